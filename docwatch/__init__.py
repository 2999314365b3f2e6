"""docwatch: DataFrame operators for captured pages, feeds, messages and text corpora."""
