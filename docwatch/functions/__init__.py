"""functions of docwatch; every function takes and returns DataFrames or Columns."""
