"""All registered queries of the library's own operators."""

from docwatch.plans import changes, documents, entities, evidence, extraction, files, frontier, messages, monitoring, pages, pages_docs, stories  # noqa: F401
from docwatch.plans.registry import ORACLES, QUERIES  # noqa: F401
