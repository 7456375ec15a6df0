"""All document queries: importing the modules registers them."""

from formweave.plans import cases, extractions, forms, pipelines, queries, rasters, word_pages  # noqa: F401
from formweave.plans.registry import ORACLES, QUERIES  # noqa: F401
