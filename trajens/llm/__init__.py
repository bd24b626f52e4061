"""Training-data operators: dedup, mixing, packing, search, PII, sharding, quality, language ID,
token counts. Nothing else in the library imports this subpackage."""
