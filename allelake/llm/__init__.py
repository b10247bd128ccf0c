"""Training-data operators: tokenisation, deduplication, quality, licences, scoring and packing."""
