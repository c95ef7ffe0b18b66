"""Training-data operators: search, deduplication, extraction, classifiers,
archives, token files and packing.  Nothing outside this package imports it."""
