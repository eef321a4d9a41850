"""Training-data operators: packing, language models, deduplication, archives, search, scans."""
