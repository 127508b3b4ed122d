"""Training-data operators: packing, de-duplication, language, archives, extraction, quality, mixing."""
