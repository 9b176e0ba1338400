"""Training-data operators: search, near duplicates, filters, extraction, packing and archives."""
