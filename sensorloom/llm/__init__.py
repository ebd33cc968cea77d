"""Training-data operators: scans, de-duplication, extraction, counting and packing of text."""
