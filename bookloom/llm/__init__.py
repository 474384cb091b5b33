"""Training-data operators: dedup, scans, extraction, language, quality, decontamination, tokens."""
