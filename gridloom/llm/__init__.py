"""Training-data operators: fingerprints, near duplicates, language, licences, quality, lines, PII, BPE, packing."""
