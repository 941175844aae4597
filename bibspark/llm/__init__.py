"""Training-data operators: secrets, licences, token output, PII, quality, dedup, BPE, WARC, decontamination."""
