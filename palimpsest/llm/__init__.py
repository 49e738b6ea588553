"""Training-data operators: archives, near-duplicates, tokens, licences, leaks, toxicity, shards, scores, fingerprints."""
