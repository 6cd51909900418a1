"""Training-data operators: tokens, packing, toxicity, quality, licences, near-duplicates, chat logs, shards,
fingerprints and a language model. Nothing else in the library imports this package."""
