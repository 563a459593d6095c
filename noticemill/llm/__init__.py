"""Operators for preparing training data: sharding, decontamination, licences, near-duplicates, toxicity, secrets,
token files, language and packing. Nothing outside this folder (but the guarded registration) imports it."""
