"""Operators of a training-data pipeline: quality, toxicity, secrets, duplicates, mixing, language, URLs, decontamination."""
