"""Operators for large training-data corpora: sharding, token files, packing, near-duplicates,
page text, language, decontamination, line runs, toxicity and fingerprints.

Nothing else in the library imports this package. ``densitykit.llm.queries`` registers one
query per operator.
"""
