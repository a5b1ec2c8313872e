"""Operators for large-scale text corpora: tokens, private data, duplicates,
packing, toxicity, decontamination, fingerprints, secrets, quality, language.

Nothing else in the library imports this subpackage.
"""
