"""Operators for preparing training text: extraction, licences, near
duplicates, repeated passages, archives, token files, fingerprints, toxicity,
packing and decontamination. Nothing else in the library imports this package.
"""
