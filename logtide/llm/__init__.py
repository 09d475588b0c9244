"""Training-data operators: decontamination, toxicity, mixing, near-duplicates, extraction,
fingerprints, token counts, language-model scores, language identification and personal data.

Nothing else in the library imports this package.
"""
