"""Operators of a training-data pipeline (packing, token counts, personal
data, fingerprints, language ID, BPE, near-dedup, LM scoring, quality).

Nothing else in the library imports this subpackage."""
