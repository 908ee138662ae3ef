"""Operations of a training-data pipeline: dedup, mixing, scanning, scoring, tokenising, searching.

Nothing else in the package imports this subpackage.
"""
