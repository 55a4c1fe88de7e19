"""Operations of a training-data pipeline: redaction, classifiers, near-duplicate
joins, packing, token counts, exact search, URL rules and source mixing.

Nothing else in the library imports this subpackage; it imports general
helpers of the library. ``queries.py`` registers its queries.
"""
