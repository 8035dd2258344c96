"""Operations of a training-data pipeline: filtering, deduplication, search, mixing, counting.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
