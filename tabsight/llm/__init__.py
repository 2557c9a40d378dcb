"""Operations of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""
