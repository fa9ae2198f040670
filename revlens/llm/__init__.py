"""Operations of a training-data pipeline over ``documents``, ``pages``, ``benchmark`` and ``labels``.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface; ``queries``
binds them to the tables and derives the digest columns.
"""
