"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it; ``queries.py`` holds its thin
``opN_*`` queries and ``oracles.py`` the DuckDB SQL of those SQL can express.
"""
