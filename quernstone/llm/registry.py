"""All queries of this subpackage with their SQL."""

from quernstone.llm import queries_abuse, queries_boilerplate, queries_lines, queries_near, queries_quality, queries_split, queries_tokens

MODULES = [queries_near, queries_quality, queries_boilerplate, queries_split, queries_lines, queries_tokens, queries_abuse]


def queries() -> dict:
    """Name to callable(spark, folder)."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    """Name to DuckDB SQL."""
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
