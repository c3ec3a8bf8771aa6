"""All queries of the core with their SQL, from the modules of this folder."""

from quernstone.plans import corpus, relational, rules, storage, streams

MODULES = [relational, corpus, rules, streams, storage]


def queries() -> dict:
    """Name to callable(spark, folder)."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    """Name to DuckDB SQL."""
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
