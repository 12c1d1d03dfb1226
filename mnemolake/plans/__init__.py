"""Queries over the store: adapters, the registry, and the families of queries."""


def load():
    """All queries and their SQL."""
    from mnemolake.plans import extraction, more, named, relational, retrieval, scalar  # noqa: F401
    from mnemolake.plans.catalog import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
