"""The query catalogue: operators applied to the tables, with DuckDB SQL for each that SQL can express."""

from . import governance, knowledge, lifecycle, operations, profiles, relational, retrieval, scalars, similarity, stores, views

PARTS = (relational.CATALOGUE, similarity.CATALOGUE, lifecycle.CATALOGUE, profiles.CATALOGUE, scalars.CATALOGUE, knowledge.CATALOGUE, views.CATALOGUE, governance.CATALOGUE, retrieval.CATALOGUE, operations.CATALOGUE, stores.CATALOGUE)


def all_queries() -> dict:
    return {k: f for c in PARTS for k, f in c.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: s for c in PARTS for k, s in c.sql.items()}
