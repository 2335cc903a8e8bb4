"""All queries of the library, by name, with the DuckDB SQL of each."""

from __future__ import annotations

from . import content_queries, interaction_queries, model_queries, trained_queries

MODULES = (interaction_queries, model_queries, content_queries, trained_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def entry(spark, sf_dir: str):
    """Holdout split, popularity, unseen top ten, metrics: the leaderboard of two models."""
    return model_queries.leaderboard_join(spark, sf_dir)
