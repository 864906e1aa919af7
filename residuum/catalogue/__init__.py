"""Queries over the driver tables, one module per group of operators."""

from importlib import import_module

GROUPS = ["contact_queries", "structure_queries", "score_queries", "family_queries", "state_queries", "render_queries", "dataset_queries", "episode_queries", "source_queries"]


def load_all() -> None:
    for group in GROUPS:
        import_module(f"{__name__}.{group}")
