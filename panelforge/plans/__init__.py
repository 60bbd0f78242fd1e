"""Registered queries: one Spark plan and, where SQL can say it, one SQL twin per operator."""

from importlib import import_module

MODULES = (
    "panel_queries",
    "window_queries",
    "aggregate_queries",
    "join_queries",
    "score_queries",
    "blend_queries",
    "quality_queries",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"panelforge.plans.{name}")
