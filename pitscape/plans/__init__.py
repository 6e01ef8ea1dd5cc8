"""Registered queries, by topic."""

from __future__ import annotations

import importlib

MODULES = (
    "panel_queries", "score_queries", "label_queries", "return_queries", "geometry_queries", "model_queries", "audit_queries",
    "recompute_queries", "ladder_queries", "summary_queries", "relabel_queries", "null_queries",
)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"pitscape.plans.{name}")
