"""All registered queries by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_features", "q_scoring", "q_corpus", "q_mailbox", "q_graph", "q_models", "q_streams")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(import_module(f"lurewatch.plans.{m}").QUERIES)
    return out
