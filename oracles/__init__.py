"""Oracle SQL per registered query, for a second engine to run on the same tables."""

from importlib import import_module

MODULES = ("q_features", "q_scoring", "q_corpus", "q_mailbox", "q_graph", "q_models", "q_streams")


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(import_module(f"oracles.{m}").ORACLE)
    return out
