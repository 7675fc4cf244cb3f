"""CTE library for the oracle SQL: name -> (dependencies, text). `q` emits only the CTEs a query needs."""

from __future__ import annotations

from lurewatch.plans.views import VIEWS, oracle_view

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def q(final: str, *deps: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in CTES[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    if final.lstrip().startswith("WITH"):
        final = f"SELECT * FROM ({final})"
    return (f"WITH {body}\n" if body else "") + final


for _v, (_src, _sql) in VIEWS.items():
    cte(_v, tuple(x for x in _src if x in VIEWS), oracle_view(_v))


def count(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {s(pattern)})) AS DOUBLE)"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {s(pattern)})"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def rows(columns: str, values) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return s(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(x) for x in r) + ')' for r in values)}) AS t({columns})"
