"""Registry of named queries over the driver tables, each with its DuckDB oracle.

``@register(name, oracle=sql)`` records a ``(spark, sf_dir) -> DataFrame``
callable under an operator ID of SURVEY section 2. ``oracle`` is the same
query in plain SQL with ``{adapter}`` placeholders (expanded to CTEs by
``tables.duck_sql``); ``None`` marks a query with no SQL equivalent.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str | None] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        ORACLES[name] = oracle
        return fn
    return deco


# --- SQL fragment helpers for oracles (plain string building) ---------------

def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_any(expr: str, terms) -> str:
    if not terms:
        return "FALSE"
    return "(" + " OR ".join(f"contains({expr}, {q(t.lower())})" for t in terms) + ")"


def sql_first(expr: str, terms) -> str:
    if not terms:
        return "CAST(NULL AS STRING)"
    return "COALESCE(" + ", ".join(
        f"CASE WHEN contains({expr}, {q(t.lower())}) THEN {q(t.lower())} END" for t in terms) + ")"


MODULES = ("q_intake", "q_tracker", "q_text", "q_linkage", "q_logs", "q_similar", "q_lint", "q_pay", "q_watch", "q_profile", "q_intake_form", "q_shaping",
           "q_records", "q_sources", "q_scoring", "q_streaming")


def load_all():
    """Import every query module so their ``@register`` calls run."""
    import importlib
    import importlib.util
    for m in MODULES:
        name = f"lantern.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
    return QUERIES, ORACLES
