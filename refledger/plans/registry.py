"""Registered queries, and the tables and bindings they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refledger.operators import stage
from refledger.plans.bindings import BINDINGS, DEALT, ORACLE_BINDINGS, rule_lines, rule_parts

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_REFERENCE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
_SHARED = BINDINGS | ORACLE_BINDINGS


class Tables:
    """Test tables and the bindings derived from them, read by name as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "rule_parts":
                self._known[name] = rule_parts(self["lineitem"], self["part"])
            elif name == "rule_lines":
                self._known[name] = rule_lines(self["rule_parts"])
            else:
                self._known[name] = self.sql(BINDINGS[name], DEALT.get(name, {}))
        return self._known[name]

    def sql(self, text: str, dealt: dict[str, list[str]] | None = None) -> DataFrame:
        """Rows of a statement; `dealt` names tables that are dealt out by some of their columns first."""
        names = dict.fromkeys(_REFERENCE.findall(text))
        tables = {n: self[n] for n in names}
        tables |= {n: stage.dealt(tables[n], *cols) for n, cols in (dealt or {}).items()}
        return self.spark.sql(text, **tables)


def _with_bindings(text: str) -> str:
    """The same statement for the checking engine: bindings become common table expressions."""
    ordered: dict[str, None] = {}

    def visit(sql: str) -> None:
        for name in _REFERENCE.findall(sql):
            if name in _SHARED and name not in ordered:
                visit(_SHARED[name])
                ordered[name] = None

    visit(text)

    def plain(sql: str) -> str:
        return _REFERENCE.sub(lambda m: m.group(1), sql).replace("{{", "{").replace("}}", "}")

    ctes = [f"{name} AS ({plain(_SHARED[name])})" for name in ordered]
    body = plain(text).strip()
    if not ctes:
        return body
    if body.startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body.removeprefix('WITH ')}"
    return f"WITH {', '.join(ctes)} {body}"


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is SQL over {table} and {binding} names that gives the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = _with_bindings(oracle)
        return fn

    return add
