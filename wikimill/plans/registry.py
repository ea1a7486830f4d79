"""Registry of queries and their SQL counterparts, and access to base and derived tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from .derived import DERIVED

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Base tables (Parquet) and derived tables by name, e.g. ``t.wiki_docs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.dir.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return read_table(self.spark, self.path(name))
        if name in DERIVED:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over base and derived tables; derived ones become common table expressions."""
        for name in BASE:
            if re.search(rf"\b{name}\b", with_derived(text)):
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(with_derived(text))


def with_derived(text: str) -> str:
    """Prefix ``text`` with the derived tables it names, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name, body in DERIVED.items():
            if name not in order and re.search(rf"\b{name}\b", sql):
                visit(body)
                if name not in order:
                    order.append(name)

    visit(text)
    text = text.strip()
    recursive = bool(re.match(r"(?i)WITH\s+RECURSIVE\b", text))
    rest = re.sub(r"(?i)^WITH(\s+RECURSIVE)?\b", "", text, count=1).strip() if re.match(r"(?i)WITH\b", text) else None
    if not order:
        return text
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({DERIVED[n].strip()})" for n in order)
    return f"{head},\n{rest}" if rest is not None else f"{head}\n{text}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL counterpart when there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_derived(oracle)
        return fn

    return wrap
