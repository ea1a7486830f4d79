"""Similarity and fidelity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as h
from ..functions.arrays import rows_of
from ..functions.keys import FILE_PREFIX, nfkc, strip
from ..functions.markup import count
from ..functions.urls import SITE, Site
from ..session import stored
from .aggregates import jaccard


def compact_text(c: Column) -> Column:
    """Text for comparison: no media tags, no blanks, no zero-width characters, lower case."""
    t = F.regexp_replace(nfkc(c), r"(?i)<\s*(?:img|video)\b[^>]*>", " ")
    return F.lower(F.regexp_replace(t, r"[​-‍⁠﻿\s]+", ""))


@F.pandas_udf(T.DoubleType())
def _gram_jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaccard similarity of the sets of character trigrams (shorter grams for shorter texts), as arrays of numbers."""

    def grams(text: str, n: int) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        key = points[: len(points) - n + 1]
        for i in range(1, n):
            key = (key << 21) | points[i : len(points) - n + 1 + i]
        return np.unique(key)

    def one(a: str, b: str) -> float:
        if a == b:
            return 1.0
        n = min(3, len(a), len(b))
        if n == 0:
            return 0.0
        x, y = grams(a, n), grams(b, n)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common / (len(x) + len(y) - common)

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def with_text_similarity(pairs: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Add the Jaccard similarity of the character trigrams.

    The texts are compacted in the JVM; a set of trigrams per row is far quicker as a sorted number array than as an array
    of strings, so that step runs in numpy.
    """
    return pairs.withColumn(name, _gram_jaccard(compact_text(F.coalesce(left, F.lit(""))), compact_text(F.coalesce(right, F.lit("")))))


def ratio_similarity(a: Column, b: Column) -> Column:
    """Smaller count over larger; two zeros are equal."""
    a, b = F.greatest(F.lit(0), a), F.greatest(F.lit(0), b)
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def page_metrics(html: Column, site: Site = SITE) -> dict[str, Column]:
    """What is compared between an original page and its copy."""
    targets = F.transform(h.all_matches(html, rf"""(?i)<a\b[^>]*\shref=["']{site.link_prefix}([^"'#?]+)""", 1), h.percent_decode)
    is_file = lambda x: x.rlike(FILE_PREFIX)
    bare = lambda x: F.regexp_replace(x, FILE_PREFIX, "")
    alts = F.transform(h.all_matches(html, r"(?i)<img\b[^>]*>"), lambda t: strip(F.coalesce(h.attribute(t, "alt"), F.lit(""))))
    ids = h.all_matches(html, r"""(?i)<iframe\b[^>]*\ssrc=["'][^"']*(?:youtube\.com/(?:watch\?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{6,})""", 1)
    return {
        "text": h.visible_text(html),
        "links": F.array_distinct(F.filter(targets, lambda x: ~is_file(x))),
        "images": F.array_distinct(F.transform(F.filter(F.concat(targets, alts), is_file), bare)),
        "youtube": F.array_distinct(ids),
        "tables": count(html, r"(?i)<table\b"),
        "rows": count(html, r"(?i)<tr\b"),
        "cells": count(html, r"(?i)<t[dh]\b"),
        "foldings": count(html, r"(?i)<details\b"),
    }


# Weights of the fidelity score.
WEIGHTS = {"text": 0.35, "links": 0.15, "images": 0.05, "youtube": 0.05, "tables": 0.10, "rows": 0.10, "cells": 0.10, "foldings": 0.10}


def fidelity(pairs: DataFrame, key: str, original: str, rendered: str, site: Site = SITE) -> DataFrame:
    """Weighted agreement of a page and its copy, with the parts it consists of."""
    a, b = page_metrics(F.col(original), site), page_metrics(F.col(rendered), site)
    d = pairs.select(key, *[c.alias(f"a_{n}") for n, c in a.items()], *[c.alias(f"b_{n}") for n, c in b.items()])
    d = with_text_similarity(d, "a_text", "b_text", "text").drop("a_text", "b_text")
    sets = {n: jaccard(F.col(f"a_{n}"), F.col(f"b_{n}")) for n in ("links", "images", "youtube")}
    ratios = {n: ratio_similarity(F.col(f"a_{n}"), F.col(f"b_{n}")) for n in ("tables", "rows", "cells", "foldings")}
    d = d.select(key, "text", *[c.alias(n) for n, c in {**sets, **ratios}.items()])
    return d.withColumn("score", F.round(sum(F.col(n) * w for n, w in WEIGHTS.items()), 4))


# --- tables ---------------------------------------------------------------------------------------------------------

# a pair below this token similarity cannot reach a total of 0.32 even with equal rows and columns
MIN_TOKEN = (0.32 - 0.14 - 0.08) / 0.78


def tokens(c: Column) -> Column:
    """Distinct tokens of at least two characters."""
    t = F.lower(strip(F.regexp_replace(nfkc(c), r"\s+", " ")))
    parts = F.filter(F.split(t, r"[\s·|/(),:;\[\]{}<>]+"), lambda x: F.length(x) >= 2)
    return F.array_distinct(parts)


def _closeness(a: Column, b: Column) -> tuple[Column, Column]:
    """How close two counts are, as a fraction: the smaller over the larger, 0 over 1 if one is not positive."""
    some = (a > 0) & (b > 0)
    return F.when(some, F.least(a, b)).otherwise(0).cast("long"), F.when(some, F.greatest(a, b)).otherwise(1).cast("long")


# Tables of one side that stay together, parts of a side at most, offers an original brings from a part.
PART, PARTS, OFFERS = 512, 16, 256


def _parts(original: DataFrame, baseline: DataFrame) -> DataFrame:
    """Documents with more than ``PART`` tables on a side, with the number of parts each side is dealt into."""
    one, none = F.lit(1).alias("o"), F.lit(0).alias("b")
    n = original.select("doc_id", one, none).unionByName(baseline.select("doc_id", none.alias("o"), one.alias("b"))).groupBy("doc_id").agg(F.sum("o").alias("o"), F.sum("b").alias("b"))
    parts = {p: F.least(F.lit(PARTS), F.greatest(F.lit(1), F.ceil(F.col(p) / PART))).cast("int").alias(f"{p}_parts") for p in "ob"}
    return stored(n.where(F.greatest("o", "b") > PART).select("doc_id", *parts.values()), "table-parts")


def table_candidates(original: DataFrame, baseline: DataFrame) -> DataFrame:
    """Pairs of tables of the same document that could be matched, with total and token score.

    Sides have ``(doc_id, idx, text, n_rows, n_cols)``. The tokens of a table move once, to the others of its document, where
    all pairs are scored as they are joined; only scores go on. A side of more than ``PART`` tables is dealt into parts, at most
    ``PARTS`` of them, and every part of one side meets every part of the other in a place of its own, so such a document is
    worked on by up to ``PARTS`` squared tasks and its tokens move at most ``PARTS`` times.
    """
    parts = _parts(original, baseline)

    def side(df: DataFrame, p: str, q: str) -> DataFrame:
        d = df.select("doc_id", F.col("idx").alias(f"{p}_idx"), tokens(F.col("text")).alias(f"{p}_tokens"), F.col("n_rows").alias(f"{p}_rows"), F.col("n_cols").alias(f"{p}_cols"))
        d = d.join(parts, "doc_id", "left")
        part = F.pmod(F.xxhash64(f"{p}_idx"), F.coalesce(f"{p}_parts", F.lit(1))).cast("int").alias(f"{p}_part")
        copies = F.when((F.size(f"{p}_tokens") > 0) & F.col(f"{p}_idx").isNotNull(), F.sequence(F.lit(0), F.coalesce(f"{q}_parts", F.lit(1)) - 1))
        return rows_of(d, ["doc_id", f"{p}_idx", f"{p}_tokens", f"{p}_rows", f"{p}_cols", part], copies, f"{q}_part")

    pairs = side(original, "o", "b").join(side(baseline, "b", "o"), ["doc_id", "o_part", "b_part"])
    n, m = F.size("o_tokens"), F.size("b_tokens")
    # the similarity is at most the smaller size over the larger; as an item of an array the common tokens are counted once a pair
    pairs = pairs.where(F.least(n, m) / F.greatest(n, m) >= MIN_TOKEN)
    keep = ["doc_id", "o_part", "b_part", "o_idx", "b_idx", "o_rows", "b_rows", "o_cols", "b_cols", (n + m).alias("_sizes")]
    d = rows_of(pairs, keep, F.array(F.size(F.array_intersect("o_tokens", "b_tokens")).cast("long")), "_common")
    d = d.withColumn("_union", F.col("_sizes") - F.col("_common"))
    d = d.withColumn("token_score", F.col("_common") / F.col("_union")).where(F.col("token_score") >= MIN_TOKEN)
    # 0.78, 0.14 and 0.08 of three fractions over one denominator, in whole numbers
    (r, rows), (c, cols), union = _closeness(F.col("o_rows"), F.col("b_rows")), _closeness(F.col("o_cols"), F.col("b_cols")), F.col("_union")
    above = (78 * F.col("_common") * rows * cols + 14 * r * union * cols + 8 * c * union * rows).cast("decimal(19,0)")
    d = d.withColumns({"_above": above, "_below": (100 * union * rows * cols).cast("decimal(19,0)")})
    rank = F.expr("(_above * CAST(1000000000000000000 AS DECIMAL(19,0))) div _below")
    milli = F.expr("(_above * CAST(2000 AS DECIMAL(5,0)) + _below) div (_below * CAST(2 AS DECIMAL(2,0)))")
    score = F.col("token_score") * 0.78 + (r / rows) * 0.14 + (c / cols) * 0.08
    return d.select("doc_id", "o_part", "b_part", "o_idx", "b_idx", "token_score", score.alias("score"), (5 * F.col("_common") >= union).alias("enough_tokens"), rank.alias("rank"), milli.alias("milli"))


def _offers(original: DataFrame, baseline: DataFrame) -> DataFrame:
    """The best ``OFFERS`` baselines of each original in each part, of those that reach 0.32; ``last`` marks the one that more may follow."""
    best = Window.partitionBy("doc_id", "o_part", "b_part", "o_idx").orderBy(F.desc("rank"), "b_idx")
    d = table_candidates(original, baseline).where("rank >= 320000000000000000").withColumn("n", F.row_number().over(best))
    return d.where(F.col("n") <= OFFERS).select("doc_id", "o_idx", "b_idx", "rank", "milli", "enough_tokens", (F.col("n") == OFFERS).alias("last"))


def _take_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches from offers that come by document, original and rank. A document stops, in a row that is not ``taken``, at an
    original whose ``last`` offer is used up. Only the used baselines of one document are held."""
    doc = answered = object()
    used, stopped = set(), False
    for batch in batches:
        at, taken = [], []
        for i, (d, o, b, enough, last) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("doc_id", "o_idx", "b_idx", "enough_tokens", "last")), strict=True)):
            if d != doc:
                doc, answered, used, stopped = d, object(), set(), False
            if stopped or o == answered:
                continue
            if b not in used:
                answered = o
                if not enough:
                    continue
                used.add(b)
            elif last:
                stopped = True
            else:
                continue
            at.append(i)
            taken.append(not stopped)
        rows = batch.take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in ("doc_id", "o_idx", "b_idx", "milli")), pa.array(taken, pa.bool_())], ["doc_id", "o_idx", "b_idx", "milli", "taken"])


def pair_tables(original: DataFrame, baseline: DataFrame) -> DataFrame:
    """Greedy pairing per document: originals in order take their best free baseline table (ties: the first).

    The best one must reach 0.32 in total and 0.20 in tokens, otherwise the original stays unmatched. Scores are ranked as whole
    numbers (18 digits) and rounded half up to three places.

    A baseline below 0.32 decides nothing, so it is left out at once. The others are read in order, as a stream: an original's
    first offer that is not used is its answer. Only if all ``OFFERS`` from a part are used, the rest of that document is scored
    again against its free baselines. The first ``OFFERS`` open originals always get their answer, so that takes at most one
    round for each ``OFFERS`` originals of a document, and one in all for documents of so many baselines.
    """
    original, baseline = (x.select("doc_id", "idx", "text", "n_rows", "n_cols") for x in (original, baseline))
    offers, matched = _offers(original, baseline), []
    while True:
        ordered = offers.repartition("doc_id").sortWithinPartitions("doc_id", "o_idx", F.desc("rank"), "b_idx")
        kinds = T.StructType([*(offers.schema[n] for n in ("doc_id", "o_idx", "b_idx", "milli")), T.StructField("taken", T.BooleanType())])
        answered = stored(ordered.mapInArrow(_take_in_order, kinds), "table-offers")
        matched.append(answered.where("taken").select("doc_id", "o_idx", "b_idx", (F.col("milli") / 1000.0).alias("score")))
        stops = answered.where("NOT taken").select("doc_id", F.col("o_idx").alias("_from"))
        if stops.isEmpty():
            return reduce(DataFrame.unionByName, matched)
        if len(matched) == 1:  # later rounds read the documents that have stopped, and no others
            original, baseline = (stored(x.join(stops.select("doc_id"), "doc_id", "left_semi"), "table-rest") for x in (original, baseline))
        used = reduce(DataFrame.unionByName, matched).select("doc_id", F.col("b_idx").alias("idx"))
        free = baseline.join(stops.select("doc_id"), "doc_id", "left_semi").join(used, ["doc_id", "idx"], "left_anti")
        offers = _offers(original.join(stops, "doc_id").where("idx >= _from").drop("_from"), free)
