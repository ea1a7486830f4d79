"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of ``block_words``. Each output shard draws how many
blocks of every source it takes: a multinomial draw, conditioned on the corpus totals, which a binary tree over the shards
hands down (every node splits its counts between its halves with its own seeded generator), so shards draw independently of
each other and the totals still meet the targets. The k-th slot of a source is mapped through pseudorandom permutations of
the source's block numbers, one for each epoch, and joined with the blocks by number.

No source is held by one task: positions come from prefix sums over about sqrt(n) pseudorandom stretches of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, stored, text_of
from .words import word_chunks

SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` go round the sources in code point order, null last; the mix is ``share`` of all words, and no source gives
    more than ``repeats`` times its words."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    repeats: int = 2
    block_words: int = 64
    shard_blocks: int = 256
    seed: int = 11


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != "")).cast("long")


def targets_of(sizes: list[int], mix: Mix = Mix()) -> list[float]:
    """Words to take of each source: by weight; what a source cannot give is reshared until none is above its limit."""
    weights = [float(mix.weights[i % len(mix.weights)]) for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), mix.share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > mix.repeats * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in full:
            out[i] = float(mix.repeats * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def drawn(marked: int, other: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` slots drawn without return are ``marked``: a hypergeometric draw, exact for any size.

    Every slot is taken by itself with the probability that gives ``take`` on average. What is missing is then drawn from the rest,
    and what is too much is drawn back out of those taken, in the same way; both are about the root of ``take``.
    """
    out, sign = 0, 1
    while take:
        if take == marked + other or not marked:
            return out + sign * min(marked, take)
        p = take / (marked + other)
        m, o = int(rng.binomial(marked, p)), int(rng.binomial(other, p)) if other else 0
        out += sign * m
        if m + o <= take:
            marked, other, take = marked - m, other - o, take - m - o
        else:
            marked, other, take, sign = m, o, m + o - take, -sign
    return out


def split_counts(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A draw of ``take`` of ``sum(counts)`` slots without return, by source (multivariate hypergeometric)."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = drawn(c, rest, take, rng)
        take -= int(out[i])
    return out


KNOWN = 10_000  # splits a task remembers; neighbouring shards share nearly all of theirs


def shard_draw(quota: np.ndarray, shards: int, shard: int, mix: Mix, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source in ``shard`` and in all shards before it. ``known`` remembers the splits of the tree."""
    known = {} if known is None else known
    if len(known) > KNOWN:
        known.clear()
    total = int(quota.sum())
    bound = lambda k: total * k // shards
    lo, hi, counts, before = 0, shards, quota.astype(np.int64), np.zeros(len(quota), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (lo, hi) not in known:
            known[lo, hi] = split_counts(counts, bound(mid) - bound(lo), np.random.default_rng([mix.seed, lo, hi]))
        left = known[lo, hi]
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, counts - left, before + left
    return counts, before


def permuted(k: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """A pseudorandom permutation of 0 … n-1 at ``k``: four rounds that shift one coordinate of a grid of about root n by root n by a
    hash of the other, walked until it falls below ``n``. The grid has hardly more than ``n`` places, so few walk on."""
    wide = max(1, math.isqrt(max(1, n) - 1) + 1)
    sides = (np.uint64(-(-n // wide) or 1), np.uint64(wide))
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        at = [x // sides[1], x % sides[1]]
        for i, r in enumerate(keys):
            f = (at[1 - i % 2] + r) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(31)
            f = (f * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)
            at[i % 2] = (at[i % 2] + f) % sides[i % 2]
        return at[0] * sides[1] + at[1]

    out = once(k.astype(np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def positions(docs: DataFrame) -> DataFrame:
    """``docs(source, doc_id, size, digest, …)`` with ``first``: the document's first word within its source."""
    n = docs.agg(F.count(F.lit(1))).first()[0]
    stretches = max(1, math.isqrt(n))
    d = docs.withColumn("stretch", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(stretches)))
    before = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    heads = d.groupBy("source", "stretch").agg(F.sum("size").alias("n")).withColumn("head", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = W.partitionBy("source", "stretch").orderBy("doc_id", "digest", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    h = heads.select(F.col("source").alias("s_"), F.col("stretch").alias("t_"), "head")
    d = d.join(h, d["source"].eqNullSafe(h["s_"]) & (d["stretch"] == h["t_"]))
    return d.withColumn("first", F.col("head") + F.col("inner")).drop("s_", "t_", "head", "inner", "stretch")


@dataclass
class Source:
    source: str | None
    size: int
    target: float
    blocks: int
    quota: int


def source_plan(docs: DataFrame, mix: Mix) -> list[Source]:
    """Sizes, targets and numbers of blocks to draw. One row per source comes to the driver; sources are few by nature."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"] or 0) for r in rows]
    out = []
    for r, n, t in zip(rows, sizes, targets_of(sizes, mix), strict=True):
        blocks = -(-n // mix.block_words)
        out.append(Source(r["source"], n, t, blocks, min(mix.repeats * blocks, round(t * blocks / n)) if n else 0))
    return out


def slots(spark, plan: list[Source], mix: Mix) -> DataFrame:
    """``shard, slot, s (number of the source), block`` of the whole mix; every shard works out its own part.

    The planner takes the table for as small as the list of shards, so it is marked against being broadcast.
    """
    quota, blocks = np.array([p.quota for p in plan], np.int64), [p.blocks for p in plan]
    shards = max(1, -(-int(quota.sum()) // mix.shard_blocks))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            for shard in frame["id"].tolist():
                counts, before = shard_draw(quota, shards, shard, mix, known)
                s = np.repeat(np.arange(len(plan)), counts)
                block = np.zeros(len(s), np.int64)
                for i in np.flatnonzero(counts).tolist():
                    k = before[i] + np.arange(counts[i])
                    for epoch in np.unique(k // blocks[i]).tolist():
                        at = k // blocks[i] == epoch
                        block[np.flatnonzero(s == i)[at]] = permuted(k[at] % blocks[i], blocks[i], [mix.seed, i, epoch])
                order = np.random.default_rng([mix.seed, 1, shard]).permutation(len(s))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(s)), "s": s[order], "block": block[order]})

    if not quota.sum():
        return spark.createDataFrame([], "shard long, slot long, s int, block long")
    tasks = max(1, min(shards, -(-shards // 64)))
    return spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, slot long, s int, block long").hint("merge")


def numbered(docs: DataFrame, plan: list[Source]) -> DataFrame:
    """Adds ``s``, the source's number. The list of sources is small by nature and checked by ``source_plan``."""
    names = docs.sparkSession.createDataFrame([(p.source, i, p.size, p.target) for i, p in enumerate(plan)], "source_ string, s int, source_size long, target double")
    return docs.join(names, docs["source"].eqNullSafe(names["source_"])).drop("source_")


def pieces(docs: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block it reaches into: ``block``, ``words`` of it there, and the first of them in the document."""
    last = F.floor((F.col("first") + F.col("size") - 1) / block_words)
    d = docs.where("size > 0").withColumn("block", F.explode_outer(F.sequence(F.floor(F.col("first") / block_words), last)))
    begin = F.greatest(F.col("block") * block_words, F.col("first"))
    end = F.least((F.col("block") + 1) * block_words, F.col("first") + F.col("size"))
    return d.withColumn("words", (end - begin).cast("long")).withColumn("offset", (begin - F.col("first")).cast("long"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    t = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(t).alias("size"), F.xxhash64(t).alias("digest"))


def mix_counts(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken``: what the mix takes of every document, without its texts.

    One row per input row. Null and empty texts have size 0 and give nothing; null sources are one source, the last; documents
    with a null id count like others; repeated rows are separate documents. An empty table gives no rows. Reruns agree.
    """
    spark = docs.sparkSession
    d = stored(positions(sized(docs, id_col, text_col, source_col)), "mix")
    plan = source_plan(d, mix)
    d = stored(numbered(d, plan).withColumn("row", F.monotonically_increasing_id()), "mix")  # stored: the row numbers hold from now on
    drawn = slots(spark, plan, mix).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    part = pieces(d, mix.block_words).select("row", "s", "block", "words").join(drawn, ["s", "block"])
    taken = part.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = d.join(taken.hint("merge"), "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: ``shard, slot, source, block, doc_id, offset, n_words, text``.

    A slot is one block; its rows are the pieces of documents in it, in order of ``first`` (word within the source). ``text``
    holds the piece's words, joined by one space. Nulls and repeats as in ``mix_counts``.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_of(text_col).alias("text"))
    d = d.withColumn("size", n_words(F.col("text"))).withColumn("digest", F.xxhash64("text"))
    place = stored(positions(d.drop("text")).dropDuplicates(["source", "doc_id", "digest", "first"]), "mix")
    plan = source_plan(place, mix)
    # Equal rows hold the same words, so any one of them may stand at any of their places.
    spots = numbered(place, plan).groupBy("doc_id", "digest", "source", "s", "size").agg(F.collect_list("first").alias("firsts"))
    texts = d.dropDuplicates(["doc_id", "digest", "source"]).select(F.col("doc_id").alias("i_"), F.col("digest").alias("d_"), F.col("source").alias("o_"), "text")
    spots = spots.join(texts, spots["doc_id"].eqNullSafe(texts["i_"]) & (spots["digest"] == texts["d_"]) & spots["source"].eqNullSafe(texts["o_"])).drop("i_", "d_", "o_")
    width = mix.block_words

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        firsts = batch.column("firsts").to_pylist()
        for chunk in word_chunks(batch.column("text")):
            out = {k: [] for k in ("row", "block", "first", "offset", "n_words", "text")}
            for i in range(chunk.hi - chunk.lo):
                a, b = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
                for first in firsts[chunk.lo + i] if b > a else ():
                    for block in range(first // width, (first + b - a - 1) // width + 1):
                        lo, hi = max(block * width, first), min((block + 1) * width, first + b - a)
                        keep = np.arange(lo - first, hi - first)
                        for k, v in zip(out, (chunk.lo + i, block, lo, lo - first, hi - lo, chunk.joined(i, keep).decode()), strict=True):
                            out[k].append(v)
            if out["row"]:
                rows = pa.array(out.pop("row"))
                yield out | {"doc_id": batch.column("doc_id").take(rows), "source": batch.column("source").take(rows), "s": batch.column("s").take(rows)}

    id_type = docs.schema[id_col].dataType.simpleString()
    part = map_batches(spots, cut, f"s int, block long, doc_id {id_type}, source string, first long, offset long, n_words long, text string")
    return slots(spark, plan, mix).join(part, ["s", "block"]).select("shard", "slot", "source", "block", "doc_id", "offset", "n_words", "first", "text")
