"""Substring dedup by winnowing and a join of windows, in place of relative Lempel-Ziv parsing.

1. Reference blocks: of the ``block`` words that begin at each position, the least hash in every window of ``window`` words is
   chosen (so equal windows choose the same block). The index holds each chosen block with the least and greatest id it is in;
   blocks of one document alone are dropped, so what follows grows with what is repeated.
2. Candidates: all windows of a document whose chosen block is in the index. There is no greedy parse, and no factor with a
   start, a length and a reference.
3. Shared blocks alone prove nothing, so these windows are joined by the hash of their whole content: a window is a duplicate if
   its least id over the corpus is smaller than the document's. Runs of such windows are the spans.

Documents that equal an earlier one word by word are settled first. Texts are shuffled once; hot blocks
and windows are aggregated before the shuffle, and the joins back have one row per key on one side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document, map_batches, settle, stored, text_of
from .words import U64, Words, mix, sliding_argmin, window_hashes, word_chunks


@dataclass(frozen=True)
class Spans:
    """A span is at least ``window`` words that stand in a document with a smaller id."""

    window: int = 50
    block: int = 25


def sequence_digests(chunk: Words) -> list[str]:
    return [hashlib.blake2b(chunk.joined(i), digest_size=16).hexdigest() for i in range(chunk.hi - chunk.lo)]


def index_blocks(h: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: hashes of all blocks, and for every window the position of the block it chooses; then the chosen ones."""
    blocks = window_hashes(h, spans.block)
    owner = sliding_argmin(blocks, spans.window - spans.block + 1)
    return blocks, owner, owner[np.flatnonzero(np.diff(owner, prepend=-1))] if len(owner) else owner


def chosen_blocks(docs: DataFrame, spans: Spans) -> DataFrame:
    """``doc_id, text_key, seq, n_words, blocks`` per input row: digest of the word sequence and hashes of its reference blocks."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc_id")
        for chunk in word_chunks(batch.column("text")):
            h = chunk.hashes()
            out = []
            for i in range(chunk.hi - chunk.lo):
                blocks, _, chosen = index_blocks(h[chunk.offsets[i]:chunk.offsets[i + 1]], spans)
                out.append(np.unique(blocks[chosen]).view(np.int64))
            offs = np.concatenate(([0], np.cumsum([len(x) for x in out])))
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield {"doc_id": ids.slice(chunk.lo, chunk.hi - chunk.lo), "text_key": batch.column("text_key").slice(chunk.lo, chunk.hi - chunk.lo), "seq": sequence_digests(chunk), "n_words": chunk.counts, "blocks": lists}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {id_type}, text_key long, seq string, n_words long, blocks array<long>")


def factor_windows(docs: DataFrame, spans: Spans) -> DataFrame:
    """``doc_id, text_key, start, a, b``: all windows of ``docs(doc_id, text, shared)`` that rest on a shared block; (a, b) is the content."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, keys, shared = batch.column("doc_id"), batch.column("text_key"), batch.column("shared")
        for chunk in word_chunks(batch.column("text")):
            h = chunk.hashes()
            other = mix(h, 3)
            row, start, a, b = [], [], [], []
            for i in range(chunk.hi - chunk.lo):
                lo, hi = chunk.offsets[i], chunk.offsets[i + 1]
                blocks, owner, _ = index_blocks(h[lo:hi], spans)
                known = shared[chunk.lo + i]
                if not known.is_valid or not len(owner):
                    continue
                at = np.flatnonzero(np.isin(blocks, known.values.to_numpy().view(U64))[owner])
                row.append(np.full(len(at), chunk.lo + i))
                start.append(at)
                a.append(window_hashes(h[lo:hi], spans.window)[at])
                b.append(window_hashes(other[lo:hi], spans.window)[at])
            if row:
                rows = pa.array(np.concatenate(row))
                yield {"doc_id": ids.take(rows), "text_key": keys.take(rows), "start": np.concatenate(start).astype(np.int32), "a": np.concatenate(a).view(np.int64),
                       "b": (np.concatenate(b) >> U64(32)).astype(np.uint32).view(np.int32)}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {id_type}, text_key long, start int, a long, b int")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that documents with different ids have, and the least of these ids (null is below all)."""
    i, absent = F.col("doc_id"), F.max(F.col("doc_id").isNull().cast("int"))
    ends = rows.groupBy(*keys).agg(F.min(i).alias("m"), F.max(i).alias("x"), absent.alias("z"))
    return ends.where("m <> x or z = 1 and m is not null").select(*keys, F.when(F.col("z") == 0, F.col("m")).alias("least"))


def renamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"{k}_" for k in keys})


def same_row(keys: list[str]) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))


def removed_words(docs: DataFrame, spans: Spans = Spans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``, one row per input row.

    Every word is removed that a window of ``window`` words covers which also starts in a document with a smaller id; windows
    are judged on the input. ``kept_text`` has the other words, joined by one space. Null and empty texts have no words. Rows
    with a null id are below all others and never lose words; rows with equal ids do not count against each other. An empty
    table gives no rows.
    """
    docs = document(docs, id_col, text_col).withColumn("text_key", F.xxhash64(text_of("text")))
    spark, row = docs.sparkSession, ["doc_id", "text_key"]
    index = stored(chosen_blocks(docs, spans), "block")
    # Word-by-word copies: the least id of a sequence is its reference; documents with other ids are copies as a whole.
    first = repeated(index.where(F.col("n_words") >= spans.window), ["seq"]).select("seq", "least")
    copies = stored(index.select(*row, "seq").join(first, "seq").where("not doc_id <=> least").select(*row).distinct(), "copy")
    parsed = index.where(F.size("blocks") > 0).select(*row, "blocks").join(renamed(copies, row), same_row(row), "left_anti")
    entries = parsed.distinct().select(*row, F.explode_outer("blocks").alias("h"))
    hot = stored(repeated(entries, ["h"]).select("h"), "repeated")  # stored, so that the join back can split hot keys
    shared = entries.join(hot, "h").groupBy(*row).agg(F.collect_set("h").alias("shared"))
    shared = stored(shared, "shared")
    settle(spark)
    with_blocks = docs.join(renamed(shared, row), same_row(row)).select(*row, "text", "shared")
    windows = stored(factor_windows(with_blocks, spans), "window")
    settle(spark)
    least = stored(repeated(windows, ["a", "b"]), "repeated")
    hits = windows.join(least, ["a", "b"]).where("doc_id > least or least is null and doc_id is not null")
    found = hits.groupBy(*row).agg(F.collect_set("start").alias("starts")).withColumn("copied", F.lit(False))
    found = found.unionByName(copies.withColumn("starts", F.array().cast("array<int>")).withColumn("copied", F.lit(True)))
    found = stored(found, "hit")
    settle(spark)
    out = docs.join(renamed(found, row), same_row(row), "left")
    width = spans.window

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        starts, copied = batch.column("starts"), batch.column("copied")
        for chunk in word_chunks(batch.column("text")):
            gone, kept = [], []
            for i in range(chunk.hi - chunk.lo):
                n, at = int(chunk.counts[i]), starts[chunk.lo + i]
                keep = np.ones(n, bool)
                if copied[chunk.lo + i].as_py():
                    keep[:] = False
                elif at.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    s = at.values.to_numpy()
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + width, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                gone.append(n - int(keep.sum()))
                kept.append(chunk.joined(i, np.flatnonzero(keep)).decode())
            yield {"doc_id": batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo), "n_words": chunk.counts, "n_removed": gone, "kept_text": kept}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(out.select("doc_id", "text", "starts", "copied"), cut, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
