"""Exact dedup of an incoming batch against immutable snapshots, screened by static binary fuse filters.

A snapshot is the digests of documents that were taken in before. It is cut into buckets by digest, and each bucket gets one
binary fuse filter (Graf and Lemire, 2022) over its distinct digests: three 8-bit cells per key, no false negatives, about
0.4 % false positives. Incoming digests are made distinct first, so a hot text is one row. Those that a filter passes are joined
with the exact bucket; digests that repeat inside the batch are found apart from the snapshot. Texts are read again for the
digests so found and for no others, and are grouped by their bytes. Only then rows learn which row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document, settle, stored, text_of
from .words import U64, mix

BUCKET_KEYS = 50_000  # keys of a bucket, about
BROADCAST_DIGESTS = 500_000  # of 64 letters: 50 MB


class BinaryFuse:
    """A static 3-wise binary fuse filter over distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.segment = max(4, 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        self.segments = max(1, -(-int(n * factor) // self.segment))
        self.cells = np.zeros((self.segments + 2) * self.segment, np.uint8)
        for self.seed in range(1, 200):
            if self._fill(keys):
                return
            if self.seed % 20 == 0:  # a small set may need more room
                self.segments += 1
                self.cells = np.zeros((self.segments + 2) * self.segment, np.uint8)
        raise RuntimeError("the keys are not distinct")

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three cells (in three neighbouring segments) and the fingerprint of each key."""
        h = mix(keys, self.seed)
        low = U64(self.segment - 1)
        first = ((h >> U64(32)) * U64(self.segments)) >> U64(32)
        g = mix(h, 1)
        cells = [(first + U64(i)) * U64(self.segment) + ((g >> U64(20 * i)) & low) for i in range(3)]
        return np.stack(cells, 1).astype(np.int64), (h ^ (h >> U64(32))).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        """Peels keys that are alone in a cell, round by round, then sets the cells in reverse order."""
        cells, prints = self.places(keys)
        size, alive, rounds = len(self.cells), np.arange(len(keys)), []
        while len(alive):
            at = cells[alive]
            alone = np.bincount(at.ravel(), minlength=size) == 1
            single = alone[at]
            peeled = single.any(1)
            if not peeled.any():
                return False
            rounds.append((alive[peeled], single[peeled].argmax(1)))
            alive = alive[~peeled]
        self.cells[:] = 0
        for k, own in reversed(rounds):
            at = cells[k]
            mine = at[np.arange(len(k)), own]
            self.cells[mine] = 0
            self.cells[mine] = prints[k] ^ self.cells[at[:, 0]] ^ self.cells[at[:, 1]] ^ self.cells[at[:, 2]]
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self.places(keys)
        return (self.cells[at[:, 0]] ^ self.cells[at[:, 1]] ^ self.cells[at[:, 2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        out = cls.__new__(cls)
        out.seed, out.segment, out.segments = (int(x) for x in np.frombuffer(data[:24], np.int64))
        out.cells = np.frombuffer(data[24:], np.uint8)
        return out


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, sha`` of every row; a null text counts as empty."""
    return docs.select("doc_id", F.sha2(text_of("text"), 256).alias("sha"))


def key_of(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def bucket_of(sha: Column, buckets: int) -> Column:
    return F.pmod(key_of(sha), F.lit(buckets)).cast("int")


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """``bucket, filter``: one filter for the distinct digests of each bucket of ``snapshot(sha)``."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(frame["key"].to_numpy().astype(np.int64).view(U64))
        return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "filter": [BinaryFuse(keys).to_bytes()]})

    keys = snapshot.select(bucket_of(F.col("sha"), buckets).alias("bucket"), key_of(F.col("sha")).alias("key")).distinct()
    return keys.groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screened(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Distinct incoming digests that a filter passes. Digests are spread evenly, so buckets are of like size."""

    def screen(keys: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(one):
            return keys[["sha"]].iloc[:0]
        passed = BinaryFuse.from_bytes(one["filter"].iloc[0]).holds(keys["key"].to_numpy().astype(np.int64).view(U64))
        return keys.loc[passed, ["sha"]]

    keys = incoming.select("sha").distinct().select("sha", bucket_of(F.col("sha"), buckets).alias("bucket"), key_of(F.col("sha")).alias("key"))
    return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen, "sha string")


def asked_texts(texts: DataFrame, asked: DataFrame, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """``texts(doc_id, text)`` with their ``sha``, for the digests of ``asked(sha, n)`` only; ``n`` counts the rows of a digest.

    Up to ``most`` digests are broadcast, so that no other text moves. Beyond that the texts are dealt by digest, but for
    digests with more than a thousandth of the asked rows: those are fewer than a thousand, and are broadcast.
    """
    texts = texts.withColumn("sha", F.sha2("text", 256))
    size = asked.agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("rows")).first()
    if size["digests"] <= most:
        return texts.join(F.broadcast(asked.select("sha")), "sha", "left_semi")
    hot = F.col("n") * 1000 > size["rows"]
    found = texts.join(F.broadcast(asked.where(hot).select("sha")), "sha", "left_semi")
    return found.unionByName(texts.join(asked.where(~hot).select("sha").hint("merge"), "sha", "left_semi"))


def exact_duplicates(incoming: DataFrame, snapshot: DataFrame, bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, known`` for all rows of both tables.

    ``known``: the text is in the snapshot. Texts are equal when their bytes are; null counts as empty. Of equal texts the row
    with the largest id stays; a null id is below all others, and repeated rows with that id all count as kept. Empty tables
    give no rows.
    """
    spark = incoming.sparkSession
    new, old = document(incoming, id_col, text_col), document(snapshot, id_col, text_col)
    rows = stored(digests(new).withColumn("old", F.lit(False)).unionByName(digests(old).withColumn("old", F.lit(True))), "digest")
    new_d, old_d = rows.where(~F.col("old")), rows.where(F.col("old"))
    buckets = max(1, -(-rows.count() // bucket_keys))
    filters = stored(snapshot_filters(old_d, buckets), "filter")  # immutable: a later batch reads it again
    positive = stored(screened(new_d, filters, buckets), "positive")
    settle(spark)
    # Digests that more than one row has: those of the batch that an exact bucket confirms, and repeated ones of either side.
    in_both = positive.join(old_d.select("sha").distinct(), "sha", "left_semi").withColumn("known", F.lit(True))
    repeated = rows.groupBy("old", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.lit(False).alias("known"))
    asked = in_both.unionByName(repeated).groupBy("sha").agg(F.max("known").alias("known"))
    asked = stored(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(asked, "sha"), "asked")
    # The byte check: only their texts move, grouped by digest and bytes. Copies in one task become one row before the shuffle.
    texts = asked_texts(new.unionByName(old).select("doc_id", text_of("text").alias("text")), asked)
    same = texts.groupBy("sha", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    same = stored(same.select("sha", "group_size", "keep_id").join(asked.select("sha", "known"), "sha"), "group")
    settle(spark)
    split = same.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if split:
        raise RuntimeError("two texts share a SHA-256 digest")
    out = rows.join(same, "sha", "left")
    return out.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"), F.coalesce("known", F.lit(False)).alias("known"),
    )


def halves(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """One table as a snapshot and the batch that came after it, by a hash of the id."""
    first = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0
    return docs.where(~first), docs.where(first)
