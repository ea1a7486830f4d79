"""Search over a gram index (T1, T2): postings choose the candidates, and texts are read for those only.

``build`` numbers the documents, stores them in that order and lists, for every run of ``size`` letters of a lower-cased field,
the rows that hold it. A query's rarest grams are intersected; what is left is judged and ranked by the plain search, so the
rows are those of ``search.search_top`` over all documents. Queries shorter than a gram scan the texts as before.

Grams are cut with numpy inside tasks, as one number each; a task hands on one list per gram and chunk of rows instead of a row
per gram and document. Postings lie in the order of (gram, chunk). A frequent gram therefore spans many files, and the statistics of the files lead a
query to its few row groups; the same holds for the documents, which lie in the order of their row numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, work_path
from . import search

# The fields that search looks into, in the order of their numbers.
FIELDS = ("translated_title", "source_title", "root_title", "source_wikitext")
ROW = "_row"
CHUNK = 1024  # row numbers of a posting list
LETTERS = 2_000_000  # cut at a time in a task; a longer text is cut alone
LISTS = 20_000  # handed on at a time
PUSHED = 10  # values of one IN that reach the file statistics each by itself; longer lists reach them as a range


def any_of(column: str, values: list) -> Column:
    """``column`` is one of ``values``, written so that each value can rule out row groups."""
    lists = [values[i:i + PUSHED] for i in range(0, len(values), PUSHED)]
    found = F.col(column).isin(lists[0])
    for one in lists[1:]:
        found |= F.col(column).isin(one)
    return found


def slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about ``LETTERS`` letters; a longer text is alone."""
    lo = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > LETTERS:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def posting_lists(texts: list[str], rows: np.ndarray, size: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in the order of their rows: grams and chunks of the lists, where the lists begin, and the places in the chunk."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = max(0, len(code) - size + 1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    key = np.zeros(n, np.int64)
    for k in range(size):
        key = key << 21 | code[k:k + n]
    inside = owner[:n] == owner[len(owner) - n:]
    key, row = key[inside], rows[owner[:n][inside]]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    new = (np.diff(key, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)
    key, row = key[new], row[new]
    chunk = row // CHUNK
    begin = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))
    letters = np.stack([key[begin] >> 21 * (size - 1 - k) & 0x1FFFFF for k in range(size)], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [letters[i:i + size] for i in range(0, len(letters), size)], chunk[begin], np.append(begin, len(key)), (row % CHUNK).astype(np.int16)


def postings(rows: DataFrame, size: int) -> DataFrame:
    """``gram, field, chunk, places`` of numbered documents: for ``CHUNK`` row numbers at a time, which of them hold the gram.
    A null field has no grams; a chunk may have several lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for field in range(len(FIELDS)):
                texts = batch.column(field + 1)
                for lo, hi in slices(pc.utf8_length(texts).to_numpy()):
                    gram, chunk, begin, place = posting_lists(texts.slice(lo, hi - lo).to_pylist(), number[lo:hi], size)
                    for i in range(0, len(gram), LISTS):
                        at = begin[i:i + LISTS + 1]
                        lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(place[at[0]:at[-1]]))
                        m = len(at) - 1
                        yield pa.RecordBatch.from_arrays([pa.array(gram[i:i + m]), pa.array(np.full(m, field, np.int8)), pa.array(chunk[i:i + m]), lists], ["gram", "field", "chunk", "places"])

    texts = rows.select(ROW, *[F.lower(F.coalesce(c, F.lit(""))).alias(f"f{i}") for i, c in enumerate(FIELDS)])
    return texts.mapInArrow(run, "gram string, field byte, chunk long, places array<short>")


@dataclass(frozen=True)
class SearchIndex:
    """An index below ``folder``; written once, read by any session."""

    spark: SparkSession
    folder: str
    size: int = 3

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def documents(self) -> DataFrame:
        return self.table("documents").drop(ROW)

    def candidates(self, text: str, most: int = 4, looked_up: int = 40) -> DataFrame | None:
        """``_row``: rows with a field that holds the query's ``most`` rarest grams; None if the query is shorter than a gram.

        Of a long query, ``looked_up`` grams at even distances are compared by their counts. Fewer grams only leave more
        candidates, never fewer.
        """
        q = text.strip(" ").lower()
        if len(q) < self.size:
            return None
        held = sorted({q[i:i + self.size] for i in range(len(q) - self.size + 1)})
        held = held[:: -(-len(held) // looked_up)]
        counts = {r["gram"]: r["rows"] for r in self.table("counts").where(any_of("gram", held)).collect()}
        rarest = sorted(held, key=lambda g: (counts.get(g, 0), g))[:most]
        bit = F.lit(0)
        for i, g in enumerate(rarest):
            bit = F.when(F.col("gram") == g, 1 << i).otherwise(bit)
        lists = self.table("postings").where(any_of("gram", rarest)).select("gram", "field", "chunk", F.explode_outer("places").alias("place"))
        rows = lists.groupBy((F.col("chunk") * CHUNK + F.col("place")).alias(ROW), "field").agg(F.bit_or(bit).alias("held"))
        return rows.where(F.col("held") == (1 << len(rarest)) - 1).select(ROW).distinct()

    def survivors(self, text: str, literal: int = 200) -> DataFrame:
        """The documents a query may match, with their texts. Up to ``literal`` of them are read by their row numbers, more by a join."""
        rows = self.candidates(text)
        if rows is None:
            return self.documents()
        rows = stored(rows, "candidates")
        first = [r[ROW] for r in rows.limit(literal + 1).collect()]
        docs = self.table("documents")
        if not first:
            return docs.where(F.lit(False)).drop(ROW)
        found = docs.where(any_of(ROW, sorted(first))) if len(first) <= literal else docs.join(rows, ROW, "left_semi")
        return found.drop(ROW)

    def search_top(self, text: str, source: str, limit: int = 80) -> DataFrame:
        """The rows of ``search.search_top`` over all documents of the index."""
        return search.search_top(self.survivors(text), text, source, limit)


def build(docs: DataFrame, folder: str | None = None, size: int = 3) -> SearchIndex:
    """Index ``docs``, which need the columns of the plain search; all columns are kept.

    Documents are numbered where they lie, without a shuffle; ids may be null or repeated. Postings are dealt by ranges of
    (gram, chunk), so that no task holds all rows of a frequent gram.
    """
    if size not in (1, 2, 3):  # the letters of a gram share one 64-bit number
        raise ValueError("a gram has one to three letters")
    spark = docs.sparkSession
    index = SearchIndex(spark, folder or work_path(spark, "search"), size)
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(f"{index.folder}/documents")
    held = stored(postings(index.table("documents"), size), "lists")  # ranges are found on a sample, so grams are not cut twice
    held.repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk").write.parquet(f"{index.folder}/postings")
    counts = index.table("postings").groupBy("gram").agg(F.sum(F.size("places")).alias("rows"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{index.folder}/counts")
    return index
