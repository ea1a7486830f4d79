"""Near-duplicate documents by a chosen-path set similarity join.

1. A document's set is its distinct word shingles. Documents with equal sets are one class; all later steps hold one row per
   class, so groups of copies, however large, cost nothing more.
2. Each class has ``coordinates`` MinHash values. A tree branches the classes by the value at one coordinate; a node that is
   still larger than ``node_limit`` branches again by each of ``branches`` further coordinates, up to ``depth`` times. Trees use
   different coordinates and are independent, which gives the recall (``recall_of``).
3. A small node is compared exhaustively on 8-bit sketches. A node that stays large is cut into blocks of half the limit and all
   pairs of blocks are compared, each in its own task: nothing is capped. What may be linked is kept as groups, not as pairs.
4. Equal groups of different trees are one. Their classes get the full sets, and links are confirmed exactly on them; what they
   connect inside a group is kept as stars, so a group yields fewer links than it has classes.
5. Connected components of the confirmed links give the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document, free_name, map_batches, map_groups, settle, stored, text_of
from .components import components
from .words import NON_SPACE, U64, Words, mix, window_hashes, window_starts, word_chunks


@dataclass(frozen=True)
class Trees:
    """Linked: ``100 * intersection >= percent * union`` of the sets of ``shingle`` words."""

    percent: int = 85
    shingle: int = 5
    coordinates: int = 64
    trees: int = 7
    depth: int = 2
    branches: int = 2
    node_limit: int = 512
    seed: int = 5

    @property
    def least_agreement(self) -> int:
        """Sketch values that two linked classes share at least: five standard deviations below the mean."""
        p = self.percent / 100
        return max(1, int(self.coordinates * p - 5 * (self.coordinates * p * (1 - p)) ** 0.5))


def recall_of(trees: Trees, similarity: float) -> float:
    """Probability that a pair of this similarity meets in a compared node, if all its nodes are large (the worst case)."""
    down = 1.0
    for _ in range(trees.depth):
        down = 1 - (1 - similarity * down) ** trees.branches
    return 1 - (1 - similarity * down) ** trees.trees


def shingle_sets(chunk: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and their offsets."""
    h = chunk.hashes()
    grams = window_hashes(h, k)
    counts, out = chunk.counts, []
    for i, n in enumerate(counts.tolist()):
        a = int(chunk.offsets[i])
        if n >= k:
            out.append(np.unique(grams[a:a + n - k + 1]))
        else:
            out.append(window_hashes(h[a:a + n], n) if n else np.zeros(0, U64))
    offs = np.concatenate(([0], np.cumsum([len(s) for s in out]))).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U64)), offs


def min_hashes(sets: np.ndarray, offs: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` MinHash values (uint32) of every set that is not empty, zeros for the others."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=U64)
    out = np.zeros((len(offs) - 1, n), np.uint32)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        base = mix(sets, 1)
        for c in range(n):
            out[some, c] = np.minimum.reduceat(((base * a[c] + b[c]) >> U64(32)).astype(np.uint32), offs[some])
    return out


def signatures(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, n_shingles, cls, signature, sketch`` per input row; ``cls`` (null for an empty set) tells equal sets, the sketch
    has one byte of each MinHash value."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk in word_chunks(batch.column("text"), NON_SPACE, True):
            sets, offs = shingle_sets(chunk, trees.shingle)
            sig = min_hashes(sets, offs, trees.coordinates, trees.seed)
            size = np.diff(offs)
            cls = [class_of(sets[offs[i]:offs[i + 1]]) for i in range(len(size))]
            yield {"doc_id": batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo), "n_shingles": size, "cls": cls, "signature": [s.tobytes() for s in sig], "sketch": [s.tobytes() for s in sig.astype(np.uint8)]}

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, cls string, signature binary, sketch binary")


def coordinate(column: str, i: int) -> Column:
    return F.substring(column, 4 * i + 1, 4)


def nodes(classes: DataFrame, trees: Trees) -> DataFrame:
    """``node, part, cls, n_shingles, sketch``: the nodes (or pairs of blocks of them) to be compared.

    A row carries, for its tree, the MinHash values of the branches further down: for each branch the value at its own
    coordinate and then the values of the branches below it.
    """
    coordinates = cycle(np.random.default_rng(trees.seed + 1).permutation(trees.coordinates).tolist())

    def width(depth: int) -> int:
        return 4 + trees.branches * width(depth - 1) if depth else 0

    def root(t: int) -> Column:
        below = [coordinate("signature", next(coordinates)) for _ in range(trees.branches * width(trees.depth) // 4)]
        return F.struct(F.xxhash64(F.lit(t), coordinate("signature", next(coordinates))).alias("node"), F.concat(*below, F.lit(b"")).alias("below"))

    carried = ["cls", "n_shingles", "sketch"]
    rows = classes.select(*carried, F.explode(F.array(*map(root, range(trees.trees)))).alias("r")).select(*carried, "r.node", "r.below")
    done = None
    for depth in range(trees.depth, -1, -1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        rows = rows.join(sizes, "node")
        small = rows.where(F.col("members") <= trees.node_limit).select(*carried, "node", F.lit("").alias("part"))
        done = small if done is None else done.unionByName(small)
        large = rows.where(F.col("members") > trees.node_limit)
        if depth:
            w = width(depth)

            def branch(b: int, w: int = w) -> Column:
                value, rest = F.substring("below", b * w + 1, 4), F.substring("below", b * w + 5, w - 4)
                return F.struct(F.xxhash64("node", F.lit(b), value).alias("node"), rest.alias("below"))

            child = F.explode(F.array(*map(branch, range(trees.branches)))).alias("r")
            rows = stored(large.select(*carried, child).select(*carried, "r.node", "r.below"), "node")
        else:
            # What stays large: blocks of half the limit, and every pair of blocks is a node of its own.
            half = max(1, trees.node_limit // 2)
            blocks = F.ceil(F.col("members") / half).cast("int")
            block = F.pmod(F.xxhash64("cls"), blocks).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.concat_ws("-", F.least(o, block), F.greatest(o, block)))
            done = done.unionByName(large.select(*carried, "node", F.explode(pairs).alias("part")))
    return done


class Groups:
    """Union-find over 0 … n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def groups(self) -> list[list[int]]:
        """Groups of two and more, each in order."""
        by: dict[int, list[int]] = {}
        for i in range(len(self.up)):
            by.setdefault(self.root(i), []).append(i)
        return [g for g in by.values() if len(g) > 1]


def loose_groups(members: DataFrame, trees: Trees) -> DataFrame:
    """``grp, cls``: classes of a node that the sketches connect. ``grp`` is a digest of the members."""
    least, percent = trees.least_agreement, trees.percent

    def run(rows: dict[str, list]) -> dict[str, list]:
        order = sorted(range(len(rows["cls"])), key=rows["cls"].__getitem__)
        cls = [rows["cls"][i] for i in order]
        sketch = np.frombuffer(b"".join(rows["sketch"][i] for i in order), np.uint8).reshape(len(cls), -1)
        size = np.array([rows["n_shingles"][i] for i in order])
        found = Groups(len(cls))
        for i in range(len(cls) - 1):
            near = (sketch[i + 1:] == sketch[i]).sum(1) >= least
            near &= 100 * np.minimum(size[i + 1:], size[i]) >= percent * np.maximum(size[i + 1:], size[i])
            for j in np.flatnonzero(near).tolist():
                found.join(i, i + 1 + j)
        groups = [[cls[i] for i in g] for g in found.groups()]
        names = [hashlib.blake2b("".join(g).encode(), digest_size=16).hexdigest() for g in groups]
        return {"grp": [n for n, g in zip(names, groups, strict=True) for _ in g], "cls": [c for g in groups for c in g]}

    return map_groups(members, ["node", "part"], run, "grp string, cls string").distinct()


def confirmed_links(groups: DataFrame, sets: DataFrame, trees: Trees) -> DataFrame:
    """``a, b``: links confirmed on the full sets; what they connect inside a group is given as stars."""

    percent = trees.percent

    def run(rows: dict[str, list]) -> dict[str, list]:
        order = sorted(range(len(rows["cls"])), key=rows["cls"].__getitem__)
        cls, all_sets = [rows["cls"][i] for i in order], [np.frombuffer(rows["shingles"][i], U64) for i in order]
        size = np.array([len(s) for s in all_sets])
        found = Groups(len(cls))
        if len(cls) == 2:
            common = len(np.intersect1d(*all_sets, assume_unique=True))
            if 100 * common >= percent * (size.sum() - common):
                found.join(0, 1)
        else:
            flat = np.concatenate(all_sets)
            by_value = np.argsort(flat, kind="stable")
            value, owner = flat[by_value], np.repeat(np.arange(len(size)), size)[by_value]
            for i in range(len(cls) - 1):
                lo, hi = np.searchsorted(value, all_sets[i], "left"), np.searchsorted(value, all_sets[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(size))
                for j in np.flatnonzero(100 * common >= percent * (size + size[i] - common)).tolist():
                    if j > i:
                        found.join(i, j)
        # every group of linked classes as a star around its least one
        groups = found.groups()
        return {"a": [cls[g[0]] for g in groups for _ in g[1:]], "b": [cls[i] for g in groups for i in g[1:]]}

    return map_groups(groups.join(sets, "cls").select("grp", "cls", "shingles"), ["grp"], run, "a string, b string")


def class_of(members: np.ndarray) -> str | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).hexdigest() if len(members) else None


def full_sets(docs: DataFrame, trees: Trees) -> DataFrame:
    """``cls, shingles`` of every text."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk in word_chunks(batch.column("text"), NON_SPACE, True):
            sets, offs = shingle_sets(chunk, trees.shingle)
            parts = [sets[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield {"cls": [class_of(s) for s in parts], "shingles": [s.tobytes() for s in parts]}

    return map_batches(docs.select("text"), run, "cls string, shingles binary")


def near_duplicates(docs: DataFrame, trees: Trees = Trees(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Words are cut at ASCII white space after lower-casing A-Z; a text with fewer words than a shingle has its whole word
    sequence as its only element. Null, empty and blank texts have no set, are linked with nothing and are kept.
    ``component_id`` is the least id that links reach. Rows with a null id take part; they get the least id of their
    component, or null, and are kept only if their component has no id at all. Repeated rows are copies of each other and are
    kept or dropped alike. An empty table gives no rows.
    """
    docs = document(docs, id_col, text_col)
    rows = stored(signatures(docs, trees), "signature")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    groups = stored(loose_groups(nodes(stored(classes, "class"), trees), trees), "group")
    settle(docs.sparkSession)
    # One text of every class that may have a link; only those are read as full sets. Other texts with the same id are sets
    # of other classes and find no group.
    asked = classes.join(groups.select("cls").distinct(), "cls").select(F.col("rep").alias("i_")).distinct()
    with_text = docs.join(asked, docs["doc_id"].eqNullSafe(asked["i_"]), "left_semi")
    sets = full_sets(with_text, trees).dropDuplicates(["cls"])
    links = stored(confirmed_links(groups, sets, trees), "link")
    settle(docs.sparkSession)
    parts = components(links)
    least = classes.select("cls", "rep").join(parts, F.col("cls") == F.col("node"), "left")
    least = least.select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    ids = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = least.join(ids, "component").select("cls", "component_id")
    out = rows.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, trees: Trees = Trees(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group; all columns stay. Rows without words have no group and stay.

    Rows are told apart by id and text, so another text with the id of a dropped row stays, and a null id counts as any other (as
    the least). Of rows with equal id and text one stays.
    """
    key, gone = free_name(docs, "row_"), free_name(docs, "gone_")
    rows = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("digest")))
    found = stored(near_duplicates(rows, trees, key, text_col), "near-rows")
    drop = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct(), "near-gone")
    again = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy(F.col("doc_id").alias(gone)).count().where("count > 1")
    again = stored(again.select(gone), "near-again")
    same = F.col(key) == F.col(gone)
    single = rows.join(drop.unionByName(again), same, "left_anti")
    if again.isEmpty():
        return single.drop(key)
    return single.unionByName(rows.join(again, same, "left_semi").dropDuplicates([key])).drop(key)
