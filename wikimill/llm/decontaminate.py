"""Benchmark decontamination: find passages of benchmark items in documents, allowing for edits.

1. An item is looked for by windows of at most ``LARGEST`` words, beginning at every ``STRIDE``-th word of a document and at
   every word of the item. Edits make the walks of longer windows part for good, so long items have more windows, not longer
   ones. A passage that lost as many words as it may still holds a whole document window (see ``size_of``).
2. The CGK random walk reads a window word by word for ``3 * w`` steps; in each step a random function of the step and the
   word under the pointer says whether the pointer moves on. Few edits leave most of the two walks the same, so edit distance
   becomes Hamming distance.
3. Bit sampling: a repetition compares the walks at ``samples`` random steps by one hash. ``repetitions`` walks with own random
   functions give the recall (see ``recall_of``). Of windows that meet, half of the words must be the same.
4. Every candidate place is verified by the exact edit distance in words between the item and the best stretch of the document.

Documents are only read through; the items are the query set and travel to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document, map_batches
from .words import U64, WORD_LIKE, Words, mix, window_starts, word_chunks

STEPS = 1.5  # steps that are sampled, in windows: a walk of 3 windows has mostly run off its window after them
ITEM_BLOCK_WORDS = 200_000  # words of items that one pass over the documents takes along, about 250 bytes each in the index
LARGEST = 11  # words of a window; items of 14 words and more are one class
STRIDE = 2  # words between the beginnings of document windows


@dataclass(frozen=True)
class Plan:
    """``similarity``: greatest edit distance is ``(1 - similarity) * item words``; see the module for the rest."""

    similarity: float = 0.8
    repetitions: int = 10
    samples: int = 5
    seed: int = 7


@dataclass
class SizeClass:
    """The item windows of one size: sorted sample hashes of each repetition, with the item and the place they belong to."""

    w: int
    stride: int
    keys: list[np.ndarray] = field(default_factory=list)
    item: list[np.ndarray] = field(default_factory=list)
    at: list[np.ndarray] = field(default_factory=list)


def size_of(n: int, most: int) -> tuple[int, int]:
    """Window size and stride for an item of ``n`` words and at most ``most`` edits; ``w + stride - 1 <= n - most``."""
    if not most:  # only verbatim passages: longer windows are met by chance less often
        w = min(LARGEST, max(1, 3 * (n + 1) // 4))
        return w, max(1, min(STRIDE, n - w + 1))
    w = max(1, min(LARGEST, n - most - STRIDE + 1))
    return w, max(1, min(STRIDE, n - most - w + 1))


def edits_of(n: int, plan: Plan) -> int:
    return int((1 - plan.similarity) * n + 1e-9)


def sampled_steps(w: int, rep: int, plan: Plan) -> np.ndarray:
    rng = np.random.default_rng([plan.seed, w, rep])
    steps = max(1, int(STEPS * w))
    # a short window has few steps that edits leave alone, so fewer of them must agree
    return np.sort(rng.choice(steps, min(plan.samples, 3 + w // 6, steps), replace=False))


def walk_samples(h: np.ndarray, starts: np.ndarray, w: int, rep: int, plan: Plan) -> np.ndarray:
    """For the windows of ``w`` words at ``starts``: one hash of the words under the pointer at the sampled steps."""
    steps = sampled_steps(w, rep, plan)
    pos, end, key = starts.copy(), starts + w, np.zeros(len(starts), U64)
    h = np.append(h, U64(0))
    bits, had = None, -1
    for j in range(int(steps[-1]) + 1):
        if j // 64 != had:
            had = j // 64
            bits = mix(h, plan.seed + 1000 * rep + had + 1)
        if j in steps:
            key = mix((key * U64(31)) ^ np.where(pos < end, h[pos], U64(0)))
        pos += ((bits[pos] >> U64(j % 64)) & U64(1)).astype(np.int64)
        np.minimum(pos, end, out=pos)
    return key


def alike(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, w: int) -> np.ndarray:
    """Whether at least half of the words of the windows of ``b`` at ``bt`` are in those of ``a`` at ``at``."""
    out, span, step = np.zeros(len(at), bool), np.arange(w), max(1, 2_000_000 // (w * w))
    for lo in range(0, len(at), step):
        x, y = a[at[lo:lo + step, None] + span], b[bt[lo:lo + step, None] + span]
        out[lo:lo + step] = 2 * (x[:, None, :] == y[:, :, None]).any(2).sum(1) >= w
    return out


def fit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance in words between ``item`` and any stretch of ``text``, and that stretch (start, end)."""
    n = len(text)
    cols = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), cols.copy()
    for i, word in enumerate(item, 1):
        up, diag = cost + 1, np.empty(n + 1, np.int64)
        diag[0], diag[1:] = n + len(item) + 1, cost[:-1] + (text != word)
        best = np.minimum(up, diag)
        start = np.where(diag < up, np.concatenate(([0], origin[:-1])), origin)
        best[0], start[0] = i, 0
        # insertions: best[j] = min over k <= j of best[k] + (j - k)
        lead = best - cols
        low = np.minimum.accumulate(lead)
        src = np.maximum.accumulate(np.where(lead == low, cols, 0))
        cost, origin = low + cols, start[src]
    e = int(np.argmin(cost))
    return int(cost[e]), int(origin[e]), e


class ItemIndex:
    """All windows of a block of items."""

    def __init__(self, ids: list[int], words: list[np.ndarray], plan: Plan):
        self.ids, self.words, self.plan, self.classes = ids, words, plan, {}
        self.flat = np.concatenate(words) if words else np.zeros(0, U64)
        self.first = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1])).astype(np.int64)
        by_size: dict[tuple[int, int], list[int]] = {}
        for i, h in enumerate(words):
            if len(h):
                by_size.setdefault(size_of(len(h), edits_of(len(h), plan)), []).append(i)
        for (w, stride), members in by_size.items():
            cls = SizeClass(w, stride)
            flat = np.concatenate([words[i] for i in members])
            offs = np.concatenate(([0], np.cumsum([len(words[i]) for i in members])))
            starts, counts = window_starts(offs, w)
            owner = np.repeat(np.array(members), counts)
            at = starts - np.repeat(offs[:-1], counts)
            for rep in range(plan.repetitions):
                keys = walk_samples(flat, starts, w, rep, plan)
                order = np.argsort(keys, kind="stable")
                cls.keys.append(keys[order])
                cls.item.append(owner[order])
                cls.at.append(at[order])
            self.classes[(w, stride)] = cls

    def candidates(self, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, item, estimated start of the item in words of the text), distinct."""
        found = []
        for (w, stride), cls in self.classes.items():
            starts, counts = window_starts(offsets, w)
            text = np.repeat(np.arange(len(counts)), counts)
            starts, text = (x[(starts - offsets[text]) % stride == 0] for x in (starts, text))
            if not len(starts):
                continue
            for rep in range(self.plan.repetitions):
                keys = walk_samples(h, starts, w, rep, self.plan)
                lo = np.searchsorted(cls.keys[rep], keys, "left")
                hit = np.flatnonzero(cls.keys[rep][np.minimum(lo, len(cls.keys[rep]) - 1)] == keys)
                if not len(hit):
                    continue
                n = np.searchsorted(cls.keys[rep], keys[hit], "right") - lo[hit]
                row = np.repeat(hit, n)
                k = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                like = alike(h, starts[row], self.flat, self.first[cls.item[rep][k]] + cls.at[rep][k], w)
                row, k = row[like], k[like]
                found.append(np.stack([text[row], cls.item[rep][k], starts[row] - offsets[text[row]] - cls.at[rep][k]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def verified(self, chunk: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, start, words, distance) of the best place of each item in each text, if it is near enough."""
        h = chunk.hashes()
        rows = self.candidates(h, chunk.offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for text, item, at in rows.tolist():
            word = self.words[item]
            most = edits_of(len(word), self.plan)
            if done.get((text, item), at - 1) >= at:
                continue  # the stretch that was searched holds this place as well
            a, b = int(chunk.offsets[text]), int(chunk.offsets[text + 1])
            lo = max(a, a + at - most)
            hi = min(b, a + at + 2 * len(word) + 2 * most)
            done[text, item] = hi - a - len(word) - most
            part = h[lo:hi]
            if np.isin(word, part).sum() < len(word) - most:
                continue
            d, s, e = fit_distance(word, part)
            if d <= most and (d, lo - a + s) < best.get((text, item), (len(word) + 1, 0, 0))[:2]:
                best[text, item] = (d, lo - a + s, e - s)
        for (text, item), (d, s, n) in sorted(best.items()):
            yield text, self.ids[item], s, n, d


def recall_of(plan: Plan, n: int, edits: int, trials: int = 300, vocabulary: int = 5000) -> float:
    """Measured share of passages of ``n`` random words with ``edits`` random word edits that the candidates hold."""
    rng, hits = np.random.default_rng(3), 0
    for _ in range(trials):
        item = rng.integers(1, vocabulary, n)
        passage = list(item)
        for _ in range(edits):
            kind, p = rng.integers(3), int(rng.integers(len(passage)))
            if kind == 0:
                passage[p] = vocabulary + 1
            elif kind == 1:
                passage.insert(p, vocabulary + 2)
            else:
                del passage[p]
        text = np.concatenate([rng.integers(1, vocabulary, int(rng.integers(5, 60))), passage, rng.integers(1, vocabulary, 40)])
        index = ItemIndex([0], [mix(item.astype(U64))], plan)
        hits += len(index.candidates(mix(text.astype(U64)), np.array([0, len(text)]))) > 0
    return hits / trials


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items, streamed to the driver and cut into blocks of at most ``ITEM_BLOCK_WORDS`` words (or one longer item)."""
    ids, words, size = [], [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null and i is not null")
    for row in rows.orderBy("i", "t").toLocalIterator():
        chunk = next(word_chunks(pa.array([row["t"]]), WORD_LIKE, True))
        h = chunk.hashes()
        if not len(h):
            continue
        if ids and size + len(h) > ITEM_BLOCK_WORDS:
            yield ids, words
            ids, words, size = [], [], 0
        ids.append(row["i"])
        words.append(h)
        size += len(h)
    if ids:
        yield ids, words


def contaminated(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, n_words, distance``: each document and item of which it holds a passage, at its best place.

    Words are lower-cased runs of letters and digits; start and n_words give the passage in them. Documents or items that are
    null, empty or without words match nothing, and neither do rows without an id. Of equally near places the first is given;
    repeated rows give one row each document id and item (the nearest place). Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = document(docs, id_col, text_col).where("text is not null and doc_id is not null")
    types = [d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, item_id_col))]
    schema = f"doc_id {types[0]}, item_id {types[1]}, start long, n_words long, distance long"
    parts = []
    for ids, words in item_blocks(benchmark, item_id_col, item_text_col):
        index = spark.sparkContext.broadcast(ItemIndex(ids, words, plan))

        def search(batch: pa.RecordBatch, index=index) -> Iterator[dict]:
            doc_id = batch.column("doc_id")
            for chunk in word_chunks(batch.column("text"), WORD_LIKE, True):
                rows = list(index.value.verified(chunk))
                if rows:
                    text, item, start, n, distance = map(list, zip(*rows, strict=True))
                    yield {"doc_id": doc_id.take(pa.array([chunk.lo + t for t in text])), "item_id": item, "start": start, "n_words": n, "distance": distance}

        parts.append(map_batches(docs, search, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    place = F.min(F.struct("distance", "start", "n_words")).alias("p")
    return out.groupBy("doc_id", "item_id").agg(place).select("doc_id", "item_id", "p.start", "p.n_words", "p.distance")
