"""Groups of spelling variants: words that differ by one letter, found by a bit-sliced position index.

The vocabulary is counted in the tasks that read the texts. Then each pair of near words meets in exactly one block:

- Let L be the shorter length of a pair and p its common prefix. Either p >= L // 2, and the words share that prefix, or they
  share the last L - L // 2 letters. So a word has one key for each side and for L = its length and its length - 1.
- A key with more words than ``limit`` is cut again: its range of p is halved, and the word gets the keys of both halves (a longer
  prefix, or the same prefix with a longer suffix). At the end one letter is open, which bounds a block by the alphabet. So a
  prefix that a third of all words share costs a few more keys a word, and no group is compared all to all.

Inside a block the words are bits. For each (position, letter) a bitset says which words have that letter there; a query word
runs over its letters and carries three sets of words on: those without an error so far, those with one letter replaced, and
those with one letter more (read at shifted positions). 64 words are handled by one operation. Blocks give sums and a best near
word for each word; pairs are never rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document, map_groups, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
CAPITALS = {c: c + 32 for c in range(65, 91)}
SLICE = 1 << 20  # characters of a text worked on at once, cut between runs
FLUSH = 300_000  # distinct words a task gathers before it hands them on
DROPPED = 31  # one run in so many loses a letter
LIMIT = 2048  # words of a key in one block
BLOCK = 8192  # keys of words in one group of blocks, on average
QUERIES = 1024  # words of a block that run over its index at once
SALTS = 16


def slices(text: str) -> Iterator[str]:
    lo = 0
    while lo < len(text):
        cut = OTHER.search(text, lo + SLICE)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def thinned(doc_id: str, run: str, every: int = DROPPED) -> str:
    """The run in lower case (A-Z only); without one letter if ``every`` divides the CRC of id and run."""
    word = run.lower() if run.isascii() else run.translate(CAPITALS)
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame, shortest: int, at_least: int) -> DataFrame:
    """``word, n``: words of the table with their occurrences; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for part in slices(text.as_py() or ""):
                    for raw, n in Counter(RUN.findall(part)).items():
                        if len(raw) >= shortest and len(word := thinned(doc_id or "", raw)) >= shortest:
                            counts[word] += n
                    if len(counts) >= FLUSH:
                        yield out()
                        counts.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def keyed(size: Column, a: Column, b: Column) -> Column:
    """A key: pairs whose shorter word has ``size`` letters and whose common prefix is from ``a`` to below ``size - b`` letters
    (any from ``a`` on if b = 0). Such words share their first ``a`` and last ``b`` letters."""
    word = F.col("word")
    return F.struct(size.alias("size"), a.alias("a"), b.alias("b"), F.substring(word, F.lit(1), a).alias("head"), F.substring(word, F.length("word") - b + 1, b).alias("tail"))


KEY = ["size", "a", "b", "head", "tail"]


def first_keys(words: DataFrame, shortest: int) -> DataFrame:
    keys = []
    for size in (F.length("word"), F.length("word") - 1):
        half = (size / 2).cast("int")
        keys += [keyed(size, half, F.lit(0)), keyed(size, F.lit(0), size - half)]
    return words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*").where(F.col("size") >= shortest)


def halved(rows: DataFrame) -> DataFrame:
    """The keys of both halves of each key's range."""
    size, a, b = F.col("size"), F.col("a"), F.col("b")
    mid = a + ((size - a - b + 1) / 2).cast("int")
    upper = F.when((b == 0) | (mid < size - b), keyed(size, mid, b))
    return rows.select("word", "n", F.explode(F.array_compact(F.array(upper, keyed(size, a, size - mid)))).alias("k")).select("word", "n", "k.*")


def with_bounded_keys(rows: DataFrame, limit: int) -> DataFrame:
    """Every key has at most ``limit`` words, or one open letter. At most log2 of a word's length rounds."""
    done = []
    while True:
        rows = stored(rows, "spelling-keys")
        large = rows.where(F.col("size") - F.col("a") - F.col("b") > 1).groupBy(*KEY).count().where(F.col("count") > limit)
        large = stored(large.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("large")), "spelling-large")
        if large.isEmpty():
            out = rows
            for more in done:
                out = out.unionByName(more)
            return out
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(large, [*KEY, "salt"], "left").drop("salt")
        done.append(marked.where(F.col("large").isNull()).drop("large"))
        rows = halved(marked.where("large").drop("large"))


class Index:
    """Words of ``size`` and ``size + 1`` letters as bits, most frequent first."""

    def __init__(self, words: list[str], size: int) -> None:
        wide = -(-len(words) // 64) * 8
        self.size, self.bytes = size, wide
        self.letters = np.frombuffer(b"".join(w.encode("latin-1").ljust(size + 1, b"\0") for w in words), np.uint8).reshape(-1, size + 1)
        self.known, code = np.unique(self.letters, return_inverse=True)
        self.code = code.reshape(self.letters.shape)
        self.long = self.letters[:, size] != 0

    def packed(self, rows: np.ndarray) -> np.ndarray:
        bits = np.packbits(rows, axis=-1, bitorder="little")
        return np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, self.bytes - bits.shape[-1])]).view(np.uint64)

    def slice(self, position: int) -> np.ndarray:
        """One bitset for each letter: the words that have it at ``position``."""
        return self.packed(self.letters[:, position] == self.known[:, None])

    def links(self, queries: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitsets of each query (rows of words of ``size`` letters): words with one letter replaced, with one letter more."""
        shape = (len(queries), self.bytes // 8)
        none = np.broadcast_to(self.packed(np.ones(len(self.letters), bool)), shape).copy()
        replaced, longer = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        wanted, end = none.copy(), self.size - b if b else -1
        here = self.slice(0)
        for i in range(self.size):
            after = self.slice(i + 1)
            letter = self.code[queries, i]
            same = here[letter]
            longer |= none
            longer &= after[letter]
            replaced &= same
            replaced |= none & ~same
            none &= same
            if i + 1 == a:
                wanted &= none
            if i + 1 == end:
                wanted &= ~none
            here = after
        longer |= none
        return replaced & wanted & self.packed(~self.long), longer & wanted & self.packed(self.long)


def first_bit(rows: np.ndarray) -> np.ndarray:
    word = (rows != 0).argmax(1)
    v = rows[np.arange(len(rows)), word]
    return word * 64 + np.bitwise_count((v & (~v + np.uint64(1))) - np.uint64(1))


def block_links(words: list[str], n: list[int], size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the words, near words of each, and the place of the most frequent one (ties: least word)."""
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    index = Index([words[i] for i in order], size)
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    short = np.flatnonzero(~index.long)
    for lo in range(0, len(short), QUERIES):
        at = short[lo:lo + QUERIES]
        replaced, longer = index.links(at, a, b)
        either = replaced | longer
        rows = np.flatnonzero(either.any(1))
        if not len(rows):
            continue
        count[at[rows]] += np.bitwise_count(either[rows]).sum(1, dtype=np.int64)
        best[at[rows]] = np.minimum(best[at[rows]], first_bit(either[rows]))
        rows = np.flatnonzero(longer.any(1))
        back = np.unpackbits(longer[rows].view(np.uint8), axis=1, bitorder="little")[:, :len(words)]
        cols = np.flatnonzero(back.any(0))
        if len(cols):
            count[cols] += back[:, cols].sum(0, dtype=np.int64)
            best[cols] = np.minimum(best[cols], at[rows[back[:, cols].argmax(0)]])
    found = np.flatnonzero(count)
    return order, found, count[found], best[found]


def near_words(rows: DataFrame, buckets: int) -> DataFrame:
    """``word, n_near, form_n, form``: for each word with near words their number and the most frequent one."""

    def run(group: dict[str, list]) -> dict[str, list]:
        classes: dict[tuple, list[int]] = {}
        for i, at in enumerate(zip(group["size"], group["a"], group["b"], strict=True)):
            classes.setdefault(at, []).append(i)
        out: dict[str, list] = {"word": [], "n_near": [], "form_n": [], "form": []}
        for (size, a, b), at in classes.items():
            words, n = [group["word"][i] for i in at], [group["n"][i] for i in at]
            if len(words) < 2 or all(len(w) > size for w in words):
                continue
            order, found, count, best = block_links(words, n, size, a, b)
            out["word"] += [words[i] for i in order[found]]
            out["n_near"] += count.tolist()
            out["form_n"] += [n[i] for i in order[best]]
            out["form"] += [words[i] for i in order[best]]
        return out

    place = F.pmod(F.xxhash64(*KEY), F.lit(buckets))
    blocks = map_groups(rows.select("word", "n", "size", "a", "b", place.alias("bucket")), ["bucket"], run, "word string, n_near long, form_n long, form string")
    least = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return blocks.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("f")).select("word", "n_near", (-F.col("f.n")).alias("form_n"), "f.form")


def with_roots(words: DataFrame) -> DataFrame:
    """Adds ``root``: forms followed to the last. A form is at least ``ratio`` times as frequent, so chains are short and have an
    end; every step doubles the way a word has come."""
    linked = words.where("form IS NOT NULL")
    steps = stored(linked.select(F.col("word").alias("via"), F.col("form").alias("next")), "spelling-steps")
    roots = stored(linked.select("word", F.col("form").alias("root")), "spelling-roots")
    while not roots.join(steps, F.col("root") == F.col("via"), "left_semi").isEmpty():
        roots = stored(roots.join(steps, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        ahead = steps.select(F.col("via").alias("next"), F.col("next").alias("last"))
        steps = stored(steps.join(ahead, "next", "left").select("via", F.coalesce("last", "next").alias("next")), "spelling-steps")
    return words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, shortest: int = 7, at_least: int = 2, ratio: int = 10, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of the table.

    Null and empty texts have no words; a null id counts as empty text; each of several equal rows counts. Of near words with the
    same number the least in code-point order is the form. An empty table gives no rows. ``shortest`` must be 3 at least.
    """
    if shortest < 3:
        raise ValueError("words of one and two letters have no half to share")
    words = stored(vocabulary(document(docs, id_col, text_col), shortest, at_least), "vocabulary")
    rows = stored(with_bounded_keys(first_keys(words, shortest), limit), "spelling-blocks")
    near = near_words(rows, rows.count() // BLOCK + 1)
    is_form = F.col("near_n") >= ratio * F.col("n")
    out = words.join(near.withColumnsRenamed({"form": "near_word", "form_n": "near_n"}), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_word")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    return with_roots(stored(out, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")
