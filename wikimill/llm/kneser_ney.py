"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read by the scoring tasks as memory-mapped arrays.

The model is a folder below the shared folder. All arrays are sorted and cut into shards, so no process ever holds a whole one:

- ``words``: 64-bit hashes of the training tokens; a token's number is its place. With counts, and with the number of distinct
  tokens before it.
- ``pairs``: the second tokens of all bigrams, sorted within each first token, with counts (one byte; larger ones in a list of
  their own). A shard holds a range of first tokens, where their seconds begin, and the totals and the numbers of bigrams seen
  once, twice and more often of these. The ranges follow the counts of the first tokens; a first token that alone is more than a
  shard is cut into ranges of second tokens, and its first shard has the totals of all of them.

Tasks write shards to a temporary name and rename them, so a repeated task leaves the same files. The folder must be mounted by
the executors (a ``file:`` path), as memory mapping needs it; anything else raises. Counts are summed inside tasks before the
shuffle, so a hot word is few rows.

Every text ends with one end token, and the first word follows an end token. With c(hw) the bigram counts and n1 … n4 the
numbers of bigrams seen so often, D(k) = k - (k + 1) * Y * n(k+1) / n(k) for k = 1, 2, 3 (3 and more) and Y = n1 / (n1 + 2 n2);
p(w | h) = (c(hw) - D(c(hw))) / c(h) + g(h) p(w), where g(h) is what the discounts have freed. p(w) is the same formula on the
numbers of distinct tokens before w, interpolated with the uniform 1 / (V + 1), which also is what an unknown token gets.
A discount that cannot be estimated (some n is 0) is 0.5 * k / (k + 1) instead.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from .common import document, map_batches, settle, stored, text_of
from .words import NON_SPACE, U64, Words, word_chunks

END = U64(0x1F83D9ABFB41BD6B)  # stands for the end token; word hashes are spread over all 64 bits
GATHER = 2_000_000  # tokens a task sums up before it hands counts on
ROWS = 100_000  # rows of an Arrow batch
MANY = 255  # counts from here on do not fit into a byte
SHARD_PAIRS = 2_000_000  # tokens, and so bigrams, of a shard, about; twice as many at most unless a first token is cut
SHARD_WORDS = 1_000_000


def mounted(path: str) -> str:
    """The local path of a mounted shared folder."""
    if "://" in path and not path.startswith("file://") or path.startswith(("hdfs:", "s3", "viewfs:")):
        raise RuntimeError(f"the model needs a shared folder that executors have mounted, not {path}")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays as ``<name>.<array>.npy``; the rename makes a repeated or concurrent task harmless."""
    os.makedirs(folder, exist_ok=True)
    for k, v in arrays.items():
        tmp = f"{folder}/.{name}.{k}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            np.save(f, v)
        os.replace(tmp, f"{folder}/{name}.{k}.npy")


@lru_cache(maxsize=4096)
def load(folder: str, name: str, array: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.{array}.npy", mmap_mode="r")


def tokens_of(chunk: Words) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each followed by the end token, and their offsets."""
    n = chunk.hi - chunk.lo
    offs = chunk.offsets + np.arange(n + 1)
    out = np.empty(offs[-1], U64)
    ends = offs[1:] - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = chunk.hashes(), END
    return out, offs


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for chunk in word_chunks(batch.column("text"), NON_SPACE, True):
            yield tokens_of(chunk)


def summed(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    key = np.concatenate(keys)
    keys.clear()
    key.sort()  # in place, as memory is what two tasks of an executor share
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(cut, append=len(key))
    key = key[cut]
    del cut
    for lo in range(0, len(key), ROWS):  # small batches, as both sides hold one in memory
        part = [pa.array(key[lo:lo + ROWS].view(np.int64)), pa.array(n[lo:lo + ROWS].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(part, ["key", "n"])


def gathered(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for keys in parts:
        held.append(keys)
        size += len(keys)
        if size >= GATHER:
            yield from summed(held)
            held, size = [], 0
    if held:
        yield from summed(held)


@dataclass
class Model:
    """What a task needs to find its way: shard borders and the few numbers of the model. Its size is the number of shards."""

    folder: str
    word_first: list[int] = field(default_factory=list)  # the first hash of each word shard
    word_base: list[int] = field(default_factory=list)  # the number of its first token
    pair_first: list[int] = field(default_factory=list)  # the least bigram of each pair shard, as first * 2**32 + second
    tokens: int = 0
    vocabulary: int = 0
    pair_discount: tuple[float, ...] = (0.0,) * 4
    word_discount: tuple[float, ...] = (0.0,) * 4
    kinds: tuple[int, ...] = (0, 0, 0)  # tokens with one, two, more distinct tokens before them
    bigrams: int = 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers of sorted distinct hashes; -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(hashes, np.array(self.word_first, U64))
        for i, base in enumerate(self.word_base):
            lo, hi = cuts[i], cuts[i + 1] if i + 1 < len(cuts) else len(hashes)
            if lo < hi:
                shard = load(f"{self.folder}/words", str(i), "hash")
                at = np.minimum(np.searchsorted(shard, hashes[lo:hi]), len(shard) - 1)
                out[lo:hi] = np.where(shard[at] == hashes[lo:hi], at + base, -1)
        return out

    def of_words(self, ids: np.ndarray) -> np.ndarray:
        """Counts of the tokens with sorted numbers."""
        out, cuts = np.zeros(len(ids), np.int64), [*np.searchsorted(ids, self.word_base).tolist(), len(ids)]
        for i, base in enumerate(self.word_base):
            if cuts[i] < cuts[i + 1]:
                out[cuts[i]:cuts[i + 1]] = load(f"{self.folder}/words", str(i), "n")[ids[cuts[i]:cuts[i + 1]] - base]
        return out

    def of_lower(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of distinct tokens before the tokens with sorted numbers."""
        out, shard = np.zeros(len(ids), np.int64), ids // SHARD_WORDS
        for i in np.unique(shard).tolist():
            lo, hi = np.searchsorted(shard, [i, i + 1])
            out[lo:hi] = load(f"{self.folder}/lower", str(i), "n")[ids[lo:hi] - i * SHARD_WORDS]
        return out

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.pair_first, np.int64), keys, "right") - 1

    def firsts_of(self, i: int) -> tuple[int, int, bool]:
        """Of a pair shard: its least first token, how many it holds, and whether another shard has the same one."""
        here, after = self.pair_first[i], self.pair_first[i + 1] if i + 1 < len(self.pair_first) else self.vocabulary << 32
        low = here >> 32
        return low, ((after - 1) >> 32) - low + 1, here & 0xFFFFFFFF > 0 or after >> 32 == low

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs of known tokens."""
        out = np.zeros(len(keys), np.int64)
        shard = self.pair_shard(keys)
        for i in np.unique(shard).tolist():
            lo, hi = np.searchsorted(shard, [i, i + 1])
            out[lo:hi] = self._counts(i, keys[lo:hi])
        return out

    def _counts(self, i: int, keys: np.ndarray) -> np.ndarray:
        begin, second, n, many = (load(f"{self.folder}/pairs", str(i), x) for x in ("begin", "second", "n", "many"))
        if not len(second):
            return np.zeros(len(keys), np.int64)
        first, want = (keys >> 32) - self.firsts_of(i)[0], keys & 0xFFFFFFFF
        lo, end = begin[first].astype(np.int64), begin[first + 1].astype(np.int64)
        hi = end.copy()
        while (open_ := lo < hi).any():  # binary search in all stretches at once
            mid = (lo + hi) >> 1
            less = open_ & (second[np.minimum(mid, len(second) - 1)] < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, len(second) - 1)
        out = np.where((lo < end) & (second[at] == want), n[at], 0).astype(np.int64)
        big = np.flatnonzero(out == MANY)
        out[big] = many[np.searchsorted(many[:, 0], at[big]), 1]
        return out

    def of_firsts(self, ids: np.ndarray) -> np.ndarray:
        """Rows (total, seen once, twice, more often) of the bigrams that begin with the sorted tokens."""
        out = np.zeros((len(ids), 4), np.int64)
        shard = self.pair_shard(ids << 32)
        for i in np.unique(shard).tolist():
            lo, hi = np.searchsorted(shard, [i, i + 1])
            out[lo:hi] = load(f"{self.folder}/pairs", str(i), "first")[ids[lo:hi] - self.firsts_of(i)[0]]
        return out


def discounts(n: list[int]) -> tuple[float, ...]:
    """D(0) … D(3) from n1 … n4."""
    out = [0.0]
    for k in (1, 2, 3):
        ok = n[0] + 2 * n[1] > 0 and n[k - 1] > 0 and n[k] > 0
        d = k - (k + 1) * (n[0] / (n[0] + 2 * n[1])) * n[k] / n[k - 1] if ok else 0.0
        out.append(d if 0 < d < k else 0.5 * k / (k + 1))
    return tuple(out)


def discounted(n: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return n - np.array(d)[np.minimum(n, 3)]


def borders(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens at which pair shards begin, from the counts of the tokens, and into how many shards each of them is cut."""
    hot = n > most
    part = np.cumsum(np.where(hot, 0, n)) // most
    begins = np.diff(part, prepend=-1) > 0
    begins |= hot
    begins[1:] |= hot[:-1]
    at = np.flatnonzero(begins)
    return at, np.where(hot[at], -(-n[at] // most), 1)


def write_words(counts: DataFrame, model: Model) -> None:
    """Word shards: hash ranges of equal width, as hashes are even."""
    total = counts.count()
    shards = max(1, -(-total // SHARD_WORDS))
    unsigned = F.col("key").bitwiseXOR(F.lit(-(2**63)))  # order as unsigned
    shard = F.floor((unsigned / F.lit(2.0**64) + F.lit(0.5)) * shards)
    shard = F.least(F.greatest(shard, F.lit(0)), F.lit(shards - 1)).cast("int")
    folder, most = f"{model.folder}/words", SHARD_PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, key, n in by_shard(batches):
            key = key.view(U64)
            save(folder, str(i), hash=key, n=n)
            at, parts = borders(n, most)
            yield pa.RecordBatch.from_pydict({"shard": [i], "first": [str(key[0])], "words": [len(key)], "tokens": [int(n.sum())], "at": [at.tolist()], "parts": [parts.tolist()]})

    rows = sorted_shards(counts.withColumn("shard", shard).withColumn("order", unsigned), shards).mapInArrow(run, "shard long, first string, words long, tokens long, at array<long>, parts array<long>").collect()
    rows, cuts = sorted(rows, key=lambda r: r["shard"]), []
    for i, r in enumerate(rows):  # shards may be empty only if there are few words
        if r["shard"] != i:
            for name in ("hash", "n"):
                os.replace(f"{folder}/{r['shard']}.{name}.npy", f"{folder}/{i}.{name}.npy")
        model.word_first.append(int(r["first"]))
        model.word_base.append(model.vocabulary)
        cuts += [(model.vocabulary + a, k) for a, k in zip(r["at"], r["parts"], strict=True)]
        model.vocabulary += r["words"]
        model.tokens += r["tokens"]
    # Numbers are in the order of hashes, so ranges of equal width hold like numbers of second tokens.
    for a, k in cuts:
        k = min(k, model.vocabulary)
        model.pair_first += [a << 32 | j * model.vocabulary // k for j in range(k)]


def sorted_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of a shard in one partition, in order. Four shards a partition even out what hashing the shard number leaves uneven."""
    spark = rows.sparkSession
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "order").select("shard", "key", "n")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) of sorted rows; one shard is held at a time."""
    now, keys, counts = None, [], []
    for batch in batches:
        shard, key, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if shard[lo] != now:
                if keys:
                    yield int(now), np.concatenate(keys), np.concatenate(counts)
                now, keys, counts = shard[lo], [], []
            keys.append(key[lo:hi].copy())
            counts.append(n[lo:hi].copy())
    if keys:
        yield int(now), np.concatenate(keys), np.concatenate(counts)


def word_numbers(hashes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, their numbers, and the place of each token among them."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    return distinct, model.numbers(distinct), inverse


def pair_keys(ids: np.ndarray, offs: np.ndarray, start: int) -> np.ndarray:
    """``first * 2**32 + second`` for each token after the one before it (``start`` at the beginning of a text)."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[offs[:-1]] = start
    return before << 32 | ids


def save_pairs(folder: str, i: int, low: int, key: np.ndarray, n: np.ndarray, first: np.ndarray) -> None:
    begin = np.searchsorted((key >> 32) - low, np.arange(len(first) + 1))
    big = np.flatnonzero(n >= MANY)
    save(folder, str(i), begin=begin.astype(np.uint32 if len(key) < 2**32 else np.int64), second=(key & 0xFFFFFFFF).astype(np.uint32),
         n=np.minimum(n, MANY).astype(np.uint8), many=np.stack([big, n[big]], 1), first=narrow(first))


def narrow(first: np.ndarray) -> np.ndarray:
    return first.astype(np.uint32 if first.max(initial=0) < 2**32 else np.int64)


def write_pairs(train: DataFrame, model: Model) -> None:
    spark, shared = train.sparkSession, train.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        end = int(m.numbers(np.array([END], U64))[0])

        def keys() -> Iterator[np.ndarray]:
            for tokens, offs in token_batches(batches):
                _, ids, inverse = word_numbers(tokens, m)
                yield pair_keys(ids[inverse], offs, end)

        for batch in gathered(keys()):
            shard = m.pair_shard(batch.column(0).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["key", "n", "shard"])

    shards, folder = len(model.pair_first), f"{model.folder}/pairs"
    raw = train.select("text").mapInArrow(count, "key long, n long, shard int")
    rows = sorted_shards(raw.withColumn("order", F.col("key")), shards)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, key, n in by_shard(batches):
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            key, n = key[cut], np.add.reduceat(n, cut)
            low, width, split = shared.value.firsts_of(i)
            first = np.zeros((width, 4), np.int64)
            at = (key >> 32) - low
            first[:, 0] = np.bincount(at, n, width)
            for k in (1, 2, 3):
                first[:, k] = np.bincount(at[n == k if k < 3 else n >= 3], minlength=width)
            save_pairs(folder, i, low, key, n, first)
            if split:
                yield pa.RecordBatch.from_pydict({"key": pa.array([-2 - low], pa.int64()), "n": pa.array([0], pa.int64()), "seen": pa.array([first[0].tolist()], pa.list_(pa.int64()))})
            second, before = np.unique(key & 0xFFFFFFFF, return_counts=True)
            seen = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            for lo in range(0, len(second), ROWS):
                part = [pa.array(second[lo:lo + ROWS]), pa.array(before[lo:lo + ROWS].astype(np.int64)), pa.nulls(len(second[lo:lo + ROWS]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(part, ["key", "n", "seen"])
            yield pa.RecordBatch.from_pydict({"key": pa.array([-1], pa.int64()), "n": pa.array([len(key)], pa.int64()), "seen": pa.array([seen.tolist()], pa.list_(pa.int64()))})

    # One pass writes the shards and hands on what the lower order needs; its rows are kept, so the pass runs once.
    out = stored(rows.mapInArrow(write, "key long, n long, seen array<long>"), "lower")
    sums = [F.sum(F.col("seen")[k]).alias(f"n{k}") for k in range(4)]
    total = out.where("key = -1").agg(*sums, F.sum("n").alias("n")).first()
    model.pair_discount = discounts([int(total[k] or 0) for k in range(4)])
    model.bigrams = int(total["n"])
    for i in range(shards):  # a range without any bigram
        if not os.path.exists(f"{folder}/{i}.first.npy"):
            low, width, _ = model.firsts_of(i)
            save_pairs(folder, i, low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((width, 4), np.int64))
    for r in out.where("key < -1").groupBy("key").agg(*sums).collect():  # first tokens of several shards: fewer than shards
        i = model.pair_first.index(-2 - r["key"] << 32)
        save(folder, str(i), first=narrow(np.array([[r[f"n{k}"] for k in range(4)]])))
    settle(spark)
    write_lower(out.where("key >= 0").groupBy("key").agg(F.sum("n").alias("n")), model)


def write_lower(before: DataFrame, model: Model) -> None:
    """The number of distinct tokens before each token, ``SHARD_WORDS`` token numbers a shard."""
    shards, folder, last = max(1, -(-model.vocabulary // SHARD_WORDS)), f"{model.folder}/lower", model.vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, key, n in by_shard(batches):
            full = np.zeros(min(SHARD_WORDS, last - i * SHARD_WORDS), np.uint32)
            full[key - i * SHARD_WORDS] = n
            save(folder, str(i), n=full)
            kinds = np.bincount(np.minimum(n, 5), minlength=6)[1:6]
            yield pa.RecordBatch.from_pydict({"kinds": pa.array([kinds.tolist()], pa.list_(pa.int64()))})

    shard = F.floor(F.col("key") / F.lit(SHARD_WORDS)).cast("int")
    rows = sorted_shards(before.withColumn("shard", shard).withColumn("order", F.col("key")), shards).mapInArrow(write, "kinds array<long>").collect()
    kinds = np.sum([r["kinds"] for r in rows], axis=0).tolist()  # every token has one before it, so no shard is empty
    model.word_discount = discounts(kinds[:4])
    model.kinds = (kinds[0], kinds[1], sum(kinds[2:]))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the training texts and writes the model; null texts count as empty, and each text has one end token."""
    spark = docs.sparkSession
    model = Model(mounted(work_path(spark, "model")))
    texts = docs.select(text_of(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(tokens for tokens, _ in token_batches(batches))

    words = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    words = stored(words, "unigram")
    settle(spark)
    write_words(words, model)
    if model.tokens:
        write_pairs(texts, model)
    settle(spark)
    return model


def score_chunk(chunk: Words, m: Model) -> dict[str, np.ndarray]:
    """``n_tokens, n_known, base_score, score`` of each text."""
    tokens, offs = tokens_of(chunk)
    distinct, ids, inverse = word_numbers(tokens, m)
    known = ids >= 0
    order = np.argsort(ids, kind="stable")
    some = order[np.searchsorted(ids[order], 0):]  # known tokens by number
    count, before = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    first = np.zeros((len(ids), 4), np.int64)
    if len(some):
        count[some] = m.of_words(ids[some])
        before[some] = m.of_lower(ids[some])
        first[some] = m.of_firsts(ids[some])
    n, v = m.tokens, m.vocabulary
    base = np.log10((count + 1) / (n + v + 1))

    uniform = 1 / (v + 1)
    if m.bigrams:
        freed = sum(d * k for d, k in zip(m.word_discount[1:], m.kinds, strict=True)) / m.bigrams
        lower = np.maximum(discounted(before, m.word_discount), 0) / m.bigrams + freed * uniform
    else:
        lower = np.full(len(ids), uniform)
    total = first[:, 0]
    left = np.where(total > 0, (first[:, 1:] @ np.array(m.pair_discount[1:])) / np.maximum(total, 1), 1.0)

    place = np.empty(len(tokens), np.int64)  # of the token before, among the distinct ones; -1: none
    place[1:] = inverse[:-1]
    end = int(np.searchsorted(distinct, END))
    place[offs[:-1]] = end
    both = known[place] & known[inverse]
    keys, at = np.unique(ids[place[both]] << 32 | ids[inverse[both]], return_inverse=True)
    pair = np.zeros(len(tokens), np.int64)
    if len(keys):
        pair[both] = m.of_pairs(keys)[at]
    high = np.maximum(discounted(pair, m.pair_discount), 0) / np.maximum(total[place], 1)
    logs = np.log10(high + left[place] * lower[inverse])

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, offs[:-1])

    return {"n_tokens": np.diff(offs), "n_known": per_text((count[inverse] > 0).astype(np.int64)), "base_score": per_text(base[inverse]), "score": per_text(logs)}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity``, one row per input row.

    Null texts count as empty and are one end token. Ids may be null or repeated. An empty table gives no rows. With a model of
    no texts every token is unknown.
    """
    spark: SparkSession = docs.sparkSession
    docs = document(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(model)  # shard borders and a few numbers

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk in word_chunks(batch.column("text"), NON_SPACE, True):
            out = score_chunk(chunk, shared.value)
            yield out | {"doc_id": batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo), "train_tokens": np.full(chunk.hi - chunk.lo, shared.value.tokens),
                         "perplexity": 10 ** (-out["score"] / out["n_tokens"])}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
