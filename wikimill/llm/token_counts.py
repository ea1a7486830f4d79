"""Token counts of whole texts without token ids.

A text falls into pre-tokens that no vocabulary piece spans: a run of spaces with the characters after it, and single line feeds
and tabs. So a text's tokens are the sum over its pre-tokens. Pre-tokens are counted over the corpus, each distinct one is
encoded once, and the numbers of pieces are joined to the pre-token frequencies of the documents:

- the most frequent pre-tokens, at most ``head`` of them, travel to the tasks as sorted hash arrays (a bound on what is
  broadcast, not on what is counted), so hot pre-tokens never meet in one task;
- all others are joined by a shuffle on the pre-token itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document, map_batches, settle, stored

SPACE = "▁"
#: A run of spaces with what follows up to the next space, line feed or tab; spaces alone; or one line feed or tab.
PRE_TOKEN = re.compile(r" *[^ \n\t]+| +|[\n\t]")
HEAD = 1_000_000  # pre-tokens in the broadcast arrays, 16 bytes each
FLUSH = 400_000  # distinct pre-tokens a task gathers before it hands them on


@dataclass(frozen=True)
class Pieces:
    """A SentencePiece BPE model file; ``path`` must be readable on every executor."""

    path: str

    @property
    def model(self):
        return _model(self.path)

    def check(self) -> None:
        """The cut into pre-tokens is exact if no piece joins two of them. Raises if the model has such a piece."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        norm = proto.normalizer_spec
        ok = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        spans = [p.piece for p in proto.pieces if p.type in (1, 4) and re.search(f"[^{SPACE}]{SPACE}|[\\n\\t]", p.piece)]
        if not ok or spans or any(p.type == 4 for p in proto.pieces):
            raise ValueError(f"pre-tokens of this model cannot be counted apart: {spans[:3]}")

    def ids(self, tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token. The model itself puts one space before a text, so a leading space is given up for it; one without
        a leading space is encoded behind a line feed (which never merges) and two pieces are taken off."""
        shaped = [t[1:] if t[0] == " " and len(t) > 1 else "\n" + t for t in tokens]
        found = self.model.encode(shaped, num_threads=1)
        return [x[:1] if t == " " else x if t[0] == " " else x[2:] for t, x in zip(tokens, found, strict=True)]

    def count(self, tokens: list[str]) -> list[int]:
        return [len(x) for x in self.ids(tokens)]


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens as the model sees them: with the space it puts before a text that is not empty."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``token, n``: distinct pre-tokens of the whole table; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(pre_tokens(text.as_py() or ""))
                if len(counts) >= FLUSH:
                    yield pa.RecordBatch.from_pydict({"token": list(counts), "n": pa.array(counts.values(), pa.int64())})
                    counts = Counter()
        if counts:
            yield pa.RecordBatch.from_pydict({"token": list(counts), "n": pa.array(counts.values(), pa.int64())})

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits: a 64-bit sort key and 32 more to compare."""
    whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in tokens), ">u8").reshape(-1, 2)
    return whole[:, 0].astype(np.int64), (whole[:, 1] & 0x7FFFFFFF).astype(np.int32)


def encoded(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds ``pieces``, as each distinct pre-token is encoded once, and the hashes ``key`` and ``check``."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        tokens = batch.column("token").to_pylist()
        key, check = hashes(tokens)
        yield {"token": batch.column("token"), "n": batch.column("n"), "pieces": pieces.count(tokens), "key": key, "check": check}

    return map_batches(counts, run, "token string, n long, pieces int, key long, check int")


@dataclass
class Head:
    """The frequent pre-tokens, sorted by key."""

    key: np.ndarray
    check: np.ndarray
    pieces: np.ndarray

    def find(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each token; 0 if it is not here."""
        if not len(self.key) or not tokens:
            return np.zeros(len(tokens), np.int64)
        key, check = hashes(tokens)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), self.pieces[at], 0).astype(np.int64)


def head_of(table: DataFrame, size: int) -> tuple[Head, int]:
    """The pre-tokens seen at least so often that they are not more than ``size``; and that number of times."""
    seen = F.least("n", F.lit(100_000))  # the histogram has as many rows at most
    hist = table.groupBy(seen.alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
    least, total = 100_001, 0
    for row in hist:
        total += row["k"]
        if total > size:
            break
        least = row["n"]
    rows = table.where(F.col("n") >= least).select("key", "check", "pieces").toArrow()  # numbers only, no texts
    key, check, pieces = (rows.column(i).to_numpy() for i in range(3))
    order = np.argsort(key)
    return Head(key[order], check[order], pieces[order]), least


def token_counts(docs: DataFrame, pieces: Pieces, limit: int = 4096, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per input row.

    Null texts count as empty: no bytes and no tokens. Texts are counted whole, without begin and end tokens; strings that
    look like special tokens are ordinary text. Null ids and repeated rows each give their row; an empty table gives none.
    """
    pieces.check()
    docs = document(docs, id_col, text_col)
    spark = docs.sparkSession
    table = stored(encoded(corpus_counts(docs), pieces), "pretoken")
    settle(spark)
    top, least = head_of(table, head)
    shared = spark.sparkContext.broadcast(top)
    memo: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column("text")
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo in range(0, len(texts), 256):
            part = [pre_tokens(t.as_py() or "") for t in texts[lo:lo + 256]]
            if len(memo) > FLUSH:
                memo.clear()
            new = list({t for tokens in part for t in tokens if t not in memo})
            memo.update(zip(new, shared.value.find(new).tolist(), strict=True))
            sums, rest = [], []
            for tokens in part:
                n = [memo[t] for t in tokens]
                sums.append(sum(n))
                rest.append(list(Counter(t for t, k in zip(tokens, n, strict=True) if not k).items()) if 0 in n else [])
            yield {"row": np.arange(lo, lo + len(part)), "n_bytes": n_bytes[lo:lo + len(part)], "doc_id": batch.column("doc_id").slice(lo, len(part)), "known": sums,
                   "rest": [[{"token": t, "f": f} for t, f in r] for r in rest]}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(docs, run, f"row long, doc_id {id_type}, n_bytes long, known long, rest array<struct<token:string,f:long>>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "document")  # stored: the row numbers hold from now on
    tail = table.where(F.col("n") < least).select("token", "pieces")
    open_ = rows.where(F.size("rest") > 0).select("row", F.explode_outer("rest").alias("r")).select("row", "r.token", "r.f")
    more = open_.join(tail, "token").groupBy("row").agg(F.sum(F.col("f") * F.col("pieces")).alias("more"))
    settle(spark)
    out = rows.drop("rest").join(more, "row", "left").withColumn("n_tokens", F.col("known") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
