"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each is a logistic regression on hashed word and word-beginning features and on
the probabilities of the categories before it; in training these probabilities come from models that did not see the row
(out-of-fold), so a later model learns how far an earlier one can be trusted. The last category's threshold is the one that is best
on its out-of-fold probabilities. The chain is fitted in one task on a bounded sample
of labelled rows (``Chain.sample`` per value of the last category); the model is a bounded table of weights. All documents are
then read once, whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document, map_batches
from .words import NON_SPACE, U64, Words, mix, word_chunks


@dataclass(frozen=True)
class Chain:
    """``categories``: name and SQL condition on a row of labels, in the order of the chain; the last one decides."""

    categories: tuple[tuple[str, str], ...] = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
    sample: int = 1500  # labelled rows of each value of the last category that are used at most
    bits: int = 20
    beginnings: tuple[int, ...] = (3, 4, 5)  # bytes
    folds: int = 3
    steps: int = 120
    ridge: float = 1e-4
    floor: float = 2.0  # log-likelihood roots below this tell nothing
    seed: int = 13


@dataclass
class Model:
    """Weights of a category: sparse over the features, then one for each category before it, then the constant."""

    columns: np.ndarray
    weights: np.ndarray  # categories x columns
    chain: np.ndarray  # categories x categories
    constant: np.ndarray
    threshold: float = 0.5

    def tables(self, bits: int) -> np.ndarray:
        out = np.zeros((len(self.weights), 1 << bits), np.float32)
        out[:, self.columns] = self.weights
        return out


def features(chunk: Words, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (text, feature) pairs and their values: 1 + log of the count, with length 1 for each text."""
    n = chunk.hi - chunk.lo
    text = np.repeat(np.arange(n), chunk.counts)
    size = chunk.ends - chunk.starts
    low = U64((1 << chain.bits) - 1)
    keys = [text.astype(U64) << U64(32) | chunk.hashes() & low]
    for k in chain.beginnings:
        long = size > k
        h = mix(chunk.hashes(chunk.starts[long], chunk.starts[long] + k), k) & low
        keys.append(text[long].astype(U64) << U64(32) | h)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, col = (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, n))
    return row, col, (value / norm[row]).astype(np.float32)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def salience(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, floor: float) -> np.ndarray:
    """How surely a feature tells the classes apart: the root of its log-likelihood ratio over documents, less ``floor``."""
    n, positive = len(y), y.sum()
    total = np.bincount(col, minlength=width)
    inside = np.bincount(col, y[row], width)
    out = np.zeros(width)
    for seen, share in ((inside, positive / n), (total - inside, 1 - positive / n)):
        out += seen * np.log(np.maximum(seen, 1e-9) / np.maximum(total * share, 1e-9))
        rest = n * share - seen
        out += rest * np.log(np.maximum(rest, 1e-9) / np.maximum((n - total) * share, 1e-9))
    return np.maximum(np.sqrt(np.maximum(2 * out, 0)) - floor, 0)


def fit_one(row: np.ndarray, col: np.ndarray, val: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, chain: Chain) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with both classes weighing the same, by gradient steps scaled per weight (Adagrad)."""
    n, positive = len(y), int(y.sum())
    if positive in (0, n):
        share = (positive + 0.5) / (n + 1)
        return np.zeros(width), np.zeros(dense.shape[1]), float(np.log(share / (1 - share)))
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (n - positive))
    scale = salience(row, col, y, width, chain.floor)
    some = scale[col] > 0
    row, col = row[some], col[some]
    val = val[some] * scale[col]
    w, d, c = np.zeros(width), np.zeros(dense.shape[1]), 0.0
    sw, sd, sc = np.full(width, 1e-12), np.full(dense.shape[1], 1e-12), 1e-12
    for _ in range(chain.steps):
        z = np.bincount(row, val * w[col], n) + dense @ d + c
        g = (logistic(z) - y) * weight
        gw = np.bincount(col, val * g[row], width) + chain.ridge * w
        gd, gc = dense.T @ g + chain.ridge * d, float(g.sum())
        sw += gw * gw
        sd += gd * gd
        sc += gc * gc
        w -= 0.5 * gw / np.sqrt(sw)
        d -= 0.5 * gd / np.sqrt(sd)
        c -= 0.5 * gc / sc**0.5
    return w * scale, d, c


def fit_chain(texts: pa.Array, labels: np.ndarray, chain: Chain) -> Model:
    """``labels``: rows x categories, 0 or 1."""
    rows, cols, vals = [], [], []
    for chunk in word_chunks(texts, NON_SPACE, True):
        r, c, v = features(chunk, chain)
        rows.append(r + chunk.lo)
        cols.append(c)
        vals.append(v)
    row, col, val = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, vals))
    columns, col, seen = np.unique(col, return_inverse=True, return_counts=True)
    often = seen >= 2
    keep = often[col]
    columns, new = columns[often], np.cumsum(often) - 1
    row, col, val = row[keep], new[col[keep]], val[keep]
    n, k, width = len(labels), labels.shape[1], len(columns)
    fold = np.random.default_rng(chain.seed).permutation(n) % chain.folds
    before = np.zeros((n, 0))
    out = Model(columns, np.zeros((k, width), np.float32), np.zeros((k, k)), np.zeros(k))
    for i in range(k):
        y = labels[:, i].astype(float)
        w, d, c = fit_one(row, col, val, before, y, width, chain)
        out.weights[i], out.chain[i, :i], out.constant[i] = w, d, c
        held = np.zeros(n)
        for f in range(chain.folds):
            inside = fold != f
            number = np.cumsum(inside) - 1
            part = inside[row]
            w, d, c = fit_one(number[row[part]], col[part], val[part], before[inside], y[inside], width, chain)
            z = np.bincount(row, val * w[col], n) + before @ d + c
            held[~inside] = logistic(z)[~inside]
        before = np.column_stack([before, held])
    out.threshold = best_threshold(before[:, -1], labels[:, -1]) if n else 0.5
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the probabilities between which the F1 score of out-of-fold predictions is best."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # no cut between equal values
    at = int(np.argmax(f1))
    after = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[order][at] + after) / 2, 0.2, 0.8))


def train(docs: DataFrame, labels: DataFrame, chain: Chain = Chain(), id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The chain fitted on the bounded sample; None if no document has a label. Labels with a null in a category are left out; of
    several labels of one document the greatest value of each category counts."""
    names = [n for n, _ in chain.categories]
    rows = labels.select(F.col("doc_id").alias("label_id"), *(F.expr(c).cast("int").alias(n) for n, c in chain.categories)).dropna()
    rows = rows.groupBy("label_id").agg(*(F.max(n).alias(n) for n in names))
    order = F.xxhash64("label_id", F.lit(chain.seed))
    have = document(docs, id_col, text_col).where("doc_id is not null")
    # Only labels of documents that are there count; the sample is drawn on ids alone, then its texts are fetched.
    rows = rows.join(have.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi")
    drawn = rows.where(F.col(names[-1]) == 1).orderBy(order, "label_id").limit(chain.sample).unionByName(
        rows.where(F.col(names[-1]) == 0).orderBy(order, "label_id").limit(chain.sample))
    texts = have.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))  # at most 2 * sample rows of labels

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label_id", "text"], na_position="first").drop_duplicates("label_id")
        m = fit_chain(pa.array(frame["text"], pa.string(), from_pandas=True), frame[names].to_numpy(), chain)
        some = np.abs(m.weights).max(0) > 1e-3
        return pd.DataFrame({"columns": [m.columns[some].astype(np.int32).tobytes()], "weights": [m.weights[:, some].astype(np.float32).tobytes()], "chain": [m.chain.tobytes()], "constant": [m.constant.tobytes()], "threshold": [m.threshold]})

    found = texts.select("label_id", "text", *names).groupBy(F.lit("chain")).applyInPandas(fit, "columns binary, weights binary, chain binary, constant binary, threshold double").collect()
    if not found:
        return None
    r, k = found[0], len(names)
    columns = np.frombuffer(r["columns"], np.int32)
    return Model(columns, np.frombuffer(r["weights"], np.float32).reshape(k, len(columns)), np.frombuffer(r["chain"]).reshape(k, k), np.frombuffer(r["constant"]), r["threshold"])


def classify(docs: DataFrame, model: Model | None, chain: Chain = Chain(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` for each category, and ``toxic``: the last one is above the model's threshold.

    One row per input row, whole texts. Null, empty and blank texts have no words and are never rejected: their probabilities
    are 0. Without a model (no labels) all probabilities are 0. Ids may be null or repeated. An empty table gives no rows.
    """
    docs = document(docs, id_col, text_col)
    names = [n for n, _ in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words and by 2 ** bits
    made: dict[str, np.ndarray] = {}

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        m = shared.value
        if m is not None and "tables" not in made:
            made["tables"] = m.tables(chain.bits)
        for chunk in word_chunks(batch.column("text"), NON_SPACE, True):
            n = chunk.hi - chunk.lo
            p = np.zeros((n, len(names)))
            some = chunk.counts > 0
            if m is not None:
                row, col, val = features(chunk, chain)
                for i in range(len(names)):
                    z = np.bincount(row, val * made["tables"][i][col], n) + p[:, :i] @ m.chain[i, :i] + m.constant[i]
                    p[:, i] = np.where(some, logistic(z), 0.0)
            yield {"doc_id": batch.column("doc_id").slice(chunk.lo, n), "toxic": pa.array(p[:, -1] > (m.threshold if m is not None else 1.0))} | {f"p_{x}": p[:, i] for i, x in enumerate(names)}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {id_type}, " + ", ".join(f"p_{x} double" for x in names) + ", toxic boolean")
