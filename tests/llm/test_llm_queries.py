"""Queries against their SQL, and against plain Python where SQL cannot express them, on the smallest tables."""

import collections
import math
import re
import zlib

import duckdb
import pytest
from wikimill.llm.queries import ORACLES, QUERIES

from helpers import LOWER, words


def norm(v):
    return "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    con.execute(ORACLES[name])
    have = [d[0] for d in con.description]
    order = sorted(range(len(have)), key=have.__getitem__)
    assert [have[i] for i in order] == cols
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in con.fetchall())


def test_decontamination_finds_every_verbatim_passage(spark, sf_dir, docs):
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for i in items for d in docs if f" {plain(i.text)} " in f" {plain(d.text)} "}
    rows = QUERIES["op2_benchmark_decontamination"](spark, sf_dir).collect()
    assert want and want == {(r.doc_id, r.item_id) for r in rows if r.distance == 0}


def test_mixture_meets_its_targets(spark, sf_dir, docs):
    rows = QUERIES["op4_mixture"](spark, sf_dir).collect()
    again = QUERIES["op4_mixture"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    text, source = {d.doc_id: d.text for d in docs}, {d.doc_id: d.source for d in docs}
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r["size"] == len(words(text[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= max(64, 0.02 * t) for s, t in target.items())


def test_token_counts_equal_the_tokenizer(spark, sf_dir, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((d.doc_id, len((d.text or "").encode()), n := len(model.encode(d.text or "")), n > 4096) for d in docs)
    assert want == sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, sf_dir).collect())


def kneser_ney(train):
    """Plain bigram model: {(h, w): p} as a function, and the counts."""
    uni, bi = collections.Counter(), collections.Counter()
    for ws in train:
        ws = [None, *ws, None]
        uni.update(ws[1:])
        bi.update(zip(ws[:-1], ws[1:], strict=True))

    def cuts(counts):
        n = collections.Counter(counts)
        out = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[k] and n[k + 1] else 0
            out.append(d if 0 < d < k else 0.5 * k / (k + 1))
        return out

    before, around = collections.Counter(w for _, w in bi), collections.defaultdict(lambda: [0] * 4)
    high, low = cuts(bi.values()), cuts(before.values())
    for (h, _), n in bi.items():
        around[h][0] += n
        around[h][min(n, 3)] += 1
    freed = sum(low[min(n, 3)] for n in before.values()) / len(bi)

    def p(h, w):
        k = before[w]
        lower = max(k - low[min(k, 3)], 0) / len(bi) + freed / (len(uni) + 1)
        if h not in around:
            return lower
        total, *n = around[h]
        c = bi[h, w]
        return max(c - high[min(c, 3)], 0) / total + sum(d * x for d, x in zip(high[1:], n, strict=True)) / total * lower

    return p, uni


def test_lm_score_equals_the_plain_model(spark, sf_dir, docs):
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {d.doc_id: words((d.text or "").translate(LOWER)) for d in docs}
    p, uni = kneser_ney(ws for i, ws in tokens.items() if not out(i))
    total, kinds = sum(uni.values()), len(uni)
    rows = QUERIES["op9_lm_score"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = [None, *tokens[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out(r.doc_id), len(ws) - 1, total)
        assert r.n_known == sum(w in uni for w in ws[1:])
        assert math.isclose(r.base_score, sum(math.log10((uni[w] + 1) / (total + kinds + 1)) for w in ws[1:]), rel_tol=1e-6)
        assert math.isclose(r.score, sum(math.log10(p(h, w)) for h, w in zip(ws[:-1], ws[1:], strict=True)), rel_tol=1e-6)


def test_toxicity_on_labels_it_did_not_see(spark):
    """Held-out accuracy: labels of one fifth of the documents are kept from the fit."""
    from pyspark.sql import functions as F
    from wikimill.llm import toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    test = F.col("doc_id") % 5 == 0
    model = toxicity.train(docs.where(~test), labels)
    rows = toxicity.classify(docs.where(test), model).join(labels.select("doc_id"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    labelled = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    hit = sum(labelled[r.doc_id] == 1 for r in toxic)
    there = sum(labelled[r.doc_id] == 1 for r in rows)
    assert there > 50 and hit >= 0.9 * there and len(toxic) - hit <= 0.01 * len(rows)
