"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, and plain versions on random tables."""

import collections
import glob
import hashlib
import random

import numpy as np
import pytest
from helpers import LOWER, ODD, prose, table, words
from pyspark.sql import functions as F
from wikimill.llm import decontaminate, exact_dedup, kneser_ney, license_scan, line_dedup, mixture, near_dedup, substring_dedup, token_counts, toxicity
from wikimill.llm.components import components


def ids(rows, name="doc_id"):
    return sorted(((r[name] is None, r[name] or 0) for r in rows))


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [(i, t, None if i == 906 else "s") for i, t in ODD]).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return token_counts.Pieces(str(public_tokenizers.path("piece_bpe_32k.model")))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_one_row_per_input_row(spark, odd, empty, pieces):
    labels = labels_of(spark, [(901, 1, 0, None), (906, 0, 1, ""), (None, 1, 1, ""), (905, None, 0, "")])
    model = toxicity.train(odd, labels)
    runs = {
        "license": license_scan.license_summary,
        "lines": line_dedup.dedup_lines,
        "mix": mixture.mix_counts,
        "near": near_dedup.near_duplicates,
        "tokens": lambda d: token_counts.token_counts(d, pieces),
        "exact": lambda d: exact_dedup.exact_duplicates(*exact_dedup.halves(d)[::-1]),
        "spans": substring_dedup.removed_words,
        "score": lambda d: kneser_ney.score(d, kneser_ney.train(d)),
        "toxic": lambda d: toxicity.classify(d, model),
    }
    for name, run in runs.items():
        assert ids(run(odd).collect()) == ids(odd.collect()), name
        assert run(empty).count() == 0, name
    assert not any(r["toxic"] for r in toxicity.classify(odd, None).collect())
    assert toxicity.train(empty, labels) is None


def test_license_places_and_labels(spark):
    rng = random.Random(1)
    filler = [prose(rng, n) for n in (0, 1, 31, 32, 33, 63, 64, 500)]
    rows = [(i, f"{t} MIT-License. {t} Licensed under the Apache License, Version 2.0. {t}\nGNU General\tPublic\nLICENSE") for i, t in enumerate(filler)]
    rows += [(50, "mit licenses"), (51, "license mit"), (52, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files"), (53, "MİT license MIT license mit license")]
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    got = {r.doc_id: r for r in license_scan.license_summary(table(spark, rows)).collect()}
    for i, t in rows:
        import re

        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        at = [(p, k) for k, v in phrases.items() for p in range(len(ws)) if ws[p:p + len(v)] == v]
        starts = [p for p, _ in at]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), min(starts, default=None), max(starts, default=None)), i
        assert r.base_labels == ",".join(sorted({k for _, k in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[52].labels == "mit" and got[52].n_base == 0 and 0.8 <= got[52].score < 1


def edit(rng, text, rate):
    out = []
    for w in text.split():
        if rng.random() < rate:
            out += [[], [f"n{rng.randrange(9999)}"], [w, f"n{rng.randrange(9999)}"]][rng.randrange(3)]
        else:
            out.append(w)
    return " ".join(out)


def test_decontamination_with_edits(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, n, 4000)) for i, n in enumerate([3, 8, 15, 20, 30, 45, 60, 100, 220] * 4)]
    items += [(90, None), (91, ""), (None, "a b c d")]
    rows, want = [], set()
    for k, (i, t) in enumerate(items):
        if not t or i is None:
            continue
        exact = k % 2 == 0 or len(t.split()) < 15
        inner = t.upper() if exact else edit(rng, t, 0.06)
        rows.append((k, f"{prose(rng, rng.randrange(40), 4000)}. {inner} {prose(rng, 20, 4000)}"))
        want.add((k, i))
    rows += [(500, prose(rng, 3000, 4000)), (501, None), (None, items[5][1]), (502, items[5][1]), (502, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(table(spark, rows), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found) == len(got) and (502, items[5][0]) in found
    assert len(want - found) <= 1 and not {d for d, _ in found} & {500, 501}
    assert decontaminate.contaminated(table(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.recall_of(decontaminate.Plan(), 30, 4) >= 0.98


@pytest.mark.parametrize("n", [5, 6, 14, 15, 16, 62, 63, 70, 80, 255])
def test_recall_at_the_greatest_number_of_edits(n):
    plan = decontaminate.Plan()
    assert decontaminate.recall_of(plan, n, n // 5, 100 if n < 100 else 30) >= 0.97


def test_fit_distance_is_the_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(150):
        a, b = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 14))

        def distance(x, y):
            row = list(range(len(y) + 1))
            for i, u in enumerate(x, 1):
                new = [i]
                for j, v in enumerate(y, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (u != v)))
                row = new
            return row[-1]

        best = min(distance(a, b[s:e]) for s in range(len(b) + 1) for e in range(s, len(b) + 1))
        d, s, e = decontaminate.fit_distance(a, b)
        assert d == best == distance(a, b[s:e])


def test_line_dedup_against_a_plain_version(spark):
    rng = random.Random(3)
    for _ in range(2):
        pool = [prose(rng, 2, 9) for _ in range(7)] + [""]
        rows = [(i // 2 if i % 9 else None, rng.choice([None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))])) for i in range(40)]
        df = table(spark, rows)
        keyed = [(r.doc_id, r.h, r.text) for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").distinct().collect()]
        spots = collections.defaultdict(list)
        for i, h, t in keyed:
            full = [(j, x) for j, x in enumerate((t or "").split("\n")) if x.strip(" ")]
            for a in range(len(full) - 2):
                spots[tuple(x for _, x in full[a:a + 3])].append(((i is not None, i or 0, h, a), [j for j, _ in full[a:a + 3]]))
        gone = collections.defaultdict(set)
        for places in spots.values():
            for key, lines in sorted(places)[1:]:
                gone[key[:3]].update(lines)
        want = collections.Counter()
        for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect():
            lost = gone[(r.doc_id is not None, r.doc_id or 0, r.h)]
            want[(r.doc_id, None if r.text is None else "\n".join(x for j, x in enumerate(r.text.split("\n")) if j not in lost), len(lost))] += 1
        out = line_dedup.dedup_lines(df)
        assert collections.Counter((r.doc_id, r.text, r.n_removed) for r in out.collect()) == want
        assert set(df.columns) < set(out.columns)


def test_mixture_parts():
    assert mixture.targets_of([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixture.targets_of([]) == [] and mixture.targets_of([0, 10]) == pytest.approx([0, 15])
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixture.permuted(np.arange(n), n, [1, 2, n]).tolist()) == list(range(n))
    quota = np.array([5, 0, 1000, 37])
    for shards in (1, 2, 7):
        parts = [mixture.shard_draw(quota, shards, k, mixture.Mix()) for k in range(shards)]
        assert (sum(c for c, _ in parts) == quota).all()
        assert all((b == sum((c for c, _ in parts[:k]), np.zeros(4, int))).all() for k, (_, b) in enumerate(parts))
    big = mixture.split_counts(np.array([4 * 10**9, 10**9, 0]), 10**9, np.random.default_rng(0))
    assert big.sum() == 10**9 and abs(big[0] - 8 * 10**8) < 10**5


def test_mix_texts_agree_with_counts(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 3, 70, 400])), rng.choice(["a", "b", None])) for i in range(60)] + [(7, "x y z", "a")] * 2 + [(8, None, "b"), (None, "p q r s", "a")]
    df = table(spark, rows)
    counts = collections.Counter()
    for r in mixture.mix_counts(df).collect():
        counts[r.doc_id] += r.taken
    pieces, texts = collections.Counter(), {r[0]: r[1] for r in rows}
    for r in mixture.mix_texts(df).collect():
        pieces[r.doc_id] += r.n_words
        assert len(words(r.text)) == r.n_words
        if r.doc_id not in (7, 8):
            assert words(texts[r.doc_id])[r.offset:r.offset + r.n_words] == words(r.text)
    assert +counts == +pieces


def plain_components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {n: root(n) for n in nodes}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for g in range(14):
        base = prose(rng, rng.choice([4, 6, 40, 150]), 60)
        rows.append((len(rows), base))
        for _ in range(rng.randrange(12)):
            rows.append((len(rows), edit(rng, rng.choice(rows[-5:])[1] if g % 2 else base, rng.choice([0, 0.003, 0.01, 0.02]))))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]

    def shingles(t):
        ws = words(t.translate(LOWER))
        return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()

    sets = [shingles(t) for _, t in rows]
    want = plain_components(range(len(rows)), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    assert len(set(want.values())) < len(rows)
    for trees in (near_dedup.Trees(), near_dedup.Trees(node_limit=4)):  # the second branches and cuts large nodes to blocks
        got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, rows), trees).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert near_dedup.recall_of(near_dedup.Trees(), 0.85) > 0.999
    kept = near_dedup.keep_one(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (5, 5)]
    real = {(a, b) for a, b in edges if a is not None and a != b}
    want = plain_components(sorted({n for e in real for n in e}), lambda a, b: (a, b) in real or (b, a) in real)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts_of_odd_texts(spark, pieces):
    rng = random.Random(7)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "\r", "▁", "the", "<s>", "</s>", "<unk>", "é", "漢", "😀", "\x00", ".", "0", "​", "\xa0"]
    texts = ["", " ", "\n", None, "<s> hi </s>", " a", "a ", "a\n\nb", "▁▁a", "\x00"] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(300)]
    want = [len(pieces.model.encode(t or "")) for t in texts]
    for head in (10, token_counts.HEAD):
        got = {r.doc_id: r for r in token_counts.token_counts(table(spark, list(enumerate(texts))), pieces, 10, head).collect()}
        assert [got[i].n_tokens for i in range(len(texts))] == want
        assert all(got[i].over_limit == (n > 10) and got[i].n_bytes == len((texts[i] or "").encode()) for i, n in enumerate(want))


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 100, 5000, 60000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        one = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse(keys).to_bytes())
        assert one.holds(keys).all()
        if n >= 60000:
            assert len(one.cells) < 1.3 * n and one.holds(rng.integers(2**63, 2**64 - 1, 50000, dtype=np.uint64)).mean() < 0.006


def test_asked_texts_alike_at_every_size(spark):
    """Broadcast, and beyond it hot digests apart from the others: the same texts, and only those asked for."""
    rows = [(i, "hot") for i in range(3000)] + [(3000 + i, f"pair {i // 2}") for i in range(1400)] + [(9000 + i, f"single {i}") for i in range(50)] + [(9999, None)]
    docs = table(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = [sorted(r.doc_id for r in exact_dedup.asked_texts(docs, asked, most).collect()) for most in (10**6, 0)]
    assert got[0] == got[1] == list(range(4400))


def test_exact_duplicates(spark):
    rng = random.Random(8)
    texts = [rng.choice([None, "", "a", "A", "a ", prose(rng, 3, 3)]) for _ in range(200)]
    rows = list(enumerate(texts))
    old, new = table(spark, rows[:120]), table(spark, rows[120:])
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(new, old).collect()}
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    for i, t in rows:
        group, r = by[t or ""], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(group), len(group), i == max(group), hashlib.sha256((t or "").encode()).hexdigest())
        assert r.known == (min(group) < 120 <= max(group))


def test_spans_against_a_plain_version(spark):
    rng = random.Random(9)
    spans = substring_dedup.Spans(window=10, block=5)
    for _ in range(2):
        pool = [prose(rng, n, 40) for n in (6, 12, 15, 25, 40)]
        rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.6 else prose(rng, 7, 30) for _ in range(rng.randrange(7)))) for i in range(50)]
        rows += [(50, rows[3][1] + "\n"), (51, None), (52, "a " * 200), (53, "a " * 50), (53, "a " * 50)]
        first = {}
        for i, t in sorted(rows, key=lambda r: r[0]):
            ws = words(t)
            for p in range(len(ws) - 9):
                first.setdefault(tuple(ws[p:p + 10]), i)
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.removed_words(table(spark, rows), spans).collect())
        want = collections.Counter()
        for i, t in rows:
            ws = words(t)
            gone = {p + j for p in range(len(ws) - 9) if first[tuple(ws[p:p + 10])] < i for j in range(10)}
            want[(i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone))] += 1
        assert got == want


def test_a_frequent_first_token_spans_several_shards(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(f"the w{rng.randrange(4000)}" for _ in range(100)) + f" {prose(rng, 30)}") for i in range(60)]
    df = table(spark, rows)
    want = {r.doc_id: r.score for r in kneser_ney.score(df, kneser_ney.train(df)).collect()}
    monkeypatch.setattr(kneser_ney, "SHARD_PAIRS", 300)
    model = kneser_ney.train(df)
    sizes = [len(np.load(p)) for p in glob.glob(f"{model.folder}/pairs/*.second.npy")]
    assert sum(sizes) == model.bigrams and max(sizes) <= 2 * 300
    got = {r.doc_id: r.score for r in kneser_ney.score(df, model).collect()}
    assert got == pytest.approx(want)
