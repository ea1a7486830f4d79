"""Odd rows in every stage of the pipeline, exact draws, ties, edited passages against all pairs, and growth of line dedup."""

import collections
import os
import random
import subprocess
import sys
import time

import corpus_pipeline
import numpy as np
import pytest
from helpers import LOWER, prose, table, words
from pyspark.sql import functions as F
from wikimill.llm import decontaminate, line_dedup, mixture, near_dedup, toxicity
from wikimill.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Gone_ string, row_key string"


def odd_docs(spark):
    rng = random.Random(8)
    clean, other = prose(rng, 60), prose(rng, 80)
    item = "which of these rivers runs through seven old towns before it meets the cold northern sea"
    lines = "first shared line\nsecond shared line\nthird shared line"
    rows = [
        (1, clean), (1, other), (1, clean), (None, clean + " more"), (None, f"{other} {item} {other}"), (2, None), (2, ""), (3, " \n\t "), (4, f"x {item} y"), (4, "harmless words with the same id"),
        (5, lines + "\nown five"), (6, lines + "\nown six"), (None, lines + "\nown null"), (7, "word " * 20000), (8, "x" * 100000), (9, None), (9, None),
    ]
    return spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 2 else "s", len(t or ""), "x", "x") for n, (i, t) in enumerate(rows)], DOCS).repartition(3), item


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with the benchmark and labels the stages read."""
    d = tmp_path_factory.mktemp("sf")
    _, item = odd_docs(spark)
    spark.createDataFrame([(1, item), (2, None), (None, item), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def listed(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, sf, name):
    docs, item = odd_docs(spark)
    docs = stored(docs, "odd")
    stage = dict(corpus_pipeline.STAGES)[name]
    before, out = listed(docs), stage(spark, docs, sf)
    assert stage(spark, docs.where("false"), sf).count() == 0
    if name == "mixing":
        assert {r.source for r in out.select("source").distinct().collect()} == {None, "s"}
        return
    assert out.dtypes == docs.dtypes
    after = listed(out)
    if name == "toxicity":
        assert after == before  # one class of labels only: nothing is known to be toxic
    elif name == "line dedup":
        assert sum(after.values()) == sum(before.values())
        assert {r.text for r in out.where(F.col("text").rlike(r"(^|\n)own ")).collect()} == {"first shared line\nsecond shared line\nthird shared line\nown null", "own five", "own six"}
    elif name == "near dedup":
        clean = next(r.text for r in docs.where("doc_id is null and text like '% more'").collect())
        assert sum(n for (_, t), n in after.items() if t in (clean, clean.removesuffix(" more"))) == 1  # of (1, 1, null) one row stays
        assert after[None, clean] == 1 and sum(n for (i, _), n in after.items() if i == 1) == 1  # the other text of id 1 stays
        assert after[9, None] == 2 and after[2, ""] == after[2, None] == 1
    else:
        gone = before - after
        assert all(f" {item} " in t for _, t in gone) and sum(gone.values()) == 2 and not after - before
        assert after[4, "harmless words with the same id"] == 1


def test_toxic_row_goes_and_its_namesake_stays(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 30)} {'vile hateful filth' if i % 2 else 'pleasant garden'}") for i in range(120)] + [(200, "a pleasant garden of its own"), (200, "such vile hateful filth too"), (None, "so vile hateful filth again"), (None, "a pleasant garden")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", "x") for i, t in rows], DOCS)
    spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, stored(docs, "toxic"), str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if "vile" not in r[1]], key=str)


def test_conflicting_labels_have_one_meaning(spark):
    docs = spark.createDataFrame([(i, f"{'bad words' if i % 2 else 'fine words'} {i}") for i in range(60)], "doc_id long, text string")
    one = [(i, 1, i % 2) for i in range(60)]
    twice = one + [(i, 1, 0) for i in range(60)]
    models = [toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int").repartition(n)) for rows, n in ((one, 1), (twice, 3), (twice[::-1], 2))]
    assert all((m.weights == models[0].weights).all() and m.threshold == models[0].threshold for m in models)


def test_draws_are_hypergeometric_at_every_size():
    rng, size = np.random.default_rng(1), 4000
    for marked, other, take in ((5, 7, 4), (30, 10, 25), (400, 600, 500), (1, 999, 10)):
        got = np.bincount([mixture.drawn(marked, other, take, rng) for _ in range(size)], minlength=take + 1)
        want = np.bincount(rng.hypergeometric(marked, other, take, size), minlength=take + 1)
        some = got + want >= 20
        assert ((got - want)[some] ** 2 / (got + want)[some]).sum() < 2 * some.sum() + 20
    assert mixture.drawn(5, 0, 3, rng) == 3 and mixture.drawn(0, 5, 3, rng) == 0 and mixture.drawn(4, 4, 8, rng) == 4
    # far beyond 10**9: mean and spread of the law
    marked, other, take = 3 * 10**12, 10**12, 10**12
    draws = np.array([mixture.drawn(marked, other, take, rng) for _ in range(400)]) - 75 * 10**10
    sd = (take * 0.75 * 0.25 * 3 / 4) ** 0.5
    assert abs(draws.mean()) < 4 * sd / 20 and 0.85 < draws.std() / sd < 1.15


def test_counts_follow_from_the_drawn_blocks(spark):
    """Every drawn block laid over the documents word by word."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([0, 1, 70, 300])), rng.choice(["a", "b", None])) for i in range(50)] + [(None, "p q", "a"), (7, None, "a")]
    df, mix = table(spark, rows), mixture.Mix(block_words=16, shard_blocks=8)
    place = mixture.positions(mixture.sized(df, "doc_id", "text", "source")).collect()
    plan = mixture.source_plan(mixture.sized(df, "doc_id", "text", "source"), mix)
    number = {p.source: i for i, p in enumerate(plan)}
    times = collections.Counter((r.s, r.block) for r in mixture.slots(spark, plan, mix).collect())
    covered = collections.Counter((r.source, w) for r in place for w in range(r["first"], r["first"] + r["size"]))
    assert set(covered.values()) == {1} and all(sum(s == p.source for s, _ in covered) == p.size for p in plan)
    want = sorted((str(r.doc_id), r["size"], sum(times[number[r.source], w // 16] for w in range(r["first"], r["first"] + r["size"]))) for r in place)
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in mixture.mix_counts(df, mix).collect()) == want


def edit_distance_inside(item, text):
    """Least number of word edits that turn ``item`` into some stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edited_passages_against_all_pairs(spark):
    """Short and long items, passages with up to the allowed edits and beyond, string ids: all pairs by plain edit distance."""
    rng = random.Random(9)
    items = [(f"i{k}", prose(rng, n, 2000)) for k, n in enumerate([5, 6, 8, 10, 14, 20, 30, 45, 63, 80])]
    rows = []
    for k in range(80):
        ws = items[k % 10][1].split()
        for _ in range(rng.randrange(0, len(ws) // 4 + 2)):
            at = rng.randrange(len(ws))
            kind = rng.randrange(3)
            ws[at:at + (kind != 1)] = ["edited"] if kind < 2 else []
        rows.append((f"d{k}", f"{prose(rng, rng.randrange(30), 2000)} {' '.join(ws)} {prose(rng, 20, 2000)}"))
    rows += [(f"e{k}", prose(rng, 100, 2000)) for k in range(10)] + [("n", None), (None, items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([*items, ("none", None)], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench).collect()}
    plain = lambda t: words(t.translate(LOWER))
    want = {}
    for d, text in rows:
        for i, item in items if d and text else ():
            near = edit_distance_inside(plain(item), plain(text))
            if near <= decontaminate.edits_of(len(plain(item)), decontaminate.Plan()):
                want[d, i] = near
    assert len(want) > 50 and set(got) <= set(want)
    assert all(want[x] == n for x, n in got.items())
    assert len(got) >= 0.98 * len(want)  # the search has a target recall; what it finds is exact


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, "another text of id one with enough words"), (None, text + " x"), (2, text), (3, ""), (3, "")]
    kept = collections.Counter((r.doc_id, r.text) for r in near_dedup.keep_one(table(spark, rows)).collect())
    assert kept == {(None, text + " x"): 1, (1, "another text of id one with enough words"): 1, (3, ""): 2}


def test_twice_the_lines_cost_at_most_about_twice(spark):
    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        d = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        start = time.perf_counter()
        assert [r.n_removed for r in line_dedup.dedup_lines(d).select("doc_id", "n_removed").orderBy("doc_id").collect()] == [0, n]
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(64000) <= 2 * min(seconds(32000), seconds(32000)) + 1


def test_core_queries_do_without_the_folder(tmp_path):
    """The entry module where an import of the folder fails."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"import sys; sys.path.insert(0, {root!r}); sys.modules['xxhash'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and 'pipeline' not in q and not any(n.startswith('op1') for n in q) and not set(e.oracle_sql()) - set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
