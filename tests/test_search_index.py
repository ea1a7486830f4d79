"""The gram index of search against the plain search over all texts."""

import random

import numpy as np

from wikimill.operators import search, search_index

SCHEMA = """id long, source string, source_title string, root_title string, translated_title string, source_wikitext string,
            published_revision_no int, published_html string, gram string, rows int"""
LETTERS = "aAbB é😀가 "


def documents(spark, n, rnd):
    def text(k):
        return "".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(k)))

    rows = [(rnd.choice([None, i, 7]), rnd.choice(["mirror", "mirror", "other"]), rnd.choice(["틀:x", text(8), text(8)]), rnd.choice([None, text(6)]),
             rnd.choice([None, text(9)]), rnd.choice([None, "", text(60)]), rnd.choice([1, 1, 0]), "<p>", "x", 1) for i in range(n)]
    rows.append((9000, "mirror", "long", "long", "long", "ab" * 100_000 + "needle in it", 1, "<p>", "x", 1))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def listed(df):
    """Rows of equal rank and title may stand in any order, and any of them may be cut: the order's keys are compared."""
    return [(r["rank"], len(r["translated_title"] or r["source_title"]), r["source_title"]) for r in df.collect()]


def test_posting_lists_are_runs_of_letters():
    texts = ["", "a", "abc", "aaaa", "x😀y가z", "abc\0\0d", "aaab"]
    for size in (1, 2, 3):
        gram, chunk, begin, place = search_index.posting_lists(texts, np.arange(1021, 1028), size)
        got = {(g, c * search_index.CHUNK + p) for g, c, lo, hi in zip(gram, chunk, begin[:-1], begin[1:], strict=True) for p in place[lo:hi].tolist()}
        assert got == {(t[i:i + size], 1021 + n) for n, t in enumerate(texts) for i in range(len(t) - size + 1)}
        assert len(place) == len(got) and begin[-1] == len(place)
    assert list(search_index.slices(np.array([1, 10**7, 0, 5, 5]))) == [(0, 1), (1, 2), (2, 5)]


def test_index_finds_what_the_scan_finds(spark):
    rnd = random.Random(4)
    docs = documents(spark, 400, rnd)
    index = search_index.build(docs)
    docs = index.documents()  # the same rows in every run
    for q in ["", "ab", "aba", " ABAB ", "a b", "bé😀", "needle in", "needles", "no such words at all " * 5, "".join(rnd.choice(LETTERS.lower()) for _ in range(4))]:
        assert listed(index.search_top(q, "mirror", 20)) == listed(search.search_top(docs, q, "mirror", 20)), q


def test_many_survivors_come_by_a_join_and_few_by_their_numbers(spark):
    index = search_index.build(documents(spark, 300, random.Random(5)))
    plans = [index.survivors("aba", literal)._jdf.queryExecution().executedPlan().toString() for literal in (1000, 1)]
    assert "Join" not in plans[0] and "PushedFilters: [In(_row" in plans[0].replace("Or(", "") and "Join" in plans[1]
    assert index.survivors("aba", 1000).count() == index.survivors("aba", 1).count() < 300


def test_an_empty_table_gives_no_rows(spark):
    index = search_index.build(documents(spark, 1, random.Random(6)).limit(0))
    assert index.search_top("needle", "mirror").count() == 0
