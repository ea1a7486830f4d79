"""Spelling groups against a plain version."""

import collections
import random
import re
import zlib

import pytest
from helpers import LOWER, ODD, table
from wikimill.llm import spelling
from wikimill.llm.queries import QUERIES


def plain_words(rows, shortest=7):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_groups(counts):
    holes = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
    near = {w: set() for w in counts}
    for (a, b), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
        if a + b in counts:
            near[a + b] |= ws
            for w in ws:
                near[w].add(a + b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = plain_groups(plain_words([(d.doc_id, d.text) for d in docs]))
    assert any(r[1] for r in want)
    assert rows_of(QUERIES["op13_spelling_groups"](spark, sf_dir)) == want


@pytest.mark.parametrize("limit", [2, 8, 2048])
def test_one_shared_beginning_or_end_and_chains(spark, limit):
    """Few letters, so most words are near others; a third share a beginning, a third an end; keys are cut down to one letter."""
    rng = random.Random(limit)
    words = {"".join(rng.choices("abé", k=rng.randrange(7, 10))) for _ in range(150)}
    words |= {"qqqqqq" + "".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(80)} | {"".join(rng.choices("abcd", k=rng.randrange(1, 5))) + "zzzzzz" for _ in range(80)}
    rows = [(i, " ".join([w] * rng.choice([1, 2, 3, 25, 60, 700]))) for i, w in enumerate(sorted(words))]
    for w, n in {"chainab": 2, "chainabc": 30, "chainbbc": 400, "chainbbcd": 5000}.items():
        rows.append((next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:{w}".encode()) % 31), " ".join([w] * n)))
    want = plain_groups(plain_words(rows))
    assert ("chainab", "chainabc", "chainbbcd") in {r[:3] for r in want}
    assert rows_of(spelling.spelling_groups(table(spark, rows), limit=limit)) == want


def test_keys_are_cut_until_few_words_share_one(spark):
    words = spark.createDataFrame([("commonstart" + "".join(chr(97 + (i // 26**k) % 26) for k in range(3)), 2) for i in range(2000)], "word string, n long")
    rows = spelling.with_bounded_keys(spelling.first_keys(words, 7), 50)
    large = rows.groupBy(*spelling.KEY).count().where("count > 50")
    assert large.where("size - a - b > 1").isEmpty()


def test_odd_rows(spark):
    rows = [*ODD, (907, "straße STRASSE ÉCOLIER école" * 2), (None, "spelling speling spelling"), (908, "abcdefg" * 20000 + " " + "abcdefg" * 20000)]
    assert rows_of(spelling.spelling_groups(table(spark, rows))) == plain_groups(plain_words(rows))
    assert rows_of(spelling.spelling_groups(table(spark, rows).where("false"))) == []


def test_a_text_is_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 3)
    text = "one twothreefour 5 six-seven é"
    assert "".join(spelling.slices(text)) == text
    assert [r for part in spelling.slices(text) for r in spelling.RUN.findall(part)] == spelling.RUN.findall(text)
