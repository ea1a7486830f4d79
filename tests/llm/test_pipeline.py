"""Each stage of the pipeline against a plain version of what it decides, on the smallest tables."""

import collections
import re

import corpus_pipeline
import pytest
from helpers import LOWER, words
from wikimill.llm.common import read, stored


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The documents before the first stage and after each one."""
    out = [read(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), name.replace(" ", "-")))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few toxic labels to learn from
    before = read(spark, sf, "documents")
    after = corpus_pipeline.drop_toxic(spark, before, sf)
    assert after.dtypes == before.dtypes and after.exceptAll(before).count() == 0
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    toxic, clean = ({i for i, x in labels.items() if x == v} for v in (1, 0))
    # a few labelled documents have no toxic word at all
    assert len(toxic & kept) <= 0.08 * len(toxic) and len(clean - kept) <= 0.005 * len(clean)


def test_repeated_runs_go(steps):
    before, after = rows(steps[1]), rows(steps[2])
    assert set(before) == set(after)
    seen, gone = {}, collections.defaultdict(set)
    for i in sorted(before):
        lines = [(j, x) for j, x in enumerate(before[i].text.split("\n")) if x.strip(" ")]
        for a in range(len(lines) - 2):
            run = tuple(x for _, x in lines[a:a + 3])
            if seen.setdefault(run, (i, a)) != (i, a):
                gone[i].update(j for j, _ in lines[a:a + 3])
    assert gone
    for i, r in before.items():
        want = "\n".join(x for j, x in enumerate(r.text.split("\n")) if j not in gone[i])
        assert after[i].text == want and after[i].n_chars == len(want)


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[2]), rows(steps[3])

    def shingles(text):
        ws = words((text or "").translate(LOWER))
        return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()

    sets = {i: shingles(r.text) for i, r in before.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert set(after) == {i for i in sets if root(i) == i}


def test_passages_go(spark, sf_dir, steps):
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    items = [f" {plain(r.text)} " for r in read(spark, sf_dir, "benchmark").collect()]
    before, after = rows(steps[3]), rows(steps[4])
    holding = {i for i, r in before.items() if any(x in f" {plain(r.text)} " for x in items)}
    assert holding and not holding & set(after)
    assert len(set(before) - set(after) - holding) <= 0.02 * len(before)


def test_the_mix_holds_the_documents_words(steps):
    docs, mix = rows(steps[4]), steps[5].collect()
    taken = collections.Counter()
    for r in mix:
        assert words(docs[r.doc_id].text)[r.offset:r.offset + r.n_words] == words(r.text)
        taken[r.source] += r.n_words
    total = sum(len(words(r.text)) for r in docs.values())
    assert abs(sum(taken.values()) / total - 1.5) < 0.05
    blocks = collections.Counter((r.shard, r.slot) for r in mix)
    assert len(blocks) == len({(r.shard, r.slot, r.source, r.block) for r in mix})
    assert corpus_pipeline.ORACLE_SQL is None
