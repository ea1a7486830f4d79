"""Joins, graphs, resolution and writers on small tables."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wikimill.operators import assets as a
from wikimill.operators import graph as g
from wikimill.operators import quality as q
from wikimill.operators import ranking as r
from wikimill.operators import similarity as sim
from wikimill.session import cut_lineage, shared_dir
from wikimill.sources import sinks as k
from wikimill.sources import snapshots as v
from wikimill.sources import tables as t


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext.getCheckpointDir() is not None and shared_dir(spark)


def test_closure_equals_breadth_first_search(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(60)]
    seeds = [(x, x) for x in range(0, 31, 5)]
    got = {(x["root"], x["node"]): x["depth"] for x in g.transitive_closure(spark.createDataFrame(seeds, "root int, node int"), spark.createDataFrame(edges, "src int, dst int")).collect()}
    want = {}
    for root, _ in seeds:
        frontier, depth, seen = {root}, 0, {root: 0}
        while frontier:
            depth += 1
            frontier = {d for s, d in edges if s in frontier} - set(seen)
            seen.update(dict.fromkeys(frontier, depth))
        want.update({(root, n): d for n, d in seen.items()})
    assert got == want


def plain_crawl(root, links, max_depth, max_docs):
    best = {}
    for src, dst, score in links:
        if score >= 74:
            best.setdefault(src, {})[dst] = max(score, best.get(src, {}).get(dst, 0))
    queue, known, out = [(-100, 0, 0, root)], {root}, []
    while queue and len(out) < max_docs:
        queue.sort()
        worth, depth, _, node = queue.pop(0)
        out.append((root, node, depth, -worth, len(out) + 1))
        for dst, score in best.get(node, {}).items() if depth < max_depth else ():
            if dst not in known:
                known.add(dst)
                queue.append((-score, depth + 1, len(out), dst))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_crawl_equals_one_queue(spark, seed):
    """Random graphs with cycles, loops, repeated links, links of low scores, a hub and a root without links."""
    rnd = random.Random(seed)
    few = seed % 2  # few scores: large buckets and many ties
    links = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(60)}", rnd.choice([70, 80, 90, 100]) if few else rnd.randrange(60, 101)) for _ in range(160)]
    links += [("n0", f"n{i}", 80 + i % 3) for i in range(60)]
    roots = ["n0", "n1", "n5", "n7", "nowhere", "n1"]
    depth, docs = [(3, 25), (4, 9), (2, 100), (0, 5)][seed]
    got = g.crawl_frontier(spark.createDataFrame([(x,) for x in roots] + [(None,)], "title string"), spark.createDataFrame(links, "src string, dst string, score int"), depth, docs)
    want = [row for root in sorted(set(roots)) for row in plain_crawl(root, links, depth, docs)]
    assert sorted((x["root"], x["node"], x["depth"], x["score"], x["place"]) for x in got.collect()) == sorted(want)
    assert g.crawl_frontier(spark.createDataFrame([], "title string"), spark.createDataFrame(links, "src string, dst string, score int"), depth, docs).count() == 0


def py_expand(raw, templates, path=(), depth=0):
    def call(mt):
        parts = [x.strip() for x in mt.group(1).split(",")]
        name, params = parts[0], dict(x.split("=", 1) for x in parts[1:] if "=" in x)
        if name in path or depth >= 8 or name not in templates:
            return ""
        body = re.sub(r"@(\w+)=([^@\n]*)@", lambda y: params.get(y[1], y[2]), templates[name])
        body = re.sub(r"@(\w+)@", lambda y: params.get(y[1], ""), body)
        return py_expand(body, templates, (*path, name), depth + 1)

    return re.sub(r"\[include\(([^()]*)\)\]", call, raw)


def test_include_expansion(spark):
    rnd = random.Random(2)
    names = [f"틀:T{i}" for i in range(8)]

    def text():
        bits = ["x ", "@k=none@ ", "@k@ ", "\n"] + [f"[include({n}, k={rnd.randint(0, 9)})] " for n in names] + ["[include(틀:none)] ", "[include(틀:T1, k=@k=q@)] "]
        return "".join(rnd.choice(bits) for _ in range(6))

    templates = {n: text() for n in names}
    docs = [(i, text()) for i in range(25)]
    out = g.expand_includes(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(list(templates.items()), "title string, text string"))
    assert {x["id"]: x["text"] for x in out.collect()} == {i: py_expand(d, templates) for i, d in docs}


def test_table_pairing_equals_a_loop(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    mk = lambda: [(d, i, " ".join(rnd.sample(words, rnd.randint(1, 6))), rnd.randint(1, 4), rnd.randint(1, 4)) for d in range(12) for i in range(5)]
    o, b = mk(), mk()
    want = {}
    for d in range(12):
        used = set()
        for _, i, text, rows, cols in (x for x in o if x[0] == d):
            best = None
            for _, j, text2, rows2, cols2 in (x for x in b if x[0] == d):
                if j in used:
                    continue
                x, y = set(text.split()), set(text2.split())
                token = len(x & y) / len(x | y)
                score = token * 0.78 + (1 - min(1, abs(rows - rows2) / max(rows, rows2))) * 0.14 + (1 - min(1, abs(cols - cols2) / max(cols, cols2))) * 0.08
                if best is None or score > best[1] + 1e-12:
                    best = (j, score, token)
            if best and best[1] >= 0.32 and best[2] >= 0.20:
                used.add(best[0])
                want[(d, i)] = best[0]
    schema = "doc_id long, idx int, text string, n_rows int, n_cols int"
    got = sim.pair_tables(spark.createDataFrame(o, schema), spark.createDataFrame(b, schema)).collect()
    assert {(x["doc_id"], x["o_idx"]): x["b_idx"] for x in got} == want


TABLES = "doc_id long, idx int, text string, n_rows int, n_cols int"


def py_pairing(o, b):
    """Greedy pairing as a plain loop, in fractions."""
    found, used = {}, set()
    for d, i, text, rows, cols in sorted(o):
        offers = []
        for e, j, text2, rows2, cols2 in b:
            if d == e and (e, j) not in used and text and text2:
                x, y = set(text.split()), set(text2.split())
                token = Fraction(len(x & y), len(x | y))
                offers.append((-(78 * token + 14 * Fraction(min(rows, rows2), max(rows, rows2)) + 8 * Fraction(min(cols, cols2), max(cols, cols2))), j, token))
        if offers and (best := min(offers))[0] <= -32 and best[2] >= Fraction(1, 5):
            used.add((d, best[1]))
            found[(d, i)] = best[1]
    return found


def paired(spark, o, b):
    return [((x["doc_id"], x["o_idx"]), x["b_idx"]) for x in sim.pair_tables(spark.createDataFrame(o, TABLES), spark.createDataFrame(b, TABLES)).collect()]


def test_table_pairing_of_copies_takes_one_round(spark, monkeypatch):
    writes, stored = [], sim.stored
    monkeypatch.setattr(sim, "stored", lambda df, name: writes.append(name) or stored(df, name))
    o = [(1, i, "red green blue", 2, 2) for i in range(12)]
    assert sorted(paired(spark, o, o)) == [((1, i), i) for i in range(12)]
    assert len(writes) <= 2


def test_table_pairing_in_parts_and_rounds(spark, monkeypatch):
    for name, value in {"PART": 4, "PARTS": 3, "OFFERS": 2}.items():
        monkeypatch.setattr(sim, name, value)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(7)]
    mk = lambda: [(d, i, " ".join(rnd.sample(words, rnd.randint(0, 4))), rnd.randint(1, 3), rnd.randint(1, 3)) for d, n in enumerate((20, 9, 3, 0, 1)) for i in range(n)]
    o, b = mk(), mk()[:-1]
    copies = [(9, i, "red green blue", 2, 2) for i in range(15)]
    got = paired(spark, o + copies, b + copies)
    assert len(got) == len(dict(got))
    assert dict(got) == py_pairing(o + copies, b + copies)


def test_tokens_of_tables_move_once(spark):
    o = spark.createDataFrame([(1, 0, "red green blue", 2, 2)], TABLES)
    plan = sim.table_candidates(o, o)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_short_texts_compare_by_shorter_grams(spark):
    df = spark.createDataFrame([(1, "ab", "abc"), (2, "", ""), (3, "", "x"), (4, "A b C", "abc"), (5, "abcd", "abce")], "id int, l string, r string")
    got = {x["id"]: round(x["s"], 6) for x in sim.with_text_similarity(df, "l", "r", "s").collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0, 5: round(1 / 3, 6)}


MEDIA = "id int, root_title string, role string, caption string, alt_text string"


def media_match(spark, files, extra=(), role="album-cover:a"):
    media = spark.createDataFrame([(1, "Group", role, "A: Song", "Group album cover"), *extra], MEDIA)
    refs = spark.createDataFrame([(i, "Group", f) for i, f in enumerate(files)], "ref_id int, root_title string, file_name string")
    return {files[x["ref_id"]] for x in a.match_stored_media(refs, media).collect()}


def test_stored_media_match(spark):
    yes = ["A: Song.jpg", "A: Song(Group).jpg", "a song digital cover.png"]
    no = ["A: Song 로고.svg", "A: Song member profile.jpg", "A: Song(Other Group).jpg"]
    assert media_match(spark, yes + no) == set(yes)
    assert media_match(spark, yes, [(2, "Group", "album-cover:b", "A: Song", None)]) == set()
    assert media_match(spark, yes, role="infobox") == set()


def test_stored_over_remote_in_both_orders(spark):
    schema = "id long, root string, source_ref string, label string, original_url string, enrichment_url string, resolved_url string, storage_path string"
    stored = ("파일:A.jpg", "A.jpg", "https://cdn.example/a", None, "https://storage.example/a", "path-a")
    pending = ("https://cdn.example/a", "파일:A.jpg", None, None, None, None)
    hints = spark.createDataFrame([], "root string, key string, url string")
    for first, second in ((stored, pending), (pending, stored)):
        queue = spark.createDataFrame([(1, "R", *first), (2, "R", *second)], schema)
        got = {x["key"]: x["url"] for x in a.resolved_map(queue, hints, "root").collect()}
        assert got["A.jpg"] == "https://storage.example/a" and got["https://cdn.example/a"] == "https://storage.example/a"


def test_ambiguous_alias_stays_unresolved(spark):
    assets = spark.createDataFrame([("a", "Group Logo.svg", "u/a"), ("b", "Group (Logo).svg", "u/a"), ("b", "Logo-Group.svg", "u/b")], "scope string, key string, url string")
    refs = spark.createDataFrame([(1, "a", "File:Logo (Group).svg"), (2, "b", "Logo Group.svg"), (3, "b", "logo-group.SVG")], "ref_id int, scope string, ref string")
    got = {x["ref_id"]: (x["level"], x["url"]) for x in a.resolve_aliases(refs, assets, "scope").collect()}
    assert got[1] == (3, "u/a") and got[2] == (3, None) and got[3] == (2, "u/b")


def test_image_bytes(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D494844520000000200000005") + b"x"
    rows = [(1, b"\x01\x02\x03", "image/png", 200), (2, b"<html>", "text/html", 200), (3, b"", "image/png", 200), (4, b"x" * (8 * 1024 * 1024 + 1), "image/png", 200), (5, b"\x01", "image/png", 503), (6, png, None, 200)]
    df = spark.createDataFrame(rows, "id int, content binary, declared string, http_status int")
    assert {x["id"]: x["rejected"] for x in t.inspect_images(df).collect()} == {1: "", 2: "not_an_image", 3: "empty", 4: "too_large", 5: "http_status", 6: "placeholder_size"}


def test_image_files_reader(spark, tmp_path):
    (tmp_path / "a.gif").write_bytes(b"GIF89a" + bytes([5, 0, 7, 0]) + b"rest")
    x = t.inspect_images(t.image_files(spark, str(tmp_path)).withColumnRenamed("path", "url")).collect()[0]
    assert (x["type"], x["width"], x["height"], x["rejected"]) == ("image/gif", 5, 7, "")


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, ord int")
    once = k.upsert(target, new, ["id"], "ord")
    rows = lambda d: [tuple(x) for x in d.orderBy("id").collect()]
    assert rows(once) == [(1, "a", 1), (2, "y", 2), (3, "z", None)]
    assert rows(k.upsert(once, new, ["id"], "ord")) == rows(once)


def test_replace_children_empties_a_bucket(spark, tmp_path):
    path = str(tmp_path / "sections")
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc int, v string")
    k.write_bucketed(old.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(4)).cast("int")), path)
    k.replace_children(spark, path, spark.createDataFrame([(1,)], "doc int"), spark.createDataFrame([], "doc int, v string"), "doc", buckets=4)
    assert [tuple(x) for x in spark.read.parquet(path).select("doc", "v").collect()] == [(2, "c")]


def test_numbering_spreads_a_hot_key(spark):
    rnd = random.Random(9)
    rows = [(1 if rnd.random() < 0.6 else 2, rnd.randint(0, 400), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, i int")
    got = {x["i"]: x["n"] for x in r.numbered_within(df, "k", F.floor(F.col("o") / 50), [F.col("o"), F.col("i")], "n").collect()}
    want = {}
    for key in (1, 2):
        for n, row in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])), 1):
            want[row[2]] = n
    assert got == want
    everything = {x["i"]: x["pos"] for x in r.numbered(df, [F.col("o"), F.col("i")]).collect()}
    assert everything == {row[2]: n for n, row in enumerate(sorted(rows, key=lambda x: (x[1], x[2])), 1)}


def test_overlaps_across_stretches(spark):
    patches = [(1, 1, 0, 9000), (1, 2, 100, 200), (1, 3, 8500, 8600), (1, 4, 9000, 9100), (2, 1, 5, 6)]
    got = q.overlapping_patches(spark.createDataFrame(patches, "doc_id int, patch_id int, start_pos int, end_pos int")).collect()
    assert sorted((x["doc_id"], x["patch_id"]) for x in got) == [(1, 2), (1, 3)]


def test_empty_template_closure(spark):
    docs = spark.createDataFrame([("R", "A", "no includes")], "root_title string, source_title string, source_wikitext string")
    assert g.template_closure(docs).count() == 0


def table_rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_versions_of_a_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "doc int, v string")
    v.create(frame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (3, "d")]), path, "doc", buckets=4)
    first = v.version(spark, path)
    v.replace_children(spark, path, frame([(1, ""), (7, "")]).select("doc"), frame([(1, "new"), (2, "not a given parent"), (7, "seven")]))
    after = [(1, "new"), (2, "c"), (3, "d"), (7, "seven")]
    assert table_rows(v.read(spark, path).where("doc is not null")) == after and v.read(spark, path).where("doc is null").count() == 1
    assert len(table_rows(v.read(spark, path, first).where("doc = 1"))) == 2  # the old version is still whole

    # a failure between writing and the swap: the table stays, its files can be cleared, and the next change works
    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(v, "commit", fail)
        v.replace_children(spark, path, frame([(2, "")]).select("doc"), frame([(2, "half done")]))
    assert table_rows(v.read(spark, path).where("doc is not null")) == after
    assert len(v.vacuum(spark, path)) == 1
    # all rows of a bucket go
    v.replace_children(spark, path, frame([(i, "") for i in (1, 2, 3, 7)]).select("doc"), frame([]))
    assert table_rows(v.read(spark, path)) == [(None, "n")]

    # two changes from one version: the second one is refused
    stale = v.version(spark, path)
    v.insert_ignore(spark, path, frame([(5, "x"), (5, "y")]), F.col("v"))
    with pytest.raises(Exception, match="exist"):
        v.commit(spark, path, v.replace(stale, number=stale.number + 1))
    assert table_rows(v.read(spark, path).where("doc is not null")) == [(5, "x")]
    v.upsert(spark, path, spark.createDataFrame([(5, "old", 1), (5, "newest", 2), (6, "six", 1)], "doc int, v string, o int"), "o")
    assert table_rows(v.read(spark, path).where("doc is not null")) == [(5, "newest"), (6, "six")]
    v.vacuum(spark, path, keep=1)
    assert len(v.version_numbers(spark, path)) == 1 and v.read(spark, path).count() == 3
    with pytest.raises(ValueError, match="bucket"):
        v.create(frame([]).withColumn("Bucket", F.lit(1)), path, "doc")
    with pytest.raises(FileNotFoundError):
        v.read(spark, str(tmp_path / "nothing"))


def test_artifacts_are_written_once_and_contents_are_not_moved(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<p>{i % 7}", "css" if i % 2 else "") for i in range(40)] + [(None, "<p>only", None)], "id int, html string, css string")
    manifest = k.artifact_manifest(docs, "id", {"html": "html", "css": "css"})
    want = sorted([("html", f"<p>{i}") for i in range(7)] + [("html", "<p>only"), ("css", "css")])
    mostly = k.artifact_manifest(spark.createDataFrame([(i, f"<p>{i % 38}", "") for i in range(40)], "id int, html string, css string"), "id", {"html": "html", "css": "css"})
    for rows, small, n in ((manifest, 100, 9), (mostly, 5, 38), (manifest, 1, 9)):  # rows to keep, rows to drop, neither is small
        once = k.missing_artifacts(rows, small=small)
        assert len({(r["kind"], r["content"]) for r in once.collect()}) == once.count() == n
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert small == 1 or "hashpartitioning" not in plan
    path = str(tmp_path / "store")
    k.export_artifacts(manifest.where("id < 3"), path)
    files = {f.name for f in (tmp_path / "store").rglob("part-*")}
    k.export_artifacts(manifest, path)
    out = spark.read.parquet(path)
    assert sorted((r["kind"], r["content"]) for r in out.collect()) == want
    assert files < {f.name for f in (tmp_path / "store").rglob("part-*")}
    k.export_artifacts(manifest, path)
    assert out.sparkSession.read.parquet(path).count() == len(want)


def test_template_closure_equals_a_walk_from_every_root(spark):
    rnd = random.Random(21)
    names = [f"틀:T{i}" for i in range(12)]
    docs = [(f"R{i % 4}", f"R{i % 4}/d{i}", " ".join(f"[include({n})]" for n in rnd.sample(names, 2))) for i in range(8)]
    docs += [("R0", n, " ".join(f"[include({x})]" for x in rnd.sample(names, rnd.randrange(3)))) for n in names[:9]]
    out = {n: re.findall(r"include\(([^)]+)\)", text) for _, n, text in docs if n in names}
    want = set()
    for root in {d[0] for d in docs}:
        depth = {n: 0 for r0, title, text in docs if r0 == root and title not in names for n in re.findall(r"include\(([^)]+)\)", text)}
        queue = list(depth)
        for n in queue:
            for x in out.get(n, []):
                if x not in depth:
                    depth[x] = depth[n] + 1
                    queue.append(x)
        want |= {(root, n, d, n in out) for n, d in depth.items()}
    got = g.template_closure(spark.createDataFrame(docs, "root_title string, source_title string, source_wikitext string"))
    assert {(x["root"], x["node"], x["depth"], x["found"]) for x in got.collect()} == want


def test_without_repeats_at_one_place(spark):
    """Rows at the same place give the same result in whatever order they come."""
    rows = [(1, 5, "B"), (1, 5, "A"), (1, 5, "B"), (1, 4, "A"), (1, 6, "B")]
    for order in (rows, rows[::-1], sorted(rows)):
        d = r.without_repeats(spark.createDataFrame(order, "doc long, pos long, value string").coalesce(1), "doc", "pos", "value")
        assert sorted(tuple(x) for x in d.collect()) == [(1, 4, "A"), (1, 5, "B")]


def test_a_shared_call_is_expanded_once(spark, monkeypatch):
    """Many documents with the same call cost one expansion of it a round, and each gets the whole text."""
    sizes = []
    monkeypatch.setattr(g, "cut_lineage", lambda d: sizes.append((out := cut_lineage(d)).count()) or out)
    docs = spark.createDataFrame([(i, f"{i} [include(틀:A, x={i % 2})] and [include(틀:A, x=0)] [include(틀:Z)].") for i in range(60)], "id int, text string")
    templates = spark.createDataFrame([("틀:A", "a@x@[include(틀:B)]"), ("틀:B", "b")], "title string, text string")
    out = {x["id"]: x["text"] for x in g.expand_includes(docs, templates).collect()}
    assert out == {i: f"{i} a{i % 2}b and a0b ." for i in range(60)}
    assert max(sizes) == 2


def test_text_present_does_not_rewrite_the_text(spark):
    rows = [(None,), ("",), (" \t\n\r ",), ("\n a \n",), (" ",)]
    d = spark.createDataFrame(rows, "t string")
    assert [x[0] for x in d.select(q.text_present("t")).collect()] == [False, False, False, True, True]
    assert "regexp_replace" not in d.select(q.text_present("t"))._jdf.queryExecution().toString()
