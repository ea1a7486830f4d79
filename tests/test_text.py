"""Text functions and scanners against plain Python on small inputs."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from wikimill.functions import html as h
from wikimill.functions import keys as k
from wikimill.functions import markup as m
from wikimill.functions.dates import expand_date_macros, iso_date
from wikimill.operators import extract as x
from wikimill.operators import parse as p
from wikimill.operators import quality as q
from wikimill.operators import search as s


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, src string")


def column(df, expr, *cols):
    return [r[0] for r in df.orderBy("id").select(expr.alias("v")).collect()]


def test_unicode_normalization(spark):
    texts = ["Ａｂｃ　１", "plain", "ｶﾞ ﬁ é", "①", None, ""]
    df = frame(spark, texts)
    assert column(df, k.nfkc("src")) == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert column(df, k.nfkd("src")) == [None if t is None else unicodedata.normalize("NFKD", t) for t in texts]


def test_keys(spark):
    df = frame(spark, [" 파일:Ａ  b​.PNG ", "File:x y.jpg?w=1", "Template: Foo", "foo", "틀:Bar"])
    assert column(df, k.asset_key("src"))[:2] == ["a b.png", "x y.jpg?w=1"]
    assert column(df, k.asset_base_key("src"))[1] == "x y"
    assert column(df, k.template_title("src"))[2:] == ["틀:Foo", "틀:foo", "틀:Bar"]
    files = frame(spark, ["File:Logo (Group).svg", "Group Logo.svg", "a.b", "noext", ".svg"])
    assert column(files, k.token_signature("src"))[:2] == ["svg|group|logo", "svg|group|logo"]
    assert column(files, k.compact_signature("src")) == ["svg|logogroup", "svg|grouplogo", "b|a", "|noext", "|svg"]


def py_include_bodies(text):
    out, low, at = [], text.lower(), 0
    while (start := low.find("[include(", at)) >= 0:
        depth, end = 0, -1
        for i in range(start + 9, len(text)):
            if text[i] == "(":
                depth += 1
            elif text[i] == ")":
                if depth:
                    depth -= 1
                elif text[i + 1 : i + 2] == "]":
                    end = i
                    break
        if end < 0:
            break
        out.append(text[start + 9 : end])
        at = end + 2
    return out


def test_include_bodies_on_random_text(spark):
    rnd = random.Random(7)
    bits = ["[include(", "[Include(", ")]", "(", ")", "]", ",", "T", "틀:a", "=", "\n", "x "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    texts.append("[include(a, b=((((deep))))]) tail [include(x)]")
    df = frame(spark, texts)
    assert column(df, m.include_bodies("src")) == [py_include_bodies(t) for t in texts]
    joined = column(df, m.include_pieces("src"))
    assert joined == [py_pieces(t) for t in texts]


def py_pieces(text):
    bodies, out, at = py_include_bodies(text), [], 0
    for b in bodies:
        start = text.lower().index("[include(" + b.lower() + ")]", at)
        out += [text[at:start], b]
        at = start + len(b) + 11
    return [*out, text[at:]]


def test_running_depth_matches_a_loop(spark):
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(["{{{", "}}}", "a", "{{{ }}}", "}}} }}}", "{{{ {{{"]) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    df = frame(spark, texts).withColumn("d", m.depth_after_lines(m.lines("src")))
    for text, got in zip(texts, column(df, F.col("d")), strict=True):
        depth, want = 0, []
        for line in text.split("\n"):
            depth = max(0, depth + line.count("{{{") - line.count("}}}"))
            want.append(depth)
        assert got == want


def py_balance(text):
    square = curly = i = 0
    while i < len(text):
        if text.startswith("[[", i):
            square, i = square + 1, i + 2
        elif text.startswith("]]", i) and square:
            square, i = square - 1, i + 2
        elif text.startswith("{{{", i):
            curly, i = curly + 1, i + 3
        elif text.startswith("}}}", i) and curly:
            curly, i = curly - 1, i + 3
        else:
            i += 1
    return square, curly


def test_bracket_balance(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("[]{}a") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = frame(spark, texts)
    got = list(zip(column(df, m.final_depth(F.col("src"), r"\[\[", r"\]\]")), column(df, m.final_depth(F.col("src"), r"\{\{\{", r"\}\}\}")), strict=True))
    assert got == [py_balance(t) for t in texts]


def test_block_boundaries(spark):
    cases = {
        "{{{#!wiki a\nx}}}{{{#!folding b\ny}}}": "{{{#!wiki a\nx}}}\n{{{#!folding b\ny}}}",
        "[[a|{{{#!wiki a\nx}}}{{{#!wiki b\ny}}}]]": "[[a|{{{#!wiki a\nx}}}{{{#!wiki b\ny}}}]]",
        "{{{#!wiki o\n{{{#!if a\nx}}}{{{#!if b\ny}}}\n}}}": "{{{#!wiki o\n{{{#!if a\nx}}}\n{{{#!if b\ny}}}\n}}}",
        "{{{plain}}}{{{#!wiki b\ny}}}": "{{{plain}}}{{{#!wiki b\ny}}}",
        "no blocks\r\nhere": "no blocks\nhere",
    }
    df = x.with_block_boundaries(frame(spark, list(cases)), "src", "fixed")
    assert column(df, F.col("fixed")) == list(cases.values())


def test_conditions(spark):
    cases = {
        "a == null": True, "a != null": False, "null == null": True, "'x' == 'x'": True, "3 >= 2 && !(1 > 2)": True, "a b == null": None,
        "a || 1 < x": None, "(a == null)": True, "a === 'q' || b == null": True, "x": False, "1": True, "0": False, "!zero": True, "": None, "5 > 'a'": None,
    }
    df = frame(spark, ["{{{#!if " + c + "\nbody}}}" for c in cases])
    got = [r["value"] for r in x.conditional_calls(df, "id", "src").orderBy("id").collect()]
    assert got == list(cases.values())


def py_blocks(text):
    """Reference walk over lines: gather each kind of block by its own rule."""
    lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)
    body = [ln.rstrip("\r\n") for ln in lines]
    kind = [p.line_class(b) for b in body]
    delta = [b.count("{{{") - b.count("}}}") for b in body]
    out, i = [], 0
    while i < len(lines):
        k0, j, depth = kind[i], i, 0
        if k0 in ("whitespace", "list"):
            while j < len(lines) and kind[j] == k0:
                j += 1
        elif k0 in ("heading", "template", "media", "divider"):
            j += 1
        elif k0 in ("styled-block", "raw-block"):
            while j < len(lines):
                depth += delta[j]
                j += 1
                if depth <= 0:
                    break
        else:
            while j < len(lines):
                if j > i and depth == 0 and kind[j] != k0:
                    break
                depth = max(0, depth + delta[j])
                j += 1
        out.append((k0, "".join(lines[i:j])))
        i = j
    return out


def test_markup_blocks_and_losslessness(spark):
    rnd = random.Random(11)
    pool = ["== H ==", "=== x ==", "text {{{ a", "}}} b", "plain", "", "  ", "|| a || b ||", "|| open {{{", " * item", " 1. item", "----", "{{{#!wiki s", "{{{", "}}}", "[include(틀:a)]", "[[파일:x.png]]", "[youtube(abc)]"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25))) + rnd.choice(["", "\n", "\r\n"]) for _ in range(150)]
    df = frame(spark, texts)
    rows = p.markup_blocks(df, "id", "src").orderBy("id", "pos").collect()
    for n, text in enumerate(texts):
        got = [(r["type"], r["raw"]) for r in rows if r["id"] == n]
        assert "".join(r for _, r in got) == text
        assert got == py_blocks(text)
    parts = F.filter(p.block_texts("src"), lambda x, i: (F.col("id") != 3) | (i != 0))
    assert [r["id"] for r in q.lossy_splits(p.blocked(df, "id", "src"), "id", "src", parts).collect()] == [3]


def py_editable(text):
    locks = [(re.compile(a.replace("(?i)", ""), re.I if "(?i)" in a else 0), b) for a, b in p.LOCK_RULES]
    line_lock = lambda s_: next((b for rx, b in locks if rx.search(s_)), "")
    out, sec, depth, cur, start_protected = [], 0, 0, [], None
    number = 0

    def flush():
        nonlocal cur, number
        if cur:
            reason = "Document lead metadata" if sec == 0 else "Inside a protected wiki block" if cur[0][1] > 0 else next((line_lock(t) for t, _ in cur if line_lock(t)), "")
            out.append((sec, number, "\n".join(t for t, _ in cur).strip(), reason))
            number += 1
        cur = []

    for line in text.split("\n"):
        if re.match(r"^(={2,6})\s*(.*?)\s*\1\s*$", line):
            flush()
            sec, depth, number = sec + 1, 0, 0
            continue
        if not line.strip() and depth == 0:
            flush()
            continue
        protected = depth > 0 or bool(line_lock(line))
        if cur and start_protected != protected and depth == 0:
            flush()
        if not cur:
            start_protected = protected
        cur.append((line, depth))
        depth = max(0, depth + line.count("{{{") - line.count("}}}"))
    flush()
    return out


def test_editable_blocks(spark):
    rnd = random.Random(13)
    pool = ["== H ==", "plain words", "more", "", " ", "|| a ||", "{{{#!wiki s", "}}}", "{{{x}}}", "[include(a)]", "----", "[br] text", "[age(2000-01-01)]"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 30))) for _ in range(120)]
    rows = p.editable_blocks(frame(spark, texts), "id", "src").orderBy("id", "section", "block").collect()
    for n, text in enumerate(texts):
        got = [(r["section"], r["block"], r["raw"], "" if r["editable"] else r["lock"]) for r in rows if r["id"] == n]
        want = [(a, b, c, d or ("" if c else "Empty block")) for a, b, c, d in py_editable(text)]
        assert [(g[:3]) for g in got] == [(w[:3]) for w in want], text
        assert [g[3] for g, w in zip(got, want, strict=True) if w[3]] == [w[3] for w in want if w[3]]


def test_table_rows(spark):
    text = "|| a || [[x|y || z]] ||\nno row\n|| {{{ in\n|| side }}} || b ||\n|| never closed\ntext\n  ||<-2> opt || last ||"
    rows = p.markup_cells(frame(spark, [text]), "id", "src").orderBy("row", "col").collect()
    got = {}
    for r in rows:
        got.setdefault(r["row"], []).append(r["raw"])
    assert list(got.values())[:2] == [[" a ", " [[x|y || z]] "], [" {{{ in\n|| side }}} ", " b "]]
    assert list(got.values())[2] == [" never closed\ntext\n  ", "<-2> opt ", " last "]


def test_chunks_and_structure(spark):
    source = "== 개요 ==\n[[방탄소년단|BTS]] 링크\n[include(틀:국기, 국명=대한민국)]\n|| a || b ||\n{{{#!wiki x\ny}}}\n[* note] https://x.example/a\n[youtube(abcdef1)]\n"
    good = source.replace("개요", "Overview").replace("링크", "link")
    bad = good.replace("[[방탄소년단|BTS]]", "[[BTS|BTS]]")
    df = spark.createDataFrame([(1, source, good), (2, source, bad)], "id int, a string, b string")
    errors = {r["id"]: r["e"] for r in df.select("id", q.structure_errors("a", "b").alias("e")).collect()}
    assert errors[1] == []
    assert errors[2] == ["links_changed:1->1"]
    chunks = [r["text"] for r in p.line_chunks(df.where("id = 1"), "id", "a", 50).orderBy("chunk").collect()]
    assert len(chunks) >= 2 and "".join(chunks) == source
    want, cur = [], ""
    for line in re.split(r"(?<=\n)", source):
        if cur and len(cur) + len(line) > 50:
            want.append(cur)
            cur = ""
        cur += line
    assert chunks == ([*want, cur] if cur else want)


def test_dates(spark):
    df = frame(spark, ["born 2001년 2월 3일 x", "on 2020. 11. 05.", "none", "[dday(2024-07-01)] [age(2000-07-03)] [dday(2024-13-01)]"])
    assert column(df, iso_date("src"))[:3] == ["2001-02-03", "2020-11-05", None]
    at = F.lit("2024-07-01 20:00:00").cast("timestamp")  # the next day in UTC+9
    assert column(df, expand_date_macros("src", at))[3] == "+1 23 [dday(2024-13-01)]"


def test_snippet(spark):
    long = "This sentence about a group is long enough to be shown here, surely. " * 5
    df = frame(spark, ["== Overview ==\n{{{#!wiki\nhidden sentence that is long enough to be shown, but inside.\n}}}\nshort.\n" + long + "\n== Next ==\nother"])
    got = s.with_snippet(df, "src").collect()[0]["snippet"]
    assert got.startswith("This sentence") and got.endswith("…") and len(got) <= 218


def depth_of(text, mark, links):
    """Plain split by a character loop."""
    parts, cur, paren, square, curly, quoted, i = [], "", 0, 0, 0, False, 0
    while i < len(text):
        step = 1
        if quoted:
            quoted = not (text[i] == '"' and text[i - 1] != "\\")
        elif links and text[i] == '"':
            quoted = True
        elif links and text.startswith(("{{{", "}}}"), i):
            curly, step = max(0, curly + (1 if text[i] == "{" else -1)), 3
        elif links and text.startswith(("[[", "]]"), i):
            square, step = max(0, square + (1 if text[i] == "[" else -1)), 2
        elif text[i] in "()" and not (square or curly):
            paren = max(0, paren + (1 if text[i] == "(" else -1))
        elif text[i] == mark and not (paren or square or curly):
            parts, cur, i = [*parts, cur], "", i + 1
            continue
        cur += text[i:i + step]
        i += step
    return [*parts, cur]


def test_splits_at_any_depth(spark):
    rnd = random.Random(21)
    texts = ["".join(rnd.choice(["(", ")", "[[", "]]", "{{{", "}}}", ",", "|", "=", "a", '"', "b c"]) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    texts += ["f(a(b(c(d,e),g),h),i), z=1", "plain, text", ""]
    df = frame(spark, texts)
    for mark in ",|":
        assert column(df, m.split_top(F.col("src"), mark)) == [depth_of(t, mark, True) for t in texts]
    assert column(df, m.top_level_parts(F.col("src"))) == [depth_of(t, ",", False) for t in texts]
    halves = [[(p := depth_of(t, "=", True))[0], t[len(p[0]) + 1:]] if len(p := depth_of(t, "=", True)) > 1 else [t] for t in texts]
    assert column(df, m.split_once(F.col("src"))) == halves
    df = frame(spark, ["[include(T, k=f(a(b(c,d),e),g), z=1)]"])
    rows = x.template_calls(df, "id", "src").orderBy("param").collect()
    assert [(r["name"], r["value"]) for r in rows] == [("k", "f(a(b(c,d),e),g)"), ("z", "1")]


def test_conditions_and_media_at_any_depth(spark):
    text = "{{{#!if a == null\n" * 5 + "x {{{b}}} y" + "}}}" * 5
    rows = x.conditional_calls(frame(spark, [text]), "id", "src").orderBy("pos").collect()
    assert len(rows) == 5 and rows[-1]["body"] == "x {{{b}}} y" and all(r["value"] for r in rows)
    assert rows[0]["body"].startswith("{{{#!if a == null") and rows[0]["body"].endswith("}}}")
    media = "[[File:a.png|x [[b|[[c]] d]] [[e]]|w=1]] [youtube(abc, [z [y]])] [[File:open"
    got = x.media_calls(frame(spark, [media]), "id", "src").orderBy("pos").collect()
    assert [(r["kind"], r["target"], r["options"]) for r in got] == [("file", "File:a.png", "x [[b|[[c]] d]] [[e]]|w=1"), ("youtube", "abc", "[z [y]]")]


def test_nested_tables_and_lists(spark):
    inner = "deep"
    for level in range(6):
        inner = f"<table><tr><td>L{level}</td><td>{inner}</td></tr></table>"
    lists = "<ul><li>a" * 6 + "</li></ul>" * 6
    page = f"<article><p>one</p>{inner}{lists}<ol><li>b</li></ol><ul><li>open <p>two</p></article>"
    blocks = p.page_blocks(p.page_sections(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html"), "id").orderBy("pos")
    got = [(r["type"], r["raw"]) for r in blocks.collect()]
    assert got == [("paragraph", "<p>one"), ("table", inner), ("list", lists), ("list", "<ol><li>b</li></ol>"), ("paragraph", "<p>two")]
    cells = p.table_cells(blocks, ["id", "pos"]).orderBy("row", "col").collect()
    assert [(c["row"], c["col"], c["text"][:2]) for c in cells] == [(0, 0, "L5"), (0, 1, "L4")]


def test_spans_and_cuts_are_those_of_the_text(spark):
    rnd = random.Random(22)
    texts = ["".join(rnd.choice(["ab", "é", "x", "😀", "\n"]) for _ in range(n)) for n in (0, 1, 5, 600, 3000)]
    from wikimill.functions import html as h

    df = frame(spark, texts)
    spans = column(df, h.match_spans(F.col("src"), "x+"))
    assert [[(s["start"], s["raw"]) for s in row] for row in spans] == [[(hit.start() + 1, hit.group()) for hit in re.finditer("x+", t)] for t in texts]
    for start, n in ((1, 3), (1, 0), (500, 40), (513, 512), (1000, 2000)):
        assert column(df, h.cut(h.chunks(F.col("src")), F.lit(start), F.lit(n))) == [t[start - 1:start - 1 + n] for t in texts]


def test_long_texts_take_linear_time(spark):
    import time

    def seconds(n):
        body = "".join(f"[[Page {i}|label {i}]] text 가나 {{{{{{x}}}}}}\n" for i in range(n))
        df = spark.createDataFrame([(1, "T", body)], "id int, title string, src string")
        begin = time.time()
        assert x.page_links(df, "id", "title", "src").count() == n
        assert q.syntax_leaks(df, "id", "src").count() >= 0
        assert len(df.select(q.untranslated_text("src").alias("t")).first()["t"]) > 0
        return time.time() - begin

    seconds(100)
    small, large = seconds(1500), seconds(6000)
    assert large < 6 * small + 2


def plain_context(html, start, end, near=140):
    """Row or item around html[start:end], else its neighbourhood (the plain search over all tags for every link)."""
    for tag in ("tr", "li"):
        opens = [m.start() for m in re.finditer(f"<{tag}", html) if m.start() < start]
        closes = [m.end() + 1 for m in re.finditer(f"</{tag}", html) if m.start() >= end]
        if opens and closes:
            return opens[-1], min(closes) - opens[-1]
    low = max(0, start - near)
    return low, end - low + near


def test_link_places_equal_a_plain_search(spark):
    rng = random.Random(11)
    parts = ["<tr>", "</tr>", "<li>", "</li>", '<a href="/w/A">a</a>', '<a href="/w/B">bb</a>', "text ", "<td>"]
    pages = ["".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(60)] + ["", None]
    d = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    spans = h.match_spans(F.col("html"), "<a [^>]*>[^<]*</a>")
    for row in d.select("id", "html", spans.alias("s")).select("html", x.link_places(F.col("html"), F.col("s")).alias("p")).collect():
        want = [plain_context(row.html, m.start(), m.end()) for m in re.finditer("<a [^>]*>[^<]*</a>", row.html or "")]
        assert [(p["begin"] - 1, p["length"]) for p in row.p or []] == want


def test_twice_the_links_cost_at_most_about_twice(spark):
    """Links in rows of their own and in one long row; the smaller of two runs each, with a constant for planning."""
    def page(n, kind):
        one = {"rows": "<tr>멤버 G <a href='/w/T{}'>T</a></tr>", "items": "<li>앨범 G <a href='/w/T{}'>T</a></li>", "row": "멤버 G <a href='/w/T{}'>T</a> ", "free": "<p>G <a href='/w/T{}'>T</a> words</p>"}[kind]
        return ("<tr>" if kind == "row" else "") + "".join(one.format(i) for i in range(n)) + "</tr>"

    def seconds(n, kind):
        d = spark.createDataFrame([(1, "G", "G", page(n, kind))], "page_id int, title string, root_title string, html string")
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            x.relation_candidates(d, "page_id", "html").collect()
            best = min(best, time.perf_counter() - start)
        return best

    for kind in ("rows", "row"):
        assert seconds(12000, kind) <= 2 * seconds(6000, kind) + 0.5, kind


def test_conditions_with_given_values(spark):
    given = {"a": "x", "n": "3", "e": "", "q": "it's", "null": "7"}
    cases = {
        "a == 'x'": True, 'a == "y"': False, "a != 'x'": False, "b == 'x'": False, "b == null": True, "a == null": False, "n == 3": False, "n != 3": True, "n > 2": None,
        "e == ''": True, "e": False, "a && n": True, "a && b": False, "a == b": False, "b == c": True, "q == \"it's\"": True, "q == 'it\\'s'": True, "null == null": True,
        "a == true": False, "a x == 'x'": None, "A == 'x'": False, "(a) == 'x' || 1 < x": True, "b && 1 < x": False, "a && 1 < x": None,
    }
    rows = [(i, "{{{#!if " + c + "\nbody}}}", given) for i, c in enumerate(cases)]
    df = spark.createDataFrame([*rows, (99, "{{{#!if a == null\n}}}", None), (100, None, given)], "id int, src string, env map<string,string>")
    got = [r["value"] for r in x.conditional_calls(df, "id", "src", "env").orderBy("id").collect()]
    assert got == [*cases.values(), True]


def plain_resolve(text, names):
    """Body by body: the balanced end of each block is searched anew."""
    out, n, shown, at = "", 0, 0, 0
    while (start := text.find("{{{#!if", at)) >= 0:
        depth, end = 0, -1
        for brace in re.finditer(r"\{\{\{|\}\}\}", text[start:]):
            depth += 1 if brace.group() == "{{{" else -1
            if not depth:
                end = start + brace.start()
                break
        if end < 0:
            break
        out += text[at:start]
        n += 1
        condition, _, body = text[start + 7:end].partition("\n")
        if x._evaluate(condition, names):
            inner = plain_resolve(body, names)
            out, n, shown = out + inner[0], n + inner[1], shown + 1 + inner[2]
        at = end + 3
    return out + text[at:], n, shown


def test_resolved_texts_equal_a_plain_walk(spark):
    rng = random.Random(12)
    parts = ["{{{#!if a == 'x'\n", "{{{#!if a != 'x'\n", "{{{#!if a b\n", "{{{#!wiki\n", "{{{", "}}}", "}}}", "}}}", " word\n", "{{{#!if b == null"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(0, 14))), {"a": rng.choice("xy")}) for i in range(300)]
    rows += [(300, None, None), (301, "{{{#!if a == 'x'\n" * 2000 + "}}}" * 2000, {"a": "x"})]
    got = {r["id"]: r for r in x.resolve_conditions(spark.createDataFrame(rows, "id int, src string, env map<string,string>"), "id", "src", "env").collect()}
    for i, text, names in rows[:300]:
        assert (got[i]["text"], got[i]["evaluated"], got[i]["included"]) == plain_resolve(text, names), text
    assert got[300]["text"] is None and got[301]["included"] == 2000 and got[301]["text"] == ""


def test_call_parameters(spark):
    df = frame(spark, ["[include(틀:A, x=1, x = 2 ,third, y=[[a,b]], =no)] [include(Template:B)]", None, "none"])
    rows = x.call_parameters(df, "id", "src").orderBy("id", "call").collect()
    assert [(r["id"], r["call"], r["given"]) for r in rows] == [(0, 0, {"x": "2", "y": "[[a,b]]", "": "no"}), (0, 1, {})]


def test_per_value_holds_a_stretch_of_a_batch():
    """Values of a batch become Python objects a stretch at a time, results leave before the next stretch; null stays null."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from wikimill.functions.batches import STRETCH, per_value

    seen = []
    run = per_value(T.StringType())(lambda x: seen.append(x) or x.upper()).func
    out = run(iter([pa.array(["a"] * (3 * STRETCH) + [None])]))
    assert next(out).to_pylist() == ["A"] * STRETCH and len(seen) == STRETCH
    assert [len(b) for b in out] == [STRETCH, STRETCH, 1] and len(seen) == 3 * STRETCH
