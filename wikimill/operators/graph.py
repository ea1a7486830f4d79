"""Link and include graphs (G*). Iterations cut their lineage in the shared checkpoint folder after every round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import internal_links, woven
from ..functions.arrays import rest, rows_of
from ..functions.keys import document_key, strip, template_title, title_key
from ..functions.markup import include_bodies, include_pieces, include_target, simple_includes, top_level_parts
from ..functions.urls import SITE, Site
from ..session import cut_lineage, stored
from .filters import profile_score
from .ranking import first_by, top_rows


def include_edges(docs: DataFrame, title: str, source: str) -> DataFrame:
    """Distinct document -> template edges by the balanced rule; only real templates count."""
    names = F.array_distinct(F.transform(include_bodies(source), include_target))
    edges = rows_of(docs.where(F.col(source).isNotNull()), [F.col(title).alias("owner")], names, "template")
    keep = F.col("template").rlike("^틀:") & ~F.col("template").rlike(r"/설명문서(?:$|/)") & ~F.col("template").rlike(r"[{}\[\]]")
    return edges.withColumn("template", title_key("template")).where(keep)


def simple_include_edges(docs: DataFrame, title: str, source: str) -> DataFrame:
    """Distinct document -> template edges by the short rule; the local namespace is added where it is absent."""
    names = F.array_distinct(simple_includes(source))
    edges = rows_of(docs.where(F.col(source).isNotNull()), [F.col(title).alias("owner")], names, "template")
    return edges.withColumn("template", template_title("template")).where("template <> ''").distinct()


def transitive_closure(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All nodes each root can reach, with the smallest number of steps.

    ``seeds(root, node)`` start at depth 0, ``edges(src, dst)`` may hold cycles. Every round joins only the new nodes.
    """
    edges = stored(edges.select("src", "dst").distinct(), "closure-edges")
    frontier = stored(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)), "closure-new")
    visited, depth = frontier, 0
    while max_rounds is None or depth < max_rounds:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(visited, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure-new")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % 8 == 0:
            visited = stored(visited, "closure-seen")
    return visited


def template_closure(docs: DataFrame) -> DataFrame:
    """Templates each root needs, directly or through other templates, and whether a document for them exists.

    ``docs(root_title, source_title, source_wikitext)``; the articles of a root are its seeds.
    """
    d = docs.withColumn("_key", document_key("source_title"))
    is_template = F.col("_key").startswith("틀:")
    # texts are read once; seeds and edges are parts of what they give
    owners = d.withColumn("_own", F.struct(F.col("_key").alias("src"), F.col("root_title").alias("root")))
    calls = stored(simple_include_edges(owners, "_own", "source_wikitext").select("owner.*", F.col("template").alias("dst")), "template-calls")
    seeds = calls.where(~F.col("src").startswith("틀:")).select("root", F.col("dst").alias("node")).distinct()
    edges = calls.where(F.col("src").startswith("틀:")).select("src", "dst")
    known = d.where(is_template).select(F.col("_key").alias("node"), F.lit(True).alias("found")).distinct()
    # a template that many roots use is walked once: the closure is that of the used templates, and the roots join it
    used = seeds.select(F.col("node").alias("root"), "node").distinct()
    below = transitive_closure(used, edges)
    reached = seeds.withColumnRenamed("node", "via").join(below.withColumnRenamed("root", "via"), "via").groupBy("root", "node").agg(F.min("depth").alias("depth"))
    return reached.join(known, "node", "left").select("root", "node", "depth", F.coalesce("found", F.lit(False)).alias("found"))


def crawl_frontier(roots: DataFrame, links: DataFrame, max_depth: int, max_docs: int, min_score: int = 74) -> DataFrame:
    """Documents a bounded crawl fetches from each root, in the order of one priority queue per root.

    ``roots(title)``, ``links(src, dst, score)``. The queue gives the best score, then the least depth, then what was found first
    (by the earlier document, in it by score and title). A title enters a root's queue once, with the score and depth of its first
    discovery. Documents of ``max_depth`` are fetched and not followed; a root takes ``max_docs`` documents.

    All roots advance together. A round follows the next open titles of every root, ``max_docs`` at most, and lines them up with the
    titles they find: one found by the i-th stands behind all that were as urgent already, and behind the i-th. Titles that are not
    followed themselves (of ``max_depth``) can be settled at once; the line is cut at the first other one, as that has to be followed
    before the rest is known. So there are as many rounds as such cuts, and never more than ``max_docs``. What has been queued is
    remembered in a table.
    """
    links = stored(links.where(F.col("score") >= min_score).groupBy("src", "dst").agg(F.max("score").alias("score")), "crawl-links")
    start = roots.select(F.col("title").alias("root"), F.col("title").alias("node")).where("root IS NOT NULL").distinct()
    opened = start.withColumns({"depth": F.lit(0), "score": F.lit(100), "finder": F.lit(0), "used": F.lit(0)})
    known = stored(start, "crawl-known")
    urgency = F.struct((-F.col("score")).alias("worth"), "depth")
    fetched = []
    for turn in range(1, max_docs + 1):
        ranked = top_rows(opened, ["root"], [urgency, F.col("finder"), F.col("node")], max_docs).where(F.col("rn") <= max_docs - F.col("used"))
        ranked = stored(ranked, "crawl-open")
        if ranked.isEmpty():
            break
        found = ranked.where(F.col("depth") < max_depth).alias("d").join(links.alias("l"), F.col("d.node") == F.col("l.src"))
        found = found.join(known.alias("k"), (F.col("k.root") == F.col("d.root")) & (F.col("k.node") == F.col("l.dst")), "left_anti")
        first = F.min(F.struct("d.rn", "l.score", (F.col("d.depth") + 1).alias("depth")))
        fresh = found.groupBy(F.col("d.root").alias("root"), F.col("l.dst").alias("node")).agg(first.alias("f")).select("root", "node", "f.*")
        ahead = ranked.groupBy("root").agg(F.collect_list(urgency).alias("ahead"), F.first("used").alias("used"))  # max_docs of a root at most
        gap = F.greatest("rn", F.size(F.filter("ahead", lambda u: u <= urgency)))
        fresh = stored(fresh.join(ahead, "root").withColumn("line", F.struct(gap.alias("gap"), F.lit(1).alias("kind"), (-F.col("score")).alias("worth"), "depth", F.col("rn").alias("by"), "node")).drop("ahead"), "crawl-found")
        cut = fresh.where(F.col("depth") < max_depth).groupBy("root").agg(F.min("line").alias("cut"))
        cols = ["root", "node", "depth", "score", "used", "line", "rn"]
        line = F.struct(F.col("rn").alias("gap"), F.lit(0).alias("kind"), (-F.col("score")).alias("worth"), "depth", F.col("rn").alias("by"), "node")
        lined = ranked.withColumn("line", line).select(cols).unionByName(fresh.where(F.col("depth") == max_depth).select(cols)).withColumnRenamed("rn", "by")
        lined = lined.join(cut, "root", "left").where(F.coalesce(F.col("line") < F.col("cut"), F.lit(True)))
        lined = top_rows(lined, ["root"], [F.col("line")], max_docs).where(F.col("rn") <= max_docs - F.col("used"))
        lined = stored(lined.select("root", "node", "depth", "score", "by", (F.col("line.kind") == 0).alias("followed"), (F.col("used") + F.col("rn")).alias("place")), "crawl-settled")
        fetched.append(lined.select("root", "node", "depth", "score", "place"))
        finders = lined.where("followed").select("root", F.col("by").alias("rn"), F.col("place").alias("finder"))
        new = fresh.join(finders, ["root", "rn"])
        left = ranked.unionByName(new.select(ranked.columns)).join(lined, ["root", "node"], "left_anti")
        used = lined.groupBy("root").agg(F.max("place").alias("used"))
        opened = left.drop("rn", "used").join(used, "root").where(F.col("used") < max_docs)
        known = known.unionByName(new.select("root", "node"))
        if turn % 8 == 0:
            known, fetched = stored(known, "crawl-known"), [stored(reduce(DataFrame.unionByName, fetched), "crawl-fetched")]
    empty = start.select("root", "node", *(F.lit(0).alias(c) for c in ("depth", "score", "place"))).where("false")
    return reduce(DataFrame.unionByName, fetched, empty)


def link_graph(links: DataFrame) -> DataFrame:
    """One edge per document and target: the first anchor text, first and last time seen."""
    return links.groupBy("from_id", "to_title").agg(
        F.min_by("anchor_text", F.struct("position", "anchor_text")).alias("anchor_text"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
    )


def backlinks(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Linking documents per target and whether the target exists."""
    counts = edges.groupBy("to_title").agg(F.countDistinct("from_id").alias("n_from"), F.count("*").alias("n_links"))
    known = docs.select(F.col("title").alias("to_title"), F.lit(True).alias("_found")).distinct()
    return counts.join(known, "to_title", "left").select("to_title", "n_from", "n_links", F.col("_found").isNull().alias("unresolved"))


def link_integrity(pages: DataFrame, html: str, scope: DataFrame, published: DataFrame, site: Site = SITE) -> DataFrame:
    """Per page: links to scope titles that are not published, and links that leave the scope.

    ``scope(root_title, title)`` is the core scope of each root, ``published(title)`` the published titles.
    """
    links = rows_of(pages, ["id", "root_title"], internal_links(html, site), "title")
    links = links.withColumn("title", title_key("title"))
    s = scope.select("root_title", "title", F.lit(True).alias("_in")).distinct()
    p = published.select("title", F.lit(True).alias("_pub")).distinct()
    j = links.join(s, ["root_title", "title"], "left").join(p, "title", "left")
    return j.groupBy("id").agg(
        F.count("*").alias("links"),
        F.count_if(F.col("_in").isNotNull() & F.col("_pub").isNull()).alias("unpublished_core"),
        F.count_if(F.col("_in").isNull()).alias("outside_core"),
    )


# Sub-documents that never belong to the core.
EXCLUDED_SUFFIXES = ("노래방 수록 목록", "유튜브")


def core_scope(docs: DataFrame, relations: DataFrame) -> DataFrame:
    """Core documents per root with the strongest reason, its priority and score.

    ``docs(root_title, source_title, source_wikitext, crawl_depth)``,
    ``relations(root_title, title, label, reason, score, pos)`` as found on the root page.
    """
    d = docs.withColumn("title", title_key("source_title")).where(~F.col("title").rlike("(?i)^(?:틀|Template):"))
    # the texts are judged first, so that only a flag is shuffled
    d = d.select("root_title", "title", "id", "crawl_depth", (profile_score("source_wikitext") >= 2).alias("is_profile"))
    d = first_by(d, ["root_title", "title"], [F.col("id")], ["is_profile", "crawl_depth"])
    root = F.col("root_title")
    suffix = F.when(
        F.startswith(F.col("title"), F.concat(root, F.lit("/"))), F.substring("title", F.length(root) + 2, F.length("title"))
    ).otherwise("")
    roots = d.where(F.col("title") == root).select("root_title", "title", F.lit("root").alias("reason"), F.lit(100).alias("priority"), F.lit(100).alias("score"), F.lit(-1).cast("bigint").alias("pos"))

    rel = relations.withColumn("title", title_key("title")).join(d.drop("crawl_depth"), ["root_title", "title"])
    reason, label = F.col("reason"), F.col("label")
    fandom = (reason == "root-activity-row") & (label.contains("팬덤") | F.col("title").contains("팬덤"))
    member = (reason == "root-qualified-title") & F.col("is_profile")

    def by_rule(sub, row, fan, qualified) -> Column:
        return (
            F.when((reason == "root-subdocument") & ~suffix.isin(*EXCLUDED_SUFFIXES), sub)
            .when(reason == "root-member-row", row)
            .when(fandom, fan)
            .when(member, qualified)
        )

    picked = rel.select(
        "root_title", "title",
        by_rule("root_subdocument", "member_row", "fandom", "qualified_member_profile").alias("reason"),
        by_rule(95, 92, 88, 90).alias("priority"),
        F.when(F.coalesce("score", F.lit(0)) > 0, F.col("score")).otherwise(by_rule(100, 90, 82, 95)).alias("score"),
        F.col("pos").cast("bigint").alias("pos"),
    ).where("reason IS NOT NULL")
    depth = F.when(F.coalesce("crawl_depth", F.lit(0)) == 0, 99).otherwise(F.col("crawl_depth"))
    fallback = d.where(F.startswith(F.col("title"), F.concat(root, F.lit("/"))) & ~suffix.isin(*EXCLUDED_SUFFIXES) & (depth <= 1)).select(
        "root_title", "title", F.lit("root_subdocument_fallback").alias("reason"), F.lit(80).alias("priority"), F.lit(80).alias("score"), F.lit(2**62).alias("pos")
    )
    # only roots whose own page is known have a core
    has_root = roots.select("root_title")
    everything = roots.unionByName(picked).unionByName(fallback).join(has_root, "root_title", "left_semi")
    return first_by(everything, ["root_title", "title"], [-F.col("priority"), F.col("pos")], ["reason", "priority", "score"])


# --- include expansion ----------------------------------------------------------------------------------------------

PARAM_WITH_DEFAULT = r"@([ㄱ-힣A-Za-z0-9_]+)=([^@\n]*)@"
PARAM = r"@([ㄱ-힣A-Za-z0-9_]+)@"


def _substitute(text: Column, params: Column) -> Column:
    """Replace ``@key=default@`` and then ``@key@`` by the last value given for the key."""

    def replace(t: Column, pattern: str, default_group: int | None) -> Column:
        def piece(z: Column) -> Column:
            given = F.get(F.filter(params, lambda x: x["key"] == z["g1"]), F.lit(0))["value"]
            return F.concat(z["piece"], F.coalesce(given, z["g2"] if default_group else F.lit(None).cast("string"), F.lit("")))

        return F.when(t.rlike(pattern), F.array_join(F.transform(woven(t, pattern, *([1, 2] if default_group else [1])), piece), "")).otherwise(t)

    return replace(replace(text, PARAM_WITH_DEFAULT, 2), PARAM, None)


def _is_skipped_template(name: Column, longest: int | None = None) -> Column:
    # Templates that describe the wiki itself and are left out of an expansion.
    listed = r"(?i)^틀:(?:접근 제한|설명문서|문서 가져옴|토론 관련 틀|토론 합의(?:/설명문서)?|다른 뜻|분류 설명|분류 참고|한시적 넘겨주기|상위 문서|하위 문서|관련 문서)$"
    odd = name.rlike(r"[\n\r{}]") | (F.length(name) > longest if longest is not None else F.lit(False)) | name.rlike(r"/설명문서(?:/.*)?$")
    return name.rlike("^틀:") & (odd | name.rlike(listed))


def expand_includes(docs: DataFrame, templates: DataFrame, max_depth: int = 8) -> DataFrame:
    """Texts with their include calls replaced by the template text, parameters filled in.

    ``docs(id, text)``, ``templates(title, text)``. What a call of a document gives depends on the call alone, so each distinct call
    is expanded once, whatever the number of documents that make it, and the documents' pieces are then joined with the results.
    One round expands one level of all calls: calls are joined with the templates, and the inserted text is split at its own
    calls for the next round. A template never expands inside itself. The pieces keep their place in ``ord`` and are put together
    at the end.
    """
    t = first_by(templates.withColumn("name", title_key("title")), ["name"], [F.col("title")], ["text"]).withColumnRenamed("text", "body")
    own = stored(rows_of(docs.where(F.col("text").isNotNull()), ["id"], include_pieces("text"), "piece", "i"), "include-pieces")
    calls = own.where("i % 2 = 1").select("piece").distinct().select(
        F.col("piece").alias("call"), F.array().cast("array<int>").alias("ord"), "piece", F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth")
    )
    done: list[DataFrame] = []
    while True:
        calls = calls.withColumn("_args", F.transform(top_level_parts(F.col("piece")), strip))
        calls = calls.withColumn("name", title_key(F.coalesce(F.get("_args", F.lit(0)), F.lit(""))))
        named = F.filter(rest(F.col("_args")), lambda x: x.contains("="))
        pairs = F.transform(
            named,
            lambda x: F.struct(strip(F.regexp_extract(x, r"(?s)^([^=]*)=", 1)).alias("key"), strip(F.regexp_replace(x, r"(?s)^[^=]*=", "")).alias("value")),
        )
        usable = (F.col("name") != "") & ~_is_skipped_template(F.col("name")) & (F.col("depth") < max_depth) & ~F.array_contains("path", F.col("name"))
        # a later value for the same key wins, so the list is reversed and the first hit taken
        inserted = calls.where(usable).withColumn("_params", F.reverse(pairs)).join(t, "name")
        text = _substitute(F.col("body"), F.col("_params")).alias("text")
        level = cut_lineage(inserted.select("call", "ord", text, F.concat("path", F.array("name")).alias("path"), (F.col("depth") + 1).alias("depth")))
        parts = rows_of(level, ["call", "ord", "path", "depth"], include_pieces("text"), "piece", "i")
        parts = parts.withColumn("ord", F.concat("ord", F.array("i")))
        done.append(parts.where("i % 2 = 0").select("call", "ord", F.col("piece").alias("text")))
        if level.isEmpty():
            break
        calls = parts.where("i % 2 = 1").select("call", "ord", "piece", "path", "depth")

    def joined(place: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "text"))), lambda x: x["text"]), "").alias("text")

    expanded = stored(reduce(DataFrame.unionByName, done).groupBy("call").agg(joined("ord")), "includes")
    filled = own.where("i % 2 = 1").join(expanded, F.col("piece") == F.col("call"), "left").select("id", "i", F.coalesce("text", F.lit("")).alias("text"))
    return own.where("i % 2 = 0").select("id", "i", F.col("piece").alias("text")).unionByName(filled).groupBy("id").agg(joined("i"))
