"""Line dedup by winnowing, in DataFrame functions only.

A run of ``window`` equal lines that stood before (in a document with a smaller id, or earlier in the same document) is
deleted where it is repeated. Each window of ``window`` line hashes gives its least hash as a fingerprint, so every repeated
run shares a fingerprint with its first copy. Fingerprints that occur once are dropped; the others carry the digests of the
windows around them, which extends the match to both sides, and equal digests tell exactly which windows are repeated.

Texts meet the deleted line numbers in one join by document; the fingerprint joins hold a few numbers per line. Hot lines are
aggregated before the shuffle, and the join back to them has one row per fingerprint on one side, so adaptive execution can
split the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import let
from .common import cut_lineage, free_name, text_of

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, digest, removed`` (sorted 0-based line numbers) of each document with lines to delete.

    ``docs(doc_id, text, digest)``. Blank lines are not counted as lines of a run.
    """
    lines = F.filter(F.transform(lines_of(text_of("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda z: F.trim(z["x"]) != "")
    d = docs.select("doc_id", "digest", lines.alias("lines")).where(F.size("lines") >= window)
    d = d.select("doc_id", "digest", F.transform("lines", lambda z: z["i"]).alias("at"),
                 F.transform("lines", lambda z: F.xxhash64(z["x"])).alias("h"),
                 F.transform("lines", lambda z: F.md5(z["x"])).alias("m"))
    starts = F.sequence(F.lit(0), F.size("h") - window)
    # The rightmost least hash of each window; windows that choose the same line give it once.
    chosen = F.transform(starts, lambda s: F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(window - 1)), lambda j: F.struct(F.element_at("h", s + j + 1).alias("h"), (-(s + j)).alias("p")))))
    # The chosen line never moves back, so equal choices are neighbours.
    fresh = lambda cs: F.filter(cs, lambda c, i: (i == 0) | (F.get(cs, i - 1)["p"] != c["p"]))
    d = d.withColumn("chosen", F.transform(let(chosen, fresh), lambda c: F.struct(c["h"].alias("h"), (-c["p"]).alias("p"))))

    def around(p: Column) -> Column:
        first, last = F.greatest(p - window + 1, F.lit(0)), F.least(p, F.size(F.col("h")) - window)
        return F.transform(F.sequence(first, last), lambda s: F.struct(
            s.alias("s"), F.unhex(F.md5(F.array_join(F.slice(F.col("m"), s + 1, window), ""))).alias("w"), F.slice(F.col("at"), s + 1, window).alias("at")))

    d = d.withColumn("prints", F.transform("chosen", lambda c: F.struct(c["h"].alias("h"), around(c["p"]).alias("windows"))))
    prints = d.select("doc_id", "digest", F.explode_outer("prints").alias("f")).select("doc_id", "digest", "f.h", "f.windows")
    shared = cut_lineage(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    windows = prints.join(shared, "h").select("doc_id", "digest", F.explode_outer("windows").alias("x")).select("doc_id", "digest", "x.s", "x.w", "x.at")
    place = F.struct("doc_id", "digest", "s")
    first = windows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("w", "first")
    first = cut_lineage(first)  # a table of its own, so that the join back can split hot keys
    later = windows.join(first, "w").where(place > F.col("first"))
    return later.groupBy("doc_id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("removed"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated runs deleted from the text; two columns follow: ``n_lines`` and ``n_removed``.

    (The two names get a leading underscore while they clash.) A run is ``window`` lines that are not blank, blank lines
    between them aside; blank lines stay. Windows are judged on the input. Documents are ordered by id, null first, and by
    text digest where ids are equal; identical rows are one document and keep the same lines. Null texts stay null and have no
    lines; an empty text has one (blank) line.
    """
    doc, dig, gone = (free_name(docs, n) for n in ("doc_id_", "digest_", "removed_"))
    digest = F.xxhash64(text_of(text_col))
    found = repeated_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest")), window)
    found = found.select(F.col("doc_id").alias(doc), F.col("digest").alias(dig), F.col("removed").alias(gone))
    out = docs.join(found, F.col(id_col).eqNullSafe(found[doc]) & (digest == found[dig]), "left")
    removed = F.col(gone)
    # array_except looks numbers up by their hash
    kept = let(lines_of(F.col(text_col)), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), removed), lambda i: F.get(x, i)))
    text = F.when(removed.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    return out.withColumn(n_lines, F.coalesce(F.size(lines_of(F.col(text_col))), F.lit(0)).cast("long")).withColumn(
        n_removed, F.coalesce(F.size(removed), F.lit(0)).cast("long")).withColumn(text_col, text).drop(doc, dig, gone)
