"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Tokens have one global order, by the number of documents that hold them, rarest first. A template of ``n`` distinct tokens
and containment ``c`` needs ``a = ceil(c * n)`` common tokens, so a matching block shares one of the template's first
``n - a + 1`` tokens (prefix filter), has at least ``a`` template tokens (length filter), and its first common token leaves
enough tokens on both sides (positional filter). Survivors are counted exactly. The templates are a short fixed parameter,
so only they are broadcast; texts are never shuffled.

A block is ``2 * stride`` words, one begins every ``stride`` words, and the stride is not below the longest template: every
stretch as long as a template lies whole in a block, and each start belongs to exactly one block.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``phrase``: only places where the words stand consecutively count; else a block that holds enough of them does."""

    label: str
    text: str
    containment: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, self.text.lower()) if w]

    @property
    def needed(self) -> int:
        return math.ceil(round(self.containment * len(set(self.words)), 9))


#: Fixed phrases and sentences of well-known licenses.
BASE = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)
SENTENCES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "licensed under a creative commons attribution license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("proprietary", "all rights reserved do not distribute", 1.0),
)


def words_of(text: Column) -> Column:
    """Lower-cases A-Z only and cuts into runs of digits, letters and non-ASCII characters."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def token_order(docs: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """The templates' tokens, rarest first, by the documents of the whole table that hold them; ties by name."""
    vocab = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(words_of(text_of("text")), F.array(*map(F.lit, vocab)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # at most one row per template token
    seen = {r["w"]: r["count"] for r in rows}
    return sorted(vocab, key=lambda w: (seen.get(w, 0), w))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, hits``.

    ``hits``: an array of ``(template, label, containment, block, places)``, one for each template and block that match;
    ``places`` are the word positions where a phrase stands (empty for sentences, and the hit is then the block from word
    ``block`` on). Null and empty texts have no words and no hits; repeated rows each give a row; an empty table gives none.
    """
    docs = document(docs, id_col, text_col)
    order = token_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    stride = max(32, *(len(t.words) for t in templates))
    least = min(t.needed for t in templates)
    index, entry_tokens = [], set()
    for i, t in enumerate(templates):
        ranks = sorted(rank[w] for w in set(t.words))
        entry_tokens.update(ranks[:len(ranks) - t.needed + 1])
        index += [(r, i, t.label, t.phrase, t.words, ranks, at, t.needed) for at, r in enumerate(ranks[:len(ranks) - t.needed + 1])]
    spark = docs.sparkSession
    index = spark.createDataFrame(index, "token int, template int, label string, phrase boolean, t_words array<string>, t_ranks array<int>, t_at int, needed int")

    entries = F.array(*(F.lit(order[r]) for r in sorted(entry_tokens)))
    to_rank = F.create_map(*(F.lit(x) for w, r in rank.items() for x in (w, r)))
    vocab = F.array(*map(F.lit, order))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(text_of("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(stride)),
                         lambda s: F.struct(s.alias("start"), F.slice(F.col("words"), s + 1, 2 * stride).alias("w")))
    blocks = F.filter(blocks, lambda b: F.arrays_overlap(b["w"], entries))
    rows = rows.select("row", "doc_id", "n_words", F.explode_outer(blocks).alias("b"))
    ranks = F.array_sort(F.transform(F.array_intersect(F.col("b.w"), vocab), lambda w: F.element_at(to_rank, w)))
    rows = rows.withColumn("ranks", ranks)
    prefix = F.slice("ranks", F.lit(1), F.greatest(F.size("ranks") - least + 1, F.lit(0)))
    rows = rows.select("*", F.posexplode_outer(prefix).alias("at", "token"))

    fits = (
        (rows["token"] == index["token"])
        & (F.size(rows["ranks"]) >= index["needed"])
        & (F.least(F.size(rows["ranks"]) - rows["at"], F.size(index["t_ranks"]) - index["t_at"]) >= index["needed"])
    )
    pairs = rows.join(F.broadcast(index), fits, "left").drop(index["token"])
    common = F.array_intersect("ranks", "t_ranks")
    pairs = pairs.withColumn("common", common)
    # A pair can meet at several prefix tokens; its first common token speaks for it.
    found = (F.size("common") >= F.col("needed")) & (F.col("common")[0] == F.col("token"))
    places = F.when(F.col("phrase"), F.transform(
        F.filter(F.sequence(F.lit(0), F.least(F.lit(stride), F.size("b.w")) - 1), lambda p: F.slice(F.col("b.w"), p + 1, F.size("t_words")) == F.col("t_words")),
        lambda p: (p + F.col("b.start")).cast("long"),
    )).otherwise(F.array().cast("array<bigint>"))
    pairs = pairs.withColumn("places", F.when(found, places))
    hit = F.when(found & (~F.col("phrase") | (F.size("places") > 0)), F.struct(
        "template", "label", (F.size("common") / F.size("t_ranks")).alias("containment"), F.col("b.start").cast("long").alias("block"), "places"))
    return pairs.groupBy("row", "doc_id", "n_words").agg(F.collect_list(hit).alias("hits")).drop("row")


def license_summary(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; score: the greatest containment of a hit."""
    base = F.filter("hits", lambda h: h["template"] < len(BASE))
    starts = F.flatten(F.transform(base, lambda h: h["places"]))
    out = license_scan(docs, BASE + SENTENCES, **columns).withColumn("starts", starts)

    def names(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("score"),
    )
