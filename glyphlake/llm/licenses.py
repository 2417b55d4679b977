"""Licence scan: a positional index of rare licence words, aligned postings, mandatory key phrases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import ascii_lower, let, stored, text_of

#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Licence wordings, and the phrases of which a text must hold one for the label (fixed values); the label is the first word of a name.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "mit license"),
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        ("apache license", "www apache org licenses"),
    ),
    "gpl": (
        "licensed under the gnu general public license version 3 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "general public license"),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ("lesser general public license", "library general public license"),
    ),
    "agpl": ("under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms",),
    ),
    "bsd short": ("this software is licensed under the bsd license", ("bsd license",)),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which is available at www eclipse org legal epl 2 0", ("eclipse public license",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software",)),
    "isc short": ("this software is licensed under the isc license", ("isc license",)),
    "cc": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution", "creative commons license", "creative commons zero")),
    "cc short": ("this work is licensed under cc by nc 4 0", ("cc by",)),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    "boost": ("distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt", ("boost software license",)),
}
#: Words of each template that are in the index: those of highest IDF over the scanned documents.
RAREST = 16
#: Share of the weight of a template's indexed words that must align at one place of a file.
LEAST_SHARE = 0.5
#: Places may drift by less than twice this many words (an inserted name, a line number).
DRIFT = 4
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """Words of the lower-cased text with one blank around each; '' if there are none."""
    words = F.trim(F.regexp_replace(ascii_lower(text), WORD_GAP, " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(f" {p} ")
    return found


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    first, *rest = phrase.split(" ")

    def starts(w: Column, i: Column) -> Column:
        same = w == first
        for k, r in enumerate(rest, 1):
            same = same & F.get(words, i + k).eqNullSafe(F.lit(r))
        return F.when(same, i)

    return F.filter(F.transform(words, starts), lambda x: x.isNotNull())


def licence_words() -> list[str]:
    """Words of the templates that may be indexed."""
    return sorted({w for text, _ in TEMPLATES.values() for w in text.split() if len(w) > 1 and w.isalpha()})


def positional_index(total: int, counts: dict[str, int], rarest: int = RAREST) -> list[tuple[str, str, int, float]]:
    """(word, template, place, weight) of each template's ``rarest`` words by IDF; a template's weights sum to 1."""
    idf = {w: math.log(1 + (total + 1) / (counts.get(w, 0) + 0.5)) for w in licence_words()}
    index = []
    for name, (text, _) in TEMPLATES.items():
        words = text.split()
        chosen = sorted({w for w in words if w in idf}, key=lambda w: (-idf[w], w))[:rarest]
        whole = sum(idf[w] for w in chosen)
        index += [(w, name, i, idf[w] / whole) for i, w in enumerate(words) if w in chosen]
    return index


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Document frequencies of the licence words are counted over all documents, and each template's RAREST words of
    highest IDF are indexed with their places. Every file is looked up in that index first: each indexed word in it votes
    for (template, place in the file - place in the template), and the share of a template is the most weight of
    its indexed words that vote alike, within DRIFT words. (Places are kept for files whose
    indexed words have that share of some template at all.) Templates with ``least_share`` of their whole weight
    are then verified: the file must hold one of the template's mandatory phrases. A phrase alone gives no label,
    but the base phrases do by contract. ``score`` is 1 with a base phrase, else the best share of a verified template, else 0.

    Null text counts as empty: no words, labels '' and score 0. Texts of any length are read whole. Null ids, repeated rows and
    equal texts stay rows of their own. Extra columns are left out, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    spaced = docs.select(F.col(id_col).alias("doc_id"), spaced_words(text_of(text_col)).alias("t"))
    seen = spaced.select(F.explode(F.array_intersect(F.split("t", " "), F.array(*map(F.lit, licence_words())))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # licence words only
    index = positional_index(docs.count(), counts)
    indexed = sorted({w for w, *_ in index})
    weights = {name: {w: weight for w, n, _, weight in index if n == name} for name in TEMPLATES}
    sets = F.array(*[F.struct(F.array(*map(F.lit, own)).alias("words"), F.array(*map(F.lit, own.values())).alias("weights")) for own in weights.values()])

    def may_match(present: Column) -> Column:
        """Whether the indexed words of a file, wherever they stand, have the least share of some template."""
        held = lambda t: F.zip_with(t["words"], t["weights"], lambda w, x: F.when(F.array_contains(present, w), x).otherwise(0.0))
        return F.exists(sets, lambda t: F.aggregate(held(t), F.lit(0.0), lambda a, x: a + x) >= least_share - 1e-6)

    def per_text(t: Column) -> Column:
        def fields(w: Column) -> Column:
            base = {p: F.when(t.contains(f" {p} "), _places(w, p)).otherwise(F.array().cast("array<int>")) for p in BASE}
            placed = F.filter(F.transform(w, lambda x, i: F.when(x.isin(indexed), F.struct(x.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.array_sort(F.flatten(F.array(*base.values()))).alias("at"),
                F.filter(F.array(*[F.when(F.size(base[p]) > 0, F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull()).alias("base"),
                F.when(let(F.array_intersect(w, F.array(*map(F.lit, indexed))), may_match), placed).alias("hits"),
            )

        def verified(s: Column) -> Column:
            # Phrases are searched only in files that the index has found something in.
            phrases = F.filter(F.array(*[F.when(_any(t, keys), F.lit(name)) for name, (_, keys) in TEMPLATES.items()]), lambda x: x.isNotNull())
            names = ["n_words", "at", "base", "hits"]
            return F.struct(*[s[k].alias(k) for k in names], F.when(F.size(s["hits"]) > 0, phrases).alias("phrases"))

        array = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(t), " "))
        return let(let(array, fields), verified)

    rows = spaced.select("doc_id", F.monotonically_increasing_id().alias("row"), let(F.col("t"), per_text).alias("s")).select("doc_id", "row", "s.*")
    rows = stored(rows, "licence_words")
    postings = F.broadcast(_table(spark, index, ["word", "template", "place", "weight"]))  # words of the templates
    hits = rows.where("hits IS NOT NULL").select("row", F.inline("hits"))
    votes = hits.join(postings, "word").select("row", "template", "word", "weight", F.floor((F.col("i") - F.col("place")) / DRIFT).alias("shift"))
    # A shift lies in its own cell and the next, so that votes on both sides of a cell's edge meet.
    cells = votes.select("row", "template", "word", "weight", F.explode(F.array("shift", F.col("shift") + 1)).alias("cell")).distinct()
    aligned = cells.groupBy("row", "template", "cell").agg(F.sum("weight").alias("share")).groupBy("row", "template").agg(F.max("share").alias("share"))
    aligned = aligned.withColumn("share", F.least(F.lit(1.0), F.round("share", 6))).where(F.col("share") >= least_share)
    found = rows.where("hits IS NOT NULL").select("row", F.explode("phrases").alias("template"))
    matches = aligned.join(found.hint("merge"), ["row", "template"]).groupBy("row").agg(F.collect_set(F.substring_index("template", " ", 1)).alias("found"), F.max("share").alias("best"))  # at most one label a template
    out = rows.drop("hits", "phrases").join(matches.hint("merge"), "row", "left")
    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.element_at("at", F.when(F.size("at") > 0, 1).otherwise(None)).cast("long").alias("first_word"),
        F.element_at("at", F.when(F.size("at") > 0, -1).otherwise(None)).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
