"""Licence scan: a trained paragraph classifier, confirmed by templates."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

UNKNOWN = "unknown"
#: Short public notices of each family (fixed values).
TEMPLATES = {
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
#: Sentences with the same words that state no licence.
OTHERS = (
    "The driver lost the licence after the second offence.",
    "The results were released under pressure from the general public.",
    "An Apache helicopter landed near the work site.",
    "The new version of this work is under review.",
    "Students of the university have permission to use the source.",
    "Any person may obtain a copy of the map free of charge.",
    "The terms of the public contract are subject to change.",
    "The foundation published the program in March.",
    "The use of the file is permitted in the following form.",
)
#: Words before which a denial stands, what denies, and what reports a notice instead of giving it.
STATING = ("licensed", "released", "dedicated", "permitted", "subject", "granted", "made", "free")
DENIALS = ("not", "never", "no longer", "not yet", "neither")
REPORTS = (
    ("The article compares notices such as", "with older ones."),
    ("The historian says that in 1992 the author wrote a driver that was", "as others were."),
    ("The author", "a driver in 1992, says the historian."),
    ("He moved to other works;", "of art and music, as critics wrote."),
    ("The court asked whether the program was", "or under some other terms."),
    ("It is said to be", "but nobody could show it."),
    ("Should it be", "then the rules of the contract would change."),
    ("Unlike what was", "these files are closed and all rights are reserved."),
)
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))
#: Variants of each template; as how many lines, at most, the lines of all documents weigh together.
VARIANTS, PARAGRAPHS = 32, 4_000
#: Share of held-out lines of documents that the threshold may let through.
FALSE_RATE = 0.0005
#: Share of held-out denials and reports that it may let through.
HARD_RATE = 0.05
#: Least share of a template's words that a paragraph must hold to confirm its family.
CONFIRM = 0.6
#: Words of the longest template: a notice of one that starts in a line ends within so many words after it.
LONGEST = max(len(re.findall(r"[^\W_]+", t)) for ts in TEMPLATES.values() for t in ts)
#: Words that no gate is made of while a template has others.
PLAIN = "a an and any are as at be by for free from in is it may not of on or that the this to under use version with works you".split()


class Model(NamedTuple):
    #: n-gram, and its weight in each of FAMILIES
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table out of values in the program."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    pairs = F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)), lambda p: F.contains(p, F.lit(" ")))
    return F.array_distinct(F.concat(words, pairs))


def _gate() -> str:
    """A pattern of lower-case text without which no template can be confirmed: text that holds a share
    of CONFIRM of a template's words has one of any so many of them that too few are left. Those are the
    longest words, and plain ones last."""
    found: dict[str, set[str]] = {}
    for words in map(_template_words, (t for ts in TEMPLATES.values() for t in ts)):
        least = next(n for n in range(len(words) + 1) if n / len(words) >= CONFIRM)
        for w in sorted(words, key=lambda w: (w in PLAIN or len(w) == 1, -len(w), w))[: len(words) - least + 1]:
            found.setdefault(w[0], set()).add(w[1:])
    first = "|".join(f"{c}(?:{'|'.join(sorted(map(re.escape, ends)))})" for c, ends in sorted(found.items()))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{first})(?![\p{{L}}\p{{N}}])"


def _template_words(template: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", template.lower())))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraphs: id, version (of the text), place, block (neighbouring lines up to one without a
    letter or digit)."""
    key = [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version")]
    return docs.select(*key, F.posexplode(F.split(F.col(text_col), r"\n(?:[^\p{L}\p{N}\n]*\n)+")).alias("place", "block"))


def _runs(blocks: DataFrame) -> DataFrame:
    """Each line by itself, and with the LONGEST words that follow it in its block if it isn't the
    last: id, version, place, start (line in the block), run, text, words."""
    lines = F.split("block", "\n")
    one = lambda x, i, all_lines: F.struct(i.alias("start"), F.lit(False).alias("run"), x.alias("text"), F.lit("").alias("after"))
    more = lambda x, i, all_lines: F.struct(i.alias("start"), F.lit(True).alias("run"), x.alias("text"), F.array_join(F.slice(all_lines, i + 2, LONGEST), "\n").alias("after"))
    blocks = blocks.withColumn("_lines", lines)
    each = F.concat(F.transform("_lines", lambda x, i: one(x, i, F.col("_lines"))), F.filter(F.transform("_lines", lambda x, i: more(x, i, F.col("_lines"))), lambda r: r["after"] != ""))
    rows = blocks.select("id", "version", "place", F.explode(each).alias("r")).select("id", "version", "place", "r.*")
    whole = tokens(F.concat_ws("\n", "text", "after"))
    rows = rows.withColumn("words", F.when(F.col("run"), F.slice(whole, 1, F.size(tokens(F.col("text"))) + LONGEST)).otherwise(tokens(F.col("text"))))
    return rows.withColumn("text", F.when(F.col("run"), F.concat_ws("\n", "text", "after")).otherwise(F.col("text"))).drop("after")


def denied(template: str) -> list[str]:
    """The template with each denial before the first word that states it."""
    words = template.split(" ")
    at = next((i for i, w in enumerate(words) if w.lower().strip(",.:;") in STATING), None)
    return [] if at is None else [" ".join([*words[:at], d, *words[at:]]) for d in DENIALS]


def reported(template: str) -> list[str]:
    """The template in sentences that tell of it."""
    inner = template.rstrip(".")
    return [f"{before} {inner[:1].lower()}{inner[1:]} {after}" for before, after in REPORTS]


def _own_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k (a digest of its place), line of every line of the documents that holds a letter or digit."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("place", "line"))
    return lines.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select(F.xxhash64("id", "place").alias("k"), "line")


def train_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Sparse multinomial logistic regression on words and word pairs.

    Licence paragraphs are variants of TEMPLATES: some words left out, some with a neighbouring
    sentence; "unknown" is variants of OTHERS, which have a licence's words, denials and reports of
    templates, which a template would confirm, and all lines of all documents that pass the scan's gate
    and that no template confirms. Lines that fail the gate are never scored, so the classifier has
    nothing to learn of them, and the scan lets none through: that is how they count for the threshold.
    The lines of documents weigh together as PARAGRAPHS lines at most, so that the licences' share does
    not fall with the documents' number. A fifth is held out to set the threshold, by lines of documents
    and by denials and reports.
    """
    spark = docs.sparkSession
    fits = lambda c: F.lower(c).rlike(_gate())
    own = _own_lines(docs.where(fits(F.col(text_col))), id_col, text_col).where(fits(F.col("line"))).select(tokens(F.col("line")).alias("w"), "k")
    own = own.where(F.array_max(_template_shares(F.col("w"))) < CONFIRM)
    named = [{"label": FAMILIES.index(f), "text": t} for f in TEMPLATES for t in TEMPLATES[f]] + [{"label": 0, "text": t} for t in OTHERS]
    hard = [{"label": 0, "text": x} for ts in TEMPLATES.values() for t in ts if not t.startswith("SPDX") for x in denied(t) + reported(t)]
    base = _table(spark, named, "label double, text string").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    word = tokens(F.col("text"))
    base = base.withColumn("w", word).withColumn("w", F.when(F.col("variant") == 0, F.col("w")).otherwise(F.filter("w", lambda x, i: F.pmod(F.xxhash64(x, i, "variant"), F.lit(8)) > 0)))
    spare = tokens(F.lit("and in that place the story goes on for a while with other words about work and use of things"))
    base = base.withColumn("w", F.when(F.pmod("variant", F.lit(3)) == 2, F.concat("w", F.slice(spare, F.pmod("variant", F.lit(9)) + 1, F.lit(8)))).otherwise(F.col("w")))
    # words of denials and reports all stay, as without them they state a licence
    told = _table(spark, hard, "label double, text string").select("label", tokens(F.col("text")).alias("w"), F.xxhash64("text").alias("k"))
    made = base.select("label", "w", F.xxhash64("text", "variant").alias("k"), F.lit("made").alias("kind")).union(told.withColumn("kind", F.lit("hard")))
    apart = lambda rows: rows.select("label", "kind", ngrams(F.col("w")).alias("grams"), _held().alias("held"))
    made = materialise(apart(made))
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 13, minDF=3.0).fit(made.where("not held"))
    own = apart(own.select(F.lit(0.0).alias("label"), "w", "k", F.lit("own").alias("kind")))
    learned = materialise(counts.transform(made.union(own)).drop("grams"))
    n_own = learned.where("kind = 'own' and not held").count()
    weight = F.when(F.col("kind") == "own", F.lit(min(1.0, PARAGRAPHS / max(n_own, 1)))).otherwise(F.lit(1.0))
    lr = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.3, maxIter=60, standardization=False, weightCol="weight").fit(learned.where("not held").withColumn("weight", weight))
    # probability of "unknown" at the quantiles of held-out lines
    p = F.get(F.expr("from_json(to_json(struct(probability)), 'probability struct<values array<double>>').probability.values"), F.lit(0))
    held = lr.transform(learned.where("held and label = 0")).select("kind", p.alias("p"))
    n_held = _own_lines(docs, id_col, text_col).where(_held()).count()
    cuts = [_low_quantile(held.where("kind = 'own'"), n_held), held.where("kind = 'hard'").agg(F.percentile("p", F.lit(HARD_RATE))).first()[0]]
    matrix = lr.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(counts.vocabulary) if abs(matrix[:, i]).max() > 1e-9}
    return Model(weights, [float(x) for x in lr.interceptVector], max(0.5, *(1 - c for c in cuts if c is not None)))


def _held() -> Column:
    """Whether a line, by its digest k, is of the fifth that is held out."""
    return F.pmod("k", F.lit(5)) == 4


def _low_quantile(held: DataFrame, n: int) -> float | None:
    """The quantile FALSE_RATE of p in held and as many ones as make n rows of it; none of no rows."""
    if not n:
        return None
    low, part = divmod(FALSE_RATE * (n - 1), 1)
    found = [r[0] for r in held.select("p").orderBy("p").offset(int(low)).limit(2).collect()]
    a, b = (found + [1.0, 1.0])[:2]
    return a + part * (b - a)


def _template_shares(words: Column) -> Column:
    """For each family the largest share of a template's words that the words hold."""
    shares = []
    for family in FAMILIES[1:]:
        sets = [_template_words(t) for t in TEMPLATES[family]]
        each = [F.size(F.array_intersect(words, F.array(*map(F.lit, s)))) / len(s) for s in sets]
        shares.append(F.greatest(*each))
    return F.array(*shares)


def scan_licences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statements of a licence: id, version (a digest of the text it stands in), place (paragraph),
    start (its line), line (its text, of several lines if they are wrapped), family, probability,
    template_share.

    Looked at are lines and, so that wrapped notices are whole, runs of neighbouring lines of a
    paragraph. What no template confirms can't be the answer, whatever its probability, so texts, then
    paragraphs, then lines go that hold too few words of any template: only what is left is written
    and scored, by a join of its n-grams with the weights, whose number the classifier's vocabulary
    bounds. A family is given if it is the most likely (the first by name of equals), 1 - P(unknown)
    reaches the calibrated threshold, and a template of the family confirms it. Hits of one family that
    start in neighbouring lines are its single lines, or one statement if only runs are hits. Repeated
    rows state the same; rows of one id with different texts are scored by themselves. Rows
    without an id are left out. An id column of one of the names above keeps it, and the other column gets an underscore.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.lower("text").rlike(_gate()))
    blocks = _blocks(texts, "id", "text").where(F.lower("block").rlike(_gate()))
    blocks = blocks.where(F.array_max(_template_shares(tokens(F.col("block")))) >= CONFIRM)
    found = _runs(blocks).withColumn("_shares", _template_shares(F.col("words"))).where(F.array_max("_shares") >= CONFIRM)
    found = materialise(found.dropDuplicates(["id", "version", "place", "start", "run"]))
    weights = _table(spark, [{"gram": g, "w": w} for g, w in model.weights.items()], "gram string, w array<double>")
    key = ["id", "version", "place", "start", "run"]
    grams = found.select(*key, F.explode(ngrams(F.col("words"))).alias("gram"))
    sums = grams.join(F.broadcast(weights), "gram").groupBy(*key).agg(*(F.sum(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(len(FAMILIES))))
    margin = F.array(*((F.coalesce(f"m{i}", F.lit(0.0)) + b).alias(f"m{i}") for i, b in enumerate(model.bias)))
    e = F.transform(margin, lambda m: F.exp(m - F.array_max(margin)))
    sums = sums.withColumn("_e", e).withColumn("_p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
    best = sums.withColumn("_best", F.array_max(F.slice("_p", 2, len(FAMILIES)))).select(*key, F.col("_best").alias("probability"), (1 - F.get("_p", F.lit(0))).alias("licence"), F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("_p", F.col("_best")).cast("int")).alias("family"))
    best = best.where(F.col("licence") >= model.threshold)
    share = F.get("_shares", F.array_position(F.array(*map(F.lit, FAMILIES[1:])), F.col("family")).cast("int") - 1)
    hits = found.join(best, key).withColumn("template_share", share).where(F.col("template_share") >= CONFIRM)
    in_order = Window.partitionBy("id", "version", "place", "family").orderBy("start", "run")
    hits = hits.withColumn("_new", (F.col("start") - F.coalesce(F.lag("start").over(in_order), F.lit(-2)) > 1).cast("int")).withColumn("_island", F.sum("_new").over(in_order))
    near = Window.partitionBy("id", "version", "place", "family", "_island")
    hits = hits.withColumn("_lines", F.sum((~F.col("run")).cast("int")).over(near)).withColumn("_rank", F.row_number().over(near.orderBy(F.col("template_share").desc(), F.col("start").desc())))
    hits = hits.where(~F.col("run") | (F.col("_lines") == 0) & (F.col("_rank") == 1))
    apart = lambda c: c + "_" if c == id_col.lower() else c
    return hits.select(F.col("id").alias(id_col), *(F.col(c).alias(apart(n)) for c, n in (("version", "version"), ("place", "place"), ("start", "start"), ("text", "line"), ("family", "family"), ("probability", "probability"), ("template_share", "template_share"))))


def licences_of_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_licences long (paragraphs), families (distinct, by name, joined by a
    comma; empty if none), probability (of the likeliest; null if none).

    Null or empty text: none; texts may be of any length. Rows of one id are one document, whose
    statements are those of its different texts, so a repeated row changes nothing; null ids are left
    out. An empty table gives none; other columns are ignored.
    """
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    hits = scan_licences(known, model, "_doc", "_text")
    by_doc = hits.groupBy("_doc").agg(F.count(F.lit(1)).alias("n_licences"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability"))
    return known.select("_doc").distinct().join(by_doc, "_doc", "left").select(F.col("_doc").alias(id_col), F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"), "probability")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licences_of_documents(docs, train_licences(docs))
