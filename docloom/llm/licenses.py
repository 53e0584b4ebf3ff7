"""Licence families of paragraphs: a trained classifier, confirmed by templates (DataFrame functions and Spark ML)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.session import materialize

# Usual notices of each family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
}
# Notices that name no known family, for the unknown class.
OTHER_NOTICES = [
    "Licensed under the {0} License.",
    "Released under the {0} Public License, version {1}.",
    "This work is licensed under the terms of the {0} agreement.",
    "Copyright {1} {0}. All rights reserved.",
    "Use of this text is subject to the {0} license terms.",
]
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, UNKNOWN, *TEMPLATES]
# What all ordinary lines together weigh at most in the fit, beside 200 of each class of notices.
ORDINARY = 2000.0
# Steps in which the probabilities of held lines are counted.
STEP = 1e-4


def tokens(text: Column) -> Column:
    """Lower-case letter runs; every number is the word 0."""
    text = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "0"), r"[^\p{L}0]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def grams(words: Column) -> Column:
    """Words and pairs of neighbouring words, each once."""

    def both(w: Column) -> Column:
        pair = F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        return F.array_distinct(F.concat(w, F.slice(pair, 1, F.greatest(F.size(w) - 1, F.lit(0)))))

    return let(words, both)


def _vocabulary(spark: SparkSession) -> list[str]:
    """The n-grams of all notices, in order. Only these tell a notice from other text, so only these are features."""
    table = spark.createDataFrame([(t,) for _, t in _notices()], "notice string")
    return sorted(r[0] for r in table.select(F.explode(grams(tokens(F.col("notice"))))).distinct().collect())


def _templates(spark: SparkSession, words: list[str]) -> Column:
    """The family of each template and the numbers of its n-grams among ``words``."""
    table = spark.createDataFrame([(c, t) for c, texts in TEMPLATES.items() for t in texts], "family string, notice string")
    place = {w: i for i, w in enumerate(words)}
    rows = table.select("family", grams(tokens(F.col("notice"))).alias("grams")).collect()
    # One literal each, as an array of hundreds of literals would be planned slowly.
    numbers = [F.split(F.lit(" ".join(str(place[g]) for g in r["grams"])), " ").cast("array<int>") for r in rows]
    return F.array(*[F.struct(F.lit(r["family"]).alias("family"), n.alias("grams")) for r, n in zip(rows, numbers)])


def _notices() -> list[tuple[str, str]]:
    """(class, notice): those of the templates, and some of families that do not exist."""
    invented = ["Norvand", "Quell Open", "Teralis", "Ostmark Free", "Velum", "Harrow Community", "Pine Shared", "Lumen"]
    notices = [(c, t) for c, texts in TEMPLATES.items() for t in texts]
    return notices + [(UNKNOWN, t.format(name, i + 1)) for t in OTHER_NOTICES for i, name in enumerate(invented)]


def _known(rows: DataFrame, words: list[str]) -> DataFrame:
    """``rows`` with ``grams``, those of ``paragraph``, and ``features``, which of ``words`` are among them."""
    counter = CountVectorizerModel.from_vocabulary(words, "grams", "features", binary=True)
    return counter.transform(rows.withColumn("grams", grams(tokens(F.col("paragraph")))))


def _features(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the vector ``features`` of the word numbers in ``known``."""
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], "_numbers", "features", binary=True)
    return counter.transform(rows.withColumn("_numbers", F.col("known").cast("array<string>"))).drop("_numbers")


def paragraphs(docs: DataFrame, words: list[str]) -> DataFrame:
    """(_row, doc_id, hash, filled, known): every line of every document, written once.

    ``known`` has the numbers of the words that the line has, ``filled`` says
    whether it has any letter or number. The vectors are read back as the
    structure that they are stored as, whose numbers Spark SQL can group by.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    ).select("_row", "doc_id", F.explode_outer(F.split("text", "\n")).alias("paragraph"))
    rows = _known(rows, words).select(
        "_row", "doc_id", F.xxhash64("paragraph").alias("hash"), (F.size("grams") > 0).alias("filled"), "features"
    )
    written = materialize(rows, "licence-paragraphs", "zstd")
    stored = "_row long, doc_id long, hash long, filled boolean, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
    table = docs.sparkSession.read.schema(stored).parquet(written._scratch_path)
    return table.select("_row", "doc_id", "hash", "filled", F.col("features.indices").alias("known"))


def notice_rows(docs: DataFrame, words: list[str], templates: Column) -> DataFrame:
    """(class, known): notices alone, cut, and inside the words of ordinary paragraphs.

    Those words come from four lines, chosen by hash among all lines.
    """
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split("text", "\n")).alias("paragraph")).where(F.length(F.trim("paragraph")) > 0)
    lines = lines.withColumn("_n", F.pmod(F.xxhash64("paragraph"), F.lit(1 << 20))).orderBy("_n", "paragraph").limit(256)
    numbers = F.transform(F.split(F.lit("\n".join(words)), "\n"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    own = grams(tokens(F.col("paragraph")))
    known = let(own, lambda g: F.transform(F.filter(numbers, lambda x: F.array_contains(g, x["w"])), lambda x: x["i"]))
    plain = lines.where(F.size(tokens(F.col("paragraph"))) > 0).where(_similarity(known, templates) < 0.5)
    table = spark.createDataFrame(_notices(), "class string, notice string")
    table = table.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    # A notice alone, cut to its first two thirds, and within the words of ordinary paragraphs.
    frames = plain.groupBy(F.pmod(F.col("_n"), F.lit(4)).alias("_k")).agg(
        F.split(F.min(F.struct("_n", "paragraph"))["paragraph"], " ").alias("_w")
    )
    words_of = F.split("notice", " ")
    part = F.greatest(F.lit(3), F.floor(F.size(words_of) * 2 / 3).cast("int"))
    joined = table.join(frames, "_k", "left").withColumn("_w", F.coalesce("_w", F.array().cast("array<string>")))
    around = lambda a, b: F.concat_ws(" ", F.slice("_w", a, 4), F.col("notice"), F.slice("_w", b, 4))
    positive = joined.select(
        F.col("class"),
        F.when(F.col("_k") == 4, F.col("notice"))
        .when(F.col("_k") == 5, F.concat_ws(" ", F.slice(words_of, F.lit(1), part)))
        .otherwise(around(1, 5)).alias("paragraph"),
    )
    return positive.select("class", known.alias("known"))


def training_rows(lines: DataFrame, notices: DataFrame, templates: Column) -> DataFrame:
    """(class, known, held, n, label): the notices, and all ordinary lines of all documents, each text once.

    Lines that share most words with a notice are left out. Equal rows are
    one with their number ``n``; ``held`` marks a quarter of the ordinary lines, by hash.
    """
    plain = lines.where("filled").where(_similarity(F.col("known"), templates) < 0.5)
    held = F.pmod(F.xxhash64("hash", F.lit(7)), F.lit(4)) == 0
    plain = plain.select("hash", "known").distinct().groupBy(held.alias("held"), "known").agg(F.count(F.lit(1)).alias("n"))
    negative = plain.select(F.lit(NONE).alias("class"), "known", "held", "n")
    rows = notices.select("class", "known", F.lit(False).alias("held"), F.lit(1).cast("long").alias("n")).unionByName(negative)
    label = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (c, float(i))]), F.col("class"))
    return rows.withColumn("label", label)


def _similarity(own: Column, templates: Column, family: Column | None = None) -> Column:
    """The largest share of a template's n-grams that are in ``own``, by number (of one family, or of any)."""

    def best(own: Column) -> Column:
        mine = templates if family is None else F.filter(templates, lambda x: x["family"] == family)
        return F.array_max(F.transform(mine, lambda x: F.size(F.array_intersect(x["grams"], own)) / F.size(x["grams"])))

    return let(own, best)


def _scored(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    model = model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_class")
    return model.transform(_features(rows, model.numFeatures)).withColumn("_p", vector_to_array("_probability"))


def train(
    lines: DataFrame, notices: DataFrame, words: list[str], templates: Column, false_alarm: float = 0.001
) -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the smallest licence probability that counts.

    Fitted on three quarters of all ordinary lines, which weigh at most
    ``ORDINARY`` together, and all notices. The probability is calibrated on
    the other quarter, in steps of ``STEP``: at most ``false_alarm`` of its
    lines lie above, and never less than one half.
    """
    rows = materialize(training_rows(lines, notices, templates), "licence-training")
    size = rows.where("NOT held").groupBy("class").agg(F.sum("n").alias("count"))
    each = F.when(F.col("class") == NONE, F.least(F.lit(1.0), F.lit(ORDINARY) / F.col("count"))).otherwise(200.0 / F.col("count"))
    weighted = rows.where("NOT held").join(F.broadcast(size), "class").withColumn("weight", F.col("n") * each)
    learner = LogisticRegression(maxIter=60, regParam=0.002, weightCol="weight", family="multinomial")
    model = learner.fit(_features(weighted, len(words)))
    outside = _scored(rows.where("held"), model).select(F.ceil((1 - F.get("_p", F.lit(0))) / STEP).alias("step"), "n")
    steps = outside.groupBy("step").agg(F.sum("n").alias("n"))
    limit = steps.agg(F.percentile(F.col("step") * STEP, F.lit(1 - false_alarm), F.col("n"))).first()[0]
    return model, max(0.5, limit or 0.5)


def scan_licenses(docs: DataFrame, confirm: float = 0.6) -> DataFrame:
    """Licence of each document: doc_id, license, licenses, n_paragraphs, n_license_paragraphs, confidence.

    Every paragraph (line) is classified by multinomial logistic regression
    over those of its word n-grams that are in a notice, fitted on all lines of
    all documents (``train``). One whose probability of being a notice is above
    the calibrated limit gets the most likely family, if it also has ``confirm``
    of the n-grams of one of that family's templates; else it is ``unknown``.
    ``license`` is the family of the surest confirmed paragraph, ``unknown``
    when none is confirmed, ``none`` without notices. ``licenses`` lists all.

    Null and empty texts have no paragraphs and no licence. Repeated rows and
    rows without id are scanned each for itself; ties go to the family that
    sorts first. An empty table gives no rows; further columns are ignored.
    """
    words = _vocabulary(docs.sparkSession)
    lines = paragraphs(docs, words)
    templates = _templates(docs.sparkSession, words)
    model, limit = train(lines, notice_rows(docs, words, templates), words, templates)
    scored = _scored(lines, model)
    sureness = 1 - F.get("_p", F.lit(0))
    notice = F.col("filled") & (sureness >= limit)
    families = F.slice("_p", 2, len(CLASSES) - 1)
    likely = F.array_position(families, F.array_max(families)).cast("int")
    family = F.element_at(F.array(*[F.lit(c) for c in CLASSES[1:]]), likely)
    found = scored.select(
        "_row", "doc_id", "known", "filled", F.when(notice, family).alias("_family"), sureness.alias("_sure")
    )
    named = F.col("_family").isNotNull()
    similar = _similarity(F.col("known"), templates, F.col("_family")) >= confirm
    confirmed = F.coalesce(F.when(named & (F.col("_family") != UNKNOWN), similar), F.lit(False))
    found = found.withColumn(
        "_license", F.when(named, F.when(confirmed, F.col("_family")).otherwise(UNKNOWN))
    )
    # Confirmed before unknown, then the surest, then the name that sorts first.
    last = F.lit(len(CLASSES)) - F.array_position(F.array(*[F.lit(c) for c in sorted(CLASSES)]), F.col("_license"))
    rank = F.struct(
        (F.col("_license") != UNKNOWN).alias("known"), F.col("_sure").alias("sure"),
        last.alias("last"), F.col("_license").alias("license"),
    )
    rank = F.when(F.col("_license").isNotNull(), rank)
    out = found.groupBy("_row", "doc_id").agg(
        F.count(F.when(F.col("filled"), 1)).alias("n_paragraphs"),
        F.count("_license").alias("n_license_paragraphs"),
        F.sort_array(F.collect_set("_license")).alias("licenses"),
        F.max(rank).alias("_best"),
    )
    return out.select(
        "doc_id", F.coalesce("_best.license", F.lit(NONE)).alias("license"), "licenses", "n_paragraphs",
        "n_license_paragraphs", F.col("_best.sure").alias("confidence"),
    )
