"""Licence scan by diagonal voting, in DataFrame operations only.

All rolling hashes of ``GRAM`` words of all texts are joined to the places of the same
hashes in licence templates.  A match votes for the diagonal ``text place - template
place`` of its template; diagonals a few words apart are merged, so that inserted or
dropped words don't break a span, and a merged span is verified by the share of
distinct template places that it holds and by its length.

The templates are constants of this module, so broadcasting their grams is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import materialise

GRAM = 3
MAX_SHIFT = 4
MIN_SHARE = 0.6
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Openings of public licences and usual notices, as words.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under cc by nc 4 0", "cc-by-nc"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


def _words(text: Column) -> Column:
    # lower() makes an ASCII letter of one other sign only, the Kelvin sign, so that is hidden from it; it changes no word's bounds.
    # Splitting at single blanks is far cheaper than matching the words by pattern.
    blank = F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9"))), BETWEEN, " "))
    return F.filter(F.split(blank, " "), lambda w: w != "")


def _with_grams(table: DataFrame, words: Column, *keep: Column | str) -> DataFrame:
    """``keep``, ``_n_words``, and ``_grams``, the hashes of all runs of GRAM words."""
    # Exploding an array of one makes the hashes a column, which the lambda below reads by place;
    # as an expression they would be computed anew for each element.
    hashed = table.select(*keep, F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("_hashed"))
    runs = F.slice("_hashed", 1, F.greatest(F.size("_hashed") - (GRAM - 1), F.lit(0)))
    grams = F.transform(runs, lambda h, i: F.xxhash64(h, *[F.get("_hashed", i + j) for j in range(1, GRAM)]))
    return hashed.select("*", F.size("_hashed").alias("_n_words"), grams.alias("_grams")).drop("_hashed")


def template_grams(spark: SparkSession) -> DataFrame:
    """``(gram, template, label, phrase, place, grams)`` of all phrases and templates."""
    rows = [(i, words, label, i < len(PHRASES)) for i, (words, label) in enumerate((*PHRASES, *TEMPLATES))]
    table = _with_grams(spark.createDataFrame(rows, "template int, words string, label string, phrase boolean"), F.split("words", " "), "template", "label", "phrase")
    return table.select("template", "label", "phrase", F.size("_grams").alias("grams"), F.posexplode("_grams").alias("place", "gram"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``; ``spans`` are the verified ones (label, first word,
    words, share of the template held).

    Null and empty texts have no words, no places and score 0.  Texts under GRAM words match
    nothing.  Rows with the same id and text are scanned once and each returned.  A null id is kept as is.  Columns other than
    id and text are not read.
    """
    key = [F.col(id_col).alias("_lic_id"), F.xxhash64(F.col(text_col)).alias("_lic_text")]
    # Besides its grams each text sends a row without one, which counts its words, so that texts are read once.
    grams = _with_grams(docs, _words(F.col(text_col)), *key).select("_lic_id", "_lic_text", "_n_words", F.posexplode(F.concat("_grams", F.array(F.lit(None).cast("long")))).alias("_at", "gram"))
    votes = grams.join(F.broadcast(template_grams(docs.sparkSession)), "gram", "left").where("template IS NOT NULL OR gram IS NULL").withColumn("diagonal", F.when(F.col("gram").isNotNull(), F.col("_at") - F.col("place")))
    own = ["_lic_id", "_lic_text", "template", "label", "phrase", "grams"]
    found = votes.groupBy(*own, "diagonal").agg(F.collect_set("place").alias("places"), F.min("_at").alias("from"), F.max("_at").alias("to"), F.max("_n_words").cast("long").alias("n_words"), F.count_if(F.col("gram").isNull()).alias("rows"))

    found = materialise(found)  # few rows, read several times below; else all texts would be hashed each time
    diagonals = found.where("template IS NOT NULL").drop("n_words", "rows")
    exact = diagonals.where(F.col("phrase") & (F.size("places") == F.col("grams")))
    base = exact.groupBy("_lic_id", "_lic_text").agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base"))

    by_place = Window.partitionBy(*own).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(by_place) > MAX_SHIFT).cast("int")
    merged = (
        diagonals.where(~F.col("phrase")).withColumn("run", F.sum(F.coalesce(fresh, F.lit(0))).over(by_place))
        .groupBy(*own, "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.min("from").alias("from"), F.max("to").alias("to"))
        .withColumn("share", F.col("held") / F.col("grams"))
    )
    spans = merged.where((F.col("share") >= MIN_SHARE) & (F.col("to") - F.col("from") + 1 <= F.col("grams") * 2)).groupBy("_lic_id", "_lic_text").agg(
        F.array_sort(F.collect_list(F.struct("label", "from", (F.col("to") - F.col("from") + GRAM).alias("words"), "share"))).alias("spans")
    )

    texts = found.where("template IS NULL").select("_lic_id", "_lic_text", "n_words", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"))
    found = base.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).unionByName(spans, allowMissingColumns=True)
    found = found.groupBy("_lic_id", "_lic_text").agg(*[F.max(c).alias(c) for c in ("n_base", "first_word", "last_word", "base", "spans")])
    out = texts.alias("t").join(found.alias("f"), F.expr("t._lic_id <=> f._lic_id and t._lic_text = f._lic_text"), "left")
    labels = F.array_union(F.coalesce("base", F.array().cast("array<string>")), F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return out.select(
        F.col("t._lic_id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.array_join(F.coalesce("base", F.array().cast("array<string>")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"), score.alias("score"), "spans",
    )
