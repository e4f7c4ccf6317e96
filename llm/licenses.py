"""License scans by diagonal voting over word k-grams."""

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from llm.oracles import LOWER, UPPER

WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
K = 2
LONGEST_GAP = 3   # words by which neighbouring diagonals of one span may differ
COVER = 0.6       # of a template's k-grams that a span must show

# Phrases and labels of the base, and notices of the method: fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                     "compliance with the License. You may obtain a copy of the License at",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                  "that the following conditions are met",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "all-rights-reserved": "All rights reserved",
}


def words_of(text):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(1))


def _grams(words):
    """Hashes of all runs of K words of an array column."""
    pairs = F.when(F.size(words) >= K, F.sequence(F.lit(1), F.size(words) - (K - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(pairs, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(K)]))


def templates(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(gram, template, label, is_base, at, grams): a row for each k-gram of each template; its size is that of the
    parameters."""
    rows = [(text, label, True) for text, label in phrases.items()] + [(text, label, False) for label, text in notices.items()]
    table = spark.createDataFrame(rows, "template string, label string, is_base boolean")
    grams = table.withColumn("hashes", _grams(words_of(F.col("template")))).withColumn("grams", F.size("hashes"))
    return grams.select("template", "label", "is_base", "grams", F.posexplode("hashes").alias("at", "gram"))


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text", phrases=PHRASES, notices=NOTICES,
                  cover=COVER, gap=LONGEST_GAP) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of ``docs``.

    1. All rolling k-gram hashes of all words meet the templates' k-gram positions (a broadcast join: the templates
       are parameters).
    2. Hits are summed by document, template and diagonal (word position less template position). A phrase is there
       where one diagonal holds all its k-grams: that is the base.
    3. For notices, neighbouring diagonals (at most ``gap`` apart: words put in or left out) make one span, verified by
       the part of the template's k-grams it shows and by its length. ``score`` is the best such part, 1 for phrases.

    ``spans`` lists label, first and last word and part of every verified place. A null text is an empty one. Rows that
    repeat an id and a text are counted once and returned as often as they are there. An empty table gives no rows."""
    spark = docs.sparkSession
    words = F.coalesce(words_of(docs[text_col].cast("string")), F.array().cast("array<string>"))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("hash"), words.alias("words"))
    # a last entry of each document stands for the document itself
    marked = rows.select("doc_id", "hash", F.size("words").alias("n_words"), F.posexplode(
        F.concat(_grams(F.col("words")), F.array(F.lit(0).cast("long")))).alias("pos", "gram"))
    known = templates(spark, phrases, notices)
    mark = spark.sql("SELECT '' AS template, '' AS label, false AS is_base, 0 AS grams, 0 AS at, 0L AS gram")
    hits = marked.join(F.broadcast(known.unionByName(mark)), "gram")
    own = hits.where("label <> '' OR pos = greatest(n_words - 1, 0)")
    votes = own.groupBy("doc_id", "hash", "n_words", "template", "label", "is_base", "grams",
                        (F.col("pos") - F.col("at")).alias("diagonal"), "at").agg(F.count("*").alias("copies"))
    diagonals = votes.groupBy("doc_id", "hash", "n_words", "template", "label", "is_base", "grams", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("copies").alias("copies"))
    diagonals = diagonals.where("NOT is_base OR size(ats) = grams")
    line = Window.partitionBy("doc_id", "hash", "template").orderBy("diagonal")
    near = F.least(F.lit(gap), F.floor(F.col("grams") / 4))  # short notices may stand one after the other
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > near
    grouped = diagonals.withColumn("fresh", F.when(F.col("is_base") | (F.col("label") == ""), 1).otherwise(
        F.coalesce(apart, F.lit(True)).cast("int")))
    grouped = grouped.withColumn("span", F.sum("fresh").over(line))
    spans = grouped.groupBy("doc_id", "hash", "n_words", "template", "label", "is_base", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("first"),
        F.max(F.col("diagonal") + F.col("high") + (K - 1)).alias("last"), F.max("copies").alias("copies"))
    part = F.when(F.col("grams") > 0, F.col("votes") / F.col("grams")).otherwise(F.lit(0.0))
    fits = F.col("last") - F.col("first") + 1 <= 1.5 * (F.col("grams") + (K - 1))
    spans = spans.withColumn("part", part).where(F.col("is_base") | (F.col("label") == "") | ((F.col("part") >= cover) & fits))
    is_mark, base = F.col("label") == "", F.col("is_base")
    found = spans.groupBy("doc_id", "hash", "n_words").agg(
        F.max(F.when(is_mark, F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(~is_mark, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(~is_mark, F.when(base, F.lit(1.0)).otherwise(F.col("part")))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(~is_mark, F.struct("first", "last", "label", "part")))).alias("spans"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels",
        "labels", "score", "spans")
