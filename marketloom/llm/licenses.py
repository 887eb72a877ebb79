"""License scan by diagonal voting, with DataFrame functions only.

All rolling hashes of three words are joined to the positions that they have in license templates. Matches vote for the
diagonal (position in the text minus position in the template); neighbouring diagonals are merged, so that a few
inserted or missing words do not split a match; a merged span counts if enough of the template is in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that must stand whole, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Openings of public license texts, and their labels.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)


def word_array(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def templates(spark: SparkSession, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """(template, label, base, grams, place, a, b, c): the word triples of every template with their places."""
    rows = []
    for base, group in ((True, phrases), (False, texts)):
        for label, text in group:
            w = text.split()
            if len(w) < K:
                raise ValueError(f"a template needs {K} words: {text!r}")
            number = len({r[0] for r in rows})
            rows += [(number, label, base, len(w) - K + 1, i, *w[i : i + K]) for i in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, place int, a string, b string, c string")


def scan(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEXTS, drift: int = 4, coverage: float = 0.8,
    most_filtered: int = 20_000,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Phrases count where all their words stand in a row. Texts count where, over diagonals at most ``drift`` apart, at
    least ``coverage`` of the template's triples occur; ``score`` is the best share that a template reaches (0 to 1).
    ``spans`` has (label, first word, last word, share) of what counts. Null and empty texts have no words and no
    labels. Rows are kept apart even if they repeat an id. Up to ``most_filtered`` template triples are looked for
    before the positions are dealt out; with more of them all positions are joined.
    """
    spark = documents.sparkSession
    parts = templates(spark, phrases, texts).withColumn("h", F.xxhash64("a", "b", "c"))
    w = F.col("w")

    def triple(i: Column) -> Column:
        return F.struct((i - 1).alias("at"), F.get(w, i - 1).alias("a"), F.get(w, i).alias("b"), F.get(w, i + 1).alias("c"))

    def hashed(i: Column) -> Column:
        return F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))

    places = F.when(F.size(w) >= K, F.sequence(F.lit(1), F.size(w) - (K - 1)))
    n_grams = sum(len(t.split()) - K + 1 for _, t in (*phrases, *texts))
    if n_grams <= most_filtered:
        wanted = [r["h"] for r in parts.select("h").distinct().collect()]
        places = F.filter(places, lambda i: hashed(i).isin(wanted))
    rows = documents.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), word_array(F.col(text_col)).alias("w"))
    grams = rows.select("row", "id", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), triple(i).alias("t")))).alias("g"))
    grams = grams.select("row", "id", "n_words", "g.h", F.col("g.t.at").alias("at"), "g.t.a", "g.t.b", "g.t.c").repartition("row")
    small = F.broadcast(parts) if n_grams <= most_filtered else parts
    voted = grams.join(small, ["h", "a", "b", "c"], "left").withColumn("diagonal", F.col("at") - F.col("place"))

    doc, one = ["row", "id", "n_words"], ["template", "label", "base", "grams"]
    votes = voted.groupBy(*doc, *one, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    # phrases stay on their diagonal; texts take in the next one if it is near
    fresh = F.when(F.col("base") | F.lag("diagonal").over(along).isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > drift), 1).otherwise(0)
    merged = votes.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(along))
    spans = merged.groupBy(*doc, *one, "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"), F.min("diagonal").alias("start"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last")
    ).withColumn("share", F.coalesce(F.col("found") / F.col("grams"), F.lit(0.0)))
    whole = F.col("base") & (F.col("share") == 1)
    counts = whole | (~F.col("base") & (F.col("share") >= coverage))
    joined = F.array_join(F.sort_array(F.collect_set(F.when(counts, F.col("label")))), ",")
    return spans.groupBy(*doc).agg(
        F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"), joined.alias("labels"), F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.when(counts, F.struct("first", "last", "label", "share")))).alias("spans"),
    ).withColumnRenamed("id", id_col).drop("row")
