"""License scans by diagonal voting.

Every word k-gram of every text is hashed and joined to the positions of the same k-gram in
the license templates (a fixed list, hence a broadcast). A hit at document word p and
template position t votes for diagonal p - t, where the template would start. Votes are
summed per document, template and diagonal; a diagonal with a vote for every k-gram of the
template is a verified exact copy, as the joined words themselves are compared. For long
templates neighbouring diagonals (words put in or left out) are merged by a window over the
diagonals of a document, and the span is verified by the share of template positions that
its votes cover.

Defined results: null and empty texts have no words, labels or places and score 0. A hit is
counted wherever it stands, also overlapping. Repeated documents are separate rows. Extra
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.llm.common import WORD, words

K = 3
#: Diagonals at most so far apart belong to one span; share of a template that a span must cover.
GAP = 6
COVER = 0.6

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Opening sentences of public licenses and the labels of the method.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "apache-2-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl-text"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-text"),
    ("this work is licensed under a creative commons attribution", "cc-by-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
)


def template_grams(k: int = K) -> list[tuple[int, int, str, bool, str, str, str, int]]:
    """template, t, label, base, w0, w1, w2, number of k-grams of the template."""
    rows = []
    for number, (text, label) in enumerate([*BASE, *TEMPLATES]):
        ws = re.findall(WORD, text)
        n = len(ws) - k + 1
        rows += [(number, t, label, number < len(BASE), *ws[t:t + k], n) for t in range(n)]
    return rows


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    gram = F.xxhash64("w0", "w1", "w2")
    # the empty word, which no text holds, marks the end of a document and counts its words
    grams = [*template_grams(), (-1, 0, "", False, "", None, None, 1)]
    templates = spark.createDataFrame(grams, "template int, t int, label string, base boolean, w0 string, w1 string, w2 string, grams int")
    templates = templates.select("template", "t", "label", "base", "grams", F.col("w0").alias("t0"), F.col("w1").alias("t1"), F.col("w2").alias("t2"), gram.alias("th"))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", words(F.col("text")).alias("ws"))
    rows = rows.select("uid", "doc_id", "ws", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "w0"))
    rows = rows.select("uid", "doc_id", "pos", "w0", F.get("ws", F.col("pos") + 1).alias("w1"), F.get("ws", F.col("pos") + 2).alias("w2"))
    same = F.col("w0").eqNullSafe(F.col("t0")) & F.col("w1").eqNullSafe(F.col("t1")) & F.col("w2").eqNullSafe(F.col("t2"))
    hits = rows.withColumn("h", gram).join(F.broadcast(templates), F.col("h") == F.col("th")).where(same)
    diagonal = (F.col("pos") - F.col("t")).alias("diagonal")
    # one exchange: what follows groups within a document
    hits = hits.select("uid", "doc_id", "template", "label", "base", "grams", "t", diagonal).repartition("uid")
    votes = hits.groupBy("uid", "doc_id", "template", "label", "base", "grams", "diagonal").agg(F.collect_list("t").alias("ts"))
    per = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = (~F.col("base") & (F.col("diagonal") - F.lag("diagonal").over(per) <= GAP)).cast("int")
    votes = votes.withColumn("new", F.lit(1) - F.coalesce(apart, F.lit(0)))
    votes = votes.withColumn("span", F.sum("new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("ts"))))
    spans = votes.groupBy("uid", "doc_id", "template", "label", "base", "grams", "span").agg(
        covered.alias("covered"), F.min("diagonal").cast("long").alias("start"))
    found = F.col("template") >= 0
    share = F.col("covered") / F.col("grams")
    full = F.col("base") & (F.col("covered") == F.col("grams"))
    good = found & (full | (~F.col("base") & (share >= COVER)))
    spans = spans.withColumns({"full": F.coalesce(full, F.lit(False)), "good": F.coalesce(good, F.lit(False)), "share": share})
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("uid", "doc_id").agg(
        F.max(F.when(F.col("template") == -1, F.col("start"))).alias("n_words"),
        F.count_if("full").alias("n_base"), F.min(F.when(F.col("full"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("full"), F.col("start"))).alias("last_word"),
        text(F.when(F.col("full"), F.col("label"))).alias("base_labels"), text(F.when(F.col("good"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.col("share"))), F.lit(0.0)).alias("score")).drop("uid")
