"""License scan by diagonal voting, with DataFrame functions only.

Rolling word k-gram hashes of every text are joined to the positions of the
same k-grams in license templates. A match at document word ``p`` and template
word ``t`` votes for the diagonal ``p - t``; votes are counted per (document,
template, diagonal), diagonals that lie within ``gap`` words of each other are
merged (they differ by inserted or dropped words), and a merged span is kept if
it covers enough of the template's k-grams.

Defined cases: a null or empty text has no words, hence n_words 0, no matches,
empty label strings and score 0. Rows that repeat doc_id and text give one row;
one doc_id with different texts gives a row for each text. A null doc_id is kept
as a key of its own. Columns other than doc_id and text are ignored, so their
names cannot clash. Templates of fewer than k words cannot match by k-gram and
are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
GAP = 3
COVERAGE = 0.75

# Phrases whose consecutive words give a base label.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices as the licenses' own texts word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

SEPARATORS = r"[\x00-/:-`{-\x7f]+"


def words_of(text: str) -> list[str]:
    """The driver's words of one template."""
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the words of the lower-cased text; empty first and last pieces of the split are dropped.

    lower() may change letters outside A-Z too. That moves no word boundary, since
    every such letter is inside words before and after, and no template has one.
    """
    first = F.when(F.element_at("_pieces", 1) == "", 1).otherwise(0)
    last = F.when((F.element_at("_pieces", -1) == "") & (F.size("_pieces") > 1), 1).otherwise(0)
    return (
        df.withColumn("_pieces", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS))
        .withColumn("_drop", first)
        .withColumn(out, F.slice("_pieces", F.col("_drop") + 1, F.size("_pieces") - F.col("_drop") - last))
        .drop("_pieces", "_drop")
    )


def gram(words: str, at: Column, k: int) -> list[Column]:
    return [F.get(F.col(words), at + j) for j in range(k)]


def template_grams(spark: SparkSession, templates, phrases, k: int) -> DataFrame:
    """(g_hash, g_words, tpl, tpl_pos, tpl_grams, label, phrase): one row for each k-gram position; phrase: the words of a base phrase at its first position."""
    rows = []
    for tpl, (label, text, base) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates]):
        words = words_of(text)
        if len(words) < k:
            raise ValueError(f"template {text!r} has fewer than {k} words")
        for at in range(len(words) - k + 1):
            rows.append((words[at : at + k], tpl, at, len(words) - k + 1, label, words if base and at == 0 else None, base))
    made = spark.createDataFrame(rows, "g_words array<string>, tpl int, tpl_pos int, tpl_grams int, label string, phrase array<string>, is_base boolean")
    return made.withColumn("g_hash", F.xxhash64(*[F.get("g_words", F.lit(j)) for j in range(k)]))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, k: int = K, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """One row for each (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    spans: the verified spans as structs (label, first, last, covered), in order of first word.
    """
    spark = docs.sparkSession
    grams = F.broadcast(template_grams(spark, templates, phrases, k))  # as many rows as the fixed templates have words
    texts = with_words(docs.select("doc_id", "text"), "text", "words").select("doc_id", F.xxhash64("text").alias("text_key"), "words", F.size("words").alias("n_words"))
    placed = texts.select("doc_id", "text_key", "n_words", "words", F.posexplode_outer("words").alias("pos", "w"))
    here = gram("words", F.col("pos"), k)
    met = F.col("tpl").isNotNull()  # a hash match counts only if the words are the same
    for j in range(k):
        met = met & F.get("g_words", F.lit(j)).eqNullSafe(here[j])
    hits = (
        placed.join(grams, F.xxhash64(F.col("w"), *here[1:]) == F.col("g_hash"), "left")
        .where(F.col("tpl").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
        .withColumn("met", met)
        .where(F.col("met") | F.coalesce(F.col("pos") == 0, F.lit(True)))
        .select(
            "doc_id", "text_key", "n_words", "pos", *[F.when(F.col("met"), F.col(c)).alias(c) for c in ("tpl", "label", "is_base", "tpl_grams", "tpl_pos")],
            F.when(F.col("met"), F.col("pos") - F.col("tpl_pos")).alias("diag"),
            F.when(F.col("met") & F.col("phrase").isNotNull() & (F.slice("words", F.col("pos") + 1, F.size("phrase")) == F.col("phrase")), F.col("pos")).alias("base_at"),
        )
        .repartition("doc_id", "text_key")
    )
    key = ["doc_id", "text_key"]
    votes = hits.groupBy(*key, "tpl", "diag").agg(
        F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("tpl_grams").alias("tpl_grams"),
        F.collect_set("tpl_pos").alias("found"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("base_at").alias("base_at"),
    )
    by_diag = Window.partitionBy(*key, "tpl").orderBy("diag")
    runs = votes.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(by_diag) <= gap, 0).otherwise(1)).withColumn("run", F.sum("_new").over(by_diag))
    spans = (
        runs.groupBy(*key, "tpl", "run")
        .agg(
            F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("tpl_grams").alias("tpl_grams"),
            F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"),
            F.collect_list("base_at").alias("base_at"),
        )
        .withColumn("covered", F.col("n_found") / F.col("tpl_grams"))
        .withColumn("ok", F.coalesce(~F.col("is_base") & (F.col("covered") >= coverage), F.lit(False)))
    )
    per_doc = spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.flatten(F.collect_list("base_at")).alias("_at"),
        F.collect_set(F.when(F.size("base_at") > 0, F.col("label"))).alias("_base"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("first", "last", "label", "covered")))).alias("_spans"),
    )
    # Notices that share wording overlap; the template that covers a place best keeps it.
    beaten = lambda s: F.exists("_spans", lambda o: (o["first"] <= s["last"]) & (o["last"] >= s["first"]) & (o["covered"] > s["covered"]))
    kept = per_doc.withColumn("spans", F.filter("_spans", lambda s: ~beaten(s))).withColumn("_own", F.transform("spans", lambda s: s["label"]))
    return kept.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", "_own")), ",").alias("labels"),
        "spans",
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs).drop("spans")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATE_ROWS = ", ".join(
    f"({n}, '{label}', {base}, {_sql_list(words_of(text))})" for n, (label, text, base) in enumerate([(a, b, True) for a, b in BASE_PHRASES] + [(a, b, False) for a, b in TEMPLATES])
)
ORACLES = {
    "op7_license_scan": rf"""WITH t(tpl, label, is_base, tw) AS (VALUES {_TEMPLATE_ROWS}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT tpl, label, is_base, tw, len(tw) - {K - 1} AS n, unnest(range(1, len(tw) - {K - 2})) AS tp FROM t),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS p FROM d WHERE len(w) >= {K}),
h AS (SELECT doc_id, tpl, label, is_base, n, tp, p, p - tp AS diag, is_base AND tp = 1 AND w[p:p + len(tw) - 1] = tw AS base_hit FROM p JOIN g ON w[p] = tw[tp] AND w[p + 1] = tw[tp + 1] AND w[p + 2] = tw[tp + 2]),
v AS (SELECT doc_id, tpl, label, n, diag, min(p) AS first, max(p) + {K - 1} AS last FROM h WHERE NOT is_base GROUP BY ALL),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tpl ORDER BY diag) AS run FROM (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tpl ORDER BY diag) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM v)),
s AS (SELECT r.doc_id, r.tpl, r.label, min(r.first) AS first, max(r.last) AS last, count(DISTINCT h.tp) / r.n AS covered FROM r JOIN h USING (doc_id, tpl, diag) GROUP BY r.doc_id, r.tpl, r.label, r.n, r.run HAVING count(DISTINCT h.tp) / r.n >= {COVERAGE}),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.first <= s.last AND o.last >= s.first AND o.covered > s.covered)),
b AS (SELECT doc_id, count(*) AS n_base, min(p) - 1 AS first_word, max(p) - 1 AS last_word, list_distinct(list(label)) AS labels FROM h WHERE base_hit GROUP BY doc_id),
m AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(covered) AS best FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
