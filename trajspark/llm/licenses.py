"""License scan by diagonal voting.

All word pairs of a text are joined by hash to the word pairs of the templates. Each match votes for a template and a
diagonal (place in the text less place in the template); words on one diagonal stand as in the template. Diagonals of a
template that lie within ``SLACK`` words of each other are merged, so that inserted or missing words don't part a text. A merged
span counts if enough different pairs of the template stand close together in it: on one diagonal, on diagonals at most a
template's length apart, or in the whole span if that isn't much longer than the template. Repeated notices thus lose nothing.
Matches are verified word by word, so a phrase is found exactly where its words stand consecutively.

The templates are fixed and small: broadcast, and joined where the text is read. Only votes are shuffled, by row.

Defined results: a null text is the empty text (0 words); without a place first_word and last_word are null, the labels
empty and the score 0; each row has its own result, repeated or null ids or not; other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLACK = 3
COVER = 0.75        # share of a template's word pairs that a span must hold
STRETCH = 2         # longest span, in lengths of the template

WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # fixed value: a word, after A-Z are lowered


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    base: bool = False

    @property
    def pairs(self) -> list[tuple[str, str]]:
        words = self.text.split()
        return list(zip(words, words[1:]))

    @property
    def full(self) -> int:
        return (1 << len(self.pairs)) - 1


# Phrases that must be found exactly, then openings of license notices. At most 63 word pairs each.
TEMPLATES = [
    Template("gnu general public license", "gpl", True),
    Template("apache license", "apache", True),
    Template("cc by", "cc-by", True),
    Template("mit license", "mit", True),
    Template("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    Template("licensed under the apache license version 2 0", "apache-2.0"),
    Template("licensed under the gnu general public license version 3", "gpl-3.0"),
    Template("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    Template("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    Template("gnu lesser general public license", "lgpl"),
    Template("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]


def _template_frames(spark: SparkSession, templates: list[Template]) -> tuple[DataFrame, DataFrame]:
    if any(not 1 <= len(t.pairs) <= 63 for t in templates):
        raise ValueError("a template needs 2 to 64 words")
    pairs = [(k, place, a, b) for k, t in enumerate(templates) for place, (a, b) in enumerate(t.pairs)]
    kinds = [(k, t.label, t.base, len(t.pairs), t.full) for k, t in enumerate(templates)]
    return (
        spark.createDataFrame(pairs, "template int, place int, a string, b string"),
        spark.createDataFrame(kinds, "template int, label string, base boolean, pairs int, whole long"),
    )


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs``."""
    pairs, kinds = (F.broadcast(df) for df in _template_frames(docs.sparkSession, templates))
    keyed = pairs.withColumn("hash", F.xxhash64("a", "b")).select("hash", "template", "place", "a", "b")
    # Lowering other letters too changes no count of words, and no template has such letters.
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(0))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("w"))
    following = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))
    grams = texts.select(
        "row", "doc_id", F.posexplode_outer(F.arrays_zip(F.col("w").alias("first"), following.alias("second"))).alias("at", "gram")
    ).select("row", "doc_id", "at", F.col("gram.first").alias("first"), F.col("gram.second").alias("second"))
    same = (F.xxhash64("first", "second") == F.col("hash")) & (F.col("first") == F.col("a")) & (F.col("second") == F.col("b"))
    # The last word of a text has no second one; its row always stays and tells the number of words.
    votes = grams.join(keyed, same, "left").where(F.col("template").isNotNull() | F.col("second").isNull()).select(
        "row", "doc_id", "at", "template",
        (F.col("at") - F.col("place")).alias("diagonal"),
        F.expr("shiftleft(1L, place)").alias("mark"),
    )
    # One shuffle; what follows is grouped by more columns than the row and needs none.
    diagonals = votes.repartition("row").groupBy("row", "doc_id", "template", "diagonal").agg(
        F.bit_or("mark").alias("marks"), F.min("at").alias("low"), F.max("at").alias("high")
    ).join(kinds, "template", "left")
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, 1).otherwise(0)
    exact = F.col("base") & (F.col("marks") == F.col("whole"))
    # Diagonals in lengths of the template: votes of those within STRETCH - 1 stand in a window of STRETCH lengths.
    close = Window.partitionBy("row", "template", "span").orderBy("lengths").rangeBetween(Window.currentRow, STRETCH - 1)
    spans = (
        diagonals.withColumn("step", step).withColumn("span", F.sum("step").over(order))
        .withColumn("exact", F.when(exact, F.col("diagonal")))
        .withColumn("lengths", F.col("diagonal") / (F.col("pairs") + 1))
        .withColumn("near", F.bit_count(F.bit_or("marks").over(close)))
        .groupBy("row", "doc_id", "template", "label", "base", "pairs", "span").agg(
            F.bit_or("marks").alias("marks"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("near").alias("near"),
            F.count("exact").alias("places"), F.min("exact").alias("first"), F.max("exact").alias("last"),
        )
    )
    short = F.col("high") - F.col("low") + 2 <= STRETCH * (F.col("pairs") + 1)
    cover = F.greatest("near", F.when(short, F.bit_count("marks"))) / F.col("pairs")
    holds = F.when(F.col("base"), F.col("places") > 0).otherwise(cover >= COVER)
    name = lambda rows: F.array_join(F.array_sort(F.collect_set(rows)), ",")
    return spans.withColumn("holds", holds).groupBy("row", "doc_id").agg(
        # Rows without a template are the texts' last words.
        F.coalesce(F.max(F.when(F.col("template").isNull(), F.col("high"))) + 1, F.lit(0)).cast("long").alias("n_words"),
        F.sum("places").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        name(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        name(F.when(F.col("holds"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("holds"), F.when(F.col("base"), 1.0).otherwise(cover))), F.lit(0.0)).alias("score"),
    ).drop("row")


def scan_sql(templates: list[Template] = TEMPLATES) -> str:
    """The same in SQL."""
    pairs = ", ".join(f"({k}, {p}, '{a}', '{b}')" for k, t in enumerate(templates) for p, (a, b) in enumerate(t.pairs))
    kinds = ", ".join(f"({k}, '{t.label}', {t.base}, {len(t.pairs)}, {t.full})" for k, t in enumerate(templates))
    return f"""
        WITH pairs(template, place, a, b) AS (VALUES {pairs}), kinds(template, label, base, pairs, whole) AS (VALUES {kinds}),
        texts AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents
        ), votes AS (
            SELECT row, i - 1 - place AS diagonal, i - 1 AS spot, template, place
            FROM (SELECT row, w, unnest(range(1, len(w))) AS i FROM texts) JOIN pairs ON w[i] = a AND w[i + 1] = b
        ), diagonals AS (
            SELECT row, template, diagonal, bit_or(1::BIGINT << place) AS marks, min(spot) AS low, max(spot) AS high
            FROM votes GROUP BY ALL
        ), steps AS (
            SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {SLACK} THEN 1 ELSE 0 END AS step
            FROM diagonals JOIN kinds USING (template) WINDOW o AS (PARTITION BY row, template ORDER BY diagonal)
        ), numbered AS (
            SELECT *, sum(step) OVER (PARTITION BY row, template ORDER BY diagonal) AS span,
                   CASE WHEN base AND marks = whole THEN diagonal END AS exact FROM steps
        ), windows AS (
            SELECT *, bit_count(bit_or(marks) OVER (
                PARTITION BY row, template, span ORDER BY diagonal / (pairs + 1)
                RANGE BETWEEN CURRENT ROW AND {STRETCH - 1}::DOUBLE FOLLOWING
            )) AS near FROM numbered
        ), spans AS (
            SELECT row, template, label, base, pairs, span,
                   greatest(max(near), CASE WHEN max(high) - min(low) + 2 <= {STRETCH} * (pairs + 1) THEN bit_count(bit_or(marks)) END) / pairs
                   AS cover, count(exact) AS places, min(exact) AS first, max(exact) AS last
            FROM windows GROUP BY row, template, label, base, pairs, span
        ), held AS (
            SELECT *, CASE WHEN base THEN places > 0 ELSE cover >= {COVER} END AS holds FROM spans
        ), found AS (
            SELECT row, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds) AS labels,
                   max(CASE WHEN base THEN 1 ELSE cover END) FILTER (holds) AS score
            FROM held GROUP BY row
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
               last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0)::DOUBLE AS score
        FROM texts LEFT JOIN found USING (row)
    """
