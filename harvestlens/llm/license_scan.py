"""License scan: base phrases by place, and license notices by an exact set-similarity join, in DataFrame operations only.

A block is a line, or the end of a line with the lines after it in its paragraph, up to the longest template's words on either side, as notices are
wrapped. A template is found in a block that holds at least CONTAINMENT of its distinct words. Words are ordered by how many blocks of the
corpus hold them, rarest first. A block that reaches the threshold must share one of the template's rarest words (prefix filter), hold enough template
words at all (length filter), and have enough of them left behind its first shared word, in the template and in the block (positional filter); what passes
is compared exactly. Words that stand in no template cannot be shared and are left out of a block before anything is moved.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import stored, table

CONTAINMENT = 0.85
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases looked for word by word, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Wordings of common notices, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("copyright all rights reserved", "reserved"),
)


def needed(size: int, containment: float) -> int:
    return ceil(containment * size - 1e-9)


def _words(text: Column) -> Column:
    """The words of a lower-cased text."""
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after another, words counted from 0."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    found = F.filter(F.sequence(F.lit(0), last), lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)]))
    # the joined words tell cheaply whether the phrase is there at all
    return F.when(F.concat(F.lit(" "), F.col("joined"), F.lit(" ")).contains(f" {phrase} "), found).otherwise(F.expr("CAST(array() AS array<int>)"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _blocks(reach: int, fewest: int) -> Column:
    """(line, words, parts) of each line and each wrapped stretch that starts in it; words of the templates only. parts are the line and what follows, of which
    neither may hold as much of a template as the stretch."""
    none = F.expr("CAST(array() AS array<string>)")
    shape = lambda i, words, parts: F.struct(i.alias("line"), words.alias("words"), parts.alias("parts"))

    def following(i: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), none.alias("words"))
        # a line without words ends the paragraph, as enough words do
        more = lambda a, x: F.when(
            (a["n"] < reach) & (x["n"] > 0), F.struct((a["n"] + x["n"]).alias("n"), F.array_union(a["words"], x["head"]).alias("words"))
        ).otherwise(F.struct(F.greatest(a["n"], F.lit(reach)).alias("n"), a["words"].alias("words")))
        return F.aggregate(F.slice("held", i + 2, reach), start, more, lambda a: a["words"])

    lines = F.transform("held", lambda x, i: shape(i, x["own"], F.expr("CAST(array() AS array<array<string>>)")))
    pairs = F.transform("held", lambda x, i: F.struct(i.alias("line"), x["own"].alias("own"), x["tail"].alias("tail"), F.when(F.size(x["tail"]) > 0, following(i)).otherwise(none).alias("rest")))
    pairs = F.filter(pairs, lambda x: F.size(F.array_except(x["rest"], x["tail"])) > 0)
    wrapped = F.transform(pairs, lambda x: shape(x["line"], F.array_union(x["tail"], x["rest"]), F.array(x["own"], x["rest"])))
    return F.filter(F.concat(lines, wrapped), lambda x: F.size(x["words"]) >= fewest)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) for every row.

    n_base counts all places of the phrases; first_word and last_word are the smallest and largest start, null without one. labels adds those of the
    templates found; score is 1 for a phrase, else the largest containment found, else 0; notices lists (line, label, containment), a wrapped one at its
    first line. A null text is empty: no words,
    no labels, score 0. Rows with the same doc_id and text have the same result, and rows without doc_id are scanned like any other."""
    sizes = {text: len(set(text.split())) for text, _ in templates}
    fewest = min((needed(n, containment) for n in sizes.values()), default=1)
    vocabulary = sorted({w for text, _ in templates for w in text.split()})
    held_words = F.array(*[F.lit(w) for w in vocabulary])

    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), text.alias("low"))
    rows = rows.withColumn("lines", F.transform(F.split("low", "\n", -1), _words)).drop("low")
    rows = rows.withColumn("words", F.flatten("lines")).withColumn("joined", F.array_join("words", " "))
    for k, (phrase, _) in enumerate(phrases):
        rows = rows.withColumn(f"at{k}", _places(F.col("words"), phrase))
    rows = rows.withColumn("places", F.concat(*[F.col(f"at{k}") for k in range(len(phrases))]))
    reach = max((len(text.split()) for text, _ in templates), default=1)
    ends = lambda x: (F.slice(x, 1, reach), F.slice(x, F.greatest(F.size(x) - reach + 1, F.lit(1)), reach))
    rows = rows.withColumn("held", F.transform("lines", lambda x: F.struct(F.size(x).alias("n"), F.array_intersect(held_words, x).alias("own"), *(e.alias(n) for e, n in zip(ends(x), ("head", "tail"))))))
    rows = rows.withColumn("held", F.transform("held", lambda x: F.struct(x["n"].alias("n"), x["own"].alias("own"), *(F.array_intersect(x["own"], x[n]).alias(n) for n in ("head", "tail")))))
    digest = rows.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])).alias("base"),
        _blocks(reach, fewest).alias("blocks"),
    )
    digest = stored(digest, "license-blocks")
    found = notices(digest, templates, containment)
    per_text = found.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("line", "label", "containment"))).alias("notices"), F.max("containment").alias("best")
    )
    d, p = digest.drop("blocks").alias("d"), per_text.alias("p")
    both = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")), "left")
    more = F.coalesce(F.transform("p.notices", lambda x: x["label"]), F.expr("CAST(array() AS array<string>)"))
    label_text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return both.select(
        "d.doc_id", "d.n_words", "d.n_base", "d.first_word", "d.last_word", label_text(F.col("d.base")).alias("base_labels"),
        label_text(F.concat("d.base", more)).alias("labels"),
        F.when(F.col("d.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("p.best", F.lit(0.0))).alias("score"), F.col("p.notices").alias("notices"),
    )


def notices(digest: DataFrame, templates, containment: float) -> DataFrame:
    """(doc_id, text_hash, line, label, containment) of the blocks that hold a template; blocks hold template words only."""
    blocks = digest.select("doc_id", "text_hash", F.explode("blocks").alias("b")).select("doc_id", "text_hash", "b.line", "b.words", "b.parts")
    # one count for each word of the templates: as many rows as the templates have words
    counts = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = sorted({w for text, _ in templates for w in text.split()}, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(rank)}
    index = []
    for text, label in templates:
        words = sorted(set(text.split()), key=place.get)
        need = needed(len(words), containment)
        index += [(w, label, i, len(words), need, words) for i, w in enumerate(words[: len(words) - need + 1])]
    spark = digest.sparkSession
    shape = "token string, label string, i int, size int, need int, template array<string>"
    by_token = F.broadcast(spark.createDataFrame(index, shape))  # as large as the templates
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in rank]), F.col("words"))
    first = F.array(*[F.lit(w) for w in sorted({row[0] for row in index}, key=place.get)])
    blocks = blocks.withColumn("ordered", ordered).withColumn("token", F.explode(F.array_intersect(first, F.col("ordered"))))
    met = blocks.join(by_token, "token").withColumn("j", F.array_position("ordered", F.col("token")) - 1)
    met = met.filter((F.size("ordered") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("ordered") - F.col("j") - 1) >= F.col("need")))
    met = met.withColumn("common", F.array_intersect("template", "ordered"))
    # each block and template once: at the first word that they share
    met = met.filter((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("token")))
    # what a line or the lines after it hold alone is found there
    met = met.filter(F.forall("parts", lambda p: F.size(F.array_intersect("template", p)) < F.size("common")))
    return met.select("doc_id", "text_hash", "line", "label", (F.size("common") / F.col("size")).alias("containment"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("notices")


def scan_sql() -> str:
    """The same by brute force: every line against every template."""
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '{SEPARATORS}'), lambda w: w <> '')"
    places = [
        "list_filter(range(len(words)), lambda i: " + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split())) + ")" for p, _ in PHRASES
    ]
    templates = ", ".join(f"({n}, [{', '.join(repr(w) for w in sorted(set(t.split())))}], '{label}')" for n, (t, label) in enumerate(TEMPLATES))
    base = ", ".join(f"CASE WHEN len(at{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
    split AS (SELECT rid, doc_id, {words('low')} AS words FROM docs),
    found AS (SELECT rid, doc_id, words, {', '.join(f'{p} AS at{k}' for k, p in enumerate(places))} FROM split),
    based AS (SELECT rid, doc_id, len(words) AS n_words, {' || '.join(f'at{k}' for k in range(len(PHRASES)))} AS places,
              list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM found),
    templates(n, template, label) AS (VALUES {templates}),
    lines AS (SELECT rid, list_distinct({words('line')}) AS block FROM (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM docs)),
    met AS (SELECT rid, label, len(list_intersect(block, template)) / len(template) AS share FROM lines, templates
            WHERE len(list_intersect(block, template)) >= ceil({CONTAINMENT} * len(template) - 1e-9)),
    best AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS best FROM met GROUP BY rid)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
           CAST(list_max(places) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
           CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
    FROM based LEFT JOIN best USING (rid)"""
