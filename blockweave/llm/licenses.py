"""License scan by diagonal voting; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch

#: Phrases that count wherever their words stand consecutively.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that the method finds, also with words put in or left out.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
)
#: Pairs of these alone tell nothing of a license and are no evidence.
COMMON = frozenset("a an and any are by in is it of on or that the this to under with without you".split())
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, int, str, str, str, bool]]:
    """(template, position, first word, second word, label, base) of every informative word pair of the templates."""
    rows = []
    for base, templates in ((True, phrases), (False, notices)):
        for text, label in templates:
            words, t = text.split(), len({r[0] for r in rows})
            rows += [(t, i, a, b, label, base) for i, (a, b) in enumerate(zip(words, words[1:])) if base or not {a, b} <= COMMON]
    return rows


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, gap: int = 3, drift: int = 9, coverage: float = 0.7) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row of ``docs``.

    Every rolling pair of words is hashed and joined to the pairs' positions in the templates, a table whose size
    the parameters fix and which is broadcast. Matches vote for their diagonal, document position less template
    position. Diagonals of one template at most ``gap`` apart are merged into a span, of which what lies within
    ``drift`` of its strongest diagonal is verified: each template position counts once, at its first place there, and only if that place is
    behind the one of the template position before it. ``coverage`` of the template's pairs must be found so, in order; how often a pair
    is repeated changes nothing. ``score`` is the largest share found. A phrase counts where one diagonal holds all
    its pairs. Matches are written to the shared folder; votes are combined before they shuffle, by row.

    Null and empty texts have no words, no labels ('') and score 0; repeated rows stay, each with its own result;
    a null doc_id stays; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    grams = template_grams(phrases, notices)
    values = ", ".join(f"({t}, {i}, '{a}', '{b}', '{label}', {str(base).lower()})" for t, i, a, b, label, base in [*grams, (-1, 0, "", "", "", False)])
    known = spark.sql(f"select t, i, xxhash64(a, b) as gram, label, base, cast(count(*) over (partition by t) as int) as need from values {values} as g(t, i, a, b, label, base)")
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(low, BREAK), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    # the pair of two empty words ends each list: it keeps documents that match nothing (posexplode_outer, as the
    # optimizer would infer a filter on the list from posexplode and make the list twice)
    rows = rows.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(F.array_append(pairs, F.xxhash64(F.lit(""), F.lit("")))).alias("pos", "gram"))
    # matches are few: written once, the text is never read again and a lost executor costs no second scan
    hits = rows.join(F.broadcast(known), "gram").select("row", "doc_id", "n_words", "t", "label", "base", "need", "i", (F.col("pos") - F.col("i")).alias("diagonal"))
    votes = Scratch(spark, "licenses").write(hits).groupBy("row", "doc_id", "n_words", "t", "label", "base", "need", "diagonal")
    votes = votes.agg(F.count("*").alias("votes"), F.collect_list("i").alias("at"))
    by = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = F.when(~F.col("base") & (F.col("t") >= 0) & (F.col("diagonal") - F.lag("diagonal").over(by) <= gap), F.lit(0)).otherwise(F.lit(1))
    spans = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by))
    whole = spans.where((F.col("t") < 0) | F.col("base") & (F.col("votes") == F.col("need")))
    whole = whole.select("row", "doc_id", "n_words", "label", F.when(F.col("base"), F.col("diagonal")).alias("start"), "base", F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("share"))
    span = Window.partitionBy("row", "t", "span")
    near = spans.where(~F.col("base") & (F.col("t") >= 0)).withColumn("best", F.max(F.struct("votes", (-F.col("diagonal")).alias("minus"))).over(span)).withColumn("strength", F.sum("votes").over(span))
    near = near.where((F.col("strength") >= coverage * F.col("need")) & (F.abs(F.col("diagonal") + F.col("best.minus")) <= drift))
    places = near.select("row", "doc_id", "n_words", "t", "label", "need", "span", "diagonal", F.explode("at").alias("i"))
    places = places.groupBy("row", "doc_id", "n_words", "t", "label", "need", "span", "i").agg(F.min(F.col("diagonal") + F.col("i")).alias("place"))
    behind = F.col("place") > F.coalesce(F.lag("place").over(span.orderBy("i")), F.lit(-1))
    found = places.withColumn("behind", behind).groupBy("row", "doc_id", "n_words", "t", "label", "need", "span").agg(F.count(F.when(F.col("behind"), 1)).alias("n"))
    found = found.withColumn("share", F.col("n") / F.col("need")).where(F.col("share") >= coverage)
    both = whole.unionByName(found.select("row", "doc_id", "n_words", "label", F.lit(None).cast("int").alias("start"), F.lit(False).alias("base"), "share"))
    out = both.groupBy("row", "doc_id", "n_words").agg(
        F.count("start").alias("n_base"),
        F.min("start").cast("long").alias("first_word"),
        F.max("start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") != "", F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9).alias("score"))


def sql(phrases=PHRASES, notices=NOTICES, gap: int = 3, drift: int = 9, coverage: float = 0.7, table: str = "documents") -> str:
    values = ", ".join(f"({t}, {i}, '{a}', '{b}', '{label}', {str(base).lower()})" for t, i, a, b, label, base in template_grams(phrases, notices))
    return f"""
with known as (select *, count(*) over (partition by t) as need from (values {values}) as g(t, i, a, b, label, base)),
docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}),
pairs as (select r, unnest(list_zip(w[1:-2], w[2:])) as p, generate_subscripts(w[2:], 1) - 1 as pos from docs where len(w) > 1),
hits as (select r, t, label, base, need, i, pos, pos - i as diagonal from pairs join known on p[1] = a and p[2] = b),
whole as (select r, label, diagonal as start, true as base, 1.0::double as share from hits where base group by r, t, label, need, diagonal having count(*) = need),
votes as (select r, t, need, diagonal, count(*) as votes from hits where not base group by all),
steps as (select *, case when diagonal - lag(diagonal) over (partition by r, t order by diagonal) <= {gap} then 0 else 1 end as apart from votes),
marked as (select *, sum(apart) over (partition by r, t order by diagonal) as span from steps),
spans as (
  select *, first_value(diagonal) over (partition by r, t, span order by votes desc, diagonal) as best, sum(votes) over (partition by r, t, span) as strength from marked),
near as (select r, t, span, diagonal from spans where strength >= {coverage} * need and abs(diagonal - best) <= {drift}),
places as (select h.r, h.t, h.label, h.need, n.span, h.i, min(h.pos) as place from hits h join near n using (r, t, diagonal) group by all),
ordered as (select *, place > coalesce(lag(place) over (partition by r, t, span order by i), -1) as behind from places),
found as (
  select r, label, null::bigint as start, false as base, count(*) filter (behind) / need as share from ordered group by r, t, label, need, span having count(*) filter (behind) / need >= {coverage}),
summed as (
  select r, count(start) as n_base, min(start) as first_word, max(start) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(share) as score from (select * from whole union all select * from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0.0), 9)::double as score
from docs left join summed using (r)"""
