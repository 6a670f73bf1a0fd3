"""Mixing sources to target weights by systematic sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Expected copies are whole multiples of 1/2**26: sums are exact, in any order and engine, to 4e10 documents a source.
ONE = 1 << 26
#: Hash parts of a size class: a third of all rows in one source still falls into hundreds of cells.
SPREAD = 64


def word_count(text):
    """Number of runs without the six ASCII white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``.

    Sources by code point, null last, take ``weights`` in turn and share the total of all sizes. No target is above
    ``limit`` times its source's size; what is above is shared out again by weight. With sources ordered by
    limit * size / weight, the capped ones are a prefix: source k is capped if its cap is at most its share of
    what the prefix leaves. Windows run over one row for each source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("long"))
    per = per.withColumn("cap", limit * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.select(
        "source", "source_size", "weight", "cap",
        (F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weights"),
        F.row_number().over(order).alias("nth"),
    )
    # the first source whose cap exceeds its share, and with it all later ones, is not capped
    free = F.col("cap") * F.col("weights") > F.col("left") * F.col("weight")
    whole = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(free, F.struct("nth", "left", "weights"))).over(whole)
    per = per.withColumn("first", first)
    share = (F.col("first.left") * F.col("weight")).cast("double") / F.col("first.weights")
    capped = F.col("first").isNull() | (F.col("nth") < F.col("first.nth"))
    return per.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` and the columns named in ``carry``, a row for each row of ``docs``.

    Every document of a source expects target / source_size copies, ``limit`` at most. Expected copies are
    prefix-summed within the source, one random offset (from ``seed`` and the source's name) is added, and the
    document is emitted once for each integer boundary its interval crosses. The order within a source is by size
    class, a hash of doc_id, size and doc_id, so that the sample is spread over sizes and words come near the target.

    A source is never one group: a prefix sum runs within (size class, hash) cells, and the cells' totals, a
    bounded array for each source, are summed by array functions and joined back.

    Null text has size 0, a null source is one source, null doc_ids come first among equals, repeated rows count
    as often as they occur (which of two equal rows is taken is the same result); no rows give no rows.
    """
    source = F.col("source").cast("string")
    digits = F.col("size").cast("string")
    klass = F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int")
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int") % SPREAD

    def sized(*more):
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), word_count(F.col("text").cast("string")).alias("size"), *more)
        return own.withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))).withColumn("cell", klass * SPREAD + spread)

    # texts are counted once; what follows reads a few numbers for each document
    slim = Scratch(docs.sparkSession, "mix").write(sized())
    base = sized(F.struct(*carry).alias("_carry")) if carry else slim
    targets = source_targets(slim.select("source", "size"), weights, limit)
    targets = targets.withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))).drop("source")
    cells = slim.groupBy("group", "cell").agg(F.count("*").alias("n"))
    cells = cells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(F.lit(0)).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "group").cast("binary")), 1, 6), 16, 10).cast("long") * (ONE >> 24)
    start = F.expr(
        "aggregate(cells, named_struct('n', 0L, 'out', cast(array() as array<struct<cell:int,before:bigint>>)), "
        "(s, c) -> named_struct('n', s.n + c.n, 'out', array_append(s.out, named_struct('cell', c.cell, 'before', s.n)))).out"
    )
    plan = cells.join(targets, "group").select("group", "source_size", "target", step.alias("step"), offset.alias("offset"), F.inline(start))
    within = Window.partitionBy("group", "cell").orderBy("size", F.col("doc_id").asc_nulls_first())
    rows = base.withColumn("nth", F.row_number().over(within)).join(plan, ["group", "cell"])
    end = (F.col("before") + F.col("nth")) * F.col("step") + F.col("offset")
    rows = rows.withColumn("copies", F.shiftright(end, 26) - F.shiftright(end - F.col("step"), 26))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_carry.{c}").alias(f"_{c}") for c in carry])


def sql(weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 7, table: str = "documents") -> str:
    """The same in SQL, with one ordinary prefix sum for each source."""
    weight = "case " + " ".join(f"when nth % {len(weights)} = {i} then {w}" for i, w in enumerate(weights)) + " end"
    order = f"'{seed}:' || coalesce('s' || source, '-')"
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from {table}),
named as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as nth from sized group by source),
weighed as (select source, source_size, {weight}::bigint as weight, {limit} * source_size as cap from named),
ranked as (select *, row_number() over (order by cap / weight, source nulls last) as k, sum(source_size) over ()::bigint as total from weighed),
rest as (
  select *, (total - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))::bigint as free,
    (sum(weight) over (order by k rows between current row and unbounded following))::bigint as weights from ranked),
first_free as (select * from rest where cap * weights > free * weight order by k limit 1),
targets as (
  select r.source, r.source_size, case when f.k is null or r.k < f.k then r.cap::double else (f.free * r.weight)::double / f.weights end as target
  from rest r left join first_free f on true),
steps as (
  select *, case when source_size > 0 then floor(target / source_size * {ONE})::bigint else 0 end as step,
    ('0x' || substr(md5({order}), 1, 6))::bigint * {ONE >> 24} as shift from targets),
cells as (
  select *, (length(size::varchar) * 10 + substr(size::varchar, 1, 1)::int) * {SPREAD}
    + ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 2))::int % {SPREAD} as cell from sized),
ends as (
  select doc_id, size, source_size, target, step,
    row_number() over (partition by c.source order by cell, size, doc_id nulls first) * step + shift as e
  from cells c join steps s on c.source is not distinct from s.source)
select doc_id, size, source_size, target, ((e >> 26) - ((e - step) >> 26)) * size as taken from ends"""


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; the columns stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text", "source")}
    rows = mix(plain.select(*[c.alias(k) for k, c in own.items()], *names), weights, limit, seed, carry=tuple(names))
    rows = rows.where("copies > 0").select("copies", *[f"_{n}" for n in names])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(f"_{n}").alias(c) for n, c in zip(names, docs.columns)])
