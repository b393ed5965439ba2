"""Neighbour and percentile operators that stay balanced when one key owns most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILE_ACCURACY = 10_000


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, fields: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: a struct of ``fields`` of the following row of the same key (null at the end).

    ``bucket`` must not decrease along ``order`` (a truncated time, say). Rows are sorted
    inside (key, bucket); across buckets only the first row of each bucket is passed on, so a
    key with a third of all rows is spread over its buckets.
    """
    row = F.struct(*fields)
    keyed = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    inner = keyed.withColumn("__lead", F.lead(row).over(inside))
    heads = keyed.groupBy(*keys, "__bucket").agg(F.min_by(row, F.struct(*order)).alias("__head"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    following = heads.select(*keys, "__bucket", F.lead("__head").over(across).alias("__follow"))
    return (
        inner.join(following, [*keys, "__bucket"])
        .withColumn(name, F.coalesce("__lead", "__follow"))
        .drop("__bucket", "__lead", "__follow")
    )


def as_of(
    asked: DataFrame, known: DataFrame, keys: Sequence[str], asked_at: str, known_at: str, bucket, value: Sequence[str], name: str
) -> DataFrame:
    """Add ``name``: a struct of ``value`` from the last ``known`` row at or before each ``asked`` row.

    Both sides are merged in time order and the last known row is carried forward, inside
    (key, bucket) first and then, for the start of a bucket, from the last known row of the
    buckets before. ``bucket`` maps a time column to a value that does not decrease with it.
    No pairs are formed and a busy key is spread over its buckets.
    """
    row = F.struct(*value)
    kind = known.select(row.alias("v")).schema["v"].dataType
    rest = [c for c in asked.columns if c not in (*keys, asked_at)]
    carried = F.struct(*rest) if rest else F.struct(F.lit(1).alias("__none"))
    carried_kind = asked.select(carried.alias("v")).schema["v"].dataType
    left = asked.select(*keys, F.col(asked_at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__v"), carried.alias("__a"))
    right = known.select(*keys, F.col(known_at).alias("__t"), F.lit(0).alias("__side"), row.alias("__v"), F.lit(None).cast(carried_kind).alias("__a"))
    merged = left.unionByName(right).withColumn("__b", bucket(F.col("__t")))
    inside = Window.partitionBy(*keys, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    near = merged.withColumn("__near", F.last("__v", ignorenulls=True).over(inside))
    ends = merged.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "__b", F.last("__end", ignorenulls=True).over(across).alias("__far"))
    out = near.where("__side = 1").join(before, [*keys, "__b"])
    return out.select(*keys, F.col("__t").alias(asked_at), *[F.col(f"__a.{c}").alias(c) for c in rest], F.coalesce("__near", "__far").alias(name))


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group, with count and maximum.

    A first pass brackets each quantile with approximate ranks; a second pass counts the
    values below the bracket and sorts only the distinct values inside it. Groups of up to
    PERCENTILE_ACCURACY rows are their own bracket.
    """
    group = list(group)
    margin = 3.0 / PERCENTILE_ACCURACY
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    names = list(quantiles)
    marks = [p for n in names for p in (max(0.0, quantiles[n] - margin), min(1.0, quantiles[n] + margin))]
    stats = rows.groupBy(*group).agg(
        F.count("*").alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", marks, PERCENTILE_ACCURACY).alias("__marks"),
    )
    small = F.col("__n") <= PERCENTILE_ACCURACY
    ask = stats.select(
        *group,
        "__n",
        "__max",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("__name"),
                        ((F.col("__n") - 1) * F.lit(float(quantiles[n]))).alias("__pos"),
                        F.when(small, F.col("__min")).otherwise(F.col("__marks")[2 * i]).alias("__lo"),
                        F.when(small, F.col("__max")).otherwise(F.col("__marks")[2 * i + 1]).alias("__hi"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        ).alias("__ask"),
    ).select(*group, "__n", "__max", "__ask.*")
    # One row per distinct value first: repeated values are combined before the shuffle.
    counted = rows.groupBy(*group, "__v").agg(F.count("*").alias("__c"))
    key = group or ["__one"]
    if not group:
        # Without groups there is exactly one row per quantile to hand to every task.
        counted, ask = counted.withColumn("__one", F.lit(1)), F.broadcast(ask.withColumn("__one", F.lit(1)))
    met = counted.join(ask, key).where(F.col("__v") <= F.col("__hi"))
    below = (
        met.where(F.col("__v") < F.col("__lo")).groupBy(*key, "__name").agg(F.sum("__c").alias("__below"))
    )
    inside = met.where(F.col("__v") >= F.col("__lo")).join(below, [*key, "__name"], "left")
    running = F.sum("__c").over(
        Window.partitionBy(*key, "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ) + F.coalesce("__below", F.lit(0))
    placed = inside.withColumn("__to", running)
    low = F.floor("__pos")
    at = lambda index: F.min(F.when(F.col("__to") > index, F.col("__v")))
    picked = placed.groupBy(*key, "__name", "__n", "__max", "__pos").agg(
        at(low).alias("__a"), at(F.least(low + 1, F.col("__n") - 1)).alias("__b")
    )
    part = F.col("__pos") - F.floor("__pos")
    result = picked.withColumn("__p", F.col("__a") * (1 - part) + F.col("__b") * part)
    return result.groupBy(*group).agg(
        F.first("__n").alias("samples"),
        F.first("__max").alias("max"),
        *[F.max(F.when(F.col("__name") == n, F.col("__p"))).alias(n) for n in names],
    )
