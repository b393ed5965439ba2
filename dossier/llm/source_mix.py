"""Mixing sources to target weights: random order, prefix sums, and a cut at each source's exact budget.

Weights go to the sources in code-point order. Targets share the total size by weight; no target exceeds
``max_epochs`` times its source, and the excess is shared again until none does. Inside a source the documents stand
in the order of a hash of their id and text. The source's target is as many whole epochs as fit, and a last partial
epoch that takes documents in that order and cuts the last one at the budget, so the words taken equal the target
rounded to a whole word.

Order and prefix sums are distributed: the hash range of a source is cut into ranges of about ``bucket_rows``
documents, ranges are summed, and only the range sums are accumulated along the source. A source with a third of all
rows has as many ranges as its size asks for.

Null texts have size 0 and are taken 0 times. A null source is a source of its own, last in order. Repeated rows are
separate documents; rows that tie in the order are equal in id and size, so the result is one multiset on every run.
Null ids stand before others of the same hash. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.tables import stored
from dossier.llm.words import count_words


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        count_words(F.col("text")).alias("size"),
        F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), "text")).alias("key"),
    )


def weighted_sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source with its size, rows and weight; the rank that deals the weights is a distributed one."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = F.col("source").asc_nulls_last()
    sources = stored(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sources.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    return sources.join(parts, "part").select(
        "source", "source_size", "rows", F.get(cycle, (rank % len(weights)).cast("int")).alias("weight")
    )


def with_targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Raise the common level until no source that is still below its ceiling would pass it."""
    ceiling = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0

    def above(level: float) -> Column:
        return ceiling.cast("double") < F.lit(level) * F.col("weight")

    level, full = 0.0, -1
    while True:
        capped = above(level)
        taken, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(capped, ceiling)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(capped.cast("long")), F.lit(0)),
        ).first()
        if n == full or not weight:
            break
        level, full = float(total - taken) / weight, n
    target = F.when(above(level), ceiling.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target)


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, bucket_rows: int = 5_000
) -> DataFrame:
    """doc_id, source, size, source_size, target and words taken of every document."""
    sized = stored(sized_documents(docs), "mix-sizes")
    sources = stored(with_targets(stored(weighted_sources(sized, weights), "mix-weights"), max_epochs), "mix-targets")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("rows") / F.lit(bucket_rows))
    s = sources.withColumnRenamed("source", "of_source")
    placed = sized.join(s, F.col("source").eqNullSafe(F.col("of_source"))).withColumn(
        "range", F.shiftright(place * ranges, 32)
    )
    sums = placed.groupBy("of_source", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("of_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("of_source").alias("s_source"),
        F.col("range").alias("s_range"),
        F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("before_range"),
    )
    inside = (
        Window.partitionBy("of_source", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordered = placed.withColumn("up_to", F.sum("size").over(inside))
    joined = ordered.join(
        sums, F.col("of_source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range"))
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    before = F.col("before_range") + F.col("up_to") - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - before))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


SQL = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(' ', CAST(doc_id AS VARCHAR), text)) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS nth,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM sources),
levels AS (
  SELECT nth, CAST(total - 3 * coalesce(sum(source_size) OVER before, 0) AS DOUBLE)
              / (all_weight - coalesce(sum(weight) OVER before, 0)) AS level,
         3.0 * source_size AS ceiling, weight
  FROM filled WINDOW before AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT level FROM levels WHERE CAST(ceiling AS DOUBLE) >= level * weight ORDER BY nth LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN CAST(3 * source_size AS DOUBLE) < (SELECT level FROM found) * weight THEN CAST(3 * source_size AS DOUBLE)
              ELSE (SELECT level FROM found) * weight END AS target
  FROM sources),
ordered AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size
              + least(size, greatest(0, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM ordered
"""
