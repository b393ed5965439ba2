"""Order-independent digests over large sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_HEX = 5


def sorted_digest(df: DataFrame, group: list[str], sort_id: str, line: Column, header: Column | None = None) -> DataFrame:
    """Two-level sha256 of the lines of a group: equal exactly when the sets of lines are equal.

    ``sort_id`` is a hex digest, so its first hex digits cut a group into evenly sized
    buckets whose order is the order of the ids. Every bucket gives the sha256 of its sorted
    lines, joined by newline; the digest is that of the header and the buckets' digests in
    order. It is the same function for a group of any size, and no task holds a whole group.
    Output: group, lines, digest.
    """
    keyed = df.select(*group, F.col(sort_id).alias("__id"), line.alias("__line"))
    buckets = (
        keyed.groupBy(*group, F.substring("__id", 1, BUCKET_HEX).alias("__bucket"))
        .agg(F.sort_array(F.collect_list(F.struct("__id", "__line"))).alias("__rows"))
        .select(
            *group,
            F.size("__rows").cast("long").alias("__lines"),
            F.struct(
                "__bucket",
                F.sha2(F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n"), 256).alias("payload"),
            ).alias("__part"),
        )
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list("__part")), lambda p: p["payload"]), "\n")
    out = buckets.groupBy(*group).agg(F.sum("__lines").alias("lines"), body.alias("__body"))
    text = F.col("__body") if header is None else F.concat_ws("\n", header, F.col("__body"))
    return out.select(*group, "lines", F.sha2(text, 256).alias("digest"))
