"""Joins of items with what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str, keys: list[str]) -> DataFrame:
    """Left join of each path with the longest prefix that is the path itself or ends
    at one of its slashes. The prefixes that can match are the path's own ancestors, so
    this is an equality join however many prefixes there are."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.concat(F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, F.lit("")).otherwise(F.lit("")))).otherwise(F.array_join(F.slice(parts, 1, i + 1), "/")))
    up = paths.select(*keys, path, F.explode(F.array_distinct(F.concat(ups, F.array(F.col(path), F.lit("/"))))).alias("_up"))
    known = prefixes.withColumn("_up", F.when(F.col(prefix) == "/", F.lit("/")).otherwise(F.regexp_replace(prefix, "/+$", "")))
    hit = up.join(known, "_up").where(F.col(path).startswith(F.col("_up")))
    best = hit.groupBy(*keys).agg(F.max(F.struct(F.length(prefix).alias("_n"), prefix, *[c for c in prefixes.columns if c != prefix])).alias("_b"))
    return paths.join(best, keys, "left").select(*paths.columns, *[F.col("_b")[c].alias(c) for c in prefixes.columns])


def resumable(outputs: DataFrame, markers: DataFrame, key: list[str], current_size: str, marked_size: str) -> DataFrame:
    """Outputs with a marker whose source size is the present one (semi-join)."""
    m = markers.select(*[F.col(k).alias(f"_m_{k}") for k in key], F.col(marked_size).alias("_size"))
    on = [F.col(k) == F.col(f"_m_{k}") for k in key] + [F.col(current_size) == F.col("_size")]
    return outputs.join(m, on, "left_semi")


def to_encode(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return items.join(done, key, "left_anti")


def missing(wanted: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys that are wanted and don't exist yet."""
    return wanted.select(*key).distinct().join(existing.select(*key), key, "left_anti")


def total_sizes(items: DataFrame, sizes: DataFrame, item: str, parts: str, part_key: str, size: str) -> DataFrame:
    """Per item the sum of its parts' sizes; parts without one add nothing."""
    each = items.select(item, F.explode_outer(parts).alias(part_key))
    return each.join(sizes, part_key, "left").groupBy(item).agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))


def destination(path: Column, output_dir: str | None, in_place: Column) -> Column:
    """The directory that will be written to."""
    from ..functions.scalars import parent

    here = F.coalesce(F.nullif(parent(path), F.lit("")), F.lit("."))
    return here if output_dir is None else F.when(in_place, here).otherwise(F.lit(output_dir))


def unwritable(items: DataFrame, dirs: DataFrame, path: str = "path", output_dir: str | None = None, in_place: Column | None = None) -> DataFrame:
    """``items`` with dest_dir and unwritable; a directory nobody asked about counts as
    writable. The join is the cache: each directory is checked once."""
    dest = destination(F.col(path), output_dir, F.lit(True) if in_place is None else in_place)
    d = dirs.select(F.col("dir").alias("dest_dir"), F.col("writable").alias("_w")).dropDuplicates(["dest_dir"])
    return items.withColumn("dest_dir", dest).join(d, "dest_dir", "left").withColumn("unwritable", ~F.coalesce("_w", F.lit(True))).drop("_w")


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
