"""Disc images from their listings: type, main feature, extras, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ext_lower, vts_title

# Names on discs.
MEDIA = ["mkv", "mp4", "avi", "mov", "m4v", "wmv", "flv", "webm", "ts", "m2ts", "mts", "m2t", "mpg", "mpeg", "vob"]
STREAMS = ["m2ts", "m2t", "mts"]
DIRECTORIES = {"Bluray": "bdmv/stream", "Dvd": "video_ts", "Avchd": "private/avchd/bdmv/stream", "BlurayFlat": "stream"}
LOCKS = {"aacs": "AACS encryption", "bdsvm": "BD+ encryption"}


def entries(listing: DataFrame) -> DataFrame:
    """``listing`` (disc, inner_path, name, is_directory, size) with the parent's path
    and the extension, both in lower case."""
    return listing.withColumn("folder", F.lower(F.regexp_extract("inner_path", r"^(.*)/[^/]*$", 1))).withColumn("ext", ext_lower(F.col("name")))


def media_entries(listing: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    return entries(listing).where(~F.col("is_directory") & F.col("ext").isin(extensions or MEDIA))


def disc_types(listing: DataFrame) -> DataFrame:
    """disc, disc_type, reason: encryption first, then the directories in order; a flat
    stream directory only with a stream in it."""
    e = entries(listing)
    path = F.lower("inner_path")
    there = lambda c: F.max(F.coalesce(c, F.lit(False)))
    is_dir = F.col("is_directory")
    flags = [there(is_dir & (path == p)).alias(f"_{t}") for t, p in DIRECTORIES.items()]
    flags += [there(is_dir & (path == k)).alias(f"_{k}") for k in LOCKS]
    flags += [there(~is_dir & (F.col("folder") == "stream") & F.col("ext").isin(STREAMS)).alias("_flat")]
    d = e.groupBy("disc").agg(*flags)
    reason = None
    for k, text in LOCKS.items():
        reason = F.when(F.col(f"_{k}"), text) if reason is None else reason.when(F.col(f"_{k}"), text)
    kind = F.when(F.col("_aacs") | F.col("_bdsvm"), "Encrypted").when(F.col("_Bluray"), "Bluray").when(F.col("_Dvd"), "Dvd").when(F.col("_Avchd"), "Avchd").when(F.col("_BlurayFlat") & F.col("_flat"), "BlurayFlat").otherwise("BareMedia")
    return d.select("disc", kind.alias("disc_type"), reason.alias("reason"))


def share_of_largest(rows: DataFrame, group: list[str], size: Column, num: int, den: int, name: str = "is_main") -> DataFrame:
    """``rows`` with whether the size is at least num/den of its group's largest, in
    whole numbers."""
    largest = F.max(size).over(Window.partitionBy(*group))
    return rows.withColumn(name, size >= F.floor(largest * num / den))


def title_sets(rows: DataFrame, disc: list[str], title: Column, size: Column) -> DataFrame:
    """Sizes of title sets, and which are main: at least four fifths of the largest."""
    sums = rows.where(title.isNotNull()).groupBy(*disc, title.alias("title_set")).agg(F.sum(size).alias("set_size"), F.count(F.lit(1)).alias("n_files"))
    return share_of_largest(sums, disc, F.col("set_size"), 80, 100)


def numbered(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """title01, title02, ... by place, not by the set's own number."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("title", F.concat(F.lit("title"), F.lpad(place.cast("string"), 2, "0")))


def analyze(listing: DataFrame) -> DataFrame:
    """Per media file of a readable disc: disc, disc_type, inner_path, size, role (main
    or extra), title_set and title (discs with several main sets only)."""
    m = media_entries(listing).join(disc_types(listing), "disc").where("disc_type != 'Encrypted'")
    m = m.select("disc", "disc_type", "inner_path", "name", "size", "folder", "ext")
    kind = F.col("disc_type")
    blu = m.where(((kind == "Bluray") & (F.col("folder") == DIRECTORIES["Bluray"]) | (kind == "BlurayFlat") & (F.col("folder") == "stream")) & F.col("ext").isin(STREAMS))
    quarter = share_of_largest(blu.union(m.where(kind == "BareMedia")), ["disc"], F.col("size"), 1, 4).withColumn("title_set", F.lit(None).cast("string"))
    avchd = m.where((kind == "Avchd") & F.col("ext").isin(STREAMS)).withColumn("is_main", F.lit(True)).withColumn("title_set", F.lit(None).cast("string"))
    dvd = m.where((kind == "Dvd") & (F.col("folder") == DIRECTORIES["Dvd"]) & (F.col("ext") == "vob")).withColumn("title_set", vts_title(F.col("name")))
    sets = title_sets(dvd, ["disc"], F.col("title_set"), F.col("size")).where("is_main")
    sets = sets.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("disc")))
    sets = numbered(sets, ["disc"], ["title_set"]).select("disc", "title_set", F.lit(True).alias("is_main"), F.when(F.col("sets") > 1, F.col("title")).alias("title"))
    dvd = dvd.join(sets, ["disc", "title_set"], "left").withColumn("is_main", F.coalesce("is_main", F.lit(False)))
    plain = quarter.unionByName(avchd).withColumn("title", F.lit(None).cast("string"))
    out = plain.unionByName(dvd)
    return out.select("disc", "disc_type", "inner_path", "size", F.when(F.col("is_main"), "main").otherwise("extra").alias("role"), "title_set", "title")


def extras(analysis: DataFrame) -> DataFrame:
    """What isn't main, the largest first in each disc."""
    place = F.row_number().over(Window.partitionBy("disc").orderBy(F.desc("size"), "inner_path"))
    return analysis.where("role = 'extra'").select("disc", "inner_path", "size", place.alias("place"))


def unreadable(files: DataFrame, listing: DataFrame, analysis: DataFrame) -> DataFrame:
    """path, problem of the disc images among ``files`` that give no title: encrypted,
    without media, or without a listing."""
    from ..functions.predicates import is_disc_image

    discs = files.where(is_disc_image(F.col("path"))).select("path").distinct()
    good = analysis.where("role = 'main'").select(F.col("disc").alias("path"))
    types = disc_types(listing).select(F.col("disc").alias("path"), "disc_type", "reason")
    problem = F.when(F.col("disc_type").isNull(), "no listing of the disc").when(F.col("reason").isNotNull(), F.col("reason")).otherwise("no media on the disc")
    return discs.join(good, "path", "left_anti").join(types, "path", "left").select("path", problem.alias("problem"))


def scan_items(files: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row per title: path, iso_path, inner_path, inner_paths, title_suffix. Files
    that are no disc are themselves; a title's files are in order of set and path."""
    from ..functions.predicates import is_disc_image

    regular = files.where(~is_disc_image(F.col("path"))).select("path", F.lit(None).cast("string").alias("iso_path"), F.lit(None).cast("string").alias("inner_path"), F.lit(None).cast("array<string>").alias("inner_paths"), F.lit(None).cast("string").alias("title_suffix"))
    main = analysis.where("role = 'main'").groupBy("disc", "title").agg(F.array_sort(F.collect_list(F.struct("title_set", "inner_path"))).alias("f"))
    main = main.withColumn("paths", F.transform("f", lambda x: x["inner_path"]))
    discs = main.select(F.col("disc").alias("path"), F.col("disc").alias("iso_path"), F.get("paths", F.lit(0)).alias("inner_path"), F.when(F.size("paths") > 1, F.col("paths")).alias("inner_paths"), F.col("title").alias("title_suffix"))
    return regular.unionByName(discs)
