"""Small tables from files: completion markers, mounts, disc listings, probe documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import DISC_EXTENSIONS, needs_frame_probe

MARKER = "source_size bigint, duration_secs double, completed_at timestamp"


def read_markers(spark: SparkSession, path: str, suffix: str = ".complete") -> DataFrame:
    """output, source_size, duration_secs, completed_at of the marker files below
    ``path``; files that aren't markers are left out."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    m = texts.select(_file().alias("file"), F.from_json("value", MARKER, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssX"}).alias("m"))
    return m.where("m.source_size is not null").select(F.expr(f"left(file, char_length(file) - {len(suffix)})").alias("output"), "m.*")


def read_mounts(spark: SparkSession, path: str = "/proc/mounts") -> DataFrame:
    """device, mount_point, fs_type; lines with fewer fields are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 3).select(parts[0].alias("device"), F.replace(parts[1], F.lit("\\040"), F.lit(" ")).alias("mount_point"), parts[2].alias("fs_type"))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """item_id and raw, one captured document a file. The id is the document's path below
    ``path`` without .json, as its file's path is below the library's root."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return texts.select(F.regexp_replace(_below(path), "[.]json$", "").alias("item_id"), F.col("value").alias("raw"))


def _file() -> Column:
    """The path of the file that is read; Spark gives it as a URI."""
    return F.url_decode(F.replace(F.regexp_replace(F.input_file_name(), "^file:/*", "/"), F.lit("+"), F.lit("%2B")))


def _below(path: str) -> Column:
    """The path of the file that is read, below a folder."""
    top = path.rstrip("/") + "/"
    file = _file()
    return file.substr(F.position(F.lit(top), file) + len(top), F.char_length(file))


def read_disc_probes(spark: SparkSession, path: str) -> DataFrame:
    """disc, inner_path and raw of documents of files within discs, kept below ``path`` as
    disc/inner/path.json, where disc is the image's path below the library's root."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    name = F.regexp_replace(_below(path), "[.]json$", "")
    image = "^(.*?[.](?i:" + "|".join(DISC_EXTENSIONS) + "))/(.+)$"
    return texts.select(F.regexp_extract(name, image, 1).alias("disc"), F.regexp_extract(name, image, 2).alias("inner_path"), F.col("value").alias("raw")).where("inner_path != ''")


def read_frames(info: DataFrame, path: str, key: str = "item_id") -> DataFrame:
    """``info`` with frames_json, the first-frame document of items whose header calls for
    one, null for others and where there is none. Documents are at ``path``/key.json;
    only those asked for are opened, each in the task that has its item. Needs a folder
    that all executors see."""
    asked = info.where(needs_frame_probe(F.col("master_display"), F.col("max_cll"), F.col("color_transfer"), F.col("color_primaries"))).select(key).distinct()

    def opened(batches):
        for batch in batches:
            texts = []
            for name in batch.column(0).to_pylist():
                try:
                    with open(f"{path}/{name}.json", encoding="utf-8", errors="replace") as f:
                        texts.append(f.read())
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "frames_json"])

    kind = dict(info.dtypes)[key]
    return info.join(asked.mapInArrow(opened, f"`{key}` {kind}, frames_json string"), key, "left")


LISTING = "disc string, inner_path string, name string, is_directory boolean, size bigint"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Disc listings, JSON lines of disc, inner_path, is_directory and size; a missing
    name is the path's last part, a missing size 0. Rows without a disc or path, and
    lines that aren't JSON, are left out."""
    rows = spark.read.schema(LISTING).json(path).where("disc is not null and inner_path is not null")
    return rows.select("disc", "inner_path", F.coalesce("name", F.element_at(F.split("inner_path", "/"), -1)).alias("name"), F.coalesce("is_directory", F.lit(False)).alias("is_directory"), F.coalesce("size", F.lit(0)).alias("size"))


def network_mount(paths: DataFrame, mounts: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with the type of the network file system they are on, else null."""
    from ..functions.predicates import is_network_fs
    from ..operators.joins import longest_prefix

    m = mounts.select("mount_point", "fs_type").groupBy("mount_point").agg(F.max("fs_type").alias("fs_type"))
    on = longest_prefix(paths, m, path, "mount_point", [path])
    return on.withColumn("network_fs", F.when(is_network_fs(F.col("fs_type")), F.col("fs_type"))).drop("mount_point", "fs_type")
