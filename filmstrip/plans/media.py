"""Registered queries whose media come from the given tables: probe documents, disc
listings, output plans, devices, made of columns that the SQL sees as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Target
from ..functions import predicates, scalars
from ..operators import disc, outputs, probe
from .catalog import cents, query, table

_SIDE = ["side_data_type", "red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y", "white_point_x", "white_point_y", "min_luminance", "max_luminance", "max_content", "max_average"]


def _side(**values: Column) -> Column:
    kind = lambda n: "int" if n in ("max_content", "max_average") else "string"
    return F.struct(*[values.get(n, F.lit(None)).cast(kind(n)).alias(n) for n in _SIDE])


def _display(green_y: Column, red_x: Column) -> Column:
    """Mastering metadata as a probe writes it."""
    of = lambda n: F.lit(f"{n}/50000")
    return _side(side_data_type=F.lit("Mastering display metadata"), red_x=red_x, red_y=of(16000), green_x=of(13250), green_y=green_y, blue_x=of(7500), blue_y=of(3000), white_point_x=of(15635), white_point_y=of(16450), min_luminance=F.lit("50/10000"), max_luminance=F.lit("10000000/10000"))


def _light(content: Column, average: Column) -> Column:
    return _side(side_data_type=F.lit("Content light level metadata"), max_content=content, max_average=average)


_STREAM = {"codec_type": "string", "codec_name": "string", "width": "int", "height": "int", "pix_fmt": "string", "color_primaries": "string", "color_transfer": "string", "channels": "int", "bit_rate": "string", "side_data_list": probe.SIDE_DATA, "tags": "struct<BPS:string,language:string,title:string>", "disposition": "struct<`default`:int,comment:int>"}


def _stream(**values) -> Column:
    return F.struct(*[(values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in _STREAM.items()])


def probe_docs(spark, sf_dir) -> DataFrame:
    """p_partkey, raw, frames_json: a captured document per part; some are junk, some
    without video, and every field is missing somewhere. Parts are few bytes and their
    documents many, so parts are dealt over tasks first."""
    key, none, size = F.col("p_partkey"), F.lit(None), F.col("p_size")
    side = F.when(key % 8 == 0, F.filter(F.array(_display(F.when(key % 16 != 0, F.lit("34500/50000")), F.concat(key.cast("string"), F.lit("/50000"))), F.when(key % 3 == 0, _light(F.lit(1000), key % 400))), lambda x: x.isNotNull()))
    video = _stream(
        codec_type=F.lit("video"),
        codec_name=F.when(key % 3 == 0, "hevc").when(key % 3 == 1, "h264"),
        width=size * 100,
        height=size * 50,
        pix_fmt=F.when(key % 4 == 0, "yuv420p10le"),
        color_primaries=F.element_at(F.array(F.lit("unknown"), F.lit(" bt709 "), F.lit(""), F.lit("Unspecified"), F.lit("bt2020"), none), (key % 6 + 1).cast("int")),
        color_transfer=F.when(key % 7 == 0, "smpte2084"),
        side_data_list=side,
        tags=F.struct(F.when(key % 5 == 0, " 12 ").when(key % 2 == 0, (cents("p_retailprice") * 10).cast("string")).alias("BPS"), none.cast("string").alias("language"), none.cast("string").alias("title")),
    )
    tags = lambda bps, language, title: F.struct(bps.cast("string").alias("BPS"), language.cast("string").alias("language"), title.cast("string").alias("title"))
    flags = lambda d, c: F.struct(F.lit(d).alias("default"), F.lit(c).alias("comment"))
    first = _stream(codec_type=F.lit("audio"), codec_name=F.lit("ac3"), channels=F.lit(2), bit_rate=F.when(key % 9 != 3, "192000"), tags=tags(none, F.lit("eng"), none), disposition=flags(1, 0))
    second = _stream(codec_type=F.lit("audio"), codec_name=F.lit("dts"), channels=F.lit(6), tags=tags(F.lit("1509000"), none, F.lit("Director's Commentary")), disposition=flags(0, 1))
    blind = key % 13 == 0
    streams = F.filter(F.array(F.when(~blind, video), F.when((key % 3 != 1) | blind, first), F.when(key % 9 == 0, second), F.when(key % 10 == 0, _stream(codec_type=F.lit("subtitle")))), lambda x: x.isNotNull())
    about = F.struct(F.when(key % 7 != 0, (key * 1000 + 999).cast("string")).alias("bit_rate"), F.when(key % 11 == 0, "N/A").otherwise(F.concat(size.cast("string"), F.lit(".5"))).alias("duration"))
    raw = F.when(key % 17 == 0, "no JSON").otherwise(F.to_json(F.struct(streams.alias("streams"), about.alias("format"))))
    frames = F.to_json(F.struct(F.array(F.struct(F.array(_display(F.lit("1/2"), F.lit("1/4")), _light(F.lit(4000), key % 7)).alias("side_data_list"))).alias("frames")))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").repartition("p_partkey")
    return parts.select("p_partkey", raw.alias("raw"), F.when(key % 9 == 0, frames).alias("frames_json"))


_DOCS_SQL = """
d AS (SELECT p_partkey, p_partkey AS k, p_size, CAST(round(p_retailprice * 100) AS BIGINT) * 10 AS bps, p_partkey % 17 = 0 AS junk, p_partkey % 13 = 0 AND p_partkey % 17 <> 0 AS blind FROM part)
"""


@query(f"""
WITH {_DOCS_SQL}, h AS (SELECT *, NOT junk AND NOT blind AS ok,
  CASE WHEN NOT junk AND NOT blind AND k % 8 = 0 AND k % 16 <> 0 THEN 'G(13250,34500)B(7500,3000)R(' || k || ',16000)WP(15635,16450)L(10000000,50)' END AS md,
  CASE WHEN NOT junk AND NOT blind AND k % 24 = 0 THEN '1000,' || (k % 400) END AS cll,
  CASE WHEN NOT junk AND NOT blind THEN CASE k % 6 WHEN 1 THEN 'bt709' WHEN 4 THEN 'bt2020' END END AS cp,
  CASE WHEN NOT junk AND NOT blind AND k % 7 = 0 THEN 'smpte2084' END AS ct FROM d),
f AS (SELECT *, k % 9 = 0 AND (md IS NULL OR cll IS NULL) AND (ct IS NOT NULL OR coalesce(cp = 'bt2020', false) OR cp IS NULL) AS ask FROM h)
SELECT p_partkey, CASE WHEN junk THEN 'unreadable probe document' WHEN blind THEN 'no video stream found' END AS error,
  CASE WHEN ok AND k % 3 = 0 THEN 'hevc' WHEN ok AND k % 3 = 1 THEN 'h264' ELSE 'unknown' END AS codec,
  CAST(CASE WHEN ok THEN p_size * 100 ELSE 0 END AS INTEGER) AS width, CAST(CASE WHEN ok THEN p_size * 50 ELSE 0 END AS INTEGER) AS height,
  CAST(CASE WHEN junk THEN 0 WHEN ok AND k % 5 <> 0 AND k % 2 = 0 THEN bps // 1000 WHEN k % 7 <> 0 THEN (k * 1000 + 999) // 1000 ELSE 0 END AS BIGINT) AS bitrate_kbps,
  CAST(CASE WHEN junk OR k % 11 = 0 THEN 0 ELSE p_size + 0.5 END AS DOUBLE) AS duration_secs,
  CASE WHEN ok AND k % 4 = 0 THEN 'yuv420p10le' ELSE 'unknown' END AS pix_fmt,
  NOT junk AND (k % 3 <> 1 OR blind) AS has_audio, NOT junk AND k % 10 = 0 AS has_subtitles, cp AS color_primaries, ct AS color_transfer,
  coalesce(md, CASE WHEN ask THEN 'G(13250,25000)B(7500,3000)R(12500,16000)WP(15635,16450)L(10000000,50)' END) AS master_display,
  coalesce(cll, CASE WHEN ask THEN '4000,' || (k % 7) END) AS max_cll
FROM f
""")
def probe_documents(spark, sf_dir):
    info = probe.media_info(probe_docs(spark, sf_dir), frames_col="frames_json")
    info = info.withColumn("color", probe.color(info))
    return info.select("p_partkey", "error", "codec", "width", "height", "bitrate_kbps", "duration_secs", "pix_fmt", "has_audio", "has_subtitles", "color.color_primaries", "color.color_transfer", "color.master_display", "color.max_cll")


@query(f"""
WITH {_DOCS_SQL}
SELECT p_partkey, 0 AS idx, 'ac3' AS codec, 2 AS channels, CAST(CASE WHEN k % 9 <> 3 THEN 192 ELSE 0 END AS BIGINT) AS bitrate_kbps, 'eng' AS language, NULL AS title, true AS is_default, false AS is_comment, false AS commentary FROM d WHERE NOT junk AND (k % 3 <> 1 OR blind)
UNION ALL SELECT p_partkey, CASE WHEN k % 3 <> 1 OR blind THEN 1 ELSE 0 END, 'dts', 6, 1509, NULL, 'Director''s Commentary', false, true, true FROM d WHERE NOT junk AND k % 9 = 0
""")
def probe_audio(spark, sf_dir):
    rows = probe.audio_rows(probe.media_info(probe_docs(spark, sf_dir)), "p_partkey")
    return rows.withColumn("commentary", predicates.looks_like_commentary(F.col("is_comment"), F.col("title")))


def listing(spark, sf_dir) -> DataFrame:
    """disc, inner_path, name, is_directory, size: twenty parts make a disc, of a type by
    its number; two of seven are encrypted."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 20).alias("d"), (cents("p_retailprice") * F.col("p_size")).alias("size"))
    k, t = F.col("k").cast("string"), F.col("d") % 7
    dvd = F.concat(F.lit("VIDEO_TS/VTS_"), F.lpad((F.col("k") % 4 + 1).cast("string"), 2, "0"), F.lit("_"), (F.col("k") % 5).cast("string"), F.lit(".VOB"))
    bare = F.when(F.col("k") % 3 == 0, F.concat(F.lit("movies/m"), k, F.lit(".mkv"))).when(F.col("k") % 3 == 1, F.concat(F.lit("readme"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("v"), k, F.lit(".MP4")))
    path = F.when(t == 1, dvd).when(t == 2, F.concat(F.lit("PRIVATE/AVCHD/BDMV/STREAM/"), k, F.lit(".MTS"))).when(t == 3, bare).when(t == 4, F.concat(F.lit("STREAM/"), k, F.lit(".m2ts"))).otherwise(F.concat(F.lit("BDMV/STREAM/"), k, F.lit(".m2ts")))
    name = F.concat(F.lit("lib/D"), F.col("d").cast("string"), F.lit(".iso"))
    files = p.select(name.alias("disc"), path.alias("inner_path"), F.lit(False).alias("is_directory"), "size")
    folders = F.when(t.isin(0, 5, 6), F.array(F.lit("BDMV"), F.lit("BDMV/STREAM"), F.when(t == 5, "AACS").when(t == 6, "bdsvm"))).when(t == 1, F.array(F.lit("VIDEO_TS"))).when(t == 2, F.array(F.lit("PRIVATE/AVCHD/BDMV/STREAM"))).when(t == 3, F.array(F.lit("movies"))).otherwise(F.array(F.lit("Stream")))
    dirs = p.select("d").distinct().select(name.alias("disc"), F.explode(F.array_compact(folders)).alias("inner_path"), F.lit(True).alias("is_directory"), F.lit(0).cast("long").alias("size"))
    return files.union(dirs).withColumn("name", scalars.file_name(F.col("inner_path")))


_TYPES = "CASE d % 7 WHEN 0 THEN 'Bluray' WHEN 1 THEN 'Dvd' WHEN 2 THEN 'Avchd' WHEN 3 THEN 'BareMedia' WHEN 4 THEN 'BlurayFlat' ELSE 'Encrypted' END"


@query(f"""
SELECT DISTINCT 'lib/D' || d || '.iso' AS disc, {_TYPES} AS disc_type, CASE d % 7 WHEN 5 THEN 'AACS encryption' WHEN 6 THEN 'BD+ encryption' END AS reason FROM (SELECT p_partkey // 20 AS d FROM part)
""")
def disc_types(spark, sf_dir):
    return disc.disc_types(listing(spark, sf_dir))


_FILES_SQL = f"""
WITH p AS (SELECT p_partkey AS k, p_partkey // 20 AS d, CAST(round(p_retailprice * 100) AS BIGINT) * p_size AS size FROM part),
f AS (SELECT *, 'lib/D' || d || '.iso' AS disc, {_TYPES} AS disc_type, CASE WHEN d % 7 = 1 AND k % 5 <> 0 THEN '0' || (k % 4 + 1) END AS title_set,
  CASE d % 7 WHEN 1 THEN 'VIDEO_TS/VTS_0' || (k % 4 + 1) || '_' || (k % 5) || '.VOB' WHEN 2 THEN 'PRIVATE/AVCHD/BDMV/STREAM/' || k || '.MTS'
    WHEN 3 THEN CASE k % 3 WHEN 0 THEN 'movies/m' || k || '.mkv' ELSE 'v' || k || '.MP4' END WHEN 4 THEN 'STREAM/' || k || '.m2ts' ELSE 'BDMV/STREAM/' || k || '.m2ts' END AS inner_path
  FROM p WHERE d % 7 < 5 AND NOT (d % 7 = 3 AND k % 3 = 1)),
s AS (SELECT disc, title_set, sum(size) AS n FROM f WHERE title_set IS NOT NULL GROUP BY ALL),
m AS (SELECT disc, title_set, row_number() OVER (PARTITION BY disc ORDER BY title_set) AS r, count(*) OVER (PARTITION BY disc) AS c FROM (SELECT *, max(n) OVER (PARTITION BY disc) AS top FROM s) WHERE n >= top * 80 // 100),
a AS (SELECT f.disc, disc_type, inner_path, CAST(size AS BIGINT) AS size, f.title_set,
  CASE WHEN CASE d % 7 WHEN 1 THEN r IS NOT NULL WHEN 2 THEN true ELSE size >= max(size) OVER (PARTITION BY f.disc) // 4 END THEN 'main' ELSE 'extra' END AS role,
  CASE WHEN c > 1 THEN 'title0' || r END AS title FROM f LEFT JOIN m ON f.disc = m.disc AND f.title_set = m.title_set)
"""


@query(_FILES_SQL + "SELECT * FROM a")
def disc_files(spark, sf_dir):
    return disc.analyze(listing(spark, sf_dir))


@query(_FILES_SQL + """
SELECT 's' || s_suppkey || '.mkv' AS path, NULL AS iso_path, NULL AS inner_path, NULL AS inner_paths, NULL AS title_suffix FROM supplier
UNION ALL SELECT disc, disc, arg_min(inner_path, (coalesce(title_set, ''), inner_path)), CASE WHEN count(*) > 1 THEN string_agg(inner_path, '|' ORDER BY title_set, inner_path) END, title FROM a WHERE role = 'main' GROUP BY disc, title
""")
def disc_items(spark, sf_dir):
    """Files and discs as the titles that are to be encoded."""
    discs = listing(spark, sf_dir)
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".mkv")).alias("path")).union(discs.select("disc").distinct())
    return disc.scan_items(files, disc.analyze(discs)).withColumn("inner_paths", F.array_join("inner_paths", "|"))


@query(_FILES_SQL + "SELECT disc, inner_path, size, CAST(row_number() OVER (PARTITION BY disc ORDER BY size DESC, inner_path) AS INTEGER) AS place FROM a WHERE role = 'extra'")
def disc_extras(spark, sf_dir):
    return disc.extras(disc.analyze(listing(spark, sf_dir)))


@query("""
WITH c AS (SELECT c_custkey AS k, '/lib/' || c_mktsegment AS dir, c_name AS n, CASE c_custkey % 4 WHEN 0 THEN '.mkv' WHEN 1 THEN '.avi' WHEN 2 THEN '' ELSE '.iso' END AS ext, c_custkey % 3 = 0 AS t FROM customer),
s AS (SELECT *, n || CASE WHEN t AND ext <> '' THEN '.title02' ELSE '' END AS stem FROM c)
SELECT k AS c_custkey, dir || '/' || stem || '.transcoded.mkv' AS beside, '/out/' || stem || '.mkv' AS apart, CASE WHEN ext = '.iso' THEN dir || '/' || stem || '.transcoded.mkv' END AS resolved, dir || '/' || stem || '.transcoded.mkv.complete' AS marker,
  n || ext || CASE WHEN ext = '.iso' THEN CASE WHEN t THEN ' [title02]' ELSE '' END || ':a.m2ts' ELSE '' END AS shown,
  '-map 0:a:' || CASE WHEN k % 2 = 0 THEN CAST(k % 5 AS VARCHAR) ELSE '0?' END AS audio,
  CASE WHEN k % 7 = 0 THEN '' WHEN k % 5 = 0 THEN '-c:s ' || CASE WHEN k % 4 = 1 THEN 'mov_text' ELSE 'srt' END ELSE '-c:s copy' END AS subtitles,
  CASE k % 3 WHEN 0 THEN '-c:v hevc_nvenc -preset p7 -rc vbr -cq 20' WHEN 1 THEN '-vaapi_device /dev/dri/renderD128 -c:v hevc_vaapi -global_quality 20' ELSE '-c:v hevc_videotoolbox -q:v 20' END
    || CASE WHEN k % 11 > 0 THEN ' -maxrate ' || (k % 11) || 'k -bufsize ' || (k % 11 * 2) || 'k' ELSE '' END
    || CASE k % 3 WHEN 0 THEN ' -b:v 0' || CASE WHEN k % 2 = 0 THEN ' -pix_fmt p010le' ELSE '' END WHEN 1 THEN ' -vf format=' || CASE WHEN k % 2 = 0 THEN 'p010le' ELSE 'nv12' END || ',hwupload' ELSE '' END AS video,
  trim(CASE WHEN k % 2 = 0 THEN '-color_primaries bt2020' ELSE '' END || CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN ' -max_cll 1000,400' ELSE '' END) AS colors
FROM s
""")
def output_plan(spark, sf_dir):
    """Output paths, names, markers and encoder arguments of titles."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ext = F.when(k % 4 == 0, ".mkv").when(k % 4 == 1, ".avi").when(k % 4 == 2, "").otherwise(".iso")
    path = F.concat(F.lit("/lib/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), ext)
    title = F.when(k % 3 == 0, "title02")
    c = c.select("c_custkey", path.alias("path"), title.alias("title"), F.when(k % 3 == 0, "nvidia").when(k % 3 == 1, "intel").otherwise("apple").alias("gpu"))
    target, none = Target(), F.lit(None).cast("string")
    beside = outputs.output_path(outputs.output_stem(F.col("path"), F.col("title")), "mkv")
    color = F.struct(F.when(k % 2 == 0, "bt2020").alias("color_primaries"), none.alias("color_transfer"), none.alias("color_space"), none.alias("color_range"), none.alias("master_display"), F.when(k % 5 == 0, "1000,400").alias("max_cll"))
    is_disc = predicates.is_disc_image(F.col("path"))
    words = lambda a: F.array_join(a, " ")
    return c.select(
        "c_custkey",
        beside.alias("beside"),
        outputs.output_path(outputs.output_stem(F.col("path"), F.col("title")), "mkv", "/out/").alias("apart"),
        outputs.resolved_output(F.col("path"), F.col("title"), is_disc, target, True, None).alias("resolved"),
        outputs.marker_path(beside).alias("marker"),
        outputs.display_name(F.col("path"), F.when(is_disc, "x/a.m2ts"), F.lit(None).cast("array<string>"), F.col("title")).alias("shown"),
        words(outputs.audio_map(F.when(k % 2 == 0, k % 5))).alias("audio"),
        words(outputs.subtitle_args(target, k % 7 == 0, F.when(k % 5 == 0, outputs.subtitle_fallback(F.when(k % 4 == 1, "mp4").otherwise("mkv"))))).alias("subtitles"),
        words(outputs.video_args(F.col("gpu"), k % 11, k % 2 == 0, target)).alias("video"),
        words(outputs.color_args(color, F.col("gpu"))).alias("colors"),
    )


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey * 1000 END AS src, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_orderkey END AS out,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'hevc' END AS codec, o_orderkey % 100 AS a, o_orderkey % 97 AS b FROM orders),
r AS (SELECT *, CASE WHEN codec IS NULL THEN 'probe cannot read output file' WHEN codec = 'unknown' THEN 'Output has no recognizable video codec'
    WHEN a > 0 AND b > 0 AND abs(a - b) > 5 THEN 'Duration mismatch: source ' || a || '.0s vs output ' || b || '.0s (diff ' || abs(a - b) || '.0s)' END AS late,
  CASE WHEN out IS NULL THEN 'Output file does not exist' WHEN out = 0 THEN 'Output file is empty' END AS early FROM o)
SELECT o_orderkey, coalesce(early, CASE WHEN src IS NULL THEN 'Source file disappeared' WHEN out < src // 100 THEN 'Output file is suspiciously small (' || out || ' bytes vs ' || src || ' bytes source)' ELSE late END) AS file_reason, coalesce(early, late) AS disc_reason FROM r
""")
def output_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    out = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, 0).otherwise(k).cast("long")
    src = F.when(k % 11 > 0, F.col("o_custkey") * 1000)
    codec = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "unknown").otherwise("hevc")
    times = (k % 100).cast("double"), (k % 97).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", predicates.invalid_output(out, src, codec, *times).alias("file_reason"), predicates.invalid_output(out, src, codec, *times, disc=True).alias("disc_reason"))


_NAMES = ["NVIDIA GeForce RTX 2060", "A100-SXM4", "Quadro RTX 4000", "NVIDIA GeForce GTX 1080 Ti", "GeForce gtx 970"]
_FS = ["nfs", "nfs4", "ext4", "cifs", "fuse.sshfs", "nfs.x", "nfsx"]


@query("""
SELECT s_suppkey, CASE k % 3 WHEN 0 THEN CASE WHEN k % 5 IN (1, 2) THEN 4 ELSE 3 END ELSE 2 END AS sessions, k % 5 < 3 AS ten_bit,
  CASE WHEN k % 2 = 0 THEN 'nvidia' WHEN k % 3 = 0 THEN 'intel' WHEN k % 5 = 0 THEN 'apple' END AS device,
  CASE WHEN k % 4 = 0 THEN 'not-found' WHEN k % 3 = 0 THEN 'broken' WHEN k % 5 = 0 THEN 'encoder-missing' ELSE 'ready' END AS state,
  k % 7 NOT IN (2, 6) AS network, k % 6 IN (0, 1, 2, 4) AS wide, k % 3 = 0 AS is_disc,
  CASE k % 4 WHEN 0 THEN 'killed by signal 9 (SIGKILL) (no output)' WHEN 1 THEN 'killed by signal 40 (no output)' WHEN 2 THEN 'exit code ' || k || ' (no output)' ELSE 'terminated abnormally (no output)' END AS ended,
  CASE WHEN k % 2 = 0 THEN 'last ' || k WHEN k % 3 = 0 THEN 'out' ELSE 'exit code 1 (no output)' END AS told
FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)
""")
def devices(spark, sf_dir):
    """What devices can do, file systems, and how processes ended."""
    k = F.col("s_suppkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    name = pick(_NAMES)
    stderr = F.when(k % 2 == 0, F.concat(F.lit("first\nlast "), k.cast("string"), F.lit(" \n \n")))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        predicates.max_sessions(F.when(k % 3 == 0, "nvidia").otherwise("intel"), F.regexp_replace(name, "^NVIDIA ", "")).alias("sessions"),
        predicates.supports_10bit(name).alias("ten_bit"),
        predicates.gpu_kind(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("device"),
        predicates.encoder_state(k % 4 != 0, k % 3 != 0, k % 5 != 0).alias("state"),
        predicates.is_network_fs(pick(_FS)).alias("network"),
        predicates.is_10bit(pick(["yuv420p10le", "p010le", "yuv444p12be", "yuv420p", "yuv444p10be", "nv12"])).alias("wide"),
        predicates.is_disc_image(F.concat(F.lit("a/b."), pick(["ISO", "mkv", ""]))).alias("is_disc"),
        scalars.exit_status(F.when(k % 4 == 2, k), F.when(k % 4 == 0, 9).when(k % 4 == 1, 40)).alias("ended"),
        scalars.last_line(stderr, F.when(k % 3 == 0, "\nout\n"), F.lit(1), F.lit(None).cast("int")).alias("told"),
    )


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey AS k FROM orders)
SELECT o_orderkey, CASE WHEN k * 250 >= 1000 AND k * 250 % 1000 = 0 THEN (k // 4) || 's' WHEN k * 250 < 1000 THEN (k * 250) || 'ms' ELSE (k // 4) || CASE k % 4 WHEN 1 THEN '.250s' WHEN 2 THEN '.500s' ELSE '.750s' END END AS timeout,
  CASE WHEN k % 3 > 0 THEN CAST(k % 90 AS VARCHAR) END AS title, greatest(k % 200 - 44, 20) AS width,
  CASE WHEN k // 3600 < 10 THEN '0' ELSE '' END || (k // 3600) || ':' || right('0' || (k // 60 % 60), 2) || ':' || right('0' || (k % 60), 2) AS elapsed,
  CASE WHEN k % 2 = 0 THEN k % 50 * 100 + 25 END AS speed, CASE WHEN k % 2 = 1 THEN least(1000, k * 100000 // (50 * 1000)) END AS permille,
  CASE WHEN k % 5 = 0 THEN '?' WHEN k * 1000 >= 1048576 THEN (k * 1000 // 1048576) || ' MB' WHEN k * 1000 >= 1024 THEN (k * 1000 // 1024) || ' KB' ELSE (k * 1000) || ' B' END AS label,
  CASE WHEN k % 3 = 0 THEN 'libcuda.so.' || k END AS library, 'it broke ' || k AS short
FROM o
""")
def report_texts(spark, sf_dir):
    """Timeouts, title numbers, widths, times, progress lines and messages."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    line = F.when(k % 2 == 0, F.concat(F.lit("speed= "), (k % 50).cast("string"), F.lit(".25x"))).otherwise(F.concat(F.lit("out_time_us="), (k * 100000).cast("string")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalars.format_timeout(k * 250).alias("timeout"),
        scalars.vts_title(F.concat(F.lit("vts_"), (k % 90).cast("string"), F.lit("_"), (k % 3).cast("string"), F.lit(".vob"))).alias("title"),
        scalars.name_width(k % 200).alias("width"),
        scalars.elapsed(k).alias("elapsed"),
        scalars.progress_speed(line).alias("speed"),
        scalars.progress_permille(line, F.lit(50.0)).alias("permille"),
        scalars.size_label(F.when(k % 5 != 0, k * 1000)).alias("label"),
        scalars.missing_library(F.when(k % 3 == 0, F.concat(F.lit("cannot open libcuda.so."), text, F.lit(": no"))).otherwise("fine")).alias("library"),
        scalars.short_error(F.concat(F.when(k % 2 == 0, "[hevc @ 0x1] ").otherwise(" Error: "), F.lit("it broke "), text)).alias("short"),
    )
