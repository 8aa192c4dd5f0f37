from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from filmstrip.config import ConfigError, Target, parse
from filmstrip.functions import errors, predicates, scalars
from filmstrip.operators import folds, outputs, probe


def values(spark, rows, ddl, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*exprs).collect()]


def one(spark, rows, ddl, expr):
    return [r[0] for r in values(spark, rows, ddl, expr)]


K, M, G = 1024, 1024**2, 1024**3


def test_sizes(spark):
    cases = [(0, "0KB"), (100, "0KB"), (1023, "1KB"), (512 * K, "512KB"), (M - 1, "1024KB"), (M, "1MB"), (500 * M, "500MB"), (G - 1, "1024MB"), (G, "1.0GB"), (2 * G, "2.0GB"), (1500 * G, "1500.0GB")]
    assert one(spark, [(n,) for n, _ in cases], "n bigint", scalars.format_size(F.col("n"))) == [s for _, s in cases]


def test_years(spark):
    cases = [("The Maltese Falcon (1941).iso", 1941), ("Movie Title (2003) [1080p].mkv", 2003), ("Movie.Title.1933.iso", 1933), ("Movie 1965 - rerelease 2020.iso", 1965)]
    cases += [(x, None) for x in ("Movie.1080p.HEVC.iso", "Movie.4096.iso", "Movie20031234.iso", "foo120030.iso", "Movie.1899.iso", "Movie.2100.iso", "MOVIE_DISC.iso", "", "abc")]
    assert one(spark, [(s,) for s, _ in cases], "s string", scalars.parse_year(F.col("s"))) == [y for _, y in cases]


def test_rationals(spark):
    cases = [("13250/50000", 13250), ("1/2", 25000), ("garbage", None), ("1/0", None)]
    assert one(spark, [(s,) for s, _ in cases], "s string", scalars.rational_scaled(F.col("s"), 50000)) == [v for _, v in cases]


def test_names_and_bars(spark):
    assert one(spark, [("a" * 40, 10), ("abc", 0), ("abcdef", 1), ("映" * 10, 10)], "s string, w int", scalars.truncate_name(F.col("s"), F.col("w"))) == ["aaaaaaaa..", "", "a", "映" * 10]
    bars = one(spark, [(0.0,), (0.5,), (1.0,), (2.5,)], "x double", scalars.progress_bar(F.col("x"), 10))
    assert bars[0].startswith(">") and bars[1].startswith("=====") and bars[2:] == ["=" * 10] * 2


def test_times(spark):
    assert one(spark, [(0,), (1700000000,)], "s bigint", scalars.iso8601(F.col("s"))) == ["1970-01-01T00:00:00Z", "2023-11-14T22:13:20Z"]
    assert one(spark, [(3661,)], "s bigint", scalars.elapsed(F.col("s"))) == ["01:01:01"]
    assert one(spark, [(30000,), (250,), (1500,)], "s bigint", scalars.format_timeout(F.col("s"))) == ["30s", "250ms", "1.500s"]


def test_titles_and_paths(spark):
    assert one(spark, [(x,) for x in ("VTS_01_1.VOB", "vts_02_3.vob", "VTS_01_0.VOB", "VIDEO_TS.VOB", "RANDOM.VOB")], "s string", scalars.vts_title(F.col("s"))) == ["01", "02", None, None, None]
    p = F.col("p")
    rows = [("/mnt/media/show/episode.mkv",), ("/m/film.avi",), (".mkv",)]
    assert one(spark, rows, "p string", outputs.output_path(p, "mkv")) == ["/mnt/media/show/episode.transcoded.mkv", "/m/film.transcoded.mkv", ".mkv.transcoded.mkv"]
    assert one(spark, rows[:1], "p string", outputs.output_path(p, "mkv", "/out")) == ["/out/episode.mkv"]
    assert one(spark, [("/media/Show S01D01.iso",)], "p string", outputs.output_stem(p, F.lit("title02"))) == ["/media/Show S01D01.title02.iso"]
    assert one(spark, rows, "p string", scalars.ext_lower(p)) == ["mkv", "avi", ""]


def test_targets(spark):
    rows = [("hevc", 1280, 720, 800), ("h264", 1280, 720, 800), ("hevc", 7680, 4320, 800)]
    meets = lambda m: predicates.meets_target(*map(F.col, "abcd"), max_kbps=m)
    ddl = "a string, b int, c int, d int"
    assert one(spark, rows, ddl, meets(0)) == [True, False, False]
    assert one(spark, rows[:1], ddl, meets(500)) == [False] and one(spark, rows[:1], ddl, meets(1000)) == [True]
    assert one(spark, [(x,) for x in ("yuv420p10le", "p010le", "yuv444p10be", "yuv420p", "nv12")], "p string", predicates.is_10bit(F.col("p"))) == [True] * 3 + [False] * 2
    assert one(spark, [(x,) for x in (0.04, 0.999, 1.0, 1.5, 0.0, -1.0)], "d double", predicates.is_too_short(F.col("d"), 1.0)) == [True, True] + [False] * 4


def test_devices(spark):
    names = ["NVIDIA GeForce GTX 750 Ti", "geforce gtx 980", "GTX 1060", "RTX 2060", "GTX 1660", "A100"]
    assert one(spark, [(x,) for x in names], "n string", predicates.supports_10bit(F.col("n"))) == [False] * 3 + [True] * 3
    rows = [("nvidia", "NVIDIA GeForce RTX 2060"), ("nvidia", "A100-SXM4"), ("intel", "x"), ("apple", "y")]
    assert one(spark, rows, "k string, n string", predicates.max_sessions(F.col("k"), F.col("n"))) == [3, 4, 2, 2]


def test_error_classes(spark):
    c = F.col("s")
    texts = ["Cannot init NVENC encoder", "Subtitle encoding currently only possible from text to text or bitmap to bitmap", "Could not find tag for codec hdmv_pgs_subtitle", "Disk quota exceeded", "No wav codec tag found for codec pcm_dvd", "some random error"]
    got = values(spark, [(t,) for t in texts], "s string", errors.is_session_limit(c), errors.is_subtitle(c), errors.is_audio_copy(c), errors.is_disk_space(c))
    assert got == [(True, False, False, False), (False, True, False, False), (False, True, False, False), (False, False, False, True), (False, False, True, False), (False,) * 4]


def test_summaries(spark):
    log = "frame= 1\n[mod @ 0x1] Could not write header\n[mod @ 0x2] Could not write header\n\n[x @ 0x3] Invalid thing  \nConversion failed!\n"
    rows = [(log,), ("step one\nstep two\nstep three\nstep four",), ("",), ("e error\nd error\nc error\nb error\na error",)]
    assert one(spark, rows, "s string", errors.summary(F.col("s"))) == ["[mod @ 0x1] Could not write header | [x @ 0x3] Invalid thing", "step two | step three | step four", "unknown error", "e error | d error | c error | b error"]


def test_ramp_actions(spark):
    big = 2**64 - 1
    cases = [((2, 3, 100, 0), "wait"), ((2, 2, 0, 0), "wait"), ((0, 0, 0, 0), "wait"), ((2, 2, 100, 0), "ramp-up"), ((3, 3, 150, 100), "ramp-up"), ((3, 3, 100, 100), "stall"), ((3, 3, 90, 100), "stall"), ((3, 3, 85, 100), "stall"), ((3, 3, 80, 100), "stall-revert"), ((3, 3, 10, 1000), "stall-revert"), ((1, 1, 1, big), "stall-revert"), ((1, 1, big, 100), "ramp-up")]
    from decimal import Decimal

    rows = [(a, b, Decimal(c), Decimal(d)) for (a, b, c, d), _ in cases]
    assert one(spark, rows, "a int, b int, c decimal(20,0), d decimal(20,0)", folds.ramp_action(*map(F.col, "abcd"))) == [x for _, x in cases]


def test_retry_sequences(spark):
    session, sub, disk = "OpenEncodeSessionEx failed", "Subtitle codec 1 is not supported", "No space left on device"
    runs = {
        "audio": (["No wav codec tag found", "No wav codec tag found"], ["reencode-audio", "bail"]),
        "sub": ([sub] * 3, ["reencode-subtitles", "skip-subtitles", "bail"]),
        "session": ([session] * 7, ["session-limit"] * 5 + ["bail"]),
        "disk": ([disk] * 6, ["disk-space"] * 5 + ["bail"]),
        "nothing": (["Nothing was written into output file"] * 8, ["reencode-subtitles", "skip-subtitles"] + ["session-limit"] * 5 + ["bail"]),
    }
    rows = [(k, i, t) for k, (ts, _) in runs.items() for i, t in enumerate(ts)]
    got = folds.retry_fold(spark.createDataFrame(rows, "k string, i int, s string"), ["k"], ["i"], folds.failure_bits(F.col("s")))
    assert {r.k: r.decisions for r in got.collect()} == {k: d for k, (_, d) in runs.items()}


def test_ramp_fold(spark):
    rows = [("r", 0, 1, 100), ("r", 1000, 2, 150), ("r", 6000, 2, 150), ("r", 12000, 3, 120), ("r", 18000, 2, 500)]
    r = folds.ramp_fold(spark.createDataFrame(rows, "k string, t int, n int, v int"), ["k"], at=F.col("t"), reporting=F.col("n"), total=F.col("v")).first()
    assert (r.actions, r.final_max, r.baseline, r.ramping) == (["ramp-up", "wait", "ramp-up", "stall-revert", "off"], 2, 150, False)


def test_probe_documents(spark):
    doc = """{"streams":[{"codec_type":"video","codec_name":"hevc","width":1920,"height":1080,"pix_fmt":"yuv420p10le","color_primaries":"unknown","color_transfer":"smpte2084",
      "side_data_list":[{"side_data_type":"Mastering display metadata","green_x":"13250/50000","green_y":"34500/50000","blue_x":"7500/50000","blue_y":"3000/50000","red_x":"34000/50000","red_y":"16000/50000","white_point_x":"15635/50000","white_point_y":"16450/50000","max_luminance":"40000000/10000","min_luminance":"1/10000"},{"side_data_type":"Content light level metadata","max_content":4000,"max_average":1000}]},
      {"codec_type":"audio","codec_name":"dts","channels":6,"bit_rate":"1509000","disposition":{"default":1,"comment":0}},
      {"codec_type":"audio","codec_name":"ac3","channels":2,"tags":{"BPS":"192000"},"disposition":{"default":0,"comment":1}}],"format":{"bit_rate":"8000999","duration":"12.5"}}"""
    info = probe.media_info(spark.createDataFrame([("a", doc), ("b", "junk"), ("c", '{"streams":[],"format":{}}'), ("d", None)], "item_id string, raw string"))
    r = {x.item_id: x for x in info.collect()}
    a = r["a"]
    assert a.error is None and (a.codec, a.bitrate_kbps, a.duration_secs, a.color_primaries, a.color_transfer) == ("hevc", 8000, 12.5, None, "smpte2084")
    assert a.master_display == "G(13250,34500)B(7500,3000)R(34000,16000)WP(15635,16450)L(40000000,1)" and a.max_cll == "4000,1000"
    assert [(s["index"], s.bitrate_kbps, s.is_default, s.is_comment) for s in a.audio_streams] == [(0, 1509, True, False), (1, 192, False, True)]
    assert r["b"].error and r["c"].error == "no video stream found" and r["d"].error
    assert probe.audio_rows(info.where("item_id = 'a'")).count() == 2


def test_arguments(spark):
    row = spark.createDataFrame([("bt2020", None, "m", "l")], "p string, t string, m string, l string")
    color = F.struct(F.col("p").alias("color_primaries"), F.col("t").alias("color_transfer"), F.col("t").alias("color_space"), F.col("t").alias("color_range"), F.col("m").alias("master_display"), F.col("l").alias("max_cll"))
    r = row.select(outputs.color_args(color, F.lit("nvidia")).alias("n"), outputs.color_args(color, F.lit("intel")).alias("i"), outputs.video_args(F.lit("nvidia"), F.lit(800), F.lit(True), Target()).alias("v"), outputs.audio_map(F.lit(None).cast("int")).alias("a"), outputs.audio_map(F.lit(2)).alias("b")).first()
    assert r.n == ["-color_primaries", "bt2020", "-master_display", "m", "-max_cll", "l"] and r.i == ["-color_primaries", "bt2020"]
    assert r.v == "-c:v hevc_nvenc -preset p7 -rc vbr -cq 20 -maxrate 800k -bufsize 1600k -b:v 0 -pix_fmt p010le".split()
    assert (r.a, r.b) == (["-map", "0:a:0?"], ["-map", "0:a:2"])


def test_config():
    c = parse("target:\n  quality: 25 # comment\n  container: 'mp4'\nmedia_extensions:\n  - .MKV\nskip_ambiguous_audio: yes\nunknown: 1\n")
    assert (c.target.quality, c.target.container, c.media_extensions, c.skip_ambiguous_audio) == (25, "mp4", ("mkv",), True)
    with pytest.raises(ConfigError, match="line 2"):
        parse("target:\n  quality: high\n")
    with pytest.raises(ConfigError, match="line 1"):
        parse("nonsense")


def test_retry_fold_gathers_no_more_than_it_needs(spark):
    kinds = ["disk", "audio", "subtitle", "session"]
    rows = [(k, i, kinds[(i // (k + 1)) % 4]) for k in range(2) for i in range(500)] + [(2, i, "disk" if i < 5 else "audio" if i < 6 else "subtitle" if i < 8 else "session") for i in range(500)]
    bits = F.struct(*[(F.col("s") == k).alias(k) for k in kinds])
    got = folds.retry_fold(spark.createDataFrame(rows, "k int, i int, s string").repartition(3), ["k"], ["i"], bits)
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()
    out = {g.k: g for g in got.collect()}
    assert out[2].decisions == ["disk-space"] * 5 + ["reencode-audio", "reencode-subtitles", "skip-subtitles"] + ["session-limit"] * 5 + ["bail"]
    assert out[0].decisions == ["disk-space", "reencode-audio", "reencode-subtitles", "session-limit", "disk-space", "bail"]
    assert all(g.gave_up for g in out.values())
