from __future__ import annotations

import json

from pyspark.sql import functions as F

from filmstrip import cli
from filmstrip.config import Config
from filmstrip.functions import errors, predicates
from filmstrip.operators import aggregates, disc, joins, rank
from filmstrip.plans import library
from filmstrip.sinks.tables import listed
from filmstrip.sources.tables import LISTING, network_mount, read_disc_probes, read_listing
from filmstrip.sources.walk import media_files, walk

AUDIO = "item string, idx int, channels int, kbps int, title string, is_default boolean, is_comment boolean, year int"


def test_primary_audio(spark):
    def s(item, idx, ch, kbps, title=None, default=False, comment=False, year=None):
        return (item, idx, ch, kbps, title, default, comment, year)

    rows = [
        s("single", 0, 2, 192), s("modern", 0, 6, 1509, year=2010), s("modern", 1, 2, 192, year=2010),
        s("flag", 0, 6, 1509, comment=True), s("flag", 1, 2, 192), s("title", 0, 6, 1509, "Director's Commentary"), s("title", 1, 2, 192),
        s("old", 0, 1, 192, year=1933), s("old", 1, 2, 192, year=1933), s("mono", 0, 1, 192, year=2010), s("mono", 1, 2, 192, year=2010),
        s("both", 0, 6, 1509, comment=True), s("both", 1, 2, 192, comment=True), s("rate", 0, 2, 256), s("rate", 1, 2, 192),
        s("default", 0, 2, 192), s("default", 1, 2, 192, default=True), s("tie", 0, 2, 192), s("tie", 1, 2, 192), s("lone", 0, 2, 192, comment=True),
    ]
    d = spark.createDataFrame(rows, AUDIO)
    p = rank.pick_primary(d, ["item"], idx=F.col("idx"), channels=F.col("channels"), bitrate=F.col("kbps"), commentary=predicates.looks_like_commentary(F.col("is_comment"), F.col("title")), default=F.col("is_default"), year=F.col("year"))
    got = {r.item: (r.primary_index, r.ambiguous) for r in p.collect()}
    assert got == {"single": (0, False), "modern": (0, False), "flag": (1, False), "title": (1, False), "old": (0, False), "mono": (1, False), "both": (0, True), "rate": (0, False), "default": (1, True), "tie": (0, True), "lone": (0, False)}


def _listing(spark):
    rows = []

    def add(d, folder, files, up=()):
        for u in up:
            rows.append((d, u, u.split("/")[-1], True, 0))
        rows.append((d, folder, folder.split("/")[-1], True, 0)) if folder else None
        rows.extend((d, f"{folder}/{n}" if folder else n, n.split("/")[-1], False, s) for n, s in files.items())

    add("BD", "BDMV/STREAM", {"00000.m2ts": 11250000, "00001.m2ts": 8437500, "00002.m2ts": 9375000, "00010.m2ts": 1500000, "00011.m2ts": 800000}, ["BDMV"])
    add("DVD", "VIDEO_TS", {"VTS_01_1.VOB": 3000000, "VTS_01_2.VOB": 3000000, "VTS_02_1.VOB": 750000, "VIDEO_TS.VOB": 75000, "VTS_01_0.IFO": 10})
    add("AVC", "PRIVATE/AVCHD/BDMV/STREAM", {"00000.MTS": 3750000, "00001.MTS": 3125000}, ["PRIVATE"])
    add("BARE", "", {"movie.mkv": 6000000, "bonus.mkv": 1250000})
    add("MULTI", "VIDEO_TS", {f"VTS_0{i}_1.VOB": 1562500 for i in (1, 2, 4)} | {"VIDEO_TS.VOB": 75000})
    add("FLAT", "STREAM", {"00000.m2ts": 6750000, "00010.m2ts": 750000})
    add("LOCKED", "BDMV/STREAM", {"00000.m2ts": 5}, ["BDMV", "aacs"])
    return spark.createDataFrame(rows, "disc string, inner_path string, name string, is_directory boolean, size bigint")


def test_discs(spark):
    listing = _listing(spark)
    kinds = {r.disc: r.disc_type for r in disc.disc_types(listing).collect()}
    assert kinds == {"BD": "Bluray", "DVD": "Dvd", "AVC": "Avchd", "BARE": "BareMedia", "MULTI": "Dvd", "FLAT": "BlurayFlat", "LOCKED": "Encrypted"}
    a = disc.analyze(listing).collect()
    main = {d: sorted((r.inner_path.split("/")[-1], r.title) for r in a if r.disc == d and r.role == "main") for d in kinds}
    assert [x for x, _ in main["BD"]] == ["00000.m2ts", "00001.m2ts", "00002.m2ts"] and [x for x, _ in main["AVC"]] == ["00000.MTS", "00001.MTS"]
    assert main["DVD"] == [("VTS_01_1.VOB", None), ("VTS_01_2.VOB", None)] and main["BARE"] == [("movie.mkv", None)] and main["LOCKED"] == []
    assert main["MULTI"] == [("VTS_01_1.VOB", "title01"), ("VTS_02_1.VOB", "title02"), ("VTS_04_1.VOB", "title03")]


def test_probe_parts(spark):
    rows = [("one", 0, 4000, 1500.0), ("max", 0, 2000, 500.0), ("max", 1, 8000, 500.0), ("bad", 0, 2000, 500.0), ("bad", 1, 600, 600.0), ("bad", 2, None, None)]
    d = spark.createDataFrame(rows, "k string, n int, b int, d double")
    got = aggregates.aggregate_probes(d, ["k"], order=F.col("n"), bitrate=F.col("b"), duration=F.col("d"))
    assert {r.k: (r.bitrate_kbps, r.duration_secs) for r in got.collect()} == {"one": (4000, 1500.0), "max": (8000, 1000.0), "bad": (2000, 1500.0)}


def test_longest_prefix_and_mounts(spark):
    p = spark.createDataFrame([("/mnt/nas/films/a",), ("/mnt/nasty/b",), ("/mnt/nas",), ("x",)], "path string")
    m = spark.createDataFrame([("a", "/", "ext4"), ("b", "/mnt/nas", "nfs4"), ("c", "/mnt/nas/films", "fuse.sshfs.x")], "device string, mount_point string, fs_type string")
    got = {r.path: r.network_fs for r in network_mount(p, m).collect()}
    assert got == {"/mnt/nas/films/a": "fuse.sshfs.x", "/mnt/nasty/b": None, "/mnt/nas": "nfs4", "x": None}


def test_scan(spark, tmp_path):
    for n in ("video.mkv", "video.MP4", "readme.txt", "s1/ep01.mkv", "e.transcoded.mkv", ".tmp_transcode_e.mkv", "movie.iso", "a-b/x.mkv", "a/b/x.mkv"):
        f = tmp_path / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    (tmp_path / "alias.mkv").symlink_to(tmp_path / "video.mkv")
    (tmp_path / "loop").symlink_to(tmp_path)
    got = [r.path.removeprefix(f"{tmp_path}/") for r in media_files(walk(spark, str(tmp_path)), ("mkv", "mp4")).collect()]
    assert got == ["a/b/x.mkv", "a-b/x.mkv", "alias.mkv", "movie.iso", "s1/ep01.mkv", "video.MP4"]
    assert media_files(walk(spark, str(tmp_path / "video.mkv")), ("mkv",)).count() == 1


def test_gate_order(spark):
    def doc(codec="h264", secs="100", fmt="yuv420p", streams=1):
        audio = ',{"codec_type":"audio","codec_name":"ac3","channels":2,"bit_rate":"192000"}' * streams
        return f'{{"streams":[{{"codec_type":"video","codec_name":"{codec}","width":1280,"height":720,"pix_fmt":"{fmt}"}}{audio}],"format":{{"bit_rate":"800000","duration":"{secs}"}}}}'

    docs = {"/m/a.mkv": doc(), "/m/short.mkv": doc(secs="0.5"), "/m/done.mkv": doc("hevc"), "/m/ten.mkv": doc(fmt="yuv420p10le"), "/m/resumed.mkv": doc(), "/ro/x.mkv": doc(), "/m/stale.mkv": doc()}
    files = spark.createDataFrame([(p, 1000) for p in [*docs, "/m/bad.mkv", "BD", "MULTI"]], "path string, size bigint").withColumn("path", F.when(F.col("path").isin("BD", "MULTI"), F.concat("path", F.lit(".iso"))).otherwise(F.col("path")))
    listing = _listing(spark).withColumn("disc", F.concat("disc", F.lit(".iso")))
    inner = [(r.disc, r.inner_path, doc(streams=2)) for r in disc.analyze(listing).collect() if r.disc in ("BD.iso", "MULTI.iso")]
    d = spark.createDataFrame([(p, None, x) for p, x in docs.items()] + inner, "path string, inner_path string, raw string")
    out = spark.createDataFrame([("/m/resumed.transcoded.mkv", 500, "hevc", 100.0), ("/m/stale.transcoded.mkv", 500, "hevc", 100.0)], "output string, size bigint, codec string, duration_secs double")
    marks = spark.createDataFrame([("/m/resumed.transcoded.mkv", 1000), ("/m/stale.transcoded.mkv", 999)], "output string, source_size bigint")
    dirs = spark.createDataFrame([("/m", True), ("/ro", False)], "dir string, writable boolean")
    p = library.plan(files, listing, d, out, marks, dirs, Config(skip_ambiguous_audio=False), has_10bit=False)
    got = {(r.path, r.title_suffix): r for r in p.collect()}
    kinds = {k[0]: r.outcome for k, r in got.items() if k[1] is None}
    assert kinds == {"/m/a.mkv": "transcode", "/m/short.mkv": "skip", "/m/done.mkv": "skip-silent", "/m/ten.mkv": "skip", "/m/resumed.mkv": "resumed", "/ro/x.mkv": "skip", "/m/stale.mkv": "transcode", "/m/bad.mkv": "probe-error", "BD.iso": "transcode"}
    assert got["BD.iso", None].duration_secs == 300.0 and got["BD.iso", None].source_size == 11250000 + 8437500 + 9375000 and got["BD.iso", None].primary_index == 0
    assert [got["MULTI.iso", f"title0{i}"].output for i in (1, 2, 3)] == [f"MULTI.title0{i}.transcoded.mkv" for i in (1, 2, 3)]
    strict = library.plan(files, listing, d, out, marks, dirs, Config(skip_ambiguous_audio=True), has_10bit=False)
    assert {r.reason for r in strict.where("path = 'BD.iso'").collect()} == {"ambiguous primary audio (top candidates tie on channels and bitrate)"}
    assert {r.path: r.reason for r in p.where("outcome = 'skip'").collect()} == {"/m/short.mkv": "duration too short (0.50s)", "/m/ten.mkv": "10-bit source, but the device has no 10-bit encoder", "/ro/x.mkv": "destination is not writable: /ro"}
    twice = library.plan(files, listing, d.union(d.where("path = '/m/a.mkv'")), out, marks, dirs, Config())
    assert [(r.outcome, r.reason) for r in twice.where("path = '/m/a.mkv'").collect()] == [("probe-error", "more than one probe document")]
    assert sum(r.n for r in library.report(p).collect()) == len(got)


def test_joins(spark):
    items = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", [])], "item string, parts array<string>")
    sizes = spark.createDataFrame([("x", 5), ("y", 7)], "part string, size bigint")
    assert {r.item: r.total_size for r in joins.total_sizes(items, sizes, "item", "parts", "part", "size").collect()} == {"a": 12, "b": 0, "c": 0}
    outs = spark.createDataFrame([("a", 1), ("b", 2)], "output string, size bigint")
    marks = spark.createDataFrame([("a", 1), ("b", 3)], "output string, source_size bigint")
    assert [r.output for r in joins.resumable(outs, marks, ["output"], "size", "source_size").collect()] == ["a"]


def test_discs_without_titles(spark):
    """Every image is accounted for: encrypted, empty, unlisted."""
    files = spark.createDataFrame([("a/lock.iso", 10), ("a/empty.img", 10), ("a/unlisted.ISO", 10), ("a/x.mkv", 10)], "path string, size bigint")
    listing = spark.createDataFrame([("a/lock.iso", "BDMV/STREAM", "STREAM", True, 0), ("a/lock.iso", "aacs", "aacs", True, 0), ("a/lock.iso", "BDMV/STREAM/1.m2ts", "1.m2ts", False, 5), ("a/empty.img", "readme.txt", "readme.txt", False, 5)], LISTING)
    none = lambda ddl: spark.createDataFrame([], ddl)
    p = library.plan(files, listing, none("path string, inner_path string, raw string"), none("output string, size bigint, codec string, duration_secs double"), none("output string, source_size bigint"), none("dir string, writable boolean"), Config())
    assert {r.path: (r.outcome, r.reason) for r in p.collect()} == {
        "a/lock.iso": ("probe-error", "AACS encryption"),
        "a/empty.img": ("probe-error", "no media on the disc"),
        "a/unlisted.ISO": ("probe-error", "no listing of the disc"),
        "a/x.mkv": ("probe-error", "no probe document"),
    }


def test_listing_and_disc_probe_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"disc":"a.iso","inner_path":"BDMV/STREAM","is_directory":true}\n{"disc":"a.iso","inner_path":"BDMV/STREAM/1.m2ts","size":7}\nbroken\n{"disc":"a.iso"}\n')
    got = sorted(tuple(r) for r in read_listing(spark, str(tmp_path / "l.json")).collect())
    assert got == [("a.iso", "BDMV/STREAM", "STREAM", True, 0), ("a.iso", "BDMV/STREAM/1.m2ts", "1.m2ts", False, 7)]
    at = tmp_path / "p" / "a.iso" / "BDMV" / "STREAM" / "1.m2ts.json"
    at.parent.mkdir(parents=True)
    at.write_text("{}")
    assert [tuple(r) for r in read_disc_probes(spark, str(tmp_path / "p")).collect()] == [("a.iso", "BDMV/STREAM/1.m2ts", "{}")]


def test_command_line(spark, tmp_path, capsys):
    """Every row is printed, discs and replacements too."""
    (tmp_path / "m").mkdir()
    (tmp_path / "p").mkdir()
    doc = '{"streams":[{"codec_type":"video","codec_name":"h264","width":640,"height":480}],"format":{"bit_rate":"800000","duration":"100"}}'
    for i in range(30):
        (tmp_path / "m" / f"f{i:02}.mkv").write_bytes(b"x" * 1000)
        (tmp_path / "p" / f"f{i:02}.mkv.json").write_text(doc)
    (tmp_path / "m" / "d.iso").write_bytes(b"x")
    (tmp_path / "o.json").write_text(json.dumps({"output": f"{tmp_path}/m/f03.transcoded.mkv", "size": 400, "codec": "hevc", "duration_secs": 100.0}) + "\n")
    assert cli.main([str(tmp_path / "m"), "--probes", str(tmp_path / "p"), "--outputs", str(tmp_path / "o.json"), "--replace"]) == 0
    out = capsys.readouterr().out
    assert all(f"/f{i:02}.mkv\t" in out for i in range(30)) and "no listing of the disc" in out and "\treplace\t" in out
    (tmp_path / "mounts").write_text(f"srv:/x {tmp_path} cifs rw\n")
    assert cli.main([str(tmp_path / "m"), "--probes", str(tmp_path / "p"), "--quiet", "--mounts", str(tmp_path / "mounts")]) == 0
    told = capsys.readouterr()
    assert "network file system (cifs)" in told.err and ".mkv" not in told.out and told.out.startswith("outcome\t")
    assert cli.main([str(tmp_path / "m"), "--outputs", str(tmp_path / "o.json"), "--list-outputs"]) == 0
    assert capsys.readouterr().out == f"{tmp_path}/m/f03.transcoded.mkv\n"


def test_documents_belong_to_paths(spark, tmp_path, capsys):
    """Files and discs of one name in two folders have their own documents."""
    doc = '{"streams":[{"codec_type":"video","codec_name":"%s","width":640,"height":480}],"format":{"bit_rate":"800000","duration":"100"}}'
    listing = []
    for show, codec in (("a b", "hevc"), ("c+d", "h264")):
        for name in ("ep01.mkv", "d.iso"):
            at = tmp_path / "m" / show / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(b"x" * 1000)
            inner = tmp_path / "i" / show / "d.iso/BDMV/STREAM/1.m2ts.json"
            inner.parent.mkdir(parents=True, exist_ok=True)
            inner.write_text(doc % codec)
            at = tmp_path / "p" / show / f"{name}.json"
            at.parent.mkdir(parents=True, exist_ok=True)
            if name == "ep01.mkv":
                at.write_text(doc % codec)
            else:
                listing += [{"disc": f"{tmp_path}/m/{show}/d.iso", "inner_path": "BDMV/STREAM", "is_directory": True}, {"disc": f"{tmp_path}/m/{show}/d.iso", "inner_path": "BDMV/STREAM/1.m2ts", "size": 700}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, listing)))
    assert cli.main([str(tmp_path / "m"), "--probes", str(tmp_path / "p"), "--disc-probes", str(tmp_path / "i"), "--listing", str(tmp_path / "l.json")]) == 0
    rows = [x.split("\t") for x in capsys.readouterr().out.splitlines() if x.startswith(str(tmp_path))]
    assert sorted((r[0].removeprefix(f"{tmp_path}/m/"), r[3]) for r in rows) == [("a b/d.iso", "skip-silent"), ("a b/ep01.mkv", "skip-silent"), ("c+d/d.iso", "transcode"), ("c+d/ep01.mkv", "transcode")]


def test_one_deep_folder_is_spread_over_rounds(spark, tmp_path):
    at = tmp_path / "top"
    for n in range(6):
        at = at / f"level{n}"
        for k in range(3):
            (at / f"side{k}").mkdir(parents=True)
            (at / f"side{k}" / "f.mkv").write_bytes(b"x" * (n + 1))
    (at / "back").symlink_to(tmp_path / "top")
    (tmp_path / "gone.mkv").symlink_to(tmp_path / "nowhere")
    got = walk(spark, str(tmp_path), per_task=1)
    rows = [(r.path, r.size) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 18 and sum(r[1] for r in rows) == 3 * 21
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert walk(spark, str(tmp_path / "top/level0/side0")).count() == 1
    assert walk(spark, str(tmp_path / "none")).count() == 0


def test_only_frames_asked_for_are_opened(spark, tmp_path):
    import os

    from filmstrip.operators import probe
    from filmstrip.sources.tables import read_frames

    doc = '{"streams":[{"codec_type":"video","codec_name":"hevc"%s}],"format":{}}'
    light = '{"frames":[{"side_data_list":[{"side_data_type":"Content light level metadata","max_content":%d,"max_average":7}]}]}'
    for n, name in enumerate(("hdr", "sdr", "unknown")):
        (tmp_path / f"{name}.json").write_text(light % n)
        os.utime(tmp_path / f"{name}.json", (1, 10**9))
    docs = [("hdr", doc % ',"color_transfer":"smpte2084"'), ("sdr", doc % ',"color_transfer":"bt709"'), ("unknown", doc % ""), ("none", doc % "")]
    info = probe.media_info(spark.createDataFrame(docs, "item_id string, raw string"))
    got = {r.item_id: r.max_cll for r in probe.with_frames(read_frames(info, str(tmp_path))).collect()}
    assert got == {"hdr": "0,7", "sdr": None, "unknown": "2,7", "none": None}
    read = {n for n in ("hdr", "sdr", "unknown") if (tmp_path / f"{n}.json").stat().st_atime > 1}
    assert "sdr" not in read
    assert {r.item_id for r in read_frames(info, str(tmp_path)).where("frames_json is not null").collect()} == {"hdr", "unknown"}


def test_one_file_may_be_an_artefact(spark, tmp_path):
    at = tmp_path / "a.transcoded.mkv"
    at.write_bytes(b"x")
    assert media_files(walk(spark, str(at)), ("mkv",), single=True).count() == 1
    assert media_files(walk(spark, str(tmp_path)), ("mkv",)).count() == 0


def test_finished_outputs(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "output string")
    assert [r.output for r in listed(df).collect()] == ["a", "b"]


def test_summary_looks_at_no_pair_of_lines(spark):
    """Lines are told apart by grouping: nothing in the expression looks for a line among
    the others, and a log of many lines is summed up all the same."""
    log = "\n".join(f"[mod @ {i}] error {'same' if i % 7 else i}" for i in range(20_000))
    df = spark.createDataFrame([(log,)] * 2, "log string").select(errors.summary(F.col("log")).alias("s"))
    assert {r.s for r in df.collect()} == {"[mod @ 0] error 0 | [mod @ 1] error same | [mod @ 7] error 7 | [mod @ 14] error 14"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan


def test_primary_sorts_once_and_in_parts_of_bounded_size(spark):
    rows = [("a", 0, 6, 9, True, False), ("a", 1, 2, 5, False, False), ("b", 0, 2, 5, False, True), ("b", 1, 2, 5, True, False), ("c", 0, 2, 5, None, True), ("c", 1, 2, 5, None, True), ("d", 0, 2, 5, True, True), ("d", 1, 6, 5, None, True), ("e", 0, 2, 5, False, False), ("e", 1, 2, 5, False, True), ("f", 3, 2, 5, None, True)]
    d = spark.createDataFrame(rows, "item string, idx int, channels int, kbps int, talk boolean, first boolean")
    spread = rank.dealt(d, ["item"], len(rows), per_task=2)
    assert spread.rdd.getNumPartitions() == 6 and rank.dealt(d, ["item"], len(rows)) is d
    p = rank.pick_primary(spread, ["item"], idx=F.col("idx"), channels=F.col("channels"), bitrate=F.col("kbps"), commentary=F.col("talk"), default=F.col("first"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    got = {r.item: tuple(r)[1:] for r in p.collect()}
    assert got == {"a": (1, 2, False, None), "b": (0, 2, False, None), "d": (1, 2, True, rank.ALL_COMMENTARY), "e": (1, 2, True, rank.TIED), "f": (3, 1, False, None)}
