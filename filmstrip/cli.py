"""Command line: the dry run over a folder of files and captured probe documents."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config, parse
from .functions.predicates import is_disc_image
from .plans import library
from .session import session
from .sinks.tables import listed, replacements
from .sources.tables import LISTING, network_mount, read_disc_probes, read_listing, read_markers, read_mounts, read_probes
from .sources.walk import media_files, walk


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("filmstrip", description="What is to be done in a media library.")
    p.add_argument("root", help="folder or file to look at")
    p.add_argument("--config", type=Path)
    p.add_argument("--dump-config", action="store_true")
    p.add_argument("--output-dir")
    p.add_argument("--no-overwrite", action="store_true")
    p.add_argument("--skip-ambiguous-audio", action="store_true")
    p.add_argument("--min-duration", type=float, default=1.0)
    p.add_argument("--probes", help="folder of captured probe documents, each at its file's path below the root, with .json")
    p.add_argument("--disc-probes", help="folder of captured documents of files within discs, disc's path below the root/inner/path.json")
    p.add_argument("--listing", help="disc listings, JSON lines of disc, inner_path, is_directory, size")
    p.add_argument("--outputs", help="finished outputs, JSON lines of output, size, codec, duration_secs")
    p.add_argument("--dirs", help="directories, JSON lines of dir, writable")
    p.add_argument("--mounts", default="/proc/mounts", help="mount table; a network mount is told of")
    p.add_argument("--replace", action="store_true", help="also list planned replacements")
    p.add_argument("--list-outputs", action="store_true", help="only list finished outputs, for a pipe")
    p.add_argument("--quiet", action="store_true", help="only the report, not each title")
    p.add_argument("--jobs", type=int, default=0, help="encodes at once, 0 for what the device allows")
    p.add_argument("--probe-timeout", type=float, default=30.0, help="seconds that a probe may take")
    return p.parse_args(argv)


def config(args: argparse.Namespace) -> Config:
    c = parse(args.config.read_text()) if args.config else Config()
    return replace(c, output_dir=args.output_dir or c.output_dir, overwrite=not args.no_overwrite, skip_ambiguous_audio=args.skip_ambiguous_audio or c.skip_ambiguous_audio, min_duration=args.min_duration, dry_run=True, jobs=max(args.jobs, 0), probe_timeout=args.probe_timeout)


def _print(rows: DataFrame) -> None:
    """Every row, tab-separated, a partition at a time."""
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    cfg = config(args)
    if args.dump_config:
        print(cfg)
        return 0
    spark = session()
    single = Path(args.root).is_file()
    files = media_files(walk(spark, args.root), cfg.media_extensions, single=single)
    top = str(Path(args.root).parent if single else Path(args.root)).rstrip("/") + "/"
    below = F.when(F.col("path").startswith(top), F.substr("path", F.lit(len(top) + 1))).otherwise(F.col("path"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    docs = empty("path string, inner_path string, raw string")
    if args.probes:
        names = files.select("path", below.alias("item_id"))
        docs = docs.union(names.join(read_probes(spark, args.probes), "item_id").select("path", F.lit(None).cast("string"), "raw"))
    if args.disc_probes:
        names = files.select("path", below.alias("disc"))
        docs = docs.union(names.join(read_disc_probes(spark, args.disc_probes), "disc").select("path", "inner_path", "raw"))
    rows = lambda path, ddl: spark.read.schema(ddl).json(path) if path else empty(ddl)
    listing = read_listing(spark, args.listing) if args.listing else empty(LISTING)
    done = rows(args.outputs, "output string, size bigint, codec string, duration_secs double")
    marks = read_markers(spark, args.root) if Path(args.root).is_dir() else empty("output string, source_size bigint")
    if args.list_outputs:
        for r in listed(done).toLocalIterator():
            print(r.output)
        return 0
    if Path(args.mounts).is_file():
        top = spark.createDataFrame([(str(Path(args.root).resolve()),)], "path string")
        on = network_mount(top, read_mounts(spark, args.mounts)).first()
        if on.network_fs:
            print(f"{args.root} is on a network file system ({on.network_fs})", file=sys.stderr)
    planned = library.plan(files, listing, docs, done, marks, rows(args.dirs, "dir string, writable boolean"), cfg).cache()
    if not args.quiet:
        _print(planned.orderBy("path", "title_suffix"))
    if args.replace:
        items = planned.join(done.select("output", F.col("size").alias("out_size"), F.col("codec").alias("out_codec"), F.col("duration_secs").alias("out_duration")), "output")
        items = items.withColumns({"is_disc": is_disc_image(F.col("path")), "source_duration": F.col("duration_secs")})
        _print(replacements(items))
    _print(library.report(planned))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
