"""The library plan: from files, listings and probe documents to what is to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import predicates, scalars
from ..operators import aggregates, classify, disc, joins, outputs, probe, rank


def probes(docs: DataFrame) -> DataFrame:
    """Media information per (path, inner_path) of captured documents."""
    return probe.media_info(docs, frames_col="frames_json" if "frames_json" in docs.columns else None)


def primary_audio(info: DataFrame, key: list[str]) -> DataFrame:
    """The primary track per item, by the year in its name or titles."""
    s = info.select(*key, "path", F.explode("audio_streams").alias("s")).select(*key, "path", "s.*")
    talk = predicates.looks_like_commentary(F.col("is_comment"), F.col("title"))
    years = aggregates.year_hint(s, key, scalars.parse_year(scalars.file_name(F.col("path"))), scalars.parse_year(F.col("title")), talk)
    s = s.join(years, key)
    return rank.pick_primary(s, key, idx=F.col("index"), channels=F.col("channels"), bitrate=F.col("bitrate_kbps"), commentary=talk, default=F.col("is_default"), year=F.col("year"))


def plan(files: DataFrame, listing: DataFrame, docs: DataFrame, done: DataFrame, markers: DataFrame, dirs: DataFrame, cfg: Config, *, has_10bit: bool = True) -> DataFrame:
    """One row per title with outcome, reason, size, output and primary track. An item with more than one probe document is an
    error: which of them is its own can't be told.

    files: path, size. listing: disc, inner_path, name, is_directory, size. docs: path,
    inner_path (null for files), raw. done: output, size, codec, duration_secs.
    markers: output, source_size. dirs: dir, writable. Disc images that give no title
    are errors that say why; resolved_output is null where the source itself is
    replaced in the end."""
    analysis = disc.analyze(listing)
    bad = disc.unreadable(files, listing, analysis).withColumn("iso_path", F.col("path"))
    items = disc.scan_items(files, analysis).unionByName(bad, allowMissingColumns=True).join(files.select("path", F.col("size").alias("file_size")), "path")
    items = items.withColumn("item", F.concat_ws("|", "path", F.coalesce("title_suffix", F.lit(""))))
    docs = docs.withColumn("inner_path", F.coalesce("inner_path", F.lit("")))
    told = [c for c in docs.columns if c not in ("path", "inner_path")]
    docs = docs.groupBy("path", "inner_path").agg(F.min(F.struct(*told)).alias("_d"), F.count(F.lit(1)).alias("_of")).select("path", "inner_path", "_d.*", "_of")
    info = probes(docs).withColumn("error", F.when(F.col("_of") > 1, "more than one probe document").otherwise(F.col("error"))).drop("_of")
    first = items.withColumn("inner_path", F.coalesce("inner_path", F.lit("")))
    found = first.join(info, ["path", "inner_path"], "left")
    parts = items.where("inner_paths is not null").select("item", "path", F.posexplode("inner_paths").alias("part", "inner_path"))
    sized = parts.join(listing.select(F.col("disc").alias("path"), "inner_path", "size"), ["path", "inner_path"], "left")
    sizes = sized.groupBy("item").agg(F.sum("size").alias("parts_size"))
    whole = parts.join(info.select("path", "inner_path", "bitrate_kbps", "duration_secs", "error"), ["path", "inner_path"], "left")
    whole = aggregates.aggregate_probes(whole, ["item"], order=F.col("part"), bitrate=F.col("bitrate_kbps"), duration=F.col("duration_secs"), failed=F.col("error").isNotNull() | F.col("bitrate_kbps").isNull())
    whole = whole.select("item", F.col("bitrate_kbps").alias("all_kbps"), F.col("duration_secs").alias("all_secs"))
    best = primary_audio(found.where("audio_streams is not null"), ["item"]).select("item", "primary_index", "ambiguous", F.col("reason").alias("audio_reason"))
    p = found.join(sizes, "item", "left").join(whole, "item", "left").join(best, "item", "left")
    is_disc = F.col("iso_path").isNotNull()
    p = p.withColumn("source_size", F.coalesce("parts_size", "file_size")).withColumn("kbps", F.coalesce("all_kbps", "bitrate_kbps")).withColumn("secs", F.coalesce("all_secs", "duration_secs"))
    p = p.withColumn("output", outputs.output_path(outputs.output_stem(F.col("path"), F.col("title_suffix")), cfg.target.container, cfg.output_dir))
    o = done.select("output", F.col("size").alias("out_size"), F.col("codec").alias("out_codec"), F.col("duration_secs").alias("out_secs"))
    m = markers.select("output", F.col("source_size").alias("marked"))
    p = p.join(o, "output", "left").join(m, "output", "left")
    invalid = predicates.invalid_output(F.col("out_size"), F.col("file_size"), F.col("out_codec"), F.col("secs"), F.col("out_secs"))
    p = joins.unwritable(p, dirs, output_dir=cfg.output_dir, in_place=F.lit(cfg.overwrite) & ~is_disc)
    gate = classify.outcome(
        error=F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("codec").isNull(), "no probe document").otherwise(F.col("error")),
        too_short=predicates.is_too_short(F.col("duration_secs"), cfg.min_duration),
        meets_target=predicates.meets_target(F.col("codec"), F.col("width"), F.col("height"), F.col("bitrate_kbps"), max_width=cfg.target.max_width, max_height=cfg.target.max_height, max_kbps=cfg.target.max_bitrate_kbps),
        needs_10bit=predicates.is_10bit(F.col("pix_fmt")) & F.lit(not has_10bit),
        resumed=F.col("out_size").isNotNull() & invalid.isNull() & (F.col("marked") == F.col("file_size")),
        unwritable=F.col("unwritable") & F.lit(not cfg.dry_run),
        ambiguous=is_disc & F.col("ambiguous") & F.lit(cfg.skip_ambiguous_audio),
        reasons={
            "too_short": F.format_string("duration too short (%.2fs)", "duration_secs"),
            "unwritable": F.concat(F.lit("destination is not writable: "), F.col("dest_dir")),
            "ambiguous": F.concat(F.lit("ambiguous primary audio ("), F.col("audio_reason"), F.lit(")")),
        },
    )
    p = p.withColumn("gate", gate)
    resolved = outputs.resolved_output(F.col("path"), F.col("title_suffix"), is_disc, cfg.target, cfg.overwrite, cfg.output_dir)
    name = outputs.display_name(F.col("path"), F.nullif(F.col("inner_path"), F.lit("")), F.col("inner_paths"), F.col("title_suffix"))
    return p.select("path", "title_suffix", name.alias("name"), "gate.outcome", "gate.reason", "source_size", F.col("kbps").alias("bitrate_kbps"), F.col("secs").alias("duration_secs"), "pix_fmt", F.when(is_disc, F.col("primary_index")).alias("primary_index"), "output", resolved.alias("resolved_output"))


def report(planned: DataFrame) -> DataFrame:
    """Outcomes with how many titles and how much they hold."""
    c = classify.counts(planned, size_col="source_size")
    return c.withColumn("size", scalars.format_size(F.col("bytes"))).orderBy("outcome")
