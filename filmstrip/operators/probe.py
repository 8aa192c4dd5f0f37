"""Probe documents to media information: streams, colours, HDR metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import needs_frame_probe
from ..functions.scalars import bound, digits, rational_scaled, trimmed

SIDE_DATA = "array<struct<side_data_type:string,red_x:string,red_y:string,green_x:string,green_y:string,blue_x:string,blue_y:string,white_point_x:string,white_point_y:string,min_luminance:string,max_luminance:string,max_content:int,max_average:int>>"
PROBE = f"streams array<struct<codec_name:string,codec_type:string,width:int,height:int,pix_fmt:string,color_primaries:string,color_transfer:string,color_space:string,color_range:string,channels:int,bit_rate:string,side_data_list:{SIDE_DATA},tags:struct<BPS:string,language:string,title:string>,disposition:struct<`default`:int,comment:int>>>, format struct<bit_rate:string,duration:string>"
FRAMES = f"frames array<struct<side_data_list:{SIDE_DATA}>>"


def _once(d: DataFrame, name: str, value: Column) -> DataFrame:
    """``d`` with a column computed once a row: a generator of one row is a step that
    isn't merged with what reads the column, which would compute it again at each place."""
    return d.withColumn(name, F.explode_outer(F.array(value)))


def clean_color_tag(c: Column) -> Column:
    return bound(trimmed(c), lambda t: F.when((t != "") & ~F.lower(t).isin("unknown", "unspecified"), t))


def kbps(*candidates: Column) -> Column:
    """The first candidate that is a number, in thousands, truncated; else 0."""
    return F.floor(F.coalesce(*[digits(c) for c in candidates], F.lit(0)) / 1000).cast("bigint")


def _side(side: Column, kind: str) -> Column:
    return F.get(F.filter(side, lambda x: x["side_data_type"] == kind), F.lit(0))


def master_display(side: Column) -> Column:
    """G(x,y)B(x,y)R(x,y)WP(x,y)L(max,min), null if any of them is missing."""
    pair = lambda tag, x, y: [F.lit(f"{tag}("), x, F.lit(","), y, F.lit(")")]

    def text(m: Column) -> Column:
        at = lambda n: rational_scaled(m[n], 50000).cast("string")
        light = lambda n: rational_scaled(m[n], 10000).cast("string")
        return F.concat(*pair("G", at("green_x"), at("green_y")), *pair("B", at("blue_x"), at("blue_y")), *pair("R", at("red_x"), at("red_y")), *pair("WP", at("white_point_x"), at("white_point_y")), *pair("L", light("max_luminance"), light("min_luminance")))

    return bound(_side(side, "Mastering display metadata"), text)


def max_cll(side: Column) -> Column:
    return bound(_side(side, "Content light level metadata"), lambda m: F.concat(m["max_content"].cast("string"), F.lit(","), m["max_average"].cast("string")))


def media_info(docs: DataFrame, raw_col: str = "raw", frames_col: str | None = None) -> DataFrame:
    """``docs`` with the columns of a media information; ``error`` says why there is
    none. 0 and "unknown" stand for what a document doesn't tell. First-frame metadata
    fills what the header lacks, where the header looks incomplete."""
    d = _once(docs, "_p", F.from_json(raw_col, PROBE))
    video = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    d = _once(d, "_t", F.struct(video.alias("v"), F.filter("_p.streams", lambda s: s["codec_type"] == "audio").alias("a")))
    audio = F.transform(
        "_t.a",
        lambda s, i: F.struct(
            i.alias("index"),
            F.coalesce(s["codec_name"], F.lit("unknown")).alias("codec"),
            F.coalesce(s["channels"], F.lit(0)).alias("channels"),
            kbps(s["tags"]["BPS"], s["bit_rate"]).alias("bitrate_kbps"),
            s["tags"]["language"].alias("language"),
            s["tags"]["title"].alias("title"),
            (F.coalesce(s["disposition"]["default"], F.lit(0)) == 1).alias("is_default"),
            (F.coalesce(s["disposition"]["comment"], F.lit(0)) == 1).alias("is_comment"),
        ),
    )
    v = F.col("_t.v")
    tags = {c: clean_color_tag(v[c]) for c in ("color_primaries", "color_transfer", "color_space", "color_range")}
    tags |= {"master_display": master_display(v["side_data_list"]), "max_cll": max_cll(v["side_data_list"])}
    d = _once(d, "_c", F.struct(*[c.alias(n) for n, c in tags.items()]))
    d = d.withColumns(
        {
            "error": F.when(F.col("_p.streams").isNull() & F.col("_p.format").isNull(), "unreadable probe document").when(v.isNull(), "no video stream found"),
            "codec": F.coalesce(v["codec_name"], F.lit("unknown")),
            "width": F.coalesce(v["width"], F.lit(0)),
            "height": F.coalesce(v["height"], F.lit(0)),
            "bitrate_kbps": kbps(v["tags"]["BPS"], F.col("_p.format.bit_rate")),
            "duration_secs": F.coalesce(F.when(F.col("_p.format.duration").rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), F.col("_p.format.duration").try_cast("double")), F.lit(0.0)),
            "pix_fmt": F.coalesce(v["pix_fmt"], F.lit("unknown")),
            "has_audio": F.coalesce(F.size("_t.a") > 0, F.lit(False)),
            "has_subtitles": F.coalesce(F.exists("_p.streams", lambda s: s["codec_type"] == "subtitle"), F.lit(False)),
            "audio_streams": audio,
        }
        | {c: F.col(f"_c.{c}") for c in tags}
    )
    d = d.drop("_p", "_t", "_c")
    return with_frames(d, frames_col) if frames_col else d


def with_frames(d: DataFrame, frames_col: str = "frames_json") -> DataFrame:
    """Media information with what first-frame documents add to incomplete headers."""
    side = F.flatten(F.transform(F.from_json(frames_col, FRAMES)["frames"], lambda f: F.coalesce(f["side_data_list"], F.array().cast(SIDE_DATA))))
    asked = needs_frame_probe(F.col("master_display"), F.col("max_cll"), F.col("color_transfer"), F.col("color_primaries"))
    d = _once(d, "_f", F.when(asked, side))
    return d.withColumns({"master_display": F.coalesce("master_display", master_display(F.col("_f"))), "max_cll": F.coalesce("max_cll", max_cll(F.col("_f")))}).drop("_f")


def color(d: DataFrame) -> Column:
    return F.struct("color_primaries", "color_transfer", "color_space", "color_range", "master_display", "max_cll")


def audio_rows(info: DataFrame, item_col: str = "item_id") -> DataFrame:
    """One row per audio stream, numbered among the item's audio streams."""
    return info.select(item_col, F.explode("audio_streams").alias("s")).select(item_col, F.col("s.index").alias("idx"), "s.codec", "s.channels", "s.bitrate_kbps", "s.language", "s.title", "s.is_default", "s.is_comment")
