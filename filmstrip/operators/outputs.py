"""Where outputs go, what they are called, and the encoder's arguments for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Target
from ..functions.scalars import extension, file_name, parent, stem

MARKER_SUFFIX = ".complete"
# Presets by effort, and text subtitle codecs by container.
PRESETS = {"slow": "p7", "slower": "p7", "veryslow": "p7", "medium": "p4", "fast": "p1", "faster": "p1", "veryfast": "p1"}
TEXT_SUBTITLES = {"mp4": "mov_text", "m4v": "mov_text", "mov": "mov_text"}


def _in(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def output_path(path: Column, container: str, output_dir: str | None = None) -> Column:
    if output_dir is not None:
        return F.concat(F.lit(output_dir.rstrip("/") + "/"), stem(path), F.lit(f".{container}"))
    return _in(parent(path), F.concat(stem(path), F.lit(f".transcoded.{container}")))


def output_stem(path: Column, title: Column) -> Column:
    ext = extension(path)
    name = F.concat(stem(path), F.lit("."), title, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return F.when(title.isNull(), path).otherwise(_in(parent(path), name))


def resolved_output(path: Column, title: Column, is_disc: Column, target: Target, overwrite: bool, output_dir: str | None) -> Column:
    """Null for outputs that replace their source."""
    out = output_path(output_stem(path, title), target.container, output_dir)
    return F.when(F.lit(overwrite) & ~is_disc, F.lit(None)).otherwise(out)


def marker_path(output: Column) -> Column:
    return F.concat(output, F.lit(MARKER_SUFFIX))


def display_name(path: Column, inner_path: Column, inner_paths: Column, title: Column) -> Column:
    name = file_name(path)
    tag = F.when(title.isNull(), "").otherwise(F.concat(F.lit(" ["), title, F.lit("]")))
    many = F.concat(name, tag, F.lit(" ("), F.size(inner_paths).cast("string"), F.lit(" files)"))
    return F.when(inner_paths.isNotNull(), many).when(inner_path.isNotNull(), F.concat(name, tag, F.lit(":"), file_name(inner_path))).otherwise(name)


def _pair(flag: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(F.lit(flag), value)).otherwise(F.array().cast("array<string>"))


def color_args(color: Column, gpu_kind: Column) -> Column:
    nvidia = gpu_kind == "nvidia"
    return F.concat(
        _pair("-color_primaries", color["color_primaries"]),
        _pair("-color_trc", color["color_transfer"]),
        _pair("-colorspace", color["color_space"]),
        _pair("-color_range", color["color_range"]),
        _pair("-master_display", F.when(nvidia, color["master_display"])),
        _pair("-max_cll", F.when(nvidia, color["max_cll"])),
    )


def subtitle_fallback(container: Column) -> Column:
    return F.when(container.isin(*TEXT_SUBTITLES), "mov_text").otherwise("srt")


def subtitle_args(target: Target, skip: Column, override: Column) -> Column:
    none = F.array().cast("array<string>")
    configured = F.array(F.lit("-c:s"), F.lit(target.subtitle_codec)) if target.subtitle_codec else none
    return F.when(skip, none).when(override.isNotNull(), F.array(F.lit("-c:s"), override)).otherwise(configured)


def audio_map(primary: Column) -> Column:
    return F.array(F.lit("-map"), F.when(primary.isNull(), "0:a:0?").otherwise(F.concat(F.lit("0:a:"), primary.cast("string"))))


def video_args(gpu_kind: Column, kbps: Column, is_10bit: Column, target: Target) -> Column:
    """The encoder's arguments as an array, by device."""
    lits = lambda *xs: F.array(*[F.lit(str(x)) for x in xs])
    rate = lambda k: F.concat(k.cast("string"), F.lit("k"))
    none = F.array().cast("array<string>")
    limit = F.when(kbps > 0, F.array(F.lit("-maxrate"), rate(kbps), F.lit("-bufsize"), rate(kbps * 2))).otherwise(none)
    nvidia = F.concat(lits("-c:v", "hevc_nvenc", "-preset", PRESETS.get(target.preset, target.preset), "-rc", "vbr", "-cq", target.quality), limit, lits("-b:v", "0"), F.when(is_10bit, lits("-pix_fmt", "p010le")).otherwise(none))
    surface = F.when(is_10bit, "format=p010le,hwupload").otherwise("format=nv12,hwupload")
    intel = F.concat(lits("-vaapi_device", "/dev/dri/renderD128", "-c:v", "hevc_vaapi", "-global_quality", target.quality), limit, F.array(F.lit("-vf"), surface))
    apple = F.concat(lits("-c:v", "hevc_videotoolbox", "-q:v", target.quality), limit)
    return F.when(gpu_kind == "nvidia", nvidia).when(gpu_kind == "intel", intel).when(gpu_kind == "apple", apple)
