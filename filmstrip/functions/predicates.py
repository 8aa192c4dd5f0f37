"""Conditions on files, streams and devices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ext_lower

# Names that the conditions look for.
DISC_EXTENSIONS = ["iso", "img"]
COMMENTARY = ["commentary", "director's", "directors comment", "cast and crew", "with director", "audio description", "descriptive audio", "isolated score"]
NETWORK_FS = ["nfs", "nfs4", "smb", "smb2", "smb3", "smbfs", "cifs", "fuse.sshfs", "afs", "ceph", "9p", "glusterfs"]
NO_10BIT = ["GTX 750", "GTX 9", "GTX 1050", "GTX 1060", "GTX 1070", "GTX 1080"]
PROFESSIONAL = ["quadro", "tesla"]
PROFESSIONAL_STARTS = ["a10", "a30", "a40", "a100", "l4", "l40", "h100"]
HDR_TRANSFERS = ["smpte2084", "arib-std-b67"]
# What is said of an output that can't be used.
MISSING, EMPTY, GONE = "Output file does not exist", "Output file is empty", "Source file disappeared"
SMALL = "Output file is suspiciously small (%d bytes vs %d bytes source)"
UNREADABLE, NO_CODEC = "probe cannot read output file", "Output has no recognizable video codec"
APART = "Duration mismatch: source %.1fs vs output %.1fs (diff %.1fs)"


def _contains(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in parts])


def is_disc_image(path: Column) -> Column:
    return ext_lower(path).isin(DISC_EXTENSIONS)


def meets_target(codec: Column, width: Column, height: Column, kbps: Column, *, max_width: int = 3840, max_height: int = 2160, max_kbps: int = 0, codecs: tuple[str, ...] = ("hevc", "h265")) -> Column:
    fits = codec.isin(*codecs) & (width <= max_width) & (height <= max_height)
    return fits & (kbps <= max_kbps) if max_kbps else fits


def is_10bit(pix_fmt: Column) -> Column:
    return pix_fmt.rlike("(10|12)(le|be)") | pix_fmt.startswith("p010")


def is_too_short(duration: Column, least: float) -> Column:
    """Unknown durations (0 or less) are not short."""
    return (duration > 0) & (duration < least)


def supports_10bit(gpu_name: Column) -> Column:
    return ~_contains(F.lower(gpu_name), [x.lower() for x in NO_10BIT])


def max_sessions(kind: Column, name: Column) -> Column:
    low = F.lower(name)
    professional = _contains(low, PROFESSIONAL) | reduce(lambda a, b: a | b, [low.startswith(x) for x in PROFESSIONAL_STARTS])
    return F.when(kind == "nvidia", F.when(professional, 4).otherwise(3)).otherwise(2)


def gpu_kind(nvidia: Column, intel: Column, apple: Column) -> Column:
    """The device to use of those that are there."""
    return F.when(nvidia, "nvidia").when(intel, "intel").when(apple, "apple")


def encoder_state(found: Column, runs: Column, has_encoder: Column) -> Column:
    return F.when(~found, "not-found").when(~runs, "broken").when(~has_encoder, "encoder-missing").otherwise("ready")


def looks_like_commentary(comment_flag: Column, title: Column, keywords: list[str] | None = None) -> Column:
    return F.coalesce(comment_flag, F.lit(False)) | F.coalesce(_contains(F.lower(title), keywords or COMMENTARY), F.lit(False))


def is_network_fs(fs_type: Column) -> Column:
    return reduce(lambda a, b: a | b, [(fs_type == n) | fs_type.startswith(n + ".") for n in NETWORK_FS])


def needs_frame_probe(master_display: Column, max_cll: Column, transfer: Column, primaries: Column) -> Column:
    complete = master_display.isNotNull() & max_cll.isNotNull()
    hdr = F.coalesce(transfer.isin(HDR_TRANSFERS), F.lit(False)) | F.coalesce(F.lower(primaries) == "bt2020", F.lit(False))
    return ~complete & (hdr | (transfer.isNull() & primaries.isNull()))


def invalid_output(out_size: Column, src_size: Column, codec: Column, src_duration: Column, out_duration: Column, *, disc: bool = False) -> Column:
    """The first reason why an output can't be used, null if it can. Outputs of discs
    aren't compared with the image's size."""
    reason = F.when(out_size.isNull(), MISSING).when(out_size == 0, EMPTY)
    if not disc:
        small = F.format_string(SMALL, out_size, src_size)
        reason = reason.when(src_size.isNull(), GONE).when(out_size < F.floor(src_size / 100), small)
    apart = F.abs(src_duration - out_duration)
    mismatch = F.format_string(APART, src_duration, out_duration, apart)
    return reason.when(codec.isNull(), UNREADABLE).when(codec == "unknown", NO_CODEC).when((src_duration > 0) & (out_duration > 0) & (apart > 5.0), mismatch)


def should_freeze(hits: Column) -> Column:
    return hits >= 3
