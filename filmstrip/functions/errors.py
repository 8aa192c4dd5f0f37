"""Encoder messages: which kind of failure they tell of, and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of messages.
SESSION_LIMIT = ["out of memory", "InitializeEncoder failed", "Cannot init NVENC", "OpenEncodeSessionEx failed", "No capable devices found", "Nothing was written into output file"]
DISK_SPACE = ["Disk quota exceeded", "No space left on device", "ENOSPC"]
SUBTITLE = [
    ["subtitle encoding currently only possible from text to text or bitmap to bitmap"],
    ["subtitle codec not supported"],
    ["subtitle codec", "is not supported"],
    ["error while opening encoder for output stream", "subtitle"],
    ["could not find tag for codec", "subtitle"],
    ["could not find tag for codec", "hdmv_pgs"],
    ["unknown encoder", "subtitle"],
    ["codec not currently supported in container"],
]
AUDIO_COPY = [["no wav codec tag found"], ["could not write header", "incorrect codec parameters"]]
TELLING = ["error", "invalid", "could not", "failed", "cannot", "not supported", "unsupported", "no wav codec", "no such", "incorrect codec", "nothing was written"]
NOISE_STARTS = ["frame=", "size=", "Last message repeated"]
NOISE = "Conversion failed!"
NOTHING_WRITTEN = "Nothing was written"


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _groups(c: Column, groups: list[list[str]]) -> Column:
    low = F.lower(c)
    return _any([reduce(lambda a, b: a & b, [low.contains(x) for x in g]) for g in groups])


def is_session_limit(c: Column) -> Column:
    return _any([c.contains(x) for x in SESSION_LIMIT])


def is_disk_space(c: Column) -> Column:
    return _any([c.contains(x) for x in DISK_SPACE])


def is_subtitle(c: Column) -> Column:
    return _groups(c, SUBTITLE)


def is_audio_copy(c: Column) -> Column:
    return _groups(c, AUDIO_COPY)


def category(c: Column) -> Column:
    """For reports; the order is not that of retries."""
    return F.when(is_session_limit(c), "session-limit").when(is_audio_copy(c), "audio-copy").when(is_subtitle(c), "subtitle").when(is_disk_space(c), "disk-space").otherwise("unknown")


def summary(log: Column, telling: list[str] | None = None, keep: int = 4, tail: int = 3) -> Column:
    """Up to ``keep`` telling lines, those with the same text behind [module] once, by
    first occurrence; else the last ``tail`` lines that aren't noise."""
    lines = F.filter(F.transform(F.split(log, r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, r"^\s+", "")
    noise = lambda x: _any([bare(x).startswith(s) for s in NOISE_STARTS] + [bare(x) == NOISE])
    heard = F.filter(lines, lambda x: ~noise(x))
    told = F.filter(heard, lambda x: _any([F.lower(x).contains(t) for t in telling or TELLING]))
    body = lambda x: F.regexp_replace(x, r"^\[.*?\] \s*", "")
    # one pass over the telling lines, each with its body, which stops looking when it has enough
    none = F.array().cast("array<string>")
    seen = lambda s, x: (F.size(s["lines"]) >= keep) | F.array_contains(s["bodies"], x["body"])
    add = lambda s, x: F.struct(F.concat(s["bodies"], F.array(x["body"])).alias("bodies"), F.concat(s["lines"], F.array(x["line"])).alias("lines"))
    first = F.aggregate(
        F.transform(told, lambda x: F.struct(body(x).alias("body"), x.alias("line"))),
        F.struct(none.alias("bodies"), none.alias("lines")),
        lambda s, x: F.when(seen(s, x), s).otherwise(add(s, x)),
    )["lines"]
    last = F.slice(heard, F.greatest(F.size(heard) - tail + 1, F.lit(1)), F.lit(tail))
    return F.when(F.size(first) > 0, F.array_join(first, " | ")).when(F.size(last) > 0, F.array_join(last, " | ")).otherwise("unknown error")
