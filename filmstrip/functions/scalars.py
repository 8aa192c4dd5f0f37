"""Names, sizes, times and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1024, 1024**2, 1024**3


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def format_size(n: Column) -> Column:
    """1.5GB, 20MB, 3KB: 1024-based, ties to even."""
    f = lambda unit, digits, name: F.format_string(f"%.{digits}f{name}", F.bround(n / F.lit(float(unit)), digits))
    return F.when(n >= GB, f(GB, 1, "GB")).when(n >= MB, f(MB, 0, "MB")).otherwise(f(KB, 0, "KB"))


def parse_year(c: Column) -> Column:
    """The first number of exactly four digits from 1900 to 2099."""
    return F.nullif(F.regexp_extract(c, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)[.][^.]*$", "")


def extension(path: Column) -> Column:
    """As written; empty if there is none, as for dotfiles."""
    return F.regexp_extract(file_name(path), r"^.+[.]([^.]*)$", 1)


def ext_lower(path: Column) -> Column:
    return F.lower(extension(path))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def digits(c: Column) -> Column:
    """A whole number written in digits alone, else null."""
    return bound(c, lambda x: F.when(x.rlike(r"^[+]?[0-9]+$"), x.try_cast("bigint")))


def _rational(c: Column) -> tuple[Column, Column]:
    part = lambda p: digits(trimmed(p))
    cut = F.position(F.lit("/"), c)
    return part(F.left(c, cut - 1)), part(c.substr(cut + 1, F.char_length(c)))


def parse_rational(c: Column) -> Column:
    """num and den of ``num/den``; null if either isn't a number or den is 0."""

    def parsed(c: Column) -> Column:
        num, den = _rational(c)
        return bound(F.struct(num.alias("num"), den.alias("den")), lambda r: F.when(c.contains("/") & r["num"].isNotNull() & (r["den"] > 0), r))

    return bound(c, parsed)


def rational_scaled(c: Column, k: int) -> Column:
    """The rational times ``k``, truncated."""
    times = lambda r: F.try_multiply(r["num"], F.lit(k))
    return bound(parse_rational(c), lambda r: F.when(r.isNotNull(), (times(r) - times(r) % r["den"]) / r["den"])).cast("bigint")


def truncate_name(name: Column, width: int | Column, ellipsis: str = "..") -> Column:
    """By characters, the ellipsis within the width; clipped where it has no room."""
    width = F.lit(width) if isinstance(width, int) else width
    long, room = F.char_length(name) > width, width - len(ellipsis)
    return F.when(~long, name).when(room <= 0, F.left(name, width)).otherwise(F.concat(F.left(name, room), F.lit(ellipsis)))


def progress_bar(fraction: Column, width: int, filled: str = "=", head: str = ">", empty: str = "-") -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(fraction * width))).cast("int")
    return F.when(n >= width, F.lit(filled * width)).otherwise(F.concat(F.repeat(F.lit(filled), n), F.lit(head), F.repeat(F.lit(empty), F.lit(width - 1) - n)))


def format_timeout(ms: Column) -> Column:
    return F.when((ms >= 1000) & (ms % 1000 == 0), F.concat(F.floor(ms / 1000).cast("string"), F.lit("s"))).when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.3fs", ms / 1000.0))


def iso8601(seconds: Column) -> Column:
    """Whole seconds since the epoch, in UTC whatever the session's zone is."""
    t = F.timestamp_seconds(seconds)
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), (F.floor(s / 60) % 60).cast("bigint"), s % 60)


def vts_title(name: Column) -> Column:
    """NN of VTS_NN_M.VOB in any case, unless M is 0 (menus)."""
    upper = F.upper(name)
    fits = upper.rlike(r"^VTS_[^_]*_[^_]*[.]VOB$") & ~upper.rlike(r"^VTS_[^_]*_0[.]VOB$")
    return F.when(fits, F.regexp_extract(upper, r"^VTS_([^_]*)_", 1))


def name_width(columns: Column) -> Column:
    return F.greatest(columns - 44, F.lit(20))


def progress_speed(line: Column) -> Column:
    """speed=1.23x as 123; null for other lines."""
    return F.floor(F.regexp_extract(line, r"^speed=\s*([0-9]+(?:[.][0-9]+)?)x", 1).try_cast("double") * 100).cast("bigint")


def progress_permille(line: Column, duration: Column) -> Column:
    """out_time_us=N as thousandths of the duration in seconds, 0 to 1000; null for other
    lines."""
    us = F.regexp_extract(line, r"^out_time_us=([0-9]+)", 1).try_cast("bigint")
    return F.when(us.isNotNull() & (duration > 0), F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(us / (duration * 1000.0))))).cast("bigint")


def missing_library(text: Column) -> Column:
    """The library that a loader's message says it can't open."""
    return F.nullif(F.regexp_extract(text, r"(lib[A-Za-z0-9_+-]+[.]so(?:[.][0-9]+)*)", 1), F.lit(""))


def size_label(n: Column) -> Column:
    """Whole megabytes, kilobytes or bytes."""
    whole = lambda u: F.floor(n / u).cast("string")
    return F.when(n.isNull(), "?").when(n >= MB, F.concat(whole(MB), F.lit(" MB"))).when(n >= KB, F.concat(whole(KB), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def short_error(text: Column) -> Column:
    """Without a leading [module] or Error prefix."""
    return F.regexp_replace(trimmed(text), r"^(?:\[[^\]]*\]\s*)?(?:[Ee]rror:?\s*)?", "")


SIGNALS = {1: "SIGHUP", 2: "SIGINT", 3: "SIGQUIT", 4: "SIGILL", 6: "SIGABRT", 8: "SIGFPE", 9: "SIGKILL", 11: "SIGSEGV", 13: "SIGPIPE", 14: "SIGALRM", 15: "SIGTERM"}


def exit_status(code: Column, signal: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in SIGNALS.items() for x in (k, f" ({v})")])
    return (
        F.when(signal.isNotNull(), F.concat(F.lit("killed by signal "), signal.cast("string"), F.coalesce(F.try_element_at(names, signal), F.lit("")), F.lit(" (no output)")))
        .when(code.isNotNull(), F.concat(F.lit("exit code "), code.cast("string"), F.lit(" (no output)")))
        .otherwise("terminated abnormally (no output)")
    )


def last_line(stderr: Column, stdout: Column, code: Column, signal: Column) -> Column:
    """The last line with text of stderr, else of stdout, else the exit status."""
    last = lambda c: F.try_element_at(F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != ""), F.lit(-1))
    return F.coalesce(last(stderr), last(stdout), exit_status(code, signal))


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0).otherwise((before - after) / before * 100.0).cast("int")


def disk_estimate(size: Column) -> Column:
    return F.greatest(F.floor(size / 2), F.lit(100 * MB)).cast("bigint")


def compression_ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, 1.0).otherwise(after / before)
