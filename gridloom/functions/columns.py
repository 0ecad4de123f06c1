"""Column expressions: casts, tags, search predicates, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Text as double, blank and unreadable as null; only plain decimal notation counts."""
    plain = F.regexp_like(F.trim(c), F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    return F.when(plain, F.trim(c).try_cast("double"))


def split_tags(c: Column, delimiter: str | None) -> Column:
    """Tags by a literal delimiter, empty ones kept; without one, the value is the only tag, blank means none."""
    if delimiter is None:
        return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))
    return F.split(c, re.escape(delimiter), -1)


def holds(c: Column, query: str) -> Column:
    """Whether the value, as text, holds the query literally, in any case."""
    return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(query.lower())), F.lit(False))


def begins(c: Column, query: str) -> Column:
    return F.coalesce(F.startswith(F.lower(c.cast("string")), F.lit(query.lower())), F.lit(False))


def ellipsis(c: Column, most: int = 160) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "-")


def short_count(c: Column) -> Column:
    """999, 1.5k, 12k, 1.5M."""
    def unit(size: float, sign: str) -> Column:
        x = c / F.lit(size)
        return F.concat(F.when(x < 10, F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")).otherwise(F.format_string("%d", F.round(x).cast("long"))), F.lit(sign))

    return F.when(c < 1000, c.cast("string")).when(c < 1_000_000, unit(1e3, "k")).otherwise(unit(1e6, "M"))


def iso(c: Column) -> Column:
    """A time as ISO text; a fraction of a second shows as six digits where there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(c.cast("timestamp")) % 1_000_000
    return F.when(micros == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")))


#: The units of sizes, each 1,024 of the one before.
SIZES = ("KiB", "MiB", "GiB", "TiB")


def bytes_text(c: Column) -> Column:
    """999 B, 1.5 KiB, 2.0 MiB, 310 GiB: one decimal below 100; of a long, or a decimal without places."""
    v = c.cast("double")
    out = F.concat(c.cast("string"), F.lit(" B"))
    for k, unit in enumerate(SIZES, 1):
        n = v / F.lit(float(1024**k))
        text = F.when(n >= 100, F.floor(n + 0.5).cast("string")).otherwise(F.format_string("%.1f", n))
        out = F.when(v >= F.lit(float(1024**k)), F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """45 s, 2 min, 3 h, 3 h 10 min: whole seconds below a minute, then whole minutes; below 0 as 0."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5))
    minutes = F.floor(s / 60 + 0.5)
    h, m = F.floor(minutes / 60), minutes % 60
    hours = F.concat(h.cast("string"), F.lit(" h"), F.when(m > 0, F.concat(F.lit(" "), m.cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(hours)


def instant(c: Column, form: str) -> Column:
    """Milliseconds since 1970 of text: a number scaled by its form, else a time as ISO text; null beyond what calendars hold."""
    n = to_number(c)
    ms = F.when(n.isNotNull(), n * (1.0 if form == "unix_millis" else 1000.0)).otherwise(F.unix_millis(F.trim(c).try_cast("timestamp")))
    return F.when(F.abs(ms) <= F.lit(8.64e15), F.round(ms).cast("long"))


def sha256(c: Column) -> Column:
    """The SHA-256 of a text's UTF-8 bytes, or of binary content, as lowercase hex; null of null."""
    return F.sha2(c.cast("binary"), 256)
