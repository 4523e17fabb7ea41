"""Durations and dates, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([0-9]+(?:[.][0-9]+)?)"


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found.cast("double"))


def _sum(*parts: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for p, f in parts:
        out = out + F.coalesce(p, F.lit(0.0)) * f
    return out


def is_iso(c: Column) -> Column:
    """PT with hours, minutes and seconds in this order, each at most once: what the parts make up again is the text."""
    parts = [F.regexp_extract(c, _NUMBER + d, 0) for d in "HMS"]
    return F.coalesce(c == F.concat(F.lit("PT"), *parts), F.lit(False))


def iso_minutes(c: Column) -> Column:
    """Minutes of PT#H#M#S with decimals, null for anything else; a bare PT is 0."""
    return F.when(is_iso(c), marked_minutes(c))


def marked_minutes(c: Column) -> Column:
    """Minutes of the first number before each of H, M and S."""
    return _sum((_part(c, _NUMBER + "H"), 60.0), (_part(c, _NUMBER + "M"), 1.0), (_part(c, _NUMBER + "S"), 1 / 60))


def sql_is_iso(e: str) -> str:
    return f"coalesce({e} = concat('PT', " + ", ".join(f"regexp_extract({e}, '{_NUMBER}{d}', 0)" for d in "HMS") + "), false)"


def sql_marked_minutes(e: str) -> str:
    part = lambda d: f"coalesce(TRY_CAST(nullif(regexp_extract({e}, '{_NUMBER}{d}', 1), '') AS DOUBLE), 0)"
    return f"(0e0 + {part('H')} * 60e0 + {part('M')} * 1e0 + {part('S')} * (1 / 60e0))"


def shown_minutes(c: Column) -> Column:
    """Minutes as a page reads them: text that begins with PT by its designators, else ``2h``, ``5min`` and ``30 sec``; 0 for none."""
    upper = F.upper(c)
    plain = _sum((_part(c, "([0-9]+)h"), 60.0), (_part(c, "([0-9]+)min"), 1.0), (_part(c, r"([0-9]+)[ \t]*s"), 1 / 60))
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).when(upper.startswith("PT"), marked_minutes(upper)).otherwise(plain)


def long(minutes: Column) -> Column:
    """Rounded to five minutes: ``1 day 2 hours 5 min``, ``2 hours``, ``10 min``."""
    m = (F.floor(F.coalesce(minutes, F.lit(0)) / 5 + 0.5) * 5).cast("long")
    counted = lambda n, one, many: F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many)))
    parts = F.concat_ws(" ", counted(F.floor(m / 1440), "day", "days"), counted(F.floor(m % 1440 / 60), "hour", "hours"), counted(m % 60, "min", "min"))
    return F.when(parts == "", "0 min").otherwise(parts)


def minutes_iso(minutes: Column) -> Column:
    """PT#H#M of whole minutes, PT0M for none."""
    m = F.floor(minutes)
    h, rest = F.floor(m / 60), m % 60
    return (
        F.when(m <= 0, "PT0M").when((h > 0) & (rest > 0), F.concat(F.lit("PT"), h.cast("string"), F.lit("H"), rest.cast("string"), F.lit("M")))
        .when(h > 0, F.concat(F.lit("PT"), h.cast("string"), F.lit("H"))).otherwise(F.concat(F.lit("PT"), rest.cast("string"), F.lit("M")))
    )


def legacy_minutes(c: Column) -> Column:
    """Minutes of ISO durations, of ``1h30min``, of ``1 hour 15 minutes`` and of bare numbers; 0 for none."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    spelled = _sum((_part(t, r"(\d+(?:\.\d+)?)\s*(?:h|hours?|heures?)(?![a-z])"), 60.0), (_part(t, r"(\d+(?:\.\d+)?)\s*(?:m|min|mins|minutes?)(?![a-z])"), 1.0), (_part(t, r"(?:h|heures?)(\d+)$"), 1.0), (_part(t, r"(\d+(?:\.\d+)?)\s*(?:s|sec|secs|seconds?|secondes?)(?![a-z])"), 1 / 60))
    return F.coalesce(iso_minutes(F.upper(t)), F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")), F.when(t != "", spelled), F.lit(0.0))


def compact(minutes: Column) -> Column:
    """``1 hour 30 min``, ``1 hour``, ``30 min``; whole days as ``1j``."""
    m = F.floor(F.coalesce(minutes, F.lit(0)))
    d, h, r = F.floor(m / 1440), F.floor(m % 1440 / 60), m % 60
    parts = F.array_compact(
        F.array(F.when(d > 0, F.concat(d.cast("string"), F.lit("j"))), F.when(h > 0, F.concat(h.cast("string"), F.when(h > 1, " hours").otherwise(" hour"))), F.when(r > 0, F.concat(r.cast("string"), F.lit(" min"))))
    )
    return F.when(m <= 0, "0 min").otherwise(F.array_join(parts, " "))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn")


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def clock_full(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def short(minutes: Column) -> Column:
    """``1h05``, ``2h``, ``5 min``."""
    m = F.floor(minutes)
    h, r = F.floor(m / 60), m % 60
    return F.when(h <= 0, F.concat(r.cast("string"), F.lit(" min"))).when(r == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h"), F.lpad(r.cast("string"), 2, "0")))
