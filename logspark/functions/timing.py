"""Time columns. Everything is UTC; buckets are integer arithmetic on epoch milliseconds, so no
result depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# Accepted epoch range, years 2000 to 2100.
EPOCH_MIN_S, EPOCH_MAX_S = 946_684_800, 4_102_444_800

# Timestamp shapes searched for in a log line, in this order.
CONTAINER_PREFIX = r"^\s*([a-zA-Z0-9_-]+(?:-\d+)?\s*\|)\s*"
EPOCH_MS_SHAPE = r"(?:\b|^\s*)(\d{13})\b"
EPOCH_S_SHAPE = r"(?:\b|^\s*)(\d{10})(?:\.(\d{1,6}))?\b"
ISO_SHAPE = (
    r"\b(\d{4})[-/](\d{2})[-/](\d{2})[T\s](\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,6}))?\s*(Z|[+-]\d{2}:?\d{2})?\b"
)
SYSLOG_SHAPE = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\b"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def ms(timestamp: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP."""
    return F.unix_millis(timestamp)


def at_ms(value: int | Column) -> Column:
    """TIMESTAMP of epoch milliseconds."""
    return F.timestamp_millis(F.lit(value) if isinstance(value, int) else value)


def ntz_ms(timestamp: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ read as UTC, whatever the session zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), timestamp)


def bucket(ms_col: Column, width_ms: int | Column) -> Column:
    """Start of the bucket holding ``ms_col``."""
    return ms_col - F.pmod(ms_col, F.lit(width_ms).cast("long") if isinstance(width_ms, int) else width_ms)


def _frac_ms(frac: Column) -> Column:
    return F.when(frac == "", F.lit(0)).otherwise(F.substring(F.rpad(frac, 3, "0"), 1, 3).cast("int"))


def _utc_ms(text: Column) -> Column:
    """Epoch ms of ``yyyy-MM-dd HH:mm:ss`` text read as UTC; null when it is no real date."""
    return ms(F.try_to_timestamp(F.concat(text, F.lit("Z"))))


def _epoch_number(text: Column) -> Column:
    position = F.regexp_instr(text, F.lit(EPOCH_MS_SHAPE))
    millis = F.regexp_extract(text, EPOCH_MS_SHAPE, 1).try_cast("long")
    from_millis = F.when(
        position.between(1, 50) & millis.between(EPOCH_MIN_S * 1000, EPOCH_MAX_S * 1000), millis
    )
    position_s = F.regexp_instr(text, F.lit(EPOCH_S_SHAPE))
    seconds = F.regexp_extract(text, EPOCH_S_SHAPE, 1).try_cast("long")
    fraction = _frac_ms(F.regexp_extract(text, EPOCH_S_SHAPE, 2))
    from_seconds = F.when(
        position_s.between(1, 50) & seconds.between(EPOCH_MIN_S, EPOCH_MAX_S), seconds * 1000 + fraction
    )
    return F.coalesce(from_millis, from_seconds)


def _iso(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, ISO_SHAPE, i)
    plain = F.concat(
        F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), F.concat_ws(":", part(4), part(5), part(6))
    )
    zone = F.regexp_replace(part(8), ":", "")
    offset_min = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    signed = (
        F.when(zone.isin("", "Z"), F.lit(0))
        .when(offset_min >= 1440, F.lit(None).cast("int"))
        .when(F.startswith(zone, F.lit("-")), -offset_min)
        .otherwise(offset_min)
    )
    return _utc_ms(plain) + _frac_ms(part(7)) - signed * MINUTE_MS


def _syslog(text: Column, now_ms: int) -> Column:
    part = lambda i: F.regexp_extract(text, SYSLOG_SHAPE, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(1))
    tail = F.concat(
        F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"),
        F.lit(" "), F.concat_ws(":", part(3), part(4), part(5)),
    )
    year = F.year(F.date_from_unix_date(F.lit(now_ms // DAY_MS).cast("int")))
    this_year = _utc_ms(F.concat(year.cast("string"), tail))
    last_year = _utc_ms(F.concat((year - 1).cast("string"), tail))
    return F.when(part(1) == "", None).otherwise(
        F.when(this_year > now_ms + 7 * DAY_MS, last_year).otherwise(this_year)
    )


def extract_timestamp_ms(text: Column, now_ms: int) -> Column:
    """First timestamp found in a log line as epoch ms, or null.

    Tried in order: 13-digit epoch ms, 10-digit epoch seconds, ISO 8601, syslog (year taken from
    ``now_ms``, the year before when that lies more than 7 days ahead). A compose-style ``name |``
    prefix is ignored.
    """
    line = F.regexp_replace(text, CONTAINER_PREFIX, "")
    return F.coalesce(_epoch_number(line), _iso(line), _syslog(line, now_ms))


def coerce_event_ms(value: Column, now_ms: int | Column) -> Column:
    """A JSON time value as epoch ms: epoch seconds, else ISO text (naive = UTC), else ``now_ms``."""
    number = value.try_cast("decimal(28,6)")
    text = F.trim(value)
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":")
    iso = F.try_to_timestamp(F.when(has_zone, text).otherwise(F.concat(text, F.lit("Z"))))
    return F.coalesce((number * 1000).try_cast("long"), ms(iso), F.lit(now_ms))
