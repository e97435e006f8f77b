"""Timestamps are LONG nanoseconds since the epoch (UTC); everything else is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mathcols import col

SECOND_NS = 1_000_000_000
MINUTE_NS = 60 * SECOND_NS
HOUR_NS = 60 * MINUTE_NS
DAY_NS = 24 * HOUR_NS
MARKET_TZ = "America/New_York"

# Session clock in minutes after local midnight.
PREMARKET_OPEN, SESSION_OPEN, FIRST_HOUR_END, MIDDAY, SESSION_CLOSE = 240, 570, 630, 750, 960

# Magnitudes from which an epoch number is read as ns, us or ms (else seconds).
EPOCH_NS_FROM, EPOCH_US_FROM, EPOCH_MS_FROM = 1e18, 1e15, 1e12


def idiv(a: Column, b: int) -> Column:
    """Floor division of 64-bit integers, exact (``/`` alone would go through DOUBLE)."""
    width = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, width), width)


def bucket_ns(ts: Column | str, width_ns: int) -> Column:
    """Start of the bucket of ``width_ns`` that holds ts; exact for 64-bit nanoseconds."""
    c = col(ts)
    return c - F.pmod(c, F.lit(width_ns).cast("long"))


def event_time(ts: Column | str) -> Column:
    c = col(ts)
    return F.timestamp_micros(idiv(c, 1000))


def to_ns(t: Column | str) -> Column:
    return F.unix_micros(col(t).cast("timestamp")) * F.lit(1000).cast("long")


def infer_epoch_ns(x: Column | str) -> Column:
    """Epoch number of unknown unit to nanoseconds, by magnitude."""
    c = col(x).cast("long")
    a = F.abs(c)
    return (
        F.when(a >= F.lit(int(EPOCH_NS_FROM)), c)
        .when(a >= F.lit(int(EPOCH_US_FROM)), c * 1000)
        .when(a >= F.lit(int(EPOCH_MS_FROM)), c * 1_000_000)
        .otherwise(c * SECOND_NS)
    )


def market_time(ts: Column | str, tz: str = MARKET_TZ) -> Column:
    """Local wall-clock TIMESTAMP (session time zone must be UTC)."""
    return F.from_utc_timestamp(event_time(ts), tz)


def output_time(ts: Column | str, mode: str) -> Column:
    """The four output modes: ``utc``/``market`` as strings with offset, or naive timestamps."""
    if mode == "utc_naive":
        return event_time(ts)
    if mode == "market_naive":
        return market_time(ts)
    if mode == "utc_aware":
        return F.date_format(event_time(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    if mode == "market_aware":
        local = market_time(ts)
        offset_min = ((F.unix_micros(local) - F.unix_micros(event_time(ts))) / 60_000_000).cast("long")
        sign = F.when(offset_min < 0, F.lit("-")).otherwise(F.lit("+"))
        mins = F.abs(offset_min)
        return F.concat(
            F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign,
            F.lpad(F.floor(mins / 60).cast("string"), 2, "0"), F.lit(":"),
            F.lpad((mins % 60).cast("string"), 2, "0"),
        )
    raise ValueError(f"unknown time output mode: {mode}")


def session_date(ts: Column | str) -> Column:
    return F.to_date(market_time(ts))


def minute_of_day(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def utc_minute(ts: Column | str) -> Column:
    """Minute of the UTC day straight from the number; no timestamp conversion needed."""
    c = col(ts)
    in_day = F.pmod(c, F.lit(DAY_NS).cast("long"))
    return idiv(in_day, MINUTE_NS).cast("int")


def market_minute(ts: Column | str) -> Column:
    return minute_of_day(market_time(ts))


def local_clock_ns(ts: Column | str, minute: int) -> Column:
    """UTC ns of ``minute`` after local midnight on the local date of ts (DST aware)."""
    midnight = F.date_trunc("day", market_time(ts))
    local = midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minute), F.lit(0).cast("decimal(18,6)"))
    return to_ns(F.to_utc_timestamp(local, MARKET_TZ))


def is_trading_day(t: Column) -> Column:
    return F.dayofweek(t).between(2, 6)


def in_market_session(ts: Column | str) -> Column:
    """Weekday and 09:30 <= local time <= 16:00, both ends included."""
    t = market_time(ts)
    secs = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return is_trading_day(t) & secs.between(SESSION_OPEN * 60, SESSION_CLOSE * 60)


def in_regular_hours(ts: Column | str) -> Column:
    """09:30 <= local time < 16:00."""
    m = market_minute(ts)
    return (m >= SESSION_OPEN) & (m < SESSION_CLOSE)


def in_premarket(ts: Column | str) -> Column:
    m = market_minute(ts)
    return (m >= PREMARKET_OPEN) & (m < SESSION_OPEN)


def day_half(ts: Column | str) -> Column:
    return F.when(market_minute(ts) >= MIDDAY, F.lit("PM")).otherwise(F.lit("AM"))


def duration_seconds(text: Column | str) -> Column:
    """'30s', '15m', '4h', '1d' to seconds; NULL when the text is not a duration."""
    t = F.lower(F.trim(col(text)))
    n = F.regexp_extract(t, r"^(\d+)\s*([smhd])$", 1)
    unit = F.regexp_extract(t, r"^(\d+)\s*([smhd])$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(n != "", n.cast("long") * factor)


def overlap_ns(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0).cast("long"))
