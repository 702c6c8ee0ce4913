"""Column expressions: text, time and number clean-up.

Everything here is a built-in expression, so it stays inside whole-stage
code generation and never leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probegrid.schema import CLOSURE_WORDS, TIMESTAMP_FORMATS

# White space around a value: what text editors and exports leave there.
BLANKS = " \t\n\r\u000b\u000c\u00a0\u3000"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"


OFFSET_PATTERN = r"[0-9]:[0-9]{2}(:[0-9.]+)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_timestamp(c: Column, dtype: T.DataType, formats=TIMESTAMP_FORMATS, zone: str | None = None) -> Column:
    """Timestamp without zone; text that fits no format becomes null.

    An offset in the text is honoured: the time is moved to ``zone``, by default
    the session's.
    """
    if not isinstance(dtype, T.StringType):
        return c.cast("timestamp_ntz")
    text = F.trim(c, F.lit(BLANKS))
    # text that states its offset is an instant: it is given in the zone of the feed
    instant = F.when(text.rlike(OFFSET_PATTERN), text.try_cast("timestamp"))
    here = instant.cast("timestamp_ntz") if zone is None else F.convert_timezone(None, F.lit(zone), instant.cast("timestamp_ntz"))
    tries = [here, text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Start of the ``minutes``-wide slot (a divisor of 60) holding ``ts``."""
    if minutes < 1 or 60 % minutes:
        raise ValueError("minutes must divide 60")
    past = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts) % minutes, F.extract(F.lit("SECOND"), ts)
    )
    return ts - past


def parse_number(c: Column, dtype: T.DataType) -> Column:
    """Double, with unreadable text and NaN both as null."""
    if isinstance(dtype, T.StringType):
        text = F.trim(c, F.lit(BLANKS))
        value = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    else:
        value = c.cast("double")
    return F.when(~F.isnan(value), value)


def is_closed(c: Column) -> Column:
    """True for the closure words in any case; null counts as open."""
    return F.coalesce(F.lower(F.trim(c.cast("string"), F.lit(BLANKS))).isin(CLOSURE_WORDS), F.lit(False))


def id_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Id as text, so that 1, 1.0 and '1.0' all meet as '1'."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = c.cast("bigint")
        return F.when(whole == c, whole.cast("string")).otherwise(c.cast("string"))
    return F.regexp_replace(c.cast("string"), r"^([0-9]+)\.0+$", "$1")


def holds(predicate: Column) -> Column:
    """The predicate with unknown read as false."""
    return F.coalesce(predicate, F.lit(False))


def all_of(predicates) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def day_type(ts: Column) -> Column:
    """weekday for Monday to Friday, weekend otherwise, null for null."""
    return F.when(ts.isNotNull(), F.when(F.weekday(ts) < 5, "weekday").otherwise("weekend"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def interval_seconds(since: Column) -> Column:
    """Length of a day-time interval in seconds, exact to the microsecond."""
    return since.cast("interval second").cast("decimal(20,6)")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less time, whatever the session zone."""
    return (interval_seconds(ts - _epoch()) * 1_000_000).cast("bigint")


def as_event_time(ts: Column) -> Column:
    """Zone-less time as the zoned timestamp watermarks ask for, read as UTC."""
    return F.timestamp_micros(epoch_micros(ts))


def from_event_time(ts: Column) -> Column:
    """Inverse of ``as_event_time``."""
    seconds = F.unix_micros(ts).cast("decimal(24,6)") / 1_000_000
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
