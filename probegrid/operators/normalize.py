"""Raw feed to standard columns and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probegrid.functions.scalars import floor_minutes, id_text, is_closed, parse_number, parse_timestamp
from probegrid.schema import (
    POINT_ALIASES, POINT_CORE, POINT_NUMERIC, SEGMENT_ALIASES, SEGMENT_CORE, SEGMENT_NUMERIC,
)


def _key(name: str) -> str:
    return name.strip().replace(" ", "_").replace("-", "_").lower()


def normalize_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename columns to their standard names.

    Names are compared in lower case, trimmed, with blanks and dashes as
    underscores. The first alias present wins; of several raw columns with
    the same key the last one is taken.
    """
    by_key = {_key(c): c for c in df.columns}
    standard = {}
    for name, candidates in aliases.items():
        found = next((by_key[_key(c)] for c in candidates if _key(c) in by_key), None)
        if found is not None:
            standard[found] = name
    names = [standard.get(c, c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"renaming gives two columns named {clashes}")
    return df.toDF(*names)


def require_columns(df: DataFrame, required: list[str], table: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns {missing}")


#: Metadata key of a column that was numbered here and not delivered.
MADE_UP = "made_up"


def _with_sequence(df: DataFrame) -> DataFrame:
    """A column that decides between records of equal time.

    Without one in the data, the position in the input files is used, as a
    reader that keeps file order would. Its metadata says so: over a shuffled
    input a second evaluation may give other numbers, so nothing compares them.
    """
    if "ingest_seq" in df.columns:
        return df
    return df.select("*", F.monotonically_increasing_id().alias("ingest_seq", metadata={MADE_UP: True}))


def _within(df: DataFrame, date_from, date_to) -> DataFrame:
    """Keep records of [date_from, date_to); reaches the scan for typed columns."""
    ts = F.col("timestamp")
    if date_from is not None:
        df = df.where(ts >= F.lit(str(date_from)).cast("timestamp_ntz"))
    if date_to is not None:
        df = df.where(ts < F.lit(str(date_to)).cast("timestamp_ntz"))
    return df


def _typed(df: DataFrame, numeric: list[str], ids: list[str], core: list[str], slot: str, minutes: int, date_from, date_to) -> DataFrame:
    """Parse columns to their types, then add slot and date.

    Core columns that arrive as text come out of a one-row ``inline``. Filters
    on them then stay above the parsing; pushed below it they would repeat
    every parse expression several times per row. Typed columns stay plain,
    so their filters and their pruning reach the scan.
    """
    types = {f.name: f.dataType for f in df.schema}
    plain, text = [], []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c == "timestamp" and not isinstance(types[c], T.TimestampNTZType):
            col = parse_timestamp(col, types[c])
        elif c in numeric and not isinstance(types[c], T.NullType):
            col = parse_number(col, types[c])
        elif c in ids:
            col = id_text(col, types[c])
        is_text = c in core and isinstance(types[c], T.StringType)
        (text if is_text else plain).append(col.alias(c))
    if text:
        parsed = df.select(*plain, F.inline(F.array(F.struct(*text)))).select(*[f"`{c}`" for c in df.columns])
    else:
        parsed = df.select(*plain)
    ts = F.col("timestamp")
    start = floor_minutes(ts, minutes)
    return _within(parsed, date_from, date_to).select("*", start.alias(slot), F.to_date(ts).alias("date"))


def standardize_points(raw: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Point feed with standard names and types, 15-minute slot and date.

    ``date_from``/``date_to`` limit the read; records without a readable time
    have no date and are left out once either is given.
    """
    df = normalize_columns(raw, POINT_ALIASES)
    require_columns(df, POINT_CORE, "point feed")
    if "road_closure" not in df.columns:
        df = df.withColumn("road_closure", F.lit(False))
    if "confidence" not in df.columns:
        df = df.withColumn("confidence", F.lit(None).cast("double"))
    df = _typed(_with_sequence(df), POINT_NUMERIC, ["point_id"], POINT_CORE, "interval_15min", 15, date_from, date_to)
    return df.withColumn("road_closure_bool", is_closed(F.col("road_closure")))


def standardize_segments(raw: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Segment feed with standard names and types, 30-minute slot and date."""
    df = normalize_columns(raw, SEGMENT_ALIASES)
    require_columns(df, SEGMENT_CORE, "segment feed")
    if "segment_id" not in df.columns:
        df = df.withColumn("segment_id", F.monotonically_increasing_id().cast("string"))
    if "confidence" not in df.columns:
        df = df.withColumn("confidence", F.lit(None).cast("double"))
    return _typed(df, SEGMENT_NUMERIC, ["block_id", "segment_id"], SEGMENT_CORE, "interval_30min", 30, date_from, date_to)
