"""Assigning records to blocks and scan boxes.

Boxes of any size share one index of square cells in levels, each level four times
as wide as the one below. A box stands at the lowest level whose cells are at
least as wide as its longer side, so it touches four cells at most, a country as
well as a street (beyond the widest level, which no map reaches, 81). A record is looked up once at each level that holds a box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From about a millionth of a degree to the widest cell a double can hold.
LEVELS = range(-10, 512)
WIDTH_STEP = 4.0
ENDLESS = float("inf")


def parse_boxes(boxes: DataFrame) -> DataFrame:
    """Split ``bbox`` text (minLon,minLat,maxLon,maxLat) into four numbers; what cannot be read is null."""
    part = F.split("bbox", ",")
    names = ["min_lon", "min_lat", "max_lon", "max_lat"]
    number = [F.trim(F.get(part, F.lit(i))).try_cast("double") for i in range(4)]
    return boxes.select("name", *[F.when(F.abs(x) < ENDLESS, x).alias(n) for x, n in zip(number, names, strict=True)], (F.size(part) == 4).alias("complete"))


def _usable():
    return F.coalesce(F.col("complete") & (F.col("min_lon") <= F.col("max_lon")) & (F.col("min_lat") <= F.col("max_lat")), F.lit(False))


def unusable_boxes(boxes: DataFrame) -> DataFrame:
    """The boxes that contain nothing because their text is not four numbers in order."""
    kept = parse_boxes(boxes).where(~_usable()).select("name")
    return boxes.join(kept.distinct(), "name", "left_semi")


def _width(level):
    return F.pow(F.lit(WIDTH_STEP), level)


def box_cells(boxes: DataFrame) -> DataFrame:
    """Usable boxes under the cells they touch: ``level, cell_x, cell_y`` and the four edges."""
    longer = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    low, high = LEVELS[0], LEVELS[-1]
    level = F.least(F.greatest(F.coalesce(F.ceil(F.log(WIDTH_STEP, longer)), F.lit(low)), F.lit(low)), F.lit(high)).cast("int")

    def axis(first, last):
        return F.explode(F.sequence(F.floor(F.col(first) / _width(F.col("level"))), F.floor(F.col(last) / _width(F.col("level")))))

    placed = parse_boxes(boxes).where(_usable()).drop("complete").withColumn("level", level)
    return placed.withColumn("cell_x", axis("min_lon", "max_lon")).withColumn("cell_y", axis("min_lat", "max_lat"))


def _levels(cells: DataFrame) -> list[int]:
    """The levels in use: as many rows as ``LEVELS`` has, however many boxes there are."""
    return sorted(r.level for r in cells.select("level").distinct().toLocalIterator())


def _met(points: DataFrame, boxes: DataFrame, levels: list[int] | None, how: str) -> DataFrame:
    cells = box_cells(boxes)
    lon, lat = F.col("longitude"), F.col("latitude")
    at = [F.struct(F.lit(n).alias("level"), F.floor(lon / WIDTH_STEP ** n).alias("cell_x"), F.floor(lat / WIDTH_STEP ** n).alias("cell_y"))
          for n in (levels if levels is not None else _levels(cells))]
    # a position no box can contain is looked up nowhere, and kept where rows without a box are wanted
    known = (F.abs(lon) < ENDLESS) & (F.abs(lat) < ENDLESS)
    nowhere = F.array().cast("array<struct<level:int,cell_x:bigint,cell_y:bigint>>")
    probes = F.when(known, F.array(*at) if at else nowhere).otherwise(nowhere)
    probed = points.select("*", F.explode_outer(probes).alias("_probe")).select(*[f"`{c}`" for c in points.columns], "_probe.*")
    inside = lon.between(F.col("min_lon"), F.col("max_lon")) & lat.between(F.col("min_lat"), F.col("max_lat"))
    same = [F.col(c) == F.col(f"_{c}") for c in ("level", "cell_x", "cell_y")]
    other = cells.select(F.col("name"), "min_lon", "min_lat", "max_lon", "max_lat", *[F.col(c).alias(f"_{c}") for c in ("level", "cell_x", "cell_y")])
    return probed.join(other, same[0] & same[1] & same[2] & inside, how).drop("level", "cell_x", "cell_y", "_level", "_cell_x", "_cell_y")


def points_in_boxes(points: DataFrame, boxes: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Pairs of record and box with the record inside, edges included.

    No record is compared with a box that does not share a cell of the box's own
    size with it. Spark broadcasts the cells while they are small; beyond that
    AQE splits a crowded cell. ``levels`` states the levels in use where they are
    known; otherwise a first job over the boxes finds them.
    """
    return _met(points, boxes, levels, "inner").drop("min_lon", "min_lat", "max_lon", "max_lat")


def blocks_by_position(points: DataFrame, block_boxes: DataFrame, key: str, levels: list[int] | None = None) -> DataFrame:
    """``key, block_id``: the block whose box contains each record; null where none does.

    ``block_boxes`` has ``name`` (the block) and ``bbox``. Of several boxes around a
    record the smallest counts, of equally large ones the first by name. ``key``
    names a record.
    """
    found = _met(points.select(key, "longitude", "latitude"), block_boxes, levels, "left")
    area = (F.col("max_lon") - F.col("min_lon")) * (F.col("max_lat") - F.col("min_lat"))
    return found.groupBy(key).agg(F.min(F.when(F.col("name").isNotNull(), F.struct(area.alias("area"), F.col("name").alias("name")))).alias("best")).select(key, F.col("best.name").alias("block_id"))


def first_positions(shapes: DataFrame) -> DataFrame:
    """``bbox_uuid, latitude, longitude``: where the geometry of each segment flow starts."""
    start = F.min_by(F.struct("latitude", "longitude"), "sequence_order")
    return shapes.groupBy(F.col("flow_uuid").alias("bbox_uuid")).agg(start.alias("start")).select("bbox_uuid", "start.*")


def place_to_block(places: DataFrame) -> DataFrame:
    """place_id to block_id; fails in the job if a place stands in two rows."""
    once = places.groupBy("place_id").agg(F.count("*").alias("n"), F.max("block_id").alias("block"))
    twice = F.raise_error(F.concat(F.lit("place listed twice: "), F.col("place_id").cast("string")))
    return once.select("place_id", F.when(F.col("n") == 1, F.col("block")).otherwise(twice).alias("block_id"))


def segment_to_block(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Add block_id by place; a place without a block keeps a null block."""
    return segments.join(place_to_block(places), "place_id", "left")
