"""Boxes of many sizes, blocks by place and position, lineage with gaps, weights."""

import random

import pytest

from probegrid.operators import grid, lineage, spatial

POINTS = "id long, longitude double, latitude double"


def brute(points, boxes):
    out = set()
    for i, x, y in points:
        for name, text in boxes:
            try:
                a, b, c, d = (float(v) for v in text.split(","))
            except ValueError:
                continue
            if x is not None and y is not None and a <= x <= c and b <= y <= d:
                out.add((i, name))
    return out


@pytest.fixture(scope="module")
def places(spark):
    r = random.Random(6)
    boxes = [("country", "90,-20,130,25"), ("world", "-180,-90,180,90"), ("point", "110.5,1.5,110.5,1.5"), ("line", "110,1,111,1")]
    for n in range(1000):
        w = 10 ** r.uniform(-4, 0.5)
        x, y = r.uniform(105, 115), r.uniform(-2, 4)
        boxes.append((f"b{n}", f"{x},{y},{x + w},{y + w * r.uniform(0.1, 3)}"))
    bad = [("backwards", "111,1,110,2"), ("words", "a,b,c,d"), ("three", "1,2,3"), ("none", None), ("nan", "NaN,1,2,3"), ("endless", "-Infinity,1,2,3"), ("five", "1,1,2,2,3")]
    points = [(n, r.uniform(104, 116), r.uniform(-3, 5)) for n in range(2000)]
    points += [(5000, 110.5, 1.5), (5001, 110.0, 1.0), (5002, None, 1.0), (5003, float("nan"), 1.0), (5004, float("inf"), 1.0), (5005, 1e300, 1.0)]
    make = spark.createDataFrame
    return points, boxes, bad, make(points, POINTS).repartition(4), make(boxes + bad, "name string, bbox string").repartition(3)


def test_points_in_boxes(places):
    points, boxes, _, p, b = places
    assert {(r.id, r.name) for r in spatial.points_in_boxes(p, b).collect()} == brute(points, boxes)


def test_no_box_makes_many_cells(places):
    _, boxes, bad, _, b = places
    cells = spatial.box_cells(b).groupBy("name").count().collect()
    assert {r.name for r in cells} == {n for n, _ in boxes}
    assert max(r["count"] for r in cells) <= 4
    assert {r.name for r in spatial.unusable_boxes(b).collect()} == {n for n, _ in bad}


def test_four_numbers_in_order_are_usable_wherever_they_lie(spark):
    boxes = [("street", "1109,1,1109.0001,1.5"), ("far", "1e300,0,1e300,1"), ("huge", "-1e308,-1e308,1e308,1e308"), ("low", "-5000,-2000,-4000,-1000"), ("tiny", "2e19,2e19,2e19,2e19")]
    points = [(1, 1109.00005, 1.25), (2, 1e300, 0.5), (3, -4500.0, -1500.0), (4, 2e19, 2e19), (5, 1109.0002, 1.25), (6, 7e18, -7e18)]
    b, p = spark.createDataFrame([*boxes, ("bad", "2,1,1,2")], "name string, bbox string"), spark.createDataFrame(points, POINTS)
    assert [r.name for r in spatial.unusable_boxes(b).collect()] == ["bad"]
    assert {(r.id, r.name) for r in spatial.points_in_boxes(p, b).collect()} == brute(points, boxes)
    cells = {r.name: r["count"] for r in spatial.box_cells(b).groupBy("name").count().collect()}
    # only a box wider than the widest cell, 4 ** 511, touches more than four
    assert cells.pop("huge") <= 81 and max(cells.values()) <= 4


def test_blocks_by_position(places):
    points, boxes, _, p, b = places
    pairs = brute(points, boxes)
    area = {n: (lambda v: (v[2] - v[0]) * (v[3] - v[1]))([float(x) for x in t.split(",")]) for n, t in boxes}
    want = {i: min(((area[n], n) for j, n in pairs if j == i), default=(0, None))[1] for i, _, _ in points[:200] + points[-6:]}
    got = {r.id: r.block_id for r in spatial.blocks_by_position(p, b, "id").collect()}
    assert len(got) == len(points) and all(got[i] == n for i, n in want.items())


def test_no_boxes_at_all(spark, places):
    none = spark.createDataFrame([("x", "")], "name string, bbox string")
    assert spatial.points_in_boxes(places[3], none).count() == 0
    assert spatial.blocks_by_position(places[3], none, "id").where("block_id is null").count() == len(places[0])


def test_place_listed_twice(spark):
    flows = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "place_id string, n int")
    blocks = spark.createDataFrame([("p", "1"), ("z", "2")], "place_id string, block_id string")
    assert {(r.n, r.block_id) for r in spatial.segment_to_block(flows, blocks).collect()} == {(1, "1"), (2, None), (3, None)}
    with pytest.raises(Exception, match="place listed twice: p"):
        spatial.segment_to_block(flows, blocks.union(blocks)).collect()


def test_lineage_loses_no_flow(spark):
    flows = spark.createDataFrame([("f1", "a1"), ("f2", "a2"), ("f3", "gone"), ("f4", None)], "uuid string, point_uuid string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' capture_time")
    assigned = spark.createDataFrame([("a1", "r", "1", "2"), ("a2", "r", "9", "9")], "uuid string, pd_uuid string, latitude string, longitude string")
    site = spark.createDataFrame([("S", "1", "2")], "original_id string, latitude string, longitude string")
    assert [(r.uuid, r.point_id) for r in lineage.flow_to_point(flows, assigned, site).collect()] == [("f1", "S")]
    assert {(r.uuid, r.link) for r in lineage.unlinked_flows(flows, assigned, site).collect()} == {("f2", "no_point"), ("f3", "no_assignment"), ("f4", "no_assignment")}
    assert {(r.link, r.flows) for r in lineage.lineage_report(flows, assigned, site).collect()} == {("linked", 1), ("no_point", 1), ("no_assignment", 2)}
    with pytest.raises(Exception, match="point position listed twice: 1, 2"):
        lineage.flow_to_point(flows, assigned, site.union(site)).collect()


def test_points_without_weight(spark):
    rows = [(p, v) for p, v in (("1", 10.0), ("2", 20.0), ("3", 30.0))]
    names = [*grid.POINT_MEANS]
    cleaned = spark.createDataFrame(rows, "point_id string, v double").selectExpr("point_id", "timestamp_ntz'2024-01-01 00:00:00' interval_15min", *[f"v as {c}" for c in names])
    config = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B")], "point_id string, block_id string")
    weights = spark.createDataFrame([("1", 2.0)], "point_id string, weight double")
    got = {r.block_id: (r.weighted_ci_percent, r.total_weight, r.unweighted_points) for r in grid.block_30min_weighted(cleaned, config, weights).collect()}
    assert got == {"A": (10.0, 2.0, 1), "B": (None, None, 1)}
    assert {(r.point_id, r.records) for r in grid.unweighted_points(cleaned, weights).collect()} == {("2", 1), ("3", 1)}
    for bad in ([("1", 2.0), ("1", 2.0)], [("1", 0.0)], [("1", None)]):
        with pytest.raises(Exception, match="one weight above zero is needed for point 1"):
            grid.block_30min_weighted(cleaned, config, spark.createDataFrame(bad, "point_id string, weight double")).collect()
