"""Bottlenecks, spreading and statistical tests against brute force and numerical integrals."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probegrid.functions.distributions import normal_two_sided, student_two_sided
from probegrid.operators import patterns

T0 = dt.datetime(2024, 1, 1)
CLEANED = "point_id string, interval_15min timestamp_ntz, date date, ci_percent double"


def student(t, df):
    """By Simpson's rule in the angle, t = sqrt(df) tan(x)."""
    x = np.linspace(0, math.atan(abs(t) / math.sqrt(df)), 200_001)
    k = np.ones(len(x))
    k[1:-1:2], k[2:-1:2] = 4, 2
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.log(math.pi) / 2
    return 1 - 2 * float((k * np.exp(log_norm + (df - 1) * np.log(np.cos(x)))).sum()) * (x[1] - x[0]) / 3


def test_student_and_normal(spark):
    cases = [(t, df) for t in (0.0, -0.001, 0.3, 1.0, -1.7, 1.7321, 2.5, 4.0, 7.5) for df in (0.7, 1.0, 2.0, 3.5, 10.0, 47.3, 300.0, 5000.0)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", student_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert max(abs(r.p - student(r.t, r.df)) for r in got) < 1e-9
    zs = [(z,) for z in (0.0, 0.001, -0.5, 1.0, 1.96, 2.8, 2.83, -3.5, 6.0, 12.0)]
    for r in spark.createDataFrame(zs, "z double").select("z", normal_two_sided(F.col("z")).alias("p"), student_two_sided(F.col("z"), F.lit(1e6)).alias("q"), student_two_sided(F.col("z"), F.lit(1.000001e6)).alias("s")).collect():
        want = math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p - want) < 1e-12 and r.p == pytest.approx(want, rel=1e-9)
        assert abs(r.q - r.s) < 1e-9 and abs(r.q - want) < 1e-5
    nothing = spark.createDataFrame([(1.0, None), (None, 3.0), (1.0, 0.0), (1.0, -2.0)], "t double, df double")
    assert all(r.p is None for r in nothing.select(student_two_sided(F.col("t"), F.col("df")).alias("p")).collect())


def day(n):
    return (T0 + dt.timedelta(days=n)).date()


def impact(spark, affected, normal):
    rows = [("p", T0, day(0), x) for x in affected] + [("p", T0, day(1), x) for x in normal] + [("p", T0, day(2), 5.0)]
    calendar = spark.createDataFrame([(day(0), "affected"), (day(1), "normal"), (day(2), "other")], "date date, label string")
    return patterns.impact_tests(spark.createDataFrame(rows, CLEANED).repartition(3), calendar).first()


def test_impact_tests(spark):
    r = random.Random(1)
    a, b = [round(r.gauss(5, 2), 1) for _ in range(60)], [round(r.gauss(4, 3), 1) for _ in range(90)]
    got = impact(spark, a + [None], b)
    va, vb = np.var(a, ddof=1) / 60, np.var(b, ddof=1) / 90
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va ** 2 / 59 + vb ** 2 / 89)
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    ties = sum(k ** 3 - k for k in (sum(1 for _ in g) for _, g in itertools.groupby(sorted(a + b))))
    z = (u - 60 * 90 / 2) / math.sqrt(60 * 90 / 12 * (151 - ties / (150 * 149)))
    assert (got.affected_n, got.normal_n) == (60, 90)
    assert got.welch_t == pytest.approx(t, rel=1e-12) and got.welch_df == pytest.approx(df, rel=1e-12)
    assert abs(got.welch_p - student(t, df)) < 1e-9
    assert got.rank_sum_u == u and got.rank_sum_z == pytest.approx(z, rel=1e-12)
    assert abs(got.rank_sum_p - math.erfc(abs(z) / math.sqrt(2))) < 1e-9


@pytest.mark.parametrize("a, b", [([], [1.0, 2.0]), ([3.0, 3.0], [3.0, 3.0, 3.0]), ([1.0], [2.0])])
def test_groups_without_spread(spark, a, b):
    got = impact(spark, a, b)
    assert got.welch_t is None and got.welch_p is None
    assert (got.rank_sum_p is None) == (not a or len(set(a + b)) == 1)


def grid_rows(seed, points, slots, days=1):
    r = random.Random(seed)
    return [(f"p{p}", T0 + dt.timedelta(days=d, minutes=30 * s + 15 * h), day(d), float(r.randrange(12)))
            for d in range(days) for p in range(points) for s in range(slots) for h in range(2) if r.random() < 0.8]


def means(rows, key):
    found = {}
    for row in rows:
        found.setdefault(key(row), []).append(row[3])
    return {k: sum(v) / len(v) for k, v in found.items()}


def test_bottlenecks(spark):
    rows = grid_rows(3, 9, 40)
    blocks = {f"p{p}": "A" if p < 5 else "B" for p in range(9)}
    # the layout leaves gaps in its order: neighbours are next points, not next numbers
    config = spark.createDataFrame([(f"p{p}", blocks[f"p{p}"], 10 * p) for p in range(9)], "point_id string, block_id string, corridor_order int")
    cells = means(rows, lambda x: (x[0], int((x[1] - T0).total_seconds() // 1800)))
    limit = np.quantile(list(cells.values()), 0.6)
    high = {k for k, v in cells.items() if v >= limit}
    heads = {}
    for s in range(40):
        for block in "AB":
            run = []
            names = [p for p in sorted(blocks) if blocks[p] == block]
            for p in [*names, None]:
                if p is not None and (p, s) in high:
                    run.append(p)
                elif run:
                    heads.setdefault((block, run[-1]), {})[s] = (len(run), sum(cells[q, s] for q in run))
                    run = []
    want = []
    for (block, head), of in heads.items():
        for _, g in itertools.groupby(enumerate(sorted(of)), lambda x: x[1] - x[0]):
            ss = [s for _, s in g]
            n = [of[s][0] for s in ss]
            want.append((block, head, T0 + dt.timedelta(minutes=30 * ss[0]), T0 + dt.timedelta(minutes=30 * ss[-1]), 30 * len(ss), max(n), round(sum(n) / len(n), 9), round(sum(of[s][1] for s in ss) / sum(n), 9)))
    got = patterns.bottlenecks(spark.createDataFrame(rows, CLEANED).repartition(3), config, q=0.6)
    got = [(r.block_id, r.head_point_id, r.first_slot, r.last_slot, r.minutes, r.max_extent, round(r.mean_extent, 9), round(r.mean_ci_percent, 9)) for r in got.collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_spreading(spark):
    rows = grid_rows(5, 2, 48, days=17)
    slots = means(rows, lambda x: (x[2], int((x[1] - T0).total_seconds() // 1800) % 48))
    limit = np.quantile(list(slots.values()), 0.7)
    want = {}
    for d in sorted({k[0] for k in slots}):
        high = sorted(s for e, s in slots if e == d and slots[e, s] >= limit)
        runs = [[s for _, s in g] for _, g in itertools.groupby(enumerate(high), lambda x: x[1] - x[0])]
        best = max(runs, key=lambda x: (len(x), -x[0]), default=[])
        start = dt.datetime.combine(d, dt.time()) + dt.timedelta(minutes=30 * best[0]) if best else None
        want[d] = (len(high), len(runs), len(best), start, start and start + dt.timedelta(minutes=30 * len(best)))
    df = spark.createDataFrame(rows, CLEANED).repartition(3)
    got = {r.date: (r.peak_slots, r.stretches, r.longest_slots, r.longest_start, r.longest_end) for r in patterns.peak_spreading(df, 0.7).collect()}
    assert got == want
    weeks = patterns.weekly_spreading(df, 0.7).orderBy("week").collect()
    assert [(r.week, r.days) for r in weeks] == [(day(0), 7), (day(7), 7), (day(14), 3)]
    mean = [sum(want[day(d)][2] for d in span) / len(span) for span in (range(7), range(7, 14), range(14, 17))]
    assert [r.mean_longest_slots for r in weeks] == pytest.approx(mean)
    assert weeks[0].spreading_slots is None and weeks[2].spreading_slots == pytest.approx(mean[2] - mean[1])
