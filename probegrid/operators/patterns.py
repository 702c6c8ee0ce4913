"""Congestion patterns in time and space, from the cleaned point table.

These analyses are named, not defined, by the workflow this library serves;
the definitions are given in each function. Those with quantiles read their
input more than once: pass a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probegrid.functions.distributions import normal_two_sided, student_two_sided
from probegrid.functions.order_stats import percentiles, pooled, value_positions
from probegrid.functions.scalars import epoch_micros, floor_minutes, ratio
from probegrid.operators.grid import assign_blocks, point_blocks, point_layout
from probegrid.schema import PEAK_QUANTILE

CI = "ci_percent"


def weekly_distribution(cleaned: DataFrame) -> DataFrame:
    """Mean and median congestion per weekday (Monday = 0) and hour."""
    slot = F.col("interval_15min")
    keys = ["weekday", "hour"]
    keyed = cleaned.select(F.weekday(slot).alias("weekday"), F.hour(slot).alias("hour"), CI)
    means = keyed.groupBy(*keys).agg(F.avg(CI).alias("mean_ci_percent"), F.count("*").alias("record_count"))
    medians = percentiles(keyed, keys, [CI], {"median": 0.5})
    return means.join(medians, keys).select(
        *keys, "mean_ci_percent", "record_count", F.col(f"{CI}_median").alias("median_ci_percent")
    )


def weekly_heatmap(cleaned: DataFrame) -> DataFrame:
    """One row per hour, one column per weekday: mean congestion."""
    slot = F.col("interval_15min")
    keyed = cleaned.select(F.hour(slot).alias("hour"), F.weekday(slot).alias("weekday"), CI)
    return keyed.groupBy("hour").pivot("weekday", list(range(7))).agg(F.avg(CI))


def _moments(x: str = CI) -> list[Column]:
    return [
        F.count("*").alias("record_count"),
        F.min(x).alias("min_ci_percent"),
        F.avg(x).alias("mean_ci_percent"),
        F.max(x).alias("max_ci_percent"),
        F.stddev_samp(x).alias("sd_ci_percent"),
    ]


def monthly_trend(cleaned: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "interval_15min").cast("date")
    return cleaned.groupBy(month.alias("month")).agg(*_moments(), F.avg("current_speed").alias("mean_current_speed"))


def daily_fluctuation(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("date").agg(*_moments())


def boxplot_stats(df: DataFrame, units: list[str], measure: str = CI) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers and outlier count per group."""
    wanted = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    found = percentiles(df, units, [measure], wanted)
    five = found.select(*units, *[F.col(f"{measure}_{c}").alias(c) for c in ("n", *wanted)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    five = five.withColumn("lower_fence", F.col("q1") - reach).withColumn("upper_fence", F.col("q3") + reach)
    x = F.col(measure)
    inside = x.between(F.col("lower_fence"), F.col("upper_fence"))
    ends = (
        df.select(*units, measure)
        .join(five.select(*units, "lower_fence", "upper_fence"), units)
        .groupBy(*units)
        .agg(
            F.min(F.when(inside, x)).alias("lower_whisker"),
            F.max(F.when(inside, x)).alias("upper_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return five.join(ends, units)


def impact_comparison(cleaned: DataFrame, calendar: DataFrame) -> DataFrame:
    """Affected against normal days: means, difference, ratio and Welch's t.

    ``calendar`` has date and label ('affected' or 'normal').
    """
    labelled = cleaned.join(calendar.select("date", "label"), "date")
    x = F.col(CI)

    def part(label: str) -> list[Column]:
        mine = F.when(F.col("label") == label, x)
        return [
            F.count(mine).alias(f"{label}_n"),
            F.avg(mine).alias(f"{label}_mean"),
            F.var_samp(mine).alias(f"{label}_var"),
        ]

    m = labelled.agg(*part("affected"), *part("normal"))
    a, b = F.col("affected_mean"), F.col("normal_mean")
    error = F.sqrt(F.col("affected_var") / F.nullif(F.col("affected_n"), F.lit(0)) + F.col("normal_var") / F.nullif(F.col("normal_n"), F.lit(0)))
    return m.select(
        "affected_n", "normal_n", "affected_mean", "normal_mean",
        (a - b).alias("difference"),
        ratio(a, b).alias("ratio"),
        ratio(a - b, error).alias("welch_t"),
    )


def impact_tests(cleaned: DataFrame, calendar: DataFrame) -> DataFrame:
    """Is congestion on affected days another than on normal ones? Two tests, two-sided.

    Welch's t with its degrees of freedom, and the rank-sum statistic U of the
    affected records with average ranks, its variance corrected for ties, by the normal
    distribution without a continuity correction. A group without records, or values
    that are all equal, give null statistics and null probabilities. ``cleaned`` is
    read twice.
    """
    labelled = pooled(cleaned.join(calendar.select("date", "label").where("label in ('affected', 'normal')"), "date").where(F.col(CI).isNotNull()))
    mine = F.col("label") == "affected"
    a, b = F.when(mine, F.col(CI)), F.when(~mine, F.col(CI))
    m = labelled.groupBy("unit").agg(
        F.count(a).alias("affected_n"), F.count(b).alias("normal_n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    ea, eb = F.col("va") / F.nullif(F.col("affected_n"), F.lit(0)), F.col("vb") / F.nullif(F.col("normal_n"), F.lit(0))
    parts = ea * ea / F.nullif(F.col("affected_n") - 1, F.lit(0)) + eb * eb / F.nullif(F.col("normal_n") - 1, F.lit(0))
    welch = m.select(
        "unit", "affected_n", "normal_n", ratio(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)).alias("welch_t"), ratio((ea + eb) * (ea + eb), parts).alias("welch_df"))
    # ranks of counted values: one row per distinct value
    places = value_positions(labelled, ["unit"], CI)
    counts = labelled.groupBy(F.col("unit").alias("_unit"), F.col(CI).cast("double").alias("_value")).agg(F.count_if(mine).alias("affected"))
    ranked = places.join(counts, (F.col("unit") == F.col("_unit")) & (F.col("value") == F.col("_value")))
    equal = F.col("n_equal").cast("decimal(18,0)")
    twice = F.col("affected").cast("decimal(18,0)") * (2 * F.col("n_below") + F.col("n_equal") + 1).cast("decimal(19,0)")
    sums = ranked.groupBy("unit").agg(F.sum(twice).cast("double").alias("twice_ranks"), F.sum((equal * equal * equal - equal).cast("double")).alias("ties"))
    n, k = F.col("affected_n").cast("double"), F.col("normal_n").cast("double")
    total = n + k
    u = F.col("twice_ranks") / 2 - n * (n + 1) / 2
    spread = n * k / 12 * (total + 1 - ratio(F.col("ties"), total * (total - 1)))
    both = welch.join(sums, "unit").withColumn("rank_sum_u", u).withColumn("rank_sum_z", ratio(u - n * k / 2, F.sqrt(F.when(spread > 0, spread))))
    return both.select(
        "affected_n", "normal_n", "welch_t", "welch_df", student_two_sided(F.col("welch_t"), F.col("welch_df")).alias("welch_p"),
        F.when((n > 0) & (k > 0), F.col("rank_sum_u")).alias("rank_sum_u"), "rank_sum_z", normal_two_sided(F.col("rank_sum_z")).alias("rank_sum_p"))


def hotspots(cleaned: DataFrame, k: int = 10, q: float = PEAK_QUANTILE) -> DataFrame:
    """The ``k`` points most often at or above the pooled quantile of congestion."""
    threshold = percentiles(pooled(cleaned), ["unit"], [CI], {"threshold": q}).select(f"{CI}_threshold")
    high = F.col(CI) >= threshold.scalar()
    shares = cleaned.groupBy("point_id").agg(
        F.count("*").alias("record_count"), F.count_if(high).alias("high_count")
    )
    share = F.col("high_count") / F.col("record_count")
    return shares.withColumn("high_share", share).orderBy(F.desc("high_share"), "point_id").limit(k)


def speed_profile(cleaned: DataFrame, config: DataFrame) -> DataFrame:
    """Mean speed along the corridor and its drop from the point before.

    One row per configured point is ordered, per block.
    """
    means = assign_blocks(cleaned, config).groupBy("block_id", "point_id").agg(
        F.avg("current_speed").alias("mean_current_speed"), F.avg(CI).alias("mean_ci_percent")
    )
    order = Window.partitionBy("block_id").orderBy("corridor_order")
    return means.join(point_layout(config), "point_id").select(
        "block_id",
        "point_id",
        "corridor_order",
        "mean_current_speed",
        "mean_ci_percent",
        (F.lag("mean_current_speed").over(order) - F.col("mean_current_speed")).alias("speed_drop"),
    )


def functional_class_compare(flows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Speed and jam factor by functional class; a flow counts once per class it has.

    The classes of a flow, bounded by its document, are one row until flows meet them.
    Both sides grow alike and neither is ever broadcast (see ``lineage.segment_geometry``).
    """
    # in a struct, as a set leaves plain nulls out
    found = shapes.groupBy(F.col("flow_uuid").alias("bbox_uuid")).agg(F.collect_set(F.struct("functional_class")).alias("classes"))
    classes = flows.join(found.hint("merge"), "bbox_uuid").select("speed_kmh", "jam_factor", F.explode("classes.functional_class").alias("functional_class"))
    return classes.groupBy("functional_class").agg(
        F.count("*").alias("flow_count"),
        F.avg("speed_kmh").alias("mean_speed"),
        F.avg("jam_factor").alias("mean_jam_factor"),
        F.max("jam_factor").alias("max_jam_factor"),
    )


def time_space_matrix(cleaned: DataFrame, config: DataFrame) -> DataFrame:
    """One row per 30-minute slot, one column of mean speed per point of the layout.

    The layout names the columns, so no pass over the records looks for them; a
    point outside it fails the job that meets it. For layouts of thousands of
    points use ``time_space_long``.
    """
    slot = floor_minutes(F.col("interval_15min"), 30).alias("interval_30min")
    points = [r.point_id for r in point_layout(config).select("point_id").orderBy("point_id").toLocalIterator()]
    return assign_blocks(cleaned, config).groupBy(slot).pivot("point_id", points).agg(F.avg("current_speed"))


def time_space_long(cleaned: DataFrame, config: DataFrame) -> DataFrame:
    """The same diagram as rows, for layouts with many points."""
    slot = floor_minutes(F.col("interval_15min"), 30).alias("interval_30min")
    cells = cleaned.groupBy(slot, "point_id").agg(
        F.avg("current_speed").alias("mean_current_speed"), F.avg(CI).alias("mean_ci_percent")
    )
    return cells.join(point_layout(config), "point_id", "left")


def peak_hours(cleaned: DataFrame, q: float = PEAK_QUANTILE) -> DataFrame:
    """Per date: the hour with the highest mean congestion, and the number of
    hours at or above the quantile of the hourly means of all dates."""
    hourly = cleaned.groupBy("date", F.hour("interval_15min").alias("hour")).agg(F.avg(CI).alias("mean_ci"))
    limit = percentiles(pooled(hourly), ["unit"], ["mean_ci"], {"limit": q}).select("mean_ci_limit").scalar()
    limits = hourly.groupBy("date").agg(
        F.max(F.struct("mean_ci", (-F.col("hour")).alias("late"))).alias("top"),
    )
    return hourly.join(limits, "date").groupBy("date").agg(
        F.max(-F.col("top.late")).alias("peak_hour"),
        F.max("top.mean_ci").alias("peak_mean_ci"),
        F.count_if(F.col("mean_ci") >= limit).alias("hours_at_peak"),
    )


def _runs(df: DataFrame, keys: list[str], position: str, name: str) -> DataFrame:
    """Number unbroken runs of ``position`` (whole numbers, distinct per key): equal ``name`` within keys is one run."""
    return df.withColumn(name, F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position)))


def bottlenecks(cleaned: DataFrame, config: DataFrame, q: float = PEAK_QUANTILE) -> DataFrame:
    """Where queues begin: congested stretches of the corridor that stand at one head.

    A cell is a point of the layout in a half hour; it is congested if its mean
    congestion is at or above the ``q`` quantile of all cells. Congested neighbours
    along a block in one half hour are a stretch; its head is the last point in driving
    order, as queues grow backwards. Stretches with one head in consecutive half
    hours are one bottleneck: head, first and last half hour, duration, largest and
    mean extent in points, and mean congestion. Pass a stored table.

    Runs are found by block and half hour (as many rows as a block has points), then
    by head (as many as there are half hours).
    """
    slot = floor_minutes(F.col("interval_15min"), 30)
    cells = assign_blocks(cleaned, config).groupBy("block_id", "point_id", slot.alias("interval_30min")).agg(F.avg(CI).alias("ci"))
    limit = percentiles(pooled(cells), ["unit"], ["ci"], {"limit": q}).select("ci_limit").scalar()
    along = Window.partitionBy("block_id").orderBy("corridor_order", "point_id")
    blocks = point_blocks(config)
    places = point_layout(config).join(blocks, "point_id").withColumn("place", F.row_number().over(along)).select("point_id", "place")
    high = cells.where(F.col("ci") >= limit).join(places, "point_id")
    stretches = _runs(high, ["block_id", "interval_30min"], "place", "run").groupBy("block_id", "interval_30min", "run").agg(
        F.max_by("point_id", "place").alias("head_point_id"), F.count("*").alias("extent"), F.sum("ci").alias("ci_sum"))
    half_hour = F.floor(epoch_micros(F.col("interval_30min")) / (30 * 60 * 1_000_000)).cast("bigint")
    standing = _runs(stretches.withColumn("half_hour", half_hour), ["block_id", "head_point_id"], "half_hour", "stand")
    return standing.groupBy("block_id", "head_point_id", "stand").agg(
        F.min("interval_30min").alias("first_slot"), F.max("interval_30min").alias("last_slot"), (F.count("*") * 30).alias("minutes"),
        F.max("extent").alias("max_extent"), F.avg("extent").alias("mean_extent"), (F.sum("ci_sum") / F.sum("extent")).alias("mean_ci_percent"),
    ).drop("stand")


def peak_spreading(cleaned: DataFrame, q: float = PEAK_QUANTILE) -> DataFrame:
    """Per date: how long the longest peak lasted and how the peak broke up.

    A half hour is at peak if its mean congestion over all points is at or above the
    ``q`` quantile of all half hours. The longest unbroken stretch of the date counts
    (the earliest of equal ones); half hours without records break a stretch.
    Pass a stored table.
    """
    slots = cleaned.groupBy("date", floor_minutes(F.col("interval_15min"), 30).alias("slot")).agg(F.avg(CI).alias("ci"))
    limit = percentiles(pooled(slots), ["unit"], ["ci"], {"limit": q}).select("ci_limit").scalar()
    number = (F.hour("slot") * 2 + F.floor(F.minute("slot") / 30)).cast("int")
    high = _runs(slots.where(F.col("ci") >= limit).withColumn("number", number), ["date"], "number", "run")
    stretches = high.groupBy("date", "run").agg(F.min("slot").alias("start"), F.count("*").alias("n"))
    first = F.struct(F.col("n"), (-epoch_micros(F.col("start"))).alias("early"), F.col("start"))
    longest = stretches.groupBy("date").agg(F.count("*").alias("stretches"), F.sum("n").alias("peak_slots"), F.max(first).alias("top"))
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30), F.lit(0))
    days = slots.select("date").distinct()
    zero = F.lit(0).cast("bigint")
    return days.join(longest, "date", "left").select(
        "date", F.coalesce("peak_slots", zero).alias("peak_slots"), F.coalesce("stretches", zero).alias("stretches"),
        F.coalesce("top.n", zero).alias("longest_slots"), F.col("top.start").alias("longest_start"),
        (F.col("top.start") + half * F.col("top.n").cast("int")).alias("longest_end"))


def weekly_spreading(cleaned: DataFrame, q: float = PEAK_QUANTILE) -> DataFrame:
    """Per week (its Monday): lengths and starts of the daily longest peaks, and their change from the week before.

    The step to the week before is over weeks that have records.
    """
    days = peak_spreading(cleaned, q).withColumn("week", F.date_trunc("week", "date").cast("date"))
    minute = F.hour("longest_start") * 60 + F.minute("longest_start")
    weeks = days.groupBy("week").agg(
        F.count("*").alias("days"), F.sum("peak_slots").alias("peak_slots"), F.max("longest_slots").alias("longest_slots"),
        F.avg("longest_slots").alias("mean_longest_slots"), F.avg(minute).alias("mean_start_minute"))
    before = Window.orderBy("week")
    step = lambda c: F.col(c) - F.lag(c).over(before)
    return weeks.withColumn("spreading_slots", step("mean_longest_slots")).withColumn("shift_minutes", step("mean_start_minute"))
