"""Coverage, seasonal and daily patterns of a network.

Rows are (``station_id``, a time column, ``value``). Every table here is first reduced per station and calendar cell,
so what follows runs on stations x cells rows, however long the series is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.functions.amounts import count_where
from gaugegrid.operators.windows import add_chunks, own_rows
from gaugegrid.settings import COVERAGE_CUTOFFS, WET_DAY_MM, WET_DAY_SLACK


def station_periods(rows: DataFrame, ts: str, period: str, per_day: int) -> DataFrame:
    """Readings, expected readings, total, coverage and rate per station and calendar month or year."""
    day = F.to_date(ts)
    start = F.trunc(day, period)
    days = F.datediff(F.add_months(start, 1 if period == "month" else 12), start)
    cells = rows.where(F.col("value").isNotNull()).groupBy("station_id", start.alias("start")).agg(
        F.count("*").alias("observations"), F.sum("value").alias("rain_mm"), F.max(days * per_day).alias("expected")
    )
    return cells.select(
        "station_id",
        F.year("start").alias("year"),
        *([F.month("start").alias("month")] if period == "month" else []),
        "observations",
        "expected",
        "rain_mm",
        (F.col("observations") / F.col("expected")).alias("coverage"),
        (F.col("rain_mm") * per_day / F.col("observations")).alias("rate"),
    )


def network_monthly(months: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Mean rate of the station-months with enough coverage."""
    good = months.where(F.col("coverage") >= cutoff)
    return good.groupBy("year", "month").agg(F.avg("rate").alias("value"), F.count("*").alias("stations"))


def full_calendar(monthly: DataFrame) -> DataFrame:
    """Every month between the first and last one with data; ``value`` is null where none qualified."""
    first, last = F.make_date("year", "month", F.lit(1)), F.make_date("year", "month", F.lit(1))
    spine = monthly.agg(F.min(first).alias("a"), F.max(last).alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("start")
    )
    return spine.select(F.year("start").alias("year"), F.month("start").alias("month")).join(monthly, ["year", "month"], "left")


def month_table(monthly: DataFrame, value: str = "value", *keys: str) -> DataFrame:
    """Years (or ``keys``) as rows, months as columns ``m1`` .. ``m12``."""
    return monthly.groupBy(*(keys or ("year",))).agg(*[F.max(F.when(F.col("month") == m, F.col(value))).alias(f"m{m}") for m in range(1, 13)])


def hour_table(by_year: DataFrame, value: str = "rate") -> DataFrame:
    """Years as rows, hours of the day as columns ``h0`` .. ``h23``, from a table of (year, hour)."""
    return by_year.groupBy("year").agg(*[F.max(F.when(F.col("hour") == h, F.col(value))).alias(f"h{h}") for h in range(24)])


def cutoff_sensitivity(years: DataFrame, cutoffs=COVERAGE_CUTOFFS) -> DataFrame:
    """Annual mean rate and stations at each coverage cutoff, and how far the cutoffs move the year's mean."""
    tried = years.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    means = tried.where(F.col("coverage") >= F.col("cutoff")).groupBy("year", "cutoff").agg(
        F.avg("rate").alias("rate"), F.count("*").alias("stations")
    )
    of_year = Window.partitionBy("year")  # at most one row per cutoff
    spread = F.max("rate").over(of_year) - F.min("rate").over(of_year)
    return means.withColumn("spread", F.when(F.count("*").over(of_year) == len(cutoffs), spread))


def relative_wetness(months: DataFrame, cutoff: float = 0.9, least_months: int = 12) -> DataFrame:
    """A station's rate over the network's rate of the same month, averaged over its well-covered months."""
    good = months.where(F.col("coverage") >= cutoff)
    # the network table has one row per month
    paired = good.join(F.broadcast(network_monthly(months, cutoff).select("year", "month", "value")), ["year", "month"])
    ratio = F.try_divide(F.col("rate"), F.col("value"))
    return paired.groupBy("station_id").agg(F.avg(ratio).alias("relative"), F.count("*").alias("months")).where(
        F.col("months") >= least_months
    )


def extremes_of(table: DataFrame, value: str, key: str = "station_id") -> DataFrame:
    """The keys with the largest and smallest value (ties by key)."""
    return table.agg(
        F.max_by(key, F.struct(F.col(value), F.col(key))).alias("largest"),
        F.max(value).alias("largest_value"),
        F.min_by(key, F.struct(F.col(value), F.col(key))).alias("smallest"),
        F.min(value).alias("smallest_value"),
    )


def cell_totals(rows: DataFrame, *cells: Column) -> DataFrame:
    """Total, wet readings and readings per station and cell."""
    return rows.where(F.col("value").isNotNull()).groupBy("station_id", *cells).agg(
        F.sum("value").alias("rain"), count_where(F.col("value") > 0).alias("wet"), F.count("*").alias("n")
    )


def diurnal_profile(rows: DataFrame, ts: str, least: int, per_hour: float = 1.0) -> DataFrame:
    """Mean over stations of rate, frequency and intensity per hour of day, and the hour's share of the rate."""
    cells = cell_totals(rows, F.hour(ts).alias("hour")).where(F.col("n") >= least)
    hours = cells.groupBy("hour").agg(
        F.count("*").alias("stations"),
        F.avg(F.col("rain") / F.col("n") * per_hour).alias("rate"),
        F.avg(F.col("wet") / F.col("n")).alias("frequency"),
        F.avg(F.try_divide(F.col("rain"), F.nullif(F.col("wet"), F.lit(0)))).alias("intensity"),
    )
    return hours.withColumn("share", F.col("rate") / F.sum("rate").over(Window.partitionBy(F.lit(0))))  # 24 rows


def hour_span_share(profile: DataFrame, first: int, last: int) -> DataFrame:
    return profile.agg(F.sum(F.when(F.col("hour").between(first, last), F.col("share"))).alias("share"))


def hourly_by_year(rows: DataFrame, ts: str, least: int, per_hour: float = 1.0) -> DataFrame:
    """Mean rate per year and hour over the stations with enough readings in that cell."""
    cells = cell_totals(rows, F.year(ts).alias("year"), F.hour(ts).alias("hour")).where(F.col("n") >= least)
    return cells.groupBy("year", "hour").agg(F.avg(F.col("rain") / F.col("n") * per_hour).alias("rate"))


def peak_hours(by_year: DataFrame) -> DataFrame:
    return by_year.groupBy("year").agg(F.max_by("hour", F.struct(F.col("rate"), -F.col("hour"))).alias("peak_hour"))


def month_hour(rows: DataFrame, ts: str, least: int, per_hour: float = 1.0) -> DataFrame:
    """Mean rate per month and hour, and each hour's share of its month."""
    cells = cell_totals(rows, F.month(ts).alias("month"), F.hour(ts).alias("hour")).where(F.col("n") >= least)
    rates = cells.groupBy("month", "hour").agg(F.avg(F.col("rain") / F.col("n") * per_hour).alias("rate"))
    return rates.withColumn("share", F.col("rate") / F.sum("rate").over(Window.partitionBy("month")))


def day_part_shares(month_hours: DataFrame) -> DataFrame:
    """Morning (4-9 h) and afternoon (13-18 h) share per month."""
    def part(first: int, last: int) -> Column:
        return F.sum(F.when(F.col("hour").between(first, last), F.col("share")).otherwise(0.0))

    return month_hours.groupBy("month").agg(part(4, 9).alias("morning"), part(13, 18).alias("afternoon"))


def monthly_anomaly(monthly: DataFrame) -> DataFrame:
    """Value minus the mean of its calendar month."""
    return monthly.withColumn("anomaly", F.col("value") - F.avg("value").over(Window.partitionBy("month")))


def coverage_by_month(months: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Stations with enough coverage, and median coverage of the reporting stations, per month."""
    return months.groupBy("year", "month").agg(
        count_where(F.col("coverage") >= cutoff).alias("qualifying"),
        F.percentile("coverage", 0.5).alias("median_coverage"),
    )


def stations_by_first_month(months: DataFrame) -> DataFrame:
    """Stations ranked by the first month with data."""
    first = months.groupBy("station_id").agg(F.min(F.make_date("year", "month", F.lit(1))).alias("first_month"))
    return first.withColumn("position", F.row_number().over(Window.orderBy("first_month", "station_id")))  # stations


def coverage_islands(coverage: DataFrame) -> DataFrame:
    """Runs of consecutive months without a qualifying station."""
    index = F.col("year") * 12 + F.col("month")
    empty = full_calendar(coverage).where(F.coalesce("qualifying", F.lit(0)) == 0).select(index.alias("i"), F.make_date("year", "month", F.lit(1)).alias("start"))
    island = F.col("i") - F.row_number().over(Window.orderBy("i"))  # months, a bounded calendar
    return empty.withColumn("island", island).groupBy("island").agg(
        F.min("start").alias("first_month"), F.max("start").alias("last_month"), F.count("*").alias("months")
    ).drop("island")


def wet_day_pairs(days: DataFrame, wet_mm: float = WET_DAY_MM) -> DataFrame:
    """Complete days whose previous day is complete too, with both wet states. ``day_no`` numbers the days."""
    w = Window.partitionBy("station_id", "_chunk").orderBy("day_no")
    wet = (F.col("value") >= wet_mm - WET_DAY_SLACK).cast("int")
    return (
        days.withColumn("today", wet)
        .transform(add_chunks, 1, 0, None, "day_no")
        .withColumn("yesterday", F.max("today").over(w.rangeBetween(-1, -1)))
        .transform(own_rows, 1, 0, None, "day_no")
        .where(F.col("yesterday").isNotNull())
    )


def wet_day_transition(pairs: DataFrame) -> DataFrame:
    """P(wet), P(wet after wet) and P(wet after dry) by month (0: all months)."""
    def given(state: int) -> Column:
        return F.avg(F.when(F.col("yesterday") == state, F.col("today")))

    by_month = pairs.rollup("month").agg(
        F.count("*").alias("n"), F.avg("today").alias("p_wet"),
        given(1).alias("p_wet_after_wet"), given(0).alias("p_wet_after_dry"),
    )
    return by_month.withColumn("month", F.coalesce("month", F.lit(0)))


def persistence_gaps(transition: DataFrame) -> DataFrame:
    """How much likelier a wet day is after a wet one than after a dry one: of all months, and of the months where that is most and least (ties: the
    earlier month). Months without a day of either kind before them do not count."""
    gap = F.col("p_wet_after_wet") - F.col("p_wet_after_dry")
    rows = transition.withColumn("gap", F.round(gap, 9)).where(F.col("gap").isNotNull())
    monthly = F.col("month") > 0
    return rows.agg(
        F.max(F.when(~monthly, F.col("gap"))).alias("gap"),
        F.max_by("month", F.when(monthly, F.struct(F.col("gap"), -F.col("month")))).alias("widest_month"),
        F.max(F.when(monthly, F.col("gap"))).alias("widest"),
        F.min_by("month", F.when(monthly, F.struct(F.col("gap"), F.col("month")))).alias("narrowest_month"),
        F.min(F.when(monthly, F.col("gap"))).alias("narrowest"),
    )


def extremes(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The ``k`` largest values, ties in the given order."""
    return rows.orderBy(F.desc("value"), *order).limit(k)


def neighbour_witness(days: DataFrame, pairs: DataFrame, station: str, first, last, nearest: int = 3) -> DataFrame:
    """Daily totals and wet readings of a suspect station beside those of its nearest neighbours."""
    near = pairs.where((F.col("s") == station) & (F.col("dist_km") > 0)).orderBy("dist_km", "j").limit(nearest).select(
        F.col("j").alias("station_id"), "dist_km"
    )
    own = days.sparkSession.createDataFrame([(station, 0.0)], "station_id string, dist_km double")
    chosen = F.broadcast(near.unionByName(own))  # the suspect and its nearest neighbours
    inside = days.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.join(chosen, "station_id").groupBy("day", "station_id", "dist_km").agg(
        F.sum("value").alias("total"), count_where(F.col("value") > 0).alias("wet"), F.count("*").alias("n")
    )
