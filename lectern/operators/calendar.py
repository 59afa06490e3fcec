"""Calendars of issues: gaps, availability, runs of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days(lo: str, hi: str, spans: DataFrame) -> DataFrame:
    """All days of each row's span lo..hi, as ``day``."""
    return spans.withColumn("day", F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))))


def missing(issues: DataFrame, date: str, lo: str, hi: str) -> DataFrame:
    """(grain, value): missing years of lo..hi, missing months of the years that exist, missing days of the months that exist."""
    spark = issues.sparkSession
    span = spark.sql(f"SELECT DATE '{lo}' AS lo, DATE '{hi}' AS hi")
    every = days("lo", "hi", span).select("day", F.year("day").alias("y"), F.trunc("day", "month").alias("m"))
    have = issues.select(F.col(date).cast("date").alias("day")).where("day IS NOT NULL").distinct()
    have = have.select("day", F.year("day").alias("y"), F.trunc("day", "month").alias("m"))
    years, months = have.select("y").distinct(), have.select("y", "m").distinct()
    y = every.select("y").distinct().join(years, "y", "left_anti").select(F.lit("year").alias("grain"), F.col("y").cast("string").alias("value"))
    m = every.select("y", "m").distinct().join(years, "y", "left_semi").join(months, ["y", "m"], "left_anti").select(F.lit("month"), F.date_format("m", "yyyy-MM"))
    d = every.join(months, ["y", "m"], "left_semi").join(have, ["day"], "left_anti").select(F.lit("day"), F.date_format("day", "yyyy-MM-dd"))
    return y.union(m).union(d)


def outside_ranges(dates: DataFrame, date: str, ranges: DataFrame) -> DataFrame:
    """Rows whose date lies in none of ranges(lo, hi), ends included; ranges become days, so the join is on equality."""
    closed = days("lo", "hi", ranges.where("lo <= hi")).select(F.col("day").alias("_day")).distinct()
    return dates.join(closed, F.col(date).cast("date") == F.col("_day"), "left_anti")


def in_periods(dates: DataFrame, date: str, periods: DataFrame) -> DataFrame:
    """Each row with each of periods(name, lo, hi) that holds its date; an open hi never ends.

    Periods are met by year: each is exploded to its years up to the data's last, so rows and periods join on equality.
    """
    last = dates.agg(F.max(F.year(date)).alias("_last"))
    by_year = periods.crossJoin(F.broadcast(last)).withColumn("_y", F.explode(F.expr("sequence(year(lo), greatest(year(lo), least(coalesce(year(hi), _last), greatest(_last, year(lo)))))"))).drop("_last")
    cond = (F.col(date).cast("date") >= F.col("lo")) & (F.col("hi").isNull() | (F.col(date).cast("date") <= F.col("hi")))
    return dates.withColumn("_y", F.year(date)).join(by_year, "_y").where(cond).drop("_y", "lo", "hi")


def runs(numbers: DataFrame, group: str, number: str) -> DataFrame:
    """(group, first, last, n) of consecutive distinct numbers."""
    d = numbers.select(group, F.col(number).cast("bigint").alias("_x")).where("_x IS NOT NULL").distinct()
    island = F.col("_x") - F.row_number().over(Window.partitionBy(group).orderBy("_x"))
    return d.withColumn("_i", island).groupBy(group, "_i").agg(F.min("_x").alias("first"), F.max("_x").alias("last"), F.count(F.lit(1)).alias("n")).drop("_i")


def compress_sequence(numbers: DataFrame, group: str, number: str, extra_from: int = 90, gaps: int = 5) -> DataFrame:
    """Per group its numbers below ``extra_from`` as ``range`` lo-hi and ``holes`` if at most ``gaps`` lack, else as a list; the rest in ``extra``."""
    seqs = numbers.groupBy(group).agg(F.array_sort(F.collect_set(F.col(number).cast("int"))).alias("s"))
    split = seqs.select(group, F.filter("s", lambda x: x < extra_from).alias("normal"), F.filter("s", lambda x: x >= extra_from).alias("extra"))
    full = F.when(F.size("normal") > 0, F.sequence(F.array_min("normal"), F.array_max("normal"))).otherwise(F.col("normal"))
    with_holes = split.withColumn("holes", F.array_except(full, "normal"))
    compact = F.size("holes") <= gaps
    span = F.concat_ws("-", F.array_min("normal").cast("string"), F.array_max("normal").cast("string"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return with_holes.select(group, F.when(compact & (F.size("normal") > 0), span).otherwise(text("normal")).alias("numbers"), F.when(compact, text("holes")).otherwise("").alias("holes"), text("extra").alias("extra"))


def latest_available(now: Column, zone: str = "Asia/Shanghai", hour: int = 19) -> Column:
    """Today's date in the zone, or before the hour yesterday's."""
    local = F.from_utc_timestamp(now, zone)
    return F.when(F.hour(local) < hour, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local))


def is_issue_id(issue: Column) -> Column:
    """Eight digits that are a date, or six digits (year and number)."""
    return F.coalesce(F.when(issue.rlike("^[0-9]{8}$"), F.try_to_timestamp(issue, F.lit("yyyyMMdd")).isNotNull()).otherwise(issue.rlike("^[0-9]{6}$")), F.lit(False))


def daily_pick(day: Column, n: int) -> Column:
    """Days since 1970-01-01 modulo n."""
    return F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(n))


def is_closed(day: Column, lo: str | None = None, hi: str | None = None, years_missing: list[int] | None = None, days_missing: list[str] | None = None, ranges: list[tuple[str, str]] | None = None, years: list[int] | None = None, year_range: tuple[int, int] | None = None, year_out: int | None = None) -> Column:
    """Whether a publication has nothing on a day (YYYYMMDD): each rule that is given may close it, ends of ranges included.

    The lists are a publication's own settings; long ones of other data go through ``outside_ranges`` and joins.
    """
    date, year = day.cast("string"), F.substring(day.cast("string"), 1, 4).cast("int")
    rules = [
        lo is not None and date < lo, hi is not None and date > hi, bool(years_missing) and year.isin(years_missing or []), bool(days_missing) and date.isin(days_missing or []),
        *[date.between(a, b) for a, b in ranges or []], years is not None and ~year.isin(years or []), year_range is not None and ~year.between(*(year_range or (0, 0))), year_out is not None and year == year_out,
    ]
    closed = F.lit(False)
    for rule in rules:
        if rule is not False:
            closed = closed | rule
    return closed
