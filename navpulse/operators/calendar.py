"""Date dimension with Jalali dates, trading calendar and minute grids.

The dimension has one row per date (366 a year), built by Spark from a closed form; jobs
join it by date instead of converting values one by one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from navpulse.functions import times
from navpulse.settings import MarketHours

# Years of the 33-year cycle that are leap, and one known New Year's Day.
LEAP_PLACES = (1, 5, 9, 13, 17, 22, 26, 30)
CYCLE = 33
KNOWN_YEAR, KNOWN_NEW_YEAR = 1403, dt.date(2024, 3, 20)
FIRST_YEAR, LAST_YEAR = 1210, 1633

# Holidays on the same Jalali date every year (month, day, name).
SOLAR_HOLIDAYS = (
    (1, 1, "نوروز"),
    (1, 2, "نوروز"),
    (1, 3, "نوروز"),
    (1, 4, "نوروز"),
    (1, 12, "روز جمهوری اسلامی"),
    (1, 13, "روز طبیعت"),
    (3, 14, "رحلت امام خمینی"),
    (3, 15, "قیام ۱۵ خرداد"),
    (11, 22, "پیروزی انقلاب اسلامی"),
    (12, 29, "ملی شدن صنعت نفت"),
)
# Religious holidays (year, month, day, name), listed for 1405 only.
LUNAR_HOLIDAYS = (
    (1405, 1, 1, "عید فطر"),
    (1405, 1, 2, "تعطیلی عید فطر"),
    (1405, 1, 25, "شهادت امام جعفر صادق"),
    (1405, 3, 6, "عید قربان"),
    (1405, 3, 14, "عید غدیر"),
    (1405, 4, 3, "تاسوعا"),
    (1405, 4, 4, "عاشورا"),
    (1405, 5, 13, "اربعین"),
    (1405, 5, 21, "رحلت پیامبر و شهادت امام حسن"),
    (1405, 5, 22, "شهادت امام رضا"),
    (1405, 5, 30, "شهادت امام حسن عسکری"),
    (1405, 6, 8, "میلاد پیامبر و امام جعفر صادق"),
    (1405, 8, 22, "شهادت حضرت فاطمه"),
    (1405, 10, 2, "ولادت امام علی"),
    (1405, 10, 16, "مبعث"),
    (1405, 11, 4, "نیمه شعبان"),
    (1405, 12, 9, "شهادت امام علی"),
    (1405, 12, 19, "عید فطر"),
    (1405, 12, 20, "تعطیلی عید فطر"),
)
NAME_GLUE = " و "


def _leaps_before(year: Column) -> Column:
    places = F.array(*[F.lit(p) for p in LEAP_PLACES])
    return F.floor(year / CYCLE) * len(LEAP_PLACES) + F.size(
        F.filter(places, lambda p: p < year % CYCLE)
    )


def new_year_day(year: Column) -> Column:
    """Gregorian date on which a Jalali year starts."""
    known = F.lit(KNOWN_YEAR)
    days = (year - known) * 365 + _leaps_before(year) - _leaps_before(known)
    return F.date_add(F.lit(KNOWN_NEW_YEAR), days.cast("int"))


def jalali_year(day: Column | str) -> Column:
    """Jalali year of a date, by the closed form; raises outside the years it holds for."""
    day = F.col(day) if isinstance(day, str) else day
    year = F.year(day) - 621
    year = F.when(day >= new_year_day(year), year).otherwise(year - 1)
    outside = ~year.between(FIRST_YEAR, LAST_YEAR)
    return F.when(outside, F.raise_error(F.lit("date outside the Jalali calendar"))).otherwise(year).cast("int")


def year_start(day: Column | str) -> Column:
    """First day of the Jalali year that a date lies in."""
    return new_year_day(jalali_year(day))


def span_of(*dates: tuple[DataFrame, Column | str]) -> tuple[dt.date, dt.date] | None:
    """Smallest and largest date of some columns, each by a one-row aggregate; None without any."""
    found = []
    for df, column in dates:
        day = F.to_date(column)
        found += [x for x in df.agg(F.min(day), F.max(day)).first() if x is not None]
    return (min(found), max(found)) if found else None


def require_calendar(df: DataFrame, column: str, day: str) -> DataFrame:
    """Raises on a row whose date has no calendar row (``column`` is null), instead of losing it."""
    missing = F.raise_error(F.concat(F.lit("no calendar row for "), F.col(day).cast("string")))
    return df.withColumn(column, F.when(F.col(column).isNull() & F.col(day).isNotNull(), missing).otherwise(F.col(column)))


def jalali_dates(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per Jalali date of every Jalali year that touches the span."""
    start, stop = first.year - 622, last.year - 620
    if start < FIRST_YEAR or stop > LAST_YEAR:
        raise ValueError(f"dates outside {FIRST_YEAR}-{LAST_YEAR} of the Jalali calendar")
    years = spark.range(start, stop + 1, 1, 1).select(
        F.col("id").cast("int").alias("jalali_year"), new_year_day(F.col("id")).alias("year_start")
    )
    length = F.datediff(new_year_day(F.col("jalali_year") + 1), F.col("year_start"))
    n = F.col("_n")
    days = years.select(
        "jalali_year", "year_start", F.explode(F.sequence(F.lit(0), length - 1)).alias("_n")
    ).select(
        F.date_add("year_start", n).alias("day"),
        "jalali_year",
        F.when(n < 186, F.floor(n / 31) + 1)
        .otherwise(F.floor((n - 186) / 30) + 7)
        .cast("int")
        .alias("jalali_month"),
        F.when(n < 186, n % 31 + 1).otherwise((n - 186) % 30 + 1).cast("int").alias("jalali_day"),
        "year_start",
    )
    return days.withColumn(
        "day_fa", F.format_string("%04d/%02d/%02d", "jalali_year", "jalali_month", "jalali_day")
    )


def constant_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A short fixed table, built in the JVM by one statement."""

    def literal(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"DATE'{v}'" if isinstance(v, dt.date) else str(v)

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def official_holidays(dates: DataFrame) -> DataFrame:
    """day, name: the listed holidays on the given dates; names of one day are joined."""
    spark = dates.sparkSession
    month_day = ["jalali_month", "jalali_day", "name"]
    solar = constant_rows(spark, ["place", *month_day], [
        (i, *row) for i, row in enumerate(SOLAR_HOLIDAYS)
    ])
    lunar = constant_rows(spark, ["place", "jalali_year", *month_day], [
        (100 + i, *row) for i, row in enumerate(LUNAR_HOLIDAYS)
    ])
    by_rule = dates.join(F.broadcast(solar), ["jalali_month", "jalali_day"])
    listed = dates.join(F.broadcast(lunar), ["jalali_year", "jalali_month", "jalali_day"])
    named = by_rule.select("day", "place", "name").unionByName(
        listed.select("day", "place", "name")
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", "name")))  # at most 29 a day
    return named.groupBy("day").agg(
        F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["name"])), NAME_GLUE).alias(
            "name"
        )
    )


def trading_calendar(
    spark: SparkSession,
    first: dt.date,
    last: dt.date,
    hours: MarketHours,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Every date of the span with its Jalali date, and whether and why it trades.

    What the market was seen to do outranks announced closures, these the weekly rest,
    and that the official list. ``observed`` has day, trading, note (latest versions).
    """
    dates = jalali_dates(spark, first, last).filter(F.col("day").between(first, last))
    names = official_holidays(dates).withColumnRenamed("name", "_official")
    out = dates.join(F.broadcast(names), "day", "left")
    closures = [(d, note) for d, note in sorted(hours.extra_closures.items())]
    if closures and hours.use_holidays:
        extra = constant_rows(spark, ["day", "_extra"], closures)
        out = out.join(F.broadcast(extra), "day", "left")
    else:
        out = out.withColumn("_extra", F.lit(None).cast("string"))
    if observed is not None and hours.use_holidays:
        seen = observed.select("day", F.col("trading").alias("_seen"), F.col("note").alias("_note"))
        out = out.join(seen, "day", "left")
    else:
        out = out.withColumn("_seen", F.lit(None).cast("boolean")).withColumn(
            "_note", F.lit(None).cast("string")
        )
    works = F.weekday("day").isin(*hours.weekdays)
    listed = F.col("_official").isNotNull() & F.lit(hours.use_holidays)
    source = (
        F.when(F.col("_seen").isNotNull(), "observed")
        .when(F.col("_extra").isNotNull(), "extra")
        .when(~works, "weekend")
        .when(listed, "official")
        .otherwise("weekday")
    )
    reason = (
        F.when(source == "observed", F.col("_note"))
        .when(source == "extra", F.col("_extra"))
        .when(source == "official", F.col("_official"))
    )
    trading = F.when(source == "observed", F.col("_seen")).otherwise(source == "weekday")
    return out.select(
        "day", "day_fa", "jalali_year", "jalali_month", "jalali_day", "year_start",
        trading.alias("trading"), reason.alias("reason"), source.alias("source"),
        (F.col("_official").isNotNull() | F.col("_extra").isNotNull() | F.col("_seen").isNotNull())
        .alias("listed"),
    )


def calendar_of_year(
    spark: SparkSession, jalali_year: int, hours: MarketHours, observed: DataFrame | None = None
) -> DataFrame:
    """Listed days of a Jalali year that are not plain weekly rest."""
    if not 1400 <= jalali_year <= 1500:
        raise ValueError("year must be 1400-1500")
    return calendar_of_years(spark, jalali_year, jalali_year, hours, observed).drop("jalali_year").orderBy("day")


def calendar_of_years(
    spark: SparkSession, first: int, last: int, hours: MarketHours, observed: DataFrame | None = None
) -> DataFrame:
    """The same for all Jalali years of a span."""
    days = trading_calendar(spark, dt.date(first + 621, 3, 1), dt.date(last + 622, 3, 31), hours, observed)
    listed = days.filter(F.col("jalali_year").between(first, last) & F.col("listed") & (F.col("source") != "weekend"))
    return listed.select("jalali_year", "day", "day_fa", "trading", "reason", "source")


def jalali_to_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Gregorian date of a Jalali one by the closed form; null for a date that does not exist.

    Six months of 31 days, five of 30, and a last one of 29, or 30 in a leap year. Years
    outside those that the leap rule holds for have no dates.
    """
    y, m, d = (F.col(c) if isinstance(c, str) else c for c in (year, month, day))
    leap = F.datediff(new_year_day(y + 1), new_year_day(y)) == 366
    length = F.when(m <= 6, 31).when((m <= 11) | leap, 30).otherwise(29)
    exists = y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & (d >= 1) & (d <= length)
    into = F.when(m <= 6, (m - 1) * 31).otherwise(186 + (m - 7) * 30) + d - 1
    return F.when(exists, F.date_add(new_year_day(y), into.cast("int")))


def from_jalali(df: DataFrame, calendar: DataFrame, year: str, month: str, day: str) -> DataFrame:
    """Adds the Gregorian ``day`` of a Jalali date; a date that does not exist has no match."""
    dim = calendar.select(
        F.col("jalali_year").alias(year),
        F.col("jalali_month").alias(month),
        F.col("jalali_day").alias(day),
        F.col("day").alias("gregorian_day"),
    )
    return df.join(dim, [year, month, day], "left")


def last_trading_days(calendar: DataFrame, through: dt.date, count: int) -> DataFrame:
    return (
        calendar.filter(F.col("trading") & (F.col("day") <= F.lit(through)))
        .select("day")
        .orderBy(F.col("day").desc())
        .limit(count)
    )


def minute_grid(
    df: DataFrame, day: str, start_second: Column | int, end_second: Column | int
) -> DataFrame:
    """One row per minute from start to end (both in seconds of the day, both included).

    A start after the end gives no rows. At most 1,440 rows per input row.
    """
    start = F.lit(start_second) if isinstance(start_second, int) else start_second
    end = F.lit(end_second) if isinstance(end_second, int) else end_second
    steps = F.when(start <= end, F.sequence(start, end, F.lit(times.MINUTE)))
    return df.withColumn("sod", F.explode(steps)).withColumn(
        "ts", times.at_second(day, F.col("sod"))
    )
