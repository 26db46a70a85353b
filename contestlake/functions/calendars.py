"""Scoring calendars.

A date is turned into its period number by arithmetic, so "date inside period"
is an equality join on the number and never a range join.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calendar:
    """Weekly calendar with a short opening period.

    ``opening`` is the first day, ``regular`` the first day of period two.
    """

    opening: date
    regular: date
    periods: int
    days: int = 7

    def number(self, day: Column) -> Column:
        """Period number of a date; null outside the season."""
        regular = F.lit(self.regular)
        late = F.floor(F.datediff(day, regular) / self.days).cast("int") + 2
        n = F.when(day < F.lit(self.opening), F.lit(None)).when(day < regular, F.lit(1)).otherwise(late)
        return F.when(n <= self.periods, n).cast("int")

    def start(self, number: Column) -> Column:
        return F.when(number == 1, F.lit(self.opening)).otherwise(
            F.date_add(F.lit(self.regular), ((number - 2) * self.days).cast("int"))
        )

    def end(self, number: Column) -> Column:
        return F.date_add(F.lit(self.regular), ((number - 1) * self.days - 1).cast("int"))

    def next_open(self, day: Column) -> Column:
        """Period whose lineup can still be set; on a Monday the current one."""
        return self.number(day) + F.when(F.weekday(day) == 0, 0).otherwise(1)

    def pool_target(self, day: Column) -> Column:
        """On a Sunday a pool page already shows the coming period."""
        return self.number(day) + F.when(F.weekday(day) == 6, 1).otherwise(0)

    def table(self, spark: SparkSession) -> DataFrame:
        n = F.col("number")
        return spark.range(1, self.periods + 1).select(
            F.col("id").cast("int").alias("number")
        ).select(
            n, self.start(n).alias("start_date"), self.end(n).alias("end_date"),
            (n == self.periods).alias("is_final"),
        )


# Season of the published figures, 27 weekly periods.
SEASON = Calendar(date(2026, 3, 25), date(2026, 3, 30), 27)


def month_number(day: Column, base_year: int) -> Column:
    """Months since January of ``base_year``, counted from one."""
    return ((F.year(day) - base_year) * 12 + F.month(day)).cast("int")


def two_digit_year(day: Column) -> Column:
    """Two-digit years 69..99 belong to the last century."""
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def short_date(text: Column) -> Column:
    """``M/d/yy`` → date, null when it does not parse."""
    return two_digit_year(F.try_to_timestamp(text, F.lit("M/d/yy")).cast("date"))


def posted_at(text: Column) -> Column:
    """``M/d/yy h:mm AM`` in league time → timestamp."""
    stamp = F.try_to_timestamp(text, F.lit("M/d/yy h:mm a"))
    return F.when(F.year(stamp) >= 2069, stamp - F.expr("INTERVAL 100 YEARS")).otherwise(stamp)


def captured_at(header: Column, offset_hours: int = 1) -> Column:
    """``captured: 2026-08-02 ~11:35`` local stamp moved to league time."""
    pattern = r"captured: (\d{4}-\d{2}-\d{2})[T ~]+(\d{1,2}:\d{2})"
    text = F.concat_ws(" ", F.regexp_extract(header, pattern, 1), F.regexp_extract(header, pattern, 2))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:mm")) + F.expr(f"INTERVAL {offset_hours} HOURS")
