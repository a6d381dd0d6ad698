"""Weekly class series: expansion to dates, week parity, academic weeks, exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semester_start(valid_from: str | Column) -> Column:
    """1 September (Monday after, if it is a Sunday) for series from September to January, else the series' own first day."""
    day = F.col(valid_from) if isinstance(valid_from, str) else valid_from
    year = F.year(day) - F.when(F.month(day) == 1, 1).otherwise(0)
    first = F.make_date(year, F.lit(9), F.lit(1))
    autumn = (F.month(day) >= 9) | (F.month(day) == 1)
    return F.when(autumn, F.date_add(first, F.when(F.weekday(first) == 6, 1).otherwise(0))).otherwise(day)


def academic_week(valid_from: str | Column, day: str | Column) -> Column:
    """Weeks from the Monday of the semester's first week, counted from 1."""
    start = semester_start(valid_from)
    monday = F.date_sub(start, F.weekday(start))
    return F.floor(F.datediff(F.col(day) if isinstance(day, str) else day, monday) / 7).cast("int") + 1


def matches_week(pattern: str, week: str | Column) -> Column:
    week = F.col(week) if isinstance(week, str) else week
    return (F.col(pattern) == "every") | ((F.col(pattern) == "odd") & (week % 2 == 1)) | ((F.col(pattern) == "even") & (week % 2 == 0))


def expanded(series: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each week of each series within [first, last], whatever its parity.

    Series that don't touch the range are dropped, and ranges are intersected, before rows are made.
    """
    lo, hi = F.greatest("valid_from", F.lit(first).cast("date")), F.least("valid_until", F.lit(last).cast("date"))
    start = F.date_add("lo", F.pmod(F.col("weekday") - F.weekday("lo"), F.lit(7)).cast("int"))
    pruned = series.filter((F.col("valid_from") <= F.lit(last).cast("date")) & (F.col("valid_until") >= F.lit(first).cast("date")))
    pruned = pruned.withColumns({"lo": lo, "hi": hi}).withColumn("first_day", start).filter("first_day <= hi")
    days = F.explode(F.sequence("first_day", "hi", F.expr("interval 7 days")))
    return pruned.withColumn("occurrence_date", days).drop("lo", "hi", "first_day")


def occurrences(series: DataFrame, exceptions: DataFrame, first: str, last: str) -> DataFrame:
    """Occurrences of the right parity without those that are excepted, with their instants and references."""
    rows = expanded(series, first, last)
    rows = rows.filter(matches_week("week_pattern", academic_week("valid_from", "occurrence_date")))
    rows = rows.join(exceptions.select("series_id", "occurrence_date"), ["series_id", "occurrence_date"], "left_anti")
    at = lambda c: F.col("occurrence_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col(c))
    return rows.withColumns({"start_at": at("start_min"), "end_at": at("end_min"), "ref": F.concat_ws(":", F.lit("s"), F.col("series_id").cast("string"), F.col("occurrence_date").cast("string"))})


def skips_of_marks(series: DataFrame, first: str, last: str) -> DataFrame:
    """Dates that fall out by week marks: weeks (only these) and except_weeks (not these)."""
    rows = expanded(series, first, last).withColumn("week", academic_week("valid_from", "occurrence_date"))
    only = F.coalesce(F.size("weeks") > 0, F.lit(False)) & ~F.array_contains("weeks", F.col("week"))
    out = F.coalesce(F.array_contains("except_weeks", F.col("week")), F.lit(False))
    return rows.filter(matches_week("week_pattern", "week") & (only | out)).select("series_id", "occurrence_date")


def skipped_once(exceptions: DataFrame, skips: DataFrame) -> DataFrame:
    """Exceptions with further skips; a date that is skipped already stays as it is."""
    new = skips.select("series_id", "occurrence_date").distinct().join(exceptions, ["series_id", "occurrence_date"], "left_anti")
    return exceptions.select("series_id", "occurrence_date", "status").unionByName(new.withColumn("status", F.lit("skipped")))


def rolled(day: str, today: str | Column) -> Column:
    """A past weekday that was named goes to the next week."""
    return F.when(F.col(day) < today, F.date_add(day, 7)).otherwise(F.col(day))


def rule_days(events: DataFrame, horizon: str) -> DataFrame:
    """uid and day of every recurrence up to the horizon (exclusive), and rows with broken set for rules beyond the subset.

    ``events`` has uid, first_day, freq (DAILY, WEEKLY, MONTHLY, YEARLY), interval_n, count_n, until_day and
    by_days (array of weekdays, Monday = 0; WEEKLY only). Days of a month that lacks them are left out.
    """
    last = F.least(F.coalesce("until_day", F.lit(horizon).cast("date")), F.date_sub(F.lit(horizon).cast("date"), 1))
    known = F.col("freq").isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY")
    e = events.withColumns({"last": last, "step": F.coalesce("interval_n", F.lit(1)), "broken": ~F.coalesce(known, F.lit(False))})
    n = F.greatest(F.datediff("last", "first_day"), F.lit(-1))
    months = F.col("step") * F.when(F.col("freq") == "YEARLY", 12).otherwise(1)
    steps = F.least(F.floor(n / F.col("step")), F.greatest(F.col("count_n") - 1, F.lit(0))).cast("int")  # least() passes over nulls
    daily = F.transform(F.sequence(F.lit(0), steps), lambda i: F.date_add("first_day", i * F.col("step")))
    monday = F.date_sub("first_day", F.weekday("first_day"))
    weekly = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n + 6) / (7 * F.col("step"))).cast("int")), lambda i: F.transform(F.array_sort(F.coalesce("by_days", F.array(F.weekday("first_day")))), lambda d: F.date_add(monday, (i * 7 * F.col("step") + d).cast("int")))))
    monthly = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.months_between("last", "first_day"), F.lit(-1)) / months).cast("int")), lambda i: F.add_months("first_day", (i * months).cast("int"))), lambda d: F.dayofmonth(d) == F.dayofmonth("first_day"))
    days = F.when(n < 0, F.array().cast("array<date>")).when(F.col("freq") == "DAILY", daily).when(F.col("freq") == "WEEKLY", weekly).otherwise(monthly)
    kept = F.filter(days, lambda d: (d >= F.col("first_day")) & (d <= F.col("last")))
    limited = F.when(F.col("count_n").isNotNull(), F.slice(kept, F.lit(1), F.col("count_n"))).otherwise(kept)
    out = e.withColumn("days", F.when(F.col("broken"), F.array(F.lit(None).cast("date"))).otherwise(limited))
    return out.select("uid", "broken", F.explode("days").alias("day"))


def days_between(first_day: Column, rule: Column, first: Column, last: Column) -> Column:
    """The days of a rule (freq, interval_n, count_n, until_day, by_days) from ``first`` to ``last``, both included, as an array.

    Counting starts where the window does, however long ago the rule began: which steps fall into it, and the numbers that
    they have among all of the rule's, follow by division. Only a COUNT over days that some months lack is counted out.
    """
    step = F.coalesce(rule["interval_n"], F.lit(1))
    end = F.least(last, F.coalesce(rule["until_day"], last))
    below = lambda number: rule["count_n"].isNull() | (number < rule["count_n"])
    since = lambda day, per: F.floor(F.datediff(day, first_day) / per).cast("int")
    steps = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi), F.lit(1))).otherwise(F.array().cast("array<int>"))
    none, inside = F.array().cast("array<date>"), lambda d: (d >= first) & (d <= end) & (d >= first_day)
    # days
    daily = F.filter(steps(F.greatest(since(F.date_sub(first, 1), step) + 1, F.lit(0)), since(end, step)), below)
    daily = F.transform(daily, lambda i: F.date_add(first_day, i * step))
    # weeks, counted from the Monday of the first; the first may lack some of its days
    monday, own = F.date_sub(first_day, F.weekday(first_day)), F.array_sort(F.array_distinct(F.coalesce(rule["by_days"], F.array(F.weekday(first_day)))))
    week = lambda day: F.floor(F.datediff(day, monday) / (step * 7)).cast("int")
    missing = F.size(F.filter(own, lambda d: d < F.weekday(first_day)))
    dated = lambda w: F.transform(own, lambda d, j: F.struct(F.date_add(monday, (w * 7 * step + d).cast("int")).alias("day"), (w * F.size(own) + j - missing).alias("number")))
    weekly = F.flatten(F.transform(steps(F.greatest(week(first), F.lit(0)), week(end)), dated))
    weekly = F.transform(F.filter(weekly, lambda d: inside(d["day"]) & below(d["number"])), lambda d: d["day"])
    # months and years: a day that a month lacks is left out, and not counted
    months = step * F.when(rule["freq"] == "YEARLY", 12).otherwise(1)
    month = lambda day: F.floor(((F.year(day) - F.year(first_day)) * 12 + F.month(day) - F.month(first_day)) / months).cast("int")
    counted = rule["count_n"].isNotNull()
    monthly = F.transform(steps(F.when(counted, 0).otherwise(F.greatest(month(first), F.lit(0))), month(end)), lambda i: F.add_months(first_day, (i * months).cast("int")))
    monthly = F.filter(monthly, lambda d: F.dayofmonth(d) == F.dayofmonth(first_day))
    monthly = F.when(counted, F.slice(monthly, F.lit(1), F.coalesce(rule["count_n"], F.lit(0)))).otherwise(monthly)
    freq = rule["freq"]
    days = F.when(freq == "DAILY", daily).when(freq == "WEEKLY", weekly).when(freq.isin("MONTHLY", "YEARLY"), F.filter(monthly, inside))
    return F.when((end < first) | (end < first_day), none).otherwise(days)
