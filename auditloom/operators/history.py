"""Commits and branches: what a history shows.

Commits have `repo`, `author`, `files_changed`, `insertions`, `deletions` and what else a caller keeps. Null counts are
taken as 0, null authors are an author of their own. `now` is a parameter, so results do not move with the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import strip

# Limits of large commits, of undescribed ones, the age of abandoned branches, and main lines.
MANY_FILES, MANY_LINES, FEW_FILES, OLD_DAYS = 30, 1000, 5, 90
MAIN = ("main", "master", "develop")
INSPECTED, COUNTED, TOP = 200, 500, 10


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def is_large() -> Column:
    """More than 30 files, or more than 1000 lines in and out."""
    return (_n("files_changed") > MANY_FILES) | (_n("insertions") + _n("deletions") > MANY_LINES)


def is_undescribed(message: Column) -> Column:
    """No text in the second line of the message, with more than 5 files."""
    second = F.get(F.split(strip(message), "\n"), F.lit(1))
    return F.coalesce(strip(second) == "", F.lit(True)) & (_n("files_changed") > FEW_FILES)


def described(commits: DataFrame, message: str = "message") -> DataFrame:
    """`commits` with `subject` (its first line, 200 characters), `too_large` and `undescribed`."""
    subject = F.substring(F.split(F.coalesce(F.col(message), F.lit("")), "\n")[0], 1, 200)
    return commits.select("*", subject.alias("subject"), is_large().alias("too_large"), is_undescribed(F.coalesce(F.col(message), F.lit(""))).alias("undescribed"))


def latest(commits: DataFrame, order: list, most: int = INSPECTED) -> DataFrame:
    """The `most` latest commits of each repository, a feature of the reports; `order` has to break ties."""
    return commits.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("nth") <= most).drop("nth")


def top_contributors(commits: DataFrame, most: int = TOP, counted: int | None = None, order: list | None = None) -> DataFrame:
    """(repo, author, commits): the authors with most commits of each repository; ties by name. With `counted` (reports take
    `COUNTED`) only as many latest commits of each repository count, by `order`."""
    considered = commits if counted is None else latest(commits, order, counted)
    counts = considered.groupBy("repo", "author").agg(F.count("*").alias("commits"))
    rank = Window.partitionBy("repo").orderBy(F.desc("commits"), F.asc_nulls_last("author"))
    return counts.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= most).drop("nth")


def abandoned(branches: DataFrame, now: Column, days: int = OLD_DAYS) -> DataFrame:
    """(repo, name, age_days) of branches whose tip is older than `days`, main lines aside. Null tips are not judged."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("tip")) / 86400)
    return branches.where(~F.col("name").isin(*MAIN)).select("repo", "name", age.alias("age_days")).where(F.col("age_days") > days)


def summary(commits: DataFrame) -> DataFrame:
    """(repo, commits, large, undescribed, with_secret) of described commits with `has_secret`."""
    return commits.groupBy("repo").agg(F.count("*").alias("commits"), F.count_if("too_large").alias("large"), F.count_if("undescribed").alias("undescribed"), F.count_if("has_secret").alias("with_secret"))
