"""Files to lines, and what is counted on lines.

A corpus is a DataFrame with `repo`, `path` and `content`; other columns are ignored. Null contents have no lines and count
nothing, empty files have no lines. All operators here but the totals are narrow; totals are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import line_array, strip

# How lines start that are no code, and lines that do not count as duplicated.
NO_CODE = ("#", "//", "*")
NO_DUPLICATE = ("#", "//", "*", "/*", "import", "from")


def _starts(c: Column, prefixes) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | c.startswith(p)
    return found


def lines(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, line), line numbers from 1; the lines of repeated files once."""
    each = files.select("repo", "path", F.posexplode(line_array(F.col("content"))).alias("at", "line"))
    return each.dropDuplicates(["repo", "path", "at"]).select("repo", "path", (F.col("at") + 1).alias("line_no"), "line")


def is_code(line: Column) -> Column:
    bare = strip(line)
    return (bare != "") & ~_starts(bare, NO_CODE)


def code_lines(content: Column) -> Column:
    """The number of lines of code of a text, without a row per line."""
    return F.size(F.filter(line_array(content), is_code))


def loc_per_file(files: DataFrame) -> DataFrame:
    """(repo, path, loc) of each file once; a null content has 0."""
    return files.select("repo", "path", F.coalesce(code_lines(F.col("content")), F.lit(0)).alias("loc")).distinct()


def project_loc(files: DataFrame) -> DataFrame:
    """(repo, total_files, total_loc)."""
    return loc_per_file(files).groupBy("repo").agg(F.count("*").alias("total_files"), F.sum("loc").alias("total_loc"))


def first_files(files: DataFrame, most: int) -> DataFrame:
    """The first `most` files of each repository by path; a feature of several reports, not a guard.

    The paths alone are ranked; the texts meet them by (repo, path).
    """
    order = Window.partitionBy("repo").orderBy("path")
    first = files.select("repo", "path").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")
    return files.join(first, ["repo", "path"], "left_semi")


def duplication(files: DataFrame, most: int | None = None) -> DataFrame:
    """(repo, lines, duplicated, percent) over the counted lines of all files, or of the first `most`.

    A line counts if it has ten characters or more and is no comment or import. Lines are known by 96 bits of their hashes and
    their length, so that no text is shuffled. Repeated files count once. Equal lines of a file are summed within it and then
    before they meet, so a line that makes up most of a repository costs one row a task.
    """
    sampled = files if most is None else first_files(files, most)
    bare = F.filter(F.transform(line_array(F.col("content")), strip), lambda l: (F.length(l) >= 10) & ~_starts(l, NO_DUPLICATE))
    marks = F.transform(bare, lambda l: F.struct(F.xxhash64(l).alias("h"), F.crc32(l.cast("binary")).alias("c"), F.length(l).alias("n")))
    each = sampled.select("repo", "path", F.posexplode(marks).alias("at", "line")).groupBy("repo", "path", "at").agg(F.first("line").alias("line"))
    once = each.groupBy("repo", "line").agg(F.count("*").alias("n"))
    total = once.groupBy("repo").agg(F.sum("n").alias("lines"), F.sum(F.col("n") - 1).alias("duplicated"))
    return total.withColumn("percent", F.round(F.col("duplicated") * 100 / F.col("lines"), 1))


# Suffixes of files whose size is none of source code.
UNSIZED = ".png .jpg .jpeg .gif .svg .ico .woff .woff2 .ttf .eot .pdf .zip .tar .gz .jar .exe .dll .so .dylib .lock".split()


def large_files(files: DataFrame, least: int = 100_000, most: int | None = 20) -> DataFrame:
    """(repo, path, size_kb) of the files over `least` bytes, the largest `most` of each repository; ties by path. Binary
    files and locks are left out."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    big = files.where((F.col("size") > least) & ~suffix.isin(UNSIZED)).select("repo", "path", "size").distinct()
    if most is not None:
        order = Window.partitionBy("repo").orderBy(F.desc("size"), "path")
        big = big.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return big.select("repo", "path", F.round(F.col("size") / 1024, 1).alias("size_kb"))


# Suffixes of images and videos.
IMAGES = ".png .jpg .jpeg .gif .bmp .webp .tiff".split()
VIDEOS = ".mp4 .avi .mov .wmv .mkv".split()


def heavy_media(files: DataFrame, least: int = 500_000, most: int | None = 20) -> DataFrame:
    """(repo, path, size_kb, kind) of images and videos over `least` bytes, the largest `most` of each repository."""
    ext = F.lower("ext")
    kinds = files.withColumn("kind", F.when(ext.isin(IMAGES), "image").when(ext.isin(VIDEOS), "video")).where("kind is not null")
    big = kinds.where(F.col("size") > least).select("repo", "path", "size", "kind").distinct()
    if most is not None:
        big = big.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("size"), "path"))).where(F.col("nth") <= most)
    return big.select("repo", "path", F.round(F.col("size") / 1024, 1).alias("size_kb"), "kind")
