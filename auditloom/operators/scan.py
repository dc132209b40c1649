"""Rules over lines: findings with their surroundings, sensitive names, secrets in changes.

The rules are literal regexes in one projection, so every regex compiles once a task and a line that matches nothing makes
no row. Only files with a finding are shuffled for the lines around it. Null contents and empty files have no findings; a
rule finds a line once, however often it matches; repeated files give their findings once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import line_array, matches_any
from auditloom.plans import rules as R

MOST_CHARACTERS = 500_000  # longer files are no source; an option of every scan
# Suffixes that are not scanned.
BINARY = ".png .jpg .jpeg .gif .svg .ico .woff .woff2 .ttf .eot .pdf .zip .tar .gz .jar .exe .dll .so .dylib".split()
# What each scanner leaves out: suffixes, and names of minified files.
SKIPPED = {"secrets": (BINARY, None), "vulnerabilities": (BINARY, r"\.min\.[^/]*$"), "performance": ([*BINARY, ".lock"], r"\.min\.js$")}


def suffix() -> Column:
    return F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))


def is_scanned(most: int | None = MOST_CHARACTERS, scanner: str | None = None) -> Column:
    """Whether a scan reads a file: by the suffixes and names that the scanner (none: every one) leaves out, up to `most`
    characters (None: any length)."""
    left_out = [SKIPPED[scanner]] if scanner else SKIPPED.values()
    kept = F.col("content").isNotNull()
    for skipped, minified in left_out:
        kept = kept & ~suffix().isin(list(skipped))
        kept = kept & ~F.col("path").rlike(minified) if minified else kept
    return kept if most is None else kept & (F.length("content") <= most)


def scannable(files: DataFrame, most: int | None = MOST_CHARACTERS, scanner: str | None = None) -> DataFrame:
    """The files that a scan reads."""
    return files.where(is_scanned(most, scanner))


def hits(line: Column, catalogue: list[R.Rule]) -> Column:
    """The places of the rules that find something in a line."""
    return F.array_compact(F.array(*(F.when(matches_any(line, r.patterns), F.lit(r.place)) for r in catalogue)))


def scan(files: DataFrame, catalogue: list[R.Rule]) -> DataFrame:
    """(repo, path, line_no, rule, rule_type, severity, cwe, context): one row a file, line and type.

    `context` is the line before, the line and the line after. It is cut from the file's own lines where they are at hand,
    so the scan is narrow but for dropping the findings of repeated files.
    """
    table = {r.place: r for r in catalogue}
    rows = files.select("repo", "path", line_array(F.col("content")).alias("lines"))
    found = rows.select("repo", "path", "lines", F.posexplode(F.transform("lines", lambda l: hits(l, catalogue))).alias("at", "hits")).where(F.size("hits") > 0)
    context = F.array_join(F.slice("lines", F.greatest(F.col("at"), F.lit(1)), F.when(F.col("at") == 0, 2).otherwise(3)), "\n")
    each = found.select("repo", "path", (F.col("at") + 1).alias("line_no"), context.alias("context"), F.explode("hits").alias("rule"))
    of = lambda get: F.element_at(F.create_map(*(F.lit(x) for r in table.values() for x in (r.place, get(r)))), F.col("rule"))
    typed = each.select("repo", "path", "line_no", "rule", of(lambda r: r.kind).alias("rule_type"), of(lambda r: r.severity).alias("severity"), of(lambda r: r.cwe).alias("cwe"), "context")
    first = typed.groupBy("repo", "path", "line_no", "rule_type").agg(F.min_by(F.struct("rule", "severity", "cwe", "context"), "rule").alias("f"))
    return first.select("repo", "path", "line_no", "f.rule", "rule_type", "f.severity", "f.cwe", "f.context")


def secrets(files: DataFrame) -> DataFrame:
    return scan(files, R.SECRET_RULES)


def vulnerabilities(files: DataFrame) -> DataFrame:
    return scan(files, R.VULNERABILITY_RULES)


def performance(files: DataFrame) -> DataFrame:
    """By the rules that can match a single line, as the audited rules do."""
    return scan(files, R.PERFORMANCE_RULES)


def performance_wide(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, rule_type, severity): all rules over whole texts, at each line where a match begins.

    The matches of a regex follow each other without overlap. Dots do not cross lines; an invalid regex of the catalogue is
    left out, as in the line scan.
    """
    live = [replace(r, patterns=tuple(p for p in r.patterns if R._compiles(p))) for r in R.WIDE_PERFORMANCE_RULES]
    text = F.translate(F.regexp_replace("content", r"\r\n?", "\n"), MARK, "\ufffe")
    starts = [F.when(F.col("text").rlike(p), F.transform(_lines_of(F.col("text"), p), _struct(r))).otherwise(F.expr(f"cast(array() as array<{FOUND}>)")) for r in live for p in r.patterns]
    rows = files.where("content is not null").select("repo", "path", text.alias("text"))
    each = rows.select("repo", "path", F.explode(F.flatten(F.array(*starts))).alias("m"))
    return each.select("repo", "path", "m.line_no", "m.rule_type", "m.severity").distinct()


MARK = "\uffff"  # no character; stands before each match
FOUND = "struct<line_no: int, rule_type: string, severity: string>"


def _lines_of(text: Column, pattern: str) -> Column:
    """The numbers of the lines in which a match begins."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "$0")), "\n")
    return F.array_compact(F.transform(marked, lambda line, i: F.when(line.contains(MARK), i + 1)))


def _struct(rule: R.Rule):
    def made(i: Column) -> Column:
        return F.struct(i.alias("line_no"), F.lit(rule.kind).alias("rule_type"), F.lit(rule.severity).alias("severity"))

    return made


def with_advice(findings: DataFrame, catalogue: list[R.Rule]) -> DataFrame:
    """The findings of a catalogue with what their rule means and what to do; by the rule's place, as types may repeat."""
    of = lambda get: F.element_at(F.create_map(*(F.lit(x) for r in catalogue for x in (r.place, get(r)))), F.col("rule"))
    return findings.select("*", of(lambda r: r.meaning).alias("description"), of(lambda r: r.advice).alias("recommendation"))


def by_severity(findings: DataFrame) -> DataFrame:
    """(repo, critical, high, medium, low, total)."""
    severities = R.SEVERITIES[:4]
    return findings.groupBy("repo").agg(*(F.count_if(F.lower("severity") == s).alias(s) for s in severities), F.count("*").alias("total"))


def by_type(findings: DataFrame) -> DataFrame:
    """(rule_type, findings), most frequent first."""
    return findings.groupBy("rule_type").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "rule_type")


def sensitive_files(files: DataFrame) -> DataFrame:
    """(repo, path) of files whose name alone is sensitive; examples and templates of settings are not."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where(matches_any(name, R.SENSITIVE_PATTERNS)).select("repo", "path").distinct()


def certificate_files(files: DataFrame) -> DataFrame:
    """(repo, path) of certificates and key stores, by suffix."""
    return files.where(suffix().isin(R.CERTIFICATES)).select("repo", "path").distinct()


def credential_paths(findings: DataFrame) -> DataFrame:
    """(repo, paths): the paths of findings whose type speaks of keys or passwords, repeated as found, in order."""
    kept = findings.where(F.lower("rule_type").rlike("key|password"))
    return kept.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "line_no", "rule"))), lambda s: s["path"]).alias("paths"))


def history_secrets(changes: DataFrame, text: str) -> DataFrame:
    """`changes` with `has_secret`: whether the text of the change holds one; null texts do not."""
    return changes.withColumn("has_secret", F.coalesce(matches_any(F.col(text), R.HISTORY_PATTERNS), F.lit(False)))
