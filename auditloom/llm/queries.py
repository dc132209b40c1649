"""The registered queries of this subpackage. Each takes (spark, directory of tables) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import leakage, names, origin, residue, secrets, syntax, tokenize
from auditloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark, d):
    return tokenize.encode(table(spark, d, "documents").select("doc_id", "text"))


@query
def p1_found(spark, d):
    return syntax.broken_files(table(spark, d, "source_files")).select("repo", "file_path")


@query
def p1_errors(spark, d):
    return syntax.broken_files(table(spark, d, "source_files"))


@query
def p1_rates(spark, d):
    return syntax.rates(table(spark, d, "source_files"), table(spark, d, "file_metrics"))


def _secrets(spark, d):
    return secrets.find(secrets.snippets(table(spark, d, "secret_findings"), table(spark, d, "vulnerability_findings")), "snippet")


@query
def p2_found(spark, d):
    return _secrets(spark, d).where("size(secrets) > 0").select("table_name", "finding_id").distinct()


@query
def p2_redacted(spark, d):
    """The same code with every credential hidden, one row per finding and text."""
    return _secrets(spark, d).select("table_name", "finding_id", "redacted").distinct()


@query
def p3_found(spark, d):
    return names.same(names.entities(table(spark, d, "commits"), "author"))


@query
def p3_entities(spark, d):
    return names.entities(table(spark, d, "commits"), "author").select("spelling", "entity")


@query
def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


@query
def p7_held(spark, d):
    """How many words of an item each leaking document holds."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def p8_found(spark, d):
    return residue.score(table(spark, d, "documents")).where("residue").select("doc_id").distinct()


@query
def p8_scores(spark, d):
    """Of every document the log-odds of its likeliest passage and the decision."""
    return residue.score(table(spark, d, "documents"))


def _findings(spark, d):
    return [table(spark, d, t) for t in ("secret_findings", "vulnerability_findings", "performance_findings")]


@query
def p5_found(spark, d):
    other = origin.origins(table(spark, d, "source_files")).where("origin is not null")
    return origin.led_to(other.select("repo", "file_path"), *_findings(spark, d))


@query
def p5_origins(spark, d):
    """Of every file with content, where it comes from; null for code written by hand."""
    return origin.origins(table(spark, d, "source_files"))
