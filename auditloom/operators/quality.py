"""Metrics of files: complexity, maintainability, unused imports, large functions, debt.

Python is measured on its syntax tree, in one Arrow pass that yields every metric of a file; JavaScript and TypeScript by
JVM expressions. Files that do not parse have complexity 0 and no functions; null contents count as empty. Any other
suffix has complexity 0. Rows are judged each; `repo`, `path`, `ext` and `content` are used, other columns ignored.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.lines import code_lines

# The branching words and function heads of scripts, the limits of large code, and the points of debt.
BRANCH = r"\b(?:if|else\s+if|elif|while|for|case|catch|&&|\|\||\?)\b"
SCRIPTS = (".js", ".ts", ".jsx", ".tsx")
SOURCES = ".py .js .ts .jsx .tsx .java .go .rs .cs .cpp .cc .h .rb .php .swift .kt .dart".split()
FUNCTION = re.compile(r"function\s+(?P<a>\w+)|(?:const|let|var)\s+(?P<b>\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>|(?:async\s+)?function\s*\*?\s*\([^)]*\)")
LARGE_FUNCTION, LARGE_CLASS, LARGE_FILE = 50, 200, 500
MOST_BYTES = 100_000

BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Lambda, ast.comprehension)


def python_metrics(text: str, function: int = LARGE_FUNCTION, class_: int = LARGE_CLASS) -> tuple[float, int, list[dict]]:
    """(complexity, unused imports, large functions and classes) of Python source; (0, 0, []) if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return 0.0, 0, []
    complexity = 1 + sum(isinstance(n, BRANCHES) for n in nodes) + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
    bound = {a.asname or (a.name.split(".")[0] if isinstance(n, ast.Import) else a.name) for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    unused = sum(len(re.findall(rf"\b{re.escape(name)}\b", text)) <= 1 for name in bound)
    large = []
    for n in nodes:
        kind = "class" if isinstance(n, ast.ClassDef) else "function" if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) else None
        if kind and (span := (n.end_lineno or n.lineno) - n.lineno) > (class_ if kind == "class" else function):
            large.append({"kind": kind, "name": n.name, "line": n.lineno, "lines": span})
    return float(complexity), unused, large


def script_functions(text: str, function: int = LARGE_FUNCTION) -> list[dict]:
    """The large functions of a script: from a definition to the line where its braces are closed again."""
    lines = text.splitlines()
    depth = [0]
    for line in lines:
        depth.append(depth[-1] + line.count("{") - line.count("}"))
    large = []
    for m in FUNCTION.finditer(text):
        first = text.count("\n", 0, m.start())
        base = depth[first] if first < len(depth) else 0
        last = next((i for i in range(first + 1, len(lines)) if depth[i + 1] - base <= 0), first)
        if last - first > function:
            large.append({"kind": "function", "name": m["a"] or m["b"] or "anonymous", "line": first + 1, "lines": last - first})
    return large


def script_complexity(text: Column) -> Column:
    """1 and the branching words of a script; only unspaced operators count as words."""
    return (F.regexp_count(text, F.lit(BRANCH)) + 1).cast("double")


def maintainability(loc: Column, complexity: Column) -> Column:
    """0 to 100, one decimal; 100 for no code."""
    raw = F.lit(221) - F.sqrt(complexity) * 5.2 - loc * 0.23 - F.sqrt(loc) * 16.2
    return F.when(loc == 0, F.lit(100.0)).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 1))


def is_source(most_bytes: int | None = MOST_BYTES) -> Column:
    """Whether a file is measured: by suffix and, unless that is None, up to `most_bytes`."""
    kept = F.lower("ext").isin(SOURCES) & F.col("content").isNotNull()
    return kept if most_bytes is None else kept & (F.col("size") < most_bytes)


def file_metrics(files: DataFrame, most_bytes: int | None = MOST_BYTES, function: int = LARGE_FUNCTION, class_: int = LARGE_CLASS) -> DataFrame:
    """(repo, path, loc, complexity, maintainability, unused, large, issues): the metrics of every source file, each once.

    One pass over the texts: lines and branches by JVM expressions, trees in the Arrow pass that follows; only the metrics are
    shuffled to drop repeated files. `most_bytes` (None: all) is the size from which files are not measured, `function` and
    `class_` are the lines over which these are large.
    """
    sources = files.where(is_source(most_bytes))
    text = F.when(F.col("ext").isin(".py", *SCRIPTS), F.col("content"))
    counted = sources.select("repo", "path", "ext", code_lines(F.col("content")).alias("loc"), F.when(F.col("ext").isin(*SCRIPTS), script_complexity(F.col("content"))).alias("script"), text.alias("content"))
    schema = "repo string, path string, loc int, script double, tree double, unused int, large array<struct<kind:string,name:string,line:int,lines:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("lines", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [python_metrics(text or "", function, class_) if ext == ".py" else (None, 0, script_functions(text, function) if text else []) for ext, text in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist())]
            c, u, large = zip(*rows) if rows else ((), (), ())
            kept = [batch.column(n) for n in ("repo", "path", "loc", "script")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(c, pa.float64()), pa.array(u, pa.int32()), pa.array(large, kind)], ["repo", "path", "loc", "script", "tree", "unused", "large"])

    known = counted.mapInArrow(run, schema).dropDuplicates(["repo", "path"])
    complexity = F.coalesce("script", "tree", F.lit(0.0))
    unused = F.coalesce("unused", F.lit(0))
    issues = F.array_compact(F.array(F.when(unused > 0, F.concat(unused.cast("string"), F.lit(" unused import(s)"))), F.when(F.col("loc") > LARGE_FILE, F.concat(F.lit("Large file ("), F.col("loc").cast("string"), F.lit(" lines of code)")))))
    return known.select("repo", "path", "loc", complexity.alias("complexity"), maintainability(F.col("loc"), complexity).alias("maintainability"), unused.alias("unused"), "large", issues.alias("issues"))


def debt_minutes(loc: Column, complexity: Column, issues: Column) -> Column:
    """The minutes of debt of a file, by its complexity, its size and its issues."""
    by_complexity = F.when(complexity > 15, (complexity - 15) * 5).when(complexity > 10, (complexity - 10) * 2).otherwise(0.0)
    return by_complexity + F.when(loc > LARGE_FILE, (loc - LARGE_FILE) * 0.1).otherwise(0.0) + issues * 5


def project_quality(metrics: DataFrame) -> DataFrame:
    """(repo, files, loc, complexity, maintainability, unused, debt_hours); complexity over files that have one."""
    minutes = debt_minutes(F.col("loc"), F.col("complexity"), F.coalesce(F.size("issues"), F.lit(0)))
    return metrics.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.sum("loc").alias("loc"),
        F.round(F.coalesce(F.avg(F.when(F.col("complexity") > 0, F.col("complexity"))), F.lit(0.0)), 2).alias("complexity"),
        F.round(F.coalesce(F.avg("maintainability"), F.lit(0.0)), 2).alias("maintainability"),
        F.sum("unused").alias("unused"),
        F.round(F.sum(minutes) / 60, 1).alias("debt_hours"),
    )


def large_units(metrics: DataFrame) -> DataFrame:
    """(repo, path, kind, name, line, lines) of all large functions and classes."""
    return metrics.select("repo", "path", F.inline("large"))


HEADS = {"function": 20, "class": 20}


def listed_units(metrics: DataFrame, most: dict[str, int] = HEADS) -> DataFrame:
    """(repo, path, kind, name, line, lines): of each kind the first large ones of a repository by path and line, as reports list them."""
    order = Window.partitionBy("repo", "kind").orderBy("path", "line", "name")
    kept = F.lit(False)
    for kind, n in most.items():
        kept = kept | (F.col("kind") == kind) & (F.col("nth") <= n)
    return large_units(metrics).withColumn("nth", F.row_number().over(order)).where(kept).drop("nth")
