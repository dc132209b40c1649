"""Scores and reports: every part is aggregated to one row a repository, joined on it, and scored by column expressions.

`audit` gives the joined row of every repository, `render` turns one collected row into Markdown, `write` puts JSON lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from auditloom.functions.text import line_array
from auditloom.operators import architecture, history, lines, manifests, quality, scan
from auditloom.plans import rules

# The weight of each score, and the ratings of the whole.
WEIGHTS = {"architecture": 0.20, "security": 0.25, "quality": 0.20, "performance": 0.15, "dependencies": 0.10, "documentation": 0.10}
RATINGS = [(90, "EXCELLENT"), (75, "GOOD"), (60, "FAIR"), (40, "POOR"), (-1, "CRITICAL")]


def _bounded(score: Column) -> Column:
    return F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), score)), 1)


def _upto(most: float, amount: Column) -> Column:
    return F.least(F.lit(most), amount)


def _step(value: Column, *steps: tuple[float, float]) -> Column:
    """The worth of the first limit that `value` is over."""
    out = F.lit(0.0)
    for limit, worth in reversed(steps):
        out = F.when(value > limit, worth).otherwise(out)
    return out


def scores(row: DataFrame) -> DataFrame:
    """`row` with a score from 0 to 10 of each part, `overall` from 0 to 100 and its `rating`."""
    c = F.col
    parts = {
        "architecture": 8.0 - _step(c("languages"), (5, 1.5), (3, 0.5)) - F.when((c("total_loc") > 100_000) & (c("layers") == 0), 2.0).otherwise(0.0) + F.when(c("frameworks") > 0, 0.5).otherwise(0.0) - _step(c("complexity"), (15, 1.0)),
        "security": 10.0 - _upto(5, c("secrets") * 1.0) - _upto(2, c("sensitive") * 0.5) - _upto(2, c("certificates") * 0.5) - _upto(3, c("critical") * 1.5) - _upto(2, c("high") * 0.5) - _upto(1, c("medium") * 0.2),
        "quality": 8.0 - _step(c("complexity"), (20, 2.0), (15, 1.0), (10, 0.5)) - _step(c("duplication"), (20, 2.0), (10, 1.0)) - _step(c("large_functions"), (10, 1.5), (5, 0.5)) + _step(c("maintainability"), (60, 0.5)),
        "performance": 9.0 - _upto(3, c("n_plus_one") * 1.0) - _upto(2, c("blocking") * 0.5) - _upto(2, c("loops") * 0.5) - _upto(1, c("memory") * 0.5) - _step(c("large_files"), (5, 0.5)),
        "dependencies": 9.0 - _upto(4, c("vulnerable") * 2.0) - _upto(2, c("deprecated") * 0.5) - _step(c("outdated") / F.greatest(F.lit(1), c("dependencies")), (0.3, 1.5), (0.1, 0.5)),
        "documentation": 6.0 + F.when(c("has_readme"), 2.0).otherwise(0.0) + F.when(c("has_docs"), 2.0).otherwise(0.0),
    }
    scored = row.select("*", *(_bounded(p).alias(f"score_{n}") for n, p in parts.items()))
    total = sum((c(f"score_{n}") * w for n, w in WEIGHTS.items()), F.lit(0.0)) * 10
    overall = scored.withColumn("overall", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1))
    rating = F.lit(RATINGS[-1][1])
    for least, name in reversed(RATINGS[:-1]):
        rating = F.when(c("overall") >= least, name).otherwise(rating)
    return overall.withColumn("rating", rating)


@dataclass(frozen=True)
class Advice:
    """A rule of the reports: its level, its column or expression, the limit over which it speaks, and its title."""

    level: str
    value: str
    over: float
    title: str


# What is worth saying, by level and limit; {n} is the value.
ADVICE = (
    Advice("critical", "secrets", 0, "{n} secret(s) in the sources"),
    Advice("critical", "with_secret", 0, "{n} commit(s) with secrets"),
    Advice("critical", "sql_injection", 0, "{n} SQL injection(s)"),
    Advice("critical", "vulnerable", 0, "{n} dependencies with known weaknesses"),
    Advice("important", "sensitive", 0, "{n} sensitive file(s)"),
    Advice("important", "high", 0, "{n} findings of high severity"),
    Advice("important", "complexity", 15, "complexity of {n} on average"),
    Advice("important", "duplication", 10, "{n} percent of the lines are duplicated"),
    Advice("important", "n_plus_one", 0, "{n} queries in loops"),
    Advice("important", "certificates", 0, "{n} certificate(s) or key store(s) in the repository"),
    Advice("important", "blocking", 0, "{n} blocking call(s) in coroutines"),
    Advice("important", "deprecated", 0, "{n} deprecated dependencies"),
    Advice("recommendation", "large_functions", 0, "{n} large function(s)"),
    Advice("recommendation", "large_classes", 0, "{n} large class(es)"),
    Advice("recommendation", "unused", 0, "{n} unused import(s)"),
    Advice("recommendation", "outdated", 5, "{n} outdated dependencies"),
    Advice("recommendation", "abandoned", 0, "{n} abandoned branch(es)"),
    Advice("recommendation", "large_commits", 0, "{n} large commit(s)"),
    Advice("recommendation", "slow", 0, "{n} performance findings"),
    Advice("recommendation", "heavy_media", 0, "{n} heavy image(s) or video(s)"),
    Advice("recommendation", "large_files", 5, "{n} large files"),
    Advice("recommendation", "debt_hours", 40, "{n} hours of debt"),
    Advice("recommendation", "languages", 4, "{n} languages"),
    Advice("recommendation", "total_loc", 100_000, "{n} lines of code in one repository"),
)


@dataclass(frozen=True)
class Hint:
    """A rule of the recommendations: its area, its severity (none: a suggestion), when it speaks, and its title."""

    area: str
    severity: str | None
    when: str
    title: str


# When there is something to recommend, and how pressing it is; a word in braces is a column.
HINTS = (
    Hint("architecture", "medium", "project_type = 'monolith' and total_loc > 50000", "{total_loc} lines in one monolith: find its modules"),
    Hint("architecture", None, "languages > 4", "{languages} languages: fewer are easier to build and to know"),
    Hint("architecture", None, "array_contains(framework_names, 'React') and array_contains(framework_names, 'Express')", "React beside Express: keep rules of the business behind the server"),
    Hint("architecture", "high", "not arrays_overlap(framework_names, array('Jest', 'Pytest', 'Mocha', 'Vitest', 'PHPUnit'))", "Tests: no framework for them was found"),
    Hint("security", "critical", "secrets > 0", "Secrets in the code: {secrets} to be revoked"),
    Hint("security", "high", "sensitive > 0", "Files that should not be shared: {sensitive}"),
    Hint("security", "critical", "sql_injection > 0", "Statements from strings: {sql_injection} to be bound"),
    Hint("dependencies", "critical", "vulnerable > 0", "Known weaknesses: {vulnerable} dependencies to be raised"),
    Hint("dependencies", "medium", "outdated > 10", "Versions left open: {outdated} dependencies"),
    Hint("quality", "high", "complexity > 15", "Branches: {complexity} a file on average"),
    Hint("quality", "medium", "duplication > 10", "Repetition: {duplication} percent of the lines"),
    Hint("quality", "medium", "large_functions > 0", "Long functions: {large_functions} to be split"),
    Hint("quality", "medium", "debt_hours > 40", "Debt: {debt_hours} hours"),
    Hint("performance", "high", "n_plus_one > 0", "Queries in loops: {n_plus_one} to be joined"),
    Hint("performance", "medium", "blocking > 0", "Blocking calls in coroutines: {blocking}"),
    Hint("security", "critical", "with_secret > 0", "The history keeps secrets: {with_secret} commits"),
    Hint("quality", "low", "abandoned > 3", "Old branches: {abandoned} to be closed"),
    Hint("quality", "low", "large_commits > 0", "Large commits: {large_commits}"),
    Hint("scalability", None, "total_loc > 100000", "{total_loc} lines: builds and tests need a split"),
    Hint("scalability", None, "complexity > 12", "A complexity of {complexity} slows every change"),
    Hint("scalability", None, "n_plus_one > 0", "Queries in loops grow with the data"),
    Hint("scalability", None, "project_type = 'monolith'", "A monolith scales as a whole only"),
)


def _title(text: str) -> Column:
    """A title with the values of the columns that it names."""
    parts = [F.lit(p) if i % 2 == 0 else F.regexp_replace(F.col(p).cast("string"), r"\.0$", "") for i, p in enumerate(re.split(r"\{(\w+)\}", text))]
    return F.concat(*parts)


def recommendations(row: DataFrame) -> DataFrame:
    """(repo, rank, area, severity, title): what is recommended for each repository, in order; suggestions have no severity."""
    rows = [F.when(F.expr(h.when), F.struct(F.lit(i).alias("rank"), F.lit(h.area).alias("area"), F.lit(h.severity).cast("string").alias("severity"), _title(h.title).alias("title"))) for i, h in enumerate(HINTS)]
    return row.select("repo", F.inline(F.array_compact(F.array(*rows))))


def recommendation_summary(recommended: DataFrame, most: int = 3) -> DataFrame:
    """(repo, critical, recommended, suggested): how many are critical, and the first `most` titles of either kind."""
    titles = lambda test: F.slice(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("rank", "title")))), lambda s: s["title"]), 1, most)
    none = F.col("severity").isNull()
    return recommended.groupBy("repo").agg(F.count_if(F.col("severity") == "critical").alias("critical"), titles(~none).alias("recommended"), titles(none).alias("suggested"))


SAME = 20  # letters of a title that make it the same as another


def priorities(row: DataFrame) -> DataFrame:
    """(repo, rank, level, title): what the limits say about each repository, in order, and then the critical and high
    recommendations whose titles do not begin as one of these does."""
    rows = [F.when(F.col(a.value) > a.over, F.struct(F.lit(i).alias("rank"), F.lit(a.level).alias("level"), _title(a.title.replace("{n}", "{" + a.value + "}")).alias("title"))) for i, a in enumerate(ADVICE)]
    level = {"critical": "critical", "high": "important"}
    more = [F.when(F.expr(h.when), F.struct(F.lit(len(ADVICE) + i).alias("rank"), F.lit(level[h.severity]).alias("level"), _title(h.title).alias("title"))) for i, h in enumerate(HINTS) if h.severity in level]
    own = row.select("repo", F.array_compact(F.array(*rows)).alias("own"), F.array_compact(F.array(*more)).alias("more"))
    new = F.filter("more", lambda m: ~F.exists("own", lambda o: F.lower(F.substring(o["title"], 1, SAME)) == F.lower(F.substring(m["title"], 1, SAME))))
    return own.select("repo", F.inline(F.concat("own", new)))


def _filled(df: DataFrame) -> DataFrame:
    return df.fillna(0).fillna(False)


def _kinds(lines: Column, catalogue: list[rules.Rule]) -> Column:
    """The types found in each line, once a line, of all lines."""
    name = F.create_map(*(F.lit(x) for r in catalogue for x in (r.place, r.kind)))
    return F.flatten(F.transform(lines, lambda l: F.array_distinct(F.transform(scan.hits(l, catalogue), lambda h: name[h]))))


def _of(column: str, *kinds: str) -> Column:
    return F.size(F.filter(column, lambda k: k.isin(*kinds)))


def _measured(files: DataFrame, most: int | None) -> DataFrame:
    """One row a file with all that is counted of it: one pass over the texts, and a shuffle of numbers that drops repeated files."""
    read = lambda scanner: F.when(scan.is_scanned(most, scanner), F.col("lines")).otherwise(F.expr("cast(array() as array<string>)"))
    texts = files.where("content is not null").select("repo", "path", "content", line_array(F.col("content")).alias("lines"))
    kinds = texts.select("repo", "path", _kinds(read("secrets"), rules.SECRET_RULES).alias("s"), _kinds(read("vulnerabilities"), rules.VULNERABILITY_RULES).alias("v"), _kinds(read("performance"), rules.PERFORMANCE_RULES).alias("p"))
    severe = lambda level: _of("v", *(r.kind for r in rules.VULNERABILITY_RULES if r.severity == level)).alias(level)
    counted = kinds.select(
        "repo", "path", F.size("s").alias("secrets"), severe("critical"), severe("high"), severe("medium"), _of("v", "SQL Injection").alias("sql_injection"),
        F.size("p").alias("slow"), _of("p", "N+1 Query").alias("n_plus_one"), _of("p", "Memory Issue").alias("memory"), _of("p", "Blocking I/O").alias("blocking"), _of("p", "Expensive Loop").alias("loops"),
    )
    return counted.dropDuplicates(["repo", "path"])


def audit(files: DataFrame, commits: DataFrame | None = None, branches: DataFrame | None = None, now: Column | None = None, directories: DataFrame | None = None, advisories: DataFrame | None = None, most_characters: int | None = scan.MOST_CHARACTERS, most_bytes: int | None = quality.MOST_BYTES) -> DataFrame:
    """One row a repository: counts of every part, scores, overall and rating. Parts without data count 0.

    `advisories` (name, vulnerable, deprecated: booleans) tells of dependencies what is known of them, by name.

    `most_characters` and `most_bytes` (None: any) are the sizes up to which files are scanned and measured.

    The texts are read by five passes (rules, metrics, duplicated lines, frameworks, kind of project), none of which shuffles
    a text; everything that is joined is one row a repository.
    """
    paths = files.select("repo", "path", "ext", "size").distinct()
    metrics = quality.file_metrics(files, most_bytes)
    count = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    units = lambda kind: F.sum(F.size(F.filter("large", lambda u: u["kind"] == kind)))
    found = _measured(files, most_characters)
    named = architecture.languages(paths).groupBy("repo").agg(F.count("*").alias("languages"), F.min_by("language", F.struct(-F.col("file_count"), "language")).alias("language"))
    parts = [
        named,
        count(architecture.layers(paths, directories), "layers"),
        architecture.frameworks(files).groupBy("repo").agg(F.count("*").alias("frameworks"), F.array_sort(F.collect_set("framework")).alias("framework_names")),  # at most all that are known
        architecture.project_type(files, directories),
        quality.project_quality(metrics).select("repo", "complexity", "maintainability", "unused", "debt_hours", F.col("loc").alias("total_loc")),
        metrics.groupBy("repo").agg(units("function").alias("large_functions"), units("class").alias("large_classes")),
        lines.duplication(files.where(quality.is_source(most_bytes))).select("repo", F.col("percent").alias("duplication")),
        count(lines.large_files(paths), "large_files"),
        count(lines.heavy_media(paths), "heavy_media"),
        count(scan.sensitive_files(paths), "sensitive"),
        count(scan.certificate_files(paths), "certificates"),
        found.groupBy("repo").agg(*(F.sum(n).alias(n) for n in found.columns[2:])),
        manifests.summary(manifests.dependencies(files)).select("repo", F.col("total").alias("dependencies"), "outdated"),
        paths.groupBy("repo").agg(F.max(F.lower("path").rlike(r"^readme(\.\w+)?$")).alias("has_readme"), F.max(F.col("path").startswith("docs/")).alias("has_docs")),
    ]
    if advisories is not None:
        known = manifests.unique(manifests.dependencies(files)).join(advisories.select("name", "vulnerable", "deprecated"), "name")
        parts.append(known.groupBy("repo").agg(F.count_if("vulnerable").alias("vulnerable"), F.count_if("deprecated").alias("deprecated")))
    if commits is not None:
        parts.append(history.summary(commits).select("repo", F.col("large").alias("large_commits"), "with_secret"))
    if branches is not None:
        parts.append(count(history.abandoned(branches, now), "abandoned"))
    row = paths.select("repo").distinct()
    for p in parts:
        row = row.join(p, "repo", "left")
    for name in ("large_commits", "with_secret", "abandoned", "vulnerable", "deprecated"):
        if name not in row.columns:
            row = row.withColumn(name, F.lit(0).cast("long"))
    return scores(_filled(row.withColumn("framework_names", F.coalesce("framework_names", F.expr("cast(array() as array<string>)")))))


def quick_scan(files: DataFrame, most: int | None = scan.MOST_CHARACTERS) -> DataFrame:
    """The secret and vulnerability findings of all files in one table, by `scanner`."""
    of = lambda scanner: scan.scannable(files, most, scanner)
    return scan.secrets(of("secrets")).withColumn("scanner", F.lit("secrets")).unionByName(scan.vulnerabilities(of("vulnerabilities")).withColumn("scanner", F.lit("vulnerabilities")))


def write(row: DataFrame, folder: str) -> None:
    """The audit as JSON lines, in a folder of its own and never among the files that were read."""
    row.write.mode("overwrite").json(folder)


def diagram(layers: list[str], frameworks: list[str]) -> str:
    """A Mermaid graph of the layers in a chain, with the frameworks beside them."""
    out = ["graph TD"]
    out += [f'    L{i}["{name}"]' for i, name in enumerate(layers)]
    out += [f"    L{i} --> L{i + 1}" for i in range(len(layers) - 1)]
    if frameworks:
        out += ["    subgraph Frameworks", *(f'        F{i}["{name}"]' for i, name in enumerate(frameworks)), "    end"]
    return "\n".join(out)


SHOWN = 20  # findings of a scanner that the Markdown report lists


def render(row: Row, advice: list[Row], layers: list[str] = (), frameworks: list[str] = (), findings: dict[str, list[Row]] | None = None) -> str:
    """The report of one repository as Markdown: score, parts, what to do, the first findings of each scanner, diagram."""
    bar = lambda s: "█" * int(s) + "░" * (10 - int(s))
    out = [f"# {row.repo}", "", f"**{row.overall} of 100** ({row.rating}), {row.project_type}, mainly {row.language}", "", "| Part | Score | |", "|-|-|-|"]
    out += [f"| {n} | {row[f'score_{n}']} | {bar(row[f'score_{n}'])} |" for n in WEIGHTS]
    for level in ("critical", "important", "recommendation"):
        said = [a.title for a in sorted(advice, key=lambda a: a["rank"]) if a.level == level]
        out += ["", f"## {level.capitalize()}", "", *(f"- {t}" for t in said)] if said else []
    for scanner, found in (findings or {}).items():
        listed = [f"- {f.severity}: {f.rule_type}, `{f.path}` line {f.line_no}" for f in found[:SHOWN]]
        out += ["", f"## {scanner.capitalize()}", "", *listed, *([f"- and {len(found) - SHOWN} more"] if len(found) > SHOWN else [])] if found else []
    return "\n".join([*out, "", "```mermaid", diagram(list(layers), list(frameworks)), "```", ""])


def summaries(row: Row) -> dict[str, str]:
    """One sentence on each part of an audited repository."""
    return {
        "architecture": f"{row.languages} language(s), mainly {row.language}; {row.frameworks} framework(s); a {row.project_type} in {row.layers} top-level directories.",
        "security": f"{row.secrets} secret(s), {row.sensitive} sensitive file(s), {row.certificates} certificate(s); {row.critical} critical, {row.high} high and {row.medium} medium findings.",
        "quality": f"{row.total_loc} lines of code; complexity {row.complexity}, maintainability {row.maintainability}, {row.duplication} percent duplicated; {row.large_functions} large function(s), {row.unused} unused import(s), {row.debt_hours} hours of debt.",
        "performance": f"{row.slow} finding(s), {row.n_plus_one} of them queries in loops; {row.large_files} large file(s).",
        "dependencies": f"{row.dependencies} dependencies, {row.outdated} unpinned.",
        "history": f"{row.large_commits} large commit(s), {row.with_secret} with secrets, {row.abandoned} abandoned branch(es).",
    }


# How a project of each manager is set up.
SETUP = {"npm": "npm install", "pip": "pip install -r requirements.txt", "pipenv": "pipenv install", "pyproject": "pip install .", "cargo": "cargo build", "maven": "mvn install", "gradle": "gradle build", "go": "go mod download", "bundler": "bundle install", "composer": "composer install", "pub": "dart pub get", "nuget": "dotnet restore"}


def readme(row: Row, layers: list[str], frameworks: list[str], managers: list[str]) -> str:
    """A first README of a repository: what it is, how it is set up, how it is laid out."""
    out = [f"# {row.repo}", "", f"A {row.project_type} in {row.language}" + (f" with {', '.join(frameworks)}." if frameworks else "."), "", "## Setup", "", "```", *(SETUP[m] for m in managers if m in SETUP), "```", "", "## Layout", "", *(f"- {x}" for x in layers), "", "## Size", "", f"{row.total_loc} lines of code, {row.dependencies} dependencies."]
    return "\n".join(out) + "\n"


def guide(row: Row, layers: list[str], managers: list[str]) -> str:
    """What someone new to a repository does first."""
    steps = ["Clone the repository.", *(f"Run `{SETUP[m]}`." for m in managers if m in SETUP), *(f"Read {x}." for x in layers[:3]), "Ask for credentials; none belong in the sources." if row.secrets or row.sensitive else "Run the tests."]
    return "\n".join(["# First steps", "", *(f"{i}. {s}" for i, s in enumerate(steps, 1))]) + "\n"
