"""The registered queries of the core. Each takes (spark, directory of tables) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import architecture, history, lines, manifests, nested, quality, scan
from auditloom.plans import report
from auditloom.plans import rules as R
from auditloom.plans import sql as S
from auditloom.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "secret_scan"


def query(sql: str | None = None):
    """Register the function as a query, with its SQL counterpart where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def code(spark: SparkSession, d: str) -> DataFrame:
    """The source files as delivered; operators drop repeated rows after their pass over the texts, so that no text is shuffled."""
    return spread(table(spark, d, "source_files").select("repo", F.col("file_path").alias("path"), "name", "ext", "size", "content"))


def _snippets(df: DataFrame, column: str) -> DataFrame:
    return df.select("repo", F.concat("file_path", F.lit("#"), F.col("finding_id").cast("string")).alias("path"), F.col(column).alias("content"))


def contexts(spark, d):
    return _snippets(table(spark, d, "secret_findings"), "context")


def snippets(spark, d):
    return _snippets(table(spark, d, "vulnerability_findings"), "code_snippet")


def paths(spark, d):
    parts = [table(spark, d, t).select("repo", F.col("file_path").alias("path")) for t in ("secret_findings", "vulnerability_findings", "performance_findings")]
    certificates = table(spark, d, "repos").where("project_type = 'cli'").select("repo", F.lit("certs/server.pem").alias("path"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(certificates).distinct()


def commits(spark, d):
    return table(spark, d, "commits").select("commit_id", "repo", "message", "author", "commit_date", "files_changed", "insertions", "deletions").distinct()


def manifest_files(spark, d):
    """Manifests written from the repositories' rows, as no table holds any."""
    table(spark, d, "repos").createOrReplaceTempView("auditloom_repos")
    return spark.sql(S.MANIFESTS.replace("from repos", "from auditloom_repos"))


@query(S.findings(S.CONTEXTS, R.SECRET_RULES))
def secret_scan(spark, d):
    return scan.secrets(contexts(spark, d))


@query(f"with f as ({S.findings(S.CONTEXTS, R.SECRET_RULES)}) select repo, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low, count(*) as total from f group by repo")
def secrets_by_severity(spark, d):
    return scan.by_severity(scan.secrets(contexts(spark, d)))


@query(S.findings(S.SNIPPETS, R.VULNERABILITY_RULES))
def vulnerability_scan(spark, d):
    return scan.vulnerabilities(snippets(spark, d))


@query(f"with f as ({S.findings(S.SNIPPETS, R.VULNERABILITY_RULES)}) select rule_type, count(*) as findings from f group by rule_type order by 2 desc, 1")
def vulnerabilities_by_type(spark, d):
    return scan.by_type(scan.vulnerabilities(snippets(spark, d)))


@query(S.findings(S.SLOW, R.PERFORMANCE_RULES))
def performance_scan(spark, d):
    rows = table(spark, d, "vulnerability_findings").select("repo", "finding_id", "file_path", F.expr(S.SEEDED).alias("seeded"))
    return scan.performance(_snippets(rows, "seeded"))


@query()
def performance_scan_wide(spark, d):
    return scan.performance_wide(code(spark, d))


@query(S.advised())
def findings_with_advice(spark, d):
    """The findings of all three scanners with what they mean and what to do."""
    slow = table(spark, d, "vulnerability_findings").select("repo", "finding_id", "file_path", F.expr(S.SEEDED).alias("seeded"))
    parts = [
        scan.with_advice(scan.secrets(contexts(spark, d)), R.SECRET_RULES),
        scan.with_advice(scan.vulnerabilities(snippets(spark, d)), R.VULNERABILITY_RULES),
        scan.with_advice(scan.performance(_snippets(slow, "seeded")), R.PERFORMANCE_RULES),
    ]
    return reduce(DataFrame.unionByName, parts).select("repo", "path", "line_no", "rule_type", "description", "recommendation")


@query(f"with f as ({S.findings(S.CONTEXTS, R.SECRET_RULES)}) select repo, list(path order by path, line_no, rule) as paths from f where regexp_matches(lower(rule_type), 'key|password') group by repo")
def credential_paths(spark, d):
    return scan.credential_paths(scan.secrets(contexts(spark, d)))


_NAMES = [p.replace(r"\.env\.(?!example$|sample$|template$)\w+$", r"\.env\.\w+$") for p in R.SENSITIVE_PATTERNS]


@query(f"with {S.PATHS}, named as (select *, regexp_extract(path, '([^/]*)$', 1) as n from code) select distinct repo, path from named where " + " or ".join(f"({S.matches('n', p)}" + (r" and not regexp_matches(n, '(?i)\.env\.(example|sample|template)$'))" if p.endswith(r"\w+$") else ")") for p in _NAMES))
def sensitive_files(spark, d):
    return scan.sensitive_files(paths(spark, d))


@query(f"with {S.PATHS} select distinct repo, path from code where lower(regexp_extract(path, '(\\.[^./]*)$', 1)) in ({', '.join(map(S.text, R.CERTIFICATES))})")
def certificate_files(spark, d):
    return scan.certificate_files(paths(spark, d))


@query(f"with {S.CONTEXTS} select repo, path, coalesce({S.any_match('content', R.HISTORY_PATTERNS)}, false) as has_secret from code")
def history_secrets(spark, d):
    return scan.history_secrets(contexts(spark, d), "content").select("repo", "path", "has_secret").distinct()


@query(f"with {S.CODE}, {S.LINES} select repo, path, line_no, line from lines")
def file_lines(spark, d):
    return lines.lines(code(spark, d))


@query(S.LOC + " select repo, path, loc from loc_per_file")
def loc_per_file(spark, d):
    return lines.loc_per_file(code(spark, d))


@query(S.LOC + " select repo, count(*) as total_files, cast(sum(loc) as bigint) as total_loc from loc_per_file group by repo")
def project_loc(spark, d):
    return lines.project_loc(code(spark, d))


@query(S.DUPLICATION)
def duplication(spark, d):
    return lines.duplication(code(spark, d))


@query(f"with {S.CODE} select repo, path, round(size / 1024, 1) as size_kb from (select *, row_number() over (partition by repo order by size desc, path) as nth from code where size > 3000) where nth <= 20")
def large_files(spark, d):
    return lines.large_files(code(spark, d), least=3000)


@query(f"with {S.CODE} select repo, path, round(size / 1024, 1) as size_kb, case when lower(ext) in ('.ts') then 'video' else 'image' end as kind from code where size > 3000 and lower(ext) in ('.js', '.ts')")
def heavy_media(spark, d):
    """Images and videos by size; suffixes stand in for those of media, as no table holds any."""
    stood_in = F.when(F.lower("ext") == ".js", ".png").when(F.lower("ext") == ".ts", ".mp4")
    return lines.heavy_media(code(spark, d).withColumn("ext", stood_in), least=3000, most=None)


@query(S.LANGUAGES + " select repo, language, file_count, round(file_count * 100 / sum(file_count) over (partition by repo), 1) as percentage from counted")
def languages(spark, d):
    return architecture.languages(code(spark, d))


@query(S.LANGUAGES + " select repo, language from (select *, row_number() over (partition by repo order by file_count desc, language) as nth from counted) where nth = 1")
def primary_language(spark, d):
    return architecture.primary_language(code(spark, d))


@query(f"with {S.CODE}, dirs as (select distinct repo, split_part(path, '/', 1) as directory from code where contains(path, '/')) select repo, directory, {S.LAYER} as layer from dirs where not starts_with(directory, '.') and directory not in ('node_modules', '__pycache__', 'venv')")
def layers(spark, d):
    return architecture.layers(code(spark, d))


@query(f"with {S.CODE}, dirs as (select distinct repo, split_part(path, '/', 1) as directory from code where contains(path, '/')), has as (select repo, list(distinct {S.LAYER}) as a from dirs where not starts_with(directory, '.') and directory not in ('node_modules', '__pycache__', 'venv') group by repo) select repo, 'Frontend' as source, 'Backend' as target, 'HTTP/WebSocket' as kind from has where list_contains(a, 'Frontend') and list_contains(a, 'Backend') union all select repo, 'Backend', 'Data Layer', 'ORM/Direct' from has where list_contains(a, 'Backend') and list_contains(a, 'Data Layer')")
def layer_connections(spark, d):
    return architecture.connections(architecture.layers(code(spark, d)))


@query(S.frameworks())
def frameworks_by_manifest(spark, d):
    files = manifest_files(spark, d).withColumn("ext", F.lit(None).cast("string"))
    return architecture.frameworks(files)


@query(S.all_frameworks())
def frameworks(spark, d):
    files = manifest_files(spark, d).withColumn("ext", F.lit(None).cast("string"))
    return architecture.frameworks(code(spark, d).select("repo", "path", "ext", "content").unionByName(files))


@query(f"select *, case when {S.sure()} then 0.9 else 0.75 end as confidence from ({S.all_frameworks()})")
def framework_confidence(spark, d):
    return architecture.with_confidence(frameworks(spark, d), F.col("repo"))


@query(S.kinds())
def project_types(spark, d):
    return architecture.project_type(code(spark, d))


@query(S.LOC + f", {S.METRICS} select repo, path, complexity from metrics")
def script_complexity(spark, d):
    scripts = code(spark, d).where(F.col("ext").isin(".js", ".ts") & F.col("content").isNotNull())
    return scripts.select("repo", "path", quality.script_complexity(F.col("content")).alias("complexity")).distinct()


def _script_metrics(spark, d):
    scripts = code(spark, d).where(F.col("ext").isin(".js", ".ts") & F.col("content").isNotNull())
    return scripts.select("repo", "path", lines.code_lines(F.col("content")).alias("loc"), quality.script_complexity(F.col("content")).alias("complexity")).distinct()


@query(S.LOC + f", {S.METRICS} select repo, path, {S.MAINTAINED} as maintainability from metrics")
def maintainability(spark, d):
    return _script_metrics(spark, d).select("repo", "path", quality.maintainability(F.col("loc"), F.col("complexity")).alias("maintainability"))


@query(S.LOC + f", {S.METRICS} select repo, round(sum({S.DEBT}) / 60, 1) as debt_hours from metrics group by repo")
def technical_debt(spark, d):
    minutes = quality.debt_minutes(F.col("loc"), F.col("complexity"), F.when(F.col("loc") > 500, 1).otherwise(0))
    return _script_metrics(spark, d).groupBy("repo").agg(F.round(F.sum(minutes) / 60, 1).alias("debt_hours"))


@query("select repo, count(*) as files, round(coalesce(avg(complexity) filter (complexity > 0), 0), 6) as complexity, round(coalesce(avg(maintainability_index), 0), 6) as maintainability from (select distinct repo, file_path, complexity, maintainability_index from file_metrics) group by repo")
def measured_quality(spark, d):
    """Averages of the delivered metrics: complexity over files that have one, maintainability over all."""
    one = table(spark, d, "file_metrics").select("repo", "file_path", "complexity", "maintainability_index").distinct()
    measured = F.avg(F.when(F.col("complexity") > 0, F.col("complexity")))
    return one.groupBy("repo").agg(F.count("*").alias("files"), F.round(F.coalesce(measured, F.lit(0.0)), 6).alias("complexity"), F.round(F.coalesce(F.avg("maintainability_index"), F.lit(0.0)), 6).alias("maintainability"))


@query()
def file_metrics(spark, d):
    return quality.file_metrics(code(spark, d), most_bytes=None).select("repo", "path", "loc", "complexity", "maintainability", "unused", "issues")


@query()
def large_units(spark, d):
    """Functions over 6 lines and classes over 8, as the files of the tables are short; all sizes of files are measured."""
    return quality.large_units(quality.file_metrics(code(spark, d), most_bytes=None, function=6, class_=8))


@query()
def project_quality(spark, d):
    return quality.project_quality(quality.file_metrics(code(spark, d), most_bytes=None))


@query(S.DEPENDENCIES + " select repo, path, manager, name, version from deps")
def dependencies(spark, d):
    return manifests.dependencies(manifest_files(spark, d)).select("repo", "path", "manager", "name", "version")


@query(S.UNIQUE + " select repo, name, version, manager, outdated from uniq")
def unique_dependencies(spark, d):
    return manifests.unique(manifests.dependencies(manifest_files(spark, d)))


@query(S.UNIQUE + " select repo, count(*) as total, count(*) filter (outdated) as outdated, string_agg(distinct manager, ', ' order by manager) as managers from uniq group by repo")
def dependency_summary(spark, d):
    return manifests.summary(manifests.dependencies(manifest_files(spark, d)))


@query(f"with {S.COMMITS} select commit_id, repo, author from commits_ where {S.LARGE}")
def large_commits(spark, d):
    return commits(spark, d).where(history.is_large()).select("commit_id", "repo", "author")


@query(f"with {S.COMMITS}, second as (select *, trim(coalesce(string_split(trim(coalesce(message, '')), chr(10))[2], '')) as s from commits_) select commit_id, repo from second where s = '' and coalesce(files_changed, 0) > 5")
def undescribed_commits(spark, d):
    return history.described(commits(spark, d)).where("undescribed").select("commit_id", "repo")


@query(f"with {S.COMMITS}, counted as (select repo, author, count(*) as commits from commits_ group by repo, author) select repo, author, commits from (select *, row_number() over (partition by repo order by commits desc, author nulls last) as nth from counted) where nth <= 10")
def top_contributors(spark, d):
    return history.top_contributors(commits(spark, d))


@query(f"with {S.COMMITS}, tips as (select repo, author as name, max(epoch(cast(commit_date as timestamptz))) as tip from commits_ where author is not null and commit_date is not null group by 1, 2) select repo, name, cast(floor((epoch(timestamp '{S.NOW}') - tip) / 86400) as bigint) as age_days from tips where floor((epoch(timestamp '{S.NOW}') - tip) / 86400) > 90 and name not in ('main', 'master', 'develop')")
def abandoned_branches(spark, d):
    """Ages of tips; every author's last commit stands for a branch, as no table holds branches."""
    tips = commits(spark, d).where("author is not null and commit_date is not null").groupBy("repo", F.col("author").alias("name")).agg(F.max(F.to_timestamp("commit_date")).alias("tip"))
    return history.abandoned(tips, F.lit(S.NOW).cast("timestamp"))


@query(f"with s as ({S.findings(S.CONTEXTS, R.SECRET_RULES)}), v as ({S.findings(S.SNIPPETS, R.VULNERABILITY_RULES)}), a as (select repo, count(*) as secrets from s group by repo), b as (select repo, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium from v group by repo) select repo, round(greatest(0.0, 10.0 - least(5, coalesce(secrets, 0)) - least(3, coalesce(critical, 0) * 1.5) - least(2, coalesce(high, 0) * 0.5) - least(1, coalesce(medium, 0) * 0.2)), 1) as score from (select repo from a union select repo from b) left join a using (repo) left join b using (repo)")
def security_score(spark, d):
    """The security part of the scores, over the snippets of both tables of findings."""
    a = scan.secrets(contexts(spark, d)).groupBy("repo").agg(F.count("*").alias("secrets"))
    b = scan.by_severity(scan.vulnerabilities(snippets(spark, d))).select("repo", "critical", "high", "medium")
    row = a.join(b, "repo", "full").fillna(0)
    zero = ("languages", "total_loc", "layers", "frameworks", "complexity", "duplication", "large_functions", "maintainability", "n_plus_one", "memory", "large_files", "dependencies", "outdated", "sensitive", "certificates", "blocking", "loops", "vulnerable", "deprecated")
    whole = row.select("*", *(F.lit(0).alias(n) for n in zero), F.lit(False).alias("has_readme"), F.lit(False).alias("has_docs"))
    return report.scores(whole).select("repo", F.col("score_security").alias("score"))


@query()
def audit(spark, d):
    found = scan.history_secrets(history.described(commits(spark, d)), "message")
    return report.audit(code(spark, d), found, most_characters=None, most_bytes=None)


@query()
def priorities(spark, d):
    return report.priorities(audit(spark, d))


@query()
def recommendations(spark, d):
    return report.recommendations(audit(spark, d))


@query()
def recommendation_summary(spark, d):
    return report.recommendation_summary(recommendations(spark, d))


_QUICK = " union all ".join(f"select repo, path, line_no, rule_type, severity, {S.text(n)} as scanner from ({S.findings(src, rules)})" for n, rules in (("secrets", R.SECRET_RULES), ("vulnerabilities", R.VULNERABILITY_RULES)) for src in (S.CONTEXTS, S.SNIPPETS))


@query(f"select distinct * from ({_QUICK})")
def quick_scan(spark, d):
    """Both scans over the snippets of both tables of findings."""
    both = contexts(spark, d).unionByName(snippets(spark, d))
    return report.quick_scan(both, None).select("repo", "path", "line_no", "rule_type", "severity", "scanner").distinct()


@query()
def p4_found(spark, d):
    return nested.links(table(spark, d, "analysis_results"))


@query()
def p4_findings(spark, d):
    return nested.children_table(table(spark, d, "analysis_results"), nested.FINDING)


@query()
def p4_large_commits(spark, d):
    return nested.children_table(table(spark, d, "analysis_results"), nested.LARGE_COMMIT)


@query()
def p4_results(spark, d):
    return nested.results_table(table(spark, d, "analysis_results"))


@query()
def p4_traces(spark, d):
    return nested.grandchildren_table(table(spark, d, "analysis_results"), nested.FINDING)
