"""python -m auditloom TREE OUT: audits a tree and writes audit.json, audit.md, README.md and GUIDE.md to the folder OUT."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from auditloom.operators import architecture, history, manifests, scan
from auditloom.plans import report
from auditloom.sources import gitlog, tree


def run(spark: SparkSession, path: str, out: str) -> dict:
    """Audits the tree at `path`, with its history if it has one, and writes to `out`, which must not lie in the tree."""
    source, folder = Path(path).resolve(), Path(out).resolve()
    if folder.is_relative_to(source):
        raise ValueError("the reports would be read by the next audit")
    files, directories = tree.corpus(spark, str(source))
    spark.dataSource.register(gitlog.GitLogSource)
    commits = branches = None
    if (source / ".git").exists():
        log = spark.read.format("gitlog").option("diff", "true").option("limit", str(history.INSPECTED)).load(str(source))
        commits = scan.history_secrets(history.described(log), "diff")
        branches = spark.read.format("gitlog").option("what", "branches").load(str(source))
    files = files.cache()
    row = report.audit(files, commits, branches, F.current_timestamp(), directories).first()
    if row is None:
        raise ValueError("no files")
    one = spark.createDataFrame([row])
    layers = [r.directory for r in architecture.layers(files, directories).orderBy("directory").collect()]
    found = [r.framework for r in architecture.frameworks(files).orderBy("framework").collect()]
    managers = [r.manager for r in manifests.dependencies(files).select("manager", "place").distinct().orderBy("place").collect()]
    findings: dict[str, list] = {}
    for r in report.quick_scan(files).orderBy("path", "line_no").limit(1000).collect():
        findings.setdefault(r.scanner, []).append(r)
    folder.mkdir(parents=True, exist_ok=True)
    whole = row.asDict() | {"summaries": report.summaries(row), "frameworks_found": found, "directories": layers}
    (folder / "audit.json").write_text(json.dumps(whole, indent=2, default=str))
    (folder / "audit.md").write_text(report.render(row, report.priorities(one).collect(), layers, found, findings))
    (folder / "README.md").write_text(report.readme(row, layers, found, managers))
    (folder / "GUIDE.md").write_text(report.guide(row, layers, managers))
    files.unpersist()
    return whole


if __name__ == "__main__":
    if len(sys.argv) != 3:
        sys.exit(__doc__)
    print(json.dumps(run(SparkSession.builder.getOrCreate(), *sys.argv[1:]), default=str))
