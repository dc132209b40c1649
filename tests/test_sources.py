"""Readers of trees and histories, and the incremental scan."""

import os
import subprocess

import pytest

from auditloom.operators import scan
from auditloom.plans import rules as R
from auditloom.sources import gitlog, tree
from auditloom.streaming import scan as stream
from tests.conftest import rows


def test_tree(spark, tmp_path):
    for path, data in {".env": b"A=1\n", ".github/ci.yml": b"x", "_p/__init__.py": b"", "node_modules/x.js": b"x", "x.egg-info/y": b"", "bin.py": b"a\xffb", "A.PY": b"1"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "empty").mkdir()
    files, directories = tree.corpus(spark, str(tmp_path), repo="r")
    assert rows(files, "path", "ext", "size", "content") == [(".env", "", 4, "A=1\n"), (".github/ci.yml", ".yml", 1, "x"), ("A.PY", ".py", 1, "1"), ("_p/__init__.py", ".py", 0, ""), ("bin.py", ".py", 3, "ab")]
    assert rows(directories, "directory") == [(".github",), ("_p",), ("empty",)]
    only, _ = tree.corpus(spark, str(tmp_path), repo="r", suffixes=".py", max_bytes=3)
    assert rows(only, "path") == [("A.PY",), ("_p/__init__.py",)]
    with pytest.raises(Exception):
        tree.corpus(spark, str(tmp_path / "none"))[0].count()


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b.invalid", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_text("password = 'hunter22'\n")
    git("add", "."), git("commit", "-qm", "first\n\nbody")
    spark.dataSource.register(gitlog.GitLogSource)
    commits = spark.read.format("gitlog").option("diff", "true").load(str(tmp_path))
    assert rows(commits, "seq", "author", "message", "files_changed", "insertions", "deletions") == [(0, "A B", "first\n\nbody", 1, 1, 0)]
    assert scan.history_secrets(commits, "diff").where("has_secret").count() == 1
    assert rows(spark.read.format("gitlog").option("what", "branches").load(str(tmp_path)), "name") == [("main",)]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / ".git").write_text("broken")
    assert spark.read.format("gitlog").load(str(empty)).count() == 0


def test_stream(spark, corpus, tmp_path):
    files = corpus({"a.py": 'API_KEY = "abcd1234efgh5678"\nx\n'}, {"b.py": None})
    folder = os.path.join(tmp_path, "in")
    files.write.parquet(folder)
    found = stream.findings(stream.incoming(spark, folder, "repo string, path string, content string", 1), R.SECRET_RULES)
    job = found.writeStream.format("memory").queryName("found").outputMode("append").start()
    job.processAllAvailable()
    job.stop()
    assert rows(spark.table("found")) == rows(scan.secrets(files), "repo", "path", "line_no", "rule_type", "severity")
