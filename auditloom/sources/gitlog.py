"""A data source for the commits and branches of git repositories, read by `git log` on the executors.

    spark.dataSource.register(GitLogSource)
    spark.read.format("gitlog").option("what", "commits").load("/path/of/repository")

`what` is commits or branches; `diff` = true adds the change against the parent. A path that is no repository gives no rows.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMITS = "repo string, seq int, sha string, author string, ts timestamp, message string, files_changed int, insertions int, deletions int, diff string"
BRANCHES = "repo string, name string, tip timestamp"
MARK = "\x1e"


def _git(path: str, *arguments: str) -> str:
    run = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *arguments], capture_output=True, timeout=600)
    return run.stdout.decode("utf-8", "ignore") if run.returncode == 0 else ""


def _time(seconds: str) -> datetime:
    return datetime.fromtimestamp(int(seconds), timezone.utc).replace(tzinfo=None)


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        repo = path.rstrip("/").rsplit("/", 1)[-1]
        if self.options.get("what", "commits") == "branches":
            for line in _git(path, "for-each-ref", "--format=%(refname:short)%09%(committerdate:unix)", "refs/heads").splitlines():
                name, _, seconds = line.partition("\t")
                yield repo, name, _time(seconds)
            return
        for seq, entry in enumerate(self._entries(path)):
            sha, parents, author, seconds, message, rest = entry.split("\x1f", 5)
            at = rest.find("\ndiff --")
            counts = [line.split("\t") for line in rest[: at if at >= 0 else None].splitlines() if line.count("\t") >= 2]
            counts = [] if " " in parents else counts  # merges change nothing of their own
            number = lambda x: int(x) if x.isdigit() else 0
            diff = (rest[at + 1 :] if at >= 0 else "") if self._diff() else None
            yield repo, seq, sha[:8], author, _time(seconds), message.rstrip("\n"), len(counts), sum(number(c[0]) for c in counts), sum(number(c[1]) for c in counts), diff

    def _diff(self) -> bool:
        return self.options.get("diff", "false").lower() == "true"

    def _entries(self, path: str) -> Iterator[str]:
        """The log commit by commit, from one process whose output is read as it comes; no more than one commit is held."""
        limit = ["-n", self.options["limit"]] if self.options.get("limit") else []
        change = ["-p", "--cc"] if self._diff() else []
        command = ["git", "-c", "safe.directory=*", "-C", path, "log", *limit, "--numstat", *change, f"--format={MARK}%H%x1f%P%x1f%an%x1f%ct%x1f%B%x1f"]
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as process:
            held: list[bytes] = []
            for line in process.stdout:
                if line.startswith(MARK.encode()) and held:
                    yield b"".join(held)[1:].decode("utf-8", "ignore")
                    held = []
                held.append(line)
            if held and held[0].startswith(MARK.encode()):
                yield b"".join(held)[1:].decode("utf-8", "ignore")


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return BRANCHES if self.options.get("what", "commits") == "branches" else COMMITS

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))
