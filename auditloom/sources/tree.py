"""A data source for file trees that also reads names which Spark's own sources hide (leading dots and underscores).

    spark.dataSource.register(TreeSource)
    spark.read.format("filetree").load("/path/of/trees")

Options: `path`; `repo` (a name; without it the first directory under the path is the repository when `by_directory` is true);
`skip` (names of directories that are not entered, separated by commas); `suffixes` and `max_bytes` (which files are read);
`metadata_only` (no contents); `tasks` (from how many directories on the driver stops listing and tasks walk on). Bytes that are no UTF-8 are dropped, unreadable
files have null content and size, directories come as rows with `kind` = dir so that empty ones are seen.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories that hold no source of a project.
SKIPPED = "node_modules,.git,__pycache__,.venv,venv,dist,build,.next,.nuxt,target,bin,obj,.idea,.vscode"
SCHEMA = "repo string, path string, name string, ext string, kind string, size long, content string"


class Folder(InputPartition):
    """A directory that one task reads: its repository, the root, its relative path, and whether what lies deeper belongs to it."""

    def __init__(self, repo: str, root: str, path: str, deep: bool):
        self.repo, self.root, self.path, self.deep = repo, root, path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.skip = set(options.get("skip", SKIPPED).split(","))
        self.suffixes = tuple(x for x in options.get("suffixes", "").lower().split(",") if x)
        self.most = int(options.get("max_bytes", 0))
        self.metadata = options.get("metadata_only", "false").lower() == "true"
        self.tasks = int(options.get("tasks", 256))

    def _roots(self) -> list[tuple[str, str]]:
        base = self.options["path"]
        if not os.path.isdir(base):
            raise FileNotFoundError(base)
        if self.options.get("by_directory", "false").lower() == "true":
            return [(name, os.path.join(base, name)) for name in sorted(os.listdir(base)) if os.path.isdir(os.path.join(base, name))]
        return [(self.options.get("repo", os.path.basename(os.path.normpath(base))), base)]

    def _entered(self, name: str) -> bool:
        return name not in self.skip and not name.endswith(".egg-info")

    def partitions(self) -> list[Folder]:
        """Lists level by level until there are enough directories for the tasks, which walk on from there."""
        level = [(repo, root, "") for repo, root in self._roots()]
        shallow: list[Folder] = []
        while level and len(level) < self.tasks:
            below = []
            for repo, root, path in level:
                shallow.append(Folder(repo, root, path, False))
                with os.scandir(os.path.join(root, path)) as entries:
                    below += [(repo, root, f"{path}/{e.name}".lstrip("/")) for e in entries if e.is_dir(follow_symlinks=False) and self._entered(e.name)]
            level = sorted(below)
        return [*shallow, *(Folder(*f, True) for f in level)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        repo, root = partition.repo, partition.root
        for folder, names, files in os.walk(os.path.join(root, partition.path)):
            names[:] = sorted(filter(self._entered, names)) if partition.deep else []
            relative = os.path.relpath(folder, root).replace(os.sep, "/")
            if relative != ".":
                yield repo, relative, relative.rsplit("/", 1)[-1], "", "dir", None, None
            for name in sorted(files):
                full = os.path.join(folder, name)
                if self.suffixes and not name.lower().endswith(self.suffixes):
                    continue
                try:
                    size = os.path.getsize(full)
                    if self.most and size >= self.most:
                        continue
                    content = None if self.metadata else open(full, "rb").read().decode("utf-8", "ignore")
                except OSError:
                    size = content = None
                dot = name.rfind(".")
                yield repo, name if relative == "." else f"{relative}/{name}", name, name[dot:].lower() if dot > 0 else "", "file", size, content


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def corpus(spark, path: str, **options) -> "tuple":
    """(files, directories) of a tree: files as the operators take them, directories as (repo, directory)."""
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("filetree").options(**{k: str(v) for k, v in options.items()}).load(path)
    files = rows.where("kind = 'file'").drop("kind")
    return files, rows.where("kind = 'dir' and not path like '%/%'").select("repo", rows.path.alias("directory"))
