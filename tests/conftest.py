"""One session for all tests, and the small projects they audit."""

import os

os.environ.setdefault("PYSPARK_PYTHON", __import__("sys").executable)

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def corpus(spark):
    """Makes a corpus from {path: content} of one or more repositories."""

    def make(*projects: dict, repos=("r", "s", "t")):
        rows = []
        for repo, files in zip(repos, projects):
            for path, content in files.items():
                name = path.rsplit("/", 1)[-1]
                dot = name.rfind(".")
                rows.append((repo, path, name, name[dot:].lower() if dot > 0 else "", None if content is None else len(content.encode()), content))
        return spark.createDataFrame(rows, "repo string, path string, name string, ext string, size long, content string")

    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
