"""Languages, frameworks, kind and layers of repositories, from the paths and texts of their files.

Files have `repo`, `path`, `ext` and `content`. Unknown and null suffixes have no language. Ties go by name, or by the order
of the kinds. Directories are those in which some file lies; `directories` may name further, empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.lines import first_files

# The language of each suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".go": "go", ".rs": "rust", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "cpp", ".h": "cpp",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".dart": "dart",
}
# Of each framework the words in a manifest, the words in a source, the suffixes.
FRAMEWORKS = {
    "React": (["react", "next", "remix", "gatsby"], ["from 'react'", 'from "react"', "import React"], [".jsx", ".tsx"]),
    "Vue": (["vue", "nuxt"], ["from 'vue'", 'from "vue"', "Vue.createApp"], [".vue"]),
    "Angular": (["@angular/core"], ["@Component", "@Injectable", "@NgModule"], [".component.ts"]),
    "Svelte": (["svelte", "sveltekit"], [], [".svelte"]),
    "Express": (["express"], ["require('express')", 'require("express")', "from 'express'"], []),
    "Fastify": (["fastify"], ["require('fastify')", "from 'fastify'"], []),
    "Django": (["django"], ["from django", "import django"], []),
    "FastAPI": (["fastapi"], ["from fastapi", "import fastapi"], []),
    "Flask": (["flask"], ["from flask", "import Flask"], []),
    "Tornado": (["tornado"], ["import tornado"], []),
    "Spring Boot": (["spring-boot", "spring-framework"], ["import org.springframework"], []),
    "Quarkus": (["quarkus"], ["import io.quarkus"], []),
    "Gin": (["github.com/gin-gonic"], ['"github.com/gin-gonic'], []),
    "Echo": (["github.com/labstack/echo"], ['"github.com/labstack/echo'], []),
    "Actix": (["actix-web"], ["use actix_web"], []),
    "Axum": (["axum"], ["use axum"], []),
    "React Native": (["react-native"], ["from 'react-native'"], []),
    "Flutter": (["flutter"], ["import 'package:flutter"], []),
    "ASP.NET": (["Microsoft.AspNetCore"], ["using Microsoft.AspNetCore"], []),
}
MANIFESTS = ("package.json", "requirements.txt", "pom.xml", "go.mod", "Cargo.toml")
# Words of directory names by layer, in the order in which they are tried.
LAYERS = {
    "Frontend": "frontend client web ui components pages views templates static assets".split(),
    "Backend": "backend server api routes controllers handlers middleware services".split(),
    "Data Layer": "database db models migrations schemas repositories data".split(),
    "Tests": "test tests spec __tests__ e2e".split(),
    "Infrastructure": "infrastructure infra deploy k8s docker terraform ci .github".split(),
}
# Kinds of project, in the order that breaks ties, and the words of command line tools.
KINDS = ["monolith", "microservices", "api_rest", "mobile", "desktop", "cli", "library", "unknown"]
CLI_WORDS = ["argparse", "click", "typer", "cobra", "clap"]


def _contains(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def language_of(ext: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), F.lower(ext))


def languages(files: DataFrame) -> DataFrame:
    """(repo, language, file_count, percentage), of files with a known suffix, each once."""
    counted = files.select("repo", "path", language_of(F.col("ext")).alias("language")).where("language is not null").distinct().groupBy("repo", "language").agg(F.count("*").alias("file_count"))
    share = F.col("file_count") * 100 / F.sum("file_count").over(Window.partitionBy("repo"))
    return counted.select("repo", "language", "file_count", F.round(share, 1).alias("percentage"))


def primary_language(files: DataFrame) -> DataFrame:
    """(repo, language): the most frequent one, the first by name of equals."""
    return languages(files).groupBy("repo").agg(F.min_by("language", F.struct(-F.col("file_count"), "language")).alias("language"))


def frameworks(files: DataFrame, sources: int | None = None, suffixes: int | None = None) -> DataFrame:
    """(repo, framework, evidence): by words in the root manifests, else in the sources, else by suffix; `sources` and
    `suffixes` are the numbers of first files by path that are read, all by default.

    One row a repository holds a flag for each framework and evidence, so the texts are read once and never shuffled.
    """
    known = files.where(language_of(F.col("ext")).isNotNull())
    first = lambda most: known if most is None else first_files(known, most)
    text = F.when(F.col("path") == "requirements.txt", F.lower("content")).otherwise(F.col("content"))
    flags = lambda df, name, test: df.groupBy("repo").agg(*(F.max(F.coalesce(test(v), F.lit(False))).alias(f"{name}_{i}") for i, v in enumerate(FRAMEWORKS.values())))
    by_manifest = flags(files.where(F.col("path").isin(*MANIFESTS)), "m", lambda v: _contains(text, v[0]))
    by_source = flags(first(sources), "s", lambda v: _contains(F.col("content"), v[1]))
    by_suffix = flags(first(suffixes), "x", lambda v: F.lower("ext").isin(*v[2]) if v[2] else F.lit(False))
    all_ = by_manifest.join(by_source, "repo", "full").join(by_suffix, "repo", "full")
    rows = [F.when(F.col(f"m_{i}"), F.struct(F.lit(n).alias("framework"), F.lit("manifest").alias("evidence"))).when(F.col(f"s_{i}"), F.struct(F.lit(n).alias("framework"), F.lit("import").alias("evidence"))).when(F.col(f"x_{i}"), F.struct(F.lit(n).alias("framework"), F.lit("suffix").alias("evidence"))) for i, n in enumerate(FRAMEWORKS)]
    return all_.select("repo", F.inline(F.array_compact(F.array(*rows))))


def with_confidence(found: DataFrame, root: Column) -> DataFrame:
    """Detected frameworks with `confidence`: 0.9 where the path of the tree holds a word of the framework's manifests, else 0.75."""
    sure = F.lit(False)
    for name, (words, _, _) in FRAMEWORKS.items():
        sure = sure | (F.col("framework") == name) & _contains(root, words)
    return found.withColumn("confidence", F.when(sure, 0.9).otherwise(0.75))


def directories(files: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(repo, directory): the top-level directories, with those of `empty` (repo, directory) too."""
    top = files.where(F.col("path").contains("/")).select("repo", F.split("path", "/")[0].alias("directory"))
    return (top if empty is None else top.unionByName(empty.select("repo", "directory"))).distinct()


def layer_of(directory: Column) -> Column:
    layer = F.lit("Other")
    for name, words in reversed(LAYERS.items()):
        layer = F.when(_contains(F.lower(directory), words), name).otherwise(layer)
    return layer


def layers(files: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(repo, directory, layer) of the shown top-level directories."""
    shown = directories(files, empty).where(~F.col("directory").startswith(".") & ~F.col("directory").isin("node_modules", "__pycache__", "venv"))
    return shown.withColumn("layer", layer_of(F.col("directory")))


def connections(layers: DataFrame) -> DataFrame:
    """(repo, source, target, kind): what the layers of a repository let expect."""
    has = layers.groupBy("repo").agg(F.collect_set("layer").alias("all"))
    link = lambda a, b, kind: F.when(F.array_contains("all", a) & F.array_contains("all", b), F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(kind).alias("kind")))
    return has.select("repo", F.inline(F.array_compact(F.array(link("Frontend", "Backend", "HTTP/WebSocket"), link("Backend", "Data Layer", "ORM/Direct")))))


def project_type(files: DataFrame, empty: DataFrame | None = None, sources: int | None = None, suffixes: int | None = None) -> DataFrame:
    """(repo, project_type): the kind with most points; the first in order of equals, monolith without any.

    `sources` and `suffixes` are the numbers of first files by path that are read, all by default. Every file with a word of
    command line tools gives two points, as in the audited rules, which read 30 files and ask 50 for their suffixes.
    """
    top = directories(files, empty).groupBy("repo").agg(F.collect_set("directory").alias("dirs"))
    roots = files.groupBy("repo").agg(F.collect_set(F.when(~F.col("path").contains("/"), F.col("path"))).alias("roots"))
    known = files.where(language_of(F.col("ext")).isNotNull())
    ext = F.lower("ext")
    sampled = lambda most: known if most is None else first_files(known, most)
    first = sampled(suffixes).groupBy("repo").agg(F.max(ext == ".dart").alias("dart"), F.max(ext.isin(".cs", ".xaml")).alias("cs"))
    spoken = sampled(sources).select("repo", "path", _contains(F.col("content"), CLI_WORDS).alias("cli")).distinct()
    cli = spoken.groupBy("repo").agg(F.count_if("cli").alias("cli"))
    rows = roots.join(top, "repo", "left").join(first, "repo", "left").join(cli, "repo", "left")
    no = F.expr("cast(array() as array<string>)")
    d = lambda *names: F.arrays_overlap(F.coalesce("dirs", no), F.array(*map(F.lit, names)))
    r = lambda *names: F.arrays_overlap(F.coalesce("roots", no), F.array(*map(F.lit, names)))
    n = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    points = {
        "microservices": n(r("docker-compose.yml", "docker-compose.yaml"), 2) + n(d("services"), 3) + n(d("k8s", "kubernetes"), 2),
        "api_rest": sum((n(d(x), 2) for x in ("api", "routes", "controllers", "endpoints")), n(d("public") & d("src"), 1)),
        "mobile": n(r("pubspec.yaml"), 3) + n(d("android", "ios"), 2) + n(F.col("dart"), 2),
        "desktop": n(F.col("cs"), 1),
        "cli": F.coalesce("cli", F.lit(0)) * 2,
        "library": n(r("setup.py", "setup.cfg"), 1) + n(d("lib") & ~d("src"), 1),
    }
    scored = F.array(*(F.struct((-points[k]).cast("long").alias("p"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(KINDS) if k in points))
    best = F.array_min(scored)
    return rows.select("repo", F.when(best["p"] == 0, "monolith").otherwise(best["k"]).alias("project_type"))
