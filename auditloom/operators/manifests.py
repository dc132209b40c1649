"""Dependency manifests of twelve package managers to one table of dependencies.

Every manifest is parsed by JVM expressions from its text to an array of (name, version), so all managers share one narrow
pass. Null or empty manifests, and JSON that does not parse, give no rows. Where the audited parsers have slips of their own
(a quoted attribute after a Cargo version, nested keys of a pubspec), `strict` follows the formats instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import clean_version, line_array, strip

NONE = "cast(array() as array<struct<name:string,version:string>>)"

# How manifests write a dependency, its version, and the keys that are none.
NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
COMPOSER_SECTIONS = ["require", "require-dev"]
PIPFILE_KEYS = ["name", "requires", "packages"]
PIP_LINE = r"^([a-zA-Z0-9_.-]+)\s*([><=!~]+.*)?$"
PIPFILE_LINE = r"(?m)^(\w[\w.-]*)\s*=\s*[\"']([^\"'\n]+)[\"']"
PYPROJECT_LINE = r"^[\"']([a-zA-Z0-9_.-]+)(.*)[\"']"
PYPROJECT_VERSION = r"([><=!~]+\s*[\d.*]+)"
MAVEN_BLOCK = r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*(?:<version>([^<]+)</version>)?"
GRADLE_WORDS = "implementation|api|compile|testImplementation"
GEM_LINE = r"gem\s+['\"]([^'\"]+)['\"](?:,\s*['\"]([^'\"]+)['\"])?"
NUGET_TAG = r"<PackageReference\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]+)\")?"


def _dep(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _pairs(text: Column, pattern: str, name: int = 1, version: int = 2) -> Column:
    """(name, version) of every match; a group that takes no part is ''."""
    names, versions = (F.regexp_extract_all(text, F.lit(pattern), g) for g in (name, version))
    return F.transform(F.arrays_zip(names.alias("n"), versions.alias("v")), lambda z: _dep(z["n"], z["v"]))


def _any_version(deps: Column) -> Column:
    return F.transform(deps, lambda d: _dep(d["name"], F.when(d["version"] == "", "*").otherwise(d["version"])))


def _from_lines(lines: Column, pattern: str) -> Column:
    """(name, version) of the lines that match from their start."""
    kept = F.filter(F.transform(lines, strip), lambda l: l.rlike(pattern))
    return F.transform(kept, lambda l: _dep(F.regexp_extract(l, pattern, 1), F.regexp_extract(l, pattern, 2)))


def _json_sections(text: Column, sections: list[str]) -> Column:
    fields = ", ".join(f"`{s}` map<string,string>" for s in sections)
    parsed = F.from_json(text, fields)
    maps = [F.coalesce(F.map_entries(parsed[s]), F.expr("cast(array() as array<struct<key:string,value:string>>)")) for s in sections]
    return F.transform(F.flatten(F.array(*maps)), lambda e: _dep(e["key"], clean_version(e["value"])))


def package_json(text: Column, strict: bool) -> Column:
    return _json_sections(text, NPM_SECTIONS)


def composer_json(text: Column, strict: bool) -> Column:
    php = (lambda n: n == "php") if strict else (lambda n: n.startswith("php"))
    return F.filter(_json_sections(text, COMPOSER_SECTIONS), lambda d: ~php(d["name"]))


def requirements(text: Column, strict: bool) -> Column:
    bare = F.filter(F.transform(line_array(text), strip), lambda l: ~l.rlike(r"^(?:#|-|$)"))
    name = r"^([a-zA-Z0-9_.-]+)" + (r"(?:\[[^\]]*\])?" if strict else "")
    form = PIP_LINE if not strict else name + r"\s*((?:[><=!~]=?|===)[^;#]*)?\s*(?:[;#].*)?$"
    return _any_version(F.transform(F.filter(bare, lambda l: l.rlike(form)), lambda l: _dep(F.regexp_extract(l, form, 1), strip(F.regexp_extract(l, form, 2)))))


def pipfile(text: Column, strict: bool) -> Column:
    found = _pairs(text, PIPFILE_LINE)
    return F.transform(F.filter(found, lambda d: ~d["name"].isin(PIPFILE_KEYS)), lambda d: _dep(d["name"], clean_version(d["version"])))


def pyproject(text: Column, strict: bool) -> Column:
    block = F.regexp_extract(text, r"(?ms)^[ \t]*dependencies = \[[ \t]*\r?$(.*?)(?:^[ \t]*\][ \t]*\r?$|\z)", 1)
    found = _from_lines(F.transform(line_array(block), lambda l: F.regexp_replace(strip(l), ",+$", "")), PYPROJECT_LINE)
    return _any_version(F.transform(found, lambda d: _dep(d["name"], F.regexp_extract(d["version"], PYPROJECT_VERSION, 1))))


def cargo(text: Column, strict: bool) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^[ \t]*\[(?:dev-|build-)?dependencies\][ \t]*\r?$(.*?)(?=^[ \t]*\[|\z)"), 1)
    lines = F.flatten(F.transform(blocks, line_array))
    quoted = "[^\"']+" if strict else ".+"
    form = r"^([\w-]+)\s*=\s*(?:\{.*version\s*=\s*)?[\"'](" + quoted + r")[\"']"
    return _from_lines(lines, form)


def pom(text: Column, strict: bool) -> Column:
    groups, artifacts, versions = (F.regexp_extract_all(text, F.lit(MAVEN_BLOCK), g) for g in (1, 2, 3))
    rows = F.arrays_zip(groups.alias("g"), artifacts.alias("a"), versions.alias("v"))
    return _any_version(F.transform(rows, lambda z: _dep(F.concat(strip(z["g"]), F.lit(":"), strip(z["a"])), strip(z["v"]))))


def gradle(text: Column, strict: bool) -> Column:
    gap = r"\s*\(?\s*" if strict else r"\s+"
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?:{GRADLE_WORDS})" + gap + r"['\"]([^'\"]+)['\"]"), 1), lambda x: F.split(x, ":"))
    whole = F.filter(found, lambda p: F.size(p) >= 2)
    return F.transform(whole, lambda p: _dep(F.concat(F.get(p, F.lit(0)), F.lit(":"), F.get(p, F.lit(1))), F.coalesce(F.get(p, F.lit(2)), F.lit("*"))))


def go_mod(text: Column, strict: bool) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^[ \t]*require \([ \t]*\r?$(.*?)(?:^[ \t]*\)[ \t]*\r?$|\z)"), 1)
    inside = _from_lines(F.filter(F.flatten(F.transform(blocks, line_array)), lambda l: ~strip(l).startswith("//")), r"^(\S+)\s+(\S+)")
    single = _from_lines(line_array(text), r"^require\s+([^\s(]\S*)\s+(\S+)")
    return F.concat(inside, single)


def gemfile(text: Column, strict: bool) -> Column:
    return _any_version(_pairs(text, GEM_LINE))


def pubspec(text: Column, strict: bool) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^[ \t]*dependencies:[ \t]*\r?$(.*?)(?=^[ \t]*dev_dependencies:[ \t]*\r?$|\z)"), 1)
    lines = F.flatten(F.transform(blocks, line_array))
    if strict:  # only the keys one level in, until the next top-level key
        blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^dependencies:[ \t]*\r?$(.*?)(?=^\w|\z)"), 1)
        lines = F.filter(F.flatten(F.transform(blocks, line_array)), lambda l: l.rlike(r"^ {2}\w"))
    found = _from_lines(F.filter(lines, lambda l: ~strip(l).startswith("#")), r"^(\w+):\s*(.+)$")
    return F.transform(found, lambda d: _dep(d["name"], F.regexp_replace(strip(d["version"]), r"^\^", "")))


def csproj(text: Column, strict: bool) -> Column:
    return _any_version(_pairs(text, NUGET_TAG))


@dataclass(frozen=True)
class Manager:
    """A manager: the order in which its manifests are read, its name, the paths of its manifests, its parser."""

    place: int
    name: str
    path: str
    parse: Callable[[Column, bool], Column]


MANAGERS = tuple(
    Manager(i, name, path, parse)
    for i, (name, path, parse) in enumerate(
        (
            ("npm", r"^package\.json$", package_json),
            ("pip", r"^requirements\.txt$", requirements),
            ("pipenv", r"^Pipfile$", pipfile),
            ("pyproject", r"^pyproject\.toml$", pyproject),
            ("cargo", r"^Cargo\.toml$", cargo),
            ("maven", r"^pom\.xml$", pom),
            ("gradle", r"^build\.gradle$", gradle),
            ("go", r"^go\.mod$", go_mod),
            ("bundler", r"^Gemfile$", gemfile),
            ("composer", r"^composer\.json$", composer_json),
            ("pub", r"^pubspec\.yaml$", pubspec),
            ("nuget", r"^[^/]*\.csproj$", csproj),
            ("npm nested", r"^[^/]+/package\.json$", package_json),
        )
    )
)


def dependencies(files: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, path, manager, place, seq, name, version): one row a dependency, in the order of its manifest."""
    found, manager, place = F.expr(NONE), F.lit(None).cast("string"), F.lit(None).cast("int")
    for m in reversed(MANAGERS):
        here = F.col("path").rlike(m.path)
        found = F.when(here, m.parse(F.col("content"), strict)).otherwise(found)
        manager, place = F.when(here, m.name).otherwise(manager), F.when(here, m.place).otherwise(place)
    known = files.where(F.col("content").isNotNull()).withColumn("manager", manager).where("manager is not null")
    return known.select("repo", "path", "manager", place.alias("place"), F.posexplode(found).alias("seq", "dep")).select("repo", "path", "manager", "place", "seq", "dep.name", "dep.version").where("name is not null and version is not null")


def unique(deps: DataFrame) -> DataFrame:
    """(repo, name, version, manager, outdated): of each name, whatever its case, the first met; unpinned ones are outdated."""
    first = deps.groupBy("repo", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "version", "manager"), F.struct("place", "path", "seq")).alias("f"))
    return first.select("repo", "f.name", "f.version", "f.manager", F.col("f.version").isin("*", "latest", "HEAD").alias("outdated"))


def summary(deps: DataFrame) -> DataFrame:
    """(repo, total, outdated, managers) over unique dependencies; managers sorted and joined."""
    return unique(deps).groupBy("repo").agg(F.count("*").alias("total"), F.count_if("outdated").alias("outdated"), F.concat_ws(", ", F.sort_array(F.collect_set("manager"))).alias("managers"))


def by_manifest(deps: DataFrame) -> DataFrame:
    """`deps` numbered through in the order of reading; a window, for reports of one repository."""
    return deps.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy("place", "path", "seq")))
