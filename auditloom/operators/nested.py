"""Deeply nested semi-structured records to flat tables that keep the parent's key and the place in the parent.

A record is JSON text, parsed once to VARIANT. The children of one kind stand at one of several paths (naming styles) and
come as a list, as a JSON text of it, as a map from place to entry, in an envelope with `items`, or as a single entry.
`transform` attaches the ancestors' keys and places, `flatten` combines the arrays, one `inline` per table emits the rows.

Defined results: null, empty, cut-off or failed records, absent and null parts give no rows; null entries give no row but
keep their place; a field that is absent or null is null. A record received more than once gives its rows once. Extra
columns of the input are ignored, whatever their names. Every step is narrow but the last, which drops repeated rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST, MAP = "array<variant>", "map<string,variant>"
PLACES = "array<struct<pos:int,entry:variant>>"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _styles(name: str) -> tuple[str, ...]:
    """The naming styles in which a snake_case field may come."""
    c = camel(name)
    return tuple(dict.fromkeys((name, c, c[:1].upper() + c[1:], name.replace("_", "-"))))


def get(v: Column, name: str, kind: str = "variant") -> Column:
    """The field `name` of `v` under any naming style."""
    return F.coalesce(*(F.try_variant_get(v, f"$['{s}']", kind) for s in _styles(name)))


def _parsed(df: DataFrame, name: str) -> DataFrame:
    """Column `name`, a VARIANT: where it is a JSON text, the parsed text. Staged, so that each part is evaluated once."""
    v = F.col(name)
    df = df.withColumn("_structured", F.coalesce(F.try_variant_get(v, "$", LIST).isNotNull() | F.try_variant_get(v, "$", MAP).isNotNull(), F.lit(False)))
    df = df.withColumn("_text", F.when(~F.col("_structured"), F.try_parse_json(F.try_variant_get(v, "$", "string"))))
    return df.withColumn(name, F.when(F.col("_structured"), v).otherwise(F.col("_text"))).drop("_structured", "_text")


@dataclass(frozen=True)
class Child:
    """A target table: its name, where its entries are, how an entry is known, and its columns with their types."""

    name: str
    path: tuple[str, ...]
    ref: str
    fields: dict[str, str] = field(default_factory=dict)
    nested: str = ""  # a list inside the entry


FINDING = Child(
    "finding",
    ("vulnerabilities", "findings"),
    "file_path",
    {"file_path": "string", "line_number": "int", "vulnerability_type": "string", "severity": "string", "description": "string", "code_snippet": "string", "recommendation": "string", "cwe_id": "string"},
    "trace",
)
LARGE_COMMIT = Child(
    "large_commit",
    ("git", "large_commits"),
    "hash",
    {"hash": "string", "message": "string", "author": "string", "date": "string", "files_changed": "int", "insertions": "int", "deletions": "int", "has_secret": "boolean", "is_too_large": "boolean", "has_no_description": "boolean"},
)
CHILDREN = (FINDING, LARGE_COMMIT)


def records(df: DataFrame, key: str, text: str, envelope: str = "result") -> DataFrame:
    """(key, root): each text as one VARIANT, taken out of a response envelope, itself perhaps text."""
    root = _parsed(df.select(F.col(key), F.try_parse_json(text).alias("root")), "root")
    root = root.select(key, "root", F.try_variant_get("root", "$.success", "boolean").alias("success"), F.try_variant_get("root", f"$['{envelope}']", "variant").alias("inner"))
    root = _parsed(root.withColumn("wrapped", F.col("inner").isNotNull()), "inner")
    root = root.select(key, F.when(F.col("success") == F.lit(False), None).when(F.col("wrapped"), F.col("inner")).otherwise(F.col("root")).alias("root"))
    return root.where(F.col("root").isNotNull())


def _places(df: DataFrame, name: str) -> DataFrame:
    """Column `name`, a VARIANT of any shape, as array<struct<pos int, entry variant>> of its non-null entries."""
    df = _parsed(df, name)
    v = F.col(name)
    df = df.withColumns({"_list": F.try_variant_get(v, "$", LIST), "_items": F.try_variant_get(v, "$.items", LIST), "_map": F.try_variant_get(v, "$", MAP)})
    numbered = lambda xs: F.transform(xs, lambda e, i: F.struct(i.alias("pos"), e.alias("entry")))
    by_place = F.transform(F.map_entries("_map"), lambda e: F.struct(e["key"].try_cast("int").alias("pos"), e["value"].alias("entry")))
    shaped = (
        F.when(F.col("_list").isNotNull(), numbered(F.col("_list")))
        .when(F.col("_items").isNotNull(), numbered(F.col("_items")))
        .when(F.coalesce(F.size("_map"), F.lit(0)) <= 0, None)
        .when(F.forall(F.map_keys("_map"), lambda k: k.rlike(r"^\d{1,9}$")), by_place)
        .otherwise(F.array(F.struct(F.lit(0).alias("pos"), v.alias("entry"))))
    )
    given = F.filter(F.coalesce(shaped, F.expr(f"cast(array() as {PLACES})")), lambda e: e["entry"].isNotNull() & ~F.is_variant_null(e["entry"]))
    return df.withColumn(name, given).drop("_list", "_items", "_map")


def _entries(df: DataFrame, key: str, text: str, children: Sequence[Child]) -> DataFrame:
    """(key, one column of places for each child): the shared first half of every projection."""
    rows = records(df, key, text)
    parents = {c.path[:-1]: f"_in_{i}" for i, c in enumerate(children)}
    for path, at in parents.items():
        rows = rows.withColumn(at, F.col("root"))
        for name in path:
            rows = rows.withColumn(at, get(F.col(at), name))
    rows = rows.select(key, *(get(F.col(parents[c.path[:-1]]), c.path[-1]).alias(c.name) for c in children))
    for c in children:
        rows = _places(rows, c.name)
    return rows


def links(df: DataFrame, key: str = "result_id", text: str = "result", children: Sequence[Child] = CHILDREN) -> DataFrame:
    """(key, child, pos, child_ref): one row per non-null entry of each child; child_ref is '' where it is not given."""
    rows = _entries(df, key, text, children)

    def linked(c: Child) -> Column:
        ref = lambda e: F.coalesce(get(e["entry"], c.ref, "string"), F.lit(""))
        row = lambda e: F.struct(F.col(key).alias(key), F.lit(c.name).alias("child"), e["pos"].alias("pos"), ref(e).alias("child_ref"))
        return F.transform(c.name, row)

    return rows.select(F.inline(F.flatten(F.array(*map(linked, children))))).dropDuplicates([key, "child", "pos"])


def children_table(df: DataFrame, child: Child, key: str = "result_id", text: str = "result") -> DataFrame:
    """(key, pos, the child's fields): the flat table of one child."""
    rows = _entries(df, key, text, [child])
    cells = lambda e: F.struct(F.col(key).alias(key), e["pos"].alias("pos"), *(get(e["entry"], f, kind).alias(f) for f, kind in child.fields.items()))
    return rows.select(F.inline(F.transform(child.name, cells))).dropDuplicates([key, "pos"])


def grandchildren_table(df: DataFrame, child: Child, key: str = "result_id", text: str = "result") -> DataFrame:
    """(key, pos, nested_pos, value): the entries of the list `child.nested` inside each entry, as JSON text."""
    rows = _entries(df, key, text, [child])
    lists = lambda e: F.try_variant_get(get(e["entry"], child.nested), "$", LIST)
    inner = lambda e: F.transform(
        F.coalesce(lists(e), F.expr(f"cast(array() as {LIST})")),
        lambda x, i: F.struct(F.col(key).alias(key), e["pos"].alias("pos"), i.alias("nested_pos"), F.to_json(x).alias("value")),
    )
    return rows.select(F.inline(F.flatten(F.transform(child.name, inner)))).where("value is not null and value <> 'null'").dropDuplicates([key, "pos", "nested_pos"])


def results_table(df: DataFrame, key: str = "result_id", text: str = "result", children: Sequence[Child] = CHILDREN) -> DataFrame:
    """(key, children: one column each): the parent table, one row a result that can be read, with how many entries of each
    child lead back to it. Results received twice count once."""
    rows = _entries(df, key, text, children)
    return rows.select(key, *(F.greatest(F.size(c.name), F.lit(0)).alias(f"{c.name}s") for c in children)).dropDuplicates([key])
