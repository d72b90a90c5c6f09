"""Comparison of two result sets as trees, driven by the expected one.

Every row is a tree: structs and maps are objects, arrays have a length, all
else is a leaf.  A node is compared once, by (key, path).  A mismatch at a node
speaks for all below it: a missing or null subtree, an array of another length
or a value of another kind is one row, and nothing beneath is reported.

Paths are ``a.b[0].c``; a row that the actual side lacks is ``<root>``, an array
of another length ``path.length``.  Field names hold no dot or bracket.  Two
values that are no numbers are equal as numbers; times and binaries compare as
text.  What only the actual side has is ignored.  Keys are unique on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import kept

ROOT = "<root>"
NODE = "struct<path:string,kind:string,text:string,number:double>"


def _node(path: Column, kind: Column | str, text: Column | None = None, number: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(path.alias("path"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if text is None else text).cast("string").alias("text"), (none if number is None else number).cast("double").alias("number"))


def _nodes(path: Column, value: Column, kind: T.DataType) -> Column:
    """The value's node and all below it."""
    below = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), name)
    if isinstance(kind, T.StructType):
        own = F.concat(F.array(_node(path, "object")), *[_nodes(below(F.lit(f.name)), value[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: _nodes(below(e["key"].cast("string")), e["value"], kind.valueType))
        own = F.concat(F.array(_node(path, "object")), F.flatten(each))
    elif isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: _nodes(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, kind.elementType))
        own = F.concat(F.array(_node(path, "array", number=F.size(value))), F.flatten(each))
    elif isinstance(kind, T.NumericType):
        own = F.array(_node(path, "number", number=value))
    else:
        own = F.array(_node(path, "boolean" if isinstance(kind, T.BooleanType) else "string", value))
    return F.when(value.isNull(), F.array(_node(path, "null"))).otherwise(own).cast(f"array<{NODE}>")


def melt(df: DataFrame, key: str) -> DataFrame:
    """``key, path, kind, text, number``: one row per node; the root's path is empty."""
    parts = [_nodes(F.lit(f.name), F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name != key]
    root = F.array(_node(F.lit(""), "object")).cast(f"array<{NODE}>")
    return df.select(key, F.explode(F.concat(root, *parts)).alias("x")).select(key, "x.*")


def _above(path: Column) -> Column:
    """The paths of all nodes above, the root's first."""
    steps = F.regexp_extract_all(path, F.lit(r"(\.?[^.\[]+|\[\d+\])"), F.lit(1))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "")))


def any_index(path: Column) -> Column:
    """The path with ``[]`` for every index."""
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def diff_results(expected: DataFrame, actual: DataFrame, key: str, allow: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """``key, path, problem, expected, actual`` of every topmost mismatch.

    Problems: missing, null, type, length, number (beyond ``tolerance`` of the larger
    size, of one at least), string.  ``allow`` lists (key, path) that may differ, with
    all beneath; it names indices as ``[]`` only, for any of them.
    """
    # a small file of rows becomes many nodes, so the rows are dealt out before
    e, a = melt(kept.dealt(expected, key), key), melt(kept.dealt(actual, key), key)
    both = e.select(key, "path", F.struct("kind", "text", "number").alias("e")).join(a.select(key, "path", F.struct("kind", "text", "number").alias("a")), [key, "path"], "left")
    x, y = F.col("e"), F.col("a")
    far = F.abs(x["number"] - y["number"]) / F.greatest(F.lit(1.0), F.abs(x["number"]), F.abs(y["number"])) > tolerance
    same = x["number"] == y["number"]  # also two infinities, or two that are no numbers
    problem = (
        F.when(y.isNull(), "missing").when((x["kind"] == "null") != (y["kind"] == "null"), "null").when(x["kind"] != y["kind"], "type")
        .when((x["kind"] == "array") & ~same, "length").when((x["kind"] == "number") & ~same & far, "number").when(x["kind"].isin("string", "boolean") & (x["text"] != y["text"]), "string")
    )
    found = both.withColumn("problem", problem).where("problem is not null")
    covered = found.select(key, "path", F.explode(_above(F.col("path"))).alias("__above")).join(found.select(F.col(key).alias("__k"), F.col("path").alias("__p")), (F.col(key) == F.col("__k")) & (F.col("__above") == F.col("__p")), "left_semi")
    found = found.join(covered.select(key, "path"), [key, "path"], "left_anti")
    if allow is not None:
        own = F.explode(F.transform(F.concat(_above(F.col("path")), F.array("path")), any_index)).alias("__above")
        allowed = found.select(key, "path", own).join(allow.select(F.col(key).alias("__k"), F.col("path").alias("__p")), (F.col(key) == F.col("__k")) & (F.col("__above") == F.col("__p")), "left_semi")
        found = found.join(allowed.select(key, "path"), [key, "path"], "left_anti")
    shown = lambda v: F.coalesce(v["text"], F.when(v["kind"].isin("number", "array"), v["number"].cast("string")), v["kind"])
    path = F.when(F.col("path") == "", ROOT).when(F.col("problem") == "length", F.concat("path", F.lit(".length"))).otherwise(F.col("path"))
    return found.select(key, path.alias("path"), "problem", shown(x).alias("expected"), shown(y).alias("actual"))
