"""Constraints on columns declared as data: rows of a table, or a document of fields, become one aggregate over the rows they judge.

A constraint is (path, kind, value): path names a column, a field within structs by dots, or what an array holds by [];
kind is one of KINDS; value is its operand as JSON. Nulls break `required` alone, as an absent field would.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONSTRAINT = "path string, kind string, value string"


def _of_type(x: Column, name: str, actual: T.DataType) -> Column:
    """Whether a column's type is the one declared; one of strings may also hold what can be read as it."""
    fits = {"string": T.StringType, "integer": T.IntegralType, "number": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "object": T.StructType}
    if isinstance(actual, T.StringType) and name in ("integer", "number", "boolean"):
        return x.try_cast({"integer": "bigint", "number": "double", "boolean": "boolean"}[name]).isNotNull()
    return F.lit(isinstance(actual, fits[name]) or name == "number" and isinstance(actual, T.NumericType))


#: Whether a value that is there fits, by kind.
KINDS: dict[str, Callable[[Column, object, T.DataType], Column]] = {
    "type": lambda x, v, t: _of_type(x, v, t),
    "enum": lambda x, v, t: x.isin(*[o for o in v if o is not None]) if any(o is not None for o in v) else F.lit(False),
    "const": lambda x, v, t: x == F.lit(v),
    "pattern": lambda x, v, t: F.regexp_like(x, F.lit(v)),
    "minLength": lambda x, v, t: F.length(x) >= v,
    "maxLength": lambda x, v, t: F.length(x) <= v,
    "minimum": lambda x, v, t: x >= F.lit(v),
    "maximum": lambda x, v, t: x <= F.lit(v),
    "minItems": lambda x, v, t: F.size(x) >= v,
    "maxItems": lambda x, v, t: F.size(x) <= v,
    "uniqueItems": lambda x, v, t: F.size(F.array_distinct(x)) == F.size(x) if v else F.lit(True),
}


def declared(document: str | dict, section: str | None = None) -> list[tuple[str, str, str]]:
    """The constraints of a document: {"fields": {name: {required, enum, pattern, minLength, items, fields, ...}}}, of a section if it has several.

    What a field says that is no constraint (descriptions, notes) is passed over.
    """
    about = json.loads(document) if isinstance(document, str) else document
    return list(_fields((about[section] if section else about)["fields"], ""))


def _fields(fields: dict, prefix: str) -> Iterator[tuple[str, str, str]]:
    for name, said in fields.items():
        yield from _field(f"{prefix}{name}", said)


def _field(path: str, said: dict) -> Iterator[tuple[str, str, str]]:
    for kind, value in said.items():
        if kind == "required" and value or kind in KINDS:
            yield path, kind, json.dumps(value)
    yield from _fields(said.get("fields", {}), f"{path}.")
    if "items" in said:
        yield from _field(f"{path}[]", said["items"])


def name_of(path: str, kind: str, value: str) -> str:
    """How reports name a constraint; of one kind on one path there may be several, told apart by value."""
    return f"{path} {kind}" if kind in ("required", "enum", "type", "uniqueItems") else f"{path} {kind} {json.loads(value)}"


def broken(schema: T.StructType, path: str, kind: str, value: str) -> Column:
    """Whether a row breaks a constraint; never null. A path that the schema does not have breaks `required` in every row and nothing else."""
    operand = json.loads(value) if value is not None else None
    if kind != "required" and kind not in KINDS:
        raise ValueError(f"no such kind of constraint: {kind}")

    def judged(x: Column, at: T.DataType, steps: list[str]) -> Column:
        if not steps:
            bad = x.isNull() if kind == "required" else x.isNotNull() & ~F.coalesce(KINDS[kind](x, operand, at), F.lit(False))
            return F.coalesce(bad, F.lit(False))
        step, rest = steps[0], steps[1:]
        if step == "[]":
            if not isinstance(at, T.ArrayType):
                return F.lit(kind == "required")
            return F.coalesce(F.exists(x, lambda e: judged(e, at.elementType, rest)), F.lit(False))
        if not isinstance(at, T.StructType) or step not in at.names:
            return F.lit(kind == "required")
        return judged(x[step], at[step].dataType, rest)

    steps = re.findall(r"\[\]|[^.\[\]]+", path)
    if not steps or steps[0] not in schema.names:
        return F.lit(kind == "required")
    return judged(F.col(f"`{steps[0]}`"), schema[steps[0]].dataType, steps[1:])


def _flags(rows: DataFrame, constraints: DataFrame | list) -> tuple[DataFrame, list[str]]:
    """rows with one column, an array of booleans by constraint, and the constraints' names in order."""
    said = sorted({tuple(c) for c in (constraints.select("path", "kind", "value").collect() if isinstance(constraints, DataFrame) else constraints)}, key=lambda c: [x or "" for x in c])
    names = [name_of(*c) for c in said]
    return rows.withColumn("_broken", F.array(*[broken(rows.schema, *c) for c in said]).cast("array<boolean>")), names


def report(rows: DataFrame, constraints: DataFrame | list, key: str) -> DataFrame:
    """(check, rows, violations, first): for each constraint how many rows break it, and the smallest key of these.

    constraints is a table (path, kind, value) or a list of such; it describes columns, so it is small and read by the
    driver. All constraints are judged in one pass, by one aggregate that is summed in the tasks first. An empty table has
    no violations; without constraints the report is empty.
    """
    flagged, names = _flags(rows, constraints)
    one = flagged.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count_if(F.col("_broken")[i]).alias("violations"), F.min(F.when(F.col("_broken")[i], F.col(f"`{key}`"))).alias("first")).alias(f"_{i}") for i in range(len(names))])
    if not names:
        return one.select(F.lit("").alias("check"), "rows", F.lit(0).cast("long").alias("violations"), F.lit(None).cast(rows.schema[key].dataType).alias("first")).where(F.lit(False))
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_{i}.violations").alias("violations"), F.col(f"_{i}.first").alias("first")) for i, n in enumerate(names)])
    return one.select("rows", F.explode(each).alias("x")).select("x.check", "rows", "x.violations", "x.first")


def violations(rows: DataFrame, constraints: DataFrame | list, key: str, most: int = 10) -> DataFrame:
    """(check, key, no): for each constraint the first `most` rows that break it, by key. The tasks keep no more of each than that before they meet."""
    flagged, names = _flags(rows, constraints)
    named = F.filter(F.transform("_broken", lambda b, i: F.when(b, F.get(F.array(*map(F.lit, names)).cast("array<string>"), i))), lambda x: x.isNotNull())
    each = flagged.select(F.col(f"`{key}`").alias(key), F.explode(named).alias("check"))
    return each.select("check", key, F.row_number().over(Window.partitionBy("check").orderBy(key)).alias("no")).where(F.col("no") <= most)


def rejected(rows: DataFrame, constraints: DataFrame | list) -> DataFrame:
    """rows with reasons, the names of the constraints that each breaks, in order; empty where it breaks none."""
    flagged, names = _flags(rows, constraints)
    return flagged.withColumn("reasons", F.array_compact(F.transform("_broken", lambda b, i: F.when(b, F.get(F.array(*map(F.lit, names)).cast("array<string>"), i))))).drop("_broken")
