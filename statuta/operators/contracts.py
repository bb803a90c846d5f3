"""Contracts as documents: what a set of artifacts must hold, checked with one pass over each artifact.

A document names artifacts, each with a path and a format, and checks on them:

    {"contract_id": "...", "artifacts": {"documents": {"path": "documents.parquet", "format": "parquet", "checks": {
        "rows": {"rows": {"min": 1}}, "langs": {"value": "count(distinct lang)", "equals": 4},
        "saved": {"field": "execution.saved", "equals": false}, "calls": {"field": "calls", "at_most_field": "max_calls"},
        "sizes": {"assert": "bool_and(n_chars = length(text))"}}}}}

A check counts rows, has the value of an aggregate, reads a field of a JSON object or asserts a truth. What is expected is
equals, min, max or, for fields, at_most_field. Null passes, since nothing is known then, but a missing artifact fails.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.gates import exists

RESULT = "contract string, artifact string, check string, actual string, expected string, status string"


def _expected(check: dict) -> str:
    told = check["rows"] if isinstance(check.get("rows"), dict) else {"equals": check["rows"]} if "rows" in check else {"equals": True} if "assert" in check else check
    return json.dumps({k: told[k] for k in ("equals", "min", "max", "at_most_field") if k in told}, sort_keys=True)


def _actual(check: dict) -> Column:
    """The aggregate over an artifact's rows that a check looks at, as a VARIANT's text or a SQL value."""
    if "rows" in check:
        return F.count(F.lit(1))
    if "field" in check:
        return F.max(_field(check["field"]))
    return F.expr(check.get("value") or check["assert"])


def _field(path: str) -> Column:
    """A field of a JSON object by its path, whatever its type: a VARIANT is read, so numbers, truths and texts keep theirs."""
    return F.try_variant_get(F.try_parse_json("value"), f"$.{path}", "string")


def _passes(check: dict, found: Column, other: Column) -> Column:
    told = json.loads(_expected(check))
    number = found.try_cast("double")
    parts = []
    for name, wanted in told.items():
        if name == "equals":
            plain = isinstance(wanted, int | float) and not isinstance(wanted, bool)
            parts.append(number == float(wanted) if plain else found == (json.dumps(wanted) if isinstance(wanted, bool) else str(wanted)))
        elif name == "at_most_field":
            parts.append(number <= other.try_cast("double"))
        else:
            parts.append(number >= float(wanted) if name == "min" else number <= float(wanted))
    ok = F.lit(True)
    for part in parts:
        ok = ok & F.coalesce(part, F.lit(True))
    return ok


def _judged(contract: str, name: str, rows: DataFrame, checks: dict) -> DataFrame:
    """One pass over an artifact for all of its checks. Where they only count rows, Spark reads no column."""
    columns = []
    for i, check in enumerate(checks.values()):
        other = F.max(_field(check["at_most_field"])) if "at_most_field" in check else F.lit(None)
        columns += [_actual(check).cast("string").alias(f"a{i}"), other.cast("string").alias(f"b{i}")]
    each = [F.struct(F.lit(said).alias("check"), F.col(f"a{i}").alias("actual"), F.lit(_expected(check)).alias("expected"), F.when(_passes(check, F.col(f"a{i}"), F.col(f"b{i}")), "pass").otherwise("fail").alias("status")) for i, (said, check) in enumerate(checks.items())]
    one = rows.agg(*columns).select(F.explode(F.array(*each)).alias("x"))
    return one.select(F.lit(contract).alias("contract"), F.lit(name).alias("artifact"), "x.*")


def run(spark: SparkSession, document: str | dict, root: str) -> DataFrame:
    """(contract, artifact, check, actual, expected, status) of a contract: a row `exists` for each artifact and one for each check.

    Paths are below root, but for those that name a store or begin with a slash. An artifact that is missing fails `exists`
    and each of its checks, actual being null. A JSON artifact is one object a file, read whole; tables are read by their
    format. Checks of an artifact share one scan, and artifacts are read side by side as branches of one query.
    """
    about = json.loads(document) if isinstance(document, str) else document
    out = None
    for name, said in about["artifacts"].items():
        path = said["path"] if re.match(r"/|\w+:/", said["path"]) else f"{root}/{said['path']}"
        form, checks = said.get("format", "parquet"), said.get("checks", {})
        there = exists(spark, path)
        rows = [(about["contract_id"], name, "exists", str(there).lower(), '{"equals": true}', "pass" if there else "fail")]
        if not there:
            rows += [(about["contract_id"], name, c, None, _expected(check), "fail") for c, check in checks.items()]
        part = spark.createDataFrame(rows, RESULT)
        if there and checks:
            table = spark.read.text(path, wholetext=True) if form == "json" else spark.read.format(form).load(path)
            part = part.unionByName(_judged(about["contract_id"], name, table, checks))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)


def verdict(report: DataFrame) -> DataFrame:
    """(contract, passed, failed): whether every check of a contract passes, and how many do not."""
    return report.groupBy("contract").agg(F.bool_and(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") != "pass").alias("failed"))
