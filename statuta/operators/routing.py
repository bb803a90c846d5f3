"""Fallback routing, request tables and fill-only merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators.gates import repair_span

FIELDS = ["modality", "actor", "action", "condition", "constraint", "exception"]


def clause_reasons(field_low: float = 0.5, clause_low: float = 0.5) -> Column:
    """Why a normative clause needs another extractor, from its fields, <field>_confidence and confidence."""
    c = F.col
    low = F.array_max(F.array(*[F.coalesce(c(f).isNotNull() & (c(f"{f}_confidence") < field_low), F.lit(False)) for f in FIELDS]))
    each = F.array_compact(F.array(F.when(c("actor").isNull(), "MISSING_ACTOR"), F.when(c("action").isNull(), "MISSING_ACTION"), F.when(low, "LOW_FIELD_CONFIDENCE"), F.when(c("confidence") < clause_low, "LOW_CLAUSE_CONFIDENCE")))
    return F.when(c("modality").isNull(), F.array().cast("array<string>")).otherwise(each)


def fallback_trigger(clauses: DataFrame) -> DataFrame:
    """Per source: whether any clause asks for fallback and the reasons in clause order, doubles kept.

    clauses has source_id, seg_idx, schema_valid and what clause_reasons reads; one invalid clause decides alone.
    """
    per = clauses.withColumn("r", clause_reasons()).groupBy("source_id").agg(F.min("schema_valid").alias("valid"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "r"))), lambda x: x["r"])).alias("r"))
    found = F.when(~F.col("valid"), F.array(F.lit("SCHEMA_VALIDATION_FAILURE"))).when(F.size("r") == 0, F.array(F.lit("NO_FALLBACK_NEEDED"))).otherwise(F.col("r"))
    return per.select("source_id", (~F.col("valid") | (F.size("r") > 0)).alias("triggered"), found.alias("reasons"))


def optional_trigger(sources: DataFrame, triggers: DataFrame, forced: Column) -> DataFrame:
    """Per source: FORCED, then EMPTY_CLAUSES for one without clauses, then the trigger's reasons."""
    both = sources.withColumn("forced", forced).join(triggers, "source_id", "left")
    reason = F.when(F.col("forced"), F.array(F.lit("FORCED"))).when(F.col("reasons").isNull(), F.array(F.lit("EMPTY_CLAUSES"))).otherwise(F.col("reasons"))
    return both.select("source_id", (F.col("forced") | F.coalesce("triggered", F.lit(True))).alias("triggered"), reason.alias("reasons"))


def hybrid(rule: DataFrame, external: DataFrame, strict: bool) -> DataFrame:
    """Rule result or external one by source, with a status.

    rule: source_id, triggered, result. external: source_id, ext_result (null: none), ext_error, ext_valid. Strict asks
    for a valid external result where triggered, else it is an error without result; otherwise any trouble with it
    keeps the rule's result.
    """
    both = rule.join(external, "source_id", "left")
    c = F.col
    status = F.when(~c("triggered"), "not_needed").when(c("ext_error").isNotNull(), "external_error").when(c("ext_result").isNull(), "no_external").when(~F.coalesce(c("ext_valid"), F.lit(False)), "external_invalid").otherwise("used")
    both = both.withColumn("status", status)
    result = F.when(c("status") == "used", c("ext_result")).when(c("status") == "not_needed", c("result"))
    return both.withColumn("final", result if strict else F.coalesce(result, c("result")))


def checked_external(clauses: DataFrame, key: str) -> DataFrame:
    """External clauses (with the reasons that validate_spans finds) as hybrid takes them by key: valid where there is no reason
    and the span stands in the text or is moved to the one place where it does; the result is the span so repaired."""
    c = F.col
    found = clauses.withColumn("r", repair_span(c("source_text"), c("span_text"), c("span_start"), c("span_end")))
    told = F.concat_ws(":", "r.start", "r.stop", "span_text")
    valid = (F.size("reasons") == 0) & c("r.status").isin("kept", "repaired")
    return found.select(F.col(key).alias("source_id"), told.alias("ext_result"), F.lit(None).cast("string").alias("ext_error"), valid.alias("ext_valid"))


# What a conservative choice ends with.
DISABLED, CONFIG_MISSING, NOT_TRIGGERED = "fallback_disabled", "fallback_config_missing", "fallback_not_triggered"
NETWORK_ERROR, SCHEMA_INVALID, SCHEMA_VALID, MOCK_USED = "fallback_network_error_redacted", "fallback_schema_invalid", "fallback_schema_valid", "fallback_mock_used"


def conservative(rule: DataFrame, external: DataFrame) -> DataFrame:
    """The external result where all is well with it, else the rule's, with one of the fixed statuses and `used`.

    rule: source_id, result, triggered, enabled, client (null: none is set up, mock: one that stands in). external:
    source_id, ext_result, ext_error, ext_valid; a source without a row has no valid answer. Spans are not repaired.
    """
    c = F.col
    both = rule.join(external, "source_id", "left")
    good = F.coalesce(c("ext_valid"), F.lit(False)) & c("ext_result").isNotNull()
    status = F.when(~c("enabled"), DISABLED).when(c("client").isNull(), CONFIG_MISSING).when(~c("triggered"), NOT_TRIGGERED).when(c("ext_error").isNotNull(), NETWORK_ERROR).when(~good, SCHEMA_INVALID).when(c("client") == "mock", MOCK_USED).otherwise(SCHEMA_VALID)
    both = both.withColumn("status", status).withColumn("used", c("status").isin(SCHEMA_VALID, MOCK_USED))
    return both.withColumn("final", F.when(c("used"), c("ext_result")).otherwise(c("result")))


def missing_fields(fields: list[str] = FIELDS) -> Column:
    """Names of fields that are null or empty, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", f) for f in fields]))


def fill_merge(rule: DataFrame, external: DataFrame, key: str, fields: list[str] = FIELDS) -> DataFrame:
    """External values only where the rule's are null or empty."""
    ext = external.select(key, *[F.col(f).alias(f"ext_{f}") for f in fields])
    both = rule.join(ext, key, "left")
    return both.select(key, *[F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"ext_{f}")).alias(f) for f in fields])


def request_budget(rows: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The first rows in order, numbered: what a budget of requests covers. A limit comes first, so few rows are numbered."""
    return rows.orderBy(*order).limit(budget).withColumn("no", F.row_number().over(Window.orderBy(*order)))


def request_table(rows: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, system, user, skeleton) of rows with fields missing."""
    need = rows.withColumn("missing", missing_fields()).where(F.size("missing") > 0)
    user = F.concat(F.lit("Sentence: "), F.col(text_col), F.lit("\nMissing: "), F.array_join("missing", ", "))
    skeleton = F.concat(F.lit("{"), F.array_join(F.transform("missing", lambda f: F.concat(F.lit('"'), f, F.lit('": null'))), ", "), F.lit("}"))
    return need.select(key, F.lit("Fill the missing fields from the sentence; answer with JSON alone.").alias("system"), user.alias("user"), skeleton.alias("skeleton"))


def field_coverage(long: DataFrame) -> DataFrame:
    """Per run and field how many values are not empty, of how many."""
    return long.groupBy("run", "field").agg(F.count_if(F.coalesce(F.col("pred"), F.lit("")) != "").alias("filled"), F.count(F.lit(1)).alias("total"))


def value_distribution(long: DataFrame, field: str) -> DataFrame:
    """Per run how often each value of a field is predicted; an empty one counts as none."""
    said = F.coalesce(F.nullif(F.trim("pred"), F.lit("")), F.lit("none"))
    return long.where(F.col("field") == field).groupBy("run", said.alias("value")).agg(F.count(F.lit(1)).alias("n"))
