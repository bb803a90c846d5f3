"""Gates that explain what they reject, and repair of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.strings import blank_to_null

FIELDS = ["modality", "actor", "action", "condition", "constraint", "exception"]
# Names that other extractors give to fields, and the classes of modality.
ALIASES = {"normative_type": "modality", "subject": "actor", "conditions": "condition"}
MODALITIES = ["obligation", "prohibition", "permission", "definition"]
# The keys of a whole response and of its clauses, and clause fields of models that have no place in ours.
RESPONSE = ["schema_version", "source_id", "source_text", "clauses"]
CLAUSE = ["clause_id", "source_id", "source_text", "clause_text", "clause_span_start", "clause_span_end", *FIELDS, "confidence"]
UNSUPPORTED = ["object", "original_text"]
# What stands for a secret, and what tells one: parts of keys, parts of values, keys of addresses, parameters.
REDACTED = "***REDACTED***"
SECRET_KEYS = ["key", "secret", "token"]
SECRET_VALUES = ["sk-", "bearer"]
URL_KEYS = ["base_url", "url", "endpoint", "api_url"]
SECRET_PARAMETERS = ["api_key", "apikey", "key", "token", "secret", "password", "access_token", "authorization", "auth"]


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails, in order; a check that is null does not fail."""
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))


def validate_spans(rows: DataFrame) -> DataFrame:
    """reasons for rows (source_id, source_text, span_text, span_start, span_end, confidence)."""
    c = F.col
    return rows.withColumn("reasons", reasons({
        "source_id_empty": F.coalesce(c("source_id"), F.lit("")) == "",
        "source_text_empty": F.coalesce(c("source_text"), F.lit("")) == "",
        "span_text_empty": F.coalesce(c("span_text"), F.lit("")) == "",
        "span_start_negative": c("span_start") < 0,
        "span_end_before_start": c("span_end") < c("span_start"),
        "span_end_beyond_text": c("span_end") > F.length("source_text"),
        "confidence_out_of_range": (c("confidence") < 0) | (c("confidence") > 1),
    }))


def key_gate(rows: DataFrame, json_col: str, allowed: list[str], required: list[str]) -> DataFrame:
    """unknown and missing keys of a JSON object; both null where the text is no object."""
    keys = F.json_object_keys(json_col)
    return rows.withColumn("unknown", F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed))))).withColumn("missing", F.array_except(F.array(*map(F.lit, required)), keys))


def json_kind(json_col: str, key: str) -> Column:
    """The type of a key's value in a JSON object, as Spark names it; null without the key."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_col), f"$.{key}", "variant"))


def valid_prediction(record: Column) -> Column:
    """True where a JSON record has the five keys of a prediction, schema_valid is the boolean true, and predicted is an
    object with all six fields; false for anything else, text that is not JSON and null too."""
    has = lambda json, names: F.size(F.array_except(F.array(*map(F.lit, names)), F.json_object_keys(json))) == 0
    top = has(record, ["sample_id", "source_id", "predicted", "runtime", "schema_valid"])
    flag = F.try_variant_get(F.try_parse_json(record), "$.schema_valid", "variant")
    valid = (F.schema_of_variant(flag) == "BOOLEAN") & (F.get_json_object(record, "$.schema_valid") == "true")
    return F.coalesce(top & valid & has(F.get_json_object(record, "$.predicted"), FIELDS), F.lit(False))


def align_responses(rows: DataFrame, json_col: str) -> DataFrame:
    """Whole responses (the keys of RESPONSE, clauses being a list) brought to our field names: status, reason, bad_clause,
    mappings and normalized.

    Gates in order, the first that fails being the reason: a key of RESPONSE missing (also text that is no JSON object, or
    that repeats a key within an object), another key, clauses that are no list or hold anything but objects; then of the
    first clause that fails, an unsupported field, an unknown one, another name beside its target, and a value under another
    name that is neither object nor null. bad_clause is the index of the clause or item at fault, null for the other gates.
    Values of FIELDS that are no objects become null. normalized is the response as JSON, null where status is error; status
    is accepted where mappings, the number of fields renamed, is above 0, else noop.
    """
    names = lambda xs: F.array(*map(F.lit, xs))
    beyond = lambda keys, known: F.size(F.array_except(keys, known)) > 0
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    is_null = lambda v: v.isNull() | F.is_variant_null(v)

    def clause_reason(c: Column) -> Column:
        keys = F.map_keys(c)
        both = [F.array_contains(keys, alias) & F.array_contains(keys, target) for alias, target in ALIASES.items()]
        odd = F.exists(F.map_entries(c), lambda e: e["key"].isin(list(ALIASES)) & ~is_object(e["value"]) & ~is_null(e["value"]))
        return F.when(F.arrays_overlap(keys, names(UNSUPPORTED)), "unsupported_model_field").when(beyond(keys, names([*CLAUSE, *ALIASES])), "unknown_clause_field").when(both[0] | both[1] | both[2], "alias_target_conflict").when(odd, "invalid_enum")

    def renamed(c: Column) -> Column:
        name = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), k), k)
        value = lambda k, v: F.when(~name(k).isin(FIELDS) | is_object(v), v)
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(name(e["key"]).alias("key"), value(e["key"], e["value"]).alias("value"))))

    whole = F.try_parse_json(json_col)
    out = rows.withColumn("_top", fields(whole)).withColumn("_items", F.try_variant_get(whole, "$.clauses", "array<variant>"))
    out = out.withColumn("_clauses", F.transform("_items", fields))
    no_object = F.array_position(F.transform("_clauses", lambda c: c.isNull()), F.lit(True))
    reasons_of = F.transform("_clauses", clause_reason)
    out = out.withColumn("_odd", no_object).withColumn("_reasons", F.when(no_object == 0, reasons_of))
    out = out.withColumn("_bad", F.array_position(F.transform("_reasons", lambda r: r.isNotNull()), F.lit(True)))
    keys = F.map_keys("_top")
    reason = F.when(keys.isNull() | beyond(names(RESPONSE), keys), "missing_required_top_level_key").when(beyond(keys, names(RESPONSE)), "unknown_top_level_field").when(F.col("_items").isNull() | (F.col("_odd") > 0), "invalid_clause_item").when(F.col("_bad") > 0, F.try_element_at("_reasons", F.col("_bad").cast("int")))
    at = F.when(F.col("reason") == "invalid_clause_item", F.nullif(F.col("_odd"), F.lit(0))).when(F.col("_bad") > 0, F.nullif(F.col("_bad"), F.lit(0)))
    out = out.withColumn("reason", reason).withColumn("bad_clause", F.when(~F.col("reason").isin("missing_required_top_level_key", "unknown_top_level_field"), (at - 1).cast("int")))
    good = F.col("reason").isNull()
    count = F.aggregate("_clauses", F.lit(0), lambda n, c: n + F.size(F.array_intersect(F.map_keys(c), names(ALIASES))))
    out = out.withColumn("mappings", F.when(good, count).otherwise(0))
    kept = [F.element_at("_top", k).alias(k) for k in RESPONSE[:3]]
    normalized = F.to_json(F.struct(*kept, F.transform("_clauses", renamed).alias("clauses")), {"ignoreNullFields": "false"})
    out = out.withColumn("normalized", F.when(good, normalized))
    return out.withColumn("status", F.when(~good, "error").when(F.col("mappings") > 0, "accepted").otherwise("noop")).drop("_top", "_items", "_clauses", "_odd", "_reasons", "_bad")


def align_flat(rows: DataFrame, json_col: str) -> DataFrame:
    """Outside extractions of one clause as a flat object, brought to our field names: status, reason (the first gate that fails), renamed and values.

    Gates in order: not a JSON object, no clause, an unknown key, a field under both of its names, a modality that is no class.
    A field under its other name counts as renamed; status is accepted where something was renamed, noop where nothing was,
    error where a gate fails. Whole responses are the work of align_responses.
    """
    keys = F.json_object_keys(json_col)
    known = [*FIELDS, *ALIASES]
    other = {v: k for k, v in ALIASES.items()}
    value = lambda f: blank_to_null(F.trim(F.coalesce(F.get_json_object(json_col, f"$.{f}"), F.get_json_object(json_col, f"$.{other[f]}")) if f in other else F.get_json_object(json_col, f"$.{f}")))
    rows = rows.withColumns({f"out_{f}": value(f) for f in FIELDS}).withColumn("renamed", F.size(F.array_intersect(keys, F.array(*map(F.lit, ALIASES)))))
    both = F.exists(F.array(*[F.array_contains(keys, a) & F.array_contains(keys, t) for a, t in ALIASES.items()]), lambda x: x)
    reason = F.when(keys.isNull(), "not_an_object").when(F.size(keys) == 0, "no_fields").when(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, "unknown_key").when(both, "alias_target_conflict").when(F.col("out_modality").isNotNull() & ~F.lower("out_modality").isin(MODALITIES), "invalid_modality")
    return rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "error").when(F.col("renamed") > 0, "accepted").otherwise("noop"))


def strip_fences(text: Column) -> Column:
    """Text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*[ \t]*\n", ""), r"\n?```$", ""))


def ingest_fields(rows: DataFrame, json_col: str, strict: bool = True) -> DataFrame:
    """Six fields of a JSON object: trimmed, blank as null, other types as text; schema_valid where all six keys stand
    and, when strict, modality is a class or null."""
    keys = F.json_object_keys(json_col)
    out = rows.withColumns({f: blank_to_null(F.trim(F.get_json_object(json_col, f"$.{f}"))) for f in FIELDS})
    valid = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, FIELDS)), keys)) == 0, F.lit(False))
    if strict:
        valid = valid & (F.col("modality").isNull() | F.col("modality").isin(MODALITIES))
    return out.withColumn("schema_valid", valid)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side alone has: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def snapshot_check(rows: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """(key, digest, bytes, same): whether the digest and size of each row equal those registered; false where none are."""
    known = registered.select(key, F.col("digest").alias("_d"), F.col("bytes").alias("_b"))
    same = F.coalesce((F.col("digest") == F.col("_d")) & (F.col("bytes") == F.col("_b")), F.lit(False))
    return rows.join(known, key, "left").select(key, "digest", "bytes", same.alias("same"))


def gold_gate(rows: DataFrame, id_col: str, status: Column, wanted: str, most: int) -> DataFrame:
    """One row: total, unreviewed (any status but the wanted one), duplicates (ids beyond the first of each), and passed, which
    asks for 1 to `most` rows, all reviewed, no id twice."""
    ids = rows.withColumn("_bad", F.coalesce(status != wanted, F.lit(True)).cast("long")).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"))
    one = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("bad"), F.lit(0)).alias("unreviewed"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return one.withColumn("passed", F.col("total").between(1, most) & (F.col("unreviewed") == 0) & (F.col("duplicates") == 0))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def repair_span(text: Column, span: Column, start: Column, stop: Column) -> Column:
    """(status, start, stop): kept where the slice is the span's text, moved where that stands once in the text, else
    not_found or ambiguous with the offsets as they were."""
    first = F.instr(text, span)
    rest = F.substring(text, first + 1, F.length(text))
    again = F.instr(rest, span)
    kept = (start >= 0) & (F.substring(text, F.greatest(start, F.lit(0)) + 1, F.greatest(stop - start, F.lit(0))) == span)
    status = F.when(kept, "kept").when(first == 0, "not_found").when(again > 0, "ambiguous").otherwise("repaired")
    moved = status == "repaired"
    return F.struct(status.alias("status"), F.when(moved, first - 1).otherwise(start).cast("int").alias("start"), F.when(moved, first - 1 + F.length(span)).otherwise(stop).cast("int").alias("stop"))


def redact_secret(value: Column, visible: int = 4) -> Column:
    """The first characters of a value before the mark, the mark alone where little more would be left, None for null."""
    return F.when(value.isNull(), "None").when(F.length(value) <= visible + 3, REDACTED).otherwise(F.concat(F.substring(value, 1, visible), F.lit("..." + REDACTED)))


def url_has_secret(url: Column) -> Column:
    """Whether an address names a user before its host, or a parameter that holds a secret."""
    named = F.regexp_like(F.lower(url), F.lit(f"[?&]({'|'.join(SECRET_PARAMETERS)})="))
    return F.regexp_like(url, F.lit("://[^/]*@")) | named


def redact_record(record: Column) -> Column:
    """A map of texts with the mark in place of values whose key or content tells a secret, and of addresses that hold one."""

    def value(k: Column, v: Column) -> Column:
        by_key = F.regexp_like(F.lower(k), F.lit("|".join(SECRET_KEYS)))
        by_value = F.regexp_like(F.lower(v), F.lit("|".join(SECRET_VALUES)))
        return F.when(by_key | by_value | (F.lower(k).isin(URL_KEYS) & url_has_secret(v)), REDACTED).otherwise(v)

    return F.transform_values(record, value)
