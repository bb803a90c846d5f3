"""Building a dataset of normative sentences from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions import strings as S
from statuta.plans.lineage import cut

# Patterns that mark a sentence as normative, the classes by priority, mentions of articles, and patterns of
# candidate fields.
NORMATIVE = ["shall", "must", "may", "should", "shall not", "must not", "may not", "is required", "is prohibited", "is permitted", "is obliged", "is entitled", "have the right", "have a right", "under no circumstances"]
MODALITY_PATTERNS = [
    ("prohibition", r"\b(shall not|must not|may not|is prohibited)\b|\bprohibit"),
    ("obligation", r"\b(shall|must|is required|is obliged)\b"),
    ("permission", r"\b(may|is permitted|is entitled|have the right|have a right)\b"),
    ("definition", r"\b(means|refers to|defined as|definition)\b"),
]
CITED = [r"(?i)Article\s+(\d+)", r"(?i)Art\.\s*(\d+)"]
ACTION = r"(?i)(?=shall|must|may|should)\b(?:shall|must|may|should)\s+(not\s+)?(?:be\s+)?(\w+(?:\s+\w+){0,8})"
SUBJECT = r"(?i)^((?:The|A|Each|Any)\s+\w+(?:\s+\w+)?)\s+(?:shall|must|may|should|is)"
CONDITION = r"(?i)(?:Where|If|When|In case of|Provided that|On condition that)\s+[^,.;]+(?:,|;|\.)"
CONSTRAINTS = [r"(?i)(?:within|before|after|at least|at most|no later than|not later than)\s+[^,.;]+", r"(?i)(?:in accordance with|subject to|without prejudice to)\s+[^,.;]+"]
EXCEPTION = r"(?i)(?:except|unless|with the exception of|apart from|other than|excluding)\s+[^.;]+"
ACTORS = r"(?:the\s+)?(?:controller|processor|data subject|supervisory authority|recipient|third party|natural person|legal person)"


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, sentence): texts cut after `.`, `!` or `?` before blanks and at line ends; stripped, none empty."""
    parts = F.split(F.regexp_replace(F.col(text_col), r"([.!?])\s+", "$1\n"), r"\n+")
    return docs.select(id_col, F.posexplode(parts).alias("pos", "sentence")).withColumn("sentence", F.trim(F.regexp_replace("sentence", r"^\s+|\s+$", ""))).where("sentence <> ''")


def dedup(rows: DataFrame, order: list[str], text_col: str = "sentence") -> DataFrame:
    """The first row, by order, of each text up to blanks. A partial aggregate meets the copies before they are shuffled."""
    normal = F.regexp_replace(F.col(text_col), r"\s+", " ")
    first = rows.groupBy(F.xxhash64(normal).alias("h"), normal.alias("normal")).agg(F.min(F.struct(*order, text_col)).alias("r"))
    return first.select("r.*")


def is_normative(text: Column, markers: list[str] | None = None) -> Column:
    return F.regexp_like(text, F.lit(S.unicode_pattern(r"(?i)\b(" + "|".join(markers or NORMATIVE) + r")\b")))


def is_good_length(text: Column, low: int = 60, high: int = 600) -> Column:
    return F.length(text).between(low, high)


def group_key(text: Column) -> Column:
    """'Article N' of the first mention of an article, else null."""
    n = F.coalesce(*[F.nullif(F.regexp_extract(text, S.unicode_pattern(p), 1), F.lit("")) for p in CITED])
    return F.concat(F.lit("Article "), n)


def regex_modality(text: Column) -> Column:
    """Class by the first pattern that hits, by priority; obligation by default."""
    def of(low: Column) -> Column:
        out = F.lit("obligation")
        for name, pattern in reversed(MODALITY_PATTERNS):
            # without edges first, since most texts lack the words, and edges are costly to look for at every place
            held = F.regexp_like(low, F.lit(pattern.replace(r"\b", ""))) & F.regexp_like(low, F.lit(S.unicode_pattern(pattern)))
            out = F.when(held, name).otherwise(out)
        return out

    return S.let(F.lower(text), of)


def diverse_sample(rows: DataFrame, group: str, order: list[str], target: int, per_group: int = 3) -> DataFrame:
    """Up to target rows: first per_group of each group in order, groups by name and null last, then the rest in order.

    order must tell rows apart. The tasks keep no more than per_group rows of a group before they meet, so a group of very
    many rows, as that of null may be, gathers nowhere. The rest comes from the first 2 * target rows of all: if fewer than
    target rows are chosen first, these hold target others, or there are no more, and the rank of each within its group is
    told by them alone.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    chosen = rows.withColumn("rn", rank).where(F.col("rn") <= per_group).orderBy(F.col(group).asc_nulls_last(), "rn").limit(target).withColumn("pass", F.lit(1))
    rest = rows.orderBy(*order).limit(2 * target).withColumn("rn", rank).where(F.col("rn") > per_group).orderBy(*order).limit(target).withColumn("pass", F.lit(2))
    both = chosen.unionByName(rest)
    place = Window.orderBy("pass", F.when(F.col("pass") == 1, F.col(group)).asc_nulls_last(), F.when(F.col("pass") == 1, F.col("rn")), *order)
    return both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= target)


def assign_ids(rows: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """Ids prefix_001 and so on in order, without one task for all rows: ranges in order, counts ahead, place within."""
    # the parts are written, so that counts and numbers see the same ones
    dealt = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ahead = dealt.groupBy("part").count()
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    no = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("ahead")
    return dealt.join(F.broadcast(ahead.select("part", "ahead")), "part").withColumn("id", F.concat(F.lit(f"{prefix}_"), F.format_string("%03d", no))).drop("part", "ahead")


def _first(text: Column, patterns: list[str], marks: str) -> Column:
    found = [F.nullif(S.strip(F.rtrim(F.regexp_extract(text, S.unicode_pattern(p), 0), F.lit(marks))), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def weak_annotate(text: Column) -> dict[str, Column]:
    """Candidate fields of a sentence by patterns: actor, action, condition, constraint and exception, null where none.

    Words, blanks and edges are those of any script. A subject ends where the modal verb stands as a word; it is not cut at the
    first place where the verb's letters stand in another word.
    """
    extract = lambda pattern, group: F.regexp_extract(text, S.unicode_pattern(pattern), group)
    return {
        "modality": regex_modality(text),
        "actor": F.coalesce(_first(text, [f"(?i){ACTORS}"], ""), F.nullif(S.strip(extract(SUBJECT, 1)), F.lit(""))),
        "action": F.nullif(S.strip(F.concat(extract(ACTION, 1), extract(ACTION, 2))), F.lit("")),
        "condition": _first(text, [CONDITION], ",;."),
        "constraint": _first(text, CONSTRAINTS, ""),
        "exception": _first(text, [EXCEPTION], ";."),
    }
