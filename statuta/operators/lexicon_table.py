"""Markers from a lexicon that is a table: its rows meet the texts by a hash join, so a plan is the same at ten markers or many thousands.

A text is cut into pieces that overlap by a marker's length. Each place of a piece is looked up by its next characters: by the heads
of markers, where one is by their stems, and where one is by whole markers, in the sizes that markers of this stem have. So a
place meets each marker that stands there and no other, however many markers begin alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators import lexicon as L
from statuta.plans.lineage import cut

#: Characters of a head and of a stem, places of a piece, and markers (and their characters) that are broadcast at most.
HEAD, STEM, PIECE, BROADCAST_MARKERS, BROADCAST_CHARS = 2, 6, 256, 1_000_000, 32_000_000

_WORD = r"^[\p{L}\p{N}_]$"


def from_literal(spark, lexicon: dict[str, list[str]] | None = None, version: str = "1") -> DataFrame:
    """A lexicon of lists as a table (version, category, klass, marker, no): the classes of modality are klass of category modality."""
    lexicon = lexicon or L.LEXICON
    rows = [(version, "modality" if k in L.CLASSES else k, k if k in L.CLASSES else None, m, i) for k, markers in lexicon.items() for i, m in enumerate(markers)]
    return spark.createDataFrame(rows, "version string, category string, klass string, marker string, no long")


def prepared(lexicon: DataFrame) -> DataFrame:
    """Distinct (version, category, klass, marker, no) with lower-cased markers; rows without a marker go.

    no is the place of a marker in its list, which settles ties; a table without it takes the markers in order.
    """
    no = F.col("no").cast("long") if "no" in lexicon.columns else F.lit(0).cast("long")
    rows = lexicon.select("version", "category", "klass", F.lower("marker").alias("marker"), no.alias("no")).where(F.coalesce(F.col("marker"), F.lit("")) != "")
    return rows.groupBy("version", "category", "klass", "marker").agg(F.min("no").alias("no"))


def _lookups(known: DataFrame, head: int) -> tuple[DataFrame, DataFrame]:
    """(head, ks) with the lengths of the stems that begin so, and (stem, sizes) with the sizes of the markers that begin so; both by hash."""
    k = F.least(F.length("marker"), F.lit(STEM))
    each = known.select(F.length("marker").alias("size"), k.alias("k"), F.xxhash64(F.substring("marker", 1, head)).alias("head"), F.xxhash64(k, F.substring("marker", F.lit(1), k)).alias("stem"))
    return each.groupBy("head").agg(F.collect_set("k").alias("ks")), each.groupBy("stem").agg(F.collect_set("size").alias("sizes"))


def hits(texts: DataFrame, lexicon: DataFrame, id_col: str = "rule_id", text_col: str = "text", match: str = "substring") -> DataFrame:
    """(id, version, category, klass, marker, no, start, stop): every place of every marker in each text, overlapping ones too.

    Markers and texts are compared in lower case; match="word" asks that no letter, digit or underscore adjoins the marker.
    Offsets count the characters of the lower-cased text from 0, stop is exclusive. The lexicon may have several versions;
    each hit names its own. Null and empty texts have no hits, repeated rows of texts have theirs each; other columns are
    ignored. The lexicon is broadcast while it is within BROADCAST_MARKERS and BROADCAST_CHARS, and shuffled beyond.
    """
    known = cut(prepared(lexicon))  # looked at by four branches
    met, held = _candidates(texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low")).where(F.length("low") > 0), known, match)
    return met.join(held(known), "marker").select(F.col("id").alias(id_col), "version", "category", "klass", "marker", "no", "start", "stop")


def _candidates(low: DataFrame, known: DataFrame, match: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(id, start, stop, marker) of what may be a marker in lower-cased texts, one row a place and size, and how the lexicon meets them."""
    size = F.length("marker")
    about = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("chars"), F.coalesce(F.max(size), F.lit(1)).alias("longest"), F.coalesce(F.min(size), F.lit(1)).alias("shortest")).first()
    held = F.broadcast if about.n <= BROADCAST_MARKERS and about.chars <= BROADCAST_CHARS else lambda rows: rows
    head = min(HEAD, about.shortest)
    heads, stems = _lookups(known, head)
    # a piece has PIECE places to begin at, a character before them and a longest marker and a character after
    begin = F.explode(F.sequence(F.lit(0), F.length("low") - 1, F.lit(PIECE)))
    pieces = low.select("id", "low", begin.alias("at")).select("id", "at", F.substring(F.concat(F.lit("\n"), "low"), F.col("at") + 1, F.lit(PIECE + about.longest + 2)).alias("piece"))
    ahead = lambda n: F.substring("piece", F.col("p") + 2, n)
    beside = lambda at: F.regexp_like(F.substring("piece", at, F.lit(1)), F.lit(_WORD))
    places = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.length("piece") - 1) - 1)
    met = pieces.select("id", "at", "piece", F.explode(places).alias("p"))
    if match == "word":
        met = met.where(~beside(F.col("p") + 1))
    met = met.withColumn("head", F.xxhash64(ahead(F.lit(head)))).join(F.broadcast(heads), "head").select("id", "at", "piece", "p", F.explode("ks").alias("k"))
    met = met.withColumn("stem", F.xxhash64("k", ahead(F.col("k")))).join(held(stems), "stem").select("id", "at", "piece", "p", F.explode("sizes").alias("size"))
    met = met.where(F.col("p") + F.col("size") < F.length("piece"))
    if match == "word":
        met = met.where(~beside(F.col("p") + 2 + F.col("size")))
    start = (F.col("at") + F.col("p")).cast("int")
    return met.select("id", start.alias("start"), (start + F.col("size")).cast("int").alias("stop"), ahead(F.col("size")).alias("marker")), held


def _priority(klass: Column) -> Column:
    return F.coalesce(*[F.when(klass == k, i) for i, k in enumerate(L.CLASSES)], F.lit(len(L.CLASSES)))


def modality(found: DataFrame, id_col: str = "rule_id") -> DataFrame:
    """(id, version, klass, marker, start, stop) of hits(): the first class by priority that hits, its longest marker first, then its list's order, at its first place."""
    order = F.struct(_priority(F.col("klass")).alias("prio"), (-F.length("marker")).alias("shorter"), "no", "marker", "start", "stop", "klass")
    best = found.where("category = 'modality'").groupBy(id_col, "version").agg(F.min(order).alias("m"))
    return best.select(id_col, "version", "m.klass", "m.marker", "m.start", "m.stop")


def first_of(found: DataFrame, category: str, id_col: str = "rule_id") -> DataFrame:
    """(id, version, marker, start, stop) of hits(): the marker of a category that stands first, the longest of those at one place."""
    best = found.where(F.col("category") == category).groupBy(id_col, "version").agg(F.min(F.struct("start", (-F.length("marker")).alias("shorter"), "marker", "stop")).alias("m"))
    return best.select(id_col, "version", "m.marker", "m.start", "m.stop")
