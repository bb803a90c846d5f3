"""Secret scans: spans of credentials in texts, in DataFrame functions alone.

Patterns with fixed meanings (assignments, access identifiers, long hexadecimal runs) are reported as they stand. Weak
parts (a plain identifier assignment, an opaque token, an endpoint, a secret assignment that is short or has another
name) are reported only when complementary parts of one credential co-occur: within the same paragraph, disjoint and
within a distance of each other, an identifier with a secret, or an endpoint with both; a short secret with an
identifier or an endpoint. Parts carry intervals of code points and are linked by an interval join: each part's stop meets the
starts in its own and the next cell of `reach` code points, so a part meets only what lies within reach of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm import bitmaps, store

# Kinds in the order in which ties are listed, with the pattern, the group whose length counts and the
# length it needs.
KINDS: list[tuple[str, str, int, int]] = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("ident", r"""(?i:client_?id|access_?key_?id|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 0, 5),
    ("opaque", r"[A-Za-z0-9+/]{32,}", 0, 32),
    ("endpoint", r"https?://[A-Za-z0-9.:/_-]+", 0, 10),
    ("short", r"""(?i:passwords?|passwd|passphrase|passcode|pass|pwd|secret(?:_?key)?|token|api_?key|access_?key|private_?key|auth(?:orization)?|credentials?)["']?\x20*[:=]\x20*["']?[^\s"'<>,;]{3,}""", 0, 5),
]
BREAK = r"\n[\x20\t\r]*\n"
BASE = 3
#: Of each kind, letters of which every match holds some, in lower case: a search for them costs far less than the pattern.
HOLDS = {
    "assign": ("pass", "secret", "token", "key"),
    "access": ("akia",),
    "ident": ("client", "key", "account", "user", "login"),
    "endpoint": ("://",),
    "short": ("pass", "pwd", "secret", "token", "key", "auth", "credential"),
    "break": ("\n",),
}
#: Noncharacters set around matches, and the one that stands for them where a text has them itself.
OPEN, CLOSE, OTHER = "\ufdd0", "\ufdd1", "\ufdd2"
FOUND = "array<struct<kind:int,no:int,gap:int,size:int,part:int>>"
# The parts of one credential that complement each other.
ROLES = {"id": ("access", "ident"), "secret": ("assign", "hex", "opaque", "short"), "place": ("endpoint",)}


def is_kind(column: Column, *names: str) -> Column:
    return column.isin([i for i, x in enumerate(KINDS) if x[0] in names])


def readable(text: Column) -> Column:
    """The text with other noncharacters in the place of those that mark matches, so that places stay; a null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)


def matches(text: Column, lower: Column, kind: int, pattern: str, group: int, holds: tuple[str, ...]) -> Column:
    """Matches of a pattern in a readable text: array of (kind, no, gap, size, part), the code points since the match before,
    of the match, and of the group. The pattern runs once, and never over a text without the letters that its matches hold."""
    marked = F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}" + (f"${group}{CLOSE}" if group else ""))
    if holds:
        marked = F.when(reduce(Column.__or__, (lower.contains(x) for x in holds)), marked).otherwise(F.lit(""))

    def of_pieces(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            size = F.length(F.substring_index(x, CLOSE, 1))
            part = F.length(F.substring_index(F.substring_index(x, CLOSE, 2), CLOSE, -1)) if group else size
            gap = F.length(F.substring_index(F.element_at(p, i + 1), CLOSE, -1))
            return F.struct(F.lit(kind).alias("kind"), i.alias("no"), gap.alias("gap"), size.alias("size"), part.alias("part"))

        return F.when(F.size(p) > 1, F.transform(F.slice(p, F.lit(2), F.size(p) - 1), one)).otherwise(F.array().cast(FOUND))

    return F.transform(F.array(F.split(marked, OPEN, -1)), of_pieces)[0]


def found_in(text: Column, lower: Column) -> Column:
    """Matches of all kinds of a readable text, given in lower case too, and its breaks if it has any: array of (kind, no,
    gap, size, part)."""
    some = F.concat(*(matches(text, lower, k, pattern, group, HOLDS.get(name, ())) for k, (name, pattern, group, _) in enumerate(KINDS)))
    breaks = matches(text, lower, len(KINDS), BREAK, 0, HOLDS["break"])
    return F.transform(F.array(some), lambda x: F.when(F.size(x) > 0, F.concat(x, breaks)).otherwise(x))[0]


def parts(docs: DataFrame, keys: list[str], text_col: str, reach: int) -> DataFrame:
    """Stored: row, keys, kind, start, stop (code points, end exclusive) and scope of each part; a row without parts has a
    null kind."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keys, readable(F.col(text_col)).alias("scan")).withColumn("low", F.lower("scan"))
    rows = rows.select("row", *keys, found_in(F.col("scan"), F.col("low")).alias("ms"))
    rows = rows.select("row", *keys, F.explode_outer("ms").alias("m")).select("row", *keys, "m.*")
    by_kind = Window.partitionBy("row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(by_kind)).withColumn("start", F.col("stop") - F.col("size"))
    need = F.element_at(F.array(*[F.lit(x[3]) for x in KINDS], F.lit(0)), F.col("kind") + 1)
    rows = rows.withColumn("kind", F.when(F.col("part") >= need, F.col("kind")))  # a failing match holds its place in the text, no more
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("scope", F.sum((F.col("kind") == len(KINDS)).cast("int")).over(ahead))
    base_end = F.max(F.when(F.col("kind") < BASE, F.col("stop"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    # a weak part inside a base span is that span already
    covered = (F.col("kind") >= BASE) & F.coalesce(base_end > F.col("start"), F.lit(False))
    return store.table(rows.select("row", *keys, F.when((F.col("kind") < len(KINDS)) & ~covered, F.col("kind")).alias("kind"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.coalesce("scope", F.lit(0)).alias("scope")))


def links(found: DataFrame, reach: int) -> DataFrame:
    """Pairs of complementary parts (row, a, b), each a struct (start, kind, stop): a stands before b in the same scope, they
    do not overlap, and at most reach code points lie between them.

    An interval join in cells of reach code points: b's start lies in the cell of a's stop or in the next one. Matches of a
    kind do not overlap, so a part meets a bounded number of others however many a text holds.
    """
    part = found.where("kind is not null").select("row", "scope", F.struct("start", "kind", "stop").alias("p"))
    cell = lambda x: F.floor(x / F.lit(reach)).cast("int")
    left = part.select("row", "scope", F.col("p").alias("a"), F.explode(F.array(cell(F.col("p.stop")), cell(F.col("p.stop")) + 1)).alias("cell"))
    right = part.select("row", "scope", F.col("p").alias("b"), cell(F.col("p.start")).alias("cell"))
    role = {k: (is_kind(F.col("a.kind"), *names), is_kind(F.col("b.kind"), *names)) for k, names in ROLES.items()}
    complement = F.lit(False)
    for x, y in (("id", "secret"), ("id", "place"), ("secret", "place")):
        complement = complement | (role[x][0] & role[y][1]) | (role[y][0] & role[x][1])
    return left.join(right, ["row", "scope", "cell"]).where(F.col("b.start").between(F.col("a.stop"), F.col("a.stop") + reach) & complement).select("row", "a", "b")


def kept(found: DataFrame, reach: int) -> DataFrame:
    """(row, start, kind, stop, partners) of the spans to report: all base parts, and weak ones with what they need.

    partners are the parts linked with it, as structs in order; they may hold weak parts that are not reported.
    """
    pairs = links(found, reach)
    each = pairs.select("row", F.col("a").alias("p"), F.col("b").alias("other")).unionByName(pairs.select("row", F.col("b").alias("p"), F.col("a").alias("other")))
    near = each.groupBy("row", "p").agg(F.sort_array(F.collect_set("other")).alias("partners"))
    weak = found.where("kind is not null").select("row", F.struct("start", "kind", "stop").alias("p")).join(near, ["row", "p"], "left")
    kinds = F.coalesce(F.col("partners.kind"), F.array().cast("array<int>"))
    has = {k: F.arrays_overlap(kinds, F.array(*[F.lit(i) for i, x in enumerate(KINDS) if x[0] in names])) for k, names in ROLES.items()}
    kind = F.col("p.kind")
    needs = (kind < BASE) | (is_kind(kind, "ident") & has["secret"]) | (is_kind(kind, "opaque") & has["id"]) | (is_kind(kind, "endpoint") & has["id"] & has["secret"]) | (is_kind(kind, "short") & (has["id"] | has["place"]))
    return weak.where(needs).select("row", "p.*", "partners")


def said(spans) -> Column:
    """kind:start:end of spans (start, kind, stop), comma-joined."""
    names = F.array(*[F.lit(x[0]) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, links, and s (array of start, kind, stop).

    spans lists kind:start:end of all kept spans, by start, then kind in the order of KINDS, comma-joined; base_sha256
    is the SHA-256 of the same list of the three base kinds. links lists the pairs of kept spans that belong together, as
    span~span, the earlier first, in order. Null and empty texts have none. Rows are scanned one by one, repeated rows and null
    ids too; extra columns are ignored and an empty table gives an empty result.
    """
    found = parts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", reach)
    spans = kept(found, reach).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "partners"))).alias("k"))
    spans = spans.withColumn("s", F.transform("k", lambda x: F.struct(x["start"], x["kind"], x["stop"])))
    later = lambda x: F.filter(F.coalesce(x["partners"], F.array().cast("array<struct<start:int,kind:int,stop:int>>")), lambda o: (o["start"] > x["start"]) & F.array_contains("s", o))
    pair = lambda x: F.transform(later(x), lambda o: F.concat_ws("~", said(F.array(F.struct(x["start"], x["kind"], x["stop"]))), said(F.array(o))))
    spans = spans.select("row", "s", F.array_join(F.flatten(F.transform("k", pair)), ",").alias("links"))
    rows = found.select("row", "id").distinct().join(spans, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,kind:int,stop:int>>")))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base = said(F.filter("s", lambda x: x["kind"] < BASE))
    return rows.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), said("s").alias("spans"), F.coalesce("links", F.lit("")).alias("links"), "s")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", reach: int = 200) -> DataFrame:
    """docs with every kept span replaced by [SECRET]; other rows and columns as they are, chars_col following the text.

    Spans belong to a text, so repeated texts are cut alike; overlapping spans are one. Null and empty texts stay, an empty
    table gives an empty one, and columns may have any names. Only texts whose hash is that of a text with spans are
    shuffled, found by a bitmap of at most 2^28 bits; the others stay where they are read.
    """
    key = [F.xxhash64(F.col(text_col)).alias("h"), F.crc32(F.col(text_col).cast("binary")).alias("c"), F.length(text_col).alias("n")]
    keys = ["h", "c", "n"]
    found = parts(docs.where(F.col(text_col).isNotNull()).select(F.struct(*key).alias("key"), F.col(text_col).alias("scan")), ["key"], "scan", reach)
    rows = kept(found, reach).select("row", "start", "stop")
    ahead = Window.partitionBy("row").orderBy("start", "stop")
    upto = F.max("stop").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    merged = rows.withColumn("new", (F.coalesce(upto, F.lit(-1)) < F.col("start")).cast("int")).withColumn("g", F.sum("new").over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = merged.groupBy("row", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    cuts = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    by_text = found.where("kind is not null").select("row", "key").distinct().join(cuts, "row")
    by_text = store.table(by_text.groupBy("key").agg(F.first("cuts").alias("cuts")).select("key.*", "cuts"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    likely, rest = bitmaps.split(packed, by_text, "h")
    hit = likely.join(by_text, keys, "left").select("row", "cuts").unionByName(rest.select("row", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("cuts")))
    old = F.col("row").getField(text_col)
    piece = lambda c, i: F.concat(F.substring(old, F.when(i == 0, 0).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["stop"]) + 1, c["start"] - F.when(i == 0, 0).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["stop"])), F.lit("[SECRET]"))
    new = F.when(F.col("cuts").isNull(), old).otherwise(F.concat(F.array_join(F.transform("cuts", piece), ""), F.substring(old, F.element_at("cuts", -1)["stop"] + 1, F.lit(2**31 - 1))))
    done = hit.select("row", new.alias("text"))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("row").getField(c).alias(c) for c in docs.columns])
