"""Rule-first clauses of sentences: modality markers at letter boundaries, unless-clauses, actors, actions, constraints, exceptions.

Offsets count code points from 0, ends are exclusive. A span is (text, start, stop) or null. All are column functions, so a
table of sentences becomes its clauses in one projection, without a shuffle. A null text has no clauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.strings import let, unicode_pattern

# Modality markers by priority, constraint markers, outer marks, and what a definition looks like.
MARKERS = ["no person shall", "shall not", "must not", "shall", "must", "may"]
CONSTRAINTS = ["within", "before", "after", "only if", "provided that"]
TRAILING = ".,;:!? \t"
DEFINITION = r'(?i)\b\w+\s+means\b|\b\w+\s+is\s+(a|an|the)\b|^\s*"[^"]+"\s*(means|refers to|denotes)'
# The class of each marker, and the confidence of each field.
CLASSES = {"no person shall": "prohibition", "shall not": "prohibition", "must not": "prohibition", "shall": "obligation", "must": "obligation", "may": "permission"}
CONFIDENCE = {"modality": 1.0, "actor": 0.95, "agent": 0.92, "action": 0.88, "condition": 0.9, "constraint": 0.85, "exception": 0.85}


def _span(text: Column, start: Column) -> Column:
    """From start to the text's end without trailing marks; null where start is null."""
    kept = F.rtrim(F.substring(text, start + 1, F.length(text)), F.lit(TRAILING))
    return F.when(start.isNotNull(), F.struct(kept.alias("text"), start.cast("int").alias("start"), (start + F.length(kept)).cast("int").alias("stop")))


def mid_unless(text: Column) -> Column:
    """Offset of the first "unless" that does not begin the text, else null."""
    return _place(text, unicode_pattern(r"(?i)(?<!^)(?=unless)\bunless\b"))


def initial_unless(text: Column) -> Column:
    """The condition of a text that begins with "Unless": the fewest words that a comma or blank follows."""
    found = F.regexp_extract(text, unicode_pattern(r"(?i)^(Unless\s+\w+(?:\s+\w+)*?)\s*,?\s+"), 1)
    return F.when(found != "", F.struct(found.alias("text"), F.lit(0).alias("start"), F.length(found).alias("stop")))


def modality_hits(text: Column) -> Column:
    """Markers from left to right, not overlapping, no letter on either side, before a later unless: array of (marker, start, stop)."""
    pattern = r"(?i)(?<!\p{L})(?:" + "|".join(MARKERS) + r")(?!\p{L})"

    def placed(x: Column) -> Column:
        def hit(m: Column, i: Column) -> Column:
            ahead = F.aggregate(F.slice(x["gaps"], F.lit(1), i + 1), F.lit(0), lambda a, n: a + n) + F.aggregate(F.slice(x["marks"], F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y))
            return F.struct(m.alias("marker"), ahead.alias("start"), (ahead + F.length(m)).alias("stop"))

        return F.transform(x["marks"], hit)

    def of(part: Column) -> Column:
        gaps = F.transform(F.split(part, pattern, -1), lambda g: F.length(g))
        return let(F.struct(F.regexp_extract_all(part, F.lit(pattern), F.lit(0)).alias("marks"), gaps.alias("gaps")), placed)

    return let(F.substring(text, F.lit(1), F.coalesce(mid_unless(text), F.length(text)).cast("int")), of)


def first_modality(text: Column) -> Column:
    """The first marker by priority whose first occurrence has no letter on either side: (marker, start, stop), else null."""
    known = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(m).alias("m")) for i, m in enumerate(MARKERS)])

    def of(low: Column) -> Column:
        placed = F.transform(known, lambda k: F.struct(k["prio"].alias("prio"), (F.instr(low, k["m"]) - 1).alias("start"), (F.instr(low, k["m"]) - 1 + F.length(k["m"])).alias("stop")))
        free = lambda p: (p["start"] >= 0) & ~F.regexp_like(F.substring(low, p["start"], F.when(p["start"] > 0, 1).otherwise(0)), F.lit(r"\p{L}")) & ~F.regexp_like(F.substring(low, p["stop"] + 1, F.lit(1)), F.lit(r"\p{L}"))
        return F.array_min(F.filter(placed, free))

    best = let(F.lower(text), of)
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(F.substring(text, b["start"] + 1, b["stop"] - b["start"]).alias("marker"), b["start"].alias("start"), b["stop"].alias("stop"))))


def constraint(text: Column, after: Column) -> Column:
    """From the earliest constraint marker after an offset that no letter precedes to the sentence's end."""
    tail = F.lower(F.substring(text, after + 1, F.length(text)))

    def of(low: Column) -> Column:
        places = F.transform(F.array(*map(F.lit, CONSTRAINTS)), lambda m: F.instr(low, m))
        free = F.filter(places, lambda p: (p > 0) & ~F.regexp_like(F.substring(low, p - 1, F.when(p > 1, 1).otherwise(0)), F.lit(r"\p{L}")))
        return F.array_min(free)

    return _span(text, let(tail, of) - 1 + after)


def exception(text: Column, after: Column) -> Column:
    """From the first "unless" after an offset to the sentence's end."""
    return _span(text, _place(_from(text, after), unicode_pattern(r"(?i)(?=unless)\bunless\s+")) + after)


def looks_like_definition(text: Column) -> Column:
    return F.regexp_like(text, F.lit(unicode_pattern(DEFINITION)))


def _from(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.length(text))


def _place(text: Column, pattern: str) -> Column:
    """Offset of a pattern's first match, else null. What stands before it is extracted, since a split reads its pattern anew for every text."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.length(F.regexp_extract(text, f"^((?s:.*?))(?:{pattern})", 1)))


def _past(text: Column, at: Column, marks: str) -> Column:
    """The first offset from `at` on whose character is none of marks."""
    return at + F.length(F.regexp_extract(_from(text, at), f"^[{marks}]*", 0))


def _trimmed(text: Column, start: Column, stop: Column) -> Column:
    """The span from start to stop without outer blanks; an empty text where nothing is left."""

    def of(raw: Column) -> Column:
        ahead = F.length(F.regexp_extract(raw, r"(?U)^\s*", 0))
        kept = F.regexp_replace(raw, r"(?U)^\s+|\s+\z", "")
        return F.struct(kept.alias("text"), (start + ahead).cast("int").alias("start"), (start + ahead + F.length(kept)).cast("int").alias("stop"))

    return let(F.substring(text, start + 1, stop - start), of)


def boundary_and(text: Column, left: Column, right: Column) -> Column:
    """Offset of the last "and" between two modalities that no constraint marker between them precedes, else null."""
    free = F.split(F.substring(text, left + 1, right - left), unicode_pattern(r"(?i)\b(?:within|before|after|only\s+if|provided\s+that)\b"), 2)[0]
    return let(free, lambda x: F.when(F.regexp_like(x, F.lit(unicode_pattern(r"(?i)\band\b"))), (left + F.length(F.regexp_extract(x, unicode_pattern(r"(?i)^((?s:.*))\band\b"), 1))).cast("int")))


def and_boundaries(text: Column) -> Column:
    """For each modality hit the boundary "and" before it; null for the first and where there is none."""
    return let(modality_hits(text), lambda hits: _boundaries(text, hits))


def _boundaries(text: Column, hits: Column) -> Column:
    return F.transform(hits, lambda h, i: boundary_and(text, F.get(hits, i - 1)["stop"], h["start"]))


def split(text: Column) -> Column:
    """Segments with one modality each, as spans without outer blanks, after a condition that begins the text.

    A boundary "and" ends a segment and begins the next. Without one, the left segment runs to the text's end and the
    right one begins at its marker, so they overlap. At most one modality: one segment, which may be empty.
    """

    def of(x: Column) -> Column:
        def segment(h: Column, i: Column) -> Column:
            own = F.get(x["ands"], i)
            start = F.when(i == 0, x["begin"]).when(own.isNotNull(), _past(text, own + 3, " ")).otherwise(h["start"])
            return _trimmed(text, start, F.coalesce(F.get(x["ands"], i + 1), F.length(text)))

        many = F.filter(F.transform(x["hits"], segment), lambda s: s["text"] != "")
        whole = F.struct(text.alias("text"), F.lit(0).alias("start"), F.length(text).alias("stop"))
        blank = F.regexp_like(text, F.lit(r"(?U)^\s*\z"))
        return F.when(blank, F.array(whole)).when(F.size(x["hits"]) > 1, many).otherwise(F.array(_trimmed(text, x["begin"], F.length(text))))

    begin = let(initial_unless(text), lambda c: F.when(c.isNull(), F.lit(0)).otherwise(_past(text, c["stop"], ", ")))
    parts = let(modality_hits(text), lambda hits: F.struct(hits.alias("hits"), _boundaries(text, hits).alias("ands"), begin.alias("begin")))
    return F.when(text.isNotNull(), let(parts, of))


def _local_unless(prefix: Column) -> Column:
    """"Unless" and a word that begin a segment, before its marker."""
    found = F.regexp_extract(prefix, r"(?iU)^Unless\s+\w+", 0)
    return F.when(found != "", F.struct(found.alias("text"), F.lit(0).alias("start"), F.length(found).alias("stop")))


def _moved(span: Column, by: Column) -> Column:
    return F.when(span.isNotNull(), F.struct(span["text"].alias("text"), (span["start"] + by).cast("int").alias("start"), (span["stop"] + by).cast("int").alias("stop")))


def _sure(span: Column, confidence: Column) -> Column:
    return F.when(span.isNotNull(), F.struct(span["text"].alias("text"), span["start"].cast("int").alias("start"), span["stop"].cast("int").alias("stop"), confidence.alias("confidence")))


def _actor(text: Column, c: Column) -> Column:
    """A clause's actor: "No person"; the agent "by the X" of a passive, null without one; else what lies before the marker."""
    nobody = F.struct(F.substring(c["m"]["marker"], 1, 9).alias("text"), c["m"]["start"].alias("start"), (c["m"]["start"] + 9).alias("stop"))
    agent = F.regexp_extract(c["tail"], r"(?iU)\bby\s+(the\s+\w+)", 1)
    at = c["m"]["stop"] + c["by"] + F.length(F.regexp_extract(c["tail"], r"(?iU)\bby\s+(?=the\s+\w+)", 0))
    by = F.when(c["by"].isNotNull(), F.struct(agent.alias("text"), at.alias("start"), (at + F.length(agent)).alias("stop")))
    after = F.when(c["condition"]["stop"] <= c["m"]["start"], F.least(_past(text, c["condition"]["stop"], ", "), c["m"]["start"]))
    before = _trimmed(text, F.greatest(c["seg"]["start"], F.coalesce(after, F.lit(0))), c["m"]["start"])
    passive = F.regexp_like(c["tail"], F.lit(r"(?U)^\s*be\s+\w+"))
    full = let(before, lambda b: F.when(b["text"] != "", b))
    sure = lambda k: F.lit(CONFIDENCE[k])
    return F.when(F.lower(c["m"]["marker"]) == "no person shall", _sure(nobody, sure("actor"))).when(passive, _sure(by, sure("agent"))).otherwise(_sure(full, sure("actor")))


def _action(text: Column, c: Column) -> Column:
    """From the marker to the earliest of constraint, exception, "by the X", "to the X" and the segment's end."""
    end = F.least(c["constraint"]["start"], c["exception"]["start"], c["m"]["stop"] + c["by"], c["m"]["stop"] + c["to"], c["seg"]["stop"])

    def of(raw: Column) -> Column:
        kept = F.rtrim(raw["text"], F.lit(TRAILING))
        return F.when(kept != "", F.struct(kept.alias("text"), raw["start"].alias("start"), (raw["start"] + F.length(kept)).alias("stop")))

    return let(_trimmed(text, c["m"]["stop"], end), of)


def clause(text: Column, seg: Column, number: Column, inherited: Column) -> Column:
    """A segment's clause: clause_id, its text and offsets, the six fields with confidences, and its own confidence.

    Constraint and exception are sought to the whole text's end, so those of a later clause reach earlier ones too.
    Without a modality there is a condition at most and the confidence is 0.1; without an action it is 0.3, else 0.9.
    """

    def with_marker(m: Column) -> Column:
        own = _moved(_local_unless(F.substring(seg["text"], F.lit(1), m["local"])), seg["start"])
        tail = _from(text, m["stop"])
        parts = F.struct(
            m.alias("m"), seg.alias("seg"), tail.alias("tail"),
            F.coalesce(own, inherited).alias("condition"),
            F.when(m["stop"].isNotNull(), constraint(text, m["stop"])).alias("constraint"),
            F.when(m["stop"].isNotNull(), exception(text, m["stop"])).alias("exception"),
            _place(tail, r"(?iU)\bby\s+the\s+\w+").alias("by"), _place(tail, r"(?iU)\bto\s+the\s+\w+").alias("to"),
        )
        return let(parts, fields)

    def fields(c: Column) -> Column:
        normative = c["m"]["stop"].isNotNull()
        mark = F.when(normative, F.struct(c["m"]["marker"].alias("text"), c["m"]["start"].alias("start"), c["m"]["stop"].alias("stop")))
        found = {"modality": mark, "condition": c["condition"], "constraint": c["constraint"], "exception": c["exception"]}
        spans = {f: _sure(x, F.lit(CONFIDENCE[f])) for f, x in found.items()}
        spans["actor"] = F.when(normative, _actor(text, c))
        spans["action"] = F.when(normative, _sure(_action(text, c), F.lit(CONFIDENCE["action"])))
        order = ["modality", "actor", "action", "condition", "constraint", "exception"]
        out = F.struct(F.concat(F.lit("C"), number.cast("string")).alias("clause_id"), seg["text"].alias("clause_text"), seg["start"].alias("clause_start"), seg["stop"].alias("clause_stop"), *[spans[f].alias(f) for f in order])
        sure = lambda x: F.when(x["modality"].isNull(), 0.1).when(x["action"].isNull(), 0.3).otherwise(0.9)
        return let(out, lambda x: F.struct(*[x[f].alias(f) for f in ["clause_id", "clause_text", "clause_start", "clause_stop", *order]], sure(x).alias("confidence")))

    placed = let(first_modality(seg["text"]), lambda m: F.struct(m["marker"].alias("marker"), m["start"].alias("local"), (seg["start"] + m["start"]).alias("start"), (seg["start"] + m["stop"]).alias("stop")))
    return let(placed, with_marker)


def clauses(text: Column) -> Column:
    """All clauses of a text, in order."""
    return let(F.struct(split(text).alias("segs"), initial_unless(text).alias("c")), lambda x: F.transform(x["segs"], lambda s, i: clause(text, s, i + 1, x["c"])))


def flattened(found: Column) -> Column:
    """One value a field from an array of clauses: those of the first clause, modality as its class.

    A null modality falls to the first later clause that has one, a null action to the first later clause's action.
    """
    classes = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])

    def of(found: Column) -> Column:
        first_of = lambda f: F.get(F.filter(F.transform(found, lambda c: c[f]["text"]), lambda t: t.isNotNull()), F.lit(0))
        head = F.get(found, F.lit(0))
        return F.struct(classes[F.lower(first_of("modality"))].alias("modality"), head["actor"]["text"].alias("actor"), first_of("action").alias("action"), *[head[f]["text"].alias(f) for f in ("condition", "constraint", "exception")])

    return let(found, of)


def baseline(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with clauses and error: a row without a text gets an empty array and the reason, and the job goes on."""
    rows = rows.withColumn("clauses", clauses(F.col(text_col)))
    return rows.withColumn("error", F.when(F.col(text_col).isNull(), "text is null")).withColumn("clauses", F.coalesce("clauses", F.array()))
