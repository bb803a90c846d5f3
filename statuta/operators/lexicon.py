"""Extraction of rule fields by a lexicon of markers.

Markers match as plain substrings of the lower-cased text, as the golden outputs need (so "if" hits "specified");
match="word" asks for word edges. Offsets count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.strings import NOT_AFTER_WORD, WORD, let

# The marker lexicon, the classes of modality in order of priority, determiners, auxiliaries and connectors.
LEXICON = {
    "prohibition": ["shall not", "must not", "no person shall", "is prohibited from", "may not", "it is forbidden to", "is not permitted to", "is not allowed to"],
    "obligation": ["shall", "must", "is required to", "has the obligation to", "is obliged to", "it is mandatory to"],
    "permission": ["may", "is permitted to", "is allowed to", "is authorized to", "has the right to", "it is permissible to"],
    "definition": ["means", "refers to", "denotes", "is defined as", "shall mean", "is understood as", "shall be construed as"],
    "condition": ["if", "when", "where", "in case of", "provided that", "once", "after", "before", "unless", "in the event that", "insofar as", "to the extent that", "subject to", "on condition that", "as long as", "so long as", "upon", "following", "in the case where", "in cases where", "whenever"],
    "constraint": ["within", "at least", "no later than", "without undue delay", "for the purpose of", "only", "minimum", "maximum", "prior to", "not exceeding", "at most", "no sooner than", "not before", "in accordance with", "pursuant to", "in compliance with", "consistent with", "taking into account", "having regard to", "in particular", "including", "in addition to", "for a period of", "for the duration of", "throughout"],
    "exception": ["unless", "except", "except where", "except if", "notwithstanding", "other than", "save where", "with the exception of", "excluding", "apart from", "without prejudice to", "this shall not apply where", "shall not apply to", "does not apply to", "do not apply to", "provided however that"],
    "actor": ["controller", "processor", "data subject", "supervisory authority", "data protection officer", "company", "provider", "physician", "officer", "authority", "court", "prosecutor", "driver", "inspector", "customer", "phone company", "recipient", "third party", "joint controller", "representative", "commission", "board", "member state", "union", "organisation", "organization", "employer", "employee", "operator", "user", "public authority", "competent authority", "person", "natural person", "legal person", "data importer", "data exporter", "sub-processor"],
}
CLASSES = ["prohibition", "obligation", "permission", "definition"]
DETERMINERS = ["the", "a", "an", "each", "every", "any", "no"]
AUXILIARIES = ["shall", "must", "may", "should", "is", "are", "was", "were"]
CONNECTORS = r"(?i)^(and|or|but|then|therefore|thus|hence|accordingly|consequently|however|nevertheless|moreover|furthermore|in addition|additionally|also|as well as|including|such as)\s+"


def longest_first(markers: list[str]) -> list[str]:
    return sorted(markers, key=len, reverse=True)


def _place(low: Column, marker: Column, match: str) -> Column:
    """Offset of the first occurrence, -1 where there is none."""
    if match == "word":
        # what stands before it has a length in characters, where regexp_instr counts one beyond the basic plane as two
        parts = F.split(low, F.concat(F.lit(rf"{NOT_AFTER_WORD}\Q"), marker, F.lit(rf"\E(?!{WORD})")), 2)
        return let(parts, lambda p: F.when(F.size(p) > 1, F.length(p[0])).otherwise(-1))
    return F.instr(low, marker) - 1


def first_modality(low: Column, lexicon: dict[str, list[str]], match: str = "substring") -> Column:
    """modality of a lower-cased text. Markers stand in order of preference, and the first that is there ends the search."""

    def hit(i: int, j: int, k: str, m: str) -> Column:
        at = _place(low, F.lit(m), match).cast("int")
        return F.when(F.contains(low, F.lit(m)) if match == "substring" else at >= 0, F.struct(F.lit(i).alias("prio"), F.lit(j).alias("no"), F.lit(k).alias("klass"), F.lit(m).alias("marker"), at.alias("start"), (at + len(m)).alias("stop")))

    return F.coalesce(*[hit(i, j, k, m) for i, k in enumerate(CLASSES) for j, m in enumerate(longest_first(lexicon[k]))])


def modality(text: Column, lexicon: dict[str, list[str]] | None = None, match: str = "substring") -> Column:
    """(prio, no, klass, marker, start, stop) of the first class by priority that hits, its longest marker first; else null."""
    return let(F.lower(text), lambda low: first_modality(low, lexicon or LEXICON, match))


def confidence(klass: Column, marker: Column) -> Column:
    """min(1, length / 15), at least 0.85 for prohibitions and obligations and 0.6 for definitions; to four places."""
    base = F.least(F.lit(1.0), F.length(marker) / 15)
    return F.round(F.when(klass.isin("prohibition", "obligation"), F.greatest(base, F.lit(0.85))).when(klass == "definition", F.greatest(base, F.lit(0.6))).otherwise(base), 4)


def or_default(hit: Column) -> Column:
    """The hit, or an obligation at -1 of confidence 0.1."""
    return F.struct(F.coalesce(hit["klass"], F.lit("obligation")).alias("klass"), F.coalesce(hit["marker"], F.lit("")).alias("marker"), F.coalesce(hit["start"], F.lit(-1)).alias("start"), F.coalesce(hit["stop"], F.lit(-1)).alias("stop"), F.when(hit.isNull(), F.lit(0.1)).otherwise(confidence(hit["klass"], hit["marker"])).alias("confidence"))


def present(low: Column, markers: list[str]) -> Column:
    """The markers that a lower-cased text holds."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def hits_of(low: Column, held: Column) -> Column:
    """hits of a lower-cased text from the markers that it holds."""

    def all_of(m: Column) -> Column:
        # pieces that begin where the marker does, but for the first, which may begin before any
        sizes = F.transform(F.split(low, F.concat(F.lit(r"(?=\Q"), m, F.lit(r"\E)")), -1), lambda x: F.length(x))
        places = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        kept = F.when(F.startswith(low, m), places).otherwise(F.slice(places, F.lit(2), F.size(places)))
        first = F.instr(low, m)
        # most markers stand in a text once, and the pattern is not needed
        kept = F.when(F.contains(F.substring(low, first + 1, F.length(low)), m), kept).otherwise(F.array(first - 1))
        return F.transform(kept, lambda p: F.struct(p.alias("start"), (-F.length(m)).alias("shorter"), (p + F.length(m)).alias("stop"), m.alias("marker")))

    return F.array_sort(F.flatten(F.transform(held, all_of)))


def hits(text: Column, markers: list[str]) -> Column:
    """All occurrences, overlapping ones too, as sorted (start, shorter, stop, marker): by start, then longest first."""
    return let(F.lower(text), lambda low: hits_of(low, present(low, markers)))


def clause_end(text: Column, start: Column) -> Column:
    """The first `.!?` from start on; without one the first comma or later semicolon; else the text's end."""

    def of(rest: Column) -> Column:
        stop, mark = F.length(F.regexp_extract(rest, r"^[^.!?]*", 0)), F.length(F.regexp_extract(rest, r"^;?[^,;]*", 0))
        first = let(stop, lambda n: F.when(n < F.length(rest), n))
        return F.coalesce(first, let(mark, lambda n: F.when(n < F.length(rest), n)), F.length(rest))

    return start + let(F.substring(text, start + 1, F.length(text)), of)


def _span(text: Column, start: Column, stop: Column) -> Column:
    return F.btrim(F.substring(text, start + 1, F.greatest(stop - start, F.lit(0))), F.lit(" ,;"))


def _first_span(found: Column, text: Column, keep, stop) -> Column:
    ends = F.transform(F.filter(found, keep), lambda h: F.struct(h["stop"].alias("start"), stop(h).cast("int").alias("stop")))
    spans = F.transform(ends, lambda h: F.struct(_span(text, h["start"], h["stop"]).alias("text"), h["start"].alias("start"), h["stop"].alias("stop")))
    return F.get(F.filter(spans, lambda s: s["text"] != ""), F.lit(0))


def condition(text: Column, found: Column, start: Column) -> Column:
    """First condition marker before the modality, up to its clause's end or the modality."""
    return _first_span(found, text, lambda h: h["start"] < start, lambda h: F.least(clause_end(text, h["stop"]), start))


def constraint(text: Column, found: Column, start: Column) -> Column:
    """First constraint marker at or after the modality, up to the clause's end."""
    return _first_span(found, text, lambda h: h["start"] >= start, lambda h: clause_end(text, h["start"]))


def exception(text: Column, found: Column) -> Column:
    """First exception marker, up to the clause's end."""
    return _first_span(found, text, lambda h: F.lit(True), lambda h: clause_end(text, h["stop"]))


def first_actor(low: Column, held: Column) -> Column:
    return F.array_min(F.transform(held, lambda m: F.struct((F.instr(low, m) - 1).alias("start"), (-F.length(m)).alias("shorter"), (F.instr(low, m) - 1 + F.length(m)).alias("stop"))))


def actor_hit(text: Column, markers: list[str]) -> Column:
    """The actor marker that stands first, the longest of those at one place: (start, shorter, stop) or null."""
    return let(F.lower(text), lambda low: first_actor(low, present(low, markers)))


def actor(text: Column, hit: Column, start: Column, compat: bool = True) -> Column:
    """The noun phrase of an actor marker before the modality, else the last words before the modality: (text, start, stop) or null.

    compat: a determiner is looked for in lower case, so a capital one at the beginning gives an empty actor, as in the
    golden outputs; without it the determiner is taken as it stands.
    """

    def phrase(left: Column) -> Column:
        before = F.regexp_replace(F.substring(text, F.lit(1), left), r"\s+$", "")

        def from_word(x: Column) -> Column:
            word = F.lower(x["last"]) if compat else x["last"]
            back = F.instr(F.reverse(x["before"]), F.reverse(word))
            return let(back, lambda n: F.when(n > 0, F.length(x["before"]) - (n - 1) - F.length(word)).otherwise(F.lit(-1)))

        parts = let(before, lambda b: F.struct(b.alias("before"), F.regexp_extract(b, r"(\S*)$", 1).alias("last")))
        begin = let(parts, lambda x: F.when(F.lower(x["last"]).isin(DETERMINERS), from_word(x)).otherwise(left))
        stop = hit["stop"] + F.length(F.regexp_extract(F.substring(text, hit["stop"] + 1, F.length(text)), r"^[^ ,;.!?]*", 0))
        return let(begin, lambda n: F.struct(F.when(n < 0, "").otherwise(F.substring(text, n + 1, stop - n)).alias("text"), n.cast("int").alias("start"), stop.cast("int").alias("stop")))

    def tail(ahead: Column) -> Column:
        words = F.array_remove(F.split(F.trim(ahead), r"\s+"), "")

        def last_of(w: Column) -> Column:
            ends = F.transform(w, lambda x: F.lower(x).isin(AUXILIARIES) & ~F.regexp_like(x, F.lit(r"^\p{Lu}")))
            at = let(F.array_position(ends, F.lit(True)).cast("int"), lambda n: F.when(n > 0, n - 1).otherwise(F.size(w)))
            return F.array_join(F.reverse(F.slice(w, F.lit(1), at)), " ")

        few = let(words, lambda w: F.reverse(F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))))
        return let(let(few, last_of), lambda t: F.when((t != "") & F.contains(ahead, t), F.struct(t.alias("text"), (F.instr(ahead, t) - 1).alias("start"), (F.instr(ahead, t) - 1 + F.length(t)).alias("stop"))))

    left = hit["start"] - F.length(F.regexp_extract(F.substring(text, F.lit(1), hit["start"]), r"[^ ]*$", 0))
    return F.when(hit["start"] < start, let(left, phrase)).otherwise(let(F.substring(text, F.lit(1), start), tail))


def action(text: Column, stop: Column, *spans: Column) -> Column:
    """What follows the modality without the texts of the spans, outer marks and one leading connector; empty where nothing is left."""
    rest = F.substring(text, stop + 1, F.length(text))
    for s in spans:
        rest = F.replace(rest, F.coalesce(s, F.lit("")), F.lit(""))
    return F.trim(F.regexp_replace(F.btrim(rest, F.lit(" ,;.\t")), CONNECTORS, ""))


def extract(sentences: DataFrame, text_col: str = "text", lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """sentences with modality, marker, actor, action, condition, constraint and exception, all null without a modality, and
    spans, a struct of (start, stop) of the marker and of each field, null where the field is.

    Spans of condition, constraint and exception reach from their marker's end to the end of their clause; an action that does not stand
    in the text as it is, since spans were taken out of it, has the place where it begins and its own length. One projection:
    the lexicon is literal, so no rows are multiplied and nothing is shuffled.
    """
    lexicon, text, low = lexicon or LEXICON, F.col(text_col), F.col("_low")
    rows = sentences.withColumn("_low", F.lower(text)).withColumn("_m", let(low, lambda x: first_modality(x, lexicon)))
    rows = rows.withColumns({f"_{k}": hits_of(low, present(low, lexicon[k])) for k in ("condition", "constraint", "exception")}).withColumn("_actor", first_actor(low, present(low, lexicon["actor"])))
    m, a = F.col("_m"), F.col("_actor")
    rows = rows.withColumns({"_c": let(m, lambda x: condition(text, F.col("_condition"), x["start"])), "_k": let(m, lambda x: constraint(text, F.col("_constraint"), x["start"])), "_e": exception(text, F.col("_exception")), "_a": let(F.struct(m.alias("m"), a.alias("a")), lambda x: actor(text, x["a"], x["m"]["start"]))})
    cut = F.struct(F.col("_m.stop").alias("stop"), F.col("_e.text").alias("e"), F.col("_k.text").alias("k"), F.col("_c.text").alias("c"))
    rows = rows.withColumn("_action", let(cut, lambda x: action(text, x["stop"], x["e"], x["k"], x["c"])))
    at = F.instr(F.substring(text, F.col("_m.stop") + 1, F.length(text)), F.col("_action"))
    begin = let(F.struct(at.alias("at"), F.col("_m.stop").alias("stop")), lambda x: x["stop"] + F.greatest(x["at"] - 1, F.lit(0)))
    rows = rows.withColumn("_x", let(begin, lambda n: F.struct(F.col("_action").alias("text"), n.alias("start"), (n + F.length("_action")).alias("stop"))))
    fields = {"actor": "_a", "action": "_x", "condition": "_c", "constraint": "_k", "exception": "_e"}
    there = {f: F.col("_m").isNotNull() & (F.coalesce(F.col(f"{c}.text"), F.lit("")) != "") for f, c in fields.items()}
    span = lambda c: F.struct(F.col(f"{c}.start").alias("start"), F.col(f"{c}.stop").alias("stop"))
    spans = [F.when(m.isNotNull(), span("_m")).alias("modality"), *[F.when(there[f], span(c)).alias(f) for f, c in fields.items()]]
    rows = rows.withColumns({f: F.when(there[f], F.col(f"{c}.text")) for f, c in fields.items()} | {"modality": F.col("_m.klass"), "marker": F.col("_m.marker"), "spans": F.struct(*spans)})
    return rows.drop("_low", "_m", "_condition", "_constraint", "_exception", "_actor", "_action", *fields.values())
