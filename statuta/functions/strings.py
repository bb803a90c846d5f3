"""Column functions for the text of rules: normal forms, set similarity, spans."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical forms of modality markers.
MODALITY_FORMS = {
    "may": "may",
    "shall": "shall",
    "shall not": "shall not",
    "must": "must",
    "must not": "must not",
    "no person shall": "shall not",
    "no person must": "must not",
}


#: A blank in the sense of Unicode, as Python's str.split() takes it; Java's own \\s has ASCII ones alone.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


#: A letter, digit or underscore of any script, as Python's \\w; the same before a place, where Java looks back by halves of
#: characters beyond the basic plane, so that one of these is two; and the edge of a word.
WORD = r"[\p{L}\p{N}_]"
AFTER_WORD, NOT_AFTER_WORD = f"(?<={WORD}{{1,2}})", f"(?<!{WORD}{{1,2}})"
EDGE = f"(?:{NOT_AFTER_WORD}(?={WORD})|{AFTER_WORD}(?!{WORD}))"


def unicode_pattern(pattern: str) -> str:
    """A pattern whose \\w, \\s and \\b mean letters, blanks and edges of any script; none may stand in a class of its own."""
    return pattern.replace(r"\w", WORD).replace(r"\s", BLANK).replace(r"\b", EDGE).replace("(?i)", "(?iu)")


def strip(text: Column) -> Column:
    """Text without outer blanks of any kind."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def clean_field(text: Column, lower: bool = False, strip_punctuation: bool = True) -> Column:
    """Blanks collapsed and outer ones dropped, optionally lower case, outer punctuation `.,;:!?'"` dropped."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.lower(out) if lower else out
    return F.btrim(out, F.lit(".,;:!?'\"")) if strip_punctuation else out


def canonical_modality(text: Column) -> Column:
    """The canonical marker, or the cleaned text where none is known."""
    cleaned = clean_field(text, lower=True)
    forms = F.create_map(*[F.lit(x) for x in chain.from_iterable(MODALITY_FORMS.items())])
    return F.coalesce(forms[cleaned], cleaned)


def words_only(text: Column) -> Column:
    """Lower case with all but letters, digits and underscores made blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def without_marks(text: Column, strip_again: bool = True) -> Column:
    """Lower case, blanks collapsed, then `.,;:!?"'()-` deleted, which can leave two blanks; outer ones go again."""
    out = F.translate(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), ".,;:!?\"'()-", "")
    return F.trim(out) if strip_again else out


def tokens(text: Column) -> Column:
    """Distinct words between blanks, those beyond ASCII among them."""
    return F.array_distinct(F.array_remove(F.split(text, f"{BLANK}+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct tokens: 1 where both are empty, 0 where one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def trim_span(text: Column, start: Column) -> Column:
    """Text without trailing `.,;:!? ` and tabs, with the offsets of what is left: (text, span_start, span_end)."""
    kept = F.rtrim(text, F.lit(".,;:!? \t"))
    return F.struct(kept.alias("text"), start.cast("int").alias("span_start"), (start + F.length(kept)).cast("int").alias("span_end"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def once(value: Column) -> Column:
    """The value from a generator, computed once a row: a filter on it stays above, where a column's filter would sink and compute it again."""
    return F.explode(F.array(value))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: what a lambda captures would else be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
