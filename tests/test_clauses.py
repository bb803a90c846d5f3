"""Clauses of sentences by hand, and single JSON objects."""

import json

from pyspark.sql import functions as F

from statuta.operators import clauses as C
from statuta.sources import jsonl


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.c for r in rows.select("i", C.clauses(F.col("text")).alias("c")).orderBy("i").collect()]


def test_split_at_and(spark):
    two, kept = found(spark, ["A reviewer may inspect the file and shall record the decision.", "The clerk may act only if asked and must sign."])
    assert [(c.clause_text, c.modality.text) for c in two] == [("A reviewer may inspect the file", "may"), ("shall record the decision.", "shall")]
    assert (two[0].actor.text, two[0].action.text, two[1].actor, two[1].action.text) == ("A reviewer", "inspect the file", None, "record the decision")
    # no boundary after a constraint marker: the left clause runs to the end, the right one begins at its marker; the right
    # one's marker ranks first in both
    assert [(c.clause_text, c.modality.text) for c in kept] == [("The clerk may act only if asked and must sign.", "must"), ("must sign.", "must")]


def test_voice_and_prefixes(spark):
    passive, agentless, nobody, unless = found(spark, ["Records shall be kept by the controller.", "Records must be kept.", "No person shall enter within ten days.", "Unless approved, the driver may leave unless stopped."])
    assert (passive[0].actor.text, passive[0].action.text) == ("the controller", "be kept")
    assert agentless[0].actor is None and agentless[0].action.text == "be kept"
    assert (nobody[0].actor.text, nobody[0].action.text, nobody[0].constraint.text) == ("No person", "enter", "within ten days")
    assert (unless[0].condition.text, unless[0].actor.text, unless[0].exception.text) == ("Unless approved", "the driver", "unless stopped")


def test_spans_are_slices(spark):
    texts = ["Unless approved, the driver may stop and shall report to the office within a day.", "Ürün shall be sold by the Käufer.", "  A  must   go ; ", "may", "", None, "no rule"]
    for text, clauses in zip(texts, found(spark, texts), strict=True):
        assert (clauses is None) == (text is None)
        for c in clauses or []:
            assert text[c.clause_start : c.clause_stop] == c.clause_text
            for f in ("modality", "actor", "action", "condition", "constraint", "exception"):
                assert c[f] is None or text[c[f].start : c[f].stop] == c[f].text


def test_baseline_keeps_broken_rows(spark):
    rows = C.baseline(spark.createDataFrame([(1, "He may go."), (2, None)], "i int, text string")).orderBy("i").collect()
    assert [(len(r.clauses), r.error) for r in rows] == [(1, None), (0, "text is null")]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lexicon.json").write_text(json.dumps({"categories": {"a": {"markers": ["x", "y z"]}, "b": {"markers": []}}}, indent=1))
    assert sorted(map(tuple, jsonl.lexicon_rows(spark, str(tmp_path / "lexicon.json")).select("category", "marker").collect())) == [("a", "x"), ("a", "y z")]
