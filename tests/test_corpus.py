"""Corpus building beyond ASCII, samples and lists without a task for a group, against plain Python versions."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from statuta.functions import strings as S
from statuta.operators import clauses, comparison, corpus

TEXTS = [
    "Der Verkäufer shall prüfen die Akte.", "The Käufer shall zahlen.", "The\xa0Käufer must nicht be verkauft, after zwei Jahre.", "überall mayßen and shall not be gelöscht unless\xa0Ärzte widersprechen;", "The registrar is bound.", "Where\xa0nötig , the processor may löschen", "änderte shall", "shall ändern_x 2½ Ⅷ áb",
    "If 𝔄 is groß, each controller must   handeln within 30 Tage.", "ſhall not", None, "", "\xa0", "Any natural person  should gehen\xa0", "excluding\xa0 ,;.", "Each Ärztin Müller must gehen", "The a is b",
]


def annotated(text):
    search = lambda p: re.search(p, text, re.IGNORECASE)
    low = text.lower()
    kind = next((k for k, p in corpus.MODALITY_PATTERNS if re.search(p, low)), "obligation")
    actor = search(corpus.ACTORS)
    subject = search(r"^((?:The|A|Each|Any)\s+\w+(?:\s+\w+)?)\s+(?:shall|must|may|should|is)")
    action = search(r"\b(?:shall|must|may|should)\s+(not\s+)?(?:be\s+)?(\w+(?:\s+\w+){0,8})")
    first = lambda patterns, marks: next((m[0].rstrip(marks).strip() or None for p in patterns if (m := search(p.removeprefix("(?i)")))), None)
    return (kind, actor[0].strip() if actor else subject[1].strip() if subject else None, ((action[1] or "") + action[2]).strip() if action else None, first([corpus.CONDITION], ",;."), first(corpus.CONSTRAINTS, ""), first([corpus.EXCEPTION], ";."))


def test_weak_annotation_beyond_ascii(spark):
    rnd = random.Random(5)
    words = ["shall", "must", "not", "be", "may", "the", "The", "Käufer", "ändern", "processor", "where", "If", "within", "subject to", "unless", "größer", "𝔄", "2", "_x", ",", ".", ";"]
    texts = TEXTS + [rnd.choice([" ", "\xa0", "  ", " "]).join(rnd.choices(words, k=rnd.randrange(1, 14))) for _ in range(400)]
    found = corpus.weak_annotate(F.col("text"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", *[found[k].alias(k) for k in ("modality", "actor", "action", "condition", "constraint", "exception")]).collect()
    for r in got:
        if texts[r.i] is not None and "́" not in texts[r.i]:  # Python's \w leaves out marks as well, but its tables differ by version
            assert tuple(r)[1:] == annotated(texts[r.i]), repr(texts[r.i])


def test_tokens_part_at_blanks_of_any_kind(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [f"A{b}B{b}{b}c" for b in blanks] + ["a​b", "  ", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(S.tokens(F.col("x")).alias("t")).collect()]
    assert got == [list(dict.fromkeys(t.split())) if t is not None else None for t in texts]


def test_clause_offsets_beyond_the_basic_plane(spark):
    df = spark.createDataFrame([(t,) for t in ["𝔄𝔅 must go unless told.", "Unless Ärzte\xa0müssen, x must go", "unless it is 𝔄, y may unless 𝔅 z", "xunless ünless äunless a", "𝔄unless b"]], "t string")
    rows = df.select("t", clauses.mid_unless(F.col("t")).alias("m"), clauses.initial_unless(F.col("t")).alias("i"), clauses.exception(F.col("t"), F.lit(1)).alias("e")).collect()
    for r in rows:
        places = [m.start() for m in re.finditer(r"\bunless\b", r.t, re.IGNORECASE) if m.start() > 0]
        assert r.m == (places[0] if places else None), r.t
        later = [m.start() for m in re.finditer(r"\bunless\s+", r.t[1:], re.IGNORECASE)]
        assert (r.e.start if r.e else None) == (later[0] + 1 if later else None), r.t
        begin = re.match(r"^(Unless\s+\w+(?:\s+\w+)*?)\s*,?\s+", r.t, re.IGNORECASE)
        assert (r.i.text if r.i else None) == (begin[1] if begin else None), r.t


def diverse(rows, target, per_group=3):
    seen, chosen = Counter(), []
    for g, n in sorted(rows, key=lambda r: r[1]):
        seen[g] += 1
        chosen.append((seen[g] > per_group, (g is None, g or "") if seen[g] <= per_group else (False, ""), seen[g] if seen[g] <= per_group else 0, n))
    return [n for *_, n in sorted(chosen)[:target]]


def test_diverse_sample_gathers_no_group(spark):
    rnd = random.Random(6)
    for target, groups in ((5, 3), (20, 3), (40, 30), (200, 2), (7, 30)):
        rows = [(rnd.choice([None, None, None, *(f"g{k}" for k in range(groups))]), n) for n in range(120)]
        df = spark.createDataFrame(rows, "g string, n int")
        got = [r.n for r in corpus.diverse_sample(df, "g", ["n"], target).orderBy("place").collect()]
        assert got == diverse(rows, target)
    plan = spark._jvm.PythonSQLUtils.explainString(corpus.diverse_sample(df, "g", ["n"], 5)._jdf.queryExecution(), "simple")
    assert plan.count("WindowGroupLimit") >= 2  # once in the tasks that read, once after they meet
    assert corpus.diverse_sample(df.limit(0), "g", ["n"], 5).count() == 0


def test_sorted_ids(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), rnd.randint(0, 400), rnd.sample(["x", "y", "z"], rnd.randint(0, 3)) + rnd.choice([[], [None], ["x"]])) for _ in range(900)] + [("a", None, ["x"]), ("a", 5, None)]
    df = spark.createDataFrame(rows, "run string, id long, failures array<string>")
    for size in (10_000, 7):
        chunks = comparison.sorted_ids(df, "id", size).collect()
        want = {}
        for run, i, bad in rows:
            for c in bad or ():
                if c is not None and i is not None:
                    want.setdefault((run, c), set()).add(i)
        assert max(len(r.ids) for r in chunks) <= size
        got = {}
        for r in sorted(chunks, key=lambda r: r.chunk):
            got[r.run, r.category] = got.get((r.run, r.category), []) + r.ids
        assert got == {k: sorted(v) for k, v in want.items()}
        assert sorted((r.run, r.category, r.chunk) for r in chunks) == [(a, b, k) for (a, b), v in sorted(want.items()) for k in range(-(-len(v) // size))]
