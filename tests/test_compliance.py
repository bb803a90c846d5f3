"""Similarity join, observed order, lexicon tables, declared constraints and contracts against plain Python versions."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statuta.operators import constraints as C
from statuta.operators import contracts as N
from statuta.operators import lexicon as L
from statuta.operators import lexicon_table as LT
from statuta.operators import matching as M
from statuta.operators import traces as T


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def phrases():
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["the"] * 40 + ["prüfe", "𝔄", "a\xa0b", "Ärzte"]
    make = lambda n: [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(n)]
    return make(250) + ["", "  ", "\xa0", None, "the", "THE"], make(300) + ["", None, "the", "The", "w1 w2 w3", " ".join(words) * 3]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("deal", [1024, 7])
def test_similar_texts_are_those_of_brute_force(spark, phrases, threshold, deal, monkeypatch):
    monkeypatch.setattr(M, "DEAL", deal)
    left, right = ({t.lower() for t in side if t is not None and t.split()} for side in phrases)
    frames = [spark.createDataFrame([(t,) for t in side], "t string") for side in phrases]
    got = {(r.left_text, r.right_text): r.similarity for r in M.similar_texts(*(M.token_sets(f, "t") for f in frames), threshold).collect()}
    assert got == {(a, b): s for a in left for b in right if (s := jaccard(a, b)) >= threshold}


def test_prefixes_hold_the_rarest_tokens_alone(spark, phrases):
    sets = M.token_sets(spark.createDataFrame([(t,) for t in phrases[0]], "t string"), "t")
    counts = Counter(x for r in sets.collect() for x in r.tokens)
    frequency = spark.createDataFrame(list(counts.items()), "token string, n long")
    found = {}
    for r in M.prefixes(sets, frequency, 0.3).collect():
        found.setdefault(r.text, {})[r.place] = r.token
    for r in sets.collect():
        ordered = sorted(r.tokens, key=lambda x: (counts[x], x))
        keep = len(ordered) - -(-3 * len(ordered) // 10) + 1
        assert found[r.text] == dict(enumerate(ordered[:keep]))


def test_best_processes(spark, phrases):
    texts, names = phrases
    rules = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (900, "no such words here")]
    named = [(i % 7, t) for i, t in enumerate(names)]
    got = M.best_processes(spark.createDataFrame(rules, "rule_id long, action string"), spark.createDataFrame(named, "process_id long, name string"), "action").collect()
    want = Counter()
    for i, t in rules:
        if t is None or not t.split():
            continue
        alike = sorted({(-s, n.lower()) for _, n in named if n and (s := jaccard(t, n)) >= 0.3})
        best = (-alike[0][0], alike[0][1], min(p for p, n in named if n and n.lower() == alike[0][1]), len(alike)) if alike else (0.0, None, None, 0)
        want[(i, *best)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert (900, 0.0, None, None, 0) in want
    empty = spark.createDataFrame([], "process_id long, name string")
    assert {r.best for r in M.best_processes(spark.createDataFrame(rules, "rule_id long, action string"), empty, "action").collect()} == {0.0}
    with pytest.raises(ValueError):
        M.similar_texts(empty, empty, 0)


def plain_sessions(rows, gap):
    out, by_case = set(), {}
    for case, time, event, activity in rows:
        if case is not None and time is not None:
            by_case.setdefault(case, []).append((time, event, activity or ""))
    for case, found in by_case.items():
        session, place, was = 0, 0, None
        for time, event, activity in sorted(found):
            if was is None or time - was[0] > gap:
                session, place, before = session + 1, 0, T.START
            else:
                before = was[1]
            place += 1
            out.add((case, session, place, activity, event, before))
            was = (time, activity)
    return out


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(2)
    rows = [(1 if k % 3 else rnd.randint(2, 9), rnd.randint(0, 40_000), k, rnd.choice(["ask", "Pay", "pay later", None, "größe"])) for k in range(900)]
    rows += [(None, 5, 901, "ask"), (3, None, 902, "ask"), (77, 10, 903, "ask"), (77, 70, 904, "pay"), (77, 131, 905, "ask")]  # gaps of 60 and 61
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "c long, s long, e long, a string").select("c", F.timestamp_seconds("s").alias("t"), F.col("t").cast("timestamp_ntz").alias("ntz"), "e", "a", F.lit(1).alias("part"), F.lit("x").alias("before"))
    return rows, df


@pytest.mark.parametrize("time", ["t", "ntz"])
@pytest.mark.parametrize("ranges", [1, 16])
def test_sessions(spark, events, time, ranges):
    rows, df = events
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        with_adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r.case, r.session, r.place, r.activity, r.event, r.before) for r in T.sessions(df, "c", time, "e", "a", 60).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = plain_sessions(rows, 60)
    assert got == want
    assert sorted(x[1:3] for x in want if x[0] == 77) == [(1, 1), (1, 2), (2, 1)]


def test_observed_order(spark, events):
    rows, df = events
    log = T.sessions(df, "c", "t", "e", "a", 600).cache()
    plain = plain_sessions(rows, 600)
    assert {tuple(r) for r in T.follows(log).collect()} == {(a, b, n) for (a, b), n in Counter((x[5], x[3]) for x in plain).items()}
    rules = [(1, "One must ask before pay."), (2, "ask before pay"), (3, "PAY before größe and so on"), (4, "before ask"), (5, "pay before later"), (6, None), (7, "nothing said"), (8, "x before y")]
    first = {}
    for case, session, place, activity, *_ in plain:
        for word in activity.lower().split():
            key = (case, session, word)
            first[key] = min(place, first.get(key, place))
    want = set()
    for rule, one, two in ((2, "ask", "pay"), (3, "pay", "größe"), (5, "pay", "later")):
        want |= {(rule, c, s, p, first[(c, s, two)]) for (c, s, w), p in first.items() if w == one and (c, s, two) in first and p >= first[(c, s, two)]}
    got = {tuple(r) for r in T.observed_order(spark.createDataFrame(rules, "rule_id int, text string"), log).collect()}
    assert got == want and {r[0] for r in want} == {2, 3, 5}
    assert T.observed_order(spark.createDataFrame(rules, "rule_id int, text string"), log.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sentences(spark):
    rnd = random.Random(3)
    words = ["the controller", "shall", "shall not", "specified", "if", "Where", "within 30 days", "unless", "Üser", "user", "übermay", "may", "may_", "ma", "y", "𝔄", "notif", "unless unless", ".", "𝔄may", "𝔄 may 😀if"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "if"), (203, "x" * 254 + "shall not" + "y" * 300 + " if"), (204, "unless" * 100), (0, rows[0][1])]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "rule_id long, text string, start int, marker string")


@pytest.mark.parametrize("match", ["substring", "word"])
def test_lexicon_table_equals_the_literal_lexicon(spark, sentences, match):
    rows, df = sentences
    found = LT.hits(df, LT.from_literal(spark), match=match).cache()
    got, want = Counter((r.rule_id, r.category, r.klass, r.marker, r.start, r.stop) for r in found.collect()), Counter()
    for i, text in rows:
        for kind, markers in L.LEXICON.items():
            for m in markers:
                pattern = re.compile(f"(?=(?<!\\w){re.escape(m)}(?!\\w))" if match == "word" else f"(?={re.escape(m)})")
                for x in pattern.finditer((text or "").lower()):
                    want[(i, *(("modality", kind) if kind in L.CLASSES else (kind, None)), m, x.start(), x.start() + len(m))] += 1
    assert got == want
    literal = df.distinct().select("rule_id", L.modality(F.col("text"), match=match).alias("m"), L.actor_hit(F.col("text"), L.LEXICON["actor"]).alias("a"))
    held = {r.rule_id: (r.klass, r.marker, r.start, r.stop) for r in LT.modality(found).collect()}
    assert held == {r.rule_id: (r.m.klass, r.m.marker, r.m.start, r.m.stop) for r in literal.collect() if r.m}
    if match == "substring":
        actors = {r.rule_id: (r.start, r.stop) for r in LT.first_of(found, "actor").collect()}
        assert actors == {r.rule_id: (r.a.start, r.a.stop) for r in literal.collect() if r.a}


def test_markers_that_begin_alike_do_not_all_meet_a_place(spark):
    names = spark.range(20_000).selectExpr("'2' version", "'party' category", "cast(null as string) klass", "format_string('customer#%09d', id) marker", "0L no")
    both = LT.from_literal(spark).unionByName(names)
    df = spark.createDataFrame([(i, f"The customer and customer#{i:09d} may ask customer#{i}, the customer") for i in range(50)], "rule_id long, text string")
    low = df.selectExpr("rule_id id", "lower(text) low")
    met, _ = LT._candidates(low, LT.prepared(both), "substring")
    assert met.count() < 50 * 40
    found = LT.hits(df, both)
    assert sorted(r.marker for r in found.where("category = 'party'").collect()) == [f"customer#{i:09d}" for i in range(50)]
    assert found.where("marker = 'customer'").count() == 4 * 50


def test_lexicon_table_of_many_markers_has_a_plan_of_the_same_size(spark, sentences, monkeypatch):
    _, df = sentences
    plan = lambda lexicon: df.sparkSession._jvm.PythonSQLUtils.explainString(LT.hits(df, lexicon)._jdf.queryExecution(), "simple")
    some = spark.range(50_000).select(F.lit("1").alias("version"), F.lit("object").alias("category"), F.lit(None).cast("string").alias("klass"), F.concat(F.lit("marker "), "id").alias("marker"))
    few, many = plan(some.limit(50)), plan(some)
    assert abs(len(few) - len(many)) < 200
    both = spark.createDataFrame([("1", "modality", "obligation", "shall"), ("2", "modality", "obligation", "SHALL"), ("2", "x", None, ""), ("2", "x", None, None)], "version string, category string, klass string, marker string")
    found = LT.hits(df, both).cache()
    by = Counter(r.version for r in found.collect())
    assert by["1"] == by["2"] > 0 and set(by) == {"1", "2"}
    monkeypatch.setattr(LT, "BROADCAST_MARKERS", 0)
    assert Counter(tuple(r) for r in LT.hits(df, both).collect()) == Counter(tuple(r) for r in found.collect())
    assert LT.hits(df, both.limit(0)).count() == 0 == LT.hits(df.limit(0), both).count()


DOCUMENT = {
    "description": "not a constraint",
    "fields": {
        "id": {"type": "integer", "required": True},
        "kind": {"type": "string", "enum": ["a", "b"], "minLength": 1, "maxLength": 2, "pattern": "^[ab]"},
        "score": {"minimum": 0, "maximum": 1, "notes": "between"},
        "inner": {"fields": {"name": {"required": True, "const": "x"}}},
        "tags": {"minItems": 1, "uniqueItems": True, "items": {"enum": ["t", "u"], "required": True}},
        "gone": {"required": True, "pattern": "x"},
    },
}


def test_declared_constraints(spark):
    schema = "id long, kind string, score double, inner struct<name: string>, tags array<string>, _broken int"
    rows = [(1, "a", 0.5, ("x",), ["t"], 1), (2, "c", 2.0, ("y",), ["t", "t"], 1), (3, "", -1.0, (None,), [], 1), (None, None, None, None, None, 1), (5, "abc", 0.0, ("x",), ["z", None], 1), (5, "b", 1.0, ("x",), ["u", "t"], 1)]
    want = {
        "id required": [None], "id type": [], "kind enum": [2, 3, 5], "kind minLength 1": [3], "kind maxLength 2": [5], "kind pattern ^[ab]": [2, 3], "kind type": [], "score minimum 0": [3], "score maximum 1": [2],
        "inner.name required": [3, None], "inner.name const x": [2], "tags minItems 1": [3], "tags uniqueItems": [2], "tags[] enum": [5], "tags[] required": [5], "gone required": [1, 2, 3, None, 5, 5],
    }
    constraints = C.declared(json.dumps({"sample": DOCUMENT}), "sample")
    table = spark.createDataFrame(constraints, C.CONSTRAINT)
    df = spark.createDataFrame(rows, schema).drop("_broken")
    got = {r.check: (r.rows, r.violations, r.first) for r in C.report(df, table, "id").collect()}
    assert got == {k: (6, len(v), min((x for x in v if x is not None), default=None)) for k, v in (want | {"gone pattern x": []}).items()}
    first = Counter((r.check, r.id) for r in C.violations(df, table, "id", 2).collect())
    order = lambda v: sorted(v, key=lambda x: (x is not None, x or 0))
    assert first == Counter((k, x) for k, v in want.items() for x in order(v)[:2])
    reasons = {tuple(r.reasons) for r in C.rejected(df, constraints).where("id = 1").collect()}
    assert reasons == {("gone required",)}
    assert C.report(df, [], "id").count() == 0 and C.violations(df, [], "id").count() == 0
    assert {r.violations for r in C.report(df.limit(0), table, "id").collect()} == {0}
    with pytest.raises(ValueError):
        C.report(df, [("id", "shape", "1")], "id")


def test_contract(spark, tmp_path):
    spark.range(12).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "m.json").write_text(json.dumps({"llm": {"saved": False}, "calls": 3, "most": 5, "name": "ü"}, indent=1))
    contract = {"contract_id": "c", "artifacts": {
        "t": {"path": "t.parquet", "checks": {"rows": {"rows": 12}, "few": {"rows": {"max": 11}}, "range": {"rows": {"min": 1, "max": 12}}, "sum": {"value": "sum(id)", "equals": 66}, "true": {"assert": "max(id) = 11"}, "false": {"assert": "max(id) < 11"}, "null": {"assert": "max(if(id > 50, true, null))"}}},
        "m": {"path": "m.json", "format": "json", "checks": {"saved": {"field": "llm.saved", "equals": False}, "open": {"field": "llm.saved", "equals": True}, "name": {"field": "name", "equals": "ü"}, "calls": {"field": "calls", "at_most_field": "most"}, "over": {"field": "most", "at_most_field": "calls"}, "gone": {"field": "x.y", "equals": 1}}},
        "bare": {"path": str(tmp_path / "m.json"), "format": "json"},
        "gone": {"path": "gone.parquet", "checks": {"rows": {"rows": 0}}}}}
    got = {(r.artifact, r.check): (r.actual, r.status) for r in N.run(spark, json.dumps(contract), str(tmp_path)).collect()}
    assert {k for k, v in got.items() if v[1] == "fail"} == {("t", "few"), ("t", "false"), ("m", "open"), ("m", "over"), ("gone", "exists"), ("gone", "rows")}
    assert (got["t", "rows"], got["t", "sum"], got["m", "saved"], got["m", "gone"], got["gone", "rows"]) == (("12", "pass"), ("66", "pass"), ("false", "pass"), (None, "pass"), (None, "fail"))
    whole = N.verdict(N.run(spark, contract, str(tmp_path))).first()
    assert (whole.passed, whole.failed) == (False, 6)
    assert N.run(spark, {"contract_id": "none", "artifacts": {}}, str(tmp_path)).count() == 0
