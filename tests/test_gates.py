"""Gates against plain Python versions of the reference's rules."""

import json

from statuta.operators import gates as B

ALIASES = {"normative_type": "modality", "subject": "actor", "conditions": "condition"}


def plain(text):
    """(status, reason, bad_clause, mappings, normalized) of a response, as the reference's gates give them."""
    try:
        top = json.loads(text)
    except (TypeError, ValueError):
        top = None
    fail = lambda reason, k=None: ("error", reason, k, 0, None)
    if not isinstance(top, dict) or set(B.RESPONSE) - set(top):
        return fail("missing_required_top_level_key")
    if set(top) - set(B.RESPONSE):
        return fail("unknown_top_level_field")
    if not isinstance(top["clauses"], list):
        return fail("invalid_clause_item")
    for k, c in enumerate(top["clauses"]):
        if not isinstance(c, dict):
            return fail("invalid_clause_item", k)
    out, n = [], 0
    for k, c in enumerate(top["clauses"]):
        if {"object", "original_text"} & set(c):
            return fail("unsupported_model_field", k)
        if set(c) - set(B.CLAUSE) - set(ALIASES):
            return fail("unknown_clause_field", k)
        if any(a in c and t in c for a, t in ALIASES.items()):
            return fail("alias_target_conflict", k)
        if any(c.get(a) is not None and not isinstance(c[a], dict) for a in ALIASES):
            return fail("invalid_enum", k)
        n += len(set(c) & set(ALIASES))
        named = {ALIASES.get(f, f): v for f, v in c.items()}
        out.append({f: v if f not in B.FIELDS or isinstance(v, dict) else None for f, v in named.items()})
    return ("accepted" if n else "noop", None, None, n, {**top, "clauses": out})


def test_align_responses(spark):
    span = {"value": "x", "span": [0, 1], "note": None}
    top = {"schema_version": "1", "source_id": "s", "source_text": None}
    lists = [
        [], [{}], [{"clause_id": "c", "modality": span, "actor": None, "confidence": 0.5}], [{"normative_type": span, "subject": None}, {"conditions": span, "clause_span_start": 3}],
        [{"actor": "text", "action": 7, "exception": ["x"], "condition": True}], [{"object": 1, "odd": 2}], [{}, {"original_text": None}], [{"odd": 1, "subject": span, "actor": span}],
        [{"subject": span, "actor": span}], [{"subject": None, "actor": None}], [{}, {"normative_type": "obligation"}], [{"conditions": []}, {"object": 1}], [{"object": 1}, 5], [{}, None], ["a"], [[]], ["{}"], [{"clause_text": "{}"}],
    ]
    texts = [json.dumps({**top, "clauses": x}) for x in lists]
    texts += [json.dumps({**top, "clauses": x}) for x in (None, "x", {}, 3)] + [json.dumps({**top, "clauses": [], "extra": 1}), json.dumps({**top, "clauses": [5], "extra": 1}), json.dumps(top), "{}", "[]", "null", "no json", "", None, json.dumps({"clauses": [5], "extra": 1})]
    got = B.align_responses(spark.createDataFrame(list(enumerate(texts)), "id int, answer string"), "answer").collect()
    assert len(got) == len(texts)
    for r in got:
        seen = (r.status, r.reason, r.bad_clause, r.mappings, r.normalized and json.loads(r.normalized))
        assert seen == plain(texts[r.id]), texts[r.id]
    assert len({r.reason for r in got}) == 8


def test_align_flat_conflict(spark):
    rows = [(1, '{"modality": "obligation", "normative_type": "permission"}'), (2, '{"normative_type": "permission"}'), (3, '{"modality": null, "normative_type": "permission", "x": 1}')]
    got = {r.id: (r.status, r.reason) for r in B.align_flat(spark.createDataFrame(rows, "id int, answer string"), "answer").collect()}
    assert got == {1: ("error", "alias_target_conflict"), 2: ("accepted", None), 3: ("error", "unknown_key")}


def test_snapshot_check(spark):
    rows = spark.createDataFrame([(k, f"d{k}", k) for k in range(6)], "id int, digest string, bytes long")
    registered = spark.createDataFrame([(k, "other" if k == 1 else f"d{k}", 9 if k == 2 else k) for k in range(5)], "id int, digest string, bytes long")
    assert {r.id: r.same for r in B.snapshot_check(rows, registered, "id").collect()} == {0: True, 1: False, 2: False, 3: True, 4: True, 5: False}
