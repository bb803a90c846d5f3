"""Stages of the pipeline on a small corpus, each against a plain version, and the whole over the smallest tables."""

import itertools
import os
import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from statuta.llm import factorization, secrets, source_mixing  # noqa: E402
from statuta.llm.ship import ship  # noqa: E402

DATA = os.environ.get("STATUTA_TEST_DATA", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, cuts int, row int, h int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(60) for _ in range(12)]
    out = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(base)]
    out += [(20 + i, t, "a") for i, t in enumerate(base[:4])]  # exact copies
    out += [(30 + i, " ".join([*t.split()[:-1], "other"]), "b") for i, t in enumerate(base[2:7])]  # near copies
    out += [(40, None, "a"), (41, "", "b"), (42, " \t ", None), (43, "few words", "a"), (44, "Few Words", "b"), (None, base[0], "a"), (None, "no id", "b")]
    out += [(50, text(70), "a"), out[0], out[0]]
    out += [(50, text(40), "b")]  # another text under an id that is there
    out += [(60, f"{text(30)} password = abcdefghijklmnop {text(5)}", "a"), (61, "user = bob pwd: hunter2 " + text(20), "b")]
    return out


def key(r):
    return tuple(str(x) for x in r)


def test_near_copies(spark, rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if any(u and v and 100 * len(u & v) >= 80 * len(u | v) for u in sets[a] for v in sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    want = Counter()
    for i, t, s in rows:
        if i is None:
            want[(i, t)] += 1
        elif root[i] == i:
            want[(i, t)] = 1
    got = corpus_pipeline.near_copies(spark, make(spark, rows), DATA)
    assert got.columns == make(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert len(want) < len({(i, t) for i, t, _ in rows})


def test_quality(spark, rows):
    docs = make(spark, rows)
    ship(spark)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(12)], "doc_id long, quality int, toxic int")
    model = factorization.fit(factorization.training_rows(docs, labels))

    def score(t, n):  # every pair of features
        data = np.frombuffer((t or "").encode(), np.uint8)
        ids, x, _ = factorization.featurize(data, np.array([0, len(data)]), np.array([float(n or 0)]))
        v = model.v[ids].astype(float) * x[:, None]
        pairs = sum(v[i] @ v[j] for i in range(len(ids)) for j in range(i))
        return 1 / (1 + np.exp(-(model.w0 + model.w[ids] @ x + pairs)))

    scores = {(i, t): score(t, t and len(t)) for i, t, _ in rows}
    cut = float(np.median(list(scores.values())))
    assert min(abs(s - cut) for s in scores.values() if s != cut) > 1e-7
    got = factorization.accepted(docs, labels, threshold=cut - 1e-9).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows if scores[i, t] >= cut - 1e-9)
    assert corpus_pipeline.quality(spark, docs, DATA).schema == docs.schema


def test_secrets(spark, rows):
    docs = make(spark, rows)
    spans = {r.text: r.s for r in docs.select("text").distinct().selectExpr("text", "text as doc_id").transform(lambda d: secrets.scan(d)).withColumnRenamed("doc_id", "text").collect()}

    def clean(t):
        out, at = "", 0
        for s in sorted(spans[t], key=lambda s: (s.start, s.stop)) if t else ():
            if s.start >= at:
                out += t[at : s.start] + "[SECRET]"
            at = max(at, s.stop)
        return t if not out else out + t[at:]

    got = corpus_pipeline.without_secrets(spark, docs, DATA).collect()
    assert Counter((r.doc_id, r.text, r.n_chars, r.h) for r in got) == Counter((i, clean(t), None if t is None else len(clean(t)), 3) for i, t, _ in rows)
    assert sum("[SECRET]" in (r.text or "") for r in got) == 2


def test_mixing(spark, rows):
    docs = make(spark, rows)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    taken = Counter()
    for r in source_mixing.taken(docs).collect():
        taken[r.doc_id] += r.taken
    got = corpus_pipeline.mixed(spark, docs, DATA).collect()
    words = Counter()
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(split(t))
    for r in got:
        words[r.doc_id] += len(split(r.text))
        left = iter(split(r.text))
        assert any(all(w in it for w in split(r.text)) for it in map(iter, texts[r.doc_id])), next(left)  # words of one text, in order
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_mixing_plans_are_small(spark, rows):
    """Draws are made once, and neither they nor the choice of blocks is planned together with the documents."""
    docs = make(spark, rows)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(source_mixing.mix(docs)["uses"]).count("MapInPandas") == 1
    whole = plan(source_mixing.mixed_documents(docs))
    assert whole.count("MapInPandas") == 0 and whole.count("Join") == 1 and whole.count("Window") <= 2


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[x for x, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, rows, stage):
    empty = make(spark, rows).limit(0)
    got = stage[1](spark, empty, DATA)
    assert got.count() == 0 and (stage is corpus_pipeline.STAGES[-1] or got.columns == empty.columns)


def test_whole(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left, now = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns and 0 < now.count() <= left, name
        left = now.count()
    got = corpus_pipeline.run(spark, DATA)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.where("not round_trip").count() == 0
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
