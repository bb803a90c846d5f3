"""Packing, divergence of sources and fill-in-middle against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("statuta.llm")
from pyspark.sql import functions as F  # noqa: E402

from statuta.llm import best_fit_packing, fill_in_middle, source_divergence  # noqa: E402
from statuta.llm.queries import TOKENIZER_FILE, op13_fill_in_middle  # noqa: E402
from statuta.llm.ship import ship  # noqa: E402

#: Columns that the operators' own results and steps are named like.
SCHEMA = "doc_id long, text string, lang string, source string, length long, piece int, n long, form string, output string, part string, rank int, value long, item string, g long, h long"
ALPHABET = ["a", "Zz", "é", "ß", "日", "😀", "\n", " ", "0", "@", "[", "`", "{", "\0", "\x7f", "abcdefghij", "word "]


def table(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names clash."""
    ship(spark)
    return spark.createDataFrame([(*r, 7, 7, 7, "x", "x", "x", 7, 7, "x", 7, 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randrange(60))) for _ in range(150)]
    texts += [None, "", " ", "A", "\n", "<P>", "x<S>y", "<M", "<", "<<P", "S>x", "tokens of a common kind " * 900, "é" * 5000]
    out = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "no id", "en", "a"), (None, None, None, None), (10**15, "far", "en", "a")]


def arranged(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), output


def test_fill_in_middle(spark, rows):
    got = fill_in_middle.transform(table(spark, rows)).withColumn("text", fill_in_middle.restored()).collect()
    want = [arranged(i, t) for i, t, *_ in rows]
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(table(spark, [])).count() == 0


def test_fill_in_middle_hashes_large_and_negative_ids(spark):
    rows = [(-5, "a b c", "en", "a"), (2**63 - 1, "a b c", "en", "a")]
    assert {tuple(r) for r in fill_in_middle.transform(table(spark, rows)).collect()} == {arranged(i, t) for i, t, *_ in rows}


def test_units_over_several_blocks():
    text = "abc é 日😀\n" * 300_000  # 5 MB, past five blocks of words
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    found = fill_in_middle.Units(text.encode())
    assert found.n == len(units)
    chars = np.concatenate(([0], np.cumsum([len(u) for u in units])))
    for k in (0, 1, 7, 1_000_000, len(units) - 1, len(units)):
        begin = text[: chars[k]]
        assert (found.border(k), found.characters(found.border(k))) == (len(begin.encode()), len(begin))


@pytest.mark.parametrize("size", range(20))
def test_units_of_short_texts(size):
    rnd = random.Random(size)
    for _ in range(40):
        text = "".join(rnd.choices(ALPHABET, k=size))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        found = fill_in_middle.Units(text.encode())
        assert found.n == len(units)
        assert [found.border(k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def test_fill_in_middle_query(spark):
    made = op13_fill_in_middle(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert made.join(docs, "doc_id").where(F.col("restored_sha256") != F.sha2(F.col("text").cast("binary"), 256)).count() == 0
    assert made.count() == docs.count()


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(TOKENIZER_FILE).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing(spark, rows, capacity):
    made = best_fit_packing.pack_documents(table(spark, rows), TOKENIZER_FILE, capacity=capacity, with_ids=True)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = made.collect()
    want = []
    for i, t, *_ in rows:
        ids = ids_of(t)
        cuts = [0, len(ids)] if len(ids) <= capacity else [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append(r)
    for found in held.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == np.cumsum([0, *(r.length for r in found[:-1])]).tolist()
        assert sum(r.length for r in found) <= capacity and sum(3 * r.length > capacity for r in found) <= 2
    least = max(-(-sum(r.length for r in got) // capacity), large_alone([r.length for r in got], capacity))
    assert least <= len(held) <= least + 1
    whole = {r.sequence_id: r.ids for r in best_fit_packing.sequences(made).collect()}
    assert whole == {k: [x for r in found for x in r.ids] for k, found in held.items()}


def large_alone(lengths, capacity):
    """Sequences that the items above a third of the capacity need: at most two fit together, so all but a largest matching."""
    large = sorted(n for n in lengths if 3 * n > capacity)
    low, high, pairs = 0, len(large) - 1, 0
    while low < high:
        if large[low] + large[high] <= capacity:
            low, pairs = low + 1, pairs + 1
        high -= 1
    return len(large) - pairs


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((best if best is not None else capacity) - n)
    return len(gaps)


def test_packing_over_the_histogram_equals_item_by_item():
    rnd = random.Random(5)
    for _ in range(60):
        capacity = rnd.randrange(3, 60)
        counts = {rnd.randint(1, capacity): rnd.randrange(40) for _ in range(rnd.randrange(1, 30))}
        items = [n for n, k in counts.items() for _ in range(k)]
        runs = best_fit_packing.packed(counts, capacity)
        assert Counter({n: k for n, k in counts.items() if k}) == sum((Counter({n: each * r.bins}) for r in runs for n, each in r.holds), Counter())
        assert all(r.gap == capacity - sum(n * each for n, each in r.holds) >= 0 and r.bins for r in runs)
        assert sum(r.bins for r in best_fit_packing.matched(counts, capacity)) == large_alone(items, capacity)
        used = sum(r.bins for r in runs)
        assert used <= best_fit_decreasing(items, capacity) + 1
        seen = defaultdict(list)
        for length, begin, end, each, sequence, offset in best_fit_packing.slots(runs):
            for k in range(begin, end):
                place = k - begin
                seen[sequence + place // each].append((offset + place % each * length, length))
        assert sorted(seen) == list(range(used))
        for found in seen.values():
            found.sort()
            assert [o for o, _ in found] == np.cumsum([0, *(n for _, n in found[:-1])]).tolist()


def test_packing_plan_is_bounded_by_the_capacity():
    runs = best_fit_packing.packed({k: 10**9 // k for k in range(1, 1025)}, 1024)
    assert len(best_fit_packing.slots(runs)) < 8192


def test_packing_of_nothing(spark):
    assert best_fit_packing.pack_documents(table(spark, []), TOKENIZER_FILE).count() == 0


def test_parts_of_a_long_text_give_its_ids():
    rnd = random.Random(6)
    text = "".join(rnd.choices([*ALPHABET, " two words", "  ", "it's ", "<|endoftext|>", "\n\n"], k=4000))
    cut = best_fit_packing.parts(text, 300)
    assert len(cut) > 20 and "".join(cut) == text
    assert [x for part in cut for x in ids_of(part)[:-1]] == ids_of(text)[:-1]


def test_ranked_encoder_gives_the_ids_of_the_tokenizer():
    encoder, rnd = best_fit_packing.Encoder(open(TOKENIZER_FILE).read()), random.Random(9)
    assert encoder.ranked is not None
    odd = [chr(c) for c in [*range(0x250), 0x2028, 0x3000, 0x200B, 0x660, 0x1D7D8, 0x10FFFF, 0x301, 0xFEFF]]
    texts = ["".join(rnd.choices([*odd, " the", "'s", "'ll", "  ", "<|endoftext|>" if k % 50 == 0 else " end", "words" * 5], k=60)) for k in range(300)]
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts += ["\n".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)} .{chr(c)}, x" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    texts += [c * 300_000 for c in (" ", "\n", "a", "é", "!", "'s", " \n\t")]
    for text in texts:
        assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_by_themselves():
    from public_tokenizers import path

    encoder = best_fit_packing.Encoder(open(path("word_bpe_49k.json")).read())
    assert encoder.ranked is None and encoder.encode("Two words") == encoder.tokenizer.encode("Two words", add_special_tokens=False).ids


def diverging(rows, min_docs):
    """The divergence of groups by plain counting over dense rows."""
    docs = [(lang or "", source or "", [t.translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, k in seen.items() if k >= min_docs)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept]

        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted(((-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode(), o) for o in counts if o != s))
            terms = sorted((-(x - y), t.encode(), t) for x, y, t in zip(p[s], q, kept, strict=True) if counts[s][t] and x > y)[:50]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)} | {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms)}
    return out


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(7)
    words = ["alpha", "Beta", "übung", "日本", "é", "x", "gamma1delta", "RARE"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(60)) + [rnd.choice(["alpha"] * 5 + ["\x00-", ""])]), rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["s", "s", "s", "S", "ü", "", None, "t", "u"])) for i in range(260)]
    # a group without terms, one whose language keeps none, a null text, repeated rows, one very long text
    return [*rows, (900, "12 34", "en", "digits"), (901, None, "en", "none"), (902, "once", "xx", "a"), (903, "", "xx", "b"), (None, None, None, None), rows[0], rows[0], (904, "alpha beta " * 60_000, "en", "long")]


def test_divergence(spark, spoken):
    for min_docs in (5, 30):
        got = {tuple(r) for r in source_divergence.divergence(table(spark, spoken), min_docs=min_docs).collect()}
        want = diverging(spoken, min_docs)
        assert got == want
        assert {x[1] for x in want if x[0] == "en" and x[2] == "pair"} >= {"digits", "none", "", "long"}
        assert all(v == 0 for lang, _, part, _, v, _ in got if lang == "xx")


def test_divergence_does_not_depend_on_blocks(spark, spoken, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK", 50)
    monkeypatch.setattr(source_divergence, "LARGE", 60)
    monkeypatch.setattr(source_divergence, "CELLS", 20)
    assert {tuple(r) for r in source_divergence.divergence(table(spark, spoken), min_docs=5).collect()} == diverging(spoken, 5)


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(table(spark, [])).count() == 0


def test_term_counts_hand_on_what_they_hold(spark, spoken, monkeypatch):
    docs = table(spark, spoken).select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    whole = {tuple(r) for r in source_divergence.term_counts(docs).collect()}
    monkeypatch.setattr(source_divergence, "HELD", 10)
    assert {tuple(r) for r in source_divergence.term_counts(docs).collect()} == whole


def test_shares_of_very_large_counts(spark):
    row = spark.range(1).select(source_divergence.share(F.lit(10**17), F.lit(3 * 10**17), F.lit(10**9)).alias("p"), source_divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert (row.p, row.none) == (1 + 10**9 * (10**17 + 5) // (3 * 10**17 + 5 * 10**9), None)


def test_accumulators_equal_dense_distances():
    rng = np.random.default_rng(8)
    import pandas as pd

    base = rng.integers(1, 50, 6)
    dense = np.where(rng.random((6, 40)) < 0.4, base[:, None] + rng.integers(0, 90, (6, 40)), -1)
    g, t = np.nonzero(dense >= 0)
    index = pd.DataFrame({"term": [f"t{x}" for x in t], "row": g, "p": dense[g, t]}).sample(frac=1, random_state=1)
    acc = source_divergence.accumulate(index, base, np.arange(6))
    filled = np.where(dense >= 0, dense, base[:, None])
    for a, b in itertools.combinations(range(6), 2):
        neither = 40 - (dense[a] >= 0).sum() - (dense[b] >= 0).sum()
        assert acc[a, b] + acc[b, a] + neither * abs(base[a] - base[b]) == np.abs(filled[a] - filled[b]).sum()
