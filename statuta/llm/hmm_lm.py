"""Hidden Markov language model over whole texts.

Latent states emit words. A word's emission is factored as p(class | state) p(word | class): the most frequent words
have a class each, all others share hashed classes, and p(word | class) comes from the counts of every training token.
So the Baum-Welch counts, summed over all partitions, have a fixed size, while the word counts grow with the corpus
and stay a table. score is the exact log10 likelihood of a text by the scaled forward recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm import store
from statuta.llm import words as W

STATES = 8
#: Words with a class of their own, at most; hashed classes of all others; the end of a text is class 0.
OWN = 4095
SHARED = 1024
CLASSES = 1 + OWN + SHARED
_SLOTS = 1 << 17
#: Steps of the recursion between two scalings of all texts, at most.
UNSCALED = 8
#: The end token's hash in the tables of counts.
END = -(1 << 63)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def training(id_col: Column) -> Column:
    """Rows to learn from: crc32 of the id as text leaves a remainder other than 2; a null id is not learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 != 2, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training rows of (id, text, train): 64-bit hashes of lower-cased words, and END once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in kept])
            at, where = np.unique(keys, return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in kept])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts)], names=["word", "c"])

        for batch in batches:
            for _, _, data, offsets in W.slices(batch.column(0)):
                w = W.tokenize(data, offsets, lower=True)
                keys, counts = np.unique(np.concatenate((w.hash.view(np.int64), np.full(len(offsets) - 1, END))), return_counts=True)
                kept.append((keys, counts))
                held += len(keys)
                if held > 1_000_000:  # bounds the task's memory; what is summed twice is summed again below
                    yield merged()
                    kept, held = [], 0
        if kept:
            yield merged()

    return docs.where("train").select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(W.releasing(run), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def class_of(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class of each word hash: 1 + place among the own words (ascending), else a shared class."""
    out = ((words.view(np.uint64) >> np.uint64(17)) % np.uint64(SHARED)).astype(np.int64) + (1 + OWN)
    # own words are looked up by the last bits of their hashes; the few that share these are tried in turn
    slot = lambda x: x & (_SLOTS - 1)
    order = np.argsort(slot(own), kind="stable")
    many = np.bincount(slot(own), minlength=_SLOTS).astype(np.int16)
    begin = (np.cumsum(many) - many).astype(np.int16)
    near = np.flatnonzero(many[slot(words)])
    turn = 0
    while len(near):
        at = slot(words[near])
        k = order[begin[at] + turn]
        hit = own[k] == words[near]
        out[near[hit]] = 1 + k[hit]
        turn += 1
        near = near[~hit & (many[at] > turn)]
    return out


def shared_class(word: Column) -> Column:
    """The same shared class in SQL."""
    return (F.lit(1 + OWN) + F.pmod(F.shiftrightunsigned(word, 17), F.lit(SHARED))).cast("int")


def sequences(texts: pa.Array, own: np.ndarray) -> Iterator[tuple[int, int, W.Words, np.ndarray, np.ndarray]]:
    """Per slice: rows a to b, words, classes of the tokens with each text's end, and where each text's tokens begin."""
    for a, b, data, offsets in W.slices(texts):
        w = W.tokenize(data, offsets, lower=True)
        n = len(offsets) - 1
        begins = w.first + np.arange(n + 1)
        classes = np.zeros(len(w.hash) + n, np.int64)
        classes[np.arange(len(w.hash)) + w.text_of] = class_of(w.hash.view(np.int64), own)
        yield a, b, w, classes, begins


def batches_by_length(begins: np.ndarray, width: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in groups of like length, longest first within each: (texts, lengths)."""
    size = np.diff(begins)
    order = np.argsort(-size, kind="stable")
    for k in range(0, len(order), width):
        rows = order[k : k + width]
        yield rows, size[rows]


def forward(m: Model, classes: np.ndarray, begins: np.ndarray, expect: bool) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Natural-log likelihood of each text's classes; with expect, also the expected counts (start, move, emit).

    Tokens stand step by step, a column each, longer texts first, so that a step goes on from the first columns of the one
    before. Columns are scaled where a text ends and every UNSCALED steps, within which no product leaves a double's range.
    """
    k = len(m.start)
    out = np.zeros(len(begins) - 1)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, m.emit.shape[1]))
    back = np.ascontiguousarray(m.move.T)
    for rows, size in batches_by_length(begins):
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # texts with a token at step t
        begun = np.concatenate(([0], np.cumsum(alive)))
        text = np.arange(begun[-1]) - np.repeat(begun[:-1], alive)
        c = classes[begins[:-1][rows][text] + np.repeat(np.arange(longest), alive)]
        ends = np.diff(alive, append=0) != 0
        ends[UNSCALED - 1 :: UNSCALED] = True
        bounds = begun.tolist()
        alpha = np.take(m.emit, c, axis=1)
        ahead = alpha.copy() if expect else None
        scale = np.ones(len(c))
        last = None
        for a, b, scaled in zip(bounds[:-1], bounds[1:], ends.tolist(), strict=True):
            now = alpha[:, a:b]
            now *= m.start[:, None] if last is None else back.dot(last[:, : b - a])
            if scaled:
                now /= np.add.reduce(now, axis=0, out=scale[a:b])
            last = now
        out[rows] = np.bincount(text, np.log(scale), len(rows))
        if expect:
            ahead /= scale
            for a, b, d in zip(bounds[-3::-1], bounds[-2:0:-1], bounds[:1:-1], strict=True):
                ahead[:, a : a + d - b] *= m.move.dot(ahead[:, b:d])
            # a column of ahead is emission over scale times what the later tokens say; move and emit take that with alpha
            n = int(alive[0])
            prior = np.arange(n, len(c)) - np.repeat(alive[:-1], alive[1:])
            for j in range(k):
                move[j] += ahead[:, n:].dot(alpha[j][prior])
                seen = alpha[j] * ahead[j] * scale / m.emit[j][c]
                start[j] += seen[:n].sum()
                emit[j] += np.bincount(c, seen, emit.shape[1])
    return out, [start, move * m.move, emit] if expect else None


def normal(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """Probabilities from counts, each row of emissions smoothed by one count spread as prior."""
    start, move = start + 1e-3, move + 1e-3
    emit = emit + prior[None, :]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def first_model(prior: np.ndarray, states: int, seed: int) -> Model:
    """Parameters to begin with: a seeded perturbation of the class frequencies of the whole corpus."""
    rng = np.random.default_rng(seed)
    emit = prior[None, :] * (0.3 + rng.gamma(1.0, 1.0, (states, len(prior))))
    stay = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(stay, 0.9)
    return Model(np.full(states, 1 / states), stay if states > 1 else np.ones((1, 1)), emit / emit.sum(axis=1, keepdims=True))


def baum_welch(rows: DataFrame, m: Model, own: np.ndarray, prior: np.ndarray) -> Model:
    """One round over the training rows of (text, train): each partition sums its expected counts, a groupBy those of all."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((m, own))
    k = len(m.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own = shared.value
        total = None
        for batch in batches:
            for _, _, _, classes, begins in sequences(batch.column(0), own):
                _, found = forward(m, classes, begins, True)
                total = found if total is None else [x + y for x, y in zip(total, found, strict=True)]
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["cell", "x"])

    sums = rows.where("train").select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(W.releasing(run), "cell int, x double").groupBy("cell").agg(F.sum(F.round(F.col("x") * 1e6).cast("decimal(38,0)")).cast("double").alias("x"))
    got = sums.toPandas()  # one number a parameter
    if not len(got):
        return m
    flat = np.zeros(k + k * k + k * len(prior))
    flat[got["cell"].to_numpy(int)] = got["x"].to_numpy(float) / 1e6
    return normal(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(k, -1), prior)


def chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """rows (id, train, text) with chunk, a number for each run of rows of about chunk_bytes in a partition."""
    kind = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("train", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a, b, data, _ in W.slices(batch.column(2)):
                chunk = pa.array(np.full(b - a, base + seen // chunk_bytes), pa.int64())
                seen += len(data)
                yield pa.RecordBatch.from_arrays([chunk, *(batch.column(i).slice(a, b - a) for i in range(3))], schema=kind)

    return rows.mapInArrow(W.releasing(run), "chunk long, id long, train boolean, text string")


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (chunk, word) of rows (chunk, text) that come chunk by chunk."""
    chunk, kept = None, []

    def done() -> Iterator[pa.RecordBatch]:
        words = np.unique(np.concatenate(kept))
        for k in range(0, len(words), 100_000):
            part = words[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk), pa.int64()), pa.array(part)], names=["chunk", "word"])

    for batch in batches:
        for a, b, data, offsets in W.slices(batch.column(1)):
            w = W.tokenize(data, offsets, lower=True)
            chunks = batch.column(0).slice(a, b - a).to_numpy()
            for c in np.unique(chunks).tolist():
                if c != chunk and kept:
                    yield from done()
                    kept = []
                chunk = c
                kept.append(np.unique(w.hash[np.repeat(chunks == c, w.count)].view(np.int64)))
                if len(kept) > 16:
                    kept = [np.unique(np.concatenate(kept))]
    if kept:
        yield from done()


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The n rows (word, c) of largest c, ties to the smaller word.

    A histogram of counts, 16 bins for each power of two, gives a bin below which none of them lies, so that the sort sees
    little more than n rows and not n of each partition.
    """
    place = F.floor(16 * F.log2("c"))
    bins = counts.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("bin")).collect()  # at most 16 * 63 rows
    least, seen = None, 0
    for r in bins:
        if seen < n:
            least, seen = r["bin"], seen + r["rows"]
    kept = counts if least is None else counts.where(place >= least)
    return kept.orderBy(F.desc("c"), "word").limit(n)


@dataclass
class Learned:
    """A model with the words that have a class of their own, tokens (n) and distinct words (v) of each class, and counts, the
    table (word, c) of all training tokens."""

    model: Model
    own: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray
    counts: DataFrame


def learn(rows: DataFrame, states: int, rounds: int, shares: tuple[int, ...], seed: int) -> Learned:
    """What score learns from the training rows of (id, text, train)."""
    spark = rows.sparkSession
    counts = store.table(token_counts(rows))
    top = most_frequent(counts.where(F.col("word") != END), OWN).select("word")
    own = np.sort(np.array([r.word for r in top.collect()], np.int64))  # OWN words at most
    mine = spark.createDataFrame(pd.DataFrame({"word": own, "k": np.arange(1, len(own) + 1)}), "word long, k int")
    classed = counts.join(F.broadcast(mine), "word", "left").withColumn("k", F.when(F.col("word") == END, 0).otherwise(F.coalesce("k", shared_class(F.col("word")))))
    sums = classed.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # a row a class
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[sums["k"]], class_v[sums["k"]] = sums["n"], sums["v"]
    prior = (class_n + 1) / (class_n + 1).sum()

    m = first_model(prior, states, seed)
    deal = F.xxhash64("id", F.lit(seed))
    if shares:  # the largest share is written once, so that the first rounds don't read the corpus again and again
        part = store.table(rows.where(F.col("train") & (F.pmod(deal, F.lit(min(shares))) == 0)))
        for share in shares:
            m = baum_welch(part.where(F.pmod(deal, F.lit(share)) == 0), m, own, prior)
        store.drop(part)
    for _ in range(rounds):
        m = baum_welch(rows, m, own, prior)
    return Learned(m, own, class_n, class_v, counts)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = 2, shares: tuple[int, ...] = (64, 32, 16, 8), chunk_bytes: int = 12_000_000, seed: int = 5) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are lower-cased words and one end a text; a null text is empty and has the end alone. base_score is the add-one
    unigram log10 probability with one place for unknown words, score that of the hidden Markov model, in which a word
    of class C has (c + 1) / (N_C + V_C + 1) of it. All counts cover all training rows. Baum-Welch begins from the class
    frequencies of the corpus, passes over growing shares of the training rows (one row in shares[0], then in shares[1]
    and so on, dealt by a hash of the id), then `rounds` times over all of them. Rows are scored one by one, repeated rows too; a null id counts as held out. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("train", training(F.col("id")))
    found = learn(rows, states, rounds, shares, seed)
    m, own, class_n, class_v, counts = found.model, found.own, found.class_n, found.class_v, found.counts
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = int(total[0] or 0), int(total[1])

    # words meet their counts: runs of texts as read are chunks, each chunk's distinct words join the counts, and come back to it
    held = store.table(chunked(rows.select("id", "train", "text"), chunk_bytes))
    shared = spark.sparkContext.broadcast((m, own, class_n, class_v))
    asked = held.select("chunk", "text").mapInArrow(W.releasing(distinct_words), "chunk long, word long")
    answered = asked.join(counts, "word").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("word", "c"))).alias("t"))
    known = answered.select("chunk", F.transform("t", lambda x: x["word"]).alias("words"), F.transform("t", lambda x: x["c"]).alias("counts"))
    end_count = counts.where(F.col("word") == END).select("c").first()
    end_c = end_count[0] if end_count else 0
    log_all = float(np.log10(n + (v + 1)))
    out_schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m, own, class_n, class_v = shared.value
        table = np.asarray(right["words"].iloc[0], np.int64) if len(right) else np.zeros(0, np.int64)
        times = np.asarray(right["counts"].iloc[0], np.int64) if len(right) else np.zeros(0, np.int64)
        found = []
        for a, b, w, classes, begins in sequences(pa.array(left["text"], pa.string()), own):
            words = w.hash.view(np.int64)
            c = np.zeros(len(words), np.int64)
            if len(table):
                at = np.minimum(np.searchsorted(table, words), len(table) - 1)
                c = np.where(table[at] == words, times[at], 0)
            own_class = np.delete(classes, begins[1:] - 1) if len(begins) > 1 else classes[:0]
            inside = np.log10((c + 1) / (class_n[own_class] + class_v[own_class] + 1))
            base = np.log10(c + 1) - log_all
            sum_of = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[w.first])
            ends = np.log10(end_c + 1) - log_all
            likelihood, _ = forward(m, classes, begins, False)
            end_inside = np.log10((end_c + 1) / (class_n[0] + class_v[0] + 1))
            part = left.iloc[a:b]
            found.append(pd.DataFrame({"id": part["id"].astype("Int64"), "held_out": ~part["train"].astype(bool), "n_tokens": w.count + 1, "n_known": np.diff(np.concatenate(([0], np.cumsum(c > 0)))[w.first]) + int(end_c > 0), "train_tokens": n, "base_score": sum_of(base) + ends, "score": likelihood / np.log(10) + sum_of(inside) + end_inside}))
        return pd.concat(found)

    scored = held.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(run, out_schema)
    return scored.withColumnRenamed("id", id_col)
