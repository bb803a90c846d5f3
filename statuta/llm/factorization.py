"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part takes linear time as
(|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2. It is fitted on a bounded sample of labelled rows and scores every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm import words as W
from statuta.llm.quality_rules import Texts, share

WORD_BITS = 15
#: Buckets of each structure statistic and of the metadata.
BUCKETS = 16
_STATS = 8
FEATURES = (1 << WORD_BITS) + _STATS * BUCKETS


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray


def _bucket(x: np.ndarray) -> np.ndarray:
    """A share in 0..1 in BUCKETS steps, fine near 0."""
    return np.minimum(np.sqrt(np.clip(x, 0, 1)) * BUCKETS, BUCKETS - 1).astype(np.int64)


def featurize(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of each text, and where those of each text begin.

    Words weigh 1 + log(count), scaled to length 1 over the text; each of eight statistics is one bucket of weight 0.5:
    words, mean length of words, symbols, repeated words, repeated lines, upper-case words, distinct words, and the
    n_chars column (bucket 0 where it is null).
    """
    t = Texts(data, offsets)
    w, n = t.words, t.n_words()
    rows = len(n)
    mask = np.uint64((1 << WORD_BITS) - 1)
    key = np.sort((w.text_of.astype(np.uint64) << np.uint64(WORD_BITS)) | (w.hash & mask))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    times = np.diff(np.concatenate((at, [len(key)])))
    key = key[at]
    owner, word = (key >> np.uint64(WORD_BITS)).astype(np.int64), (key & mask).astype(np.int64)
    value = 1 + np.log(times)
    length = np.sqrt(np.bincount(owner, value * value, rows))
    value = value / length[owner]
    log = lambda x: np.minimum(np.log2(1 + x), BUCKETS - 1).astype(np.int64)
    seen, again = t.lines()
    stats = [log(n), log(share(t.word_chars(), n)), _bucket(share(t.n_symbols(), n)), _bucket(share(t.n_repeat_words(), n)), _bucket(share(again, seen)), _bucket(share(t.n_upper_words(), n)), _bucket(share(np.bincount(owner, minlength=rows), n)), log(np.maximum(n_chars, 0))]
    ids = np.concatenate([word, *((1 << WORD_BITS) + k * BUCKETS + s for k, s in enumerate(stats))])
    values = np.concatenate([value, np.full(_STATS * rows, 0.5)])
    owners = np.concatenate([owner, np.tile(np.arange(rows), _STATS)])
    order = np.argsort(owners, kind="stable")
    return ids[order], values[order].astype(np.float32), np.searchsorted(owners[order], np.arange(rows + 1))


def raw_scores(m: Model, ids: np.ndarray, values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """w0 + linear + pairwise part of each row, and sum_i v_i x_i; every row has features."""
    vx = m.v[ids] * values[:, None]
    sums = np.add.reduceat(vx, begins[:-1], axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), begins[:-1])
    linear = np.add.reduceat(m.w[ids] * values, begins[:-1])
    return m.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(ids: np.ndarray, values: np.ndarray, begins: np.ndarray, y: np.ndarray, rank: int, epochs: int, batch: int, rate: float, decay: float, seed: int) -> Model:
    """Logistic loss by Adagrad over shuffled batches; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    m = Model(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, rank)).astype(np.float32))
    g0, gw, gv = 1e-6, np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, rank), 1e-6, np.float32)
    size = np.diff(begins)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            rows = order[k : k + batch]
            n = size[rows]
            b = np.concatenate(([0], np.cumsum(n)))
            at = np.arange(b[-1]) + np.repeat(begins[rows] - b[:-1], n)
            i, x = ids[at], values[at]
            raw, sums = raw_scores(m, i, x, b)
            err = (sigmoid(raw) - y[rows]) / len(rows)
            e = np.repeat(err, n)
            vi = m.v[i]
            dv = (e * x)[:, None] * (np.repeat(sums, n, axis=0) - vi * x[:, None])
            touched, where = np.unique(i, return_inverse=True)
            tw = np.bincount(where, e * x).astype(np.float32) + decay * m.w[touched]
            tv = np.stack([np.bincount(where, dv[:, f]) for f in range(rank)], axis=1).astype(np.float32) + decay * m.v[touched]
            g0 += float(err.sum()) ** 2
            m.w0 -= rate * float(err.sum()) / g0**0.5
            gw[touched] += tw * tw
            gv[touched] += tv * tv
            m.w[touched] -= rate * tw / np.sqrt(gw[touched])
            m.v[touched] -= rate * tv / np.sqrt(gv[touched])
    return m


def fit(rows: DataFrame, max_rows: int = 4000, rank: int = 8, epochs: int = 6, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> Model:
    """A model from rows (id, text, n_chars, label 0 to 1).

    At most max_rows rows are used, those of the smallest hashes of their ids, of whatever length: a row has at most
    FEATURES features, so the fit has a bounded size. Classes are drawn as they come. Without rows the model scores 0.5
    everywhere.
    """
    kind = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("label", pa.float64()), ("ids", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a, b, data, offsets in W.slices(part.column(3)):
                i, x, begins = featurize(data, offsets, chars(part.column(4).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([*(part.column(k).slice(a, b - a) for k in range(3)), W.lists(i, begins, pa.int32()), W.lists(x, begins, pa.float32())], schema=kind)

    # features are made where the texts are; what is ordered and sent on is bounded
    made = rows.select(F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"), "label", "text", "n_chars").mapInArrow(W.releasing(run), "h long, t long, label double, ids array<int>, vals array<float>")
    got = made.orderBy("h", "label", "t").limit(max_rows).toArrow().sort_by([("h", "ascending"), ("label", "ascending"), ("t", "ascending")])
    if not got.num_rows:
        return Model(0.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, rank), np.float32))
    ids = got.column("ids").combine_chunks()
    begins = np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths())))).astype(np.int64)
    return train(ids.flatten().to_numpy().astype(np.int64), got.column("vals").combine_chunks().flatten().to_numpy(), begins, got.column("label").to_numpy(), rank, epochs, batch, rate, decay, seed)


def chars(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Per row: id and score, 0 to 1, higher where label 1 is likelier; empty and null texts have their statistics alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES * (rank + 1) numbers, whatever the data
    kind = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in batches:
            for a, b, data, offsets in W.slices(part.column(1)):
                raw, _ = raw_scores(m, *featurize(data, offsets, chars(part.column(2).slice(a, b - a))))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(sigmoid(raw.astype(np.float64)))], schema=kind)

    n_chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), n_chars.alias("n"))
    return rows.mapInArrow(W.releasing(run), "id long, score double").withColumnRenamed("id", id_col)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", folds: int = 5, max_rows: int = 4000) -> DataFrame:
    """Rows of max_rows labelled ids outside the held-out fold, those of the smallest hashes.

    An id labelled more than once has the mean of its labels. The chosen ids are bounded by max_rows, so they are
    broadcast and the texts stay where they are read.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    chosen = known.where(~held_out(F.col("id"), folds)).groupBy("id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    n_chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), n_chars.alias("n_chars"))
    return rows.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")


def held_out(id_col, folds: int = 5):
    """Whether crc32 of the id as text leaves remainder 0; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5, max_rows: int = 4000) -> DataFrame:
    """Per row: id, held_out, score and predicted (1 where score >= threshold).

    Learns from labelled rows outside the held-out fold alone. Repeated rows get equal scores, null ids stay null and
    count as held out, extra columns are ignored, and an empty table gives an empty result.
    """
    model = fit(training_rows(docs, labels, id_col, text_col, folds=folds, max_rows=max_rows), max_rows)
    found = score(docs, model, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.3, folds: int = 5, max_rows: int = 4000) -> DataFrame:
    """The rows of docs with a score of threshold or more, with their columns as they are.

    Rows are judged one by one, as classify does: repeated rows share their verdict, a null text counts as an empty one and null
    ids do not matter. An empty table gives an empty one; columns may have any names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(training_rows(docs, labels, id_col, text_col, chars_col, folds=folds, max_rows=max_rows), max_rows))
    at, size_at = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in batches:
            for a, b, data, offsets in W.slices(part.column(at)):
                rows = part.slice(a, b - a)
                n_chars = chars(rows.column(size_at)) if size_at is not None else np.zeros(b - a)
                raw, _ = raw_scores(m, *featurize(data, offsets, n_chars))
                yield rows.filter(pa.array(sigmoid(raw.astype(np.float64)) >= threshold))

    return docs.mapInArrow(W.releasing(run), docs.schema)
