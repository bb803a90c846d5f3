"""SentencePiece encoding and decoding: the segmentation of largest total score, by a max-plus parallel scan.

The pieces and scores of a SentencePiece model are read as a unigram model: of all ways to cut a text into pieces, the
one with the largest sum of scores is taken; a character of no piece becomes its UTF-8 bytes. Texts of up to `giant`
characters are segmented in one go. A longer text is split into chunks; each gives a matrix whose entry (i, j) is the
best score of a path that enters i characters into the chunk and leaves by a piece that reaches j characters past it.
Max-plus products of matrices are associative, so they are combined by segments of chunks, and each chunk is then
backtraced on its own between its known entry and exit.

Of segmentations of equal score one is chosen by the same rule however a text is cut: seen from the end, each piece
starts as early as it can. Beside its scores a matrix therefore ranks, for each exit, its entries by that order, and
products settle ties by the ranks and rank anew.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm import store
from statuta.llm import words as W

#: How far a chunk boundary may move back to stand before a blank, where no piece can cross.
SNAP = 2048
#: Chunks whose matrices one task multiplies.
SEGMENT = 128
NEVER = -(1 << 60)
NO_PIECE = (1 << 20) - 1


@dataclass
class Vocabulary:
    """Pieces with integer scores; blanks stand for themselves here. Byte pieces are kept apart.

    trie leads through the characters of pieces to "", which holds a piece's score and id. fragment matches runs between which
    no piece can stretch: a blank begins one, and so does a change between the characters that share pieces with letters
    and all others.
    """

    ids: dict[str, int]
    scores: dict[str, int]
    byte_ids: list[int]
    unknown: int
    longest: int
    trie: dict = field(default_factory=dict)
    texts: dict[int, bytes] = field(default_factory=dict)
    fragment: re.Pattern = None

    def __post_init__(self) -> None:
        for piece, score in self.scores.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (score, self.ids[piece])
        self.texts = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        near: dict[str, set[str]] = {}
        for piece in self.ids:
            for x, y in itertools.pairwise(piece.lstrip(" ")):
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        with_letters = {c for piece in self.ids for c in piece if c.isalpha()}
        todo = list(with_letters)
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in with_letters:
                    with_letters.add(y)
                    todo.append(y)
        own = "[" + re.escape("".join(sorted(with_letters - {" "}))) + "]" if with_letters - {" "} else "(?!)"
        other = "[^ " + own[1:] if own != "(?!)" else "[^ ]"
        self.fragment = re.compile(f" *{own}+| *{other}+| +")


def load(model_file: str) -> Vocabulary:
    """The vocabulary of a model file with identity normalization, a dummy prefix and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids, scores, byte_ids = {}, {}, [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text = piece.replace("▁", " ")
            if re.search("[^ ] ", text):
                raise ValueError("a piece holds a blank after other characters")
            ids[text], scores[text] = i, int(sp.get_score(i))
    return Vocabulary(ids, scores, byte_ids, min(scores.values()) - 10, max(map(len, ids)))


def viterbi(v: Vocabulary, s: str, n: int, entry: dict[int, int]) -> tuple[list[int], list[int]]:
    """Best score of each position of s, and the last piece to it, from scored entries; pieces start before n.

    A last piece is its start and its id in one number, start * 2^20 + id, or id 2^20 - 1 for a character of no piece.
    Of equal scores the piece that starts first wins. Entries count as arrivals from before.
    """
    size = min(len(s), n + v.longest - 1)
    best, back = [NEVER] * (size + 1), [-1] * (size + 1)
    for i, x in entry.items():
        if i <= size:
            best[i] = x
    root, unknown = v.trie, v.unknown
    for p in range(min(n, size)):
        now = best[p]
        if now == NEVER:
            continue
        q, alone, at = p, True, p << 20
        node = root.get(s[p])
        while node is not None:
            q += 1
            if "" in node:
                score, i = node[""]
                if q == p + 1:
                    alone = False
                if now + score > best[q]:
                    best[q], back[q] = now + score, at | i
            if q == size:
                break
            node = node.get(s[q])
        if alone and now + unknown > best[p + 1]:
            best[p + 1], back[p + 1] = now + unknown, at | NO_PIECE
    return best, back


def steps(back: list[int], start: int, stop: int) -> list[int]:
    """Starts of the pieces between two positions on the best path, last piece first, then -1 for the arrival at start."""
    out: list[int] = []
    while stop > start:
        stop = back[stop] >> 20
        out.append(stop)
    out.append(-1)
    return out


def ranked(keys: list[list[int] | None]) -> list[int]:
    """The place of each key in ascending order; of None, behind all."""
    order = sorted((i for i, x in enumerate(keys) if x is not None), key=lambda i: keys[i])
    out = [len(keys)] * len(keys)
    for r, i in enumerate(order):
        out[i] = r
    return out


def path(v: Vocabulary, s: str, back: list[int], start: int, stop: int) -> bytes:
    """Ids of the pieces between two positions on the best path, four bytes each."""
    out: list[int] = []
    while stop > start:
        i = back[stop] & NO_PIECE
        stop = back[stop] >> 20
        if i != NO_PIECE:
            out.append(i)
        else:
            out.extend(v.byte_ids[b] for b in reversed(s[stop].encode()))
    out.reverse()
    return array("i", out).tobytes()


class Scores(dict):
    """Best score of a fragment, kept while there is room."""

    def __init__(self, v: Vocabulary, room: int):
        super().__init__()
        self.v, self.room = v, room

    def __missing__(self, s: str) -> int:
        best, _ = viterbi(self.v, s, len(s), {0: 0})
        if len(s) < 64:
            if len(self) >= self.room:
                self.clear()
            self[s] = best[len(s)]
        return best[len(s)]


class Segmenter(dict):
    """Ids of a fragment (blanks, then others), four bytes each, kept while there is room."""

    def __init__(self, v: Vocabulary, room: int = 400_000):
        super().__init__()
        self.v, self.room = v, room
        self.scores = Scores(v, room)

    def __missing__(self, s: str) -> bytes:
        _, back = viterbi(self.v, s, len(s), {0: 0})
        found = path(self.v, s, back, 0, len(s))
        if len(s) < 64:
            if len(self) >= self.room:
                self.clear()
            self[s] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.v.fragment.findall(" " + text))) if text else b"", np.int32)


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of an encoding: pieces and bytes in a row, without the blank that encoding puts in front."""
    return b"".join([v.texts[i] for i in ids])[1:].decode()


def cuts(s: str, n: int) -> list[int]:
    """Positions 0 < p < n that no piece crosses: a blank after another character."""
    return [m.start() + 1 for m in re.finditer(r"[^ ](?= )", s[: n + 1]) if m.start() + 1 < n]


def transfer(seg: Segmenter, s: str, n: int) -> np.ndarray:
    """The scores and ranks, as (2, k, k), of a chunk of n characters; s goes on for up to longest - 1 characters past it."""
    v, k = seg.v, seg.v.longest
    m = np.full((2, k, k), NEVER, np.int64)
    at = cuts(s, n)

    def leave(best: list[int], upto: int) -> list[int]:
        return [best[upto + j] if upto + j < len(best) else NEVER for j in range(k)]

    if not at:
        found = [viterbi(v, s, n, {i: 0}) for i in range(min(k, n + 1))]
        for i, (best, _) in enumerate(found):
            m[0, i] = leave(best, n)
        for j in range(k):  # the paths of one exit at a time, which are as long as the chunk
            m[1, :, j] = ranked([steps(found[i][1], i, n + j) if i < len(found) and m[0, i, j] != NEVER else None for i in range(k)])
        return m
    first, last = at[0], at[-1]
    heads = [viterbi(v, s[:first], first, {i: 0}) if i <= first else None for i in range(k)]
    head = [NEVER if x is None else x[0][first] for x in heads]
    middle = sum(map(seg.scores.__getitem__, v.fragment.findall(s[first:last])))
    tail = leave(viterbi(v, s[last:], n - last, {0: 0})[0], n - last)
    for i in range(k):
        for j in range(k):
            if head[i] != NEVER and tail[j] != NEVER:
                m[0, i, j] = head[i] + middle + tail[j]
    # every path passes the first cut, so entries rank alike for all exits
    m[1] = np.array(ranked([None if x is None or x[0][first] == NEVER else steps(x[1], i, first) for i, x in enumerate(heads)]), np.int64)[:, None]
    return m


def choose(scores: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Along the axis before the last, the place of the largest score, of equal ones that of the smallest rank."""
    tied = scores == scores.max(axis=-2, keepdims=True)
    return np.argmin(np.where(tied, ranks, np.iinfo(np.int64).max), axis=-2)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices with ranks."""
    through = a[0][:, :, None] + b[0][None, :, :]
    m = choose(through, b[1][None, :, :])
    score = np.maximum(np.take_along_axis(through, m[:, None, :], axis=1)[:, 0, :], NEVER)
    # paths differ in b first, then in a
    key = np.take_along_axis(b[1], m, axis=0) * (len(m) + 1) + np.take_along_axis(a[1], m, axis=1)
    key = np.where(score == NEVER, np.iinfo(np.int64).max, key)
    return np.stack((score, np.argsort(np.argsort(key, axis=0, kind="stable"), axis=0)))


def backtrace(seg: Segmenter, s: str, n: int, entry: int, leave: int) -> bytes:
    """Ids of the pieces that start in a chunk, entered at entry and left `leave` characters past its end, four bytes each."""
    v, at = seg.v, [p for p in cuts(s, n) if p > entry]
    if entry >= n:
        return b""
    if not at:
        part = s[entry : n + leave]
        _, back = viterbi(v, part, n - entry, {0: 0})
        return path(v, part, back, 0, len(part))
    inside = b"".join(map(seg.__getitem__, itertools.chain(v.fragment.findall(s[entry : at[0]]), v.fragment.findall(s[at[0] : at[-1]]))))
    part = s[at[-1] : n + leave]
    _, back = viterbi(v, part, n - at[-1], {0: 0})
    return inside + path(v, part, back, 0, len(part))


def traces(seg: Segmenter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, k, ids, same) of chunks (row, k, n, s, entry, leave), same being whether the ids decode to the chunk's part of the text.

    A batch of chunks is long: their ids, as Python numbers some twenty times the text, are held for one chunk alone.
    """
    v = seg.v
    for batch in batches:
        for a, b, _, _ in W.slices(batch.column(3)):
            row, k, sizes, texts, entries, leaves = (batch.column(i).slice(a, b - a) for i in range(6))
            found, same = [], []
            for s, n, i, j in zip(texts, sizes.to_pylist(), entries.to_pylist(), leaves.to_pylist(), strict=True):
                s = s.as_py()
                found.append(np.frombuffer(backtrace(seg, s, n, i, j), np.int32))
                same.append(b"".join([v.texts[t] for t in found[-1].tolist()]).decode() == s[i : n + j])
            lists = W.lists(np.concatenate(found), np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([row, k, lists, pa.array(same, pa.bool_())], names=["row", "k", "ids", "same"])


def boundaries(t: str, chunk: int) -> list[int]:
    """Where chunks of about `chunk` characters begin, and the end: before a blank where one is near, else as they fall."""
    snap = min(SNAP, chunk // 2)
    out = [0]
    for at in range(chunk, len(t), chunk):
        window = t[at - snap : at]
        i = window.rfind(" ")
        while i > 0 and window[i - 1] == " ":
            i = window.rfind(" ", 0, i)
        out.append(at - snap + i if i > 0 else at)
    return [*out, len(t)]


def chunked(rows: DataFrame, chunk: int, longest: int) -> DataFrame:
    """(row, k, n, s) of rows (row, text): chunks of about `chunk` characters with what follows each, cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, t = batch.column(0)[i].as_py(), " " + batch.column(1)[i].as_py()
                ends = boundaries(t, chunk)
                for g in range(0, len(ends) - 1, 64):
                    some = list(itertools.pairwise(ends[g : g + 65]))
                    columns = [pa.array([row] * len(some), pa.int64()), pa.array(range(g, g + len(some)), pa.int32()), pa.array([b - a for a, b in some], pa.int32()), pa.array([t[a : b + longest - 1] for a, b in some], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "k", "n", "s"])

    return rows.select("row", "text").mapInArrow(W.releasing(run), "row long, k int, n int, s string")


def scan(spark, chunks: DataFrame, shared, longest: int) -> DataFrame:
    """(row, k, entry, leave) of each chunk on the best path of its text."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(shared.value)
        for batch in batches:
            for a, b, _, _ in W.slices(batch.column(3)):
                row, k, sizes, texts = (batch.column(i).slice(a, b - a) for i in range(4))
                found = [transfer(seg, s, n).tobytes() for s, n in zip(texts.to_pylist(), sizes.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([row, k, pa.array(found, pa.binary())], names=["row", "k", "m"])

    def read(m: bytes) -> np.ndarray:
        return np.frombuffer(m, np.int64).reshape(2, longest, longest)

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        total = read(part["m"].iloc[0])
        for m in part["m"].iloc[1:]:
            total = product(total, read(m))
        return pd.DataFrame({"row": [part["row"].iloc[0]], "g": [part["g"].iloc[0]], "m": [total.tobytes()]})

    def walk(ms: list[np.ndarray], start: np.ndarray, leave: int) -> list[tuple[np.ndarray, int, int]]:
        """Per matrix the scores at its entry, and its entry and exit on the best path that ends in `leave`."""
        before = [start]
        for m in ms:
            before.append(np.maximum((before[-1][:, None] + m[0]).max(axis=0), NEVER))
        out = []
        for k in range(len(ms) - 1, -1, -1):
            entry = int(choose((before[k] + ms[k][0, :, leave])[:, None], ms[k][1, :, leave][:, None])[0])
            out.append((before[k], entry, leave))
            leave = entry
        return out[::-1]

    def over_segments(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("g")
        start = np.full(longest, NEVER, np.int64)
        start[0] = 0
        found = walk([read(m) for m in part["m"]], start, 0)
        return pd.DataFrame({"row": part["row"], "g": part["g"], "start": [x[0].tobytes() for x in found], "leave": [x[2] for x in found]})

    def over_chunks(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        found = walk([read(m) for m in part["m"]], np.frombuffer(part["start"].iloc[0], np.int64), int(part["leave"].iloc[0]))
        return pd.DataFrame({"row": part["row"], "k": part["k"], "entry": [x[1] for x in found], "leave": [x[2] for x in found]})

    made = store.table(chunks.select("row", "k", "n", "s").mapInArrow(W.releasing(matrices), "row long, k int, m binary")).withColumn("g", F.floor(F.col("k") / SEGMENT).cast("int"))
    products = made.groupBy("row", "g").applyInPandas(multiply, "row long, g int, m binary")
    ends = products.groupBy("row").applyInPandas(over_segments, "row long, g int, start binary, leave int")
    return made.join(ends, ["row", "g"]).groupBy("row", "g").applyInPandas(over_chunks, "row long, k int, entry int, leave int")


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", giant: int = 32_768, chunk: int = 16_384) -> DataFrame:
    """Per row: id, ids (array of piece ids), n_tokens and round_trip (decoding the ids gives the text back).

    Null texts give null ids, 0 tokens and a null round_trip; empty texts an empty array. Rows are encoded one by one,
    repeated rows and null ids too; extra columns are ignored and an empty table gives an empty result. Of
    segmentations of equal score each piece, seen from the end, starts as early as it can; giant and chunk decide how a text
    is worked on and never what comes out. The vocabulary (tens of thousands of pieces) is broadcast.
    """
    spark = docs.sparkSession
    v = load(model_file)
    shared = spark.sparkContext.broadcast(v)
    kind = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        seg = Segmenter(v)
        for batch in batches:
            for a, b, _, _ in W.slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                found = [None if t is None else seg.encode(t) for t in texts]
                same = [None if t is None else (decode(v, x.tolist()) == t if t else not len(x)) for t, x in zip(texts, found, strict=True)]
                sizes = np.cumsum([0, *(0 if x is None else len(x) for x in found)])
                flat = np.concatenate([np.zeros(0, np.int32), *(x for x in found if x is not None)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat), mask=pa.array([x is None for x in found]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(same, pa.bool_())], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(W.releasing(whole), "id long, ids array<int>, round_trip boolean")

    long = store.table(rows.where(F.length("text") > giant).select(F.monotonically_increasing_id().alias("row"), "id", "text"))
    chunks = store.table(chunked(long, chunk, v.longest).repartition("row", "k"))
    ends = scan(spark, chunks, shared, v.longest)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from traces(Segmenter(shared.value), batches)

    traced = chunks.join(ends, ["row", "k"]).select("row", "k", "n", "s", "entry", "leave").mapInArrow(W.releasing(trace), "row long, k int, ids array<int>, same boolean")
    parts = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"), F.min("same").alias("round_trip"))
    giants = long.select("row", "id").join(parts, "row").select("id", "ids", "round_trip")
    out = short.unionByName(giants)
    return out.select(F.col("id").alias(id_col), "ids", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_tokens"), "round_trip")


def decode_ids(tokens: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text, the inverse of encode; null ids give a null text, an empty array an empty one."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(shared.value, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(W.releasing(run), "id long, text string").withColumnRenamed("id", id_col)
