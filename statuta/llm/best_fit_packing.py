"""Documents as token ids, cut only where too long, packed into as few sequences of a fixed capacity as can be found.

Large items, above a third of the capacity, go into a sequence at most two at a time, by greedy matching: the largest left
takes the largest that still fits beside it, which leaves no more sequences than needed for the large ones. Smaller items
follow, largest first, each into the smallest gap that takes it.

How items are packed depends on their lengths alone, and there are no more lengths than the capacity. So the packing is
made over the histogram of lengths, for all items of a length at once: runs of sequences that are filled alike are kept as
one run. Each item then finds its place by its number among those of its length, with which no task holds all items of a length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm import store
from statuta.llm import words as W

#: Characters of a longer text that are tokenized at a time.
PART = 1 << 18
#: Between two ASCII words a blank always begins a new piece of the byte-level pattern, so a text can be cut before it.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Fixed value: the pattern by which byte-level vocabularies part a text before they merge.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The byte that each character of a byte-level vocabulary stands for: itself where it can be seen, the others counted from 256 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _SEEN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}


def parts(text: str, size: int = PART) -> list[str]:
    """A text in parts of about `size` characters, whose ids in a row are those of the whole."""
    cuts = [0]
    while len(text) - cuts[-1] > size and (found := _CUT.search(text, cuts[-1] + size)):
        cuts.append(found.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Encoder:
    """Ids of texts by a tokenizer given as JSON, without what it adds around a text.

    Where the tokenizer is a plain byte-level one, each merge having the next id, its own vocabulary also makes a rank-based
    encoder, which gives the same ids in about a quarter of the time. Texts that hold one of the tokenizer's added tokens, and
    all texts of other kinds of tokenizer, are encoded by the tokenizer itself.
    """

    def __init__(self, described: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        self.tokenizer = Tokenizer.from_str(described)
        about = json.loads(described)
        self.added = [t["content"] for t in about["added_tokens"]]
        self.ranked = ranked(about, self.added)

    def encode(self, text: str) -> list[int]:
        if self.ranked is None or any(t in text for t in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [x for part in parts(text) for x in self.ranked(part)]


def ranked(about: dict, added: list[str]) -> Callable[[str], list[int]] | None:
    """A rank-based encoder from a tokenizer's own description, or None where it is of another kind."""
    import tiktoken

    first, model = about["pre_tokenizer"] or {}, about["model"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges") or ()]
    plain = about["normalizer"] is None and (first.get("type"), first.get("add_prefix_space"), first.get("use_regex")) == ("ByteLevel", False, True)
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges")):
        return None
    vocabulary = {piece: i for piece, i in model["vocab"].items() if piece not in added}
    if sorted(vocabulary[m] for m in merged) != [vocabulary[m] for m in merged] or len(vocabulary) != 256 + len(merged):
        return None
    ranks = {bytes(_BYTES[c] for c in piece): i for piece, i in vocabulary.items()}
    return tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every text's ids and end_id, in one piece where they fit the capacity.

    Longer ones are cut into pieces of the capacity, the first of which may be shorter. A null text counts as empty and gives
    end_id alone. Rows are taken one by one, repeated ones and null ids too; other columns are not read; an empty table
    gives an empty result. The tokenizer's file, of a byte-level kind, is read by the driver and broadcast (a few MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text())
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]
    kind = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for a, b, _, _ in W.slices(batch.column(1)):
                rows = []
                for i, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    ids = np.array([*encoder.encode(text or ""), end_id], "<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    rows += [(i, k, x, y - x, zlib.crc32(ids[x:y].tobytes()), ids[x:y].astype(np.int32)) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), fields, strict=False)], schema=kind)

    names = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(W.releasing(run), names).withColumnRenamed("id", id_col)


@dataclass
class Run:
    """`bins` sequences filled alike: the gap that each has left, and how many items of which length each holds."""

    gap: int
    bins: int
    holds: list[tuple[int, int]] = field(default_factory=list)

    def filled(self, length: int, each: int, bins: int) -> Run:
        """As many of these sequences with `each` more items of a length."""
        return replace(self, gap=self.gap - length * each, bins=bins, holds=[*self.holds, (length, each)] if each else self.holds)


def matched(counts: Mapping[int, int], capacity: int) -> list[Run]:
    """Runs for the items above a third of the capacity, at most two a sequence: the largest left takes the largest that fits."""
    left = {n: counts[n] for n in sorted(counts, reverse=True) if 3 * n > capacity and counts[n]}
    out = []
    for big in list(left):
        while left[big]:
            beside = next((n for n in left if n <= min(big, capacity - big) and left[n] > (n == big)), None)
            if beside is None:
                bins = left[big]
                out.append(Run(capacity - big, bins, [(big, 1)]))
                left[big] = 0
            elif beside == big:
                bins = left[big] // 2
                out.append(Run(capacity - 2 * big, bins, [(big, 2)]))
                left[big] -= 2 * bins
            else:
                bins = min(left[big], left[beside])
                out.append(Run(capacity - big - beside, bins, [(big, 1), (beside, 1)]))
                left[big] -= bins
                left[beside] -= bins
    return out


def packed(counts: Mapping[int, int], capacity: int) -> list[Run]:
    """Runs of sequences for counts[length] items of every length, 1 to capacity."""
    runs = matched(counts, capacity)
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        items, after = counts[length], []
        for run in sorted(runs, key=lambda r: r.gap):
            each = run.gap // length  # the smallest gap goes on being the smallest until it takes no more
            if not each or not items:
                after.append(run)
                continue
            bins, rest = divmod(min(items, each * run.bins), each)
            items -= each * bins + rest
            split = [run.filled(length, each, bins), run.filled(length, rest, int(rest > 0)), run.filled(length, 0, run.bins - bins - (rest > 0))]
            after += [r for r in split if r.bins]
        each = capacity // length
        split = [Run(capacity, 0).filled(length, each, items // each), Run(capacity, 0).filled(length, items % each, int(items % each > 0))]
        runs = after + [r for r in split if r.bins]
    return runs


def slots(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, each, sequence, offset): items of a length numbered from..to-1 go, `each` in a row, to sequences counted from `sequence`, the first of each at `offset`."""
    out, used, sequence = [], {}, 0
    for run in runs:
        offset = 0
        for length, each in run.holds:
            begin = used.get(length, 0)
            used[length] = begin + each * run.bins
            out.append((length, begin, used[length], each, sequence, offset))
            offset += each * length
        sequence += run.bins
    return out


def pack(items: DataFrame, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """items with sequence_id and offset: every sequence holds items of at most `capacity` in all, gapless from offset 0.

    items has an integer column length, 1 to capacity, and may have others; `keys` order the items of a length, and rows
    equal in them share out their places in any order. items is read more than once and must give the same rows each time
    (a written table does). The histogram at the driver and the broadcast slots are bounded by the capacity: at most
    capacity lengths, and in a sequence no more different lengths than the square root of twice the capacity.
    """
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    spark = items.sparkSession
    places = spark.createDataFrame(slots(packed(counts, capacity)), "`length` long, `from` long, `to` long, `each` long, `sequence` long, `at` long")
    # items of a length are numbered within buckets, as many as there are items in one if lengths were all alike
    buckets = max(1, int(sum(counts.values()) ** 0.5))
    dealt = items.select("*", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"))
    sizes = dealt.groupBy("length", "_bucket").count()
    before = sizes.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    numbered = dealt.select("*", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)).alias("_k")).join(before, ["length", "_bucket"])
    number = F.col("_before") + F.col("_k") - 1
    found = numbered.withColumn("_n", number).join(F.broadcast(places), "length").where("_n >= `from` AND _n < `to`")
    place = F.col("_n") - F.col("from")
    return found.select(*(F.col(c) for c in items.columns), (F.col("sequence") + F.call_function("div", place, F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """pieces() of docs with the places that pack() gives them; see there for nulls, empty texts, repeated rows and empty tables."""
    made = store.table(pieces(docs, tokenizer_file, id_col, text_col, capacity, end_id, with_ids))
    return pack(made, capacity, (id_col, "piece", "start", "ids_crc32"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pack_documents(with_ids=True): the ids of every sequence, at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
