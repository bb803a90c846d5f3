"""Divergence of sources: how far the term shares of the sources of a language lie apart.

The distances between all groups (language, source) come from a product of the sparse matrix of terms by its transpose,
row by row as Gustavson's method has it: a group scatters each of its terms through the term-major index, adding at once
into one number for each peer, so pairs of postings are never written out. A term that a group lacks has a share too, the
group's baseline; first every peer is taken to be at its baseline, and the scatter corrects that for the terms it has.
Terms are dealt out in blocks, each task holding a block's part of the index; the accumulators of all blocks are summed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm import store
from statuta.llm import words as W

#: Shares are whole numbers of this many parts.
PARTS = 1_000_000_000
#: What is added to every count.
PRIOR = 5
#: Counts that a task holds before it hands them on.
HELD = 200_000
#: Postings of a block, at least and at most: the square of the number of groups is between, so that the accumulators of all
#: blocks are no more than the postings. Accumulators of a task.
BLOCK, LARGE, CELLS = 1 << 16, 1 << 20, 1 << 22

_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII in a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TERM).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and rows that have the term, over all of docs (lang, source, text)."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])

    def out(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, n_docs) in held.items():
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([n_docs[k] for k in keys], pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column(2)):
                groups = zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True)
                cuts = offsets.tolist()
                for group, x, y in zip(groups, cuts, cuts[1:], strict=False):
                    n, n_docs = held[group]
                    size -= len(n)
                    here = Counter(terms(data[x:y].tobytes()))
                    n.update(here)
                    n_docs.update(here.keys())
                    size += len(n)
                if size > HELD:
                    yield from out(held)
                    held.clear()
                    size = 0
        yield from out(held)

    counted = docs.select("lang", "source", "text").mapInArrow(W.releasing(run), "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column, n_terms: Column, prior: int = PRIOR) -> Column:
    """1 + floor(PARTS * (count + prior) / (total + prior * n_terms)), exact; null where there are no terms."""
    above = F.lit(PARTS).cast("decimal(10,0)") * (count + prior).cast("decimal(20,0)")
    below = (total.cast("long") + prior * n_terms.cast("long")).cast("decimal(20,0)")
    return (F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)"))) + 1).cast("long")


def off_baseline(p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each of base the sum of |p - base| over all of p, by running sums over the sorted p."""
    p = np.sort(p)
    total = np.concatenate(([0], np.cumsum(p)))
    k = np.searchsorted(p, base)
    return base * k - total[k] + total[-1] - total[k] - base * (len(p) - k)


def accumulate(index: pd.DataFrame, base: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row of accumulators for each group of rows, over the terms of index (term, row, p), base[g] being a group's baseline.

    acc[h] is the sum, over the group's terms, of the distance to h's baseline and, for h above the group, what the terms
    that both have change: |p_g - p_h| in the place of |p_g - base_h| + |base_g - p_h| - |base_g - base_h|.
    acc[g][h] + acc[h][g] is then the whole distance, but for |base_g - base_h| on terms that neither has.
    """
    term = pd.factorize(index["term"])[0]
    g, p = index["row"].to_numpy(np.int64), index["p"].to_numpy(np.int64)
    order = np.lexsort((g, term))  # the term-major index
    term, g, p = term[order], g[order], p[order]
    end = np.searchsorted(term, term, "right")
    by_row = np.argsort(g, kind="stable")
    begins = np.searchsorted(g[by_row], np.arange(len(base) + 1))
    out = np.zeros((len(rows), len(base)), np.int64)
    for acc, row in zip(out, rows.tolist(), strict=True):
        at = by_row[begins[row] : begins[row + 1]]
        if not len(at):
            continue
        acc += off_baseline(p[at], base)
        n = end[at] - at - 1  # peers behind it in each of its posting lists
        first = np.cumsum(n) - n
        peer = np.arange(n.sum()) + np.repeat(at + 1 - first, n)
        mine, h, theirs = np.repeat(p[at], n), g[peer], p[peer]
        np.add.at(acc, h, np.abs(mine - theirs) - np.abs(mine - base[h]) - np.abs(base[row] - theirs) + np.abs(base[row] - base[h]))
    return out


def block_sums(index: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) of one block of terms for those groups that its part names, a below b."""
    groups = groups.sort_values("g")
    base, part = groups["base"].to_numpy(np.int64), groups["part"].iloc[0]
    rows = np.arange(part, len(base), groups["parts"].iloc[0])
    acc = accumulate(index, base, rows)
    if groups["block"].iloc[0] == 0:  # once for each pair: the terms that neither has, those that both have being taken off twice
        lacks = groups["n_terms"].to_numpy(np.int64)
        for one, row in zip(acc, rows.tolist(), strict=True):
            one[row + 1 :] += (groups["vocabulary"].iloc[0] - lacks[row] - lacks[row + 1 :]) * np.abs(base[row] - base[row + 1 :])
    a, b = np.repeat(rows, len(base)), np.tile(np.arange(len(base)), len(rows))
    keep = (a != b) & ((acc.ravel() != 0) | (groups["block"].iloc[0] == 0))
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "value": acc.ravel()[keep]})


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) that occurs.

    A language keeps the terms that at least min_docs of its rows have. A group's share of a kept term is share() of its
    count there. Part `pair`: item is each other source of the language, value the sum of the differences of shares over all
    kept terms, 0 if there are none. Part `term`: item is a kept term that the group has, above its share in the whole
    language, value the difference, ranks up to top_terms only. Ranks count from 1 by value descending, then item in the
    order of its UTF-8 bytes. Null texts, languages and sources count as ''; repeated rows count each; ids and other
    columns are not read; an empty table gives an empty result.

    Counts of all rows are summed in the tasks and again by Spark. Postings are cut into blocks of terms; where a language
    has so many sources that a task's accumulators would be large, their rows are dealt to several tasks as well.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    term = Window.partitionBy("lang", "term")
    kept = term_counts(docs).select("*", F.sum("n").over(term).alias("lang_n"), F.sum("n_docs").over(term).alias("lang_docs"))
    kept = store.table(kept.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"))

    langs = kept.groupBy("lang").agg(F.countDistinct("term").alias("vocabulary"), F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("postings"))
    of = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(of, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.select("*", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_groups"))
    groups = store.table(groups.select("*", F.coalesce(share(F.lit(0), F.col("total"), F.col("vocabulary")), F.lit(0)).alias("base")))

    block = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGE), F.col("n_groups") * F.col("n_groups")))
    n_blocks = F.greatest(F.ceil(F.col("postings") / block), F.lit(1)).cast("int")
    n_parts = F.greatest(F.ceil(F.col("n_groups") * F.col("n_groups") / CELLS), F.lit(1)).cast("int")
    groups = groups.withColumns({"blocks": n_blocks, "parts": n_parts})
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("vocabulary")))
    over_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    index = shares.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), over_part, "term", F.col("g").alias("row"), "p")
    peers = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "parts", "g", "base", "n_terms", "vocabulary").select("*", over_part)
    key = ["lang", "block", "part"]
    sums = index.groupBy(*key).cogroup(peers.groupBy(*key)).applyInPandas(block_sums, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h")), F.struct(F.col("b").alias("g"), F.col("a").alias("h")))).alias("x"))
    names = groups.select("lang", "g", "source")
    pairs = both.select("lang", "value", "x.g", "x.h").join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    above = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))).alias("value")).where("value > 0")
    return pairs.unionByName(above.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top_terms))
