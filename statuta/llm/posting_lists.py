"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all equally long, so that the largest inner product is the smallest
distance. Equal vectors are one class from the start, of which the k + 1 smallest ids are all that can matter. The number
of lists grows with the rows, as their root; centroids are fitted in two levels, coarse ones on a bounded sample and the
rest group by group in tasks on a sample in proportion to the lists. Each class goes to the list of its nearest centroid and, near
a boundary, to some more. Lists are dealt as blocks of candidates and of queries, so a hot list is spread and a task holds
one block of each. A query walks an in-memory graph of centroids and searches the lists whose distance is within a ratio of the
nearest's. How large the ratio must be depends on the data, so it is set by a sample of queries that are searched in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm import store

#: Rows of a coarse group that its centroids are fitted on, at most.
GROUP_ROWS = 65_536
#: Nearest lists that every query searches at least.
LEAST_LISTS = 16


@dataclass
class Index:
    """Centroids, neighbours of each, coarse centroids with a list near each to enter by, and the length of lifted vectors."""

    centroids: np.ndarray
    graph: np.ndarray
    coarse: np.ndarray
    entry: np.ndarray
    length2: float


@dataclass
class Pruning:
    """A query searches the lists within `ratio` of its nearest's distance, the `floor` nearest in any case, `width` at most."""

    ratio: float
    width: int
    floor: int = 1


def usable(vector: Column) -> Column:
    """Not null, not empty or zero, and of finite components alone."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(vector, lambda x: x != 0)


def lifted(x: np.ndarray, length2: float) -> np.ndarray:
    """Vectors with the component that brings each to the common length."""
    return np.concatenate((x, np.sqrt(np.maximum(length2 - (x * x).sum(axis=1), 0))[:, None]), axis=1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, less the rows' own squared lengths."""
    return (centroids * centroids).sum(axis=1)[None, :] - 2 * x @ centroids.T


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(distances(x[k : k + 4096], centroids), axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def balanced(x: np.ndarray, lists: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means in which a list of more than twice the mean is split and an empty one moves there."""
    x = x[np.unique(x.round(6), axis=0, return_index=True)[1]]
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        size = np.bincount(own, minlength=lists)
        sums = np.stack([np.bincount(own, x[:, d], lists) for d in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        heavy = np.argsort(-size)
        for poor, rich in zip(np.flatnonzero(size == 0), heavy[size[heavy] > 2 * len(x) / lists], strict=False):
            c[poor] = x[rng.choice(np.flatnonzero(own == rich))]
    return c


def share_of(rows: DataFrame, wanted: int, count: int) -> DataFrame:
    """About `wanted` of the rows (h, v), those of small hashes of their vectors."""
    return rows.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 40)) <= int((1 << 40) * min(1.0, wanted / max(count, 1))))


def fit(rows: DataFrame, count: int, length2: float, lists: int, list_sample: int, max_sample: int, degree: int, rounds: int, seed: int) -> Index:
    """The index over rows (h, v), h being a hash of the vector.

    Coarse centroids, the root of lists many, come from at most max_sample rows; each coarse group's own from its part of
    lists * list_sample rows, at most GROUP_ROWS. Centroids and graph are some 16 * sqrt(rows) numbers for each dimension
    at most, and are collected and broadcast.
    """
    spark = rows.sparkSession
    few = share_of(rows, max_sample * 9 // 10, count).select("v", "h").orderBy("h").limit(max_sample)
    coarse = balanced(lifted(np.array([r.v for r in few.collect()]), length2), int(np.ceil(lists**0.5)), rounds, np.random.default_rng(seed))
    shared = spark.sparkContext.broadcast(coarse)

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = lifted(np.stack(part["v"].to_numpy()), length2)
            yield pd.DataFrame({"g": nearest(x, shared.value), "h": part["h"], "x": list(x)})

    grouped = store.table(share_of(rows, lists * list_sample, count).mapInPandas(group, "g int, h long, x array<double>"))
    total = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("n"))  # a row a coarse centroid
    thin = grouped.join(F.broadcast(total), "g").where(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(1 << 30)) <= F.lit(float(1 << 30) * GROUP_ROWS * 9 / 10) / F.col("n"))

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h")
        x, g, n = np.stack(part["x"].to_numpy()), int(part["g"].iloc[0]), int(part["n"].iloc[0])
        found = balanced(x, max(1, round(n / list_sample)), rounds, np.random.default_rng([seed, g]))
        return pd.DataFrame({"g": g, "no": np.arange(len(found)), "c": list(found)})

    got = thin.groupBy("g").applyInPandas(settle, "g int, no int, c array<double>").toPandas().sort_values(["g", "no"])
    centroids = np.stack(got["c"].to_numpy()) if len(got) else coarse
    store.drop(grouped)
    entry = nearest(coarse, centroids)
    around = spark.sparkContext.broadcast(centroids)
    near = min(degree, len(centroids) - 1)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = around.value
        for part in batches:
            for k in range(0, len(part), 512):
                at = part["id"].to_numpy()[k : k + 512]
                d = distances(c[at], c)
                d[np.arange(len(at)), at] = np.inf
                yield pd.DataFrame({"id": at, "near": list(np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(at), 0), np.int64))})

    found = spark.range(len(centroids)).mapInPandas(neighbours, "id long, near array<long>").toPandas().sort_values("id")
    ring = (np.arange(len(centroids))[:, None] + np.array([1, -1])) % len(centroids)  # keeps the graph connected
    return Index(centroids, np.concatenate((np.stack(found["near"].to_numpy()).astype(np.int64).reshape(len(centroids), near), ring), axis=1), coarse, entry, length2)


def search_centroids(ix: Index, x: np.ndarray, width: int, ratio: float, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids that a best-first walk of the graph finds for each row: (ids, squared distances), ascending.

    Each row holds its `width` best so far, beginning with the lists near its nearest coarse centroids, and opens the
    nearest not opened yet, as long as it lies within `ratio` of the nearest's distance or fewer than `floor` are opened. All rows
    step at once; a step costs the neighbours of one centroid a row, and nothing is kept for centroids that fell behind.
    """
    rows, width = len(x), min(width, len(ix.centroids))
    norm, own = (ix.centroids * ix.centroids).sum(axis=1), (x * x).sum(axis=1)
    first = np.argsort(distances(x, ix.coarse), axis=1)[:, : min(4, len(ix.coarse))]
    ids = np.full((rows, width), -1)
    dist = np.full((rows, width), np.inf)
    opened = np.zeros((rows, width), bool)

    def merge(who: np.ndarray, new: np.ndarray) -> None:
        d = norm[new] - 2 * np.einsum("ij,ikj->ik", x[who], ix.centroids[new])
        new_sorted = np.sort(new, axis=1)
        again = (new[:, :, None] == ids[who][:, None, :]).any(axis=2)
        if (new_sorted[:, 1:] == new_sorted[:, :-1]).any():
            for k in range(1, new.shape[1]):
                again[:, k] |= (new[:, :k] == new[:, k : k + 1]).any(axis=1)
        d[again] = np.inf
        every_id, every_d = np.concatenate((ids[who], new), axis=1), np.concatenate((dist[who], d), axis=1)
        every_open = np.concatenate((opened[who], np.zeros(new.shape, bool)), axis=1)
        best = np.argsort(every_d, axis=1, kind="stable")[:, :width]
        ids[who], dist[who], opened[who] = (np.take_along_axis(y, best, axis=1) for y in (every_id, every_d, every_open))

    everyone = np.arange(rows)
    merge(everyone, ix.entry[first])
    active = everyone
    while len(active):
        open_d = np.where(opened[active], np.inf, dist[active])
        at = np.argmin(open_d, axis=1)
        least = np.maximum(dist[active].min(axis=1) + own[active], 0)
        next_d = open_d[np.arange(len(active)), at]
        go = (next_d + own[active] <= ratio * ratio * least + 1e-9) | np.isfinite(next_d) & (opened[active].sum(axis=1) < floor)
        active, at = active[go], at[go]
        opened[active, at] = True
        if len(active):
            merge(active, ix.graph[ids[active, at]])
    found = np.where(ids >= 0, dist + own[:, None], np.inf)
    return np.maximum(ids, 0), np.maximum(found, 0)


def assigned(rows: DataFrame, shared, width: int, ratio: float, most: int, step: int = 512) -> DataFrame:
    """(cid, v, list): the lists of each row (cid, v) whose distance is within ratio of its nearest's, at most `most`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for part in batches:
            for a in range(0, len(part), step):
                some = part.iloc[a : a + step]
                ids, d = search_centroids(ix, lifted(np.stack(some["v"].to_numpy()).astype(float), ix.length2), width, ratio)
                near = np.sqrt(d) <= ratio * np.sqrt(d[:, :1]) + 1e-9
                near[:, most:] = False
                r, k = np.nonzero(near)
                yield pd.DataFrame({"cid": some["cid"].to_numpy()[r], "v": some["v"].to_numpy()[r], "list": ids[r, k]})

    return rows.select("cid", "v").mapInPandas(run, "cid long, v array<double>, list int")


def placed(sizes: np.ndarray, tile_rows: int) -> np.ndarray:
    """First and last tile of each list: lists stand one after the other, and a tile ends after every tile_rows rows."""
    stop = np.cumsum(sizes)
    return np.stack(((stop - sizes) // tile_rows, np.maximum(stop - 1, stop - sizes) // tile_rows), axis=1)


def probes(rows: DataFrame, shared, tiles, pruning: Pruning, step: int = 512) -> DataFrame:
    """(cid, v, early, tile, lists): the tiles that each query (cid, v) comes to, with the lists that it searches there.

    The `floor` nearest lists are early ones, those within the ratio besides are not. A query's further component is 0, so its
    distance to a lifted vector falls as their inner product grows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, place = shared.value, tiles.value
        for part in batches:
            for a in range(0, len(part), step):
                some = part.iloc[a : a + step]
                x = np.pad(np.stack(some["v"].to_numpy()).astype(float), ((0, 0), (0, 1)))
                ids, d = search_centroids(ix, x, pruning.width, pruning.ratio, pruning.floor)
                near = np.sqrt(d) <= pruning.ratio * np.sqrt(d[:, :1]) + 1e-9
                near[:, : pruning.floor] = np.isfinite(d[:, : pruning.floor])
                r, k = np.nonzero(near)
                lists = ids[r, k]
                times = place[lists, 1] - place[lists, 0] + 1
                tile = np.repeat(place[lists, 0], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                r, late, lists = np.repeat(r, times), np.repeat(k >= pruning.floor, times), np.repeat(lists, times)
                order = np.lexsort((lists, tile, late, r))
                r, late, tile, lists = r[order], late[order], tile[order], lists[order]
                new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (late[1:] != late[:-1]) | (tile[1:] != tile[:-1]))))
                yield pd.DataFrame({"cid": some["cid"].to_numpy()[r[new]], "v": some["v"].to_numpy()[r[new]], "early": ~late[new], "tile": tile[new], "lists": np.split(lists, new[1:])})

    return rows.select("cid", "v").mapInPandas(run, "cid long, v array<double>, early boolean, tile long, lists array<int>")


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed component by component, so equal vectors get equal scores wherever they stand."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def firsts(i: np.ndarray, score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each i, by i, ties to the smaller name."""
    order = np.lexsort((names, -score, i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < k]


def best_of(q: np.ndarray, x: np.ndarray, cids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of each query's k largest inner products, ties to the smaller cid."""
    rough = q @ x.T
    if len(x) > k:
        # whatever may be among the k best, given that the rough product is off by rounding alone
        bar = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        slack = 1e-12 * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max()) * q.shape[1]
        i, j = np.nonzero(rough >= (bar - slack)[:, None])
    else:
        i, j = (y.ravel() for y in np.indices(rough.shape))
    score = inner(q[i], x[j])
    best = firsts(i, score, cids[j], k)
    return i[best], j[best], score[best]


def calibrated(ix: Index, asked: DataFrame, classes: DataFrame, posted: DataFrame, k: int, cover: float, sample: int) -> Pruning:
    """The pruning under which the lists searched hold a share `cover` of the true neighbours of a sample of queries.

    The queries of the smallest hashes, `sample` at most, are compared with all classes; each of their k best then tells by
    how much farther than the nearest list its own nearest to the query is, and how many lists are nearer. Queries close to a
    centroid have few lists within a ratio, so all search the LEAST_LISTS nearest in any case, and the ratio is what the other
    neighbours need. The work is linear in the rows. Width is one and a half times what the sample's queries need at most, so
    that it binds for none but odd ones; the walk holds so many lists a query.
    """
    got = asked.select("v", "h").orderBy("h").limit(sample).collect()
    q = np.array([r.v for r in got])
    shared = asked.sparkSession.sparkContext.broadcast(q)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"q": [], "cid": [], "least": [], "score": []})
        for part in parts:
            i, j, score = best_of(shared.value, np.stack(part["v"].to_numpy()), part["least"].to_numpy(), k + 1)
            more = pd.DataFrame({"q": i, "cid": part["cid"].to_numpy()[j], "least": part["least"].to_numpy()[j], "score": score})
            best = pd.concat((best, more), ignore_index=True) if len(best) else more
            best = best.iloc[firsts(best["q"].to_numpy(), best["score"].to_numpy(), best["least"].to_numpy(), k + 1)]
        yield best

    near = classes.select("cid", "least", "v").mapInPandas(batches, "q int, cid long, least long, score double")
    true = near.withColumn("no", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least"))).where(F.col("no") <= k + 1)
    lists = posted.select("cid", "list").join(F.broadcast(true.select("q", "cid")), "cid").groupBy("q", "cid").agg(F.collect_list("list").alias("lists")).toPandas()  # sample * (k + 1) rows at most
    x = np.pad(q, ((0, 0), (0, 1)))
    d = np.sqrt(np.maximum(distances(x, ix.centroids) + (x * x).sum(axis=1)[:, None], 0))
    ratios = d / np.maximum(d.min(axis=1, keepdims=True), 1e-12)
    place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
    own = [(ratios[i, list(at)].min(), place[i, list(at)].min()) for i, at in zip(lists["q"], lists["lists"], strict=True)]
    far, behind = np.array([x[0] for x in own]), np.array([x[1] for x in own])
    floor = min(LEAST_LISTS, len(ix.centroids))
    need = np.sort(np.where(behind < floor, 1.0, far))
    ratio = float(need[min(len(need) - 1, int(np.ceil(cover * len(need))))]) + 1e-9
    most = np.maximum((ratios <= ratio).sum(axis=1), floor).max()
    return Pruning(ratio, int(min(len(ix.centroids), np.ceil(1.5 * most))), floor)


def answer(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each query among the rows of its lists on a tile, if they reach its bar: (query, cid, least, score).

    left: queries (cid, v, lists, bar), lists being null where all are meant; right: the tile's rows (list, cid, least, v).
    """
    found = []
    if len(left) and len(right):
        right = right.sort_values("list", kind="stable")
        q, bar, x = np.stack(left["v"].to_numpy()), left["bar"].to_numpy(float), np.stack(right["v"].to_numpy())
        cids, names = right["cid"].to_numpy(), right["least"].to_numpy()
        there, begin = np.unique(right["list"].to_numpy(), return_index=True)
        wanted = [there if at is None else at for at in left["lists"]]
        who, lists = np.repeat(np.arange(len(left)), [len(at) for at in wanted]), np.concatenate(wanted)
        for at, a, b in zip(there, begin, [*begin[1:], len(right)], strict=True):
            asking = who[lists == at]
            i, j, score = best_of(q[asking], x[a:b], names[a:b], k)
            i, j = asking[i], j + a
            reach = score >= bar[i]
            found.append((i[reach], j[reach], score[reach]))
    if not found:
        return pd.DataFrame({"query": [], "cid": [], "least": [], "score": []})
    i, j, score = (np.concatenate(y) for y in zip(*found, strict=True))
    once = np.unique(np.stack((i, cids[j])), axis=1, return_index=True)[1]  # a row stands in several lists
    i, j, score = i[once], j[once], score[once]
    best = firsts(i, score, names[j], k)
    return pd.DataFrame({"query": left["cid"].to_numpy()[i[best]], "cid": cids[j[best]], "least": names[j[best]], "score": score[best]})


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, max_sample: int = 20_000, list_rows: int = 128, root_lists: float = 4.0, list_sample: int = 64, cover: float = 0.95, sample_queries: int = 256, pruning: Pruning | None = None, copies: int = 3, copy_ratio: float = 1.12, tile_rows: int = 4096, query_block: int = 1024, index_bytes: int = 256 << 20, seed: int = 3) -> DataFrame:
    """Per query (id divisible by every): its k nearest other rows found, as query_id, rank from 1, id and score.

    Nearest is the largest inner product in double precision, ties to the smaller id. Vectors that are null, empty,
    zero or of another length than most, or that hold a null or non-finite component, take no part, nor do null ids. Of rows that repeat
    an id, each distinct vector takes part. All rows are indexed, in one list for list_rows rows or root_lists * sqrt(rows)
    lists, whichever is less, but never more than index_bytes of centroids and graph, which every task holds; see fit for its
    samples. Lists are pruned so that about a share `cover` of true neighbours is
    found, unless a pruning is given; see calibrated. A query for which fewer than k rows are found is searched in all
    lists. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    nothing = spark.createDataFrame([], "query_id long, rank int, id long, score double").withColumnRenamed("id", id_col)
    if dims is None:
        return nothing
    rows = store.table(rows.where(F.size("v") == dims["d"]).withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h", "v"]))
    # of equal vectors the k + 1 smallest ids; Spark keeps so many of each in every task before the shuffle
    least = rows.withColumn("no", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("no") <= k + 1)
    classes = store.table(least.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()).withColumn("least", F.col("ids")[0]))
    about = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    degree = 24
    fitting = index_bytes // (8 * (int(dims["d"]) + degree + 3))
    lists = int(max(1, min(-(-about[0] // list_rows), np.ceil(root_lists * about[0] ** 0.5), fitting)))
    index = fit(classes.select("h", "v"), about[0], float(about[1]) * (1 + 1e-9), lists, list_sample, max_sample, degree, 8, seed)
    lists = len(index.centroids)
    shared = spark.sparkContext.broadcast(index)

    posted = store.table(assigned(classes, shared, max(copies, 24), copy_ratio, copies).join(classes.select("cid", "least"), "cid"))
    queries = store.table(rows.where(F.col("id") % every == 0).join(classes.select("h", "v", "cid"), ["h", "v"]).select(F.col("id").alias("query_id"), "cid"))
    asked = store.table(classes.select("cid", "h", "v").join(queries.select("cid").distinct(), "cid", "left_semi"))
    counts = posted.groupBy("list").count().toPandas()  # a row a list
    sizes = np.zeros(lists, np.int64)
    sizes[counts["list"]] = counts["count"]
    place = placed(sizes, tile_rows)
    ends = spark.createDataFrame(pd.DataFrame({"list": np.arange(lists), "first": place[:, 0], "last": place[:, 1]}), "list int, first long, last long")
    held = store.table(posted.join(F.broadcast(ends), "list").select((F.col("first") + F.pmod(F.xxhash64("cid"), F.col("last") - F.col("first") + 1)).alias("tile"), "list", "cid", "least", "v"))
    spent = [rows, classes, posted, queries, asked, held]

    def answered(put: DataFrame) -> DataFrame:
        """Stored: the k + 1 best classes (query, cid, least, score) of each query on each tile of put (cid, v, tile, lists, bar)."""
        parts = store.table(put.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).cast("int").alias("parts")))  # small, or joined by a shuffle
        left = put.join(parts, "tile").select("tile", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), "cid", "v", "lists", "bar")
        right = held.join(parts, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "list", "cid", "least", "v")
        best = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInPandas(lambda a, b: answer(a, b, k + 1), "query long, cid long, least long, score double")
        out = store.table(best.groupBy("query", "cid", "least").agg(F.max("score").alias("score")))
        store.drop(parts)
        spent.append(out)
        return out

    def ranked(best: DataFrame) -> DataFrame:
        """The k best ids of each query: of the k + 1 best classes their ids, less its own."""
        top = best.withColumn("no", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))).where(F.col("no") <= k + 1).select("query", "cid", "score")
        named = top.join(classes.select("cid", "ids"), "cid").select(F.col("query").alias("cid"), "score", F.explode("ids").alias("id"))
        # ids of a class of queries, of which each then leaves out its own
        first = named.withColumn("no", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "id"))).where(F.col("no") <= 2 * k + 1)
        mine = queries.join(first.select("cid", "score", "id"), "cid").where("id <> query_id")
        unique = mine.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return unique.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    def ended(found: DataFrame) -> DataFrame:
        """found stored, and all other tables removed."""
        out = store.table(found)
        store.drop(*spent)
        return out

    if not asked.limit(1).count():
        store.drop(*spent)
        return nothing
    pruning = pruning or calibrated(index, asked, classes, posted, k, cover, sample_queries)
    ways = store.table(probes(asked, shared, spark.sparkContext.broadcast(place), pruning))
    spent.append(ways)
    early = answered(ways.where("early").withColumn("bar", F.lit(float("-inf"))))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    bars = early.withColumn("no", F.row_number().over(by_score)).where(F.col("no") == k + 1).select(F.col("query").alias("cid"), F.col("score").alias("bar"))
    late = answered(ways.where("not early").join(bars, "cid", "left").fillna(float("-inf"), "bar"))
    best = early.unionByName(late).groupBy("query", "cid", "least").agg(F.max("score").alias("score"))
    found = store.table(ranked(best).select("query_id", "rank", F.col("id").alias(id_col), "score"))
    enough = found.groupBy("query_id").count().where(F.col("count") >= k)
    rest = store.table(queries.join(enough, "query_id", "left_anti"))
    spent.append(rest)
    if not rest.limit(1).count():
        store.drop(*spent)
        return found
    spent.append(found)
    everywhere = asked.join(rest.select("cid").distinct(), "cid", "left_semi").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(int(place.max()))).cast("array<bigint>")))
    more = answered(everywhere.select("cid", "v", "tile", F.lit(None).cast("array<int>").alias("lists"), F.lit(float("-inf")).alias("bar")))
    again = ranked(more).join(rest.select("query_id"), "query_id", "left_semi").select("query_id", "rank", F.col("id").alias(id_col), "score")
    return ended(found.join(rest.select("query_id"), "query_id", "left_anti").unionByName(again))
