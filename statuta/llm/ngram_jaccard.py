"""Similarity join of texts on their sets of word n-grams, exact.

Sets are cut into size bands, and documents that share one of the smallest hashes of their sets (a prefix that two
similar sets can't both miss) meet in a tile of a band. Inside a tile, bitmap signatures bound the overlap of two sets
from above by bit counts; what passes is settled by intersecting the sorted arrays. Equal sets are one class from the
start. Links of each tile's smallest member are settled first, and pairs that these already connect are left out of
the second round, whose members share enough of their smallest hashes with another component and whose tiles are of the rarest n-grams among the documents that still meet another component: of a
large family of copies, those with edits of their own meet few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm import bitmaps, store
from statuta.llm import words as W
from statuta.llm.components import components

#: Bits of a signature.
BITS = 1024
#: Members of a tile's block; a larger tile is dealt as pairs of blocks.
BLOCK = 512
#: Bytes of texts of a home; the pairs of a heavier one are dealt to several.
HOME_BYTES = 64 << 20
#: Of the smallest hashes of a set, those whose tiles are settled against their smallest member in the first round.
LEADERS = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct n-gram hashes of each text and where they begin; a text of fewer words is one n-gram."""
    w = W.tokenize(data, offsets, lower=True)
    hashes, at = W.windows(w, n)
    owner = w.text_of[at]
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    short = np.zeros(len(few), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1):
            on = w.count[few] > k
            short[on] = short[on] * np.uint64(0xD1342543DE82EF95) + w.hash[w.first[few[on]] + k]
    return W.distinct(np.concatenate((owner, few)), np.concatenate((hashes, W.mix(short + np.uint64(1)))), len(offsets) - 1)


#: A prefix is longer than it must be by 1 in so many hashes of the set; two similar sets then share as many more in it.
EXTRA = 10


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest hashes of a set of n, among which a similar set of m has at least 1 + min(n, m) // EXTRA too."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1 + n // EXTRA, 0)


def least_shared(n: Column, percent: int) -> Column:
    """Hashes of its prefix that a set of n shares with any similar one, which has percent of its size at least."""
    return 1 + F.floor(F.ceil(n * percent / F.lit(100) - 1e-9) / EXTRA)


def signatures(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A bitmap of BITS bits for each set, as 64-bit integers."""
    rows = len(begins) - 1
    bits = np.zeros((rows, BITS), bool)
    bits[np.repeat(np.arange(rows), np.diff(begins)), (values & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def features(docs: DataFrame, n: int, percent: int, wanted: str) -> DataFrame:
    """Per row of (id, text): id and n (set size), with f1 and f2 (128 bits that stand for the set), and size (bytes of the text),
    prefix (its smallest hashes), set (all), or bits (its signature); wanted is "class", "prefix", "set" or "bits"."""
    extra = {"class": [("size", pa.int64(), "long")], "prefix": [("prefix", pa.list_(pa.int64()), "array<long>")], "bits": [("bits", pa.binary(), "binary")], "set": [("set", pa.list_(pa.int64()), "array<long>")]}[wanted]
    kind = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), *(x[:2] for x in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column(1)):
                values, begins = shingle_sets(data, offsets, n)
                size = np.diff(begins)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate(([np.uint64(0)], np.cumsum(W.mix(values ^ np.uint64(s)), dtype=np.uint64))) for s in (0x1234567, 0x7654321ABCDEF)]
                    f1, f2 = ((s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums)
                columns = [batch.column(0).slice(a, b - a), pa.array(size, pa.int32()), pa.array(f1), pa.array(f2)]
                if wanted == "class":
                    columns.append(pa.array(np.diff(offsets)))
                elif wanted == "prefix":
                    take = np.minimum(prefix_size(size, percent), size)
                    kept = np.arange(len(values)) - np.repeat(begins[:-1], size) < np.repeat(take, size)
                    columns.append(W.lists(values[kept].view(np.int64), np.concatenate(([0], np.cumsum(take))), pa.int64()))
                elif wanted == "set":
                    columns.append(W.lists(values.view(np.int64), begins, pa.int64()))
                elif wanted == "bits":
                    columns.append(pa.array([x.tobytes() for x in signatures(values, begins)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return docs.mapInArrow(W.releasing(run), ", ".join(["id long, n int, f1 long, f2 long", *(f"{x[0]} {x[2]}" for x in extra)]))


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (id, text) whose id is in ids, without shuffling the texts of the others."""
    return bitmaps.among(docs, store.table(ids.distinct()), "id").select("id", "text")


def in_groups(rows: DataFrame, keys: list[str], settle, schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """settle(pa.Table) -> pa.RecordBatch over runs of rows in which groups of equal keys are whole, streaming.

    A task holds one batch and one group at a time, so groups must be small and may be many.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches([batch])
            got = got if rest is None else pa.concat_tables([rest, got])
            same = np.ones(got.num_rows, bool)
            for c in keys:
                column = got.column(c).to_numpy()
                same &= column == column[-1]
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            rest = got.slice(cut)
            if cut:
                yield settle(got.slice(0, cut))
        if rest is not None:
            yield settle(rest)

    return dealt.mapInArrow(W.releasing(run), schema)


def cuts_of(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin, and the number of rows."""
    change = np.zeros(rows.num_rows - 1, bool)
    for c in keys:
        column = rows.column(c).to_numpy()
        change |= column[1:] != column[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [rows.num_rows]))


def homes(pairs: DataFrame) -> DataFrame:
    """Stored: (home, id) of the texts that the pairs (a, b, home) need."""
    return store.table(pairs.select("home", F.explode(F.array("a", "b")).alias("id")).distinct())


def verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact intersection of their sorted arrays.

    pairs has (a, b, home); a text goes once to each home that has pairs of it. Homes have few texts; where these (id, size
    in sizes) have more than HOME_BYTES, they are dealt into groups of about so many, and the pairs of each two groups get a home.
    """
    needed = homes(pairs)
    held = needed.join(bitmaps.among(sizes, store.table(needed.select("id").distinct()), "id"), "id").groupBy("home").agg(F.sum("size").alias("bytes"))
    heavy = store.table(held.where(F.col("bytes") > HOME_BYTES).select("home", F.ceil(F.col("bytes") / F.lit(HOME_BYTES)).alias("groups")))
    if heavy.limit(1).count():
        group = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.col("groups"))
        pairs = store.table(pairs.join(heavy, "home", "left").select("a", "b", F.when(F.col("groups").isNull(), F.col("home")).otherwise(F.xxhash64("home", F.least(group("a"), group("b")), F.greatest(group("a"), group("b")))).alias("home")))
        needed = homes(pairs)
    texts = rows_of(docs, needed.select("id"))
    nothing = F.lit(None)
    rows = needed.join(texts, "id").select("home", F.lit(0).alias("part"), "id", nothing.cast("long").alias("b"), "text").unionByName(pairs.select("home", F.lit(1).alias("part"), F.col("a").alias("id"), "b", nothing.cast("string").alias("text")))

    def settle(rows: pa.Table) -> pa.RecordBatch:
        cuts, out = cuts_of(rows, ["home"]), []
        part, ids, other = rows.column("part").to_numpy(), rows.column("id").to_numpy(), rows.column("b").to_numpy(zero_copy_only=False)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            middle = a + int((part[a:b] == 0).sum())
            sets: dict[int, list[np.ndarray]] = {}
            for c, d, data, offsets in W.slices(rows.column("text").slice(a, middle - a)):
                values, begins = shingle_sets(data, offsets, n)
                for k in range(d - c):
                    sets.setdefault(int(ids[a + c + k]), []).append(values[begins[k] : begins[k + 1]])
            for x, y in zip(ids[middle:b].tolist(), other[middle:b].astype(np.int64).tolist(), strict=True):
                if any(similar(u, v, percent) for u in sets.get(x, []) for v in sets.get(y, [])):
                    out.append((x, y))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return in_groups(rows, ["home"], settle, "a long, b long", ("part",)).distinct()


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union| for two ascending arrays of distinct values."""
    if not len(u) or not len(v):
        return False
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    both = int((v[at] == u).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def tile_candidates(block: np.ndarray, ids: np.ndarray, size: np.ndarray, comp: np.ndarray, guest: np.ndarray, first: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile (or of two blocks of it) that size, component and signature leave open."""
    order = np.lexsort((~first, size))  # of two equal sizes, one that may be the smaller comes before
    ids, size, comp, guest, first, block, bits = (x[order] for x in (ids, size, comp, guest, first, block, bits))
    out_a, out_b = [], []
    two = block.min() != block.max()
    reach = np.searchsorted(size, size * 100 // percent, "right")
    for i in np.flatnonzero(first[:-1]):
        j = np.arange(i + 1, reach[i])
        if two:
            j = j[block[j] != block[i]]
        j = j[(comp[j] != comp[i]) & ~(guest[j] & guest[i])]
        if not len(j):
            continue
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum((size[i] + size[j] - differ) // 2, size[i])
        j = j[100 * most >= percent * (size[i] + size[j] - most)]
        out_a.append(np.full(len(j), ids[i]))
        out_b.append(ids[j])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def in_tiles(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, home) from rows (tile, band, x, y, block, id, n, comp, guest, first, bits)."""
    keys = ["tile", "band", "x", "y"]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        cuts = cuts_of(rows, keys)
        home = W.mix(rows.column("tile").to_numpy().view(np.uint64) + rows.column("band").to_numpy().astype(np.uint64) * np.uint64(3) + W.mix((rows.column("x").to_numpy().astype(np.uint64) << np.uint64(32)) | rows.column("y").to_numpy().astype(np.uint64))).view(np.int64)
        block, ids, size, comp, guest, first = (rows.column(c).to_numpy() for c in ("block", "id", "n", "comp", "guest", "first"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        found = [(*tile_candidates(block[a:b], ids[a:b], size[a:b].astype(np.int64), comp[a:b], guest[a:b].astype(bool), first[a:b].astype(bool), bits[a:b], percent), home[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]
        a = np.concatenate([x for x, _, _ in found] or [np.zeros(0, np.int64)])
        b = np.concatenate([y for _, y, _ in found] or [np.zeros(0, np.int64)])
        h = np.repeat(np.array([z for _, _, z in found], np.int64), [len(x) for x, _, _ in found])
        order = np.lexsort((h, b, a))
        a, b, h = a[order], b[order], h[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (a, b, h)], names=["a", "b", "home"])

    found = in_groups(members, keys, settle, "a long, b long, home long")
    return found.groupBy("a", "b").agg(F.min("home").alias("home"))


def within(rows: DataFrame, keys: list[str], where: str, **found: Column) -> DataFrame:
    """rows with aggregates of their groups, of the groups that `where` keeps.

    Aggregates are partial before they are shuffled, and written, so that the join back on the keys is a plain one
    of two shuffles, in which Spark splits a key of very many rows. No task gathers a group.
    """
    groups = store.table(rows.groupBy(*keys).agg(*[x.alias(name) for name, x in found.items()]).where(where))
    return rows.join(groups, keys)


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles (distinct n-grams, lower-cased A-Z) and component_id.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets; component_id is the smallest id that
    links reach, the row's own included. A text of fewer words than n is one n-gram; null, empty and blank texts have
    no set, link with nothing and keep their own id. Equal sets (repeated rows too) are one class. Rows with a null id
    take the component of a class that also has an id, else null. Extra columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = store.table(features(rows, n, percent, "class"))
    sizes = made.select("id", "size")
    prefixes = store.table(features(rows.where("id is not null"), n, percent, "prefix").where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.min_by("prefix", "id").alias("prefix")).select("id", "n", "prefix"))

    # postings; a hash that one class alone has in its prefix is of no use, nor is a class that shares too few of its own
    post = prefixes.select("id", "n", F.posexplode("prefix").alias("pos", "tile")).select("tile", "id", "n", (F.col("pos") < LEADERS).alias("near"))
    need = least_shared(F.col("n"), percent)
    some = store.table(within(post, ["tile"], "lead < last", lead=F.min("id"), last=F.max("id")))
    enough = some.groupBy("id", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= need)
    met = store.table(some.drop("lead", "last").join(enough.select("id", "n"), ["id", "n"], "left_semi"))
    store.drop(prefixes, some)

    # first round: each tile's smallest member against the others
    stars = within(met.where("near"), ["tile"], "lead < last", lead=F.min("id"), last=F.max("id")).where("lead < id").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    stars = store.table(stars)
    parts = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("parts"))
    stars = stars.join(parts, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("home"))
    first = store.table(verified(store.table(stars), rows, sizes, n, percent))
    comp = store.table(components(first))

    # second round: who meets another component there, in tiles of the rarest n-grams among these, for the pairs still apart
    own_prefix = F.col("n") - F.ceil(F.col("n") * F.lit(2 * percent) / F.lit(100 + percent) - 1e-9) + 1
    known = store.table(met.select("tile", "id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left").select("tile", "id", "n", F.coalesce("component", "id").alias("comp")))
    mixed = within(known, ["tile"], "lo < hi", lo=F.min("comp"), hi=F.max("comp")).groupBy("id", "n", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = store.table(mixed.where(F.col("m") >= need).select("id", "comp"))
    store.drop(met, known)
    texts = store.table(rows_of(rows, mixed.select("id")))
    signed = store.table(features(texts, n, percent, "bits").where("n > 0").select("id", "n", "bits").dropDuplicates(["id", "n", "bits"]))
    grams = store.table(features(texts, n, percent, "set").select("id", "n", F.explode("set").alias("tile")))
    shared = within(grams, ["tile"], "df > 1", df=F.count(F.lit(1)))
    rare = Window.partitionBy("id", "n").orderBy("df", "tile")
    ranked = shared.withColumn("rank", F.dense_rank().over(rare)).withColumn("rank", F.col("rank") + F.col("n") - F.max("rank").over(Window.partitionBy("id", "n")))
    least = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100) - 1e-9) + 1
    posted = ranked.where(F.col("rank") <= least).select("tile", "id", (F.col("rank") <= own_prefix).alias("first")).distinct()
    posted = store.table(posted.join(mixed, "id"))
    store.drop(grams)
    apart = within(posted, ["tile"], "lo < hi and some", lo=F.min("comp"), hi=F.max("comp"), some=F.max("first")).select("tile", "id", "first", "comp")
    step = float(np.log(100 / percent))
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9).cast("int")
    banded = store.table(apart.join(signed.select("id", "n"), "id").withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", own + F.col("guest")))
    banded = within(banded, ["tile", "band"], "g = 0 and lo < hi and some", m=F.count(F.lit(1)), g=F.min("guest"), lo=F.min("comp"), hi=F.max("comp"), some=F.max("first"))
    banded = banded.withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = banded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tile", "band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "n", "comp", "guest", F.col("first").cast("int").alias("first"))
    second = verified(store.table(in_tiles(dealt.join(signed.select("id", "bits"), "id"), percent)), rows, sizes, n, percent)
    final = store.table(components(first.union(second)).withColumnRenamed("node", "rep"))
    store.drop(texts, signed, posted)

    classes = made.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    # written, so that the join back is one of two shuffles, in which Spark splits a class of very many copies
    named = store.table(classes.join(final, "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")))
    return made.select("id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component the rows with the smallest id stay.

    Texts without words stay, and so do rows with a null id. Of rows that repeat an id and a text one stays; different texts
    under one id stay. Columns may have any names; an empty table gives an empty one. Only rows whose id is gone or
    repeated are shuffled, found by a bitmap of at most 2^28 bits.
    """
    found = store.table(link_classes(docs, id_col, text_col, n, percent).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "component_id"))
    marked = store.table(found.groupBy("id").agg((F.max("component_id") != F.col("id")).alias("gone"), (F.count(F.lit(1)) > 1).alias("again")).where("gone or again"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text"))
    likely, rest = bitmaps.split(packed.where("id is not null"), marked, "id")
    left = likely.join(marked.where("gone").select("id"), "id", "left_anti")
    once = left.dropDuplicates(["id", "text"])
    return once.select("row").unionByName(rest.select("row")).unionByName(packed.where("id is null").select("row")).select("row.*")
