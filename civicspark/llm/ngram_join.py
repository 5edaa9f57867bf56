"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a threshold.  Shingles are ordered from rare to frequent by a counting
sketch over the whole corpus.  The ``k``-prefix of a set of ``n`` shingles with
least overlap ``t = ceil(threshold * n)`` is its first ``n - t + k`` shingles;
two sets that link share ``k`` shingles of their ``k``-prefixes, for every k.
Each document takes the k of least estimated cost (matches read plus documents
that reach k matches, which Markov's inequality bounds), and a pair must share
as many prefix shingles as the smaller k of the two before it is verified.  What
lies behind a prefix of ``p`` shingles adds ``n - p`` at most to the overlap, so a
pair must also share what its least overlap exceeds that by.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicspark.llm import wordhash as wh
from civicspark.llm.common import (
    BROADCAST_ROWS, bounded, connected_components, grouped_rows, input_bytes, keep, partition_blobs, parts_for, runs, sized, tasks_for, unpack, with_schema,
)

#: Largest k of a k-prefix; powers of two up to a set's least overlap are weighed, and that overlap.
MAX_MATCHES = 60_000
#: Cost of a verification, for each shingle of the set, in units of one read posting: two sets are sent and compared.
VERIFY_COST = 2.0
#: Counters of the frequency sketch: about one for SKETCH_LOAD words, within these bounds.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS, SKETCH_LOAD = 18, 23, 32
#: Turns of linking sets of open postings to pivots, and pivots of a set in each.
PIVOT_TURNS, PIVOTS = 2, 3
#: Smallest shingles of a set that make up its sketch, and the similarity by sketches from which a pair with a pivot is verified.
SKETCH_SIZE, SKETCH_CUT = 32, 0.5
#: Hubs of a block, and partners of a block that a task verifies.
BLOCK_HUBS, BLOCK_ROWS = 48, 1_000
#: Turns of verifying each set's best partner of what is still apart.
BEST_TURNS = 1
#: Ends of pairs that may be broadcast with their hubs; more are shuffled.
ASKED_ENDS = 100_000
#: Sets of a block of a lead, sets of a group whose postings are paired one by one, and shingles of such groups held at once.
BLOCK_SETS, SMALL_GROUP, GROUP_ROWS = 256, 48, 500_000
#: Sets or shingles of a block of a product.
BLOCK = 256

_ROW = [np.uint64, np.uint64, np.uint32, np.uint16]  # shingle, set id, set size, k


def _set_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set of sorted shingles, equal for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wh.mix(h))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wh.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(off).astype(np.uint64)
    return wh.mix(wh.mix(total[off[1:]] - total[off[:-1]]) ^ (other[off[1:]] - other[off[:-1]]) + n)


def _sets(batches, text: str, width: int):
    """(batch, shingles, offsets) of slices of the batches."""
    for batch in batches:
        for part in wh.chunks(batch, text):
            words = wh.split_words(part.column(part.schema.get_field_index(text)), lower=True)
            yield (part, *wh.shingle_sets(words, width))


def _least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-num * n // den)


def _smallest(h: np.ndarray, off: np.ndarray) -> pa.Array:
    """The leading halves of the SKETCH_SIZE smallest shingles of each set, which come sorted."""
    sizes = np.minimum(np.diff(off), SKETCH_SIZE)
    at = np.r_[0, np.cumsum(sizes)]
    taken = np.repeat(off[:-1] - at[:-1], sizes) + np.arange(at[-1])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((h[taken] >> np.uint64(32)).astype(np.uint32).view(np.int32)))


def shingle_profile(docs: DataFrame, text: str, id_col: str, width: int) -> tuple[DataFrame, np.ndarray]:
    """Set size, set id and smallest shingles of every document, and the frequency sketch of all shingles.

    The frequency sketch counts shingles by their leading bits, up to 65,535.
    """
    slices = 64
    expected = max(1, input_bytes(docs) // 4 // SKETCH_LOAD)
    bits = max(LEAST_SKETCH_BITS, min(MOST_SKETCH_BITS, math.ceil(math.log2(expected))))

    def scan(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for part, h, off in _sets(batches, text, width):
            np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            n = part.num_rows
            yield {
                "id": part.column(part.schema.get_field_index(id_col)), "n": np.diff(off),
                "set_id": _set_ids(h, off).view(np.int64), "low": _smallest(h, off), "slice": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary()),
            }
        if counts.any():
            none, press = pa.nulls(slices, pa.int64()), zstandard.ZstdCompressor(level=1)
            blobs = [press.compress(np.minimum(x, 65535).astype(np.uint16).tobytes()) for x in np.split(counts, slices)]
            yield {"id": none, "n": none, "set_id": none, "low": pa.nulls(slices, pa.list_(pa.int32())), "slice": range(slices), "counts": blobs}

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("low", pa.list_(pa.int32())), ("slice", pa.int32()), ("counts", pa.binary())])
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    scanned = keep(base.mapInArrow(with_schema(scan, schema), "id long, n long, set_id long, low array<int>, slice int, counts binary"), "profile")

    def add(batches):
        unpress = zstandard.ZstdDecompressor()
        for (which,), held in grouped_rows(batches, ["slice"]):
            total = np.zeros((1 << bits) // slices, np.uint32)
            for batch in held:
                for blob in batch.column(1).to_pylist():
                    total += np.frombuffer(unpress.decompress(blob), np.uint16)
            yield {"slice": [which], "counts": [np.minimum(total, 65535).astype(np.uint16).tobytes()]}

    summed = (
        scanned.where("slice is not null").select("slice", "counts").repartition(slices, "slice").sortWithinPartitions("slice")
        .mapInArrow(with_schema(add, pa.schema([("slice", pa.int32()), ("counts", pa.binary())])), "slice int, counts binary")
        .collect()
    )  # at most 2 ** MOST_SKETCH_BITS counters
    sketch = np.zeros((slices, (1 << bits) // slices), np.uint16)
    for row in summed:
        sketch[row.slice] = np.frombuffer(row.counts, np.uint16)
    return scanned.where("slice is null").select("id", "n", "set_id", "low"), sketch.ravel()


def _prefixes(h, off, sketch, num, den):
    """Prefix rows of the sets: shingle, set index, k."""
    n = np.diff(off)
    seen = sketch[(h >> np.uint64(65 - len(sketch).bit_length())).astype(np.int64)]
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, seen, doc))
    h, seen = h[order], seen[order]
    place = np.arange(len(h)) - np.repeat(off[:-1], n)
    base = n - _least_overlap(n, num, den)
    noise = max(1.0, float(sketch.mean()))
    total = np.concatenate([np.zeros(1), np.cumsum(np.maximum(0.0, seen.astype(np.float64) - noise))])
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    overlap, k = np.minimum(n - base, MAX_MATCHES), 1
    while len(n) and k < 2 * int(overlap.max()):
        taken = np.minimum(k, overlap)  # the last choice is the whole set
        length = base + taken
        read = total[off[:-1] + length] - total[off[:-1]]
        cost = (read + length) + VERIFY_COST * n * read / taken
        better = cost < best
        best[better], matches[better] = cost[better], taken[better]
        k *= 2
    used = place < (base + matches)[doc]
    return h[used], doc[used], matches[doc][used]


def _needed(na, nb, ka, kb, num, den):
    """Shared prefix shingles that a pair needs at least, and whether its sizes let it link."""
    overlap = -(-num * (na + nb) // (num + den))
    behind = np.maximum(np.maximum(0, _least_overlap(na, num, den) - ka), np.maximum(0, _least_overlap(nb, num, den) - kb))
    fits = np.minimum(na, nb) * den >= num * np.maximum(na, nb)
    return np.maximum(np.minimum(ka, kb), overlap - behind), fits


def _summed(a, b, need):
    """Pairs once each, with their number of rows."""
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], need[first], np.diff(np.r_[first, len(a)])


def _posting_starts(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)


def _neighbours(token, doc, n, k, num, den):
    """Two partners at most of every row: (smaller, larger, needed, shared), first of next sizes, then of pivots.

    The rows come sorted by shingle, size and set id, without repeats.  One
    partner is the row before in that order, the other is the posting's pivot,
    the set of largest hash.  A pair is named once for a posting, so the counts
    never exceed what the two sets share.
    """
    row = np.arange(len(token))
    starts = _posting_starts(token)
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(token)]))
    mixed = wh.mix(doc.view(np.uint64))
    pivot = np.flatnonzero(mixed == np.maximum.reduceat(mixed, starts)[run])[run] if len(row) else row
    for at, other in ((row[1:], row[:-1]), (row[np.abs(row - pivot) > 1], pivot[np.abs(row - pivot) > 1])):
        need, fits = _needed(n[at], n[other], k[at], k[other], num, den)
        fits &= token[at] == token[other]
        x, y = doc[at[fits]], doc[other[fits]]
        yield _summed(np.minimum(x, y), np.maximum(x, y), need[fits])


def candidate_rows(docs: DataFrame, text: str, id_col: str, width: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """Rows of postings that sets of near sizes share (``b`` null), and the pairs of :func:`_neighbours` with
    how many shingles they share there at least, ``star`` of them through a pivot (``shingle`` null).

    Prefix rows travel as packed arrays, once for each task and set, so a set
    that many documents share costs one row a task.
    """
    parts = 4 * parts_for(docs, 4_000_000)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # of bounded size

    def send(batches):
        counts, sent = shared.value, np.zeros(0, np.uint64)
        for part, h, off in _sets(batches, text, width):
            ids = _set_ids(h, off)
            _, first = np.unique(ids, return_index=True)
            fresh = np.zeros(len(ids), bool)
            fresh[first] = True
            fresh &= (np.diff(off) > 0) & ~np.isin(ids, sent)
            sent = np.union1d(sent, ids[fresh])
            h = h[np.repeat(fresh, np.diff(off))]
            n, ids = np.diff(off)[fresh], ids[fresh]
            off = np.r_[0, np.cumsum(n)]
            token, doc, k = _prefixes(h, off, counts, num, den)
            where = (token % np.uint64(parts)).astype(np.int64)
            blobs = list(partition_blobs(where, [token, ids[doc], n[doc].astype(np.uint32), k.astype(np.uint16)]))
            if blobs:
                yield {"part": [p for p, _ in blobs], "rows": [x for _, x in blobs]}

    def meet(batches):
        for (_,), held in grouped_rows(batches, ["part"]):
            columns = [unpack(x, _ROW) for batch in held for x in batch.column(1).to_pylist()]
            token, doc, n, k = (np.concatenate(x) for x in zip(*columns))
            n, k, doc = n.astype(np.int64), k.astype(np.int64), doc.view(np.int64)
            order = np.lexsort((doc, n, token))
            token, doc, n, k = token[order], doc[order], n[order], k[order]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]
            token, doc, n, k = (x[fresh] for x in (token, doc, n, k))
            near = np.r_[False, (token[1:] == token[:-1]) & (n[:-1] * den >= num * n[1:]), False]
            token, doc, n, k = (x[near[1:] | near[:-1]] for x in (token, doc, n, k))
            for star, (a, b, need, shared) in enumerate(_neighbours(token, doc, n, k, num, den)):
                none = pa.nulls(len(a), pa.int64())
                yield {"a": a, "b": b, "need": need, "shared": shared, "star": shared * star, "shingle": none, "n": none, "k": none}
            none = pa.nulls(len(doc), pa.int64())
            yield {"a": doc, "b": none, "need": none, "shared": none, "star": none, "shingle": token.view(np.int64), "n": n, "k": k}

    base = docs.where(F.col(id_col).isNotNull()).select(F.col(text).cast("string").alias(text))
    sent = base.mapInArrow(with_schema(send, pa.schema([("part", pa.int32()), ("rows", pa.binary())])), "part int, rows binary")
    names = ["a", "b", "need", "shared", "star", "shingle", "n", "k"]
    return (
        sent.repartition(tasks_for(parts // 4), "part").sortWithinPartitions("part")
        .mapInArrow(with_schema(meet, pa.schema([(x, pa.int64()) for x in names])), ", ".join(f"{x} long" for x in names))
    )


def verify(
    pairs: DataFrame, docs: DataFrame, owner: DataFrame, text: str, id_col: str, width: int, num: int, den: int, component: DataFrame | None = None
) -> DataFrame:
    """Those of the pairs ``a``, ``b`` of set ids that link.

    One end of a pair is its hub, the end of the larger component if components
    are given.  Hubs of one component form blocks; a block holds its hubs' sets
    while partners' sets stream by, each sent once to a block, and is dealt over
    several tasks if it has many partners.
    owner: ``set_id`` and ``id`` of one document that has the set.
    """
    if component is None:
        dealt = pairs.select(F.col("a").alias("hub"), "b", F.col("a").alias("block"))
    else:
        sizes = component.groupBy("component").agg((F.count("*") + 1).alias("size"))
        held = component.join(sizes, "component").select("id", "component", "size").union(sizes.select("component", "component", "size"))
        if component.count() <= BROADCAST_ROWS // 2:  # roots are no more than members
            held = F.broadcast(held)
        for end in ("a", "b"):
            pairs = pairs.join(held.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"), F.col("size").alias(f"s_{end}")), end, "left")
        turn = F.coalesce("s_b", F.lit(1)) > F.coalesce("s_a", F.lit(1))
        hub, home = F.when(turn, F.col("b")).otherwise(F.col("a")), F.when(turn, F.col("c_b")).otherwise(F.col("c_a"))
        size = F.when(turn, F.col("s_b")).otherwise(F.coalesce("s_a", F.lit(1)))
        slice_of = F.pmod(F.xxhash64(hub), F.ceil(size / BLOCK_HUBS))
        dealt = pairs.select(hub.alias("hub"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.xxhash64(F.coalesce(home, hub), slice_of).alias("block"))
    dealt = keep(dealt.groupBy("block", "b").agg(F.collect_set("hub").alias("hubs")), "dealt")
    busy = sized(dealt.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("slots")), dealt.count())
    partners = dealt.join(busy, "block").select("block", F.pmod(F.xxhash64("b"), F.col("slots")).alias("slot"), F.col("b").alias("set_id"), "hubs")
    hubs = dealt.select("block", F.explode("hubs").alias("set_id")).distinct().join(busy, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "set_id", F.lit(None).cast("array<long>").alias("hubs")
    )
    asked, ends = hubs.union(partners), dealt.select(F.explode(F.array_append("hubs", F.col("b"))).alias("set_id"))
    total = dealt.agg(F.sum(F.size("hubs") + 1)).first()[0] or 0
    if total <= ASKED_ENDS:
        asked, ends = F.broadcast(asked), F.broadcast(ends)
        wanted = F.broadcast(owner.join(ends, "set_id", "left_semi").select("set_id", F.col("id").alias("doc")))
    else:
        wanted = owner.join(ends.distinct(), "set_id", "left_semi").select("set_id", F.col("id").alias("doc"))
        wanted = bounded(keep(wanted, "wanted"))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias(text))

    def sets(batches):
        sent = set()
        for part, h, off in _sets(batches, text, width):
            # rows of one id may hold different texts, and repeated rows one text
            asked_id, own_id = part.column(part.schema.get_field_index("set_id")).to_pylist(), _set_ids(h, off).view(np.int64).tolist()
            fresh = {x: i for i, (x, own) in enumerate(zip(asked_id, own_id)) if x == own and x not in sent}
            sent.update(fresh)
            yield {"set_id": list(fresh), "shingles": [h[off[i] : off[i + 1]].tobytes() for i in fresh.values()]}

    sets_of = base.join(wanted, "doc").select("set_id", text).mapInArrow(
        with_schema(sets, pa.schema([("set_id", pa.int64()), ("shingles", pa.binary())])), "set_id long, shingles binary"
    )

    def meet(batches):
        now, held = None, {}
        for key, part in runs(batches, ["block", "slot"]):
            if key != now:
                now, held = key, {}
            found = []
            for other, mine, blob in zip(*(part.column(k).to_pylist() for k in (2, 3, 4))):
                one = np.frombuffer(blob, np.uint64)
                if mine is None:
                    held[other] = one
                    continue
                for hub in mine:
                    x = held[hub]
                    same = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, one), len(x) - 1)] == one))
                    if same * den >= num * (len(x) + len(one) - same):
                        found.append((hub, other))
            if found:
                yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return (
        sets_of.join(asked, "set_id").withColumn("late", F.col("hubs").isNotNull())
        .repartition("block", "slot").sortWithinPartitions("block", "slot", "late").select("block", "slot", "set_id", "hubs", "shingles")
        .mapInArrow(with_schema(meet, pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long")
    )


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    held = bounded(component)
    for end in ("a", "b"):
        pairs = pairs.join(held.select(F.col("id").alias(end), F.col("component").alias(f"component_{end}")), end, "left")
    return pairs.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).drop("component_a", "component_b")


def _open_rows(rows: DataFrame, component: DataFrame) -> DataFrame:
    """Rows, with their components, of postings that two or more components share, and each posting's ``lead``,
    the component that has most of it, written.
    """
    rows = rows.join(bounded(component.withColumnRenamed("id", "a")), "a", "left").withColumn("component", F.coalesce("component", "a"))
    sizes = rows.groupBy("shingle", "component").agg(F.count("*").alias("count"), F.min("k").alias("k"))
    shared = sizes.groupBy("shingle").agg(F.max(F.struct("count", "component")).alias("top"), F.min("k").alias("low"), F.count("*").alias("components"))
    shared = keep(shared.where("components > 1").select("shingle", F.col("top.component").alias("lead"), "low"), "shared")
    return keep(rows.join(bounded(shared), "shingle"), "open")


def _star(rows: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs of sets with pivots: in every open posting, one set of its lead.

    Which one changes with the turn.  A set gets at most PIVOTS pivots, those it
    shares most postings with, so the pairs are as many as the sets.
    """
    head = F.max(F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("pivot"), F.col("n").alias("pivot_n"))).alias("head")
    pivots = rows.where("component = lead").groupBy("shingle").agg(head).select("shingle", "head.pivot", "head.pivot_n")
    near = F.least("n", "pivot_n") * den >= F.lit(num) * F.greatest("n", "pivot_n")
    shared = rows.where("component <> lead").join(bounded(keep(pivots, "pivots")), "shingle").where(near).groupBy("a", "pivot").count()
    order = Window.partitionBy("a").orderBy(F.desc("count"), "pivot")
    return shared.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select("a", F.col("pivot").alias("b"))


def _promising(pairs: DataFrame, owner: DataFrame) -> DataFrame:
    """Those of the pairs that are alike by the smallest shingles of their sets, which estimate their similarity.

    Only for pairs with pivots, which spare work: a pair that is left out here
    wrongly is found by the last wave.
    """
    for end in ("a", "b"):
        pairs = pairs.join(owner.select(F.col("set_id").alias(end), F.col("low").alias(f"low_{end}")), end)
    union = F.slice(F.array_sort(F.transform(F.array_union("low_a", "low_b"), lambda x: x.cast("long").bitwiseAND(0xFFFFFFFF))), 1, SKETCH_SIZE)
    both = F.transform(F.array_intersect("low_a", "low_b"), lambda x: x.cast("long").bitwiseAND(0xFFFFFFFF))
    return pairs.where(F.size(F.array_intersect(union, both)) >= SKETCH_CUT * F.size(union)).select("a", "b")


def _products(sets: dict[str, np.ndarray], row: np.ndarray, token: np.ndarray, num: int, den: int):
    """Pairs of the sets of a group, by products of blocks of sets with blocks of shingles.

    row and token: which set has which shingle, in any order.  Only pairs across
    components and, in a group of two blocks, across them count.
    """
    by_size = np.argsort(sets["n"], kind="stable")
    place = np.empty(len(by_size), np.int64)
    place[by_size] = np.arange(len(by_size))
    ids, n, k, c, held, block = (sets[x][by_size] for x in ("a", "n", "k", "component", "held", "block"))
    two = sets["first"][0] != sets["second"][0]
    row = place[row]
    order = np.argsort(row, kind="stable")
    row, token = row[order], np.unique(token, return_inverse=True)[1][order]
    at = np.searchsorted(row, np.arange(len(ids) + 1))
    elsewhere = held - np.diff(at)
    for low in range(0, len(ids), BLOCK):
        high = min(low + BLOCK, len(ids))
        # only sizes within the threshold of this block's
        stop = int(np.searchsorted(n * num, n[high - 1] * den, "right"))
        r, x = row[at[low] : at[stop]] - low, token[at[low] : at[stop]]
        shared = np.zeros((high - low, stop - low), np.float32)
        for t in range(0, int(token.max()) + 1, BLOCK):
            inside = (x >= t) & (x < t + BLOCK)
            has = np.zeros((stop - low, BLOCK), np.float32)
            has[r[inside], x[inside] - t] = 1
            shared += has[: high - low] @ has.T
        i, j = np.nonzero(shared)
        count = shared[i, j].astype(np.int64)
        i, j = i + low, j + low
        need, fits = _needed(n[i], n[j], k[i], k[j], num, den)
        fits &= (i < j) & (c[i] != c[j]) & (count + np.minimum(elsewhere[i], elsewhere[j]) >= need)
        if two:
            fits &= block[i] != block[j]
        i, j = i[fits], j[fits]
        yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), need[fits], count[fits]


def _each_pair(sets: dict[str, np.ndarray], row: np.ndarray, token: np.ndarray, group: np.ndarray, num: int, den: int):
    """Pairs of the sets of many small groups: those of every posting of a group, summed."""
    order = np.lexsort((row, token, group[row]))
    row, token = row[order], token[order]
    of = group[row]
    starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (of[1:] != of[:-1])])
    count = np.diff(np.r_[starts, len(token)])
    out = []
    for c in np.unique(count[count > 1]):
        at = starts[count == c]
        i, j = np.triu_indices(c, 1)
        out.append((row[(at[:, None] + i).ravel()], row[(at[:, None] + j).ravel()]))
    if not out:
        return
    i, j = (np.concatenate(x) for x in zip(*out))
    across = (sets["component"][i] != sets["component"][j]) & ((sets["first"] == sets["second"])[i] | (sets["block"][i] != sets["block"][j]))
    i, j = i[across], j[across]
    need, fits = _needed(sets["n"][i], sets["n"][j], sets["k"][i], sets["k"][j], num, den)
    i, j, need, shared = _summed(i[fits], j[fits], need[fits])
    elsewhere = sets["held"] - np.bincount(row, minlength=len(sets["a"]))
    fits = shared + np.minimum(elsewhere[i], elsewhere[j]) >= need
    a, b = sets["a"][i[fits]], sets["a"][j[fits]]
    yield np.minimum(a, b), np.maximum(a, b), need[fits], shared[fits]


def _open_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs across components of open postings, with the prefix shingles they need and share.

    Postings are gathered by their lead, and a set has one row for each lead,
    with all its shingles there.  A lead of many sets is dealt over several tasks,
    each with two blocks of its sets.  A pair is passed on if what it shares
    there, with all that its sets have elsewhere, can reach what it needs.
    """
    total = rows.groupBy("a").agg(F.count("*").alias("held"), F.min(F.least("k", "low")).alias("least")).where("held >= least")
    packed = rows.groupBy("lead", "a").agg(F.collect_list("shingle").alias("shingles"), *(F.first(x).alias(x) for x in ("n", "k", "component")))
    packed = keep(packed.join(bounded(keep(total.select("a", "held"), "held")), "a"), "packed")
    large = packed.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks")).where("blocks > 1")
    dealt = packed.join(bounded(keep(large, "large")), "lead", "left").withColumn("block", F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.select("*", other.alias("other")).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))

    small_group, group_rows = SMALL_GROUP, GROUP_ROWS

    def meet(batches):
        names = ("a", "n", "k", "component", "held", "block", "first", "second")
        small, size = [], 0

        def arrays(tables):
            table = pa.Table.from_batches([x for held in tables for x in held])
            lists = table.column("shingles").combine_chunks()
            counts = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
            group = np.repeat(np.arange(len(tables)), [sum(x.num_rows for x in held) for held in tables])
            return {x: table.column(x).to_numpy() for x in names}, counts, lists.flatten().to_numpy(), group

        def pairs(found):
            for a, b, need, shared in found:
                yield {"a": a, "b": b, "need": need, "shared": shared}

        for _, held in grouped_rows(batches, ["lead", "first", "second"]):
            sets = sum(x.num_rows for x in held)
            if sets > small_group:
                own, row, token, _ = arrays([held])
                yield from pairs(_products(own, row, token, num, den))
                continue
            small.append(held)
            size += sum(len(x.column(x.schema.get_field_index("shingles")).flatten()) for x in held)
            if size > group_rows:
                yield from pairs(_each_pair(*arrays(small), num, den))
                small, size = [], 0
        if small:
            yield from pairs(_each_pair(*arrays(small), num, den))

    names = ["a", "b", "need", "shared"]
    return dealt.select("lead", "first", "second", "block", "a", "n", "k", "component", "held", "shingles").repartition("lead", "first", "second").sortWithinPartitions(
        "lead", "first", "second"
    ).mapInArrow(with_schema(meet, pa.schema([(x, pa.int64()) for x in names])), ", ".join(f"{x} long" for x in names))


def _joined(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: ``id`` and ``component``, of all but the ids that name a component."""
    if component is None:
        return keep(connected_components(links, roots=False), "component")
    held = bounded(component)
    for end in ("a", "b"):
        links = links.join(held.select(F.col("id").alias(end), F.col("component").alias(f"component_{end}")), end, "left")
    merged = connected_components(links.select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b")), roots=False)
    moved = component.join(bounded(merged.select(F.col("id").alias("component"), F.col("component").alias("root"))), "component", "left")
    return keep(moved.select("id", F.coalesce("root", "component").alias("component")).union(merged), "component")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def ngram_jaccard_join(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, threshold: tuple[int, int] = (75, 100)
) -> DataFrame:
    """Documents with the component of their similarity links.

    Returns ``id_col``, ``n_shingles``, ``set_id`` (equal for equal sets) and
    ``component_id``, the smallest id that links reach, one row for each row of
    ``docs``.  Words are runs other than ``[\\x20\\x09-\\x0D]`` with A-Z folded; a
    text of fewer than ``width`` words is one shingle, an empty or null text has
    none and links with nothing.  Rows of equal sets (copies, repeated rows)
    form one class before anything is paired.  Rows of a null id get a null
    component and link nothing; rows of one id with different texts are linked
    by their own texts.  Other columns of ``docs`` are not read.

    Candidates are verified in waves.  In the first, a row of a posting has two
    partners at most, the row of next size and the posting's pivot, and a set
    takes the best of each kind.  The next two take pivots of the components
    that this left apart.  The last wave takes every pair whose ends then still
    lie in different components.  So a large group of near copies costs rows in
    proportion to its size, and no link between components is lost.
    """
    g = math.gcd(*threshold)
    num, den = threshold[0] // g, threshold[1] // g
    profile, sketch = shingle_profile(docs, text, id_col, width)
    owner = keep(profile.where("n > 0 and id is not null").groupBy("set_id", "n").agg(F.min("id").alias("id"), F.first("low").alias("low")), "owner")
    found = keep(candidate_rows(docs, text, id_col, width, num, den, sketch), "candidates")
    args = (docs, owner, text, id_col, width, num, den)
    rows = found.where("b is null").select("a", "shingle", "n", "k")
    strong = found.where("b is not null").groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("shared").alias("shared"), F.sum("star").alias("star")).where("shared >= need")
    ends = keep(strong.select("a", "b", "shared", "star").union(strong.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "star")), "ends")
    best = ends.groupBy("a").agg(F.max(F.struct("shared", F.col("b").alias("b"))).alias("best"))
    pivot = ends.where("star > 0").groupBy("a").agg(F.max(F.struct("star", F.col("b").alias("b"))).alias("best"))
    new = keep(verify(_ordered(best.union(pivot).select("a", "best.b")).distinct(), *args), "links")
    component = _joined(None, new)
    for turn in range(PIVOT_TURNS):
        rows = _open_rows(rows.select("a", "shingle", "n", "k"), component)
        pairs = keep(_promising(_ordered(_star(rows, turn, num, den)).distinct(), owner), "pivot-pairs")
        new = keep(verify(pairs, *args, component), "links")
        component = _joined(component, new)
    rows = _open_rows(rows.select("a", "shingle", "n", "k"), component)
    rest = _open_pairs(rows, num, den).groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("shared").alias("shared"))
    rest = keep(rest.where("shared >= need").select("a", "b", (F.col("shared") - F.col("need")).alias("more")), "rest")
    for turn in range(BEST_TURNS):
        if turn:
            rest = keep(_apart(rest, component), "rest")
        both = rest.select("a", "b", "more").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b"), "more"))
        best = both.groupBy("a").agg(F.max(F.struct("more", F.col("b").alias("b"))).alias("best")).select("a", "best.b")
        new = keep(verify(_ordered(best), *args, component), "links")
        component = _joined(component, new)
    new = keep(verify(_apart(rest, component).select("a", "b"), *args, component), "links")
    component = _joined(component, new)
    # components of set ids; the smallest document of each
    classes = owner.join(component.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    of_set = keep(classes.join(least, "component").select("set_id", "n", "component_id"), "classes")
    component_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return profile.join(of_set, ["set_id", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), "set_id"
    )


def keep_one_per_component(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose component holds a smaller id; see :func:`ngram_jaccard_join`."""
    joined = ngram_jaccard_join(docs, text, id_col)
    dropped = joined.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(bounded(keep(dropped, "dropped")), id_col, "left_anti")
