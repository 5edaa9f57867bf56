"""The trie of shared conversation prefixes, from polynomial fingerprints.

A turn is known by the SHA-256 of its role and text, so no text is shuffled.
Conversations are sorted over all tasks by range, so that one of any length is
split; numpy scans give every prefix a polynomial fingerprint, and the parts of
a conversation that spans tasks are joined by their powers of the base.  Rows of
one depth and fingerprint are a candidate node.  Each is held turn by turn
against its representative: all members must agree in the digest of the last
turn and in the fingerprint of the prefix before it, which by induction makes
whole prefixes equal.  Where they do not, the turn gets a hash of both added to
its own, and fingerprints are taken anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import keep, runs, with_schema

#: Base of the polynomials, odd; arithmetic is modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Conversation ids in a row of the chunks that are hashed one after the other.
CHUNK_IDS = 4_096
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_SCANNED = pa.schema(
    [
        ("part", pa.int32()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("fp", pa.int64()),
        ("prev_fp", pa.int64()),
        ("digest", pa.binary()),
        ("chars", pa.int64()),
        ("before", pa.int64()),
        ("extra", pa.int64()),
    ]
)
_SCANNED_DDL = "part int, conv_id long, depth long, fp long, prev_fp long, digest binary, chars long, before long, extra long"


def turn_digests(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv_id, turn, digest (SHA-256 of role and text) and chars (code points of the text) of every turn.

    Null roles and texts count as empty; rows without a conversation are left out.
    """
    said_by, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.concat(F.length(said_by).cast("string"), F.lit(":"), said_by, said)
    return turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.length(said).cast("long").alias("chars"),
    )


def _powers(exponents: np.ndarray) -> np.ndarray:
    """The base to so many powers, modulo 2**64, from two short tables."""
    if not len(exponents):
        return np.zeros(0, np.uint64)
    low = _table(_BASE, 1 << 12)
    high = _table((low[-1:] * _BASE)[0], int(exponents.max() >> 12) + 1)
    return low[exponents & 0xFFF] * high[exponents >> 12]


def _table(factor: np.uint64, size: int) -> np.ndarray:
    steps = np.full(size, factor, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _scan(bits: int):
    """A scan of batches sorted by conversation and turn: places, fingerprints and characters before each turn."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv_now, count, total, chars_now = None, 0, np.uint64(0), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            chars = batch.column("chars").to_numpy(zero_copy_only=False)
            extra = batch.column("extra").to_numpy(zero_copy_only=False).view(np.uint64)
            digest = batch.column("digest")
            whole = np.frombuffer(b"".join(digest.to_pylist()), np.uint8).reshape(n, 32)
            h = np.ascontiguousarray(whole[:, :8]).view(np.uint64).ravel()
            h = (h & mask) + extra
            first = np.r_[True, conv[1:] != conv[:-1]]
            start = np.flatnonzero(first)
            sizes = np.diff(np.r_[start, n])
            goes_on = conv_now is not None and conv[0] == conv_now
            place = np.arange(n) - np.repeat(start, sizes) + 1
            if goes_on:
                place[: sizes[0]] += count
            term = h * _powers(place)
            summed = np.cumsum(term, dtype=np.uint64)
            fp = summed - np.repeat(summed[start] - term[start], sizes)
            said = np.cumsum(chars)
            before = said - chars
            before = before - np.repeat(before[start], sizes)
            if goes_on:
                fp[: sizes[0]] += total
                before[: sizes[0]] += chars_now
            conv_now, count, total, chars_now = conv[-1], int(place[-1]), fp[-1], int(before[-1] + chars[-1])
            yield {
                "part": batch.column("part"),
                "conv_id": conv,
                "depth": place,
                "fp": fp.view(np.int64),
                "prev_fp": (fp - term).view(np.int64),
                "digest": digest,
                "chars": chars,
                "before": before,
                "extra": extra.view(np.int64),
            }

    return run


def _carried(rows: DataFrame) -> DataFrame:
    """``rows`` with the parts of conversations that span tasks joined.

    Only the first conversation of a task can have begun before it, so there is
    one carry for each task at most, computed by the driver.
    """
    parts = rows.groupBy("conv_id", "part").agg(F.max("depth").alias("n"), F.max_by("fp", "depth").alias("fp"), F.sum("chars").alias("chars"))
    spans = rows.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv_id")
    carries: dict[int, tuple[int, int, np.ndarray, int]] = {}
    now = None
    for r in parts.join(spans, "conv_id").orderBy("conv_id", "part").collect():
        if now is None or now[0] != r.conv_id:
            now = (r.conv_id, 0, np.zeros(1, np.uint64), 0)
        else:
            carries[r.part] = now
        total = now[2] + np.array([r.fp]).view(np.uint64) * _powers(np.array([now[1]]))
        now = (r.conv_id, now[1] + r.n, total, now[3] + r.chars)
    if not carries:
        return rows

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {name: batch.column(name) for name in _SCANNED.names}
            part, conv, depth, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "conv_id", "depth", "before"))
            fp, prev = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "prev_fp"))
            depth, before, fp, prev = depth.copy(), before.copy(), fp.copy(), prev.copy()
            for p in np.unique(part):
                if int(p) in carries:
                    whose, offset, total, chars = carries[int(p)]
                    at = (part == p) & (conv == whose)
                    shift = _powers(np.array([offset]))
                    fp[at], prev[at] = total + shift * fp[at], total + shift * prev[at]
                    depth[at] += offset
                    before[at] += chars
            yield out | {"depth": depth, "before": before, "fp": fp.view(np.int64), "prev_fp": prev.view(np.int64)}

    return rows.mapInArrow(with_schema(add, _SCANNED), _SCANNED_DDL)


def sequences(turns: DataFrame, bits: int = 64) -> DataFrame:
    """A row for each turn with its depth (from 1), fingerprint and the characters before it; written and read back.

    turns: columns of :func:`turn_digests`.  Turns are in ascending order, nulls
    first, and those of one number in the order of their digests; repeated rows
    are turns of their own.
    """
    if "extra" not in turns.columns:
        turns = turns.withColumn("extra", F.lit(0).cast("long"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    dealt = turns.select("conv_id", "turn", "digest", "chars", "extra").repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(with_schema(_scan(bits), _SCANNED), _SCANNED_DDL)
    return _carried(keep(scanned, "trie-scan"))


def _candidates(rows: DataFrame) -> DataFrame:
    """The groups of one depth and fingerprint, and whether their members disagree."""
    groups = rows.groupBy("depth", "fp").agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.min("prev_fp").alias("prev_fp"),
        F.max("prev_fp").alias("other_fp"),
        F.min("digest").alias("digest"),
        F.max("digest").alias("other_digest"),
        F.min("before").alias("before"),
    )
    differ = (F.col("prev_fp") != F.col("other_fp")) | (F.col("digest") != F.col("other_digest"))
    return groups.withColumn("collided", differ).drop("other_fp", "other_digest", "digest")


def _verified(turns: DataFrame, bits: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) whose fingerprints tell all prefixes apart; collided groups are split and scanned anew."""
    rows = sequences(turns, bits)
    for split in range(rounds):
        nodes = keep(_candidates(rows), "trie-nodes")
        collided = nodes.where("collided").select("depth", "fp", F.lit(True).alias("collided"))
        if collided.limit(1).count() == 0:
            return rows, nodes.drop("collided")
        # turns of a collided group differ in digest or in what came before: a hash of both parts them
        apart = F.when(F.col("collided"), F.xxhash64("digest", "prev_fp", F.lit(split))).otherwise(F.col("extra"))
        again = rows.join(collided, ["depth", "fp"], "left").select("conv_id", F.col("depth").alias("turn"), "digest", "chars", apart.alias("extra"))
        rows = sequences(again, bits)
    raise RuntimeError(f"fingerprints still collide after {rounds} rounds")


def _chunks_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Runs of ids of one node, as text, with the first id of each."""
    for (depth, fp), rows in runs(batches, ["depth", "fp"]):
        ids = rows.column("conv_id").to_pylist()
        for k in range(0, len(ids), CHUNK_IDS):
            yield {"depth": [depth], "fp": [fp], "first": [ids[k]], "ids": [",".join(map(str, ids[k : k + CHUNK_IDS]))]}


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """SHA-256 of the joined chunks of each node, fed one after the other."""
    now, state = None, None
    for key, rows in runs(batches, ["depth", "fp"]):
        if key != now:
            if now is not None:
                yield {"depth": [now[0]], "fp": [now[1]], "ends_sha256": [state.hexdigest()]}
            now, state, comma = key, hashlib.sha256(), b""
        for ids in rows.column("ids").to_pylist():
            state.update(comma + ids.encode())
            comma = b","
    if now is not None:
        yield {"depth": [now[0]], "fp": [now[1]], "ends_sha256": [state.hexdigest()]}


def _batched(function, schema: pa.Schema, rows: int = 2_048):
    """``function``'s single rows, gathered to larger batches."""

    def run(batches):
        held: dict[str, list] = {name: [] for name in schema.names}
        for columns in function(batches):
            for name in schema.names:
                held[name] += columns[name]
            if len(held[schema.names[0]]) >= rows:
                yield held
                held = {name: [] for name in schema.names}
        if held[schema.names[0]]:
            yield held

    return with_schema(run, schema)


def _ends(ends: DataFrame) -> DataFrame:
    """depth, fp and ends_sha256 of every node that conversations end in.

    The hash reads a node's ids in order, so it is taken in one task, from
    chunks of CHUNK_IDS ids that are streamed, never held together.
    """
    keys = ["depth", "fp"]
    chunk = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    hashed = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("ends_sha256", pa.string())])
    dealt = ends.select("depth", "fp", "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    chunks = dealt.mapInArrow(_batched(_chunks_of_ids, chunk, 256), "depth long, fp long, first long, ids string")
    sorted_chunks = chunks.repartition(*keys).sortWithinPartitions(*keys, "first")
    return sorted_chunks.mapInArrow(_batched(_hashed_ids, hashed), "depth long, fp long, ends_sha256 string")


@dataclass
class Trie:
    """Nodes of the trie and the rows they were made of."""

    nodes: DataFrame
    rows: DataFrame


def trie(turns: DataFrame, convs: DataFrame, bits: int = 64, rounds: int = 8) -> Trie:
    """The prefix trie of turns given by digests.

    turns: conv_id, turn, digest and chars, as of :func:`turn_digests`; convs: a
    column conv_id with every conversation, those without turns included.  See
    :func:`prefix_trie` for the nodes.  ``bits`` shortens the turns' hashes, for
    tests of collisions.
    """
    rows, groups = _verified(turns, bits, rounds)
    ended = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"), F.sum("chars").alias("total"))
    ended = convs.select(F.col("conv_id").cast("long")).where("conv_id IS NOT NULL").distinct().join(ended, "conv_id", "left")
    ended = keep(ended.na.fill(0, ["depth", "fp", "total"]), "trie-ends")

    children = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("prev_fp").alias("fp")).agg(F.count("*").alias("n_children"))
    # a conversation owns the nodes whose smallest member it is: from one depth on, to its end
    owned = groups.join(children, ["depth", "fp"], "left").groupBy("conv_id").agg(
        F.min("before").alias("until"), F.max(F.col("n_children").isNull().cast("int")).alias("leaf")
    )
    # what it says before that is said by a smaller member too, and saved once in every node from there up
    owners = ended.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("until", "total").alias("until"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")
    )
    owners = keep(owners, "trie-owners")
    sums = (
        rows.join(owners, "conv_id")
        .groupBy("depth", "fp")
        .agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("until") - F.col("before"), F.lit(0))).alias("saved_tokens"))
    )
    root = owners.agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("until").alias("saved_tokens")
    ).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = root.select(zero.alias("depth"), zero.alias("fp"), "n_convs", "conv_id", F.lit(None).cast("long").alias("prev_fp"), "n_leaves", "saved_tokens")
    deep = groups.join(sums, ["depth", "fp"]).select("depth", "fp", "n_convs", "conv_id", "prev_fp", "n_leaves", "saved_tokens")
    every = top.union(deep)
    parents = top.union(deep).select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev_fp"), F.col("conv_id").alias("parent_conv_id"))
    nodes = (
        every.join(children, ["depth", "fp"], "left")
        .join(_ends(ended), ["depth", "fp"], "left")
        .join(parents, ["depth", "prev_fp"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", zero).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
            "fp",
            F.col("prev_fp").alias("parent_fp"),
        )
    )
    return Trie(nodes, rows)


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each distinct sequence of a conversation's first turns, the empty one included.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs (conversations that begin so), n_children, n_leaves (childless nodes
    of the subtree), saved_tokens (over the subtree, each node's n_convs - 1
    times the code points of its last text), ends_sha256 (of the ids of the
    conversations that end there), and fp and parent_fp, which with the depth
    name a node and its parent.

    A null role or text counts as empty, a null turn comes first, turns of one
    number are in the order of their digests, and repeated rows are turns of
    their own.  Rows without a conversation take no part; other columns are
    ignored.  An empty table has no node, not even a root.
    """
    digests = turn_digests(turns, conv, turn, role, text)
    return trie(digests, digests.select("conv_id")).nodes
