"""Line dedup with two Bloom filters.

A first scan puts the hash of every long enough line into a filter of lines seen
once; where filters of two tasks meet, what both hold goes into a filter of
lines seen twice.  A second scan shuffles only lines that the second filter
holds, as digests, for the exact count of documents and the choice of the one
that keeps the line.  The filters have a fixed greatest size: beyond it more
lines are suspected and shuffled, and results stay exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import wordhash as wh
from civicspark.llm.common import give_back, grouped_rows, input_bytes, keep, with_schema

#: Stripped at both ends of a line.
MARKS = b" \t\n\x0b\x0c\r"
#: Bits of each filter: about 16 for each expected line, within these bounds.
LEAST_BITS, MOST_BITS = 20, 28
#: Stored bytes of input for each line that is expected.
LINE_BYTES = 200
_SLICES = 64


def line_keys(lines: list[bytes], least: int) -> list[bytes | None]:
    """The key of every line, or None for a line whose key is shorter than ``least`` code points."""
    out = []
    for line in lines:
        key = line.strip(MARKS)
        long = len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)
        out.append(key.lower() if long else None)  # of bytes: A-Z only
    return out


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _places(h: int, bits: int) -> tuple[int, int]:
    return h & ((1 << bits) - 1), (h >> 32) & ((1 << bits) - 1)


def _filter_bits(docs: DataFrame) -> int:
    expected = max(1, input_bytes(docs) // LINE_BYTES)
    return max(LEAST_BITS, min(MOST_BITS, int(np.ceil(np.log2(16 * expected)))))


def twice_seen(docs: DataFrame, text: str, least: int, bits: int) -> np.ndarray:
    """The filter of lines that at least two documents may hold, as packed bits."""
    size = (1 << bits) // 8

    def fill(batches):
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for batch in batches:
            for value in _texts(batch.column(0)):
                for key in {k for k in line_keys(_lines(value), least) if k is not None}:
                    a, b = _places(xxhash.xxh3_64_intdigest(key), bits)
                    if once[a] and once[b]:
                        twice[a] = twice[b] = True
                    else:
                        once[a] = once[b] = True
        press = zstandard.ZstdCompressor(level=1)
        halves = [np.packbits(x).reshape(_SLICES, -1) for x in (once, twice)]
        yield {"slice": range(_SLICES), "once": [press.compress(x.tobytes()) for x in halves[0]], "twice": [press.compress(x.tobytes()) for x in halves[1]]}

    def merge(batches):
        unpress = zstandard.ZstdDecompressor()
        for (which,), held in grouped_rows(batches, ["slice"]):
            once, twice = np.zeros(size // _SLICES, np.uint8), np.zeros(size // _SLICES, np.uint8)
            for batch in held:
                for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    new = np.frombuffer(unpress.decompress(x), np.uint8)
                    twice |= np.frombuffer(unpress.decompress(y), np.uint8) | (once & new)
                    once |= new
            yield {"slice": [which], "twice": [zstandard.ZstdCompressor(level=1).compress(twice.tobytes())]}

    both = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    one = pa.schema([("slice", pa.int32()), ("twice", pa.binary())])
    parts = (
        docs.select(F.col(text).cast("string").alias(text)).mapInArrow(with_schema(fill, both), "slice int, once binary, twice binary")
        .repartition(_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(with_schema(merge, one), "slice int, twice binary")
        .collect()
    )  # at most 2 ** MOST_BITS bits
    out = np.zeros(size, np.uint8)
    for row in parts:
        step = size // _SLICES
        out[row.slice * step : (row.slice + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.twice), np.uint8)
    return out


def suspected_lines(docs: DataFrame, text: str, id_col: str, least: int, twice: np.ndarray, bits: int) -> DataFrame:
    """``digest`` and ``id`` of each line of each document that the filter holds."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def pick(batches):
        held = shared.value
        for batch in batches:
            ids, digests = [], []
            for number, value in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                for key in {k for k in line_keys(_lines(value), least) if k is not None}:
                    if all(held[x >> 3] >> (7 - (x & 7)) & 1 for x in _places(xxhash.xxh3_64_intdigest(key), bits)):
                        ids.append(number)
                        digests.append(_digest(key))
            yield {"digest": digests, "id": ids}

    schema = pa.schema([("digest", pa.binary()), ("id", pa.int64())])
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    return base.mapInArrow(with_schema(pick, schema), "digest binary, id long")


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=20).digest()


def _dropped(text: bytes | None, least: int, drop) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and the rest joined."""
    lines = _lines(text)
    rest = [x for x, k in zip(lines, line_keys(lines, least)) if k is None or not drop(_digest(k))]
    return len(lines), len(lines) - len(rest), b"\n".join(rest)


def line_dedup(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_chars: int = 40, least_docs: int = 5,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Documents without lines that many documents share, but for one keeper.

    Returns every row and column of ``docs`` with ``text`` cut, ``n_lines`` (before)
    and ``n_dropped``; columns of these two names are replaced.  A line's key is
    the line stripped of white space at its ends with A-Z folded.  Keys of at
    least ``least_chars`` code points in at least ``least_docs`` distinct ids lose
    all their lines except in the largest id that holds them.  A null or empty
    text is one empty line; a null id neither counts nor loses lines; rows that
    repeat an id count once and are cut alike.

    The dropped keys are broadcast if there are at most ``broadcast_rows``; else
    they are joined to the documents they leave.
    """
    bits = _filter_bits(docs)
    twice = twice_seen(docs, text, least_chars, bits)
    suspects = suspected_lines(docs, text, id_col, least_chars, twice, bits)
    counted = suspects.groupBy("digest").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("keeper"))
    shared = keep(counted.where(F.col("docs") >= least_docs).select("digest", "keeper"), "lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*names).withColumn(text, F.col(text).cast("string"))
    few = shared.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        held = docs.sparkSession.sparkContext.broadcast({bytes(r.digest): r.keeper for r in shared.toLocalIterator()})
    else:
        lost = suspects.join(shared, "digest").where("id <> keeper").groupBy("id").agg(F.collect_set("digest").alias("__lost"))
        rows = rows.join(lost.withColumnRenamed("id", "__id"), rows[id_col] == F.col("__id"), "left").drop("__id")

    def cut(batches):
        for batch in (part for whole in batches for part in wh.chunks(whole, text)):
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            texts = _texts(batch.column(batch.schema.get_field_index(text)))
            lost = [None] * len(ids) if few else batch.column(batch.schema.get_field_index("__lost")).to_pylist()
            found = []
            for number, value, gone in zip(ids, texts, lost):
                if number is None:
                    found.append(_dropped(value, least_chars, lambda d: False))
                elif few:
                    found.append(_dropped(value, least_chars, lambda d: held.value.get(d, number) != number))
                else:
                    found.append(_dropped(value, least_chars, set(gone or ()).__contains__))
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            columns[text] = pa.array([None if t is None else x[2] for x, t in zip(found, texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns | {"n_lines": pa.array([x[0] for x in found], pa.int64()), "n_dropped": pa.array([x[1] for x in found], pa.int64())})
        give_back()

    kinds = [f for f in rows.schema.fields if f.name in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return rows.mapInArrow(cut, f"{schema}, n_lines long, n_dropped long")
