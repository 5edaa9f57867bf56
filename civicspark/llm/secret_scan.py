"""Secret scans: patterns of known secrets, and a token-efficiency test for random strings.

A byte-pair vocabulary packs prose and names into long tokens, but falls back on
tokens of one or two characters where it meets random strings.  So a long run of
key-like characters with few characters for each token is reported, unless it
is a digest, an identifier or a number.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tiktoken rank file, read by the driver and broadcast.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes that a rank file may have; it is broadcast.
VOCABULARY_BYTES = 64_000_000
#: How the vocabulary's encoder cuts texts before it merges bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of spans, in the order that breaks ties of their starts.
KINDS = ("assign", "access", "hex", "random")
#: Characters of a run that are encoded at once, since merging is slower than linear.
SLICE = 4_096

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # a match of [0-9a-f]+ is a whole run, so no shorter one is lost
#: Digests by their number of hex digits: MD5, SHA-1, Tiger, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGEST = re.compile("(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_SIZES = frozenset((32, 40, 48, 56, 64, 96, 128))
_NAMED_DIGEST = re.compile("(?:md5|sha1|sha224|sha256|sha384|sha512)[-=_/+].*", re.I | re.S)
_UUID = re.compile("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_NUMBER = re.compile("[0-9+/_=-]+")
#: A word of a name: small, capital, or camel case, perhaps with a number behind.
_NAME = re.compile("(?:[a-z]+|[A-Z]+|(?:[A-Z]{0,3}[a-z]{2,})+[A-Z]{0,3})?[0-9]{0,4}")
_BREAK = re.compile("[+/_=-]+")

_SPANS = "array<struct<kind: string, start: int, end: int>>"


def is_known(run: str) -> bool:
    """Whether a run is a digest, an identifier (UUID, names joined by marks, camel case) or a number."""
    if _DIGEST.fullmatch(run) and len(run) in _DIGEST_SIZES:
        return True
    if _NUMBER.fullmatch(run) or _UUID.fullmatch(run) or _NAMED_DIGEST.fullmatch(run):
        return True
    return all(_NAME.fullmatch(part) for part in _BREAK.split(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches of the patterns, in the order of starts and kinds."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


class TokenTest:
    """Finds runs of key-like characters that a vocabulary encodes badly."""

    def __init__(self, ranks: bytes, least_chars: int, most_chars_per_token: float) -> None:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoder = tiktoken.Encoding("scan", pat_str=PIECES, mergeable_ranks=merges, special_tokens={})
        self.run = re.compile("[A-Za-z0-9+/_=-]{%d,}" % least_chars)
        self.most = most_chars_per_token

    def ratio(self, run: str) -> float:
        """Characters for each token."""
        return len(run) / sum(len(self.encoder.encode_ordinary(run[k : k + SLICE])) for k in range(0, len(run), SLICE))

    def spans(self, text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the random runs of a text that overlap no known span."""
        found, starts, reach = [], [a for a, _, _ in known], []
        for _, b, _ in known:
            reach.append(max(b, reach[-1] if reach else 0))
        for m in self.run.finditer(text):
            before = bisect_right(starts, m.end() - 1)
            if before and reach[before - 1] > m.start():
                continue
            run = m.group()
            if not is_known(run) and self.ratio(run) <= self.most:
                found.append((m.start(), m.end(), KINDS[3]))
        return found


@lru_cache(maxsize=4)
def _token_test(shared: Broadcast, least_chars: int, most_chars_per_token: float) -> TokenTest:
    """One encoder for each worker process."""
    return TokenTest(shared.value, least_chars, most_chars_per_token)


def _read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        ranks = file.read(VOCABULARY_BYTES + 1)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return ranks


def secret_scan(
    docs: DataFrame,
    text: str = "text",
    spans: str = "spans",
    vocabulary: str = VOCABULARY,
    least_chars: int = 20,
    most_chars_per_token: float = 2.0,
) -> DataFrame:
    """``docs`` with a column ``spans`` of the secrets in the whole ``text``: kind, start and end in code points.

    The kinds are ``assign`` (a name such as ``token``, a mark and a value of six
    characters or more), ``access`` (access key ids), ``hex`` (24 or more hex
    digits) and ``random``: runs of ``least_chars`` or more of ``A-Za-z0-9+/_=-``
    with at most ``most_chars_per_token`` characters for each token of the
    vocabulary, neither digest, identifier nor number, that overlap no span of
    the other kinds.  Runs beyond 4,096 characters are encoded in slices, which
    may add a token at each cut.

    A null or empty text has an empty list.  Every row keeps its other columns,
    repeated rows are scanned each, and a column named ``spans`` is replaced.
    An empty table stays empty.  Spans are in the order of their starts; at one
    start, in the order of the kinds above.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read_ranks(vocabulary))

    @F.arrow_udf(_SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        test = _token_test(shared, least_chars, most_chars_per_token)
        starts, ends, kinds, offsets = [], [], [], [0]
        for value in texts:
            whole = value.as_py() or ""
            base = base_spans(whole)
            for a, b, kind in sorted(base + test.spans(whole, base), key=lambda x: (x[0], KINDS.index(x[2]))):
                starts.append(a)
                ends.append(b)
                kinds.append(kind)
            offsets.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return docs.withColumn(spans, scan(F.col(text).cast("string")))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
