"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern.  Tier one: a minimal perfect hash over the
vocabulary's byte strings gives the id of a pre-token that is itself a vocabulary entry (the slot's bytes are compared, so
that strangers are turned away).  Tier two, for the rest: merges are taken from a heap of (rank, position) over a linked
list of byte parts, O(n log n) for a pre-token of n bytes.  A bounded memo keeps what the
two tiers gave for frequent pre-tokens.

The vocabulary is one file of bounded size (50,256 entries here); its hash tables are what is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .workspace import table

#: Pre-tokens remembered, at most twice this number: of the newer and the older half, the older one is forgotten when the newer is full.
MEMO_ENTRIES = 400_000
CHUNK_TOKENS = 1 << 17


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank from a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0..n-1")
    return [t for _, t in pairs]


class MinimalPerfectHash:
    """Hash-and-displace over byte strings: n keys, n slots, no collisions.

    Keys fall into buckets by one hash; each bucket, largest first, gets the smallest displacement that sends
    its keys to free slots.  Buckets of one key point at a free slot directly (a negative displacement).
    Displacements are tried up to a bound; where a bucket finds none, all keys are hashed anew by the next seed.
    Keys must differ; a repeated one is a ValueError.
    """

    def __init__(self, keys: list[bytes], load: float = 2.0) -> None:
        if len(set(keys)) < len(keys):
            raise ValueError("a key is repeated")
        self.keys = keys
        n = self.n = max(1, len(keys))
        self.m = max(1, int(n / load))
        for self.seed in range(256):  # a seed fails for few and small key sets; that all of these fail has no odds to speak of
            if self._place():
                return
        raise ValueError("no seed separates the keys")

    def _place(self) -> bool:
        """Whether every bucket finds a displacement under this seed; sets ``shift`` (by bucket) and ``at`` (key by slot)."""
        n, most = self.n, max(1024, 8 * self.n)
        buckets: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_128_intdigest(k, self.seed) for k in self.keys]
        for i, h in enumerate(hashes):
            buckets.setdefault((h >> 64) % self.m, []).append(i)
        self.shift = np.zeros(self.m, np.int64)
        self.at = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        order = sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0]))
        single = next((k for k, (_, own) in enumerate(order) if len(own) == 1), len(order))
        for b, own in order[:single]:
            for d in range(most):
                slots = [self._slot(hashes[i], d) for i in own]
                if len(set(slots)) == len(slots) and free[slots].all():
                    break
            else:
                return False
            self.shift[b] = d
            self.at[slots] = own
            free[slots] = False
        for (b, (i,)), slot in zip(order[single:], np.flatnonzero(free).tolist(), strict=False):
            self.shift[b] = -slot - 1
            self.at[slot] = i
        return True

    def _slot(self, h: int, d: int) -> int:
        return ((h & 0xFFFFFFFF) + d * ((h >> 32 & 0xFFFFFFFF) | 1) + d * d) % self.n

    def find(self, key: bytes) -> int:
        """The key's index, or -1 if it is none of the keys."""
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        d = int(self.shift[(h >> 64) % self.m])
        i = int(self.at[-d - 1 if d < 0 else self._slot(h, d)])
        return i if i >= 0 and self.keys[i] == key else -1


class Encoder(dict):
    """Maps a pre-token to its ids packed as little-endian unsigned 32-bit integers; remembers a bounded number."""

    def __init__(self, mph: MinimalPerfectHash, pattern: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.mph, self.vocabulary = mph, mph.keys
        self.ranks = {k: i for i, k in enumerate(mph.keys)}.get  # of pairs of parts
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            raw = piece.encode()
            i = self.mph.find(raw)
            packed = i.to_bytes(4, "little") if i >= 0 else array("I", self.merge(raw)).tobytes()
            if len(raw) > 64:
                return packed
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a byte string that is not in the vocabulary: lowest rank first, leftmost first among equals."""
        n, rank = len(raw), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: it was merged away
        before = list(range(-1, n))
        s = n.bit_length()
        s2, low = 2 * s, (1 << s) - 1
        # An item is rank, position and end in one integer: the lowest rank first, among equals the leftmost.
        heap = [r << s2 | i << s | i + 2 for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(heap)
        end.append(0)
        while heap:
            x = heappop(heap)
            i, to = x >> s & low, x & low
            j = end[i]
            if not j or end[j] != to:  # a part of this pair has changed since
                continue
            end[i], end[j], before[to] = to, 0, i
            if to < n and (r := rank(raw[i : (k := end[to])])) is not None:
                heappush(heap, r << s2 | i << s | k)
            if i and (r := rank(raw[(k := before[i]) : to])) is not None:
                heappush(heap, r << s2 | k << s | to)
        out, i = [], 0
        while i < n:
            out.append(rank(raw[i : end[i]]))
            i = end[i]
        if None in out:
            raise ValueError("the vocabulary lacks a single byte")
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, in chunks of bounded size."""
        if len(text) < CHUNK_TOKENS:
            yield b"".join(map(self.__getitem__, self.pattern.findall(text)))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while chunk := list(islice(found, CHUNK_TOKENS)):
            yield b"".join(map(self.__getitem__, chunk))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the multilingual byte-level vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _encoder(spark: SparkSession, path: str | None, pattern: str | None):
    """A function for executors that returns the encoder; a worker builds the memo once per vocabulary."""
    own, own_pattern = default_vocabulary() if path is None else (path, pattern)
    mph = MinimalPerfectHash(read_ranks(own))
    sent = spark.sparkContext.broadcast((mph.keys, mph.seed, mph.m, mph.shift, mph.at))
    name = hashlib.sha1(b"\0".join(mph.keys)).hexdigest() + (pattern := pattern or own_pattern)

    def get() -> Encoder:
        if name not in _ENCODERS:
            keys, seed, m, shift, at = sent.value
            hashed = MinimalPerfectHash.__new__(MinimalPerfectHash)
            hashed.keys, hashed.n, hashed.seed, hashed.m, hashed.shift, hashed.at = keys, max(1, len(keys)), seed, m, shift.tolist(), at.tolist()
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(hashed, pattern)
        return _ENCODERS[name]

    return get


def encode(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<long>) per row of ``docs``; a null text has no ids.

    Every match of ``pattern`` is encoded apart, without special tokens.  Rows are independent: repeated rows, null
    ids and other columns change nothing; an empty table gives an empty result.
    """
    get = _encoder(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                packed = [b"".join(enc.encode(t or "")) for t in part.column(1).to_pylist()]
                sizes = np.array([len(p) // 4 for p in packed], np.int64)
                values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<long>")


def decode(ids: DataFrame, *, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) per row of ``ids``; null counts as no ids; an id outside the vocabulary is an error."""
    get = _encoder(ids.sparkSession, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = [enc.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    kind = ids.schema[id_col].dataType.simpleString()
    return ids.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode fused, chunk by chunk, when only digests are wanted."""
    get = _encoder(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for b in batches:
            n, ids, back = [], [], []
            for value in b.column(1):
                size, h, g = 0, hashlib.sha256(), hashlib.sha256()
                for packed in enc.encode(value.as_py() or ""):
                    size += len(packed) // 4
                    h.update(packed)
                    g.update(enc.decode(packed))
                n.append(size)
                ids.append(h.hexdigest())
                back.append(g.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
