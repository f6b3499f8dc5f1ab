"""Encoding with a public byte-level BPE vocabulary by a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a pre-token that is a whole token
with one probe and one comparison. Second tier: any other pre-token is merged byte pair by byte
pair with a heap of candidate pairs over a linked list, in n log n steps even for a pre-token of
many thousand bytes. Every distinct pre-token of a batch is looked up once.

The driver builds the hash once (a vocabulary has a fixed size, about 1 MB) and broadcasts it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.durable import spread

#: Where the vocabulary lies unless the session's ``spark.gridloom.vocabulary`` or the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the vocabulary's texts are cut into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15
CHUNK_BYTES = 4 << 20
MEMO = 1 << 17


class PerfectHash:
    """Minimal perfect hash of byte strings by hash, bucket and displacement.

    A key's first hash names its bucket; the bucket's displacement, mixed into the second hash,
    names a slot of its own for each key. Buckets of one key store their slot itself, as -1 - slot.
    """

    def __init__(self, keys: list[bytes]):
        self.keys, n = keys, len(keys)
        digests = [xxhash.xxh3_128_intdigest(k) for k in keys]
        low = np.array([d & _MASK for d in digests], np.uint64)
        high = np.array([d >> 64 for d in digests], np.uint64)
        m = max(1, n // 4)
        bucket = (low % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=m)
        start = np.r_[0, np.cumsum(size)]
        self.displace = np.zeros(m, np.int64)
        self.slots = np.full(n, -1, np.int64)
        tries = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-size, kind="stable"):
            rows = order[start[b] : start[b + 1]]
            if len(rows) < 2:
                break
            base = 0
            while True:
                at = self._slot(high[rows][None, :], (tries + np.uint64(base))[:, None], n)
                free = (self.slots[at] < 0).all(1)
                if len(rows) > 1:
                    s = np.sort(at, 1)
                    free &= (s[:, 1:] != s[:, :-1]).all(1)
                good = np.flatnonzero(free)
                if len(good):
                    self.displace[b] = base + good[0]
                    self.slots[at[good[0]]] = rows
                    break
                base += len(tries)
        empty = iter(np.flatnonzero(self.slots < 0).tolist())
        for b in np.flatnonzero(size == 1):
            slot = next(empty)
            self.displace[b] = -1 - slot
            self.slots[slot] = order[start[b]]

    @staticmethod
    def _slot(high: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (high ^ (d * np.uint64(_MIX))) * np.uint64(_MIX)
        return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    def ready(self) -> None:
        """Plain lists for fast single lookups."""
        self._d, self._s, self._n, self._m = self.displace.tolist(), self.slots.tolist(), len(self.keys), len(self.displace)

    def get(self, key: bytes) -> int:
        """Number of the key, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self._d[(h & _MASK) % self._m]
        if d < 0:
            i = self._s[-1 - d]
        else:
            i = self._s[((((h >> 64) ^ (d * _MIX & _MASK)) * _MIX & _MASK) >> 32) % self._n]
        return i if self.keys[i] == key else -1


class Encoder:
    """Pre-tokens to ids; ``table`` numbers the tokens by rank."""

    def __init__(self, table: PerfectHash):
        table.ready()
        self.table = table
        self.cut = regex.compile(PRE_TOKEN).findall
        self.byte = [table.get(bytes([b])) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo: dict[str, list[int]] = {}

    def _pair(self, a: int, b: int) -> int:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            got = self.pairs[a, b] = self.table.get(self.table.keys[a] + self.table.keys[b])
        return got

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that isn't a token: always the pair of lowest rank, leftmost first."""
        ids = [self.byte[b] for b in raw]
        n, pair = len(ids), self._pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank, ids[k])) >= 0:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := pair(ids[h], rank)) >= 0:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> list[int]:
        got = self.memo.get(text)
        if got is None:
            raw = text.encode()
            whole = self.table.get(raw)
            got = [whole] if whole >= 0 else self.merge(raw)
            if len(self.memo) > MEMO:
                self.memo.clear()
            if len(text) < 64:
                self.memo[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        return [i for p in self.cut(text) for i in self.piece(p)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text; null and empty texts have none."""
        cut, pieces, per_text = self.cut, [], []
        for t in texts.to_pylist():
            found = cut(t) if t else []
            per_text.append(len(found))
            pieces += found
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(per_text), np.int64)
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        lists = [self.piece(p) for p in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.array([i for x in lists for i in x], np.int32)
        start = np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[code]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(start[code] - (ends - sizes), sizes)
        last = np.cumsum(per_text)
        total = np.r_[0, ends][np.r_[0, last]]
        return flat[at], np.diff(total)


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


_ENCODERS: dict[int, Encoder] = {}
_TABLES: dict[tuple[str, str], object] = {}


def shared_table(spark: SparkSession, path: str | None = None):
    """Broadcast of the vocabulary's perfect hash; built once a session."""
    path = path or spark.conf.get("spark.gridloom.vocabulary", VOCABULARY)
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.sparkContext.broadcast(PerfectHash(read_vocabulary(path)))
    return _TABLES[key]


def encoder_of(table) -> Encoder:
    """The worker's encoder of a broadcast table; kept for later tasks of the same worker."""
    key = id(table.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(table.value)
    return _ENCODERS[key]


def text_chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    which = np.cumsum(size) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(which)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (list of int) of every row, without special tokens.

    Null and empty texts get an empty list; the spelling of a special token is ordinary text. Rows
    come through one by one: repeated rows and null identifiers stay, other columns are ignored.
    """
    table = shared_table(df.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(table)
        for batch in batches:
            for b in text_chunks(batch, 1):
                ids, counts = encoder.encode_batch(b.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "ids"])

    slim = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    out = slim.mapInArrow(encode, T.StructType([slim.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(F.col("id").alias(id_col), "ids")
