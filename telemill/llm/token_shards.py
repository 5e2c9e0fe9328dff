"""Token ids as one succinct file per shard: a wavelet matrix that answers from compressed planes.

Documents are sorted by id over range partitions; a task cuts its stream into shards of about ``SHARD_TOKENS`` ids, so
a worker holds one shard at a time.  A shard file is self-contained: the ids and lengths of its documents, and one bit
plane per bit of the ids, most significant first.  In each plane the zeros of the sequence above go before its ones.
Planes are compressed in blocks with a directory of ranks, so access, counting and occurrence lookup open only the
blocks they touch.  Files are rows of a Parquet table (one per shard): Spark's commit makes them appear whole or not at
all, also after lost executors.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.bpe import UnitEncoder, byte_characters, encoded_batches

SHARD_TOKENS = 1 << 20
BLOCK_BITS = 1 << 15
#: Values of a plane that are moved together: their places stay in the processor's cache.
MOVED = 1 << 16
MAGIC = b"WVM1"


def _pack(plane: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """A plane's compressed blocks, their sizes and the number of ones before each."""
    squeeze = zstandard.ZstdCompressor(level=1)
    packed = np.packbits(plane).tobytes()
    step = BLOCK_BITS // 8
    blocks = [squeeze.compress(packed[i : i + step]) for i in range(0, len(packed), step)]
    ones = np.bitwise_count(np.frombuffer(packed, np.uint8))
    per = np.add.reduceat(ones, np.arange(0, len(ones), step), dtype=np.int64) if len(ones) else np.zeros(0, np.int64)
    return b"".join(blocks), [len(b) for b in blocks], (np.cumsum(per) - per).tolist()


def _parted(values: np.ndarray, ones: np.ndarray, zeros: int) -> np.ndarray:
    """The values at the plane's zeros, then those at its ones, by places: a mask as index takes twice the time."""
    out = np.empty_like(values)
    zero, one = 0, zeros
    for at in range(0, len(values), MOVED):
        own, mask = values[at : at + MOVED], ones[at : at + MOVED]
        low, high = np.flatnonzero(~mask), np.flatnonzero(mask)
        own.take(low, out=out[zero : zero + len(low)], mode="clip")  # other modes copy
        own.take(high, out=out[one : one + len(high)], mode="clip")
        zero, one = zero + len(low), one + len(high)
    return out


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    current = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, directory = [], []
    for bit in range(bits - 1, -1, -1):
        ones = current & current.dtype.type(1 << bit) != 0
        raw, sizes, ranks = _pack(ones)
        planes.append(raw)
        zeros = len(ones) - int(np.count_nonzero(ones))
        directory.append(np.array([zeros, *sizes, *ranks], "<u4").tobytes())
        current = _parted(current, ones, zeros)
    nulls = np.packbits([d is None for d in doc_ids]).tobytes()
    names = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + nulls)
    head = struct.pack("<4sIQQQ", MAGIC, bits, len(ids), len(doc_ids), len(names))
    return head + names + b"".join(directory) + b"".join(planes)


class Shard:
    """Reads one shard file.  Blocks are opened on demand."""

    HEAD = struct.calcsize("<4sIQQQ")

    def __init__(self, raw: bytes):
        magic, self.bits, self.n, docs, names = struct.unpack_from("<4sIQQQ", raw)
        assert magic == MAGIC, "not a shard file"
        own = zlib.decompress(raw[self.HEAD : self.HEAD + names])
        ids = np.frombuffer(own, "<i8", docs).tolist()
        self.lengths = np.frombuffer(own, "<u8", docs, 8 * docs).astype(np.int64)
        nulls = np.unpackbits(np.frombuffer(own, np.uint8, -1, 16 * docs))[:docs]
        self.doc_ids = [None if gone else d for d, gone in zip(ids, nulls)]
        blocks = -(-self.n // BLOCK_BITS)
        at = self.HEAD + names
        table = np.frombuffer(raw, "<u4", self.bits * (1 + 2 * blocks), at).reshape(self.bits, 1 + 2 * blocks).astype(np.int64)
        self.zeros, sizes, self.ranks = table[:, 0], table[:, 1 : 1 + blocks], table[:, 1 + blocks :]
        ends = np.cumsum(sizes) + at + 4 * self.bits * (1 + 2 * blocks)
        self.begins = (ends - sizes.ravel()).reshape(sizes.shape)
        self.ends = ends.reshape(sizes.shape)
        self.raw, self.open = raw, zstandard.ZstdDecompressor()
        self.block = lru_cache(maxsize=64)(self._block)

    def _block(self, plane: int, k: int) -> np.ndarray:
        packed = self.open.decompress(self.raw[self.begins[plane, k] : self.ends[plane, k]])
        return np.unpackbits(np.frombuffer(packed, np.uint8))[: self.n - k * BLOCK_BITS]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        return int(self.ranks[plane, i // BLOCK_BITS] + np.count_nonzero(self.block(plane, i // BLOCK_BITS)[: i % BLOCK_BITS]))

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) given bit of a plane."""
        before = self.ranks[plane] if bit else np.arange(len(self.ranks[plane])) * BLOCK_BITS - self.ranks[plane]
        at = int(np.searchsorted(before, k, "right")) - 1
        return at * BLOCK_BITS + int(np.flatnonzero(self.block(plane, at) == bit)[k - before[at]])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for plane in range(self.bits):
            ones = self._ones(plane, i)
            bit = int(self.block(plane, i // BLOCK_BITS)[i % BLOCK_BITS])
            value = value << 1 | bit
            i = int(self.zeros[plane]) + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        begin = 0
        for plane in range(self.bits):
            low, high = self._ones(plane, begin), self._ones(plane, end)
            one = token >> (self.bits - 1 - plane) & 1
            begin, end = (int(self.zeros[plane]) + low, int(self.zeros[plane]) + high) if one else (begin - low, end - high)
        return begin, end

    def count(self, token: int, end: int | None = None) -> int:
        """How often an id occurs before position ``end``, by default in the whole shard."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0, of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, one, at - int(self.zeros[plane]) if one else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, in order: the planes undone from the last to the first."""
        current = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        blocks = self.begins.shape[1]
        for plane in range(self.bits - 1, -1, -1):
            packed = b"".join(self.open.decompress(self.raw[self.begins[plane, k] : self.ends[plane, k]]) for k in range(blocks))
            ones = np.unpackbits(np.frombuffer(packed, np.uint8))[: self.n].view(bool)
            above = np.empty_like(current)
            zeros = int(self.zeros[plane])
            above[np.flatnonzero(~ones)] = current[:zeros]
            above[np.flatnonzero(ones)] = current[zeros:] | current.dtype.type(1 << (self.bits - 1 - plane))
            current = above
        return current


@lru_cache(maxsize=2)
def file_encoder(path: str, added_tokens: bool = False) -> UnitEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    own = {c: b for b, c in enumerate(byte_characters())}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    # Without a pattern of its own, the byte-level splitter takes a run of letters and one space before it as a piece.
    whole = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    whole = whole.get("type") == "ByteLevel" and whole.get("use_regex") and not whole.get("add_prefix_space")
    return UnitEncoder(tokenizer, np.array([sum(1 for c in name if c in own) for name in names]), added_tokens, bool(whole) and not tokenizer.normalizer)


def write_shards(
    docs: DataFrame, out: str, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, added_tokens: bool = False
) -> None:
    """Write ``docs`` in ascending doc_id order as shard files below ``out``: _part, _shard, _start, n_tokens, n_docs, file.

    ``_start`` counts the ids before the shard in its part.  Each document ends with ``end_id``.  A null text has only
    that; null ids come first; rows that repeat an id are ordered by text.  With ``added_tokens`` the text of a token added
    to the tokenizer, like ``<|endoftext|>``, becomes that token, as by the library's default; else it is ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, end = TaskContext.get().partitionId(), file_encoder(path, added_tokens), np.array([end_id], "<u4")
        held, names, lengths, shard, start, n = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            file = build(np.concatenate(held), names, lengths)
            return pa.RecordBatch.from_pydict(
                {"_part": [part], "_shard": [shard], "_start": [start], "n_tokens": [n], "n_docs": [len(names)], "file": [file]},
                pa.schema([(c, pa.int64()) for c in ("_part", "_shard", "_start", "n_tokens", "n_docs")] + [("file", pa.binary())]),
            )

        for batch in batches:
            for rows, encoded in encoded_batches(batch, encoder):
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoded):
                    held += (ids, end)
                    names.append(doc_id)
                    lengths.append(len(ids) + 1)
                    n += lengths[-1]
                    if n >= shard_tokens:
                        yield flush()
                        held, names, lengths, shard, start, n = [], [], [], shard + 1, start + n, 0
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    shards = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(
        run, "_part long, _shard long, _start long, n_tokens long, n_docs long, file binary"
    )
    shards.write.parquet(out)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, file in zip(*(batch.column(c).to_pylist() for c in ("_part", "_start", "file"))):
                shard = Shard(file)
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                sums = [zlib.crc32(ids[b:e].tobytes()) for b, e in zip(begins, ends)]
                columns = [
                    pa.array(np.full(len(ends), part), pa.int64()), pa.array(shard.doc_ids, pa.int64()),
                    pa.array(begins + start, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_part", "doc_id", "_at", "n_tokens", "ids_crc32"])

    read = shards.select("_part", "_start", "file").mapInArrow(
        run, "_part long, doc_id long, _at long, n_tokens long, ids_crc32 long"
    )
    # One row per part, as many as there were write tasks.
    parts = shards.groupBy("_part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = read.join(bases, F.col("_part") == F.col("_p"))
    return joined.select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
