"""Token-id store: raw id payloads with a minimal perfect hash index.

A store is a folder of shards.  ``shard-N.ids`` holds raw ids of one width, one
record after another in ascending key order; ``shard-N.mph`` maps a key to its
record: a minimal perfect hash (levels of bit vectors; a key's slot is the rank
of the first bit that it set alone) over the shard's distinct keys, and by slot
a 32-bit fingerprint, the first record's offset and the number of records.
``records`` finds keys' shards by binary search over the shards' key ranges,
then each key in constant time; a key that is not there is refused by its
fingerprint, but for one in 2**32.

Defined results: null and empty texts hold the end id alone; a null key is a key
of its own, before all others; rows that repeat a key are kept, in the order of
their ids; an empty table is a store without shards.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane.llm.bpe import encoder
from solvane.llm.shared import NewFile, filesystem, only, text_slices, tidy, written

#: Bits for each key that is left at a level of the hash.
BITS_PER_KEY = 2.0
LEVELS = 40
#: The null key's place in the key order and in hashes.
NULL_KEY = -(1 << 63)
#: Ids that one task of a keyed read fetches, about, and the most tasks.
READ_TOKENS = 4 << 20
READ_TASKS = 20_000


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift), one to one for each salt."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1, without gaps."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left) and len(levels) < LEVELS:
            size = max(8, int(len(left) * BITS_PER_KEY))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; of other keys any slot, or -1."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.before[-1] + at[hit]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        out.write(struct.pack("<II", len(self.levels), len(self.rest)))
        for bits in self.levels:
            out.write(struct.pack("<Q", len(bits)))
            out.write(np.packbits(bits).tobytes())
        out.write(self.rest.astype("<u8").tobytes())
        return out.getvalue()

    @classmethod
    def load(cls, data: memoryview) -> tuple[PerfectHash, int]:
        """The hash, and the number of bytes that it took."""
        n, rest = struct.unpack_from("<II", data)
        at, levels = 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at + 8), count=size).astype(bool))
            at += 8 + -(-size // 8)
        return cls(levels, np.frombuffer(data, "<u8", rest, at).astype(np.uint64)), at + 8 * rest


def shard_files(keys: np.ndarray, sizes: np.ndarray) -> bytes:
    """The .mph file of records in key order: keys (repeats adjacent) and their numbers of ids."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    own = keys[first].astype(np.int64).view(np.uint64)
    hashed = PerfectHash.build(own)
    slot = hashed.slots(own)
    prints, offset, count = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u8"), np.zeros(len(own), "<u4")
    prints[slot] = mixed(own, 977) >> np.uint64(32)
    begins = np.cumsum(np.r_[0, sizes])
    offset[slot] = first
    count[slot] = np.diff(np.r_[first, len(keys)])
    return b"".join([struct.pack("<QQ", len(own), len(keys)), prints.tobytes(), offset.tobytes(), count.tobytes(), begins.astype("<u8").tobytes(), hashed.dump()])


class Shard:
    """One shard, opened for keyed reads."""

    def __init__(self, folder: str, name: str, width: int):
        self._fs, at = filesystem(folder)
        self._ids, self._width = f"{at}/{name}.ids", width
        with self._fs.open_input_file(f"{at}/{name}.mph") as f:
            data = memoryview(f.read())
        n, records = struct.unpack_from("<QQ", data)
        at = 16
        self._prints = np.frombuffer(data, "<u4", n, at)
        self._first = np.frombuffer(data, "<u8", n, at + 4 * n).astype(np.int64)
        self._count = np.frombuffer(data, "<u4", n, at + 12 * n).astype(np.int64)
        self._begins = np.frombuffer(data, "<u8", records + 1, at + 16 * n).astype(np.int64)
        self._hash, _ = PerfectHash.load(data[at + 16 * n + 8 * (records + 1) :])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into keys, offset in ids, number of ids) of every record of the keys."""
        own = keys.astype(np.int64).view(np.uint64)
        slot = self._hash.slots(own)
        ok = np.flatnonzero(slot >= 0)
        ok = ok[self._prints[slot[ok]] == (mixed(own[ok], 977) >> np.uint64(32)).astype(np.uint32)]
        n = self._count[slot[ok]]
        record = np.repeat(self._first[slot[ok]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(ok, n), self._begins[record], self._begins[record + 1] - self._begins[record]

    def read(self, offsets: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """Ids of records as little-endian unsigned 32-bit; neighbours are read together."""
        w = self._width
        with self._fs.open_input_file(self._ids) as f:
            order = np.argsort(offsets, kind="stable")
            out: list[bytes] = [b""] * len(offsets)
            at = 0
            while at < len(order):
                end, lo = at + 1, int(offsets[order[at]])
                hi = lo + int(sizes[order[at]])
                while end < len(order) and int(offsets[order[end]]) <= hi and hi - lo < 1 << 21:
                    hi = max(hi, int(offsets[order[end]] + sizes[order[end]]))
                    end += 1
                ids = np.frombuffer(f.read_at((hi - lo) * w, lo * w), f"<u{w}").astype("<u4")
                for k in order[at:end]:
                    a = int(offsets[k]) - lo
                    out[k] = ids[a : a + int(sizes[k])].tobytes()
                at = end
        return iter(out)


def build_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """Writes docs(doc_id, text) as a store, in ascending doc_id order over all shards; returns its catalogue.

    The catalogue (shard, name, n_docs, n_tokens, low, high) is written too.
    width 2 is enough for vocabularies of up to 65,536 ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        name, file, keys, sizes = f"shard-{number:06d}", None, [], []
        for b in text_slices(batches):
            coded = enc.encode(b.column("text").to_pylist())
            sizes.append(np.fromiter((len(x) // 4 + 1 for x in coded), np.int64, len(coded)))
            keys.append(b.column("key").to_numpy())
            ids = np.frombuffer(end.join(coded) + end, "<u4")
            if int(ids.max()) >= 1 << (8 * width):
                raise ValueError(f"an id of {ids.max()} does not fit in {width} bytes")
            file = file or NewFile(f"{folder}/{name}.ids")
            file.write(ids.astype(f"<u{width}").tobytes())
        rows = []
        if file:
            file.finish()
            keys, sizes = np.concatenate(keys), np.concatenate(sizes)
            index = NewFile(f"{folder}/{name}.mph")
            index.write(shard_files(keys, sizes))
            index.finish()
            rows = [{"shard": number, "name": name, "n_docs": len(keys), "n_tokens": int(sizes.sum()), "low": int(keys[0]), "high": int(keys[-1])}]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    rows = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), "text", F.xxhash64("text").alias("mark"))
    ordered = rows.repartitionByRange("key", "mark").sortWithinPartitions("key", "mark")
    return written(ordered.select("key", "text").mapInArrow(tidy(write), "shard long, name string, n_docs long, n_tokens long, low long, high long"), "store-catalogue")


def records(spark: SparkSession, folder: str, catalogue: DataFrame, keys: DataFrame, width: int = 2, payload: bool = True) -> DataFrame:
    """All records of the keys(doc_id): (doc_id, start, n_tokens, ids_crc32, ids).

    start counts the ids of all records before it in the store.  ids are
    little-endian unsigned 32-bit, null if payload is false.  The catalogue has
    a row for each shard and is the only thing that the driver and every task
    hold.
    """
    rows = sorted(catalogue.collect(), key=lambda r: r["shard"])
    names = [r["name"] for r in rows]
    low, high = np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64)
    base = np.cumsum([0, *(r["n_tokens"] for r in rows)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("key").to_numpy()
            a, z = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")
            n = np.maximum(z - a, 0)
            shard = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n), pa.int64()), pa.array(shard.astype(np.int64), pa.int64())], ["key", "shard"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = -1, None
        for b in batches:
            keys, shards = b.column("key").to_numpy(), b.column("shard").to_numpy()
            for k in range(0, len(keys), 2000):
                for s in np.unique(shards[k : k + 2000]):
                    if s != at:
                        at, shard = s, Shard(folder, names[s], width)
                    own = keys[k : k + 2000][shards[k : k + 2000] == s]
                    which, offset, size = shard.find(own)
                    found = own[which]
                    for c in range(0, len(found), 500):
                        ids = list(shard.read(offset[c : c + 500], size[c : c + 500]))
                        cut = found[c : c + 500]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(cut, pa.int64(), mask=cut == NULL_KEY),
                                pa.array(base[s] + offset[c : c + 500], pa.int64()),
                                pa.array(size[c : c + 500], pa.int64()),
                                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                                pa.array(ids if payload else [None] * len(ids), pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    asked = only(keys, "doc_id").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    tasks = int(min(READ_TASKS, max(1, base[-1] // READ_TOKENS)))
    placed = asked.mapInArrow(tidy(place), "key long, shard long").repartitionByRange(tasks, "shard", "key").sortWithinPartitions("shard", "key")
    return placed.mapInArrow(tidy(fetch), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
