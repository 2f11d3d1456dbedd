"""Best-fit packing of documents into token sequences by exact-complement hashing.

Only the histogram of piece lengths matters for which lengths share a sequence,
so the plan is made on the driver from at most ``size`` counts, whatever the
size of the corpus.  Lengths are taken in descending order; the gap that is left
is filled exactly by one, two or three lengths, looked up in indexes from a sum
to the single, pairs and triples that make it up; an entry leaves its index when
a length of it runs out.  Where no such sum is there,
the largest length that fits goes in (best fit) and the smaller gap is tried
again.  A combination is used as often as its counts allow.  The plan is a table
of rank intervals: the r-th piece of a length belongs in this sequence, there.
Pieces get their ranks from counts by task and length, without a global sort.

Defined results: a null or empty text is a piece that holds the end id alone;
repeated rows and repeated or null doc_ids are packed as documents of their own;
an empty table gives no pieces.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvane.llm.bpe import encoder
from solvane.llm.shared import only, text_slices, tidy, written

PIECES = "doc_id long, piece int, start long, length long, part int, rank_in_part long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """docs(doc_id, text) -> pieces of at most size ids, written: PIECES.

    ids are little-endian unsigned 32-bit.  A document with its end id is cut
    only if it is longer than size; its first piece takes the remainder.
    rank_in_part numbers the pieces of one length in one task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, end, ranks = TaskContext.get().partitionId(), encoder(tokenizer), struct.pack("<I", end_id), Counter()
        for b in text_slices(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                x += end
                n = len(x) // 4
                first = n if n <= size else n % size or size
                at = 0
                for k, length in enumerate([first, *[size] * ((n - first) // size)]):
                    for c, v in zip(cols, (doc, k, at, length, ranks[length], x[4 * at : 4 * (at + length)]), strict=True):
                        c.append(v)
                    ranks[length] += 1
                    at += length
            doc, piece, start, length, rank, ids = cols
            for a in range(0, len(doc), 4000):
                z = slice(a, a + 4000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[z], pa.int64()), pa.array(piece[z], pa.int32()), pa.array(start[z], pa.int64()), pa.array(length[z], pa.int64()), pa.array([part] * len(doc[z]), pa.int32()), pa.array(rank[z], pa.int64()), pa.array(ids[z], pa.binary())],
                    ["doc_id", "piece", "start", "length", "part", "rank_in_part", "ids"],
                )

    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(slim.mapInArrow(tidy(cut), PIECES), "pieces", compression="zstd")


class _Sums:
    """Indexes from a sum to the lengths that make it up, under the counts that are left.

    A sum is indexed when it is first asked for: its pairs by their larger
    length, its triples by their largest length, which leaves the sum of a pair.
    Counts only fall, so entries are dropped and never come back.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self._pairs: dict[int, np.ndarray] = {}
        self._triples: dict[int, np.ndarray] = {}

    def pairs(self, total: int) -> np.ndarray:
        """The larger lengths, in descending order, of all pairs with this sum of which both lengths are left."""
        larger = self._pairs.get(total)
        if larger is None:
            larger = np.arange(total - 1, (total - 1) // 2, -1)
        larger = larger[(self.left[larger] > 0) & (self.left[total - larger] > 0)]
        self._pairs[total] = larger
        return larger

    def triples(self, total: int) -> np.ndarray:
        """The largest lengths, in descending order, of all triples with this sum whose pair is indexed."""
        largest = self._triples.get(total)
        if largest is None:
            largest = np.arange(total - 2, (total - 1) // 3, -1)
            largest = largest[self.left[largest] > 0]
            largest = largest[[len(self.pairs(total - int(a))) > 0 for a in largest]] if len(largest) else largest
        largest = largest[self.left[largest] > 0]
        self._triples[total] = largest
        return largest

    def fill(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """Lengths that add up to gap, the largest first choice; used counts what the sequence holds already."""
        free = self.left[: gap + 1].copy()
        for length, n in used.items():
            if length <= gap:
                free[length] -= n
        if free[gap] > 0:
            return (gap,)
        pair = self._pair(free, gap, gap)
        if pair:
            return pair
        gone = []
        for a in self.triples(gap).tolist():
            if free[a] <= 0:
                continue
            free[a] -= 1
            pair = self._pair(free, gap - a, a)
            free[a] += 1
            if pair:
                break
            if not len(self._pairs[gap - a]):
                gone.append(a)
        else:
            a = 0
        if gone:
            self._triples[gap] = self._triples[gap][~np.isin(self._triples[gap], gone)]
        return (a, *pair) if a else None

    def _pair(self, free: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
        """The pair with the largest length, up to ``most``, that free counts allow."""
        x = self.pairs(total)
        y = total - x
        ok = (x <= most) & (free[x] > 0) & (free[y] > 0) & ((x != y) | (free[x] > 1))
        k = int(ok.argmax()) if len(ok) else 0
        return (int(x[k]), int(y[k])) if len(ok) and ok[k] else None


def plan(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """counts[length] -> [(lengths with how often each, number of sequences)]: every piece is in it once."""
    size = len(counts) - 1
    sums, out = _Sums(counts.astype(np.int64)), []
    while True:
        there = np.flatnonzero(sums.left)
        if not len(there):
            return out
        used = Counter({int(there[-1]): 1})
        gap = size - int(there[-1])
        while gap > 0:
            exact = sums.fill(gap, used)
            if exact:
                used.update(exact)
                break
            fits = there[(there <= gap)][::-1]
            best = next((int(x) for x in fits if sums.left[x] > used[int(x)]), 0)
            if not best:
                break
            # many small pieces go in at once; the last ones are left to the exact sums
            n = max(1, min(int(sums.left[best]) - used[best], (gap - 3 * best) // best))
            used[best] += n
            gap -= n * best
        times = min(int(sums.left[x]) // n for x, n in used.items())
        for x, n in used.items():
            sums.left[x] -= n * times
        out.append((tuple(sorted(used.items(), reverse=True)), times))


def rank_intervals(planned: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset), sorted: where each rank goes."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, times in planned:
        offset = 0
        for length, n in lengths:
            rows.append((length, taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(pieces: DataFrame, size: int) -> DataFrame:
    """pieces(length, part, rank_in_part, ...) -> the same rows with sequence_id and offset."""
    tally = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # size rows at most
        counts[r["length"]] = r["n"]
    table = rank_intervals(plan(counts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = pieces.columns
    ranked = pieces.join(bases, ["part", "length"]).select(*names, (F.col("rank_in_part") + F.col("base")).alias("rank"))
    keys = (table[:, 0] << 48) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            k = rank - row[:, 1]
            own = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(tidy(place), kinds + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Packs docs: (pieces with their ids, placement of each piece).

    Both hold part, length and rank_in_part, which name a piece.  The placement
    carries ids_crc32, so that it can be checked without moving the ids.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, size)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "rank_in_part")
    return pieces, assign(slim, size)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets) of each packed sequence; a sequence's pieces meet in one task, size ids at most."""
    rows = pieces.select("part", "length", "rank_in_part", "ids").join(placed, ["part", "length", "rank_in_part"])
    items = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        rows.groupBy("sequence_id")
        .agg(items.alias("items"))
        .select("sequence_id", F.aggregate("items", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"), F.col("items.doc_id").alias("doc_ids"), F.col("items.offset").alias("offsets"))
    )
