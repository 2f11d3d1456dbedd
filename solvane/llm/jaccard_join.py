"""N-gram Jaccard self-join of documents, as a size-aware heavy-light join.

A document's set holds the hashes of its distinct word shingles.  Documents with
equal sets form a class, and one member stands for it.  Shingles are ordered from
rare to frequent, by counts of all documents in a sketch of fixed size (any one
order is exact; the counts only make lists short).  Two sets that reach the
threshold share at least one shingle among the first p = n - ceil(t n) + 1 of
each, and at least two among the first p + 1.

* Light sets (few shingles) enumerate the two-element subsets of their first
  p + 1 shingles; light sets that are alike share a subset.
* Heavy sets enter the inverted lists of their first p shingles, which are
  scanned by all sets that can be alike by size, light ones near the boundary
  included.
* The boundary is the size at which the summed costs (entries, and partners in
  the lists) are least; both are measured on all sets, by one sketch of how many
  classes enter each shingle's list and one of how many enter each subset's.

Lists are dealt out by their keys' hashes, packed as bytes, and scanned in sorted
order.  A short list gives all pairs that pass the size and position filters.  A
longer one is scanned against one hub, the member that holds the list's key
earliest in its order.  Pairs whose histograms of hashes leave room for the overlap
are verified on their whole sets.  Long lists whose members are then in one
component need no more; of the others, members of different components are
paired in blocks, under the same filters.  So a large group of near copies
costs its length, and no link that could join two components is left out.

Shingles are compared by 64-bit hashes that depend on the order of the words:
two given documents of n and m different shingles have one more in common than
their words say with a chance of about n m / 2**64.  Sets are told apart by their
size and 128 bits, and classes are numbered.

Defined results: null or empty texts, and texts without words, have n_shingles
0 and are linked with nothing; a text with fewer words than a shingle is one
shingle of all its words; repeated rows are linked; a null doc_id is a class
member without an id, and components are named by the smallest id that is not
null (null if there is none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.shared import only, scope, text_key, text_slices, tidy, trim, without, written
from solvane.llm.wordhash import SPACES, finish, tokens

#: Buckets of a sketch of frequencies, and the parts in which it is summed.
BUCKETS = 1 << 22
PARTS = 64
#: Buckets of a sketch of a part of all keys, so few that keys hardly share a bucket.
FEW = BUCKETS // 4
FEW_LOAD = 0.5
#: A list of more expected members is dealt out by member too.
LIST_ROWS = 100_000
#: Members of a short list.
SHORT = 16
#: Entries of lists that one task scans at once, about.
RANGE_ENTRIES = 200_000
#: A partner that an entry meets in a list costs as much as so many entries: its histogram, and maybe its set, has to be fetched.
PARTNER_COST = 32.0
#: Of the partners in a long list, beside the hub, so many have to be fetched: size and place rule most out, and lists that are closed need none.
OPEN_SHARE = 1 / 32
#: Bins of a set's histogram, which bounds the overlap of two sets from above.
BINS = 512
#: Sets of more shingles are always heavy.
LIGHT_MOST = 400
#: A class in more pairs than this, and than a HOT_ENDS-th of all pairs, has its pairs dealt out; so HOT_ENDS classes at most are dealt out for each end.
HUB_PAIRS = 100
HOT_ENDS = 10_000
#: Entries of an open long list that are compared with each other at once, about; longer lists are dealt out in blocks.
LONG_BLOCK = 1024
#: Classes, and shingles, of one component that are compared with each other at once, about; larger components are dealt out in blocks.
LINK_BLOCK = 2048
LINK_SHINGLES = 1 << 20
#: A shingle whose members are so large a share of the pairs is counted by a product of matrices, others pair by pair.
DENSE_PAIRS = 1 / 150
#: Sets, and shingles, that one task compares, about.
LINK_SETS = 2000
LINK_TASK = 1 << 21
#: Bytes of text that are hashed at once; arrays of some eight times the size are made of them.
SLICE = 1 << 20
#: Bits, for each id that is wanted, of the filter that keeps texts out of the shuffle when sets are fetched, and the least and most of them.
FILTER_BITS_EACH = 16
FILTER_BITS = (1 << 20, 1 << 30)


def _fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence of words and one more: the order counts, and equal words do not cancel out."""
    with np.errstate(over="ignore"):
        return finish(h * np.uint64(0x9E3779B97F4A7C15) + word)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    t = tokens(texts, SPACES)
    h = t.hash
    n = max(0, len(h) - width + 1)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = _fold(rolled, h[k : k + n])
    out = []
    for a, z in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
        if z - a >= width:
            s = np.sort(rolled[a : z - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif z > a:
            whole = np.full(1, z - a, np.uint64)
            for k in range(a, z):
                whole = _fold(whole, h[k : k + 1])
            out.append(whole)
        else:
            out.append(rolled[:0])
    return out


def set_name(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set, as signed numbers."""
    with np.errstate(over="ignore"):
        a, b = finish(s).sum(dtype=np.uint64), finish(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _slim(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))


def _sketch_parts(sketch: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(numbers, compressed counts) of a sketch's parts."""
    each = BUCKETS // PARTS
    parts = range(len(sketch) // each)
    return pa.array(parts, pa.int32()), pa.array([zlib.compress(sketch[p * each : (p + 1) * each].tobytes(), 1) for p in parts], pa.binary())


def _classes_and_sketch(docs: DataFrame, width: int) -> DataFrame:
    """Written: (doc_id, mark, n, s1, s2) of each row, and rows (part, counts) of the sketch with n null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(BUCKETS, np.uint32)
        names = ["doc_id", "mark", "n", "s1", "s2", "part", "counts"]
        for b in text_slices(batches, limit=SLICE):
            sets = shingle_sets(b.column("text").to_pylist(), width)
            named = [set_name(s) for s in sets]
            if any(map(len, sets)):
                np.add.at(sketch, _slots(np.concatenate(sets)), 1)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in named], pa.int64()), pa.array([x for _, x in named], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if sketch.any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, pa.int64())] * 5, *_sketch_parts(sketch)], names)

    return written(_slim(docs).mapInArrow(tidy(scan), "doc_id long, mark long, n long, s1 long, s2 long, part int, counts binary"), "shingle-classes", compression="zstd")


def _summed(rows: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """The sketch of the whole table: parts are summed in two steps, so that no task gets all tasks' rows.

    Sums are exact; the driver holds them as 32-bit floats, since all that they tell
    is an order of shingles and rough lengths of lists.
    """
    each = BUCKETS // PARTS

    def add(key, table):
        total = np.zeros(each, np.uint64)
        for x in table.column("counts").to_pylist():
            v = zlib.decompress(x)
            total += np.frombuffer(v, np.uint32 if len(v) == 4 * each else np.uint64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "counts"])

    kinds = "part int, counts binary"
    step = rows.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("deal"))
    step = step.groupBy("part", "deal").applyInArrow(add, kinds).groupBy("part").applyInArrow(add, kinds)
    out = np.zeros(size, np.float32)
    for r in step.toLocalIterator():  # size / each rows of fixed size
        out[r["part"] * each : (r["part"] + 1) * each] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return out


def least_overlap(n: int, percent: int) -> int:
    """The least number of common shingles of a set of n with any set that is alike."""
    return -(-percent * n // 100)


def _bins(s: np.ndarray) -> bytes:
    """How many members of a set fall in each bin, 255 for more."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def _prefixes(docs: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    """The first p + 1 shingles of each row's set, rare ones first, and its histogram."""
    share = docs.sparkSession.sparkContext.broadcast(sketch)
    names = ["doc_id", "mark", "n", "keys", "bins"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = share.value
        for b in text_slices(batches, limit=SLICE):
            out: tuple[list, ...] = tuple([] for _ in names)
            for doc, mark, s in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), shingle_sets(b.column("text").to_pylist(), width), strict=True):
                n = len(s)
                p = n - least_overlap(n, percent) + 1
                if n < 2 or (n + 1) * percent > 100 * n:  # only an equal set is alike
                    continue
                first = np.argsort(counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")[: p + 1]
                for c, v in zip(out, (doc, mark, n, s[first].view(np.int64), _bins(s)), strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names)

    return _slim(docs).mapInArrow(tidy(scan), "doc_id long, mark long, n long, keys array<long>, bins binary")


def _subsets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets with equally long prefixes, a row each: hashes of all two-element subsets, and the later element's place."""
    a, z = np.triu_indices(keys.shape[1], 1)
    with np.errstate(over="ignore"):
        return finish(keys[:, a] * np.uint64(0x9E3779B97F4A7C15) + finish(keys[:, z] + np.uint64(0x2545F4914F6CDD1D))), z


def _prefix_rows(n: np.ndarray, keys: pa.ListArray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their prefixes as a matrix) of the sets of at most ``most`` shingles, equally long prefixes together."""
    size = keys.value_lengths().to_numpy().astype(np.int64)
    flat, begin = keys.flatten().to_numpy(), np.cumsum(size) - size
    small = (n <= most) & (size > 1)
    for length in np.unique(size[small]):
        rows = np.flatnonzero(small & (size == length))
        yield rows, flat[begin[rows][:, None] + np.arange(length)].astype(np.int64).view(np.uint64)


def _slots(keys: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (keys & np.uint64(buckets - 1)).astype(np.int64)


def _few(keys: np.ndarray, share: float) -> np.ndarray:
    """Which keys are among the given share of all keys, by their hashes."""
    return (keys >> np.uint64(32)).astype(np.float64) < share * 2.0**32


def _list_sketches(own: DataFrame, shares: tuple[float, float]) -> np.ndarray:
    """How many classes enter the list of each shingle, and of each two-element subset.

    Four sketches, one after the other: of all shingles and all subsets (BUCKETS
    each), and of the given shares of them (FEW each).  All classes are counted.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2 * (BUCKETS + FEW), np.uint32)

        def add(kind: int, keys: np.ndarray) -> None:
            np.add.at(sketch, kind * BUCKETS + _slots(keys), 1)
            np.add.at(sketch, 2 * BUCKETS + kind * FEW + _slots(keys[_few(keys, shares[kind])], FEW), 1)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                n, keys = c.column("n").to_numpy(), c.column("keys")
                size = keys.value_lengths().to_numpy()
                flat = keys.flatten().to_numpy().view(np.uint64)
                add(0, np.delete(flat, np.cumsum(size)[size > 0] - 1))  # the last one is for subsets only
                for _, prefix in _prefix_rows(n, keys, LIGHT_MOST):
                    add(1, _subsets(prefix)[0].ravel())
        if sketch.any():
            yield pa.RecordBatch.from_arrays(list(_sketch_parts(sketch)), ["part", "counts"])

    return _summed(own.select("n", "keys").mapInArrow(tidy(scan), "part int, counts binary"), 2 * (BUCKETS + FEW))


def _costs(own: DataFrame, few: np.ndarray, shares: tuple[float, float]) -> list[tuple[int, float, float]]:
    """(size, cost of lists, cost of subsets), summed over all classes of up to 2 * LIGHT_MOST shingles.

    Two members of a short list meet once; a member of a long one meets the hub,
    and some of the others.  Lengths are told by the shares of keys that hardly
    share buckets, and stand for all keys.
    """
    length = np.maximum(few, 1)
    partners = np.where(length <= SHORT, (length - 1) / 2, 1 + OPEN_SHARE * (length - 1) / 2)
    share = own.sparkSession.sparkContext.broadcast(1 + PARTNER_COST * partners)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, total = share.value, {}

        def summed(kind: int, keys: np.ndarray) -> np.ndarray:
            own = _few(keys, shares[kind])
            return np.where(own, cost[kind * FEW + _slots(keys, FEW)], 0.0).sum(axis=1) / shares[kind]

        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                n = c.column("n").to_numpy()
                for rows, prefix in _prefix_rows(n, c.column("keys"), 2 * LIGHT_MOST):
                    single, both = summed(0, prefix[:, :-1]), np.zeros(len(rows))
                    light = n[rows] <= LIGHT_MOST
                    if light.any():
                        both[light] = summed(1, _subsets(prefix[light])[0])
                    for k, x, y in zip(n[rows].tolist(), single.tolist(), both.tolist(), strict=True):
                        was = total.get(k, (0.0, 0.0))
                        total[k] = (was[0] + x, was[1] + y)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x for x, _ in total.values()], pa.float64()), pa.array([y for _, y in total.values()], pa.float64())], ["n", "single", "subset"])

    rows = own.where(F.col("n") <= 2 * LIGHT_MOST).select("n", "keys").mapInArrow(tidy(scan), "n long, single double, subset double")
    summed = rows.groupBy("n").agg(F.sum("single").alias("c"), F.sum("subset").alias("s")).orderBy("n")
    return [(r["n"], r["c"], r["s"]) for r in summed.collect()]  # 2 * LIGHT_MOST rows at most


def boundary(costs: list[tuple[int, float, float]], percent: int) -> int:
    """The size up to which sets are light: where subsets of smaller sets plus lists of larger ones cost least.

    costs: (size, summed cost of lists, summed cost of subsets).  Light sets that
    can be alike a heavy one pay for both.
    """
    sizes = sorted({0, *(n for n, _, _ in costs if n <= LIGHT_MOST)})
    total = lambda most: sum(s for n, _, s in costs if n <= most) + sum(c for n, c, _ in costs if 100 * n >= percent * (most + 1))
    return min(sizes, key=lambda most: (total(most), most))


def _alike(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m with a first common key at i and j can reach the threshold."""
    need = -(-percent * (n + m) // (100 + percent))
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - i, m - j) >= need)


_ENTRY = np.dtype([("key", "<i8"), ("deal", "<i4"), ("n", "<i4"), ("i", "<i4"), ("cls", "<i8")])


def _dealt(keys: np.ndarray, cls: np.ndarray, parts: np.ndarray | None) -> np.ndarray:
    """The part of its list that an entry goes to, from 1 on; 0 where the list is whole."""
    if parts is None:
        return np.zeros(len(keys), np.int32)
    p = parts[_slots(keys.view(np.uint64))].astype(np.int64)
    return np.where(p > 1, 1 + cls % np.maximum(p, 1), 0)


def _set_entries(n: np.ndarray, cls: np.ndarray, keys: pa.ListArray, parts: np.ndarray | None, light: int, percent: int) -> np.ndarray:
    """A batch of sets' entries in lists; i is how many shingles at most precede what the key shares."""
    size = keys.value_lengths().to_numpy().astype(np.int64)
    flat = keys.flatten().to_numpy()
    begin = np.cumsum(size) - size
    i = np.arange(len(flat)) - np.repeat(begin, size)
    own = np.repeat(np.arange(len(n)), size)
    p = n + percent * -n // 100 + 1  # n - ceil(percent n / 100) + 1
    use = (i < p[own]) & (n[own] * 100 >= percent * (light + 1))
    out = [np.zeros(int(use.sum()), _ENTRY)]
    e = out[0]
    e["key"], e["n"], e["i"], e["cls"] = flat[use], n[own[use]], i[use], cls[own[use]]
    e["deal"] = _dealt(e["key"], e["cls"], None if parts is None else parts[:BUCKETS])
    for rows, prefix in _prefix_rows(n, keys, light):
        both, later = _subsets(prefix)
        e = np.zeros(both.size, _ENTRY)
        e["key"], e["n"], e["i"], e["cls"] = both.view(np.int64).ravel(), np.repeat(n[rows], len(later)), np.tile(later - 1, len(rows)), np.repeat(cls[rows], len(later))
        e["deal"] = _dealt(e["key"], e["cls"], None if parts is None else parts[BUCKETS:])
        out.append(e)
    return np.concatenate(out)


def _scan_lists(e: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of classes to verify, entries of long lists) of the lists that one range holds.

    Parts of a list that is dealt out count as long, whatever their length: they meet only among long lists' entries.
    """
    e = e[np.lexsort((e["cls"], e["n"], e["i"], e["deal"], e["key"]))]
    new = np.r_[True, (e["key"][1:] != e["key"][:-1]) | (e["deal"][1:] != e["deal"][:-1])] if len(e) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(e)])
    use = (size > 1) | (e["deal"][begin] > 0)
    e, size = e[np.repeat(use, size)], size[use]
    begin = np.cumsum(size) - size
    head, length = np.repeat(begin, size), np.repeat(size, size)
    place = np.arange(len(e)) - head
    wide = {f: e[f].astype(np.int64) for f in ("n", "i")}
    found = []

    def pair(x: np.ndarray, y: np.ndarray) -> None:
        ok = (e["cls"][x] != e["cls"][y]) & _alike(wide["n"][x], wide["i"][x], wide["n"][y], wide["i"][y], percent)
        a, b = e["cls"][x[ok]], e["cls"][y[ok]]
        found.append(np.c_[np.minimum(a, b), np.maximum(a, b)])

    for d in range(1, SHORT):
        x = np.flatnonzero((length <= SHORT) & (place + d < length))
        if not len(x):
            break
        pair(x, x + d)
    far = np.flatnonzero((length > SHORT) | (e["deal"] > 0))
    hub = far[length[far] > SHORT]
    pair(head[hub], hub)
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0), e[far]


_SCANNED = "a long, b long, key long, n int, i int, cls long"


def _parts(lengths: np.ndarray) -> np.ndarray | None:
    """Into how many parts the list of each bucket is dealt, those of shingles and of subsets one after the other; None if all are whole.

    Made bit by bit, so that the driver holds no second copy of the sketch.
    """
    over = [(of, of.mean(dtype=np.float64)) for of in lengths.reshape(2, BUCKETS)]
    if all(of.max() - mean <= LIST_ROWS for of, mean in over):
        return None
    each = BUCKETS // PARTS
    return np.concatenate([np.ceil((of[at : at + each] - mean) / LIST_ROWS).clip(1, 60_000).astype(np.uint16) for of, mean in over for at in range(0, BUCKETS, each)])


def _lists(own: DataFrame, lengths: np.ndarray, light: int, percent: int, entries: int) -> DataFrame:
    """Written: pairs (a, b) of the lists' scan, and entries (key, n, i, cls) of long lists (a null)."""
    ranges = max(1, entries // RANGE_ENTRIES)
    share = own.sparkSession.sparkContext.broadcast(_parts(lengths))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                c = b.slice(at, 2000)
                e = _set_entries(c.column("n").to_numpy(), c.column("cls").to_numpy(), c.column("keys"), share.value, light, percent)
                with np.errstate(over="ignore"):
                    r = (finish(e["key"].view(np.uint64) + e["deal"].astype(np.uint64)) % np.uint64(ranges)).astype(np.int64) if len(e) else np.zeros(0, np.int64)
                order = np.argsort(r, kind="stable")
                e, r = e[order], r[order]
                cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(e) else np.zeros(0, np.int64)
                blobs = [e[x:y].tobytes() for x, y in zip(cuts, np.r_[cuts[1:], len(e)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["r", "entries"])

    def scan(key, table):
        pairs, long = _scan_lists(np.frombuffer(b"".join(table.column("entries").to_pylist()), _ENTRY), percent)
        k, m = len(pairs), len(long)
        none = lambda n, kind: pa.nulls(n, kind)
        each = [("a", pairs[:, 0], None, pa.int64()), ("b", pairs[:, 1], None, pa.int64()), ("key", None, long["key"], pa.int64()), ("n", None, long["n"], pa.int32()), ("i", None, long["i"], pa.int32()), ("cls", None, long["cls"], pa.int64())]
        cols = [pa.chunked_array([pa.array(x, t) if x is not None else none(k, t), pa.array(y, t) if y is not None else none(m, t)], t) for _, x, y, t in each]
        trim()
        return pa.table(cols, [name for name, *_ in each])

    dealt = own.select("n", "cls", "keys").mapInArrow(tidy(deal), "r long, entries binary")
    return written(dealt.groupBy("r").applyInArrow(scan, _SCANNED), "lists", compression="zstd")


def _hot_ends(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Written: (cls, n, s1, s2, deals) of classes in very many pairs; 2 * HOT_ENDS rows at most, whatever the pairs."""
    most = max(HUB_PAIRS, pairs.count() // HOT_ENDS)
    ends = pairs.select(F.inline(F.array(*[F.struct(F.col(e).alias("cls"), F.lit(int(e == "a")).alias("a"), F.lit(int(e == "b")).alias("b")) for e in "ab"])))
    times = ends.groupBy("cls").agg(F.greatest(F.sum("a"), F.sum("b")).alias("n")).where(F.col("n") > most)
    deals = times.select("cls", F.ceil(F.col("n") / most).cast("int").alias("deals"))
    return written(own.select("cls", "n", "s1", "s2").join(F.broadcast(deals), "cls"), "hot-ends")


def _copies(sets: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """The sets, those of hot ends once for each part that their pairs are dealt to."""
    parts = F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)
    return sets.join(F.broadcast(hot.select(*keys, "deals")), keys, "left").withColumn("part", F.explode(parts)).drop("deals")


def _meet(pairs: DataFrame, end: str, copies: DataFrame, hot: DataFrame, keys: dict[str, str], *more) -> DataFrame:
    """pairs with columns of the sets at one end; keys: a set's key column -> the pairs' column."""
    known = hot.select(*[F.col(k).alias(v) for k, v in keys.items()], "deals")
    dealt = pairs.join(F.broadcast(known), list(keys.values()), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("deals", F.lit(1)).cast("long")).cast("int")).drop("deals")
    on = copies["part"] == dealt["part"]
    for k, v in keys.items():
        on = on & (copies[k] == dealt[v])
    return copies.join(dealt, on).select(*[dealt[c] for c in pairs.columns], *[copies[c].alias(f"{c}_{end}") for c in more])


_NAME = ["n", "s1", "s2"]


def _possible(pairs: DataFrame, own: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """The pairs whose histograms allow the overlap that they need, with both ends' names; own has (cls, n, s1, s2, bins)."""
    names = [f"{c}_{e}" for e in "ab" for c in _NAME]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(c.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in ("bins_a", "bins_b"))
                most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                n = c.column("n_a").to_numpy() + c.column("n_b").to_numpy()
                ok = (most >= -(-percent * n // (100 + percent))) | (x.max(axis=1) == 255) | (y.max(axis=1) == 255)
                yield c.select(["a", "b", *names]).filter(pa.array(ok))

    copies = _copies(own.select("cls", *_NAME, "bins"), hot, ["cls"])
    both = pairs
    for e in "ba":
        both = _meet(both, e, copies, hot, {"cls": e}, *_NAME, "bins")
    return both.mapInArrow(tidy(sift), "a long, b long, " + ", ".join(f"{c} long" for c in names))


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(n, s1, s2, set) of the rows that wanted(k, mark) names, and of few others; wanted must be written.

    A filter of bounded size lets the wanted rows through and hardly any others;
    sets, not texts, are shuffled.
    """
    spark = docs.sparkSession
    size = int(np.clip(1 << (FILTER_BITS_EACH * wanted.count()).bit_length(), *FILTER_BITS))
    slot = F.pmod(F.xxhash64("k", "mark"), F.lit(size))
    words = wanted.select(slot.alias("b")).groupBy(F.shiftright("b", 16).alias("w")).agg(F.collect_set(F.col("b").bitwiseAND(0xFFFF).cast("int")).alias("b"))
    packed = np.zeros(size >> 3, np.uint8)
    for r in words.toLocalIterator():  # as many bits as the filter has, at most
        at = (r["w"] << 16) + np.array(r["b"], np.int64)
        np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    share = spark.sparkContext.broadcast(packed)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = share.value
        for whole in batches:
            at = whole.column("slot").to_numpy()
            passed = whole.filter(pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            for b in text_slices(iter([passed]), limit=SLICE):
                found = [s for s in shingle_sets(b.column("text").to_pylist(), width) if len(s)]
                named = [set_name(s) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in found], pa.int64()), pa.array([x for x, _ in named], pa.int64()), pa.array([x for _, x in named], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["n", "s1", "s2", "set"])

    rows = _slim(docs).select("text", *text_key(text_hash="mark"))
    return rows.select("text", slot.alias("slot")).mapInArrow(tidy(sets), "n long, s1 long, s2 long, set binary")


def _verified(near: DataFrame, sets: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets of hashes reach the threshold, written.  Both joins use one shuffle of the sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    copies = _copies(sets, hot, _NAME).dropDuplicates([*_NAME, "part"])
    both = near
    for e in "ba":
        both = _meet(both, e, copies, hot, {c: f"{c}_{e}" for c in _NAME}, "set")
    return written(both.select("a", "b", "set_a", "set_b").mapInArrow(tidy(check), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(v, comp) of every end of links(a, b): the smallest reachable end, by least labels and jumps to labels' labels."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "both-ways")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("comp")), "labels")
    while True:
        told = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("heard"))
        step = labels.join(told, "v").select("v", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jumped = step.join(labels.select(F.col("v").alias("comp"), F.col("comp").alias("far")), "comp", "left").select("v", "was", F.least("comp", "far").alias("comp"))
        fresh = written(jumped, "labels")
        labels = fresh.select("v", "comp")
        if fresh.where("comp <> was").isEmpty():
            return labels


def _linked(docs: DataFrame, classes: DataFrame, own: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The verified of pairs(a, b) of classes."""
    hot = _hot_ends(pairs, own)
    near = written(_possible(pairs, own, hot, percent), "possible")
    ends = near.select(F.col("a").alias("cls")).union(near.select(F.col("b").alias("cls"))).distinct()
    wanted = written(ends.join(classes.select("cls", "k", "mark"), "cls").select("k", "mark"), "wanted-sets")
    return _verified(near, _sets_of(docs, wanted, width), hot, percent)


def _open_pairs(lists: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of one long list that are in different components and can be alike by size and place.

    lists has the entries (key, n, i, cls).  Blocks of a list meet pairwise, so a
    list of any length is spread over tasks, and only pairs that pass are written.
    """
    at = written(lists.join(comp.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "long-lists", compression="zstd")
    blocks = F.ceil(F.col("m") / LONG_BLOCK).cast("int")
    open_lists = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m", blocks.alias("blocks"))
    open_lists = written(open_lists, "open-lists")
    ranges = max(1, int(open_lists.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0) // RANGE_ENTRIES)
    each = at.join(open_lists.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    each = each.select("key", "lo", "hi", "block", "n", "i", "cls", "comp", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(ranges)).alias("r"))

    def pair(key, table):
        col = {c: table.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi", "block", "n", "i", "cls", "comp")}
        order = np.lexsort((col["hi"], col["lo"], col["key"]))
        cut = np.flatnonzero(sum(np.diff(col[c][order]) != 0 for c in ("key", "lo", "hi")) > 0) + 1
        found = []
        for rows in np.split(order, cut):
            for part in np.array_split(rows, -(-len(rows) // 256)):
                x, y = part[:, None], rows[None, :]
                ok = (col["comp"][x] < col["comp"][y]) & _alike(col["n"][x], col["i"][x], col["n"][y], col["i"][y], percent)
                if col["lo"][rows[0]] != col["hi"][rows[0]]:
                    ok &= col["block"][x] != col["block"][y]
                u, v = np.nonzero(ok)
                a, b = col["cls"][part[u]], col["cls"][rows[v]]
                found.append(np.c_[np.minimum(a, b), np.maximum(a, b)])
        pairs = np.unique(np.concatenate(found), axis=0)
        trim()
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return each.groupBy("r").applyInArrow(pair, "a long, b long").distinct()


class _Side:
    """Which sets of one block hold each shingle: the list of those that do, or, where most do, of those that do not."""

    def __init__(self, shingle: np.ndarray, row: np.ndarray, shingles: int, size: int):
        held = np.bincount(shingle, minlength=shingles)
        self.most = held * 2 > size
        which = np.flatnonzero(self.most)
        place = np.cumsum(self.most) - 1
        own = self.most[shingle]
        absent = np.ones((len(which), size), bool)
        absent[place[shingle[own]], row[own]] = False
        k, r = np.nonzero(absent)
        shingle, row = np.r_[shingle[~own], which[k]], np.r_[row[~own], r]
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.row = shingle[order], row[order]
        self.count = np.bincount(self.shingle, minlength=shingles)
        self.begin = np.cumsum(self.count) - self.count
        self.sign = np.where(self.most, -1, 1)  # a set holds a shingle: most + sign * (it is listed)
        self.size = size

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """For each set the sum of the signed weights of the shingles that list it."""
        return np.bincount(self.row, (self.sign * weight)[self.shingle], self.size)

    def matrix(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros((len(shingles), self.size), np.float32)
        for k, c in enumerate(shingles):
            out[k, self.row[self.begin[c] : self.begin[c] + self.count[c]]] = self.sign[c]
        return out


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The numbers of common shingles of all sets of x with all of y."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    _, ids = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cut = int(sizes[0].sum())
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    n = int(ids.max()) + 1
    both = (np.bincount(ids[:cut], minlength=n) > 0) & (np.bincount(ids[cut:], minlength=n) > 0)
    number, m = np.cumsum(both) - 1, int(both.sum())
    a, b = (_Side(number[i[both[i]]], r[both[i]], m, len(size)) for i, r, size in zip((ids[:cut], ids[cut:]), rows, sizes, strict=True))
    # (most_a + sign_a in_a) (most_b + sign_b in_b), summed over all shingles
    out = (a.sums(b.most)[:, None] + b.sums(a.most)[None, :] + np.count_nonzero(a.most & b.most)).astype(np.int32)
    work = a.count * b.count
    dense = work > a.size * b.size * DENSE_PAIRS
    heavy = np.flatnonzero(dense)
    for lo in range(0, len(heavy), 1024):
        part = heavy[lo : lo + 1024]
        out += np.rint(a.matrix(part).T @ b.matrix(part)).astype(np.int32)
    entry = np.flatnonzero(~dense[a.shingle])
    flat = out.ravel()
    times = b.count[a.shingle[entry]]
    for e in np.split(np.arange(len(entry)), np.flatnonzero(np.diff(np.cumsum(times) // 1_000_000)) + 1):
        c, t = a.shingle[entry[e]], times[e]
        at = np.repeat(b.begin[c] - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
        np.add.at(flat, np.repeat(a.row[entry[e]] * b.size, t) + b.row[at], np.repeat(a.sign[c] * b.sign[c], t).astype(np.int32))
    return out


def _block_links(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray | None]:
    """With how many sets of y each set of x is alike, and the other way round; without y, with how many others of x."""
    other = x if y is None else y
    common = _common(x, other)
    size, to = (np.array([len(s) for s in side], np.int64) for side in (x, other))
    ok = np.stack([100 * c.astype(np.int64) >= percent * (n + to - c) for c, n in zip(common, size, strict=True)])
    if y is None:
        np.fill_diagonal(ok, False)
    return ok.sum(axis=1), None if y is None else ok.sum(axis=0)


def link_counts(docs: DataFrame, classes: DataFrame, comp: DataFrame, width: int, percent: int) -> DataFrame:
    """(cls, n_links) of every class in comp(v, comp): how many other classes it is linked with.

    Components are exact, so all links are inside them; there every pair is compared.  Blocks of a component meet
    pairwise, so its classes' sets are sent as often as it has blocks, and no pairs are written.
    """
    named = comp.select(F.col("v").alias("cls"), "comp").join(classes.select("cls", *_NAME, "k", "mark"), "cls")
    size = named.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    blocks = F.greatest(F.ceil(F.col("m") / LINK_BLOCK), F.ceil(F.col("all") / LINK_SHINGLES)).cast("int")
    at = written(named.join(size, "comp").select("cls", *_NAME, "k", "mark", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block")), "link-blocks")
    sent = at.agg(F.sum("blocks"), F.sum(F.col("blocks") * F.col("n"))).first()
    ranges = max(1, (sent[0] or 0) // LINK_SETS, (sent[1] or 0) // LINK_TASK)
    sets = _sets_of(docs, at.select("k", "mark"), width).dropDuplicates(_NAME)
    each = at.drop("k", "mark").join(sets, _NAME).select("cls", "comp", "block", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("cls", "comp", "block", "set", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    each = each.withColumn("r", F.pmod(F.xxhash64("comp", "lo", "hi"), F.lit(ranges)))

    def count(key, table):
        cls, where, lo, hi, block = (table.column(c).to_numpy() for c in ("cls", "comp", "lo", "hi", "block"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        order = np.lexsort((block, hi, lo, where))
        changed = (np.diff(where[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
        n = np.zeros(len(cls), np.int64)
        for rows in np.split(order, np.flatnonzero(changed) + 1):
            x, y = rows[block[rows] == lo[rows[0]]], rows[block[rows] != lo[rows[0]]]
            if lo[rows[0]] == hi[rows[0]]:
                n[x], _ = _block_links([sets[k] for k in x], None, percent)
            elif len(x) and len(y):
                n[x], n[y] = _block_links([sets[k] for k in x], [sets[k] for k in y], percent)
        trim()
        return pa.table([pa.array(cls), pa.array(n)], ["cls", "n_links"])

    return each.groupBy("r").applyInArrow(count, "cls long, n_links long").groupBy("cls").agg(F.sum("n_links").alias("n_links"))


def similar_components(docs: DataFrame, width: int = 4, percent: int = 85, light: int | None = None, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, k, mark, stands) of every row of docs(doc_id, text).

    Documents link when their sets' Jaccard similarity is percent / 100 or more.
    With count_links also n_links: with how many other classes (different sets) the row's class is linked, none left out.
    light overrides the boundary, which the costs choose otherwise.  k and mark name the row (shared.text_key); stands is true for the rows that
    stand for their component, which are one row or repeats of it.  The result is written; all other working tables are removed.
    """
    with scope(docs.sparkSession):
        return written(_components_of(docs, width, percent, light, count_links), "similar", outer=1, compression="zstd")


def _components_of(docs: DataFrame, width: int, percent: int, light: int | None, count_links: bool) -> DataFrame:
    scanned = _classes_and_sketch(docs, width)
    sketch = _summed(scanned)
    rows = scanned.where("n is not null").select("doc_id", *text_key(text_hash="mark"), "n", "s1", "s2")
    members = rows.where("n > 0")
    classes = members.groupBy(*_NAME).agg(F.min(F.struct("k", "mark", "doc_id")).alias("rep"))
    # numbers, not hashes, name classes: two of them never fall together
    classes = written(classes.select(*_NAME, F.monotonically_increasing_id().alias("cls"), "rep.k", "rep.mark", "rep.doc_id"), "classes")
    prefixes = _prefixes(docs, sketch, width, percent).withColumn("k", text_key(text_hash="mark")[0])
    own = prefixes.drop("n").join(classes.select("k", "mark", "cls", *_NAME), ["k", "mark"]).dropDuplicates(["cls"]).select("cls", *_NAME, "keys", "bins")
    own = written(own, "prefixes", compression="zstd")
    del sketch, prefixes  # the driver keeps no sketch that is done with
    trim()
    subsets = F.size("keys") * (F.size("keys") - 1) / 2
    sums = own.agg(F.sum(F.size("keys") - 1).alias("single"), F.sum(F.when(F.col("n") <= LIGHT_MOST, subsets)).alias("subset")).first()
    shares = tuple(min(1.0, FEW * FEW_LOAD / max(float(x or 0), 1.0)) for x in (sums["single"], sums["subset"]))
    lengths = _list_sketches(own, shares)
    if light is None:
        light = boundary(_costs(own, lengths[2 * BUCKETS :], shares), percent)
    listed = int((sums["single"] or 0) + (own.where(F.col("n") <= light).agg(F.sum(subsets)).first()[0] or 0))

    lists = _lists(own, lengths[: 2 * BUCKETS], light, percent, listed)
    del lengths
    trim()
    pairs = written(lists.where("a is not null").select("a", "b").distinct(), "pairs")
    links = _linked(docs, classes, own, pairs, width, percent)
    comp = components(links)

    more = _open_pairs(lists.where("a is null").select("key", "n", "i", "cls"), comp, percent)
    more = written(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    if not more.isEmpty():
        late = _linked(docs, classes, own, more, width, percent)
        if not late.isEmpty():
            comp = components(links.unionByName(late))

    named = classes.join(comp.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = named.groupBy("comp").agg(F.min(F.struct("k", "mark", "doc_id")).alias("first"))
    by_class = named.join(smallest, "comp").select("n", "s1", "s2", "first", "cls")
    n_links = [F.col("n_links")] if count_links else []
    if count_links:
        counted = written(link_counts(docs, classes, comp, width, percent), "link-counts")
        by_class = by_class.join(counted, "cls", "left").na.fill(0, ["n_links"])
    linked = members.join(by_class, ["n", "s1", "s2"])
    stands = (F.col("k") == F.col("first.k")) & (F.col("mark") == F.col("first.mark"))
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "k", "mark", stands.alias("stands"), *n_links)
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "k", "mark", F.lit(True).alias("stands"), *[F.lit(0).cast("long").alias("n_links") for _ in n_links]))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component (the smallest doc_id, and of repeated rows one); texts without words all stay."""
    parts = similar_components(docs, width, percent)
    kept = without(docs, parts.where("not stands").select("k", "mark"))
    # rows that are repeated word for word under one id: only these are shuffled
    again = written(parts.where("stands and n_shingles > 0").groupBy("k", "mark").count().where("count > 1").select("k", "mark"), "repeated-rows")
    if again.isEmpty():
        return kept
    names = docs.columns
    k, mark = text_key()
    marked = kept.select("*", k.alias("w_k"), mark.alias("w_mark"))
    some = marked.join(again.select(F.col("k").alias("w_k"), F.col("mark").alias("w_mark")), ["w_k", "w_mark"], "left_semi").dropDuplicates(["w_k", "w_mark"])
    return without(kept, again).unionByName(some.select(*[F.col(f"`{n}`") for n in names]))
