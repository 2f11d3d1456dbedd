"""Benchmark decontamination with a distributed positional inverted index.

The training text is indexed once, in shards of a bounded number of bytes.  A
shard's row in the stored index holds, for each term of the test vocabulary that
occurs in the shard, the ascending list of its positions; documents are told
apart by a gap in the positions.  Which terms are in the test vocabulary is asked
of a filter of fixed size, so a few others are indexed too, and the index serves
all test phrases.  Corpus frequencies come from the stored postings of all
shards.  A test phrase is found in a shard by taking the postings of its rarest
term (by corpus frequency), shifted by the term's offset in the phrase, and
intersecting them with the shifted postings of its other terms, from rare to
frequent; what is left are the exact phrase's first positions.  Proximity matches
take the phrase's rarest terms only, each within ``slop`` words of its place and
in the same document; the other terms need not occur at all.

Shards are rows, so nothing is shuffled by term, and a passage that very many
documents share costs what its occurrences cost.  Test phrases go to the stored
index in blocks of a fixed number.  Terms are 64-bit hashes of words.

Defined results: null and empty texts have no words and no hits; items without
words have no phrases; a repeated document row is a document of its own; items
with the same id count once in the list of items; a null item id is the empty
one; an exact match is a proximity match too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.shared import only, text_slices, tidy, written
from solvane.llm.wordhash import tokens

#: Bytes of text in one shard; a longer document is a shard of its own.
SHARD_BYTES = 2 << 20
#: Distinct phrases that go to the shards at once.
BLOCK_PHRASES = 100_000
#: Bits of the filter of the test vocabulary.
VOCABULARY_BITS = 1 << 27

#: Maximal runs of digits, letters (A-Z as a-z) and characters beyond ASCII are words.
_WORDS = np.array([int(b >= 128 or chr(b).isalnum()) for b in range(256)], np.uint8)
_INDEX = "shard string, doc_ids array<long>, marks array<long>, begins array<int>, n_words array<int>, terms array<long>, bounds array<int>, positions array<int>"
_MATCHES = "row_id string, doc_id long, text_hash long, n_words long, n_hit long, items array<string>, hit_starts array<int>, hit_ends array<int>, proximity_items array<string>"


class Phrases:
    """A block of test phrases: the vocabulary, each distinct phrase once, and the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        t = tokens([text for _, text in items], _WORDS)
        #: sorted hashes of the words; a term is its place here
        self.vocabulary, ids = np.unique(t.hash, return_inverse=True)
        by_words: dict[tuple[int, ...], set[str]] = {}
        for (item, _), lo, hi in zip(items, t.first[:-1], t.first[1:], strict=True):
            own = ids[lo:hi].tolist()
            for a in range(max(1, len(own) - size + 1)) if own else ():
                by_words.setdefault(tuple(own[a : a + size]), set()).add(item)
        self.items = [sorted(x) for x in by_words.values()]
        self.length = np.array([len(p) for p in by_words], np.int32)
        self.terms = np.full((len(by_words), size), -1, np.int32)
        for k, p in enumerate(by_words):
            self.terms[k, : len(p)] = p

    def order_by(self, frequency: np.ndarray) -> None:
        """Each phrase's offsets from its rarest term to its most frequent one."""
        df = np.where(self.terms >= 0, np.r_[frequency, 0][self.terms], np.iinfo(np.int64).max)
        self.offsets = np.argsort(df, axis=1, kind="stable").astype(np.int32)


def _bit(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, mask) of each term in the filter."""
    at = (hashes % np.uint64(VOCABULARY_BITS)).astype(np.int64)
    return at >> 3, (1 << (at & 7)).astype(np.uint8)


def index_postings(docs: DataFrame, known: np.ndarray, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index: a row for each shard, with the postings of the terms that pass the filter ``known``."""
    share = docs.sparkSession.sparkContext.broadcast(known)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = share.value, TaskContext.get().partitionId()
        for nth, b in enumerate(text_slices(batches, limit=shard_bytes)):
            t = tokens(b.column("text").to_pylist(), _WORDS)
            byte, mask = _bit(t.hash)
            hit = np.flatnonzero(known[byte] & mask)
            # one place is left free after each document
            terms, places = t.hash[hit], (hit + t.texts()[hit]).astype(np.int32)
            order = np.argsort(terms, kind="stable")
            terms, places = terms[order], places[order]
            first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
            row = [b.column("doc_id"), b.column("mark"), t.first[:-1] + np.arange(b.num_rows), t.counts(), terms[first].view(np.int64), np.r_[first, len(terms)], places]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, k)) for v, k in zip(row, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{nth}"]), *lists], ["shard", "doc_ids", "marks", "begins", "n_words", "terms", "bounds", "positions"])

    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return written(slim.mapInArrow(tidy(index), _INDEX), "postings", compression="zstd")


def frequencies(index: DataFrame) -> DataFrame:
    """Written: (term, n), the occurrences of each indexed term over all shards."""
    spans = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.element_at("bounds", i + 2) - F.element_at("bounds", i + 1)).alias("n")))
    return written(index.select(F.inline(spans)).groupBy("term").agg(F.sum("n").alias("n")), "term-frequencies")


def frequencies_of(block: Phrases, frequency: DataFrame) -> np.ndarray:
    """Occurrences of each term of a block; as many numbers as its vocabulary has terms."""
    out = np.zeros(len(block.vocabulary), np.int64)
    own = frequency.sparkSession.createDataFrame(pa.table({"term": block.vocabulary.view(np.int64)}))
    for r in frequency.join(F.broadcast(own), "term").collect():
        out[np.searchsorted(block.vocabulary, np.int64(r["term"]).view(np.uint64))] = r["n"]
    return out


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that cover the given ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[cut], reach[np.r_[cut[1:] - 1, len(starts) - 1]]


def _exact(block: Phrases, keep: np.ndarray, lists: dict[int, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first position) of all exact occurrences of the kept phrases in one shard.

    ``at`` holds the term at each position of the shard, as its postings say:
    looking a shifted posting up there is its intersection with that term's list.
    """
    found_p, found_s = [], []
    rare = block.offsets[keep, 0]
    anchors = block.terms[keep, rare]
    for lo in range(0, len(keep), 2048):
        part = slice(lo, lo + 2048)
        own = [lists[t] for t in anchors[part]]
        sizes = np.array([len(x) for x in own])
        # bounded steps: the anchors' postings are taken until a million places are at hand
        step = np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(sizes) // 1_000_000)) + 1)
        for ks in step:
            p = np.repeat(keep[part][ks], sizes[ks])
            s = np.concatenate([own[k] for k in ks]).astype(np.int64) - np.repeat(rare[part][ks], sizes[ks])
            ok = (s >= 0) & (s + block.length[p] <= len(at))
            p, s = p[ok], s[ok]
            for j in range(1, block.terms.shape[1]):
                if not len(p):
                    break
                live = j < block.length[p]
                o = np.where(live, block.offsets[p, j], 0)
                ok = ~live | (at[s + o] == block.terms[p, o])
                p, s = p[ok], s[ok]
            found_p.append(p)
            found_s.append(s)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_p]), np.concatenate([none, *found_s])


def _near(block: Phrases, lists: dict[int, np.ndarray], at: np.ndarray, begins: np.ndarray, counts: np.ndarray, slop: int, rare_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place of its rarest term) where each of its rarest terms stands within slop words of its place, in one document."""
    offsets = block.offsets[:, :rare_terms]
    rare = np.take_along_axis(block.terms, offsets, 1)
    there = np.zeros(len(block.vocabulary) + 1, bool)
    there[list(lists)] = True
    there[-1] = True  # for -1, no term
    keep = np.flatnonzero(there[rare].all(axis=1))
    found_p, found_s = [], []
    for lo in range(0, len(keep), 2048):
        part = keep[lo : lo + 2048]
        own = [lists[t] for t in rare[part, 0].tolist()]
        sizes = np.array([len(x) for x in own])
        # bounded steps, as for exact matches
        for ks in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(sizes) // 250_000)) + 1):
            p, s = np.repeat(part[ks], sizes[ks]), np.concatenate([own[k] for k in ks]).astype(np.int64)
            for j in range(1, rare.shape[1]):
                if not len(p):
                    break
                doc = np.searchsorted(begins, s, "right") - 1
                want, term = s + offsets[p, j] - offsets[p, 0], rare[p, j]
                ok = term < 0
                for d in range(-slop, slop + 1):
                    place = want + d
                    inside = (place >= begins[doc]) & (place < begins[doc] + counts[doc])
                    ok |= inside & (at[np.where(inside, place, 0)] == term)
                p, s = p[ok], s[ok]
            found_p.append(p)
            found_s.append(s)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_p]).astype(np.int64), np.concatenate([none, *found_s])


def search(index: DataFrame, block: Phrases, slop: int | None = None, rare_terms: int = 4) -> DataFrame:
    """Matches of a block of phrases, a row for each document of the index (_MATCHES).

    hit_starts and hit_ends are word positions, ends exclusive, of maximal runs
    covered by exact matches; proximity_items are empty unless slop is given.
    """
    share = index.sparkSession.sparkContext.broadcast(block)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = share.value
        for b in batches:
            for row in range(b.num_rows):
                ids, marks, begins, counts, terms, bounds, places = (b.column(k)[row].values for k in range(1, 8))
                begins, counts, terms, bounds, places = (x.to_numpy() for x in (begins, counts, terms, bounds, places))
                terms = terms.view(np.uint64)
                # the block's terms in this shard
                slot = np.minimum(np.searchsorted(terms, own.vocabulary), max(0, len(terms) - 1))
                mine = np.flatnonzero(terms[slot] == own.vocabulary) if len(terms) else np.zeros(0, np.int64)
                number = np.full(len(terms), -2, np.int32)
                number[slot[mine]] = mine
                at = np.full(int(begins[-1] + counts[-1]) + 1, -2, np.int32)
                at[places] = np.repeat(number, np.diff(bounds))
                lists = {t: places[bounds[k] : bounds[k + 1]] for t, k in zip(mine.tolist(), slot[mine].tolist(), strict=True)}
                there = np.zeros(len(own.vocabulary) + 1, bool)
                there[mine] = True
                there[-1] = True  # for -1, no term
                keep = np.flatnonzero(there[own.terms].all(axis=1))
                p, s = _exact(own, keep, lists, at) if len(keep) else (np.zeros(0, np.int64),) * 2
                doc = np.searchsorted(begins, s, "right") - 1
                near: dict[int, set[str]] = {}
                if slop is not None:
                    q, t = _near(own, lists, at, begins, counts, slop, rare_terms)
                    which = np.unique(np.c_[np.searchsorted(begins, t, "right") - 1, q], axis=0)
                    for d, x in which.tolist():
                        near.setdefault(d, set()).update(own.items[x])
                out = {n: [] for n in ("n_hit", "items", "hit_starts", "hit_ends", "proximity_items")}
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(begins) + 1))
                for d in range(len(begins)):
                    mine = order[cuts[d] : cuts[d + 1]]
                    if len(mine):
                        a, z = _union(s[mine] - begins[d], s[mine] - begins[d] + own.length[p[mine]])
                        out["n_hit"].append(int((z - a).sum()))
                        out["items"].append(sorted({i for k in np.unique(p[mine]) for i in own.items[k]}))
                    else:
                        a = z = ()
                        out["n_hit"].append(0)
                        out["items"].append([])
                    out["hit_starts"].append(a)
                    out["hit_ends"].append(z)
                    out["proximity_items"].append(sorted(near.get(d, ())))
                texts, ints = pa.list_(pa.string()), pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{b.column(0)[row]}-{d}" for d in range(len(begins))], pa.string()), ids, marks, pa.array(counts, pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], texts), pa.array(out["hit_starts"], ints), pa.array(out["hit_ends"], ints), pa.array(out["proximity_items"], texts)],
                    ["row_id", "doc_id", "text_hash", "n_words", "n_hit", "items", "hit_starts", "hit_ends", "proximity_items"],
                )

    return index.mapInArrow(tidy(match), _MATCHES)


def blocks_of(benchmark: DataFrame, size: int, limit: int = BLOCK_PHRASES) -> Iterator[Phrases]:
    """The test phrases in blocks of about limit; one block is in the driver's memory at a time."""
    held, n = [], 0
    # sorted, so that a block is the same each time
    for r in only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"] if r["item_id"] is not None else "", r["text"]))
        n += len(r["text"] or "") // 4 + 1
        if n >= limit:
            yield Phrases(held, size)
            held, n = [], 0
    if held:
        yield Phrases(held, size)


def _vocabulary(benchmark: DataFrame, size: int) -> np.ndarray:
    """The filter of all words of the benchmark."""
    known = np.zeros(VOCABULARY_BITS >> 3, np.uint8)
    for block in blocks_of(benchmark, size):
        np.bitwise_or.at(known, *_bit(block.vocabulary))
    return known


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, slop: int | None = None, rare_terms: int = 4) -> DataFrame:
    """Exact and proximity matches of all test phrases of size words, a row for each row of docs.

    An item of fewer words, but not none, is one phrase.  row_id names the row's
    shard and place there, as the stored index has them, text_hash its text; the
    rows of several blocks of phrases are merged by row_id.
    """
    index = index_postings(docs, _vocabulary(benchmark, size))
    frequency, found = frequencies(index), []
    for block in blocks_of(benchmark, size):
        block.order_by(frequencies_of(block, frequency))
        found.append(search(index, block, slop, rare_terms))
    if not found:
        empty = Phrases([], size)
        empty.order_by(np.zeros(0, np.int64))
        found.append(search(index, empty, slop, rare_terms))
    return found[0] if len(found) == 1 else _merged(found)


def _merged(found: list[DataFrame]) -> DataFrame:
    """One row a document from the rows of several blocks, all of the same stored index."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))))
    merged = (
        every.groupBy("row_id", "doc_id", "text_hash", "n_words")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("proximity_items")))).alias("proximity_items"), spans.alias("spans"))
    )
    # the union of sorted spans: a span opens a new run where it starts beyond all before it
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("reach")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["hit_ends"] - F.greatest(x["hit_starts"], acc["reach"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], x["hit_ends"]).alias("reach")),
    )
    return merged.select("row_id", "doc_id", "text_hash", "n_words", step["n"].cast("long").alias("n_hit"), "items", F.col("spans.hit_starts").alias("hit_starts"), F.col("spans.hit_ends").alias("hit_ends"), "proximity_items")
