"""Document fingerprints by locally consistent parsing.

A text is parsed into a hierarchy of phrases.  At each level runs of one symbol
become single symbols; then three rounds of deterministic coin tossing (the
lowest bit in which a symbol differs from the one before it, and that bit's
value) bring neighbours to different labels below 8; phrases begin at local
maxima of the labels, and a phrase's name is a hash of its symbols.  A boundary
depends on a few symbols around it only, so equal substrings get equal phrases
but for a few at their ends, wherever they stand.

The fingerprint holds the least hashes of the phrase names of the levels in
``LEVELS_USED``, one for each of ``SLOTS`` slots; likeness is the Dice share that
belongs to the share of slots that agree.

Defined results: null counts as the empty text, whose fingerprint is all zeros
and is like itself (1) and unlike all others (0); equal texts have equal
fingerprints; a text is its own successor in a table of one row; rows with one
doc_id follow each other by a hash of their texts, then by the texts; null ids
come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.shared import only, text_slices, tidy
from solvane.llm.wordhash import finish

SLOTS = 128
#: Levels whose phrases count: words and parts of words, and clauses.
LEVELS_USED = (2, 3)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NULL_KEY = -(1 << 63)
_EMPTY = "0" * (4 * SLOTS)


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of nonzero x."""
    low = x & (~x + x.dtype.type(1))
    if x.dtype == np.uint64:
        return ((low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)).astype(np.uint8)
    return ((low.astype(np.float32).view(np.uint32) >> np.uint32(23)) - np.uint32(127)).astype(np.uint8)


def _toss(label: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One round of coin tossing; the first symbol of a text is tossed against its own complement's low bit."""
    differ = np.empty_like(label)
    differ[0] = 1
    np.bitwise_xor(label[1:], label[:-1], out=differ[1:])
    differ[head] = 1
    k = _low_bit(differ)
    bit = ((label >> k.astype(label.dtype)) & label.dtype.type(1)).astype(np.uint8)
    # neighbours that are equal by chance (first symbols of texts) stay apart by the bit alone
    return 2 * k + bit


def _level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of several texts' symbols, one text after another, and where each text begins."""
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first] = True
    if not new.all():
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(symbols)))
        symbols = symbols[at]
        long = run > 1
        named = symbols.astype(np.uint64)
        with np.errstate(over="ignore"):
            named[long] = finish(named[long] * _BASE + run[long].astype(np.uint64))
        symbols = named
        first = np.searchsorted(at, first)
    head = first
    label = symbols
    for _ in range(3):
        label = _toss(label, head)
    n = len(symbols)
    start = np.zeros(n, bool)
    if n > 2:
        # ties cannot be local maxima on both sides: the left one of two equal labels is taken
        start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
        last = np.r_[head[1:], n] - 1
        start[last] = False
    start[head] = True
    at = np.flatnonzero(start)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max(initial=0)), _BASE)])
        value = finish(symbols.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)) * powers[place]
        names = finish(np.add.reduceat(value, at))
    return names, np.searchsorted(at, head)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS 16-bit values for each text; rows of empty texts are 0."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    full = [k for k, t in enumerate(texts) if t]
    if not full:
        return out
    coded = [np.frombuffer(texts[k].encode("utf-32-le", "surrogatepass"), "<u4") for k in full]
    symbols = np.concatenate(coded)
    first = np.cumsum([0, *(len(c) for c in coded[:-1])])
    least = np.full((len(full), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    for level in range(1, max(LEVELS_USED) + 1):
        symbols, first = _level(symbols, first)
        if level in LEVELS_USED:
            with np.errstate(over="ignore"):
                h = finish(symbols ^ np.uint64(0xD1B54A32D192ED03 * level & (2**64 - 1)))
            text = np.repeat(np.arange(len(full)), np.diff(np.append(first, len(symbols))))
            slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
            np.minimum.at(least, (text, slot), h >> np.uint64(7))
    # an empty slot takes the value of the next one that is not empty, mixed with how far that is
    empty = least == np.iinfo(np.uint64).max
    own = np.where(empty, 0, np.arange(SLOTS))
    twice = np.concatenate([np.where(empty, 2 * SLOTS, np.arange(SLOTS)), np.where(empty, 2 * SLOTS, SLOTS + np.arange(SLOTS))], axis=1)
    following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    away = following - np.arange(SLOTS)
    own = following % SLOTS
    value = np.take_along_axis(least, own, axis=1)
    with np.errstate(over="ignore"):
        value = finish(value + away.astype(np.uint64) * _BASE)
    out[full] = (value & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def written_out(rows: np.ndarray) -> list[str]:
    """Fingerprints as lowercase hex."""
    return [r.astype(">u2").tobytes().hex() for r in rows]


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """Dice likeness of fingerprints, row by row; chance agreement is small with 16 bits and not corrected."""
    j = (a == b).mean(axis=1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), 2 * j / (1 + j))


def edited(text: str, following: str) -> str:
    """The last half of text, rounded down, replaced by as much of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least (key, mark) of each bucket, in order; as many as there are shuffle partitions, about.

    A key that stands in several of the shares has its buckets cut by its texts'
    hashes, so one doc_id (or null) in a third of all rows is spread as well.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.min("key").alias("lo"), F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 100_000).alias("cuts")).first()
    if found["lo"] is None:
        return np.zeros(1, np.int64), np.full(1, _NULL_KEY, np.int64)
    keys, times = np.unique(np.array([found["lo"], *(found["cuts"] or [])], np.int64), return_counts=True)
    marks = [[_NULL_KEY + (k << 64) // t for k in range(t)] for t in times.tolist()]
    return np.repeat(keys, times), np.array([m for each in marks for m in each], np.int64)


def _buckets(bounds: tuple[np.ndarray, np.ndarray], key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The bucket of each (key, mark)."""
    keys, marks = bounds
    lo, out = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right") - 1
    for a in np.unique(lo[out > lo]):  # keys with several buckets
        own = np.flatnonzero((lo == a) & (out > lo))
        z = np.searchsorted(keys, keys[a], "right")
        out[own] = a + np.searchsorted(marks[a:z], mark[own], "right") - 1
    return out


def with_successors(docs: DataFrame) -> DataFrame:
    """(bucket, ahead, key, mark, text), dealt by ranges of doc_id and text hash: each bucket ends with rows of which the least follows it (ahead = 1).

    The rows that may be a bucket's first go to the bucket before it too, one at
    most from each batch, and those of the first bucket to the last one.
    """
    slim = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = slim.select("key", F.xxhash64("text").alias("mark"), "text")
    bounds = _bounds(slim)
    last = len(bounds[0]) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, mark = b.column("key").to_numpy(), b.column("mark").to_numpy()
            bucket = _buckets(bounds, key, mark)
            head = []
            for k in np.unique(bucket):
                own = np.flatnonzero(bucket == k)
                own = own[key[own] == key[own].min()]
                own = own[mark[own] == mark[own].min()]
                head.append(min(own.tolist(), key=lambda r: b.column("text")[r].as_py()))
            head = np.array(head, np.int64)
            rest = pa.array(np.r_[np.arange(len(key)), head])
            into = np.r_[bucket, np.where(bucket[head] > 0, bucket[head] - 1, last)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(into), pa.array(np.r_[np.zeros(len(key)), np.ones(len(head))].astype(np.int32)), *(b.column(c).take(rest) for c in ("key", "mark", "text"))], ["bucket", "ahead", "key", "mark", "text"])

    dealt = rows.mapInArrow(tidy(deal), "bucket int, ahead int, key long, mark long, text string")
    return dealt.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "key", "mark", "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs(doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose successor is still to come
        done = False
        for b in text_slices(batches, limit=1 << 20):
            keys, ahead, texts = b.column("key").to_pylist(), b.column("ahead").to_pylist(), b.column("text").to_pylist()
            if done:
                continue
            if 1 in ahead:  # rows after the first one ahead repeat its id
                keep = ahead.index(1) + 1
                keys, ahead, texts, done = keys[:keep], ahead[:keep], texts[:keep], True
            prints = fingerprints(texts)
            if held is not None:
                keys, texts = [held[0], *keys], [held[1], *texts]
                prints = np.concatenate([held[2][None, :], prints])
            held = (keys[-1], texts[-1], prints[-1])
            if len(keys) < 2:
                continue
            changed = [edited(a, z) for a, z in zip(texts[:-1], texts[1:], strict=True)]
            other = fingerprints(changed)
            none = np.array([not t for t in texts])
            own = np.array(keys[:-1], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int64(), mask=own == _NULL_KEY),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                    pa.array(written_out(prints[:-1])),
                    pa.array(written_out(other)),
                    pa.array(likeness(prints[:-1], other, none[:-1], np.array([not c for c in changed]))),
                    pa.array(likeness(prints[:-1], prints[1:], none[:-1], none[1:])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs).select("key", "ahead", "text").mapInArrow(tidy(scan), kinds)
