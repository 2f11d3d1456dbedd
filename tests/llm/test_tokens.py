import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from solvane.llm import flat_tokens, packing, token_store
from solvane.llm.bpe import BpeEncoder
from solvane.llm.shared import working_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids(texts, as_text=False):
    """Ids by the plain library; with as_text, by one without special tokens."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = as_text
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


MARK = "<|endoftext|>"
MARKED = [(1, f"hello {MARK} world"), (2, MARK), (3, f"{MARK}{MARK} x\n{MARK}"), (4, "plain words <|endoftext |>"), (5, None), (6, f"a{MARK}b " * 40)]


def test_special_tokens_are_encoded_as_the_library_does(spark):
    texts = [t for _, t in MARKED]
    want = ids(texts)
    assert 50256 in want[0] and want[1] == [50256]
    assert [np.frombuffer(x, "<u4").tolist() for x in BpeEncoder(PATH).encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in BpeEncoder(PATH, as_text=True).encode(texts)] == ids(texts, as_text=True)
    docs = spark.createDataFrame(MARKED, "doc_id long, text string")
    folder = working_folder(spark, "t")
    stored = token_store.records(spark, folder, token_store.build_store(docs, folder, PATH, end_id=0), docs).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in stored} == {d: [*i, 0] for (d, _), i in zip(MARKED, want, strict=True)}
    pieces, _ = packing.pack(docs, PATH, end_id=2, size=16)
    cut = {}
    for r in pieces.orderBy("doc_id", "piece").collect():
        cut.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert cut == {d: [*i, 2] for (d, _), i in zip(MARKED, want, strict=True)}


def test_separator_scan_is_told_apart_from_special_tokens_in_texts(spark):
    docs = spark.createDataFrame(MARKED, "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in flat_tokens.token_counts(docs, PATH, 50256).collect()}
    assert got == {d: len(i) for (d, _), i in zip(MARKED, ids([t for _, t in MARKED], as_text=True), strict=True)}
    with pytest.raises(Exception, match="holds the separator"):
        flat_tokens.token_counts(docs, PATH, 50256, as_text=False)
    plain = docs.where("doc_id in (4, 5)")
    assert flat_tokens.token_counts(plain, PATH, 50256, as_text=False).count() == 2


def test_sums_find_what_a_search_of_all_combinations_finds():
    rng = random.Random(8)
    for _ in range(300):
        size = rng.randint(2, 24)
        counts = np.array([0] + [rng.choice([0, 0, 1, 2, 3]) for _ in range(size)])
        sums = packing._Sums(counts)
        for _ in range(6):
            gap, used = rng.randint(1, size), packing.Counter()
            there = np.flatnonzero(sums.left).tolist()
            if there:
                used[rng.choice(there)] += 1
            free = {x: int(sums.left[x]) - used[x] for x in there}
            ways = [w for k in (1, 2, 3) for w in itertools.combinations_with_replacement(sorted(free), k) if sum(w) == gap and all(w.count(x) <= free[x] for x in w)]
            got = sums.fill(gap, used)
            assert (got is None) == (not ways) and (got is None or tuple(sorted(got)) in ways and len(got) == min(map(len, ways)))
            for x in got or ():
                sums.left[x] -= 1


def test_memo_encodes_like_the_library():
    rng = random.Random(5)
    alphabet = ["a", " ", "\n", "\t", "b1", ".", "'s", "\xa0", "  ", "\x00", "é", "\r", "\x1c", "x", "<|endoftext|>", "́", "中", " ", "ǅ", ",", "!", "Word"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for e in (BpeEncoder(PATH, as_text=True), BpeEncoder(PATH)):
        assert e.encode(texts) == e.whole(texts)
    odd = [f"a{chr(c)}b {chr(c)}1{chr(c)}. {chr(c)}\n{chr(c)} {chr(c)}, x" for c in range(0x2100)]
    assert e.encode(odd) == e.whole(odd)
    assert e.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_separator_scan_counts_every_document(spark, odd, block):
    got = flat_tokens.token_counts(odd.repartition(3), PATH, 50256, block_tokens=block).collect()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, len(i)) for r, i in zip(odd.collect(), ids([r["text"] for r in odd.collect()], as_text=True), strict=True)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == want
    assert all(r["terminated"] for r in got)
    by_file = {}
    for r in sorted(got, key=lambda r: (r["file"], r["ordinal"])):
        assert r["start"] == by_file.get(r["file"], 0)
        by_file[r["file"]] = r["start"] + r["n_tokens"] + 1


def test_separator_scan_of_files_with_odd_ends(spark, tmp_path):
    for name, x in (("a", [9, 9, 0, 9]), ("b", [0, 0]), ("c", [5, 6, 7, 8, 9, 5, 6]), ("d", [])):
        (tmp_path / f"{name}.bin").write_bytes(np.array(x, "<u2").tobytes())
    for block in (1, 2, 3, 100):
        got = sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in flat_tokens.scan_separators(spark, f"file://{tmp_path}", 0, block_tokens=block).collect())
        assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 1, False), ("b.bin", 0, 0, 0, True), ("b.bin", 1, 1, 0, True), ("c.bin", 0, 0, 7, False)]


def test_empty_tables(spark, empty):
    assert flat_tokens.token_counts(empty, PATH, 0).count() == 0
    folder = working_folder(spark, "t")
    assert token_store.records(spark, folder, token_store.build_store(empty, folder, PATH), empty).count() == 0
    assert packing.pack(empty, PATH)[1].count() == 0


def test_perfect_hash_is_perfect():
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n)).view(np.uint64)
        h = token_store.PerfectHash.build(keys)
        assert sorted(h.slots(keys)) == list(range(len(keys)))
        again, size = token_store.PerfectHash.load(memoryview(h.dump()))
        assert (again.slots(keys) == h.slots(keys)).all() and size == len(h.dump())


def test_store_round_trip_and_keyed_access(spark, odd):
    folder = working_folder(spark, "t")
    catalogue = token_store.build_store(odd, folder, PATH, end_id=0)
    rows = token_store.records(spark, folder, catalogue, odd).collect()
    docs = odd.collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.array([*i, 0], "<u4").tobytes()) for r, i in zip(docs, ids([r["text"] for r in docs]), strict=True))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    some = spark.createDataFrame([(4,), (99,), (-5,), (None,)], "doc_id long")
    got = token_store.records(spark, folder, catalogue, some).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 4), (True, 0), (True, 0)]


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1025, 3000), rng.integers(1, 50, 5000), np.full(1000, 343), np.ones(3000, int), np.zeros(0, int), rng.integers(500, 1024, 500)):
        counts = np.bincount(lengths, minlength=1025)
        used = np.zeros(1025, int)
        sequences = 0
        for parts, n in packing.plan(counts):
            assert sum(a * b for a, b in parts) <= 1024
            for a, b in parts:
                used[a] += b * n
            sequences += n
        assert (used[1:] == counts[1:]).all()
        least = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()), -(-int((lengths == 343).sum()) // 2))
        assert sequences <= 1.005 * least + 2


def test_packing_is_gapless_and_keeps_all_ids(spark, odd):
    pieces, placed = packing.pack(odd, PATH, end_id=2, size=64)
    rows = placed.collect()
    docs = odd.collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    held = {(r["part"], r["length"], r["rank_in_part"]): bytes(r["ids"]) for r in pieces.collect()}
    assert len(held) == len(rows)
    want = sorted(np.array([*i, 2], "<u4").tobytes() for i in ids([r["text"] for r in docs]))
    single = [held[(r["part"], r["length"], r["rank_in_part"])] for r in rows if r["doc_id"] == 4]
    pieces4 = sorted(((r["piece"], held[(r["part"], r["length"], r["rank_in_part"])]) for r in rows if r["doc_id"] == 4))
    assert b"".join(x for _, x in pieces4) in want and len(single) == len(pieces4)
    assert all(len(x) == 256 for _, x in pieces4[1:])
    assert all(r["ids_crc32"] == zlib.crc32(held[(r["part"], r["length"], r["rank_in_part"])]) for r in rows)
    seqs = packing.sequences(pieces, placed)
    assert seqs.count() == len(by_seq) and sum(len(r["ids"]) for r in seqs.collect()) == sum(len(x) for x in want)
