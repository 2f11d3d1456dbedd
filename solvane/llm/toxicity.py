"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target (a person addressed or spoken of),
negation, reported speech, a near gap, a far gap.  Four small transducers read
the symbols of a clause: one drops negations over what follows nearby, one marks
what stands after a verb of reporting, one marks what is aimed at a target, one
sums up.  They are composed once into a single table, and the table runs over
all clauses of a batch side by side.  What it emits are matched clauses of
types such as "targeted insult" or "negated threat"; a text's features are its
clauses by type, weighted by the words' weights, and how densely they stand in
it; a small logistic model with weights learned from labels turns them into a
score.

The word lists below are a seed; words and word beginnings that set labelled
toxic texts apart join the insults with their log-odds as weights, which covers
other languages and inflected forms.  A word is judged among the texts that share
its vocabulary: texts are grouped by their frequent words, and what is frequent
in the toxic texts of one group only is not drowned by all other groups.  Words
are taken in up to a false-discovery rate.

Defined results: a null or empty text has no clauses and gets the base score;
without labels the seed words alone are used with the weights in ``PRIOR``;
repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.quality import sampled
from solvane.llm.shared import text_slices, tidy
from solvane.llm.wordhash import WORDS_AND_SIGNS, Tokens, prefix_hash, tokens

# Seed words of each class.
INSULTS = "idiot idiots moron morons stupid dumb loser losers clown scum trash worthless pathetic disgusting imbecile filth vermin idiota imbecil estupido estúpido basura escoria idiot idiote imbécile stupide ordure abruti crétin dumm dummkopf abschaum trottel versager".split()
THREATS = "kill hurt destroy beat stab burn matar morir tuer frapper brûler töten schlagen umbringen".split()
TARGETS = "you your you're u he she they them him her his their people tu te usted ustedes vous toi ton ils elles du dich dir ihr euch sie".split()
NEGATIONS = "not no never nobody isn't aren't don't nunca jamás ne pas jamais nicht kein keine nie".split()
REPORTS = "said says say told called calls wrote claimed reported quote dijo dice dit disait affirme sagte sagt schrieb".split()
CLAUSE_ENDS = ".!?;:"

#: Symbols read.
INSULT, THREAT, TARGET, NEGATION, REPORT, NEAR, FAR = range(7)
#: Words between two symbols from which on the gap is far.
FAR_WORDS = 4
#: Labelled rows, and bytes of their texts, that weights and words are learned from at most.
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 96 << 20
#: Frequent words that texts are grouped by, groups at most, and the likeness from which two groups are one.
GROUP_WORDS = 256
GROUPS = 8
GROUP_LIKENESS = 0.7
#: Texts of a group at least; smaller ones are no measure of what is frequent.
GROUP_TEXTS = 30
#: Words of one beginning in one text that count at most.
WORDS_A_TEXT = 3
#: Share of the learned words that may be there by chance.
FALSE_SHARE = 0.05
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
_SLICE = 1 << 20


@dataclass
class Transducer:
    """move[state, symbol] and out[state, symbol]; symbols it does not care about pass through unchanged."""

    move: np.ndarray
    out: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """Composition: other reads what self writes; states are pairs."""
        a, b = len(self.move), len(other.move)
        symbols = self.move.shape[1]
        move, out = np.zeros((a * b, symbols), np.int32), np.zeros((a * b, symbols), np.int32)
        for p in range(a):
            for q in range(b):
                for x in range(symbols):
                    y = self.out[p, x]
                    move[p * b + q, x] = self.move[p, x] * b + other.move[q, y]
                    out[p * b + q, x] = other.out[q, y]
        return Transducer(move, out)


#: Symbols written: a read symbol, or for insults and threats 7 + flags + 8 * (1 if a threat): 1 negated, 2 reported, 4 targeted.
_WRITTEN = 7 + 16


def _copying(states: int) -> Transducer:
    every = np.arange(_WRITTEN)
    return Transducer(np.repeat(np.arange(states)[:, None], _WRITTEN, 1), np.repeat(every[None, :], states, 0))


def _opening() -> Transducer:
    """Insults and threats become unmarked matches."""
    t = _copying(1)
    t.out[0, INSULT], t.out[0, THREAT] = 7, 15
    return t


def _flagging(on: int, off: int | None, flag: int) -> Transducer:
    """After ``on`` all matches get the flag, until ``off``."""
    t = _copying(2)
    t.move[:, on] = 1
    if off is not None:
        t.move[:, off] = 0
    for x in range(7, _WRITTEN):
        t.out[1, x] = 7 + ((x - 7) | flag)
    return t


def grammar() -> Transducer:
    """Matches, then negation (nearby), reported speech (the rest of the clause) and target (nearby), composed."""
    return _opening().then(_flagging(NEGATION, FAR, 1)).then(_flagging(REPORT, None, 2)).then(_flagging(TARGET, FAR, 4))


TYPES = 16
#: Weights for each clause type without labels: an insult or a threat counts, more so if aimed at someone, hardly if negated or reported.
PRIOR = np.array([(0.9 if not k & 8 else 0.6) * (1.5 if k & 4 else 1.0) * (0.2 if k & 1 else 1.0) * (0.4 if k & 2 else 1.0) for k in range(TYPES)])


def _hashes(words: list[str]) -> np.ndarray:
    t = tokens([w.lower() for w in words], WORDS_AND_SIGNS)
    return np.unique(t.hash[t.first[:-1]])


@dataclass
class Lexicon:
    """Sorted hashes of words (kind 0) and of beginnings (kind n: n bytes) that count as insults, with weights."""

    hashes: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]

    @classmethod
    def seed(cls) -> Lexicon:
        h = _hashes(INSULTS)
        return cls({0: h}, {0: np.ones(len(h))})

    def weigh(self, t: Tokens) -> np.ndarray:
        """The weight of each token as an insult, 0 if it is none."""
        out = np.zeros(len(t.hash))
        for kind, known in self.hashes.items():
            if len(known):
                h = t.hash if kind == 0 else prefix_hash(t, kind)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out = np.maximum(out, np.where((known[at] == h) & (t.kind == 1), self.weights[kind][at], 0.0))
        return out


_CLASSES = {THREAT: _hashes(THREATS), TARGET: _hashes(TARGETS), NEGATION: _hashes(NEGATIONS), REPORT: _hashes(REPORTS)}
_ENDS = _hashes(list(CLAUSE_ENDS))
_GRAMMAR = grammar()


def clause_features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """A row for each text: weighted matches of each clause type, as saturating sums."""
    t = tokens(texts, WORDS_AND_SIGNS)
    out = np.zeros((len(texts), TYPES))
    n = len(t.hash)
    if not n:
        return out
    weight = lexicon.weigh(t)
    symbol = np.full(n, -1, np.int8)
    for s, known in _CLASSES.items():
        at = np.minimum(np.searchsorted(known, t.hash), len(known) - 1)
        symbol[known[at] == t.hash] = s
    symbol[weight > 0] = INSULT
    weight[symbol == THREAT] = 1.0
    # a clause ends after a sign that ends it, and with its text
    sign = t.kind == 2
    end = sign & np.isin(t.raw[t.start], np.frombuffer(CLAUSE_ENDS.encode(), np.uint8))
    begin = np.r_[True, end[:-1]]
    begin[t.first[:-1][t.counts() > 0]] = True
    clause = np.cumsum(begin) - 1
    event = np.flatnonzero(symbol >= 0)
    # only clauses with a match matter
    matched = np.zeros(clause[-1] + 1, bool)
    matched[clause[event[symbol[event] <= THREAT]]] = True
    event = event[matched[clause[event]]]
    if not len(event):
        return out
    own = clause[event]
    new = np.r_[True, own[1:] != own[:-1]]
    gap = np.r_[0, np.diff(event)]
    starts = np.flatnonzero(new)
    left = np.diff(np.r_[starts, len(event)])
    state = np.zeros(len(starts), np.int32)
    emitted = np.zeros(len(event), np.int32)
    live, k = np.arange(len(starts)), 0
    while len(live):
        e = starts[live] + k
        s = state[live]
        if k:
            s = _GRAMMAR.move[s, np.where(gap[e] > FAR_WORDS, FAR, NEAR)]
        emitted[e] = _GRAMMAR.out[s, symbol[event[e]]]
        state[live] = _GRAMMAR.move[s, symbol[event[e]]]
        k += 1
        live = live[left[live] > k]
    hit = emitted >= 7
    row = t.texts()[event[hit]]
    np.add.at(out, (row, emitted[hit] - 7), weight[event[hit]])
    return np.log1p(out)


def _unique_keys(t: Tokens, k: int) -> dict[int, np.ndarray]:
    own = slice(t.first[k], t.first[k + 1])
    words = t.kind[own] == 1
    return {kind: np.unique(h[own][words & (h[own] != 0)]) for kind, h in [(0, t.hash), *((p, prefix_hash(t, p)) for p in PREFIXES)]}


def _one_of_each(texts: list[str]) -> list[str]:
    """Texts without those that begin or end like an earlier one: near copies are not evidence of their own."""
    seen: set[tuple[int, str]] = set()
    out = []
    for t in texts:
        keys = {(0, t[:60]), (1, t[-60:])}
        if seen.isdisjoint(keys):
            out.append(t)
        seen |= keys
    return out


def text_features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """The clause features, and the summed weight of all matches for each hundred words, which long texts do not reach by chance."""
    x = clause_features(texts, lexicon)
    words = tokens(texts, WORDS_AND_SIGNS).counts()
    return np.c_[x, np.log1p(100 * np.expm1(x).sum(axis=1) / np.maximum(words, 20))]


class _Words:
    """The different words of many texts: pairs (text, word), and the words' hashes and first bytes.

    Texts are tokenised once, in slices; what is held of a text is its different words.
    """

    def __init__(self, texts: list[str]):
        most = max(PREFIXES)
        docs, hashes, known, heads, sizes = [], [], [], [], []
        for a in range(0, len(texts), 500):
            t = tokens(texts[a : a + 500], WORDS_AND_SIGNS)
            word = np.flatnonzero(t.kind == 1)
            doc = t.texts()[word]
            order = np.lexsort((t.hash[word], doc))
            word, doc = word[order], doc[order]
            new = np.r_[True, (np.diff(t.hash[word]) != 0) | (np.diff(doc) != 0)] if len(word) else np.zeros(0, bool)
            docs.append((doc[new] + a).astype(np.int32))
            hashes.append(t.hash[word[new]])
            own, first = np.unique(t.hash[word], return_index=True)
            first = word[first]
            at = t.start[first][:, None] + np.arange(most)
            inside = np.arange(most) < t.size[first][:, None]
            known.append(own)
            heads.append(np.where(inside, t.low[np.where(inside, at, 0)], 0).astype(np.uint8) if len(own) else np.zeros((0, most), np.uint8))
            sizes.append(np.minimum(t.size[first], most))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.texts = len(texts)
        self.hash, first = np.unique(join(known, np.uint64), return_index=True)
        low = np.concatenate([np.zeros((0, most), np.uint8), *heads])[first].ravel()
        n = len(self.hash)
        self._table = Tokens(low, low, np.arange(n) * most, join(sizes, np.int64)[first], np.ones(n, np.uint8), self.hash, np.array([0, n]))
        self.doc, self.word = join(docs, np.int32), np.searchsorted(self.hash, join(hashes, np.uint64)).astype(np.int32)

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, text, index of the key, different words of the text that have it): words for kind 0, beginnings of kind bytes."""
        if kind == 0:
            return self.hash, self.doc, self.word, np.ones(len(self.doc), np.int64)
        keys, of = np.unique(prefix_hash(self._table, kind), return_inverse=True)
        own = of[self.word]
        ok = keys[own] != 0 if len(keys) else np.zeros(0, bool)
        both, n = np.unique(self.doc[ok].astype(np.int64) * max(1, len(keys)) + own[ok], return_counts=True)
        return keys, both // max(1, len(keys)), both % max(1, len(keys)), n


def vocabulary_groups(words: _Words) -> np.ndarray:
    """A number for each text: texts that use the same frequent words are in one group, such as those of one language."""
    if not words.texts:
        return np.zeros(0, np.int64)
    count = np.bincount(words.word, minlength=len(words.hash))
    top = np.lexsort((words.hash, -count))[:GROUP_WORDS]
    column = np.full(len(words.hash) + 1, -1)
    column[np.sort(top)] = np.arange(len(top))
    at = column[words.word]
    x = np.zeros((words.texts, max(1, len(top))), np.float32)
    x[words.doc[at >= 0], at[at >= 0]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    # centres as far apart as can be, then moved to the middle of their texts
    centre = [x.sum(axis=0)]
    for _ in range(GROUPS - 1):
        near = (x @ (np.stack(centre) / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)).T).max(axis=1)
        near[~x.any(axis=1)] = 1
        centre.append(x[int(near.argmin())])
    c = np.stack(centre)
    for _ in range(20):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == k].sum(axis=0) for k in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    name = np.arange(len(c))
    for k in range(len(c)):
        for j in range(k):
            if c[k] @ c[j] >= GROUP_LIKENESS:
                name[name == name[k]] = name[j]
    return name[own]


def _discoveries(p: np.ndarray, tests: int, share: float) -> np.ndarray:
    """Which of the p values are taken in, so that the expected share of chance ones among them is not above share."""
    order = np.argsort(p, kind="stable")
    ok = np.flatnonzero(p[order] <= share * np.arange(1, len(p) + 1) / max(1, tests))
    out = np.zeros(len(p), bool)
    out[order[: ok[-1] + 1 if len(ok) else 0]] = True
    return out


def induce(toxic: list[str], other: list[str], least: int = 2, odds: float = 2.0, false_share: float = FALSE_SHARE) -> Lexicon:
    """The seed and all words and beginnings that are far more frequent in toxic texts than in others of their group.

    least is the least number of toxic texts, odds the least log-odds of the two
    frequencies among all different words of the texts; false_share bounds the
    share of chance words, by the likelihood ratio statistic of the frequencies.
    """
    toxic, other = _one_of_each(toxic), _one_of_each(other)
    words = _Words(toxic + other)
    group, bad = vocabulary_groups(words), np.arange(words.texts) < len(toxic)
    large = [g for g, n in zip(*np.unique(group, return_counts=True), strict=True) if n >= GROUP_TEXTS]
    scopes = [np.ones(words.texts, bool), *([group == g for g in large] if len(large) > 1 else [])]
    own_words = np.bincount(words.doc, minlength=words.texts)
    found: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in scopes]
    for kind in (0, *PREFIXES):
        keys, doc, key, n = words.keys(kind)
        n = np.minimum(n, WORDS_A_TEXT)
        if not len(keys):
            continue
        tally = lambda rows: np.bincount(key[rows], n[rows], len(keys))  # noqa: B023, E731
        # a word counts wherever it stands, so it must not be an ordinary one among all texts
        at_large = np.log((tally(bad[doc]) + 0.5) / (1 + own_words[bad].sum())) - np.log((tally(~bad[doc]) + 0.5) / (1 + own_words[~bad].sum()))
        for k, inside in enumerate(scopes):
            toxic_rows = (inside & bad)[doc]
            ok = np.flatnonzero(np.bincount(key[toxic_rows], minlength=len(keys)) >= least)
            a, b = tally(toxic_rows)[ok], tally((inside & ~bad)[doc])[ok]
            all_bad, all_good = 1 + own_words[inside & bad].sum(), 1 + own_words[inside & ~bad].sum()
            log_odds = np.log((a + 0.5) / all_bad) - np.log((b + 0.5) / all_good)
            expected = (a + b) * all_bad / (all_bad + all_good)
            ratio = 2 * (a * np.log(a / expected) + np.where(b > 0, b * np.log(np.maximum(b, 1e-9) / np.maximum(a + b - expected, 1e-9)), 0.0))
            found[k].append((kind, keys[ok], log_odds, np.where((log_odds >= odds) & (at_large[ok] >= odds / 2), ratio, 0.0)))
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {kind: (np.zeros(0, np.uint64), np.zeros(0)) for kind in (0, *PREFIXES)}
    for rows in found:
        ratio = np.concatenate([np.zeros(0), *(r for *_, r in rows)])
        p = np.array([math.erfc(math.sqrt(max(x, 0.0) / 2)) for x in ratio])
        taken = _discoveries(p, len(p), false_share) & (ratio > 0)
        at = 0
        for kind, known, log_odds, r in rows:
            own = taken[at : at + len(r)]
            at += len(r)
            best[kind] = (np.r_[best[kind][0], known[own]], np.r_[best[kind][1], np.minimum(log_odds[own], 6.0) / 3.0])
    seed = Lexicon.seed()
    hashes, weights = {}, {}
    for kind, (h, w) in best.items():
        if kind == 0:
            h, w = np.r_[h, seed.hashes[0]], np.r_[w, np.where(np.isin(seed.hashes[0], h), 0.0, seed.weights[0])]
        order = np.lexsort((-w, h))
        h, w = h[order], w[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        hashes[kind], weights[kind] = h[first], w[first]
    return Lexicon(hashes, weights)


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.5, steps: int = 60) -> np.ndarray:
    """Weights and an intercept (last), Newton steps, drawn to the prior."""
    x = np.c_[x, np.ones(len(x))]
    mean = np.r_[prior, -3.0]
    pull = np.r_[np.full(len(prior), strength), 1e-3]

    def loss(w: np.ndarray) -> float:
        m = np.clip(x @ w, -500, 500)
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * (pull * (w - mean) ** 2).sum())

    w = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - mean))
        # the loss is convex: a step that is too long is halved until it goes down
        now, size = loss(w), 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = text_features(texts, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def learn(texts: list[str | None], labels: list[int]) -> Model:
    """A model of labelled texts: words from three quarters of them, clause weights from the rest (from all, if these are few)."""
    toxic = np.array(labels) == 1
    if not toxic.any():
        return Model(Lexicon.seed(), np.r_[PRIOR * 2, 0.0, -3.0])
    held = np.arange(len(texts)) % 4 == 3
    few = toxic[held].sum() < 40
    pick = lambda m: [texts[k] or "" for k in np.flatnonzero(m)]
    lexicon = induce(pick(toxic & (few | ~held)), pick(~toxic & (few | ~held)))
    rows = np.flatnonzero(np.ones(len(texts), bool) if few else held)
    x = np.concatenate([text_features([texts[k] for k in rows[a : a + 300]], lexicon) for a in range(0, len(rows), 300)])
    return Model(lexicon, _logistic(x, toxic[rows].astype(float), np.r_[PRIOR * 2, 0.0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, leave_fold: int | None = 2) -> Model:
    """Learns from at most ``rows`` labelled rows and SAMPLE_BYTES of text in one task; the model comes to the driver as one row."""
    import pickle

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys, size = [], [], 0
        for b in text_slices(batches, limit=_SLICE):
            size += b.column("text").nbytes
            if size > SAMPLE_BYTES and texts:
                break
            texts += b.column("text").to_pylist()
            ys += b.column("label").to_pylist()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(learn(texts, ys))], pa.binary())})

    sample = sampled(docs, labels, label, rows, leave_fold).repartition(1).sortWithinPartitions("mark", "text")
    made = sample.mapInArrow(tidy(train), "model binary").first()
    return pickle.loads(made["model"]) if made else learn([], [])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1; all other columns stay."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = share.value
        for b in text_slices(batches, limit=_SLICE):
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(own.score(b.column("text").to_pylist()))], [*(f.name for f in kept), column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(tidy(scored), f"{kinds}, `{column}` double")
