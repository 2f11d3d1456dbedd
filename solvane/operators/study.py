"""Design studies: constrained Pareto ranking, hypervolume, sensitivity, optimiser, scenarios, workspaces."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.core import InvalidInput, large, require_none, require_unique
from solvane.functions.sampling import splitmix
from solvane.operators.graphs import _cut
from solvane.operators.ordering import average_ranks

EPSILON = 1e-12
#: Solutions whose objectives are held by each task, to rank them all at once; larger studies are ranked by joins, round by round.
MOST_SOLUTIONS = 50_000
#: Solutions with two objectives that one task ranks by sweeps at most.
MOST_SWEPT = 5_000_000


def violation(residuals: list[str]) -> Column:
    """The sum of positive residuals."""
    out = F.lit(0.0)
    for r in residuals:
        out = out + F.greatest(F.col(r), F.lit(0.0))
    return out


def _costs(rows: DataFrame, objectives: dict[str, str]) -> DataFrame:
    """rows with o0, o1, ...: the objectives, all to be minimised."""
    return rows.select("*", *[(-F.col(c) if way == "max" else F.col(c)).alias(f"o{k}") for k, (c, way) in enumerate(objectives.items())])


def _dominates(n: int, a: str = "a", b: str = "b") -> Column:
    """Whether a's costs are nowhere worse and somewhere better."""
    no_worse, better = F.lit(True), F.lit(False)
    for k in range(n):
        x, y = F.col(f"{a}.o{k}"), F.col(f"{b}.o{k}")
        no_worse = no_worse & (x <= y + EPSILON)
        better = better | (x < y - EPSILON)
    return no_worse & better


class Steps:
    """Members of a front in the order of their first costs: where the least second cost goes down."""

    __slots__ = ("x", "y")

    def __init__(self) -> None:
        self.x: list[float] = []
        self.y: list[float] = []

    def beats(self, a: float, b: float) -> bool:
        """Whether some member dominates (a, b), which comes after all of them."""
        y = self.y
        if not y or y[-1] > b + EPSILON or a != a or b != b:
            return False
        if y[-1] < b - EPSILON:
            return True
        k = len(y) - 1  # equal second costs: the first member that has them has the least first cost
        while k and y[k - 1] <= b + EPSILON:
            k -= 1
        return self.x[k] < a - EPSILON

    def add(self, a: float, b: float) -> None:
        if a == a and b == b and (not self.y or b < self.y[-1]):
            self.x.append(a)
            self.y.append(b)


def pareto_front(rows: DataFrame, objectives: dict[str, str], residuals: list[str] | None = None) -> DataFrame:
    """Rows that no other row dominates; feasible rows only, if there is one.

    A row is dominated by some row exactly if it is by one that nothing
    dominates, so tasks first drop what is dominated inside themselves, and only
    the few that are left meet each other; with two objectives, in one sweep.
    """
    n = len(objectives)
    named = _costs(rows.withColumn("violation", violation(residuals or [])), objectives)
    least = named.agg(F.min("violation").alias("v")).first()["v"]
    if least is None:
        return rows.withColumn("violation", F.lit(0.0)).where("false")
    pool = named.where(F.col("violation") <= (0.0 if least <= 0 else least + EPSILON))
    cols = [f"o{k}" for k in range(n)]

    def local(batches):
        kept = None
        for b in batches:
            every = b if kept is None else pd.concat([kept, b], ignore_index=True)
            every = every.sort_values(cols, kind="stable").reset_index(drop=True)
            c = every[cols].to_numpy()
            front: list[int] = []
            if n == 2:
                steps = Steps()
                for i, (x, y) in enumerate(c.tolist()):
                    if not steps.beats(x, y):
                        steps.add(x, y)
                        front.append(i)
                kept = every.iloc[front]
                continue
            for i in range(len(c)):
                f = c[front]
                if not len(f) or not ((f <= c[i] + EPSILON).all(1) & (f < c[i] - EPSILON).any(1)).any():
                    front.append(i)
            kept = every.iloc[front]
        if kept is not None:
            yield kept

    few = _cut(pool.mapInPandas(local, pool.schema))
    if n == 2:
        return few.repartition(1).mapInPandas(local, pool.schema).drop(*cols)
    beaten = few.alias("b").join(few.alias("a"), _dominates(n), "left_anti")
    return beaten.drop(*cols)


def front_ranks(costs: np.ndarray) -> np.ndarray:
    """The front of each row: taken in lexicographic order, a row joins the first front of which no member dominates it."""
    out = np.zeros(len(costs), np.int64)
    fronts: list[np.ndarray] = []
    sizes: list[int] = []
    for i in np.lexsort(costs.T[::-1]) if len(costs) else ():
        c = costs[i]
        lo, hi = 0, len(fronts)
        while lo < hi:  # a row that some front dominates is dominated by all fronts before that
            mid = (lo + hi) // 2
            f = fronts[mid][: sizes[mid]]
            if ((f <= c + EPSILON).all(1) & (f < c - EPSILON).any(1)).any():
                lo = mid + 1
            else:
                hi = mid
        if lo == len(fronts):
            fronts.append(np.empty((8, costs.shape[1])))
            sizes.append(0)
        if sizes[lo] == len(fronts[lo]):
            fronts[lo] = np.concatenate([fronts[lo], np.empty_like(fronts[lo])])
        fronts[lo][sizes[lo]] = c
        sizes[lo] += 1
        out[i] = lo
    return out


def swept_ranks(costs: np.ndarray) -> np.ndarray:
    """``front_ranks`` of two costs: of a front only the steps of its second costs are looked at."""
    out = np.zeros(len(costs), np.int64)
    fronts: list[Steps] = []
    order = np.lexsort(costs.T[::-1])
    for i, (a, b) in zip(order.tolist(), costs[order].tolist(), strict=True):
        lo, hi = 0, len(fronts)
        while lo < hi:
            mid = (lo + hi) // 2
            if fronts[mid].beats(a, b):
                lo = mid + 1
            else:
                hi = mid
        if lo == len(fronts):
            fronts.append(Steps())
        fronts[lo].add(a, b)
        out[i] = lo
    return out


def _prefix_counts(values: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each of queries (ends, limits): how many of the first ``end`` values, a permutation of 0 ... n - 1, are below ``limit``; by bits from the highest."""
    ends = [(np.zeros_like(e), e.copy(), np.zeros_like(e)) for e, _ in queries]
    for bit in range(len(values).bit_length() - 1, -1, -1):
        one = (values >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        for k, (low, high, n) in enumerate(ends):
            up = (queries[k][1] >> bit & 1).astype(bool)
            a, b = zeros[low], zeros[high]
            n += np.where(up, b - a, 0)
            ends[k] = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - b, b), n
        values = np.concatenate([values[~one], values[one]])
    return [n for _, _, n in ends]


def swept_counts(costs: np.ndarray) -> np.ndarray:
    """By how many rows of two costs each is dominated: no worse in both, less those that are better in none."""
    known = costs[~np.isnan(costs).any(1)]
    by = np.argsort(known[:, 0], kind="stable")
    first, second = known[by, 0], np.sort(known[:, 1])
    values = np.empty(len(known), np.int64)
    values[np.argsort(known[by, 1], kind="stable")] = np.arange(len(known))
    x, y = (lambda c: np.searchsorted(first, c, "right")), (lambda c: np.searchsorted(second, c, "right"))
    below = lambda sorted_, c: np.searchsorted(sorted_, c - EPSILON, "left")
    some = ~np.isnan(costs).any(1)
    a, b = costs[some, 0], costs[some, 1]
    better_x, better_y = below(first, a), below(second, b)
    one, two, both = _prefix_counts(values, [(better_x, y(b + EPSILON)), (x(a + EPSILON), better_y), (better_x, better_y)])
    out = np.zeros(len(costs), np.int64)
    out[some] = one + two - both
    return out


def _ranked_by_sweep(named: DataFrame, cols: list[str], key: str) -> DataFrame:
    """named with rank and dominated_count, for two objectives: one task sorts and sweeps keys and costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if not every:
            return
        held = pa.Table.from_batches(every)
        ok, bad = (held.column(c).to_numpy() for c in ("feasible", "violation"))
        costs = np.stack([held.column(c).to_numpy().astype(float) for c in cols], axis=1)[ok]
        rank, n = np.zeros(len(ok), np.int64), np.zeros(len(ok), np.int64)
        rank[ok], n[ok] = swept_ranks(costs), swept_counts(costs)
        rank[~ok] = (int(rank[ok].max()) + 1 if ok.any() else 0) + np.unique(bad[~ok], return_inverse=True)[1]
        n[~ok] = len(costs) + np.searchsorted(np.sort(bad[~ok]), bad[~ok] - EPSILON, "left")
        out = pa.table({key: held.column(key), "dominated_count": pa.array(n), "rank": pa.array(rank.astype(np.int32))})
        yield from out.to_batches(max_chunksize=100_000)

    kind = named.schema[key].dataType.simpleString()
    found = named.select(key, "feasible", "violation", *cols).repartition(1).mapInArrow(run, f"`{key}` {kind}, dominated_count long, rank int")
    return named.join(large(found), key)


def _ranked_at_once(named: DataFrame, cols: list[str], key: str) -> DataFrame:
    """named with rank and dominated_count; all costs, of a bounded number, are held by each task."""
    held = named.select(key, "feasible", "violation", *cols).toArrow()
    order = np.argsort(held.column(key).to_numpy(), kind="stable")
    ids, ok, bad = (held.column(c).to_numpy()[order] for c in (key, "feasible", "violation"))
    costs = np.stack([held.column(c).to_numpy()[order].astype(float) for c in cols], axis=1)
    rank = np.zeros(len(ids), np.int64)
    rank[ok] = front_ranks(costs[ok])
    # infeasible rows follow the last front, equal violations share a rank
    rank[~ok] = (int(rank[ok].max()) + 1 if ok.any() else 0) + np.unique(bad[~ok], return_inverse=True)[1]
    share = named.sparkSession.sparkContext.broadcast((ids, costs[ok], np.sort(bad[~ok]), rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, good, worse, rank = share.value
        for b in batches:
            num = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False)
            own, fine = np.stack([num(c).astype(float) for c in cols], axis=1), num("feasible")
            n = np.where(fine, 0, len(good) + np.searchsorted(worse, num("violation") - EPSILON, "left"))
            for k in np.flatnonzero(fine):
                n[k] = np.count_nonzero((good <= own[k] + EPSILON).all(1) & (good < own[k] - EPSILON).any(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int64)), pa.array(rank[np.searchsorted(ids, num(key))].astype(np.int32))], [*b.schema.names, "dominated_count", "rank"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    return named.repartition(key).mapInArrow(run, f"{kinds}, dominated_count long, rank int")


def _ranked_by_rounds(named: DataFrame, cols: list[str], key: str) -> DataFrame:
    """named with rank and dominated_count: the dominance relation is a self-join, fronts are peeled from it round by round."""
    n = len(cols)
    a, b = named.alias("a"), named.alias("b")
    both = F.col("a.feasible") & F.col("b.feasible") & _dominates(n)
    better = (F.col("a.feasible") & ~F.col("b.feasible")) | (~F.col("a.feasible") & ~F.col("b.feasible") & (F.col("a.violation") < F.col("b.violation") - EPSILON))
    counted = named.join(a.join(b, both | better).groupBy(F.col(f"b.{key}").alias(key)).agg(F.count(F.lit(1)).alias("dominated_count")), key, "left").na.fill(0, ["dominated_count"])
    counted = _cut(counted)
    ranked = None
    left, rank = _cut(counted.where("feasible").select(key, *cols)), 0
    while not left.isEmpty():
        x, y = left.alias("a"), left.alias("b")
        front = _cut(y.join(x, _dominates(n), "left_anti").withColumn("rank", F.lit(rank)))
        ranked = front if ranked is None else ranked.unionByName(front)
        left = _cut(left.join(front.select(key), key, "left_anti"))
        rank += 1
    bad = counted.where("not feasible").select(key, "violation").withColumn("rank", (F.dense_rank().over(Window.orderBy("violation")) - 1 + rank).cast("int"))
    ranks = bad.select(key, "rank")
    return counted.join(ranks.unionByName(ranked.select(key, "rank")) if ranked is not None else ranks, key)


def rank_study(rows: DataFrame, objectives: dict[str, str], residuals: list[str] | None = None, key: str = "candidate_id", at_once: int = MOST_SOLUTIONS, swept: int = MOST_SWEPT) -> DataFrame:
    """rows with violation, feasible, rank, dominated_count and crowding (null at the ends of a front).

    Feasible rows come before others; these go by their summed violation;
    feasible ones by fronts.  Up to ``at_once`` rows are ranked together, up to
    ``swept`` rows of two objectives by a sweep in one task, more of them round
    by round, with the same result.
    """
    named = _cut(_costs(rows.withColumn("violation", violation(residuals or [])).withColumn("feasible", F.col("violation") <= EPSILON), objectives))
    cols = [f"o{k}" for k in range(len(objectives))]
    require_unique(named, key)
    total = named.count()
    way = _ranked_at_once if total <= at_once else _ranked_by_sweep if len(cols) == 2 and total <= swept else _ranked_by_rounds
    out = _cut(way(named, cols, key))
    return out.join(crowding(out.select(key, "rank", "feasible", *cols), cols, key), key).drop(*cols)


def crowding(ranked: DataFrame, objectives: list[str], key: str = "candidate_id") -> DataFrame:
    """(key, crowding): summed normalised gaps to a row's neighbours in its front; null (endless) at ends and in fronts of two."""
    out = ranked
    total, ends = F.lit(0.0), F.lit(False)
    for k, o in enumerate(objectives):
        by = Window.partitionBy("rank").orderBy(o, key)
        whole = Window.partitionBy("rank")
        out = out.withColumn(f"p{k}", F.lag(o).over(by)).withColumn(f"n{k}", F.lead(o).over(by)).withColumn(f"s{k}", F.max(o).over(whole) - F.min(o).over(whole))
        flat = F.col(f"s{k}") <= EPSILON
        total = total + F.when(flat, 0.0).otherwise((F.col(f"n{k}") - F.col(f"p{k}")) / F.when(~flat, F.col(f"s{k}")))
        ends = ends | (~flat & (F.col(f"p{k}").isNull() | F.col(f"n{k}").isNull()))
    out = out.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("rank")))
    return out.select(key, F.when((F.col("size") > 2) & ~ends, total).alias("crowding"))


def hypervolume_2d(front: DataFrame, x: str, y: str, reference: tuple[float, float]) -> DataFrame:
    """One row: the area that costs (x, y) cover below a reference point."""
    inside = front.where((F.col(x) < reference[0]) & (F.col(y) < reference[1])).select(F.col(x).alias("x"), F.col(y).alias("y"))
    by = Window.partitionBy(F.lit(0)).orderBy("x", "y")
    low = F.min("y").over(by.rowsBetween(Window.unboundedPreceding, -1))
    steps = inside.withColumn("top", F.coalesce(low, F.lit(float(reference[1])))).where("y < top")
    return steps.agg(F.coalesce(F.sum((reference[0] - F.col("x")) * (F.col("top") - F.col("y"))), F.lit(0.0)).alias("hypervolume"))


def spearman(rows: DataFrame, parameters: list[str], objectives: list[str]) -> DataFrame:
    """(parameter, objective, rho): rank correlations, 0 where a side does not vary."""
    every = [*parameters, *objectives]
    ranked = average_ranks(rows, every)
    n = F.count(F.lit(1))
    # ranks are halves of integers: their moments are exact sums
    sums = ranked.agg(n.alias("n"), *[F.sum(f"r_{c}").alias(f"s_{c}") for c in every], *[F.sum(F.col(f"r_{c}") * F.col(f"r_{c}")).alias(f"q_{c}") for c in every], *[F.sum(F.col(f"r_{p}") * F.col(f"r_{o}")).alias(f"x_{p}_{o}") for p in parameters for o in objectives])
    var = lambda c: F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("n")
    each = []
    for p in parameters:
        for o in objectives:
            den = var(p) * var(o)
            rho = F.when(den > EPSILON, (F.col(f"x_{p}_{o}") - F.col(f"s_{p}") * F.col(f"s_{o}") / F.col("n")) / F.sqrt(den)).otherwise(0.0)
            each.append(F.struct(F.lit(p).alias("parameter"), F.lit(o).alias("objective"), rho.alias("rho")))
    return sums.select(F.inline(F.array(*each)))


def _draws(seed: int | np.ndarray, n: int) -> np.ndarray:
    """n numbers in [0, 1) of the counter-based generator, a row for each seed if there are several; draw k hangs on (seed, k) alone."""
    with np.errstate(over="ignore"):
        first = seed.astype(np.uint64)[:, None] if isinstance(seed, np.ndarray) else np.uint64(seed & (2**64 - 1))
        x = first + (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _rho(x: np.ndarray, y: np.ndarray) -> float:
    a, b = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    va, vb = a.var(), b.var()
    return float(((a - a.mean()) * (b - b.mean())).mean() / math.sqrt(va * vb)) if va * vb > EPSILON else 0.0


def statistical_sensitivity(rows: DataFrame, parameters: list[str], objectives: list[str], bootstrap: int = 1000, permutations: int = 1000, confidence: float = 0.95, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Rank correlations with bootstrap limits, permutation p values and their Holm correction, a row for each pair.

    Replicates of all pairs are spread over tasks; a study's rows (2,000,000 at
    most) are broadcast.
    """
    data = rows.select(*parameters, *objectives).limit(2_000_001).toPandas()
    if len(data) > 2_000_000:
        raise InvalidInput("more than 2,000,000 rows")
    # replicates pick rows by number, so the numbers must not hang on how rows came in
    data = data.sort_values([*parameters, *objectives], kind="stable", ignore_index=True)
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast(data)
    pairs = [(k, p, o) for k, (p, o) in enumerate((p, o) for p in parameters for o in objectives)]
    block = 100
    tasks = [(k, p, o, kind, at, min(block, total - at)) for k, p, o in pairs for kind, total in (("bootstrap", bootstrap), ("permutation", permutations)) for at in range(0, total, block)]

    def run(batches):
        d = share.value
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, y = d[r.parameter].to_numpy(), d[r.objective].to_numpy()
                n = len(x)
                for k in range(r.first, r.first + r.n):
                    u = _draws(seed + 7919 * r.pair + 104729 * k + (1 if r.kind == "bootstrap" else 2), n)
                    if r.kind == "bootstrap":
                        i = (u * n).astype(int)
                        out.append((r.pair, r.kind, _rho(x[i], y[i])))
                    else:
                        out.append((r.pair, r.kind, _rho(x, y[np.argsort(u, kind="stable")])))
            yield pd.DataFrame(out, columns=["pair", "kind", "rho"])

    made = spark.createDataFrame(tasks, "pair int, parameter string, objective string, kind string, first int, n int").repartition(min(200, max(1, len(tasks))), "pair", "first", "kind").mapInPandas(run, "pair int, kind string, rho double")
    real = spearman(rows, parameters, objectives).join(spark.createDataFrame(pairs, "pair int, parameter string, objective string"), ["parameter", "objective"])
    every = made.join(F.broadcast(real.select("pair", F.col("rho").alias("real"))), "pair")
    tail = (1 - confidence) / 2
    sorted_b = F.array_sort(F.collect_list(F.when(F.col("kind") == "bootstrap", F.col("rho"))))
    stats = every.groupBy("pair").agg(sorted_b.alias("b"), F.count_if((F.col("kind") == "permutation") & (F.abs("rho") >= F.abs("real") - EPSILON)).alias("extreme"))
    low, high = int(math.floor(tail * (bootstrap - 1))), int(math.ceil((1 - tail) * (bootstrap - 1)))
    out = real.join(stats, "pair").select("parameter", "objective", "rho", F.element_at("b", low + 1).alias("low"), F.element_at("b", high + 1).alias("high"), ((F.col("extreme") + 1) / (permutations + 1)).alias("p"))
    return holm(out, "p", ["parameter", "objective"], alpha)


def holm(rows: DataFrame, p: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """rows with p_holm and significant: step-down correction, a running maximum."""
    by = Window.partitionBy(F.lit(0)).orderBy(p, *keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    step = rows.withColumn("w_step", F.least(F.col(p) * (n - F.row_number().over(by) + 1), F.lit(1.0)))
    out = step.withColumn("p_holm", F.max("w_step").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("w_step")
    return out.withColumn("significant", F.col("p_holm") <= alpha)


# Optimiser: a small stateful loop on the driver; evaluation is the distributed job.


class Stream:
    """The counter-based generator with its exact place, for resuming."""

    def __init__(self, seed: int, at: int = 0):
        self.seed, self.at = seed, at

    def unit(self) -> float:
        self.at += 1
        return (splitmix((self.seed + (self.at - 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 11) / float(1 << 53)

    def index(self, n: int) -> int:
        self.at += 1
        return splitmix((self.seed + (self.at - 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)) % n


@dataclass
class Variable:
    name: str
    low: float
    high: float
    kind: str = "continuous"  #: continuous, integer or categorical


@dataclass
class Optimizer:
    """Ask and tell: stratified start, tournaments, simulated binary crossover, polynomial mutation, elitist survival."""

    variables: list[Variable]
    directions: list[str]
    population: int = 64
    offspring: int = 64
    archive_size: int = 256
    seed: int = 42
    crossover: float = 0.9
    mutation: float | None = None
    eta_crossover: float = 15.0
    eta_mutation: float = 20.0
    generation: int = 0
    next_id: int = 1
    at: int = 0
    members: list[dict] = field(default_factory=list)
    archive: list[dict] = field(default_factory=list)

    def _fit(self, v: Variable, x: float) -> float:
        x = min(max(x, v.low), v.high)
        return x if v.kind == "continuous" else float(round(x))

    def ask(self) -> pd.DataFrame:
        """Candidates to evaluate: (candidate_id, generation, values)."""
        s = Stream(self.seed, self.at)
        n = len(self.variables)
        if not self.members:
            cols = []
            for v in self.variables:
                order = list(range(self.population))
                for k in range(self.population - 1, 0, -1):
                    j = s.index(k + 1)
                    order[k], order[j] = order[j], order[k]
                cols.append([self._fit(v, v.low + (v.high - v.low) * (k + s.unit()) / self.population) for k in order])
            values = [list(x) for x in zip(*cols, strict=True)]
        else:
            rate = self.mutation if self.mutation is not None else 1 / n
            pick = lambda: min((self.members[s.index(len(self.members))] for _ in range(2)), key=self._order)
            values = []
            while len(values) < self.offspring:
                a, b = list(pick()["values"]), list(pick()["values"])
                if s.unit() < self.crossover:
                    for k, v in enumerate(self.variables):
                        u = s.unit()
                        if v.kind == "categorical":
                            if u < 0.5:
                                a[k], b[k] = b[k], a[k]
                            continue
                        beta = (2 * u) ** (1 / (self.eta_crossover + 1)) if u <= 0.5 else (1 / (2 * (1 - u))) ** (1 / (self.eta_crossover + 1))
                        a[k], b[k] = 0.5 * ((1 + beta) * a[k] + (1 - beta) * b[k]), 0.5 * ((1 - beta) * a[k] + (1 + beta) * b[k])
                for child in (a, b):
                    for k, v in enumerate(self.variables):
                        if s.unit() < rate:
                            if v.kind == "categorical":
                                child[k] = v.low + s.index(int(v.high - v.low) + 1)
                            else:
                                u = s.unit()
                                delta = (2 * u) ** (1 / (self.eta_mutation + 1)) - 1 if u < 0.5 else 1 - (2 * (1 - u)) ** (1 / (self.eta_mutation + 1))
                                child[k] += delta * (v.high - v.low)
                    values.append([self._fit(v, x) for v, x in zip(self.variables, child, strict=True)])
            values = values[: self.offspring]
        self.at = s.at
        out = pd.DataFrame({"candidate_id": range(self.next_id, self.next_id + len(values)), "generation": self.generation, "values": values})
        self.next_id += len(values)
        return out

    @staticmethod
    def _order(m: dict) -> tuple:
        return m["rank"], -m["crowding"], m["id"]

    def _ranked(self, rows: list[dict]) -> list[dict]:
        sign = [-1 if d == "max" else 1 for d in self.directions]
        costs = np.array([[s * x for s, x in zip(sign, r["objectives"], strict=True)] for r in rows], float)
        viol = np.array([r["violation"] for r in rows])
        left, rank = set(np.flatnonzero(viol <= EPSILON).tolist()), 0
        while left:
            i = np.array(sorted(left))
            c = costs[i]
            front = [k for n, k in enumerate(i) if not ((c <= c[n] + EPSILON).all(1) & (c < c[n] - EPSILON).any(1)).any()]
            crowd = np.zeros(len(front))
            for o in range(costs.shape[1]):
                v = costs[front, o]
                span = v.max() - v.min()
                order = np.lexsort(([rows[k]["id"] for k in front], v))
                if span > EPSILON:
                    crowd[order[[0, -1]]] = math.inf
                    crowd[order[1:-1]] += (v[order[2:]] - v[order[:-2]]) / span
            if len(front) <= 2:
                crowd[:] = math.inf
            for k, x in zip(front, crowd, strict=True):
                rows[k] |= {"rank": rank, "crowding": float(x)}
            left -= set(front)
            rank += 1
        for n, v in enumerate(sorted({x for x in viol if x > EPSILON})):
            for k in np.flatnonzero(viol == v):
                rows[k] |= {"rank": rank + n, "crowding": 0.0}
        return rows

    def tell(self, evaluated: pd.DataFrame) -> None:
        """Takes (candidate_id, values, objectives, residuals) of the last candidates."""
        fresh = [{"id": int(r.candidate_id), "values": list(r.values_), "objectives": list(r.objectives), "violation": float(sum(max(0.0, x) for x in r.residuals))} for r in evaluated.rename(columns={"values": "values_"}).itertuples(index=False)]
        rows = self._ranked(self.members + fresh)
        self.members = sorted(rows, key=self._order)[: self.population]
        known = {m["id"]: m for m in self.archive + fresh if m["violation"] <= EPSILON}
        self.archive = sorted((m for m in self._ranked(list(known.values())) if m["rank"] == 0), key=self._order)[: self.archive_size] if known else []
        self.generation += 1

    def checkpoint(self) -> str:
        """All of the state as JSON; ``resume`` goes on exactly."""
        return json.dumps({k: ([vars(x) for x in v] if k == "variables" else v) for k, v in vars(self).items()})

    @classmethod
    def resume(cls, text: str) -> Optimizer:
        d = json.loads(text)
        d["variables"] = [Variable(**v) for v in d["variables"]]
        return cls(**d)


# Scenario deltas, manifests and workspaces.


def compare_scenarios(fields: DataFrame, baseline: str) -> DataFrame:
    """Deltas of fields(scenario_id, name, values) against a baseline scenario: n, min, mean, max and RMS of each field's delta.

    Fields of other lengths than the baseline's are refused.
    """
    base = fields.where(F.col("scenario_id") == baseline).select("name", F.col("values").alias("b"))
    rows = fields.where(F.col("scenario_id") != baseline).join(base, "name")
    require_none(rows.where(F.size("values") != F.size("b")), "a field does not fit the baseline's")
    d = rows.select("scenario_id", "name", F.explode(F.zip_with("values", "b", lambda x, y: x - y)).alias("d"))
    return d.groupBy("scenario_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("min_delta"), F.avg("d").alias("mean_delta"), F.max("d").alias("max_delta"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms_delta"))


def validate_manifest(manifest: dict) -> None:
    """Refuses a study without parameters or objectives, with names that differ in case only, or with empty ranges."""
    for part in ("parameters", "objectives"):
        if not manifest.get(part):
            raise InvalidInput(f"no {part}")
    names = [x["name"].lower() for part in ("parameters", "objectives", "constraints") for x in manifest.get(part, [])]
    if len(names) != len(set(names)):
        raise InvalidInput("names are not unique")
    for p in manifest["parameters"]:
        if p.get("kind") == "categorical":
            if not p.get("categories") or len(p["categories"]) != len(set(p["categories"])):
                raise InvalidInput(f"{p['name']}: categories are missing or repeated")
        elif not p["low"] <= p["high"]:
            raise InvalidInput(f"{p['name']}: an empty range")
    for o in manifest["objectives"]:
        if o.get("components", 1) < 1 or o.get("direction") not in ("min", "max"):
            raise InvalidInput(f"{o['name']}: bad objective")


class Workspace:
    """A study in a folder of any file system that Spark reaches: a manifest, and a journal of batches that are committed once each.

    A commit is written under another name and renamed; committing a batch again
    with the same content does nothing, with other content it is refused.  path
    is a URI; a plain path is one of the session's default file system.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path = path.rstrip("/")
        spark = spark or SparkSession.active()
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    @classmethod
    def create(cls, path: str, manifest: dict, spark: SparkSession | None = None) -> Workspace:
        """A new workspace with a manifest that holds; the folder must not be there yet."""
        validate_manifest(manifest)
        out = cls(path, spark)
        if out._fs.exists(out._at("")):
            raise InvalidInput(f"{path} is there already")
        out._fs.mkdirs(out._at("batches"))
        out._put("manifest.json", manifest)
        return out

    def _put(self, name: str, content) -> None:
        tmp = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        if not self._fs.rename(tmp, self._at(name)):
            self._fs.delete(tmp, False)
            raise InvalidInput(f"{name} was written by someone else")

    def _get(self, name: str):
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        except Py4JJavaError as e:
            if "ChecksumException" in str(e.java_exception):  # the file system keeps checksums of its own
                raise InvalidInput(f"{name} is damaged") from e
            raise
        finally:
            stream.close()

    def manifest(self) -> dict:
        return self._get("manifest.json")

    def commit(self, batch: int, rows: list[dict]) -> bool:
        """Whether the batch was new."""
        content = {"batch": batch, "rows": rows, "sha256": self._digest(rows)}
        name = f"batches/{batch:08d}.json"
        if self._fs.exists(self._at(name)):
            if self._get(name)["sha256"] != content["sha256"]:
                raise InvalidInput(f"batch {batch} is committed with other content")
            return False
        self._put(name, content)
        return True

    @staticmethod
    def _digest(rows: list[dict]) -> str:
        return hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()

    def rows(self) -> list[dict]:
        """All committed rows; what was half written is not among them."""
        out = []
        for name in sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("batches"))):
            if name.endswith(".json"):
                c = self._get(f"batches/{name}")
                if self._digest(c["rows"]) != c["sha256"]:
                    raise InvalidInput(f"{name} is damaged")
                out += c["rows"]
        return out
