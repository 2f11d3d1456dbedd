"""Evidence: designs of experiments, global sensitivity, robust and uncertain ranking, multi-fidelity, passports."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.core import InvalidInput, large
from solvane.operators.graphs import _cut
from solvane.operators.study import EPSILON, Stream, _draws, pareto_front

MOST_ROWS = 2_000_000
#: Reference results of a front that each task holds at most.
MOST_FRONT = 100_000
#: Rows of intervals of one objective that one task ranks at most.
MOST_INTERVALS = 10_000_000


def saltelli_design(spark: SparkSession, bounds: list[tuple[float, float]], n: int, seed: int = 42) -> DataFrame:
    """(row, block, base, values): A, B and AB_i blocks of n rows each; values by (row, column) alone."""
    k = len(bounds)
    if n * (k + 2) > MOST_ROWS:
        raise InvalidInput(f"more than {MOST_ROWS} rows")

    def run(batches):
        u = _draws(seed, 2 * n * k).reshape(2, n, k)
        for b in batches:
            out = []
            for r in b["id"]:
                block, base = divmod(int(r), n)
                x = u[1, base] if block == 1 else u[0, base]
                if block >= 2:
                    x = x.copy()
                    x[block - 2] = u[1, base, block - 2]
                out.append((int(r), "A" if block == 0 else "B" if block == 1 else f"AB{block - 2}", base, [lo + (hi - lo) * float(v) for (lo, hi), v in zip(bounds, x, strict=True)]))
            yield pd.DataFrame(out, columns=["row", "block", "base", "values"])

    return spark.range(n * (k + 2)).mapInPandas(run, "row long, block string, base long, values array<double>")


def sobol_indices(results: DataFrame) -> DataFrame:
    """(parameter, first_order, total) from results(block, base, y): Saltelli and Jansen forms, variance of A and B together."""
    y = lambda block, name: results.where(F.col("block") == block).select("base", F.col("y").alias(name))
    both = results.where("block in ('A', 'B')").agg(F.var_samp("y").alias("v"))
    if not (both.first()["v"] or 0) > 0:
        raise InvalidInput("the outcome does not vary")
    mixed = results.where("block like 'AB%'").select(F.substring("block", 3, 9).cast("int").alias("parameter"), "base", F.col("y").alias("m"))
    rows = mixed.join(y("A", "a"), "base").join(y("B", "b"), "base").crossJoin(F.broadcast(both))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    return rows.groupBy("parameter").agg((F.avg(b * (m - a)) / F.first("v")).alias("first_order"), (F.avg((a - m) * (a - m)) / 2 / F.first("v")).alias("total"))


def morris_design(spark: SparkSession, bounds: list[tuple[float, float]], trajectories: int, levels: int = 4, seed: int = 42) -> DataFrame:
    """(trajectory, step, changed, delta, values): trajectories of k + 1 points, one coordinate moved at a time."""
    if levels < 4 or levels % 2:
        raise InvalidInput("levels are even and 4 at least")
    k = len(bounds)
    delta = levels / (2 * (levels - 1))

    def run(batches):
        for b in batches:
            out = []
            for t in b["id"]:
                s = Stream(seed + 1_000_003 * int(t))
                order = list(range(k))
                for i in range(k - 1, 0, -1):
                    j = s.index(i + 1)
                    order[i], order[j] = order[j], order[i]
                x, ways = [], []
                for _ in range(k):
                    way = 1 if s.unit() < 0.5 else -1
                    start = s.index(levels // 2) / (levels - 1)
                    x.append(start if way > 0 else start + delta)
                    ways.append(way)
                value = lambda x: [lo + (hi - lo) * v for (lo, hi), v in zip(bounds, x, strict=True)]
                out.append((int(t), 0, None, None, value(x)))
                for n, c in enumerate(order, 1):
                    x[c] += ways[c] * delta
                    out.append((int(t), n, c, ways[c] * delta, value(x)))
            yield pd.DataFrame(out, columns=["trajectory", "step", "changed", "delta", "values"]).astype({"changed": "Int32"})

    return spark.range(trajectories).mapInPandas(run, "trajectory long, step int, changed int, delta double, values array<double>")


def morris_effects(results: DataFrame) -> DataFrame:
    """(parameter, mu, mu_star, sigma) of elementary effects from results(trajectory, step, changed, delta, y)."""
    by = Window.partitionBy("trajectory").orderBy("step")
    e = results.withColumn("effect", (F.col("y") - F.lag("y").over(by)) / F.col("delta")).where("changed is not null")
    return e.groupBy(F.col("changed").alias("parameter")).agg(F.avg("effect").alias("mu"), F.avg(F.abs("effect")).alias("mu_star"), F.coalesce(F.stddev_samp("effect"), F.lit(0.0)).alias("sigma"))


def robust_scenarios(outcomes: DataFrame, direction: str = "min", alpha: float = 0.8, key: str = "candidate_id") -> DataFrame:
    """A row for each candidate of outcomes(key, scenario_id, probability, objective, residual): mean, deviation, worst, CVaR, violation probability.

    Probabilities are normalised; the CVaR is the mean of the worst 1 - alpha of
    them, the scenario at the limit weighing with its part.
    """
    loss = -F.col("objective") if direction == "max" else F.col("objective")
    rows = outcomes.withColumn("p", F.col("probability") / F.sum("probability").over(Window.partitionBy(key))).withColumn("loss", loss)
    by = Window.partitionBy(key).orderBy(F.col("loss").desc(), "scenario_id")
    before = F.coalesce(F.sum("p").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tail = 1 - alpha
    rows = rows.withColumn("part", F.least(F.greatest(F.lit(tail) - before, F.lit(0.0)), F.col("p")))
    sign = -1 if direction == "max" else 1
    out = rows.groupBy(key).agg(
        F.sum(F.col("p") * F.col("objective")).alias("mean"),
        F.sum(F.col("p") * F.col("objective") * F.col("objective")).alias("square"),
        (sign * F.max("loss")).alias("worst"),
        (sign * F.sum(F.col("part") * F.col("loss")) / F.sum("part")).alias("cvar"),
        F.sum(F.when(F.col("residual") > 0, F.col("p")).otherwise(0.0)).alias("violation_probability"),
    )
    return out.withColumn("deviation", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("square")


def _interval_fronts(rows: DataFrame, key: str) -> DataFrame:
    """(key, rank) of rows(key, tier_number, lo0, hi0): a front is all that begins before the least end of what is left of its tier."""

    def run(batches):
        every = list(batches)
        if not every:
            return
        held = pa.Table.from_batches(every)
        tier, lo, hi = (held.column(c).to_numpy() for c in ("tier_number", "lo0", "hi0"))
        # what has no begin is beaten by nothing, what has no end beats nothing; Spark's NaN is above all numbers
        lo = np.where(held.column("lo0").is_null().to_numpy(), -np.inf, np.where(np.isnan(lo), np.inf, lo - EPSILON))
        hi = np.where(np.isnan(hi), np.inf, hi)
        order = np.lexsort((lo, tier))
        rank, out = 0, np.empty(len(order), np.int32)
        for own in np.split(order, np.flatnonzero(np.diff(tier[order])) + 1):
            begins, least = lo[own], np.minimum.accumulate(hi[own][::-1])[::-1]
            at = 0
            while at < len(own):
                upto = int(np.searchsorted(begins, least[at], "right"))
                out[own[at:upto]] = rank
                at, rank = upto, rank + 1
        yield from pa.table({key: held.column(key), "rank": pa.array(out)}).to_batches(max_chunksize=100_000)

    return rows.repartition(1).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, rank int")


def uncertainty_ranking(rows: DataFrame, objectives: dict[str, str], residuals: list[str] | None = None, multiplier: float = 1.96, key: str = "candidate_id", at_once: int = MOST_INTERVALS) -> DataFrame:
    """rows with tier (proven, possible, infeasible) and rank: a row dominates where its interval's worse end beats the other's better end.

    Objectives and residuals are means in their columns, deviations in columns
    with _sd behind their names.  Better tiers come first, then fronts.  With one
    objective, up to ``at_once`` rows are ranked by one task that sorts them, more
    of them round by round, with the same result.
    """
    tier_high, tier_low = F.lit(True), F.lit(True)
    for r in residuals or []:
        tier_high = tier_high & (F.col(r) + multiplier * F.col(f"{r}_sd") <= 0)
        tier_low = tier_low & (F.col(r) - multiplier * F.col(f"{r}_sd") <= 0)
    tier = F.when(tier_high, 0).when(tier_low, 1).otherwise(2)
    named = rows.withColumn("tier_number", tier)
    for k, (c, way) in enumerate(objectives.items()):
        mid = -F.col(c) if way == "max" else F.col(c)
        named = named.withColumn(f"lo{k}", mid - multiplier * F.col(f"{c}_sd")).withColumn(f"hi{k}", mid + multiplier * F.col(f"{c}_sd"))
    n = len(objectives)
    ends = [f"{e}{k}" for k in range(n) for e in ("lo", "hi")]
    better, no_worse = F.lit(False), F.lit(True)
    for k in range(n):
        no_worse = no_worse & (F.col(f"a.hi{k}") <= F.col(f"b.lo{k}") + EPSILON)
        better = better | (F.col(f"a.hi{k}") < F.col(f"b.lo{k}") - EPSILON)
    beats = (F.col("a.tier_number") < F.col("b.tier_number")) | (F.col("a.tier_number") == F.col("b.tier_number")) & no_worse & better
    named = _cut(named)
    if n == 1 and named.limit(at_once + 1).count() <= at_once:
        ranked = _interval_fronts(named.select(key, "tier_number", *ends), key)
    else:
        left, rank, ranked = named.select(key, "tier_number", *ends), 0, None
        while not left.isEmpty():
            front = _cut(left.alias("b").join(left.alias("a"), beats, "left_anti").withColumn("rank", F.lit(rank)))
            ranked = front if ranked is None else ranked.unionByName(front)
            left = _cut(left.join(front.select(key), key, "left_anti"))
            rank += 1
    names = F.element_at(F.array(F.lit("proven"), F.lit("possible"), F.lit("infeasible")), F.col("tier_number") + 1)
    out = named.withColumn("tier", names).drop("tier_number", *ends)
    return out.join(large(ranked.select(key, "rank")), key) if ranked is not None else out.withColumn("rank", F.lit(0))


def calibration(observations: DataFrame, key: str = "candidate_id", floor: float = 1e-9) -> DataFrame:
    """One row: slope, intercept and residual deviation of reference over fast results; slope 1 where fast ones do not vary."""
    fast = observations.where("fidelity = 'fast'").select(key, F.col("objective").alias("x"))
    ref = observations.where("fidelity = 'reference'").select(key, F.col("objective").alias("y"), "cost")
    pairs = fast.join(ref, key)
    s = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("cost").alias("reference_cost"))
    if (s.first()["n"] or 0) < 2:
        raise InvalidInput("two candidates with both fidelities are needed")
    c = pairs.crossJoin(F.broadcast(s))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    m = c.groupBy("n", "mx", "my", "reference_cost").agg(F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy"), F.sum(dy * dy).alias("syy"))
    slope = F.when(F.col("sxx") > EPSILON, F.col("sxy") / F.when(F.col("sxx") > EPSILON, F.col("sxx"))).otherwise(1.0)
    m = m.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    sse = F.greatest(F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    return m.select("n", "slope", "intercept", F.greatest(F.sqrt(sse / F.greatest(F.col("n") - 2, F.lit(1))), F.lit(floor)).alias("residual_deviation"), "reference_cost")


class Growth:
    """By what area points grow the area that costs of a front cover below a reference point: two searches in sums along the front's steps."""

    def __init__(self, known: np.ndarray, reference: np.ndarray):
        p = known[(known < reference).all(1)]
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        low = np.minimum.accumulate(p[:, 1])
        step = np.ones(len(p), bool)
        step[1:] = p[1:, 1] < low[:-1]
        self.x, self.y, self.reference = p[step, 0], p[step, 1], reference
        self.ends = np.append(self.x, reference[0])
        self.sums = np.append(0.0, np.cumsum(np.diff(self.ends) * self.y))

    def of(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """The growth by each point alone."""
        start = np.searchsorted(self.x, px, "right")
        stop = np.searchsorted(-self.y, -py, "left")  # the first step as low as the point
        top = np.append(self.reference[1], self.y)[start]
        grown = (self.ends[start] - px) * (top - py) + self.sums[stop] - self.sums[start] - py * (self.ends[stop] - self.ends[start])
        return np.where((px < self.reference[0]) & (py < self.reference[1]) & (start <= stop) & (top > py), grown, 0.0)


def recommend(observations: DataFrame, directions: list[str], batch: int = 4, draws: int = 256, seed: int = 42, key: str = "candidate_id") -> DataFrame:
    """The candidates without reference results that promise most per cost: (key, gain, cost, score).

    observations has objectives as an array.  Objectives are calibrated one by
    one; for two of them the gain is the expected growth of the reference
    front's hypervolume under normal errors, otherwise the summed deviations.
    """
    models = []
    for k, way in enumerate(directions):
        m = calibration(observations.withColumn("objective", (F.element_at("objectives", k + 1)) * (-1 if way == "max" else 1)), key).first()
        models.append((m["slope"], m["intercept"], m["residual_deviation"], m["reference_cost"]))
    sign = np.array([-1.0 if d == "max" else 1.0 for d in directions])
    names = [f"r{k}" for k in range(len(directions))]
    known_rows = observations.where("fidelity = 'reference'").select(*[(F.element_at("objectives", k + 1) * float(sign[k])).alias(n) for k, n in enumerate(names)])
    ends = known_rows.agg(*[f(n).alias(f"{e}_{n}") for n in names for e, f in (("lo", F.min), ("hi", F.max))]).first()
    low, high = (np.array([ends[f"{e}_{n}"] for n in names], float) for e in ("lo", "hi"))
    known = np.zeros((0, len(names)))
    if len(names) == 2:
        # what other results dominate adds no area: the front alone goes to the tasks
        front = pareto_front(known_rows.distinct(), dict.fromkeys(names, "min")).select(*names).distinct().limit(MOST_FRONT + 1).collect()
        if len(front) > MOST_FRONT:
            raise InvalidInput(f"a front of more than {MOST_FRONT} reference results")
        known = np.array([list(r) for r in front], float).reshape(-1, 2)
    todo = observations.where("fidelity = 'fast'").join(observations.where("fidelity = 'reference'").select(key).distinct(), key, "left_anti")
    far = high + 0.1 * np.maximum(high - low, 1.0)
    growth = Growth(known, far) if len(directions) == 2 else None
    cost = float(np.mean([m[3] for m in models]))

    def run(batches):
        sd = np.array([m[2] for m in models])
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                ids = b[key].to_numpy(np.int64)
                gain = np.full(len(b), float(sd.sum()))
                if growth is not None:
                    mean = np.stack(b["objectives"]).astype(float) * sign * [m[0] for m in models] + [m[1] for m in models]
                    u = np.clip(_draws(seed + 7919 * ids, 2 * draws), 1e-12, 1 - 1e-12)
                    z, w = np.sqrt(-2 * np.log(u[:, :draws])), 2 * math.pi * u[:, draws:]
                    gain = growth.of(mean[:, :1] + sd[0] * (z * np.cos(w)), mean[:, 1:] + sd[1] * (z * np.sin(w))).mean(axis=1)
                yield pd.DataFrame({key: ids, "gain": gain, "cost": cost, "score": gain / cost if cost > 0 else 0.0})

    spread = todo.select(key, "objectives").repartition(todo.sparkSession.sparkContext.defaultParallelism, key)
    return spread.mapInPandas(run, f"{key} long, gain double, cost double, score double").orderBy(F.col("score").desc(), key).limit(batch)


REQUIRED = ("study_id", "candidate_id", "engine_version", "created_at", "input_hashes")


def seal(passport: dict) -> dict:
    """The passport with its content hash, after checks."""
    for f in REQUIRED:
        if not passport.get(f):
            raise InvalidInput(f"{f} is missing")
    datetime.fromisoformat(str(passport["created_at"]).replace("Z", "+00:00"))
    for a, b in (("interval_low", "interval_high"), ("reference_value", "reference_source")):
        if (passport.get(a) is None) != (passport.get(b) is None):
            raise InvalidInput(f"{a} and {b} come together")
    body = {k: v for k, v in passport.items() if k != "content_hash"}
    return body | {"content_hash": hashlib.sha256(b"passport|" + json.dumps(body, sort_keys=True).encode()).hexdigest()}


def validate(passport: dict) -> bool:
    """Whether a sealed passport is as it was sealed."""
    return bool(passport.get("content_hash")) and seal(passport)["content_hash"] == passport["content_hash"]
