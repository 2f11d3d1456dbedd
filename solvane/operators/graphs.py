"""Connected components, degrees, closeness and betweenness of graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.core import large, shared_root

#: Nodes of a graph whose adjacency is broadcast for path counting at most.
BROADCAST_NODES = 100_000
#: Links, counted in both directions, whose components one task finds at most; more of them take rounds of joins.
LINKS_AT_ONCE = 4_000_000
#: Sources whose shortest paths are counted together, and nodes times sources, at most.
SOURCES_AT_ONCE = 64
PLACES_AT_ONCE = 2_000_000


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a checkpoint in the session's shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def _fresh(df: DataFrame) -> DataFrame:
    """df cut, and without the estimate of its size, which a checkpoint keeps: through joins in a loop its digits multiply by round."""
    done = _cut(df)
    return DataFrame(done.sparkSession._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), done.sparkSession)


def _united(batches):
    """(v, comp) of all links(a, b): the lesser root stays a root, so that it is the smallest end."""
    ends = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    if not ends:
        return
    ids, at = np.unique(np.concatenate([x for pair in zip(*ends, strict=True) for x in pair]), return_inverse=True)
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*np.split(at, 2), strict=True):
        x, y = sorted((top(int(x)), top(int(y))))
        root[y] = x
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[top(x) for x in range(len(ids))]])], ["v", "comp"])


def components(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(v, comp): the smallest end reachable from each end of links(a, b), by least labels and jumps to labels' labels.

    Up to ``at_once`` links of whole numbers are united by one task, more of them
    round by round, with the same result.
    """
    both = _cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    if both.schema["a"].dataType.typeName() == "long" and both.limit(at_once + 1).count() <= at_once:
        return _cut(both.where("a <= b").repartition(1).mapInArrow(_united, "v long, comp long"))
    labels = _fresh(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("comp")))
    while True:
        told = both.join(large(labels.select(F.col("v").alias("b"), "comp")), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("heard"))
        step = labels.join(large(told), "v").select("v", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        far = labels.select(F.col("v").alias("at"), F.col("comp").alias("far"))
        fresh = _fresh(step.join(large(far), step["comp"] == far["at"], "left").select("v", "was", F.least("comp", "far").alias("comp")))
        labels = fresh.select("v", "comp")
        if fresh.where("comp <> was").isEmpty():
            return labels


def with_components(nodes: DataFrame, edges: DataFrame, key: str = "idx") -> DataFrame:
    """nodes with component: 0, 1, ... in the order of each component's first node."""
    found = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b"))).withColumnRenamed("v", key)
    named = nodes.join(large(found), key, "left").withColumn("comp", F.coalesce("comp", key))
    order = named.select("comp").distinct()
    from pyspark.sql import Window

    numbered = order.withColumn("component", F.row_number().over(Window.orderBy("comp")) - 1)
    return named.join(numbered, "comp").drop("comp")


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "idx") -> DataFrame:
    """nodes with degree and degree centrality (degree / (n - 1))."""
    ends = edges.select(F.col("i").alias(key)).union(edges.select(F.col("j").alias(key))).groupBy(key).agg(F.count(F.lit(1)).alias("degree"))
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = nodes.join(ends, key, "left").na.fill(0, ["degree"]).crossJoin(F.broadcast(total))
    return out.withColumn("degree_centrality", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0)).drop("n")


def _adjacency(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, to): the places in ids of each node's neighbours, one node after the other."""
    a, b = np.searchsorted(ids, i), np.searchsorted(ids, j)
    a, b = np.r_[a, b], np.r_[b, a]
    return np.r_[0, np.cumsum(np.bincount(a, minlength=len(ids)))], b[np.argsort(a, kind="stable")]


def _paths_from(sources: np.ndarray, begin: np.ndarray, to: np.ndarray, slot: np.ndarray, between: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """Harmonic closeness of sources; what their shortest paths add to the betweenness of others is added to between.

    All sources go on level by level together.  A place is a source's number times
    the number of nodes, plus a node; slot is room for len(sources) times that.
    """
    n, k = len(begin) - 1, len(sources)
    size, close = np.diff(begin), np.zeros(k)
    seen, share = np.zeros(k * n, bool), np.zeros(k * n)
    own, node, count = np.arange(k), sources, np.ones(k)
    at = own * n + node
    seen[at] = True
    levels = []
    while True:
        # the ends of all links of this level, and which of them are new
        times = size[node]
        back = np.repeat(np.arange(len(node)), times)
        w = to[np.arange(len(back)) + np.repeat(begin[node] - (np.cumsum(times) - times), times)]
        ends = (own * n)[back] + w
        new = np.flatnonzero(~seen[ends])
        if not len(new):
            break
        back, ends = back[new], ends[new]
        slot[ends] = np.arange(len(ends))
        first = np.flatnonzero(slot[ends] == np.arange(len(ends)))
        before, own, node = at, own[back[first]], w[new[first]]
        at = ends[first]
        slot[at] = np.arange(len(at))
        there = slot[ends]
        seen[at] = True
        total = np.bincount(there, count[back], len(at))
        levels.append((before, at, back, there, count, total))
        close += np.bincount(own, minlength=k) / len(levels)
        count = total
        if count.max() > 1e200:  # only shares of the same source's counts matter
            most = np.zeros(k)
            np.maximum.at(most, own, count)
            count = np.maximum(count / most[own], 1e-300)
    for before, at, back, there, count, total in reversed(levels):
        share[before] = count * np.bincount(back, ((1 + share[at]) / total)[there], len(before))
    share[np.arange(k) * n + sources] = 0.0
    between += share.reshape(k, n).sum(axis=0)
    reached |= seen.reshape(k, n).any(axis=0)
    return close


def centralities(nodes: DataFrame, edges: DataFrame, key: str = "idx") -> DataFrame:
    """(key, closeness, betweenness): harmonic closeness / (n - 1), betweenness / ((n - 1)(n - 2)) over ordered pairs.

    Sources are spread over tasks; the adjacency is broadcast, for graphs of at
    most BROADCAST_NODES nodes.
    """
    n = nodes.count()
    if n > BROADCAST_NODES:
        raise ValueError(f"centralities are for graphs of at most {BROADCAST_NODES} nodes")
    i, j = (np.asarray(c, np.int64) for c in edges.select(F.col("i").cast("long"), F.col("j").cast("long")).toArrow().itercolumns())
    ids = np.unique(np.concatenate([np.asarray(nodes.select(F.col(key).cast("long")).toArrow().column(0), np.int64), i, j]))
    share = nodes.sparkSession.sparkContext.broadcast((ids, *_adjacency(ids, i, j)))

    def run(batches):
        ids, begin, to = share.value
        each = max(1, min(SOURCES_AT_ONCE, PLACES_AT_ONCE // max(len(ids), 1)))
        slot, between, reached = np.zeros(each * len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids), bool)
        for b in batches:
            sources = b[key].to_numpy()
            for at in range(0, len(sources), each):
                part = sources[at : at + each]
                yield pd.DataFrame({key: part, "c": _paths_from(np.searchsorted(ids, part), begin, to, slot, between, reached), "b": 0.0})
        yield pd.DataFrame({key: ids[reached], "c": 0.0, "b": between[reached]})

    # neighbours by number are often near each other, and need about as many levels
    parts = nodes.select(F.col(key).cast("long").alias(key)).repartitionByRange(max(1, min(96, n // 50)), key).mapInPandas(run, f"{key} long, c double, b double")
    out = parts.groupBy(key).agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
    return out.select(key, (F.col("c") / max(n - 1, 1)).alias("closeness"), (F.col("b") / max((n - 1) * (n - 2), 1)).alias("betweenness"))
