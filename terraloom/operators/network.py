"""Iterative graph operators; every round is a set of joins over a stored table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from terraloom.scale import global_row_number, materialize, release, shuffled


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (index of a smaller or the same member) after joining along the pairs a-b; the least index names a component."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (hi, lo) to a star around the least node of each component."""
    table = pa.Table.from_batches(list(batches))
    both = pa.chunked_array([*table["hi"].chunks, *table["lo"].chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[np.asarray(both.indices)].reshape(2, -1)
    label = joined_labels(np.arange(len(order)), ends[0], ends[1])
    names = both.dictionary.take(order)
    away = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(away)), names.take(pa.array(label[away]))], ["hi", "lo"])


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100, settle: int = 200_000) -> DataFrame:
    """(node, component): the smallest node id reachable.

    Alternating star contraction: an edge always points from a larger to a smaller id.  The
    large star moves each larger neighbour of a node to the least one the node knows, the
    small star does so with the node and its smaller neighbours.  Edges never grow in
    number, nodes without an edge never travel, and a component is a star around its
    smallest id after a number of rounds that grows with the logarithm of its size, however
    long its paths are.  ``edges`` (src, dst) are read in both directions.  Minima are formed
    before each shuffle; hubs are left to adaptive skew handling of the joins.  The last
    ``settle`` edges (a few MB) are joined in one task.
    """
    star = materialize(edges.where("src != dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    seen = None
    for _ in range(max_rounds):
        last = star
        mark = star.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
        if 0 < mark["n"] <= settle:
            kind = star.schema["hi"].dataType.simpleString()
            star = star.repartition(1).mapInArrow(_settle, f"hi {kind}, lo {kind}")
        if mark == seen or mark["n"] <= settle:
            made = materialize(nodes.select("node").distinct().join(shuffled(star.select(F.col("hi").alias("node"), "lo")), "node", "left").select(
                "node", F.coalesce("lo", "node").alias("component")))
            release(last)
            return made
        seen = mark
        around = star.select(F.col("lo").alias("node"), F.col("hi").alias("next")).unionByName(star.select(F.col("hi").alias("node"), F.col("lo").alias("next")))
        low = around.groupBy("node").agg(F.min("next").alias("low")).select(F.col("node").alias("lo"), F.least("node", "low").alias("low"))
        large = star.join(shuffled(low), "lo").select("hi", F.col("low").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = large.join(shuffled(least), "hi").where("lo != low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        star = materialize(moved.unionByName(least.select("hi", F.col("low").alias("lo"))).distinct())
        release(last)
    raise RuntimeError("components did not settle; raise max_rounds")


def patch_ids(components: DataFrame) -> DataFrame:
    """Number components 1.. by their smallest node."""
    ids = global_row_number(components.select("component").distinct(), ["component"], "patch_id")
    return components.join(shuffled(ids), "component").select("node", "patch_id")


def cell_id(q: str = "q", r: str = "r"):
    """One sortable number per hexagon cell (order of q, then r)."""
    return (F.col(q) * F.lit(2**31) + F.col(r)).cast("bigint")


def service_area(edges: DataFrame, sources: DataFrame, cutoff: float, max_rounds: int = 10_000, merge_every: int = 8) -> DataFrame:
    """(node, dist): network distance from the nearest source, up to ``cutoff``.

    Edges (src, dst, length) are read in both directions.  A round relaxes the nodes that
    the last one improved and writes only those it improves itself; every ``merge_every``
    rounds these tables become one.  What a round looks up in them is joined to its few
    candidates, so the distances found so far need not be placed again.
    """
    both = materialize(
        edges.select("src", "dst", "length").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length"))
        .groupBy("src", "dst").agg(F.min("length").alias("length")))
    front = materialize(sources.select("node").distinct().withColumn("dist", F.lit(0e0)))
    known = [front]

    def union() -> DataFrame:
        every = known[0]
        for more in known[1:]:
            every = every.unionByName(more)
        return every

    for _ in range(max_rounds):
        reach = materialize(both.join(front.withColumnRenamed("node", "src"), "src").select(
            F.col("dst").alias("node"), (F.col("dist") + F.col("length")).alias("_d")
        ).where(F.col("_d") <= cutoff).groupBy("node").agg(F.min("_d").alias("_d")))
        old = union().join(reach.select("node"), "node", "left_semi").groupBy("node").agg(F.min("dist").alias("dist"))
        better = materialize(reach.join(old, "node", "left").where("dist is null or _d < dist").select("node", F.col("_d").alias("dist")))
        release(reach)
        if better.isEmpty():
            best = materialize(union().groupBy("node").agg(F.min("dist").alias("dist")))
            release(better, both, *known)
            return best
        known.append(better)
        front = better
        if len(known) > merge_every:
            one = materialize(union().groupBy("node").agg(F.min("dist").alias("dist")))
            release(*known[:-1])  # the last one is the frontier
            known = [one, better]
    raise RuntimeError("distances did not settle; raise max_rounds")


def lines_reached(edges: DataFrame, area: DataFrame, cutoff: float) -> DataFrame:
    """Edges with the length that lies inside the service area (from either end)."""
    ends = edges.join(area.select(F.col("node").alias("src"), F.col("dist").alias("_a")), "src", "left").join(
        area.select(F.col("node").alias("dst"), F.col("dist").alias("_b")), "dst", "left")
    from_a = F.greatest(F.lit(cutoff) - F.coalesce("_a", F.lit(cutoff)), F.lit(0e0))
    from_b = F.greatest(F.lit(cutoff) - F.coalesce("_b", F.lit(cutoff)), F.lit(0e0))
    got = F.least(F.col("length"), from_a + from_b)
    return ends.where("_a is not null or _b is not null").withColumn("reached", got).drop("_a", "_b")


#: Path counts above this are scaled: they grow with every hop and pass any float in a long graph.
_FULL = 2.0**900


def _dependencies(start: np.ndarray, to: np.ndarray, n: int, sources: np.ndarray, room: int = 2**24) -> np.ndarray:
    """Summed pair dependencies of all nodes over the given sources, hop by hop; edges as sorted lists per node.

    As many sources advance together as have ``room`` for their nodes and the edges of their
    shortest paths, at most 128: place ``k * n + node`` is a node as seen from the k-th, so a
    hop costs a few array operations for all of them, however thin their frontiers are.  An
    edge keeps its share of the path counts at its far end, so counts matter only within a
    hop and may be scaled by powers of two; ``power`` holds them where one factor per source
    does not do.
    """
    total, degree = np.zeros(n), np.diff(start)
    lanes = min(128, max(1, room // (n + len(to) // 2 + 1)))
    slot = np.empty(lanes * n, np.int32)  # a place's index in its frontier, -1 before it is reached
    for first in range(0, len(sources), lanes):
        part = sources[first:first + lanes]
        slot.fill(-1)
        front, paths, power, steps = np.arange(len(part)) * n + part, np.ones(len(part)), None, []
        slot[front] = np.arange(len(front))
        nodes = [part]
        while True:
            a, b = _new_edges(start, degree, to, front, nodes[-1], slot, max(room // 8, 1))
            if not len(b):
                break
            at = np.arange(len(b), dtype=np.int32)
            slot[b] = at
            front = b[slot[b] == at]
            slot[front] = at[:len(front)]
            b = slot[b]
            share = paths[a]
            if power is not None:
                top = np.full(len(front), np.iinfo(np.int32).min)
                np.maximum.at(top, b, power[a])
                share = np.ldexp(share, power[a] - top[b])
            paths = np.bincount(b, share, len(front))
            share /= paths[b]
            if power is not None or paths.max() > _FULL:
                paths, up = np.frexp(paths)
                power = up if power is None else top + up
                lane = front // n
                best = np.full(len(part), np.iinfo(np.int32).min)
                np.maximum.at(best, lane, power)
                power = power - best[lane]
                if power.min() > -900:
                    paths, power = np.ldexp(paths, power), None
            steps.append((a, b, share))
            nodes.append(front % n)
        dep = np.zeros(len(nodes[-1]))
        deps = [dep]
        for (a, b, share), own in zip(reversed(steps), reversed(nodes[:-1])):
            dep = np.bincount(a, share * (1 + dep)[b], len(own))
            deps.append(dep)
        deps[-1] = np.zeros(len(part))  # the sources themselves
        total += np.bincount(np.concatenate(nodes), np.concatenate(deps[::-1]), n)
    return total


def _new_edges(
    start: np.ndarray, degree: np.ndarray, to: np.ndarray, front: np.ndarray, nodes: np.ndarray, slot: np.ndarray, most: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Edges from a frontier to places not reached before: index in the frontier and place; looked up about ``most`` at a time."""
    size = degree[nodes]
    upto = np.cumsum(size)
    cuts = [0, len(front)] if upto[-1] <= most else [0, *(np.flatnonzero(np.diff(upto // most)) + 1), len(front)]
    found = []
    for lo, hi in zip(cuts, cuts[1:]):
        many = size[lo:hi]
        a = np.repeat(np.arange(lo, hi, dtype=np.int32), many)
        b = to[np.arange(len(a)) + np.repeat(start[nodes[lo:hi]] - upto[lo:hi] + many + (upto[lo - 1] if lo else 0), many)]
        b += (front - nodes)[a]
        fresh = slot[b] < 0
        found.append((a[fresh], b[fresh]))
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))


def betweenness(nodes: DataFrame, edges: DataFrame, local_edges: int = 4_000_000, state: int = 50_000_000) -> DataFrame:
    """Exact normalized betweenness of an undirected, unweighted graph: (node, betweenness).

    A graph of at most ``local_edges`` directed edges (some 50 MB) goes along with the tasks,
    and the sources are dealt out over them.  A larger one stays a table: sources advance
    together in batches, one hop per round, as a table (source, node, paths) of at most
    about ``state`` rows; the back pass of a batch returns the dependencies hop by hop,
    then the hops of the batch are deleted.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    every = materialize(nodes.select("node").distinct())
    n, m = every.count(), both.count()
    if m <= local_edges:
        sums = _local_dependencies(every, both, n * m)
    else:
        batches = max(1, -(-n * n // state))
        parts = [_batch_dependencies(every.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == k), both) for k in range(batches)]
        sums = parts[0]
        for part in parts[1:]:
            sums = sums.unionByName(part)
    scale = (n - 1) * (n - 2)
    sums = sums.groupBy("node").agg((F.sum("dep") / F.lit(float(max(scale, 1)))).alias("betweenness"))
    made = materialize(every.join(shuffled(sums), "node", "left").fillna(0.0, ["betweenness"]))
    release(both, every)
    return made


def _local_dependencies(every: DataFrame, both: DataFrame, work: int, task: int = 1_000_000_000) -> DataFrame:
    """(node, dep) with the whole graph in every task, a share of the sources in each.

    ``work`` (sources times edges) is dealt out at about ``task`` edges a task, a few minutes.
    """
    pairs = both.toArrow()
    names, ends = np.unique(np.concatenate([pairs["src"].to_numpy(), pairs["dst"].to_numpy()]), return_inverse=True)
    src, dst = ends.reshape(2, -1)
    order = np.lexsort((dst, src))
    to, start = dst[order], np.append(0, np.cumsum(np.bincount(src, minlength=len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names))
        for batch in batches:
            at = np.searchsorted(names, own := batch["node"].to_numpy(zero_copy_only=False)) if len(names) else np.zeros(0, int)
            known = at[names[np.minimum(at, len(names) - 1)] == own] if len(names) else at
            total += _dependencies(start, to, len(names), known)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"node": pa.array(names[full], kind), "dep": total[full]})

    kind = pairs.schema.field("src").type
    width = max(every.sparkSession.sparkContext.defaultParallelism, -(-work // task))
    return every.repartition(width).mapInArrow(run, f"node {every.schema['node'].dataType.simpleString()}, dep double")


def _batch_dependencies(sources: DataFrame, both: DataFrame) -> DataFrame:
    """(node, dep) of the given sources; leaves one table."""
    hops, scales = [materialize(sources.select(F.col("node").alias("s"), "node").withColumn("paths", F.lit(1e0)))], [1.0]
    scale = 1.0
    while True:
        grown = hops[-1].withColumnRenamed("node", "src").join(both, "src").groupBy("s", F.col("dst").alias("node")).agg((F.sum("paths") * scale).alias("paths"))
        # a node next to hop d lies in hop d-1, d or d+1, so older hops need no check
        for old in hops[-2:]:
            grown = grown.join(old.select("s", "node"), ["s", "node"], "left_anti")
        grown = materialize(grown)
        least, most = grown.agg(F.min("paths"), F.max("paths")).first()
        if most is None:
            release(grown)
            break
        if least < 1 / _FULL:
            raise RuntimeError("path counts of one hop lie too far apart for tables; raise local_edges")
        hops.append(grown)
        scales.append(scale)
        scale = 1 / _FULL if most > _FULL else 1.0
    total, below, held = None, None, []  # dependencies of the next hop: (s, node, paths, dep)
    for k in range(len(hops) - 1, 0, -1):
        hop = hops[k]
        if below is None:
            now = hop.withColumn("dep", F.lit(0e0))
        else:
            share = below.select("s", F.col("node").alias("src"), ((1 + F.col("dep")) / F.col("paths")).alias("x"))
            back = share.join(both, "src").groupBy("s", F.col("dst").alias("node")).agg(F.sum("x").alias("x"))
            now = hop.join(back, ["s", "node"], "left").select("s", "node", "paths", (F.col("paths") * F.coalesce("x", F.lit(0e0)) * scales[k + 1]).alias("dep"))
        below = materialize(now)
        held.append(below)
        part = below.groupBy("node").agg(F.sum("dep").alias("dep"))
        total = part if total is None else total.unionByName(part)
    if total is None:
        return hops[0].select("node", F.lit(0e0).alias("dep"))
    made = materialize(total.groupBy("node").agg(F.sum("dep").alias("dep")))
    release(*hops, *held)
    return made


def pixel_regions(px: DataFrame, value: str) -> DataFrame:
    """Label 4-connected pixels of equal value: adds ``region`` (smallest pixel id)."""
    ids = px.where(F.col(value).isNotNull()).withColumn("node", cell_id("r", "c"))
    step = lambda dr, dc: ids.select("node", value, (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"))
    at = ids.select("r", "c", F.col("node").alias("dst"), F.col(value).alias("_v"))
    pairs = step(0, 1).unionByName(step(1, 0)).join(shuffled(at), ["r", "c"]).where(F.col(value) == F.col("_v"))
    comp = connected_components(ids, pairs.select(F.col("node").alias("src"), "dst"))
    return ids.join(shuffled(comp.withColumnRenamed("component", "region")), "node").drop("node")
