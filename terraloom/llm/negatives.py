"""Hard negatives among labelled image patches.

Method: vertical scan of decomposed vectors (BOND).  A block of patches is stored by
dimension, with the least and the largest value of each.  For one anchor the dimensions
are read in descending magnitude of the anchor's own components; after every few of them
the least and the largest sum that the dimensions still unread can add give each candidate
an interval for its score, and a bitmap keeps those that can still count.  What is left
after the last dimension has its exact score.

Two passes: the first keeps, per anchor, the best patches of the same cover class; the
second those of other classes whose scores lie in the windows that the positives' scores
open.  Anchors meet every block of patches, in tasks of bounded size; only the best of a
block leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terraloom.llm import words as w
from terraloom.scale import materialize

ROWS, ANCHORS, STEP = 16_384, 512, 8  # patches and anchors of a task, dimensions between two looks at the bitmap
LARGEST = 2**63 - 1


def scaled(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component as integers, a column per dimension; missing components are 0.

    Python integers take over where a score could leave 62 bits.
    """
    n = np.asarray(vectors.value_lengths(), np.int64)
    values = np.floor(256.0 * np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)))
    largest = float(np.abs(values).max()) if len(values) else 0.0
    if largest * largest * max(1, width) < 2.0**52:
        whole, kind = values.astype(np.int64), np.int64
    else:
        whole, kind = np.array([int(x) for x in values], object), object
    out = np.zeros((len(n), width), kind)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = whole
    return out


class Block:
    """Patches of a task by dimension."""

    def __init__(self, values: np.ndarray):
        self.columns = np.ascontiguousarray(values.T)
        self.low = self.columns.min(axis=1) if values.shape[0] else np.zeros(values.shape[1], values.dtype)
        self.high = self.columns.max(axis=1) if values.shape[0] else self.low

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that ``useful`` (low, high) never ruled out, and their exact scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        one, two = a * self.low[order], a * self.high[order]
        least = np.append(np.cumsum(np.minimum(one, two)[::-1])[::-1], 0)
        most = np.append(np.cumsum(np.maximum(one, two)[::-1])[::-1], 0)
        score = np.zeros(len(candidates), self.columns.dtype)
        for k in range(0, len(order), STEP):
            part = order[k : k + STEP]
            for d, x in zip(part, a[k : k + STEP]):
                score = score + x * self.columns[d][candidates]
            done = min(k + STEP, len(order))
            keep = useful(score + least[done], score + most[done])
            if not keep.all():
                candidates, score = candidates[keep], score[keep]
            if not len(candidates):
                break
        return candidates, score


def _kth(values: np.ndarray, k: int):
    """k-th largest value, or None if there are fewer."""
    return None if len(values) < k else np.sort(values)[len(values) - k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def _best(ids: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties by smaller id."""
    line = _kth(score, k)
    near = np.arange(len(rows)) if line is None else np.flatnonzero(score >= line)
    return near[np.lexsort((rows[near], ids[rows[near]], -score[near]))][:k]


def _top(block: Block, ids: np.ndarray, anchor: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates of a block."""

    def useful(low, high):
        line = _kth(low, k)
        return np.ones(len(low), bool) if line is None else np.asarray(high >= line, bool)

    rows, score = block.scan(anchor, candidates, useful)
    best = _best(ids, rows, score, k)
    return rows[best], score[best]


def window(positive: int) -> tuple[int, int]:
    """Scores s with 30 * positive <= 100 * s <= 90 * positive; empty for negative ones."""
    return -(-30 * positive // 100), 90 * positive // 100


def _in_windows(block: Block, ids: np.ndarray, anchor: np.ndarray, candidates: np.ndarray, positive_scores: list[int], k: int):
    """For each positive score the k best candidates of a block whose score lies in its window."""
    windows = [(s, *window(s)) for s in positive_scores]
    windows = [x for x in windows if x[1] <= x[2]]

    def useful(low, high):
        keep = np.zeros(len(low), bool)
        for _, a, b in windows:
            inside = np.asarray((high >= a) & (low <= b), bool)
            sure = np.asarray((low >= a) & (high <= b), bool)
            line = _kth(low[sure], k)
            keep |= inside if line is None else inside & np.asarray(high >= line, bool)
        return keep

    if not windows:
        return
    rows, score = block.scan(anchor, candidates, useful)
    for s, a, b in windows:
        inside = np.flatnonzero(np.asarray((score >= a) & (score <= b), bool))
        for i in inside[_best(ids, rows[inside], score[inside], k)]:
            yield s, rows[i], score[i]


def _whole(scores: list) -> list:
    return [max(-LARGEST - 1, min(LARGEST, int(s))) for s in scores]


def _search(patches: DataFrame, anchors: DataFrame, blocks: int, groups: int, width: int, visit, schema: str) -> DataFrame:
    """Each group of anchors meets each block of patches once; ``visit`` returns what leaves the task."""
    left = patches.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def task(these: pa.Table, those: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if these.num_rows and those.num_rows:
            values = [scaled(t[c].combine_chunks(), width) for t, c in ((these, "bands"), (those, "anchor_bands"))]
            if object in (v.dtype for v in values):
                values = [v.astype(object) for v in values]
            ids, at, label = (np.asarray(these[c].to_numpy(zero_copy_only=False)) for c in ("id", "at", "cover"))
            block = Block(values[0])
            for i, r in enumerate(those.drop_columns(["anchor_bands"]).to_pylist()):
                out += visit(block, ids, at, label, values[1][i], r)
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table({n: pa.array(_whole([r[k] for r in out]), pa.int64()) for k, n in enumerate(names)})

    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(task, schema)


def hard_negatives(patches: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives of each anchor patch and each of its positives.

    patches (image patches or pixels with the land-cover class they were labelled with):
    ``patch_id`` bigint, ``bands`` array of numbers (reflectances or any other features),
    ``cover`` int; further columns are not read.  A row with a null cover, a null vector or
    a null or non-finite component takes no part.  Every component x becomes
    floor(256 * x); a row's score is its inner product with the anchor, missing components
    of shorter vectors count 0, scores that leave 64 bits are compared exactly and returned
    as the nearest bigint.  Higher scores come first, ties by smaller patch_id, null ids
    last.

    Anchors are the rows whose patch_id is divisible by ``every``.  An anchor's positives
    are its first ``positives`` other rows of the same cover.  Returns, for each anchor and
    positive, the first ``negatives`` rows of another cover whose score s satisfies
    30 * positive_score <= 100 * s <= 90 * positive_score: ``anchor_id``, ``positive_id``,
    ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.  Repeated
    rows are rows of their own, each with its results.  An empty table gives an empty
    result.
    """
    ok = "cover is not null and bands is not null and forall(bands, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
    rows = patches.select(F.col("patch_id").cast("bigint").alias("patch_id"), F.col("bands").cast("array<double>").alias("bands"), F.col("cover").cast("bigint").alias("cover"))
    rows = materialize(rows.where(ok).withColumn("at", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("patch_id") % every == 0, 1)).alias("anchors"), F.max(F.size("bands")).alias("width")).first()
    blocks, groups, width = max(1, -(-size["n"] // ROWS)), max(1, -(-size["anchors"] // ANCHORS)), size["width"] or 0
    data = rows.select(
        F.coalesce("patch_id", F.lit(w.NULL_ID)).alias("id"), "at", "cover", "bands", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias("block"))
    anchors = rows.where(F.col("patch_id") % every == 0).select(
        F.col("patch_id").alias("anchor_id"), F.col("at").alias("anchor_at"), F.col("cover").alias("anchor_cover"), F.col("bands").alias("anchor_bands"),
        F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int").alias("group"))

    def same(block: Block, ids, at, label, anchor, r) -> list[tuple]:
        mates = np.flatnonzero((label == r["anchor_cover"]) & (at != r["anchor_at"]))
        found, score = _top(block, ids, anchor, mates, positives)
        return [(r["anchor_at"], ids[i], at[i], s) for i, s in zip(found, score)]

    best = lambda *order: F.row_number().over(W.partitionBy(*order[0]).orderBy(*order[1:]))
    near = _search(data, anchors, blocks, groups, width, same, "anchor_at bigint, positive bigint, positive_at bigint, positive_score bigint")
    near = materialize(near.withColumn("place", best(["anchor_at"], F.desc("positive_score"), "positive", "positive_at")).where(F.col("place") <= positives))
    wanted = near.groupBy("anchor_at").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # at most `positives` scores

    def other(block: Block, ids, at, label, anchor, r) -> list[tuple]:
        found = _in_windows(block, ids, anchor, np.flatnonzero(label != r["anchor_cover"]), r["scores"], negatives)
        return [(r["anchor_at"], s, ids[i], at[i], x) for s, i, x in found]

    far = _search(
        data, anchors.join(wanted, "anchor_at"), blocks, groups, width, other,
        "anchor_at bigint, positive_score bigint, negative bigint, negative_at bigint, negative_score bigint")
    far = far.withColumn("rank", best(["anchor_at", "positive_score"], F.desc("negative_score"), "negative", "negative_at")).where(F.col("rank") <= negatives)
    known = near.join(anchors.select("anchor_at", "anchor_id"), "anchor_at").join(far, ["anchor_at", "positive_score"])
    id_ = lambda c: F.when(F.col(c) != w.NULL_ID, F.col(c))
    return known.select("anchor_id", id_("positive").alias("positive_id"), "rank", id_("negative").alias("negative_id"), "positive_score", "negative_score")
