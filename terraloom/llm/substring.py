"""Removal of passages that an earlier lesson already has.

Method: fixed-block anchors.  Every lesson is cut into non-overlapping blocks of
``(window + 1) // 2`` words; these blocks are the index.  A repeat of ``window`` words
contains exactly one whole block of the earlier lesson, so probing the index with every
rolling block-long run of words finds each repeat.  Hits are then extended: all windows
around a hit are compared as whole, and neighbouring repeated windows join to maximal
repeats.

Lessons travel as groups of a few MB.  A group sends each bucket of the hash range one
packed row of distinct hashes (so a passage that a third of all lessons share costs one
entry per group), and gets one packed row back.  The text itself is shuffled once; the
later steps reuse that exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import words as w

KEY_BITS = 40
MESSAGE = "bucket bigint, part bigint, keys binary, lowest binary, anchors binary"
REPLY = "part bigint, keys binary, lowest binary"
RESULT = "lesson_id bigint, n_words bigint, n_removed bigint, repeats array<struct<first:bigint,last:bigint>>, kept string"


class _Group:
    """Words of one group of lessons."""

    def __init__(self, lessons: pa.Table, window: int):
        self.ids = w.ids_column(lessons["lesson_id"])
        self.data, self.offsets = w.column_bytes(lessons["body"])
        self.starts, self.ends = w.word_spans(self.data, self.offsets)
        self.row = w.rows_of(self.starts, self.offsets)
        self.begin = np.searchsorted(self.starts, self.offsets)
        self.hash = w.span_hash(self.data, self.starts, self.ends)
        self.window, self.block = window, (window + 1) // 2

    def runs(self, k: int) -> np.ndarray:
        """Positions at which ``k`` words of one lesson follow."""
        n = max(0, len(self.row) - k + 1)
        return np.flatnonzero(self.row[:n] == self.row[k - 1 : k - 1 + n])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of rolling runs, their hashes, and which of them are index blocks."""
        at = self.runs(self.block)
        key = w.window_hash(self.hash, self.block)[at] >> w.U(64 - KEY_BITS)
        return at, key, (at - self.begin[self.row[at]]) % self.block == 0


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the smallest id of each, and whether it has several ids."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    at = w.firsts(keys)
    if not len(at):
        return keys, ids, np.zeros(0, bool)
    low = np.minimum.reduceat(ids, at)
    return keys[at], low, np.maximum.reduceat(ids, at) != low


def _deal(part: int, keys: np.ndarray, bits: int, buckets: int, **values: np.ndarray) -> tuple[list, dict[str, list[bytes]]]:
    """Cut sorted keys into the buckets of their range."""
    edges = [(b << bits) // buckets for b in range(buckets)]
    cut = np.append(np.searchsorted(keys, np.array(edges, w.U)), len(keys))
    full = np.flatnonzero(np.diff(cut))
    out = {"keys": [w.sorted_planes(keys[cut[b] : cut[b + 1]]) for b in full]}
    for name, v in values.items():
        out[name] = [w.planes(v[cut[b] : cut[b + 1]]) for b in full]
    return [int(b) for b in full], out


def _flagged(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return (keys << w.U(1)) | flags.astype(w.U)


def _message(part: int, buckets: list, sent: dict, anchors: list) -> pa.Table:
    n = len(buckets)
    return pa.table({
        "bucket": pa.array(buckets, pa.int64()), "part": pa.array([part] * n, pa.int64()), "keys": pa.array(sent["keys"], pa.binary()),
        "lowest": pa.array(sent["lowest"], pa.binary()), "anchors": pa.array(anchors, pa.binary())})


def _send_anchors(part: int, g: _Group, buckets: int) -> pa.Table:
    """Per bucket: the distinct rolling runs, and the blocks with their smallest lesson."""
    at, key, is_block = g.anchors()
    ids = g.ids[g.row[at]]
    probe, _, several = _distinct(key, ids)
    to, sent = _deal(part, _flagged(probe, several), KEY_BITS + 1, buckets)
    block, low, _ = _distinct(key[is_block], ids[is_block])
    to_i, index = _deal(part, _flagged(block, np.zeros(len(block), bool)), KEY_BITS + 1, buckets, lowest=low)
    have = dict(zip(to_i, zip(index["keys"], index["lowest"])))
    sent["lowest"] = [have[b][1] if b in have else b"" for b in to]
    return _message(part, to, sent, [have[b][0] if b in have else b"" for b in to])


def _send_windows(part: int, g: _Group, replies: pa.Table, buckets: int) -> pa.Table:
    """Per bucket: the distinct windows around anchor hits with their smallest lesson."""
    at, key, is_block = g.anchors()
    hit, low = _lookup(replies, key, KEY_BITS)
    hit &= is_block | (low < g.ids[g.row[at]])
    near = np.zeros(len(g.row) + 1, np.int32)
    np.add.at(near, np.maximum(at[hit] - (g.window - g.block), 0), 1)
    near[at[hit] + 1] -= 1
    start = g.runs(g.window)
    start = start[np.cumsum(near)[start] > 0]
    keys, low, several = _distinct(w.window_hash(g.hash, g.window, 1)[start], g.ids[g.row[start]])
    # the lowest bit tells that several lessons of the group have the window
    keys = (keys & ~w.U(1)) | several.astype(w.U)
    to, sent = _deal(part, keys, 64, buckets, lowest=low)
    return _message(part, to, sent, [b""] * len(to))


def _lookup(replies: pa.Table, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the replies, and the smallest lesson told with it."""
    known = [w.unsorted_planes(x) for x in replies["keys"].to_pylist()]
    low = [w.unplanes(x, np.int64) for x in replies["lowest"].to_pylist()]
    found, lowest = np.zeros(len(keys), bool), np.full(len(keys), w.NULL_ID)
    if known and len(keys):
        known, low = np.concatenate(known), np.concatenate(low)
        order = np.argsort(known)
        known, low = known[order], low[order]
        slot = np.zeros(1 << 22, bool)  # most keys are in no reply and end here
        slot[known >> w.U(bits - 22)] = True
        maybe = np.flatnonzero(slot[keys >> w.U(bits - 22)])
        at = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
        same = known[at] == keys[maybe]
        found[maybe[same]] = True
        lowest[maybe[same]] = low[at[same]]
    return found, lowest


def _answer(messages: pa.Table, anchors: bool) -> pa.Table:
    """One bucket: tell each group which of its keys other lessons have, and the smallest of these."""
    parts = np.asarray(messages["part"].to_numpy())
    keys = [w.unsorted_planes(x) for x in messages["keys"].to_pylist()]
    source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    keys = np.concatenate(keys)
    several, keys = (keys & w.U(1)).astype(bool), keys >> w.U(1)
    if anchors:
        blocks = [w.unsorted_planes(x) >> w.U(1) for x in messages["anchors"].to_pylist() if x]
        lows = [w.unplanes(x, np.int64) for x in messages["lowest"].to_pylist() if x]
        known, low, _ = _distinct(np.concatenate(blocks), np.concatenate(lows)) if blocks else (np.zeros(0, w.U), np.zeros(0, np.int64), None)
    order = np.argsort(keys, kind="stable")
    keys, source, several = keys[order], source[order], several[order]
    at = w.firsts(keys)
    size = np.diff(np.append(at, len(keys)))
    shared = (size > 1) | np.logical_or.reduceat(several, at)
    if anchors:
        found = np.minimum(np.searchsorted(known, keys[at]), max(0, len(known) - 1))
        shared &= known[found] == keys[at] if len(known) else False
        lowest = low[found] if len(known) else np.zeros(len(at), np.int64)
    else:
        ids = np.concatenate([w.unplanes(x, np.int64) for x in messages["lowest"].to_pylist()])[order]
        lowest = np.minimum.reduceat(ids, at)
    take = np.repeat(shared, size)
    keys, source, lowest = keys[take], source[take], np.repeat(lowest, size)[take]
    order = np.argsort(source, kind="stable")  # within a group the keys stay sorted
    keys, source, lowest = keys[order], source[order], lowest[order]
    at = w.firsts(source)
    end = np.append(at[1:], len(source)).astype(np.int64)
    return pa.table({
        "part": pa.array(parts[source[at]], pa.int64()),
        "keys": pa.array([w.sorted_planes(keys[a:b]) for a, b in zip(at, end)], pa.binary()),
        "lowest": pa.array([w.planes(lowest[a:b]) for a, b in zip(at, end)], pa.binary())})


def _cut(g: _Group, replies: pa.Table, passed: dict[str, pa.ChunkedArray]) -> pa.Table:
    """Remove the words of windows that start in an earlier lesson."""
    n = len(g.row)
    start = g.runs(g.window)
    hit, low = _lookup(replies, w.window_hash(g.hash, g.window, 1)[start] >> w.U(1), 63)
    start = start[hit & (low < g.ids[g.row[start]])]
    delta = np.zeros(n + 1, np.int32)
    delta[start] += 1
    delta[start + g.window] -= 1
    gone = np.cumsum(delta[:n]) > 0
    rows = len(g.ids)
    n_words = np.diff(g.begin)
    n_removed = np.bincount(g.row[gone], minlength=rows)
    # maximal repeats: runs of removed words within a lesson
    before = np.ones(n, bool)
    if n:
        before[1:] = ~gone[:-1] | (g.row[1:] != g.row[:-1])
    first = np.flatnonzero(gone & before)
    after = np.ones(n, bool)
    if n:
        after[:-1] = ~gone[1:] | (g.row[1:] != g.row[:-1])
    last = np.flatnonzero(gone & after)
    base = g.begin[:-1]
    per_row = np.append(0, np.cumsum(np.bincount(g.row[first], minlength=rows)))
    spans = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(first - base[g.row[first]], pa.int64()), pa.array(last - base[g.row[first]], pa.int64())], ["first", "last"]))
    return pa.table({
        "lesson_id": pa.array(g.ids, pa.int64(), mask=g.ids == w.NULL_ID), "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()), "repeats": spans, "kept": _joined(g, ~gone), **passed})


def _joined(g: _Group, keep: np.ndarray) -> pa.Array:
    """Kept words of each lesson joined by one space."""
    at = np.flatnonzero(keep)
    rows = g.row[at]
    more = np.zeros(len(at), bool)  # another kept word of the lesson follows
    more[:-1] = rows[1:] == rows[:-1]
    mark = np.zeros(len(g.data) + 2, np.int8)
    mark[g.starts[at]] += 1
    mark[g.ends[at] + more] -= 1
    take = np.cumsum(mark[: len(g.data)], dtype=np.int8) > 0
    size = np.bincount(rows, weights=g.ends[at] - g.starts[at] + more, minlength=len(g.ids)).astype(np.int64)
    return w.text_column(np.where(w.spaces(g.data), np.uint8(32), g.data)[take], np.append(0, np.cumsum(size)))


def remove_repeats(
    lessons: DataFrame, window: int = 13, group_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, keep: Sequence[str] = ()
) -> DataFrame:
    """Cut from each lesson the passages that a lesson with a smaller ``lesson_id`` has too.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns are not read, those in
    ``keep`` are passed on (an error where one is named like a result).  A word
    is a run of characters other than space and 09-0D.  A word goes when a run of
    ``window`` words that covers it also starts in a lesson with a smaller id; runs are
    judged on the given bodies.  Returns per row ``lesson_id``, ``n_words``,
    ``n_removed``, ``repeats`` (word ranges cut, first and last inclusive, maximal) and
    ``kept`` (the other words joined by one space).

    A null or blank body has no words and an empty ``kept``.  Rows with the same id do not
    cut each other; a null id counts as larger than every other.  An empty table gives an
    empty result.  Bodies of any length are read whole.

    ``group_bytes`` and ``bucket_bytes`` bound the text and the hashes that one task holds.
    Lessons are placed by id and body, so one id may hold any share of the rows; rows equal
    in both stay together.
    Runs are compared by 63-bit hashes of whole windows.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    w.unlike(keep, ("lesson_id", "n_words", "n_removed", "repeats", "kept"))
    size, width = w.text_bytes(lessons, "body"), w.shuffle_width(lessons)
    groups, buckets = max(width, math.ceil(size / group_bytes)), max(width, math.ceil(size / bucket_bytes))
    placed = lessons.select(
        F.col("lesson_id").cast("bigint").alias("lesson_id"), "body", *[F.col(c).alias(f"keep_{c}") for c in keep],
        F.pmod(F.xxhash64("lesson_id", "body", F.lit(1)), F.lit(groups)).alias("part"))
    by_part, kinds = placed.groupBy("part"), dict(lessons.dtypes)

    def anchors_out(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return w.tidied(_send_anchors, key[0].as_py(), _Group(table, window), buckets)

    def windows_out(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        return w.tidied(_send_windows, key[0].as_py(), _Group(table, window), replies, buckets)

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        return w.tidied(_cut, _Group(table, window), replies, {c: table[f"keep_{c}"] for c in keep})

    def answered(sent: DataFrame, anchors: bool) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lambda table: w.tidied(_answer, table, anchors), REPLY)

    shared = answered(by_part.applyInArrow(anchors_out, MESSAGE), True)
    repeated = answered(by_part.cogroup(shared.groupBy("part")).applyInArrow(windows_out, MESSAGE), False)
    return by_part.cogroup(repeated.groupBy("part")).applyInArrow(
        cut, ", ".join([RESULT, *[f"`{c}` {kinds[c]}" for c in keep]]))
