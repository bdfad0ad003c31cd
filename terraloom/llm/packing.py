"""Packing of lessons into training sequences of a fixed number of tokens.

Method: bin completion.  Only lengths matter, so the search runs on the histogram of piece
lengths, which has fewer rows than a sequence has tokens however many lessons there are.
Best-fit decreasing gives the first incumbent, sums of lengths a lower bound.  The search
branches over sequences: around the largest length left it takes the undominated fillings,
least waste first, each as often as the histogram allows and then less often; a branch ends
where its waste leaves no sequence to be saved against the incumbent, the search where the
bound is met, nothing is left to try, or ``budget`` steps are used up.  The result is a list
of patterns; each piece finds its place from its rank among the pieces of its length, which
Spark computes over range partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import bpe
from terraloom.llm import words as w
from terraloom.scale import materialize, running_total

PIECE = "lesson_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; only the first may be shorter than ``room``."""
    first = (n - 1) % room + 1
    return [(0, first), *((s, room) for s in range(first, n, room))]


def completion(sizes: list[int], counts: Mapping[int, int], room: int) -> list[int]:
    """Lengths (descending) that fill ``room`` with the least waste.

    sizes: ascending distinct lengths with a count left.  States (room left, largest
    length allowed) that were searched in vain are not entered again.
    """
    best: list[int] = []
    best_waste = room
    chosen: list[int] = []
    vain: set[tuple[int, int]] = set()

    # total of all pieces up to each length bounds what a branch can still fill
    totals = np.minimum(np.cumsum([s * counts[s] for s in sizes]), 1 << 60).tolist() if sizes else []

    def sum_below(k: int, left: int) -> int:
        return min(left, totals[k])

    def enter(left: int, top: int, again: int) -> None:
        """Go on to fill ``left`` from sizes[:top]; of sizes[top - 1] only ``again`` are left."""
        nonlocal best, best_waste
        if left < best_waste:
            best, best_waste = chosen[:], left
        stack.append([left, top, again, min(top, bisect_right(sizes, left)) - 1])

    # not recursive: a sequence may hold as many pieces as it has tokens
    stack: list[list[int]] = []
    enter(room, len(sizes), counts[sizes[-1]] if sizes else 0)
    while stack and best_waste:
        left, top, again, k = stack[-1]
        # no filling from here down can use more than this, so less waste is out of reach
        if k < 0 or left - sum_below(k, left) >= best_waste:
            stack.pop()
            if stack:
                chosen.pop()
                vain.add((left, top - 1, again + 1))
            continue
        stack[-1][3] = k - 1
        size = sizes[k]
        have = again if k == top - 1 else counts[size]
        if have >= 1 and (left - size, k, have) not in vain:
            chosen.append(size)
            enter(left - size, k + 1, have - 1)
    return best


def best_fit(histogram: Mapping[int, int], room: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing as patterns (times used, lengths in descending order).

    Sequences with equal contents are handled together: a piece goes where it leaves the
    least room, so the fullest sequence that it fits into takes pieces until it is full.
    """
    open_: dict[int, list[list]] = {}  # room left: patterns and how many sequences have them
    rooms: list[int] = []

    def put(left: int, times: int, lengths: list[int]) -> None:
        if left not in open_:
            open_[left] = []
            insort(rooms, left)
        open_[left].append([times, lengths])

    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        n = histogram[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                times, lengths, left = -(-n // (room // size)), [], room
            else:
                left = rooms[at]
                times, lengths = open_[left].pop()
                if not open_[left]:
                    del open_[left], rooms[at]
            each = left // size
            whole = min(times, n // each)
            if whole:
                put(left - each * size, whole, lengths + [size] * each)
                n, times = n - whole * each, times - whole
            if times and n:
                put(left - n * size, 1, lengths + [size] * n)
                n, times = 0, times - 1
            if times and lengths:
                put(left, times, lengths)
    return [(times, lengths) for groups in open_.values() for times, lengths in groups]


def fewest(histogram: Mapping[int, int], room: int) -> int:
    """Lower bound on the number of sequences: pieces over half the room stand apart, and shorter ones from any length on need what these leave."""
    if not any(histogram.values()):
        return 0
    count = np.zeros(room + 1, np.int64)
    for s, n in histogram.items():
        count[s] += n
    pieces, tokens = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * np.arange(room + 1)))
    within = lambda run, a, b: run[b + 1] - run[a] if b >= a else 0  # noqa: E731  over lengths a..b
    half, best = room // 2, 0
    for k in range(half + 1):
        alone, apart = within(pieces, room - k + 1, room), within(pieces, half + 1, room - k)
        need = within(tokens, max(k, 1), half) - (apart * room - within(tokens, half + 1, room - k))
        best = max(best, alone + apart + max(0, -(-need // room)))
    return int(best)


def _dominated(small: list[int], large: list[int]) -> bool:
    """Whether the pieces of ``small`` fit into the places of the pieces of ``large`` (both in descending order)."""
    left = large[:]
    for s in small:
        fit = [i for i, x in enumerate(left) if x >= s]
        if not fit:
            return False
        left[min(fit, key=left.__getitem__)] -= s
    return True


def fillings(sizes: list[int], counts: Mapping[int, int], room: int, waste: int, steps: int) -> tuple[list[list[int]], int]:
    """Undominated ways to fill ``room`` with at most ``waste`` left over, least waste first, and the steps used.

    The filling with the least waste is always among them; ``steps`` bounds the search for the others.
    """
    first = completion(sizes, counts, room)
    found, used = [first], 0
    stack = [(room, len(sizes) - 1, [], dict(counts))] if sizes and steps else []
    while stack and used < steps:
        left, k, chosen, have = stack.pop()
        used += 1
        k = min(k, bisect_right(sizes, left) - 1)
        while k >= 0 and not have[sizes[k]]:
            k -= 1
        if k < 0:
            if left <= waste and chosen != first:
                found.append(chosen)
            continue
        size = sizes[k]
        stack.append((left, k - 1, chosen, have))
        stack.append((left - size, k, [*chosen, size], {**have, size: have[size] - 1}))
    found = [f for f in found if room - sum(f) <= waste]
    found.sort(key=lambda f: (-sum(f), [-x for x in f]))
    kept: list[list[int]] = []
    for f in found:
        if not any(f == g or _dominated(f, g) for g in kept):
            kept.append(f)
    return kept, used


def packing_plan(histogram: Mapping[int, int], room: int, budget: int = 100_000) -> list[tuple[int, list[int]]]:
    """Patterns (times used, lengths in descending order) that place every piece.

    Never more sequences than best-fit decreasing; the fewest possible if the search ends within ``budget`` steps
    after its first way down.
    """
    counts = {s: n for s, n in histogram.items() if n}
    incumbent = best_fit(counts, room)
    best, bound = sum(t for t, _ in incumbent), fewest(counts, room)
    total = sum(s * n for s, n in counts.items())
    sizes = sorted(counts)
    path: list[tuple[int, list[int]]] = []
    used = waste = 0

    def change(times: int, lengths: list[int]) -> None:
        """Take ``times`` sequences out of the counts; give them back if negative."""
        nonlocal waste
        waste += times * (room - sum(lengths))
        for s in dict.fromkeys(lengths):
            old = counts.get(s, 0)
            counts[s] = old - times * lengths.count(s)
            if not old:
                insort(sizes, s)
            elif not counts[s]:
                del sizes[bisect_left(sizes, s)]

    def moves() -> Iterator[tuple[int, list[int]]]:
        """Sequences around the largest length: the least waste first, further fillings when the search comes back."""
        nonlocal used
        tried: list[list[int]] = []
        for first in (True, False):
            steps = 0 if first else min(2000, budget - used)
            if not first and steps <= 0:
                return
            top = sizes[-1]
            counts[top] -= 1
            if not counts[top]:
                sizes.pop()
            ways, took = fillings(sizes, counts, room - top, (best - 1) * room - total - waste, steps)
            counts[top] += 1
            if counts[top] == 1:
                sizes.append(top)
            used += took
            for way in ways:
                if way in tried:
                    continue
                tried.append(way)
                lengths = [top, *way]
                times = min(counts[s] // lengths.count(s) for s in set(lengths))
                while times:  # as often as possible, then less often
                    yield times, lengths
                    times //= 2

    allowed = lambda: (best - 1) * room - total
    stack = [moves()] if sizes and best > bound else []
    down = True  # the first way down is free
    while stack and best > bound and used < budget:
        move = next(stack[-1], None)
        used += not down
        if move is None:
            stack.pop()
            down = False
            if path:
                times, lengths = path.pop()
                change(-times, lengths)
            continue
        times, lengths = move
        if waste + times * (room - sum(lengths)) > allowed():
            down = False
            continue
        change(times, lengths)
        path.append(move)
        if not sizes:
            incumbent, best = path[:], sum(t for t, _ in path)
            down = False
            path.pop()
            change(-times, lengths)
            continue
        if allowed() - waste < 0:
            path.pop()
            change(-times, lengths)
            continue
        stack.append(moves())
    return incumbent


def _places(plan: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Per length and pattern, ordered: length, first rank, pieces a sequence, first sequence, first offset."""
    rows, ranks, sequence = [], {}, 0
    for times, lengths in plan:
        offset = 0
        for size in dict.fromkeys(lengths):
            k = lengths.count(size)
            rank = ranks.get(size, 0)
            rows.append((size, rank, k, sequence, offset))
            ranks[size] = rank + times * k
            offset += size * k
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def lesson_pieces(lessons: DataFrame, path: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of each lesson: its ids and ``end_id``, cut where they are longer than ``room``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.encoder(path)
        for batch in batches:
            for a, b in bpe.slices(batch["body"]):
                ids, per_text = tool(*w.column_bytes(batch["body"].slice(a, b - a)))
                out = []
                for lesson, p, q in zip(batch["lesson_id"].slice(a, b - a).to_pylist(), per_text[:-1].tolist(), per_text[1:].tolist()):
                    own = np.append(ids[p:q], end_id).astype("<u4")
                    out += [(lesson, k, s, n, zlib.crc32(own[s : s + n])) for k, (s, n) in enumerate(cut(len(own), room))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["lesson_id", "piece", "start", "length", "ids_crc32"])

    return lessons.selectExpr("cast(lesson_id as bigint) lesson_id", "body").mapInArrow(w.tidy(pieces), PIECE)


def pack_lessons(lessons: DataFrame, path: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all lessons into as few sequences of at most ``room`` tokens as bin completion finds.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns are not read.  ``path``
    is a file of the tokenizers library.  A lesson's tokens are its ids and ``end_id``; only
    lessons longer than ``room`` are cut, from the end, so the first piece may be shorter.
    Returns a row per piece: ``lesson_id``, ``piece``, ``start``, ``length``, ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers), ``sequence_id``, ``offset``.
    A null body is empty and gives one piece with ``end_id``.  Rows with the same id are
    packed each on its own.  An empty table gives an empty result.
    """
    pieces = materialize(lesson_pieces(lessons, path, room, end_id).withColumn("at", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in pieces.where(F.col("length") < room).groupBy("length").count().collect()}  # below `room` rows
    size, rank, per, sequence, offset = _places(packing_plan(histogram, room))
    key = size << 44 | rank  # ordered by length, then rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, r = (np.asarray(batch[c].to_numpy(zero_copy_only=False), np.int64) for c in ("length", "rank"))
            at = np.asarray(batch["at"].to_numpy(zero_copy_only=False), np.int64)
            if len(key):
                k = np.maximum(np.searchsorted(key, length << 44 | (r - 1), side="right") - 1, 0)
                turn, inside = np.divmod(r - 1 - rank[k], per[k])
                seq, off = sequence[k] + turn, offset[k] + inside * length
            else:
                seq = off = np.zeros(len(r), np.int64)
            whole = length == room  # alone in its sequence
            yield pa.RecordBatch.from_pydict({
                **{c: batch[c] for c in ("lesson_id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": pa.array(np.where(whole, 2 * at + 1, 2 * seq), pa.int64()), "offset": pa.array(np.where(whole, 0, off), pa.int64())})

    ranked = running_total(pieces, ["at"], keys=("length",), out="rank").withColumn("rank", F.col("rank").cast("bigint"))
    return ranked.mapInArrow(w.tidy(place), PIECE + ", sequence_id bigint, offset bigint")
