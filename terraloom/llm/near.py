"""Near copies among lessons.

Method: order MinHash.  The sketch of a lesson holds, for each of ``bands`` hash
functions, the ``picks`` smallest of its occurrence-labelled shingles in the order in which
they stand in the text, so it answers to edit similarity and not only to shared content.
Lessons that agree in a band are candidates; a banded alignment of their shingles decides.
What no band finds an exact prefix filter does: a text linked to another shares at least
``least`` of its shingles with it, so both have a common one among their first in any order of
all shingles that leave out fewer than that.

Equal bodies are one node from the start.  All texts are placed once, in lots; lots send their
shingles' hashes, cut short, to ranges that count them.  Only texts whose shingles that other
texts have are enough for a link go on, with their sketch and, as buckets, their rarest shared
shingles.  Of these, first each node is aligned with one leader of
its buckets; then small buckets are searched whole for links between the classes so far.
Members of large buckets that can have no link leave them: a node's shingles that no other
node of a large bucket has bound what it can share, and the shortest text of the bucket
bounds what it must.  This is exact, and takes most texts out that only have a passage or
an origin in common.  The rest is dealt into random blocks: one task joins the classes of a
block and returns at most one link a member, and rounds with new blocks go on as long as
classes merge.  This is done for the bands and then for the buckets of the prefix filter, of
which large ones that still hold several classes are then searched whole, one task a pair of
blocks; a pair of texts is compared in the first bucket it shares, and not at all within a
class.  Only links leave a task, so no bucket is expanded into rows of pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import bpe
from terraloom.llm import words as w
from terraloom.operators.network import connected_components
from terraloom.scale import materialize, release

LARGEST = w.U(2**64 - 1)
# Sizes of tasks.  None changes what is compared: each pair of classes that shares a bucket is joined, ruled out by an exact
# bound or compared.
SMALL = 32  # buckets with at most this many members are searched whole, in one row
BLOCK = 128  # larger ones in random blocks of about this many
HALF = 256  # and, as long as they hold several classes, in pairs of blocks of about this many
HALF_SHINGLES = 1 << 18  # or of about this many shingles
LOT = 400_000  # shingles of a task that looks for those of one node only
CLASS_LOT = 1 << 20  # shingles of a task that sends all of its texts, at about six bytes each; four times as many of one that counts them
CUT = w.U(24)  # bits of a shingle's hash that are not sent


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled hashes of every run of ``k`` words in text order, and the offsets of each text.

    The label tells how often the same run stood before in the text.  A text of fewer
    words has one shingle, all of it; one without words has none.
    """
    data, offsets = w.column_bytes(texts)
    starts, ends = w.word_spans(data, offsets)
    h, row, begin = w.span_hash(data, starts, ends), w.rows_of(starts, offsets), np.searchsorted(starts, offsets)
    n = np.diff(begin)
    last = max(0, len(row) - k + 1)
    at = np.flatnonzero(row[:last] == row[k - 1 : k - 1 + last])
    value = w.window_hash(h, k)[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        padded = np.full((len(short), k), w.U(1))
        for j in range(k):
            have = j < n[short]
            padded[have, j] = h[begin[short[have]] + j]
        at = np.concatenate([at, begin[short]])
        value = np.concatenate([value, w.mix((padded * w.mix(np.arange(7, 7 + k, dtype=w.U))).sum(axis=1, dtype=w.U))])
        order = np.argsort(at)
        at, value = at[order], value[order]
    own = w.mix(value + w.mix(row[at].astype(w.U) + w.U(1)))
    twice = np.sort(own)
    twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
    turn = np.zeros(len(own), np.int64)
    if len(twice):
        again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own)
        order = again[np.argsort(own[again], kind="stable")]
        first = w.firsts(own[order])
        size = np.diff(np.append(first, len(order)))
        turn[order] = np.arange(len(order)) - np.repeat(first, size)
    value = np.where(turn > 0, w.mix(value + turn.astype(w.U) * w.U(0x9E3779B97F4A7C15)), value)
    return value, np.append(0, np.cumsum(np.bincount(row[at], minlength=len(n))))


def sketches(labels: np.ndarray, offsets: np.ndarray, bands: int, picks: int) -> np.ndarray:
    """Order MinHash values, a row per text with shingles and a column per band."""
    n = np.diff(offsets)
    out = np.zeros((len(n), bands), w.U)
    weight = w.mix(np.arange(1, picks + 1, dtype=w.U)) | w.U(1)
    few = np.flatnonzero((n > 0) & (n < picks))
    for r in few:
        out[r] = w.mix((labels[offsets[r] : offsets[r + 1]] * weight[: n[r]]).sum(dtype=w.U))
    many = np.flatnonzero(n >= picks)
    if not len(many):
        return out
    own = labels[bpe.ragged(offsets[many], n[many])]
    start = np.cumsum(n[many]) - n[many]
    for band in range(bands):
        g = w.mix(own + w.mix(np.array([band + 101], w.U)))
        places = np.empty((picks, len(many)), np.int64)
        for p in range(picks):
            low = np.minimum.reduceat(g, start)
            hit = np.flatnonzero(g == np.repeat(low, n[many]))
            if len(hit) > len(many):  # equal hashes within a text: the first one counts
                hit = hit[np.searchsorted(hit, start)]
            places[p] = hit
            g[hit] = LARGEST
        places.sort(axis=0)
        out[many, band] = w.mix((own[places] * weight[:, None]).sum(axis=0, dtype=w.U))
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: float) -> int:
    """Largest number of shared labelled shingles in the same order, at most ``band`` places apart."""
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    j = order[at]
    i = np.flatnonzero(b[j] == a)
    j = j[i]
    j = j[np.abs(i - j) <= band]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned shingles over all shingles of both; 0 where that is surely below ``least``.

    Two texts with at least this similarity have at most
    (1 - least) / (1 + least) * (len(a) + len(b)) shingles outside the alignment, so a
    band of this width loses nothing.
    """
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a):
        return 0.0
    common = aligned(a, b, (1 - least) / (1 + least) * (len(a) + len(b)) + 1e-9)
    return common / (len(a) + len(b) - common)


def _links(pairs: DataFrame, bodies: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose bodies are at least ``least`` similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for a, b in bpe.slices(batch["body_a"], 1 << 20):
                la, oa = shingles(batch["body_a"].slice(a, b - a), k)
                for c, d in bpe.slices(batch["body_b"].slice(a, b - a), 1 << 20):
                    lb, ob = shingles(batch["body_b"].slice(a + c, d - c), k)
                    for r in range(c, d):
                        good[a + r] = similarity(la[oa[r] : oa[r + 1]], lb[ob[r - c] : ob[r - c + 1]], least) >= least
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"]}).filter(pa.array(good))

    both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a").join(
        bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    return both.select("a", "b", "body_a", "body_b").mapInArrow(w.tidy(verify), "a binary, b binary")


def _pairs(groups: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes within ``mates`` (arrays of node, class, n) whose numbers of shingles allow a link."""
    one = groups.select("mates", F.explode("mates").alias("x"))
    two = one.select("x", F.explode("mates").alias("y")).where("x.node < y.node and x.class != y.class")
    return two.where(F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _mates() -> list:
    return [F.collect_list(F.struct("node", "class", "n")).alias("mates")]


def _with_leader(members: DataFrame, leaders: DataFrame, least: float) -> DataFrame:
    both = members.join(leaders, "bucket").where((F.col("class") != F.col("leader.class")) & (
        F.least("n", "leader.n") >= F.lit(least) * F.greatest("n", "leader.n")))
    return both.select("node", F.col("leader.node").alias("to"), *[c for c in leaders.columns if c not in ("bucket", "leader")])


def _first_pairs(members: DataFrame, least: float) -> DataFrame:
    """Each node with that leader of its buckets that meets the most others."""
    size = members.groupBy("bucket").agg(F.count("*").alias("size"))
    degree = members.join(size, "bucket").groupBy("node").agg(F.sum("size").alias("degree"))
    leaders = members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node", "class", "n")).alias("leader"))
    met = _with_leader(members, leaders.withColumn("degree", F.col("leader.degree")), least)
    best = met.groupBy("node").agg(F.max(F.struct("degree", "to")).alias("best"))
    return best.select(F.least("node", "best.to").alias("a"), F.greatest("node", "best.to").alias("b")).distinct()


def _small_pairs(members: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """All pairs between classes in buckets of at most ``SMALL`` members."""
    small = members.join(sizes.where((F.col("size") <= SMALL) & (F.col("low") != F.col("high"))).select("bucket"), "bucket")
    return _pairs(small.groupBy("bucket").agg(*_mates()), least).distinct()


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high"))


def _common(owner: np.ndarray, values: np.ndarray, m: int) -> np.ndarray:
    """How many values each two of ``m`` owners have in common."""
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, common = owner[shared], np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (c, c + 4096))
        has = np.zeros((m, 4096), np.float32)
        has[owner[a:b], column[a:b] - c] = 1
        common += has @ has.T
    return common


def _block(nodes: list, classes: list, texts: pa.Array, k: int, least: float, here: np.ndarray | None = None) -> list[tuple]:
    """Links that join the classes of one block; every pair of classes is either joined or has no link here.

    here: tells for every two members whether they are compared in this block; all are without it.
    """
    labels, offsets = shingles(texts, k)
    m, n = len(nodes), np.diff(offsets)
    owner = np.repeat(np.arange(m), n)
    common = _common(owner, labels, m)
    root = {c: c for c in classes}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    # shared shingles in any order bound the aligned ones from above
    maybe = np.triu(common * (1 + least) >= least * (n[:, None] + n[None, :]) - 1e-3, 1)
    for i, j in zip(*np.nonzero(maybe if here is None else maybe & here)):
        a, b = find(classes[i]), find(classes[j])
        if a != b and similarity(labels[offsets[i] : offsets[i + 1]], labels[offsets[j] : offsets[j + 1]], least) >= least:
            root[a] = b
            out.append((nodes[i], nodes[j]))
    w.give_back()
    return out


def _lot_tokens(lots: int, k: int):
    """Per range of shingles: the distinct ones of a lot, and which of them several of its nodes have."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        labels, _ = shingles(table["body"].combine_chunks(), k)
        value, often = np.unique(labels, return_counts=True)
        cut = np.searchsorted(value, np.array([(p << 64) // lots for p in range(1, lots)], w.U))
        w.give_back()
        return pa.table({
            "part": pa.array(np.arange(lots), pa.int64()), "lot": pa.array([key[0].as_py()] * lots, pa.int64()),
            "tokens": pa.array([w.sorted_planes(x) for x in np.split(value, cut)], pa.binary()),
            "several": pa.array([(x > 1).tobytes() for x in np.split(often, cut)], pa.binary())})

    return send


def _shared_tokens(table: pa.Table) -> pa.Table:
    """Of one range: for each lot, whether its shingles belong to several nodes."""
    tokens = [w.unsorted_planes(x) for x in table["tokens"].to_pylist()]
    size = [len(x) for x in tokens]
    value, at, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    several = np.concatenate([np.frombuffer(x, bool) for x in table["several"].to_pylist()])
    shared = often > 1
    shared[at[several]] = True
    return pa.table({"lot": table["lot"], "part": table["part"], "shared": pa.array(
        [x.tobytes() for x in np.split(shared[at], np.cumsum(size)[:-1])], pa.binary())})


def _linkable(members: DataFrame, sizes: DataFrame, bodies: DataFrame, k: int, least: float, turns: int = 2) -> DataFrame:
    """Members (bucket, node, n) of large buckets with several classes, without those that can have no link there.

    A link of x and y needs at least least / (1 + least) * (n_x + n_y) common shingles; x has at most its shingles
    that another node has, and n_y is at least the least n of the bucket and least * n_x.
    """
    large = sizes.where((F.col("size") > SMALL) & (F.col("low") != F.col("high"))).select("bucket")
    rows = materialize(members.join(large, "bucket").select("bucket", "node", "n"))
    for _ in range(turns):
        nodes = rows.select("node", "n").distinct()
        lots = max(1, -(-(nodes.agg(F.sum("n")).first()[0] or 0) // LOT))
        hot = nodes.join(bodies, "node").select("node", "body", F.pmod(F.xxhash64("node"), F.lit(lots)).alias("lot"))
        sent = hot.groupBy("lot").applyInArrow(_lot_tokens(lots, k), "part bigint, lot bigint, tokens binary, several binary")
        answer = sent.groupBy("part").applyInArrow(_shared_tokens, "lot bigint, part bigint, shared binary")

        def count(table: pa.Table, replies: pa.Table) -> pa.Table:
            labels, offsets = shingles(table["body"].combine_chunks(), k)
            shared = np.frombuffer(b"".join(replies.sort_by("part")["shared"].to_pylist()), bool)
            own = shared[np.searchsorted(np.unique(labels), labels)] if len(labels) else np.zeros(0, bool)
            run = np.append(0, np.cumsum(own))[offsets]
            return pa.table({"node": table["node"], "shared": pa.array(np.diff(run), pa.int64())})

        counts = hot.groupBy("lot").cogroup(answer.groupBy("lot")).applyInArrow(count, "node binary, shared bigint")
        shortest = rows.groupBy("bucket").agg(F.min("n").alias("shortest"))
        needs = least / (1 + least) * (F.col("n") + F.greatest("shortest", least * F.col("n"))) - 1e-6
        kept = materialize(rows.join(counts, "node").join(shortest, "bucket").where(F.col("shared") >= needs).select("bucket", "node", "n"))
        release(rows)
        rows = kept
    return rows


def _first_places(row: np.ndarray, count: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of entries that ``order`` sorts by ``row``, the places of the first ``count`` of each row."""
    start = np.searchsorted(row[order], np.arange(len(count)))
    return order[bpe.ragged(start, count)]


def _needed(n: np.ndarray, least: float) -> np.ndarray:
    """Shingles that a text with ``n`` shares with every one it is linked to, at least."""
    return np.maximum(1, np.ceil(least * n - 1e-6)).astype(np.int64)


def _once(table: pa.Table) -> pa.Table:
    """One row of each node."""
    _, at = np.unique(np.asarray(table["node"].combine_chunks().dictionary_encode().indices), return_index=True)
    return table.take(pa.array(at))


def _in_lots(bodies: DataFrame, lots: int) -> DataFrame:
    """Rows (node, body, lot); equal bodies lie in one lot, and of those that lie together in the input one goes there."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _once(pa.Table.from_batches([batch])).to_batches()

    one = bodies.select("node", "body").mapInArrow(w.tidy(once), "node binary, body string")
    return one.withColumn("lot", F.pmod(F.xxhash64("node"), F.lit(lots))).repartition("lot")


def _lot_counts(parts: int, k: int):
    """Per range of shingles: the distinct ones of a lot, cut to their first bits, and how many its nodes have."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        labels, _ = shingles(_once(table)["body"].combine_chunks(), k)
        value, often = np.unique(labels >> CUT, return_counts=True)
        often = np.minimum(often, 255).astype(np.uint8)
        cut = np.searchsorted(value, np.array([(p << 64 - int(CUT)) // parts for p in range(1, parts)], w.U))
        w.give_back()
        return pa.table({
            "part": pa.array(np.arange(parts), pa.int64()), "lot": pa.array([key[0].as_py()] * parts, pa.int64()),
            "tokens": pa.array([w.sorted_planes(x) for x in np.split(value, cut)], pa.binary()),
            "often": pa.array([x.tobytes() for x in np.split(often, cut)], pa.binary())})

    return send


def _ranks(table: pa.Table) -> pa.Table:
    """Of one range: for each lot a byte a shingle, 0 where one node alone has it, else larger the more nodes have it."""
    tokens = [w.unsorted_planes(x) for x in table["tokens"].to_pylist()]
    size, tokens = [len(x) for x in tokens], np.concatenate(tokens)
    often = np.frombuffer(b"".join(table["often"].to_pylist()), np.uint8)
    order = np.argsort(tokens)
    ends = np.append(w.firsts(tokens[order]), len(tokens))
    total = np.diff(np.append(0, np.cumsum(often[order], dtype=np.int64))[ends])
    rank = np.empty(len(tokens), np.uint8)
    rank[order] = np.repeat(np.where(total > 1, np.minimum(255, np.ceil(8 * np.log2(np.maximum(1, total)))), 0).astype(np.uint8), np.diff(ends))
    out = pa.table({"lot": table["lot"], "part": table["part"], "ranks": pa.array([x.tobytes() for x in np.split(rank, np.cumsum(size)[:-1])], pa.binary())})
    w.give_back()
    return out


def _linked_nodes(bodies: DataFrame, k: int, least: float, bands: int, picks: int) -> DataFrame:
    """The nodes that can have a link, with n, body, sketch and the prefix filter's buckets.

    A linked node has enough shingles that other nodes have too.  Of these, the rarest ones that leave out fewer than a
    link needs are its buckets: two linked nodes share one.  Shingles are counted by their first bits, so some count as
    shared that are not: nodes and buckets more, never fewer.
    """
    size = w.text_bytes(bodies, "body")
    lots = max(1, -(-size // (6 * CLASS_LOT)))
    parts = max(min(lots, w.shuffle_width(bodies)), -(-size // (24 * CLASS_LOT)))
    placed = _in_lots(bodies, lots)
    sent = placed.groupBy("lot").applyInArrow(_lot_counts(parts, k), "part bigint, lot bigint, tokens binary, often binary")
    answer = sent.groupBy("part").applyInArrow(_ranks, "lot bigint, part bigint, ranks binary")

    def choose(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _once(table)
        labels, offsets = shingles(table["body"].combine_chunks(), k)
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(labels >> CUT)
        first = w.firsts((labels >> CUT)[order])
        rank = np.empty(len(labels), np.uint8)
        rank[order] = np.repeat(np.frombuffer(b"".join(replies.sort_by("part")["ranks"].to_pylist()), np.uint8), np.diff(np.append(first, len(labels))))
        shared = np.bincount(row[rank > 0], minlength=len(n))
        count = np.maximum(0, shared - _needed(n, least) + 1)
        rows = np.flatnonzero(count)
        at = np.flatnonzero((rank > 0) & (count[row] > 0))
        at = at[_first_places(row[at], count, np.lexsort((labels[at], rank[at], row[at])))]
        own, ends = labels[bpe.ragged(offsets[rows], n[rows])], np.append(0, np.cumsum(n[rows]))
        sketch = pa.array(sketches(own, ends, bands, picks).view(np.int64).reshape(-1))
        kept = table.take(pa.array(rows))
        out = pa.table({
            "node": kept["node"], "n": pa.array(n[rows], pa.int64()), "body": kept["body"],
            "sketch": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * bands, pa.int32()), sketch),
            "buckets": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[rows])), pa.int32()), pa.array(labels[at].view(np.int64)))})
        w.give_back()
        return out

    return placed.groupBy("lot").cogroup(answer.groupBy("lot")).applyInArrow(
        choose, "node binary, n bigint, body string, sketch array<bigint>, buckets array<bigint>")


def _block_links(members: DataFrame, sizes: DataFrame, bodies: DataFrame, turn: int, k: int, least: float) -> DataFrame:
    """Links within random blocks of larger buckets that still hold several classes."""
    open_ = sizes.where((F.col("low") != F.col("high")) & (F.col("size") > (BLOCK if turn else SMALL))).select("bucket", "size")
    block = F.pmod(F.xxhash64("bucket", "node", F.lit(turn)), F.ceil(F.col("size") / BLOCK))
    rows = members.join(open_, "bucket").select("node", "class", F.xxhash64("bucket", block).alias("block")).join(bodies, "node")

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        found = _block(table["node"].to_pylist(), table["class"].to_pylist(), table["body"].combine_chunks(), k, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return rows.groupBy("block").applyInArrow(link, "a binary, b binary")


def _rest_links(members: DataFrame, sizes: DataFrame, bodies: DataFrame, k: int, least: float) -> DataFrame:
    """Links that join all classes with a link in a larger bucket.

    A block holds members of one bucket and of about one number of shingles: of one class where the class fills a
    block, else of any.  Every two blocks that may have a link are one task, blocks of the same class none.
    """
    open_ = sizes.where((F.col("low") != F.col("high")) & (F.col("size") > SMALL)).select("bucket")
    # numbers of shingles of a link differ by less than one step
    step = F.floor(F.log("n") / float(-np.log(least - 1e-6))) if 1e-5 < least < 1 else F.col("n") if least >= 1 else F.lit(0)
    rows = members.join(open_, "bucket").withColumn("step", step.cast("bigint"))
    of_class = rows.groupBy("bucket", "class").agg(F.count("*").alias("own")).where(F.col("own") >= HALF).select("bucket", "class", F.col("class").alias("pure"))
    rows = rows.join(of_class, ["bucket", "class"], "left").withColumn("pure", F.coalesce("pure", F.lit(b"")))
    group = ["bucket", "step", "pure"]
    counts = rows.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / HALF), F.ceil(F.sum("n") / HALF_SHINGLES)).alias("blocks"))
    part = F.pmod(F.xxhash64("bucket", "node", F.lit(-1)), F.col("blocks"))
    rows = materialize(rows.join(counts, group).select("bucket", "step", "pure", "node", "class", part.alias("part")))
    blocks = rows.select("bucket", "step", "pure", "part").distinct()
    a, b = (blocks.select("bucket", F.struct("step", "pure", "part").alias(c)) for c in "ab")
    tasks = a.join(b, "bucket").where(
        "a <= b and b.step - a.step <= 1 and (a.pure != b.pure or a.pure = X'')").select("bucket", "a", "b", F.xxhash64("bucket", "a", "b").alias("task"))
    sides = tasks.select("bucket", "task", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"), (F.col("a") == F.col("b")).alias("one"))
    sides = sides.select("bucket", "block.step", "block.pure", "block.part", "task", "one")
    known = members.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    rows = rows.withColumn("side", F.xxhash64("step", "pure", "part")).join(sides, [*group, "part"]).select("bucket", "task", "side", "one", "node", "class")
    rows = rows.join(known, "node").join(bodies, "node")

    def link(table: pa.Table) -> pa.Table:
        bucket, one = table["bucket"][0].as_py(), table["one"][0].as_py()
        side = table["side"].to_numpy()
        lists = table["buckets"].combine_chunks()
        value, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        # a pair that shares a smaller bucket is compared there
        owner, value = owner[value < bucket], value[value < bucket]
        here = (_common(owner, value, len(lists)) == 0) & (one | (side[:, None] != side[None, :]))
        found = [] if not np.triu(here, 1).any() else _block(table["node"].to_pylist(), table["class"].to_pylist(), table["body"].combine_chunks(), k, least, here)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return rows.groupBy("bucket", "task").applyInArrow(link, "a binary, b binary")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame | None:
    """Classes (node, class) joined along links (a, b); None when nothing was to join."""
    ends = links.join(classes.select(F.col("node").alias("a"), F.col("class").alias("src")), "a").join(
        classes.select(F.col("node").alias("b"), F.col("class").alias("dst")), "b").where("src != dst").select("src", "dst").distinct()
    ends = materialize(ends)
    if ends.isEmpty():
        release(ends)
        return None
    parts = connected_components(ends.select(F.col("src").alias("node")).unionByName(ends.select(F.col("dst").alias("node"))), ends)
    moved = parts.where("node != component").select(F.col("node").alias("class"), "component")
    made = materialize(classes.join(moved, "class", "left").select("node", F.coalesce("component", "class").alias("class")))
    release(ends, parts, classes)
    return made


def _crowded(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets with several classes."""
    kind = members.join(classes, "node").groupBy("bucket").agg(*[f(F.xxhash64("class")).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))])
    return materialize(members.join(kind.where("low != high").select("bucket"), "bucket").select("node", "n", "bucket"))


def _search(members: DataFrame, classes: DataFrame, bodies: DataFrame, k: int, least: float, idle_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Members (node, n, bucket) that may still have a link in a large bucket, and the classes after small buckets were searched whole and large ones in blocks."""
    for step in (_first_pairs, _small_pairs):
        now = members.join(classes, "node")
        pairs = step(now, least) if step is _first_pairs else step(now, _sizes(now), least)
        classes = _merged(classes, _links(pairs, bodies, k, least)) or classes
    now = members.join(classes, "node")
    members = _linkable(now, _sizes(now), bodies, k, least)
    # large buckets that have become small
    now = members.join(classes, "node")
    classes = _merged(classes, _links(_small_pairs(now, _sizes(now), least), bodies, k, least)) or classes
    turn, idle = 0, 0
    while idle < idle_rounds:
        now = members.join(classes, "node")
        more = _merged(classes, _block_links(now, _sizes(now), bodies, turn, k, least))
        classes, idle, turn = more or classes, 0 if more else idle + 1, turn + 1
    return members, classes


def near_copies(lessons: DataFrame, least: float = 0.8, shingle: int = 5, bands: int = 16, picks: int = 3, idle_rounds: int = 1) -> DataFrame:
    """One row per lesson with the class of near copies it belongs to.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns are not read.  Two
    lessons are linked when the best order-preserving alignment of their shingles
    (``shingle`` words in a row) has at least ``least`` of all shingles of both; classes
    are what links connect.  Returns ``lesson_id``, ``class_id`` (smallest lesson_id of the
    class), ``class_size`` (rows), ``kept`` (true for one row of each class, one with the
    class's id), ``body_md5`` (hex).

    Equal bodies are always one class; a null body counts as empty and empty bodies are
    equal.  Lessons without words are linked to nothing else, a lesson shorter than a shingle only
    to those with the same words.  Null ids are the class's id only if there is no other.
    An empty table gives an empty result.

    The search is exact for any ``least`` above 0 (up to equal 64-bit hashes of different
    shingles): ``bands`` and ``picks`` only tell how many links are found before the prefix
    filter looks for those left.  ``idle_rounds`` only tells how many rounds of random
    blocks in a row may merge nothing before larger buckets are searched whole.
    """
    bodies = lessons.select(F.col("lesson_id").cast("bigint").alias("lesson_id"), F.coalesce("body", F.lit("")).alias("body")).withColumn(
        "node", F.unhex(F.md5("body")))
    rows = materialize(bodies.select("lesson_id", "node").withColumn("at", F.monotonically_increasing_id()))
    found = materialize(_linked_nodes(bodies, shingle, least, bands, picks))
    bodies = found.select("node", "body")
    classes = materialize(found.select("node", F.col("node").alias("class")))
    members = found.select("node", "n", F.posexplode("sketch").alias("band", "value")).select("node", "n", F.xxhash64("band", "value").alias("bucket"))
    members = _crowded(members, classes)
    if not members.isEmpty():
        _, classes = _search(members, classes, bodies, shingle, least, idle_rounds)
    members = _crowded(found.select("node", "n", F.explode("buckets").alias("bucket")), classes)
    if not members.isEmpty():
        members, classes = _search(members, classes, bodies, shingle, least, idle_rounds)
        now = members.join(classes, "node")
        classes = _merged(classes, _rest_links(now, _sizes(now), bodies, shingle, least)) or classes
    named = rows.join(classes, "node", "left").select("lesson_id", "at", "node", F.coalesce("class", "node").alias("class"))
    firsts = named.groupBy("class").agg(F.min(F.struct(F.col("lesson_id").isNull(), "lesson_id", "at")).alias("first"), F.count("*").alias("class_size"))
    return named.join(firsts, "class").select(
        "lesson_id", F.col("first.lesson_id").alias("class_id"), "class_size", (F.col("at") == F.col("first.at")).alias("kept"),
        F.lower(F.hex("node")).alias("body_md5"))
