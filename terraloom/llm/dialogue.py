"""Repair of the turn structure of conversations.

Method: weighted CYK parsing over intervals.  The repaired roles must read
``(s?(ua)+)?`` (system, user, assistant).  In Chomsky normal form the grammar has one
nonterminal for each pair of states (p, q) of that language: it derives what leads from p
to q, either as two shorter spans (p, r)(r, q) or as one turn that is kept, given another
role or deleted, with any number of inserted turns around it (the insertion closure).  A
cell of a span holds the least (cost, audit) of one nonterminal.  As the binary rules are
associative, spans of 1, 2, 4, ... turns are enough: they are combined bottom-up by their
length, first inside blocks of ``block`` turns, then over blocks of blocks, so one endless
conversation is spread over many tasks.

Two audits of one cell and one cost never are prefixes of each other (what the longer one
adds could only be insertions, which cost), so the least audit of a span is made of the
least audits of its halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.scale import materialize, release, running_total

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # state after the last role
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

Cells = dict[tuple[int, int], tuple[int, str]]


def _least(cells: Cells, pair: tuple[int, int], cost: int, audit: str) -> None:
    old = cells.get(pair)
    if old is None or (cost, audit) < old:
        cells[pair] = (cost, audit)


def joined(left: Cells, right: Cells) -> Cells:
    """Cells of two spans in a row: rules (p, q) -> (p, r)(r, q)."""
    out: Cells = {}
    for (p, r), (c, x) in left.items():
        for (s, q), (d, y) in right.items():
            if r == s:
                old = out.get((p, q))
                if old is None or c + d < old[0] or (c + d == old[0] and x + y < old[1]):
                    out[p, q] = (c + d, x + y)
    return out


@cache
def _closure() -> Cells:
    """Inserted turns only."""
    cells: Cells = {(p, p): (0, "") for p in range(4)}
    for role in ROLES:
        for pair in STEPS[role]:
            _least(cells, pair, INSERT, "I")
    for _ in range(2):
        cells = joined(cells, cells)
    return cells


@cache
def turn_cells(initial: str, fault: str) -> Cells:
    """Cells of one turn; fault: blank, duplicate, truncated or empty."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        more = UNFINISHED if fault == "truncated" else 0
        for pair in STEPS.get(initial, ()):
            _least(cells, pair, KEEP + more, "K")
        for role in ROLES:
            for pair in STEPS[role]:
                _least(cells, pair, REROLE + more, "R")
    return joined(joined(_closure(), cells), _closure())


def _best(cells: Cells) -> tuple[int, str]:
    return min(cells[p] for p in ((START, START), (START, ASSISTANT)) if p in cells)


def repaired_turns(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits of ``audit``; ``turns`` are the rows in order."""
    expected = _expected(audit)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter != "D":
            to = next(expected)
            yield (role if letter == "K" else to), text


def _expected(audit: str) -> Iterator[str]:
    """Roles of the repaired turns; with an odd number of them the first is a system turn."""
    if (len(audit) - audit.count("D")) % 2:
        yield "system"
    while True:
        yield "user"
        yield "assistant"


SPAN = ("conv string, block bigint, n bigint, first string, last string, low bigint, high bigint, turns bigint, blank bigint, "
        "duplicate bigint, truncated bigint, illegal bigint, pairs array<int>, costs array<bigint>, audits array<string>")
_ARROW = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()),
    ("high", pa.int64()), ("turns", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
    ("pairs", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_COUNTS = ("n", "turns", "blank", "duplicate", "truncated", "illegal")


def _leaf(turn: int | None, initial: str, fault: str) -> dict:
    return {"n": 1, "first": initial, "last": initial, "low": turn, "high": turn, "turns": int(turn is not None), "illegal": 0,
            **{k: int(fault == k) for k in ("blank", "duplicate", "truncated")}, "cells": turn_cells(initial, fault)}


def _pair(a: dict, b: dict) -> dict:
    out = {k: a[k] + b[k] for k in _COUNTS}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"],
                  "high": a["high"] if b["high"] is None else b["high"], "cells": joined(a["cells"], b["cells"])}


def _parsed(spans: list[dict]) -> dict:
    """One span of all, combined bottom-up: every round doubles the length."""
    while len(spans) > 1:
        spans = [_pair(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def _write(found: list[tuple[str, int, dict]]) -> pa.RecordBatch:
    columns = {
        "conv": [c for c, _, _ in found], "block": [b for _, b, _ in found],
        **{k: [s[k] for _, _, s in found] for k in (*_COUNTS, "first", "last", "low", "high")},
        "pairs": [[4 * p + q for p, q in s["cells"]] for _, _, s in found], "costs": [[c for c, _ in s["cells"].values()] for _, _, s in found],
        "audits": [[x for _, x in s["cells"].values()] for _, _, s in found]}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _blocks(read):
    """Reads rows ordered by (conv, block, place) and returns one span per block; ``read`` makes spans of a batch."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []
        for batch in batches:
            for key, span in zip(zip(batch["conv"].to_pylist(), batch["block"].to_pylist()), read(batch)):
                if key != at and held:
                    found.append((*at, _parsed(held)))
                    held = []
                at = key
                held.append(span)
            if len(found) >= 1000:
                yield _write(found)
                found = []
        if held:
            found.append((*at, _parsed(held)))
        if found:
            yield _write(found)

    return spans


def _read_turns(batch: pa.RecordBatch) -> Iterator[dict]:
    return map(_leaf, *(batch[c].to_pylist() for c in ("turn", "initial", "fault")))


def _read_spans(batch: pa.RecordBatch) -> Iterator[dict]:
    for r in batch.to_pylist():
        yield r | {"cells": {divmod(p, 4): (c, x) for p, c, x in zip(r["pairs"], r["costs"], r["audits"])}}


def _together(df: DataFrame, *place: str) -> DataFrame:
    """Rows of a block in one task, in order."""
    return df.repartition("conv", "block").sortWithinPartitions("conv", "block", *place)


RESULT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
        for conv, span in zip(batch["conv"].to_pylist(), _read_spans(batch)):
            cost, audit = _best(span["cells"])
            gaps = 0 if span["low"] is None else span["high"] - span["low"] + 1 - span["turns"]
            for k, v in {"conv": conv, "gaps": gaps, "cost": cost, "audit": audit, **{k: span[k] for k in ("blank", "duplicate", "truncated", "illegal")}}.items():
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k in ("conv", "audit") else pa.int64()) for k, v in out.items()], list(out))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its result row comes first, its turns follow and only pass through a hash."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    row, found = None, []

    def open_(result: dict) -> dict:
        return {"result": result, "hash": hashlib.sha256(), "at": 0, "roles": _expected(result["audit"]), "any": False}

    def put(role: str, text: str) -> None:
        row["hash"].update((("\n" if row["any"] else "") + f"{role}:{text}").encode())
        row["any"] = True

    def insert() -> None:
        audit = row["result"]["audit"]
        while row["at"] < len(audit) and audit[row["at"]] == "I":
            put(next(row["roles"]), "")
            row["at"] += 1

    def close() -> None:
        insert()
        found.append(row["result"] | {"repaired_sha256": row["hash"].hexdigest()})

    for batch in batches:
        place, role, text = (batch[c].to_pylist() for c in ("pos", "role", "text"))
        for i, p in enumerate(place):
            if p == 0:
                if row:
                    close()
                row = open_({c: batch[c][i].as_py() for c in names})
                continue
            insert()
            letter = row["result"]["audit"][row["at"]]
            row["at"] += 1
            if letter != "D":
                to = next(row["roles"])
                put(role[i] if letter == "K" else to, text[i])
        if len(found) >= 1000:
            yield pa.RecordBatch.from_pylist(found)
            found = []
    if row:
        close()
        yield pa.RecordBatch.from_pylist(found)


def repair_conversations(turns: DataFrame, block: int = 256) -> DataFrame:
    """The cheapest repair of each conversation.

    The course material holds no dialogues, so this operator is general: ``turns`` has
    ``conv_id`` bigint, ``turn`` bigint, ``role`` and ``text`` string; further columns are
    not read.  A null role or text stands for one space.  A conversation's rows are taken
    by turn (nulls first); rows of one turn by role and digest of the text.  Null ids make
    one conversation of their own.

    The first fault of a row counts: *blank* (nothing but white space), *duplicate* (role
    and text stood before in the conversation), *truncated* (does not end in ``.``, ``!``
    or ``?``).  Edits: keep 0, another role (user or assistant) 1, delete 2 (blank and
    duplicate rows must go), insert an empty user or assistant turn 5; a truncated row that
    stays costs 5 more.  The initials of the repaired roles read ``(s?(ua)+)?``.

    Returns one row per ``conv_id``: ``gaps`` (turn numbers missing between the least and
    the largest; 0 if all are null), ``blank``, ``duplicate``, ``truncated``, ``illegal``
    (neighbours whose initials are not su, ua, au), ``cost``, ``audit`` (initials of the
    edits in order; of equal costs the least in ASCII), ``repaired_sha256`` of the repaired
    ``role:text`` lines joined by newlines.  An empty table gives an empty result.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", F.md5("text"))
    placed = materialize(running_total(rows, ["turn", "role", "digest"], keys=["conv"], out="pos").withColumn("pos", F.col("pos").cast("bigint")))
    same = F.md5(F.concat_ws(":", F.length("role"), "role", "digest"))
    facts = placed.select(
        "conv", "turn", "pos", F.substring("role", 1, 1).alias("initial"), same.alias("same"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("empty"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    first = facts.groupBy("conv", "same").agg(F.min("pos").alias("first"))
    fault = F.when(F.col("empty"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    leaves = facts.join(first, ["conv", "same"]).select(
        "conv", F.expr(f"(pos - 1) div {block}").alias("block"), "pos", "turn", "initial", fault.alias("fault"))
    spans = materialize(_together(leaves, "pos").mapInArrow(_blocks(_read_turns), SPAN))
    while spans.where("block > 0").limit(1).count():
        wider = spans.withColumn("at", F.col("block")).withColumn("block", F.expr(f"block div {block}"))
        wider = materialize(_together(wider, "at").mapInArrow(_blocks(_read_spans), SPAN))
        release(spans)
        spans = wider
    results = spans.mapInArrow(_results, RESULT).withColumns({"pos": F.lit(0).cast("bigint"), "role": F.lit(""), "text": F.lit("")})
    whole = results.unionByName(placed.select("conv", "pos", "role", "text"), allowMissingColumns=True)
    read = whole.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_digests, RESULT + ", repaired_sha256 string")
    return read.select(F.expr("try_cast(nullif(conv, '') as bigint)").alias("conv_id"), *[c for c in read.columns if c != "conv"])
