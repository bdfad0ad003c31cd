import hashlib
import itertools
import random
import re

import pytest

from terraloom.llm.dialogue import repair_conversations, repaired_turns
from terraloom.llm.queries import damaged

SCHEMA = "pos int, conv string, conv_id bigint, turn bigint, role string, text string, block int"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, most=2):
    """Least (cost, audit) over every sequence of edits with at most ``most`` inserted turns between two rows."""
    found, best = faults(rows), None
    choices = [("D",) if f in ("blank", "duplicate") else ("K", "R", "D") for f in found]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(range(most + 1), repeat=len(rows) + 1):
            audit = "I" * inserts[0] + "".join(e + "I" * k for e, k in zip(edits, inserts[1:]))
            cost = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if f == "truncated" and e != "D" else 0) for e, f in zip(edits, found)) + 5 * sum(inserts)
            if best is not None and (cost, audit) >= best:
                continue
            got = "".join(r[:1] or "-" for r, _ in repaired_turns(audit, iter(rows)))
            odd = (len(audit) - audit.count("D")) % 2 and audit.strip("D")[:1] in ("I", "R")  # a system turn is neither inserted nor named
            if re.fullmatch("(s?(ua)+)?", got) and not odd:
                best = (cost, audit)
    return best


def expected(rows):
    """Result of one conversation's (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [r[1:] for r in rows]
    cost, audit = search(pairs)
    count = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    body = "\n".join(f"{r}:{t}" for r, t in repaired_turns(audit, iter(pairs)))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[count.count(k) for k in ("blank", "duplicate", "truncated")],
            illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def run(spark, rows, **more):
    table = spark.createDataFrame([(1, "x", c, t, r, x, 2) for c, t, r, x in rows], SCHEMA)
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in repair_conversations(table, **more).collect()}


def test_against_all_edits(spark):
    rng, rows = random.Random(3), []
    for conv in range(150):
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "unit", "bot", "", None])
            text = rng.choice(["Yes.", "No!", "Well", "", None, " \t", "Why?\n", "Ça va.", f"n{turn}."])
            rows.append((conv or None, rng.choice([turn, turn, turn, 7, None]), role, text))
    got = run(spark, rows, block=2)
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r, x))
    assert got == {c: expected(v) for c, v in want.items()}


def test_long_conversation_in_any_blocks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(700)] + [(2, 0, "user", "x" * 300_000)]
    got = run(spark, rows, block=8)
    assert got == run(spark, rows, block=1024)
    pairs = [r[2:] for r in rows[:700]]
    cells = {0: (0, "")}  # state: least (cost, audit), one turn after the other
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def put(to, state, cost, audit):
        to[state] = min(to.get(state, (10**9, "")), (cost, audit))

    def inserted(cells):
        for _ in range(2):
            for state, (c, x) in list(cells.items()):
                for r in "ua":
                    if (r, state) in step:
                        put(cells, step[r, state], c + 5, x + "I")
        return cells

    for (role, _), fault in zip(pairs, faults(pairs)):
        new = {}
        for state, (c, x) in inserted(cells).items():
            put(new, state, c + 2, x + "D")
            if fault in ("", "truncated"):
                for r in {"u", "a", role[0]}:
                    if (r, state) in step:
                        put(new, step[r, state], c + (r != role[0]) + 5 * bool(fault), x + ("K" if r == role[0] else "R"))
        cells = new
    cells = inserted(cells)
    assert got[1][5:7] == min(cells[s] for s in (0, 3) if s in cells)
    assert got[2][5:7] == (2, "D")


def test_empty_table_and_damage(spark):
    assert run(spark, []) == {}
    turns = spark.createDataFrame([(1, "x", c, t, "user", "Wie? Gut!", 0) for c in range(40) for t in range(5)] + [(1, "x", None, None, None, None, 0)], SCHEMA)
    import zlib

    got = sorted((r["conv_id"] if r["conv_id"] is not None else -1, r["turn"], r["role"], r["text"]) for r in damaged(turns).where("turn is not null").collect())
    want = []
    for c in range(40):
        for t in range(5):
            kind = zlib.crc32(f"{c}:{t}".encode()) % 20
            want += [(c, t, "user", "" if kind == 1 else "Wie Gut" if kind == 2 else "Wie? Gut!")] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want)


@pytest.mark.parametrize("audit, want", [("KK", [("system", "1"), ("user", "2")]), ("DIK", [("user", ""), ("user", "2")]), ("RR", [("user", "1"), ("assistant", "2")])])
def test_repaired_turns(audit, want):
    assert list(repaired_turns(audit, iter([("system", "1"), ("user", "2")]))) == want
