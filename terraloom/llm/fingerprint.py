"""Fingerprints of lessons that can be added and subtracted.

Method: homomorphic multiset hash.  Each paragraph (line, blank ones too) is hashed to a
wide vector of 32-bit lanes and a lesson's fingerprint is the lane-wise sum modulo 2**32,
so the order of paragraphs does not matter and a paragraph is inserted or deleted by
adding or subtracting its vector.  Lanes:

* one counts phrases (up to ``PHRASE`` words in a row, paragraph by paragraph),
* ``2 * HASHES`` sum hashes of the whole paragraphs: equal only for the same paragraphs,
* ``2 * PAIRS`` count, for one bit each of a hash of the phrase alone, how often it is set.
  Seen as sums of +1 and -1 they estimate the squared distance of two lessons' phrase
  counts, which gives their likeness.

Everything is DataFrame functions; two lanes travel in one bigint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.words import NULL_ID, shuffle_width

PHRASE = 3
HASHES = 8  # bigints with two paragraph lanes each
PAIRS = 32  # bigints with two bit-counting lanes each
MASK = 0xFFFFFFFF
_WORD = r"[^\x20\x09-\x0D]+"
_PHRASES = rf"{_WORD}(?:[\x20\x09-\x0D]+{_WORD}){{0,{PHRASE - 1}}}"


def _phrase_rows(df: DataFrame, body: str) -> DataFrame:
    """A row per phrase with a hash of it; the first row of a paragraph also has the paragraph's hashes.

    A paragraph without words gives one row, and so does an empty body, which has no paragraph.
    """
    kept = [c for c in df.columns if c != body]
    lines = df.select(*kept, F.explode_outer(F.when(F.length(body) > 0, F.split(body, "\n"))).alias("_line"))
    phrases = lines.select(
        *kept, "_line", F.posexplode_outer(F.regexp_extract_all("_line", F.lit(_PHRASES), F.lit(0))).alias("_at", "_phrase"))
    first = F.col("_line").isNotNull() & (F.coalesce("_at", F.lit(0)) == 0)
    return phrases.select(
        *kept, F.col("_phrase").isNotNull().cast("bigint").alias("_one"), F.xxhash64(F.lit(1), "_phrase").alias("_bits"),
        *[F.when(first, F.xxhash64(F.lit(i + 2), "_line")).alias(f"_h{i}") for i in range(HASHES)])


def _lanes() -> list[Column]:
    """Sums over phrases: their count, the low and high halves of the paragraph hashes, and the pairs of bit counts."""
    one, unset = F.col("_one"), F.lit(0).cast("bigint")
    out = [F.sum(one)]
    for i in range(HASHES):
        out += [F.sum(F.coalesce(half, unset)) for half in (F.col(f"_h{i}").bitwiseAND(MASK), F.shiftrightunsigned(f"_h{i}", 32))]
    for j in range(PAIRS):
        out.append(F.sum(F.when(one == 1, F.shiftrightunsigned("_bits", j).bitwiseAND((1 << 32) | 1)).otherwise(unset)))
    return [c.alias(f"_l{i}") for i, c in enumerate(out)]


def _vector() -> Column:
    """The lanes as one array; paragraph lanes modulo 2**32, in pairs."""
    lane = lambda i: F.col(f"_l{i}").bitwiseAND(MASK)
    hashes = [F.shiftleft(lane(2 * i + 2), 32).bitwiseOR(lane(2 * i + 1)) for i in range(HASHES)]
    return F.array(F.col("_l0"), *hashes, *[F.col(f"_l{i}") for i in range(1 + 2 * HASHES, 1 + 2 * HASHES + PAIRS)])


def as_text(vector: str | Column) -> Column:
    """A fingerprint as hex digits."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def combined(a: str | Column, b: str | Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of both (sign 1), or of ``a`` without those of ``b`` (sign -1)."""

    def lane(x: Column, y: Column) -> Column:
        low = (x.bitwiseAND(MASK) + sign * y.bitwiseAND(MASK)).bitwiseAND(MASK)
        high = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(MASK)
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.zip_with(a, b, lane)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of phrases in common, estimated from two fingerprints: 1 for equal ones, about 0 for unrelated ones."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    total = a[0] + b[0]
    lag = a[0] - b[0]

    def squares(acc: Column, ab: Column) -> Column:
        low = 2 * (ab["x"].bitwiseAND(MASK) - ab["y"].bitwiseAND(MASK)) - lag
        high = 2 * (F.shiftrightunsigned(ab["x"], 32) - F.shiftrightunsigned(ab["y"], 32)) - lag
        return acc + (low * low + high * high).cast("double")

    pairs = F.zip_with(F.slice(a, 2 + HASHES, PAIRS), F.slice(b, 2 + HASHES, PAIRS), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    apart = F.aggregate(pairs, F.lit(0.0), squares) / (2.0 * PAIRS)
    return F.when(a == b, 1.0).when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - apart / total)))


def fingerprints(lessons: DataFrame) -> DataFrame:
    """``lesson_id`` and ``fingerprint`` (array of lanes) of each lesson.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns are not read.  A null
    body is empty and an empty one has the zero fingerprint.  Rows with the same id count
    as parts of one lesson: their paragraphs are added up.
    """
    rows = _phrase_rows(lessons.select("lesson_id", "body"), "body")
    return rows.groupBy("lesson_id").agg(*_lanes()).select("lesson_id", _vector().alias("fingerprint"))


def range_of(key: Column, starts: list[int]) -> Column:
    """Index of the last start that is not above ``key``; looks at about 2 * sqrt(n) starts."""
    step = max(1, math.isqrt(len(starts)))
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    array = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    coarse = F.greatest(F.lit(0), below(array(starts[::step])) - 1) * step
    return coarse + below(F.slice(array(starts), coarse + 1, F.lit(step))) - 1


def compare_edits(lessons: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of each lesson, of an edit of it, and of the lesson that follows.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns are not read.  Lessons
    follow each other by ascending id (ties by body, null ids last; after the last comes
    the first).  The edit replaces the last ``n_chars // share`` code points by as many
    (or all) of the start of the next lesson.  Returns a row per given row:
    ``lesson_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hex),
    ``near_edited``, ``near_next``.  A null body is empty; an empty table gives an empty result.

    Ids are cut into ranges at ids that occur, so the first lesson of each range is known
    beforehand and is also sent, as a guest, to the range before it.
    """
    key = F.coalesce(F.col("lesson_id").cast("bigint"), F.lit(NULL_ID))
    rows = lessons.select(F.col("lesson_id").cast("bigint").alias("lesson_id"), key.alias("_key"), F.coalesce("body", F.lit("")).alias("body"))
    n = 2 * shuffle_width(lessons)
    cuts = rows.agg(F.percentile_approx("_key", [i / n for i in range(n)], 100 * n), F.min("_key")).first()
    starts = sorted({*(cuts[0] or []), *([] if cuts[1] is None else [cuts[1]])}) or [0]
    placed = rows.select("*", range_of(F.col("_key"), starts).alias("_range"), F.lit(0).alias("_guest"))
    guests = placed.where(F.col("_key").isin(starts)).withColumn("_guest", F.lit(1)).withColumn(
        "_range", F.pmod(F.col("_range") - 1, F.lit(len(starts))))
    order = W.partitionBy("_range").orderBy("_guest", "_key", "body")
    tail = F.floor(F.length("body") / share).cast("int")
    both = placed.unionByName(guests).select(
        "_range", "_guest", "lesson_id", "body", F.row_number().over(order).alias("_seq"), F.lead("body").over(order).alias("_next"))
    edited = both.select(
        "_range", "_guest", "lesson_id", "_seq", F.length("body").cast("bigint").alias("n_chars"), "body",
        F.when(F.col("_guest") == 0, F.concat(
            F.substring("body", F.lit(1), F.length("body") - tail), F.substring("_next", F.lit(1), tail))).alias("_edited"))
    keys = ["_range", "_guest", "_seq", "lesson_id", "n_chars", "edited_sha256"]
    texts = edited.withColumn("edited_sha256", F.unhex(F.sha2(F.encode("_edited", "utf-8"), 256))).select(
        *keys, F.explode(F.when(F.col("_guest") == 1, F.array(F.struct(F.lit(0).alias("which"), F.col("body").alias("text")))).otherwise(F.array(
            F.struct(F.lit(0).alias("which"), F.col("body").alias("text")), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("text"))))).alias("_t"))
    hashed = _phrase_rows(texts.select(*keys, "_t.which", "_t.text"), "text").groupBy(*keys, "which").agg(*_lanes()).select(
        *keys, "which", _vector().alias("_own"))
    along = W.partitionBy("_range").orderBy("_seq", "which")
    near = hashed.select(
        *keys, "which", "_own", F.lead("_own", 1).over(along).alias("_edited"), F.lead("_own", 2).over(along).alias("_following"))
    return near.where((F.col("_guest") == 0) & (F.col("which") == 0)).select(
        "lesson_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_text("_own").alias("fingerprint"),
        as_text("_edited").alias("edited_fingerprint"), likeness("_own", "_edited").alias("near_edited"),
        likeness("_own", "_following").alias("near_next"))
