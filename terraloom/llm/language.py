"""Language of lessons from interpolated Kneser-Ney character models.

Counts of character ``ORDER``-grams of all labelled lessons come from one Spark
aggregation; all of them make the models, so lower orders, totals and discounts are those
of the whole corpus and a model is as large as the counts say.  Models are sorted arrays of hashed n-grams with a column of log-probabilities
and back-off weights for each language, so one look-up serves all languages.  A lesson
gets the language whose model needs the fewest bits a character; it is rejected when even
that is surely more than the calibrated limit of the language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import bpe
from terraloom.llm import words as w

ORDER = 4  # four characters of 16 bits make one key
SPACE = 32
EVIDENCE = 50  # characters after which more text adds no confidence
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-case 16-bit code of each code point; everything but letters and marks is a space."""
    if not _letters:
        table = np.full(0x110000, SPACE, np.uint16)
        for c in range(0x110000):
            if c < 0xD800 or 0xE000 <= c < 0x323B0:
                ch = chr(c)
                if unicodedata.category(ch)[0] in "LM":
                    low = ch.lower()
                    code = ord(low) if len(low) == 1 else c
                    table[c] = code if code < 0xD800 else 0xD800 + code % 0x2800  # beyond the plane: folded
        _letters.append(table)
    return _letters[0]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts with single spaces, the offsets of each text, and its number of letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    code = _letter_table()[points]
    keep = code != SPACE
    n_letters = np.diff(np.append(0, np.cumsum(keep))[chars])
    keep[1:] |= keep[:-1]  # the first space after a letter stays
    starts = chars[:-1][np.diff(chars) > 0]
    keep[starts] = code[starts] != SPACE
    return code[keep], np.append(0, np.cumsum(keep))[chars], n_letters


def grams(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Key of the last ``ORDER`` characters at each position; before a text stand spaces."""
    key = code.astype(w.U)
    place = np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER):
        before = np.full(len(code), SPACE, w.U)
        if back < len(code):
            inside = place[back:] >= back
            before[back:][inside] = code[:-back][inside]
        key |= before << w.U(16 * back)
    return key


def count_grams(lessons: DataFrame) -> DataFrame:
    """``language``, ``gram`` (key as bigint), ``n`` over all lessons with a language and a body."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for language, parts in held.items():
                keys, n = _summed(parts)
                yield pa.RecordBatch.from_pydict({
                    "language": pa.array([language] * len(keys), pa.string()), "gram": pa.array(keys.view(np.int64)), "n": pa.array(n, pa.int64())})
            held.clear()

        for batch in batches:
            for a, b in bpe.slices(batch["body"], 2 << 20):
                code, offsets, _ = letters(*w.column_bytes(batch["body"].slice(a, b - a)))
                key = grams(code, offsets)
                kinds = batch["language"].slice(a, b - a).dictionary_encode()
                of = np.repeat(np.asarray(kinds.indices), np.diff(offsets))
                for k, language in enumerate(kinds.dictionary.to_pylist()):
                    part = np.unique(key[of == k], return_counts=True)
                    held.setdefault(language, []).append(part)
                    size += len(part[0])
                if size > 1_500_000:
                    for language, parts in held.items():
                        held[language] = [_summed(parts)]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > 1_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    return (lessons.where("language is not null and body is not null").select("language", "body")
            .mapInArrow(w.tidy(count), "language string, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n")))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = w.firsts(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


@dataclass
class Models:
    """Sorted hash arrays of each order, with log2 probability and back-off of each language."""

    languages: list[str]
    hashes: list[np.ndarray] = field(default_factory=list)  # of n-grams, by order - 1
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)  # hashes of n-grams without the last character
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None  # log2 probability of an unknown character
    limit: np.ndarray | None = None  # calibrated bits a character
    spread: np.ndarray | None = None

    @staticmethod
    def find(hashes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = w.mix(key)
        at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
        return at, (hashes[at] == h if len(hashes) else np.zeros(len(key), bool))

    def log_probability(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 P(last character | the ones before) of distinct keys, a column per language."""
        if order == 0:
            return np.tile(self.unseen, (len(key), 1))
        at, seen = self.find(self.hashes[order - 1], key)
        out = np.empty((len(key), len(self.languages)), np.float32)
        out[seen] = self.logp[order - 1][at[seen]]
        rest = key[~seen]
        if len(rest):
            weight = np.zeros((len(rest), len(self.languages)), np.float32)
            if order > 1:
                at, known = self.find(self.contexts[order - 1], rest >> w.U(16))
                weight[known] = self.backoff[order - 1][at[known]]
            out[~seen] = weight + self.log_probability(rest & w.U((1 << 16 * (order - 1)) - 1), order - 1)
        return out

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text and language, its characters, its letters."""
        code, offsets, n_letters = letters(*w.column_bytes(texts))
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.languages)))
        if len(code):
            key = grams(code, offsets)
            order = np.argsort(key)
            new = w.firsts(key[order])
            slot = np.empty(len(key), np.int32)
            slot[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(key))))
            logp = self.log_probability(key[order[new]])
            full = np.flatnonzero(n)
            for k in range(len(self.languages)):
                out[full, k] = -np.add.reduceat(logp[:, k][slot], offsets[:-1][full], dtype=np.float64) / n[full]
        return out, n, n_letters


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney models from the counts of ``ORDER``-grams of each language.

    Lower orders count in how many contexts an n-gram was met; the discount of each order
    is n1 / (n1 + 2 * n2).
    """
    made = Models(sorted(counts))
    tables = []  # per language: by order, keys and (continuation) counts
    for language in made.languages:
        key, n = counts[language]
        levels = [(key, n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            levels.append(tuple(x if i == 0 else x.astype(np.float64) for i, x in enumerate(np.unique(levels[-1][0] & w.U((1 << 16 * order) - 1), return_counts=True))))
        tables.append(levels[::-1])
    unions = [np.unique(np.concatenate([t[o][0] for t in tables])) for o in range(ORDER)]
    alphabet = len(unions[0]) + 1.0
    made.unseen = np.zeros(len(tables), np.float32)
    contexts = [np.unique(u >> w.U(16)) for u in unions]
    logp = [np.zeros((len(u), len(tables)), np.float64) for u in unions]
    back = [np.zeros((len(c), len(tables)), np.float64) for c in contexts]
    for k, levels in enumerate(tables):
        lower = None
        for o, (key, n) in enumerate(levels):
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            context = key >> w.U(16)  # sorted as the keys are
            at = w.firsts(context)
            total, kinds = np.add.reduceat(n, at), np.diff(np.append(at, len(n)))
            gamma = discount * kinds / total
            union = unions[o]
            own = np.searchsorted(union, key)
            if o == 0:
                p = np.full(len(union), gamma[0] / alphabet)
                made.unseen[k] = np.log2(gamma[0] / alphabet)
            else:
                weight = np.ones(len(contexts[o]))  # 1 where the language has not met the context
                weight[np.searchsorted(contexts[o], context[at])] = gamma
                back[o][:, k] = np.log2(weight)
                c = np.searchsorted(contexts[o], union >> w.U(16))
                p = weight[c] * lower[np.searchsorted(unions[o - 1], union & w.U((1 << 16 * o) - 1))]
            p[own] += (n - discount) / np.repeat(total, kinds)
            logp[o][:, k] = np.log2(p)
            lower = p
    for union, context, p, weight in zip(unions, contexts, logp, back):
        for keys, values, hashes, columns in ((union, p, made.hashes, made.logp), (context, weight, made.contexts, made.backoff)):
            h = w.mix(keys)
            order = np.argsort(h)
            hashes.append(h[order])
            columns.append(values[order].astype(np.float32))
    return made


def train(lessons: DataFrame) -> Models | None:
    """Models of all languages in ``lessons`` (``lesson_id``, ``body``, ``language``); None if there are none.

    All lessons and all n-grams are counted and kept: about 24 bytes for each distinct run
    of ``ORDER`` characters and language, on the driver and in each worker.  The limit for
    rejection lies half way between the mean bits a character of a language's lessons and
    what their second-best model needs, taken from all lessons with a language.
    """
    rows = count_grams(lessons).toArrow()
    if not rows.num_rows:
        return None
    counts = {}
    language = rows["language"].combine_chunks().dictionary_encode()
    of, key, n = np.asarray(language.indices), rows["gram"].to_numpy().view(w.U), rows["n"].to_numpy()
    for k, name in enumerate(language.dictionary.to_pylist()):
        order = np.argsort(key[of == k])
        counts[name] = key[of == k][order], n[of == k][order]
    models = kneser_ney(counts)
    _calibrate(models, lessons.where("language is not null and body is not null"))
    return models


def _calibrate(models: Models, lessons: DataFrame) -> None:
    names = models.languages

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bpe.slices(batch["body"], 1 << 20):
                bits, n, _ = models.bits(batch["body"].slice(a, b - a))
                own = np.array([names.index(x) for x in batch["language"].slice(a, b - a).to_pylist()], np.int64)
                mine = bits[np.arange(len(own)), own]
                others = bits.copy()
                others[np.arange(len(own)), own] = np.inf
                ok = n > 0
                yield pa.RecordBatch.from_pydict({
                    "k": own[ok], "n": n[ok].astype(np.int64), "own": mine[ok],
                    "other": others.min(axis=1)[ok] if len(names) > 1 else mine[ok] + 2.0})

    stats = lessons.select("language", "body").mapInArrow(w.tidy(measure), "k bigint, n bigint, own double, other double").groupBy("k").agg(
        (F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("own"), (F.sum(F.col("other") * F.col("n")) / F.sum("n")).alias("other"),
        F.avg(F.col("n") * F.pow(F.col("own"), 2)).alias("m2"), F.avg("n").alias("n")).collect()
    models.limit, models.spread = np.full(len(names), np.inf), np.zeros(len(names))
    for r in stats:
        models.limit[r["k"]] = r["own"] + max(0.5, (r["other"] - r["own"]) / 2)
        models.spread[r["k"]] = max(2.5, np.sqrt(max(0.0, r["m2"] - r["n"] * r["own"] ** 2)))


def identify(lessons: DataFrame, models: Models | None, keep: Sequence[str] = ()) -> DataFrame:
    """Language of each lesson.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns, ``language`` among
    them, are not read, those in ``keep`` are passed on (an error where one is named like a result).  Returns per row ``lesson_id``, ``language_found``, ``confidence``
    (0 to 1: share of the best language when at most ``EVIDENCE`` characters count),
    ``bits`` a character, and ``rejected``: no letters, or surely above the calibrated limit of
    the language found.  ``language_found`` is ``und`` with confidence 0 when the body is
    null or has no letter, or when there are no models.  Ties go to the first language by
    name.  An empty table gives an empty result.
    """
    names = models.languages if models else []
    w.unlike(keep, ("lesson_id", "language_found", "confidence", "bits", "rejected"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bpe.slices(batch["body"], 1 << 20):
                part = batch.slice(a, b - a)
                m = part.num_rows
                best, bits, confidence, rejected = np.full(m, -1), np.zeros(m), np.zeros(m), np.ones(m, bool)
                if names:
                    each, n, n_letters = models.bits(part["body"])
                    ok = n_letters > 0
                    best[ok] = each[ok].argmin(axis=1)
                    bits = each.min(axis=1)
                    share = np.exp2(-(each - bits[:, None]) * np.minimum(n, EVIDENCE)[:, None])
                    confidence[ok] = 1 / share.sum(axis=1)[ok]
                    rejected = ~ok | (bits - models.limit[best] > 3 * models.spread[best] / np.sqrt(np.maximum(n, 1)))
                yield pa.RecordBatch.from_pydict({
                    "lesson_id": part["lesson_id"], "language_found": pa.array([names[k] if k >= 0 else UNDETERMINED for k in best], pa.string()),
                    "confidence": confidence, "bits": pa.array(bits, mask=best < 0), "rejected": rejected,
                    **{c: part.column(2 + i) for i, c in enumerate(keep)}})

    rows = lessons.select(F.col("lesson_id").cast("bigint").alias("lesson_id"), "body", *[F.col(c).alias(f"_{c}") for c in keep])
    kinds = dict(lessons.dtypes)
    return rows.mapInArrow(w.tidy(found), ", ".join([
        "lesson_id bigint, language_found string, confidence double, bits double, rejected boolean", *[f"`{c}` {kinds[c]}" for c in keep]]))
