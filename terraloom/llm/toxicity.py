"""Toxic passages of lessons and a score of each lesson.

Method: a linear-chain conditional random field with the states clean and toxic.  It is
fitted on a bounded sample of labelled lessons.  Labels are per lesson, so the tokens are
labelled first: in a toxic lesson, those whose word, or beginning or end of the word, is
met in clearly more toxic than clean lessons; in a clean lesson none.  Forward-backward
marginals of all tokens make the lesson's score through a calibrated logistic function,
and runs of likely toxic tokens give the offending places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import bpe
from terraloom.llm import words as w

SLOTS = 1 << 20  # weights, addressed by feature hash
CHAIN = 64  # tokens after which a long line starts a new chain
PREFIXES, SUFFIXES = range(3, 10), range(3, 7)  # in bytes


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


_LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


class Tokens:
    """Runs of letters and digits of a batch, its distinct words with their features, and its chains."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = w.column_bytes(texts)
        data = _lower(self.data)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        full = _LETTER[data]
        first, last = full.copy(), full.copy()
        if n:
            first[1:] &= ~full[:-1] | edge[1:-1]
            last[:-1] &= ~full[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = w.rows_of(self.starts, self.offsets)
        h = w.span_hash(data, self.starts, self.ends)
        order = np.argsort(h)
        new = w.firsts(h[order])
        self.word = np.empty(len(h), np.int64)
        self.word[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(h))))
        at = np.sort(order[new])  # one place of each distinct word, in text order
        rank = np.empty(len(new), np.int64)
        rank[self.word[at]] = np.arange(len(at))
        self.word = rank[self.word]
        s, e = self.starts[at], self.ends[at]
        parts = [w.span_hash(data, s, e)]
        for k in PREFIXES:
            parts.append(np.where(e - s > k, w.mix(w.span_hash(data, s, np.minimum(s + k, e)) + w.U(k)), w.U(0)))
        for k in SUFFIXES:
            parts.append(np.where(e - s > k, w.mix(w.span_hash(data, np.maximum(e - k, s), e) + w.U(100 + k)), w.U(0)))
        self.features = np.stack(parts, axis=1)  # 0: the word has no such part
        # chains: lines, cut after CHAIN tokens
        line = np.cumsum(data == 10)[self.starts] + self.row if len(self.starts) else np.zeros(0, np.int64)
        begin = w.firsts(line)
        place = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line))))
        self.chain_at = np.flatnonzero(place % CHAIN == 0)
        self.chain_n = np.diff(np.append(self.chain_at, len(line)))


def slots(features: np.ndarray) -> np.ndarray:
    """Weight slot of each feature; slot 0 is for missing ones and stays 0."""
    return np.where(features == 0, w.U(0), features % w.U(SLOTS - 1) + w.U(1)).astype(np.int64)


def marginals(energy: np.ndarray, at: np.ndarray, n: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(toxic) of each token, expected transitions (2 x 2), and the log-normaliser of all chains.

    energy: log-odds of toxic from the token alone.  at, n: chains of tokens.  chain:
    log-weights, rows 0 and 1 from clean and toxic, row 2 for the first token, columns to clean and toxic.
    """
    out, pairs, log_z = np.zeros(len(energy)), np.zeros((2, 2)), 0.0
    order = np.argsort(-n, kind="stable")  # long chains first: the live ones are a prefix
    at, n = at[order], n[order]
    if not len(n):
        return out, pairs, log_z
    weight, start = np.exp(chain[:2]), np.exp(chain[2])
    live = [int(x) for x in np.searchsorted(-n, -np.arange(n[0]), side="left")]
    ahead, like = [], []
    for t, m in enumerate(live):
        like_t = np.ones((m, 2))
        like_t[:, 1] = np.exp(np.clip(energy[at[:m] + t], -30, 30))
        a = (start if t == 0 else ahead[-1][:m] @ weight) * like_t
        scale = a.sum(axis=1, keepdims=True)
        log_z += float(np.log(scale).sum())
        ahead.append(a / scale)
        like.append(like_t)
    back = np.ones((live[-1], 2))
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        full = np.ones((m, 2))
        full[: len(back)] = back
        both = ahead[t] * full
        both /= both.sum(axis=1, keepdims=True)
        out[at[:m] + t] = both[:, 1]
        if t:
            right = like[t] * full
            joint = ahead[t - 1][:m, :, None] * weight[None] * right[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = right @ weight.T
            back /= back.sum(axis=1, keepdims=True)
    return out, pairs, log_z


@dataclass
class Model:
    """Weights of features, of transitions and of the logistic function; None without both labels."""

    base: float
    weights: np.ndarray | None = None
    bias: float = 0.0
    chain: np.ndarray | None = None
    link: np.ndarray | None = None

    def tag(self, tokens: Tokens) -> np.ndarray:
        energy = self.bias + self.weights[slots(tokens.features)].sum(axis=1)
        return marginals(energy[tokens.word], tokens.chain_at, tokens.chain_n, self.chain)[0]

    def score(self, tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(tokens, toxic) @ self.link, -30, 30)))


def evidence(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Per text: 1, log of expected toxic tokens, the largest marginal, and expected toxic tokens a token."""
    rows = len(tokens.offsets) - 1
    total = np.bincount(tokens.row, weights=toxic, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, tokens.row, toxic)
    share = total / np.maximum(1, np.bincount(tokens.row, minlength=rows))
    return np.stack([np.ones(rows), np.log1p(total), most, np.sqrt(share)], axis=1)


def token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts that have a part met in clearly more toxic than clean texts."""
    n_words = max(1, len(tokens.features))
    row, word = np.divmod(np.unique(tokens.row * n_words + tokens.word), n_words)
    n_hot, n_cold = toxic.sum(), len(toxic) - toxic.sum()
    telling = np.zeros(len(tokens.features), bool)
    for column in tokens.features.T:  # parts of one length
        part, of = np.unique(column, return_inverse=True)
        seen = np.unique(of[word] * len(toxic) + row)  # each part once a text
        index, text = np.divmod(seen, len(toxic))
        hot = np.bincount(index, weights=toxic[text], minlength=len(part))
        cold = np.bincount(index, minlength=len(part)) - hot
        clear = (part != 0) & (hot >= max(4, 0.008 * n_hot)) & ((hot + 0.5) / (n_hot + 1) >= 8 * (cold + 0.5) / (n_cold + 1))
        telling |= clear[of]
    return (telling[tokens.word] & (toxic[tokens.row] > 0)).astype(np.float64)


def fit(texts: pa.Array, toxic: np.ndarray, base: float, rounds: int = 60) -> Model:
    """Penalised likelihood by gradient steps (Adam), then the logistic function by Newton steps.

    toxic: 0 or 1 of each text; base: share of toxic ones to calibrate for.
    """
    tokens = Tokens(texts)
    y = token_labels(tokens, toxic)
    slot, used = np.unique(slots(tokens.features), return_inverse=True)
    used = used.reshape(tokens.features.shape)
    absent = slot == 0
    word_n, word_y = np.bincount(tokens.word, minlength=len(used)), np.bincount(tokens.word, weights=y, minlength=len(used))
    state = y.astype(int)
    inner = np.ones(len(y), bool)
    inner[tokens.chain_at] = False
    k = np.flatnonzero(inner)
    seen_pairs = np.bincount(2 * state[k - 1] + state[k], minlength=4).reshape(2, 2).astype(float)
    seen_first = np.bincount(state[tokens.chain_at], minlength=2).astype(float)
    theta = np.zeros(len(slot) + 1 + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    theta[len(slot)] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    total = max(1.0, y.sum())
    for step in range(1, rounds + 1):
        chain = theta[-6:].reshape(3, 2)
        energy = theta[len(slot)] + theta[: len(slot)][used].sum(axis=1)
        p, pairs, _ = marginals(energy[tokens.word], tokens.chain_at, tokens.chain_n, chain)
        off = np.bincount(tokens.word, weights=p, minlength=len(used)) - word_y
        first = np.array([len(tokens.chain_at) - p[tokens.chain_at].sum(), p[tokens.chain_at].sum()])
        gradient = np.concatenate([
            np.bincount(used.reshape(-1), weights=np.repeat(off, used.shape[1]), minlength=len(slot)), [off.sum()],
            (pairs - seen_pairs).reshape(-1), first - seen_first]) / total + 1e-4 * theta
        gradient[: len(slot)][absent] = 0
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6) / np.sqrt(1 + step / 20)
    weights = np.zeros(SLOTS, np.float32)
    weights[slot] = theta[: len(slot)]
    model = Model(base, weights, float(theta[len(slot)]), theta[-6:].reshape(3, 2).copy())
    x = evidence(tokens, model.tag(tokens))
    share = toxic.mean()
    row_weight = np.where(toxic > 0, base / share, (1 - base) / (1 - share))
    link = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        slope = x.T @ (row_weight * (p - toxic)) + 1e-2 * link
        curve = (x * (row_weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(link))
        link -= np.clip(np.linalg.solve(curve, slope), -5, 5)
    model.link = link
    return model


def train(lessons: DataFrame, labels: DataFrame, rows: int = 4000) -> Model:
    """Model from lessons (``lesson_id``, ``body``) and labels (``lesson_id``, ``toxic`` 0 or 1).

    At most ``rows`` labelled lessons are used for fitting, up to half of them toxic, those
    with the smallest hash of their id; shares of the labels are counted over all.  Null
    ids, labels and bodies are not used.  With one kind of label, or none, every lesson
    later gets the share of toxic labels (0 without any) as its score.
    """
    labels = labels.select("lesson_id", F.col("toxic").cast("int").alias("toxic")).where("lesson_id is not null and toxic in (0, 1)")
    count = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    hot, cold = count.get(1, 0), count.get(0, 0)
    base = hot / (hot + cold) if hot + cold else 0.0
    if not hot or not cold:
        return Model(base)
    take = min(hot, max(rows // 2, rows - cold))
    chosen = None
    for value, n in ((1, take), (0, rows - take)):
        part = labels.where(F.col("toxic") == value).orderBy(F.xxhash64("lesson_id"), "lesson_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = lessons.select("lesson_id", "body").where("body is not null").join(F.broadcast(chosen), "lesson_id").orderBy("lesson_id").limit(2 * rows).toArrow()
    toxic = sample["toxic"].to_numpy().astype(float)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(base)
    return fit(sample["body"], toxic, base)


def score_lessons(lessons: DataFrame, model: Model) -> DataFrame:
    """Toxicity of each lesson and the places that are likely toxic.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns, labels among them,
    are not read.  Returns a row per row: ``lesson_id``, ``score`` (0 to 1), ``flagged``
    (score of at least 0.5) and ``places``: runs of tokens with a marginal of at least
    0.5, as ``first`` and ``after`` (code points) with their largest ``marginal``.  A null
    or empty body, or one without letters, has no places and the score of no evidence.  An
    empty table gives an empty result.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bpe.slices(batch["body"]):
                part = batch.slice(a, b - a)
                m = part.num_rows
                if model.weights is None:
                    value, ends, spans = np.full(m, model.base), np.zeros(m + 1, np.int32), [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
                else:
                    tokens = Tokens(part["body"])
                    toxic = model.tag(tokens)
                    value = model.score(tokens, toxic)
                    hot = np.flatnonzero(toxic >= 0.5)
                    apart = np.ones(len(hot), bool)
                    apart[1:] = (np.diff(hot) > 1) | (np.diff(tokens.row[hot]) > 0)
                    at = np.flatnonzero(apart)
                    row = tokens.row[hot[at]]
                    char = np.append(0, np.cumsum((tokens.data & 0xC0) != 0x80))
                    base = char[tokens.offsets[:-1]][row]
                    last = hot[np.append(at[1:], len(hot)) - 1] if len(at) else hot
                    spans = [char[tokens.starts[hot[at]]] - base, char[tokens.ends[last]] - base, np.maximum.reduceat(toxic[hot], at) if len(at) else np.zeros(0)]
                    ends = np.append(0, np.cumsum(np.bincount(row, minlength=m))).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int64()), pa.array(spans[2], pa.float64())], ["first", "after", "marginal"]))
                yield pa.RecordBatch.from_pydict({"lesson_id": part["lesson_id"], "score": value, "flagged": value >= 0.5, "places": places})

    return lessons.selectExpr("cast(lesson_id as bigint) lesson_id", "body").mapInArrow(
        score, "lesson_id bigint, score double, flagged boolean, places array<struct<first:bigint,after:bigint,marginal:double>>")
