"""Byte-level BPE ids of lessons, their places in the text, and the way back.

Texts come as Arrow batches.  A batch is cut before white space that follows other
characters; no match of the split pattern crosses such a place, so each *segment* has the
same ids wherever it stands.  Each distinct segment of a batch is encoded once by the
tokenizers library (a bounded cache keeps them between batches of a worker) and the ids of
the batch are gathered with numpy.  Tokens know how many bytes they stand for, which gives
every token its bytes and, through the byte-to-character map, its characters.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terraloom.llm import words as w

CACHE = 400_000  # segments a worker remembers
_open: dict[tuple, "Encoder"] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def tokenizer_of(path: str, pattern: str | None = None):
    """A tokenizer of the library from its own file, or from a file of ranks and the split pattern."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    if pattern is None:
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True  # their strings in a text are ordinary text
        return made
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    letter = byte_letters()
    name = lambda token: "".join(letter[b] for b in token)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:  # apply earlier merges until the last one is left
            pairs = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            k = pairs.index(min(pairs))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            merges.append((name(parts[0]), name(parts[1])))
    made = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


def token_bytes(path: str, pattern: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids of a vocabulary file in a row, and where each id begins."""
    if pattern is None:
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = {t: i for t, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items() if all(c in back for c in t)}
        vocab = {bytes(back[c] for c in t): i for t, i in vocab.items()}
    else:
        vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = token
    return np.frombuffer(b"".join(table), np.uint8), np.append(0, np.cumsum([len(t) for t in table]))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1 of all i in a row."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _kinds() -> np.ndarray:
    """0 control, 1 white space, 2 punctuation, 3 letter, 4 other; 5 and 6 lead bytes of white space beyond ASCII."""
    kind = np.full(256, 4, np.uint8)
    kind[:0x21] = kind[0x7F] = 0
    kind[[0x20, *range(9, 14)]] = 1
    for b in range(0x21, 0x7F):
        kind[b] = 3 if chr(b).isalpha() else 4 if chr(b).isdigit() else 2
    kind[0xC2], kind[0xE1:0xE4] = 5, 6
    return kind


_KIND = _kinds()


class Encoder:
    """The tokenizer with the segments that this worker has met."""

    def __init__(self, path: str, pattern: str | None):
        self.tokenizer = tokenizer_of(path, pattern)
        self.size = np.diff(token_bytes(path, pattern)[1])
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, w.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the segments: texts, white space after a character that surely is none, punctuation after a letter."""
        n = len(data)
        cut = np.zeros(n, bool)
        if n:
            kind = _KIND[data]
            last = kind[:-1]
            odd = np.zeros(n, bool)  # might end a white-space character of two or three bytes
            odd[1:] |= (last == 5) & (kind[1:] >= 4)
            odd[2:] |= (kind[:-2] == 6) & (kind[2:] >= 4)
            latin = np.zeros(n - 1, bool)  # ends an accented Latin letter
            latin[1:] = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
            cut[1:] = (kind[1:] == 1) & (last >= 2) & ~odd[:-1] | (kind[1:] == 2) & ((last == 3) | latin)
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, and how many each has.  Those with white space only in front are encoded in one string."""
        size = np.array([len(p) for p in pieces])
        texts, members, run, length = [], [], [], 0
        for k, p in enumerate(pieces):
            if p[0] in b" \t\n\v\f\r" and (0x20 < p[-1] < 0x7F or p[-1] >= 0x80 and p[-2] == 0xC3):
                run.append(k)
                length += len(p)
                if length > 4000:
                    members.append(run)
                    run, length = [], 0
            else:
                members.append([k])
        if run:
            members.append(run)
        texts = [b"".join(pieces[k] for k in ks).decode() for ks in members]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        order = np.array([k for ks in members for k in ks])
        flat = np.concatenate(ids)
        ends = np.cumsum(self.size[flat])
        if ends[-1] != size.sum():
            raise ValueError("ids do not stand for the bytes of the text")
        until = np.searchsorted(ends, np.cumsum(size[order]), side="right")
        many = np.diff(until, prepend=0)
        n = np.zeros(len(pieces), np.int64)
        n[order] = many
        start = np.zeros(len(pieces), np.int64)
        start[order] = until - many
        return flat[ragged(start, n)], n

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's."""
        first = self.segments(data, offsets)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        last = np.append(first[1:], len(data))
        h = w.span_hash(data, first, last)
        order = np.argsort(h)
        new = w.firsts(h[order])
        distinct = h[order[new]]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(h))))
        slot = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[slot] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            if len(self.keys) + len(distinct) > CACHE:
                self._forget()
                known = np.zeros(len(distinct), bool)
            raw = data.tobytes()
            where = order[new[~known]]
            ids, n = self._encode([raw[a:b] for a, b in zip(first[where].tolist(), last[where].tolist())])
            keys = np.concatenate([self.keys, distinct[~known]])
            at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            n = np.concatenate([self.n, n])
            self.ids = np.concatenate([self.ids, ids])
            by = np.argsort(keys)
            self.keys, self.at, self.n = keys[by], at[by], n[by]
            slot = np.searchsorted(self.keys, distinct)
        n = self.n[slot][inverse]
        ids = self.ids[ragged(self.at[slot][inverse], n)]
        per_text = np.append(0, np.cumsum(n))[np.searchsorted(first, offsets)]
        return ids, per_text


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Encoder(path, pattern)
    return _open[path, pattern]


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, one row at least."""
    _, off = w.column_bytes(texts)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """32-bit values as one little-endian byte string for each text."""
    raw = pa.py_buffer(np.ascontiguousarray(values, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(4 * offsets, np.int64)), raw]).cast(pa.binary())


def encode_lessons(lessons: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """BPE ids of each lesson and where each token stands.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns are not read.  ``path``
    is a file of the tokenizers library, or of ranks (one base64 token and its rank a line)
    if the split ``pattern`` is given.  Returns ``lesson_id``, ``n_tokens``, ``token_ids``
    and ``starts``: ids, and the character in which each token begins (tokens that begin
    inside a character have that one), as little-endian unsigned 32-bit integers.  A null
    body is empty and has no tokens; strings of special tokens are ordinary text; an empty
    table gives an empty result.  A worker holds slices of a batch and a bounded cache.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            for a, b in slices(batch["body"]):
                part = batch.slice(a, b - a)
                data, offsets = w.column_bytes(part["body"])
                ids, per_text = tool(data, offsets)
                # byte of each token, then the character that this byte lies in
                at = np.append(0, np.cumsum(tool.size[ids]))[:-1]
                char = np.cumsum((data & 0xC0) != 0x80)
                before = np.append(0, char)[offsets[:-1]]
                starts = (char[at] - 1 - np.repeat(before, np.diff(per_text))).astype("<u4") if len(at) else np.zeros(0, "<u4")
                yield pa.RecordBatch.from_pydict({
                    "lesson_id": part["lesson_id"], "n_tokens": pa.array(np.diff(per_text), pa.int64()),
                    "token_ids": _binary(ids, per_text), "starts": _binary(starts, per_text)})

    return lessons.selectExpr("cast(lesson_id as bigint) lesson_id", "body").mapInArrow(w.tidy(encode), "lesson_id bigint, n_tokens bigint, token_ids binary, starts binary")


def decode_lessons(tokens: DataFrame, path: str, pattern: str | None = None, keep: tuple[str, ...] = ("lesson_id",)) -> DataFrame:
    """Bytes that token ids stand for.

    tokens: ``token_ids`` as ``encode_lessons`` gives them and the columns to ``keep``.
    Adds ``decoded``, the bytes of all tokens in a row, so characters that are split over
    tokens come together again; ids cut anywhere decode to the bytes they have.  Null ids
    decode to no bytes.  An id outside the vocabulary is an error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begin = token_bytes(path, pattern)
        sizes = np.diff(begin)
        for batch in batches:
            raw = batch.column(len(keep)).fill_null(b"").cast(pa.large_binary())
            off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            a = 0
            while a < len(raw):
                b = max(a + 1, int(np.searchsorted(off, off[a] + (2 << 20), side="right")) - 1)
                ids = np.frombuffer(raw.buffers()[2], "<u4", (off[b] - off[a]) // 4, int(off[a])) if off[b] > off[a] else np.zeros(0, "<u4")
                size = sizes[ids]
                data = table[ragged(begin[ids], size)]
                ends = np.append(0, np.cumsum(size))[(off[a : b + 1] - off[a]) // 4]
                texts = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_pydict({**{k: batch.column(i).slice(a, b - a) for i, k in enumerate(keep)}, "decoded": texts.cast(pa.binary())})
                a = b

    kinds = dict(tokens.dtypes)
    return tokens.select(*keep, "token_ids").mapInArrow(w.tidy(decode), ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", decoded binary")
