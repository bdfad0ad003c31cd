import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken

from terraloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "token_ids string, lesson_id bigint, body string"
ODD = [
    "", None, " ", "\n", "a", "  two  spaces \n\n\n end  ", "don't we'll 'S IT'S x's's ''s", "é è x  \n\nz", "a \n b　 c", "\x1c \x1f x\x7f y\x85 z",
    "日本語 テスト。𝄞𝄞 👩‍👩‍👧 flag", "<|endoftext|> text", "1234 a1b2 3.14!", "word" * 3000, "́ combining é", "tab\tand\r\nlines\r\n", "«été», l’île—ça!", "a​ b", "   x", "!×a÷b,c",
]


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_offsets_and_round_trip(spark, known):
    rows = [("x", i, t) for i, t in enumerate(ODD)] + [("x", None, "no id"), ("x", 3, "again"), ("x", 3, "again")]
    rows += [("y", 100 + i, " ".join(ODD[j % len(ODD)] or "" for j in range(i, i + 7))) for i in range(40)]
    tokens = bpe.encode_lessons(spark.createDataFrame(rows, SCHEMA), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_lessons(tokens, RANKS, public_tokenizers.PATTERN, keep=("lesson_id", "n_tokens", "token_ids", "starts")).collect()
    got = sorted(((r["lesson_id"], list(struct.unpack(f"<{r['n_tokens']}I", r["token_ids"])), bytes(r["decoded"])) for r in back), key=repr)
    assert got == sorted(((i, known.encode_ordinary(t or ""), (t or "").encode()) for _, i, t in rows), key=repr)
    for r in back:
        text, ids = bytes(r["decoded"]).decode(), struct.unpack(f"<{r['n_tokens']}I", r["token_ids"])
        byte, starts = 0, []
        for x in ids:
            starts.append(len(text.encode()[:byte].decode(errors="ignore")))
            byte += len(known.decode_single_token_bytes(x))
        assert list(struct.unpack(f"<{len(ids)}I", r["starts"])) == starts


def test_split_characters_come_together(spark, known):
    ids = known.encode_ordinary("𝄞é")
    parts = spark.createDataFrame([(k, bytearray(struct.pack("<I", x))) for k, x in enumerate(ids)] + [(99, None)], "k int, token_ids binary")
    got = {r["k"]: bytes(r["decoded"]) for r in bpe.decode_lessons(parts, RANKS, public_tokenizers.PATTERN, keep=("k",)).collect()}
    assert b"".join(got[k] for k in range(len(ids))).decode() == "𝄞é" and got[99] == b""


def test_library_file_gives_the_same_ids(spark):
    rows = [("x", i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r["lesson_id"]: bytes(r["token_ids"]) for r in bpe.encode_lessons(df, RANKS, public_tokenizers.PATTERN).collect()}
    two = {r["lesson_id"]: bytes(r["token_ids"]) for r in bpe.encode_lessons(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert one == two


def test_empty_table(spark):
    assert bpe.encode_lessons(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).collect() == []


def test_cache_is_bounded(monkeypatch):
    import pyarrow as pa

    from terraloom.llm import words as w

    monkeypatch.setattr(bpe, "CACHE", 50)
    tool = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    for i in range(20):
        texts = [hashlib.md5(bytes([i, j])).hexdigest() + " peta" for j in range(30)]
        ids, ends = tool(*w.column_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in tool.tokenizer.encode_batch(texts)]
        assert len(tool.keys) <= 61
