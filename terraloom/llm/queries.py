"""Registered queries of the numbered operators over the given tables.

Each maps a table to the operator's records, applies it to all rows and names the
results; digests are derived here.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import bpe, dialogue, exact, extract, fingerprint, language, near, negatives, packing, simhash, substring, toxicity, warc
from terraloom.scale import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("lesson_id"), F.col("text").alias("body"), F.col("lang").alias("language"), F.col("source").alias("folder"))


def sha256(text: str):
    return F.sha2(F.encode(text, "utf-8"), 256)


@query("op1_substring_dedup", r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::varchar[]) w from documents),
win as (select doc_id, s, array_to_string(w[s:s + 12], ' ') k
        from (select doc_id, w, unnest(range(1, len(w) - 11)) s from d where len(w) >= 13)),
low as (select k, min(doc_id) lo from win group by k),
gone as (select distinct doc_id, s + o pos from win join low using (k), range(13) t(o) where lo < doc_id),
word as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) pos from d),
kept as (select word.doc_id, count(gone.pos) n_removed, string_agg(word, ' ' order by word.pos) filter (gone.pos is null) kept
         from word left join gone on word.doc_id = gone.doc_id and word.pos = gone.pos group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join kept on d.doc_id = kept.doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(lessons(spark, sf_dir), window=13).select(
        F.col("lesson_id").alias("doc_id"), "n_words", "n_removed", sha256("kept").alias("kept_sha256"))


@query("op9_exact_dedup", r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over g keep_id, count(*) over g group_size, doc_id = min(doc_id) over g kept, text_sha256
from t window g as (partition by text_sha256)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.collapse_copies(lessons(spark, sf_dir)).select(
        F.col("lesson_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("body_sha256").alias("text_sha256"))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(lessons(spark, sf_dir)).withColumnRenamed("lesson_id", "doc_id")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode_lessons(lessons(spark, sf_dir), *vocabulary)
    return bpe.decode_lessons(tokens, *vocabulary, keep=("lesson_id", "n_tokens", "token_ids")).select(
        F.col("lesson_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_lessons(lessons(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("lesson_id", "doc_id")


def held_out(parts: int, rest: int):
    return F.coalesce(F.crc32(F.col("lesson_id").cast("string")) % parts == rest, F.lit(False))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lessons(spark, sf_dir)
    models = language.train(rows.where(~held_out(4, 2)))
    return language.identify(rows, models).select(
        F.col("lesson_id").alias("doc_id"), held_out(4, 2).alias("held_out"), F.col("language_found").alias("lang_pred"), F.col("confidence").alias("score"))


@query("op8_near_copies")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_copies(lessons(spark, sf_dir)).withColumnRenamed("lesson_id", "doc_id").drop("body_md5")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


@query("op2_warc", r"""
with t as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) payload_bytes, sha1(coalesce(html, '')) h from pages),
r as (select *, max(page_id) over (partition by h) best from t)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           cast(1 + ((cast('0x' || substr(upper(h), cast(1 + 5 * (i // 4) as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31) as int), 1)), '') payload_digest,
       case when page_id = best then 'response' else 'revisit' end record_type, case when page_id <> best then best end refers_to
from r""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages(spark, sf_dir), folder, min_revisit_bytes=0)
    return warc.read_archives(spark, folder).drop("url", "html")


@query("op6_main_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(pages(spark, sf_dir)).drop("path")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lessons(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("lesson_id"), "toxic")
    model = toxicity.train(rows, labels.where(~held_out(5, 0)))
    return toxicity.score_lessons(rows, model).select(
        F.col("lesson_id").alias("doc_id"), held_out(5, 0).alias("held_out"), "score", F.col("flagged").cast("int").alias("predicted"))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults by a checksum of conversation and turn: dropped, emptied, without full stops, repeated, from the user."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = (F.crc32(F.concat_ws(":", named("conv_id"), named("turn"))) % 20).alias("kind")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("copy")


@query("op11_conversation_repair", r"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k, coalesce(cast(conv_id as varchar), '') conv from conversations),
crc as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(k, ''), lambda ch: [cast(ascii(ch) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda v, x: case when x >= 0 then xor(v, x) else xor(v >> 1, 3988292384 * (v & 1)) end), 4294967295) % 20 kind from c),
d as (
  select conv, turn, case when kind = 4 then 'user' else role end role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
  from crc, lateral (select unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)))),
p as (select *, row_number() over (partition by conv order by turn nulls first, role, md5(text)) pos from d),
f as (
  select *, left(role, 1) initial,
         case when not regexp_matches(text, '[^ 	-]') then 'b' when row_number() over (partition by conv, role, text order by pos) > 1 then 'd'
              when not regexp_matches(text, '[.!?][ 	-]*\z') then 't' else '' end fault from p),
counts as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
         count(*) filter (fault = 't') truncated, max(pos) n from f group by 1),
pairs as (select conv, initial || lead(initial) over (partition by conv order by pos) two from f),
wrong as (select conv, count(*) illegal from pairs where two is not null and two not in ('su', 'ua', 'au') group by 1),
step(p, r, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(p, q, c, x) as (values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
edit as (
  select conv, pos, s.p, s.q, case when s.r = initial then 0 else 1 end + case when fault = 't' then 5 else 0 end c, case when s.r = initial then 'K' else 'R' end x
  from f join step s on s.r = f.initial or s.r in ('u', 'a') where fault not in ('b', 'd')
  union all select conv, pos, s, s, 2, 'D' from f, range(4) t(s)),
moves as (select conv, pos, edit.p, ins.q, min({'c': edit.c + ins.c, 'x': edit.x || ins.x}) m from edit join ins on edit.q = ins.p group by 1, 2, 3, 4),
dp as (
  select conv, 0::bigint pos, q, {'c': c, 'x': x} m from counts, ins where p = 0
  union all
  select dp.conv, dp.pos + 1, moves.q, min({'c': dp.m.c + moves.m.c, 'x': dp.m.x || moves.m.x})
  from dp join moves on dp.conv = moves.conv and moves.pos = dp.pos + 1 and moves.p = dp.q group by 1, 2, 3),
won as (select conv, min(m) m from dp join counts using (conv) where dp.pos = counts.n and q in (0, 3) group by 1),
letters as (select conv, m.x audit, unnest(string_split(m.x, '')) l, unnest(range(1, length(m.x) + 1)) i from won where m.x <> ''),
placed as (
  select *, sum(cast(l <> 'I' as int)) over (partition by conv order by i) pos, sum(cast(l <> 'D' as int)) over (partition by conv order by i) j,
         sum(cast(l <> 'D' as int)) over (partition by conv) m from letters),
repaired as (
  select placed.conv, string_agg(case when l = 'K' then f.role || ':' || f.text else case when (j + m) % 2 = 1 then 'user:' else 'assistant:' end || case when l = 'R' then f.text else '' end end,
         chr(10) order by i) body
  from placed left join f on l <> 'I' and f.conv = placed.conv and f.pos = placed.pos where l <> 'D' group by 1)
select cast(nullif(o.conv, '') as bigint) conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
       coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(m.c, 0)::bigint "cost", coalesce(m.x, '') audit, sha256(coalesce(body, '')) repaired_sha256
from (select distinct conv from c) o left join counts on counts.conv = o.conv left join wrong on wrong.conv = o.conv
left join won on won.conv = o.conv left join repaired on repaired.conv = o.conv""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    fixed = dialogue.repair_conversations(damaged(turns)).withColumnRenamed("conv_id", "_id")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return turns.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


@query("op12_hard_negatives", """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id anchor_id, b.vec_id other, a.label = b.label same,
         coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::bigint score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as int) "rank", other negative_id, positive_score, score negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other) qualify row_number() over w <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select(F.col("vec_id").alias("patch_id"), F.col("embedding").alias("bands"), label.alias("cover")))


@query("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(lessons(spark, sf_dir)).withColumnRenamed("lesson_id", "doc_id")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
