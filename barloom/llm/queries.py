"""The corpus queries over a folder of tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import backoff, hard_negatives, language, line_dedup, matroska, mixing, ngram_join, packing, periodic_runs, surrogates, tokens, toxicity, vector_dedup

#: Tokenizer files are named here and read where they are.
TOKENIZERS = str(Path(public_tokenizers.path("word_bpe_49k.json")).parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_private(docs, "barloom")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.store_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.store_texts(table(spark, sf_dir, "documents")))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs.with_runs(docs.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text"))))
    best = periodic_runs.most_periodic(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("best.length * 1000 div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding"), 256).alias("vector"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_source_mix": op2_source_mix,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_token_orc": op4_token_orc,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_matroska": op8_matroska,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_backoff": op10_backoff,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language": op12_language,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op5_line_dedup": r"""
with lines as (
  select doc_id, i, lines[i] as line,
         translate(trim(lines[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, lines, unnest(generate_series(1, len(lines))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
dup as (select key, min(doc_id) as keeper from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (select l.doc_id, l.i, l.line, d.keeper is not null and l.doc_id <> d.keeper as gone from lines l left join dup d on l.key = d.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op10_backoff": r"""
with words as (
  select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
                                lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
places as (select doc_id, w, unnest(generate_series(1, len(w))) as i from words),
grams as (select doc_id, i, case when i >= 3 then w[i - 2] end as u, case when i >= 2 then w[i - 1] end as v, w[i] as x from places),
one as (select x, count(*) as c from grams group by x),
two as (select v, x, count(*) as c from grams where i >= 2 group by v, x),
three as (select u, v, x, count(*) as c from grams where i >= 3 group by u, v, x),
summed as (
  select g.doc_id, sum(case when i >= 3 then ln(three.c / before.c) when i = 2 then ln(two.c / first.c) else ln(one.c / (select count(*) from grams)) end) as s
  from grams g left join one on one.x = g.x left join two on two.v = g.v and two.x = g.x left join three on three.u = g.u and three.v = g.v and three.x = g.x
    left join two before on before.v = g.u and before.x = g.v left join one first on first.x = g.v
  group by g.doc_id)
select d.doc_id, len(w)::bigint as n_words, round(coalesce(s, 0), 4) as log_score, round(case when len(w) > 0 then s / len(w) end, 6) as mean_log_score
from words d left join summed using (doc_id)
""",
    "op11_periodic_runs": r"""
with codes as (
  select list(v order by i) as t
  from (select i, list_reduce(list_prepend(i, list_transform(range(8), lambda k: 0)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))),
ids as (
  select doc_id, text, row_number() over () as d,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from documents, codes),
texts as (select d, doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as w from ids),
places as (
  select d, w, len(w) as n, h % 10 = 0 as planted, case when len(w) > 0 then g % len(w) end as a, g, unnest(range(len(w))) as i from texts),
words as (
  select d, i, n, w[1 + case when planted and i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end] as x from places),
pairs as (select p.d, q.i - p.i as q, p.i as i from words p join words q on p.d = q.d and p.x = q.x and q.i > p.i and q.i - p.i <= p.n // 3),
islands as (select d, q, i, i - row_number() over (partition by d, q order by i) as island from pairs),
stretches as (select d, q, min(i) as s, count(*) + q as n from islands group by d, q, island having count(*) + q >= greatest(24, 3 * q)),
runs as (select * from stretches r where not exists (select 1 from stretches o where o.d = r.d and o.q < r.q and o.s <= r.s and o.s + o.n >= r.s + r.n)),
listed as (
  select d, count(*) as n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as lines,
         first(struct_pack(s := s, n := n, q := q) order by n::hugeint * 1000000000000 // q desc, s, q) as best
  from runs group by d),
gone as (select distinct d, unnest(range(s + q, s + n)) as i from runs),
left_over as (select w.d, string_agg(w.x, ' ' order by w.i) as t from words w anti join gone g on w.d = g.d and w.i = g.i group by w.d)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.n::bigint as length, best.q::bigint as period, (1000 * best.n // best.q)::bigint as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(o.t, '')) as collapsed_sha256
from texts t left join listed l on l.d = t.d left join left_over o on o.d = t.d
""",
    "op13_hard_negatives": """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as s
  from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, other_id as positive_id, s as positive_score from scores where same qualify row_number() over (partition by anchor_id order by s desc, other_id) <= 5)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by n.s desc, n.other_id))::int as rank, n.other_id as negative_id, p.positive_score, n.s as negative_score
from positives p join scores n on n.anchor_id = p.anchor_id and not n.same and 80 * p.positive_score <= 100 * n.s and 100 * n.s <= 100 * p.positive_score
qualify rank <= 5
""",
}
