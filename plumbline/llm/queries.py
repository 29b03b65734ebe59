"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    byte_bpe, embedding_dedup, exact_dedup, filter_audit, langid, lm_score, mixing, ngram_join, pieces, ranked_search,
    repair, substring_dedup, warc,
)
from plumbline.llm.frames import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted, (size, whole, target, _, copies) = mixing.mix_counts(docs)
    return counted.selectExpr(
        "doc_id", f"{size} AS size", f"{whole} AS source_size", f"{target} AS target", f"{size} * {copies} AS taken"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told, (ids, n, lossless) = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
    return told.select("doc_id", F.col(ids).alias("piece_ids"), F.col(n).alias("n_pieces"), F.col(lossless).alias("lossless"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_on(docs)
    told, (lang, score, rejected) = langid.identify(docs.select("doc_id", "text"), model)
    return told.select(
        "doc_id",
        langid.is_held_out(F.col("doc_id")).alias("held_out"),
        F.col(lang).alias("lang_pred"),
        F.col(score).alias("score"),
        F.col(rejected).alias("rejected"),
    )


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = repair.packed_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item, over all documents and whole texts."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text, and of the bytes these decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    told, ids = byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, keep_text=False)
    told, raw = byte_bpe.decoded(told, ranks, ids)
    decimal = F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary")
    return told.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2(raw, 256).alias("decoded_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove at each step of every order, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_repair_ids": op6_repair_ids,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_filter_audit": op13_filter_audit,
}

_SPACES = r"[\x20\x09-\x0D]"
_WORDS = r"[^\x20\x09-\x0D]+"

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """
reach(a, b) as (
  select id, id from nodes
  union
  select reach.a, links.b from reach join links on reach.b = links.a)"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::bigint as size
  from documents),
per_source as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
    source_size * 2.0::double as cap
  from per_source),
tried as (
  select *, (sum(source_size) over () * 1.5::double - (sum(cap) over up - cap))
      / (sum(weight) over () - sum(weight) over up + weight) as attempt
  from weighed
  window up as (order by cap / weight, source nulls last rows between unbounded preceding and current row)),
levelled as (
  select *, (select arg_min(attempt, cap / weight) from tried where attempt * weight <= cap) as level
  from tried),
targets as (
  select source, source_size, least(cap, coalesce(level * weight, cap)) as target from levelled),
rates as (
  select *, case when source_size > 0 then target / source_size else 0 end as rate from targets)
select doc_id, size, source_size, target,
  (size * (floor(rate)::bigint + case when
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '-')), 1, 13))::bigint / 4503599627370496.0::double
    < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sized join rates on sized.source is not distinct from rates.source""",
    "op2_warc": """
with paid as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
firsts as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as original
  from paid)
select page_id, payload_bytes, payload_digest,
  case when original = page_id then 'response' else 'revisit' end as record_type,
  case when original <> page_id then original end as refers_to
from firsts""",
    "op7_exact_dedup": f"""
with normal as (
  select doc_id, length(coalesce(text, '')) as chars,
    regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g') as norm
  from documents),
grouped as (
  select doc_id, norm, count(*) over (partition by norm) as group_size,
    first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id
  from normal)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from grouped""",
    "op9_embedding_dedup": f"""
with recursive vectors as (
  select vec_id as id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select x.id as a, y.id as b from vectors x join vectors y
    on x.label = y.label and x.id <> y.id and len(x.v) = len(y.v)
  where list_cosine_similarity(x.v, y.v) >= 0.98),
nodes as (select vec_id as id from embeddings),{_COMPONENTS},
grouped as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from links group by a)
select id as vec_id, coalesce(n, 0)::bigint as n_links, component_id, id = component_id as kept
from nodes join grouped on grouped.a = id left join degree on degree.a = id""",
    "op10_ngram_join": f"""
with recursive worded as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(
    case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as s
  from worded),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select x.doc_id as a, y.doc_id as b
  from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id
  join sizes m on m.doc_id = x.doc_id join sizes n on n.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, m.n, n.n
  having 100 * count(*) >= 85 * (m.n + n.n - count(*))),
nodes as (select doc_id as id from documents),{_COMPONENTS}
select a as doc_id, coalesce(n, 0)::bigint as n_shingles, min(b) as component_id
from reach left join sizes on sizes.doc_id = a group by a, n""",
    "op11_ranked_search": f"""
with terms as (
  select doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') as w from documents),
sizes as (select doc_id, len(w)::bigint as n from terms where len(w) > 0),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from sizes),
counts as (select doc_id, t, count(*)::bigint as tf from (select doc_id, unnest(w) as t from terms) group by doc_id, t),
weights as (
  select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select t, count(*)::bigint as df from counts group by t), corpus),
asked as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) as t from benchmark),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::bigint as score
  from asked join counts using (t) join weights using (t) join sizes using (doc_id), corpus
  group by item_id, doc_id),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10""",
    "op13_filter_audit": f"""
with recursive letters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
grown(o) as (select l from letters union all select o || l from grown, letters where length(o) < 5 and not contains(o, l)),
steps as (
  select o as filter_order, s::int as step, substr(o, s::int, 1) as f, substr(o, 1, s::int - 1) as earlier
  from grown, range(1, 6) as r(s) where length(o) = 5),
texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w
  from documents),
marks as (
  select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic
  from labels group by doc_id),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, concat(
    case when len(w) < 50 then 'A' else '' end,
    case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end,
    case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 'C' else '' end,
    case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
    case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) as fails
  from texts left join marks using (doc_id)),
patterns as (
  select part, fails, count(*)::bigint as n, sum(good)::bigint as good, sum(toxic)::bigint as toxic from failed group by part, fails),
told as (
  select part, filter_order, step, f,
    sum(case when translate(earlier || f, fails, '') = earlier || f then n else 0 end)::bigint as kept,
    sum(case when contains(fails, f) and translate(earlier, fails, '') = earlier then n else 0 end)::bigint as removed,
    sum(case when contains(fails, f) and translate(earlier, fails, '') <> earlier then n else 0 end)::bigint as redundant,
    sum(case when fails = f then n else 0 end)::bigint as unique_fails,
    sum(case when contains(fails, f) and translate(earlier, fails, '') = earlier then good else 0 end)::bigint as good_lost,
    sum(case when contains(fails, f) and translate(earlier, fails, '') = earlier then toxic else 0 end)::bigint as toxic_lost
  from patterns, steps group by part, filter_order, step, f)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, f)::bigint as shapley
from told""",
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
