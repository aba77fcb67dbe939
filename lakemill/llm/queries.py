"""The queries of this subpackage and the SQL that some are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.tokens import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.quality import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.suffixes import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer())


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.vectors import exact_top_k

    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.urls import labelled_urls, url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES, labelled=labelled_urls(spark))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2).drop("node", "text_hash")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.turns import repair_digests

    return repair_digests(table(spark, sf_dir, "conversations"))


def op12_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.audio import media_digests

    found = media_digests(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    x.__name__: x for x in (op1_token_files, op2_html_text, op3_quality_rules, op4_mixing, op5_repeats, op6_packing, op7_top_k, op8_url_filter, op9_licenses, op10_near_duplicates, op11_repair, op12_audio, op13_hard_negatives)
}

_RULES = """
with docs as (
  select row_number() over () as n, doc_id, source, coalesce(text, '') as text, md5(coalesce(text, '')) as digest from documents
), parts as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, string_split(text, chr(10)) as all_lines from docs
), counts as (
  select n, doc_id, source, digest, words, len(words) as n_words,
    length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
    list_filter(all_lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from parts
), windows as (
  select n, place, words[place] || ' ' || words[place + 1] || ' ' || words[place + 2] as win
  from (select n, words, unnest(range(1, len(words) - 1)) as place from counts)
), twice as (
  select n, place from (select n, place, count(*) over (partition by n, win) as times from windows) where times > 1
), covered as (
  select n, count(distinct place + step) as n_repeat_words from twice, (values (0), (1), (2)) s(step) group by n
), lines as (
  select n, source, digest, line_words, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as line
  from (select n, source, digest, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as line_words
        from (select n, source, digest, unnest(lines) as line from counts))
), hosts as (
  select source, count(distinct digest) as every from counts group by source
), frequent as (
  select l.source, l.line from lines l join hosts h on l.source is not distinct from h.source
  group by l.source, l.line, h.every having count(distinct l.digest) > 25 and count(distinct l.digest) > cast(0.05 as double) * h.every
), removed as (
  select l.n, sum(l.line_words) as lost from lines l join frequent f on l.source is not distinct from f.source and l.line = f.line group by l.n
), judged as (
  select c.doc_id, c.n_words, c.word_chars, c.n_symbols, len(c.lines) - len(list_distinct(c.lines)) as n_dup_lines,
    coalesce(v.n_repeat_words, 0) as n_repeat_words, coalesce(r.lost, 0) as lost
  from counts c left join covered v on c.n = v.n left join removed r on c.n = r.n
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (n_words - lost < cast(0.3 as double) * n_words) as kept
from judged
"""

_TOP_K = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where vec_id is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from vectors q join vectors c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 10
"""

_NEGATIVES = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and label is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), pairs as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, cast(list_dot_product(a.v, c.v) as bigint) as score
  from vectors a join vectors c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id and len(a.v) = len(c.v)
), near as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), ranked as (
  select n.anchor_id, n.positive_id, p.vec_id as negative_id, n.positive_score, p.score as negative_score,
    row_number() over (partition by n.anchor_id, n.positive_id order by p.score desc, p.vec_id) as rank
  from near n join pairs p on n.anchor_id = p.anchor_id and not p.alike
    and 30 * n.positive_score <= 100 * p.score and 100 * p.score <= 90 * n.positive_score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""

#: SQL of the queries that it can express. Others need hashes, tokenizers, forests or trees that it lacks.
ORACLES: dict[str, str] = {"op3_quality_rules": _RULES, "op7_top_k": _TOP_K, "op13_hard_negatives": _NEGATIVES}
