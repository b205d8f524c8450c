"""The ten operators and the pipeline as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        _queries[key] = fn
        if sql is not None:
            _oracles[key] = sql
        return fn

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    return dict(_oracles)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.ngram_jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from slipmark.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_QUALITY = r"""
with w as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents
), measured as (
    select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, words
    from w
), win as (
    select doc_id, i, {'a': words[i], 'b': words[i + 1], 'c': words[i + 2]} as win
    from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from measured where len(words) > 2)
), again as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from win) where n > 1
), covered as (
    select doc_id, sum(least(3, i - coalesce(p, i - 3))) as n
    from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from again) group by doc_id
), failed as (
    select m.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
        cast(n_words < 50 as bigint) as f0, cast(100 * coalesce(c.n, 0) > 50 * n_words as bigint) as f1,
        cast(5 * n_symbols > n_words as bigint) as f2, cast(2 * n_dup_lines > n_lines as bigint) as f3,
        cast(word_chars < 2 * n_words as bigint) as f4, cast(word_chars > 16 * n_words as bigint) as f5
    from measured m left join covered c on m.doc_id = c.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 as bits, f0 + f1 > 0 as base_failed,
    f0 + f1 + f2 + f3 + f4 + f5 = 0 as kept
from failed
"""


@query("op6_quality_rules", _QUALITY)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.quality_rules import quality

    return quality(_table(spark, sf_dir, "documents"))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


@query("op10_sainte_lague_mix")
def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.secrets import digest, scan_secrets

    return digest(scan_secrets(_table(spark, sf_dir, "documents")))


@query("op9_chat_format")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from slipmark.llm.chat import digest, format_conversations

    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return digest(format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


@query("op1_template_decontamination")
def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op2_chained_passages")
def op2_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


_FIXITY = """
with bodies as (
    select page_id, coalesce(url, '') as url, coalesce(html, '') as body from pages
), records as (
    select page_id, 'crawl-' || (page_id // 1000) || '.warc' as file,
        length('WARC/1.1..WARC-Type: resource..WARC-Record-ID: <urn:page:>..WARC-Target-URI: ..Content-Type: text/html..'
            || 'Content-Length: ........') + length(cast(page_id as varchar)) + strlen(url) + strlen(body)
            + length(cast(strlen(body) as varchar)) as length
    from bodies
), marked as (
    select *, (page_id * 104729) % 499 = 1 as lost, (page_id * 15485863) % 997 = 2 as late, (page_id * 7919) % 211 = 0 as flipped
    from records
), placed as (
    select *, cast(coalesce(sum(case when not late or lost then length end) over before, 0) as bigint) as first_offset,
        cast(coalesce(sum(case when not lost then length end) over before, 0) as bigint) as second_offset
    from marked window before as (partition by file order by page_id rows between unbounded preceding and 1 preceding)
)
select page_id, file, case when late and not lost then second_offset else first_offset end as "offset",
    case when lost then 'missing' when late then 'extra' else 'changed' end as status,
    case when not lost then second_offset end as second_offset
from placed where lost or late or flipped
"""


@query("op3_merkle_fixity", _FIXITY)
def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the pages' WARC files, each without some records and so with offsets of its own; one has changed bytes.

    The first and the second offsets are those of the replicas' own bytes.
    """
    from pyspark.sql import functions as F

    from slipmark.llm.fixity import audit, digested, placed, warc_records

    whole = warc_records(_table(spark, sf_dir, "pages")).select("page_id", "file", "record")
    lost, late = F.expr("(page_id * 104729) % 499 = 1"), F.expr("(page_id * 15485863) % 997 = 2")
    at = F.length("record") - 4  # before the closing line breaks
    changed = F.overlay("record", F.when(F.substring(F.col("record"), at, F.lit(1)) == "?", "!").otherwise("?"), at, F.lit(1))
    kept = whole.where(~lost).withColumn("record", F.when(F.expr("(page_id * 7919) % 211 = 0"), changed).otherwise(F.col("record")))
    found = audit(placed(digested(whole.where(~late | lost))), placed(digested(kept)))
    page = F.regexp_extract("name", "<urn:page:(-?[0-9]+)>", 1).cast("long")
    return found.select(page.alias("page_id"), "file", "offset", "status", "second_offset")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op13_bounded_packing")
def op13_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from slipmark.llm.packing import digest, pack

    return digest(pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


_NEGATIVES = """
with used as (
    select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
    select a.row, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score
    from used a join used b on a.row <> b.row where a.vec_id % 50 = 0
), positives as (
    select row, anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by row order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (
        partition by p.row, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
    s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.row = s.row and not s.same
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""


@query("op12_vertical_negatives", _NEGATIVES)
def op12_vertical_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from slipmark.llm.hard_negatives import mine

    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op11_qdwh_whitening")
def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slipmark.llm.embedding_whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))
