"""Skips, limits, samples and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipmark.functions import fixed, text
from slipmark.operators import filters, paging
from slipmark.queries import views as V
from slipmark.queries.registry import query
from slipmark.sources.scratch import new_path

BLANK_RE = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\t-\r\x1c-\x20\x85\p{Z}]"
TOKEN_LIMIT = 20_000


@query("skip_limit", "select row_id, target from problems order by row_id limit 500 offset 250", "problems")
def skip_limit(spark, sf_dir):
    """A page of the whole ordered table: skip 250, take 500."""
    return paging.skip_limit(V.problems(spark, sf_dir), ["row_id"], 250, 500).select("row_id", "target")


@query("skip_limit_rest", "select row_id, target from problems order by row_id offset 250", "problems")
def skip_limit_rest(spark, sf_dir):
    return paging.skip_limit(V.problems(spark, sf_dir).select("row_id", "target"), ["row_id"], 250, -1)


@query("round_robin_batches", """
select row_id, row_number() over (order by row_id) - 1 as row_no, (row_number() over (order by row_id) - 1) % 4 as batch
from problems""", "problems")
def round_robin_batches(spark, sf_dir):
    return paging.round_robin(V.problems(spark, sf_dir).select("row_id"), ["row_id"], 4)


@query("token_budget_batches", rf"""
with recursive items as (
  select source, doc_id, len(regexp_extract_all(text, '{BLANK_RE}')) + {fixed.MAX_TOKENS} as cost,
         row_number() over (partition by source order by doc_id) as rn from documents),
walk as (
  select source, doc_id, rn, cost, cost as total, cast(0 as bigint) as batch from items where rn = 1
  union all
  select i.source, i.doc_id, i.rn, i.cost,
         case when w.total + w.cost >= {TOKEN_LIMIT} then i.cost else w.total + i.cost end,
         w.batch + case when w.total + w.cost >= {TOKEN_LIMIT} then 1 else 0 end
  from walk w join items i on i.source = w.source and i.rn = w.rn + 1)
select source, doc_id, batch from walk""")
def token_budget_batches(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    cost = text.token_count(F.col("text")) + fixed.MAX_TOKENS
    return paging.token_budget_batches(docs, "source", ["doc_id"], cost, TOKEN_LIMIT)


@query("limit_scored", """
select row_id, ok from scored where answer is not null and answer <> '' order by row_id limit 1000""", "scored")
def limit_scored(spark, sf_dir):
    """Stop after 1,000 scored rows; blank answers do not count."""
    log = V.response_log(spark, sf_dir)
    kept = paging.limit_valid(log, ~text.is_blank(F.col("answer")), ["row_id"], 1000)
    return kept.select("row_id", text.number_scorer(F.col("answer"), F.col("target")).alias("ok"))


@query("stored_sample", f"""
select row_id, model from scored where ok and model = 'gpt-4-0314' and style = 'sbs'
order by md5(concat_ws('|', '7', row_id, 'sample')), row_id limit {fixed.SAMPLE_SIZE}""", "scored")
def stored_sample(spark, sf_dir):
    """Drawn and stored by the first call, read by the second."""
    right = filters.correct_only(V.response_log(spark, sf_dir), "gpt-4-0314", "sbs")
    path = new_path(spark, "samples")
    paging.stored_sample(right, "row_id", fixed.SAMPLE_SIZE, path, ["model"])
    return paging.stored_sample(right, "row_id", fixed.SAMPLE_SIZE, path, ["model"])


@query("skip_rows", """
select row_id, model from (select *, row_number() over (order by row_id) - 1 as n from response_log)
where n >= 777 and model = 'gpt-4-0314'""", "response_log")
def skip_rows(spark, sf_dir):
    """Skip the first rows of the log, then filter."""
    log = V.response_log(spark, sf_dir).select("row_id", "model")
    return paging.skip_rows(log, ["row_id"], 777).where("model = 'gpt-4-0314'")
