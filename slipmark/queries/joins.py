"""Joins between questions, responses and earlier results."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipmark.functions import text
from slipmark.functions.lets import array_rows, strip
from slipmark.functions.numbers import number_intervention
from slipmark.operators import containment, filters, joins, paging
from slipmark.queries import views as V
from slipmark.queries.numbers import candidates_sql, outputs_sql
from slipmark.queries.prompts import with_each
from slipmark.queries.registry import query
from slipmark.sources.scratch import stored

# Questions asked again: the whole question for early orders' statuses, only the body or a short form for others.
_ASKED_SQL = """
asked as (select row_id, case ls when 'F' then concat(body, ' ', ask) else concat(body, chr(13)) end as question
          from problems join lines using (row_id)
          union all select concat('s', row_id), concat(' ', left(body, 24), ' ') from problems
          union all select concat('d', cast(doc_id as varchar)), text from documents),
logged as (select replace(case when error_type is null then question else full_prompt end, chr(13), '') as t
           from response_log where model = 'gpt-4-0314' and style = 'sbs' and answer is not null and answer <> '')"""


def _asked(spark, sf_dir):
    base = V.lines(spark, sf_dir)
    body = V._body()
    one = base.select("row_id", F.when(F.col("ls") == "F", F.concat(body, F.lit(" " + V.ASK))).otherwise(
        F.concat(body, F.lit("\r"))).alias("question"))
    short = base.select(F.concat(F.lit("s"), "row_id").alias("row_id"), F.concat(
        F.lit(" "), F.left(body, F.lit(24)), F.lit(" ")).alias("question"))
    docs = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text")
    return one.unionAll(short).unionAll(docs)


@query("resume_anti_containment", "with " + _ASKED_SQL.strip() + r"""
select row_id, question from (
  select row_id, question, trim(replace(question, chr(13), ''), concat(' ', chr(10), chr(9), chr(11), chr(12), chr(160))) as q from asked)
where not exists (select 1 from logged where contains(t, q))""", "response_log")
def resume_anti_containment(spark, sf_dir):
    log = V.response_log(spark, sf_dir).where("model = 'gpt-4-0314' and style = 'sbs'")
    log = log.where(~text.is_blank(F.col("answer"))).select(
        F.when(F.col("error_type").isNull(), F.col("question")).otherwise(F.col("full_prompt")).alias("question"))
    return containment.drop_contained(_asked(spark, sf_dir), log)


@query("align_responses", """
select p.row_id, concat(p.body, ' ', p.ask) as question, r.answer
from problems p left join (select question, answer from response_log where model = 'gpt-4-0314') r
  on r.question = concat(p.body, ' ', p.ask)""", "response_log")
def align_responses(spark, sf_dir):
    asked = V.problems(spark, sf_dir).select(
        "row_id", text.assemble_question(F.col("body"), F.col("ask")).alias("question"))
    got = V.response_log(spark, sf_dir).where("model = 'gpt-4-0314'").select("question", "answer")
    return joins.align_responses(asked, got, ["question"])


@query("align_responses_repeated", """
select p.row_id, concat(p.body, ' ', p.ask) as question, 'again' || r.answer as answer
from problems p left join (select question, answer from response_log where model = 'gpt-4-0314') r
  on r.question = concat(p.body, ' ', p.ask)""", "response_log")
def align_responses_repeated(spark, sf_dir):
    """Answered questions were asked twice: the later response counts."""
    asked = V.problems(spark, sf_dir).select(
        "row_id", text.assemble_question(F.col("body"), F.col("ask")).alias("question"))
    first = V.response_log(spark, sf_dir).where("model = 'gpt-4-0314'").select("question", "answer", F.lit(0).alias("run"))
    later = first.where("answer is not null").select("question", F.concat(F.lit("again"), "answer").alias("answer"), F.lit(1).alias("run"))
    return joins.align_responses(asked, later.unionAll(first), ["question"], ["run"]).select("row_id", "question", "answer")


def _right_source(extra: str = "") -> str:
    return ("(select row_id as id, full_prompt as text from scored "
            f"where ok and model = 'gpt-4-0314' and style = 'sbs'{extra})")


@query("matched_sets", candidates_sql(_right_source()) + "," + outputs_sql("copy", ["add1", "add101"]) + """
select s.question, o.text as first_text, p.text as second_text
from outputs o join outputs p on o.id = p.id and o.part_no = 0 and p.part_no = 1 join scored s on s.row_id = o.id""",
       "scored")
def matched_sets(spark, sf_dir):
    right = filters.correct_only(V.response_log(spark, sf_dir), "gpt-4-0314", "sbs")
    made = number_intervention(F.col("row_id"), F.col("full_prompt"), "copy", "add1_add101")
    sets = array_rows(right, ["question"], made)
    both = joins.matched_sets(sets, "question", ["add1", "add101"])
    return both.select("question", F.col("texts")[0].alias("first_text"), F.col("texts")[1].alias("second_text"))


@query("skip_completed", """
select row_id, question from (select row_id, concat(body, ' ', ask) as question from problems)
where question not in (select question from scored where ok)""", "scored")
def skip_completed(spark, sf_dir):
    asked = V.problems(spark, sf_dir).select(
        "row_id", text.assemble_question(F.col("body"), F.col("ask")).alias("question"))
    log = V.response_log(spark, sf_dir)
    done = log.where(~text.is_blank(F.col("answer")) & text.number_scorer(F.col("answer"), F.col("target")))
    return joins.skip_completed(asked, done, "question")


@query("logprob_cache", """
with requests as (select concat(row_id, '-', cast(n as varchar)) as request_id, question as input, target
                  from response_log, (values (1), (2)) as t(n)),
known as (select question as input, target, -(length(full_prompt) % 13) / 10.0 as logprob from response_log
          where error_type is not null)
select request_id, r.input, r.target, coalesce(k.logprob, -(length(r.input) % 7) / 10.0) as logprob,
       k.input is not null as cached
from requests r left join known k on k.input = r.input and k.target = r.target""", "response_log")
def logprob_cache(spark, sf_dir):
    log = V.response_log(spark, sf_dir)
    requests = with_each(log.select("row_id", F.col("question").alias("input"), "target"), "n", ["1", "2"]).select(
        F.concat_ws("-", "row_id", "n").alias("request_id"), "input", "target")
    known = log.where("error_type is not null").select(
        F.col("question").alias("input"), "target", (-(F.length("full_prompt") % 13) / F.lit(10.0)).alias("logprob"))
    compute = lambda missing: missing.withColumn("logprob", -(F.length("input") % 7) / F.lit(10.0))
    return joins.cached_logprobs(requests, known, compute, ["input", "target"])


@query("logprob_cache_repeated", """
select row_id as request_id, question as input, target,
       case when error_type is null then -(length(question) % 7) / 10.0
            when length(question) % 2 = 0 then -1.5 else -(length(full_prompt) % 13) / 10.0 end as logprob,
       error_type is not null as cached
from response_log""", "response_log")
def logprob_cache_repeated(spark, sf_dir):
    """Every other pair stands in the cache twice: the later value counts, and each request has one row."""
    log = V.response_log(spark, sf_dir)
    requests = log.select(F.col("row_id").alias("request_id"), F.col("question").alias("input"), "target")
    known = log.where("error_type is not null").select(
        F.col("question").alias("input"), "target", (-(F.length("full_prompt") % 13) / F.lit(10.0)).alias("logprob"), F.lit(0).alias("run"))
    later = known.where("length(input) % 2 = 0").select("input", "target", F.lit(-1.5).alias("logprob"), F.lit(1).alias("run"))
    compute = lambda missing: missing.withColumn("logprob", -(F.length("input") % 7) / F.lit(10.0))
    return joins.cached_logprobs(requests, known.unionAll(later), compute, ["input", "target"], ["run"])


@query("pair_by_position", """
select p.row_id, concat(p.body, ' ', p.ask) as question, r.answer, r.target from problems p join response_log r using (row_id)""",
       "response_log")
def pair_by_position(spark, sf_dir):
    asked = V.problems(spark, sf_dir).select(
        "row_id", text.assemble_question(F.col("body"), F.col("ask")).alias("question"))
    return joins.pair_by_position(asked, V.response_log(spark, sf_dir).select("row_id", "answer", "target"), "row_id")


@query("sample_membership", """
with sample as (select row_id from scored where ok and model = 'gpt-4-0314'
                order by md5(concat_ws('|', '7', row_id, 'sample')), row_id limit 300)
select row_id, model, row_id in (select row_id from sample) as in_sample from response_log""", "scored")
def sample_membership(spark, sf_dir):
    log = V.response_log(spark, sf_dir)
    right = log.where("model = 'gpt-4-0314'").where(
        ~text.is_blank(F.col("answer")) & text.number_scorer(F.col("answer"), F.col("target")))
    sample = stored(paging.draw_sample(right.select("row_id"), "row_id", 300), "sample")
    marked = joins.mark_sample(log.select("row_id", "model"), sample, "row_id")
    return marked.select("row_id", "model", "in_sample")


@query("collect_failures", candidates_sql(
    "(select row_id as id, concat(answer, ' ', target) as text from response_log)") + "," + outputs_sql("copy", ["add1"]) + """
select r.question, case when c.n is null then 'no number at this position' else 'number has no changed form' end as reason
from response_log r left join (select id, count(*) as n from cands where position = 'copy' group by id) c on c.id = r.row_id
where r.answer is not null and r.row_id not in (select id from outputs)""", "response_log")
def collect_failures(spark, sf_dir):
    """Answer and target as reasoning: a wrong answer has no copied number, so it fails, with the reason."""
    log = V.response_log(spark, sf_dir).where("answer is not null")
    log = log.select("row_id", "question", F.concat("answer", F.lit(" "), "target").alias("t"))
    made = stored(log.select(
        "question", number_intervention(F.col("row_id"), F.col("t"), "copy", "add1", reasons=True).alias("out")), "made")
    return joins.failures(made, "question", F.col("out.made"), F.col("out.reason"))


@query("src_prefer_annotated", """
select row_id, model, style, question, error_type, true as annotated from response_log where error_type is not null and model = 'gpt-4-0314'
union all
select row_id, model, style, question, null, false from response_log where model <> 'gpt-4-0314'""", "response_log")
def src_prefer_annotated(spark, sf_dir):
    """One model has an annotated log, so its plain rows are not used."""
    log = V.response_log(spark, sf_dir).select("row_id", "model", "style", "question", "error_type")
    annotated = log.where("error_type is not null and model = 'gpt-4-0314'").withColumn("annotated", F.lit(True))
    plain = log.drop("error_type").withColumn("annotated", F.lit(False))
    return joins.prefer_annotated(annotated, plain, ["model", "style"])


@query("perturbed_prompt", """
select row_id, case when coalesce(reasoning, '') <> '' then concat('Q: ', question, chr(10), chr(10), 'A: Let', chr(39),
       's think step by step. ', reasoning) else question end as prompt
from (select row_id, question, case when answer is null then null when answer = '' then '' else trim(answer) end as reasoning
      from response_log)""", "response_log")
def perturbed_prompt(spark, sf_dir):
    log = V.response_log(spark, sf_dir)
    return log.select("row_id", text.perturbed_prompt(F.col("question"), "sbs", strip(F.col("answer"))).alias("prompt"))
