"""Summaries, runs, first and last rows, target log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipmark.functions import logprobs
from slipmark.operators import aggregates
from slipmark.queries import views as V
from slipmark.queries.registry import query

SUMMARY_SQL = """count(ok) as trials, avg(cast(ok as int)) as score, 'number_scorer' as scorer,
       min(start_ts) as start_time, max(end_ts) as end_time"""
ANSWERED = "(select * from scored where answer is not null and answer <> '')"


@query("score_summary", f"select model, style, {SUMMARY_SQL} from {ANSWERED} group by model, style", "scored")
def score_summary(spark, sf_dir):
    return aggregates.score_summary(V.response_log(spark, sf_dir), ["model", "style"])


@query("chunk_summary", f"""
select cast(floor(row_no / 100) as bigint) as chunk, {SUMMARY_SQL}
from (select *, row_number() over (order by row_id) - 1 as row_no from scored)
where answer is not null and answer <> '' group by 1""", "scored")
def chunk_summary(spark, sf_dir):
    return aggregates.chunk_summary(V.response_log(spark, sf_dir), ["row_id"])


@query("run_summary", f"""
select style as log_file, model, {SUMMARY_SQL}
from (select *, row_number() over (partition by style order by row_id)
                - row_number() over (partition by style, model order by row_id) as island from {ANSWERED})
group by style, model, island""", "scored")
def run_summary(spark, sf_dir):
    """The log of one style as one log file, as in one file the rows of several models follow each other."""
    log = V.response_log(spark, sf_dir).withColumn("log_file", F.col("style"))
    return aggregates.run_summary(log, "log_file", ["row_id"]).drop("run_no")


@query("run_summary_blanks", f"""
select style as log_file, model, {SUMMARY_SQL}
from (select * exclude (ok), answer is not null and answer <> '' and ok as ok, row_number() over (partition by style order by row_id)
                - row_number() over (partition by style, model order by row_id) as island from scored)
group by style, model, island""", "scored")
def run_summary_blanks(spark, sf_dir):
    """As in scoring a log again: a row without an answer is a wrong trial and ends a run of another model."""
    log = V.response_log(spark, sf_dir).withColumn("log_file", F.col("style"))
    return aggregates.run_summary(log, "log_file", ["row_id"], count_blank=True).drop("run_no")


_TWICE = """twice as (select *, 0 as copy, row_id || '-0' as place from response_log
                      union all select *, 1, row_id || '-1' from response_log where answer is not null)"""


def _twice(spark, sf_dir):
    """The log with a second row for each answered question, as after a second run."""
    log = V.response_log(spark, sf_dir).select("row_id", "question", "answer")
    again = log.where("answer is not null")
    with_place = lambda d, n: d.select("question", "answer", F.concat("row_id", F.lit(f"-{n}")).alias("place"))
    return with_place(log, 0).unionAll(with_place(again, 1))


@query("first_wins_dedupe", f"""
with {_TWICE} select question, arg_min(answer_or_mark, place) as answer, min(place) as place
from (select *, coalesce(answer, '<none>') as answer_or_mark from twice) group by question""", "response_log")
def first_wins_dedupe(spark, sf_dir):
    kept = aggregates.first_wins(_twice(spark, sf_dir), "question", "place")
    return kept.select("question", F.coalesce("answer", F.lit("<none>")).alias("answer"), "place")


@query("last_wins_dedupe", f"""
with {_TWICE} select question, arg_max(answer_or_mark, place) as answer, max(place) as place
from (select *, coalesce(answer, '<none>') as answer_or_mark from twice) group by question""", "response_log")
def last_wins_dedupe(spark, sf_dir):
    kept = aggregates.last_wins(_twice(spark, sf_dir), "question", "place")
    return kept.select("question", F.coalesce("answer", F.lit("<none>")).alias("answer"), "place")


_STRIP = "trim({}, concat(' ', chr(10), chr(9), chr(13)))"


@query("target_logprob", f"""
with t as (select *, {_STRIP.format("token")} as word from token_logprobs),
tails as (select *, {_STRIP.format("string_agg(token, '') over (partition by row_id order by i rows between 4 preceding and current row)")} as seen
          from t),
found as (select row_id, min(i) as at from tails
          where seen = case when seen = '' then {_STRIP.format("explanation")} else right({_STRIP.format("explanation")}, length(seen)) end
          group by row_id),
used as (select t.*, string_agg(token, '') over (partition by t.row_id order by i) as answer_text
         from t join found f on f.row_id = t.row_id and t.i > f.at
         where word <> '' and contains(target, word)),
kept as (select *, coalesce(lag(answer_text) over (partition by row_id order by i), '') as earlier from used)
select a.row_id, coalesce(round(sum(logprob), 6), 0) as logprob, coalesce(max_by(answer_text, i), '') as answer_text,
       cast(count(i) as int) as n_tokens
from (select distinct row_id from t) a left join (select * from kept where not contains(earlier, target)) k using (row_id)
group by a.row_id""", "token_logprobs")
def target_logprob(spark, sf_dir):
    made = V.token_records(spark, sf_dir).select("row_id", logprobs.record_logprob(F.col("record")).alias("m"))
    return made.select("row_id", F.round("m.logprob", 6).alias("logprob"), "m.answer_text", "m.n_tokens")
