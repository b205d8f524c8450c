"""Whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipmark.functions import fixed, messages, text
from slipmark.operators import aggregates, filters
from slipmark.plans import evaluate, generate, ledger, scoring, tasksets
from slipmark.queries import views as V
from slipmark.queries.aggregates import SUMMARY_SQL
from slipmark.queries.joins import _right_source
from slipmark.queries.letters import STRIP, noisy_sql, positions_sql
from slipmark.queries.numbers import candidates_sql, outputs_sql
from slipmark.queries.registry import query
from slipmark.sources import logs, problems
from slipmark.sources.scratch import new_path, released, stored
from slipmark.streaming import chunks
from slipmark.streaming.scoring import incremental_scoring

GPT, STYLE = "gpt-4-0314", "sbs"


def accuracy_and_taskset(spark, sf_dir):
    """Trials and share of right answers by model and style, and how many right ones give a changed text."""
    from slipmark.functions.numbers import number_intervention

    log = V.response_log(spark, sf_dir)
    scored = aggregates.scored_rows(log)
    made = number_intervention(F.col("row_id"), F.col("full_prompt"), "copy", "random")
    changed = F.when(F.col("ok"), F.size(made))
    return scored.groupBy("model", "style").agg(
        F.count("ok").alias("trials"),
        F.avg(F.col("ok").cast("double")).alias("score"),
        F.sum(changed).alias("changed_texts"),
    )


_ALL_RIGHT = "(select row_id as id, full_prompt as text from scored where ok and answer <> '')"


@query("accuracy_and_taskset", candidates_sql(_ALL_RIGHT) + "," + outputs_sql("copy", ["random"]) + """
select model, style, count(ok) as trials, avg(cast(ok as int)) as score, sum(case when ok then coalesce(n, 0) end)::bigint as changed_texts
from scored left join (select id, count(*) as n from outputs group by id) o on o.id = row_id
where answer is not null and answer <> '' group by model, style""", "scored")
def _accuracy_and_taskset(spark, sf_dir):
    return accuracy_and_taskset(spark, sf_dir)


def _number_taskset(spark, sf_dir, **options):
    return tasksets.build_number_taskset(V.response_log(spark, sf_dir), GPT, STYLE, **options)


_NUMBER_ROWS = """
select s.question, s.target, o.part_no, o.perturbation, o.text from outputs o join scored s on s.row_id = o.id"""


@query("build_number_taskset", candidates_sql(_right_source()) + "," + outputs_sql("propcalc", ["add1", "add101"], False)
       + _NUMBER_ROWS, "scored")
def build_number_taskset(spark, sf_dir):
    return _number_taskset(spark, sf_dir, position="propcalc", perturbation="add1_add101").rows


@query("build_number_taskset_resumed", candidates_sql(_right_source(" and error_type is null")) + ","
       + outputs_sql("copy", ["random"]) + _NUMBER_ROWS, "scored")
def build_number_taskset_resumed(spark, sf_dir):
    """Annotated questions count as done in an earlier run; the data set pads numbers."""
    done = V.response_log(spark, sf_dir).where("error_type is not null").select("question")
    return _number_taskset(spark, sf_dir, taskset="MultiArith", position="copy", perturbation="random", done=done).rows


@query("build_number_taskset_sampled", candidates_sql(f"""(select row_id as id, full_prompt as text from scored
   where ok and model = '{GPT}' and style = '{STYLE}' order by md5(concat_ws('|', '7', row_id, 'sample')), row_id limit 300)""")
       + "," + outputs_sql("copy", ["random"], False) + _NUMBER_ROWS, "scored")
def build_number_taskset_sampled(spark, sf_dir):
    """From the stored sample of 300 right answers."""
    return _number_taskset(
        spark, sf_dir, position="copy", perturbation="random", sample_size=fixed.SAMPLE_SIZE,
        sample_path=new_path(spark, "samples")).rows


@query("sink_task_map", candidates_sql(_right_source()) + "," + outputs_sql("calc", ["add1", "add101"], False) + """
select s.question, o.text as reasoning, s.target, o.perturbation from outputs o join scored s on s.row_id = o.id""", "scored")
def sink_task_map(spark, sf_dir):
    """One JSON map per perturbation, read back."""
    rows = stored(_number_taskset(spark, sf_dir, position="calc", perturbation="add1_add101").rows, "taskset")
    path = new_path(spark, "taskmaps")
    names = ["add1", "add101"]
    problems.write_task_maps(rows, path, names)
    back = [
        problems.read_task_map(spark, f"{path}/perturbation={n}").withColumn("perturbation", F.lit(n)) for n in names
    ]
    return back[0].unionByName(back[1]).select("question", "reasoning", "target", "perturbation")


@query("taskset_resume_merged", candidates_sql(_right_source()) + "," + outputs_sql("propcalc", ["add1", "add101"], False)
       + """
select s.question, s.target, o.part_no, o.perturbation, case when s.error_type = 'calculation' then concat('Earlier: ', o.text) else o.text end as text
from outputs o join scored s on s.row_id = o.id""", "scored")
def taskset_resume_merged(spark, sf_dir):
    """Maps of an earlier run, written and read: one perturbation has the annotated questions, the other one those of one error
    type. Only questions in both maps are taken over; the result has old and new ones."""
    names = ["add1", "add101"]
    log = V.response_log(spark, sf_dir)
    before = _number_taskset(spark, sf_dir, position="propcalc", perturbation="add1_add101").rows
    types = log.where((F.col("model") == GPT) & (F.col("style") == STYLE)).where("error_type is not null").select("question", "error_type")
    held = before.join(types, "question").where("perturbation = 'add1' or error_type = 'calculation'")
    path = new_path(spark, "earlier-maps")
    problems.write_task_maps(held.withColumn("text", F.concat(F.lit("Earlier: "), "text")), path, names)
    earlier = problems.read_task_maps(spark, path, names)
    return _number_taskset(spark, sf_dir, position="propcalc", perturbation="add1_add101", earlier=earlier).rows


@query("build_letter_taskset_original", f"""with recursive src as (
  select row_id as id, question, target, split_part(full_prompt, 'think step by step.', 2) as t
  from (select *, row_number() over (order by row_id) as place from scored)
  where place > 500 and ok and answer <> '' and model = '{GPT}' and style = '{STYLE}'
  order by md5(concat_ws('|', '7', row_id, 'sample')), row_id limit 300),
counted as (select *, len(regexp_extract_all(t, '\\p{{L}}')) as n from src),""".replace("\\\\", "\\") + positions_sql("counted", 10)
       + f"""
select s.question, s.target, 0 as part_no, 'typo10' as perturbation, trim(z.t, {STRIP}) as text
from ({noisy_sql("counted", "'letter:typo10'", 11, 10)}) z join src s on s.id = z.id""", "scored")
def build_letter_taskset_original(spark, sf_dir):
    """Letter noise on the right answers of the original log: its first 500 rows are skipped, and 300 of the rest sampled."""
    log = V.response_log(spark, sf_dir)
    asked = log.withColumn("question", F.split_part("full_prompt", F.lit(" step by step"), F.lit(1)))
    rows = tasksets.letter_input_of_original(asked, GPT, STYLE, ["row_id"], skip=500, sample_size=fixed.SAMPLE_SIZE)
    return tasksets.build_letter_taskset(rows, "typo10").rows


@query("build_letter_taskset", candidates_sql(_right_source()).replace("with ", "with recursive ", 1) + ","
       + outputs_sql("copy", ["random"], False)
       + r""", counted as (select id, text as t, len(regexp_extract_all(text, '\p{L}')) as n from outputs),"""
       + positions_sql("counted", 10)
       + f"""
select s.question, s.target, 0 as part_no, 'typo10' as perturbation, trim(z.t, {STRIP}) as text
from ({noisy_sql("counted", "'letter:typo10'", 11, 10)}) z join scored s on s.row_id = z.id""", "scored")
def build_letter_taskset(spark, sf_dir):
    """Letter noise on a number task set; short texts without enough letters fail."""
    made = _number_taskset(spark, sf_dir, position="copy", perturbation="random").rows
    log = V.response_log(spark, sf_dir).select("question", "row_id")
    rows = made.select("question", F.col("text").alias("reasoning"), "target").join(log, "question")
    return tasksets.build_letter_taskset(rows, "typo10").rows


@query("build_letter_taskset_log", f"""with recursive src as (
  select row_id as id, target, split_part(full_prompt, 'think step by step.', 2) as t, concat('Box ', split_part(split_part(full_prompt, concat(chr(10), chr(10), 'A:'), 1), 'Box ', 2)) as question
  from response_log where model = '{GPT}' and style = '{STYLE}' and error_type = 'copying'),
counted as (select *, len(regexp_extract_all(t, '\\p{{L}}')) as n from src),""".replace("\\\\", "\\") + positions_sql("counted", 10)
       + f"""
select s.question, s.target, 0 as part_no, 'typo10' as perturbation, trim(z.t, {STRIP}) as text
from ({noisy_sql("counted", "'letter:typo10'", 11, 10)}) z join src s on s.id = z.id""", "response_log")
def build_letter_taskset_log(spark, sf_dir):
    """Letter noise on an annotated log, whose questions hold the changed texts; the task map is the fallback."""
    log = V.response_log(spark, sf_dir)
    annotated = log.withColumn("question", F.col("full_prompt"))
    plain = log.select("question", F.col("full_prompt").alias("reasoning"), "target", "row_id")
    taskset = "test_adjusted_position-copy_perturbation-random"
    rows = tasksets.choose_letter_input(annotated, plain, taskset, GPT, STYLE, ["row_id"])
    return tasksets.build_letter_taskset(rows, "typo10").rows


def _replayed(log):
    recorded = log.select("question", F.col("answer").alias("response"), "start_ts", "end_ts")
    return lambda rows, attempt: generate.replay(rows, recorded, ["question"])


@query("evaluate_dataset", f"""
with asked as (select p.row_id, concat(p.body, ' ', p.ask) as question, p.target from problems p
               where concat(p.body, ' ', p.ask) not in (select question from response_log
                     where model = '{GPT}' and style = '{STYLE}' and error_type = 'copying' and answer is not null and answer <> '')),
answers as (select a.row_id, s.ok, s.answer, s.start_ts, s.end_ts, row_number() over (order by a.row_id) - 1 as n
            from asked a left join (select * from scored where model = '{GPT}' and style = '{STYLE}') s using (row_id))
select 'test' as taskset, '{GPT}' as model, '{STYLE}' as style, cast(floor(n / 100) as bigint) as chunk, {SUMMARY_SQL}
from answers where answer is not null and answer <> '' group by 4""", "scored")
def evaluate_dataset(spark, sf_dir):
    """All problems put to one model; the answers of an earlier run are not asked again."""
    p = V.problems(spark, sf_dir)
    asked = p.select("row_id", text.assemble_question(F.col("body"), F.col("ask")).alias("question"),
                     text.extract_target(F.col("answer_steps")).alias("target"))
    log = V.response_log(spark, sf_dir).where((F.col("model") == GPT) & (F.col("style") == STYLE))
    earlier = log.where((F.col("error_type") == "copying") & ~text.is_blank(F.col("answer")))
    result = evaluate.evaluate_dataset(
        asked, _replayed(log), GPT, STYLE, "test", ["row_id"], earlier=earlier, reruns=0)
    return result.summary


@query("evaluate_dataset_reruns", """
select concat(p.body, ' ', p.ask) as question, case when e % 5 = 3 then '1/2' else p.target end as target,
       case when (answer is null or answer = '') and e % 2 = 1 then 'no answer' when e % 5 = 3 then 'target can''t be read'
            when answer is null or answer = '' or ok then 'right' else 'wrong' end as outcome
from problems p join lines using (row_id) join scored s using (row_id)""", "scored")
def evaluate_dataset_reruns(spark, sf_dir):
    """A written problem file, read in its own order, with targets that are no numbers; failed questions are asked once more.
    Every question is in the result once."""
    path = new_path(spark, "evaluated")
    p = V.problems(spark, sf_dir)
    lost = F.regexp_extract("question", r"each\. (\d+) are", 1).cast("int")
    asked = p.select(text.assemble_question(F.col("body"), F.col("ask")).alias("question"), "answer_steps")
    steps = F.when(lost % 5 == 3, "By halves. #### 1/2").otherwise(F.col("answer_steps"))
    with released(spark):
        asked.select("question", steps.alias("answer")).write.option("compression", "gzip").json(path)
    log = V.response_log(spark, sf_dir)
    second = F.when(lost % 2 == 0, F.concat(F.lit(" "), "target"))

    def run(rows, attempt):
        told = log.select("question", (F.col("answer") if attempt == 0 else second).alias("response"), "start_ts", "end_ts")
        return generate.replay(rows, told, ["question"])

    questions = evaluate.load_questions(spark, "gsm8k", path)
    result = evaluate.evaluate_dataset(questions, run, GPT, STYLE, "test", ["src_file", "src_block", "src_seq"], reruns=1)
    judged = result.rows.where("ok is not null").select("question", "target", F.when(F.col("ok"), "right").otherwise("wrong").alias("outcome"))
    return judged.unionAll(result.failures.select("question", "target", "reason"))


@query("rescore_log_skipped", f"""
select 'test_adjusted_position-calc' as taskset, log_file, model as model_family, model, {SUMMARY_SQL}
from (select *, row_number() over (partition by log_file order by row_id) as place
      from (select *, cast(year(start_ts) as varchar) as log_file from scored))
where place > 500 and model = '{GPT}' and style = '{STYLE}' and answer is not null and answer <> ''
  and (year(start_ts) % 2 = 1 or error_type is null or error_type = 'calculation')
group by log_file, model""", "scored")
def rescore_log_skipped(spark, sf_dir):
    """The first 500 rows of each file are left out, whatever their model."""
    log = V.response_log(spark, sf_dir).withColumn("log_file", F.year("start_ts").cast("string"))
    annotated = log.where(F.year("start_ts") % 2 == 0)
    return evaluate.rescore_log(
        log, "test_adjusted_position-calc", GPT, STYLE, "log_file", ["row_id"], annotated, skip=500, count_blank=False)


@query("rescore_log", f"""
select 'test_adjusted_position-calc' as taskset, log_file, model as model_family, model, {SUMMARY_SQL}
from (select *, cast(year(start_ts) as varchar) as log_file from scored)
where model = '{GPT}' and style = '{STYLE}' and answer is not null and answer <> ''
  and (year(start_ts) % 2 = 1 or error_type is null or error_type = 'calculation')
group by log_file, model""", "scored")
def rescore_log(spark, sf_dir):
    """One log file per year; the even years have an annotated log."""
    log = V.response_log(spark, sf_dir).withColumn("log_file", F.year("start_ts").cast("string"))
    annotated = log.where(F.year("start_ts") % 2 == 0)
    return evaluate.rescore_log(
        log, "test_adjusted_position-calc", GPT, STYLE, "log_file", ["row_id"], annotated, count_blank=False)


@query("rescore_log_blanks", f"""
select 'test_adjusted_position-calc' as taskset, log_file, model as model_family, model, {SUMMARY_SQL}
from (select * replace (case when answer is null or answer = '' then false else ok end as ok), cast(year(start_ts) as varchar) as log_file
      from scored)
where model = '{GPT}' and style = '{STYLE}' and (year(start_ts) % 2 = 1 or error_type is null or error_type = 'calculation')
group by log_file, model""", "scored")
def rescore_log_blanks(spark, sf_dir):
    """Rows without an answer are wrong trials, as re-scoring has it by default."""
    log = V.response_log(spark, sf_dir).withColumn("log_file", F.year("start_ts").cast("string"))
    annotated = log.where(F.year("start_ts") % 2 == 0)
    return evaluate.rescore_log(log, "test_adjusted_position-calc", GPT, STYLE, "log_file", ["row_id"], annotated)


@query("generate_stage_messages", """
select row_id, concat('A: ', trim(replace(substr(full_prompt, strpos(full_prompt, 'A:') + 2), 'A:', ''))) as prompt,
       concat('2 messages, ', length(concat('A: ', trim(replace(substr(full_prompt, strpos(full_prompt, 'A:') + 2), 'A:', '')))),
              ' characters') as response
from response_log""", "response_log")
def generate_stage_messages(spark, sf_dir):
    """Ready message lists as input: each is sent as it is, and known by its last content."""
    log = V.response_log(spark, sf_dir)
    asked = log.select("row_id", messages.build_messages(F.col("full_prompt")).alias("messages"))

    def answer(frame):
        sizes, last = frame["messages"].str.len().astype(str), frame["prompt"].str.len().astype(str)
        return sizes + " messages, " + last + " characters"

    return generate.generate_from_messages(asked, answer).select("row_id", "prompt", "response")


@query("generate_stage", f"""
select question, style, case when answer is not null then concat(full_prompt, ' ', answer, ' Therefore, the answer (arabic numerals) is') end as final_prompt, answer as response
from response_log""", "response_log")
def generate_stage(spark, sf_dir):
    """Recorded responses in place of calls, by prompt."""
    log = V.response_log(spark, sf_dir)
    asked = log.select("question", "style", "full_prompt")
    recorded = log.select("full_prompt", F.col("answer").alias("response"))
    replayed = generate.replay(asked, recorded, ["full_prompt"])
    return replayed.select(
        "question", "style",
        text.answer_extraction_prompt(F.col("full_prompt"), F.col("response")).alias("final_prompt"), "response")


@query("generate_stage_function", """
select row_id, style, final_prompt, cast(length(final_prompt) as varchar) as response
from (select row_id, style, concat(p, ' ', cast(length(p) as varchar), ' Therefore, the answer (arabic numerals) is') as final_prompt
from (select row_id, style, concat('Q: ', question, chr(10), chr(10), 'A: Let', chr(39), 's think step by step',
             case style when 'sbs' then '.' else ', being careful to notice and fix any mistakes.' end) as p from response_log))
""", "response_log")
def generate_stage_function(spark, sf_dir):
    """Two stages with a batch function that answers with the length of its prompt."""
    log = V.response_log(spark, sf_dir).select("row_id", "question", "style")
    made = generate.generate(log, lambda frame: frame["prompt"].str.len().astype(str))
    return made.select("row_id", "style", "final_prompt", "response")


_PROMPTS = """(select row_id, style, concat('Q: ', question, chr(10), chr(10), 'A: Let', chr(39), 's think step by step',
    case style when 'sbs' then '.' else ', being careful to notice and fix any mistakes.' end) as p from response_log)"""


@query("generate_stage_ledger", f"""
with stages as (select row_id, style, p, concat(p, ' ', cast(length(p) as varchar), ' Therefore, the answer (arabic numerals) is') as final_prompt
                from {_PROMPTS})
select row_id, style, final_prompt, cast(length(final_prompt) as varchar) as response,
       (select count(distinct p) + count(distinct final_prompt) from stages) as entries
from stages""", "response_log")
def generate_stage_ledger(spark, sf_dir):
    """The same stages with a ledger, twice: the second run finds all answers and calls nothing."""
    log = V.response_log(spark, sf_dir).select("row_id", "question", "style")
    answered = ledger.Ledger(new_path(spark, "ledger"), 64)

    def refused(frame):
        raise RuntimeError("called again")

    generate.generate(log, lambda frame: frame["prompt"].str.len().astype(str), ledger=answered)
    made = generate.generate(log, refused, ledger=answered)
    entries = answered.read(spark).agg(F.count("*").alias("entries"))  # one row
    return made.select("row_id", "style", "final_prompt", "response").crossJoin(F.broadcast(entries))


@query("rerun_failed", """
select r.row_id, r.question,
       case when answer is not null and answer <> '' then answer when e % 2 = 0 then concat(' ', target) end as response,
       cast(case when answer is not null and answer <> '' then 0 else 1 end as int) as attempt
from response_log r join lines using (row_id)""", "response_log")
def rerun_failed(spark, sf_dir):
    """The second attempt answers those of the failed questions whose count of lost pens is even."""
    log = V.response_log(spark, sf_dir).select("row_id", "question", "answer", "target")
    lost = F.regexp_extract("question", r"each\. (\d+) are", 1).cast("int")
    second = F.when(lost % 2 == 0, F.concat(F.lit(" "), "target"))

    def run(rows, attempt):
        told = log.select("row_id", (F.col("answer") if attempt == 0 else second).alias("response"))
        return generate.replay(rows, told, ["row_id"])

    return generate.rerun_failed(log.select("row_id", "question"), run, "row_id", 1)


@query("generate_stage_errors", """
select row_id, case when ln % 3 > 0 then question end as response,
       case when ln % 3 = 0 then concat('ValueError: line ', row_id) end as error
from response_log join lines using (row_id)""", "response_log")
def generate_stage_errors(spark, sf_dir):
    """A batch function that fails for every third line: only those rows have no answer, and each has its own message."""
    lines = V.lines(spark, sf_dir).select("row_id", "ln")
    asked = V.response_log(spark, sf_dir).select("row_id", F.col("question").alias("prompt")).join(lines, "row_id")

    def answer(frame):
        bad = frame["ln"].to_numpy() % 3 == 0
        if bad.any():
            raise ValueError(f"line {frame['row_id'].iat[int(bad.argmax())]}")
        return frame["prompt"]

    return generate.call_in_batches(asked, answer, errors="error").select("row_id", "response", "error")


@query("pluggable_scorer", r"""
select row_id, ok as by_number, trim(coalesce(answer, '')) = target as by_text,
       contains(coalesce(answer, ''), target) as by_function from scored""", "scored")
def pluggable_scorer(spark, sf_dir):
    log = V.response_log(spark, sf_dir)
    answer, target = F.coalesce("answer", F.lit("")), F.col("target")
    own = scoring.python_scorer(lambda response, wanted: wanted in response)
    return log.select(
        "row_id",
        scoring.scorer_named("number_scorer")(F.col("answer"), target).alias("by_number"),
        scoring.scorer_named("exact_scorer")(answer, target).alias("by_text"),
        own(answer, target).alias("by_function"))


@query("pluggable_skip", """
select row_id, contains(body, ' 7 rows') as by_column, length(body) > 60 as by_function from problems
where not contains(body, ' 0 are lost')""", "problems")
def pluggable_skip(spark, sf_dir):
    p = V.problems(spark, sf_dir)
    skip = lambda q: F.contains(q, F.lit(" 0 are lost"))
    long = scoring.python_skip(lambda q: len(q) > 60)
    return p.where(~skip(F.col("body"))).select(
        "row_id", F.contains("body", F.lit(" 7 rows")).alias("by_column"), long(F.col("body")).alias("by_function"))


@query("incremental_scoring", """
select model, style, count(ok) as trials, sum(cast(ok as int))::bigint as right_ones,
       min(start_ts) as start_time, max(end_ts) as end_time
from scored where answer is not null and answer <> '' group by model, style""", "scored")
def incremental_scoring_query(spark, sf_dir):
    """Half of the log files are there at first, the other half come later; the same job runs twice."""
    log = V.response_log(spark, sf_dir)
    source, out, state = (new_path(spark, n) for n in ("stream-log", "stream-summary", "stream-state"))
    for style in ("sbs", "sbs recovery"):
        log.where(F.col("style") == style).write.mode("append").parquet(source)
        incremental_scoring(
            spark, source, log.schema, out, state, ["model", "style"], files_per_batch=100).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("model", "style").agg(
        F.sum("trials").alias("trials"),
        F.sum(F.round(F.col("score") * F.col("trials")).cast("long")).alias("right_ones"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


@query("incremental_scoring_csv", """
select model, style, count(ok) as trials, sum(cast(ok as int))::bigint as right_ones,
       min(start_ts) as start_time, max(end_ts) as end_time
from scored where answer is not null and answer <> '' group by model, style""", "scored")
def incremental_scoring_csv(spark, sf_dir):
    """The same over the CSV form of the log, which the writers make."""
    log = V.response_log(spark, sf_dir).withColumn("logprob", F.lit(None).cast("double"))
    source, out, state = (new_path(spark, n) for n in ("stream-csv", "stream-csv-summary", "stream-csv-state"))
    for style in ("sbs", "sbs recovery"):
        logs.write_log(log.where(F.col("style") == style), source, compression="gzip")
        incremental_scoring(spark, source, None, out, state, ["model", "style"], files_per_batch=100).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("model", "style").agg(
        F.sum("trials").alias("trials"),
        F.sum(F.round(F.col("score") * F.col("trials")).cast("long")).alias("right_ones"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def _followed(spark, sf_dir, name, follow, parts=4):
    """The log lands in steps, by ranges of the order, and is followed after each one; gives the folder of what it made."""
    log = V.response_log(spark, sf_dir)
    source, out, state = (new_path(spark, f"{name}-{n}") for n in ("log", "made", "state"))
    place = F.substring("row_id", 1, 15).cast("long")
    cuts = log.select(F.percentile_approx(place, [i / parts for i in range(1, parts)]).alias("c")).first().c
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = log if low is None else log.where(place > low)
        (part if high is None else part.where(place <= high)).write.mode("append").parquet(source)
        follow(spark, source, log.schema, out, state).awaitTermination()
    return out


@query("streamed_chunks", f"""
select model, cast(floor(row_no / 100) as bigint) as chunk, {SUMMARY_SQL}
from (select *, row_number() over (partition by model order by row_id) - 1 as row_no from scored)
where answer is not null and answer <> '' group by 1, 2""", "scored")
def streamed_chunks(spark, sf_dir):
    """Chunks of 100 questions of each model, which go on from one step of the log to the next."""
    def follow(*a):
        return chunks.follow_chunks(*a, run=["model"], order=["row_id"])

    made = _followed(spark, sf_dir, "chunks", follow)
    return chunks.chunks_so_far(spark, made, ["model"], dict(V.response_log(spark, sf_dir).dtypes)["start_ts"])


@query("streamed_answers", """
with twice as (select model, question, answer, ok, row_id || '-0' as place from scored
               union all select model, question, case when row_id[15] in ('0', '2', '4') then null else answer end,
                                case when row_id[15] in ('0', '2', '4') then null else ok end, row_id || '-1' from scored where row_id[15] <> '6'),
last as (select model, question, arg_max(coalesce(answer, ''), place) as answer,
                arg_max(case when answer is null or answer = '' then 'waiting' when ok then 'right' else 'wrong' end, place) as verdict
         from twice group by model, question)
select model, verdict, count(*) as questions, sum(length(answer))::bigint as answer_chars from last group by model, verdict""", "scored")
def streamed_answers(spark, sf_dir):
    """The last answer of each question after a second run over most of them, in which some are left without one."""
    log = V.response_log(spark, sf_dir)
    source, out, state = (new_path(spark, f"answers-{n}") for n in ("log", "made", "state"))
    digit = F.substring("row_id", 15, 1)
    again = log.where(digit != "6").withColumn("answer", F.when(~digit.isin("0", "2", "4"), F.col("answer")))
    for i, run in enumerate((log, again)):
        with released(spark):
            run.withColumn("place", F.concat("row_id", F.lit(f"-{i}"))).write.mode("append").option("compression", "zstd").parquet(source)
        schema = spark.read.parquet(source).schema
        chunks.follow_answers(spark, source, schema, out, state, run=["model"], order=["place"]).awaitTermination()
    verdict = F.when(text.is_blank(F.col("answer")), "waiting").when(F.col("ok"), "right").otherwise("wrong")
    return chunks.answers_so_far(spark, out, ["model"]).groupBy("model", verdict.alias("verdict")).agg(
        F.count("*").alias("questions"), F.sum(F.length(F.coalesce("answer", F.lit("")))).alias("answer_chars"))
