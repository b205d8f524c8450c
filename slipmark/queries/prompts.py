"""Prompt, scoring, model-name and message columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipmark.functions import fixed, identity, messages, specs, text
from slipmark.functions.lets import array_rows, strip
from slipmark.operators import aggregates, filters
from slipmark.queries import views as V
from slipmark.queries.registry import query

# The styles that every style operator is shown on.
STYLES = ["", "qa", "sbs", "sbs recovery", "zeroshot", "direct", "fewshot", "sbs system: Be brief."]
STYLE_ROWS = "(values " + ", ".join(f"('{s}')" for s in STYLES) + ") as st(style)"
MODELS = [*fixed.CHAT_MODELS, *fixed.TOGETHER_MODELS, *fixed.ANTHROPIC_MODELS, "text-davinci-002",
          "ft:gpt-3.5-turbo-0613:team::1", "org/some-base-7b"]
MODEL_ROWS = "(values " + ", ".join(f"('{m}')" for m in MODELS) + ") as mo(model)"

STEP = "concat(' Let', chr(39), 's think step by step.')"
CAREFUL = "concat(' Let', chr(39), 's think step by step, being careful to notice and fix any mistakes.')"
SUFFIX = "' Therefore, the answer (arabic numerals) is'"
BLANKS_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160))"


def with_each(df, name, values):
    """Every row with every value of a short fixed list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def prompt_sql(q: str, style: str) -> str:
    return f"""concat(
  case when contains({style}, 'qa') or contains({style}, 'sbs')
       then replace(concat(case when contains({q}, 'Q:') or contains({q}, 'Question:') then '' else 'Q: ' end, {q},
                           case when contains({q}, concat(chr(10), 'A:')) or contains({q}, concat(chr(10), 'Answer:'))
                                then '' else concat(chr(10), chr(10), 'A:') end), 'Q: Q:', 'Q:')
       else {q} end,
  case when not contains({style}, 'sbs') or contains({q}, {STEP}) or contains({q}, {CAREFUL}) then ''
       when contains({style}, 'recovery') then {CAREFUL} else {STEP} end,
  case when contains({style}, 'zeroshot') then ' The answer (arabic numerals) is' else '' end)"""


@query("assemble_question", "select row_id, concat(body, ' ', ask) as question from problems", "problems")
def assemble_question(spark, sf_dir):
    return V.problems(spark, sf_dir).select(
        "row_id", text.assemble_question(F.col("body"), F.col("ask")).alias("question"))


@query("extract_target", """
select row_id, replace(trim(split_part(answer_steps, '####', -1)), ',', '') as target,
       trim(split_part(answer_steps, '####', -1)) as rescore_target from problems""", "problems")
def extract_target(spark, sf_dir):
    a = F.col("answer_steps")
    return V.problems(spark, sf_dir).select(
        "row_id", text.extract_target(a).alias("target"), text.extract_target(a, keep_commas=True).alias("rescore_target"))


@query("numeric_answer_filter", r"""
select row_id, split_part(trim(answer), ' ', 1) as target from (
  select row_id, answer_unit as answer from problems
  union all select concat('doc', cast(doc_id as varchar)), text from documents)
where regexp_matches(split_part(regexp_replace(trim(answer, concat(' ', chr(10), chr(9), chr(13))), '\s+', ' ', 'g'), ' ', 1), '^\p{N}+$')""",
       "problems")
def numeric_answer_filter(spark, sf_dir):
    answers = V.problems(spark, sf_dir).select("row_id", F.col("answer_unit").alias("answer")).unionAll(
        V.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "text"))
    return filters.numeric_answers(answers, "answer", "target").select("row_id", "target")


@query("format_prompt", f"""
select row_id, style, {prompt_sql("question", "style")} as prompt,
       {prompt_sql("full_prompt", "style")} as reprompt
from (select row_id, question, full_prompt from response_log), {STYLE_ROWS}""", "response_log")
def format_prompt(spark, sf_dir):
    df = with_each(V.response_log(spark, sf_dir).select("row_id", "question", "full_prompt"), "style", STYLES)
    return df.select(
        "row_id", "style",
        text.format_prompt(F.col("question"), F.col("style")).alias("prompt"),
        text.format_prompt(F.col("full_prompt"), F.col("style")).alias("reprompt"))


@query("split_system_prompt", f"""
select row_id, concat(style, ' for ', body) as style, trim(split_part(concat(style, ' for ', body), 'system:', 1)) as base_style,
       trim(split_part(concat(style, ' for ', body), 'system:', 2)) as system_prompt
from problems, {STYLE_ROWS}""", "problems")
def split_system_prompt(spark, sf_dir):
    df = with_each(V.problems(spark, sf_dir).select("row_id", "body"), "s", STYLES)
    style = F.concat("s", F.lit(" for "), "body")
    return df.select("row_id", style.alias("style"), strip(text.base_style(style)).alias("base_style"),
                     text.system_prompt(style).alias("system_prompt"))


@query("answer_extraction_prompt", f"""
select row_id, concat(full_prompt, ' ', answer) as full_query,
       case when answer is not null then concat(full_prompt, ' ', answer, {SUFFIX}) end as final_prompt
from (select row_id, full_prompt, answer from response_log where answer is not null)
union all select row_id, null, null from response_log where answer is null""", "response_log")
def answer_extraction_prompt(spark, sf_dir):
    p, a = F.col("full_prompt"), F.col("answer")
    return V.response_log(spark, sf_dir).select(
        "row_id", text.full_query(p, a).alias("full_query"), text.answer_extraction_prompt(p, a).alias("final_prompt"))


@query("style_stages", f"""
select row_id, style, cast(case when style = '' or style like '%fewshot%' or style like '%direct%' then 1 else 2 end as int)
       as n_stages from problems, {STYLE_ROWS}""", "problems")
def style_stages(spark, sf_dir):
    df = with_each(V.problems(spark, sf_dir).select("row_id"), "style", STYLES)
    return df.select("row_id", "style", text.stage_count(F.col("style")).alias("n_stages"))


_ASKED = """
asked as (select row_id as id, full_prompt as q, case when style = 'sbs' then '' else 'Be brief.' end as sys,
                 case when model like 'gpt%' then 'Repeat the answer.' else '' end as post from response_log
          union all select concat('conv', cast(conv_id as varchar), '-', cast(turn as varchar)), text, '', '' from conversations),
parts as (select id, 0 as slot, 'system' as role, sys as content from asked where sys <> ''
          union all select id, 1, 'user', case when contains(q, 'A:') then
              trim(left(q, strpos(q, 'A:') - 1), concat(' ', chr(10))) else q end from asked
          union all select id, 2, 'assistant', concat('A: ', trim(replace(substr(q, strpos(q, 'A:') + 2), 'A:', ''), concat(' ', chr(10))))
              from asked where contains(q, 'A:')
          union all select id, 3, 'user', post from asked where post <> '')"""


@query("build_messages", "with " + _ASKED.strip() + """
select id, cast(row_number() over (partition by id order by slot) - 1 as int) as pos, role, content from parts""",
       "response_log")
def build_messages(spark, sf_dir):
    log = V.response_log(spark, sf_dir).select(
        F.col("row_id").alias("id"), F.col("full_prompt").alias("q"),
        F.when(F.col("style") == "sbs", "").otherwise("Be brief.").alias("sys"),
        F.when(F.startswith("model", F.lit("gpt")), "Repeat the answer.").otherwise("").alias("post"))
    turns = V.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("q"), F.lit("").alias("sys"), F.lit("").alias("post"))
    made = messages.build_messages(F.col("q"), F.col("sys"), F.col("post"))
    return array_rows(log.unionByName(turns), ["id"], made)


@query("render_messages", """
select conv_id, count(*) as n_messages,
       case when count(*) > 2 then max_by(text, turn) else string_agg(text, concat(chr(10), chr(10)) order by turn) end as shown
from conversations group by conv_id""")
def render_messages(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    return aggregates.render_conversations(turns, "conv_id", "turn", "text")


@query("base_model_name", rf"""
select row_id, model, coalesce(nullif(regexp_extract(model, 'gpt-[^\s:]+'), ''),
       split_part(split_part(model, '/', -1), '-', 1)) as base
from (select row_id, model from response_log
      union all select row_id, concat(model, ':', cast(q as varchar)) from lines, {MODEL_ROWS})""", "response_log")
def base_model_name(spark, sf_dir):
    tuned = with_each(V.lines(spark, sf_dir).select("row_id", "q"), "m", MODELS)
    tuned = tuned.select("row_id", F.concat("m", F.lit(":"), F.col("q").cast("string")).alias("model"))
    names = V.response_log(spark, sf_dir).select("row_id", "model").unionAll(tuned)
    return names.select("row_id", "model", identity.base_model_name(F.col("model")).alias("base"))


@query("provider_lookup", f"""
select row_id, model,
  case when model in ({", ".join(repr(m) for m in fixed.TOGETHER_MODELS)}) then 'together'
       when model in ({", ".join(repr(m) for m in fixed.ANTHROPIC_MODELS)}) then 'anthropic' else 'openai' end as provider,
  cast(case when model like '%gpt-4%' then 10000 when base in ({", ".join(repr(m) for m in fixed.CHAT_MODELS)}) then 10000
       else 3000 end as bigint) as requests_per_minute,
  cast(case when model like '%gpt-4%' then 300000 when base in ({", ".join(repr(m) for m in fixed.CHAT_MODELS)}) then 2000000
       else 250000 end as bigint) as tokens_per_minute,
  model like '%gpt-4%' or base in ({", ".join(repr(m) for m in fixed.CHAT_MODELS)}) as is_chat
from (select row_id, model, coalesce(nullif(regexp_extract(model, 'gpt-[^ :]+'), ''),
             split_part(split_part(model, '/', -1), '-', 1)) as base
      from (select row_id, model from response_log union all select row_id, model from lines, {MODEL_ROWS}))""",
       "response_log")
def provider_lookup(spark, sf_dir):
    names = V.response_log(spark, sf_dir).select("row_id", "model").unionAll(
        with_each(V.lines(spark, sf_dir).select("row_id"), "model", MODELS))
    return identity.with_provider(names).drop("family")


@query("blank_handling", """
select row_id, answer is null or answer = '' as is_blank, coalesce(answer, '') as filled from response_log""",
       "response_log")
def blank_handling(spark, sf_dir):
    a = F.col("answer")
    return V.response_log(spark, sf_dir).select(
        "row_id", text.is_blank(a).alias("is_blank"), F.coalesce(a, F.lit("")).alias("filled"))


@query("log_row_filter", """
select row_id, model, style, error_type from response_log
where model = 'gpt-4-0314' and style = 'sbs' and (error_type is null or error_type = 'copying')""", "response_log")
def log_row_filter(spark, sf_dir):
    taskset = "test_adjusted_position-copy_perturbation-random"
    log = V.response_log(spark, sf_dir)
    return log.where(filters.log_row_filter(taskset, "gpt-4-0314", "sbs")).select(
        "row_id", "model", "style", "error_type")


@query("log_row_filter_strict", """
select row_id, model, style, error_type from response_log
where model = 'gpt-4-0314' and style = 'sbs' and error_type = 'calculation'""", "response_log")
def log_row_filter_strict(spark, sf_dir):
    taskset = "test_adjusted_position-propcalc_perturbation-random"
    log = V.response_log(spark, sf_dir)
    return log.where(filters.log_row_filter(taskset, "gpt-4-0314", "sbs", strict=True)).select(
        "row_id", "model", "style", "error_type")


@query("correct_only", """
select row_id, target, answer from scored where ok and model = 'gpt-4-0314' and style = 'sbs'""", "scored")
def correct_only(spark, sf_dir):
    log = V.response_log(spark, sf_dir)
    return filters.correct_only(log, "gpt-4-0314", "sbs").select("row_id", "target", "answer")


@query("style_label", """
select row_id, temp, case when temp <> 0 then concat(style, ' temp=', cast(temp as varchar)) else style end as label
from (select l.row_id, r.style, l.e / 4.0 as temp from lines l join response_log r using (row_id))""", "response_log")
def style_label(spark, sf_dir):
    df = V.lines(spark, sf_dir).select(
        "row_id", F.when(F.col("ls") == "F", "sbs").otherwise("sbs recovery").alias("style"),
        (F.col("e") / 4.0).alias("temp"))
    return df.select("row_id", "temp", text.style_label(F.col("style"), F.col("temp")).alias("label"))


@query("question_key", f"""
select id, question, reasoning from (
  select row_id as id,
         split_part(trim(split_part(full_prompt, concat('A: Let', chr(39), 's think'), 1), concat(' ', chr(10))), 'Q: ', 2) as question,
         case when contains(full_prompt, {STEP}) then split_part(full_prompt, {STEP}, 2) else full_prompt end as reasoning
  from response_log
  union all
  select concat('doc', cast(doc_id as varchar)),
         case when contains(split_part(text, concat('A: Let', chr(39), 's think'), 1), 'Q: ') then split_part(text, 'Q: ', 2) end,
         case when contains(text, {STEP}) then split_part(text, {STEP}, 2) else text end from documents)""",
       "response_log")
def question_key(spark, sf_dir):
    asked = V.response_log(spark, sf_dir).select(F.col("row_id").alias("id"), F.col("full_prompt").alias("t")).unionAll(
        V.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "text"))
    return asked.select("id", text.question_key(F.col("t")).alias("question"),
                        text.prompt_reasoning(F.col("t"), F.col("t")).alias("reasoning"))


@query("qa_wrap", """
select row_id, case when p = '' then p else concat('Q: ', p, chr(10), 'A:') end as wrapped
from (select row_id, coalesce(answer, '') as p from response_log
      union all select row_id, concat(body, ' ', ask) from problems)""", "response_log")
def qa_wrap(spark, sf_dir):
    p = V.response_log(spark, sf_dir).select("row_id", F.coalesce("answer", F.lit("")).alias("p")).unionAll(
        V.problems(spark, sf_dir).select("row_id", text.assemble_question(F.col("body"), F.col("ask"))))
    return p.select("row_id", text.qa_wrap(F.col("p")).alias("wrapped"))


@query("logprob_prompt", """
select row_id, case when style like '%sbs%' then concat(full_prompt, ' ', target)
                    else concat(full_prompt, ' ', answer, chr(10), 'The answer is:', ' ', target) end as prompt
from (select row_id, full_prompt, answer, target, s as style
      from response_log, (values ('sbs'), ('qa'), ('zeroshot')) as st(s)
      where model not like 'claude%' and model not like 'gpt%' and answer is not null and answer <> '')""",
       "response_log")
def logprob_prompt(spark, sf_dir):
    from slipmark.plans.generate import supports_logprobs

    log = with_each(V.response_log(spark, sf_dir).drop("style"), "style", ["sbs", "qa", "zeroshot"])
    log = log.where(supports_logprobs(F.col("model")) & ~text.is_blank(F.col("answer")))
    query_text = text.full_query(F.col("full_prompt"), F.col("answer"))
    return log.select("row_id", text.logprob_prompt(
        F.col("full_prompt"), query_text, F.col("style"), F.col("target")).alias("prompt"))


@query("number_scorer", "select row_id, ok from scored", "scored")
def number_scorer(spark, sf_dir):
    log = V.response_log(spark, sf_dir)
    return log.select("row_id", text.number_scorer(F.col("answer"), F.col("target")).alias("ok"))


@query("number_scorer_texts", r"""
select row_id, case when try_cast(target as double) is null then null
                    else coalesce(try_cast(num as double) = try_cast(target as double), false) end as ok
from (select row_id, target, regexp_extract(replace(split_part(concat(full_prompt, coalesce(answer, '')),
             ' Therefore, the answer (arabic numerals) is', -1), ',', ''), '-?[0-9]+[.]?[0-9]*') as num
      from response_log)""", "response_log")
def number_scorer_texts(spark, sf_dir):
    """The scorer over whole prompts (with the extraction sentence before the answer)."""
    log = V.response_log(spark, sf_dir)
    said = F.concat("full_prompt", F.coalesce("answer", F.lit("")))
    return log.select("row_id", text.number_scorer(said, F.col("target")).alias("ok"))


@query("parse_spec", """
select row_id, cast(part_no as int) as part_no, part, contains(part, 'random') as random,
       try_cast(nullif(regexp_extract(part, 'add([0-9]+)', 1), '') as bigint) as add_amount,
       try_cast(nullif(regexp_extract(part, '([0-9]+)$', 1), '') as bigint) as trailing_number
from (select row_id, unnest(string_split(spec, '_')) as part, generate_subscripts(string_split(spec, '_'), 1) - 1 as part_no
      from (select row_id, concat('random_add', cast(q as varchar), '_typo', cast(k as varchar), '_add', cast(e as varchar)) as spec
            from lines))""", "lines")
def parse_spec(spark, sf_dir):
    spec = F.concat(F.lit("random_add"), F.col("q").cast("string"), F.lit("_typo"), F.col("k").cast("string"),
                    F.lit("_add"), F.col("e").cast("string"))
    return array_rows(V.lines(spark, sf_dir), ["row_id"], specs.spec_parts(spec)).drop("pos")


@query("reasoning_boundary", f"""
select id, cast(case when strpos(text, {STEP}) > 0 then strpos(text, {STEP}) - 1 + length({STEP}) else 0 end as int) as b
from texts""", "texts")
def reasoning_boundary(spark, sf_dir):
    return V.texts(spark, sf_dir).select("id", text.reasoning_boundary(F.col("text")).alias("b"))


@query("normalize_question", f"""
select id, trim(replace(t, chr(13), ''), {BLANKS_SQL}) as question
from (select row_id as id, concat(chr(160), ' ', body, chr(13), chr(10), ' ', ask, chr(13), chr(10)) as t from problems
      union all select concat('doc', cast(doc_id as varchar)), text from documents)""", "problems")
def normalize_question(spark, sf_dir):
    raw = V.problems(spark, sf_dir).select(
        F.col("row_id").alias("id"),
        F.concat(F.lit("  "), "body", F.lit("\r\n "), "ask", F.lit("\r\n")).alias("t"))
    docs = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "text")
    return raw.unionAll(docs).select("id", text.normalize_question(F.col("t")).alias("question"))


@query("run_identity", """
select row_id, name, datafile, position, perturbation, letter_perturbation, model_file,
       case position when 'calc' then 'calculation' when 'propcalc' then 'calculation' else 'copying' end as error_type
from (select *, concat(datafile, '_adjusted_position-', position, '_perturbation-', perturbation,
             case when letter_perturbation is null then '' else concat('_letter_perturbation-', letter_perturbation) end,
             '_', model_file, '.json') as name
      from (select r.row_id, replace(replace(r.model, '.', '-'), '/', '-') as model_file,
                   case when r.style = 'sbs' then 'test' else 'MultiArith' end as datafile,
                   case l.e % 4 when 0 then 'any' when 1 then 'copy' when 2 then 'calc' else 'propcalc' end as position,
                   concat('add', cast(l.q as varchar)) as perturbation,
                   case when l.k % 2 = 0 then concat('typo', cast(l.k as varchar)) end as letter_perturbation
            from response_log r join lines l using (row_id)))""", "response_log")
def run_identity(spark, sf_dir):
    log = V.lines(spark, sf_dir)
    e = F.col("e") % 4
    model = F.when(F.col("rf") == "A", "gpt-4-0314").when(F.col("rf") == "N", "claude-3-opus-20240229").otherwise(
        "meta-llama/Llama-3-70b-chat-hf")
    name = identity.run_name(
        F.when(F.col("ls") == "F", "test").otherwise("MultiArith"),
        F.when(e == 0, "any").when(e == 1, "copy").when(e == 2, "calc").otherwise("propcalc"),
        F.concat(F.lit("add"), F.col("q").cast("string")),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("typo"), F.col("k").cast("string"))),
        model)
    named = log.select("row_id", name.alias("name"))
    parts = identity.parse_run_name(F.col("name"))
    return named.select("row_id", "name", *[c.alias(n) for n, c in parts.items()],
                        identity.error_type_of(parts["position"]).alias("error_type"))


@query("empty_reasoning_passthrough", """
select row_id, case when coalesce(answer, '') = '' then '' else 'worked' end as kind from response_log""",
       "response_log")
def empty_reasoning_passthrough(spark, sf_dir):
    """Blank answers go through unchanged and count as done, also where no number could be changed."""
    from slipmark.functions.numbers import number_intervention

    reasoning = F.coalesce("answer", F.lit(""))
    made = V.response_log(spark, sf_dir).select(
        "row_id", number_intervention(F.col("row_id"), reasoning, "any", "add1").alias("made"))
    shown = made.select("row_id", F.inline_outer("made"))
    return shown.select("row_id", F.when(F.col("text") == "", "").otherwise("worked").alias("kind"))
