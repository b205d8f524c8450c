"""Problem and response-log views over the given tables, as DataFrames and as SQL.

Both forms compute the same rows. The SQL form joins the views as they are described; the DataFrame form computes
all of them from ``lines`` in one pass, since every column of a problem or response follows from its line.
``row_id`` is a fixed-width text, so that it orders like (order, line, part, supplier) at any table size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "\n"

SQL_VIEWS = {
    "lines": """
select concat(lpad(cast(l_orderkey as varchar), 15, '0'), lpad(cast(l_linenumber as varchar), 2, '0'),
              lpad(cast(l_partkey as varchar), 12, '0'), lpad(cast(l_suppkey as varchar), 12, '0')) as row_id,
       l_orderkey o, l_linenumber ln, l_partkey p, l_suppkey s,
       cast(min(l_quantity) as int) q, cast(l_partkey % 90 + 10 as int) k, cast(l_suppkey % 9 as int) e,
       min(l_returnflag) rf, min(l_linestatus) ls, min(l_shipdate) ts
from lineitem group by l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "problems": """
select row_id,
       concat('Box ', cast(o as varchar), '-', cast(ln as varchar), '-', cast(p as varchar), '-', cast(s as varchar),
              ' has ', cast(q as varchar), ' rows of ', cast(k as varchar), ' pens at ', cast(k % 4 as varchar),
              '.50 each. ', cast(e as varchar), ' are lost.') as body,
       'How many are left?' as ask,
       concat('Count and subtract. #### ', format('{:,}', q*k-e)) as answer_steps,
       concat(cast(q*k-e as varchar), ' (pens)') as answer_unit,
       cast(q*k-e as varchar) as target
from lines""",
    "responses_text": """
select b.row_id,
       concat('Q: ', b.body, ' ', b.ask, chr(10), chr(10), 'A: Let', chr(39), 's think step by step',
              case l.ls when 'F' then '.' else ', being careful to notice and fix any mistakes.' end,
              ' 1. There are ', cast(l.q as varchar), ' rows of ', cast(l.k as varchar), ', so ',
              format('{:,}', l.q*l.k), ' pens. 2. After losing ', cast(l.e as varchar), ' of ',
              format('{:,}', l.q*l.k), ' we have ', format('{:,}', l.q*l.k-l.e), '. 3. So ',
              format('{:,}', l.q*l.k-l.e), ' are left.', ' Therefore, the answer (arabic numerals) is') as text
from problems b join lines l on b.row_id = l.row_id""",
    "response_log": """
select l.row_id, l.ts as start_ts, concat(b.body, ' ', b.ask) as question, b.target,
       case l.rf when 'A' then 'gpt-4-0314' when 'N' then 'claude-3-opus-20240229'
            else 'meta-llama/Llama-3-70b-chat-hf' end as model,
       case l.ls when 'F' then 'sbs' else 'sbs recovery' end as style,
       t.text as full_prompt,
       case when (l.o + l.ln) % 17 = 0 then null when (l.o + l.ln) % 19 = 0 then ''
            when (l.o + l.ln) % 5 = 0 then concat(' $', cast(l.q*l.k + l.e + 1 as varchar), '.')
            else concat(' $', format('{:,}', l.q*l.k-l.e), '.') end as answer,
       case l.o % 7 when 0 then 'copying' when 1 then 'calculation' else null end as error_type,
       l.ts as end_ts
from lines l join problems b on l.row_id = b.row_id join responses_text t on l.row_id = t.row_id""",
    # scored log: the scorer in SQL; null where the target is not a number
    "scored": r"""
select *, case when try_cast(target as double) is null then null
               when num is null or not regexp_matches(num, '^-?[0-9]+[.]?[0-9]*$')
                 or regexp_matches(num, '^-?0+[1-9][0-9]*$') then false
               else try_cast(num as double) = try_cast(target as double) end as ok
from (select *, regexp_extract(replace(
        case when contains(answer, ' Therefore, the answer (arabic numerals) is')
             then split_part(answer, ' Therefore, the answer (arabic numerals) is', -1)
             when contains(answer, 'The answer (arabic numerals) is')
             then split_part(answer, 'The answer (arabic numerals) is', -1)
             else answer end, ',', ''), '-?\p{Nd}+[.]?\p{Nd}*') as num
      from response_log)""",
    # texts for the text operators: the response texts and the given documents
    "texts": """
select row_id as id, text from responses_text
union all select concat('doc', cast(doc_id as varchar)), text from documents""",
    # token lists of the prompts with their targets
    "token_logprobs": r"""
select row_id, full_prompt as explanation, target, i, tok as token,
       -((7 * length(tok) + i) % 13) / 10.0 as logprob
from (select row_id, full_prompt, target, unnest(toks) as tok, generate_subscripts(toks, 1) - 1 as i
      from (select row_id, full_prompt, target,
                   regexp_extract_all(concat(full_prompt, ' ', target), '\s*[^\s]+') as toks from response_log))""",
}

NEEDS = {
    "lines": [],
    "problems": ["lines"],
    "responses_text": ["lines", "problems"],
    "response_log": ["lines", "problems", "responses_text"],
    "scored": ["lines", "problems", "responses_text", "response_log"],
    "texts": ["lines", "problems", "responses_text"],
    "token_logprobs": ["lines", "problems", "responses_text", "response_log"],
}


def with_views(sql: str, names: list[str]) -> str:
    """Put the named views (and what they need) before ``sql`` as common table expressions."""
    needed: list[str] = []
    for name in names:
        for each in [*NEEDS[name], name]:
            if each not in needed:
                needed.append(each)
    if not needed:
        return sql.strip()
    recursive = "recursive " if "with recursive" in sql else ""
    ctes = ",\n".join(f"{n} as ({SQL_VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.startswith("with recursive "):
        body = ", " + body[len("with recursive "):]
    elif body.startswith("with "):
        body = ", " + body[len("with "):]
    return f"with {recursive}{ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, ln, p, s = "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, F.lit("0"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(o, ln, p, s)
        .agg(
            F.min("l_quantity").cast("int").alias("q"),
            F.min("l_returnflag").alias("rf"),
            F.min("l_linestatus").alias("ls"),
            F.min("l_shipdate").alias("ts"),
        )
        .select(
            F.concat(pad(o, 15), pad(ln, 2), pad(p, 12), pad(s, 12)).alias("row_id"),
            F.col(o).alias("o"), F.col(ln).alias("ln"), F.col(p).alias("p"), F.col(s).alias("s"), "q",
            (F.col(p) % 90 + 10).cast("int").alias("k"), (F.col(s) % 9).cast("int").alias("e"), "rf", "ls", "ts",
        )
    )


def _text(*parts):
    return F.concat(*[F.lit(x) if x.__class__ is str and not x.startswith("@") else _col(x) for x in parts])


def _col(x):
    return F.col(x[1:]).cast("string") if isinstance(x, str) else x


def _body():
    return _text("Box ", "@o", "-", "@ln", "-", "@p", "-", "@s", " has ", "@q", " rows of ", "@k", " pens at ",
                 (F.col("k") % 4).cast("string"), ".50 each. ", "@e", " are lost.")


ASK = "How many are left?"
_total = lambda: F.col("q") * F.col("k")
_left = lambda: F.col("q") * F.col("k") - F.col("e")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        "row_id",
        _body().alias("body"),
        F.lit(ASK).alias("ask"),
        F.concat(F.lit("Count and subtract. #### "), F.format_number(_left(), 0)).alias("answer_steps"),
        F.concat(_left().cast("string"), F.lit(" (pens)")).alias("answer_unit"),
        _left().cast("string").alias("target"),
    )


def _response_text():
    end = F.when(F.col("ls") == "F", ".").otherwise(", being careful to notice and fix any mistakes.")
    total, left = F.format_number(_total(), 0), F.format_number(_left(), 0)
    return _text(
        "Q: ", _body(), " " + ASK + "\n\nA: Let's think step by step", end, " 1. There are ", "@q", " rows of ", "@k",
        ", so ", total, " pens. 2. After losing ", "@e", " of ", total, " we have ", left, ". 3. So ", left,
        " are left.", " Therefore, the answer (arabic numerals) is",
    )


def responses_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("row_id", _response_text().alias("text"))


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line_no = F.col("o") + F.col("ln")
    wrong = (_total() + F.col("e") + 1).cast("string")
    return lines(spark, sf_dir).select(
        "row_id",
        F.col("ts").alias("start_ts"),
        F.concat(_body(), F.lit(" " + ASK)).alias("question"),
        _left().cast("string").alias("target"),
        F.when(F.col("rf") == "A", "gpt-4-0314").when(F.col("rf") == "N", "claude-3-opus-20240229")
        .otherwise("meta-llama/Llama-3-70b-chat-hf").alias("model"),
        F.when(F.col("ls") == "F", "sbs").otherwise("sbs recovery").alias("style"),
        _response_text().alias("full_prompt"),
        F.when(line_no % 17 == 0, F.lit(None).cast("string"))
        .when(line_no % 19 == 0, "")
        .when(line_no % 5 == 0, F.concat(F.lit(" $"), wrong, F.lit(".")))
        .otherwise(F.concat(F.lit(" $"), F.format_number(_left(), 0), F.lit("."))).alias("answer"),
        F.when(F.col("o") % 7 == 0, "copying").when(F.col("o") % 7 == 1, "calculation").alias("error_type"),
        F.col("ts").alias("end_ts"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return responses_text(spark, sf_dir).select(F.col("row_id").alias("id"), "text").unionAll(
        docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "text")
    )


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _tokens(prompts: pa.Array, targets: pa.Array) -> pa.Array:
    """Records of prompt, target, tokens (``\\s*[^\\s]+`` of both) and their log-probabilities; without both the lists are null."""
    space = pa.scalar(" ", pa.large_string())
    texts = pc.binary_join_element_wise(prompts.cast(pa.large_string()), targets.cast(pa.large_string()), space)
    known = texts.is_valid()
    texts = pc.utf8_rtrim(texts.fill_null(""), " \t\n\x0b\x0c\r")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    ends = np.zeros(len(data) + 1, dtype=bool)  # a token ends before a blank and at the end of its text
    ends[1:-1] = _BLANK[data[1:]]
    ends[at[1:]] = True
    ends[1:] &= ~_BLANK[data]
    ends[0] = False
    ends = np.flatnonzero(ends)
    first = np.searchsorted(ends, at, "right")
    tokens = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    place = np.arange(len(ends)) - np.repeat(first[:-1], np.diff(first))
    scores = -((pc.utf8_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64) * 7 + place) % 13) / 10.0
    lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), v, mask=pc.invert(known)) for v in (tokens, pa.array(scores))]
    return pa.StructArray.from_arrays([prompts, targets, *lists], ["explanation", "target", "tokens", "logprobs"])


def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per response, with a ``record`` of prompt, target, and parallel lists of tokens and log-probabilities.

    A function of the record runs in the same Python step, so that the lists do not pass through the JVM."""
    made = F.arrow_udf(_tokens, "struct<explanation:string,target:string,tokens:array<string>,logprobs:array<double>>")
    return response_log(spark, sf_dir).select("row_id", made("full_prompt", "target").alias("record"))


def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of ``token_records``."""
    return token_records(spark, sf_dir).select("row_id", "record.*")
