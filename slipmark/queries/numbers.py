"""Number operators over response texts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipmark.functions import numbers as N
from slipmark.functions import specs, text
from slipmark.functions.lets import array_rows
from slipmark.queries import views as V
from slipmark.queries.registry import query

# Tokens of a text as rows. ``pieces`` tile the text up to its last number, so places are running sums of their lengths, and
# the characters beside a number are in its own piece, in the next one or in the tail: no join back to the text.
NUM = r"[0-9]+(?:,[0-9]{3})*(?:[.][0-9]*)?"
BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def tokens_sql(source: str, name: str, text_column: str = "text", keep: str = "") -> str:
    """``keep``: further columns of the source, each with a comma behind."""
    return rf"""
{name} as materialized (
  select id, {keep} idx, num, cast(fin - length(num) as int) as start, cast(fin as int) as fin,
         try_cast(replace(num, ',', '') as double) as value,
         substr(piece, length(piece) - length(num), least(1, length(piece) - length(num))) as char_before,
         coalesce(lead(left(piece, 1)) over (partition by id order by idx), char_behind) as char_after
  from (select id, {keep} idx, num, piece, char_behind, sum(length(piece)) over (partition by id order by idx) as fin
        from (select id, {keep} unnest(pieces) as piece, unnest(nums) as num, generate_subscripts(nums, 1) - 1 as idx, char_behind
              from (select id, {keep} regexp_extract_all({text_column}, '(?s)[^0-9]*{NUM}') as pieces,
                           regexp_extract_all({text_column}, '(?s)[^0-9]*({NUM})', 1) as nums,
                           left(regexp_extract({text_column}, '[^0-9]*$'), 1) as char_behind from {source}))))"""


# Step marks without a loop: of the marks N that stand alone between blanks, the run 1..k without a gap counts
# (there the N-th different mark is N); mark N is masked at its first place from the first place of mark N - 1 on
# (N = 1: from the boundary on).
MASK_SQL = rf"""
source as materialized (select id, text, case when strpos(text, concat(' Let', chr(39), 's think step by step.')) > 0
                            then strpos(text, concat(' Let', chr(39), 's think step by step.')) + 25 else 0 end as b
           from __SOURCE__),
{tokens_sql("source", "raw_tokens", keep="b,")},
marks as (
  select id, b, cast(replace(num, '.', '') as int) as n, min(start) as first, list(start order by start) as starts
  from raw_tokens
  where length(num) between 2 and 5 and regexp_matches(num, '^[1-9][0-9]{{0,3}}[.]$')
    and (start = 0 or regexp_matches(char_before, '{BLANK}')) and regexp_matches(char_after, '{BLANK}')
  group by id, b, num),
bounded as (
  select id, n, starts, row_number() over (partition by id order by n) as place,
         case when n = 1 then case when b > 0 then b + 1 else 0 end else lag(first) over (partition by id order by n) end as bound
  from marks),
masked_marks as materialized (
  select * from (select id, n, list_min(list_filter(starts, lambda s: s >= bound)) as start from bounded where place = n)
  where start is not null)"""

TOKENS_SQL = MASK_SQL + rf""",
toks as materialized (
  select t.id, row_number() over (partition by t.id order by t.start) - 1 as i, t.num, t.start, t.fin, t.value, t.b
  from raw_tokens t left join masked_marks m on m.id = t.id and m.start = t.start
  where m.id is null),
ranked as materialized (
  select *, row_number() over (partition by id, value order by i) as nth,
         lead(start) over (partition by id, value order by i) as start2,
         lead(fin) over (partition by id, value order by i) as fin2,
         lead(i) over (partition by id, value order by i) as i2,
         contains(num, ',') and regexp_matches(num, '[.][0-9]') as odd
  from toks),
cands as (
  select 'any' as position, row_number() over (partition by id order by i) - 1 as j, * from ranked
  where start >= b and not odd
  union all
  select 'calc', row_number() over (partition by id order by value, i) - 1, * from ranked
  where nth = 1 and start >= b and not odd
  union all
  select 'copy', row_number() over (partition by id order by value, i) - 1, * from ranked
  where nth > 1 and start >= b and not odd
  union all
  select 'propcalc', row_number() over (partition by id order by value, i) - 1, * from ranked
  where nth = 1 and start >= b and start2 is not null and not odd)"""


def mask_sql(source: str) -> str:
    return "with " + MASK_SQL.replace("__SOURCE__", source).strip()


def candidates_sql(source: str) -> str:
    return "with " + TOKENS_SQL.replace("__SOURCE__", source).strip()


def draw_sql(key: str, purpose: str, i: str = "'0'") -> str:
    return f"cast(cast('0x' || substr(md5(concat_ws('|', '7', {key}, {purpose}, {i})), 1, 8) as ubigint) as bigint)"


def change_sql(key: str, name: str, lo: int = -3, hi: int = 3) -> str:
    """The change of a spec part: ``random`` or ``addN``."""
    if name == "random":
        d = f"({draw_sql(key, repr('change:random'))} % {hi - lo} + {lo})"
        return f"(case when {d} >= 0 then {d} + 1 else {d} end)"
    return name.removeprefix("add")


def perturbed_sql(num: str, change: str, pad: bool = True) -> str:
    """The changed number as text, from a column expression of the old text and one of the change."""
    digits = f"trim(replace({num}, ',', ''), '.')"
    whole = f"(cast({digits} as hugeint) + ({change}))"
    places = f"length(split_part({digits}, '.', 2))"
    scaled = f"(cast(replace({digits}, '.', '') as hugeint) + ({change}) * cast(rpad('1', cast({places} + 1 as int), '0') as hugeint))"
    shown = f"cast(abs({scaled}) as varchar)"
    wide = f"lpad({shown}, greatest(length({shown}), {places} + 1)::int, '0')"
    frac = f"rtrim(right({wide}, {places}), '0')"
    dec = (
        f"concat(case when {scaled} < 0 then '-' else '' end, left({wide}, length({wide}) - {places}), '.', "
        f"case when {frac} = '' then '0' else {frac} end)"
    )
    new = (
        f"case when contains({digits}, '.') then {dec} when regexp_matches({digits}, '^0+$') then null "
        f"when contains({num}, ',') then format('{{:,}}', {whole}) else cast({whole} as varchar) end"
    )
    if not pad:
        return new
    dotted = f"concat({new}, case when ends_with({num}, '.') then '.' else '' end)"
    width = f"case when starts_with({digits}, '0') and length({digits}) > 1 then length({num}) else 0 end"
    value = f"lpad({dotted}, greatest({width}, length({dotted}))::int, '0')"
    return f"case when ({new}) is null then null else {value} end"


def outputs_sql(position: str, parts: list[str], pad: bool = True) -> str:
    """Rows (id, part_no, perturbation, text) from the candidates of a position; follows ``candidates_sql``."""
    rows = " union all ".join(
        f"select id, {i} as part_no, '{p}' as perturbation, {perturbed_sql('num', change_sql('id', p), pad)} as new, "
        f"* exclude (id) from chosen"
        for i, p in enumerate(parts)
    )
    tail = ", substr(text, fin + 1, start2 - fin), new" if position == "propcalc" else ""
    return f"""
picked as (select id, {draw_sql("id", "'place'")} % count(*) as pick from cands where position = '{position}' group by id),
chosen as (select c.*, x.text from cands c join picked p on p.id = c.id and p.pick = c.j join source x on x.id = c.id
           where c.position = '{position}'),
changed as (select *, bool_or(new is null) over (partition by id) as failed from ({rows})),
outputs as (
  select id, part_no, perturbation,
         trim(concat(substr(text, b + 1, start - b), new{tail}), ' ' || chr(9) || chr(10) || chr(13)) as text
  from changed where not failed)"""


@query(
    "mask_step_numbers",
    mask_sql("texts")
    + r"""
select x.id, case when places is null then x.text else list_reduce(
    list_prepend(x.text, list_transform(places, lambda p: concat(p.start, ',', p.n))),
    lambda acc, m: concat(left(acc, greatest(cast(split_part(m, ',', 1) as int) - 1, 0)),
                          case when split_part(m, ',', 1) = '0' then '' else ' ' end,
                          repeat('@', length(split_part(m, ',', 2))), '. ',
                          substr(acc, cast(split_part(m, ',', 1) as int) + length(split_part(m, ',', 2)) + 3))) end as masked
from source x left join (
  select id, list({'start': start, 'n': n} order by start) as places from masked_marks group by id) m on m.id = x.id""",
    "texts",
)
def mask_step_numbers(spark, sf_dir):
    df = V.texts(spark, sf_dir)
    return df.select("id", N.mask_step_numbers(F.col("text"), text.reasoning_boundary(F.col("text"))).alias("masked"))


@query("tokenize_numbers", "with " + tokens_sql("texts", "t").strip() + """
select id, cast(idx as int) as idx, cast(start as int) as start, cast(fin as int) as "end", num as text, value from t""",
       "texts")
def tokenize_numbers(spark, sf_dir):
    return array_rows(V.texts(spark, sf_dir), ["id"], N.number_tokens(F.col("text"))).drop("pos")


@query("number_occurrences", "with " + tokens_sql("texts", "t").strip() + """
select id, value, count(*) as n, cast(min(start) as int) as first_start,
       string_agg(cast(start as varchar), ',' order by start) as starts
from t group by id, value""", "texts")
def number_occurrences(spark, sf_dir):
    rows = array_rows(V.texts(spark, sf_dir), ["id"], N.number_occurrences(F.col("text")))
    return rows.select("id", "value", F.col("n").cast("long").alias("n"), "first_start",
                       F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query("select_candidates", candidates_sql("texts") + """
select id, position, cast(j as int) as j, cast(i as int) as idx, num as number,
       case when position = 'propcalc' then cast(i2 as int) end as partner_idx from cands""", "texts")
def select_candidates(spark, sf_dir):
    df = V.texts(spark, sf_dir)
    found = df.select("id", F.inline_outer(N.candidates_by_position(F.col("text"))))
    return array_rows(found, ["id", "position"], F.col("c")).withColumnRenamed("pos", "j")


def _changes_sql(pad):
    return perturbed_sql("num", change_sql("concat(id, '-', cast(idx as varchar))", "random"), pad)


@query("perturb_value", "with " + tokens_sql("texts", "t").strip() + f"""
select id, cast(idx as int) as idx, num as number, {_changes_sql(True)} as random_padded,
       {_changes_sql(False)} as random_plain, {perturbed_sql("num", "101")} as add101
from t where not (contains(num, ',') and regexp_matches(num, '[.][0-9]'))""", "texts")
def perturb_value(spark, sf_dir):
    rows = array_rows(V.texts(spark, sf_dir), ["id"], N.number_tokens(F.col("text"))).where(~N._unformattable(F.col("text")))
    key = F.concat("id", F.lit("-"), F.col("idx").cast("string"))
    # used several times, so it stays a column of its own
    changed = rows.select("id", "idx", "text", N.part_change(key, specs.number_parts("random")[0], -3, 3).alias("change"))
    number, change = F.col("text"), F.col("change")
    return changed.select(
        "id", "idx", number.alias("number"),
        N.perturb_value(number, change).alias("random_padded"),
        N.perturb_value(number, change, handle_padding=False).alias("random_plain"),
        N.perturb_value(number, F.lit(101)).alias("add101"),
    )


def _intervention(position, spec, noise=None, handle_padding=True):
    def run(spark, sf_dir):
        df = V.texts(spark, sf_dir)
        made = N.number_intervention(
            F.col("id"), F.col("text"), position, spec, noise=noise, handle_padding=handle_padding
        )
        return array_rows(df, ["id"], made).drop("pos")

    return run


def _intervention_sql(position, parts, pad=True):
    return candidates_sql("texts") + "," + outputs_sql(position, parts, pad) + (
        "\nselect id, part_no, perturbation, text from outputs union all "
        + " union all ".join(f"select id, {i}, '{p}', '' from source where text = ''" for i, p in enumerate(parts))
    )


query("number_intervention", _intervention_sql("copy", ["random"]), "texts")(_intervention("copy", "random"))
query("number_intervention_any", _intervention_sql("any", ["random"], False), "texts")(
    _intervention("any", "random", handle_padding=False))
query("number_intervention_calc", _intervention_sql("calc", ["random", "add5"]), "texts")(
    _intervention("calc", "random_add5"))
query("number_intervention_propcalc", _intervention_sql("propcalc", ["add1", "add101"]), "texts")(
    _intervention("propcalc", "add1_add101"))
