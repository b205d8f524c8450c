"""Letter noise over documents and response texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipmark.functions import noise
from slipmark.functions.lets import array_rows
from slipmark.functions.numbers import number_intervention
from slipmark.queries import views as V
from slipmark.queries.numbers import candidates_sql, draw_sql, outputs_sql
from slipmark.queries.registry import query

STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def positions_sql(source: str, size: int, name: str = "placed") -> str:
    """Positions without replacement: rank i is drawn among those left, then moved past the taken ones."""
    return rf"""
ranks as (select id, n, unnest(range({size})) as i from {source} where n > {size}),
drawn as (select id, i, {draw_sql("id", "'letters'", "cast(i as varchar)")} % greatest(n - i, 1) as r from ranks),
draw_lists as (select id, list(r order by i) as rs from drawn group by id),
{name} as (
  select id, cast([] as bigint[]) as taken, rs, 0 as i from draw_lists
  union all
  select id, list_append(taken, list_reduce(list_prepend(rs[i + 1], list_sort(taken)),
                                            lambda r, t: case when r >= t then r + 1 else r end)), rs, i + 1
  from {name} where i < {size})"""


def noisy_sql(texts: str, purpose: str, take: int, size: int, placed: str = "placed") -> str:
    """Texts with letter k replaced where k - 1 is one of the first ``take`` positions; ``texts`` has id, t."""
    return rf"""
select id, string_agg(case when k is not null and list_contains(ps, k - 1)
                           then concat(left(piece, length(piece) - 1),
                                       substr('abcdefghijklmnopqrstuvwxyz', {draw_sql("id", purpose, "cast(k as varchar)")} % 26 + 1, 1))
                           else piece end, '' order by rn) as t
from (select id, ps, piece, rn, case when regexp_matches(piece, '\p{{L}}$') then rn - 1 end as k
      from (select x.id, p.taken[1:{take}] as ps, unnest(regexp_extract_all(x.t, '(?s)\P{{L}}*\p{{L}}|\P{{L}}+')) as piece,
                   generate_subscripts(regexp_extract_all(x.t, '(?s)\P{{L}}*\p{{L}}|\P{{L}}+'), 1) as rn
            from {texts} x join {placed} p on p.id = x.id and p.i = {size})) group by id"""


BOUND = """src as (select id, case when strpos(text, concat(' Let', chr(39), 's think step by step.')) > 0
             then substr(text, strpos(text, concat(' Let', chr(39), 's think step by step.')) + 26) else text end as t
        from texts where text <> ''),
counted as (select id, t, len(regexp_extract_all(t, '\\p{L}')) as n from src)""".replace("\\\\", "\\")


@query("letter_noise", f"with recursive {BOUND}," + positions_sql("counted", 10) + f"""
select id, 0 as part_no, 'typo5' as perturbation, trim(t, {STRIP}) as text from ({noisy_sql("counted", "'letter:typo5'", 6, 10)})
union all
select id, 1, 'typo10', trim(t, {STRIP}) from ({noisy_sql("counted", "'letter:typo10'", 11, 10)})
union all
select id, unnest([0, 1]), unnest(['typo5', 'typo10']), '' from texts where text = ''""", "texts")
def letter_noise(spark, sf_dir):
    df = V.texts(spark, sf_dir)
    made = noise.letter_noise(F.col("id"), F.col("text"), "typo5_typo10")
    return array_rows(df, ["id"], made).drop("pos")


@query("number_plus_letter_noise", candidates_sql("texts").replace("with ", "with recursive ", 1) + ","
       + outputs_sql("copy", ["add1", "add101"])
       + r""", counted as (select id, len(regexp_extract_all(text, '\p{L}')) as n from outputs where part_no = 0),"""
       + positions_sql("counted", 3)
       + f""", first_out as (select id, text as t from outputs where part_no = 0),
second_out as (select id, text as t from outputs where part_no = 1)
select id, 0 as part_no, 'add1' as perturbation, t as text from ({noisy_sql("first_out", "'letter:all'", 3, 3)})
union all
select id, 1, 'add101', t from ({noisy_sql("second_out", "'letter:all'", 3, 3)})
union all
select id, unnest([0, 1]), unnest(['add1', 'add101']), '' from texts where text = ''""", "texts")
def number_plus_letter_noise(spark, sf_dir):
    df = V.texts(spark, sf_dir)
    made = number_intervention(
        F.col("id"), F.col("text"), "copy", "add1_add101", noise=noise.matched_noise(3))
    return array_rows(df, ["id"], made).drop("pos")
