"""Sentences by learned abbreviations, beside SQL from the same counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadlens.operators import sentences as se
from threadlens.plans.bridges import Tables
from threadlens.plans.registry import query

CORE_SQL = r"regexp_extract(lower({0}), '(?s)[\p{{L}}\p{{N}}](?:.*[\p{{L}}\p{{N}}])?')"


def likelihood_sql(k: str, n: str, p: str) -> str:
    share = f"greatest(1e-12, least(1 - 1e-12, {p}))"
    return f"(({k}) * ln({share}) + (({n}) - ({k})) * ln(1 - {share}))"


def association_sql(both: str, first: str, second: str, total: str) -> str:
    p, p1 = f"({second}) / cast({total} as double)", f"({both}) / cast({first} as double)"
    p2 = f"coalesce((({second}) - ({both})) / cast(nullif({total} - ({first}), 0) as double), 0)"
    rest, others = f"({second}) - ({both})", f"{total} - ({first})"
    apart = f"{likelihood_sql(both, first, p)} + {likelihood_sql(rest, others, p)}"
    bound = f"{likelihood_sql(both, first, p1)} + {likelihood_sql(rest, others, p2)}"
    return f"-2 * (({apart}) - ({bound}))"


# The words of each document with their neighbours by windows, then the counts, the three lists and the breaks.
SENTENCES_SQL = rf"""
cut as (select doc_id, w, i from (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i
   from (select doc_id, regexp_split_to_array(text, '\s+') ws from documents)) where w <> ''),
seq as (select doc_id, w, row_number() over d i, lag(w) over d b, lead(w) over d a from cut window d as (partition by doc_id order by i)),
told as (select *, {CORE_SQL.format('w')} t, {CORE_SQL.format('a')} nt, right(w, 1) in ('.', '!', '?') ends,
   coalesce(right(b, 1) not in ('.', '!', '?'), false) inside,
   regexp_matches(w, '[\p{{L}}\p{{N}}]\.$') last_dot, regexp_matches(a, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') cap from seq),
cnt as (select t, count(*) n, count(*) filter (regexp_matches(w, '[\p{{L}}\p{{N}}]\.([^\p{{L}}\p{{N}}.][^\p{{L}}\p{{N}}]*)?$')) k,
   count(*) filter (regexp_matches(w, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}')) low,
   count(*) filter (inside and regexp_matches(w, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}')) inn from told where t <> '' group by t),
tot as (select sum(n) n, (sum(k) + 0.5e0) / (sum(n) + 1.0e0) p from cnt),
abbr as (select t, n from (select t, c.n, k, length(replace(t, '.', '')) c0, length(t) c1, p from cnt c, tot)
  where k > 0 and regexp_matches(t, '\p{{L}}') and -2 * ({likelihood_sql('k', 'n', 'p')} - {likelihood_sql('k', 'n', '0.99e0')})
    * exp(-c0) * (c1 - c0 + 1) * pow(cast(c0 as double), cast(k - n as double)) >= 0.3e0),
brk as (select doc_id, i, case when last_dot then t end t, nt, cap from told where ends and a is not null),
opn as (select nt, count(*) o from brk where t is null or t not in (select t from abbr) group by nt),
osum as (select coalesce(sum(o), 0) s from opn),
nxt as (select c.t nt, c.n, low > 0 and inn = 0 small, case when s > 0 then coalesce(o, 0) * tot.n > c.n * s
    and {association_sql('coalesce(o, 0)', 's', 'c.n', 'tot.n')} > 30 else false end opens
  from cnt c left join opn on opn.nt = c.t, tot, osum),
prs as (select b.t, b.nt, a.n tn, count(*) ab from brk b join abbr a on a.t = b.t group by all),
may as (select p.t, p.nt, coalesce((opens or small) and not (ab * tot.n > tn * x.n
    and {association_sql('ab', 'tn', 'x.n', 'tot.n')} > 7.88e0 and not opens), false) may
  from prs p left join nxt x on x.nt = p.nt, tot),
stay as (select doc_id, i from brk left join may on may.t = brk.t and may.nt = brk.nt where may.t is null or (cap and may)),
lens as (select doc_id, i - lag(i, 1, 0) over (partition by doc_id order by i) n from
  (select doc_id, i from stay union all select doc_id, max(i) from seq group by doc_id))"""


@query(
    "q_ft_sentences_learned",
    """select d.doc_id, count(l.n) sentences, coalesce(max(l.n), 0) longest_sentence
    from documents d left join lens l on l.doc_id = d.doc_id group by d.doc_id""",
    extra=SENTENCES_SQL,
)
def ft_sentences_learned(t: Tables) -> DataFrame:
    return se.learned_sentences(t.documents, se.held_pairs(t.documents), ("doc_id",))
