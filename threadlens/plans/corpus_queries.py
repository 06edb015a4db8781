"""Queries over the corpus: tokens, stems, vocabulary, frequencies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators import corpus as co
from threadlens.plans.bridges import Tables
from threadlens.plans.registry import query
from threadlens.sources.counts import CountTable

# The stemmer's tables stand here again, so that a wrong entry on either side shows.
# Irregular words.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# Suffix replacements of steps 2 and 3 (measure above 0) and 4 (measure above 1).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _fits(word: str, pattern: str) -> str:
    return f"regexp_matches({word}, '{pattern}')"


def _m0(w: str) -> str:
    return _fits(w, f"^({_C})?{_V}{_C}")


def _m1(w: str) -> str:
    return _fits(w, f"^({_C})?{_V}{_C}({_V})?$")


def _m2(w: str) -> str:
    return _fits(w, f"^({_C})?{_V}{_C}{_V}{_C}")


def _vowel(w: str) -> str:
    return _fits(w, f"^({_C})?{_V}")


def _short(w: str) -> str:
    return _fits(w, f"^{_C}[aeiouy][^aeiouwxyY]$|^[aeiou][^aeiou]$")


def _consonant(w: str) -> str:
    return _fits(w, "([^aeiouy]|[aeiou]y(yy)*|[^aeiouy](yy)+)$")


def _swaps(table: dict[str, str]) -> str:
    whens = []
    for suffix in sorted(table, key=len, reverse=True):
        k = len(suffix)
        tested = f"left(w, {1 - k})" if suffix == "logi" else f"left(w, -{k})"
        whens.append(
            f"when w like '%{suffix}' then case when {_m0(tested)} then concat(left(w, -{k}), '{table[suffix]}') else w end"
        )
    return "case " + " ".join(whens) + " else w end"


def _drops() -> str:
    whens = []
    for suffix in sorted(STEP4, key=len, reverse=True):
        head = f"left(w, -{len(suffix)})"
        test = _m2(head) + (f" and {_fits(head, '[st]$')}" if suffix == "ion" else "")
        whens.append(f"when w like '%{suffix}' then case when {test} then {head} else w end")
    return "case " + " ".join(whens) + " else w end"


def stem_sql(source: str) -> str:
    """CTEs up to ``stems(token, n, stem)`` over the texts of ``source``."""
    pool = " ".join(f"when '{word}' then '{stem}'" for word, stem in IRREGULAR.items())
    return f"""
tok as (select token, count(*) n from (select unnest({TOKENS}) token from {source}) group by token),
p0 as (select token, n, regexp_replace(token, '^y', 'Y') w from tok),
p1 as (select token, n, case when length(w) = 4 and w like '%ies' then left(w, -1)
   when w like '%sses' or w like '%ies' then left(w, -2) when w like '%ss' then w
   when w like '%s' then left(w, -1) else w end w from p0),
p2 as (select token, n, w like '%ied' or w like '%eed' done,
   case when length(w) = 4 and w like '%ied' then left(w, -1) when w like '%ied' then left(w, -2)
   when w like '%eed' then case when {_m0("left(w, -3)")} then left(w, -1) else w end
   when w like '%ed' and {_vowel("left(w, -2)")} then left(w, -2)
   when w like '%ing' and {_vowel("left(w, -3)")} then left(w, -3) else w end w, w old from p1),
p3 as (select token, n, case when done or w = old then w
   when w like '%at' or w like '%bl' or w like '%iz' then concat(w, 'e')
   when length(w) > 1 and right(w, 1) = left(right(w, 2), 1) and {_consonant("w")}
     then case when right(w, 1) in ('l', 's', 'z') then w else left(w, -1) end
   when {_m1("w")} and {_short("w")} then concat(w, 'e') else w end w from p2),
p4 as (select token, n, case when w like '%y' and length(w) > 2 and {_consonant("left(w, -1)")}
   then concat(left(w, -1), 'i') else w end w from p3),
p5 as (select token, n, case when w like '%alli' and {_m0("left(w, -4)")} then left(w, -2) else w end w from p4),
p6 as (select token, n, {_swaps(STEP2)} w from p5),
p7 as (select token, n, {_swaps(STEP3)} w from p6),
p8 as (select token, n, {_drops()} w from p7),
p9 as (select token, n, case when w like '%e' and ({_m2("left(w, -1)")} or ({_m1("left(w, -1)")} and not {_short("left(w, -1)")}))
   then left(w, -1) else w end w from p8),
p10 as (select token, n, case when w like '%ll' and {_m2("left(w, -1)")} then left(w, -1) else w end w from p9),
stems as (select token, n, case token {pool} else
   case when length(token) <= 2 then token else regexp_replace(w, '^Y', 'y') end end stem from p10)"""


STEM_SQL = stem_sql("documents")


@query("q_co_tokens", "select token, count(*) n from (select unnest(" + TOKENS + ") token from documents) group by token")
def tokens(t: Tables) -> DataFrame:
    return co.token_counts(t.documents)


@query("q_co_stems", "select token, n, stem from stems", extra=STEM_SQL)
def stems(t: Tables) -> DataFrame:
    return co.stems(co.token_counts(t.documents))


@query("q_co_vocabulary", "select distinct stem from stems", extra=STEM_SQL)
def vocabulary(t: Tables) -> DataFrame:
    return co.vocabulary(co.stems(co.token_counts(t.documents)))


@query("q_co_vocabulary_size", "select count(distinct stem) stems, count(*) tokens from stems", extra=STEM_SQL)
def vocabulary_size(t: Tables) -> DataFrame:
    return co.stems(co.token_counts(t.documents)).agg(
        F.count_distinct("stem").alias("stems"), F.count("*").alias("tokens")
    )


@query("q_co_frequency", "select stem, cast(sum(n) as bigint) n from stems group by stem", extra=STEM_SQL)
def frequency(t: Tables) -> DataFrame:
    return co.frequency(co.stems(co.token_counts(t.documents)))


@query("q_co_frequency_merged", "select stem, cast(sum(n) as bigint) n from stems group by stem", extra=STEM_SQL)
def frequency_merged(t: Tables) -> DataFrame:
    """Counts of even and odd documents are merged; the odd ones are withdrawn and added again before the stems are taken."""
    docs, kept = t.documents, CountTable(t.spark, f"counts_{uuid.uuid4().hex}")
    parts = {f"part{k}": docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)) == k) for k in (0, 1)}
    for name, part in parts.items():
        kept.add(co.token_counts(part), name)
    kept.withdraw("part1")
    kept.add(co.token_counts(parts["part1"]), "part1")
    return co.frequency(co.stems(kept.total()))


@query("q_co_cutoff", "select stem, cast(sum(n) as bigint) n from stems group by stem having sum(n) > 1", extra=STEM_SQL)
def cutoff(t: Tables) -> DataFrame:
    return co.cutoff(co.frequency(co.stems(co.token_counts(t.documents))))


def loglik_sql(source: str, key: str, out: str = "loglik") -> str:
    """CTE ``loglik(key, loglikelihood)``; needs ``stems`` over the whole corpus."""
    return f"""
wt as (select {key}, w, count(*) sc from (select {key}, unnest(regexp_split_to_array(lower(text), '\\s+')) w from {source})
   where w <> '' group by {key}, w),
tt as (select {key}, w, count(*) tc from (select {key}, unnest({TOKENS}) w from {source}) group by {key}, w),
fr as (select stem, sum(n) f from stems group by stem),
{out} as (select d.{key}, floor(coalesce(sum(sc * tc * ln(cast(case when f > 1 then f else 1 end as double))), 0)
     / (select count(*) from fr) * 100 + 0.5) / 100 loglikelihood
  from (select {key} from {source}) d left join wt on d.{key} = wt.{key} left join tt on tt.{key} = wt.{key} and tt.w = wt.w
  left join stems on stems.token = tt.w left join fr on fr.stem = stems.stem group by d.{key})"""


@query("q_ft_loglik", "select doc_id, loglikelihood from loglik", extra=STEM_SQL + "," + loglik_sql("documents", "doc_id"))
def loglik(t: Tables) -> DataFrame:
    return co.scored_posts(t.documents, co.lexicon(t.documents), ("doc_id",))
