"""Porter stemming as column expressions, one projection per step.

Follows M.F. Porter, "An algorithm for suffix stripping" (1980), with the widely used later amendments
(short words kept, a pool of irregular words, -ied/-ies of four letters, -y only after a consonant, -bli,
-fulli, -logi). Meant for distinct tokens, so a vocabulary is stemmed, never a corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word is [C](VC)^m[V]. A leading y is written Y while a word is being stemmed: there it is a consonant.
C = "[^aeiou][^aeiouy]*"
V = "[aeiouy][aeiou]*"
M_OVER_0 = f"^(?:{C})?{V}{C}"
M_IS_1 = f"^(?:{C})?{V}{C}(?:{V})?$"
M_OVER_1 = f"^(?:{C})?{V}{C}{V}{C}"
HAS_VOWEL = f"^(?:{C})?{V}"
# consonant-vowel-consonant at the end, the last not w, x or y; or a two-letter vowel-consonant word
SHORT_END = f"^{C}[aeiouy][^aeiouwxyY]$|^[aeiou][^aeiou]$"
CONSONANT_END = "(?:[^aeiouy]|[aeiou]y(?:yy)*|[^aeiouy](?:yy)+)$"
# put where -ed or -ing fell and the ending still has to be tidied
MARK = "\u0001"

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


def _suffix(suffixes) -> str:
    """Longest of ``suffixes`` that ends the word ('' if none)."""
    longest_first = sorted(suffixes, key=len, reverse=True)
    return "case " + " ".join(f"when endswith(w, '{s}') then '{s}'" for s in longest_first) + " else '' end"


def _case(table: dict[str, str], key: str, other: str) -> str:
    return f"case {key} " + " ".join(f"when '{old}' then '{new}'" for old, new in table.items()) + f" else {other} end"


def _head(n: int | str) -> str:
    """The word without its last ``n`` characters."""
    return f"substring(w, 1, length(w) - {n})"


PLURAL = f"""case when endswith(w, 'ies') and length(w) = 4 then {_head(1)}
    when endswith(w, 'sses') or endswith(w, 'ies') then {_head(2)}
    when endswith(w, 's') and not endswith(w, 'ss') then {_head(1)} else w end"""

PAST = f"""case when endswith(w, 'ied') then if(length(w) = 4, {_head(1)}, {_head(2)})
    when endswith(w, 'eed') then if({_head(3)} rlike '{M_OVER_0}', {_head(1)}, w)
    when endswith(w, 'ed') and {_head(2)} rlike '{HAS_VOWEL}' then concat({_head(2)}, '{MARK}')
    when endswith(w, 'ing') and {_head(3)} rlike '{HAS_VOWEL}' then concat({_head(3)}, '{MARK}') else w end"""

TIDY = f"""case when not endswith(w, '{MARK}') then w
    when bare rlike '(?:at|bl|iz)$' then concat(bare, 'e')
    when length(bare) > 1 and right(bare, 1) = left(right(bare, 2), 1) and bare rlike '{CONSONANT_END}'
      then if(right(bare, 1) in ('l', 's', 'z'), bare, substring(bare, 1, length(bare) - 1))
    when bare rlike '{M_IS_1}' and bare rlike '{SHORT_END}' then concat(bare, 'e') else bare end"""

LAST_Y = f"""if(endswith(w, 'y') and length(w) > 2 and {_head(1)} rlike '{CONSONANT_END}', concat({_head(1)}, 'i'), w)"""

ALLI = f"if(endswith(w, 'alli') and {_head(4)} rlike '{M_OVER_0}', {_head(2)}, w)"

# -logi counts its l with the stem
REPLACE = f"""if(suffix <> '' and if(suffix = 'logi', {_head(3)}, {_head('length(suffix)')}) rlike '{M_OVER_0}',
    concat({_head('length(suffix)')}, %s), w)"""

DROP = f"""if(suffix <> '' and {_head('length(suffix)')} rlike '{M_OVER_1}'
    and (suffix <> 'ion' or {_head(3)} rlike '[st]$'), {_head('length(suffix)')}, w)"""

LAST_E = f"""if(endswith(w, 'e') and ({_head(1)} rlike '{M_OVER_1}'
    or ({_head(1)} rlike '{M_IS_1}' and not {_head(1)} rlike '{SHORT_END}')), {_head(1)}, w)"""

LAST_L = f"if(endswith(w, 'll') and {_head(1)} rlike '{M_OVER_1}', {_head(1)}, w)"


def porter(df: DataFrame, token: str = "token", out: str = "stem") -> DataFrame:
    """Add the stem of a lower-case ``token`` column."""
    kept = [f"`{c}`" for c in df.columns]

    def step(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.selectExpr(*kept, *columns)

    rows = step(df, f"regexp_replace(`{token}`, '^y', 'Y') as w")
    rows = step(rows, f"{PLURAL} as w")
    rows = step(rows, f"{PAST} as w")
    rows = step(rows, "w", f"{_head(1)} as bare")
    for expression in (TIDY, LAST_Y, ALLI):
        rows = step(rows, f"{expression} as w")
    for table in (STEP2, STEP3):
        rows = step(rows, "w", f"{_suffix(table)} as suffix")
        rows = step(rows, f"{REPLACE % _case(table, 'suffix', repr(''))} as w")
    rows = step(rows, "w", f"{_suffix(STEP4)} as suffix")
    for expression in (DROP, LAST_E, LAST_L):
        rows = step(rows, f"{expression} as w")
    regular = f"if(length(`{token}`) <= 2, `{token}`, regexp_replace(w, '^Y', 'y'))"
    return step(rows, f"{_case(IRREGULAR, f'`{token}`', regular)} as `{out}`")
