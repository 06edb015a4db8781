"""HTML as Markdown, against a recursive query that reads one token of each page a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.markdown import html_markdown
from threadlens.plans.bridges import Tables
from threadlens.plans.extract_queries import chained
from threadlens.plans.registry import query

DROP = [("(?s)<!--.*?(-->|\\z)", "")]
DROP += [(rf"(?is)<{tag}\b[^<>]*>.*?(</{tag}\s*>|\z)", "") for tag in ("head", "script", "style", "noscript")]


def _attribute(name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*["'']([^"''<>]*)["'']"""
    return f"case when regexp_matches(t, '{pattern}') then replace(regexp_extract(t, '{pattern}', 1), '&amp;', '&') end"


BREAK_TAGS = (
    "p div li tr h1 h2 h3 h4 h5 h6 pre ul ol table blockquote hr br dl dt dd section article header footer nav aside main "
    "form figure figcaption"
).split()
BREAKS = ", ".join(f"'{k}', '/{k}'" for k in BREAK_TAGS)

# Nesting beyond 64, which the given pages do not reach, is not cut here.
MARKDOWN_SQL = rf"""
raw as (select page_id, unnest(l) t, unnest(range(1, len(l) + 1)) pos from (select page_id, regexp_extract_all({chained('html', DROP)},
  '<[^<>]*>|&#[0-9]{{1,7}};|&#[xX][0-9a-fA-F]{{1,6}};|&[a-zA-Z]{{1,8}};|[^<&]+|[<&]') l from pages)),
kinds as (select *, case when length(t) > 1 and t like '<%' then lower(regexp_extract(t, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) else 'text' end kind,
  case when t like '&#x%' or t like '&#X%' then try_cast('0x' || regexp_extract(t, '([0-9a-fA-F]+);', 1) as int)
    else try_cast(regexp_extract(t, '^&#([0-9]+);', 1) as int) end code from raw),
attrs as (select *, {_attribute('href')} href, {_attribute('src')} src, coalesce({_attribute('alt')}, '') alt,
  coalesce(' width="' || {_attribute('width')} || '"', '') || coalesce(' height="' || {_attribute('height')} || '"', '') size,
  coalesce(try_cast(regexp_extract({_attribute('start')}, '^[0-9]{{1,6}}$') as int), 1) nr from kinds),
tok as materialized (select page_id, pos, kind, href, nr, coalesce(case
  when kind = 'text' and t like '&#%' then case when code between 1 and 55295 or code between 57344 and 1114111 then chr(code) else t end
  when kind = 'text' then case t when '&lt;' then '<' when '&gt;' then '>' when '&quot;' then '"' when '&nbsp;' then ' '
    when '&middot;' then '·' when '&copy;' then '©' when '&amp;' then '&' else t end
  when kind = 'img' then case when size = '' then '![' || alt || '](' || src || ')'
    else '<img src="' || src || '"' || size || case when alt = '' then '' else ' alt="' || alt || '"' end || ' />' end
  when kind = 'hr' then '* * *' when kind in ('b', '/b', 'strong', '/strong') then '**' when kind in ('i', '/i', 'em', '/em') then '_' end, '') piece
  from attrs),
fold as (
  select page_id, 0::bigint pos, '' txt, true pending, '' marker, []::int[] lists, 0 quote, 0 cells, 0 nrows, null::varchar href, 0 pre
  from pages where html is not null
  union all
  select page_id, pos, case when not shows then txt when begins then txt || chr(10) || repeat('> ', quote) || marker ||
      case when pre > 0 then e else ltrim(e, ' ') end else txt || e end,
    kind in ({BREAKS}) or (pending and not shows),
    case when kind = 'li' then repeat('  ', greatest(len(lists) - 1, 0)) || case when lists[-1] >= 0 then lists[-1] || '. ' else '* ' end
      when regexp_matches(kind, '^h[1-6]$') then repeat('#', kind[2]::int) || ' '
      when regexp_matches(kind, '^/(li|h[1-6])$') or shows then '' else marker end,
    case when kind = 'ul' then list_append(lists, -1) when kind = 'ol' then list_append(lists, nr)
      when kind in ('/ul', '/ol') then lists[1:len(lists) - 1]
      when kind = 'li' and lists[-1] >= 0 then list_append(lists[1:len(lists) - 1], lists[-1] + 1) else lists end,
    case kind when 'blockquote' then quote + 1 when '/blockquote' then greatest(quote - 1, 0) else quote end,
    case when kind = 'tr' then 0 when kind in ('td', 'th') then cells + 1 else cells end,
    case when kind = 'table' then 0 when kind = '/tr' then nrows + 1 else nrows end,
    case when kind = 'a' then new_href when kind = '/a' then null else href end,
    case kind when 'pre' then pre + 1 when '/pre' then greatest(pre - 1, 0) else pre end
  from (select *, e <> '' and not (pending and trim(e, ' ') = '' and pre = 0) shows,
      pending or kind = 'hr' or (kind = '/tr' and nrows = 0 and cells > 0) begins
    from (select f.page_id, t.pos, f.txt, f.pending, f.marker, f.lists, f.quote, f.cells, f.nrows, f.href, f.pre, t.kind, t.href new_href, t.nr,
        case when kind = 'text' then case when pre > 0 then piece else regexp_replace(piece, '[ \t\r\n\f]+', ' ', 'g') end
          when kind = 'a' then coalesce('](<' || f.href || '>)', '') || case when t.href is null then '' else '[' end
          when kind = '/a' then coalesce('](<' || f.href || '>)', '') when kind in ('td', 'th') and cells > 0 then ' | '
          when kind = '/tr' and nrows = 0 and cells > 0 then rtrim(repeat('---|', cells), '|') else piece end e
      from fold f join tok t on t.page_id = f.page_id and t.pos = f.pos + 1))),
ends as (select page_id, max(pos) pos from fold group by page_id),
folded as (select page_id, txt || coalesce('](<' || href || '>)', '') txt from fold join ends using (page_id, pos))"""


@query(
    "q_ex_html_markdown",
    r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(txt, ' +\n', chr(10), 'g'), ' +$', ''), '^\n+', ''), '\n+$', '') as text
    from pages left join folded using (page_id)""",
    extra=MARKDOWN_SQL,
    recursive=True,
)
def html_to_markdown(t: Tables) -> DataFrame:
    """Every page with its lists, headings, tables, quotes, images and links."""
    return t.pages.select("page_id", html_markdown(F.col("html")).alias("text"))
