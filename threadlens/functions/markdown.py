"""HTML as Markdown with its structure kept: lists with numbers and depth, headings, quotes, tables, images, links.

A page is an array of tokens (tags, entities, runs of text) and one fold over it whose state holds the open elements: a
stack of lists, the depth of quotes and preformatted text, the open link, the place in a table. A break is only noted; it is
written with the prefix of its line once something follows, so empty elements leave no lines.

Text grows in blocks of about the square root of the number of tokens, so that no long text is copied for each token.

Defined results: null stays null; an end tag without its start closes nothing; what is open at the end is closed there; a
link in a link ends the outer one; an unknown entity stays as it stands, a number that is no character too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.markup import DROP_RULES, ENTITIES, rewrite

TOKEN = r"<[^<>]*+>|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z]{1,8};|[^<&]++|[<&]"
BREAKS = (
    "p div li tr h1 h2 h3 h4 h5 h6 pre ul ol table blockquote hr br dl dt dd section article header footer nav aside main "
    "form figure figcaption"
).split()
# Lists and quotes within more than this many others are shown as deep as these; browsers have such a limit too.
DEPTH = 64
STATE = (
    "struct<out:string,pending:boolean,marker:string,lists:array<int>,over:int,quote:int,cells:int,rows:int,"
    "href:string,pre:int>"
)
BLOCKS = f"struct<done:array<string>,s:{STATE}>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _of(kind: Column, names) -> Column:
    return kind.isin([x for n in names for x in (n, f"/{n}")])


def _attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute, null without one."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*+=\s*+["']([^"'<>]*+)["']""", 1)
    there = tag.rlike(rf"""(?is)\s{name}\s*+=\s*+["'][^"'<>]*+["']""")
    return F.when(there, F.replace(found, F.lit("&amp;"), F.lit("&")))


def _entity(token: Column) -> Column:
    code = F.when(
        token.rlike("^&#[xX]"), F.conv(F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)
    ).otherwise(F.regexp_extract(token, "^&#([0-9]+);", 1)).try_cast("long")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair]), token)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    return F.coalesce(F.when(token.startswith("&#"), char).otherwise(named), token)


def _token(token: Column) -> Column:
    """(kind, text, attr): the kind is a tag's name with its slash, '' for another tag, 'text' for what is shown."""
    tag = (F.length(token) > 1) & token.startswith("<")
    kind = F.when(tag, F.lower(F.regexp_extract(token, "^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1))).otherwise("text")

    def described(kind: Column) -> Column:
        src, alt = _attribute(token, "src"), F.coalesce(_attribute(token, "alt"), F.lit(""))
        sizes = [
            F.coalesce(F.concat(F.lit(f' {side}="'), _attribute(token, side), F.lit('"')), F.lit("")) for side in ("width", "height")
        ]
        size = F.concat(*sizes)
        image = F.when(size == "", F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")"))).otherwise(
            F.concat(F.lit('<img src="'), src, F.lit('"'), size, F.when(alt == "", "").otherwise(F.concat(F.lit(' alt="'), alt, F.lit('"'))), F.lit(" />"))
        )
        text = F.when(kind == "text", F.when(token.startswith("&"), _entity(token)).otherwise(token)).when(
            kind == "img", F.coalesce(image, F.lit(""))
        ).when(kind == "hr", "* * *").when(_of(kind, ("b", "strong")), "**").when(_of(kind, ("i", "em")), "_")
        attr = F.when(kind == "a", _attribute(token, "href")).when(
            kind == "ol", F.greatest(F.coalesce(F.regexp_extract(_attribute(token, "start"), "^[0-9]{1,6}$", 0).try_cast("int"), F.lit(1)), F.lit(0)).cast("string")
        )
        return F.struct(kind.alias("kind"), F.coalesce(text, F.lit("")).alias("text"), attr.alias("attr"))

    return _let(kind, described)


def _step(s: Column, t: Column) -> Column:
    """One token moves the state on."""
    kind, text, attr = t["kind"], t["text"], t["attr"]
    open_list = F.size(s["lists"]) > 0
    top = F.when(open_list, F.element_at(s["lists"], -1))
    under = F.slice(s["lists"], 1, F.greatest(F.size(s["lists"]) - 1, F.lit(0)))
    shut = F.when(s["href"].isNotNull(), F.concat(F.lit("](<"), s["href"], F.lit(">)"))).otherwise("")
    rule = (kind == "/tr") & (s["rows"] == 0) & (s["cells"] > 0)
    shown = (
        F.when(kind == "text", F.when(s["pre"] > 0, text).otherwise(F.regexp_replace(text, r"[ \t\r\n\f]+", " ")))
        .when(kind == "a", F.concat(shut, F.when(attr.isNotNull(), "[").otherwise("")))
        .when(kind == "/a", shut)
        .when(kind.isin("td", "th") & (s["cells"] > 0), " | ")
        .when(rule, F.array_join(F.array_repeat(F.lit("---"), s["cells"]), "|"))
        .otherwise(text)
    )

    def written(e: Column) -> Column:
        begins = s["pending"] | rule | (kind == "hr")
        shows = (e != "") & ~(s["pending"] & (F.trim(e) == "") & (s["pre"] == 0))
        lead = F.concat(F.lit("\n"), F.repeat(F.lit("> "), F.least(s["quote"], F.lit(DEPTH))), s["marker"])
        added = F.when(begins, F.concat(lead, F.when(s["pre"] > 0, e).otherwise(F.ltrim(e)))).otherwise(e)
        number = F.when(top >= 0, F.concat(top.cast("string"), F.lit(". "))).otherwise("* ")
        indent = F.repeat(F.lit("  "), F.greatest(F.size(s["lists"]) - 1, F.lit(0)))
        marker = (
            F.when(kind == "li", F.concat(indent, number))
            .when(kind.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(kind, 2, 1).try_cast("int")), F.lit(" ")))
            .when(kind.rlike("^/(li|h[1-6])$") | shows, "")
            .otherwise(s["marker"])
        )
        full = F.size(s["lists"]) >= DEPTH
        over = F.when(kind.isin("ul", "ol") & full, s["over"] + 1).when(kind.isin("/ul", "/ol") & (s["over"] > 0), s["over"] - 1)
        lists = (
            F.when(kind.isin("ul", "ol") & full | kind.isin("/ul", "/ol") & (s["over"] > 0), s["lists"])
            .when(kind == "ul", F.concat(s["lists"], F.array(F.lit(-1))))
            .when(kind == "ol", F.concat(s["lists"], F.array(attr.try_cast("int"))))
            .when(kind.isin("/ul", "/ol"), under)
            .when((kind == "li") & (top >= 0), F.concat(under, F.array(top + 1)))
            .otherwise(s["lists"])
        )

        def depth(now: Column, name: str) -> Column:
            return F.when(kind == name, now + 1).when(kind == f"/{name}", F.greatest(now - 1, F.lit(0))).otherwise(now)

        cells = F.when(kind == "tr", 0).when(kind.isin("td", "th"), s["cells"] + 1).otherwise(s["cells"])
        rows = F.when(kind == "table", 0).when(kind == "/tr", s["rows"] + 1).otherwise(s["rows"])
        href = F.when(kind == "a", attr).when(kind == "/a", F.lit(None)).otherwise(s["href"])
        return F.struct(
            F.when(shows, F.concat(s["out"], added)).otherwise(s["out"]).alias("out"),
            (_of(kind, BREAKS) | (s["pending"] & ~shows)).alias("pending"),
            marker.alias("marker"), lists.alias("lists"), F.coalesce(over, s["over"]).alias("over"),
            depth(s["quote"], "blockquote").alias("quote"),
            cells.alias("cells"), rows.alias("rows"), href.alias("href"), depth(s["pre"], "pre").alias("pre"),
        ).cast(STATE)

    return _let(shown, written)


def html_markdown(html: Column) -> Column:
    """Markdown of a page or fragment. Blanks at line ends go."""
    start = F.struct(
        F.lit(""), F.lit(True), F.lit(""), F.array().cast("array<int>"),
        F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("string"), F.lit(0),
    ).cast(STATE)

    def folded(tokens: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(tokens))).cast("int"), F.lit(1))
        firsts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), width)).otherwise(F.array().cast("array<int>"))

        def block(b: Column, first: Column) -> Column:
            after = F.aggregate(F.slice(tokens, first, width), b["s"], _step)
            return _let(
                after,
                lambda a: F.struct(F.concat(b["done"], F.array(a["out"])).alias("done"), a.withField("out", F.lit("")).alias("s")).cast(BLOCKS),
            )

        def ended(b: Column) -> Column:
            shut = F.concat(F.lit("](<"), b["s"]["href"], F.lit(">)"))
            return F.concat(F.array_join(b["done"], ""), F.coalesce(shut, F.lit("")))

        return F.aggregate(firsts, F.struct(F.array().cast("array<string>").alias("done"), start.alias("s")).cast(BLOCKS), block, ended)

    tokens = F.transform(F.regexp_extract_all(rewrite(html, DROP_RULES), F.lit(TOKEN), F.lit(0)), _token)
    text = F.when(html.isNotNull(), _let(tokens, folded))
    return F.regexp_replace(F.regexp_replace(text, r"(?<! ) ++(?=\n|\z)", ""), r"\A\n++|\n++\z", "")
