"""Pages of regions, lines, words and tables as nested structs, and what is written from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g
from .text import escape_markup, strip_white

WORD = f"struct<text:string,bbox:{g.BOX},polygon:array<double>>"
LINE = f"struct<text:string,bbox:{g.BOX},direction:string,words:array<{WORD}>,baseline:double,polygon:array<double>>"
CELL = f"struct<row:int,col:int,text:string,row_span:int,col_span:int,is_header:boolean,bbox:{g.BOX}>"
TABLE = f"struct<rows:int,cols:int,has_header_row:boolean,cells:array<{CELL}>>"
REGION = f"struct<type:string,bbox:{g.BOX},reading_order:int,lines:array<{LINE}>,table:{TABLE},attributes:map<string,string>>"
PAGE = f"struct<width:int,height:int,direction:string,regions:array<{REGION}>,attributes:map<string,string>>"
REGION_TYPES = (
    "title", "heading", "paragraph", "list", "table", "figure", "chart", "caption", "header", "footer",
    "page_number", "formula", "code", "key_value", "quote", "separator", "stamp", "signature", "handwriting", "marginalia",
)
_HTML_TAGS = {
    "title": "h1", "heading": "h2", "paragraph": "p", "caption": "figcaption", "header": "header", "footer": "footer",
    "quote": "blockquote", "code": "pre", "page_number": "footer", "marginalia": "aside",
}


def _join(parts: Column, by: str) -> Column:
    return F.array_join(parts, by)


def checked_type(kind: Column) -> Column:
    """A region type; an unknown one is an error."""
    return F.when(kind.isin(*REGION_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown region type: "), F.coalesce(kind, F.lit("null")))).cast("string"))


def _origin(table: Column, r: Column, c: Column) -> Column:
    return F.filter(table["cells"], lambda x: (x["row"] == r) & (x["col"] == c))


def cell_at(table: Column, r, c) -> Column:
    """The first cell with that origin, or null."""
    r, c = (F.lit(v) if not isinstance(v, Column) else v for v in (r, c))
    return F.get(_origin(table, r, c), F.lit(0))


def _grid(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def table_html(table: Column) -> Column:
    def cell(x: Column) -> Column:
        tag = F.when(F.coalesce(x["is_header"], F.lit(False)), "th").otherwise("td")
        span = lambda n, name: F.when(F.coalesce(n, F.lit(1)) > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), tag, span(x["row_span"], "rowspan"), span(x["col_span"], "colspan"), F.lit(">"), escape_markup(F.coalesce(x["text"], F.lit(""))), F.lit("</"), tag, F.lit(">"))

    def row(r: Column) -> Column:
        cells = F.flatten(F.transform(_grid(table["cols"]), lambda c: F.slice(_origin(table, r, c), 1, 1)))
        return F.concat(F.lit("<tr>"), _join(F.transform(cells, cell), ""), F.lit("</tr>"))

    return F.when(table.isNotNull(), F.concat(F.lit("<table>"), _join(F.transform(_grid(table["rows"]), row), ""), F.lit("</table>")))


def table_otsl(table: Column) -> Column:
    """Structure tags of the grid; of cells that overlap the later one counts, places without a cell are empty."""

    def place(r: Column, c: Column) -> Column:
        covers = F.filter(
            table["cells"],
            lambda x: (x["row"] <= r) & (r < x["row"] + F.coalesce(x["row_span"], F.lit(1))) & (x["col"] <= c) & (c < x["col"] + F.coalesce(x["col_span"], F.lit(1))),
        )
        x = F.try_element_at(covers, F.lit(-1))
        full = strip_white(F.coalesce(x["text"], F.lit(""))) != ""
        return (
            F.when(x.isNull(), "ecel")
            .when((x["row"] == r) & (x["col"] == c), F.when(full, "fcel").otherwise("ecel"))
            .when(x["row"] == r, "lcel")
            .when(x["col"] == c, "ucel")
            .otherwise("xcel")
        )

    rows = F.transform(_grid(table["rows"]), lambda r: F.concat(F.transform(_grid(table["cols"]), lambda c: place(r, c)), F.array(F.lit("nl"))))
    return F.when(table.isNotNull(), _join(F.flatten(rows), " "))


def table_markdown(table: Column) -> Column:
    def row(r: Column) -> Column:
        cells = F.transform(_grid(table["cols"]), lambda c: F.coalesce(cell_at(table, r, c)["text"], F.lit("")))
        line = F.concat(F.lit("| "), _join(cells, " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), _join(F.transform(_grid(table["cols"]), lambda c: F.lit("---")), " | "), F.lit(" |"))
        return F.when((r == 0) & F.coalesce(table["has_header_row"], F.lit(False)), F.concat(line, F.lit("\n"), rule)).otherwise(line)

    return F.when(table.isNotNull(), _join(F.transform(_grid(table["rows"]), row), "\n"))


def _line_texts(region: Column) -> Column:
    return F.transform(F.coalesce(region["lines"], F.array().cast(f"array<{LINE}>")), lambda x: x["text"])


def region_text(region: Column) -> Column:
    """Lines by line breaks; a table without lines gives its grid."""
    table = region["table"]
    grid = _join(F.transform(_grid(table["rows"]), lambda r: _join(F.transform(_grid(table["cols"]), lambda c: F.coalesce(cell_at(table, r, c)["text"], F.lit(""))), " ")), "\n")
    lines = _line_texts(region)
    return F.when(table.isNotNull() & (F.size(lines) == 0), grid).otherwise(_join(lines, "\n"))


def ordered_regions(page: Column) -> Column:
    """Regions by reading order; equal ones stay as they were."""
    keyed = F.transform(page["regions"], lambda r, i: F.struct(r["reading_order"].alias("o"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda k: F.get(page["regions"], k["i"]))


def page_text(page: Column) -> Column:
    return _join(F.filter(F.transform(ordered_regions(page), region_text), lambda t: t != ""), "\n")


def page_lines(page: Column) -> Column:
    return F.flatten(F.transform(ordered_regions(page), lambda r: F.coalesce(r["lines"], F.array().cast(f"array<{LINE}>"))))


def page_words(page: Column) -> Column:
    return F.flatten(F.transform(page_lines(page), lambda x: F.coalesce(x["words"], F.array().cast(f"array<{WORD}>"))))


def _attribute(region: Column, name: str) -> Column:
    return F.try_element_at(region["attributes"], F.lit(name))


def region_html(region: Column) -> Column:
    kind, text = region["type"], region_text(region)
    items = _join(F.transform(_line_texts(region), lambda x: F.concat(F.lit("<li>"), escape_markup(x), F.lit("</li>"))), "")
    out = (
        F.when((kind == "table") & region["table"].isNotNull(), table_html(region["table"]))
        .when(kind == "list", F.concat(F.lit("<ul>"), items, F.lit("</ul>")))
        .when(kind.isin("figure", "chart"), F.concat(F.lit('<figure><img alt="'), escape_markup(text), F.lit('"></figure>')))
        .when(kind == "formula", F.concat(F.lit("<math>"), escape_markup(F.coalesce(_attribute(region, "latex"), text)), F.lit("</math>")))
        .when(kind == "separator", F.lit("<hr>"))
    )
    tag = F.lit("p")
    for name, value in _HTML_TAGS.items():
        tag = F.when(kind == name, value).otherwise(tag)
    return out.otherwise(F.concat(F.lit("<"), tag, F.lit(">"), escape_markup(text), F.lit("</"), tag, F.lit(">")))


def page_html(page: Column) -> Column:
    return _join(F.transform(ordered_regions(page), region_html), "\n")


def region_markdown(region: Column) -> Column:
    kind, text = region["type"], region_text(region)
    latex = F.coalesce(F.nullif(_attribute(region, "latex"), F.lit("")), text)
    chart = _attribute(region, "chart")
    return (
        F.when((kind == "table") & region["table"].isNotNull(), table_markdown(region["table"]))
        .when(kind == "list", _join(F.transform(_line_texts(region), lambda x: F.concat(F.lit("- "), x)), "\n"))
        .when(kind == "separator", "---")
        .when(kind == "formula", F.concat(F.lit("$$\n"), latex, F.lit("\n$$")))
        .when(kind == "chart", F.coalesce(F.concat(F.lit("```json\n"), chart, F.lit("\n```")), text))
        .when(kind == "figure", "")
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*")))
        .when(kind == "title", F.concat(F.lit("# "), text))
        .when(kind == "heading", F.concat(F.lit("## "), text))
        .when(kind == "quote", F.concat(F.lit("> "), text))
        .otherwise(text)
    )


def page_markdown(page: Column) -> Column:
    return _join(F.filter(F.transform(ordered_regions(page), region_markdown), lambda t: strip_white(t) != ""), "\n\n")


def clipped(page: Column) -> Column:
    """Boxes of regions, lines and words within the page; regions outside go. Polygons and cells stay as they are."""
    whole = g.box(0, 0, page["width"], page["height"])
    cut = lambda b: g.clip(b, 0, 0, page["width"], page["height"])
    word = lambda w: w.withField("bbox", cut(w["bbox"]))
    line = lambda x: x.withField("bbox", cut(x["bbox"])).withField("words", F.transform(x["words"], word))
    region = lambda r: r.withField("bbox", cut(r["bbox"])).withField("lines", F.transform(r["lines"], line))
    return page.withField("regions", F.transform(F.filter(page["regions"], lambda r: g.intersects(r["bbox"], whole)), region))


def translated(region: Column, dx, dy) -> Column:
    """A region with its lines, words and cells moved."""
    move = lambda x: x.withField("bbox", g.translate(x["bbox"], dx, dy))
    line = lambda x: move(x).withField("baseline", x["baseline"] + dy).withField("words", F.transform(x["words"], move))
    out = move(region).withField("lines", F.transform(region["lines"], line))
    cells = F.transform(region["table"]["cells"], move)
    return out.withField("table", F.when(region["table"].isNotNull(), region["table"].withField("cells", cells)))


def with_reading_order(regions: Column, direction: str = "ltr") -> Column:
    """Regions by their tops rounded to a tenth, then from the left, or from the right for rtl; numbered from 0."""
    side = (lambda b: -b["x1"]) if direction == "rtl" else (lambda b: b["x0"])
    keyed = F.transform(regions, lambda r, i: F.struct(F.round(r["bbox"]["y0"], 1).alias("y"), side(r["bbox"]).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda k, n: F.get(regions, k["i"]).withField("reading_order", n))


def to_json(page: Column) -> Column:
    """A page as JSON without absent fields."""
    return F.to_json(page)


def from_json(text: Column) -> Column:
    """The inverse: absent types, directions and spans get their defaults; an unknown type is an error."""
    page = F.from_json(text, PAGE)

    def cell(c: Column) -> Column:
        return c.withField("row_span", F.coalesce(c["row_span"], F.lit(1))).withField("col_span", F.coalesce(c["col_span"], F.lit(1))).withField("is_header", F.coalesce(c["is_header"], F.lit(False)))

    def region(r: Column) -> Column:
        table = F.when(r["table"].isNotNull(), r["table"].withField("cells", F.transform(r["table"]["cells"], cell)))
        return r.withField("type", checked_type(F.coalesce(r["type"], F.lit("paragraph")))).withField("reading_order", F.coalesce(r["reading_order"], F.lit(0))).withField("table", table)

    return page.withField("direction", F.coalesce(page["direction"], F.lit("ltr"))).withField("regions", F.transform(page["regions"], region))
