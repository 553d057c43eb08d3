"""Markdown: lines typed in the row, links and headings as expressions, and HTML by a parser in an Arrow function."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINK = r"(!?)\[([^\[\]()]*)\]\(([^\[\]()]+)\)"


def line_type(line: Column) -> Column:
    """h1..h5, bold, li, quote or p, read after leading blanks."""
    bare = F.ltrim(line)
    hashes = F.length(F.regexp_extract(bare, "^(#+)", 1))
    heading = F.concat(F.lit("h"), F.least(hashes, F.lit(5)).cast("string"))
    return F.when(hashes > 0, heading).when(bare.startswith("**"), "bold").when(bare.rlike(r"^[*-] "), "li").when(bare.startswith("'''"), "quote").otherwise("p")


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, type, depth, in_quote, text: depth is leading blanks / 3; a quote line opens or closes."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    typed = lines.withColumn("type", line_type(F.col("line"))).withColumn("depth", F.floor((F.length("line") - F.length(F.ltrim("line"))) / 3))
    marks = F.sum((F.col("type") == "quote").cast("long")).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return typed.select("doc_id", "line_no", "type", "depth", ((marks % 2 == 1) & (F.col("type") != "quote")).alias("in_quote"), heading_text(F.col("line")).alias("text"))


def heading_text(line: Column) -> Column:
    """Without up to six leading #, if the line is not indented."""
    return F.trim(F.regexp_replace(line, "^#{1,6}", ""))


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, label, url, is_image of every link."""
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(LINK), F.lit(i)).alias(n) for i, n in ((1, "bang"), (2, "label"), (3, "url"))))
    return docs.select("doc_id", F.explode(found).alias("l")).select("doc_id", "l.label", "l.url", (F.col("l.bang") == "!").alias("is_image"))


#: Marks and the elements they open and close.
_MARKS = {"**": ("<b>", "</b>"), "__": ('<p class="underline">', "</p>"), "--": ('<p class="strike">', "</p>"), "~~": ('<p class="strike">', "</p>"), "*": ("<i>", "</i>")}
_INLINE = re.compile(LINK + r"|\*\*|__|--|~~|\*")
#: Languages of code fences.
_LANGUAGES = ("java", "python", "javascript", "c++", "html", "css", "sql")


def inline(text: str) -> str:
    """Marks toggle; a mark without its partner stays as it is."""
    pieces, at, open_ = [], 0, []
    for m in _INLINE.finditer(text):
        pieces.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        if m[3]:
            url = m[3] if re.match(r"[a-z][a-z0-9+.-]*://", m[3], re.I) else "http://" + m[3]
            url, label = html.escape(url), html.escape(m[2])
            pieces.append(f'<img src="{url}" alt="{label}">' if m[1] else f'<a class="link" target="_blank" href="{url}">{label}</a>')
        elif m[0] in [mark for mark, _ in open_]:
            while open_:
                mark, place = open_.pop()
                if mark == m[0]:
                    pieces[place] = _MARKS[mark][0]
                    pieces.append(_MARKS[mark][1])
                    break
        else:
            open_.append((m[0], len(pieces)))
            pieces.append(m[0])
    return "".join(pieces) + html.escape(text[at:], quote=False)


def to_html(text: str) -> str:
    """Headings, paragraphs, nested lists and quotes; a quote that names a language is code."""
    out: list[str] = []
    lists: list[int] = []
    quote: list[str] | None = None
    language = ""

    def close_lists(depth: int = -1):
        while lists and lists[-1] > depth:
            out.append("</li></ul>")
            lists.pop()

    for line in (text or "").split("\n"):
        bare = line.lstrip()
        if quote is not None:
            if bare.startswith("'''"):
                body = html.escape("\n".join(quote), quote=False)
                out.append(f'<pre><code class="{language}">{body}</code></pre>' if language else f"<blockquote>{body}</blockquote>")
                quote = None
            else:
                quote.append(line)
            continue
        depth = (len(line) - len(bare)) // 3
        if bare.startswith("'''"):
            close_lists()
            quote, language = [], next((x for x in _LANGUAGES if x in bare[3:].lower()), "")
        elif re.match(r"[*-] ", bare):
            if lists and lists[-1] >= depth:
                close_lists(depth)
            if lists and lists[-1] == depth:
                out.append("</li>")
            else:
                out.append("<ul>")
                lists.append(depth)
            out.append("<li>" + inline(bare[2:]))
        else:
            close_lists()
            n = min(5, len(bare) - len(bare.lstrip("#")))
            if n:
                out.append(f"<h{n}>{inline(bare.lstrip('#').strip())}</h{n}>")
            elif bare:
                out.append(f"<p>{inline(bare)}</p>")
    close_lists()
    if quote is not None:
        out.append("<blockquote>" + html.escape("\n".join(quote), quote=False) + "</blockquote>")
    return "".join(out)


def with_html(docs: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def rendered(column: pd.Series) -> pd.Series:
        return column.map(to_html, na_action="ignore")

    return docs.withColumn("html", rendered(F.coalesce(text, F.lit(""))))
