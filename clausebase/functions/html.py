"""HTML as column expressions: markup, anchors, character references.

The patterns consume tags, comments and scripts whole and possessively, so that
a page is read in one linear pass and no repeated group recurses.

Rules for broken pages: a comment, script or style that isn't closed runs to the
end of the page; so does a tag that isn't closed, and both say nothing.  A quote
that isn't closed ends with its tag.  An anchor without ``</a>`` ends where the
next one begins or an element closes that was opened before it.  Of several
``href`` of one tag the last counts.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let

#: The rest of a tag after the first letter of its name, without the closing bracket.
BODY = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
TAG = rf"</?[a-z]{BODY}>"
SILENT = rf"(?is)<!--(?:-?>|.*?--!?>|.*+)|<(script|style)(?=[\s/>]){BODY}>(?:.*?</\1(?=[\s/>])[^>]*+>|.*+)|({TAG})|</?[a-z].*+|<[!?/][^>]*+>?+"
ANCHORS = rf"(?is)<a(?=[\s/>])({BODY})>((?:[^<]++|(?!</?a[\s/>]){TAG})*+)|{TAG}|[^<]++"
TOKEN = rf"(?is){TAG}|[^<]++"
ATTRIBUTE = r"""(?is)[^\s=/>][^\s=/>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
VALUE = r"""(?is)=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
REFERENCE = r"&#[xX][0-9a-fA-F]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+[;=]?+|[^&]++|&"
# fixed values: elements without an end tag
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Letters of the longest name that counts without its semicolon, and digits of the highest code point.
LONGEST, HEX_DIGITS, DIGITS = max(len(n) for n in html.entities.html5 if not n.endswith(";")), 6, 7


def _map(pairs: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a code point as HTML reads it: Windows names for 128 to 159, nothing for controls and non-characters, the replacement character for what is none."""
    low = _map({str(n): html.unescape(f"&#{n};") for n in range(160)})
    silent = ((code >= 0xFDD0) & (code <= 0xFDEF)) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(code < 160, F.try_element_at(low, code.cast("string")))
        .when(((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF), F.lit("�"))
        .when(silent, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def unescaped(text: Column, attribute: bool = False) -> Column:
    """text with its character references decoded, numbered and named ones.

    A name without its semicolon counts if it is one of the old names, also at
    the begin of a longer word; in an attribute only if neither a letter, a
    digit nor ``=`` follows.
    """
    names = _map(html.entities.html5)

    def named(x: Column) -> Column:
        word = F.regexp_replace(x, "^&|=$", "")
        found = F.try_element_at(names, word)
        if attribute:
            return F.when(F.endswith(x, F.lit("=")), x).otherwise(F.coalesce(found, x))
        starts = [F.when(F.length(word) >= n, F.concat(F.try_element_at(names, F.substring(word, 1, n)), F.substring(x, n + 2, F.length(x)))) for n in range(LONGEST, 1, -1)]
        return F.coalesce(F.when(~F.endswith(x, F.lit("=")), found), *starts, x)

    def numbered(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?0*+([0-9a-fA-F]*+)", 1)
        hexadecimal = F.lower(F.substring(x, 3, 1)) == "x"
        long = F.length(digits) > F.when(hexadecimal, HEX_DIGITS).otherwise(DIGITS)
        value = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)
        code = F.when(digits == "", 0).when(long, 0x110000).otherwise(value.cast("int"))
        return let(code, _character)

    one = lambda x: F.when(~F.startswith(x, F.lit("&")) | (x == "&"), x).when(F.startswith(x, F.lit("&#")), numbered(x)).otherwise(named(x))
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one), ""))


def spoken(page: Column) -> Column:
    """A page without comments, declarations, scripts and styles; every ``<`` left begins a whole tag."""
    return F.regexp_replace(F.regexp_replace(page, "<(?![A-Za-z/!?])", "&lt;"), SILENT, "$2")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def plain_text(markup: Column, decoded: bool = True) -> Column:
    """Text of markup without silent parts: tags count as spaces, references are decoded, runs of spaces are one."""
    text = F.regexp_replace(markup, f"(?is){TAG}", " ")
    return squeezed(unescaped(text) if decoded else text)


def _end(tokens: Column) -> Column:
    """How many of an anchor's tokens stand before the first end tag of an element that none of them opened."""
    start = F.struct(F.lit("/").alias("open"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^</?([A-Za-z][^\s/>]*+)", 1))
        to = lambda stack, done: F.struct(stack.alias("open"), F.when(done, s["n"]).otherwise(s["n"] + 1).alias("n"), done.alias("done"))

        def closed(at: Column) -> Column:
            return to(F.when(at > 0, F.substring(s["open"], at + F.length(name) + 1, F.length(s["open"]))).otherwise(s["open"]), at == 0)

        silent = ~F.startswith(x, F.lit("<")) | name.isin(*VOID) | (F.endswith(x, F.lit("/>")) & ~F.startswith(x, F.lit("</")))
        opened = to(F.concat(F.lit("/"), name, s["open"]), F.lit(False))
        return F.when(s["done"], s).when(silent, to(s["open"], F.lit(False))).when(F.startswith(x, F.lit("</")), let(F.instr(s["open"], F.concat(F.lit("/"), name, F.lit("/"))), closed)).otherwise(opened)

    return F.aggregate(tokens, start, step)["n"]


def anchors(page: Column) -> Column:
    """array<struct<href, text>> of the anchors with an href, in order; null for a null page."""

    def label(inner: Column) -> Column:
        said = lambda tokens: let(_end(tokens), lambda n: F.array_join(F.filter(tokens, lambda x, i: (i < n) & ~F.startswith(x, F.lit("<"))), " "))
        raw = F.when(F.contains(inner, F.lit("<")), let(F.regexp_extract_all(inner, F.lit(TOKEN), F.lit(0)), said)).otherwise(inner)
        return squeezed(unescaped(raw))

    def one(a: Column) -> Column:
        own = F.filter(F.regexp_extract_all(a["attributes"], F.lit(ATTRIBUTE), F.lit(0)), lambda x: x.rlike(r"(?i)^href(?:\s*+=|$)"))
        href = let(F.try_element_at(own, F.lit(-1)), lambda x: F.concat(*[F.regexp_extract(x, VALUE, k) for k in (1, 2, 3)]))
        return F.struct(let(href, lambda h: F.regexp_replace(unescaped(h, attribute=True), r"(?U)^\s+|\s+$", "")).alias("href"), label(a["inner"]).alias("text"))

    def of(text: Column) -> Column:
        found = [F.regexp_extract_all(text, F.lit(ANCHORS), F.lit(k)) for k in (1, 2)]
        zipped = F.filter(F.arrays_zip(found[0].alias("attributes"), found[1].alias("inner")), lambda a: a["attributes"] != "")
        return F.filter(F.transform(zipped, one), lambda a: a["href"].isNotNull())

    return let(spoken(page), of)
