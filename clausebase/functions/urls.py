"""Addresses, links and page titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html
from .dates import let

# fixed values: document types and link rules
DOC_TYPES = ("pdf", "doc", "docx", "xls", "xlsx")
MENU_PAGE = "view_section.jsp"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_document_link(url: Column) -> Column:
    return F.lower(url_path(url)).rlike(r"\.(" + "|".join(DOC_TYPES) + ")$")


def doc_type(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(url_path(url)), r"\.(" + "|".join(DOC_TYPES) + ")$", 1), F.lit("")), F.lit("unknown"))


def menu_id(url: Column) -> Column:
    """The first id parameter of the query, decoded; null if there is none."""
    raw = F.nullif(F.regexp_extract(url, r"\?(?:[^#]*?&)?id=([^&#]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def in_scope(own: Column, root: str) -> Column:
    return (own == root) | F.startswith(own, F.lit(root + ","))


def normal_scheme(url: Column, https_only: Sequence[str] = ()) -> Column:
    """http to https on hosts that no longer answer http."""
    host = F.lower(F.regexp_extract(url, r"^http://([^/:?#]*)", 1))
    return F.when(host.isin(*https_only), F.concat(F.lit("https"), F.substring(url, 5, F.length(url)))).otherwise(url) if https_only else url


def skipped(href: Column) -> Column:
    return (href == "") | F.startswith(href, F.lit("javascript:")) | F.startswith(href, F.lit("#"))


def resolved(base: Column, href: Column) -> Column:
    """Absolute address of a link: absolute, scheme-relative, root-relative, query, or relative with dot segments."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    joined = F.when(F.startswith(href, F.lit("/")), F.regexp_extract(href, r"^([^?#]*)", 1)).otherwise(F.concat(folder, F.regexp_extract(href, r"^([^?#]*)", 1)))
    parts = F.split(joined, "/")
    zero = F.array().cast("array<string>")
    steps = F.aggregate(F.slice(parts, 2, F.size(parts)), zero, lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    ends = F.when(joined.rlike(r"/\.\.?$"), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .otherwise(F.concat(origin, F.lit("/"), F.array_join(ends, "/"), tail))
    )


def links(page: Column) -> Column:
    """array<struct<href, text>> of the anchors with an href that is followed; null for a null page."""
    return F.filter(html.anchors(page), lambda x: ~skipped(x["href"]))


def page_title(page: Column, own_id: Column, decoded: bool = True) -> Column:
    """The title, else the first heading of level 1 or 2, else ``section-`` and the id; with its character references as written if not decoded."""

    def of(text: Column) -> Column:
        inner = [F.nullif(html.plain_text(F.regexp_extract(text, pattern, 1), decoded), F.lit("")) for pattern in (r"(?is)<title(?=[\s>])[^>]*+>(.*?)</title>", r"(?is)<h[12](?=[\s>])[^>]*+>(.*?)</h[12]>")]
        return F.coalesce(*inner)

    return F.coalesce(let(html.spoken(page), of), F.concat(F.lit("section-"), own_id))
