"""Columns over HTML and URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+|[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def title(html: Column, tag: str = "h3") -> Column:
    """Inner text of the first such element; null if there is none or it is blank."""
    inner = strip_space(strip_tags(F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)))
    return F.nullif(inner, F.lit(""))


def paragraphs(html: Column) -> Column:
    """Texts of all p elements, cleaned and joined by a blank; an empty text if there are none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1)
    # typographic quotes become blanks, odd spaces go, newlines become blanks
    clean = F.transform(found, lambda p: F.translate(F.translate(strip_space(strip_tags(p)), "\u201c\u201d\n", "   "), "\u00a0\u2002\u2028", ""))
    return F.array_join(clean, " ")


def links(html: Column) -> Column:
    """href of every link, in order; an a element without one gives the empty string."""
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"<a\b[^>]*>"), 0)
    return F.transform(anchors, lambda a: F.regexp_extract(a, r'href="([^"]*)"', 1))


def host(url: Column) -> Column:
    """The third part between slashes; a port stays with it."""
    return F.split_part(url, F.lit("/"), F.lit(3))


def is_followed(url: Column, hosts: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Plain http, a known host and, where given, a known prefix."""
    ok = url.startswith("http://")
    if hosts:
        ok &= host(url).isin(*hosts)
    if prefixes:
        some = F.lit(False)
        for p in prefixes:
            some |= url.startswith(p)
        ok &= some
    return ok


def is_attachment(url: Column, extensions: Sequence[str]) -> Column:
    """Case-sensitive ending."""
    return url.rlike(rf"\.({'|'.join(extensions)})$")


def file_name(url: Column) -> Column:
    """The last part of the path, URL-decoded."""
    return F.url_decode(F.element_at(F.split(url, "/"), -1))


def url_date(url: Column) -> Column:
    """Date from .../yyyy/MM/dd/name; 0001-01-01 where there is none."""
    parts = F.split(url, "/")
    y, m, d = (F.try_element_at(parts, F.lit(k)) for k in (-4, -3, -2))
    made = F.when(y.rlike(r"^\d{4}$"), F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date"))
    return F.coalesce(made, F.lit("0001-01-01").cast("date"))
