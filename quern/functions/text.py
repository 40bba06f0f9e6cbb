"""Functions on texts and pages, all of them column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The range of the characters that are kept beside letters, blanks and line ends.
CJK = r"\x{3192}-\x{FABF}"


def clean(text: Column) -> Column:
    """Only letters A-Z and a-z, blanks, line ends and U+3192 to U+FABF; all else goes without leaving a gap. Null stays null."""
    return F.regexp_replace(text, F.lit(f"[^A-Za-z \n{CJK}]"), F.lit(""))


def without_elements(html: Column, tags: Sequence[str] = ("script", "style")) -> Column:
    """The html without these elements and their content; one that isn't closed reaches to the end. Names are case-sensitive."""
    for tag in tags:
        html = F.regexp_replace(html, F.lit(rf"(?s)<{tag}[^>]*>.*?(?:</{tag}>|\z)"), F.lit(""))
    return html


def strip_html(html: Column, tags: Sequence[str] = ("script", "style")) -> Column:
    """clean of the text between tags, without line ends; adjacent tags join text, entities leave their letters."""
    return F.regexp_replace(F.regexp_replace(without_elements(html, tags), F.lit("<[^>]*>"), F.lit("")), F.lit(f"[^A-Za-z {CJK}]"), F.lit(""))


def page_text(html: Column) -> Column:
    """Text between tags with its line ends, without script and style."""
    return F.regexp_replace(without_elements(html), F.lit("<[^>]*>"), F.lit(""))


def tags_to_lines(html: Column) -> Column:
    """As page_text, but each tag becomes a line end, so that blocks of the page are parted."""
    return F.regexp_replace(without_elements(html), F.lit("<[^>]*>"), F.lit("\n"))


def title(html: Column) -> Column:
    """What the title element holds; null where there is none or it is empty."""
    t = F.regexp_extract(html, "<title[^>]*>([^<]*)<", 1)
    return F.when(F.length(t) > 0, t)


# The endings of the links that strict extraction takes.
LINK_ENDINGS = ("cn", "com", "net", "org", "cx", "wang", "cc", "xin", "top", "html", "htm")
STRICT_LINK = rf"""<a[^>]href=["']([^ ]+(?:{"|".join(LINK_ENDINGS)})|[^ ]tech)["']"""
ANY_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'<>]*)["']"""


def links(html: Column, strict: bool = False) -> Column:
    """The links of a page in order, as an array: any href of an a element, or by the strict pattern."""
    return F.regexp_extract_all(html, F.lit(STRICT_LINK if strict else ANY_LINK), F.lit(1))


def percent_decoded(text: Column) -> Column:
    """`+` to a blank and %XX, of either case, to bytes; an escape that is cut or no hex stays as it is."""
    return F.try_url_decode(F.regexp_replace(text, F.lit("%(?![0-9A-Fa-f]{2})"), F.lit("%25")))


def parameter(request: Column) -> Column:
    """Everything after the first `=`; null where there is none."""
    return F.when(F.instr(request, "=") > 0, F.regexp_extract(request, "(?s)^[^=]*=(.*)$", 1))


def snippet(text: Column, pos: Column, before: int = 100, after: int = 50) -> Column:
    """The characters from `before` ahead of pos to `after` behind it, as far as there are any."""
    start = F.greatest(pos - before, F.lit(0))
    return F.substring(text, start + 1, pos + after + 1 - start)


def byte_snippet(text: Column, pos: Column, before: int = 100, after: int = 50) -> Column:
    """As snippet, with pos taken for a byte of the UTF-8 text: broken characters at either end are left out."""
    data = F.encode(text, "UTF-8")
    start = F.greatest(pos - before, F.lit(0))
    part = F.hex(F.substring(data, start + 1, pos + after + 1 - start))
    whole = F.regexp_replace(part, F.lit("^(?:[89AB][0-9A-F])+"), F.lit(""))
    for lead, size in (("[CD][0-9A-F]", 1), ("E[0-9A-F]", 2), ("F[0-9A-F]", 3)):
        whole = F.regexp_replace(whole, F.lit(rf"^((?:[0-9A-F]{{2}})*?){lead}(?:[89AB][0-9A-F]){{0,{size - 1}}}$"), F.lit("$1"))
    return F.decode(F.unhex(whole), "UTF-8")


def id_key(page_id: Column) -> Column:
    """The page id padded with blanks to ten characters."""
    return F.rpad(page_id.cast("string"), 10, " ")


def idf(df: Column, pages: float = 100) -> Column:
    """log2(pages / df): negative for words in more pages than that."""
    return F.log2(F.lit(float(pages)) / df)
