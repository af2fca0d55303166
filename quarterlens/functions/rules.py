"""Predicates on links, pages and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .text import combined, contains_any


def valid_report_link(url: Column, text: Column, year: int = 2025) -> Column:
    """Whether a link is worth scoring: a file, a report page or a telling text; about results; nothing excluded; recent."""
    u = F.lower(F.coalesce(url, F.lit("")))
    t = F.lower(F.coalesce(text, F.lit("")))
    c = combined(text, url)
    reachable = (
        contains_any(u, P.FILE_EXTENSIONS) | contains_any(u, P.PAGE_PATHS) | contains_any(F.concat(t, u), P.TEXT_INDICATORS)
    )
    quarterly = contains_any(c, P.QUARTERLY_TERMS)
    about = quarterly | contains_any(c, P.ANNUAL_TERMS) | contains_any(c, P.FINANCIAL_TERMS)
    recent = contains_any(c, [str(year), str(year - 1)]) | contains_any(c, P.LATEST_TERMS)
    return (
        F.when(u == "", False)
        .when(~reachable | ~about, False)
        .when(contains_any(c, P.STRICT_EXCLUSIONS), False)
        .otherwise(recent | quarterly)
    )


def financial_report_url(url: Column) -> Column:
    u = F.lower(url)
    return F.coalesce(contains_any(u, P.FILE_EXTENSIONS) & contains_any(u, P.FINANCIAL_URL_WORDS), F.lit(False))


def chart_or_summary(c: Column) -> Column:
    return contains_any(c, P.CHART_TERMS)


def valid_ir_url(url: Column) -> Column:
    u = F.lower(url)
    excluded = contains_any(u, P.IR_EXCLUSIONS)
    return (
        F.when(url.isNull() | u.contains("javascript:"), False)
        .when(~(url.startswith("http://") | url.startswith("https://")), False)
        .when(contains_any(u, P.IR_STRONG) & ~excluded, True)
        .when(contains_any(u, P.IR_WEAK) & ~excluded, ~contains_any(u, P.IR_NEWS))
        .otherwise(False)
    )


def valid_ir_page(title: Column, url: Column, body: Column) -> Column:
    t, u, b = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, url, body))
    by_url = contains_any(u, P.IR_URLS)
    return F.when(contains_any(t, P.IR_DENIED), by_url).otherwise(
        contains_any(t, P.IR_TITLES) | by_url | contains_any(b, P.IR_CONTENT)
    )


def calendar_rejected(url: Column) -> Column:
    u = F.lower(url)
    return contains_any(u, P.CALENDAR_TERMS) & ~contains_any(u, P.CALENDAR_ALLOWED)


def direct_download(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(pdf|xlsx?|docx?)$")


def third_party(url: Column) -> Column:
    return contains_any(F.lower(url), P.THIRD_PARTIES)


def skips_event(c: Column, score: Column) -> Column:
    """Whether a hit counts for stopping a search early: no event page, and a quarter score of 0.3 or more."""
    return ~contains_any(c, P.EVENT_TERMS) & (score >= 0.3)


def recent_fallback(text: Column, url: Column) -> Column:
    return contains_any(F.lower(url), P.FALLBACK_TERMS) & contains_any(F.concat(text, url), ["2024", "2025"])


def sec_section(url: Column, text: Column, year: int = 2025) -> Column:
    """Links of a filings section: valid by their address alone, and current by their text."""
    current = contains_any(F.lower(text), ["2025", "10-q", "10-k", "latest", "recent"])
    return valid_report_link(url, F.lit(""), year) & current


def web_page_instead(url: Column, head: Column) -> Column:
    """Whether a download is a web page and no file: its first characters are a page's, and the address does not look like that of
    a file or a viewer."""
    page = (
        head.startswith("<!DOCTYPE")
        | head.startswith("<html")
        | (F.substring(head, 1, 500).contains("<html") & ~F.substring(head, 1, 100).contains("%PDF"))
    )
    return page & ~contains_any(F.lower(url), P.VIEWER_TERMS)


def page_by_type(content_type: Column) -> Column:
    """Whether the server calls its answer a web page; then nothing of it is read."""
    return contains_any(F.lower(F.coalesce(content_type, F.lit(""))), ["text/html", "application/html"])


def file_problem(name: Column, size: Column, head: Column) -> Column:
    """Why a file is unusable, or null. head: the first 2048 bytes as text (bytes that are no UTF-8 left out)."""
    n, low = F.lower(name), F.lower(head)
    pdf, excel = n.endswith(".pdf"), n.endswith(".xlsx") | n.endswith(".xls")
    zipped = head.startswith("PK\x03\x04")
    return (
        F.when(size < 10_000, "too small")
        .when(pdf & ~head.startswith("%PDF-"), "not a PDF")
        .when(pdf & contains_any(low, P.HTML_MARKS), "web page")
        .when(pdf & contains_any(low, P.ERROR_MARKS), "error page")
        .when(excel & ~zipped, "not a workbook")
        .when(~excel & (size < 50_000), "below minimum")
    )


def file_problem_bytes(name: Column, content: Column) -> Column:
    """file_problem on binary content, old workbooks' header included."""
    head = F.substring(content, 1, 2048)
    n = F.lower(name)
    old = (n.endswith(".xlsx") | n.endswith(".xls")) & (F.hex(F.substring(content, 1, 4)) == "D0CF11E0")
    text = F.try_validate_utf8(head.cast("string"))
    problem = file_problem(name, F.octet_length(content), F.coalesce(text, F.decode(head, "ISO-8859-1")))
    return F.when(old & (F.octet_length(content) >= 10_000), F.lit(None)).otherwise(problem)
