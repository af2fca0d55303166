"""Parts of addresses, names and paths made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .text import contains_any


def url_structure(url: Column) -> Column:
    """struct(domain_structure, has_www, tld, domain_depth, path_structure)."""
    parts = F.split(F.lower(url), "/")
    domain = F.split(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")), r"\.")
    return F.struct(
        domain.alias("domain_structure"), F.array_contains(domain, "www").alias("has_www"),
        F.element_at(domain, -1).alias("tld"), F.size(domain).alias("domain_depth"),
        F.slice(parts, F.lit(4), F.size(parts)).alias("path_structure"),
    )


def host(url: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.lower(url), "/"), F.lit(3)), F.lit(""))


def origin(url: Column) -> Column:
    return F.array_join(F.slice(F.split(url, "/"), 1, 3), "/")


def base_domain(url: Column) -> Column:
    return F.replace(host(url), F.lit("www."), F.lit(""))


def company_of_domain(url: Column) -> Column:
    return F.split_part(base_domain(url), F.lit("."), F.lit(1))


def registrable_domain(url: Column) -> Column:
    parts = F.split(host(url), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")


def ir_candidates(url: Column) -> Column:
    """Addresses at which a company's investor pages may be, likeliest first."""
    d, name = base_domain(url), company_of_domain(url)
    made = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.array(
        made("https://ir.about", name, ".com/"),
        *[made(f"https://{s}.", d, "/") for s in ("investors", "investor", "ir")],
        made("https://corporate.", d, "/investor/"),
        *[made("https://www.", d, f"/{p}/") for p in ("investor", "investors")],
        *[made(f"https://{s}.", d, "/") for s in ("finance", "sec")],
    )


def ir_paths(url: Column) -> Column:
    """The origin with each usual path, then the registrable domain with each usual subdomain."""
    by_path = [F.concat(origin(url), F.lit(p)) for p in P.IR_PATHS]
    by_name = [F.concat(F.lit(f"https://{s}."), registrable_domain(url)) for s in P.IR_SUBDOMAINS]
    return F.array(*by_path, *by_name)


def file_extension(url: Column) -> Column:
    u = F.lower(url)
    return F.when(u.contains(".xlsx"), ".xlsx").when(u.contains(".xls"), ".xls").otherwise(".pdf")


def report_filename(ticker: Column, year: Column, url: Column) -> Column:
    return F.concat(ticker, F.lit("_"), F.translate(year, "_", "-"), F.lit("_financial_report"), file_extension(url))


def text_of_url(url: Column) -> Column:
    return F.translate(F.element_at(F.split(url, "/"), -1), "-_", "  ")


def object_paths(root: Column, ticker: Column, period: Column, name: Column) -> Column:
    """struct of the eight places of a report's files under a root."""
    raw = F.concat_ws("/", root, F.lit("raw"), ticker, period)
    parsed = F.concat_ws("/", root, F.lit("parsed"), ticker, period)
    under = lambda p: F.concat_ws("/", parsed, F.lit(p))
    return F.struct(
        F.concat(raw, F.lit("/"), name, F.lit(".pdf")).alias("raw_pdf"), under("text").alias("text_dir"),
        under("tables").alias("tables_dir"), under("images").alias("images_dir"), under("structured.json").alias("structured_json"),
        under("docling/manifest.json").alias("docling_manifest"), under("manifest.jsonl").alias("manifest_jsonl"),
        F.concat(root, F.lit("/state/"), ticker, F.lit(".json")).alias("state_json"),
    )


def report_paths(url: Column) -> Column:
    """Three segments of the path from each telling segment on, for addresses about reports."""
    parts = F.split(url, "/")
    found = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.size(parts)), lambda i: contains_any(F.lower(F.element_at(parts, i)), P.PATH_SEGMENTS)
        ),
        lambda i: F.array_join(F.slice(parts, i, 3), "/"),
    )
    return F.when(contains_any(F.lower(url), P.PATH_TERMS), found).otherwise(F.array().cast("array<string>"))


def year_path(url: Column) -> Column:
    """The path around the first segment that begins with a year, for files only."""
    parts = F.split(url, "/")
    at = F.try_element_at(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i).rlike(r"^20\d{2}")), F.lit(1)
    )
    start = F.greatest(at - 1, F.lit(1))
    return F.when(
        contains_any(F.lower(url), P.FILE_EXTENSIONS) & at.isNotNull(), F.array_join(F.slice(parts, start, at + 3 - start), "/")
    )
