"""DuckDB SQL for the registered queries, written from the rules themselves."""

from __future__ import annotations

from .. import params as P
from . import lists as W

SQL: dict[str, str] = {}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(c: str, words) -> str:
    """Whether one of the words is in the text."""
    return "(" + " OR ".join(f"contains({c}, {quote(w)})" for w in words) + ")"


def case(pairs, otherwise: str) -> str:
    return "(CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END)"


LINKS = """report_links AS (
  SELECT o_orderkey AS link_id, c_custkey % 30 AS company_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Earnings Release' WHEN '2-HIGH' THEN 'Form 10-Q'
         WHEN '3-MEDIUM' THEN 'Quarterly Revenue Trend' WHEN '4-NOT SPECIFIED' THEN 'Annual Report'
         ELSE 'Governance Charter' END
    || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' Q' || quarter(o_orderdate) || ' ' || (year(o_orderdate)+24) END AS text,
    'https://' || CASE o_orderstatus WHEN 'F' THEN 's2.q4cdn.com' WHEN 'O' THEN 'investors.example.com' ELSE 'www.example.com' END
    || '/' || (year(o_orderdate)+24) || '/q' || quarter(o_orderdate) || '/doc-' || o_orderkey
    || CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.PDF' ELSE '.html' END AS url
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
TICKERS = "[" + ", ".join(quote(c[0]) for c in P.COMPANIES) + "]"
L = (
    f"WITH {LINKS}, l AS (SELECT *, lower(text) AS t, lower(url) AS u, lower(text || ' ' || url) AS c, "
    f"{TICKERS}[(company_id + 1)::INT] AS ticker FROM report_links) "
)

VALID = case(
    [
        (f"NOT ({has('u', W.FILE_EXTENSIONS)} OR {has('u', W.PAGE_PATHS)} OR {has('(t || u)', W.TEXT_INDICATORS)})", "false"),
        (f"NOT ({has('c', W.QUARTERLY_TERMS)} OR {has('c', W.ANNUAL_TERMS)} OR {has('c', W.FINANCIAL_TERMS)})", "false"),
        (has("c", W.STRICT_EXCLUSIONS), "false"),
    ],
    f"({has('c', ['2025', '2024', *W.LATEST_TERMS])} OR {has('c', W.QUARTERLY_TERMS)})",
)
CHART = has("c", W.CHART_TERMS)

# classification
YEAR = case([(has("c", [str(y)]), y) for y in W.YEARS], "2025")
ANNUAL = has("c", ["annual", "10-k"])
QUARTER = case([*[(has("c", w), q) for q, w in W.QUARTER_WORDS], (ANNUAL, 4)], "NULL")
TYPE = case([(has("c", ["10-q", "q1", "q2", "q3", "quarterly"]), "'quarterly'"), (ANNUAL, "'annual'")], "'quarterly'")
CLASSED = (
    f"{L}, k AS (SELECT *, {YEAR} AS y, {QUARTER} AS q, {TYPE} AS type, {has('c', W.REPORT_WORDS)} AS isreport FROM l), "
    "cl AS (SELECT *, CASE WHEN y >= 2025 THEN CASE q WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 1.1 WHEN 2 THEN 1.2 WHEN 1 THEN 1.3 ELSE 10.0 END "
    "WHEN y = 2024 THEN 2.0 + (4 - coalesce(q, 4)) * 0.1 ELSE 5.0 END + CASE WHEN type = 'annual' THEN 0.5 ELSE 0.0 END AS priority, "
    "y >= 2025 AND coalesce(q IN (3, 4), false) AS latest, "
    "CASE WHEN q IS NULL THEN y || '_latest' WHEN q = 4 AND type = 'annual' THEN y || '_Q4_Annual' ELSE y || '_Q' || q END "
    "|| CASE WHEN y >= 2025 AND coalesce(q IN (3, 4), false) THEN '_LATEST_EXPECTED' ELSE '' END AS label FROM k)"
)

# scores
BONUS = case([(has("c", W.SUPER_STRONG), "0.5"), (has("c", W.STRONG), "0.3"), (has("c", W.MEDIUM), "0.1")], "0.0")
BEST = "greatest(" + ", ".join(f"CASE WHEN {has('c', w)} THEN {x} ELSE 0.0 END" for w, x in W.QUARTER_WEIGHTS) + ")"
PRIORITY = case(
    [
        (f"NOT {has('c', W.FISCAL_YEARS)}", "0.0"), (CHART, "0.05"), (f"{BEST} > 0", f"{BEST} * 0.8 + {BONUS}"),
        (has("c", ["earning", "quarterly", "10-q"]), f"0.6 + {BONUS}"),
    ],
    "0.2",
)
_DAYS = "(CASE WHEN {m} = 2 THEN 28 WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END)"


def _later() -> str:
    month = "(CASE WHEN contains(c, 'oct') THEN 10 WHEN contains(c, 'nov') THEN 11 ELSE 12 END)"
    parts = []
    for w in ("oct(?:ober)?", "november", "december"):
        found = f"regexp_extract_all(c, '{w}\\s+(\\d{{1,2}}),?\\s+2025', 1)"
        parts.append(f"len([d for d in {found} if d::INT BETWEEN 1 AND {_DAYS.format(m=month)} AND {month} * 100 + d::INT > 1009]) > 0")
    m, d = "split_part(x, '/', 1)::INT", "split_part(x, '/', 2)::INT"
    pairs = "regexp_extract_all(c, '(\\d{1,2}/\\d{1,2})/2025', 1)"
    parts.append(f"len([x for x in {pairs} if {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND {_DAYS.format(m=m)} AND {m} * 100 + {d} > 1009]) > 0")
    return "(" + " OR ".join(parts) + ")"


def availability(score: str) -> str:
    return case(
        [
            (_later(), f"{score} * 0.1"), (f"contains(c, 'q3') AND contains(c, '2025') AND {has('c', ['conference', 'call'])}", f"{score} * 0.2"),
            (has("c", [".ics", "calendar"]), f"{score} * 0.3"), ("contains(c, 'q4') AND contains(c, '2025')", f"{score} * 0.95"),
            (f"{has('c', ['earnings-call', 'conference-call', 'webcast', 'event-details'])} AND contains(c, 'event')", f"{score} * 0.3"),
            (f"contains(c, '2024') AND {has('c', ['q4', 'fourth quarter', '10-k', 'annual'])}", f"{score} * 0.7"), ("contains(c, '2024')", f"{score} * 0.4"),
        ],
        score,
    )


_YEAR_BONUS = case([("contains(c, '2025')", "0.5"), ("contains(c, '2024')", "0.2"), ("contains(c, '2023')", "0.05")], "0.0")
TOTAL = "least(" + " + ".join([
    PRIORITY, _YEAR_BONUS, _YEAR_BONUS, case([(has("c", [w]), x) for w, x in W.OCTOBER_QUARTERS], "0.0") + " * 0.2",
    case([(has("c", ["earning", "quarterly", "10-q"]), "0.3"), (has("c", ["10-k", "annual"]), "0.15")], "0.0"),
    case([("contains(u, '.pdf')", "0.1"), (has("u", [".xlsx", ".xls"]), "0.05")], "0.0"),
    case([(has("c", ["latest", "recent", "current", "new"]), "0.2")], "0.0"), case([("contains(c, '25')", "0.25")], "0.0"),
]) + ", 1.0)"
SCORE = availability(f"({TOTAL})::DOUBLE")


def final(score: str, strategy: str) -> str:
    bonus = case([(f"{strategy} = {quote(s)}", b) for s, b in W.STRATEGY_BONUS], "0.0")
    return f"least({score} + {bonus} + greatest(0.0, (6 - priority) * 0.1), 1.0)"


KEYWORD = f"0.8 + CASE WHEN {has('t', ['2025'])} OR {has('u', ['2025'])} THEN 0.1 ELSE 0.0 END + CASE WHEN contains(u, 'pdf') THEN 0.1 ELSE 0.0 END"
CONFIDENCE = "least(" + " + ".join(
    f"CASE WHEN contains(t, {quote(w)}) OR contains(u, {quote(w)}) THEN {x} ELSE 0.0 END" for x, ws in W.IR_CONFIDENCE for w in ws
) + ", 1.0)"


def one(when: str, n) -> str:
    return f"CASE WHEN {when} THEN {n} ELSE 0 END"


PDF = " + ".join([
    one("contains(u, lower(ticker))", 10), *[one(f"contains(u, '{w}') OR contains(t, '{w}')", 5) for w in W.PDF_TERMS],
    case([("contains(c, '2025')", 3), ("contains(c, '2024')", 1)], "0"), *[one(f"contains(u, '{w}')", 2) for w in W.PDF_DOMAINS],
]) + " - " + " - ".join(one(f"contains(t, '{w}')", 1) for w in W.PDF_GENERIC)
CHOICE = " + ".join([
    one(f"contains(u, lower(ticker)) OR {has('u', ['investor', 'earnings'])}", 3), one(f"{has('u', ['earnings', 'financial', 'report', '10-q'])} OR {has('t', ['earnings', 'financial', 'report', '10-q'])}", 2),
    one(f"{has('u', ['presentation', 'press release'])} OR {has('t', ['presentation', 'press release'])}", 1), case([("contains(c, '2025')", 2), ("contains(c, '2024')", 1)], "0"),
    one(f"{has('u', ['q1', 'q2', 'q3', 'q4', 'quarterly'])} OR {has('t', ['q1', 'q2', 'q3', 'q4', 'quarterly'])}", 1), one(has("u", ["q4cdn", "ir.", "investors."]), 1),
]) + " - " + one(has("t", ["download", "view", "click here"]), 1)
FINANCIAL_URL = f"{has('u', W.FILE_EXTENSIONS)} AND {has('u', W.FINANCIAL_URL_WORDS)}"


def ir_url(u: str, raw: str) -> str:
    excluded = has(u, W.IR_EXCLUSIONS)
    return case(
        [
            (f"{raw} IS NULL OR contains({u}, 'javascript:')", "false"), (f"NOT ({raw} LIKE 'http://%' OR {raw} LIKE 'https://%')", "false"),
            (f"{has(u, W.IR_STRONG)} AND NOT {excluded}", "true"), (f"{has(u, W.IR_WEAK)} AND NOT {excluded}", f"NOT {has(u, W.IR_NEWS)}"),
        ],
        "false",
    )


STRIP = r"regexp_replace({0}, '^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$', '', 'g')"

# scans and predicates
_values = ", ".join(f"({i}, {quote(a)}, {quote(b)}, {quote(c)})" for i, (a, b, c) in enumerate(P.COMPANIES))
SQL["company_scan"] = f"SELECT ord, ticker, name, website, count(*) AS n_customers FROM (VALUES {_values}) v(ord, ticker, name, website) JOIN customer ON c_custkey % 30 = ord GROUP BY ALL"
SQL["company_subset"] = f"SELECT ticker, website, count(*) AS n_customers FROM (VALUES {_values}) v(ord, ticker, name, website) JOIN customer ON c_custkey % 30 = ord WHERE ticker IN ('AAPL', 'MSFT', 'V') GROUP BY ALL"
SQL["valid_links"] = f"{L} SELECT link_id FROM l WHERE {VALID}"
SQL["financial_report_links"] = f"{L} SELECT link_id FROM (SELECT link_id, replace(u, '/doc-', '/report-') AS u FROM l WHERE link_id % 3 > 0) WHERE {FINANCIAL_URL}"
SQL["chart_links"] = f"{L} SELECT link_id FROM l WHERE {CHART}"
_ir = "(url || '/investors/' || page_id)"
SQL["ir_url_valid"] = f"SELECT page_id, {ir_url(f'lower({_ir})', _ir)} AS valid FROM pages"
SQL["ir_page_valid"] = f"""WITH p AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS ti, lower(url) AS u, lower(html) AS b FROM pages)
SELECT page_id, CASE WHEN {has('ti', W.IR_DENIED)} THEN {has('u', W.IR_URLS)} ELSE {has('ti', W.IR_TITLES)} OR {has('u', W.IR_URLS)} OR {has('b', W.IR_CONTENT)} END AS valid FROM p"""
SQL["calendar_reject"] = f"{L} SELECT link_id FROM l WHERE link_id % 3 = 0 AND NOT {has('u', W.CALENDAR_ALLOWED)}"
SQL["direct_download"] = rf"{L} SELECT link_id FROM l WHERE regexp_matches(u, '\.(pdf|xlsx?|docx?)$')"
SQL["third_party_links"] = f"{L} SELECT link_id FROM l WHERE link_id % 7 = 0 AND contains(u, 'www.example.com')"
SQL["early_stop_hits"] = f"{L} SELECT link_id FROM l WHERE NOT {has('u', W.EVENT_TERMS)} AND {PRIORITY} >= 0.3"
SQL["fallback_links"] = f"{L} SELECT link_id FROM l WHERE {has('u', W.FALLBACK_TERMS)} AND {has('(text || url)', ['2024', '2025'])}"
_valid_by_url = VALID.replace("(t || u)", "u").replace("(c,", "(u,")
SQL["sec_links"] = f"{L} SELECT company_id, min(link_id) AS link_id FROM l WHERE {_valid_by_url} AND {has('t', ['2025', '10-q', '10-k', 'latest', 'recent'])} GROUP BY 1"
SQL["file_validity"] = f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pdf' WHEN doc_id % 3 = 0 THEN 'xlsx' ELSE 'docx' END AS e,
  CASE WHEN doc_id % 4 = 0 THEN '%PDF-1.7 ' || text ELSE text END AS b FROM documents),
g AS (SELECT *, strlen(b) AS n, lower(substring(b, 1, 2048)) AS h FROM f)
SELECT doc_id, CASE WHEN n < 10000 THEN 'too small' WHEN e = 'pdf' AND b NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'not a PDF' WHEN e = 'pdf' AND {has('h', W.HTML_MARKS)} THEN 'web page'
  WHEN e = 'pdf' AND {has('h', W.ERROR_MARKS)} THEN 'error page' WHEN e = 'xlsx' THEN 'not a workbook' WHEN e <> 'xlsx' AND n < 50000 THEN 'below minimum' ELSE 'ok' END AS problem FROM g""".replace("\\\\", "\\")

# classification and scores
SQL["classify_links"] = f"""{CLASSED} SELECT link_id, CASE WHEN isreport THEN round(priority, 6) END AS priority, CASE WHEN isreport THEN label END AS label, CASE WHEN isreport THEN type END AS type,
CASE WHEN isreport THEN y END AS year, CASE WHEN isreport THEN q END AS quarter, CASE WHEN isreport THEN latest END AS is_latest_expected FROM cl"""
_INFO = (
    f"{L}, d AS (SELECT *, {case([(has('c', [str(y)]), y) for y in (2025, 2024, 2023)], 'NULL')} AS year, "
    f"{case([(f'regexp_matches(c, {quote(p)})', q) for p, q in W.LEGACY_QUARTERS], 'NULL')} AS quarter, "
    f"{has('c', W.LEGACY_EARNINGS)} AS is_earnings, {ANNUAL} AS is_annual FROM l)"
)
SQL["date_info"] = f"{_INFO} SELECT link_id, year, quarter, is_earnings, is_annual FROM d"
SQL["classify_links_legacy"] = f"""{_INFO} SELECT link_id,
CASE WHEN NOT is_earnings THEN NULL WHEN year = 2025 THEN CASE WHEN quarter IS NOT NULL THEN round(1 + (4 - quarter) * 0.1, 6)::DOUBLE WHEN is_annual THEN 2 ELSE 3 END
  WHEN year = 2024 THEN CASE WHEN coalesce(quarter = 4, false) OR is_annual THEN 4 WHEN quarter IS NOT NULL THEN round(5 + (4 - quarter) * 0.1, 6)::DOUBLE ELSE 6 END ELSE 8 END AS priority,
CASE WHEN NOT is_earnings THEN NULL WHEN year = 2025 THEN CASE WHEN quarter IS NOT NULL THEN '2025_Q' || quarter WHEN is_annual THEN '2025_annual' ELSE '2025' END
  WHEN year = 2024 THEN CASE WHEN coalesce(quarter = 4, false) OR is_annual THEN '2024_Q4_annual' WHEN quarter IS NOT NULL THEN '2024_Q' || quarter ELSE '2024' END ELSE coalesce(year::VARCHAR, 'older') END AS label,
CASE WHEN NOT is_earnings THEN NULL WHEN year = 2025 THEN CASE WHEN quarter IS NULL AND is_annual THEN 'annual' ELSE 'quarterly' END
  WHEN year = 2024 THEN CASE WHEN coalesce(quarter = 4, false) OR is_annual THEN 'annual' ELSE 'quarterly' END WHEN is_annual THEN 'annual' ELSE 'quarterly' END AS type FROM d"""
for _name, _x in (("quarter_priority", PRIORITY), ("content_bonus", BONUS), ("availability_adjust", availability("1.0::DOUBLE")), ("comprehensive_score", SCORE), ("keyword_score", KEYWORD), ("ir_confidence", CONFIDENCE)):
    SQL[_name] = f"{L} SELECT link_id, round(({_x})::DOUBLE, 6) AS score FROM l"
_names = "[" + ", ".join(quote(s) for s, _ in W.STRATEGY_BONUS) + ", 'whole_page_scan']"
SQL["final_score"] = f"{CLASSED}, s AS (SELECT *, {_names}[link_id % 5 + 1] AS strategy, {SCORE} AS score FROM cl WHERE isreport) SELECT link_id, strategy, round({final('score', 'strategy')}, 6) AS score FROM s"
SQL["pdf_link_score"] = f"{L} SELECT link_id, ({PDF})::BIGINT AS score, ({CHOICE})::BIGINT AS choice_score FROM l"

# ranking
SQL["best_report_per_company"] = f"""{CLASSED}, s AS (SELECT *, {SCORE} AS score FROM cl WHERE isreport AND {VALID}), f AS (SELECT *, {final('score', "'comprehensive_scan'")} AS final_score FROM s)
SELECT company_id, link_id, url, label, type, round(score, 6) AS score, round(final_score, 6) AS final_score FROM f
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY round(final_score, 12) DESC, link_id) = 1"""
_own_words = ["investor", "earnings", "q4cdn", "ir.", "financial", "quarterly"]
SQL["best_pdf_per_company"] = f"""{L}, p AS (SELECT company_id, link_id, NOT {has('u', W.THIRD_PARTIES)} AND ({has('u', _own_words)} OR {has('t', _own_words)} OR contains(u, lower(ticker)) OR contains(t, lower(ticker))) AS own,
({CHOICE})::BIGINT AS score FROM l WHERE contains(u, '.pdf'))
SELECT company_id, link_id, own, score FROM p QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY own DESC, score DESC, link_id) = 1"""
SQL["top_links_per_company"] = f"""{L}, x AS (SELECT company_id, link_id, replace(url, '/doc-', '/investors/') AS url, text FROM l), y AS (SELECT *, lower(text) AS t, lower(url) AS u FROM x),
z AS (SELECT *, {CONFIDENCE} AS s FROM y), w AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY s DESC, link_id) AS place FROM z QUALIFY place <= 3)
SELECT company_id, arg_min(link_id, place) AS link_id, count(*) AS n FROM w WHERE {ir_url('u', 'url')} GROUP BY 1"""
_page = " OR ".join(f"contains(t, {quote(w)}) OR contains(u, {quote(w.replace(' ', '-'))}) OR contains(t, {quote(w.replace(' ', ''))})" for w in W.PAGE_INDICATORS)
SQL["dedup_url_keep_first"] = f"{L} SELECT company_id, regexp_replace(url, '/doc-[0-9]+', '/doc', 'g') AS place, min(link_id) AS link_id FROM l GROUP BY 1, 2"

# addresses
_HOST = "lower(split_part(url, '/', 3))"
SQL["url_structure"] = f"""SELECT page_id, {_HOST} AS domain, list_contains(string_split({_HOST}, '.'), 'www') AS has_www, string_split({_HOST}, '.')[-1] AS tld,
len(string_split({_HOST}, '.'))::INT AS domain_depth, array_to_string(string_split(lower(url), '/')[4:], '/') AS path FROM pages"""
_BASE = f"replace({_HOST}, 'www.', '')"
_REG = f"array_to_string(string_split({_HOST}, '.')[-2:], '.')"
_ORIGIN = "(split_part(url, '/', 1) || '//' || split_part(url, '/', 3))"
SQL["base_domain"] = f"SELECT page_id, {_BASE} AS domain, split_part({_BASE}, '.', 1) AS company, {_ORIGIN} AS origin, {_REG} AS registrable FROM pages"
_cands = [f"'https://ir.about' || split_part({_BASE}, '.', 1) || '.com/'", *[f"'https://{s}.' || {_BASE} || '/'" for s in ("investors", "investor", "ir")],
          f"'https://corporate.' || {_BASE} || '/investor/'", *[f"'https://www.' || {_BASE} || '/{p}/'" for p in ("investor", "investors")],
          *[f"'https://{s}.' || {_BASE} || '/'" for s in ("finance", "sec")], *[f"{_ORIGIN} || '{p}'" for p in W.IR_PATHS], *[f"'https://{s}.' || {_REG}" for s in W.IR_SUBDOMAINS]]
SQL["ir_url_candidates"] = " UNION ALL ".join(f"SELECT page_id, {i} AS ord, {c} AS candidate FROM pages" for i, c in enumerate(_cands))
SQL["text_of_url"] = f"{L} SELECT link_id, replace(replace(string_split(url, '/')[-1], '-', ' '), '_', ' ') AS text FROM l"
SQL["path_frequency"] = f"""{L}, x AS (SELECT string_split(regexp_replace(url, '/doc-[0-9]+', '/annual-report', 'g') || '/x', '/') AS p FROM l), y AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM x)
SELECT array_to_string(p[i:i+2], '/') AS path, count(*) AS n FROM y WHERE {has('lower(p[i])', W.PATH_SEGMENTS)} GROUP BY 1"""
SQL["year_paths"] = f"""{L}, x AS (SELECT link_id, u, string_split(url, '/') AS p FROM l), y AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: regexp_matches(p[i], '^20\\d{{2}}'))[1] AS i FROM x)
SELECT link_id, CASE WHEN i IS NOT NULL AND {has('u', W.FILE_EXTENSIONS)} THEN array_to_string(p[greatest(i - 1, 1):i+2], '/') END AS path FROM y"""
_dates = "flatten([" + ", ".join(f"regexp_extract_all(b, {quote('(?i)' + p)})[1:10]" for p in W.DATE_PATTERNS) + "])"
SQL["date_strings"] = f"""{L}, x AS (SELECT link_id, text || ' on 3/4/2025, July 31, 2025 and 2024-05-06; fy 2025 ' || link_id AS b FROM l), y AS (SELECT link_id, {_dates} AS d FROM x)
SELECT link_id, array_to_string(d, '|') AS dates, array_to_string(list_reverse_sort(list_distinct(d))[1:5], '|') AS latest FROM y"""

# periods
_TITLES = """t AS (SELECT o_orderkey, year(o_orderdate) + 24 AS y, quarter(o_orderdate) AS q, o_orderkey % 9 AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS published FROM orders),
ti AS (SELECT *, CASE k WHEN 0 THEN 'Results Q' || q || ' ' || y WHEN 1 THEN ['first', 'second', 'third', 'Fourth'][q] || ' quarter ' || y WHEN 2 THEN y || ' q' || q
  WHEN 3 THEN 'Three months ended March 31, ' || y WHEN 4 THEN 'FY' || y || ' Q' || q WHEN 5 THEN 'FY' || (y % 100) || ' Q' || q WHEN 6 THEN q || 'q' || (y % 100) WHEN 7 THEN '  ' || q || 'Q' || (y % 100)
  ELSE 'Report ' || y END AS title,
  CASE WHEN k IN (0, 2, 4, 6) OR (k = 1 AND q < 4) THEN y || '-Q' || q END AS by_title FROM t)"""
_BY_DATE = "(substring(published, 1, 4) || '-Q' || q)"
SQL["period_from_title"] = f"WITH {_TITLES} SELECT o_orderkey, by_title AS period FROM ti"
SQL["period_from_date"] = f"WITH {_TITLES} SELECT o_orderkey, {_BY_DATE} AS period FROM ti"
SQL["infer_period"] = f"WITH {_TITLES} SELECT o_orderkey, coalesce(by_title, {_BY_DATE}) AS period FROM ti"
SQL["normalize_period"] = f"""WITH {_TITLES}, r AS (SELECT o_orderkey, upper(CASE o_orderkey % 3 WHEN 0 THEN coalesce(by_title, {_BY_DATE}) WHEN 1 THEN published[1:10] ELSE trim(title) END) AS s FROM ti)
SELECT o_orderkey, CASE WHEN regexp_full_match(s, '\\d{{4}}-Q[1-4]') THEN s WHEN regexp_matches(s, '\\d{{4}}.*?[1-4]') THEN regexp_extract(s, '(\\d{{4}}).*?([1-4])', 1) || '-Q' || regexp_extract(s, '(\\d{{4}}).*?([1-4])', 2) END AS period FROM r"""
SQL["expected_quarter"] = """SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 5 THEN 1 ELSE 0 END)::INT AS target_year,
CASE WHEN month(o_orderdate) >= 10 THEN 3 WHEN month(o_orderdate) >= 8 THEN 2 WHEN month(o_orderdate) >= 5 THEN 1 ELSE 4 END AS target_quarter, (year(o_orderdate) - 1)::INT AS fallback_year,
CASE WHEN month(o_orderdate) >= 10 THEN 2 WHEN month(o_orderdate) >= 8 THEN 1 WHEN month(o_orderdate) >= 5 THEN 4 ELSE 3 END AS fallback_quarter FROM orders"""
_NAMED = f"""{CLASSED}, n AS (SELECT link_id, ticker, ticker || '_' || replace(CASE WHEN isreport THEN label ELSE 'unknown' END, '_', '-') || '_financial_report'
|| CASE WHEN contains(u, '.xlsx') THEN '.xlsx' WHEN contains(u, '.xls') THEN '.xls' ELSE '.pdf' END AS filename FROM cl)"""
_PERIOD = r"CASE WHEN regexp_matches(filename, '\d{4}[_\-]?Q?[1-4]') THEN regexp_extract(filename, '(\d{4})[_\-]?Q?([1-4])', 1) || '-Q' || regexp_extract(filename, '(\d{4})[_\-]?Q?([1-4])', 2) ELSE '2025-Q4' END"
SQL["filename_generate"] = f"{_NAMED} SELECT link_id, filename FROM n"
SQL["filename_parse"] = f"{_NAMED} SELECT link_id, CASE WHEN regexp_matches(filename, '^[A-Z]{{2,5}}') THEN regexp_extract(filename, '^([A-Z]{{2,5}})', 1) ELSE 'UNKNOWN' END AS ticker, {_PERIOD} AS period FROM n"
SQL["ticker_from_stem"] = f"{_NAMED} SELECT link_id, split_part(filename, '_', 1) AS ticker, split_part(filename, '_', 2) AS part FROM n"
_under = {"text_dir": "text", "tables_dir": "tables", "images_dir": "images", "structured_json": "structured.json", "docling_manifest": "docling/manifest.json", "manifest_jsonl": "manifest.jsonl"}
SQL["object_paths"] = f"""{_NAMED}, o AS (SELECT link_id, ticker, {_PERIOD} AS p FROM n) SELECT link_id, 'store/raw/' || ticker || '/' || p || '/report.pdf' AS raw_pdf, {', '.join(f"'store/parsed/' || ticker || '/' || p || '/{v}' AS {k}" for k, v in _under.items())},
'store/state/' || ticker || '.json' AS state_json FROM o"""

# documents
SQL["doc_hash"] = "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS n_bytes FROM documents"
SQL["doc_dedup_keep_first"] = "SELECT doc_id, source, md5(text) AS md5 FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1"
SQL["dup_stats"] = "SELECT source, count(*) AS total, count(DISTINCT text) AS extracted, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY 1"
_DOCNAME = "upper(source) || '_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '_Slides.pdf' WHEN 1 THEN '_supplement.pdf' ELSE '_report.pdf' END"
_HEAD = "array_to_string(string_split(text, chr(10))[1:20], chr(10))"
SQL["report_type"] = f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'presentation' WHEN doc_id % 5 = 1 THEN 'supplemental' WHEN {has(f'lower({_HEAD})', ['earnings call', 'conference call'])} THEN 'presentation' ELSE 'press' END AS report_type FROM documents"
SQL["title_from_name"] = f"SELECT doc_id, replace(replace({_DOCNAME}, '.pdf', ''), '_', ' ') AS title FROM documents"
SQL["head_lines"] = f"SELECT doc_id, {_HEAD} AS head FROM documents"
SQL["truncate_text"] = "SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || chr(10) || '[TRUNCATED]' ELSE text END) AS md5 FROM documents"
SQL["concat_first5"] = """SELECT conv_id, string_agg('TABLE: ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5) GROUP BY 1"""
SQL["markdown_to_csv"] = """SELECT n_regionkey, '"key","name"' || chr(10) || string_agg('"' || n_nationkey || '","' || n_name || '"', chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1"""
SQL["json_clean"] = "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 'no record' ELSE props END AS json FROM events"
SQL["json_parse_fallback"] = """WITH x AS (SELECT event_id, event_type, value, event_id % 5 > 0 AND event_id % 7 > 0 AS ok FROM events)
SELECT event_id, event_type AS ticker, '2025-Q1' AS period, ok AS extracted, CASE WHEN ok THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN ok THEN value END AS revenue, CASE WHEN ok THEN NULL ELSE 'Extraction failed - see error log' END AS guidance_summary FROM x"""

# manifest and summaries
E = """WITH e AS (SELECT d.doc_id, upper(source) AS ticker, '2025-Q' || (d.doc_id % 4 + 1) AS period, '2025-0' || (d.doc_id % 9 + 1) || '-15' AS published, CASE WHEN lang <> 'en' THEN lang END AS report_type,
sha256(coalesce(text, '')) AS sha256, CASE WHEN d.doc_id % 3 > 0 THEN quality::DOUBLE * 0.9 END AS confidence FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SQL["manifest_entries"] = f"""{E} SELECT doc_id, '{{"ticker":"' || ticker || '","period":"' || period || '","sha256":"' || sha256 || '","notes":["parsed"]}}' AS entry FROM e"""
SQL["manifest_summary"] = f"{E} SELECT count(*) AS total_reports, count(DISTINCT ticker) AS unique_tickers, coalesce(round(avg(confidence), 3), 0) AS avg_confidence, count(confidence) AS confidence_samples FROM e"
SQL["manifest_by_type"] = f"{E} SELECT coalesce(report_type, 'unknown') AS report_type, count(*) AS n FROM e GROUP BY 1"
SQL["manifest_by_period"] = f"{E} SELECT period, count(*) AS n FROM e GROUP BY 1"
SQL["latest_entry_per_key"] = f"{E} SELECT ticker, doc_id, published FROM e QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published DESC, doc_id) = 1"
SQL["is_duplicate"] = "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
SQL["corpus_summary"] = """SELECT count(*) AS total_reports, string_agg(DISTINCT source, ',' ORDER BY source) AS tickers, string_agg(DISTINCT '2025-Q' || (doc_id % 4 + 1), ',' ORDER BY '2025-Q' || (doc_id % 4 + 1)) AS periods,
round(sum(strlen(text)::DOUBLE) / 1048576, 2) AS total_size_mb FROM documents"""
SQL["pipeline_summary"] = f"""{E} SELECT count(*) AS total, count(*) FILTER (doc_id % 5 <> 0) AS extracted, count(*) FILTER (doc_id % 7 <> 0) AS uploaded, count(*) FILTER (doc_id % 2 = 0) AS in_manifest,
count(*) FILTER (doc_id % 11 = 0) AS qc_passed, round(avg(coalesce(confidence, 0)) FILTER (doc_id % 5 <> 0), 3) AS avg_confidence FROM e"""
SQL["run_totals"] = """WITH x AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS g, avg(value) AS a FROM events)
SELECT n AS total, g AS succeeded, n - g AS failed, round(100.0 * g / n, 4) AS rate, round(a, 6) AS avg_seconds, round(a * n / 3600, 6) AS speed_up, 2 * g >= n AS passed FROM x"""
SQL["failure_analysis"] = "SELECT props AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, error LIMIT 5"
SQL["upload_summary"] = "SELECT event_type, count(*) AS total, count(*) FILTER (value >= 5) AS successful, count(*) FILTER (value < 5) AS failed FROM events GROUP BY 1"

# state
A = "WITH RECURSIVE a AS (SELECT event_id, user_id, event_type, md5(props) AS sha256, strftime(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y-%m-%d %H:%M:%S') AS published FROM events)"
_STATE = "SELECT user_id, arg_max(sha256, event_id) AS sha256, arg_max(published, event_id) AS published, count(*) AS processing_count FROM a GROUP BY 1"
SQL["state_upsert"] = f"{A} {_STATE}"
SQL["skip_decision"] = f"""{A}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM a),
r AS (SELECT user_id, i, event_id, sha256 AS s, published AS p, true AS process FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, o.event_id, CASE WHEN o.sha256 <> r.s AND o.published >= r.p THEN o.sha256 ELSE r.s END, CASE WHEN o.sha256 <> r.s AND o.published >= r.p THEN o.published ELSE r.p END, o.sha256 <> r.s AND o.published >= r.p
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT event_id, process FROM r"""
SQL["skip_reasons"] = f"""{A}, s AS (SELECT user_id, arg_max(sha256, event_id) AS sha, arg_max(published, event_id) AS pub FROM a WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, CASE WHEN sha IS NULL THEN true WHEN sha256 = sha THEN false ELSE published >= pub END AS process, CASE WHEN sha IS NULL THEN 'No previous state found' WHEN sha256 = sha THEN 'Same SHA256 already processed: ' || sha256[1:8] || '...'
WHEN published < pub THEN 'Older report (published ' || published || ' vs ' || pub || ')' ELSE 'New report to process (SHA256: ' || sha256[1:8] || '...)' END AS reason FROM a LEFT JOIN s USING (user_id)"""
SQL["older_arrivals"] = f"""{A}, w AS (SELECT event_id, published, max(published) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before FROM a)
SELECT event_id, newest_before FROM w WHERE published < newest_before"""
SQL["state_histogram"] = f"{A}, s AS ({_STATE}) SELECT processing_count, count(*) AS n FROM s GROUP BY 1"
SQL["latest_updates"] = f"{A}, s AS ({_STATE}) SELECT user_id, published FROM s ORDER BY published DESC, user_id"

# checks
SQL["required_objects_missing"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
_S = STRIP.format("text")
SQL["qc_outputs"] = f"""WITH x AS (SELECT doc_id, {_S} AS s FROM documents), y AS (SELECT doc_id, CASE WHEN length(s) < 100 THEN 'Text file too short: ' || length(s) || ' chars'
WHEN NOT {has('lower(s)', W.CONTENT_TERMS)} THEN 'Text file does not appear to contain earnings content' ELSE '' END AS errors FROM x) SELECT doc_id, errors, errors = '' AS passed FROM y"""
_R = f"""{E}, r AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN ticker END AS rt, doc_id % 5 - 1 AS rv, CASE WHEN doc_id % 6 = 0 THEN 'EUR' ELSE 'USD' END AS ru, doc_id % 7 = 0 AS rs, doc_id % 8 AS rh,
coalesce(confidence, 0) AS cf, CASE WHEN doc_id % 10 = 0 THEN 9 ELSE 64 END AS sl FROM e),"""
_Q = """q AS (SELECT *, list_filter([CASE WHEN rt IS NULL THEN 'Missing required field: ticker' END, CASE WHEN report_type IS NULL THEN 'Missing required field: report_type' END, CASE WHEN confidence IS NULL THEN 'Missing required field: confidence' END,
CASE WHEN rt IS NULL THEN 'Ticker mismatch: expected ' || ticker || ', got None' END, CASE WHEN period <> '2025-Q1' THEN 'Period mismatch: expected 2025-Q1, got ' || period END,
CASE WHEN cf < 0.1 THEN 'Very low confidence' END, CASE WHEN rv < 0 THEN 'Revenue value is negative' END, CASE WHEN ru <> 'USD' THEN 'Unexpected revenue unit: ' || ru END, CASE WHEN rs THEN 'Invalid revenue scale: T' END,
CASE WHEN rh > 5 THEN 'Too many key highlights: ' || rh || ' (max 5)' END], lambda x: x IS NOT NULL) AS a,
list_filter([CASE WHEN report_type IS NULL THEN 'Missing or empty required field: report_type' END, CASE WHEN doc_id % 3 = 0 THEN 'Missing or empty required field: source_url' END, CASE WHEN sl <> 64 THEN 'Invalid SHA256 length: 9' END,
CASE WHEN length(ticker) > 5 THEN 'Invalid ticker format: ' || ticker END, CASE WHEN doc_id % 9 = 0 THEN 'Invalid GCS PDF path: /f.pdf' END], lambda x: x IS NOT NULL) AS b FROM r)"""
SQL["qc_structured"] = f"{_R} {_Q} SELECT doc_id, array_to_string(a, '; ') AS errors FROM q"
SQL["qc_manifest"] = f"{_R} {_Q} SELECT doc_id, array_to_string(b, '; ') AS errors, b[1] AS first_error FROM q"
SQL["qc_full"] = f"{_R} {_Q} SELECT doc_id, len(a) + len(b) = 0 AS overall_passed, (len(a) + len(b))::INT AS error_count FROM q"

# files
SQL["csv_long_form"] = """WITH n AS (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS row_no, * FROM nation)
SELECT row_no, 0 AS col_no, n_nationkey::VARCHAR AS value FROM n UNION ALL SELECT row_no, 1, n_name FROM n UNION ALL SELECT row_no, 2, n_regionkey::VARCHAR FROM n"""
SQL["jsonl_permissive"] = f"{E} SELECT ticker, period, count(*) AS n FROM e WHERE doc_id % 10 <> 0 GROUP BY 1, 2"
SQL["binary_scan"] = "WITH f AS (SELECT string_agg(r_name || chr(10), '' ORDER BY r_name) AS b FROM region) SELECT strlen(b) AS file_size, sha256(b) AS sha256 FROM f"
SQL["page_titles"] = f"SELECT page_id, nullif(lower({STRIP.format('regexp_extract(html, ' + quote('<title>([^<]*)</title>') + ', 1)')}), '') AS title FROM pages"
