"""Fixed values of the rules, written out for the SQL by themselves, so that a slip in the engine's own lists shows."""

from __future__ import annotations

# Fixed values, in the order of the rules.
FILE_EXTENSIONS = ".pdf .xlsx .xls".split()
PAGE_PATHS = "/earnings /financial /sec-filings /press-release /investor".split()
TEXT_INDICATORS = "download view pdf report earnings presentation".split()
QUARTERLY_TERMS = [
    "earning", "quarterly", "10-q", "q1", "q2", "q3", "q4", "first quarter", "second quarter", "third quarter", "fourth quarter",
    "financial report", "results", "interim",
]
ANNUAL_TERMS = ["10-k", "annual report", "annual"]
FINANCIAL_TERMS = "financial report filing sec".split()
STRICT_EXCLUSIONS = [
    "proxy", "charter", "bylaws", "biography", "bio", "governance charter", "code of conduct", "ethics", "press kit", "glossary",
    "definitions", "sustainability", "esg", "environmental", "social responsibility", "presentation", "webcast", "transcript",
    "slides", "conference call", "investor day", "analyst day", "guidance", "outlook", "press release",
]
LATEST_TERMS = "latest recent current interim".split()
FINANCIAL_URL_WORDS = "earning financial report quarter annual 10-".split()
FALLBACK_TERMS = ".pdf .xlsx .xls download filing earnings".split()
CHART_TERMS = [
    "trend", "chart", "summary", "overview", "snapshot", "graphic", "revenue_by_mkt_qtrly_trend", "rev_by_mkt_qtrly_trend",
    "quarterly_trend", "revenue_trend", "quarterly revenue trend", "presentation", "slides", "highlights", "slideshow",
    "infographic", "dashboard", "visualization", "visual", "qtrly_trend", "mkt_qtrly", "investor_presentation",
    "earnings_presentation", "webcast", "conference_call", "supplementary", "supplement", "fact_sheet", "factsheet", "datasheet",
    "data_sheet", "statistics", "metrics", "analysis", "outlook", "earnings conference call", "conference call", "earnings call",
    "event-details", "event details", "earnings event", "investor event", "live event", "earnings announcement",
    "call transcript", "listen live", "join call", "replay", "audio", "video",
]
REPORT_WORDS = "earning quarterly 10-q 10-k annual".split()
YEARS = [2025, 2024, 2023, 2022, 2021]
QUARTER_WORDS = [
    (4, ["q4", "fourth quarter", "4q", "fourth"]), (3, ["q3", "third quarter", "3q", "third"]),
    (2, ["q2", "second quarter", "2q", "second"]), (1, ["q1", "first quarter", "1q", "first"]),
]
LEGACY_EARNINGS = ["earnings", "quarterly", "results", "financial results", "10-q", "10-k"]
LEGACY_QUARTERS = [("q3|third.*quarter|3q", 3), ("q2|second.*quarter|2q", 2), ("q4|fourth.*quarter|4q", 4), ("q1|first.*quarter|1q", 1)]
FISCAL_YEARS = ["2025", "fy25", "fy2025", "fy 25", "fiscal 2025", "fiscal 25", "2026", "fy26", "fy2026", "fy 26", "fiscal 2026", "fiscal 26"]
QUARTER_WEIGHTS = [(["q2", "second"], 1.0), (["q3", "third"], 0.7), (["q4", "fourth"], 0.5), (["q1", "first"], 0.6)]
SUPER_STRONG = ["10-q", "form 10-q", "quarterly report", ".pdf", "sec filings", "financial report", "quarterly filing", "earnings release pdf"]
STRONG = [
    "10-k", "earnings report", "financial statements", "sec filing", "form 10", "quarterly filing", "earnings filing",
    "quarterly results pdf", "financial results pdf", "investor pdf",
]
MEDIUM = "earnings financial quarterly results".split()
STRATEGY_BONUS = [("learned_patterns", 0.3), ("dynamic_discovery", 0.2), ("sec_filings", 0.15), ("comprehensive_scan", 0.1)]
OCTOBER_QUARTERS = [
    ("q2", 1.0), ("second quarter", 1.0), ("2q", 1.0), ("q3", 0.7), ("third quarter", 0.7), ("3q", 0.7), ("q4", 0.6),
    ("fourth quarter", 0.6), ("4q", 0.6), ("q1", 0.5),
]
IR_EXCLUSIONS = (
    "store directory locations career job help support contact login account identity auth signin signup register newsroom news "
    "press-release blog article announcement media press story event webinar conference"
).split()
IR_STRONG = "investor-relations /ir/ investors/ shareholders".split()
IR_WEAK = "governance earnings reports financial".split()
IR_NEWS = "2024- 2025- /20 announcement partnership".split()
IR_TITLES = ["investor", "investors", "investor relations", "financial", "earnings", "stockholder", "shareholder"]
IR_URLS = "investors. investor. ir. /investor /investors /ir".split()
IR_CONTENT = ["financial reports", "earnings", "sec filings", "quarterly", "annual report", "10-k", "10-q", "press release", "financial information"]
IR_DENIED = ["access denied", "forbidden", "denied"]
IR_CONFIDENCE = [
    (0.8, ["investor relations", "investor-relations", "/ir/", "/investors/"]), (0.4, ["investors", "financials", "governance", "shareholders"]),
    (0.2, ["reports", "earnings", "quarterly", "annual"]),
]
IR_PATHS = (
    "/investor /investors /ir /about/investors /investor-relations /shareholders /financials /corporate/investors "
    "/our-company/investors /company/investors /about/investor-relations /corporate/financials /corporate/governance "
    "/company/financial-information /about/financial-information /investor-relations-2 /investor-relations-home /en/investors "
    "/en/investor-relations /global/investors /investor/financial-reporting /investor/quarterly-earnings "
    "/investor/events-and-presentations /investor/presentations /investor/earnings /investor/sec-filings /en-us/investor "
    "/investors/news-events-and-reports /news /newsroom /press-releases /media /news/earnings /news/financial "
    "/news/press-releases /media/press-releases /newsroom/earnings"
).split()
IR_SUBDOMAINS = "ir investor investors financials corporate shareholders sec reports".split()
PDF_TERMS = "earnings financial quarterly q1 q2 q3 q4 10-q results".split()
PDF_DOMAINS = "q4cdn sec.gov investor ir.".split()
PDF_GENERIC = "download click here view".split()
THIRD_PARTIES = "spglobal.com moodys.com fitchratings.com bloomberg.com reuters.com morningstar.com sec.gov".split()
CALENDAR_ALLOWED = ".pdf doc_financials transcript".split()
EVENT_TERMS = "event-details conference-call webcast".split()
PAGE_INDICATORS = [
    "q2 2025 earnings", "q3 2025 earnings", "q4 2025 earnings", "q1 2025 earnings", "second quarter 2025", "third quarter 2025",
    "fourth quarter 2025", "first quarter 2025", "second quarter results", "quarterly results", "earnings presentation",
    "earnings release", "press release", "financial results", "quarterly earnings", "july 31, 2025", "jul 24, 2025", "aug 21, 2025",
    "07/29/2025", "fy25 q4", "fiscal 2025", "fiscal quarter", "quarterly-earnings", "financial-reporting",
    "events-and-presentations", "sec filings", "earnings conference call", "investor presentation",
]
HIGH_KEYWORDS = [
    "earnings release", "quarterly earnings", "quarterly results", "q2 2025", "second quarter 2025", "earnings presentation",
    "financial results", "10-q", "press release",
]
PATH_SEGMENTS = "202 upload document file".split()
DATE_PATTERNS = [
    r"Q[1-4]\s+(?:FY\s*)?20\d{2}",
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+20\d{2}",
    r"\d{1,2}/\d{1,2}/20\d{2}",
    r"20\d{2}-\d{2}-\d{2}",
    r"FY\s*20\d{2}",
]
HTML_MARKS = ["<!doctype", "<html>", "<body>", "<head>", "</html>", "<div", "<script"]
ERROR_MARKS = ["404", "not found", "access denied", "forbidden", "error", "page not found"]
CONTENT_TERMS = "revenue earnings quarter financial".split()

# What queries add to the end of each page, {i} being its number: elements that crawled pages have and the given ones lack.
TAIL = (
    '<div class="Quarterly-Report box"><a class="link" href="/investor/2025/q3/earnings-{i}.pdf?a=1&amp;b=2">Q3 2025 earnings &amp; results</a></div>'
    '<table class=data><tr><td>x<td><a href="https://investors.example.com/2025/q2/report-{i}.pdf">Q2 2025 <b>quarterly</b> report</a><tr><td><a>none</a></table>'
    "<section id=main class='content wide'><ul><li><a href=/reports/2024/annual-{i}.xlsx>Annual report 2024</a><li><a href='#top'>top</a></ul></section>"
    '<!-- <a href="/investor/2025/hidden.pdf">Q3 2025 hidden</a> --><script>var x = "<a href=/2025/no.pdf>no</a>";</script>'
    '<div onclick="open({i})"><div class="button x">in</div></div><p><img class="link"><p>next <i class=button>italic</i>'
    '<dl><dt>a<dd><a href="/filings/10-q-{i}.html">Latest 10-Q filing</a></dl><div class="menu"><a href="/ir">Investors</a></div>'
    '<header><b><a href="/about">About</b> us</a></header><footer><a href="/late">late</a></footer>'
    '<a href="/investor/2025/results-{i}.html"><span>October 3, 2025</span> quarterly results</a><span onclick="/financial/q3-2025-earnings-{i}.xlsx"><em>For Q3 2025</em></span>'
    '<div><a href="/earnings/fiscal-2025/third-quarter-2025-{i}.pdf">Press Download</a><u>fiscal 2025 is on, 07/29/2025 too</u></div>'
    '<p>See the third quarter 2025 and quarterly results at https://investors.example.com/2025/q3/doc-{i}.pdf, or the report at https://www.example.com/ir'
)

# Words of single companies in keyword searches, and pages of last resort, in order.
TICKER_KEYWORDS = {
    "AMGN": "amgen|biotechnology|pharmaceuticals|financials|quarterly-earnings|static-files|earnings-presentation|pdf|q2-2025".split("|"),
    "MSFT": "microsoft|fy-2025-q4|press-release-webcast|sec-filings|investor|earnings|income-statements|financial-statements".split("|"),
    "NKE": "nike|news-events-and-reports|quarterly-earnings|fiscal-2025|q4-fy2025|earnings-announcement|investor-news".split("|"),
    "IBM": "ibm|financial-reporting|earnings-2q25|second-quarter|press-release".split("|"),
    "INTC": "intel|financial-results|earnings-conference-call|press-releases|q2-2025|financial-results".split("|"),
    "JPM": "jpmorgan|jpmorganchase|quarterly-earnings|investor-relations|earnings-pdf|second-quarter".split("|"),
    "HON": "honeywell|presentations|events-and-presentations|earnings-presentation|static-files|quarterly-results".split("|"),
    "WMT": "walmart|earnings-release|earnings-presentation|fy26-q2|corporate".split("|"),
    "CAT": "caterpillar|machinery|construction|cat inc".split("|"),
    "DIS": "disney|entertainment|media|walt disney".split("|"),
    "GS": "goldman sachs|investment banking|financial services".split("|"),
    "CVX": "chevron|oil|energy|petroleum".split("|"),
    "MMM": "3m|mmm|industrial|materials".split("|"),
    "PG": "procter gamble|consumer goods|household products".split("|"),
}
FIXED_PAGES = {
    "AMZN": "https://ir.aboutamazon.com/quarterly-results https://ir.aboutamazon.com/sec-filings".split(),
    "AMGN": "https://investors.amgen.com/financials/sec-filings https://investors.amgen.com/financials/quarterly-results".split(),
    "CVX": "https://investor.chevron.com/financial-information/quarterly-earnings https://investor.chevron.com/sec-filings".split(),
    "GS": "https://investor.goldmansachs.com/financial-information/quarterly-earnings https://investor.goldmansachs.com/financials".split(),
    "JPM": "https://ir.jpmorganchase.com/financial-information/quarterly-earnings https://ir.jpmorganchase.com/sec-filings".split(),
    "V": "https://investor.visa.com/financial-information/quarterly-earnings https://investor.visa.com/sec-filings".split(),
    "WMT": "https://corporate.walmart.com/news/financials/quarterly-earnings-reports https://corporate.walmart.com/financials".split(),
    "HON": "https://investor.honeywell.com/financial-information/quarterly-results https://investor.honeywell.com/financials/quarterly-earnings".split(),
    "MSFT": "https://www.microsoft.com/investor/earnings/fy-2025-q4/ https://www.microsoft.com/investor/sec-filings".split(),
    "UNH": "https://www.unitedhealthgroup.com/investor/financial-information/quarterly-results https://investors.unitedhealthgroup.com/quarterly-earnings".split(),
    "PG": "https://us.pg.com/investor/financial-information/quarterly-results https://pginvestor.com/quarterly-earnings".split(),
    "MMM": "https://investors.3m.com/financial-information/quarterly-results https://investors.3m.com/quarterly-earnings".split(),
    "DIS": "https://www.thewaltdisneycompany.com/investors/financial-information/quarterly-results https://thewaltdisneycompany.com/investor-relations/financials".split(),
    "DOW": "https://investors.dow.com/financial-information/quarterly-results https://investors.dow.com/quarterly-earnings".split(),
    "CAT": "https://www.caterpillar.com/investors/financial-information/quarterly-results https://investors.caterpillar.com/quarterly-earnings".split(),
}
