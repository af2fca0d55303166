"""Word lists, weights and limits that results depend on, and the engine's parameters."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

COMPANIES = [
    ("AAPL", "Apple Inc.", "https://www.apple.com"),
    ("AMGN", "Amgen Inc.", "https://www.amgen.com"),
    ("AMZN", "Amazon.com, Inc.", "https://www.aboutamazon.com/"),
    ("AXP", "American Express Company", "https://www.americanexpress.com"),
    ("BA", "The Boeing Company", "https://www.boeing.com"),
    ("CAT", "Caterpillar Inc.", "https://www.caterpillar.com"),
    ("CRM", "Salesforce, Inc.", "https://www.salesforce.com"),
    ("CSCO", "Cisco Systems, Inc.", "https://www.cisco.com"),
    ("CVX", "Chevron Corporation", "https://www.chevron.com"),
    ("DIS", "The Walt Disney Company", "https://thewaltdisneycompany.com/"),
    ("SHW", "Sherwin-Williams Company", "https://www.sherwin-williams.com/"),
    ("GS", "The Goldman Sachs Group, Inc.", "https://www.goldmansachs.com"),
    ("HD", "The Home Depot, Inc.", "https://www.homedepot.com"),
    ("HON", "Honeywell International Inc.", "https://www.honeywell.com"),
    ("IBM", "International Business Machines Corporation", "https://www.ibm.com"),
    ("INTC", "Intel Corporation", "https://www.intel.com"),
    ("JNJ", "Johnson & Johnson", "https://www.jnj.com"),
    ("JPM", "JPMorgan Chase & Co.", "https://www.jpmorganchase.com"),
    ("KO", "The Coca-Cola Company", "https://www.coca-colacompany.com"),
    ("MCD", "McDonald's Corporation", "https://www.mcdonalds.com"),
    ("MMM", "3M Company", "https://www.3m.com"),
    ("MRK", "Merck & Co., Inc.", "https://www.merck.com"),
    ("MSFT", "Microsoft Corporation", "https://www.microsoft.com"),
    ("NKE", "Nike, Inc.", "https://www.nike.com"),
    ("NVDA", "NVIDIA Corporation", "https://www.nvidia.com"),
    ("PG", "The Procter & Gamble Company", "https://www.pg.com"),
    ("TRV", "The Travelers Companies, Inc.", "https://www.travelers.com"),
    ("UNH", "UnitedHealth Group Incorporated", "https://www.unitedhealthgroup.com"),
    ("V", "Visa Inc.", "https://www.visa.com"),
    ("WMT", "Walmart Inc.", "https://www.walmart.com"),
]

# Link validity
FILE_EXTENSIONS = [".pdf", ".xlsx", ".xls"]
PAGE_PATHS = ["/earnings", "/financial", "/sec-filings", "/press-release", "/investor"]
TEXT_INDICATORS = ["download", "view", "pdf", "report", "earnings", "presentation"]
QUARTERLY_TERMS = [
    "earning", "quarterly", "10-q", "q1", "q2", "q3", "q4", "first quarter", "second quarter", "third quarter",
    "fourth quarter", "financial report", "results", "interim",
]
ANNUAL_TERMS = ["10-k", "annual report", "annual"]
FINANCIAL_TERMS = ["financial", "report", "filing", "sec"]
STRICT_EXCLUSIONS = [
    "proxy", "charter", "bylaws", "biography", "bio", "governance charter", "code of conduct", "ethics", "press kit",
    "glossary", "definitions", "sustainability", "esg", "environmental", "social responsibility", "presentation", "webcast",
    "transcript", "slides", "conference call", "investor day", "analyst day", "guidance", "outlook", "press release",
]
LATEST_TERMS = ["latest", "recent", "current", "interim"]
FINANCIAL_URL_WORDS = ["earning", "financial", "report", "quarter", "annual", "10-"]
FALLBACK_TERMS = [".pdf", ".xlsx", ".xls", "download", "filing", "earnings"]

# Charts and summaries that are no reports
CHART_TERMS = [
    "trend", "chart", "summary", "overview", "snapshot", "graphic", "revenue_by_mkt_qtrly_trend", "rev_by_mkt_qtrly_trend",
    "quarterly_trend", "revenue_trend", "quarterly revenue trend", "presentation", "slides", "highlights", "slideshow",
    "infographic", "dashboard", "visualization", "visual", "qtrly_trend", "mkt_qtrly", "investor_presentation",
    "earnings_presentation", "webcast", "conference_call", "supplementary", "supplement", "fact_sheet", "factsheet",
    "datasheet", "data_sheet", "statistics", "metrics", "analysis", "outlook", "earnings conference call", "conference call",
    "earnings call", "event-details", "event details", "earnings event", "investor event", "live event",
    "earnings announcement", "call transcript", "listen live", "join call", "replay", "audio", "video",
]

# Classification
REPORT_WORDS = ["earning", "quarterly", "10-q", "10-k", "annual"]
YEARS = [2025, 2024, 2023, 2022, 2021]
QUARTER_WORDS = [
    (4, ["q4", "fourth quarter", "4q", "fourth"]),
    (3, ["q3", "third quarter", "3q", "third"]),
    (2, ["q2", "second quarter", "2q", "second"]),
    (1, ["q1", "first quarter", "1q", "first"]),
]
LEGACY_EARNINGS = ["earnings", "quarterly", "results", "financial results", "10-q", "10-k"]
LEGACY_QUARTERS = [("q3|third.*quarter|3q", 3), ("q2|second.*quarter|2q", 2), ("q4|fourth.*quarter|4q", 4), ("q1|first.*quarter|1q", 1)]

# Scores
FISCAL_YEARS = [
    "2025", "fy25", "fy2025", "fy 25", "fiscal 2025", "fiscal 25", "2026", "fy26", "fy2026", "fy 26", "fiscal 2026", "fiscal 26",
]
QUARTER_WEIGHTS = [(["q2", "second"], 1.0), (["q3", "third"], 0.7), (["q1", "first"], 0.6), (["q4", "fourth"], 0.5)]
SUPER_STRONG = [
    "10-q", "form 10-q", "quarterly report", ".pdf", "sec filings", "financial report", "quarterly filing", "earnings release pdf",
]
STRONG = [
    "10-k", "earnings report", "financial statements", "sec filing", "form 10", "quarterly filing", "earnings filing",
    "quarterly results pdf", "financial results pdf", "investor pdf",
]
MEDIUM = ["earnings", "financial", "quarterly", "results"]
STRATEGY_BONUS = [("learned_patterns", 0.3), ("dynamic_discovery", 0.2), ("sec_filings", 0.15), ("comprehensive_scan", 0.1)]


def year_patterns(year: int) -> list[tuple[str, float]]:
    """Weights of the year of a search and of the three before it."""
    return [(str(year - k), w) for k, w in enumerate((1.0, 0.85, 0.6, 0.4))]


def quarter_patterns(month: int) -> list[tuple[str, float]]:
    """Ordered weights of quarter words for the month that a search is made in; the first one contained counts."""
    if month >= 11:
        return [("q3", 1.0), ("third quarter", 1.0), ("3q", 1.0), ("q2", 0.8), ("q4", 0.6)]
    if month == 10:
        return [
            ("q2", 1.0), ("second quarter", 1.0), ("2q", 1.0), ("q3", 0.7), ("third quarter", 0.7), ("3q", 0.7),
            ("q4", 0.6), ("fourth quarter", 0.6), ("4q", 0.6), ("q1", 0.5),
        ]
    if month >= 7:
        return [("q2", 1.0), ("second quarter", 1.0), ("2q", 1.0), ("q1", 0.8), ("q3", 0.4)]
    if month >= 4:
        return [("q1", 1.0), ("first quarter", 1.0), ("1q", 1.0), ("q4", 0.9), ("annual", 0.9), ("q2", 0.4)]
    return [("q4", 1.0), ("fourth quarter", 1.0), ("4q", 1.0), ("annual", 1.0), ("10-k", 0.95), ("q3", 0.6)]


# Investor-relations pages
IR_EXCLUSIONS = [
    "store", "directory", "locations", "career", "job", "help", "support", "contact", "login", "account", "identity", "auth",
    "signin", "signup", "register", "newsroom", "news", "press-release", "blog", "article", "announcement", "media", "press",
    "story", "event", "webinar", "conference",
]
IR_STRONG = ["investor-relations", "/ir/", "investors/", "shareholders"]
IR_WEAK = ["governance", "earnings", "reports", "financial"]
IR_NEWS = ["2024-", "2025-", "/20", "announcement", "partnership"]
IR_TITLES = ["investor", "investors", "investor relations", "financial", "earnings", "stockholder", "shareholder"]
IR_URLS = ["investors.", "investor.", "ir.", "/investor", "/investors", "/ir"]
IR_CONTENT = [
    "financial reports", "earnings", "sec filings", "quarterly", "annual report", "10-k", "10-q", "press release", "financial information",
]
IR_DENIED = ["access denied", "forbidden", "denied"]
IR_CONFIDENCE = [
    (0.8, ["investor relations", "investor-relations", "/ir/", "/investors/"]),
    (0.4, ["investors", "financials", "governance", "shareholders"]),
    (0.2, ["reports", "earnings", "quarterly", "annual"]),
]
IR_PATHS = [
    "/investor", "/investors", "/ir", "/about/investors", "/investor-relations", "/shareholders", "/financials",
    "/corporate/investors", "/our-company/investors", "/company/investors", "/about/investor-relations", "/corporate/financials",
    "/corporate/governance", "/company/financial-information", "/about/financial-information", "/investor-relations-2",
    "/investor-relations-home", "/en/investors", "/en/investor-relations", "/global/investors", "/investor/financial-reporting",
    "/investor/quarterly-earnings", "/investor/events-and-presentations", "/investor/presentations", "/investor/earnings",
    "/investor/sec-filings", "/en-us/investor", "/investors/news-events-and-reports", "/news", "/newsroom", "/press-releases",
    "/media", "/news/earnings", "/news/financial", "/news/press-releases", "/media/press-releases", "/newsroom/earnings",
]
IR_SUBDOMAINS = ["ir", "investor", "investors", "financials", "corporate", "shareholders", "sec", "reports"]
IR_LINK_WORDS = [
    "investor relations", "investors", "investor", "shareholders", "financial information", "financials", "ir", "governance",
    "financial results", "earnings", "reports", "quarterly results", "annual reports", "sec filings", "investor information",
    "corporate governance", "financial data", "stockholders", "quarterly earnings", "annual report", "financial statements",
    "financial reporting", "quarterly-earnings", "earnings releases", "events and presentations", "presentations",
    "news events and reports", "earnings conference call", "press releases", "financial news",
]
IR_HREF_WORDS = [
    "investor", "ir", "financial", "shareholders", "governance", "earnings", "reports", "quarterly", "annual", "stockholder",
    "corporate", "sec-filings", "financials", "financial-reporting", "quarterly-earnings", "events-and-presentations",
    "presentations", "news-events-and-reports", "earnings-fy", "press-release",
]
IR_KNOWN = {
    "AMGN": "https://investors.amgen.com/financials/sec-filings",
    "AMZN": "https://ir.aboutamazon.com/sec-filings/default.aspx",
    "CVX": "https://investor.chevron.com/sec-filings/quarterly-results",
    "IBM": "https://www.ibm.com/investor/financials",
    "GS": "https://www.goldmansachs.com/investor-relations/financials/current/quarterly-earnings-releases",
    "JPM": "https://www.jpmorganchase.com/ir/quarterly-earnings",
    "MSFT": "https://www.microsoft.com/en-us/investor/earnings/fy-2025-q4",
    "NKE": "https://s1.q4cdn.com/806093406/files/doc_downloads/2025/07/nike-inc-q4-fy24-earnings-release.pdf",
    "UNH": "https://www.unitedhealthgroup.com/content/unh/en/investors/financial-information/sec-filings.html",
    "PG": "https://www.pg.com/investors/financial-reporting/index.shtml",
    "V": "https://investor.visa.com/financial-information/quarterly-earnings",
    "WMT": "https://corporate.walmart.com/news/category/financial-news",
    "HON": "https://investor.honeywell.com/~/media/Files/H/Honeywell-V2-IR/financial-reports/quarterly-results/2025/q2-earnings-release-2025.pdf",
}

# Pages under an investor page that may hold its reports, and titles of pages that are not there
NAVIGATION_PATHS = [
    "/financials/quarterly-earnings", "/financials/quarterly-earnings/", "/en-us/investor/earnings",
    "/en-us/investor/earnings/fy-2025-q4", "/en-us/investor/earnings/fy-2025-q4/", "/en-us/Investor/sec-filings",
    "/en-us/investor/sec-filings", "/investors/news-events-and-reports", "/investors/news-events-and-reports/?toggle=earnings",
    "/investor/financial-reporting", "/financial-info/financial-results", "/ir/quarterly-earnings",
    "/events-and-presentations/presentations", "/investors/financials", "/quarterly-earnings", "/earnings", "/financial-reporting",
    "/sec-filings", "/investor/earnings", "/investors/earnings", "/investors/financial-reporting", "/quarterly-results",
    "/quarterly-reports", "/financial-reports", "/earnings-materials", "/financial-documents", "/earnings-releases",
    "/press-releases", "/financial-information", "/investor-relations", "/financial-information/quarterly-results",
    "/financial-information/quarterly-earnings", "/financial-information/earnings-releases",
]
NAVIGATION_FAILED = ["not found", "error", "404", "403", "forbidden"]
BUTTON_WORDS = ["download", "pdf", "earnings", "financial-report"]
FALLBACK_WORDS = ["earnings", "financial", "report", "results", "filing"]
SPELLINGS = {"Q[1-4]": ["Q1", "Q2", "Q3", "Q4"]}
VIEWER_TERMS = [".pdf", "download", "filing", "doc_financials"]

# PDF links
PDF_TERMS = ["earnings", "financial", "quarterly", "q1", "q2", "q3", "q4", "10-q", "results"]
PDF_DOMAINS = ["q4cdn", "sec.gov", "investor", "ir."]
PDF_GENERIC = ["download", "click", "here", "view"]
THIRD_PARTIES = ["spglobal.com", "moodys.com", "fitchratings.com", "bloomberg.com", "reuters.com", "morningstar.com", "sec.gov"]
CALENDAR_TERMS = ["webcast.ics", ".ics", "add-to-calendar", "calendar.ics"]
CALENDAR_ALLOWED = [".pdf", "doc_financials", "transcript"]
EVENT_TERMS = ["event-details", "conference-call", "webcast"]

# Whole-page scan and keyword search
PAGE_INDICATORS = [
    "q2 2025 earnings", "q3 2025 earnings", "q4 2025 earnings", "q1 2025 earnings", "second quarter 2025", "third quarter 2025",
    "fourth quarter 2025", "first quarter 2025", "second quarter results", "quarterly results", "earnings presentation",
    "earnings release", "press release", "financial results", "quarterly earnings", "july 31, 2025", "jul 24, 2025",
    "aug 21, 2025", "07/29/2025", "fy25 q4", "fiscal 2025", "fiscal quarter", "quarterly-earnings", "financial-reporting",
    "events-and-presentations", "sec filings", "earnings conference call", "investor presentation",
]
HIGH_KEYWORDS = [
    "earnings release", "quarterly earnings", "quarterly results", "q2 2025", "second quarter 2025", "earnings presentation",
    "financial results", "10-q", "press release",
]
MEDIUM_KEYWORDS = ["earnings", "quarterly", "financial", "investor", "10-k"]
# Words of single companies; a keyword search adds each with "earnings" and each with "quarterly"
TICKER_KEYWORDS = {
    "AMGN": [
        "amgen", "biotechnology", "pharmaceuticals", "financials", "quarterly-earnings", "static-files", "earnings-presentation", "pdf", "q2-2025",
    ],
    "MSFT": [
        "microsoft", "fy-2025-q4", "press-release-webcast", "sec-filings", "investor", "earnings", "income-statements", "financial-statements",
    ],
    "NKE": ["nike", "news-events-and-reports", "quarterly-earnings", "fiscal-2025", "q4-fy2025", "earnings-announcement", "investor-news"],
    "IBM": ["ibm", "financial-reporting", "earnings-2q25", "second-quarter", "press-release"],
    "INTC": ["intel", "financial-results", "earnings-conference-call", "press-releases", "q2-2025", "financial-results"],
    "JPM": ["jpmorgan", "jpmorganchase", "quarterly-earnings", "investor-relations", "earnings-pdf", "second-quarter"],
    "HON": ["honeywell", "presentations", "events-and-presentations", "earnings-presentation", "static-files", "quarterly-results"],
    "WMT": ["walmart", "earnings-release", "earnings-presentation", "fy26-q2", "corporate"],
    "CAT": ["caterpillar", "machinery", "construction", "cat inc"],
    "DIS": ["disney", "entertainment", "media", "walt disney"],
    "GS": ["goldman sachs", "investment banking", "financial services"],
    "CVX": ["chevron", "oil", "energy", "petroleum"],
    "MMM": ["3m", "mmm", "industrial", "materials"],
    "PG": ["procter gamble", "consumer goods", "household products"],
}
# Date spellings that a page's text is searched for
PAGE_DATES = [
    r"(july|august|september|october|november|december)\s+\d{1,2},?\s+2025", r"q[1-4]\s+2025", r"2025\s+q[1-4]", r"fiscal\s+2025", r"fy\s*2025",
    r"\d{2}/\d{2}/2025",
]
# Pages that are looked at when nothing else finds a company's reports, in order
FIXED_PAGES = {
    "AMZN": ["https://ir.aboutamazon.com/quarterly-results", "https://ir.aboutamazon.com/sec-filings"],
    "AMGN": ["https://investors.amgen.com/financials/sec-filings", "https://investors.amgen.com/financials/quarterly-results"],
    "CVX": ["https://investor.chevron.com/financial-information/quarterly-earnings", "https://investor.chevron.com/sec-filings"],
    "GS": ["https://investor.goldmansachs.com/financial-information/quarterly-earnings", "https://investor.goldmansachs.com/financials"],
    "JPM": ["https://ir.jpmorganchase.com/financial-information/quarterly-earnings", "https://ir.jpmorganchase.com/sec-filings"],
    "V": ["https://investor.visa.com/financial-information/quarterly-earnings", "https://investor.visa.com/sec-filings"],
    "WMT": ["https://corporate.walmart.com/news/financials/quarterly-earnings-reports", "https://corporate.walmart.com/financials"],
    "HON": ["https://investor.honeywell.com/financial-information/quarterly-results", "https://investor.honeywell.com/financials/quarterly-earnings"],
    "MSFT": ["https://www.microsoft.com/investor/earnings/fy-2025-q4/", "https://www.microsoft.com/investor/sec-filings"],
    "UNH": ["https://www.unitedhealthgroup.com/investor/financial-information/quarterly-results", "https://investors.unitedhealthgroup.com/quarterly-earnings"],
    "PG": ["https://us.pg.com/investor/financial-information/quarterly-results", "https://pginvestor.com/quarterly-earnings"],
    "MMM": ["https://investors.3m.com/financial-information/quarterly-results", "https://investors.3m.com/quarterly-earnings"],
    "DIS": ["https://www.thewaltdisneycompany.com/investors/financial-information/quarterly-results", "https://thewaltdisneycompany.com/investor-relations/financials"],
    "DOW": ["https://investors.dow.com/financial-information/quarterly-results", "https://investors.dow.com/quarterly-earnings"],
    "CAT": ["https://www.caterpillar.com/investors/financial-information/quarterly-results", "https://investors.caterpillar.com/quarterly-earnings"],
}

# Page patterns
PATH_TERMS = ["report", "earning", "financial", "quarterly", "annual"]
PATH_SEGMENTS = ["202", "upload", "document", "file"]
NAME_TERMS = ["earning", "financial", "report", "quarter", "annual"]
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERNS = [
    r"Q[1-4]\s+(?:FY\s*)?20\d{2}",
    rf"(?:{MONTHS})\s+\d{{1,2}},?\s+20\d{{2}}",
    r"\d{1,2}/\d{1,2}/20\d{2}",
    r"20\d{2}-\d{2}-\d{2}",
    r"FY\s*20\d{2}",
]

# Files
HTML_MARKS = ["<!doctype", "<html>", "<body>", "<head>", "</html>", "<div", "<script"]
ERROR_MARKS = ["404", "not found", "access denied", "forbidden", "error", "page not found"]
CONTENT_TERMS = ["revenue", "earnings", "quarter", "financial"]


@dataclass(frozen=True)
class EngineParams:
    """What a run depends on besides its tables. as_of stands for today; nothing reads the clock."""

    as_of: str = "2025-10-10"
    future_after: tuple[int, int, int] = (2025, 10, 9)
    base_year: int = 2025
    companies: list[str] = field(default_factory=list)
    workers: int = 8

    @property
    def year(self) -> int:
        return int(self.as_of[:4])

    @property
    def month(self) -> int:
        return int(self.as_of[5:7])

    @classmethod
    def from_env(cls, env=os.environ) -> EngineParams:
        names = [x.strip() for x in env.get("QUARTERLENS_COMPANIES", "").split(",") if x.strip()]
        return cls(
            as_of=env.get("QUARTERLENS_AS_OF", cls.as_of), companies=names, workers=int(env.get("QUARTERLENS_WORKERS", "8"))
        )

    def problems(self) -> list[str]:
        """Errors of the configuration, all of them."""
        known = {c[0] for c in COMPANIES}
        out = [f"unknown company: {c}" for c in self.companies if c not in known]
        if self.workers < 1:
            out.append("workers must be at least 1")
        if len(self.as_of) != 10:
            out.append("as_of must be an ISO date")
        return out
