"""DuckDB SQL for the further queries."""

from __future__ import annotations

from .. import params as P
from . import lists as W
from .oracle import _NAMED, CLASSED, CONFIDENCE, PDF, PRIORITY, SCORE, SQL, STRIP, VALID, A, E, L, _page, _valid_by_url, has, ir_url, quote


def listed(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


# searches
_companies = ", ".join(f"({i}::BIGINT, {quote(t)}, {quote(u)})" for i, (t, _, u) in enumerate(P.COMPANIES))
COMPANIES = f"co(company_id, ticker, url) AS (VALUES {_companies})"
_host = "lower(split_part(url, '/', 3))"
_bare = f"replace({_host}, 'www.', '')"
_first = f"split_part({_bare}, '.', 1)"
_candidates = (
    f"['https://ir.about' || {_first} || '.com/', 'https://investors.' || {_bare} || '/', 'https://investor.' || {_bare} || '/', 'https://ir.' || {_bare} || '/', "
    f"'https://corporate.' || {_bare} || '/investor/', 'https://www.' || {_bare} || '/investor/', 'https://www.' || {_bare} || '/investors/', "
    f"'https://finance.' || {_bare} || '/', 'https://sec.' || {_bare} || '/']"
)
_spelled = ", ".join(f"({3 * i + k}, {quote(s)})" for i, w in enumerate(P.IR_LINK_WORDS) for k, s in enumerate((w.title(), w.upper(), w)))
_words = ", ".join(f"({i}, {quote(w)})" for i, w in enumerate(P.IR_LINK_WORDS))
_hrefs = ", ".join(f"({i}, {quote(w)})" for i, w in enumerate(P.IR_HREF_WORDS))
_known = ", ".join(f"({quote(t)}, {quote(u)})" for t, u in P.IR_KNOWN.items())
_about = has("t", P.IR_LINK_WORDS)
SQL["discover_ir"] = f"""{L}, {COMPANIES},
n AS (SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY link_id) - 1 AS ord, link_id,
  CASE WHEN link_id % 4 = 0 THEN upper(text) ELSE text END AS text, CASE WHEN link_id % 11 = 0 THEN 'nav' WHEN link_id % 13 = 0 THEN 'footer' ELSE '' END AS area,
  CASE WHEN link_id % 3 = 0 THEN replace(url, '/doc-', '/investors/') ELSE url END AS h FROM l),
k AS (SELECT company_id, ord, text, area, CASE WHEN company_id % 5 = 3 OR (company_id % 5 = 2 AND area <> 'nav') THEN regexp_replace(h, '^https://[^/]*', '') ELSE h END AS href FROM n),
f AS (SELECT *, lower(text) AS t, lower(href) AS u FROM k), g AS (SELECT *, {ir_url('u', 'href')} AS valid, {CONFIDENCE} AS conf FROM f),
met AS (SELECT company_id, 3 AS stage, 0 AS word, ord, href, valid, conf FROM g WHERE ({_about} OR {has('u', P.IR_LINK_WORDS)}) AND NOT contains(href, 'javascript:') AND ord < 100
  UNION ALL SELECT company_id, 4, i, ord, href, valid, 0 FROM g JOIN (VALUES {_spelled}) v(i, s) ON contains(text, s)
  UNION ALL SELECT company_id, 5, i, ord, href, valid, 0 FROM g JOIN (VALUES {_words}) v(i, s) ON contains(t, s)
  UNION ALL SELECT company_id, 6, i, ord, href, valid, 0 FROM g JOIN (VALUES {_hrefs}) v(i, s) ON contains(href, s)),
few AS (SELECT *, row_number() OVER (PARTITION BY company_id, stage, word ORDER BY conf DESC, ord) AS nth FROM met QUALIFY nth <= CASE stage WHEN 3 THEN 3 WHEN 6 THEN 5 ELSE 1 END),
crawled AS (SELECT ({_candidates})[(company_id % 9 + 1)::INT] AS url FROM co WHERE company_id % 4 = 1),
every AS (SELECT company_id, 1 AS stage, 0 AS place, v.u AS found FROM co JOIN (VALUES {_known}) v(t, u) ON co.ticker = v.t
  UNION ALL SELECT company_id, 2, c.i, c.found FROM (SELECT company_id, unnest(range(9)) AS i, unnest({_candidates}) AS found FROM co) c
    WHERE c.found IN (SELECT url FROM crawled) AND (company_id % 8 <> 1 OR {has('lower(c.found)', ['investors.', 'investor.', 'ir.', '/investor', '/investors', '/ir'])})
  UNION ALL SELECT company_id, stage, word * 10 + nth, href FROM few WHERE valid
  UNION ALL SELECT company_id, CASE area WHEN 'nav' THEN 7 ELSE 8 END, ord, href FROM g WHERE area <> '' AND {_about} AND valid
  UNION ALL SELECT company_id, 9, 0, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/investor' FROM co)
SELECT company_id, arg_min(stage, (stage, place, found)) AS stage, arg_min(found, (stage, place, found)) AS found FROM every GROUP BY 1"""
_paths = listed(P.NAVIGATION_PATHS)
NAVIGATION = f"""{L}, co AS (SELECT unnest(range(30)) AS i), pa AS (SELECT i, unnest(range(33)) AS j, unnest({_paths}) AS path FROM co),
there AS (SELECT i, j, 'https://c' || i || '.example.com/ir' || path AS page FROM pa WHERE (i * 7 + j) % 3 = 0 AND (i + j) % 11 <> 0),
shown AS (SELECT 'https://c' || company_id || '.example.com/ir' || {_paths}[(link_id % 33 + 1)::INT] AS page, (link_id // 33) % 40 AS ord, CASE WHEN link_id % 4 = 0 THEN 'Webcast' ELSE text END AS text, regexp_replace(url, '/doc-[0-9]+', '/doc') AS url FROM l),
nav AS (SELECT i AS company_id, url, text, j AS path_ord, ord FROM there JOIN shown USING (page) WHERE ord < 30)"""
SQL["navigation_links"] = f"{NAVIGATION} SELECT company_id, url, path_ord, ord FROM nav"
# the class and validity of a link, over any relation with t, u, c
_classed = CLASSED[CLASSED.index(", k AS (") :].replace("FROM l)", "FROM l2)")
SQL["navigation_reports"] = f"""{NAVIGATION}, l2 AS (SELECT *, lower(text) AS t, lower(url) AS u, lower(text || ' ' || url) AS c FROM nav){_classed}
SELECT company_id, url, path_ord, ord, label, 'navigation_paths' AS strategy, 0.9::DOUBLE AS score FROM cl WHERE isreport AND {VALID} AND text <> '' QUALIFY row_number() OVER (PARTITION BY company_id, url ORDER BY path_ord, ord, text) = 1"""
BODIES = "b AS (SELECT page_id, html || ' in Q3 2025 see https://investors.example.com/2025/q3/doc-' || page_id || '.pdf, or the report at ' || url AS body FROM pages)"


def _near(words) -> str:
    w = ", ".join(f"({i}, {quote(x)})" for i, x in enumerate(words))
    valid = VALID.replace("(t || u)", "u").replace("(c,", "(u,")
    return f"""{BODIES}, w(rank, word) AS (VALUES {w}),
s AS (SELECT page_id, rank, word, body, string_split_regex(body, '(?i)' || word) AS gaps, regexp_extract_all(body, '(?i)' || word) AS hits FROM b, w),
x AS (SELECT *, unnest(range(1, least(5, len(hits)) + 1)) AS i FROM s),
y AS (SELECT page_id, rank, word, body, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda v: length(v))), 0))::INT AS place FROM x),
z AS (SELECT page_id, rank, word, hit, place, unnest(regexp_extract_all(substring(body, greatest(place - 200, 0) + 1, place + length(hit) + 200 - greatest(place - 200, 0)), 'https?://[^\\s<>"]{{10,}}')) AS found_url FROM y),
o AS (SELECT *, {valid} AS valid FROM (SELECT *, lower(found_url) AS u FROM z))"""


SQL["context_urls"] = f"WITH {_near(['investor', 'report', 'Q[1-4]'])} SELECT page_id, word, hit, place, found_url, valid FROM o"
SQL["fallback_reports"] = f"""WITH {_near(['2025', '2024', 'Q[1-4]', 'earnings', 'financial', 'report', 'results', 'filing'])}
SELECT page_id, rank, place, found_url AS url, hit AS text, 5.0::DOUBLE AS priority, '2025_fallback' AS year, 'fallback' AS type, 'fallback_search' AS strategy, 0.3::DOUBLE AS score FROM o WHERE valid"""
SQL["first_valid_pdf"] = f"""{L}, p AS (SELECT company_id, link_id, ({PDF})::BIGINT AS score FROM l WHERE contains(u, '.pdf')),
r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, link_id) AS place FROM p QUALIFY place <= 3)
SELECT company_id, arg_min(link_id, place) AS link_id, min(place) AS place, arg_min(score, place) AS score FROM r WHERE link_id % 3 <> 0 GROUP BY 1"""

# pages as trees: the tokens of each page one after the other, with the open elements as a list
_HREF = """(?is)\\shref\\s*=\\s*(?:"([^"]*)"|'([^']*)'|([^\\s"'>]+))"""
_token = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>"
    r"""|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|<[!?/][^>]*>|[^<]+|<"""
)
_tail = " || page_id || ".join(quote(x) for x in W.TAIL.split("{i}"))
_blocks = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_ends = [(_blocks, ["p"], ["button", "table", "td", "th"]), (["li"], ["li"], ["ul", "ol"]), (["dt", "dd"], ["dt", "dd"], ["dl"]), (["td", "th"], ["td", "th"], ["tr", "table"]),
         (["tr"], ["tr"], ["table"]), (["option"], ["option"], ["select"])]


def _innermost(names) -> str:
    return f"coalesce(list_max(list_filter(range(1, len(w.names) + 1), lambda j: list_contains({names}, w.names[j]))), 0)"


_cut = "CASE WHEN k.kind = 'close' THEN " + _innermost("[k.name]") + "".join(
    f" WHEN list_contains({listed(tags)}, k.name) AND {_innermost(listed(ended))} > {_innermost(listed(stops))} THEN {_innermost(listed(ended))}" for tags, ended, stops in _ends
) + " ELSE 0 END"


def decoded(x: str) -> str:
    for name, c in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {quote(c)})"
    return x


def attribute(name: str, of: str = "tok") -> str:
    pattern = quote(_HREF.replace("href", name))
    return decoded(f"CASE WHEN regexp_matches({of}, {pattern}) THEN regexp_extract({of}, {pattern}, 1) || regexp_extract({of}, {pattern}, 2) || regexp_extract({of}, {pattern}, 3) END")


TREE = f"""WITH RECURSIVE src AS (SELECT page_id, url, html || {_tail} AS html FROM pages),
tok AS (SELECT page_id, url, unnest(toks) AS tok, unnest(range(len(toks)))::INT AS pos FROM (SELECT page_id, url, regexp_extract_all(html, {quote(_token)}) AS toks FROM src)),
k AS (SELECT *, lower(regexp_extract(tok, '(?is)^</?([a-z][^\\s/>]*)', 1)) AS name, CASE WHEN regexp_matches(tok, '(?is)^<[!?]') THEN 'skip' WHEN regexp_matches(tok, '(?is)^</[a-z]') THEN 'close'
  WHEN regexp_matches(tok, '(?is)^<(script|style|title)\\b') THEN 'raw' WHEN regexp_matches(tok, '(?is)^<(br|meta|img|hr|link|input)\\b') THEN 'void' WHEN regexp_matches(tok, '(?is)^<[a-z]') THEN 'open' ELSE 'text' END AS kind FROM tok),
w AS (SELECT page_id, -1 AS pos, ''::VARCHAR AS kind, ''::VARCHAR AS name, []::VARCHAR[] AS names, []::INT[] AS pres, []::INT[] AS kept, 0 AS n FROM src
  UNION ALL SELECT page_id, pos, kind, name, CASE WHEN kind = 'open' THEN list_append(left_names, name) ELSE left_names END, CASE WHEN kind = 'open' THEN list_append(left_pres, n) ELSE left_pres END, left_pres,
    n + CASE WHEN kind IN ('open', 'void', 'raw') THEN 1 ELSE 0 END FROM
    (SELECT *, CASE WHEN cut > 0 THEN old_names[:cut - 1] ELSE old_names END AS left_names, CASE WHEN cut > 0 THEN old_pres[:cut - 1] ELSE old_pres END AS left_pres FROM
      (SELECT k.page_id, k.pos, k.kind, k.name, w.names AS old_names, w.pres AS old_pres, w.n, {_cut} AS cut FROM w JOIN k ON k.page_id = w.page_id AND k.pos = w.pos + 1))),
ev AS (SELECT w.*, k.tok, k.url, n - CASE WHEN w.kind IN ('open', 'void', 'raw') THEN 1 ELSE 0 END AS before FROM w JOIN k ON k.page_id = w.page_id AND k.pos = w.pos),
el0 AS (SELECT page_id, url, before AS pre, pos, kind, name AS tag, CASE WHEN kind = 'raw' THEN regexp_extract(tok, '^<[^>]*>') ELSE tok END AS tok, coalesce(kept[-1], -1) AS parent, len(kept) AS depth, kept FROM ev WHERE kind IN ('open', 'void', 'raw')),
fin AS (SELECT el0.page_id, el0.pre, min(ev.pos) AS upto, min(ev.before) AS next FROM el0 JOIN ev ON ev.page_id = el0.page_id AND ev.pos > el0.pos AND NOT list_contains(ev.kept, el0.pre) WHERE el0.kind = 'open' GROUP BY 1, 2),
whole AS (SELECT page_id, max(n) AS n, max(pos) AS pos FROM ev GROUP BY 1),
el AS (SELECT el0.*, CASE WHEN kind = 'open' THEN coalesce(fin.next, whole.n) - 1 ELSE el0.pre END AS last, CASE WHEN kind = 'open' THEN coalesce(fin.upto, whole.pos + 1) ELSE el0.pos + 1 END AS upto,
  row_number() OVER (PARTITION BY el0.page_id, tag ORDER BY el0.pre) - 1 AS nth FROM el0 JOIN whole ON whole.page_id = el0.page_id LEFT JOIN fin ON fin.page_id = el0.page_id AND fin.pre = el0.pre),
says AS (SELECT page_id, pos, kept, {decoded("CASE WHEN kind = 'raw' THEN regexp_extract(tok, '(?is)^<title[^>]*>(.*?)</title', 1) ELSE tok END")} AS said FROM ev WHERE kind = 'text' OR (kind = 'raw' AND name = 'title')),
ad AS (SELECT el.*, {attribute('href')} AS href, {attribute('onclick')} AS onclick, {attribute('class')} AS cls, {attribute('role')} AS role, {attribute('id')} AS ident FROM el),
tx AS (SELECT ad.page_id, ad.pre, {STRIP.format("coalesce(string_agg(said, '' ORDER BY says.pos), '')")} AS text FROM ad LEFT JOIN says ON says.page_id = ad.page_id AND says.pos >= ad.pos AND says.pos < ad.upto GROUP BY 1, 2),
o AS (SELECT ad.*, text FROM ad JOIN tx ON tx.page_id = ad.page_id AND tx.pre = ad.pre)"""
_page_links = "a AS (SELECT page_id, url, nth AS ord, nullif(href, '') AS href, text FROM o WHERE tag = 'a')"
SQL["page_links"] = f"{TREE}, {_page_links} SELECT page_id, ord::INT AS ord, href, text FROM a WHERE ord < 200"
SQL["pdf_links"] = f"{TREE}, {_page_links} SELECT page_id, count(*) AS n_links, count(*) FILTER (contains(lower(href), '.pdf')) AS n_pdf FROM a GROUP BY 1"


def full(x: str) -> str:
    return f"CASE WHEN {x} LIKE '/%' THEN split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || {x} WHEN {x} LIKE 'http%' THEN {x} END"


SQL["absolutised_links"] = f"{TREE}, {_page_links} SELECT page_id, ord::INT AS ord, {full('href')} AS full FROM a WHERE href LIKE '/%' OR href LIKE 'http%'"


def inside(*ancestors: str) -> str:
    """Whether an element (x) lies within one that fits, within one that fits and so on, from the outermost."""
    on = "true"
    for k, a in enumerate(ancestors):
        on = f"EXISTS (SELECT 1 FROM ad y{k} WHERE y{k}.page_id = x.page_id AND y{k}.pre < x.pre AND x.pre <= y{k}.last AND {a.replace('y.', f'y{k}.')} AND {on.replace('x.', f'y{k}.')})"
    return on


_classed_as = lambda c, of="y": f"list_contains(string_split_regex(coalesce({of}.cls, ''), '\\s+'), {quote(c)})"
_menus = " OR ".join(["y.tag IN ('nav', 'header')", *map(_classed_as, ["navigation", "menu", "nav-menu"])])
SQL["area_links"] = f"""{TREE}, a AS (SELECT page_id, 'page' AS area, nullif(href, '') AS href FROM o WHERE tag = 'a'
  UNION ALL SELECT page_id, 'nav', nullif(href, '') FROM o x WHERE tag = 'a' AND {inside(f'({_menus})')}
  UNION ALL SELECT page_id, 'footer', nullif(href, '') FROM o x WHERE tag = 'a' AND {inside("y.tag = 'footer' AND y.nth = 0")})
SELECT page_id, area, count(*) AS n, max(href) AS last FROM a GROUP BY 1, 2"""
_click = [
    ("a", "tag = 'a'"), ("button", "tag = 'button'"), ("div[onclick]", "tag = 'div' AND onclick IS NOT NULL"), ("span[onclick]", "tag = 'span' AND onclick IS NOT NULL"),
    ("[role=button]", "role = 'button'"), ("[class*=button]", "contains(cls, 'button')"), ("[class*=link]", "contains(cls, 'link')"), ("[href]", "href IS NOT NULL"),
    ("[onclick]", "onclick IS NOT NULL"), ("[class*=download]", "contains(cls, 'download')"),
]
CLICK = "ck AS (" + " UNION ALL ".join(f"SELECT {k} AS rank, {quote(n)} AS selector, coalesce(nullif(href, ''), onclick, '') AS address, * FROM o WHERE {c}" for k, (n, c) in enumerate(_click)) + ")"
SQL["clickable_elements"] = f"{TREE}, {CLICK} SELECT page_id, rank, selector, pre, tag, address, text FROM ck"


_label = CLASSED[CLASSED.index(", k AS (") :]


def reports(rows: str, by_text: bool = True) -> str:
    """CTEs k and cl over the rows (url, text): valid reports with their label."""
    seen = "text" if by_text else "''"
    valid = VALID.replace("(t || u)", "(vt || u)").replace("(c,", "(vc,")
    made = f"(SELECT *, lower(text) AS t, lower(url) AS u, lower(text || ' ' || url) AS c, lower({seen}) AS vt, lower({seen} || ' ' || url) AS vc FROM ({rows}))"
    return f"(WITH l AS {made}{_label} SELECT * FROM cl WHERE isreport AND {valid})"


_like = lambda tag, w: f"x.tag = '{tag}' AND contains(lower(x.cls), '{w}')"
_discovery = [
    *[(f"div[class*={w}]", _like("div", w)) for w in ("report", "filing", "earning")], *[(f"section[class*={w}]", _like("section", w)) for w in ("financial", "investor")],
    ("table tr td a", f"x.tag = 'a' AND {inside(chr(121) + '.tag = ' + quote('table'), 'y.tag = ' + quote('tr'), 'y.tag = ' + quote('td'))}"),
    ("ul li a", f"x.tag = 'a' AND {inside('y.tag = ' + quote('ul'), 'y.tag = ' + quote('li'))}"), ("dl dd a", f"x.tag = 'a' AND {inside('y.tag = ' + quote('dl'), 'y.tag = ' + quote('dd'))}"),
    *[(f".{c} a", f"x.tag = 'a' AND {inside(_classed_as(c))}") for c in ("content", "main", "primary")], ("#main a", f"x.tag = 'a' AND {inside('y.ident = ' + quote('main'))}"),
]
_found = " UNION ALL ".join(f"SELECT {k} AS rank, {quote(n)} AS selector, row_number() OVER (PARTITION BY page_id ORDER BY pre) AS place, * FROM o x WHERE {c}" for k, (n, c) in enumerate(_discovery))
SQL["dynamic_discovery"] = f"""{TREE}, fd AS ({_found}), lk AS (SELECT page_id, selector, place, text, {full('href')} AS url FROM fd WHERE place <= 50 AND (href LIKE '/%' OR href LIKE 'http%'))
SELECT page_id, selector, place, url, text, label, round(score, 4) AS score FROM (SELECT *, {SCORE} AS score FROM {reports('SELECT * FROM lk')}) WHERE score > 0.2"""
_button_words = ["download", "pdf", "earnings", "financial-report"]
SQL["pdf_candidates"] = f"""{TREE}, flat AS (SELECT ad.page_id, ad.pre, coalesce(string_agg({STRIP.format('said')}, '' ORDER BY says.pos), '') AS said FROM ad LEFT JOIN says ON says.page_id = ad.page_id AND says.pos >= ad.pos AND says.pos < ad.upto GROUP BY 1, 2),
e AS (SELECT ad.*, said FROM ad JOIN flat ON flat.page_id = ad.page_id AND flat.pre = ad.pre),
fl AS (SELECT page_id, pre, said, href AS h, CASE WHEN href LIKE '/%' THEN split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || href ELSE href END AS address FROM e WHERE tag = 'a' AND contains(lower(href), '.pdf')),
bl AS (SELECT * FROM e x WHERE tag IN ('button', 'div', 'span') AND cls IS NOT NULL AND ({has("lower(cls)", _button_words)} OR {has("lower(said)", _button_words)})),
nr AS (SELECT page_id, 1 AS pass, pre AS a, 0 AS b, pre AS c, address AS url, said AS text FROM fl WHERE h LIKE '/%' OR h LIKE 'http%'
  UNION ALL SELECT bl.page_id, 2, bl.pre, 0, fl.pre, address, CASE WHEN bl.said <> '' THEN bl.said ELSE fl.said END FROM bl JOIN fl ON fl.page_id = bl.page_id AND fl.pre > bl.pre AND fl.pre <= bl.last
  UNION ALL SELECT bl.page_id, 2, bl.pre, 1, fl.pre, address, CASE WHEN bl.said <> '' THEN bl.said ELSE fl.said END FROM bl LEFT JOIN e up ON up.page_id = bl.page_id AND up.pre = bl.parent JOIN fl ON fl.page_id = bl.page_id AND (bl.parent < 0 OR (fl.pre > up.pre AND fl.pre <= up.last)))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pass, a, b, c) - 1)::INT AS ord, pass, url, text FROM nr"""
_months = "july|august|september|october|november|december"
_dates = [rf"(?:{_months})\s+\d{{1,2}},?\s+2025", r"q[1-4]\s+2025", r"2025\s+q[1-4]", r"fiscal\s+2025", r"fy\s*2025", r"\d{2}/\d{2}/2025"]
_date_list = ", ".join(f"({k}, {quote(d)})" for k, d in enumerate(_dates))
_own = f"ow AS (SELECT o.*, (SELECT arg_min(said, says.pos) FROM says WHERE says.page_id = o.page_id AND says.kept[-1] = o.pre AND says.pos > o.pos) AS own FROM o WHERE kind = 'open')"
_up = lambda c: f"CASE WHEN coalesce(x.{c}, '') <> '' THEN x.{c} WHEN x.{c} IS NULL AND coalesce(y.{c}, '') <> '' THEN y.{c} END"
_above = lambda c: f"CASE WHEN coalesce(x.{c}, '') <> '' THEN 0 WHEN x.{c} IS NULL AND coalesce(y.{c}, '') <> '' THEN 1 END"
DATED = f"""{_own}, nr AS (SELECT x.*, coalesce({_up('href')}, {_up('onclick')}) AS address, coalesce({_above('href')}, {_above('onclick')})::INT AS above
  FROM ow x LEFT JOIN o y ON y.page_id = x.page_id AND y.pre = x.parent WHERE {' OR '.join(f"regexp_matches(lower(x.own), {quote(d)})" for d in _dates)})"""
SQL["date_hits"] = f"{TREE}, {DATED} SELECT page_id, pre, tag, own, address, above FROM nr"
_indicators = ", ".join(f"({k}, {quote(w)})" for k, w in enumerate(W.PAGE_INDICATORS))
SQL["page_scan"] = f"""{TREE}, {CLICK}, {DATED}, ind(which, word) AS (VALUES {_indicators}), dt(rank, pattern) AS (VALUES {_date_list}),
bd AS (SELECT page_id, which, word FROM o, ind WHERE tag = 'body' AND contains(lower(text), word)),
g AS (SELECT ck.page_id, any_value({full('address')}) AS url, any_value(text) AS text, 1 AS pass, arg_min(word, which) AS matched, rank, 0 AS first, pre, 0.95::DOUBLE AS sc FROM ck JOIN bd ON bd.page_id = ck.page_id
  AND (contains(lower(text), word) OR contains(lower(text), replace(word, ' ', '')) OR contains(lower(address), replace(word, ' ', '-'))) WHERE address LIKE '/%' OR address LIKE 'http%' GROUP BY ck.page_id, rank, pre),
h0 AS (SELECT DISTINCT nr.page_id, nr.pre, dt.rank, unnest(regexp_extract_all(lower(own), pattern)) AS matched FROM nr, dt),
h AS (SELECT *, min(pre) OVER (PARTITION BY page_id, rank, matched) AS first FROM h0 QUALIFY row_number() OVER (PARTITION BY page_id, rank, matched ORDER BY pre) <= 5),
b AS (SELECT h.page_id, {full('address')} AS url, text, 2 AS pass, matched, rank, first, h.pre, 0.9::DOUBLE AS sc FROM h JOIN nr ON nr.page_id = h.page_id AND nr.pre = h.pre WHERE address LIKE '/%' OR address LIKE 'http%'),
every AS (SELECT * FROM {reports('SELECT * FROM g')} UNION ALL SELECT * FROM {reports('SELECT * FROM b', False)})
SELECT page_id, url, text, pass, matched, label, sc AS score FROM every QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pass, rank, first, pre, matched) = 1"""
# searches of a company's links
_year = lambda c: f"CASE WHEN link_id % 3 = 0 THEN replace({c}, '2022', '2025') ELSE {c} END"
SEARCH = f"""sl AS (SELECT company_id, link_id, ticker, nth, CASE WHEN company_id % 5 = 2 AND nth <= 100 THEN CASE WHEN link_id % 2 = 0 THEN 'Quarterly report' ELSE 'Other 2025 report' END WHEN link_id % 11 = 0 THEN '' ELSE {_year('text')} END AS text,
  CASE WHEN link_id % 7 = 0 AND company_id % 5 <> 2 THEN replace({_year('url')}, '/doc-', '/investment-banking-' || lower(ticker) || '-earnings-release-') ELSE {_year('url')} END AS url
  FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY link_id) AS nth FROM l))"""
_all_words = ", ".join(f"({k}, NULL, {quote(w)})" for k, w in enumerate(W.HIGH_KEYWORDS))
_mine = ", ".join(f"({1000 + k + 500 * j}, {quote(t)}, {quote(f'{w} {more}')})" for t, ws in W.TICKER_KEYWORDS.items() for j, more in enumerate(("earnings", "quarterly")) for k, w in enumerate(ws))
_broad = "(0, 'earnings'), (1, 'quarterly'), (2, 'financial')"

def keyword_ctes(rel: str) -> str:
    """kr: the reports that the keyword search finds among rel (company_id, link_id, ticker, nth, text, url)."""
    medium = f"SELECT r.* EXCLUDE (ticker), word, keyword FROM {rel} r JOIN br ON contains(lower(text), keyword) WHERE nth <= 30 AND company_id NOT IN (SELECT company_id FROM hk GROUP BY 1 HAVING count(*) >= 2)"
    return f"""kw(word, of, keyword) AS (VALUES {_all_words}, {_mine}), br(word, keyword) AS (VALUES {_broad}),
f AS (SELECT r.*, word, keyword FROM {rel} r JOIN kw ON of IS NULL OR of = ticker WHERE nth <= 50 AND text <> '' AND (contains(lower(text), keyword) OR contains(lower(url), replace(keyword, ' ', '-')))),
hi AS (SELECT *, 0.8::DOUBLE + CASE WHEN contains(lower(text || ' ' || url), '2025') THEN 0.1 ELSE 0.0 END + CASE WHEN contains(lower(url), 'pdf') THEN 0.1 ELSE 0.0 END AS sc FROM {reports('SELECT * EXCLUDE (ticker) FROM f')}),
st0 AS (SELECT company_id, word, min(nth) AS stop FROM hi WHERE sc > 0.9 GROUP BY 1, 2),
hk AS (SELECT hi.* FROM hi LEFT JOIN st0 ON st0.company_id = hi.company_id AND st0.word = hi.word WHERE stop IS NULL OR nth <= stop),
md AS (SELECT *, 0.4::DOUBLE AS sc FROM {reports(medium)}),
kr AS (SELECT * FROM (SELECT 1 AS tier, * FROM hk UNION ALL SELECT 2, * FROM md) QUALIFY row_number() OVER (PARTITION BY company_id, url ORDER BY tier, word, nth) = 1)"""


def learned_ctes(rel: str) -> str:
    """lr: the reports among the first PDF files of rel, under texts from their addresses."""
    name = "regexp_replace(split_part(url, '/', -1), '[-_]', ' ', 'g')"
    return f"""fi AS (SELECT company_id, link_id, url FROM {rel} WHERE nth <= 200 AND contains(lower(url), '.pdf') QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY link_id) <= 20),
fx0 AS (SELECT *, lower(url) AS u, lower(text) AS t, lower(text || ' ' || url) AS c FROM (SELECT *, {name} AS text FROM fi)), fy AS (SELECT * FROM fx0 WHERE {has('u', W.FINANCIAL_URL_WORDS)}),
lr AS (SELECT * FROM (WITH l AS (SELECT * FROM fy){_label} SELECT *, {SCORE} AS sc FROM cl WHERE isreport) WHERE sc > 0.2)"""


SQL["keyword_search"] = f"{L}, {SEARCH}, {keyword_ctes('sl')} SELECT company_id, link_id, tier, keyword, url, label, sc AS score FROM kr"
SQL["learned_reports"] = f"""{L}, {SEARCH}, sm AS (SELECT * REPLACE (replace(url, '/doc-', '/quarterly-report_') AS url) FROM sl), {learned_ctes('sm')}
SELECT company_id, link_id, text, label, round(sc, 4) AS score FROM lr"""


def cascade_sql(main: str, more: str = "") -> str:
    """The cascade over the links m (those of b that fit `main`), and further hits."""
    now = f"NOT {has('u', ['event-details', 'conference-call', 'webcast'])} AND {PRIORITY} >= 0.3"
    return f"""{CLASSED}, b AS (SELECT company_id, link_id, {SCORE} AS score, {VALID} AS ok, ({_page}) AS page,
  {_valid_by_url} AND {has('t', ['2025', '10-q', '10-k', 'latest', 'recent'])} AS sec, {has('u', ['.pdf', '.xlsx', '.xls', 'download', 'filing', 'earnings'])} AND {has('(text || url)', ['2024', '2025'])} AS fb, {now} AS now FROM cl WHERE isreport),
m AS (SELECT * FROM b WHERE {main}), rl AS (SELECT company_id, link_id, ticker, text, url, row_number() OVER (PARTITION BY company_id ORDER BY link_id) AS nth FROM l WHERE {main}),
{keyword_ctes('rl')}, {learned_ctes('rl')},
h AS (SELECT company_id, 1 AS n, 'whole_page_scan' AS strategy, 0.95::DOUBLE AS score, now FROM m WHERE ok AND page UNION ALL SELECT company_id, 2, 'enhanced_keyword_search', sc, {now} FROM kr UNION ALL
  SELECT company_id, 3, 'learned_patterns', sc, {now} FROM lr UNION ALL SELECT company_id, 4, 'comprehensive_scan', score, now FROM m WHERE ok UNION ALL
  SELECT company_id, 6, 'dynamic_discovery', score, now FROM m WHERE ok AND score > 0.2 UNION ALL SELECT company_id, 8, 'fallback_search', 0.7, now FROM m WHERE fb UNION ALL
  SELECT * FROM (SELECT company_id, 7, 'sec_filings', NULL, now FROM m WHERE sec QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY link_id) = 1){more}),
g AS (SELECT company_id, n, count(*) AS hits, count(*) FILTER (now) AS cur FROM h GROUP BY 1, 2),
st AS (SELECT company_id, min(n) AS stop FROM g WHERE (n <= 4 AND hits >= 2 AND cur >= 1) OR hits >= 3 GROUP BY 1)
SELECT h.company_id, strategy, count(*) AS n, round(sum(score), 4) AS score FROM h LEFT JOIN st ON h.company_id = st.company_id WHERE stop IS NULL OR n <= stop GROUP BY 1, 2"""


SQL["strategy_cascade"] = cascade_sql("true")
SQL["cascade_all"] = cascade_sql("link_id % (company_id + 2) <> 0 AND company_id % 3 = 0", """
  UNION ALL SELECT company_id, 5, 'navigation_paths', 0.9, now FROM b WHERE ok AND link_id % 40 = 1 AND company_id % 3 = 1
  UNION ALL SELECT company_id, 8, 'fallback_search', 0.3, false FROM l WHERE link_id % 100 = 2 AND company_id NOT IN (SELECT company_id FROM m WHERE fb)""")
_fixed = ", ".join(f"({quote(t)}, {k}, {quote(u)})" for t, us in W.FIXED_PAGES.items() for k, u in enumerate(us))
SQL["fixed_page_reports"] = f"""{L}, {COMPANIES}, fx(ticker, page_ord, page) AS (VALUES {_fixed}), tr AS (SELECT company_id, page_ord, page FROM co JOIN fx USING (ticker)),
sh AS (SELECT page, (link_id // 50) % 300 AS ord, text, regexp_replace(url, '/20[0-9][0-9]/', '/' || CASE WHEN page_ord = 0 AND l.company_id % 2 = 0 THEN '2023' WHEN link_id % 3 = 0 THEN '2025' ELSE '2021' END || '/') AS url
  FROM l JOIN tr ON tr.company_id = l.company_id AND tr.page_ord = link_id % 2 WHERE link_id % 5 < 2),
hi AS (SELECT company_id, page_ord, ord, url, text FROM tr JOIN sh USING (page) WHERE ord < 200 AND {has('lower(url)', W.FALLBACK_TERMS)} AND {has('(text || url)', ['2024', '2025'])})
SELECT * FROM hi QUALIFY page_ord = min(page_ord) OVER (PARTITION BY company_id)"""
_report_words, _segments = ["report", "earning", "financial", "quarterly", "annual"], ["202", "upload", "document", "file"]
_name = "lower(string_split(url, '/')[-1])"
_lists = {
    "pdf_urls": ("url", "contains(u, '.pdf')"), "excel_urls": ("url", f"NOT contains(u, '.pdf') AND {has('u', ['.xlsx', '.xls'])}"),
    "earnings_texts": ("text", has("t", ["earning", "financial", "result"])), "date_texts": ("text", has("t", ["q1", "q2", "q3", "q4", "2023", "2024", "2025"])),
    "report_texts": ("text", has("t", ["report", "filing", "presentation"])),
    "naming_conventions": ("string_split(url, '/')[-1]", f"{has('u', ['.pdf', '.xlsx', '.xls'])} AND {has(_name, ['earning', 'financial', 'report', 'quarter', 'annual'])}"),
}
SQL["page_patterns"] = f"""{L}, m AS (SELECT *, replace(url, '/doc-', '/annual-report-') AS url2 FROM l), n AS (SELECT * EXCLUDE (url, u, url2), url2 AS url, lower(url2) AS u FROM m QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY link_id) <= 200),
p AS (SELECT *, string_split(url, '/') AS parts FROM n)
SELECT company_id, {', '.join(f"coalesce(string_agg({v}, '|' ORDER BY link_id) FILTER ({w}), '') AS {n}" for n, (v, w) in _lists.items())},
string_agg(nullif(array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: {has('lower(parts[i])', _segments)}), lambda i: array_to_string(parts[i:i+2], '/')), '|'), ''), '|' ORDER BY link_id) FILTER ({has('u', _report_words)}) AS report_paths FROM p GROUP BY 1"""

# downloads and uploads
SQL["files_to_download"] = f"{_NAMED} SELECT link_id FROM n WHERE link_id % 2 = 1 OR link_id % 10 = 0"
SQL["answer_problems"] = f"""{L}, a AS (SELECT link_id, CASE WHEN link_id % 7 = 0 THEN 'web page by its type' WHEN link_id % 5 IN (0, 2) AND NOT {has('u', ['.pdf', 'download', 'filing', 'doc_financials'])} THEN 'web page by its start' END AS problem FROM l)
SELECT link_id, problem FROM a WHERE problem IS NOT NULL"""
SQL["ticker_files"] = f"{_NAMED} SELECT link_id, ticker FROM n WHERE ticker = 'MSFT'"
SQL["file_sizes"] = "SELECT doc_id, round(coalesce(strlen(text), 0) / 1024, 1) AS kb, round(coalesce(strlen(text), 0) / 1048576, 2) AS mb FROM documents"
SQL["download_summary"] = """WITH r AS (SELECT source, count(*) % 2 = 0 AS ok FROM documents GROUP BY 1), f AS (SELECT coalesce(strlen(text), 0) AS size FROM documents WHERE doc_id % 3 < 2)
SELECT (SELECT coalesce(string_agg(source, ',' ORDER BY source), '') FROM r WHERE ok) AS successful, (SELECT coalesce(string_agg(source, ',' ORDER BY source), '') FROM r WHERE NOT ok) AS failed,
(SELECT count(*) FROM r WHERE ok) AS total_success, (SELECT count(*) FROM r WHERE NOT ok) AS total_failed, (SELECT count(*) FROM f) AS n_files, (SELECT round(sum(size::DOUBLE) / 1048576, 2) FROM f) AS total_mb"""
SQL["upload_rows"] = f"""{_NAMED} SELECT ticker, link_id % 9 <> 0 AS success, count(*) AS n, max(CASE WHEN link_id % 9 <> 0 THEN 'store/raw/' || ticker || '/2025-Q4/' || filename END) AS last_path,
max(CASE WHEN link_id % 9 = 0 THEN 'no space for ' || link_id END) AS last_error FROM n GROUP BY 1, 2"""

# state
_REPLAY = f"""{A}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM a),
r AS (SELECT user_id, i, sha256 AS s, published AS p, 1::BIGINT AS n FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, CASE WHEN o.sha256 <> r.s AND o.published >= r.p THEN o.sha256 ELSE r.s END, CASE WHEN o.sha256 <> r.s AND o.published >= r.p THEN o.published ELSE r.p END,
  r.n + CASE WHEN o.sha256 <> r.s AND o.published >= r.p THEN 1 ELSE 0 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)"""
SQL["state_after_skips"] = SQL["stream_state_upsert"] = f"{_REPLAY} SELECT user_id, arg_max(s, i) AS sha256, arg_max(p, i) AS published, max(n) AS processing_count FROM r GROUP BY 1"
SQL["state_overview"] = "SELECT count(DISTINCT user_id) AS total, count(DISTINCT user_id) FILTER (event_type = 'error') AS processed FROM events"
SQL["state_backups"] = """WITH u AS (SELECT user_id, bool_or(event_type = 'error') AS kept FROM events GROUP BY 1)
SELECT user_id, kept, CASE WHEN kept THEN 'store/state/' || user_id || '_backup_20251010_120000.json' END AS backup FROM u"""

# summaries
SQL["corpus_totals"] = """SELECT count(*) AS total_reports, count(DISTINCT source) AS unique_tickers, count(DISTINCT doc_id % 4) AS unique_periods, sum(doc_id % 7)::BIGINT AS total_tables, sum(doc_id % 3)::BIGINT AS total_images,
round(sum(strlen(text)::DOUBLE) / 1048576, 2) AS total_size_mb FROM documents"""
SQL["corpus_by_type"] = "SELECT CASE doc_id % 5 WHEN 0 THEN 'presentation' WHEN 1 THEN 'supplemental' ELSE 'press' END AS report_type, count(*) AS n FROM documents GROUP BY 1"
SQL["failed_rows"] = """SELECT user_id AS company, arg_max(CASE WHEN event_id % 2 = 0 THEN 'Timeout: ' ELSE 'No reports: ' END || event_id, event_id) AS last_error, count(*) AS total_attempts,
arg_max(CASE WHEN event_id % 2 = 0 THEN 'Timeout' ELSE 'No reports' END, event_id) AS category FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY min(event_id) LIMIT 5"""
SQL["image_totals"] = """WITH p AS (SELECT source, count(*) AS n, count(DISTINCT text) AS e FROM documents GROUP BY 1)
SELECT 100::BIGINT AS processed, count(*) FILTER (e > 0) AS with_images, sum(e)::BIGINT AS unique_images, sum(n - e)::BIGINT AS duplicate_images, sum(n)::BIGINT AS total_images FROM p"""
SQL["year_weights"] = """SELECT (year(o_orderdate) + 24)::VARCHAR AS year, count(*) AS n, CASE year(o_orderdate) + 24 WHEN 2025 THEN 1.0 WHEN 2024 THEN 0.85 WHEN 2023 THEN 0.6 WHEN 2022 THEN 0.4 ELSE 0.0 END::DOUBLE AS weight FROM orders GROUP BY 1, 3"""
SQL["config_problems"] = f"""SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 31 = 30 OR c_nationkey % 31 = 30 THEN 'unknown company: NONE' END, CASE WHEN c_nationkey < 3 THEN 'workers must be at least 1' END,
CASE WHEN c_custkey % 7 = 0 THEN 'as_of must be an ISO date' END) AS problems FROM customer"""

# checks
_s = STRIP.format("text")
_few = STRIP.format("substring(text, 1, (doc_id % 20)::INT)")
SQL["qc_extraction"] = f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN {_s} END AS s, length({_few}) AS f FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN s IS NULL THEN 'Text file not found' END, CASE WHEN length(s) < 100 THEN 'Text file too short: ' || length(s) || ' chars' END,
CASE WHEN length(s) >= 100 AND NOT {has('lower(s)', ['revenue', 'earnings', 'quarter', 'financial'])} THEN 'Text file does not appear to contain earnings content' END,
CASE WHEN s IS NULL AND doc_id % 3 = 0 THEN 'Neither meaningful text nor tables found - extraction may have failed' END,
CASE WHEN doc_id % 3 > 0 AND f < 10 THEN 'Table file too small: t1.csv' END, CASE WHEN doc_id % 3 = 2 AND doc_id % 5 = 0 THEN 'Table file not found: t2.csv' END], lambda v: v IS NOT NULL), '; ') AS errors FROM x"""
SQL["qc_objects"] = """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 <> 0 THEN 'Missing GCS object: store/raw/' || upper(source) || '/2025-Q1/' || doc_id || '.pdf' END,
CASE WHEN doc_id % 2 <> 0 THEN 'Missing GCS object: store/parsed/' || upper(source) || '/2025-Q1/text' END, 'Unknown object type: video'], lambda v: v IS NOT NULL), '; ') AS errors FROM documents"""
SQL["qc_json"] = """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 2 THEN 'Missing required field: confidence' END,
CASE doc_id % 7 WHEN 2 THEN 'Ticker mismatch: expected X, got Y' WHEN 4 THEN 'Ticker mismatch: expected X, got None' END,
CASE doc_id % 3 WHEN 0 THEN 'Very low confidence: 0.05' WHEN 1 THEN 'Invalid confidence value: high' ELSE 'Very low confidence: 0' END,
CASE doc_id % 6 WHEN 0 THEN 'Revenue should be a dictionary' WHEN 1 THEN 'Revenue value should be numeric' WHEN 2 THEN 'Revenue value is negative' END,
CASE doc_id % 6 WHEN 2 THEN 'Unexpected revenue unit: EUR' END, CASE doc_id % 6 WHEN 2 THEN 'Invalid revenue scale: T' END, CASE doc_id % 4 WHEN 0 THEN 'EPS should be numeric or null' END,
CASE doc_id % 5 WHEN 0 THEN 'Key highlights should be a list' WHEN 2 THEN 'Too many key highlights: 6 (max 5)' END], lambda v: v IS NOT NULL), '; ') AS errors FROM documents"""
SQL["manifest_full"] = f"""{E} SELECT doc_id, 'store/raw/' || ticker || '/' || period || '/r.pdf' AS pdf_path, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 > 0 THEN doc_id % 9 ELSE 0 END::INT AS pages,
CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE 0 END::INT AS tables, CASE WHEN doc_id % 2 = 0 THEN '1.0.0' END AS version, CASE WHEN confidence IS NOT NULL THEN 'store/parsed/' || ticker || '/' || period || '/structured.json' END AS record,
confidence, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END::INT AS n_notes FROM e"""
SQL["table_exports"] = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'dataframe' WHEN doc_id % 4 = 1 THEN 'csv' WHEN doc_id % 8 <> 7 THEN 'markdown' END AS method,
CASE WHEN doc_id % 4 = 0 THEN 'name' || chr(10) || source WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 8 <> 7 THEN '"name"' || chr(10) || '"' || source || '"' END AS csv FROM documents"""
SQL["table_exports"] = SQL["table_exports"].replace("WHEN doc_id % 8 <> 7 THEN 'markdown'", "WHEN doc_id % 4 = 2 THEN 'to_dataframe' WHEN doc_id % 8 <> 7 THEN 'markdown'").replace(
    "WHEN doc_id % 8 <> 7 THEN '\"name\"'", "WHEN doc_id % 4 = 2 THEN 'h' || chr(10) || source || chr(10) WHEN doc_id % 8 <> 7 THEN '\"name\"'"
)

# files
TREE_FILES = """rp AS (SELECT coalesce(source, 'none') AS t, '2025-Q' || (doc_id % 4 + 1) AS period, doc_id AS i, 'r' || doc_id AS report, coalesce(text, '') AS text, lang, n_chars FROM documents),
fl AS (SELECT t, period, report, 'pdf' AS kind, report || '.pdf' AS filename, '' AS folder, encode('%PDF-' || i) AS content FROM rp WHERE i % 4 = 0
  UNION ALL SELECT t, period, report, 'text', report || '.txt', 'text/', encode(text) FROM rp WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
  UNION ALL SELECT t, period, report, 'table', report || '-t' || k || '.csv', 'tables/', encode('k,v' || chr(10) || k || ',' || strlen(text)) FROM rp, (VALUES (1), (2)) v(k) WHERE k <= i % 3
  UNION ALL SELECT t, period, report, 'image', report || '-p1-chart.png', 'images/', unhex(md5(text)) FROM rp WHERE i % 3 = 0
  UNION ALL SELECT t, period, report, 'metadata', report || '.json', 'metadata/', encode('{' || concat_ws(', ', '"lang": "' || lang || '"', '"n_chars": ' || n_chars) || '}') FROM rp)"""
SQL["layout"] = f"""WITH {TREE_FILES} SELECT upper(t) AS ticker, period, kind, count(*) AS n, sum(octet_length(content))::BIGINT AS size,
  sha256(string_agg(filename || ':' || sha256(content), ',' ORDER BY filename || ':' || sha256(content))) AS "all" FROM fl GROUP BY 1, 2, 3"""
SQL["pruned_layout"] = f"WITH {TREE_FILES} SELECT report, decode(content) AS text FROM fl WHERE t = 'src3' AND period = '2025-Q4' AND kind = 'text'"
SQL["partition_tree"] = f"WITH {TREE_FILES} SELECT upper(t) AS ticker, period, filename, octet_length(content) AS length FROM fl"
SQL["output_sets"] = f"""WITH {TREE_FILES}, st AS (SELECT upper(t) AS ticker, period, report AS stem, string_agg(filename, ',' ORDER BY filename) FILTER (kind = 'table') AS tables,
  string_agg(filename, ',' ORDER BY filename) FILTER (kind = 'image') AS images, max(filename) FILTER (kind = 'pdf') AS filename, max(filename) FILTER (kind = 'text') AS text_file FROM fl GROUP BY 1, 2, 3)
SELECT ticker, period, stem, filename, text_file, tables, images FROM st WHERE filename IS NOT NULL AND text_file IS NOT NULL"""
SQL["object_listing"] = f"WITH {TREE_FILES} SELECT t || '/' || period || '/' || folder || filename AS name, octet_length(content) AS size, string_split(filename, '.')[-1] AS extension FROM fl WHERE t = 'src1'"
SQL["whole_texts"] = f"WITH {TREE_FILES} SELECT filename AS name, text FROM fl JOIN rp USING (report) WHERE fl.t = 'src1' AND fl.period = '2025-Q2' AND kind = 'text'"
SQL["json_objects"] = "SELECT 'A' AS ticker, count(*) AS processing_count FROM region"
SQL["results_sink"] = "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3"
SQL["appended_lines"] = f"""{E} SELECT '2025-Q1' AS period, count(*) AS n, 0 AS stamped FROM e WHERE period = '2025-Q1' HAVING n > 0 UNION ALL
SELECT '2025-Q2', count(*), count(*) FROM e WHERE period = '2025-Q2' AND report_type IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'left out', count(*), 0 FROM e WHERE period = '2025-Q2' AND report_type IS NULL HAVING count(*) > 0"""
SQL["put_states"] = f"""{A}, b AS (SELECT * FROM a WHERE user_id % 2 = 0 UNION ALL SELECT * FROM a WHERE user_id % 2 = 1 AND event_type = 'error')
SELECT user_id, arg_max(sha256, event_id) AS sha256, arg_max(published, event_id) AS published, count(*) AS processing_count FROM b GROUP BY 1"""
SQL["stored_objects"] = """SELECT 'parsed/' || doc_id || '/text.txt' AS name, sha256(CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE coalesce(text, '') END) AS content,
CASE WHEN doc_id % 3 = 0 THEN 'application/json' ELSE 'text/plain' END AS content_type, source AS region, doc_id % 3 = 0 AS again FROM documents"""
SQL["backup_states"] = f"""{A}, x AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM a GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN n ELSE e END AS now, nullif(e, 0) AS was FROM x WHERE e > 0 OR user_id % 2 = 0"""
