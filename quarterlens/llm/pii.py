"""Personal data by weak supervision (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_ids, stored, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "secret")
#: Characters of text before and after a candidate that labelers see.
LEFT, RIGHT = 40, 24
ROUNDS = 50
THRESHOLD = 0.5

# Linear-time forms of the base patterns: possessive loops never give back what no later part could use, and a match
# begins at the start of a run or where the last match ended, as every leftmost match does.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Gazetteers.
_DOMAINS = (
    "com org net edu gov mil int info biz name pro mobi io co app dev me tv ai cloud online site shop store tech xyz club "
    "de fr es it nl uk us eu ch at be pt pl se no dk fi ie ca au nz jp in br mx ar cl pe ve uy cn hk tw kr sg my th id ph vn "
    "ru ua by kz cz sk hu ro bg gr tr il ae sa eg za ng ke ma is lu li mt cy ee lv lt si hr rs ba mk al md"
).split()
_COUNTRY_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 "
    "93 94 95 98 211 212 213 216 218 220 221 233 234 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 "
    "374 375 376 380 381 382 385 386 387 389 420 421 423 501 502 503 504 505 506 507 509 591 593 595 598 852 853 855 856 880 886 "
    "960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998"
).split()
_FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica "
    "Thomas Sarah Charles Karen Christopher Nancy Daniel Margaret Matthew Betty Anthony Sandra Donald Ashley Steven Kimberly "
    "Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie "
    "Ronald Rebecca Timothy Laura Jason Sharon Jeffrey Cynthia Ryan Kathleen Jacob Amy Gary Angela Nicholas Anna Eric "
    "Hans Klaus Petra Jürgen Ursula Wolfgang Monika Dieter Sabine Manfred Renate Günter Heike Stefan Andrea Matthias Birgit "
    "Pierre Marie Jacques Camille Philippe Nathalie Jean Isabelle Michel Sylvie Alain Catherine Nicolas Julien Céline Élodie "
    "Juan José María Carmen Luis Antonio Ana Manuel Francisco Isabel Javier Dolores Carlos Pilar Miguel Teresa Rafael Lucía"
).split()
_TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame".split()

# Context cues for and against, for each kind.
_CUES = {
    "email": (r"e-?mail|mailto|contact|correo|courriel|write to|reach", r"example only|placeholder"),
    "ip": (r"\bip\b|address|host|server|login|from|client", r"version|release|\bv\.?\s*$|section|chapter|build"),
    "card": (r"card|visa|master|amex|payment|credit|karte|tarjeta|carte", r"isbn|order|invoice|serial|tracking|sku|\bid\b|phone|tel"),
    "phone": (r"phone|tel|call|mobile|cell|fax|contact|reach|whatsapp", r"isbn|order|invoice|serial|version|price|total"),
    "name": (r"name|contact|dear|sincerely|signed|by|from|mit|von|par|por", r"street|avenue|road|university|inc\b|corp"),
    "secret": (r"token|secret|password|api|key|credential|auth", r"checksum|commit|sha|digest|hash|example"),
}

_INITIALS = "".join(sorted({n[0] for n in (*_TITLES, *_FIRST_NAMES)}))

#: kind, strict form?, pattern, trigger. Loose forms only propose; labelers decide. Patterns begin with what fails soonest.
_SOURCES = (
    ("email", True, _EMAIL, lambda t: t.contains("@")),
    ("ip", True, _IP, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", True, _CARD, lambda t: t.rlike(r"[0-9][\x20-]?[0-9]")),
    ("phone", True, _PHONE, lambda t: t.contains("+")),
    (
        "email",
        False,
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
        r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
        lambda t: t.rlike(r"(?i)[(\[]at[)\]]"),
    ),
    (
        "phone",
        False,
        r"(?=[(0-9])(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
        lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    ),
    (
        "name",
        False,
        rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:(?:" + "|".join(_TITLES) + r")\.?\x20\p{Lu}\p{Ll}++|(?:" + "|".join(_FIRST_NAMES) + r")\x20\p{Lu}\p{Ll}++)(?:\x20\p{Lu}\p{Ll}++)?(?!\p{L})",
        lambda t: t.rlike(rf"[{_INITIALS}]\p{{Ll}}+\.?\x20\p{{Lu}}\p{{Ll}}"),
    ),
    (
        "secret",
        False,
        r"""(?i)(?=[tspa])(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?["']?[A-Za-z0-9_/+-]{16,}+["']?""",
        lambda t: t.rlike("[=:]"),
    ),
)


#: Characters that a text is cut into blocks of, when parts of it are put together.
BLOCK = 1024
#: Marks the ends of matches while a text is parted; texts that hold it are parted in another way.
_END = "\x01"
_MATCHES = "array<struct<source:int,match:string,gap:int,left:string,right:string>>"


def _found(text: Column, source: int) -> Column:
    """All matches of a pattern with the length of the text since the last match, and what stands around them."""
    kind, strict, pattern, trigger = _SOURCES[source]
    one_pass = F.split(F.regexp_replace(text, pattern, f"{_END}$0{_END}"), _END, -1)
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    two_passes = F.array_compact(F.flatten(F.zip_with(gaps, matches, lambda g, m: F.array(g, m))))
    # gap, match, gap, ..., gap
    parts = F.when(trigger(text), F.when(text.contains(_END), two_passes).otherwise(one_pass)).otherwise(F.array(F.lit("")))

    def match(p: Column, i: Column) -> Column:
        gap = F.get(p, i - 1)
        return F.struct(
            F.lit(source).alias("source"), F.get(p, i).alias("match"), F.length(gap).alias("gap"),
            F.right(gap, F.lit(LEFT)).alias("left"), F.left(F.get(p, i + 1), F.lit(RIGHT)).alias("right"),
        )

    every = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: match(p, i))
    none = F.array().cast(_MATCHES)
    # bound once, as parts would be computed anew wherever it's named
    return F.get(F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, every(p)).otherwise(none)), 0)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits pass the checksum."""
    return F.aggregate(
        F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    ) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    """Whether a base match holds (its numbers are in range)."""
    digits = _digits(m)
    n = F.length(digits)
    ip = F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255
    )
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def _votes(kind: Column, base: Column, m: Column, left: Column, right: Column) -> list[Column]:
    """Each labeler's vote: 1, 0, or -1 for none."""
    digits = _digits(m)
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    regex = vote(base, kind.isin("card", "ip"))
    gazetteer = (
        F.when(kind == "email", vote(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(_DOMAINS), F.lit(True)))
        .when(kind == "ip", vote(m.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), F.lit(True)))
        .when(kind == "card", vote(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), F.lit(True)))
        .when(kind == "phone", vote(m.rlike(r"^\+(?:" + "|".join(_COUNTRY_CODES) + r")(?![0-9]{6})"), ~m.startswith("(")))
        .when(kind == "name", vote(m.rlike(r"^(?:" + "|".join(_FIRST_NAMES) + r")\x20"), F.lit(False)))
        .otherwise(-1)
    )
    context = F.lit(-1)
    for k, (yes, no) in _CUES.items():
        around = F.lower(F.concat(left, F.lit(" "), F.when(kind == "secret", m).otherwise(""), F.lit(" "), right))
        context = F.when(kind == k, vote(around.rlike(yes), around.rlike(no))).otherwise(context)
    shape = (
        F.when(kind == "email", vote(F.length(m) <= 254, F.lit(True)))
        .when(kind == "ip", vote(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & ~right.rlike(r"^\.[0-9]"), F.lit(True)))
        .when(kind == "card", vote(m.rlike(r"^[0-9]{14,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"), F.lit(True)))
        .when(kind == "phone", vote(F.length(digits).between(10, 13), F.lit(True)))
        .when(kind == "name", vote(m.rlike(r"^(?:" + "|".join(_TITLES) + r")\b") | (F.size(F.split(m, " ")) == 2), F.lit(False)))
        .when(kind == "secret", vote(m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z0-9_/+-]{20,}"), F.lit(True)))
    )
    return [regex, gazetteer, context, shape]


LABELERS = ("v_regex", "v_gazetteer", "v_context", "v_shape")


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Probability that a span is personal data, for each pattern of votes of one kind.

    The model of Dawid and Skene with two classes: each labeler has a rate of voting 1 in either class, and an abstention says
    nothing. It starts from the share of positive votes; counts are smoothed by pseudo-counts that hold labelers to be
    better than chance, so that the classes keep their meaning.
    """
    share = lambda v: (1 + sum(x == 1 for x in v)) / (2 + sum(x >= 0 for x in v))
    post = {v: share(v) for v, _ in counts}
    width = len(counts[0][0]) if counts else 0
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        prior = (sum(post[v] * n for v, n in counts) + 2) / (total + 4)
        rates = []
        for j in range(width):
            yes1 = sum(post[v] * n for v, n in counts if v[j] == 1) + 4
            any1 = sum(post[v] * n for v, n in counts if v[j] >= 0) + 5
            yes0 = sum((1 - post[v]) * n for v, n in counts if v[j] == 1) + 1
            any0 = sum((1 - post[v]) * n for v, n in counts if v[j] >= 0) + 5
            rates.append((yes1 / any1, yes0 / any0))
        for v, _ in counts:
            odds = math.log(prior / (1 - prior))
            for x, (p1, p0) in zip(v, rates, strict=True):
                if x >= 0:
                    odds += math.log(p1 / p0 if x else (1 - p1) / (1 - p0))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


#: What the span classifier sees of a span itself, beside the votes: few values each, whatever the corpus holds.
SHAPE = ("length", "digits", "parted", "before", "after")


def _shape(m: Column, left: Column, right: Column) -> list[Column]:
    n = F.length(m)
    digits = F.length(_digits(m)) / n
    neighbour = lambda c: (
        F.when(c == "", "end").when(c.rlike(r"\s"), "blank").when(c.rlike(r"[\p{L}\p{N}]"), "word").when(c.rlike(r"[(\[{<\x22':=]"), "open")
        .otherwise("other")
    )
    return [
        F.when(n < 8, "7").when(n < 12, "11").when(n < 16, "15").when(n < 24, "23").when(n < 40, "39").otherwise("40"),
        F.when(digits == 0, "none").when(digits < 0.3, "few").when(digits < 0.7, "many").otherwise("most"),
        F.when(m.rlike(r"\s"), "blank").when(m.contains("-"), "dash").when(m.contains("."), "dot").otherwise("not"),
        neighbour(F.right(left, F.lit(1))),
        neighbour(F.left(right, F.lit(1))),
    ]


def train(counts: list[tuple[str, tuple[int, ...], tuple[str, ...], int]], steps: int = 200) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on each kind's votes and on the shape of the span and its
    surroundings, with EM's posteriors as soft labels, by accelerated gradient steps over the table of distinct feature sets.
    What the votes leave open weighs little, so that the looks of trusted spans decide there."""
    rows = []
    for kind in sorted({k for k, _, _, _ in counts}):
        patterns: dict[tuple[int, ...], int] = {}
        for k, v, _, n in counts:
            if k == kind:
                patterns[v] = patterns.get(v, 0) + n
        post = expectation_maximisation(sorted(patterns.items()))
        sure = lambda v: abs(2 * post[v] - 1)  # noqa: B023, E731
        rows += [(_features(kind, v, shape), post[v], math.log1p(n) * sure(v)) for k, v, shape, n in counts if k == kind]
    names = sorted({f for fs, _, _ in rows for f in fs})
    number, total = {f: i for i, f in enumerate(names)}, sum(n for _, _, n in rows) or 1.0
    data = [([number[f] for f in fs], y, n / total) for fs, y, n in rows]
    w = ahead = [0.0] * len(names)
    for step in range(steps):
        slope = [1e-3 * x for x in ahead]
        for fs, y, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(ahead[f] for f in fs)))))
            for f in fs:
                slope[f] += (p - y) * n
        after = [x - 0.4 * g for x, g in zip(ahead, slope, strict=True)]
        ahead = [x + step / (step + 3) * (x - old) for x, old in zip(after, w, strict=True)]
        w = after
    return dict(zip(names, w, strict=True))


def _features(kind: str, votes: tuple[int, ...], shape: tuple[str, ...]) -> list[str]:
    voted = [f"{kind}:{n}={x}" for n, x in zip(LABELERS, votes, strict=True) if x >= 0]
    return [f"kind={kind}", *voted, *(f"{kind}:{n}={x}" for n, x in zip(SHAPE, shape, strict=True))]


def find_spans(docs: DataFrame) -> DataFrame:
    """One row for each accepted span: row, doc_id, kind, base, start, end (code points, end exclusive).

    Candidates are the base patterns' valid matches and the matches of looser patterns that overlap none of those. Four
    labelers vote on each (regex, gazetteer, context, shape). Counts of vote patterns give the labelers' reliabilities by
    expectation-maximisation, and the posteriors train a logistic classifier of spans, which sees the votes, the span's own
    shape and what stands beside it, and which every candidate then passes through. Base spans stay whatever it says. The
    counts that reach the driver are of few values each (3^4 votes and 6 * 4 * 4 * 5 * 5 shapes for a kind at most, whatever
    the corpus holds).

    The texts are scanned once and never shuffled; later steps move candidates only. Null and empty texts have no span.
    """
    return _spans(docs)[1]


def _spans(docs: DataFrame, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and their accepted spans; row: an id of each row that docs has, else rows are numbered here."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    scanned = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"),
        *[_found(text, i).alias(f"s{i}") for i in range(len(_SOURCES))],
    )
    scanned = stored(spark, scanned, "pii-scan")
    sources = F.concat(*[F.col(f"s{i}") for i in range(len(_SOURCES))])
    rows = scanned.select("row", "doc_id", F.posexplode(sources).alias("ord", "c")).select("row", "doc_id", "ord", "c.*")

    # Positions: all matches of a pattern count here, also those that do not hold.
    own = Window.partitionBy("row", "source").orderBy("ord")
    kinds = F.array(*[F.lit(s[0]) for s in _SOURCES])
    stricts = F.array(*[F.lit(s[1]) for s in _SOURCES])
    size = F.length("match")
    placed = (
        rows.withColumn("end", F.sum(F.col("gap") + size).over(own).cast("long"))
        .withColumn("start", F.col("end") - size)
        .withColumn("kind", F.element_at(kinds, F.col("source") + 1))
        .withColumn("base", F.element_at(stricts, F.col("source") + 1) & _valid(F.col("kind"), F.col("match")))
    )
    by_row = Window.partitionBy("row")
    earlier = by_row.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # from the end backwards: a frame that reaches to the partition's end would be gone over anew for each row
    later = by_row.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(earlier)
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(later)
    candidates = (
        placed.withColumn("be", base_end)
        .withColumn("bs", base_start)
        .filter(
            F.col("base")
            | ~F.col("kind").isin("ip", "card")
            & ~(F.element_at(stricts, F.col("source") + 1))
            & ~F.coalesce(F.col("be") > F.col("start"), F.lit(False))
            & ~F.coalesce(F.col("bs") < F.col("end"), F.lit(False))
        )
    )
    votes = _votes(F.col("kind"), F.col("base"), F.col("match"), F.col("left"), F.col("right"))
    shape = _shape(F.col("match"), F.col("left"), F.col("right"))
    voted = candidates.select(
        "row", "doc_id", "kind", "base", "start", "end", *[v.alias(n) for v, n in zip((*votes, *shape), (*LABELERS, *SHAPE), strict=True)]
    )
    voted = stored(spark, voted, "pii-votes")
    patterns = voted.groupBy("kind", *LABELERS, *SHAPE).count().collect()  # bounded, see above
    weights = train([(r["kind"], tuple(r[n] for n in LABELERS), tuple(r[n] for n in SHAPE), r["count"]) for r in patterns])

    # The classifier as an expression: a literal map from its discrete features to its weights.
    if weights:
        table_of = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
        score = F.coalesce(table_of[F.concat(F.lit("kind="), F.col("kind"))], F.lit(0.0))
        for n in (*LABELERS, *SHAPE):
            key = F.concat(F.col("kind"), F.lit(f":{n}="), F.col(n).cast("string"))
            score = score + F.coalesce(table_of[key], F.lit(0.0))
    else:
        score = F.lit(0.0)
    voted = voted.withColumn("probability", 1 / (1 + F.exp(-score)))
    accepted = voted.filter(F.col("base") | (F.col("probability") >= THRESHOLD))
    return scanned.select("row", "doc_id"), accepted.select(
        "row", "doc_id", "kind", "base", "start", "end", "probability"
    )


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base spans, a digest of them, all accepted spans as text, and their number.

    Rows with equal doc_ids are told apart by a row number from the scan, so repeated rows each get their own result. Null
    and empty texts have no span; other columns are ignored; an empty table gives no rows.
    """
    rows, spans = _spans(docs)
    entry = F.struct(
        F.col("start"),
        _rank(F.col("kind")).alias("k"),
        F.col("base"),
        F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"),
    )
    per = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(entry)).alias("spans"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
    )
    joined = rows.join(per, "row", "left")
    join_of = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x["s"]), ","), F.lit(""))
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(join_of(F.filter("spans", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"),
        join_of(F.col("spans")).alias("spans"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every accepted span replaced by its kind in brackets, such as [EMAIL]; all rows and columns stay.

    Spans of a row are merged where they overlap. Each row is cut by its own spans, also if it has no doc_id or shares it.
    """
    rows, own = row_ids(docs)
    found = "_pii"  # under a name that docs does not have
    while found in docs.columns or f"{found}_row" in docs.columns:
        found += "_"
    spans = _spans(rows, rows[own])[1]
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    clear = (
        spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
        .filter(F.col("end") > F.col("reach"))
        .withColumn("start", F.greatest("start", "reach"))
    )
    per = clear.groupBy(F.col("row").alias(f"{found}_row")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(found)
    )
    joined = rows.join(per, rows[own] == per[f"{found}_row"], "left")
    # the text between span i - 1 and span i, then span i's mark; the last part has no mark
    end_of = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(found, i)["end"].cast("int"))
    start_of = lambda i: F.coalesce(F.try_element_at(found, i + 1)["start"].cast("int"), F.length("text"))
    mark = lambda i: F.coalesce(F.concat(F.lit("["), F.upper(F.try_element_at(found, i + 1)["kind"]), F.lit("]")), F.lit(""))
    blocks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    parts = lambda held: F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: F.concat(_cut(held, end_of(i), start_of(i)), mark(i)))
    cleaned = F.get(F.transform(F.array(blocks), lambda held: F.array_join(parts(held), "")), 0)  # blocks are bound once
    clean = F.when(F.col(found).isNull() | F.col("text").isNull(), F.col("text")).otherwise(cleaned)
    return joined.withColumn("text", clean).select(*docs.columns)


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in blocks. A substring of the whole text would be counted out from its beginning each time."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
    return F.when(end <= start, F.lit("")).otherwise(F.substring(F.array_join(held, ""), start - first * BLOCK + 1, end - start))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
