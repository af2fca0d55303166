"""Quality by positive-unlabelled learning: trusted texts of quality against everything that was crawled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ship, slices, spread, stored, table, text_bytes, texts, tidy

THRESHOLD = 0.5
SLICE = 1 << 20
#: Weight of the squared weights; most Newton steps, their lengths, and the gain that ends them.
RIDGE, STEPS, LENGTHS, GAIN = 1e-4, 12, (1.0, 0.5, 0.125), 1e-6
#: Bins of scores, and the share of trusted texts that must lie above a bin for it to bound the class prior.
BINS, TAIL = 1000, 0.25

_PUNCTUATION = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_CLASS = np.zeros(256, np.int64)  # 0: other control characters and bytes within a character
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[192:] = 1, 2, 3, 4, 5, 6
_CLASS[_PUNCTUATION] = 7 + np.arange(len(_PUNCTUATION))
_CLASSES = 7 + len(_PUNCTUATION)
_SPACE = np.zeros(256, bool)
_SPACE[9:14] = _SPACE[32] = True
#: Texts' statistics, by name.
NAMES = [
    "bytes", "words", "upper", "digits", "lines", "beyond ascii", "marks a word", "shouted words", "words that end in marks", "letters a word",
    "word repeats the last", "different words", "most common word", "different triples", "different lines", "words a sentence",
    *(f"mark {chr(c)}" for c in _PUNCTUATION),
]


def _runs(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of bytes that aren't `apart`: where each begins and ends, and in which text it is."""
    inside = ~apart[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    tops = offsets[:-1][offsets[:-1] < len(data)]
    begins[tops] = inside[tops]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal runs of bytes."""
    size = end - start
    places = np.append(0, np.cumsum(size))
    at = np.repeat(start - places[:-1], size) + np.arange(places[-1])
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data[at])])
    return whole.dictionary_encode().indices.to_numpy().astype(np.int64)


def _distinct(row: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different codes each row has, and how often the commonest comes."""
    width = int(code.max()) + 1 if len(code) else 1
    key, many = np.unique(row * width + code, return_counts=True)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, key // width, many)
    return np.bincount(key // width, minlength=rows), most


def statistics(batch: pa.Array) -> np.ndarray:
    """A row of statistics for each whole text (see NAMES); an empty text's are those of no words."""
    data, offsets = text_bytes(batch)
    rows = len(batch)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(row * _CLASSES + _CLASS[data], minlength=rows * _CLASSES).reshape(rows, _CLASSES).astype(float)
    upper, lower, digits, newline, wide, marks = kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 5], kinds[:, 6], kinds[:, 7:]
    start, end, of = _runs(data, offsets, _SPACE)
    words = np.maximum(np.bincount(of, minlength=rows), 1).astype(float)
    per = lambda on: np.bincount(of, weights=on, minlength=rows) / words
    sums = lambda on: np.append(0, np.cumsum(on))
    capital, small = sums(_CLASS[data] == 1), sums(_CLASS[data] == 2)
    shouted = (capital[end] - capital[start] > 1) & (small[end] == small[start])
    tail = _CLASS[data[end - 1]] >= 7
    code = _codes(data, start, end)
    again = np.append(False, (code[1:] == code[:-1]) & (of[1:] == of[:-1])) if len(code) else np.zeros(0, bool)
    different, most = _distinct(of, code, rows)
    third = np.zeros(rows)
    three = of[2:] == of[:-2] if len(of) > 2 else np.zeros(0, bool)
    if three.any():
        k = int(code.max()) + 1
        _, pair = np.unique(code[:-2] * k + code[1:-1], return_inverse=True)
        _, triple = np.unique(pair * k + code[2:], return_inverse=True)
        third = _distinct(of[2:][three], triple[three], rows)[0] / np.maximum(words - 2, 1)
    third[words < 3] = 1
    apart = np.zeros(256, bool)
    apart[10] = True
    a, b, line_of = _runs(data, offsets, apart)
    lines = np.maximum(np.bincount(line_of, minlength=rows), 1)
    stops = marks[:, [_PUNCTUATION.index(ord(c)) for c in ".!?"]].sum(1)
    size = np.diff(offsets)
    columns = [
        np.log1p(size), np.log1p(words), upper / (upper + lower + 1), np.sqrt(digits / words), np.sqrt(newline / words), wide / (upper + lower + wide + 1),
        np.sqrt(marks.sum(1) / words), np.sqrt(per(shouted)), per(tail), np.log1p(np.maximum(size - words, 0) / words),
        np.sqrt(per(again)), different / words ** 0.9, most / words, third, np.maximum(_distinct(line_of, _codes(data, a, b), rows)[0], 1) / lines,
        np.log1p(words / (stops + 1)),
    ]
    return np.column_stack([*columns, *np.sqrt(marks / words[:, None]).T]).astype(np.float32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in slices(batch, SLICE):
            part = batch.slice(start, end - start)
            found = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _lists(found)], ["doc_id", "held_out", "x"])


def _lists(rows: np.ndarray) -> pa.Array:
    places = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(places), pa.array(rows.ravel(), pa.float32()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): the statistics of every whole text."""
    held = F.coalesce(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    return spread(texts(docs, held)).mapInArrow(tidy(_describe), "doc_id long, held_out boolean, x array<float>")


def _summed(rows: DataFrame, of_batch, width: int) -> np.ndarray:
    """The sum over all rows (x, trusted) of what of_batch gives for a batch (an array of `width` numbers), added up in tasks
    and then place by place: `width` numbers come to the driver, however many tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["place", "value"])

    sums = rows.select("x", "trusted").mapInArrow(tidy(run), "place int, value double").groupBy("place").agg(F.sum("value"))
    out = np.zeros(width)
    for place, value in sums.collect():
        out[place] = value
    return out


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


class Scale:
    """Statistics brought to mean 0 and deviation 1 over all texts, at most eight deviations away, with a constant."""

    def __init__(self, n: float, total: np.ndarray, squares: np.ndarray):
        self.mean = total / max(n, 1)
        deviation = np.sqrt(np.maximum(squares / max(n, 1) - self.mean**2, 0))
        self.deviation = np.where(deviation > 1e-6, deviation, np.inf)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.deviation, -8, 8), np.ones(len(x))])


class Sums:
    """What a risk and its Newton step need, of some weights over the trusted or over all rows: means of the losses of either
    sign, of x, of x times the score of either sign, and of x x' times the score's slope."""

    def __init__(self, part: np.ndarray, d: int):
        n = max(part[0], 1)
        self.n, self.as_good, self.as_bad = part[0], part[1] / n, part[2] / n
        self.x, self.up, self.down = (part[3 + i * d : 3 + (i + 1) * d] / n for i in range(3))
        self.slope = part[3 + 3 * d :].reshape(d, d) / n


def _losses(weights: list[np.ndarray], scale: Scale):
    d = len(weights[0])

    def of_batch(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        out = []
        for group in (trusted, ~trusted):
            part = scale(x[group])
            for w in weights:
                g = part @ w
                s = sigmoid(g)
                slope = (part * (s * (1 - s))[:, None]).T @ part
                out += [[len(part), softplus(-g).sum(), softplus(g).sum()], part.sum(0), s @ part, (1 - s) @ part, slope.ravel()]
        return np.concatenate(out)

    return of_batch, 2 * len(weights) * (3 + 3 * d + d * d)


def _newton(rows: DataFrame, scale: Scale, start: np.ndarray, risk) -> np.ndarray:
    """Weights of least risk: Newton steps, of which the best length is taken. risk gives value, gradient and curvature from the sums
    over trusted and over all rows. A job a step."""
    d = len(start)

    def at(weights: list[np.ndarray]) -> list[tuple]:
        of_batch, width = _losses(weights, scale)
        parts = _summed(rows, of_batch, width).reshape(2, len(weights), -1)
        out = []
        for i, w in enumerate(weights):
            value, gradient, curvature = risk(Sums(parts[0, i], d), Sums(parts[1, i], d), w)
            ridge = np.append(np.full(d - 1, RIDGE), 0)
            out.append((value + ridge @ w**2 / 2, gradient + ridge * w, curvature + np.diag(ridge + 1e-9), w))
        return out

    now = at([start])[0]
    for _ in range(STEPS):
        step = np.linalg.solve(now[2], now[1])
        best = min(at([now[3] - k * step for k in LENGTHS]), key=lambda x: x[0])
        if best[0] >= now[0]:
            break
        gain, now = now[0] - best[0], best
        if gain < GAIN:
            break
    return now[3]


def apart_risk(p: Sums, u: Sums, w: np.ndarray) -> tuple:
    """Of telling trusted texts from all: the classifier whose scores bound the class prior."""
    return p.as_good + u.as_bad, u.up - p.down, p.slope + u.slope


def non_negative_risk(prior: float):
    """The non-negative unbiased risk: prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) for the logistic loss l. Inside
    the bound it is convex, as l(g) - l(-g) = -g. At the bound a step that lowers only the part that the bound holds gains nothing, so
    the search for weights ends there instead of fitting unlabelled texts as bad that are good."""

    def risk(p: Sums, u: Sums, w: np.ndarray) -> tuple:
        return prior * p.as_good + max(0.0, u.as_bad - prior * p.as_bad), u.up - prior * p.x, u.slope

    return risk


def class_prior(trusted: np.ndarray, whole: np.ndarray) -> float:
    """The share of good texts among all, from histograms of a score: the least ratio of the share of all texts to that of trusted
    ones above a bound, of which each is raised by its standard error, as the least of many uncertain ratios is too low. Where
    only good texts lie above the bound, the ratio is the prior; elsewhere it is larger."""
    above = lambda h: np.cumsum(h[::-1])[::-1]
    p, u = above(trusted), above(whole)
    far = p >= max(TAIL * p[0], 1)
    ratio = (u[far] / max(u[0], 1)) / (p[far] / max(p[0], 1)) * (1 + 1 / np.sqrt(p[far]))
    return float(np.clip(ratio.min(initial=1.0), 0.01, 0.99))


class Model:
    def __init__(self, scale: Scale, weights: np.ndarray, prior: float):
        self.scale, self.weights, self.prior = scale, weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale(x) @ self.weights)


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Fits on described rows: those that labels call good (and that are not held out) are the trusted ones, and all rows, held out or
    not, are the unlabelled ones. Labels of bad texts are not used, nor those of a doc_id that is called both. Every sum goes
    over all rows; some thousand numbers a step come to the driver. Without trusted texts every score is 0.5."""
    spark = rows.sparkSession
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = 1 AND most = 1")
    trusted = rows.filter("NOT held_out").join(good.select("doc_id"), "doc_id", "left_semi")
    both = rows.select("x", F.lit(False).alias("trusted")).unionByName(trusted.select("x", F.lit(True).alias("trusted")))
    both = stored(spark, both, "quality-rows")
    d = len(NAMES)

    def moments(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        x, n = x[~trusted], trusted.sum()
        return np.concatenate([[n, len(x)], x.sum(0), (x**2).sum(0)])

    sums = _summed(both, moments, 2 + 2 * d)
    scale = Scale(sums[1], sums[2 : 2 + d], sums[2 + d :])
    start = np.zeros(d + 1)
    if not sums[0]:
        discard(both)
        return Model(scale, start, 0.5)
    telling = _newton(both, scale, start, apart_risk)

    def histograms(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        place = np.minimum((sigmoid(scale(x) @ telling) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(place[on], minlength=BINS) for on in (trusted, ~trusted)]).astype(float)

    found = _summed(both, histograms, 2 * BINS)
    prior = class_prior(found[:BINS], found[BINS:])
    start[-1] = np.log(prior / (1 - prior))
    weights = _newton(both, scale, start, non_negative_risk(prior))
    discard(both)
    return Model(scale, np.round(weights, 6), prior)  # sums in another order give the same weights


def scored(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.scores(_matrix(batch.column(2)))
                predicted = pa.array((score >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Each text is read once, for its statistics, which are stored.

    A null text counts as empty and gets the score of a text without words. Rows that share a doc_id are scored one by one, and are all
    trusted if it is labelled good; a null doc_id is never labelled and not held out. An empty table gives no rows. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = stored(spark, described(docs), "quality-statistics")
    return scored(rows, fit(rows, labels))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
