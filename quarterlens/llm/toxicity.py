"""Toxicity by noisy-channel deobfuscation and a word classifier."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, ship, slices, spread, stored, table, text_bytes, texts, tidy

SLICE = 1 << 20
#: Features are picked and the classifier is fitted on at most this many labelled rows (those of least hash).
TRAIN_ROWS = 20_000
#: Most features, and the least excess over chance, in standard deviations, that makes one.
FEATURES, LEAST_Z, LEAST_WEIGHT = 400, 3.0, 3.0
#: Lengths of word beginnings, and how often one must come, to be a feature.
PREFIXES, LEVELS = (4, 5, 6, 7), (2, 4)
#: Words, and bytes of these, that a task counts before it passes the sums on; and words that it turns into sums at a time.
COUNTED, COUNTED_BYTES, SUMMED = 500_000, 1 << 24, 50_000
THRESHOLD = 0.7
#: Clean rows that are added to those seen with a feature, when the feature's share of toxic rows is estimated.
DOUBT = 8.0
BEAM = 8
DECODED = 50_000
#: Long obfuscated tokens are decoded in windows, which overlap by the longest feature word (of so many letters at least) and
#: go STEP characters further each.
LONGEST, STEP = 24, 16
#: A feature word within a decoded token has at least so many letters, and words of the corpus make up the rest of it;
#: pieces of up to SHORT letters must be frequent (log frequency).
WITHIN, SHORT, FREQUENT = 4, 3, -8.0

#: What a character of leetspeak may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h",
}
_BARE_EDGE = ".,;:?\"'[]{}<>«»„“”‘’…—–/\\&%#^~`=_-"
_EDGE = ".,;:!?\"'()[]{}<>|«»„“”‘’…—–/\\&%#*$@^~`+=_-"
_JUNK = re.compile(r"([^\w\s])\1\1+")
_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*]{1,2}[^\s.\-_*]){2,}[.,!?]*(?!\S)|(?<!\S)[0-9@$!|+](?:[ .\-_*]{1,2}[^\s.\-_*]){2,}[.,!?]*(?!\S)")
_BLANKS = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")
#: Where joined words may part: at what is no letter and no leetspeak, or at anything but letters and digits.
_PARTS = (re.compile("[^\\w" + re.escape("".join(c for c in LEET if not c.isdigit())) + "]|_"), re.compile(r"[\W_]"))
#: Single characters set apart, as a token of a passage holds them.
_CHAIN = re.compile(r"[^\s.\-_*](?:[.\-_*]{1,2}[^\s.\-_*])*[.\-_*,!?]*")
_APART = re.compile(r"[ .\-_*]")
_CHANNEL = {"same": 0.0, "leet": -1.0, "any": -3.0, "drop": -0.7, "once": -0.5, "part": -1.0}


def word_key(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Lexicon:
    """Log frequencies of the corpus's words, held by sorted 64-bit keys: twelve bytes a word. `own` goes before them."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, own: dict[str, float]):
        order = np.argsort(keys)
        self.keys, self.logs, self.own = keys[order], logs[order].astype(np.float32), own

    def get(self, word: str, default: float | None = None) -> float | None:
        if word in self.own:
            return self.own[word]
        key = word_key(word)
        i = int(self.keys.searchsorted(key))
        return float(self.logs[i]) if i < len(self.keys) and self.keys[i] == key else default

    def __contains__(self, word: str) -> bool:
        return self.get(word) is not None

    def values(self) -> list[float]:
        return [*self.own.values(), *self.logs.tolist()]


class Decoder:
    """Viterbi search for the clean form of an obfuscated word or passage.

    The lattice has a step for each run of equal characters: the run as it is, one or two of it, what leetspeak lets it
    stand for, or, for a blank or another separator, nothing or the end of a word. A path costs what the channel charges for its
    steps and what a character trigram model thinks of the letters. The search is exact: the state is the last two
    letters, no state is dropped, and each keeps its `best` paths, among which the best ones of all lie. Those are then
    weighed as words of the corpus.
    """

    def __init__(self, trigrams: dict[str, float], words: dict[str, float]):
        self.trigrams, self.words = trigrams, words
        self.floor = min(trigrams.values(), default=-8.0) - 2.0
        self.word_floor = min(words.values(), default=-10.0) - 4.0
        self.memo: dict[str, tuple[str, ...]] = {}

    def decode(self, token: str) -> tuple[str, ...]:
        """The best clean form of a token, and runners-up that are words of the corpus."""
        if token not in self.memo:
            if len(self.memo) >= DECODED:
                self.memo.clear()
            self.memo[token] = self.likely(self.spelled(token))
        return self.memo[token]

    def likely(self, spelled: list[str]) -> tuple[str, ...]:
        return tuple(dict.fromkeys(spelled[:1] + [t for t in spelled[1:] if t and all(w in self.words for w in t.split())]))

    @staticmethod
    def steps(c: str, n: int) -> list[tuple[str, float]]:
        """What a run of n characters c may stand for (a blank ends a word), and what the channel charges for each."""
        if c.isalpha():
            out = [(c * min(n, 3), _CHANNEL["same"] if n < 3 else -2.0)]
            if n > 1:
                out.append((c, _CHANNEL["once"]))
            if n > 2:
                out.append((c * 2, _CHANNEL["once"]))
            return out
        price = _CHANNEL["any"] if c == "*" else _CHANNEL["leet"]
        out = [(x * k, price) for x in LEET.get(c, "") for k in ((1, 2) if n > 1 else (1,))]
        out.append(("", _CHANNEL["drop"] * (3 if c.isdigit() else 1)))
        if not c.isalnum():
            out.append((" ", _CHANNEL["part"]))
        return out

    def paths(self, text: str, best: int = BEAM) -> list[tuple[float, str]]:
        """The `best` cheapest paths through the lattice: their scores, the greatest first, and their letters."""
        paths: dict[str, list] = {"^^": [(0.0, ())]}
        floor, trigrams = self.floor, self.trigrams
        for run in re.finditer(r"(.)\1*", text, re.DOTALL):
            steps = self.steps(run.group(1), len(run.group()))
            reached: dict[str, list] = {}
            for state, held in paths.items():
                for letters, price in steps:
                    now, cost = state, price
                    for x in letters:
                        if x == " ":
                            cost += trigrams.get(now + "$", floor) if now != "^^" else 0.0
                            now = "^^"
                        else:
                            cost += trigrams.get(now + x, floor)
                            now = now[1] + x
                    reached.setdefault(now, []).extend((s + cost, (path, letters)) for s, path in held)
            paths = {
                s: [max(b, key=lambda p: p[0])] if best == 1 else sorted(b, key=lambda p: -p[0])[:best] for s, b in reached.items()
            }
        ends = [(s + trigrams.get(state + "$", floor) if state != "^^" else s, p) for state, held in paths.items() for s, p in held]
        out = []
        for score, path in sorted(ends, key=lambda x: -x[0])[:best]:
            parts = []
            while path:
                path, letters = path
                parts.append(letters)
            out.append((score, " ".join("".join(reversed(parts)).split())))
        return out

    def spelled(self, token: str) -> list[str]:
        """Readings of a token, the best first."""
        weigh = lambda t: sum(self.words.get(w, self.word_floor) for w in t.split()) if t else self.word_floor
        ranked = sorted(((score + weigh(t), t) for score, t in self.paths(token, 4 * BEAM)), key=lambda x: (-x[0], x[1]))
        return list(dict.fromkeys(t for _, t in ranked))

    def divides(self, letters: str, open_left: bool = False, open_right: bool = False) -> bool:
        """Whether words of the corpus make up the letters. At an open side the token goes on, so a word may be cut there, but
        at least one whole word must be left."""
        n = len(letters)
        if not n:
            return not (open_left or open_right)
        begins = [i == 0 or (open_left and i <= LONGEST) for i in range(n + 1)]
        ends = [False] * (n + 1)
        for i in range(n):
            if begins[i] or ends[i]:
                for j in range(i + 1, n + 1):
                    if not ends[j]:
                        log = self.words.get(letters[i:j])
                        ends[j] = log is not None and (j - i > SHORT or log >= FREQUENT)
        return any(ends[max(0, n - LONGEST) if open_right else n :])


def windows(token: str, longest: int = LONGEST) -> list[tuple[str, bool, bool]]:
    """Overlapping windows of a token, and whether it goes on before and after each: any `longest` characters lie in one."""
    starts = range(0, max(1, len(token) - longest), STEP)
    return [(token[a : a + longest + STEP], a > 0, a + longest + STEP < len(token)) for a in starts]


def obfuscated(t: str) -> list[str]:
    """The obfuscated forms of a lower-case token: it and its parts, where they hold more than letters, and its plain words with a
    letter three times or more in a row."""
    out = [w for w in plain_words(t) if _RUN.search(w)]
    if not t.isalpha():
        core = _JUNK.sub("", t).strip(_BARE_EDGE)
        if core and not core.isalpha() and any(c.isalpha() for c in core):
            out.append(core)
            parts = {x for pattern in _PARTS for x in pattern.split(core)} - {core}
            out += sorted(p for p in parts if not p.isalpha() and any(c.isalpha() for c in p))
    return out


def words_in(text: str) -> Counter:
    """Plain words of a whole text with their counts."""
    words: Counter = Counter()
    for t, n in Counter(text.lower().split()).items():
        for w in plain_words(t):
            words[w] += n
    return words


def token_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of texts; and for each token in its place its number, and the number of its text."""
    lists = pc.utf8_split_whitespace(texts)
    tokens = pc.list_flatten(lists).dictionary_encode()
    return tokens.dictionary, tokens.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()


def strings(column: pa.Array) -> list[str]:
    """A string array as a list, several times as fast as by its own method."""
    data, ends = text_bytes(column)
    raw, ends = data.tobytes(), ends.tolist()
    return [raw[a:b].decode() for a, b in zip(ends, ends[1:])]  # noqa: B905


def plain_cores(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case tokens without punctuation around them, and which of them are then words of letters only."""
    cores = pc.utf8_trim(pc.utf8_lower(tokens), characters=_BARE_EDGE)
    return cores, pc.utf8_is_alpha(cores).to_numpy(False)


def repetitive(words: pa.Array) -> np.ndarray:
    """Which words may hold a character three times in a row: those in which one to four bytes come three times in a row."""
    data, ends = text_bytes(words)
    hit = np.zeros(len(data) + 1, bool)
    for size in (1, 2, 3, 4):
        if len(data) >= 3 * size:
            same = np.append(0, np.cumsum(data[size:] == data[:-size]))  # same[i]: how many of the first i pairs are equal
            hit[: len(data) - 3 * size + 1] |= same[2 * size :] - same[: -2 * size] == 2 * size
    sums = np.append(0, np.cumsum(hit))
    # a run that goes over a word's end only makes one more word to look at
    return sums[ends[1:]] > sums[ends[:-1]]


def features_of(words: Counter) -> Iterator[str]:
    """Features of a text: each word; and each beginning of words (PREFIXES letters) that it holds twice, or four
    times, or more, in any words."""
    starts: Counter = Counter()
    for w, n in words.items():
        yield w
        for k in PREFIXES:
            if len(w) < k:
                break
            starts[w[:k]] += n
    yield from levels_of(starts)


def levels_of(starts: Counter) -> Iterator[str]:
    for s, n in starts.items():
        for level in LEVELS:
            if n >= level:
                yield f"{s}*{level}"


_NOTHING: tuple = ((), (), 0)


class Model:
    """Weights of features, and the decoder."""

    def __init__(self, weights: dict[str, float], bias: float, decoder: Decoder, alone: dict[str, float] | None = None):
        self.weights, self.bias, self.decoder, self.alone = weights, bias, decoder, alone or {}
        self.words = {f for f in weights if "*" not in f}
        self.starts = {f.split("*")[0] for f in weights if "*" in f}
        self.heads: dict[str, list[str]] = {}
        for w in sorted(self.words):
            if len(w) >= WITHIN:
                self.heads.setdefault(w[:WITHIN], []).append(w)
        self.longest = max([LONGEST, *map(len, self.words)])
        self.word_set, self.start_set = (pa.array(sorted(x), pa.string()) for x in (self.words, self.starts))
        self.memo: dict[tuple, str | None] = {}
        self.tokens: dict[str, tuple] = {}

    def restored(self, form: tuple[str, bool, bool]) -> str | None:
        """What is hidden in a window: a feature word or a word that begins like one, as the whole or between separators; or a
        feature word among other words."""
        if form not in self.memo:
            if len(self.memo) >= DECODED:
                self.memo.clear()
            self.memo[form] = self._restored(*form)
        return self.memo[form]

    def _matters(self, word: str) -> bool:
        return word in self.words or any(word[:k] in self.starts for k in PREFIXES)

    def _restored(self, token: str, open_left: bool, open_right: bool) -> str | None:
        spelled = self.decoder.spelled(token)
        for t in self.decoder.likely(spelled):
            for w in t.split():
                if self._matters(w):
                    return w
        for letters in dict.fromkeys(t.replace(" ", "") for t in spelled):
            for i in range(len(letters) - WITHIN + 1):
                for w in self.heads.get(letters[i : i + WITHIN], ()):
                    if letters.startswith(w, i):
                        before, after = letters[:i], letters[i + len(w) :]
                        if self.decoder.divides(before, open_left) and self.decoder.divides(after, False, open_right):
                            return w
        return None

    def token(self, t: str) -> tuple[tuple[str, ...], tuple[str, ...], int]:
        """Of a token as it stands and as it is restored: feature words, beginnings of words that make features, and how many
        single characters set apart it holds (0 if it holds anything else)."""
        if t not in self.tokens:
            if len(self.tokens) >= 2 * DECODED:
                self.tokens.clear()
            low = t.lower()
            words = plain_words(low)
            for form in obfuscated(low):
                words = words + sorted({w for window in windows(form, self.longest) if (w := self.restored(window))})
            starts = [w[:k] for w in words for k in PREFIXES if len(w) >= k and w[:k] in self.starts]
            chain = len(_APART.sub("", low.rstrip(",!?"))) if _CHAIN.fullmatch(low) else 0
            self.tokens[t] = tuple(w for w in words if w in self.words), tuple(starts), chain
        return self.tokens[t]

    def apart(self, lowered: str) -> set[str]:
        """Feature words in passages of single letters set apart, by whatever white space, as the decoder restores these, and as they
        stand."""
        found = set()
        for m in _SPACED.finditer(_BLANKS.sub(" ", lowered)):
            if m.group() not in self.decoder.memo:
                self.decoder.memo[m.group()] = (self.decoder.paths(m.group(), 1)[0][1],)
            restored = self.decoder.memo[m.group()][0]
            found |= {w for w in restored.split() if w in self.words}
            # a passage may hold no sign of where its words end
            joined = {restored.replace(" ", ""), _APART.sub("", m.group())}
            found |= {w for w in self.words if len(w) > 2 and any(w in letters for letters in joined)}
        if len(self.decoder.memo) >= DECODED:
            self.decoder.memo.clear()
        return found

    def scan(self, texts: pa.Array) -> list[list[str]]:
        """Features of each whole text, as it stands and as it is restored. Each distinct token is looked at once."""
        tokens, code, doc = token_codes(texts)
        cores, plain = plain_cores(tokens)
        # most tokens are plain words that are no feature and no beginning of one, and are not looked at any further
        look = ~plain | repetitive(cores) | (pc.utf8_length(cores).to_numpy() < 2)
        look |= pc.is_in(cores, self.word_set).to_numpy(False)
        for k in PREFIXES:
            look |= pc.is_in(pc.utf8_slice_codeunits(cores, 0, k), self.start_set).to_numpy(False)
        seen: list[tuple] = [_NOTHING] * len(tokens)
        for c, t in zip(np.flatnonzero(look).tolist(), strings(tokens.filter(pa.array(look))), strict=True):
            seen[c] = self.token(t)
        words: list[set[str]] = [set() for _ in range(len(texts))]
        starts: list[Counter] = [Counter() for _ in range(len(texts))]
        matters = np.array([bool(w or s) for w, s, _ in seen], bool)
        for d, c in zip(*(x[matters[code]].tolist() for x in (doc, code)), strict=True) if len(code) else ():
            words[d].update(seen[c][0])
            starts[d].update(seen[c][1])
        # texts with three characters set apart in a row, or more
        chain = np.array([k for _, _, k in seen], np.int64)[code] if len(code) else np.zeros(0, np.int64)
        run = np.cumsum((chain == 0) | (np.diff(doc, prepend=-1) != 0))
        held = np.bincount(run, chain, minlength=1)[run] >= 3 if len(run) else np.zeros(0, bool)
        for d in np.unique(doc[held & (chain > 0)]).tolist():
            words[d] |= self.apart(texts[d].as_py().lower())
        return [sorted(f for f in (*w, *levels_of(n)) if f in self.weights) for w, n in zip(words, starts, strict=True)]

    def present(self, text: str) -> set[str]:
        return set(self.scan(pa.array([text], pa.string()))[0])

    def scores(self, texts: pa.Array) -> list[float]:
        """The regression's probability, or, if higher, what the surest feature says alone (a short text has no more)."""
        out = []
        for found in self.scan(texts):
            x = self.bias + sum(self.weights[w] for w in found)
            out.append(max([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), *(self.alone.get(w, 0.0) for w in found)]))
        return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's features and its least word hash: near copies mostly share that."""
    for batch in batches:
        for a, b in slices(batch, SLICE, 0):
            part = batch.slice(a, b - a)
            words = [words_in(t) for t in part.column(0).to_pylist()]
            sigs = [min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws), default=0) for ws in words]
            items = [list(features_of(ws)) for ws in words]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(sigs, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["text", "toxic", "sig", "items"]
            )


def plain_words(t: str) -> list[str]:
    """The plain words of a lower-case token."""
    if t.isalpha():
        return [t]
    s = t.strip(_EDGE)
    return [s] if s.isalpha() else _WORDS.findall(s)


_COUNT = np.dtype([("key", "<i8"), ("n", "<i8")])
_PACKED = "bucket int, kind int, data binary"
_WORD, _TRIGRAM, _TEXTS = 0, 1, 2


def added(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each distinct key with the sum of its counts, sorted by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    out = np.zeros(len(first), _COUNT)
    out["key"], out["n"] = keys[first], np.add.reduceat(counts[order], first) if len(first) else 0
    return out


def trigram_letters(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def trigram_sums(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Each trigram of the words, with two marks before and one after, as one number (see trigram_letters), and the sum of these
    words' counts."""
    if not words:
        return np.zeros(0, _COUNT)
    sizes = np.array([len(w) + 3 for w in words])
    raw = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    begins = np.ones(len(raw), bool)
    begins[np.cumsum(sizes) - 1] = begins[np.cumsum(sizes) - 2] = False
    at = np.flatnonzero(begins)
    keys = raw[at] << 42 | raw[at + 1] << 21 | raw[at + 2]
    return added(keys, np.repeat(counts, sizes)[at])


def document_counts(texts: pa.Array) -> pa.Table:
    """Each plain word (word), and the number of texts that hold it (n)."""
    tokens, code, parent = token_codes(texts)
    cores, plain = plain_cores(tokens)
    others = [plain_words(t.lower()) for t in strings(tokens.filter(pa.array(~plain)))]
    size = np.ones(len(tokens), np.int64)
    size[~plain] = [len(w) for w in others]
    first = np.cumsum(size) - size
    words = pa.concat_arrays([cores.filter(pa.array(plain)), pa.array([w for ws in others for w in ws], pa.string())]).dictionary_encode()
    number = words.indices.to_numpy().astype(np.int64)
    of_token = np.empty(int(size.sum()), np.int64)
    n_plain, rest = int(plain.sum()), size[~plain]
    of_token[first[plain]] = number[:n_plain]
    of_token[np.repeat(first[~plain] - (np.cumsum(rest) - rest), rest) + np.arange(len(number) - n_plain)] = number[n_plain:]
    each = size[code]
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    once = np.sort(np.repeat(parent, each) * max(1, len(words.dictionary)) + of_token[np.repeat(first[code], each) + within])
    once = once[np.diff(once, prepend=-1) > 0] % max(1, len(words.dictionary))
    return pa.table({"word": words.dictionary, "n": np.bincount(once, minlength=len(words.dictionary)).astype(np.int64)})


def _packed(counts: np.ndarray, kind: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    where = (counts["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    counts, where = counts[np.argsort(where, kind="stable")], np.sort(where)
    cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(counts)]
    return ((int(where[a]), kind, counts[a:b].tobytes()) for a, b in pairwise(cuts) if b > a)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "data"])


def _language(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From texts: the number of texts that hold each word (by its key), each trigram's sum over these words, and the number of
        texts; summed over many texts and packed by bucket before they go on."""
        n_texts, held = 0, []

        def merged() -> pa.Table:
            return pa.concat_tables(held).combine_chunks().group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def sums() -> pa.RecordBatch:
            words, trigrams = [], []
            for part in merged().to_batches(SUMMED) if held else ():
                names, counts = strings(part.column(0)), part.column(1).to_numpy()
                words.append(added(np.fromiter(map(word_key, names), np.int64, len(names)), counts))
                trigrams.append(trigram_sums(names, counts))
            out = [(0, _TEXTS, np.array([(0, n_texts)], _COUNT).tobytes())]
            for kind, found in ((_WORD, words), (_TRIGRAM, trigrams)):
                whole = np.concatenate([*found, np.zeros(0, _COUNT)])
                out += _packed(added(whole["key"], whole["n"]), kind, buckets)
            return _rows(out)

        for batch in batches:
            for a, b in slices(batch, SLICE, 0):
                held.append(document_counts(batch.column(0).slice(a, b - a)))
                n_texts += b - a
                if sum(t.num_rows for t in held) > COUNTED or sum(t.nbytes for t in held) > COUNTED_BYTES:
                    held = [merged()]
                    if held[0].num_rows > COUNTED // 2 or held[0].nbytes > COUNTED_BYTES // 2:
                        yield sums()
                        n_texts, held = 0, []
            release()
        yield sums()

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows sorted by bucket and kind. Words of fewer than LEAST_WEIGHT texts go no further."""
    at, held = None, []

    def total() -> pa.RecordBatch:
        counts = np.frombuffer(b"".join(held), _COUNT)
        whole = added(counts["key"], counts["n"])
        return _rows([(*at, (whole[whole["n"] >= LEAST_WEIGHT] if at[1] == _WORD else whole).tobytes())])

    for batch in batches:
        for bucket, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, kind) != at and held:
                yield total()
                held = []
            at = bucket, kind
            held.append(data)
    if held:
        yield total()


def language(docs: DataFrame) -> tuple[dict[str, float], np.ndarray, np.ndarray, int]:
    """Trigram log probabilities, keys of words and their document counts, and the number of documents, from all texts.

    Nothing is sampled or capped; words of fewer than LEAST_WEIGHT documents only count for the trigrams. Sums move, not
    texts; what reaches the driver is one number for each trigram of the alphabet and sixteen bytes a word.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = spread(texts(docs)).select("text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        plain.mapInArrow(tidy(_language(buckets)), _PACKED)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "kind")
        .mapInArrow(tidy(_add), _PACKED)
    )
    counted = stored(spark, counted, "toxicity-language")

    def whole(kind: int) -> np.ndarray:
        parts = counted.filter(F.col("kind") == kind).select("data").toArrow().column(0).to_pylist()
        return np.frombuffer(b"".join(parts), _COUNT)

    after: Counter = Counter()
    found = whole(_TRIGRAM)
    pairs = list(zip(map(trigram_letters, found["key"].tolist()), found["n"].tolist(), strict=True))
    for t, n in pairs:
        after[t[:2]] += n
    chars = {t: math.log((n + 0.1) / (after[t[:2]] + 3.0)) for t, n in pairs}
    words = whole(_WORD)
    return chars, words["key"].copy(), words["n"].copy(), int(whole(_TEXTS)["n"].sum())


def _presence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(model.weights)
        number = {w: i for i, w in enumerate(names)}
        for batch in batches:
            found = [sorted(number[w] for w in f) for f in model.scan(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["found", "toxic", "weight"]
            )

    return run


def _logistic(rows: list, width: int, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights (none below 0) and bias of a logistic regression on word presence, by accelerated gradient steps."""
    r = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
    c = np.array([j for x in rows for j in x[0]], np.int64)
    y, n = np.array([x[1] for x in rows], float), np.array([x[2] for x in rows], float)
    total = n.sum()
    prior = (float((y * n).sum()) + 0.5) / (total + 1)
    w, b = np.zeros(width), math.log(prior / (1 - prior))
    vw, vb = w.copy(), b
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(r, vw[c], len(rows)), -30, 30)))
        g = (p - y) * n / total
        nw = np.maximum(0, vw - 4 * (np.bincount(c, g[r], width) + 1e-5 * vw))
        nb = vb - 4 * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fits the decoder's language model, picks features and fits their weights.

    The language model counts the texts of all docs, labelled or not, and reads no label. Features and weights use labelled
    rows outside the held-out third only, and of these the `most` rows whose doc_id has the least hash. Near copies share one
    vote there: a row's weight is one over the number of rows with its least word hash. With no labelled rows, or those of one
    class only, the model has no features and calls nothing toxic.
    """
    spark = docs.sparkSession
    ship(spark)
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # `most` rows of two numbers; of an id with several texts one text counts
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    signed = sample.select("text", "toxic").mapInArrow(tidy(_sample), "text string, toxic int, sig long, items array<string>")
    signed = stored(spark, signed, "toxicity-sample")
    sizes = signed.groupBy("sig").agg((1 / F.count("*")).alias("weight"))
    weighed = signed.join(F.broadcast(sizes), "sig")  # `most` rows of two numbers
    sums = stored(
        spark,
        weighed.select(F.explode("items").alias("item"), "toxic", "weight")
        .groupBy("item")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("weight"))).alias("n1"), F.sum("weight").alias("n")),
        "toxicity-sums",
    )
    totals = weighed.agg(F.sum("weight"), F.sum(F.when(F.col("toxic") == 1, F.col("weight")))).first()
    total, toxic = totals[0] or 0.0, totals[1] or 0.0
    if not toxic or toxic == total:
        return Model({}, -30.0, Decoder({}, {}))
    share = toxic / total
    n1 = F.coalesce("n1", F.lit(0.0))
    z = (n1 - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    features = sums.filter(F.col("n") >= LEAST_WEIGHT).filter(z >= LEAST_Z).orderBy(F.desc(z), "item").limit(FEATURES).collect()
    chars, keys, counts, n_docs = language(docs)
    logs = np.log(counts / (max(n_docs, 1) * 50))
    lexicon = Lexicon(keys, logs, {})
    # words that mark toxic texts are what writers hide: among hidden words they're not rare
    lexicon.own = {r["item"]: max(lexicon.get(r["item"], -4.0), -4.0) for r in features if "*" not in r["item"]}
    decoder = Decoder(chars, lexicon)
    weights = dict.fromkeys((r["item"] for r in features), 1.0)
    model = Model(weights, 0.0, decoder)
    rows = weighed.select("text", "toxic", "weight").mapInArrow(tidy(_presence(model)), "found array<int>, toxic int, weight double").collect()
    w, b = _logistic([(x["found"], x["toxic"], x["weight"]) for x in rows], len(weights))
    alone = {r["item"]: (r["n1"] or 0.0) / (r["n"] + DOUBT) for r in features}
    return Model({k: float(x) for k, x in zip(sorted(weights), w, strict=True)}, float(b), decoder, alone)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, SLICE):
                part = batch.slice(a, b - a)
                scores = model.scores(part.column(1))
                held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in part.column(0).to_pylist()]
                release()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every whole text from 0 to 1.

    Words that hold digits or symbols, letters repeated three times or more, and passages of single letters set apart (with
    their blanks, which may end words or mean nothing) are restored by the decoder; a text's score rests on the features of it as it stands and as it is restored. Nothing is
    shuffled.

    Null and empty texts get the score of a text without features, and a null doc_id counts as the text "None" for
    its fold. Every row is scored once; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return spread(texts(docs)).mapInArrow(
        tidy(_scores(model)), "doc_id long, held_out boolean, score double, predicted int"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ship(spark)
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
