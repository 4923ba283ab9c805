"""Personal data: base patterns, and a linear-chain conditional random field for the forms that they miss.

The field labels tokens (a run of letters, a run of digits, one sign) with O or the begin and inside of a kind. Its
features are word shapes: the shapes of a token and its neighbours, singly and joined, membership in a small lexicon,
and whether a blank stands before. Shapes are numbers, so a batch of tokens becomes a matrix of feature places by
array arithmetic; weights are found by gradient ascent on the likelihood (forward-backward) of a small labelled table
(``labelled_rows``: sentences from templates, or any table of text and spans, ``MOST_LABELLED`` rows at most). Sequences of
similar length are decoded together by Viterbi in numpy.

Every token of a text is scored, and the labels are those of the best path over the whole text. A run of tokens can carry
labels only if that pays: what its scores and moves gain at most over O is a sum over its tokens, so prefix sums tell
which tokens are O on the best path for certain (``Field.possible``). Those separate a text into stretches that are decoded
apart, with the same result.

A decoded span counts if its normal form is valid (an address, four parts up to 255, 13 to 19 digits that pass Luhn, 7 to
15 digits of a phone) and it touches no base span; base spans always stay.

The base patterns run in linear time, also on very long texts without a blank: a match can only begin where a run of its
characters begins, so later starts are never tried.

Defined cases: a null text is empty, an empty one has no spans; rows are independent, so repeated rows, ties and null ids
give one result row each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.common import steps, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
MOST_LABELLED, REACH, HASHES, BATCH_TOKENS = 5_000, 40, 4_096, 400_000
#: Neighbours on either side that a token's features look at, and tokens that are scored at once.
SEEN, SCORED = 3, 32_768
Span = tuple[str, int, int]

# --- base patterns ---------------------------------------------------------------
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _run_before(text: str, end: int, least: int) -> int:
    """Where the run of address characters that ends at ``end`` begins, not before ``least``."""
    width = 64
    while True:
        start = max(least, end - width)
        run = end - start - len(text[start:end].rstrip(_LOCAL))
        if run < end - start or start == least:
            return end - run
        width *= 2


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap within a kind; those that fail the kind's rule are dropped."""
    found, last = [], 0
    for m in _HOST.finditer(text) if "@" in text else ():
        start = _run_before(text, m.start(), last)
        if start < m.start():
            found.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


# --- tokens and features -----------------------------------------------------------
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\w\s]|_")
#: With the blanks before it: tokens and blanks are all that a text holds.
_BLANKS_TOKEN = re.compile(rf"\s*+(?:{_TOKEN.pattern})")
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?[aA][tT]\b|\b[dD][oO][tT]\b")
# fixed values: spelled-out signs, ends of host names, words before numbers
_SIGNS = {"at": 1, "dot": 2}
_ENDS = {"com": 3, "org": 3, "net": 3, "edu": 3, "de": 3, "fr": 3, "es": 3, "uk": 3, "io": 3, "info": 3}
_CUES = {"tel": 4, "phone": 4, "call": 4, "fax": 4, "mobile": 4, "fon": 4, "telefon": 4, "card": 5, "visa": 5, "ip": 6,
         "mail": 7, "email": 7, "contact": 7}
_LEXICON = {**_SIGNS, **_ENDS, **_CUES}
_PUNCTUATION = "@.-()[]/,:;+#$%&=<>{}_!?*'\"|\\~^"
_SHAPES = 64


def _shape(token: str) -> tuple[int, int]:
    """Shape and lexicon entry of a token; 0 is kept for the end of a sequence."""
    head = token[:24]
    if "0" <= head[0] <= "9":
        n = min(len(token), 8)
        small = len(head) <= 3 and int(head) <= 255
        return (n * 2 + small if n < 4 else 4 + n), 0
    if head[0] in _PUNCTUATION:
        return 14 + _PUNCTUATION.index(head[0]), 0
    if not head[0].isalpha():
        return 50, 0
    kind = 0 if head.islower() else 1 if head.istitle() else 2 if head.isupper() else 3
    return 51 + kind * 3 + (len(token) > 1) + (len(token) > 8), _LEXICON.get(head.lower(), 0)


_MIX = np.array([1, 40503, 2654435761, 2246822519, 3266489917, 668265263], np.uint64)


def feature_places(shape: np.ndarray, entry: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """(features, tokens): the place of each feature in its own table. Sequences are separated by two zeros."""
    def at(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by == 0:
            return x
        if by > 0:
            out[:-by] = x[by:]
        else:
            out[-by:] = x[:by]
        return out

    s, e, b = (x.astype(np.uint64) for x in (shape, entry, blank))
    s0, s1, s2, p1, p2, p3, s3 = (at(s, k) for k in (0, 1, 2, -1, -2, -3, 3))
    e0, e1, e2, q1, q2 = (at(e, k) for k in (0, 1, 2, -1, -2))
    gap = b * 2 + at(b, 1)
    parts = [(s0, gap), (s1, b), (s2,), (p1, b), (p2,), (p1, s0, gap), (s0, s1, gap), (p1, s0, s1), (p2, p1, s0), (s0, s1, s2),
             (p2, p1, s1, s2), (e0, q1), (e0, e1), (q1, e1), (e2, s0), (q2, s0), (p3, s0), (s3, s0)]
    out = np.empty((len(parts), len(shape)), np.int64)
    for k, columns in enumerate(parts):
        mixed = sum((c * m for c, m in zip(columns, _MIX)), np.uint64(0))
        out[k] = (mixed ^ (mixed >> np.uint64(15))) % np.uint64(HASHES)
    return out


class _Codes(dict):
    """Shape, lexicon entry and blank of a token with the blanks before it, as one number."""

    def __missing__(self, token: str) -> int:
        bare = token.lstrip()
        shape, entry = _shape(bare)
        code = shape | entry << 8 | (len(bare) < len(token)) << 12
        if len(token) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[token] = code
        return code


class Tokens:
    """Texts as tokens laid end to end, for one batch."""

    def __init__(self):
        none = np.zeros(3, np.uint16)
        self.parts, self.none, self.bounds, self.known = [none], none, [], _Codes()
        self.count = 3

    def add(self, text: str) -> None:
        own = np.array([*map(self.known.__getitem__, _BLANKS_TOKEN.findall(text.rstrip()))], np.uint16)
        self.bounds.append((self.count, self.count + len(own)))
        self.parts += [own, self.none]
        self.count += len(own) + 3

    def codes(self) -> np.ndarray:
        return np.concatenate(self.parts)


def places_of(codes: np.ndarray) -> np.ndarray:
    return feature_places(codes & 255, codes >> 8 & 15, codes >> 12)


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def sequences(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Stretches of a text within reach of a trigger; words cut by their borders are left out. Decoding doesn't go by them."""
    start = end = None
    for m in _TRIGGER.finditer(text):
        if end is not None and m.start() - reach <= end:
            end = m.end() + reach
            continue
        if end is not None:
            yield _whole_words(text, start, end)
        start, end = max(0, m.start() - reach), m.end() + reach
    if end is not None:
        yield _whole_words(text, start, end)


def _whole_words(text: str, start: int, end: int) -> tuple[int, int]:
    end = min(end, len(text))
    while 0 < start < end and text[start - 1].isalnum() and text[start].isalnum():
        start += 1
    while start < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end -= 1
    return start, end


# --- the field ----------------------------------------------------------------------
def _groups(bounds: list[tuple[int, int]], most: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Sequences of similar length, as many as fit when padded to the longest."""
    order = sorted((i for i, (a, b) in enumerate(bounds) if b > a), key=lambda i: bounds[i][1] - bounds[i][0])
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * (bounds[i][1] - bounds[i][0]) > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, features: int, labels: int = len(LABELS)):
        self.emit = np.zeros((features, HASHES, labels))
        self.move, self.begin = np.zeros((labels, labels)), np.zeros(labels)

    def scores(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros((places.shape[1], self.move.shape[0]))
        for table, at in zip(self.emit, places):
            out += table[at]
        return out

    def gradient(self, scores: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of padded sequences (n, t, labels) with gold labels (-1: padding), and its gradients."""
        n, t, labels = scores.shape
        real = gold >= 0
        forward, backward = np.zeros((t, n, labels)), np.zeros((t, n, labels))
        forward[0] = self.begin + scores[:, 0]
        for k in range(1, t):
            step = _logsum(forward[k - 1][:, :, None] + self.move, 1) + scores[:, k]
            forward[k] = np.where(real[:, k, None], step, forward[k - 1])
        for k in range(t - 2, -1, -1):
            step = _logsum(self.move + (scores[:, k + 1] + backward[k + 1])[:, None, :], 2)
            backward[k] = np.where(real[:, k + 1, None], step, 0)
        total = _logsum(forward[-1], 1)
        hot = np.eye(labels)[np.maximum(gold, 0)] * real[:, :, None]
        emit = hot - np.exp(forward.transpose(1, 0, 2) + backward.transpose(1, 0, 2) - total[:, None, None]) * real[:, :, None]
        move = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
        path = (np.where(real, np.take_along_axis(scores, np.maximum(gold, 0)[:, :, None], 2)[:, :, 0], 0).sum()
                + self.begin[gold[:, 0]].sum() + (move * self.move).sum())
        for k in range(1, t):
            pair = np.exp(forward[k - 1][:, :, None] + self.move + (scores[:, k] + backward[k])[:, None, :] - total[:, None, None])
            move -= (pair * real[:, k, None, None]).sum(axis=0)
        return float(path - total.sum()), emit, move, emit[:, 0].sum(axis=0)

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of padded sequences (n, t, labels)."""
        n, t, labels = scores.shape
        best, back = self.begin + scores[:, 0], np.zeros((t, n, labels), np.int8)
        stay = np.arange(labels)
        for k in range(1, t):
            step = best[:, :, None] + self.move
            live = (k < lengths)[:, None]
            back[k] = np.where(live, step.argmax(axis=1), stay)
            best = np.where(live, step.max(axis=1) + scores[:, k], best)
        out = np.zeros((n, t), np.int8)
        at = best.argmax(axis=1)
        for k in range(t - 1, -1, -1):
            out[:, k] = at
            at = back[k][np.arange(n), at]
        return out

    def gains(self, scores: np.ndarray) -> np.ndarray:
        """What a token adds at most to a run of labels, compared with O."""
        inner = self.move[1:, 1:].max() - self.move[0, 0]
        return (scores[:, 1:].max(axis=1) - scores[:, 0]) + inner

    def possible(self, gains: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
        """The tokens that may carry a label on the best path of their text. All others are O on it: any run of labels around
        them gains less than nothing, also with the moves into it and out of it. Between texts ``gains`` is low."""
        move, begin, still = self.move, self.begin, self.move[0, 0]
        into, out = move[0, 1:].max() - still, move[1:, 0].max() - still
        least = move[1:, 1:].max() - still - into - out - 1e-6
        gains = gains.copy()
        ends = np.array([(a, b - 1) for a, b in bounds if b > a], np.int64).reshape(-1, 2)
        gains[ends[:, 0]] += max(0.0, (begin[1:] - begin[0]).max() - into)
        gains[ends[:, 1]] += max(0.0, -out)
        sums = np.concatenate([[0.0], np.cumsum(gains)])
        most = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        return most >= least

    def decode(self, tokens: Tokens) -> np.ndarray:
        """A label per token of the batch: the best path of each text."""
        found = np.zeros(tokens.count, np.int8)
        bounds = [(a, b) for a, b in tokens.bounds if b > a]
        if not bounds:
            return found
        codes, gains = tokens.codes(), np.empty(tokens.count)
        for k in range(0, tokens.count, SCORED):
            gains[k:k + SCORED] = self.gains(self._scored(codes, k, min(tokens.count, k + SCORED)))
        gains[codes == 0] = -1e4  # the ends of texts
        may = self.possible(gains, bounds)
        may[codes == 0] = False
        edges = np.flatnonzero(np.diff(may.astype(np.int8), prepend=0, append=0))
        # a stretch with the O before and behind it, where its text goes on there
        inner = [(a - bool(codes[a - 1]), b + bool(codes[b]), bool(codes[a - 1]), bool(codes[b])) for a, b in edges.reshape(-1, 2).tolist()]
        stretches = [x[:2] for x in inner]
        for group in _groups(stretches):
            at, lengths = _padded(stretches, group)
            flat, where = np.unique(at, return_inverse=True)
            scores = self._at(codes, flat)[where.reshape(at.shape)]
            for row, i in enumerate(group):
                if inner[i][2]:
                    scores[row, 0, 1:] = -np.inf
                if inner[i][3]:
                    scores[row, lengths[row] - 1, 1:] = -np.inf
            labels = self.viterbi(scores, lengths)
            real = np.arange(at.shape[1]) < lengths[:, None]
            found[at[real]] |= labels[real]
        return found

    def _scored(self, codes: np.ndarray, start: int, end: int) -> np.ndarray:
        """Scores of the tokens from ``start`` to ``end``; features look at three neighbours on both sides."""
        first = max(0, start - SEEN)
        return self.scores(places_of(codes[first:end + SEEN])[:, start - first:end - first])

    def _at(self, codes: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Scores of single tokens, ascending and not at either end of the batch."""
        out = np.empty((len(where), self.move.shape[0]))
        for k in range(0, len(where), SCORED):
            own = where[k:k + SCORED]
            around = np.clip(own[:, None] + np.arange(-SEEN, SEEN + 1), 0, len(codes) - 1)
            out[k:k + SCORED] = self.scores(places_of(codes[around].ravel())[:, SEEN::2 * SEEN + 1])
        return out


def _padded(bounds: list[tuple[int, int]], group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    first = np.array([bounds[i][0] for i in group])
    lengths = np.array([bounds[i][1] - bounds[i][0] for i in group])
    steps_ = np.arange(lengths.max())
    return np.where(steps_ < lengths[:, None], first[:, None] + steps_, 0), lengths


def fit(rows: Iterable[tuple[str, list[Span]]], rounds: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Fit a field on labelled texts by gradient ascent with per-weight step sizes."""
    tokens, gold = Tokens(), [0, 0, 0]
    for text, spans in rows:
        tokens.add(text)
        for start, end in token_spans(text):
            label = next((2 * KINDS.index(k) + (1 if s == start else 2) for k, s, e in spans if s <= start and end <= e), 0)
            gold.append(label)
        gold += [0, 0, 0]
    places, gold = places_of(tokens.codes()), np.array(gold)
    field = Field(len(places))
    weights = [field.emit, field.move, field.begin]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        grads = [-decay * w for w in weights]
        scores = field.scores(places)
        total = sum(b > a for a, b in tokens.bounds)
        for group in _groups(tokens.bounds, 20_000):
            at, lengths = _padded(tokens.bounds, group)
            want = np.where(np.arange(at.shape[1]) < lengths[:, None], gold[at], -1)
            _, emit, move, begin = field.gradient(scores[at], want)
            flat, real = at.ravel(), (want >= 0).ravel()
            emit = emit.reshape(len(flat), -1)[real] / total
            for k, own in enumerate(places[:, flat[real]]):
                for label in range(emit.shape[1]):
                    grads[0][k, :, label] += np.bincount(own, emit[:, label], HASHES)
            grads[1], grads[2] = grads[1] + move / total, grads[2] + begin / total
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return field


# --- spans ------------------------------------------------------------------------------
_SPELLED = re.compile(r"\s*[\[({<]\s*(at|dot|@|\.)\s*[\])}>]\s*|\s+(at|dot)\s+|\s*([@.])\s*", re.I)


def valid(kind: str, text: str) -> bool:
    """Does the normal form of a decoded span keep its kind's rule?"""
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    if kind == "phone":
        return 7 <= len(digits) <= 15
    plain = _SPELLED.sub(lambda m: {"at": "@", "dot": "."}.get(x := (m[1] or m[2] or m[3]).lower(), x), text)
    if kind == "ip":
        parts = plain.split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain))


def labelled_spans(labels: Iterable[int], spans: Iterable[tuple[int, int]]) -> list[Span]:
    """Spans of begin and inside labels; an inside without a begin of its kind begins one."""
    out: list[Span] = []
    before = 0
    for label, (start, end) in zip(labels, spans):
        if label:
            kind = KINDS[(label - 1) // 2]
            if label % 2 == 0 and before and KINDS[(before - 1) // 2] == kind:
                out[-1] = (kind, out[-1][1], end)
            else:
                out.append((kind, start, end))
        before = label
    return out


def _apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """The spans that touch none of the others."""
    others = sorted(others, key=lambda s: s[1])
    starts, ends = [s[1] for s in others], [*itertools.accumulate((s[2] for s in others), max)]
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[1]]


def find_batch(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and those that the field adds; every text is decoded as a whole."""
    tokens, out = Tokens(), []
    for text in texts:
        tokens.add(text)
    labels = field.decode(tokens)
    labelled = np.concatenate([[0], np.cumsum(labels != 0)])
    for text, (a, b) in zip(texts, tokens.bounds):
        base, added = base_spans(text), []
        if labelled[b] > labelled[a]:
            added = [s for s in labelled_spans(labels[a:b].tolist(), token_spans(text)) if valid(s[0], text[s[1]:s[2]])]
        out.append((base, _apart(added, base) if added else []))
    return out


def joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


# --- labelled table ------------------------------------------------------------------------
# fixed values: templates. w a word, t the end of a host name, o a part of an address, N a run of that many digits.
_FORMS = {
    "email": ("{w} at {w} dot {t}", "{w}.{w} (at) {w} (dot) {t}", "{w}[at]{w}[dot]{t}", "{w} [at] {w}.{t}", "{w}@{w} dot {t}",
              "{w} @ {w} . {t}", "{w}.{2}(at){w}{1}.{w}.{t}", "{w}_{w} at {w}.{t}", "{w}{2} (at) {w} dot {w} dot {t}"),
    "phone": ("({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "00{2} {3} {7}", "1-{3}-{3}-{4}", "({3}) {3} {4}", "00{2}-{3}-{3}-{4}"),
    "ip": ("{o} . {o} . {o} . {o}", "{o}[.]{o}[.]{o}[.]{o}", "{o} dot {o} dot {o} dot {o}", "{o}(.){o}(.){o}(.){o}"),
    "card": ("{4}.{4}.{4}.{4}", "{4}/{4}/{4}/{4}", "{4} - {4} - {4} - {4}", "{4}  {4}  {4}  {4}", "{4} {6} {5}", "{4}_{4}_{4}_{4}")}
_PLAIN = ("20{2}-0{1}-1{1}", "1{1}.0{1}.20{2}", "{2}:{2}:{2}", "{1}.{1}.{2}", "v{1}.{2}.{3}", "$ {1},{3}.{2}", "order {8}", "no. {5}", "{1}.{5}",
          "page {2} of {3}", "978-{1}-{2}-{6}-{1}", "token = \"{h}\"", "{h}", "{16}", "+{1} ({3}) {3}-{4}", "{w}.{2}@{w}{1}.{w}.com", "{w} at {w}",
          "the dot {w}", "{w} at {2} dot {w}", "a[{1}] = b[{1}]", "{4}, {4}, {4}", "{2}-{2}-{2}", "@{w}", "({4})", "{4}-{4}", "{3} {3}", "{w} (at) {w}",
          "{w}. {2} {w}", "{6}", "https://{w}.{w}.com/{w}/{4}", "{w} {1}. {w} {2}. {w}", "{o}.{o}.{o}.{o}")
_CARRIERS = ("{a} {x} {b}", "{a}, {x}. {b}", "{x}", "{a}: {x}", "{a} ({x}) {b}", "{a} {x}, {b}", "{a}.\n{x}\n{b}", "{a} {c} {x} {b}", "{a}### {x}&&& {b}",
             "{a} {x}%%% {b}")
_LETTERS = "eeeeaaaiinnnrrsstttooldhcumpgbvfzäöüßéèçñó"


def labelled_rows(count: int = 1200, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences of made-up words with and without personal data."""
    rng = random.Random(seed)

    def word() -> str:
        w = "".join(rng.choice(_LETTERS) for _ in range(rng.randint(2, 9)))
        return rng.choice([w, w, w, w.capitalize(), w.upper()])

    def name() -> str:
        return "".join(c for c in word().lower() if c.isascii()) or "ana"

    def fill(form: str, kind: str) -> str:
        def value(m: re.Match) -> str:
            code = m[1]
            if code == "w":
                return name()
            if code == "t":
                return rng.choice(list(_ENDS))
            if code == "o":
                return str(rng.randint(0, 255))
            if code == "h":
                return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40])))
            return "".join(rng.choice("0123456789") for _ in range(int(code)))
        text = re.sub(r"\{(\w+)\}", value, form)
        if kind == "card":  # make the last digit right
            digits = _digits(text)
            text = next(t for d in "0123456789" if luhn(_digits(t := text[:-1] + d))) if digits else text
        return text

    def prose() -> str:
        return " ".join(word() for _ in range(rng.randint(1, 7)))

    rows = []
    for i in range(count):
        kind = KINDS[i % 4] if i % 3 else ""
        piece = fill(rng.choice(_FORMS[kind] if kind else _PLAIN), kind)
        carrier = rng.choice(_CARRIERS)
        cue = rng.choice(list(_CUES))
        before = re.split(r"\{x\}", carrier)[0].replace("{a}", prose()).replace("{b}", prose()).replace("{c}", cue)
        after = re.split(r"\{x\}", carrier)[1].replace("{b}", prose())
        rows.append((before + piece + after, [(kind, len(before), len(before) + len(piece))] if kind else []))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind:string,start:int,end:int>>")


def fit_table(labelled: DataFrame) -> Field:
    """Fit on a labelled table, of which ``MOST_LABELLED`` rows at most are used."""
    rows = labelled.select("text", "spans").where("text is not null").limit(MOST_LABELLED).collect()
    return fit([(r[0], [tuple(s) for s in r[1] or []]) for r in rows])


def find(documents: DataFrame, field: Field) -> DataFrame:
    """Per document: doc_id, the number of base spans of each kind, base_sha256, spans (all), n_added."""
    counts = [f"n_{k}" for k in KINDS]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            found = find_batch(field, texts)
            base = [joined(b) for b, _ in found]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                        pa.array([joined(b + a) if a else x for (b, a), x in zip(found, base)], pa.string()),
                        pa.array([len(a) for _, a in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_sha256", "spans", "n_added"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_added long"
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(task), schema)


def personal_data(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Base patterns and a field fitted on ``labelled`` (the small table of this module if None)."""
    return find(documents, fit_table(labelled_table(documents.sparkSession) if labelled is None else labelled))
