"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms.  The model adds spans in other forms
("jane at post dot org", "(415) 555-0132", "10[.]0[.]0[.]7", a card number with dots).  It scores whole candidate
segments: their digit groups, separators, check digits, labels of an address and the words before them.  A dynamic programme over
segments of bounded length chooses boundaries and types together, for each stretch of text that can hold a segment; all text
between such stretches has the outside type in every labelling the model allows, so cutting there changes nothing.

The model is fitted by the exact likelihood of whole segmentations on labelled lines (``pii_examples``), a table of fixed size that
does not depend on the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of
from contactspark.llm.pii_examples import CUES, OTHER, examples, passes_luhn

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE = len(KINDS)  # the type of single tokens outside all segments
MOST = 25  # tokens of a segment
DIGITS = (7, 19)  # of a number
GROUPS = 7  # of its digits at most
BEFORE = 40  # characters of context
LINES = 800  # of the labelled table
ROUNDS, RATE, DECAY = 60, 0.25, 0.002

IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")

Span = tuple[int, int, int]  # start, end, kind


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the e-mail pattern, in time linear in the text: from each ``@`` outwards instead of from each letter on."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        behind = DOMAIN.match(text, at + 1) if start < at else None
        free = behind.end() if behind else at + 1
        if behind:
            yield start, free, 0
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    found = list(emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and passes_luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# ---- where a segment can lie

NUMBERS = re.compile(r"(?<![0-9])[0-9]{1,3}+(?:(?: dot |\[dot\]|\(dot\))[0-9]{1,3}+)++|[0-9][0-9 ().+/\[\]-]{5,}")
AT = re.compile(r" ?[(\[]at[)\]] ?| at (?=[\w-]++(?: dot |\.\w))| @ ?(?=[\w-]++\.\w)|(?<=\w)@ (?=[\w-]++\.\w)", re.I)
# the same in pieces that begin with fixed text, which the scan of a long text is quick for
MARKS = [re.compile(p) for w in ("at", "AT") for p in (rf"\({w}\)", rf"\[{w}\]", rf" {w} (?=[\w-]++(?: dot | DOT |\.\w))")] + [re.compile(r" @ ?(?=[\w-]++\.\w)"), re.compile(r"@ (?=[\w-]++\.\w)")]
ADDRESS_LEFT = re.compile(r"[\w.+-]{1,64}$")
ADDRESS_RIGHT = re.compile(r"[\w-]{1,40}(?:(?:\.| dot | ?\(dot\) ?| ?\[dot\] ?)[\w-]{1,40}){0,5}", re.I)
TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\s|[^\w\s]|_|.", re.S)


def stretches(text: str, blocked: list[Span]) -> list[tuple[int, int, bool]]:
    """Places ``(start, end, is a number)`` that can hold a segment, in order and apart; none touches a blocked span."""
    found = []
    for m in NUMBERS.finditer(text):
        start, end = m.span()
        while start and text[start - 1] in "+(" and m.start() - start < 2:
            start -= 1
        found.append((start, end, True))
    for mark in MARKS:
        for m in mark.finditer(text):
            start, end = m.span()
            start, end = start - (text[start - 1:start] == " "), end + (text[end:end + 1] == " ")
            left, right = ADDRESS_LEFT.search(text, max(0, start - 64), start), ADDRESS_RIGHT.match(text, end)
            if left and right:
                found.append((left.start(), right.end(), False))
    found.sort()
    out, closed, taken = [], 0, 0
    for start, end, number in found:
        start = max(start, closed)
        while taken < len(blocked) and blocked[taken][1] <= start:
            taken += 1
        k = taken
        while start < end:
            while k < len(blocked) and blocked[k][1] <= start:
                k += 1
            upto = min(end, blocked[k][0]) if k < len(blocked) else end
            if upto > start:
                out.append((start, upto, number))
            start = max(upto, blocked[k][1]) if k < len(blocked) and upto < end else end
        closed = max(closed, end)
    return out


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


# ---- features of a whole segment

WORD = re.compile(r"[^\W0-9_][\w.-]*", re.U)
_CUES = {re.sub(r"\W", "", w.lower()): kind for kind, lines in CUES.items() for w in " ".join(lines).split() if len(re.sub(r"\W", "", w)) > 1}
_CUES |= {re.sub(r"\W", "", w.lower()): "other" for w in " ".join(OTHER).split() if re.sub(r"\W", "", w.lower()) not in _CUES}
# fixed values: ends of host names that are common
KNOWN_ENDS = frozenset("com org net edu gov de fr es it nl uk io co info eu ch at be us".split())
DOTS = re.compile(r"\.| dot |\s?\(dot\)\s?|\s?\[dot\]\s?", re.I)
LITTLE = frozenset("a an the in on by of to is was be they we he she it and or arrived stood look meet seen home noon last ease once all first least".split())


def _context(text: str, start: int) -> list[str]:
    before = text[max(0, start - BEFORE):start]
    words = [re.sub(r"\W", "", w.lower()) for w in WORD.findall(before)][-3:]
    cues = {_CUES[w] for w in words if w in _CUES}
    near = before.rstrip()
    return [f"cue:{c}" for c in sorted(cues)] + ([] if cues else ["cue:none"]) + (["currency"] if near[-1:] in "$€£#" and near else [])


def number_features(text: str, start: int, end: int) -> list[str]:
    body = text[start:end]
    groups = re.findall("[0-9]+", body)
    marks = re.sub("[0-9]+", "0", body)
    digits = "".join(groups)
    before, behind = text[start - 1:start], text[end:end + 1]
    sizes = [len(g) for g in groups]
    shape = re.sub("[0-9]+", lambda m: str(len(m[0])), body)
    out = ["number", f"digits:{len(digits)}", f"groups:{min(len(groups), 9)}", f"marks:{''.join(sorted(set(re.sub('[0-9]+', '', body))))[:8]}", f"shape:{shape[:24]}", f"first:{digits[0]}",
           f"longest:{max(sizes)}", f"ends:{marks[0]}"]
    if len(digits) >= 12:
        out.append(f"luhn:{passes_luhn(digits)}:{len(digits) in (15, 16)}")
        out.append(f"fours:{set(sizes[:-1]) == {4} and len(sizes) == 4}")
    if len(groups) == 4:
        parted = set(re.findall("[^0-9]+", body))
        out.append(f"bytes:{all(int(g) <= 255 for g in groups)}:{min(parted) if len(parted) == 1 else 'mixed'}")
    if groups[0][:2] in ("19", "20") and sizes[0] == 4 or groups[-1][:2] in ("19", "20") and sizes[-1] == 4:
        out.append("year")
    if len(set(sizes)) == 1 and len(sizes) > 4:
        out.append("even list")
    if before.isalnum() or before in tuple(".,-/:_+%") and before:
        out.append(f"touched left:{'a' if before.isalnum() else before}")
    if behind.isalnum() or behind in tuple("-/:_%@") and behind or behind in tuple(".,") and text[end + 1:end + 2].isdigit():
        out.append(f"touched right:{'a' if behind.isalnum() else behind}")
    if body.count("(") != body.count(")") or body.count("[") != body.count("]"):
        out.append("unbalanced")
    if text[end:end + 2].strip()[:1].isdigit() or text[max(0, start - 2):start].strip()[-1:].isdigit():
        out.append("more digits beside")
    return out + _context(text, start)


def address_features(text: str, start: int, end: int) -> list[str]:
    body = text[start:end]
    at = AT.search(body)
    if not at:
        return ["address", "no at"]
    name, host = body[:at.start()], body[at.end():]
    labels = DOTS.split(host)
    style = "sign" if "@" in at[0] else "box" if "(" in at[0] or "[" in at[0] else "word"
    spelled = "spelled" if re.search("dot", host, re.I) else "point"
    last = labels[-1].lower()
    out = ["address", f"at:{style}", f"dot:{spelled}", f"at:{style}:{spelled}", f"labels:{min(len(labels), 5)}", f"end:{last in KNOWN_ENDS}", f"end:{last in KNOWN_ENDS}:{style}", f"end size:{min(len(last), 5)}",
           f"little name:{name.lower() in LITTLE}", f"little host:{bool(LITTLE.intersection(x.lower() for x in labels))}", f"name digits:{name.isdigit()}", f"empty:{not all(labels) or not name}"]
    if text[start - 1:start].isalnum() or text[start - 1:start] in tuple("._+-") and start:
        out.append("cut left")
    if text[end:end + 1].isalnum() or text[end:end + 1] in ("_", "-") or re.match(r"(?:\.| dot | ?\(dot\) ?| ?\[dot\] ?)\w", text[end:end + 10], re.I):
        out.append(f"cut right:{last in KNOWN_ENDS}")
    return out + _context(text, start)


Candidate = tuple[int, int, tuple[int, ...], list[str]]  # first token, token behind the last, types, features


def candidates(text: str, places: list[tuple[int, int]], number: bool) -> list[Candidate]:
    """All segments that the model allows within one stretch."""
    out: list[Candidate] = []
    for i, (start, stop) in enumerate(places):
        c = text[start]
        if number:
            if not ("0" <= c <= "9" or c in "(+"):
                continue
            digits = groups = 0
            for j in range(i, min(len(places), i + MOST)):
                left, right = places[j]
                if "0" <= text[left] <= "9":
                    digits, groups = digits + right - left, groups + 1
                    if digits > DIGITS[1] or groups > GROUPS:
                        break
                    if digits >= DIGITS[0] or "." in text[start:right] or "dot" in text[start:right]:
                        out.append((i, j + 1, (1, 2, 3), number_features(text, start, right)))
        elif c.isalnum():
            for j in range(i + 2, min(len(places), i + MOST)):
                if text[places[j][0]].isalnum() and AT.search(text[start:places[j][1]]):
                    out.append((i, j + 1, (0,), address_features(text, start, places[j][1])))
    return out


# ---- the model

Weights = tuple[dict[str, np.ndarray], np.ndarray]  # of each feature by type, and of each type behind each type


def _log_sum(x: np.ndarray, axis) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.sum(np.exp(x - top), axis=axis))


class Table:
    """Labelled stretches as arrays: candidates with their features, and which of them are right."""

    def __init__(self, lines: list[tuple[str, list[tuple[int, int, str]]]]):
        self.names: dict[str, int] = {}
        rows, columns, where, gold = [], [], [], []
        self.gold_pairs = np.zeros((OUTSIDE + 1, OUTSIDE + 1))
        lengths = []
        for text, spans in lines:
            right = {(a, b): KINDS.index(kind) for a, b, kind in spans}
            for start, end, number in stretches(text, base_spans(text)):
                places = tokens(text, start, end)
                e, path = len(lengths), []
                lengths.append(len(places))
                for i, j, kinds, features in candidates(text, places, number):
                    good = right.get((places[i][0], places[j - 1][1]))
                    for kind in kinds:
                        where.append((e, i, j, kind))
                        gold.append(good == kind)
                        rows.extend([len(where) - 1] * len(features))
                        columns.extend(self.names.setdefault(f, len(self.names)) for f in features)
                        if good == kind:
                            path.append((i, j, kind))
                at, last = 0, OUTSIDE
                for i, j, kind in [*sorted(path), (len(places), len(places), None)]:
                    for _ in range(at, i):
                        self.gold_pairs[last, OUTSIDE] += 1
                        last = OUTSIDE
                    if kind is not None:
                        self.gold_pairs[last, kind] += 1
                        at, last = j, kind
        self.lengths, self.where, self.gold = np.array(lengths, int), np.array(where, int).reshape(-1, 4), np.array(gold, bool)
        self.rows, self.columns = np.array(rows, int), np.array(columns, int)
        self.batches = []  # stretches of like length, candidates, and these with the number of the stretch in the batch
        for low, high in ((0, 8), (8, 16), (16, 1 << 30)):
            chosen = np.flatnonzero((self.lengths > low) & (self.lengths <= high))
            inside = np.flatnonzero(np.isin(self.where[:, 0], chosen))
            if len(chosen):
                self.batches.append((chosen, inside, np.column_stack([np.searchsorted(chosen, self.where[inside, 0]), self.where[inside, 1:]])))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns, self.where[self.rows, 3]], minlength=len(self.where))

    def gradient(self, w: np.ndarray, pairs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, and its slope in both kinds of weights."""
        values = self.scores(w)
        total, chance, expected = (values[self.gold].sum() + (self.gold_pairs * pairs).sum()), np.zeros(len(values)), np.zeros_like(pairs)
        for stretches_, rows, where in self.batches:
            whole, chance[rows], more = _expected(self.lengths[stretches_], where, values[rows], pairs)
            total -= whole.sum()
            expected += more
        slope = np.bincount(self.columns * w.shape[1] + self.where[self.rows, 3], weights=(self.gold - chance)[self.rows], minlength=w.size).reshape(w.shape)
        return float(total), slope, self.gold_pairs - expected


def _expected(lengths: np.ndarray, where: np.ndarray, values: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the sum over all labellings of each stretch, chance of each candidate, expected pairs of types: forward and backward over segments."""
    n, long, types = len(lengths), int(lengths.max()), OUTSIDE + 1
    widest = min(MOST, long)
    e, i, j, kind = where.T
    score = np.full((n, long + 1, widest + 1, types), -np.inf)  # by end and length
    score[e, j, j - i, kind] = values
    score[:, 1:, 1, OUTSIDE] = np.where(np.arange(1, long + 1)[None, :] <= lengths[:, None], 0.0, -np.inf)
    alpha = np.full((n, long + 1, types), -np.inf)
    alpha[:, 0, OUTSIDE] = 0
    entering = np.full((n, long + 1, types), -np.inf)  # before a segment of a type that starts here
    for t in range(long + 1):
        if t:
            most = min(t, widest)
            alpha[:, t] = _log_sum(entering[:, t - most:t][:, ::-1] + score[:, t, 1:most + 1], 1)  # lengths 1 to most
        entering[:, t] = _log_sum(alpha[:, t, :, None] + pairs[None], 1)
    beta = np.full((n, long + 1, types), -np.inf)
    leaving = np.full((n, long + 1, types), -np.inf)  # a segment of a type starts here
    for t in range(long, -1, -1):
        most = min(long - t, widest)
        if most:
            leaving[:, t] = _log_sum(np.stack([score[:, t + k, k] + beta[:, t + k] for k in range(1, most + 1)], 1), 1)
        beta[:, t] = np.where((lengths == t)[:, None], 0.0, _log_sum(pairs[None] + leaving[:, t, None, :], 2))
    whole = _log_sum(alpha[np.arange(n), lengths], 1)
    chance = np.exp(np.minimum(0, entering[e, i, kind] + values + beta[e, j, kind] - whole[e]))
    expected = np.exp(alpha[..., :, None] + pairs + leaving[..., None, :] - whole[:, None, None, None])
    return whole, chance, expected.sum((0, 1))


@lru_cache(maxsize=2)
def fit(lines: int = LINES, seed: int = 1) -> Weights:
    """Weights by Adam steps on the likelihood with a quadratic penalty; the same on every machine up to rounding."""
    table = Table(examples(lines, seed))
    w, pairs = np.zeros((len(table.names), OUTSIDE + 1)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    for step in range(1, ROUNDS + 1):
        _, a, b = table.gradient(w, pairs)
        for k, (weight, slope) in enumerate(((w, a), (pairs, b))):
            slope = slope / len(table.lengths) - DECAY * weight
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            weight += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return {name: w[at, :OUTSIDE] for name, at in table.names.items()}, pairs


def segments(text: str, places: list[tuple[int, int]], number: bool, weights: Weights) -> list[Span]:
    """The best labelling of one stretch: places and types of its segments."""
    known, pairs = weights
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, kinds, features in candidates(text, places, number):
        total = sum((known[f] for f in features if f in known), np.zeros(OUTSIDE))
        for kind in kinds:
            ending.setdefault(j, []).append((i, kind, float(total[kind])))
    if not ending:
        return []
    best = [{OUTSIDE: (0.0, -1, -1)}]
    for t in range(1, len(places) + 1):
        here: dict[int, tuple[float, int, int]] = {}
        for i, kind, score in [(t - 1, OUTSIDE, 0.0), *ending.get(t, [])]:
            total, before = max((value[0] + pairs[last, kind], last) for last, value in best[i].items())
            if kind not in here or total + score > here[kind][0]:
                here[kind] = (total + score, i, before)
        best.append(here)
    t, kind, out = len(places), max(best[-1], key=lambda k: best[-1][k][0]), []
    while t:
        _, i, before = best[t][kind]
        if kind != OUTSIDE:
            out.append((places[i][0], places[t - 1][1], kind))
        t, kind = i, before
    return out[::-1]


def added_spans(text: str, base: list[Span], weights: Weights) -> list[Span]:
    """Spans of the model beside those of the patterns, with which they share no character."""
    out = []
    for start, end, number in stretches(text, sorted(base)):
        out += segments(text, tokens(text, start, end), number, weights)
    return out


SPAN = "array<struct<start:long,rank:int,stop:long,kind:string>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` of every row: spans by start, then kind; places are code points and the end is exclusive.

    A null or empty text has none; rows alike in id and text give a row each.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                more = added_spans(text, found, weights.value) if text else []
                for into, spans in ((base, found), (added, more)):
                    into.append([{"start": a, "rank": k, "stop": b, "kind": KINDS[k]} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    return columns_of(docs, doc_id="long", text="string").mapInArrow(run, f"doc_id long, base {SPAN}, added {SPAN}")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by the name of its kind; of overlapping spans the first and then the longest is taken."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
            at = end
    return "".join([*out, text[at:]])
