"""Personal data by candidate gradient boosting.

Base spans follow fixed rules (``base_spans``): e-mail addresses, IP addresses,
card numbers and phone numbers, the leftmost non-overlapping matches of a kind,
those that fail their check dropped.  The method adds spans:

1. Generators with high recall propose overlapping candidates: for every
   sequence of neighbouring digit groups the sub-sequences that could be a card,
   a phone or an IP address (so also two numbers that a rule takes as one), for
   every "@", "(at)", "[at]" or " at " before a host the address around it.
2. A candidate's features describe its format (digit groups, separators, check
   digit, octets, host labels) and its context (neighbouring characters and
   numbers, words before it).
3. Per kind, boosted trees (logistic loss, histogram splits) are fitted on all
   candidates of the corpus.  Labels need no annotation: a candidate
   that is a base span is positive; one that cuts across a base span, or is
   itself a dropped match, or lies in no match of a rule, is negative; parts of a
   dropped match have no label and are left to the model.  Every positive
   candidate also gives variants of its format that the rules do not know
   (without country code, with other separators, written-out "at" and "dot",
   with another number right behind it: positive) and decoys of the same place (dates,
   amounts, versions, plain numbers: negative).
4. A fifth of the documents (by crc32 of the id) is not fitted on: it calibrates the
   scores (a logistic curve on the margin) and sets each kind's threshold, the
   least one with a precision of ``precision`` there.
5. Candidates over their threshold are added, best first, where they overlap
   neither a base span nor one added before.

Two passes over the texts, no shuffle of texts.  The candidates are counted by
their features (exact quantiles cut these into ``BINS`` bins, after which equal
ones are counted again); every level of every tree is one job over these counts,
which adds up the histograms of its nodes for all kinds.  The sums are integers
(2^-24 of a gradient), so that the trees do not depend on how rows lie in tasks;
the scores are calibrated on counts of margins in steps of 1/1024.  The driver
holds sums and the model, a few thousand numbers.

Defined cases: null and empty texts have no spans; null ids and repeated rows
are rows like others; an empty table, or a kind without positive candidates,
adds nothing; texts of any length are read whole, every generator in time
proportional to the text; only the named columns are read (``redacted`` returns
all), further columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterwise.llm.common import batches_of, staged

#: The kinds in their order, and the rules of the base spans.
KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

ROUNDS = 60
DEPTH = 3
RATE = 0.2
BINS = 32
#: Steps of a gradient's and a margin's unit, and binned rows a task.
GRADIENT_STEPS = 1 << 24
MARGIN_STEPS = 1 << 10
TASK_ROWS = 1 << 16
MOST_TASKS = 64
PRECISION = 0.99
GROUPS = 6

_NOT_DIGIT = re.compile("[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]+")
_ANY_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_GAP = re.compile(r"[ ().+/-]{1,3}")
_WRITTEN = re.compile(r"(?: ?[\[(]at[\])] ?| at )([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,63})+)", re.IGNORECASE)
_WORTH = re.compile(r"[0-9@]|[\[( ]at[\]) ]", re.IGNORECASE)
#: Words before a span that speak for or against it.
_HINTS = tuple(re.compile(p, re.IGNORECASE) for p in (
    r"phone|tel|call|fax|mobile", r"card|visa|credit|payment|iban|account", r"\bip\b|host|server|address|addr", r"mail|contact|write to",
    r"token|key|secret|hash|sha|id\b", r"version|release|chapter|section|page|figure|no\.?$|\bv$"))


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            end = host.end()
        else:
            end = max(end, at)  # a local part does not reach over an "@"
        at = text.find("@", max(at + 1, end))


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in span.split("."))


def rule_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether its check holds) of every match of a rule."""
    if "@" in text:
        for s, e in _emails(text):
            yield 0, s, e, True
    for m in _IP.finditer(text):
        yield 1, m.start(), m.end(), _octets(m.group())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 12 else ""
        yield 2, m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield 3, m.start(), m.end(), 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    return sorted((s, k, e) for k, s, e, good in rule_matches(text) if good)


def candidates(text: str) -> set[tuple[int, int, int]]:
    """(kind, start, end) of everything that may be personal data."""
    out = set()
    groups = [m.span() for m in _DIGITS.finditer(text)]
    # Whether a group goes on from the one before it, after up to three separators.
    near = [False] + [0 < b[0] - a[1] <= 3 and bool(_GAP.fullmatch(text, a[1], b[0])) for a, b in zip(groups, groups[1:])]
    for i, (first, _) in enumerate(groups):
        digits, flat, dots = 0, True, True
        for j in range(i, min(i + GROUPS, len(groups))):
            lo, hi = groups[j]
            if j > i:
                if not near[j]:
                    break
                gap = text[groups[j - 1][1]:lo]
                flat &= gap in (" ", "-", ".", "/")
                dots &= gap == "."
            digits += hi - lo
            if digits > 19:
                break
            if flat and digits >= 12:
                out.add((2, first, hi))
            if dots and j == i + 3:
                out.add((1, first, hi))
            if 7 <= digits <= 15:
                start = first
                if start and text[start - 1] == "(" and ")" in text[start:hi]:
                    start -= 1
                if start and text[start - 1] == "+":
                    start -= 1
                out.add((3, start, hi))
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start and at - start < 64 and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _ANY_HOST.match(text, end)
        if host and start < at:
            out.add((0, start, host.end()))
        at = text.find("@", at + 1)
    for m in _WRITTEN.finditer(text):
        start = m.start()
        while start and m.start() - start < 64 and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.add((0, start, m.end()))
    return out


def _class(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0 if c in "\"'`=" else 4.0 if c in "+(.-/" else 5.0


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span, left, right = text[start:end], text[max(0, start - 32):start], text[end:end + 8]
    groups = _DIGITS.findall(span)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    rest = right.lstrip(" ().+/-")
    before = left.rstrip(" ().+/-")
    out = [len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), sizes[1] if len(sizes) > 1 else 0, len(span),
           span[:1] == "+", "(" in span, span.count("(") == span.count(")"), span.count("."), span.count("-"), span.count(" "), span.count("/"),
           12 <= len(digits) <= 19 and luhn(digits), sum(len(g) > 3 or int(g) > 255 for g in groups[:8]), sum(len(g) > 1 and g[0] == "0" for g in groups),
           _class(left[-1:]), _class(right[:1]), rest[:1].isdigit() and len(right) - len(rest) <= 2, before[-1:].isdigit() and len(left) - len(before) <= 2,
           len(right) - len(rest), len(left) - len(before)]
    if kind == 0:
        local, sep, host = re.split(r"( ?[\[(]at[\])] ?|@| at )", span, maxsplit=1, flags=re.IGNORECASE)
        labels = re.split(r" ?[\[(]dot[\])] ?| dot |\.", host, flags=re.IGNORECASE)
        out += [len(local), len(labels), len(labels[-1]), labels[-1].isalpha(), sep == "@", local[-1:].isalnum(), "dot" in host.lower() and "." not in host,
                labels[-1] == labels[-1].lower()]
    return [float(x) for x in out] + [float(bool(h.search(left))) for h in _HINTS]


class Spans:
    """Looks up spans that overlap or hold a stretch; spans of one kind do not overlap each other."""

    def __init__(self, spans: Iterable[tuple[int, int, int]]):
        self.kinds = {}
        for s, k, e in sorted(spans):
            starts, ends = self.kinds.setdefault(k, ([], []))
            starts.append(s)
            ends.append(e)

    def overlap(self, start: int, end: int) -> bool:
        return any(bisect_right(ends, start) < bisect_left(starts, end) for starts, ends in self.kinds.values())

    def hold(self, start: int, end: int) -> bool:
        return any((i := bisect_right(starts, start) - 1) >= 0 and ends[i] >= end for starts, ends in self.kinds.values())


def labelled(text: str) -> Iterator[tuple[int, int, int, int | None]]:
    """(kind, start, end, label) of the candidates; label None: a part of a match that its rule dropped."""
    matches = list(rule_matches(text))
    base = [(s, k, e) for k, s, e, good in matches if good]
    dropped = [(s, k, e) for k, s, e, good in matches if not good]
    exact, failed = set(base), set(dropped)
    around, inside = Spans(base), Spans(dropped)
    for k, s, e in sorted(candidates(text)):
        if (s, k, e) in exact:
            yield k, s, e, 1
        elif around.overlap(s, e) or (s, k, e) in failed:
            yield k, s, e, 0
        elif inside.hold(s, e):
            yield k, s, e, None
        else:
            yield k, s, e, 0


#: Numbers that are no personal data (# stands for a random digit).
_DECOYS = ("20##-##-##", "##.##.20##", "##/##/20##", "#.#.#", "########", "#########", "##########", "## ### ###", "#.###.###", "20##-##-## ##",
           "####-####", "### ### ### ###", "97#-#-##-######-#", "97#-##########", "#.##############", "#.#########")


def _variants(kind: int, span: str, draw: np.random.Generator) -> Iterator[tuple[str, str, str, int]]:
    """(text put right before, other text of the span, text put right behind, label)."""
    digit = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    letters = lambda n: "".join("abcdef"[i] for i in draw.integers(0, 6, n))
    if kind == 0:
        local, host = span.rsplit("@", 1)
        short = ".".join(host.split(".")[-2:])
        yield "", f"{local}@{short}", "", 1
        for a, d in ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" [at] ", "."), (" at ", ".")):
            for name in sorted({host, short}):
                yield "", local + a + name.replace(".", d), "", 1
        yield "", f"{local} at {host.split('.')[0]}.{digit(2)}", "", 0
        yield "", f"{letters(4)} at {letters(4)}.{letters(3).capitalize()}", "", 0
        yield "", f"{letters(4)} at {letters(4)}.{letters(3)}.{letters(3).capitalize()}", " " + letters(3), 0
        return
    digits = _NOT_DIGIT.sub("", span)
    for front, behind in ((letters(2), letters(2)), (" ", letters(1)), (letters(1), " ")):
        yield front, digits if kind > 1 else span, behind, 0
    if kind == 1:
        yield "", span, f" +{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", 1
        yield "", ".".join(str(256 + int(digit(2))) for _ in range(4)), "", 0
        yield "", span, f".{digit(2)}", 0
        return
    if kind == 2:
        for sep in "./":
            yield "", sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)), "", 1
        yield "", span, f" {digit(16)}", 1
        yield f"{digit(16)} ", span, "", 1
        last = str((int(digits[-1]) + 1 + int(draw.integers(0, 9))) % 10)
        if last != digits[-1]:
            yield "", digits[:-1] + last, f" {digit(16)}", 0
    else:
        groups = _DIGITS.findall(span)
        if len(groups) > 2:
            yield "", span[span.index(groups[1]) - (span[span.index(groups[1]) - 1] == "("):], "", 1
            yield "", "-".join(groups[1:]), "", 1
            yield "", ".".join(groups[1:]), "", 1
        yield "", span, f" {digit(3)}.{digit(2)}.{digit(3)}.{digit(2)}", 1
        yield "", span, f" {digit(16)}", 1
    for decoy in _DECOYS:
        yield "", "".join(digit(1) if c == "#" else c for c in decoy), "", 0


def _examples(text: str, seed: int) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, features) of a text's labelled candidates, their variants and decoys."""
    draw = np.random.default_rng(seed)
    for k, s, e, label in labelled(text):
        if label is None:
            continue
        yield k, label, features(text, k, s, e)
        if label:
            left, right = text[max(0, s - 32):s], text[e:e + 8]
            for front, other, behind, good in _variants(k, text[s:e], draw):
                at = len(left) + len(front)
                yield k, good, features(left + front + other + behind + right, k, at, at + len(other))


def training_rows(docs: DataFrame) -> DataFrame:
    """(kind, label, held_out, features) of all labelled candidates of the corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(batches_of(b, "id"), batches_of(b, "text")):
                if text and _WORTH.search(text):
                    fold = zlib.crc32(str(doc_id).encode()) % 5 == 0
                    seed = zlib.crc32(text.encode())
                    rows += [(k, y, fold, f) for k, y, f in _examples(text, seed)]
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["kind", "label", "held_out", "features"])

    return docs.mapInArrow(run, "kind int, label int, held_out boolean, features array<double>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features): bin b holds the values up to edge b."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1).astype(np.uint8)


def _leaf_of(feature: list[int], cut: list[int], bins: np.ndarray) -> np.ndarray:
    """Each row's node behind the levels that the inner nodes fill."""
    node, base, feature, cut = np.zeros(len(bins), np.int64), 0, np.array(feature, np.int64), np.array(cut, np.int64)
    while base < len(feature):
        at = base + node
        node, base = 2 * node + (bins[np.arange(len(bins)), feature[at]] > cut[at]), 2 * base + 1
    return node


def histograms(bins: np.ndarray, y: np.ndarray, rows: np.ndarray, state: dict) -> np.ndarray:
    """(2, nodes, features, BINS): the steps of gradient and second derivative of the rows in each node of the open level."""
    margin = np.full(len(y), state["bias"])
    for feature, cut, leaf in state["trees"]:
        margin += np.array(leaf)[_leaf_of(feature, cut, bins)]
    p = _sigmoid(margin)
    sums = [np.rint(v * GRADIENT_STEPS) * rows for v in (y - p, np.maximum(p * (1 - p), 1e-6))]
    n = len(state["feature"]) + 1
    node = _leaf_of(state["feature"], state["cut"], bins) * BINS
    return np.array([[np.bincount(node + c, v, n * BINS).reshape(n, BINS) for c in bins.T] for v in sums]).astype(np.int64).transpose(0, 2, 1, 3)


class Boosting:
    """Boosted trees of full depth, one level at a time: ``take`` gets the histograms of ``state``'s open level."""

    def __init__(self, edges: list[np.ndarray], share: float, depth: int = DEPTH, rate: float = RATE):
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.edges, self.depth, self.rate = edges, depth, rate
        self.state = {"bias": float(np.log(share / (1 - share))), "trees": [], "feature": [], "cut": []}

    def take(self, sums: np.ndarray) -> None:
        g, h = (sums / GRADIENT_STEPS).cumsum(-1)
        gt, ht = g[:, :, -1:], h[:, :, -1:]
        gain = g * g / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt * gt / (ht + 1)
        n, s = len(g), self.state
        f_best, b_best, gain_best = np.zeros(n, np.int64), np.full(n, BINS, np.int64), np.zeros(n)  # bin BINS: all rows go left
        for f, e in enumerate(self.edges):
            gain[:, f, len(e):] = 0
            at = gain[:, f].argmax(1)
            better = gain[np.arange(n), f, at] > gain_best + 1e-9
            gain_best[better], f_best[better], b_best[better] = gain[np.arange(n), f, at][better], f, at[better]
        feature, cut = s["feature"] + f_best.tolist(), s["cut"] + b_best.tolist()
        if len(feature) < (1 << self.depth) - 1:
            self.state = s | {"feature": feature, "cut": cut}
            return
        at, last = np.arange(n), np.minimum(b_best, BINS - 1)
        left = np.stack([g[at, f_best, last], h[at, f_best, last]])
        both = np.stack([left, np.stack([gt[at, f_best, 0], ht[at, f_best, 0]]) - left], 2).reshape(2, -1)
        leaf = self.rate * both[0] / (both[1] + 1)
        self.state = s | {"trees": [*s["trees"], (feature, cut, leaf.tolist())], "feature": [], "cut": []}

    def model(self) -> dict:
        """Per tree the features and cuts of its inner nodes, level by level, and its leaves."""
        value = lambda f, b: float(self.edges[f][b]) if b < len(self.edges[f]) else 1e300
        return {"bias": self.state["bias"], "trees": [{"feature": feature, "cut": [value(f, b) for f, b in zip(feature, cut)], "leaf": leaf}
                                                      for feature, cut, leaf in self.state["trees"]]}


PROBS = np.linspace(0, 1, BINS + 1)[1:-1]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> dict:
    """The trees of rows at hand."""
    grown = Boosting([np.unique(np.quantile(c, PROBS)) for c in x.T], float(y.mean()), depth, rate)
    bins = binned(x, grown.edges)
    for _ in range(rounds * depth):
        grown.take(histograms(bins, y, np.ones(len(y)), grown.state))
    return grown.model()


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["bias"])
    for t in model["trees"]:
        feature, cut, node, base = np.array(t["feature"]), np.array(t["cut"]), np.zeros(len(x), np.int64), 0
        while base < len(feature):
            at = base + node
            node = 2 * node + (x[np.arange(len(x)), feature[at]] > cut[at])
            base = 2 * base + 1
        out += np.array(t["leaf"])[node]
    return out


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float, rows: np.ndarray | None = None) -> tuple[float, float, float]:
    """(slope, offset, threshold): a logistic curve by Newton steps; the rows over the threshold have the precision, which
    lies half way between the least score that has it and the next.  ``rows``: how often each margin and label occurs."""
    a, b = 1.0, 0.0
    rows = np.ones(len(y)) if rows is None else rows
    positive, negative = (rows * y).sum(), (rows * (1 - y)).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    for _ in range(25):
        p = _sigmoid(a * margin + b)
        w, r = rows * np.maximum(p * (1 - p), 1e-9), rows * (target - p)
        hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(r * margin).sum(), r.sum()]))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    a = max(a, 1e-3)
    score = _sigmoid(a * margin + b)
    order = np.argsort(-score, kind="stable")
    right = np.cumsum((rows * y)[order]) / np.cumsum(rows[order])
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        return a, b, 2.0
    after = score[order][good[-1] + 1] if good[-1] + 1 < len(y) else 0.0
    return a, b, max(0.5, float(score[order][good[-1]] + after) / 2)


def _stepped(margin: np.ndarray) -> np.ndarray:
    """Margins in whole steps; beyond 40 a score does not change."""
    return np.rint(np.clip(margin, -40, 40) * MARGIN_STEPS)


def score_of(model: dict, margin: np.ndarray) -> np.ndarray:
    return _sigmoid(model["slope"] * _stepped(margin) / MARGIN_STEPS + model["offset"])


def _counted_bins(rows: DataFrame, edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """(kind, label, held_out, bins, n): the counted candidates by the bins of their features, a byte each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, lists, bins = np.asarray(b["kind"]), b["features"], np.empty(b.num_rows, object)
            for k in edges:
                at = np.flatnonzero(kind == k)
                if len(at):
                    x = np.asarray(lists.take(pa.array(at)).flatten()).reshape(len(at), -1)
                    for i, r in zip(at, binned(x, edges[k])):
                        bins[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([b["kind"], b["label"], b["held_out"], pa.array(bins, pa.binary()), b["n"]], names=["kind", "label", "held_out", "bins", "n"])

    some = rows.filter(F.col("kind").isin(list(edges)))
    return some.mapInArrow(run, "kind int, label int, held_out boolean, bins binary, n long").groupBy("kind", "label", "held_out", "bins").agg(F.sum("n").alias("n"))


def _by_kind(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, bins, labels, numbers) of a task's counted rows, one Arrow batch after the other."""
    for b in batches:
        kind = np.asarray(b["kind"])
        for k in np.unique(kind).tolist():
            at = pa.array(np.flatnonzero(kind == k))
            raw = b"".join(b["bins"].take(at).to_pylist())
            yield k, np.frombuffer(raw, np.uint8).reshape(len(at), -1), np.asarray(b["label"].take(at)).astype(float), np.asarray(b["n"].take(at)).astype(float)


def _summed(rows: DataFrame, states: dict[int, dict]) -> dict[int, np.ndarray]:
    """The histograms of every kind's open level over all rows: integer sums, one array a task and kind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for k, bins, y, n in _by_kind(batches):
            sums[k] = sums.get(k, 0) + histograms(bins, y, n, states[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["kind", "sums"])

    out = {}
    for r in rows.mapInArrow(run, "kind int, sums binary").collect():  # at most MOST_TASKS of them a kind
        out[r["kind"]] = out.get(r["kind"], 0) + np.frombuffer(r["sums"], np.int64)
    return {k: v.reshape(2, len(states[k]["feature"]) + 1, -1, BINS) for k, v in out.items()}


def _margin_counts(rows: DataFrame, models: dict[int, dict], edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """(kind, label, step, n): how often each margin occurs."""
    states = {k: [([*t["feature"]], [int(np.searchsorted(edges[k][f], c)) if c < 1e300 else BINS for f, c in zip(t["feature"], t["cut"])], t["leaf"])
                  for t in m["trees"]] for k, m in models.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, bins, y, n in _by_kind(batches):
            margin = np.full(len(y), models[k]["bias"])
            for feature, cut, leaf in states[k]:
                margin += np.array(leaf)[_leaf_of(feature, cut, bins)]
            step = _stepped(margin).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), pa.array(y.astype(np.int32)), pa.array(step), pa.array(n.astype(np.int64))],
                                             names=["kind", "label", "step", "n"])

    return rows.mapInArrow(run, "kind int, label int, step long, n long").groupBy("kind", "label", "step").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION, rounds: int = ROUNDS) -> dict:
    """Boosted trees, calibration and threshold by kind, from all candidates.  A kind with fewer than 5 positive or negative rows
    to fit or calibrate on has none."""
    found = training_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    counted = staged(found.groupBy("kind", "label", "held_out", "features").agg(F.count(F.lit(1)).alias("n")), "pii-candidates")
    total = {(r["kind"], r["label"], r["held_out"]): r["n"] for r in counted.groupBy("kind", "label", "held_out").agg(F.sum("n").alias("n")).collect()}  # at most 16
    kinds = [k for k in range(len(KINDS)) if min(total.get((k, y, out), 0) for y in (0, 1) for out in (False, True)) >= 5]
    if not kinds:
        return {}
    wide = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.max(F.size("features")).alias("n")).collect()}
    probs = F.array(*map(F.lit, PROBS.tolist()))
    cuts = [F.percentile(F.get("features", F.lit(i)), probs, F.col("n")).alias(f"f{i}") for i in range(max(wide.values()))]
    edges = {r["kind"]: [np.unique(r[f"f{i}"]) for i in range(wide[r["kind"]])]
             for r in counted.filter(F.col("kind").isin(kinds) & ~F.col("held_out")).groupBy("kind").agg(*cuts).collect()}
    bins = staged(_counted_bins(counted, edges), "pii-bins")
    tasks = min(-(-bins.count() // TASK_ROWS), MOST_TASKS)  # a task may read any number of rows
    to_fit, held_out = (bins.filter(c).coalesce(tasks) for c in (~F.col("held_out"), F.col("held_out")))
    grown = {k: Boosting(edges[k], total[k, 1, False] / (total[k, 0, False] + total[k, 1, False])) for k in kinds}
    for _ in range(rounds * DEPTH):  # one job a level, for all kinds
        for k, sums in _summed(to_fit, {k: g.state for k, g in grown.items()}).items():
            grown[k].take(sums)
    models = {k: g.model() for k, g in grown.items()}
    # At most 81,921 steps a kind and label.
    margins_ = _margin_counts(held_out, models, edges).orderBy("kind", "step", "label").toPandas()
    out = {}
    for k, at in margins_.groupby("kind"):
        margin, y, n = at["step"].to_numpy() / MARGIN_STEPS, at["label"].to_numpy().astype(float), at["n"].to_numpy().astype(float)
        a, b, threshold = calibrate(margin, y, precision, n)
        chosen = _sigmoid(a * margin + b) >= threshold
        out[str(k)] = models[k] | {"slope": a, "offset": b, "threshold": threshold, "rows": sum(total[k, y_, o] for y_ in (0, 1) for o in (False, True)),
                                   "held_out_precision": float((n * y)[chosen].sum() / n[chosen].sum()) if chosen.any() else None,
                                   "held_out_recall": float((n * y)[chosen].sum() / (n * y).sum())}
    return out


def added_spans(base: Spans, proposed: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the proposed (score, kind, start, end), best first (then longer, then earlier), those that overlap no span so far."""
    out = []  # sorted (start, end, kind)
    for _, k, s, e in sorted(proposed, key=lambda c: (-c[0], c[2] - c[3], c[2], c[1])):
        at = bisect_left(out, (s, e, k))
        if not base.overlap(s, e) and (at == 0 or out[at - 1][1] <= s) and (at == len(out) or out[at][0] >= e):
            out.insert(at, (s, e, k))
    return [(s, k, e) for s, e, k in out]


def all_spans(texts: list[str | None], model: dict) -> tuple[list, list]:
    """The base spans and all spans (start, kind, end) of every text, by start, then kind."""
    base, around, rows = [], [], {int(k): ([], []) for k in model}
    for i, text in enumerate(texts):
        worth = bool(text) and _WORTH.search(text)
        base.append(base_spans(text) if worth else [])
        around.append(Spans(base[i]))
        if worth:
            for k, s, e in sorted(candidates(text)):
                if k in rows and not around[i].overlap(s, e):
                    rows[k][0].append((i, s, e))
                    rows[k][1].append(features(text, k, s, e))
    proposed = {}
    for k, (at, x) in rows.items():
        if at:
            m = model[str(k)]
            score = score_of(m, margins(m, np.array(x)))
            for (i, s, e), p in zip(at, score.tolist()):
                if p >= m["threshold"]:
                    proposed.setdefault(i, []).append((p, k, s, e))
    return base, [sorted(f + added_spans(around[i], proposed[i])) if i in proposed else f for i, f in enumerate(base)]


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans): arrays of (kind, start, end) by start, then kind; ``spans`` holds the base spans and the added ones."""
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in y], kinds)
                     for y in all_spans(batches_of(b, "text"), model)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    of = "array<struct<kind:string,start:long,end:long>>"
    return small.mapInArrow(run, f"id {kind}, base {of}, spans {of}").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; each stretch of the text that spans cover becomes the first one's kind in brackets."""
    at = docs.columns.index(text_col)

    def rest(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for s, k, e in spans:
            if s >= done:
                out += [text[done:s], f"[{KINDS[k].upper()}]"]
            done = max(done, e)
        return "".join(out) + text[done:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            left = [rest(t, x) if x else t for t, x in zip(texts, all_spans(texts, model)[1])]
            cols = [pa.array(left, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a text: number of base spans by kind, their digest, all spans, number of added ones."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
