"""Personal data: candidates scored by gradient-boosted trees.

Plain patterns give the base spans (e-mail, ip, card, phone), which always stay. Generators of high recall propose
further, overlapping spans: spelled-out addresses, spaced or defanged ips, numbers with other separators. Boosted
trees judge each by its format (digits, separators, check sum, part sizes) and its context (the characters and the
digits around it); thresholds for each kind are set on calibrated chances so that hardly a wrong candidate
passes. The trees are fitted on the driver from a bounded sample (TRAIN_TEXTS texts, EXAMPLES examples): base spans
and base spans respelled in place are the positives; candidates of a wrong format, respelled likewise, and what the
generators find elsewhere are the negatives, but for candidates that look like a real respelling: nobody knows what
they are, so they teach nothing. Most texts have neither digits nor "@" and are passed over by one search.

Defined cases: null text counts as empty and has no spans; overlapping spans of different kinds are all listed and
redacted once; repeated rows each get a row; without a single base span in the sample only base spans are found; the
work grows in proportion to a text's length, whatever is in it (a million digits, zeros or addresses in a row).
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import calibration, chance
from .shared import documents, pieces_of, smallest_hashes

KINDS = ("email", "ip", "card", "phone")
#: Texts with candidates that the trees are fitted on, those with the smallest hashes, and examples from them.
TRAIN_TEXTS, EXAMPLES = 3000, 30_000
#: Base spans, and other candidates, of one text that the trees are fitted on, at most (chosen at random).
TEXT_SPANS = 64
#: Ways in which each base span is written anew.
RESPELLINGS = 8
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 16
#: Wrong candidates among those that pass, at most, on the part of the sample held back for calibration.
WRONG = 0.01
LEAST_CHANCE = 0.9
BATCH_BYTES = 8_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers joined by dots, as many as there are: every four in a row are an address.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
#: Marks of a spelled-out address, looked for in lower case; a search for the literal comes first, so texts without one cost little.
MARKS = ("(at)", "[at]", "{at}")
SPELLED = re.compile(r" at [a-z0-9-]+ ?(?:\.|[(\[{]?dot\b)[a-z ()\[\]{}]")
DIGIT = re.compile(r"[0-9]")
AT, DOT = r"(?: ?(?:@|\(at\)|\[at\]|\{at\}) ?| at )", r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?| dot )"
WIDE = {
    "email": re.compile(rf"\b[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{{0,63}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}\b", re.IGNORECASE),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|\(\.\)|, ?|-)[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./()-]{0,2}[0-9]){7,12}(?![0-9A-Za-z])"),
}


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap: the letters before each "@", if a domain follows it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost dotted fours of parts up to 255 that don't overlap; those with a greater part are passed over whole."""
    found = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k: k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in four)):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the plain patterns, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", a, b) for a, b in addresses(text)]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def spelled_out(text: str) -> bool:
    """Whether a text without "@" may hold an address."""
    low = text.lower()
    return any(x in low for x in MARKS) or SPELLED.search(low) is not None


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """What the generators propose; spans may overlap."""
    for k in KINDS:
        if ("@" in text or spelled_out(text)) if k == "email" else DIGIT.search(text):
            yield from ((k, m.start(), m.end()) for m in WIDE[k].finditer(text))


def plausible(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate may be what people write on purpose: it is never taken for a wrong one."""
    span, digits = text[start:end].lower(), digits_of(text[start:end])
    if kind == "email":
        return re.search(r"[a-z]{2}\Z", span) is not None and ("@" in span or any(x in span for x in MARKS) or " at " in span and re.search(r"\bdot\b", span) is not None)
    if kind == "ip":
        return all(int(p.lstrip("0")[:4] or "0") <= 255 for p in re.findall("[0-9]+", span)) and not re.search("[,-]", span)
    if kind == "card":
        return luhn(digits)
    return span.startswith(("+", "00")) and 9 <= len(digits) <= 15


def described(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, digits = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - 12): start], text[end: end + 12]
    parts = [p for p in re.split(r"[^0-9]+", span) if p]
    low = span.lower()
    marks = [c for c in span if not c.isalnum()]
    word = len(re.search(r"\S*\Z", before)[0]) + len(re.match(r"\S*", after)[0])
    return [
        KINDS.index(kind), len(digits), len(span), len(parts), max((len(p) for p in parts), default=0),
        max((int(p[:6]) for p in parts), default=0), float(luhn(digits)) if digits else 0.0, span.count("."), float("+" in span) + float(span.startswith("00")),
        float("(" in span and ")" in span), len(set(marks)), len(marks), float("@" in span), float("(at)" in low or "[at]" in low or "{at}" in low),
        float(bool(re.search(r"\bdot\b", low))), float(" at " in low), float(before[-1:].isalnum()) + 2 * float(after[:1].isalnum()),
        float(bool(re.search(r"[0-9]", before))) + float(bool(re.search(r"[0-9]", after))), word, len(low.rsplit(" ", 1)[-1]),
        float(plausible(text, kind, start, end)), float(bool(re.search(r"[a-z0-9] ?\. [A-Z]", span))), sum(low.count(x) for x in (*MARKS, "(dot)", "[dot]", "{dot}", " dot ")),
    ]


def renamed(email: str, rng: np.random.Generator) -> str:
    """Half of the time without digits, so that these don't tell an address from other words."""
    return re.sub("[0-9]", "", email) if rng.random() < 0.5 and re.fullmatch(r"[^@]*[^@0-9][^@]*@[A-Za-z-]+(\.[A-Za-z-]+)+", email) else email


def respelled(text: str, span: tuple[str, int, int], rng: np.random.Generator) -> tuple[str, tuple[str, int, int]]:
    """The text with the span written another way, and where it then is."""
    kind, start, end = span
    old, pick = text[start:end], lambda *x: x[int(rng.integers(len(x)))]
    if kind == "email":
        old = renamed(old, rng)
        new = old.replace("@", pick("(at)", "[at]", "{at}", " (at) ", " at ", " [at] ", " AT ", "(AT)")).replace(".", pick(".", " dot ", "(dot)", " (dot) ", "[dot]", " DOT "))
    elif kind == "ip":
        new = old.replace(".", pick("[.]", "(.)", " . "))
    elif kind == "card":
        d, sep = digits_of(old), pick(".", "/", "_", "  ", " - ")
        new = sep.join(d[i: i + 4] for i in range(0, len(d), 4))
    else:
        new = re.sub(r"[ .-]", pick("/", ".", "-"), old).replace("+", pick("00", "+"))
    return text[:start] + new + text[end:], (kind, start, start + len(new))


def broken(text: str, span: tuple[str, int, int], rng: np.random.Generator) -> tuple[str, tuple[str, int, int]]:
    """The text with a span of nearly the same look that is not what it seems."""
    kind, start, end = span
    old, pick = text[start:end], lambda *x: x[int(rng.integers(len(x)))]
    if kind == "email":
        # a name at a place, and the next sentence
        name, place = renamed(old, rng).split("@")
        new = name + pick(" at ", " AT ", "@", " @ ") + place.split(".")[0] + pick(". ", " . ") + pick("The", "It", "This", "But", "Then", "He")
        return text[:start] + new + text[end:], (kind, start, start + len(new))
    if kind == "ip":
        new = re.sub(r"[0-9]+", str(int(rng.integers(256, 999))), old, count=1)
    elif kind == "card":
        i = max(i for i, c in enumerate(old) if c.isdigit())
        new = old[:i] + str((int(old[i]) + int(rng.integers(1, 9))) % 10) + old[i + 1:]
    else:
        new = re.sub(r"[^0-9]", "", old)[: int(rng.integers(8, 14))]
    return text[:start] + new + text[end:], (kind, start, start + len(new))


@dataclass
class Trees:
    """Boosted trees of fixed depth; ``edges`` are the features' bin borders."""

    edges: np.ndarray
    splits: list = field(default_factory=list)
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.bias)
        for features, cuts, leaves in self.splits:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[np.arange(len(x)), features[node]] >= cuts[node])
            out += leaves[node - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees fitted to the log loss by Newton steps on binned features."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    trees = Trees(np.stack([np.quantile(x[:, i], quantiles) for i in range(x.shape[1])]))
    bins, margin = trees.binned(x), np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    trees.bias = float(margin[0])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        features, cuts = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS + 1)
        node = np.zeros(len(x), int)
        for level in range(DEPTH):
            first = 2**level - 1
            for n in range(first, 2 * first + 1):
                own, best = np.flatnonzero(node == n), 1e-6
                if len(own) < 2:
                    continue
                for f in range(x.shape[1]):
                    gs, hs = (np.bincount(bins[own, f], v[own], BINS + 1) for v in (g, h))
                    gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                    gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - gs.sum() ** 2 / (hs.sum() + 1)
                    if gain.max() > best:
                        best, features[n], cuts[n] = gain.max(), f, int(gain.argmax()) + 1
            node = 2 * node + 1 + (bins[np.arange(len(x)), features[node]] >= cuts[node])
        leaf = node - (2**DEPTH - 1)
        leaves = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        trees.splits.append((features, cuts, leaves))
        margin += leaves[leaf]
    return trees


class Covered:
    """Disjoint stretches of a text, in order."""

    def __init__(self, spans: Iterable[tuple[str, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: tuple[str, int, int]) -> bool:
        i = bisect.bisect_left(self.starts, span[2])
        return i > 0 and self.ends[i - 1] > span[1]

    def add(self, span: tuple[str, int, int]) -> None:
        """A span that meets none of the others."""
        i = bisect.bisect_left(self.starts, span[1])
        self.starts.insert(i, span[1])
        self.ends.insert(i, span[2])


def examples(text: str) -> Iterator[tuple[list[float], int, bool, str]]:
    """(features, whether it is right, whether it is for calibration, kind) of what a text teaches."""
    seed = zlib.crc32(text.encode())
    rng, base, part = np.random.default_rng(seed), base_spans(text), seed % 3 == 0
    some = lambda x: [x[i] for i in sorted(rng.permutation(len(x))[:TEXT_SPANS])]
    for kind, start, end in some(base):
        window, near = text[max(0, start - 200): end + 200], (kind, min(start, 200), min(start, 200) + end - start)
        yield described(window, *near), 1, part, kind
        for _ in range(RESPELLINGS):
            right, wrong = respelled(window, near, rng), broken(window, near, rng)
            yield described(right[0], *right[1]), 1, part, kind
            if not any(s == wrong[1] for s in base_spans(wrong[0])):
                x, at = wrong if kind == "email" or rng.random() < 0.5 else respelled(*wrong, rng)
                yield described(x, *at), 0, part, kind
    covered = Covered(base)
    for c in some([c for c in candidates(text) if not covered.meets(c) and not plausible(text, *c)]):
        yield described(text, *c), 0, part, c[0]


def learnt(rows: list[tuple[list[float], int, bool, str]]) -> Trees | None:
    """Trees, calibration and thresholds from examples; None where they can't tell anything."""
    if not rows:
        return None
    x, y, part = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], bool)
    if len(set(y[~part].tolist())) < 2 or len(set(y[part].tolist())) < 2:
        return None
    trees = boosted(x[~part], y[~part])
    margin, y, kinds = trees.margins(x[part]), y[part], np.array([r[3] for r in rows])[part]
    trees.a, trees.b = calibration(margin, y)
    p = chance(margin, trees.a, trees.b)
    for kind in KINDS:
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(-p[own], kind="stable")]
        wrong = np.cumsum(1 - y[own]) / np.arange(1, len(own) + 1)
        good = np.flatnonzero(wrong <= WRONG)
        trees.thresholds[kind] = max(LEAST_CHANCE, float(p[own[good[-1]]])) if len(good) else 2.0
    return trees


def fit(df: DataFrame, train_texts: int = TRAIN_TEXTS, most: int = EXAMPLES) -> Trees | None:
    """From the texts that hold a digit or "@", train_texts at most, and their examples with the smallest hashes."""
    sample = smallest_hashes(documents(df).filter(F.col("text").rlike("[0-9@]")), train_texts, "doc_id", "text")
    kinds = (pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for rows in itertools.batched(examples(text), 2048):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["x", "y", "part", "kind"])

    rows = sample.mapInArrow(run, "x array<double>, y int, part boolean, kind string")
    rows = rows.orderBy(F.xxhash64("x", "y", "kind")).limit(most).collect()
    return learnt(sorted((list(r["x"]), r["y"], r["part"], r["kind"]) for r in rows))


def found_spans(text: str, trees: Trees | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind, then start."""
    if not ANY.search(text) and not spelled_out(text):
        return [], []
    base = base_spans(text)
    covered, more = Covered(base), []
    for some in itertools.batched((c for c in candidates(text) if not covered.meets(c)) if trees else (), 4096):
        p = chance(trees.margins(np.array([described(text, *c) for c in some], float)), trees.a, trees.b)
        more += [(x, c) for c, x in zip(some, p.tolist(), strict=True) if x >= trees.thresholds[c[0]]]
    taken, chosen = Covered(), []
    for _, c in sorted(more, key=lambda y: -y[0]):  # the likelier one of two that overlap
        if not taken.meets(c):
            taken.add(c)
            chosen.append(c)
    return base, sorted({*base, *chosen}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(df: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    trees = fit(df, train_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            found = [found_spans(t, trees) for t in batch.column("text").to_pylist()]
            kinds = [Counter(s[0] for s in base) for base, _ in found]
            counts = [pa.array([n[k] for n in kinds], pa.int64()) for k in KINDS]
            hashes = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, hashes, pa.array([written(every) for _, every in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return documents(df).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, every: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are replaced together."""
    out, done = [], 0
    for kind, start, end in sorted(every, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """The rows of ``df`` with all their columns; spans in text are replaced."""
    trees = fit(df, train_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            texts = [redact(t, found_spans(t, trees)[1]) if t is not None else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return df.mapInArrow(run, df.schema)
