"""Personal data by candidates and boosted trees.

Base rules find e-mail addresses, IPv4 addresses, payment cards and telephone numbers; what
they find always stays. High-recall generators propose more spans, which may overlap: disguised
addresses ("name [at] host [dot] org"), digit groups, dotted numbers, long mixed tokens and
values behind words such as "password". Boosted trees score each candidate from its format and
its context, and a threshold per kind, calibrated on a part of the texts that the trees did
not see, selects. Selected candidates are taken by score; none overlaps a span already taken.

The trees are fitted on the candidates of all distinct texts, of their rewritten forms and of
values planted into them, 7 of 10 texts; the others, which the trees do not see, set the
thresholds. A text belongs to one side as a whole, copies of a text change nothing, and the model
is the same at every run. Features are coded in fixed bins (``EDGES``), equal codes are counted
together, and what the trees need of them are sums (``boosting``), so no part of the rows meets
in one task or on the driver. Kinds weigh alike. A candidate is personal data if a base rule finds
exactly it, if it is a base span written in another way, if it is a made value planted beside
words of the text, or if it carries a known key format or stands behind a secret's name; it is
none if no rule touches it. The two sides never share a way of writing (``WAYS``), and no rule
that gives labels to secrets is a feature. A kind selects from the score at which, on the unseen
side, ``PRECISION`` of its choice is right and at most ``FALSE_RATE`` of the candidates that are
none are chosen; where there is no such score it selects nothing.

Null and empty texts have no spans. Places count code points, ends are exclusive. Texts are
read whole; equal texts get equal spans; repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.arrays import texts_of
from tidelog.llm.boosting import Trees, grow_trees, task_sums
from tidelog.session import cut, ship

PRECISION = 0.99
FALSE_RATE = 0.001
LARGEST_WEIGHT = 4.0
#: Steps of a margin of 1 that thresholds tell apart.
SCORES = 64
#: Different codes of a row, and of a task about; a task sends sums of a fixed size.
CHUNK = 1 << 14
TASK_CODES = 1 << 17
MOST_TASKS = 1024
#: Characters of a text around a planted value.
AROUND = 120
#: The kinds in the order of their listing, and the base patterns.
KINDS = ["email", "ip", "card", "phone", "secret"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The rule of addresses, tried at the first digit of a run only: where it fails there it fails
#: at the others, and a match ends with its run. So a long run of digits is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MORE = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[(\[{]\s?at\s?[)\]}]|\sat\s)\s?"
        r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|\sdot\s)\s?[A-Za-z0-9-]{2,63})+",
        re.I,
    ),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\s?\.\s?|[\[({]\.[\])}])[0-9]{1,3}){3}(?![\w])"),
    "card": re.compile(r"(?<!\w)[0-9](?:[\x20.\-/_]?[0-9]){12,18}(?!\w)"),
    "phone": re.compile(r"(?<!\w)\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,14}(?!\w)"),
    "secret": re.compile(r"(?<![\w/+=-])[A-Za-z0-9/+_=-]{16,}"),
}
#: Addresses whose plain dots stand between letters, so that they end before the next sentence.
STRICT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[(\[{]\s?at\s?[)\]}]|\sat\s)\s?"
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)[A-Za-z0-9-]{2,63})+",
    re.I,
)
#: What every match of both holds from its ``@`` on, and what may stand before that.
TAIL = re.compile(
    r"[@(\[{\s](?:(?<=@)|(?<=[(\[{])\s?at\s?[)\]}]|(?<=\s)at\s)\s?"
    r"[A-Za-z0-9-]{1,63}\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|\sdot\s|dot\s)\s?[A-Za-z0-9-]{2}",
    re.I,
)
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]", re.I)
NAMED = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[^\s,;]{6,}")
KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:ghp|gho|xox[bp]|sk|pk)[_-][A-Za-z0-9_-]{16,}")
CONTEXT = {
    "email": re.compile(r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel)\W*$"),
    "ip": re.compile(r"(?i)(?:ip|host|server|addr\w*)\W*$"),
    "card": re.compile(r"(?i)(?:card|visa|karte|carte|tarjeta|credit)\W*$"),
    "phone": re.compile(r"(?i)(?:tel\w*|phone|call|fax|mobil\w*|cell)\W*$"),
    "secret": re.compile(r"(?i)(?:password|passwd|pwd|secret|token|key)\W*$"),
}
#: Ways of writing, first those that the trees are fitted on, then those they are measured by:
#: what stands for ``@`` and for dots of an address, between the numbers of an IP address and
#: the groups of a card, the form of a number without its country, what precedes a secret.
WAYS: dict[str, tuple[list, list]] = {
    "email": (
        [(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("{at}", "."), (" @ ", ".")],
        [("[at]", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("{at}", "{dot}"), (" [at] ", " dot ")],
    ),
    "ip": ([" . ", "(.)", "{.}"], ["[.]", " ."]),
    "card": ([".", "/"], ["_"]),
    "phone": (["({}) {}-{}", "0{} {}{}", "{}-{}-{}", "{} {} {}"], ["({}){}-{}", "{}.{}.{}", "0{}/{}{}"]),
    "secret": (["password=", "api_key: ", "token=", "pwd: "], ["secret: ", "passwd=", "api-key="]),
}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


DIGIT = re.compile("[0-9]")
SPACE = re.compile(r"\s")
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Words before some of the planted values.
CUES = {
    "email": ["email: ", "contact ", "mail "],
    "ip": ["host ", "ip ", "server "],
    "card": ["card ", "visa "],
    "phone": ["tel. ", "phone: ", "call "],
    "secret": ["the ", "use "],
}


def emails(text: str) -> Iterator[Span]:
    """The leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from each
    ``@`` outwards, so that long runs of letters without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """What the base rules find, by start and kind."""
    found: list[Span] = [*emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(octet, m[0].split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=order)


def places(rule: re.Pattern, text: str) -> Iterator[re.Match]:
    """All matches, also those that begin inside of others."""
    m = rule.search(text)
    while m:
        yield m
        m = rule.search(text, m.start() + 1)


def addresses(rule: re.Pattern, text: str, starts: list[int]) -> Iterator[Span]:
    """The matches that ``rule.finditer`` gives, from what stands for ``@`` outwards: a match
    begins with the longest run of up to 64 letters before it that no other match holds."""
    done = 0
    for at in starts:
        end = at - 1 if at and SPACE.match(text, at - 1) else at
        start = end
        while start > done and end - start < 64 and LOCAL_RUN.match(text, start - 1):
            start -= 1
        m = rule.match(text, start) if start < end else None
        if m:
            yield "email", m.start(), m.end()
            done = m.end()


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    found: set[Span] = set()
    starts = [m.start() for m in places(TAIL, text)]
    if starts:
        for rule in (MORE["email"], STRICT):
            found.update(addresses(rule, text, starts))
    if DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            found.update((kind, m.start(), m.end()) for m in MORE[kind].finditer(text))
        for m in MORE["secret"].finditer(text):
            if DIGIT.search(m[0]) and any(c.isalpha() for c in m[0]):
                found.add(("secret", m.start(), m.end()))
    if "=" in text or ":" in text:
        found.update(("secret", m.start(), m.start() + len(m[0].rstrip(".!?)"))) for m in NAMED.finditer(text))
    return sorted(found, key=order)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    counts = Counter(own)
    digits = digits_of(own)
    letters = sum(c.isalpha() for c in own)
    groups = re.split(r"\D+", own.strip("+()"))
    entropy = -sum(n / len(own) * math.log2(n / len(own)) for n in counts.values())
    octets = digits and own.count(".") == 3 and all(g and len(g) <= 3 and int(g) <= 255 for g in groups)
    domain = re.split(r"[.\s\])}]+", own)[-1]
    return [
        *(float(kind == k) for k in KINDS),
        len(own),
        len(digits),
        letters,
        len(own) - len(digits) - letters,
        entropy,
        len(counts) / len(own),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(bool(octets)),
        float("+" in own or before.endswith("+")),
        float("(" in own),
        float("@" in own),
        float("=" in own or ":" in own),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(domain) if domain.isalpha() else 0,
        sum(c.isupper() for c in own) / len(own),
        *(float(CONTEXT[k].search(before) is not None) for k in KINDS),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
    ]


N_FEATURES = len(features("a", ("email", 0, 1)))
#: Where the bins of each feature end: shares by 32nds, bits by eighths, numbers one by one at
#: first; so codes do not depend on the rows, and equal ones can be counted together.
SHARES, BITS = np.arange(32) / 32, np.arange(1, 49) / 8
NUMBERS = np.concatenate([np.arange(40), np.arange(40, 64, 4), 2.0 ** np.arange(6, 16)])
FLAG = np.zeros(1)
EDGES: list[np.ndarray] = [
    *[FLAG] * 5, *[NUMBERS] * 4, BITS, SHARES, *[FLAG] * 6, *[NUMBERS] * 4, SHARES, *[FLAG] * 7,
]


def restyled(rng: random.Random, kind: str, own: str, unseen: bool) -> str:
    """A value written in another way."""
    way = rng.choice(WAYS[kind][unseen])
    if kind == "email":
        user, _, host = own.rpartition("@")
        return user + way[0] + host.replace(".", way[1])
    if kind == "ip":
        return way.join(own.split("."))
    if kind == "card":
        d = digits_of(own)
        return way.join(d[k : k + 4] for k in range(0, len(d), 4))
    if kind == "phone":
        d = digits_of(own)[-10:]
        return way.format(d[:3], d[3:6], d[6:])
    return way + own


def made(rng: random.Random, kind: str) -> str:
    """A value of a kind in its plain form."""
    if kind == "email":
        names = ["".join(rng.choices(LETTERS, k=rng.randint(3, 9))) for _ in range(4)]
        user = names[0] + rng.choice(["", ".", "_"]) + names[1] + rng.choice(["", str(rng.randint(1, 99))])
        return f"{user}@{rng.choice([names[2], names[2] + '-' + names[3]])}.{rng.choice(['com', 'org', 'net', 'de', 'io', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        start = rng.choice("3456") + "".join(rng.choices(DIGITS, k=14))
        return next(start + d for d in DIGITS if luhn(start + d))
    if kind == "phone":
        return f"+{rng.randint(1, 99)} {rng.randint(201, 989)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
    return "".join(rng.choices(LETTERS + LETTERS.upper() + DIGITS, k=rng.randint(16, 40)))


def rewritten(rng: random.Random, text: str, spans: list[Span], unseen: bool) -> tuple[str, list[Span]]:
    """The text with its base spans written in other ways, and where they stand then."""
    out, found, at, size = [], [], 0, 0
    for kind, start, end in spans:
        if start < at:
            continue
        own = restyled(rng, kind, text[start:end], unseen)
        gap = text[at:start]
        out += [gap, own]
        size += len(gap)
        found.append((kind, size, size + len(own)))
        size += len(own)
        at = end
    return "".join([*out, text[at:]]), found


def planted(rng: random.Random, text: str, kind: str, unseen: bool) -> tuple[str, Span]:
    """A made value between two words of the text, with what stands around it, and its place."""
    at = rng.randint(0, len(text))
    gap = SPACE.search(text, at)
    at = gap.start() if gap else len(text)
    before = text[max(0, at - AROUND) : at] + " "
    if rng.random() < 0.3:
        before += rng.choice(CUES[kind])
    own = restyled(rng, kind, made(rng, kind), unseen)
    after = rng.choice([" ", ". ", ", "]) + text[at : at + AROUND].lstrip()
    return before + own + after, (kind, len(before), len(before) + len(own))


def labelled(text: str, unseen: bool) -> list[tuple[list[float], int]]:
    """Candidates of a text, of its rewritten form and of values planted into it, labelled."""
    out = []
    base = base_spans(text)
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    other = rewritten(rng, text, base, unseen)
    for own, true in ((text, base), other):
        if out and own is other[0] and own == text:
            out += out
            break
        exact = set(true)
        for span in candidates(own):
            kind, start, end = span
            value = own[start:end]
            if kind == "secret":
                label = int(bool(KEY.search(value) or NAMED.match(value)))
            elif span in exact or any(k == kind and abs(s - start) <= 1 and abs(e - end) <= 1 for k, s, e in exact):
                label = 1
            else:
                # Beside a true span of its kind the label is unclear.
                if any(k == kind and s < end and start < e for k, s, e in exact):
                    continue
                label = 0
            out.append((features(own, span), label))
    for kind in KINDS:
        own, (_, start, end) = planted(rng, text, kind, unseen)
        for span in candidates(own):
            if span[1] < end and start < span[2]:
                same = span[0] == kind
                whole = abs(span[2] - end) <= 1 and (abs(span[1] - start) <= 1 or (kind == "secret" and span[1] >= start))
                if same and whole:
                    out.append((features(own, span), 1))
                elif not same and span[0] != "secret":
                    out.append((features(own, span), 0))
    return out


class Covered:
    """Disjoint ranges in order, to tell what overlaps them."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=order):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start

    def add(self, start: int, end: int) -> None:
        """A range that meets none."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


@dataclass
class PiiModel:
    """The trees and the score from which each kind selects; above 1 selects nothing."""

    trees: Trees
    thresholds: dict[str, float]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """The base spans, and all spans."""
        text = text or ""
        base = base_spans(text)
        taken = list(base)
        covered = Covered(base)
        more = [c for c in candidates(text) if not covered.meets(c[1], c[2])]
        if more:
            score = self.trees.probability(np.array([features(text, c) for c in more]))
            for i in sorted(range(len(more)), key=lambda i: (-score[i], order(more[i]))):
                kind, start, end = more[i]
                if score[i] >= self.thresholds.get(kind, 2.0) and not covered.meets(start, end):
                    taken.append(more[i])
                    covered.add(start, end)
        return base, sorted(taken, key=order)


def calibrated(score: np.ndarray, label: np.ndarray, n: np.ndarray) -> float:
    """The lowest score from which on the labels are right in PRECISION of the cases, with at
    most FALSE_RATE of the others among them; ``n`` cases stand behind a row."""
    right, wrong = n * label, n * (1 - label)
    if not right.sum():
        return 2.0
    by = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[by]) / np.cumsum(n[by])
    last_of_tie = np.append(score[by][1:] != score[by][:-1], True)
    few = np.cumsum(wrong[by]) <= FALSE_RATE * wrong.sum()
    good = np.flatnonzero((precision >= PRECISION) & few & last_of_tie)
    return max(0.5, float(score[by][good[-1]])) if len(good) else 2.0


def codes_of(rows: list[tuple[list[float], int]], unseen: int) -> np.ndarray:
    """A row of bytes for each labelled candidate: its codes, its label and its side."""
    out = np.full((len(rows), N_FEATURES + 2), unseen, np.uint8)
    if rows:
        x = np.array([r[0] for r in rows], float)
        for j, edges in enumerate(EDGES):
            out[:, j] = np.searchsorted(edges, x[:, j], "left")
        out[:, N_FEATURES] = [r[1] for r in rows]
    return out


def coded(docs: DataFrame, text_col: str) -> DataFrame:
    """``key, codes``: the labelled candidates of every distinct text, as rows of bytes; the
    texts stay where they are, only what is found in them is made distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = batch.column(2).to_pylist()
            codes = [
                codes_of(labelled(text, bool(side)), side).tobytes()
                for text, side in zip(texts_of(batch.column(0)).to_pylist(), sides, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(codes, pa.binary())], ["key", "codes"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(text)
    side = (F.pmod(F.xxhash64(key, F.lit(1)), F.lit(10)) >= 7).cast("int")
    return docs.select(text, key, side).mapInArrow(run, "key long, codes binary").dropDuplicates(["key"])


def counted(codes: DataFrame) -> DataFrame:
    """``code, n``: how often each row of bytes stands in ``codes``."""
    kind = np.dtype((np.void, N_FEATURES + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in own], pa.binary()), pa.array(n)], ["code", "n"])

    return codes.select("codes").mapInArrow(run, "code binary, n long").groupBy("code").agg(F.sum("n").alias("n"))


def limited(codes: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` candidates, of which each kind and side has its share, for callers who
    ask for a sample."""
    width = N_FEATURES + 2
    at = F.explode(F.sequence(F.lit(0), (F.length("codes") / width).cast("int") - 1)).alias("at")
    every = codes.where(F.length("codes") > 0).select("key", at, "codes")
    every = every.select("key", "at", F.expr(f"substring(codes, at * {width} + 1, {width})").alias("codes"))
    parts = []
    for kind in range(len(KINDS)):
        for side, tenths in ((0, 7), (1, 3)):
            own = F.expr(f"substring(codes, {kind + 1}, 1) = X'01' and substring(codes, {width}, 1) = X'0{side}'")
            best = every.where(own).orderBy(F.xxhash64("key", "at"), "key", "at")
            parts.append(best.limit(rows * tenths // (10 * len(KINDS))).select("codes"))
    return reduce(DataFrame.union, parts)


def chunked(counts: DataFrame) -> DataFrame:
    """``unseen, codes, y, n``: up to ``CHUNK`` different codes in each row, in packed arrays."""
    size = counts.count()
    parts = min(MOST_TASKS, max(-(-size // TASK_CODES), min(counts.sparkSession.sparkContext.defaultParallelism, size // CHUNK), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), CHUNK):
                part = batch.slice(first, CHUNK)
                codes = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(len(part), -1)
                n = part.column(1).to_numpy()
                for side in (0, 1):
                    own = codes[:, -1] == side
                    packed = (codes[own, :N_FEATURES].T.tobytes(), codes[own, N_FEATURES].tobytes(), n[own].tobytes())
                    columns = [pa.array([side], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]
                    yield pa.RecordBatch.from_arrays(columns, ["unseen", "codes", "y", "n"])

    return counts.repartition(parts).mapInArrow(run, "unseen int, codes binary, y binary, n binary")


def kind_sums(codes: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.array([n[codes[k] > 0].sum() for k in range(len(KINDS))], np.int64)


def score_sums(trees: Trees) -> Callable:
    """How many candidates of each kind and label have each score, by ``SCORES`` steps of the
    margin."""

    def sums(codes: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        step = np.floor(np.clip(trees.margin_of_codes(codes), -30, 30) * SCORES).astype(np.int64) + 30 * SCORES
        out = np.zeros((len(KINDS), 2, 60 * SCORES + 1), np.int64)
        for k in range(len(KINDS)):
            own = codes[k] > 0
            np.add.at(out[k], (y[own], step[own]), n[own])
        return out

    return sums


def fit_pii(docs: DataFrame, text_col: str = "text", sample_docs: int | None = None, sample_rows: int | None = None) -> PiiModel:
    """The model from all texts; a caller who wants less work may ask for a sample of about
    ``sample_docs`` texts and at most ``sample_rows`` candidates."""
    ship(docs.sparkSession)
    if sample_docs is not None:
        key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        share = min(1.0, sample_docs / max(1, docs.select(key).distinct().count()))
        docs = docs.where(F.pmod(key, F.lit(1_000_000)) < int(share * 1_000_000))
    codes = coded(docs, text_col)
    if sample_rows is not None:
        codes = limited(cut(codes), sample_rows)
    chunks = cut(chunked(cut(counted(codes))))
    seen = chunks.where("unseen = 0").select("codes", "y", "n")
    total = task_sums(seen, kind_sums, N_FEATURES)
    # Kinds weigh alike, but no candidate more than LARGEST_WEIGHT.
    weights = np.minimum(LARGEST_WEIGHT, total.sum() / np.maximum(1, len(KINDS) * total))
    trees = grow_trees(seen, EDGES, weights)
    often = task_sums(chunks.where("unseen = 1").select("codes", "y", "n"), score_sums(trees), N_FEATURES)
    thresholds = {}
    for kind, n in zip(KINDS, often, strict=True):
        label, step = np.nonzero(n)
        score = trees.probability_of_margin(step / SCORES - 30)
        thresholds[kind] = calibrated(score, label, n[label, step])
    return PiiModel(trees, thresholds)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii_spans(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts and the digest of the base spans, all spans and their number, of
    every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # trees of a fixed number and depth
    base_kinds = KINDS[:4]
    names = [id_col, *(f"n_{k}" for k in base_kinds), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            counts: list[list[int]] = [[] for _ in base_kinds]
            digests, spans, number_of_all = [], [], []
            for text in texts_of(batch.column(1)).to_pylist():
                base, every = own.spans(text)
                number = Counter(k for k, _, _ in base)
                for into, kind in zip(counts, base_kinds, strict=True):
                    into.append(number[kind])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
                number_of_all.append(len(every))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(number_of_all, pa.int64()),
                ],
                names,
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redacted(spark: SparkSession, model: PiiModel) -> Callable:
    """A column function: the text with a mark such as ``<EMAIL>`` for each span; overlapping
    spans share the mark of the first. Null texts stay null."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # trees of a fixed number and depth

    def redact(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, start, end in shared.value.spans(text)[1]:
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    @F.pandas_udf(T.StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(redact)

    return run
