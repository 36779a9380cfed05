"""Operator 10: personal data by base patterns and a semi-Markov conditional random field.

The base patterns find each kind apart, leftmost and without retries, so they miss what
stands too close together: a phone number followed by a card number is one long run of
digits for both. The semi-Markov model scores whole candidate segments (digit counts,
group shapes, checksums, neighbours) and a dynamic program over segments of at most
``MAX_TOKENS`` tokens chooses boundaries and types jointly. It reads what the base spans
leave; base spans stay, its entities are added. The program runs along the text and keeps
only the paths that can still win, so a long text is decoded as a short one is. Tokens with
no digit or at-sign within ``MAX_TOKENS`` of them can be in no segment and are skipped.

The model is trained here, on sequences drawn from a seeded generator (see ``examples``);
it does not depend on the corpus and is the same in every run.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits

KINDS = ("email", "ip", "card", "phone")
#: Tokens in one entity, at most.
MAX_TOKENS = 28
#: Tokens held at a time while a text is decoded.
BLOCK = 4096

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A start inside a run of digits never matches where the run's start does not.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by kind as listed, then start; linear in the text."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        # A part before this at-sign cannot be used again by the next one.
        at = text.find("@", done if found else at + 1)
        if not found:
            done = max(done, start)
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the model ------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|[\W_]|.", re.DOTALL)
_OUT = "out"
_LABELS = (_OUT, *KINDS)
_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]+ ?(?:@|\[ ?at ?\]|\( ?at ?\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[ ?dot ?\]|\( ?dot ?\)) ?[A-Za-z0-9-]+)+"
)
_SPLIT = re.compile(r"[0-9]+")


def _side(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def _features(kind: str, span: str, left: str, right: str) -> list[str]:
    """Whole-span features of a candidate entity."""
    groups = _SPLIT.findall(span)
    digits = "".join(groups)
    shape = _SPLIT.sub("d", span)
    out = [
        f"{kind}",
        f"{kind}:left={_side(left)}",
        f"{kind}:right={_side(right)}",
        f"{kind}:digits={min(len(digits), 20)}",
    ]
    if kind == "email":
        whole = bool(_EMAIL.fullmatch(span))
        out += [f"email:whole={whole}", f"email:whole={whole},left={_side(left)}", f"email:whole={whole},right={_side(right)}"]
        return out
    out += [f"{kind}:shape={shape[:24]}", f"{kind}:groups={len(groups)}"]
    out.append(f"{kind}:sizes={','.join(str(len(g)) for g in groups[:8])}")
    if kind == "card":
        checked = 16 <= len(digits) <= 19 and luhn(digits)
        out += [f"card:luhn={checked}", f"card:luhn={checked},{len(groups)}"]
    elif kind == "ip":
        octets = shape == "d.d.d.d" and all(map(_octet, groups))
        out += [f"ip:octets={octets}", f"ip:octets={octets},left={_side(left)}", f"ip:octets={octets},right={_side(right)}"]
    else:
        out.append(f"phone:plus={span[0] == '+'},{8 <= len(digits) <= 15}")
    return out


def _outside(token: str, left: str) -> list[str]:
    kind = "digit" if token.isdigit() else "letter" if token.isalpha() else "space" if token.isspace() else token
    return [f"out:{kind}", f"out:{kind}:{min(len(token), 20)}" if kind == "digit" else f"out:{kind}<{_side(left)}"]


def _by_bracket(tokens: list[str], j: int) -> bool:
    """Whether a blank stands at a bracket or at-sign, the only place for one in an address."""
    return j > 0 and tokens[j - 1] in "[()]@" or j + 1 < len(tokens) and tokens[j + 1] in "[()]@"


def _candidates(tokens: list[str], first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the segments that can be entities at all and start in [first, last)."""
    for i in range(first, len(tokens) if last is None else last):
        head = tokens[i]
        if head[0].isascii() and (head.isdigit() or head in "+("):
            digits = 0
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                t = tokens[j]
                if t.isdigit() and t.isascii():
                    digits += len(t)
                    if digits > 19:
                        break
                    if digits >= 4:
                        if head.isdigit() and j == i + 6 and tokens[i + 1] == ".":
                            yield i, j + 1, "ip"
                        if digits >= 13 and head.isdigit():
                            yield i, j + 1, "card"
                        if 7 <= digits <= 15:
                            yield i, j + 1, "phone"
                elif t not in " ().-" and not (j == i and t == "+"):
                    break
        if (head[0].isascii() and (head[0].isalnum() or head[0] in "._%+-")) and (i == 0 or tokens[i - 1] not in "._%+-"):
            seen = False
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                t = tokens[j]
                if t == "@" or t == "at" and j and tokens[j - 1] in "[( ":
                    if seen:
                        break  # one at-sign each
                    seen = True
                elif not t.isascii() or not (t.isalnum() or t in "._%+-[]() "):
                    break
                elif t == " " and not _by_bracket(tokens, j):
                    break
                if seen and t.isalnum() and t not in ("at", "dot"):
                    yield i, j + 1, "email"


def _blocks(text: str, a: int, b: int, block: int) -> Iterator[tuple[list[str], list[int], int, int]]:
    """The tokens of text[a:b] in runs: (tokens, their places and the end, first, last); those from
    first to last are the run's own, one before and ``MAX_TOKENS`` + 1 after them are its surroundings."""
    found = _TOKEN.finditer(text, a, b)
    tokens: list[str] = []
    at: list[int] = []
    first, more = 0, True
    while more:
        while len(tokens) < first + block + MAX_TOKENS + 1 and (m := next(found, None)):
            tokens.append(m[0])
            at.append(m.start())
        more = len(tokens) == first + block + MAX_TOKENS + 1
        last = first + block if more else len(tokens)
        yield tokens, [*at, at[-1] + len(tokens[-1]) if at else a], first, last
        tokens, at = tokens[last - 1 :], at[last - 1 :]
        first = 1


def decode(text: str, a: int, b: int, weights: dict[str, float], block: int | None = None) -> list[Span]:
    """The best segmentation of text[a:b]: its entities, by start. Ties go to the earlier start."""
    k = len(_LABELS)
    move = [[weights.get(f"{x}>{y}", 0.0) for y in _LABELS] for x in _LABELS]
    fresh = lambda: ([-inf] * k, [None] * k)
    # (scores, paths) of segmentations that end at this token and at each of the next ones; a
    # path is (path before, entity), shared by all that continue it.
    ahead: deque = deque([([0.0, *[-inf] * (k - 1)], [None] * k), *(fresh() for _ in range(MAX_TOKENS))])

    def step(here, there, label: int, own: float, span: Span | None) -> None:
        scores, paths = here
        for was in range(k):
            s = scores[was] + move[was][label] + own
            if s > there[0][label]:
                there[0][label] = s
                there[1][label] = (paths[was], span) if span else paths[was]

    for tokens, at, first, last in _blocks(text, a, b, block or BLOCK):
        starts: dict[int, list[tuple[int, str]]] = {}
        for i, j, kind in _candidates(tokens, first, last):
            starts.setdefault(i, []).append((j, kind))
        for i in range(first, last):
            here = ahead.popleft()
            ahead.append(fresh())
            x = at[i]
            left = text[x - 1 : x]
            step(here, ahead[0], 0, sum(weights.get(f, 0.0) for f in _outside(tokens[i], left)), None)
            for j, kind in starts.get(i, ()):
                y = at[j]
                own = sum(weights.get(f, 0.0) for f in _features(kind, text[x:y], left, text[y : y + 1]))
                step(here, ahead[j - i - 1], _LABELS.index(kind), own, (kind, x, y))
    scores, paths = ahead[0]
    path = paths[max(range(k), key=lambda y: scores[y])]
    out: list[Span] = []
    while path:
        path, span = path
        out.append(span)
    return out[::-1]


class _Lattice:
    """Candidate segments of one training text, each with its features."""

    def __init__(self, text: str):
        self.tokens = _TOKEN.findall(text)
        self.at = [0]
        for t in self.tokens:
            self.at.append(self.at[-1] + len(t))
        self.ending: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(len(self.tokens) + 1)]
        near = lambda i: text[i - 1 : i] if i else ""
        for i, t in enumerate(self.tokens):
            self.ending[i + 1].append((i, 0, _outside(t, near(self.at[i]))))
        for i, j, kind in _candidates(self.tokens):
            a, b = self.at[i], self.at[j]
            right = text[b : b + 1]
            self.ending[j].append((i, _LABELS.index(kind), _features(kind, text[a:b], near(a), right)))

    def gradient(self, weights: dict[str, float], gold: list[Span]) -> dict[str, float]:
        """Of the conditional log-likelihood: features of the gold segments less expected ones."""
        n, k = len(self.tokens), len(_LABELS)
        move = [[exp(weights.get(f"{a}>{b}", 0.0)) for b in _LABELS] for a in _LABELS]
        arcs = [(end, s, y, f, exp(min(30.0, sum(weights.get(x, 0.0) for x in f)))) for end in range(1, n + 1) for s, y, f in self.ending[end]]
        forward = [[0.0] * k for _ in range(n + 1)]
        backward = [[0.0] * k for _ in range(n + 1)]
        scale = [1.0] * (n + 1)
        forward[0][0] = 1.0
        place = 0
        for end in range(1, n + 1):
            while place < len(arcs) and arcs[place][0] == end:
                _, s, y, _, e = arcs[place]
                shrink = 1.0
                for x in range(s + 1, end):
                    shrink /= scale[x]
                forward[end][y] += shrink * e * sum(forward[s][w] * move[w][y] for w in range(k))
                place += 1
            scale[end] = sum(forward[end]) or 1.0
            forward[end] = [v / scale[end] for v in forward[end]]
        backward[n] = [1.0] * k
        out: dict[str, float] = defaultdict(float)
        for end, s, y, f, e in reversed(arcs):
            shrink = 1.0
            for x in range(s + 1, end + 1):
                shrink /= scale[x]
            onward = backward[end][y] * e * shrink
            for w in range(k):
                p = forward[s][w] * move[w][y] * onward
                if p:
                    for x in (*f, f"{_LABELS[w]}>{_LABELS[y]}"):
                        out[x] -= p
                backward[s][w] += move[w][y] * onward
        wanted = {(a, b): kind for kind, a, b in gold}
        inside = {i for _, a, b in gold for i in range(a, b)}
        was = 0
        for end, s, y, f, _ in arcs:
            a, b = self.at[s], self.at[end]
            if (wanted.get((a, b)) == _LABELS[y]) if y else (a not in inside):
                for x in (*f, f"{_LABELS[was]}>{_LABELS[y]}"):
                    out[x] += 1.0
                was = y
        return out


def examples(count: int = 900, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Training sequences: entities of all kinds in usual and broken-up forms, close together and
    apart, among words and decoys (years, prices, versions, dates, keys, failing checksums)."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abdeghilnorstué") for _ in range(rnd.randrange(1, 9)))

    def name() -> str:
        return "".join(rnd.choice("abcdefghkmprst") for _ in range(rnd.randrange(3, 8)))

    def card() -> str:
        body = rnd.choice("3456") + d(14)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        gap, size = rnd.choice([("", 4), ("", 4), (" ", 4), ("-", 4), (" ", 2)])
        return gap.join(whole[i : i + size] for i in range(0, 16, size))

    def ip() -> str:
        return ".".join(str(rnd.randrange(1, 256)) for _ in range(4))

    def phone() -> str:
        return rnd.choice(
            [f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"+{d(2)}{d(9)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}",
             f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)} (0){d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"]
        )

    def email() -> str:
        at, dot = rnd.choice([("@", "."), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", " (dot) ")])
        return f"{name()}.{d(2)}{at}{name()}{rnd.choice(['', d(1)])}{dot}example{dot}{rnd.choice(['com', 'org', 'net'])}"

    def decoy() -> str:
        bad = d(15)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return rnd.choice(
            [str(rnd.randrange(1900, 2030)), f"{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"20{d(2)}-0{d(1)}-1{d(1)}", bad, d(20), d(rnd.randrange(1, 9)),
             f"{d(3)},{d(3)}", f"password={name()}{d(6)}{name()}", f"AKIA{name().upper()}{d(3)}", f'token = "{d(4)}{name()}{d(5)}"', f"{d(3)}.{rnd.randrange(256, 999)}.{d(2)}.{d(2)}", f"(at) {word()}", "(1)", f"x{d(3)}@{word()}"]
        )

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rnd.randrange(2, 6)):
            own = " ".join(word() for _ in range(rnd.choice([0, 0, 1, 2])))
            text += (rnd.choice([" ", " ", " ", ", "]) + own if text else own) + rnd.choice([" ", " ", ", ", ": "]) * bool(own)
            if rnd.random() < 0.4:
                text += decoy()
            else:
                kind = rnd.choice(KINDS)
                made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
        text += rnd.choice(["", ".", " " + word(), ", " + word()])
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def model(epochs: int = 8, rate: float = 0.4, shrink: float = 1e-4) -> dict[str, float]:
    """Weights by conditional likelihood, adaptive gradient steps; the same in every process."""
    lattices = [(_Lattice(text), gold) for text, gold in examples()]
    weights: dict[str, float] = {}
    squares: dict[str, float] = defaultdict(lambda: 1e-2)
    for _ in range(epochs):
        for lattice, gold in lattices:
            for f, g in lattice.gradient(weights, gold).items():
                g -= shrink * weights.get(f, 0.0)
                squares[f] += g * g
                weights[f] = weights.get(f, 0.0) + rate * g / sqrt(squares[f])
    return {f: w for f, w in weights.items() if abs(w) > 1e-6}


def _reach(text: str, at: int, a: int, b: int, forward: bool) -> int:
    """The place ``MAX_TOKENS`` + 1 whole tokens before ``at``, or after it; at most ``a``, ``b``."""
    wide = 16 * MAX_TOKENS
    while True:
        low, high = (at, min(b, at + wide)) if forward else (max(a, at - wide), at)
        found = [m.start() for m in _TOKEN.finditer(text, low, high)]
        # The token at the edge may be cut; the next wider look shows it whole.
        if forward and (high == b or len(found) > MAX_TOKENS + 2):
            return b if len(found) <= MAX_TOKENS + 2 else found[MAX_TOKENS + 2]
        if not forward and (low == a or len(found) > MAX_TOKENS + 2):
            return a if len(found) <= MAX_TOKENS + 2 else found[-MAX_TOKENS - 1]
        wide *= 4


def _stretches(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """What base spans leave, within ``MAX_TOKENS`` of digits and at-signs: all that can be in a segment."""
    free, at = [], 0
    for a, b in sorted((a, b) for _, a, b in base):
        if a > at:
            free.append((at, a))
        at = max(at, b)
    if at < len(text):
        free.append((at, len(text)))
    for a, b in free:
        near: list[list[int]] = []
        for m in _TRIGGER.finditer(text, a, b):
            # A token has a character at least: what is so near is within reach.
            if near and m.start() - near[-1][1] <= MAX_TOKENS:
                near[-1][1] = m.end()
            else:
                near.append([m.start(), m.end()])
        own: tuple[int, int] | None = None
        for low, high in near:
            low, high = _reach(text, low, a, b, False), _reach(text, high, a, b, True)
            if own and low <= own[1]:
                own = own[0], max(high, own[1])
            else:
                if own:
                    yield own
                own = low, high
        if own:
            yield own


def added_spans(text: str, base: list[Span], weights: dict[str, float]) -> list[Span]:
    """Entities of the model in what the base spans leave."""
    return [span for a, b in _stretches(text, base) for span in decode(text, a, b, weights)]


def find(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind as listed, then start."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added = added_spans(text, base, weights)
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, becomes its kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, base counts n_<kind>, base_sha256,
    spans (all), n_spans, n_added. A null text is an empty one; repeated rows and null ids each return;
    an empty table gives an empty one; further columns are ignored."""
    spark = docs.sparkSession
    arrow_limits(spark)
    held = spark.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py(), held.value) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            shas = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array(shas, pa.string()),
                    pa.array([_joined(every) for _, every in found], pa.string()),
                    pa.array([len(every) for _, every in found], pa.int64()),
                    pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long, n_added long"
    )


def redacted(text: Column, spark) -> Column:
    """The text with every span replaced; null stays null, and an empty or blank text as it is.

    Each row is for itself, so repeated rows and other columns do not matter, and an empty table
    has nothing to replace. A text is read whole whatever its length."""
    held = spark.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if t is None else redact(t, find(t, held.value)[1]) for t in texts], dtype=object)

    return run(text)
