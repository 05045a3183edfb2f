"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The patterns ``assign``, ``access`` and ``hex`` give base spans.  The random field tags tokens as beginning of a secret
(B), inside (I) or outside (O) from their shape, the shapes of their neighbours and features of the whole text, and is
decoded by Viterbi.  A token that may be secret is cut at ``+ / _ . -`` into parts, each of which has its tag, so that a
credential of several parts is a B and I's; moves within a token and between tokens have weights of their own.  The field is
trained here by maximum likelihood on windows whose tags come from the base spans and on made windows of credentials that
the patterns don't know, with ordinary numbers, addresses and words as negatives; file features are always of whole texts.

Only tokens of LEAST_FREE characters or more with a digit, or of LEAST_WORD or more, can be tagged B or I (``candidate``); any
other token is O for certain.  So Viterbi runs over the stretches of such tokens only, however long they are, with the moves
from the O before and to the O after: that gives the tags of the whole chain.  A token ends before the full stop of a
sentence.  Tokens are whole wherever they lie, and so are the spans.

Defined results: a null text is empty; an empty text has no spans and the hash of the empty string; rows that share a
doc_id are scanned row by row; an empty table gives an empty result; extra columns are left alone (the spans' columns get
other names where the input has theirs, see ``scan``).
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C

# The base patterns, in the order in which kinds are listed, with their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "crf"]
_CASED = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

_CHAR = r"[A-Za-z0-9+/_\-]"
TOKEN = re.compile(rf"{_CHAR}+(?:\.{_CHAR}+)*|[^\sA-Za-z0-9+/_\-]+")
_FREE = re.compile(rf"(?<![A-Za-z0-9+/_\-])(?=[^\s]{{10}}){_CHAR}+(?:\.{_CHAR}+)*")
PART = re.compile(r"[A-Za-z0-9]+|[+/_.\-]+")
_JOINTS = "+/_.-"
_DIGIT, _LETTER, _SMALL, _CAPITAL = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z]"), re.compile("[A-Z]")
_RUN = re.compile("[0-9]+|[a-z]+|[A-Z]+")
LEAST_FREE, LEAST_WORD = 10, 16
CONTEXT = 3
SEED, MADE = 7, 100
MAX_TRAIN_TEXTS, MAX_TRAIN_SPANS, MAX_TRAIN_PARTS = 1_000, 3, 100  # bounds on training: texts, spans of each, parts of a stretch


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    out = []
    if _CASED.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if HEX_RUN.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# ------------------------------------------------------------------------------------------------ features
_KEYWORDS = {"password", "passwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "private", "pwd"}
_SHAPES = [
    ("digits", re.compile("[0-9]+")),
    ("hex", re.compile("(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)")),
    ("word", re.compile("[A-Za-z]+")),
    ("upper", re.compile("[A-Z0-9]+")),
    ("mixed", re.compile("[A-Za-z0-9]+")),
    ("base", re.compile(r"(?=.*[0-9])[A-Za-z0-9+/_\-]+")),
    ("dotnum", re.compile(r"[0-9.\-/]+")),
    ("dotted", re.compile(r"[A-Za-z0-9+/_.\-]+")),
]


@lru_cache(4096)
def shape(token: str) -> str:
    """A token's class, with a bucket of its length."""
    n = len(token)
    size = "1" if n < 4 else "2" if n < 8 else "3" if n < 16 else "4" if n < 24 else "5" if n < 48 else "6"
    for name, pattern in _SHAPES:
        if pattern.fullmatch(token):
            return name + ("" if name == "word" and n < 16 else size)
    return "equals" if token[0] in "=:" else "quote" if token[0] in "\"'`" else "at" if token[0] == "@" else "mark"


def entropy_bucket(token: str) -> str:
    n = len(token)
    return f"h{int(-2 * sum(k / n * log2(k / n) for k in Counter(token).values()))}"


def kinds(token: str) -> str:
    """Which of digits, small and capital letters a token has."""
    return "".join(name for name, pattern in (("0", _DIGIT), ("a", _SMALL), ("A", _CAPITAL)) if pattern.search(token))


def turns(token: str) -> int:
    """How often digits, small and capital letters take turns, in eighths of the length."""
    return 8 * max(len(_RUN.findall(token)) - 1, 0) // len(token)


def _texture(token: str, name: str) -> list[str]:
    k, t = kinds(token), turns(token)
    digits = 5 * sum(map(token.count, "0123456789")) // len(token)
    return [f"{name}e={entropy_bucket(token)}", f"{name}d={digits}", f"{name}c={k}", f"{name}t={t}", f"{name}c={k}&t={t}"]


def observe(tokens: list[str], i: int, file: list[str]) -> list[list[str]]:
    """The features of each part of token i: the first one's are of the token as a whole, its neighbours and the file too."""
    t = tokens[i]
    whole, parts = shape(t), PART.findall(t)
    shapes = [shape(p) if p[0] not in _JOINTS else "joint" + p[0] for p in parts]
    out = []
    for k, (p, s) in enumerate(zip(parts, shapes)):
        row = ["part=" + s, "on=" + (shapes[k + 1] if k + 1 < len(parts) else "end")]
        row.append(f"from={shapes[k - 1]}&{s}" if k else "first")
        out.append(row + _texture(p, "p") if len(p) >= 12 and not s.startswith("word") else row)
    first = ["s=" + whole, f"parts={min(len(parts), 9)}"]
    if len(t) >= 12 and whole[:4] != "word":
        first += _texture(t, "")
    for k in (1, 2, 3):
        p = tokens[i - k] if i >= k else ""
        first.append(f"p{k}=" + (shape(p) if p else "none"))
        if p and len(p) < 64 and (p.lower() in _KEYWORDS or _CASED.search(p)):
            first += ["key near", "key near&" + whole]
    first.append("n1=" + (shape(tokens[i + 1]) if i + 1 < len(tokens) else "none"))
    out[0] += first + [f"f={f}&{whole}" for f in file]
    return out


def tally(text: str) -> np.ndarray:
    """What ``file_features`` looks at: characters, marks of code, digits, marks of markup, and whether a credential is named."""
    return np.array([len(text), sum(map(text.count, "={};")), sum(map(text.count, "0123456789")), sum(map(text.count, "<>")), _CASED.search(text) is not None])


def file_features(counts: np.ndarray) -> list[str]:
    """Features of the whole text, from its ``tally``: code or prose, many digits or few, markup, and named credentials."""
    n, marks, digits, angles, named = counts
    return ["code" if marks * 100 > n else "prose", "digits" if digits * 20 > n else "letters", "markup" if angles * 100 > n else "plain", "named" if named else "unnamed"]


OFF = -1e9  # the score of what can't be
O_ROW = (0.0, OFF, OFF)  # the scores of a token that isn't free


class Field:
    """A linear-chain conditional random field with three tags over parts of tokens.

    It has two tables of moves: within a token (1) and from one token to the next (0)."""

    def __init__(self) -> None:
        self.emit: dict[str, tuple[float, float, float]] = {}
        self.move = np.zeros((2, 3, 3)).tolist()

    def scores(self, feats: list[list[str]]) -> list[tuple[float, float, float]]:
        out, get = [], self.emit.get
        for fs in feats:
            o = b = i = 0.0
            for f in fs:
                w = get(f)
                if w:
                    o, b, i = o + w[0], b + w[1], i + w[2]
            out.append((o, b, i))
        return out

    def viterbi(self, scores: list[tuple[float, float, float]], inner: list[int], opens: bool = True, closes: bool = True) -> list[int]:
        """The best tags; inner says of each part whether it goes on with the token of the part before.  Unless the chain opens
        (closes) here, an O stands before (after) it."""
        o, b, i = scores[0]
        if not opens:
            o, b = o + self.move[0][0][0], b + self.move[0][0][1]
        best, back = (o, b, OFF), []
        for row, at in zip(scores[1:], inner[1:]):
            move, step, last = self.move[at], [], []
            for t in (0, 1, 2):
                x, y, z = best[0] + move[0][t] if t != 2 else 2 * OFF, best[1] + move[1][t], best[2] + move[2][t]  # I doesn't follow O
                k = 0 if x >= y and x >= z else 1 if y >= z else 2
                last.append(k)
                step.append((x, y, z)[k] + row[t])
            best = tuple(step)
            back.append(last)
        end = best if closes else [v + self.move[0][t][0] for t, v in enumerate(best)]
        tags = [max((0, 1, 2), key=lambda t: end[t])]
        for last in reversed(back):
            tags.append(last[tags[-1]])
        return tags[::-1]

    def fit(self, chains: list[tuple[list[list[str]], list[bool], list[int], list[int]]], rounds: int = 80, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """Gradient ascent (with Adagrad steps) on the mean log likelihood, by forward and backward sums over all chains at
        once; a chain: features, whether a part is free (it is O otherwise), inner as in ``viterbi``, tags."""
        index: dict[str, int] = {}
        n, longest = len(chains), max(len(c[3]) for c in chains)
        ids, cell = [], []
        off, inner, gold, real = np.zeros((n, longest, 3)), np.zeros((n, longest), int), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for c, (feats, free, ins, tags) in enumerate(chains):
            m = len(tags)
            inner[c, :m], gold[c, :m], real[c, :m] = ins, tags, True
            off[c, :m, 1:] = np.where(free, 0, OFF)[:, None]
            for k, fs in enumerate(feats):
                if free[k]:
                    ids += [index.setdefault(f, len(index)) for f in fs]
                    cell += [c * longest + k] * len(fs)
        ids, cell = np.array(ids), np.array(cell)
        lengths = real.sum(1)
        emit, move = np.zeros((len(index), 3)), np.zeros((2, 3, 3))
        bar = np.zeros((3, 3))
        bar[0, 2] = OFF
        ge, gm = np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)
        eye, step_real = np.eye(3), real[:, 1:]

        def total(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis, keepdims=True)
            return np.log(np.exp(v - top).sum(axis)) + top.squeeze(axis)

        for _ in range(rounds):
            x = np.stack([np.bincount(cell, emit[ids, t], n * longest) for t in range(3)], 1).reshape(n, longest, 3) + off
            x[:, 0, 2] = OFF
            moves = (move + bar)[inner]  # the moves into each part
            a, b = x.copy(), np.zeros_like(x)
            for k in range(1, longest):
                a[:, k] = total(a[:, k - 1, :, None] + moves[:, k], 1) + x[:, k]
            for k in range(longest - 2, -1, -1):
                b[:, k] = np.where(step_real[:, k, None], total(moves[:, k + 1] + (x[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0)
            z = total(a[np.arange(n), lengths - 1], 1)
            p = np.exp(a + b - z[:, None, None])
            miss = (((eye[gold] - p) * real[:, :, None]) / n).reshape(-1, 3)
            de = np.stack([np.bincount(ids, miss[cell, t], len(index)) for t in range(3)], 1) - ridge * emit
            q = np.exp(a[:, :-1, :, None] + moves[:, 1:] + (x[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
            q = (eye[gold[:, :-1]][:, :, :, None] * eye[gold[:, 1:]][:, :, None, :] - np.where(step_real[:, :, None, None], q, 0)) * step_real[:, :, None, None] / n
            dm = np.stack([q[inner[:, 1:] == t].sum(0) for t in (0, 1)]) - ridge * move
            ge, gm = ge + de**2, gm + dm**2
            emit += rate * de / np.sqrt(ge)
            move += rate * dm / np.sqrt(gm)
        self.emit = {f: tuple(emit[k].tolist()) for f, k in index.items()}
        self.move = move.tolist()


# ------------------------------------------------------------------------------------------------ training
def _made(rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Made windows: credentials in settings, headers and prose, alone or some in a row; then numbers, addresses and long
    words, not secret."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    word = lambda: some(letters, rng.randint(2, 9))
    leads = ["Authorization: Bearer ", "auth = ", 'private_key: "', "credential=", "pwd: ", "export KEY=", "key: '", 'token = "', "secret: ", "my key is ", "the password is "]
    every = letters + letters.upper() + digits
    for _ in range(MADE):
        pool = rng.choice([digits + "abcdef", digits + "ABCDEF", letters + digits, every, letters.upper() + digits, every + "+/", letters + digits + "_-"])
        secret = rng.choice(["", "", "", "ghp_", "sk-", "xoxb-", "glpat-"]) + some(pool, rng.randint(20, 48))
        if not re.search("[0-9]", secret) or not re.search("[A-Za-z]", secret):
            secret += "4f"
        short = rng.choice([some(every, rng.randint(11, 16)) + "7", some(letters + letters.upper(), rng.randint(20, 32)), some(digits, rng.randint(12, 20))])
        dotted = ".".join("eyJ" * (k == 0) + some(every, rng.randint(12, 40)) for k in range(3))
        grouped = rng.choice(["-", "_"]).join(some(letters.upper() + digits, 5) for _ in range(5))
        lead = rng.choice(leads)
        before, after = " ".join(word() for _ in range(4)) + " ", rng.choice(["", '"', "'", "."]) + " " + " ".join(word() for _ in range(4))
        for one in (secret, rng.choice([short, dotted, grouped])):
            yield before + lead + one + after, [(len(before + lead), len(before + lead + one))]
        one = rng.choice([dotted, secret])
        yield before + one + after, [(len(before), len(before + one))]
        row, spans, text = [secret, dotted, some(every, rng.choice([40, 64, 160, 300])), some(every, 64)], [], before + lead
        for one in rng.sample(row, rng.randint(2, 4)):
            spans.append((len(text), len(text) + len(one)))
            text += one + rng.choice([" ", "\n", " , "])
        yield text + after.lstrip("\"'."), spans
        for plain in rng.sample([
            some(digits, rng.randint(10, 20)), f"{word()}.{some(digits, 2)}@mail{some(digits, 1)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), some(letters, rng.randint(16, 30)),
            f"https://{word()}.example.net/{word()}/{some(digits, 5)}", f"{word()}-{some(digits, 3)}-{word()}-{word()}", f"+{some(digits, 12)}", f"{word()}_{word()}_{word()}_{some(digits, 2)}",
            f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}{some('012345', 2)}Z", f"/{word()}/{word()}/{word()}{some(digits, 2)}/{word()}",
            f"{word()}.{word()}.{word()}{some(digits, 1)}.{word()}", f"{word()}-{some(digits, 4)}.final.pdf", f"{word().title()}{word().title()}{word().title()}{some(digits, 1)}", some(letters, rng.randint(8, 14)) + some(digits, 2),
            f"{word()}{word()}-{word()}{word()}", some(digits, 4) + " " + some(digits, 4) + " " + some(digits, 4) + " " + some(digits, 4),
        ], 4):
            yield before + plain + " " + after, []


def _hosts(rng: random.Random) -> Iterator[str]:
    """Made files for the made windows to lie in: prose, settings, tables of numbers, markup."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for line in (lambda: " ".join(word() for _ in range(12)) + ".", lambda: f"{word()} = {word()};", lambda: f"{word()} {rng.randint(0, 99999)} {rng.randint(0, 99999)}", lambda: f"<p>{word()} {word()}</p>"):
        for name in ("", "password = none"):
            yield "\n".join([name, *(line() for _ in range(30))])


def train(texts: list[str]) -> Field:
    """A field from the base spans of texts and from made windows, which lie in these texts or in made files."""
    rng = random.Random(SEED)
    chains, tallies = [], [tally(t) for t in texts]

    def add(text: str, spans: list[tuple[int, int]], file: list[str]) -> None:
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        tokens = [text[s:e] for s, e in found]
        feats, free, inner, tags = [], [], [], []
        for i, (a, z) in enumerate(found):
            may = candidate(tokens[i])
            rows = observe(tokens, i, file) if may else [[]]
            within = may and any(s <= a and z <= e for s, e in spans)
            feats += rows
            free += [may] * len(rows)
            inner += [0] + [1] * (len(rows) - 1)
            tags += [1] * within + [2] * (len(rows) - 1) if within else [0] * len(rows)
        # tokens that aren't free are O for certain: a chain is a stretch between two of them
        bars = [-1, *(k for k, f in enumerate(free) if not f), len(free)]
        for x, y in zip(bars, bars[1:]):
            if 1 < y - x <= MAX_TRAIN_PARTS:
                lo, hi = max(x, 0), y + 1
                chains.append((feats[lo:hi], free[lo:hi], inner[lo:hi], tags[lo:hi]))

    hosts = tallies + [tally(t) for t in _hosts(rng)] * (1 + len(tallies) // 8)
    for text, spans in _made(rng):
        add(text, spans, file_features(rng.choice(hosts) + tally(text)))
    for text, counts in zip(texts, tallies):
        near = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["hex"]]
        for s, e in near[:MAX_TRAIN_SPANS]:
            lo, hi = max(0, s - 120), e + 120
            lo, hi = (text.rfind(" ", 0, lo) + 1 if lo else 0), (text.find(" ", hi) if " " in text[hi : hi + 999] else hi)
            inside = [(m.start(2) - lo, m.end(2) - lo) for m in ASSIGN.finditer(text[lo:hi]) if len(m[2]) >= LEAST["hex"]]
            add(text[lo:hi], [(m[0] + lo, m[1] + lo) for m in inside] or [(s - lo, e - lo)], file_features(counts))
    field = Field()
    field.fit(chains)
    return field


def candidate(token: str) -> bool:
    """Whether a token's parts may be tagged B or I."""
    n = len(token)
    return n >= LEAST_FREE and (_DIGIT.search(token) is not None or n >= LEAST_WORD and _LETTER.search(token) is not None) and _FREE.fullmatch(token) is not None


def _before(text: str, at: int, n: int) -> list[tuple[int, int]]:
    """The last n whole tokens before place at, where a token starts."""
    size = 64
    while True:
        lo = max(0, at - size)
        found = [(m.start() + lo, m.end() + lo) for m in TOKEN.finditer(text[lo:at])]
        if lo == 0 or len(found) > n:  # the first one may be cut
            return found[-n:]
        size *= 4


def _tagged(found: list[tuple[int, int]], tokens: list[str], inner: list[int], tags: list[int]) -> list[list[int]]:
    """The spans of tagged parts; found: where each token lies, in the order of the parts."""
    out, i, at = [], -1, 0
    parts: list[str] = []
    for go_on, tag in zip(inner, tags):
        if not go_on:
            i, at = i + 1, found[i + 1][0]
            parts = PART.findall(tokens[i])[::-1] if candidate(tokens[i]) else [tokens[i]]
        start, at = at, at + len(parts.pop())
        if tag == 1:
            out.append([start, at])
        elif tag == 2 and out:
            out[-1][1] = at
    return out


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans that the field tags as secrets."""
    out, done, file = [], -1, None
    for c in _FREE.finditer(text):
        if c.start() < done or not candidate(c[0]):
            continue
        # the stretch: candidates that follow each other, between the tokens that their features look at
        file = file or file_features(tally(text))
        found = _before(text, c.start(), CONTEXT)
        i = len(found)
        for m in TOKEN.finditer(text, c.start()):
            found.append((m.start(), m.end()))
            if not candidate(m[0]):
                break
        j = len(found) if candidate(text[slice(*found[-1])]) else len(found) - 1
        tokens = [text[s:e] for s, e in found]
        feats, inner = [], []
        for k in range(i, j):
            rows = observe(tokens, k, file)
            feats += rows
            inner += [0] + [1] * (len(rows) - 1)
        tags = field.viterbi(field.scores(feats), inner, i == 0, j == len(found))
        if any(tags):
            out += _tagged(found[i:j], tokens[i:j], inner, tags)
        done = found[j - 1][1]
    return [(s, e) for s, e in out]


def whole_chain(text: str, field: Field) -> tuple[list[tuple[int, int]], list[int]]:
    """What ``field_spans`` gives, by Viterbi over all tokens of the text; and the tags."""
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    tokens, scores, inner = [text[s:e] for s, e in found], [], []
    if not tokens:
        return [], []
    file = file_features(tally(text))
    for k, t in enumerate(tokens):
        rows = field.scores(observe(tokens, k, file)) if candidate(t) else [O_ROW]
        scores += rows
        inner += [0] + [1] * (len(rows) - 1)
    tags = field.viterbi(scores, inner)
    return [(s, e) for s, e in _tagged(found, tokens, inner, tags)], tags


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the field's spans are added where no base span overlaps them."""
    base, extra, k, reach = base_spans(text), [], 0, 0
    for s, e in field_spans(text, field):  # both lists go by start
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s:
            extra.append((s, e, "crf"))
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2])))


# ------------------------------------------------------------------------------------------------ Spark
SPAN = "array<struct<start:int,end:int,kind:string>>"


def learn(spark: SparkSession, docs: DataFrame, text: str = "text") -> Field:
    """A field trained on a bounded sample of the texts that hold a pattern."""
    some = docs.where(F.col(text).rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{24}"))
    rows = some.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).distinct().orderBy("h", "t").limit(MAX_TRAIN_TEXTS).collect()
    return train([r.t for r in rows])


def span_names(docs: DataFrame) -> list[str]:
    """The names of the spans' columns: base_found and all_found, with underscores where docs has such columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in ("base_found", "all_found"):
        while name in taken:
            name += "_"
        out.append(name)
    return out


def scan(docs: DataFrame, field: Field, redact: bool = False, text: str = "text") -> DataFrame:
    """All columns of docs, and the lists of base spans and of all spans, named by ``span_names``; with redact the spans of
    the text are replaced by [SECRET]."""
    kept, (base_name, all_name) = docs.columns, span_names(docs)
    at = kept.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in C.small_batches(batches, text):
            base, every, texts = [], [], []
            for t in b.column(at).to_pylist():
                x, y = all_spans(t or "", field)
                base.append([dict(zip(("start", "end", "kind"), s)) for s in x])
                every.append([dict(zip(("start", "end", "kind"), s)) for s in y])
                if redact:
                    texts.append(t if not y else redacted(t, y))
            cols = list(b.columns)
            if redact:
                cols[at] = pa.array(texts, b.schema.types[at])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(base, kind), pa.array(every, kind)], [*kept, base_name, all_name])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_arrow(docs.select(*kept), run, f"{out}, {base_name} {SPAN}, {all_name} {SPAN}")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each stretch of spans replaced."""
    out, at = [], 0
    for s, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]])


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op6_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, learn(spark, docs)).select("doc_id", "base_found", "all_found")
    count = lambda kind: F.size(F.filter("base_found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base_found"), 256).alias("base_sha256"), joined("all_found").alias("spans"))
