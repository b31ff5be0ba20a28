"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field reads stretches around digits and @ signs, and around what a label makes a secret (``SECRET``), letters or not.
Tokens are runs of ASCII letters and digits, single marks, or runs of other characters; a segment of up to ``MAX_TOKENS``
tokens, or a whole run without white space however long, may carry one of the entity types, every other token is outside.  Features describe a whole candidate segment (shape, counts and changes of digits and letters, marks, checksum,
octets) and what stands on both sides of it.  The sum over all segmentations, the marginals and the best segmentation
all come from one dynamic programme over token positions with bounded segment length.  A stretch is segmented whole,
however long: the programme keeps a few numbers a token, and scores of segments are made again on the way back.

Training: at most ``TRAIN_REGIONS`` stretches of the corpus, those with the smallest hash, labelled by the base patterns
and by ``SECRET``, and ``INVENTED`` times as many into which ``invented`` writes entities in the forms that no pattern here finds
(unquoted and bearer keys, local telephone numbers, social security numbers) and things that only look like them
(dates, versions, prices, identifiers).  Stochastic gradient steps on the log-likelihood.  The weights (some ten
thousand numbers) go to the tasks; documents are read once more and never shuffled.

Base spans always stay; an added span must not overlap a base span, and the field must be sure of it.

Defined results: null and empty texts have no spans; offsets are code points; spans of one kind never overlap;
repeated rows and ids are read each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents

KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "secret", "ssn")
TRAIN_REGIONS = 600
MAX_TOKENS = 14
SURE = 0.8
MARGIN = 32
#: Texts with inventions for each text of the sample.
INVENTED = 6
#: Segments whose scores a task remembers.
CACHE = 100_000

# Fixed patterns of the base kinds, written so that no text costs more than time in proportion to its length: an
# e-mail's local part is read backwards from its @, and an address can only begin where a run of digits does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"""(?i)\b(?:token|secret|api[_-]?key|password|passwd)\s*[=:]\s*["']([0-9A-Za-z+/_-]{16,})["']""")

_DIGIT = re.compile("[0-9@]")
#: Words between a label and what it names.
_LINKS = frozenset(("is", "was", "are", "the", "a", "an", "of", "as", "to"))
_QUOTES = frozenset("\"'`=:,;()[]{}<>")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def regions(text: str):
    """(start, end) of the stretches around digits and @ signs, and around labelled secrets."""
    last = None
    marks = (m.start() for m in _DIGIT.finditer(text))
    if labelled := [p for m in SECRET.finditer(text) for p in (*range(m.start(1), m.end(1), MARGIN), m.end(1) - 1)]:
        marks = heapq.merge(marks, labelled)
    for p in marks:
        if last and p - last[1] <= 2 * MARGIN:
            last[1] = p
            continue
        if last:
            yield _widened(text, *last)
        last = [p, p]
    if last:
        yield _widened(text, *last)


def _widened(text: str, first: int, final: int) -> tuple[int, int]:
    start, end = max(0, first - MARGIN), min(len(text), final + 1 + MARGIN)
    while start > max(0, first - 2 * MARGIN) and text[start - 1].isalnum():
        start -= 1
    while end < min(len(text), final + 1 + 2 * MARGIN) and text[end].isalnum():
        end += 1
    return start, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _bucket(n: int) -> int:
    return next((k for k, top in enumerate((0, 1, 3, 6, 8, 12, 15, 16, 19, 31)) if n <= top), 10)


def segment_features(s: str, before: str, after: str, cue: str) -> list[str]:
    """Features of the whole segment s; before, after: the tokens around it; cue: the last word before it."""
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", s)))
    groups = ".".join(str(min(len(g), 9)) for g in re.findall(r"[0-9]+", s)) if not letters else ""
    marks = "".join(sorted({c for c in s if not c.isalnum()}))
    out = [
        "bias",
        f"d{_bucket(len(digits))}",
        f"l{_bucket(letters)}",
        f"n{_bucket(len(s))}",
        f"dl{_bucket(len(digits))}.{_bucket(letters)}",
        f"m{marks}",
        f"s{shape}" if len(shape) < 24 else "slong",
        f"at{s.count('@')}.{min(4, s.count('.'))}",
        f"first{s[0] if not s[0].isalnum() else shape[0]}",
        f"last{s[-1] if not s[-1].isalnum() else shape[-1]}",
        f"b{before}",
        f"a{after}",
    ]
    if groups:
        out.append(f"g{groups}{marks}")
    if 13 <= len(digits) <= 19 and letters == 0:
        out.append(f"luhn{luhn(digits)}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append(f"octets{all(len(p) < 4 and int(p) <= 255 for p in parts)}")
    if len(s) >= 20:
        out.append(f"p{s[:3]}")
    if digits and letters and len(s) >= 12 and not set(marks) - set("_-+/=."):
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
        letter = {c for c in s if c.isalpha()}
        kind = "hex" if letter <= set("abcdef") or letter <= set("ABCDEF") else "up" if s.upper() == s else "low" if s.lower() == s else "mix"
        kind += "." * ("." in marks)
        size = _bucket(len(s))
        out += [f"key{kind}{size}", f"x{min(9, 10 * changes // len(s))}.{size}", f"key.{before}{after}", f"cue{cue}{size > 6}"]
    elif letters and not digits and len(s) >= 12:
        out += [f"word{_bucket(len(s))}.{marks}", f"key.{before}{after}", f"cue{cue}.word"]
    elif not letters:
        out.append(f"cue{cue}.{_bucket(len(digits))}")
    return out


class Stretch:
    """Tokens of a text and its candidate segments: a segment holds a digit or @, or is part of a labelled secret, and starts
    and ends at no space."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.flagged = [bool(_DIGIT.search(w)) for w in self.words]
        for m in SECRET.finditer(text):
            for k, (a, b) in enumerate(self.spans):
                self.flagged[k] |= m.start(1) <= a and b <= m.end(1)
        # the last token of each run without white space, for the run's first token (also past a quote or a sign)
        self.run_end: dict[int, int] = {}
        first = 0
        for k in range(len(self.spans)):
            if k + 1 == len(self.spans) or self.spans[k + 1][0] > self.spans[k][1] or self.words[k] in _QUOTES:
                last = k
                while last > first and not self.words[last][-1].isalnum():
                    last -= 1
                if last - first >= MAX_TOKENS:
                    self.run_end[first] = last
                first = k + 1

    def ends(self, i: int):
        """The ends of the segments that begin with token i."""
        word, spans, n = self.words, self.spans, len(self.words)
        if not (word[i].isascii() and (word[i].isalnum() or word[i] in "+(")):
            return
        seen = False
        for j in range(i, min(n, i + MAX_TOKENS)):
            seen = seen or self.flagged[j]
            if j > i and spans[j][0] - spans[j - 1][1] > 1:
                return
            if seen and word[j].isalnum():
                yield j + 1
        if i in self.run_end and any(self.flagged[i : self.run_end[i] + 1]):
            yield self.run_end[i] + 1

    def key(self, i: int, j: int) -> tuple[str, str, str, str]:
        """What the features of the segment of tokens i to j - 1 are made of."""
        word = self.words
        before, after = word[i - 1].lower()[-8:] if i else "", word[j].lower()[:8] if j < len(word) else ""
        cue = next((w.lower()[:10] for w in reversed(word[max(0, i - 4) : i]) if w.isalpha() and w.lower() not in _LINKS), "")
        spans = self.spans  # a word that touches the segment is told from one beside it
        left = "~" if i and spans[i - 1][1] == spans[i][0] else ""
        right = "~" if j < len(word) and spans[j - 1][1] == spans[j][0] else ""
        return self.text[spans[i][0] : spans[j - 1][1]], left + ("9" if before.isdigit() else before), right + ("9" if after.isdigit() else after), cue

    def decode(self, field: Field) -> list[tuple[int, int, int, float]]:
        """(first token, token after the last, type, chance) of each entity of the best segmentation."""
        n = len(self.words)
        ahead, top = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = top[0] = 0.0
        back: list = [None] * (n + 1)
        for i in range(n):
            ahead[i + 1] = _add(ahead[i + 1], ahead[i])
            if top[i] > top[i + 1]:
                top[i + 1], back[i + 1] = top[i], None
            for j in self.ends(i):
                every, best, kind = field(self.key(i, j))
                ahead[j] = _add(ahead[j], ahead[i] + every)
                if top[i] + best > top[j]:
                    top[j], back[j] = top[i] + best, (i, kind, best)
        chosen, j = [], n
        while j:
            if back[j]:
                chosen.append((back[j][0], j, *back[j][1:]))
                j = back[j][0]
            else:
                j -= 1
        if not chosen:
            return []
        behind = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1]
            for j in self.ends(i):
                behind[i] = _add(behind[i], field(self.key(i, j))[0] + behind[j])
        return [(i, j, t, math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n]))) for i, j, t, s in reversed(chosen)]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > a - 40 else a


def marginals(n: int, where: list, s: np.ndarray) -> np.ndarray:
    """Chance of each segment and type, from all segmentations of n tokens; where: (first, end), ascending."""
    ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = behind[n] = 0.0
    every, k = np.logaddexp.reduce(s, axis=1).tolist(), 0
    for i in range(n):
        ahead[i + 1] = _add(ahead[i + 1], ahead[i])
        while k < len(where) and where[k][0] == i:
            j = where[k][1]
            ahead[j] = _add(ahead[j], ahead[i] + every[k])
            k += 1
    k = len(where) - 1
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        while k >= 0 and where[k][0] == i:
            behind[i] = _add(behind[i], every[k] + behind[where[k][1]])
            k -= 1
    around = np.array([ahead[i] + behind[j] - ahead[n] for i, j in where])
    return np.exp(np.minimum(0.0, s + around[:, None]))


class Field:
    """Weights of the features by type; features that training did not meet weigh nothing."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights, self.held = names, weights, {}  # the last row of weights is zero

    def __call__(self, key: tuple) -> tuple[float, float, int]:
        """(log of the summed types, score of the best type, the best type) of a segment."""
        got = self.held.get(key)
        if got is None:
            if len(self.held) >= CACHE:
                self.held.clear()
            none = len(self.weights) - 1
            s = self.weights[[self.names.get(f, none) for f in segment_features(*key)]].sum(axis=0)
            got = self.held[key] = float(np.logaddexp.reduce(s)), float(s.max()), int(s.argmax())
        return got


def invented(rng: random.Random) -> tuple[str, str | None, str]:
    """(context before, kind or None, what stands there): an entity in a form the patterns do not find, or its double."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    key = rng.choice([
        lambda: some("0123456789abcdef", rng.choice((24, 32, 40, 64))),
        lambda: some(upper + lower + "0123456789" * 2, rng.randrange(20, 44)),
        lambda: some(lower + "0123456789" * 2, rng.randrange(20, 36)),
        lambda: "AKIA" + some(upper + "0123456789" * 2, 16),
        lambda: rng.choice(("ghp_", "sk-", "xoxb-", "pk_")) + some(upper + lower + "0123456789", rng.randrange(20, 37)),
        lambda: some(upper + lower + "0123456789" * 2 + "+/", rng.randrange(30, 44)) + rng.choice(("", "a", "7")),
        lambda: "eyJ" + ".".join(some(upper + lower + "0123456789_-", k) + some(upper + lower, 1) for k in (rng.randrange(12, 36), rng.randrange(20, 90), rng.randrange(20, 43))),
    ])
    words = lambda: rng.choice((some(upper + lower, rng.randrange(16, 40)), some(lower, rng.randrange(16, 32)), "-".join(some(lower, rng.randrange(4, 9)) for _ in range(4))))
    name = rng.choice(("token", "secret", "api_key", "apikey", "password", "passwd", "pwd", "pw", "key", "auth", "access_key", "credential", "Token", "PASSWORD", "API_KEY"))
    quote = rng.choice(("", "", '"', "'", "`"))
    form = rng.randrange(13)
    if form == 12:  # letters only: a label and quotes say that it is a secret
        mark = rng.choice("\"'")
        return rng.choice(("token", "secret", "api_key", "api-key", "password", "passwd")) + rng.choice((" = ", "=", ": ", ":")) + mark, "secret", words() + mark
    if form < 3:
        return name + rng.choice((" = ", "=", ": ", ":", " is ", " ")) + quote, "secret", key() + quote
    if form < 4:
        return rng.choice(("Authorization: Bearer ", "Bearer ", "bearer ", "Basic ", "x-api-key: ")), "secret", key()
    if form < 6:
        a, b, c = str(rng.randrange(2, 10)) + digits(2), digits(3), digits(4)
        a = rng.choice((a, "0" + a[1:]))
        return rng.choice(("", "", "tel ", "Tel. ", "call ", "phone: ", "ring ", "fax ")), "phone", rng.choice((f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"))
    if form < 7:
        return rng.choice(("", "", "SSN ", "ssn: ", "social security number ", "no. ")), "ssn", f"{digits(3)}-{digits(2)}-{digits(4)}"
    double = rng.choice([
        lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
        lambda: f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1900, 2100)}",
        lambda: f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}/{rng.randrange(1900, 2100)}",
        lambda: f"{rng.randrange(24):02d}:{digits(2)}:{digits(2)}",
        lambda: f"v{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(20)}",
        lambda: f"{rng.randrange(1, 999)},{digits(3)}.{digits(2)}",
        lambda: digits(rng.randrange(1, 20)),
        lambda: f"{some(upper, 3)}-{digits(rng.randrange(3, 7))}",
        lambda: some(lower, rng.randrange(4, 12)) + digits(rng.randrange(1, 4)),
        lambda: "#" + some("0123456789abcdef", 6),
        lambda: f"{digits(3)}-{digits(4)}",
        lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{digits(4)} {digits(4)} {digits(4)}",
    ])
    return rng.choice(("", "", "on ", "of ", "no. ", "version ", "id ", "page ", "key ", "in ")), None, double()


def with_invented(texts: list[str], seed: int) -> list[tuple[str, dict]]:
    """Each text with an invention written between two of its words: (text, its spans (start, end) -> kind)."""
    rng, out = random.Random(seed), []
    for text in texts:
        gaps = [m.end() for m in re.finditer(r"\s", text)] or [0]
        at = rng.choice(gaps)
        lead, kind, body = invented(rng)
        left, right = text[:at] + ("" if not at or text[at - 1].isspace() else " "), rng.choice((" ", ". ", ", ", "\n")) + text[at:]
        start = len(left) + len(lead)
        own = {(start, start + len(body.rstrip("\"'`"))): kind} if kind else {}
        out.append((left + lead + body + right, own))
    return out


def train(texts: list[str], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Field:
    """The field of stretches of text labelled by the patterns, and of INVENTED times as many with inventions."""
    names: dict[str, int] = {}
    rows = []
    for text, own in [*((t, {}) for t in texts), *with_invented(texts * INVENTED, seed)]:
        stretch = Stretch(text)
        where = [(i, j) for i in range(len(stretch.words)) for j in stretch.ends(i)]
        if not where:
            continue
        spans = {m.span(1): "secret" for m in SECRET.finditer(text)} | own | {(a, b): kind for kind, a, b in base_spans(text)}
        gold = np.zeros((len(where), len(TYPES)))
        for k, (i, j) in enumerate(where):
            if (kind := spans.get((stretch.spans[i][0], stretch.spans[j - 1][1]))) is not None:
                gold[k, TYPES.index(kind)] = 1
        features = [[names.setdefault(f, len(names)) for f in segment_features(*stretch.key(i, j))] for i, j in where]
        at, size = np.concatenate(features), np.array(list(map(len, features)))
        order = np.argsort(at, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        rows.append((len(stretch.words), where, at, np.cumsum(size) - size, np.repeat(np.arange(len(where)), size)[order], at[order][head], head, gold))
    weights = np.zeros((len(names) + 1, len(TYPES)))
    shuffled = random.Random(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        shuffled.shuffle(rows)
        for n, where, at, starts, segment, own, head, gold in rows:
            gradient = gold - marginals(n, where, np.add.reduceat(weights[at], starts, axis=0))
            weights[own] += step * (np.add.reduceat(gradient[segment], head, axis=0) - decay * weights[own])
    return Field(names, weights)


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    out = []
    for start, end in regions(text):
        stretch = Stretch(text[start:end])
        for i, j, t, chance in stretch.decode(field):
            a, b = start + stretch.spans[i][0], start + stretch.spans[j - 1][1]
            if chance >= SURE and not any(a < y and x < b for _, x, y in base):
                out.append((TYPES[t], a, b))
    return out


def _regions(most: int):
    """The stretches of a task with the least hashes, `most` different ones."""

    def run(batches):
        held: dict[int, str] = {}
        for b in batches:
            for text in b["text"]:
                for a, z in regions(text):
                    if z - a <= 300:
                        r = text[a:z]
                        held[int.from_bytes(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")] = r
                if len(held) > 4 * most:
                    held = dict(heapq.nsmallest(most, held.items()))
        held = dict(heapq.nsmallest(most, held.items()))
        if held:
            yield pd.DataFrame({"h": list(held), "region": list(held.values())}).astype({"h": "int64"})

    return run


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _detect(field):
    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                more = added_spans(text, base, field)
                spans = sorted(base + more, key=lambda s: (TYPES.index(s[0]), s[1]))
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), len(spans)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]
            yield pa.record_batch([b.column("id"), *columns], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return run


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_regions: int = TRAIN_REGIONS) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one row for each row of df."""
    texts = bounded_batches(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # each task brings its own train_regions at most, so the corpus is not shuffled for them
    found = texts.select("text").mapInPandas(_regions(train_regions), "h long, region string").distinct()
    sample = [r[0] for r in found.orderBy("h", "region").limit(train_regions).select("region").collect()]
    field = train(sample)
    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return texts.mapInArrow(_detect(field), schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    return find_personal_data(documents(spark, sf_dir))
