"""Personal data by fixed base patterns and a semi-Markov conditional random field (operator 7)."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_column

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind, in time linear in the text."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = list(re.finditer(r"[0-9]+", m[0])) if m[0].count(".") >= 3 else []
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0]) <= 255 for p in parts[k : k + 4]):
                out.append((1, m.start() + parts[k].start(), m.start() + parts[k + 3].end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- the model: segments of at most MOST tokens carry a kind or none; a segment's score is linear in features of the whole span

MOST = 16
#: Tokens of a stretch that one lattice takes; longer ones pass in overlapping lattices.
WINDOW = 160
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
#: What opens a stretch: digits, @, or an obfuscated at.
_OPEN = re.compile(r"[0-9]+|@|[\[({] ?at ?[\])}]")


def span_features(text: str, start: int, end: int) -> np.ndarray:
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    groups = re.findall(r"[0-9]+", s)
    left, right = text[start - 1 : start], text[end : end + 1]
    low = re.sub(r"\s*[\[({]\s*at\s*[\])}]\s*", "@", re.sub(r"\s*[\[({]\s*dot\s*[\])}]\s*", ".", s.lower()))
    dotted = low.replace("[.]", ".")
    n, plain = len(digits), not re.search(r"[^0-9 -]", s)
    return np.array([
        1.0,
        bool(re.fullmatch(r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+", low)),
        low.count("@") == 1,
        "@" in low,
        bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", dotted)) and all(int(g) <= 255 for g in groups),
        bool(re.fullmatch(r"[0-9.\[\]]+", s)),
        len(groups) == 4,
        13 <= n <= 19 and plain and luhn(digits),
        13 <= n <= 19 and plain,
        9 <= n <= 15,
        s[:1] == "+" or s[:2] == "00",
        s[:1] in "+(",
        bool(re.fullmatch(r"\+?[0-9][0-9 ().-]*[0-9]|\([0-9]+\)[0-9 ().-]*[0-9]", s)),
        bool(re.search(r"[(). -]", s)),
        len(groups) >= 3,
        len(groups) == 1,
        bool(re.search(r"[A-Za-z]", s)),
        bool(re.search(r"[^A-Za-z0-9@.+() \[\]_%-]", s)),
        left.isalnum(),
        right.isalnum(),
        left in ("+", "(", ".", "-", "@") and left != "",
        right in ("-", "@", ")") and right != "",
        right == "." and text[end + 1 : end + 2].isalnum(),
        s[:1].isspace() or s[-1:].isspace(),
    ], float)


def token_features(token: str) -> np.ndarray:
    return np.array([1.0, token[:1].isdigit(), "@" in token, token.isalpha(), token.isspace(), len(token) > 8], float)


class Lattice:
    """The segmentations of one region: tokens, and the spans that may be entities (others cannot, by hard limits)."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
        n = len(self.at) - 1
        self.n = n
        self.tokens = np.stack([token_features(text[a:b]) for a, b in zip(self.at[:-1], self.at[1:], strict=True)]) if n else np.zeros((0, 6))
        digit = np.concatenate(([0], np.cumsum([sum("0" <= c <= "9" for c in text[a:b]) for a, b in zip(self.at[:-1], self.at[1:], strict=True)])))
        ends: list[tuple[int, int]] = []
        opens = [text[a] in "+(" or text[a].isalnum() for a in self.at[:-1]]
        closes = [text[b - 1].isalnum() for b in self.at[1:]]
        for j in range(1, n + 1):
            if closes[j - 1]:
                for i in range(max(0, j - MOST), j):
                    if opens[i]:
                        s = text[self.at[i] : self.at[j]]
                        if 7 <= digit[j] - digit[i] <= 19 or ("." in s and ("@" in s or 4 <= digit[j] - digit[i] <= 12 or "at" in s.lower())):
                            ends.append((i, j))
        self.spans = ends
        self.x = np.stack([span_features(text, self.at[i], self.at[j]) for i, j in ends]) if ends else np.zeros((0, len(_NAMES)))


_NAMES = span_features("x", 0, 1)


class SemiMarkov:
    """Weights of whole spans by kind, of tokens outside, and of an entity right after another."""

    def __init__(self, spans: np.ndarray, tokens: np.ndarray):
        self.spans, self.tokens = spans, tokens

    def best(self, lat: Lattice) -> list[Span]:
        """The best joint choice of boundaries and kinds: (kind, start, end) in characters."""
        outside = lat.tokens @ self.tokens
        score = lat.x @ self.spans.T
        by_end: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(lat.spans):
            by_end.setdefault(j, []).append(k)
        value, back = np.zeros(lat.n + 1), [None] * (lat.n + 1)
        for j in range(1, lat.n + 1):
            value[j] = value[j - 1] + outside[j - 1]
            for k in by_end.get(j, ()):
                kind = int(score[k].argmax())
                got = value[lat.spans[k][0]] + score[k, kind]
                if got > value[j]:
                    value[j], back[j] = got, (k, kind)
        out, j = [], lat.n
        while j:
            if back[j] is None:
                j -= 1
            else:
                k, kind = back[j]
                i = lat.spans[k][0]
                out.append((kind, lat.at[i], lat.at[j]))
                j = i
        return out[::-1]

    def expected(self, lat: Lattice) -> tuple[float, np.ndarray, np.ndarray]:
        """Log partition sum, and the probability of each span with each kind and of each token outside."""
        outside, score = lat.tokens @ self.tokens, lat.x @ self.spans.T
        ahead, behind = np.full(lat.n + 1, -np.inf), np.full(lat.n + 1, -np.inf)
        ahead[0] = behind[lat.n] = 0
        total = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
        by_end, by_start = {}, {}
        for k, (i, j) in enumerate(lat.spans):
            by_end.setdefault(j, []).append(k)
            by_start.setdefault(i, []).append(k)
        for j in range(1, lat.n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1] + outside[j - 1], *(ahead[lat.spans[k][0]] + total[k] for k in by_end.get(j, ()))])
        for i in range(lat.n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1] + outside[i], *(behind[lat.spans[k][1]] + total[k] for k in by_start.get(i, ()))])
        z = ahead[lat.n]
        edge = np.array([ahead[i] + behind[j] for i, j in lat.spans])
        return z, np.exp(score + edge[:, None] - z) if len(score) else score, np.exp(ahead[:-1] + outside + behind[1:] - z)


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Labelled regions, drawn evenly from formats of the four kinds and from look-alikes that are none."""
    d = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, d.integers(0, 10, k)))
    word = lambda: "".join(map(chr, d.integers(97, 123, d.integers(2, 9))))

    def card(ok: bool) -> str:
        while True:
            s = num(int(d.choice([13, 15, 16, 16, 19])))
            if luhn(s) == ok:
                sep = str(d.choice(["", "", " ", "-"]))
                return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def entity(kind: int) -> str:
        if kind == 0:
            host = ".".join(word() for _ in range(d.integers(1, 3))) + str(d.choice([".com", ".org", ".example.net"]))
            return word() + str(d.choice(["", ".", "_"])) + num(2) + str(d.choice(["@", "@", "[at]", " (at) "])) + host
        if kind == 1:
            return str(d.choice([".", ".", ".", "[.]"])).join(str(x) for x in d.integers(0, 256, 4))
        if kind == 2:
            return card(True)
        form = str(d.choice(["+c (aaa) bbb-dddd", "+c aaa bbb dddd", "+c-aaa-bbb-dddd", "+caaabbbdddd", "00c aaa bbb dddd", "(aaa) bbb-dddd", "+c (aaa) bbb.dddd"]))
        return form.replace("aaa", num(3)).replace("bbb", num(3)).replace("dddd", num(4)).replace("c", str(d.integers(1, 99)))

    def other() -> str:
        return str(d.choice([
            f"{d.integers(1990, 2030)}-{d.integers(1, 13):02d}-{d.integers(1, 29):02d}", f"{d.integers(0, 24)}:{num(2)}:{num(2)}", f"{num(1)}.{num(1)}", f"v{num(1)}.{num(2)}.{num(1)}",
            card(False), "".join(f"{x:x}" for x in d.integers(0, 16, 40)), f"{num(2)},{num(3)}.{num(2)}", f"#{num(8)}", f"{num(3)}.{d.integers(256, 999)}.{num(2)}.{num(3)}", f"@{word()}", num(7), num(10), num(22),
            f"{num(3)}-{num(2)}", f"{word()}{num(6)}", f"{num(4)} {num(4)}", f"{word()}@{word()}", f"ISBN {num(3)}-{num(10)}", f"at {num(4)}.{num(4)}", f"{num(2)}.{num(2)}.{num(4)}",
        ]))

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(d.integers(1, 4))):
            text += str(d.choice(["", "", word() + " ", "(", '"'])) if not text else str(d.choice([" ", ", ", " " + word() + " ", "; "]))
            if d.random() < 0.55:
                kind = int(d.integers(0, 4))
                s = entity(kind)
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = other()
            text += s
        out.append((text + str(d.choice(["", "", ".", ",", ")", " " + word()])), spans))
    return out


@lru_cache(maxsize=4)
def train(n: int = 350, rounds: int = 40, seed: int = 11) -> SemiMarkov:
    """Conditional likelihood by gradient ascent with per-weight rates, on n labelled regions."""
    made = SemiMarkov(np.zeros((4, len(_NAMES))), np.zeros(6))
    data = []
    for text, spans in examples(n, seed):
        lat = Lattice(text)
        at = {a: i for i, a in enumerate(lat.at)}
        index = {s: k for k, s in enumerate(lat.spans)}
        want, out = np.zeros((len(lat.spans), 4)), np.ones(lat.n)
        for kind, a, b in spans:
            k = index.get((at.get(a), at.get(b)))
            if k is not None:
                want[k, kind] = 1
                out[at[a] : at[b]] = 0
        data.append((lat, want, out))
    g_spans, g_tokens = np.full(made.spans.shape, 1e-6), np.full(6, 1e-6)
    for _ in range(rounds):
        for k in range(0, len(data), 25):
            up_s, up_t = -1e-3 * made.spans, -1e-3 * made.tokens
            for lat, want, out in data[k : k + 25]:
                _, p, q = made.expected(lat)
                up_s = up_s + (want - p).T @ lat.x
                up_t = up_t + (out - q) @ lat.tokens
            g_spans += up_s**2
            g_tokens += up_t**2
            made.spans = made.spans + 0.5 * up_s / np.sqrt(g_spans)
            made.tokens = made.tokens + 0.5 * up_t / np.sqrt(g_tokens)
    return made


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold an entity: whole neighbouring words with digits, @ or an obfuscated at, joined by single blanks.

    An obfuscated at that stands alone between blanks takes the word on either side.
    """
    out: list[list[int]] = []
    for m in _OPEN.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        a, b = m.span()
        floor = out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if m[0][0] in "[({":
            if a == m.start() and a - 1 > floor and text[a - 1] == " ":
                a -= 1
                while a > floor and not text[a - 1].isspace():
                    a -= 1
            if b == m.end() and text[b : b + 1] == " ":
                b += 1
                while b < len(text) and not text[b].isspace():
                    b += 1
        if out and a - out[-1][1] <= 1:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def stretch_spans(part: str, model: SemiMarkov) -> list[Span]:
    """The best spans of a stretch of any length.

    No span has over MOST tokens, so one that starts MOST tokens before the end of a lattice lies in it whole;
    later ones are left to the next lattice, which starts where the last one kept ends.
    """
    at = [m.start() for m in _TOKEN.finditer(part)] + [len(part)]
    out: list[Span] = []
    first = 0
    while first < len(at) - 1:
        last = min(first + WINDOW, len(at) - 1)
        until = len(part) + 1 if last == len(at) - 1 else at[last - MOST]
        begin, done = at[first], 0
        for kind, i, j in model.best(Lattice(part[begin : at[last]])):
            if begin + i < until:
                out.append((kind, begin + i, begin + j))
                done = begin + j
        if until > len(part):
            break
        first = bisect.bisect_left(at, max(done, until))
    return out


def find_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the model adds): added ones never overlap a base span."""
    base = base_spans(text)
    if not base and not _OPEN.search(text):
        return base, []
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        return k == 0 or reach[k - 1] <= a

    added: list[Span] = []
    for a, b in regions(text):
        part = text[a:b]
        if sum(c.isdigit() for c in part) < 4 and "@" not in part and not re.search(r"[\[({] ?at ?[\])}]", part):
            continue
        k = bisect.bisect_right(starts, a)
        if k and reach[k - 1] >= b - 2:  # a base span fills the region, but for a mark behind it
            continue
        added += [(kind, a + i, a + j) for kind, i, j in stretch_spans(part, model) if free(a + i, a + j)]
    return base, added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """docs(doc_id, text) -> FOUND: one row for each row. Counts and base_sha256 are of the base spans, spans of all.

    Positions are code points, end exclusive. Null or empty text: no spans (digest of the empty string).
    Repeated rows keep one row each, null doc_ids stay null, an empty table gives no rows; other columns are
    not read. Time is linear in the text; the model looks at whole stretches of words with digits or the like.
    """

    def run(batches):
        for b in batches:
            rows = []
            for text in text_column(b, "text"):
                base, added = find_spans(text, model)
                n = [sum(s[0] == k for s in base) for k in range(4)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind, like [EMAIL]; overlapping spans become one, named by the first."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """docs with every span masked in text; a column n_chars, where there is one, counts the new text. Null text stays null."""

    def run(texts):
        import pandas as pd

        for part in texts:
            yield pd.Series([None if t is None else mask(t, [*x[0], *x[1]]) if (x := find_spans(t, model)) != ([], []) else t for t in part], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), train())
