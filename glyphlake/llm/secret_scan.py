"""Secret scans: fixed patterns, and values in a credential's place that would take many guesses."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import text_of, tokenizer_path

#: Kinds in the order in which spans with one start are listed; the first three are always kept.
KINDS = ("assign", "access", "hex", "guess")
# Base patterns (fixed values); the least lengths stand in them where no shorter match could hide a longer one.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Words of which one stands before every base assignment, and before every value that the method looks at.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CUE_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login", "://")
# Credential contexts of the method: a value assigned to a telling name, the word after a scheme's name, the password of an address.
VALUE = r"""[^\s"'`<>{}()\[\],;$%]{6,}"""
CONTEXTS = (
    re.compile(
        rf"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth|signing|encryption)[_\- ]?key|auth(?:orization)?|credentials?|login)["'`]?\x20{{0,8}}(?::=|=>|:|=|\x20is\x20)\x20{{0,8}}["'`]?({VALUE})""",
        re.I | re.A,
    ),
    re.compile(rf"\b(?:bearer|basic)\x20{{1,8}}({VALUE})", re.I | re.A),
    re.compile(r"://[^\s/:@]{1,64}:([^\s/@:]{6,})@"),
)
#: Guesses, as a power of ten, from which on a value is a secret.
STRONG = 10.0
#: What each further segment costs: one of five kinds.
SEGMENT = math.log10(5)
#: Words of placeholders, which a guesser tries first (fixed values).
PLACEHOLDERS = (
    "password passwd secret token key apikey api access auth user username admin root login your my the insert enter here example sample test demo dummy "
    "change changeme placeholder replace todo none null undefined true false foo bar value string redacted hidden default"
).split()
LEET = str.maketrans("4@301$57", "aaeoisst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./")
LEAST_WORD, MOST_WORD, LEAST_WALK, MOST_WALK, MOST_PERIOD = 3, 16, 3, 16, 8
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)")
YEAR = re.compile(r"(?:19|20)\d\d")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds: leftmost, not overlapping within a kind, failing ones dropped."""
    found = [(2, *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    return found


def values(text: str) -> set[tuple[int, int]]:
    """Places of values in a credential's context."""
    low = text.lower()
    if not any(w in low for w in CUE_WORDS):
        return set()
    return {m.span(1) for pattern in CONTEXTS for m in pattern.finditer(text)}


# ---- guess costs, as powers of ten


@functools.cache
def ranks(path: str) -> dict[str, float]:
    """Words of a public vocabulary with the logarithm of their rank; placeholders come first."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>") and LEAST_WORD <= len(w) - 4 <= MOST_WORD and w[:-4].isalpha()]
    out = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}
    return out | dict.fromkeys(PLACEHOLDERS, 0.0)


@functools.cache
def near_keys() -> frozenset[str]:
    """Pairs of characters that lie side by side on the keyboard, or follow each other in the alphabet or in numbers."""
    at = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    # Each row stands half a key to the right of the one above, so a key touches two of the next row.
    out = {a + b for a, (y, x) in at.items() for b, (v, u) in at.items() if (y == v and abs(x - u) == 1) or (v == y + 1 and u in (x - 1, x)) or (v == y - 1 and u in (x, x + 1))}
    for row in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        out |= {a + b for a, b in zip(row, row[1:], strict=False)} | {b + a for a, b in zip(row, row[1:], strict=False)}
    return frozenset(out)


def char_cost(c: str) -> float:
    return math.log10(10 if "0" <= c <= "9" else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def word_cost(piece: str, known: dict[str, float]) -> float | None:
    """A word's rank, more for capitals and for digits and signs in the place of letters; None if it is no word."""
    low = piece.lower()
    more = 0.0
    cost = known.get(low)
    if cost is None:
        plain = low.translate(LEET)
        if plain == low or (cost := known.get(plain)) is None:
            return None
        more = sum(a != b for a, b in zip(low, plain, strict=True)) * math.log10(2)
    upper = sum(c.isupper() for c in piece)
    if upper:
        letters = sum(c.isalpha() for c in piece)
        more += math.log10(2) if upper == letters or upper == 1 and piece[0].isupper() else math.log10(max(2, math.comb(letters, upper)))
    return cost + more


def date_cost(piece: str) -> float:
    years = YEAR.findall(piece)
    spread = max(20, abs(int(years[0]) - 2020)) if years else 100
    return math.log10(spread * (365 if len(piece) > 4 or not years else 1) * (4 if not piece.isdigit() else 1))


def walk_cost(piece: str) -> float:
    """The first key, a factor for each change of direction, and the length."""
    low = piece.lower().translate(SHIFTED)
    at = {c: (y, 2 * x + y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    steps = [(at[b][0] - at[a][0], at[b][1] - at[a][1]) if abs(at[b][1] - at[a][1]) <= 2 and abs(at[b][0] - at[a][0]) <= 1 else ord(b) - ord(a) for a, b in zip(low, low[1:], strict=False)]
    turns = sum(a != b for a, b in zip(steps, steps[1:], strict=False))
    return math.log10(47) + turns * math.log10(6) + math.log10(len(piece))


def segments(value: str, known: dict[str, float]) -> Iterable[tuple[int, int, float]]:
    """(start, end, cost) of words, dates, walks and repeats in ``value``; ends rise."""
    n, near = len(value), near_keys()
    low = value.lower().translate(SHIFTED)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    walk = 0
    runs = [0] * (MOST_PERIOD + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - MOST_WORD), end - LEAST_WORD + 1):
            cost = word_cost(value[start:end], known)
            if cost is not None:
                yield start, end, cost
        for start in dates.get(end, ()):
            yield start, end, date_cost(value[start:end])
        walk = walk + 1 if end > 1 and low[end - 2 : end] in near else 1
        for size in range(LEAST_WALK, min(walk, MOST_WALK) + 1):
            yield end - size, end, walk_cost(value[end - size : end])
        for period in range(1, MOST_PERIOD + 1):
            runs[period] = runs[period] + 1 if end > period and value[end - 1] == value[end - 1 - period] else 0
            times = runs[period] // period + 1
            if times >= 2 and times * period >= 3:
                unit = value[end - period : end]
                whole = word_cost(unit, known) if period >= LEAST_WORD else None
                yield end - times * period, end, (sum(map(char_cost, unit)) if whole is None else whole) + math.log10(times)


def guess_cost(value: str, known: dict[str, float]) -> float:
    """The least guesses for ``value``, as a power of ten, over all ways to cut it into segments and brute-force spans.

    ``best[i]`` is the least cost of the first i characters; ``span[i]`` that with a brute-force span at the end, which may go on
    without another segment's cost.
    """
    if not value:
        return 0.0
    best, span = [0.0], [math.inf]
    found, ahead = iter(segments(value, known)), None
    ahead = next(found, None)
    for end in range(1, len(value) + 1):
        span.append(min(span[-1], best[-1] + SEGMENT) + char_cost(value[end - 1]))
        least = span[end]
        while ahead and ahead[1] == end:
            least = min(least, best[ahead[0]] + SEGMENT + ahead[2])
            ahead = next(found, None)
        best.append(least)
    return best[-1] - SEGMENT


def spans_of(text: str, known: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each by start, kind and end."""
    base = sorted(base_spans(text), key=lambda s: (s[1], s[0], s[2]))
    more = [(3, *at) for at in values(text) if guess_cost(text[at[0] : at[1]], known) >= STRONG]
    return base, sorted([*base, *more], key=lambda s: (s[1], s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def report(text: Column, vocabulary: str) -> Column:
    """A struct of FIELDS for each text."""

    @F.pandas_udf(f"struct<{','.join(f.replace(' ', ':') for f in FIELDS.split(', '))}>")
    def find(texts: pd.Series) -> pd.DataFrame:
        known, rows = ranks(vocabulary), []
        for t in texts:
            base, every = spans_of(t, known)
            rows.append((*[sum(k == x for k, _, _ in base) for x in range(3)], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return find(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Base spans always stay; ``guess`` spans are values in a credential's context that take at least 10 ** STRONG guesses. Null or
    empty text has no spans: counts 0, the hash of the empty string, spans ''. Texts of any length are read whole. Null ids, equal
    texts and repeated rows stay rows of their own; spans of one start and kind stand by their end; extra columns are left out. An
    empty table gives an empty result. ``vocabulary`` is the file of a public tokenizer whose whole words, in order, are guessed.
    """
    vocabulary = vocabulary or tokenizer_path("word_bpe_49k.json")
    return docs.select(F.col(id_col).alias("doc_id"), report(text_of(text_col), vocabulary).alias("r")).select("doc_id", "r.*")


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
