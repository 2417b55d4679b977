"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, stored, text_of, tokenizer_path

#: Kinds in the order in which spans with one start are listed; the first four are always kept.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "national_id", "person")
BASE = 4
# Base patterns (fixed values); a start inside a run of digits never matches where the run's own start does not.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates of the other kinds.
#: Any long run of token characters: keys and passwords, but digests, names of files and long words too, which the votes tell apart.
TOKEN_RUN = re.compile(r"[A-Za-z0-9_+/-]{16,}")
LETTERS = re.compile(r"[^\W\d_]+")
#: Plain words, and forms that digests and identifiers have.
WORD, DIGEST = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
ASSIGN = r"(?:passw(?:or)?d|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?"
ASSIGNED = re.compile(ASSIGN + r"([^\s\"']{6,})", re.I)
ASSIGNS = re.compile(ASSIGN + r"\Z", re.I)
#: Words and numbers joined by signs, as in names of pages and files.
JOINED = re.compile(r"(?:[A-Za-z]?[0-9]+|[A-Z]?[a-z]+|[A-Z]+)(?:[_+/-]+(?:[A-Za-z]?[0-9]+|[A-Z]?[a-z]+|[A-Z]+|\Z))+")
#: Characters behind a known prefix from which on the prefix speaks for a key.
KEY_REST = 12
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NAME = r"[A-ZÀ-Þ][a-zà-ÿ]+"
PERSON = re.compile(rf"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.? |\b[Nn]ame: ?)({NAME}(?: {NAME}){{0,2}})")
#: Two or three capitalised words in a row: a name if the first is a given name or the words before say so.
TITLED = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.? |\b[Nn]ame: ?)\Z")
CAPITALS = re.compile(rf"\b(?!(?:Mr|Mrs|Ms|Dr|Prof)\b){NAME}(?: {NAME}){{1,2}}\b")
#: Gazetteers: issuers' prefixes, known key prefixes, country codes of IBANs, given names.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "xox", "AIza", "glpat-", "eyJ")
IBAN_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
GIVEN_NAMES = frozenset(
    "adam agnes albert alex alexander alfred alice alicia amanda amelia amy ana andrea andreas andrew angela anita anna anne anthony antoine antonio arthur barbara beatrice benjamin bernard brian bruno camille carlos "
    "carmen caroline catherine charles charlotte chloe chris christian christine christopher claire clara claudia claudio daniel david deborah denis diana diego dominique donald dorothy edward elena elisabeth elizabeth "
    "emily emma eric erik eva felix fernando frances francesca francisco frank franz frederic gabriel george gerard giovanni giulia gregory guillaume hans hannah heinrich helen helena henri henry hugo ingrid irene "
    "isabel jack jacques jakob james jan jane javier jean jennifer jessica joan johann johanna john jonathan jorge jose joseph juan julia julien karen karl katharina kevin klaus laura lea leon linda lisa louis louise luca "
    "lucas lucia luis manuel marco margaret maria marie mark markus martin mary matthew michael miguel monica nicolas nina oliver olivia pablo patricia patrick paul paula pedro peter philip pierre rachel rafael rebecca "
    "richard robert rosa sandra sara sarah simon sofia sophie stefan stephen susan thomas victor werner william wolfgang".split()
)
CUES = {
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "credential", "auth"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social security", "national id", "tax id", "dni"),
    "person": ("name", "contact", "dear", "patient", "customer", "signed"),
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
PREFIXED = re.compile("(?<![A-Za-z0-9_+/-])(?:" + "|".join(map(re.escape, KEY_PREFIXES)) + ")[A-Za-z0-9_+/-]*")
AGAINST = ("version", "isbn", "commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "etag", "revision", "section", "page", "figure", "doi", "http", "chapter", "saint", "street")
#: Yes, no, nothing to say.
YES, NO, ABSTAIN = "1", "2", "0"
LABELERS = ("form", "gazetteer", "context", "shape", "counter", "lexicon", "assigned")
FEATURES = 12
THRESHOLD = 0.5
#: What is held of a labeler before any vote is seen, with the weight of so many spans: how often it is right when it speaks; and the
#: prior of a candidate. The weight is fixed, so the votes of a corpus outweigh it.
RIGHT, PRIOR, WEIGHT = 0.8, 0.4, 20.0
#: The most that a labeler's silence may say, as a log ratio.
SILENCE = 1.0
VOCABULARY = "byte_bpe_50k.json"


@functools.cache
def lexicon(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """(words, names) of a public vocabulary: its entries of letters at a word's start in small letters, and those that it has with a capital only."""
    with open(path, encoding="utf-8") as f:
        entries = [x[1:] for x in json.load(f)["model"]["vocab"] if x.startswith("\u0120") and x[1:].isalpha() and len(x) > 3]
    words = frozenset(x for x in entries if x.islower())
    return words, frozenset(x.lower() for x in entries if x.istitle() and x.lower() not in words)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds: leftmost, not overlapping within a kind, failing ones dropped."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def other_spans(text: str) -> set[tuple[int, int, int]]:
    """Candidates of the kinds that only the method finds."""
    found = set()
    found.update((4, *m.span()) for m in TOKEN_RUN.finditer(text))
    if any(p in text for p in KEY_PREFIXES):
        found.update((4, *m.span()) for m in PREFIXED.finditer(text))
    low = text.lower() if any(c in text for c in "=:") else ""
    if any(c in low for c in ("passw", "pwd", "token", "secret", "key")):
        found.update((4, *m.span(1)) for m in ASSIGNED.finditer(text))
    found.update((5, *m.span()) for m in IBAN.finditer(text)) if re.search(r"[A-Z]{2}[0-9]{2}", text) else None
    found.update((6, *m.span()) for m in NATIONAL.finditer(text)) if "-" in text else None
    if any(c in text for c in ("Mr", "Ms", "Dr", "Prof", "ame:")):
        found.update((7, *m.span(1)) for m in PERSON.finditer(text))
    found.update((7, *m.span()) for m in CAPITALS.finditer(text))
    return found


def _iban_sum(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def covered(value: str, words: frozenset[str]) -> float:
    """The share of a value's letters that lie in words of the vocabulary, taken from the left, the longest first."""
    letters = inside = 0
    for run in LETTERS.findall(value):
        letters += len(run)
        low, at = run.lower(), 0
        while at < len(low):
            end = next((e for e in range(min(len(low), at + 14), at + 3, -1) if low[at:e] in words), None)
            inside += (end or at) - at
            at = end or at + 1
    return inside / letters if letters else 0.0


def votes_of(kind: int, value: str, before: str, words: frozenset[str], names: frozenset[str]) -> str:
    """One vote of each labeler. They look at overlapping things and may well disagree; none is trusted as it stands."""
    name = KINDS[kind]
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    form = gazetteer = lexical = assigned = ABSTAIN
    shape = YES if len(set(value)) >= 8 else NO
    if name == "secret":
        prefix = next((p for p in KEY_PREFIXES if value.startswith(p)), "")
        rest = value[len(prefix) :]
        plain = bool(JOINED.fullmatch(rest)) or (len(rest) < KEY_REST if prefix else bool(WORD.fullmatch(value)))
        cases = any(c.islower() for c in value) + any(c.isupper() for c in value) + (digits > 0)
        assigned = YES if ASSIGNS.search(before) else ABSTAIN
        form = NO if plain or not letters or DIGEST.fullmatch(value) else YES if prefix or cases == 3 and len(value) >= 20 else ABSTAIN
        gazetteer = YES if prefix and not plain else ABSTAIN
        shape = NO if letters < 3 or len(set(value)) < 8 else YES if digits >= 3 else NO if not digits else ABSTAIN
        share = covered(value, words) if letters else 0.0
        lexical = NO if share >= 0.6 or bool(WORD.fullmatch(value)) or not letters else YES if share < 0.3 and letters >= 3 else ABSTAIN
        if assigned == YES:  # a password may look like anything
            form, shape = ABSTAIN if form == NO else form, ABSTAIN if shape == NO else shape
    elif name == "iban":
        form = YES if _iban_sum(value) else NO
        gazetteer = NO if value[:2] not in IBAN_COUNTRIES else YES if form == YES else ABSTAIN
        shape = YES if len(value.replace(" ", "")) >= 15 else NO
    elif name == "national_id":
        form = NO if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else YES
        shape = ABSTAIN
    elif name == "person":
        parts = [w.lower() for w in value.split()]
        gazetteer = YES if parts[0] in GIVEN_NAMES else NO
        lexical = NO if any(w in words for w in parts) or len(set(parts)) < len(parts) else YES if all(w in names for w in parts) else ABSTAIN
        form = YES if TITLED.search(before) else ABSTAIN
        # Capitals at the start of a sentence say little; in the midst of one they speak for a name.
        shape = ABSTAIN if " " in value and before.rstrip()[-1:].isalnum() else NO
    else:
        form = YES
        gazetteer = YES if name == "card" and value[0] in "3456" or name == "phone" or name == "email" and value.rpartition(".")[2].isalpha() else ABSTAIN
        shape = ABSTAIN
    low = before.lower()
    context = YES if any(c in low for c in CUES[name]) else ABSTAIN
    against = NO if any(c in low for c in AGAINST) else ABSTAIN
    return form + gazetteer + context + shape + against + lexical + assigned


def features_of(kind: int, value: str, before: str, words: frozenset[str], names: frozenset[str]) -> str:
    """Binned measures of a span for the final classifier: of its letters, and of what stands before it. No vote is among them."""
    n = len(value)
    low, letters = before.lower(), [c for c in value.lower() if c.isalpha()]
    share = lambda x: min(3, 4 * x // n)
    sort = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "-" for c in value]
    last = before.split()[-1] if before.split() else ""
    if KINDS[kind] == "person":
        own = [w.lower() for w in value.split()]
        known = 3 if all(w in names for w in own) else 2 if own[0] in names else 1 if not any(w in words for w in own) else 0
    elif KINDS[kind] == "iban":
        known = int(_iban_sum(value))
    else:
        known = min(3, int(4 * covered(value, words)))
    return "".join(
        map(
            str,
            (
                min(3, n // 12),
                share(sum(k == "d" for k in sort)),
                share(len(set(value))),
                share(sum(k == "u" for k in sort)),
                share(sum(k == "-" for k in sort) * 4),
                share(sum(x != y for x, y in zip(sort, sort[1:], strict=False)) * 2),
                min(3, 6 * sum(c in "aeiouyäöüéèêáíóú" for c in letters) // len(letters)) if letters else 0,
                known,
                # The word before: its end, if it is a sign, or whether it is a short one with a capital, as titles are.
                2 if last[-1:] == ":" else 1 if before[-1:] in "=\"'" else 3 if last[:1].isupper() and len(last) <= 5 else 0,
                int(any(c in low for c in CUES[KINDS[kind]])),
                int(any(c in low for c in AGAINST)),
                int(before.rstrip()[-1:].isalnum()),
            ),
        )
    )


def candidates(text: str | None, vocabulary: str | None = None) -> list[tuple[int, int, int, str, str]]:
    """(kind, start, end, votes, features) of all candidates, by start and kind."""
    text = text or ""
    words, names = lexicon(vocabulary or tokenizer_path(VOCABULARY))
    out = []
    for kind, start, end in sorted({*base_spans(text), *other_spans(text)}, key=lambda s: (s[1], s[0], s[2])):
        value, before = text[start:end], text[max(0, start - 32) : start]
        if kind < BASE:  # these stay whatever is said of them
            out.append((kind, start, end, ABSTAIN * len(LABELERS), "0" * FEATURES))
        else:
            out.append((kind, start, end, votes_of(kind, value, before, words, names), features_of(kind, value, before, words, names)))
    return out


SPAN = "array<struct<kind:int,start:int,end:int,votes:string,features:string>>"


def candidate_column(text: Column, vocabulary: str | None = None) -> Column:
    vocabulary = vocabulary or tokenizer_path(VOCABULARY)

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "votes", "features"), c, strict=True)) for c in candidates(t, vocabulary)] for t in texts])

    return find(text)


# ---- label model and classifier: both learn from counts of all candidates


def majority(votes: str) -> bool:
    """What a plain count of votes says."""
    return votes.count(YES) > votes.count(NO)


def label_model(counts: dict[tuple[int, str], int], rounds: int = 60) -> tuple[dict[tuple[int, str], float], dict[tuple[int, str], tuple[float, float]]]:
    """EM over vote patterns of each kind: (the chance that a pattern's spans are personal data, each labeler's reliability).

    A labeler has, for each class, a chance of yes, no and silence. Rounds alternate between these chances and the posteriors, which
    start from the share of yes among votes cast. What is held beforehand weighs as much as WEIGHT spans of each class: in a
    corpus the agreement of labelers decides, and one that others contradict loses its say. One that would speak against what it says
    is given none. A reliability is the chance that a yes is said rather of personal data, and a no rather of other spans, both classes
    being equally common (0.5: it says nothing).
    """
    out: dict[tuple[int, str], float] = {}
    trusted: dict[tuple[int, str], tuple[float, float]] = {}
    for kind in sorted({k for k, _ in counts}):
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        weight = np.array([n for _, n in rows], float)
        votes = np.array([[int(c) for c in v] for v, _ in rows])
        said = np.stack([votes == c for c in (0, 1, 2)], axis=2).astype(float)  # row, labeler, outcome
        yes, no = said[:, :, 1], said[:, :, 2]
        post = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1.0)
        silent = (weight[:, None] * said[:, :, 0]).sum(0) / weight.sum()
        held = [np.stack([silent, (1 - silent) * r, (1 - silent) * (1 - r)], axis=1) * WEIGHT + 0.02 for r in (RIGHT, 1 - RIGHT)]
        for _ in range(rounds):
            rates = []
            for prior, mass in zip(held, (post, 1 - post), strict=True):
                seen = prior + ((weight * mass)[:, None, None] * said).sum(0)
                rates.append(seen / seen.sum(1, keepdims=True))
            ratio = np.log(rates[0] / rates[1])
            ratio[:, 0] = np.clip(ratio[:, 0], -SILENCE, SILENCE)
            ratio[:, 1], ratio[:, 2] = np.maximum(ratio[:, 1], 0), np.minimum(ratio[:, 2], 0)
            share = (WEIGHT * PRIOR + (weight * post).sum()) / (WEIGHT + weight.sum())
            score = math.log(share / (1 - share)) + (said * ratio).sum((1, 2))
            post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out |= {(kind, v): float(p) for (v, _), p in zip(rows, post, strict=True)}
        right = 1 / (1 + np.exp(-np.abs(ratio[:, 1:])))
        trusted |= {(kind, name): (float(right[j, 0]), float(right[j, 1])) for j, name in enumerate(LABELERS)}
    return out, trusted


def reliabilities(counts: dict[tuple[int, str], int]) -> dict[tuple[int, str], float]:
    return label_model(counts)[0]


class Classifier(dict):
    """Chances by (kind, features), also of those that it was not fitted on."""

    def __init__(self, theta: np.ndarray | None = None) -> None:
        super().__init__()
        self.theta = theta

    def __missing__(self, key: tuple[int, str]) -> float:
        score = 0.0 if self.theta is None else float(self.theta[_one_hot(*key)].sum())
        self[key] = 0.0 if self.theta is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        return self[key]

    def __reduce__(self):
        return Classifier, (self.theta,)


def _one_hot(kind: int, features: str) -> list[int]:
    """Weights of a span: one of its kind, and one of each bin, which every kind has for itself."""
    first = kind * (1 + 4 * FEATURES)
    return [first, *(first + 1 + 4 * i + int(c) for i, c in enumerate(features))]


def fit(counts: dict[tuple[int, str, str], int], rounds: int = 400) -> Classifier:
    """Logistic regression of the label model's chances on the features of spans, for all kinds at once."""
    by_votes: dict[tuple[int, str], int] = defaultdict(int)
    for (kind, votes, _), n in counts.items():
        by_votes[kind, votes] += n
    soft = reliabilities(by_votes)
    rows: dict[tuple[int, str], list[float]] = {}
    for (kind, votes, features), n in counts.items():
        row = rows.setdefault((kind, features), [0.0, 0.0])
        row[0] += n
        row[1] += n * soft[kind, votes]
    if not rows:
        return Classifier()
    keys = sorted(rows)
    x = np.zeros((len(keys), len(KINDS) * (1 + 4 * FEATURES)))
    for i, key in enumerate(keys):
        x[i, _one_hot(*key)] = 1
    # Counts weigh by their root, so that a common form does not drown the rare ones.
    n = np.array([rows[k][0] for k in keys])
    w, y = np.sqrt(n), np.array([rows[k][1] for k in keys]) / n
    w = w / w.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ theta))
        slope = x.T @ (w * (p - y)) + 1e-4 * theta
        bend = (x * (w * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + 1e-3 * np.eye(len(theta))
        step = np.linalg.solve(bend, slope)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(theta)


def learn(found: DataFrame, column: str = "spans") -> Classifier:
    """Fit on the candidates in ``column`` of all rows. What reaches the driver are counts of votes and binned features, bounded by the bins."""
    spans = found.select(F.explode(column).alias("s")).where(F.col("s.kind") >= BASE).groupBy("s.kind", "s.votes", "s.features").agg(F.count(F.lit(1)).alias("n"))
    return fit({(r["kind"], r["votes"], r["features"]): r["n"] for r in spans.collect()})


def kept(spans, chance: Classifier) -> list[tuple[int, int, int]]:
    """Spans that stay: base kinds, and those that the classifier takes for personal data."""
    return [(k, s, e) for k, s, e, _, f in spans if k < BASE or chance[k, f] >= THRESHOLD]


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Candidates of the kinds beyond the base ones are any long token runs, number groups and rows of capitalised words; votes, EM
    and the classifier, which learn from the counts of all candidates, keep some and reject the others.

    Null or empty text has no spans: counts 0, the hash of the empty string, spans ''. Texts of any length are read whole. Null ids,
    equal texts and repeated rows stay rows of their own; extra columns are left out. An empty table gives an empty result.
    """
    found = stored(docs.select(F.col(id_col).alias("doc_id"), candidate_column(text_of(text_col)).alias("spans")), "candidates")
    chance = learn(found)
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    @F.pandas_udf(f"struct<{','.join(f.replace(' ', ':') for f in fields.split(', '))}>")
    def decide(spans: pd.Series) -> pd.DataFrame:
        rows = []
        for own in spans:
            own = [(c["kind"], c["start"], c["end"], c["votes"], c["features"]) for c in own]
            base = [c[:3] for c in own if c[0] < BASE]
            n = [sum(c[0] == k for c in base) for k in range(BASE)]
            rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(kept(own, chance))))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    return found.select("doc_id", decide("spans").alias("r")).select("doc_id", "r.*")


def redact_text(text: str, spans) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, done = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"<{KINDS[k]}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; other columns and null texts stay.

    Candidates are searched once and stored beside their rows. Empty texts stay empty, long ones are read whole, repeated rows
    stay, and an empty table gives an empty result.
    """
    spans = fresh("spans")
    found = stored(docs.withColumn(spans, candidate_column(text_of(text_col))), "candidates")
    chance = learn(found, spans)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, own: pd.Series) -> pd.Series:
        said = ([(c["kind"], c["start"], c["end"], c["votes"], c["features"]) for c in x] for x in own)
        return pd.Series([None if t is None else redact_text(t, kept(x, chance)) for t, x in zip(texts, said, strict=True)], dtype=object)

    return found.withColumn(text_col, clean(F.col(text_col), F.col(spans))).drop(spans)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
