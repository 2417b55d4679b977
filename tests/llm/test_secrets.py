"""Secret scan: base patterns written plainly, guess costs over all segmentations, planted values."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.llm import secret_scan
from glyphlake.llm.common import tokenizer_path

PLAIN = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def base_of(text):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, (pattern, good)) in enumerate(PLAIN.items()) for m in re.finditer(pattern, text or "") if good(m))
    return [sum(k == x for _, k, _, _ in found) for x in range(3)], [f"{kind}:{s}:{e}" for s, _, kind, e in found]


@pytest.fixture(scope="module")
def known():
    return secret_scan.ranks(tokenizer_path("word_bpe_49k.json"))


pieces = st.sampled_from(["password", "PASSWD", "Secret", "toKen", "api_key", "apikey", "paſſword", "toKen", "AKIA", "AKIAAKIA", "=", ":", " ", '"', "'", "a1b2c3d4e5f60718", "0123456789abcde", "ABCDEFGHIJ1234", "x" * 12, "é", "\n", "==", "-", "日"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    base = sorted(secret_scan.base_spans(text), key=lambda s: (s[1], s[0]))
    assert secret_scan.listed(base) == ",".join(base_of(text)[1])


def test_all_rows_and_edges(spark, sf_dir, edge, none, known):
    for table in (spark.read.parquet(f"{sf_dir}/documents.parquet"), edge):
        texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in table.select("doc_id", "text").collect()))
        want = []
        for _, doc, text in texts:
            counts, base = base_of(text)
            _, every = secret_scan.spans_of(text, known)
            assert set(base) <= set(secret_scan.listed(every).split(",")) | set()
            want.append((doc, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), secret_scan.listed(every)))
        got = [(r["doc_id"] or 0, *r[1:]) for r in secret_scan.scan(table).collect()]
        assert sorted(got) == sorted(want)
    assert secret_scan.scan(none).collect() == []


def test_query_matches_rows(spark, sf_dir):
    rows = secret_scan.op13_secret_scan(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def all_segments(value, known):
    """Costs of every piece that is a word, a date, a walk or a repeat, each found by itself."""
    n, near, low = len(value), secret_scan.near_keys(), value.lower().translate(secret_scan.SHIFTED)
    out = {}

    def put(s, e, cost):
        out[s, e] = min(cost, out.get((s, e), math.inf))

    for s in range(n):
        for e in range(s + 1, n + 1):
            piece = value[s:e]
            if 3 <= e - s <= 16:
                if (cost := secret_scan.word_cost(piece, known)) is not None:
                    put(s, e, cost)
                if all(low[i : i + 2] in near for i in range(s, e - 1)):
                    put(s, e, secret_scan.walk_cost(piece))
            m = secret_scan.DATE.match(value, s) if value[s].isdigit() else None
            if m and m.end() == e:
                put(s, e, secret_scan.date_cost(piece))
            for period in range(1, 9):
                times, rest = divmod(e - s, period)
                # Only the longest repeat of whole units that ends here.
                if rest == 0 and times >= 2 and e - s >= 3 and piece == piece[:period] * times and not (s >= period and value[s - period : s] == piece[:period]):
                    unit = piece[:period]
                    whole = secret_scan.word_cost(unit, known) if period >= 3 else None
                    put(s, e, (sum(map(secret_scan.char_cost, unit)) if whole is None else whole) + math.log10(times))
    return out


def cheapest(value, known):
    found = all_segments(value, known)

    @functools.cache
    def rest(i):
        if i == len(value):
            return 0.0
        ways = [secret_scan.SEGMENT + sum(map(secret_scan.char_cost, value[i:j])) + rest(j) for j in range(i + 1, len(value) + 1)]
        ways += [secret_scan.SEGMENT + found[i, j] + rest(j) for j in range(i + 1, len(value) + 1) if (i, j) in found]
        return min(ways)

    return max(0.0, rest(0) - secret_scan.SEGMENT)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["monkey", "dragon", "P@ss", "2019-03-04", "1987", "qwer", "zxc", "aaa", "abab", "xyz", "K9#", "é", "Q", "7", "_", "hunter", "01.02.99"]), max_size=5).map("".join))
def test_guess_cost_is_the_least_over_all_segmentations(value):
    known = secret_scan.ranks(tokenizer_path("word_bpe_49k.json"))
    assert secret_scan.guess_cost(value, known) == pytest.approx(cheapest(value, known))


@pytest.mark.parametrize("value", ["changeme", "password123", "your_api_key_here", "qwertyuiop", "aaaaaaaaaaaa", "monkey1987", "2019-03-04", "P@ssw0rd!", "letmein", "example-token"])
def test_weak_values_are_no_secrets(value, known):
    assert secret_scan.guess_cost(value, known) < secret_scan.STRONG


def test_strong_values_are_found_where_base_patterns_see_none(known):
    draw = random.Random(3)
    for _ in range(200):
        value = "".join(draw.choices(string.ascii_letters + string.digits + "#@!^&*", k=12))
        for text in (f"pwd: {value} and so on", f"login => '{value}'", f"the passphrase is {value}\n", f"Authorization: Bearer {value}", f'"client_secret" : "{value}"'):
            at = text.index(value)
            if value[:6].isalnum():
                assert f"guess:{at}:" in secret_scan.listed(secret_scan.spans_of(text, known)[1]), text
        url = f"postgres://joe:{value.replace('@', 'x')}@db/x"
        assert "guess:15:27" in secret_scan.listed(secret_scan.spans_of(url, known)[1])
    for text in ("password: changeme", "token = ${TOKEN_FROM_ENV}", "secret: <your secret>", "the key to a good life is patience and luck", "password: password123", "author: somebody else"):
        assert secret_scan.spans_of(text, known)[1] == []


def test_long_values_take_linear_time(known):
    value = "".join(random.Random(1).choices(string.ascii_letters, k=60_000))
    assert secret_scan.guess_cost(value, known) > 1000
    assert secret_scan.guess_cost("a" * 60_000, known) < secret_scan.STRONG
