from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions import script, text
from glyphlake.operators import scoring


def run(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize("typed,want", [("g]kfn", "नेपाल"), ("sf7df8f}+", "काठमाडौं"), ("km", "फ"), ("qm", "क्र"), ("s{", "र्क"), ("0f", "ण"), ("if", "ष"), ("´", "´"), ("M", "M"), ("", "")])
def test_preeti_to_unicode(spark, typed, want):
    assert run(spark, script.preeti_to_unicode, [typed]) == [want]


@pytest.mark.parametrize("typed", ["g]kfn", "s{", "ls", "1fg", "k|df0f"])
def test_keys_come_back_or_are_stable(spark, typed):
    (there,) = run(spark, script.preeti_to_unicode, [typed])
    (back,) = run(spark, script.unicode_to_preeti, [there])
    (again,) = run(spark, script.preeti_to_unicode, [back])
    assert again == there


def test_unicode_to_preeti(spark):
    assert run(spark, script.unicode_to_preeti, ["नेपाल", "कि", "र्क", "क्", "abc १", "र", "र्"]) == ["g]kfn", "ls", "s{", "s\\", "abc !", "/", "/\\"]


@pytest.mark.parametrize("typed,want", [("namaste", "नमस्ते"), ("nepal", "नेपल"), ("kathmandu", "कथ्मन्दु"), ("ri", "रि"), ("kri", "कृ"), ("gyan", "ज्ञन"), ("shree", "श्री"), ("MM", "ँ"), ("k1a", "क1अ")])
def test_roman_to_devanagari(spark, typed, want):
    assert run(spark, script.roman_to_devanagari, [typed]) == [want]


def test_roman_runs_need_a_blank_after_them(spark):
    assert run(spark, script.roman_runs, ["nepal nepal", "ri\n", "12 ka "]) == ["नेपल nepal", "रि\n", "12 क "]


def spelt(token: str) -> str:
    """Romanised spelling written out step by step."""
    out, i, bare = "", 0, False
    first = lambda table, i: next((k for k in sorted(table, key=len, reverse=True) if token.startswith(k, i)), None)
    while i < len(token):
        if n := first(script.NASALS, i):
            out, i, bare = out + script.NASALS[n], i + len(n), False
        elif c := first(script.ROMAN_CONSONANTS, i):
            out += (script.HALANT if bare else "") + script.ROMAN_CONSONANTS[c]
            i += len(c)
            v = first(script.ROMAN_VOWELS, i)
            out, i, bare = (out + script.ROMAN_VOWELS[v][1], i + len(v), False) if v else (out, i, True)
        elif v := first(script.ROMAN_VOWELS, i):
            out, i, bare = out + script.ROMAN_VOWELS[v][0], i + len(v), False
        else:
            out, i, bare = out + token[i], i + 1, False
    return out


def test_roman_agrees_with_the_plain_rule(spark):
    values = ["shrii ksha chhNgyM", "aaiauM MMk", "wThDhbhph", "x y\nza", "kMkhaa", "ñandú rii"]
    assert run(spark, script.roman_to_devanagari, values) == [spelt(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abc \n\té", max_size=12), min_size=1, max_size=8))
def test_counts(spark, values):
    lines = lambda t: 0 if t == "" else max(1, sum(bool(x.strip()) for x in t.split("\n")))
    assert run(spark, text.char_count, values) == [len(v.replace("\n", "")) for v in values]
    assert run(spark, lambda c: text.char_count(c, "dense"), values) == [len(v.replace("\n", "").replace(" ", "")) for v in values]
    assert run(spark, text.line_count, values) == [lines(v) for v in values]


def test_null_text(spark):
    assert run(spark, text.nfc, [None, "é"]) == ["", "é"]
    assert run(spark, text.line_count, [None]) == [0]


def word_distance(a: str, b: str) -> int:
    x, y = re.findall(r"\S+", a), re.findall(r"\S+", b)
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
    return row[-1]


def test_word_edits(spark):
    pairs = [("a b c d", "a c x d"), ("", "a b"), ("same same", "same"), ("नमस्ते संसार", "नमस्ते"), (" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(0, 300, 2)))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, truth string, pred string")
    got = [r[0] for r in df.orderBy("i").select(scoring.word_edits(F.col("truth"), F.col("pred"))).collect()]
    assert got == [word_distance(*p) for p in pairs]


# Keys of whole letters, of half ones and of signs, as a typist knows them; none of the converter's patterns is used below.
WHOLE = {"s": "क", "v": "ख", "u": "ग", "r": "च", "h": "ज", "t": "त", "y": "थ", "b": "द", "w": "ध", "g": "न", "k": "प", "a": "ब", "d": "म", "o": "य", "n": "ल", "j": "व", "z": "श", ";": "स", "x": "ह"}
HALF = {"S": "क्", "V": "ख्", "U": "ग्", "R": "च्", "H": "ज्", "T": "त्", "Y": "थ्", "W": "ध्", "G": "न्", "K": "प्", "A": "ब्", "D": "म्", "N": "ल्", "J": "व्", "Z": "श्", ":": "स्", "X": "ह्"}
SIGN = {"f": "ा", "L": "ी", "'": "ु", '"': "ू", "[": "ृ", "]": "े", "}": "ै", "f]": "ो", "f}": "ौ"}
NASAL = {"+": "ं", "F": "ँ"}
syllables = st.tuples(
    st.lists(st.sampled_from(sorted(HALF)), max_size=2), st.sampled_from(sorted(WHOLE)), st.sampled_from(["", "l", *sorted(SIGN)]), st.sampled_from(["", "", "+", "F"]), st.booleans()
)


def typed_and_read(halves, letter, sign, nasal, reph):
    """A syllable as it is typed (short i first, reph last) and as it is read (reph first, short i behind its letters)."""
    keys = ("l" if sign == "l" else "") + "".join(halves) + letter + ("" if sign == "l" else sign) + nasal + ("{" if reph else "")
    text = ("र्" if reph else "") + "".join(HALF[h] for h in halves) + WHOLE[letter] + ("ि" if sign == "l" else SIGN.get(sign, "")) + NASAL.get(nasal, "")
    return keys, text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(syllables, min_size=1, max_size=5), min_size=1, max_size=20))
def test_typed_syllables_are_read(spark, words):
    pairs = [tuple("".join(part) for part in zip(*(typed_and_read(*s) for s in word), strict=True)) for word in words]
    assert run(spark, script.preeti_to_unicode, [k for k, _ in pairs]) == [t for _, t in pairs]


def test_conversion_time_is_small_and_words_are_forgotten(spark):
    """Conversions run on whole texts outside of interpreted expressions, and remember a bounded number of bounded words."""
    for convert in (script.preeti_to_unicode, script.unicode_to_preeti, script.roman_to_devanagari, script.roman_runs):
        plan = spark.createDataFrame([("ka [\n] ",)], "t string").select(convert(F.col("t")).alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambda" not in plan and "regexp" not in plan
    known = script.Remembered(str.upper)
    for i in range(script.MOST_WORDS + 5):
        assert known[f"w{i}"] == f"W{i}"
    assert len(known) == 5 and known["x" * 100] == "X" * 100 and len(known) == 5


def test_what_is_no_letter_stays(spark):
    typed = ["[\n] ^_` ka\r\n", "shri chhkri MMM riri", "\U0010f100k\U0010f103", None, ""]
    assert run(spark, script.roman_to_devanagari, typed) == ["[\n] ^_` क\r\n", "श्रि छ्कृ ँं रिरि", "\U0010f100क\U0010f103", None, ""]
    assert run(spark, script.roman_runs, ["x" * 50_000, "[\n] ka.ka ka"]) == ["x" * 50_000, "[\n] ka.क ka"]


def test_report_counts_in_one_pass(spark):
    df = spark.createDataFrame([("a", "g]kfn"), ("a", "ab \n["), ("a", None), ("b", None)], "lang string, t string")
    report = script.conversion_report(df, "t", "lang")
    assert report._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert [tuple(r) for r in report.orderBy("lang").collect()] == [("a", 3, 2, 2, 10), ("b", 1, 0, None, None)]
