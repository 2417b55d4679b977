"""The label model of personal data: what it learns of labelers, and where the classifier beats their majority."""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter

import pytest

from glyphlake.llm import personal_data
from glyphlake.llm.common import tokenizer_path
from tests.llm.test_texts import planted


def cases(count=1600):
    """Planted cases, and digests that no cue gives away: two labelers take them for keys, one for a digest."""
    rng, out = random.Random(8), []
    for k in range(count):
        out.append(planted(rng, k))
        if k % 8 == 0:
            head = "it came with build "
            out.append((head + "".join(rng.choices("0123456789abcdef", k=40)) + " of it", len(head), len(head) + 40, None))
    return out


def judged(texts):
    """(votes, features, kind, truth) of each candidate beyond the base kinds."""
    for text, start, end, kind in texts:
        for k, s, e, votes, features in personal_data.candidates(text):
            if k >= personal_data.BASE:
                yield k, votes, features, kind == personal_data.KINDS[k] and s < end and start < e


@pytest.fixture(scope="module")
def halves():
    every = cases()
    return list(judged(every[:900])), list(judged(every[900:]))


def test_classifier_beats_the_majority_on_held_out_spans(halves):
    fitted, held_out = halves
    chance = personal_data.fit(Counter((k, v, f) for k, v, f, _ in fitted))
    right = sum((chance[k, f] >= personal_data.THRESHOLD) == truth for k, _, f, truth in held_out)
    plain = sum(personal_data.majority(v) == truth for _, v, _, truth in held_out)
    differ = [(personal_data.majority(v), truth) for k, v, f, truth in held_out if (chance[k, f] >= personal_data.THRESHOLD) != personal_data.majority(v)]
    assert right >= 0.98 * len(held_out) and right - plain >= 0.05 * len(held_out)
    assert sum(m != t for m, t in differ) >= 0.9 * len(differ) > 0


def test_reliabilities_leave_what_was_held_of_them(halves):
    """Labelers start as right in 8 of 10 cases; shape and lexicon, which take digests for keys, fall, and those that others confirm rise."""
    fitted, _ = halves
    _, trusted = personal_data.label_model(Counter((k, v) for k, v, _, _ in fitted))
    secret = {name: trusted[personal_data.KINDS.index("secret"), name] for name in personal_data.LABELERS}
    assert secret["shape"][0] < 0.65 and secret["lexicon"][0] < 0.65
    assert secret["assigned"][0] > 0.95 and secret["form"][1] > 0.95 and secret["counter"][1] > 0.95
    # What they learn agrees with the truth, which they never saw: how much more often a yes is said of secrets than of other spans.
    truth = [(v, t) for k, v, _, t in fitted if personal_data.KINDS[k] == "secret"]
    for name in ("shape", "lexicon", "form", "context"):
        at = personal_data.LABELERS.index(name)
        of_secrets, of_others = (sum(v[at] == personal_data.YES for v, t in truth if t == own) / sum(t == own for _, t in truth) for own in (True, False))
        assert secret[name][0] == pytest.approx(max(0.5, of_secrets / (of_secrets + of_others)), abs=0.06), name


def test_label_model_is_that_of_plain_sums():
    """The same rounds written out span by span."""
    counts = {(4, "1010011"): 30, (4, "2001200"): 50, (4, "0011010"): 20, (4, "2002020"): 90, (4, "0000000"): 3}
    got, _ = personal_data.label_model(counts, rounds=7)
    spans = [v for (_, v), n in counts.items() for _ in range(n)]
    post = [(v.count("1") + 0.5) / (v.count("1") + v.count("2") + 1) for v in spans]
    n, weight = len(spans), personal_data.WEIGHT
    for _ in range(7):
        score = [math.log((weight * personal_data.PRIOR + sum(post)) / (weight * (1 - personal_data.PRIOR) + n - sum(post)))] * n
        for j in range(len(personal_data.LABELERS)):
            silent = sum(v[j] == "0" for v in spans) / n
            rates = []
            for right, mass in ((personal_data.RIGHT, post), (1 - personal_data.RIGHT, [1 - p for p in post])):
                seen = [0.02 + weight * x for x in (silent, (1 - silent) * right, (1 - silent) * (1 - right))]
                for v, m in zip(spans, mass, strict=True):
                    seen[int(v[j])] += m
                rates.append([x / sum(seen) for x in seen])
            for i, v in enumerate(spans):
                c = int(v[j])
                ratio = math.log(rates[0][c] / rates[1][c])
                score[i] += max(-1.0, min(1.0, ratio)) if c == 0 else max(0.0, ratio) if c == 1 else min(0.0, ratio)
        post = [1 / (1 + math.exp(-x)) for x in score]
    for v, p in zip(spans, post, strict=True):
        assert got[4, v] == pytest.approx(p)


def test_features_hold_no_vote():
    """Spans with the same measures have the same chance, whatever the labelers say of them."""
    words, names = personal_data.lexicon(tokenizer_path(personal_data.VOCABULARY))
    assert len(names) > 2000 and len(words) > 10_000
    value = "a1b2c3d4e5f60718293a4b5c6d7e8f9012345678"
    one, two = ((personal_data.votes_of(4, value, b, words, names), personal_data.features_of(4, value, b, words, names)) for b in ("some plain words here ", "other usual things too "))
    assert one == two and len(one[1]) == personal_data.FEATURES
    assert personal_data.votes_of(4, value, "in the commit here ", words, names) != one[0]


def test_classifier_travels_to_tasks(halves):
    fitted, _ = halves
    chance = personal_data.fit(Counter((k, v, f) for k, v, f, _ in fitted))
    back = pickle.loads(pickle.dumps(chance))
    assert all(back[k, f] == chance[k, f] for k, _, f, _ in fitted)
    assert personal_data.fit({})[4, "0" * personal_data.FEATURES] == 0.0
