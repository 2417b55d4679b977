"""Edit scripts between a truth and a prediction: substitutions, deletions, insertions, and what was taken for what."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that are kept to be traced at once, and parts that a longer stretch is cut into.
BLOCK, PARTS = 256, 64
#: Bytes of bit vectors of symbols that are remembered.
REMEMBERED = 1 << 26


class _Table:
    """Columns of the distance table as bit vectors over the truth (Myers; Hyyrö for whole sequences)."""

    def __init__(self, truth: Sequence) -> None:
        self.ones = (1 << len(truth)) - 1
        self.places: dict = {}
        for i, x in enumerate(truth):
            self.places.setdefault(x, []).append(i)
        self.known: dict = {}
        self.room = REMEMBERED // (len(truth) // 8 + 1)

    def equal(self, symbol) -> int:
        """Bits of the truth's places that hold ``symbol``."""
        bits = self.known.get(symbol)
        if bits is None:
            bits = 0
            for i in self.places.get(symbol, ()):
                bits |= 1 << i
            if len(self.known) < self.room:
                self.known[symbol] = bits
        return bits

    def step(self, up: int, down: int, symbol) -> tuple[int, int, int]:
        """From the rises and falls along one column to the next one: (cells that cost no more than their diagonal, rises, falls)."""
        eq, ones = self.equal(symbol), self.ones
        level = (((eq & up) + up) ^ up) | eq | down
        right, left = (down | ~(level | up)) & ones, level & up
        right = (right << 1) | 1
        left <<= 1
        return level & ones, (left | ~(level | right)) & ones, right & level & ones


def aligned(truth: Sequence, pred: Sequence) -> Counter:
    """How often each (truth, prediction) stands in a cheapest alignment; None stands for nothing.

    Of the cheapest alignments it is the one that, from the end, takes a pair before a deletion and that before an insertion. Columns
    are computed in bit vectors and kept for BLOCK of them at once: longer stretches are cut into PARTS whose starts are
    kept, and each part is computed again when the trace comes to it, so memory stays far below the whole table.
    """
    found: Counter = Counter()
    m, n = len(truth), len(pred)
    while m and n and truth[m - 1] == pred[n - 1]:
        m, n = m - 1, n - 1
        found[truth[m], pred[n]] += 1
    truth = truth[:m]
    table = _Table(truth)

    def back(low: int, high: int, up: int, down: int, row: int) -> int:
        """Trace from ``row`` of column ``high`` to column ``low``, whose state is (up, down); the row in which it arrives."""
        if high - low > BLOCK:
            size = max(BLOCK, -(-(high - low) // PARTS))
            starts = []
            for j in range(low, high):
                if (j - low) % size == 0:
                    starts.append((j, up, down))
                _, up, down = table.step(up, down, pred[j])
            for j, up, down in reversed(starts):
                row = back(j, min(high, j + size), up, down, row)
            return row
        columns = []
        for j in range(low, high):
            level, up, down = table.step(up, down, pred[j])
            columns.append((level, up))
        j = high
        while j > low:
            if not row:
                found[None, pred[j - 1]] += 1
                j -= 1
                continue
            t, p = truth[row - 1], pred[j - 1]
            level, rises = columns[j - 1 - low]
            if t == p or not level >> (row - 1) & 1:
                found[t, p] += 1
                row, j = row - 1, j - 1
            elif rises >> (row - 1) & 1:
                found[t, None] += 1
                row -= 1
            else:
                found[None, p] += 1
                j -= 1
        return row

    row = back(0, n, table.ones, 0, m)
    found.update((t, None) for t in truth[:row])
    return found


COUNTS = "substitutions long, deletions long, insertions long"


def counts_of(found: Counter) -> tuple[int, int, int]:
    edits = [(t, p, n) for (t, p), n in found.items() if t != p]
    return sum(n for t, p, n in edits if t is not None and p is not None), sum(n for _, p, n in edits if p is None), sum(n for t, _, n in edits if t is None)


def edit_counts(truth: Column, pred: Column, unit: str = "char") -> Column:
    """A struct of substitutions, deletions (of the truth) and insertions, in characters or words; null if a text is null. Their sum is the edit distance."""
    split = WORD.findall if unit == "word" else str

    @F.pandas_udf(f"struct<{COUNTS.replace(' ', ':').replace(',:', ',')}>")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None or y is None else counts_of(aligned(split(x), split(y))) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"], dtype="Int64")

    return count(truth, pred)


def pair_counts(truth: Column, pred: Column) -> Column:
    """How often each character of a truth was read as each one of the prediction: an array of (truth, pred, n); '' stands for nothing."""

    @F.pandas_udf("array<struct<truth:string,pred:string,n:long>>")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = (Counter() if x is None or y is None else aligned(x, y) for x, y in zip(a, b, strict=True))
        return pd.Series([[{"truth": t or "", "pred": p or "", "n": n} for (t, p), n in found.items()] for found in pairs])

    return count(truth, pred)
