"""Rules of the corpus operators written a second time, plainly, for tests."""

from __future__ import annotations

import re
import unicodedata

from glyphlake.llm import quality_rules

SIGNS = set("#*$%&|<>!~^_=+{}[]\\@")


def line_fails(line: str) -> bool:
    n, chars = line.count(" ") + 1, len(line)
    kind = [unicodedata.category(c) for c in line]
    upper, letters = kind.count("Lu"), sum(k[0] == "L" for k in kind)
    words = line.split(" ")
    return (
        n >= 3 and any(c in SIGNS for c in line) and sum(c in SIGNS for c in line) * 10 >= chars
        or n >= 3 and any(c in "|»›•·" for c in line) and sum(c in "|»›•·" for c in line) * 3 >= n
        or n >= 4 and any(a == b == "Lu" for a, b in zip(kind, kind[1:])) and upper * 10 >= letters * 7
        or n >= 30 and not re.search("[.!?…:;]", line)
        or n <= 20 and any(p in line.lower() for p in quality_rules.BOILERPLATE)
        or n >= 12 and len(set(words)) * 10 <= len(words) * 4
    )


def is_bare(line: str) -> bool:
    return len(line) <= 40 and not re.search(r"[.!?…:;,。！？：；，、)\]\"'»”’][ \t\n\x0b\f\r]*\Z", line) and len(re.split(r"[ \t\n\x0b\f\r]+", line.strip(" "))) <= 4


def bare_lines(full: list[str]) -> set[int]:
    """Lines that lie in five bare ones or more in a row."""
    found, run = set(), []
    for i, line in enumerate([*full, "End."]):
        if is_bare(line):
            run.append(i)
            continue
        found |= set(run) if len(run) >= 5 else set()
        run = []
    return found


def clean(text: str) -> str:
    """A text without its failing lines."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    menu = {full[k] for k in bare_lines([lines[i] for i in full])}
    return "\n".join(x for i, x in enumerate(lines) if not line_fails(x) and i not in menu)


def verdict(text: str, base_failed: bool) -> tuple[int, int, bool]:
    """(failed lines, lost characters, kept) of a text."""
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    menu = bare_lines(full)
    good = [x for i, x in enumerate(full) if not line_fails(x) and i not in menu]
    whole = sum(map(len, full))
    lost = whole - sum(map(len, set(good)))
    return len(full) - len(good), lost, not base_failed and lost * 100 <= whole * quality_rules.MAX_LOST
