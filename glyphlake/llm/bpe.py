"""Byte-level BPE encoding and decoding; merges come from a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import text_of, tokenizer_path

#: White space of Unicode, as the vocabulary's pre-tokenizer reads it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the byte-level pre-tokenizer cuts a text (fixed by the vocabulary's format); the first is for ASCII.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{BLANK}A-Za-z0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
EXACT_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: White space other than lone blanks and line feeds between words.
UNEVEN = re.compile(rf"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  | \n|\n |\n\n|\A[ \n]|[ \n]\Z")
#: Words that a worker remembers before it starts afresh, and the longest that it remembers.
REMEMBERED, LONGEST = 500_000, 64
#: Children of a node of the segment tree.
FAN = 16
ABSENT = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return names


def cut(text: str) -> list[str]:
    """Pre-tokens of a text."""
    return PIECES.findall(text) if text.isascii() else _exact().findall(text)


@lru_cache(1)
def _exact():
    import regex

    return regex.compile(EXACT_PIECES)


class Memory(dict):
    """A dict that fills itself, bounded in entries and in the length of each."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Encoder and decoder of one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in names.items()}
        self.of_byte = [vocab[names[b]] for b in range(256)]
        #: Rank of a pair of ids, and the id that the pair of each rank becomes.
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.pieces = Memory(lambda piece: np.array(self.merge([self.of_byte[b] for b in piece.encode()]), "<u4").tobytes())
        self.bare = Memory(lambda word: b"".join(map(self.pieces.__getitem__, cut(word))))
        self.after_blank = Memory(lambda word: b"".join(map(self.pieces.__getitem__, cut(" " + word))))
        self.line_feed = self.pieces["\n"]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge until no pair is left: the tree's root is the leftmost pair of lowest rank.

        Leaf ``i`` holds ``rank * n + i`` of the pair that starts at symbol ``i``; each node above holds the
        least of its FAN children, so a merge changes three leaves and the nodes above them.
        """
        n = len(ids)
        if n < 2:
            return ids
        rank_of, made = self.rank_of.get, self.made
        leaves = []
        for i in range(n - 1):
            rank = rank_of(ids[i] << 20 | ids[i + 1])
            leaves.append(ABSENT if rank is None else rank * n + i)
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
        top = levels[-1]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (least := min(top)) != ABSENT:
            rank, i = divmod(least, n)
            j = after[i]
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            before[k] = i
            changed = [i] if i < n - 1 else []
            if j < n - 1:
                leaves[j] = ABSENT
                changed.append(j)
            rank = rank_of(ids[i] << 20 | ids[k]) if k < n else None
            if i < n - 1:
                leaves[i] = ABSENT if rank is None else rank * n + i
            if (h := before[i]) >= 0:
                rank = rank_of(ids[h] << 20 | ids[i])
                leaves[h] = ABSENT if rank is None else rank * n + h
                changed.append(h)
            for d in range(1, len(levels)):
                below, level, changed = levels[d - 1], levels[d], {x // FAN for x in changed}
                for x in changed:
                    level[x] = min(below[x * FAN : x * FAN + FAN])
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text are recognised."""
        if self.parted is None or not self.parted.search(text):
            return self._plain(text)
        parts = self.parted.split(text)
        return b"".join(np.uint32(self.special[x]).astype("<u4").tobytes() if k % 2 else self._plain(x) for k, x in enumerate(parts) if x)

    def _plain(self, text: str) -> bytes:
        # Words after a lone blank are cut alike wherever they stand, so they can be remembered whole.
        if UNEVEN.search(text):
            return b"".join(map(self.pieces.__getitem__, cut(text)))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.bare[first] + b"".join(map(self.after_blank.__getitem__, rest)))
        return self.line_feed.join(lines)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(4)
def loaded(path: str) -> Bpe:
    """The encoder of a file, loaded once in a worker."""
    return Bpe(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (``ids, decoded`` if asked for).

    Null text counts as empty: no tokens. Texts of any length are encoded whole. Repeated rows, equal texts and null ids stay rows of
    their own. Extra columns are left out. An empty table gives an empty result. Memory in a worker is bounded by one batch and
    REMEMBERED words of LONGEST characters at most.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")

    def run(batches):
        import pandas as pd

        bpe = loaded(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").astype("int64"), decoded) if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy() if batch["doc_id"].isna().any() else batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
