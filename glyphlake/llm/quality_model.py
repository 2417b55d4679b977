"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import packing
from glyphlake.llm.common import stored, text_of, tokenizer_path

#: Values of a word's vector; neighbours on each side that make its context; nonzero places of an index vector.
DIM, REACH, PLACES = 64, 2, 2
#: Words of a task whose contexts are added up at once.
CHUNK = 1_000_000
#: Expected number of labelled rows that the network is fitted on (the documented bound of the sample).
TRAIN_ROWS = 20_000
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
PREDICT_AT = 0.3
VECTOR = [f"v{k}" for k in range(DIM)]


# ---- words of a text and their vectors


def index_vectors(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Random index vectors: PLACES places and signs of each word as a neighbour on the left and on the right."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIM, (2, vocabulary, PLACES)), rng.choice([-1.0, 1.0], (2, vocabulary, PLACES))


def contexts_of(texts: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, contexts): for each word, the sum of the index vectors of its REACH neighbours on each side."""
    places, signs = index_vectors(vocabulary)
    gap = np.full(REACH, -1)
    words = np.concatenate([x for t in texts for x in (t.astype("int64"), gap)])
    total = np.zeros(vocabulary * DIM)
    for k in range(1, REACH + 1):
        both = (words[:-k] >= 0) & (words[k:] >= 0)
        left, right = words[:-k][both], words[k:][both]
        for p in range(PLACES):
            total += np.bincount(left * DIM + places[1, right, p], signs[1, right, p], len(total))
            total += np.bincount(right * DIM + places[0, left, p], signs[0, left, p], len(total))
    return np.bincount(words[words >= 0], minlength=vocabulary), total.reshape(vocabulary, DIM)


def word_vectors(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """``word, n, v0 ...``: count and summed context of every word of all texts; at most ``vocabulary`` rows."""

    def run(batches):
        counts, total, held, size = np.zeros(vocabulary, "int64"), np.zeros((vocabulary, DIM)), [], 0

        def add() -> None:
            nonlocal counts, total
            n, v = contexts_of(held, vocabulary)
            counts, total = counts + n, total + v

        for batch in batches:
            for words in batch["words"]:
                held.append(np.frombuffer(words, dtype_for(vocabulary)))
                size += len(held[-1])
                if size >= CHUNK:
                    add()
                    held, size = [], 0
        if size:
            add()
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"word": seen, "n": counts[seen], **dict(zip(VECTOR, total[seen].astype("int64").T, strict=True))})

    schema = "word int, n long, " + ", ".join(f"{v} long" for v in VECTOR)
    return tokens.select("words").mapInPandas(run, schema).groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in VECTOR])


def dtype_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, words``: the words of each whole text, entries of a public vocabulary, as bytes."""
    kind = dtype_for(vocabulary_size(path))

    def run(batches):
        words_of = packing.loaded(path)
        for batch in batches:
            ids = batch["doc_id"]
            yield pd.DataFrame({"doc_id": ids.astype("Int64") if ids.isna().any() else ids, "words": [np.frombuffer(words_of(t), "<u4").astype(kind).tobytes() for t in batch["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, "doc_id long, words binary")


def vocabulary_size(path: str) -> int:
    return packing.loaded(path).library.get_vocab_size()


class Pool:
    """Mean and spread of the unit vectors of a text's words; zeros for a text without words."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, vocabulary: int):
        self.kind = dtype_for(vocabulary)
        self.vectors = np.zeros((vocabulary, DIM), np.float32)
        self.vectors[words] = contexts / np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)

    def __call__(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM))
        for row, words in zip(out, texts, strict=True):
            own, times = np.unique(np.frombuffer(words, self.kind), return_counts=True)
            if len(own):
                share, v = times / times.sum(), self.vectors[own].astype(float)
                row[:DIM] = mean = share @ v
                row[DIM:] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        return out


# ---- the network


class Network:
    """Two layers in numpy: tanh, then a logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        check = rng.random(len(x)) < 0.2
        check &= len(x) >= 50
        fit_x, fit_y = x[~check], y[~check]
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0
        for _ in range(ROUNDS):
            order = rng.permutation(len(fit_x))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                hidden = np.tanh(fit_x[at] @ self.p[0] + self.p[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.p[2] + self.p[3], -30, 30))) - fit_y[at]) / len(at)
                back = np.outer(error, self.p[2]) * (1 - hidden**2)
                slopes = [fit_x[at].T @ back + DECAY * self.p[0], back.sum(0), hidden.T @ error + DECAY * self.p[2], error.sum(keepdims=True)]
                step += 1
                for j, slope in enumerate(slopes):
                    first[j] = 0.9 * first[j] + 0.1 * slope
                    second[j] = 0.999 * second[j] + 0.001 * slope**2
                    self.p[j] = self.p[j] - RATE * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if check.any() and len(set(y[check])) == 2:
            logits = self._logits(x[check])
            loss = lambda t: np.mean(np.logaddexp(0, logits / t) - y[check] * logits / t)
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Words are the tokens of the public vocabulary at ``path``: words, parts of rarer words, and signs, in their own case.
    Each has a vector of its own, the sum of its contexts over all texts; the table of vectors has at most as many rows as the
    vocabulary (50,257), which bounds what is broadcast. Mean and spread of the vectors over each whole text go to the network.
    It is fitted on labelled rows whose crc32(id) mod 5 is not 0, thinned by a hash of the id to about ``train_rows``.

    Null text is empty: no words, and scored like any other. Texts of any length are read whole. Equal texts score alike,
    repeated rows stay rows of their own. A null id is held out. Without both labels in the training rows every score is
    their mean, or 0.5 if there are none. Extra columns are left out. An empty table gives an empty result.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    vocabulary = vocabulary_size(path)
    tokens = stored(tokenized(docs, path, id_col, text_col), "words", compression="zstd")
    table = word_vectors(tokens, vocabulary).toPandas()  # at most one row for each entry of the vocabulary
    pool = Pool(table["word"].to_numpy("int64"), table[VECTOR].to_numpy(float), vocabulary)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    labelled = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held)
    share = min(1.0, train_rows / max(1, labelled.count()))
    thinned = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def features(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "f": list(pool(batch["words"]))})

    # The sample is bounded by train_rows, so it goes to the tokens and not they to it.
    train = tokens.join(F.broadcast(thinned), "doc_id").select("doc_id", "y", "words").mapInPandas(features, "doc_id long, y double, f array<double>").toPandas()
    train["tie"] = train["f"].map(tuple)
    train = train.sort_values(["doc_id", "y", "tie"])
    if len(train) and train["y"].nunique() == 2:
        model = Network(np.array(train["f"].tolist(), float), train["y"].to_numpy())
    else:
        mean = float(train["y"].mean()) if len(train) else 0.5
        model = lambda x: np.full(len(x), mean)

    @F.pandas_udf("double")
    def score(words: pd.Series) -> pd.Series:
        return pd.Series(model(pool(words)) if len(words) else np.zeros(0))

    scored = tokens.select("doc_id", held.alias("held_out"), score("words").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
