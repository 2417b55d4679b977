"""Pluggable recognisers over many pages: a user's callable runs inside tasks, loaded once in each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a recogniser that is not there answers (fixed values).
FALLBACK_TEXT, FALLBACK_CONFIDENCE = "नमूना पाठ", 0.95


#: Values that a recogniser gets at once.
BATCH = 64
FOUND = ["text", "confidence", "model_simulated", "error"]


def _answer(found: dict) -> tuple:
    return found["text"], float(found["confidence"]), False, None


def _answers(predict, values: list, fallback: str) -> list[tuple]:
    """An answer for each value. A batch that fails, or has another number of answers, is tried again value by value."""
    many = getattr(predict, "predict_batch", None)
    if many is not None:
        try:
            found = [_answer(x) for x in many(values)]
            if len(found) == len(values):
                return found
        except Exception:  # noqa: BLE001, S110  which value it was is found out below
            pass
    out = []
    for value in values:
        try:
            found = predict(value) if callable(predict) else many([value])[0]
            out.append(_answer(found))
        except Exception as e:  # noqa: BLE001  a page's error is data
            out.append((fallback, 0.0, False, f"{type(e).__name__}: {e}"))
    return out


def recognise(df: DataFrame, load: Callable[[], Callable] | None, column: str = "content", fallback: str = FALLBACK_TEXT, batch_size: int = BATCH, profile=None) -> DataFrame:
    """``df`` with ``text, confidence, model_simulated, error``.

    ``load()`` gives ``predict(value) -> {"text", "confidence"}``, or an object whose ``predict_batch(values)`` gives a list of these
    for ``batch_size`` values, and is called once a task. Without a loader the fallback answers with confidence 0.95 and is marked
    simulated; a page that fails gets the fallback with confidence 0 and its error, and the job goes on. ``profile`` is
    the resource profile of the stage (an accelerator for each task, say).
    """
    return _run(df, [(None, load)], column, fallback, batch_size, profile)


def _run(df: DataFrame, models: list[tuple[str | None, Callable | None]], column: str, fallback: str, batch_size: int, profile) -> DataFrame:
    """Pages go through Python for models with a loader alone; the fixed answer of the others is put beside by Spark."""
    named = models[0][0] is not None
    loaders = [(name, load) for name, load in models if load is not None]
    fixed = {"text": F.lit(fallback), "confidence": F.lit(FALLBACK_CONFIDENCE), "model_simulated": F.lit(True), "error": F.lit(None).cast("string")}
    absent = [{**fixed, "model": F.lit(name)} if named else fixed for name, load in models if load is None]
    if not loaders:
        return _each(df, absent)
    added = ["text string", "confidence double", "model_simulated boolean", "error string", *(["model string"] if named else [])]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = [(name, load()) for name, load in loaders]
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size].reset_index(drop=True)
                for name, predict in loaded:
                    found = pd.DataFrame(_answers(predict, list(part[column]), fallback), columns=FOUND)
                    yield pd.concat([part, found.assign(model=name) if named else found], axis=1)

    out = df.mapInPandas(run, schema, profile=profile)
    if not absent:
        return out
    own = {c: F.col(c) for c in absent[0]}
    return _each(out, [own, *absent], F.col("model") == loaders[0][0]).select(out.columns)  # each page once, by its first loaded model


def _each(df: DataFrame, answers: list[dict], all_of: Column | None = None) -> DataFrame:
    """A row of ``df`` for each of ``answers``; where ``all_of`` is false, for the first alone."""
    if len(answers) == 1:
        return df.select(*[F.col(c) for c in df.columns if c not in answers[0]], *[value.alias(c) for c, value in answers[0].items()])
    rows = F.array(*[F.struct(*[value.alias(c) for c, value in answer.items()]) for answer in answers])
    rows = rows if all_of is None else F.when(all_of, rows).otherwise(F.slice(rows, 1, 1))
    return df.select(*[F.col(c) for c in df.columns if c not in answers[0]], F.inline(rows))


def choose_engine(word_level: Callable | None, char_level: Callable | None) -> Callable | None:
    """The word-level loader if there is one."""
    return word_level if word_level is not None else char_level


#: Bytes and pages after which pages of a file go on as a batch.
PAGE_BYTES, PAGE_ROWS = 16 << 20, 1024


def page_batches(files: Iterator[tuple], splitter: Callable, most_bytes: int = PAGE_BYTES, most_rows: int = PAGE_ROWS) -> Iterator[list[tuple]]:
    """Lists of (key, number, page) of (key, file) in order: a splitter that yields its pages is asked for no more than a list holds."""
    held, size = [], 0
    for key, value in files:
        for number, page in enumerate(splitter(value), 1):
            held.append((key, number, page))
            size += len(page) if hasattr(page, "__len__") else 64
            if size >= most_bytes or len(held) >= most_rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def fan_out_pages(df: DataFrame, splitter: Callable, key: str, column: str = "content") -> DataFrame:
    """One row per page, numbered from 1: ``splitter(value)`` yields the pages of a file, of which a task holds some megabytes at a time."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = ((k, value) for batch in batches for k, value in zip(batch[key], batch[column], strict=True))
        for pages in page_batches(files, splitter):
            yield pd.DataFrame(pages, columns=[key, "page", "content"])

    return df.select(key, column).mapInPandas(run, f"`{key}` {key_type}, page int, content {df.schema[column].dataType.simpleString()}")


def text_pages(df: DataFrame, key: str, column: str = "text", separator: str = "\f") -> DataFrame:
    """Pages of a text, numbered from 1, where no splitter is needed."""
    return df.select(key, F.posexplode(F.split(column, separator)).alias("at", "content")).select(key, (F.col("at") + 1).alias("page"), "content")


def run_models(df: DataFrame, loaders: dict[str, Callable | None], column: str = "content", batch_size: int = BATCH, profile=None) -> DataFrame:
    """Every model over the same input, one row for each: the input is read once, and each batch goes through all models."""
    return _run(df, list(loaders.items()), column, FALLBACK_TEXT, batch_size, profile)


def map_directory(files: DataFrame, kernel: Callable[[bytes], bytes]) -> DataFrame:
    """``files`` with the kernel's result in ``content``; a file that fails keeps null and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch["content"]:
                try:
                    out.append((kernel(bytes(value)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"label": batch["label"], "name": batch["name"], "content": [c for c, _ in out], "error": [e for _, e in out]})

    return files.select("label", "name", "content").mapInPandas(run, "label string, name string, content binary, error string")
