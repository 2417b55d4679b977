"""Roll-ups from glyphs to lines, pages and documents, and CTC decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD_GAP = 0.8
NO_TEXT = "No text was recognised"


def ordered_join(order: str, text: str, separator: str) -> Column:
    """Texts of a group joined in order; the group is one page or document."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), separator)


def word_gaps(glyphs: DataFrame) -> DataFrame:
    """``piece``: the glyph, with a blank before it if it lies further than 0.8 median widths of its line from the one before."""
    line = Window.partitionBy("page_id", "line_no")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(line.orderBy("glyph_no"))
    wide = F.coalesce(gap > WORD_GAP * F.median("w").over(line), F.lit(False))
    return glyphs.withColumn("piece", F.when(wide, F.concat(F.lit(" "), "glyph")).otherwise(F.col("glyph")))


def lines_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """One row per line: text, bounding box, glyphs, confidence fixed at 0."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return (
        word_gaps(glyphs)
        .groupBy("page_id", "line_no")
        .agg(
            ordered_join("glyph_no", "piece", "").alias("text"),
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            (right - F.min("x")).alias("w"),
            (bottom - F.min("y")).alias("h"),
            F.count(F.lit(1)).alias("n_glyphs"),
            F.lit(0.0).alias("confidence"),
        )
    )


def pages_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """One row per page: glyph boxes and their mean confidence."""
    return glyphs.groupBy("page_id").agg(F.count(F.lit(1)).alias("num_chars"), F.countDistinct("line_no").alias("num_lines"), F.avg("confidence").alias("avg_confidence"))


def pages_from_lines(lines: DataFrame) -> DataFrame:
    """One row per page: text, characters but blanks and line feeds, mean of confidences that are not 0."""
    pages = lines.groupBy("page_id").agg(ordered_join("line_no", "text", "\n").alias("text"), F.count(F.lit(1)).alias("num_lines"), F.coalesce(F.avg(F.nullif("confidence", F.lit(0.0))), F.lit(0.0)).alias("avg_confidence"))
    return pages.withColumn("num_chars", F.length(F.replace(F.replace("text", F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))).cast("long"))


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """One row per document: pages joined by a blank line, sums, engine of the first page, mean over pages with lines."""
    return pages.groupBy("doc_id").agg(
        ordered_join("page", "text", "\n\n").alias("text"),
        F.sum("num_lines").cast("long").alias("num_lines"),
        F.sum("num_chars").cast("long").alias("num_chars"),
        F.count(F.lit(1)).alias("num_pages"),
        F.min_by("engine", "page").alias("engine"),
        F.coalesce(F.avg(F.when(F.col("num_lines") > 0, F.col("avg_confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.bool_or(F.col("num_lines") > 0).alias("any_lines"),
    ).withColumn("error", F.when(~F.col("any_lines"), NO_TEXT))


def headed_text(pages: DataFrame) -> DataFrame:
    """One row per document: pages under ``[Page n]`` headers."""
    headed = pages.withColumn("text", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), "text"))
    return headed.groupBy("doc_id").agg(ordered_join("page", "text", "\n\n").alias("text"))


def pdf_text(pages: DataFrame) -> DataFrame:
    """One row per document: pages joined by a blank line, plain mean of page confidences."""
    return pages.groupBy("doc_id").agg(ordered_join("page", "text", "\n\n").alias("text"), F.coalesce(F.avg("avg_confidence"), F.lit(0.0)).alias("confidence"))


def best_steps(steps: DataFrame) -> DataFrame:
    """Per sample and step: the likeliest class (the lowest of several) and its probability."""
    return steps.groupBy("sample_id", "t").agg(F.max("prob").alias("best"), F.max_by(F.col("k"), F.struct("prob", -F.col("k"))).alias("k"))


def ctc_decode(steps: DataFrame, blank: int = 46, charset: dict[int, str] | None = None) -> DataFrame:
    """Per sample: greedy CTC text (repeats of the step before dropped, then blanks) and the mean best probability.

    Without a charset, classes are joined by blanks.
    """
    best = best_steps(steps)
    again = F.col("k").eqNullSafe(F.lag("k").over(Window.partitionBy("sample_id").orderBy("t")))
    kept = best.withColumn("out", F.when(~again & (F.col("k") != blank), F.col("k")))
    ordered = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("t", "out"))), lambda s: s["out"]), lambda k: k.isNotNull())
    if charset is not None:
        table = F.create_map(*[F.lit(x) for pair in charset.items() for x in pair])
        text = F.array_join(F.transform(ordered, lambda k: F.coalesce(F.try_element_at(table, k), F.lit(""))), "")
    else:
        text = F.array_join(F.transform(ordered, lambda k: k.cast("string")), " ")
    return kept.groupBy("sample_id").agg(text.alias("text"), F.avg(F.col("best").cast("double")).alias("confidence"))
