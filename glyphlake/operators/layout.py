"""Layout analysis of line boxes: rows, columns, cells, reading order.

Boxes are rows ``page_id, line_no, text, x, y, w, h``; every window is over one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = "page_id"
#: Fixed values of the row and column rules.
ROW_GAP, ANCHOR_TOLERANCE = 1.5, 15
GAP_FACTOR, LEAST_GAP, LAST_EDGE = 3.0, 30.0, 2000
TWO_COLUMN_HEIGHTS, TWO_COLUMN_SHARE = 2.0, 0.2


def page_medians(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(PAGE).agg(F.median("w").alias("median_w"), F.median("h").alias("median_h"))


def rows_drifting(boxes: DataFrame) -> DataFrame:
    """``row_no``: a new row begins where y grows by more than 1.5 median heights over the box before it."""
    along = Window.partitionBy(PAGE).orderBy("y", "x", "line_no")
    heights = F.median("h").over(Window.partitionBy(PAGE))
    step = F.when((heights > 0) & (F.col("y") - F.lag("y").over(along) > ROW_GAP * heights), 1).otherwise(0)
    marked = boxes.withColumn("median_h", heights).withColumn("step", step)
    return marked.withColumn("row_no", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("step")


def rows_anchored(boxes: DataFrame, tolerance: int = ANCHOR_TOLERANCE) -> DataFrame:
    """``row_no``: a new row begins where y is further than ``tolerance`` from the first box of the row.

    The first box of a row depends on all before it, so a page's boxes are folded in order; the fold keeps where rows start.
    """
    boxes_of = F.array_sort(F.collect_list(F.struct("y", "x", "line_no", "text", "w", "h")))

    def fold(acc: Column, b: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(b["y"] - acc["anchor"]) > tolerance)
        starts = F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
        return F.struct(F.when(new, b["y"]).otherwise(acc["anchor"]).alias("anchor"), (acc["i"] + 1).alias("i"), starts.alias("starts"))

    def row_of_each(starts: Column, n: Column) -> Column:
        return F.flatten(F.transform(starts, lambda s, row: F.array_repeat(row, F.coalesce(F.get(starts, row + 1), n) - s)))

    start = F.struct(F.lit(None).cast("int").alias("anchor"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))
    pages = boxes.groupBy(PAGE).agg(boxes_of.alias("boxes"))
    starts = pages.select(PAGE, "boxes", F.aggregate("boxes", start, fold, lambda a: a["starts"]).alias("starts"))
    folded = starts.select(PAGE, "boxes", row_of_each(F.col("starts"), F.size("boxes")).alias("rows"))
    flat = folded.select(PAGE, F.explode(F.arrays_zip("boxes", "rows")).alias("b"))
    return flat.select(PAGE, F.col("b.boxes.line_no").alias("line_no"), F.col("b.boxes.text").alias("text"), *[F.col(f"b.boxes.{c}").alias(c) for c in ("x", "y", "w", "h")], F.col("b.rows").alias("row_no"))


def row_gaps(rows: DataFrame) -> DataFrame:
    """``right`` edge and ``gap`` to the next box of the row (null at its end)."""
    along = Window.partitionBy(PAGE, "row_no").orderBy("x", "line_no")
    right = F.col("x") + F.col("w")
    return rows.withColumn("right", right).withColumn("gap", F.lead("x").over(along) - right)


def column_ranges(rows: DataFrame) -> DataFrame:
    """Per page, ranges ``col, start_x, end_x`` between wide gaps: over 3 median positive gaps and 30 at least."""
    gaps = row_gaps(rows)
    usual = gaps.groupBy(PAGE).agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("median_gap"))
    wide = gaps.join(usual.hint("merge"), PAGE).where(F.col("gap") > F.greatest(F.col("median_gap") * GAP_FACTOR, F.lit(LEAST_GAP)))
    edges = wide.select(PAGE, F.col("right").alias("edge")).distinct()
    ends = edges.unionByName(edges.select(PAGE).distinct().withColumn("edge", F.lit(LAST_EDGE)))
    along = Window.partitionBy(PAGE).orderBy("edge")
    return ends.select(PAGE, (F.row_number().over(along) - 1).alias("col"), F.lag("edge", 1, 0).over(along).alias("start_x"), F.col("edge").alias("end_x"))


def assign_cells(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``col`` of each box: the first range that holds x, else the last one; null on pages without columns."""
    held = ranges.groupBy(PAGE).agg(F.array_sort(F.collect_list(F.struct("col", "start_x", "end_x"))).alias("ranges"))
    x = F.col("x")
    inside = F.filter("ranges", lambda r: (r["start_x"] <= x) & (x < r["end_x"]))
    return rows.join(held.hint("merge"), PAGE, "left").withColumn("col", F.coalesce(F.get(inside, F.lit(0))["col"], F.element_at("ranges", -1)["col"])).drop("ranges")


def cell_text(cells: DataFrame) -> DataFrame:
    """Text of each (row, column) in x order; column 0 is the whole row on pages without columns."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "line_no", "text")))
    return cells.groupBy(PAGE, "row_no", F.coalesce("col", F.lit(0)).alias("col")).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("cell"))


def cell_grid(cells: DataFrame, columns: int) -> DataFrame:
    """Cells as one row per table row: columns ``c0`` to ``c{columns - 1}``, and ``more`` with the cells beyond, in order (null if there are none)."""
    texts = cell_text(cells)
    beyond = F.transform(F.array_sort(F.collect_list(F.when(F.col("col") >= columns, F.struct("col", "cell")))), lambda x: x["cell"])
    return texts.groupBy(PAGE, "row_no").agg(*[F.max(F.when(F.col("col") == k, F.col("cell"))).alias(f"c{k}") for k in range(columns)], F.when(F.max("col") >= columns, beyond).alias("more"))


def two_column_pages(boxes: DataFrame, page_w: int) -> DataFrame:
    """Per page, whether the first two boxes of some row lie further apart than two median heights and a fifth of the page."""
    rows = rows_drifting(boxes)
    along = Window.partitionBy(PAGE, "row_no").orderBy("x", "line_no")
    first = rows.withColumn("place", F.row_number().over(along)).withColumn("gap", F.lead("x").over(along) - F.col("x") - F.col("w")).where("place = 1")
    far = F.col("gap") > F.greatest(F.col("median_h") * TWO_COLUMN_HEIGHTS, F.lit(page_w * TWO_COLUMN_SHARE))
    return first.groupBy(PAGE).agg(F.coalesce(F.bool_or(far), F.lit(False)).alias("two_columns"))


def detect_columns(boxes: DataFrame, page_w: int) -> DataFrame:
    """``col`` (by the box's centre on two-column pages, else 0) and ``rank`` of each box in its column by (y, x)."""
    paged = boxes.join(two_column_pages(boxes, page_w).hint("merge"), PAGE)
    col = F.when(F.col("two_columns") & (F.col("x") + F.col("w") / 2 >= page_w / 2), 1).otherwise(0)
    placed = paged.withColumn("col", col)
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy(PAGE, "col").orderBy("y", "x", "line_no")))


def reading_order(boxes: DataFrame, page_w: int, merge: str = "round_robin") -> DataFrame:
    """``place`` of each box in its page: columns in turn (``round_robin``) or one after the other (``column``)."""
    keys = ["rank", "col"] if merge == "round_robin" else ["col", "rank"]
    return detect_columns(boxes, page_w).withColumn("place", F.row_number().over(Window.partitionBy(PAGE).orderBy(*keys)))


def lines_of_boxes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """Boxes with the text of the line of the same geometry; of several such lines the last one counts."""
    keys = [PAGE, "x", "y", "w", "h"]
    last = lines.groupBy(*keys).agg(F.max_by("text", "line_no").alias("line_text"))
    return boxes.join(last.hint("merge"), keys)


def text_layer(boxes: DataFrame, page_w: int) -> DataFrame:
    """Lines that hold text, in reading order with their geometry."""
    return reading_order(boxes, page_w).where(F.regexp_like("text", F.lit(r"\S"))).select(PAGE, "place", "text", "x", "y", "w", "h")


def flatten_lines(pages: Column) -> Column:
    """The lines of all pages of a document as one list, in page order; a page without lines adds none."""
    return F.flatten(F.transform(pages, lambda p: F.coalesce(p["lines"], F.array().cast("array<string>"))))


def parse_lines(c: Column) -> Column:
    """JSON lines with boxes to an array of structs."""
    return F.from_json(c, "array<struct<box:struct<x:int,y:int,w:int,h:int>,text:string>>")


def boxed_lines(lines: Column) -> Column:
    """Lines that have a box and text."""
    return F.filter(lines, lambda x: x["box"].isNotNull() & F.regexp_like(F.coalesce(x["text"], F.lit("")), F.lit(r"\S")))
