"""Recognised words to lines of an image, as the TSV of Tesseract gives them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["page", "block", "par", "line"]
NUMBERS = [*KEY, "word", "left", "top", "width", "height"]
MAX_NUMBER = (1 << 32) - 1


def lines(words: DataFrame) -> DataFrame:
    """``words`` (doc_id, image_width, image_height, level, page, block, par, line, word, left, top, width, height, conf, text)
    to a row for each line of an image.

    Words are those of level 5 with text, a finite confidence of at least 0 and a box that is not empty once clipped to the
    image; they are joined in order of ``word``. A line has the mean confidence (0 to 1), the union of the boxes in pixels,
    the same as shares of the image (``bounds``) and its ``position`` in the image by top and left. A number that is missing
    or no unsigned 32-bit number fails the image: its only row has status error.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    found = words.where(F.col("level") == 5).withColumn("text", text).where(F.col("text") != "")
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > MAX_NUMBER) for c in [*NUMBERS, "image_width", "image_height"]])
    left, top = F.least("left", "image_width"), F.least("top", "image_height")
    boxes = found.select(
        "doc_id", "image_width", "image_height", *KEY, "word", "text", F.col("conf").cast("double").alias("conf"), (bad | F.col("conf").isNull()).alias("failed"),
        left.alias("left"), top.alias("top"), F.least(left + F.col("width"), "image_width").alias("right"), F.least(top + F.col("height"), "image_height").alias("bottom"),
    )
    sure = ~F.isnan("conf") & (F.abs("conf") < float("inf")) & (F.col("conf") >= 0)
    kept = boxes.where(F.col("failed") | (sure & (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top"))))
    grouped = kept.repartition("doc_id").groupBy("doc_id", *KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.least(F.avg("conf") / 100, F.lit(1.0)).alias("confidence"), F.count("*").alias("n_words"),
        *(F.min(c).alias(c) for c in ("left", "top")), *(F.max(c).alias(c) for c in ("right", "bottom", "image_width", "image_height", "failed")),
    )
    image = Window.partitionBy("doc_id")
    placed = grouped.withColumn("position", F.row_number().over(image.orderBy("top", "left", *KEY))).withColumn("failed", F.max("failed").over(image))
    share = lambda a, size: (a / F.col(size)).cast("double")
    bounds = F.struct(
        share(F.col("left"), "image_width").alias("left"), share(F.col("top"), "image_height").alias("top"),
        share(F.col("right") - F.col("left"), "image_width").alias("width"), share(F.col("bottom") - F.col("top"), "image_height").alias("height"),
    )
    out = placed.where(~F.col("failed") | (F.col("position") == 1)).withColumn("bounds", F.when(~F.col("failed"), bounds))
    fields = [*KEY, "position", "text", "confidence", "left", "top", "right", "bottom", "bounds", "n_words"]
    return out.select(
        "doc_id", F.when(F.col("failed"), "error").otherwise("ok").alias("status"), F.when(F.col("failed"), "recognition_failed").alias("error_code"),
        *(F.when(~F.col("failed"), F.col(c)).alias(c) for c in fields),
    )


def checked(found: DataFrame) -> DataFrame:
    """Recognised lines (doc_id, text, confidence, left, top, width, height as shares of the image) in order, or one failed row a document.

    A line has text, a confidence from 0 to 1 and a box inside the unit square.
    """
    number = lambda c: F.col(c).cast("double")
    unit = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(number(c)) & (number(c) >= 0) & (number(c) <= 1) for c in ("confidence", "left", "top", "width", "height")])
    inside = (F.col("width") > 0) & (F.col("height") > 0) & (number("left") + number("width") <= 1 + 1e-6) & (number("top") + number("height") <= 1 + 1e-6)
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = found.withColumn("__bad", ~F.coalesce(unit & inside & (text != ""), F.lit(False)))
    image = Window.partitionBy("doc_id")
    placed = rows.withColumn("__failed", F.max("__bad").over(image)).withColumn("position", F.row_number().over(image.orderBy("top", "left", "text")))
    keep = [F.when(~F.col("__failed"), F.col(c)).alias(c) for c in ("position", "text", "confidence", "left", "top", "width", "height")]
    return placed.where(~F.col("__failed") | (F.col("position") == 1)).select("doc_id", F.when(F.col("__failed"), "error").otherwise("ok").alias("status"), F.when(F.col("__failed"), "recognition_failed").alias("error_code"), *keep)
