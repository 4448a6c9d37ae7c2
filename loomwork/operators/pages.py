"""Pages and images that go into one document: input caps, page lists and totals, page geometry, and how an image is taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.binary import image_kind
from loomwork.functions.names import MAX_PAGES
from loomwork.operators.prefix import has_hot_key, running_totals

# Caps on inputs, A4 and its margin, the longest side of a page in points, and points a pixel.
MAX_FILES, MAX_FILE = 20, 100 << 20
A4, MARGIN, MAX_SIDE, POINTS = (595.28, 841.89), 36, 14_400, 0.75


def capped(files: DataFrame, key: str, size: Column, most: int = MAX_FILES, bytes_: int = MAX_FILE) -> DataFrame:
    """(key, files, error_code, over): 'many' if a call has too many files, else 'big' if one is too large, and how many are.

    Null sizes count as 0 bytes.
    """
    large = F.count_if(F.coalesce(size, F.lit(0)) > bytes_)
    told = files.groupBy(key).agg(F.count("*").alias("files"), large.alias("over"))
    return told.withColumn("error_code", F.when(F.col("files") > most, "many").when(F.col("over") > 0, "big"))


def appended(*lists: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Lists one after another under each key, duplicates kept; ``ord`` counts on and ``src`` numbers the list. Many tasks share a hot key."""
    both = None
    for k, rows in enumerate(lists):
        one = rows.withColumn("src", F.lit(k))
        both = one if both is None else both.unionByName(one)
    return running_totals(both, [key], ["src", order], {"ord": F.lit(1).cast("long")}, spread=has_hot_key(both, [key]))


def running_pages(files: DataFrame, key: str, pages: Column, order: str = "ord", most: int = MAX_PAGES) -> DataFrame:
    """files with ``pages`` up to each and ``many``: whether the total passes the cap there."""
    total = running_totals(files, [key], [order], {"pages": pages.cast("long")}, spread=has_hot_key(files, [key]))
    return total.withColumn("many", F.col("pages") > most)


def fit_a4(w: Column, h: Column) -> Column:
    """(x, y, w, h): a picture as large as the margins let it be, in the middle; null without a size."""
    scale = F.least((A4[0] - 2 * MARGIN) / w, (A4[1] - 2 * MARGIN) / h)
    placed = F.struct(((A4[0] - w * scale) / 2).alias("x"), ((A4[1] - h * scale) / 2).alias("y"), (w * scale).alias("w"), (h * scale).alias("h"))
    return F.when((w > 0) & (h > 0), placed)


def page_of(w: Column, h: Column) -> Column:
    """(w, h) in points of a page of a picture's own size; a side over the limit shrinks both."""
    shrink = F.least(F.lit(1.0), MAX_SIDE / F.greatest(w * POINTS, h * POINTS))
    return F.when((w > 0) & (h > 0), F.struct((w * POINTS * shrink).alias("w"), (h * POINTS * shrink).alias("h")))


def to_points(x: Column, y: Column, scale: Column, height: Column) -> Column:
    """(x, y) on a page of rendered pixels: scaled back, and from the bottom."""
    return F.struct((x / scale).alias("x"), (height - y / scale).alias("y"))


def marked_kind(content: Column) -> Column:
    """Extension of a marked picture: png for what may be transparent, else jpg."""
    return F.when(image_kind(content).isin("png", "gif"), "png").otherwise("jpg")


def routed(images: DataFrame, content_col: str = "content") -> DataFrame:
    """images with kind, route and error_code: how each gets into a document.

    route is ``asis`` for upright JPEG and for PNG, ``png`` or ``jpeg`` for what is drawn
    anew as such, null with error_code ``img`` (unknown, or nothing declared) or
    ``pixels`` (too large).  Null content is unknown.
    """
    from loomwork.operators.containers import upright
    from loomwork.operators.guards import declared

    sized = declared(images, content_col)
    kind = image_kind(F.coalesce(F.col(content_col), F.lit(b"")))
    sized = upright(sized.withColumn("kind", kind), content_col)
    pixels = F.col("declared_pixels")
    guarded = F.col("kind").isin("png", "heif")
    code = F.when(F.col("kind").isNull() | (guarded & (F.coalesce(pixels, F.lit(0)) == 0)), "img").when(guarded & ~F.col("allowed"), "pixels")
    route = F.when(F.col("kind") == "jpeg", F.when(F.col("upright") == 1, "asis").otherwise("jpeg")).when(F.col("kind") == "png", "asis").when(F.col("kind") == "gif", "png").otherwise("jpeg")
    return sized.withColumn("error_code", code).withColumn("route", F.when(F.col("error_code").isNull(), route)).drop("declared_pixels", "allowed", "upright")
