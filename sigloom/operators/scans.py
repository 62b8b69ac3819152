"""Scanned or searchable: classes of pages and documents from facts of their pages.

A page is a row: its document, words, letters, images, width and height, the
share of it that its largest image covers, and its text. Nulls count as 0 (or no
text); a page without area has the density 0. One aggregate gives the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import text as tx

#: Coverage from which on an image counts as the whole page, and as most of it.
WHOLE, MOST = 0.8, 0.5
#: Letters per unit of area under which text is next to none.
SPARSE = 0.001


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def scanned_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, words, letters, images, width, height, coverage, text) with ``quality``, ``scanned`` and ``scan_confidence``."""
    words, images, coverage = _number("words"), _number("images"), _number("coverage")
    area = _number("width") * _number("height")
    density = F.when(area > 0, _number("letters") / area).otherwise(0.0)
    quality = F.when(words == 0, "Empty").otherwise(tx.text_quality("text", lenient=False))
    whole = coverage > WHOLE
    no_text = (images > 0) & (words == 0)
    little_text = (images > 0) & (density < SPARSE) & (words < 50)
    scanned = (whole & (words < 20)) | ((coverage > MOST) & F.col("quality").isin("Garbage", "Empty")) | no_text | little_text
    few = F.when(words == 0, 0.2).when(words < 10, 0.1).otherwise(0.0)
    sure = F.lit(0.5) + F.when(whole, 0.3).otherwise(0.0) + few + F.when(coverage > 0.9, 0.1).otherwise(0.0)
    out = pages.withColumn("quality", quality).withColumn("scanned", scanned)
    return out.withColumn("scan_confidence", F.when(F.col("scanned"), F.least(F.round(sure, 6), F.lit(1.0))).otherwise(0.0))


def scanned_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, total_words, total_images, scanned_pages, kind, needs_ocr, confidence) of every document of :func:`scanned_pages`.

    Scanned beyond nine pages of ten, Searchable under one of ten, else Mixed.
    The confidence is the mean of the scanned pages', 1 where none is.
    """
    hit = F.col("scanned").cast("int")
    per = scanned_pages(pages).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(_number("words")).cast("long").alias("total_words"),
        F.sum(_number("images")).cast("long").alias("total_images"),
        F.sum(hit).cast("long").alias("scanned_pages"),
        F.round(F.coalesce(F.avg(F.when(F.col("scanned"), F.col("scan_confidence"))), F.lit(1.0)), 6).alias("confidence"),
    )
    share = F.col("scanned_pages") / F.col("pages")
    kind = F.when(share > 0.9, "Scanned").when(share < 0.1, "Searchable").otherwise("Mixed")
    return per.withColumn("kind", kind).withColumn("needs_ocr", F.col("kind") != "Searchable")
