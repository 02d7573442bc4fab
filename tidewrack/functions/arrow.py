"""Helpers for Arrow-batched Python stages with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Rows and bytes in one Arrow batch handed to Python: long texts make batches shorter, not larger.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of very different lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_pieces(texts: list[str | None], limit: int) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) lists of about ``limit`` characters each; a longer text is cut after a space or line end.

    All pieces of a row come in order; a null is an empty text and gives no piece.
    """
    held: list[tuple[int, str]] = []
    size = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > limit:
                cut = max(text.rfind(" ", at, at + limit), text.rfind("\n", at, at + limit))
                end = cut + 1 if cut > at else at + limit
            if held and size + end - at > limit:
                yield held
                held, size = [], 0
            held.append((row, text[at:end]))
            size += end - at
            at = end
    if held:
        yield held
