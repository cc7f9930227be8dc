"""Labelled rows to learn from: a bounded sample, chosen by hash so that it repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.rows import columns, staged


def held_out(doc_id):
    """Rows of this fold are never learnt from: CRC-32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` learnable rows and ``max_bytes`` of text per label.

    The bounds hold for the fit alone, and for each label by itself. Rows are drawn by the
    hash of the id, repeated ones as rows of their own; rows without an id, label or text,
    and the held-out fold, are left out. A text that is longer than what is left of its
    label's bytes is passed over; the rows after it are still taken.
    """
    known = columns(labels, id="doc_id", y=label).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    texts = columns(docs, id=doc_id, text=text).select("id", "text", F.xxhash64("text").alias("t"), F.octet_length("text").alias("n"))
    # Drawn by length, so that the driver gets no text but those that are learnt from.
    short = texts.where(F.col("n") <= max_bytes).drop("text").join(known.withColumn("h", F.xxhash64("id")), "id")
    short = staged(short.select("h", "id", F.col("y").cast("int").alias("y"), "t", "n"), "labelled")
    drawn: list[tuple[int, int, int, int, int]] = []
    for y in (0, 1):
        left = max_bytes
        for place, row in enumerate(short.where(F.col("y") == y).orderBy("h", "id", "t").limit(per_class).collect()):
            if row.n <= left:
                left -= row.n
                drawn.append((row.h, y, place, row.t, row.n))
    if not drawn:
        return []
    keys = docs.sparkSession.createDataFrame(list({d[3:] for d in drawn}), "t long, n int")
    found = texts.select("t", "n", "text").join(F.broadcast(keys), ["t", "n"]).dropDuplicates(["t", "n"])
    text_of = {(r.t, r.n): r.text for r in found.toLocalIterator()}
    # In the order of the hash, both labels mixed.
    return [(text_of[t, n], y) for _, y, _, t, n in sorted(drawn)]
