"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.functions.lambdas import quoted
from relflow.sources.scratch import written

#: Rows of each label that a fit may see, and the bytes of text that they may have on average.
PER_LABEL, ROW_BYTES = 1_500, 60_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text leaves 1 on division by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> tuple[list[bytes], list[int]]:
    """Texts and 0/1 labels of rows that are not held out: the first by hash, ``per_label`` of each label.

    Null ids, labels and texts don't count, nor do ids without a document.  A label's
    texts come to per_label * ROW_BYTES at most: one that would pass this is left out,
    and the next one takes its place.  Ids are broadcast: 2 * per_label at most.
    """
    t = F.col(quoted(text)).cast("string")
    usable = docs.where(t.isNotNull()).select(F.col(quoted(doc_id)).alias("id"), F.octet_length(t).cast("bigint").alias("size"))
    rows = labels.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).cast("int").alias("y"))
    rows = rows.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    sized = written(rows.distinct().join(usable, "id").groupBy("id", "y").agg(F.max("size").alias("size")), "labelled")
    picked: dict = {}
    for y in (0, 1):
        # the budget skips few rows, so twice as many are enough unless texts are very long
        left, ahead = per_label * ROW_BYTES, sized.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id")
        fits = ahead.where(F.col("size") <= left).limit(2 * per_label).collect()
        n = 0
        for r in fits:
            if n < per_label and r["size"] <= left:
                picked.setdefault(r["id"], y)
                left, n = left - r["size"], n + 1
    ids = docs.sparkSession.createDataFrame(list(picked.items()), sized.select("id", "y").schema)
    texts = docs.where(t.isNotNull()).select(F.col(quoted(doc_id)).alias("id"), t.cast("binary").alias("t"))
    found = texts.join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(2 * per_label).select("t", "y").collect()
    return [bytes(r["t"]) for r in found], [r["y"] for r in found]
