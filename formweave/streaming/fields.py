"""Field values over a stream of documents: the batch extraction applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from formweave.operators import fields, lines


def write_fields(docs: DataFrame, dictionary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stores (doc_id, keyword, value) of each arriving document; a document arrives whole, so no state is kept.

    Each micro-batch has its own folder, which a repeated attempt writes anew, so that no value is stored twice.
    """

    def batch(part: DataFrame, number: int) -> None:
        fields.merge(fields.from_lines(lines.explode_lines(part), dictionary)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
