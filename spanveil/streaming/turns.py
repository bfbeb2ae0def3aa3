"""De-identification of whole conversations that arrive as a stream, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources import loaders


def deidentify_stream(engine: Engine, raw: DataFrame, target: str, checkpoint: str, fmt: str = "auto", **trigger) -> StreamingQuery:
    """Writes the results of a stream of texts (conv_id, value) to Parquet at ``target``; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        turns = loaders.load_texts(batch, fmt)
        engine.deidentify(turns).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
