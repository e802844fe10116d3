"""Validation of streams. A document's verdict needs no state, so the same columns serve; rows that fail go elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from skein.operators.validator import Validator


def validate_stream(stream: DataFrame, validator: Validator, column: str = "value") -> DataFrame:
    return validator.validate(stream, column)


def route(stream: DataFrame, validator: Validator, valid_path: str, rejected_path: str, checkpoint: str, column: str = "value", fmt: str = "parquet") -> DataStreamWriter:
    """A writer that appends valid rows to one place and the others, with their errors, to another. Each batch goes to
    folders named by its number, which a repeated batch overwrites, so that every row arrives exactly once. A batch is
    read and checked once and kept for both writes."""

    def write(batch: DataFrame, number: int) -> None:
        marked = validator.marked(batch, column).persist()
        try:
            good, bad = validator.halves(marked, column)
            good.write.mode("overwrite").format(fmt).save(f"{valid_path}/batch={number}")
            bad.write.mode("overwrite").format(fmt).save(f"{rejected_path}/batch={number}")
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
