"""A saved mapping on a stream: the batch projection, unchanged and stateless."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.transform import apply_mapping


def map_stream(stream: DataFrame, mapping: Mapping[str, object], template: DataFrame | T.StructType, **options) -> DataFrame:
    """The mapped stream. Rows are independent, so append mode needs no watermark or state."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return apply_mapping(stream, mapping, template, **options)


def write_mapped_stream(
    mapped: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
) -> StreamingQuery:
    """Append the mapped stream to files, exactly once per checkpoint."""
    writer = mapped.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
