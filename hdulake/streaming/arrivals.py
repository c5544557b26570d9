"""Files as they arrive in a folder: a row for each HDU of each new file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.sources.readers import CATALOG, CatalogSource

_FIELDS = pa.schema([("path", pa.string()), ("hdu", pa.int32()), ("kind", pa.string()), ("extname", pa.string()), ("extver", pa.int64()), ("naxis", pa.int32()), ("axes", pa.list_(pa.int64())), ("bitpix", pa.int32()), ("header_offset", pa.int64()), ("data_offset", pa.int64()), ("data_bytes", pa.int64())])


def stream_catalog(spark: SparkSession, folder: str, pattern: str = "*.fits", files_at_a_time: int = 1000) -> DataFrame:
    """A stream with the rows of ``hdu_catalog`` for files that come into the folder. Only their headers are read."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_a_time)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path in batch["path"].to_pylist() for r in CatalogSource.rows(path.replace("file:///", "/").removeprefix("file:"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FIELDS)], schema=_FIELDS)

    return source.load(folder).select(F.col("path")).mapInArrow(run, CATALOG)
