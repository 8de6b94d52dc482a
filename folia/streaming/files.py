"""A stream of print files: a folder watched for new ones, each framed by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.sources import afp


def stream_fields(spark: SparkSession, folder: str, glob: str = "*.afp", files_per_trigger: int = 1000) -> DataFrame:
    """Framed fields and errors of files as they come."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    return afp.frame(files.filter(F.col("length") <= afp.MOST_BYTES).select("path", "content"))
