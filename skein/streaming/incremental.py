"""Indexing of session files as they arrive.  A file stream tells which files are new; each batch is one scan of these files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.api import SessionIndex

FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(index: SessionIndex, root: str, checkpoint: str, most_files: int = 1000) -> StreamingQuery:
    """Indexes the files under a root that came since the last run, then stops.

    A file stream does not tell of files that were rewritten: those are found by `SessionIndex.index`, which compares cursors.
    """

    def scan(batch: DataFrame, _: int) -> None:
        # At most `most_files` paths come to the driver, which opens the files by name.
        paths = [r.path for r in batch.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).collect()]
        if paths:
            index.index(paths=paths)

    stream = index.spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files)
    return stream.load(root).select("path").writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
