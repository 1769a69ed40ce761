"""A folder of arriving archives as a stream: each becomes a version, in order of arrival."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..sources.archives import import_and_file


_log = logging.getLogger(__name__)


def watch(store: Store, folder: str, checkpoint: str, interval: str = "10 seconds", once: bool = False, max_files: int = 1) -> StreamingQuery:
    """Import every archive put into ``folder/incoming``.

    The stream's checkpoint remembers what was taken, so a restart skips nothing; a batch that runs again after a crash
    finds each archive that became a version in its manifest, or filed already, and does not import it twice.  A failed
    one is filed under ``failed`` and the stream goes on; the reason goes to the log.  Only paths pass through the
    stream, the archives are read by the import.  ``once`` takes what is there and stops.
    """
    folder = folder.rstrip("/")
    stream = store.spark.readStream.format("binaryFile").option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", max_files).option("latestFirst", "false").schema("path string, modificationTime timestamp, length long, content binary").load(f"{folder}/incoming")

    def take(batch: DataFrame, _: int) -> None:
        for row in batch.select("path", "modificationTime").orderBy("modificationTime", "path").collect():
            try:
                import_and_file(store, row["path"], folder)
            except Exception as e:  # filed under failed/; one bad archive does not stop the others
                _log.warning("import of %s failed: %s", row["path"], e)

    writer = stream.select("path", "modificationTime").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
