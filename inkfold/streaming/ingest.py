"""Files that come into a library as a stream: opened, told apart from what is known, and counted.

An incoming file is `fresh`, `duplicate` (its fingerprint is in the library, or came before), `rejected` (no image),
`broken` (an image whose header can't be read), or, for archives, `unopenable` or `hollow` (without pages). Only
fingerprints are held as state, one small value each, for `hold` after they were first seen; a file that
comes again later than that counts as fresh. Of equal newcomers in one batch the first in order is fresh.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from inkfold.operators.gallery import fingerprint
from inkfold.sources.headers import HEAD, header
from inkfold.sources.page_archives import NO_PAGES, ArchiveReader, Runs, located, type_of

FILES = "folder string, name string, size long, modified timestamp, is_image boolean, width int, height int, state string"


HELD = "held"


def _probed(head: bytes | None, is_image: bool) -> tuple[int | None, int | None, str | None]:
    """Upright width and height, and the state that this settles already."""
    if not is_image:
        return None, None, "rejected"
    found = header(head)
    return (*found.upright, None) if found else (None, None, "broken")


def opened(found: DataFrame, folder: str | None = None) -> DataFrame:
    """The pages of dropped files: FILES, where state is null for images that can be read.

    found: path, modificationTime and length, a batch or a stream, as Spark's binaryFile source gives them; contents
    aren't taken from it. Archives are read entry by entry and put into a folder of their name, and have a row
    with the reason if they can't be opened or hold no page; other files go into `folder`. Only first bytes
    are read of images.
    """
    fields = StructType([StructField(c, StringType()) for c in ("archive", "path", "size", "why", "head")])

    def rows(path: str, modified: object, size: int) -> Iterator[tuple]:
        name = path.rpartition("/")[2]
        fs, at = located(path)
        if re.search(r"\.(zip|cbz)$", name, re.I):
            own = re.sub(r"\.[^.]+$", "", name)
            for _, inside, length, why, head in ArchiveReader({"path": path}, fields).read(Runs([(at, 0, None)])):
                if inside is None:
                    yield own, name, size, modified, False, None, None, "hollow" if why == NO_PAGES else "unopenable"
                else:
                    yield own, inside.rpartition("/")[2], length, modified, True, *_probed(head, True)
            return
        is_image = type_of(name) is not None
        head = None
        if is_image:
            try:
                with fs.open_input_file(at) as file:
                    head = file.read(HEAD)
            except OSError:
                pass
        yield folder, name, size, modified, is_image, *_probed(head, is_image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for path, modified, size in zip(*(batch.column(c).to_pylist() for c in ("path", "modified", "size"))):
                out = list(rows(path, modified, size))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in FILES.split(", ")])

    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).mapInArrow(run, FILES)


class FirstSeen(StatefulProcessor):
    """Of each fingerprint, the first file is fresh; the others are duplicates, as long as the state is held."""

    def __init__(self, order: str, hold_ms: int):
        self.order, self.hold_ms = order, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", self.hold_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # the state is asked and told once: each of these is a way to the JVM and back
        files = list(rows)
        seen = self.seen.exists()
        if not seen:
            self.seen.update((True,))
        known = seen or any(f["state"] == HELD for f in files)
        for i, f in enumerate(sorted((f for f in files if f["state"] != HELD), key=lambda f: (f[self.order] is None, f[self.order]))):
            yield Row(**(f.asDict() | {"state": "duplicate" if known or i else "fresh"}))

    def close(self) -> None:
        pass


def with_fingerprint(files: DataFrame) -> DataFrame:
    """Files as `opened` gives them, with their fingerprint."""
    return files.withColumn("fingerprint", fingerprint("folder", "name", "size", "modified"))


def told_apart(incoming: DataFrame, library: DataFrame, order: str, hold_ms: int) -> DataFrame:
    """incoming (a stream with fingerprint, folder, state) with every state filled in; states that are there stay.

    library: a stream of the fingerprints that the library has. It goes into the same state as what comes in, each of
    its rows once, and comes first within a batch.
    """
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in incoming.schema if f.name not in ("fingerprint", "state")]
    held = library.select("fingerprint", F.lit(HELD).alias("state"), *blank).select(incoming.columns)
    every = incoming.where("state is null").unionByName(held)
    judged = every.groupBy("fingerprint").transformWithState(FirstSeen(order, hold_ms), incoming.schema, "Append", "ProcessingTime")
    return judged.unionByName(incoming.where("state is not null"))


def write(judged: DataFrame, folder: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Starts writing below `folder`; a batch that is run again after a crash overwrites what it wrote before.

    It runs until it is stopped: states that expire by the clock give a batch at each trigger, also without files.
    """

    def put(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        if not held.isEmpty():
            held.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        held.unpersist()

    return judged.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(put).start()


def drain(query: StreamingQuery, pause: float = 0.2) -> None:
    """Waits for a batch that found nothing new and stops the query; what stopped it before that is raised.

    The first batch after a restart may be one that was cut short, with the files of then, so it doesn't count.
    """
    first = None
    while query.isActive:
        now = query.lastProgress
        if now is not None:
            first = now["batchId"] if first is None else first
            if now["batchId"] > first and now["numInputRows"] == 0:
                break
        time.sleep(pause)
    query.stop()
    if query.exception():
        raise query.exception()


def counted(written: DataFrame) -> DataFrame:
    """folder, state and how many files."""
    return written.groupBy("folder", "state").agg(F.count("*").alias("n"))
