"""Page images: what a file is and how large, from its first bytes, and pages turned upright."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.sources.headers import HEAD, header, upright
from inkfold.sources.page_archives import located


def heads(files: DataFrame, path: str = "path", most: int = HEAD) -> DataFrame:
    """Adds head: the first bytes of each file; null if it can't be read. Nothing else of it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = []
            for uri in frame[path]:
                fs, at = located(uri)
                try:
                    with fs.open_input_file(at) as f:
                        read.append(f.read(most))
                except OSError:
                    read.append(None)
            yield frame.assign(head=read)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{kinds}, head binary")


def _headers(content: pd.Series) -> pd.DataFrame:
    found = [header(bytes(c)) if c is not None else None for c in content]
    size = [h.upright if h else (None, None) for h in found]
    ints = lambda values: pd.array(list(values), "Int32")
    return pd.DataFrame({"width": ints(s[0] for s in size), "height": ints(s[1] for s in size), "orientation": ints(h.orientation if h else None for h in found), "found_type": [h.type if h else None for h in found]})


def probed(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds width and height of the upright image, its orientation and found_type; null where it is no image that is known."""
    read = F.pandas_udf(_headers, "width int, height int, orientation int, found_type string")
    return files.withColumn("probe", read(content)).select("*", "probe.*").drop("probe")


def library(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(folder, name, size, modified, added, width, height) of the images below path; what can't be read drops out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    images = found.where(t.image_type(F.col("path")).isNotNull()).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = probed(heads(images), "head").where("width is not null")
    return out.select(F.lit(folder).cast("string").alias("folder"), t.base_name(F.col("path")).alias("name"), "size", "modified", F.current_timestamp().alias("added"), "width", "height")


def upright_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data): decoded pages as Spark's image source gives them (rows of BGR bytes), turned as their tags ask for.

    What can't be decoded drops out.
    """
    decoded = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    path = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))  # the image source escapes what its paths hold
    rows = heads(decoded.select(path.alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                found = header(row.head)
                if found and found.orientation > 1:
                    image = upright(np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels), found.orientation)
                    out.append((row.path, image.shape[1], image.shape[0], row.channels, image.tobytes()))
                else:
                    out.append((row.path, row.width, row.height, row.channels, row.data))
            yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "data"])

    return rows.mapInPandas(run, "path string, width int, height int, channels int, data binary")
