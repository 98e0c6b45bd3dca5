"""Libraries of pages in folders: ingest, names, counts, exports and deletes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import text as t


def fingerprint(folder: str, name: str, size: str, modified: str) -> Column:
    return F.concat_ws(":", F.coalesce(folder, F.lit("")), name, F.col(size).cast("string"), F.col(modified).cast("string"))


def fresh(incoming: DataFrame, library: DataFrame, order: str, key: str = "fingerprint") -> DataFrame:
    """What isn't in the library yet; of equal newcomers the first."""
    first = Window.partitionBy(key).orderBy(order)
    return incoming.join(library.select(key), key, "left_anti").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def accounting(incoming: DataFrame, library: DataFrame, order: str, key: str = "fingerprint") -> DataFrame:
    """How many of the incoming files are fresh, known already, repeated or no images, by folder."""
    known = library.select(key, F.lit(True).alias("known")).distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    state = F.when(~F.col("is_image"), "rejected").when(F.col("known"), "duplicate").when(F.col("nth") > 1, "duplicate").otherwise("fresh")
    return incoming.withColumn("nth", nth).join(known, key, "left").groupBy("folder", state.alias("state")).agg(F.count("*").alias("n"))


def folders_for(archives: DataFrame, folders: DataFrame, fresh_pages: DataFrame) -> DataFrame:
    """The folder of each archive name that brought a fresh page: the held one, or a new one; it takes the archive's name if it had none."""
    gained = archives.join(fresh_pages.select("folder").distinct(), archives["name"] == F.col("folder"), "left_semi")
    held = folders.select(F.col("name"), F.col("id").alias("held_id"), F.col("archive").alias("held_archive"))
    return gained.join(held, "name", "left").select(
        "name", F.coalesce("held_id", F.concat(F.lit("new:"), F.col("name"))).alias("id"), F.coalesce("held_archive", "archive").alias("archive"), F.col("held_id").isNull().alias("is_new")
    )


def in_natural_order(files: DataFrame, group: str, path: str, *then: str) -> DataFrame:
    """Adds place, from 0: digits by value, letters without case or accents, then the path itself and the further columns."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(t.natural_key(F.col(path)), path, *then)) - 1)


def unique_names(files: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Adds unique_name: the first keeps its name, later ones get ` (n)` before the extension, from 2, past names that are taken.

    Only names of one family (alike but for such numbers) can clash. A family of one name is numbered by a
    window; one with several, such as `a.png` and `a (2).png`, is streamed in order past the names that it has taken,
    each name with the number that it tries next, so no number is tried twice for it.
    """
    ending = lambda x: F.regexp_extract(x, r"\.[^.]+$", 0)
    numbered = lambda x, n: F.concat(t.stem(x), F.lit(" ("), n.cast("string"), F.lit(")"), ending(x))
    family = Window.partitionBy(folder, "family")
    rows = files.select(folder, order, name, F.concat(F.regexp_replace(t.stem(F.col(name)), r"( \(\d+\))+$", ""), ending(F.col(name))).alias("family"))
    rows = rows.withColumn("mixed", F.min(name).over(family) != F.max(name).over(family)).withColumn("nth", F.row_number().over(family.orderBy(order)))
    alone = rows.where("not mixed").withColumn("unique_name", F.when(F.col("nth") == 1, F.col(name)).otherwise(numbered(F.col(name), F.col("nth"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, taken, tries = None, set(), {}
        for frame in frames:
            out = []
            for place, kin, wanted in zip(frame[folder], frame["family"], frame[name]):
                if (place, kin) != own:
                    own, taken, tries = (place, kin), set(), {}
                got = wanted
                while got in taken:
                    n = tries[wanted] = tries.get(wanted, 1) + 1
                    got = re.sub(r"^(.*?)(\.[^.]+)?$", lambda m: f"{m[1]} ({n}){m[2] or ''}", wanted, count=1, flags=re.S)
                taken.add(got)
                out.append(got)
            yield frame[[folder, order, name]].assign(unique_name=out)

    mixed = rows.where("mixed").select(folder, order, name, "family").repartition(folder, "family").sortWithinPartitions(folder, "family", order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(folder, order, name).schema)
    return alone.select(folder, order, name, "unique_name").unionByName(mixed.mapInPandas(run, f"{kinds}, unique_name string"))


def best_pages(pages: DataFrame) -> DataFrame:
    """The furthest stage of each page: lettered, cleaned or the original; the name is a PNG's unless original."""
    reached = F.when(F.col("lettered").isNotNull(), "lettered").when(F.col("cleaned").isNotNull(), "cleaned").otherwise("original")
    name = F.when(reached == "original", F.col("name")).otherwise(F.concat(t.stem(F.col("name")), F.lit(".png")))
    return pages.select("folder", "page_no", name.alias("name"), F.coalesce("lettered", "cleaned", "original").alias("data"), reached.alias("reached"))


def archive_names(pages: DataFrame, folders: DataFrame, target: str) -> DataFrame:
    """`folder-target.zip`, or `folder-cleaned.zip` if no page is lettered; .cbz if it came from one."""
    lettered = pages.groupBy("folder").agg(F.bool_or(F.col("reached") == "lettered").alias("lettered"))
    ending = F.when(F.coalesce("archive", F.lit("")).rlike(r"(?i)\.cbz$"), "cbz").otherwise("zip")
    tag = F.when(F.col("lettered"), t.slug(F.lit(target))).otherwise("cleaned")
    return folders.join(lettered, folders["name"] == lettered["folder"]).select("name", F.concat("name", F.lit("-"), tag, F.lit("."), ending).alias("file"))


def folder_summary(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages, bytes and share done of each folder."""
    d = done.select("page_id", F.lit(1).alias("done")).distinct()
    return pages.join(d, "page_id", "left").groupBy("folder").agg(
        F.count("*").alias("pages"), F.sum("size").alias("bytes"), F.count("done").alias("done"), F.coalesce(F.try_divide(F.count("done"), F.count("*")), F.lit(0.0)).alias("share")
    )


def view(pages: DataFrame, open_folder: str | None) -> DataFrame:
    """The pages of the open folder; at the root, those in no folder."""
    return pages.where(F.col("folder").eqNullSafe(F.lit(open_folder)))


def without_pages(tables: dict[str, DataFrame], gone: DataFrame, key: str = "page_id") -> dict[str, DataFrame]:
    """Every table without the rows of pages that are deleted."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def mask_key(page: str, spread: str) -> Column:
    """The key of a letter mask that is kept: `page@spread`."""
    return F.concat_ws("@", F.col(page).cast("string"), F.col(spread).cast("string"))


def without_masks(masks: DataFrame, gone: DataFrame, page: str = "page_id", key: str = "key") -> DataFrame:
    """Kept masks without those of the pages that changed or went, whatever their spread."""
    own = F.regexp_extract(key, "^(.*)@[^@]*$", 1)
    gone = gone.select(F.col(page).cast("string").alias("gone_page")).distinct()
    return masks.join(gone, own == F.col("gone_page"), "left_anti")


def without_empty_folders(folders: DataFrame, pages: DataFrame) -> DataFrame:
    """Folders that have a page left, or were made by hand."""
    held = folders.join(pages.select(F.col("folder").alias("name")).distinct(), "name", "left_semi")
    return held.unionByName(folders.where("manual").join(held.select("name"), "name", "left_anti"))
