"""State that grows along a chapter: glossary, cast, story and chapter folds, each with its merge rule.

Every fold is also available over arrays (one step for a batch of news), so batch and streaming share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import text as t

GLOSSARY, CAST, BEATS = 40, 12, 400
PLACEHOLDERS = ("unknown", "unnamed", "none", "n/a", "?", "-", "—")


def first_wins(news: DataFrame, key: str, most: int = GLOSSARY) -> DataFrame:
    """Entries by first appearance, with their first values; none is taken once there are `most`."""
    own = Window.partitionBy("chapter", key).orderBy("seq")
    firsts = news.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("seq"))
    return firsts.withColumn("place", place).where(F.col("place") <= most)


def last_wins(news: DataFrame, key: str, values: list[str], most: int = GLOSSARY) -> DataFrame:
    """Entries in order of first appearance, with their last values; one refused while full never comes in."""
    last = F.max_by(F.struct(*values), "seq")
    merged = news.groupBy("chapter", key).agg(F.min("seq").alias("seq"), last.alias("v"))
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("seq"))
    return merged.withColumn("place", place).where(F.col("place") <= most).select("chapter", key, "seq", "place", *[f"v.{v}" for v in values])


def last_known(values: Column, order: Column, unknown: str) -> Column:
    """The last value that isn't unknown, else unknown."""
    return F.coalesce(F.max_by(values, F.when(values != unknown, order)), F.lit(unknown))


def cast_fold(news: DataFrame, most: int = CAST) -> DataFrame:
    """People by first appearance, `most` at most; gender and note are the last that said something."""
    seq = F.col("seq")
    people = news.groupBy("chapter", "name").agg(
        F.min("seq").alias("first_seq"),
        last_known(F.col("gender"), seq, "unknown").alias("gender"),
        last_known(F.col("note"), seq, "").alias("note"),
    )
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("first_seq"))
    return people.withColumn("place", place).where(F.col("place") <= most)


def merged_cast(held: Column, news: Column, most: int = CAST) -> Column:
    """held with news folded in, both array<struct<name, gender, note, settled>>.

    A settled fact stays; another is replaced unless the news is blank (`unknown` or ''); new people come
    last while there are fewer than `most`.
    """

    def merge(old: Column, new: Column) -> Column:
        keeps = lambda fact, blank: F.array_contains(old.settled, fact) | (new[fact] == blank)
        return F.struct(
            old["name"].alias("name"),
            F.when(keeps("gender", "unknown"), old.gender).otherwise(new.gender).alias("gender"),
            F.when(keeps("note", ""), old.note).otherwise(new.note).alias("note"),
            old.settled.alias("settled"),
        )

    def step(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda a: a["name"] == x["name"])
        return F.when(known, F.transform(acc, lambda a: F.when(a["name"] == x["name"], merge(a, x)).otherwise(a))).when(F.size(acc) < most, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(news, held, step)


def merged_story(held: Column, news: Column) -> Column:
    """Scene and cast: a blank scene keeps the held one."""
    scene = F.when(t.blank(news.scene), held.scene).otherwise(news.scene)
    return F.struct(scene.alias("scene"), merged_cast(held["cast"], news["cast"]).alias("cast"))


def folded_beats(held: Column, news: Column, first: Column) -> Column:
    """Beats with `news` written from `first` on; a gap before it is filled with blanks."""
    gap = F.array_repeat(F.lit(""), F.greatest(first - F.size(held), F.lit(0)).cast("int"))
    padded = F.concat(held, gap)
    before = F.slice(padded, F.lit(1), first)
    after = F.slice(padded, first + F.size(news) + 1, F.greatest(F.size(padded) - first - F.size(news), F.lit(0)))
    return F.concat(before, news, after)


def unless_blank(new: Column, held: Column) -> Column:
    return F.when(t.blank(new), held).otherwise(new)


def corrected(people: DataFrame, edits: DataFrame) -> DataFrame:
    """Facts set by hand: the last edit of a name and fact holds and is settled; a cleared one isn't.

    people: chapter, name, gender, note, settled. edits: chapter, name, fact, value, seq.
    """
    last = edits.groupBy("chapter", "name").pivot("fact", ["gender", "note"]).agg(F.max_by("value", "seq"))
    last = last.select("chapter", "name", F.col("gender").alias("set_gender"), F.col("note").alias("set_note"))
    both = people.join(last, ["chapter", "name"], "left")
    for fact, blank in (("gender", "unknown"), ("note", "")):
        value = F.col(f"set_{fact}")
        others = F.array_remove("settled", fact)
        both = both.withColumn("settled", F.when(value.isNull(), F.col("settled")).when(value == blank, others).otherwise(F.array_union(others, F.array(F.lit(fact)))))
        both = both.withColumn(fact, F.coalesce(value, fact))
    return both.select(people.columns)


#: The facts of a person and what each says if it says nothing.
FACTS = {"gender": "unknown", "note": ""}


def as_events(news: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """News (chapter, seq, name, gender, note) and edits (chapter, seq, name, fact, value) as one relation, batch or stream."""
    told = news.select("chapter", "seq", "name", "gender", "note", F.lit(None).cast("string").alias("fact"), F.lit(None).cast("string").alias("value"))
    if edits is None:
        return told
    none = F.lit(None).cast("string")
    return told.unionByName(edits.select("chapter", "seq", "name", none.alias("gender"), none.alias("note"), "fact", "value"))


def facts(events: DataFrame) -> DataFrame:
    """What has to be kept of each chapter and name, as an aggregate that doesn't depend on the order of arrival.

    That is where the name came first, and of each fact the last news that said something and the last edit.
    Blank names are nobody's. Equal sequence numbers: an edit comes after news, else the greater value.
    """
    by_hand = F.col("fact").isNotNull()
    last = lambda value, when: F.max(F.when(when, F.struct(F.col("seq").alias("seq"), value.alias("value"))))
    kept = [F.min("seq").alias("first_seq")]
    for fact, nothing in FACTS.items():
        said = F.coalesce(fact, F.lit(nothing))
        kept += [last(said, ~by_hand & (said != nothing)).alias(f"{fact}_said"), last(F.coalesce("value", F.lit("")), F.col("fact") == fact).alias(f"{fact}_set")]
    return events.where(~t.blank(F.col("name"))).groupBy("chapter", "name").agg(*kept)


def settled_cast(kept: DataFrame, most: int = CAST) -> DataFrame:
    """The cast that a fold of all events in order gives: chapter, name, gender, note, settled, place.

    People come by their first event, told or set by hand, `most` at most. An edit settles its fact: no news overwrites
    it. A blank edit (`unknown` for a gender) clears the fact and unsettles it, so later news counts again.
    """
    values, settled = [], []
    for fact, nothing in FACTS.items():
        said, edit = F.col(f"{fact}_said"), F.col(f"{fact}_set")
        cleared = t.blank(edit.value) | (edit.value == nothing)
        values.append(F.when(edit.isNotNull() & ~cleared, edit.value).when(edit.isNull() | (said.seq > edit.seq), F.coalesce(said.value, F.lit(nothing))).otherwise(nothing).alias(fact))
        settled.append(F.when(edit.isNotNull() & ~cleared, fact))
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("first_seq", "name"))
    people = kept.select("chapter", "name", *values, F.array_compact(F.array(*settled)).alias("settled"), place.alias("place"))
    return people.where(F.col("place") <= most)


def still_unknown(people: DataFrame, most: int = CAST) -> DataFrame:
    """`Still unknown: a, b.` for the first `most` people without a gender; nothing if there are none."""
    open_ = (F.col("gender") == "unknown") & (F.col("place") <= most) & ~t.blank(F.col("name"))
    names = F.transform(F.array_sort(F.collect_list(F.when(open_, F.struct("place", "name")))), lambda x: x["name"])
    question = F.when(F.size(names) > 0, F.concat(F.lit("Still unknown: "), F.array_join(names, ", "), F.lit("."))).otherwise("")
    return people.groupBy("chapter").agg(question.alias("question"))
