"""Merges of new rows into a table that is rewritten: insert, update, fill, replace and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import keep


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], seq: str, source_id: str) -> DataFrame:
    """`old` and those of `new` whose keys it lacks; of rows with the same keys the first; rows with an empty id always."""
    anonymous = F.col(source_id) == ""
    named = keep.first(new.where(~anonymous), keys, seq)
    added = named.join(old.select(*keys), keys, "left_anti").unionByName(new.where(anonymous).select(*named.columns))
    return old.unionByName(added.select(*old.columns))


def actions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(action, n): what a merge would create and update, without writing."""
    known = old.select(*keys, F.lit(True).alias("_known")).distinct()
    found = new.join(known, keys, "left")
    return found.groupBy(F.when(F.col("_known"), "updated").otherwise("created").alias("action")).agg(F.count("*").alias("n"))


def update_fields(old: DataFrame, new: DataFrame, keys: list[str], seq: str, overwrite: list[str], fill: list[str], largest: list[str]) -> DataFrame:
    """Rows of `old` with what `new` says of them: these columns overwritten, those if not empty, counts raised. The last new row decides."""
    latest = keep.last(new, keys, seq)
    side = latest.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*overwrite, *fill, *largest)], F.lit(True).alias("_new"))
    joined = old.join(side, keys, "left")

    def value(c: str) -> Column:
        new_value = F.col(f"_{c}")
        if c in overwrite:
            return F.when(F.col("_new"), new_value).otherwise(F.col(c))
        if c in fill:
            return F.coalesce(F.nullif(new_value, F.lit("")), F.col(c))
        return F.greatest(F.col(c), F.coalesce(new_value, F.col(c))) if c in largest else F.col(c)

    return joined.select(*[value(c).alias(c) if c not in keys else F.col(c) for c in old.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """New rows win; of new rows with the same keys the last."""
    latest = keep.last(new, keys, seq).select(*old.columns)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def reimport(old: DataFrame, new: DataFrame, source: str, seq: str, preserve: bool = False, overwrite: tuple = (), fill: tuple = (), largest: tuple = ()) -> DataFrame:
    """`new` rows of a source in place of those of `old`; with `preserve` old rows stay and take only these columns from new ones with their source_id."""
    keys = ["source", "source_id"]
    if not preserve:
        return insert_absent(old.where(~F.col("source").eqNullSafe(F.lit(source))), new, keys, seq, "source_id")
    return insert_absent(update_fields(old, new.where("source_id <> ''"), keys, seq, list(overwrite), list(fill), list(largest)), new, keys, seq, "source_id")


def fill_empty(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    side = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(side, keys, "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that `new` has are replaced by its rows; others stay, those of parents without new children too."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


def delete_parents(children: DataFrame, gone: DataFrame, parent: str) -> DataFrame:
    """What a cascading delete leaves of the children."""
    return children.join(gone.select(parent).distinct(), parent, "left_anti")


def write_swap(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a new version beside what may be read just now; readers switch by path."""
    writer = df.write.mode("error")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
