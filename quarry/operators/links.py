"""Many-to-many links and nested reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_links(links: DataFrame, targets: DataFrame, target: str, key: str) -> DataFrame:
    """Links whose target row is among the readable ``targets``."""
    return links.join(targets.select(F.col(key).alias(target)), target, "left_semi")


def link_arrays(owners: DataFrame, links: DataFrame, key: str, owner: str, target: str, name: str) -> DataFrame:
    """``owners`` with the ordered array of link targets; null where there is none. One row's array must fit into a task."""
    arrays = links.groupBy(F.col(owner).alias(key)).agg(F.array_sort(F.collect_list(F.struct("idx", target))).alias("_l"))
    return owners.join(arrays, key, "left").withColumn(name, F.col(f"_l.{target}")).drop("_l")


@dataclass(frozen=True)
class Links:
    """The link rows behind a multiRelation field: their owner and target columns. Scope them first by :func:`visible_links`."""

    rows: DataFrame
    owner: str
    target: str


LINK_OPERATORS = ("contains", "in", "eq", "ne")


def linked_to(owners: DataFrame, links: DataFrame, key: str, owner: str, target: str, op: str, values: list) -> DataFrame:
    """Owners by their link targets: ``contains`` all, ``in`` any, ``eq`` exactly, ``ne`` not exactly these values; other operators do not restrict."""
    wanted = list(dict.fromkeys(values))
    if op not in LINK_OPERATORS or op == "contains" and not wanted:
        return owners
    if op == "in":
        return owners.join(links.where(F.col(target).isin(wanted)).select(F.col(owner).alias(key)), key, "left_semi") if wanted else owners.where(F.lit(False))
    counted = _counted(links, key, owner, target, wanted)
    if op == "contains":
        return owners.join(counted.where(F.col("_hit") == len(wanted)).select(key), key, "left_semi")
    same = counted.where((F.col("_all") == len(wanted)) & (F.col("_hit") == len(wanted))).select(key)
    if op == "eq":
        return owners.join(same, key, "left_semi") if wanted else owners.join(counted.select(key), key, "left_anti")
    return owners.join(same, key, "left_anti") if wanted else owners.join(counted.select(key), key, "left_semi")


def _counted(links: DataFrame, key: str, owner: str, target: str, wanted: list) -> DataFrame:
    hit = F.count_distinct(F.when(F.col(target).isin(wanted), F.col(target))) if wanted else F.lit(0)
    return links.groupBy(F.col(owner).alias(key)).agg(F.count_distinct(target).alias("_all"), hit.alias("_hit"))


def link_marks(owners: DataFrame, links: Links, key: str, name: str, op: str, values: list) -> DataFrame:
    """``owners`` with a boolean column: whether :func:`linked_to` would keep them. For conditions inside an ``$or``."""
    wanted = list(dict.fromkeys(values))
    joined = owners.join(_counted(links.rows, key, links.owner, links.target, wanted), key, "left")
    every, hit = F.coalesce("_all", F.lit(0)), F.coalesce("_hit", F.lit(0))
    same = (every == len(wanted)) & (hit == len(wanted))
    mark = {"contains": hit == len(wanted), "in": hit > 0, "eq": same, "ne": ~same}[op]
    return joined.withColumn(name, mark).drop("_all", "_hit")


def write_links(values: DataFrame, owner: str, array: str, target: str) -> DataFrame:
    """(owner, target, idx): an array field as link rows, the first of equal targets kept, idx in order from 0."""
    rows = values.select(owner, F.posexplode(F.array_distinct(F.col(array))).alias("idx", target)).where(F.col(target).isNotNull())
    return rows.select(owner, target, (F.row_number().over(Window.partitionBy(owner).orderBy("idx")) - 1).alias("idx"))


def expand_relation(df: DataFrame, fk: str, targets: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """``df`` with a struct of the related row; null where it is missing or hidden."""
    side = targets.select(F.col(key).alias(fk), F.struct(*columns).alias(name))
    return df.join(side, fk, "left")


def expand_details(parents: DataFrame, children: DataFrame, parent_id: Column, columns: list[str], name: str) -> DataFrame:
    """``parents`` with the array of child structs in parent_idx order; empty where there is none. One row's array must fit into a task."""
    grouped = children.groupBy(F.col("parent_id").alias("_pid")).agg(F.array_sort(F.collect_list(F.struct("parent_idx", *columns))).alias(name))
    joined = parents.withColumn("_pid", parent_id).join(grouped, "_pid", "left").drop("_pid")
    empty = F.array().cast(joined.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(name, empty))


def expand_links(owners: DataFrame, links: DataFrame, targets: DataFrame, key: str, owner: str, target: str, target_key: str, columns: list[str], name: str) -> DataFrame:
    """``owners`` with the array of linked rows' structs in link order; missing or hidden ones left out. One row's array must fit into a task."""
    found = links.join(targets.select(F.col(target_key).alias(target), *columns), target)
    arrays = found.groupBy(F.col(owner).alias(key)).agg(F.array_sort(F.collect_list(F.struct("idx", *columns))).alias(name))
    return owners.join(arrays, key, "left")
