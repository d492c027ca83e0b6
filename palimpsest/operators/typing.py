"""Item types: the subtype closure, families of items that share an id, class bounds of lifecycles, conflicts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import at_or_before


def closure_rows(parents: dict[str, str | None]) -> list[tuple[str, str, int, int]]:
    """(sub, super, distance, depth of super) of a type hierarchy, each type being its own subtype."""
    out = []
    chain = lambda t: [t, *chain(parents[t])] if t is not None else []
    for t in parents:
        up = chain(t)
        out += [(t, s, i, len(up) - 1 - i) for i, s in enumerate(up)]
    return out


def type_closure(spark: SparkSession, parents: dict[str, str | None]) -> DataFrame:
    """As a table; its size is that of the declared types, so joins with it are broadcast and its rows are read without a job."""
    kinds = pa.schema([("sub", pa.string()), ("super", pa.string()), ("distance", pa.int32()), ("depth", pa.int32())])
    rows = [dict(zip(kinds.names, r, strict=True)) for r in closure_rows(parents)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=kinds))


def of_type(items: DataFrame, closure: DataFrame, wanted: str, column: str = "item_class") -> DataFrame:
    """Items whose class is `wanted` or a subtype."""
    subs = closure.filter(F.col("super") == wanted).select(F.col("sub").alias(column))
    return items.join(F.broadcast(subs), column, "left_semi").select(*items.columns)


def _supers(closure: DataFrame) -> Column:
    """A map from each declared class to its superclasses and itself, the topmost first."""
    rows = sorted(closure.collect(), key=lambda r: r["depth"])
    pairs = [(F.lit(c), F.array(*[F.lit(r["super"]) for r in rows if r["sub"] == c])) for c in sorted({r["sub"] for r in rows})]
    return F.create_map(*[x for pair in pairs for x in pair]).cast("map<string,array<string>>")


def _ranks(closure: DataFrame, column: str = "item_class") -> tuple[Column, Column]:
    """A declared class's place in the order of depth, then name (null of any other), and the classes in that order.

    A number is folded by a hash aggregate, a name would be sorted.
    """
    names = [r["sub"] for r in sorted(closure.collect(), key=lambda r: (r["depth"], r["sub"])) if r["distance"] == 0]
    places = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)]).cast("map<string,int>")
    return places[F.col(column)], F.array(*[F.lit(c) for c in names]).cast("array<string>")


def with_family(in_force: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows with `family`: the topmost class above item_class that events of the id use.

    Classes on one branch share a family and so an item; types on different branches that share an id are different items. An
    annihilation is repeated for each family of the id that its class is compatible with; rows without a family go.
    The rows meet by item_id alone, which windows and groups by (item_id, family) then find done.
    """
    supers, end = _supers(closure), F.col("kind") == "annihilation"
    top = lambda c: F.get(F.filter(supers[c], lambda up: F.array_contains("_used", up)), 0)
    akin = lambda f: F.array_contains(supers[F.col("item_class")], f) | F.array_contains(supers[f], F.col("item_class"))
    used = F.collect_set(F.when(~end, F.col("item_class"))).over(W.partitionBy("item_id"))
    all_tops = F.filter(F.array_distinct(F.transform("_used", top)), akin)
    mine = F.when(end, all_tops).otherwise(F.array(top(F.col("item_class"))))
    rows = in_force.withColumn("_used", used).withColumn("family", F.explode(mine))
    return rows.filter("family is not null").select(*in_force.columns, "family")


def bounds(numbered: DataFrame, closure: DataFrame, item: tuple[str, ...] = ("item_id", "family")) -> DataFrame:
    """(item, lifecycle, lower_class, upper_class): the most and the least derived class that a lifecycle uses."""
    rank, names = _ranks(closure)
    rows = numbered.withColumn("_rank", rank).filter("_rank is not null")
    out = rows.groupBy(*item, "lifecycle").agg(F.max("_rank").alias("_lower"), F.min("_rank").alias("_upper"))
    return out.select(*item, "lifecycle", F.get(names, "_lower").alias("lower_class"), F.get(names, "_upper").alias("upper_class"))


def alive_items(numbered: DataFrame, closure: DataFrame, when, item: tuple[str, ...] = ("item_id", "family"), inclusive: bool = True) -> DataFrame:
    """(item, lifecycle, item_class) of the items alive at `when`, each with its lifecycle's most derived class, in one aggregation.

    A lifecycle is alive when one of its events has come and its annihilation, which is numbered with it, has not: the first event of
    every run is its anchor, so the earliest event brings the first update.
    """
    rank, names = _ranks(closure)
    here = at_or_before(F.col("when_rank"), F.col("when_ts"), when, inclusive)
    end = F.col("kind") == "annihilation"
    seen = [F.max("_rank").alias("_lower"), F.max(F.when(here & ~end, 1)).alias("_begun"), F.max(F.when(here & end, 1)).alias("_gone")]
    out = numbered.withColumn("_rank", rank).groupBy(*item, "lifecycle").agg(*seen).filter("_begun = 1 and _gone is null and _lower is not null")
    return out.select(*item, "lifecycle", F.get(names, "_lower").alias("item_class"))


def inconsistent(numbered: DataFrame, closure: DataFrame, item: tuple[str, ...] = ("item_id", "family")) -> DataFrame:
    """(item, lifecycle, item_class, lower_class): uses whose class is not above their lifecycle's most derived one."""
    low = bounds(numbered, closure, item).select(*item, "lifecycle", "lower_class")
    used = numbered.filter("kind <> 'annihilation'").select(*item, "lifecycle", "item_class").distinct().join(low, [*item, "lifecycle"])
    above = closure.select(F.col("sub").alias("lower_class"), F.col("super").alias("item_class"))
    return used.join(F.broadcast(above), ["lower_class", "item_class"], "left_anti").select(*item, "lifecycle", "item_class", "lower_class")


def ambiguous(numbered: DataFrame, closure: DataFrame, item: tuple[str, ...] = ("item_id", "family")) -> DataFrame:
    """(item, lifecycle, item_class, n_leaves): uses of a class that lies above two or more leaves of its lifecycle."""
    used = numbered.filter("kind <> 'annihilation'").select(*item, "lifecycle", "item_class").distinct()
    strict = closure.filter("distance > 0").select(F.col("sub").alias("_s"), F.col("super").alias("item_class"))
    keys = [*item, "lifecycle"]
    names = [F.col(k).alias(f"_{k}") for k in keys]
    inner = used.join(F.broadcast(strict), "item_class").join(used.select(*names, F.col("item_class").alias("_d")), [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_s") == F.col("_d")], "left_semi")
    leaves = used.join(inner.select(*keys, "item_class").distinct(), [*keys, "item_class"], "left_anti")
    up = leaves.withColumnRenamed("item_class", "leaf").join(F.broadcast(strict.withColumnRenamed("_s", "leaf")), "leaf")
    return up.join(used, [*keys, "item_class"], "left_semi").groupBy(*keys, "item_class").agg(F.count("*").alias("n_leaves")).filter("n_leaves > 1")


def abstract_only(numbered: DataFrame, closure: DataFrame, abstract: list[str], item: tuple[str, ...] = ("item_id", "family")) -> DataFrame:
    """Lifecycles whose most derived class is abstract: they cannot be made."""
    return bounds(numbered, closure, item).filter(F.col("lower_class").isin(abstract))
