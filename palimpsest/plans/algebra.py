"""The query algebra: items by class or id, constants, sums, products, projections; rendering and counting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.typing import of_type


class Query:
    """An expression over the items of a scope; compile() gives a lazy DataFrame, count() one row without making products."""

    def compile(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        raise NotImplementedError

    def tally(self, closure: DataFrame) -> Column | None:
        """The count as an aggregate over all items, so that they are rendered once for all parts; None if rows must be looked at."""
        return None

    def count(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        tally = self.tally(closure)
        return (self.compile(items, closure).agg(F.count("*").alias("n"))) if tally is None else items.agg(tally.cast("bigint").alias("n"))

    def __add__(self, other: Query) -> Query:
        return Plus(self, other)

    def map(self, **columns: Column) -> Query:
        return Map(self, columns)

    def ap(self, other: Query, on: Callable[[DataFrame, DataFrame], Column] | None = None) -> Query:
        return Product(self, other, on)


class Items(Query):
    """Items alive whose class is item_class or a subtype (None: any), all or those with one id; several may share the id."""

    def __init__(self, item_class: str | None, item_id=None) -> None:
        self.item_class, self.item_id = item_class, item_id

    def compile(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        if self.item_id is not None:
            items = items.filter(F.col("item_id") == self.item_id)
        return items if self.item_class is None else of_type(items, closure, self.item_class)

    def tally(self, closure: DataFrame) -> Column:
        mine = F.lit(True) if self.item_id is None else F.col("item_id") == self.item_id
        if self.item_class is not None:
            subtypes = [r["sub"] for r in closure.filter(F.col("super") == self.item_class).collect()]  # declared types
            mine &= F.col("item_class").isin(subtypes)
        return F.count(F.when(mine, 1))


class Point(Query):
    """A constant row."""

    def __init__(self, **values) -> None:
        self.values = values

    def compile(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        return items.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in self.values.items()])

    def tally(self, closure: DataFrame) -> Column:
        return F.lit(1)

    def count(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        return items.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("n"))


class Nothing(Query):
    """No items; the identity of +."""

    def compile(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        return items.limit(0)

    def tally(self, closure: DataFrame) -> Column:
        return F.lit(0)

    def count(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        return items.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"))


class Plus(Query):
    """Both sides one after the other; duplicates stay."""

    def __init__(self, left: Query, right: Query) -> None:
        self.left, self.right = left, right

    def compile(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        if isinstance(self.left, Nothing):
            return self.right.compile(items, closure)
        if isinstance(self.right, Nothing):
            return self.left.compile(items, closure)
        return self.left.compile(items, closure).unionByName(self.right.compile(items, closure))

    def tally(self, closure: DataFrame) -> Column | None:
        left, right = self.left.tally(closure), self.right.tally(closure)
        return None if left is None or right is None else left + right

    def count(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        if self.tally(closure) is not None:
            return super().count(items, closure)
        return self.left.count(items, closure).union(self.right.count(items, closure)).agg(F.sum("n").alias("n"))


class Map(Query):
    """A projection of each row."""

    def __init__(self, of: Query, columns: dict[str, Column]) -> None:
        self.of, self.columns = of, columns

    def compile(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        return self.of.compile(items, closure).select(*[c.alias(n) for n, c in self.columns.items()])

    def tally(self, closure: DataFrame) -> Column | None:
        return self.of.tally(closure)

    def count(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        return self.of.count(items, closure)


class Product(Query):
    """Every pair as structs `left` and `right`; a condition `on` of the two sides turns it into a join."""

    def __init__(self, left: Query, right: Query, on: Callable | None = None) -> None:
        self.left, self.right, self.on = left, right, on

    def compile(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        a = self.left.compile(items, closure)
        b = self.right.compile(items, closure)
        a = a.select(F.struct(*[F.col(c) for c in a.columns]).alias("left"))
        b = b.select(F.struct(*[F.col(c) for c in b.columns]).alias("right"))
        return a.crossJoin(b) if self.on is None else a.join(b, self.on(F.col("left"), F.col("right")))

    def tally(self, closure: DataFrame) -> Column | None:
        left, right = self.left.tally(closure), self.right.tally(closure)
        return None if self.on is not None or left is None or right is None else left * right

    def count(self, items: DataFrame, closure: DataFrame) -> DataFrame:
        if self.on is not None or self.tally(closure) is not None:
            return super().count(items, closure)
        both = self.left.count(items, closure).select(F.col("n").alias("a")).crossJoin(self.right.count(items, closure))
        return both.select((F.col("a") * F.col("n")).alias("n"))
