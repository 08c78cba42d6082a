"""A small relational algebra over SQL expressions, with two carriers.

``SparkRelation`` wraps a DataFrame; every step is a DataFrame transformation and every expression goes to Catalyst.
``SqlRelation`` writes the same steps out as common table expressions of a SQL text, to hold results against another
engine. Expressions are strings made with ``functions.dialect``, which knows where the two spell things differently.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Dialect


class Relation(ABC):
    """Rows with named columns; steps return new relations."""

    d: Dialect

    @property
    @abstractmethod
    def columns(self) -> list[str]: ...

    @abstractmethod
    def add(self, **expressions: str) -> Relation:
        """Add columns, or replace those of the same name; all expressions see the columns before the step."""

    @abstractmethod
    def where(self, condition: str, derived: bool = False) -> Relation:
        """``derived``: the condition is over long computed columns, which it should not repeat below them."""

    @abstractmethod
    def pick(self, *names: str, **expressions: str) -> Relation: ...

    @abstractmethod
    def group(self, *keys: str, **aggregates: str) -> Relation: ...

    @abstractmethod
    def join(self, other: Relation, on: list[str], how: str = "inner") -> Relation:
        """Equi-join; the keys appear once."""

    @abstractmethod
    def union(self, other: Relation) -> Relation:
        """All rows of both; by name, what one lacks is null."""

    @abstractmethod
    def explode(self, name: str, array: str) -> Relation:
        """One row for each element of an array."""

    def top(self, n: int, order: str, by: str = "") -> Relation:
        """The first ``n`` rows of each group in an order, which should be total."""
        over = f"PARTITION BY {by} " if by else ""
        return self.add(__n=f"row_number() OVER ({over}ORDER BY {order})").where(f"__n <= {n}").drop("__n")

    def by_text(self, *steps: Callable[[Relation], Relation]) -> Relation:
        """``steps`` in turn, which add columns made of text and of nothing else."""
        r = self
        for step in steps:
            r = step(r)
        return r

    def drop(self, *names: str) -> Relation:
        return self.pick(*(c for c in self.columns if c not in names))

    def has(self, name: str) -> bool:
        return name in self.columns


class SparkRelation(Relation):
    d = SPARK

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def add(self, **expressions: str) -> SparkRelation:
        return SparkRelation(self.df.withColumns({k: F.expr(v) for k, v in expressions.items()}))

    def where(self, condition: str, derived: bool = False) -> SparkRelation:
        if not derived:
            return SparkRelation(self.df.where(condition))
        fenced = self.df.withColumn("__fence", F.monotonically_increasing_id())  # no filter passes below it
        return SparkRelation(fenced.where(F.expr(f"({condition}) AND __fence >= 0")).drop("__fence"))

    def pick(self, *names: str, **expressions: str) -> SparkRelation:
        return SparkRelation(self.df.select(*names, *(F.expr(v).alias(k) for k, v in expressions.items())))

    def group(self, *keys: str, **aggregates: str) -> SparkRelation:
        return SparkRelation(self.df.groupBy(*keys).agg(*(F.expr(v).alias(k) for k, v in aggregates.items())))

    def join(self, other: SparkRelation, on: list[str], how: str = "inner") -> SparkRelation:
        return SparkRelation(self.df.join(other.df, on, how))

    def union(self, other: SparkRelation) -> SparkRelation:
        return SparkRelation(self.df.unionByName(other.df, allowMissingColumns=True))

    def top(self, n: int, order: str, by: str = "") -> SparkRelation:
        if by:
            return super().top(n, order, by)
        keys = [F.expr(k.removesuffix(" DESC")).desc() if k.endswith(" DESC") else F.expr(k).asc() for k in order.split(", ")]
        return SparkRelation(self.df.orderBy(*keys).limit(n))  # every task keeps n rows; no window over all

    def by_text(self, *steps: Callable[[Relation], Relation]) -> SparkRelation:
        """Blocks repeat their texts, so the steps take each distinct text once, and rows get its columns by a join.

        Where the distinct texts are few, which a job of its own finds out, they go to the rows, which stay where they are.
        """
        texts = self.df.select("text").distinct()
        found = Relation.by_text(SparkRelation(texts), *steps)
        if any(self.has(c) for c in found.columns if c != "text"):  # a step may read what is there already
            return Relation.by_text(self, *steps)
        few = None if self.df.isStreaming else _few(texts)
        if few is not None:
            found = Relation.by_text(SparkRelation(few), *steps)
        found = found.df.withColumnRenamed("text", "__key")
        found = found if few is None else F.broadcast(found)
        return SparkRelation(self.df.join(found, F.expr("text <=> __key"), "left").drop("__key"))

    def explode(self, name: str, array: str) -> SparkRelation:
        return SparkRelation(self.df.withColumn(name, F.expr(f"explode({array})")))


#: Distinct texts, and characters of each, up to which they pass through the driver and go to every task.
FEW, SHORT = 1 << 15, 500


def _few(texts: DataFrame) -> DataFrame | None:
    """All of ``texts``, one column, as a table that reads nothing; None if they are many or long."""
    found = texts.select(F.substring("text", 1, SHORT).alias("text"), (F.length("text") > SHORT).alias("long")).limit(FEW + 1).toArrow()
    if found.num_rows > FEW or True in found["long"].to_pylist():
        return None
    spark = texts.sparkSession
    # the optimizer runs what stands on a local table by itself, in the driver, but nothing beyond an aggregate; dealt to all tasks
    return spark.createDataFrame(found.select(["text"]), texts.schema).distinct().repartition(spark.sparkContext.defaultParallelism)


class SqlRelation(Relation):
    d = DUCK

    def __init__(self, source: str, columns: list[str], steps: list[tuple[str, str]] | None = None, numbers=None):
        self.source, self._columns, self._steps = source, list(columns), steps or []
        self._numbers = numbers or count()

    @property
    def columns(self) -> list[str]:
        return list(self._columns)

    def _next(self, text: str, columns: list[str], steps: list[tuple[str, str]] | None = None) -> SqlRelation:
        name = f"s{next(self._numbers)}"
        return SqlRelation(name, columns, [*(steps if steps is not None else self._steps), (name, text)], self._numbers)

    def add(self, **expressions: str) -> SqlRelation:
        same = [c for c in self._columns if c not in expressions]
        new = ", ".join(f"{v} AS {k}" for k, v in expressions.items())
        return self._next(f"SELECT {', '.join(same)}{', ' if same else ''}{new} FROM {self.source}", [*same, *expressions])

    def where(self, condition: str, derived: bool = False) -> SqlRelation:
        return self._next(f"SELECT * FROM {self.source} WHERE {condition}", self._columns)

    def pick(self, *names: str, **expressions: str) -> SqlRelation:
        return self._next(f"SELECT {', '.join([*names, *(f'{v} AS {k}' for k, v in expressions.items())])} FROM {self.source}", [*names, *expressions])

    def group(self, *keys: str, **aggregates: str) -> SqlRelation:
        by = f" GROUP BY {', '.join(keys)}" if keys else ""
        return self._next(f"SELECT {', '.join([*keys, *(f'{v} AS {k}' for k, v in aggregates.items())])} FROM {self.source}{by}", [*keys, *aggregates])

    def _with(self, other: SqlRelation) -> list[tuple[str, str]]:
        mine = {name for name, _ in self._steps}
        return [*self._steps, *(x for x in other._steps if x[0] not in mine)]

    def join(self, other: SqlRelation, on: list[str], how: str = "inner") -> SqlRelation:
        if how in ("left_semi", "left_anti"):
            same = " AND ".join(f"a.{c} = b.{c}" for c in on)
            exists = "EXISTS" if how == "left_semi" else "NOT EXISTS"
            return self._next(f"SELECT * FROM {self.source} AS a WHERE {exists} (SELECT 1 FROM {other.source} AS b WHERE {same})", self._columns, self._with(other))
        rest = [c for c in self._columns if c not in on], [c for c in other._columns if c not in on]
        cols = ", ".join([*(f"coalesce(a.{c}, b.{c}) AS {c}" if how == "full" else f"a.{c}" for c in on), *(f"a.{c}" for c in rest[0]), *(f"b.{c}" for c in rest[1])])
        text = f"SELECT {cols} FROM {self.source} AS a {how.upper()} JOIN {other.source} AS b ON {' AND '.join(f'a.{c} = b.{c}' for c in on)}"
        return self._next(text, [*on, *rest[0], *rest[1]], self._with(other))

    def union(self, other: SqlRelation) -> SqlRelation:
        return self._next(f"SELECT * FROM {self.source} UNION ALL BY NAME SELECT * FROM {other.source}", list(dict.fromkeys([*self._columns, *other._columns])), self._with(other))

    def explode(self, name: str, array: str) -> SqlRelation:
        same = [c for c in self._columns if c != name]
        return self._next(f"SELECT {', '.join(same)}, unnest({array}) AS {name} FROM {self.source}", [*same, name])

    def table(self, source: str, columns: list[str]) -> SqlRelation:
        """Another source for the same text."""
        return SqlRelation(source, columns, [], self._numbers)

    def sql(self) -> str:
        steps = ",\n".join(f"{name} AS ({text})" for name, text in self._steps)
        return f"{f'WITH {steps}' if steps else ''}\nSELECT {', '.join(self._columns)} FROM {self.source}"
