"""The join between triples maps: equality of texts, values against values.

With several conditions a child links to the subjects that every condition finds, each by whatever parent record: an
intersection of subject sets, not a conjunction on one parent record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.plans.terms import there


def keyed(parent: DataFrame, subjects: Column, values: Column) -> DataFrame:
    """k, o: each value of a parent record with each of its subjects, once."""
    return parent.select(F.explode(values).alias("k"), subjects.alias("os")).select("k", F.explode("os").alias("o")).distinct()


def keyed_once(parent: DataFrame, needs: tuple[Column, ...], key: Column, subject: Column | None) -> DataFrame:
    """k, o: as keyed, for records of one value and one subject. subject: none where all have one that is known."""
    return parent.where(there((key, *needs))).select(key.alias("k"), *([] if subject is None else [subject.alias("o")])).distinct()


def join_once(child: DataFrame, parent: DataFrame) -> DataFrame:
    """What the child has, and o. A child's record with one value meets each subject once, as the parent's rows are
    distinct: no set is needed behind the join."""
    return child.join(parent, "k").drop("k")


def join_subjects(child: DataFrame, payload: list[str], conditions: list[tuple[str, DataFrame]]) -> DataFrame:
    """payload and o. child: payload columns, and an array of values for each condition, named in conditions."""
    if len(conditions) == 1:
        values, parent = conditions[0]
        return child.select(*payload, F.explode(F.array_distinct(values)).alias("k")).join(parent, "k").select(*payload, "o").distinct()
    found = None
    key = [*payload, *(v for v, _ in conditions)]
    for i, (values, parent) in enumerate(conditions):
        one = child.select(*key, F.explode(F.array_distinct(values)).alias("k")).join(parent, "k").select(*key, "o", F.lit(i).alias("c"))
        found = one if found is None else found.unionByName(one)
    return found.distinct().groupBy(*key, "o").agg(F.count("*").alias("n")).where(F.col("n") == len(conditions)).select(*payload, "o")
