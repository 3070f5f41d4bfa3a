"""Queries over the table of annotations: paging, reuse of equal requests, participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def may_see(user: str, owner: str = "user_id", participants: str = "participants") -> Column:
    return (F.col(owner) == user) | F.array_contains(participants, user)


def page(rows: DataFrame, order: str, number: int, size: int = 10) -> DataFrame:
    """The ``number``-th page (from 1), latest first."""
    return rows.orderBy(F.desc(order)).offset((number - 1) * size).limit(size)


def reusable(rows: DataFrame, fingerprint: str = "fingerprint", order: str = "id", status: str = "status") -> DataFrame:
    """Of each fingerprint the earliest complete row; an equal request takes its result."""
    w = Window.partitionBy(fingerprint).orderBy(order)
    return rows.where(F.col(status) == "COMPLETE").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_participant(rows: DataFrame, user: str, participants: str = "participants") -> DataFrame:
    return rows.withColumn(participants, F.array_union(F.coalesce(participants, F.array().cast("array<string>")), F.array(F.lit(user))))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """An append-only table as it stands: of each key the row of the highest version."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
