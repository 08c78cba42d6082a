"""Relational plans: one description of an operator, run by Spark or written out as SQL for another engine."""

from .relation import Relation, SparkRelation, SqlRelation

__all__ = ["Relation", "SparkRelation", "SqlRelation"]
