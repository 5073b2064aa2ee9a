"""relflow: functional analytics over Spark DataFrames.

A :class:`Relation` wraps one DataFrame.  Every operator lowers to ordinary
DataFrame expressions, so Catalyst plans the work; Python code runs on the
executors only for logic that columns cannot express.
"""

from relflow.functions.folds import Fold, fold, fold_fn
from relflow.operators.grouping import cogroup, fold_relation, group_by, into, reduce_relation
from relflow.operators.joins import filter_by, join, on, remove_by
from relflow.operators.setops import (
    concat,
    difference,
    difference_multiset,
    distinct,
    intersection,
    intersection_multiset,
    set_op,
    union,
    union_multiset,
)
from relflow.relation import Relation, constantly, dump, relation, returning

__all__ = [
    "Fold", "Relation", "cogroup", "concat", "constantly", "difference", "difference_multiset",
    "distinct", "dump", "filter_by", "fold", "fold_fn", "fold_relation", "group_by",
    "intersection", "intersection_multiset", "into", "join", "on", "reduce_relation", "relation",
    "remove_by", "returning", "set_op", "union", "union_multiset",
]
