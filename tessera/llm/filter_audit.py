"""Operator 12: how filters interact, over all orders in which they can be applied.

A document is a set of failed filters.  Sets are counted for each part first; each count then goes
to the edges of the subset lattice, (filters already applied, next filter): 80 of them for five
filters.  An order of the filters is a path through the lattice, so its steps are a join of the
counted edges with the steps of all permutations (600), and a filter's sum over all orders is its
edges' sum weighted by the paths that run through each.

Defined results: a null text is empty, a null lang is the part of the empty string.  Rows that
repeat count once each; rows of one doc_id and equal texts don't make each other copies.  A null
doc_id counts as the largest, and has no labels.  A document with several rows of labels is good
(toxic) if one of them says so.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters, limits and patterns of the filters.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, SPACES), "")

    def bits(w: Column) -> Column:
        few = F.size(w) < LEAST_WORDS
        alike = 100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w)
        capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
        loud = 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long")
        return few.cast("int") + 2 * alike.cast("int") + 4 * loud.cast("int") + 8 * text.rlike(SYMBOLS).cast("int")

    return F.transform(F.array(words), bits)[0]  # words are made once


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits), n, good, toxic: documents by the filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_failures(text).alias("failed")
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    known = each.join(marks, "doc_id", "left").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "part", "digest", "failed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic"))
    )
    # copies: rows of a text are counted by id, then by what they share, so that no group is gathered
    kind = ("digest", "failed", "part", "quality", "toxic")
    by_id = known.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row for each kind of a text
    ahead = by_kind.withColumn("ahead", F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    copies = F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("ahead")).alias("n"))
    split = ahead.select("part", "quality", "toxic", F.explode(F.array(F.struct("failed", F.col("ahead").alias("n")), copies)).alias("s")).where("s.n > 0")
    return split.groupBy("part", "s.failed").agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("quality")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))


def lattice_edges(sets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, applied (bits), next (a filter's number), and the counts of that edge."""
    others = len(filters) - 1
    number = F.col("edge")
    following = F.shiftright(number, others).alias("next")
    low = number.bitwiseAND((1 << others) - 1)

    def skipping(f: int) -> Column:  # a hole at the bit of the next filter
        return low.bitwiseAND((1 << f) - 1) + 2 * (low - low.bitwiseAND((1 << f) - 1))

    applied = F.element_at(F.array(*(skipping(f) for f in range(len(filters)))), F.shiftright(number, others) + 1).alias("applied")
    edges = sets.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(len(filters) * 2**others - 1)))).select("part", "failed", "n", "good", "toxic", applied, following)
    bit = F.call_function("shiftleft", F.lit(1), F.col("next"))
    fails = F.col("failed").bitwiseAND(bit) != 0
    passed = F.col("failed").bitwiseAND(F.col("applied")) == 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    return edges.groupBy("part", "applied", "next").agg(
        total(passed & ~fails).alias("kept"),
        total(passed & fails).alias("removed"),
        total(~passed & fails).alias("redundant"),
        total(F.col("failed") == bit).alias("unique_fails"),
        total(passed & fails, "good").alias("good_lost"),
        total(passed & fails, "toxic").alias("toxic_lost"),
    )


def permutation_steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """filter_order, step, applied, next: the lattice paths of all orders."""
    return [("".join(order), i + 1, sum(1 << filters.index(f) for f in order[:i]), filters.index(order[i])) for order in permutations(filters) for i in range(len(filters))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    n = len(FILTERS)
    edges = lattice_edges(failure_sets(docs, labels))
    paths = F.element_at(F.array(*(F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n))), F.bit_count("applied") + 1)
    weighed = edges.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "next")))  # 16 edges each
    steps = docs.sparkSession.createDataFrame(permutation_steps(), "filter_order string, step int, applied int, next int")
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return weighed.join(F.broadcast(steps), ["applied", "next"]).select("part", "filter_order", "step", *counts)
