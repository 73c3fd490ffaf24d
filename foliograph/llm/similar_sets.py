"""Problem 3: all pairs of records whose sets of values overlap above a share.

Method: size-aware overlap join. For two sets of sizes a and b the wanted share asks for an overlap of
c(a, b) values. Small sets spell out their subsets of c values, once for each size a partner can have; sets that
meet in one are a pair. Sets too large for that are looked up in inverted lists of their rarest values. Both
kinds of pairs are joined, and the final share is computed for each.

Records with equal sets form a class, and only classes are joined: copies are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.session import cut_lineage
from foliograph.sources import present


def needed_overlap(a: int, b: int, share: Fraction) -> int:
    """The least overlap with which sets of sizes ``a`` and ``b`` have ``share`` of all their values in common."""
    least = share * (a + b) / (1 + share)
    return -(-least.numerator // least.denominator)


@lru_cache(maxsize=4096)
def partner_sizes(size: int, share: Fraction, least: int) -> range:
    """Sizes a set can have that overlaps enough with one of ``size`` values."""
    low = share * size
    high = size / share
    return range(max(least, -(-low.numerator // low.denominator)), int(high) + 1)


@lru_cache(maxsize=4096)
def subset_count(size: int, share: Fraction, least: int) -> int:
    """How many subsets a set of ``size`` values spells out."""
    return sum(comb(size, c) for b in partner_sizes(size, share, least) if (c := needed_overlap(size, b, share)) <= size)


def is_small(size: int, share: Fraction, least: int, max_subsets: int) -> bool:
    """Whether a set is spelled out; depends on its size alone."""
    return subset_count(size, share, least) <= max_subsets


@lru_cache(maxsize=4096)
def _choices(size: int, chosen: int) -> np.ndarray:
    return np.array(list(combinations(range(size), chosen)), dtype=np.int32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def set_classes(records: DataFrame, key: str, values: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(``class``, ``record``) of each record with at least ``least`` distinct values, and (``class``, ``tokens``) of each class.

    A class is the smallest record with the same set. Values are read once: what travels on is a fingerprint of 128
    bits that tells sets apart, and the values' hashes of 64 bits, sorted, which tell the values of two sets apart.
    """
    items = F.array_sort(F.array_distinct(F.filter(values, present)))
    sets = (
        records.select(F.col(key).cast("long").alias("record"), items.alias("items"))
        .filter(F.col("record").isNotNull() & (F.size("items") >= least))
        .select("record", F.unhex(F.md5(F.to_json("items"))).alias("print"), F.array_sort(F.transform("items", lambda v: F.xxhash64(v))).alias("tokens"))
    )
    sets = cut_lineage(sets.dropDuplicates(["record", "print"]))
    first = sets.groupBy("print").agg(F.min("record").alias("class"))
    member = cut_lineage(sets.select("record", "print").join(first, "print").select("class", "record"))
    heads = first.select(F.col("class").alias("record"), "print")
    return member, cut_lineage(sets.join(heads, ["record", "print"], "left_semi").select(F.col("record").alias("class"), "tokens"))


#: What a set is to its partner in a subset's key: the smaller, the larger, or of the same size.
_SMALLER, _LARGER, _EQUAL = 0, 1, 2


def _subset_keys(sets: DataFrame, share: Fraction, least: int, large_from: int) -> DataFrame:
    """(``key``, ``entry``) of every subset of every small set.

    Only partners that spell out theirs too are met. A key stands for a subset and the two sizes it is enough for; ``entry`` is the class times 4 plus the role
    of the set, so that a row is two numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            sizes = np.diff(ends)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                tokens = _mix(flat[ends[rows][:, None] + np.arange(size)])
                for partner in partner_sizes(size, share, least):
                    chosen = needed_overlap(size, partner, share)
                    if chosen > size or partner >= large_from:
                        continue
                    role = _EQUAL if size == partner else _SMALLER if size < partner else _LARGER
                    choices = _choices(size, chosen)
                    step = max(1, 200_000 // len(choices))
                    for at in range(0, len(rows), step):
                        # The sum of the hashes of a subset is its key: the same in whatever order it is taken.
                        total = tokens[at : at + step][:, choices].sum(axis=2, dtype=np.uint64)
                        low, high = min(size, partner), max(size, partner)
                        keys = _mix(total + np.uint64(low * 65537 + high)).view(np.int64).ravel()
                        entries = np.repeat(ids[rows[at : at + step]] * 4 + role, len(choices))
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(entries)], names=["key", "entry"])

    return sets.select("class", "tokens").mapInArrow(run, "key bigint, entry bigint")


def _small_pairs(sets: DataFrame, share: Fraction, least: int, large_from: int) -> DataFrame:
    """Classes of small sets that meet in a subset.

    Both sides of the join are the same rows, shuffled once: the condition is written so that no part of it can
    be moved to one side.
    """
    keys = _subset_keys(sets, share, least, large_from)
    a = keys.select("key", F.col("entry").alias("x"))
    b = keys.select("key", F.col("entry").alias("y"))
    roles = F.pmod("x", F.lit(4)) * 3 + F.pmod("y", F.lit(4))
    meet = roles.isin(_SMALLER * 3 + _LARGER, _EQUAL * 3 + _EQUAL) & ((roles != _EQUAL * 3 + _EQUAL) | (F.col("x") < F.col("y")))
    pairs = a.join(b, "key").filter(meet)
    return pairs.select(F.shiftright("x", 2).alias("a"), F.shiftright("y", 2).alias("b")).distinct()


def _large_pairs(sets: DataFrame, large_from: int, share: Fraction, least: int) -> DataFrame:
    """Pairs with at least one set of ``large_from`` values or more that share one of their rarest values.

    Sets too small for any large partner take no part. Two values with one hash only make a list longer: what two
    sets share stays shared.
    """
    smallest = partner_sizes(large_from, share, least).start
    near = sets.filter(F.size("tokens") >= smallest)
    tokens = near.select("class", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("n"), F.max((F.col("size") >= large_from).cast("int")).alias("in_large"))
    # A value that one set alone has, or no large set has, can't be what a pair is found by, yet counts in the order of its set.
    ranked = (
        tokens.join(frequency, "token")
        .groupBy("class", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token", "in_large"))).alias("by_rarity"))
    )
    # Two sets that overlap enough share one of their first size - least overlap + 1 values in any fixed order.
    kept = F.ceil(F.col("size") * F.lit(share.numerator) / F.lit(share.denominator) - F.lit(1e-9))
    prefix = F.slice("by_rarity", 1, (F.col("size") - kept + 1).cast("int"))
    shared = F.filter(prefix, lambda x: (x["n"] > 1) & (x["in_large"] == 1))
    lists = ranked.select("class", "size", F.explode(shared).alias("x")).select("class", "size", F.col("x.token").alias("token"))
    of_large = lists.filter(F.col("size") >= large_from).select(F.col("class").alias("l"), F.col("size").alias("size_l"), "token")
    # A pair of two large sets is met from both; once is enough.
    once = (F.col("size") < large_from) | (F.col("l") < F.col("class"))
    met = of_large.join(lists, "token").filter((F.col("l") != F.col("class")) & once)
    sizes = F.least("size", "size_l") * F.lit(share.denominator) >= F.greatest("size", "size_l") * F.lit(share.numerator)
    return met.filter(sizes).select(F.least("l", "class").alias("a"), F.greatest("l", "class").alias("b")).distinct()


def large_size(share: Fraction, least: int, max_subsets: int) -> int:
    """The size from which on sets are looked up in lists: the first with more than ``max_subsets`` subsets."""
    return next(size for size in count(least) if not is_small(size, share, least, max_subsets))


def similar_classes(sets: DataFrame, share: float | str, least: int, max_subsets: int = 64) -> DataFrame:
    """(``a``, ``b``, ``share``): pairs of different sets (as classes) with at least ``share`` in common.

    ``sets``: (class, tokens). Sets below the first size that has more than ``max_subsets`` subsets count as small.
    No pair is lost whatever their sizes, and there is no cap on the records that have a value: hot values are split
    by the adaptive skew join.
    """
    wanted = Fraction(str(share))
    if wanted >= 1:  # sets with all values in common are one class
        return sets.sparkSession.createDataFrame([], "a bigint, b bigint, share double")
    large_from = large_size(wanted, least, max_subsets)
    pairs = _small_pairs(sets.filter(F.size("tokens") < large_from), wanted, least, large_from).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    candidates = pairs.unionByName(_large_pairs(sets, large_from, wanted, least))
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tokens_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    every = F.size("tokens_a") + F.size("tokens_b") - common
    return (
        candidates.join(left, "a")
        .join(right, "b")
        .select("a", "b", common.alias("common"), every.alias("every"))
        .filter(F.col("common") * F.lit(wanted.denominator) >= F.col("every") * F.lit(wanted.numerator))
        .select("a", "b", (F.col("common") / F.col("every")).alias("share"))
    )


def similar_records(records: DataFrame, key: str, values: str, share: float | str, least: int, max_subsets: int = 64) -> DataFrame:
    """(``id_a``, ``id_b``): every pair of records, the smaller id first, whose sets have ``share`` in common.

    Share is common values over all distinct values of the two; only records with at least ``least`` distinct
    values take part. Nulls and empty strings are no values; order and repetition don't count; null keys and
    lists give nothing; repeated rows count once; an empty table gives an empty result.
    """
    member, sets = set_classes(records, key, values, least)
    pairs = similar_classes(sets, share, least, max_subsets).select("a", "b")
    a = member.select(F.col("class").alias("a"), F.col("record").alias("id_a"))
    b = member.select(F.col("class").alias("b"), F.col("record").alias("id_b"))
    between = pairs.join(a, "a").join(b, "b").select("id_a", "id_b")
    within = a.join(b, F.col("a") == F.col("b")).filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
    return between.unionByName(within).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def similar_links(records: DataFrame, key: str, values: str, share: float | str, least: int, max_subsets: int = 64) -> DataFrame:
    """(``record``, ``class``, ``links``): each record with its class of equal sets and the number of other records it is similar to."""
    classes, sets = set_classes(records, key, values, least)
    pairs = similar_classes(sets, share, least, max_subsets).select("a", "b")
    sizes = classes.groupBy("class").agg(F.count("*").alias("members"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    reached = (
        both.join(sizes.select(F.col("class").alias("other"), "members"), "other").groupBy("class").agg(F.sum("members").alias("reached"))
    )
    return (
        classes.select("record", "class")
        .join(sizes, "class")
        .join(reached, "class", "left")
        .select("record", "class", (F.col("members") - 1 + F.coalesce("reached", F.lit(0))).alias("links"))
    )
