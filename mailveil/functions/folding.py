"""Folds over long arrays in time that grows with their length.

Arrays do not grow in place: appending copies what is there. A fold that collects results
one by one is quadratic, so these work block by block, and only whole blocks are collected.
Where a step is small, an array that is one block is folded directly, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let

BLOCK = 128


def blocks(items: Column) -> Column:
    """The array cut into arrays of BLOCK items; none for an empty array."""
    def cut(held: Column) -> Column:
        count = F.ceil(F.size(held) / BLOCK).cast("int")
        return F.when(count > 0, F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(
                F.array_repeat(held, F.lit(0)))

    return let(items, cut)


def one_or_more_blocks(items: Column, direct: Callable[[Column], Column],
                       by_block: Callable[[Column], Column]) -> Column:
    """The first way for an array of at most BLOCK items, the second for a longer one."""
    return let(items, lambda held: F.when(F.size(held) <= BLOCK, direct(held)).otherwise(
        by_block(held)))


def fold(items: Column, state: Column, none: Column,
         step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold the items with a state and collect what each step gives.

    ``step`` takes the state and an item and returns the new state and an array of what to
    collect, of the type of the empty array ``none``. The result is a struct of the last
    ``state`` and ``out``, everything collected in order.
    """
    def pair(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def one(acc: Column, item: Column) -> Column:
        return let(pair(*step(acc["state"], item)), lambda r: pair(
            r["state"], F.when(F.size(r["out"]) > 0, F.concat(acc["out"], r["out"]))
            .otherwise(acc["out"])))

    def block(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, pair(acc["state"], none), one), lambda r: pair(
            r["state"], F.array_append(acc["out"], r["out"])))

    parts = F.array_repeat(none, F.lit(0))
    return F.aggregate(blocks(items), pair(state, parts), block,
                       lambda acc: pair(acc["state"], F.flatten(acc["out"])))


def side_by_side(left: Column, right: Column, *names: str) -> Column:
    """Structs of the items of two arrays in the same place."""
    return F.zip_with(left, right, lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))


def running(values: Column, start: int, join: Callable[[Column, Column], Column]) -> Column:
    """The results of joining all values up to each one, as integers."""
    none = F.array().cast("array<int>")

    def folded(part: Column, state: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("state"), none.alias("out")), one,
                           lambda acc: acc["out"])

    def one(acc: Column, value: Column) -> Column:
        joined = join(acc["state"], value).cast("int")
        return F.struct(joined.alias("state"), F.array_append(acc["out"], joined).alias("out"))

    def block(done: Column, part: Column) -> Column:
        # A block goes on where the last one ended.
        state = F.coalesce(F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(-1)),
                           F.lit(start))
        return F.array_append(done, folded(part, state))

    return one_or_more_blocks(
        values, lambda held: folded(held, F.lit(start)),
        lambda held: F.flatten(F.aggregate(blocks(held), F.array_repeat(none, F.lit(0)), block)))


def cut_out(text: Column, ranges: Column) -> Column:
    """The pieces of a text that ``ranges``, structs of ``start`` and ``end``, cover.

    Finding a position in a text means reading up to it. The stretch that a block of ranges
    needs is cut out first, so ranges in order cost little more than the text they span. Empty
    ranges need nothing, and a range that is the whole stretch is not cut out again.
    """
    def of_block(part: Column) -> Column:
        needed = let(F.filter(part, lambda r: r["end"] > r["start"]), lambda some: F.struct(
            F.array_min(F.transform(some, lambda r: r["start"])).alias("low"),
            F.array_max(F.transform(some, lambda r: r["end"])).alias("high")))

        def piece(stretch: Column, b: Column, r: Column) -> Column:
            return F.when(r["end"] <= r["start"], F.lit("")).when(
                (r["start"] == b["low"]) & (r["end"] == b["high"]), stretch).otherwise(
                F.substr(stretch, r["start"] - b["low"] + 1, r["end"] - r["start"]))

        return let(needed, lambda b: let(
            F.when(b["low"].isNotNull(), F.substr(text, b["low"] + 1, b["high"] - b["low"])),
            lambda stretch: F.transform(part, lambda r: piece(stretch, b, r))))

    return one_or_more_blocks(
        ranges, of_block, lambda held: F.flatten(F.transform(blocks(held), of_block)))
