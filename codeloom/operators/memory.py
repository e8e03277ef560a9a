"""Addresses of a trace looked up in memory: globals, the own frame, other frames, the heap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from .windows import floor_lookup

def _spaces(globals_: DataFrame, locals_: DataFrame, frames: DataFrame, heap: DataFrame) -> DataFrame:
    """All bases in one table: each space's in rising order, so that one floor lookup serves them all.

    Memory of globals and of the heap grows up from its base.  A variable of a
    frame reaches down from its offset, and an address belongs to the next frame
    pointer above it: those are stored below zero, where the next one up is the next one down.
    """
    null = F.lit(None)
    up = lambda df, space: df.select(F.lit(space).alias("space"), F.col("base"), "name", null.cast("string").alias("owner"), "size", "n")
    down = locals_.select(F.concat(F.lit("F:"), "func").alias("space"), (-F.col("offset")).alias("base"), "name", F.col("func").alias("owner"), "size", "n")
    pointers = frames.select(F.lit("S").alias("space"), (-F.col("rbp")).alias("base"), null.cast("string").alias("name"), F.col("func").alias("owner"), null.cast("long").alias("size"), null.cast("long").alias("n"))
    typed = [d.select("space", F.col("base").cast("long"), "name", "owner", F.col("size").cast("long"), F.col("n").cast("long")) for d in (up(globals_, "G"), up(heap, "H"), down, pointers)]
    both = typed[0].unionByName(typed[1]).unionByName(typed[2]).unionByName(typed[3])
    return both.withColumn("found", F.struct("name", "owner", "base", "size", "n")).select("space", "base", "found")


def _look(bases: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, step, found, diff): the base at or below each address of its space, and how far below."""
    got = floor_lookup(asked.select("space", "at", F.col("k").alias("id")), bases, "space", "at", "base", "found")
    return got.select(F.floor(F.col("id") / 4).alias("id"), (F.col("id") % 4).alias("step"), F.col("value").alias("found"), (F.col("at") - F.col("base")).alias("diff"))


def _inside(step: int):
    """The variable found in a step, where the address lies in it: size of an element times their number."""
    whole = F.col("found.size") * F.coalesce(F.col("found.n"), F.lit(1))
    position = F.when(F.col("found.n").isNotNull(), F.expr("diff div found.size"))
    return F.max(F.when((F.col("step") == step) & (F.col("diff") < whole), F.struct("found.name", "found.owner", position.alias("position"))))


def locate(accesses: DataFrame, globals_: DataFrame, locals_: DataFrame, frames: DataFrame, heap: DataFrame) -> DataFrame:
    """(id, class, name, owner, position): the variable that each address belongs to; null where there is none.

    ``accesses``: id, at (address), func and rbp of the frame that accesses.
    ``globals_`` and ``heap``: name, base, size (of an element), n (elements, null if
    no array).  ``locals_``: func, name, offset (below the frame pointer), size, n.
    ``frames``: func, rbp of the frames on the stacks.

    The first hit counts: GLOBAL; LOCAL, in the own frame; NONLOCALSTACK, in the
    frame of the next pointer above the address; HEAP.  ``owner`` is the function of
    a frame, ``position`` the element of an array.  All spaces are cut into ranges
    together, so that none of them is one task's; the other frame is looked up
    in a second pass, as its function is known only then.
    """
    spark = accesses.sparkSession
    shared.folder(spark)
    bases = _spaces(globals_, locals_, frames, heap)
    rows = accesses.select(F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "func", F.col("rbp").cast("long").alias("rbp"))
    asks = F.array(
        F.struct(F.lit("G").alias("space"), F.col("at").alias("at"), F.lit(0).alias("step")), F.struct(F.concat(F.lit("F:"), "func").alias("space"), (F.col("at") - F.col("rbp")).alias("at"), F.lit(1).alias("step")),
        # strictly above: one address further
        F.struct(F.lit("S").alias("space"), (-F.col("at") - 1).alias("at"), F.lit(2).alias("step")), F.struct(F.lit("H").alias("space"), F.col("at").alias("at"), F.lit(3).alias("step")),
    )
    asked = rows.select("id", F.explode(asks).alias("a")).select("a.space", "a.at", (F.col("id") * 4 + F.col("a.step")).alias("k")).filter("space is not null and at is not null")
    first = _look(bases, asked).groupBy("id").agg(_inside(0).alias("global"), _inside(1).alias("own"), _inside(3).alias("heap"), F.max(F.when(F.col("step") == 2, F.struct("found.owner", F.col("diff")))).alias("frame")).checkpoint()
    # the offset from the pointer of the frame that was found; below zero as those of the variables
    other = first.filter("global is null and own is null and frame.owner is not null")
    other = other.select(F.concat(F.lit("F:"), "frame.owner").alias("space"), (-F.col("frame.diff") - 1).alias("at"), (F.col("id") * 4 + 2).alias("k"))
    second = _look(bases.filter("space like 'F:%'"), other).groupBy("id").agg(_inside(2).alias("other"))
    out = rows.select("id").join(first, "id", "left").join(second, "id", "left")
    hit = F.coalesce("global", "own", "other", "heap")
    kind = F.when(F.col("global").isNotNull(), "GLOBAL").when(F.col("own").isNotNull(), "LOCAL").when(F.col("other").isNotNull(), "NONLOCALSTACK").when(F.col("heap").isNotNull(), "HEAP")
    return out.select("id", kind.alias("class"), hit["name"].alias("name"), hit["owner"].alias("owner"), hit["position"].alias("position"))
