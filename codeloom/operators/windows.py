"""Ordered operators over event logs: segments, brackets, running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import shared


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` cut into ranges of its order (column ``__range``) and stored, so that no key is one task's alone."""
    return shared.stored(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")


def _same(part: list[str], prefix: str = "__") -> Column:
    out = F.lit(True)
    for c in part:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def running(df: DataFrame, part: list[str], order: list[str], **values: Column) -> DataFrame:
    """Running sums of ``values`` within each part, each row's own included.

    A part is summed in ranges of its order; what earlier ranges hold is added.
    Of a range's parts only the first can have begun in an earlier one, so that
    few sums are to be added, however many parts there are.
    """
    cut = df
    for name, v in values.items():
        cut = cut.withColumn(name, v.cast("long"))
    cut = ranged(cut, [*part, *order])
    sums = cut.groupBy(*part, "__range").agg(*(F.sum(n).alias(n) for n in values))
    w = W.partitionBy(*part).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(c).alias(f"__{c}") for c in part), F.col("__range").alias("__r"), *(F.sum(n).over(w).alias(f"__{n}") for n in values), F.count("*").over(w).alias("__before")).filter("__before > 0").drop("__before")
    out = cut.join(F.broadcast(offsets), (F.col("__range") == F.col("__r")) & _same(part), "left")
    local = W.partitionBy(*part, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for n in values:
        out = out.withColumn(n, F.sum(n).over(local) + F.coalesce(f"__{n}", F.lit(0)))
    return out.drop("__range", "__r", *(f"__{c}" for c in part), *(f"__{n}" for n in values))


def following(df: DataFrame, part: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The next value that is not null behind each row of its part, as column ``name``.

    A part is read backwards in ranges of its order; a range without a value takes the one of the ranges behind it.
    """
    cut = ranged(df.withColumn("__value", value), [*part, *order])
    key = F.struct(*order)
    first = cut.groupBy(*part, "__range").agg(F.min_by("__value", F.when(F.col("__value").isNotNull(), key)).alias("__first"))
    w = W.partitionBy(*part).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    behind = first.select(*(F.col(c).alias(f"__{c}") for c in part), F.col("__range").alias("__r"), F.last("__first", ignorenulls=True).over(w).alias("__behind")).filter("__behind is not null")
    back = W.partitionBy(*part, "__range").orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, -1)
    # only a range's last part goes on in the next one, so that ``behind`` is small
    out = cut.withColumn("__own", F.last("__value", ignorenulls=True).over(back)).join(F.broadcast(behind), (F.col("__range") == F.col("__r")) & _same(part), "left")
    return out.withColumn(name, F.coalesce("__own", "__behind")).drop("__range", "__r", "__value", "__own", "__behind", *(f"__{c}" for c in part))


def segments(log: DataFrame, part: list[str], order: str, special: Column, context: list[str], strict: bool = True) -> DataFrame:
    """Plain events between special ones, numbered by ``seg``.

    With ``strict`` only events in the same context as their segment's first stay.
    A part is counted in ranges of its order; what earlier ranges hold is added.
    """
    numbered = running(log.withColumn("__special", special), part, [order], seg=special.cast("int"))
    plain = numbered.filter("not __special").drop("__special")
    if not strict or not context:
        return plain
    # a group's first event is found by partial minima, so that a long segment is no one task's either
    key = [*part, "seg"]
    first = plain.groupBy(*key).agg(F.min_by(F.struct(*context), order).alias("__first")).select(*(F.col(c).alias(f"__{c}") for c in key), "__first")
    same = _same(key)
    for c in context:
        same = same & F.col(c).eqNullSafe(F.col("__first").getField(c))
    return plain.join(first, same, "left_semi")


def compact(plain: DataFrame, key: list[str], order: str, is_read: Column) -> DataFrame:
    """Reads, writes and the first of each, by segment and variable."""
    return plain.groupBy(*key).agg(
        F.sum(is_read.cast("int")).alias("reads"), F.sum((~is_read).cast("int")).alias("writes"),
        F.min(F.when(is_read, F.col(order))).alias("first_read"), F.min(F.when(~is_read, F.col(order))).alias("first_write"),
    )


def invocation(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Running number of each call within its function and thread."""
    return running(log, key, [order], invno=F.lit(1)).withColumn("invno", F.col("invno").cast("int"))


def depth(log: DataFrame, part: list[str], order: str, up: Column, down: Column) -> DataFrame:
    """Brackets open after each event: calls without their returns, locks without their unlocks."""
    return running(log, part, [order], depth=F.when(up, 1).when(down, -1).otherwise(0))


def brackets(log: DataFrame, part: list[str], order: str, up: Column, down: Column) -> DataFrame:
    """Each opening event with the event that closes it (or null): the next closing one that ends its depth."""
    ups = up.cast("boolean")
    d = depth(log.filter(up | down), part, order, up, down).withColumn("opens", ups)
    d = d.withColumn("level", F.when(F.col("opens"), F.col("depth")).otherwise(F.col("depth") + 1))
    d = following(d, [*part, "level"], [order], F.struct("opens", F.col(order).alias("at")), "__next")
    d = d.withColumn("closed_by", F.when(~F.col("__next.opens"), F.col("__next.at")))
    return d.filter("opens").drop("opens", "depth", "__next")


def lifetimes(log: DataFrame, part: list[str], order: str, begins: Column, ends: Column) -> DataFrame:
    """Each beginning with the next end in its part: allocation and release of memory."""
    return following(log, part, [order], F.when(ends, F.col(order)), "ended").filter(begins)


def floor_lookup(points: DataFrame, bases: DataFrame, part: str, at: str, base: str, value: str, size: str | None = None) -> DataFrame:
    """For each point (part, at, id) the value of the last base at or below it.

    Bases and points are sorted together in ranges; a range that begins with
    points takes the last base of the ranges ahead.  With ``size``, a column of
    the bases, the value counts only where the point lies below base + size
    (else it is null).  Column ``base`` stays.
    """
    have = [F.col(value).alias("value"), F.col(base).alias("base"), *([F.col(size).alias("size")] if size else [])]
    found = F.struct(*have)
    rows = bases.select(part, F.col(base).alias(at), F.lit(0).alias("kind"), found.alias("hit"), F.lit(None).cast("long").alias("id"))
    asked = points.select(part, F.col(at).cast(bases.schema[base].dataType).alias(at), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["hit"].dataType).alias("hit"), F.col("id").cast("long").alias("id"))
    cut = ranged(rows.unionByName(asked), [part, at, "kind"])
    w = W.partitionBy(part, "__range").orderBy(at, "kind").rowsBetween(W.unboundedPreceding, 0)
    last = cut.groupBy(part, "__range").agg(F.max_by(F.when(F.col("kind") == 0, F.col("hit")), F.when(F.col("kind") == 0, F.col(at))).alias("last"))
    carried = F.last("last", ignorenulls=True).over(W.partitionBy(part).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    carry = last.select(F.col(part).alias("__part"), F.col("__range").alias("__r"), carried.alias("carried")).filter("carried is not null")
    out = cut.withColumn("hit", F.last("hit", ignorenulls=True).over(w)).filter("kind = 1")
    # only a range's first part has begun in an earlier one
    out = out.join(F.broadcast(carry), (F.col("__range") == F.col("__r")) & F.col(part).eqNullSafe(F.col("__part")), "left").withColumn("hit", F.coalesce("hit", "carried"))
    inside = F.col(at) < F.col("hit.base") + F.col("hit.size") if size else F.lit(True)
    return out.select(part, at, "id", F.when(inside, F.col("hit.value")).alias("value"), F.col("hit.base").alias("base"))


def last_seen(lines: DataFrame, part: str, order: str, value: Column) -> DataFrame:
    """The last non-null value so far, as the current directory of a build log."""
    w = W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("current", F.last(value, ignorenulls=True).over(w))


def next_definition(decls: DataFrame, usr: str, order: str, key: str, is_def: Column) -> DataFrame:
    """Links declarations: a definition to itself, one before it to the next, one after it to the first."""
    w = W.partitionBy(usr).orderBy(order)
    out = decls.withColumn("first_def", F.first(F.when(is_def, F.col(key)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    out = out.withColumn("next_def", F.first(F.when(is_def, F.col(key)), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    return out.withColumn("def_id", F.coalesce("next_def", "first_def")).drop("first_def", "next_def")


def ordinal(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Dense rank over the whole table without one task for all: ranks within ranges, then each range's offset.

    The ranges are pinned by a checkpoint; one small row a range is broadcast.
    """
    cut = ranged(df, [order])
    sizes = cut.groupBy("__range").agg(F.count_distinct(order).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    local = F.dense_rank().over(W.partitionBy("__range").orderBy(order))
    return cut.join(F.broadcast(offsets), "__range").withColumn(name, (local + F.col("__before")).cast("int")).drop("__range", "__before")
