"""Problem 2: percentiles per group over very many numbers, by radix selection.

Values are mapped to integers of the same order.  The first digit is log-linear: LEADING bits of a value's magnitude
with its power of two, so a digit spans at most 2**-LEADING of its values.  One pass counts the first digits per group;
a running sum finds the digit that holds each target rank; the next passes look only at rows in those digits and count
the next DIGIT bits, until the digits hold one value each.  Ranks are then exact (error 0).

The first digits' counts are also a summary that can be stored by day: summaries of any partition add up, and a
percentile read from a summary has a relative error of at most 2**-LEADING (0.8 %), and none for magnitudes below
2**(LEADING + 1).  The percentile p of n values is the value at rank max(1, ceil(p n)).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, small

LEADING = 7
DIGIT = 16
PROBABILITIES = (0.5, 0.9, 0.95, 0.99)
_LEAST = -(2**63) + 1


def ordered(c: Column, kind: str) -> Column:
    """A value as a long of the same order; the least long becomes the one above, so that each has a magnitude.  Floating values by their bits (NaN above all, as Spark sorts it; -0.0 as 0)."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.when(c.cast("long") < _LEAST, F.lit(_LEAST)).otherwise(c.cast("long"))
    # The bits of a positive double are ordered already; those of a negative one are mirrored.
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c.cast("double") + F.lit(0.0)).cast("long")
    # The call takes no null.
    return F.when(c.isNull(), F.lit(None).cast("long")).when(bits >= 0, bits).otherwise(-(bits.bitwiseAND(F.lit(2**63 - 1))))


def original(k: Column, kind: str) -> Column:
    """The value of an ordered long."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return k.cast(kind)
    bits = F.when(k >= 0, k).otherwise((-k).bitwiseOR(F.lit(-(2**63))))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast(kind)


def power_of_two(k: Column) -> tuple[Column, Column]:
    """(a first guess, the exact power of two) of an ordered long's magnitude; the guess is a column _guess in the second."""
    size = F.abs(k)
    guess = F.floor(F.log2(size.cast("double"))).cast("int")
    # log2 may be off by one next to a power of two.
    power = (
        F.when(size == 0, 0)
        .when(F.expr("shiftleft(1L, _guess)") > size, F.col("_guess") - 1)
        .when((F.col("_guess") < 62) & (F.expr("shiftleft(1L, _guess + 1)") <= size), F.col("_guess") + 1)
        .otherwise(F.col("_guess"))
    )
    return guess, power


def with_digit(df: DataFrame, key: str) -> DataFrame:
    """df with _digit (long, of the order of key) and _below (bits of key below the digit)."""
    k = F.col(key)
    guess, power = power_of_two(k)
    size = F.abs(k)
    below = F.greatest(F.col("_power") - LEADING, F.lit(0))
    df = df.withColumn("_guess", F.least(F.greatest(F.coalesce(guess, F.lit(0)), F.lit(0)), F.lit(62)))
    df = df.withColumn("_power", power.cast("int")).withColumn("_below", below.cast("int")).withColumn("_size", size)
    digit = F.expr("shiftright(_size, _below)") + F.col("_below").cast("long") * (1 << LEADING)
    return df.withColumn("_digit", F.when(k < 0, -digit).otherwise(digit)).drop("_guess", "_power", "_size")


def low_of(digit: Column, below: Column) -> Column:
    """Least ordered long in a first digit."""
    top = F.abs(digit) - below.cast("long") * (1 << LEADING)
    low = F.call_function("shiftleft", top, below)
    high = low + (F.call_function("shiftleft", F.lit(1).cast("long"), below) - 1)
    return F.when(digit < 0, -high).otherwise(low)


def long_form(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(by..., measure, _key): one row for each value that is not null."""
    kinds = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), ordered(F.col(m), kinds[m]).alias("_key")) for m in measures])
    return df.select(*by, F.explode(F.filter(pairs, lambda p: p["_key"].isNotNull())).alias("_v")).select(*by, "_v.measure", "_v._key")


def summary(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Counts of first digits: (by..., measure, digit, below, n).  Add n up over any of `by` to combine summaries."""
    rows = with_digit(long_form(df, by, measures), "_key")
    return rows.groupBy(*by, "measure", F.col("_digit").alias("digit"), F.col("_below").alias("below")).agg(F.count(F.lit(1)).alias("n"))


def merge(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summaries added up to the groups `by`."""
    return summaries.groupBy(*by, "measure", "digit", "below").agg(F.sum("n").alias("n"))


def ranks(counts: DataFrame, group: Sequence[str], order: Sequence[str], targets: Column | None, probabilities: Sequence[float]) -> DataFrame:
    """The rows of counts that hold a target rank, with p and the rank left within the row."""
    w = Window.partitionBy(*group)
    counted = counts.withColumn("_upto", F.sum("n").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if targets is None:
        counted = counted.withColumn("_total", F.sum("n").over(w))
        wanted = F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(p))).cast("long").alias("rank")) for p in probabilities])
        counted = counted.withColumn("_t", F.explode(F.filter(wanted, lambda t: (t["rank"] <= F.col("_upto")) & (t["rank"] > F.col("_upto") - F.col("n")))))
        return counted.withColumn("p", F.col("_t.p")).withColumn("_rank", F.col("_t.rank") - (F.col("_upto") - F.col("n")))
    return counted.where((targets <= F.col("_upto")) & (targets > F.col("_upto") - F.col("n"))).withColumn("_rank", targets - (F.col("_upto") - F.col("n")))


def from_summary(summaries: DataFrame, by: Sequence[str], probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """Percentiles of merged summaries: (by..., measure, p, low, high, estimate); the exact value lies in low..high, and the
    estimate, the middle, is off by at most 2**-LEADING of it.  For ordered longs of whole-number columns."""
    found = ranks(merge(summaries, by), [*by, "measure"], ["digit"], None, probabilities)
    low = low_of(F.col("digit"), F.col("below"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("below"))
    return (
        found.withColumn("low", low)
        .withColumn("high", F.col("low") + (width - 1))
        .select(*by, "measure", "p", "low", "high", (F.col("low") + F.expr("(high - low) div 2")).alias("estimate"))
    )


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of columns, null being equal to null."""
    on = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        on = on & left[c].eqNullSafe(right[c])
    return on


def radix_select(df: DataFrame, by: Sequence[str], measures: Sequence[str], probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """Exact percentiles: (by..., measure, n, p, value).

    A null in `by` is a group of its own; null values are not counted; a group without values has no row, as has an empty
    table.  Ties, zeros, negatives and the largest magnitudes are counted as they are, but for the least long (-2**63), which
    counts as the one above it; repeated rows are counted each time.
    Other columns, also those named like the results, are not read.  Whole-number and floating columns may not be mixed.
    """
    kinds = {dict(df.dtypes)[m] for m in measures}
    whole = kinds <= {"tinyint", "smallint", "int", "bigint"}
    if not whole and kinds & {"tinyint", "smallint", "int", "bigint"}:
        raise ValueError("measures must be all whole numbers or all floating")
    kind = "bigint" if whole else "double"
    names = {c: f"_g{i}" for i, c in enumerate(by)}
    group = [*names.values(), "measure"]
    rows = with_digit(long_form(df.select(*[F.col(c).alias(a) for c, a in names.items()], *measures), list(names.values()), measures), "_key")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    counts = rows.groupBy(*group, "_digit", "_below").agg(F.count(F.lit(1)).alias("n"))
    found = ranks(counts, group, ["_digit"], None, probabilities)
    # _low.._low + 2**_below - 1 holds the target; _rank is its rank among the rows there.
    found = cut(found.select(*group, "p", F.col("_total").alias("_n"), "_rank", "_digit", low_of(F.col("_digit"), F.col("_below")).alias("_low"), "_below"))
    while (found.agg(F.max("_below")).first()[0] or 0) > 0:
        # Each pass looks only at rows in a digit that holds a target; the digits of different p may be the same.
        places = found.where("_below > 0").select(*group, "_digit", F.col("_low"), F.col("_below").alias("_bits")).distinct()
        places = small(places.select(*[F.col(c).alias(f"_t_{c}") for c in group], F.col("_digit").alias("_t_digit"), "_low", "_bits"))
        on = F.col("_digit") == F.col("_t_digit")
        for c in group:
            on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        inside = rows.drop("_below").join(places, on).where(F.col("_key") - F.col("_low") < F.expr("shiftleft(1L, _bits)")).where("_key >= _low")
        shift = F.greatest(F.col("_bits") - DIGIT, F.lit(0))
        nxt = inside.withColumn("_next", F.call_function("shiftright", F.col("_key") - F.col("_low"), shift)).groupBy(*group, "_digit", "_low", "_bits", "_next").agg(F.count(F.lit(1)).alias("n"))
        held = found.where("_below > 0").select(*[F.col(c).alias(f"_t_{c}") for c in group], "p", "_n", F.col("_rank").alias("_want"), F.col("_low").alias("_t_low"), F.col("_below").alias("_t_bits"))
        on = (F.col("_low") == F.col("_t_low")) & (F.col("_bits") == F.col("_t_bits"))
        for c in group:
            on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        chosen = ranks(nxt.join(small(held), on), [*group, "p", "_low", "_bits"], ["_next"], F.col("_want"), probabilities)
        shift = F.greatest(F.col("_bits") - DIGIT, F.lit(0))
        stepped = chosen.select(*group, "p", "_n", "_rank", "_digit", (F.col("_low") + F.call_function("shiftleft", F.col("_next"), shift)).alias("_low"), shift.cast("int").alias("_below"))
        found = cut(found.where("_below = 0").unionByName(stepped))
    rows.unpersist()
    return found.select(*[F.col(a).alias(c) for c, a in names.items()], "measure", F.col("_n").alias("n"), "p", original(F.col("_low"), kind).alias("value"))


def wide(percentiles: DataFrame, by: Sequence[str], measures: Sequence[str], probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """One row per group: n_<measure> and p50_<measure>, p90_<measure> and so on."""
    picks = []
    for m in measures:
        mine = F.col("measure") == m
        picks.append(F.max(F.when(mine, F.col("n"))).alias(f"n_{m}"))
        picks += [F.max(F.when(mine & (F.col("p") == p), F.col("value"))).alias(f"p{round(p * 100)}_{m}") for p in probabilities]
    return percentiles.groupBy(*by).agg(*picks)
