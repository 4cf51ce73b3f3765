"""Joins on time: the last tag before a statistic, and intervals that overlap.

Times are integers in any unit. Both joins cut time into buckets by powers of two,
so a group holds a number of distinct times, or of pieces of intervals, that does not
depend on how many rows there are at one time or how long an interval is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import prefix
from loomgraph.operators.spread import join_one
from loomgraph.plans.scratch import stored

#: Bits of time in one level of buckets: a bucket holds at most 2**12 distinct times, or buckets of the level below.
LEVEL_BITS = 12
#: Intervals get bins by powers of 2**2 of their length.
BIN_BITS = 2
MOST_BINS = 31


def _last_before(lasts: DataFrame, bits: int) -> DataFrame:
    """(b, last, carried): for each bucket with rows (b, last) the last value of the buckets before it.

    The buckets are numbers of some bits; buckets with the same higher bits are one
    group, ordered by a window, and what comes before the group is carried from the
    level above. The last level is one group of ``2**LEVEL_BITS`` rows at most.
    """
    window = Window.partitionBy("up").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    here = lasts.withColumn("up", F.shiftright("b", LEVEL_BITS))
    inside = here.withColumn("near", F.last("last", ignorenulls=True).over(window))
    if bits <= LEVEL_BITS:
        return inside.select("b", "last", F.col("near").alias("carried"))
    above = here.groupBy("up").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("b"))).alias("top"))
    above = _last_before(stored(above.select(F.col("up").alias("b"), F.col("top").alias("last")), "buckets"), bits - LEVEL_BITS)
    far = above.select(F.col("b").alias("up"), F.col("carried").alias("far"))
    return inside.join(far, "up").select("b", "last", F.coalesce("near", "far").alias("carried"))


def as_of_join(stats: DataFrame, tags: DataFrame, time: str, tie: str, within: int | None = None) -> DataFrame:
    """Each row of ``stats`` with the columns of the last row of ``tags`` at or before its ``time``, null if there is none.

    Of tags of one time the one of largest ``tie`` counts. ``within`` leaves out tags
    that are older than so many units. The tag's own time is the column ``tag_<time>``.
    Columns of both sides must differ but for ``time``. A null time matches nothing.

    Tags are cut down to one for each time and both sides to their distinct times
    before anything is ordered, so a time that holds most rows is one row; its
    statistics are joined to it in parts.
    """
    clash = {c.lower() for c in stats.columns} & {c.lower() for c in tags.columns} - {time.lower()}
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    kept = [c for c in tags.columns if c != time]
    value = F.struct(F.col(time).alias(f"tag_{time}"), *kept)
    t = F.col(time).cast("long")
    by_time = tags.where(F.col(time).isNotNull()).groupBy(t.alias("b")).agg(F.max_by(value, F.struct(F.col(tie), F.xxhash64(*kept))).alias("last"))
    asked = stats.where(F.col(time).isNotNull()).select(t.alias("b")).distinct()
    times = stored(asked.join(by_time, "b", "full"), "times")
    low, high = times.agg(F.min("b"), F.max("b")).first()
    if low is None:
        low = high = 0
    shifted = times.withColumn("b", F.col("b") - low)
    found = _last_before(shifted, max(1, int(high - low).bit_length()))
    tag = F.coalesce("last", "carried")
    if within is not None:
        tag = F.when(F.col("b") + low - tag[f"tag_{time}"].cast("long") <= within, tag)
    answers = stored(found.select((F.col("b") + low).alias("_t"), tag.alias("_tag")), "answers")
    many = stats.withColumn("_t", t)
    fields = [f"tag_{time}", *kept]
    return join_one(many, answers, "_t", "left").select(*stats.columns, *[F.col("_tag")[c].alias(c) for c in fields])


def _level(length: Column) -> Column:
    """The lowest level whose bins, 4**level long, are no shorter than ``length``."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) / BIN_BITS - 1e-12).cast("int")


def _pieces(df: DataFrame, start: str, end: str, own: bool, levels: list[int]) -> DataFrame:
    """Rows with (level, bin): the bins of their own level that an interval meets, two at most, or those of all higher ``levels``."""
    level = _level(F.col(end) - F.col(start))
    home = df.withColumn("_home", level)

    def bins(n: int) -> Column:
        found = F.sequence(F.shiftright(F.col(start), BIN_BITS * n), F.shiftright(F.col(end) - 1, BIN_BITS * n))
        return F.transform(found, lambda b: F.struct(F.lit(n).alias("level"), b.alias("bin")))

    at = [F.when(F.col("_home") == n if own else F.col("_home") < n, bins(n)) for n in levels]
    return home.select("*", F.explode(F.flatten(F.array_compact(F.array(*at)))).alias("_piece")).select("*", "_piece.level", "_piece.bin").drop("_piece", "_home")


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` whose intervals [start, end) have a time in common; each pair once.

    Columns must have different names; intervals that are empty or have a null end
    overlap nothing. A pair meets at the level of the longer interval, where that
    one lies in two bins at most and the other in no more; it is reported in the
    first bin that both have. So an interval is repeated twice for each level that
    occurs, however long it is and however many bins it would cover below.
    """
    clash = {c.lower() for c in a.columns} & {c.lower() for c in b.columns}
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    left = a.where(F.col(a_span[0]) < F.col(a_span[1]))
    right = b.where(F.col(b_span[0]) < F.col(b_span[1]))
    of = lambda df, span: df.select(_level(F.col(span[1]) - F.col(span[0])).alias("level"))
    levels = sorted(r["level"] for r in of(left, a_span).union(of(right, b_span)).distinct().collect())  # MOST_BINS + 1 at most
    if not levels:
        levels = [0]
    first = F.greatest(*[F.expr(f"shiftright(`{s}`, {BIN_BITS} * level)") for s in (a_span[0], b_span[0])])
    meets = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1])) & (F.col("bin") == first)

    def met(own_a: bool, own_b: bool) -> DataFrame:
        x, y = _pieces(left, *a_span, own_a, levels), _pieces(right, *b_span, own_b, levels)
        return x.join(y, ["level", "bin"]).where(meets).drop("level", "bin")

    return met(True, True).unionByName(met(True, False)).unionByName(met(False, True))


def overlap_sums(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Rows of ``a`` that overlap a row of ``b``, with their number (n) and the time shared with all of them (shared), without making the pairs.

    Of intervals [start, end) those overlap [s, e) that start before e and do not end
    by s. The time shared is what they cover before e less what they cover before s.
    Empty intervals overlap nothing; sums are exact decimals inside.
    """
    left, right = (df.where(F.col(s) < F.col(e)) for df, (s, e) in ((a, a_span), (b, b_span)))
    one, exact = F.lit(1).cast("long"), lambda c: F.col(c).cast("decimal(20,0)")
    starts = right.select(F.col(b_span[0]).cast("long").alias("_t"), one.alias("_starts"), F.lit(0).cast("long").alias("_ends"), exact(b_span[0]).alias("_moment"))
    ends = right.select(F.col(b_span[1]).cast("long").alias("_t"), F.lit(0).cast("long").alias("_starts"), one.alias("_ends"), (-exact(b_span[1])).cast("decimal(20,0)").alias("_moment"))
    asked = left.select(F.explode(F.array(*[F.col(c).cast("long") for c in a_span])).alias("_t")).distinct()
    # Ends at s itself are over by s, and add nothing to what is covered before it; so all below s + 1 count.
    upto = prefix.sums_below(starts.union(ends), asked.union(asked.select(F.col("_t") + 1)).distinct(), "_t", ["_starts", "_ends", "_moment"])
    before = upto.withColumn("_covered", (F.col("_starts") - F.col("_ends")) * F.col("_t").cast("decimal(20,0)") - F.col("_moment"))
    at_end = before.select(F.col("_t").alias("_e"), F.col("_starts").alias("_started"), F.col("_covered").alias("_to"))
    at_start = before.select((F.col("_t") - 1).alias("_s"), F.col("_ends").alias("_over"))
    from_start = before.select(F.col("_t").alias("_f"), F.col("_covered").alias("_from"))
    s, e = (F.col(c).cast("long") for c in a_span)
    met = left.withColumn("_s", s).withColumn("_f", s).withColumn("_e", e).join(at_start, "_s").join(from_start, "_f").join(at_end, "_e")
    n = F.col("_started") - F.col("_over")
    return met.where(n > 0).select(*a.columns, n.alias("n"), (F.col("_to") - F.col("_from")).cast("long").alias("shared"))
