"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target divided by its size is the expected number of copies of each
of its documents. The whole part is taken; the fraction is a probability that
pivotal rounding makes 0 or 1: two documents meet, mass moves from one to the
other at random until one of them is integral, and the other goes on with what
remains. Documents meet in blocks of similar size, so that words, not only
documents, come near the target. Each block leaves one fractional document at
most; these meet again in blocks, level by level, until one per source is left.

All probabilities are whole multiples of 2**-40, so sums are exact, and all
random numbers are hashes of the documents, so reruns agree.

Defined results: a null text has size 0; null sources form one source, last in
order; a source without words has target 0 and takes nothing; repeated rows are
separate documents; a null doc_id is a document like any other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.scratch import stored

WORD = r"[^ \t-\r]+"
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: No source and no document is taken more often than this.
MOST = 2
ONE = 1 << 40
#: Documents that meet in one block, on average.
BLOCK = 128
#: Parts in which rows that agree in doc_id, source and size are numbered.
SALTS = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: its size and target. Windows here run over sources, not documents.

    Sources are filled in order of (cap / weight); whatever a full source leaves
    over is shared by weight among the rest, so no target exceeds its cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    capped = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    filled = capped.withColumn("level", left / F.sum("weight").over(after))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    level = F.max(F.when(~full, F.col("level"))).over(whole)  # that of the first source that is not full
    return filled.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _meet(units: Column, level: int) -> Column:
    """Fold sorted units (p, key, ...) into (carry, p, winners): at most one unit stays fractional."""
    none = F.lit(-1)
    start = F.struct(none.alias("carry"), F.lit(0).cast("long").alias("p"), F.array().cast("array<int>").alias("won"))

    def step(state: Column, i: Column) -> Column:
        unit = F.get(units, i)
        both = state["p"] + unit["p"]
        u = _uniform(unit["key"], F.lit(level), F.lit("pivot"))
        made = lambda carry, p, won: F.struct(carry.alias("carry"), p.cast("long").alias("p"), won.alias("won"))
        plus = lambda j: F.concat(state["won"], F.array(j))
        one = F.lit(ONE)
        merge = F.when(u * both < state["p"], state["carry"]).otherwise(i)  # who goes on with the sum
        old_wins = u * (2 * one - both) < (one - unit["p"])
        return (
            F.when(unit["p"] == 0, state)
            .when(state["carry"] < 0, made(i, unit["p"], state["won"]))
            .when(both < one, made(merge, both, state["won"]))
            .when(both == one, made(none, F.lit(0), plus(merge)))
            .otherwise(F.when(old_wins, made(i, both - one, plus(state["carry"]))).otherwise(made(state["carry"], both - one, plus(i))))
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(units) - 1), start, step)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken words."""
    counted = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    # Equal rows are numbered by counting them first, so that no task gathers them.
    numbered = counted.groupBy("doc_id", "source", "size").count().select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("nth"))
    sizes = stored(numbered.withColumn("key", F.xxhash64("doc_id", "source", "size", "nth")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share, most).coalesce(1), "mix-targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(most)).cast("int")
    rated = targets.select("source", "source_size", "target", whole.alias("whole"), F.round((ratio - whole) * ONE).cast("long").alias("p"))
    bucket = F.floor(F.log2(F.col("size") + 1)).cast("int")
    banded = sizes.withColumn("band", bucket)
    bands = stored(banded.groupBy("source", "band").count().select("source", "band", F.ceil(F.col("count") / block).alias("blocks")).coalesce(1), "mix-bands")
    placed = (
        banded.join(bands, same(banded, bands) & (banded["band"] == bands["band"]))
        .select(banded["*"], F.pmod(F.xxhash64("key", F.lit("block")), "blocks").alias("block"))
    )
    unit = F.struct("size", "key", "doc_id")
    gathered = placed.groupBy("source", "band", "block").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    joined = gathered.join(rated, same(gathered, rated)).select(gathered["*"], "source_size", "target", "whole", F.col("p"))
    units = F.transform("units", lambda x: F.struct(F.col("p").alias("p"), x["key"].alias("key")))
    met = joined.withColumn("met", _meet(units, 0))
    blocks = stored(met.select("*", F.xxhash64("source", "band", "block").alias("id")), "mix-blocks")

    # The reduction tree: what each block left meets again.
    open_units = blocks.where("met.carry >= 0").select(
        "source", "id", F.col("met.p").alias("p"), F.get("units", F.col("met.carry"))["size"].alias("size"), F.get("units", F.col("met.carry"))["key"].alias("key")
    )
    winners = None
    level = 0
    while True:
        level += 1
        per_source = open_units.groupBy("source").count()
        widest = per_source.agg(F.max("count").alias("n")).first()["n"] or 0
        groups = per_source.select("source", F.ceil(F.col("count") / block).alias("blocks"))
        grouped = open_units.join(groups, same(open_units, groups)).select(open_units["*"], F.pmod(F.xxhash64("id", F.lit(level)), "blocks").alias("block"))
        folded = grouped.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("size", "key", "id", "p"))).alias("units"))
        folded = stored(folded.withColumn("met", _meet(F.col("units"), level)), f"mix-level{level}")
        carry = F.get("units", F.col("met.carry"))
        won = folded.select(F.explode("met.won").alias("i"), "units").select(F.get("units", F.col("i"))["id"].alias("id"))
        last = widest <= block
        if last:  # one unit a source is left; chance decides
            final = folded.where("met.carry >= 0").select(carry["id"].alias("id"), carry["key"].alias("key"), F.col("met.p").alias("p"))
            won = won.union(final.where(_uniform(F.col("key"), F.lit("final")) * ONE < F.col("p")).select("id"))
        winners = won if winners is None else winners.union(won)
        if last:
            break
        open_units = folded.where("met.carry >= 0").select("source", carry["id"].alias("id"), F.col("met.p").alias("p"), carry["size"].alias("size"), carry["key"].alias("key"))

    decided = blocks.join(winners.withColumn("up", F.lit(True)), "id", "left")
    each = decided.select("source", "source_size", "target", "whole", "met", F.coalesce("up", F.lit(False)).alias("up"), F.posexplode("units").alias("i", "unit"))
    chosen = F.array_contains("met.won", F.col("i")) | (F.col("up") & (F.col("i") == F.col("met.carry")))
    copies = F.col("whole") + chosen.cast("int")
    size = F.col("unit.size")
    return each.select(F.col("unit.doc_id").alias("doc_id"), "source", size.alias("size"), "source_size", "target", copies.alias("copies"), (copies * size).cast("long").alias("taken"))


def repeat(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs``, all columns, as often as the mix takes them.

    Copies are matched by doc_id, source and size. Rows that agree in all three
    are numbered in ``SALTS`` parts, by a hash of text and place, and the parts one
    after another; the first of them get the most copies.
    """
    names = docs.columns
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs["doc_id"].alias("_id"), docs["source"].alias("_source"), size.alias("_size"), F.xxhash64(docs["text"]).alias("_hash"))
    mixed = stored(mix(docs, **how).select("doc_id", "source", "size", "copies"), "mixed")
    key = ["doc_id", "source", "size"]
    counted = mixed.groupBy(*key).agg(F.count("*").alias("rows"), F.max("copies").alias("copies"))
    on = lambda df: F.col("_id").eqNullSafe(df["doc_id"]) & F.col("_source").eqNullSafe(df["source"]) & (F.col("_size") == df["size"])
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    alone = counted.where("rows = 1 and copies > 0").hint("merge")  # grows with the documents: one plan at every size
    taken = keyed.join(alone, on(alone)).select("_row", again).select("_row.*")
    several = stored(counted.where("rows > 1").select(*key), "several")
    if not several.limit(1).count():
        return taken
    # How many of the rows of a key get so many copies, most copies first, as running counts.
    hit = mixed.join(several.withColumnsRenamed({c: f"s_{c}" for c in key}), mixed["doc_id"].eqNullSafe(F.col("s_doc_id")) & mixed["source"].eqNullSafe(F.col("s_source")) & (mixed["size"] == F.col("s_size")))
    grades = hit.groupBy(*key, "copies").count()
    up_to = Window.partitionBy(*key).orderBy(F.col("copies").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = grades.withColumn("upto", F.sum("count").over(up_to)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("upto", "copies"))).alias("steps"))
    salt = F.pmod(F.xxhash64("_hash", F.monotonically_increasing_id()), F.lit(SALTS))
    rows = stored(keyed.join(several, on(several), "left_semi").withColumn("_salt", salt), "equal-rows")
    own = ["_id", "_source", "_size"]
    parts = rows.groupBy(*own, "_salt").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy(*own).orderBy("_salt")) - F.col("n"))
    parts = parts.join(steps, on(steps)).select(*[F.col(c).alias(f"p{c}") for c in own], F.col("_salt").alias("p_salt"), "before", "steps")
    nth = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*own, "_salt").orderBy("_hash")))
    same = F.col("_id").eqNullSafe(F.col("p_id")) & F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("_size") == F.col("p_size")) & (F.col("_salt") == F.col("p_salt"))
    placed = nth.join(parts, same).withColumn("copies", F.filter("steps", lambda x: F.col("before") + F.col("_nth") <= x["upto"])[0]["copies"])
    return taken.union(placed.where("copies > 0").select("_row", again).select("_row.*"))
