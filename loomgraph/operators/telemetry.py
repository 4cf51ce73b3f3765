"""Reports on run statistics: joins with tags, opcode mix, tiers, histograms."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = "_instruction"

# Opcodes of each class; the long families follow from their parts.
ORDERS = ("", "_RL", "_AQ", "_RL_AQ")
WIDTHS = ("W", "D")
ATOMICS = ("SWAP", "ADD", "XOR", "AND", "OR", "MIN", "MAX", "MINU", "MAXU", "CAS")
LOADS_AND_STORES = ("LB", "LH", "LW", "LBU", "LHU", "SB", "SH", "SW", "LWU", "LD", "SD")
INTEGER = (
    "LUI AUIPC ADDI SLTI SLTIU XORI ORI ANDI ADD SUB SLL SLT SLTU XOR SRL SRA OR AND FENCE FENCE_I ECALL EBREAK MRET "
    "CSRRW CSRRS CSRRC CSRRWI CSRRSI CSRRCI SLLI SRLI SRAI ADDIW SLLIW SRLIW SRAIW ADDW SUBW SLLW SRLW SRAW "
    "MUL MULH MULHSU MULHU DIV DIVU REM REMU MULW DIVW DIVUW REMW REMUW"
).split()
BRANCH = "JAL JALR BEQ BNE BLT BGE BLTU BGEU".split()
ROUNDINGS = ("RNE", "RTZ", "RDN", "RUP", "RMM", "DYN")
ROUNDED = ("FMADD", "FMSUB", "FNMSUB", "FNMADD", "FADD", "FSUB", "FMUL", "FDIV", "FSQRT")
UNROUNDED = ("FSGNJ", "FSGNJN", "FSGNJX", "FMIN", "FMAX", "FEQ", "FLE", "FLT", "FCLASS")
FLOAT_MEMORY = ("FLW", "FSW", "FLD", "FSD")
FLOAT_MOVES = ("FMV_X_W", "FMV_W_X", "FMV_X_D", "FMV_D_X")
INTEGER_KINDS = ("W", "WU", "L", "LU")


def opcode_classes() -> dict[str, str]:
    """Class of each classified opcode. LRW_RL has none; loads and stores of floats are float."""
    reserve = [f"{op}{w}{o}" for op, w, o in product(("LR", "SC"), WIDTHS, ORDERS) if (op, w, o) != ("LR", "W", "_RL")]
    memory = [*LOADS_AND_STORES, *reserve, *(f"AMO{a}{w}{o}" for a, w, o in product(ATOMICS, WIDTHS, ORDERS))]
    between = [(a, b) for f in "SD" for k in INTEGER_KINDS for a, b in ((k, f), (f, k))] + [("S", "D"), ("D", "S")]
    convert = [f"FCVT_{a}_{b}_{r}" for (a, b), r in product(between, ROUNDINGS)]
    math = [f"{op}_{p}_{r}" for op, p, r in product(ROUNDED, "SD", ROUNDINGS)] + [f"{op}_{p}" for op, p in product(UNROUNDED, "SD")]
    groups = {"memory": memory, "integer": INTEGER, "branch": BRANCH, "float": [*FLOAT_MEMORY, *math, *convert, *FLOAT_MOVES]}
    return {op: kind for kind, ops in groups.items() for op in ops}


def opcode_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(op + SUFFIX, kind) for op, kind in opcode_classes().items()], "StatisticName string, class string")


def join_tags(stats: DataFrame, tags: DataFrame) -> DataFrame:
    """Statistics with the tags of their time: an inner join, every match of equal times."""
    return stats.join(tags, "SimTime", "inner")


def opcode_mix(stats: DataFrame) -> DataFrame:
    """(total, memory, integer, branch, float): sums over instruction counters, and over each class of them."""
    table = opcode_table(stats.sparkSession)  # some 410 rows
    counted = stats.where(F.col("StatisticName").endswith(SUFFIX)).groupBy("StatisticName").agg(F.sum("sum_u64").alias("n"))
    classed = counted.join(F.broadcast(table), "StatisticName", "left")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("class") == kind, F.col("n"))), F.lit(0))
    return classed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[of(k).alias(k) for k in ("memory", "integer", "branch", "float")])


def opcode_shares(mix: DataFrame) -> DataFrame:
    return mix.select(*[(F.col(k) / F.col("total")).alias(k) for k in ("memory", "integer", "branch", "float")])


def tier_of(tier: Column, pxn: Column, my_pxn: Column) -> Column:
    """Where an access counts: its tier on the reader's own node, else remote."""
    return F.when(pxn != my_pxn, "remote_pxn").when(tier == "l1sp", "l1sp").when(tier == "l2sp", "l2sp").when(tier == "dram", "dram").otherwise("other")


# Counters of a thread, by operation and tier.
TIER_COUNTERS = [f"{op}_{tier}" for op in ("load", "store", "atomic") for tier in ("l1sp", "l2sp", "dram", "remote_pxn")]


def tier_counts(accesses: DataFrame) -> DataFrame:
    """(thread, one count per operation and tier) of accesses (thread, op, tier)."""
    keyed = accesses.select("thread", F.concat_ws("_", "op", "tier").alias("counter"))
    return keyed.groupBy("thread").pivot("counter", TIER_COUNTERS).count().na.fill(0)


def tier_sets(accesses: DataFrame) -> DataFrame:
    """(node, thread, level, counts...) of accesses (node, thread, op, tier): counts of each thread, each node and all, in one pass.

    ``level`` is thread, node or all; columns that a level adds up are null. Null
    nodes and threads keep rows of their own, which ``level`` tells from totals.
    """
    keyed = accesses.select("node", "thread", F.concat_ws("_", "op", "tier").alias("counter"))
    counts = [F.count_if(F.col("counter") == c).alias(c) for c in TIER_COUNTERS]
    level = F.element_at(F.array(F.lit("thread"), F.lit("node"), F.lit("all")), (F.grouping("node") + F.grouping("thread")).cast("int") + 1)
    made = keyed.rollup("node", "thread").agg(level.alias("level"), *counts)
    return made.select("node", "thread", "level", *TIER_COUNTERS)


def class_cube(stats: DataFrame, parts: list[str]) -> DataFrame:
    """(parts..., grouped, total, n) of counters over every combination of ``parts``; ``grouped`` has a bit for each part that is added up."""
    return stats.cube(*parts).agg(F.grouping_id(*parts).alias("grouped"), F.sum("sum_u64").alias("total"), F.count("*").alias("n"))


# Names and units of the counters in statistics files.
STAT_CATALOGUE = [(f"{op}_{tier}".upper(), "instructions") for tier in ("local_l1sp", "remote_l1sp", "l2sp", "dram", "remote_pxn") for op in ("load", "store", "atomic")] + [
    ("STALL_CYCLES", "cycles"),
    ("BUSY_CYCLES", "cycles"),
]


def stat_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAT_CATALOGUE, "name string, units string")


def tag_histogram(events: DataFrame, bins: int = 4, width: int = 1) -> DataFrame:
    """(bin, n, cycles) of (tag, cycles) in bins of ``width`` from 0; tags outside count in no bin."""
    b = F.width_bucket(F.col("tag").cast("double"), F.lit(0.0), F.lit(float(bins * width)), F.lit(bins)) - 1
    return events.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"), F.sum("cycles").alias("cycles"))


def cycle_counters(samples: DataFrame) -> DataFrame:
    """(thread, busy, stall, icache_miss): sums of per-sample counters."""
    return samples.groupBy("thread").agg(*[F.sum(c).alias(c) for c in ("busy", "stall", "icache_miss")])


def snapshot(stats: DataFrame, tag: str) -> DataFrame:
    return stats.withColumn("TagName", F.lit(tag))


def sweep_parameters(names: DataFrame, column: str = "name") -> DataFrame:
    """A map of the parameters in names like ``key_value__key_value``; the last underscore of a part ends its key."""
    parts = F.split(column, "__")
    entries = F.transform(F.filter(parts, lambda p: p.contains("_")), lambda p: F.struct(F.regexp_extract(p, r"^(.*)_[^_]*$", 1), F.regexp_extract(p, r"_([^_]*)$", 1)))
    return names.withColumn("params", F.map_from_entries(entries))
