"""Codec of global addresses: 64-bit patterns held in signed columns.

An address has one of seven forms, four for absolute addresses and three for
those relative to the reader's place. A form is a set of flag bits, the place
fields that it carries and the number of bits of its offset; encoding and
decoding both follow from that table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.intmath import long

TIERS = ("l1sp", "l2sp", "dram", "ctrl")
# Places of the flag bits, absolute addresses first, and the offset bits of relative forms.
ABSOLUTE, FAR_DRAM, FAR_L2SP, CONTROL = 63, 62, 61, 29
NEAR_DRAM, NEAR_L2SP = 30, 29
NEAR_DRAM_BITS, NEAR_BITS = 30, 29
#: Place fields that each tier has.
PLACES = {"dram": ("pxn",), "l2sp": ("pxn", "pod"), "ctrl": ("pxn", "pod", "core"), "l1sp": ("pxn", "pod", "core")}


@dataclass(frozen=True)
class Form:
    absolute: bool
    tier: str
    flags: tuple[int, ...]
    offset_bits: int


def _either(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out.bitwiseOR(x)
    return out


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, so that plans stay small."""
    return F.transform(F.array(value), use)[0]


class Layout:
    """Places of the fields for a machine of so many nodes (pxn), pods a node and cores a pod."""

    def __init__(self, pxns: int, pods: int, cores: int):
        low, self.fields = FAR_L2SP, {}
        for name, n in (("pxn", pxns), ("pod", pods), ("core", cores)):
            width = (n - 1).bit_length()
            low -= width
            self.fields[name] = low, (1 << width) - 1
        low_of = lambda name: self.fields[name][0]
        self.forms = (
            # Tested in this order: the first whose flags are all set is the form.
            Form(True, "dram", (ABSOLUTE, FAR_DRAM), low_of("pxn")),
            Form(True, "l2sp", (ABSOLUTE, FAR_L2SP), low_of("pod")),
            Form(True, "ctrl", (ABSOLUTE, CONTROL), 0),
            Form(True, "l1sp", (ABSOLUTE,), CONTROL),
            Form(False, "dram", (NEAR_DRAM,), NEAR_DRAM_BITS),
            Form(False, "l2sp", (NEAR_L2SP,), NEAR_BITS),
            Form(False, "l1sp", (), NEAR_BITS),
        )

    @staticmethod
    def _flags(form: Form) -> Column:
        pattern = sum(1 << b for b in form.flags)
        return long(pattern - (1 << 64) if pattern >> 63 else pattern)

    def form_of(self, word: Column) -> Column:
        """The number of the form of an address."""
        chosen = None
        for i, form in enumerate(self.forms):
            hit = word.bitwiseAND(self._flags(form)) == self._flags(form)
            chosen = F.when(hit, i) if chosen is None else chosen.when(hit, i)
        return chosen

    def parts_of(self, word: Column, form: Column, my_pxn=0, my_pod=0, my_core=0) -> list[Column]:
        """absolute, tier, pxn, pod, core and offset of an address of a form; fields that a tier has not are 0, relative ones are the reader's."""
        mine = {"pxn": my_pxn, "pod": my_pod, "core": my_core}
        of_form = lambda value: F.get(F.array(*[F.lit(value(f)) for f in self.forms]), form)
        absolute = of_form(lambda f: f.absolute)
        place = []
        for name, (low, mask) in self.fields.items():
            here = F.when(absolute, F.shiftrightunsigned(word, low).bitwiseAND(long(mask))).otherwise(long(mine[name]))
            place.append(F.when(of_form(lambda f: name in PLACES[f.tier]), here).otherwise(long(0)).alias(name))  # noqa: B023
        offset = word.bitwiseAND(F.get(F.array(*[long((1 << f.offset_bits) - 1) for f in self.forms]), form))
        return [absolute.alias("absolute"), of_form(lambda f: f.tier).alias("tier"), *place, offset.alias("offset")]

    def decode(self, addr: Column, my_pxn=0, my_pod=0, my_core=0) -> Column:
        """The parts of an address as a struct."""
        return _named(addr, lambda word: _named(self.form_of(word), lambda form: F.struct(*self.parts_of(word, form, my_pxn, my_pod, my_core))))

    def encode(self, info: Column) -> Column:
        """The address of such a struct; fields too wide for their bits lose the upper ones."""
        get = info.getField
        made = None
        for form in self.forms:
            parts = [self._flags(form), long(get("offset")).bitwiseAND(long((1 << form.offset_bits) - 1))]
            if form.absolute:
                for name in PLACES[form.tier]:
                    low, mask = self.fields[name]
                    parts.append(F.shiftleft(long(get(name)).bitwiseAND(long(mask)), low))
            fits = get("absolute") == F.lit(form.absolute)
            # The last form also takes what has no form of its own: a relative address of a control register.
            if form is not self.forms[-1]:
                fits = fits & (get("tier") == form.tier)
            made = F.when(fits, _either(parts)) if made is None else made.when(fits, _either(parts))
        return made

    def to_absolute(self, addr: Column, my_pxn=0, my_pod=0, my_core=0) -> Column:
        def moved(word: Column) -> Column:
            there = _named(self.decode(word, my_pxn, my_pod, my_core), lambda x: self.encode(x.withField("absolute", F.lit(True))))
            return F.when(word < 0, word).otherwise(there)  # the sign bit is the flag of absolute addresses

        return _named(addr, moved)


def with_decoded(df: DataFrame, layout: Layout, addr: str = "addr") -> DataFrame:
    """``df`` with the parts of its addresses; the form is a column of its own, so that all of it runs in generated code."""
    formed = df.withColumn("_form", layout.form_of(F.col(addr)))
    return formed.select(*df.columns, *layout.parts_of(F.col(addr), F.col("_form")))


def banks(interleave_size: int, interleave_step: int) -> int:
    """Memories among which blocks of ``interleave_size`` bytes are dealt in turn, one block of each in a step; one if not dealt."""
    return interleave_step // interleave_size if interleave_size else 1


def bank_of(addr: Column, interleave_size: int, n_banks: int) -> Column:
    return F.floor(addr / interleave_size) % n_banks


def bank_range(bank: int, memsize: int, interleave_size: int, interleave_step: int) -> tuple[int, int]:
    """First and last address of a bank of ``memsize`` bytes: those of its first and its last block."""
    if not interleave_size:
        return bank * memsize, (bank + 1) * memsize - 1
    last_block = bank + banks(interleave_size, interleave_step) * (memsize // interleave_size - 1)
    return bank * interleave_size, (last_block + 1) * interleave_size - 1


def bank_ranges(spark: SparkSession, memsize: int, interleave_size: int, interleave_step: int) -> DataFrame:
    """(bank, first, last) of every bank."""
    rows = [(b, *bank_range(b, memsize, interleave_size, interleave_step)) for b in range(banks(interleave_size, interleave_step))]
    return spark.createDataFrame(rows, "bank long, first long, last long")


def core_xy(core: Column, width: int) -> tuple[Column, Column]:
    return core % width, F.floor(core / width)


def core_id(x: Column, y: Column, width: int) -> Column:
    return y * width + x
