"""Comparisons (setp) of bit patterns, and which single-bit flips of a source turn them.

Closed forms, as Catalyst expressions over ``LongType`` patterns: no flip is tried. Everything rests on
one fact about unsigned numbers a <> b whose highest differing bit is t. A flip of a below t
leaves the order as it is. A flip above t, where both agree, makes a the larger if the bit was 0, else
the smaller. A flip at t lets the bits below t decide. So the flips k after which a < b are masks
built from the differing bits smeared down (``flips_below``).

Signed order is unsigned order after the sign bit of both is inverted, which flips the same bits.
Floats compare by sign and magnitude: flips of magnitude bits keep the sign, so they reduce to
unsigned order of magnitudes; those that leave the finite range for NaN are again flips after which
the magnitude exceeds that of infinity; the sign bit is one comparison. Both zeros are equal.

Width, kind and comparator may be columns, so one expression serves rows of any instruction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

COMPARATORS = ("eq", "ne", "lt", "le", "gt", "ge", "ltu", "leu", "gtu", "geu")
#: The same comparison with its sides exchanged.
MIRRORED = {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le", "ltu": "gtu", "leu": "geu", "gtu": "ltu", "geu": "leu"}

_MIN64 = -(1 << 63)


def _lit(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long") if isinstance(x, int) else F.lit(x)


def ones(width: Column) -> Column:
    """All ones of a width from 0 to 64."""
    return F.when(width <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - width).cast("int")))


def less(a: Column, b: Column) -> Column:
    """Unsigned a < b of 64-bit patterns."""
    turn = F.lit(_MIN64).cast("long")
    return a.bitwiseXOR(turn) < b.bitwiseXOR(turn)


def flips_below(a: Column, b: Column) -> Column:
    """Bits k for which a with bit k flipped is below b, unsigned; a and b are plain references."""
    gap = a.bitwiseXOR(b)

    def by_smear(smear: Column) -> Column:
        """smear: all bits up to t."""
        low = F.shiftrightunsigned(smear, 1)
        top = F.when(less(a.bitwiseAND(low), b.bitwiseAND(low)), smear.bitwiseXOR(low)).otherwise(F.lit(0).cast("long"))
        clearing = F.bitwise_not(smear).bitwiseAND(a)  # above t a flip makes a smaller if it clears the bit; below t a flip changes nothing
        return clearing.bitwiseOR(top).bitwiseOR(F.when(less(a, b), low).otherwise(F.lit(0).cast("long")))

    return F.when(gap == 0, a).otherwise(let(ones(F.length(F.bin(gap))), by_smear))


def flips_equal(a: Column, b: Column) -> Column:
    """The bit whose flip makes a equal to b, if one does."""
    gap = a.bitwiseXOR(b)
    return F.when(F.bit_count(gap) == 1, gap).otherwise(F.lit(0).cast("long"))


def _holds(comparator: Column, below: Column, equal: Column, every: Column, unordered: Column | None = None) -> Column:
    """From the flips after which it is below, equal and unordered: those after which the comparison holds."""
    unordered = F.lit(0).cast("long") if unordered is None else unordered
    ordered = every.bitwiseAND(F.bitwise_not(unordered))
    either = below.bitwiseOR(equal)
    kind = F.regexp_replace(comparator, "u$", "")
    out = F.when(kind.isin("eq", "ne"), equal).when(kind.isin("lt", "ge"), below).otherwise(either)
    out = F.when(kind.isin("ne", "ge", "gt"), F.bitwise_not(out)).otherwise(out).bitwiseAND(ordered)
    return F.when((comparator == "ne") | comparator.endswith("u"), out.bitwiseOR(unordered)).otherwise(out)


def infinity(width: Column) -> Column:
    """The magnitude of infinity."""
    values = {16: 0x7C00, 32: 0x7F800000, 64: 0x7FF0000000000000}
    return F.when(width == 16, _lit(values[16])).when(width == 64, _lit(values[64])).otherwise(_lit(values[32]))


def _as_mask(c: Column) -> Column:
    return F.when(c, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def _float_flips(comparator: Column, a: Column, b: Column, width: Column) -> Column:
    """{flips of a after which the comparison of floats holds, whether it holds as it is}."""
    none, every = F.lit(0).cast("long"), ones(width - 1)
    named = F.struct(every.alias("every"), a.bitwiseAND(every).alias("ma"), b.bitwiseAND(every).alias("mb"), a.bitwiseAND(F.bitwise_not(every)).alias("sa"), b.bitwiseAND(F.bitwise_not(every)).alias("sb"), infinity(width).alias("inf"))

    def with_parts(p: Column) -> Column:
        every, ma, mb, inf = p["every"], p["ma"], p["mb"], p["inf"]
        minus_a, minus_b, plus_b = p["sa"] != 0, (p["sb"] != 0) & (mb != 0), (p["sb"] == 0) & (mb != 0)
        # flips after which the magnitude does not exceed infinity's, and after which it is below or equal to the other one
        sets = F.struct(flips_below(ma, inf).bitwiseOR(flips_equal(ma, inf)).bitwiseAND(every).alias("fits"), flips_below(ma, mb).bitwiseAND(every).alias("smaller"), flips_equal(ma, mb).bitwiseAND(every).alias("same"))

        def with_sets(q: Column) -> Column:
            greater = every.bitwiseAND(F.bitwise_not(q["smaller"].bitwiseOR(q["same"])))
            below = F.when(~minus_a, F.when(minus_b, none).otherwise(q["smaller"])).otherwise(F.when(plus_b, every).otherwise(greater))
            equal = F.when((~minus_a & minus_b) | (minus_a & plus_b), none).otherwise(q["same"])
            unordered = F.when(mb > inf, every).otherwise(every.bitwiseAND(F.bitwise_not(q["fits"])))
            return let(F.struct(below.alias("b"), equal.alias("e"), unordered.alias("u")), lambda r: _holds(comparator, r["b"], r["e"], every, r["u"]))

        def now(minus: Column) -> Column:
            lower = F.when(minus & (ma != 0), F.when(minus_b, ma > mb).otherwise(F.lit(True))).otherwise(F.when(minus_b, F.lit(False)).otherwise(ma < mb))
            equal = (ma == mb) & ((ma == 0) | (minus == minus_b))
            known = (ma <= inf) & (mb <= inf)
            return let(F.struct(_as_mask(lower & known).alias("b"), _as_mask(equal & known).alias("e"), _as_mask(~known).alias("u")), lambda r: _holds(comparator, r["b"], r["e"], F.lit(1).cast("long"), r["u"])) == 1

        sign = ones(width).bitwiseXOR(every)
        return F.struct(let(sets, with_sets).bitwiseOR(F.when(now(~minus_a), sign).otherwise(none)).alias("flips"), now(minus_a).alias("now"))

    return let(named, with_parts)


def _int_flips(comparator: Column, a: Column, b: Column, width: Column) -> Column:
    """{flips of a after which the comparison of unsigned numbers holds, whether it holds as it is}."""
    sets = F.struct(flips_below(a, b).alias("b"), flips_equal(a, b).alias("e"), ones(width).alias("every"))
    flips = let(sets, lambda q: _holds(comparator, q["b"].bitwiseAND(q["every"]), q["e"], q["every"]))
    now = let(F.struct(_as_mask(less(a, b)).alias("b"), _as_mask(a == b).alias("e")), lambda q: _holds(comparator, q["b"], q["e"], F.lit(1).cast("long"))) == 1
    return F.struct(flips.alias("flips"), now.alias("now"))


def _flips(comparator: Column, kind: Column, width: Column, a: Column, b: Column) -> Column:
    return F.when(kind == "f", _float_flips(comparator, a, b, width)).otherwise(_int_flips(comparator, a, b, width))


def _sides(kind: Column, width: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Both patterns cut to the width, the sign bit inverted where they are signed."""
    every = ones(width)
    turn = F.when(kind == "s", every.bitwiseXOR(F.shiftrightunsigned(every, 1))).otherwise(F.lit(0).cast("long"))
    return a.bitwiseAND(every).bitwiseXOR(turn), b.bitwiseAND(every).bitwiseXOR(turn)


def _named(comparator: Column | str, kind: Column | str, width: Column | int, a: Column, b: Column) -> Column:
    comparator, kind, width = _lit(comparator), _lit(kind), _lit(width).cast("int")
    x, y = _sides(kind, width, a, b)
    other = F.coalesce(F.element_at(F.create_map(*[F.lit(z) for pair in MIRRORED.items() for z in pair]), comparator), comparator)
    return F.struct(comparator.alias("c"), other.alias("o"), kind.alias("k"), width.alias("w"), x.alias("x"), y.alias("y"))


def holds(comparator: Column | str, kind: Column | str, width: Column | int, a: Column, b: Column) -> Column:
    """Whether a compares so with b; kind: u (also for bits), s or f. NaN is unordered; ``ne`` and the comparators that end in u hold for it."""
    return let(_named(comparator, kind, width, a, b), lambda n: _flips(n["c"], n["k"], n["w"], n["x"], n["y"])["now"])


def toggles(comparator: Column | str, kind: Column | str, width: Column | int, a: Column, b: Column) -> tuple[Column, Column]:
    """(bits of a, bits of b) whose flip, of one bit alone, turns the comparison."""

    def turned(n: Column, side: str, first: str, second: str) -> Column:
        return let(_flips(n[side], n["k"], n["w"], n[first], n[second]), lambda r: F.when(r["now"], F.bitwise_not(r["flips"])).otherwise(r["flips"]).bitwiseAND(ones(n["w"])))

    named = _named(comparator, kind, width, a, b)
    return let(named, lambda n: turned(n, "c", "x", "y")), let(named, lambda n: turned(n, "o", "y", "x"))


def setp_shape(opcode: Column, widths: Column) -> Column:
    """comparator, kind (u, s, f) and width of a setp instruction's text; null where it names no comparator.

    Without a type the comparison is unsigned and as wide as the widest of its two sources, else 32 bits.
    """
    op = F.regexp_extract(F.lower(F.trim(opcode)), r"^([^\s,%;]*)", 1)
    found = F.regexp_extract(op, rf"\.({'|'.join(sorted(COMPARATORS, key=len, reverse=True))})(?=\.|$)", 1)
    typed = lambda group: F.try_element_at(F.regexp_extract_all(op, F.lit(r"\.([subf])(\d+)(?=\.|$)"), F.lit(group)), F.lit(-1))
    kind = F.coalesce(F.when(typed(1) == "b", "u").otherwise(typed(1)), F.lit("u"))
    known = F.array_max(F.slice(F.coalesce(widths, F.array().cast("array<int>")), 1, 2))
    width = F.coalesce(F.when(typed(2).cast("int") > 0, typed(2).cast("int")), F.when(known > 0, known.cast("int")), F.lit(32))
    return F.when(op.startswith("setp") & (found != ""), F.struct(found.alias("comparator"), kind.alias("kind"), F.least(width, F.lit(64)).alias("width")))
