"""Scalar functions on trace values, as Catalyst expressions.

A register value is a ``LongType`` bit pattern (two's complement stands for unsigned 64 bits).
``w`` is the width in bits; results are cut to it. Arithmetic works on 16- or 32-bit limbs, so
it wraps instead of raising an overflow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
MIN64 = -(1 << 63)


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def full(w: int) -> int:
    """All ones of width ``w`` as a signed long."""
    return -1 if w == 64 else (1 << w) - 1


def cut(x: Column, w: int) -> Column:
    return x if w == 64 else x.bitwiseAND(F.lit(full(w)).cast("long"))


def signed(x: Column, w: int) -> Column:
    """The value of ``x`` read as a signed number of width ``w``."""
    return x if w == 64 else F.shiftright(F.shiftleft(x, 64 - w), 64 - w)


# bits


def and_(a: Column, b: Column, w: int) -> Column:
    return cut(a.bitwiseAND(_c(b)), w)


def or_(a: Column, b: Column, w: int) -> Column:
    return cut(a.bitwiseOR(_c(b)), w)


def xor(a: Column, b: Column, w: int) -> Column:
    return cut(a.bitwiseXOR(_c(b)), w)


def not_(a: Column, w: int) -> Column:
    return cut(F.bitwise_not(a), w)


def not_pred(a: Column) -> Column:
    return F.when(a.bitwiseAND(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")


def and_not(a: Column, b: Column, w: int) -> Column:
    return and_(a, F.bitwise_not(b), w)


def or_not(a: Column, b: Column, w: int) -> Column:
    return or_(a, F.bitwise_not(b), w)


def nand(a: Column, b: Column, w: int) -> Column:
    return not_(a.bitwiseAND(b), w)


def nor(a: Column, b: Column, w: int) -> Column:
    return not_(a.bitwiseOR(b), w)


def is_zero(a: Column, w: int) -> Column:
    """1 if the value is zero, else 0."""
    return F.when(cut(a, w) == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")


# arithmetic


def add(a: Column, b: Column, w: int = 64) -> Column:
    a, b = _c(a), _c(b)
    low = a.bitwiseAND(F.lit(M32)) + b.bitwiseAND(F.lit(M32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return cut(F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(M32))), w)


def neg(a: Column, w: int = 64) -> Column:
    return add(F.bitwise_not(_c(a)), _c(1), w)


def sub(a: Column, b: Column, w: int = 64) -> Column:
    return add(a, neg(b), w)


def _wide(a: Column, b: Column) -> Column:
    """The 64-bit pattern of the product of two unsigned 32-bit numbers."""
    b0, b1 = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return add(a * b0, F.shiftleft(a * b1, 16))


def mul_lo(a: Column, b: Column, w: int = 64) -> Column:
    a, b = _c(a), _c(b)
    al, bl = a.bitwiseAND(F.lit(M32)), b.bitwiseAND(F.lit(M32))
    if w <= 32:
        return cut(_wide(al, bl), w)
    cross = add(_wide(F.shiftrightunsigned(a, 32), bl), _wide(al, F.shiftrightunsigned(b, 32)))
    return add(_wide(al, bl), F.shiftleft(cross, 32), w)


def mul_wide_u32(a: Column, b: Column) -> Column:
    return _wide(cut(a, 32), cut(b, 32))


def mul_wide_s32(a: Column, b: Column) -> Column:
    return signed(a, 32) * signed(b, 32)


def mad(a: Column, b: Column, c: Column, w: int = 64) -> Column:
    return add(mul_lo(a, b, w), c, w)


def mul24(a: Column, b: Column) -> Column:
    """Low 32 bits of the product of the low 24 bits, unsigned."""
    return cut(cut(a, 24) * cut(b, 24), 32)


def sad(a: Column, b: Column, c: Column, w: int) -> Column:
    """Sum of c and the absolute difference of unsigned a and b."""
    return add(F.when(less_u(a, b), sub(b, a, w)).otherwise(sub(a, b, w)), c, w)


def div_u(a: Column, b: Column, w: int) -> Column:
    """Unsigned quotient of up to 32 bits; all ones by zero."""
    a, b = cut(a, w), cut(b, w)
    return F.when(b == 0, F.lit((1 << w) - 1)).otherwise(F.floor((a - F.pmod(a, F.when(b != 0, b))) / F.when(b != 0, b))).cast("long")


def rem_u(a: Column, b: Column, w: int) -> Column:
    """Unsigned remainder of up to 32 bits; the dividend by zero."""
    a, b = cut(a, w), cut(b, w)
    return F.when(b == 0, a).otherwise(F.pmod(a, F.when(b != 0, b)))


def _by_size(a: Column, b: Column, w: int, of: Callable[[Column, Column, int], Column], sign: Column) -> Column:
    """``of`` on absolute values, with the sign where it holds."""
    x = of(F.abs(signed(a, w)), F.abs(signed(b, w)), w)
    return cut(F.when(sign, neg(x, w)).otherwise(x), w)


def div_s(a: Column, b: Column, w: int) -> Column:
    """Signed quotient towards zero of up to 32 bits; all ones by zero."""
    zero = cut(b, w) == 0
    return F.when(zero, F.lit((1 << w) - 1)).otherwise(_by_size(a, b, w, div_u, (signed(a, w) < 0) != (signed(b, w) < 0)))


def rem_s(a: Column, b: Column, w: int) -> Column:
    """Signed remainder with the dividend's sign, of up to 32 bits; the dividend by zero."""
    return _by_size(a, b, w, rem_u, signed(a, w) < 0)


def add_carry(a: Column, b: Column, carry: Column, w: int) -> tuple[Column, Column]:
    """(sum, carry out) of up to 32 bits with a carry in of 0 or 1."""
    total = cut(a, w) + cut(b, w) + carry
    return cut(total, w), F.call_function("shiftrightunsigned", total, F.lit(w)).cast("long")


def mad_carry(a: Column, b: Column, c: Column, carry: Column, w: int, high: bool = False) -> tuple[Column, Column]:
    """(sum, carry out) of the low or high half of a product of up to 32 bits, c and a carry in."""
    product = _wide(cut(a, w), cut(b, w))
    return add_carry(F.call_function("shiftrightunsigned", product, F.lit(w)) if high else product, c, carry, w)


# comparison


def _flipped(a: Column) -> Column:
    return a.bitwiseXOR(F.lit(MIN64).cast("long"))


def less_u(a: Column, b: Column) -> Column:
    return _flipped(a) < _flipped(b)


def min_u(a: Column, b: Column) -> Column:
    return F.when(less_u(a, b), a).otherwise(b)


def max_u(a: Column, b: Column) -> Column:
    return F.when(less_u(a, b), b).otherwise(a)


def min_s(a: Column, b: Column, w: int) -> Column:
    return cut(F.least(signed(a, w), signed(b, w)), w)


def max_s(a: Column, b: Column, w: int) -> Column:
    return cut(F.greatest(signed(a, w), signed(b, w)), w)


def setp(kind: str, a: Column, b: Column, w: int, is_signed: bool = False) -> Column:
    """eq, ne, lt, le, gt, ge at the declared width: 1 or 0."""
    a, b = (signed(a, w), signed(b, w)) if is_signed else (_flipped(cut(a, w)), _flipped(cut(b, w)))
    test = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[kind]
    return F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("long")


def selp(a: Column, b: Column, p: Column) -> Column:
    return F.when(p.bitwiseAND(F.lit(1)) != 0, a).otherwise(b)


def slct(a: Column, b: Column, c: Column, w: int = 32) -> Column:
    """a where c, read as signed, is not negative, else b."""
    return F.when(signed(c, w) >= 0, a).otherwise(b)


# shifts: two rules for amounts of at least the width


def shl(a: Column, n: Column, w: int) -> Column:
    """The amount counts modulo the width."""
    return cut(F.call_function("shiftleft", a, _c(n).bitwiseAND(F.lit(w - 1)).cast("int")), w)


def shr_u(a: Column, n: Column, w: int) -> Column:
    return F.call_function("shiftrightunsigned", cut(a, w), _c(n).bitwiseAND(F.lit(w - 1)).cast("int"))


def shr_s(a: Column, n: Column, w: int) -> Column:
    return cut(F.call_function("shiftright", signed(a, w), _c(n).bitwiseAND(F.lit(w - 1)).cast("int")), w)


def shl_clamped(a: Column, n: Column, w: int) -> Column:
    """An amount of the width or more gives zero."""
    return F.when(_c(n) >= w, F.lit(0).cast("long")).otherwise(shl(a, n, w))


def shr_u_clamped(a: Column, n: Column, w: int) -> Column:
    return F.when(_c(n) >= w, F.lit(0).cast("long")).otherwise(shr_u(a, n, w))


# bit fields


def popc(a: Column, w: int) -> Column:
    return F.bit_count(cut(a, w)).cast("long")


def _bin(a: Column, w: int) -> Column:
    return F.lpad(F.bin(cut(a, w)), w, "0")


def _from_bin(text: Column) -> Column:
    """The signed long with this pattern of up to 64 binary digits."""
    high = F.conv(F.substring(F.lpad(text, 64, "0"), 1, 32), 2, 10).cast("long")
    low = F.conv(F.substring(F.lpad(text, 64, "0"), 33, 32), 2, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def clz(a: Column, w: int) -> Column:
    return F.when(cut(a, w) == 0, F.lit(w)).otherwise(w - F.length(F.bin(cut(a, w)))).cast("long")


def bfind(a: Column, w: int) -> Column:
    """Position of the highest set bit, all ones (32 bits) if none."""
    return F.when(cut(a, w) == 0, F.lit(M32)).otherwise(F.length(F.bin(cut(a, w))) - 1).cast("long")


def brev(a: Column, w: int) -> Column:
    return _from_bin(F.reverse(_bin(a, w)))


def _ones(n: Column) -> Column:
    return F.when(n >= 64, F.lit(-1).cast("long")).when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1)


def bfe_u(a: Column, pos: Column, size: Column, w: int) -> Column:
    """``size`` bits of a from ``pos``, both modulo 256; a size of 0 or a start past the width gives 0, bits beyond the width are left out."""
    pos, size = _c(pos).bitwiseAND(F.lit(255)), _c(size).bitwiseAND(F.lit(255))
    moved = F.when(pos >= w, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", cut(a, w), F.least(pos, F.lit(w - 1)).cast("int")))
    return moved.bitwiseAND(_ones(size))


def bfe_s(a: Column, pos: Column, size: Column, w: int) -> Column:
    """As ``bfe_u``, filled above with the top bit of the field as far as it lies within the width."""
    pos, size = _c(pos).bitwiseAND(F.lit(255)), _c(size).bitwiseAND(F.lit(255))
    field, kept = bfe_u(a, pos, size, w), F.least(size, w - pos)
    bit = F.call_function("shiftrightunsigned", field, F.greatest(kept - 1, F.lit(0)).cast("int")).bitwiseAND(F.lit(1))
    filled = cut(field.bitwiseOR(F.bitwise_not(_ones(kept))), w)
    return F.when((kept > 0) & (bit == 1), filled).otherwise(field)


def bfi(a: Column, b: Column, pos: Column, size: Column, w: int) -> Column:
    """b with ``size`` of its bits from ``pos`` replaced by a's low bits."""
    mask = F.when(_c(pos) >= w, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", _ones(_c(size)), F.least(_c(pos), F.lit(w - 1)).cast("int")))
    moved = F.call_function("shiftleft", _c(a), F.least(_c(pos), F.lit(w - 1)).cast("int"))
    return cut(b.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(moved.bitwiseAND(mask)), w)


def lop3(a: Column, b: Column, c: Column, table: int, w: int) -> Column:
    """Any function of three bits: bit a + 2 b + 4 c of ``table``."""
    out = F.lit(0).cast("long")
    for k in range(8):
        if table >> k & 1:
            terms = [x if k >> i & 1 else F.bitwise_not(x) for i, x in enumerate((a, b, c))]
            out = out.bitwiseOR(terms[0].bitwiseAND(terms[1]).bitwiseAND(terms[2]))
    return cut(out, w)


def prmt(a: Column, b: Column, selector: Column) -> Column:
    """Four bytes picked out of the eight of b:a; a selector's top bit repeats the byte's sign."""
    both = F.shiftleft(cut(b, 32), 32).bitwiseOR(cut(a, 32))
    out = F.lit(0).cast("long")
    for i in range(4):
        s = F.shiftrightunsigned(_c(selector), 4 * i).bitwiseAND(F.lit(15))
        byte = F.call_function("shiftrightunsigned", both, (s.bitwiseAND(F.lit(7)) * 8).cast("int")).bitwiseAND(F.lit(255))
        byte = F.when(s >= 8, F.when(byte >= 128, F.lit(255)).otherwise(F.lit(0))).otherwise(byte).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return out


# conversion and video


def cvt(a: Column, src: int, dst: int, src_signed: bool) -> Column:
    return cut(signed(a, src) if src_signed else cut(a, src), dst)


def vminmax(kind: str, a: Column, b: Column, c: Column | None = None, second: str | None = None, w: int = 32) -> Column:
    """Signed minimum or maximum of two, and of a third if given."""
    pick = {"min": F.least, "max": F.greatest}
    out = pick[kind](signed(a, w), signed(b, w))
    return cut(pick[second](out, signed(c, w)) if second else out, w)


TRANSCENDENTAL = {
    "sin": F.sin, "cos": F.cos, "ex2": lambda x: F.pow(F.lit(2.0), x), "lg2": lambda x: F.log2(x), "rcp": lambda x: F.try_divide(F.lit(1.0), x),
    "rsqrt": lambda x: F.try_divide(F.lit(1.0), F.sqrt(x)), "sqrt": F.sqrt, "abs": F.abs, "neg": lambda x: -x,
}


# backward influence: which bits of a source can change live bits of the result


def influence(op: str, live: Column, a: Column, b: Column, w: int, which: int = 0) -> Column:
    """Closed forms. ``which`` is the source asked about; live is the mask of live result bits.

    identity, not, xor: every live bit; and: where the other source is 1; or: where it is 0;
    shl, shr_u (b is the amount): the live mask moved back; selp (b is the predicate).
    """
    live, other = cut(live, w), b if which == 0 else a
    n = _c(b).bitwiseAND(F.lit(w - 1)).cast("int")
    forms = {
        "identity": lambda: live, "not": lambda: live, "xor": lambda: live, "and": lambda: live.bitwiseAND(other), "or": lambda: live.bitwiseAND(F.bitwise_not(other)),
        "shl": lambda: F.call_function("shiftrightunsigned", live, n), "shr_u": lambda: F.call_function("shiftleft", live, n),
        "selp": lambda: F.when((b.bitwiseAND(F.lit(1)) != 0) == F.lit(which == 0), live).otherwise(F.lit(0).cast("long")),
    }
    return cut(forms[op](), w)


def influence_by_flips(result, a: Column, live: Column, w: int) -> Column:
    """Brute force: flip each bit of ``a``, and keep those that change a live bit of ``result(a)``."""
    base = result(a)
    out = F.lit(0).cast("long")
    for i in range(w):
        bit = F.lit(1 << i if i < 63 else MIN64).cast("long")
        changed = result(a.bitwiseXOR(bit)).bitwiseXOR(base).bitwiseAND(live) != 0
        out = out.bitwiseOR(F.when(changed, bit).otherwise(F.lit(0).cast("long")))
    return out


# address hashing


def set_index_xor(addr: Column, line: int, sets: int) -> Column:
    """Set bits xored with as many bits above them."""
    bits = sets.bit_length() - 1
    low = F.shiftrightunsigned(addr, line.bit_length() - 1)
    return low.bitwiseXOR(F.shiftrightunsigned(low, bits)).bitwiseAND(F.lit(sets - 1))


def set_index_linear(addr: Column, line: int, sets: int) -> Column:
    return F.shiftrightunsigned(addr, line.bit_length() - 1).bitwiseAND(F.lit(sets - 1))


def field(addr: Column, mask: int) -> Column:
    """The bits of ``addr`` under ``mask``, gathered to the low end."""
    out, at = F.lit(0).cast("long"), 0
    for i in range(64):
        if mask >> i & 1:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(addr, i).bitwiseAND(F.lit(1)), at))
            at += 1
    return out


#: Irreducible polynomials over GF(2) by the number of sets, and how many address bits above the index take part.
POLYNOMIALS = {16: 0b10011, 32: 0b100101, 64: 0b1000011}
FOLDED = {16: 13, 32: 15, 64: 19}


def set_index_polynomial(high: Column, index: Column, sets: int) -> Column:
    """The remainder of the address bits, as a polynomial over GF(2), by one of degree log2(sets).

    ``high``: address bits above ``index``. Bit i of high weighs x**(i + degree) modulo the polynomial.
    """
    degree, weight, out = sets.bit_length() - 1, 1, index.bitwiseAND(F.lit(sets - 1))
    for _ in range(degree):
        weight = weight << 1 ^ (POLYNOMIALS[sets] if weight >> (degree - 1) & 1 else 0)
    for i in range(FOLDED[sets]):
        out = out.bitwiseXOR(F.shiftrightunsigned(high, i).bitwiseAND(F.lit(1)) * weight)
        weight = weight << 1 ^ (POLYNOMIALS[sets] if weight >> (degree - 1) & 1 else 0)
    return out.cast("long")


#: For each bit of a page-entropy index over 32 sets, the address bits above the index and the bits of the index that it adds up.
PAGE_BITS = (((13, 10, 9, 5, 0), (3, 0, 0)), ((12, 11, 6, 1), (3, 2, 1, 1)), ((14, 9, 8, 7, 2), (1, 2)), ((11, 10, 8, 3), (2, 3, 3)), ((12, 9, 8, 5, 4), (1, 0, 4)))


def set_index_page(high: Column, index: Column) -> Column:
    """A set of 32 by sums modulo 2 of chosen page and index bits."""
    bit = lambda c, i: F.shiftrightunsigned(c, i).bitwiseAND(F.lit(1))
    out = F.lit(0).cast("long")
    for at, (page, low) in enumerate(PAGE_BITS):
        total = F.lit(0).cast("long")
        for c in [bit(high, i) for i in page] + [bit(index, i) for i in low]:
            total = total.bitwiseXOR(c)
        out = out.bitwiseOR(F.shiftleft(total, at))
    return out
