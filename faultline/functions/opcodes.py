"""From instruction text to operators, and how many sources of which width an operator has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an opcode starts with, what it must contain, and its operator; the first that fits counts.
RULES = (
    ("mul.lo", "", "MUL_LO"),
    *((name, ".f32", f"{name.upper()}_F32") for name in ("div", "sqrt", "add", "sub", "neg", "mul")),
    ("mul.wide", ".s32", "MUL_WIDE_S32"), ("mul.wide", "", "MUL_WIDE_U32"), ("mov", "", "IDENTITY"), ("cvta", "", "IDENTITY"), ("mad", "", "MAD"), ("fma", ".f32", "FMA_F32"), ("abs", ".f32", "ABS_F32"),
    ("ex2", ".f32", "EX2_APPROX_FTZ_F32"), ("rcp", ".f32", "RCP_APPROX_FTZ_F32"), ("min", ".f32", "MIN_F32"), ("max", ".f32", "MAX_F32"),
    ("add", "", "ADD"), ("sub", "", "SUB"), ("neg", "", "NEG"), ("not", ".pred", "NOT_PRED"), ("not", "", "NOT"), ("and", "", "AND"), ("or", "", "OR"), ("xor", "", "XOR"), ("shl", "", "SHL"),
    ("shr", ".s", "SHR_S"), ("shr", "", "SHR_U"), ("min", ".s", "MIN_S"), ("min", "", "MIN_U"), ("max", ".s", "MAX_S"), ("max", "", "MAX_U"), ("popc", "", "POPC"), ("clz", "", "CLZ"), ("brev", "", "BREV"),
    ("bfe", ".s", "BFE_S"), ("bfe", "", "BFE_U"), ("lop3", "", "LOP3"), ("cvt", ".u64.u32", "CVT_U32_U64"), ("cvt", ".u32.u64", "CVT_U64_U32"), ("cvt", ".s64.s32", "CVT_S32_S64"), ("cvt", ".s32.s64", "CVT_S64_S32"), ("selp", "", "SELP"),
)
COMPARES = "eq|ne|ltu|leu|gtu|geu|lt|le|gt|ge"
#: operators' own names that hold an underscore, as they may be written instead of an opcode.
NAMES = (
    *"add_f32 div_f32 sqrt_f32 sub_f32 neg_f32 mul_lo mul_f32 mul_wide_u32 mul_wide_s32 fma_f32 abs_f32 ex2_approx_ftz_f32 rcp_approx_ftz_f32 min_f32 max_f32 shr_u shr_s min_u min_s max_u max_s".split(),
    *"cvt_u32_u64 cvt_u64_u32 cvt_s32_s64 cvt_s64_s32 cvt_sat_f32_f32 bfe_u bfe_s addr_sum setp_eq setp_ne".split(),
    *(f"setp_{c}_{k}" for c in ("lt", "le", "gt", "ge") for k in "us"),
    *(f"setp_{c}_f{w}" for c in ("eq", "ne", "lt", "le", "gt", "ge", "ltu", "leu", "gtu", "geu") for w in (16, 32, 64)),
)
#: The order in which comparators are looked for where no part of the text is one.
LOOSE = ("ltu", "leu", "gtu", "geu", "eq", "ne", "lt", "le", "gt", "ge")
#: Operators of one, three and four sources; all others have two.
UNARY = ("IDENTITY", "NEG", "NEG_F32", "SQRT_F32", "NOT", "NOT_PRED", "POPC", "CLZ", "BREV", "CVT_U32_U64", "CVT_U64_U32", "CVT_S32_S64", "CVT_S64_S32", "CVT_SAT_F32_F32", "ABS_F32", "EX2_APPROX_FTZ_F32", "RCP_APPROX_FTZ_F32")
TERNARY = ("MAD", "SELP", "FMA_F32", "BFE_U", "BFE_S")
WIDENING, NARROWING, WIDE = ("CVT_U32_U64", "CVT_S32_S64"), ("CVT_U64_U32", "CVT_S64_S32"), ("MUL_WIDE_U32", "MUL_WIDE_S32")


def operator(text: Column) -> Column:
    """The operator of an instruction's text; unknown ones in upper case.

    ``NAMES`` are operators already. Other text with underscores goes by the rules, so ``add_u32`` is ADD.
    """
    op = F.regexp_extract(F.lower(F.trim(text)), r"^([^\s,%;]*)", 1)
    out = F.upper(F.trim(text))
    # comparisons: the first comparator, and the last type among the parts
    found = F.regexp_extract(op, rf"\.({COMPARES})(?=\.|$)", 1)
    loose = F.coalesce(*[F.when(op.contains(f".{c}") | op.contains(f"_{c}_"), c) for c in LOOSE], F.lit(""))
    found = F.when(found != "", found).otherwise(loose)
    kinds = F.regexp_extract_all(op, F.lit(r"\.([subf])\d+(?=\.|$)"), F.lit(1))
    widths = F.regexp_extract_all(op, F.lit(r"\.[subf](\d+)(?=\.|$)"), F.lit(1))
    kind, width = F.try_element_at(kinds, F.lit(-1)), F.try_element_at(widths, F.lit(-1))
    name, plain = F.upper(found), F.upper(F.regexp_replace(found, "u$", ""))
    compare = (
        F.when(kind == "f", F.concat(F.lit("SETP_"), name, F.lit("_F"), F.when(width.isin("16", "64"), width).otherwise("32")))
        .when(found.isin("eq", "ne"), F.concat(F.lit("SETP_"), name))
        .otherwise(F.concat(F.lit("SETP_"), plain, F.when((kind == "s") & ~found.endswith("u"), "_S").otherwise("_U")))
    )
    out = F.when(op.startswith("setp") & (found != ""), compare).otherwise(out)
    for start, part, to in reversed(RULES):
        out = F.when(op.startswith(start) & (op.contains(part) if part else F.lit(True)), to).otherwise(out)
    out = F.when(op.startswith("cvt") & op.contains(".sat") & op.contains(".f32.f32"), "CVT_SAT_F32_F32").otherwise(out)
    return F.when(op.isin(*NAMES), F.upper(op)).otherwise(out)


def source_count(op: Column) -> Column:
    return F.when(op.isin(*UNARY), 1).when(op.isin(*TERNARY), 3).when(op == "LOP3", 4).otherwise(2)


def result_width(op: Column, width: Column) -> Column:
    """Bits of an operator's result, from those of the instruction."""
    one = (op == "NOT_PRED") | op.startswith("SETP_")
    return F.when(one, 1).when(op.isin("POPC", "CLZ", *NARROWING), 32).when(op.isin(*WIDENING, *WIDE), 64).otherwise(width)


def source_width(op: Column, width: Column, index: Column) -> Column:
    """Bits of source ``index`` (from 0)."""
    narrow = op.isin(*WIDENING, *WIDE) | (op.isin("BFE_U", "BFE_S") & index.isin(1, 2))
    return F.when(narrow, 32).when(op.isin(*NARROWING), 64).when((op == "SELP") & (index == 2), 1).when((op == "LOP3") & (index == 3), 8).otherwise(width)
