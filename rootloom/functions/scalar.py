"""Scalar functions on addresses, masks, keys, relations and weights, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_address(reg: Column, shift: Column, off: Column, off_reg: Column, off1: Column, segment: Column) -> Column:
    """reg * shift (0: as it is) + off (times off_reg, if any) + off1; no register gives 0; the es segment has no offset."""
    scaled = F.when(shift != 0, reg * shift).otherwise(reg)
    offset = F.when(F.lower(segment) == "es", F.lit(0)).otherwise(F.coalesce(off, F.lit(0)) * F.coalesce(off_reg, F.lit(1)) + F.coalesce(off1, F.lit(0)))
    return F.when(reg.isNull(), F.lit(0)).otherwise(scaled + offset).cast("long")


def shifted_address(reg: Column, shift: int, off: Column) -> Column:
    """The debugger's variant: reg shifted left by bits."""
    return F.shiftleft(reg, shift) + off


def load_mask(ops: Column, same_as_write: Column) -> Column:
    """OR over op lists of a fold from all ones: `and` masks, `shr` shifts left, `shl` right; 0 if the load is its own write.

    ops: array<array<struct<operation, operand>>>.
    """
    step = lambda m, o: F.when(o["operation"] == "and", m.bitwiseAND(o["operand"])).when(o["operation"] == "shr", F.call_function("shiftleft", m, o["operand"].cast("int"))).when(o["operation"] == "shl", F.call_function("shiftrightunsigned", m, o["operand"].cast("int"))).otherwise(m)
    one = lambda xs: F.aggregate(xs, F.lit(-1).cast("long"), step)
    return F.when(same_as_write, F.lit(0).cast("long")).otherwise(F.aggregate(F.transform(ops, one), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def store_mask(ops: Column) -> Column:
    """Bits that a read-modify-write changes: `and` those not in the operand, `or` those in it; any other op makes it unknown (null)."""
    bits = lambda o: F.when(o["operation"] == "and", F.bitwise_not(o["operand"])).when(o["operation"] == "or", o["operand"])
    return F.aggregate(ops, F.lit(0).cast("long"), lambda a, o: a.bitwiseOR(bits(o)))


def remaining_mask(rest: Column, store: Column) -> Column:
    return rest.bitwiseAND(F.bitwise_not(store.bitwiseAND(rest)))


def mask_bits(mask: Column) -> Column:
    return F.bit_count(mask)


def shift_mask(mask: Column, by: Column) -> Column:
    """Left by a positive number of bits, right by a negative."""
    return F.when(by >= 0, F.call_function("shiftleft", mask, by)).otherwise(F.call_function("shiftright", mask, -by))


def little_endian(values: Column) -> Column:
    """Bytes, least significant first, to a long."""
    return F.aggregate(F.reverse(values), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 8).bitwiseOR(b.cast("long")))


def from_hex(text: Column) -> Column:
    """A hex string with or without 0x; null beyond a signed long."""
    return F.try_to_number(F.conv(F.regexp_replace(F.lower(text), "^0x", ""), 16, 10), F.lit("99999999999999999999")).try_cast("long")


def signed_offset(text: Column) -> Column:
    """Hex offset; 8 or 16 digits that begin with f are negative."""
    digits = F.regexp_replace(F.lower(text), "^0x", "")
    low = F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long")
    high = F.conv(F.left(F.lpad(digits, 16, "0"), F.lit(8)), 16, 10).cast("long")
    return F.when((F.length(digits) == 8) & digits.startswith("f"), low - F.lit(1 << 32)).when((F.length(digits) == 16) & digits.startswith("f"), F.shiftleft(high - F.lit(1 << 32), 32) + low).otherwise(F.shiftleft(high, 32) + low)


# Canonical register, its names by width in bytes.
REGISTERS = {
    "rax": {"rax": 8, "eax": 4, "ax": 2, "ah": 1, "al": 1},
    "rbx": {"rbx": 8, "ebx": 4, "bx": 2, "bh": 1, "bl": 1},
    "rcx": {"rcx": 8, "ecx": 4, "cx": 2, "ch": 1, "cl": 1},
    "rdx": {"rdx": 8, "edx": 4, "dx": 2, "dh": 1, "dl": 1},
    "rsi": {"rsi": 8, "esi": 4, "si": 2, "sil": 1},
    "rdi": {"rdi": 8, "edi": 4, "di": 2, "dil": 1},
    "rbp": {"rbp": 8, "ebp": 4, "bp": 2, "bpl": 1},
    "rsp": {"rsp": 8, "esp": 4, "sp": 2, "spl": 1},
    **{f"r{n}": {f"r{n}": 8, f"r{n}d": 4, f"r{n}w": 2, f"r{n}b": 1} for n in range(8, 16)},
}
_NAMES = {name: (whole, width) for whole, names in REGISTERS.items() for name, width in names.items()}


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def canonical_register(name: Column) -> Column:
    return F.coalesce(F.element_at(_lookup({k: v[0] for k, v in _NAMES.items()}), F.lower(name)), F.lower(name))


def register_width(name: Column) -> Column:
    """Width in bytes; 8 for names that are not known."""
    return F.coalesce(F.element_at(_lookup({k: v[1] for k, v in _NAMES.items()}), F.lower(name)), F.lit(8))


def short_key(file: Column, line: Column) -> Column:
    return F.concat_ws("_", file, line.cast("string"))


def quad_key(file: Column, line: Column, total: Column, index: Column) -> Column:
    return F.concat_ws("_", file, line.cast("string"), total.cast("string"), index.cast("string"))


def caller_prefix(callers: Column) -> Column:
    """array of file:line, innermost first, to `outer|...|inner|`."""
    return F.array_join(F.transform(F.reverse(callers), lambda x: F.concat(x, F.lit("|"))), "")


def _hex_number(text: Column) -> Column:
    digits = F.conv(F.regexp_replace(text, "^-?(0[xX])?", ""), 16, 10).cast("long")
    return F.when(text.startswith("-"), -digits).otherwise(digits)


def parse_expression(text: Column) -> Column:
    """`type|reg + off + k*reg2` to struct(kind, reg, shift, off, off_reg, off1); numbers are hex, with or without 0x.

    The first number is the offset, the first bare name the register.  A scaled part is the register itself and its factor
    if there is no other; beside one it is the register that the offset is multiplied with, its factor (if not 1) the
    offset, and an offset given as well becomes off1.  Without text the kind is `empty`.
    """
    body = F.regexp_replace(F.regexp_replace(F.substring_index(text, "|", -1), r"\s+", ""), r"(?<=[A-Za-z0-9])-", "+-")
    parts = F.filter(F.split(body, r"\+"), lambda x: x != "")
    number = lambda x: x.rlike("^-?(0[xX])?[0-9a-fA-F]+$")
    first = lambda p: F.get(F.filter(parts, p), F.lit(0))
    none = F.lit(None).cast("string")
    start = F.struct(first(lambda x: ~x.contains("*") & ~number(x)).alias("reg"), F.lit("0").alias("shift"), F.coalesce(first(number), F.lit("0")).alias("off"), none.alias("off1"), none.alias("off_reg"))

    def scaled(at: Column, x: Column) -> Column:
        a, b = F.split_part(x, F.lit("*"), F.lit(1)), F.split_part(x, F.lit("*"), F.lit(2))
        n, reg = F.when(number(b), b).otherwise(a), F.when(number(b), a).otherwise(b)
        plain, given = at["reg"].isNull(), (n != "1") & (at["off"] != "0")
        return F.struct(
            F.coalesce(at["reg"], reg).alias("reg"), F.when(plain, n).otherwise(at["shift"]).alias("shift"), F.when(plain | (n == "1"), at["off"]).otherwise(n).alias("off"),
            F.when(~plain & given, at["off"]).otherwise(at["off1"]).alias("off1"), F.when(plain, at["off_reg"]).otherwise(reg).alias("off_reg"),
        )

    empty = F.coalesce(F.trim(text) == "", F.lit(True))
    found = F.element_at(F.transform(F.array(F.aggregate(F.filter(parts, lambda x: x.contains("*")), start, scaled)), lambda s: F.struct(s["reg"].alias("reg"), _hex_number(s["shift"]).alias("shift"), _hex_number(s["off"]).alias("off"), s["off_reg"].alias("off_reg"), _hex_number(s["off1"]).alias("off1"))), 1)
    kind = F.when(empty, "empty").when(text.contains("|"), F.substring_index(text, "|", 1))
    return F.struct(kind.alias("kind"), *[F.when(~empty, found[c]).alias(c) for c in ("reg", "shift", "off", "off_reg", "off1")])


def normalised_disassembly(text: Column) -> Column:
    """The opcode, then only what is neither letter nor digit in the arguments."""
    opcode = F.substring_index(text, " ", 1)
    return F.concat(opcode, F.regexp_replace(F.substring(text, F.length(opcode) + 1, F.length(text)), r"[\p{L}\p{Nd}]", ""))


def strip_prefix(path: Column, root: str) -> Column:
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def file_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def line_of(text: Column) -> Column:
    """The number after the last colon of file:line."""
    return F.substring_index(text, ":", -1).try_cast("int")


def event_key(*parts: Column) -> Column:
    return F.array_join(F.array(*[p.cast("string") for p in parts]), "_")


def unpack_write(reg: Column, off: Column, shift: Column) -> tuple[Column, Column, Column]:
    """Hex strings, lower case, of a memory write's parts; no register is an empty string."""
    return F.coalesce(F.lower(reg), F.lit("")), F.lower(F.hex(F.coalesce(off, F.lit(0)))), F.lower(F.hex(F.coalesce(shift, F.lit(0))))


# relations and weights


def relation_class(distinct: Column, low: Column, high: Column) -> Column:
    """irrelevant {0}, invariant {k}, conditional {0, k}, else variable."""
    return F.when((distinct == 1) & (high == 0), "irrelevant").when(distinct == 1, "invariant").when((distinct == 2) & (low == 0), "conditional").otherwise("variable")


def magnitude_difference(left: Column, right: Column) -> Column:
    return F.abs(left - right)


def correlation(magnitude: Column) -> Column:
    """min(m, 1/m); 0 without a magnitude."""
    return F.when(magnitude > 0, F.least(magnitude, 1 / magnitude)).otherwise(F.lit(0.0))


def boosted(corr: Column) -> Column:
    gap = F.abs(1 - corr)
    return corr + (gap - gap * gap)


def invariance_equal(ratio_l, cond_l, prop_l, n_l, ratio_r, cond_r, prop_r, n_r) -> Column:
    """Relaxed equality of two invariances.  Not symmetric, not transitive: a residual test, never a join key."""
    both = F.when(prop_l == prop_r, True).when((prop_l > 0) & (F.abs(prop_l - prop_r) / prop_l < 0.1), True).when(F.abs(prop_l - prop_r) < 0.01, True).otherwise(F.bround(n_l * prop_l) == F.bround(n_r * prop_r))
    mixed = F.when(cond_l, prop_l).otherwise(prop_r) >= 0.99
    return (ratio_l == ratio_r) & F.when(cond_l & cond_r, both).when(cond_l != cond_r, mixed).otherwise(True)


def forward_impact(left: Column, right: Column, perc: Column) -> Column:
    """The share of the left's contribution that its excess over the right explains."""
    return F.when((left > right) & (left != 0), (left - right) / left * perc).otherwise(F.lit(0.0))


def backward_impact(left_perc: Column, right_perc: Column) -> Column:
    return F.greatest(right_perc - left_perc, F.lit(0.0))


def negative_event(left: Column, right: Column, actual_left: Column, actual_right: Column) -> Column:
    """The left weighs at least a fifth less than the right, and is not actually heavier."""
    return (left < right) & ((right - left) / right >= 0.2) & ~(actual_left > actual_right)


def count_tolerance(left: Column, right: Column) -> Column:
    """Absolute counts alike: half apart if both are small, else a quarter."""
    far = F.abs(left - right) / F.greatest(left, right)
    return F.when(left + right <= 10, far <= 0.5).otherwise(far <= 0.25)


def weight_order(total: Column, corr: Column) -> Column:
    return F.struct(F.bround(total, 2).alias("total"), corr.alias("corr"))


def normalised_weight(weight: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(weight / n * 1000)
