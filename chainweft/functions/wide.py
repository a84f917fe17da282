"""Exact arithmetic on amounts wider than ``decimal(38, 0)``.

Raw amounts are decimal strings of up to 78 digits (256 bits); sums can be
longer.  An amount is cut from the right into limbs of 27 digits held as
``decimal(27, 0)``; the limbs are summed on their own (ordinary partial
aggregation) and one carry pass turns the limb sums back into a decimal
string.  Spark widens the sum to ``decimal(37, 0)``, room for 1e10 addends per
group, and ANSI mode raises rather than wraps beyond that.  Upper limbs of
short amounts are null and cost the sum nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 27
LIMBS = 3
WIDTH = DIGITS * LIMBS
BASE = 10**DIGITS
#: Lifts every ``decimal(37, 0)`` above zero.
LIFT = 10**10


def _number(value: int) -> Column:
    return F.lit(Decimal(value))


def padded(amount: Column) -> Column:
    """Fixed-width form: comparing two padded amounts compares their values."""
    return F.lpad(amount, WIDTH, "0")


def compared(amount: Column) -> Column:
    """A form of any width: comparing two of them compares the amounts' values."""
    stripped = F.ltrim(amount, F.lit("0"))
    return F.struct(F.length(stripped).alias("size"), stripped.alias("digits"))


def limbs(amount: Column, count: int = LIMBS) -> list[Column]:
    """Most significant limb first; a limb the amount does not reach is null."""
    kind = f"decimal({DIGITS},0)"
    size = F.length(amount)
    out = [F.right(amount, F.lit(DIGITS)).cast(kind)]
    for k in range(1, count):
        rest = F.left(amount, size - k * DIGITS)
        out.append(F.when(size > k * DIGITS, (rest if k == count - 1 else F.right(rest, F.lit(DIGITS))).cast(kind)))
    return out[::-1]


def whole_limbs(amount: Column, count: int = LIMBS) -> list[Column]:
    """Limbs with zero where the amount does not reach, for row-level arithmetic."""
    return [F.coalesce(limb, _number(0)) for limb in limbs(amount, count)]


def _floor_div(value: Column) -> Column:
    """Floor division by BASE that mentions ``value`` once.

    ``div`` truncates, so the value is first lifted above zero.  Mentioning the
    value twice would double the carry expression at every limb.
    """
    return F.call_function("div", value + _number(LIFT * BASE), _number(BASE)) - F.lit(LIFT)


def _carried(parts: Sequence[Column]) -> tuple[Column, list[Column]]:
    """(carry out of the top limb, limbs in 0..BASE-1, most significant first)."""
    out: list[Column] = []
    carry = F.lit(0).cast("bigint")
    for part in reversed(list(parts)):
        total = part.cast("decimal(37,0)") + carry.cast("decimal(20,0)")
        out.append(F.pmod(total, _number(BASE)))
        carry = _floor_div(total)
    return carry, out[::-1]


def _text(parts: Sequence[Column]) -> Column:
    digits = F.concat(*[F.lpad(p.cast(f"decimal({DIGITS},0)").cast("string"), DIGITS, "0") for p in parts])
    stripped = F.ltrim(digits, F.lit("0"))
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def _single(parts: Sequence[Column]) -> tuple[Column, Column]:
    """(the sum sits in the lowest limb alone, that limb)."""
    *upper, low = parts
    alone = F.abs(low) < _number(BASE)
    for part in upper:
        alone = alone & (part == 0)
    return alone, low


def joined(parts: Sequence[Column]) -> Column:
    """Limb sums of non-negative addends back to one decimal string.

    Sums below 27 digits, nearly all in practice, skip the carry pass.
    """
    alone, low = _single(parts)
    _, digits = _carried(parts)
    return F.when(alone, low.cast("string")).otherwise(_text(digits))


def joined_signed(parts: Sequence[Column]) -> Column:
    """Limb sums that may be negative overall; the sign is part of the string."""
    alone, low = _single(parts)
    carry, digits = _carried(parts)
    _, negated = _carried([-p for p in parts])
    return (
        F.when(alone, low.cast("string"))
        .when(carry < 0, F.concat(F.lit("-"), _text(negated)))
        .otherwise(_text(digits))
    )


def total(amount: Column, keep: Column | None = None) -> Column:
    """One-expression exact sum of raw amounts (``sumIf`` when ``keep`` is given)."""
    parts = limbs(amount if keep is None else F.when(keep, amount))
    return joined([F.coalesce(F.sum(p), _number(0)) for p in parts])


def net(plus: Column, minus: Column) -> Column:
    """Exact signed ``sum(plus) - sum(minus)``; nulls count as nothing."""
    up, down = limbs(plus), limbs(minus)
    zero = _number(0)
    return joined_signed(
        [F.coalesce(F.sum(u), zero) - F.coalesce(F.sum(d), zero) for u, d in zip(up, down)]
    )


def sign(amount: Column) -> Column:
    """-1, 0 or 1 of a signed decimal string."""
    return (
        F.when(amount.startswith("-"), F.lit(-1)).when(amount == "0", F.lit(0)).otherwise(F.lit(1))
    )


HEX_DIGITS = 9
HEX_LIMBS = 9
HEX_BASE = 10**HEX_DIGITS


def from_hex(word: Column) -> Column:
    """A 64-digit hex word (no prefix) as a decimal string.

    ``conv`` stops at 64 bits, so the word is folded from 4-hex-digit chunks:
    each step multiplies the limbs by 65536, adds the chunk and carries.
    """
    chunks = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.conv(F.substring(word, i * 4 + F.lit(1), F.lit(4)), 16, 10).cast("bigint"),
    )
    start = F.array_repeat(F.lit(0).cast("bigint"), HEX_LIMBS)

    def shift(acc: Column, chunk: Column) -> Column:
        # least significant limb first inside the fold
        grown = F.aggregate(
            acc,
            F.struct(chunk.alias("carry"), F.array().cast("array<bigint>").alias("out")),
            lambda s, limb: F.struct(
                F.call_function("div", limb * F.lit(65536) + s["carry"], F.lit(HEX_BASE)).alias("carry"),
                F.concat(
                    s["out"], F.array(F.pmod(limb * F.lit(65536) + s["carry"], F.lit(HEX_BASE)))
                ).alias("out"),
            ),
        )
        return grown["out"]

    folded = F.aggregate(chunks, start, shift)
    text = F.array_join(
        F.transform(F.reverse(folded), lambda v: F.lpad(v.cast("string"), HEX_DIGITS, "0")), ""
    )
    stripped = F.ltrim(text, F.lit("0"))
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def scaled(amount: Column, decimals: Column) -> Column:
    """Raw amount to a decimal number text with trailing zeros removed."""
    places = decimals.cast("int")
    width = F.greatest(F.length(amount), places + F.lit(1))
    text = F.lpad(amount, width, F.lit("0"))
    whole = F.substring(text, F.lit(1), width - places)
    part = F.rtrim(F.substring(text, width - places + F.lit(1), places), F.lit("0"))
    return F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))


def unscaled(text: Column, decimals: Column) -> Column:
    """The inverse of :func:`scaled`; null when the text has too many places."""
    places = decimals.cast("int")
    bits = F.split(text, "\\.")
    part = F.coalesce(F.try_element_at(bits, F.lit(2)), F.lit(""))
    raw = F.ltrim(F.concat(bits[0], F.rpad(part, places, F.lit("0"))), F.lit("0"))
    fits = text.rlike("^[0-9]+(\\.[0-9]+)?$") & (F.length(part) <= places)
    return F.when(fits, F.when(raw == "", F.lit("0")).otherwise(raw))
