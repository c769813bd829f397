"""Bit strings packed into 64-bit words, and the two bit distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vecspark.types import BIT_SQL, as_col, let, null_of, raising


def _pack(flags: Column) -> Column:
    """Pack an array of booleans, first flag in the highest bit of the first word."""
    return let(flags, _packed)


def _packed(flags: Column) -> Column:
    size = F.size(flags)
    word_no = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / 64).cast("int"))
                     ).otherwise(F.array().cast("array<int>"))
    words = F.transform(word_no, lambda w: F.aggregate(
        F.transform(F.slice(flags, w * 64 + 1, F.lit(64)),
                    lambda on, i: F.when(on, F.call_function("shiftleft", F.lit(1).cast("bigint"), 63 - i))
                    .otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)))
    return F.struct(size.alias("len"), words.alias("words")).cast(BIT_SQL)


def binary_quantize(v) -> Column:
    """One bit per element: is it above zero?"""
    v = as_col(v)
    return F.when(v.isNull(), null_of(BIT_SQL)).otherwise(_pack(F.transform(v, lambda x: x > 0)))


def bits_from_text(text) -> Column:
    """``'0101'`` to a bit string; other characters are an error."""
    text = as_col(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return (F.when(text.isNull(), null_of(BIT_SQL))
            .when(text.rlike("^[01]*$"), _pack(F.transform(chars, lambda c: c == "1")))
            .otherwise(raising(F.lit("bit string may hold only 0 and 1"), BIT_SQL)))


def bits_to_text(b) -> Column:
    b = as_col(b)
    digits = F.transform(b["words"], lambda w: F.lpad(F.bin(w), 64, "0"))
    return F.when(b.isNull(), null_of("string")).otherwise(
        F.substring(F.array_join(digits, ""), F.lit(1), b["len"]))


def bit_check(b, length: int) -> Column:
    """The bit string itself when it has the declared length."""
    b = as_col(b)
    message = F.concat(F.lit("bit string length "), b["len"].cast("string"),
                       F.lit(f" does not match type bit({length})"))
    return F.when(b.isNull() | (b["len"] == length), b).otherwise(raising(message, BIT_SQL))


def _count(a: Column, b: Column, op) -> Column:
    return F.aggregate(F.zip_with(a["words"], b["words"], lambda x, y: F.bit_count(op(x, y))),
                       F.lit(0), lambda s, x: s + x).cast("double")


def _same_length(a: Column, b: Column, body: Column) -> Column:
    message = F.concat(F.lit("different bit lengths "), a["len"].cast("string"),
                       F.lit(" and "), b["len"].cast("string"))
    return (F.when(a.isNull() | b.isNull(), null_of("double"))
            .when(a["len"] == b["len"], body).otherwise(raising(message, "double")))


def hamming_distance(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    return _same_length(a, b, _count(a, b, lambda x, y: x.bitwiseXOR(y)))


def jaccard_distance(a, b) -> Column:
    """1 minus shared bits over all bits; 1 when none are shared."""
    a, b = as_col(a), as_col(b)
    both = _count(a, b, lambda x, y: x.bitwiseAND(y))
    either = _count(a, b, lambda x, y: x.bitwiseOR(y))
    return _same_length(a, b, F.when(both == 0, F.lit(1.0)).otherwise(1 - both / either))


