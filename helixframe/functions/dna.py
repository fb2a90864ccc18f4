"""Column expressions on DNA strings and bytes; all of them stay inside the JVM.

Null in gives null out. Only A, C, G and T (either case where stated) are symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACGT"
#: A run of anything that is not a symbol ends a segment.
BREAK = "[^ACGTacgt]+"
INVALID_CODE = 4
#: A signed 64-bit word holds at most this many two-bit symbols and stays non-negative.
MAX_PACKED = 31


def symbol_code(c: Column) -> Column:
    """0..3 for a single A, C, G, T of either case, else 4."""
    at = F.instr(F.lit("ACGTacgt"), c)
    return F.when(F.length(c) != 1, F.lit(INVALID_CODE)).when(at > 0, (at - 1) % 4).otherwise(F.lit(INVALID_CODE)).cast("int")


def code_symbol(code: Column) -> Column:
    """A, C, G or T for 0..3, else N."""
    return F.when(code.between(0, 3), F.substring(F.lit(ALPHABET), code.cast("int") + 1, F.lit(1))).otherwise(F.lit("N"))


def complement_code(code: Column) -> Column:
    """The complementary symbol's code."""
    return (F.lit(3) - code).cast("int")


def complement_char(c: Column) -> Column:
    """Complement of a single symbol, upper case; anything else is Z."""
    return F.when(F.length(c) != 1, F.lit("Z")).when(c.rlike("^[ACGTacgt]$"), F.translate(c, "ACGTacgt", "TGCATGCA")).otherwise(F.lit("Z"))


def fold(s: Column) -> Column:
    """Upper case for the four symbols alone, so that no other letter can become one."""
    return F.translate(s, "acgt", "ACGT")


def reverse_complement(s: Column) -> Column:
    """Reverse complement, upper case; for text of valid symbols."""
    return F.translate(F.reverse(s), "ACGTacgt", "TGCATGCA")


def canonical(s: Column) -> Column:
    """The smaller of both strands."""
    return F.least(fold(s), reverse_complement(s))


def canonical_sign(s: Column) -> Column:
    """1 if the given strand is the smaller one, -1 if its reverse complement is, 0 for a palindrome."""
    f, r = fold(s), reverse_complement(s)
    return F.when(f < r, 1).when(f > r, -1).when(f == r, 0).cast("int")


def is_clean(s: Column) -> Column:
    """True if every character is a symbol; the empty string is clean."""
    return s.rlike(r"\A[ACGTacgt]*\z")


def pack(s: Column) -> Column:
    """Two bits a symbol as a bigint; for at most 31 valid symbols."""
    return F.conv(F.translate(s, "ACGTacgt", "01230123"), 4, 10).cast("bigint")


def unpack(code: Column, k: int) -> Column:
    """The k symbols of a packed word."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", ALPHABET)


def pack_blocks(s: Column) -> Column:
    """An array of packed words, 31 symbols each but the last; for valid symbols of any number."""
    return F.when(F.length(s) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s), F.lit(MAX_PACKED)), lambda i: pack(F.substring(s, i, F.lit(MAX_PACKED)))))


def unpack_blocks(blocks: Column, k: int) -> Column:
    """The k symbols of packed words."""
    last = k - (k - 1) // MAX_PACKED * MAX_PACKED
    n = F.size(blocks)
    return F.array_join(F.transform(blocks, lambda x, i: F.when(i + 1 < n, unpack(x, MAX_PACKED)).otherwise(unpack(x, last))), "")


def strand_hash(s: Column) -> Column:
    """A 64-bit hash that both strands share."""
    return F.xxhash64(canonical(s))


def left_blocks(codes: Column, n: Column) -> Column:
    """Packed words of MAX_PACKED symbols each from n digits 0 to 3 as bytes; the last word is filled up with zeros."""
    digits = lambda i: F.rpad(F.substring(codes, i, F.lit(MAX_PACKED)).cast("string"), MAX_PACKED, "0")
    return F.transform(F.sequence(F.lit(1), n, F.lit(MAX_PACKED)), lambda i: F.conv(digits(i), 4, 10).cast("bigint"))


def packed_at(blocks: Column, at: Column, k: int) -> Column:
    """The packed word of the k symbols that begin at the 0-based offset, from left_blocks; k is at most MAX_PACKED."""
    shift = lambda name, x, n: F.call_function(name, x, n.cast("int"))
    word, skip = F.floor(at / F.lit(MAX_PACKED)).cast("int"), F.pmod(at, F.lit(MAX_PACKED))
    over = skip + F.lit(k - MAX_PACKED)  # symbols that the next word has
    one = shift("shiftright", F.get(blocks, word), F.lit(-2) * over)
    two = shift("shiftleft", F.get(blocks, word), F.lit(2) * over).bitwiseOR(shift("shiftright", F.get(blocks, word + 1), F.lit(2 * MAX_PACKED) - F.lit(2) * over))
    return F.when(over <= 0, one).otherwise(two).bitwiseAND(F.lit((1 << 2 * k) - 1))


#: Fixed masks that swap ever larger groups of two-bit symbols: group's bits, mask of each second group.
_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def with_canonical_code(df: DataFrame, name: str, k: int) -> DataFrame:
    """df with its packed words of k symbols replaced by the smaller of each and its reverse complement's word.

    A step names its result, so that each is computed once; all of it is arithmetic in generated code.
    """
    others, turned = [c for c in df.columns if c != name], f"{name}_turned"
    df = df.select(*others, name, F.col(name).alias(turned))
    for bits, mask in _SWAPS:
        x, m = F.col(turned), F.lit(mask)
        df = df.select(*others, name, F.shiftrightunsigned(x, bits).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), bits)).alias(turned))
    return df.select(*others, F.least(F.col(name), F.shiftrightunsigned(F.bitwise_not(F.col(turned)), 64 - 2 * k)).alias(name))
