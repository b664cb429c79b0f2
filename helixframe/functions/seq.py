"""Nucleotide column functions (F01-F08, F16, F17): all built-in expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER_BASES = "".join(BASES[i % 4] for i in range(26)) * 2


def sequence_of(text: Column) -> Column:
    """A sequence derived from text: letters to bases by alphabet position mod 4, other marks to N, space, stop and comma dropped."""
    return F.regexp_replace(F.translate(F.regexp_replace(text, r"[\s.,]", ""), LETTERS, LETTER_BASES), "[^ACGT]", "N")


def complement(s: Column) -> Column:
    """N and unknown characters stay."""
    return F.translate(s, "ACGT", "TGCA")


def revcomp(s: Column) -> Column:
    return F.reverse(complement(s))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement when the last base counts most."""
    return F.when(complement(kmer) < F.reverse(kmer), revcomp(kmer)).otherwise(kmer)


def is_reversed(kmer: Column) -> Column:
    return complement(kmer) < F.reverse(kmer)


def is_valid(kmer: Column) -> Column:
    return ~kmer.rlike("[^ACGT]")


def pack(kmer: Column) -> Column:
    """2 bits a base in a long, base i at bits 2i; for k up to 31."""
    return F.conv(F.translate(F.reverse(kmer), "ACGT", "0123"), 4, 10).cast("long")


def unpack(packed: Column, k: int) -> Column:
    """Letters of a code, four bases at a time by a constant table."""
    out = []
    for at in range(0, k, 4):
        n = min(4, k - at)
        letters = F.split(F.lit(",".join("".join(BASES[v >> 2 * i & 3] for i in range(n)) for v in range(1 << 2 * n))), ",")
        out.append(F.get(letters, F.shiftrightunsigned(packed, 2 * at).bitwiseAND(F.lit((1 << 2 * n) - 1)).cast("int")))
    return F.concat(*out)


_TOP = -(1 << 63)


def pack_long(kmer: Column) -> Column:
    """``high, low`` of a k-mer of 32 to 63 bases: bases 32 and on, and the first 32 with the top bit turned over; ordered like the codes."""
    part = lambda at, n: pack(F.concat(F.substring(kmer, at, n), F.lit("A")))  # noqa: E731  an A more changes nothing
    low = part(1, 16).bitwiseOR(F.shiftleft(part(17, 16), 32)).bitwiseXOR(F.lit(_TOP))
    return F.struct(part(33, 31).alias("high"), low.alias("low"))


def unpack_long(packed: Column, k: int) -> Column:
    first = unpack(packed["low"].bitwiseXOR(F.lit(_TOP)), 32)
    return F.concat(first, unpack(packed["high"], k - 32)) if k > 32 else first


def unpacked(code: Column, k: int) -> Column:
    """Letters of a code as k has it: a long up to 31 bases, two up to 63."""
    return unpack(code, k) if k <= 31 else unpack_long(code, k)


def push_right(kmer: Column, base: Column) -> Column:
    return F.concat(F.substring(kmer, 2, 1 << 20), base)


def push_left(kmer: Column, base: Column, k: int) -> Column:
    return F.concat(base, F.substring(kmer, 1, k - 1))


def peek_left(kmer: Column) -> Column:
    return F.substring(kmer, 1, 1)


def peek_right(kmer: Column) -> Column:
    return F.substring(kmer, -1, 1)


def marginal_first(seq: Column, k: int) -> Column:
    """First base of a node that isn't part of the overlap with its left neighbour."""
    return F.substring(seq, k, 1)


def marginal_last(seq: Column, k: int) -> Column:
    return F.when(F.length(seq) >= k, F.substring(F.reverse(seq), k, 1))


def marginal_length(seq: Column, k: int) -> Column:
    return F.length(seq) - F.lit(k - 1)


# overlap masks: bits 128..16 are left neighbours A, C, G, T; bits 8..1 right ones


def right_bit(base: Column) -> Column:
    return F.when(base == "A", 8).when(base == "C", 4).when(base == "G", 2).when(base == "T", 1).otherwise(0)


def left_bit(base: Column) -> Column:
    return right_bit(base) * 16


def mark(mask: Column, bit: Column) -> Column:
    return mask.bitwiseOR(bit)


def unmark(mask: Column, bit: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(bit))


def has(mask: Column, bit: Column) -> Column:
    return mask.bitwiseAND(bit) != 0


def right_degree(mask: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(F.lit(15)))


def left_degree(mask: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(F.lit(240)))


def is_dead_end(mask: Column) -> Column:
    return (right_degree(mask) == 0) | (left_degree(mask) == 0)


def revcomp_mask(mask: Column) -> Column:
    """Bit reversal of the byte."""
    out = F.lit(0)
    for i in range(8):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(mask, i).bitwiseAND(F.lit(1)), 7 - i))
    return out


def base_score(a: Column, b: Column, match: int = 1, mismatch: int = -1) -> Column:
    """N matches everything."""
    return F.when((a == b) | (a == "N") | (b == "N"), match).otherwise(mismatch)


def max_score(s: Column, match: int = 1) -> Column:
    return F.length(s) * match


def relative_score(score: Column, s: Column, match: int = 1) -> Column:
    return F.when(F.length(s) > 0, (score / max_score(s, match)).cast("float"))
