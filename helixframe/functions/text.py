"""Text formats as column expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
FLAG_BITS = {
    "paired": 0x1,
    "proper_pair": 0x2,
    "unmapped": 0x4,
    "mate_unmapped": 0x8,
    "reverse": 0x10,
    "mate_reverse": 0x20,
    "first_in_pair": 0x40,
    "second_in_pair": 0x80,
    "secondary": 0x100,
    "qc_fail": 0x200,
    "duplicate": 0x400,
    "supplementary": 0x800,
}


def flag(value: Column, name: str) -> Column:
    return value.bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def split_chars(s: Column, mark: str) -> Column:
    return F.split(s, "\\Q" + mark + "\\E", -1)


def cigar_tokens(cigar: Column) -> Column:
    """array<struct<n int, op string>>; `*` and other unparsable strings give an empty array."""
    whole = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(0))
    return F.transform(whole, lambda t: F.struct(t.substr(F.lit(1), F.length(t) - 1).cast("int").alias("n"), F.substring(t, -1, 1).alias("op")))


def cigar_supported(cigar: Column, allowed: str) -> Column:
    """Only the allowed operations and no `*`."""
    return cigar.rlike(f"^(\\d+[{allowed}])+$")


def tag(header: Column, letter: str) -> Column:
    """The content of a tag such as ``C(...)C``."""
    return F.regexp_extract(header, f"{letter}\\((.*?)\\){letter}", 1)


def chain_of(text: Column) -> Column:
    """Node ids of a chain's text: numbers apart by spaces."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))


def alignment_info(aligned: Column, score: Column, branch: Column, first: Column, last: Column, chain: Column) -> Column:
    """``A()A S()S B()B P()P C()C``; an unaligned read has chain 0 and no position."""
    one = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    nodes = F.when(aligned & (F.size(chain) > 0), F.array_join(chain.cast("array<string>"), " ")).otherwise(F.lit("0"))
    return F.concat(F.lit("A("), one(aligned), F.lit(")A\tS("), score.cast("string"), F.lit(")S\tB("), one(branch), F.lit(")B\tP("), first.cast("string"), F.lit(" "), last.cast("string"), F.lit(")P\tC("), nodes, F.lit(")C"))


def same_read(a: Column, b: Column) -> Column:
    """Do two headers name one read: up to the first white space, a slash number or a dot apart."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"^[@>]?(\S*)", 1), r"[/.][12]$", "")
    return stem(a) == stem(b)


def human_time(seconds: float) -> str:
    """Seconds as hours, minutes and seconds, leading zero parts left out."""
    h, rest = divmod(int(seconds), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{seconds:.2f}s" if seconds < 60 and seconds != int(seconds) else f"{s}s"


def date_time(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now()).strftime("%a %b %d %H:%M:%S %Y")
