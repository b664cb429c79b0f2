"""k-mer tables.

k-mers of up to 63 bases are 2-bit codes: a long up to 31 bases, a struct of two above.  They are counted by minimizer: runs of k-mers with one
minimizer are shuffled as packed bases, with the bases beside them where neighbour bits are asked for, and counted where they arrive.  The
number of tasks grows with the files read, so that one task's table doesn't.  Letters are restored only for the rows of a
result that asks for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions import seq as S
from ..session import materialise

#: Bases of a minimizer.
MINIMIZER = 11
#: About what Spark reads in one task; files of less aren't split.
SPLIT_BYTES = 128 << 20
#: Codes a task adds up before it sends them on.
HELD_CODES = 2_000_000
#: Codes that are looked for by broadcast.
FEW_CODES = 2_000_000
#: Bytes of (packed) files whose k-mers one task counts.
COUNTED_BYTES = 2 << 20


def spread(reads: DataFrame) -> DataFrame:
    """A table of fewer files than cores, none of them large, dealt over all cores; by what the plan knows, nothing is run."""
    if reads.isStreaming:
        return reads
    cores, files = reads.sparkSession.sparkContext.defaultParallelism, reads.inputFiles()
    size = int(str(reads._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return reads.repartition(cores) if files and len(files) < cores and size < cores * SPLIT_BYTES else reads


def counting_parts(reads: DataFrame) -> int:
    """Partitions for counting k-mers: the session's, or more where files are large, so that a task's share doesn't grow with them."""
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if reads.isStreaming or not reads.inputFiles():
        return parts
    leaves = reads._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(parts, -(-sum(n for n in sizes if n < 1 << 50) // COUNTED_BYTES))  # rows that aren't from files have no size


def _expanded(reads: DataFrame, keys: list[str], seq: str, made: list[T.StructField], run) -> DataFrame:
    """``keys`` and new columns for each k-mer that ``run`` finds in an Arrow column of sequences: row numbers first."""
    kept = [reads.schema[c] for c in keys]
    names = [*keys, *(f.name for f in made)]

    def expand(source):
        for b in source:
            for row, *columns in run(b.column(len(keys))):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keys))), *columns], names=names)

    return spread(reads.select(*keys, F.col(seq).alias("seq__"))).mapInArrow(expand, T.StructType([*kept, *made]))


def kmer_rows(reads: DataFrame, k: int, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """``keys, pos, kmer`` for every valid k-mer (ACGT only)."""
    made = [T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType())]

    def run(texts):
        for row, pos, text in codes.substrings(texts, k):
            yield row, pa.array(pos.astype(np.int32)), text

    return _expanded(reads, keys or [], seq, made, run)


LONG_CODE = T.StructType([T.StructField("high", T.LongType(), False), T.StructField("low", T.LongType(), False)])


def _code_type(k: int) -> T.DataType:
    return T.LongType() if k <= codes.MOST_K else LONG_CODE


def _pairs(high: np.ndarray, low: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(high), pa.array(low)], fields=[pa.field("high", pa.int64(), False), pa.field("low", pa.int64(), False)])


def canonical_rows(reads: DataFrame, k: int, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """``keys, pos, canon, turned`` for every valid k-mer; canon is a code up to k = 63, letters above."""
    if k > codes.MOST_LONG_K:
        kmer = F.col("kmer")
        return kmer_rows(reads, k, keys, seq).select(*(keys or []), "pos", S.canonical(kmer).alias("canon"), S.is_reversed(kmer).alias("turned"))
    made = [T.StructField("pos", T.IntegerType()), T.StructField("canon", _code_type(k)), T.StructField("turned", T.BooleanType())]

    def run(texts):
        if k > codes.MOST_K:
            for row, pos, high, low, turned in codes.canonical_pairs(texts, k):
                yield row, pa.array(pos.astype(np.int32)), _pairs(high, low), pa.array(turned)
            return
        for row, pos, code, turned in codes.canonical_codes(texts, k):
            yield row, pa.array(pos.astype(np.int32)), pa.array(code), pa.array(turned)

    return _expanded(reads, keys or [], seq, made, run)


def _summed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Equal codes (one array, or high and low) added up; the last array of each is the mask."""
    *code, mask = (np.concatenate([h[i] for h in held]) for i in range(len(held[0])))
    order = np.argsort(code[0]) if len(code) == 1 else np.lexsort(code[::-1])
    code, mask = [c[order] for c in code], mask[order]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in code])
    starts = np.flatnonzero(new)
    n, bits, code = np.diff(np.append(starts, len(order))), np.bitwise_or.reduceat(mask, starts).astype(np.int32), [c[starts] for c in code]
    return pa.RecordBatch.from_arrays([pa.array(code[0]) if len(code) == 1 else _pairs(*code), pa.array(n.astype(np.int64)), pa.array(bits)], names=["code", "n", "bf"])


def _super_batch(held: list) -> pa.RecordBatch:
    """Equal super-k-mers added up."""
    columns = [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(order)))
    words = [f"w{i}" for i in range(len(columns) - 2)]
    return pa.RecordBatch.from_arrays([*(pa.array(c[starts].astype(np.int64)) for c in columns[:-1]), pa.array(columns[-1][starts].astype(np.int32)), pa.array(times.astype(np.int64))], names=["minimizer", *words, "kmers", "times"])


def super_kmer_rows(reads: DataFrame, k: int, seq: str = "seq", beside: bool = False) -> DataFrame:
    """``minimizer, w0, w1, ..., kmers, times``: runs of k-mers with one minimizer as packed bases, 32 a long; a task's repeats added up.

    Two longs up to k = 31, four above.  ``beside`` adds the bases beside a run as one more long, w2 or w4.
    """

    def run(source):
        held, size = [], 0
        for b in source:
            for found in codes.super_kmers(b.column(0), k, min(MINIMIZER, k), beside):
                held.append(found)
                size += len(found[0])
                if size >= HELD_CODES // 4:
                    yield _super_batch(held)
                    held, size = [], 0
        if size:
            yield _super_batch(held)

    return spread(reads.select(seq)).mapInArrow(run, "minimizer long, " + "".join(f"w{i} long, " for i in range(codes.super_words(k) + beside)) + "kmers int, times long")


def _turned_word(df: DataFrame, code: str, out: str) -> DataFrame:
    """``df`` with 32 packed bases reversed and complemented: pairs of bits turned round by halves."""
    df = df.withColumn(out, F.bitwise_not(code))
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        part = F.lit(mask)
        df = df.withColumn(out, F.shiftrightunsigned(out, shift).bitwiseAND(part).bitwiseOR(F.shiftleft(F.col(out).bitwiseAND(part), shift)))
    return df


def _bases_at(words: int, first: int) -> Column:
    """32 packed bases of a super-k-mer from base ``i + first`` on; beyond its end anything."""
    cases = []
    for w in range(words):
        here, low = f"w{w}", 32 * w - first
        nxt = f"shiftleft(w{w + 1}, 64 - 2 * (i - {low}))" if w + 1 < words else "0L"
        cases.append(f"WHEN i = {low} THEN {here} WHEN i < {low + 32} THEN shiftrightunsigned({here}, 2 * (i - {low})) | {nxt}")
    return F.expr("CASE " + " ".join(cases) + " ELSE 0L END")


def canonical_of(df: DataFrame, k: int) -> DataFrame:
    """``df`` with ``code``, the less of a k-mer (``forward``, or ``high`` and ``low`` above 31 bases) and its reverse complement, ``turned`` where it is the latter and ``same`` where they are equal."""
    if k <= codes.MOST_K:
        df = _turned_word(df, "forward", "reverse").withColumn("reverse", F.shiftrightunsigned("reverse", 64 - 2 * k))
        return df.withColumn("code", F.least("forward", "reverse")).withColumns({"turned": F.col("reverse") < F.col("forward"), "same": F.col("reverse") == F.col("forward")})
    df = _turned_word(_turned_word(df, "low", "above"), "high", "below")  # the reverse complement of 64 bases
    out = 128 - 2 * k
    if out == 64:
        high, low = F.lit(0).cast("long"), F.col("above")
    else:
        high, low = F.shiftrightunsigned("above", out), F.shiftrightunsigned("below", out).bitwiseOR(F.shiftleft("above", 64 - out))
    top = F.lit(-(1 << 63))
    df = df.withColumns({"high2": high, "low2": low.bitwiseXOR(top), "low": F.col("low").bitwiseXOR(top)})
    df = df.withColumn("turned", (F.col("high2") < F.col("high")) | ((F.col("high2") == F.col("high")) & (F.col("low2") < F.col("low"))))
    either = lambda c: F.when(F.col("turned"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
    same = (F.col("high2") == F.col("high")) & (F.col("low2") == F.col("low"))
    return df.withColumns({"code": F.struct(either("high"), either("low")), "same": same})


def _dealt_codes(reads: DataFrame, k: int, seq: str, beside: bool = False) -> DataFrame:
    """``minimizer, times, code, turned, same`` of all k-mers, one row for those of equal runs, dealt out by minimizer; with ``beside`` the numbers of the bases ``left`` and ``right``, 4 for none."""
    words = codes.super_words(k)
    dealt = super_kmer_rows(reads, k, seq, beside).repartition(counting_parts(reads), "minimizer")
    kept = ["minimizer", "times", *(f"w{w}" for w in range(words + beside)), *(["kmers"] if beside else [])]
    each = dealt.select(*kept, F.explode(F.sequence(F.lit(0), F.col("kmers") - 1)).alias("i"))
    sides = {}
    if beside:
        base = lambda i: F.expr("CASE " + " ".join(f"WHEN {i} < {32 * (w + 1)} THEN shiftrightunsigned(w{w}, 2 * ({i} - {32 * w})) & 3" for w in range(words)) + " END").cast("int")
        sides["left"] = F.when(F.col("i") == 0, F.shiftright(f"w{words}", 3).cast("int")).otherwise(base("(i - 1)"))
        sides["right"] = F.when(F.col("i") == F.col("kmers") - 1, F.col(f"w{words}").bitwiseAND(F.lit(7)).cast("int")).otherwise(base(f"(i + {k})"))
    extra = [c.alias(n) for n, c in sides.items()]
    if k <= codes.MOST_K:
        each = each.select("minimizer", "times", *extra, _bases_at(words, 0).bitwiseAND(F.lit((1 << 2 * k) - 1)).alias("forward"))
    else:
        each = each.select("minimizer", "times", *extra, _bases_at(words, 0).alias("low"), _bases_at(words, 32).bitwiseAND(F.lit((1 << 2 * (k - 32)) - 1)).alias("high"))
    return canonical_of(each, k).select("minimizer", "times", "code", "turned", "same", *sides)


def _by_code(dealt: DataFrame, k: int, *totals: Column) -> DataFrame:
    """``code`` and totals of equal codes; they have one minimizer, so nothing is shuffled again."""
    parts = {"code": F.col("code")} if k <= codes.MOST_K else {"high": F.col("code.high"), "low": F.col("code.low")}
    names = list(parts)
    summed = dealt.withColumns(parts).groupBy("minimizer", *names).agg(*totals)
    code = F.col("code") if k <= codes.MOST_K else F.struct(*names).alias("code")
    return summed.select(code, *(c for c in summed.columns if c not in ("minimizer", *names)))


def counted_codes(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``code, n`` of all k-mers (k up to 63), by minimizers.

    Super-k-mers are dealt out by minimizer, a fraction of their k-mers' bytes; both strands of a
    k-mer have one minimizer, so every k-mer is counted where its super-k-mers are, by Spark's own
    aggregation, without another shuffle.
    """
    return _by_code(_dealt_codes(reads, k, seq), k, F.sum("times").alias("n"))


def masked_codes(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``code, n, bf`` of all k-mers (k up to 63): :func:`counted_codes` with the bits of the bases beside them."""
    bit = lambda c: F.call_function("shiftright", F.lit(8), F.col(c))  # noqa: E731  no bit for 4
    other = lambda c: F.when(F.col(c) < 4, F.call_function("shiftleft", F.lit(1), F.col(c))).otherwise(0)
    mask = F.when(F.col("turned"), other("right") * 16 + other("left")).otherwise(bit("left") * 16 + bit("right"))
    return _by_code(_dealt_codes(reads, k, seq, True).withColumn("mask", mask), k, F.sum("times").alias("n"), F.bit_or("mask").alias("bf"))


def _code_table(reads: DataFrame, k: int, seq: str, masks: bool) -> DataFrame:
    """``code, n, bf``: counts, and with ``masks`` the neighbour bits, of canonical codes, every one of which is shuffled; the plain form of :func:`masked_codes`."""
    found = codes.neighbour_masks if k <= codes.MOST_K else codes.neighbour_pair_masks

    def run(source):
        held, size = [], 0
        for b in source:
            for *code, mask in found(b.column(0), k):
                columns = (*code, mask if masks else np.zeros_like(mask))
                held.append(columns)
                size += len(columns[0])
                if size >= HELD_CODES:
                    yield _summed(held)
                    held, size = [], 0
        if size:
            yield _summed(held)

    schema = T.StructType([T.StructField("code", _code_type(k)), T.StructField("n", T.LongType()), T.StructField("bf", T.IntegerType())])
    return spread(reads.select(seq)).mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n"), F.bit_or("bf").alias("bf"))


def kmer_counts(reads: DataFrame, k: int, least: int = 1, seq: str = "seq") -> DataFrame:
    """``canon, n`` of k-mers seen ``least`` times or more."""
    if k > codes.MOST_LONG_K:
        table = kmer_rows(reads, k, seq=seq).groupBy(S.canonical(F.col("kmer")).alias("canon")).agg(F.count(F.lit(1)).alias("n"))
        return table.filter(F.col("n") >= least) if least > 1 else table
    return counted_codes(reads, k, seq).filter(F.col("n") >= least).select(S.unpacked(F.col("code"), k).alias("canon"), "n")


def kmer_totals(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("distinct_kmers"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_kmers"), F.count_if(F.col("n") > 1).alias("repeated_kmers"))


def spectrum(table: DataFrame, most: int = 65535) -> DataFrame:
    """``multiplicity, kmers``: histogram of counts, saturating like a 16-bit counter."""
    return table.groupBy(F.least(F.col("n"), F.lit(most)).cast("long").alias("multiplicity")).agg(F.count(F.lit(1)).alias("kmers"))


def neighbour_rows(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``canon, mask`` for each occurrence of a k-mer too long for a code: bits of the adjacent valid k-mers, canonical strand."""
    rows = kmer_rows(reads.select(F.col(seq).alias("whole__")), k, ["whole__"], "whole__")
    at = lambda i: F.substring(F.col("whole__"), i, F.lit(1))
    left = F.when(F.col("pos") > 0, at(F.col("pos"))).otherwise("")
    mask = S.left_bit(left).bitwiseOR(S.right_bit(at(F.col("pos") + k + 1)))
    k_mer = F.col("kmer")
    return rows.select(S.canonical(k_mer).alias("canon"), F.when(S.is_reversed(k_mer), S.revcomp_mask(mask)).otherwise(mask).alias("mask"))


def overlap_table(reads: DataFrame, k: int, least: int = 1, seq: str = "seq") -> DataFrame:
    """``canon, n, bf``: counts and neighbour bits of surviving k-mers in one aggregation.

    With ``least`` above 1, bits of neighbours that did not survive are cleared.
    """
    if k > codes.MOST_LONG_K:
        table = neighbour_rows(reads, k, seq).groupBy("canon").agg(F.count(F.lit(1)).alias("n"), F.bit_or("mask").alias("bf")).filter(F.col("n") >= least)
    else:
        table = masked_codes(reads, k, seq).filter(F.col("n") >= least).select(S.unpacked(F.col("code"), k).alias("canon"), "n", "bf")
    return table if least <= 1 else _surviving(table, k)


def _surviving(kept: DataFrame, k: int) -> DataFrame:
    """``kept`` without the bits of neighbours that aren't in it.

    Neighbours share all bases but their outer ones.  Each k-mer sends its outer base and its bits to the
    k - 1 bases on either side, where at most 16 rows meet, so the k-mers are read once and nothing is joined.
    """
    own = lambda at: S.right_bit(F.substring("canon", at, 1))
    ends = F.array(
        F.struct(F.substring("canon", 2, k - 1).alias("middle"), (own(1) * 16).alias("own"), F.col("bf").bitwiseAND(F.lit(15)).alias("bits")),
        F.struct(F.substring("canon", 1, k - 1).alias("middle"), own(k).alias("own"), F.col("bf").bitwiseAND(F.lit(240)).alias("bits")),
    )
    rows = kept.select("canon", "n", F.explode(ends).alias("x")).select("canon", "n", "x.*")
    rows = rows.select("canon", "n", S.canonical(F.col("middle")).alias("middle"), S.is_reversed(F.col("middle")).alias("turned"), (F.col("middle") == S.revcomp(F.col("middle"))).alias("same"), "own", "bits")
    turn = lambda c: F.when(F.col("turned"), S.revcomp_mask(F.col(c))).otherwise(F.col(c))
    rows = rows.withColumns({"own": F.when(F.col("same"), F.col("own").bitwiseOR(S.revcomp_mask(F.col("own")))).otherwise(turn("own")), "bits": turn("bits")})
    rows = rows.withColumn("bits", F.col("bits").bitwiseAND(F.bit_or("own").over(Window.partitionBy("middle"))))
    return rows.withColumn("bits", turn("bits")).groupBy("canon").agg(F.max("n").alias("n"), F.bit_or("bits").alias("bf"))


def middle_links(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``code, strands, links``: the links of :func:`graph.unique_links` between all of the reads' k-mers (odd k up to 31), by the k - 1 bases that two neighbours share.

    There the pairs of outer bases seen, 4 times the left one's number and the right one's, are a matrix of 16 bits.  A link is a bit
    alone in its row, the source's right neighbours, and in its column, the target's left ones.  Links stand for
    both strands (2), or, where the shared bases are their own reverse complement, for themselves (1).
    """
    if k % 2 == 0 or k > codes.MOST_K:
        raise ValueError(f"k must be odd and at most {codes.MOST_K}: {k}")
    bit = lambda left, right: F.call_function("shiftleft", F.lit(1), left * 4 + right)
    there, back = bit(F.col("left"), F.col("right")), bit(3 - F.col("right"), 3 - F.col("left"))
    pair = F.when(F.col("same"), there.bitwiseOR(back)).when(F.col("turned"), back).otherwise(there)
    seen = _dealt_codes(reads, k - 1, seq, True).filter("left < 4 AND right < 4").withColumn("pair", pair)
    cells = _by_code(seen, k - 1, F.bit_or("pair").alias("pairs"), F.max("same").alias("same"))
    links = F.lit(0)
    for a in range(4):
        for b in range(4):
            alone = F.col("pairs").bitwiseAND(F.lit(15 << 4 * a | 0x1111 << b)) == 1 << 4 * a + b
            if a + b == 3:
                alone &= ~F.col("same")  # a hairpin
            if a == b:
                alone &= F.col("code") != sum(a << 2 * i for i in range(k - 1))  # an own loop
            links = links + F.when(alone, 1 << 4 * a + b).otherwise(0)
    return cells.select("code", F.when(F.col("same"), 1).otherwise(2).alias("strands"), links.alias("links"))


def link_totals(middles: DataFrame) -> DataFrame:
    """``links, sources, targets`` of :func:`middle_links`; a k-mer's right end, or left one, is in one row only."""
    some = lambda mask: (F.col("links").bitwiseAND(F.lit(mask)) != 0).cast("int")
    total = lambda n: F.coalesce(F.sum((n * F.col("strands")).cast("long")), F.lit(0).cast("long"))
    sources, targets = sum(some(15 << 4 * i) for i in range(4)), sum(some(0x1111 << i) for i in range(4))
    return middles.agg(total(F.bit_count("links")).alias("links"), total(sources).alias("sources"), total(targets).alias("targets"))


def known_codes(asked: DataFrame, reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``canon``: the distinct codes of ``asked`` (column canon) that ``reads`` hold (k up to 63).

    Few asked ones are broadcast, so that no k-mer of the reads is shuffled; more are joined with the reads' counts.
    """
    asked = materialise(asked.select("canon").distinct(), "asked")
    if asked.count() <= FEW_CODES:
        return canonical_rows(reads, k, seq=seq).select("canon").join(F.broadcast(asked), "canon", "left_semi").distinct()
    return asked.join(counted_codes(reads, k, seq).select(F.col("code").alias("canon")), "canon", "left_semi")
