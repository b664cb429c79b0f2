"""Evaluation of corrected reads and SAM conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.align import three_way
from ..functions.seq import revcomp
from ..functions.text import cigar_supported, cigar_tokens, same_read
from ..sources.reads import primary

MAX_INDEL = 3


def three_reads(wrong: DataFrame, perfect: DataFrame, corrected: DataFrame, key: str = "rec_id") -> DataFrame:
    """The three versions of each read by record."""
    a = wrong.select(key, F.col("read").alias("wrong"))
    return a.join(perfect.select(key, F.col("read").alias("perfect")), key).join(corrected.select(key, F.col("read").alias("corrected")), key)


def comparable(triples: DataFrame, limit: int = MAX_INDEL) -> DataFrame:
    """Reads whose lengths and gaps differ by few bases only."""
    gaps = F.length("perfect") - F.length(F.replace(F.col("perfect"), F.lit("-"), F.lit("")))
    return triples.filter((F.abs(F.length("wrong") - F.length("perfect")) <= limit) & (F.abs(F.length("corrected") - F.length("perfect")) <= limit) & (gaps <= limit))


def aligned_triples(triples: DataFrame, key: str = "rec_id") -> DataFrame:
    """Equal-length strings of each triple; those that are equal in length and free of gaps need no alignment."""
    equal = (F.length("wrong") == F.length("perfect")) & (F.length("corrected") == F.length("perfect")) & ~F.col("perfect").contains("-")
    plain = triples.filter(equal).select(key, "wrong", "perfect", "corrected")
    other = triples.filter(~equal).select(key, three_way("wrong", "perfect", "corrected").alias("x")).select(key, "x.*")
    return plain.unionByName(other)


def per_read(aligned: DataFrame, key: str = "rec_id") -> DataFrame:
    """``tp, tn, fp, fn, initial_n, new_n, errors`` of each read, base by base."""
    at = lambda c: lambda i: F.col(c).substr(i, F.lit(1))
    n = F.length("perfect")
    bases = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at("wrong")(i).alias("w"), at("perfect")(i).alias("p"), at("corrected")(i).alias("c"))))
    count = lambda f: F.size(F.filter("b", f)).cast("long")
    rows = aligned.withColumn("b", F.coalesce(bases, F.array().cast("array<struct<w:string,p:string,c:string>>")))
    return rows.select(
        key,
        count(lambda x: (x["w"] != x["p"]) & (x["c"] == x["p"])).alias("tp"), count(lambda x: (x["w"] == x["p"]) & (x["c"] == x["p"])).alias("tn"),
        count(lambda x: (x["w"] == x["p"]) & (x["c"] != x["p"])).alias("fp"), count(lambda x: (x["w"] != x["p"]) & (x["c"] != x["p"])).alias("fn"),
        count(lambda x: x["w"] == "N").alias("initial_n"), count(lambda x: x["c"] == "N").alias("new_n"), count(lambda x: x["w"] != x["p"]).alias("errors"),
    )


def confusion(reads: DataFrame) -> DataFrame:
    """One row: base and whole-read confusion, N counts, most errors, gain in percent."""
    full = lambda c: F.count_if(c)
    wrong, right = F.col("errors") > 0, (F.col("fp") == 0) & (F.col("fn") == 0)
    row = reads.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")],
        full(wrong & right).alias("tp_full"), full(~wrong & right).alias("tn_full"), full(~wrong & ~right).alias("fp_full"), full(wrong & ~right).alias("fn_full"),
        F.coalesce(F.sum("initial_n"), F.lit(0)).alias("initial_n"), F.coalesce(F.sum("new_n"), F.lit(0)).alias("new_n"), F.coalesce(F.max("errors"), F.lit(0)).alias("max_errors"),
    )
    return row.withColumn("gain", gain(F.col("tp"), F.col("fp"), F.col("fn")))


def gain(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fn == 0, F.lit(0.0)).otherwise(100.0 * (tp - fp) / (tp + fn))


def evaluate(wrong: DataFrame, perfect: DataFrame, corrected: DataFrame) -> DataFrame:
    """The evaluation job on three libraries."""
    return confusion(per_read(aligned_triples(comparable(three_reads(wrong, perfect, corrected)))))


def trimmed_insert_size(sizes: DataFrame, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Mean and standard deviation between the quartiles."""
    keys = keys or []
    q = sizes.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    joined = sizes.join(F.broadcast(q), keys) if keys else sizes.join(F.broadcast(q), F.lit(True))  # a row per library
    inner = joined.filter((F.col(value) >= F.col("q")[0]) & (F.col(value) <= F.col("q")[1]))
    return inner.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def pair_evaluation(pairs: DataFrame, distance: int = 500) -> DataFrame:
    """Labelled pairs judged by their distance (A18): ``pos1, pos2, label`` -> confusion, gain, sensitivity, false-positive rate."""
    far = F.abs(F.col("pos1") - F.col("pos2")) > distance
    bad = F.col("label")
    row = pairs.agg(F.count_if(far & bad).alias("tp"), F.count_if(far & ~bad).alias("fp"), F.count_if(~far & ~bad).alias("tn"), F.count_if(~far & bad).alias("fn"))
    return row.select("*", gain(F.col("tp"), F.col("fp"), F.col("fn")).alias("gain"), stats.sensitivity(F.col("tp"), F.col("fn")).alias("sensitivity"), (1 - stats.specificity(F.col("tn"), F.col("fp"))).alias("fpr"))


def projected(contig: Column, pos: Column, cigar: Column, read_length: Column, reverse: Column) -> Column:
    """The reference along a CIGAR at the read's length (C02): M copies, I and S give N, D skips; padded or cut to length by strand.

    A leading S does not move along the reference, a trailing one does.
    """
    start = F.struct(pos.cast("int").alias("at"), F.lit("").alias("out"))
    n_text = lambda n: F.repeat(F.lit("N"), n)

    def step(acc, t):
        n, op = t["n"], t["op"]
        copy = contig.substr(acc["at"], n)
        lead = acc["out"] == ""
        moved = F.when(op.isin("M", "D", "=", "X"), acc["at"] + n).when((op == "S") & ~lead, acc["at"] + n).otherwise(acc["at"])
        text = F.when(op.isin("M", "=", "X"), F.concat(acc["out"], copy)).when(op.isin("I", "S"), F.concat(acc["out"], n_text(n))).otherwise(acc["out"])
        return F.struct(moved.alias("at"), text.alias("out"))

    out = F.aggregate(cigar_tokens(cigar), start, step)["out"]
    forward = F.rpad(out, read_length, "N")
    backward = revcomp(F.lpad(F.when(F.length(out) > read_length, out.substr(F.length(out) - read_length + 1, read_length)).otherwise(out), read_length, "N"))
    return F.when(reverse, backward).otherwise(forward)


def sam_to_reads(reads: DataFrame, sam: DataFrame, contigs: DataFrame, allowed: str = "MIDS", use_alternatives: bool = False) -> DataFrame:
    """``rec_id, mapped, read``: each read rewritten as the reference where its alignment lies.

    Rows are joined by name, secondary and supplementary ones dropped, unmapped (0x4) and unsupported
    ones leave the read unmapped.  Contigs are joined by name, the last of equal names winning.
    """
    one = primary(sam).withColumn("usable", cigar_supported(F.col("cigar"), allowed) & (F.col("flag").bitwiseAND(F.lit(4)) == 0))
    if use_alternatives:
        from ..sources.reads import alternatives

        own = F.struct(match_score(F.col("cigar"), F.col("nm")).alias("s"), F.col("rname").alias("rname"), (F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("reverse"), F.col("pos").alias("pos"), F.col("cigar").alias("cigar"))
        other = F.transform(alternatives(F.coalesce("xa", F.lit(""))), lambda x: F.struct(match_score(x["cigar"], x["nm"]).alias("s"), x["rname"].alias("rname"), x["reverse"].alias("reverse"), x["pos"].alias("pos"), x["cigar"].alias("cigar")))
        best = F.aggregate(other, own, lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
        one = one.withColumn("best", best).withColumns({"rname": F.col("best.rname"), "pos": F.col("best.pos"), "cigar": F.col("best.cigar"), "turned": F.col("best.reverse")}).drop("best")
    else:
        one = one.withColumn("turned", F.col("flag").bitwiseAND(F.lit(16)) != 0)
    texts = contigs.withColumn("order__", F.monotonically_increasing_id()).groupBy("rname").agg(F.max_by("seq", "order__").alias("contig"))
    named = reads.withColumn("qname", F.regexp_replace(F.regexp_extract("pre", r"^[@>]?(\S*)", 1), "/[12]$", ""))
    joined = named.join(one.select("qname", "rname", "pos", "cigar", "turned", "usable"), "qname", "left").join(texts, "rname", "left")
    mapped = F.coalesce(F.col("usable"), F.lit(False)) & F.col("contig").isNotNull()
    made = projected(F.col("contig"), F.col("pos"), F.col("cigar"), F.length("read"), F.col("turned"))
    return joined.select("rec_id", mapped.alias("mapped"), F.when(mapped, made).otherwise(F.col("read")).alias("read"))


def match_score(cigar: Column, nm: Column) -> Column:
    """Matched bases less the edit distance, by which the best alternative is chosen."""
    matched = F.aggregate(cigar_tokens(cigar), F.lit(0), lambda a, t: a + F.when(t["op"] == "M", t["n"]).otherwise(0))
    return matched - F.coalesce(nm, F.lit(0))


def unmapped_count(converted: DataFrame) -> DataFrame:
    return converted.agg(F.count_if(~F.col("mapped")).alias("unmapped"), F.count(F.lit(1)).alias("reads"))


def consistent_names(reads: DataFrame, sam: DataFrame) -> DataFrame:
    """Rows of two lock-step tables whose names differ."""
    both = reads.select("rec_id", F.col("pre").alias("h1")).join(sam.select("rec_id", F.col("qname").alias("h2")), "rec_id")
    return both.filter(~same_read(F.col("h1"), F.col("h2")))
