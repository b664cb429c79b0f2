"""Read libraries: scans of FASTA, FASTQ, SAM and raw text, plain or gzipped."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import FLAG_BITS, flag
from .records import scan

TYPES = {".fasta": "fasta", ".fastq": "fastq", ".sam": "sam", ".raw": "raw"}


def file_type(path: str) -> tuple[str, bool]:
    """(type, gzipped) from the name's extension, in any case; other extensions are an error."""
    p = PurePosixPath(path.lower())
    zipped = p.suffix == ".gz"
    kind = TYPES.get(PurePosixPath(p.stem).suffix if zipped else p.suffix)
    if kind is None:
        raise ValueError(f"unknown file type: {path}")
    return kind, zipped


def read_fasta(spark: SparkSession, path: str, lib_id: int = 0) -> DataFrame:
    """Records start at a '>' that begins a line; all lines up to the next one are joined; what precedes the first is skipped."""
    r = scan(spark, path, "fasta")
    return r.select(F.lit(lib_id).alias("lib_id"), "rec_id", F.concat("head", F.lit("\n")).alias("pre"), "read", F.lit("\n").alias("post"), F.lit(None).cast("string").alias("qual"))


def read_fastq(spark: SparkSession, path: str, lib_id: int = 0) -> DataFrame:
    """Four-line records; a header that doesn't start with '@' is an error; records with an empty read are dropped."""
    r = scan(spark, path, "fastq").filter("head <> '' AND read <> ''")
    return r.select(F.lit(lib_id).alias("lib_id"), "rec_id", F.concat("head", F.lit("\n")).alias("pre"), "read", F.concat(F.lit("\n"), "plus", F.lit("\n"), "qual", F.lit("\n")).alias("post"), "qual")


def read_raw(spark: SparkSession, path: str, lib_id: int = 0) -> DataFrame:
    """One read per line; empty lines are dropped."""
    r = scan(spark, path, "raw").filter("head <> ''")
    return r.select(F.lit(lib_id).alias("lib_id"), "rec_id", F.lit("").alias("pre"), F.col("head").alias("read"), F.lit("\n").alias("post"), F.lit(None).cast("string").alias("qual"))


def read_sam_reads(spark: SparkSession, path: str, lib_id: int = 0) -> DataFrame:
    """The SEQ column of each alignment row, with what precedes and follows it kept for writing it again."""
    rows = scan(spark, path, "sam").filter(~F.col("head").startswith("@") & (F.col("head") != ""))
    f = F.split("head", "\t")
    return rows.select(F.lit(lib_id).alias("lib_id"), "rec_id", F.concat(F.array_join(F.slice(f, 1, 9), "\t"), F.lit("\t")).alias("pre"), f[9].alias("read"), F.concat(F.lit("\t"), F.array_join(F.slice(f, 11, 1000), "\t"), F.lit("\n")).alias("post"), f[10].alias("qual"))


READERS = {"fasta": read_fasta, "fastq": read_fastq, "raw": read_raw, "sam": read_sam_reads}


def read_library(spark: SparkSession, path: str, lib_id: int = 0) -> DataFrame:
    """Scan by the path's extension; gzip is undone by Spark's codec of the same extension."""
    return READERS[file_type(path)[0]](spark, path, lib_id)


def read_libraries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All libraries, told apart by ``lib_id`` in the order given."""
    out = None
    for i, p in enumerate(paths):
        df = read_library(spark, p, i)
        out = df if out is None else out.unionByName(df)
    return out


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``rname, seq``: the name is the header without '>', up to its first white space."""
    return read_fasta(spark, path).select(F.regexp_extract("pre", r"^>(\S*)", 1).alias("rname"), F.col("read").alias("seq"))


def parse_sam(rows: DataFrame, value: str = "value") -> DataFrame:
    """SAM columns of text rows; NM and XA are looked for in columns 12 and 13 only."""
    f = F.split(F.col(value), "\t")
    optional = F.array(F.get(f, F.lit(11)), F.get(f, F.lit(12)))
    pick = lambda tag: F.get(F.filter(optional, lambda x: x.startswith(tag)), F.lit(0))
    at = lambda i: F.get(f, F.lit(i))
    return rows.filter(~F.col(value).startswith("@")).select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), at(3).cast("int").alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"),
        at(6).alias("rnext"), at(7).cast("int").alias("pnext"), at(8).cast("int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"),
        F.regexp_extract(pick("NM:i:"), r"NM:i:(\d+)", 1).cast("int").alias("nm"), F.coalesce(F.regexp_extract(pick("XA:Z:"), r"XA:Z:(.*)", 1), F.lit("")).alias("xa"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def with_flags(sam: DataFrame, column: str = "flag") -> DataFrame:
    return sam.withColumns({f"is_{n}": flag(F.col(column), n) for n in FLAG_BITS})


def primary(sam: DataFrame) -> DataFrame:
    """Rows that are neither secondary nor supplementary."""
    return sam.filter(F.col("flag").bitwiseAND(F.lit(FLAG_BITS["secondary"] | FLAG_BITS["supplementary"])) == 0)


def alternatives(xa: Column) -> Column:
    """The alternatives of an XA tag: contig, reverse strand, position, cigar, edit distance."""
    parts = F.filter(F.split(xa, ";"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        F.split(x, ",")[0].alias("rname"), F.split(x, ",")[1].startswith("-").alias("reverse"),
        F.regexp_replace(F.split(x, ",")[1], "[+-]", "").cast("int").alias("pos"), F.split(x, ",")[2].alias("cigar"), F.split(x, ",")[3].cast("int").alias("nm"),
    ))


def library_stats(reads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Reads and mean length per library (the .met file's content)."""
    return reads.groupBy(*(keys or ["lib_id"])).agg(F.count(F.lit(1)).alias("num_reads"), F.avg(F.length("read")).alias("avg_read_len"), F.max(F.length("read")).alias("max_read_len"))


def first_records(reads: DataFrame, n: int = 10) -> DataFrame:
    return reads.withColumn("r", F.row_number().over(Window.partitionBy("lib_id").orderBy("rec_id"))).filter(F.col("r") <= n).drop("r")
