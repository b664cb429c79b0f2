"""Readers and writers on fresh fixtures."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.sources import reads as R
from helixframe.sources import records, sinks

FASTA = "junk before\n>r1 first\nACGTAC\nGTAC\n>r2\nNNACGT\n"
FASTQ = "@q1/1 a\nACGT\n+\nIIII\n@q1/2\nTTGCA\n+q1\n@II+>\n@empty\n\n+\n\n"
SAM = "@HD\tVN:1.6\nr1\t0\tchr1\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\tXT:A:U\tNM:i:1\nr2\t16\tchr1\t1\t60\t2S3M\t*\t0\t0\tTTACG\tIIIII\tNM:i:0\tXA:Z:chr2,-7,5M,2;chr3,+1,5M,0;\n"
RAW = "ACGTACGT\n\nGGGG\n"


@pytest.fixture
def files(tmp_path):
    made = {}
    for name, text in (("a.fasta", FASTA), ("a.fastq", FASTQ), ("a.sam", SAM), ("a.raw", RAW)):
        (tmp_path / name).write_text(text)
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
        made[name.split(".")[1]] = str(tmp_path / name)
    return made


def rows(df):
    return [(r["rec_id"], r["read"]) for r in df.orderBy("rec_id").collect()]


def test_types():
    assert R.file_type("x/A.FASTQ.GZ") == ("fastq", True)
    assert R.file_type("b.raw") == ("raw", False)
    for bad in ("a.fa", "a.fq", "a.txt", "a"):
        with pytest.raises(ValueError):
            R.file_type(bad)


@pytest.mark.parametrize("zipped", ["", ".gz"])
def test_scans(spark, files, zipped):
    read = lambda k: rows(R.read_library(spark, files[k] + zipped))
    assert [x for _, x in read("fasta")][-2:] == ["ACGTACGTAC", "NNACGT"]
    assert [x for _, x in read("fastq")] == ["ACGT", "TTGCA"]
    assert [x for _, x in read("sam")] == ["ACGT", "TTACG"]
    assert [x for _, x in read("raw")] == ["ACGTACGT", "GGGG"]


def test_fasta_skips_what_precedes_the_first_record(spark, files):
    got = R.read_fasta(spark, files["fasta"]).orderBy("rec_id").collect()
    assert [(r["pre"], r["read"]) for r in got] == [(">r1 first\n", "ACGTACGTAC"), (">r2\n", "NNACGT")]


def test_bad_fastq_header(spark, tmp_path):
    (tmp_path / "b.fastq").write_text("x1\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="must start with @"):
        R.read_fastq(spark, str(tmp_path / "b.fastq")).collect()


def test_fastq_round_trip(spark, files, tmp_path):
    lib = R.read_library(spark, files["fastq"])
    sinks.write_reads(lib.coalesce(1), str(tmp_path / "out"), "gzip")
    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == FASTQ.split("@empty")[0]


def test_fasta_wrap(spark, tmp_path):
    lib = spark.createDataFrame([(0, 0, ">a\n", "A" * 150, "\n", None)], "lib_id int, rec_id long, pre string, read string, post string, qual string")
    sinks.write_fasta(lib, str(tmp_path / "w"))
    text = "".join(p.read_text() for p in (tmp_path / "w").glob("part-*"))
    assert text == ">a\n" + "A" * 70 + "\n" + "A" * 70 + "\n" + "A" * 10 + "\n"


def test_sam(spark, files):
    a, b = R.read_sam(spark, files["sam"]).orderBy("qname").collect()
    assert (a["pos"], a["cigar"], a["nm"], a["xa"]) == (3, "4M", 1, "")
    alt = R.read_sam(spark, files["sam"]).filter("qname = 'r2'").select(R.alternatives(F.col("xa")).alias("x")).first()["x"]
    assert [(x["rname"], x["reverse"], x["pos"], x["nm"]) for x in alt] == [("chr2", True, 7, 2), ("chr3", False, 1, 0)]
    assert R.with_flags(R.read_sam(spark, files["sam"])).filter("is_reverse").count() == 1


def test_union_and_stats(spark, files):
    both = R.read_libraries(spark, [files["raw"], files["fastq"]])
    got = {r["lib_id"]: (r["num_reads"], r["avg_read_len"]) for r in R.library_stats(both).collect()}
    assert got == {0: (2, 6.0), 1: (2, 4.5)}
    assert R.read_contigs(spark, files["fasta"]).filter("rname = 'r1'").count() == 1


def test_small_sinks(spark, tmp_path):
    m = spark.createDataFrame([(3, 2.5)], "num_reads int, avg double")
    sinks.write_metrics(m, str(tmp_path / "sta"))
    assert sinks.read_metrics(spark, str(tmp_path / "sta")) == {"num_reads": "3", "avg": "2.5"}
    t = spark.createDataFrame([(2, [1, 2], 3, 5)], "ord int, chain array<int>, next_node int, freq int")
    sinks.save_markov(t, str(tmp_path / "mk"), 4, 6)
    assert sinks.load_markov(spark, str(tmp_path / "mk"), 4, 6).count() == 1
    with pytest.raises(ValueError):
        sinks.load_markov(spark, str(tmp_path / "mk"), 4, 7)


def records_of(r, n):
    """A FASTQ and a FASTA text with long and short records, quality lines that begin with any sign."""
    fastq, fasta, reads = "", "", []
    for i in range(n):
        size = r.choice([1, 3, 20, 90, 400])
        read = "".join(r.choices("ACGTN", k=size))
        quality = "".join(r.choices("@+>I#A", k=size))
        fastq += f"@q{i} x\n{read}\n+{r.choice(['', 'q'])}\n{quality}\n"
        cut = r.choice([7, 60, 1000])
        fasta += f">q{i} x\n" + "".join(read[a : a + cut] + "\n" for a in range(0, size, cut))
        reads.append((i, f"q{i} x", read, quality))
    return fastq, fasta, reads


@pytest.mark.parametrize("split", [97, 256, 1000, 100_000])
def test_any_split_gives_the_same_records(spark, tmp_path, split):
    import random

    fastq, fasta, want = records_of(random.Random(split), 60)
    (tmp_path / "a.fastq").write_text(fastq)
    (tmp_path / "a.fasta").write_text("junk\n" + fasta)
    (tmp_path / "a.raw").write_text("".join(x + "\n" for _, _, x, _ in want))
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [tuple(x) for x in R.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("rec_id").select("rec_id", "pre", "read", "qual").collect()]
        assert got == [(i, f"@{h}\n", x, q) for i, h, x, q in want]
        got = [tuple(x) for x in R.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("rec_id").select("rec_id", "pre", "read").collect()]
        assert got == [(i, f">{h}\n", x) for i, h, x, _ in want]
        assert rows(R.read_raw(spark, str(tmp_path / "a.raw"))) == [(i, x) for i, _, x, _ in want]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_folder_is_read_by_file_name(spark, tmp_path):
    (tmp_path / "d.fasta").mkdir()
    for i, name in enumerate(("b", "a", "c")):
        (tmp_path / "d.fasta" / name).write_text("".join(f">{name}{j}\n{'ACGT' * (50 if i == 2 else 1)}\n" for j in range(3)))
    got = R.read_fasta(spark, str(tmp_path / "d.fasta")).orderBy("rec_id").collect()
    assert [r["rec_id"] for r in got] == list(range(9))
    assert [r["pre"] for r in got] == [f">{n}{j}\n" for n in "abc" for j in range(3)]


def test_no_line_is_shuffled(spark, files):
    """The scan itself has no exchange; the one of the few lines between splits has been written before."""
    plan = R.read_fastq(spark, files["fastq"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_empty_files(spark, tmp_path):
    for kind in ("fasta", "fastq", "raw", "sam"):
        (tmp_path / f"e.{kind}").write_text("")
        assert R.read_library(spark, str(tmp_path / f"e.{kind}")).collect() == []
    (tmp_path / "n.fasta").write_text("no record\nat all\n")
    assert R.read_fasta(spark, str(tmp_path / "n.fasta")).collect() == []
    (tmp_path / "h.fasta").write_text(">only a header\n>x\n")
    assert rows(R.read_fasta(spark, str(tmp_path / "h.fasta"))) == [(0, ""), (1, "")]
    (tmp_path / "c.fastq").write_text("@a\nAC\n+\nII\n@b\nGG\n")
    assert rows(R.read_fastq(spark, str(tmp_path / "c.fastq"))) == [(0, "AC"), (1, "GG")]


def test_lines_are_numbered_without_python(spark, tmp_path):
    for name in ("raw", "sam"):
        path = tmp_path / f"many.{name}"
        path.write_text("".join(f"r{i}\n" if i % 3 else "\n" for i in range(5000)))
        found = records.scan(spark, str(path), name)
        assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r["rec_id"]: r["head"] for r in found.filter("head <> ''").collect()} == {i: f"r{i}" for i in range(5000) if i % 3}


def test_batches_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(records, "PIECE_BYTES", 50)
    b = pa.RecordBatch.from_pydict({"value": ["A" * 20] * 30 + [None, "", "C" * 500], "n": list(range(33))})
    pieces = list(records._pieces([b, b.slice(0, 0)]))
    assert [n for p in pieces for n in p.column(1).to_pylist()] == list(range(33)) and max(p.num_rows for p in pieces) < 6
