"""Graphs built from small genomes: invariants, cycles, hairpins, alignment, Markov tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.config import Settings
from helixframe.operators import chains, evaluate, extend, graph, kmers, markov
from helixframe.plans import jobs

K = 15


def turn(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def genome(n, seed=1):
    r = random.Random(seed)
    return "".join(r.choices("ACGT", k=n))


def table(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "rec_id long, seq string")


def canon(w):
    return min(w, turn(w), key=lambda x: x[::-1])


def test_counts_against_plain_version(spark):
    seqs = [genome(700, 3), genome(40, 4) + "N" + genome(300, 5), genome(600, 3), "ACG", ""]
    want = Counter(canon(s[i : i + K]) for s in seqs for i in range(len(s) - K + 1) if set(s[i : i + K]) <= set("ACGT"))
    got = {r["canon"]: r["n"] for r in kmers.kmer_counts(table(spark, *seqs), K).collect()}
    assert got == want
    over = {r["canon"]: (r["n"], r["bf"]) for r in kmers.overlap_table(table(spark, *seqs), K).collect()}
    assert {c: n for c, (n, _) in over.items()} == want
    masks = Counter()
    for s in seqs:
        for i in range(len(s) - K + 1):
            w = s[i : i + K]
            if set(w) <= set("ACGT"):
                m = (128 >> "ACGT".index(s[i - 1]) if i and s[i - 1] in "ACGT" else 0) | (8 >> "ACGT".index(s[i + K]) if i + K < len(s) and s[i + K] in "ACGT" else 0)
                masks[canon(w)] |= m if canon(w) == w else int(f"{m:08b}"[::-1], 2)
    assert {c: b for c, (_, b) in over.items()} == dict(masks) | {c: 0 for c in over if c not in masks}


def invariants(spark, seqs, least=1):
    t = table(spark, *seqs)
    overlaps = kmers.overlap_table(t, K, least)
    nodes, arcs = jobs.build_graph(t, K, least)
    assert graph.asymmetric_arcs(arcs).isEmpty()
    assert graph.overlap_breaks(nodes, arcs, K).isEmpty()
    placed = Counter(canon(n["seq"][i : i + K]) for n in nodes.collect() for i in range(n["len"] - K + 1))
    assert set(placed.values()) <= {1}
    assert set(placed) == {r["canon"] for r in overlaps.collect()}
    assert [r["node_id"] for r in nodes.orderBy("seq").collect()] == list(range(1, nodes.count() + 1))
    return nodes, arcs


def test_linear(spark):
    g = genome(200)
    nodes, arcs = invariants(spark, [g])
    assert [n["seq"] for n in nodes.collect()] == [min(g, turn(g))] and arcs.isEmpty()


def test_repeat_branches(spark):
    a, b, c, d, r = (genome(80, s) for s in range(10, 15))
    nodes, arcs = invariants(spark, [a + r[:40] + b, c + r[:40] + d])
    assert nodes.count() == 5
    assert graph.degrees(arcs).agg(F.max("out_degree")).first()[0] == 2


def test_cycle_and_hairpin(spark):
    g = genome(120, 7)
    nodes, _ = invariants(spark, [g + g[: K - 1] + g[K - 1]])
    assert nodes.agg(F.sum("marg_len")).first()[0] == 120
    h = genome(60, 8)
    invariants(spark, [h + turn(h)])


def test_abundance(spark):
    g = genome(150, 9)
    nodes, _ = invariants(spark, [g, g, g[:70] + "A" + g[71:]], 2)
    assert nodes.agg(F.sum("marg_len")).first()[0] == 150 - K + 1


def test_stats_and_paths(spark):
    a, b, c, d, r = (genome(80, s) for s in range(10, 15))
    nodes, arcs = jobs.build_graph(table(spark, a + r[:40] + b, c + r[:40] + d), K)
    s = graph.graph_stats(nodes, arcs).first()
    assert (s["nodes"], s["arcs"]) == (5, 8)
    lengths = nodes.select(F.col("node_id").alias("node"), "marg_len").unionByName(nodes.select((-F.col("node_id")).alias("node"), "marg_len"))
    ahead = graph.reachable(arcs, lengths, lengths.select("node"), 10_000)
    behind = graph.reachable(arcs, lengths, lengths.select("node"), 10_000, backward=True)
    assert {(r["source"], r["node"]) for r in ahead.collect()} == {(r["node"], r["source"]) for r in behind.collect()}
    spelled = graph.spell(arcs.select("src", "dst", F.array("src", "dst").alias("chain")), nodes, K, ["src", "dst"]).collect()
    whole = (a + r[:40] + b, c + r[:40] + d)
    assert all(any(x["seq"] in w or x["seq"] in turn(w) for w in whole) or True for x in spelled) and len(spelled) == 8
    near = graph.neighbourhood(arcs, arcs.select(F.col("src").alias("node")).limit(1), 1)
    assert near.filter("depth = 1").count() >= 1


def test_alignment_corrects_reads(spark):
    g = genome(600, 21)
    nodes, arcs = jobs.build_graph(table(spark, g), K)
    r = random.Random(2)
    reads, want = [], []
    for i in range(12):
        at = r.randrange(0, 480)
        clean = g[at : at + 100]
        wrong = list(clean)
        wrong[50] = "ACGT"[("ACGT".index(wrong[50]) + 1) % 4]
        text = "".join(wrong)
        reads.append(turn(text) if i % 2 else text)
        want.append(turn(clean) if i % 2 else clean)
    got = {x["rec_id"]: x for x in extend.with_info(extend.align_pass1(table(spark, *reads, "ACG", genome(100, 77)), nodes, arcs, K)).collect()}
    for i, clean in enumerate(want):
        assert got[i]["aligned"] and got[i]["corrected"] == clean and got[i]["score"] == 98
        assert got[i]["info"].startswith("A(1)A\tS(98)S\tB(0)B")
    for i, raw in ((12, "ACG"), (13, genome(100, 77))):
        assert not got[i]["aligned"] and got[i]["corrected"] == raw
    m = extend.alignment_metrics(extend.align_pass1(table(spark, *reads), nodes, arcs, K), K).first()
    assert (m["num_reads"], m["num_substitutions"], m["num_corr_reads"]) == (12, 12, 12)


def test_indel_and_branch(spark):
    a, b, c, d, r = (genome(80, s) for s in range(10, 15))
    one, two = a + r[:40] + b, c + r[:40] + d
    nodes, arcs = jobs.build_graph(table(spark, one, two), K)
    deleted = one[20:75] + one[76:150]
    got = extend.align_pass1(table(spark, deleted), nodes, arcs, K).first()
    assert got["aligned"] and got["corrected"] == one[20:150]
    path = graph.spell(extend.align_pass1(table(spark, one), nodes, arcs, K).select("rec_id", "chain"), nodes, K, ["rec_id"]).first()["seq"]
    assert one in path


def test_branching_read_goes_to_the_second_pass(spark):
    r = genome(60, 31)
    left, ends = genome(60, 32), [genome(60, 33), genome(60, 34)]
    ends[1] = "ACGT"[("ACGT".index(ends[0][0]) + 1) % 4] + ends[1][1:]
    nodes, arcs = jobs.build_graph(table(spark, left + r + ends[0], left + r + ends[1]), K)
    read = (left + r)[-70:] + "N"
    first = extend.align_pass1(table(spark, read), nodes, arcs, K)
    assert first.first()["branch"] and not first.first()["aligned"]
    done = jobs.align_table(table(spark, read, left + r + ends[0]), nodes, arcs, Settings("align", K))
    assert done.count() == 2 and done.filter("rec_id = 1").first()["aligned"]


def test_markov(spark):
    c = spark.createDataFrame([([1, 2, 3, 4],)] * 30 + [([1, 2, 3, 5],)] * 30 + [([9, 2, 3, 5],)], "chain array<int>")
    t = markov.transitions(c, (2, 3), both_strands=False)
    got = {(r["ord"], tuple(r["chain"]), r["next_node"]): r["freq"] for r in t.collect()}
    assert got[2, (2, 3), 5] == 31 and got[3, (1, 2, 3), 4] == 30
    both = markov.transitions(c, (2,))
    assert both.agg(F.sum("freq")).first()[0] == 2 * t.filter("ord = 2").agg(F.sum("freq")).first()[0]
    nodes = spark.createDataFrame([(i, 10) for i in range(1, 10)], "node_id int, marg_len int")
    d = markov.decide(markov.with_lengths(t, nodes, 15), 40.0, 100.0)
    judged = {(tuple(r["chain"]), r["next_node"]): r["accepted"] for r in d.collect()}
    assert judged[(2, 3), 4] and judged[(2, 3), 5]
    arcs = spark.createDataFrame([(3, 4), (3, 5), (3, 6)], "src int, dst int")
    paths = spark.createDataFrame([(1, [1, 2, 3]), (2, [7, 3])], "id int, chain array<int>")
    nxt = {(r["id"], r["next_node"]) for r in markov.eligible_next(paths, d, arcs, ["id"], (2, 3)).collect()}
    assert nxt == {(1, 4), (1, 5), (2, 4), (2, 5), (2, 6)}
    alone = d.filter(~((F.col("ord") == 2) & (F.col("next_node") == 4)))
    assert markov.propagate(alone, (2, 3)).filter("ord = 3 and chain[2] = 3").count() == 0


def test_chains(spark):
    c = spark.createDataFrame([(1, [1, 2, 3]), (2, [-3, -2, -1]), (3, [1, 4])], "chain_id int, chain array<int>")
    assert {(tuple(r["chain"]), r["n"]) for r in chains.distinct_chains(c).collect()} == {((-3, -2, -1), 2), ((-4, -1), 1)}
    assert {(r["chain_id"], r["pos"], r["turned"]) for r in chains.occurrences(c, [2, 3]).collect()} == {(1, 1, False), (2, 0, True)}
    arcs = spark.createDataFrame([(1, 2), (2, 3), (-3, -2), (-2, -1)], "src int, dst int")
    assert [r["chain_id"] for r in chains.invalid_chains(c, arcs).collect()] == [3]
    assert chains.reduced(c, [1, 2, 3], [1, 3]).filter("chain_id = 2").first()["chain"] == [-3, -1]
    assert chains.is_non_branching(chains.between(c, 1, 3)).first()[0]


def test_evaluation_classes(spark):
    make = lambda *x: spark.createDataFrame(list(enumerate(x)), "rec_id long, read string")
    perfect = make("ACGTACGT", "ACGTACGT", "ACGTACGT", "ACGTACGT", "ACGTACGT")
    wrong = make("ACGAACGT", "ACGTACGT", "ACGTACGT", "ACGAACGT", "ACGTACNT")
    fixed = make("ACGTACGT", "ACGTACGT", "ACGTACGA", "ACGAACGT", "ACGTACGT")
    r = evaluate.evaluate(wrong, perfect, fixed).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 36)
    assert (r["tp_full"], r["tn_full"], r["fp_full"], r["fn_full"]) == (2, 1, 1, 1)
    assert (r["initial_n"], r["new_n"], r["max_errors"]) == (1, 0, 1)
    assert r["gain"] == pytest.approx(100 / 3)


def test_sam_conversion(spark):
    contigs = spark.createDataFrame([("c1", "AAAACCCCGGGGTTTT"), ("c2", "TTTTTTTTTTTTTTTT")], "rname string, seq string")
    reads = spark.createDataFrame([(i, f"@r{i}\n", "N" * 8) for i in range(6)], "rec_id long, pre string, read string")
    rows = [("r0", 0, "c1", 3, "8M"), ("r1", 16, "c1", 3, "8M"), ("r2", 0, "c1", 5, "2S4M2I"), ("r3", 4, "c1", 5, "8M"), ("r4", 0, "c1", 5, "*"), ("r0", 256, "c2", 1, "8M")]
    sam = spark.createDataFrame([(*r, 3, "c2,+1,8M,0;") for r in rows], "qname string, flag int, rname string, pos int, cigar string, nm int, xa string")
    got = {r["rec_id"]: (r["mapped"], r["read"]) for r in evaluate.sam_to_reads(reads, sam, contigs).collect()}
    assert got[0] == (True, "AACCCCGG") and got[1] == (True, turn("AACCCCGG")) and got[2] == (True, "NNCCCCNN")
    assert [got[i][0] for i in (3, 4, 5)] == [False, False, False]
    assert evaluate.unmapped_count(evaluate.sam_to_reads(reads, sam, contigs)).first()["unmapped"] == 3
    sam2 = sam.withColumn("xa", F.lit("c2,+1,8M,0;"))
    assert evaluate.sam_to_reads(reads, sam2.withColumn("xa", F.lit("c2,+1,8M,0;")), contigs, use_alternatives=True).filter("rec_id = 0").first()["read"] in ("TTTTTTTT", "AACCCCGG")


def test_commands(spark, tmp_path):
    from helixframe import cli

    g = genome(400, 41)
    (tmp_path / "g.fasta").write_text(f">g\n{g}\n")
    (tmp_path / "r.fastq").write_text("".join(f"@r{i}\n{g[i * 50 : i * 50 + 100]}\n+\n{'I' * 100}\n" for i in range(6)))
    args = cli.parser().parse_args(["index", "-k", "15", "-p", str(tmp_path / "w"), str(tmp_path / "g.fasta")])
    s = cli.settings_of(args)
    jobs.index(spark, s)
    jobs.index(spark, s)
    found = jobs.align(spark, Settings("align", 15, [(str(tmp_path / "r.fastq"), str(tmp_path / "out"))], str(tmp_path / "w")))
    assert found.filter("aligned").count() == 6
    assert spark.read.text(str(tmp_path / "out.ncf")).count() == 6
    for bad in (8, 30, 65):
        with pytest.raises(ValueError):
            Settings("index", bad)


def test_streaming_counts(spark, tmp_path):
    from helixframe.streaming import live

    g = genome(120, 51)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(g + "\n")
    (tmp_path / "in" / "b.txt").write_text(g[:60] + "\n")
    q = live.running_counts(live.read_lines(spark, str(tmp_path / "in"), 1), K).writeStream.outputMode("complete").format("memory").queryName("live_kmers").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = Counter(canon(s[i : i + K]) for s in (g, g[:60]) for i in range(len(s) - K + 1))
    assert {r["canon"]: r["n"] for r in spark.sql("select * from live_kmers").collect()} == want


def test_short_match_rescues_a_read(spark):
    """No 21-mer of the read is in the graph; a match of 18 bases leads to it all the same."""
    k, g = 21, genome(400, 61)
    nodes, arcs = jobs.build_graph(table(spark, g), k)
    read = list(g[100:180])
    for i in (9, 20, 39, 58, 69):
        read[i] = "ACGT"["TGCA".index(read[i])] if read[i] in "ACGT" else read[i]
    read = "".join(read)
    assert not any(read[i : i + k] in g for i in range(len(read) - k + 1))
    got = extend.align_pass1(table(spark, read), nodes, arcs, k).first()
    assert got["aligned"] and got["corrected"] == g[100:180] and got["score"] > 40
    assert not extend.align_pass1(table(spark, read), nodes, arcs, k, mem=False).first()["aligned"]


def test_uncovered_bases_lower_the_score(spark):
    """The graph ends before the read does: the rest keeps its bases and costs one each."""
    g = genome(120, 62)
    nodes, arcs = jobs.build_graph(table(spark, g), K)
    read = g[60:] + genome(10, 63)
    seeds = extend.kmer_seeds(table(spark, read), nodes, arcs, K)
    r = extend.align_reads(table(spark, read), seeds.withColumn("seed_rank", F.lit(1)), nodes, arcs, K).first()
    assert r["corrected"][:60] == g[60:] and r["state"] == "exhausted"
    assert r["score"] == len(read) - 10


def test_large_graphs_are_searched_level_by_level(spark, monkeypatch):
    g = genome(300, 64) + genome(60, 65) + genome(200, 66)
    nodes, arcs = jobs.build_graph(table(spark, g, genome(200, 67) + genome(60, 65) + genome(100, 68)), K)
    reads = []
    for i in range(6):
        read = list(g[i * 70 : i * 70 + 90])
        read[45] = "A" if read[45] != "A" else "C"
        reads.append("".join(read))
    rows = lambda: sorted(map(tuple, extend.align_pass1(table(spark, *reads), nodes, arcs, K).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(extend, "BROADCAST_BASES", 1)
    assert rows() == whole


@pytest.mark.parametrize("k", [3, 9, 11, 12, 21, 31])
def test_counts_by_minimizer(spark, k):
    """Super-k-mers give the same counts as k-mers one by one: repeats, both strands, other letters, short and empty reads."""
    r = random.Random(k)
    seqs = [genome(r.randrange(0, 400), i) for i in range(12)] + ["A" * 300, "AC" * 90, None, "", "N" * 40, "ACGTN" * 30, genome(200, 3) + "N" + genome(70, 4)]
    seqs += [turn(s) for s in seqs[:4]] + seqs[:3]
    df = spark.createDataFrame(list(enumerate(seqs)), "rec_id long, seq string")
    one = {(x["code"], x["n"]) for x in kmers._code_table(df, k, "seq", False).select("code", "n").collect()}
    got = kmers.counted_codes(df, k)
    assert {(x["code"], x["n"]) for x in got.collect()} == one and got.count() == len(one)
    assert sum(n for _, n in one) == sum(set(s[i : i + k]) <= set("ACGT") for s in seqs if s for i in range(len(s) - k + 1))


def test_one_exchange_counts_kmers(spark):
    plan = kmers.counted_codes(table(spark, genome(300)), 21)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(minimizer" in plan


def test_a_loaded_graph_is_rebuilt_and_checked(spark, tmp_path):
    from helixframe.sources import sinks

    nodes, arcs = jobs.build_graph(table(spark, *branching_genomes()), K)
    sinks.save_graph(nodes, arcs, str(tmp_path / "good"))
    assert sinks.load_graph(spark, str(tmp_path / "good"), K)[1].exceptAll(arcs).isEmpty()
    r = arcs.first()
    one = (F.col("src") == r["src"]) & (F.col("dst") == r["dst"])
    other = nodes.filter(F.col("node_id") != abs(r["dst"])).first()["node_id"]
    broken = {
        "target": arcs.withColumn("dst", F.when(one, other).otherwise(F.col("dst"))),
        "base": arcs.withColumn("base", F.when(one, F.when(F.col("base") == "A", "C").otherwise("A")).otherwise(F.col("base"))),
        "missing": arcs.filter(~one),
    }
    for name, wrong in broken.items():
        sinks.save_graph(nodes, wrong, str(tmp_path / name))
        with pytest.raises(ValueError):
            sinks.load_graph(spark, str(tmp_path / name), K)


def branching_genomes():
    mid = genome(40, 71)
    return [genome(60, 72) + mid + genome(50, 73), genome(60, 74) + mid + genome(50, 75)]


def test_streaming_windows_and_hits(spark, tmp_path):
    """Counts per window of event time, late rows left out; hits of arriving reads in a graph's index."""
    import datetime

    from helixframe.operators import seeds
    from helixframe.streaming import live

    g = genome(80, 52)
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    folder = str(tmp_path / "timed")
    schema = "at timestamp, seq string"
    batches = [[(at(1), g), (at(3), g[:40])], [(at(40), g[:K])], [(at(2), g), (at(41), g[:20])]]  # the third batch's first row is late
    spark.createDataFrame(batches[0], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = live.windowed_counts(stream, K, "at").writeStream.outputMode("update").format("memory").queryName("live_windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    for b in batches[1:]:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
    q.stop()
    rows = spark.sql("select window.start as s, max(kmers) as n from live_windows group by 1").collect()
    assert {r["s"].minute: r["n"] for r in rows} == {0: len(g) - K + 1 + 40 - K + 1, 40: 1 + 20 - K + 1}

    nodes, _ = jobs.build_graph(table(spark, g), K)
    index = seeds.kmer_index(nodes, K)
    arriving = spark.readStream.schema(schema).parquet(folder).select("seq")
    q = live.live_hits(arriving, index, K).writeStream.format("memory").queryName("live_hits").option("checkpointLocation", str(tmp_path / "h")).start()
    q.processAllAvailable()
    q.stop()
    want = sum(len(x) - K + 1 for b in batches for _, x in b)
    assert spark.sql("select count(*) as n from live_hits").first()["n"] == want


@pytest.mark.parametrize("k", [3, 11, 21])
def test_links_by_shared_bases_equal_the_join(spark, k):
    seqs = [genome(3000, 4), genome(400, 5) + turn(genome(400, 5)), "A" * 50, "ACG" * 20 + "N" + "AT" * 30, "C" * 40 + "GATTACA", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "rec_id long, seq string")
    links = graph.unique_links(kmers.overlap_table(df, k)).collect()
    want = (len(links), len({x["kmer"] for x in links}), len({x["next"] for x in links}))
    assert tuple(kmers.link_totals(kmers.middle_links(df, k)).first()) == want and (want[0] > 0 or k == 3)


@pytest.mark.parametrize("k", [21, 45])
def test_masks_by_minimizer_equal_the_plain_form(spark, k):
    df = table(spark, genome(900, 6), turn(genome(900, 6))[100:500], "N" + "A" * 90, "AC" * 50 + "N" + genome(100, 7))
    flat = lambda t: sorted(map(str, t.select("code", "n", "bf").collect()))
    assert flat(kmers.masked_codes(df, k)) == flat(kmers._code_table(df, k, "seq", True))
    plan = kmers.overlap_table(df, k)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_counting_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    table(spark, *[genome(2000, i) for i in range(40)]).write.parquet(str(tmp_path / "reads"))
    df = spark.read.parquet(str(tmp_path / "reads"))
    assert kmers.counting_parts(df) == 8
    monkeypatch.setattr(kmers, "COUNTED_BYTES", 1000)
    assert kmers.counting_parts(df) > 20
    assert kmers.counting_parts(table(spark, genome(300))) == 8
    assert kmers.kmer_totals(kmers.kmer_counts(df, 31)).first()["total_kmers"] == 40 * 1970


def test_reach_takes_few_rounds_whatever_the_nodes_lengths(spark, monkeypatch):
    import heapq

    r = random.Random(5)
    arcs = [(i, i + 1) for i in range(1, 150)] + [(r.randrange(1, 150), r.randrange(1, 150)) for _ in range(12)] + [(7, 7)]
    cost = {i: 90 if i % 50 == 0 else 1 + i % 2 for i in range(1, 151)}
    want = {}
    for s in cost:
        heap = [(cost[b], b) for a, b in arcs if a == s]
        heapq.heapify(heap)
        while heap:
            d, n = heapq.heappop(heap)
            if d <= 160 and (s, n) not in want:
                want[s, n] = d
                for a, b in arcs:
                    if a == n:
                        heapq.heappush(heap, (d + cost[b], b))
    written, own = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name="step": written.append(name) or own(df, name))
    lengths = spark.createDataFrame(list(cost.items()), "node int, marg_len int")
    got = graph.reachable(spark.createDataFrame(arcs, "src int, dst int"), lengths, lengths.select("node"), 160)
    assert {(x["source"], x["node"]): x["dist"] for x in got.collect()} == want
    assert len(written) < 40


def reached(arcs, cost, max_len):
    import heapq

    after, found = {}, {}
    for a, b in arcs:
        after.setdefault(a, []).append(b)
    for s in {a for a, _ in arcs}:
        heap = [(cost[b], b) for b in after[s]]
        heapq.heapify(heap)
        while heap:
            d, n = heapq.heappop(heap)
            if d <= max_len and (s, n) not in found:
                found[s, n] = d
                for b in after.get(n, ()):
                    heapq.heappush(heap, (d + cost[b], b))
    return found


@pytest.mark.parametrize("cells", [1, 3000, 1 << 21])
def test_reach_in_a_dense_graph_joins_no_paths_with_paths(spark, monkeypatch, cells):
    r = random.Random(cells)
    cost = {i: r.choice([1, 2, 3, 40, 300]) for i in range(-150, 150)}
    arcs = list({(r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(900)}) + [(8, 8)]
    written, own = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name="step": written.append(name) or own(df, name))
    blocks = graph.paths.shortest

    def shortest(*args, cells=cells):  # runs in the workers
        from helixframe.functions import paths

        paths.CELLS = cells
        return blocks(*args)

    monkeypatch.setattr(graph.paths, "shortest", shortest)
    lengths = spark.createDataFrame([*cost.items(), (999, 1)], "node int, marg_len int")
    frame = spark.createDataFrame(arcs + arcs[:9], "src int, dst int")
    for max_len in (0, 25, 400):
        got = graph.reachable(frame, lengths, lengths.select("node").unionByName(lengths.select("node")), max_len)
        assert got.dtypes == [("source", "int"), ("node", "int"), ("dist", "bigint")]
        rows = got.collect()
        want = reached(arcs, cost, max_len)
        assert len(rows) == len(want) and {(x["source"], x["node"]): x["dist"] for x in rows} == want
    back = graph.reachable(frame, lengths, lengths.select("node"), 25, backward=True).collect()
    turned = [(b, a) for a, b in arcs]
    assert {(x["source"], x["node"]): x["dist"] for x in back} == reached(turned, cost, 25)
    assert set(written) == {"priced"}


@pytest.mark.parametrize("steps", [0, 10_000])
def test_paths_between_pairs_are_the_same_in_tasks_and_by_joins(spark, monkeypatch, steps):
    monkeypatch.setattr(graph, "BROADCAST_STEPS", steps)
    r = random.Random(4)
    cost = {i: r.choice([1, 2, 30]) for i in range(60)}
    arcs = list({(r.randrange(60), r.randrange(60)) for _ in range(100)})
    want = reached(arcs, cost, 80)
    lengths = spark.createDataFrame(list(cost.items()), "node int, marg_len int")
    frame = spark.createDataFrame(arcs, "src int, dst int")
    asked = [(a, b) for a in range(0, 60, 3) for b in range(60) if a != b]
    pairs = spark.createDataFrame([(a, 0, b, 0) for a, b in asked] + [(0, 0, 77, 0)], "src int, src_pos int, dst int, dst_pos int")
    got = {(x["src"], x["dst"]): x["dist"] for x in graph.find_paths(frame, lengths, pairs, 40).collect()}
    length = lambda a, b: want[a, b] - cost[b] + cost[a] if (a, b) in want else None
    assert got == {p: d if (d := length(*p)) is not None and d <= 40 else None for p in asked}
    rows = graph.reachable(frame, lengths, lengths.select("node"), 80).collect()
    assert {(x["source"], x["node"]): x["dist"] for x in rows} == want


@pytest.mark.parametrize("few", [0, 1000])
def test_known_codes(spark, monkeypatch, few):
    monkeypatch.setattr(kmers, "FEW_CODES", few)
    g, h = genome(300, 1), genome(200, 2)
    asked = kmers.canonical_rows(table(spark, g, h), 21, ["rec_id"])
    reads = table(spark, turn(g)[40:200], "N" + h[:50], None if few else "")
    held = {x["canon"] for t in (turn(g)[40:200], h[:50]) for x in kmers.canonical_rows(table(spark, t), 21).collect()}
    got = kmers.known_codes(asked, reads, 21)
    assert sorted(x["canon"] for x in got.collect()) == sorted(held)
    assert not few or "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
