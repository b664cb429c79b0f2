"""Seeding: k-mer index lookup, islands of consistent hits, exact matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import suffixes
from .kmers import canonical_rows

MEM_LEAST = 16
MEM_ENOUGH = 100
KEPT_SEEDS = 10
#: Reads of so many bases or fewer are broadcast to the index, about 30 bytes a base.
BROADCAST_BASES = 1_000_000
#: For exact matches, about a kilobyte a base.
BROADCAST_MATCH_BASES = 100_000


def kmer_index(nodes: DataFrame, k: int) -> DataFrame:
    """``canon, node, pos, marg_len``: where each canonical k-mer lies, in the canonical strand's coordinates."""
    rows = canonical_rows(nodes.select("node_id", "seq", "marg_len"), k, ["node_id", "marg_len"])
    turned = F.col("turned")
    return rows.select("canon", F.when(turned, -F.col("node_id")).otherwise(F.col("node_id")).alias("node"), F.when(turned, F.col("marg_len") - 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), "marg_len")


def lookup(reads: DataFrame, index: DataFrame, k: int, key: str = "rec_id", how: str = "inner") -> DataFrame:
    """``key, rpos, node, pos, marg_len``: each read k-mer's place in the graph, strand by strand.

    The reverse complement of (node, pos) is (-node, marg_len - 1 - pos).  Reads of few bases (counted
    first) are broadcast, so that the index isn't shuffled for them.
    """
    asked = canonical_rows(reads, k, [key]).withColumnRenamed("pos", "rpos")
    if how == "inner" and not reads.isStreaming and (reads.agg(F.sum(F.length("seq"))).first()[0] or 0) <= BROADCAST_BASES:
        asked = F.broadcast(asked)
    hit = asked.join(index, "canon", how)
    return hit.select(key, "rpos", F.when(F.col("turned"), -F.col("node")).otherwise(F.col("node")).alias("node"), F.when(F.col("turned"), F.col("marg_len") - 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), "marg_len")


def islands(hits: DataFrame, arcs: DataFrame | None = None, key: str = "rec_id") -> DataFrame:
    """``key, chain, node_first, read_first, read_end``: runs of consistent hits.

    A hit continues its predecessor on the same node at the same shift, or, over an arc, from the
    node's last k-mer to the next node's first; invalid k-mers in between only widen the gap.
    """
    w = Window.partitionBy(key).orderBy("rpos", "node", "pos")
    prev = lambda c: F.lag(c).over(w)
    h = hits.select("*", prev("node").alias("p_node"), prev("pos").alias("p_pos"), prev("rpos").alias("p_rpos"), prev("marg_len").alias("p_len"))
    same = (F.col("node") == F.col("p_node")) & (F.col("pos") - F.col("p_pos") == F.col("rpos") - F.col("p_rpos")) & (F.col("pos") > F.col("p_pos"))
    if arcs is not None:
        known = arcs.select(F.col("src").alias("p_node"), F.col("dst").alias("node"), F.lit(True).alias("arc")).distinct()
        h = h.join(known, ["p_node", "node"], "left")
        gap = F.col("p_len") - F.col("p_pos") + F.col("pos")
        same = same | (F.coalesce("arc", F.lit(False)) & (gap == F.col("rpos") - F.col("p_rpos")))
    h = h.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    h = h.withColumn("island", F.sum("new").over(Window.partitionBy(key).orderBy("rpos", "node", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    grouped = h.groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("rpos", "node", "pos"))).alias("x"))
    nodes = F.transform("x", lambda v: v["node"])
    chain = F.aggregate(nodes, F.array().cast("array<int>"), lambda a, n: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1) == n), a).otherwise(F.concat(a, F.array(n.cast("int")))))
    return grouped.select(key, chain.alias("chain"), F.col("x")[0]["pos"].cast("int").alias("node_first"), F.col("x")[0]["rpos"].cast("int").alias("read_first"), (F.element_at("x", -1)["rpos"] + 1).cast("int").alias("read_end"))


def merged_seeds(seeds: DataFrame, key: str = "rec_id") -> DataFrame:
    """Adjacent single-node seeds on one diagonal merged, by node and offset."""
    node = F.col("chain")[0]
    w = Window.partitionBy(key, node).orderBy("node_first", "read_first")
    diagonal = F.col("node_first") - F.col("read_first")
    single = seeds.filter(F.size("chain") == 1)
    marked = single.withColumn("new", F.when(F.lag(diagonal).over(w) == diagonal, 0).otherwise(1))
    run = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = run.groupBy(key, node.alias("n"), "run").agg(F.first("chain").alias("chain"), F.min("node_first").alias("node_first"), F.min("read_first").alias("read_first"), F.max("read_end").alias("read_end")).drop("n", "run")
    return merged.unionByName(seeds.filter(F.size("chain") > 1).select(*merged.columns))


def top_seeds(seeds: DataFrame, limit: int = KEPT_SEEDS, key: str = "rec_id", trim: int | None = None) -> DataFrame:
    """The longest seeds of each read (W07, O02); with ``trim`` = k, each end gives up to k - 1 k-mers back."""
    length = F.col("read_end") - F.col("read_first")
    w = Window.partitionBy(key).orderBy(length.desc(), "read_first", "chain", "node_first")
    kept = seeds.withColumn("seed_rank", F.row_number().over(w)).filter(F.col("seed_rank") <= limit)
    return kept if trim is None else kept.withColumn("read_end", (F.col("read_end") - F.least(F.lit(trim - 1), length - 1)).cast("int"))


def best_candidates(candidates: DataFrame, key: str = "rec_id", score: str = "score", order: str = "seed_rank") -> DataFrame:
    """The best candidate of each read, the first of equals (W08), and how many share its score."""
    w = Window.partitionBy(key)
    ranked = candidates.withColumn("r", F.row_number().over(w.orderBy(F.desc(score), order))).withColumn("top", F.max(score).over(w))
    tied = ranked.withColumn("ties", F.count_if(F.col(score) == F.col("top")).over(w))
    return tied.filter("r = 1").drop("r", "top")


def _carried(source):
    """Sorted rows with the last slot at or before each, within the partition, and the partition's number."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None
    for b in source:
        where = b.schema.names.index("slot")
        own = b.column(where)
        own = pa.concat_arrays([pa.nulls(1, own.type) if last is None else last, own])
        at = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), np.arange(len(own)), 0))
        own = own.take(pa.array(at))
        last = own.slice(len(own) - 1)
        rows = b.set_column(where, "slot", own.slice(1))
        yield rows.append_column("part", pa.array(np.full(b.num_rows, part, np.int32)))


def located(points: DataFrame, slots: DataFrame) -> DataFrame:
    """``points`` with the ``node_id, start`` of the slot that holds their ``position``: the last start at or before it.

    An as-of join in one pass: both sides are range-partitioned by position and sorted together,
    each partition carries its last start along, and the last start of the partitions before (a row
    for each partition) fills in what comes ahead of a partition's first.  A slot's width costs
    nothing, and many points at one position spread over partitions.  Points before the first start,
    at or beyond their slot's ``end`` (if slots have one) or without a position are left out; of slots
    with one start the last by end and id counts.
    """
    spark = points.sparkSession
    ended = "end" in slots.columns
    slot = F.struct(F.col("start").cast("long").alias("start"), (F.col("end") if ended else F.lit(None)).cast("long").alias("end"), F.col("node_id"))
    point = F.struct(*points.columns)
    nothing = lambda c, df: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    both = slots.filter("start is not null").select(F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), slot.alias("slot"), nothing(point, points).alias("point"))
    both = both.unionByName(points.filter("position is not null").select(F.col("position").cast("long").alias("at"), F.lit(1).alias("kind"), nothing(slot, slots).alias("slot"), point.alias("point")))
    order = ["at", "kind", "slot", "spread"]
    dealt = both.withColumn("spread", F.when(F.col("kind") == 1, F.monotonically_increasing_id()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*dealt.drop("spread").schema.fields, T.StructField("part", T.IntegerType())])
    sorted_rows = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("spread")
    placed = materialise(sorted_rows.mapInArrow(_carried, schema), "placed")
    carried, last = [], None
    for r in placed.groupBy("part").agg(F.max("slot").alias("slot")).orderBy("part").collect():  # a row for each partition
        carried.append((r["part"], last))
        last = r["slot"] or last
    before = F.broadcast(spark.createDataFrame(carried, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", both.schema["slot"].dataType)])))
    found = placed.filter("kind = 1").join(before, "part").withColumn("slot", F.coalesce("slot", "before")).filter("slot is not null")
    if ended:
        found = found.filter("at < slot.end")
    return found.select("point.*", "slot.node_id", "slot.start")


def exact_matches(reads: DataFrame, nodes: DataFrame, least: int = MEM_LEAST, key: str = "rec_id", both_strands: bool = True) -> DataFrame:
    """``key, node, node_first, read_first, length``: maximal exact matches of ``least`` bases or more.

    Windows of ``least`` bases (at most 21, longer matches are filtered) are joined as codes where a match begins and where one ends,
    so that only true matches are made.  Reads of few bases (counted first) are broadcast.
    """
    window = min(least, suffixes.LETTERS)
    held = suffixes.places(nodes.select(F.col("node_id").alias("node"), "seq"), window, "node")
    lengths = nodes.select(F.col("node_id").alias("node"), F.length("seq").alias("length"))
    few = (reads.agg(F.sum(F.length("seq"))).first()[0] or 0) <= BROADCAST_MATCH_BASES
    found = suffixes.matches(reads, held, lengths, window, key, both_strands, few)
    return found.filter(F.col("length") >= least) if least > window else found


def adaptive_matches(matches: DataFrame, k: int, key: str = "rec_id", enough: int = MEM_ENOUGH) -> DataFrame:
    """Per read, matches of the greatest least length (from k - 1 down) that gives ``enough`` of them."""
    capped = F.least(F.col("length"), F.lit(k - 1))
    counted = matches.groupBy(key, capped.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    running = counted.withColumn("sum", F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("l")).rowsBetween(Window.unboundedPreceding, 0)))
    cut = running.filter(F.col("sum") >= enough).groupBy(key).agg(F.max("l").alias("cut"))
    return matches.join(cut, key, "left").filter(F.col("cut").isNull() | (F.col("length") >= F.col("cut"))).drop("cut")


def unique_matches(matches: DataFrame, reads: DataFrame, key: str = "rec_id", seq: str = "seq", in_read_too: bool = True) -> DataFrame:
    """Matches whose text occurs once among the matches (J16): in the graph, and in the reads too unless told otherwise."""
    spelled = matches.join(reads.select(key, F.col(seq).alias("s__")), key).withColumn("text", F.substring(F.col("s__"), F.col("read_first") + 1, F.col("length").cast("int"))).drop("s__")
    places = spelled.select("text", "node", "node_first").distinct().groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    out = spelled.join(places.filter("n = 1").select("text"), "text", "left_semi")
    if in_read_too:
        uses = spelled.select("text", key, "read_first").distinct().groupBy("text").agg(F.count(F.lit(1)).alias("n"))
        out = out.join(uses.filter("n = 1").select("text"), "text", "left_semi")
    return out


def find_pattern(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes that hold a whole pattern, and where."""
    return nodes.withColumn("at", F.instr("seq", pattern)).filter("at > 0").select("node_id", "at")


def match_seeds(matches: DataFrame, lengths: DataFrame, read_lengths: DataFrame, k: int, key: str = "rec_id", trimmed: bool = True) -> DataFrame:
    """Matches as seeds in k-mer offsets; those that begin beyond the last k-mer of node or read are dropped.

    Not ``trimmed``, a seed ends where its match does, in bases.
    """
    own = lengths.select(F.col("node").alias("node"), "marg_len")
    both = matches.join(own, "node").join(read_lengths.select(key, F.col("read_marg").alias("read_marg")), key)
    inside = both.filter("node_first < marg_len and read_first < read_marg")
    count = F.greatest(F.col("length") - (k - 1), F.lit(1)) if trimmed else F.col("length")
    return inside.select(key, F.array(F.col("node").cast("int")).alias("chain"), F.col("node_first").cast("int").alias("node_first"), F.col("read_first").cast("int").alias("read_first"), (F.col("read_first") + count).cast("int").alias("read_end"))


def seed_places(seeds: DataFrame, key: str = "rec_id") -> DataFrame:
    """A single-node seed as one row per k-mer."""
    return seeds.select(key, F.explode(F.sequence(F.lit(0), F.col("read_end") - F.col("read_first") - 1)).alias("i"), "chain", "node_first", "read_first").select(key, (F.col("read_first") + F.col("i")).alias("rpos"), F.col("chain")[0].alias("node"), (F.col("node_first") + F.col("i")).alias("pos"))
