"""The thirteen operators applied to the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, jaccard_join, line_dedup, packing, pii, resample, sharding, suffix_lm, topk, toxicity, vector_codes, warc
from .common import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    made = bpe.encode_decode(docs, "text", public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(divisor: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == rest


def op2_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    scored = suffix_lm.score_texts(docs, ~held_out(7, 2))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary", "states")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs, details=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = jaccard_join.similar_groups(docs, size=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "class_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    placed = sharding.shard_by_size(docs, shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    scored = toxicity.classify(docs, labels, ~held_out(5, 0))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = warc.round_trip(pages)
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    made = fingerprint.fingerprint_edits(docs)
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("sketch")).alias("fingerprint"), F.lower(F.hex("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "contained", "n_distinct")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    coded, books = vector_codes.compress(vectors)
    summed = vector_codes.with_label_error(coded)
    return summed.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    target = read_table(spark, sf_dir, "benchmark", "text")
    drawn = resample.resample(docs, target)
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_suffix_lm, op3_line_dedup, op4_jaccard_join, op5_sharding, op6_toxicity, op7_warc, op8_packing, op9_topk, op10_fingerprint, op11_vector_codes, op12_pii, op13_resample)}


_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACE}), {_UPPER}, {_LOWER}) AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT a.doc_id, pos, line, s.k IS NOT NULL AND a.doc_id <> s.first_id AS dropped FROM keyed a LEFT JOIN shared s ON a.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""




def _lloyd_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Rounds of assignment and movement as a chain of materialised steps."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {parts} AS size FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false))""",
  f"cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * size + 1:(p + 1) * size] AS x FROM kept, unnest(range({parts})) t(p))",
  f"book0 AS MATERIALIZED (SELECT p, e - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM cut) f WHERE e <= {entries})"]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT c.vec_id, c.label, c.p, c.x, b.e, (list_inner_product(c.x, c.x) - 2 * list_inner_product(c.x, b.x) + list_inner_product(b.x, b.x))::BIGINT AS d FROM cut c JOIN book{r} b ON c.p = b.p) s
  GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS MATERIALIZED (
  SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM (
    SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, best.e, i) g GROUP BY p, e)""")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)")
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT vec_id, any_value(label) AS label, lower(string_agg(printf('%02x', best.e), '' ORDER BY p)) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""


def _crc32_sql(bytes_list: str) -> str:
    """CRC-32 of a list of byte values; ``t`` is the table of 256 remainders."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


OP13_SQL = rf"""
WITH RECURSIVE bit AS (
  SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bit WHERE k = 8),
texts AS MATERIALIZED (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
counted AS MATERIALIZED (SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS word FROM texts) x GROUP BY ALL),
named AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted) x),
bucketed AS MATERIALIZED (
  SELECT word, {_crc32_sql("list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)")} % 10000 AS bucket FROM named, crc),
totals AS MATERIALIZED (
  SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 'b') AS t FROM counted JOIN bucketed USING (word) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM totals),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(totals.t, 0)::DOUBLE + 1) * (whole.s::DOUBLE + 10000) / ((coalesce(totals.s, 0)::DOUBLE + 1) * (whole.t::DOUBLE + 10000))))::BIGINT AS gain FROM totals, whole),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM counted JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT x.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || x.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts x LEFT JOIN weights y ON x.doc_id = y.doc_id WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM placed
"""


def oracle_sql() -> dict:
    return {"op3_line_dedup": OP3_SQL, "op9_topk": OP9_SQL, "op11_vector_codes": _lloyd_sql(), "op13_resample": OP13_SQL}
