"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlake.llm import embedding_dedup, filter_audit, language_id, line_dedup, minhash_dedup, mixing, packing, sharding, suffix_dedup, telephony, token_files, toxicity, whitening
from interlake.llm._spark import new_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperdimensional language profiles, learned outside the held-out fourth, for every document."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    model = language_id.train(docs, learn=~out)
    return language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 1024."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenized_pieces(docs, tokenizer=TOKENIZER, most=1024, end_id=2)
    return packing.pack(pieces, n_rows=packing.expected_pieces(docs), capacity=1024)


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, labels, learn=~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more among embeddings of one label, with their components."""
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents hold go from all of them."""
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under strings of 100 bytes that stand earlier go from every document."""
    kept = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document in a mix of all sources, weighted 1, 2, 3 in turn, at most 3 epochs."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's bytes stored as telephony audio in a table in the shared folder, read back, decoded, resampled and described."""
    folder = new_folder(spark, "telephony")
    telephony.store_payloads(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    read = telephony.decode_media(stored.select(F.struct("doc_id", "n_bytes").alias("row"), "media"), key="row", with_pcm=False, digests=True)
    return read.select("row.doc_id", "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to seekable zstandard files and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER, end_id=2)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every usable embedding on the first 16 components, and how well they are white."""
    return whitening.by_component(whitening.fit_and_apply(table(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000, k=16))


def op12_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near-equal bytes."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of all 120 orders, for each language."""
    masks = filter_audit.failures(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.with_labels(masks, table(spark, sf_dir, "labels")))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY doc_id
"""

OP8_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM totals),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size) OVER before, 0) * 3.0::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT min_by(level, source_size * 3.0::DOUBLE / weight) AS level FROM levels WHERE level * weight <= source_size * 3.0::DOUBLE),
targets AS (SELECT source, source_size, least(final.level * weight, source_size * 3.0::DOUBLE) AS target FROM weighed, final),
placed AS (SELECT *, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM sized),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, size, CAST(t.source_size AS BIGINT) AS source_size, target,
  CAST(size * CASE WHEN t.source_size = 0 THEN 0 ELSE floor(target / t.source_size)
    + CASE WHEN size > 0 AND upto - size / 2.0::DOUBLE < target - floor(target / t.source_size) * t.source_size THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM run JOIN targets t ON run.source IS NOT DISTINCT FROM t.source
"""

OP12_SQL = r"""
WITH RECURSIVE powers(n, c, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM powers WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM powers WHERE k = 8),
docs AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
bytes AS (SELECT doc_id, size, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT)) AS b FROM docs),
summed AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(b, lambda acc, x: xor(acc >> 8, crc.tab[(xor(acc, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc),
run AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY doc_id ASC NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (ORDER BY doc_id ASC NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS nth FROM summed),
placed AS (SELECT *, CAST(least(15, (2 * upto - size) * 16 // (2 * total)) AS INTEGER) AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""

OP13_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 10 * length(d.text) THEN 4 ELSE 0 END)
      + (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN d.doc_id > least THEN 16 ELSE 0 END) AS mask,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM worded d JOIN firsts f ON d.text = f.text LEFT JOIN said s ON d.doc_id = s.doc_id GROUP BY ALL),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM orders, range(1, 6) t(step)),
made AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, cells GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM made
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_toxicity_grammar": op3_toxicity_grammar,
    "op4_dart_minhash": op4_dart_minhash,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_water_filling_mix": op8_water_filling_mix,
    "op9_telephony_audio": op9_telephony_audio,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_prefix_sum_shards": op12_prefix_sum_shards,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op8_water_filling_mix": OP8_SQL, "op12_prefix_sum_shards": OP12_SQL, "op13_filter_audit": OP13_SQL}
