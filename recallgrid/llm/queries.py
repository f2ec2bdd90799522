"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codebooks, exact_dedup, extraction, fingerprints, langid, minhash, mixing, resampling, token_counts, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


MIX_WEIGHTS = [3.0, 1.0, 2.0]


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.5, cap=2)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", "copies")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprints(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("own_sketch")).alias("fingerprint"),
        fingerprints.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own_sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("own_sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.build_derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    head = lambda name: F.element_at("headers", name)
    return made.select(
        "page_id", "type", "record_id", head("WARC-Refers-To").alias("refers_to"), head("WARC-Concurrent-To").alias("concurrent_to"), "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), head("WARC-Block-Digest").alias("block_digest"), head("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        F.sha2("block", 256).alias("block_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""

PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "conv_id long, turn long, role string, text string"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(PLANTED, schema))
    out = chat.format_conversations(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("first_wrong").isNull().alias("valid"),
    )


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) + (length(text) - length(replace(text, '\', '')))
    + length(regexp_replace(text, '<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<</TURN>>|\[INST\]|\[/INST\]|<s>|</s>', '\0!', 'g')) - length(text) AS escaped,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 26 + length(role) END AS marks
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(escaped + marks) AS BIGINT) AS formatted_chars,
  bool_and((CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    ELSE before = 'user' AND role = 'assistant' END) AND (k < n OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(docs, path), path)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


TOXIC_FROM = 0.7


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & ~held_out).select("doc_id", F.col("toxic").alias("label"))
    rows = docs.select("doc_id", "text").join(toxicity.sample(labels).hint("broadcast"), "doc_id")
    scores = toxicity.score(docs, toxicity.train(rows))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codebooks.quantize(_table(spark, sf_dir, "embeddings"))
    return codebooks.with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """The rounds of op12 written out, one after another."""
    parts = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS g FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS MATERIALIZED (SELECT vec_id, label, p, g[p * len(g) // 4 + 1 : (p + 1) * len(g) // 4] AS x FROM kept, range(4) r(p))",
        "b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e FROM v) q WHERE e < 256)",
    ]
    for k in range(codebooks.ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, p, x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y), 'e': e}}) AS best
          FROM (SELECT v.*, b.e, b.x AS y FROM v JOIN b{k} b USING (p)) j GROUP BY ALL)""")
        if k < codebooks.ROUNDS:
            parts.append(f"""m{k} AS (SELECT p, e, list(y ORDER BY pos) AS x FROM (SELECT p, best.e AS e, pos, floor(sum(x[pos]) / count(*)) AS y FROM a{k}, range(1, len(x) + 1) i(pos) GROUP BY ALL) s GROUP BY ALL)""")
            parts.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    last = codebooks.ROUNDS
    parts.append(f"c AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id, label)")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256 FROM c"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT kind, id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
counted AS MATERIALIZED (SELECT kind, id, f, count(*) AS n FROM runs GROUP BY ALL),
coded AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(f), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted) d, steps),
rows_ AS MATERIALIZED (SELECT kind, id, bucket, sum(n) AS n FROM counted JOIN coded USING (f) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 'b'), 0) AS t FROM rows_ GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM b) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM b) + 10000 AS DOUBLE)))) AS gain FROM b),
weighed AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM rows_ JOIN g USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('42:' || w.id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN weighed ON weighed.id = w.id WHERE kind = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN r USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_mixing, op4_fingerprints, op5_warc, op6_exact_dedup, op7_chat, op8_bpe, op9_minhash, op10_toxicity, op11_extraction, op12_codes, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op7_chat": OP7_SQL, "op12_codes": _op12_sql(), "op13_resampling": OP13_SQL}
