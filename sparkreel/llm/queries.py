"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, jaccard_join, metric_dedup, quality_rank, secret_scan, sentencepiece_sa, substring_dedup, suffix_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """Whether a document's labels are kept from training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the passages of 50 words or more that near-duplicate an earlier document's, and those documents."""
    out = substring_dedup.passages(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", F.size("spans").cast("bigint").alias("n_spans"), substring_dedup.covered(F.col("spans")).alias("n_repeated"),
        F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["source"]))).alias("sources"), "spans",
    )


def op2_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranking = quality_rank.fit(docs, training_labels(spark, sf_dir))
    scored = quality_rank.score(docs, ranking)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_rank.CUT_SCORE).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(_table(spark, sf_dir, "documents"), jaccard_join.Rule(k=3, num=90))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l1 AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
l AS (SELECT a, b FROM l1 UNION ALL SELECT b, a FROM l1),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a)
SELECT id AS doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a)
SELECT id AS vec_id, any_value(coalesce(n, 0)) AS n_links, min(c) AS component_id, id = min(c) AS kept FROM r LEFT JOIN k ON k.a = id GROUP BY id
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the benchmark items that it leaks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("bigint").alias("n_items"), F.transform("leaks", lambda x: x["item_id"]).alias("items"), "leaks")


#: A conversation that holds the strings a template must escape.
HARD_CASE = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_CASE).alias("text"))
    out = chat_format.rendered(chat_format.rebuilt(chat_format.as_events(turns.unionByName(hard))))
    read = out.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("loss_text"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text)
    + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, '\', '')))
    + (length(text) - length(replace(text, '<', ''))) + (length(text) - length(replace(text, '\', ''))) + 20 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = sentencepiece_sa.encode(docs, _vocabulary("piece_bpe_32k.model"), keep=("doc_id", "text"), decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.replace("text", F.lit(sentencepiece_sa.SPACE), F.lit(" "))).alias("round_trip"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


TOKEN_LIMIT = 1024


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = token_counts.prefix_token_counts(docs.withColumn("n_bytes", F.octet_length("text").cast("bigint")), _vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep=("doc_id", "n_bytes"))
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rank": op2_quality_rank,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat_format": op6_chat_format,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {"op3_jaccard_join": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op6_chat_format": OP6_SQL}
