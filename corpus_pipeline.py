"""Corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes all that its predecessor kept; its result is written as
Parquet to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.llm import decontaminate, jaccard_join, quality_rank, secret_scan, sentencepiece_sa
from sparkreel.llm.queries import training_labels
from sparkreel.llm.shared import staged


def carried(docs: DataFrame) -> DataFrame:
    """``doc``, a whole row, and its ``text``: whatever the columns are called, none clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted ranking scores at the cut or above."""
    ranking = quality_rank.fit(docs, training_labels(spark, sf_dir))
    scored = quality_rank.score(carried(docs), ranking, keep=("doc",))
    return scored.filter(F.col("score") >= quality_rank.CUT_SCORE).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group that Jaccard links of 0.8 over five-word shingles make. Empty texts stay.

    Rows are told apart by id and text: one that shares its id with a copy but has a text of its own stays. Of texts of
    one group that share the least id, the one of least hash stays.
    """
    found = staged(jaccard_join.groups(docs, jaccard_join.Rule(k=5, num=80), hashed=True), "groups")
    others = found.filter("component_id <> doc_id or (doc_id is null and component_id is not null)").select("doc_id", "h1")
    repeated = not found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty()
    if repeated:
        heads = found.filter("component_id = doc_id and n_shingles > 0")
        first = heads.groupBy("doc_id").agg(F.min("h1").alias("first"))
        others = others.unionByName(heads.join(first, "doc_id").filter("h1 <> first").select("doc_id", "h1"))
    others = others.distinct().select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"))
    small = others.count() <= jaccard_join.BROADCAST_IDS
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h1"))
    kept = docs.join(F.broadcast(others) if small else others, same, "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    found = decontaminate.leaks(carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaks") == 0).select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mask; ``n_chars`` follows the text."""
    masked = secret_scan.scan_secrets(carried(docs), keep=("doc",), mask="[secret]")
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return masked.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids, with whether the ids decode to the text. Columns of these names in ``docs`` give way."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_sa.encode(carried(docs), path, keep=("doc", "text"), decoded=True)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_sa.SPACE), F.lit(" "))
    new = {"n_ids": F.size("ids"), "ids": F.col("ids"), "round_trip": same}
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "text" and c not in new], *[v.alias(c) for c, v in new.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: A trained ranking and token ids are not SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
