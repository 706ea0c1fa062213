"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bestfit, bpe, chat, huffman, merkle, packing, pages, passages, pii, quality, simhash, sql, winnow
from .common import new_dir, stored
from .tokens import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.line_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"), with_text=False).drop("redacted")


def op5_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(_table(spark, sf_dir, "documents"), words=50, similarity=0.8)


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_dir(spark, "tokens")
    huffman.write_tokens(_table(spark, sf_dir, "documents"), out, vocabulary_path(), end_id=2)
    return huffman.read_tokens(spark, out, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path(), width=1024, end_id=0, with_ids=False).drop("ids")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    kinds = dict(turns.dtypes)
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    read = chat.read_chat(stored(chat.format_chat(turns.unionByName(extra)), "chat"))
    per_turn = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    loss = F.array_join("trained", "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return read.select("conv_id", F.size("roles").cast("long").alias("n_turns"), digest(F.array_join(per_turn, "")).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), "formatted_chars")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader presents texts without line ends where the id's checksum is even."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify(merkle.build_manifest(_table(spark, sf_dir, "documents"), presented={"text": shown}), spark)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"), with_groups=False)
    return found.drop("groups")


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), width=4096, end_id=1, with_ids=False).drop("ids")


_QUERIES = (
    op1_simhash, op2_bpe, op3_quality, op4_pii, op5_winnow, op6_passages, op7_pages, op8_huffman, op9_packing, op10_chat, op11_merkle, op12_alignment, op13_bestfit
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
