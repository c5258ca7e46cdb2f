"""One query per operator, with production parameters, over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from . import alignment, chat, language, minhash, multiset, negatives, pieces, pii, retrieval, simhash, substrings, tokenfile, toxicity
from .catalog import query
from .common import fold, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_simhash")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), width=3, radius=2)


@query("op9_token_files")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{work_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokenfile.write_ids(table(spark, sf, "documents"), folder, tokenizer("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_ids(spark, folder)


@query("op4_chat", chat.ORACLE)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", chat.TRICKY), (-7, 1, "assistant", chat.TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.union(more)))


@query("op7_multiset_hash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return multiset.compared(table(spark, sf, "documents"))


@query("op10_surrogates")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pii.replaced(table(spark, sf, "documents").select("doc_id", "text"), count="n_found")


@query("op2_language")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = fold("doc_id", 4) == 2
    model = language.profiles(docs.filter(~held).select("lang", "text"))
    return language.identified(docs, model, {"doc_id": F.col("doc_id"), "held_out": held})


@query("op6_toxicity")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = table(spark, sf, "documents"), fold("doc_id", 3) == 1
    labels = table(spark, sf, "labels").filter(fold("doc_id", 3) != 1).select("doc_id", "toxic")
    model = toxicity.train(toxicity.labelled(docs.filter(~held), labels))
    out = toxicity.scored(docs, model, {"doc_id": F.col("doc_id"), "held_out": held})
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op3_pieces")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    back = pieces.decoded(pieces.encoded(table(spark, sf, "documents"), model, ["doc_id", "text"]), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


@query("op5_substrings")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf, "documents")).drop("kept")


@query("op1_retrieval")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.searched(table(spark, sf, "documents"), table(spark, sf, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


@query("op13_minhash", minhash.ORACLE)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), width=4, similarity=0.8)


@query("op11_alignment")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.compared(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query("op12_negatives", negatives.ORACLE)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf, "embeddings"), "vec_id", "embedding", label, scale=256, every=50, positives=5, negatives=3, low=50, high=95)
