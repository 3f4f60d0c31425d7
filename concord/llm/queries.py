"""The registered queries of the corpus operators: thin functions over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import ann, chat, decontam, fim, html, lexical, lm, neardup, packing, quality, secrets, sharding, tokenids
from concord.llm.common import shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every whole text of ``documents``, as spans and digests."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("findings", lambda x: x["kind"] != "lexed")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), n("lexed").alias("n_lexed"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as read back from the coded files; 49,408 ids in the vocabulary, end id 1."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenids.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, by_word=True, vocabulary=49_408)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``: four-word shingles, four differing bits."""
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, radius=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document; ``source`` is the host."""
    measured = written(quality.measure(table(spark, sf_dir, "documents")).drop("text"), "measured")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
    return quality.with_verdicts(measured).select(*names)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its bin of 2,048 words."""
    return packing.packed(table(spark, sf_dir, "documents"), capacity=2048, per_source=2)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written in shards 0 to 39 of one shuffled sequence and read back; row counts at most one apart."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, path, n_shards=40)
    rows = sharding.read_shards(docs, path)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and the benchmark item whose template windows it holds."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "n_changed")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted string."""
    said = "</s>[INST] ok [/INST]"
    known = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))))
    out = chat.formatted(known.unionByName(extra)).withColumn("turns", chat.turns(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every whole document."""
    return lm.scores(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th row of ``embeddings`` among all other rows."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document rearranged for filling in its middle; digests of the output and of the text rebuilt from it."""
    out = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rebuilt = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def queries() -> dict:
    found = (op1_secret_scan, op2_best_fit_packing, op3_sharding, op4_token_ids, op5_simhash, op6_quality_rules, op7_decontamination, op8_chat_format, op9_html_extraction, op10_lm_scoring, op11_nearest_neighbours, op12_lexical_search, op13_fill_in_middle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.SQL, "op8_chat_format": chat.SQL, "op11_nearest_neighbours": ann.SQL, "op12_lexical_search": lexical.SQL, "op13_fill_in_middle": fim.SQL}
