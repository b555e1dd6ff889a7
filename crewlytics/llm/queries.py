"""The registered queries of the subpackage, and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlytics.llm import (
    collocations,
    conversation_repair,
    decontamination,
    html_templates,
    pattern_packing,
    preference_chat,
    quality_trees,
    secret_grammar,
    simhash_gray,
    substring_rlz,
    token_files,
    twins,
    url_reputation,
    warc,
)
from crewlytics.sources.scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_templates.extract_text(table(spark, sf_dir, "pages"))


def op2_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 13-word windows that smaller documents have."""
    kept = substring_rlz.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256")
    )


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    path = tokenizer_path("byte_bpe_50k.json")
    return pattern_packing.pack(table(spark, sf_dir, "documents"), path, 2048, 0)


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, four bits."""
    groups = simhash_gray.simhash_groups(table(spark, sf_dir, "documents"), 4, 4)
    return groups.select(
        "doc_id",
        F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a passage like a benchmark item: five-word shingles, similarity 0.8."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, items).drop("key")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = shared_folder(spark, "archives")
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder, payloads=False).where("gap is null")

    return found.select(
        F.expr(r"nullif(regexp_extract(record_id, r'^urn:page:(-?\d+)$', 1), '')").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(r"nullif(regexp_extract(refers_to, r'^urn:page:(-?\d+)$', 1), '')").cast("long").alias("refers_to"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to token files and read back."""
    folder = shared_folder(spark, "tokens")
    path = tokenizer_path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, path, "dropped", 2)
    sums = token_files.checksums(token_files.read_tokens(spark, folder))
    return token_files.read_metadata(spark, folder).join(sums, "seq").drop("seq")


RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls judged by rules and by the reputation of their host.

    A page counts as bad where the label of its id says low quality or toxic.
    """
    labels = table(spark, sf_dir, "labels")
    bad = F.expr("cast(quality = 0 or toxic = 1 as int)")
    outcomes = labels.select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


def op9_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations against the same with their partner's last reply."""
    chosen, rejected = preference_chat.swapped_replies(table(spark, sf_dir, "conversations"))
    pairs = preference_chat.preference_pairs(chosen, rejected)
    spans = "array_join(transform({}, s -> concat(s.start, ':', s.length)), ' ')"
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        "n_prompt_turns",
        "prompt",
        "chosen",
        "rejected",
        F.expr(spans.format("chosen_spans")).alias("chosen_trained"),
        F.expr(spans.format("rejected_spans")).alias("rejected_trained"),
    )


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and trees fitted to the labels."""
    docs = table(spark, sf_dir, "documents")
    trees = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    return quality_trees.judge(docs, trees).drop("score")


def op11_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: by rules, and by the formats of the credentials that the rules label."""
    docs = table(spark, sf_dir, "documents")
    found = secret_grammar.scan(docs, secret_grammar.train(docs))
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secret_grammar.KINDS],
        F.sha2(F.expr(listed.format(base)), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and then repaired by the cheapest edits."""
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(damaged, gone="gone"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of two and three words that belong together most, for each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_html_templates,
        op2_substring_rlz,
        op3_pattern_packing,
        op4_simhash_gray,
        op5_decontamination,
        op6_warc,
        op7_token_files,
        op8_url_reputation,
        op9_preference_chat,
        op10_quality_trees,
        op11_secret_grammar,
        op12_conversation_repair,
        op13_collocations,
    )}


def oracle_sql() -> dict[str, str]:
    return twins.TWINS
