"""One registered query per operator of this subpackage, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import chat, oracles
from sheaf.llm.common import table
from sheaf.llm.decontaminate import contamination
from sheaf.llm.language import identify
from sheaf.llm.language import learn as learn_languages
from sheaf.llm.lexical_tree import ranked_search
from sheaf.llm.near_dedup import near_duplicates
from sheaf.llm.packing import bucketed, pack
from sheaf.llm.prefix_trie import coded, prefix_trie, rebuilt
from sheaf.llm.quality_model import learn as learn_quality
from sheaf.llm.quality_model import score_quality
from sheaf.llm.quality_rules import quality_rules
from sheaf.llm.sharding import shards
from sheaf.llm.suffix_dedup import repeated_bytes
from sheaf.llm.url_filter import SITE_RANK, url_verdicts
from sheaf.llm.warc import read_records, write_warc
from sheaf.session import prepare

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


@query("op5_chat_prefix_targets", oracles.CHAT)
def op5(spark, sf_dir) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"), spark)
    return chat.read_back(chat.format_conversations(turns))


@query("op6_pack_powers_of_two")
def op6(spark, sf_dir) -> DataFrame:
    return bucketed(pack(table(spark, sf_dir, "documents"), with_ids=False))


@query("op7_feistel_shards")
def op7(spark, sf_dir) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


@query("op9_compression_bands")
def op9(spark, sf_dir) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op10_url_token_rules", oracles.URLS)
def op10(spark, sf_dir) -> DataFrame:
    judged = url_verdicts(table(spark, sf_dir, "pages"))
    site = F.when(F.col("rank") == SITE_RANK, F.col("rule"))
    return judged.select("page_id", "host", "path", site.alias("rule"), "verdict", F.col("rule").alias("matched_rule"))


@query("op4_prefix_filtered_windows", oracles.DECONTAMINATION)
def op4(spark, sf_dir) -> DataFrame:
    judged = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op8_piece_lattice_language")
def op8(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_languages(docs))


@query("op1_byte_convolutions")
def op1(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))


@query("op2_odd_sketch_near_dedup", oracles.NEAR_DEDUP)
def op2(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_suffix_array_repeats", oracles.SUFFIX_ARRAY)
def op3(spark, sf_dir) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


@query("op11_indexed_warc", oracles.WARC)
def op11(spark, sf_dir) -> DataFrame:
    index, folder = write_warc(table(spark, sf_dir, "pages"))
    read = read_records(index, folder, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_document_tree_search", oracles.RANKED)
def op12(spark, sf_dir) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_ternary_prefix_trie", oracles.PREFIX_TRIE)
def op13(spark, sf_dir) -> DataFrame:
    return prefix_trie(rebuilt(coded(table(spark, sf_dir, "conversations"))))
