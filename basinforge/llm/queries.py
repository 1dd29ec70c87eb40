"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinforge.llm import compression_rules, interpolation_lm, line_winnow, merkle, oracle, packing, pii_crf, piece_bpe, prefix_hashes, progressive_jpeg, simhash, token_alignment, warc_revisit, zdict_quality

#: Where the public vocabulary files are; None asks the module ``public_tokenizers``.
TOKENIZER_DIR: str | None = None


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file that every machine has."""
    if folder := folder or TOKENIZER_DIR:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation_lm.score(table(spark, sf_dir, "documents"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    outputs = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    return pii_crf.find_documents(docs, pii_crf.fit(docs), outputs)


def op4_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_winnow.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=50)
    return found.select("doc_id", "n_deleted_lines", "n_deleted_words", F.sha2("text", 256).alias("kept_sha256"))


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = packing.PackingSpec(vocabulary("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), spec, with_ids=False)


def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return zdict_quality.score(docs, zdict_quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), outputs)


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.describe_documents(table(spark, sf_dir, "documents"))


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_rules.apply_rules(docs, compression_rules.fit(docs, table(spark, sf_dir, "labels")))


def capture_log(pages: DataFrame) -> DataFrame:
    """WARC records made of ``pages``: each page gives a response and two later revisits.

    The revisits spell the URL otherwise; one names an entity tag and one a date, and
    some of both are stale.
    """
    page, url = F.col("page_id"), F.col("url")
    start = F.lit(1_700_000_000) + F.pmod(page * 7919, F.lit(100_003)) * 60
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    modified = (start - F.pmod(page, F.lit(977)) * 3600).cast("string")
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    stale = F.pmod(page, F.lit(5)) == 0
    full = F.array(
        field("Content-Type", F.lit("text/html")), field("ETag", tag), field("Last-Modified", modified), field("Date", start.cast("string")), field("Server", F.concat(F.lit("s"), F.pmod(page, F.lit(9)).cast("string")))
    )
    by_tag = F.array(field("etag", F.when(stale, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))), field("Date", (start + 3600).cast("string")), field("Server", F.lit("cache")))
    by_date = F.array(field("last-modified", modified), field("Expires", (start + 90000).cast("string")))
    body = F.col("html").cast("binary")
    record = lambda n, u, t, kind, h, sha, size: F.struct(
        (page * 3 + n).alias("record_id"), u.alias("url"), t.cast("long").alias("captured"), F.lit(kind).alias("kind"), h.alias("headers"), sha.alias("payload_sha256"), size.cast("long").alias("payload_bytes")
    )
    none = F.lit(None).cast("string")
    return pages.select(
        F.explode(
            F.array(
                record(0, url, start, "response", full, F.sha2(body, 256), F.length(body)),
                record(1, F.concat(F.regexp_replace(url, "^https?://", "http://"), F.lit("#again")), start + 3600, "revisit", by_tag, none, F.lit(None)),
                record(2, F.regexp_replace(url, "^https?://", "HTTPS://www."), start + 86400 * F.pmod(page, F.lit(40)), "revisit", by_date, none, F.lit(None)),
            )
        ).alias("r")
    ).select("r.*")


def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    line = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";")
    return found.withColumn("headers", line)


def op11_merkle_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("subroot", "root", "proof_sha256", "folded_root", "verified")
    return merkle.authenticate(table(spark, sf_dir, "documents"), outputs=outputs, changed=merkle.lowered)


def op12_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hashes.fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), outputs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_line_winnowing": op4_line_winnowing,
    "op5_cost_balanced_packing": op5_cost_balanced_packing,
    "op6_compression_classifier": op6_compression_classifier,
    "op7_piece_bpe": op7_piece_bpe,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op9_compression_bands": op9_compression_bands,
    "op10_revisit_resolution": op10_revisit_resolution,
    "op11_merkle_traversal": op11_merkle_traversal,
    "op12_prefix_hashes": op12_prefix_hashes,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_winnowing": oracle.LINE_WINNOWING,
    "op10_revisit_resolution": oracle.REVISIT_RESOLUTION,
    "op11_merkle_traversal": oracle.MERKLE_TRAVERSAL,
}
