"""Queries of the training-data problems (4 to 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import addresses, leakage, names, packing, reading, split_overlap
from ledgerloom.session import read_table, store


def _same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(split_overlap.same_rows(read_table(spark, sf_dir, "manifest"), read_table(spark, sf_dir, "canonical_records")), "same-rows")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlapping_pairs(_same(spark, sf_dir))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(_same(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every manifest row with its class of sameness."""
    return split_overlap.same_rows(read_table(spark, sf_dir, "manifest"), read_table(spark, sf_dir, "canonical_records")).select("manifest_id", "split", F.col("component").alias("class_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.group_pairs(addresses.address_groups(read_table(spark, sf_dir, "parties")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.address_groups(read_table(spark, sf_dir, "parties"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices, parties = read_table(spark, sf_dir, "invoices"), read_table(spark, sf_dir, "parties")
    return names.name_clusters([invoices.select("supplier_name"), invoices.select("buyer_name"), parties.select("legal_name"), parties.select("trading_name")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(_names(spark, sf_dir))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(store(p7_packed(spark, sf_dir), "packed"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id", "n_words", F.round("matched", 4).alias("matched"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "reading_labels"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return reading.level_profile(store(p9_levels(spark, sf_dir), "levels"), documents)


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_classes": p4_classes, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_clusters": p6_clusters, "p7_packed": p7_packed, "p7_report": p7_report, "p8_found": p8_found, "p8_passages": p8_passages, "p9_levels": p9_levels, "p9_profile": p9_profile}
SQL: dict[str, str] = {}
