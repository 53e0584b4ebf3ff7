"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import anchors, bwt, forest, kdtree, kmeans, langid, licenses, lines, lmscore, merkle, minhash, mixing, packing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.forest_search(_table(spark, sf_dir, "embeddings"))


def op2_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(_table(spark, sf_dir, "documents"))


def op4_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.kd_shards(_table(spark, sf_dir, "documents"), shards=24)


def op6_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op12_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.remove_repeats(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_forest,
        op2_bwt_repeats,
        op3_line_quality,
        op4_minmax_near_duplicates,
        op5_kd_shards,
        op6_nearest_centroid_language,
        op7_pattern_packing,
        op8_pivotal_mixing,
        op9_license_scan,
        op10_cross_entropy_difference,
        op11_heap_bounds,
        op12_block_anchors,
        op13_merkle_manifest,
    )
}
