"""Command line: python -m siftwell.cli --task ranking --data_path ... --data_source csv-raw ..."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.transforms import load
from siftwell.operators import enrich, pairs, profile, row_quality, summary, synth, visual
from siftwell.operators.heuristics import scores
from siftwell.plans.frame import categorical
from siftwell.sources import readers, sinks

TASKS = ("all", "ranking", "ranking_summary", "visualization", "feature_summary_transformers", "identify_rare_values", "data_generator", "instance_ranking", "selftest")


def flag(text: str) -> bool:
    return str(text).lower() == "true"


def arguments(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Feature screening on Spark")
    add = p.add_argument
    add("--task", choices=TASKS, default="all")
    add("--minibatch_size", type=int, default=2**14)
    add("--output_folder", default="ranking_outputs")
    add("--data_source", default="ob-vw")
    add("--data_path")
    add("--subsampling", type=int, default=10)
    add("--combination_number_upper_bound", type=int, default=2**15)
    add("--missing_value_symbols", default=",{}")
    add("--heuristic", default="MI-numba-randomized")
    add("--include_noise_baseline_features", type=flag, default=False)
    add("--include_cardinality_in_feature_names", type=flag, default=True)
    add("--image_format", default="pdf")
    add("--num_threads", type=int, default=8)
    add("--label_column", default="label")
    add("--max_unique_hist_constraint", type=int, default=30_000)
    add("--transformers", default="none")
    add("--rare_value_count_upper_bound", type=int, default=1)
    add("--feature_set_focus")
    add("--interaction_order", type=int, default=1)
    add("--reference_model_JSON", default="")
    add("--target_ranking_only", type=flag, default=True)
    add("--explode_multivalue_features", default="False")
    add("--subfeature_mapping", default="False")
    add("--num_synthetic_features", type=int, default=100)
    add("--tldr", type=flag, default=True)
    add("--num_synthetic_rows", type=int, default=1_000_000)
    add("--generator_type", choices=["naive"], default="naive")
    add("--output_synthetic_df_name", default="test_data_synthetic")
    add("--disable_tqdm", type=flag, default=False)
    add("--mi_stratified_sampling_ratio", type=float, default=1.0)
    return p.parse_args(argv)


@dataclass
class Prepared:
    rows: DataFrame
    features: list[str]
    numeric: set[str]


def _pivoted(base: DataFrame, long: DataFrame) -> tuple[DataFrame, list[str]]:
    """Derived rows (batch, idx, feature, value) as columns beside the base."""
    names = sorted(r[0] for r in long.select("feature").distinct().collect())
    if not names:
        return base, []
    wide = long.groupBy("batch", "idx").pivot("feature", names).agg(F.first("value"))
    return base.join(wide, ["batch", "idx"], "left").fillna("", names), names


def prepare(spark: SparkSession, a: argparse.Namespace, data: readers.Dataset | None = None) -> Prepared:
    """Reads, indexes, samples, batches and enriches, in the order focus, transforms, multivalue,
    sub-features, crosses, controls."""
    data = data or readers.read(spark, a.data_source, a.data_path)
    rows, label = data.rows, a.label_column
    features = list(rows.columns)
    if a.feature_set_focus:
        wanted = readers.reference_features(spark, a.reference_model_JSON) if a.feature_set_focus == "_all_from_reference_JSON" else set(a.feature_set_focus.split(","))
        features = sorted((wanted & set(features)) | {label})
    rows = rows.select(*(f"`{f}`" for f in features)).withColumn("__order", F.monotonically_increasing_id())
    base = categorical(rows, features, ["__order"], a.minibatch_size, a.subsampling)
    numeric = [f for f in features if f in data.numeric and f != label]
    if a.transformers != "none" and numeric:
        base, new = _pivoted(base, enrich.enrich_with_transforms(base, numeric, load(a.transformers)))
        features += new
    if a.explode_multivalue_features != "False":
        base, new = _pivoted(base, enrich.multivalue(base, a.explode_multivalue_features.split(";"), a.missing_value_symbols.split(",")))
        features += new
    if a.subfeature_mapping != "False":
        base, new = _pivoted(base, enrich.subfeatures(base, a.subfeature_mapping))
        features += new
    chosen = None
    if a.reference_model_JSON:
        chosen = [tuple(f.split(",")) for f in sorted(readers.reference_features(spark, a.reference_model_JSON, combined_only=True))]
    plain = list(features)
    if a.interaction_order > 1 or chosen:
        base, new = enrich.with_crosses(base, plain, a.interaction_order, label, sampler=pairs.PairSampler(a.combination_number_upper_bound), chosen=chosen)
        features += new
    if "3mr" in a.heuristic:
        base, new = enrich.with_crosses(base, plain, 2, label, relation=True, sampler=pairs.PairSampler(a.combination_number_upper_bound))
        features += new
    if a.include_noise_baseline_features:
        base, new = enrich.with_controls(base, label)
        features += new
    return Prepared(base, features, data.numeric)


def ranking(spark: SparkSession, a: argparse.Namespace, data: readers.Dataset | None = None) -> DataFrame:
    began = time.time()
    p = prepare(spark, a, data)
    label = a.label_column
    if "3mr" in a.heuristic:
        found = pairs.relation_pairs(p.features, label)
    else:
        found = pairs.label_pairs(p.features, label) if a.target_ranking_only else pairs.all_pairs(p.features, label)
    if "prior" in a.heuristic and a.reference_model_JSON:
        found = pairs.outside_model(found, readers.reference_features(spark, a.reference_model_JSON))
    sampler = pairs.PairSampler(a.combination_number_upper_bound)
    found = sampler.take(list(dict.fromkeys(found)))
    triplets = scores(p.rows, found, a.heuristic, a.mi_stratified_sampling_ratio)
    triplets = pairs.median_scores(triplets if a.heuristic == "Constant" else pairs.both_ways(triplets))
    cover = profile.coverage(p.rows, p.features, a.missing_value_symbols.split(","))
    size = profile.cardinality(p.rows, p.features)
    if "3mr" in a.heuristic:
        order = summary.three_mr_ranking(summary.three_mr_parts(triplets, label))
        sinks.write_tsv(spark.createDataFrame([(f, i + 1) for i, f in enumerate(order)], "Feature string, `3MR_Ranking` int"), f"{a.output_folder}/3mr_ranks.tsv")
    if a.include_cardinality_in_feature_names:
        triplets = summary.decorated(triplets, size, cover)
    sinks.write_ranks(triplets, a.output_folder)
    sinks.write_tsv(profile.memory_size(p.rows, p.features), f"{a.output_folder}/memory.tsv")
    counts = profile.bounded_counts(p.rows, p.features, a.max_unique_hist_constraint)
    sinks.write_json(spark, profile.repetitions_json(profile.value_repetitions(counts)), f"{a.output_folder}/value_repetitions.json")
    sinks.write_json(spark, sampler.to_json(), f"{a.output_folder}/combination_estimation_counts.json")
    sinks.write_json(spark, vars(a), f"{a.output_folder}/arguments.json")
    sinks.write_json(spark, {"ranking_s": time.time() - began}, f"{a.output_folder}/timings.json")
    return triplets


def ranking_summary(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    ranks = readers.read_ranks(spark, f"{a.output_folder}/pairwise_ranks.tsv")
    single = summary.singles(ranks, a.label_column, "MI" in a.heuristic)
    sinks.write_singles(single, a.heuristic, a.output_folder, summary.singles_aggregated(single) if a.interaction_order > 1 else None, summary.transformers_only(single))
    if a.tldr:
        single.orderBy(F.desc("Score")).show(20, False)
    return single


def visualization(spark: SparkSession, a: argparse.Namespace) -> None:
    ranks = readers.read_ranks(spark, f"{a.output_folder}/pairwise_ranks.tsv")
    sinks.write_tsv(visual.heatmap(ranks), f"{a.output_folder}/heatmap.tsv")
    sinks.write_tsv(visual.top_features(ranks, a.label_column), f"{a.output_folder}/barplot.tsv")
    if not a.target_ranking_only:
        shape, best = visual.clustered(ranks)
        sinks.write_tsv(shape, f"{a.output_folder}/silhouette.tsv")
        sinks.write_tsv(best, f"{a.output_folder}/TopClustering.tsv")


def main(argv=None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("siftwell").getOrCreate()
    if a.task in ("all", "ranking"):
        ranking(spark, a)
    if a.task in ("all", "ranking_summary"):
        ranking_summary(spark, a)
    if a.task in ("all", "visualization"):
        visualization(spark, a)
    if a.task == "feature_summary_transformers":
        p = prepare(spark, a)
        stats = profile.numeric_summary(profile.numeric_bounds(p.rows, [f for f in p.features if f in p.numeric]))
        sinks.write_tsv(stats, f"{a.output_folder}/numeric_feature_statistics.tsv")
        profile.transformer_grid(stats).selectExpr("to_json(struct(*)) AS spec").show(1000, False)
    if a.task == "identify_rare_values":
        p = prepare(spark, a)
        rare = profile.rare_values(p.rows, p.features, a.rare_value_count_upper_bound)
        sinks.write_profile({"rare_values": rare, "feature_sparsity_summary": profile.sparsity(rare, profile.cardinality(p.rows, p.features), sorted(p.numeric)).orderBy("rare_percent")}, a.output_folder)
    if a.task == "instance_ranking":
        data = readers.read(spark, a.data_source, a.data_path)
        rows = row_quality.row_scores(data.rows.withColumn("group", F.substring(F.col(f"`{data.columns[0]}`"), 1, 1)), data.columns, ["group"])
        sinks.write_tsv(rows, f"{a.output_folder}/row_quality.tsv")
    if a.task == "data_generator":
        sinks.write_data(synth.naive(spark, a.num_synthetic_rows, a.num_synthetic_features).drop("idx"), f"{a.output_synthetic_df_name}/data.csv")
    if a.task == "selftest":
        a.target_ranking_only, a.include_cardinality_in_feature_names = True, False
        df = synth.naive(spark, 100_000, 100).drop("idx")
        out = ranking(spark, a, readers.Dataset(df, df.columns))
        if out.count() != 201:
            raise AssertionError("the self-test has found other pairs than it should")


if __name__ == "__main__":
    main()
