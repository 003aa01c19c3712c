"""python -m lurelens collect | enrich | train | score | validate"""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators.contexts import union_all
from .operators.evidence import TABLES
from .plans import learn
from .plans.collect import budgeted_permutations, collect, format_counts
from .plans.enrich import enrich
from .sources import readers as R
from .sources import writers as W
from .sources.feeds import read_live_feed
from .sources.generators import command_generator


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lurelens")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *required: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--suffix-list", default="", help="public suffix rules; by default those that come with Spark")
        p.add_argument("--observation-date", default=datetime.now(timezone.utc).date().isoformat())
        return p

    p = add("collect", "brands")
    for kind in ("local", "feed", "permutation"):
        p.add_argument(f"--{kind}", action="append", default=[])
    p.add_argument("--row-cap", type=int, default=Settings.row_cap)
    p.add_argument("--live", action="append", default=[], metavar="ADDRESS[,ADDRESS...][#COLUMN]", help="a feed to download; the first address that can be read counts")
    p.add_argument("--dns", help="Parquet evidence table: hosts that do not resolve are left out")
    p.add_argument("--generator", default="", help="a program that prints the permutations of a domain as JSON")
    p.add_argument("--budget", type=int, default=0, help="rows of permutations after which no more domains are permuted")
    for name in ("enrich", "validate"):
        p = add(name, "input", "brands")
        p.add_argument("--require-match", action="store_true")
        p.add_argument("--match-threshold", type=float, default=Settings.match_threshold)
        for table in TABLES:
            p.add_argument(f"--{table}", help="Parquet evidence table")
    p.add_argument("--standard", required=True)
    p.add_argument("--hardened", required=True)
    p.add_argument("--truth-column", default="")
    p = add("train", "features")
    p.add_argument("--hardened", action="store_true")
    for flag, default in (("trees", 300), ("seed", 42), ("min-positives", 10), ("min-unlabeled", 50), ("cv-folds", 0), ("search", 10)):
        p.add_argument(f"--{flag}", type=int, default=default)
    for flag, default in (("reliable-quantile", 0.30), ("reliable-max-score", 0.30), ("target-recall", 0.95)):
        p.add_argument(f"--{flag}", type=float, default=default)
    p.add_argument("--group-columns", default="")
    p = add("score", "features", "standard", "hardened")
    p.add_argument("--truth-column", default="")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lurelens").getOrCreate()
    s = Settings(observation_date=a.observation_date, suffixes=R.read_suffix_rules(spark, a.suffix_list or None))
    if a.command == "collect":
        s = replace(s, row_cap=a.row_cap)
        sources = []
        for kind in ("local", "feed", "permutation"):
            for path in getattr(a, kind):
                if kind == "local":
                    tables = [R.read_table(spark, p) for p in R.candidate_files(spark, path)]
                    urls = union_all(*(t.select(F.col(f"`{R.candidate_column(t)}`").alias("url")) for t in tables))
                elif kind == "feed":
                    urls = R.read_feed(spark, path)
                else:
                    urls = R.permutations_from(spark.read.text(path, wholetext=True).select(F.lit("").alias("brand"), F.col("value").alias("json"))).select(F.col("host").alias("url"))
                sources.append((kind, path.rsplit("/", 1)[-1], urls.withColumn("ord", F.monotonically_increasing_id())))
        for address in a.live:
            addresses, _, column = address.partition("#")
            urls = read_live_feed(spark, addresses.split(","), column)
            sources.append(("feed", addresses.split("/")[2], urls.withColumn("ord", F.monotonically_increasing_id())))
        brands, dns = R.read_brands(spark, a.brands), spark.read.parquet(a.dns) if a.dns else None
        if a.generator:
            gate = (lambda hosts: dns) if dns is not None else None
            permuted = budgeted_permutations(brands, command_generator(a.generator), s, a.budget, dns=gate)
            print(f"permutations: {format_counts(permuted.counters)}")
            sources.append(("permutation", "permutations", permuted.rows.select("url", "ord")))
        found = collect(sources, brands, s, F.to_date(F.lit(a.observation_date)), dns)
        W.write_csv(found, a.output, found.columns, single=True)
    elif a.command in ("enrich", "validate"):
        s = replace(s, require_match=a.require_match, match_threshold=a.match_threshold)
        given = {k: spark.read.parquet(getattr(a, k)) for k in TABLES if getattr(a, k)}
        contexts, brands = R.read_contexts(spark, a.input), R.read_brands(spark, a.brands)
        if a.command == "validate":
            report = learn.validate(contexts, brands, s, learn.Trained.load(spark, a.standard), learn.Trained.load(spark, a.hardened), given, a.truth_column)
            W.write_json(report, contexts, a.output)
            return
        result = enrich(contexts, brands, s, given)
        for name in ("features", "compact", "failed", "official"):
            W.write_csv(getattr(result, name), f"{a.output}/{name}")
    elif a.command == "train":
        s = replace(s, trees=a.trees, seed=a.seed, min_positives=a.min_positives, min_unlabeled=a.min_unlabeled, reliable_quantile=a.reliable_quantile, reliable_max_score=a.reliable_max_score, target_recall=a.target_recall)
        rows = R.read_features(spark, a.features).withColumn("row_key", F.xxhash64("url", "domain", "source_file", "source_row"))
        groups = [c for c in a.group_columns.split(",") if c]
        trained = learn.train(rows, s, hardened=a.hardened, tries=a.search, cv_folds=a.cv_folds, group_columns=groups)
        trained.save(f"{a.output}/artifact")
        W.write_csv(trained.scored, f"{a.output}/scored")
        if trained.cross_validated is not None:
            W.write_csv(trained.cross_validated, f"{a.output}/cross_validated")
        W.write_csv(spark.createDataFrame(trained.importances(), "feature string, importance double"), f"{a.output}/importances", single=True)
        W.write_json(trained.summary, rows, f"{a.output}/summary")
    else:
        rows = R.read_features(spark, a.features, schema="url string, target_brand_domain string, validation_status string")
        if not rows.limit(1).count():
            classified, long = learn.empty_scores(rows)
        else:
            classified, long = learn.score(rows, learn.Trained.load(spark, a.standard), learn.Trained.load(spark, a.hardened))
        W.write_csv(classified, f"{a.output}/classified")
        W.write_csv(long, f"{a.output}/long")
        W.write_json(learn.evaluate(classified, a.truth_column), rows, f"{a.output}/metrics")


if __name__ == "__main__":
    main()
