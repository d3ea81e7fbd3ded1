"""Command line: gather, ablate, analyse, perplexity."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeprint.functions.text import GROUP_MODES
from codeprint.operators import gathering, learning, metrics, scoring, stats
from codeprint.sources import readers, sinks

#: Kinds of samples whose logs are analysed; a missing log is skipped.
KINDS = ("samples", "normal_samples", "comp_samples")


def analyse(spark: SparkSession, folder: str) -> list[str]:
    """The reports of all ablation logs below ``folder``, a heading before each log's."""
    out = []
    for kind in KINDS:
        for mode in GROUP_MODES:
            try:
                rows = stats.ablation_report(readers.ablation_log(spark, f"{folder}/{kind}_ablation_{mode}")).orderBy("name").collect()  # one row a feature set
            except readers.AnalysisException:
                continue
            out += [f"Results for {kind} - {mode}:", *(r["report"] for r in rows)]
    return out


def perplexity(spark: SparkSession, human: str, machine: list[str], out: str, name: str) -> None:
    """Score, calibrate, classify; one text report for each data set and threshold below ``out``."""
    rows = [readers.load_samples(spark, p).withColumns({"id": F.monotonically_increasing_id(), "dataset": F.lit(p.rstrip("/").rsplit("/", 1)[-1])}) for p in machine]
    for r in rows[1:]:
        rows[0] = rows[0].unionByName(r)
    own = readers.load_samples(spark, human).withColumn("id", F.monotonically_increasing_id())
    scorer = scoring.TrigramScorer(own.select("code").unionByName(rows[0].select("code")), "code")
    sinks.write_report(metrics.text_report(scoring.perplexity_run(own, rows[0], scorer, name)), out)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codeprint")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("gather", help="leaderboards to valid samples")
    one.add_argument("--years", nargs="+", default=["2021", "2024"])
    one.add_argument("--days", nargs="+", type=int, default=list(range(1, 26)))
    one.add_argument("--base-url", required=True)
    one.add_argument("--folder", required=True)
    one.add_argument("--secrets", default=".env")
    one = commands.add_parser("ablate", help="every feature set on every file of samples and group mode")
    one.add_argument("samples", nargs="+")
    one.add_argument("--out", required=True)
    one = commands.add_parser("analyse", help="print the ablation logs")
    one.add_argument("folder")
    one = commands.add_parser("perplexity", help="thresholds from human samples, then reports")
    one.add_argument("human")
    one.add_argument("machine", nargs="+")
    one.add_argument("--out", required=True)
    one.add_argument("--model", default="trigram")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("codeprint").getOrCreate()
    if a.command == "gather":
        gathering.gather(spark, a.years, a.days, a.base_url, a.folder, gathering.listing(readers.secret(a.secrets, "GITHUB_TOKEN")), interval="5")
    elif a.command == "ablate":
        print(learning.run_feature_ablations(spark, a.samples, a.out))
    elif a.command == "analyse":
        print("\n".join(analyse(spark, a.folder)))
    else:
        perplexity(spark, a.human, a.machine, a.out, a.model)


if __name__ == "__main__":
    main()
