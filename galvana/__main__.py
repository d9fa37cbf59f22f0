"""Command line: ``python -m galvana extract|score|diagnose|report|compare``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from galvana import api
from galvana.operators import diagnose, registry
from galvana.sources import cycler, sinks


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="galvana")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, what in (("extract", "raw CSV to features"), ("score", "features to scores"), ("diagnose", "features to modes"), ("report", "folder of raw CSV to all tables"), ("compare", "features with arms to comparisons")):
        one = verbs.add_parser(verb, help=what)
        one.add_argument("input")
        one.add_argument("output")
        one.add_argument("--rules", help="JSON of a rule table")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("galvana").getOrCreate()
    rules = diagnose.Rules.load(given.rules) if given.rules else diagnose.FULL_CELL
    if given.verb == "report":
        api.diagnose_folder(spark, given.input, given.output, rules)
        return
    if given.verb == "extract":
        sinks.write_table(api.extract_csv(spark, given.input), given.output)
        return
    features = cycler.read_table(spark, given.input)
    if given.verb == "diagnose":
        sinks.write_table(diagnose.diagnose(features, rules), given.output)
    elif given.verb == "score":
        sinks.write_table(api.score_features(features)["scores"], given.output)
    else:
        for name, table in api.compare_arms(features, registry.primary_indicator_columns(features)).items():
            sinks.write_table(table, f"{given.output.rstrip('/')}/{name}.parquet")


if __name__ == "__main__":
    main()
