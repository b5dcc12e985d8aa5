"""Run all layers, or one: ``python -m hearlog {all,landing,plays,marts,models} ROOT [--source PATH] ...``."""

import argparse

from pyspark.sql import SparkSession

from hearlog.params import Params
from hearlog.plans import layers
from hearlog.session import prepare_session
from hearlog.sources import tables


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hearlog", description=__doc__)
    parser.add_argument("layer", choices=["all", "landing", "plays", "marts", "models"])
    parser.add_argument("root", help="folder of the layers' tables")
    parser.add_argument("--source", help="folder of the export files, for all and landing")
    parser.add_argument("--listener-pattern", help="regular expression; its first group in a file's path names the listener")
    parser.add_argument("--listener-key", action="append", default=[], help="column that tells listeners apart")
    parser.add_argument("--published", action="store_true", help="write tables under their published names")
    given = parser.parse_args(arguments)
    if given.layer in ("all", "landing") and not given.source:
        parser.error(f"{given.layer} needs --source")

    spark = prepare_session(spark or SparkSession.builder.appName("hearlog").getOrCreate())
    params = Params(listener_keys=tuple(given.listener_key))
    if given.layer == "all":
        layers.run_all(spark, given.source, given.root, params, given.listener_pattern, published=given.published)
    elif given.layer == "landing":
        layers.land(spark, given.source, f"{given.root}/landing")
    elif given.layer == "plays":
        files = tables.read_table(spark, f"{given.root}/landing/files")
        records = tables.read_table_if_present(spark, f"{given.root}/landing/records")
        layers.build_plays(files, f"{given.root}/plays", params, given.listener_pattern, given.published, records)
    else:
        fact = tables.read_table(spark, f"{given.root}/plays/{layers.FACT}")
        write = layers.write_marts if given.layer == "marts" else layers.write_models
        write(fact, f"{given.root}/{given.layer}", params, published=given.published)


if __name__ == "__main__":
    main()
