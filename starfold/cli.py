"""Command line: demo, run, follow, train and report."""

from __future__ import annotations

import argparse
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("starfold").getOrCreate()


def demo(args) -> int:
    from pyspark.sql import functions as F

    from starfold import config
    from starfold.plans import pipeline
    from starfold.sources import files, synthetic

    spark = session()
    lc = synthetic.generate(spark, synthetic.population(args.n, args.seed), args.days, args.minutes)
    rows = pipeline.process(lc.withColumn("f", F.col("flux").cast("double")), lc.select("tic_id", "crowdsap", F.lit(1.0).alias("radius"), F.lit(1.0).alias("mass")).distinct(), config.load(args.config) if args.config else config.Config())
    files.write_catalog(rows, f"{args.out}/catalog", args.format)
    print(pipeline.report(rows))
    truth = rows.join(lc.select("tic_id", "label").distinct(), "tic_id")
    print("accuracy", truth.agg(F.avg((F.col("class") == F.col("label")).cast("int"))).first()[0])
    return 0


def run(args) -> int:
    from starfold import config
    from starfold.operators import catalog, learn
    from starfold.plans import pipeline
    from starfold.sources import files

    spark = session()
    try:
        lc, known = files.curves(spark, args.input)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if args.resume:
        lc = catalog.pending(lc, files.read_manifest(spark, f"{args.resume}/manifest"))
    models = learn.load(args.models) if args.models else None
    rows = pipeline.process(lc, known, config.load(args.config) if args.config else config.Config(), models=models)
    files.write_bundle(rows, None, args.out, args.format)
    return 0


def follow(args) -> int:
    """Takes the files of a folder in batches, and goes on where an earlier run ended."""
    from starfold import config
    from starfold.operators import learn
    from starfold.streaming import arrivals

    spark = session()
    models = learn.load(args.models) if args.models else None
    query = arrivals.follow(spark, args.input, args.out, config.load(args.config) if args.config else config.Config(), models, args.most, not args.forever)
    query.awaitTermination()
    return 0


def train(args) -> int:
    """A model from the curves of labelled stars; labels are a CSV with a header of tic_id and label."""
    from pyspark.sql import functions as F

    from starfold import config
    from starfold.operators import boosting, convnet, learn
    from starfold.plans import pipeline, training
    from starfold.sources import files
    from starfold.sources.tables import saved

    spark = session()
    try:
        lc, known = files.curves(spark, args.input)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    labels = spark.read.option("header", True).csv(args.labels).select(files.tic_number(F.col("tic_id")).alias("tic_id"), "label")
    features, views = pipeline.features_of(lc, known, config.load(args.config) if args.config else config.Config())
    rows, names = saved(training.training_set(features, labels), "training"), list(learn.FEATURES)
    if rows.isEmpty():
        print("no star has a known label", file=sys.stderr)
        return 2
    models = {"ml": boosting.fit(rows, names, rounds=args.rounds) if args.learner == "boosting" else learn.trained(rows, names)}
    if args.steps:
        models["cnn"] = convnet.fit(training.training_set(views, labels), training.BINS, steps=args.steps, filters=args.filters)
    learn.save(models, args.out)
    return 0


def report(args) -> int:
    from starfold.plans import pipeline
    from starfold.sources import files

    print(pipeline.report(files.read_catalog(session(), args.catalog, args.format)))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="starfold")
    sub = p.add_subparsers(dest="command", required=True)
    for name, fn in (("demo", demo), ("run", run), ("follow", follow), ("train", train), ("report", report)):
        s = sub.add_parser(name)
        s.set_defaults(fn=fn)
        s.add_argument("--format", default="parquet", choices=("csv", "json", "parquet"))
        if name != "report":
            s.add_argument("--out", required=True)
            s.add_argument("--config")
        if name == "demo":
            s.add_argument("--n", type=int, default=16)
            s.add_argument("--seed", type=int, default=0)
            s.add_argument("--days", type=float, default=16.0)
            s.add_argument("--minutes", type=float, default=8.0)
        if name in ("run", "follow", "train"):
            s.add_argument("--input", required=True)
        if name in ("run", "follow"):
            s.add_argument("--models")
        if name == "run":
            s.add_argument("--resume")
        if name == "follow":
            s.add_argument("--most", type=int, default=10_000)
            s.add_argument("--forever", action="store_true")
        if name == "train":
            s.add_argument("--labels", required=True)
            s.add_argument("--learner", default="boosting", choices=("boosting", "forest"))
            s.add_argument("--rounds", type=int, default=400)
            s.add_argument("--steps", type=int, default=0, help="steps of a network on the views besides; none by default")
            s.add_argument("--filters", type=int, default=16)
        if name == "report":
            s.add_argument("--catalog", required=True)
    args = p.parse_args(argv)
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
