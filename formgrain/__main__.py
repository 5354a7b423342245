"""Command line: ``run`` the pipeline on the first forms of a dataset, or write a ``sample`` record or a ``dataset`` of answer keys."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from formgrain.plans import assemble
from formgrain.sources import generator
from formgrain.sources.dataset import Settings


def parser(settings: Settings) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="formgrain", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run the configured steps and print the summary")
    run.add_argument("--run-id", required=True, help="name of the run, and of its folder")
    run.add_argument("--dev", type=int, default=settings.dev_count, help="how many dev forms, from the first")
    run.add_argument("--test", type=int, default=settings.test_count, help="how many test forms, from the first")
    run.add_argument("--workers", type=int, default=settings.workers, help="forms that are with a model at the same time")
    run.add_argument("--reuse", action="store_true", help="do only what isn't there yet")
    sample = commands.add_parser("sample", help="write one answer key")
    sample.add_argument("--seed", type=int, default=1)
    sample.add_argument("--out", default="sample")
    keys = commands.add_parser("dataset", help="write the answer keys of a dataset as JSON lines")
    keys.add_argument("--count", type=int, default=500)
    keys.add_argument("--dev", type=int, default=100)
    keys.add_argument("--seed", type=int, default=1)
    keys.add_argument("--out", required=True)
    return out


def main(args: Sequence[str] | None = None, settings: Settings | None = None) -> int:
    settings = settings or Settings.load(dotenv=".env")
    asked = parser(settings).parse_args(args)
    if asked.command == "sample":
        os.makedirs(asked.out, exist_ok=True)
        path = os.path.join(asked.out, f"{asked.seed:06d}.json")
        with open(path, "w", encoding="utf-8") as f:
            f.write(generator.truth_text(asked.seed))
        print(f"wrote {path}")
        return 0
    spark = SparkSession.builder.appName("formgrain").getOrCreate()
    if asked.command == "dataset":
        rows = generator.dataset(spark, asked.count, asked.dev, asked.seed)
        rows.select("id", "split", "seed", "truth", "truth_sha256").write.mode("overwrite").json(asked.out)
        print(f"wrote {asked.count} answer keys to {asked.out}")
        return 0
    settings = Settings(**{**settings.__dict__, "workers": asked.workers})
    summary = assemble.run(spark, settings, asked.run_id, asked.dev, asked.test, asked.reuse, " ".join(args if args is not None else sys.argv[1:]))
    print(json.dumps(summary, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
