"""Command lines: `slipweave run`, `slipweave dataset` and `slipweave check`."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .conf import load
from .operators import recognize
from .plans import dataset, pipeline
from .plans.shared import exists, new_path, remove
from .sources import files, sinks

# Options and defaults that callers rely on.
_COMMANDS = {
    "run": {
        "--input": {"required": True}, "--output": {"required": True}, "--overwrite": {"action": "store_true"},
        "--max-batch": {"type": int}, "-v --verbose": {"action": "store_true"},
    },
    "dataset": {"--output": {"default": "data/output"}, "--dest": {"default": "data/ocr_dataset.jsonl"}},
    "check": {},
}
_TEXT = "slipweave.operators.recognize:TextRecognizer", "slipweave.operators.recognize:TextPreprocessor"
_PIXELS = "slipweave.operators.pixels:PixelPreprocessor"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="slipweave")
    sub = top.add_subparsers(dest="command", required=True)
    for name, options in _COMMANDS.items():
        command = sub.add_parser(name)
        for flags, how in options.items():
            command.add_argument(*flags.split(), **how)
        if name != "dataset":
            command.add_argument("--recognizer", default=_TEXT[0], help="module:factory of the model; the default reads text files")
            command.add_argument("--preprocessor", help=f"module:factory; by default text with the default model, else {_PIXELS}")
            command.add_argument("--env-prefix", default="SLIPWEAVE_", help="prefix of the settings in the environment and in .env")
    sub.choices["run"].add_argument("--output-id", help="id of a single image's result")
    sub.choices["run"].add_argument("--layout", choices=(pipeline.TABLE, pipeline.FOLDERS), default=pipeline.TABLE, help="folders: raw.json and text.txt per receipt, too")
    sub.choices["run"].add_argument("--unique-ids", action="store_true", help="stop when two files have one id")
    sub.choices["dataset"].add_argument("--one-file", action="store_true", help="join the parts into one file")
    return top


def _flow(args: argparse.Namespace):
    """(settings, model factory, preprocessor factory)"""
    settings = load(prefix=args.env_prefix)
    make = recognize.imported(args.recognizer)
    other = args.preprocessor or (_TEXT[1] if args.recognizer == _TEXT[0] else _PIXELS)
    prepare = recognize.imported(other)
    return settings, make, (lambda: prepare(settings)) if other == _PIXELS else prepare


def _dataset(spark: SparkSession, args: argparse.Namespace) -> int:
    base = args.output.rstrip("/")
    found = files.stored(spark, base)
    texts = files.texts(spark, base) if found is None else files.latest(found).select("output_id", "text")
    path = f"{base}/manifest.jsonl"
    records = dataset.build(files.manifest(spark, path), texts) if exists(spark, path) else dataset.build_from_listing(texts)
    if args.one_file:
        parts = new_path(spark, "dataset")
        n = sinks.write_dataset(records, parts)
        sinks.one_file(spark, parts, args.dest)
        remove(spark, parts)
    else:
        n = sinks.write_dataset(records, args.dest)
    print(f"wrote {n} records to {args.dest}")
    return 0


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    settings, make, prepare = _flow(args)
    began = time.monotonic()
    done = pipeline.process(
        spark, args.input, args.output, make, prepare, overwrite=args.overwrite, settings=settings,
        max_images_per_call=args.max_batch, layout=args.layout, unique_ids=args.unique_ids, output_id=args.output_id,
    )
    if not done.found:
        print(f"nothing to do: {done.skipped} done before, --overwrite does them again")
        return 0
    if done.results is None:
        print(f"0 of 0 done, {done.skipped} skipped")
        return 0
    s = dataset.summary(done.results).first()
    print(f"{s.succeeded} of {s.total} done in {time.monotonic() - began:.1f} s, {done.skipped} skipped")
    for r in done.results.where("status = 'error'").orderBy("place").select("file", "error").toLocalIterator():
        print(f"  {r.file}: {r.error}")
    peak = done.results.agg(F.max("peak_memory")).first()[0]
    if peak is not None:
        print(f"peak device memory {peak / 2**30:.2f} GB")
    return int(s.failed > 0)


def _check(args: argparse.Namespace) -> int:
    """A sample image through preprocessor and model, without Spark."""
    settings, make, prepare = _flow(args)
    model, pre = make(), prepare()
    image, _ = pre.prepare(pre.sample())
    lines = recognize.with_backoff(model, [image], settings)[0]
    print(f"{type(model).__name__} read {len(lines)} lines: {[t for t, _, _ in lines]}")
    peak = getattr(model, "peak_memory", lambda: None)()
    if peak is not None:
        print(f"peak device memory {peak / 2**30:.2f} GB")
    return 0


def main(argv: list[str] | None = None) -> int:
    """0 when nothing failed or nothing was to do, else 1."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if getattr(args, "verbose", False) else logging.WARNING, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    if args.command == "check":
        return _check(args)
    spark = SparkSession.builder.appName("slipweave").getOrCreate()
    return _dataset(spark, args) if args.command == "dataset" else _run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
