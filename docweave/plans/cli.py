"""Command line: extract PATH..., structure INPUT..., schema. Exit code 0: all went well, 3: some inputs failed, 1: nothing went."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import parse_prompt, resolve
from docweave.errors import ConfigInvalid
from docweave.functions.files import base_name, inner_name
from docweave.operators import metrics
from docweave.operators.archives import archive_summaries, input_slots
from docweave.plans import result, sinks
from docweave.plans.engine import DocEngine
from docweave.sources.scan import missing
from docweave.sources.store import clear, hadoop_path, stored

log = logging.getLogger("docweave")  # silent unless --verbose
log.addHandler(logging.NullHandler())


def whole(spark: SparkSession, path: str) -> str:
    """A path as scans name it."""
    there, system = hadoop_path(spark, path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return system.makeQualified(there).toString()


def inputs(engine: DocEngine, paths: list[str]) -> tuple[DataFrame, list[dict]]:
    """Slots of the inputs in order, and a summary of each archive."""
    spark = engine.spark
    absent = set(missing(spark, paths))
    given = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "origin int, path string")
    zips = [p for p in paths if p.lower().endswith(".zip") and p not in absent]
    entries = engine.scan(zips) if zips else engine.spark.createDataFrame([], "path string, entry string, error_code string, error_message string")
    entries = stored(entries.select("path", "entry", "error_code", "error_message"))
    lost = given.where(F.col("path").isin(sorted(absent)) & F.lower("path").endswith(".zip"))
    lost = lost.select("origin", F.lit(0).alias("sub"), "path", F.lit("archive-failed").alias("kind"), F.lit("ERR_FILE_NOT_FOUND").alias("error_code"), F.concat(F.lit("File not found: "), "path").alias("error_message"))
    slots = input_slots(given, entries).unionByName(lost).orderBy("origin", "sub")
    return stored(slots), [r.asDict() for r in archive_summaries(entries).orderBy("archive").toLocalIterator()]


def extract(engine: DocEngine, args) -> tuple[dict, int]:
    paths = [whole(engine.spark, p) for p in args.paths]
    slots, archives = inputs(engine, paths)
    results, seen = metrics.observed(engine.results(paths, None, args.full_pages, args.detect_seals, args.force))
    rows = stored(results)
    log.info("results: %s", seen.get)  # known with the action that stored them
    both = slots.join(rows.select("path", "ok", "markdown", F.col("error_code").alias("code"), F.col("error_message").alias("error"), F.col("metrics.performance.total_ms").alias("ms")), "path", "left")
    written = sinks.write_markdown(both.where("ok and kind = 'parse'").select("origin", "sub", "path", "markdown"), args.out)
    if args.results:
        sinks.write_results(rows, args.results).count()
    shown = both.drop("markdown").join(written, "path", "left").orderBy("origin", "sub")
    items = []
    for r in shown.toLocalIterator():
        ok = bool(r["ok"]) and r["kind"] != "archive-failed"
        item = {"path": r["path"], "ok": ok, "durationMs": r["ms"] or 0}
        item |= {"message": "Already a text file"} if ok and r["kind"] == "passthrough" else {"outFile": r["out_file"]} if ok else {k: v for k, v in (("error", r["error"] or r["error_message"]), ("code", r["code"] or r["error_code"])) if v}
        items.append(item)
    failed = sum(not i["ok"] for i in items)
    summary = {"total": len(items), "ok": len(items) - failed, "failed": failed, "totalMs": sum(i["durationMs"] for i in items), "items": items}
    summary["metrics"] = {k: seen.get[k] for k in ("files", "retries", "images", "yuan")}
    return summary | ({"archives": archives} if archives else {}), failed


def structure(engine: DocEngine, args) -> tuple[dict, int]:
    if args.prompt and args.prompt_text:
        raise ConfigInvalid("--prompt and --prompt-text exclude each other")
    prompt = None
    if args.prompt:
        with open(args.prompt, encoding="utf-8") as f:
            prompt = parse_prompt(f.read())
    elif args.prompt_text:
        prompt = parse_prompt(args.prompt_text)
    paths = [whole(engine.spark, p) for p in args.paths]
    slots, archives = inputs(engine, paths)
    rows = stored(engine.results(paths, None, args.full_pages, args.detect_seals, args.force))
    both = slots.join(rows.select("path", "ok", "markdown", F.col("error_code").alias("code"), F.col("error_message").alias("error")), "path", "left")
    name = base_name(inner_name(F.col("path")))
    # The slots say the order: an input's place, then an entry's.
    seq = F.struct("origin", "sub")
    good = stored(both.where("ok").select(seq.alias("seq"), name.alias("name"), F.col("markdown").alias("text")))
    found = engine.structured(good, prompt)
    meta, failures = [], []
    for r in both.drop("markdown").orderBy("origin", "sub").toLocalIterator():
        if r["ok"]:
            meta.append({"path": r["path"], "kind": "passthrough" if r["kind"] == "passthrough" else "parsed"})
        else:
            failures.append({"path": r["path"], "error": r["error"] or r["error_message"] or "parse failed", **({"code": c} if (c := r["code"] or r["error_code"]) else {})})
    summary = {"inputs": meta, **found} | ({"archives": archives} if archives else {}) | ({"parseFailures": failures} if failures else {})
    return summary, len(failures)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docweave")
    top.add_argument("--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("schema", help="print the JSON Schema of a result")
    for name in ("extract", "structure"):
        p = sub.add_parser(name)
        p.add_argument("paths", nargs="+")
        p.add_argument("--mode", choices=("mock", "api"))
        for option in ("base-url", "api-key", "text-model", "vision-model", "ocr-provider", "aliyun-access-key-id", "aliyun-access-key-secret", "aliyun-ocr-endpoint", "aliyun-ocr-region", "cache-dir"):
            p.add_argument(f"--{option}")
        p.add_argument("--concurrency", type=int, dest="file_concurrency", help="files parsed at once")
        p.add_argument("--full-pages", action="store_true", help="all pages of long PDFs")
        p.add_argument("--force", action="store_true", help="past the cache")
        p.add_argument("--no-detect-seals", action="store_false", dest="detect_seals")
        if name == "extract":
            p.add_argument("--out", help="folder for the Markdown (default: beside each input)")
            p.add_argument("--results", help="folder for results as JSON")
        else:
            p.add_argument("--prompt")
            p.add_argument("--prompt-text")
            p.add_argument("--max-input-chars", type=int)
    return top


SETTINGS = ("mode", "base_url", "api_key", "text_model", "vision_model", "ocr_provider", "aliyun_access_key_id", "aliyun_access_key_secret", "aliyun_ocr_endpoint", "aliyun_ocr_region", "cache_dir", "file_concurrency", "max_input_chars")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verbose:
        logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="[docweave:%(levelname)s] %(message)s")
    if args.command == "schema":
        print(json.dumps(result.json_schema(), indent=2))
        return 0
    given = {k: v for k in SETTINGS if (v := getattr(args, k, None)) is not None}
    if "vision_model" in given:
        given["ocr_model"] = given["vision_model"]
    config = resolve(**given)
    spark = SparkSession.builder.config("spark.speculation", "false").getOrCreate()
    log.info("%s of %d inputs, %s", args.command, len(args.paths), config.mode)
    try:
        summary, failed = (extract if args.command == "extract" else structure)(DocEngine(spark, config), args)
    finally:
        clear(spark)
    print(json.dumps(summary, indent=2, ensure_ascii=False))
    return 3 if failed else 0


if __name__ == "__main__":
    try:
        code = main()
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        code = 1
    sys.stdout.flush()
    os._exit(code) if code == 1 else sys.exit(code)
