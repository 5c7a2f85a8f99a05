"""Command line: index a tree, search it, and report what searches saved."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import answers, counters
from quarrylight.operators import savings
from quarrylight.plans.engine import Engine
from quarrylight.sources import requests


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarrylight")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="bring a snapshot to the state of a tree")
    search = commands.add_parser("search", help="the view for one query")
    stats = commands.add_parser("stats", help="what searches saved")
    status = commands.add_parser("status", help="files, chunks and age of a snapshot, as JSON")
    status.add_argument("--snapshot", required=True)
    index.add_argument("root")
    for command in (index, search):
        command.add_argument("--snapshot", required=True)
        command.add_argument("--vocabulary", help="file of base64 tokens and ranks to count tokens by")
        command.add_argument("--pattern", help="how that vocabulary's tokenizer finds pieces")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--token-budget", type=int, default=0)
    search.add_argument("--client", default="cli")
    search.add_argument("--log")
    stats.add_argument("--log", required=True)
    stats.add_argument("--json", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("quarrylight").getOrCreate()
    if given.command == "stats":
        log = requests.read(spark, given.log)
        summary, clients = savings.request_summary(log), savings.by_client(log)
        print(answers.as_json(summary, None) if given.json else requests.dashboard(summary, clients))
        return
    counted_by = getattr(given, "vocabulary", None) and counters.BytePairs(given.vocabulary, given.pattern or r"\S+|\s+")
    engine = Engine(spark, counter=counted_by or counters.quarter_length)
    found = engine.load(given.snapshot)
    if given.command == "index":
        changed = {r["change"]: r["count"] for r in engine.index(given.root).groupBy("change").count().collect()}
        engine.save(given.snapshot)
        print(json.dumps(changed))
        return
    if not found:
        raise SystemExit("no snapshot of this format there")
    if given.command == "status":
        print(answers.as_json(engine.stats()))
        return
    asked = spark.createDataFrame([(1, given.query)], "qid int, query string")
    if given.token_budget:
        results = engine.search_within(asked, given.token_budget).withColumnRenamed("place", "rank")
    else:
        results = engine.search(asked, given.limit)
    view = engine.context(results).first()
    if view is None:
        print(answers.NOTHING)
        return
    text = view["context"]
    located = results.join(engine.chunks.select("chunk_id", "file_path"), "chunk_id")
    targeted = spark.createDataFrame([(1, text)], "qid int, text string").select("qid", counters.counted(F.col("text"), engine.counter).alias("targeted_tokens"))
    entry = savings.track_search(located, engine.files, targeted).first()
    print(text + answers.footer(entry["naive_tokens"], entry["targeted_tokens"], entry["saved_tokens"]))
    if given.log:
        row = (datetime.now(timezone.utc).isoformat(), given.client, given.query, float(entry["chunk_count"]), float(entry["naive_tokens"]), float(entry["targeted_tokens"]), float(entry["saved_tokens"]))
        requests.append(spark.createDataFrame([row], "ts string, client string, query string, chunks double, naive_tokens double, targeted_tokens double, saved_tokens double"), given.log)


if __name__ == "__main__":
    main()
