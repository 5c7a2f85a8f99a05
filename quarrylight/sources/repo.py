"""Files of a source tree, as a table of paths that executors read."""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarrylight.sources import filters

ALIAS_FILES = ("tsconfig.json", "jsconfig.json")


def walk(root: str) -> tuple[str, list[tuple[str, int]], list[filters.Rule]]:
    """Absolute root, (path, bytes) of candidate files, and the ignore rules.

    Entries whose name starts with a dot are skipped, ignored folders aren't entered.
    """
    top = os.path.realpath(root)
    if not os.path.exists(top):
        raise FileNotFoundError(f"Repo path does not exist: {root}")
    if not os.path.isdir(top):
        raise NotADirectoryError(f"Repo path is not a directory: {root}")
    texts: list[tuple[str, str]] = []
    found: list[tuple[str, int]] = []
    for folder, folders, names in os.walk(top):
        own = os.path.join(folder, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as file:
                texts.append(("" if folder == top else folder, file.read()))
        rules = filters.rules(texts)
        folders[:] = sorted(f for f in folders if not f.startswith(".") and not filters.ignored(os.path.join(folder, f), rules, top))
        for name in sorted(names):
            path = os.path.join(folder, name)
            if not name.startswith(".") and os.path.isfile(path) and not filters.ignored(path, rules, top):
                found.append((path, os.path.getsize(path)))
    return top, found, filters.rules(texts)


def files(spark: SparkSession, root: str) -> DataFrame:
    """file_path and content of what is indexed, read by the executors; oversize files aren't opened.

    The root has to be visible to executors.  Bytes that aren't UTF-8 become U+FFFD; files
    that vanish meanwhile are left out.
    """
    _, found, _ = walk(root)
    listed = spark.createDataFrame(found, "path string, length long") if found else spark.createDataFrame([], "path string, length long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as file:
                        rows.append((path, file.read()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["file_path", "content"])

    chosen = filters.at_most(listed, "length").where(filters.indexable(listed["path"]))
    return chosen.mapInPandas(read, "file_path string, content string")


def _plain_json(text: str) -> dict:
    """JSON with comments and trailing commas."""
    parts = re.findall(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[^"/]+|/', text, re.S)
    kept = "".join(p for p in parts if not p.startswith(("//", "/*")))
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", kept))


def aliases(root: str) -> list[tuple[str, str]]:
    """(pattern, target) of the first configuration file that has path aliases; the first target of each."""
    for name in ALIAS_FILES:
        try:
            with open(os.path.join(root, name), encoding="utf-8") as file:
                options = _plain_json(file.read()).get("compilerOptions", {})
        except (OSError, ValueError):
            continue
        if options.get("paths"):
            base = posixpath.normpath(posixpath.join(root, options.get("baseUrl", ".")))
            return [(pattern, posixpath.normpath(posixpath.join(base, targets[0]))) for pattern, targets in options["paths"].items() if targets]
    return []
