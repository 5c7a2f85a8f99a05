"""Parsing of source files into chunks: one file in, any number of rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import parse_python, parse_script, scripts
from quarrylight.functions import text as T

SCHEMA = "chunk_id string, file_path string, symbol_name string, kind string, start_line int, end_line int, code string, file_hash string, refs array<string>, ext_refs array<string>, pos int, error string"


def of_file(path: str, content: str, root: str, aliases: list[tuple[str, str]]) -> list[dict]:
    """Symbols of one file; components are masked first, Python files without symbols are one chunk unless they don't parse."""
    if path.endswith(".py"):
        found = parse_python.symbols(content, path, root)
        lines = content.split("\n")
        for s in found:
            s["code"] = "\n".join(lines[s["start"] - 1 : s["end"]])
        if not found and content.strip() and _parses(content):
            found = [{"name": "__file__", "kind": "file", "start": 1, "end": len(lines), "code": content, "refs": [], "ext_refs": []}]
        return found
    if path.endswith((".vue", ".svelte")):
        content = scripts.mask(content)
        if content is None:
            return []
    return parse_script.symbols(content, path, aliases)


def _parses(content: str) -> bool:
    import ast

    try:
        ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


def parsed(files: DataFrame, root: str = "/repo", aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Chunks of files (file_path, content), with the file's hash and each chunk's place in it.

    A file that can't be parsed gives one row with ``error`` set and no id, so one bad file
    doesn't fail the job.  Of chunks with one id the last counts.
    """
    named = list(aliases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, digest in zip(batch["file_path"], batch["content"], batch["file_hash"], strict=True):
                try:
                    found = of_file(path, content or "", root, named)
                except Exception as error:  # noqa: BLE001  a file's failure is a row
                    rows.append((None, path, None, None, None, None, None, digest, None, None, None, repr(error)))
                    continue
                last = {s["name"]: i for i, s in enumerate(found)}
                rows += [(f"{path}::{s['name']}", path, s["name"], s["kind"], s["start"], s["end"], s["code"], digest, s["refs"], s["ext_refs"], i, None) for i, s in enumerate(found) if last[s["name"]] == i]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    hashed = files.select("file_path", "content", T.content_hash(F.coalesce("content", F.lit(""))).alias("file_hash"))
    return hashed.mapInPandas(run, SCHEMA)
