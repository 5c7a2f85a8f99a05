"""Which files of a tree are indexed: by path, ignore rules and size."""

from __future__ import annotations

import posixpath
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions, what marks a test file, what is never indexed, and the largest size.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte", ".py")
TEST_FILE = r"(\.(test|spec)\.[jt]sx?$)|([\\/](__tests__|test|tests)[\\/])|([\\/]test_[^\\/]+\.py$)|(_test\.py$)"
BASELINE = ("node_modules", ".git", "dist", "build", ".next", "coverage", ".quarrylight", "__pycache__", ".venv", "venv", ".pytest_cache", "*.egg-info")
MOST_BYTES = 1_572_864

TEST_FILE_SQL = TEST_FILE


def indexable(path: Column) -> Column:
    """Allowed extension (case counts) and no test file; the whole path is looked at."""
    return F.regexp_extract(path, r"\.[^./]*$", 0).isin(*EXTENSIONS) & ~path.rlike(TEST_FILE)


def at_most(files: DataFrame, column: str = "length", most: int = MOST_BYTES) -> DataFrame:
    return files.where(F.col(column) <= most)


def pattern_regex(pattern: str) -> str:
    """A regular expression for what one ignore pattern itself matches, relative to its folder."""
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("" if "/" in pattern.rstrip("/") else "(?:.*/)?") + out


class Rule(NamedTuple):
    folder: str
    regex: str
    negated: bool
    folders_only: bool


def rules(files: list[tuple[str, str]]) -> list[Rule]:
    """Rules in order, from (folder, text of its ignore file); baseline rules come first and belong to the root."""
    out = [Rule("", pattern_regex(p), False, False) for p in BASELINE]
    for folder, text in files:
        for line in text.splitlines():
            line = line.rstrip()
            if line and not line.startswith("#"):
                negated = line.startswith("!")
                pattern = line[negated:].removeprefix("\\")
                out.append(Rule(folder.rstrip("/"), pattern_regex(pattern), negated, pattern.endswith("/")))
    return out


def ignored(path: str, found: list[Rule], root: str) -> bool:
    """Whether a file is ignored: it or one of its folders is, by the last rule of a level that matches.

    Baseline and root rules are one level.  Rules of a nested folder hold below it; they can
    ignore more but not take back what a level above ignores.
    """
    for level in dict.fromkeys((r.folder or root) for r in found):
        if not path.startswith(level + "/"):
            continue
        parts = path[len(level) + 1 :].split("/")
        for n in range(1, len(parts) + 1):
            at, verdict = "/".join(parts[:n]), False
            for r in found:
                if (r.folder or root) == level and not (r.folders_only and n == len(parts)) and re.fullmatch(r.regex, at, re.S):
                    verdict = not r.negated
            if verdict:
                return True
    return False


def not_ignored(files: DataFrame, found: list[Rule], root: str, column: str = "path") -> DataFrame:
    """Files that no rule ignores; only paths go to Python."""
    top = root.rstrip("/")

    def keep(paths: pa.Array) -> pa.Array:
        return pa.array([p is not None and not ignored(p, found, top) for p in paths.to_pylist()])

    return files.where(F.arrow_udf(keep, "boolean")(F.col(column)))


def ancestors(path: str, root: str) -> list[str]:
    """Folders between the root and a file, root first."""
    out, at = [], posixpath.dirname(path)
    while at.startswith(root) and len(at) >= len(root):
        out.append(at)
        if at == root:
            break
        at = posixpath.dirname(at)
    return out[::-1]
