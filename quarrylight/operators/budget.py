"""Greedy packing of ranked chunks and what they depend on into a token budget.

Order matters (a chunk that doesn't fit is skipped, later ones may fit), so each query is
packed by one function over its candidates: the ranked chunks, what can be reached from
them, and the lines that their files would add to the view.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions.counters import quarter_length
from quarrylight.operators.context import COLLAPSED

MOST_PRIMARY = 25


def view(selected: list[str], chunks: dict[str, dict], files: dict[str, list[str]]) -> str:
    """The compact view of the selected chunks; twin of the DataFrame form."""
    chosen, blocks = set(selected), []
    for path in dict.fromkeys(chunks[c]["file_path"] for c in selected):
        members = [chunks[c] for c in files[path]]
        out = [f"// ═══ {path} ═══"]
        out += [m["code"] for m in members if m["kind"] == "module"][:1]
        others = 0
        for m in members:
            if m["kind"] == "module":
                continue
            span = f"{m['symbol_name']}  ({m['kind']}, lines {m['start_line']}-{m['end_line']})"
            if m["symbol_name"] == "__file__":
                out += [m["code"]] if m["chunk_id"] in chosen else []
            elif m["chunk_id"] in chosen:
                out += [f"// ▸ {span}", m["code"]]
            else:
                others += 1
                if others <= COLLAPSED:
                    out.append(f"//   {span}:  {m['signature']}")
        if others > COLLAPSED:
            out.append(f"//   … {others - COLLAPSED} more symbol(s) in this file")
        blocks.append("\n".join(out))
    return "\n\n".join(blocks)


def greedy(ranked: list[str], edges: dict[str, list[str]], chunks: dict[str, dict], files: dict[str, list[str]], limit: int, counter: Callable[[str], int] = quarter_length) -> list[str]:
    """Chunks in the order in which they are packed; the first always is."""
    taken: list[str] = []
    for primary in ranked:
        queue = deque([primary])
        while queue:
            chunk = queue.popleft()
            if chunk in taken or chunk not in chunks:
                continue
            if taken and counter(view([*taken, chunk], chunks, files)) > limit:
                continue
            taken.append(chunk)
            queue.extend(d for d in edges.get(chunk, []) if d not in taken)
    return taken


def closure(ranked: DataFrame, edges: DataFrame, most_hops: int | None = None, sizes: DataFrame | None = None, most_size: int | None = None) -> DataFrame:
    """qid and chunk_id of everything that can be reached from the ranked chunks.

    One join a hop until nothing is new.  Checkpoints end the lineage.  With ``sizes``
    (chunk_id, size), paths are followed as long as the sizes on them sum to ``most_size``
    at most.
    """
    sizes = edges.select(F.col("dst").alias("chunk_id")).unionByName(ranked.select("chunk_id")).distinct().withColumn("size", F.lit(0).cast("long")) if sizes is None else sizes
    links = edges.join(sizes, F.col("dst") == F.col("chunk_id")).select("src", "dst", "size").distinct().checkpoint()
    seen = ranked.select("qid", "chunk_id").distinct().join(sizes, "chunk_id").select("qid", "chunk_id", F.col("size").alias("cost")).checkpoint()
    frontier, hop = seen, 0
    while most_hops is None or hop < most_hops:
        step = frontier.join(links, frontier.chunk_id == links.src).select("qid", F.col("dst").alias("chunk_id"), (F.col("cost") + F.col("size")).alias("cost"))
        step = step if most_size is None else step.where(F.col("cost") <= most_size)
        had = seen.withColumnRenamed("cost", "_had")
        frontier = step.groupBy("qid", "chunk_id").agg(F.min("cost").alias("cost")).join(had, ["qid", "chunk_id"], "left").where("_had IS NULL OR cost < _had").drop("_had").checkpoint()
        if frontier.isEmpty():
            break
        seen, hop = seen.unionByName(frontier).groupBy("qid", "chunk_id").agg(F.min("cost").alias("cost")).checkpoint(), hop + 1
    return seen.select("qid", "chunk_id")


def pack(ranked: DataFrame, chunks: DataFrame, edges: DataFrame, limit: int, counter: Callable[[str], int] = quarter_length, hops: int | None = None) -> DataFrame:
    """qid, place, chunk_id: what is packed for each query within ``limit`` tokens.

    Code travels for the closure's chunks and modules alone; other symbols of their files
    go as one line.  Dependencies are followed until nothing is new, or for ``hops``.  A
    chunk is only looked at when all before it on some path were taken, and the view holds
    the code of each of them, so paths whose code alone is over the limit end there; this
    holds for the fallback rule, with other counters the whole closure is packed.
    """
    ranked = ranked.where(F.col("rank") <= MOST_PRIMARY)
    plain = counter is quarter_length
    sizes = chunks.select("chunk_id", F.when(F.col("kind") == "module", 0).otherwise(T.utf16_length(F.coalesce("code", F.lit("")))).cast("long").alias("size")) if plain else None
    reach = closure(ranked, edges, hops, sizes, 4 * limit if plain else None)
    paths = reach.join(chunks.select("chunk_id", "file_path"), "chunk_id").select("qid", "file_path").distinct()
    inside = reach.withColumn("_in", F.lit(True))
    members = paths.join(chunks, "file_path").join(inside, ["qid", "chunk_id"], "left").join(ranked.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left")
    code = F.when(F.col("_in") | (F.col("kind") == "module"), F.coalesce("code", F.lit("")))
    out = edges.groupBy(F.col("src").alias("chunk_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda e: e["dst"]).alias("deps"))
    rows = members.join(out, "chunk_id", "left").select("qid", "chunk_id", "file_path", "symbol_name", "kind", "start_line", "end_line", "ord", "rank", "deps", code.alias("code"), T.signature(F.col("code")).alias("signature"))
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["file_path", "start_line", "end_line", "ord"], kind="stable")
        held = {r["chunk_id"]: r for r in part.to_dict("records")}
        files = part.groupby("file_path", sort=False)["chunk_id"].apply(list).to_dict()
        order = part[part["rank"].notna()].sort_values("rank")["chunk_id"].tolist()
        links = {c: list(r["deps"]) for c, r in held.items() if r["deps"] is not None and r["code"] is not None}
        usable = {c: r for c, r in held.items() if r["code"] is not None}
        reachable = {c: [d for d in ds if d in usable] for c, ds in links.items()}
        taken = greedy(order, reachable, held, files, limit, counter)
        return pd.DataFrame({"qid": part["qid"].iloc[0], "place": range(1, len(taken) + 1), "chunk_id": taken})

    return rows.groupBy("qid").applyInPandas(one, f"qid int, place int, chunk_id {kind}")
