"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Nearness is the inner product.  Each distinct vector is a node; one more coordinate makes
all nodes equally long, so that larger inner products are smaller distances.  The graph
starts from the neighbours within the leaves of some random projection trees and improves
by NN-descent: neighbours of a node are compared with each other, unless both were in an
earlier round, and each keeps the nearest it has met.  Rounds go on until few lists change.
A query walks the graph from its node, always opening the nearest nodes that it hasn't
opened, until those that it would open are all open.

Both are iterated joins between nodes and messages to nodes.  Nodes are dealt into buckets,
messages are packed into one binary row for each pair of buckets and shuffled to where
their node is; every round is written to the shared folder.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part.  Vectors of
different lengths have no inner product: each length has a graph of its own, and queries
meet the rows of their length.  Copies of a vector are one node; the smallest ids of each
node stand for it, as many as a result can hold.  Approximate: neighbours may be missed.
The graph compares vectors in half precision; every node that a query looks at is scored in
double precision on the original vectors, so near copies are told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm._common import remove, written

#: Neighbours kept of a node, reverse ones used beside them, trees, rows of a leaf.
K, REVERSE, TREES, LEAF = 40, 32, 10, 512
#: Rounds end when this share of all neighbours is new, and after so many at the latest.
SETTLED, MOST_ROUNDS = 0.1, 12
#: Nodes that a query keeps in sight, the best of them that it wants open, those that it opens in a step, and its most steps.
SIGHT, WANTED, OPENED, MOST_STEPS = 224, 192, 64, 24
#: Steps end when the nodes still to be opened are this share of all that are wanted.
UNDONE = 0.005
#: Vectors that the trees' planes are drawn from: one of so many, within bounds; deeper levels share a plane.
SAMPLE_OF, SAMPLE_LEAST, SAMPLE_MOST = 32, 8_192, 65_536
NODES_OF_BUCKET = 3_000
SCHEMA = "bucket int, kind int, id long, vec binary, data binary"

_EDGE = np.dtype([("to", "i8"), ("of", "i8")])
_FLAGGED = np.dtype([("to", "i8"), ("of", "i8"), ("new", "u1")])
_LIST = np.dtype([("of", "i8"), ("sim", "f4"), ("new", "u1")])
_SCORED = np.dtype([("to", "i8"), ("of", "i8"), ("sim", "f4")])


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each id: its bits mixed, then the rest by the number of buckets."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(n)).astype(np.int32)


def _packed(rows: np.ndarray, n: int, kind: int = 1) -> Iterator[tuple]:
    """Records as one row for each bucket of their ``to``."""
    if len(rows):
        place = bucket_of(rows["to"], n)
        order = np.argsort(place, kind="stable")
        rows, place = rows[order], place[order]
        at, first = np.unique(place, return_index=True)
        for b, part in zip(at.tolist(), np.split(rows, first[1:]), strict=True):
            yield b, kind, None, None, part.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "id", "vec", "data"])


def _meet(nodes: DataFrame, messages: DataFrame | None, n: int, act: Callable[[dict], Iterator[tuple]], label: str, messages_of: np.dtype) -> DataFrame:
    """Brings nodes and messages of each bucket together, acts on them, and writes what comes out.

    ``act`` gets the bucket's ids (sorted), vecs and data as lists, and the messages as one
    array of records; it yields rows of SCHEMA.
    """
    both = nodes.unionByName(messages) if messages is not None else nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, data, records, kinds = [], [], [], [], []
        for batch in batches:
            kind = batch.column(1).to_pylist()
            for i, k in enumerate(kind):
                if k == 1:
                    records.append(np.frombuffer(batch.column(4)[i].as_py(), messages_of))
                else:
                    ids.append(batch.column(2)[i].as_py())
                    vecs.append(batch.column(3)[i].as_py())
                    data.append(batch.column(4)[i].as_py())
                    kinds.append(k)
        if not ids and not records:
            return
        order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
        here = {
            "ids": np.array([ids[i] for i in order], np.int64),
            "vecs": [vecs[i] for i in order],
            "data": [data[i] for i in order],
            "kinds": [kinds[i] for i in order],
            "n": n,
            "messages": np.concatenate(records) if records else np.zeros(0, messages_of),
        }
        out = []
        for row in act(here):
            out.append(row)
            if len(out) >= 2_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return written(both.repartitionById(n, "bucket").mapInArrow(run, SCHEMA), label)


def _runs(to: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and stop of each run in a sorted array."""
    if len(to):
        starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        stops = np.append(starts[1:], len(to))
        yield from zip(to[starts].tolist(), starts.tolist(), stops.tolist(), strict=True)


def _best(of: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ones, nearest first, ties to the smaller id."""
    order = np.lexsort((of, -sim))
    of, sim = of[order], sim[order]
    _, first = np.unique(of, return_index=True)
    first = np.sort(first)[:k]
    return of[first], sim[first]


def _lists(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(data, _LIST)
    return rows["of"], rows["sim"]


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles as bytes) and dims of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append((x + 0.0).tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], names=["id", "vec", "dims"])

    return rows.mapInArrow(run, "id long, vec binary, dims int")


def nodes_of(valid: DataFrame, held: int) -> DataFrame:
    """Distinct vectors: node (smallest id), members (the ``held`` smallest ids), vec, dims."""
    place = Window.partitionBy("vec").orderBy("id")
    first = valid.withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= held)
    return first.groupBy("vec", "dims").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("node"), "members", "vec", "dims")


def _planes(sample: np.ndarray, depth: int, trees: int, seed: int) -> np.ndarray:
    """For each tree, a plane (direction and offset) for each inner node, halving the sample each time."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    out = np.zeros((trees, max(1, (1 << depth) - 1), dims + 1), np.float32)
    for t in range(trees):
        level = [np.arange(len(sample))]
        for d in range(depth):
            below = []
            for i, here in enumerate(level):
                direction = rng.standard_normal(dims).astype(np.float32)
                side = sample[here] @ direction
                node = (1 << d) - 1 + i
                out[t, node, :-1], out[t, node, -1] = direction, np.median(side) if len(side) else 0.0
                right = side > out[t, node, -1]
                below += [here[~right], here[right]]
            level = below
    return out


def _shared_planes(sample: np.ndarray, levels: int, trees: int, seed: int) -> np.ndarray:
    """For each tree and further level, one plane through the sample's median."""
    rng = np.random.default_rng(seed + 1)
    out = rng.standard_normal((trees, levels, sample.shape[1] + 1)).astype(np.float32)
    for t in range(trees):
        for level in range(levels):
            out[t, level, -1] = np.median(sample @ out[t, level, :-1])
    return out


def build(nodes: DataFrame, n_nodes: int, n: int, seed: int = 5) -> DataFrame:
    """The graph: rows of SCHEMA with kind 0, vec (half-precision, all of length 1) and data (neighbours, nearest first)."""
    spark = nodes.sparkSession
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, n_nodes // SAMPLE_OF))
    sample = np.stack([np.frombuffer(r["vec"], np.float16).astype(np.float32) for r in nodes.orderBy(F.xxhash64("id", F.lit(seed))).limit(size).select("vec").toLocalIterator()])
    wanted = max(0, int(np.ceil(np.log2(max(1, n_nodes / LEAF)))))
    depth = min(wanted, int(np.log2(max(1, len(sample) / 8))))
    planes = spark.sparkContext.broadcast((_planes(sample, depth, TREES, seed), _shared_planes(sample, wanted - depth, TREES, seed)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, further = planes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = np.stack([np.frombuffer(v, np.float16) for v in batch.column(1).to_pylist()]).astype(np.float32)
            for t in range(len(trees)):
                at = np.zeros(len(vec), np.int64)
                for _ in range(depth):
                    at = 2 * at + 1 + (np.einsum("ij,ij->i", vec, trees[t, at, :-1]) > trees[t, at, -1])
                for plane in further[t]:
                    at = 2 * at + 1 + (vec @ plane[:-1] > plane[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), t, np.int32)), pa.array(at), batch.column(0), batch.column(1)], names=["tree", "leaf", "id", "vec"])

    dealt = nodes.select("id", "vec").mapInArrow(leaves, "tree int, leaf long, id long, vec binary")
    # copies are one node, but many vectors that are nearly equal may still fill a leaf
    full = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("int").alias("parts"))
    split = dealt.join(full, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")).cast("int"))
    order = ["tree", "leaf", "part"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(ids: list[int], vecs: list[bytes]) -> Iterator[tuple]:
            own = np.array(ids, np.int64)
            vec = np.stack([np.frombuffer(v, np.float16) for v in vecs]).astype(np.float32)
            sims = vec @ vec.T
            np.fill_diagonal(sims, -np.inf)
            k = min(K // 2, len(own) - 1)
            if k < 1:
                return
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            rows = np.empty(top.size, _SCORED)
            rows["to"], rows["of"], rows["sim"] = np.repeat(own, k), own[top.ravel()], np.take_along_axis(sims, top, 1).ravel()
            yield from _packed(rows, n)

        now, ids, vecs = None, [], []
        for batch in batches:
            for *at, i, v in zip(*(batch.column(c) for c in range(5)), strict=True):
                at = tuple(x.as_py() for x in at)
                if at != now:
                    if ids:
                        yield _batch(list(near(ids, vecs)))
                    now, ids, vecs = at, [], []
                ids.append(i.as_py())
                vecs.append(v.as_py())
        if ids:
            yield _batch(list(near(ids, vecs)))

    found = split.select(*order, "id", "vec").repartition(n, *order).sortWithinPartitions(*order).mapInArrow(within, SCHEMA)
    state = _meet(nodes, found, n, _merge, "nn-forest", _SCORED)
    for _ in range(MOST_ROUNDS):
        better = _descend(state, n)
        remove(state)
        state = better
        if _fresh(state) <= SETTLED * K * n_nodes:
            break
    return state


def _fresh(state: DataFrame) -> int:
    """Neighbours that the last round brought, over all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(np.frombuffer(d.as_py(), _LIST)["new"].sum()) for d in batch.column(0))])], names=["n"])

    return state.select("data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _merge(here: dict) -> Iterator[tuple]:
    """Nodes with the messages' neighbours taken in; their lists hold the K nearest, and which of them are new."""
    ids, got = here["ids"], here["messages"]
    got = got[np.argsort(got["to"], kind="stable")]
    low, high = np.searchsorted(got["to"], ids), np.searchsorted(got["to"], ids, "right")
    for i, node in enumerate(ids.tolist()):
        old = np.frombuffer(here["data"][i] or b"", _LIST)
        new = got[low[i] : high[i]]
        new = new[~np.isin(new["of"], old["of"])]
        of, sim = _best(np.concatenate([old["of"], new["of"]]), np.concatenate([old["sim"], new["sim"]]), K)
        rows = np.empty(len(of), _LIST)
        rows["of"], rows["sim"], rows["new"] = of, sim, ~np.isin(of, old["of"])
        yield int(bucket_of(np.array([node]), here["n"])[0]), 0, node, here["vecs"][i], rows.tobytes()


def _descend(state: DataFrame, n: int) -> DataFrame:
    """One round of NN-descent: neighbours, forward and reverse, of each node are compared with each other.

    Pairs that are both old met in an earlier round; nodes without new neighbours ask nobody.
    """

    def reverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(d.as_py(), _LIST) for d in batch.column(4)]
            if not lists:
                continue
            rows = np.empty(sum(map(len, lists)), _FLAGGED)
            every = np.concatenate(lists)
            rows["to"], rows["new"] = every["of"], every["new"]
            rows["of"] = np.repeat(batch.column(2).to_numpy(), [len(x) for x in lists])
            yield _batch(list(_packed(rows, n)))

    def ask(here: dict) -> Iterator[tuple]:
        ids, got = here["ids"], here["messages"]
        got = got[np.lexsort((bucket_of(got["of"] ^ got["to"], 1 << 30), got["to"]))]  # reverse ones in random order
        low, high = np.searchsorted(got["to"], ids), np.searchsorted(got["to"], ids, "right")
        asked = []
        for i, node in enumerate(ids.tolist()):
            own, back = np.frombuffer(here["data"][i], _LIST), got[low[i] : high[i]][:REVERSE]
            around, first = np.unique(np.concatenate([own["of"], back["of"]]), return_index=True)
            fresh = np.concatenate([own["new"], back["new"]])[first]
            if not fresh.any():
                continue
            rows = np.empty(len(around), _FLAGGED)
            rows["to"], rows["of"], rows["new"] = around, node, fresh
            asked.append(rows)
        if asked:
            yield from _packed(np.concatenate(asked), n)

    def answer(here: dict) -> Iterator[tuple]:
        ids, got = here["ids"], here["messages"]
        if not len(ids) or not len(got):
            return
        vecs = np.stack([np.frombuffer(v, np.float16) for v in here["vecs"]])
        worst = np.array([_lists(d)[1][-1] if len(d) == _LIST.itemsize * K else -2.0 for d in here["data"]], np.float32)
        for start in range(0, len(got), 50_000):
            part = got[start : start + 50_000]
            at = np.searchsorted(ids, part["to"])
            rows = np.empty(len(part), _member(vecs.shape[1]))
            rows["to"], rows["of"], rows["worst"], rows["new"], rows["vec"] = part["of"], part["to"], worst[at], part["new"], vecs[at]
            yield from _packed(rows, n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [x for batch in batches for x in batch.column(4).to_pylist()]
        if not raw:
            return
        got = np.concatenate([np.frombuffer(x, _member(width)) for x in raw])
        del raw
        got = got[np.argsort(got["to"], kind="stable")]
        out, size = [], 0
        for _, start, stop in _runs(got["to"]):
            members = got[start:stop]
            vec = members["vec"].astype(np.float32)
            sims = vec @ vec.T
            np.fill_diagonal(sims, -3.0)
            unmet = (members["new"][:, None] | members["new"][None, :]) > 0
            a, b = np.nonzero((sims > members["worst"][:, None]) & unmet)
            rows = np.empty(len(a), _SCORED)
            rows["to"], rows["of"], rows["sim"] = members["of"][a], members["of"][b], sims[a, b]
            out.append(rows)
            size += len(rows)
            if size > 2_000_000:
                out = [_sift(np.concatenate(out))]
                size = len(out[0])
        if out:
            yield _batch(list(_packed(_sift(np.concatenate(out)), n)))

    width = len(state.select("vec").first()[0]) // 2
    back = state.mapInArrow(reverse, SCHEMA)
    asked = _meet(state, back, n, ask, "nn-ask", _FLAGGED)
    answers = _meet(state, asked, n, answer, "nn-answer", _FLAGGED)
    updates = written(answers.repartitionById(n, "bucket").mapInArrow(compare, SCHEMA), "nn-updates")
    better = _meet(state, updates, n, _merge, "nn-graph", _SCORED)
    remove(asked, answers, updates)
    return better


def _member(width: int) -> np.dtype:
    return np.dtype([("to", "i8"), ("of", "i8"), ("worst", "f4"), ("new", "u1"), ("vec", "f2", (width,))])


def _sift(rows: np.ndarray) -> np.ndarray:
    """Each pair once, and the K nearest of each node."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["of"], -rows["sim"], rows["to"]))]
    fresh = np.append(True, (rows["to"][1:] != rows["to"][:-1]) | (rows["of"][1:] != rows["of"][:-1]))
    rows = rows[fresh]
    starts = np.flatnonzero(np.append(True, rows["to"][1:] != rows["to"][:-1]))
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[rank < K]


def greedy(graph: DataFrame, exact: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """For each query (rows of SCHEMA, kind 0: id, vec, data unused) the nodes in sight.

    Queries start at the node of their own id.  Each step opens the nearest unopened nodes
    of all queries at once: the graph answers with their neighbours, these with their
    nearness, in double precision on the vectors of ``exact`` (id, vec).  A query is done when
    the WANTED best of its nodes in sight are open; when all but a few are, the walk ends.  Returns rows of SCHEMA with data (of,
    sim, opened), nearest first.
    """
    asking = np.dtype([("to", "i8"), ("of", "i8")])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).to_numpy()
            rows = np.empty(len(ids), asking)
            rows["to"], rows["of"] = ids, ids
            yield _batch(list(_packed(rows, n)))

    def both_ways(here: dict) -> Iterator[tuple]:
        ids, got = here["ids"], here["messages"]
        got = got[np.lexsort((bucket_of(got["of"] ^ got["to"], 1 << 30), got["to"]))]
        low, high = np.searchsorted(got["to"], ids), np.searchsorted(got["to"], ids, "right")
        for i, node in enumerate(ids.tolist()):
            around = np.unique(np.concatenate([_lists(here["data"][i])[0], got["of"][low[i] : high[i]][: 2 * REVERSE]]))
            yield int(bucket_of(np.array([node]), n)[0]), 0, node, here["vecs"][i], around.tobytes()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_lists(d.as_py())[0] for d in batch.column(4)]
            if lists:
                rows = np.empty(sum(map(len, lists)), _EDGE)
                rows["to"], rows["of"] = np.concatenate(lists), np.repeat(batch.column(2).to_numpy(), [len(x) for x in lists])
                yield _batch(list(_packed(rows, n)))

    def neighbours(here: dict) -> Iterator[tuple]:
        ids, got = here["ids"], here["messages"]
        at = np.searchsorted(ids, got["to"]) if len(ids) else np.zeros(0, np.int64)
        lists = [np.frombuffer(here["data"][i], np.int64) for i in at.tolist()]
        if lists:
            rows = np.empty(sum(map(len, lists)), asking)  # to: the query, of: a node to look at
            rows["to"], rows["of"] = np.repeat(got["of"], [len(x) for x in lists]), np.concatenate(lists)
            yield from _packed(rows, n)

    def choose(here: dict) -> Iterator[tuple]:
        """Nodes that a query has not seen; its vector goes to each of their buckets."""
        ids, got = here["ids"], here["messages"]
        got = np.unique(got)
        low, high = np.searchsorted(got["to"], ids), np.searchsorted(got["to"], ids, "right")
        for i, query in enumerate(ids.tolist()):
            seen = np.frombuffer(here["data"][i] or b"", _SEEN)["of"]
            look = got["of"][low[i] : high[i]]
            look = look[~np.isin(look, seen)]
            place = bucket_of(look, n)
            for b in np.unique(place).tolist():
                yield b, 2, query, here["vecs"][i], look[place == b].tobytes()

    def rate(here: dict) -> Iterator[tuple]:
        kinds = np.array(here["kinds"])
        own = np.flatnonzero(kinds == 0)
        ids = here["ids"][own]
        if not len(own):
            return
        vecs = np.stack([np.frombuffer(here["vecs"][i], np.float64) for i in own])
        out = []
        for i in np.flatnonzero(kinds == 2).tolist():
            look = np.frombuffer(here["data"][i], np.int64)
            at = np.searchsorted(ids, look)
            rows = np.empty(len(look), _RATED)
            rows["to"], rows["of"] = here["ids"][i], look
            rows["sim"] = [np.dot(v, q) for q in [np.frombuffer(here["vecs"][i], np.float64)] for v in vecs[at]]
            if len(rows) > SIGHT:
                rows = rows[np.argpartition(-rows["sim"], SIGHT)[:SIGHT]]
            out.append(rows)
        if out:
            yield from _packed(np.concatenate(out), n)

    def look_on(here: dict) -> Iterator[tuple]:
        ids, got = here["ids"], here["messages"]
        got = got[np.argsort(got["to"], kind="stable")]
        low, high = np.searchsorted(got["to"], ids), np.searchsorted(got["to"], ids, "right")
        for i, query in enumerate(ids.tolist()):
            held = np.frombuffer(here["data"][i] or b"", _SEEN)
            new = got[low[i] : high[i]]
            rows = np.zeros(len(held) + len(new), _SEEN)
            rows[: len(held)] = held
            rows["of"][len(held) :], rows["sim"][len(held) :] = new["of"], new["sim"]
            rows = rows[np.lexsort((rows["of"], -rows["sim"]))][:SIGHT]
            yield int(bucket_of(np.array([query]), n)[0]), 0, query, here["vecs"][i], rows.tobytes()

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, data in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                rows = np.frombuffer(data, _SEEN)
                go = rows["of"][:WANTED][rows["opened"][:WANTED] == 0][:OPENED]
                asked = np.empty(len(go), asking)
                asked["to"], asked["of"] = go, query
                out.append(asked)
            if out:
                yield _batch(list(_packed(np.concatenate(out), n)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, k, i, v, data in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                rows = np.frombuffer(data, _SEEN).copy()
                rows["opened"][np.flatnonzero(rows["opened"][:WANTED] == 0)[:OPENED]] = 1
                out.append((b, k, i, v, rows.tobytes()))
            yield _batch(out)

    wide = _meet(graph, graph.mapInArrow(back, SCHEMA), n, both_ways, "nn-wide", _EDGE)
    state, asked = queries, written(queries.mapInArrow(begin, SCHEMA), "nn-asked")
    limit = UNDONE * queries.count() * WANTED * asking.itemsize
    for _ in range(MOST_STEPS):
        lists = _meet(wide, asked, n, neighbours, "nn-lists", asking)
        chosen = _meet(state, lists, n, choose, "nn-chosen", asking)
        rated = written(exact.unionByName(chosen).repartitionById(n, "bucket").mapInArrow(_all_kinds(rate), SCHEMA), "nn-rated")
        new = _meet(state, rated, n, look_on, "nn-sight", _RATED)
        remove(lists, chosen, rated, asked)
        asked, state = written(new.mapInArrow(ahead, SCHEMA), "nn-asked"), new.mapInArrow(mark, SCHEMA)
        if (asked.agg(F.sum(F.length("data"))).first()[0] or 0) <= limit:
            break
    remove(wide, asked)
    return new


_SEEN = np.dtype([("of", "i8"), ("sim", "f8"), ("opened", "u1")])
_RATED = np.dtype([("to", "i8"), ("of", "i8"), ("sim", "f8")])


def _all_kinds(act: Callable[[dict], Iterator[tuple]]) -> Callable:
    """Runs ``act`` over a partition in which nodes (0) and requests with a vector (2) stand side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)]
        rows.sort(key=lambda r: r[2])
        here = {"ids": np.array([r[2] for r in rows], np.int64), "vecs": [r[3] for r in rows], "data": [r[4] for r in rows], "kinds": [r[1] for r in rows]}
        out = list(act(here))
        if out:
            yield _batch(out)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query, which is a row of ``vectors`` named in ``queries`` (``id_col``).

    Returns query_id, rank (from 1), ``id_col``, score: largest inner product first, ties to
    the smaller id, the query's own row left out.  Queries whose vector takes no part have
    no rows; with fewer than k other rows, all that were found are returned.
    """
    narrow = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].alias("vec"))
    held = written(nodes_of(valid_vectors(narrow, "id", "vec"), k + 1), "nn-nodes")
    ids = queries.select(queries[id_col].cast("long").alias("query_id")).where("query_id IS NOT NULL").distinct()
    # which node a query is: rows are matched by their vector, as a node's members are but its smallest
    wanted = narrow.join(ids, narrow["id"] == F.col("query_id"), "left_semi")
    own = valid_vectors(wanted, "id", "vec").select(F.col("id").alias("query_id"), F.col("vec").alias("_vec")).distinct()
    of_node = written(own.join(held.select("node", "vec", "dims"), F.col("_vec") == F.col("vec")).select("query_id", "node", "vec", "dims"), "nn-queries")
    lengths = sorted(r["dims"] for r in of_node.select("dims").distinct().collect())  # lengths of vectors, not rows
    names = f"query_id long, rank int, {id_col} long, score double"
    found = [_among(held.where(F.col("dims") == d), of_node.where(F.col("dims") == d), k) for d in lengths]
    out = reduce(DataFrame.unionByName, found) if found else of_node.where("false").select("query_id", F.lit(0).alias("rank"), F.col("node").alias("id"), F.lit(0.0).alias("score"))
    result = written(out, "nn-found")
    remove(held, of_node, *found)
    return result.toDF(*(c.split()[0] for c in names.split(", ")))


def _among(held: DataFrame, of_node: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among nodes of its length: query_id, rank, id, score."""
    spark = held.sparkSession
    norm = np.sqrt(float(held.agg(F.max(_length_squared("vec"))).first()[0]))
    n_nodes = held.count()
    n = max(spark.sparkContext.defaultParallelism, -(-n_nodes // NODES_OF_BUCKET))

    def placed(halved: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                out = []
                for i, b, v in zip(ids.tolist(), bucket_of(ids, n).tolist(), batch.column(1).to_pylist(), strict=True):
                    if halved:  # one more coordinate makes all equally long
                        x = np.frombuffer(v, np.float64) / norm
                        v = np.append(x, np.sqrt(max(0.0, 1.0 - float(x @ x)))).astype(np.float16).tobytes()
                    out.append((b, 0, i, v, b""))
                yield _batch(out)

        return run

    nodes = written(held.select("node", "vec").mapInArrow(placed(True), SCHEMA), "nn-start")
    graph = build(nodes, n_nodes, n)
    remove(nodes)
    exact = written(held.select("node", "vec").mapInArrow(placed(False), SCHEMA), "nn-exact")
    asking = written(of_node.select("node", "vec").distinct().mapInArrow(placed(False), SCHEMA), "nn-asking")
    seen = greedy(graph, exact, asking, n)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(d, _SEEN) for d in batch.column(4).to_pylist()]
            if lists:
                every = np.concatenate(lists)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(2).to_numpy(), [len(x) for x in lists])), pa.array(every["of"]), pa.array(every["sim"])], names=["asked", "node", "score"])

    near = seen.mapInArrow(best, "asked long, node long, score double").join(held.select("node", "members"), "node")
    place = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    lists = near.select("asked", "score", F.explode("members").alias("id")).withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= k + 1)
    mine = of_node.select("query_id", F.col("node").alias("asked")).join(lists, "asked").where(F.col("id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = mine.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    out = written(ranked, "nn-ranked")
    remove(graph, exact, asking, seen)
    return out


def _length_squared(column: str):
    def run(v: pa.Array) -> pa.Array:
        return pa.array([float(np.dot(x, x)) for x in (np.frombuffer(b, np.float64) for b in v.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(F.col(column))
