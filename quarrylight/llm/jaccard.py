"""Exact Jaccard join on word shingles with a token-group matrix.

Documents that are alike are put into groups; the union of a group's tokens is stored once,
as a bitmap of hashed tokens.  A query's bitmap against the union bounds its overlap with
every member; only groups whose bound reaches the threshold are opened, and only then do
token sets travel and get compared member by member.  Which groups a query has to see at
all comes from a prefix filter: documents that reach the threshold share one of the first
few tokens of each, in any fixed order of all tokens.  Here the order puts frequent tokens
last, rarer ones first, by hash among those.

Each text is cut into shingles twice: for its digest, bitmap (two to four bits for each
token) and the counts of tokens, then for its prefix, which needs those counts.  Token sets
are made a third time for opened groups and queries alone.

Copies (equal token sets) are one representative.  What is already known to be connected is
never compared again, so large families of near copies cost about their size, not its
square: pivots of each family connect most of it first, and the prefix filter then looks
for links between different components alone.  No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import graph
from quarrylight.llm._common import memo, original, remove, reserved, small_batches, tidy, written

#: Tokens that the order puts last, at most: a bound on the broadcast, not on what is joined.
FREQUENT = 1 << 17
#: Documents of one part of the corpus that share a token before it counts as frequent.
FREQUENT_FROM = 2
#: Documents of a family that the others are first compared with, about.
PIVOTS = 32
#: Members of a group, tokens of a group, and queries that are compared with it in one task.
GROUP, GROUP_TOKENS, QUERIES = 32, 250_000, 1024
#: Documents whose texts are picked by a broadcast of their ids; beyond, by a shuffle of the texts.
PICKED = 250_000
#: Parts into which the rows of one key are dealt in joins with a table of few rows for each key.
SALTS = 16
#: Prefix tokens that one task sorts.
TOKENS_OF_TASK = 500_000

_U = np.uint64
_MUL, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


class _Words(dict):
    """64-bit hash of each word, kept for the words seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = memo(_Words())


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles: A-Z lower-cased, words apart by ASCII white space.

    A text of fewer words is one shingle, a text without words has none.
    """
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(_words.__getitem__, found), _U, n)
    width = min(words, n)
    out = np.full(n - width + 1, _U(width), _U)
    for i in range(width):
        out = out * _MUL + hashes[i : n - width + 1 + i]
    out ^= out >> _U(30)
    out *= _M1
    out ^= out >> _U(27)
    out *= _M2
    out ^= out >> _U(31)
    return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any set that reaches the threshold."""
    return -(-n * percent // 100)


def prefix(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in the order of all tokens: one more than may be missing."""
    n = len(tokens)
    size = n - least_overlap(n, percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        if late.any():
            last = tokens[late][np.argsort(place[at[late]], kind="stable")]
            return np.concatenate([tokens[~late], last])[:size]
    return tokens[:size]


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bitmap with a bit for each token: a power of two of bits, at least two for each token and 64 in all.

    A token's place is its low bits, so the halves of a bitmap, joined by or, are the bitmap
    of half the size.
    """
    bits = max(64, 1 << max(0, 2 * len(tokens) - 1).bit_length())
    held = np.zeros(bits, bool)
    held[(tokens & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little")


def folded(held: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (the last axis) at a smaller number of bytes."""
    while held.shape[-1] > size:
        half = held.shape[-1] // 2
        held = held[..., :half] | held[..., half:]
    return held


def most_overlap(query: np.ndarray, n: int, unions: np.ndarray) -> np.ndarray:
    """A bound on the tokens that a query of n tokens shares with any set within each union (rows of bitmaps).

    Shared tokens stand at places that both bitmaps hold; at most as many more are shared as
    the query has tokens that fell on an earlier one's place.
    """
    size = min(len(query), unions.shape[-1])
    query = folded(query, size)
    both = np.bitwise_count(folded(unions, size) & query).sum(axis=-1, dtype=np.int64)
    return both + (n - int(np.bitwise_count(query).sum(dtype=np.int64)))


def _digests(texts: DataFrame, words: int) -> DataFrame:
    """A row for each document (id, n, k1, k2, first, sig), and rows for tokens that a part of the corpus repeats (token, count)."""
    schema = pa.schema([(c, pa.int64()) for c in ("id", "n", "k1", "k2", "first")] + [("sig", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        counts = np.zeros(0, _COUNTED)
        seen: set[int] = set()

        def counted(more: np.ndarray) -> np.ndarray:
            token, where = np.unique(more["token"], return_inverse=True)
            out = np.zeros(len(token), _COUNTED)
            out["token"], out["count"] = token, np.bincount(where, weights=more["count"], minlength=len(token))
            return out

        def repeated() -> np.ndarray:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            out = np.zeros(int((times >= FREQUENT_FROM).sum()), _COUNTED)
            out["token"], out["count"] = token[times >= FREQUENT_FROM], times[times >= FREQUENT_FROM]
            held.clear()
            seen.clear()
            return out

        def told(rows: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 5 + [pa.nulls(len(rows), pa.binary()), pa.array(rows["token"].view(np.int64)), pa.array(rows["count"])], schema=schema)

        for batch in batches:
            ns, k1s, k2s, firsts, sigs = [], [], [], [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), words)
                key = xxhash.xxh3_128_intdigest(tokens.tobytes())
                ns.append(len(tokens))
                k1s.append((key >> 64) - (1 << 63))
                k2s.append((key & ((1 << 64) - 1)) - (1 << 63))
                firsts.append(int(tokens[:1].view(np.int64)[0]) if len(tokens) else None)  # the smallest hash: alike sets often share it
                sigs.append(signature(tokens).tobytes() if len(tokens) else None)
                if len(tokens) and key not in seen:  # copies count once
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
                    if size > 1_000_000:
                        counts, size = counted(np.concatenate([counts, repeated()])), 0
                        if len(counts) > 500_000:  # sums go on after the shuffle
                            yield told(counts)
                            counts = counts[:0]
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (ns, k1s, k2s, firsts)), pa.array(sigs, pa.binary()), none, none], schema=schema)
        if held:
            counts = counted(np.concatenate([counts, repeated()]))
        if len(counts):
            yield told(counts)

    return texts.mapInArrow(tidy(run), "id long, n long, k1 long, k2 long, first long, sig binary, token long, count long")


_COUNTED = np.dtype([("token", "u8"), ("count", "i8")])


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and the place of each in the order (rarest first): FREQUENT at most."""
    sums = counted.groupBy("token").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, n = sums["token"].to_numpy().view(_U), sums["n"].to_numpy()
    order = np.argsort(token)
    return token[order], np.argsort(np.lexsort((token[order], n[order])))


def _tokens_of(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and tokens (as bytes) of the documents among ``ids``; only those are cut into shingles again.

    The ids are counted first: up to PICKED of them meet the texts where these lie, more by a shuffle.
    """
    ids = written(ids.select("id").distinct(), "jaccard-picked")
    few = ids.count() <= PICKED
    picked = texts.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "tokens"])

    made = written(picked.mapInArrow(tidy(run), "id long, tokens binary"), "jaccard-tokens")
    remove(ids)
    return made


class _Group:
    """Members of a group as one token-to-member index, and the union of their tokens."""

    def __init__(self, members: list[tuple[int, np.ndarray]]) -> None:
        self.ids = [i for i, _ in members]
        self.sizes = np.array([len(t) for _, t in members])
        tokens = np.concatenate([t for _, t in members])
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        self.owner = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.union, self.first = np.unique(tokens, return_index=True)
        self.after = np.append(self.first[1:], len(tokens))

    def links(self, tokens: np.ndarray, percent: int) -> list[int]:
        """Members that reach the threshold with a query; nothing is compared if the union's bound doesn't."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < least_overlap(len(tokens), percent):
            return []
        start, many = self.first[at], self.after[at] - self.first[at]
        flat = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        shared = np.bincount(self.owner[flat], minlength=len(self.ids))
        return np.flatnonzero(100 * shared >= percent * (self.sizes + len(tokens) - shared)).tolist()


def _opened(rows: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """Edges ``a``, ``b`` between queries and members of their groups.

    ``rows``: grp, part, query (boolean), id, tokens.  Each (grp, part) has the group's members and
    some of its queries; members come first, queries stream past them.
    """
    dealt = rows.select("grp", "part", "query", "id", "tokens").repartition(n_tasks, "grp", "part").sortWithinPartitions("grp", "part", "query", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, group, edges = None, [], None, []
        above: dict[int, int] = {}  # a forest of what is connected within the part

        def root(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            for grp, part, query, doc, tokens in zip(*(batch.column(i) for i in range(5)), strict=True):
                at = (grp.as_py(), part.as_py())
                if at != now:
                    now, members, group = at, [], None
                    above.clear()
                doc, tokens = doc.as_py(), np.frombuffer(tokens.as_py(), _U)
                if not query.as_py():
                    members.append((doc, tokens))
                    continue
                if not members:
                    continue
                if group is None:
                    group = _Group(members)
                for i in group.links(tokens, percent):
                    if (one := root(doc)) != (other := root(group.ids[i])):
                        above[one] = other
                        edges.append((doc, group.ids[i]))
                if len(edges) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])
                    edges = []
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def _parts(queries: DataFrame) -> DataFrame:
    """grp and parts (of about QUERIES) of the groups that need more than one: at most a row for each QUERIES of them."""
    return queries.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).where("parts > 1")


def _salted(rows: DataFrame, few: DataFrame, kept: str) -> DataFrame:
    """Left join of rows (grp, id) with few rows (grp, ``kept``), a hot group's rows dealt to SALTS tasks."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("grp", "_salt", kept)
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["grp", "_salt"], "left").drop("_salt")  # the few rows times SALTS are for no broadcast


def _split(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows grp, part, query, id: a group's queries in parts of about QUERIES, its members with each part."""
    parts = written(_parts(queries), "jaccard-parts")
    of = F.coalesce("parts", F.lit(1))
    split = _salted(queries, parts, "parts").select("grp", F.pmod(F.xxhash64(F.lit(1), "id"), of).cast("int").alias("part"), F.lit(True).alias("query"), "id")
    spread = members.join(parts, "grp", "left").select("grp", F.explode(F.sequence(F.lit(0), of - 1)).alias("part"), F.lit(False).alias("query"), "id")
    return split.unionByName(spread)


def _blocks(members: DataFrame, queries: DataFrame, tokens: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """Edges between the queries (grp, id) and the members (grp, id) of each group."""
    return _opened(_split(members, queries).join(tokens, "id"), percent, n_tasks)


def _pivot_pairs(members: DataFrame, queries: DataFrame, sigs: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """grp (a pivot's id) and id: for each query, of the members of its group that the bitmaps let pass, the first and the likeliest."""
    rows = _split(members, queries).join(sigs.select("id", "n", "sig"), "id").select("grp", "part", "query", "id", "n", "sig")
    dealt = rows.repartition(n_tasks, "grp", "part").sortWithinPartitions("grp", "part", "query", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, stacked = None, [], None
        for batch in batches:
            pivots, asked = [], []
            for grp, part, query, doc, n, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, part) != now:
                    now, members, stacked = (grp, part), [], None
                sig = np.frombuffer(sig, np.uint8)
                if not query:
                    members.append((doc, n, sig))
                    continue
                if stacked is None:  # members by the length of their bitmaps
                    stacked = [(np.array([m[0] for m in some]), np.array([m[1] for m in some]), np.stack([m[2] for m in some])) for size in {len(m[2]) for m in members} if (some := [m for m in members if len(m[2]) == size])]
                passed = []
                for ids, sizes, held in stacked:
                    most = np.minimum(most_overlap(sig, n, held), np.minimum(sizes, n))
                    fits = np.flatnonzero((100 * most >= percent * (sizes + n - most)) & (ids != doc))
                    passed += [(int(ids[i]), most[i] / (sizes[i] + n - most[i])) for i in fits]
                for pivot in {min(passed)[0], max(passed, key=lambda x: (x[1], -x[0]))[0]} if passed else ():
                    pivots.append(pivot)
                    asked.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(asked, pa.int64())], names=["grp", "id"])

    return dealt.mapInArrow(tidy(run), "grp long, id long").distinct()


def _unions(in_groups: DataFrame, sigs: DataFrame, n_tasks: int) -> DataFrame:
    """grp, least (tokens of its smallest member) and the bitmap of the union of all members' tokens."""
    rows = in_groups.join(sigs.select("id", "n", "bits", "sig"), ["id", "n", "bits"]).select("grp", "n", "sig")
    dealt = rows.repartition(n_tasks, "grp").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, union, out = None, 0, None, []

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["grp", "least", "held"])
            out.clear()
            return batch

        for batch in batches:
            for grp, n, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sig = np.frombuffer(sig, np.uint8)
                if grp == now:
                    size = min(len(union), len(sig))
                    least, union = min(least, n), folded(union, size) | folded(sig, size)
                else:
                    if now is not None:
                        out.append((now, least, union.tobytes()))
                    now, least, union = grp, n, sig
            if len(out) > 1_000:
                yield told()
        if now is not None:
            out.append((now, least, union.tobytes()))
            yield told()

    return dealt.mapInArrow(tidy(run), "grp long, least long, held binary")


def _qualifying(asked: DataFrame, unions: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The (grp, id) of ``asked`` in which the group's union may hold enough of the query's tokens."""

    def may(n: pa.Array, sig: pa.Array, least: pa.Array, held: pa.Array) -> pa.Array:
        out = []
        for size, query, smallest, union in zip(n.to_pylist(), sig.to_pylist(), least.to_pylist(), held.to_pylist(), strict=True):
            most = int(most_overlap(np.frombuffer(query, np.uint8), size, np.frombuffer(union, np.uint8)))
            out.append(most >= max(least_overlap(size, percent), -(-percent * (size + smallest) // (100 + percent))))
        return pa.array(out, pa.bool_())

    met = asked.join(unions, "grp").join(sigs.select("id", "n", "sig"), "id")
    return met.where(F.arrow_udf(may, "boolean")("n", "sig", "least", "held")).select("grp", "id").distinct()


def _prefixes(texts: DataFrame, frequent, words: int, percent: int) -> DataFrame:
    """id, n and prefix tokens (as bytes) of each document with words."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, out = [], []
            for t in batch.column(1):
                tokens = shingles(t.as_py(), words)
                ns.append(len(tokens))
                out.append((prefix(tokens, *shared.value, percent) if len(tokens) else tokens).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(out, pa.binary())], names=["id", "n", "prefix"])

    return texts.where("id IS NOT NULL").mapInArrow(tidy(cut), "id long, n int, prefix binary").where("n > 0")


_MET = np.dtype([("token", "u8"), ("component", "i8"), ("id", "i8"), ("n", "i4"), ("at", "i4")])
#: Bytes of a token, beyond the bits that name its bucket, that go along: equal ones make candidates, token sets decide.
_TOKEN_BYTES = 5


def _planes(column: np.ndarray, width: int) -> bytes:
    """The low bytes of a column, plane by plane, so that bytes that hardly change stand together and compress."""
    return np.ascontiguousarray(column.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _pack(rows: np.ndarray, bits: int) -> bytes:
    """Records of one bucket: tokens cut to their telling bits, ids as steps, components as distances from ids."""
    token = (rows["token"] << _U(bits)) >> _U(64 - 8 * _TOKEN_BYTES)
    steps = np.diff(rows["id"], prepend=0)
    return b"".join([_planes(token.view(np.int64), _TOKEN_BYTES), _planes(steps, 8), _planes(rows["component"] - rows["id"], 8), _planes(rows["n"], 4), _planes(rows["at"], 4)])


def _unpack(data: bytes) -> np.ndarray:
    widths = (_TOKEN_BYTES, 8, 8, 4, 4)
    n, at, columns = len(data) // sum(widths), 0, []
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        columns.append(wide.view("<i8").ravel())
        at += n * width
    out = np.empty(n, _MET)
    out["token"], out["id"], out["n"], out["at"] = columns[0], np.cumsum(columns[1]), columns[3], columns[4]
    out["component"] = out["id"] + columns[2]
    return out


_PAIR = np.dtype([("id", "i8"), ("target", "i8")])


def _pairs(ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), _PAIR)
    out["id"], out["target"] = ids, targets
    return out


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs["id"]), pa.array(pairs["target"])], names=["id", "target"])


def _may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets that have met at a token of their prefixes can reach the threshold, were it their first.

    Both orders agree, so what they share lies at or behind the places of their first common
    token.  Too different sizes fail this too.
    """
    n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
    least = -(-percent * (n + m) // (100 + percent))
    return np.minimum(n - a["at"], m - b["at"]) >= least


def _asked(here: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Queries and target components among the documents that share one token.

    Components stand by falling number of documents here; each asks those before it that
    have a document that may link.
    """
    names, where, sizes = np.unique(here["component"], return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -sizes))] = np.arange(len(names))
    place = rank[where]
    order = np.argsort(place, kind="stable")
    here, place = here[order], place[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    targets = here["component"][first]
    block = max(1, 2_000_000 // len(here))
    for start in range(int(first[1]), len(here), block):  # the largest asks nobody
        q = slice(start, start + block)
        fits = _may_link(here[q][:, None], here[None, :], percent)
        by_target = np.logical_or.reduceat(fits, first, axis=1) & (place[q, None] > np.arange(len(names)))
        asking, asked = np.nonzero(by_target)
        yield _pairs(here["id"][q][asking], targets[asked])


def _candidates(prefixes: DataFrame, reps: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """Pairs (id, target): a query and a component, other than its own, with a member that shares a prefix token.

    ``reps``: id and component.  Of two components that share a token, the one with fewer
    documents there gives the queries.
    """
    bits = max(0, (n_tasks - 1).bit_length())
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):  # records take more room than prefixes
            tokens = [np.frombuffer(p, _U) for p in batch.column(2).to_pylist()]
            many = np.array([len(t) for t in tokens])
            rows = np.empty(int(many.sum()), _MET)
            if not len(rows):
                continue
            rows["token"] = np.concatenate(tokens)
            for name, i in (("id", 0), ("n", 1), ("component", 3)):
                rows[name] = np.repeat(batch.column(i).to_numpy(zero_copy_only=False), many)
            rows["at"] = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            place = (rows["token"] >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(rows), np.int32)
            order = np.argsort(place, kind="stable")
            rows, place = rows[order], place[order]
            at, first = np.unique(place, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([_pack(x, bits) for x in np.split(rows, first[1:])], pa.binary())], names=["bucket", "rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x.as_py()) for batch in batches for x in batch.column(1)]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.argsort(rows["token"], kind="stable")]
        starts = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
        stops = np.append(starts[1:], len(rows))
        # tokens that stand in one component alone can't show a new link
        low, high = np.minimum.reduceat(rows["component"], starts), np.maximum.reduceat(rows["component"], starts)
        live, many = low != high, stops - starts
        twos = starts[live & (many == 2)]  # most lists: one query, one target
        one, two = rows[twos], rows[twos + 1]
        fits = _may_link(one, two, percent)
        held = [_pairs(two["id"][fits], one["component"][fits])]
        size = len(held[0])
        for start, stop in zip(starts[live & (many > 2)].tolist(), stops[live & (many > 2)].tolist(), strict=True):
            for part in _asked(rows[start:stop], percent):
                held.append(part)
                size += len(part)
                if size > 500_000:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > 250_000:
                        yield _pair_batch(held[0])
                        held, size = [], 0
        if size:
            yield _pair_batch(np.unique(np.concatenate(held)))

    known = prefixes.join(reps.select("id", "component"), "id").select("id", "n", "prefix", "component")
    dealt = known.mapInArrow(tidy(deal), "bucket int, rows binary").repartitionById(1 << bits, "bucket")
    return dealt.mapInArrow(tidy(meet), "id long, target long").distinct()


def classes(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its class: id, n_shingles, component_id.

    Two documents link when their sets of distinct ``words``-word shingles have a Jaccard
    similarity of ``percent`` or more; ``component_id`` is the smallest id reachable by
    links.  Texts of fewer words are one shingle; null texts and texts without words have
    none and are alone.  Rows with equal ids are parts of one document, linked to each other;
    rows without an id keep their n_shingles and have no component.  All documents and
    whole texts take part.  Other columns, whatever their names, are not looked at.
    """
    small_batches(docs.sparkSession)
    texts = _text(docs, id_col, text_col)
    digests = written(_digests(texts, words), "jaccard-digests")
    rows = digests.where("n IS NOT NULL").select("id", "n", "k1", "k2")
    frequent = _frequent(digests.where("token IS NOT NULL"))
    full = digests.where("n > 0 AND id IS NOT NULL").withColumn("bits", F.length("sig"))
    reps = written(full.groupBy("k1", "k2", "n").agg(F.min_by(F.struct("id", "bits", "first", "sig"), "id").alias("r")).select("r.id", "n", "r.bits", "r.first", "k1", "k2", "r.sig"), "jaccard-reps")
    total = reps.agg(F.sum("n")).first()[0] or 0
    n_tasks = max(min(1 << 20, int(total * (100 - percent) / 100 / TOKENS_OF_TASK) + 1), int(docs.sparkSession.sparkContext.defaultParallelism))

    # first the families: documents with the same smallest token, each compared with some pivots
    firsts = reps.select(F.col("first").alias("grp"), "id").distinct()
    family = written(firsts.groupBy("grp").agg(F.count("*").alias("many")).where("many > 1"), "jaccard-families")
    queries = written(_salted(firsts, family, "many").where("many IS NOT NULL"), "jaccard-firsts")
    members = queries.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 33) * F.col("many") < F.lit(PIVOTS * (1 << 31))).select("grp", "id")
    pairs = written(_pivot_pairs(members, queries.select("grp", "id"), reps, percent, n_tasks), "jaccard-pairs")
    tokens = _tokens_of(texts, pairs.select("id").union(pairs.select("grp")), words)
    near = graph.components(written(_blocks(pairs.select("grp", F.col("grp").alias("id")).distinct(), pairs, tokens, percent, n_tasks), "jaccard-near"))
    remove(tokens, pairs, queries, family)

    # then what is left: queries against the groups of other components that share a prefix token
    first_round = reps.join(near.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "bits", F.coalesce("component", "id").alias("component")).distinct()
    known = written(first_round, "jaccard-known")
    prefixes = _prefixes(texts, frequent, words, percent)
    wanted = written(_candidates(prefixes, known.select("id", "component").distinct(), percent, n_tasks), "jaccard-candidates")
    # members of a group have bitmaps of one length; a query only asks groups of its own and of the next lengths
    sizes = known.groupBy("component", "bits").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).cast("int").alias("groups"))
    opened = written(wanted.select("target").distinct().join(sizes, F.col("target") == F.col("component")).select("component", "bits", "groups"), "jaccard-opened")
    name = lambda at: F.xxhash64("component", "bits", at.cast("int"))
    in_groups = written(known.join(opened, ["component", "bits"]).select(name(F.pmod(F.xxhash64("id"), F.col("groups"))).alias("grp"), "id", "n", "bits"), "jaccard-groups")
    unions = written(_unions(in_groups, reps, n_tasks), "jaccard-unions")
    sized = wanted.join(known.select("id", F.col("bits").alias("_own")).distinct(), "id")
    fits = (F.col("target") == F.col("component")) & (F.col("bits") * percent < F.col("_own") * 200) & (F.col("_own") * percent < F.col("bits") * 200)
    asked = sized.join(opened, fits).select("id", "component", "bits", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("at")).select(name(F.col("at")).alias("grp"), "id")
    open_ = written(_qualifying(asked, unions, reps, percent), "jaccard-qualifying")
    members = in_groups.select("grp", "id").distinct().join(open_.select("grp").distinct(), "grp", "left_semi")
    tokens = _tokens_of(texts, members.select("id").union(open_.select("id")), words)
    links = written(_blocks(members, open_, tokens, percent, n_tasks), "jaccard-links")
    # sets of rows that have one id are linked too
    several = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).where("low <> high")
    keys = ["k1", "k2", "n"]
    own = rows.join(several.select("id"), "id", "left_semi").join(reps.select(F.col("id").alias("rep"), *keys), keys).select("id", "rep")
    final = graph.components(links.union(known.where("id <> component").select("id", "component")).union(own))

    classed = reps.join(final.withColumnRenamed("node", "id"), "id", "left").select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce("component", "id").alias("component"))
    result = rows.join(classed, F.expr("k1 = _k1 AND k2 = _k2 AND n = _n"), "left")
    smallest = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    placed = written(result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), smallest.alias("component_id")), "jaccard-classes")
    remove(digests, reps, near, known, wanted, opened, in_groups, unions, open_, tokens, links, final)
    return placed


def representatives(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document kept of each class: that with the smallest id.

    Rows without an id and texts without words stay, as they link with nothing.  Of repeated
    rows with the kept id, one with words stays.  What is marked is what goes or repeats, mostly
    the fewer: up to PICKED ids meet the texts where these lie, more by a shuffle.
    """
    found = classes(docs, percent, words, id_col, text_col).where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    goes = F.max(F.col(id_col) != F.col("component_id")).alias("_goes")
    marks = found.groupBy(F.col(id_col).alias("_marked")).agg(goes, F.count("*").alias("_times")).where("_goes OR _times > 1")
    marks = written(marks, "jaccard-marks")
    remove(found)
    named, held = reserved(docs)
    marked = named.join(F.broadcast(marks) if marks.count() <= PICKED else marks.hint("merge"), F.col(held[id_col]).cast("long") == F.col("_marked"), "left")
    # a text with words; others link with nothing
    counts = F.col("_marked").isNotNull() & F.coalesce(F.col(held[text_col]).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    single = marked.where(~counts)
    repeated = marked.where(counts & ~F.col("_goes")).dropDuplicates(["_marked"])
    return original(single.unionByName(repeated).drop("_marked", "_goes", "_times"), docs)
