"""The engine: indexing a tree and answering batches of queries over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import counters, vectors
from quarrylight.functions import text as T
from quarrylight.operators import budget, changes, context, expand, lexical, neighbours, rank, savings
from quarrylight.sources import repo, shared, snapshot, symbols


class Engine:
    """Holds the tables of an index: files, chunks, postings and edges.

    Every call of :meth:`index` writes a version of them below ``folder`` and reads it back, so
    what was indexed stays what it was when the tree changes, and searches neither parse nor
    count words again.  The version before the last is deleted.

    ``embedder`` maps texts to vectors of length 1 (``model`` names it in snapshots); with it,
    chunks and queries get vectors.  With ``ann_from``, an index of their nearest is kept as soon
    as that many chunks have vectors, and scores beyond its candidates count as 0; without it,
    all are compared.  ``counter`` counts tokens, by default the fallback rule.
    """

    def __init__(
        self, spark: SparkSession, model: str = "", folder: str | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None,
        ann_from: int | None = None, counter: Callable[[str], int] = counters.quarter_length,
    ) -> None:
        self.spark, self.model, self._folder, self.version = spark, model, folder, 0
        self.embedder, self.ann_from, self.counter = embedder, ann_from, counter
        self.near: neighbours.Index | None = None
        self.files: DataFrame | None = None
        self.chunks: DataFrame | None = None
        self.postings: DataFrame | None = None
        self.edges: DataFrame | None = None

    @property
    def folder(self) -> str:
        if self._folder is None:
            self._folder = f"{shared.shared_dir(self.spark)}/engine-{uuid.uuid4().hex}"
        return self._folder

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/v={self.version}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def index(self, root: str) -> DataFrame:
        """Brings the index to the state of a tree; only new and changed files are parsed.  Returns what changed."""
        self.version += 1
        # the tree is read once: all that follows sees the same contents
        seen = self._kept(repo.files(self.spark, root).withColumn("hash", T.content_hash(F.col("content"))), "seen")
        old = self.files if self.files is not None else self.spark.createDataFrame([], "file_path string, hash string, tokens long, updated timestamp")
        found = self._kept(changes.diff(old, seen.select("file_path", "hash")), "changes")
        fresh = changes.changed_only(old, seen)
        parsed = symbols.parsed(fresh.select("file_path", "content"), root, repo.aliases(root))
        made = parsed.where("chunk_id IS NOT NULL").withColumn("ord", F.struct("file_path", "pos"))
        gone = found.where("change = 'unlink'")
        made = made if self.embedder is None else vectors.embedded(made, self.embedder)
        new_files = fresh.select("file_path", "hash", counters.counted(F.col("content"), self.counter).alias("tokens"), F.current_timestamp().alias("updated"))
        chunks = made if self.chunks is None else changes.remove(self.chunks, gone).join(fresh.select("file_path"), "file_path", "left_anti").unionByName(made, allowMissingColumns=True)
        before = self.chunks
        self.files = self._kept(changes.upsert(changes.remove(old, gone), new_files), "files")
        self.chunks = self._kept(chunks, "chunks")
        self._derive()
        self._keep_near(None if before is None else before.join(found.where("change <> 'same'"), "file_path", "left_semi"), found)
        shared.delete(self.spark, f"{self.folder}/v={self.version}/seen")
        shared.delete(self.spark, f"{self.folder}/v={self.version - 2}")
        return found

    def _derive(self) -> None:
        """The tables that follow from the chunks."""
        self.postings = self._kept(lexical.kept(self.chunks), "postings")
        self.edges = self._kept(expand.dependencies(self.chunks), "edges")

    def _embedded(self) -> DataFrame:
        return self.chunks.where("embedding IS NOT NULL").select("chunk_id", "embedding")

    def _keep_near(self, replaced: DataFrame | None = None, found: DataFrame | None = None) -> None:
        """The index of nearest vectors of this version; chunks of unchanged files keep their lists."""
        if self.ann_from is None or "embedding" not in self.chunks.columns or self._embedded().count() < self.ann_from:
            self.near = None
            return
        if self.near is not None and replaced is not None:
            fresh = self.chunks.join(found.where("change IN ('add', 'change')"), "file_path", "left_semi")
            built = neighbours.add(neighbours.remove(self.near, replaced), fresh.where("embedding IS NOT NULL"))
        else:
            built = neighbours.build(self._embedded())
        if built is not None:
            folder = f"{self.folder}/v={self.version}/neighbours"
            neighbours.save(built, folder)
            built = neighbours.load(self.spark, folder)
        self.near = built

    def _asked(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
        """The queries with vectors, and their candidates where an index of nearest vectors is kept."""
        if self.embedder is not None and "query_embedding" not in queries.columns:
            queries = queries.withColumn("query_embedding", vectors.vector(F.col("query"), self.embedder))
        held = self.near is not None and "query_embedding" in queries.columns
        return queries, neighbours.search(self.near, queries, rank.wanted(k)) if held else None

    def _ranked(self, queries: DataFrame, k: int, stem: bool) -> DataFrame:
        """The k best of each query, written once: what follows reads them several times."""
        shared.shared_dir(self.spark)
        queries, near = self._asked(queries, k)
        return rank.rank(self.chunks, queries, k, stem, postings=self.postings, near=near).checkpoint()

    def search(self, queries: DataFrame, k: int = rank.DEFAULT_K, stem: bool = True) -> DataFrame:
        """Ranked chunks of each query, then what its best match depends on: qid, chunk_id, hop, rank."""
        return expand.expanded(self._ranked(queries, k, stem), self.edges)

    def search_within(self, queries: DataFrame, limit: int, stem: bool = True) -> DataFrame:
        """qid, place, chunk_id: as much of the ranked chunks and their dependencies as fits."""
        return budget.pack(self._ranked(queries, budget.MOST_PRIMARY, stem), self.chunks, self.edges, limit, self.counter)

    def context(self, results: DataFrame) -> DataFrame:
        return context.render(results, self.chunks)

    def stats(self) -> DataFrame:
        return savings.index_stats(self.files, self.chunks)

    def save(self, folder: str) -> int:
        version = snapshot.save(self.spark, folder, {"files": self.files, "chunks": self.chunks, "postings": self.postings, "edges": self.edges}, self.model)
        if self.near is not None:
            neighbours.save(self.near, f"{folder}/v={version}/neighbours")
        return version

    def load(self, folder: str) -> bool:
        found = snapshot.load(self.spark, folder, self.model)
        if found is None:
            return False
        self.files, self.chunks, self.postings, self.edges = (found.get(name) for name in ("files", "chunks", "postings", "edges"))
        if self.postings is None or self.edges is None:
            self.version += 1
            self._derive()
        if self.ann_from is not None and "embedding" in self.chunks.columns:
            self.near = neighbours.load(self.spark, f"{folder}/v={snapshot.current(self.spark, folder)}/neighbours", self._embedded().count())
            if self.near is None:
                self.version += 1
                self._keep_near()
        return True
