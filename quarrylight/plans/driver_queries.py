"""Queries over the driver tables, each with its SQL twin where SQL can express it.

A document stands for a chunk of code: its source is the file, ``doc_<id>`` the symbol, its
id the place in the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import answers, porter, vectors
from quarrylight.operators import budget, changes, context, expand, lexical, neighbours, rank, savings
from quarrylight.sources import filters, requests, samples, shared, snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The batch of queries: id, text, and the vector whose neighbours it also asks for.
BATCH = [
    (1, "thing whre onstwh the", 7),
    (2, "loser worthless idiot", 12),
    (3, "released license mit", 33),
    (4, "doc_42", 5),
    (5, "mail example com mail", 101),
    (6, "und der auf", 250),
    (7, "la queux retion de", 77),
]
K = 5


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 10 == 0, "file").when(F.col("doc_id") % 50 == 3, "module").otherwise("function")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"), F.concat(F.lit("doc_"), "doc_id").alias("symbol_name"), kind.alias("kind"),
        F.col("text").alias("code"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + 9).alias("end_line"), F.col("doc_id").alias("ord"),
    )


def batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, t) for q, t, _ in BATCH], "qid int, query string")


def batch_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(q, t, v) for q, t, v in BATCH], "qid int, query string, vec_id long")
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query_embedding"))
    return ids.join(vectors, "vec_id", "left").drop("vec_id")


# --- SQL that several twins share -------------------------------------------------------

_CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, source AS file_path, 'doc_' || doc_id AS symbol_name,
  CASE WHEN doc_id % 10 = 0 THEN 'file' WHEN doc_id % 50 = 3 THEN 'module' ELSE 'function' END AS kind,
  text AS code, doc_id AS start_line, doc_id + 9 AS end_line, doc_id AS ord FROM documents)"""
_BATCH = "batch(qid, query, vec_id) AS (VALUES " + ", ".join(f"({q}, '{t}', {v})" for q, t, v in BATCH) + ")"


def _tokens_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_GATE = rf"list_filter(string_split_regex(lower(query), '\W+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"
_INDEX = f"""{_CHUNKS}, {_BATCH},
  toks AS (SELECT chunk_id, {_tokens_sql("concat_ws(' ', symbol_name, code)")} AS tokens FROM chunks),
  tf AS (SELECT chunk_id, term, count(*) AS f FROM (SELECT chunk_id, unnest(tokens) AS term FROM toks) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  lens AS (SELECT chunk_id, len(tokens) AS len FROM toks),
  totals AS (SELECT count(*) AS n, coalesce(avg(len), 1) AS avgdl FROM lens)"""
_SCORED = """qt AS (SELECT qid, term, count(*) AS qf FROM asked GROUP BY ALL),
  gt AS (SELECT qid, term, count(*) AS times FROM gated GROUP BY ALL),
  scores AS (SELECT qid, chunk_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avgdl)))) AS bm25
    FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN lens USING (chunk_id) CROSS JOIN totals GROUP BY ALL),
  lex AS (SELECT qid, s.chunk_id, bm25, CASE WHEN max(bm25) OVER (PARTITION BY qid) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY qid) ELSE 0 END
    * CASE WHEN kind = 'file' THEN 0.3 ELSE 1.0 END AS lexical FROM scores s JOIN chunks c ON s.chunk_id = c.chunk_id),
  matched AS (SELECT qid, chunk_id, CAST(sum(times) AS BIGINT) AS matched FROM tf JOIN gt USING (term) GROUP BY ALL),
  named AS (SELECT qid, chunk_id FROM chunks JOIN batch ON trim(query) <> '' AND contains(lower(symbol_name), lower(trim(query)))),
  found AS (SELECT qid, chunk_id, lexical, matched, n.chunk_id IS NOT NULL AS name_hit FROM
    (SELECT coalesce(l.qid, m.qid) AS qid, coalesce(l.chunk_id, m.chunk_id) AS chunk_id, coalesce(lexical, 0) AS lexical, coalesce(matched, 0) AS matched
     FROM lex l FULL JOIN matched m ON l.qid = m.qid AND l.chunk_id = m.chunk_id) FULL JOIN named n USING (qid, chunk_id))"""
_TERMS = f"asked AS (SELECT qid, unnest({_tokens_sql('query')}) AS term FROM batch), gated AS (SELECT qid, unnest({_GATE}) AS term FROM batch)"
_SCORES = f"{_INDEX}, {_TERMS}, {_SCORED}"
_PASSED = f"""{_SCORES}, passed AS (SELECT qid, chunk_id, 0.0::DOUBLE AS semantic, coalesce(lexical, 0) AS lexical, coalesce(matched, 0) AS matched, name_hit,
  round(0.2 * coalesce(lexical, 0), 6) AS score FROM found WHERE name_hit OR coalesce(matched, 0) >= 2)"""
_RANKED = f"""{_PASSED}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM passed QUALIFY rank <= {K})"""


def _stems_sql(words: str) -> str:
    """CTEs up to ``stems(word, stem)`` of the distinct words of a relation ``words``: Porter's rules over letters marked by kind.

    A y that is a consonant is written Y, so [aeiouy] are the vowels; a measure above 0 is a vowel
    and a consonant, above 1 the same twice.
    """
    cut = lambda n, x="s": f"left({x}, length({x}) - {n})"
    above = lambda n, x: f"regexp_matches({x}, '[aeiouy][^aeiouy]{'+[aeiouy]+[^aeiouy]' * n}')"
    short = lambda x: f"regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$')"
    vowel = lambda x: f"regexp_matches({x}, '[aeiouy]')"
    head = "left(s, length(s) - length(x))"
    return rf"""marked AS (SELECT word, regexp_replace(regexp_replace(word, '(^|[aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g') AS s FROM ({words})),
  plural AS (SELECT word, CASE WHEN regexp_matches(s, '(sses|ies)$') THEN {cut(2)} WHEN regexp_matches(s, '(^|[^s])s$') THEN {cut(1)} ELSE s END AS s FROM marked),
  past AS (SELECT word, s LIKE '%eed' AS kept, NOT s LIKE '%eed' AND (s LIKE '%ed' AND {vowel(cut(2))} OR s LIKE '%ing' AND {vowel(cut(3))}) AS off, s FROM plural),
  bare AS (SELECT word, off, CASE WHEN kept AND {above(0, cut(3))} THEN {cut(1)} WHEN off AND s LIKE '%ed' THEN {cut(2)} WHEN off THEN {cut(3)} ELSE s END AS s FROM past),
  mended AS (SELECT word, CASE WHEN NOT off THEN s WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e'
      WHEN length(s) > 1 AND regexp_matches(s, '[^aeiouylsz]$') AND lower(right(s, 1)) = lower(left(right(s, 2), 1)) THEN {cut(1)}
      WHEN {above(0, "s")} AND NOT {above(1, "s")} AND {short("s")} THEN s || 'e' ELSE s END AS s FROM bare),
  ending AS (SELECT word, CASE WHEN regexp_matches(s, '[yY]$') AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE s END AS s FROM mended),
  two AS (SELECT word, s, list_filter(['ational', 'ization', 'iveness', 'fulness', 'ousness', 'tional', 'biliti', 'entli', 'ousli', 'ation', 'alism', 'aliti', 'iviti', 'enci', 'anci', 'izer', 'abli', 'alli', 'ator', 'eli'], lambda e: ends_with(s, e))[1] AS x FROM ending),
  second AS (SELECT word, CASE WHEN x IS NOT NULL AND {above(0, head)} THEN {head} || MAP {{'ational': 'ate', 'tional': 'tion', 'enci': 'ence', 'anci': 'ance', 'izer': 'ize', 'abli': 'able', 'alli': 'al', 'entli': 'ent', 'eli': 'e', 'ousli': 'ous', 'ization': 'ize', 'ation': 'ate', 'ator': 'ate', 'alism': 'al', 'iveness': 'ive', 'fulness': 'ful', 'ousness': 'ous', 'aliti': 'al', 'iviti': 'ive', 'biliti': 'ble'}}[x] ELSE s END AS s FROM two),
  three AS (SELECT word, s, list_filter(['icate', 'ative', 'alize', 'iciti', 'ical', 'ness', 'ful'], lambda e: ends_with(s, e))[1] AS x FROM second),
  third AS (SELECT word, CASE WHEN x IS NOT NULL AND {above(0, head)} THEN {head} || MAP {{'icate': 'ic', 'ative': '', 'alize': 'al', 'iciti': 'ic', 'ical': 'ic', 'ful': '', 'ness': ''}}[x] ELSE s END AS s FROM three),
  four AS (SELECT word, s, list_filter(['ement', 'ance', 'ence', 'able', 'ible', 'ment', 'ant', 'ent', 'ion', 'ism', 'ate', 'iti', 'ous', 'ive', 'ize', 'al', 'er', 'ic', 'ou'], lambda e: ends_with(s, e))[1] AS x FROM third),
  fourth AS (SELECT word, CASE WHEN x IS NOT NULL AND {above(1, head)} AND (x <> 'ion' OR regexp_matches({head}, '[st]$')) THEN {head} ELSE s END AS s FROM four),
  fifth AS (SELECT word, CASE WHEN s LIKE '%e' AND ({above(1, cut(1))} OR {above(0, cut(1))} AND NOT {short(cut(1))}) THEN {cut(1)} ELSE s END AS s FROM fourth),
  stems AS (SELECT word, CASE WHEN length(word) < 3 OR NOT regexp_matches(word, '^[\x00-\x7F]*$') THEN word WHEN s LIKE '%ll' AND {above(1, "s")} THEN lower({cut(1)}) ELSE lower(s) END AS stem FROM fifth)"""


# --- index and lexical ranking ----------------------------------------------------------


@_query(f"WITH {_INDEX} SELECT chunk_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM toks")
def tokenize(spark, sf_dir):
    return lexical.chunk_tokens(documents_as_chunks(spark, sf_dir)).select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


@_query(f"WITH {_INDEX} SELECT chunk_id, term, f FROM tf")
def term_freq(spark, sf_dir):
    return lexical.term_frequency(documents_as_chunks(spark, sf_dir))


@_query(f"WITH {_INDEX} SELECT term, df FROM df")
def doc_freq(spark, sf_dir):
    return lexical.document_frequency(lexical.term_frequency(documents_as_chunks(spark, sf_dir)))


@_query(f"WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM totals")
def doc_len_stats(spark, sf_dir):
    return lexical.totals(lexical.lengths(documents_as_chunks(spark, sf_dir))).select("n", F.round("avgdl", 6).alias("avgdl"))


@_query(f"WITH {_SCORES} SELECT qid, chunk_id, round(bm25, 6) AS bm25 FROM scores")
def bm25_score(spark, sf_dir):
    return lexical.bm25(lexical.hits(lexical.postings(documents_as_chunks(spark, sf_dir)), batch(spark)), batch(spark)).select("qid", "chunk_id", F.round("bm25", 6).alias("bm25"))


@_query(f"WITH {_SCORES} SELECT qid, chunk_id, round(lexical, 6) AS lexical FROM lex")
def bm25_normalized(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    return lexical.normalised(lexical.bm25(lexical.hits(lexical.postings(chunks), batch(spark)), batch(spark)), chunks).select("qid", "chunk_id", F.round("lexical", 6).alias("lexical"))


@_query(f"WITH {_BATCH} SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_GATE}) AS term FROM batch) GROUP BY ALL")
def query_terms(spark, sf_dir):
    return lexical.query_gate_terms(batch(spark))


@_query(f"WITH {_PASSED} SELECT qid, chunk_id, matched, name_hit FROM passed")
def relevance_gate(spark, sf_dir):
    return rank.scored(documents_as_chunks(spark, sf_dir), batch(spark)).select("qid", "chunk_id", "matched", "name_hit")


@_query(f"WITH {_RANKED} SELECT rank, chunk_id, score FROM ranked WHERE qid = 3")
def rank_lexical_topk(spark, sf_dir):
    return rank.rank(documents_as_chunks(spark, sf_dir), batch(spark).where("qid = 3"), K).select("rank", "chunk_id", "score")


@_query(f"WITH {_RANKED} SELECT qid, rank, chunk_id, score FROM ranked")
def rank_batch_queries(spark, sf_dir):
    return rank.rank(documents_as_chunks(spark, sf_dir), batch(spark), K).select("qid", "rank", "chunk_id", "score")


_STEMMED = f"""{_CHUNKS}, {_BATCH},
  toks AS (SELECT chunk_id, {_tokens_sql("concat_ws(' ', symbol_name, code)")} AS tokens FROM chunks),
  plain AS (SELECT chunk_id, unnest(tokens) AS word FROM toks), {_TERMS.replace("asked AS", "asked_words AS").replace("gated AS", "gated_words AS")},
  {_stems_sql("SELECT word FROM plain UNION SELECT term FROM asked_words UNION SELECT term FROM gated_words")},
  tf AS (SELECT chunk_id, stem AS term, count(*) AS f FROM plain JOIN stems USING (word) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  lens AS (SELECT chunk_id, len(tokens) AS len FROM toks),
  totals AS (SELECT count(*) AS n, coalesce(avg(len), 1) AS avgdl FROM lens),
  asked AS (SELECT qid, stem AS term FROM asked_words JOIN stems ON term = word), gated AS (SELECT qid, stem AS term FROM gated_words JOIN stems ON term = word), {_SCORED}"""


@_query(f"WITH {_CHUNKS}, {_stems_sql('SELECT DISTINCT unnest(' + _tokens_sql('code') + ') AS word FROM chunks')} SELECT word, stem AS term FROM stems")
def porter_stems(spark, sf_dir):
    words = documents_as_chunks(spark, sf_dir).select(F.explode(T.tokens(F.col("code"))).alias("term")).distinct()
    return porter.stems(words)


@_query(f"WITH {_PASSED.replace(_SCORES, _STEMMED)} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM passed QUALIFY rank <= {K}")
def stemmed_rank(spark, sf_dir):
    return rank.rank(documents_as_chunks(spark, sf_dir), batch(spark), K, stem=True).select("qid", "rank", "chunk_id", "score")


# --- vectors and hybrid ranking ---------------------------------------------------------

_COSINE = f"""{_BATCH}, sims AS (SELECT qid, e.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS semantic
  FROM embeddings e CROSS JOIN (SELECT qid, embedding FROM batch JOIN embeddings USING (vec_id)) q)"""


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@_query(f"WITH {_COSINE} SELECT qid, chunk_id, round(semantic, 6) AS semantic FROM sims")
def cosine_scores(spark, sf_dir):
    return rank.cosine(_vectors(spark, sf_dir), batch_with_vectors(spark, sf_dir)).select("qid", "chunk_id", F.round("semantic", 6).alias("semantic"))


@_query(f"WITH {_COSINE} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(semantic, 6) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(semantic, 6) AS semantic FROM sims QUALIFY rank <= {K}")
def semantic_topk(spark, sf_dir):
    scores = cosine_scores(spark, sf_dir)
    place = Window.partitionBy("qid").orderBy(F.desc("semantic"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= K).select("qid", "rank", "chunk_id", "semantic")


@_query(f"WITH {_COSINE} SELECT qid, chunk_id, round(semantic, 6) AS semantic FROM sims QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(semantic, 6) DESC, chunk_id) <= 50")
def ann_candidates_exact(spark, sf_dir):
    return rank.candidates(cosine_scores(spark, sf_dir), K)


@_query(
    f"""WITH {_SCORES}, sims AS (SELECT qid, c.chunk_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS semantic
  FROM chunks c JOIN embeddings e ON e.vec_id = c.chunk_id CROSS JOIN (SELECT qid, embedding FROM batch JOIN embeddings USING (vec_id)) q),
  every AS (SELECT coalesce(f.qid, s.qid) AS qid, coalesce(f.chunk_id, s.chunk_id) AS chunk_id, coalesce(lexical, 0) AS lexical, coalesce(matched, 0) AS matched,
    coalesce(name_hit, FALSE) AS name_hit, coalesce(semantic, 0) AS semantic FROM found f FULL JOIN sims s ON f.qid = s.qid AND f.chunk_id = s.chunk_id)
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(semantic + 0.2 * lexical, 6) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(semantic + 0.2 * lexical, 6) AS score
  FROM every WHERE name_hit OR matched >= 2 OR semantic >= 0.3 QUALIFY rank <= {K}"""
)
def hybrid_rank(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir).join(_vectors(spark, sf_dir), "chunk_id", "left")
    return rank.rank(chunks, batch_with_vectors(spark, sf_dir), K, nearest_only=False).select("qid", "rank", "chunk_id", "score")


def _index(spark, sf_dir):
    """An index that was built on some vectors, was given the rest and some again, and lost others."""
    every = _vectors(spark, sf_dir)
    built = neighbours.build(every.where("chunk_id % 3 <> 1"))
    return neighbours.remove(neighbours.add(built, every.where("chunk_id % 3 = 1 OR chunk_id % 10 = 0")), every.where("chunk_id % 11 = 4"))


_WANTED = rank.wanted(K)


@_query(f"WITH {_COSINE} SELECT qid, chunk_id, round(semantic, 6) AS semantic FROM sims WHERE chunk_id % 11 <> 4 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, chunk_id) <= {_WANTED}")
def ann_index_search(spark, sf_dir):
    asked = batch_with_vectors(spark, sf_dir)
    # every list is opened, as the twin compares all
    return neighbours.search(_index(spark, sf_dir), asked, _WANTED, 1.0).select("qid", "chunk_id", F.round("semantic", 6).alias("semantic"))


@_query(
    f"""WITH {_SCORES}, sims AS (SELECT qid, e.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS semantic
  FROM embeddings e CROSS JOIN (SELECT qid, embedding FROM batch JOIN embeddings USING (vec_id)) q WHERE e.vec_id % 11 <> 4),
  near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY qid ORDER BY semantic DESC, chunk_id) <= {_WANTED}),
  every AS (SELECT coalesce(f.qid, s.qid) AS qid, coalesce(f.chunk_id, s.chunk_id) AS chunk_id, coalesce(lexical, 0) AS lexical, coalesce(matched, 0) AS matched,
    coalesce(name_hit, FALSE) AS name_hit, coalesce(semantic, 0) AS semantic FROM found f FULL JOIN near s ON f.qid = s.qid AND f.chunk_id = s.chunk_id)
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(semantic + 0.2 * lexical, 6) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(semantic + 0.2 * lexical, 6) AS score
  FROM every JOIN chunks USING (chunk_id) WHERE name_hit OR matched >= 2 OR semantic >= 0.3 QUALIFY rank <= {K}"""
)
def ann_rank(spark, sf_dir):
    asked = batch_with_vectors(spark, sf_dir)
    near = neighbours.search(_index(spark, sf_dir), asked, _WANTED, 1.0)
    return rank.rank(documents_as_chunks(spark, sf_dir), asked, K, near=near).select("qid", "rank", "chunk_id", "score")


@_query(f"WITH {_COSINE} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(semantic, 6) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(semantic, 6) AS score FROM sims JOIN documents ON doc_id = chunk_id WHERE semantic >= 0.3 QUALIFY rank <= {K}")
def search_by_vector(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir).join(_vectors(spark, sf_dir), "chunk_id", "left")
    return rank.rank(chunks, batch_with_vectors(spark, sf_dir).withColumn("query", F.lit("")), K).select("qid", "rank", "chunk_id", "score")


@_query("SELECT vec_id, CAST(4 * ceil(4 * len(embedding) / 3.0) AS INTEGER) AS text_length, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last FROM embeddings")
def embedding_text(spark, sf_dir):
    held = _table(spark, sf_dir, "embeddings").select("vec_id", vectors.to_text(F.col("embedding")).alias("text"))
    back = held.select("vec_id", F.length("text").alias("text_length"), vectors.from_text(F.col("text")).alias("v"))
    return back.select("vec_id", "text_length", F.round(T.dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.col("v")[0].cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))


@_query("SELECT doc_id, md5('doc_' || doc_id || chr(10) || substr(text, 1, 1000)) AS input_md5 FROM documents")
def embedding_input(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    return chunks.select(F.col("chunk_id").alias("doc_id"), F.md5(T.embedding_input(F.col("symbol_name"), F.col("code")).cast("binary")).alias("input_md5"))


@_query("SELECT count(*) > 0 AS any_vector, FALSE AS any_without FROM documents JOIN embeddings ON doc_id = vec_id")
def has_embedding(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    found = vectors.has_any(chunks.join(_vectors(spark, sf_dir), "chunk_id", "left")), vectors.has_any(vectors.embedded(chunks, None))
    return spark.createDataFrame([found], "any_vector boolean, any_without boolean")


# --- incremental maintenance ------------------------------------------------------------


def _files(spark, sf_dir, edited: bool):
    """One file for each document; the edited state lacks some, has some altered and some more."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/repo/doc_"), "doc_id").alias("file_path"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.when(F.col("doc_id") % 5 == 2, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")) if edited else F.col("text")
    return d.where(F.col("doc_id") % 7 != (1 if edited else 3)).select("file_path", T.content_hash(text).alias("hash"), text.alias("text"))


_FILES = """old AS (SELECT '/repo/doc_' || doc_id AS file_path, sha1(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 7 <> 3),
  seen AS (SELECT '/repo/doc_' || doc_id AS file_path, sha1(coalesce(text, '') || CASE WHEN doc_id % 5 = 2 THEN ' edited' ELSE '' END) AS hash FROM documents WHERE doc_id % 7 <> 1)"""


@_query("SELECT doc_id, sha1(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@_query(f"WITH {_FILES} SELECT file_path, hash FROM seen ANTI JOIN old USING (file_path, hash)")
def hash_skip(spark, sf_dir):
    return changes.changed_only(_files(spark, sf_dir, False), _files(spark, sf_dir, True)).select("file_path", "hash")


@_query(f"WITH {_FILES} SELECT file_path, hash FROM old ANTI JOIN seen USING (file_path) UNION ALL SELECT file_path, hash FROM seen")
def upsert_merge(spark, sf_dir):
    return changes.upsert(_files(spark, sf_dir, False), _files(spark, sf_dir, True)).select("file_path", "hash")


@_query(f"WITH {_FILES} SELECT file_path, hash FROM old SEMI JOIN seen USING (file_path)")
def remove_files(spark, sf_dir):
    old = _files(spark, sf_dir, False)
    gone = changes.diff(old, _files(spark, sf_dir, True)).where("change = 'unlink'")
    return changes.remove(old, gone).select("file_path", "hash")


@_query(f"WITH {_FILES} SELECT coalesce(o.file_path, s.file_path) AS file_path, CASE WHEN o.hash IS NULL THEN 'add' WHEN s.hash IS NULL THEN 'unlink' WHEN o.hash = s.hash THEN 'same' ELSE 'change' END AS change FROM old o FULL JOIN seen s ON o.file_path = s.file_path")
def reconcile_diff(spark, sf_dir):
    return changes.diff(_files(spark, sf_dir, False), _files(spark, sf_dir, True))


@_query(f"WITH {_FILES} SELECT file_path, hash FROM seen")
def snapshot_round_trip(spark, sf_dir):
    """The newer of two saved versions is what is read."""
    folder = f"{shared.shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.save(spark, folder, {"files": _files(spark, sf_dir, False).drop("text")}, "model")
    snapshot.save(spark, folder, {"files": _files(spark, sf_dir, True).drop("text")}, "model")
    return snapshot.load(spark, folder, "model")["files"]


# --- filters ----------------------------------------------------------------------------

_PATHS = "paths AS (SELECT page_id, '/repo/' || CASE page_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/gen/' WHEN 2 THEN 'tests/' ELSE 'node_modules/' END || 'page_' || page_id || CASE page_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.test.ts' WHEN 4 THEN '.vue' ELSE '.TS' END AS path, html FROM pages)"


def _paths(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % n + 1).cast("int"))
    path = F.concat(F.lit("/repo/"), pick(4, ["src/", "src/gen/", "tests/", "node_modules/"]), F.lit("page_"), "page_id", pick(6, [".ts", ".py", ".md", ".test.ts", ".vue", ".TS"]))
    return p.select("page_id", path.alias("path"), "html")


@_query(f"WITH {_PATHS} SELECT page_id, path FROM paths WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|vue|svelte|py)$') AND NOT regexp_matches(path, '{filters.TEST_FILE_SQL}')")
def path_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(filters.indexable(F.col("path"))).select("page_id", "path")


@_query(f"WITH {_PATHS} SELECT page_id, path FROM paths WHERE NOT regexp_matches(path, '(^|/)node_modules(/|$)') AND NOT (path LIKE '/repo/src/gen/%' AND NOT path LIKE '%/page_1%')")
def ignore_filter(spark, sf_dir):
    rules = filters.rules([("/repo", "/src/gen/*\n!page_1*\n")])
    return filters.not_ignored(_paths(spark, sf_dir), rules, "/repo").select("page_id", "path")


@_query(
    f"""WITH {_PATHS} SELECT page_id, path FROM paths WHERE NOT regexp_matches(path, '(^|/)node_modules(/|$)') AND path NOT LIKE '/repo/%.md'
  AND NOT (path LIKE '/repo/src/%' AND path LIKE '%.vue') AND NOT (path LIKE '/repo/src/gen/%' AND path LIKE '%/page_2%' AND path NOT LIKE '%.py') AND path NOT LIKE '/repo/tests/%'"""
)
def nested_ignores(spark, sf_dir):
    """Rules of nested folders hold below them; they can't take back what the root ignores, and a folder's ignored files stay so."""
    rules = filters.rules([("/repo", "*.md\n/tests/\n"), ("/repo/src", "*.vue\n!*.md\n"), ("/repo/src/gen", "page_2*\n!*.py\n!*.vue\n"), ("/repo/tests", "!*\n")])
    return filters.not_ignored(_paths(spark, sf_dir), rules, "/repo").select("page_id", "path")


@_query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 4000")
def size_filter(spark, sf_dir):
    return filters.at_most(_table(spark, sf_dir, "documents"), "n_chars", 4000).select("doc_id", "n_chars")


@_query(f"WITH {_CHUNKS} SELECT chunk_id, count(*) OVER (PARTITION BY file_path) <= 50 AS embeddable FROM chunks")
def dense_file_guard(spark, sf_dir):
    return changes.dense_guard(documents_as_chunks(spark, sf_dir), 50).select("chunk_id", "embeddable")


@_query(
    r"""WITH parts AS (SELECT page_id, html, regexp_extract(html, '(?is)^(.*?<script[^>]*>).*?</script>', 1) AS before, regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS inside FROM pages),
  masked AS (SELECT page_id, regexp_replace(before, '[^\n]', ' ', 'g') || inside || regexp_replace(substr(html, length(before) + length(inside) + 1), '[^\n]', ' ', 'g') AS masked
    FROM parts WHERE regexp_matches(inside, '\S'))
  SELECT page_id, CAST(length(masked) AS INTEGER) AS n_chars, md5(masked) AS masked_md5 FROM masked"""
)
def script_mask(spark, sf_dir):
    from quarrylight.functions import scripts

    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.withColumn("masked", scripts.masked(F.col("html"))).where("masked IS NOT NULL").select("page_id", F.length("masked").alias("n_chars"), F.md5(F.col("masked").cast("binary")).alias("masked_md5"))


# --- dependencies and views -------------------------------------------------------------


def _linked(spark, sf_dir):
    """Chunks with string ids; every third file has another suffix, some references lead nowhere."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    suffix = F.element_at(F.array(F.lit(".ts"), F.lit(".py"), F.lit("/index.ts")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = lambda i: F.concat(F.lit("f"), i % 20)
    return d.select(
        "doc_id", F.concat(path(F.col("doc_id")), suffix, F.lit("::doc_"), "doc_id").alias("chunk_id"),
        F.array(*[F.concat(path(F.col("doc_id") + n), F.element_at(F.array(F.lit(".ts"), F.lit(".py"), F.lit("/index.ts")), ((F.col("doc_id") + n) % 3 + 1).cast("int")), F.lit("::doc_"), (F.col("doc_id") + n).cast("string")) for n in (20, 40)]).alias("refs"),
        F.array(*[F.concat(path(F.col("doc_id") + n), F.lit("::doc_"), (F.col("doc_id") + n).cast("string")) for n in (1, 1_000_000)]).alias("ext_refs"),
    )


def _linked_sql() -> str:
    suffix = lambda e: f"CASE ({e}) % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '/index.ts' END"
    name = lambda e: f"'f' || (({e}) % 20) || {suffix(e)} || '::doc_' || ({e})"
    return f"""linked AS (SELECT doc_id, {name("doc_id")} AS chunk_id FROM documents),
  refs AS (SELECT l.chunk_id AS src, t.chunk_id AS dst, n // 20 - 1 AS pos FROM linked l CROSS JOIN (VALUES (20), (40)) AS v(n) JOIN linked t ON t.doc_id = l.doc_id + n),
  ext AS (SELECT l.chunk_id AS src, t.chunk_id AS dst, 0 AS pos FROM linked l JOIN linked t ON t.doc_id = l.doc_id + 1),
  deps AS (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY g, pos) AS INTEGER) AS pos FROM (SELECT *, 0 AS g FROM refs UNION ALL SELECT *, 1 AS g FROM ext))"""


@_query(f"WITH {_linked_sql()} SELECT src, dst, CAST(pos AS INTEGER) AS pos FROM refs")
def resolve_refs(spark, sf_dir):
    return expand.references(_linked(spark, sf_dir))


@_query(f"WITH {_linked_sql()} SELECT src, dst, CAST(pos AS INTEGER) AS pos FROM ext")
def resolve_external_refs(spark, sf_dir):
    return expand.external_references(_linked(spark, sf_dir))


@_query(f"WITH {_linked_sql()} SELECT src, dst, pos FROM deps")
def direct_deps(spark, sf_dir):
    return expand.dependencies(_linked(spark, sf_dir))


def _some_ranked(spark, sf_dir):
    """A query for each document, whose results are given: the document itself and the one twenty on."""
    d = _linked(spark, sf_dir)
    q = d.select(F.col("doc_id").alias("qid"), "chunk_id", F.lit(1).alias("rank"), "doc_id")
    second = d.select(F.col("doc_id").alias("_id"), F.col("chunk_id").alias("_chunk")).join(q, F.col("_id") == F.col("doc_id") + 20)
    return q.select("qid", "chunk_id", "rank").unionByName(second.select("qid", F.col("_chunk").alias("chunk_id"), F.lit(2).alias("rank")))


@_query(
    f"""WITH {_linked_sql()}, given AS (SELECT doc_id AS qid, chunk_id, 1 AS rank, doc_id FROM linked),
  results AS (SELECT qid, chunk_id, rank FROM given UNION ALL SELECT g.qid, l.chunk_id, 2 FROM given g JOIN linked l ON l.doc_id = g.doc_id + 20),
  one AS (SELECT qid, dst, row_number() OVER (PARTITION BY qid ORDER BY pos) AS place FROM (SELECT g.qid, dst, min(pos) AS pos FROM given g JOIN deps ON src = chunk_id
    WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.qid = g.qid AND r.chunk_id = dst) GROUP BY ALL)),
  two AS (SELECT qid, dst, row_number() OVER (PARTITION BY qid ORDER BY place, pos) AS place FROM (SELECT o.qid, d.dst, min(o.place * 1000 + d.pos) // 1000 AS place, min(o.place * 1000 + d.pos) % 1000 AS pos
    FROM one o JOIN deps d ON d.src = o.dst WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.qid = o.qid AND r.chunk_id = d.dst) AND NOT EXISTS (SELECT 1 FROM one p WHERE p.qid = o.qid AND p.dst = d.dst) GROUP BY ALL)),
  added AS (SELECT qid, dst, hop, row_number() OVER (PARTITION BY qid ORDER BY hop, place) AS spot FROM (SELECT qid, dst, 1 AS hop, place FROM one WHERE place <= 4 UNION ALL SELECT qid, dst, 2, place FROM two) QUALIFY spot <= 4)
  SELECT qid, chunk_id, 0 AS hop, CAST(rank AS INTEGER) AS rank FROM results
  UNION ALL SELECT a.qid, dst, hop, CAST(spot + (SELECT max(rank) FROM results r WHERE r.qid = a.qid) AS INTEGER) FROM added a"""
)
def expand_two_hop(spark, sf_dir):
    return expand.expanded(_some_ranked(spark, sf_dir), expand.dependencies(_linked(spark, sf_dir)))


_SPAN = "c.symbol_name || '  (' || c.kind || ', lines ' || c.start_line || '-' || c.end_line || ')'"
_SIGNATURE = r"regexp_replace(regexp_replace(split_part(c.code, chr(10), 1), '^\s+', ''), '\s+$', '')"
_VIEW = f"""{_RANKED}, places AS (SELECT qid, file_path, min(rank) AS file_rank FROM ranked JOIN chunks USING (chunk_id) GROUP BY ALL),
  members AS (SELECT p.qid, p.file_rank, c.*, r.chunk_id IS NOT NULL AS selected, {_SPAN} AS span, {_SIGNATURE} AS signature,
    c.kind <> 'module' AND r.chunk_id IS NULL AS other FROM places p JOIN chunks c USING (file_path) LEFT JOIN ranked r ON r.qid = p.qid AND r.chunk_id = c.chunk_id),
  counted AS (SELECT *, sum(CAST(kind = 'module' AS INTEGER)) OVER w AS modules, sum(CAST(other AS INTEGER)) OVER w AS shown,
    sum(CAST(other AS INTEGER)) OVER (PARTITION BY qid, file_path) AS others FROM members WINDOW w AS (PARTITION BY qid, file_path ORDER BY start_line, end_line, ord))"""


@_query(f"WITH {_VIEW} SELECT qid, file_path, CAST(shown AS INTEGER) AS place, '//   ' || span || ':  ' || signature AS line FROM counted WHERE other AND shown <= 40")
def collapsed_signatures(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    return context.collapsed(rank.rank(chunks, batch(spark), K), chunks)


@_query(
    f"""WITH {_VIEW}, parts AS (SELECT qid, file_rank, file_path, others, kind <> 'module' AS late, ord, start_line, end_line,
    CASE WHEN kind = 'module' THEN CASE WHEN modules = 1 THEN code END WHEN selected THEN '// ▸ ' || span || chr(10) || code WHEN shown <= 40 THEN '//   ' || span || ':  ' || signature END AS part FROM counted),
  blocks AS (SELECT qid, file_rank, '// ═══ ' || file_path || ' ═══' || chr(10) || string_agg(part, chr(10) ORDER BY late, start_line, end_line, ord)
    || CASE WHEN max(others) > 40 THEN chr(10) || '//   … ' || CAST(max(others) - 40 AS BIGINT) || ' more symbol(s) in this file' ELSE '' END AS block FROM parts WHERE part IS NOT NULL GROUP BY qid, file_rank, file_path)
  SELECT qid, md5(string_agg(block, chr(10) || chr(10) ORDER BY file_rank)) AS context_md5, CAST(length(string_agg(block, chr(10) || chr(10) ORDER BY file_rank)) AS BIGINT) AS n_chars FROM blocks GROUP BY qid"""
)
def ghost_context(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    view = context.render(rank.rank(chunks, batch(spark), K), chunks)
    return view.select("qid", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.length("context").cast("long").alias("n_chars"))


@_query()
def budget_pack(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    ranked = rank.rank(chunks, batch(spark), budget.MOST_PRIMARY)
    edges = chunks.select(F.col("chunk_id").alias("src"), (F.col("chunk_id") + 1).alias("dst"), F.lit(1).alias("pos")).join(chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_semi")
    return budget.pack(ranked, chunks, edges, 20_000)


# --- accounting -------------------------------------------------------------------------


@_query("SELECT doc_id, CAST(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


_TRACKED = f"""{_RANKED}, sizes AS (SELECT source AS file_path, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY source),
  touched AS (SELECT DISTINCT qid, file_path FROM ranked JOIN chunks USING (chunk_id)),
  targeted AS (SELECT qid, CAST(sum(ceil(length(code) / 4.0)) AS BIGINT) AS targeted_tokens, count(*) AS chunk_count FROM ranked JOIN chunks USING (chunk_id) GROUP BY qid),
  naive AS (SELECT qid, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS naive_tokens FROM touched LEFT JOIN sizes USING (file_path) GROUP BY qid),
  tracked AS (SELECT qid, naive_tokens, targeted_tokens, greatest(0, naive_tokens - targeted_tokens) AS saved_tokens, chunk_count FROM naive JOIN targeted USING (qid))"""


@_query(f"WITH {_TRACKED} SELECT * FROM tracked")
def track_search(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    results = rank.rank(chunks, batch(spark), K).join(chunks.select("chunk_id", "file_path", "code"), "chunk_id")
    files = chunks.groupBy("file_path").agg(F.sum(T.estimated_tokens(F.col("code"))).alias("tokens"))
    return savings.track_search(results, files, results.groupBy("qid").agg(F.sum(T.estimated_tokens(F.col("code"))).alias("targeted_tokens")))


@_query(f"WITH {_TRACKED} SELECT CAST(least(count(*), 200) AS BIGINT) AS calls, CAST(sum(naive_tokens) AS BIGINT) AS naive_tokens, CAST(sum(targeted_tokens) AS BIGINT) AS targeted_tokens, CAST(greatest(0, sum(naive_tokens) - sum(targeted_tokens)) AS BIGINT) AS saved_tokens, CAST(floor(greatest(0, sum(naive_tokens) - sum(targeted_tokens)) / sum(naive_tokens) * 100 + 0.5) AS BIGINT) AS saved_pct FROM tracked")
def token_savings_net(spark, sf_dir):
    return savings.net_savings(track_search(spark, sf_dir))


def _log(spark, sf_dir):
    """Events as a request log: 4 naive tokens for each unit of value, 1 targeted; every ninth line is malformed."""
    e = _table(spark, sf_dir, "events")
    saved = F.when(F.col("event_id") % 9 != 4, F.greatest(F.lit(0.0), F.floor(F.col("value")) * 3.0 - 20))
    return e.select(F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("client"), (F.floor(F.col("value")) * 4.0).alias("naive_tokens"), (F.floor(F.col("value")) * 1.0 + 20).alias("targeted_tokens"), saved.alias("saved_tokens"))


_BLOCKS = f"""parts AS (SELECT qid, file_rank, file_path, others, kind <> 'module' AS late, ord, start_line, end_line,
    CASE WHEN kind = 'module' THEN CASE WHEN modules = 1 THEN code END WHEN selected THEN '// ▸ ' || span || chr(10) || code WHEN shown <= 40 THEN '//   ' || span || ':  ' || signature END AS part FROM counted),
  blocks AS (SELECT qid, file_rank, '// ═══ ' || file_path || ' ═══' || chr(10) || string_agg(part, chr(10) ORDER BY late, start_line, end_line, ord)
    || CASE WHEN max(others) > 40 THEN chr(10) || '//   … ' || CAST(max(others) - 40 AS BIGINT) || ' more symbol(s) in this file' ELSE '' END AS block FROM parts WHERE part IS NOT NULL GROUP BY qid, file_rank, file_path),
  contexts AS (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY file_rank) AS context FROM blocks GROUP BY qid)"""


@_query(
    f"""WITH {_VIEW}, {_BLOCKS}, {_TRACKED.removeprefix(_RANKED + ", ")}
  SELECT qid, md5(CASE WHEN context IS NULL THEN 'No matching context found. If you expected code here, read the relevant file directly.'
    ELSE context || chr(10) || chr(10) || '---' || chr(10) || '~' || saved_tokens || ' tokens saved this call (' || naive_tokens || ' naive -> ' || targeted_tokens
      || ' targeted). Lines shown are real; "// name (kind, lines …): signature" entries are other symbols in the file, collapsed — request them by name if you need their bodies.' END) AS answer_md5
  FROM (SELECT qid FROM batch UNION ALL SELECT 99) LEFT JOIN contexts USING (qid) LEFT JOIN tracked USING (qid)"""
)
def search_answer(spark, sf_dir):
    """The batch and a query that nothing matches, as its callers are answered."""
    chunks = documents_as_chunks(spark, sf_dir)
    asked = batch(spark).unionByName(spark.createDataFrame([(99, "zzz")], "qid int, query string"))
    ranked = rank.rank(chunks, asked, K)
    rows = asked.select("qid").join(context.render(ranked, chunks).select("qid", "context"), "qid", "left").join(track_search(spark, sf_dir), "qid", "left")
    return rows.select("qid", F.md5(answers.answer(F.col("context"), F.col("naive_tokens"), F.col("targeted_tokens"), F.col("saved_tokens")).cast("binary")).alias("answer_md5"))


_LOG = "log AS (SELECT event_id AS ord, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS client, floor(value) * 4.0 AS naive_tokens, floor(value) * 1.0 + 20 AS targeted_tokens, greatest(0.0, floor(value) * 3.0 - 20) AS saved_tokens FROM events WHERE event_id % 9 <> 4)"


@_query(f"WITH {_LOG} SELECT count(*) AS calls, sum(naive_tokens) AS naive_tokens, sum(targeted_tokens) AS targeted_tokens, sum(saved_tokens) AS saved_tokens, arg_min(ts, ord) AS first_ts, arg_max(ts, ord) AS last_ts, CAST(floor(sum(saved_tokens) / sum(naive_tokens) * 100 + 0.5) AS BIGINT) AS saved_pct FROM log")
def request_log_summary(spark, sf_dir):
    return savings.request_summary(_log(spark, sf_dir))


@_query(f"WITH {_LOG}, g AS (SELECT client, count(*) AS calls, sum(saved_tokens) AS saved_tokens, min(ord) AS first_ord FROM log GROUP BY client) SELECT *, CAST(row_number() OVER (ORDER BY round(saved_tokens, 6) DESC, first_ord) AS INTEGER) AS place FROM g")
def savings_by_client(spark, sf_dir):
    return savings.by_client(_log(spark, sf_dir))


@_query(f"WITH {_LOG} SELECT ord, ts, client, naive_tokens, targeted_tokens, saved_tokens FROM log ORDER BY ord DESC LIMIT 10")
def recent_calls(spark, sf_dir):
    return savings.recent(_log(spark, sf_dir))


@_query("SELECT count(DISTINCT source) AS files, count(DISTINCT doc_id) AS chunks, strftime(max(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER)), '%Y-%m-%d') AS last_updated FROM documents")
def index_stats(spark, sf_dir):
    chunks = documents_as_chunks(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("ord") % 365).cast("int")).cast("timestamp")
    files = chunks.groupBy("file_path").agg(F.max(day).alias("updated"))
    return savings.index_stats(files, chunks).select("files", "chunks", F.date_format("last_updated", "yyyy-MM-dd").alias("last_updated"))


@_query(f"WITH {_LOG} SELECT CAST(ord AS VARCHAR) AS query, ts, client, naive_tokens, targeted_tokens, saved_tokens FROM log")
def request_log_read(spark, sf_dir):
    """Events appended to a log in two goes, with lines between them that are no searches."""
    path = f"{shared.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows = _log(spark, sf_dir).withColumn("query", F.col("ord").cast("string")).withColumn("chunks", F.lit(1.0))
    requests.append(rows.where("ord % 2 = 0"), path)
    spark.createDataFrame([("",), ('{"ts": "x", "savedTok',), ('{"ts": "x", "client": "c", "savedTokens": null}',), ("[1]",)], "value string").write.mode("append").text(path)
    requests.append(rows.where("ord % 2 = 1"), path)
    return requests.read(spark, path).select("query", "ts", "client", "naive_tokens", "targeted_tokens", "saved_tokens")


# --- parsing and streaming --------------------------------------------------------------


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _parsed_sql(sources: list[tuple[str, str]], rows: str, code: str = "NULL") -> str:
    """Expected symbols, written out by the rules; their code is the lines of the source but where a row states it."""
    held = ", ".join(f"({_literal(p)}, {_literal(c)})" for p, c in sources)
    return f"""WITH sources(file_path, content) AS (VALUES {held}), expected(file, name, kind, start_line, end_line, refs, ext_refs) AS (VALUES {rows}),
  lines AS (SELECT e.*, array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10)) AS plain FROM expected e JOIN sources ON file_path = '/repo/' || file)
  SELECT '/repo/' || file || '::' || name AS chunk_id, kind, start_line, end_line, refs, ext_refs, md5(coalesce({code}, plain)) AS code_md5 FROM lines"""


def _symbol_rows(spark, sources):
    from quarrylight.sources import symbols

    found = symbols.parsed(spark.createDataFrame(sources, "file_path string, content string")).where("chunk_id IS NOT NULL")
    return found.select("chunk_id", "kind", "start_line", "end_line", F.array_join("refs", " ").alias("refs"), F.array_join("ext_refs", " ").alias("ext_refs"), F.md5(F.col("code").cast("binary")).alias("code_md5"))


@_query(
    _parsed_sql(
        samples.PYTHON,
        """('app.py', '__module__', 'module', 1, 6, '', ''), ('app.py', 'start', 'function', 7, 8, '/repo/app.py::stop', '/repo/util::helper'),
    ('app.py', 'stop', 'function', 11, 12, '', ''), ('app.py', 'Box', 'class', 15, 17, '', ''), ('app.py', 'Box.open', 'method', 18, 19, '/repo/app.py::start', ''),
    ('app.py', 'Box.close', 'async-method', 21, 22, '/repo/app.py::stop', ''), ('util.py', 'helper', 'async-function', 1, 3, '', ''), ('plain.py', '__file__', 'file', 1, 2, '', '')""",
    )
)
def parse_python_chunks(spark, sf_dir):
    return _symbol_rows(spark, samples.PYTHON)


@_query(
    _parsed_sql(
        samples.SCRIPTS,
        """('auth.ts', 'login', 'function', 4, 6, '/repo/auth.ts::check', '/repo/users::find'), ('auth.ts', 'check', 'function', 8, 10, '', ''),
    ('auth.ts', 'logout', 'const-function', 12, 14, '/repo/auth.ts::login', ''), ('auth.ts', '__module__', 'module', 1, 15, '', ''),
    ('users.ts', 'User', 'interface', 1, 3, '', ''), ('users.ts', 'Users', 'class', 5, 7, '', ''), ('users.ts', 'Users.constructor', 'method', 9, 12, '', ''),
    ('users.ts', 'Users.find', 'method', 14, 16, '/repo/users.ts::find', ''), ('users.ts', 'Users.size', 'method', 18, 20, '', ''), ('users.ts', 'find', 'function', 23, 25, '', ''),
    ('view.vue', 'go', 'function', 4, 4, '', '/repo/auth::login'), ('view.vue', '__module__', 'module', 1, 6, '', ''), ('run.js', '__file__', 'file', 1, 2, '', '')""",
        "CASE WHEN kind = 'class' THEN plain || chr(10) || '}' WHEN file = 'auth.ts' AND kind = 'module' THEN list_extract(string_split(plain, chr(10)), 1) || chr(10) || list_extract(string_split(plain, chr(10)), 2) WHEN kind = 'module' THEN list_extract(string_split(plain, chr(10)), 3) END",
    )
)
def parse_ts_chunks(spark, sf_dir):
    return _symbol_rows(spark, samples.SCRIPTS)


@_query("SELECT '/repo/doc_' || doc_id AS file_path, sha1(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 5 <> 0")
def stream_reindex(spark, sf_dir):
    from quarrylight.streaming import reindex

    return reindex.replay(spark, sf_dir)
