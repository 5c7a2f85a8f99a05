import json
import math

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from quarrylight import cli
from quarrylight.functions import counters, vectors
from quarrylight.operators import neighbours, rank
from quarrylight.plans.engine import Engine
from quarrylight.sources import samples


def test_vectors(spark):
    rows = spark.createDataFrame([("a", "f", "x", "p", [1.5, -2.0]), ("b", "g", None, "p", None)], "chunk_id string, symbol_name string, code string, file_path string, v array<float>")
    back = rows.select(vectors.from_text(vectors.to_text(F.col("v"))).alias("v")).collect()
    assert [r["v"] for r in back] == [[1.5, -2.0], None]
    made = vectors.embedded(rows.drop("v"), lambda texts: [[float(len(t))] for t in texts]).orderBy("chunk_id").collect()
    assert [r["embedding"] for r in made] == [[3.0], None]
    assert vectors.embedded(rows.drop("v"), lambda texts: [[0.0]] * len(texts), 1).where("embedding IS NOT NULL").count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/auth.ts").write_text(samples.SCRIPTS[0][1])
    cli.main(["index", str(tmp_path / "tree"), "--snapshot", str(tmp_path / "snap")])
    assert json.loads(capsys.readouterr().out) == {"add": 1}
    cli.main(["search", "login", "--snapshot", str(tmp_path / "snap"), "--log", str(tmp_path / "log")])
    shown = capsys.readouterr().out
    assert "▸ login" in shown and "tokens saved this call (" in shown
    cli.main(["stats", "--log", str(tmp_path / "log"), "--json"])
    assert json.loads(capsys.readouterr().out)["calls"] == 1
    cli.main(["status", "--snapshot", str(tmp_path / "snap")])
    status = json.loads(capsys.readouterr().out)
    assert status["files"] == 1 and status["chunks"] > 1 and status["lastUpdated"]
    cli.main(["search", "zzz", "--snapshot", str(tmp_path / "snap")])
    assert "No matching" in capsys.readouterr().out


def _unit(spark, n, size=16, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, size))
    made = middles[rng.integers(20, size=n)] + 0.4 * rng.normal(size=(n, size))
    return spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(made)], "chunk_id long, embedding array<float>")


def test_kept_lists_of_vectors(spark, tmp_path):
    """Built, given more, rid of some, saved and read back, the index gives what comparing all gives; by its default share nearly so."""
    every = _unit(spark, 1500).unionByName(spark.createDataFrame([(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [1.0, 0.0]), (9004, [math.nan] * 16)], "chunk_id long, embedding array<float>"))
    index = neighbours.build(every.where("chunk_id < 1000"))
    index = neighbours.remove(neighbours.add(index, every.where("chunk_id >= 990")), every.where("chunk_id % 7 = 5"))
    neighbours.save(index, str(tmp_path / "near"))
    held = every.where("chunk_id < 9000 AND chunk_id % 7 <> 5")
    index = neighbours.load(spark, str(tmp_path / "near"), held.count())
    assert index is not None and neighbours.load(spark, str(tmp_path / "near"), 5) is None and neighbours.load(spark, str(tmp_path / "none")) is None
    asked = held.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_embedding"))
    pairs = lambda rows: {(r["qid"], r["chunk_id"]) for r in rows.collect()}
    want = pairs(rank.candidates(rank.cosine(held, asked), 2))
    assert pairs(neighbours.search(index, asked, rank.wanted(2), 1.0)) == want
    assert len(pairs(neighbours.search(index, asked, rank.wanted(2))) & want) > 0.97 * len(want)
    assert neighbours.build(every.where("chunk_id >= 9000 AND chunk_id <> 9003")) is None


def test_engine_keeps_an_index_of_vectors(spark, tmp_path):
    """The index follows the tree, and a snapshot brings it along."""

    def letters(texts):
        out = []
        for t in texts:
            v = np.array([t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"], float)
            out.append([float(x) for x in v / (np.linalg.norm(v) or 1)])
        return out

    (tmp_path / "tree").mkdir()
    for i, word in enumerate(("zebra", "quokka", "jaguar", "walrus", "gibbon", "python")):
        (tmp_path / f"tree/f{i}.py").write_text(f"def {word}():\n    return '{word * 3}'\n")
    asked = spark.createDataFrame([(1, "zzebraa"), (2, "wwalrus")], "qid int, query string")
    best = lambda engine: {r["qid"]: r["chunk_id"].rsplit("::", 1)[1] for r in engine.search(asked, 1).where("hop = 0").collect()}
    kept = Engine(spark, "letters", embedder=letters, ann_from=3)
    kept.index(str(tmp_path / "tree"))
    assert kept.near.rows.count() == 6 and best(kept) == {1: "zebra", 2: "walrus"}
    (tmp_path / "tree/f0.py").write_text("def zebras():\n    return 'zebrazebrazebra'\n")
    (tmp_path / "tree/f3.py").unlink()
    kept.index(str(tmp_path / "tree"))
    assert kept.near.rows.count() == 5 and best(kept)[1] == "zebras"
    kept.save(str(tmp_path / "snap"))
    other = Engine(spark, "letters", embedder=letters, ann_from=3)
    assert other.load(str(tmp_path / "snap")) and other.near.rows.count() == 5 and best(other)[1] == "zebras"


def test_byte_pair_counter(spark, tmp_path):
    """Counts as the library does, null as nothing, and what it refuses by the fallback rule."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b" a": 258}
    import base64

    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
    count = counters.BytePairs(str(tmp_path / "ranks"), r"\w+|\W")
    known = tiktoken.Encoding("known", pat_str=r"\w+|\W", mergeable_ranks=ranks, special_tokens={})
    texts = ["", "ababab ab", "äöü abab", "a" * 500, "x\ny"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r["n"] for r in rows.select(counters.counted(F.col("t"), count).alias("n")).collect()] == [*(len(known.encode_ordinary(t)) for t in texts), 0]
    assert [r["n"] for r in rows.select(counters.counted(F.col("t")).alias("n")).collect()] == [*map(counters.quarter_length, texts), 0]
    assert counters.quarter_length("\ud800abc") == 1
