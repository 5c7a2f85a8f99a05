"""Behaviour of indexing and search on small trees and hand-built rows."""

import os

import pytest

from quarrylight.functions import parse_python, parse_script, porter, scripts
from quarrylight.operators import budget, changes, context, expand, lexical, rank, savings
from quarrylight.plans.engine import Engine
from quarrylight.sources import filters, repo, requests, samples, symbols
from quarrylight.streaming import reindex

COLUMNS = "chunk_id string, file_path string, symbol_name string, kind string, start_line int, end_line int, code string, refs array<string>, ext_refs array<string>, ord int"


def chunks(spark, *rows):
    full = [(f"{p}::{n}", p, n, kind, 10 * i + 1, 10 * i + 5, code, refs, ext, i) for i, (p, n, kind, code, refs, ext) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "qid int, query string")


def names(df):
    return [r["chunk_id"].split("::")[1] for r in df.orderBy("qid", "rank").collect()]


def test_rare_term_ranks_first(spark):
    rows = [("a.ts", f"f{i}", "function", "alpha beta", None, None) for i in range(5)] + [("a.ts", "rare", "function", "alpha beta gamma", None, None)]
    assert names(rank.rank(chunks(spark, *rows), asked(spark, "alpha beta gamma"), 1)) == ["rare"]


def test_gate_needs_two_terms_or_a_name(spark):
    rows = chunks(spark, ("a.ts", "one", "function", "alpha beta", None, None), ("a.ts", "two", "function", "alpha only", None, None))
    assert names(rank.rank(rows, asked(spark, "alpha beta"))) == ["one"]
    assert names(rank.rank(rows, asked(spark, "two"))) == ["two"]
    assert names(rank.rank(rows, asked(spark, "zzz yyy"))) == []
    # a repeated term counts twice
    assert set(names(rank.rank(rows, asked(spark, "alpha alpha")))) == {"one", "two"}


def test_stemming_and_file_penalty(spark):
    rows = chunks(spark, ("a.ts", "run_process", "function", "x", None, None), ("a.ts", "__file__", "file", "run process run process", None, None))
    found = names(rank.rank(rows, asked(spark, "running processes"), 2, stem=True))
    assert found[0] == "run_process"
    assert [porter.stem(w) for w in ("running", "ponies", "caresses", "relational", "hopping", "happy", "conditional", "adjustable")] == ["run", "poni", "caress", "relat", "hop", "happi", "condit", "adjust"]


def test_semantic_floor_and_vectors(spark):
    rows = chunks(spark, *[("a.ts", f"v{i}", "function", "x", None, None) for i in range(3)])
    vectors = spark.createDataFrame([("a.ts::v0", [1.0, 0.0]), ("a.ts::v1", [0.3, 0.95]), ("a.ts::v2", [0.2, 0.97])], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, "", [1.0, 0.0]), (2, "", [])], "qid int, query string, query_embedding array<float>")
    found = rank.rank(rows.join(vectors, "chunk_id"), queries)
    assert names(found) == ["v0", "v1"]


def test_expansion_two_hops_capped(spark):
    rows = [("a.ts", "top", "function", "alpha beta", ["a.ts::b", "a.ts::c"], ["d::x"]), ("a.ts", "b", "function", "q", ["a.ts::e", "a.ts::top"], None), ("a.ts", "c", "function", "q", ["a.ts::f"], None), ("a.ts", "e", "function", "q", ["a.ts::g"], None), ("a.ts", "f", "function", "q", None, None), ("a.ts", "g", "function", "q", None, None), ("d/index.ts", "x", "function", "q", None, None)]
    table = chunks(spark, *rows)
    ranked = rank.rank(table, asked(spark, "alpha beta"), 1)
    assert names(expand.expanded(ranked, expand.dependencies(table))) == ["top", "b", "c", "x", "e"]


def test_view(spark):
    rows = [("a.ts", "__module__", "module", "import x", None, None), ("a.ts", "f", "function", "function f() {\n}", None, None), ("a.ts", "g", "function", "  function g() {\n}", None, None)]
    table = chunks(spark, *rows)
    results = spark.createDataFrame([(1, "a.ts::f", 1)], "qid int, chunk_id string, rank int")
    view = context.render(results, table).first()["context"]
    assert view == "// ═══ a.ts ═══\nimport x\n// ▸ f  (function, lines 11-15)\nfunction f() {\n}\n//   g  (function, lines 21-25):  function g() {"
    held = {r["chunk_id"]: r.asDict() | {"signature": r["code"].split("\n")[0].strip()} for r in table.collect()}
    assert budget.view(["a.ts::f"], held, {"a.ts": list(held)}) == view


def test_budget_keeps_the_first_and_skips(spark):
    rows = [("a.ts", "D", "function", "alpha beta " + "d" * 200, ["a.ts::C"], None), ("a.ts", "C", "function", "c" * 400, ["a.ts::B"], None), ("a.ts", "B", "function", "b" * 40, None, None)]
    table = chunks(spark, *rows)
    ranked = rank.rank(table, asked(spark, "alpha beta"))
    sizes = []
    for limit in (1, 130, 10_000):
        packed = budget.pack(ranked, table, expand.dependencies(table), limit, hops=8).orderBy("place").collect()
        assert packed[0]["chunk_id"] == "a.ts::D"
        sizes.append(len(packed))
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] == 3


def test_budget_follows_a_long_chain(spark):
    many = 70
    rows = [("a.ts", "D0", "function", "alpha beta", ["a.ts::D1"], None)]
    rows += [("a.ts", f"D{i}", "function", f"d{i}", [f"a.ts::D{i + 1}"] if i < many else None, None) for i in range(1, many + 1)]
    table = chunks(spark, *rows)
    packed = budget.pack(rank.rank(table, asked(spark, "alpha beta"), budget.MOST_PRIMARY), table, expand.dependencies(table), 20_000)
    assert [r["chunk_id"] for r in packed.orderBy("place").collect()] == [f"a.ts::D{i}" for i in range(many + 1)]


def test_savings(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"ts":"2024-01-02T0","client":"a","query":"q","chunks":1,"naiveTokens":1000,"targetedTokens":300,"savedTokens":700}\n\n{"ts":"2024-01-03T0","client":"b","query":"q","chunks":1,"naiveTokens":500,"targetedTokens":200,"savedTokens":300}\n{"ts":"x","savedTok\n{"ts":"2024-01-04T0","client":"b","query":"q","chunks":1,"naiveTokens":500,"targetedTokens":100,"savedTokens":400}\n')
    rows = requests.read(spark, str(log))
    s = savings.request_summary(rows).first()
    assert (s["calls"], s["naive_tokens"], s["saved_tokens"], s["saved_pct"], s["first_ts"][:10]) == (3, 2000, 1400, 70, "2024-01-02")
    assert [r["client"] for r in savings.by_client(rows).orderBy("place").collect()] == ["a", "b"]
    assert "70%" in requests.dashboard(savings.request_summary(rows), savings.by_client(rows))
    assert savings.request_summary(requests.read(spark, str(tmp_path / "none"))).first()["calls"] == 0


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file_path string, hash string")
    assert {tuple(r) for r in changes.diff(old, new).collect()} == {("a", "same"), ("b", "change"), ("c", "unlink"), ("d", "add")}
    assert {tuple(r) for r in changes.upsert(old, new).collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")}


def test_ignore_rules():
    rules = filters.rules([("", "gen/\n*.log\n!keep.log\n"), ("/r/pkg", "secret.ts\n!../x\n")])
    hidden = lambda p: filters.ignored(p, rules, "/r")
    assert hidden("/r/gen/a.ts") and hidden("/r/x/node_modules/y/a.ts") and hidden("/r/a.log") and not hidden("/r/keep.log")
    assert hidden("/r/pkg/secret.ts") and hidden("/r/pkg/sub/secret.ts") and not hidden("/r/other/secret.ts")


def test_scripts_and_python():
    masked = scripts.mask("<a>\n<script>\nlet x\n</script>\n<script>  </script>")
    assert masked.split("\n")[2] == "let x" and masked.count("\n") == 4 and scripts.mask("<b/>") is None
    found = {s["name"]: s for s in parse_python.symbols(samples.PYTHON[0][1], "/repo/app.py", "/repo")}
    assert found["start"]["refs"] == ["/repo/app.py::stop"] and found["start"]["ext_refs"] == ["/repo/util::helper"]
    assert found["Box"]["kind"] == "class" and found["Box.close"]["kind"] == "async-method" and found["__module__"]["end"] == 6
    assert parse_python.symbols("def (:", "/x.py", "/") == []


def test_script_symbols():
    auth = {s["name"]: s for s in parse_script.symbols(samples.SCRIPTS[0][1], "/repo/auth.ts")}
    assert set(auth) == {"login", "check", "logout", "__module__"}
    assert auth["login"]["refs"] == ["/repo/auth.ts::check"] and auth["login"]["ext_refs"] == ["/repo/users::find"]
    assert auth["logout"]["kind"] == "const-function" and (auth["check"]["start"], auth["check"]["end"]) == (8, 10)
    assert auth["__module__"]["code"] == "import { find as look } from './users';\nconst LIMIT = 5;"
    users = {s["name"]: s for s in parse_script.symbols(samples.SCRIPTS[1][1], "/repo/users.ts")}
    assert {"User", "Users", "Users.constructor", "Users.find", "Users.size", "find"} == set(users)
    assert (users["Users"]["start"], users["Users"]["end"]) == (5, 7) and users["Users.find"]["refs"] == ["/repo/users.ts::find"]
    assert [s["name"] for s in parse_script.symbols("console.log(1);\n", "/a.js")] == ["__file__"]
    assert parse_script.resolved_alias("@/x/y", [("@/*", "/repo/src/*")]) == "/repo/src/x/y"


def test_tree_end_to_end(spark, tmp_path):
    for path, content in samples.PYTHON + samples.SCRIPTS:
        target = tmp_path / path.removeprefix("/repo/")
        target.write_text(content)
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests/x.py").write_text("def a(): pass\n")
    (tmp_path / ".gitignore").write_text("run.js\n")
    engine = Engine(spark)
    root = os.path.realpath(tmp_path)
    first = {r["file_path"].removeprefix(root + "/") for r in engine.index(root).collect()}
    assert first == {"app.py", "util.py", "broken.py", "plain.py", "auth.ts", "users.ts", "view.vue"}
    found = names(engine.search(asked(spark, "login"), 1))
    assert found[0] == "login" and "check" in found and "find" in found
    assert engine.stats().first()["files"] == 7
    assert engine.save(str(tmp_path / ".index")) == 1
    other = Engine(spark)
    assert other.load(str(tmp_path / ".index")) and not Engine(spark, "another").load(str(tmp_path / ".index"))
    os.remove(tmp_path / "util.py")
    (tmp_path / "plain.py").write_text("def fresh():\n    return 1\n")
    assert {(r["file_path"].rsplit("/", 1)[1], r["change"]) for r in other.index(root).where("change <> 'same'").collect()} == {("util.py", "unlink"), ("plain.py", "change")}
    assert names(other.search(asked(spark, "fresh"), 1)) == ["fresh"]


def test_index_stays_until_the_next_index(spark, tmp_path):
    """What was indexed doesn't follow the tree by itself, and a second call sees every edit of it."""
    (tmp_path / "a.py").write_text("def alpha_one():\n    return 1\n")
    (tmp_path / "b.py").write_text("def beta_two():\n    return 2\n")
    engine = Engine(spark)
    changed = lambda: {(os.path.basename(r["file_path"]), r["change"]) for r in engine.index(str(tmp_path)).collect()}
    found = lambda q: names(engine.search(asked(spark, q), 3))
    assert changed() == {("a.py", "add"), ("b.py", "add")}
    (tmp_path / "a.py").write_text("def gamma_three():\n    return 3\n")
    (tmp_path / "c.py").write_text("def delta_four():\n    return 4\n")
    assert found("alpha_one") == ["alpha_one"] and found("gamma_three") == []
    assert changed() == {("a.py", "change"), ("b.py", "same"), ("c.py", "add")}
    assert found("alpha_one") == [] and found("gamma_three") == ["gamma_three"] and found("delta_four") == ["delta_four"]
    os.remove(tmp_path / "b.py")
    assert found("beta_two") == ["beta_two"]
    assert changed() == {("a.py", "same"), ("b.py", "unlink"), ("c.py", "same")}
    assert found("beta_two") == [] and engine.stats().first()["files"] == 2


def test_kept_postings_rank_like_counted_ones(spark):
    rows = chunks(spark, *[("a.ts", f"fn{i}", "function", f"alpha beta{i % 3} Running{i}Words " + "gamma " * i, None, None) for i in range(12)], ("a.ts", "none", "function", None, None, None))
    queries = asked(spark, "alpha gamma", "beta1 alpha running", "alpha alpha", "", "the of")
    for stem in (False, True):
        plain = [tuple(r) for r in rank.rank(rows, queries, 4, stem).orderBy("qid", "rank").select("qid", "rank", "chunk_id", "score").collect()]
        again = [tuple(r) for r in rank.rank(rows, queries, 4, stem, postings=lexical.kept(rows)).orderBy("qid", "rank").select("qid", "rank", "chunk_id", "score").collect()]
        assert plain == again and plain


def test_bm25_shuffles_only_what_is_asked_for(spark, tmp_path):
    chunks(spark, *[("a.ts", f"fn{i}", "function", "alpha beta " * i, None, None) for i in range(50)]).write.parquet(str(tmp_path / "chunks"))
    rows, queries = spark.read.parquet(str(tmp_path / "chunks")), asked(spark, "alpha")
    lexical.bm25(lexical.hits(lexical.postings(rows), queries), queries).write.parquet(str(tmp_path / "out"))
    hits = lexical.hits(lexical.postings(rows), queries)
    assert {r["term"] for r in hits.select("term").distinct().collect()} == {"", "alpha"}


def test_stream_index_survives_a_restart(spark, tmp_path):
    folder = str(tmp_path / "index")
    row = lambda path, text, seq=1: spark.createDataFrame([(path, text, seq, f"h-{text}")], "file_path string, text string, seq long, hash string")
    held = lambda: {(r["file_path"], r["text"]) for r in reindex.Index(spark, folder).read().collect()}
    assert reindex.Index(spark, folder).read() is None
    first = reindex.Index(spark, folder)
    first.merge(row("a", "1"))
    first.merge(row("b", "1").union(row("b", "2", 2)))
    reindex.Index(spark, folder).merge(row("c", "1"))  # another process
    assert held() == {("a", "1"), ("b", "2"), ("c", "1")}
    found = reindex.Index(spark, folder).sweep(spark.createDataFrame([("a", "h-9", "9"), ("c", "h-1", "1")], "file_path string, hash string, text string"))
    assert {(r["file_path"], r["change"]) for r in found.collect()} == {("a", "change"), ("b", "unlink")}
    assert held() == {("a", "9"), ("c", "1")}
    for i in range(10):
        reindex.Index(spark, folder).merge(row(f"n{i}", "1"))
    assert len(held()) == 12 and reindex.Index(spark, folder)._tables()[0] > 0


def test_python_rules(tmp_path):
    parse = lambda text: parse_python.symbols(text, "/r/p/m.py", "/r")
    of = lambda text: {s["name"]: (s["kind"], s["start"], s["end"]) for s in parse(text)}
    assert of("import os\nX = 1\n\n@deco\ndef f():\n    pass\nY = 2\n") == {"__module__": ("module", 1, 3), "f": ("function", 4, 6)}
    assert of("def f():\n    pass\nX = 1\n") == {"__module__": ("module", 1, 3), "f": ("function", 1, 2)}
    assert of("print(1)\n") == {} and of("") == {}
    assert of("@d\nclass A:\n    x = 1\n\n    @d\n    async def g(self):\n        pass\n") == {"A": ("class", 2, 4), "A.g": ("async-method", 5, 7)}
    assert of("class A: pass\n") == {"A": ("class", 1, 1)}
    rows = {s["name"]: s for s in parse("from .q import h as k\nfrom ..z import *\nfrom t.u import w\ndef a():\n    b(); k(); w(); a(); o.c()\ndef b(): pass\nclass C:\n    def a(self):\n        a(); C()\n")}
    assert rows["a"]["refs"] == ["/r/p/m.py::b"] and rows["a"]["ext_refs"] == ["/r/p/q::h", "/r/t/u::w"]
    assert rows["C.a"]["refs"] == ["/r/p/m.py::a"]


def test_walk_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        repo.walk(str(tmp_path / "none"))


def test_parsed_rows(spark):
    rows = symbols.parsed(spark.createDataFrame(samples.SCRIPTS, "file_path string, content string")).collect()
    assert {r["chunk_id"] for r in rows} >= {"/repo/view.vue::go", "/repo/run.js::__file__"} and all(r["error"] is None for r in rows)
