"""Each operator against a brute-force twin, on rows with nulls, empties, ties, copies and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import bpe, graph, jaccard, kdtree, lz, mixing, nndescent, pii, quality, separators, toxicity
from quarrylight.llm.queries import END_OF_DOCUMENT, ENGLISH, VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, n string, tokens string, component string, label int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else 0, "x", "y", None, "z", "c", 1) for i, t, lang, s in rows], SCHEMA)


def texts():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "Ünder", "straße", "dé", "the", "of", "日本", "😀", "a.b", "x-1", "42"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.choice([3, 6, 40, 120]))) for _ in range(30)]
    near = []
    for t in base[:10]:
        parts = t.split(" ")
        parts[len(parts) // 2] = "changed"
        near.append(" ".join(parts))
    return [*base, *near, base[3], base[3], base[3].upper(), "", "   \t\n", "one two", "One  two", "a" * 3000, "z " * 4000, None, None]


@pytest.fixture(scope="module")
def docs(spark):
    sources = ["s1", "s2", None, "s1", "s3"]
    rows = [(10 * i if i else 0, t, ["en", None, "de"][i % 3], sources[i % 5]) for i, t in enumerate(texts())]
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def collected(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def brute_classes(rows, percent=80):
    sets = {}
    for i, t, _ in rows:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_classes(docs, empty):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs).collect()}
    assert found == brute_classes(collected(docs))
    assert jaccard.classes(empty).count() == 0


def test_jaccard_large_family_and_representatives(spark):
    rng = random.Random(3)
    origin = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(origin)
        for k in rng.sample(range(150), rng.choice([1, 2, 3])):
            words[k] = f"v{i}-{k}"
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(500 + i, f"passage {' '.join(origin[:20])} then {' '.join(f'q{i}-{k}' for k in range(60))}", "en", "s") for i in range(30)]
    rows += [(900, rows[0][1], "en", "s"), (None, rows[0][1], "en", "s"), (901, None, "en", "s"), (0, rows[0][1], "en", "s")]
    table = make(spark, rows)
    expect = brute_classes([(i, t, s) for i, t, _, s in rows if i is not None])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(table).collect()}
    assert found.pop(None)[1] is None and found == expect
    kept = Counter(r["doc_id"] for r in jaccard.representatives(table).collect())
    assert kept == Counter({i for i, (n, c) in expect.items() if n == 0 or c == i} | {None})


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 3)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200}


BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def brute_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [pii.Span(k, *m.span()) for k in pii.KINDS for m in BASE[k].finditer(text) if keep[k](m[0])]


def test_pii_base_spans_match_the_plain_patterns():
    rng = random.Random(5)
    parts = ["a", "@", ".", "1", "25", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "(", ")", "x", "0", "255", "256", "é", "%", "_", "a@b.c", "+49 151 1234567"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 20)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("bob at mail dot example dot org", "email", "bob at mail dot example dot org"),
    ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("ip １９２.１６８.０.１", "ip", "１９２.１６８.０.１"),
])
def test_pii_disguises_map_back(text, kind, span):
    base, added = pii.scan(text)
    assert [(s.kind, text[s.start : s.end]) for s in added if s.kind == kind] == [(kind, span)]
    assert f"[{kind.upper()}]" in pii.masked(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("host eight dot eight dot four dot four now", "ip", "eight dot eight dot four dot four"),
        ("host 8 dot 8 dot 4 dot 4 now", "ip", "8 dot 8 dot 4 dot 4"),
        ("to john（at）example（dot）com now", "email", "john（at）example（dot）com"),
        ("to john [\u0430t] example [d\u043et] com now", "email", "john [\u0430t] example [d\u043et] com"),
        ("to john at example\tdot\tcom now", "email", "john at example\tdot\tcom"),
        ("to john  aT  example  dOt  com now", "email", "john  aT  example  dOt  com"),
        ("to john [at] example dot com now", "email", "john [at] example dot com"),
        ("to john at example [dot] com now", "email", "john at example [dot] com"),
        ("to john@mail.example dot com now", "email", "john@mail.example dot com"),
    ],
)
def test_pii_gate_is_no_narrower_than_the_transducers(text, kind, span):
    assert (kind, span) in {(s.kind, text[s.start : s.end]) for s in pii.scan(text)[1]}


def test_pii_tables(spark, docs, empty):
    assert pii.scan("look at this, a dot. One or two of three at home")[1] == []
    rows = make(spark, [(1, "a@b.co and 1.2.3.4", "en", "s"), (2, None, "en", "s"), (2, "", "en", "s")])
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["spans"], r["base_sha256"]) for r in pii.digest(rows).collect()}
    assert got == {(1, 1, 1, "email:0:6,ip:11:18", hashlib.sha256(b"email:0:6,ip:11:18").hexdigest()), (2, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert {(r["kind"], r["value"]) for r in pii.find(rows).collect()} == {("email", "a@b.co"), ("ip", "1.2.3.4")}
    out = pii.redact(rows)
    assert out.columns == rows.columns and out.where("doc_id = 1").first()["text"] == "[EMAIL] and [IP]" and out.where("text IS NULL").count() == 1
    assert pii.digest(docs).count() == docs.count() and pii.digest(empty).count() == 0


def naive_phrases(data):
    seen, word = set(), b""
    for i in range(len(data)):
        word += data[i : i + 1]
        if word not in seen:
            seen.add(word)
            word = b""
    return seen | ({word} if word else set())


def test_lz_against_the_plain_parse(docs, empty):
    rows = sorted(collected(docs), key=lambda r: -r[0])
    found = {r["doc_id"]: r for r in lz.edited_likeness(docs).collect()}
    assert len(found) == len(rows) and lz.edited_likeness(empty).count() == 0
    for k, (i, text, _) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[i]
        plain = [lz._smallest(lz._hashes(sorted(naive_phrases(t.encode())))) for t in (text, edited, after)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(map(lz.written_out, plain[:2]))
        assert r["near_edited"] == pytest.approx(lz.likeness(plain[0], plain[1])) and r["near_next"] == pytest.approx(lz.likeness(plain[0], plain[2]))


def test_lz_many_ranges_and_one_row(spark, monkeypatch):
    monkeypatch.setattr(lz, "ROWS_OF_RANGE", 7)
    rows = [(i * i, f"text number {i} " * 5, "en", "s") for i in range(40)] + [(None, "nothing", "en", "s"), (4, "text number 2 " * 5, "en", "s")]
    found = lz.edited_likeness(make(spark, rows)).collect()
    assert len(found) == 42
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expect = Counter()
    for k, r in enumerate(order):
        t, after = r[1], order[(k + 1) % len(order)][1]
        expect[r[0], hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found) == expect
    one = lz.edited_likeness(make(spark, [(5, "abc abc", "en", "s")])).first()
    assert one["near_next"] == 1.0
    pairs = lz.compare(spark.createDataFrame([("", ""), ("00000001", None), ("00000001", "00000001")], "fingerprint_a string, fingerprint_b string"))
    assert [r["likeness"] for r in pairs.collect()] == [1.0, None, 1.0]


def test_shards(spark, docs, empty):
    rows = kdtree.assign(docs, shards=4).collect()
    by_id = {i: t for i, t, _ in collected(docs)}
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        data = (by_id[r["id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kdtree.assign(empty, shards=4).count() == 0
    # a hot group of equal rows is split like any other
    same = make(spark, [(i if i < 50 else 7, "same text", "en", "s") for i in range(400)])
    counts = Counter(r["shard"] for r in kdtree.assign(same, shards=24).collect())
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 2
    assert len({r["shard"] for r in kdtree.assign(same, target_bytes=1700).collect()}) == 4


def ranks(path):
    return bpe.read_ranks(path)


def test_bpe_like_the_library(docs, empty):
    own = ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    codec = bpe.Codec(own, public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "一", "Ⅷ", "½", "😀", "𝐀", "́", "​", "!", "'s", "'re", "the", "ing", "9", "٣", "ж", "　", "_", "\x00", "🇩", "İ"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert codec.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 5_000):
        assert codec.encode(text) == library.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    found = {r["doc_id"]: r for r in bpe.digest(docs, VOCABULARY, public_tokenizers.PATTERN).collect()}
    for i, text, _ in collected(docs):
        ids = library.encode_ordinary(text or "")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()} == {i: t or "" for i, t, _ in collected(docs)}
    assert bpe.digest(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole, capped = share * sum(sizes.values()), set()
    while True:
        left = whole - sum(most * sizes[s] for s in capped)
        weights = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / weights for s in names}
        over = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing(docs, empty):
    rows = collected(docs)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for i in size:
        sizes[source[i]] += size[i]
    expect = brute_targets(sizes)
    found = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    taken = Counter()
    for i, r in found.items():
        assert (r["size"], r["source_size"]) == (size[i], sizes[source[i]]) and r["target"] == pytest.approx(expect[source[i]]) and 0 <= r["taken"] <= 2 * size[i]
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - expect[s]) <= 1 for s in expect)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()} == {i: r["taken"] for i, r in found.items()}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({i: r["taken"] for i, r in found.items() if r["taken"]})


def test_separator_scan(spark, docs, empty, tmp_path):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(ENGLISH), special_tokens={})
    found = {r["doc_id"]: r["n_tokens"] for r in separators.counts(docs, ENGLISH, public_tokenizers.PATTERN, END_OF_DOCUMENT).collect()}
    assert found == {i: len(library.encode_ordinary(t or "")) for i, t, _ in collected(docs)}
    assert separators.counts(empty, ENGLISH, public_tokenizers.PATTERN, END_OF_DOCUMENT).count() == 0
    rng = np.random.default_rng(2)
    for n, data in enumerate([rng.choice([7, 1, 2, 3], 997, p=[0.1, 0.3, 0.3, 0.3]), np.array([7, 7, 1]), np.array([1, 2]), np.zeros(300)]):
        data.astype("<u2").tofile(tmp_path / f"f{n}.tok")
        expect, begun = [], 0
        for k in [*np.flatnonzero(data == 7).tolist(), None]:
            if k is not None or begun < len(data):
                expect.append((begun, (len(data) if k is None else k) - begun, k is not None))
            begun = begun if k is None else k + 1
        for block in (1, 5, 64, 2000):
            got = separators.scan(spark, str(tmp_path), 7, block_tokens=block).where(F.col("file") == f"f{n}.tok").orderBy("ordinal").collect()
            assert [(r["start"], r["n_tokens"], r["ended"]) for r in got] == expect and [r["ordinal"] for r in got] == list(range(len(expect)))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1020, [], 1), (None, x[0].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    queries = table.where("vec_id % 20 = 0").select("vec_id")
    found = defaultdict(list)
    for r in nndescent.search(table, queries, k=20).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 400, 20))
    wide, hits = x.astype(np.float64), 0
    for q, got in found.items():
        scores = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:20]
        hits += len(set(order) & {i for i, _ in got})
        assert len(got) == 20 and all(s == pytest.approx(scores[i]) for i, s in got)
    assert hits >= 0.95 * 20 * len(found)
    assert [i for i, _ in found[60]][:20] == [i for i in range(50, 71) if i != 60]
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in nndescent.search(few, few.where("vec_id = 20")).orderBy("rank").collect()] == [1, 2]
    assert nndescent.search(table.where("false"), queries).count() == 0


def labelled(spark):
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic, bad = i % 6 == 0, i % 5 == 1
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["slurish", "nasty", "vileword", "grubby"]))
        if bad:
            words = [w for w in words[:20] for _ in range(5)] if i % 2 else [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
        if i < 700:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", "s1"), (1001, "", "en", "s1")]
    return make(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, empty):
    table, labels = labelled(spark)
    rows = toxicity.severity(table, labels).collect()
    assert len(rows) == table.count()
    wrong = sum(r["toxic"] != (r["doc_id"] % 6 == 0) for r in rows if 700 <= r["doc_id"] < 900)
    assert wrong <= 4
    for r in rows:
        above = [r["p_above_0"], r["p_above_1"], r["p_above_2"]]
        assert above == sorted(above, reverse=True) and r["severity"] == pytest.approx(sum(above))
    sets, grades = [np.array([1])] * 3, np.zeros(3, int)
    assert toxicity.fit(sets, grades, steps=5).thresholds.size == 1
    assert toxicity.severity(empty, labels).count() == 0


def test_quality_on_held_out_rows(spark):
    table, labels = labelled(spark)
    model = quality.fit(table, labels)
    rows = {r["doc_id"]: r for r in quality.score(table, model).collect()}
    wrong = sum(rows[i]["keep"] != (i % 5 != 1) for i in range(700, 900))
    assert wrong <= 4 and len(rows) == 902
    kept = quality.kept(table, model)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["keep"]}
    assert quality.kept(table.where("false"), model).count() == 0


@pytest.mark.parametrize("order", ["sorted", "interleaved"])
def test_quality_whatever_the_order_of_the_labels(spark, order):
    rng = random.Random(9)
    bad = sorted(i % 5 == 0 for i in range(600)) if order == "sorted" else [i % 5 == 0 for i in range(600)]
    table = make(spark, [(i, " ".join(f"word{rng.randrange(300)}" + "#$" * b for _ in range(40)), "en", "s1") for i, b in enumerate(bad)]).coalesce(1)
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i % 3], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r["keep"] for r in quality.score(table, quality.fit(table, labels)).collect()}
    assert sum(rows[i] == bad[i] for i in range(0, 600, 3)) <= 2


def test_quality_without_both_classes(spark, empty):
    table = make(spark, [(i, f"some words {i}", "en", "s1") for i in range(20)] + [(3, "again", None, None), (None, "x", "en", "s")])
    for quality_of in ([], [1] * 9, [0] * 9):
        labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality_of)], "doc_id long, quality int, toxic int")
        rows = quality.classify(table, labels).collect()
        assert len(rows) == 22 and all(r["keep"] == 1 and r["score"] == 0.5 for r in rows)
    assert quality.classify(empty, labels).count() == 0
    y, keys = np.array([0] * 10 + [1] * 50), np.arange(60)
    assert np.bincount(y[quality.held_out(y, keys)]).tolist() == [2, 10] and quality.held_out(y[5:], keys[5:]).all()


def test_quality_hands_over_the_surest_of_all_documents(spark):
    """The counts that the views exchange, against plain ones over every row without a sampled label."""
    rng = random.Random(4)
    table = make(spark, [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", None]), f"s{i % 7}") for i in range(500)])
    made = quality.features(table).cache()
    rows = [(r["key"], np.frombuffer(r["text"], np.uint16), np.frombuffer(r["meta"], np.uint16)) for r in made.collect()]
    draw = np.random.default_rng(1)
    views = tuple(quality.View(draw.normal(0, 2, width + 2), draw.normal(0, 1, width)) for width in quality._WIDTHS)
    sampled = np.array([r[0] for r in rows[:50]])
    found = quality._handed(made, views, sampled, 0.2, 0.6)
    pool = [r for r in rows if r[0] not in set(sampled.tolist())]
    logit = lambda v, at: views[v].weights[:-2][at].sum() + views[v].weights[-2] * views[v].ratios[at].mean() + views[v].weights[-1]
    for v in (0, 1):
        z = np.array([logit(1 - v, r[2 - v]) for r in pool])
        low, high = np.sort(z)[int(0.2 * 0.4 * len(z)) - 1], np.sort(z)[len(z) - int(0.2 * 0.6 * len(z))]
        step = 2 * quality._LOGIT_MOST / quality._LOGIT_BINS  # rows within a bin of the limit may fall to either side
        for slack, within in ((-step, np.less_equal), (step, np.greater_equal)):
            counts = np.zeros_like(found[v])
            for r, x in zip(pool, z, strict=True):
                for label, sure in enumerate((x <= min(low, -2.2) + slack, x >= max(high, 2.2) - slack)):
                    if sure:
                        counts[r[v + 1], label] += 1
                        counts[-1, label] += 1
            assert within(counts, found[v]).all() and counts.any()


def test_quality_sees_the_words_of_long_texts(spark):
    rng = random.Random(3)
    words = [[f"{c}{'abcdefghij'[k // 26]}{'abcdefghijklmnopqrstuvwxyz'[k % 26]}" for k in range(200)] for c in "xy"]
    bad = [rng.random() < 0.5 for _ in range(400)]
    table = make(spark, [(i, " ".join(rng.sample(words[b], 150)), "en", "s1") for i, b in enumerate(bad)])
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i < 300], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r["keep"] for r in quality.score(table, quality.fit(table, labels)).collect()}
    assert sum(rows[i] == bad[i] for i in range(300, 400)) <= 2


def test_quality_counts_every_upper_case_word():
    words = ["low"] * 1200
    quiet = quality.text_features(" ".join(words))
    for i in range(1200):
        if i % 6:
            words[i] = "LOW"
    place = lambda x: [i for i in x if i >= quality.TEXT_WIDTH - quality._BINS]
    assert place(quiet) != place(quality.text_features(" ".join(words)))


def test_pipeline_stages(spark, tmp_path):
    table, labels = labelled(spark)
    extra = make(spark, [(2000, table.where("doc_id = 2").first()["text"] + " extra", "en", "s0"), (2001, "write a@b.co or john (at) mail (dot) com " + " ".join(f"k{i}" for i in range(40)), "en", "s2")])
    table.unionByName(extra).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {r["doc_id"] for r in seen["quality_classifier"].collect()}
    assert {i for i in range(700, 900) if i % 5 == 1} - good and 2000 in good
    once = {r["doc_id"] for r in seen["ngram_jaccard_join"].collect()}
    assert 2 in once and 2000 not in once and 2001 in once
    assert seen["pii"].where("doc_id = 2001").first()["text"].startswith("write [EMAIL] or [EMAIL] k0")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(VOCABULARY), special_tokens={})
    mixed = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"]))) for r in seen["mixing"].collect())
    assert mixed == Counter((r["doc_id"], tuple(r["ids"])) for r in seen["byte_bpe"].collect())


def test_bpe_splits_every_code_point_like_the_library():
    own = ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    codec = bpe.Codec(own, public_tokenizers.PATTERN)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for start in range(0, len(every), 2_000):
        text = "".join(f"a{c}1{c} {c}." for c in every[start : start + 2_000])
        assert codec.encode(text) == library.encode_ordinary(text), hex(start)


@pytest.mark.parametrize("part", [" ", "\t", "(", "( ", "[at", " at ", "@a.", "1 ", "+1(", "one, ", "dot ", "plus ", "a dot ", "x at y.z "])
def test_pii_is_linear_in_the_text(part):
    text = "(at) @ one two three four dot " + part * (300_000 // len(part))
    began = time.process_time()
    pii.scan(text)
    assert time.process_time() - began < 10


def test_pii_names_at_hosts():
    kinds = lambda text: [(s.kind, text[s.start : s.end]) for s in pii.scan(text)[1]]
    assert kinds("ask j.doe at example.com or jdoe7 at mail.example.org") == [("email", "j.doe at example.com"), ("email", "jdoe7 at mail.example.org")]
    assert kinds("look at example.com today, 15 at example.com") == []
    assert kinds("to john ((at)) example <dot> com") == [("email", "john ((at)) example <dot> com")]
    assert kinds("plus 4 nine 1 five 1 two 3 four 5 six 7") == [("phone", "plus 4 nine 1 five 1 two 3 four 5 six 7")]
    assert kinds("one dot two dot three dot four") == [("ip", "one dot two dot three dot four")]


def test_shards_tell_whole_names_apart(spark):
    """Sources that begin alike are different values: each half of the tree holds one."""
    table = make(spark, [(i % 7, "same text", "en", f"newspaper-{'ab'[i % 2]}") for i in range(80)])
    rows = kdtree.rows_of(table).collect()
    assert Counter(r["by_source"] for r in rows) == {0.0: 40, 1.0: 40}
    nulls = kdtree.rows_of(make(spark, [(1, None, None, None), (2, "x", "de", "s"), (None, "y", "en", "s")])).collect()
    assert sorted((r["by_source"], r["by_lang"]) for r in nulls) == [(-1.0, -1.0), (0.0, 0.0), (0.0, 1.0)]
    assert kdtree.assign(make(spark, [(None, None, None, None)] * 5), shards=2).count() == 5


CLASHING = ["epochs", "cut", "_source", "_size", "_key", "_words", "_kept", "_times", "query_id", "rank", "score", "key", "grp", "_id", "id", "node"]


def test_columns_with_clashing_names(spark, docs):
    wide = docs.withColumns({c: F.lit(7) for c in CLASHING})
    mixed = mixing.mixed(wide)
    assert mixed.columns == wide.columns
    assert all(r[c] == 7 for r in mixed.collect() for c in CLASHING)
    once = jaccard.representatives(wide)
    assert once.columns == wide.columns and sorted(str(r["doc_id"]) for r in once.collect()) == sorted(str(r["doc_id"]) for r in jaccard.representatives(docs).collect())
    assert mixing.mix(wide).count() == docs.count() and lz.edited_likeness(wide).count() == docs.count() and kdtree.assign(wide, shards=3).count() == docs.count()
    assert bpe.digest(wide, VOCABULARY, public_tokenizers.PATTERN).count() == docs.count() and pii.redact(wide).columns == wide.columns
    assert separators.counts(wide, ENGLISH, public_tokenizers.PATTERN, END_OF_DOCUMENT).count() == docs.count()
    labels = spark.createDataFrame([(i, i // 10 % 2, i // 10 % 2) for i in range(0, 300, 10)], "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    assert quality.classify(wide, labels).count() == docs.count() and quality.kept(wide, quality.fit(wide, labels)).columns == wide.columns
    assert toxicity.severity(wide, labels).count() == docs.count()


def test_very_long_texts_and_repeated_rows(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(800_000))  # five megabytes
    table = make(spark, [(1, long, "en", "s1"), (1, long, "en", "s1"), (2, long + " and more", "en", None), (3, "short text of few words", "de", "s1")])
    found = sorted((r["doc_id"], r["component_id"]) for r in jaccard.classes(table).collect())
    assert found == [(1, 1), (1, 1), (2, 1), (3, 3)]
    digests = {r["doc_id"]: r["decoded_sha256"] for r in bpe.digest(table, VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert digests[1] == hashlib.sha256(long.encode()).hexdigest()
    assert {r["n_email"] for r in pii.digest(table).collect()} == {0}
    taken = mixing.mix(table).collect()
    assert len(taken) == 4 and sum(r["size"] for r in taken) == 3 * 800_000 + 7
    assert sorted(r["n_tokens"] for r in separators.counts(table, ENGLISH, public_tokenizers.PATTERN, END_OF_DOCUMENT).collect())[0] == 5


def test_toxicity_without_both_classes(spark):
    table = make(spark, [(i, f"some words {i}", "en", "s1") for i in range(20)] + [(3, "again", None, None), (None, None, "en", "s")])
    for toxic in ([], [0] * 9, [1] * 9):
        labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
        rows = toxicity.severity(table, labels).collect()
        assert len(rows) == 22 and all(np.isfinite(r["severity"]) for r in rows)
        if not any(toxic):
            assert not any(r["toxic"] for r in rows)


def recall(spark, x, queries, k=20):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(int(i),) for i in queries], "vec_id long")
    found = defaultdict(list)
    for r in nndescent.search(rows, asked, k=k).collect():
        found[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in queries:
        scores = x @ x[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-k]
        hits += sum(scores[i] >= least for i in found[q])
        assert len(found[q]) == k == len(set(found[q]))
    return hits / (k * len(queries))


def test_nearest_neighbours_among_near_copies_and_of_odd_norms(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(32)
    near = centre + 0.002 * rng.standard_normal((1500, 32)) * np.linalg.norm(centre)  # similarities above 0.999
    near /= np.linalg.norm(near, axis=1)[:, None]
    other = rng.standard_normal((1500, 32))
    other /= np.linalg.norm(other, axis=1)[:, None]
    assert recall(spark, np.concatenate([near, other]), range(0, 3000, 60)) >= 0.95
    other[7] *= 300  # one vector much longer than all others
    assert recall(spark, other, range(0, 1500, 30)) >= 0.95


def test_nearest_neighbours_of_several_lengths_and_repeated_ids(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(30)] + [(100 + i, [1.0, float(i)]) for i in range(5)] + [(3, [9.0, 9.0, 9.0]), (200, [5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query_id", F.lit(1)).withColumn("rank", F.lit(2))
    found = nndescent.search(table, table.where("vec_id IN (0, 100, 200)").select("vec_id"), k=20)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100}  # a vector alone among its length has no neighbours
    assert [i for i, _ in got[100]] == [101, 102, 103, 104] or [i for i, _ in got[100]] == [104, 103, 102, 101]
    assert len(got[0]) == 20 and all(i < 30 for i, _ in got[0])
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
