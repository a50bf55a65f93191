"""Operators of the llm subpackage against brute force, round trips and held-out accuracy, on small tables."""

import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from sievelight.llm import ann, attention, benchmark, decontaminate, jaccard, langid, lm, mixing, mixture, near, quality, seekable, urls, warc
from sievelight.llm.components import connected_components
from sievelight.llm.work import Work

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """Brute force over all pairs of (id, text)."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    least = {i: i for i, _ in rows}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    for _ in rows:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
        if not moved:
            break
    return {(i, len(s), least[i]) for i, s in sets}


def frame(spark, rows, extra="x"):
    return spark.createDataFrame([(i, t, None, "s", 0, extra) for i, t in rows], EMPTY + ", region string")


def planted(n=160, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [r.choice(vocab) for _ in range(60)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  two"), (1005, "a b c d e"), (1006, "x " * 50)]
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join([r.choice(vocab) for _ in range(25)] + passage)) for i in range(60)]
    return rows


@pytest.mark.parametrize("leaf, block", [(64, 2048), (2, 2048), (2, 16)])
def test_jaccard_join_is_exact(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = planted(90)
    got = jaccard.jaccard_components(frame(spark, rows))
    assert {tuple(r) for r in got.collect()} == components(rows)


def test_jaccard_join_of_edge_cases(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], EMPTY)).count() == 0
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]
    assert sorted(tuple(r) for r in jaccard.jaccard_components(frame(spark, twice)).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(9, 9), (None, 4)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Work(spark)).collect()}
    least = {v: v for e in edges for v in e if v is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    assert got == {k: v for k, v in least.items() if k in got} and len(got) > 200


def contamination(docs, items):
    import re

    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(len(w) - 12, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = set()
    for i, t in docs:
        w = cut(t)
        hit, who = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    who |= wins[tuple(w[k : k + n])]
        out.add((i, len(w), len(hit), len(who), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark):
    r = random.Random(2)
    v = [f"v{i}é" for i in range(40)]
    items = [(i, " ".join(r.choice(v) for _ in range(n))) for i, n in enumerate((30, 13, 14, 3, 1))] + [(7, None), (8, "--")]
    docs = [(i, " ".join(r.choice(v) for _ in range(50))) for i in range(20)] + [(50 + i, "Pre, " + t.upper().replace("É", "é") + "; post " * (40 * i)) for i, t in items[:5]] + [(90, None), (91, ""), (92, items[0][1] + " " + items[0][1])]
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in got.collect()} == contamination(docs, items)
    none = decontaminate.decontaminate(frame(spark, docs[:3]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert all(not x.contaminated and x.items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" for x in none)


def test_proximity(spark):
    docs = frame(spark, [(1, "red a b blue c green"), (2, "red " + "x " * 30 + "blue green"), (3, "green blue red")])
    wanted = spark.createDataFrame([(["red", "blue", "green"],)], "phrase array<string>")
    assert {r.doc_id for r in decontaminate.proximity(docs, wanted, 6, Work(spark)).collect()} == {1, 3}


def test_language_id(spark):
    out = langid.identify(spark.read.parquet(f"{SF}/documents.parquet"))
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(truth, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.95 * held.count() > 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "The thing")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, {"en": np.ones(langid.DIMENSION) / 9, "fr": -np.ones(langid.DIMENSION) / 9}).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und" and 0 <= got[4][1] <= 1
    assert langid.predict(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_trigram_vectors_add_up():
    s, text = langid.Space(), "Hello, wörld 中文! " * 3
    v, n = s.vectors([text])
    codes = s._codes(text)
    assert n[0] == len(codes) and np.allclose(v[0], sum(s._gram(int(c)) for c in codes), atol=1e-3)


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest has too few labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("held_out", langid.held_out())
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(docs, quality.learn(docs.where("not held_out"), labels.where(~langid.held_out()))).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    odd = spark.createDataFrame([(1, None, True), (2, "", True)], "doc_id long, text string, held_out boolean")
    assert all(r.score == 0.5 for r in quality.score(odd, None).collect())
    assert quality.learn(docs.limit(0), labels) is None


def test_prior_estimate():
    r = np.random.default_rng(0)
    p, n = r.normal(2, 1, 4000), r.normal(-2, 1, 4000)
    assert abs(quality.estimate_prior(p, np.concatenate([p[:1200], n[:2800]])) - 0.3) < 0.1


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = [(i, [float(v) for v in r.normal(size=16)]) for i in range(400)] + [(1000 + i, [1.0] * 16) for i in range(60)]
    x += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [float("inf")] * 16)]
    got = ann.nearest(spark.createDataFrame(x, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    ok = {i: np.float32(v).astype(float) for i, v in x if i < 5000}
    for q in [i for i in ok if i % 20 == 0]:
        best = sorted(((-float(ok[i] @ ok[q]), i) for i in ok if i != q))[:20]
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == [i for _, i in best]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_forest_recall():
    e = ds.dataset("/root/testdata/sf0.1/embeddings.parquet").to_table().to_pandas()
    x = np.stack(e["embedding"]).astype(float)
    q, hit = x[::20], 0
    for v, (c, s) in zip(q, ann.Forest(x, 1.0).best(q, 21, enough=1900)):
        hit += len(set(c[np.argsort(-s)[:20]]) & set(np.argsort(-(x @ v))[:20]))
    assert hit >= 0.9 * 20 * len(q)


def test_forest_recall_at_production_parameters():
    """A full shard of random directions: nothing closer than 60 degrees, the least favourable case."""
    r = np.random.default_rng(4)
    x = r.standard_normal((ann.SHARD, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, hit, most = x[::160], 0, 0
    f = ann.Forest(x, 1.0)
    for v, c in zip(q, f.candidates(q)):
        s = x[c] @ v
        hit += len(set(c[np.argsort(-s)[1:21]]) & set(np.argsort(-(x @ v))[1:21]))
        most = max(most, len(c))
    assert hit >= 0.9 * 20 * len(q) and most <= 0.0501 * len(x)


def test_forest_stops_deep_where_neighbours_are_close():
    r = np.random.default_rng(5)
    centres = r.standard_normal((32, 64))
    x = np.repeat(centres, 256, axis=0) + 0.05 * r.standard_normal((32 * 256, 64))
    f = ann.Forest(x, float(np.linalg.norm(x, axis=1).max()))
    for i, (v, (c, s)) in enumerate(zip(x[::512], f.best(x[::512], 20))):
        assert set(np.argsort(-(x @ v), kind="stable")[:20]) <= set(c)


def test_nearest_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 2000)
    monkeypatch.setattr(ann, "BLOCK", 30)
    r = np.random.default_rng(2)
    x = r.standard_normal((5000, 24)) * r.uniform(0.5, 1.5, (5000, 1))
    x[10::50] = x[0]
    rows = [(i, [float(c) for c in v], "q", i, "b") for i, v in enumerate(x)] + [(20, [float(c) for c in x[20]], "q", 20, "b")] * 2 + [(None, [1.0] * 24, "q", 0, "b"), (-20, [2.0, 1.0], "q", 0, "b")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>, score string, shard int, ids string"), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, -g.score, g.vec_id))
    assert len(by) == 250 and -20 not in by
    hit = 0
    for q, mine in by.items():
        mine.sort()
        best = sorted((-float(x[i] @ x[q]), i) for i in range(5000) if i != q)[:20]
        hit += len({i for _, i in best} & {i for _, _, i in mine})
        assert all(abs(-float(x[i] @ x[q]) - s) < 1e-9 for _, s, i in mine)
        if q != 20:
            assert [m[0] for m in mine] == list(range(1, 21)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert hit >= 0.9 * 20 * len(by)
    with pytest.raises(TypeError):
        ann.nearest(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))


def test_jaccard_join_divides_regions_at_production_parameters(spark):
    """Near copies on both sides of the radius, more than a block holds, so that regions are divided into cells."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(jaccard.BLOCK + 700):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    divided = []
    cells = jaccard._cells
    jaccard._cells = lambda *a: divided.append(1) or cells(*a)
    try:
        got = {tuple(x) for x in jaccard.jaccard_components(frame(spark, rows)).collect()}
    finally:
        jaccard._cells = cells
    assert got == fast_components(rows) and divided


def fast_components(rows):
    """Brute force over all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    names, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            names.setdefault(g, []).append(i)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in names[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join_of_long_texts_nulls_and_names(spark):
    long = " ".join(f"l{i}" for i in range(250_000))
    rows = [(1, long), (2, long + " tail"), (None, "a b c d e f g"), (3, "a b c d e f g"), (None, "alone in the world it is")]
    docs = frame(spark, rows).withColumns({n: F.lit(1) for n in ("point", "key", "n", "part", "set", "opens")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 249_996, 1), (2, 249_997, 1), (None, 3, 3), (3, 3, 3), (None, 2, None)], key=str)


def test_warc():
    block = b"HTTP/1.1 404 Gone\r\nContent-Type: text/html; charset=latin-1\r\nX: y\r\n\r\n<html><head><title>T&amp;t</title><style>p{}</style></head><p>caf\xe9<script>no</script><!-- no --> a<br>b</p>"
    meta, conv = warc.derive("<urn:x>", "http://a/", "2020-01-01T00:00:00Z", block)
    assert meta[0] == "metadata" and conv[0] == "conversion" and meta[2] == conv[2] == "<urn:x>" and meta[1] != conv[1]
    assert conv[-1].decode() == "T&t\ncafé\na\nb" and meta[6] == 404 and b"http-x: y" in meta[-1]
    assert conv[8] == warc.digest(block.partition(b"\r\n\r\n")[2]) and conv[9] == warc.digest(conv[-1])
    assert [r[0] for r in warc.derive("", None, None, b"")] == ["metadata", "conversion"]


def test_warc_records_and_files(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rec = warc.derivatives(warc.responses(pages))
    assert rec.count() == 6 and rec.where("record_type = 'conversion' and source_id = 1").first().block == b"x"
    folder = Work(spark).path("warc")
    files = warc.write_warc(rec, folder).collect()
    assert sum(f.records for f in files) == 6


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://A.net/x", None), (2, "http://q.org/a", link.format("http://a.net/x#y")), (3, "http://r.org/b", '<meta http-equiv=refresh content="0; url=http://q.org/a">'),
        (4, "http://example.net/en/1", link.format("http://r.org/b")), (5, None, "x"), (6, "no scheme", None), (7, "http://z.org/fr/1", link.format("http://y.org/")), (8, "http://y.org/", link.format("http://a.net/q")), (9, "http://w.org/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[4][2:] == ("example.net/en/", "allow")
    assert got[2][2:] == got[3][2:] == (None, "allow")  # an alias is allowed explicitly
    assert got[7][2:] == ("org/fr/", "allow") and got[8][3] == "allow" and got[9] == ("w.org", "/", None, "allow") and got[5] == ("", "", None, "allow") == got[6]
    two = spark.createDataFrame([(1, "http://a.net/x", None), (2, "http://q.org/a", link.format("http://a.net/x"))], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(two).collect()} == {1: "block", 2: "block"}


def test_urls_of_many_redirects(spark):
    """Chains, cycles, hubs and trees of aliases against union-find."""
    r = random.Random(6)
    names = [f"http://h{i}.{r.choice(['net', 'org', 'info'])}/{r.choice(['fr/', 'x/', ''])}{i}" for i in range(400)]
    to = {}
    for i in range(399):
        kind = i // 100
        to[i] = i + 1 if kind == 0 else 100 if kind == 1 else 200 + (i + 1 - 200) % 7 if kind == 2 and i < 207 else r.randrange(300, 400) if kind == 3 else None
    rows = [(i, u, None if to.get(i) is None else f'<link rel="canonical" href="{names[to[i]]}">', "c", "n", "h") for i, u in enumerate(names)]
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in to.items():
        if j is not None:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    rule = lambda u: "allow" if ".org/fr/" in u else "block" if ".net/" in u else None
    shared = {}
    for i, u in enumerate(names):
        if rule(u):
            shared.setdefault(root(i), set()).add(rule(u))
    want = {i: rule(u) or ("allow" if "allow" in shared.get(root(i), ()) else "block" if shared.get(root(i)) else "allow") for i, u in enumerate(names)}
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string, component string, node string, host string")
    got = urls.judge(pages).collect()
    assert len(got) == 403 and {x.page_id: x.verdict for x in got} == want and set(want.values()) == {"allow", "block"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_classifiers_of_odd_tables(spark):
    rows = [(i % 40, "good words here " * (i % 5 + 1) if i % 2 else "zzz ### 000", "en" if i % 2 else "de", "s", 0) for i in range(90)] + [(99, "long " * 200_000, "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, EMPTY).withColumns({"lang_pred": F.lit("x"), "score": F.lit(3), "held_out": F.lit("y")})
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs.limit(0)).count() == 0


def test_token_files(spark, tmp_path):
    path = seekable.vocabulary("word_bpe_49k.json")
    texts = ["it's we'LL (x). thea, THE.", "é 中文 ²½! a‍b", "", "<|endoftext|> a", "word" * 40]
    c = seekable.Chunks(path)
    assert list(c.texts([t.encode() for t in texts])) == [c.whole(t) for t in texts]
    rows = [(i * 3 % 50, t) for i, t in enumerate(texts * 10)] + [(7, None), (None, "x")]
    got = sorted(tuple(r) for r in seekable.token_rows(frame(spark, rows), path).collect() if r.doc_id is not None)
    start, want = 2, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*c.whole(t or ""), 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert seekable.token_rows(spark.createDataFrame([], EMPTY), path).count() == 0


def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = seekable.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|StartOfText|> x <|startoftext|>", "<| endoftext |>", "don't o'clock 'S", "x" * 300 + " y", "w7,! $5.00? " * 400, "\u00a0nb\u2003em", "e\u0301 \u0301"]
    assert list(seekable.Chunks(path).texts([x.encode() for x in texts])) == [t.encode(x, add_special_tokens=False).ids for x in texts]
    with pytest.raises(TypeError):
        seekable.token_rows(spark.createDataFrame([("a", "b")], "doc_id string, text string"), path)


def test_ids_when_memory_is_full(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(seekable, "REMEMBERED", 200)
    monkeypatch.setattr(seekable, "PIECE", 3000)
    path = seekable.vocabulary("word_bpe_49k.json")
    t, c, r = Tokenizer.from_file(path), seekable.Chunks(path), random.Random(5)
    word = lambda: "".join(r.choice("abcdeXYZ\u00e9\u00df0'-") for _ in range(r.randint(1, 9))) + r.choice(["", "", ".", ",!", "$$$"])
    texts = ["", " ", *(" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(60)), "a<|endoftext|>b", "y" * 500 + "\n" + "z" * 70 + " y"]
    texts.append("\t".join(word() for _ in range(4000)))
    for _ in range(2):
        assert list(c.texts([x.encode() for x in texts])) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_worker_encodes_each_chunk_once(monkeypatch):
    c, seen = seekable.Chunks(seekable.vocabulary("word_bpe_49k.json")), []
    many = c.many
    monkeypatch.setattr(c, "many", lambda parts: [seen.extend(parts), many(parts)][1])
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(k, k + 10_000)).encode() for k in range(0, 300_000, 10_000)]
    first, again = ([ids for t in texts for ids in c.packed([t])] for _ in range(2))
    assert first == again and len(seen) == len(set(seen)) == 300_000


def test_token_files_of_long_texts_and_small_files(spark, monkeypatch):
    path = seekable.vocabulary("word_bpe_49k.json")
    monkeypatch.setattr(seekable, "FILE_BYTES", 200)
    rows = [(i, " ".join(f"w{i} x{j}" for j in range(50))) for i in range(40)] + [(90, "long words " * 60_000), (None, "n"), (None, None)]
    files, folder = seekable.token_files(frame(spark, rows), path)
    assert files.count() > files.select("part").distinct().count()
    c = seekable.Chunks(path)
    got = {r.doc_id: (r.start, r.n_tokens) for r in seekable.read(files, folder).collect() if r.doc_id is not None}
    start = 1 + 2  # the null ids' rows
    for i, text in rows[:41]:
        n = len(c.whole(text)) + 1
        assert got[i] == (start, n)
        start += n


def test_a_reader_reads_one_frame_and_checks_it(tmp_path):
    f = tmp_path / "x.zst"
    w = seekable.SeekableWriter(f.open("wb"))
    for i in range(5):
        w.add(i, np.arange(i * 10, dtype="<u4"))
    w.close()
    raw = bytearray(f.read_bytes())
    with f.open("rb") as g:
        assert seekable.SeekableReader(g, len(raw)).tokens(3).tolist() == list(range(30))
    import zstandard

    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) == 400
    raw[len(raw) - 9 - 12 * 2 + 8] ^= 1
    f.write_bytes(raw)
    with f.open("rb") as g, pytest.raises(ValueError):
        seekable.SeekableReader(g, len(raw)).tokens(3)


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 16)
    rows = [(i, f"The cat sat on mat{i % 7} the dog {'x' * (i % 5)}") for i in range(60)] + [(100, None), (101, ""), (102, "Zq zq")]
    docs = frame(spark, rows).withColumn("held_out", langid.held_out(7, 2))
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for t in train:
        for w in [*words(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*words(t), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert got[i].score < 0 and got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_attention_gives_probabilities_and_sees_no_future():
    counts = np.array([5, 3, 9, 0, 1, 4])
    voc = attention.Vocabulary(counts, [np.array([0, 1, 2, 4, 5])])
    net = attention.Attention(voc.sizes())
    pair = lambda ids: (np.concatenate([[1], voc.row[ids[:-1]]]), voc.targets(np.array(ids)))
    before = [2, 0, 1] * 12
    total = 0.0
    for last in range(6):
        lp = net.log_probabilities(*attention.layout([pair(np.array([*before, last]))])) + voc.share[np.array([*before, last])]
        total += math.exp(lp[-1])
        assert np.allclose(lp[:-1], (net.log_probabilities(*attention.layout([pair(np.array([*before, 0]))])) + voc.share[np.array([*before, 0])])[:-1], atol=1e-5)
    assert abs(total - 1) < 1e-4


def test_attention_looks_up_what_it_learns():
    r = np.random.default_rng(0)
    net = attention.Attention(np.full(attention.CLASSES, attention.MEMBERS))
    texts = [(r.integers(0, attention.ROWS, n), r.integers(0, attention.CLASSES * attention.MEMBERS, n)) for n in (1, 15, 16, 17, 90)]
    x, lead, y, real = attention.layout(texts)
    assert np.allclose(net._read(x, lead), net._forward(x, lead)[-1], atol=1e-4)
    loss, g = net.gradients(x, lead, y, real)
    assert math.isclose(loss, -net.log_probabilities(x, lead, y, real).mean(), rel_tol=1e-4)
    for name in ("e", "q", "v", "bias", "u2"):
        w, at = getattr(net, name), np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, losses = w[at], []
        for step in (0.02, -0.02):
            w[at] = old + step
            losses.append(net.gradients(x, lead, y, real)[0])
        w[at] = old
        assert math.isclose((losses[0] - losses[1]) / 0.04, g[name][at], rel_tol=0.05, abs_tol=1e-4)
    again = attention.Attention.of(net.state())
    again.load(net.flat())
    assert np.array_equal(again.flat(), net.flat())


def test_language_model_learns_from_all_training_texts(spark):
    path = seekable.vocabulary("word_bpe_49k.json")
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["red fox ran", "blue bird sang", "old man sat"]) for _ in range(60))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "the " * 150_000), (1003, "fox red ran man bird " * 36), (1004, "red fox ran " * 60), (1004, "red fox ran " * 60), (None, "x")]
    docs = frame(spark, rows).withColumn("held_out", F.coalesce(langid.held_out(7, 2), F.lit(False)))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = lm.windows(docs.where("doc_id < 1003"), path, *none, 49408)
    n = cut.agg(F.sum(F.length("ids") / 4)).first()[0]
    every = sum(len((t or "").split()) + 1 for i, t in rows[:303])
    assert 0.5 * every / lm.RATE < n < 2 * every / lm.RATE
    got = {}
    for x in lm.score(docs).collect():
        got.setdefault(x.doc_id, []).append(x.score)
    assert len(got[1004]) == 2 and got[1004][0] == got[1004][1] and len(got[None]) == 1
    assert got[1004][0] > got[1003][0]  # known order of words against another, of the same words
    empty = docs.limit(0)
    assert lm.score(empty).count() == 0
    untaught = lm.score(docs.where("held_out")).collect()
    assert len(untaught) == docs.where("held_out").count() and all(x.train_tokens == 0 and x.score <= 0 for x in untaught)


def test_every_training_token_is_in_one_window(spark, monkeypatch):
    monkeypatch.setattr(lm, "WINDOW", 32)
    path, end = seekable.vocabulary("word_bpe_49k.json"), 49408
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["red", "Fox", "ran,", "\u00fcber", "zqxv"]) for _ in range(n))) for i, n in enumerate([0, 1, 31, 32, 33, 95, 700])] + [(7, None)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = {}
    for w in lm.windows(frame(spark, rows), path, *none, end).collect():
        got.setdefault(w.key, []).append((w.start, w.before, np.frombuffer(w.ids, "<u4").tolist()))
    found = []
    for runs in got.values():
        whole = []
        for start, before, ids in sorted(runs):
            assert start == len(whole) and before == (whole[-1] if whole else -1)
            whole += ids
        found.append(whole)
    heads = {w: int(lm.Heads.named(path).of(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for _, t in rows for w in (t or "").split()}
    assert sorted(found) == sorted([*(heads[w] for w in (t or "").split()), end] for _, t in rows)


def test_the_model_learns_from_each_window(spark, monkeypatch):
    r = np.random.default_rng(0)
    voc = attention.Vocabulary(np.full(50, 9))
    cut = spark.createDataFrame([(i, 0, -1, bytearray(r.integers(0, 49, 20).astype("<u4").tobytes())) for i in range(200)], "key long, start long, before long, ids binary").coalesce(2)
    monkeypatch.setattr(lm, "GROUP", 1000)
    whole = lm.fitted(voc, cut)
    for rest in (cut.where("key != 7"), cut.where("key != 150")):  # any window, left out, changes the model
        assert not np.array_equal(whole.flat(), lm.fitted(voc, rest).flat())
    assert np.array_equal(whole.flat(), lm.fitted(voc, cut.repartition(5)).flat())


def test_heads_of_words():
    from tokenizers import Tokenizer

    path = seekable.vocabulary("word_bpe_49k.json")
    t, h = Tokenizer.from_file(path), lm.Heads(path)
    words = ["the", "THE", "b.", "a", "\u00fcber", "zqx", "(x", "\u4e2d\u6587", "catsandzq"]
    raw = [w.encode() for w in words]
    n = np.array([len(x) for x in raw])
    got = [t.id_to_token(int(i)) for i in h.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n)]
    vocab = t.get_vocab()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
    for x, piece in zip(raw, got):
        s = "".join(char[b] for b in x.lower())
        assert piece == (s + "</w>" if s + "</w>" in vocab else max((s[:k] for k in range(1, len(s) + 1) if s[:k] in vocab), key=len))


def test_a_table_finds_what_was_added():
    from sievelight.llm.words import Table

    r = np.random.default_rng(0)
    keys = np.unique(np.concatenate([r.integers(1, 2**63, 900, dtype=np.uint64), np.arange(1, 100, dtype=np.uint64) << np.uint64(40), [np.uint64(0)]]))
    t = Table(len(keys))
    at = t.add(keys)
    found, here = t.find(np.concatenate([keys, r.integers(1, 2**63, 500, dtype=np.uint64)]))
    assert len(set(at.tolist())) == len(keys) and np.array_equal(found[: len(keys)], at) and here[: len(keys)].all() and not here[len(keys) :].any()
    with pytest.raises(ValueError):
        t.add(np.array([5], np.uint64))


def test_windows_score_each_token_once():
    counts = np.arange(1, 200)
    voc = attention.Vocabulary(counts)
    model = lm.Model(voc, attention.Attention(voc.sizes()))
    r = np.random.default_rng(1)
    ids = r.integers(0, 198, 100)
    whole = np.append(ids, voc.end)
    total = 0.0
    for i in range(len(whole)):  # each token by itself, with the block before its own and its block up to it as context
        lo = max(0, i // attention.STRIDE * attention.STRIDE - attention.STRIDE)
        x, y = lm.paired(voc, whole[lo : i + 1], int(whole[lo - 1]) if lo else -1)
        total += model.net.log_probabilities(*attention.layout([(x, y)]))[-1] + voc.share[whole[i]]
    assert math.isclose(model.score([ids])[0], total / math.log(10), rel_tol=1e-4)


def test_scores_do_not_depend_on_neighbours():
    r = np.random.default_rng(4)
    voc = attention.Vocabulary(np.arange(2000, 0, -1), [r.integers(0, 1990, 500)])
    model = lm.Model(voc, attention.Attention(voc.sizes()))
    texts = [r.integers(0, 1990, n) for n in r.integers(0, 700, 60)] + [r.integers(0, 1990, 20000)]
    together = model.score(texts)
    assert np.array_equal(together, np.array([model.score([t])[0] for t in texts])) and np.array_equal(together, model.score(texts[::-1])[::-1])
    v = r.normal(size=50)
    bounds = np.array([0, 0, 7, 7, 30, 50, 50])
    assert np.allclose(lm._sums(v, bounds), [v[a:b].sum() for a, b in zip(bounds, bounds[1:])])


def test_products_of_scores_are_exact_in_any_order(monkeypatch):
    r = np.random.default_rng(6)
    voc = attention.Vocabulary(np.arange(2000, 0, -1), [r.integers(0, 1990, 500)])
    net = attention.Attention(voc.sizes())
    seen, logs = [], attention._logs
    monkeypatch.setattr(attention, "_logs", lambda w, b, rows, y: [seen.append((w, rows)), logs(w, b, rows, y)][1])
    net.log_probabilities(*attention.layout([lm.paired(voc, r.integers(0, 1990, n)) for n in (1, 40, 700)]))
    assert seen
    for w, rows in seen:
        exact = rows.astype(float) @ w.T.astype(float)
        for order in (np.arange(w.shape[1]), r.permutation(w.shape[1])):
            z = np.zeros(exact.shape, np.float32)
            for k in order:
                z += rows[:, k, None] * w[:, k]
            assert np.array_equal(z, exact)
    w, b, rows, y = *(r.integers(-9, 9, s).astype(np.float32) / 8 for s in ((64, 24), 64, (50, 24))), r.integers(0, 64, 50)
    assert np.array_equal(logs(w, b, rows, y), np.concatenate([logs(w, b, rows[i : i + 1], y[i : i + 1]) for i in range(50)]))


def test_sums_of_tasks_are_few_rows(spark):
    parts = [np.random.default_rng(i).integers(0, 9, 10_000) for i in range(5)]
    parts[0][:5000] = 0
    rows = [r for x in parts for r in lm._packed(x).to_pylist()]
    assert len(rows) == 14  # runs of zeros aren't sent
    packed = spark.createDataFrame([(r["at"], bytearray(r["x"])) for r in rows], "at long, x binary")
    assert np.array_equal(lm._total(packed, 10_000, np.int64), sum(parts)) and not lm._total(packed.limit(0), 7, float).any()


def test_gradients_hold_no_subnormal_numbers():
    z = np.random.default_rng(7).normal(size=(300, 64)).astype(np.float32)
    z[:, 60:] = attention._NO  # places without ids
    p = np.exp(z.astype(float))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(300), np.arange(300) % 60] -= 1
    _, g = attention._softmax_gradient(z, np.arange(300) % 60, 4096)
    assert np.allclose(g, p / 4096, atol=1e-9) and not ((g != 0) & (np.abs(g) < np.finfo(np.float32).tiny)).any()


def test_no_part_of_the_order_is_heavy(spark):
    u = (F.xxhash64("id") / float(2**64) + 0.5).alias("u")
    for weight in (0.05, 0.1, 1.0):
        keys = spark.range(200_000).select((-F.log(u) / weight).alias("key"))
        octave = (F.log2(F.greatest(F.col("key"), F.lit(2.0**mixing.LOW))) - mixing.LOW) / (mixing.HIGH - mixing.LOW)
        place = F.least(F.floor(octave * mixing.BINS**2), F.lit(mixing.BINS**2 - 1))
        assert keys.groupBy(place.alias("p")).count().agg(F.max("count")).first()[0] < 20


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 40))), r.choice(["a", "a", "a", "b", "ç", None])) for i in range(400)] + [(900, None, "a"), (901, "", "d"), (5, "x y", "b"), (5, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        taken = sum(x.copies * x.size for x in own)
        assert own[0].source_size == sum(x.size for x in own) and 0 <= own[0].target - taken <= 2 * max(x.size for x in own)
        assert own[0].target <= 2 * own[0].source_size + 1e-6 and all(x.copies <= 2 for x in own)
    assert abs(sum({x.source: x.target for x in got}.values()) - 1.5 * sum(x.size for x in got)) < 1e-3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_splits_equal_rows_and_keeps_columns(spark):
    rows = [(i, " ".join("w" for _ in range(10)), "a") for i in range(50)] + [(99, "ten " * 10, "a")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, share=1.4).collect()
    assert len(got) == len(rows) and sum(r.copies * r.size for r in got) == 70700 and got[0].target == 70700
    assert {r.copies for r in got if r.doc_id != 99} <= {1, 2} and {r.copies for r in got if r.doc_id == 99} == {1, 2}
    names = "_row _key _place _left _at _in _whole _s __x row n key size target copies source_size".split()
    wide = docs.limit(30).withColumns({n: F.lit(n) for n in names})
    out = mixing.mix(wide)
    assert out.count() == 30 and set(names) <= set(out.columns) and out.select("_s", "row").distinct().collect() == [("_s", "row")]
    one = spark.createDataFrame([(None, "x y", "b"), (None, "x z", "b"), (None, None, None)], docs.schema)
    assert sorted(r.size for r in mixing.mix(one).collect()) == [0, 2, 2]


def test_mixing_measures():
    import pyarrow as pa

    rows = ["", None, "a b\u00e9 1!", " x", "y ", "\n\t", "\u4e2d " * 5, "q" * 5_000_000]
    size, share = mixing.measures(pa.array(rows))
    assert size.tolist() == [len((t or "").encode().split()) for t in rows]
    odd = [sum(c.isascii() and not c.isalpha() and c not in " \t\n\x0b\x0c\r" for c in t or "") for t in rows]
    assert share.tolist() == [1 - o / len(t) if t else 0.0 for o, t in zip(odd, rows)]


def test_mixing_prefers_quality(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "a") for i in range(2000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = mixing.mix(docs, share=0.3, quality=mixing.label_weights(labels)).where("copies > 0")
    assert 0.8 < got.agg(F.avg((F.col("doc_id") % 2))).first()[0] and 590 <= got.count() <= 600


@pytest.mark.parametrize("module", [near, benchmark, mixture, urls])
def test_sql(spark, module):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in module.SQL.items():
        got = module.QUERIES[name](spark, SF)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        plain = lambda r: tuple(round(v, 4) if isinstance(v, float) else v for v in r)
        assert sorted(map(repr, (plain(r) for r in got.select(*names).collect()))) == sorted(map(repr, (plain(r) for r in cur.fetchall())))


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    first = {r.doc_id: r.lang_pred for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    docs = [d for d in docs if first[d[0]] != "und"]
    keep = {c for _, _, c in components([(d[0], d[1]) for d in docs])}
    docs = [d for d in docs if d[0] in keep]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in contamination([(d[0], d[1]) for d in docs], items) if x[4]}
    docs = [d for d in docs if d[0] not in bad]
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(docs, EMPTY), quality=mixing.label_weights(spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    tok = seekable.Chunks(seekable.vocabulary("word_bpe_49k.json"))
    want = sorted((d[0], len(tok.whole(d[1])) + 1) for d in docs for _ in range(taken[d[0]]))
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, SF).collect()) == want


def test_pipeline_stages_handle_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    base = " ".join(f"word{i}" for i in range(60))
    kind = "doc_id long, text string, lang string, source string, n_chars long, _ string, size int, copies string, key long, nth map<string,int>"
    rest = ("x", 3, "c", 7, {"a": 1})
    rows = [(1, base, "en", "a", 1, *rest)] * 3 + [(1, base + " z", "en", "a", 1, *rest), (None, base + " y", None, None, None, *rest), (None, None, None, None, None, *rest), (None, "12 34", "en", "b", 2, *rest)]
    rows += [(None, f"only here {i} and there", None, "b", 3, *rest) for i in range(3)] + [(7, "an item of the benchmark stands here in full", "en", "b", 4, *rest), (7, "nothing of that kind", "de", "b", 4, *rest)]
    d = str(tmp_path)
    spark.createDataFrame([(3, "item of the benchmark stands here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame(rows, kind)
    one = cp.language_id(spark, docs, d)
    assert one.columns == docs.columns and one.count() == len(rows) - 2
    two = cp.near_duplicates(spark, one, d)
    assert two.columns == docs.columns and two.where("doc_id = 1").count() == 1 and two.count() == 6
    three = cp.clean_of_benchmarks(spark, two, d)
    assert sorted(r.text for r in three.collect() if r.doc_id == 7) == ["nothing of that kind"] and three.count() == 5
    four = cp.mixture(spark, three, d)
    assert four.columns == docs.columns and {(r.size, r.copies, r._) for r in four.collect()} == {(3, "c", "x")}
    assert cp.token_ids(spark, four, d).count() == four.count() > 0
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, d)
        assert out.count() == 0, name
        if name != "token_ids":
            assert out.columns == docs.columns
