"""Merkle manifest, personal data and centroid clustering against plain versions, on small and odd tables."""

import glob
import hashlib
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import centroids, merkle, pii, trees
from sievelight.llm.work import Work

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, grp string, pos string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def docs(spark, tmp_path, rows):
    """A folder of tables whose documents are (doc_id, source, text), with columns that clash with the operators' own."""
    spark.createDataFrame([(i, t, "en", s, 7, "d", "g", "p") for i, s, t in rows], DOC).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def tree(nodes):
    """Root, and of each node the (place, siblings) of its levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            p.append((run[: i % 16], run[i % 16 + 1 :]))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def manifest(rows):
    """op11 in plain Python, for (doc_id, source, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, t: sha("".join(map(part, (i, s, "en", 7, t))))
    lower = lambda t: t if t is None else "".join(c.lower() if c.isascii() else c for c in t)
    groups = {}
    for i, s, t in rows:
        struck = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups.setdefault(s, []).append((i is not None, i or 0, leaf(i, s, t), leaf(i, s, lower(t)) if struck else leaf(i, s, t), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, _, a, b, i), path in zip(sorted(groups[s]), subs[s][1]):
            whole = path + top
            for left, right in whole:
                b = sha("".join([*left, b, *right]))
            out.append((i, a, subs[s][0], root, sha("".join(x for left, right in whole for x in left + right)), b, b == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [3, 1])
def test_manifest(spark, tmp_path, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 16**depth)
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "b", "B", "ü"]), r.choice(["Ab C", "", "über Ähre", None])) for i in range(700)]
    rows += [(1000 + i, "many", f"T{i}") for i in range(16 * 17 + 1)]
    rows += [(5, None, "x"), (None, None, "X"), (None, "a", None), (7, "lone", "A" * 200_000), (8, "twice", "Q"), (8, "twice", "Q"), (8, "twice", "R")]
    rows += [(2000 + i, f"host{i}", "T") for i in range(40)]
    got = merkle.op11_merkle_manifest(spark, docs(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == manifest(rows)


def test_manifest_of_few_rows(spark, tmp_path):
    for n, rows in enumerate([[], [(1, "s", "One")], [(None, None, None)]]):
        got = merkle.op11_merkle_manifest(spark, docs(spark, tmp_path / str(n), rows))
        assert sorted(map(tuple, got.collect()), key=str) == (manifest(rows) if rows else [])


def test_siblings_by_index():
    m = np.frombuffer("".join(sha(str(i)) for i in range(37)).encode(), np.uint8).reshape(-1, 64)
    flat, at = merkle.siblings(m)
    for i in range(37):
        run = [sha(str(k)) for k in range(i // 16 * 16, min(37, i // 16 * 16 + 16)) if k != i]
        assert flat[at[i] : at[i + 1]].decode() == "".join(run)


def test_blocks_go_over_batches(spark):
    rows = spark.range(20000).select((F.col("id") % 3).alias("grp"), F.lit(20000).cast("long").alias("n"), F.floor(F.col("id") / 3).alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    try:
        got = {r.grp: r.digest for r in merkle.grow(rows.withColumn("n", F.when(F.col("grp") < 2, 6667).otherwise(6666).cast("long")), Work(spark))[-1].collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {g: tree([sha(str(i)) for i in range(g, 20000, 3)])[0] for g in range(3)}


def clusters(rows, k=40, rounds=5):
    """op13 in plain Python, for (vec_id, embedding)."""
    fine = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(256 * x) for x in v] for _, v in fine]
    first = sorted(range(len(fine)), key=lambda n: (fine[n][0] is None, sha(f"2:{fine[n][0]}"), fine[n][1]))[:k]
    c = [ints[n] for n in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, m), j) for j, m in enumerate(c))[::-1]
    for _ in range(rounds):
        at = [nearest(v)[0] for v in ints]
        c = [[sum(x) // len(own) for x in zip(*own)] if (own := [v for v, a in zip(ints, at) if a == j]) else c[j] for j in range(len(c))]
    out = [(i, *nearest(v)) for (i, _), v in zip(fine, ints)]
    long = lambda v: min(v, 2**63 - 1)
    return sorted([(i, j, long(d), long(sum(e for _, m, e in out if m == j)), long(sum(e for *_, e in out)), sha(",".join(map(str, c[j])))) for i, j, d in out], key=str)


def placed(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    got, c = centroids.cluster(df)
    return sorted(map(tuple, centroids.summarized(got, c).collect()), key=str)


def test_centroids(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=64).tolist()) for i in range(260)]
    rows += [(300 + i, [0.25] * 64) for i in range(50)] + [(300, [0.25] * 64), (None, [1.0] * 64), (401, [0.5] * 63), (402, None), (403, [float("nan")] + [0.0] * 63), (404, [None] + [0.0] * 63), (405, [math.inf] * 64), (406, [])]
    rows += [(500 + i, (np.eye(64)[i] * 3).tolist()) for i in range(60)]  # ties
    assert placed(spark, rows) == clusters(rows)


def test_centroids_of_large_numbers_and_few_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=64) * 10.0 ** (i % 30)).tolist()) for i in range(90)]
    assert placed(spark, rows) == clusters(rows)
    assert placed(spark, [(1, [0.1] * 64)]) == clusters([(1, [0.1] * 64)])
    assert placed(spark, []) == []


def test_intervals_hold_the_exact_values():
    r = np.random.default_rng(7)
    for scale in (3, 1000, 1 << 25):
        x = r.integers(-scale, scale, (200, 64))
        c = centroids.Centroids(r.integers(-scale, scale, (40, 64)).tolist())
        low, high = c.intervals(x)
        exact = np.array([[sum(int(b) * int(b) - 2 * int(a) * int(b) for a, b in zip(v, m)) for m in c.rows] for v in x], dtype=object)
        assert (low <= exact).all() and (exact <= high).all()
        at, d, _ = c.assign(x)
        every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in c.rows] for v in x]
        assert at.tolist() == [e.index(min(e)) for e in every] and d.tolist() == [min(e) for e in every]


def plain_base(t):
    """The rules' patterns as they are given."""
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    ok = lambda d: sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    out += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and ok(digits(m[0]))]
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_spans_of_random_texts():
    r = random.Random(6)
    for _ in range(6000):
        t = "".join(r.choice(["a", "Z", "1", "22", "255", "256", "000", ".", "@", "-", " ", "+", "(", ")", "+1 (555) 555-1234", "4111 1111 1111 1111", "x@y.z", "ü", "%_"]) for _ in range(r.randrange(14)))
        assert pii.base_spans(t) == plain_base(t), t
    for t in ("1" * 20000, "a" * 50000 + "@", "1." * 20000, "+1(" * 9000, "1 " * 20000, "a@" * 9000):  # in linear time
        assert len(pii.base_spans(t)) < 20000 and pii.candidates(t) is not None


def corpus(seed, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(40)]
        if i % 2 == 0:
            w[r.randrange(40)] = pii.made_up(pii.KINDS[i // 2 % 4], r)
        if i % 3 == 0:
            w[r.randrange(40)] = r.choice([f"2024-{r.randint(10, 12)}-{r.randint(10, 28)} 10:{r.randint(10, 59)}:00", f"order {r.randrange(10**9)}", f"v{r.randrange(9)}.{r.randrange(99)}.1"])
        rows.append((i, "s", " ".join(w)))
    return rows


def test_pii(spark, tmp_path):
    rows = corpus(1) + [(900, "s", None), (901, "s", ""), (902, "s", "x " * 200_000 + "a.b@c.de"), (903, None, "4111 1111 1111 1111"), (903, None, "4111 1111 1111 1111"), (None, "s", "+1 (555) 555-1234")]
    folder = docs(spark, tmp_path, rows)
    got = pii.op12_pii(spark, folder)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {}
    for i, _, t in rows:
        texts.setdefault(i, t or "")
    out = got.collect()
    assert len(out) == len(rows)
    for x in out:
        base = plain_base(texts[x.doc_id])
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[1] == k for s in base) for k in pii.KINDS)
        assert x.base_sha256 == sha(pii.joined(base))
        spans = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_pii_finds_disguised_spans_and_leaves_clean_texts(spark):
    frame = lambda rows: spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    finder = pii.Finder.fit(pii.gather(frame(corpus(1))))
    r = random.Random(77)
    right = total = 0
    for k in pii.KINDS:
        for i in range(60):
            before, after = " ".join(["lorem", "ipsum", "dolor"] * 5) + " ", " " + " ".join(["sit", "amet"] * 5)
            form = r.choice(pii.disguises(k, pii.made_up(k, r), r))
            t = before + form + after
            base = pii.base_spans(t)
            every = [*base, *(s for _, s in finder.added([t], [base])[0])]
            total += 1
            right += any(a <= len(before) + 1 and b >= len(before) + len(form) - 1 for a, _, b in every)
    assert right / total > 0.8
    clean = ["On 2024-03-05 at 10:15:00 version 2.14.3 was released, order 12345678.", "Look at the table. Dot plots follow at once.", "pages 12-34, 56-78 and 90", "A" * 5000, "ratio 0.123456789 of 1,234,567"]
    assert finder.added(clean, [pii.base_spans(t) for t in clean]) == [[] for _ in clean]
    mail = spark.createDataFrame([(1, "write to a.b@c.de or +1 (555) 555-1234 now", "x"), (2, None, "y")], "doc_id long, text string, spans string")
    assert sorted(map(tuple, pii.redact(mail, finder).collect())) == [(1, "write to [EMAIL] or [PHONE] now", "x"), (2, None, "y")]


def test_pii_without_examples(spark, tmp_path):
    assert pii.op12_pii(spark, docs(spark, tmp_path / "a", [])).count() == 0
    got = pii.op12_pii(spark, docs(spark, tmp_path / "b", [(1, "s", "call 555-867-5309")])).collect()
    assert [tuple(x) for x in got] == [(1, 0, 0, 0, 0, sha(""), "")]


def test_overlapping_candidates_give_way():
    found = [(0.9, (5, "phone", 15)), (0.95, (10, "card", 26)), (0.9, (26, "ip", 30)), (0.9, (0, "email", 10)), (0.9, (0, "phone", 9))]
    assert [s for _, s in pii._best(found)] == [(0, "email", 10), (10, "card", 26), (26, "ip", 30)]
    assert pii._free([(0, "ip", 3), (3, "ip", 5), (6, "ip", 9)], [(4, "card", 6)]) == [(0, "ip", 3), (6, "ip", 9)]


def test_boosted_trees():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.2)).astype(float)
    m = trees.Boosted(rounds=30).fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    p = m.probability(x[2500:])
    assert ((p > 0.5) == y[2500:]).mean() > 0.95

    def walk(row):
        out = m.start
        for f, c, leaf in zip(m.feature, m.cut, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            out += leaf[node - len(f)]
        return 1 / (1 + math.exp(-(m.slope * out + m.shift)))

    assert np.allclose(p[:50], [walk(row) for row in x[2500:2550]])
    first = trees.Boosted(rounds=1, depth=1).fit(x[:2000], y[:2000])  # the best of all single cuts
    g = y[:2000] - y[:2000].mean()
    h = y[:2000].mean() * (1 - y[:2000].mean())
    worth = lambda j, c: sum(g[s].sum() ** 2 / (h * s.sum() + 1) for s in (x[:2000, j] <= c, x[:2000, j] > c))
    cuts = [(j, c) for j in range(6) for c in np.unique(np.quantile(x[:2000, j], np.linspace(0, 1, 33)[1:-1]))]
    assert (first.feature[0, 0], first.cut[0, 0]) == max(cuts, key=lambda s: worth(*s))


def test_thresholds():
    p, y = np.array([0.9] * 50 + [0.6] * 50 + [0.3] * 50), np.array([1.0] * 100 + [0.0] * 50)
    assert trees.threshold(p, y, 0.9) == 0.6 and trees.threshold(p[:5], y[:5], 0.9) is None and trees.threshold(p[:0], y[:0], 0.9) is None


@pytest.mark.parametrize("module", [merkle, centroids])
def test_sql(spark, module):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {p.split('/')[-1][:-8]} as select * from read_parquet('{p}')")
    for name, sql in module.SQL.items():
        got = module.QUERIES[name](spark, SF)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        mine = sorted(json.dumps([r[n] for n in sorted(names)]) for r in got.collect())
        order = [names.index(n) for n in sorted(names)]
        assert sorted(got.columns) == sorted(names) and mine == sorted(json.dumps([r[i] for i in order]) for r in cur.fetchall())
