"""Operators 11 to 13 against brute force on small tables, and against their SQL on the driver's."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tarnbeck.llm import clusters, prefix_trie, registry, url_filters
from tarnbeck.llm.url_filters import Rule


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_url_filters", "op13_prefix_trie"])
def test_sql(spark, sf, name):
    df, con = registry.QUERIES[name](spark, sf), duckdb.connect()
    for t in ("embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel, cols = con.sql(registry.ORACLE[name]), sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())


# ---- centroid clustering -------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, scale, seed, dimension):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v):
            kept.append((key, tuple(int(np.floor(float(x) * scale)) for x in v)))
    draw = lambda key: hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    order = sorted(((key is None, draw(key), q) for key, q in kept), key=lambda x: (x[0], x[1], x[2]))
    cents = [q for _, _, q in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda q: min(range(len(cents)), key=lambda c: (far(q, cents[c]), c))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, q in kept:
            mine[place(q)].append(q)
        cents = [tuple(sum(x) // len(mine[c]) for x in zip(*mine[c], strict=True)) if mine[c] else cents[c] for c in range(len(cents))]
    out = [(key, place(q), far(q, cents[place(q)])) for key, q in kept]
    cost = defaultdict(int)
    for _, c, d in out:
        cost[c] += d
    return sorted(((key, c, d, cost[c], sum(cost.values()), list(cents[c])) for key, c, d in out), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, seed):
    rng = random.Random(seed)
    points = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(20)]
    rows = [(i, rng.choice(points) if i % 3 else points[0]) for i in range(120)]
    rows += [(7, points[1]), (None, points[2]), (None, points[3]), (200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 0.0]), (204, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], "vec_id long, embedding array<double>, cluster int, q int, distance string")
    got = clusters.centroid_clusters(df, k=4, rounds=5, scale=16, seed=seed, dimension=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows, 4, 5, 16, seed, 3)


def test_clusters_few_ties_large(spark):
    kind = "vec_id long, embedding array<double>"
    none = clusters.centroid_clusters(spark.createDataFrame([(1, None)], kind), dimension=2)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    # equal starts: the smaller number takes all, the other one stays
    rows = [(1, [5.0, 5.0]), (2, [5.0, 5.0])]
    got = clusters.centroid_clusters(spark.createDataFrame(rows, kind), k=8, scale=1, dimension=2).collect()
    assert [tuple(r) for r in sorted(got)] == [(1, 0, 0, 0, 0, [5, 5]), (2, 0, 0, 0, 0, [5, 5])]
    # sums beyond 64 bits and products beyond 53
    far = float((1 << 27) - 1)
    rows = [(i, [far, -far]) for i in range(6)] + [(9, [-far, far])]
    got = clusters.centroid_clusters(spark.createDataFrame(rows, kind), k=2, scale=1, dimension=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows, 2, 10, 1, 3, 2)
    with pytest.raises(Exception, match="scaled component"):
        clusters.centroid_clusters(spark.createDataFrame([(1, [2.0**27, 0.0])], kind), k=1, scale=1, dimension=2).collect()


def test_exact_sums():
    import pyarrow as pa

    big = (1 << 27) - 1
    batch = pa.RecordBatch.from_arrays([pa.array([[big, -big]], pa.list_(pa.int32())), pa.array([1 << 40])], names=["q", "weight"])
    (out,) = clusters.partial_sums(np.zeros((1, 2), np.int64))([batch])
    assert [int(x) for x in out.column(3).to_pylist()] == [big << 40, -(big << 40)]


# ---- URL filters ---------------------------------------------------------------------------------------------------


def test_compiled():
    assert url_filters.compiled("||example.net/en/")[1] == ["en", "example", "net"]
    # a token at an open end may go on in the URL
    assert url_filters.compiled("/log*in^")[1] == [] and url_filters.compiled("/login^")[1] == ["login"]
    assert url_filters.compiled("|a.b|")[1] == ["a", "b"] and url_filters.compiled("utm_source=")[1] == ["source"]


URLS = [
    None, "", "no scheme", "://", "http://", "https://EXAMPLE.net/en/1", "http://example.net/EN/1", "http://a.b.example.net/en", "http://notexample.net/en/x", "http://fr.org/fr/", "x://org/fr/?a#b",
    "http://example.com/de/a?x=1", "http://example.com?de/", "http://example.com/login", "http://example.com/LOGIN?next=/", "http://example.com/loginpage", "http://example.com/a?utm_source=x&print=1",
    "http://blog.example.com/a?utm_source=x", "http://m.example.com/a.html", "http://m.example.com/a.html?b", "ftp://ads.example.com/", "http://w.example.com/?page=2&ref=x", "http://user@example.net:80/en/", "http://net", "http://net/",
    "http://é.org/fr/é?É", "http://example.com/a\nb.exe", "http://x.example.com/" + "a/" * 50_000 + "login",
]


@pytest.mark.parametrize("rules", [url_filters.HOSTS + url_filters.PATTERNS, [Rule("an*l", "block"), Rule("net/", "allow", True), Rule("a*", "allow")], []])
def test_judged_like_every_rule_on_every_url(spark, rules):
    import re

    kind = "page_id long, url string, rule string, host int, __key int, verdict string"
    df = spark.createDataFrame([(i if i % 5 else None, u, "r", 1, 2, "v") for i, u in enumerate(URLS + URLS[4:9])], kind)
    fold = str.maketrans(url_filters.UPPER, url_filters.LOWER)

    def brute(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0].translate(fold)
        path, target = re.match("[^/?#]*([^?#]*)", rest)[1], host + rest[len(host) :]
        for r in sorted(rules, key=lambda r: (not r.is_host, -len(r.text), r.verdict != "block", r.text)):
            if r.is_host:
                h, p = r.text[: r.text.index("/")], r.text[r.text.index("/") :]
                hit = (host == h or host.endswith("." + h)) and path.startswith(p)
            else:
                hit = re.search(url_filters.compiled(r.pattern)[0].replace(r"\z", r"\Z"), target.translate(fold))
            if hit:
                return host, path, r.text if r.is_host else None, None if r.is_host else r.text, r.verdict
        return host, path, None, None, "allow"

    got = url_filters.judged(df, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "pattern", "verdict"]
    want = [(i if i % 5 else None, *brute(u)) for i, u in enumerate(URLS + URLS[4:9])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert url_filters.judged(df.limit(0), rules).collect() == []


def test_index_takes_the_rarest_token(spark):
    df = spark.createDataFrame([("http://a.com/x/",), ("http://b.com/x/",), ("http://a.com/y/",)], "url string")
    assert url_filters.rarest(df, [Rule("||a.com/", "block"), Rule("||b.com/x/", "block"), Rule("z*", "block"), Rule("||com/never/", "block")]) == ["a", "b", None, "never"]
    plan = url_filters.judged(df.withColumn("page_id", url_filters.F.lit(1)), url_filters.HOSTS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


# ---- prefix trie ---------------------------------------------------------------------------------------------------


def trie(convs):
    """{sequence: members} and the rows from a dictionary of conversations."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    below = lambda p: [q for q in members if q[: len(p)] == p]
    child = lambda p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p]
    for p, cs in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below(p) if q)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(child(p)), sum(not child(q) for q in below(p)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def family(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:] if c % 5 else own
    return out


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def talk(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([1, 2, 2, 3, 4, 12])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a", "é", "a", "", None, "longer text"]), "x", 1))
    rows += [(1, None, "user", "a", "x", 1), (1, None, "user", "a", "x", 1), (2, 5, "b", "y", "x", 1), (2, 5, "b", "x", "x", 1), (None, 1, "user", "lost", "x", 1), (10**15, 0, "user", "a", "x", 1)]
    rng.shuffle(rows)
    return rows


KIND = "conv_id long, turn long, role string, text string, depth string, conv int"


@pytest.mark.parametrize("bits,bound", [(64, 1000), (1, 1000), (2, 0), (0, 1000)])
def test_trie(spark, bits, bound):
    rows = talk(random.Random(bits), 40)
    turns, convs = prefix_trie.rebuilt(spark.createDataFrame(rows, KIND))
    got = prefix_trie.prefix_trie(turns, convs, bits=bits, broadcast_rows=bound)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == trie(family(ordered(rows)))


def test_trie_of_a_long_conversation_cut_into_ranges(spark):
    rows = [(3, t, "user", f"t{t % 7}", "x", 1) for t in range(60)] + [(4, t, "user", f"t{t % 7}", "x", 1) for t in range(45)] + [(c, 0, "user", "t0", "x", 1) for c in range(5, 12)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, ("false", "13", "3"), strict=True):
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, KIND)
        assert prefix_trie.scanned(df).where("conv = 3").select("part").distinct().count() > 3
        got = prefix_trie.prefix_trie(df)
        assert sorted(map(tuple, got.collect()), key=str) == trie(ordered(rows))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_trie_without_turns(spark):
    none = spark.createDataFrame([], KIND)
    assert prefix_trie.prefix_trie(none).collect() == []
    (row,) = prefix_trie.prefix_trie(none, spark.createDataFrame([(5,), (3,), (None,), (3,)], "conv_id long")).collect()
    assert tuple(row) == (3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())


def test_pieces_of_a_large_end(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 60)
    ids = random.Random(1).sample(range(10**6), 50)
    ends = spark.createDataFrame([(0, 0, 0, i) for i in ids] + [(1, -5, 2, 7)], "depth long, fp long, split int, conv long")
    want = {0: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 1: hashlib.sha256(b"7").hexdigest()}
    assert {r.depth: r.ends_sha256 for r in prefix_trie.ends_digests(ends).collect()} == want
