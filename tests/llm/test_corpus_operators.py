"""Mixing, centroid clustering and the divergence audit against brute force, and on nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cueloom.llm import centroids, divergence, mixing, textkit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, taken int"


@pytest.fixture(scope="module")
def tables():
    own = duckdb.connect()
    for name in ("documents", "embeddings"):
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return own


def _same(df, tables, sql):
    expected = tables.sql(sql)
    return sorted(map(tuple, df.select(*expected.columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)


def _level(sizes, weights):
    """Targets by reshared excess, in a loop."""
    open_, left = set(range(len(sizes))), sum(sizes)
    target = [0.0] * len(sizes)
    while open_:
        share = sum(weights[k] for k in open_)
        above = {k for k in open_ if left * weights[k] / share > 3 * sizes[k]}
        if not above:
            for k in open_:
                target[k] = left * weights[k] / share
            break
        for k in above:
            target[k] = 3.0 * sizes[k]
        left -= sum(3 * sizes[k] for k in above)
        open_ -= above
    return target


def _documents(rng):
    """A source with most rows, small ones, one of a single long text, one without words, and a null one."""
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((3, 40, 200)))), "en", rng.choice("aaaaaab"), k) for k in range(900)]
    rows += [(1000 + k, "x y z " * 5, "en", "tiny", 0) for k in range(3)] + [(1100, "long " * 30_000, "en", "z-long", 0), (1101, " \t\n", "en", "blank", 0), (1102, None, "en", "blank", 0)]
    return rows + [(1200 + k, "no source here", None, None, 0) for k in range(50)] + [(1, "again and again", "en", "a", 0)] * 3 + [(None, "no id", "en", "a", 0), (None, None, None, None, 0)]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = _documents(random.Random(2))
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs.repartition(5)).collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, size(t)) for i, t, *_ in rows)
    sizes, of = defaultdict(int), {}
    for i, t, _, s, _ in rows:
        sizes[s] += size(t)
        of[i, size(t)] = s
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, _level([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken, longest = Counter(), Counter()
    for r in found:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], abs_tol=1e-6)
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        assert not r["size"] or r["copies"] in (math.floor(r["target"] / max(1, sizes[s])), math.ceil(r["target"] / max(1, sizes[s])))
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert math.isclose(sum(target.values()), sum(sizes.values()))
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s]
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix(docs.limit(0)).collect() == []
    monkeypatch.undo()  # one leaf: long documents settle first, what stays open is short
    whole = mixing.mix(docs).filter("source_size = 0 or size > 0").collect()
    assert abs(sum(r["taken"] for r in whole if r["source_size"] == sizes["a"]) - target["a"]) < 20


def test_pivotal_rounding_is_unbiased():
    size, mean = np.array([50.0, 20.0, 7.0, 7.0, 3.0, 1.0]), np.zeros((2, 6))
    given = np.array([0.3, 0.9, 0.5, 0.1, 0.6, 0.2])
    for n in range(4000):
        one, two = np.full(6, 0.3), given.copy()
        mixing._settle(size, one, np.random.default_rng([n, 1]))
        mixing._trade(size, two, np.random.default_rng([n, 2]))
        for p, words in ((one, 0.3 * size.sum()), (two, float((given * size).sum()))):
            assert ((p > 0) & (p < 1)).sum() <= 1 and math.isclose(float((p * size).sum()), words)
        mean += np.array([one, two]) / 4000
    assert np.allclose(mean[0], 0.3, atol=0.035) and np.allclose(mean[1], given, atol=0.035)


def test_mixing_query(spark):
    own = mixing.op11_mixing(spark, SF)
    assert own.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    rows = own.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    assert rows and all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] for r in rows)


def _clusters_brute(vectors, k=16, rounds=3):
    """Lists of integers, looped over."""
    order = sorted(vectors, key=lambda v: (hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    centres = [v[1] for v in order[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres)) for _, x in vectors]
        if r < rounds:
            for n in range(len(centres)):
                own = [x for (_, x), (_, m) in zip(vectors, near, strict=True) if m == n]
                if own:
                    centres[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    inertia = Counter()
    for d, n in near:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(vectors, near, strict=True)), key=repr)


def test_centroids(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) + (k % 5) for _ in range(64)]) for k in range(120)]
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(3, rows[4][1]), (3, rows[4][1]), (None, rows[5][1]), (300, [0.0] * 64), (301, [-0.01] * 64), (302, [9000.0] * 64)]
    kept = len(rows)
    rows += [(400, None), (401, []), (402, [0.5] * 63), (403, [None] + [0.5] * 63), (404, [math.nan] * 64), (405, [math.inf] + [0.5] * 63), (406, [0.5] * 65)]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    expected = _clusters_brute([(i, [math.floor(64 * c) for c in v]) for i, v in rows[:kept]])
    assert sorted(map(tuple, centroids.cluster(table.repartition(4)).collect()), key=repr) == expected
    few = table.filter("vec_id in (300, 301, 302)")
    assert sorted(map(tuple, centroids.cluster(few).collect()), key=repr) == _clusters_brute([(i, [math.floor(64 * c) for c in v]) for i, v in rows if i in (300, 301, 302)])
    assert centroids.cluster(table.limit(0)).collect() == [] and centroids.cluster(table.filter("vec_id >= 400")).collect() == []


def test_centroids_query(spark, tables):
    assert _same(centroids.op12_centroids(spark, SF), tables, centroids.OP12_SQL)


def test_products_change_with_components_only(spark, monkeypatch):
    """A round reads changes only: products kept for the centres before give what fresh products give."""
    table = spark.createDataFrame([(k, [float(k % 7), float(k % 3), 1.0, -2.0]) for k in range(40)], "vec_id long, embedding array<double>")
    state = centroids.integers(table, 4)
    a, b = np.array([[1, 2, 3, 4], [64, 0, 64, -128]]), np.array([[1, 2, 5, 4], [64, 0, 64, -128]])
    step = centroids._round(centroids._round(state, a, None), b, a)
    assert sorted(map(tuple, step.collect())) == sorted(map(tuple, centroids._round(state, b, None).collect()))


def _audit_brute(rows):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for t, lang, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for own, s, terms in docs:
            if own == lang:
                held.update(set(terms))
                counts[s].update(terms)
        kept = sorted(t for t, n in held.items() if n >= 3)
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s, c in counts.items():
            parts = {"pair": [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s], "term": [(t, far(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]]}
            for part, own in parts.items():
                own.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(own) if part == "pair" or n < 200]
    return sorted(out)


@pytest.fixture(scope="module")
def worded():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 4))) for _ in range(700)]
    rows = [(" ".join(rng.choice(vocabulary[: 50 + 60 * (k % 11)]).title() for _ in range(rng.randint(0, 90))), ("en", "de", None)[k % 3], ("a", "b", "c", None)[k % 4]) for k in range(120)]
    rows += [(" ".join(map("".join, itertools.product("mnopqrstuvwxyzlk", repeat=2))), "de", "b")] * 3  # more terms of one source than there are ranks
    rows += [("Ärger;ÄRGER_x1y" * 3, "en", "b"), (None, "en", "empty"), ("", "fr", "one"), ("solo", "fr", "two"), ("x" * 5000 + " y" * 5000, "en", "a"), *[rows[0]] * 3]
    return rows


def test_divergence(spark, worded, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 60)
    monkeypatch.setattr(divergence, "STEP_BYTES", 64)
    monkeypatch.setattr(divergence, "STEP_PAIRS", 50)
    docs = spark.createDataFrame([(k, *r, 5) for k, r in enumerate(worded)], "doc_id long, text string, lang string, source string, rank int").repartition(3)
    expected = _audit_brute(worded)
    assert {r[2] for r in expected} == {"pair", "term"} and max(r[5] for r in expected) == 200
    assert sorted(map(tuple, divergence.audit(docs).collect())) == expected
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == expected
    assert divergence.audit(docs.limit(0)).collect() == []
    assert sorted(map(tuple, divergence.audit(docs.filter("lang = 'fr'")).collect())) == [("fr", "one", "pair", "two", 0, 1), ("fr", "two", "pair", "one", 0, 1)]


def test_divergence_query(spark, tables):
    assert _same(divergence.op13_divergence(spark, SF), tables, divergence.OP13_SQL)


def test_shares_of_large_counts_are_exact():
    counts = np.array([0, 12_345_678_901, 98_765_432_109_876], np.int64)
    assert divergence._share(counts, 10**14).tolist() == [1 + 10**9 * (int(c) + 1) // 10**14 for c in counts]


def test_pieces_end_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "STEP_BYTES", 3)
    text = b"ab cdef ghijkl m"
    assert b"".join(divergence._pieces(text)) == text
    assert list(itertools.chain(*(divergence.TERM.findall(p) for p in divergence._pieces(text)))) == text.split()


def test_discard(spark):
    table = textkit.written(spark.range(3).toDF("n"), "gone")
    path = table.inputFiles()[0]
    textkit.discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_sets_are_confirmed_by_one_worker_a_task(spark, monkeypatch):
    from cueloom.llm import minhash

    plans, confirmed = [], minhash._confirmed

    def seen(pairs, sets, percent):
        out = confirmed(pairs, sets, percent)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(minhash, "_confirmed", seen)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"x{k}"])) for k in range(4)], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0}
    assert plans and all(p.count("MapInArrow") == 1 for p in plans)
