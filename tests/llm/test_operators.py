"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import bpe, components, decontaminate, langid, linededup, minhash, secrets, suffixdedup, textkit, toxicity, vectordedup, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages and lines, empty, null, blank and long texts, repeated and null ids."""
    rng = random.Random(4)
    lines = [_words(rng, 8) for _ in range(12)]
    texts = [_words(rng, rng.randint(5, 120)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for k in range(8):
        words = texts[k].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
        rows.append((200 + k, texts[k] + "\n" + "\n".join(lines[k : k + 4])))
        rows.append((300 + k, "\n".join([_words(rng, 3), *lines[k : k + 5], "", _words(rng, 4)])))
    rows += [(400, ""), (401, None), (402, " \n\t "), (403, "one"), (404, "One"), (405, "12 34"), (406, "aaaa" * 400), (407, "x" + "aaaa" * 300)]
    rows += [(408, "Größe naïve 中文字符 " * 30), (409, "né Größe naïve 中文字符 " * 29), (410, _words(rng, 20_000)), (3, texts[3]), (3, texts[3]), (None, texts[4]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], DOCS).repartition(3)


@pytest.fixture(scope="module")
def tables():
    """The smallest tables as DuckDB views."""
    import duckdb

    own = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return own


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_secrets(spark, docs, nothing):
    rng = random.Random(9)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(48))
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [
        f"é中 token = \"{hexes}\" and PASSWORD:'{key}'", "token=token:abcdef secret:=ab api-key: x api_key:  =longvalue", "AKIA" + "A1B2C3D4E5F6G7H8" + " AKIASHORT",
        f"loose {key} here", "internationalisation0and1counterrevolutionaries", "deadbeef" * 3 + "\n" + "0" * 30 + "x", "", None, "Token : secretsecret", f"{key} " * 600,
    ]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in secrets.scan(rows).collect()}
    patterns = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)]
    for i, text in enumerate(texts):
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p, least) in enumerate(patterns) for m in re.finditer(p, text or "") if len(m[1]) >= least)
        assert [tuple(s) for s in got[i] if s.kind != "random"] == want
    random_spans = lambda i: [(s.start, s.end) for s in got[i] if s.kind == "random"]
    assert (6, 54) in random_spans(3) and not random_spans(4)
    assert len(random_spans(9)) == 600
    assert secrets.scan(nothing).count() == 0
    assert secrets.scan(docs).count() == docs.count()


def test_secrets_of_letters_and_clashing_columns(spark):
    rng = random.Random(19)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = [make(lower + upper, 40) for _ in range(5)] + [make(upper, 40) for _ in range(5)] + [make(lower + upper + "0123456789+/", 44) for _ in range(5)]
    words = ["internationalisationandcounterrevolutionaries", "state-of-the-art-and-well-known-things", "src/main/java/org/example/service/handlers", "-" * 40, "ab" * 30, "1234567890" * 4]
    rows = [(k, f"see {x} here", 1, 2, 3, 4) for k, x in enumerate(keys + words)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, _random int, _found int, d int, t int"))
    assert got.columns == ["doc_id", "text", "_random", "_found", "d", "t", "spans"]
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in got.collect()}
    assert sum(found[k] == [(4, 4 + len(x))] for k, x in enumerate(keys)) >= 0.9 * len(keys)
    assert not any(found[len(keys) + k] for k in range(len(words)))


def _log10_lower(z):
    """log10 of the normal distribution's logistic approximation, or of its tail."""
    if z >= -3:
        return -math.log10(1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))
    return -z * z / (2 * math.log(10)) - math.log10(-z * math.sqrt(2 * math.pi)) + math.log10(1 - 1 / z**2 + 3 / z**4)


def _battery_brute(token):
    body = token.replace("-", "+").replace("_", "/").rstrip("=")
    symbols, pairs = next((s, p) for pattern, s, p in secrets.ENCODINGS if re.search(pattern, body))
    n, k = len(body), len(symbols)
    values = [symbols.index(c) + 1 for c in body]
    chi = sum(body.count(c) ** 2 for c in set(body)) * k / n - n
    sides = [v > k / 2 for v in values]
    high, runs = sum(sides), 1 + sum(a != b for a, b in zip(sides, sides[1:]))
    mean_runs = 2 * high * (n - high) / n + 1
    spread = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_runs = (runs - mean_runs) / math.sqrt(spread) if spread > 0 else -30
    mean = sum(values) / n
    variance = sum((v - mean) ** 2 for v in values)
    z_serial = (sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / variance + 1 / n) * math.sqrt(n) if variance else 30
    two_sided = lambda z: _log10_lower(-abs(z)) + math.log10(2)
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    away = k * pairs - 1
    z_text = (chi - (k - 1) - (n - 1) * away) / math.sqrt(2 * (k - 1) + 4 * (n - 1) * away)
    return min(_log10_lower(-z_chi), two_sided(z_runs), two_sided(z_serial)) + math.log10(3), _log10_lower(z_text)


def test_randomness_battery(spark):
    """The battery and the false-discovery rule against plain loops."""
    rng = random.Random(23)
    alphabets = ["0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ab", "A", "abcXYZ019+/-_"]
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) + "=" * rng.randint(0, 2) for a in alphabets for _ in range(12)]
    got = [tuple(r.p) for r in spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "k int, t string").orderBy("k").select(secrets.battery(F.col("t")).alias("p")).collect()]
    want = [_battery_brute(t) for t in tokens]
    assert np.allclose(got, want, atol=1e-6)
    bins = sorted((min(secrets.BINS, math.floor(-10 * d)) for _, d in want), reverse=True)
    best = secrets.BINS + 1
    for b in sorted(set(bins), reverse=True):
        if 10 ** (-b / 10) * len(bins) <= secrets.FALSE_SHARE * sum(x >= b for x in bins):
            best = b
    docs = spark.createDataFrame([(k, f"({t})") for k, t in enumerate(tokens)], "doc_id long, text string")
    assert secrets.discovery_bin(docs) == best


def test_secrets_query(spark, tables):
    """All columns of the registered query on whole documents."""
    patterns = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)]
    texts = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    got = secrets.op1_secrets(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p, least) in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id] or "") if len(m[1]) >= least)
        base = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[3] == kind for w in want) for kind, _, _ in patterns)
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("random")) == base


def _suffix_brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup(docs, corpus, nothing, monkeypatch):
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    want = sorted(_suffix_brute(corpus), key=key)
    for sizes in ({}, {"BLOCK_BYTES": 20_000, "BUCKET_BYTES": 30_000, "SHARD_BYTES": 2000, "MERGE_BYTES": 9000}):
        for k, v in sizes.items():
            monkeypatch.setattr(suffixdedup, k, v)
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.dedup(docs).collect()]
        assert sorted(got, key=key) == want
    assert suffixdedup.dedup(nothing).count() == 0


def test_merged_transforms():
    rng = random.Random(2)
    strings = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(6)] for _ in range(4)]
    shards = [suffixdedup.Shard(np.frombuffer(b"".join(s), np.uint8), np.array([len(x) for x in s])) for s in strings]
    order, prefix = suffixdedup.merge(shards, 40, all_prefixes=True)
    suffixes = [(s[shard.string[p]] + b"")[len(s[shard.string[p]]) - shard.left[p] :] for s, shard in zip(strings, shards) for p in shard.suffixes]
    merged = [suffixes[i] for i in order]
    assert merged == sorted(merged)
    for a, b, n in zip(merged, merged[1:], prefix[1:]):
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == common


def _plain(text):
    """Words as decontamination sees them: characters of three or more UTF-8 bytes stand alone, general punctuation is none."""
    return re.findall(r"[a-z0-9\x80-\u07ff]+|(?![\u2000-\u207f\u3000-\u303f])[\u0800-\U0010ffff]", text.translate(LOWER))


def _leaks_brute(rows, bench):
    """Every document against every item, by edit distance of words to any stretch."""
    out = {}
    for i, text in rows:
        for item_id, item in bench:
            if item_id is None or item is None or text is None:
                continue
            p, t = _plain(item), _plain(text)
            if len(p) < decontaminate.LEAST_WORDS:
                continue
            row = [0] * (len(t) + 1)
            for a, x in enumerate(p, 1):
                new = [a]
                for b, y in enumerate(t, 1):
                    new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (x != y)))
                row = new
            if min(row) <= (int(0.2 * len(p)) if len(p) >= 10 else 0):
                out[i, item_id] = min(row)
    return out


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[k : k + (kind != 1)] = [] if kind == 2 else [_words(rng, 1)]
    return words


def test_decontamination(spark, docs, nothing):
    rng = random.Random(5)
    bench = [(i, _words(rng, n)) for i, n in enumerate((12, 30, 60, 7, 200))]
    item = dict(bench)
    texts = [
        f"before {item[0].upper()}, after", f"{_words(rng, 40)} {' '.join(_edited(rng, item[1].split(), 3))} {_words(rng, 40)}", _words(rng, 200), item[2][: len(item[2]) // 2], "", None,
        f"{_words(rng, 3000)} {item[2]}", item[0] + " " + item[1], f"x-{item[3].replace(' ', ' - ')}!", " ".join(_edited(rng, item[4].split(), 30)), item[4][:600], "中文" * 30 + "，字符", "以" + "今天天气很好我们去公园散步吧" + "。",
    ]
    bench += [(7, None), (None, "x " * 50), (8, "short"), (9, item[0]), (10, "今天天气很好，我们去公园散步吧"), (11, " ".join(reversed(item[1].split())))]
    table = spark.createDataFrame([(i, t, "clash", "r") for i, t in enumerate(texts)], "doc_id long, text string, leaks string, row string").withColumn("d", F.lit(1)).withColumn("item", F.lit(2))
    bench_table = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contaminated(table, bench_table)
    assert found.columns == ["doc_id", "text", "row", "d", "item", "leaks"]
    got = {(r.doc_id, x.item_id): x.edits for r in found.collect() for x in r.leaks}
    assert got == _leaks_brute(list(enumerate(texts)), bench) and {(0, 0), (0, 9), (1, 1), (6, 2), (7, 0), (7, 9), (7, 1), (8, 3), (9, 4), (12, 10)} == set(got)
    assert decontaminate.contaminated(nothing, bench_table).count() == 0
    assert decontaminate.contaminated(docs, bench_table.limit(0)).filter(F.size("leaks") > 0).count() == 0
    # rows that share an id are looked at each for itself, equal rows alike
    same = spark.createDataFrame([(1, texts[0]), (1, "clean"), (1, texts[0]), (None, texts[0])], "doc_id long, text string")
    assert sorted(len(r.leaks) for r in decontaminate.contaminated(same, bench_table).collect()) == [0, 2, 2, 2]


def test_decontamination_recall(spark):
    """Recall at the most edits that the rule allows, by brute force on every document and item."""
    rng = random.Random(15)
    bench = [(i, _words(rng, rng.randint(10, 90))) for i in range(60)]
    rows = []
    for k in range(240):
        words = dict(bench)[k % 60].split()
        rows.append((k, " ".join([_words(rng, rng.randint(0, 40)), *_edited(rng, words, int(0.2 * len(words))), _words(rng, rng.randint(0, 40))])))
    want = {(k, k % 60) for k, _ in rows}
    tables = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, x.item_id): x.edits for r in decontaminate.contaminated(*tables).collect() for x in r.leaks}
    some = [r for r in rows if r[0] < 12]
    brute = _leaks_brute(some, bench)
    assert {k: v for k, v in got.items() if k[0] < 12}.items() <= brute.items()
    assert len(want & set(got)) >= 0.97 * len(want) and set(got) <= want


def test_long_benchmark_items(spark):
    """An item of a megabyte is found whole, and only where enough of it stands."""
    rng = random.Random(16)
    words = _words(rng, 180_000).split()
    rows = [(0, " ".join(["intro", *_edited(rng, words, 60), "outro"])), (1, " ".join(words[:100_000])), (2, "nothing here")]
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {0: [5], 1: [], 2: []}


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontaminate.edit_distance_within(p, t) == min(row)


def _line_brute(rows, w):
    earlier, out = {}, []
    kept = {}
    for i, t in rows:
        if i is not None and t is not None:
            lines = [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
            kept[i, t] = [(k, lines[k][0], lines[k + w - 1][0], tuple(x for _, x in lines[k : k + w])) for k in range(len(lines) - w + 1)]
    for (i, _), ws in kept.items():
        for k, _, _, c in ws:
            earlier[c] = min(earlier.get(c, (i, k)), (i, k))
    for i, t in rows:
        gone = set()
        for k, a, b, c in kept.get((i, t), []):
            if earlier[c] < (i, k):
                gone |= set(range(a, b + 1))
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)))
    return out


def test_line_dedup(docs, corpus, nothing):
    got = linededup.dedup(docs.withColumn("n_lines", F.lit("clash")), words=None).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in got], key=key) == sorted(_line_brute(corpus, 3), key=key)
    assert sum(r.n_removed > 0 for r in got) > 10
    assert linededup.dedup(nothing).count() == 0


def test_line_dedup_rows_that_share_an_id(spark):
    """A row loses its own lines only, whatever other rows with its id hold; columns of any name stay."""
    line = lambda x: "\n".join(x.split())
    rows = [(1, line("a b c"), "r", "g"), (5, line("x y z w"), "r", "g"), (5, line("a b c q"), "r", "g"), (5, line("q a b c"), "r", "g"), (5, line("x y z w"), "r", "g")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _runs string, runs string").withColumn("row", F.lit(1)).withColumn("d", F.lit(2))
    got = linededup.dedup(table)
    assert got.columns == [*table.columns, "n_lines", "n_removed", "n_runs"]
    assert sorted((r.doc_id, r.text, r._runs, r.n_removed) for r in got.collect()) == [(1, line("a b c"), "r", 0), (5, "q", "r", 3), (5, "q", "r", 3), (5, line("x y z w"), "r", 0), (5, line("x y z w"), "r", 0)]


def test_line_dedup_query(spark, tables):
    """The registered query against its SQL, all columns."""
    want = tables.sql(linededup.OP4_SQL).fetchall()
    got = linededup.op4_line_dedup(spark, SF).select("doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def _passage_brute(rows, w, words):
    """A line goes if it lies in a run of consecutive lines that stands earlier and has w lines or so many words."""
    size = lambda t: max(len(re.findall(r"[^\x20\x09-\x0D]+", t)), len(t) // linededup.WORD_CHARS)
    found, first = {}, {}
    for i, t in rows:
        lines = [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
        found[i] = []
        for k in range(len(lines)):
            for n in range(1, w + 1):
                run = lines[k : k + n]
                if len(run) == n and (n == w or sum(size(x) for _, x in run) >= words):
                    content = tuple(x for _, x in run)
                    found[i].append((k, run[0][0], run[-1][0], content))
                    first[content] = min(first.get(content, (i, k)), (i, k))
    out = {}
    for i, t in rows:
        gone = {j for k, a, b, c in found[i] if first[c] < (i, k) for j in range(a, b + 1)}
        out[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone), len(gone)
    return out


def test_line_dedup_passages(spark):
    rng = random.Random(12)
    long, half, other, short = _words(rng, 60), _words(rng, 30), _words(rng, 25), [_words(rng, 4) for _ in range(4)]
    rows = [
        (0, "\n".join([long, short[0], short[1], "", half, other])), (1, f"{long}"), (2, f"new words\n  {long} \nand more"), (3, f"{half}\n\n{other}\nlast"), (4, half), (5, f"{short[0]}\n{short[1]}"),
        (6, "\n".join([long, short[0], short[1], "end"])), (7, f"{long} "), (8, "中文字符" * 120), (9, "头\n" + "中文字符" * 120), (10, ""), (11, f"{long}\n{short[2]}\n{long}\n{short[2]}"),
    ]
    rows += [(20 + k, "\n".join(rng.choice([long, half, other, *short, "", _words(rng, 20)]) for _ in range(rng.randint(1, 7)))) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in linededup.dedup(table, words=linededup.PASSAGE_WORDS).collect()}
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == _passage_brute(rows, 3, 50)
    assert [got[i].text for i in (1, 2, 3, 4, 5, 6, 7, 9)] == ["", "new words\nand more", "last", half, rows[5][1], "end", "", "头"]


def test_vector_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + rng.normal(size=64) * 0.02]) for i in range(60)]
    rows += [(300 + i, [float(x) for x in base[7]]) for i in range(30)] + [(3, [float(x) for x in base[3]])]
    odd = [(400, None), (401, [0.0] * 64), (402, [float("nan")] * 64), (403, [1.0] * 63 + [None]), (404, []), (405, [float("inf")] + [0.0] * 63), (None, [float(x) for x in base[0]]), (406, [1.0] * 3)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = vectordedup.near_duplicates(table).collect()
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids, parent = [i for i, _ in rows], {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        p, q = find(ids[a]), find(ids[b])
        parent[max(p, q)] = min(p, q)
    want = sorted((i, int(near[k].sum()) - 1, find(i), find(i) == i) for k, i in enumerate(ids))
    assert sorted(tuple(r) for r in got if r.vec_id is not None and r.vec_id < 400) == want
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got if r.vec_id is None or r.vec_id >= 400)
    assert vectordedup.near_duplicates(table.limit(0)).count() == 0


def test_vector_dedup_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(20)]
    for n, first in ((48, 100), (3, 200)):
        a = rng.normal(size=n)
        rows += [(first, [float(x) for x in a]), (first + 1, [float(x) for x in a]), (first + 2, [float(x) for x in a * 2 + 0.001]), (first + 3, [float(-x) for x in a])]
    rows.append((300, [1.0, 2.0]))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectordedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: (2, i // 100 * 100, i % 100 == 0) if i in (100, 101, 102, 200, 201, 202) else (0, i, True) for i, _ in rows}


def test_toxicity(spark, nothing):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words, toxic = _words(rng, rng.randint(10, 80)).split(), i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiotq", "scumq"]))
            words.insert(rng.randrange(len(words)), "groupz")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "x"), (902, "calm words " * 20_000)]
    labels += [(900, 1, None), (None, 1, 1), (5, 0, 0), (5000, 1, 1)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = langid.bucket_of(F.col("doc_id"), 3) == 1
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, table.filter(~held))).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == (i % 5 == 0) for i in out) >= 0.98 * len(out)
    assert got[900].predicted == got[901].predicted == 0
    machine = toxicity.fit(docs, table.limit(0))
    assert {r.predicted for r in toxicity.score(docs, machine).collect()} == {0}
    assert toxicity.score(nothing, machine).count() == 0


def test_factorization_of_terms_that_tell_nothing_alone():
    """Toxic where exactly one of two terms stands: each is as frequent in either class."""
    rng = np.random.default_rng(1)
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    bags = [np.unique(np.concatenate([[1] if x else [2], [3] if y else [4], rng.integers(10, 4000, 5)])) for x, y in zip(a, b)]
    machine = toxicity.train(bags, a != b, 0.5)
    row = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    assert ((machine.score(row, np.concatenate(bags), len(bags)) > 0.5) == (a != b)).mean() > 0.97


def test_toxicity_query(spark, tables):
    """Scores of the registered query against a naive double loop over pairs of terms."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(docs, labels.filter(langid.bucket_of(F.col("doc_id"), 3) != 1))
    texts = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        raw = np.frombuffer((text or "").encode(), np.uint8)
        own = sorted({int(machine.slot[x]) for x in toxicity.terms(raw, np.array([0, len(raw)]))[1]} - {-1})
        if len(own) > 120:
            continue  # the loop is quadratic
        total = machine.bias + sum(machine.weight[x] for x in own)
        for x in range(len(own)):
            for y in range(x):
                total += sum(p * q for p, q in zip(machine.factors[own[x]], machine.factors[own[y]]))
        r, p = got[i], 1 / (1 + math.exp(-max(-30, min(30, total))))
        assert abs(r.score - p) < 1e-6 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_factorization_learns_pairs():
    """Toxic only where both of two terms meet: no additive weights can tell."""
    rng = np.random.default_rng(0)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    bags = [np.unique(np.concatenate([[1] if x else [2], [3] if y else [4], rng.integers(10, 4000, 5)])) for x, y in zip(a, b)]
    machine = toxicity.train(bags, a & b, 0.25)
    row = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    assert ((machine.score(row, np.concatenate(bags), len(bags)) > 0.5) == (a & b)).mean() > 0.97
    assert np.abs(machine.factors).max() > 0.1


def test_bpe(docs, corpus, nothing):
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = bpe.load_ranks(path)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(ranks, pattern)
    rng = random.Random(3)
    parts = ["a", "aa", "é", "  ", "\n", "中", "0", ".", "!!", "th", "ing", "ß", "😀", "<|endoftext|>", "'s"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == known.encode_ordinary(text) and own.decode(ids).decode() == text
    long = "ab" * 20_000 + "é" * 10_000
    assert own.encode(long) == known.encode_ordinary(long)
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in bpe.round_trip(docs, path, pattern, packed=True).collect())
    ids = [known.encode_ordinary(t or "") for _, t in corpus]
    assert got == sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), np.array(i, "<i4").tobytes()) for i, (_, t) in zip(ids, corpus))
    texts = bpe.decode_column(bpe.encode_column(docs, path, pattern), path, pattern)
    assert sorted(r.text for r in texts.collect()) == sorted(t or "" for _, t in corpus)
    assert bpe.round_trip(nothing, path, pattern).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(docs, corpus, nothing, words):
    sets = []
    for _, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(corpus)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(corpus)):
        for b in range(a):
            if None not in (corpus[a][0], corpus[b][0]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(corpus):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = [(i, len(sets[k]), None if i is None else least[find(k)], i is None or least[find(k)] == i) for k, (i, _) in enumerate(corpus)]
    got = [tuple(r) for r in minhash.near_duplicates(docs.withColumn("kept", F.lit("clash")), words=words).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert minhash.near_duplicates(nothing).count() == 0


def test_estimate():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.8):
        common = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        n = int(len(common) * share)
        a, b = (np.sort(np.concatenate([common[:n], rng.integers(0, 2**63, (len(common) - n) // 2, dtype=np.uint64) * np.uint64(2)])) for _ in range(2))
        truth = n / (2 * len(a) - n)
        ra, rb = (minhash.sketch(np.sort(textkit.mix(x)))[None] for x in (a, b))
        assert abs(minhash.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] - truth) < 0.15


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {k: find(k) for k in got} == got and set(parent) - set(got) <= alone


def test_langid(spark, nothing):
    rng = random.Random(1)
    syllables = {"en": ["th", "ing", "the", "er"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "é", "tion", "que"], "es": ["ción", "ñ", "os", "la"]}
    rows = [(k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang) for k, lang in enumerate(list(syllables) * 80)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !?", "en"), (903, "the thing " * 30_000, None), (None, "thing the", "en")]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    model = langid.fit(docs.filter(langid.bucket_of(F.col("doc_id"), 5) != 0))
    assert {k: sorted(v) for k, v in model.families.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = langid.predict(docs, model).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "lang_pred", "score"} and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902, 903)} == {900: "und", 901: "und", 902: "und", 903: "en"}
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_langid_query(spark, tables):
    """Predictions of the registered query against a naive vote of the machines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.filter(langid.bucket_of(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r for r in langid.op9_langid(spark, SF).collect()}
    texts = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    assert got.keys() == texts.keys()
    sure = lambda m: 1 / (1 + math.exp(-4 * max(-8, min(8, float(m)))))
    for i, text in texts.items():
        x, count = langid.features([text])
        if not text or count[0] == 0:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        won = {n: sure(x[0] @ w + b) for n, (w, b) in model.by_family.items()} or dict.fromkeys(model.families, 1.0)
        best = max(model.families, key=lambda n: won[n])
        points = dict.fromkeys(model.families[best], 0.0)
        for (a, b_), (w, b) in model.by_pair.items():
            if a in points:
                points[a] += sure(x[0] @ w + b)
                points[b_] += 1 - sure(x[0] @ w + b)
        share = {k: v / max(1, len(points) - 1) for k, v in points.items()} if len(points) > 1 else dict.fromkeys(points, 1.0)
        lang = max(points, key=lambda k: points[k])
        assert got[i].lang_pred == lang and abs(got[i].score - won[best] / sum(won.values()) * share[lang]) < 1e-4
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_queries_of_whole_tables(spark, tables):
    """The registered queries 2, 7, 8 and 10 on whole tables, all columns, against brute force."""
    import tiktoken

    docs = tables.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: r for r in suffixdedup.op2_suffix_dedup(spark, SF).collect()}
    for i, n, removed, spans, kept in _suffix_brute(docs):
        assert tuple(got[i])[1:] == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    path, pattern = bpe.vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.op7_bpe(spark, SF).collect()}
    for i, text in docs:
        ids = known.encode_ordinary(text or "")
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = {r.doc_id: r for r in minhash.op8_minhash(spark, SF).collect()}
    sets, parent = {}, {i: i for i, _ in docs}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert {i: tuple(r) for i, r in got.items()} == {i: (i, len(sets[i]), find(i), find(i) == i) for i in sets}
    pages = tables.sql("SELECT page_id, html FROM pages").fetchall()
    last = {}
    for i, html in pages:
        last[html or ""] = max(last.get(html or "", i), i)
    got = {r.page_id: r for r in warc.op10_warc(spark, SF).collect()}
    for i, html in pages:
        p, to = (html or "").encode(), last[html or ""]
        assert tuple(got[i])[1:5] == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to == i else "revisit", None if to == i else to)
    assert len(got) == len(pages)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "é\r\n\r\n" * 50_000), (6, "u", "WARC/1.1\r\n\r\n"), (7, "v", "<p>x</p>"), (None, "w", "<p>x</p>"), (7, "v", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.warc_round_trip(pages).collect()
    payloads = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, p in payloads.items():
        if i is not None:
            last[p] = max(last.get(p, i), i)
    assert sorted(r.page_id or 0 for r in got) == sorted(i or 0 for i, _, _ in rows) and all(r.digest_ok for r in got)
    for r in got:
        p = payloads[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        if r.page_id is not None:
            want = None if last[p] == r.page_id else last[p]
            assert r.refers_to == want and r.record_type == ("response" if want is None else "revisit")
            assert want is not None or bytes(r.payload) == p
    archive = warc.write_archives(warc.deduplicated(pages)).collect()
    for k, r in enumerate(archive):
        (tmp_path / f"{k}.warc.gz").write_bytes(r.archive)
    assert warc.read_warc_files(spark, str(tmp_path / "*.warc.gz")).count() == len(rows)
    broken = bytearray(warc._record(1, "u", b"payload" * 100, None))
    head = bytes(warc._record(1, "u", b"payload" * 100, None))
    assert [f["warc-type"] for f, _ in warc.SequentialReader(head + head)] == ["response", "response"]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.SequentialReader(bytes(broken[: len(broken) // 2])))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_vector_recall(spark, monkeypatch):
    """Recall against brute force with far more lists than probes: ids divisible by 20 against all rows, lists coarse and fine."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, np.repeat(base[:500], 5, 0) + rng.normal(size=(2500, 32)) * rng.uniform(0.05, 0.3, (2500, 1)), rng.normal(size=(2000, 32))])
    table = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vectordedup, "BLOCK_ENTRIES", 300)
    monkeypatch.setattr(vectordedup, "BLOCK_QUERIES", 500)
    monkeypatch.setattr(vectordedup, "PROBES", 16)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::20] @ unit.T >= 0.95
    want = near.sum(1) - 1
    assert want.sum() > 200
    for coarse in (1024, 20):
        monkeypatch.setattr(vectordedup, "COARSE", coarse)
        index = vectordedup.train(unit[:4000], len(x))
        assert len(index.coarse) * len(index.fine) >= 4 * 16
        got = {r.vec_id: r.n_links for r in vectordedup.near_duplicates(table).collect()}
        counts = np.array([got[k] for k in range(0, len(x), 20)])
        assert (counts <= want).all() and counts.sum() >= 0.9 * want.sum()
        assert sum(got.values()) % 2 == 0  # a link counts for both of its vectors


def test_index_decides_on_the_given_table(spark, tables, monkeypatch):
    """With the default constants, ids divisible by 20 against all rows of the given table."""
    import duckdb

    placed = []
    own = vectordedup._place
    monkeypatch.setattr(vectordedup, "_place", lambda *a: placed.append(a[2]) or own(*a))
    got = {r.vec_id: r.n_links for r in vectordedup.op5_vector_dedup(spark, SF).collect()}
    assert placed == [64]
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    some = [k for k, (i, _) in enumerate(rows) if i % 20 == 0]
    want = (x[some] @ x.T >= 0.95).sum(1) - 1
    counts = np.array([got[rows[k][0]] for k in some])
    assert (counts <= want).all() and counts.sum() >= 0.9 * want.sum()
