"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
import re

import corpus_pipeline
from cueloom.llm import textkit

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_stages(spark):
    docs = textkit.table(spark, SF, "documents")
    extra = spark.createDataFrame([(10**6, None, "en", "x", 0), (10**6 + 1, "12 34", "en", "x", 5), (10**6 + 2, "", None, "x", 0)], docs.schema)
    docs, columns = textkit.written(docs.unionByName(extra), "docs"), docs.columns
    rows = {0: docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = textkit.written(stage(spark, docs, SF), f"stage-{k}")
        rows[k] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) or docs.columns == columns
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0] if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in rows[2]} <= {r.doc_id for r in rows[1]} and all(r.n_chars == len(r.text) for r in rows[2])
    sets = {}
    for r in rows[2]:
        w = _words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert {r.doc_id for r in rows[3]} == {i for i in parent if find(i) == i}
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate(LOWER)))
    items = [plain(r.text) for r in textkit.table(spark, SF, "benchmark").collect()]
    leaked = {r.doc_id for r in rows[3] if any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in rows[3]} - leaked
    texts = {r.doc_id: r.text for r in rows[4]}
    assert {r.doc_id: r.decoded_sha256 for r in rows[5]} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_long_lines_go(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(0, f"first\n{passage}", "en", "x", 0), (1, f"second\n{passage}\nthird", "en", "x", 0), (2, passage, "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()} == {0: rows[0][1], 1: "second\nthird"}


def test_edge_rows_of_every_stage(spark):
    """Empty tables, nulls in every column, empty and long texts, repeated rows and clashing column names."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, d string, kept string, leaks string, lang_pred string, score double, `a.b` string"
    more = ("r", "d", "k", "l", "p", 0.5, "a.b")
    rows = [(1, "some words stand here in a line", "en", "s", 31, *more), (1, "some words stand here in a line", "en", "s", 31, *more), (None, "letters without a number", None, None, None, *more), (2, None, None, None, None, *([None] * 7)), (3, "", "en", "s", 0, *more), (4, "long text " * 30_000, "en", "s", 300_000, *more)]
    docs, empty = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0
        got = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert {r.doc_id for r in got} >= {1, None, 4} and all(r.row == "r" and r.score == 0.5 for r in got if r.doc_id == 1)
        assert sum(r.doc_id == 1 for r in got) == (1 if k == 2 else 2)


def test_rows_that_share_an_id_are_told_apart(spark):
    """Of linked rows one stays, whatever ids they share; a row that is nobody's copy stays too."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c + " more"), (7, c), (7, c), (7, b + " other words at the end of it all that make it differ enough to count as another text here"), (9, None), (9, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], kind).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, docs, SF).collect()]
    assert len(got) == 6 and {(1, a), (5, b), rows[6], (9, None)} <= set(got) and len({(7, c), (7, c + " more")} & set(got)) == 1 and got.count((9, None)) == 2


def test_run_and_registration(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", q)[0] for q in names if q.startswith("op")} and "pipeline" in names
    assert corpus_pipeline.run(spark, SF).count() > 0
