"""Line dedup by winnowing. DataFrame functions only.

A document's lines (trimmed of blanks, empty ones left out) are hashed. A window is a run of WINDOW consecutive lines, or
of fewer that hold `words` words; of every window the smallest hash, on a tie the last, is selected. Two documents that
share a window select the same line of it, so selected lines are fingerprints that guarantee to find every shared window.

1. Fingerprints. A row goes out for each selected line only, with its place and the lines around it.
2. Positions are joined by fingerprint; those that occur once are done with.
3. A match is extended both ways from the fingerprint: `left` lines before and the rest behind. Pairs of places would grow
   with the square of a common line, so places extend together: those of one fingerprint whose lines agree from -left on
   are one group, and its earliest place is the source of all others.
4. Extensions that overlap or touch are one maximal repeated run, which is deleted from the later document.

So a line goes if and only if it lies in a run of lines that stands earlier and has WINDOW lines or `words` words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit

#: Lines of the shortest run that is found, whatever its words.
WINDOW = 3
#: Words of a passage that is found on fewer lines; so many characters count as a word at least, for scripts without blanks.
PASSAGE_WORDS, WORD_CHARS = 50, 8


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines(docs: DataFrame) -> DataFrame:
    """docs with _kept: k (index among all lines), h and g (hashes), w (words) of the lines that are not blank."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(k.alias("k"), F.trim(x).alias("t")))
    words = lambda t: F.greatest(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")), F.floor(F.length(t) / WORD_CHARS).cast("int"))
    kept = F.transform(F.filter(numbered, lambda x: x["t"] != ""), lambda x: F.struct(x["k"].alias("k"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit("second"), x["t"]).alias("g"), words(x["t"]).alias("w")))
    return docs.withColumn("_kept", kept)


def _windows(kept: Column, n: int, words: int | None) -> Column:
    """For each line the window of n lines from it, as struct with `pos`, the line it selects; null where it is none."""

    def at(i: Column) -> Column:
        part = F.slice(kept, i + 1, F.lit(n))
        least = F.array_min(F.transform(part, lambda x, j: F.struct(x["h"].alias("h"), (-j).alias("j"))))
        own = F.struct(
            (i - least["j"]).alias("pos"), (-least["j"]).alias("left"), F.lit(n).alias("n"), part[0]["k"].alias("first"), part[n - 1]["k"].alias("last"),
            F.xxhash64(F.transform(part, lambda x: x["g"])).alias("content"),
        )
        return own if words is None else F.when(F.aggregate(part, F.lit(0), lambda a, x: a + x["w"]) >= words, own)

    return F.transform(F.slice(F.sequence(F.lit(0), F.size(kept)), F.lit(1), F.greatest(F.lit(0), F.size(kept) - n + 1)), at)


def fingerprints(docs: DataFrame, window: int = WINDOW, words: int | None = PASSAGE_WORDS) -> DataFrame:
    """(fp, row, doc_id, pos, around): a row for each selected line of docs (doc_id, text) with the windows that select it.

    around: array<struct<left, n, first, last, content>>: a window of n lines from `left` before pos, its range of raw lines
    and a hash of its lines, which is independent of fp. row tells rows of one doc_id apart.
    """
    known = docs.filter("doc_id is not null and text is not null").select(_row().alias("row"), "doc_id", "text")
    held = _lines(known)
    sizes = [n for n in range(1, window + 1) if n == window or words is not None]
    for n in sizes:
        held = held.withColumn(f"_w{n}", _windows(F.col("_kept"), n, None if n == window else words))

    def selected(pos: Column) -> Column:
        near = F.concat(*(F.slice(F.col(f"_w{n}"), F.greatest(pos - n + 1, F.lit(0)) + 1, F.lit(n)) for n in sizes))
        own = F.transform(F.filter(near, lambda x: x["pos"] == pos), lambda x: x.dropFields("pos"))
        return F.struct(F.col("_kept")[pos]["h"].alias("fp"), pos.alias("pos"), own.alias("around"))

    every = F.filter(F.transform(F.slice(F.sequence(F.lit(0), F.size("_kept")), F.lit(1), F.size("_kept")), selected), lambda x: F.size(x["around"]) > 0)
    return held.select("row", "doc_id", F.explode(every).alias("f")).select("row", "doc_id", "f.*")


def repeated_runs(docs: DataFrame, window: int = WINDOW, words: int | None = PASSAGE_WORDS) -> DataFrame:
    """(row, doc_id, first, last): ranges of line numbers, from 0, of the maximal runs of rows that stand earlier in the corpus.

    Earlier means a smaller doc_id, or the same and a smaller line number; so of rows that share a doc_id only a line that
    stands further up in one of them deletes. Rows with null doc_id or text take no part.
    """
    marks = textkit.written(fingerprints(docs, window, words), "fingerprints")
    shared = marks.groupBy("fp").agg(F.count("*").alias("_n")).filter("_n > 1")
    matched = textkit.spread_join(marks, textkit.written(shared, "shared"), ["fp"])
    reach = matched.select("fp", "row", "doc_id", "pos", F.explode("around").alias("x")).select("fp", "row", "doc_id", (F.col("pos") - F.col("x.left")).alias("i"), "x.n", "x.first", "x.last", "x.content")
    reach = textkit.written(reach, "extensions")
    groups = reach.groupBy("fp", "content").agg(F.min(F.struct("doc_id", "i")).alias("_source"), F.count("*").alias("_n")).filter("_n > 1")
    later = textkit.spread_join(reach, textkit.written(groups, "sources"), ["fp", "content"]).filter(F.struct("doc_id", "i") > F.col("_source"))
    later = later.select("row", "doc_id", "i", "n", "first", "last").distinct()
    order = Window.partitionBy("row", "doc_id").orderBy("i", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("i") > F.max(F.col("i") + F.col("n")).over(before)).cast("int"), F.lit(1))
    runs = later.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("row", "doc_id", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def dedup(docs: DataFrame, window: int = WINDOW, words: int | None = PASSAGE_WORDS) -> DataFrame:
    """docs with text rid of later repeated runs, and n_lines, n_removed, n_runs added; other columns stay, of any name but these.

    A text of which nothing is left is empty; a null text stays null with n_lines 0; an empty text is one empty line. Rows
    are told apart by doc_id and text: rows that share a doc_id lose their own lines only, equal rows lose the same.
    words None finds runs of `window` lines only.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), window, words).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    joined = docs.select(_row().alias("row"), "doc_id", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("d")).join(runs, ["row", "doc_id"], "left")
    raw = F.split("d.text", "\n", -1)

    def left_between(lines: Column) -> Column:
        """The lines between runs, each gap cut out once."""
        begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.col("runs")[j - 1]["last"] + 1)
        end = lambda j: F.when(j == F.size("runs"), F.size(lines)).otherwise(F.col("runs")[j]["first"])
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda j: F.slice(lines, begin(j) + 1, end(j) - begin(j))))

    kept = F.array_join(F.transform(F.array(raw), left_between)[0], "\n")
    removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0))
    return joined.select(
        *(F.when(F.col("runs").isNull(), F.col("d.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in columns),
        F.coalesce(F.size(raw), F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.greatest(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup(textkit.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_CONTENT = {n: " || chr(10) || ".join(["t", *(f"lead(t, {j}) OVER w" for j in range(1, n))]) for n in range(1, WINDOW + 1)}
_SIZE = {n: " + ".join(["size", *(f"lead(size, {j}) OVER w" for j in range(1, n))]) for n in range(1, WINDOW + 1)}
OP4_SQL = f"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k
  FROM documents WHERE text IS NOT NULL),
kept AS (
  SELECT doc_id, k, trim(line, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i,
    greatest(len(regexp_extract_all(trim(line, ' '), '[^\\x20\\x09-\\x0D]+')), len(trim(line, ' ')) // {WORD_CHARS}) AS size
  FROM raw WHERE trim(line, ' ') <> ''),
windows AS (
  {" UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, i, {n} AS n, k AS first, lead(k, {n - 1}) OVER w AS last, {_CONTENT[n]} AS content, {_SIZE[n]} AS size FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE last IS NOT NULL" + (f" AND size >= {PASSAGE_WORDS}" if n < WINDOW else "") for n in range(1, WINDOW + 1))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, content ORDER BY doc_id, i) AS nth FROM windows),
later AS (
  SELECT *, CASE WHEN i > max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens
  FROM ranked WHERE nth > 1),
runs AS (SELECT doc_id, run, min(first) AS first, max(last) AS last FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i, n ROWS UNBOUNDED PRECEDING) AS run FROM later) GROUP BY doc_id, run),
left_over AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.k) AS text FROM raw r WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.doc_id = r.doc_id AND r.k BETWEEN u.first AND u.last) GROUP BY r.doc_id),
sums AS (SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_runs FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(l.text, '')) AS kept_sha256
FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id LEFT JOIN sums s ON s.doc_id = d.doc_id
"""
