"""Subtitle and script corpora to cue tables. A reader turns whole texts (file_id, text) into cues; `read` loads them from files.

Texts are split into blocks or lines in place, and one explode gives the cues; cue_no follows the order in the file. A cue whose
end isn't after its start ends a second later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom import shared
from cueloom.functions import predicates as pr
from cueloom.functions import text as tx
from cueloom.functions import timecode as tc
from cueloom.operators import windows as wn
from cueloom.views import CUE_MS, STEP_MS, sequential

TC = r"\d{1,2}:\d{2}:\d{2}(?:[,.:;]\d{1,3})?"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, file_name, text) of every file below path, one row a file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"))
    return raw


def _trimmed(text: Column) -> Column:
    lines = lambda t: F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)
    # a pattern would look at each blank of a whole text; it is left for blanks before a last separator, which end a text for it
    ends = lambda t: F.when(F.substring(t, -2, 2).rlike(r"\s[\x85\u2028\u2029]"), F.regexp_replace(t, r"\s+$", "")).otherwise(t)
    return tx.let(tx.let(text, lines), lambda t: tx.let(F.trim(t, F.lit(" \t\n\x0b\f\r")), ends))


def _lines(block: Column) -> Column:
    # the only white space left in a line
    return F.filter(F.transform(F.split(block, r"\R"), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x != "")


def line_table(docs: DataFrame) -> DataFrame:
    """(file_id, line_no from 1, line): lines that aren't blank."""
    return docs.select("file_id", F.posexplode(_lines(F.coalesce("text", F.lit("")))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _cues(rows: DataFrame, start: Column, end: Column, text: Column, order: str = "_i", *more: str) -> DataFrame:
    """Rows to cues: ends guarded, numbered in order; rows without text go. more: columns that stay."""
    out = rows.select("file_id", *more, F.col(order).alias("_o"), start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), F.trim(text).alias("text"))
    out = out.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 1000).otherwise(F.col("end_ms")))
    # rows without text go behind the window: a filter before it would make the texts a second time
    kept, upto = F.coalesce("text", F.lit("")) != "", Window.partitionBy("file_id").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("cue_no", F.count_if(kept).over(upto).cast("int")).filter(kept).select("file_id", "cue_no", "start_ms", "end_ms", "text", *more)


def _blocks(docs: DataFrame, text: Column) -> DataFrame:
    rows = docs.select("file_id", F.posexplode(F.split(_trimmed(text), r"\n\s*\n")).alias("_i", "_b"))
    return rows.select("file_id", "_i", _lines(F.col("_b")).alias("l"))


def _after_arrow(rows: DataFrame) -> DataFrame:
    """Blocks of lines with an arrow: times and the lines after it."""
    at = F.array_position(F.transform("l", lambda x: x.contains("-->")), True).cast("int")
    rows = rows.withColumn("_a", at).filter("_a > 0").withColumn("_t", F.split(F.get("l", F.col("_a") - 1), "-->", 2))
    return rows.withColumn("_body", F.array_join(F.slice("l", F.col("_a") + 1, F.greatest(F.lit(0), F.size("l"))), "\n"))


def parse_srt(docs: DataFrame) -> DataFrame:
    rows = _after_arrow(_blocks(docs, F.col("text")))
    return wn.renumber(_cues(rows, tc.parse_ms(F.col("_t")[0]), tc.parse_ms(F.col("_t")[1]), tx.inline_breaks(F.col("_body"))))


def parse_vtt(docs: DataFrame) -> DataFrame:
    """WebVTT, hours optional; header, STYLE and NOTE blocks and cue settings are left out."""
    held = lambda t: t.contains("STYLE") | t.contains("NOTE") | t.contains("REGION")
    headless = F.regexp_replace(_trimmed(F.col("text")), r"(?s)^WEBVTT.*?(?:\n\n|$)", "")
    body = tx.let(headless, lambda t: F.when(held(t), F.regexp_replace(t, r"(?ms)^(?:STYLE|NOTE|REGION)\b.*?(?:\n\n|\z)", "")).otherwise(t))
    rows = _after_arrow(_blocks(docs, body)).withColumn("_end", F.regexp_extract(F.trim(F.col("_t")[1]), r"^\S+", 0))
    end = F.col("_end")
    return wn.renumber(_cues(rows, tc.parse_ms(F.trim(F.col("_t")[0])), tc.parse_ms(end), tx.inline_breaks(F.col("_body"))))


def parse_ass(docs: DataFrame) -> DataFrame:
    """[Events] of ASS/SSA by its own Format: order; commas in the last column stay."""
    lines = line_table(docs)
    upto = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_section", F.last(F.when(F.col("line").rlike(r"^\["), F.col("line")), ignorenulls=True).over(upto))
    events = lines.filter(F.col("_section").startswith("[Events]"))
    names = F.transform(F.split(F.regexp_replace("line", "^Format:", ""), ","), lambda x: F.lower(F.trim(x)))
    events = events.withColumn("_names", F.last(F.when(F.col("line").startswith("Format:"), names), ignorenulls=True).over(upto))
    default = F.array(*[F.lit(x) for x in "layer start end style name marginl marginr marginv effect text".split()])
    rows = events.filter(F.col("line").startswith("Dialogue:")).withColumn("_names", F.coalesce("_names", default))
    rows = rows.withColumn("_v", F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", F.size("_names")))
    of = lambda name: F.get("_v", F.array_position("_names", name).cast("int") - 1)
    return wn.renumber(_cues(rows, tc.ass_ms(F.trim(of("start"))), tc.ass_ms(F.trim(of("end"))), tx.inline_breaks(of("text")), "line_no"))


def parse_microdvd(docs: DataFrame, fps: float = 25.0) -> DataFrame:
    lines = line_table(docs)
    part = lambda i: F.regexp_extract("line", r"^\{(\d+)\}\{(\d+)\}(.*)$", i)
    rows = lines.filter(F.col("line").rlike(r"^\{\d+\}\{\d+\}"))
    return wn.renumber(_cues(rows, tc.frames_to_ms(part(1).cast("long"), fps), tc.frames_to_ms(part(2).cast("long"), fps), F.replace(part(3), F.lit("|"), F.lit("\n")), "line_no"))


def parse_sbv(docs: DataFrame) -> DataFrame:
    rows = _blocks(docs, F.col("text")).withColumn("_t", F.split(F.get("l", F.lit(0)), ","))
    rows = rows.filter(F.get("l", F.lit(0)).rlike(r"^\d{1,2}:\d{2}:\d{2}\.\d{1,3},\d{1,2}:\d{2}:\d{2}\.\d{1,3}$"))
    return wn.renumber(_cues(rows, tc.parse_ms(F.col("_t")[0]), tc.parse_ms(F.col("_t")[1]), F.array_join(F.slice("l", F.lit(2), F.size("l")), "\n")))


def parse_lrc(docs: DataFrame) -> DataFrame:
    """A cue for each [mm:ss.xx] tag of a line, by time; the end is the next start, the last 3 s later."""
    tags = F.regexp_extract_all("line", F.lit(r"\[\d{1,2}:\d{1,2}(?:[.:]\d{1,3})?\]"), F.lit(0))
    rows = line_table(docs).withColumn("_body", F.trim(F.regexp_replace("line", r"\[[^\]]*\]", ""))).select("file_id", "line_no", "_body", F.posexplode(tags).alias("_k", "_tag"))
    part = lambda i: F.regexp_extract("_tag", r"^\[(\d{1,2}):(\d{1,2})(?:[.:](\d{1,3}))?\]$", i)
    start = tc.snap_ms((part(1).cast("long") * 60 + part(2).cast("long")) * 1000 + F.coalesce(F.rpad(part(3), 3, "0").try_cast("long"), F.lit(0)))
    rows = rows.withColumn("start_ms", start)
    order = Window.partitionBy("file_id").orderBy("start_ms", "line_no", "_k")
    rows = rows.withColumn("_i", F.row_number().over(order)).withColumn("_end", F.coalesce(F.lead("start_ms").over(order), F.col("start_ms") + 3000))
    return wn.renumber(_cues(rows, F.col("start_ms"), F.col("_end"), F.col("_body")))


def parse_ttml(docs: DataFrame) -> DataFrame:
    """<p begin end dur> in any namespace; the end is end, begin + dur, or 3 s later. Line breaks stay, other tags go."""
    paragraphs = F.regexp_extract_all("text", F.lit(r"(?is)<(?:\w+:)?p\b[^>]*>.*?</(?:\w+:)?p>"), F.lit(0))
    rows = docs.select("file_id", F.posexplode(paragraphs).alias("_i", "_p")).withColumn("_head", F.regexp_extract("_p", r"(?s)^<[^>]*>", 0))
    attribute = lambda name: F.nullif(F.regexp_extract("_head", rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    # each is looked at by several patterns
    rows = rows.withColumns({f"_{name}": attribute(name) for name in ("begin", "end", "dur")})
    start = tc.ttml_ms(F.col("_begin"))
    end = F.coalesce(tc.ttml_ms(F.col("_end")), start + tc.ttml_ms(F.col("_dur")), start + 3000)
    body = F.regexp_replace(F.regexp_replace("_p", r"(?i)<(?:\w+:)?br\s*/?>", "\n"), r"(?s)<[^>]+>", "")
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(code), F.lit(plain))
    return wn.renumber(_cues(rows, start, end, tx.normalise_breaks(body)))


def parse_inline_ranges(docs: DataFrame) -> DataFrame:
    """Lines `start --> end | text`."""
    pattern = rf"^({TC})\s*-->\s*({TC})\s*\|\s*(.*)$"
    rows = line_table(docs).filter(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return wn.renumber(_cues(rows, tc.parse_ms(part(1)), tc.parse_ms(part(2)), part(3), "line_no"))


def parse_txt(docs: DataFrame) -> DataFrame:
    """A cue for each line that isn't blank, timed in sequence."""
    return sequential(line_table(docs).select("file_id", F.col("line_no").cast("int").alias("cue_no"), F.col("line").alias("text"))).select("file_id", "cue_no", "start_ms", "end_ms", "text")


# Header names of cue tables.
START_NAMES, END_NAMES, TEXT_NAMES = ("start", "timein", "begin"), ("end", "timeout", "out"), ("text", "dialog", "subtitle", "line", "content")


def _first_name(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((c for n in names for c in columns if n in c.lower()), None)


def cues_from_rows(rows: DataFrame) -> DataFrame:
    """A table with any header (and file_id, row_no) to cues: columns are found by part of their names; without a start column the
    rows are timed in sequence."""
    columns = [c for c in rows.columns if c not in ("file_id", "row_no")]
    s, e, t = (_first_name(columns, n) for n in (START_NAMES, END_NAMES, TEXT_NAMES))
    text = F.col(f"`{t or columns[-1]}`").cast("string")
    if s is None:
        order = Window.partitionBy("file_id").orderBy("row_no")
        kept = rows.filter(F.trim(F.coalesce(text, F.lit(""))) != "").select("file_id", F.row_number().over(order).alias("cue_no"), F.trim(text).alias("text"))
        return sequential(kept).select("file_id", "cue_no", "start_ms", "end_ms", "text")
    end = tc.parse_ms(F.col(f"`{e}`").cast("string")) if e else F.lit(None)
    return wn.renumber(_cues(rows, tc.parse_ms(F.col(f"`{s}`").cast("string")), end, text, "row_no"))


def csv_records(text: Column) -> Column:
    """array<string> of a text's records: line breaks between quotes stay, a record whose quote is never closed goes, as do blank ones.

    Every second part between quotes stands within them, so a text is read once, however many lines and quotes it has."""
    within = lambda p: F.replace(p, F.lit("\n"), F.lit("\x01n"))
    parts = F.split(F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), F.lit("\x01"), F.lit("\x01a")), '"', -1)
    lines = lambda ps: F.split(F.array_join(F.transform(ps, lambda p, i: F.when(i % 2 == 1, within(p)).otherwise(p)), '"'), "\n", -1)
    closed = tx.let(parts, lambda ps: tx.let(lines(ps), lambda ls: F.when(F.size(ps) % 2 == 0, F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls)))
    back = lambda r: F.replace(F.replace(r, F.lit("\x01n"), F.lit("\n")), F.lit("\x01a"), F.lit("\x01"))
    return F.filter(F.transform(closed, back), lambda r: F.trim(r) != "")


def csv_cells(record: Column) -> Column:
    """array<string> of a record's cells. No step of the patterns goes back, so they take no stack, however long a cell is."""
    # every cell behind a comma, so that empty cells are matched too
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r'(?s),\s*(?:"[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(0))
    return F.transform(found, lambda c: F.replace(F.regexp_replace(F.regexp_replace(c, r"^,", ""), r'(?s)^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"')))


def parse_csv(docs: DataFrame) -> DataFrame:
    """Cues of comma-separated texts with a header line: columns by part of their names, as in `cues_from_rows`.

    A cell may be quoted and hold commas, doubled quotes and line breaks. Records end where quotes are balanced; a text whose
    header names no text column gives its last column. Names are looked up once a text, and texts of either kind go one way.
    """

    def place(names: tuple[str, ...]) -> Column:
        holds = lambda n: lambda c: c.contains(n)
        found = [F.array_position(F.transform("_names", holds(n)), True) for n in names]
        return F.coalesce(*(F.when(k > 0, k.cast("int")) for k in found))

    rows = docs.select("file_id", csv_records(F.col("text")).alias("_records"))
    rows = rows.withColumn("_names", F.transform(csv_cells(F.get("_records", F.lit(0))), lambda c: F.lower(F.trim(c))))
    rows = rows.withColumns({"_start": place(START_NAMES), "_end": place(END_NAMES), "_text": place(TEXT_NAMES)})
    # a filter for texts without records, as that of an inner explode, would read every text a second time
    rows = rows.select("file_id", "_start", "_end", "_text", F.posexplode_outer(F.slice("_records", F.lit(2), F.size("_records"))).alias("row_no", "_r")).filter("row_no is not null")
    rows = rows.withColumn("_c", csv_cells(F.col("_r")))
    of = lambda at: F.get("_c", F.col(at) - 1)
    text = F.coalesce(of("_text"), F.when(F.col("_text").isNull(), F.get("_c", F.size("_c") - 1)))
    known = rows.select("file_id", "row_no", F.col("_start").isNotNull().alias("_timed"), tc.parse_ms(of("_start")).alias("_s"), tc.parse_ms(of("_end")).alias("_e"), text.alias("_t"))
    cues = _cues(known, F.col("_s"), F.col("_e"), F.col("_t"), "row_no", "_timed")
    in_turn = ((F.col("cue_no") - 1) * STEP_MS).cast("bigint")
    times = {"start_ms": F.when(F.col("_timed"), F.col("start_ms")).otherwise(in_turn), "end_ms": F.when(F.col("_timed"), F.col("end_ms")).otherwise(in_turn + CUE_MS)}
    return wn.renumber(cues.withColumns(times)).select("file_id", "cue_no", "start_ms", "end_ms", "text")


def read_cue_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return cues_from_rows(rows.withColumns({"file_id": F.col("_metadata.file_path"), "row_no": F.monotonically_increasing_id()}))


_ITEM = "array<struct<start_time:string,start:string,begin:string,end_time:string,end:string,finish:string,text:string,dialogue:string,content:string>>"


def parse_cue_json(docs: DataFrame) -> DataFrame:
    """A list, or an object with subtitles or events, of items with aliased keys; a list of texts is joined by line breaks."""
    t = F.trim("text")
    items = F.when(t.startswith("["), F.from_json(t, _ITEM)).otherwise(let_first(F.from_json(t, f"struct<subtitles:{_ITEM},events:{_ITEM}>")))
    rows = docs.select("file_id", F.posexplode(items).alias("_i", "c"))
    body = F.coalesce("c.text", "c.dialogue", "c.content")
    listed = F.from_json(body, "array<string>")
    text = F.when(F.ltrim(body).startswith("[") & listed.isNotNull(), F.array_join(listed, "\n")).otherwise(body)
    at = lambda *names: tc.ttml_ms(F.concat(F.coalesce(*names), F.when(F.coalesce(*names).rlike(r"^[\d.]+$"), "s").otherwise("")))
    return wn.renumber(_cues(rows, at("c.start_time", "c.start", "c.begin"), at("c.end_time", "c.end", "c.finish"), text))


def let_first(parsed: Column) -> Column:
    return tx.let(parsed, lambda p: F.coalesce(p["subtitles"], p["events"]))


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    from cueloom import schema

    return spark.read.schema(schema.TRANSCRIPT).json(path)


# Header cells of spotting tables by role.
ROLE_NAMES = {
    "start": ("start", "in", "time in", "timecode in", "tc in", "in time", "start time", "timecode", "tc", "start tc"), "end": ("end", "out", "time out", "timecode out", "tc out", "out time", "end time", "end tc", "finish"),
    "duration": ("duration", "dur", "total", "length"), "dialogue": ("dialogue", "dialog", "text", "subtitle", "subtitles", "title", "spoken text", "script", "translation"),
    "other": ("character", "speaker", "notes", "comments", "annotation", "visual", "action", "description", "scene", "shot", "no", "no.", "#", "id"),
}


def cell_role(cell: Column) -> Column:
    """Role of a header cell, or null."""
    t = F.trim(F.regexp_replace(F.lower(cell), r"[\s_\-:]+", " "))
    out = None
    for role, names in ROLE_NAMES.items():
        out = F.when(t.isin(*names), role) if out is None else out.when(t.isin(*names), role)
    return out


def table_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|(.*)\|$", "$1"), r"\|"), lambda c: F.trim(c))


def parse_spotting_table(docs: DataFrame) -> DataFrame:
    """Tables with a header line of known roles, cells between bars; a row without timecode continues the cue before."""
    lines = line_table(docs).filter(F.col("line").contains("|")).withColumn("_c", table_cells(F.col("line")))
    roles = F.transform("_c", lambda c: F.coalesce(cell_role(c), F.lit("")))
    lines = lines.withColumn("_r", roles)
    heads = lines.filter(F.array_contains("_r", "start") & F.array_contains("_r", "dialogue")).groupBy("file_id").agg(F.min_by(F.struct("line_no", "_r"), "line_no").alias("_h"))
    rows = lines.drop("_r").join(heads, "file_id").filter(F.col("line_no") > F.col("_h.line_no"))
    of = lambda role: F.get("_c", F.array_position("_h._r", role).cast("int") - 1)
    rows = rows.withColumns({"_s": tc.parse_ms(of("start")), "_e": tc.parse_ms(of("end")), "_t": of("dialogue")})
    return _continued(rows.withColumn("_new", F.col("_s").isNotNull()))


def _continued(rows: DataFrame) -> DataFrame:
    """Rows (_new, _s, _e, _t, line_no) gathered into cues: a row that isn't new belongs to the one before."""
    order = Window.partitionBy("file_id").orderBy("line_no")
    keyed = rows.withColumn("_k", F.sum(F.col("_new").cast("int")).over(order)).filter("_k > 0")
    cues = keyed.groupBy("file_id", "_k").agg(F.min_by("_s", "line_no").alias("_s"), F.min_by("_e", "line_no").alias("_e"), F.array_sort(F.collect_list(F.when(F.coalesce("_t", F.lit("")) != "", F.struct("line_no", "_t")))).alias("_l"))
    return wn.renumber(_cues(cues, F.col("_s"), F.col("_e"), F.array_join(F.transform("_l", lambda x: x["_t"]), "\n"), "_k"))


def parse_spotting_rows(docs: DataFrame) -> DataFrame:
    """Headerless rows: the last two timecode cells are start and end and the rightmost cell with a letter the dialogue; a row with one
    leading timecode ends two frames before the next."""
    lines = line_table(docs).withColumn("_c", table_cells(F.col("line")))
    codes = F.filter("_c", lambda c: c.rlike(rf"^{TC}$"))
    words = F.filter("_c", lambda c: c.rlike(r"\p{L}") & ~c.rlike(rf"^{TC}$"))
    lines = lines.withColumns({"_codes": codes, "_words": words})
    n = F.size("_codes")
    lead = F.regexp_extract("line", rf"^({TC})\s+(\S.*)$", 1)
    lines = lines.withColumns({
        "_s": F.when(n >= 2, tc.parse_ms(F.get("_codes", n - 2))).when(n == 1, tc.parse_ms(F.get("_codes", F.lit(0)))).otherwise(tc.parse_ms(lead)), "_e": F.when(n >= 2, tc.parse_ms(F.get("_codes", n - 1))),
        "_t": F.when(F.size("_c") > 1, F.get("_words", F.size("_words") - 1)).otherwise(F.regexp_extract("line", rf"^{TC}\s+(\S.*)$", 1)),
    }).filter("_s is not null and coalesce(_t, '') <> ''")
    order = Window.partitionBy("file_id").orderBy("line_no")
    ended = lines.withColumn("_e", F.coalesce("_e", F.when(F.lead("_s").over(order).isNotNull(), F.greatest(F.lit(0), F.lead("_s").over(order) - 80)), F.col("_s") + 2000))
    return wn.renumber(_cues(ended, F.col("_s"), F.col("_e"), F.col("_t"), "line_no"))


def parse_as_broadcast(docs: DataFrame) -> DataFrame:
    """The dialogue section of an as-broadcast list, and narrative titles as `[KIND] text`, by time. The section runs from a line
    `DIALOGUE LIST` to `CAST`, `MUSIC`, `CREDITS` or `NOTES`; without such a header the whole text counts."""
    lines = line_table(docs)
    upto = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(r"(?i)^(?:as[- ]broadcast\s+)?dialogue(?:\s+list)?\s*:?$"), "in").when(F.col("line").rlike(r"(?i)^(?:cast(?:\s+list)?|music(?:\s+cue sheet)?|credits|notes)\s*:?$"), "out")
    lines = lines.withColumn("_m", mark).withColumn("_in", F.last("_m", ignorenulls=True).over(upto)).withColumn("_any", F.max(F.col("_m") == "in").over(Window.partitionBy("file_id")))
    rows = lines.filter((F.col("_in") == "in") | ~F.coalesce("_any", F.lit(False))).filter("_m is null")
    code, kind = F.regexp_extract("line", rf"^({TC})\s*", 1), r"(?i)^(narrative title|main title|title|caption|subtitle|sign)\s*[:\-]\s*"
    body = F.trim(F.regexp_replace("line", rf"^{TC}\s*", ""))
    tagged = F.when(body.rlike(kind), F.concat(F.lit("["), F.upper(F.regexp_extract(body, kind, 1)), F.lit("] "), F.regexp_replace(body, kind, ""))).otherwise(F.regexp_replace(body, tx.SPEAKER, ""))
    rows = rows.withColumns({"_s": tc.parse_ms(code), "_e": F.lit(None).cast("long"), "_t": tagged})
    cues = _continued(rows.withColumn("_new", F.col("_s").isNotNull()))
    return wn.ends_before_next(wn.sorted_by_start(cues))


def parse_flat_script(docs: DataFrame, least: int = 5) -> DataFrame:
    """A timecode alone on a line, a speaker in capitals, then dialogue; files with fewer than `least` frame timecodes give nothing."""
    lines = line_table(docs)
    code = F.col("line").rlike(r"^\d{1,2}:\d{2}:\d{2}[:;]\d{2}$")
    enough = lines.groupBy("file_id").agg(F.count_if(code).alias("n")).filter(F.col("n") >= least).select("file_id")
    rows = lines.join(enough, "file_id", "left_semi").withColumns({"_new": code, "_s": F.when(code, tc.parse_ms(F.col("line"))), "_e": F.lit(None).cast("long"), "_t": F.when(~code & ~F.col("line").rlike(r"^[A-Z][A-Z0-9 .'\-/()]{0,40}:?$"), F.col("line"))})
    return wn.ends_before_next(_continued(rows))


def parse_footage(docs: DataFrame) -> DataFrame:
    """Rows that end in START, FINISH and TOTAL in feet.frames, the dialogue in the cell before; header rows are skipped."""
    lines = line_table(docs).withColumn("_c", table_cells(F.regexp_replace("line", r"\s{2,}|\t", "|")))
    n = F.size("_c")
    foot = lambda k: F.get("_c", n - k)
    rows = lines.filter(n >= 4).withColumns({"_s": tc.footage_ms(foot(3)), "_e": tc.footage_ms(foot(2)), "_t": foot(4)}).filter("_s is not null and _e is not null").filter(~F.col("line").rlike("(?i)start.*finish"))
    return wn.renumber(_cues(rows, F.col("_s"), F.col("_e"), F.col("_t"), "line_no"))


def unstack_cells(cells: DataFrame) -> DataFrame:
    """(file_id, row_no, codes array, lines array) to cues: a row with n >= 2 timecodes sends line d of L to timecode
    round(d (n-1) / (L-1)); one starts a cue; none continues the cue before. Visual notes go, repeated timecodes merge."""
    visual = r"(?i)\b(?:logo|montage|visual|camera|shot of|cut to|close[- ]?up|wide shot)\b"
    spoken = F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: (F.trim(x) != "") & ~x.rlike(visual))
    rows = cells.withColumn("_l", spoken).select("file_id", "row_no", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.size("_l").alias("_n"), F.posexplode_outer("_l").alias("_d", "_t"))
    at = F.when(F.size("codes") <= 1, 0).otherwise(F.when(F.col("_n") <= 1, 0).otherwise(F.bround(F.col("_d") * (F.size("codes") - 1) / (F.col("_n") - 1)).cast("int")))
    rows = rows.withColumns({"_at": at, "_s": tc.parse_ms(F.get("codes", at.cast("int")))}).withColumn("line_no", F.row_number().over(Window.partitionBy("file_id").orderBy("row_no", "_d")))
    before = F.lag("_s").over(Window.partitionBy("file_id").orderBy("line_no"))
    rows = rows.withColumn("_prev", before).withColumn("_e", F.lit(None).cast("long"))
    return wn.ends_before_next(_continued(rows.withColumn("_new", F.col("_s").isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") != F.col("_s"))))))


def infer_columns(cells: DataFrame) -> DataFrame:
    """(table_id, row_no from 0, col_no, cell) to (table_id, role, col_no): header names first, then a bare timecode in row 1 with the
    rightmost worded cell, then votes over the first three rows of tables with 15 rows or fewer."""
    header = cells.filter("row_no = 0").withColumn("role", cell_role(F.col("cell"))).filter("role in ('start', 'end', 'dialogue')").groupBy("table_id", "role").agg(F.min("col_no").alias("col_no"), F.lit(1).alias("_p"))
    row1 = cells.filter("row_no = 1")
    bare = row1.filter(F.trim("cell").rlike(rf"^{TC}$")).groupBy("table_id").agg(F.min("col_no").alias("col_no")).select("table_id", F.lit("start").alias("role"), "col_no", F.lit(2).alias("_p"))
    worded = row1.filter(F.col("cell").rlike(r"\p{L}{2,}")).groupBy("table_id").agg(F.max("col_no").alias("col_no")).join(bare.select("table_id"), "table_id", "left_semi").select("table_id", F.lit("dialogue").alias("role"), "col_no", F.lit(2).alias("_p"))
    small = cells.groupBy("table_id").agg(F.max("row_no").alias("_m")).filter("_m < 15").select("table_id")
    lines = F.filter(F.split("cell", r"\R"), lambda x: F.trim(x) != "")
    share = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))) / F.greatest(F.lit(1), F.size(lines))
    vote = F.when(share(TC) >= 0.5, "start").when(share(r"(?i)\b(?:logo|montage|visual|camera|shot)\b") >= 0.35, "visual").otherwise("dialogue")
    voted = cells.filter("row_no < 3").join(small, "table_id", "left_semi").withColumn("role", vote).filter("role <> 'visual'").groupBy("table_id", "role", "col_no").count()
    voted = voted.groupBy("table_id", "role").agg(F.max_by("col_no", F.struct("count", -F.col("col_no"))).alias("col_no"), F.lit(3).alias("_p"))
    best = header.unionByName(bare).unionByName(worded).unionByName(voted)
    return best.groupBy("table_id", "role").agg(F.min_by("col_no", "_p").alias("col_no"))


# Words of a header row, and font names of marked words.
HEADER_ROW = r"(?i)(?=[STF])(?:Sh#|ShTimeIn|SceneDescription|Time\s*In|Time\s*Out|Titles|SC#|FOOTAGE|SHOT\s*DESCR|START\s*:|FINISH\s*:|TOTAL\s*:|TITLE#|TITLE\s*:)"
BOLD, ITALIC = r"(?i)Bold|Heavy|Black", r"(?i)Italic|Oblique"
#: Least columns of a table, and pixels by which a word may stand before its column.
TABLE_COLUMNS, OVERHANG = 4, 8.0
#: Pixels of rows, of a gap between columns, and between the starts of a column.
ROW_PX, GAP_PX, JOIN_PX = 3, 40.0, 30.0


def _placed(words: DataFrame) -> DataFrame:
    """(doc_id, page, row_y, x0, t) of layout words that have place and text: their row on the page, and their text marked by font."""
    font = F.coalesce("font", F.lit(""))
    marked = F.when(font.rlike(BOLD), F.concat(F.lit("**"), F.col("text"), F.lit("**"))).when(font.rlike(ITALIC), F.concat(F.lit("*"), F.col("text"), F.lit("*"))).otherwise(F.col("text"))
    kept = words.filter("text is not null and x0 is not null and y is not null")
    return kept.select("doc_id", "page", (F.bround(F.col("y") / ROW_PX) * ROW_PX).cast("int").alias("row_y"), "x0", marked.alias("t"))


def visual_rows(words: DataFrame) -> DataFrame:
    """(doc_id, page, row_y, words) of layout words: a row a line on the page, words array<struct<x0, t>> from the left, marked by font."""
    return _placed(words).groupBy("doc_id", "page", "row_y").agg(F.array_sort(F.collect_list(F.struct("x0", "t"))).alias("words"))


def _cells(words: Column, begins: Column) -> Column:
    """The texts of columns, empty ones too: the first column ends where the first of `begins` (ascending) is reached, and so on.
    Words stand from the left, so a column is a run of them."""
    cuts = F.transform(begins, lambda b: F.size(F.filter(words, lambda w: w["x0"] < b)))
    at = F.concat(F.array(F.lit(0)), cuts, F.array(F.size(words)))
    cell = lambda texts, cut, k: F.array_join(F.slice(texts, cut[k] + 1, cut[k + 1] - cut[k]), " ")
    return tx.let(F.transform(words, lambda w: w["t"]), lambda texts: tx.let(at, lambda cut: F.transform(F.sequence(F.lit(0), F.size(cut) - 2), lambda k: cell(texts, cut, k))))


def words_to_rows(words: DataFrame) -> DataFrame:
    """Layout words (doc_id, page, y, x0, x1, text, font) to (doc_id, page, row_y, line).

    Columns begin at the words of a page's first header row, or of the first one on an earlier page; a word belongs to the last
    column that begins at most OVERHANG px to its right. Cells are joined by bars, rows without a table of TABLE_COLUMNS by blanks.
    The document's first header row is a line, other headers and what stands above a page's header go. Words without place or text
    are left out.
    """
    # by document: one exchange serves the windows of pages and of documents
    rows = visual_rows(words).repartition("doc_id")
    page, upto = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id").orderBy("page").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    plain = F.array_join(F.transform("words", lambda w: w["t"]), " ")
    rows = rows.withColumn("_header_y", F.min(F.when(plain.rlike(HEADER_ROW), F.col("row_y"))).over(page))
    head = F.when(F.col("row_y") == F.col("_header_y"), F.transform("words", lambda w: w["x0"]))
    rows = rows.withColumns({"_own": F.first(head, ignorenulls=True).over(page), "_first": F.min(F.when(head.isNotNull(), F.struct("page", "row_y", head.alias("x")))).over(upto)})
    bounds = F.coalesce("_own", F.col("_first.x"), F.array().cast("array<double>"))
    is_first = (F.col("page") == F.col("_first.page")) & (F.col("row_y") == F.col("_first.row_y"))
    rows = rows.withColumn("_b", bounds).filter(F.col("_header_y").isNull() | (F.col("row_y") > F.col("_header_y")) | is_first)
    placed = _cells(F.col("words"), F.transform(F.slice("_b", F.lit(2), F.size("_b")), lambda b: b - OVERHANG))
    line = F.when(F.coalesce(is_first, F.lit(False)), F.array_join(F.transform("words", lambda w: w["t"]), " | ")).when(F.size("_b") >= TABLE_COLUMNS, F.array_join(placed, " | ")).otherwise(plain)
    return rows.select("doc_id", "page", "row_y", line.alias("line")).filter(F.trim(F.translate("line", "|", "")) != "")


def column_bounds(words: DataFrame) -> DataFrame:
    """(doc_id, page, bound): where columns recur on a page: starts of words GAP_PX or more behind the start before, clustered while
    neighbours are within JOIN_PX, clusters kept that hold a third of the page's rows and two at least; the whole mean of each."""
    return _pages(words, "row_y", "x0").select("doc_id", "page", F.explode_outer("_b").alias("bound")).filter("bound is not null")


def _pages(words: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, page, _w, _b) of layout words: a page's words array<struct<row_y, x0, ..>> in order, and its bounds.

    Words go out once, as an array a column, which takes less than half the room of an array of structs; all else is done in the page."""
    listed = _placed(words).groupBy("doc_id", "page").agg(*(F.collect_list(c).alias(c) for c in columns))
    pages = listed.select("doc_id", "page", F.array_sort(F.arrays_zip(*columns)).alias("_w"))
    before = lambda i: F.get("_w", i - 1)
    starts = F.filter("_w", lambda w, i: (i > 0) & (w["row_y"] == before(i)["row_y"]) & (w["x0"] - before(i)["x0"] >= GAP_PX))
    pages = pages.withColumns({"_s": F.array_sort(F.transform(starts, lambda w: w["x0"])), "_rows": F.size(F.array_distinct(F.transform("_w", lambda w: w["row_y"])))})
    opens = F.filter(F.transform("_s", lambda x, i: F.when((i == 0) | (x - F.get("_s", i - 1) > JOIN_PX), i)), lambda i: i.isNotNull())
    pages = pages.withColumn("_o", opens)
    islands = F.transform("_o", lambda a, k: F.slice("_s", a + 1, F.coalesce(F.get("_o", k + 1), F.size("_s")) - a))
    kept = F.filter(islands, lambda x: F.size(x) >= F.greatest(F.lit(2), F.floor(F.col("_rows") / 3)))
    mean = lambda x: F.floor(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)).cast("int")
    return pages.select("doc_id", "page", "_w", F.transform(kept, mean).alias("_b"))


def banded_rows(words: DataFrame) -> DataFrame:
    """(doc_id, page, row_y, line) of layout words by the columns that recur on their page, cells joined by bars; by blanks where none does."""
    pages = _pages(words, "row_y", "x0", "t")
    begins = F.filter(F.transform("_w", lambda w, i: F.when((i == 0) | (w["row_y"] != F.get("_w", i - 1)["row_y"]), i)), lambda i: i.isNotNull())
    pages = pages.withColumn("_at", begins)
    row = F.transform("_at", lambda a, k: F.slice("_w", a + 1, F.coalesce(F.get("_at", k + 1), F.size("_w")) - a))
    # not the inner explode: its filter for pages without rows would sort every page a second time
    rows = pages.select("doc_id", "page", "_b", F.explode_outer(row).alias("words"))
    placed = _cells(F.col("words"), F.col("_b").cast("array<double>"))
    line = F.when(F.size("_b") == 0, F.array_join(F.transform("words", lambda w: w["t"]), " ")).otherwise(F.array_join(placed, " | "))
    return rows.select("doc_id", "page", F.get("words", F.lit(0))["row_y"].alias("row_y"), line.alias("line"))


EXTENSIONS = {"srt": "srt", "vtt": "vtt", "ass": "ass", "ssa": "ass", "sub": "microdvd", "sbv": "sbv", "lrc": "lrc", "ttml": "ttml", "dfxp": "ttml", "xml": "ttml", "csv": "csv", "json": "json", "txt": "txt"}
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"srt": parse_srt, "vtt": parse_vtt, "ass": parse_ass, "microdvd": parse_microdvd, "sbv": parse_sbv, "lrc": parse_lrc, "ttml": parse_ttml, "csv": parse_csv, "json": parse_cue_json, "txt": parse_txt}


def detect_format(file_name: Column, text: Column) -> Column:
    """Format by extension, else by content, else txt."""
    extension = F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for k, v in EXTENSIONS.items():
        out = F.when(extension == k, v) if out is None else out.when(extension == k, v)
    head = F.ltrim(F.coalesce(text, F.lit("")))
    by_content = F.when(head.startswith("WEBVTT"), "vtt").when(head.contains("[Events]"), "ass").when(head.rlike(r"(?m)^\{\d+\}\{\d+\}"), "microdvd").when(head.rlike(r"(?i)<tt[\s>]"), "ttml").when(head.rlike(r"^[\[{]\s*[\[{\"]"), "json").when(head.contains("-->"), "srt").when(head.rlike(r"(?m)^\[\d{1,2}:\d{2}"), "lrc")
    return F.coalesce(out, by_content, F.lit("txt"))


def parse_any(docs: DataFrame) -> DataFrame:
    """Cues of (file_id, file_name, text) by each file's format; a file in which nothing was found gives a cue for each line.

    One scan tells the formats and deals the texts out to folders by format, of which each parser reads its own only. Files without
    cues are found by their ids; only their texts are read again. A null text gives no cue.
    """
    spark, path = docs.sparkSession, shared.shared_path(docs.sparkSession, "by-format")
    known = docs.select("file_id", "text", detect_format(F.col("file_name"), F.col("text")).alias("_format"))
    known.write.partitionBy("_format").parquet(path)
    dealt = spark.read.schema(known.schema).parquet(path)
    out = None
    for name, parser in PARSERS.items():
        own = parser(dealt.filter(F.col("_format") == name).drop("_format"))
        out = own if out is None else out.unionByName(own)
    cues = shared.written(out, "cues")
    failed = shared.written(dealt.select("file_id").join(cues.select("file_id").distinct(), "file_id", "left_anti"), "failed-files")
    return cues.unionByName(parse_txt(dealt.join(failed, "file_id", "left_semi").drop("_format")))


def detect_structure(text: Column) -> Column:
    """One of ten labels of a document by ordered tests."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    return (
        F.when(t.rlike(r"\d{2}:\d{2}:\d{2},\d{3}\s*-->"), "srt").when(t.rlike(r"^\s*WEBVTT"), "vtt").when(t.rlike(r"(?i)<tt[\s>]|<p\s+[^>]*begin="), "ttml")
        .when(count(r"(?m)\b\d{1,4}\.\d{2}\s+\d{1,4}\.\d{2}\s+\d{1,3}\.\d{2}\s*$") >= 3, "ccsl_footage").when(count(r"(?im)^\s*(?:spotting|combined continuity)") >= 1, "ccsl_double_dialogue").when(count(r"(?m)^[^\n|]*\|[^\n|]*\|") >= 3, "table")
        .when(count(r"(?m)^[A-Z][A-Z0-9 .'\-]{1,40}:") >= 3, "paragraph_with_speaker").when(count(r"\d{1,2}:\d{2}:\d{2}[:;]\d{2}") >= 3, "paragraph_with_timecodes").when(count(r"(?m)^\d+[\t;,]") >= 3, "excel_list").when(F.trim(t) != "", "plain").otherwise("unknown")
    )


def extract_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """(file_id, structure, line_no, text) of dialogue by structure: timecodes, counters, labels and notes go, invalid lines are left
    out, and neighbours that are equal count once. A file that gives fewer than 10 of over 30 lines is read again as a script with
    speakers."""
    # one pass over the texts: a line keeps the structure of its file, which is told before the lines come out, not for each of them
    told = docs.select("file_id", detect_structure(F.col("text")).alias("structure"), _lines(F.coalesce("text", F.lit(""))).alias("_l"))
    lines = told.select("file_id", "structure", F.posexplode("_l").alias("line_no", "line"))
    lines = lines.withColumn("line_no", F.col("line_no") + 1)
    cells = table_cells(F.col("line"))
    worded = F.filter(cells, lambda c: c.rlike(r"\p{L}{2,}"))
    label = F.regexp_replace("line", tx.SPEAKER, "")
    body = F.when(F.col("structure") == "table", F.get(worded, F.size(worded) - 1)).when(F.col("structure").isin("srt", "vtt"), F.when(~F.col("line").rlike(r"-->|^\d+$|^WEBVTT|^NOTE|^STYLE"), F.col("line"))).when(F.col("structure") == "paragraph_with_timecodes", F.regexp_replace(label, rf"^{TC}\s*", "")).otherwise(label)
    first = lines.withColumn("text", tx.extraction_line(body))
    file = Window.partitionBy("file_id")
    valid = first.withColumn("_ok", pr.is_valid_line(F.col("text"), min_words))
    counted = valid.withColumn("_again", (F.count("*").over(file) > 30) & (F.count_if("_ok").over(file) < 10))
    out = counted.withColumn("text", F.when(F.col("_again"), tx.extraction_line(label)).otherwise(F.col("text"))).filter(F.when(F.col("_again"), pr.is_valid_line(F.col("text"), min_words)).otherwise(F.col("_ok")))
    return wn.consecutive_dedup(out.select("file_id", "structure", F.col("line_no").alias("cue_no"), "text")).withColumnRenamed("cue_no", "line_no")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cues of every subtitle file below path, whatever its format."""
    return parse_any(texts(spark, path))
