"""Column functions on literal rows."""

import re

import pytest
from pyspark.sql import functions as F

from cueloom.functions import italics as it
from cueloom.functions import predicates as pr
from cueloom.functions import text as tx
from cueloom.functions import timecode as tc
from cueloom.operators import audit
from cueloom.operators import platforms as pl


def each(spark, f, pairs):
    """Checks f(column) on (input, expected) pairs in one job."""
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string")
    got = {r.i: r.y for r in rows.select("i", f(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(pairs))] == [b for _, b in pairs]


def test_timecodes(spark):
    each(spark, tc.parse_ms, [("01:00:07:06", 3607240), ("1:1:48:5", 3708200), ("00:00:01,5", 1500), ("00:00:01.250", 1250), ("01.02.03", 3723000), ("01.02.03.10", 3723400), ("01:02", None), ("02:01.500", 121500), ("x", None), (None, None)])
    each(spark, tc.normalise, [("01:00:07:06", "01:00:07,240"), ("1:1:48:5", "01:01:48,200"), ("0:59:61,0", "01:00:01,000"), ("nothing", "nothing"), ("00:00:01;12", "00:00:01,480")])
    each(spark, lambda c: tc.snap_seconds(c.cast("double")), [("5.1", 5080), ("2.5", 2480), ("6.5", 6480), ("0.02", 0), ("0.06", 80)])
    each(spark, tc.footage_clock, [("56.11", "00:00:37:19"), ("1.16", None), ("x", None)])
    each(spark, tc.offset_ms, [("-00:00:01,500", -1500), ("+1.5s", 1500), ("2", 2000), ("-3 sec", -3000), ("soon", None)])
    each(spark, tc.ttml_ms, [("1.5s", 1500), ("00:00:01.5", 1500), ("00:01:00", 60000), ("250ms", 250), ("25f", 1000), ("later", None)])
    each(spark, lambda c: tc.ass_clock(tc.ass_ms(c)), [("0:00:01.25", "0:00:01.25"), ("1:02:03.04", "1:02:03.04")])
    each(spark, tc.qc_seconds, [("00:00:01:05", 1.2), ("00:00:01,5", 1.5), ("bad", None)])


def test_punctuation_and_numbers(spark):
    each(spark, tx.fix_punctuation, [("Wait..  what ??", "Wait... what?"), ("No!!  Yes ,", "No! Yes,"), ("Really?!", "Really!"), ("a.... b", "a... b"), ("fine...", "fine...")])
    each(spark, lambda c: tx.number_words(c, F.lit(10)), [("3 in the morning", "3 in the morning"), ("5 mph", "five mph"), ("I saw 3 dogs.", "I saw three dogs."), ("$5 or 10%", "$5 or 10%"), ("10 of 12", "ten of 12"), ("2nd of 2", "2nd of two")])
    each(spark, tx.american_spelling, [("The colour", "The color"), ("Colour", "Color"), ("cancelled Programme", "canceled Program"), ("none", "none")])
    each(spark, tx.capitalise, [("hello\nyou", "Hello\nYou"), ("...and then", "...and then"), ("<i>so</i>", "<i>So</i>"), ("- ...still", "- ...still"), ("123 go", "123 Go"), ("", "")])
    each(spark, tx.strip_trailing_descriptor, [("Go away. (dismissive tone)", "Go away."), ("Go. (What now?)", "Go. (What now?)"), ("Go. (John)", "Go. (John)")])
    each(spark, tx.strip_speaker_labels, [("JOHN: Hello", "Hello"), ("<i>MARY - Hi</i>", "<i>Hi</i>"), ("JOHN:", "JOHN:"), ("John: x", "John: x")])
    each(spark, tx.strip_fillers, [("Uh, I um know", "I know"), ("umbrella", "umbrella")])
    each(spark, tx.acronym_dots, [("The F.B.I. came", "The FBI came"), ("U.S. law", "US law")])
    each(spark, tx.lyric_case, [("♪ la la", "♪ La la"), ("none", "none")])
    each(spark, tx.lyric_end, [("♪ la la,", "♪ la la"), ("la la,", "la la,")])
    each(spark, lambda c: tx.replace_profanity(c, F.create_map(F.lit("damn"), F.lit("d$xxn"))), [("Damn it, damned", "d$xxn it, damned")])
    each(spark, tx.strip_annotations, [("Hi (Syd: nickname) there", "Hi  there"), ("(OPTIONAL) Run", "Run"), ("So (slang for x)", "So ")])


def test_post_process(spark):
    each(spark, tx.post_process, [
        ("<laughs> No.", "No."), ("<laughs> Wow. Time out. Hang on.", "Wow. Time out. Hang on."), ("Oh, what's to think about? <moans>", "Oh, what's to think about?"), ("<exclaims>", ""),
        ("<i>Non</i>e.", "<i>None</i>."), ("<i>Somethin</i>g wrong.", "<i>Something</i> wrong."), ("<i>Flashback</i>", "<i>Flashback</i>"), ("(laughs) That's funny.", "That's funny."),
        ("[MUSIC PLAYING]", "[MUSIC PLAYING]"), ("<cHuckling exhale> Yeah... <exclaims>", "Yeah..."), ("(exhales) So (crying) it is", "So it is"), ("word<i>s</i> here", "<i>words</i> here"), ("<b>x</b> <i> </i>()", "x"),
    ])


def test_wrapping(spark):
    each(spark, lambda c: tx.split_line(c, F.lit(12)), [("one two three four", "one two\nthree four"), ("<i>one two three four</i>", "<i>one two</i>\n<i>three four</i>"), ("short", "short"), ("verylongwordwithoutbreak", "verylongwordwithoutbreak"), ("", "")])
    each(spark, lambda c: tx.wrap(c, F.lit(7)), [("aa bb cc dd", "aa bb\ncc dd"), ("abcdefghij k", "abcdefghij\nk"), ("", "")])
    each(spark, lambda c: tx.text_fits(c, F.lit(7), F.lit(2)), [("aa bb cc dd", True), ("abcdefghij", False), ("a b c d e f g h i j k l", False)])
    each(spark, lambda c: tx.dialogue_chunks(c, F.lit(20), F.lit(1)), [("Hello there. TIM SHAW: How are you? Fine.", ["Hello there.", "How are you? Fine."]), ("", [])])
    each(spark, lambda c: tx.smart_wrap(c, 14), [("Hello there, my friend", "Hello there,\nmy friend"), ("short", "short")])
    each(spark, lambda c: tx.tag_aware_break(c, F.lit(5)), [("<i>aa</i> bb cc", "<i>aa</i> bb\ncc")])


def test_delivery_text(spark):
    each(spark, tx.delivery_text, [
        ("Wizard. (Bleeker's nickname for Juno)", "Wizard."), ("JUNO: Hello\nthere", "Hello\nthere"), ("INT. HOUSE", ""), ("Page 12\nReal words", "Real words"), ("<font color=red>Hi</font> <i>you</i>", "Hi <i>you</i>"),
        ("[MUSIC PLAYING] Stop", "Stop"), ("LILA I thought so.", "I thought so."), ("Song (SINGING)", "Song (SINGING)"), ("**bold** *it*", "<b>bold</b> <i>it</i>"),
    ])
    each(spark, pr.is_dialogue, [("Hello", True), ("A", False), ("JOHN SMITH", False), ("12:30", False), ("INT. HOUSE", False), ("x\nSTORY: 1 LANG: ENG", True), ("MUSIC", False), (None, False)])
    each(spark, lambda c: pr.is_valid_line(c), [("Hello", True), ("(sighs)", False), ("...", False), ("00:01:02", False), ("Directed by X", True), ("page 3", False)])
    each(spark, tx.match_form, [("I can't, it's <i>Colour</i>!", "i cannot it is color"), ("Hôtel, déjà", "hôtel déjà"), (None, "")])
    each(spark, lambda c: pr.in_range(c, 2, 5), [("3", True), ("7", False), ("x", False), (None, False)])


def test_italics(spark):
    each(spark, it.wrap_lyrics, [("♪ la", "<i>♪ la</i>"), ("<i>♪ la</i>", "<i>♪ la</i>"), ("no", "no")])
    each(spark, it.wrap_foreign, [("Say merci, now", "Say <i>merci</i>, now"), ("nonsense", "nonsense"), ("<i>oui oui</i>", "<i>oui oui</i>")])
    policy = {r.platform_key: (r.no_italics, r.italic_lyrics, r.italic_foreign) for r in it.with_policy(spark.createDataFrame([("disney_1", ["x"]), ("new", ["No italics please"]), ("song", ["Song lyrics in italics"])], "platform_key string, rules array<string>")).collect()}
    assert policy == {"disney_1": (False, True, True), "new": (True, False, False), "song": (False, True, False)}


def test_hints(spark):
    pairs = [
        ("[MUSIC] Hi", "Hi", ["hoh_removed"]), ("Hi (waves)", "Hi", ["stage_removed"]), ("JOHN: hi", "Hi", ["char_name_removed"]), ("Uh, hi", "Hi", ["filler_removed"]), ("a  b", "a b", ["double_space"]), ("No!!", "No!", ["double_punct"]),
        ("hi", "Hi", ["capitalize"]), ("I saw 3", "I saw three", ["number_to_word"]), ("my colour", "my color", ["us_spelling"]), ("same", "same", []), ("wait....", "wait...", ["ellipsis"]), ("F.B.I.", "FBI", ["acronym_dots"]),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.h for r in rows.select("i", audit.derive_hints(F.col("a"), F.col("b"), F.lit(42)).alias("h")).collect()}
    for i, (_, _, want) in enumerate(pairs):
        assert set(want) <= set(got[i]) and (want or not got[i]), (pairs[i], got[i])


@pytest.mark.parametrize("rule, bucket", [("Minimum gap of 2 frames", "timing"), ("Maximum 42 characters per line", "text"), ("Raise subtitle over graphics", "positioning"), ("File naming as agreed", "file"), ("Use sentence case", "text")])
def test_rule_buckets(spark, rule, bucket):
    assert spark.range(1).select(pl.rule_bucket(F.lit(rule))).head()[0] == bucket


def test_long_pieces_stay_whole(spark):
    piece = "b" * (1 << 20) + "tail"
    each(spark, tx.lyric_case, [(f"♪ a{piece}", f"♪ A{piece}")])
    report = spark.createDataFrame([("p", [f"Rule: {piece}"])], "platform_key string, labels array<string>")
    assert audit.unproved(report, spark.createDataFrame([("p", piece)], "platform_key string, rule string")).count() == 0


def test_every_trailing_explanation_goes(spark):
    each(spark, tx.strip_explanations, [("Hello" + " (a long explanation)" * 20, "Hello"), ("Hello (short)" + " (a long explanation)" * 9, "Hello (short)"), (None, None)])


def _wrapped(text, width, overflow):
    """Line by line, gap by gap."""
    import re

    shown = lambda t: len(re.sub(r"<[^>]+>", "", t))
    out = []
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        while shown(line) > width + overflow:
            best, used = None, -1
            for n, gap in enumerate(re.finditer(r"\s+", line)):
                left, right = line[: gap.start()], line[gap.end() :]
                clause = gap.start() >= used and re.match(r"(and|but|or|because|so|then|that|while|when|where)\s+", right, re.I)
                if clause:
                    used = gap.end() + clause.end()
                if shown(left) <= width + overflow:
                    kind = 0 if left[-1] in ".!?;:" else 1 if left[-1] == "," else 2 if clause else 3
                    key = (shown(left) > width, max(0, shown(left) - width), shown(right) < 6, kind, -shown(left), abs(shown(left) - shown(right)), n)
                    best = min(best, (key, left, right)) if best else (key, left, right)
            if best is None:
                break
            out.append(best[1])
            line = best[2]
        out.append(line)
    return out


def test_lines_are_cut_at_natural_places(spark):
    import random

    rng = random.Random(4)
    words = ["and", "so", "that", "then", "because", "<i>", "</i>", "<i>word</i>", "hello,", "world.", "a", "I", "something", "extraordinarily", "it;", "why?", "<font color=red>", "where", "x"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["", "   ", "aaaa" * 30, "word " * 400, "One two three four. Five six seven, eight nine and ten eleven twelve"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for width, overflow in ((14, 3), (20, 0), (42, 3)):
        got = {r.i: r.lines for r in table.select("i", tx.smart_lines(F.col("t"), width, overflow).alias("lines")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == _wrapped(t, width, overflow), (width, t)
    one = lambda t, w: spark.createDataFrame([(t,)], "t string").select(tx.smart_lines(F.col("t"), w)).head()[0]
    assert len(one("I came here, I saw the place, and I left", 16)) == 3
    assert len(one("First part here. Second part here; third part here, fourth part and the fifth part", 18)) == 5


def test_scenes_are_packed_by_sentence(spark):
    import random
    import re
    import textwrap

    def packed(text, width, most):
        fits = lambda t: len(w := textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)) <= most and all(len(x) <= width for x in w)
        out, now = [], ""
        for s in re.split(r"(?<=[.!?…])\s+", text):
            joined = f"{now} {s}".strip()
            if now and not fits(joined):
                out.append(now)
                joined = s
            now = joined
            if not fits(now):
                lines = textwrap.wrap(now, width, break_long_words=False, break_on_hyphens=False)
                out += ["\n".join(lines[k : k + most]) for k in range(0, len(lines), most)]
                now = ""
        return [*out, now] if now else out

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.choice((1, 4, 7, 30)))) + rng.choice(["", "", "", ".", "!", "?"]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for width, most in ((12, 1), (20, 2), (32, 3)):
        got = {r.i: r.c for r in table.select("i", tx.dialogue_chunks(F.col("t"), F.lit(width), F.lit(most)).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == packed(t, width, most), (width, most, t)


def test_long_lines_are_cut_in_little_time(spark):
    import re
    import time

    lines = [" ".join([word] * 6000) for word in ("word, and", "<i>word</i>, and", "a<b")]
    table = spark.createDataFrame([(line,) for line in lines], "t string")
    begin = time.time()
    got = [r.parts for r in table.select(tx.smart_lines(F.col("t"), 28).alias("parts")).collect()]
    assert time.time() - begin < 20
    for line, parts in zip(lines, got, strict=True):
        assert " ".join(p.rstrip() for p in parts) == line and all(len(re.sub("<[^>]+>", "", p)) <= 31 for p in parts)


def test_wrapping_by_pattern_and_gated_steps_keep_their_results(spark):
    def greedy(text, width):
        lines, now = [], ""
        for w in [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]:
            if now and len(now) + 1 + len(w) > width:
                lines.append(now)
                now = w
            else:
                now = f"{now} {w}" if now else w
        return [*lines, now] if now else lines

    texts = ["", "  ", "one", "a bb ccc dddd eeeee ffffff", "\tlead and\n\ntrail \x0b", "a verylongwordindeed b", "x\x85y z w  q\x85", "😀😀 😀😀😀 é", "$1 \\E .*"]
    rows = spark.createDataFrame([(t, w) for t in texts for w in (0, 1, 4, 5, 9, 42)], "t string, w int")
    out = rows.select("t", "w", tx.wrap_lines(F.col("t"), F.col("w")).alias("l"))
    assert "aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()  # words were added one by one
    for r in out.collect():
        assert r.l == greedy(r.t, r.w), (r.t, r.w)
    whole = spark.createDataFrame([("a b  c", None), (None, 3)], "t string, w int").select(tx.wrap_lines(F.col("t"), F.col("w")).alias("l")).collect()
    assert [r.l for r in whole] == [["a b c"], None]
    each(spark, tx.capitalise, [("one", "One"), ("Two", "Two"), ("- three", "- Three"), ("<i>four</i>", "<i>Four</i>"), ("...five", "...five"), ("émile", "éMile"), ("6 six", "6 Six"), ("", ""), (None, None)])
    each(spark, tx.american_spelling, [("Colour of the THEATRE, my favourite", "Color of the THEATER, my favorite"), ("colours", "colors"), ("plain", "plain"), (None, None)])
    each(spark, tx.strip_annotations, [(" a (OPTIONAL) b (slang for x) ", "a b "), (" plain ", "plain"), (None, None)])
