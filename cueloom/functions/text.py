"""Text of cues as columns: the ordered cleaning chain and its steps.

Patterns are literals, so that each is compiled once a task; a step that a platform doesn't ask for, or whose characters a text
lacks, is skipped by a condition. The chain gives each step a projection of its own, in which the text is a plain column.
Rules are compared in lower case, and HOH/EMT in either case.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers and words.
NUMBER_WORDS = {"10": "ten", "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine"}

# British and American spellings.
UK_US = {
    "colour": "color", "colours": "colors", "favourite": "favorite", "favourites": "favorites", "neighbour": "neighbor", "neighbours": "neighbors",
    "honour": "honor", "honours": "honors", "behaviour": "behavior", "behaviours": "behaviors", "flavour": "flavor", "flavours": "flavors",
    "labour": "labor", "labours": "labors", "humour": "humor", "tumour": "tumor", "realise": "realize", "realises": "realizes", "realised": "realized",
    "organise": "organize", "organised": "organized", "recognise": "recognize", "recognised": "recognized", "centre": "center", "theatre": "theater",
    "licence": "license", "defence": "defense", "programme": "program", "programmes": "programs", "travelling": "traveling", "cancelled": "canceled",
    "fulfil": "fulfill", "enrol": "enroll",
}

# Patterns of notes that are no dialogue.
SOUND_BRACKET = r"(?i)\[[^\]]*(?:sound|music|applause|laughter|singing|cheering|gunshot|explosion)[^\]]*\]"
SOUND_PAREN = r"(?i)\([^\n]*?(?:music|singing|narrator|narrating|chuckles|laughs|sighs|gasps|crying|sobbing|whimpering)[^\n]*?\)"
ANNOTATION = (
    r"(?i)\(\s*(?:(?:mild\s+)?profanity|slang|informal|archaic|colloquial|dialect|expression\s+of|term\s+of|reference\s+to|nickname\s+for|short\s+for|"
    r"abbreviation|contraction|idiom|euphemism|exclamation|interjection|onomatopoeia|rhetorical|literal(?:ly)?|figurative(?:ly)?|vulgar|offensive|derogatory)[^)]{0,120}\)"
)
FILLER = r"(?iU)\b(?:uh|hmm+|erm|er|um)\b[.,]?\s*"
STAGE_PAREN = (
    r"(?i)\((?:speaking\s+\w+|through\s+\w+|into\s+\w+|to\s+[^)]+|whispering[^)]*|overlaps?|archive|continues?[^)]*|indistinct[^)]*|[^\n]*?music[^\n]*?|sarcastically|quietly|"
    r"loudly|angrily|softly|nervously|in\s+\w+|laughs?|chuckles?|gasps?|sighs?|screams?|cries?|sobbing|moans?|groans?|from\s+[^)]+|off\s*camera|off\s*screen)\)"
)
KEPT_PAREN = r"(?i)^\s*(?:os|vo|oc|cont(?:'d|inued)?|overlapping|sings?|singing|on\s*screen|onscreen|main\s+title|title|ital(?:ics)?|whispering|screaming|laughing)\s*$"
METADATA = (
    r"(?i)^(?:act\s+(?:one|two|three|four|five|\d+)|scene\s+\d+|teaser|cold\s+open|tag|fade\s+in|fade\s+out|cut\s+to|smash\s+cut|match\s+cut|end\s+(?:of\s+)?episode|"
    r"int\.|ext\.|int/ext\.|ext/int\.|(?:\d+(?:st|nd|rd|th)\s+qc:))"
)
SCENE_HEADING = r"(?i)\b(?:int\.|ext\.|int/ext\.|ext/int\.)"
QC_NOTE = r"(?i)\d+(?:st|nd|rd|th)\s+qc\s*:"
SPEAKER = r"^[A-Z][A-Z0-9 .'\-/()#&,]{0,60}[:\-]\s*"
INLINE_SPEAKER = r"^(?:[A-Z]{2,30}(?:\s+[A-Z0-9]{1,30}){0,3}|[A-Z]\s+[A-Z0-9]{1,30})\s+(?=[A-Z][a-z]|I\s|['\"(]|\d)"
# Tags in angle brackets that are no italics or bold, and sound verbs in round brackets.
# White space of Unicode as a class of characters: (?U)\s asks each character for its type.
WHITE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
ANGLE_NOTE = r"<(?!/?(?:i|b)>)[a-zA-Z][^>]{0,60}>"
SOUND_VERBS = (
    r"(?i)\((?:laughs?|chuckles?|sighs?|gasps?|groans?|moans?|cries|crying|sniffles?|exhales?|inhales?|grunts?|screams?|whispers?|sobs?|yells?|shouts?|"
    r"exclaims?|narrat(?:es?|ing|or)|singing|humming|clears? (?:his |her |their )?throat)\)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluating value once."""
    return F.transform(F.array(value), body)[0]


def replaced(text: Column, *rules: tuple[str, str]) -> Column:
    """Replacements of (pattern, new text), one after another."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def where(text: Column, gate: Column | None, step: Callable[[Column], Column]) -> Column:
    """step of the text where gate holds, the text elsewhere; the text is evaluated once."""
    return step(text) if gate is None else let(text, lambda t: F.when(gate, step(t)).otherwise(t))


def gated(text: Column, gate: Column | None, pattern: str, replacement: str = "") -> Column:
    """Replacement of a pattern where gate holds."""
    return where(text, gate, lambda t: F.regexp_replace(t, pattern, replacement))


def by_line(text: Column, f: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), f), "\n")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def visible_length(text: Column) -> Column:
    return F.length(strip_tags(text))


def spoken_length(text: Column) -> Column:
    """Characters that are read: without tags and white space."""
    return F.length(F.regexp_replace(F.when(text.contains("<"), strip_tags(text)).otherwise(text), WHITE, ""))


def canonical_tags(text: Column) -> Column:
    for name in ("i", "b"):
        text = F.regexp_replace(F.regexp_replace(text, rf"(?i)<\s*{name}\s*>", f"<{name}>"), rf"(?i)<\s*/\s*{name}\s*>", f"</{name}>")
    return text


def remove_sounds(text: Column, gate: Column | None = None) -> Column:
    known = r"(?i)\[(?:music|applause|laughter|cheering|singing)[^\]]*\]"
    return where(text, gate, lambda t: replaced(t, (known, ""), (SOUND_BRACKET, ""), (SOUND_PAREN, ""), (r"\[[^\]]{0,80}\]", "")))


def strip_annotations(text: Column) -> Column:
    noted = lambda t: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(t, r"(?i)\(OPTIONAL\)\s*", "")), r"\([^)]{1,120}:[^)]{1,120}\)", ""), ANNOTATION, "")
    return let(text, lambda t: F.when(t.contains("("), noted(t)).otherwise(F.trim(t)))


def strip_trailing_descriptor(text: Column) -> Column:
    """A bracket of 5 to 80 characters at a line's end goes if it begins in lower case and neither asks nor exclaims."""
    return F.regexp_replace(text, r"(?m)\s*\((?=\p{Ll})[^)?!]{5,80}\)\s*$", "")


def strip_stage_directions(text: Column, gate: Column | None = None) -> Column:
    return where(text, gate, lambda t: replaced(t, (r"\([^)]{1,100}\)", ""), (r"\[[^\]]{1,100}\]", "")))


def strip_speaker_labels(text: Column, gate: Column | None = None) -> Column:
    """An upper-case label with colon or dash at a line's start goes, unless nothing else stands in the line."""
    return gated(text, gate, r"(?m)^((?:</?[ib]>)*)[A-Z][A-Z0-9 .'/()]{1,40}[:\-][^\S\n]*(?=(?:</?[ib]>|[^\S\n])*[^\s<])", "$1")


def strip_fillers(text: Column, gate: Column | None = None) -> Column:
    return gated(text, gate, FILLER)


def fillers(text: Column) -> Column:
    """array<string>: the filler words of a text, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(FILLER), F.lit(0)), lambda w: F.regexp_replace(F.lower(w), r"[^a-z]", ""))


def replace_profanity(text: Column, table: Column) -> Column:
    """Whole words of a map<word, replacement> in either case, entry by entry; a null or empty map changes nothing."""
    entries = F.coalesce(F.map_entries(table), F.array().cast("array<struct<key:string,value:string>>"))
    escaped = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    return F.aggregate(entries, text, lambda acc, e: F.regexp_replace(acc, F.concat(F.lit(r"(?iu)\b\Q"), e["key"], F.lit(r"\E\b")), escaped(e["value"])))


def bleeps_to_asterisks(text: Column, gate: Column | None = None) -> Column:
    return gated(text, gate, r"(?i)\*bleep\*|\[bleep\]|\(bleep\)", "****")


def fix_punctuation(text: Column) -> Column:
    """Double blanks, blanks before punctuation, doubled and mixed marks, and dots to exactly three."""
    rules = ((r"  +", " "), (r" ([.,!?;:])", "$1"), (r"!!+", "!"), (r"\?\?+", "?"), (r"[!?][?!]+", "!"), (r"\.{4,}", "..."), (r"(?<!\.)\.{2}(?!\.)", "..."))
    return replaced(text, *rules)


def speaker_hyphens(text: Column, style: Column | None = None) -> Column:
    text = F.regexp_replace(text, "(?m)^[–—]", "-")
    if style is None:
        return text
    text = gated(text, style == "hyphen_no_space", "(?m)^- ", "-")
    return gated(text, style == "hyphen_with_space", r"(?m)^-([^\-\s])", "- $1")


def quotes(text: Column, gate: Column | None = None) -> Column:
    return gated(text, gate, r"(^|\s)'([^']*)'(\s|$|[.,?!])", '$1"$2"$3')


def forbidden_symbols(text: Column, gate: Column | None = None) -> Column:
    return where(text, gate, lambda t: replaced(t, (r"<[^>]+>", ""), ("&", "and"), ("[<>©]", ""), ("°", " degrees")))


def acronym_dots(text: Column, gate: Column | None = None) -> Column:
    return gated(text, gate, r"\b([A-Z])\.([A-Z])\.(?:([A-Z])\b)?\.?", "$1$2$3")


def lyric_case(text: Column, gate: Column | None = None) -> Column:
    """A letter after a music note in upper case; split and rebuilt, since a pattern can't change case."""
    def fixed(t: Column) -> Column:
        raised = F.transform(F.split(t, "(?<=♪)"), lambda p, i: F.when(i > 0, F.concat(F.regexp_extract(p, r"^\s*", 0), F.upper(F.substring(F.ltrim(p), 1, 1)), F.substr(F.ltrim(p), F.lit(2)))).otherwise(p))
        return F.array_join(raised, "")

    return where(text, gate, fixed)


def lyric_end(text: Column, gate: Column | None = None) -> Column:
    return gated(text, gate, r"(?m)^(?=.*[♪♫])(.*?)[,.]+(\s*(?:</i>)?\s*)$", "$1$2")


def story_lang(text: Column, gate: Column | None = None) -> Column:
    return where(text, gate, lambda t: replaced(t, (r"(?i)\bstory\s*:", "STORY:"), (r"(?i)\blang\s*:", "LANG:")))


def capitalise_line(line: Column) -> Column:
    """First letter in upper case, not inside a tag, and not after leading dots."""
    first = F.substring(line, 1, 1)
    raised = lambda prefix: F.concat(prefix, F.upper(F.substr(line, F.length(prefix) + 1, F.lit(1))), F.substr(line, F.length(prefix) + 2))
    fixed = lambda prefix: F.when(line.rlike(r"^-*\s*\.\.\.") | ~line.rlike(r"(?s)^.*?(?<![</])[a-zA-Z]") | prefix.endswith("..."), line).otherwise(raised(prefix))
    # most lines begin with a letter
    other = let(F.regexp_extract(line, r"(?s)^(.*?(?<![</]))[a-zA-Z]", 1), fixed)
    return F.when(first.between("A", "Z"), line).when(first.between("a", "z"), F.concat(F.upper(first), F.substr(line, F.lit(2)))).otherwise(other)


def capitalise(text: Column) -> Column:
    return by_line(text, lambda line: let(F.trim(line), capitalise_line))


_UNITS = "st|nd|rd|th|ft|in|cm|mm|km|kg|lb|am|pm"
#: A lone number: not after $ or %, not before %, and not where the three characters that follow end in a unit.
NUMBER_RULE = r"(?<![$%])\b{}\b(?!%)(?!(?i:.(?:UNITS)|mph|kph|(?:UNITS)$))".replace("UNITS", _UNITS)


def number_words(text: Column, upto: Column | None = None) -> Column:
    """Lone numbers up to `upto` (9 or 10; below that none) in words; without `upto` up to 10.

    Not after $ or %, not before %, and not where the three characters that follow end in a unit.
    """
    for most, digits in ((10, ["10"]), (9, [d for d in NUMBER_WORDS if d != "10"])):
        pairs = [(NUMBER_RULE.format(d), NUMBER_WORDS[d]) for d in digits]
        if upto is None:
            text = replaced(text, *pairs)
        else:
            text = where(text, (upto >= most) & text.rlike("[0-9]"), lambda t, pairs=pairs: replaced(t, *pairs))
    return text


# by first letters, so that a word of the text is compared with few of them
ANY_UK = r"(?i)\b(?:" + "|".join(rf"{a}(?:{'|'.join(w[1:] for w in UK_US if w[0] == a)})" for a in sorted({w[0] for w in UK_US})) + r")\b"


def _spelled(text: Column) -> Column:
    cases = lambda k, v: F.array(*[F.struct(F.lit(rf"\b{case(k)}\b").alias("k"), F.lit(case(v)).alias("v")) for case in (str, str.capitalize, str.upper)])
    table = F.array(*[F.struct(F.lit(k).alias("k"), cases(k, v).alias("cases")) for k, v in UK_US.items()])
    every_case = lambda acc, e: F.aggregate(e["cases"], acc, lambda t, c: F.regexp_replace(t, c["k"], c["v"]))
    # only the words that stand in the text are replaced
    return let(F.lower(text), lambda low: F.aggregate(F.filter(table, lambda e: F.contains(low, e["k"])), text, every_case))


def american_spelling(text: Column) -> Column:
    """British spellings made American, in lower case, with a capital first letter, or all in capitals."""
    return let(text, lambda t: F.when(t.rlike(ANY_UK), _spelled(t)).otherwise(t))


def split_line(line: Column, most: Column) -> Column:
    """A line over `most` characters as two balanced lines; as it is if no cut fits. Italics around the whole line stay on both."""

    def cut(words: Column, whole: Column) -> Column:
        options = F.transform(
            F.sequence(F.lit(1), F.size(words) - 1),
            lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("a"), F.array_join(F.slice(words, i + 1, F.size(words)), " ").alias("b"), i.alias("i")),
        )
        fitting = F.filter(options, lambda o: (F.length(o["a"]) <= most) & (F.length(o["b"]) <= most))
        ranked = F.transform(fitting, lambda o: F.struct(F.abs(F.length(o["a"]) - F.length(o["b"])).alias("d"), o["i"].alias("i"), o["a"].alias("a"), o["b"].alias("b")))
        italic = whole.startswith("<i>") & whole.endswith("</i>")
        joined = lambda best: F.when(italic, F.concat(F.lit("<i>"), best["a"], F.lit("</i>\n<i>"), best["b"], F.lit("</i>"))).otherwise(F.concat(best["a"], F.lit("\n"), best["b"]))
        return let(F.array_min(ranked), lambda best: F.when(best.isNull(), whole).otherwise(joined(best)))

    def measured(s: Column) -> Column:
        words = F.filter(F.split(s["plain"], r"\s+"), lambda w: w != "")
        # no cut of a longer line fits, so its cuts, which grow with the square of its words, aren't tried
        hopeless = lambda w: (F.size(w) <= 1) | (F.length(F.array_join(w, " ")) > 2 * most + 1)
        # that no cut fits is seen without the words where no two blanks stand together
        long = (F.length(s["plain"]) > 2 * most + 3) & ~s["plain"].rlike(r"\s\s")
        return F.when((F.length(s["plain"]) <= most) | long, s["line"]).otherwise(let(words, lambda w: F.when(hopeless(w), s["line"]).otherwise(cut(w, s["line"]))))

    plain = lambda x: F.trim(F.when(x.contains("<"), strip_tags(x)).otherwise(x))
    return let(line, lambda x: let(F.struct(x.alias("line"), plain(x).alias("plain")), measured))


def split_lines(text: Column, most: Column, most_italic: Column | None = None) -> Column:
    limit = lambda line: most if most_italic is None else F.when(line.contains("<i>") | line.contains("</i>"), F.coalesce(most_italic, most)).otherwise(most)
    return by_line(text, lambda line: split_line(F.trim(line), limit(line)))


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def wrap_lines(text: Column, width: Column) -> Column:
    """array<string> of greedily wrapped lines, old line breaks counting as blanks; a word over the width stands alone."""
    single = F.trim(F.regexp_replace(text, r"\s+", " "))
    # the longest run of words that fits, or a word; without a width all is one line
    most = F.greatest(F.coalesce(width.cast("int"), F.lit(1 << 30)) - 1, F.lit(0)).cast("string")
    return F.regexp_extract_all(single, F.concat(F.lit(r"(?s)\S.{0,"), most, F.lit(r"}(?= |\z)|\S+")), F.lit(0))


def wrap(text: Column, width: Column) -> Column:
    return F.array_join(wrap_lines(text, width), "\n")


def line_groups(lines: Column, size: Column) -> Column:
    """array<string>: lines in groups of `size`, joined by line breaks."""

    def grouped(held: Column) -> Column:
        n = F.ceil(F.size(held) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(held, (i * size + 1).cast("int"), size.cast("int")), "\n"))
        return F.when(F.size(held) == 0, F.array().cast("array<string>")).otherwise(cut)

    return let(lines, grouped)


def text_fits(text: Column, width: Column, most_lines: Column) -> Column:
    return let(wrap_lines(text, width), lambda lines: (F.size(lines) <= most_lines) & F.forall(lines, lambda x: F.length(x) <= width))


def tag_aware_break(text: Column, width: Column) -> Column:
    """Greedy wrapping that counts characters outside tags only."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))
    fits = lambda acc, w: visible_length(F.concat(acc["now"], F.lit(" "), w)) <= width
    step = lambda acc, w: F.when(acc["now"] == "", F.struct(acc["lines"].alias("lines"), w.alias("now"))).when(
        fits(acc, w), F.struct(acc["lines"].alias("lines"), F.concat(acc["now"], F.lit(" "), w).alias("now"))
    ).otherwise(F.struct(F.concat(acc["lines"], F.array(acc["now"])).alias("lines"), w.alias("now")))
    return F.array_join(F.aggregate(words, empty, step, lambda acc: F.filter(F.concat(acc["lines"], F.array(acc["now"])), lambda x: x != "")), "\n")


def dialogue_chunks(text: Column, width: Column, most_lines: Column) -> Column:
    """array<string>: a scene's paragraph cut at inline speaker turns, then packed sentence by sentence while it fits."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    turns = F.filter(F.transform(F.split(flat, r"(?<!^)\b[A-Z][A-Z0-9'’\-]+(?:\s+[A-Z][A-Z0-9'’\-]+){0,3}\s*:\s*"), lambda t: F.trim(t)), lambda t: t != "")

    def pack(turn: Column) -> Column:
        """Carries how greedy wrapping stands (lines, characters of the open one, widest word), so each word is looked at once."""
        blank = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("open"), F.lit(0).alias("widest"))
        empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("now"), blank.alias("at"))

        def word(at: Column, w: Column) -> Column:
            n = F.length(w)
            new = (at["lines"] == 0) | (at["open"] + 1 + n > width)
            return F.struct((at["lines"] + new.cast("int")).alias("lines"), F.when(new, n).otherwise(at["open"] + 1 + n).alias("open"), F.greatest(at["widest"], n).alias("widest"))

        fits = lambda at: (at["lines"] <= most_lines) & (at["widest"] <= width)
        state = lambda out, now, at: F.struct(out.alias("out"), now.alias("now"), at.alias("at"))
        none = F.array().cast("array<string>")

        def closed(acc: Column, sentence: Column, own: Column) -> Column:
            """After a sentence that stands alone: it stays open if it fits, else it is cut."""
            cut = F.concat(acc["out"], line_groups(wrap_lines(sentence, width), most_lines))
            return F.when(fits(own), state(acc["out"], F.array(sentence), own)).otherwise(state(cut, none, blank))

        def step(acc: Column, sentence: Column) -> Column:
            words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
            begin = F.size(acc["now"]) == 0
            longer = F.aggregate(words, acc["at"], word)
            alone = lambda held: let(F.aggregate(words, blank, word), lambda own: closed(held, sentence, own))
            full = F.struct(F.concat(acc["out"], F.array(F.array_join(acc["now"], " "))).alias("out"), none.alias("now"), blank.alias("at"))
            joined = let(longer, lambda at: F.when(fits(at), state(acc["out"], F.concat(acc["now"], F.array(sentence)), at)).otherwise(let(full, alone)))
            return F.when(begin, alone(acc)).otherwise(joined)

        return F.aggregate(F.split(turn, r"(?<=[.!?…])\s+"), empty, step, lambda a: F.when(F.size(a["now"]) == 0, a["out"]).otherwise(F.concat(a["out"], F.array(F.array_join(a["now"], " ")))))

    return F.flatten(F.transform(turns, pack))


# Words before which a line may be cut, and the least characters of a last line.
_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z"
CLAUSE_WORD = re.compile(rf"(?:and|but|or|because|so|then|that|while|when|where){_END}", re.I | re.A)
SENTENCE_END, COMMA_END = re.compile(rf"[.!?;:]{_END}"), re.compile(rf",{_END}")
_WORD, _TAG = re.compile(r"\S+\s*", re.A), re.compile("<[^>]+>")
LEAST_TAIL = 6


def cut_line(line: str, width: int, most: int) -> list[str]:
    """A line without outer white space in parts, see `smart_lines`. Work goes with its words: a part is looked for among those that
    can end it."""
    seen = (lambda t: len(_TAG.sub("", t))) if "<" in line else len
    if seen(line) <= width:
        return [line]
    words = _WORD.findall(line)
    n, begin = len(words), [0, *accumulate(len(w) for w in words)]
    bare = [w.rstrip(" ") for w in words]
    clause = [CLAUSE_WORD.match(w) is not None for w in bare]
    tags = [m.span() for m in _TAG.finditer(line)]
    visible_from, k, gone = [], len(tags), 0
    for at in reversed(begin[:-1]):
        while k and tags[k - 1][0] >= at:
            k -= 1
            gone += tags[k][1] - tags[k][0]
        inside = tags[k - 1][1] if k and tags[k - 1][1] > at else at  # a tag that is cut is text, but for tags that it holds
        visible_from.append(seen(line[at:inside]) + len(line) - inside - gone)
    visible_from.reverse()
    out, at = [], 0
    while at < n - 1 and visible_from[at] > most:
        best, run = None, 0
        for k in range(at + 1, n):
            stop = begin[k - 1] + len(bare[k - 1])
            size = seen(line[begin[at] : stop]) if tags else stop - begin[at]
            if size <= most:
                weak = 0 if SENTENCE_END.search(bare[k - 1]) else 1 if COMMA_END.search(bare[k - 1]) else 2 if clause[k] and k < n - 1 and run % 2 == 0 else 3
                gap = (size > width, max(size - width, 0), visible_from[k] < LEAST_TAIL, weak, -size, abs(size - visible_from[k]), k)
                best = gap if best is None else min(best, gap)
            elif not tags or line.find("<", max(begin[at], line.rfind(">", begin[at], stop)), stop) < 0:
                break  # no tag is open that could hide what stands here
            run = run + 1 if clause[k] else 0  # of clause words one behind another every other one counts
        if best is None:
            break
        out.append(line[begin[at] : begin[best[-1] - 1] + len(bare[best[-1] - 1])])
        at = best[-1]
    return [*out, line[begin[at] :]]


def smart_lines(text: Column, width: int, overflow: int = 3) -> Column:
    """array<string>: each line of a text cut at natural places, as often as it takes.

    A line of more than `width` visible characters gives off one line after another while more than width + overflow are left. Of
    the gaps between words at which the part before has at most width + overflow, that one is best which fits the width, then
    overflows least, leaves no tail under LEAST_TAIL, stands behind a sentence or clause, a comma or before a clause word, and
    comes latest. A part that can't be cut so stays whole. Blank lines go; null gives null.
    """
    most = width + overflow

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda lines: None if lines is None else [part for line in lines for part in cut_line(line, width, most)])

    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.pandas_udf(cut, "array<string>")(lines)


def smart_wrap(text: Column, width: int, overflow: int = 3) -> Column:
    """A text with its lines cut at natural places, see `smart_lines`."""
    return F.array_join(smart_lines(text, width, overflow), "\n")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def normalise_breaks(text: Column) -> Column:
    single = lambda x: F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x)
    return F.array_join(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(single(x))), lambda x: x != ""), "\n")


def match_form(text: Column) -> Column:
    """Lower-cased words for matching: no tags or punctuation, five contractions written out."""
    contractions = (("can't", "cannot"), ("won't", "will not"), ("I'm", "i am"), ("you're", "you are"), ("it's", "it is"))
    whole = lambda t, *pairs: replaced(t, *((rf"(?iU)\b{word}\b", long) for word, long in pairs))
    text = strip_tags(F.coalesce(text, F.lit("")))
    text = let(text, lambda t: F.when(t.contains("'"), whole(t, *contractions)).otherwise(t))
    text = let(F.lower(text), lambda t: F.when(t.contains("colour"), whole(t, ("colour", "color"))).otherwise(t))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(match_form(text), " "), lambda t: t != "")


def strip_explanations(text: Column) -> Column:
    """Brackets of 12 or more characters at the end, one after another, unless they are production cues."""
    one = lambda t: let(F.trim(F.regexp_extract(t, r"\(([^()]*)\)\s*$", 1)), lambda c: F.when((F.length(c) >= 12) & ~c.rlike(KEPT_PAREN), F.rtrim(F.regexp_replace(t, r"\s*\([^()]*\)\s*$", ""))).otherwise(t))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"\(")))), text, lambda acc, _: one(acc))


def delivery_text(text: Column) -> Column:
    """Dialogue of a cue for delivery: notes, sounds, foreign markup, labels and production lines go; i and b tags stay."""
    t = F.regexp_replace(text, r"\*\*(.+?)\*\*", "<b>$1</b>")
    t = F.regexp_replace(t, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "<i>$1</i>")
    t = strip_explanations(F.regexp_replace(t, STAGE_PAREN, ""))
    t = F.regexp_replace(t, r"(?i)\[(?:music|applause|laughter|cheering|gunshot|explosion|singing)[^\]]*\]", "")
    t = F.regexp_replace(t, r"</?(?:font|span|div|p|br|sub|sup|small|big|ruby|rt|table|tr|td|center|html|body)\b[^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+", ""), SPEAKER, "")
    lines = F.filter(F.transform(F.split(t, r"\R"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"(?i)^Page\s+\d+$") & ~x.rlike(METADATA) & ~x.rlike(SCENE_HEADING) & ~x.rlike(QC_NOTE))
    shorter = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, INLINE_SPEAKER + r"(?=\S)", ""), r"(?U)\s+", " ")))
    return F.array_join(F.filter(shorter, lambda x: x != ""), "\n")


def post_process(text: Column) -> Column:
    """Notes in angle brackets, known sounds in round ones, italics broken within a word on either side, empty tags, bold and blanks."""
    joined = ((r"<i>(\w+)</i>(\w+)", "<i>$1$2</i>"), (r"(\w+)<i>(\w+)(?:</i>)?", "<i>$1$2</i>"))
    empty = (r"<i>\s*</i>|</?b>", ""), (r"\(\s*\)|\[\s*\]", "")
    return F.trim(replaced(text, (ANGLE_NOTE, ""), *joined, *empty, (SOUND_VERBS, ""), (r"[ \t]{2,}", " ")))


def extraction_line(text: Column) -> Column:
    """An extracted line without bracketed notes, fillers, outer dashes and doubled blanks."""
    t = strip_fillers(F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", ""))
    t = F.regexp_replace(t, r"\s+,", ",")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^[\s–—-]+|[\s–—-]+$", ""), r"\s{2,}", " "))


def show_title(file_name: Column) -> Column:
    """A show's name from a file name: no extension, ids, languages, versions, dates or separators."""
    t = F.regexp_replace(file_name, r"\.[A-Za-z0-9]{2,5}$", "")
    t = F.regexp_replace(t, r"[_.]+", " ")
    t = F.regexp_replace(t, r"(?i)\b(?:EHD|ENG|ENGLISH|FINAL|CCSL|SCRIPT|DIALOGUE|SPOTTING|LIST|SUBTITLES?|V\d+|S\d+E\d+|EP?\s*\d+|\d{4,}[A-Z]?)\b", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[-\s]{2,}", " "), r"\s+", " "))
    return F.when(t == "", "UNKNOWN").otherwise(F.upper(t))


def rule_sentence(text: Column) -> Column:
    """A rule as one sentence: no bullet, single blanks, first letter in upper case, no final dot."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^\s*(?:[-*•·▪–]|\(?\d{1,3}[.)])\s*", ""))
    t = F.regexp_replace(t, r"[.;,\s]+$", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def protected_title(text: Column) -> Column:
    """`[MARKER] words` of narrative titles and captions without the marker; null for other text."""
    pattern = r"(?s)^\s*\[(?:MAIN TITLE|TITLE|NARRATIVE TITLE|CAPTION|ON[- ]?SCREEN|SUPER|CHYRON|SIGN)[^\]]*\]\s*(\S.*)$"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def inline_breaks(text: Column) -> Column:
    whole = lambda t: F.regexp_replace(F.regexp_replace(t, r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
    return F.trim(let(text, lambda t: F.when(t.contains("{") | t.contains("\\"), whole(t)).otherwise(t)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]", "_")


def strip_preamble(text: Column) -> Column:
    """A model's introduction before the answer."""
    return F.trim(F.regexp_replace(text, r"(?is)^\s*(?:sure|certainly|of course|here(?:'s| is| are)?)[^\n:]{0,120}:\s*", ""))


def clean_steps(p: Callable[[str], Column]) -> list[tuple[str, Column | None, Callable[[Column], Column]]]:
    """The chain in its order as (name, condition, step), for platform fields p(name): remove_elements, rules_text, profanity_table, ...

    The condition tells where a step is asked for and can change a text at all; it sees the text as column `text`.
    """
    has = lambda *names: F.exists(F.coalesce(p("remove_elements"), F.array().cast("array<string>")), lambda e: F.lower(e).isin(*names))
    says = lambda phrase: F.coalesce(p("rules_text"), F.lit("")).contains(phrase)
    holds = lambda *marks: functools.reduce(lambda a, b: a | b, [F.col("text").contains(m) for m in marks])
    ten = says("1-10 in words") | says("numbers 1-10") | says("0-9 written out")
    bracket, digit = holds("(", "["), F.col("text").rlike("[0-9]")
    numbers = lambda digits: lambda t: replaced(t, *[(NUMBER_RULE.format(d), NUMBER_WORDS[d]) for d in digits])
    return [
        ("canonical_tags", holds("<"), canonical_tags),
        ("hoh", bracket & has("hoh", "emt"), remove_sounds),
        ("annotations", None, strip_annotations),
        ("descriptors", holds("("), strip_trailing_descriptor),
        ("stage_directions", bracket & has("stage_directions"), strip_stage_directions),
        ("speaker_labels", holds(":", "-") & has("character_names"), strip_speaker_labels),
        ("fillers", has("fillers"), strip_fillers),
        ("profanity", F.size(p("profanity_table")) > 0, lambda t: replace_profanity(t, p("profanity_table"))),
        ("bleeps", says("asterisks (****)"), bleeps_to_asterisks),
        ("punctuation", F.col("text").rlike(r" [ .,!?;:]|[!?]{2}|\.{2}"), fix_punctuation),
        ("hyphens", holds("–", "—"), lambda t: F.regexp_replace(t, "(?m)^[–—]", "-")),
        ("hyphens_closed", holds("-") & (p("two_speaker_format") == "hyphen_no_space"), lambda t: F.regexp_replace(t, "(?m)^- ", "-")),
        ("hyphens_open", holds("-") & (p("two_speaker_format") == "hyphen_with_space"), lambda t: F.regexp_replace(t, r"(?m)^-([^\-\s])", "- $1")),
        ("quotes", holds("'") & says("quotation marks instead of apostrophes"), quotes),
        ("symbols", says("&, <, >, degree or copyright symbols"), forbidden_symbols),
        ("acronyms", holds(".") & says("no periods for acronyms"), acronym_dots),
        ("lyric_dots", holds("...") & says("ellipsis without space at start"), lambda t: F.regexp_replace(t, r"(?m)^\.\.\.\s+", "...")),
        ("lyrics", holds("♪", "♫") & says("no punctuation at end of song line"), lyric_end),
        ("lyric_case", holds("♪") & says("upper case at beginning of line") & says("song"), lyric_case),
        ("story_lang", holds(":") & says("story and lang must be capitalised"), story_lang),
        ("interruptions", holds("—") & says("double hyphens (--)"), lambda t: F.regexp_replace(t, "—", "--")),
        ("capitalise", None, capitalise),
        ("number_ten", digit & ten, numbers(["10"])),
        ("numbers", digit & (ten | says("1-9")), numbers([d for d in NUMBER_WORDS if d != "10"])),
        ("spelling", F.col("text").rlike(ANY_UK), _spelled),
        ("split_lines", None, lambda t: split_lines(t, p("max_chars_per_line"), p("max_chars_italics"))),
        ("blank_lines", None, drop_blank_lines),
    ]


def clean_text(cues: DataFrame, stop_after: str | None = None) -> DataFrame:
    """cues joined with platform fields, text cleaned by the chain; original_text keeps what came in. Null texts stay null."""
    out = cues if "original_text" in cues.columns else cues.withColumn("original_text", F.col("text"))
    for name, gate, step in clean_steps(F.col):
        text = F.col("text")
        out = out.withColumn("text", step(text) if gate is None else F.when(gate, step(text)).otherwise(text))
        if name == stop_after:
            break
    return out
