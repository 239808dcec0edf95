"""Text projections as column expressions.

Character classes are spelled out so that Java's regex engine agrees with the
Unicode meaning of word, digit and white space used by the data model.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = r"\t-\r\x1C-\x20\x{85}\p{Z}"
# The same white space, listed: trimming reads the ends of a text, a pattern tries every place of it.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"\p{L}\p{N}_"
LINE_BREAK = r"[\n\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
PAGE_MARKER = r"(?i)<!--[" + WS + r"]*PAGE:[" + WS + r"]*(\p{Nd}+)[" + WS + r"]*-->"

# Case foldings that lower() leaves alone.
FOLDS = (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"))

# Token patterns of the data model.
LEGAL_TOKEN = r"\p{Nd}+(?:[-.]\p{Nd}+)*|[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)*"
COUNT_TOKEN = r"[" + WORD + r"]+|[^" + WORD + WS + r"]"
ANSWER_TOKEN = r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{N}]+"
SENTENCE_BREAK = r"(?<=[.!?…;:])[" + WS + r"]+(?=[A-ZƏÖÜİŞÇĞ0-9])"
CLAUSE_BREAK = r"(?<=[,;:])[" + WS + r"]+"
STANDALONE_LABEL = r"(?iu)^(?:\p{Nd}+(?:[.-]\p{Nd}+)*\.?|[a-zəçşıöüğ]\))[" + WS + r"]+"


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@lru_cache(1)
def _composed_ranges() -> list[tuple[int, int]]:
    """Ranges of what composition may change: code points that change alone, combining marks, and those that stand
    second in a canonical composition."""
    risky = set()
    for c in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        char = chr(c)
        if unicodedata.combining(char) or unicodedata.normalize("NFC", char) != char or unicodedata.category(char)[0] == "M":
            risky.add(c)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and parts[0][0] != "<":
            risky.add(int(parts[1], 16))
    risky.update(range(0x1160, 0x1200))  # vowels and finals of Hangul, which compose by rule
    points, ranges = sorted(risky), []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return [(a, b) for a, b in ranges]


def _class(ranges: list[tuple[int, int]], negated: bool = False) -> str:
    return "[" + "^" * negated + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def composed_class() -> str:
    """Character class of what composition may change."""
    return _class(_composed_ranges())


@lru_cache(1)
def steady_class() -> str:
    """Class of all but the wide stretches that composition leaves alone: letters, punctuation, CJK, pictographs.

    The exact class has hundreds of ranges and is slow on every code point; this one ends at the first test for those
    of the first stretch, which an intersection asks before the others. (A list of ranges is asked from its last.)
    """
    risky = _composed_ranges()
    gaps = [(a + 1, b - 1) for (_, a), (b, _) in zip([(0, -1), *risky], [*risky, (sys.maxunicode + 1, 0)])]
    wide = [g for g in gaps if g[1] - g[0] >= 255 or g[0] <= 0x2013 <= g[1] or g[0] <= 0x3B1 <= g[1] or g[0] <= 0x3042 <= g[1]]
    return f"[\\x{{{wide[0][1] + 1:X}}}-\\x{{10FFFF}}&&{_class(wide[1:], negated=True)}]"


def nfc(col: Column) -> Column:
    """Unicode composition. Only text that may change is sent to Python; all other values pass as null.

    A short class lets most texts pass, and the long class is asked for the others alone.
    """
    risky = col.rlike(steady_class()) & col.rlike(composed_class())
    return F.coalesce(_compose(F.when(risky, col)), col)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def is_blank(col: Column) -> Column:
    """True where stripping leaves nothing; ends at the first character that is no white space."""
    return ~col.rlike(f"[^{WS}]")


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(BLANKS))


def casefold(col: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), FOLDS, F.lower(col))


def unix_lines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def canonical(col: Column, compose: bool = True) -> Column:
    """Text whose hash decides duplicates and versions."""
    base = unix_lines(col)
    base = nfc(base) if compose else base
    return strip(F.regexp_replace(base, f"[{WS}&&[^\\n]]+(?=\\n|$)", ""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(col: Column) -> Column:
    """Lines of a text; a final line break adds no empty line."""
    return once(
        F.split(col, LINE_BREAK, -1),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts),
    )


def clean_page(col: Column) -> Column:
    """Drop page-number lines, trim line ends, squeeze blank runs, trim."""
    lines = F.transform(
        F.filter(split_lines(col), lambda x: ~strip(x).rlike(r"^\p{Nd}{1,4}$")), rstrip
    )
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def tok_ws(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), f"[{WS}]+"), lambda x: x != "")


def legal_tokens(col: Column) -> Column:
    """Legal-prose tokens of composed text: numbers with inner dots or dashes, and words."""
    folded = F.replace(casefold(col), F.lit("i̇"), F.lit("i"))
    return F.regexp_extract_all(folded, F.lit(LEGAL_TOKEN), F.lit(0))


def tok_legal(col: Column, compose: bool = True) -> Column:
    return legal_tokens(nfc(col) if compose else col)


def tok_answer(col: Column, compose: bool = True) -> Column:
    base = nfc(col) if compose else col
    return F.regexp_extract_all(casefold(base), F.lit(ANSWER_TOKEN), F.lit(0))


def tok_count(col: Column) -> Column:
    """Approximate token count. Additive over pieces joined by white space."""
    return F.regexp_count(col, F.lit(COUNT_TOKEN))


def identity_words(col: Column, compose: bool = True) -> Column:
    base = nfc(col) if compose else col
    return F.array_join(F.regexp_extract_all(casefold(base), F.lit(f"[{WORD}]+"), F.lit(0)), " ")


def sentences(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, SENTENCE_BREAK, -1), strip), lambda x: x != "")


def sentence_count(col: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(col, F.lit(f"[.!?…]+(?:[{WS}]|$)")))


def is_structural(stripped: Column) -> Column:
    """Lines that keep their own line when wrapped prose is re-flowed."""
    return stripped.rlike(r"^(?:[#|>]|- |\* )") | stripped.rlike(STANDALONE_LABEL)


def previous(items: Column) -> Column:
    """The array shifted by one, so that ``zip_with`` sees each item's predecessor.

    Indexing the array from inside a lambda would evaluate it once per item.
    """
    return F.slice(F.concat(F.array(F.lit(None)), items), F.lit(1), F.size(items))


def reflow(pieces: Column) -> Column:
    """Join ordered ``struct(structural, text)`` items: own line or one space."""
    def joined(items: Column) -> Column:
        return F.zip_with(
            items,
            previous(items),
            lambda x, before: F.concat(
                F.when(before.isNull(), "").when(x["structural"] | before["structural"], "\n").otherwise(" "),
                x["text"],
            ),
        )

    return strip(F.array_join(once(pieces, joined), ""))


def join_lines(col: Column) -> Column:
    """Re-flow a whole text; blank lines end a paragraph."""

    def marked(lines: Column) -> Column:
        items = F.zip_with(
            lines,
            previous(lines),
            lambda x, before: F.struct(
                is_structural(x).alias("structural"),
                x.alias("text"),
                F.coalesce(before == "", F.lit(False)).alias("gap"),
            ),
        )
        return F.filter(items, lambda x: x["text"] != "")

    def joined(kept: Column) -> Column:
        return F.zip_with(
            kept,
            previous(kept),
            lambda x, before: F.concat(
                F.when(before.isNull(), "")
                .when(x["structural"] | x["gap"] | before["structural"], "\n")
                .otherwise(" "),
                x["text"],
            ),
        )

    # Lines are cut, stripped and tested once: each array is read twice, and in the next one twice again.
    lines = F.transform(split_lines(col), strip)
    return strip(F.array_join(once(once(lines, marked), joined), ""))


def safe_json(col: Column) -> Column:
    """JSON text that cannot close a tag or start an entity."""
    out = F.to_json(col)
    for ch, esc in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = F.replace(out, F.lit(ch), F.lit(esc))
    return out


def title_candidates(text: Column) -> Column:
    head = F.slice(split_lines(unix_lines(text)), 1, 30)
    lines = F.filter(
        head,
        lambda x: (strip(x) != "") & ~F.contains(x, F.lit("<!-- PAGE:")) & (strip(x) != "---"),
    )
    return F.transform(lines, lambda x: strip(F.regexp_replace(x, rf"^#+[{WS}]*|\[\p{{Nd}}+\][{WS}]*$", "")))


def _longest(arr: Column) -> Column:
    # Ties go to the earliest line.
    return F.array_max(
        F.transform(arr, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("t")))
    )["t"]


def doc_title(stem: Column, text: Column) -> Column:
    """File stem, or the longest early line when the stem looks like a hash."""
    clean = F.regexp_replace(stem, r"^[_ “”.]+|[_ “”.]+$", "")
    lines = title_candidates(text)
    good = F.filter(lines, lambda x: F.length(x).between(12, 240))
    return F.when(~clean.rlike(r"(?i)^[0-9a-f-]{20,}$"), clean).otherwise(
        F.coalesce(_longest(good), _longest(lines), clean)
    )


def short_title(title: Column) -> Column:
    bare = strip(F.regexp_replace(title, "^[“\"]|[”\"]$", ""))
    cut = F.regexp_replace(bare, rf"(?iu)[{WS}]+Azərbaycan Respublikasının.*$", "")
    return F.substring(F.when(cut == "", title).otherwise(cut), 1, 160)


def act_number(text: Column) -> Column:
    found = F.regexp_extract(
        F.substring(text, 1, 5000),
        rf"(?ium)^[{WS}]*(?:№|Qərar[{WS}]*№)[{WS}]*([{WORD}/-]+)[{WS}]*$",
        1,
    )
    return F.when(found != "", found)


# Profile names and their evidence words, in order of precedence.
PROFILES = ("LEGAL_ACT", "REGULATION", "GUIDANCE", "TABLE_OR_FORM", "DECISION_OR_AMENDMENT")
GUIDANCE_WORDS = "metodoloji|rəhbərlik|təlimat"
FORM_WORDS = "forma|sorğu|hesabat cədvəli"
DECISION_WORDS = "qərara alır|təsdiq edilməsi barədə|dəyişiklik"


def profile_scores(text: Column, category: Column, title: Column) -> Column:
    """Array of ``struct(profile, score)`` in precedence order."""
    sample = casefold(F.concat(title, F.lit("\n"), F.substring(text, 1, 20000)))
    points = (
        ((category == "laws") | sample.rlike(rf"(?m)^[{WS}]*m[{WS}]*a[{WS}]*d[{WS}]*d[{WS}]*ə[{WS}]+\p{{Nd}}+"), 4),
        (sample.rlike(rf"(?m)^[{WS}]*\p{{Nd}}+(?:[-.]\p{{Nd}}+)+\.?(?:[{WS}]|$)"), 3),
        (text.rlike(rf"(?m)^#{{1,6}}[{WS}]+") | sample.rlike(GUIDANCE_WORDS), 2),
        (text.rlike(rf"(?m)^[{WS}]*\|.+\|[{WS}]*$") | sample.rlike(FORM_WORDS), 3),
        (sample.rlike(DECISION_WORDS), 3),
    )
    scores = F.array(
        *[
            F.struct(F.lit(name).alias("profile"), F.when(test, worth).otherwise(0).alias("score"))
            for name, (test, worth) in zip(PROFILES, points)
        ]
    )
    return scores


def detected_profiles(scores: Column) -> Column:
    hits = F.transform(F.filter(scores, lambda s: s["score"] > 0), lambda s: s["profile"])
    return F.when(F.size(hits) == 0, F.array(F.lit("GUIDANCE"))).otherwise(hits)


def primary_profile(scores: Column) -> Column:
    best = F.array_max(
        F.transform(
            scores,
            lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("i"), s["profile"].alias("profile")),
        )
    )
    return F.when(best["score"] > 0, best["profile"]).otherwise("GUIDANCE")


def document_type(profile: Column, title: Column) -> Column:
    folded = casefold(title)
    return (
        F.when((profile == "LEGAL_ACT") | F.contains(folded, F.lit("qanun")), "law")
        .when(profile == "DECISION_OR_AMENDMENT", "decision_or_amendment")
        .when(profile == "TABLE_OR_FORM", "table_or_form")
        .when((profile == "REGULATION") | folded.rlike("qayda|əsasnamə"), "regulation")
        .otherwise("guidance")
    )


# Markup steps, in the order they apply.
SPEECH_STEPS = (
    (r"(?s)```.*?```", " "),
    (r"!\[([^\]]*)\]\([^)]+\)", " $1 "),
    (r"\[([^\]]+)\]\([^)]+\)", " $1 "),
    (rf"(?:[{WS}]*\[[{WS}]*\p{{Nd}}+(?:[{WS}]*[,;][{WS}]*\p{{Nd}}+)*[{WS}]*\])+", " "),
    (rf"(?m)^[{WS}]*(?:#{{1,6}}|[-*+] |\p{{Nd}}+[.)] )[{WS}]*", ""),
    (r"`", " "),
    (r"\*\*|__", ""),
    (r"№", " nömrə "),
    (r"%", " faiz "),
    (r"−", "-"),
    (r"(?iu)(?<![\p{L}\p{N}_])AMB(?![\p{L}\p{N}_])", "Azərbaycan Mərkəzi Bankı"),
    (r"(?iu)(?<![\p{L}\p{N}_])AZN(?![\p{L}\p{N}_])", "manat"),
    (rf"[{WS}]+([,.;:!?])", "$1"),
    (rf"[{WS}]+", " "),
)


def strip_markup(col: Column) -> Column:
    """Plain speech text of a Markdown answer (see ``SPEECH_STEPS``)."""
    out = nfc(col)
    for pattern, replacement in SPEECH_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


