"""Visually identical text with different characters, brought to one form.

A compiled longest-match transducer: one pass over the grapheme clusters of a text, applying a precomputed
mapping for widths, styles, compositions, ligatures, special spaces, invisible marks and look-alike letters.
The mapping is built once per process from the Unicode tables, checked for conflicts (an input with two
outputs, an output that is itself an input), and compiled into one longest-match expression.

Scale: one narrow pass, no shuffle; texts without any special character cost one search for its class.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: letters of other scripts that look like a Latin one
CYRILLIC_LOOK = dict(zip("АВЕЅІЈКМНОРСТУХаеіјѕорсухԁԛԝһ", "ABESIJKMHOPCTYXaeijsopcyxdqwh", strict=True))
GREEK_LOOK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαυκρ", "ABEZHIKMNOPTYXoviaukp", strict=True))
CYRILLIC_LOOK |= {"\u04c0": "I", "\u04cf": "l"}
GREEK_LOOK |= {"\u03f2": "c", "\u03f9": "C"}
ARMENIAN_LOOK = dict(zip("օսհՕՍՏԼ", "ouhOUSL", strict=True))
LISU_LOOK = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True))
LATIN_LOOK = {"\u0261": "g", "\u0251": "a"}  # script g and alpha
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮"
    "⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ﻿ﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
)
SPACES = "               　"
FRENCH_AFTER, KEYS = tuple(";:!?»%€"), tuple("#*0123456789")
EAST_ASIAN = ("ja", "zh", "ko")
CYRILLIC_LANGS = ("ru", "uk", "bg", "sr", "be", "mk")

EMOJI_BLOCKS = "[\u2190-\u21ff\u2300-\u23ff\u2460-\u24ff\u25a0-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff\u00a9\u00ae\u2122\u203c\u2049\u2139]"
JOINERS, JOINING = "\u200c\u200d", re.compile("[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\u0900-\u0dff]")  # scripts whose spelling needs joiners
MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿゙゚"
# what can need the transducer at all
SPECIAL = (
    "[ ­̀-ͯͰ-ϿЀ-ԯ؜ᅟᅠ ឴឵᠎᪰-᫿"
    "ᴀ-ᵿ᷀-᷿ -‏‪-  -⁤⁦-⁩⃐-⃿℀-⅏"
    "\u0250-\u02af\u0530-\u058f\u2150-\u2188\u2460-\u24ff\ua4d0-\ua4ff\uf900-\ufaff　゙゚ㅤﬀ-ﬆ︀-️﻿！-￦"
    "\U0001d400-\U0001d7ff\U0001f100-\U0001f189]"
)


EMOJI_LETTERS = frozenset("\u24c2\U0001f170\U0001f171\U0001f17e\U0001f17f\U0001f18e\u2139\u2122")  # letters in signs that are emoji
SPECIAL_RE, MARKS_RE = re.compile(SPECIAL), re.compile(f"[{MARKS}]")


def _class(chars: Iterable[str]) -> str:
    """The inside of a character class, as ranges: long lists of characters are searched one by one."""
    ranges: list[list[int]] = []
    for o in sorted(set(map(ord, chars))):
        if ranges and ranges[-1][1] == o - 1:
            ranges[-1][1] = o
        else:
            ranges.append([o, o])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


def _styled() -> dict[str, str]:
    """Letters and digits in other widths, styles and compositions, from the Unicode tables: decompositions and names."""
    out = {}
    blocks = [(0x250, 0x2B0), (0x1D00, 0x1D2C), (0xFF01, 0xFFE7), (0x1D400, 0x1D800), (0x2100, 0x2189), (0x2460, 0x2500), (0xF900, 0xFB00), (0x1F100, 0x1F18A)]
    for a, b in blocks:
        for o in range(a, b):
            c = chr(o)
            if c in INVISIBLE or c in EMOJI_LETTERS:
                continue
            kind, name = unicodedata.decomposition(c).split(">")[0].lstrip("<"), unicodedata.name(c, "")
            plain = unicodedata.normalize("NFKC", c)
            small = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", name)
            if small:
                out[c] = small[1].lower()
            elif kind in ("wide", "narrow") and len(plain) == 1:
                out[c] = plain
            elif kind in ("font", "circle", "square") and plain.isalnum() and len(plain) < 3:
                out[c] = plain
            elif kind == "compat" and "ROMAN NUMERAL" in name:
                out[c] = plain
            elif unicodedata.normalize("NFC", c) != c:  # one character composed of one other
                out[c] = unicodedata.normalize("NFC", c)
    return out


@lru_cache(maxsize=None)
def mapping() -> dict[str, str]:
    """Character to replacement, wherever it stands; raises if two rules contradict each other."""
    rules = [_styled(), LATIN_LOOK, LIGATURES, {c: "" for c in INVISIBLE}, {c: " " for c in SPACES}]
    out: dict[str, str] = {}
    for rule in rules:
        for c, to in rule.items():
            if out.get(c, to) != to:
                raise ValueError(f"two outputs for U+{ord(c):04X}")
            out[c] = to
    chained = [c for c, to in out.items() if any(x in out for x in to)]
    if chained:
        raise ValueError(f"outputs that are inputs: {chained[:5]}")
    return out


@lru_cache(maxsize=None)
def look_mapping() -> dict[str, str]:
    """Look-alike letter to its Latin twin, applied only within words that are not of the letter's script."""
    out: dict[str, str] = {}
    for rule in (CYRILLIC_LOOK, GREEK_LOOK, ARMENIAN_LOOK, LISU_LOOK):
        if both := out.keys() & rule.keys():
            raise ValueError(f"two outputs for {both}")
        out |= rule
    return out


def _emoji() -> str:
    """The class of emoji and signs: their blocks without the characters the mapping replaces."""
    chars = (chr(o) for a, b in re.findall("(.)(?:-(.))?", EMOJI_BLOCKS[1:-1]) for o in range(ord(a), ord(b or a) + 1))
    return f"[{_class(c for c in chars if c not in mapping())}]"


EMOJI = _emoji()


@lru_cache(maxsize=None)
def _transducer(lang: str, marks: bool) -> tuple[re.Pattern, dict]:
    """Longest match first: emoji sequences (kept), composed clusters, words with foreign letters, single characters."""
    table = dict(mapping())
    if lang in EAST_ASIAN:
        # the widths usual there: full-width punctuation and letters, the ideographic space, half-width kana
        for o in (*range(0xFF01, 0xFFE7), *range(0x2460, 0x249C)):
            table.pop(chr(o), None)
        table.pop("　")
    if lang == "fr":
        spaced = "(?P<usual>[  ](?=[;:!?»%€])|(?<=«)[  ])|"
    else:
        spaced = ""
    keycap = "[#*0-9]️?⃣"
    emoji = f"(?P<emoji>{keycap}|{EMOJI}[︎️]?[\U0001f3fb-\U0001f3ff]?(?:‍{EMOJI}[︎️]?[\U0001f3fb-\U0001f3ff]?)*)|"
    hidden = _class(INVISIBLE)
    # letters start a cluster, so this alternative is tried at every letter: only for texts with marks
    cluster = f"(?P<cluster>[^\\W\\d_](?:[{hidden}]*[{MARKS}])+)|" if marks else "(?P<cluster>(?!))|"
    singles = _class(table)
    return re.compile(f"{emoji}{spaced}{cluster}(?P<one>[{singles}]{"" if marks else "+"})"), table


@lru_cache(maxsize=None)
def _runs(lang: str) -> re.Pattern:
    """Runs of the characters the transducer acts on in texts without marks; a class alone is found fast."""
    table = _transducer(lang, False)[1]
    return re.compile("[" + _class(table) + EMOJI[1:-1] + "]+")


EMOJI_RE = re.compile(EMOJI)
WORD = re.compile(r"[^\W\d_]+")
LOOKS = re.compile("[" + "".join(look_mapping()) + "]")
FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\ua4d0-\ua4ff]")
LATIN, CYRILLIC, GREEK = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ѐ-ԯ]"), re.compile("[Ͱ-Ͽ]")
TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC_LOOK.items()) if k in "АВЕКМНОРСТУХаеорсух"}
TO_CYRILLIC_RE = re.compile("[" + "".join(TO_CYRILLIC) + "]")


def _word(word: str, lang: str) -> str:
    """A word whose letters come from several scripts, in the script it belongs to."""
    foreign = len(FOREIGN.findall(word))
    if not foreign:
        return word
    latin = len(LATIN.findall(word))
    looks = len(LOOKS.findall(word))
    if not latin:
        own = lang in CYRILLIC_LANGS or lang in ("el", "hy", "lis")
        return word if own or looks < len(word) else LOOKS.sub(lambda m: look_mapping()[m.group()], word)
    if looks == foreign:  # every foreign letter has a Latin twin
        only_twins = TO_CYRILLIC_RE.sub("", word)
        if lang in CYRILLIC_LANGS and not LATIN.search(only_twins) and foreign > latin:
            return TO_CYRILLIC_RE.sub(lambda m: TO_CYRILLIC[m.group()], word)
        return LOOKS.sub(lambda m: look_mapping()[m.group()], word)
    rest = TO_CYRILLIC_RE.sub("", word)
    if CYRILLIC.search(word) and not LATIN.search(rest):
        return TO_CYRILLIC_RE.sub(lambda m: TO_CYRILLIC[m.group()], word)
    return word


def transduce(text: str, lang: str | None = None) -> str:
    """The text in its one form. Emoji, the language's own script, spaces and signs stay as they are."""
    lang = lang or ""
    if not SPECIAL_RE.search(text):
        return text
    marks = MARKS_RE.search(text) is not None
    pattern, table = _transducer(lang, marks)

    def replace(m: re.Match) -> str:
        if (one := m.group("one")) is not None:
            if one.strip(JOINERS) == "" and JOINING.match(m.string[m.start() - 1 : m.start()]):
                return one
            return "".join(table[c] for c in one)
        if (cluster := m.group("cluster")) is not None:
            parts = [table.get(c, c) for c in cluster]
            if lang not in CYRILLIC_LANGS:  # a twin under an accent
                parts[0] = look_mapping().get(parts[0], parts[0])
            return unicodedata.normalize("NFC", "".join(parts))
        return m.group()

    def run(m: re.Match) -> str:
        chars, a, b = m.group(), m.start(), m.end()
        if EMOJI_RE.search(chars) or "\u20e3" in text[b : b + 1]:
            a = a - 1 if text[a - 1 : a] in KEYS else a
            whole = text[a : b + 1] if text[b : b + 1] == "\u20e3" else text[a:b]
            kept = pattern.sub(replace, whole)
            return kept[m.start() - a : len(kept) - (len(whole) - (b - a))]
        if lang == "fr" and len(chars) == 1 and chars in "\u00a0\u202f" and (text[b : b + 1] in FRENCH_AFTER or text[a - 1 : a] == "«"):
            return chars
        if chars.strip(JOINERS) == "" and JOINING.match(text[a - 1 : a]):
            return chars
        return "".join(table[c] for c in chars)

    text = (pattern.sub(replace, text) if marks else _runs(lang).sub(run, text))
    if lang in EAST_ASIAN or not FOREIGN.search(text):
        return text
    return WORD.sub(lambda m: _word(m.group(), lang), text)


def one_form(text: Column, lang: Column) -> Column:
    """The one form of a text in a language; null stays null, an unknown language has no customs of its own."""

    def apply(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([transduce(t, g if isinstance(g, str) else "") if isinstance(t, str) else None for t, g in zip(texts, langs, strict=True)], dtype=object)

    return F.pandas_udf(apply, "string")(text, lang)


def normalize_look(df: DataFrame, text: str = "text", lang: str = "lang", out: str = "text_one_form") -> DataFrame:
    """``df`` with ``out``, the one form of ``text``. Null and empty texts stay as they are; rows keep their number."""
    return df.withColumn(out, one_form(F.col(text).cast("string"), F.col(lang).cast("string")))
