"""Garbled text from wrong character encoding: found, and restored where possible.

A text is searched best-first over encode, decode and unescape operations. States are strings and byte
strings, visited ones are hashed, and the queue is ordered by the implausibility of the characters; the
cheapest text that can be reached is taken as the original. Operations act on the non-ASCII words only, and
within them on the parts they fit, so texts garbled in part are mended in part.

Scale: one pass, no shuffle. A JVM-side pattern keeps the texts that cannot be garbled (all ASCII without
escapes or question-mark words) out of Python; a second, linear check keeps plausible ones out of the search.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.plans.lineage import spread

# fixed values: code pages that texts are read in by mistake, and those they are written in
READ_IN = "cp1252 latin-1 mac_roman cp437 cp850 cp1250 cp1251 koi8-r cp866 mac_cyrillic iso8859-5 iso8859-2 cp852 iso8859-15 cp1254"
WRITTEN_IN = "cp1251 koi8-r cp866 iso8859-5 mac_cyrillic"  # single-byte pages told apart by their letters
EAST_ASIAN = "shift_jis gbk euc_kr euc_jp"  # multi-byte pages, told apart by what they may hold
LATIN_LETTERS = "áéíóúñäöüßàèùâêîôûçãõåëïÁÉÍÓÚÑÄÖÜÀÈÙÂÊÎÔÛÇÃÕÅËÏœŒæÆøØ"
FREQUENT_CYRILLIC, USUAL_CYRILLIC, RARE_CYRILLIC = "оеаинтсрвлкмдпу", "яыьгзбчйхжшю", "цщэфъёіїєґўјљњћђџѓќѕ"
CYRILLIC_VOWELS, CYRILLIC_SIGNS = frozenset("аеёиоуыэюяіїє"), frozenset("ъь")
QUOTES, DASHES = "“”‘’„«»", "–—…"

CANDIDATE = r"[^\x00-\x7F]|\?\?|\w\?\w|&#?\w{1,8};|\\u[0-9a-fA-F]{4}|(%[0-9A-Fa-f]{2}){2}"
LOST = re.compile("[�\x80-\x9f]|[^\\W\\d_]\\?[^\\W\\d_]")
LOST_WORDS = re.compile(r"(?<!\S)[(“\"]?\?{2,}(?=[\s.,:;)”\"]|$)")
PLAIN = re.escape(LATIN_LETTERS + FREQUENT_CYRILLIC + USUAL_CYRILLIC + RARE_CYRILLIC) + re.escape(
    (FREQUENT_CYRILLIC + USUAL_CYRILLIC + RARE_CYRILLIC).upper() + QUOTES + DASHES + "€£¿¡™"
)
ODD = re.compile(
    rf"[^\x00-\x7f{PLAIN}]|[{LATIN_LETTERS}]{{3}}|[a-zß-ÿ][ÀÂÃÄÅÐÑ]|[ÃÂ][^\w\s]|(?<=[^\W\d_])[€£¡¿]|[€£](?=[^\W\d_])|[ÃÂ](?=[a-z\s]|$)"
    rf"|(?<=[^\W\d_])[“”„–—…](?=[^\W\d_])|[а-яё][Ѐ-Я]|[A-Za-z][а-яёА-ЯЁ]|[а-яёА-ЯЁ][A-Za-z]"
)
ESCAPED = re.compile(r"&#?\w{1,8};|\\u[0-9a-fA-F]{4}|(?:%[0-9A-Fa-f]{2}){2}")
CYRILLIC = re.compile("[Ѐ-ӿ]")
WORDS = re.compile(r"[^ \t\n\r]*[^\x00-\x7f \t\n\r][^ \t\n\r]*")
STRIPPED = re.compile("Ã(?= |$)")  # its no-break space was taken for a space and lost
MULTIBYTE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
EAST_RUN = re.compile("[^\x00-\x7f]{3}")
EAST_TEXT = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3\u3000-\u303f\uff00-\uff9f]+")
EAST_OWN = {"euc_kr": re.compile("[\uac00-\ud7a3]"), "euc_jp": re.compile("[\u3040-\u30ff]"), "shift_": re.compile("[\u3040-\u30ff]")}  # no text is without
# a sign of three bytes of which only the first is left: a quotation mark, an apostrophe or a dash
LEFT_OVER = re.compile(r"(?<!\w)â(?=[A-ZÀ-ÞА-ЯЁ]|\W|$)|(?<=[^\W\d_])â(?=s\b)|(?<=\w)â(?!\w)")
MARGIN, PLAUSIBLE, STEP, FURTHER, SLACK = 1.0, 0.75, 0.05, 0.7, 1.0


@lru_cache(maxsize=None)
def _page(name: str) -> tuple[dict, list]:
    """Character to byte and byte to character of a code page; bytes it leaves open stand for themselves."""
    chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
    return {ord(c): b for b, c in reversed(list(enumerate(chars)))}, chars


@lru_cache(maxsize=65536)
def _char_cost(c: str) -> float:
    o = ord(c)
    if o < 128:
        return 0.0
    if c in LATIN_LETTERS:
        return 0.6
    low = c.lower()
    extra = 0.1 if c != low else 0.0
    for letters, cost in ((FREQUENT_CYRILLIC, 0.3), (USUAL_CYRILLIC, 0.8), (RARE_CYRILLIC, 1.6)):
        if low in letters:
            return cost + extra
    if o == 0xFFFD:
        return 8.0
    if o < 0xA0:
        return 5.0
    if c in QUOTES or c in DASHES:
        return 0.3
    if c in "€£¿¡":
        return 0.3
    if o == 0xA0:
        return 1.0
    if c in "™½²":
        return 1.0
    if 0x2200 <= o <= 0x25FF or 0x2190 <= o < 0x2200:
        return 4.0
    if 0x3040 <= o <= 0x30FF or 0xAC00 <= o <= 0xD7A3:
        return 0.5
    if 0x3040 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or o >= 0x1F300:
        return 0.8
    if c.isalpha():
        return 2.5 if 0x400 <= o < 0x530 else 2.0
    return 3.0


@lru_cache(maxsize=65536)
def word_cost(word: str) -> float:
    """Implausibility of one word: rare characters, and characters in places where they do not stand."""
    cost, before, run, latin, cyrillic, east = 0.0, "", 0, False, False, False
    n = len(word)
    if "â" in word:
        cost += 2.5 * len(LEFT_OVER.findall(word))
    for k, c in enumerate(word):
        if c < "\x80":
            latin |= c.isalpha()
            before, run = c, 0
            continue
        cost += _char_cost(c)
        after = word[k + 1] if k + 1 < n else ""
        if c.isalpha():
            east |= c >= "\u0530" and not "\u1e00" <= c <= "\u1eff"
            is_cyrillic = "Ѐ" <= c <= "ӿ"
            cyrillic |= is_cyrillic
            latin |= not is_cyrillic and c < "ɐ"
            if not is_cyrillic:
                run += 1
                if run > 2:
                    cost += 1.5
            if c.isupper() and before.islower():
                cost += 1.5
        else:
            run = 0
            left, right = before.isalpha(), after.isalpha()
            if c in "€£":
                cost += 2.0 * (left or right)
            elif c in "¿¡":
                cost += 2.0 * (left or not (right or after in QUOTES))
            elif c in "’‘":
                pass
            elif c in QUOTES or c in DASHES:
                cost += 2.0 * (left and right)
            elif left or right:
                cost += 1.5
        before = c
    return cost + 3.0 * (cyrillic and (latin or east)) + (_cyrillic_cost(word.lower()) if cyrillic else 0.0)


def _cyrillic_cost(word: str) -> float:
    """How little a lower-case word is built like one of a Slavic language: signs, vowels and consonants out of place."""
    cost, vowels, consonants, before = 0.0, 0, 0, ""
    any_vowel = letters = 0
    for c in word:
        if not "Ѐ" <= c <= "ӿ":
            vowels, consonants, before = 0, 0, ""
            continue
        letters += 1
        if c in CYRILLIC_SIGNS:
            cost += 1.5 * (not before or before in CYRILLIC_VOWELS or before in CYRILLIC_SIGNS)
            vowels = consonants = 0
        elif c in CYRILLIC_VOWELS:
            cost += 1.5 * (c == "ы" and not before)
            vowels, consonants = vowels + 1, 0
            cost += 0.7 * (vowels > 2)
            any_vowel += 1
        else:
            cost += 1.5 * (c == "й" and before != "" and before not in CYRILLIC_VOWELS)
            vowels, consonants = 0, consonants + 1
            cost += 1.0 * (consonants > 4)
        before = c
    return cost + 2.0 * (letters > 2 and not any_vowel)


@lru_cache(maxsize=65536)
def _utf8(word: str, page: str) -> str:
    """The word with every part of it that is UTF-8 when written in the page read as UTF-8."""
    to_byte = _page(page)[0]
    if all(ord(c) in to_byte for c in word):
        parts = [word]
    else:
        parts, last = [""], None
        for c in word:
            fits = ord(c) in to_byte
            if fits != last and last is not None:
                parts.append("")
            parts[-1] += c
            last = fits
    chars = _page(page)[1]
    out = []
    for part in parts:
        if not part or ord(part[0]) not in to_byte:
            out.append(part)
            continue
        raw, at = bytes(to_byte[ord(c)] for c in part), 0
        for m in MULTIBYTE.finditer(raw):
            try:
                new = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append("".join(chars[b] for b in raw[at : m.start()]) + new)
            at = m.end()
        out.append("".join(chars[b] for b in raw[at:]))
    return "".join(out)


def _reread(word: str, read: str, written: str) -> str:
    """The word read in another single-byte page; unchanged unless it then is all letters of that page."""
    to_byte, chars = _page(read)[0], _page(written)[1]
    out = []
    for c in word:
        if c < "\x80":
            if c.isalpha():
                return word
        elif c not in QUOTES and c not in DASHES:
            b = to_byte.get(ord(c))
            if b is None or b < 128:
                return word
            c = chars[b]
            if not c.isalpha():
                return word
        out.append(c)
    return "".join(out)


def _east_asian(word: str, read: str, written: str) -> str:
    """The word's bytes in the page read as a multi-byte page; unchanged unless they then are East Asian text."""
    to_byte = _page(read)[0]
    raw = [to_byte.get(ord(c)) for c in word]
    if None in raw or 2 * sum(c >= "\x80" for c in word) < len(word):
        return word
    try:
        out = bytes(raw).decode(written)
    except UnicodeDecodeError:
        return word
    east = "".join(c for c in out if c >= "\x80")
    own = len(east) > 3 if written == "gbk" else len(east) > 1 and (EAST_OWN[written[:6]].search(east) is not None)
    return out if own and EAST_TEXT.fullmatch(east) and not any(c.isalnum() and c < "\x80" for c in out) else word


def _refill(word: str) -> str:
    """The word with the signs of which only the first byte's character is left."""

    def sign(m: re.Match) -> str:
        before, after = word[: m.start()][-1:], word[m.end() :][:1]
        if before.isalnum():
            return "’" if after == "s" else "”"
        return "“" if after.isalnum() else "–"

    return LEFT_OVER.sub(sign, word)


def unescape(text: str) -> str:
    text = html.unescape(text)
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), text)
    return unquote(text, errors="ignore") if re.search("(?:%[0-9A-Fa-f]{2}){2}", text) else text


def _next(state: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str, bool]]:
    """The texts one operation away, the usual mistakes first; the last says whether the encoding is certain."""
    for page in READ_IN.split():
        yield tuple(_utf8(w, page) for w in state), f"{page}>utf-8", True
    yield tuple(unescape(w) for w in state), "unescape", True
    if any("â" in w for w in state):
        yield tuple(_refill(w) for w in state), "refill", True
    if any(EAST_RUN.search(w) for w in state):
        for written in EAST_ASIAN.split():
            for page in READ_IN.split():
                yield tuple(_east_asian(w, page, written) for w in state), f"{page}>{written}", False
    for written in WRITTEN_IN.split():
        for read in READ_IN.split():
            if read != written:
                yield tuple(_reread(w, read, written) for w in state), f"{read}>{written}", False


def search(words: tuple[str, ...]) -> tuple[float, float, tuple[str, ...], str]:
    """(cost before, cost after, the words of the cheapest reachable text, the path to it).

    Every operation adds a little to the cost, so that of two equally plausible texts the nearer one is taken.
    """
    cost = lambda ws: sum(map(word_cost, ws))
    start, good = cost(words), PLAUSIBLE * len(words)
    best, best_words, best_path = start, words, ""
    queue, seen, order = [(start, 0, 0, words, "")], {hash(words)}, 0
    while queue:  # states far from the best are left, and every step but the first must take a good part of the cost away, so it ends
        reached, _, depth, state, path = heapq.heappop(queue)
        if depth and reached > SLACK * best:
            break
        for new, how, certain in _next(state):
            if not certain and best <= good:
                break
            if hash(new) in seen:
                continue
            seen.add(hash(new))
            order += 1
            c = cost(new) + STEP * (depth + 1) + 0.001 * order
            step = f"{path} {how}".strip()
            if depth and c > FURTHER * reached:
                continue
            if c < best:
                best, best_words, best_path = c, new, step
            if c < reached:
                heapq.heappush(queue, (c, order, depth + 1, new, step))
            if certain and c <= good / 2:
                return start, c, new, step
    return start, best, best_words, best_path


def analyse(text: str | None) -> tuple[bool, str | None, float, float, str]:
    """(garbled, best text, cost before, cost after, path). Null and empty texts are not garbled."""
    if not text:
        return False, text, 0.0, 0.0, ""
    lost = bool(LOST.search(text)) or len(LOST_WORDS.findall(text)) >= 2 or ("â" in text and LEFT_OVER.search(text) is not None)
    odd = ODD.search(text) is not None
    escaped = ESCAPED.search(text) is not None
    if not (lost or odd or escaped):
        letters = CYRILLIC.findall(text)
        if not letters or sum(map(_char_cost, letters)) < 0.7 * len(letters):
            return False, text, 0.0, 0.0, ""
    text = STRIPPED.sub("Ã\xa0", text)
    words = tuple(dict.fromkeys(WORDS.findall(text)))
    if escaped:
        words += tuple(w for w in dict.fromkeys(text.split(" ")) if ESCAPED.search(w) and w not in words)
    if not words:
        return lost, text, 0.0, 0.0, ""
    before, after, new, path = search(words)
    changed = [(word_cost(w), word_cost(n)) for w, n in zip(words, new, strict=True) if w != n]
    was, is_ = sum(w for w, _ in changed), sum(n for _, n in changed)
    better = was - is_ >= MARGIN and is_ < 0.8 * was
    if not better:
        return lost, text, before, before, ""
    mended = dict(zip(words, new, strict=True))
    text = WORDS.sub(lambda m: mended.get(m.group(), m.group()), text)
    if escaped:
        text = " ".join(mended.get(w, w) for w in text.split(" "))
    # bare HTML entities and escapes alone are markup, not a wrong encoding
    return lost or path != "unescape", text, before, after, path


def _garbled_flags(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: analyse(t)[0] if isinstance(t, str) else False).astype(bool)


def is_garbled(text: Column) -> Column:
    """Whether a text is wholly or partly garbled; null: false. All-ASCII texts never reach Python's search."""
    return F.coalesce(text.rlike(CANDIDATE), F.lit(False)) & F.pandas_udf(_garbled_flags, "boolean")(F.when(text.rlike(CANDIDATE), text))


def find_garbled(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row per garbled value: key, field, garbled, restored, restorable, cost_before, cost_after, path.

    ``restored`` is the cheapest text reachable; ``restorable`` is false where characters are lost (question
    marks, replacement characters) and the text could at best be mended in part. Null or empty values, plain
    texts and an empty table give no row; a repeated row gives its rows again. Other columns are not read.
    """
    values = df.select(
        F.col(key).alias("key"), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields)))
    ).where(F.col("text").rlike(CANDIDATE))
    values = spread(values)
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, field, text in zip(b["key"], b["field"], b["text"], strict=True):
                garbled, new, before, after, path = analyse(text)
                if garbled:
                    still = LOST.search(new) is not None or len(LOST_WORDS.findall(new)) >= 2 or not path
                    rows.append((k, field, text, new, not still, before, after, path))
            yield pd.DataFrame(rows, columns=["key", "field", "garbled", "restored", "restorable", "cost_before", "cost_after", "path"])

    schema = f"key {kind}, field string, garbled string, restored string, restorable boolean, cost_before double, cost_after double, path string"
    return values.mapInPandas(scan, schema).withColumnRenamed("key", key)
