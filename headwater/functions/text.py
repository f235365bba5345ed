"""Text as built-in expressions; each says what null gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: all white space, and what separates words
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WHITE = WHITE.replace("[", "[^", 1)
NOT_WORD = r"[^\p{L}\p{N}_]+"
NOT_ALNUM = r"[^\p{L}\p{N}]+"

# fixed values: English stop words and the terms of feeds and forums that say nothing
STOP_WORDS = frozenset(
    """a about above across after afterwards again against all almost alone along already also although always am among amongst
amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become
becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can
cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere
empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for
former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby
herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep
last latter latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my
myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on
once one only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see
seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something
sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter
thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to
together too top toward towards twelve twenty two un under until up upon us very via was we well were what whatever when
whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole
whom whose why will with within without would yet you your yours yourself yourselves
amp nbsp quot http https www com org net utm ref click read share reply retweet from should also like said says say new make
got today yesterday tomorrow year years day days edit deleted removed""".split()
)


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends; null: empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{WHITE}+|{WHITE}+$", "")


def normalized(c: Column) -> Column:
    """Tags, entities, addresses and punctuation become spaces, white space is collapsed; case stays. Null: empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for pattern in ("<[^>]+>", r"&[\p{L}\p{N}_]+;", f"http{NOT_WHITE}+", NOT_WORD):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def sentences(c: Column) -> Column:
    """The stripped parts of a text, split after . ! or ? followed by white space. Null: one empty part."""
    return F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), f"(?<=[.!?]){WHITE}+"), stripped)


def first_sentence(c: Column, max_len: int = 180, min_len: int = 25) -> Column:
    """The first sentence of at least ``min_len`` characters, else the whole text, cut to ``max_len``."""
    long_ = F.filter(sentences(c), lambda s: F.length(s) >= min_len)
    whole = stripped(F.substring(stripped(c), 1, max_len))
    return F.when(F.size(long_) > 0, F.substring(F.get(long_, F.lit(0)), 1, max_len)).otherwise(whole)


def _one_stop(c: Column) -> Column:
    return F.concat(F.regexp_replace(c, r"\.+$", ""), F.lit("."))


def lead_sentence(c: Column, min_len: int = 25, max_len: int = 180) -> Column:
    """The first sentence of at least ``min_len`` characters, else the first there is, ending in one full stop."""
    parts = sentences(c)
    long_ = F.filter(parts, lambda s: F.length(s) >= min_len)
    some = F.filter(parts, lambda s: F.length(s) > 0)
    pick = F.when(F.size(long_) > 0, F.get(long_, F.lit(0))).when(F.size(some) > 0, F.get(some, F.lit(0)))
    return F.coalesce(_one_stop(F.substring(pick, 1, max_len)), F.lit(""))


def candidate_line(title: Column, snippet: Column) -> Column:
    """A line to stand for a post: its lead sentence, else a title of 30 characters, else whatever there is."""
    lead = lead_sentence(snippet)
    t, s = stripped(title), stripped(snippet)
    rest = F.when(s != "", s).when(t != "", t).otherwise("No clear summary")
    return F.when(F.length(lead) >= 25, lead).when(F.length(t) >= 30, _one_stop(t)).otherwise(_one_stop(F.substring(rest, 1, 120)))


def same_line_key(c: Column) -> Column:
    """Lines that differ in case and white space only have one key."""
    return F.lower(stripped(F.regexp_replace(c, f"{WHITE}+", " ")))


def context_tokens(c: Column) -> Column:
    """Lower-case ASCII words of at least three characters that are no stop words; words touching others are none."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda t: t.rlike("^[a-z0-9]{3,}$") & ~t.isin(*sorted(STOP_WORDS)))


def summary_tokens(c: Column) -> Column:
    """The set of lower-case ASCII words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def term_words(c: Column) -> Column:
    """Lower-case words of at least two characters without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD), lambda t: (F.length(t) >= 2) & ~t.isin(*sorted(STOP_WORDS)))


def with_pairs(words: Column) -> Column:
    """The words and the pairs of neighbours. Used on a column of its own, so that the words are made once."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def term_tokens(c: Column) -> Column:
    return with_pairs(term_words(c))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def display_label(author: Column, display: Column) -> Column:
    """``display (author)`` or the author alone, cut to 40 characters."""
    a, d = F.coalesce(author, F.lit("")), F.coalesce(display, F.lit(""))
    return F.substring(F.when(d != "", F.concat(d, F.lit(" ("), a, F.lit(")"))).otherwise(a), 1, 40)


def hover_text(title: Column, snippet: Column, date: Column | None = None, url: Column | None = None, max_snippet: int = 160) -> Column:
    """Lines for a tooltip; date and address only where there are any; a long snippet is cut with an ellipsis."""
    s = F.coalesce(snippet, F.lit(""))
    short = F.when(F.length(s) > max_snippet, F.concat(F.substring(s, 1, max_snippet), F.lit("…"))).otherwise(s)
    parts = [F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")))]
    if date is not None:
        parts.append(F.concat(F.lit("Date: "), F.date_format(date, "yyyy-MM-dd HH:mm:ss")))
    if url is not None:
        parts.append(F.concat(F.lit("URL: "), url))
    return F.concat_ws("<br>", *parts, F.concat(F.lit("Snippet: "), short))


def embedding_text(title: Column, snippet: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(snippet, F.lit("")))
