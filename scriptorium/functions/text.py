"""Text as columns: tokenizers, normalisers, cleaners, counters. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and characters that results depend on.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
FRENCH_STOPWORDS = (
    "le la les un une des de du d et ou mais donc car pour dans sur à au aux avec par ce qui que quoi dont il elle on nous vous ils elles cette ces "
    "son sa ses leur leurs mon ma mes ton ta tes notre votre se s si ne ni pas plus sans y en être avoir faire dit peut sont été était est ai as avons avez ont suis es sommes êtes"
).split()
ENGLISH_STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might can "
    "this that these those it its he she they we you i me my your his her their our which who whom whose what where when why how not no nor so than too very also only just"
).split()
STOPWORDS = tuple(dict.fromkeys(FRENCH_STOPWORDS + ENGLISH_STOPWORDS))
FRENCH_MARKERS = "le la les de des un une et est dans pour par sur avec cette sont".split()
ENGLISH_MARKERS = "the of and to in is that for it with as was are this from".split()
QUERY_STOPWORDS = (
    "le la les un une des de du et ou mais dans sur pour par avec sans sous est sont qui que quoi comment quand où quels quelles "
    "the a an and or but in on at to for of with by from is are was were what which"
).split()
URL_PARTS = "http https www ftp doi org com net edu gov io fr de uk pdf html htm php asp aspx jsp".split()
WORD_CHARACTERS = "a-zàâäæçéèêëïîôœùûü0-9"


def literal_array(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def present(text: Column | str) -> Column:
    """A null text as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def search_form(text: Column) -> Column:
    """Lower case; anything but letters, digits and white space becomes a space; white space is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def search_words(text: Column) -> Column:
    """The words of the search form: runs of letters and digits, found by one pattern."""
    return without_empty(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def okapi_words(text: Column) -> Column:
    """Runs of letters and digits, lower case, of two characters and more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def _textometric_form(text: Column) -> Column:
    lowered = F.translate(F.lower(text), "‘’", "''")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, rf"[^{WORD_CHARACTERS}\s'\-]", " "), r"\s+", " "))


def textometric_words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of a text without links, identifiers, e-mail addresses, stopwords, parts of links, and number codes."""
    # The patterns of links, identifiers, e-mail addresses and number codes.
    links = F.when(text.contains("://"), F.regexp_replace(text, r"(?i)(?:https?|ftp)://[^\s]+", " ")).otherwise(text)
    identifiers = F.when(links.contains("10."), F.regexp_replace(links, r"(?i)\b(?:doi[:\s]*)?10\.\d{4,}(?:\.\d+)*/[^\s]+", " ")).otherwise(links)
    addresses = F.when(identifiers.contains("@"), F.regexp_replace(identifiers, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", " ")).otherwise(identifiers)
    dropped = list(dict.fromkeys([*stopwords, *URL_PARTS]))
    # only words whose first or last character is below a letter can be number codes
    coded = lambda w: ((w < ":") | (F.substring(w, -1, 1) < ":")) & w.rlike(r"^(\d{4,}|[a-z]\d+|\d+[a-z]+)$")
    return F.filter(F.split(_textometric_form(addresses), " "), lambda w: (F.length(w) >= 2) & ~w.isin(dropped) & ~coded(w))


def all_words(text: Column) -> Column:
    """Textometric words with stopwords kept."""
    return without_empty(F.split(_textometric_form(text), " "))


def quality_words(text: Column) -> Column:
    """White-space words stripped to their letters and digits."""
    return without_empty(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))


def with_counts(df: DataFrame, words: str, to: str) -> DataFrame:
    """Add the distinct words of an array with their counts, [(word, count)] in word order. Counted within the row: nothing is shuffled.

    The counts come out of an explode of one element, below which no filter or projection is moved, so they are made once.
    """
    ordered, starts = f"{to}_ordered", f"{to}_starts"
    df = df.withColumn(ordered, F.sort_array(words))
    df = df.withColumn(starts, F.expr(f"filter(sequence(1, size({ordered})), i -> i > 0 and (i = 1 or get({ordered}, i - 1) <> get({ordered}, i - 2)))"))
    df = df.withColumn(starts, F.expr(f"if(size({ordered}) = 0, cast(array() as array<int>), {starts})"))
    counted = F.expr(f"transform({starts}, (s, i) -> named_struct('word', get({ordered}, s - 1), 'count', cast(coalesce(get({starts}, i + 1), size({ordered}) + 1) - s as bigint)))")
    return df.select("*", F.explode_outer(F.array(counted)).alias(to)).drop(ordered, starts)


def content_form(text: Column) -> Column:
    """For equality of contents: lower case, white space collapsed, then punctuation out, then trimmed; in this order."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"[^\p{L}\p{N}\s]", ""))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?;]+(\s|$)"))


def sentences(text: Column) -> Column:
    """Parts of over ten characters between sentence ends, abbreviations kept whole."""
    guarded = F.regexp_replace(text, r"\b(M|Mme|Dr|Prof|etc|cf|vol|pp|ed|al|p)\.", "$1\u0001")
    parts = F.split(guarded, r"(?<=[.!?;])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: F.length(s) > 10)


#: White space as scripts for browsers have it; \\s alone is ASCII here.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Abbreviations that don't end a sentence; after a first letter beyond ASCII a word border is one that a word character precedes.
HISTORIAN = "M|MM|Mme|Mlle|Dr|Pr|St|Ste|etc|cf|p|pp|vol|no|art|chap|fig|ibid|op|loc|trad|ms|mss|fol|t"
HISTORIAN_ACCENTED = "éd"


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def historian_sentences(text: Column) -> Column:
    """Parts before capitals of any script; abbreviations of address and of citation keep what follows, after one space."""
    held = F.regexp_replace(text, rf"(?:(?<![A-Za-z0-9_])({HISTORIAN})|(?<=[A-Za-z0-9_])({HISTORIAN_ACCENTED}))\.[{SPACE}]+", "$1$2.\u0000")
    parts = F.split(held, rf"(?<=[.!?])[{SPACE}]+(?=\p{{Lu}})")
    return F.filter(F.transform(parts, lambda x: trimmed(F.translate(x, "\u0000", " "))), lambda x: x != "")


def summary_sentences(text: Column) -> Column:
    """Parts of over twenty characters before capitals, plain or accented."""
    parts = F.split(F.replace(text, F.lit("|SPLIT|"), F.lit("\ue000")), rf"(?<=[.!?])[{SPACE}]+(?=[A-Z\u00c0-\u00dc])|\ue000")
    return F.filter(F.transform(parts, trimmed), lambda x: utf16_length(x) > 20)


def astral(text: Column) -> Column:
    """How many characters beyond the basic plane a text has; each counts two in UTF-16."""
    return F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def padded(text: Column) -> Column:
    """With a character that no text has after each one beyond the basic plane, so that places are those of UTF-16 units."""
    return F.regexp_replace(text, r"([\x{10000}-\x{10FFFF}])", "$1\ufdef")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(text) + astral(text)


def clean_chunk(text: Column) -> Column:
    """At most two line ends and one space in a row; then control characters (line ends too) out; trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " ")
    return strip(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""))


def clean_ocr(text: Column) -> Column:
    """Scanner noise out: odd characters, letters spaced apart (three and more are joined), bars, rules, number lines."""
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S}\s]", "")
    # a space between single letters goes if a third single letter stands on either side
    text = F.regexp_replace(text, r"(?<=(?<!\p{L})\p{L})\s+(?=\p{L}\s+\p{L}(?!\p{L}))|(?<=(?<!\p{L})\p{L}\s{1,8}\p{L})\s+(?=\p{L}(?!\p{L}))", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[|l1I]{5,}", ""), r"[-_=]{5,}", "")
    text = F.regexp_replace(F.regexp_replace(text, r" {2,}", " "), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?m)^[0-9\s.,;:!?-]+$", "")
    return strip(F.regexp_replace(text, r"(?m)^\s*\n", "\n"))


def drop_page_numbers(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?m)^\s*\d{1,4}\s*$", "")
    text = F.regexp_replace(text, r"(?m)^\s*[-–—]\s*\d+\s*[-–—]\s*$", "")
    return F.regexp_replace(text, r"(?im)^\s*Page\s+\d+\s*$", "")


def line_form(line: Column) -> Column:
    """A line for header comparison: lower case, digits as #, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"\s+", " "))


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def author_form(name: Column) -> Column:
    """An author for comparison: lower case, no accents, letters and spaces only."""
    return F.trim(F.regexp_replace(fold_accents(name), r"[^a-z\s]", ""))


def first_author(name: Column) -> Column:
    """Without 'et al.', 'et collaborateurs', '& X', 'and X'."""
    name = F.regexp_replace(F.regexp_replace(name, r"(?i)\s+et\s+al\.?$", ""), r"(?i)\s+et\s+collaborateurs$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s+&\s+.+$", ""), r"\s+and\s+.+$", ""))


def detected_language(text: Column) -> Column:
    """fr or en by counts of marker words among the first 5000 characters, with a margin of 1.2; else unknown."""
    words = F.split(F.lower(F.substring(text, 1, 5000)), r"[^\p{L}\p{N}_]+")
    count = lambda markers: F.size(F.filter(words, lambda w: F.array_contains(literal_array(markers), w)))
    french, english = count(FRENCH_MARKERS), count(ENGLISH_MARKERS)
    return F.when(french > english * F.lit(1.2), "fr").when(english > french * F.lit(1.2), "en").otherwise("unknown")


def keywords(text: Column) -> Column:
    """Acronyms of two to six capitals and words of five letters and more, lower-cased, once each, in this order."""
    acronyms = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])(\p{Lu}{2,6})(?![\p{L}\p{N}])"), 1), F.lower)
    return F.array_distinct(F.concat(acronyms, F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 5)))


def query_keywords(text: Column) -> Column:
    """Words over two characters that aren't stopwords, and quoted phrases."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s'-]", " "), r"\s+"),
        lambda w: (F.length(w) > 2) & ~F.array_contains(literal_array(QUERY_STOPWORDS), w),
    )
    return F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)))


def snippet(text: Column, most: int = 150) -> Column:
    """The first characters, cut before a word that doesn't fit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def truncated(text: Column, most: int = 4000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def has_structured_block(text: Column) -> Column:
    """A code fence, or two lines and more with table cells."""
    return text.contains("```") | text.contains("~~~") | (F.regexp_count(text, F.lit(r"(?m)^.*\|.*\|.*$")) >= 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def display_name(author: Column, year: Column, title: Column) -> Column:
    return F.when(author.isNotNull() & year.isNotNull(), F.concat(author, F.lit(" ("), year, F.lit(")"))).otherwise(title)


def context_window(model: Column, override: Column, rules: list[tuple[str, int]], default: int = 8192) -> Column:
    """The override if positive, else the window of the first pattern that a model name matches."""
    out = F.when(override > 0, override)
    for pattern, size in rules:
        out = out.when(model.rlike(pattern), size)
    return out.otherwise(default)
