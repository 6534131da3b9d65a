"""Column functions on text: tokens, codes, acronyms, prefixes, intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that tokens leave out.
STOPWORDS = (
    "a about all also am an and any are as at be been being both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that "
    "the their theirs them themselves then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with would you your yours yourself yourselves"
).split()
# Words shaped like acronyms that aren't expanded.
NOT_ACRONYMS = "info data lab labs intro core exam fall gpa online hybrid course class unit term".split()
# Program prefixes, and those that only count in capitals.
PREFIXES = "AAI CS CSYE DS EECE INFO ALY BINF MATH MGSC STAT IE".split()
CAPITAL_PREFIXES = "INFO IE".split()
# Calendar words that aren't departments.
NOT_DEPARTMENTS = "fall spring summer winter autumn term year since".split()
# Referents of a follow-up, and words of foundational intent.
REFERENT = (
    r"(?iu)(?:这门课|那门课|这课|该课|这门|此课|这[个两三]课|它|上面(?:这|那|的)|刚才(?:这|那|的)|前面(?:这|那|的)"
    r"|\bthis (?:course|class|one)\b|\bthat (?:course|class|one)\b|\bthe (?:course|class)\b|\bit\b|\bthem\b|\bthese\b|\bboth\b)"
)
FOUNDATIONAL = r"(?i)(?:first[- ]?semester|foundational|core course|入门|基础|第一(?:个)?学期|第一年|first[- ]?year|recommended for new|刚入学)"

#: ASCII word boundaries; Java's own take letters of other scripts as word characters.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FULL_CODE = rf"{LEFT}([A-Za-z]{{2,4}})[ \t\n\x0B\f\r]?([0-9]{{4}}[A-Za-z]?){RIGHT}"
NUMBER_CODE = rf"{LEFT}([0-9]{{4}}){RIGHT}"


def ascii_fold(c: Column) -> Column:
    """Lower case of ASCII letters only, as case-blind equality of identifiers has it."""
    return F.translate(c, UPPER, LOWER)


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits but for stop words; the pattern itself passes over these."""
    stop = "|".join(STOPWORDS)
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9])(?!(?:{stop})(?![a-z0-9]))([a-z0-9]+)"), 1)


def cjk_bigrams(text: Column) -> Column:
    """Pairs of neighbours in each run of CJK characters; a lone character by itself."""
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]+)"), 1)
    return F.flatten(
        F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    )


def tokenize(text: Column) -> Column:
    return F.concat(ascii_tokens(text), cjk_bigrams(text))


def code_candidates(query: Column) -> Column:
    """Texts by which a query may name a record: full codes, bare numbers not within one, the whole short query."""
    full = F.transform(
        F.arrays_zip(F.regexp_extract_all(query, F.lit(FULL_CODE), 1).alias("d"), F.regexp_extract_all(query, F.lit(FULL_CODE), 2).alias("n")),
        lambda m: F.concat_ws(" ", F.upper(m["d"]), F.upper(m["n"])),
    )
    bare = F.array_distinct(F.filter(F.regexp_extract_all(query, F.lit(NUMBER_CODE), 1), lambda x: ~F.exists(full, lambda c: F.contains(c, x))))
    whole = F.trim(query)
    short = F.when((F.length(whole) > 1) & (F.length(whole) <= 30), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array_distinct(full), bare, short))


def expand_acronyms(query: Column, glossary: Column) -> Column:
    """``query`` with the senses of its acronyms that it doesn't hold yet; ``glossary``: map of capitals to senses."""
    low = F.lower(query)
    found = F.regexp_extract_all(query, F.lit(rf"{LEFT}([A-Za-z]{{2,6}}){RIGHT}"), 1)
    skip = F.array(*map(F.lit, [*STOPWORDS, *NOT_ACRONYMS]))
    found = F.filter(found, lambda t: ~F.array_contains(skip, F.lower(t)) & ((F.length(t) != 2) | (t == F.upper(t))))
    empty = F.array().cast("array<string>")
    senses = F.flatten(F.transform(found, lambda t: F.coalesce(F.try_element_at(glossary, F.upper(t)), empty)))
    added = F.array_distinct(F.filter(senses, lambda s: ~F.contains(low, F.lower(s))))
    return F.concat_ws(" ", query, F.when(F.size(added) > 0, F.array_join(added, " ")))


def program_prefix(query: Column) -> Column:
    """The first known prefix in ``query`` in capitals, '' if it has none."""
    either = [p for p in sorted(PREFIXES, key=len, reverse=True) if p not in CAPITAL_PREFIXES]
    pattern = rf"{LEFT}((?i:{'|'.join(either)})|{'|'.join(CAPITAL_PREFIXES)}){RIGHT}"
    return F.upper(F.regexp_extract(query, pattern, 1))


def without_prefix(query: Column) -> Column:
    """``query`` without the one span that ``program_prefix`` found, white space collapsed."""
    either = [p for p in sorted(PREFIXES, key=len, reverse=True) if p not in CAPITAL_PREFIXES]
    pattern = rf"^(?s:(.*?)){LEFT}(?:(?i:{'|'.join(either)})|{'|'.join(CAPITAL_PREFIXES)}){RIGHT}(?s:(.*))$"
    cut = F.regexp_replace(query, pattern, "$1$2")
    return F.when(program_prefix(query) == "", F.when(F.trim(query) == "", "").otherwise(query)).otherwise(F.regexp_replace(F.trim(cut), r"\s+", " "))


def is_followup(query: Column) -> Column:
    return ~query.rlike(r"[A-Za-z]{2,4}\s?[0-9]{3,4}") & query.rlike(REFERENT)


def is_foundational(query: Column) -> Column:
    return query.rlike(FOUNDATIONAL)


def names_code(query: Column) -> Column:
    """Whether a query has the shape of a code: letters that are no calendar word, then 4 or 5 digits."""
    heads = F.regexp_extract_all(query, F.lit(rf"{LEFT}([A-Za-z]{{2,5}})\s?[0-9]{{4,5}}{RIGHT}"), 1)
    return F.exists(heads, lambda h: ~F.lower(h).isin(NOT_DEPARTMENTS))


def cjk_dominant(query: Column) -> Column:
    """Whether over 0.3 of the characters besides white space are CJK."""
    solid = F.regexp_replace(query, r"\s", "")
    cjk = F.length(F.regexp_replace(solid, "[^一-鿿㐀-䶿]", ""))
    return F.when(F.length(solid) > 0, cjk / F.length(solid) > 0.3).otherwise(False)


def distinct_words(c: Column) -> Column:
    """Distinct words, lower case, parted at white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(c), r"\s+")), "")


def words_overlap(query: Column, text: Column) -> Column:
    return F.size(F.array_intersect(query, text)) / F.greatest(F.size(query), F.lit(1))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has, both lower case, parted at white space: a stand-in reranker."""
    return words_overlap(distinct_words(query), distinct_words(text))


#: What is made of each query and of each text by itself, and the score of the two.
overlap.parts = distinct_words, words_overlap


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
