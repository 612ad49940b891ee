"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

TOKEN = "[\\p{L}\\p{N}]+(?:'[\\p{L}\\p{N}]+)*"


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def nfkc(text: Column) -> Column:
    """Unicode normal form KC (ICU); ``text`` must not be null."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def casefold(text: Column) -> Column:
    """Full case folding (ICU); ``text`` must not be null."""
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def tokens(text: Column, stop: list[str] = fixed.STOP_WORDS) -> Column:
    """Words of the NFKC form, case folded, without stop words; null gives no tokens.

    Words are runs of letters and digits, with apostrophes inside; they are folded together, as one text, which folds each alike.
    """
    found = F.regexp_extract_all(nfkc(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    folded = F.split(casefold(F.array_join(found, "\n")), "\n")
    return F.filter(folded, lambda w: (w != "") & ~w.isin(stop))


def term_matches(term: Column, words: Column) -> Column:
    """Whether ``words`` has the term, or its singular or plural by a final s."""
    singular = F.when(F.endswith(term, F.lit("s")) & (F.char_length(term) > 3), F.array_contains(words, F.substring(term, F.lit(1), F.char_length(term) - 1))).otherwise(False)
    return F.array_contains(words, term) | singular | F.array_contains(words, F.concat(term, F.lit("s")))


def compact(text: Column, most: int) -> Column:
    """White space folded; what exceeds ``most`` characters is cut at a word's end and ends with a full stop."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    head = F.regexp_replace(F.substring(folded, 1, most), "\\s+\\S*$", "")
    return F.when(F.char_length(folded) <= most, folded).otherwise(F.concat(F.regexp_replace(head, "[.,;: ]+$", ""), F.lit(".")))


def language(value: Column) -> Column:
    """A language's short code from its usual names; others in lower case."""
    name = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    out = F.lit(None).cast("string")
    for code, names in fixed.LANGUAGE_NAMES.items():
        out = F.coalesce(out, F.when(name.isin(names), code))
    return F.coalesce(out, name)


def external_query(text: Column) -> Column:
    """Punctuation but ``.``, ``/`` and ``-`` made spaces, spaces folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{N}_\\s./-]", " "), "\\s+", " "))


def listed(text: Column, separators: str = "\\|\\||,|;") -> Column:
    """The items of a delimited list, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != "")


def content_terms(text: Column, stop: list[str], least: int = 3) -> Column:
    """Sorted distinct tokens of at least ``least`` characters outside ``stop``."""
    return F.sort_array(F.array_distinct(F.filter(tokens(text, stop), lambda w: F.char_length(w) >= least)))


def rough_tokens(text: Column) -> Column:
    """Maximal runs of other characters than white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """White space folded, then split behind ``.``, ``!`` and ``?``."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return F.filter(F.split(folded, "(?<=[.!?])\\s+"), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\n\\s*\\n+"), lambda p: F.trim(p)), lambda p: p != "")


def ngrams(terms: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring terms, joined by spaces."""
    last = F.size(terms) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(terms, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def occurrences(text: Column, marker: str) -> Column:
    """How often the marker stands in the text, without overlap."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker.encode())


def marker_score(text: Column, markers: list[str], divisor: float) -> Column:
    return marker_share(F.lower(F.coalesce(text, F.lit(""))), markers, divisor)


def marker_share(low: Column, markers: list[str], divisor: float) -> Column:
    """``marker_score`` of a text in lower case; a marker is counted only where a quicker search finds it."""
    counts = [F.when(low.contains(m), occurrences(low, m)).otherwise(0.0) for m in markers]
    hits = sum(counts[1:], counts[0])
    return F.least(F.lit(1.0), hits / divisor)


def section_importance(section: Column) -> Column:
    name = F.lower(F.trim(section))
    out = F.lit(None).cast("double")
    for names, weight in fixed.SECTION_IMPORTANCE:
        out = F.coalesce(out, F.when(name.isin(names), weight))
    return F.coalesce(out, F.when(name.contains("literature") | name.contains("theory"), 0.8), F.lit(0.55))


def any_of(text: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for t in terms:
        found = found | low.contains(t)
    return found


def themes(text: Column) -> Column:
    named = F.array_compact(F.array(*[F.when(any_of(text, terms), F.lit(name)) for name, terms in fixed.THEMES.items()]))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("uncategorized")))


def opinion(text: Column) -> Column:
    support, oppose, condition = (any_of(text, t) for t in (fixed.SUPPORT_TERMS, fixed.OPPOSE_TERMS, fixed.CONDITION_TERMS))
    return F.when(support & (oppose | condition), "mixed_or_conditional").when(support, "support").when(oppose, "concern_or_opposition").when(condition, "conditional_unclear").otherwise("unclear")


def parse_year(value: Column) -> Column:
    """The first four digits of the first ten characters, if they are a year from 1000 to 3000."""
    digits = F.substring(F.regexp_replace(F.substring(value.cast("string"), 1, 10), "[^0-9]", ""), 1, 4)
    year = F.when(F.char_length(digits) == 4, digits.cast("int"))
    return F.when(year.between(1000, 3000), year)


def has_contact(text: Column) -> Column:
    """An at sign and a dot, or a digit and one of ``-()``."""
    t = F.coalesce(text, F.lit(""))
    return (t.contains("@") & t.contains(".")) | (t.rlike("[0-9]") & t.rlike("[-()]"))


def slug(value: Column, most: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}]+", "-"), F.lit("-")), 1, most)


def pseudonym(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.substring(F.sha2(F.trim(value), 256), 1, 16))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 16))


def preview(text: Column, most: int = 280) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.trim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def estimated_tokens(text: Column) -> Column:
    """Words times 1.3, at least one."""
    return F.greatest(F.lit(1), F.round(F.size(rough_tokens(text)) * 1.3).cast("int"))


def json_object(text: Column) -> Column:
    """From the first brace to the last, code fences dropped; null where there is none."""
    body = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.when(body != "", body)


def first_present(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(v.cast("string")) != "", v.cast("string")) for v in values])


def abstract_from_positions(index: Column) -> Column:
    """The text of a map from words to their positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")
