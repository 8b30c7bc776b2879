"""Text expressions. Everything here is a Column in, Column out; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are part of a word. Java's ``\w`` is ASCII only, so letters are spelt out.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]+"

# Common English function words dropped from text indexes by default.
ENGLISH_STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "also", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "can", "cannot", "could", "did", "do", "does", "doing", "down", "during", "each", "else",
    "every", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "itself", "just", "may", "me", "might", "more", "most", "must", "my", "myself", "no", "nor",
    "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves",
    "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the",
    "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those",
    "through", "to", "too", "under", "until", "up", "upon", "us", "very", "was", "we", "were",
    "what", "when", "where", "which", "while", "who", "whom", "whose", "why", "will", "with",
    "would", "you", "your", "yours", "yourself", "yourselves",
]


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    An expression inside a higher-order function is evaluated for every element, and separate
    projections are merged again by the optimizer; a lambda variable is neither.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(value: Column | str) -> Column:
    """Trim any white space, line breaks included."""
    return F.regexp_replace(col(value), r"^\s+|\s+$", "")


def literal_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def split_terms(raw: Column | str) -> Column:
    """Split a hand-typed list on commas, semicolons (both widths) and line breaks."""
    parts = F.split(F.coalesce(col(raw), F.lit("")), "[，,;；\n]+")
    return F.filter(F.transform(parts, strip), lambda t: F.length(t) > 0)


def contains_any(text: Column | str, terms: Column) -> Column:
    """Does any term occur in the text, ignoring case? No terms means no."""
    return bind(
        F.lower(F.coalesce(col(text), F.lit(""))),
        lambda hay: F.coalesce(F.exists(terms, lambda t: F.contains(hay, F.lower(t))), F.lit(False)),
    )


def words(text: Column | str) -> Column:
    """Lower-cased runs of word characters."""
    pieces = F.split(F.lower(F.coalesce(col(text), F.lit(""))), NON_WORD)
    return F.filter(pieces, lambda t: F.length(t) > 0)


def tokens(text: Column | str, stop_words=None) -> Column:
    """Index tokens: lower-cased words of two or more characters, stop words removed."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(col(text), F.lit(""))), F.lit(WORD + "{2,}"), F.lit(0)
    )
    if stop_words:
        # IN over literals becomes a hash lookup, array_contains would scan the list
        found = F.filter(found, lambda t: ~t.isin(list(stop_words)))
    return found


def _grams_of(tokens_: Column, n: int) -> Column:
    starts = F.when(F.size(tokens_) >= n, F.sequence(F.lit(0), F.size(tokens_) - n)).otherwise(
        F.array().cast("array<int>")
    )
    # element access, not slice: a slice copies the whole array each time
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens_, i + d) for d in range(n)]))


def ngrams(token_array: Column, longest: int) -> Column:
    """All 1..longest-grams, joined by one blank."""
    if longest < 2:
        return token_array
    return bind(
        token_array, lambda t: F.concat(t, *[_grams_of(t, n) for n in range(2, longest + 1)])
    )


def keyword_overlap(query: Column | str, text: Column | str, first: int | None = None) -> Column:
    """Share of the query's words (its ``first`` ones if given) that occur in the text as substrings."""
    def share(terms: Column) -> Column:
        hits = bind(
            F.lower(F.coalesce(col(text), F.lit(""))),
            lambda hay: F.size(F.filter(terms, lambda t: F.contains(hay, t))),
        )
        return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(
            hits.cast("double") / F.greatest(F.size(terms), F.lit(1))
        )

    return bind(words(query) if first is None else F.slice(words(query), 1, first), share)


def query_time_limit(query: Column | str) -> Column:
    """Minutes asked for by ``under N minutes`` or else ``ready in N minutes``; NULL if neither."""
    q = F.lower(F.coalesce(col(query), F.lit("")))
    under = F.regexp_extract(q, r"under\s+(\d+)\s+minutes?", 1).try_cast("int")
    ready = F.regexp_extract(q, r"ready\s+in\s+(\d+)\s+minutes?", 1).try_cast("int")
    return F.coalesce(under, ready)


def wants_high_protein(query: Column | str) -> Column:
    q = F.lower(F.coalesce(col(query), F.lit("")))
    return F.contains(q, F.lit("high protein")) | (
        F.contains(q, F.lit("protein")) & ~F.contains(q, F.lit("low protein"))
    )


def wants_low_calorie(query: Column | str) -> Column:
    q = F.lower(F.coalesce(col(query), F.lit("")))
    return F.contains(q, F.lit("low calorie")) | F.contains(q, F.lit("low-calorie"))


def normalize_name(name: Column | str) -> Column:
    """Join key for titles: lower case, single blanks, only ASCII letters, digits and blanks."""
    squeezed = F.regexp_replace(strip(F.lower(col(name))), r"\s+", " ")
    return F.regexp_replace(squeezed, "[^a-z0-9 ]+", "")


def json_list(raw: Column | str) -> Column:
    """A JSON list of texts as an array: entries trimmed, blanks dropped, bad JSON gives []."""
    text = strip(F.coalesce(col(raw), F.lit("")))
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}))
    cleaned = F.filter(F.transform(parsed, strip), lambda t: t.isNotNull() & (F.length(t) > 0))
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def labelled_concat(columns: list[str], separator: str = " | ") -> Column:
    """``name: value`` parts of the columns that hold text, joined by the separator."""
    parts = []
    for name in columns:
        value = strip(F.col(name).cast("string"))
        parts.append(F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws(separator, *parts)


def shorten(text: Column | str, length: int, mark: str) -> Column:
    value = col(text)
    return F.when(F.length(value) > length, F.concat(F.substring(value, 1, length), F.lit(mark))).otherwise(value)


def preview(text: Column | str, length: int = 140) -> Column:
    """One-line preview for result tables."""
    return shorten(strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), "\n", " ")), length, "…")


def summary(text: Column | str, length: int = 240) -> Column:
    return shorten(strip(F.coalesce(col(text), F.lit(""))), length, "...")


def recipe_text(
    title: Column | str,
    ner: Column | str,
    ingredients: Column | str,
    directions: Column | str,
    include_directions: bool = True,
    max_ingredients: int = 0,
    max_steps: int = 0,
) -> Column:
    """Labelled recipe text from parsed list columns; a part without content is left out.

    All ingredients and steps are kept; a positive ``max_ingredients`` or ``max_steps`` cuts the lists.
    """
    name = strip(F.coalesce(col(title), F.lit("")))
    parts_source = F.when(F.size(col(ner)) > 0, col(ner)).otherwise(col(ingredients))
    foods = F.slice(parts_source, 1, max_ingredients) if max_ingredients > 0 else parts_source
    parts = [
        F.when(F.length(name) > 0, F.concat(F.lit("title: "), name)),
        F.when(F.size(foods) > 0, F.concat(F.lit("ingredients: "), F.array_join(foods, "; "))),
    ]
    if include_directions:
        steps = F.slice(col(directions), 1, max_steps) if max_steps > 0 else col(directions)
        steps = F.filter(F.transform(steps, strip), lambda s: F.length(s) > 0)
        parts.append(F.when(F.size(steps) > 0, F.concat(F.lit("directions: "), F.array_join(steps, " "))))
    return strip(F.concat_ws("\n", *parts))


def stable_item_id(link: Column | str, text: Column | str) -> Column:
    """The link where there is one, else a key that depends on the text only."""
    trimmed = strip(F.coalesce(col(link), F.lit("")))
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.md5(col(text)))


def hash_order(seed: int | str, *columns: Column | str) -> Column:
    """A reproducible shuffle key: equal seed and ids give equal order on every engine."""
    parts = [F.lit(str(seed))] + [col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(seed: int | str, buckets: int, *columns: Column | str) -> Column:
    """Integer in 0..buckets-1 from the first 32 bits of the hash order."""
    head = F.conv(F.substring(hash_order(seed, *columns), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets)).cast("int")
