"""Text functions: tokens, similarity, statistics and quality, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions import pairs
from sigloom.functions.numbers import col, let

#: Word characters: letters, combining marks, digits, connectors.
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"

STOP_WORDS = tuple(
    (
        "a all also an and are as at be been both but by can could did do does each every few for from had has have he her here him his how i in is it its just "
        "may me might more most must my no not now of on once only or other our same shall she should so some such than that the their them then there these "
        "they this those to too us very was we were what when where which who why will with would you your "
    ).split()
)


def tokens(text, least: int = 2) -> Column:
    """Words in lower case, of ``least`` characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0)), lambda t: F.length(t) >= least)


def content_tokens(text, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of three characters or more that aren't stop words; repeats stay."""
    words = F.array(*map(F.lit, stop))
    return F.filter(tokens(text, 3), lambda t: ~F.array_contains(words, t))


def normalized(text) -> Column:
    """Letters and digits in lower case, single spaces."""
    kept = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{Nd}\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def levenshtein_similarity(a, b) -> Column:
    """1 - distance / greater length, in any case; 1 for two empty texts."""
    a, b = F.lower(col(a)), F.lower(col(b))
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / n)


def grams(text, n: int = 2) -> Column:
    """All n-grams of characters, in lower case, with repeats; none for shorter texts."""
    t = F.lower(col(text))
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a, b, n: int = 2) -> Column:
    """Of the sets of n-grams; 1 if both are empty."""
    x, y = F.array_distinct(grams(a, n)), F.array_distinct(grams(b, n))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def ngram_cosine(a, b, n: int = 2) -> Column:
    """Cosine of n-gram counts; texts shorter than n are compared for equality."""
    x, y = F.lower(col(a)), F.lower(col(b))
    short = (F.length(col(a)) < n) | (F.length(col(b)) < n)
    return F.when(short, (x == y).cast("double")).otherwise(pairs.gram_cosine(x, y, n))


def jaro(a, b) -> Column:
    """Jaro similarity in any case; matches are within half the greater length less one."""
    return pairs.jaro(F.lower(col(a)), F.lower(col(b)))


def jaro_winkler(a, b, p: float = 0.1) -> Column:
    """Jaro, raised by a common prefix of up to four characters whatever its value."""
    s, t = F.lower(col(a)), F.lower(col(b))
    prefix = sum(((F.length(s) >= i) & (F.length(t) >= i) & (F.substring(s, 1, i) == F.substring(t, 1, i))).cast("int") for i in range(1, 5))
    j = pairs.jaro(s, t)
    return j + prefix * p * (1.0 - j)


def combined_similarity(a, b, norm: bool = True) -> Column:
    """1 if equal, .9 if one holds the other, else .5 Jaro-Winkler + .3 Levenshtein + .2 bigram cosine."""
    x, y = (normalized(a), normalized(b)) if norm else (F.trim(F.lower(col(a))), F.trim(F.lower(col(b))))
    return pairs.combined(x, y)


# --- statistics and quality ---------------------------------------------------------------


def word_count(text) -> Column:
    return F.regexp_count(col(text), F.lit(r"[^ \t\n\r]+"))


def sentence_count(text) -> Column:
    return F.regexp_count(col(text), F.lit(r"[.!?]+(?=\s|$)"))


def paragraph_count(text) -> Column:
    return F.size(F.filter(F.split(col(text), r"\n\s*\n"), lambda p: F.trim(p) != ""))


def average_word_length(text) -> Column:
    n = word_count(text)
    return F.when(n > 0, F.length(F.regexp_replace(col(text), r"\s", "")) / n).otherwise(0.0)


_SPEECH = r"\b(?:asked|replied|said|shouted|whispered)\b"
_DEEDS = r"\b(?:s?he|they)\s+(?:felt|looked|ran|thought|walked)\b"
_CODE = r"\b(?:api|class|function|https?|json|method)\b".replace("https?", "http")
_SETUP = r"\b(?:configure|database|docker|install|kubernetes)\b"


def content_type(text) -> Column:
    """narrative or expository if the points of one side lead by more than three, else unknown."""
    t = F.lower(col(text))
    count = lambda x, p: F.regexp_count(x, F.lit(p))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    fiction = points(count(t, _SPEECH) > 3, 3) + points(count(t, _DEEDS) > 2, 3) + points(F.contains(t, F.lit("chapter")), 2) + points(count(col(text), '"[^"]+"') > 5, 2)
    fence = r"```[\s\S]*?```"
    technical = points(count(t, _CODE) > 2, 3) + points(count(t, _SETUP) > 1, 2) + points(count(col(text), fence) > 0, 3) + points(F.contains(t, F.lit("introduction")) | F.contains(t, F.lit("conclusion")), 1)
    return F.when(fiction > technical + 3, "narrative").when(technical > fiction + 3, "expository").otherwise("unknown")


POSITIVE = "amazing awesome best excellent fantastic good great happy love wonderful".split()
NEGATIVE = "angry awful bad disappointing hate horrible poor sad terrible worst".split()


def sentiment(text) -> Column:
    """struct(score, label, confidence) from the words that occur, each counted once."""
    t = F.lower(col(text))
    hits = lambda ws: sum((F.contains(t, F.lit(w)).cast("int") for w in ws), F.lit(0))
    p, n = hits(POSITIVE), hits(NEGATIVE)
    score = F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)
    label = F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")
    return F.struct(score.alias("score"), label.alias("label"), F.when(p + n > 0, 0.6 + 0.3 * F.abs(score)).otherwise(0.5).alias("confidence"))


def text_quality(text, lenient: bool = True) -> Column:
    """Empty, Garbage, Low, Medium or High, by shares of capitals and (unaccented) vowels among the letters.

    The lenient variant calls a text garbage only beyond 50 letters.
    """
    t = col(text)
    # by what is left of the text: counting matches makes an array of them
    facts = F.struct(
        F.length(F.regexp_replace(t, r"\P{L}+", "")).alias("letters"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias("capitals"),
        (F.length(t) - F.length(F.translate(t, "aeiouAEIOU", ""))).alias("vowels"),
        t.rlike(r"^[ \t\n\r]*+(?:[^ \t\n\r]++[ \t\n\r]++){19}[^ \t\n\r]").alias("long"),
    )

    def grade(f: Column) -> Column:
        capitals, vowels = f["capitals"] / f["letters"], f["vowels"] / f["letters"]
        sure = (f["letters"] > 50) if lenient else F.lit(True)
        return (
            F.when(f["letters"].isNull() | (f["letters"] < 10), "Empty")
            .when(((capitals > 0.4) | (vowels < 0.15)) & sure, "Garbage")
            .when((vowels < 0.25) | (capitals > 0.25), "Low")
            .when(~f["long"], "Medium")
            .otherwise("High")
        )

    return let(facts, grade)


def overall_quality(grade) -> Column:
    """Aggregate: Garbage, Empty, Low (with Garbage) or High if more than half (by integer division) are, else Medium."""
    n, half = F.count(F.lit(1)), F.floor(F.count(F.lit(1)) / 2)
    k = lambda *names: F.count_if(col(grade).isin(*names))
    return F.when(n == 0, "Empty").when(k("Garbage") > half, "Garbage").when(k("Empty") > half, "Empty").when(k("Low", "Garbage") > half, "Low").when(k("High") > half, "High").otherwise("Medium")


def template(text: str, values: dict[str, Column | str]) -> Column:
    """``{{name}}`` replaced by each value; null values by nothing."""
    out = F.lit(text)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(col(v).cast("string"), F.lit("")))
    return out


def json_path(json, path: str) -> Column:
    """Dotted path with numeric steps into arrays; a missing step gives the value reached so far."""
    steps = [s for s in path.split(".") if s]
    paths = ["$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in steps[:k]) for k in range(len(steps), 0, -1)]
    return F.coalesce(*[F.get_json_object(col(json), p) for p in paths], col(json))


def searchable(*parts) -> Column:
    """The parts that aren't empty, joined by spaces."""
    return F.concat_ws(" ", *[F.when(F.trim(col(p)) != "", F.trim(col(p))) for p in parts])
