"""Tokenisers and text measures as Column functions.

Four tokenisers differ on purpose: words (CJK runs as bigrams, other runs as lower-case
words), lexical tokens (cut only at a fixed list of separators), character 3-grams of the
bare letters and digits, and normalised fragments for quotation checks.  CJK means U+4E00
to U+9FFF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
#: Fixed value: the separators of the lexical tokeniser.
SEPARATORS = "，。、；：？！（）()【】《》,.;:?!\"' \t\r\n"


def _bigrams(token: Column) -> Column:
    """A CJK run as its character bigrams, a run of one character as itself; other tokens unchanged."""
    n = F.length(token)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(2)))
    return F.when(token.rlike(f"^[{CJK}]"), pairs).otherwise(F.array(token))


def _spaced(text: Column) -> Column:
    return F.regexp_replace(text, f"([{CJK}]+)", " $1 ")


def with_bigrams(own: Column, inside: str) -> Column:
    """Runs of ``inside``, those of CJK characters as bigrams; texts without CJK take no part in the latter."""
    every = lambda text: F.regexp_extract_all(text, F.lit(inside), F.lit(0))
    return F.when(own.rlike(f"[{CJK}]"), F.flatten(F.transform(every(_spaced(own)), _bigrams))).otherwise(every(own))


def words(text: Column) -> Column:
    """Lower-case words and CJK bigrams, in order."""
    return with_bigrams(F.lower(F.coalesce(text, F.lit(""))), r"[\p{L}\p{N}']+")


def _lexical(text: Column) -> Column:
    """Lower-cased, with a blank for each separator."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " " * len(SEPARATORS))


def lexical_tokens(text: Column) -> Column:
    """Like words, but anything that is no separator stays inside its token."""
    return with_bigrams(_lexical(text), "[^ ]+")


def lexical_count(text: Column, term: str | None = None) -> Column:
    """The number of lexical tokens, or of those that are ``term``."""
    own = _lexical(text)
    tokens = lexical_tokens(text)
    slow = F.size(tokens if term is None else F.filter(tokens, lambda x: x == F.lit(term)))
    fast = F.regexp_count(own, F.lit("[^ ]+" if term is None else f"(?<![^ ])\\Q{term}\\E(?![^ ])"))
    count = F.when(own.rlike(f"[{CJK}]"), slow).otherwise(fast)
    return (count if term is None else F.when(F.lower(text).contains(term), count).otherwise(0)).cast("long")


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens (without blanks), joined by blanks; none if there are fewer.

    The runs are matches of a look-ahead, one at each token's start.
    """
    run = f"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{n - 1}}})(?![^ ]))"
    return F.array_distinct(F.regexp_extract_all(F.array_join(tokens, " "), F.lit(run), F.lit(1)))


def bare(text: Column) -> Column:
    """The lower-cased letters and digits of a text."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def char_grams(own: Column, n: int = 3) -> Column:
    """The set of runs of n characters of a bare text; up to n characters are one run."""
    runs = F.array_distinct(F.regexp_extract_all(own, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(own == "", F.array().cast("array<string>")).when(F.length(own) <= n, F.array(own)).otherwise(runs)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fragment(text: Column) -> Column:
    """A quotation's bare form: no emphasis, one kind of dash, no ellipsis, single blanks."""
    out = F.regexp_replace(F.regexp_replace(text, "&amp;", "&"), r"\*", "")
    out = F.regexp_replace(out, "[—–]|--+", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"…|\.\.\.", " "), r"[\s]+", " "))


def unit_count(text: Column) -> Column:
    """CJK characters plus words of ASCII letters, digits and apostrophes."""
    own = F.coalesce(text, F.lit(""))
    return F.regexp_count(own, F.lit(f"[{CJK}]")) + F.regexp_count(own, F.lit("[A-Za-z0-9']+"))


def token_estimate(text: Column) -> Column:
    """A cheap estimate of model tokens: 1 for a CJK character, 0.35 for any other."""
    own = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(own, F.lit(f"[{CJK}]"))
    return F.floor(cjk + (F.length(own) - cjk) * 0.35)


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.ff, cut to tenths of a second."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%d0", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.floor(ms / 100) % 10)


#: Fixed value: the punctuation that cleaning deletes.
PUNCTUATION = "，。、；：？！“”‘’「」『』（）《》〈〉【】—…·,.;:?!\"'()[]<>-"


def clean(text: Column) -> Column:
    """A text without blanks and punctuation; letter case and order stay."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), PUNCTUATION, "")


def normal(text: Column) -> Column:
    """Character entities, emphasis, quotation marks, dashes and blanks brought to one form."""
    out = text
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.translate(F.translate(out, "*", ""), "“”‘’", "\"\"''")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[—–]|--+", "-"), r"\s+", " "))


def mapped(text: Column, pairs: dict[str, str]) -> Column:
    """A text with single characters replaced, as simplified by traditional forms; the table is the caller's data."""
    return F.translate(text, "".join(pairs), "".join(pairs.values()))
