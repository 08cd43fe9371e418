"""Text functions as columns: folding, tokens, synonyms, distances."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Stop words, synonym groups (the first word stands for its group) and accented letters of the search rules.
STOP_WORDS = ("a", "an", "the", "find", "me", "some", "any", "please", "sound", "sounds", "effect", "effects", "sfx", "audio", "for", "of", "that", "is", "like", "something", "need", "i", "want", "with", "and")
SYNONYMS = (
    ("whoosh", "swoosh", "swish", "sweep"),
    ("impact", "hit", "thud", "slam"),
    ("hiss", "hissing"),
    ("scratch", "scrape", "scratching", "scraping"),
    ("rain", "rainfall", "raining", "raindrop", "raindrops"),
    ("train", "railway", "locomotive"),
    ("voice", "voices", "vocal", "vocals", "speech", "talking"),
    ("quiet", "soft", "gentle"),
    ("loud", "powerful"),
    ("bright", "sharp", "trebly"),
    ("dark", "bass", "bassy", "rumble", "rumbly"),
    ("footsteps", "footstep", "walking"),
    ("wind", "windy"),
    ("water", "liquid"),
    ("click", "clicking", "tap"),
    ("beep", "bleep"),
    ("door", "doors"),
    ("metal", "metallic"),
)
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"

CANONICAL = {word: group[0] for group in SYNONYMS for word in group}
SEPARATOR = r"[^\p{L}\p{N}]+"


def deaccent(c: Column) -> Column:
    """Folds the accented letters of lower-case text."""
    return F.translate(c, ACCENTED, PLAIN)


_CANONICAL_MAP = "map(" + ", ".join(f"'{x}'" for pair in CANONICAL.items() for x in pair) + ")"
_HAS_SYNONYM = "^(?:" + "|".join(CANONICAL) + ")$"


def canonical(token: Column) -> Column:
    """The word that stands for a token's synonym group, or the token."""
    # most tokens are none of these: a pattern rules them out before the map, which is searched from its start
    return F.when(token.rlike(_HAS_SYNONYM), F.element_at(F.expr(_CANONICAL_MAP), token)).otherwise(token)


def split_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), SEPARATOR), lambda t: t != "")


def tokens(c: Column) -> Column:
    """Tokens with synonyms made one; a word with an inner apostrophe also yields its joined form."""
    plain = F.transform(split_tokens(c), canonical)
    joined = F.transform(split_tokens(F.regexp_replace(c, r"(?<=[\p{L}\p{N}])['’](?=[\p{L}\p{N}])", "")), canonical)
    return F.when(c.rlike("['’]"), F.array_union(plain, F.array_except(joined, plain))).otherwise(plain)


def words(c: Column) -> Column:
    """Words of the evaluation rules: lower case, a plural s taken off words of more than three letters."""
    plural = lambda w: (F.octet_length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(split_tokens(c), lambda w: F.when(plural(w), F.regexp_replace(w, "s$", "")).otherwise(w))


def ascii_lower(c: Column) -> Column:
    """Folds A to Z only, as the gallery order does."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def file_stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


@F.pandas_udf(StringType())
def nfc(column: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark SQL lacks."""
    return column.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def display_tag(c: Column, normalise: bool = True) -> Column:
    """A tag as shown: underscores are spaces, white space is one space; null if blank, over 64 characters or with a control character."""
    t = F.trim(F.regexp_replace(F.translate(nfc(c) if normalise else c, "_", " "), r"\s+", " "))
    return F.when((t != "") & (F.length(t) <= 64) & ~t.rlike(r"\p{Cc}"), t)


def tag_key(c: Column, normalise: bool = True) -> Column:
    return F.lower(nfc(c) if normalise else c)


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits, insertions, deletions and transpositions (of letters that may have others between) from a to b."""
    seen: dict[str, int] = {}
    most = len(a) + len(b)
    row = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        row[i + 1][1] = i
    for j in range(len(b) + 1):
        row[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            cost = 0 if x == y else 1
            if not cost:
                match = j
            row[i + 1][j + 1] = min(row[i][j] + cost, row[i + 1][j] + 1, row[i][j + 1] + 1, row[k][m] + i - k - 1 + 1 + j - m - 1)
        seen[x] = i
    return row[-1][-1]


@F.pandas_udf(IntegerType())
def distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Damerau-Levenshtein distance of two words. For distinct words only: never on a column of whole documents."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else damerau_levenshtein(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def may_be_near(a: Column | str, b: Column | str, budget: Column) -> Column:
    """Necessary for a distance within the budget: a transposition is two edits without one, so twice as many are enough."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (F.abs(F.length(a) - F.length(b)) <= budget) & (F.levenshtein(a, b) <= 2 * budget)


def edit_budget(word: Column | str) -> Column | int:
    """Two edits for words of more than seven characters, else one."""
    return (2 if len(word) > 7 else 1) if isinstance(word, str) else F.when(F.length(word) > 7, 2).otherwise(1)


_CJK = r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\x{20000}-\x{2FA1F}]"


def fold(c: Column, normalise: bool = True) -> Column:
    """Index form: NFC, control and private characters as spaces, each CJK character a token of its own."""
    t = F.regexp_replace(nfc(c) if normalise else c, r"[\p{Cc}\p{Co}]", " ")
    return F.regexp_replace(t, f"({_CJK})", " $1 ")


def index_tokens(c: Column, normalise: bool = True) -> Column:
    """Tokens of the structured index: folded, without case and accents."""
    return split_tokens(deaccent(F.lower(fold(c, normalise))))


def plain_words(text: str) -> list[str]:
    """Tokens of one string on the driver, by the rule of split_tokens."""
    return [t for t in re.split(r"[^\w]|_", text.lower()) if t]
