"""Query text to a plan: both search engines' parsers and the structured query's validation, on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from lumencat.functions.text import CANONICAL, STOP_WORDS, plain_words

NEGATIONS = ("without", "not", "no", "excluding")
# Fixed value: how durations are said.
_DURATION = re.compile(r"\b(under|below|less than|over|above|longer than)\s+(\d+(?:\.\d+)?)\s*(seconds?|secs?|s|minutes?|mins?)\b")
_INNER_APOSTROPHE = re.compile(r"(?<=\w)['’](?=\w)")


class InvalidQuery(ValueError):
    """A query that is contradictory or beyond the limits; it is never an empty result."""


@dataclass
class TextQuery:
    """Free text over titles, tags and comments, with filters beside it."""

    text: str = ""
    source_ids: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    favorites_only: bool = False
    min_duration: float | None = None
    max_duration: float | None = None
    offset: int = 0
    limit: int | None = None


@dataclass
class Interpretation:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    min_duration: float | None = None
    max_duration: float | None = None
    corrected: list[str] = field(default_factory=list)


def _add(to: list[str], value: str) -> None:
    if value not in to:
        to.append(value)


def interpret(q: TextQuery) -> Interpretation:
    """Durations, quoted phrases, negations, stop words and "short" are told apart; the rest are terms."""
    if len(q.text) > 512 or len(q.tags) > 64 or len(q.source_ids) > 128 or (q.limit or 100) > 500:
        raise InvalidQuery("search exceeds supported limits")
    if any(v is not None and (not math.isfinite(v) or v < 0) for v in (q.min_duration, q.max_duration)):
        raise InvalidQuery("duration must be a non-negative finite number")
    out = Interpretation(min_duration=q.min_duration, max_duration=q.max_duration)
    text = q.text.lower()
    for how, number, unit in _DURATION.findall(text):
        value = float(number) * (60 if unit.startswith("m") else 1)
        if how in ("under", "below", "less than"):
            out.max_duration = value if out.max_duration is None else min(out.max_duration, value)
        else:
            out.min_duration = value if out.min_duration is None else max(out.min_duration, value)
    rest = _DURATION.sub(" ", text)
    negate = False
    # a minus sign, then a quoted phrase (perhaps not closed) or a run without spaces and quotes; inner apostrophes are no quotes
    part = re.compile(r"""\s*(-?)(?:"([^"]*)"?|'([^']*)'?|((?:[^\s"']|(?<=\w)'(?=\w))+))""")
    at = 0
    while m := part.match(rest, at):
        at = m.end()
        minus, quoted = bool(m[1]), m[2] if m[2] is not None else m[3]
        if quoted is not None:
            phrase = quoted.strip()
            if phrase and (minus or negate):
                _add(out.excluded, phrase)
                negate = False
            elif phrase:
                _add(out.phrases, phrase)
            continue
        for word in plain_words(_INNER_APOSTROPHE.sub("", m[4])):
            term = CANONICAL.get(word, word)
            if term in NEGATIONS:
                negate = True
            elif term in STOP_WORDS:
                continue
            elif term == "short" and not negate and not minus:
                out.max_duration = 3.0 if out.max_duration is None else out.max_duration
            elif negate or minus:
                _add(out.excluded, term)
                negate = False
            else:
                _add(out.terms, term)
    if out.min_duration is not None and out.max_duration is not None and out.min_duration >= out.max_duration:
        raise InvalidQuery("duration filters have no overlap")
    return out


TERM, PHRASE, PREFIX = "term", "phrase", "prefix"
FIELDS = ("tags", "caption", "name", "notes", "path")
DEFAULT_FIELDS = ("tags", "caption", "name", "notes")
# Limits of a query.
MAX_CLAUSES, MAX_LIST, MAX_TAGS, MAX_DIMENSION = 32, 32, 32, 65_535


@dataclass(frozen=True)
class Clause:
    text: str
    kind: str
    excluded: bool = False

    @property
    def tokens(self) -> list[str]:
        import unicodedata

        from lumencat.functions.text import ACCENTED, PLAIN

        folded = unicodedata.normalize("NFC", self.text).lower().translate(str.maketrans(ACCENTED, PLAIN))
        spaced = re.sub("([぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0002fa1f])", r" \1 ", folded)
        return plain_words(spaced)


def parse_clauses(text: str) -> tuple[list[Clause], list[str]]:
    """Terms, "phrases", prefix* and -excluded ones of them; what holds no letter or digit is returned as ignored."""
    if len(text) > 512 or "\0" in text:
        raise InvalidQuery("query text exceeds supported limits")
    clauses: list[Clause] = []
    ignored: list[str] = []
    for m in re.finditer(r'(-(?=\S))?(?:"([^"]*)"?|([^\s"]+))', text):
        minus, raw = bool(m[1]), m[2] if m[2] is not None else m[3]
        kind = PHRASE if m[2] is not None else TERM
        if kind == TERM and raw.endswith("*") and not raw.endswith("**"):
            raw, kind = raw[:-1], PREFIX
        if not any(c.isalnum() for c in raw):
            if raw.strip():
                ignored.append("-" * minus + raw)
            continue
        c = Clause(" ".join(raw.split()), kind, minus)
        if c not in clauses:
            clauses.append(c)
    if len(clauses) > MAX_CLAUSES:
        raise InvalidQuery("too many clauses")
    return clauses, ignored


SORTS = ("relevance", "name_asc", "name_desc", "rating_desc", "added_desc", "added_asc", "pixels_desc")


@dataclass
class StructuredQuery:
    """The typed query over asset metadata. Empty lists and None do not filter."""

    text: str = ""
    fields: tuple[str, ...] = DEFAULT_FIELDS
    source_ids: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=lambda: ["image"])
    orientations: list[str] = field(default_factory=list)
    transparency: list[str] = field(default_factory=list)
    formats: list[str] = field(default_factory=list)
    technical: list[str] = field(default_factory=list)
    availability: list[str] = field(default_factory=list)
    enrichment: list[str] = field(default_factory=list)
    provenance: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    exclude_tags: list[str] = field(default_factory=list)
    tag_state: str = "confirmed"
    favorite: bool | None = None
    rated: bool | None = None
    alpha_channel: bool | None = None
    ready_only: bool = False
    needs_review: bool | None = None
    min_rating: int | None = None
    max_rating: int | None = None
    min_width: int | None = None
    max_width: int | None = None
    min_height: int | None = None
    max_height: int | None = None
    added_after: int | None = None
    added_before: int | None = None
    sort: str = "relevance"

    def validated(self) -> StructuredQuery:
        """Itself, or InvalidQuery for contradictions and unknown names."""
        clash = lambda a, b: a is not None and b is not None and a > b
        key = lambda t: " ".join(t.replace("_", " ").split()).lower()
        if any(f not in FIELDS for f in self.fields) or self.sort not in SORTS or self.tag_state not in ("confirmed", "suggested", "any"):
            raise InvalidQuery("unknown field, sort or state")
        if any(not key(t) or len(key(t)) > 64 for t in [*self.tags, *self.exclude_tags]) or {key(t) for t in self.tags} & {key(t) for t in self.exclude_tags}:
            raise InvalidQuery("a tag is blank, too long, or both required and excluded")
        if any(r is not None and not 1 <= r <= 5 for r in (self.min_rating, self.max_rating)) or clash(self.min_rating, self.max_rating):
            raise InvalidQuery("rating bounds")
        if self.rated is False and (self.min_rating is not None or self.max_rating is not None):
            raise InvalidQuery("a rating bound on unrated assets")
        for low, high in ((self.min_width, self.max_width), (self.min_height, self.max_height)):
            if any(v is not None and not 0 < v <= MAX_DIMENSION for v in (low, high)) or clash(low, high):
                raise InvalidQuery("dimension bounds")
        if self.added_after is not None and self.added_before is not None and self.added_after >= self.added_before:
            raise InvalidQuery("date bounds")
        lists = (self.kinds, self.orientations, self.transparency, self.formats, self.technical, self.availability, self.enrichment, self.provenance)
        if any(len(x) > MAX_LIST for x in lists) or len(self.tags) > MAX_TAGS or len(self.exclude_tags) > MAX_TAGS:
            raise InvalidQuery("too many values")
        parse_clauses(self.text)
        return self


#: TXT-20: what each field of the structured query can do.
CAPABILITIES = {f: {"searchable": True, "default": f in DEFAULT_FIELDS, "phrases": True, "prefixes": True} for f in FIELDS}
