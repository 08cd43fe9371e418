"""Ranked text search and structured search as DataFrame plans.

Both parse on the driver, build one lazy plan of built-in functions, and derive page, total and facets from one match set.
With a stored index (``postings``) terms, phrases and prefixes are looked up there, and only what they leave is read as
text. A page is an order with a limit, which Spark runs as a top-k, never a full sort on one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencat.functions import text as T
from lumencat.functions.interpret import PREFIX, Clause, Interpretation, StructuredQuery, TextQuery, interpret, parse_clauses
from lumencat.operators.postings import Index, clause_hits, of_words

#: Columns that ``ranked_search`` reads: id, title, comment, description strings; user_tags, profile_tags arrays of strings.
SEARCHED = ("title", "user_tags", "profile_tags", "comment", "description")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _joined() -> dict[str, Column]:
    return {"title": F.col("title"), "user_tags": F.array_join("user_tags", " "), "profile_tags": F.array_join("profile_tags", " "), "comment": F.col("comment"), "description": F.col("description")}


def with_text(sounds: DataFrame) -> DataFrame:
    """Nulls of the searched fields as empty ones, the joined lower-case text (``full``) and its form without accents (``flat``)."""
    arrays = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("user_tags", "profile_tags")}
    s = sounds.withColumns(arrays | {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "comment", "description")})
    j = _joined()
    full = F.lower(F.concat_ws(" ", j["title"], j["user_tags"], j["comment"], j["profile_tags"], j["description"]))
    # generated, so that conditions do not fold the text again and again
    return s.withColumn("_x", F.explode(F.array(F.struct(full.alias("full"), T.deaccent(full).alias("flat"))))).select("*", "_x.*").drop("_x")


def with_tokens(sounds: DataFrame) -> DataFrame:
    """Adds the token arrays of the five searched fields, their union and the joined text; nulls are empty."""
    s = sounds if "full" in sounds.columns else with_text(sounds)
    # one generated row a sound: conditions on tokens stay above it, so that a text is cut into tokens once
    s = s.withColumn("_t", F.explode(F.array(F.struct(*[T.tokens(c).alias(f"{k}_tokens") for k, c in _joined().items()])))).select("*", "_t.*").drop("_t")
    return s.withColumns({"document": F.flatten(F.array(*[F.col(f"{k}_tokens") for k in SEARCHED])), "title_lower": F.lower("title"), "tags_lower": F.lower(F.array_join("user_tags", " "))})


def may_match(term: str) -> Column:
    """Necessary for the term to be a token: a word of its synonym group is in the text. Inner apostrophes may hide one."""
    group = [w for w, first in T.CANONICAL.items() if first == term] or [term]
    return any_of([phrase_in_text(w) for w in group]) | F.contains("full", F.lit("'")) | F.contains("full", F.lit("’"))


def phrase_in_text(phrase: str) -> Column:
    return F.contains("full", F.lit(phrase)) | F.contains("flat", F.lit(phrase.translate(str.maketrans(T.ACCENTED, T.PLAIN))))


def vocabulary(tokenised: DataFrame) -> DataFrame:
    """(word, documents) over the documents in scope."""
    return tokenised.select(F.explode(F.array_distinct("document")).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))


def corrections(tokenised: DataFrame, terms: list[str]) -> dict[str, str]:
    """The nearest vocabulary word of each unknown term of four letters or more, by (distance, word), within the edit budget.

    The query's few terms meet the distinct vocabulary, of which the length difference leaves a fraction for the distance.
    """
    odd = [t for t in terms if len(t) >= 4 and t not in T.CANONICAL]
    odd = [t for t in odd if tokenised.where(may_match(t) & F.array_contains("document", t)).isEmpty()]  # most terms are known
    if not odd:
        return {}
    words = vocabulary(tokenised).select("word")
    asked = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(T.edit_budget(t)).alias("budget")) for t in odd])
    pairs = words.select("word", F.explode(asked).alias("a")).select("word", "a.term", "a.budget").where(F.abs(F.length("word") - F.length("term")) <= F.col("budget"))
    near = pairs.withColumn("d", T.distance("term", "word")).where("d <= budget").groupBy("term").agg(F.min(F.struct("d", "word")).alias("best"))
    return {r["term"]: r["best"]["word"] for r in near.collect() if r["best"]["d"] > 0}


def term_matches(term: str) -> Column:
    """The term is a token, with or without accents; one with a CJK character may also be part of the title."""
    flat = term.translate(str.maketrans(T.ACCENTED, T.PLAIN))
    found = F.array_contains("document", term) | F.exists("document", lambda t: T.deaccent(t) == flat)
    if any(c >= "⺀" for c in term):
        found = found | F.contains("title_lower", F.lit(term)) | F.contains(T.deaccent(F.col("title_lower")), F.lit(flat))
    return found


def phrase_in(c: Column, phrase: str) -> Column:
    flat = phrase.translate(str.maketrans(T.ACCENTED, T.PLAIN))
    return F.contains(c, F.lit(phrase)) | F.contains(T.deaccent(c), F.lit(flat))


def excluded_matches(term: str) -> Column:
    """An exclusion hits a token or any substring of the whole text."""
    return F.array_contains("document", term) | phrase_in_text(term)


WEIGHTS = dict(zip(SEARCHED, (30, 20, 10, 4, 2), strict=True))


def text_score(parsed: Interpretation, raw: str) -> Column:
    """Title, tag and phrase relevance; needs title_lower and tags_lower."""
    whole = raw.strip().strip("\"'").strip().lower()
    title = F.col("title_lower")
    flat = T.deaccent(title)
    plain = lambda t: t.translate(str.maketrans(T.ACCENTED, T.PLAIN))
    asked = ([whole] if whole else []) + parsed.phrases
    is_title = any_of([(title == a) | (flat == plain(a)) for a in asked])
    begins = any_of([title.startswith(a) | flat.startswith(plain(a)) for a in asked])
    within = any_of([phrase_in(title, a) for a in asked])
    total = F.when(is_title, 1000).when(begins, 400).when(within, 200).otherwise(0)
    if whole:
        total = total + 250 * F.size(F.filter("user_tags", lambda t: (F.lower(t) == whole) | (T.deaccent(F.lower(t)) == plain(whole))))
    for p in parsed.phrases:
        total = total + F.when(phrase_in(title, p), 300).when(phrase_in(F.col("tags_lower"), p), 150).otherwise(80)
    return total


def score(parsed: Interpretation, raw: str) -> Column:
    """Title, tag, phrase and token relevance, 1 at least."""
    total = text_score(parsed, raw)
    for t in parsed.terms:
        for name, weight in WEIGHTS.items():
            total = total + F.when(F.array_contains(f"{name}_tokens", t), weight).otherwise(0)
    return F.greatest(total, F.lit(1))


def token_index_columns(sounds: DataFrame) -> DataFrame:
    """(id, and the tokens of each searched field): what the ranked search's index is built of."""
    return with_tokens(sounds).select("id", *[F.col(f"{f}_tokens").alias(f) for f in SEARCHED])


def indexed_corrections(scope: DataFrame, index: Index, terms: list[str]) -> dict[str, str]:
    """As ``corrections``, over the vocabulary of the index and the documents in scope."""
    odd = [t for t in terms if len(t) >= 4 and t not in T.CANONICAL]
    if not odd:
        return {}
    ids = scope.select("id")
    known = {r["word"] for r in of_words(index, odd).join(ids, "id", "left_semi").select("word").distinct().collect()}
    odd = [t for t in odd if t not in known]
    if not odd:
        return {}
    asked = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(T.edit_budget(t)).alias("budget")) for t in odd])
    pairs = index.vocabulary.select("word").distinct().select("word", F.explode(asked).alias("a")).select("word", "a.term", "a.budget")
    near = pairs.where(T.may_be_near("term", "word", F.col("budget"))).withColumn("d", T.distance("term", "word")).where("d <= budget")
    here = index.postings.select("word", "id").join(near, "word").join(ids, "id", "left_semi")
    return {r["term"]: r["best"]["word"] for r in here.groupBy("term").agg(F.min(F.struct("d", "word")).alias("best")).collect() if r["best"]["d"] > 0}


def indexed_terms(index: Index, terms: list[str]) -> DataFrame:
    """(id, points): documents that hold each term, with or without accents, and the weights of the fields that hold it as it is."""
    flat = {t: t.translate(str.maketrans(T.ACCENTED, T.PLAIN)) for t in terms}
    p = of_words(index, terms, accents=False)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("field"))
    found = [F.bool_or(F.col("flat") == flat[t]).alias(f"_t{k}") for k, t in enumerate(terms)]
    points = F.sum(F.when(F.col("word").isin(terms), weight).otherwise(0) * sum((F.when(F.col("word") == t, 1).otherwise(0) for t in terms), F.lit(0))).alias("points")
    return p.groupBy("id").agg(points, *found).where(all_of([F.col(f"_t{k}") for k in range(len(terms))])).select("id", "points")


def ranked_matches(sounds: DataFrame, q: TextQuery, correct: bool = True, index: Index | None = None, allowed: list[str] | None = None) -> tuple[DataFrame, Interpretation]:
    """All matches with their score, and how the query was understood.

    sounds: id, source_id, status, online, favorite, duration and the searched fields. Filters come before any tokens. With
    an index of the sounds the terms are looked up there; without one, or for terms with CJK characters, which titles may
    hold inside a token, texts are cut into tokens. allowed: the caller's sources, before anything else.
    """
    parsed = interpret(q)
    scope = sounds.where((F.col("status") == "ready") & F.col("duration").isNotNull() & F.col("online"))
    if allowed is not None:
        scope = scope.where(F.col("source_id").isin(allowed) if allowed else F.lit(False))
    if q.source_ids:
        scope = scope.where(F.col("source_id").isin(q.source_ids))
    if any(c >= "⺀" for t in parsed.terms for c in t):
        index = None
    if correct:
        fixed = indexed_corrections(scope, index, parsed.terms) if index else corrections(with_tokens(with_text(scope)), parsed.terms)
        for term, word in fixed.items():
            parsed.corrected.append(f"{term} -> {word}")
            parsed.terms[parsed.terms.index(term)] = word
    early = []
    if q.favorites_only:
        early.append(F.col("favorite"))
    if parsed.min_duration is not None:
        early.append(F.col("duration") > parsed.min_duration)
    if parsed.max_duration is not None:
        early.append(F.col("duration") < parsed.max_duration)
    if q.tags:
        own = F.transform(F.concat("user_tags", "profile_tags"), lambda t: F.lower(F.translate(t, "_", " ")))
        early += [F.array_contains(own, t.replace("_", " ").strip().lower()) for t in q.tags]
    substrings = [~phrase_in_text(t) for t in parsed.excluded] + [phrase_in_text(p) for p in parsed.phrases]
    if index and parsed.terms:
        left = scope.where(all_of(early)).join(indexed_terms(index, parsed.terms), "id")
        # an excluded token that is no substring of the text (a synonym, a word without its apostrophe)
        if parsed.excluded:
            left = left.join(of_words(index, parsed.excluded).select("id").distinct(), "id", "left_anti")
        s = with_text(left).where(all_of(substrings)).withColumns({"title_lower": F.lower("title"), "tags_lower": F.lower(F.array_join("user_tags", " "))})
        return s.withColumn("score", F.greatest(text_score(parsed, q.text) + F.col("points"), F.lit(1)).cast("int")).drop("points"), parsed
    # substring searches cost little: what they rule out is never cut into tokens
    s = with_tokens(with_text(scope).where(all_of(early + [may_match(t) for t in parsed.terms] + substrings)))
    late = [term_matches(t) for t in parsed.terms] + [~excluded_matches(t) for t in parsed.excluded]
    return s.where(all_of(late)).withColumn("score", score(parsed, q.text).cast("int")), parsed


def rank_order() -> list[Column]:
    return [F.desc("score"), F.octet_length("title").asc(), F.lower("title").asc(), F.asc("id")]


def page(matches: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    return matches.orderBy(*order).offset(offset).limit(limit)


def text_facets(matches: DataFrame, top: int = 30) -> DataFrame:
    """(dim, value, n): tags (each once a sound, the most frequent ``top``), layouts and duration classes of all matches."""
    tags = F.array_distinct(F.filter(F.transform(F.concat("user_tags", "profile_tags"), lambda t: F.lower(F.trim(F.translate(t, "_", " ")))), lambda t: t != ""))
    by_tag = matches.select(F.explode(tags).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    layout = F.when(F.coalesce("channel_layout", F.lit("")) != "", F.col("channel_layout")).when(F.col("channels") == 1, "mono").when(F.col("channels") == 2, "stereo").otherwise(F.concat(F.col("channels").cast("string"), F.lit(" ch")))
    span = F.when(F.col("duration") < 3, "under 3s").when(F.col("duration") <= 15, "3s - 15s").otherwise("over 15s")
    other = matches.select(F.explode(F.array(F.struct(F.lit("layout").alias("dim"), layout.alias("value")), F.struct(F.lit("duration").alias("dim"), span.alias("value")))).alias("f")).select("f.*").groupBy("dim", "value").agg(F.count("*").alias("n"))
    return by_tag.select(F.lit("tag").alias("dim"), "value", "n").unionByName(other)


# -- structured search ---------------------------------------------------------------------------------------------


def clause_matches(c: Clause, tokens: Column) -> Column:
    """A term, phrase or prefix in one field's tokens; several tokens must follow each other."""
    own = c.tokens
    if not own:
        return F.lit(False)
    if len(own) == 1:
        return F.exists(tokens, lambda t: t.startswith(own[0])) if c.kind == PREFIX else F.array_contains(tokens, own[0])
    flat = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(flat, F.lit(" " + " ".join(own) + ("" if c.kind == PREFIX else " ")))


def structured_matches(docs: DataFrame, tags: DataFrame, q: StructuredQuery, allowed: list[str] | None = None, index: Index | None = None) -> DataFrame:
    """Documents that satisfy the query, with tier and the fields that were hit.

    docs: id, source_id, kind, admitted, online, the filter columns, and, without an index, ``<field>_tokens`` arrays;
    tags: id, key, state. The index's fields are the query's.
    The caller's scope is applied before anything else; an empty scope is an empty result.
    """
    q.validated()
    scope = q.source_ids or None
    if allowed is not None:
        scope = [s for s in q.source_ids if s in allowed] if q.source_ids else allowed
    d = docs.where(F.col("kind").isin(q.kinds) & F.col("admitted"))
    if scope is not None:
        d = d.where(F.col("source_id").isin(scope) if scope else F.lit(False))
    d = d.withColumn("availability", F.when(~F.col("online"), "offline").otherwise(F.col("availability")))
    keep = [F.col(c).isin(v) for c, v in (("orientation", q.orientations), ("transparency", q.transparency), ("format", q.formats), ("technical", q.technical), ("availability", q.availability), ("enrichment", q.enrichment)) if v]
    if q.favorite is not None:
        keep.append(F.col("favorite") == q.favorite)
    if q.rated is not None:
        keep.append(F.col("rating").isNotNull() if q.rated else F.col("rating").isNull())
    if q.alpha_channel is not None:
        keep.append(F.col("alpha") == q.alpha_channel)
    if q.ready_only:
        keep.append((F.col("technical") == "ready") & (F.col("availability") == "available"))
    if q.needs_review is not None:
        keep.append((F.col("suggestions") > 0) if q.needs_review else (F.col("suggestions") == 0))
    for column, low, high in (("rating", q.min_rating, q.max_rating), ("width", q.min_width, q.max_width), ("height", q.min_height, q.max_height)):
        if low is not None:
            keep.append(F.col(column) >= low)
        if high is not None:
            keep.append(F.col(column) <= high)
    if q.added_after is not None:
        keep.append(F.col("added_at") >= q.added_after)
    if q.added_before is not None:
        keep.append(F.col("added_at") < q.added_before)
    if q.provenance:
        keep.append(F.arrays_overlap("origins", F.array(*map(F.lit, q.provenance))))
    d = d.where(all_of(keep))
    of_state = tags if q.tag_state == "any" else tags.where(F.col("state") == q.tag_state)
    key = lambda t: " ".join(t.replace("_", " ").split()).lower()
    for t in q.tags:
        d = d.join(of_state.where(F.col("key") == key(t)).select("id"), "id", "left_semi")
    if q.exclude_tags:
        d = d.join(of_state.where(F.col("key").isin([key(t) for t in q.exclude_tags])).select("id"), "id", "left_anti")
    clauses, _ = parse_clauses(q.text)
    positive = [c for c in clauses if not c.excluded]
    hit = lambda c, f: clause_matches(c, F.col(f"{f}_tokens"))
    if index and clauses:
        d = d.join(clause_hits(index, clauses, q.fields), "id", "inner" if positive else "left")
        hit = lambda c, f: F.coalesce(F.col(f"h{clauses.index(c)}_{f}"), F.lit(False))
    if negative := [c for c in clauses if c.excluded]:
        d = d.where(~any_of([hit(c, f) for c in negative for f in q.fields]))
    if not positive:
        return d.withColumn("tier", F.lit(None).cast("int")).withColumn("hit_fields", F.array().cast("array<string>"))
    d = d.where(all_of([any_of([hit(c, f) for f in q.fields]) for c in positive]))
    tier = F.lit(5)
    for field, rank in (("notes", 4), ("name", 3), ("caption", 2), ("tags", 1)):
        if field in q.fields:
            tier = F.when(all_of([hit(c, field) for c in positive]), rank).otherwise(tier)
    whole = key(" ".join(c.text for c in positive))
    if "tags" in q.fields and all(c.kind != PREFIX for c in positive) and len(whole) <= 64:
        exact = tags.where((F.col("state") == "confirmed") & (F.col("key") == whole)).select("id").distinct().withColumn("exact_tag", F.lit(True))
        d = d.join(exact, "id", "left")
        tier = F.when(F.col("exact_tag"), 0).otherwise(tier)
    fields = F.filter(F.array(*[F.when(any_of([hit(c, f) for c in positive]), f) for f in q.fields]), lambda f: f.isNotNull())
    return d.withColumn("tier", tier.cast("int")).withColumn("hit_fields", fields).drop("exact_tag")


def structured_order(sort: str) -> list[Column]:
    """Nulls last in every order; ties by folded path, path and id."""
    ties = [T.ascii_lower(F.col("path")).asc(), F.asc("path"), F.asc("id")]
    first = {
        "relevance": [F.asc_nulls_last("tier")],
        "name_asc": [],
        "rating_desc": [F.desc_nulls_last("rating")],
        "added_desc": [F.desc_nulls_last("added_at")],
        "added_asc": [F.asc_nulls_last("added_at")],
        "pixels_desc": [F.desc_nulls_last(F.col("width") * F.col("height"))],
    }
    if sort == "name_desc":
        return [T.ascii_lower(F.col("path")).desc(), F.desc("path"), F.asc("id")]
    return first[sort] + ties


def guidance(docs: DataFrame, q: StructuredQuery, index: Index | None = None) -> DataFrame:
    """(clause, n): how many documents of the scope each clause matches alone, in one pass."""
    clauses, _ = parse_clauses(q.text)
    if index:
        hits = clause_hits(index, clauses, q.fields).join(docs.select("id"), "id", "left_semi")
        counts = hits.agg(*[F.count_if(any_of([F.col(f"h{k}_{f}") for f in q.fields])).alias(str(k)) for k in range(len(clauses))])
        rows = F.array(*[F.struct(F.lit(c.text).alias("clause"), F.col(str(k)).alias("n")) for k, c in enumerate(clauses)])
        return counts.select(F.explode(rows).alias("r")).select("r.*")
    sums = [F.count_if(any_of([clause_matches(c, F.col(f"{f}_tokens")) for f in q.fields])).alias(str(k)) for k, c in enumerate(clauses)]
    counts = docs.agg(*sums)
    rows = F.array(*[F.struct(F.lit(c.text).alias("clause"), F.col(str(k)).alias("n")) for k, c in enumerate(clauses)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def facet_counts(matches: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dim, value, n) of several dimensions in one pass over the matches; nulls are not counted."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), c.cast("string").alias("value")) for k, c in dimensions.items()]))
    return matches.select(each.alias("f")).select("f.*").where("value is not null").groupBy("dim", "value").agg(F.count("*").alias("n"))


def suggestions(words: DataFrame, term: str, top: int = 3) -> DataFrame:
    """(word, documents): words of a vocabulary (word, documents) within the edit budget of a term, most frequent first; never applied by itself."""
    budget = T.edit_budget(term)
    near = words.where((F.col("word") != term) & T.may_be_near(F.lit(term), "word", F.lit(budget)))
    return near.where(T.distance(F.lit(term), F.col("word")) <= budget).select("word", "documents").orderBy(F.desc("documents"), "word").limit(top)
