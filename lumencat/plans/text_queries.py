"""Text search queries: the ranked engine and the structured engine over documents.

A document is a sound whose title is its first line, whose comment is its text and whose tags are its language and source;
for the structured engine it is an asset with name (path), caption (first line) and notes (text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.functions import queries as Q
from lumencat.functions import text as T
from lumencat.functions.interpret import CAPABILITIES, StructuredQuery, TextQuery
from lumencat.operators import numbering, postings, segments, storage
from lumencat.operators import search as S
from lumencat.operators.cache import ChangeCounters, ResultCache
from lumencat.plans.registry import Tables, query

ONLINE_SQL = "d.source <> 'src3'"


def sounds(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    d = t.documents if documents is None else documents
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("ready").alias("status"), (F.col("source") != "src3").alias("online"), (F.col("doc_id") % 50 == 0).alias("favorite"),
        (F.col("n_chars") / 100).alias("duration"), (1 + F.col("doc_id") % 3).cast("int").alias("channels"), F.lit("").alias("channel_layout"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("comment"), F.array("lang", "source").alias("user_tags"), F.array(F.concat(F.lit("text_"), F.col("lang"))).alias("profile_tags"), F.lit("").alias("description"),
    )


def sound_index(t: Tables) -> postings.Index:
    return segments.index_of(t.spark, "sounds", f"{t.folder}/documents.parquet", lambda: S.token_index_columns(sounds(t, storage.spread(t.documents))), S.SEARCHED)


def ranked(t: Tables) -> DataFrame:
    """The ranked matches, through the index of the sounds' tokens."""
    return S.ranked_matches(sounds(t), RANKED, index=sound_index(t))[0]


#: The same relation in SQL, with tokens; none of the queries' terms has a synonym.
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_FOLD = f"translate({{}}, '{T.ACCENTED}', '{T.PLAIN}')"
SOUNDS = f"""(select d.doc_id as id, d.source as source_id, {ONLINE_SQL} as online, d.doc_id % 50 = 0 as favorite, d.n_chars / 100 as duration, 1 + d.doc_id % 3 as channels, d.lang,
  string_split(d.text, chr(10))[1] as title, lower(string_split(d.text, chr(10))[1]) as title_lower, d.text as comment,
  {_TOK.format("string_split(d.text, chr(10))[1]")} as title_tokens, {_TOK.format("d.text")} as comment_tokens, {_TOK.format("d.lang || ' ' || d.source")} as tag_tokens,
  {_TOK.format("'text_' || d.lang")} as profile_tokens,
  lower(string_split(d.text, chr(10))[1] || ' ' || d.lang || ' ' || d.source || ' ' || d.text || ' ' || 'text_' || d.lang || ' ') as full_text
  from documents d)"""

#: "the" is a stop word; the terms are "erst" and "thou".
RANKED = TextQuery(text='the erst thou -stupid "of the" over 2 seconds')
_HAS = "(list_contains(title_tokens, '{0}') or list_contains(comment_tokens, '{0}') or list_contains(tag_tokens, '{0}') or list_contains(profile_tokens, '{0}'))"
_POINTS = " + ".join(f"case when list_contains({f}_tokens, '{w}') then {p} else 0 end" for w in ("erst", "thou") for f, p in (("title", 30), ("tag", 20), ("profile", 10), ("comment", 4)))
MATCHES = f"""(select *, cast(greatest(1,
    case when title_lower = 'of the' then 1000 when starts_with(title_lower, 'of the') then 400 when contains(title_lower, 'of the') then 200 else 0 end
    + case when contains(title_lower, 'of the') then 300 when contains(lang || ' ' || source_id, 'of the') then 150 else 80 end + {_POINTS}) as integer) as score
  from {SOUNDS} s where online and duration > 2 and {_HAS.format("erst")} and {_HAS.format("thou")} and not contains(full_text, 'stupid') and contains(full_text, 'of the'))"""


@query("text_search_ranked", f"select id, title, score from {MATCHES} m order by score desc, octet_length(encode(title)), title_lower, id limit 100")
def text_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: filters, terms, an exclusion, a phrase and a duration, scored, ordered, one page."""
    found = ranked(Tables(spark, d))
    return S.page(found, S.rank_order()).select("id", "title", "score")


@query("FLT-04", f"select id from {SOUNDS} s where {_HAS.format('einer')} or list_contains(list_transform(comment_tokens, lambda t: {_FOLD.format('t')}), 'einer')")
def all_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.with_tokens(sounds(Tables(spark, d))).where(S.term_matches("einer")).select("id")


@query("FLT-05", f"select id from {SOUNDS} s where not contains(full_text, 'ouan') and not contains({_FOLD.format('full_text')}, 'ouan')")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    return S.with_tokens(sounds(Tables(spark, d))).where(~S.excluded_matches("ouan")).select("id")


@query("FLT-06", f"select id from {SOUNDS} s where contains(full_text, 'de la') or contains({_FOLD.format('full_text')}, 'de la')")
def phrases(spark: SparkSession, d: str) -> DataFrame:
    return S.with_tokens(sounds(Tables(spark, d))).where(S.phrase_in_text("de la")).select("id")


@query("AGG-01", f"select count(*) as total from {MATCHES} m")
def total(spark: SparkSession, d: str) -> DataFrame:
    return ranked(Tables(spark, d)).agg(F.count("*").alias("total"))


_TAG_FACET = f"select tag as value, count(*) as n from (select id, unnest(list_distinct([lang, source_id, 'text ' || lang])) as tag from {MATCHES} m) x group by tag order by n desc, value limit 30"
_LAYOUT = "case channels when 1 then 'mono' when 2 then 'stereo' else channels || ' ch' end"
_SPAN = "case when duration < 3 then 'under 3s' when duration <= 15 then '3s - 15s' else 'over 15s' end"


@query("AGG-04", _TAG_FACET)
def tag_facet(spark: SparkSession, d: str) -> DataFrame:
    return S.text_facets(ranked(Tables(spark, d))).where("dim = 'tag'").select("value", "n")


@query("AGG-05", f"select {_LAYOUT} as value, count(*) as n from {MATCHES} m group by 1")
def layout_facet(spark: SparkSession, d: str) -> DataFrame:
    return S.text_facets(ranked(Tables(spark, d))).where("dim = 'layout'").select("value", "n")


@query("AGG-06", f"select {_SPAN} as value, count(*) as n from {MATCHES} m group by 1")
def duration_facet(spark: SparkSession, d: str) -> DataFrame:
    return S.text_facets(ranked(Tables(spark, d))).where("dim = 'duration'").select("value", "n")


@query("TXT-09", f"select 'tag' as dim, value, n from ({_TAG_FACET}) t union all select 'layout', {_LAYOUT}, count(*) from {MATCHES} m group by 2 union all select 'duration', {_SPAN}, count(*) from {MATCHES} m group by 2 union all select 'total', null, count(*) from {MATCHES} m")
def search_result(spark: SparkSession, d: str) -> DataFrame:
    found = storage.stored(ranked(Tables(spark, d)).select("id", "user_tags", "profile_tags", "channels", "channel_layout", "duration"), "matches")
    return S.text_facets(found).unionByName(found.agg(F.count("*").alias("n")).select(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("value"), "n"))


_TERMS = "list_sort(list_distinct(list_transform(list_filter(string_split(p_name, ' '), lambda t: not list_contains(['the','a','an','of'], t)), lambda t: case when t = 'gentle' then 'quiet' when t = 'sharp' then 'bright' else t end)))"


@query("TXT-01", f"select p_partkey, case when p_size % 5 <> 0 then array_to_string({_TERMS}, ',') end as terms, case when p_size % 5 <> 0 then 'old gate' end as phrases, case when p_size % 5 <> 0 then 'rain,loud' end as excluded, case when p_size % 5 = 0 then 'duration filters have no overlap' end as error from part")
def interpretation(spark: SparkSession, d: str) -> DataFrame:
    """A table of query texts made of part names, interpreted; some contradict themselves."""
    contrary = F.when(F.col("p_size") % 5 == 0, " over 9 minutes under 2 secs").otherwise("")
    said = F.concat(F.lit("find me a "), F.col("p_name"), F.lit(' "Old gate" without rainfall -powerful'), contrary)
    i = Tables(spark, d).part.select("p_partkey", Q.interpreted(said).alias("i"))
    return i.select("p_partkey", F.array_join(F.array_sort("i.terms"), ",").alias("terms"), F.array_join("i.phrases", ",").alias("phrases"), F.array_join("i.excluded", ",").alias("excluded"), "i.error")


@query("TXT-02", "select event_id, cast(least(user_id % 40 + 10, (user_id % 7 + 1) * 60) as double) as most, cast(greatest(user_id % 3, 1) as double) as least from events")
def duration_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Bounds in several units: the tightest of each side counts."""
    n = lambda c: c.cast("string")
    u = F.col("user_id")
    said = F.concat(F.lit("click under "), n(u % 40 + 10), F.lit(" secs less than "), n(u % 7 + 1), F.lit(" minutes longer than "), n(u % 3), F.lit(".0 seconds over 1 s"))
    i = Tables(spark, d).events.select("event_id", Q.interpreted(said).alias("i"))
    return i.select("event_id", F.col("i.max_duration").alias("most"), F.col("i.min_duration").alias("least"))


@query("TXT-03", "select p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda t: not list_contains(['the','a','an','of'], t)), lambda t: case when t = 'gentle' then 'quiet' when t = 'sharp' then 'bright' else t end), ' ') as canonical from part")
def synonyms(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.split("p_name", " "), lambda t: ~t.isin(list(T.STOP_WORDS)))
    return Tables(spark, d).part.select("p_partkey", F.array_join(F.transform(kept, T.canonical), " ").alias("canonical"))


@query("TXT-04", f"select item_id, array_to_string({_TOK.format('text')}, ' ') as tokens from benchmark")
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).benchmark.select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("TXT-05", f"select doc_id, md5({_FOLD.format('lower(text)')}) as folded from documents")
def accents(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.select("doc_id", F.md5(T.deaccent(F.lower("text"))).alias("folded"))


@query("TXT-06", f"select id, len(title_tokens) + len(tag_tokens) + len(profile_tokens) + len(comment_tokens) as n from {SOUNDS} s")
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.with_tokens(sounds(Tables(spark, d))).select("id", F.size("document").cast("long").alias("n"))


#: Misspelt probes against the vocabulary of all documents.
PROBES = ("thye", "erstt", "wihch", "thandd", "heit")
_VOCABULARY = f"(select distinct unnest({_TOK.format('text')}) as word from documents)"


@query("TXT-07", f"select term, word, d as distance from (select p.term, w.word, damerau_levenshtein(p.term, w.word) as d, row_number() over (partition by p.term order by damerau_levenshtein(p.term, w.word), w.word) as n from (select unnest({list(PROBES)}) as term) p, {_VOCABULARY} w where abs(length(p.term) - length(w.word)) <= 1 and damerau_levenshtein(p.term, w.word) <= 1) x where n = 1")
def typo_correction(spark: SparkSession, d: str) -> DataFrame:
    words = Tables(spark, d).documents.select(F.explode(F.array_distinct(T.split_tokens(F.col("text")))).alias("word")).distinct()
    asked = F.explode(F.array(*map(F.lit, PROBES)))
    near = words.select("word", asked.alias("term")).where(T.may_be_near("term", "word", F.lit(1))).withColumn("d", T.distance("term", "word")).where("d <= 1")
    return near.groupBy("term").agg(F.min(F.struct("d", "word")).alias("best")).select("term", "best.word", F.col("best.d").cast("long").alias("distance"))


@query("SRT-10", f"select min(word) as word from {_VOCABULARY} w where damerau_levenshtein('heit', word) = (select min(damerau_levenshtein('heit', word)) from {_VOCABULARY} v where abs(length(word) - 4) <= 1)")
def first_candidate(spark: SparkSession, d: str) -> DataFrame:
    words = Tables(spark, d).documents.select(F.explode(F.array_distinct(T.split_tokens(F.col("text")))).alias("word")).distinct().where(F.abs(F.length("word") - 4) <= 1)
    words = storage.stored(words.withColumn("l", F.levenshtein(F.lit("heit"), F.col("word"))), "near")
    # a transposition is two edits there: the nearest word has at most twice the least distance
    least = words.agg(F.min("l").alias("least"))
    near = words.join(F.broadcast(least), F.col("l") <= 2 * F.col("least"))
    return near.agg(F.min(F.struct(T.distance(F.lit("heit"), F.col("word")).alias("d"), "word")).alias("b")).select("b.word")


@query("TXT-08", f"select id, score from {MATCHES} m")
def scores(spark: SparkSession, d: str) -> DataFrame:
    return ranked(Tables(spark, d)).select("id", "score")


# -- structured engine -----------------------------------------------------------------------------------------


FIELDS = ("tags", "caption", "name", "notes")


def _field_texts() -> dict[str, F.Column]:
    return {"tags": F.array_join(F.array("lang", "source"), " / "), "caption": F.element_at(F.split("text", "\n"), 1), "name": F.concat_ws("/", "source", F.col("doc_id").cast("string")), "notes": F.col("text")}


def asset_index(t: Tables) -> postings.Index:
    """The index of all four fields, in normal form C, built once for a table's files."""
    make = lambda: storage.spread(t.documents).select(F.col("doc_id").alias("id"), *[T.index_tokens(c).alias(f) for f, c in _field_texts().items()])
    return segments.index_of(t.spark, "assets", f"{t.folder}/documents.parquet", make, FIELDS)


def indexed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as assets, and their tag rows."""
    d = t.documents.drop("text").join(t.labels, "doc_id", "left")
    docs = d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("image").alias("kind"), F.lit(True).alias("admitted"), (F.col("source") != "src3").alias("online"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("n_chars") > 2000, "landscape").otherwise("portrait").alias("orientation"), F.lit("available").alias("availability"),
        F.col("lang").alias("format"), F.col("quality").alias("rating"), F.col("n_chars").alias("width"), F.lit(100).alias("height"), F.col("doc_id").alias("added_at"), F.coalesce("toxic", F.lit(0)).alias("suggestions"),
    )
    tags = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.array(F.struct(F.col("lang").alias("key"), F.lit("confirmed").alias("state")), F.struct(F.col("source").alias("key"), F.lit("suggested").alias("state")))).alias("t")).select("id", "t.*")
    return docs, tags


_ITOK = f"list_filter(regexp_split_to_array(translate(lower(nfc_normalize({{}})), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda t: t <> '')".replace("{{{{", "{{").replace("}}}}", "}}")
INDEXED = f"""(select d.doc_id as id, d.source as source_id, d.source || '/' || d.doc_id as path, case when n_chars > 2000 then 'landscape' else 'portrait' end as orientation, d.lang, l.quality as rating, n_chars as width, coalesce(l.toxic, 0) as suggestions,
  ' ' || array_to_string({_ITOK.format("d.lang || ' / ' || d.source")}, ' ') || ' ' as tags, ' ' || array_to_string({_ITOK.format("string_split(d.text, chr(10))[1]")}, ' ') || ' ' as caption,
  ' ' || array_to_string({_ITOK.format("d.source || '/' || d.doc_id")}, ' ') || ' ' as name, ' ' || array_to_string({_ITOK.format("d.text")}, ' ') || ' ' as notes
  from documents d left join labels l on l.doc_id = d.doc_id)"""
STRUCTURED = StructuredQuery(text='the "of the" thou* -clown', min_width=300, tags=["EN"], exclude_tags=["fr"])
_FIELDS = ("tags", "caption", "name", "notes")


def _in(pattern: str, fields: tuple[str, ...] = _FIELDS) -> str:
    return "(" + " or ".join(f"contains({f}, '{pattern}')" for f in fields) + ")"


def _all(field: str) -> str:
    return f"(contains({field}, ' the ') and contains({field}, ' of the ') and contains({field}, ' thou'))"


STRUCTURED_SQL = f"""(select *, case when {_all('tags')} then 1 when {_all('caption')} then 2 when {_all('name')} then 3 when {_all('notes')} then 4 else 5 end as tier
  from {INDEXED} i where width >= 300 and lang = 'en' and {_in(' the ')} and {_in(' of the ')} and {_in(' thou')} and not {_in(' clown ')})"""


def structured(t: Tables) -> DataFrame:
    return S.structured_matches(*indexed(t), STRUCTURED, index=asset_index(t))


@query("TXT-13", f"select id from {STRUCTURED_SQL} m")
def clauses_and_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return structured(Tables(spark, d)).select("id")


@query("TXT-14", f"select id, cast(tier as integer) as tier from {STRUCTURED_SQL} m")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    return structured(Tables(spark, d)).select("id", "tier")


@query("TXT-15", f"select id, array_to_string(list_filter([{', '.join(f'case when contains({f}, chr(32) || chr(116) || chr(104) || chr(101) || chr(32)) or contains({f}, chr(32) || chr(116) || chr(104) || chr(111) || chr(117)) then chr(39) || {chr(39)}{f}{chr(39)} end' for f in _FIELDS)}], lambda f: f is not null), ',') as hit_fields from {STRUCTURED_SQL} m".replace("chr(39) || ", ""))
def explanations(spark: SparkSession, d: str) -> DataFrame:
    return structured(Tables(spark, d)).select("id", F.array_join("hit_fields", ",").alias("hit_fields"))


@query("TXT-16", f"select 'the' as clause, count(*) filter ({_in(' the ')}) as n from {INDEXED} i union all select 'of the', count(*) filter ({_in(' of the ')}) from {INDEXED} i union all select 'thou', count(*) filter ({_in(' thou')}) from {INDEXED} i union all select 'clown', count(*) filter ({_in(' clown ')}) from {INDEXED} i")
def no_match_guidance(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return S.guidance(indexed(t)[0], STRUCTURED, asset_index(t))


@query("TXT-12", f"with x as (select doc_id, unnest({_ITOK.format('text')}) as word, generate_subscripts({_ITOK.format('text')}, 1) - 1 as pos from documents) select x.word, v.positions, v.docs, min(case when doc_id = v.first then pos end) as first_position, max(case when doc_id = v.first then pos end) as last_position, v.first as first_doc from x join (select word, count(*) as positions, count(distinct doc_id) as docs, min(doc_id) as first from x group by word) v on v.word = x.word group by x.word, v.positions, v.docs, v.first")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index's notes: of each word its occurrences and documents, and its positions in the first document."""
    p = asset_index(Tables(spark, d)).postings.where("field = 'notes'")
    of = p.groupBy("word").agg(F.sum(F.size("positions")).alias("positions"), F.count("*").alias("docs"), F.min("id").alias("first_doc"), F.min_by(F.array_min("positions"), "id").alias("first_position"), F.min_by(F.array_max("positions"), "id").alias("last_position"))
    return of.select("word", "positions", "docs", "first_position", "last_position", "first_doc")


@query("TXT-10", "select p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') as terms, 'old gate' as phrases, 'thun' as prefixes, 'loud' as excluded, '--' as ignored from part")
def clause_parser(spark: SparkSession, d: str) -> DataFrame:
    """A table of structured query texts, cut into clauses; a clause that repeats counts once."""
    said = F.concat(F.col("p_name"), F.lit(' "old  gate" thun* -loud -- '), F.element_at(F.split("p_name", " "), 1))
    c = Tables(spark, d).part.select("p_partkey", Q.clauses(said).alias("c"))
    of = lambda kind, excluded=False: F.array_join(F.array_sort(F.transform(F.filter("c.clauses", lambda x: (x["kind"] == kind) & (x["excluded"] == excluded)), lambda x: x["text"])), ",")
    return c.select("p_partkey", of("term").alias("terms"), of("phrase").alias("phrases"), of("prefix").alias("prefixes"), of("term", True).alias("excluded"), F.array_join("c.ignored", ",").alias("ignored"))


@query("TXT-11", f"select doc_id, md5(array_to_string({_ITOK.format('text')}, ' ')) as folded from documents")
def text_fold(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.select("doc_id", F.md5(F.array_join(T.index_tokens(F.col("text")), " ")).alias("folded"))


@query("TXT-17", f"select word, docs as documents from (select word, count(distinct doc_id) as docs from (select doc_id, unnest({_ITOK.format('text')}) as word from documents) x group by word) v where word <> 'erstt' and abs(length(word) - 5) <= 1 and damerau_levenshtein('erstt', word) <= 1 order by docs desc, word limit 3")
def spelling_suggestions(spark: SparkSession, d: str) -> DataFrame:
    words = asset_index(Tables(spark, d)).vocabulary.where("field = 'notes'")
    return S.suggestions(words, "erstt")


@query(
    "TXT-18",
    f"select word, count(*) as docs, count(*) as counted, (select 1 + ceil(count(*) / 512)::int from documents where doc_id % 7 = 0) as segments from (select distinct doc_id, unnest({_ITOK.format('case when doc_id % 7 = 0 then chr(122) || chr(122) || chr(99) || chr(104) || chr(32) || text else text end')}) as word from documents where doc_id % 49 <> 0) x where word in ('zzch', 'the', 'der', 'que') group by word",
)
def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """A queue of changed and deleted documents applied to the stored index by a stream, 512 ids a batch and segment; opened by another session, whose postings and vocabulary count alike.

    Its segments are the index that it began with and one for each batch, also where some were merged since.
    """
    t = Tables(spark, d)
    index = segments.branch(asset_index(t), storage.scratch(spark, "branch"))
    queue, state = storage.scratch(spark, "queue"), storage.scratch(spark, "state")
    ids = numbering.numbered(t.documents.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")), [], ["id"], "n", 0)
    ids.select("id", F.floor(F.col("n") / 512).alias("batch")).repartition("batch").write.partitionBy("batch").parquet(queue)
    stream = spark.readStream.schema("id long, batch long").option("maxFilesPerTrigger", 1).parquet(queue)
    empty = F.array().cast("array<string>")

    def make(asked: DataFrame) -> DataFrame:
        now = t.documents.where("doc_id % 49 <> 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("zzch "), F.col("text")).alias("text"))
        tokens = now.join(asked, "id", "left_semi").withColumn("notes", T.index_tokens(F.col("text")))
        return tokens.select("id", *[F.col("notes") if f == "notes" else empty.alias(f) for f in _FIELDS])

    segments.follow(stream, index.path, make, _FIELDS, state)
    again = segments.SegmentedIndex(spark.newSession(), index.path)
    asked = F.col("word").isin("zzch", "the", "der", "que") & (F.col("field") == "notes")
    counts = again.postings.where(asked).groupBy("word").agg(F.count("*").alias("docs"))
    known = again.vocabulary.where(asked).select("word", F.col("documents").alias("counted"))
    return counts.join(known, "word").withColumn("segments", F.lit(1 + again.written - index.written))


@query("TXT-20", "select * from (values ('tags', true, true), ('caption', true, true), ('name', true, true), ('notes', true, true), ('path', true, false)) t(field, searchable, by_default)")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f, c["searchable"], c["default"]) for f, c in CAPABILITIES.items()], "field string, searchable boolean, by_default boolean")


_WORDS = "list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), lambda w: case when octet_length(encode(w)) > 3 and ends_with(w, 's') and not ends_with(w, 'ss') then left(w, length(w) - 1) else w end)"


@query("TXT-21", f"select item_id, len(list_intersect(list_distinct({_WORDS.format('text')}), ['the', 'thou', 'onthe', 'of'])) as hits from benchmark order by hits desc, item_id limit 10")
def bag_of_words(spark: SparkSession, d: str) -> DataFrame:
    from lumencat.operators.evaluation import lexical_rank

    return lexical_rank(Tables(spark, d).benchmark, "the thou onthe of", "item_id", "text").limit(10)


_PLACES = ("/srv/in.png", "~/in.png", "\\\\host\\in", "File:///in", "c:\\in", "D:/in", " /in", "in/a.png", "x:", "")
_PLACE_SQL = "[" + ", ".join(f"'{p}'" for p in _PLACES) + "]"


@query(
    "TXT-22",
    f"select conv_id, turn, array_to_string(case role when 'system' then [] when 'user' then list_concat([p for p in [text, place] if p <> '' and not regexp_matches(ltrim(p), '^(/|~|\\\\\\\\|(?i:file:)|[A-Za-z]:[\\\\/])')], ['Steps: 20', 'Hires prompt: ' || role]) "
    f"else list_concat([p for p in [place] if p <> '' and not regexp_matches(ltrim(p), '^(/|~|\\\\\\\\|(?i:file:)|[A-Za-z]:[\\\\/])')], ['Steps: 20']) end, '|') as searchable from (select *, ({_PLACE_SQL})[turn % 10 + 1] as place from conversations) c",
)
def policy_text(spark: SparkSession, d: str) -> DataFrame:
    """What may be searched of each turn as generation metadata: by policy, without local paths, and without the settings that hold prompts."""
    from lumencat.operators.provenance import searchable_texts

    field = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    setting = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("turn") % 10 + 1).cast("int"))
    policy = F.when(F.col("role") == "system", "exclude").when(F.col("role") == "user", "prompts").otherwise("settings")
    text = searchable_texts(policy, F.array(field("prompt", F.col("text")), field("model", place)), F.array(setting("Steps", F.lit("20")), setting("Hires prompt", F.col("role"))))
    return Tables(spark, d).conversations.select("conv_id", "turn", F.array_join(text, "|").alias("searchable"))


_PAGE = "order by score desc, octet_length(encode(title)), title_lower, id limit 20 offset 3)"


@query("TXT-19", " union all ".join(f"select 'src {look}' as look, id, score, {kept} as kept from (select * from {MATCHES} m {where} {_PAGE} x" for look, kept, where in (("first", "false", ""), ("again", "true", ""), ("changed", "false", "where source_id <> 'src5'"))).replace("'src ", "'"))
def cached_page(spark: SparkSession, d: str) -> DataFrame:
    """A page, the same page again from the kept result, and after another session has taken a source out and counted that change, the page as it is then."""
    t, scopes = Tables(spark, d), ["src4", "src5"]
    found = ranked(t).select("id", "source_id", "title", "title_lower", "score")
    root = storage.scratch(spark, "results")
    look = lambda rows: ResultCache(spark, root).get(RANKED, scopes, S.rank_order(), lambda: rows)
    told = [("first", *look(found)), ("again", *look(found.limit(0)))]  # kept: what it would be made of is not asked
    other = spark.newSession()
    ChangeCounters(other, root).changed(other.createDataFrame([("src5",)], "scope string"))
    told.append(("changed", *look(found.where("source_id <> 'src5'"))))
    pages = [ResultCache.page(r, 3, 20).select(F.lit(name).alias("look"), "id", "score", F.lit(kept).alias("kept")) for name, r, kept in told]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("AGG-02", f"select 'orientation' as dim, orientation as value, count(*) as n from {STRUCTURED_SQL} m group by 2 union all select 'rating', coalesce(cast(rating as varchar), 'unrated'), count(*) from {STRUCTURED_SQL} m group by 2 union all select 'source', source_id, count(*) from {STRUCTURED_SQL} m group by 2 union all select 'format', lang, count(*) from {STRUCTURED_SQL} m group by 2 union all select 'needs_review', cast(suggestions > 0 as varchar), count(*) from {STRUCTURED_SQL} m group by 2")
def structured_facets(spark: SparkSession, d: str) -> DataFrame:
    dims = {"orientation": F.col("orientation"), "rating": F.coalesce(F.col("rating").cast("string"), F.lit("unrated")), "source": F.col("source_id"), "format": F.col("format"), "needs_review": (F.col("suggestions") > 0)}
    return S.facet_counts(structured(Tables(spark, d)), dims)


@query("AGG-03", f"select 'confirmed' as state, lang as tag, count(*) as n from {STRUCTURED_SQL} m group by 2 union all select * from (select 'suggested', source_id, count(*) from {STRUCTURED_SQL} m group by 2 order by 3 desc, 2 limit 50) s")
def structured_tag_facet(spark: SparkSession, d: str) -> DataFrame:
    from lumencat.operators.tags import tag_facet

    t = Tables(spark, d)
    hits = structured(t).select("id")
    rows = indexed(t)[1].withColumn("tag", F.col("key")).join(hits, "id", "left_semi")
    return tag_facet(rows, "confirmed").unionByName(tag_facet(rows, "suggested"))


@query("FLT-14", "select doc_id, case when doc_id % 11 = 0 then 'a tag is blank, too long, or both required and excluded' when doc_id % 6 = 0 or doc_id % 7 = 6 or doc_id % 7 = 0 or doc_id % 6 > doc_id % 7 then 'rating bounds' when doc_id % 5 = 0 then 'date bounds' end as rejected from documents")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """A table of structured queries, each with the reason why it is refused: a contradiction is never an empty result."""
    k = F.col("doc_id")
    q = F.struct((k % 6).alias("min_rating"), (k % 7).alias("max_rating"), F.lit(5).alias("added_after"), F.when(k % 5 == 0, 5).otherwise(6).alias("added_before"), F.array(F.lit("a_b")).alias("tags"), F.array(F.when(k % 11 == 0, "A b").otherwise("c")).alias("exclude_tags"))
    return Tables(spark, d).documents.select("doc_id", Q.rejection(q).alias("rejected"))
