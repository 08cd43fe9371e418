"""Duplicates, tags, counters, time series, vectors, metrics and scalar functions on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencat.functions import text as T
from lumencat.operators import evaluation as E
from lumencat.operators import contracts, numbering, scalars, tags, timeseries, vectors
from lumencat.plans.registry import Tables, query
from lumencat.plans.relational import ASSETS, assets

# -- aggregates ------------------------------------------------------------------------------------------------


@query("AGG-07", "select tag, n, true as truncated from (select min(word) as tag, count(*) as n, lower(word) as key from (select unnest(string_split(case when p_partkey % 2 = 0 then upper(p_name) else p_name end, ' ')) as word from part) t group by lower(word) order by n desc, key limit 10) v")
def tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent tags, told to be not all."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return tags.vocabulary(Tables(spark, d).part.select(F.explode(F.split(name, " ")).alias("tag")), "tag", 10)


@query("AGG-08", "select o_custkey, count(*) filter (o_orderstatus = 'F') as failed, count(*) filter (o_orderstatus = 'P') as pending, count(*) filter (o_totalprice > 100000) as large from orders group by o_custkey")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_totalprice") > 100_000).alias("large"))


@query("AGG-09", "select l_returnflag, count(*) filter (l_discount > 0.05) as discounted, round(sum(case when l_linestatus = 'O' then l_extendedprice else 0 end), 2) as open_value from lineitem group by l_returnflag")
def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(0)), 2).alias("open_value"))


@query("AGG-10", "select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def counts_by_state(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("AGG-11", f"select digest, count(*) as n, count(*) filter (toxic is distinct from 1) as shown, count(*) filter (quality is not distinct from 1) as reviewed from {ASSETS} a group by digest having count(*) > 1")
def duplicate_stacks(spark: SparkSession, d: str) -> DataFrame:
    from lumencat.operators.dedup import stacks

    return stacks(assets(Tables(spark, d)), "digest", shown=~F.equal_null("toxic", F.lit(1)), reviewed=F.equal_null("quality", F.lit(1)))


@query("AGG-12", "select user_id, min(ts) as first_seen from events group by user_id")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).events.groupBy("user_id").agg(F.min("ts").alias("first_seen"))


@query("AGG-13", "select o_custkey, case when max(o_orderpriority = '1-URGENT') then 'mixed' else 'plain' end as mode from orders group by o_custkey")
def mode_label(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.groupBy("o_custkey").agg(F.when(F.bool_or(F.col("o_orderpriority") == "1-URGENT"), "mixed").otherwise("plain").alias("mode"))


@query("AGG-14", "select distinct source, lang from documents")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.select("source", "lang").distinct()


@query("AGG-15", "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda t: t || ':' || p_size), ',') as rebuilt from part")
def rebuilt_array(spark: SparkSession, d: str) -> DataFrame:
    entries = F.transform(F.split("p_name", " "), lambda t: F.struct(t.alias("name")))
    done = F.transform(entries, lambda e: e.withField("size", F.col("p_size")))
    return Tables(spark, d).part.select("p_partkey", F.array_join(F.transform(done, lambda e: F.concat(e["name"], F.lit(":"), e["size"].cast("string"))), ",").alias("rebuilt"))


@query("AGG-16", "select count(*) as n_rows, cast(sum(1024 + octet_length(encode(url))) as bigint) as bytes from pages")
def budget(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).pages.agg(F.count("*").alias("n_rows"), F.sum(1024 + F.octet_length("url")).alias("bytes"))


_FRAMES = "(select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)"


def frames(t: Tables) -> DataFrame:
    """Each user's event values in order of time, as a signal's frames."""
    return timeseries.numbered_frames(t.events, "user_id", ["ts", "event_id"]).select("user_id", "frame", "value")


@query("AGG-17", "select user_id, max(abs(value)) as peak, round(sqrt(avg(value * value)), 6) as rms from events group by user_id")
def signal_levels(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.levels(Tables(spark, d).events, ["user_id"], "value").withColumn("rms", F.round("rms", 6)).select("user_id", "peak", "rms")


@query("AGG-18", f"select user_id, frame // 16 as bucket, min(value) as low, max(value) as high, round(sqrt(avg(value * value)), 6) as rms from {_FRAMES} f group by 1, 2")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.buckets(frames(Tables(spark, d)), ["user_id"], 16).select("user_id", "bucket", "low", "high", F.round("rms", 6).alias("rms"))


@query("AGG-19", "select label, case when max(abs(x)) < 0.2 then 'none' when min(abs(x)) > 0.0001 then 'binary' else 'partial' end as alpha from (select label, unnest(embedding) as x from embeddings) e group by label")
def alpha_class(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).embeddings.select("label", F.explode("embedding").alias("x"))
    return e.groupBy("label").agg(F.max(F.abs("x")).alias("hi"), F.min(F.abs("x")).alias("lo")).select("label", F.when(F.col("hi") < 0.2, "none").when(F.col("lo") > 0.0001, "binary").otherwise("partial").alias("alpha"))


_PCT = "max(case when r = ceil((n - 1) * {p} / 100.0) + 1 then value end)"


@query("AGG-20", f"select event_type, {_PCT.format(p=50)} as p50, {_PCT.format(p=95)} as p95 from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null) e group by event_type")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return E.ranked_percentiles(Tables(spark, d).events, "value", ["event_type"], [50, 95])


_PREDICTED = "(select doc_id as item, unnest([source, lang]) as tag from documents)"
_GOLD = "(select doc_id as item, 'language' as fact, lang as alternative from documents where doc_id % 3 <> 0 union all select doc_id, 'place', 'src' || (doc_id % 20) from documents where doc_id % 4 = 0)"


@query(
    "AGG-21",
    f"""with p as (select p.item, p.tag, exists (select 1 from {_GOLD} v where v.alternative = p.tag) as known, (select min(fact) from {_GOLD} g where g.item = p.item and g.alternative = p.tag) as fact from {_PREDICTED} p)
  select count(*) filter (known) as judged, count(fact) as correct, count(*) filter (not known) as unjudged, (select count(*) from (select distinct item, fact from {_GOLD} g) x) as gold_facts,
    count(distinct case when fact is not null then item || fact end) as gold_found, count(fact) / nullif(count(*) filter (known), 0) as precision, count(distinct case when fact is not null then item || fact end) / (select count(*) from (select distinct item, fact from {_GOLD} g) x) as recall from p""",
)
def tag_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = Tables(spark, d).documents
    predicted = docs.select(F.col("doc_id").alias("item"), F.explode(F.array("source", "lang")).alias("tag"))
    gold = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("item"), F.lit("language").alias("fact"), F.col("lang").alias("alternative"))
    place = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("item"), F.lit("place").alias("fact"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("alternative"))
    return E.tag_scores(predicted, gold.unionByName(place))


_FLAT = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ' ') || ' '"


@query("AGG-22", f"select round(avg(case when contains(w, ' of the ') then 1.0 else 0 end), 6) as covered, round(avg(case when contains(w, ' stupid ') or contains(w, ' clown ') then 1.0 else 0 end), 6) as errors from (select {_FLAT} as w from documents) x")
def caption_quality(spark: SparkSession, d: str) -> DataFrame:
    w = T.split_tokens(F.col("text"))
    has = lambda *p: E.mentions(w, F.array(*map(F.lit, p)))
    return Tables(spark, d).documents.agg(F.round(F.avg(has("of", "the").cast("double")), 6).alias("covered"), F.round(F.avg((has("stupid") | has("clown")).cast("double")), 6).alias("errors"))


_NEAR = """(select q.vec_id as query, v.vec_id as item, q.label as ql, v.label as vl, list_inner_product(q.embedding, v.embedding) as similarity, row_number() over (partition by q.vec_id order by list_inner_product(q.embedding, v.embedding) desc, v.vec_id) as rank
  from (select * from embeddings where vec_id % 20 = 0) q, embeddings v where v.vec_id <> q.vec_id)"""


@query(
    "AGG-23",
    f"select count(*) filter (ql < 8) as queries, round(avg(found / least(size, 5)) filter (ql < 8), 6) as recall, round(avg(1.0 / first) filter (ql < 8), 6) as mrr, count(*) filter (ql >= 8) as out_of_domain, count(*) filter (ql >= 8 and best >= 0.4) as out_of_domain_with_results "
    f"from (select query, any_value(ql) as ql, max(similarity) as best, count(*) filter (rank <= 5 and ql = vl) as found, count(*) filter (ql = vl) as size, min(case when ql = vl then rank end) as first from {_NEAR} n group by query) x",
)
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall and first hit of stated queries, from sums over blocks of items: no ranking of all items is ever laid out. Queries of two labels are out of the domain: for them nothing should be given out."""
    e = Tables(spark, d).embeddings
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("ql"))
    items = e.select(F.col("vec_id").alias("item"), "embedding", F.col("label").alias("vl"))
    s = vectors.label_retrieval(asked, items, 5)
    given = vectors.ranking(asked, items.select("item", "embedding"), 1, own=False).where("similarity >= 0.4").select("query", F.lit(True).alias("returned"))
    each = asked.select("query", (F.col("ql") < 8).alias("in_domain")).join(s, "query", "left").join(given, "query", "left")
    return E.retrieval_summary(each, 5).withColumns({c: F.round(c, 6) for c in ("recall", "mrr")})


@query("AGG-24", "select n > 100 and toxic < 0.01 as passed, array_to_string(list_filter([case when not n > 100 then 'size' end, case when not toxic < 0.01 then 'toxic' end, case when not quality > 0.5 then 'quality' end], lambda f: f is not null), ',') as failures from (select count(*) as n, avg(toxic) as toxic, avg(quality) as quality from labels) l")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    s = Tables(spark, d).labels.agg(F.count("*").alias("n"), F.avg("toxic").alias("toxic"), F.avg("quality").alias("quality"))
    v = E.verdict(s, {"size": F.col("n") > 100, "toxic": F.col("toxic") < 0.01, "quality": F.col("quality") > 0.5})
    return v.select("passed", F.array_join("failures", ",").alias("failures"))


@query("AGG-25", "select count(*) as scanned, count(*) filter (l_tax = 0) as failed, (select string_agg(l_orderkey || '/' || l_linenumber, ',' order by l_orderkey, l_linenumber) from (select * from lineitem where l_tax = 0 order by l_orderkey, l_linenumber limit 50) e) as errors from lineitem")
def scan_progress(spark: SparkSession, d: str) -> DataFrame:
    """Counters beside the first 50 errors: a top-k, so no list of all errors is ever built."""
    line = Tables(spark, d).lineitem
    errors = line.where("l_tax = 0").orderBy("l_orderkey", "l_linenumber").limit(50).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda e: F.concat_ws("/", e["l_orderkey"].cast("string"), e["l_linenumber"].cast("string"))), ",").alias("errors"))
    return line.agg(F.count("*").alias("scanned"), F.count_if(F.col("l_tax") == 0).alias("failed")).join(F.broadcast(errors))


@query("AGG-26", "select max(n) as total, count(*) as sampled, count(*) filter (o_orderstatus = 'F') as matched, count(*) filter (o_orderstatus = 'O') as changed, count(*) filter (o_orderstatus = 'P') as unreadable from (select o_orderstatus, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders) o where i % cast(ceil(n / 100) as bigint) = 0")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """Evenly spaced files of a source looked at again: the same content, another, or none that can be read."""
    state = F.when(F.col("o_orderstatus") == "F", F.lit("same")).when(F.col("o_orderstatus") == "O", F.lit("other"))
    seen = scalars.evenly_spaced(Tables(spark, d).orders.withColumn("digest", F.lit("same")).withColumn("now", state), "o_orderkey", 100)
    return scalars.relink_counts(seen, "digest", "now")


# -- time series -----------------------------------------------------------------------------------------------


@query("TS-01", f"select user_id, frame // b as bucket, min(value) as low, max(value) as high from (select *, cast(pow(2, greatest(0, ceil(log2((n + 1) / 32.0)))) as bigint) as b from (select *, count(*) over (partition by user_id) as n from {_FRAMES} f) g) h group by 1, 2")
def overview(spark: SparkSession, d: str) -> DataFrame:
    """At most 32 buckets of a power of two frames for each user."""
    return timeseries.overview(frames(Tables(spark, d)), ["user_id"], 32)


_CHANNELS = "(select user_id, channel, value, row_number() over (partition by user_id, channel order by ts, event_id) - 1 as frame from (select *, event_id % 2 as channel from events) e)"
#: A base of 4 frames, doubled for signals that would have over 8 buckets.
_BASE = f"(select *, cast(4 * pow(2, greatest(0, ceil(log2(ceil(n / 4.0) / 8.0)))) as bigint) as base from (select *, count(*) over (partition by user_id, channel) as n from {_CHANNELS} c) b)"
_P0 = f"(select user_id, channel, frame // base as bucket, min(value) as low, max(value) as high, sqrt(avg(value * value)) as rms from {_BASE} f group by 1, 2, 3)"
_P1 = f"(select user_id, channel, bucket // 4 as bucket, min(low) as low, max(high) as high, sqrt(avg(rms * rms)) as rms from {_P0} p group by 1, 2, 3)"


def channels(t: Tables) -> DataFrame:
    """Each user's events as two channels of frames."""
    e = t.events.withColumn("channel", F.col("event_id") % 2)
    return numbering.numbered(e, ["user_id", "channel"], ["ts", "event_id"], "frame", 0).select("user_id", "channel", "frame", "value")


@query("TS-02", f"select 0 as level, user_id, channel, bucket, low, high, round(rms, 6) as rms from {_P0} p union all select 1, user_id, channel, bucket, low, high, round(rms, 6) from {_P1} p where (user_id, channel) in (select (user_id, channel) from {_P0} x group by user_id, channel having count(*) > 4) union all select 2, user_id, channel, bucket // 4, min(low), max(high), round(sqrt(avg(rms * rms)), 6) from {_P1} q where (user_id, channel) in (select (user_id, channel) from {_P1} x group by user_id, channel having count(*) > 4) group by 2, 3, 4")
def pyramid(spark: SparkSession, d: str) -> DataFrame:
    """Levels of each channel; the base grows until a signal has at most 8 buckets (65,536 in the operator's default)."""
    return timeseries.pyramid(channels(Tables(spark, d)), ["user_id", "channel"], 4, levels=3, most=8).withColumn("rms", F.round("rms", 6))


_B0 = f"(select user_id, frame // 8 as bucket, min(value) as low, max(value) as high, sqrt(avg(value * value)) as rms from {_FRAMES} f group by 1, 2)"
_B1 = f"(select user_id, bucket // 4 as bucket, min(low) as low, max(high) as high, sqrt(avg(rms * rms)) as rms from {_B0} p where user_id in (select user_id from {_B0} x group by 1 having count(*) > 4) group by 1, 2)"


@query("TS-03", f"select user_id, 1 as level, i as point, min(low) as low, max(high) as high from (select user_id, bucket, low, high, n, unnest(range(0, 2)) as i from (select *, count(*) over (partition by user_id) as n from (select * from {_B1} p where bucket >= 0 and bucket < 32) w) g where n > 2) x where bucket >= floor(i * n / 2.0) and bucket < ceil((i + 1) * n / 2.0) group by 1, 3")
def window(spark: SparkSession, d: str) -> DataFrame:
    """Frames 0 to 1,023 at 32 points: the level whose buckets are as long as a point, brought to 2 points that overlap at their edges."""
    return timeseries.window(timeseries.pyramid(frames(Tables(spark, d)), ["user_id"], 8, levels=3), ["user_id"], 0, 1024, points=32, base=8, levels=3, show=2).select("user_id", "level", "point", "low", "high")


@query("TS-04", "select event_id, user_id * 100 / 48000.0 as start_s, (user_id * 100 + 480) / 48000.0 as end_s, value > 0 and value * 100 < 48000 as valid from events")
def region(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("user_id") * 100
    return Tables(spark, d).events.select("event_id", timeseries.seconds(start, F.lit(48000)).alias("start_s"), timeseries.seconds(start + 480, F.lit(48000)).alias("end_s"), timeseries.valid_region(F.lit(0), F.col("value") * 100, F.lit(48000)).alias("valid"))


# -- vectors ---------------------------------------------------------------------------------------------------


@query("VEC-01", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 5) as norm from embeddings")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    n = vectors.normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    return Tables(spark, d).embeddings.select("vec_id", F.round(vectors.norm(n), 5).alias("norm"))


# vectors of many lengths in three spaces, some without a direction; compared by cosine
_VECTORS = "(select vec_id, label, vec_id % 3 as space, list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id % 7)) as v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) * (1 + vec_id % 7) as size from embeddings where vec_id % 50 not in (7, 9, 11))"


def scaled_vectors(t: Tables) -> DataFrame:
    """Embeddings of many lengths, in three spaces; some are null, zero or not finite."""
    i = F.col("vec_id")
    odd = F.when(i % 50 == 7, F.lit(None).cast("array<double>")).when(i % 50 == 9, F.transform("embedding", lambda x: F.lit(0.0))).when(i % 50 == 11, F.transform("embedding", lambda x: F.lit(float("nan"))))
    vector = F.when((i % 50).isin(7, 9, 11), odd).otherwise(F.transform("embedding", lambda x: x.cast("double") * (1 + i % 7)))
    return t.embeddings.select("vec_id", "label", (i % 3).alias("space"), vector.alias("v"))


@query(
    "VEC-02",
    f"select query, item, rank from (select query, item, cast(rank as integer) as rank, similarity from (select q.vec_id as query, i.vec_id as item, list_inner_product(q.v, i.v) / (q.size * i.size) as similarity, row_number() over (partition by q.vec_id order by list_inner_product(q.v, i.v) / (q.size * i.size) desc, i.vec_id) as rank "
    f"from (select * from {_VECTORS} a where vec_id % 20 = 0) q join {_VECTORS} i on i.space = q.space) n) x where rank <= 10 and similarity >= 0.2",
)
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The nearest by cosine within a space, whatever the vectors' lengths; what has no direction is no one's neighbour."""
    e = scaled_vectors(Tables(spark, d))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q"), "space")
    return vectors.top_k(asked, e.select(F.col("vec_id").alias("item"), F.col("v").alias("embedding"), "space"), 10, 0.2, space="space").select("query", "item", "rank")


@query("VEC-03", f"with n as (select * from (select query, ql, vl, rank, similarity from (select q.vec_id as query, q.label as ql, v.label as vl, list_inner_product(q.embedding, v.embedding) as similarity, row_number() over (partition by q.vec_id order by list_inner_product(q.embedding, v.embedding) desc, v.vec_id) as rank from (select * from embeddings where vec_id % 20 = 0) q, embeddings v where v.vec_id <> q.vec_id) y) z where rank <= 5), c as (select c / 100.0 as cutoff, count(*) filter (ql = vl and similarity >= c / 100.0) as kept, count(*) filter (ql = vl) as uncut from n, range(0, 100) r(c) group by c) select cast(max(cutoff) as double) as cutoff from c where kept >= 0.95 * uncut")
def tuned_cutoff(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).embeddings
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("ql"))
    near = vectors.ranking(asked, e.select(F.col("vec_id").alias("item"), "embedding"), 5, own=False).join(asked.select("query", "ql"), "query").join(e.select(F.col("vec_id").alias("item"), "label"), "item")
    return vectors.cutoff(near.withColumn("hit", F.col("ql") == F.col("label")), 0.95)


@query("VEC-04", "select doc_id, md5(array_to_string(list_filter([string_split(text, chr(10))[1], lang, source], lambda p: p is not null and p <> ''), ' | ')) as assembled, 'space/' || lang as space from documents")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.select("doc_id", F.md5(vectors.embedding_text(F.element_at(F.split("text", "\n"), 1), F.col("lang"), F.col("source"))).alias("assembled"), F.concat(F.lit("space/"), F.col("lang")).alias("space"))


# -- scalar functions ------------------------------------------------------------------------------------------


@query("SCL-01", "select page_id, case when length(trim(regexp_replace(replace(url, '_', ' '), '\\s+', ' ', 'g'))) <= 64 then trim(regexp_replace(replace(url, '_', ' '), '\\s+', ' ', 'g')) end as tag, lower(url) as key, octet_length(encode(url)) as bytes, regexp_matches(url, '^https?://') as web from pages")
def strings(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).pages.select("page_id", T.display_tag(F.col("url")).alias("tag"), T.tag_key(F.col("url")).alias("key"), F.octet_length("url").cast("long").alias("bytes"), F.col("url").rlike("^https?://").alias("web"))


@query("SCL-02", "select vec_id, len(list_distinct(list_transform(embedding, lambda x: round(x, 1)))) as distinct_values, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)), 4) as dot from embeddings")
def arrays(spark: SparkSession, d: str) -> DataFrame:
    e = Tables(spark, d).embeddings
    return e.select("vec_id", F.size(F.array_distinct(F.transform("embedding", lambda x: F.round(x, 1)))).cast("long").alias("distinct_values"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("dot"))


@query("SCL-03", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":null}' as patched from events")
def json_functions(spark: SparkSession, d: str) -> DataFrame:
    j = F.from_json("props", "k int")
    return Tables(spark, d).events.select("event_id", j["k"].alias("k"), F.to_json(F.struct(j["k"].alias("k"), F.lit(None).cast("string").alias("z")), {"ignoreNullFields": "false"}).alias("patched"))


@query("SCL-04", "select l_orderkey, l_linenumber, (cast(floor(l_extendedprice) as bigint) * 48000 + 22050) // 44100 as frames, gcd(cast(l_quantity as bigint), l_partkey + 1) as aspect, least(640, greatest(1, (2 * 480 * cast(l_quantity as bigint) + 50) // 100)) as fit from lineitem")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity").cast("long"), F.col("l_extendedprice").cast("long")
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", scalars.rescaled(p, 44100, 48000).alias("frames"), scalars.gcd(q, F.col("l_partkey") + 1, 64).alias("aspect"), scalars.fit_inside(q, F.lit(50), 480, 640).alias("fit"))


@query(
    "SCL-05",
    "select user_id, case when peak < 0.0001 or rms < 0.0001 then 'silent' when rms < 0.01 then 'quiet' when rms > 20 then 'loud' else 'moderate level' end as texture, case when peak / greatest(rms, 0.00001) > 6 then 'pronounced peaks' else 'a relatively even level' end as envelope, case when n / 10.0 < 3 then 'short' when n / 10.0 > 30 then 'long' else 'medium duration' end as duration, "
    "case user_id % 9 when 1 then 'mono' when 2 then 'stereo' when 6 then '5.1 surround' when 8 then '7.1 surround' else 'multichannel' end as layout from (select user_id, max(abs(value)) as peak, sqrt(avg(value * value)) as rms, count(*) as n from events group by 1) s",
)
def classification(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a sound: classes of its level, its peaks, its duration and its channels."""
    e = Tables(spark, d).events
    s = timeseries.levels(e, ["user_id"], "value").join(e.groupBy("user_id").agg((F.count("*") / 10).alias("seconds")), "user_id")
    return s.select("user_id", scalars.texture(F.col("peak"), F.col("rms"), loud=20).alias("texture"), scalars.envelope(F.col("peak"), F.col("rms")).alias("envelope"), scalars.duration_class(F.col("seconds")).alias("duration"), scalars.layout_class(F.col("user_id") % 9).alias("layout"))


@query("SCL-06", "select o_orderkey, cast(epoch(o_orderdate) as bigint) as seconds, cast(epoch(o_orderdate) as bigint) + 3600 < 800000000 as expired from orders")
def seconds(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return Tables(spark, d).orders.select("o_orderkey", s.alias("seconds"), (s + 3600 < 800_000_000).alias("expired"))


@query("SCL-07", "select doc_id, sha256(text) as digest, sha256(source || chr(10) || lang) as selection from documents")
def digests(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.concat_ws("\n", "source", "lang"), 256).alias("selection"))


@query("SCL-08", "select d.doc_id, coalesce(case when doc_id % 5 = 0 then 'user' end, case when doc_id % 2 = 0 then lang end, case when doc_id % 3 = 0 then source end, 'parent') as value, case when doc_id % 5 = 0 then 'user' when doc_id % 2 = 0 or doc_id % 3 = 0 then 'imported' else 'inherited' end as origin, doc_id % 6 = 0 and lang <> source as conflicting from documents d")
def precedence(spark: SparkSession, d: str) -> DataFrame:
    from lumencat.operators.provenance import resolve_field

    k = F.col("doc_id")
    r = resolve_field(F.when(k % 5 == 0, F.lit("user")), F.array(F.when(k % 2 == 0, F.col("lang")), F.when(k % 3 == 0, F.col("source"))), F.lit("parent"))
    return Tables(spark, d).documents.select("doc_id", r.alias("r")).select("doc_id", "r.value", "r.origin", "r.conflicting")


@query("SCL-09", "select c_custkey, case when false then c_name end as c_name, c_mktsegment, 'c_name' as redacted from customer")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    from lumencat.operators.provenance import redacted

    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")
    return redacted(c, {"c_name": False, "c_mktsegment": True}).withColumn("redacted", F.array_join("redacted", ","))


# a document is broken in one way, by its id; the SQL says what each way is called and where it is
_BREAKS = {
    1: ("invalid_argument", "$.id"), 2: ("limit_exceeded", "$.profile.width"), 3: ("limit_exceeded", "$.profile.pixels"), 4: ("invalid_path", "$.path"), 5: ("invalid_argument", "$.profile"),
    6: ("identity_conflict", "$.tags"), 7: ("invalid_argument", "$.tags[1]"), 8: ("unsupported_schema", "$.schema"), 9: ("invalid_argument", "$.extra"), 10: ("invalid_argument", "$.recipes[0].kind"), 11: ("invalid_argument", "$"),
}
_BROKEN = "[" + ", ".join(f"{{'code': '{c}', 'path': '{p}'}}" for c, p in _BREAKS.values()) + "]"
_PARENT = "case when doc_id % 20 = 13 then doc_id when doc_id % 20 = 14 then -1 when doc_id % 20 = 15 then doc_id + 20 when doc_id % 20 > 16 then doc_id - 1 end"


@query(
    "SCL-10",
    f"select b.code, b.path, count(*) as n from (select ({_BROKEN})[doc_id % 20] as b from documents where doc_id % 20 between 1 and 11) x group by all "
    f"union all select 'invalid_reference', 'dangling', count(*) from (select {_PARENT} as parent from documents) d where parent is not null and parent not in (select doc_id from documents) "
    f"union all select 'invalid_reference', 'cyclic', count(*) from documents where doc_id % 20 = 13 union all select 'identity_conflict', 'repeated', count(*) from (select md5(text) from documents group by 1 having count(*) > 1) r",
)
def contract_errors(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON against a contract: what is wrong, where, how often; and the rules over all of them: references that lead nowhere or in a circle, identities given twice."""
    c = contracts
    contract = c.Object(
        {
            "schema": c.text(32), "id": c.uuid(), "digest": c.digest(), "path": c.relative_path(), "parent": c.whole(-1, 1 << 50, nullable=True),
            "profile": c.Object({"width": c.whole(1, 1000), "height": c.whole(1, 1000), "alpha": c.flag()}, {"pixels": (c.LIMIT, lambda read: read("width", "long") * read("height", "long") > 500_000)}),
            "tags": c.Items(c.text(16), most=8, unique=True), "recipes": c.Items(c.Object({"kind": c.choice(["crop", "turn"]), "by": c.whole(0, 360, nullable=True)})),
        }
    )
    k = F.col("doc_id") % 20
    if_ = lambda n, broken, good: F.when(k == n, broken).otherwise(good)
    tail = F.lpad(F.conv(F.col("doc_id").cast("string"), 10, 16), 12, "0")
    name = F.lower(F.concat(F.lit("0b5c0a8e-0000-4000-8000-"), tail))
    parent = F.when(k == 13, F.col("doc_id")).when(k == 14, -1).when(k == 15, F.col("doc_id") + 20).when(k > 16, F.col("doc_id") - 1)
    sides = F.struct(F.when(k == 2, 1001).when(k == 3, 900).otherwise(40).alias("width"), if_(3, 900, 50).alias("height"), F.lit(True).alias("alpha"))
    tags = F.when(k == 6, F.array("lang", "lang")).when(k == 7, F.array(F.col("lang"), F.lit(""))).otherwise(F.array("lang", "source"))
    recipes = F.array(F.struct(if_(10, "blur", "crop").alias("kind"), F.lit(None).cast("int").alias("by")))
    fields = [if_(8, "image/9", "image/1").alias("schema"), if_(1, F.upper(name), name).alias("id"), F.sha2("text", 256).alias("digest"), if_(4, F.concat(F.lit("../"), "source"), F.col("source")).alias("path"), parent.alias("parent")]
    whole = F.struct(*fields, if_(5, F.lit(None), sides).alias("profile"), tags.alias("tags"), recipes.alias("recipes"), F.when(k == 9, 1).alias("extra"))
    said = F.to_json(whole, {"ignoreNullFields": "false"})
    said = F.when(k == 9, said).otherwise(F.regexp_replace(said, ',"extra":null', ""))
    docs = Tables(spark, d).documents
    rows = docs.select("doc_id", parent.alias("parent"), F.md5("text").alias("same"), F.when(k == 11, F.concat(F.lit("{"), said)).otherwise(said).alias("said"))
    own = rows.select(F.explode(contracts.errors(F.col("said"), contract, "image/1")).alias("e")).select("e.*")
    counted = lambda df, path: df.groupBy("code").agg(F.count("*").alias("n")).select("code", F.lit(path).alias("path"), "n")
    over = counted(c.dangling(rows, "doc_id", "parent", rows, "doc_id"), "dangling").unionByName(counted(c.cyclic(rows, "doc_id", "parent"), "cyclic")).unionByName(counted(c.repeated(rows, ["same"]), "repeated"))
    return own.groupBy("code", "path").agg(F.count("*").alias("n")).unionByName(over)
