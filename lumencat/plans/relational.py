"""Filters, projections, joins, aggregates, windows, orders and set operations of the catalogue, on the shared tables.

The catalogue's relations are read off the tables: documents are assets (source, path, digest of the text), labels their
reviews, orders and customers the ledger. Sides that grow with the data are joined by key and left to adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.functions.text import ascii_lower
from lumencat.operators import moves, paging
from lumencat.operators.search import structured_order
from lumencat.plans.registry import Tables, query


def assets(t: Tables, reviews: bool = True) -> DataFrame:
    """id, source, path, digest and, with reviews, the review state of each document; unknown ratings are null."""
    d = t.documents.select(F.col("doc_id").alias("id"), "source", "lang", "n_chars", F.concat_ws("/", "source", "lang", F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.md5("text").alias("digest"))
    return d.join(t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic"), "id", "left") if reviews else d


ASSETS = """(select d.doc_id as id, d.source, d.lang, d.n_chars, d.source || '/' || d.lang || '/Doc-' || d.doc_id || '.txt' as path, md5(d.text) as digest, l.quality, l.toxic
  from documents d left join labels l on l.doc_id = d.doc_id)"""


# -- filters ---------------------------------------------------------------------------------------------------


@query("FLT-01", f"select id, path from {ASSETS} a where quality is not null and toxic = 0 and source <> 'src3' and source in ('src0','src1','src3')")
def ready_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return assets(Tables(spark, d)).where("quality is not null and toxic = 0 and source <> 'src3'").where(F.col("source").isin("src0", "src1", "src3")).select("id", "path")


@query("FLT-02", "select doc_id, n_chars from documents where n_chars > 300 and n_chars < 1500")
def open_interval(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.where((F.col("n_chars") > 300) & (F.col("n_chars") < 1500)).select("doc_id", "n_chars")


@query("FLT-03", "select p_partkey, p_name from part where list_contains(string_split(lower(replace(p_name, '_', ' ')), ' '), 'red') and list_contains(string_split(lower(replace(p_name, '_', ' ')), ' '), 'ring')")
def all_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.split(F.lower(F.translate("p_name", "_", " ")), " ")
    return Tables(spark, d).part.where(F.forall(F.array(F.lit("red"), F.lit("ring")), lambda t: F.array_contains(tags, t))).select("p_partkey", "p_name")


@query("FLT-07", "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('F','P') and o_orderpriority in ('1-URGENT','2-HIGH')")
def any_of_lists(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.where(F.col("o_orderstatus").isin("F", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("FLT-08", f"select id, source, case when toxic = 1 then 'toxic' when quality is null then 'unreviewed' else 'clean' end as state from {ASSETS} a where lang = 'en' and (quality is null or toxic = 1)")
def state_filters(spark: SparkSession, d: str) -> DataFrame:
    a = assets(Tables(spark, d)).where((F.col("lang") == "en") & (F.col("quality").isNull() | (F.col("toxic") == 1)))
    return a.select("id", "source", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality").isNull(), "unreviewed").otherwise("clean").alias("state"))


@query("FLT-09", f"select id from {ASSETS} a where quality >= 1 and quality <= 1 and n_chars >= 500 and id >= 100 and id < 900")
def ranges(spark: SparkSession, d: str) -> DataFrame:
    return assets(Tables(spark, d)).where(F.col("quality").between(1, 1) & (F.col("n_chars") >= 500) & (F.col("id") >= 100) & (F.col("id") < 900)).select("id")


@query("FLT-10", "select event_id from events where instr(',' || event_type || ',' || (user_id % 3) || ',', ',click,') > 0 or instr(',' || event_type || ',' || (user_id % 3) || ',', ',2,') > 0")
def origins_any(spark: SparkSession, d: str) -> DataFrame:
    origins = F.array(F.col("event_type"), (F.col("user_id") % 3).cast("string"))
    return Tables(spark, d).events.where(F.arrays_overlap(origins, F.array(F.lit("click"), F.lit("2")))).select("event_id")


_TAGS = "(select p_partkey as id, unnest(string_split(p_name, ' ')) as tag from part)"


@query("FLT-11", f"select p_partkey, p_name from part p where exists (select 1 from {_TAGS} t where t.id = p.p_partkey and t.tag = 'blue') and not exists (select 1 from {_TAGS} t where t.id = p.p_partkey and t.tag in ('bolt', 'ring'))")
def tag_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    p = Tables(spark, d).part
    tags = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    return p.join(tags.where("tag = 'blue'"), "p_partkey", "left_semi").join(tags.where("tag in ('bolt', 'ring')"), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("FLT-12", "select source, count(*) as n from documents where source in ('src1', 'src2') group by source")
def scope_first(spark: SparkSession, d: str) -> DataFrame:
    return paging.in_scope(Tables(spark, d).documents, "source", requested=["src1", "src2", "src5"], allowed=["src2", "src1"]).groupBy("source").agg(F.count("*").alias("n"))


@query("FLT-13", f"select id, path from {ASSETS} a where contains(lower(path), 'doc-1') and toxic is null and lang in ('en', 'fr') and id % 5 <> 0 union all select id, path from {ASSETS} a where toxic is not null and id % 5 = 0 and lang in ('en', 'fr')")
def agent_filter(spark: SparkSession, d: str) -> DataFrame:
    """Two requests: untagged ones by a part of the path, and favourites among the tagged."""
    a = assets(Tables(spark, d)).withColumn("tags", F.when(F.col("toxic").isNotNull(), F.array(F.lit("seen"))).otherwise(F.array().cast("array<string>"))).withColumn("favorite", F.col("id") % 5 == 0)
    untagged = paging.agent_filter(a, text="doc-1", untagged=True, favorites=False, formats=["en", "fr"])
    return untagged.unionByName(paging.agent_filter(a, untagged=False, favorites=True, formats=["en", "fr"])).select("id", "path")


@query("FLT-15", "select page_id, not (contains(url, '..') or contains(url, chr(92)) or regexp_matches(regexp_replace(url, '^https?:', ''), ':')) as valid from pages")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).pages.select("page_id", paging.safe_path(F.regexp_replace("url", "^https?:", "")).alias("valid"))


# -- projections -----------------------------------------------------------------------------------------------


@query("PRJ-01", f"select id, case when source = 'src3' then 'offline' when quality is null then 'pending' else 'available' end as availability, cast(n_chars as integer) as width, digest from {ASSETS} a")
def summary(spark: SparkSession, d: str) -> DataFrame:
    a = assets(Tables(spark, d))
    return a.select("id", F.when(F.col("source") == "src3", "offline").when(F.col("quality").isNull(), "pending").otherwise("available").alias("availability"), F.col("n_chars").cast("int").alias("width"), "digest")


@query("PRJ-02", "select vec_id, label, len(embedding) as dims from embeddings")
def without_samples(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).embeddings.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("PRJ-03", f"select id, path, lang, n_chars from {ASSETS} a where id = 17")
def inspector(spark: SparkSession, d: str) -> DataFrame:
    return assets(Tables(spark, d), reviews=False).where("id = 17").select("id", "path", "lang", "n_chars")


@query("PRJ-04", "select c_custkey, c_name, c_mktsegment from customer")
def agent_view(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")


@query("PRJ-05", "select doc_id, 'confirmed' as state, lang as tag from documents union all select doc_id, 'suggested', source from documents")
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = F.explode(F.array(F.struct(F.lit("confirmed").alias("state"), F.col("lang").alias("tag")), F.struct(F.lit("suggested").alias("state"), F.col("source").alias("tag")))).alias("r")
    return Tables(spark, d).documents.select("doc_id", rows).select("doc_id", "r.state", "r.tag")


@query("PRJ-06", "select l_orderkey, l_linenumber, case when l_shipdate is null then 'missing' when l_quantity > 40 then 'changed' when l_discount > 0.08 then 'rate' when l_tax > 0.06 then 'bounds' when l_returnflag = 'R' then 'returned' end as stale from lineitem")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("l_shipdate").isNull(), "missing").when(F.col("l_quantity") > 40, "changed").when(F.col("l_discount") > 0.08, "rate").when(F.col("l_tax") > 0.06, "bounds").when(F.col("l_returnflag") == "R", "returned")
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", reason.alias("stale"))


# -- joins -----------------------------------------------------------------------------------------------------


@query("JN-01", "select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(b.n, 0) as orders from documents d left join labels l on l.doc_id = d.doc_id left join (select o_custkey, count(*) as n from orders group by 1) b on b.o_custkey = d.doc_id")
def left_joins(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    n = t.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n"))
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").join(n, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("n", F.lit(0).cast("long")).alias("orders"))


@query("JN-02", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def dimension_joins(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("JN-03", "select l.l_orderkey, l.l_linenumber, s.s_name from lineitem l left join supplier s on s.s_suppkey = l.l_suppkey and s.s_nationkey = l.l_partkey % 25")
def composite_left(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    on = (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("l_partkey") % 25 == F.col("s_nationkey"))
    return t.lineitem.join(t.supplier, on, "left").select("l_orderkey", "l_linenumber", "s_name")


@query("JN-04", "select c_custkey from customer c where c_mktsegment = 'BUILDING' or exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
def membership(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    listed = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    whole = t.customer.where("c_mktsegment = 'BUILDING'")
    return whole.select("c_custkey").unionByName(t.customer.where("not c_mktsegment <=> 'BUILDING'").join(listed, "c_custkey", "left_semi").select("c_custkey"))


@query("JN-05", "select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_returnflag = 'R') and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_quantity > 45)")
def semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    line = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return t.orders.join(line.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(line.where("l_quantity > 45"), "o_orderkey", "left_anti").select("o_orderkey")


@query("JN-06", "select doc_id from documents where doc_id in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)")
def match_sets(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").join(t.labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("JN-07", "select l.l_orderkey, l.l_linenumber, p.p_name from part p join lineitem l on l.l_partkey = p.p_partkey where p.p_brand = 'Brand#7' and p.p_size < 10")
def driven_by_matches(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.part.where("p_brand = 'Brand#7' and p_size < 10").join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("JN-08", f"select m.id as missing, count(*) as n, min(p.id) as first from {ASSETS} m join {ASSETS} p on p.digest = m.digest and p.id <> m.id where m.id % 2 = 0 and p.id % 2 = 1 group by m.id")
def move_candidates(spark: SparkSession, d: str) -> DataFrame:
    a = assets(Tables(spark, d), reviews=False).select("id", "digest")
    return moves.candidates(a.where("id % 2 = 0"), a.where("id % 2 = 1")).select(F.col("id").alias("missing"), "n", "first")


@query("JN-09", f"select a.id, exists (select 1 from {ASSETS} b where b.digest = a.digest and b.source = a.source and b.id <> a.id) as same_file from {ASSETS} a")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    a = assets(Tables(spark, d), reviews=False).select("id", "digest", "source")
    n = a.groupBy("digest", "source").agg(F.count("*").alias("n")).where("n > 1")
    return a.join(n, ["digest", "source"], "left").select("id", F.col("n").isNotNull().alias("same_file"))


@query("JN-10", "select p_partkey, unnest(string_split(p_name, ' ')) as tag from part")
def unnest_tags(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))


@query("JN-11", "select e.event_id, coalesce(c.c_mktsegment = 'BUILDING', false) as flagged from events e left join customer c on c.c_custkey = e.user_id")
def probe(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False)).alias("flagged"))


@query("JN-12", "select c_custkey, (select min(o_orderdate) from orders where o_custkey = c_custkey) as first_order, (select count(*) from orders where o_custkey = c_custkey) as n from customer")
def scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first_order"), F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", "first_order", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("JN-13", "select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F') as done, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O') as queued, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount = 0) as cached from orders")
def three_flags(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("done"), F.bool_or(F.col("l_linestatus") == "O").alias("queued"), F.bool_or(F.col("l_discount") == 0).alias("cached"))
    no = F.lit(False)
    return t.orders.select("o_orderkey").join(flags, "o_orderkey", "left").select("o_orderkey", *[F.coalesce(c, no).alias(c) for c in ("done", "queued", "cached")])


@query("JN-14", f"select a.id from {ASSETS} a where a.quality is null and not exists (select 1 from {ASSETS} r where r.digest = a.digest and r.quality is not null and r.id <> a.id)")
def anti_self_join(spark: SparkSession, d: str) -> DataFrame:
    a = assets(Tables(spark, d)).select("id", "digest", "quality")
    running = a.where("quality is not null").select("digest").distinct()
    return a.where("quality is null").join(running, "digest", "left_anti").select("id")


@query("JN-15", "select d.doc_id from documents d left join labels l on l.doc_id = d.doc_id where l.doc_id is null or (l.quality is distinct from 1 and l.toxic is distinct from 0)")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    one, zero = F.lit(1), F.lit(0)
    j = t.documents.select("doc_id").join(t.labels.withColumn("there", F.lit(True)), "doc_id", "left")
    return j.where(F.col("there").isNull() | (~F.equal_null("quality", one) & ~F.equal_null("toxic", zero))).select("doc_id")


@query("JN-16", "select n_nationkey, coalesce(max(s_name), 'pending') as status from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000 group by n_nationkey")
def coalesced_status(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rich = t.supplier.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("s"))
    return t.nation.select("n_nationkey").join(rich, "n_nationkey", "left").select("n_nationkey", F.coalesce("s", F.lit("pending")).alias("status"))


@query("JN-17", "select o.o_orderkey, l.l_linenumber, p.p_partkey from orders o join lineitem l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey and p.p_size = l.l_linenumber")
def four_part_key(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    on = (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") == F.col("l_linenumber"))
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, on).select("o_orderkey", "l_linenumber", "p_partkey")


@query("JN-18", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderstatus = 'P' and o_totalprice > 150000)")
def unseen(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    large = t.orders.where("o_orderstatus = 'P' and o_totalprice > 150000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_CHAIN = """with recursive up(id, spot, depth) as (
  select doc_id, doc_id, 0 from documents
  union all select up.id, cast(floor(up.spot / 2) as bigint), up.depth + 1 from up where up.spot > 0 and up.depth < 8 and not exists (select 1 from labels l where l.doc_id = up.spot)
) select id, min(spot) as origin, cast(max(depth) as integer) as depth from up group by id"""


@query("JN-19", _CHAIN)
def parent_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each asset's nearest labelled ancestor, or where the walk of eight steps ends; a parent is half the id."""
    t = Tables(spark, d)
    return paging.walk(t.documents.select(F.col("doc_id").alias("id")), t.labels.select(F.col("doc_id").alias("stop")).distinct(), lambda at: F.floor(at / 2), 8)


@query("JN-20", f"select a.id, coalesce(case when l.toxic = 1 then 'separated' when l.quality = 1 then 'reviewed' end, 'none') as mark, g.n from {ASSETS} a left join labels l on l.doc_id = a.id join (select digest, count(*) as n from {ASSETS} x group by digest having count(*) > 1) g on g.digest = a.digest")
def copies_and_marks(spark: SparkSession, d: str) -> DataFrame:
    a = assets(Tables(spark, d))
    g = a.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return a.join(g, "digest").select("id", F.when(F.col("toxic") == 1, "separated").when(F.col("quality") == 1, "reviewed").otherwise("none").alias("mark"), "n")


# -- windows, orders, pages ------------------------------------------------------------------------------------

_PAGE = f"select id, path, cast(row_number() over (order by translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), path, id) - 1 as integer) as ord from {ASSETS} a"


@query("WIN-01", f"select * from ({_PAGE}) p where ord >= 40 and ord < 60")
def numbered_page(spark: SparkSession, d: str) -> DataFrame:
    a = assets(Tables(spark, d), reviews=False).select("id", "path")
    return paging.numbered(a, [ascii_lower(F.col("path")), F.col("path"), F.col("id")], 40, 20, "ord")


@query("WIN-02", f"select digest, n, cast(sum(n) over () as bigint) as copies, count(*) over () as stacks from (select digest, count(*) as n from {ASSETS} a group by digest having count(*) > 1) g order by n desc, digest limit 10")
def grand_totals(spark: SparkSession, d: str) -> DataFrame:
    g = assets(Tables(spark, d), reviews=False).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return paging.with_totals(g.orderBy(F.desc("n"), "digest").limit(10), g.agg(F.sum("n").alias("copies"), F.count("*").alias("stacks")))


@query("SRT-01", "select c_custkey, c_name from customer order by c_acctbal desc, octet_length(encode(c_name)), lower(c_name), c_custkey limit 25")
def score_then_title(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).customer.orderBy(F.desc("c_acctbal"), F.octet_length("c_name"), F.lower("c_name"), "c_custkey").limit(25).select("c_custkey", "c_name")


_TIES = "lower(path), path, id"
_ORDERS = {
    "relevance": f"coalesce(toxic, 9) nulls last, {_TIES}", "name_asc": _TIES, "name_desc": "lower(path) desc, path desc, id", "rating_desc": f"quality desc nulls last, {_TIES}",
    "added_desc": f"id desc, {_TIES}", "added_asc": f"id, {_TIES}", "pixels_desc": f"n_chars * 100 desc nulls last, {_TIES}",
}


@query("SRT-02", " union all ".join(f"(select '{k}' as sort, id, quality from {ASSETS} a order by {o} limit 15)" for k, o in _ORDERS.items()))
def nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """The first 15 of each of the seven sorts: unknown values last in all of them, ties by folded path, path and id."""
    a = assets(Tables(spark, d)).withColumns({"tier": F.coalesce("toxic", F.lit(9)), "rating": F.col("quality"), "added_at": F.col("id"), "width": F.col("n_chars"), "height": F.lit(100)})
    pages = [a.orderBy(*structured_order(k)).limit(15).select(F.lit(k).alias("sort"), "id", "quality") for k in _ORDERS]
    return reduce(DataFrame.unionByName, pages)


@query("SRT-03", f"select id, path from ({_PAGE}) p where ord < 30")
def gallery_order(spark: SparkSession, d: str) -> DataFrame:
    return assets(Tables(spark, d), reviews=False).orderBy(ascii_lower(F.col("path")), "path", "id").limit(30).select("id", "path")


@query("SRT-04", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey")


@query("SRT-05", "select o_orderkey, o_custkey from orders where o_orderkey > 500 order by o_orderkey limit 21")
def keyset(spark: SparkSession, d: str) -> DataFrame:
    return paging.after(Tables(spark, d).orders.select("o_orderkey", "o_custkey"), "o_orderkey", 500, 20)


@query("SRT-06", "select doc_id, bytes from (select doc_id, octet_length(encode(text)) as bytes, sum(octet_length(encode(text))) over (order by doc_id rows unbounded preceding) as total from documents where doc_id >= 0 order by doc_id limit 100) t where total <= 100000")
def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = Tables(spark, d).documents.select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return paging.within_bytes(docs.where("doc_id >= 0"), [F.col("doc_id")], "bytes", 100_000, 100).select("doc_id", "bytes")


@query("SRT-07", "select d.doc_id, d.text from documents d join (select doc_id from documents order by n_chars desc, doc_id limit 20) k on k.doc_id = d.doc_id")
def late_materialisation(spark: SparkSession, d: str) -> DataFrame:
    docs = Tables(spark, d).documents
    keys = docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")
    return docs.join(keys, "doc_id").select("doc_id", "text")


@query("SRT-08", f"select digest, id, cast(row_number() over (partition by digest order by coalesce(toxic, 0), path, id) as integer) as place, count(*) over (partition by digest) as n, count(*) over (partition by digest) > 64 as truncated from {ASSETS} a qualify n > 1 and place <= 64")
def stack_members(spark: SparkSession, d: str) -> DataFrame:
    """Stacks of copies, largest first: the first 64 members in order, with the stack's size and whether members are left out."""
    a = assets(Tables(spark, d))
    w = Window.partitionBy("digest").orderBy(F.coalesce("toxic", F.lit(0)), "path", "id")
    stacks = a.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    # rows are limited before they meet: a stack of any size sends 64 a task
    first = a.withColumn("place", F.row_number().over(w)).where("place <= 64")
    return first.join(stacks, "digest").select("digest", "id", "place", "n", (F.col("n") > 64).alias("truncated")).orderBy(F.desc("n"), "digest", "place")


@query("SRT-09", "select o_orderkey, o_orderpriority from orders order by case when o_orderstatus = 'F' then 0 when o_orderstatus = 'P' then 1 else 2 end, o_orderdate, o_orderkey limit 1")
def priority_pick(spark: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return Tables(spark, d).orders.orderBy(order, "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("SRT-11", "select id, kind from (select c_custkey as id, 'customer' as kind from customer union all select s_suppkey, 'supplier' from supplier) j order by id, kind limit 30 offset 20")
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    both = t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_suppkey").cast("long").alias("id"), F.lit("supplier").alias("kind")))
    return both.orderBy("id", "kind").offset(20).limit(30)


# -- set operations --------------------------------------------------------------------------------------------


@query("SET-01", "select c_nationkey as k from customer where c_acctbal < 0 union select s_nationkey from supplier where s_acctbal < 0")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(t.supplier.where("s_acctbal < 0").select("s_nationkey")).distinct()


@query("SET-02", "select doc_id from labels where toxic = 1 union select doc_id from documents where n_chars < 200")
def union_ids(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.labels.where("toxic = 1").select("doc_id").union(t.documents.where("n_chars < 200").select("doc_id")).distinct()


@query("SET-03", "select 'page' as kind, page_id as id, length(html) as n from pages union all select 'document', doc_id, length(text) from documents")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("n")).unionByName(t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")))


@query("SET-04", "select p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'ring', 'small'])) as n from part")
def intersection_size(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).part.select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), F.array(*map(F.lit, ("red", "ring", "small"))))).cast("long").alias("n"))


@query("SET-05", "select n_name from nation where n_regionkey in (1, 2)")
def scope_intersection(spark: SparkSession, d: str) -> DataFrame:
    return paging.in_scope(Tables(spark, d).nation, "n_regionkey", [1, 2, 4], [0, 1, 2]).select("n_name")


@query("SET-06", "with s as (select distinct url as path from pages) select path from s a where not exists (select 1 from s b where b.path <> a.path and starts_with(a.path, b.path || '/'))")
def collapse_selections(spark: SparkSession, d: str) -> DataFrame:
    return paging.collapsed(Tables(spark, d).pages.select(F.col("url").alias("path")))
