"""Quality metrics of tags, captions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumencat.functions.text import plain_words, words
from lumencat.operators.storage import stored


def lexical_rank(docs: DataFrame, text: str, key: str, column: str) -> DataFrame:
    """(key, hits): documents by how many distinct query words they hold, ties by key; those with none are left out."""
    asked = sorted({w[:-1] if len(w.encode()) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in plain_words(text)})
    hits = F.size(F.array_intersect(words(F.col(column)), F.array(*map(F.lit, asked)))).cast("long")
    return docs.select(key, hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key)


def ranked_percentiles(df: DataFrame, value: str, group: list[str], ps: list[int]) -> DataFrame:
    """Of each group the value at index ceil((n - 1) * p / 100) of its sorted values, for groups of any size. Rows are dealt out by ranges of (group, value), so no task holds a whole group;
    a row's place is its place in its range plus the sizes of the group's ranges before."""
    ranged = df.where(F.col(value).isNotNull()).select(*group, value).repartitionByRange(*group, value).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sizes = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_n": F.sum("_size").over(Window.partitionBy(*group))})
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(value)))
    placed = local.join(sizes, [*group, "_part"]).withColumn("_r", F.col("_r") + F.col("_before"))
    at = lambda p: F.ceil((F.col("_n") - 1) * p / 100) + 1
    return placed.groupBy(*group).agg(*[F.max(F.when(F.col("_r") == at(p), F.col(value))).alias(f"p{p}") for p in ps])


def mentions(text_words: Column, phrase: Column) -> Column:
    """The phrase's words follow each other in the text's."""
    flat = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.contains(flat(text_words), flat(phrase))


def tag_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(judged, correct, unjudged, gold_facts, gold_found, precision, recall).

    predicted: (item, tag); gold: (item, fact, alternative). A tag outside the gold vocabulary is unjudged; a ratio with
    nothing below it is null.
    """
    vocabulary = gold.select(F.col("alternative").alias("tag")).distinct().withColumn("known", F.lit(True))
    facts = gold.groupBy("item", F.col("alternative").alias("tag")).agg(F.min("fact").alias("fact"))
    p = predicted.join(vocabulary, "tag", "left").join(facts, ["item", "tag"], "left")
    found = p.where("fact is not null").select("item", "fact").distinct().agg(F.count("*").alias("gold_found"))
    n = p.agg(F.count_if("known").alias("judged"), F.count_if(F.col("fact").isNotNull()).alias("correct"), F.count_if(F.col("known").isNull()).alias("unjudged"))
    total = gold.select("item", "fact").distinct().agg(F.count("*").alias("gold_facts"))
    one = n.join(F.broadcast(total)).join(F.broadcast(found))  # three single rows
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    return one.withColumns({"precision": ratio("correct", "judged"), "recall": ratio("gold_found", "gold_facts")})


def retrieval_summary(queries: DataFrame, k: int = 5) -> DataFrame:
    """(queries, recall, mrr, out_of_domain, out_of_domain_with_results) of queries (in_domain, size, found, first, returned).

    size: the relevant items of the pool; found: those among the first k; first: the place of the first one; returned: whether anything was
    given out. Recall's denominator is the smaller of k and size; queries of the domain with none in the pool do not count.
    """
    counted = F.col("in_domain") & (F.coalesce("size", F.lit(0)) > 0)
    mean = lambda c: F.coalesce(F.avg(F.when(counted, F.coalesce(c, F.lit(0.0)))), F.lit(0.0))
    out = ~F.col("in_domain")
    return queries.agg(
        F.count_if(counted).alias("queries"), mean(F.col("found") / F.least("size", F.lit(k))).alias("recall"), mean(1 / F.col("first")).alias("mrr"),
        F.count_if(out).alias("out_of_domain"), F.count_if(out & F.coalesce("returned", F.lit(False))).alias("out_of_domain_with_results"),
    )


def verdict(scores: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(passed, failures): the names of the checks that do not hold; an unknown value fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda n: n.isNotNull())
    return scores.select((F.size(failed) == 0).alias("passed"), failed.alias("failures"))
