"""The portable catalogue: JSON documents out and in, snapshots, legacy documents, Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOUND = "struct<id:string,source_id:string,relative_path:string,title:string,status:string,user_tags:array<string>,comment:string,favorite:boolean>"
CATALOG = f"schema string, sounds array<{SOUND}>"
SNAPSHOT = "schema string, revision bigint, entries array<struct<path:string,size:bigint,modified:bigint,digest:string>>"
LEGACY = "schema string, total_sounds bigint, sources array<struct<id:string,name:string>>, sounds array<struct<id:string,source_id:string,relative_path:string,title:string,description:string,user_tags:array<string>,comment:string,favorite:boolean>>"
SNAPSHOT_NAME = "snapshot/1"
#: A snapshot document may have so many characters.
SNAPSHOT_CHARS = 64 << 20
#: Schema versions of the catalogue and the fields that each adds: tags and status, then comments, then favourites.
VERSIONS = {1: ("id", "source_id", "relative_path", "title", "status", "user_tags"), 2: ("comment",), 3: ("favorite",)}
SCHEMA_NAMES = {n: f"portable-catalog/{n}" for n in VERSIONS}
#: What a shared copy need not tell, by option.
PRIVATE = {"comments": ("comment",), "marks": ("favorite",)}
LEGACY_NAME = "legacy-catalog/3"


def version_for(sounds: DataFrame) -> int:
    """The oldest version that holds all that the sounds have."""
    has = sounds.agg(F.bool_or(F.coalesce("favorite", F.lit(False))).alias("v3"), F.bool_or(F.coalesce("comment", F.lit("")) != "").alias("v2")).first()
    return 3 if has["v3"] else 2 if has["v2"] else 1


def write_catalog(sounds: DataFrame, path: str, version: int | None = None, redact: Sequence[str] = ()) -> None:
    """One JSON document a row, a row each sound, nulls written out: parts of any size, in id order within a file range.

    The version is the oldest that holds the content, unless given; redact names what of PRIVATE is left out.
    """
    gone = [f for r in redact for f in PRIVATE[r]]
    sounds = sounds.withColumns({f: F.lit(None).cast(sounds.schema[f].dataType) for f in gone})
    version = version or version_for(sounds)
    fields = [f for v, names in VERSIONS.items() if v <= version for f in names]
    whole = F.to_json(F.struct(F.lit(SCHEMA_NAMES[version]).alias("schema"), F.array(F.struct(*[F.col(c) for c in fields])).alias("sounds")), {"ignoreNullFields": "false"})
    sounds.repartitionByRange("id").sortWithinPartitions("id").select(whole.alias("value")).write.text(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Sounds of documents of any version; a document of another schema or with unknown fields is an error row (``problem``)."""
    raw = spark.read.text(path).select("value", F.from_json("value", CATALOG).alias("c"), F.expr("json_object_keys(value)").alias("keys"))
    problem = F.when(F.col("c.schema").isNull(), "not a catalogue").when(~F.col("c.schema").isin(list(SCHEMA_NAMES.values())), "unsupported schema").when(F.size(F.array_except("keys", F.array(F.lit("schema"), F.lit("sounds")))) > 0, "unknown field")
    return raw.select(problem.alias("problem"), F.col("c.schema").alias("schema"), F.explode_outer("c.sounds").alias("s")).select("problem", "schema", "s.*")


def preview(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(new, known, invalid) before an import: counted by (source, path)."""
    key = ["source_id", "relative_path"]
    j = incoming.join(existing.select(*key).distinct().withColumn("_known", F.lit(True)), key, "left")
    bad = F.col("problem").isNotNull() | F.col("relative_path").isNull() | F.contains("relative_path", F.lit(".."))
    return j.agg(F.count_if(~bad & F.col("_known").isNull()).alias("new"), F.count_if(~bad & F.col("_known").isNotNull()).alias("known"), F.count_if(bad).alias("invalid"))


def imported(incoming: DataFrame, existing: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Existing sounds and the valid new ones, whose sources are mapped to local ones; nothing that exists is overwritten."""
    mapped = F.create_map(*[F.lit(x) for kv in roots.items() for x in kv]) if roots else F.create_map()
    new = incoming.where("problem is null and relative_path is not null").drop("problem", "schema")
    new = new.withColumn("source_id", F.coalesce(F.element_at(mapped, F.col("source_id")), F.col("source_id")) if roots else F.col("source_id"))
    return existing.unionByName(new.join(existing.select("source_id", "relative_path"), ["source_id", "relative_path"], "left_anti").dropDuplicates(["source_id", "relative_path"]).select(*existing.columns))


def legacy(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Sounds of legacy documents (a file each, or a line each), whose stated total must be theirs."""
    d = spark.read.schema(LEGACY).option("multiLine", multi_line).json(path).where((F.col("schema") == LEGACY_NAME) & (F.col("total_sounds") == F.size("sounds")))
    return d.select(F.explode("sounds").alias("s")).select("s.id", "s.source_id", "s.relative_path", "s.title", F.lit("pending").alias("status"), F.coalesce("s.user_tags", F.array().cast("array<string>")).alias("user_tags"), F.coalesce("s.comment", F.lit("")).alias("comment"), F.coalesce("s.favorite", F.lit(False)).alias("favorite"))


def snapshot(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Entries of folder snapshots (a file each, or a line each) with ``problem``, null for those that may be trusted.

    A document of another schema or of over SNAPSHOT_CHARS characters tells its entries' paths alone; an entry without a path
    or with a size below 0 has a problem of its own.
    """
    text = spark.read.option("wholetext", multi_line).text(path)
    d = text.select(F.from_json("value", SNAPSHOT).alias("d"), F.length("value").alias("_chars"))
    whole = F.when(F.col("d.schema").isNull(), "not a snapshot").when(F.col("d.schema") != SNAPSHOT_NAME, "unsupported schema").when(F.col("_chars") > SNAPSHOT_CHARS, "too large")
    e = d.select(whole.alias("_whole"), F.col("d.revision").alias("revision"), F.explode_outer("d.entries").alias("e"))
    own = F.when(F.col("e.path").isNull(), "path").when(F.coalesce(F.col("e.size") < 0, F.lit(True)), "size")
    kept = lambda c: F.when(F.col("_whole").isNull(), F.col(f"e.{c}")).alias(c)
    return e.select("revision", F.col("e.path").alias("path"), kept("size"), kept("modified"), kept("digest"), F.coalesce("_whole", own).alias("problem"))


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", " "), ("\r", " "), ("`", "\\`"), ("*", "\\*"), ("[", "\\["), ("]", "\\]"))


def escaped(c: Column) -> Column:
    for old, new in _ESCAPES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def markdown(sounds: DataFrame) -> DataFrame:
    """(id, value): a readable section for each sound."""
    part = lambda label, c: F.concat(F.lit(f"\n\n{label}: "), c)
    value = F.concat(F.lit("## "), escaped(F.col("title")), part("Source", escaped(F.col("source_id"))), part("Relative path", escaped(F.col("relative_path"))), part("Tags", escaped(F.array_join("user_tags", ", "))), part("Comment", escaped(F.col("comment"))))
    return sounds.select("id", value.alias("value"))
