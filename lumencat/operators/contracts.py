"""Contracts of JSON documents as one column of typed errors.

A contract says of each field what it is; ``errors`` compiles it to an expression over a document's text, in Spark's variant
type, so that a field that is there and null differs from one that is not there. Every error is (code, path); a document without
one is valid. Rules over several documents are joins: ``repeated``, ``dangling`` and ``cyclic``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencat.operators.storage import stored

# The codes of errors.
INVALID, SCHEMA, LIMIT, PATH, CONFLICT, REFERENCE, KIND = "invalid_argument", "unsupported_schema", "limit_exceeded", "invalid_path", "identity_conflict", "invalid_reference", "wrong_asset_kind"
ERRORS = "array<struct<code:string,path:string>>"


@dataclass(frozen=True)
class Value:
    """A field. ``test`` gives, for the value's column, the code of what is wrong with it or null; ``kinds``: the variant kinds it may have."""

    kinds: tuple[str, ...]
    cast: str
    test: Callable[[Column], Column] | None = None
    nullable: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Items:
    """A list: of values or objects, of ``most`` at most; ``unique`` ones."""

    of: Value | Object
    most: int = 10_000
    unique: bool = False
    nullable: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Object:
    """An object with exactly these fields. ``rules``: name to (code, function of a field reader that gives whether the rule is broken)."""

    fields: dict[str, Value | Items | Object]
    rules: dict[str, tuple[str, Callable[[Callable[..., Column]], Column]]] = field(default_factory=dict)
    nullable: bool = False
    optional: bool = False


def _code(broken: Column, code: str) -> Column:
    return F.when(broken, code)


_CONTROL = r"[\x00-\x1f\x7f]"


def text(most: int, empty: bool = False, **more: bool) -> Value:
    """Text of so many bytes at most, without control characters."""
    return Value(("STRING",), "string", lambda v: F.coalesce(_code((F.lit(not empty) & (v == "")) | (F.octet_length(v) > most) | v.rlike(_CONTROL), INVALID)), **more)


def matching(pattern: str, code: str = INVALID, **more: bool) -> Value:
    return Value(("STRING",), "string", lambda v: _code(~v.rlike(f"^(?:{pattern})\\z"), code), **more)


def choice(values: Sequence[str], code: str = INVALID, **more: bool) -> Value:
    return Value(("STRING",), "string", lambda v: _code(~v.isin(list(values)), code), **more)


def whole(least: int, most: int, code: str = LIMIT, **more: bool) -> Value:
    return Value(("BIGINT", "INT", "SMALLINT", "TINYINT"), "long", lambda v: _code((v < least) | (v > most), code), **more)


def flag(**more: bool) -> Value:
    return Value(("BOOLEAN",), "boolean", **more)


def uuid(**more: bool) -> Value:
    """Lower-case and hyphenated, not all zeros."""
    return Value(("STRING",), "string", lambda v: _code(~v.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z") | v.rlike("^[0-]*$"), INVALID), **more)


def digest(**more: bool) -> Value:
    return matching("[0-9a-f]{64}", **more)


def relative_path(most: int = 4096, **more: bool) -> Value:
    """A path below a folder: no drive, no backslash, no empty, ``.`` or ``..`` part."""
    part = r"(^|/)(\.{0,2})(/|$)"
    return Value(("STRING",), "string", lambda v: _code((F.octet_length(v) > most) | v.rlike(r"[\\:\x00-\x1f\x7f]") | v.rlike(part), PATH), **more)


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _error(code: Column, path: Column) -> Column:
    """An array of one error, or of none where the code is null."""
    return F.when(code.isNotNull(), F.array(F.struct(code.alias("code"), path.alias("path")))).otherwise(F.array().cast(ERRORS)).cast(ERRORS)


def _of(v: Column, what: Value | Items | Object, path: Column) -> Column:
    """The errors of a variant that is neither absent nor null."""
    if isinstance(what, Object):
        return F.when(_kind(v) == "OBJECT", _of_object(v, what, path)).otherwise(_error(F.lit(INVALID), path))
    if isinstance(what, Items):
        each = F.try_variant_get(v, "$", "array<variant>")
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        own = F.flatten(F.transform(each, lambda x, i: F.when(_kind(x) == "VOID", _error(F.lit(INVALID), at(i))).otherwise(_of(x, what.of, at(i)))))
        plain = F.transform(each, lambda x: F.to_json(x))
        twice = _error(_code(F.size(F.array_distinct(plain)) < F.size(plain), CONFLICT) if what.unique else F.lit(None).cast("string"), path)
        fits = F.when(F.size(each) > what.most, _error(F.lit(LIMIT), path)).otherwise(F.concat(own, twice))
        return F.when(_kind(v) == "ARRAY", fits).otherwise(_error(F.lit(INVALID), path))
    value = F.try_variant_get(v, "$", what.cast)
    wrong = F.when(~_kind(v).isin(list(what.kinds)) | value.isNull(), INVALID)
    return _error(F.coalesce(wrong, what.test(value)) if what.test else wrong, path)


def _of_object(v: Column, what: Object, path: Column) -> Column:
    held = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    below = lambda name: F.concat(path, F.lit(f".{name}"))
    found = []
    for name, f in what.fields.items():
        own = F.try_variant_get(v, f"$['{name}']", "variant")
        absent = F.lit(None).cast("string") if f.optional else F.lit(INVALID)
        null = F.lit(None).cast("string") if f.nullable else F.lit(INVALID)
        found.append(F.when(own.isNull(), _error(absent, below(name))).when(F.schema_of_variant(own) == "VOID", _error(null, below(name))).otherwise(_of(own, f, below(name))))
    more = F.array_sort(F.array_except(held, F.array(*map(F.lit, what.fields))))
    unknown = F.transform(more, lambda k: F.struct(F.lit(INVALID).alias("code"), F.concat(path, F.lit("."), k).alias("path"))).cast(ERRORS)

    def read(name: str, cast: str = "string") -> Column:
        return F.try_variant_get(v, "$" + "".join(f"['{n}']" for n in name.split(".")), cast)

    rules = [_error(_code(F.coalesce(broken(read), F.lit(False)), code), below(name)) for name, (code, broken) in what.rules.items()]
    return F.concat(*found, unknown, *rules)


def errors(document: Column, contract: Object, schema: str | None = None, most_bytes: int = 16 << 20) -> Column:
    """The errors of a document's text: too long, no JSON, of another ``schema`` (its field of that name), or what the contract says; array of (code, path)."""
    v = F.try_parse_json(document)
    root = F.lit("$")
    own = _of(v, contract, root)
    if schema is not None:
        said = F.try_variant_get(v, "$.schema", "string")
        own = F.when((_kind(v) == "OBJECT") & ~said.eqNullSafe(schema), _error(F.lit(SCHEMA), F.lit("$.schema"))).otherwise(own)
    return F.when(F.octet_length(document) > most_bytes, _error(F.lit(LIMIT), root)).when(document.isNull() | v.isNull(), _error(F.lit(INVALID), root)).otherwise(own)


def repeated(rows: DataFrame, keys: Sequence[str], code: str = CONFLICT) -> DataFrame:
    """(keys, code) of keys that several rows have."""
    return rows.groupBy(*keys).count().where("count > 1").select(*keys, F.lit(code).alias("code"))


def dangling(rows: DataFrame, key: str, reference: str, targets: DataFrame, target: str, code: str = REFERENCE) -> DataFrame:
    """(key, code) of rows whose reference, where they have one, is no target's."""
    asked = rows.where(F.col(reference).isNotNull()).select(key, reference)
    return asked.join(targets.select(F.col(target).alias(reference)).distinct(), reference, "left_anti").select(key, F.lit(code).alias("code"))


def cyclic(rows: DataFrame, key: str, parent: str, code: str = REFERENCE) -> DataFrame:
    """(key, code) of rows whose chain of parents never ends. Each round follows twice as many parents as the one before."""
    d = stored(rows.where(F.col(parent).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(parent).alias("p")), "parents")
    left = d.count()
    rounds = 0
    while left and 1 << rounds <= left:  # a chain of more steps than there are rows goes round
        d = stored(d.join(d.select(F.col("k").alias("p"), F.col("p").alias("q")), "p").select("k", F.col("q").alias("p")), "parents")
        left_now, rounds = d.count(), rounds + 1
        if left_now == 0:
            break
        left = max(left, left_now)
    return d.select(F.col("k").alias(key), F.lit(code).alias("code"))
