"""Provenance: field precedence, inheritance, redaction and searchable text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencat.operators.actions import Folded, State, compare_and_swap, folded


def local_path(value: Column) -> Column:
    """Whether a value names a place on some machine: an absolute or home path, a share, a drive, a file address."""
    return F.trim(value).rlike(r"^(/|~|\\\\|(?i:file:)|[A-Za-z]:[\\/])")


def prompt_setting(key: Column) -> Column:
    """Whether a setting's name says that it holds prompt text."""
    return F.contains(F.lower(key), F.lit("prompt"))


def searchable_texts(policy: Column, fields: Column, settings: Column) -> Column:
    """What may be searched of an asset's metadata, by policy: exclude (nothing), settings, or prompts (all).

    fields: array of (field, value), of which prompt and negative_prompt need the policy prompts, and empty ones and those that are a local path
    are left out; settings: array of (key, value), of which those that hold prompt text need it too. A text that follows itself is told once.
    """
    all_of_it = policy == "prompts"
    is_prompt = lambda f: f["field"].isin("prompt", "negative_prompt")
    told = F.transform(F.filter(fields, lambda f: (all_of_it | ~is_prompt(f)) & (f["value"] != "") & ~local_path(f["value"])), lambda f: f["value"])
    set_ = F.transform(F.filter(settings, lambda s: all_of_it | ~prompt_setting(s["key"])), lambda s: F.concat(s["key"], F.lit(": "), s["value"]))
    every = F.when(policy.isin("settings", "prompts"), F.concat(told, set_)).otherwise(F.array().cast("array<string>"))
    return F.filter(every, lambda t, i: (i == 0) | ~F.get(every, i - 1).eqNullSafe(t))


def resolve_field(user: Column, imported: Column, inherited: Column) -> Column:
    """struct<value, origin, conflicting>: a user's value, else the first imported claim, else the parent's."""
    first = F.element_at(F.filter(imported, lambda v: v.isNotNull()), 1)
    first = F.when(F.size(F.filter(imported, lambda v: v.isNotNull())) > 0, first)
    origin = F.when(user.isNotNull(), "user").when(first.isNotNull(), "imported").when(inherited.isNotNull(), "inherited").otherwise("unknown")
    clash = F.size(F.array_distinct(F.filter(imported, lambda v: v.isNotNull()))) > 1
    return F.struct(F.coalesce(user, first, inherited).alias("value"), origin.alias("origin"), clash.alias("conflicting"))


def redacted(df: DataFrame, share: dict[str, bool]) -> DataFrame:
    """Columns that are not shared become null; ``redacted`` names those that held a value."""
    names = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c, ok in share.items() if not ok] or [F.lit(None).cast("string")]), lambda n: n.isNotNull())
    out = df.withColumn("redacted", names)
    return out.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c, ok in share.items() if not ok})


def confirmed(current: DataFrame, edits: DataFrame, key: str, order: Sequence[str] = ("at",)) -> Folded:
    """Rows (key, revision, origin, parser, digest, sidecar) after confirmations, taken one after the other, and their outcomes.

    A confirmation holds for what it saw: the revision, else it is a conflict; then the parser, the content's digest and
    the sidecar's revision that the values were read with, of which the first that differs is the outcome. One that holds
    raises the revision, so that a second one of the same revision is a conflict.
    """

    def change(row: State, edit: dict) -> State | str:
        for c in ("parser", "digest", "sidecar"):
            if edit[f"expected_{c}"] != row[c]:
                return c
        return row | {"origin": "confirmed"}

    return folded(current, edits, key, order, compare_and_swap(change, expected="expected_revision"))
