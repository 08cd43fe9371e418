"""The parsers and the validation as columns, for tables of query texts (logs, saved searches)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from lumencat.functions.interpret import InvalidQuery, StructuredQuery, TextQuery, interpret, parse_clauses

_WORDS = ArrayType(StringType())
INTERPRETED = StructType([StructField(n, _WORDS) for n in ("terms", "phrases", "excluded")] + [StructField(n, DoubleType()) for n in ("min_duration", "max_duration")] + [StructField("error", StringType())])
CLAUSE = StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("excluded", BooleanType())])
PARSED = StructType([StructField("clauses", ArrayType(CLAUSE)), StructField("ignored", _WORDS), StructField("error", StringType())])


def _interpreted(text: str | None) -> tuple:
    try:
        i = interpret(TextQuery(text=text or ""))
    except InvalidQuery as e:
        return None, None, None, None, None, str(e)
    return i.terms, i.phrases, i.excluded, i.min_duration, i.max_duration, None


def _parsed(text: str | None) -> tuple:
    try:
        clauses, ignored = parse_clauses(text or "")
    except InvalidQuery as e:
        return None, None, str(e)
    return [{"kind": c.kind, "text": c.text, "excluded": c.excluded} for c in clauses], ignored, None


@F.pandas_udf(INTERPRETED)
def interpreted(text: pd.Series) -> pd.DataFrame:
    """What the ranked search understands of a text; an error for contradictory ones."""
    return pd.DataFrame([_interpreted(t) for t in text], columns=INTERPRETED.names)


@F.pandas_udf(PARSED)
def clauses(text: pd.Series) -> pd.DataFrame:
    """The clauses of a structured search's text, and what of it is ignored."""
    return pd.DataFrame([_parsed(t) for t in text], columns=PARSED.names)


@F.pandas_udf(StringType())
def rejection(query: pd.DataFrame) -> pd.Series:
    """Why a structured query (a struct of its fields; null: not given) is contradictory, null if it is not."""

    def why(fields: dict) -> str | None:
        given = {k: list(v) if hasattr(v, "tolist") else v for k, v in fields.items() if hasattr(v, "tolist") or not pd.isna(v)}
        try:
            StructuredQuery(**{k: int(v) if isinstance(v, float) else v for k, v in given.items()}).validated()
        except InvalidQuery as e:
            return str(e)
        return None

    return pd.Series([why(r) for r in query.to_dict("records")], dtype="object")
