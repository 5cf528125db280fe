"""Redaction: of named fields, and of patterns in text; an inventory of both."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import REDACTED

# Names of fields that hold secrets.
SECRET_FIELDS = ("api_key", "backup_codes", "cloud_access_key", "cloud_secret_key", "secret", "shared_secret", "sso_password", "x_key", "x_passphrase", "x_password", "x_shadow")

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "key": r"\b(AKIA|sk_live_|ghp_)[A-Za-z0-9]{8,}",
}


def redact_fields(df: DataFrame, fields: Iterable[str], mark: str = REDACTED) -> DataFrame:
    """The named columns with every value that isn't null replaced."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mark)) for c in fields})


def redact_text(text: Column, patterns: Iterable[str] = tuple(PATTERNS.values()), mark: str = REDACTED) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, mark)
    return text


def inventory(df: DataFrame, column: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(kind, occurrences, documents) of each pattern in a column, in one pass."""
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(column), F.lit(p)).alias("n")) for k, p in patterns.items()])
    return df.select(F.explode(counts).alias("c")).groupBy("c.kind").agg(F.sum(F.coalesce("c.n", F.lit(0))).alias("occurrences"), F.count_if(F.col("c.n") > 0).alias("documents"))
