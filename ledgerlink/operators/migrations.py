"""Schema versions of a ledger log as DataFrame functions, and guards of the legacy tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEGACY_TABLES = ("legacy_gleif", "legacy_gleif_other_name", "legacy_companies_house")
_V1 = [c for c in "entry_id idempotency_key action left_source left_id right_source right_id resolved_id reverses_entry_id decision score evidence_json approved_by recorded_at".split()]


class MigrationRefusedError(RuntimeError):
    """A precondition of a migration does not hold."""


@dataclass(frozen=True)
class Migration:
    version: int
    phase: str
    description: str
    apply: Callable[[DataFrame], DataFrame]
    blocked_by: Callable[[DataFrame], DataFrame] | None = None


def _baseline(df: DataFrame) -> DataFrame:
    return df.select(*_V1)


def _fill_approver(df: DataFrame) -> DataFrame:
    return df.withColumn("approver_id", F.coalesce("approver_id", F.lower(F.replace(F.col("approved_by"), F.lit(" "), F.lit(".")))))


MIGRATIONS = (
    Migration(1, "baseline", "merge log and links", _baseline),
    Migration(2, "expand", "approver_id beside approved_by", lambda df: df.withColumn("approver_id", F.lit(None).cast("string"))),
    Migration(3, "transition", "approver_id from approved_by", _fill_approver),
    Migration(4, "contract", "drop approved_by", lambda df: df.drop("approved_by"), lambda df: df.where(F.col("approver_id").isNull())),
    Migration(5, "expand", "links that a merge displaced", lambda df: df.withColumn("displaced_links_json", F.lit(None).cast("string"))),
)


def migrate(df: DataFrame, version: int = 0, target: int | None = None, migrations: tuple[Migration, ...] = MIGRATIONS) -> tuple[DataFrame, int]:
    """``df`` at ``version``, brought to ``target`` in order of version; refuses if a precondition fails.

    Nothing is written here: a caller writes the result to a new folder and renames it, so a refusal
    leaves the old state whole.
    """
    for m in sorted(migrations, key=lambda m: m.version):
        if m.version <= version or target is not None and m.version > target:
            continue
        if m.blocked_by is not None and (n := m.blocked_by(df).count()):
            raise MigrationRefusedError(f"version {m.version} ({m.phase}): {n} rows block it")
        df, version = m.apply(df), m.version
    return df, version


def adapt(event: DataFrame, log: DataFrame) -> DataFrame:
    """An event in the log's present shape: its columns only, approved_by filled while it exists."""
    if "approved_by" in log.columns and "approved_by" not in event.columns and "approver_id" in event.columns:
        event = event.withColumn("approved_by", F.col("approver_id"))
    known = event.select(*[c for c in event.columns if c in log.columns])
    return log.limit(0).unionByName(known, allowMissingColumns=True)


def current_version(versions: DataFrame) -> DataFrame:
    """One row: the highest applied version, 0 if none."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def fingerprint(*schemas: T.StructType) -> str:
    """First 32 hex digits of a digest of the schemas, blind to white space and case."""
    text = re.sub(r"\s+", " ", "\n".join(s.json() for s in schemas)).strip().lower()
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def guard_legacy(statement: str) -> None:
    """Refuses a statement that names a legacy table and does more than read."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S).strip().lower()
    reads = re.match(r"(select|with|explain|describe|show)\b", bare) and not re.search(r"\b(insert|update|delete|merge|drop|alter|create|truncate|replace)\b", bare)
    if not reads and any(re.search(rf"\b{t}\b", bare) for t in LEGACY_TABLES):
        raise MigrationRefusedError("legacy tables are read-only")
