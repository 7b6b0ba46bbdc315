"""Which files a profile looks at and in which language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.functions.text import below_any, extension, suffix
from rivulint.rules.fixed_values import (
    AUDIT_EXTENSIONS, REVIEW_PRUNED_DIRS, SCAN_EXTENSIONS, SCAN_PRUNED_DIRS, SNIFF_MARKERS,
)


def is_reviewed(path: Column) -> Column:
    return F.lower(path).endswith(".php") & ~below_any(path, REVIEW_PRUNED_DIRS)


def review_files(files: DataFrame) -> DataFrame:
    """PHP files outside the pruned folders."""
    return files.where(is_reviewed(F.col("path")))


def audit_files(files: DataFrame) -> DataFrame:
    """Files with a mapped suffix, wherever they lie, with their language."""
    return files.withColumn("language", audit_language(F.col("path"))).where(
        F.col("language").isNotNull()
    )


def scan_files(files: DataFrame) -> DataFrame:
    """Every file outside the pruned folders."""
    return files.where(~below_any(F.col("path"), SCAN_PRUNED_DIRS))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A small fixed table as a literal map, so that the key is computed once."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def audit_language(path: Column) -> Column:
    return _lookup(AUDIT_EXTENSIONS, suffix(path))


def scan_extensions() -> dict[str, str]:
    return {ext: name for name, exts in SCAN_EXTENSIONS.items() for ext in exts}


def scan_language(path: Column, content: Column) -> Column:
    """By extension, else by what the content holds, else Unknown."""
    low = F.lower(content)
    sniffed = F.lit("Unknown")
    for name in reversed(list(SNIFF_MARKERS)):
        found = F.lit(False)
        for marker in SNIFF_MARKERS[name]:
            found = found | low.contains(marker)
        sniffed = F.when(found, F.lit(name)).otherwise(sniffed)
    return F.coalesce(_lookup(scan_extensions(), extension(path)), sniffed)
