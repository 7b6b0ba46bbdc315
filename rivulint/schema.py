"""The one schema every profile's findings are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.rules.fixed_values import SEVERITY_RANK, UNKNOWN_SEVERITY_RANK

FINDING_FIELDS = {
    "profile": "string", "path": "string", "line": "int", "rule_id": "string",
    "severity": "string", "severity_rank": "int", "type": "string", "category": "string",
    "language": "string", "message": "string", "snippet": "string",
    "recommendation": "string", "confidence": "int", "match_no": "int",
}


_CASES = " ".join(f"when '{name}' then {rank}" for name, rank in SEVERITY_RANK.items())
RANK_SQL = f"case upper(severity) {_CASES} else {UNKNOWN_SEVERITY_RANK} end"


def severity_rank(column: str = "severity") -> Column:
    return F.expr(RANK_SQL.replace("severity", column))


def as_findings(df: DataFrame, profile: str | None) -> DataFrame:
    """Bring a frame with some of the fields to the full schema; what is missing is NULL.

    Without a profile the frame has one for every row.
    """
    values = {name: name for name in df.columns}
    values |= {"severity": "upper(severity)", "severity_rank": RANK_SQL}
    if profile is not None:
        values["profile"] = f"'{profile}'"
    values.setdefault("match_no", "1")
    return df.selectExpr(*[
        f"cast({values.get(name, 'null')} as {kind}) as {name}"
        for name, kind in FINDING_FIELDS.items()
    ])
