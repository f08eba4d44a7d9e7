"""Validation rules: build them from spec and contract, run them in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.operators.heavy import HOT_ROWS, weigh
from mapweave.schemas import MappingColumn, TargetTable

#: Rows that a task compares for repeats, about.
TASK_ROWS = 500_000
_VALUE = "_rule_value"


@dataclass(frozen=True)
class Rule:
    """``test`` is not_null, unique, positive, allowed_values or predicate text."""

    table: str
    column: str
    test: str
    severity: str
    allowed: tuple = ()

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}.{self.test}"


def build_rules(columns: DataFrame, contract: DataFrame) -> DataFrame:
    """Rule rows for a table of spec columns.

    ``columns``: target_table, target_column, tests ARRAY<STRING>.
    ``contract``: target_table, target_column, required, unique (one row each).
    Contract rules are errors, listed tests are warnings.
    """
    joined = columns.join(contract, ["target_table", "target_column"], "left")

    def rule(test: Column, severity: str) -> Column:
        return F.struct(test.alias("test"), F.lit(severity).alias("severity"))

    declared = F.filter(F.array(
        F.when(F.col("required"), rule(F.lit("not_null"), "error")),
        F.when(F.col("unique"), rule(F.lit("unique"), "error"))), lambda r: r.isNotNull())
    listed = F.transform(F.coalesce("tests", F.array().cast("array<string>")), lambda x: rule(x, "warning"))
    return (joined.select("target_table", "target_column", F.explode(F.concat(declared, listed)).alias("r"))
            .select("target_table", "target_column", "r.test", "r.severity",
                    F.concat_ws(".", "target_table", "target_column", "r.test").alias("test_name")))


def rules_of(columns: Iterable[MappingColumn], contract: Iterable[TargetTable]) -> list[Rule]:
    """The same for one spec held on the driver, ready for ``run_rules``."""
    declared = {(t.name, c.name): c for t in contract for c in t.columns}
    rules = []
    for col in columns:
        if col.kind == "filter":
            continue
        target = declared.get((col.target_table, col.target_column))
        for test, wanted in (("not_null", target and target.required), ("unique", target and target.unique)):
            if wanted:
                rules.append(Rule(col.target_table, col.target_column, test, "error"))
        rules += [Rule(col.target_table, col.target_column, t, "warning") for t in col.tests]
        if target and target.allowed_values:
            rules.append(Rule(col.target_table, col.target_column, "allowed_values", "warning",
                              target.allowed_values))
    return rules


def _breaks(rule: Rule) -> Column:
    """Row predicate that is true where one row alone breaks the rule."""
    c = F.col(f"`{rule.column}`")
    if rule.test == "not_null":
        return c.isNull()
    if rule.test == "positive":
        return c <= 0
    if rule.test == "allowed_values":
        return ~c.isin(*rule.allowed)
    return ~F.expr(rule.test)


def _holds(rule: Rule, df: DataFrame) -> Column:
    """Aggregate that is true when the rule holds for the whole frame."""
    c = F.col(f"`{rule.column}`")
    if rule.test == "unique":
        return (F.count(c) == F.countDistinct(c)) & (F.count_if(c.isNull()) <= 1)
    if rule.test not in ("not_null", "positive", "allowed_values"):
        try:
            df.where(F.expr(rule.test))  # analysis only: is it a row predicate?
        except PySparkException:
            whole = F.expr(rule.test)  # else accept a boolean over aggregates
            if dict(df.agg(whole.alias("p")).dtypes)["p"] != "boolean":
                raise ValueError("the rule is not a boolean expression") from None
            return F.coalesce(whole, F.lit(True))
    return F.count_if(_breaks(rule)) == 0


def run_rules(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row per rule: test_name, severity, passed, details.

    All rules are columns of a single aggregation over ``df``. A rule that
    does not resolve becomes a failed row with the message; the run goes on.
    """
    checks, rows = [], []
    for i, rule in enumerate(rules):
        known = rule.column in df.columns
        error = None if known else f"no column {rule.column}"
        passed = F.lit(False)
        if known:
            try:
                checks.append(_holds(rule, df).alias(f"_r{i}"))
                passed = F.col(f"_r{i}")
            except (PySparkException, ValueError) as exc:
                error = str(exc).split("\n")[0]
        rows.append(F.struct(
            F.lit(rule.name).alias("test_name"), F.lit(rule.severity).alias("severity"),
            passed.alias("passed"), F.lit(error).cast("string").alias("details")))
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "test_name string, severity string, passed boolean, details string")
    totals = df.agg(*checks) if checks else df.agg(F.lit(0).alias("_none"))
    return totals.select(F.inline(F.array(*rows)))


def _repeated(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias(_VALUE)).agg(F.count("*").alias("_n")).where("_n > 1").select(_VALUE)


def violations(df: DataFrame, rule: Rule, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows that break one rule (for ``unique``: all rows of repeated values, two nulls included)."""
    if rule.test != "unique":
        return df.where(_breaks(rule))
    value = F.col(f"`{rule.column}`")
    n, _, _, hot = weigh(df, value, hot_rows)
    known, nulls, often = df.where(value.isNotNull()), df.where(value.isNull()), F.xxhash64(value).isin(hot)
    # Rows without a value stay where they lie; all that matters is whether there are two.
    several = nulls.agg(F.count("*").alias("_n")).where("_n > 1")
    parts = [nulls.join(F.broadcast(several), F.lit(True), "left_semi")]
    # So do rows of hot values. All others are dealt once, so many to a task.
    if hot:
        parts.append(known.where(often).join(F.broadcast(_repeated(known.where(often), value)), value == F.col(_VALUE), "left_semi"))
    dealt = known.where(~often).withColumn(_VALUE, value).repartition(n // TASK_ROWS + 1, _VALUE)
    parts.append(dealt.join(_repeated(dealt, F.col(_VALUE)), _VALUE, "left_semi").drop(_VALUE))
    return reduce(DataFrame.union, parts)


def summarise(results: DataFrame, *keys: str) -> DataFrame:
    """Passed and failed counts by severity (and further keys)."""
    return results.groupBy(*keys, "severity").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
