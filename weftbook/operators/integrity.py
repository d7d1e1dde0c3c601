"""Reports on rows that break a declared rule.

All reports have the same columns: table, rule, column, key, n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import unique_join


def _report(table: str, rule: str, column: str, key: Column, n: Column) -> list[Column]:
    return [
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit(column).alias("column_name"),
        key.cast("string").alias("key"),
        n.cast("bigint").alias("n"),
    ]


def duplicates(df: DataFrame, table: str, columns: list[str], digest: bool = False) -> DataFrame:
    """Keys that occur more than once, with their count.  NULL keys are never equal.

    With ``digest`` long texts are compared by their SHA-256 (of the whole text), so that
    only 64 characters per row are shuffled; the report then shows the digest.
    """
    present = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    keys = [F.sha2(F.col(c), 256).alias(c) if digest else F.col(c) for c in columns]
    counted = present.select(*keys).groupBy(*columns).count().where(F.col("count") > 1)
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return counted.select(*_report(table, "unique", ",".join(columns), key, F.col("count")))


def missing_values(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Required columns that hold NULL, with the number of such rows: one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns])
    return (
        counts.select(F.inline(pairs))
        .where(F.col("n") > 0)
        .select(
            F.lit(table).alias("table_name"),
            F.lit("not null").alias("rule"),
            "column_name",
            F.lit(None).cast("string").alias("key"),
            "n",
        )
    )


def orphans(children: DataFrame, table: str, key: str, parents: DataFrame, **options) -> DataFrame:
    """Key values without a parent, with the number of rows that use them.

    Children are counted per key before they meet the parents, so each key moves once.
    """
    used = children.where(F.col(key).isNotNull()).groupBy(key).count()
    known = parents.select(F.col("id").alias(key))
    lost = unique_join(used, known, [key], "left_anti", **options)
    return lost.select(*_report(table, "foreign key", key, F.col(key), F.col("count")))


def too_long(df: DataFrame, table: str, limits: dict[str, int]) -> DataFrame:
    """Rows (by id) whose text is longer than declared, with its length: one pass."""
    checks = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.char_length(F.col(c)).cast("bigint").alias("n"), F.lit(size).alias("size"))
            for c, size in limits.items()
        ]
    )
    return (
        df.select("id", F.inline(F.filter(checks, lambda x: x["n"] > x["size"])))
        .select(
            F.lit(table).alias("table_name"),
            F.lit("length").alias("rule"),
            "column_name",
            F.col("id").cast("string").alias("key"),
            "n",
        )
    )


def outside_domain(df: DataFrame, table: str, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside their list, with the number of rows that hold them: one pass."""
    checks = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("string").alias("key"),
                F.coalesce(~F.col(c).isin(*values), F.lit(False)).alias("outside"),
            )
            for c, values in domains.items()
        ]
    )
    return (
        df.select(F.inline(F.filter(checks, lambda x: x["outside"])))
        .groupBy("column_name", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(table).alias("table_name"), F.lit("domain").alias("rule"), "column_name", "key", "n")
    )


def row_rules(
    df: DataFrame,
    table: str,
    required: list[str],
    limits: dict[str, int] | None = None,
    domains: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """The reports of ``missing_values``, ``too_long`` and ``outside_domain`` from one pass over the table.

    Every row gives its broken rules; equal ones are counted before they move.  Texts that are too long are reported
    row by row, the others by column and value.
    """
    none = F.lit(None).cast("string")

    def found(rule: str, column: str, broken: Column, key: Column, size: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), key.cast("string").alias("key"),
            size.cast("bigint").alias("size"), F.coalesce(broken, F.lit(False)).alias("broken"),
        )

    checks = [found("not null", c, F.col(c).isNull(), none, F.lit(None)) for c in required]
    for c, most in (limits or {}).items():
        checks.append(found("length", c, F.char_length(F.col(c)) > most, F.col("id"), F.char_length(F.col(c))))
    checks += [found("domain", c, ~F.col(c).isin(*values), F.col(c), F.lit(None)) for c, values in (domains or {}).items()]
    broken = df.select(F.inline(F.filter(F.array(*checks), lambda x: x["broken"])))
    counted = broken.groupBy("rule", "column_name", "key", "size").agg(F.count(F.lit(1)).alias("rows"))
    each = F.when(F.col("rule") == "length", F.array_repeat("size", F.col("rows").cast("int"))).otherwise(F.array("rows"))
    return counted.select(F.lit(table).alias("table_name"), "rule", "column_name", "key", F.explode(each).alias("n"))


def broken_row_counts(rule, have: set[str]) -> list[Column]:
    """For one declared table, aggregates named ``rule:column`` that count the rows breaking each row rule, and ``rows:``.

    Plain sums, so they can ride along with a write (``catalogue.write_checked``) or any other pass over the rows.
    """
    counts = [F.count(F.lit(1)).alias("rows:")]
    counts += [F.count_if(F.col(c).isNull()).alias(f"not null:{c}") for c in rule.required() if c in have]
    counts += [F.count_if(F.char_length(F.col(c)) > most).alias(f"length:{c}") for c, most in rule.lengths().items() if c in have]
    counts += [F.count_if(~F.col(c).isin(*values)).alias(f"domain:{c}") for c, values in rule.domains.items() if c in have]
    return counts


def check_tables(tables: dict[str, DataFrame], rules: dict) -> DataFrame:
    """Every declared rule over every given table: ``rules`` is schemas.TABLES."""
    parts: list[DataFrame] = []
    for name, df in tables.items():
        rule = rules[name]
        have = set(df.columns)
        parts += [duplicates(df, name, list(key)) for key in rule.unique if have.issuperset(key)]
        required = [c for c in rule.required() if c in have]
        limits = {c: size for c, size in rule.lengths().items() if c in have and "id" in have}
        domains = {c: values for c, values in rule.domains.items() if c in have}
        if required or limits or domains:
            parts.append(row_rules(df, name, required, limits, domains))
        for column, (parent, _) in rule.foreign_keys.items():
            if column in have and parent in tables:
                parts.append(orphans(df, name, column, tables[parent]))
    return reduce(DataFrame.unionByName, parts)
