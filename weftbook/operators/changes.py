"""Batches of creates, edits and deletes applied to a table.

Change rows carry the id, the moment of the change (``changed_at``), for edits a
``change_id`` that orders changes of the same moment, and the new field values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slugs import slug_of
from ..functions.text import either
from ..schemas import PUBLISHED, TRANSLATED, TRANSLATION_SUFFIXES
from .lookup import lookup_join, present_keys, unique_join

# Status of new rows that name none.
ARTICLE_DEFAULT, LISTING_DEFAULT = "draft", "published"


def _entered(changes: DataFrame, default_status: str, title: str) -> DataFrame:
    """Form values as they are stored: slug made safe, empty category dropped, status filled."""
    out = changes.withColumn("slug", slug_of(F.col(title), F.col("slug")))
    out = out.withColumn("status", F.coalesce("status", F.lit(default_status)))
    if "category_id" in changes.columns:
        out = out.withColumn("category_id", F.nullif(F.col("category_id").cast("string"), F.lit("")).cast("bigint"))
    return out


def apply_creates(
    base: DataFrame, creates: DataFrame, default_status: str = ARTICLE_DEFAULT, title: str = "title"
) -> DataFrame:
    """Add new rows.  An article that starts published is published at that moment.

    The status asked for decides that, not the default one.
    """
    rows = _entered(creates.withColumn("__asked", F.col("status")), default_status, title)
    if "published_at" in base.columns:
        rows = rows.withColumn("published_at", F.when(F.col("__asked") == PUBLISHED, F.col("changed_at")))
    rows = rows.withColumn("created_at", F.col("changed_at"))
    if "updated_at" in base.columns:
        rows = rows.withColumn("updated_at", F.col("changed_at"))
    rows = rows.select(*[c for c in base.columns if c in rows.columns])
    return base.unionByName(rows, allowMissingColumns=True)


ACCEPTED, ID_TAKEN, SLUG_TAKEN, NO_TEXT = "accepted", "id taken", "slug taken", "missing text"


def create_outcomes(base: DataFrame, creates: DataFrame, required: list[str], title: str = "title") -> DataFrame:
    """New rows as they would be stored, with ``outcome``: accepted, or why the database refuses them.

    A required text that is missing comes first, then an id, then a slug that a stored row has; of new rows with the same id or
    slug the earliest (by ``changed_at``, then id) counts.  An empty slug (a title without any letter kept) counts as missing.
    """
    rows = _entered(creates, ARTICLE_DEFAULT, title)
    empty = F.coalesce(F.col("slug"), F.lit("")) == ""
    for column in required:
        empty = empty | (F.coalesce(F.col(column).cast("string"), F.lit("")) == "")
    rows = rows.withColumn("__empty", empty)
    order = F.struct(F.col("__empty"), F.col("changed_at"), F.col("id"), F.col("slug"))
    rows = rows.withColumn("__order", order)
    for key in ("id", "slug"):
        first = rows.groupBy(key).agg(F.min("__order").alias(f"__first_{key}"))
        taken = present_keys(rows.select(key).where(F.col(key).isNotNull()).distinct(), base, key).withColumn(f"__taken_{key}", F.lit(True))
        rows = lookup_join(lookup_join(rows, first, [key]), taken, [key])

    def clash(key: str) -> Column:
        return F.col(f"__taken_{key}").isNotNull() | (F.col("__order") > F.col(f"__first_{key}"))

    outcome = F.when(F.col("__empty"), NO_TEXT).when(clash("id"), ID_TAKEN).when(clash("slug"), SLUG_TAKEN).otherwise(ACCEPTED)
    helpers = ["__empty", "__order", *[f"__{kind}_{key}" for kind in ("first", "taken") for key in ("id", "slug")]]
    return rows.withColumn("outcome", outcome).drop(*helpers)


def _folded(edits: DataFrame, fields: list[str], default_status: str) -> DataFrame:
    """All edits of one id as one row: last values, last moment, first publishing moment.

    The last row per id is an aggregate, so an id edited very often is cut down before
    the shuffle.
    """
    last = F.max_by(F.struct(*fields), F.struct("changed_at", "change_id"))
    publishes = F.coalesce("status", F.lit(default_status)) == PUBLISHED
    return edits.groupBy("id").agg(
        last.alias("__last"),
        F.max("changed_at").alias("__edited_at"),
        F.min(F.when(publishes, F.col("changed_at"))).alias("__published_at"),
    ).select("id", "__last.*", "__edited_at", "__published_at")


def apply_edits(
    base: DataFrame,
    edits: DataFrame,
    fields: list[str],
    default_status: str = ARTICLE_DEFAULT,
    title: str = "title",
) -> DataFrame:
    """Edits replace every field in ``fields``; a value that is missing becomes NULL.

    ``published_at`` is set once, by the first edit that leaves an undated row published, and
    never cleared.  Edits of unknown ids change nothing.
    """
    present = [c for c in fields if c in edits.columns]
    entered = _entered(_folded(edits, present, default_status), default_status, title)
    folded = entered.select("id", "__edited_at", "__published_at", F.struct(*present).alias("__new"))
    edited = F.col("__new").isNotNull()

    def value(name: str) -> Column:
        if name in present:
            return F.when(edited, F.col(f"__new.{name}")).otherwise(F.col(name))
        if name in fields:
            return F.when(~edited, F.col(name))
        if name == "published_at":
            return F.coalesce(F.col(name), F.col("__published_at"))
        if name == "updated_at":
            return F.coalesce(F.col("__edited_at"), F.col(name))
        return F.col(name)

    return unique_join(base, folded, ["id"]).select(*[value(c).alias(c) for c in base.columns])


def apply_deletes(base: DataFrame, deletes: DataFrame) -> DataFrame:
    return unique_join(base, deletes.select("id").distinct(), ["id"], "left_anti").select(*base.columns)


def delete_outcomes(base: DataFrame, deletes: DataFrame) -> DataFrame:
    """Each requested id once, and whether there was such a row."""
    asked = deletes.select("id").distinct()
    known = present_keys(asked, base, "id").withColumn("__known", F.lit(True))
    return unique_join(asked, known, ["id"]).select("id", F.col("__known").isNotNull().alias("found"))


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    fields: list[str],
    default_status: str = ARTICLE_DEFAULT,
    title: str = "title",
) -> DataFrame:
    """A batch of change rows, told apart by ``op``: create, edit or delete.

    Ids are never given twice, so a row is created before it is edited and edited before it
    is deleted: applying all creates, then all edits, then all deletes gives what the rows
    give one by one.
    """
    of = {op: changes.where(F.col("op") == op) for op in ("create", "edit", "delete")}
    grown = apply_creates(base, of["create"], default_status, title)
    return apply_deletes(apply_edits(grown, of["edit"], fields, default_status, title), of["delete"])


def remove_children(children: DataFrame, key: str, deleted: DataFrame, **options) -> DataFrame:
    """Delete the rows that belong to a deleted parent (on delete cascade)."""
    gone = deleted.select(F.col("id").alias(key)).distinct()
    return lookup_join(children, gone, [key], "left_anti", **options).select(*children.columns)


def release_children(children: DataFrame, key: str, deleted: DataFrame, **options) -> DataFrame:
    """Empty the key of rows whose parent is deleted (on delete set null)."""
    gone = deleted.select(F.col("id").alias(key), F.lit(True).alias("__gone")).distinct()
    joined = lookup_join(children, gone, [key], **options)
    return joined.select(
        *[(F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c)) for c in children.columns]
    )


def delete_rows(tables: dict[str, DataFrame], name: str, deleted: DataFrame, rules: dict) -> dict[str, DataFrame]:
    """Delete rows of one table and follow every foreign key: cascade or set null.

    ``rules`` is schemas.TABLES.  Children that go take their own children with them.
    """
    out = dict(tables)
    out[name] = apply_deletes(out[name], deleted)
    for child, rule in rules.items():
        if child not in out:
            continue
        for key, (parent, action) in rule.foreign_keys.items():
            if parent != name:
                continue
            if action == "cascade" and "id" in out[child].columns:
                gone = lookup_join(out[child], deleted.select(F.col("id").alias(key)).distinct(), [key], "left_semi")
                out = delete_rows(out, child, gone.select("id"), rules)
            elif action == "cascade":
                out[child] = remove_children(out[child], key, deleted)
            else:
                out[child] = release_children(out[child], key, deleted)
    return out


def insert_absent(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Add rows whose natural key is not there yet; running it again changes nothing.

    Of new rows with the same key the one with the lowest id counts.  Rows without a key cannot be told
    apart and are not taken: see ``without_key``.
    """
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*new.columns), F.col("id")).alias("row")).select("row.*")
    fresh = unique_join(first, present_keys(first, base, key), [key], "left_anti")
    return base.unionByName(fresh.select(*new.columns), allowMissingColumns=True)


def without_key(new: DataFrame, key: str) -> DataFrame:
    """The rows that ``insert_absent`` refuses."""
    return new.where(F.col(key).isNull())


def translation_columns(table: str) -> list[str]:
    return [f"{c}{suffix}" for c in TRANSLATED.get(table, ()) for suffix in TRANSLATION_SUFFIXES]


def add_translations(df: DataFrame, table: str) -> DataFrame:
    """Add the table's translation columns, empty; columns that are there already stay."""
    return df.withColumns(
        {c: F.lit(None).cast("string") for c in translation_columns(table) if c not in df.columns}
    )


def drop_translations(df: DataFrame, table: str) -> DataFrame:
    return df.drop(*translation_columns(table))


def merge_batches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows written before and after a column was added, in one frame."""
    return old.unionByName(new, allowMissingColumns=True)


def localised(df: DataFrame, table: str, column: str, suffix: str = TRANSLATION_SUFFIXES[0]) -> Column:
    """The translated text of a column, or the original where there is none."""
    name = f"{column}{suffix}"
    return either(F.col(name), F.col(column)) if name in df.columns else F.col(column)
