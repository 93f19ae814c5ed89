"""Keyed tables as DataFrames: look-ups, inserts, updates, exclusive flags, versions. Each function returns the new table.

Keys are compared by equality; null keys match nothing. Nothing is collected; a caller writes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted keys with their row's columns, and found: whether there is one."""
    return wanted.select(key).join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def new_rows(table: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows whose key the table does not hold; of rows with one key the first by order."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(table.select(*key).distinct(), key, "left_anti")


def inserted(table: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table with its rows and the new ones."""
    return table.unionByName(new_rows(table, rows, key, order).select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str, stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """The table with the values of changes (one row a key, null: no change); stamp is set where a row changed."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in cols), F.lit(True).alias("_changed"))
    out = table.join(new, key, "left")

    def value(c: str) -> Column:
        if c in cols:
            return F.coalesce(f"_new_{c}", c).alias(c)
        return F.when(F.col("_changed"), now).otherwise(F.col(c)).alias(c) if c == stamp else F.col(c)

    return out.select(*(value(c) for c in table.columns))


def with_exclusive(table: DataFrame, targets: DataFrame, group: str, key: str, flag: str) -> DataFrame:
    """In each group that targets names (group, key), the flag is true for that key alone; other groups stay."""
    want = targets.select(F.col(group), F.col(key).alias("_target"))
    return table.join(want, group, "left").withColumn(flag, F.when(F.col("_target").isNotNull(), F.col(key) == F.col("_target")).otherwise(F.col(flag))).select(*table.columns)


def without_guarded(table: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """The table without the given keys, except that flagged rows (defaults) cannot go."""
    return table.join(keys.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").where(F.col("_gone").isNull() | F.col(flag)).drop("_gone").select(*table.columns)


def rehomed(table: DataFrame, group: str, flag: str, order: list[str], enabled: str) -> DataFrame:
    """Groups without a flagged row give the flag to their first enabled row."""
    w = Window.partitionBy(group)
    none = ~F.coalesce(F.max(F.col(flag).cast("int")).over(w) == 1, F.lit(False))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(enabled), *order)) == 1
    return table.withColumn(flag, F.col(flag) | (none & first & F.col(enabled)))


def named(table: DataFrame, wanted: DataFrame, kind: str, name: str) -> DataFrame:
    """Enabled rows of the wanted kinds and names; case and outer blanks do not count."""
    plain = lambda df: df.withColumn("_name", F.lower(F.btrim(name)))
    return plain(table.where("enabled")).join(plain(wanted).select(kind, "_name").distinct(), [kind, "_name"], "left_semi").drop("_name")


def visible_to(table: DataFrame, owner: Column, reserved: str = "__legacy_anonymous__") -> DataFrame:
    """The rows of one owner; the reserved owner sees nothing."""
    return table.where((F.col("owner_id") == owner) & (owner != reserved))


def conjunction(table: DataFrame, **wanted) -> DataFrame:  # noqa: ANN003
    """Rows that meet every given condition: a value, or a list of values (an empty list and None filter nothing)."""
    for column, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            table = table.where(F.col(column).isin(list(value))) if value else table
        elif value is not None:
            table = table.where(F.col(column) == value)
    return table


def keyword_page(table: DataFrame, fields: list[str], text: str, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of the rows whose joined fields hold one of the words of a text; all rows where the text has none."""
    words = text.lower().split()
    body = F.lower(F.concat_ws(" ", *fields))
    found = table.where(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(body, w))) if words else table
    return found.orderBy(*order).offset(offset).limit(limit)


def owned(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """What becomes of wanted conversations (id, owner_id): created, kept (the owner's own) or refused (another's)."""
    old = existing.select("id", F.col("owner_id").alias("_old"))
    state = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("owner_id"), "kept").otherwise("refused")
    return wanted.join(old, "id", "left").select("id", "owner_id", state.alias("outcome"))


def details(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Parents with their children as an ordered array; an empty one where there are none."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))
    out = parents.join(lists, key, "left")
    return out.withColumn("children", F.coalesce("children", F.array().cast(dict(out.dtypes)["children"])))


def replaced_slice(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with all rows of the keys that rows hold replaced by rows."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def published(documents: DataFrame, version: Column) -> DataFrame:
    """Documents whose active version is the given one become published with it; the others stay."""
    return documents.withColumn("published", F.when(F.col("active") == version, version).otherwise(F.col("published")))


def draft_copy(rows: DataFrame, document_id: Column, old: Column, new: Column, edited_id: Column, text: Column) -> DataFrame:
    """The rows of one document's version again under a new version; one child's text is changed and its vector dropped.

    rows: document_id, version, child_id, parent_text, text, embedding. The parent's text changes at the first place of the
    child's old text.
    """
    mine = rows.where((F.col("document_id") == document_id) & (F.col("version") == old))
    edited = F.col("child_id") == edited_id
    old_text = mine.where(edited).agg(F.first("text").alias("_old"))  # one row
    at = F.instr(F.col("parent_text"), F.col("_old"))
    parent = F.when(at > 0, F.concat(F.substr("parent_text", F.lit(1), at - 1), text, F.substr("parent_text", at + F.length("_old")))).otherwise(F.col("parent_text"))
    copy = mine.crossJoin(F.broadcast(old_text)).withColumn("parent_text", parent).withColumn("version", new)
    changed = edited & (F.col("text") != text)
    copy = copy.withColumn("embedding", F.when(~changed, F.col("embedding"))).withColumn("text", F.when(edited, text).otherwise(F.col("text")))
    return rows.unionByName(copy.select(*rows.columns))


def activated(manifests: DataFrame, targets: DataFrame, rollback: bool = False) -> DataFrame:
    """Manifests (dataset_id, version, active, was_active) with the target version active alone; a rollback needs one that
    was active before. Datasets without a fitting target stay."""
    fits = manifests.join(targets, ["dataset_id", "version"], "left_semi").where(F.col("was_active") | F.lit(not rollback)).select("dataset_id", "version")
    out = with_exclusive(manifests, fits, "dataset_id", "version", "active")
    return out.withColumn("was_active", F.col("was_active") | F.col("active"))
