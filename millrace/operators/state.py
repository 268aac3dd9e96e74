"""Upserts, replacements and access propagation as joins of the stored and the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """``stored`` with ``new``: rows of known keys change in the ``update`` columns only, others are added whole."""
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_fresh"))
    both = stored.withColumn("_known", F.lit(True)).join(fresh, list(keys), "full_outer")
    columns = []
    for c in stored.columns:
        if c in keys or c not in new.columns:
            columns.append(F.col(c))
        elif c in update:
            columns.append(F.when(F.col("_fresh"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
    return both.select(*columns)


def replace_chunks(chunks: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All chunks of the documents in ``new`` replaced by those of ``new``."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").select(chunks.columns).unionByName(new.select(chunks.columns))


def update_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """New embeddings by document and ordinal."""
    put = vectors.select("document_id", "ordinal", F.col("embedding").alias("_new"))
    return chunks.join(put, ["document_id", "ordinal"], "left").withColumn("embedding", F.coalesce("_new", "embedding")).select(chunks.columns)


def vectors_fit(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(document_id, stored, given)`` of the documents whose vectors are not one for each chunk."""
    stored = chunks.join(vectors.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("stored"))
    given = vectors.groupBy("document_id").agg(F.count_distinct("ordinal").alias("given"))
    both = given.join(stored, "document_id", "left").select("document_id", F.coalesce("stored", F.lit(0)).cast("long").alias("stored"), "given")
    return both.where("stored <> given")


def set_stage(documents: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Documents with the stages of ``changes(document_id, stage, progress, error, ...)``; null columns of a change leave what is there.

    An error is cleared only by the stage ``ready``, which also sets
    ``indexed_at``; every changed row is touched.
    """
    names = [c for c in changes.columns if c != "document_id"]
    put = changes.select("document_id", *(F.col(c).alias(f"_new_{c}") for c in names), F.lit(True).alias("_set"))
    joined = documents.join(put, "document_id", "left")
    ready = F.coalesce(F.col("_new_stage") == "ready", F.lit(False))
    columns = {c: F.coalesce(f"_new_{c}", c) for c in names if c in documents.columns}
    if "error" in documents.columns:
        columns["error"] = F.when(ready, F.col("_new_error") if "error" in names else F.lit(None).cast("string")).otherwise(columns.get("error", F.col("error")))
    if "indexed_at" in documents.columns:
        columns["indexed_at"] = F.when(ready, now).otherwise(F.col("indexed_at"))
    if "updated_at" in documents.columns:
        columns["updated_at"] = F.when(F.col("_set"), now).otherwise(F.col("updated_at"))
    return joined.select(*(columns[c].cast(documents.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in documents.columns))


def touched(before: DataFrame, after: DataFrame, key: str, now: Column) -> DataFrame:
    """``after`` with ``updated_at`` set to now where any other column of a row differs from ``before``, or the row is new."""
    others = [c for c in after.columns if c not in (key, "updated_at")]
    old = before.select(key, F.struct(*others).alias("_old"), F.lit(True).alias("_known"))
    same = F.coalesce("_known", F.lit(False)) & F.struct(*others).eqNullSafe(F.col("_old"))
    joined = after.join(old, key, "left")
    return joined.select(*(F.when(same, F.col(c)).otherwise(now).cast(after.schema[c].dataType).alias(c) if c == "updated_at" else F.col(c) for c in after.columns))


def set_source_status(sources: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Sources with the status and error of ``changes(source_id, status, error)``; becoming idle ends a sync."""
    put = changes.select("source_id", F.col("status").alias("_status"), F.col("error").alias("_error"), F.lit(True).alias("_set"))
    joined = sources.join(put, "source_id", "left")
    put_in = {"status": F.when(F.col("_set"), F.col("_status")).otherwise(F.col("status")), "last_error": F.when(F.col("_set"), F.col("_error")).otherwise(F.col("last_error")), "last_sync_at": F.when(F.col("_status") == "idle", now).otherwise(F.col("last_sync_at"))}
    return joined.select(*(put_in[c].cast(sources.schema[c].dataType).alias(c) if c in put_in else F.col(c) for c in sources.columns))


def upsert_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users by tenant and e-mail address in any case; a name that is not given leaves the known one."""
    named = new.withColumn("email", F.lower("email"))
    known = users.withColumn("email", F.lower("email"))
    given = named.join(known.select("tenant_id", "email", F.col("name").alias("_name")), ["tenant_id", "email"], "left").withColumn("name", F.coalesce("name", "_name")).drop("_name")
    return upsert(known, given, ["tenant_id", "email"], ["name"])


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Memberships with the new ones that are not there yet."""
    return members.unionByName(new.select(members.columns).distinct().join(members, members.columns, "left_anti"))


def by_email(users: DataFrame, email: str) -> DataFrame:
    """Users with this address, in any case."""
    return users.where(F.lower("email") == email.lower())


def sync_chunk_access(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the access rules of their documents."""
    rules = documents.select("document_id", F.col("acl_public").alias("_p"), F.col("acl_groups").alias("_g"), F.lit(True).alias("_d"))
    joined = chunks.join(rules, "document_id", "left")
    for c, n in (("acl_public", "_p"), ("acl_groups", "_g")):
        joined = joined.withColumn(c, F.when(F.col("_d"), F.col(n)).otherwise(F.col(c)))
    return joined.select(chunks.columns)


def delete_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def principals(users: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Each user with the sorted keys of their groups (empty without any)."""
    joined = users.join(members, "user_id", "left").join(groups, "group_id", "left")
    return joined.groupBy("user_id", "tenant_id", "email", "is_admin").agg(F.array_sort(F.collect_set("key")).alias("groups"))


def latest_by_title(documents: DataFrame) -> DataFrame:
    """The newest document of each title."""
    newest = F.row_number().over(Window.partitionBy("tenant_id", "title").orderBy(F.col("created_at").desc(), F.col("document_id").desc()))
    return documents.withColumn("_n", newest).where("_n = 1").drop("_n")


def title_collisions(documents: DataFrame) -> DataFrame:
    """Titles that several documents have."""
    return documents.groupBy("tenant_id", "title").agg(F.count("*").alias("n")).where("n > 1")
