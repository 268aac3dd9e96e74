"""Listings that join a row with the names of what it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def documents_of(documents: DataFrame, sources: DataFrame, tenant_id: str, source_id: str | None = None, limit: int = 200) -> DataFrame:
    """A tenant's newest documents (of one source, if it is named) with the kind and name of their source."""
    rows = documents.where(F.col("tenant_id") == tenant_id)
    rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
    named = rows.join(sources.select("source_id", F.col("kind").alias("source_kind"), F.col("name").alias("source_name")), "source_id")
    return named.orderBy(F.desc("created_at"), "document_id").limit(limit)


def accounts(users: DataFrame, tenants: DataFrame, email: str | None = None, slug: str | None = None) -> DataFrame:
    """``(user_id, email, is_admin, created_at, tenant_slug, tenant_name)`` of users by address in any case, and by tenant, if these are given.

    An address may belong to several tenants; none of them is chosen here.
    """
    named = users.join(tenants.select("tenant_id", F.col("slug").alias("tenant_slug"), F.col("name").alias("tenant_name")), "tenant_id")
    named = named if email is None else named.where(F.lower("email") == email.strip().lower())
    named = named if slug is None else named.where(F.col("tenant_slug") == slug)
    return named.select("user_id", "email", "is_admin", "created_at", "tenant_slug", "tenant_name")


def first_admins(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """``(tenant_slug, email)``: each tenant's oldest administrator, who stands in where nobody is named."""
    admins = accounts(users, tenants).where("is_admin")
    oldest = F.min_by("email", F.struct("created_at", "user_id"))
    return admins.groupBy("tenant_slug").agg(oldest.alias("email"))


def results_of(results: DataFrame, questions: DataFrame, run_id: str) -> DataFrame:
    """A run's results with the words of their questions."""
    return results.where(F.col("run_id") == run_id).join(questions.select("question_id", "question"), "question_id")
