"""Access rules, metadata containment and small projections, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, functions as F

#: Order of the source kinds; sorts by kind follow it.
SOURCE_KINDS = ("upload", "web", "github", "slack", "notion", "gdrive", "jira")
#: A configuration key that contains one of these is never shown.
SECRET_PARTS = ("token", "secret", "password", "key", "credential")


def visible(groups: Sequence[str], is_admin: bool, public: Column | str = "acl_public", acl: Column | str = "acl_groups") -> Column:
    """Whether a principal with these groups may see the row; nulls never grant access."""
    if is_admin:
        return F.lit(True)
    public, acl = (F.col(c) if isinstance(c, str) else c for c in (public, acl))
    shared = F.arrays_overlap(acl, F.array(*map(F.lit, groups)).cast("array<string>")) if groups else F.lit(False)
    return F.coalesce(public, F.lit(False)) | F.coalesce(shared, F.lit(False))


def contains(document: Column, wanted: Any, path: str = "$") -> Column:
    """JSON containment of a Python value in a variant column: objects by key, arrays as sets, scalars by value."""
    if isinstance(wanted, dict):
        ok = F.lit(True) if wanted else F.coalesce(F.schema_of_variant(F.try_variant_get(document, path, "variant")).startswith("OBJECT"), F.lit(False))
        for k, v in wanted.items():
            ok = ok & contains(document, v, f"{path}['{k}']")
        return ok
    if isinstance(wanted, list):
        items = F.try_variant_get(document, path, "array<variant>")
        ok = items.isNotNull()
        for v in wanted:
            ok = ok & F.coalesce(_some(items, v), F.lit(False))
        return ok
    if wanted is None:
        return F.coalesce(F.is_variant_null(F.try_variant_get(document, path, "variant")), F.lit(False))
    if isinstance(wanted, bool):
        same = F.try_variant_get(document, path, "boolean") == wanted
        kind = "BOOLEAN"
    elif isinstance(wanted, (int, float)):
        same = F.try_variant_get(document, path, "double") == float(wanted)
        kind = None
    else:
        same = F.try_variant_get(document, path, "string") == wanted
        kind = "STRING"
    held = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    right = held == kind if kind else held.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.coalesce(same & right, F.lit(False))


def _some(items: Column, wanted: Any) -> Column:
    return F.exists(items, lambda x: contains(x, wanted))


def public_config(config: Column) -> Column:
    """A map of settings without its secrets."""
    return F.map_filter(config, lambda k, _: ~F.exists(F.array(*map(F.lit, SECRET_PARTS)), lambda s: F.contains(F.lower(k), s)))


def secret_keys(config: Column) -> Column:
    """Sorted names of the secrets that are set."""
    held = F.map_filter(config, lambda k, v: F.exists(F.array(*map(F.lit, SECRET_PARTS)), lambda s: F.contains(F.lower(k), s)) & v.isNotNull() & (v != ""))
    return F.array_sort(F.map_keys(held))


def kind_rank(kind: Column) -> Column:
    """Place of a source kind in SOURCE_KINDS, from 1; 0 for others."""
    return F.array_position(F.array(*map(F.lit, SOURCE_KINDS)), kind)
