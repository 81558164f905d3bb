"""Row-level visibility as joins on an entitlement table ``(principal, kind, target, role)``.

kind ``workspace``: role ``member`` or ``owner`` of workspace ``target``; kind ``account``:
owner of billing account ``target``; kind ``global`` with role ``hub_admin``: may read all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.operators.dims import small_dim


def is_hub_admin(entitlements: DataFrame, principal: str) -> bool:
    """One bounded lookup (at most one row read back), like checking a token's roles."""
    hit = entitlements.filter(
        (F.col("principal") == principal) & (F.col("kind") == "global") & (F.col("role") == "hub_admin")
    )
    return hit.limit(1).count() > 0


def visible_usage(
    usage: DataFrame,
    entitlements: DataFrame,
    principal: str,
    require_owner: bool = False,
    allow_hub_admin: bool = False,
) -> DataFrame:
    """Usage rows of workspaces the principal may read (member or owner; owner only
    with ``require_owner``). A hub admin reads everything when allowed."""
    if allow_hub_admin and is_hub_admin(entitlements, principal):
        return usage
    grants = entitlements.filter((F.col("principal") == principal) & (F.col("kind") == "workspace"))
    if require_owner:
        grants = grants.filter(F.col("role") == "owner")
    return usage.join(small_dim(grants.select(F.col("target").alias("workspace")).distinct()), "workspace", "left_semi")


def visible_account_usage(
    usage: DataFrame,
    accounts: DataFrame,
    entitlements: DataFrame,
    principal: str,
    allow_hub_admin: bool = False,
) -> DataFrame:
    """Usage rows of workspaces in accounts the principal owns (admin bypass)."""
    if allow_hub_admin and is_hub_admin(entitlements, principal):
        return usage
    owned = entitlements.filter(
        (F.col("principal") == principal) & (F.col("kind") == "account") & (F.col("role") == "owner")
    ).select(F.col("target").alias("account"))
    ws = accounts.join(owned.distinct(), "account", "left_semi").select("workspace")
    return usage.join(small_dim(ws), "workspace", "left_semi")
