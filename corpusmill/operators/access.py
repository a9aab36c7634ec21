"""Who may do what, and whether the parts are ready."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rules


def may(action: Column, role: Column) -> Column:
    """Whether a role may take an action; unknown roles and actions may not."""
    out = F.lit(False)
    for name, able in rules.ACTIONS.items():
        out = out | ((action == name) & role.isin(able))
    return F.coalesce(out, F.lit(False))


def role_of(address: Column) -> Column:
    out = F.lit(rules.DEFAULT_ROLE)
    for name, role in rules.ROLE_OF.items():
        out = F.when(address == name, role).otherwise(out)
    return out


def unrevoked(tokens: DataFrame, revoked: DataFrame, key: str = "token_id") -> DataFrame:
    """Tokens whose id isn't among the revoked ones."""
    return tokens.join(revoked.select(key), key, "left_anti")


def sound_environment(name: Column) -> Column:
    return F.coalesce(name.isin(rules.ENVIRONMENTS), F.lit(False))


def ready(checks: dict[str, Callable[[], bool]]) -> tuple[bool, dict[str, bool]]:
    """Whether all parts are ready, and each; a check that fails with an error isn't."""
    found = {}
    for name, check in checks.items():
        try:
            found[name] = bool(check())
        except Exception:  # noqa: BLE001  a part that can't answer isn't ready
            found[name] = False
    return all(found.values()), found
