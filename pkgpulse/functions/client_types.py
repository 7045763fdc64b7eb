"""Client-type selection (the user / CI / other toggles of every report)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The client-type dimension (name -> id), and the id that no
# row carries, which an empty selection turns into (so it selects nothing).
CLIENT_TYPES = (("user", 1), ("ci", 2), ("missing", 3))
NO_CLIENT_TYPE = 4
DEFAULT_CLIENT_TYPES = (1,)


def client_type_ids(user: bool = True, ci: bool = False, missing: bool = False) -> tuple[int, ...]:
    """Toggle flags -> selected ids (in id order)."""
    flags = {1: user, 2: ci, 3: missing}
    return tuple(i for i, on in flags.items() if on)


def client_type_predicate(ids: Iterable[int], col: str = "client_type_id") -> Column:
    """``client_type_id IN (...)``; an empty selection matches no row."""
    selected = tuple(sorted(set(int(i) for i in ids))) or (NO_CLIENT_TYPE,)
    return F.col(col).isin(*selected)
