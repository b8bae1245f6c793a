"""Feature-column selection by name tokens (pure function over a column list)."""
from __future__ import annotations

from typing import Iterable

from spreadforge.config import ALWAYS_EXCLUDE, TARGET_PREFIXES, TIME_FEATURES

# helper columns of this engine (row position, series keys) are never features
ENGINE_COLUMNS = ("idx",)


def build_xcols(columns: Iterable[str], tokens: Iterable[str],
                always: Iterable[str] = (), strict_gate_horizon: str | None = None) -> list[str]:
    """Sorted feature names for one transition.

    A column is kept when it is a time feature, an always-include column, or its
    upper-cased name contains one of the (upper-cased) tokens; the excluded
    names and target prefixes never pass.  With ``strict_gate_horizon`` (for
    example ``"DAM"``) revisions that mention a later auction are dropped.
    """
    columns = list(columns)
    toks = [t.upper() for t in tokens]
    always = set(always)
    keep = set()
    for c in columns:
        if c in ALWAYS_EXCLUDE or c in ENGINE_COLUMNS or c.startswith(TARGET_PREFIXES):
            continue
        if c in TIME_FEATURES or c in always or any(t in c.upper() for t in toks):
            keep.add(c)
    out = sorted(keep)
    if strict_gate_horizon:
        order = ["DAM", "IDA1", "IDA2", "IDA3"]
        later = order[order.index(strict_gate_horizon) + 1:]
        out = [c for c in out if not ("revision" in c and any(f"revision_{h}" in c for h in later))]
    return out
