"""Plan inspection through the public ``explain`` output.

Used by tests to pin plan properties: number of shuffle exchanges,
presence of a partial WindowGroupLimit, pushed filters, broadcast joins.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _tree(df: DataFrame) -> str:
    text = plan_text(df, "formatted")
    # The formatted mode prints the operator tree first, then details.
    return text.split("\n\n")[0] if "\n\n" in text else text


def count_operator(df: DataFrame, name: str) -> int:
    """Occurrences of a physical operator in the tree (before AQE runs)."""
    return len(re.findall(rf"[-+:\s]{re.escape(name)}\b", _tree(df)))


def shuffle_exchanges(df: DataFrame) -> int:
    """Hash/range/round-robin exchanges, not broadcasts."""
    tree = _tree(df)
    return len(re.findall(r"\bExchange\b", tree)) - len(re.findall(r"\bBroadcastExchange\b", tree))


def has_partial_group_limit(df: DataFrame) -> bool:
    """True when a top-k filter is planned as a map-side partial limit."""
    text = plan_text(df, "formatted")
    return re.search(r"\) WindowGroupLimit\s*\nInput[^\n]*\nArguments:[^\n]*Partial", text) is not None


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df, "formatted"))
