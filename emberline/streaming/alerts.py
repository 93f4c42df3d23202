"""Alert lifecycle as keyed state: one small record per alert.

The actions of one alert are ordered within a micro-batch only, so the source's
admission limit (for files ``maxFilesPerTrigger``) bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "alert_id long, seq long, action string, accepted boolean, from_tier int, to_tier int, status string"
STATE = "tier int, status string"
_NEXT_STATUS = {"ACKNOWLEDGE": "ACKNOWLEDGED", "ESCALATE": "ESCALATED", "RESOLVE": "RESOLVED"}


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tier, status = state.get if state.exists else (1, "NEW")
    # Order matters within the micro-batch only; earlier batches are in the state.
    rows = pd.concat(list(batches)).sort_values(["at", "seq"])
    out = []
    for seq, action, caller in zip(rows["seq"], rows["action"], rows["caller_tier"]):
        accepted = action != "ESCALATE" or (tier < 3 and (pd.isna(caller) or int(caller) == tier))
        before = tier
        if accepted:
            tier += action == "ESCALATE"
            status = _NEXT_STATUS[action]
        out.append((key[0], seq, action, bool(accepted), before, tier, status))
    state.update((int(tier), status))
    yield pd.DataFrame(out, columns=["alert_id", "seq", "action", "accepted", "from_tier", "to_tier", "status"])


def stream_alerts(actions: DataFrame) -> DataFrame:
    """Every action with the decision, tiers and resulting status, in arrival order per alert."""
    return (actions.select("alert_id", "seq", "at", "action", "caller_tier").groupBy("alert_id")
            .applyInPandasWithState(_apply, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout))
