"""When a drift check is announced.

| check | last announcement | previous check | announced |
|---|---|---|---|
| clean | any | any | no |
| drifted, forced | any | any | yes |
| drifted | within the least interval | any | no |
| drifted | longer ago, or none | clean, or none | yes: a new episode |
| drifted | at least the re-notify interval ago, or none | drifted | yes: a heartbeat |
| drifted | more recent | drifted | no: the same episode |

A failed announcement is forgotten, as if there had been none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from streamwarden.operators import intervals as I

CHECK, PUBLISH_FAILED = "check", "publish_failed"


@dataclass(frozen=True)
class GateSettings:
    renotify_seconds: float = 1800.0
    min_interval_seconds: float = 120.0


def replay_gate(checks: DataFrame, settings: GateSettings = GateSettings(), partitions: int | None = None) -> DataFrame:
    """``publish`` and ``publish_reason`` for (key, at, tie, kind, drifted, forced) rows."""
    is_check = F.col("kind") == CHECK
    drifted = is_check & F.coalesce("drifted", F.lit(False))
    effect = (
        F.when(F.col("kind") == PUBLISH_FAILED, I.CLEAR)
        .when(drifted & F.coalesce("forced", F.lit(False)), I.SET)
        .when(drifted, I.WAIT)
        .otherwise(I.NONE)
    )
    least = float(settings.min_interval_seconds)
    asked = checks.withColumns(
        {
            "effect": effect,
            "wait": F.lit(least),
            "wait_again": F.lit(max(least, float(settings.renotify_seconds))),
            "flag": F.when(is_check, drifted),
        }
    )
    seconds = F.format_string("%.0f s since the last announcement", F.col("at") - F.col("last"))
    fires, again, effect = F.col("fires"), F.col("again"), F.col("effect")
    reason = (
        F.when(effect == I.CLEAR, "failed announcement forgotten")
        .when(effect == I.NONE, "clean")
        .when(effect == I.SET, "forced")
        .when(fires & ~again, "new episode")
        .when(fires, "episode goes on: heartbeat")
        .when(F.col("at") - F.col("last") < least, F.concat(F.lit("too soon: "), seconds))
        .otherwise(F.concat(F.lit("same episode: "), seconds))
    )
    decided = I.replay_intervals(asked, partitions)
    return decided.select(*checks.columns, fires.alias("publish"), reason.alias("publish_reason"))
