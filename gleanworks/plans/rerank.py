"""Optional second opinion on the best rows: one call of a pluggable judge for at most top_n of them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanworks.plans.config import Config

NOTES = "dedup_key string, llm_score string, llm_note string"


def profile(cfg: Config) -> str:
    """What the judge is told about the wish: the eighteen heaviest keywords."""
    top = sorted(cfg.fit_weights.items(), key=lambda x: -x[1])[:18]
    return "Values (highest-weight signals): " + ", ".join(k for k, _ in top) + "." + (" Remote required." if cfg.remote_only else "")


def parsed(reply: str, keys: list[str]) -> list[tuple[str, str, str]]:
    """The reply's array, from the first [ to the last ]; items that don't fit are skipped."""
    first, last = reply.find("["), reply.rfind("]")
    try:
        items = json.loads(reply[first : last + 1]) if 0 <= first < last else []
    except ValueError:
        items = []
    out = []
    for x in items:
        try:
            i, fit = int(x["id"]), int(x.get("fit") or 0)
            if 0 <= i < len(keys):
                out.append((keys[i], str(fit), str(x.get("note", ""))[:160]))
        except (KeyError, TypeError, ValueError, AttributeError):
            continue
    return out


def rerank(spark: SparkSession, surfaced: DataFrame, cfg: Config, judge: Callable[[str], str] | None, top_n: int = 25) -> DataFrame:
    """Notes by dedup_key; none without a judge, or if it fails."""
    if judge is None:
        return spark.createDataFrame([], NOTES)
    rows = surfaced.select("dedup_key", "title", "company").limit(top_n).collect()
    items = [{"id": i, "title": r.title, "company": r.company} for i, r in enumerate(rows)]
    try:
        found = parsed(judge(f"PROFILE:\n{profile(cfg)}\n\nPOSTINGS:\n{json.dumps(items)}"), [r.dedup_key for r in rows])
    except Exception:  # noqa: BLE001  the message may hold a key: nothing of it is shown
        found = []
    return spark.createDataFrame(found, NOTES)
