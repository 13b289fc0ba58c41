"""Decisions on ids put into effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import stage

#: Ids that may be broadcast; more of them meet the documents in a shuffle.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, id_col: str, decided: DataFrame) -> DataFrame:
    """The rows of `docs` without those whose id is decided against and never for. decided: (_id, _stays).

    The ids that go are written first. Where they are few the documents are not shuffled.
    """
    gone = stage(decided.groupBy("_id").agg(F.bool_or("_stays").alias("_stays")).where("not _stays").select("_id"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs[id_col].eqNullSafe(gone["_id"]), "left_anti")
