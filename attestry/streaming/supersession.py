"""Supersession over a stream of facts: each subject keeps its holder as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUT = "subject string, id string, status string, other string"


def stream_supersede(facts: DataFrame) -> DataFrame:
    """Changes of status of a stream ``facts(subject, id, valid_from, arrival)``, in order of arrival within a batch.

    A new holder gives its own row as verified and its predecessor's as superseded by it; an older arrival
    is superseded by the holder. State is one row per subject; without a subject a fact is verified and has
    no state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("arrival")
        out = []
        for r in rows.itertuples(index=False):
            if held is None or r.valid_from >= held[1]:
                if held is not None:
                    out.append((key[0], held[0], "superseded", r.id))
                out.append((key[0], r.id, "verified", None))
                held = (r.id, r.valid_from)
            else:
                out.append((key[0], r.id, "superseded", held[0]))
        state.update(held)
        yield pd.DataFrame(out, columns=["subject", "id", "status", "other"])

    named = F.coalesce("subject", F.lit("")) != ""
    held = facts.filter(named).groupBy("subject").applyInPandasWithState(step, OUT, "id string, valid_from string", "append", "NoTimeout")
    alone = facts.filter(~named).select("subject", "id", F.lit("verified").alias("status"), F.lit(None).cast("string").alias("other"))
    return held.union(alone)
