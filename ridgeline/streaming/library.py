"""The learning template library as a stream: one state per identity."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgeline.operators.library import LOG, learn


def learning_stream(rows: DataFrame, threshold: float = 0.55, size: int = 5) -> DataFrame:
    """The decisions of learning_log for a stream of rows (identity, kind, ord, query, content, score, matched, admissible);
    write it in append mode.

    Rows of kind 0 seed a library (query is the template), others are attempts. Rows of an identity that arrive in one
    micro-batch go by kind, ord and query; a state holds one library of bounded size.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, out = json.loads(state.get[0]) if state.exists else [], []
        for r in pd.concat(list(frames)).sort_values(["kind", "ord", "query"]).itertuples():
            if r.kind == 0:
                entries.append([r.query, r.content, True])
                continue
            got = learn(entries, r.query, r.content, None if pd.isna(r.score) else r.score, r.matched, bool(r.admissible), threshold, size)
            out.append((key[0], r.ord, r.query, *got, [e[0] for e in entries]))
        state.update((json.dumps(entries),))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in LOG.split(", ")])

    return rows.groupBy("identity").applyInPandasWithState(run, LOG, "library string", "append", GroupStateTimeout.NoTimeout)
