"""The execution ledger as a stateful stream: one state a run, sessions in order, a snapshot row a session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelspark.operators.execution import NUMBERS, CostModel, Ledger

OUT = "run_id string, date date, " + ", ".join(f"{c} double" for c in NUMBERS[:12])


def stream_ledger(rows: DataFrame, costs: CostModel, cash: float = 1e7) -> DataFrame:
    """rows: a stream of (run_id, date, ticker, price, target_weight), each session whole in one micro-batch, sessions
    in order. Sessions already booked are passed over, so that a batch that runs again changes nothing."""

    def book(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger = Ledger(costs, cash)
        booked = ""
        if state.exists:
            booked, ledger.cash, ledger.equity, shares, last, pending = state.get
            ledger.shares, ledger.last_price = json.loads(shares), json.loads(last)
            ledger.pending = [tuple(p) for p in json.loads(pending)]
        out = []
        for day, part in pd.concat([*frames]).groupby("date", sort=True):
            if str(day) <= booked:
                continue
            prices = {t: p for t, p in zip(part["ticker"], part["price"]) if p == p and p is not None}
            weights = {t: w for t, w in zip(part["ticker"], part["target_weight"]) if w == w and w is not None}
            snapshot, _, _ = ledger.session(day, prices, weights)
            out.append({"run_id": key[0], **snapshot})
            booked = str(day)
        state.update((booked, ledger.cash, ledger.equity, json.dumps(ledger.shares), json.dumps(ledger.last_price), json.dumps(ledger.pending)))
        yield pd.DataFrame(out, columns=["run_id", "date", *NUMBERS[:12]])

    return rows.groupBy("run_id").applyInPandasWithState(book, OUT, "booked string, cash double, equity double, shares string, last string, pending string", "append", GroupStateTimeout.NoTimeout)
