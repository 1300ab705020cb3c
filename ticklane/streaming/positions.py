"""Day-to-day position state as a stream: a keyed state for each code with a timer for entries that are not filled, orders as they arise."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ticklane.operators.backtest import CONFIRM_DAYS, HARD_STOP

ORDERS = "code {code}, date date, side string, reason string, price double"
STATE = "status string, since date, out_counter int, last_date date"
#: Days after its signal up to which an entry may be filled.
LAPSE_DAYS = 7
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# The worker that sets a stateful query up does not see files that were added to the session: the processor travels as a whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _millis(day: date) -> int:
    return (day - date(1970, 1, 1)).days * 86_400_000


class Positions(StatefulProcessor):
    """PENDING_ENTRY from the signal until the code's next row, which fills it, or until LAPSE_DAYS are over; then OPEN until it is sold.

    since: the day of the signal (PENDING_ENTRY) or of the entry (OPEN).  A pending entry has a timer at the end of its last day, so it
    lapses even if no row of the code comes any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("position", STATE)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        since = None if pd.isna(row["since"]) else row["since"]
        if row["status"] == "PENDING_ENTRY" and since is not None:
            self.handle.registerTimer(_millis(since) + (LAPSE_DAYS + 1) * 86_400_000 - 1)
        self.state.update((row["status"], since, int(row["out_counter"]), since))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, since, out, last = self.state.get() if self.state.exists() else (None, None, 0, None)
        orders: list[tuple] = []
        every = pd.concat(list(rows)).sort_values("date", kind="stable")
        for day, price, mae, on_top in zip(every["date"], every["open"], every["pred_mae"], every["on_top"], strict=True):
            if last is not None and day <= last:
                continue
            last = day
            if status == "PENDING_ENTRY":
                self.handle.deleteTimer(_millis(since) + (LAPSE_DAYS + 1) * 86_400_000 - 1)
                if (day - since).days <= LAPSE_DAYS:
                    orders.append((key[0], day, "BUY", "enter_topcap", price))
                    status, since, out = "OPEN", day, 0 if on_top else 1
                    continue
                orders.append((key[0], since + timedelta(LAPSE_DAYS), "CANCEL", "entry_lapsed", None))
                status = None
            if status == "OPEN":
                out = 0 if on_top else out + 1
                reason = "risk_hard_stop" if mae < HARD_STOP else "out_of_topcap" if out >= CONFIRM_DAYS else None
                if reason:
                    orders.append((key[0], day, "SELL", reason, price))
                    status, since, out = None, None, 0
            elif on_top and mae >= HARD_STOP:
                status, since, out = "PENDING_ENTRY", day, 0
                self.handle.registerTimer(_millis(day) + (LAPSE_DAYS + 1) * 86_400_000 - 1)
        self.state.update((status, since, out, last))
        yield pd.DataFrame(orders, columns=["code", "date", "side", "reason", "price"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        status, since, _, last = self.state.get() if self.state.exists() else (None, None, 0, None)
        orders = []
        if status == "PENDING_ENTRY" and _millis(since) + (LAPSE_DAYS + 1) * 86_400_000 - 1 == expiredTimerInfo.getExpiryTimeInMs():
            orders.append((key[0], since + timedelta(LAPSE_DAYS), "CANCEL", "entry_lapsed", None))
            self.state.update((None, None, 0, last))
        yield pd.DataFrame(orders, columns=["code", "date", "side", "reason", "price"])

    def close(self) -> None:
        pass


def position_orders(preds: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """BUY, SELL and CANCEL orders from a stream of daily rows (code, date, open, pred_mae, on_top).

    A code that is on top is to be bought, at the open of its next row within LAPSE_DAYS; one that breaks the hard stop or is off the top for
    CONFIRM_DAYS rows is sold.  positions: what is held before the first row (code, status, since, out_counter).  Rows of a day that
    the code has seen are passed over.  The watermark follows the newest day: rows should come day by day, or in files of
    ascending days.
    """
    kind = preds.schema["code"].dataType.simpleString()
    day = F.timestamp_seconds(F.unix_date("date") * 86_400)  # in UTC, whatever the session's zone
    rows = preds.withColumn("_day", day).withWatermark("_day", "0 seconds").groupBy("code")
    held = positions.select("code", "status", "since", "out_counter").groupBy("code") if positions is not None else None
    return rows.transformWithStateInPandas(Positions(), ORDERS.format(code=kind), "Append", "EventTime", initialState=held)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in the store that keyed state with timers needs."""
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROCKS[0])
        else:
            spark.conf.set(_ROCKS[0], before)


def run_to_end(spark: SparkSession, inbox: str, schema, orders: str, checkpoint: str, positions: DataFrame | None = None) -> DataFrame:
    """Take the files of the inbox that the checkpoint has not seen, one batch a file, append the orders and return all of them."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    with keyed_state(spark):
        found = position_orders(stream, positions)
        query = found.writeStream.format("parquet").option("path", orders).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(found.schema).parquet(orders)


def with_top(preds: DataFrame, top: DataFrame) -> DataFrame:
    return preds.join(top.select("date", "code", F.lit(True).alias("on_top")), ["date", "code"], "left").fillna({"on_top": False})
