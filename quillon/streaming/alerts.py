"""At-most-once alerts: one state machine for batch and stream, and its log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.dates import is_expired
from quillon.functions.numbers import salted_hash

#: Events; matched is terminal and blocks all, expired blocks itself, confirmed comes once.
CONFIRMED, MATCHED, EXPIRED = "confirmed", "matched", "expired"
SCOPE = ("email", "party_size", "dates", "date_start", "date_end", "sessions", "venues")


def step(state: frozenset[str], has_match: bool, expired: bool) -> tuple[frozenset[str], str | None]:
    """(new state, event or None) of one preference scope; state holds the events that were sent."""
    if MATCHED in state:
        return state, None
    event = MATCHED if has_match else EXPIRED if expired and EXPIRED not in state else CONFIRMED if CONFIRMED not in state else None
    return (state | {event}, event) if event else (state, None)


def scope_key(salt: str):
    """Hash of a subscription's preferences; two rows with the same preferences are one scope."""
    parts = [F.lower("email"), *[F.to_json(F.col(c)) if c in ("dates", "sessions", "venues") else F.col(c) for c in SCOPE[1:]]]
    return salted_hash(salt, *parts)


def slot_key(salt: str):
    return salted_hash(salt, F.lower("email"), *[F.col(c) for c in ("party_size", "venue_id", "date", "meal", "time", "seats")])


def due_events(subscriptions: DataFrame, matches: DataFrame, log: DataFrame, today, salt: str, ordinal: str = "ordinal", limit: int | None = None) -> DataFrame:
    """Events to send now, one per scope: subscriptions (sub_id, ordinal, ...), matches (sub_id), log (sent_key,
    event). With a limit, the first in input order; a limit of 0 still sends one, as the check follows the send."""
    hit = matches.select(F.col("sub_id").alias("m_")).distinct()
    rows = subscriptions.withColumn("sent_key", scope_key(salt)).join(hit, F.col("sub_id") == F.col("m_"), "left").withColumn("has_match", F.col("m_").isNotNull()).withColumn("expired", is_expired("dates", "date_start", "date_end", today))
    first = rows.groupBy("sent_key").agg(F.max("has_match").alias("has_match"), F.max("expired").alias("expired"), F.min_by(F.struct("sub_id", "email", ordinal), ordinal).alias("s"))
    past = log.groupBy(F.col("sent_key").alias("k_")).agg(F.collect_set("event").alias("past"))
    seen = first.join(past, F.col("sent_key") == F.col("k_"), "left").withColumn("past", F.coalesce("past", F.array().cast("array<string>")))
    done = lambda e: F.array_contains("past", e)
    event = F.when(done(MATCHED), None).when(F.col("has_match"), MATCHED).when(F.col("expired") & ~done(EXPIRED), EXPIRED).when(~done(CONFIRMED), CONFIRMED)
    out = seen.withColumn("event", event).filter("event is not null").select("sent_key", "s.*", "event")
    return out.orderBy(ordinal).limit(max(1, limit)) if limit is not None else out


def append_log(sent: DataFrame, path: str, at) -> None:
    """Log of what was sent, written after the send succeeded."""
    sent.select("sent_key", "event", at.cast("timestamp").alias("sent_at")).write.mode("append").parquet(path)


def alert_processor():
    """StatefulProcessor over (scope, has_match, expired) rows: the same step with the sent events as state.

    A scope's rows may come in several frames, in any order. Only the first two rows by seq of each kind (match,
    expired, open) can cause events, so no more of them are held, and they are stepped through in seq order at the end.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Alerts(StatefulProcessor):
        def init(self, handle) -> None:
            self.sent = handle.getValueState("sent", "events string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = self.sent.get()
            state, out = frozenset((held[0] or "").split(",")) - {""} if held else frozenset(), []
            first = pd.DataFrame({"seq": [], "has_match": [], "expired": []}).astype({"seq": "int64", "has_match": bool, "expired": bool})
            for pdf in rows:
                new = pd.DataFrame({"seq": pdf["seq"], "has_match": pdf["has_match"].eq(True), "expired": pdf["expired"].eq(True)})
                every = pd.concat([first, new]).sort_values("seq", kind="stable")
                first = every[every.groupby([every["has_match"], every["expired"] & ~every["has_match"]]).cumcount() < 2]
            for r in first.itertuples():
                state, event = step(state, bool(r.has_match), bool(r.expired))
                if event:
                    out.append((key[0], event, int(r.seq)))
            self.sent.update((",".join(sorted(state)),))
            yield pd.DataFrame(out, columns=["scope", "event", "seq"])

        def close(self) -> None:
            pass

    return Alerts()


def stream_alerts(events: DataFrame) -> DataFrame:
    """Streaming (scope, seq, has_match, expired) -> (scope, event, seq), at most one of each event per scope across
    restarts; needs the RocksDB state store."""
    return events.groupBy("scope").transformWithStateInPandas(statefulProcessor=alert_processor(), outputStructType="scope string, event string, seq long", outputMode="Append", timeMode="None")


def idempotent_sink(write):
    """foreachBatch function that calls write(df, batch_id) for non-empty batches; a repeated batch id has to
    overwrite what it wrote before, which write does by putting the id in its path."""
    def run(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            write(df, batch_id)

    return run


def unsubscribe(subscriptions: DataFrame, tokens: DataFrame, salt: str) -> DataFrame:
    """All rows of an address are disabled if one valid token (hash of the address) came back."""
    t = tokens.select(F.col("token").alias("t_")).distinct()
    out = subscriptions.withColumn("h_", salted_hash(salt, F.lower("email"))).join(t, F.col("h_") == F.col("t_"), "left")
    return out.withColumn("enabled", F.when(F.col("t_").isNotNull(), False).otherwise(F.col("enabled"))).drop("h_", "t_")
