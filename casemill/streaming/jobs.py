"""Stream jobs: event log, decisions on new facts, votes, current status, retention.

Each job takes a streaming DataFrame and returns one, or starts a query; every sink keeps its checkpoint beside its
output on the shared file system. Batch twins live in the operators they reuse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from casemill import schemas
from casemill.operators import review as R
from casemill.operators.common import newest_per


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Log events as they arrive (ST1)."""
    return spark.readStream.schema(schemas.LOG_EVENT).json(path)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into a parquet table, then stop."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


def run_updates(stream: DataFrame, path: str, mode: str = "update") -> StreamingQuery:
    """Keep every update with the number of its batch; a repeated batch overwrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    with keyed_state(stream.sparkSession):
        return (stream.writeStream.outputMode(mode).foreachBatch(write)
                .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for queries started inside, which keep the setting; the session gets its own back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=<number>`` at a path, on whatever file system it is."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(root) if f.getPath().getName().startswith(f"{name}="))


def _updates(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest snapshot and all later batches, each row with its batch, and the number of the last batch."""
    bases, batches = _folders(spark, f"{path}/snapshot", "upto"), _folders(spark, f"{path}/data", "batch")
    upto = bases[-1] if bases else -1
    parts = [spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={n}" for n in batches if n > upto])] if batches and batches[-1] > upto else []
    if bases:
        parts.append(spark.read.parquet(f"{path}/snapshot/upto={upto}").withColumn("batch", F.lit(-1)))
    return reduce(DataFrame.unionByName, parts), max([upto, *batches])


def latest_updates(spark: SparkSession, path: str, keys: list[str], order: str = "batch") -> DataFrame:
    """Newest update per key of a table written by :func:`run_updates`, read from the newest snapshot on."""
    return newest_per(_updates(spark, path)[0], keys, [order]).drop("batch")


def compact_updates(spark: SparkSession, path: str, keys: list[str], order: str = "batch") -> None:
    """Write the newest update per key as a snapshot; readers then pass over all earlier batches.

    Batches that the newest snapshot covers are no longer read and may be removed by whoever keeps the folder.
    """
    rows, last = _updates(spark, path)
    newest_per(rows, keys, [order]).drop("batch").write.mode("overwrite").parquet(f"{path}/snapshot/upto={last}")


# ---- keyed state -----------------------------------------------------------

class _Leaving(StatefulProcessor):
    """State of a key that goes once the watermark is ``keep_ms`` past the newest row of the key.

    Rows older than the watermark are not seen any more, so nothing that is still to come could need it.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until_ms LONG")

    def stay(self, newest_ms: int) -> None:
        now = self.until.get()[0] if self.until.exists() else None
        then = newest_ms + self.keep_ms
        if now is None or then > now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.until.update((then,))
            self.handle.registerTimer(then)

    def close(self) -> None:
        pass


class LatestStatus(_Leaving):
    """The newest status of a case; a row comes out when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "status STRING, at_ms LONG")

    def handleInputRows(self, key, rows, timerValues):
        status, at_ms = self.newest.get() if self.newest.exists() else (None, None)
        best = None
        for r in rows:
            if at_ms is None or r.at_ms >= at_ms:
                status, at_ms, best = r.status, r.at_ms, r.since
        if best is not None:
            self.newest.update((status, at_ms))
            self.stay(at_ms)
            yield Row(key=key[0], status=status, since=best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        self.until.clear()
        return iter(())


def _millis(duration: str) -> int:
    n, unit = duration.split()
    return int(n) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def current_status(events: DataFrame, key: str, status: str, at: str, delay: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """Last status per case (ST5), for output mode "update". The state of a case without events for ``keep`` goes."""
    at_time = F.col(at).cast("timestamp")
    rows = events.select(F.col(key).alias("key"), F.col(status).alias("status"), at_time.alias("since"), F.unix_millis(at_time).alias("at_ms"))
    kind = dict(events.dtypes)[key]
    newest = rows.withWatermark("since", delay).groupBy("key").transformWithState(
        LatestStatus(_millis(keep)), f"key {kind}, status STRING, since TIMESTAMP", "update", "EventTime")
    return newest.select(F.col("key").alias(key), "status", F.col("since").cast(dict(events.dtypes)[at]).alias("since"))


def unexpired(lines: DataFrame, as_of: str) -> DataFrame:
    """Log lines still to be kept (ST6)."""
    return R.mark_expired(lines, as_of).filter(~F.col("expired")).drop("expired")


def once_per_input(packets: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """Decision inputs without repeats of the same case and hash (ST3)."""
    return packets.withWatermark(at, delay).dropDuplicatesWithinWatermark(["request_id", "inputs_hash"])


def decide_on_arrival(arrivals: DataFrame, path: str, decide_cases: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """New rows name cases; the batch decision job runs for those cases (ST2).

    ``decide_cases`` gets the distinct request ids of a batch and returns decisions, from all facts of those cases.
    """
    def write(batch: DataFrame, number: int) -> None:
        decided = decide_cases(batch.select("request_id").distinct())
        decided.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    return (arrivals.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True).start())


class Seat(_Leaving):
    """One person in one cycle of a case: whether they have a seat, and which of their votes counts.

    The earliest vote counts, whatever order votes come in; every other one is refused in the batch that shows it. A vote
    of a person without a seat waits for one, and is refused when the state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seat = handle.getValueState("seat", "seated BOOLEAN, action STRING, at_ms LONG, ref_id LONG")

    def handleInputRows(self, key, rows, timerValues):
        seated, action, at_ms, ref_id = old = self.seat.get() if self.seat.exists() else (False, None, None, None)
        sent, newest = 0, None
        for r in rows:
            if newest is None or r.at_ms > newest[0]:
                newest = (r.at_ms, r.at)
            if r.kind == "member":
                seated = True
                continue
            sent += 1
            loser = r.ref_id
            if ref_id is None or (r.at_ms, r.ref_id) < (at_ms, ref_id):
                loser, action, at_ms, ref_id = ref_id, r.action, r.at_ms, r.ref_id
            if loser is not None:
                yield self.told(key, r.at, refused=loser, reason="second vote")
        self.seat.update((seated, action, at_ms, ref_id))
        self.stay(newest[0])
        counted = lambda s: s[1] if s[0] and s[3] is not None else None
        gone, come = counted(old), counted((seated, action, at_ms, ref_id))
        had, has = (s[0] and s[3] is not None for s in (old, (seated, action, at_ms, ref_id)))
        yield self.told(key, newest[1], members=int(seated) - int(old[0]), sent=sent, votes=int(has) - int(had),
                        gone=gone if gone != come else None, come=come if gone != come else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seated, _, at_ms, ref_id = self.seat.get()
        self.seat.clear()
        self.until.clear()
        if not seated and ref_id is not None:
            yield self.told(key, datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000), refused=ref_id, reason="no seat")

    @staticmethod
    def told(key, at, members=0, sent=0, votes=0, gone=None, come=None, refused=None, reason=None) -> Row:
        return Row(request_id=key[0], review_cycle=key[1], person=key[2], at=at, members=members, sent=sent, votes=votes,
                   gone=gone, come=come, refused=refused, reason=reason)


SEAT_CHANGE = ("request_id LONG, review_cycle INT, person LONG, at TIMESTAMP, members INT, sent INT, votes INT, gone STRING, come STRING, "
               "refused LONG, reason STRING")


class Tally(_Leaving):
    """Counts of one cycle, kept from the changes of its seats; refused votes pass through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", TALLY)

    def handleInputRows(self, key, rows, timerValues):
        state = list(self.counts.get()) if self.counts.exists() else [0] * (4 + len(R.VOTE_PRIORITY))
        newest = None
        for r in rows:
            newest = r.at if newest is None or r.at > newest else newest
            state[0] += r.members
            state[1] += r.sent
            state[2] += r.votes
            for action, n in ((r.gone, -1), (r.come, 1)):
                if action in R.VOTE_PRIORITY:
                    state[4 + R.VOTE_PRIORITY.index(action)] += n
            if r.refused is not None:
                yield self.row(key, state, "refused", r)
        state[3] += 1
        self.counts.update(tuple(state))
        self.stay(int(newest.timestamp() * 1000))
        yield self.row(key, state, "tally", None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.counts.clear()
        self.until.clear()
        return iter(())

    @staticmethod
    def row(key, state, kind, r) -> Row:
        return Row(request_id=key[0], review_cycle=key[1], kind=kind, person=r.person if r else None, refused=r.refused if r else None,
                   reason=r.reason if r else None, **dict(zip(("n_members", "n_sent", "n_votes", "version", *R.VOTE_PRIORITY), state)))


TALLY = "n_members LONG, n_sent LONG, n_votes LONG, version LONG, " + ", ".join(f"{a} LONG" for a in R.VOTE_PRIORITY)


def seat_changes(seats_and_votes: DataFrame, delay: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """What each batch changes for each person of a cycle, and the votes it refuses (ST4).

    Rows: request_id, review_cycle, kind ('member' or 'vote'), person, action, at, ref_id. State is one small row for each
    person, and goes ``keep`` after their last row; a cycle must not last longer.
    """
    at = F.col("at").cast("timestamp")
    rows = seats_and_votes.select(*R.CYCLE, "person", "kind", "action", at.alias("at"), F.unix_millis(at).alias("at_ms"), "ref_id")
    return rows.withWatermark("at", delay).groupBy(*R.CYCLE, "person").transformWithState(
        Seat(_millis(keep)), SEAT_CHANGE, "append", "EventTime", eventTimeColumnName="at")


def vote_results(seats_and_votes: DataFrame, delay: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """A 'tally' row for each cycle that a batch touches, and a 'refused' row for each vote it refuses (ST4).

    The first operator keeps persons apart, so the many rows of a busy cycle are spread over tasks; the second gets one
    change for each person and batch. A decision falls in the batch in which the last member votes. For output mode "append".
    """
    tallies = seat_changes(seats_and_votes, delay, keep).groupBy(*R.CYCLE).transformWithState(
        Tally(_millis(keep)), f"request_id LONG, review_cycle INT, kind STRING, person LONG, refused LONG, reason STRING, {TALLY}",
        "append", "EventTime")
    complete = (F.col("n_members") > 0) & (F.col("n_votes") >= F.col("n_members"))
    return tallies.select(*R.CYCLE, "kind", "person", "refused", "reason", "n_votes", (F.col("n_sent") - F.col("n_votes")).alias("n_rejected"),
                          "n_members", complete.alias("complete"), F.when(complete, R.final_pick()).alias("final_decision"), "version")


def latest_tallies(spark: SparkSession, path: str) -> DataFrame:
    """The newest tally of each cycle of a table written from :func:`vote_results`."""
    rows = _updates(spark, path)[0].filter("kind = 'tally'")
    return newest_per(rows, R.CYCLE, ["version"]).drop("batch", "kind", "person", "refused", "reason", "version")


def refused_votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes refused so far, with the reason."""
    return spark.read.parquet(f"{path}/data").filter("kind = 'refused'").select(*R.CYCLE, "person", F.col("refused").alias("ref_id"), "reason")
