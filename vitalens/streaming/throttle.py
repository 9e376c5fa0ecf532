"""Sliding-log throttle per key, over a batch table or a stream.

A request is admitted when fewer than ``limit`` admitted requests lie within the
last ``window`` seconds; rejected requests are not recorded.  Which requests are
admitted depends on all earlier decisions of the key, so decisions are made in
time order, with a state of at most ``limit`` timestamps.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalens import lexicon as lx
from vitalens.operators import ordered
from vitalens.session import checkpointed

PIECE_WINDOWS = 64
DECISION = "key string, id bigint, micros bigint, admitted boolean, retry_after int, reason string"


class Ring:
    """The times, in microseconds, of the last ``limit`` admitted requests of one key.

    A request passes if the oldest of them has left the window: then fewer than
    ``limit`` are inside.
    """

    def __init__(self, limit: int, window: int, times=()):
        self.times = [*times][-limit:]
        self.limit, self.span = limit, window * 1_000_000

    def wait(self, now: int) -> int | None:
        """Admit at ``now`` and return None, or return the whole seconds until a place is free."""
        if len(self.times) == self.limit:
            free = self.times[0] + self.span
            if now <= free:
                return (free - now) // 1_000_000 + 1
            del self.times[0]
        self.times.append(now)
        return None


START = "key string, session bigint, piece bigint, ring array<bigint>"
STEP = "key string, session bigint, piece bigint, ring array<bigint>, ending array<bigint>"


def _rings(limit: int, window: int, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """Walk rows sorted by (key, session, piece, variant, micros, id), one ring at a time.

    A row without id opens a piece: its ring is what the piece starts from (else nothing).
    Yields each batch with the seconds to wait of its rows (None: admitted), and the pieces that
    ended in it: (row that opened it, ring at its end).
    """
    current, opened, ring = None, None, Ring(limit, window)
    for pdf in batches:
        waits, ended = [], []
        for row in zip(pdf["key"], pdf["session"], pdf["piece"], pdf["variant"], pdf["micros"], pdf["id"], pdf["ring"]):
            group, now, rid, start = row[:4], row[4], row[5], row[6]
            if group != current:
                if opened is not None:
                    ended.append((opened, ring.times))
                current, opened, ring = group, None, Ring(limit, window)
            if pd.isna(rid):
                opened, ring = row, Ring(limit, window, map(int, start))
                waits.append(None)
            else:
                waits.append(ring.wait(now))
        yield pdf, waits, ended
    if opened is not None:
        yield None, [], [(opened, ring.times)]


def _decide_sorted(limit: int, window: int):
    """Decisions on sorted rows; the rows that open pieces are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, waits, _ in _rings(limit, window, batches):
            if pdf is None:
                continue
            wait, asked = pd.Series(waits, dtype="Int32"), pdf["id"].notna().to_numpy()
            out = pd.DataFrame(
                {
                    "key": pdf["key"],
                    "id": pdf["id"],
                    "micros": pdf["micros"],
                    "admitted": wait.isna().to_numpy(),
                    "retry_after": wait,
                    "reason": wait.isna().map({True: None, False: "limit"}).astype("object"),
                }
            )
            yield out[asked].astype({"id": "int64"})

    return run


def _end_of_pieces(limit: int, window: int, span: int):
    """The rings that pieces end with, without times that have left the window by the next piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, ended in _rings(limit, window, batches):
            rows = []
            for (key, session, piece, _, _, _, ring), times in ended:
                until = session + (piece + 1) * span
                rows.append((key, session, piece, [*map(int, ring)], [t for t in times if t + window * 1_000_000 >= until]))
            yield pd.DataFrame(rows, columns=["key", "session", "piece", "ring", "ending"])

    return run


def _chain(steps: pd.DataFrame) -> pd.DataFrame:
    """Follow the known steps of one session from its first piece, which starts from nothing.

    Where they lead through, the starts of all pieces (wanted false); else the steps that
    are missing: from every known end of a piece on through the next (wanted true).
    """
    known: dict[int, dict[tuple, tuple]] = {}
    for piece, ring, ending in zip(steps["piece"], steps["ring"], steps["ending"]):
        known.setdefault(int(piece), {})[tuple(map(int, ring))] = tuple(map(int, ending))
    state, starts = (), []
    for piece in sorted(known):
        starts.append((piece, state))
        state = known[piece].get(state)
        if state is None:
            break
    done = state is not None
    missing = [(p + 1, e) for p in known if p + 1 in known for e in set(known[p].values()) if e not in known[p + 1]]
    out = pd.DataFrame([(p, [*r]) for p, r in (starts if done else missing)], columns=["piece", "ring"])
    out["key"], out["session"], out["wanted"] = steps["key"].iloc[0], steps["session"].iloc[0], not done
    return out[["key", "session", "piece", "ring", "wanted"]]


def _sorted_pieces(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (key, session, piece, variant, micros, id) behind the rows that open their pieces, in order."""
    opening = starts.select(
        "key", "session", "piece", "variant", F.lit(-(1 << 62)).alias("micros"), F.lit(None).cast("bigint").alias("id"), "ring"
    )
    every = rows.withColumn("ring", F.lit(None).cast("array<bigint>")).unionByName(opening)
    groups = ["key", "session", "piece", "variant"]
    return every.repartition(*groups).sortWithinPartitions(*groups, "micros", "id")


def _piece_starts(rows: DataFrame, limit: int, window: int, span: int) -> DataFrame:
    """(key, session, piece, ring): what each piece of a long session starts from.

    All pieces are run at once from nothing, then from the end of the piece before, and so on
    from every new end, until the steps lead through each session.  Where requests come at
    random, runs from different starts soon admit the same ones, and two rounds do.  Where they
    never meet, as with a steady beat, a round is needed for each different start.
    """
    pieces = rows.select("key", "session", "piece").distinct()
    asked = pieces.withColumn("ring", F.array().cast("array<bigint>"))
    steps = None
    while True:
        variant = F.xxhash64("ring")  # tells the starts of a piece apart within a round
        asked = checkpointed(asked.withColumn("variant", variant))
        copies = rows.join(asked.select("key", "session", "piece", "variant"), ["key", "session", "piece"])
        ran = _sorted_pieces(copies, asked).mapInPandas(_end_of_pieces(limit, window, span), STEP)
        steps = checkpointed(ran if steps is None else steps.unionByName(ran))
        chained = checkpointed(steps.groupBy("key", "session").applyInPandas(_chain, START + ", wanted boolean"))
        asked = chained.filter("wanted").drop("wanted")
        if asked.isEmpty():
            return chained.drop("wanted")


def throttle(
    requests: DataFrame,
    key: str,
    ts: str,
    request_id: str,
    limit: int = lx.THROTTLE_LIMITS["analyze"],
    window: int = lx.THROTTLE_WINDOW_SECONDS,
    bucket: str = "hour",
    piece_windows: int = PIECE_WINDOWS,
) -> DataFrame:
    """(key, id, micros, admitted, retry_after, reason) for a batch of requests.

    After a pause longer than the window the log is empty again, so a key is cut
    at its pauses and the sessions between are decided independently.  The cuts are found
    by bucketed windows, which never hold more than one time bucket of a key.  A session longer
    than ``piece_windows`` windows is cut further, into pieces of that length, whose starting
    logs are found by ``_piece_starts``; so a key that never pauses is spread over its pieces.
    The decisions stream through sorted partitions with a log of ``limit`` timestamps, so
    memory does not grow with a key.
    """
    base = requests.select(
        F.col(key).cast("string").alias("key"),
        F.col(request_id).cast("bigint").alias("id"),
        F.col(ts).alias("ts"),
        ordered.micros(requests, ts).alias("micros"),
    )
    seen = ordered.with_prior(base, ["key"], "ts", "id", ["micros"], bucket=bucket)
    fresh = F.col("prior").isNull() | (
        F.col("micros") - F.col("prior.micros") > window * 1_000_000
    )
    flagged = seen.select("key", "id", "ts", "micros", fresh.alias("fresh"))
    cut = ordered.with_prior(
        flagged, ["key"], "ts", "id", ["micros"], where=F.col("fresh"), bucket=bucket, out="opened"
    )
    session = F.when(F.col("fresh"), F.col("micros")).otherwise(F.col("opened.micros"))
    span = max(1, piece_windows) * window * 1_000_000  # at least a window: no piece is empty
    rows = cut.select("key", session.alias("session"), "id", "micros").withColumn(
        "piece", F.floor((F.col("micros") - F.col("session")) / span)
    )
    rows = checkpointed(rows)
    long = rows.filter("piece > 0").select("key", "session").distinct()
    many = checkpointed(rows.join(long, ["key", "session"], "left_semi"))
    starts = _piece_starts(many, limit, window, span) if not many.isEmpty() else rows.sparkSession.createDataFrame([], START)
    one = F.lit(0).cast("bigint").alias("variant")
    return _sorted_pieces(rows.select("*", one), starts.select("*", one)).mapInPandas(
        _decide_sorted(limit, window), DECISION
    )


class SlidingLog(StatefulProcessor):
    """Keyed state: the last admitted times, and the requests the watermark has not passed yet.

    Requests wait until the watermark passes them and are then decided in event order, so
    micro-batches out of order give the decisions of a batch.  They wait by time slot, and a
    timer reads the slots that are due and no others; a key that never pauses holds the
    requests within the lateness and reads each of them once, or twice in the slot the watermark
    stands in.  Admitted times are at most ``limit``.
    """

    SLOT = 60_000_000  # microseconds

    def __init__(self, limit: int, window: int):
        self.limit = limit
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "micros bigint")
        self.slots = handle.getValueState("slots", "numbers array<bigint>")
        self.waiting = handle.getMapState("waiting", "slot bigint", "micros array<bigint>, ids array<bigint>")

    def held(self) -> list[int]:
        """The numbers of slots with waiting requests, in order."""
        return [*self.slots.get()[0]] if self.slots.exists() else []

    def keep(self, slots: list[int]) -> None:
        if slots:
            self.slots.update((slots,))
        else:
            self.slots.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues)
        fresh: dict[int, tuple[list[int], list[int]]] = {}
        earliest = None
        for pdf in rows:
            late = pdf["micros"] <= passed
            if late.any():
                yield self.decided(key, [(m, i, None, "late") for m, i in zip(pdf["micros"][late], pdf["id"][late])])
            for m, i in zip(pdf["micros"][~late].tolist(), pdf["id"][~late].tolist()):
                micros, ids = fresh.setdefault(m // self.SLOT, ([], []))
                micros.append(m)
                ids.append(i)
                earliest = m if earliest is None else min(earliest, m)
        if earliest is None:
            return
        slots = self.held()
        for slot, (micros, ids) in fresh.items():
            if slot in slots:
                old = self.waiting.getValue((slot,))
                micros, ids = [*old[0], *micros], [*old[1], *ids]
            self.waiting.updateValue((slot,), (micros, ids))
        self.keep(sorted({*slots, *fresh}))
        self.wake(earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues)
        slots = self.held()
        due = slots[: bisect_right(slots, passed // self.SLOT)]
        waiting = sorted(r for slot in due for r in zip(*self.waiting.getValue((slot,))))
        ready = bisect_left(waiting, (passed + 1,))
        known = [m for (m,) in self.admitted.get()] if self.admitted.exists() else []
        ring = Ring(self.limit, self.window, known)
        out = []
        for now, rid in waiting[:ready]:
            wait = ring.wait(now)
            out.append((now, rid, wait, None if wait is None else "limit"))
        rest = waiting[ready:]  # all in the slot the watermark stands in
        for slot in due:
            if rest and slot == due[-1]:
                self.waiting.updateValue((slot,), ([m for m, _ in rest], [i for _, i in rest]))
            else:
                self.waiting.removeKey((slot,))
        later = slots[len(due) :]
        self.keep([*([due[-1]] if rest else []), *later])
        over = not rest and not later and (not ring.times or ring.times[-1] + ring.span < passed)
        if ring.times and not over:
            self.admitted.put([(m,) for m in ring.times])
        else:
            self.admitted.clear()
        if not over:  # else nothing is left to remember
            fired = expiredTimerInfo.getExpiryTimeInMs()
            # A later slot is opened at its beginning, when its first request is not read yet.
            ahead = rest[0][0] if rest else later[0] * self.SLOT if later else ring.times[-1] + ring.span
            self.wake(max(ahead, passed + 1, fired * 1000 + 1), fired)
        yield self.decided(key, out)

    @staticmethod
    def passed(timerValues) -> int:
        """The watermark in microseconds; before there is one, nothing is late."""
        return timerValues.getCurrentWatermarkInMs() * 1000 or -(1 << 62)

    def wake(self, micros: int, fired: int = -1) -> None:
        """One timer per key, at the earliest time asked for; the fired one counts no more."""
        at = -(-micros // 1000)
        known = [timer for timer in self.handle.listTimers() if timer > fired]
        if not known or at < min(known):
            for timer in known:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    @staticmethod
    def decided(key, rows: list[tuple]) -> pd.DataFrame:
        """rows: (micros, id, wait, reason); without a reason the request is admitted."""
        frame = pd.DataFrame(rows, columns=["micros", "id", "retry_after", "reason"]).astype({"micros": "int64", "id": "int64", "retry_after": "Int32", "reason": "object"})
        admitted = frame["reason"].map({"limit": False, "late": None}).where(frame["reason"].notna(), True)
        frame["admitted"], frame["key"] = admitted.astype("boolean"), key[0]
        return frame[["key", "id", "micros", "admitted", "retry_after", "reason"]]

    def close(self) -> None:
        pass


def throttle_stream(
    requests: DataFrame,
    key: str,
    ts: str,
    request_id: str,
    limit: int = lx.THROTTLE_LIMITS["analyze"],
    window: int = lx.THROTTLE_WINDOW_SECONDS,
    lateness: str = "1 minute",
) -> DataFrame:
    """Streaming form of ``throttle``; needs the RocksDB state store.

    A request is decided when the watermark passes it.  One that comes behind the watermark
    gets ``admitted`` null and reason ``late``; none is dropped.
    """
    base = requests.select(
        F.col(key).cast("string").alias("key"),
        F.col(request_id).cast("bigint").alias("id"),
        F.col(ts).cast("timestamp").alias("ts"),
    ).withWatermark("ts", lateness)
    # The event-time column itself stays behind, or Spark would drop late rows before the state sees them.
    return (
        base.select("key", "id", F.unix_micros("ts").alias("micros"))
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=SlidingLog(limit, window),
            outputStructType=DECISION,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def request_counts(requests: DataFrame, key: str, ts: str, width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """(key, window_start, n): requests of each key per sliding window; for tables and streams.

    A stream brings its own watermark on ``ts``.  Counts are partial before the shuffle, so a
    hot key is one row per window and task.
    """
    counted = requests.groupBy(F.col(key).cast("string").alias("key"), F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("key", F.col("w.start").alias("window_start"), "n")
