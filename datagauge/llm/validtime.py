"""Valid-time enrichment: sales take the version of their client that was valid when they were sold, in one stateful stage.

Rows come in batches. A table's watermark is the largest time of its earlier batches less ``DELAY``; the horizon H is the smaller of the two. The
stage is keyed by a hash of the client. Its *gate* holds sales until their time is below H; for those that it releases the stage adds the batch's
changes to the client's versions, answers, and only then prunes: of the versions up to H the last stays. Changes below their table's watermark are
late and become no version. Gate and versions share a store: Spark leaves the statistics of each store that it opens, 0.5 MB on 8 cores, in the
executor's memory for good, and each start opens one for every partition of every stage.

A key of the stage is a piece: a share of all clients. Its state is an Arrow-encoded value for the sales and one for the versions, so that a call
handles many rows at once. ``pieces_for`` sets the number of pieces by the input; it stays for the life of a checkpoint. Each batch sends every piece
a tick with the batch's number and limits: pieces without rows release and prune all the same, and a batch that is repeated finds the same limits in
its files.

A hot client (more than ``HOT_ROWS`` rows, and more than one in ``HOT_SHARE`` of all) would fill one piece. Its time is cut into slots of ``SLOT``,
and the slot modulo ``RING`` is part of the key. A piece answers within a sale's slot, and states of each slot how many versions it has that no
pruning has met, the last of these, and the survivor of the last pruning. ``resolved`` puts this together by batch and client: a sale without a
version in its slot takes the last one of the slots before, and of a client's survivors only the latest counts, as pruning across slots would have
left no other. A client has ``RING`` survivors in the state at most.

Null times of a sale: released at once, without a version. Null clients: without versions, ``n_held`` 0; a change without a client is late or of no
use. Changes that are equal in every column count once; null ``valid_at`` are ignored. Null seq and change_id come before all others; versions equal in
(valid_at, seq, change_id) each count, and the one with the larger balance, then op, is the later. Null ``arrived_at`` and null change_id fall
into the last batch, days before the first into batch 0. Repeated sales each get their row. Empty tables give no rows. Extra columns are ignored,
but tell changes apart.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import store

DELAY = 36 * 3600 * 1_000_000
BATCHES, FIRST_DAY, DAYS = 10, 19723, 152
HOT_ROWS, HOT_SHARE = 50_000, 1 << 16
SLOT, RING = 6 * 3600 * 1_000_000, 64
#: Rows of all batches for each piece, and the least pieces.
PIECE_ROWS, LEAST_PIECES = 100_000, 64

#: A limit before and one after all times; null numbers, before all others.
NEVER, ALWAYS, NULL = -(1 << 62), 1 << 62, -(1 << 63)
#: Kinds of rows.
TICK, SALE, CHANGE, LATE, HELD, SURVIVOR = range(6)
#: Bits of a row: null columns; of a hot client; met by the last pruning.
NO_ID, NO_CLIENT, NO_TIME, NO_BALANCE, HOT, MET = (1 << i for i in range(6))
#: Rows of the feed. ``at``: a sale's time or a change's valid_at. Of a tick, ``at`` is H and ``seq`` the changes' watermark.
ROW = "piece long, kind int, bits int, id long, client long, at long, slot long, seq long, balance long, op string, batch int"
#: Answers; of hot clients the versions held in each slot and the survivors. The version's columns are filled if ``v_bits`` is not negative.
ANSWER = "kind int, batch int, bits int, id long, client long, at long, slot long, n_held long, v_at long, v_seq long, v_id long, v_balance long, v_op string, v_bits int"

_SALE = ["bits", "id", "client", "at", "slot"]
_VERSION = ["bits", "id", "client", "at", "slot", "seq", "balance", "op"]
#: Settings of a start: state in RocksDB, whose changes are written instead of whole snapshots, within a bound of an executor's memory, without 4 MB reserved on disk for each store; a start runs one batch, so stores are given up when it is committed.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def _read(state, columns: list[str]) -> pd.DataFrame | None:
    value = state.get()
    return None if value is None else pa.ipc.open_stream(value[0]).read_all().to_pandas()[columns]


def _write(state, frame: pd.DataFrame) -> None:
    if not len(frame):
        state.clear()
        return
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def _split(rows: Iterator[pd.DataFrame]) -> tuple[pd.Series, pd.DataFrame]:
    """A batch's tick and its other rows."""
    frame = pd.concat(list(rows), ignore_index=True)
    is_tick = frame["kind"].to_numpy() == TICK
    if is_tick.sum() != 1:
        raise ValueError(f"a piece takes one tick a batch, not {is_tick.sum()}")
    return frame[is_tick].iloc[0], frame[~is_tick]


class Versions(StatefulProcessor):
    """Takes a batch's changes, answers the sales whose time is below H, holds the others, prunes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rows binary")
        self.kept = handle.getValueState("kept", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        tick, new = _split(rows)
        kind = new["kind"].to_numpy()
        sales, changes = self._released(new[kind == SALE][_SALE], tick["at"]), new[kind == CHANGE]
        late = changes["at"].to_numpy() < tick["seq"]
        if late.any():
            yield _answers(changes[late], LATE, tick["batch"])
        changes = changes[~late & ((changes["bits"].to_numpy() & NO_CLIENT) == 0)][_VERSION]
        kept = _read(self.kept, _VERSION)
        versions = changes if kept is None else pd.concat([kept, changes], ignore_index=True) if len(changes) else kept
        if len(sales) or len(versions):
            yield from answer(versions, sales, tick["batch"])
        if len(versions):
            _write(self.kept, prune(versions, tick["at"]))

    def _released(self, new: pd.DataFrame, horizon: int) -> pd.DataFrame:
        """New and held sales that the gate lets through; it holds the rest."""
        held = _read(self.held, _SALE)
        sales = new if held is None else pd.concat([held, new], ignore_index=True) if len(new) else held
        go = ((sales["bits"].to_numpy() & NO_TIME) > 0) | (sales["at"].to_numpy() < horizon)
        if go.any() if held is not None and not len(new) else held is not None or not go.all():
            _write(self.held, sales[~go])
        return sales[go]

    def close(self) -> None:
        pass


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _order(versions: pd.DataFrame, *first: np.ndarray) -> np.ndarray:
    """Positions of versions by ``first`` (the most significant last), then (at, seq, id, balance, op)."""
    op = pd.factorize(versions["op"].fillna(""), sort=True)[0]
    return np.lexsort([op, versions["balance"], versions["id"], versions["seq"], versions["at"], *first])


def prune(versions: pd.DataFrame, horizon: int) -> pd.DataFrame:
    """Without versions up to the horizon, but for the last of each client (of a hot one: in each part of its ring), which is marked as met."""
    old = versions["at"].to_numpy() <= horizon
    if not old.any():
        return versions
    past = versions[old]
    ring, client = past["slot"].to_numpy() % RING, past["client"].to_numpy()
    order = _order(past, ring, client)
    last = np.append((np.diff(client[order]) != 0) | (np.diff(ring[order]) != 0), True)
    past = past.iloc[order[last]]
    return pd.concat([past.assign(bits=past["bits"] | MET), versions[~old]], ignore_index=True)


def _answers(rows: pd.DataFrame, kind: int, batch: int, n_held: np.ndarray | int = 0, versions: pd.DataFrame | None = None, found: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of ANSWER for sales, changes or slots; ``found`` are positions in ``versions``, negative for none."""
    out = rows[["bits", "id", "client", "at", "slot"]].reset_index(drop=True).assign(kind=kind, batch=batch, n_held=n_held)
    if versions is None or not len(versions):
        return out.assign(v_at=0, v_seq=0, v_id=0, v_balance=0, v_op=None, v_bits=-1)[_columns(ANSWER)]
    v = versions.iloc[np.maximum(found, 0)].reset_index(drop=True)
    return out.assign(**{f"v_{c}": v[c] for c in ("at", "seq", "id", "balance", "op")}, v_bits=np.where(found >= 0, v["bits"], -1))[_columns(ANSWER)]


def answer(versions: pd.DataFrame, sales: pd.DataFrame, batch: int) -> Iterator[pd.DataFrame]:
    """Each sale with the last version of its client (and slot) up to its time, and how many there are; the states of hot clients' slots.

    One sort of versions and sales together, by client, slot and time: the last version before a sale in this order is its version.
    """
    versions = versions.iloc[_order(versions, versions["slot"].to_numpy(), versions["client"].to_numpy())].reset_index(drop=True)
    n = len(versions)
    client, slot, at, bits = (np.concatenate([versions[c].to_numpy(np.int64), sales[c].to_numpy(np.int64)]) for c in ("client", "slot", "at", "bits"))
    order = np.lexsort([np.arange(len(at)) >= n, at, slot, client])  # stable: versions stay in their order
    new_group = np.append(True, (np.diff(client[order]) != 0) | (np.diff(slot[order]) != 0))
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new_group) - 1
    last = np.empty(len(at), np.int64)
    last[order] = np.maximum.accumulate(np.where(order < n, order, -1))
    held = np.bincount(group[:n], minlength=group.max() + 1)
    if len(sales):
        of_client = (bits[n:] & NO_CLIENT) == 0
        found = last[n:]
        fits = (found >= 0) & of_client & ((bits[n:] & NO_TIME) == 0)
        if n:
            fits &= group[np.maximum(found, 0)] == group[n:]
        yield _answers(sales, SALE, batch, np.where(of_client, held[group[n:]], 0), versions, np.where(fits, found, -1))
    hot = (bits & HOT) > 0
    if hot.any():
        # One row a slot: where its group begins. Versions that a pruning met are survivors, one a slot at most; the others are held.
        starts = order[new_group]
        slots = pd.DataFrame({"bits": HOT, "id": 0, "client": client[starts], "at": 0, "slot": slot[starts]})
        live = np.flatnonzero((bits[:n] & MET) == 0)
        newest = np.full(len(starts), -1)
        newest[group[live]] = live  # the last one stays
        wanted = hot[starts]
        yield _answers(slots[wanted], HELD, batch, np.bincount(group[live], minlength=len(starts))[wanted], versions, newest[wanted])
        met = np.flatnonzero(hot[:n] & ((bits[:n] & MET) > 0))
        if len(met):
            yield _answers(slots.iloc[group[met]], SURVIVOR, batch, 0, versions, met)


def micros(at: Column) -> Column:
    """Microseconds since 1970 as the clock shows, whatever the session's zone."""
    return F.unix_date(at.cast("date")) * 86_400_000_000 + F.hour(at) * 3_600_000_000 + F.minute(at).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def batch_of(day: Column) -> Column:
    """Number of the batch of a day since 1970."""
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def pieces_for(n_rows: int) -> int:
    return max(LEAST_PIECES, -(-n_rows // PIECE_ROWS))


def hot_clients(sales: DataFrame, changes: DataFrame, rows: int = HOT_ROWS, share: int = HOT_SHARE) -> tuple[DataFrame, int]:
    """Clients with more than ``rows`` rows and more than one in ``share`` of all (so fewer than ``share``), and the number of all rows."""
    counts = sales.select("client_id").unionAll(changes.select("client_id")).groupBy("client_id").agg(F.count("*").alias("n"))
    counts = store.materialize(counts, "op12-clients")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where((F.col("n") > max(rows, n // share)) & F.col("client_id").isNotNull()).select(F.col("client_id").alias("hot_id")), n


class Enrichment:
    """A feed, a checkpoint and an output under ``root``, a new folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, pieces: int, hot: DataFrame):
        self.spark, self.root, self.pieces, self.hot = spark, root.rstrip("/"), pieces, hot

    def _dealt(self, rows: DataFrame, salt: Column) -> DataFrame:
        """Rows of the feed: hot clients get slots, every row its piece."""
        rows = rows.join(F.broadcast(self.hot), F.col("client_id") == F.col("hot_id"), "left")
        is_hot, no_client, no_time = F.col("hot_id").isNotNull(), F.col("client_id").isNull(), F.col("at").isNull()
        # Sales without a time ask for no slot: they are spread over slots that no version has.
        slot = F.when(~is_hot, 0).when(no_time, -1 - F.pmod(salt, F.lit(RING))).otherwise(F.floor(F.col("at") / SLOT)).cast("long")
        rows = rows.withColumn("slot", slot)
        piece = F.pmod(F.xxhash64(F.when(no_client, salt).otherwise(F.col("client_id")), F.pmod("slot", F.lit(RING))), F.lit(self.pieces))
        bits = sum((c.cast("int") * b for c, b in ((F.col("id").isNull(), NO_ID), (no_client, NO_CLIENT), (no_time, NO_TIME), (F.col("balance").isNull() & (F.col("kind") == CHANGE), NO_BALANCE), (is_hot, HOT))), F.lit(0))
        null = lambda c, n=NULL: F.coalesce(F.col(c).cast("long"), F.lit(n)).alias(c)
        return rows.select(piece.alias("piece"), "kind", bits.alias("bits"), null("id"), null("client_id").alias("client"), null("at", NEVER), "slot", null("seq"), null("balance"), "op", "batch")

    def _ticks(self, limits: list[tuple[int, int]]) -> DataFrame:
        """A row for each batch and piece."""
        at = F.array(*(F.struct(F.lit(b).alias("batch"), F.lit(h).cast("long").alias("at"), F.lit(w).cast("long").alias("seq")) for b, (h, w) in enumerate(limits)))
        zero = F.lit(0).cast("long")
        return self.spark.range(self.pieces).select("id", F.explode(at).alias("t")).select(
            F.col("id").alias("piece"), F.lit(TICK).alias("kind"), F.lit(0).alias("bits"), zero.alias("id"), zero.alias("client"),
            F.col("t.at").alias("at"), zero.alias("slot"), F.col("t.seq").alias("seq"), zero.alias("balance"), F.lit(None).cast("string").alias("op"), F.col("t.batch").alias("batch"))

    def stage(self, sales: DataFrame, changes: DataFrame) -> int:
        """Writes all batches and the last one that only releases, aside from what the stage watches; their number.

        ``sales`` (id, client_id, at, batch) and ``changes`` (id, client_id, seq, at, balance, op, batch), times in microseconds.
        """
        most = [dict(t.groupBy("batch").agg(F.max("at")).collect()) for t in (sales, changes)]  # a row a batch
        n = max([0, *(b + 1 for m in most for b in m)])
        n = max(n, BATCHES)
        limits = []
        for b in range(n):
            before = [[m[k] for k in m if k < b and m[k] is not None] for m in most]
            sold, valid = (max(x) - DELAY if x else NEVER for x in before)
            limits.append((min(sold, valid), valid))
        ticks = self._ticks([*limits, (ALWAYS, ALWAYS)])
        zero = F.lit(0).cast("long")
        # A row's place in its file tells repeated sales without a client or a time apart, so that they don't share a piece.
        salt = F.xxhash64("id", "client_id", "at", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 10)))
        sold = sales.select(F.lit(SALE).alias("kind"), "id", "client_id", "at", zero.alias("seq"), zero.alias("balance"), F.lit(None).cast("string").alias("op"), "batch").withColumn("salt", salt)
        changed = changes.select(F.lit(CHANGE).alias("kind"), "id", "client_id", "at", "seq", "balance", "op", "batch").withColumn("salt", salt)
        rows = [self._dealt(t, F.col("salt")) for t in (sold, changed)]
        rows[0].unionByName(rows[1]).unionByName(ticks).write.partitionBy("batch").parquet(f"{self.root}/staged")
        return n + 1

    def publish(self, batch: int) -> None:
        """Moves a batch to where the stage finds it."""
        fs, source = store.filesystem(self.spark, f"{self.root}/staged/batch={batch}")
        _, target = store.filesystem(self.spark, f"{self.root}/feed/batch={batch}")
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"batch {batch} could not be moved")

    def start(self) -> None:
        """Runs the stage over what is new, on the checkpoint, and ends."""
        # A partition beyond the number of pieces would load and commit an empty store.
        partitions = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.pieces)
        with _settings(self.spark, {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions)}):
            feed = self.spark.readStream.schema(ROW).parquet(f"{self.root}/feed")
            answers = feed.groupBy("piece").transformWithStateInPandas(Versions(), ANSWER, "append", "none")
            query = answers.writeStream.format("parquet").option("path", f"{self.root}/answers").option("checkpointLocation", f"{self.root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            finally:
                query.stop()

    def answers(self) -> DataFrame:
        return self.spark.read.schema(ANSWER).parquet(f"{self.root}/answers")

    def clean(self) -> None:
        """Deletes all but the answers."""
        for name in ("staged", "feed", "checkpoint"):
            fs, at = store.filesystem(self.spark, f"{self.root}/{name}")
            fs.delete(at, True)


@contextlib.contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def resolved(answers: DataFrame) -> DataFrame:
    """Answers as rec, id, batch, n_held, change_id, balance_cents, op."""
    version = F.when(F.col("v_bits") >= 0, F.struct("v_at", "v_seq", "v_id", "v_balance", F.coalesce("v_op", F.lit("")).alias("order_op"), "v_op", "v_bits"))
    rows = answers.withColumn("v", version)
    of_hot = F.col("bits").bitwiseAND(F.lit(HOT)) > 0
    plain = rows.where((F.col("kind") == LATE) | (F.col("kind") == SALE) & ~of_hot).select("kind", "batch", "bits", "id", "n_held", "v")
    everyone = Window.partitionBy("batch", "client")
    before = everyone.orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("kind") == HELD, F.col("v"))
    survivor = F.max(F.when(F.col("kind") == SURVIVOR, F.col("v"))).over(everyone)
    slots = rows.where(F.col("kind").isin(HELD, SURVIVOR)).select("batch", "client", "slot", "kind", F.sum("n_held").over(everyone).alias("n_others"), survivor.alias("survivor"), F.max(held).over(before).alias("earlier"))
    hot = rows.where((F.col("kind") == SALE) & of_hot).drop("n_held").join(slots.where(F.col("kind") == HELD).drop("kind"), ["batch", "client", "slot"])
    timed = F.col("bits").bitwiseAND(F.lit(NO_TIME)) == 0
    own = F.when(F.col("v_bits").bitwiseAND(F.lit(MET)) == 0, F.col("v"))
    best = F.greatest(own, F.when(timed, F.col("earlier")), F.when(timed & (F.col("survivor.v_at") <= F.col("at")), F.col("survivor")))
    hot = hot.select("kind", "batch", "bits", "id", (F.col("n_others") + F.col("survivor").isNotNull().cast("int")).alias("n_held"), best.alias("v"))
    is_sale, null = F.col("kind") == SALE, lambda c, bits, bit: F.when(F.col(bits).bitwiseAND(F.lit(bit)) == 0, F.col(c))
    return plain.unionByName(hot).select(
        F.when(is_sale, "sale").otherwise("late").alias("rec"), null("id", "bits", NO_ID).alias("id"), F.col("batch").cast("long").alias("batch"), F.when(is_sale, F.col("n_held")).alias("n_held"),
        null("v.v_id", "v.v_bits", NO_ID).alias("change_id"), null("v.v_balance", "v.v_bits", NO_BALANCE).alias("balance_cents"), F.col("v.v_op").alias("op"))


def batches(sales: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for ``Enrichment.stage``, with the batches that arrival gives them."""
    sold = sales.select(F.col("sale_id").alias("id"), "client_id", micros(F.col("sold_at")).alias("at"), batch_of(F.unix_date(F.col("arrived_at").cast("date"))).alias("batch"))
    day = F.unix_date(F.col("valid_at").cast("date")) + F.crc32(F.col("change_id").cast("string")) % 4
    cents = F.floor(F.lit(100.0) * F.col("balance") + 0.5).cast("long")
    changed = changes.where("valid_at is not null").distinct()
    return sold, changed.select(F.col("change_id").alias("id"), "client_id", "seq", micros(F.col("valid_at")).alias("at"), cents.alias("balance"), "op", batch_of(day).alias("batch"))


def enrich(sales: DataFrame, changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Feeds all batches in order, the query started anew for each, then releases what waits; one row a sale and a late change."""
    spark = sales.sparkSession
    with store.scope():
        hot, n = hot_clients(sales, changes, hot_rows)
        run = Enrichment(spark, store.scratch(spark, "op12"), pieces_for(n), hot)
        n_batches = run.stage(*batches(sales, changes))
    for b in range(n_batches):
        run.publish(b)
        run.start()
    run.clean()
    return resolved(run.answers())


def op12_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(store.table(spark, sf_dir, "sales"), store.table(spark, sf_dir, "client_changes"))


#: crc32 by its bits; then limits by batch, the batch in which each sale is emitted, and the versions that no pruning before a batch has met.
SQL = r"""
WITH c0 AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
c1 AS (SELECT *, CASE WHEN change_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(change_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384::bigint) END), 4294967295::bigint) END crc FROM c0),
c AS (SELECT change_id, client_id, coalesce(seq, -9223372036854775808) seq, valid_at, op, floor(100 * balance + 0.5)::bigint cents,
  greatest(0, coalesce(least(9, floor((datediff('day', DATE '1970-01-01', valid_at::date) + crc % 4 - 19723) * 10 / 152)), 9))::int arr FROM c1),
s AS (SELECT row_number() OVER () rid, sale_id, client_id, sold_at, greatest(0, coalesce(least(9, floor((datediff('day', DATE '1970-01-01', arrived_at::date) - 19723) * 10 / 152)), 9))::int arr FROM sales),
b AS (SELECT unnest(range(0, 11))::int b),
w AS (SELECT b, (SELECT max(sold_at) FROM s WHERE arr < b) - INTERVAL 36 HOUR ws, (SELECT max(valid_at) FROM c WHERE arr < b) - INTERVAL 36 HOUR wv FROM b),
h AS (SELECT b, wv, CASE WHEN b = 10 THEN TIMESTAMP '9999-01-01' WHEN ws IS NULL OR wv IS NULL THEN TIMESTAMP '0001-01-01' ELSE least(ws, wv) END h FROM w),
l AS (SELECT c.* FROM c JOIN h ON h.b = arr WHERE valid_at < wv),
v AS (SELECT c.*, row(valid_at, seq, coalesce(change_id, -9223372036854775808), coalesce(cents, -9223372036854775808), coalesce(op, '')) k FROM c JOIN h ON h.b = arr WHERE client_id IS NOT NULL AND (wv IS NULL OR valid_at >= wv)),
p AS (SELECT h.b, h.h, client_id, max(k) k FROM v JOIN h ON arr <= h.b AND valid_at <= h.h GROUP BY ALL),
live AS (SELECT b.b, v.* FROM v JOIN b ON arr <= b.b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.client_id = v.client_id AND p.b >= v.arr AND p.b < b.b AND v.valid_at <= p.h AND v.k < p.k)),
n AS (SELECT b, client_id, count(*) n FROM live GROUP BY ALL),
e AS (SELECT s.*, CASE WHEN sold_at IS NULL THEN arr ELSE (SELECT min(b) FROM h WHERE h.b >= arr AND sold_at < h.h) END b FROM s),
m AS (SELECT rid, any_value(sale_id) sale_id, any_value(e.b) b, any_value(e.client_id) client_id, max(CASE WHEN live.k IS NOT NULL THEN row(live.k, live.change_id, live.cents, live.op) END) x
  FROM e LEFT JOIN live ON live.b = e.b AND live.client_id = e.client_id AND live.valid_at <= e.sold_at GROUP BY rid)
SELECT 'sale' rec, sale_id id, m.b::bigint batch, coalesce(n, 0)::bigint n_held, x[2] change_id, x[3] balance_cents, x[4] op FROM m LEFT JOIN n ON n.b = m.b AND n.client_id = m.client_id
UNION ALL SELECT 'late', change_id, arr, NULL, NULL, NULL, NULL FROM l
"""
