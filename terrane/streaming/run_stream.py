"""The ordered stream of runs: steps come in, messages go out, and a run's place is kept in state.

``follow`` reads a stream of steps (one row each time a run has trained on) and keeps, for each run,
how far it is, its best loss and whether it has ended; a restart goes on from the checkpoint, so
no step counts twice. ``messages_of`` turns what it says into messages by expressions alone.
``plan`` lists all messages that a whole run will send.

How much is read a trigger is the source's setting (``maxFilesPerTrigger``, ``maxBytesPerTrigger``): messages
are made only as fast as the sink takes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from terrane.plans.shipping import ship

#: What a run does before its first step, how far along that is, and where training and the end stand.
STAGES = (("simulate", 0.02), ("prep", 0.18), ("resolve", 0.38), ("build", 0.55))
TRAIN, STOPPED, DONE = 0.6, 0.95, 1.0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of a step, and what ``follow`` says of it.
STEP = "run string, step long, total double, pde double, ic double, data double, well double, wall_s double, eta double, failure string, n_iter long"
FOLLOWED = "run string, kind string, iteration long, beat long, status string, redraw boolean, best double, " + ", ".join(c for c in STEP.split(", ") if not c.startswith(("run ", "step ")))
RUNNING, COMPLETED, STALLED, FAILED = "running", "completed", "stalled", "failed"


def plan(spark: SparkSession, n_iter: int, log_every: int = 1, snapshot_every: int = 50, n_snapshots: int = 8) -> DataFrame:
    """seq, kind, iteration and slot of all messages of a whole run, in order.

    Stages and the grid, the states of the untrained network, a loss after every ``log_every``
    steps (the last one may be shorter), states where a multiple of ``snapshot_every`` was just
    logged, then the final states, the metrics and the last stage. ``seq`` follows from the row,
    so no sort of all rows is needed.
    """
    log_every, snapshots = max(1, log_every), max(0, n_snapshots)
    done = F.least((F.col("id") + 1) * log_every, F.lit(n_iter))
    steps = spark.range(-(-n_iter // log_every)).select("id", done.alias("iteration"))
    # a logged step is a multiple of both intervals, or the last one, which has its own states
    due = (F.col("iteration") % snapshot_every == 0) & (F.col("iteration") < n_iter) if snapshot_every > 0 else F.lit(False)
    both = lcm(log_every, snapshot_every) if snapshot_every > 0 else n_iter + 1
    before = F.floor((F.col("iteration") - 1) / both)  # states sent between earlier losses
    base = len(STAGES) + 2 + snapshots
    at = F.lit(base) + F.col("id") + before * snapshots
    loss = steps.select(at.alias("seq"), F.lit("loss").alias("kind"), "iteration", F.lit(None).cast("int").alias("slot"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(snapshots - 1))) if snapshots else F.explode(F.array().cast("array<int>"))
    states = steps.filter(due).select((at + 1).alias("__at"), "iteration", slots.alias("slot")).select((F.col("__at") + F.col("slot")).alias("seq"), F.lit("state").alias("kind"), "iteration", "slot")
    head = [(n, "stage", 0, None) for n in range(len(STAGES))] + [(len(STAGES), "grid", 0, None), (len(STAGES) + 1, "stage", 0, None)]
    head += [(len(STAGES) + 2 + k, "state", 0, k) for k in range(snapshots)]
    end = base + -(-n_iter // log_every) + (n_iter - 1) // both * snapshots if n_iter > 0 else base
    tail = [(end + k, "state", n_iter, k) for k in range(snapshots)] + [(end + snapshots, "metrics", n_iter, None), (end + snapshots + 1, "stage", n_iter, None)]
    edge = spark.createDataFrame(head + tail, "seq long, kind string, iteration long, slot int")
    return edge.unionByName(loss).unionByName(states)


def lcm(a: int, b: int) -> int:
    from math import lcm

    return lcm(a, b)



class Follower(StatefulProcessor):
    """A run's counter, its best loss and its status; a timer beats while nothing comes.

    A step of size 0 (``eta``) stalls the run, a ``failure`` ends it, and so does the ``n_iter``-th step; what comes later
    is left out. ``redraw`` is set on the steps before which a sampling window is due, every ``adapt_every`` of
    them. A run that says nothing for ``beat_ms`` gives a beat, again and again, until it goes on or ends.
    """

    def __init__(self, beat_ms: int = 0, adapt_every: int = 0) -> None:
        self.beat_ms, self.adapt_every = beat_ms, adapt_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "done long, best double, status string, beats long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, best, status, beats = self.place.get() or (0, float("inf"), RUNNING, 0)
        if status != RUNNING:
            return
        frames = list(rows)  # those of one run in one trigger
        steps = frames[0] if len(frames) == 1 else pd.concat(frames)
        # plain arrays: runs are many and short, and a frame's own steps cost more than their rows
        order = np.argsort(steps["step"].to_numpy(), kind="stable")
        col = {c.split()[0]: steps[c.split()[0]].to_numpy()[order] for c in STEP.split(", ") if not c.startswith("step ")}
        ends = {STALLED: col["eta"] == 0, FAILED: pd.notna(col["failure"]), COMPLETED: col["n_iter"].astype("float64") <= np.arange(done + 1, done + 1 + len(order))}
        last = min((int(k.argmax()) for k in ends.values() if k.any()), default=len(order) - 1)
        for name in (COMPLETED, STALLED, FAILED):  # the later ones go first
            if ends[name][last]:
                status = name
        said = {c: v[: last + 1] for c, v in col.items()} | {"kind": "step", "beat": 0, "iteration": np.arange(done + 1, done + last + 2)}
        said["status"] = np.array([RUNNING] * last + [status], object)
        said["redraw"] = (said["iteration"] > 1) & ((said["iteration"] - 1) % self.adapt_every == 0) if self.adapt_every > 0 else False
        said["best"] = np.fmin.accumulate(np.concatenate([[best], said["total"].astype("float64")]))[1:]
        said = pd.DataFrame({c.split()[0]: said[c.split()[0]] for c in FOLLOWED.split(", ")}, copy=False)
        self.place.update((done + len(said), float(said["best"].iloc[-1]), status, 0))
        self._wait(timerValues, status)
        yield said

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, best, status, beats = self.place.get()
        self.place.update((done, best, status, beats + 1))
        self._wait(timerValues, status)
        row = dict.fromkeys((c.split()[0] for c in FOLLOWED.split(", ")), None)
        row |= {"run": key[0], "kind": "beat", "iteration": done, "beat": beats + 1, "status": status, "redraw": False, "best": best}
        yield pd.DataFrame([row])

    def _wait(self, timers, status: str) -> None:
        if self.beat_ms <= 0:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if status == RUNNING:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.beat_ms)


def follow(steps: DataFrame, beat_ms: int = 0, adapt_every: int = 0) -> DataFrame:
    """FOLLOWED of a stream of STEP rows; steps of a run come in order of ``step`` from trigger to trigger.

    Rows with a null run are left out; a null ``n_iter`` is a run without an end. With beats the query has to run on a
    processing-time trigger: it goes on looking for silent runs, so ``availableNow`` would never end.
    """
    spark = steps.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = steps.filter("run IS NOT NULL").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STEP.split(", ")])
    return rows.groupBy("run").transformWithStateInPandas(Follower(beat_ms, adapt_every), FOLLOWED, "Append", "ProcessingTime" if beat_ms > 0 else "None")


def _body(kind: str, at: Column, payload: Column, total: Column | None = None, slot: Column | None = None, losses: bool = False) -> Column:
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if losses else F.lit(0.0)
    return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("iteration"), F.lit(None).cast("int").alias("slot") if slot is None else slot.cast("int").alias("slot"), (part("total") if total is None else total).alias("total"), *[part(c).alias(c) for c in ("pde", "ic", "data", "well")], payload.alias("payload"))


def _stage(name: str, fraction: float, text: Column) -> Column:
    return _body("stage", F.lit(0), F.to_json(F.struct(F.lit(name).alias("stage"), text.alias("message"))), F.lit(fraction))


def messages_of(followed: DataFrame, log_every: int = 1, snapshot_every: int = 50, n_snapshots: int = 8) -> DataFrame:
    """(run, step, place) in order, then the message's columns and ``slot``, of batch or streamed FOLLOWED rows.

    Cadence counts steps, not time: a loss every ``log_every`` and with the last step, states after losses
    at multiples of ``snapshot_every``. A run that stalls says so; a failed one sends its reason and nothing more.
    """
    i, status = F.col("iteration"), F.col("status")
    none = F.array().cast("array<struct<kind:string,iteration:int,slot:int,total:double,pde:double,ic:double,data:double,well:double,payload:string>>")
    some = lambda when, *bodies: F.when(when, F.array(*bodies)).otherwise(none)
    slots = lambda at: F.transform(F.sequence(F.lit(0), F.lit(n_snapshots - 1)), lambda k: _body("state", at, F.to_json(F.struct(k.alias("slot"))), slot=k)) if n_snapshots > 0 else none
    step, ended = F.col("kind") == "step", (F.col("kind") == "step") & status.isin(COMPLETED, STALLED)
    logged = step & (status != FAILED) & ((i % max(1, log_every) == 0) | ended)
    due = logged & ~ended & (i % snapshot_every == 0) if snapshot_every > 0 else F.lit(False)
    goal = F.concat(F.lit("steps to go: "), F.coalesce(F.col("n_iter").cast("string"), F.lit("no end set")))
    loss = F.to_json(F.struct(F.col("wall_s"), F.col("eta")), {"ignoreNullFields": "false"})
    head = [*[_stage(name, at, F.lit("")) for name, at in STAGES], _body("grid", F.lit(0), F.lit("")), _stage("train", TRAIN, goal)]
    stalled = _stage("train", STOPPED, F.concat(F.lit("no step helps after iteration "), i.cast("string")))
    metrics = F.to_json(F.struct(i.alias("iterations"), F.col("total").alias("last"), F.col("best")))
    beat = _stage("wait", TRAIN, F.concat(F.lit("beat "), F.col("beat").cast("string"), F.lit(" after iteration "), i.cast("string")))
    all_ = F.concat(
        some(step & (i == 1), *head), F.when(step & (i == 1), slots(F.lit(0))).otherwise(none),
        some(F.col("kind") == "beat", beat), some(logged, _body("loss", i, loss, losses=True)), some(step & (status == FAILED), _body("error", i, F.to_json(F.struct(F.col("failure").alias("message"))))),
        some(step & (status == STALLED), stalled), F.when(due, slots(i)).otherwise(none), F.when(ended, slots(i)).otherwise(none),
        some(ended, _body("metrics", i, metrics), _stage("done", DONE, F.concat(F.lit("ended with iteration "), i.cast("string")))))
    rows = followed.select("run", i.alias("step"), (F.col("beat") * 1_000_000).alias("__beat"), F.posexplode(all_).alias("__at", "m"))
    return rows.select("run", "step", (F.col("__beat") + F.col("__at")).alias("place"), "m.*")


def replay(steps: DataFrame, folder: str, files_per_trigger: int = 4, **cadence) -> DataFrame:
    """All messages of a table of finished steps: dealt to files by run, streamed file by file, and read back.

    Takes up where it stopped if it is called again with the same ``folder``, which holds steps, checkpoint and messages.
    """
    spark: SparkSession = steps.sparkSession
    if not _there(spark, f"{folder}/steps/_SUCCESS"):
        steps.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STEP.split(", ")]).repartition("run").write.mode("overwrite").parquet(f"{folder}/steps")
    stream = spark.readStream.schema(STEP).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/steps")
    query = start(messages_of(follow(stream), **cadence), folder)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/messages")


def start(messages: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write a stream of messages to ``folder``, each once, across restarts; by default what there is, then it ends."""
    writer = messages.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/messages")
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def failures(messages: DataFrame) -> DataFrame:
    """(run, iteration, message) of the runs that failed, for whoever has to raise them."""
    return messages.filter("kind = 'error'").select("run", "iteration", F.get_json_object("payload", "$.message").alias("message"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
