"""Order of execution within methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import dominators
from codeloom.runtime import stored


def execution_order(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Per method: whether all ``before`` events come before all ``after`` events.

    ``events`` (method, ordinal, role: before, after or none; dynamic); dynamic calls are left out.
    ``edges`` (method, src, dst): control flow between ordinals. ``order``: proven if the last before has a
    lower ordinal than the first after, reversed if the other way round, else mixed. ``runtime``: proven if each after is dominated by some
    before, bypass if one isn't; straight if the method has no branches and the order is proven."""
    rows = events.where("NOT dynamic")
    span = rows.groupBy("method").agg(
        F.max(F.when(F.col("role") == "before", F.col("ordinal"))).alias("last_before"), F.min(F.when(F.col("role") == "before", F.col("ordinal"))).alias("first_before"),
        F.min(F.when(F.col("role") == "after", F.col("ordinal"))).alias("first_after"), F.max(F.when(F.col("role") == "after", F.col("ordinal"))).alias("last_after"),
    ).where("last_before is not null AND first_after is not null")
    dom = dominators(edges)
    before = rows.where("role = 'before'").select("method", F.col("ordinal").cast("long").alias("dominator")).distinct()
    guarded = dom.join(before, ["method", "dominator"], "left_semi").select("method", F.col("node").alias("ordinal")).distinct().withColumn("guarded", F.lit(True))
    after = rows.where("role = 'after'").select("method", F.col("ordinal").cast("long").alias("ordinal")).distinct()
    cover = after.join(guarded, ["method", "ordinal"], "left").groupBy("method").agg(F.min(F.coalesce("guarded", F.lit(False))).alias("all_guarded"))
    out = edges.groupBy("method", "src").agg(F.countDistinct("dst").alias("n")).groupBy("method").agg(F.max("n").alias("branches"))
    whole = span.join(cover, "method").join(out, "method", "left")
    order = F.when(F.col("last_before") < F.col("first_after"), "proven").when(F.col("last_after") < F.col("first_before"), "reversed").otherwise("mixed")
    runtime = F.when((order == "proven") & (F.coalesce("branches", F.lit(0)) <= 1), "straight").when(F.col("all_guarded"), "proven").otherwise("bypass")
    return whole.select("method", order.alias("order"), runtime.alias("runtime"))


# What makes a call asynchronous: parts of the type's name, and the method's name by phase, the first that fits.
ASYNC_TYPES = ("java.util.concurrent", "reactor.core", "org.reactivestreams", "smallrye.mutiny", "eventbus", "kafka", "messaging")
PHASES = (
    ("completion_callback", ("complete", "handle", "then"), ()), ("subscription", (), ("subscribe",)), ("publication", (), ("publish", "send", "enqueue")),
    ("scheduling", ("async",), ("execute", "submit", "schedule")),
)


def async_phase(owner: Column, name: Column) -> Column:
    """The phase of asynchronous work that a call begins, null if it begins none."""
    kind, called = F.lower(owner), F.lower(name)
    some = lambda tests: reduce(lambda a, b: a | b, tests)
    phase = F.coalesce(*[F.when(some([*[called.contains(p) for p in parts], *[called == w for w in words]]), F.lit(name_)) for name_, parts, words in PHASES])
    return F.when(some([kind.contains(t) for t in ASYNC_TYPES]), phase)


def _guarded(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, guarded): whether each after event is dominated by some before event of the same keys; without control flow it isn't."""
    dom = stored(dominators(edges))
    before = rows.where("role = 'before'").select(*keys, F.col("ordinal").cast("long").alias("dominator")).distinct()
    after = rows.where("role = 'after'").select(*keys, F.col("ordinal").cast("long").alias("node")).distinct()
    met = after.join(dom, ["method", "node"]).join(before, [*keys, "dominator"], "left_semi").select(*keys, "node").distinct().withColumn("met", F.lit(True))
    return after.join(met, [*keys, "node"], "left").groupBy(*keys).agg(F.min(F.coalesce("met", F.lit(False))).alias("guarded"))


def execution_analysis(events: DataFrame, edges: DataFrame, handlers: DataFrame) -> DataFrame:
    """(method, before_events, after_events, instruction_order, runtime_order, completion_unknown, phases) of methods with calls.

    ``events`` (method, ordinal, role: before, after or none; dynamic; owner, name); creating a callback isn't calling it, so dynamic ones are left out. ``edges``
    (method, src, dst): control flow between ordinals; ``handlers`` (method, handlers long). ``instruction_order`` is proven if all before events have lower
    ordinals than all after events, else disproven, unknown without either. ``runtime_order``: every after event dominated by a before event is proven on all
    paths; without branches and handlers the ordinals prove it for normal completion; else it is likely. Calls that begin asynchronous work leave
    open when that completes: then only the order of invocation is proven. ``phases`` counts those calls by phase."""
    rows = events.where("NOT dynamic").withColumn("phase", async_phase(F.col("owner"), F.col("name")))
    of = lambda role, f: f(F.when(F.col("role") == role, F.col("ordinal")))
    by = rows.groupBy("method").agg(
        F.count_if(F.col("role") == "before").alias("before_events"), F.count_if(F.col("role") == "after").alias("after_events"), of("before", F.max).alias("last_before"), of("after", F.min).alias("first_after"), F.max(F.col("phase").isNotNull()).alias("completion_unknown")
    )
    counted = rows.where("phase is not null").groupBy("method", "phase").agg(F.count(F.lit(1)).alias("n")).groupBy("method").agg(F.array_join(F.array_sort(F.collect_list(F.concat("phase", F.lit("="), "n"))), ",").alias("phases"))
    branches = edges.groupBy("method", "src").agg(F.countDistinct("dst").alias("n")).groupBy("method").agg(F.max("n").alias("widest"))
    whole = by.join(_guarded(rows, edges, ["method"]), "method", "left").join(branches, "method", "left").join(handlers, "method", "left").join(counted, "method", "left")
    comparable = (F.col("before_events") > 0) & (F.col("after_events") > 0)
    ahead = F.col("last_before") < F.col("first_after")
    straight = (F.coalesce("widest", F.lit(1)) <= 1) & (F.coalesce("handlers", F.lit(0)) == 0)
    guarded, open_ = F.coalesce("guarded", F.lit(False)), F.col("completion_unknown")
    invoked = "invocation_order_proven_completion_unknown"
    runtime = (
        F.when(~comparable, "unknown").when(guarded & open_, invoked).when(guarded & ~straight, "proven_on_all_cfg_paths").when(ahead & straight, F.when(open_, invoked).otherwise("proven_on_normal_completion")).otherwise("likely")
    )
    order = F.when(~comparable, "unknown").when(ahead, "proven").otherwise("disproven")
    return whole.select("method", "before_events", "after_events", order.alias("instruction_order"), runtime.alias("runtime_order"), "completion_unknown", F.coalesce("phases", F.lit("")).alias("phases"))


def phase_orders(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, phase, status) of phases with before and after events, '' for calls that begin no asynchronous work: proven if dominance orders all after
    events of the phase, else likely. Between phases there is no order: events of different phases are never compared."""
    rows = events.where("NOT dynamic").withColumn("phase", F.coalesce(async_phase(F.col("owner"), F.col("name")), F.lit("")))
    both = rows.groupBy("method", "phase").agg(F.count_if(F.col("role") == "before").alias("b"), F.count_if(F.col("role") == "after").alias("a")).where("a > 0 AND b > 0")
    return both.join(_guarded(rows, edges, ["method", "phase"]), ["method", "phase"]).select("method", "phase", F.when(F.col("guarded"), "proven").otherwise("likely").alias("status"))
