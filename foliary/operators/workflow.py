"""Workflow: legal state transitions, event audits, resume and cascades."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.sources.versioned import scratch

# The states that may follow each state.
TRANSITIONS = {
    "INIT": ("UPLOADED",),
    "UPLOADED": ("PARSING",),
    "PARSING": ("PARSING", "PARSED", "UPLOADED", "SCORE_PARSED"),
    "PARSED": ("UPLOADED", "PARSING", "SCORE_PARSED"),
    "SCORE_PARSED": ("PARSED", "UPLOADED", "PARSING", "SCORE_PARSED", "PARSE_REVIEW"),
    "PARSE_REVIEW": ("SCORE_PARSED", "PARSE_CONFIRMED"),
    "PARSE_CONFIRMED": ("SCORE_PARSED", "PARSED", "UPLOADED", "PARSING", "FORMAT_REVIEW"),
    "FORMAT_REVIEW": ("FORMAT_CONFIRMED", "PARSE_CONFIRMED"),
    "FORMAT_CONFIRMED": ("MATERIAL_LOOP", "PARSE_CONFIRMED"),
    "MATERIAL_LOOP": ("MATERIAL_CONFIRMED", "FORMAT_CONFIRMED"),
    "MATERIAL_CONFIRMED": ("TEMPLATE_MATCHED", "MATERIAL_LOOP"),
    "TEMPLATE_MATCHED": ("TEMPLATE_REVIEW", "MATERIAL_CONFIRMED"),
    "TEMPLATE_REVIEW": ("READY_TO_RENDER", "TEMPLATE_MATCHED"),
    "READY_TO_RENDER": ("RENDERING", "TEMPLATE_REVIEW"),
    "RENDERING": ("RENDERED", "READY_TO_RENDER"),
    "RENDERED": ("READY_TO_RENDER", "EXPORTED"),
    "EXPORTED": (),
}


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_state string, to_state string")


def legal(changes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each change with a flag; the edge table is a constant of a few dozen rows."""
    return changes.join(F.broadcast(allowed.withColumn("legal", F.lit(True))), ["from_state", "to_state"], "left").fillna(False, ["legal"])


def broken_chains(events: DataFrame, key: str, order: list[str], frm: str, to: str) -> DataFrame:
    """Events whose from-state isn't the to-state of the event before."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("before", F.lag(to).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(frm)))


def without_repeats(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before; the first of each key stays."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value))).drop("before")


def resumed(items: DataFrame) -> DataFrame:
    """After a crash running items are idle again; what has succeeded stays."""
    return items.withColumn("state", F.when(F.col("state") == "running", "idle").otherwise(F.col("state")))


def progress(start: float, end: float, done: str, total: str) -> F.Column:
    """Percent between start and end, rounded half to even."""
    return F.least(F.lit(end), F.lit(start) + F.bround((end - start) * F.col(done) / F.greatest(F.col(total), F.lit(1)), 0)).cast("int")


# Items of a parse configuration, those that can't be left out first, and what any change of it resets.
REQUIRED = ("project_overview", "tech_score", "project_info", "buyer_info", "response_requirements", "agency_info", "business_score", "invalid_bid")
OPTIONAL = ("delivery_service", "procurement_list", "bid_milestones", "bid_bond", "qualification_review", "compliance_review", "bid_opening", "bid_evaluation", "contract_award", "contract_termination")
AFFECTED = ("extract:coarse", "extract:llm", "score:extract", "score:llm")

# The stages that a stage's reset takes with it.
STAGES = {
    "dedupe": ("dedupe-verify", "preprocess"),
    "dedupe-verify": ("preprocess",),
    "preprocess": ("mineru",),
    "mineru": ("chapters",),
    "chapters": ("docx", "extract:coarse"),
    "extract:coarse": ("extract:llm", "score:extract"),
    "score:extract": ("score:llm",),
    "extract:llm": ("confirmed",),
    "score:llm": ("confirmed",),
    "docx": ("confirmed",),
}


def _names(names: tuple[str, ...]) -> F.Column:
    return F.array(*[F.lit(x) for x in names])


def merged_config(given: F.Column) -> F.Column:
    """map of every item to whether it is on: required ones by default, what is given overrides, unknown names are dropped."""
    every = [x for k in (*REQUIRED, *OPTIONAL) for x in (F.lit(k), F.coalesce(F.try_element_at(given, F.lit(k)), F.lit(k in REQUIRED)))]
    return F.create_map(*every)


def config_faults(chosen: F.Column) -> tuple[F.Column, F.Column]:
    """Names chosen that aren't known, and required ones that aren't chosen, both in order."""
    return F.array_sort(F.array_except(chosen, _names((*REQUIRED, *OPTIONAL)))), F.array_sort(F.array_except(_names(REQUIRED), chosen))


def config_change(new: F.Column, old: F.Column, scalars: dict[str, tuple[F.Column, F.Column]]) -> F.Column:
    """struct(added, removed, and each scalar as struct(from, to) where it changed)."""
    parts = [F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed")]
    parts += [F.when(~a.eqNullSafe(b), F.struct(b.alias("from"), a.alias("to"))).alias(k) for k, (a, b) in scalars.items()]
    return F.struct(*parts)


def affected(change: F.Column, scalars: list[str]) -> F.Column:
    """The checkpoint items that a change resets: all of them where anything changed, else none."""
    any_change = (F.size(change["added"]) > 0) | (F.size(change["removed"]) > 0)
    for k in scalars:
        any_change = any_change | change[k].isNotNull()
    return F.when(any_change, _names(AFFECTED)).otherwise(F.array().cast("array<string>"))


def below(spark: SparkSession, edges: dict[str, tuple[str, ...]] = STAGES) -> DataFrame:
    """(stage, below): every stage and all that its reset takes with it, itself included, as a recursive query over the edges."""
    rows = [(a, b) for a, to in edges.items() for b in to]
    spark.createDataFrame(rows, "a string, b string").createOrReplaceTempView("stage_edges")
    return spark.sql(
        "WITH RECURSIVE w(stage, below, depth) AS (SELECT stage, stage, 0 FROM (SELECT a AS stage FROM stage_edges UNION SELECT b FROM stage_edges) "
        f"UNION ALL SELECT w.stage, e.b, depth + 1 FROM w JOIN stage_edges e ON e.a = w.below WHERE depth < {len(edges) + 1}) SELECT DISTINCT stage, below FROM w"
    )


def invalidated(resets: DataFrame, closure: DataFrame, stage: str, key: str = "job") -> DataFrame:
    """(job, upstream, resets): the jobs in which a reset (job, stage) takes ``stage`` with it, whether one before it did,
    and how many stages were reset that do."""
    above = closure.where(F.col("below") == stage).select("stage")
    return resets.distinct().join(F.broadcast(above), "stage").groupBy(key).agg(F.bool_or(F.col("stage") != stage).alias("upstream"), F.count("*").alias("resets"))


def reset(items: DataFrame, resets: DataFrame, closure: DataFrame, key: str = "job") -> DataFrame:
    """items (job, stage, state) after resets (job, stage): what lies below a reset stage is idle again, all else stays."""
    hit = resets.join(F.broadcast(closure), "stage").select(key, F.col("below").alias("stage")).distinct().withColumn("hit", F.lit(True))
    return items.join(hit, [key, "stage"], "left").withColumn("state", F.when(F.col("hit"), "idle").otherwise(F.col("state"))).drop("hit")


def retried(items: DataFrame) -> DataFrame:
    """Before a resume: what failed or was running is idle; attempts stay."""
    return items.withColumn("state", F.when(F.col("state").isin("error", "running"), "idle").otherwise(F.col("state")))


def attempts(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Checkpoint items from their log (state): how often each ran, and its last state."""
    return log.groupBy(*key).agg(F.count_if(F.col("state") == "running").alias("attempts"), F.max_by("state", F.struct(*order)).alias("state"))


def _after(state: str, wanted, edges: dict[str, frozenset[str]]) -> str:
    for to in wanted:
        if to in edges.get(state, ()):
            state = to
    return state


def audited(requests: DataFrame, transitions: dict[str, tuple[str, ...]], key: str, order: list[str], start: str = "INIT") -> DataFrame:
    """requests (key, order.., to_state) replayed: each with the state it met (from_state) and whether it was legal.

    An illegal request changes nothing, so what a request meets depends on all before it. Requests are sorted into ranges
    of (key, order), so a key of any size is spread over tasks and read in batches; one pass tells for each range and
    key which state every entry state leads to, a few rows a key put these together, and a second pass replays.
    """
    edges = {k: frozenset(v) for k, v in transitions.items()}
    states = sorted({start, *edges, *(x for v in edges.values() for x in v)})
    spark = requests.sparkSession
    columns = [key, *order, "to_state"]
    path = scratch(spark, "requests")
    # Written, so that both passes see the same ranges.
    ranged = requests.select(*columns).repartitionByRange(key, *order).withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions(key, *order).write.partitionBy("part").parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    kind = dict(requests.dtypes)

    def led(part: pd.DataFrame) -> pd.DataFrame:
        wanted = part.sort_values(order, kind="stable")["to_state"].tolist()
        return pd.DataFrame({"own": part[key].iloc[0], "at": part["part"].iloc[0], "enter": states, "leave": [_after(s, wanted, edges) for s in states]})

    # Only a key that lies in several ranges is entered in a state that another range leads to.
    several = rows.groupBy(F.col(key).alias("own")).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("own")
    steps = rows.join(several, F.col(key).eqNullSafe(F.col("own")), "left_semi").groupBy(key, "part").applyInPandas(led, f"own {kind[key]}, at int, enter string, leave string")

    def entered(leads: pd.DataFrame) -> pd.DataFrame:
        state, out = start, []
        for at, step in leads.groupby("at", sort=True):
            out.append((leads["own"].iloc[0], at, state))
            state = step.set_index("enter")["leave"][state]
        return pd.DataFrame(out, columns=["own", "at", "met"])

    entries = steps.groupBy("own").applyInPandas(entered, f"own {kind[key]}, at int, met string")
    # Requests may have a column at of their own.
    named = rows.join(entries.withColumnRenamed("at", "foliary_at"), F.col(key).eqNullSafe(F.col("own")) & (F.col("part") == F.col("foliary_at")), "left").select("part", F.coalesce("met", F.lit(start)).alias("met"), *columns)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            met, legal = [], []
            for at, enter, own, to in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, batch.num_columns - 1)), strict=True):
                if (at, own) != last:
                    last, state = (at, own), enter
                met.append(state)
                legal.append(to in edges.get(state, ()))
                state = to if legal[-1] else state
            yield pa.record_batch([*batch.columns[2:-1], pa.array(met, pa.string()), batch.columns[-1], pa.array(legal, pa.bool_())], names=[key, *order, "from_state", "to_state", "legal"])

    schema = ", ".join(f"{c} {kind[c]}" for c in [key, *order]) + ", from_state string, to_state string, legal boolean"
    return named.repartition("part").sortWithinPartitions("part", key, *order).mapInArrow(replay, schema)


def until_terminal(events: DataFrame, key: str, order: list[str], stage: str, terminal: list[str]) -> DataFrame:
    """events with seq, their place from 0 within their key, up to the first one of a terminal stage: what a job reports
    after it has completed, failed or been cancelled belongs to nobody."""
    w = Window.partitionBy(key).orderBy(*order)
    ended = F.max(F.col(stage).isin(terminal).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = events.withColumns({"seq": F.row_number().over(w) - 1, "ended": F.coalesce(ended, F.lit(0))})
    return numbered.where("ended = 0").drop("ended")


def gate(state: F.Column, target: F.Column, order: list[str]) -> F.Column:
    """What entering a stage does: nothing where the state is there or beyond, a step where it is right before, else an error."""
    place = lambda c: F.array_position(_names(tuple(order)), c)
    return F.when((place(state) == 0) | (place(target) == 0), "unknown").when(place(state) >= place(target), "already").when(place(state) + 1 == place(target), "enter").otherwise("not reached")


def access(level: F.Column, state: dict[str, F.Column]) -> F.Column:
    """Whether a route of a level is open: each level needs all flags up to its own."""
    needs = {"public": [], "enterprise": ["enterprise"], "project": ["enterprise", "project"]}
    needs |= {k: [*needs["project"], k] for k in ("parse", "format", "material")}
    out = F.when(F.lit(False), F.lit(True))
    for k, flags in needs.items():
        ok = F.lit(True)
        for f in flags:
            ok = ok & state[f]
        out = out.when(level == k, ok)
    return out.otherwise(False)
