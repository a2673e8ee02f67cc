"""What the audit trails of analysis runs tell: calls, outcomes, budgets, models, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import text as T
from duskwatch.functions import values as V
from duskwatch.operators import ordered
from duskwatch.operators.host import latest
from duskwatch.operators.nearest import nearest
from duskwatch.session import materialize

CALLS = ("run_code_call", "tool_call")
RESULTS = ("run_code_return", "tool_result")

# Size from which a result is stored apart, and length of its preview.
OVERFLOW_CHARS = 10_000
PREVIEW_CHARS = 1_000

ORDER = ["ts", "seq"]


def is_event(*kinds: str) -> Column:
    return F.col("event").isin(*kinds)


# --- calls and their results ---------------------------------------------------------------------

def pair_calls(audit: DataFrame) -> DataFrame:
    """Calls with their results by run and call id.

    The first call and the last result of an id count. A call without a result is pending; a
    result without a call is kept as unmatched. Both sides meet in one aggregate, no join.
    """
    order = F.struct(*ORDER)
    when_call, when_result = F.when(is_event(*CALLS), order), F.when(is_event(*RESULTS), order)
    paired = (
        audit.where(is_event(*CALLS, *RESULTS) & F.col("tool_call_id").isNotNull())
        .groupBy("run_id", "tool_call_id")
        .agg(
            F.min_by(F.struct("ts", "seq", "tool_name"), when_call).alias("call"),
            F.max_by(F.struct("ts", "seq", "content", "tool_name"), when_result).alias("result"),
            F.bool_or(is_event("run_code_call", "run_code_return")).alias("code"),
        )
    )
    # A sandbox call carries no tool name of its own.
    name = F.coalesce("call.tool_name", "result.tool_name", F.when(F.col("code"), "run_code"))
    status = (
        F.when(F.col("call").isNull(), "unmatched")
        .when(F.col("result").isNull(), "pending")
        .otherwise("answered")
    )
    return paired.select(
        "run_id", "tool_call_id", name.alias("tool_name"), F.col("call.ts").alias("call_ts"),
        F.col("result.ts").alias("result_ts"), F.col("result.content").alias("content"),
        status.alias("status"))


# --- models ----------------------------------------------------------------------------------------

def resolve_models(runs: DataFrame, dim: DataFrame) -> DataFrame:
    """Model names as ids: the first catalogue entry whose alias or id equals the name wins."""
    names = dim.select("pos", "id", F.explode(F.array_distinct(F.array("alias", "id"))).alias("model"))
    # Names are dealt out before they fold: a catalogue of one file would be sorted in one task. The
    # engine takes their size from the file's, which names outgrow, and would send all of them to every task.
    first = names.repartition("model").groupBy("model").agg(F.min_by("id", "pos").alias("_id"))
    return runs.join(first.hint("merge"), "model", "left").withColumn(
        "resolved", F.coalesce("_id", "model")).drop("_id")


def unknown_models(runs: DataFrame, dim: DataFrame, max_models: int | None = None) -> DataFrame:
    """Requested names that no catalogue entry has, with the nearest alias by edit distance.

    Ties go to the first alias. Names meet only aliases that share a piece with them
    (``nearest``), so neither the catalogue nor the number of names is bounded. A caller may give
    ``max_models`` to have the job fail when there are more aliases than that.
    """
    names = dim.select(F.explode(F.array("alias", "id")).alias("model")).distinct()
    asked = runs.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    missing = asked.join(names, "model", "left_anti")
    if max_models is not None:
        count = dim.agg(F.count_distinct("alias")).scalar()
        missing = missing.where(F.assert_true(count <= max_models, "catalogue too large").isNull())
    missing = materialize(missing, "unknown-models")
    near = nearest(missing.select(F.col("model").alias("name")), dim.select("alias"))
    return missing.join(near, F.col("model").eqNullSafe(F.col("name"))).select(
        "model", "n", F.col("alias").alias("nearest"), F.col("distance").cast("bigint").alias("distance"))


# --- per run -------------------------------------------------------------------------------------

REQUESTS = ("run_code_call", "tool_call", "model_text")


def names_model() -> Column:
    """The events of a trail that say which model a run uses from there on."""
    return is_event("run_start", "model_changed")


def run_table(audit: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """One row for each run of a trail: its last model, seconds, requests, limit and habits.

    Tokens and cost are not in the trail; they come from ``usage`` (run_id, tokens, cost; several
    rows of a run add up, a cost only when all are known) and are null without it.
    """
    per = audit.groupBy("run_id").agg(
        F.max_by("model", F.when(names_model() & F.col("model").isNotNull(), F.struct(*ORDER))).alias("model"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)).alias("seconds"),
        F.count_if(is_event(*REQUESTS)).alias("requests"),
        F.max_by("max_turns", F.when(F.col("max_turns").isNotNull(), F.struct(*ORDER))).alias("max_turns"),
        F.bool_or(F.coalesce(is_event("tool_call") & (F.col("tool_name") == "write_file"), F.lit(False)))
        .alias("wrote"),
    )
    if usage is None:
        return per.withColumns({"tokens": F.lit(None).cast("bigint"), "cost": F.lit(None).cast("double")})
    used = usage.groupBy("run_id").agg(
        F.sum("tokens").alias("tokens"),
        F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")).alias("cost"))
    return per.join(used, "run_id", "left")


def run_metrics(audit: DataFrame) -> DataFrame:
    """Duration between the start and end events, prompts, calls, file writes, last status."""
    start = F.min(F.when(is_event("run_start"), F.col("ts")))
    end = F.max(F.when(is_event("run_end"), F.col("ts")))
    writes = is_event("tool_call") & (F.col("tool_name") == "write_file")
    return audit.groupBy("run_id").agg(
        ((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)).alias("duration_s"),
        F.count_if(is_event("prompt")).alias("prompts"),
        F.count_if(is_event("run_code_call")).alias("sandbox_calls"),
        F.count_if(writes).alias("file_writes"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.struct(*ORDER)))
        .alias("last_status"),
    )


def outcomes(audit: DataFrame) -> DataFrame:
    """How each run ended, from all its events: ``run_end`` alone hides interruptions."""
    seen = audit.groupBy("run_id").agg(
        F.bool_or(is_event("run_start")).alias("started"),
        F.bool_or(is_event("setup_error")).alias("setup"),
        F.bool_or(is_event("interrupted")).alias("interrupted"),
        F.bool_or(is_event("error")).alias("error"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.struct(*ORDER))).alias("status"),
    )
    outcome = (
        F.when(F.col("setup") & ~F.col("started"), "setup_failed")
        .when(F.col("interrupted"), "interrupted")
        .when(F.col("status") == "completed", "completed")
        .when((F.col("status") == "failed") | F.col("error"), "failed")
        .otherwise("open")
    )
    return seen.select("run_id", outcome.alias("outcome"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Per model: runs, seconds, tokens, cost and tokens per second.

    A cost is only given when that of every run is known. ``runs`` has one row per run with
    ``model``, ``seconds``, ``tokens`` and ``cost``.
    """
    per = runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("seconds").alias("seconds"),
        F.sum("tokens").alias("tokens"),
        F.when(F.count("cost") == F.count(F.lit(1)), F.round(F.sum("cost"), 4)).alias("cost"),
    )
    return per.withColumn(
        "tokens_per_s", F.round(F.try_divide(F.col("tokens").cast("double"), F.col("seconds")), 6)
    ).orderBy(F.asc_nulls_last("cost"), "model")


def habit_rate(runs: DataFrame, flag: str) -> DataFrame:
    """Share of each model's repetitions in which a flag is set."""
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("reps"), F.count_if(F.col(flag)).alias("did"),
        F.round(F.avg(F.col(flag).cast("double")), 6).alias("rate"))


def stability(findings: DataFrame) -> DataFrame:
    """Distinct verdicts of a model on one signal, and the commonest (ties: the smallest)."""
    per = findings.groupBy("model", "signal", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("model", "signal").agg(
        F.count(F.lit(1)).alias("verdicts"), F.sum("n").alias("n"),
        F.min(F.struct((-F.col("n")).alias("m"), "verdict"))["verdict"].alias("commonest"))


def tally(findings: DataFrame, finished: DataFrame) -> DataFrame:
    """Per signal, how many of the finished runs report it."""
    total = finished.select("run_id").distinct().agg(F.count(F.lit(1)).alias("t")).scalar()
    done = findings.join(finished.select("run_id").distinct(), "run_id", "left_semi")
    return done.groupBy("signal").agg(F.count_distinct("run_id").alias("reports")).withColumns({
        "finished": total,
        "share": F.round(F.try_divide(F.col("reports").cast("double"), total), 6),
    })


def errors(audit: DataFrame) -> DataFrame:
    """Errors by type and normalized message, with the runs and models they hit.

    An error event names no model: it is that of the latest earlier event of the run that does.
    """
    kept = audit.where(is_event("error", "setup_error") | names_model()).select(
        "run_id", *ORDER, "event", "error_type", "error", F.col("model").alias("_named"))
    named = ordered.carry_forward(kept, ["run_id"], ORDER,
                                  value=F.when(names_model(), F.col("_named")), name="model")
    found = named.where(is_event("error", "setup_error"))
    return found.groupBy("error_type", T.error_key(F.col("error")).alias("message")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"),
        F.count_distinct("model").alias("models"))


def overflow_stats(audit: DataFrame, over: int = OVERFLOW_CHARS) -> DataFrame:
    """Oversized results by run and tool: number, size in all, worst.

    The logged size counts; logs from before it was logged are judged by length.
    """
    size = F.coalesce(
        F.col("overflow_bytes").cast("bigint"),
        F.when(F.length("content") >= over, F.length("content").cast("bigint")))
    found = audit.where(is_event(*RESULTS)).withColumn("_size", size).where("_size is not null")
    return found.groupBy("run_id", "tool_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_size").alias("total"), F.max("_size").alias("worst"))


def retries(audit: DataFrame) -> DataFrame:
    """Provider retries by model and reason, with the seconds waited."""
    return audit.where(is_event("model_request_retry")).groupBy("model", "reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(V.clamp_delay(F.col("delay_seconds"))), 3).alias("waited_s"))


# --- order inside a run ------------------------------------------------------------------------------

def stalls(audit: DataFrame, min_s: float) -> DataFrame:
    """Silences inside a run longer than ``min_s``, with the events before and after."""
    rows = audit.select("run_id", *ORDER, "event")
    out = ordered.neighbours(rows, ["run_id"], ORDER,
                             prev={"before_ts": "ts", "before_event": "event"})
    gap = (F.unix_micros("ts") - F.unix_micros("before_ts")) / F.lit(1e6)
    return out.withColumn("silent_s", gap).where(F.col("silent_s") > min_s)


def turns(df: DataFrame, run: str = "run_id", order: str = "turn") -> DataFrame:
    """Prompts numbered from 1 in each run, the first one marked."""
    out = ordered.numbered(df, [run], [order], name="number")
    return out.withColumn("first", F.col("number") == 1)


def latest_turn(df: DataFrame, run: str = "run_id", order: str = "turn") -> DataFrame:
    """The last good turn of each run."""
    return latest(df, [run], [order])


def overruns(audit: DataFrame, budget_s: float) -> DataFrame:
    """Turns, from prompt to the next prompt or end, that took longer than their budget."""
    marks = audit.where(is_event("prompt", "run_end", "interrupted")).select(
        "run_id", *ORDER, "event")
    out = ordered.neighbours(marks, ["run_id"], ORDER,
                             following={"end_ts": "ts", "end_event": "event"})
    took = (F.unix_micros("end_ts") - F.unix_micros("ts")) / F.lit(1e6)
    return out.where(is_event("prompt")).withColumn("took_s", took).where(
        F.col("took_s") > budget_s)


def budget_use(runs: DataFrame, near: float = 0.8) -> DataFrame:
    """Requests of each run against its limit; runs without a limit are left out."""
    used = F.try_divide(F.col("requests").cast("double"), F.col("max_turns"))
    level = F.when(used >= 1, "at_limit").when(used >= near, "near").otherwise("below")
    return runs.where("max_turns is not null").withColumns(
        {"used": F.round(used, 6), "level": level})


def extract_programs(audit: DataFrame) -> DataFrame:
    """One numbered program per sandbox call with code, named by the stamp of its run."""
    stamp = audit.groupBy("run_id").agg(V.run_stamp(F.min("ts")).alias("stamp"))
    code = audit.where(is_event("run_code_call") & (F.col("code") != "")).select(
        "run_id", *ORDER, "code")
    out = ordered.numbered(code, ["run_id"], ORDER, name="number")
    padded = F.when(F.col("number") < 10, F.concat(F.lit("0"), F.col("number").cast("string"))
                    ).otherwise(F.col("number").cast("string"))
    return out.join(stamp, "run_id").withColumn(
        "name", F.concat("stamp", F.lit("-"), padded, F.lit(".py")))


def latest_report(audit: DataFrame) -> DataFrame:
    """The text of each run's last good turn, and whether the run failed after it."""
    text = is_event("model_text")
    per = audit.groupBy("run_id").agg(
        F.max_by(F.struct("ts", "content"), F.when(text, F.struct(*ORDER))).alias("last"),
        F.count_if(text).alias("checkpoints"),
        F.max(F.when(is_event("error", "interrupted"), F.col("ts"))).alias("failed_ts"))
    return per.where("last is not null").select(
        "run_id", F.col("last.ts").alias("ts"), F.col("last.content").alias("content"),
        "checkpoints",
        F.coalesce(F.col("failed_ts") > F.col("last.ts"), F.lit(False)).alias("failed_after"))
