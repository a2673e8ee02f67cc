"""Reports and saved programs as tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import text as T
from duskwatch.operators import ordered
from duskwatch.session import materialize


def _imported(module: str) -> str:
    """Lines that import a module, alone or in a list."""
    other = r"[\w.]+(?:[ \t]+as[ \t]+\w+)?[ \t]*,[ \t]*"
    return rf"(?md)^[ \t]*(?:import[ \t]+(?:{other})*|from[ \t]+){module}\b"


# Modules and calls that a saved program cannot use where it is run.
LINT_RULES = (
    ("argv", T.ARGV_USE),
    ("collections", _imported("collections")),
    ("ipaddress", _imported("ipaddress")),
    ("socket", _imported("socket")),
    ("exec_eval", r"\b(exec|eval)\("),
    ("os_path", r"\bos\.(path|listdir|walk)\b"),
    ("str_format", r"""["']\.format\("""),
    ("json_default", r"json\.dumps\([^)\n]*\bdefault\s*="),
    ("comma_spec", r"""f["'][^"'\n]*\{[^}\n]*:[^}\n]*,[a-z]?\}"""),
)


def lint(df: DataFrame) -> DataFrame:
    """Programs with their fixed text and the rules they break.

    A main guard is removed and its body dedented; everything else is only reported, and
    looked for outside comments.
    """
    guarded = F.col("text").rlike(T.MAIN_GUARD)
    fixed = F.when(guarded, T.drop_main_guard(F.col("text"))).otherwise(F.col("text"))
    out = df.withColumns({"fixed": fixed, "guarded": guarded})
    code = T.strip_comments(F.col("fixed"))
    out = out.withColumn("_code", code)
    found = [F.when(F.col("guarded"), F.lit("main_guard"))]
    found += [F.when(F.col("_code").rlike(p), F.lit(rule)) for rule, p in LINT_RULES]
    hits = F.filter(F.array(*found), lambda hit: hit.isNotNull())
    return out.withColumn("rules", hits).drop("_code", "guarded")


def lint_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Programs that break each rule."""
    # The outer form keeps the optimizer from testing the rules a second time in a filter.
    hits = lint(df).select(*by, F.explode_outer("rules").alias("rule")).where("rule is not null")
    return hits.groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("programs"))


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per line of each text, numbered from 1."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_at", "line")).select(
        key, (F.col("_at") + 1).cast("bigint").alias("line_no"), "line")


def search(df: DataFrame, regex: str, limit: int, key: str = "doc_id") -> DataFrame:
    """The first matching lines, in order of text and line; texts without a match are not split."""
    hits = lines(df.where(F.col("text").rlike(regex)), key).where(F.col("line").rlike(regex))
    return hits.orderBy(key, "line_no").limit(limit)


def normal_text(text: Column) -> Column:
    """Program text without comments and with single blanks, for telling copies."""
    return F.trim(F.regexp_replace(T.strip_comments(text), r"\s+", " "))


def reuse(programs: DataFrame) -> DataFrame:
    """Programs whose text, apart from comments and spacing, was seen at an earlier time.

    The texts are read once; their hashes are stored and meet without them.
    """
    hashed = programs.withColumn("text_key", F.sha2(normal_text(F.col("text")), 256)).drop("text")
    hashed = materialize(hashed, "hashes")
    first = hashed.groupBy("text_key").agg(
        F.min("stamp").alias("first_seen"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(first, "text_key").where(F.col("first_seen") < F.col("stamp"))


def had_script(runs: DataFrame, programs: DataFrame) -> DataFrame:
    """Runs with whether their task held a saved program when they started."""
    first = programs.groupBy("task_id").agg(F.min("stamp").alias("first_program"))
    return runs.join(first, "task_id", "left").withColumn(
        "had_script", F.coalesce(F.col("first_program") < F.col("start_ts"), F.lit(False)))


# --- reports --------------------------------------------------------------------------------------

# The wording of a report, in the order in which it appears.
TITLE = "# Analysis Report\n\n"
SKILL_LINE = "- Skill: `{}`\n"
PROMPT_LINE = "- Prompt: {}\n"
RUN_LINE = "- Run: `{}`\n"
MODE_LINE = "- Mode: {}\n"
MODE_STANDARD = "Standard"
MODE_INTERACTIVE = "Interactive (multiple checkpoints)"
MODE_SEVERAL = "Textual (multi-turn session)"
PROMPTS_LINE = "- Prompts:\n"
HISTORY = "## Conversation History\n### User Prompt\n```\n{}\n```\n### Agent Communication\n"
CALL = "#### Tool Call: `{}` (ID: {})\n"
CALL_CODE = "(Code saved to generated_code/ directory)\n\n"
CALL_ARGS = "```json\n{}\n```\n"
RESULT = "#### Tool Result: `{}` (ID: {})\n```\n{}\n```\n"
THINKING = "**Agent (Thinking):**\n{}\n\n"
SPOKEN = "**Agent:** {}\n\n"
FINAL = "\n## Final Findings\n\n"
CHECKPOINTS = "\n## Analysis Checkpoints\n\n"
TURNS = "\n## Analysis Turns\n\n"
CHECKPOINT = "### Checkpoint {}\n"
TURN = "### Turn {}\n"
RULE = "\n\n---\n\n"


def _fill(wording: str, *values: Column) -> Column:
    """The wording with a column in place of each pair of braces."""
    pieces = wording.split("{}")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value.cast("string"), F.lit(piece)]
    return F.concat(*out)


def report_parts(runs: DataFrame, turns: DataFrame, messages: DataFrame) -> DataFrame:
    """The text of every run's report in ordered pieces: ``run_id, section, pos, text``.

    ``runs``: run_id, skill, stamp, interactive, initial_prompt. ``turns``: run_id, turn,
    prompt, output of the good turns. ``messages``: run_id, pos, kind (call, result, thinking
    or text), tool_name, tool_call_id, content. Program bodies are left out, results are cut,
    and a run without good turns gets an empty finding.
    """
    turns = ordered.numbered(turns, ["run_id"], ["turn"], name="k")
    size = turns.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("turns"), F.min_by("prompt", "k").alias("first_prompt"),
        F.max("k").alias("last"))
    known = runs.join(size, "run_id", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    many = (F.col("turns") > 1) & ~F.col("interactive")

    def row(section: int, pos: Column, text: Column):
        return ["run_id", F.lit(section).alias("section"), pos.cast("bigint").alias("pos"),
                text.alias("text")]

    zero, name, content = F.lit(0), F.col("tool_name"), F.col("content")
    skill, stamp = _fill(SKILL_LINE, F.col("skill")), _fill(RUN_LINE, F.col("stamp"))
    mode = F.when(F.col("interactive"), MODE_INTERACTIVE).otherwise(MODE_STANDARD)
    prompt = F.coalesce("initial_prompt", F.lit("None"))
    single = F.concat(
        F.lit(TITLE), skill, _fill(PROMPT_LINE, prompt), stamp, _fill(MODE_LINE + "\n", mode))
    several = F.concat(
        F.lit(TITLE), skill, _fill(MODE_LINE, F.lit(MODE_SEVERAL)), stamp, F.lit(PROMPTS_LINE))
    header = known.select(*row(0, zero, F.when(many, several).otherwise(single)))

    placed = turns.join(known.select("run_id", "interactive", "turns", "last"), "run_id")
    is_last = F.col("k") == F.col("last")
    listed = F.concat(_fill("{}. {}\n", F.col("k"), F.col("prompt")),
                      F.when(is_last, "\n").otherwise(""))
    prompts = placed.where(many).select(*row(1, F.col("k"), listed))
    asked = F.coalesce("first_prompt", "initial_prompt", F.lit(""))
    history = known.select(*row(2, zero, _fill(HISTORY, asked)))

    call = F.concat(
        _fill(CALL, name, F.col("tool_call_id")),
        F.when(name == "run_code", CALL_CODE)
        .when(F.coalesce(content, F.lit("")) != "", _fill(CALL_ARGS, content)).otherwise(""))
    body = (
        F.when(F.col("kind") == "call", call)
        .when((F.col("kind") == "result") & (name != "run_code"),
              _fill(RESULT, name, F.col("tool_call_id"), T.report_excerpt(content)))
        .when(F.col("kind") == "thinking", _fill(THINKING, T.block_quote(content)))
        .when((F.col("kind") == "text") & content.rlike(r"\S"), _fill(SPOKEN, content))
    )
    talk = messages.select(*row(3, F.col("pos"), body)).where("text is not null")

    title = (
        F.when(F.col("turns") == 0, FINAL + "\n").when(F.col("turns") == 1, FINAL)
        .when(F.col("interactive"), CHECKPOINTS).otherwise(TURNS)
    )
    opening = known.select(*row(4, zero, title))
    label = F.when(F.col("interactive"), _fill(CHECKPOINT, F.col("k"))).otherwise(
        _fill(TURN, F.col("k")))
    findings = placed.select(*row(5, F.col("k"), F.concat(
        F.when(F.col("turns") > 1, label).otherwise(""), F.col("output"),
        F.when(is_last, "\n").otherwise(RULE))))

    out = header
    for part in (prompts, history, talk, opening, findings):
        out = out.unionByName(part)
    return out


PAGE_CHARS = 1_000_000


def render_reports(parts: DataFrame, page_chars: int = PAGE_CHARS) -> DataFrame:
    """Reports as pages of ``page_chars`` characters, the last one shorter: ``run_id, page, text``.

    A report is its pages one after the other. Pieces are cut where a page ends, so no row is longer
    than a page, however long a run or a piece of it is. Null pieces are left out.
    """
    size = F.length("text").cast("bigint")
    filled = parts.where(size > 0)
    placed = ordered.numbered(filled, ["run_id"], ["section", "pos"], name="end", step=size)
    start = F.col("end") - size
    pages = placed.select(
        "run_id", "section", "pos", "text", start.alias("start"),
        F.explode(F.sequence(F.floor(start / page_chars), F.floor((F.col("end") - 1) / page_chars))).alias("page"))
    first = F.greatest(F.col("page") * page_chars - F.col("start"), F.lit(0))
    after = (F.col("page") + 1) * page_chars - F.col("start")
    cut = F.substring("text", (first + 1).cast("int"), (F.least(after, F.length("text")) - first).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("start", cut.alias("text"))))
    return pages.groupBy("run_id", (F.col("page") + 1).alias("page")).agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
