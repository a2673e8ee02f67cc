"""Registered queries over run audit trails and the texts runs leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions import text as T
from duskwatch.functions import values as V
from duskwatch.operators import runs, texts, trigrams
from duskwatch.plans import adapters
from duskwatch.plans.adapters import oracle_cte
from duskwatch.plans.registry import query, us
from duskwatch.session import materialize, scratch
from duskwatch.sinks import results

R = oracle_cte("run")
D = oracle_cte("report")
C = oracle_cte("turn")
G = oracle_cte("program")


def audit(spark, sf):
    return adapters.run(spark, sf)


def trail(spark, sf):
    """The audit trail as it is written: few events carry the model, the limit or a tool's name."""
    event = F.col("event")
    return audit(spark, sf).withColumns({
        "model": F.when(runs.names_model(), F.col("model")),
        "max_turns": F.when(event == "run_start", F.col("max_turns")),
        "tool_name": F.when(event != "run_code_call", F.col("tool_name")),
    }).drop("tokens", "cost")


@query("call_result", R + """, c as (select run_id, tool_call_id, arg_min({'n': case when event = 'tool_call' then tool_name end}, (us, seq))['n'] as tool_name,
    bool_or(event = 'run_code_call') as code, min(us) as call_us from run where event in ('run_code_call', 'tool_call') group by 1, 2),
    r as (select run_id, tool_call_id, max(us) as result_us, arg_max(length(content), (us, seq)) as chars,
    arg_max(tool_name, (us, seq)) as result_name, bool_or(event = 'run_code_return') as code
    from run where event in ('run_code_return', 'tool_result') group by 1, 2)
    select coalesce(c.run_id, r.run_id) as run_id, coalesce(c.tool_call_id, r.tool_call_id) as tool_call_id,
    coalesce(tool_name, result_name, case when c.code or r.code then 'run_code' end) as tool_name,
    call_us, result_us, chars, case when call_us is null then 'unmatched'
    when result_us is null then 'pending' else 'answered' end as status
    from c full outer join r on c.run_id = r.run_id and c.tool_call_id = r.tool_call_id""")
def call_result(spark, sf):
    return runs.pair_calls(trail(spark, sf)).select(
        "run_id", "tool_call_id", "tool_name", us("call_ts").alias("call_us"),
        us("result_ts").alias("result_us"),
        F.length("content").cast("bigint").alias("chars"), "status")


@query("run_metrics", R + """select run_id,
    round((max(case when event = 'run_end' then us end) - min(case when event = 'run_start' then us end))
        / 1e6, 6) as duration_s,
    count(*) filter (event = 'prompt') as prompts,
    count(*) filter (event = 'run_code_call') as sandbox_calls,
    count(*) filter (event = 'tool_call' and tool_name = 'write_file') as file_writes,
    arg_max(status, (us, seq)) filter (status is not null) as last_status from run group by 1""")
def run_metrics(spark, sf):
    return runs.run_metrics(audit(spark, sf)).withColumn("duration_s", F.round("duration_s", 6))


OUTCOME = """, f as (select run_id, bool_or(event = 'run_start') as started,
    bool_or(event = 'setup_error') as setup, bool_or(event = 'interrupted') as interrupted,
    bool_or(event = 'error') as err, arg_max(status, (us, seq)) filter (status is not null) as status
    from run group by 1),
    outcome as (select run_id, case when setup and not started then 'setup_failed'
    when interrupted then 'interrupted' when status = 'completed' then 'completed'
    when status = 'failed' or err then 'failed' else 'open' end as outcome from f)"""


@query("run_outcome", R + OUTCOME + "select * from outcome")
def run_outcome(spark, sf):
    return runs.outcomes(audit(spark, sf))


def _per_run(spark, sf):
    usage = audit(spark, sf).select("run_id", "tokens", "cost")
    return runs.run_table(trail(spark, sf), usage)


PER_RUN = R + """, per as (select run_id,
    arg_max(model, (us, seq)) filter (event in ('run_start', 'model_changed')) as model,
    (max(us) - min(us)) / 1e6 as seconds, cast(sum(tokens) as bigint) as tokens,
    case when count(cost) = count(*) then sum(cost) end as cost,
    bool_or(coalesce(event = 'tool_call' and tool_name = 'write_file', false)) as wrote,
    arg_max(max_turns, (us, seq)) filter (event = 'run_start' and max_turns is not null) as max_turns,
    count(*) filter (event in ('run_code_call', 'tool_call', 'model_text')) as requests
    from run group by 1)"""


@query("leaderboard", PER_RUN + """select model, count(*) as runs, round(sum(seconds), 3) as seconds,
    cast(sum(tokens) as bigint) as tokens,
    case when count(cost) = count(*) then round(sum(cost), 4) end as cost,
    round(sum(tokens) / nullif(sum(seconds), 0), 6) as tokens_per_s from per group by 1""")
def leaderboard(spark, sf):
    return runs.leaderboard(_per_run(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@query("habit_rate", PER_RUN + """select model, count(*) as reps, count(*) filter (wrote) as did,
    round(avg(cast(wrote as int)), 6) as rate from per group by 1""")
def habit_rate(spark, sf):
    return runs.habit_rate(_per_run(spark, sf), "wrote")


@query("verdict_stability", R + """, p as (select model, signal, verdict, count(*) as n from run
    group by 1, 2, 3) select model, signal, count(*) as verdicts, cast(sum(n) as bigint) as n,
    arg_min(verdict, (-n, verdict)) as commonest from p group by 1, 2""")
def verdict_stability(spark, sf):
    return runs.stability(audit(spark, sf).select("model", "signal", "verdict"))


@query("corroboration_tally", R + OUTCOME + """, fin as (select run_id from outcome
    where outcome = 'completed')
    select signal, count(distinct run_id) as reports, (select count(*) from fin) as finished,
    round(count(distinct run_id) / (select count(*) from fin)::double, 6) as share
    from run where run_id in (select run_id from fin) group by 1""")
def corroboration_tally(spark, sf):
    rows = audit(spark, sf)
    finished = runs.outcomes(rows).where("outcome = 'completed'")
    return runs.tally(rows.select("run_id", "signal"), finished)


@query("error_taxonomy", R + """, m as (select *, last_value(case when event in ('run_start', 'model_changed')
    then model end ignore nulls) over (partition by run_id order by us, seq) as at_model from run)
    select error_type,
    'cannot read <path> at line <n> kind ' || right(error, 1) as message, count(*) as n,
    count(distinct run_id) as runs, count(distinct at_model) as models from m
    where event in ('error', 'setup_error') group by 1, 2""")
def error_taxonomy(spark, sf):
    return runs.errors(trail(spark, sf))


@query("error_key", R + """select seq, 'cannot read <path> at line <n> kind ' || right(error, 1) as message
    from run where error is not null""")
def error_key(spark, sf):
    return audit(spark, sf).where("error is not null").select(
        "seq", T.error_key(F.col("error")).alias("message"))


@query("overflow_stats", R + """, o as (select run_id, tool_name, coalesce(overflow_bytes,
    case when length(content) >= 10000 then length(content) end) as size from run
    where event in ('run_code_return', 'tool_result'))
    select run_id, tool_name, count(*) as n, cast(sum(size) as bigint) as total, max(size) as worst
    from o where size is not null group by 1, 2""")
def overflow_stats(spark, sf):
    return runs.overflow_stats(audit(spark, sf))


@query("retry_stats", R + """select model, reason, count(*) as n,
    round(sum(least(greatest(delay_seconds, 0.1), 30)), 3) as waited_s from run
    where event = 'model_request_retry' group by 1, 2""")
def retry_stats(spark, sf):
    return runs.retries(audit(spark, sf))


@query("clamp_delay", R + """select seq, case seq % 5 when 0 then least(greatest(delay_seconds, 0.1), 30)
    when 1 then least(greatest(delay_seconds, 0.1), 30) when 2 then 1.0::double when 3 then 1.0::double
    else 30.0::double end as seconds from run where event = 'model_request_retry'""")
def clamp_delay(spark, sf):
    wait = F.expr("""case seq % 5 when 0 then cast(delay_seconds as string)
        when 1 then concat(' ', delay_seconds, ' ') when 2 then 'soon' when 3 then 'Infinity'
        else '45' end""")
    return audit(spark, sf).where("event = 'model_request_retry'").select(
        "seq", V.clamp_delay(wait).alias("seconds"))


@query("provider_of", R + """select run_id, split_part(model, ':', 1) as provider, count(*) as n
    from run group by 1, 2""")
def provider_of(spark, sf):
    return audit(spark, sf).groupBy(
        "run_id", V.provider_of(F.col("model")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


@query("stall_gaps", R + """, g as (select run_id, us, seq, event,
    lag(us) over w as before_us, lag(event) over w as before_event from run
    window w as (partition by run_id order by us, seq))
    select run_id, us, event, before_us, before_event, round((us - before_us) / 1e6, 6) as silent_s
    from g where us - before_us > 43200000000""")
def stall_gaps(spark, sf):
    return runs.stalls(audit(spark, sf), 43200).select(
        "run_id", us("ts").alias("us"), "event", us("before_ts").alias("before_us"),
        "before_event", F.round("silent_s", 6).alias("silent_s"))


@query("budget_overrun", R + """, g as (select run_id, us, seq, event,
    lead(us) over w as end_us, lead(event) over w as end_event from run
    where event in ('prompt', 'run_end', 'interrupted')
    window w as (partition by run_id order by us, seq))
    select run_id, us, end_event, round((end_us - us) / 1e6, 6) as took_s
    from g where event = 'prompt' and end_us - us > 36000000000""")
def budget_overrun(spark, sf):
    return runs.overruns(audit(spark, sf), 36000).select(
        "run_id", us("ts").alias("us"), "end_event", F.round("took_s", 6).alias("took_s"))


@query("request_budget", PER_RUN + """select run_id, requests, max_turns,
    round(requests / max_turns::double, 6) as used,
    case when requests / max_turns::double >= 1 then 'at_limit'
    when requests / max_turns::double >= 0.8 then 'near' else 'below' end as level
    from per where max_turns is not null""")
def request_budget(spark, sf):
    return runs.budget_use(_per_run(spark, sf)).select(
        "run_id", "requests", F.col("max_turns").cast("bigint").alias("max_turns"), "used", "level")


@query("turn_numbers", C + """select run_id, turn, row_number() over (partition by run_id order by turn)
    as number, row_number() over (partition by run_id order by turn) = 1 as first
    from turn where role = 'user'""")
def turn_numbers(spark, sf):
    prompts = adapters.turn(spark, sf).where("role = 'user'").select("run_id", "turn")
    return runs.turns(prompts)


@query("latest_turn", C + """select run_id, max(turn) as turn, arg_max(text, turn) as text from turn
    where role = 'assistant' group by 1""")
def latest_turn(spark, sf):
    good = adapters.turn(spark, sf).where("role = 'assistant'").select("run_id", "turn", "text")
    return runs.latest_turn(good)


@query("program_extract", R + """, s as (select run_id, strftime(make_timestamp(min(us)),
    '%y-%m-%d_%H-%M-%S') as stamp from run group by 1),
    n as (select run_id, seq, code, row_number() over (partition by run_id order by us, seq) as number
    from run where event = 'run_code_call' and code <> '')
    select run_id, seq, code, number, stamp || '-' || case when number < 10 then '0' else '' end
    || cast(number as varchar) || '.py' as name from n join s using (run_id)""")
def program_extract(spark, sf):
    return runs.extract_programs(audit(spark, sf)).select("run_id", "seq", "code", "number", "name")


@query("checkpointed_report", R + """select run_id,
    max(us) filter (event = 'model_text') as us,
    arg_max(content, (us, seq)) filter (event = 'model_text') as content,
    count(*) filter (event = 'model_text') as checkpoints,
    coalesce(max(us) filter (event in ('error', 'interrupted'))
        > max(us) filter (event = 'model_text'), false) as failed_after
    from run group by 1 having count(*) filter (event = 'model_text') > 0""")
def checkpointed_report(spark, sf):
    return runs.latest_report(audit(spark, sf)).select(
        "run_id", us("ts").alias("us"), "content", "checkpoints", "failed_after")


# --- texts ---------------------------------------------------------------------------------------

@query("excerpt", D + """select doc_id,
    md5(case when length(t) > 400 then substr(t, 1, 400) || '... (' || cast(length(t) - 400 as varchar)
        || ' more chars, rerun with --debug to see all)' else t end) as echo,
    md5(case when length(text) > 1000 then substr(text, 1, 1000) || chr(10) || '... (truncated)'
        else text end) as report,
    case when length(text) > 300 then substr(text, 1, 300) || '…' else text end as cell
    from (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from report)""")
def excerpt(spark, sf):
    text = F.col("text")
    return adapters.report(spark, sf).select(
        "doc_id", F.md5(T.echo_excerpt(text)).alias("echo"),
        F.md5(T.report_excerpt(text)).alias("report"), T.cell_excerpt(text).alias("cell"))


TASK_ID = """case doc_id % 8 when 0 then 'default' when 1 then upper(source) when 2 then '-' || source
    when 3 then source || '/x' when 4 then repeat('a', cast(60 + doc_id % 10 as int)) when 5 then 'logs'
    else source || '-' || cast(doc_id as string) end"""


@query("valid_task_id", f"""with t as (select doc_id, {TASK_ID} as task from documents)
    select doc_id, task, regexp_full_match(task, '[a-z0-9][a-z0-9_-]{{0,63}}')
    and task not in ('default', 'data', 'logs', 'memory') as valid from t""")
def valid_task_id(spark, sf):
    named = adapters.table(spark, sf, "documents").select("doc_id", F.expr(TASK_ID).alias("task"))
    return named.withColumn("valid", V.valid_task_id(F.col("task")))


@query("strip_comments", G + """select doc_id, md5(regexp_replace(text, '#[^\\n\\r]*', '', 'g')) as code
    from program""")
def strip_comments(spark, sf):
    return adapters.program(spark, sf).select(
        "doc_id", F.md5(T.strip_comments(F.col("text"))).alias("code"))


REPLY = """case when turn % 8 = 0 then ' Stop ' when turn % 8 = 2 then 'continue'
    when run_id % 3 = 0 then 'focus on host ' || cast(run_id as string)
    when run_id % 3 = 1 then '  ' else substring(text, 1, 40) end"""


@query("reply_kind", C + f""", r as (select run_id, turn,
    regexp_replace({REPLY}, '^\\s+|\\s+$', '', 'g') as b from turn)
    select run_id, turn, case when lower(b) in ('stop', 'continue') then lower(b) else 'focus' end as kind,
    case when lower(b) not in ('stop', 'continue') then
        nullif(regexp_replace(replace(b, 'focus on ', ''), '^\\s+|\\s+$', '', 'g'), '') end as focus from r""")
def reply_kind(spark, sf):
    kind = T.reply_kind(F.expr(REPLY))
    return adapters.turn(spark, sf).select("run_id", "turn", kind.alias("k")).select(
        "run_id", "turn", "k.kind", "k.focus")


@query("block_quote", C + """select run_id, turn, '> ' || replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'),
    chr(10), chr(10) || '> ') as quoted from turn""")
def block_quote(spark, sf):
    return adapters.turn(spark, sf).select(
        "run_id", "turn", T.block_quote(F.col("text")).alias("quoted"))


@query("bounded_result", D + """select doc_id as handle, length(text) as chars, length(text) >= 10000 as stored,
    md5(case when length(text) >= 10000 then substr(text, 1, 1000) else text end) as shown from report""")
def bounded_result(spark, sf):
    docs = adapters.report(spark, sf).select("doc_id", "text")
    out = results.bounded(docs, scratch(spark, "bounded"), "doc_id")
    return out.withColumn("shown", F.md5("shown"))


@query("read_slice", D + """, l as (select doc_id as handle, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as line_no from report where length(text) >= 10000)
    select handle, cast(line_no as bigint) as line_no, line from l where line_no between 3 and 6""")
def read_slice(spark, sf):
    docs = adapters.report(spark, sf).select("doc_id", "text")
    path = scratch(spark, "bounded")
    results.bounded(docs, path, "doc_id")
    return results.read_slice(spark, path, None, 3, 4)


MESSAGES = """select run_id, turn as pos, text as content,
    case turn % 4 when 0 then 'text' when 1 then 'call' when 2 then 'result' else 'thinking' end as kind,
    case when run_id % 3 = 0 then 'run_code' else 'read_file' end as tool_name,
    'c' || cast(turn as string) as tool_call_id from turn"""


# Short pages, so that many reports have several.
PAGE = 1_000


@query("report_table", C + f""", messages as ({MESSAGES}),
    t as (select run_id, 'ask ' || cast(turn as varchar) as prompt, text as output,
        row_number() over (partition by run_id order by turn) as k,
        count(*) over (partition by run_id) as turns from turn where role = 'assistant'),
    r as (select distinct run_id, run_id % 2 = 0 as interactive from turn),
    z as (select r.*, coalesce(max(turns), 0) as turns, arg_min(prompt, k) as first_prompt
        from r left join t using (run_id) group by 1, 2),
    parts as (
    select run_id, 0 as section, 0 as pos, case when turns > 1 and not interactive then
        '# Analysis Report' || chr(10) || chr(10) || '- Skill: `net`' || chr(10)
        || '- Mode: Textual (multi-turn session)' || chr(10) || '- Run: `r' || cast(run_id as varchar) || '`'
        || chr(10) || '- Prompts:' || chr(10)
        else '# Analysis Report' || chr(10) || chr(10) || '- Skill: `net`' || chr(10) || '- Prompt: start'
        || chr(10) || '- Run: `r' || cast(run_id as varchar) || '`' || chr(10) || '- Mode: '
        || case when interactive then 'Interactive (multiple checkpoints)' else 'Standard' end
        || chr(10) || chr(10) end as text from z
    union all select run_id, 1, k, cast(k as varchar) || '. ' || prompt || case when k = t.turns
        then chr(10) || chr(10) else chr(10) end from t join r using (run_id)
        where t.turns > 1 and not interactive
    union all select run_id, 2, 0, '## Conversation History' || chr(10) || '### User Prompt' || chr(10)
        || '```' || chr(10) || coalesce(first_prompt, 'start') || chr(10) || '```' || chr(10)
        || '### Agent Communication' || chr(10) from z
    union all select run_id, 3, pos, case kind
        when 'call' then '#### Tool Call: `' || tool_name || '` (ID: ' || tool_call_id || ')' || chr(10)
            || case when tool_name = 'run_code' then '(Code saved to generated_code/ directory)' || chr(10) || chr(10)
            else '```json' || chr(10) || content || chr(10) || '```' || chr(10) end
        when 'result' then '#### Tool Result: `' || tool_name || '` (ID: ' || tool_call_id || ')' || chr(10)
            || '```' || chr(10) || case when length(content) > 1000 then substr(content, 1, 1000) || chr(10)
            || '... (truncated)' else content end || chr(10) || '```' || chr(10)
        when 'thinking' then '**Agent (Thinking):**' || chr(10) || '> '
            || replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10), chr(10) || '> ') || chr(10) || chr(10)
        else '**Agent:** ' || content || chr(10) || chr(10) end
        from messages where not (kind = 'result' and tool_name = 'run_code')
    union all select run_id, 4, 0, chr(10) || case when turns <= 1 then '## Final Findings'
        when interactive then '## Analysis Checkpoints' else '## Analysis Turns' end || chr(10) || chr(10)
        || case when turns = 0 then chr(10) else '' end from z
    union all select run_id, 5, k, case when t.turns > 1 then '### ' || case when interactive
        then 'Checkpoint ' else 'Turn ' end || cast(k as varchar) || chr(10) else '' end || output
        || case when k = t.turns then chr(10) else chr(10) || chr(10) || '---' || chr(10) || chr(10) end
        from t join r using (run_id)),
    whole as (select run_id, string_agg(text, '' order by section, pos) as text from parts group by 1),
    paged as (select run_id, text, unnest(range(0, length(text), {PAGE})) as start from whole)
    select run_id, cast(start // {PAGE} + 1 as bigint) as page, md5(substr(text, start + 1, {PAGE})) as text
    from paged""")
def report_table(spark, sf):
    turn = adapters.turn(spark, sf)
    turn_rows = turn.where("role = 'assistant'").select(
        "run_id", "turn", F.concat(F.lit("ask "), F.col("turn").cast("string")).alias("prompt"),
        F.col("text").alias("output"))
    run_rows = turn.select("run_id").distinct().select(
        "run_id", F.lit("net").alias("skill"),
        F.concat(F.lit("r"), F.col("run_id").cast("string")).alias("stamp"),
        (F.col("run_id") % 2 == 0).alias("interactive"), F.lit("start").alias("initial_prompt"))
    messages = spark.sql(MESSAGES.replace("from turn", "from {t}"), t=turn)
    parts = texts.report_parts(run_rows, turn_rows, messages)
    return texts.render_reports(materialize(parts, "parts"), PAGE).withColumn("text", F.md5("text"))


@query("script_reuse", G + """, n as (select doc_id, task_id, stamp_us, trim(regexp_replace(
    regexp_replace(text, '#[^\\n\\r]*', '', 'g'), '\\s+', ' ', 'g')) as t from program),
    f as (select t, min(stamp_us) as first_us, count(*) as copies from n group by 1)
    select doc_id, task_id, first_us, copies from n join f using (t) where first_us < stamp_us""")
def script_reuse(spark, sf):
    return texts.reuse(adapters.program(spark, sf)).select(
        "doc_id", "task_id", us("first_seen").alias("first_us"), "copies")


@query("script_at_start", G + """, f as (select task_id, min(stamp_us) as first_us from program group by 1)
    select r.doc_id, r.source as task_id, coalesce(f.first_us < 1735689600000000 + r.doc_id * 60000000
    - 600000000, false) as had_script from documents r left join f on f.task_id = r.source""")
def script_at_start(spark, sf):
    starts = adapters.report(spark, sf).select(
        "doc_id", "task_id", F.timestamp_micros(F.col("stamp_us") - 600000000).alias("start_ts"))
    return texts.had_script(starts, adapters.program(spark, sf)).select(
        "doc_id", "task_id", "had_script")


@query("lint_corpus", G + """, c as (select model, doc_id % 6 as kind, count(*) as n from program group by 1, 2)
    select model, rule, cast(n as bigint) as programs from c join (values (0, 'main_guard'), (1, 'argv'),
    (2, 'collections'), (3, 'ipaddress'), (3, 'os_path'), (4, 'str_format'), (4, 'exec_eval'))
    v(kind, rule) using (kind)""")
def lint_corpus(spark, sf):
    return texts.lint_counts(adapters.program(spark, sf), ["model"])


@query("lint_fixed", G + """select doc_id, md5(case when doc_id % 6 = 0 then
    replace(replace(text, 'if __name__ == "__main__":' || chr(10) || '    ', ''),
    chr(10) || '    ', chr(10)) else text end) as fixed from program""")
def lint_fixed(spark, sf):
    return texts.lint(adapters.program(spark, sf)).select("doc_id", F.md5("fixed").alias("fixed"))


@query("report_search", D + """, l as (select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as line_no from report)
    select doc_id, cast(line_no as bigint) as line_no, line from l where regexp_matches(line, '\\bthe of\\b')
    order by doc_id, line_no limit 100""")
def report_search(spark, sf):
    return texts.search(adapters.report(spark, sf), r"\bthe of\b", 100)


@query("report_search_indexed", D + """, l as (select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as line_no from report),
    h as (select *, count(*) over () as total from l where regexp_matches(line, '\\bthe of\\b'))
    select doc_id, cast(line_no as bigint) as line_no, line, total from h order by doc_id, line_no limit 100""")
def report_search_indexed(spark, sf):
    """Reports are indexed first; then only those with the trigrams of the pattern are read."""
    path = scratch(spark, "trigrams")
    trigrams.build(adapters.report(spark, sf), path)
    return trigrams.search(spark, path, r"\bthe of\b", 100)
