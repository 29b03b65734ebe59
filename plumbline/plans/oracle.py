"""SQL twins of the queries, for DuckDB over the same tables.

Each is written from the definition of its query and not from the Spark code:
medians are plain medians, skewed joins are plain joins, rules are plain filters.
Numbers in texts go through ``printf``, which rounds the binary value.
"""

from __future__ import annotations

from plumbline.operators.advice import RECOMMENDATIONS
from plumbline.sources import telemetry as t

_RUN_OF_SUPPLIER = "'run_' || (l_suppkey % 4)"
_STAGE_OF_SUPPLIER = "cast(floor(l_suppkey / 4) as integer)"
_P = "cast(floor(l_extendedprice) as bigint)"
_Q = "cast(l_quantity as bigint)"


def _day_ms(date: str) -> str:
    return f"datediff('day', date '1970-01-01', cast({date} as date)) * 86400000::bigint"


TASKS = f"""
tasks as (
  select {_RUN_OF_SUPPLIER} as run_key,
    {_STAGE_OF_SUPPLIER} as stage_id,
    0::integer as stage_attempt,
    l_orderkey * 10 + l_linenumber as task_id,
    greatest({_Q} * 12 - l_linenumber * 20, 0)::bigint as duration_ms,
    {_Q} * 10 as executor_run_time_ms,
    case when l_suppkey % 6 = 0 then {_Q} * 3 else {_Q} end as executor_deserialize_time_ms,
    case when l_suppkey % 6 = 0 then {_Q} else 0 end::bigint as result_serialization_time_ms,
    cast(floor(l_discount * 100 + 0.5::double) as bigint) as gc_time_ms,
    case when l_suppkey % 7 = 0 then l_linenumber * 1000 else 0 end::bigint as memory_bytes_spilled,
    case when l_suppkey % 14 = 0 then l_linenumber * 500 else 0 end::bigint as disk_bytes_spilled,
    case when l_linenumber = 1 then 0
         when l_suppkey % 3 = 0 and l_orderkey % 97 = 5 then {_P} * 12
         else {_P} end::bigint as shuffle_read_bytes,
    (l_linenumber * 10)::bigint as shuffle_read_records,
    {_P} * 3 as shuffle_write_bytes,
    case when l_suppkey % 5 = 0 then {_P} * 200
         when l_suppkey % 5 = 1 then {_P} else 0 end::bigint as input_bytes,
    l_returnflag = 'R' as failed
  from lineitem)"""

STAGES = f"""{TASKS},
stage_times as (
  select {_RUN_OF_SUPPLIER} as run_key, {_STAGE_OF_SUPPLIER} as stage_id,
    min({_day_ms('l_shipdate')}) as submission_time_ms,
    max({_day_ms('l_shipdate')}) as completion_time_ms
  from lineitem group by 1, 2),
task_sums as (
  select run_key, stage_id, count(*) as num_tasks,
    sum(shuffle_read_bytes)::bigint as total_shuffle_read_bytes,
    sum(shuffle_write_bytes)::bigint as total_shuffle_write_bytes,
    sum(input_bytes)::bigint as total_input_bytes,
    sum(memory_bytes_spilled)::bigint as total_memory_spilled,
    sum(disk_bytes_spilled)::bigint as total_disk_spilled,
    sum(gc_time_ms)::bigint as total_gc_time_ms,
    sum(executor_run_time_ms)::bigint as total_executor_run_time_ms,
    max(executor_run_time_ms) as max_task_run_time_ms,
    sum(executor_deserialize_time_ms + result_serialization_time_ms)::bigint as serde_time_ms,
    case when count(*) filter (shuffle_read_bytes > 0) >= 2
      then max(shuffle_read_bytes) / median(shuffle_read_bytes) filter (shuffle_read_bytes > 0)
      end as shuffle_read_skew_ratio,
    case when count(*) filter (executor_run_time_ms > 0) >= 2
      then max(executor_run_time_ms) / median(executor_run_time_ms) filter (executor_run_time_ms > 0)
      end as task_duration_skew_ratio
  from tasks group by 1, 2),
stages as (
  select run_key, stage_id, 'stage ' || stage_id as name, num_tasks, submission_time_ms,
    completion_time_ms, completion_time_ms - submission_time_ms as duration_ms,
    total_shuffle_read_bytes, total_shuffle_write_bytes, total_input_bytes, total_memory_spilled,
    total_disk_spilled, total_gc_time_ms, total_executor_run_time_ms, max_task_run_time_ms,
    serde_time_ms, shuffle_read_skew_ratio, task_duration_skew_ratio
  from task_sums join stage_times using (run_key, stage_id))"""

APP_SUMS = f"""{STAGES},
app_sums as (
  select run_key, count(*) as n_stages, sum(num_tasks)::bigint as total_tasks,
    coalesce(sum(duration_ms), 0)::bigint as total_duration_ms,
    sum(total_shuffle_read_bytes)::bigint as total_shuffle_read_bytes,
    sum(total_shuffle_write_bytes)::bigint as total_shuffle_write_bytes,
    sum(total_input_bytes)::bigint as total_input_bytes,
    sum(total_memory_spilled)::bigint as total_memory_spilled,
    sum(total_disk_spilled)::bigint as total_disk_spilled,
    sum(total_gc_time_ms)::bigint as total_gc_time_ms,
    sum(total_executor_run_time_ms)::bigint as total_executor_run_time_ms,
    max(max_task_run_time_ms) as max_task_run_time_ms,
    max(shuffle_read_skew_ratio) as worst_skew_ratio
  from stages group by 1)"""

EXECUTIONS = f"""
executions as (
  select 'run_' || (o_custkey % 4) as run_key, o_orderkey as execution_id,
    o_orderpriority as description,
    case o_orderkey % 5
      when 0 then '{t.PLAN_SORT_MERGE}'
      when 1 then '{t.PLAN_BROADCAST}'
      when 2 then case when o_custkey % 4 = 0 then '{t.PLAN_PLAIN}' else '{t.PLAN_CACHED}' end
      when 3 then '{t.PLAN_BOTH}'
      else '{t.PLAN_NO_SCAN}' end as physical_plan,
    case when o_orderkey % 10 = 0 then '{t.FINAL_TREE}' end as final_plan,
    {_day_ms('o_orderdate')} as start_ms,
    case when o_orderstatus <> 'P' then cast(floor(o_totalprice / 100) as bigint) end as duration_ms
  from orders)"""


def _has(column: str, *names: str) -> str:
    return "(" + " or ".join(f"contains({column}, '{n}')" for n in names) + ")"


_CACHED_NAMES = ("InMemoryTableScan", "InMemoryRelation")
_LAST_PLAN = "coalesce(final_plan, physical_plan)"

SIGNALS = f"""{EXECUTIONS},
signals as (
  select run_key, execution_id,
    {_has('physical_plan', 'SortMergeJoin')} as has_sort_merge_join,
    {_has('physical_plan', 'BroadcastHashJoin')} as has_broadcast_join,
    {_has('physical_plan', 'Scan parquet')} as has_parquet_scan,
    {_has('physical_plan', *_CACHED_NAMES)} as has_cached_scan,
    {_has(_LAST_PLAN, 'SortMergeJoin')} as final_has_sort_merge_join,
    {_has(_LAST_PLAN, 'BroadcastHashJoin')} as final_has_broadcast_join,
    {_has(_LAST_PLAN, 'Scan parquet')} as final_has_parquet_scan,
    {_has(_LAST_PLAN, *_CACHED_NAMES)} as final_has_cached_scan
  from executions)"""

_SKEWED = "num_tasks >= 8 and shuffle_read_skew_ratio >= 3.0"
_SMALL = (
    "num_tasks >= 20 and total_input_bytes > 0 "
    "and total_input_bytes / num_tasks < 5 * 1024 * 1024"
)
_SPILLED = "total_memory_spilled + total_disk_spilled > 1"
_SERDE = (
    "num_tasks >= 8 and total_executor_run_time_ms > 0 "
    "and serde_time_ms / total_executor_run_time_ms >= 0.25"
)
_NO_STAGE = "null::integer as stage_id"
_NO_EXECUTION = "null::bigint as execution_id"
_SCANS_UNCACHED = """
  select run_key, count(*) filter (has_parquet_scan) as scans
  from signals group by run_key
  having count(*) filter (has_parquet_scan) >= 2 and not bool_or(has_cached_scan)"""

def _fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', ({value})::double)"


_SKEW_TEXT = (
    f"'largest / median shuffle read = ' || {_fixed('shuffle_read_skew_ratio', 1)} "
    "|| '; limit = 3; tasks = ' || num_tasks"
)
_SMALL_TEXT = (
    f"'input per task, KB = ' || {_fixed('total_input_bytes / num_tasks / 1024', 1)} "
    "|| '; limit = 5120; tasks = ' || num_tasks"
)
_SPILL_TEXT = (
    f"'spilled from memory, MB = ' || {_fixed('total_memory_spilled / 1e6', 1)} "
    f"|| '; to disk, MB = ' || {_fixed('total_disk_spilled / 1e6', 1)}"
)
_SERDE_TEXT = (
    f"'serialization, % of run time = ' || "
    f"{_fixed('serde_time_ms / total_executor_run_time_ms * 100', 0)} || '; limit = 25'"
)

FINDINGS = f"""{STAGES},{SIGNALS},
findings as (
  select run_key, 1 as detector_ord, 'skew' as category,
    case when shuffle_read_skew_ratio >= 10 then 'high' else 'medium' end as severity,
    stage_id, {_NO_EXECUTION}, {_SKEW_TEXT} as message
  from stages where {_SKEWED}
  union all
  select run_key, 2, 'small_files', 'medium', stage_id, null, {_SMALL_TEXT} from stages where {_SMALL}
  union all
  select run_key, 3, 'missing_broadcast', 'high', null, execution_id,
    'execution = ' || execution_id || '; sort-merge joins in the plan = yes; broadcast joins = no'
  from signals
  where has_sort_merge_join and not has_broadcast_join
  union all
  select run_key, 4, 'missing_cache', 'medium', null, null,
    'executions that scan parquet = ' || scans || '; limit = 2; cached scans = none'
  from ({_SCANS_UNCACHED})
  union all
  select run_key, 5, 'spill', case when total_disk_spilled > 0 then 'high' else 'medium' end,
    stage_id, null, {_SPILL_TEXT} from stages where {_SPILLED}
  union all
  select run_key, 6, 'serialization_overhead', 'low', stage_id, null, {_SERDE_TEXT}
  from stages where {_SERDE})"""

_NAMES_BY_NO = " ".join(f"when {no} then '{name}'" for no, name in enumerate(t.APP_NAMES))

APPS = f"""
apps as (
  select 'run_' || app_no as run_key, 'app-' || app_no as app_id,
    case app_no {_NAMES_BY_NO} end as app_name, 'run_' || app_no as log_path, start_ms,
    true as finished
  from (select o_custkey % 4 as app_no, min({_day_ms('o_orderdate')}) as start_ms
        from orders group by 1))"""

MANY_APPS = """
many_apps as (
  select 'logs/' || c_custkey as run_key, 'app-' || c_custkey as app_id,
    'job_' || c_nationkey as app_name, 'logs/' || c_custkey as log_path,
    cast(floor(c_acctbal / 10) as bigint) as start_ms
  from customer)"""

_PAIR_VALUES = ", ".join(f"('{label}', '{b}', '{u}')" for label, b, u in t.PAIRS)

PAIRS = f"""{APPS},
paired as (
  select label, baseline_app, tuned_app, b.run_key as baseline_run, u.run_key as tuned_run,
    replace(baseline_app, '_baseline', '') as report_name,
    case when b.run_key is not null and u.run_key is not null then 'compared' else 'skipped' end
      as status,
    case when b.run_key is null then baseline_app when u.run_key is null then tuned_app end
      as missing_app
  from (values {_PAIR_VALUES}) as p(label, baseline_app, tuned_app)
  left join apps b on b.app_name = baseline_app
  left join apps u on u.app_name = tuned_app)"""

# Metric names with their place and source.
_COMPARED = [
    ("tasks", "total_tasks"),
    ("shuffle_read_bytes", "total_shuffle_read_bytes"),
    ("shuffle_write_bytes", "total_shuffle_write_bytes"),
    ("spill_bytes", "total_memory_spilled + {side}.total_disk_spilled"),
    ("executor_run_time_ms", "total_executor_run_time_ms"),
    ("longest_task_ms", "max_task_run_time_ms"),
    ("worst_skew_ratio", "worst_skew_ratio"),
]


def _metric_row(place: int, name: str, source: str) -> str:
    b, u = f"b.{source.format(side='b')}", f"u.{source.format(side='u')}"
    row = f"""
  select label, report_name, {place} as metric_ord, '{name}' as metric,
    ({b})::double as baseline, ({u})::double as tuned
  from paired join app_sums b on b.run_key = baseline_run join app_sums u on u.run_key = tuned_run"""
    if name == "worst_skew_ratio":
        row += f" where {b} is not null or {u} is not null"
    return row


_METRIC_ROWS = " union all ".join(
    _metric_row(place, name, source) for place, (name, source) in enumerate(_COMPARED, 1)
)

_PHASED = """
phased as (
  select label, report_name, 'before' as phase, baseline_run as run_key from paired
  where status = 'compared'
  union all
  select label, report_name, 'after', tuned_run from paired where status = 'compared')"""


def _lehmer(number: str, seed: int, buckets: str) -> str:
    start = f"(({number} + {seed}) % 2147483647)"
    once = f"({start} * 48271 % 2147483647)"
    return f"((({once} + {seed}) * 48271 % 2147483647) % ({buckets}))"


def _customer(key: str, hot_rows: str, cold: str, seed: int) -> str:
    return f"case when {key} < ({hot_rows}) then 1 else {_lehmer(key, seed, cold)} + 2 end::bigint"


def _amount(key: str, seed: int) -> str:
    return f"round({_lehmer(key, seed, '100000')} / 100::double, 2)"


_HOT_FACTS = """
hot_orders as (
  select case when o_orderkey < (select count(*) * 35 // 100 from orders) then 1
         else o_custkey + 2 end as customer_id,
    o_orderkey as order_id, o_totalprice::decimal(18, 2) as order_amount
  from orders),
hot_events as (
  select case when event_id < (select count(*) * 17 // 100 from events) then 1
         else user_id + 2 end as customer_id, event_id, event_type
  from events)"""

# A plain join that forms every pair, unlike the queries.
_HOT_JOIN = f"""with {_HOT_FACTS}
select customer_id, count(*) as matched_pairs, sum(order_amount)::double as total_amount
from hot_orders join hot_events using (customer_id) group by 1"""

_HOT_LEFT_JOIN = f"""with {_HOT_FACTS}
select order_id, customer_id, n_events
from hot_orders left join
  (select customer_id, count(*) as n_events from hot_events group by 1) using (customer_id)"""

_DIM_JOIN = """
select c_nationkey as signup_region, sum(o_totalprice::decimal(18, 2))::double as total
from orders join customer on o_custkey = c_custkey group by 1"""

_REGION_TOTAL = """
select o_orderpriority as region, sum(o_totalprice::decimal(18, 2))::double as region_total
from orders group by 1"""

ENRICHED = """
enriched as (
  select c_custkey as customer_id, o_orderkey as order_id, o_totalprice as order_amount,
    o_orderpriority as region, c_name as customer_name, c_nationkey as signup_region,
    upper(c_name) as name_upper, cast(floor(o_totalprice / 100) as integer) as amount_bucket
  from orders join customer on o_custkey = c_custkey)"""

_REUSE = f"""with {ENRICHED}
select 'region' as dim, region as dim_key, sum(order_amount::decimal(18, 2))::double as value
from enriched group by region
union all
select 'bucket', amount_bucket::varchar, count(*)::double from enriched group by amount_bucket
union all
select 'signup', signup_region::varchar,
  sum(order_amount::decimal(18, 2))::double / count(order_amount)
from enriched group by signup_region"""


def _bytes_text(value: str) -> str:
    """Bytes in the largest unit that keeps the number below 1024; terabytes are the last."""
    text = f"{_fixed(f'{value} / 1024.0::double ** 4', 1)} || 'TB'"
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        shown = _fixed(f"{value} / 1024.0::double ** {power}", 1)
        text = f"case when abs({value}) < 1024.0::double ** {power + 1} then {shown} || '{unit}' else {text} end"
    return text


def _change_text(before: str, after: str) -> str:
    pct = f"(({after})::double - ({before})::double) / nullif(({before})::double, 0) * 100"
    return f"""case when {before} = 0 then case when {after} = 0 then 'n/a' else 'new' end
    else case when {pct} < 0 then '↓' else '↑' end || {_fixed(f'abs({pct})', 0)} || '%' end"""


def _ratio_text(value: str) -> str:
    return f"coalesce({_fixed(value, 1)} || 'x', 'n/a')"


def _key_profile(source: str, key: str) -> str:
    return f"""
select count(*) as n_keys, sum(n)::bigint as n_rows, max(n) as max_rows, median(n) as median_rows,
  max(n) / median(n) as skew_ratio
from (select {key}, count(*) as n from {source} group by 1)"""


def _stage_finding(where: str, severity: str, category: str, *evidence: str) -> str:
    columns = ", ".join(evidence)
    return f"""with {STAGES}
select run_key, stage_id, {_NO_EXECUTION}, '{category}' as category, {severity} as severity, {columns}
from stages where {where}"""


def _line(source: str, section: int, number: int, text: str, item: str = "0", sub: str = "0", where: str = "true", report: str = "run_key", label: str = "''") -> str:
    return f"""
  select {report} as report, {label} as label, {section} as section, ({item})::bigint as item,
    ({sub})::bigint as sub_item, {number} as line_no, {text} as line from {source} where {where}"""


def _advice_values() -> str:
    quote = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    rows = []
    for category, title, detail, conf, code in RECOMMENDATIONS:
        setting = None if conf is None else " = ".join(next(iter(conf.items())))
        rows.append("(" + ", ".join(map(quote, (category, title, detail, setting, code))) + ")")
    return ", ".join(rows)


_ADVICE = f"advice(category, title, detail, setting, code) as (values {_advice_values()})"
_WITHIN = "coalesce(stage_id, execution_id, 0)"
_FINDING = (
    "'- **[' || upper(severity) || '] ' || category || '**' || {stage} || ': ' || message"
)
_STAGE = "case when stage_id is not null then ' (stage ' || stage_id || ')' else '' end"

_HEAD = [
    "'# Spark application ' || app_name",
    "''",
    "'## Summary'",
    "'- Stages: ' || n_stages",
    "'- Tasks: ' || total_tasks",
    f"'- Shuffle read: ' || {_bytes_text('total_shuffle_read_bytes')}",
    f"'- Shuffle written: ' || {_bytes_text('total_shuffle_write_bytes')}",
    f"'- Spilled: ' || {_bytes_text('(total_memory_spilled + total_disk_spilled)')}",
    "''",
    "case when n_findings > 0 then '## Findings' else 'No rule found anything.' end",
]
# Lines of a recommendation in order, of which some are absent.
_ADVICE_LINES = """list_filter([
    '### ' || title, detail,
    case when setting is not null then '' end, case when setting is not null then 'Settings:' end,
    case when setting is not null then '```' end, setting, case when setting is not null then '```' end,
    case when code is not null then '' end, case when code is not null then 'Code:' end,
    case when code is not null then '```python' end, code, case when code is not null then '```' end,
    ''], lambda x: x is not null)"""

_SINGLE_RUN = f"""with {APP_SUMS.replace(STAGES, FINDINGS)},{APPS},{_ADVICE},
counts as (select run_key, count(*) as n_findings from findings group by 1),
runs as (
  select run_key, app_name, app_sums.* exclude (run_key), coalesce(n_findings, 0) as n_findings
  from apps join app_sums using (run_key) left join counts using (run_key)),
advised as (
  select run_key, first_seen, {_ADVICE_LINES} as texts
  from (select run_key, category, min(detector_ord) as first_seen from findings group by 1, 2)
  join advice using (category))
select * from ({' union all '.join(_line('runs', 0, n, text) for n, text in enumerate(_HEAD))}
  union all {_line('findings', 1, 0, _FINDING.format(stage=_STAGE), 'detector_ord', _WITHIN)}
  union all {_line('runs', 2, 0, "''", where='n_findings > 0')}
  union all {_line('runs', 2, 1, "'## Recommendations'", where='n_findings > 0')}
  union all select run_key, '', 3, first_seen::bigint, 0::bigint, (i - 1)::integer, texts[i]
    from advised, lateral (select unnest(range(1, len(texts) + 1)) as i))"""


def _pair_line(source: str, section: int, number: int, text: str, item: str = "0", sub: str = "0", where: str = "true") -> str:
    return _line(source, section, number, text, item, sub, where, "report_name", "label")


_METRIC_TEXT = {
    True: (_bytes_text("baseline"), _bytes_text("tuned")),
    False: ("baseline::bigint::varchar", "tuned::bigint::varchar"),
}
_ROW_TEXT = f"""'| ' || metric || ' | ' || case
    when metric = 'worst_skew_ratio' then {_ratio_text('baseline')} || ' | ' || {_ratio_text('tuned')} || ' | '
      || case when baseline is null then 'n/a' else {_change_text('baseline', 'coalesce(tuned, 0)')} end
    when metric like '%bytes' then {_METRIC_TEXT[True][0]} || ' | ' || {_METRIC_TEXT[True][1]} || ' | ' || {_change_text('baseline', 'tuned')}
    else {_METRIC_TEXT[False][0]} || ' | ' || {_METRIC_TEXT[False][1]} || ' | ' || {_change_text('baseline', 'tuned')} end || ' |'"""

_NOTE = (
    f"'largest / median shuffle read: ' || {_ratio_text('b_ratio')} || ' -> ' || {_ratio_text('u_ratio')} "
    "|| '; longest task, ms: ' || b_longest || ' -> ' || u_longest "
    "|| '. Read both beside the summed executor time, which salting raises.'"
)

_COMPARISON = f"""with {APP_SUMS.replace(STAGES, FINDINGS)},{PAIRS},{_PHASED},{_ADVICE},
found as (
  select run_key, count(*) as n, count(*) filter (category = 'skew') as skews from findings group by 1),
compared as (
  select label, report_name, coalesce(bf.n, 0) as bn, coalesce(uf.n, 0) as un, coalesce(bf.skews, 0) > 0 as skewed,
    b.worst_skew_ratio as b_ratio, u.worst_skew_ratio as u_ratio,
    b.max_task_run_time_ms as b_longest, u.max_task_run_time_ms as u_longest
  from paired join app_sums b on b.run_key = baseline_run join app_sums u on u.run_key = tuned_run
  left join found bf on bf.run_key = baseline_run left join found uf on uf.run_key = tuned_run
  where status = 'compared'),
both_sides as (select * from findings join phased using (run_key)),
metric_rows as ({_METRIC_ROWS}),
fixes as (
  select label, report_name, title, detail, min(detector_ord) as first_seen
  from both_sides join advice using (category) where phase = 'before' group by 1, 2, 3, 4)
select * from ({_pair_line('compared', 0, 0, "'# ' || label || ': baseline and tuned'")}
  union all {_pair_line('compared', 0, 1, "''")}
  union all {_pair_line('compared', 0, 2, "'## Findings in the baseline'")}
  union all {_pair_line('compared', 0, 3, "'- none'", where='bn = 0')}
  union all {_pair_line('both_sides', 1, 0, _FINDING.format(stage="''"), 'detector_ord', _WITHIN, "phase = 'before'")}
  union all {_pair_line('compared', 2, 0, "''")}
  union all {_pair_line('compared', 2, 1, "'## Findings in the tuned run'")}
  union all {_pair_line('compared', 2, 2, "'- none'", where='un = 0')}
  union all {_pair_line('both_sides', 3, 0, _FINDING.format(stage="''"), 'detector_ord', _WITHIN, "phase = 'after'")}
  union all {_pair_line('compared', 4, 0, "''")}
  union all {_pair_line('compared', 4, 1, "'## Metrics'")}
  union all {_pair_line('compared', 4, 2, "'| metric | baseline | tuned | change |'")}
  union all {_pair_line('compared', 4, 3, "'|---|---|---|---|'")}
  union all {_pair_line('metric_rows', 5, 0, _ROW_TEXT, 'metric_ord')}
  union all {_pair_line('compared', 6, 0, "''", where='bn > 0')}
  union all {_pair_line('compared', 6, 1, "'## What fixed it'", where='bn > 0')}
  union all {_pair_line('fixes', 7, 0, "'- **' || title || '**: ' || detail", 'first_seen')}
  union all {_pair_line('compared', 8, 0, "''", where='skewed')}
  union all {_pair_line('compared', 8, 1, "'## About the longest task'", where='skewed')}
  union all {_pair_line('compared', 8, 2, _NOTE, where='skewed')})"""

ORACLE: dict[str, str] = {
    "evt_type_counts": f"""with {STAGES},{EXECUTIONS},{APPS}
select * from (
  select 'task_end' as kind, count(*) as events from tasks
  union all select 'stage_submitted', count(*) from stages
  union all select 'stage_completed', count(*) from stages
  union all select 'sql_start', count(*) from executions
  union all select 'sql_update', count(final_plan) from executions
  union all select 'sql_end', count(duration_ms) from executions
  union all select 'app_start', count(*) from apps
  union all select 'app_end', count(*) from apps)""",
    "evt_task_extract": f"with {TASKS} select * from tasks",
    "evt_stage_rollup": f"with {STAGES} select * exclude (task_duration_skew_ratio) from stages",
    "evt_apps": f"with {APPS} select * from apps",
    "sql_durations": f"with {EXECUTIONS} select * from executions",
    "plan_signals": f"with {SIGNALS} select * from signals",
    "latest_runs": f"""with {MANY_APPS}
select app_name, run_key, app_id, log_path, start_ms from many_apps
qualify row_number() over (partition by app_name order by start_ms desc, run_key desc) = 1""",
    "find_run": f"""with {MANY_APPS}
select app_name, run_key, app_id, log_path, start_ms from many_apps where app_name = 'job_7'
order by start_ms desc, run_key desc limit 1""",
    "latest_run": f"""with {MANY_APPS}
select app_name, run_key, app_id, log_path, start_ms from many_apps
where starts_with(app_name, 'job_1') order by start_ms desc, run_key desc limit 1""",
    "stage_rollup": f"with {STAGES} select * from stages",
    "stage_rollup_succeeded": f"""with {TASKS}
select run_key, stage_id, count(*) as num_tasks,
  sum(shuffle_read_bytes)::bigint as total_shuffle_read_bytes,
  case when count(*) filter (shuffle_read_bytes > 0) >= 2
    then max(shuffle_read_bytes) / median(shuffle_read_bytes) filter (shuffle_read_bytes > 0)
    end as shuffle_read_skew_ratio
from tasks where not failed group by 1, 2""",
    "stage_shuffle_skew": f"""with {TASKS}
select run_key, stage_id,
  case when count(*) >= 2 then max(shuffle_read_bytes) / median(shuffle_read_bytes) end
    as shuffle_read_skew_ratio
from tasks where shuffle_read_bytes > 0 group by 1, 2""",
    "stage_duration_skew": f"""with {TASKS}
select run_key, stage_id,
  case when count(*) >= 2 then max(executor_run_time_ms) / median(executor_run_time_ms) end
    as task_duration_skew_ratio
from tasks where executor_run_time_ms > 0 group by 1, 2""",
    "app_rollup": f"with {APP_SUMS} select * from app_sums",
    "combined_plans": f"""with {EXECUTIONS}
select run_key, execution_id // 64 as part,
  string_agg(physical_plan, chr(10) || '---' || chr(10) order by execution_id) as plans
from executions group by 1, 2""",
    "run_summary": f"""with {APP_SUMS}
select run_key, n_stages, total_tasks, total_shuffle_read_bytes, total_shuffle_write_bytes,
  total_memory_spilled + total_disk_spilled as total_spill_bytes
from app_sums""",
    "detect_skew": _stage_finding(
        _SKEWED,
        "case when shuffle_read_skew_ratio >= 10 then 'high' else 'medium' end",
        "skew",
        "printf('%.2f', shuffle_read_skew_ratio)::double as skew_ratio",
        "num_tasks::double as num_tasks",
        "total_shuffle_read_bytes::double as total_shuffle_read_bytes",
    ),
    "detect_small_files": _stage_finding(
        _SMALL,
        "'medium'",
        "small_files",
        "num_tasks::double as num_tasks",
        "printf('%.1f', total_input_bytes / num_tasks)::double as avg_input_bytes_per_task",
        "total_input_bytes::double as total_input_bytes",
    ),
    "detect_missing_broadcast": f"""with {SIGNALS}
select run_key, {_NO_STAGE}, execution_id, 'missing_broadcast' as category, 'high' as severity
from signals where has_sort_merge_join and not has_broadcast_join""",
    "detect_missing_broadcast_final": f"""with {SIGNALS}
select run_key, {_NO_STAGE}, execution_id, 'missing_broadcast' as category, 'high' as severity
from signals where final_has_sort_merge_join and not final_has_broadcast_join""",
    "detect_missing_broadcast_sized": f"""with {SIGNALS},
sides as (
  select 'run_' || (o_custkey % 4) as run_key, l_orderkey as execution_id, l_linenumber % 2 as side, sum({_P}) as bytes
  from lineitem join orders on l_orderkey = o_orderkey where l_returnflag <> 'R' group by 1, 2, 3),
small as (select run_key, execution_id, min(bytes) as bytes from sides group by 1, 2 having count(*) = 2)
select run_key, {_NO_STAGE}, execution_id, 'missing_broadcast' as category, 'high' as severity,
  bytes::double as small_side_bytes
from signals left join small using (run_key, execution_id)
where has_sort_merge_join and not has_broadcast_join and (bytes is null or bytes <= 50000)""",
    "detect_missing_cache": f"""with {SIGNALS}
select run_key, {_NO_STAGE}, {_NO_EXECUTION}, 'missing_cache' as category, 'medium' as severity,
  scans::double as num_scanning_executions
from ({_SCANS_UNCACHED})""",
    "detect_spill": _stage_finding(
        _SPILLED,
        "case when total_disk_spilled > 0 then 'high' else 'medium' end",
        "spill",
        "total_memory_spilled::double as memory_spilled_bytes",
        "total_disk_spilled::double as disk_spilled_bytes",
    ),
    "detect_serialization": _stage_finding(
        _SERDE,
        "'low'",
        "serialization_overhead",
        "printf('%.3f', serde_time_ms / total_executor_run_time_ms)::double as overhead_ratio",
    ),
    "all_findings": f"""with {FINDINGS},{APPS}
select run_key, app_name, detector_ord, category, severity, stage_id, execution_id, message
from findings join apps using (run_key)""",
    "findings_listing": f"""with {FINDINGS}
select run_key, category, stage_id, execution_id,
  row_number() over (partition by run_key order by detector_ord, coalesce(stage_id, execution_id, 0))
    as listing_position
from findings""",
    "finding_recommendations": f"""with {FINDINGS}
select run_key, stage_id, execution_id, category,
  case category
    when 'skew' then 'spark.sql.adaptive.skewJoin.enabled'
    when 'small_files' then 'spark.sql.files.maxPartitionBytes'
    when 'missing_broadcast' then 'spark.sql.autoBroadcastJoinThreshold'
    when 'spill' then 'spark.sql.shuffle.partitions'
    when 'serialization_overhead' then 'spark.serializer' end as conf_key,
  case category
    when 'skew' then 'true'
    when 'small_files' then '134217728'
    when 'missing_broadcast' then '104857600'
    when 'spill' then '<increase from current value>'
    when 'serialization_overhead' then 'org.apache.spark.serializer.KryoSerializer' end as conf_value
from findings""",
    "recommendations": f"""with {FINDINGS}
select run_key, category, min(detector_ord) as first_seen, count(*) as n_findings
from findings group by 1, 2""",
    "compare_metrics": f"""with {APP_SUMS},{PAIRS}
select *, round((tuned - baseline) / nullif(baseline, 0) * 100, 6) as pct
from ({_METRIC_ROWS})""",
    "compare_findings": f"""with {FINDINGS},{PAIRS},{_PHASED}
select label, phase, run_key, category, severity, stage_id, execution_id
from findings join phased using (run_key)""",
    "compare_recommendations": f"""with {FINDINGS},{PAIRS},{_PHASED}
select label, report_name, category, min(detector_ord) as first_seen, count(*) as n_findings
from findings join phased using (run_key) where phase = 'before' group by 1, 2, 3""",
    "compare_suite": f"""with {FINDINGS},{PAIRS},
found as (
  select run_key, count(*) as n, count(*) filter (category = 'skew') as skews
  from findings group by 1),
worst as (
  select run_key, max(shuffle_read_skew_ratio) as ratio, max(max_task_run_time_ms) as longest
  from stages group by 1)
select label, status, missing_app, report_name,
  case when status = 'compared' then coalesce(bf.n, 0) end as baseline_findings,
  case when status = 'compared' then coalesce(uf.n, 0) end as tuned_findings,
  status = 'compared' and coalesce(bf.skews, 0) > 0 as has_skew_note,
  bw.ratio as baseline_skew_ratio, uw.ratio as tuned_skew_ratio,
  bw.longest as baseline_longest_task_ms, uw.longest as tuned_longest_task_ms
from paired
left join found bf on bf.run_key = baseline_run
left join found uf on uf.run_key = tuned_run
left join worst bw on bw.run_key = baseline_run
left join worst uw on uw.run_key = tuned_run""",
    "fmt_bytes_cases": f"""with {STAGES}
select run_key, stage_id, {_bytes_text('total_shuffle_read_bytes')} as shuffle_read,
  {_change_text('total_shuffle_read_bytes', 'total_shuffle_write_bytes')} as change
from stages""",
    "suite_report": f"""with {FINDINGS},{PAIRS}
select label, line_no, line from (
  select label, 0 as line_no, '## ' || label as line from paired
  union all select label, 1, case when status = 'compared' then 'See `' || report_name || '`'
    else '_skipped: no event log of ' || missing_app || '_' end from paired
  union all select label, 2, '' from paired)""",
    "single_run_report": _SINGLE_RUN,
    "single_run_report_files": f"""
select report, row_number() over (partition by report order by label, section, item, sub_item, line_no) - 1 as line_no, line
from ({_SINGLE_RUN})""",
    "comparison_report": _COMPARISON,
    "pct_change": """
select l_partkey, round((taxes - discounts) / nullif(discounts, 0) * 100, 6) as pct
from (select l_partkey, sum(floor(l_discount * 100 + 0.5::double)) as discounts,
        sum(floor(l_tax * 100 + 0.5::double)) as taxes
      from lineitem group by 1)""",
    "shuffle_join_hot_key": _HOT_JOIN,
    "salted_join_hot_key": _HOT_JOIN,
    "salted_join_rows": _HOT_LEFT_JOIN,
    "salted_join_grid": f"""with {_HOT_FACTS}
select order_id, customer_id, event_type, n_events
from hot_orders join
  (select customer_id, event_type, count(*) as n_events from hot_events group by 1, 2)
  using (customer_id)""",
    "skew_aware_join": _HOT_LEFT_JOIN,
    "dim_join_shuffle": _DIM_JOIN,
    "dim_join_broadcast": _DIM_JOIN,
    "key_skew_profile": _key_profile("orders", "o_custkey"),
    "key_skew_profile_hot": f"with {_HOT_FACTS}" + _key_profile("hot_orders", "customer_id"),
    "hot_keys": f"""with {_HOT_FACTS}
select customer_id, count(*) as rows, ceil(count(*) / any_value(per))::integer as salts
from hot_orders, (select greatest(count(*) // 20, 1) as per from orders) group by 1
having count(*) > any_value(per)""",
    "small_files_region_total": _REGION_TOTAL,
    "small_files_compacted": _REGION_TOTAL,
    # One file per status: each has far fewer bytes than a file may.
    "rebalanced_write": """
select o_orderstatus, count(*) as orders, sum(o_totalprice::decimal(18, 2))::double as total, 1::bigint as files
from orders group by 1""",
    "small_files_write": """
select o_orderpriority, count(*) as orders, sum(o_totalprice::decimal(18, 2))::double as total, 300::bigint as files
from orders group by 1""",
    "row_range": """
with ids as (select unnest(range(0, (select count(*) from orders))) as id)
select id, id in (select o_orderkey from orders) as ordered from ids""",
    "enrich_orders": f"with {ENRICHED} select * from enriched",
    "enrich_orders_limited": f"""with {ENRICHED}
select * from enriched where order_id in (select o_orderkey from orders order by 1 limit 1000)""",
    "enriched_hashes": f"""with {ENRICHED}
select region, count(distinct name_upper || '-' || order_id) as hashes from enriched group by 1""",
    "reuse_by_region": f"""with {ENRICHED}
select region, sum(order_amount::decimal(18, 2))::double as total from enriched group by 1""",
    "reuse_by_bucket": f"""with {ENRICHED}
select amount_bucket, count(*) as orders from enriched group by 1""",
    "reuse_by_signup": f"""with {ENRICHED}
select signup_region, sum(order_amount::decimal(18, 2))::double / count(order_amount) as avg_amount
from enriched group by 1""",
    "reuse_uncached": _REUSE,
    "reuse_cached": _REUSE,
    "reuse_grouping_sets": _REUSE,
    "gen_skewed_orders": f"""
select o_orderkey as order_id,
  {_customer('o_orderkey', 'select count(*) * 35 // 100 from orders',
             '(select count(*) - 2 from customer)', 42)} as customer_id,
  {_amount('o_orderkey', 7)} as order_amount,
  timestamp '2024-01-01 00:00:00' as order_ts,
  {_lehmer('o_orderkey', 3, '5')}::integer as region
from orders""",
    "gen_customers": f"""
select c_custkey as customer_id, 'customer_' || c_custkey as customer_name,
  {_lehmer('c_custkey', 11, '5')}::integer as signup_region
from customer""",
    "gen_orders_join_fact": f"""
select o_orderkey as order_id,
  {_customer('o_orderkey', 'select count(*) * 3 // 23 from orders', '2000', 21)} as customer_id,
  {_amount('o_orderkey', 22)} as order_amount
from orders""",
    "gen_events_join_fact": f"""
select event_id,
  {_customer('event_id', 'select count(*) // 6 from events', '2000', 23)} as customer_id,
  {_lehmer('event_id', 24, '4')}::integer as event_type
from events""",
}
