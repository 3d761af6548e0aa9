"""The registered queries once more, as plain SQL over the same tables (DuckDB dialect).

Written independently of the operators: one window per record, correlated tests, plain joins.
"""

from __future__ import annotations

from pulsegrid.operators.grid import context_names
from pulsegrid.schema import FEATURES

CTES: dict[str, str] = {}

CTES["sig"] = """
select concat('P', cast(user_id % 10 as varchar)) as grp, concat('R', cast(user_id as varchar)) as record, event_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as double) as time_elapsed,
  case when event_id % 11 = 0 then null else value end as heart_rate,
  case when event_id % 7 = 0 then null else cast(regexp_extract(props, '([0-9]+)', 1) as double) end as breathing_rate,
  value * 0.01::double as activity,
  case when user_id % 10 = 3 then null else cast(event_id % 13 as double) end as cadence,
  event_type, concat(replace(cast(value as varchar), '.', ','), ' bpm') as hr_text
from events"""

CTES["ann"] = """
select grp, record, event_id as ann_pos, cast(time_elapsed as int) as onset, cast(event_id % 9 as int) as duration,
  case when event_id % 2 = 0 then 'Sz fbtcs' else 'FAS' end as description,
  case when record not like '%1' then cast(time_elapsed as int) else 0 end + cast(event_id % 4 as int) as generalization
from sig where event_type = 'error' and event_id % 3 = 0"""

CTES["gen"] = """
select *, case when avg(case when generalization >= onset then 1.0 else 0.0 end) over (partition by grp, record) > 0.8
  then greatest(0, generalization - onset) else generalization end as gen_offset from ann"""

CTES["sann"] = """
select *, case when avg(case when generalization >= onset then 1.0 else 0.0 end) over (partition by grp, record) > 0.8
  then greatest(0, generalization - onset) else generalization end as gen_offset
from ann where lower(description) like '%fbtcs%'"""

CTES["lab"] = """
select s.*, case when exists (select 1 from ann a where a.grp = s.grp and a.record = s.record and a.duration > 0
    and lower(a.description) like '%fbtcs%'
    and s.time_elapsed >= a.onset and s.time_elapsed < a.onset + a.duration) then 1 else 0 end as label
from sig s"""


def _features(name: str, w: int, step: int = 5) -> str:
    def stats(c: str, p: str) -> str:
        return (
            f"avg({c}) over w as {p}_mean, stddev_pop({c}) over w as {p}_std, "
            f"{c} - lag({c}, {w - 1}) over r as Delta{p}"
        )

    return f"""
select *, case when DeltaBR <> 0 then DeltaHR / DeltaBR end as Ratio_DHR_DBR, (rn - {w}) // {step} as idx from (
  select grp, record, time_elapsed as time, {w} as "window", row_number() over r as rn,
    {stats('heart_rate', 'HR')}, max(heart_rate) over w - min(heart_rate) over w as HR_range,
    {stats('breathing_rate', 'BR')}, {stats('activity', 'Act')}, {stats('cadence', 'Cad')},
    max(label) over w as label
  from lab
  window r as (partition by grp, record order by time_elapsed),
    w as (partition by grp, record order by time_elapsed rows between {w - 1} preceding and current row)
) where rn >= {w} and (rn - {w}) % {step} = 0"""


for _w in (10, 15, 30):
    CTES[f"feat{_w}"] = _features(f"feat{_w}", _w)

CTES["scored"] = """
select cast(substr(grp, 2) as int) % 3 as fold, grp, record, time, idx, label,
  round(least(1, coalesce(HR_mean, 0) / 100), 6) as score from feat15"""

CTES["dealt"] = """
select grp, case when turn < 7 then turn else 13 - turn end as deal from (select grp, (row_number() over (
  order by n_pos desc, n desc, grp) - 1) % 14 as turn from (
    select grp, count(*) as n, count(*) filter (where label = 1) as n_pos from scored group by grp))"""

CTES["fired"] = """
select *, case when sum(score) over (partition by grp, record order by idx rows between 2 preceding and 1 following) / 4
  >= 0.45 then 1 else 0 end as pred from scored"""

CTES["runs"] = """
select kind, fold, grp, record, min(idx) as i0, max(idx) as i1, count(*) as n, min(idx) * 5 as start_s, max(idx) * 5 as end_s
from (select *, idx - row_number() over (partition by kind, grp, record order by idx) as island from (
  select 'pred' as kind, * from fired where pred = 1 union all select 'true' as kind, * from fired where label = 1))
group by kind, fold, grp, record, island"""
CTES["te"] = "select * from runs where kind = 'true'"
CTES["pe"] = "select * from runs where kind = 'pred'"

CTES["pairs"] = """
select p.fold, p.grp, p.record, p.start_s as p_start, p.end_s as p_end, t.start_s as t_start, t.end_s as t_end
from pe p join te t on p.grp = t.grp and p.record = t.record and p.end_s >= t.start_s - 15 and p.start_s <= t.end_s + 15"""

CTES["best"] = """
select * from (select *, greatest(0, least(p_end, t_end) - greatest(p_start, t_start)) as overlap_s,
  row_number() over (partition by grp, record, p_start order by
    greatest(0, least(p_end, t_end) - greatest(p_start, t_start)) desc, abs(t_start - p_start), t_start) as rk
  from pairs) where rk = 1"""

CTES["hits"] = """
select t.fold, t.grp, t.record, t.start_s, t.end_s, t.i0, t.i1, t.n, min(f.idx) as hit
from te t left join fired f on f.grp = t.grp and f.record = t.record and f.pred = 1
  and f.idx >= t.i0 - 3 and f.idx < t.i1 + 1 + 3
group by all"""

CTES["near"] = """
select * exclude (rk) from (
  select h.*, a.onset, a.gen_offset,
    row_number() over (partition by h.grp, h.record, h.start_s order by abs(a.onset - h.start_s), a.ann_pos) as rk
  from hits h left join sann a on a.grp = h.grp and a.record = h.record) where rk = 1"""

CTES["gt"] = """
select fold, grp, record, start_s, end_s, case when hit is null then 0 else 1 end as detected,
  case when hit is not null then greatest(0, (hit - i0) * 5) end as det_latency_s,
  case when hit is not null and abs(onset - start_s) <= 30
    then greatest(0, greatest(0, (hit - i0) * 5) - gen_offset) end as gen_latency_s,
  end_s - start_s as duration_s from near"""

CTES["tp"] = """
select b.fold, b.grp, b.record, b.p_start as start_s, b.p_end as end_s, g.det_latency_s, g.gen_latency_s,
  b.p_end - b.p_start as duration_s
from best b left join gt g on g.grp = b.grp and g.record = b.record and g.start_s = b.t_start"""

CTES["fp"] = """
select fold, grp, record, start_s, end_s, end_s - start_s as duration_s from pe p where not exists (
  select 1 from te t where p.grp = t.grp and p.record = t.record and p.end_s >= t.start_s - 15 and p.start_s <= t.end_s + 15)"""

CTES["fn"] = """
select fold, grp, record, start_s, end_s, end_s - start_s as duration_s from te t where not exists (
  select 1 from pe p where p.grp = t.grp and p.record = t.record and p.end_s >= t.start_s - 15 and p.start_s <= t.end_s + 15)"""

CTES["lat"] = """
select fold, grp, record, start_s, (hit - i0) * 5 as det_latency_s,
  case when abs(onset - start_s) <= 30 then greatest(0, greatest(0, (hit - i0) * 5) - gen_offset) end as gen_latency_s
from near where n >= 2 and hit is not null"""

CTES["latrep"] = """
select fold, count(*) as n_detected, avg(det_latency_s) as detection_latency, avg(gen_latency_s) as gen_latency
from lat group by fold"""

CTES["confusion"] = """
select fold, count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 1) as fp,
  count(*) filter (where label = 1 and pred = 0) as fn, count(*) filter (where label = 0 and pred = 0) as tn
from fired group by fold"""

CTES["epoch"] = """
select *, case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall_epoch,
  case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision_epoch,
  case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1_epoch from confusion"""

CTES["merged"] = """
select kind, fold, grp, record, chain, min(start_s) as a, max(end_s) + 5 as b from (
  select *, sum(fresh) over (partition by kind, grp, record order by start_s) as chain from (
    select *, case when start_s - (lag(end_s) over (partition by kind, grp, record order by start_s) + 5) < 240
      then 0 else 1 end as fresh from runs))
group by kind, fold, grp, record, chain"""

CTES["pieces"] = """
select kind, fold, grp, record, s as a, least(b, s + 1000) as b
from (select *, unnest(generate_series(a, b - 1, 1000)) as s from (select kind, fold, grp, record, a, b from merged)) """

CTES["evm"] = """
select f.fold, coalesce(t.n_truth, 0) as n_truth, coalesce(t.tp, 0) as tp, coalesce(p.fp, 0) as fp, f.n,
  case when t.n_truth > 0 then t.tp / t.n_truth end as sensitivity,
  case when coalesce(t.tp, 0) + coalesce(p.fp, 0) > 0
    then coalesce(t.tp, 0) / (coalesce(t.tp, 0) + coalesce(p.fp, 0)) end as "precision",
  coalesce(p.fp, 0) * 24 / (f.n * 5 / 3600) as far_24h
from (select fold, count(*) as n from fired group by fold) f
left join (select fold, count(*) as n_truth, cast(sum(case when exists (select 1 from pieces h where h.kind = 'pred'
      and h.grp = x.grp and h.record = x.record and h.b > x.a - 15 and h.a < x.b + 15) then 1 else 0 end) as bigint) as tp
    from pieces x where kind = 'true' group by fold) t on t.fold = f.fold
left join (select fold, cast(sum(case when exists (select 1 from pieces x where x.kind = 'true'
      and h.grp = x.grp and h.record = x.record and h.b > x.a - 15 and h.a < x.b + 15) then 0 else 1 end) as bigint) as fp
    from pieces h where kind = 'pred' group by fold) p on p.fold = f.fold"""

CTES["evf"] = """
select *, case when sensitivity + "precision" > 0 then 2 * sensitivity * "precision" / (sensitivity + "precision") end as f1
from evm"""

CTES["rep"] = """
select 'stand-in' as model, e.fold, e.f1, ep.f1_epoch, e."precision", ep.precision_epoch, e.sensitivity as recall,
  ep.recall_epoch, e.sensitivity as sens_evt, cast(e.fp as double) as fp_evt, e.far_24h as far_evt,
  4.0::double as width, 0.45::double as threshold, l.detection_latency, l.gen_latency
from evf e join epoch ep on ep.fold = e.fold left join latrep l on l.fold = e.fold"""


def _sweep() -> str:
    parts = []
    for w in (4, 6, 8):
        frame = f"rows between {w // 2} preceding and {w - w // 2 - 1} following"
        for t in (0.35, 0.45, 0.55):
            parts.append(
                f"select fold, grp, label, {w} as width, {t}::double as threshold, case when sum(score) over "
                f"(partition by grp, record order by idx {frame}) / {w} >= {t} then 1 else 0 end as pred from scored"
            )
    return " union all ".join(parts)


CTES["swept"] = _sweep()


def _swept_counts(by: str) -> str:
    return f"""
select *, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1,
  case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall from (
  select {by}, width, threshold,
    count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 1) as fp,
    count(*) filter (where label = 1 and pred = 0) as fn, count(*) filter (where label = 0 and pred = 0) as tn
  from swept group by {by}, width, threshold)"""


CTES["sweep_fold"] = _swept_counts("fold")
CTES["sweep_grp"] = _swept_counts("fold, grp")

CTES["sparse"] = """
select concat('P', cast(user_id % 10 as varchar)) as grp, concat('R', cast(user_id as varchar)) as record, event_id,
  cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3600000000) as bigint) as sec,
  case when event_id % 11 = 0 then null else value end as heart_rate,
  case when event_id % 7 = 0 then null else cast(event_id % 17 as double) end as breathing_rate
from events"""

CTES["persec"] = """
select grp, record, sec,
  arg_max(breathing_rate, event_id) filter (where breathing_rate is not null) as breathing_rate,
  arg_max(heart_rate, event_id) filter (where heart_rate is not null) as heart_rate
from sparse group by grp, record, sec"""

CTES["grid"] = """
select g.grp, g.record, g.sec, p.breathing_rate, p.heart_rate
from (select grp, record, unnest(generate_series(min(sec), max(sec))) as sec from persec group by grp, record) g
left join persec p on p.grp = g.grp and p.record = g.record and p.sec = g.sec"""


def _context(forward: bool) -> str:
    cols = []
    for c in ("activity", "breathing_rate", "cadence", "heart_rate"):
        for k in range(14, -1, -1):
            shift = f"lead({c}, {14 - k})" if forward else f"lag({c}, {k})"
            ok = "rn + 14 <= n" if forward else "rn > 14"
            cols.append(f'case when {ok} then {shift} over r end as "{c}_t-{k}"')
    return f"""
select grp, record, time_elapsed as time, {', '.join(cols)}
from (select *, row_number() over (partition by grp, record order by time_elapsed) as rn,
  count(*) over (partition by grp, record) as n from sig)
window r as (partition by grp, record order by time_elapsed)"""


CTES["ctxf"] = _context(True)
CTES["ctxt"] = _context(False)
CTES["data"] = "select f.*, c.* exclude (grp, record, time) from feat15 f join ctxf c on c.grp = f.grp and c.record = f.record and c.time = f.time"


def _closure(text: str, found: list[str]) -> list[str]:
    import re

    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", text):
            _closure(CTES[name], found)
            if name not in found:
                found.append(name)
    return found


def with_views(sql: str) -> str:
    """Prefix `sql` with the common table expressions it names, in order of definition."""
    needed = set(_closure(sql, []))
    parts = [f"{n} as ({CTES[n]})" for n in CTES if n in needed]
    return (f"with {', '.join(parts)} " if parts else "") + sql


def q(*cols: str) -> str:
    return ", ".join(f'"{c}"' for c in cols)


def r6(*cols: str) -> str:
    return ", ".join(f'round("{c}", 6) as "{c}"' for c in cols)


BAND = {"low": (1, 2), "mid": (3, 4), "high": (5, 7)}


def _band_power() -> str:
    import math

    def power(k: int) -> str:
        a = f"(off * {2 * math.pi * k / 15!r}::double)"
        return f"(pow(sum((x - m) * cos({a})), 2) + pow(sum((x - m) * sin({a})), 2)) / 15"

    cols = ", ".join(
        f"round({' + '.join(power(k) for k in range(a, b + 1))}, 6) as power_{n}" for n, (a, b) in BAND.items()
    )
    return f"""
select grp, record, max(time) as time, {cols} from (
  select w.grp, w.record, w.time as wt, s.time_elapsed as time, s.breathing_rate as x, s.time_elapsed - (w.time - 14) as off,
    avg(s.breathing_rate) over (partition by w.grp, w.record, w.time) as m
  from feat15 w join sig s on s.grp = w.grp and s.record = w.record and s.time_elapsed between w.time - 14 and w.time)
group by grp, record, wt"""


CH4 = ["heart_rate", "breathing_rate", "activity", "cadence"]
CONTEXT = context_names()
REPORT = ["f1", "f1_epoch", "precision", "precision_epoch", "recall", "recall_epoch", "sens_evt", "fp_evt", "far_evt",
          "width", "threshold", "detection_latency", "gen_latency"]
MEANS = [c for c in REPORT if c not in ("width", "threshold")]

_isnull = lambda cols: " + ".join(f'case when "{c}" is null then 1 else 0 end' for c in cols)
_fill = lambda c: (
    f"coalesce(last_value({c} ignore nulls) over (partition by grp, record order by time_elapsed rows between "
    f"unbounded preceding and current row), first_value({c} ignore nulls) over (partition by grp, record order by "
    f"time_elapsed rows between current row and unbounded following)) as {c}"
)
CTES["untimed"] = """select grp, record, event_id, case when time_elapsed <> 3 then time_elapsed end as time_elapsed,
  heart_rate, breathing_rate, cadence from sig"""
CTES["firstval"] = f"""select grp, record, {', '.join(f"min_by({c}, time_elapsed) filter ({c} is not null) as {c}" for c in CH4 if c != 'activity')}
  from untimed where time_elapsed is not null group by grp, record"""
CTES["filled15"] = f"select grp, record, time, {', '.join(_fill(c).replace('time_elapsed', 'time') for c in FEATURES)} from feat15"
_last3 = lambda c, t: (
    f"last_value({c} ignore nulls) over (partition by grp, record order by {t} range between 3 preceding and "
    f"current row) as {c}"
)
_NULLS = f"""(select count(*) as n, sum({_isnull(CONTEXT)}) as raw, sum({_isnull(FEATURES)}) as features from data)"""


def _null_block(name: str, width: int, col: str) -> str:
    return (
        f"select '{name}' as block, cast(n * {width} as bigint) as cells, cast({col} as bigint) as null_cells, "
        f"round(({col}) / (n * {width}), 6) as null_pct from {_NULLS}"
    )


SQL: dict[str, str] = {
    "scan_filter": "select event_id, user_id, value from events where value > 50 and event_type = 'error'",
    "signal": f"select grp, record, event_id, time_elapsed, {q(*CH4)} from sig",
    "clean_numbers": """select event_id, (try_cast(regexp_replace(replace(hr_text, ',', '.'), '[^0-9.+eE-]', '', 'g')
        as double)) as heart_rate from sig""",
    "time_cast": """select event_id, try_cast(case when event_id % 5 = 0 then '12e'
        else cast(case when event_id % 13 <> 0 then cast(time_elapsed * 256 + 1000 + event_id % 2 as bigint) end as varchar)
        end as double) as ticks from sig""",
    "elapsed_from_ticks": """select event_id, round((t - first_value(t ignore nulls) over (partition by grp, record
        order by time_elapsed rows between unbounded preceding and unbounded following)) / 256, 6) as time_elapsed
        from (select *, case when event_id % 13 <> 0 then time_elapsed * 256 + 1000 + event_id % 2 end as t from sig)""",
    "any_core_filter": f"""select grp, record, time_elapsed, {q(*CH4)} from (select grp, record, time_elapsed, cadence,
        case when event_id % 2 = 0 then activity end as activity,
        case when event_id % 3 = 0 then breathing_rate end as breathing_rate,
        case when event_id % 5 = 0 then heart_rate end as heart_rate from sig)
        where heart_rate is not null or breathing_rate is not null or activity is not null or cadence is not null""",
    "nan_cleanup": "select event_id, case when event_id % 4 <> 0 then value end as value from events",
    "record_normalize": "select event_id, concat('R', cast(user_id as varchar)) as record from events",
    "time_unit_repair": "select event_id, case when substr(record, -1) in ('0','4','8') then time_elapsed else time_elapsed - min(time_elapsed) over (partition by record) end as time from sig",
    "schema_fill": f"""select grp, record, activity, cast(null as double) as breathing_rate,
        cast(null as double) as cadence, heart_rate, 0::bigint as label, time_elapsed from sig""",
    "round_half_even": "select event_id, cast(round_even(time_elapsed + (event_id % 4) * 0.5::double, 0) as bigint) as sec from sig",
    "dedup_last": f"""select grp, record, event_id, sec, heart_rate, breathing_rate from (select *, row_number()
        over (partition by grp, record, sec order by event_id desc) as rk from sparse) where rk = 1""",
    "incremental_skip": """select distinct concat('R', cast(user_id as varchar)) as record from events where user_id not in (
        select user_id from events where event_type = 'signup' group by user_id having count(*) >= 12)""",
    "manifest_pending": """with named as (
          select user_id as u, event_type as input, count(*) as size, max(ts) as mtime from events group by 1, 2
        ), now as (
          select u, input, size + (u % 5 = 0)::int as size, mtime from named where not (u % 11 = 0 and input = 'error')
        ), newer as (
          select * from named where u % 2 = 0 and not (u % 3 = 0 and input = 'click')
        ), done as (
          select * from newer union all select u, input, 0, mtime from named where u % 7 <> 0 and u not in (select u from newer)
        ), differ as (
          (select * from now except select * from done) union all (select * from done except select * from now)
        )
        select distinct concat('P', cast(u % 10 as varchar)) as grp, concat('R', cast(u as varchar)) as record
        from now where u in (select u from differ)""",
    "event_type_filter": """select record, ann_pos, onset::bigint as onset, duration::bigint as duration from ann
        where lower(description) like '%fbtcs%'""",
    "annotation_clean": """select record, ann_pos, onset::bigint as onset,
        case when ann_pos % 7 <> 0 then duration::bigint end as duration,
        case when ann_pos % 4 <> 0 then generalization::bigint else 0 end as generalization from ann where ann_pos % 10 <> 0""",
    "dead_letters": """select 'row' as kind, record as place, ann_pos as "position", concat(o, ' | ', coalesce(d, ''), ' | ', description) as content,
          case when o = '' then 'no onset' when o = 'n/a' then 'onset is not a number' when d is null then 'no duration' else 'duration is not a number' end as reason
        from (
          select record, ann_pos, description, case when ann_pos % 10 = 0 then 'n/a' when ann_pos % 13 = 0 then '' else cast(onset as varchar) end as o,
            case when ann_pos % 7 = 0 then '?' when ann_pos % 11 <> 0 then cast(duration as varchar) end as d from ann
        ) where o in ('', 'n/a') or d is null or d = '?'""",
    "record_annotations": """select r.record, a.ann_pos, a.onset::bigint as onset, a.duration::bigint as duration from (select distinct record as rec,
        concat(record, case when record like '%2' then '_b_1Hz' else '_1Hz' end) as record from sig) r
        left join ann a on a.record = r.rec and r.record not like '%_b_1Hz'""",
    "interval_label": "select grp, record, event_id, time_elapsed, label::bigint as label from lab",
    "generalization_offset": "select record, ann_pos, onset::bigint as onset, gen_offset::bigint as gen_offset from gen",
    "window_features": f"select grp, record, time, {r6(*FEATURES)}, label::bigint as label from feat15",
    "multi_window": " union all ".join(
        f'select grp, record, time, {w}::bigint as "window", {r6(*FEATURES)}, label::bigint as label from feat{w}' for w in (10, 15, 30)
    ),
    "feature_select": f"select grp, record, time, {r6(*FEATURES)}, label::bigint as label from feat10",
    "band_power": _band_power(),
    "last_per_second": f"select grp, record, sec, breathing_rate, heart_rate from persec",
    "span_guard": """select grp, record, min(s) as lo, max(s) as hi, max(s) - min(s) as span from (select *,
        case when record like '%7' then sec * 20000 else sec end as s from sparse) group by grp, record
        having max(s) - min(s) > 5000000 or max(s) > 10000000""",
    "grid_1hz": f"select grp, record, sec, breathing_rate, heart_rate from grid",
    "resample_1hz": f"select grp, record, sec, {_last3('breathing_rate', 'sec')}, {_last3('heart_rate', 'sec')} from grid",
    "bounded_ffill": f"""select grp, record, cast(time_elapsed as bigint) as sec,
        {', '.join(_last3(c, 'time_elapsed') for c in CH4)} from sig""",
    "context_forward": f"select c.grp, c.record, c.time, {q(*CONTEXT)} from ctxf c join feat15 f on f.grp = c.grp and f.record = c.record and f.time = c.time",
    "context_trailing": f"select c.grp, c.record, c.time, {q(*CONTEXT)} from ctxt c join feat15 f on f.grp = c.grp and f.record = c.record and f.time = c.time",
    "context_join": "select f.grp, f.record, f.time, round(f.HR_mean, 6) as HR_mean, f.label::bigint as label, " + ", ".join(
        f'case when f.time >= b.lo and f.time + 2 <= b.hi then round(g{j}.{c}, 6) end as "{c}_t-{2 - j}"'
        for c in ("breathing_rate", "heart_rate") for j in range(3)
    ) + """ from feat15 f left join (select grp, record, min(sec) as lo, max(sec) as hi from persec
        group by grp, record) b on b.grp = f.grp and b.record = f.record """ + " ".join(
        f"left join persec g{j} on g{j}.grp = f.grp and g{j}.record = f.record and g{j}.sec = f.time + {j}"
        for j in range(3)
    ),
    "raw_semi": "select grp, record, event_id, sec from sparse where record in (select record from feat15 where label = 1)",
    "diag_union": """select grp, record, time_elapsed, case when event_type = 'error' then heart_rate end as heart_rate,
        case when event_type <> 'error' then cadence end as cadence from sig""",
    "key_intersect": """select record, time_elapsed from sig where event_type <> 'click' intersect
        select record, time_elapsed from sig where activity > 0.2""",
    "distinct_records": "select distinct grp, record from sig",
    "record_anchor": """select record, time + 0.25::double as time, timestamp '2000-01-01' + to_microseconds(cast(
        (dense_rank() over (order by record) - 1) * 86400000000 + round((time + 0.25) * 1000000) as bigint)) as time_dt,
        cast(floor(time + 0.25) as bigint) as elapsed_s from feat15""",
    "ordered_features": "select record, time, idx, label::bigint as label from feat15 order by record, time, idx",
    "null_share": "select * from (" + " union all ".join(
        f"""select '{c}' as "column", round(avg(case when "{c}" is null then 1.0::double else 0 end), 6) as null_share from data"""
        for c in FEATURES + CONTEXT
    ) + ")",
    "null_report": " union all ".join([
        _null_block("raw", 60, "raw"), _null_block("features", 14, "features"), _null_block("all", 74, "raw + features"),
    ]),
    "ffill_bfill": f"select grp, record, time_elapsed, {', '.join(_fill(c) for c in CH4 if c != 'activity')} from sig",
    "ffill_null_time": f"""select grp, record, event_id, time_elapsed, {', '.join(_fill(c) for c in CH4 if c != 'activity')}
        from untimed where time_elapsed is not null union all by name select t.grp, t.record, t.event_id, t.time_elapsed,
        {', '.join(f"coalesce(t.{c}, l.{c}) as {c}" for c in CH4 if c != 'activity')}
        from untimed t left join firstval l on l.grp = t.grp and l.record = t.record where t.time_elapsed is null""",
    "position_null_time": """select *, idx * 5 as elapsed_s from (select grp, record, event_id, time_elapsed,
        row_number() over (partition by grp, record order by time_elapsed nulls first) - 1 as idx from untimed)""",
    "ml_pipeline": "select grp, record, time, " + ", ".join(
        f"round((coalesce({c}, avg({c}) over ()) - avg({c}) over ()) / stddev_pop(coalesce({c}, m_{c})) over (), 6) as {c}" for c in FEATURES
    ) + " from (select *, " + ", ".join(f"avg({c}) over () as m_{c}" for c in FEATURES) + " from filled15)",
    "importance_top": "select model, feature, round(s / sum(s) over (partition by model), 6) as importance from ("
        "select model, feature, sum(s) as s from (select model, feature, "
        "coalesce(v / nullif(sum(v) over (partition by model, fold), 0), 0) as s from (" + " union all ".join(
            f"select cast(substr(grp, 2) as int) % 3 as fold, '{m}' as model, '{c}' as feature, round({f.format(c)}, 6) as v from filled15 group by 1"
            for m, f in (("mean", "abs(avg({}))"), ("spread", "stddev_pop({})")) for c in FEATURES
        ) + ")) group by model, feature) qualify row_number() over (partition by model order by s desc, feature) <= 10",
    "group_kfold_balanced": """select count(distinct record) as n_groups, count(distinct record) as n_names, count(*) as n,
        cast(count(*) filter (where label = 1) as bigint) as n_pos, least(7, count(distinct record)) as n_folds, true as not_above from scored""",
    "group_kfold": """select fold, count(*) as n_groups, sum(n)::bigint as n, sum(n_pos)::bigint as n_pos from (
        select *, case when turn < 7 then turn else 13 - turn end as fold from (select *, (row_number() over (
          order by n_pos desc, n desc, grp) - 1) % 14 as turn from (
            select grp, count(*) as n, count(*) filter (where label = 1) as n_pos from scored group by grp)))
        group by fold""",
    "mean_impute": "select record, time, " + ", ".join(
        f"round(coalesce({c}, avg({c}) over ()), 6) as {c}" for c in ("HR_mean", "DeltaHR", "BR_std", "Cad_mean")
    ) + " from feat15",
    "zscore": "select record, time, " + ", ".join(
        f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in ("HR_mean", "DeltaHR", "BR_std", "Cad_mean")
    ) + " from feat15",
    "elapsed_by_position": "select grp, record, time, idx, idx * 5 as elapsed_s from feat15",
    "firing_power": "select fold::bigint as fold, grp, record, time, idx, label::bigint as label, score, pred::bigint as pred from fired",
    "threshold_sweep": "select fold::bigint as fold, width::bigint as width, threshold, tp, fp, fn, tn from sweep_fold",
    "event_runs": "select fold::bigint as fold, grp, record, i0, i1, n, start_s, end_s, kind from runs",
    "rising_edges": """select record, idx, cast(case when label = 1 and coalesce(lag(label) over (partition by grp, record
        order by idx), 0) = 0 then 1 else 0 end as bigint) as edge from scored""",
    "event_overlap": "select fold::bigint as fold, record, p_start, p_end, t_start, t_end from pairs",
    "event_best_match": "select fold::bigint as fold, record, p_start, p_end, t_start, t_end, overlap_s from best",
    "false_positives": "select fold::bigint as fold, record, start_s, end_s, duration_s from fp",
    "false_negatives": "select fold::bigint as fold, record, start_s, end_s, duration_s from fn",
    "nearest_onset": """select fold::bigint as fold, record, start_s, case when abs(onset - start_s) <= 30 then onset::bigint end as onset,
        case when abs(onset - start_s) <= 30 then gen_offset::bigint end as gen_offset from near""",
    "first_hit": "select fold::bigint as fold, record, start_s, hit from hits",
    "true_events": "select fold::bigint as fold, record, start_s, end_s, detected::bigint as detected, det_latency_s, gen_latency_s, duration_s from gt",
    "true_positives": "select fold::bigint as fold, record, start_s, end_s, det_latency_s, gen_latency_s, duration_s from tp",
    "fold_counts": """select fold::bigint as fold, cast(sum(a) as bigint) as tp, cast(sum(b) as bigint) as fp, cast(sum(c) as bigint) as fn,
        cast(sum(d) as bigint) as detected from (select fold, 1 as a, 0 as b, 0 as c, 0 as d from tp union all
        select fold, 0, 1, 0, 0 from fp union all select fold, 0, 0, 1, 0 from fn union all
        select fold, 0, 0, 0, detected from gt) group by fold""",
    "latency_report": f"select fold::bigint as fold, n_detected, {r6('detection_latency', 'gen_latency')} from latrep",
    "generalization_latency": "select fold::bigint as fold, record, start_s, gen_latency_s from lat where gen_latency_s is not null",
    "epoch_metrics": f"select fold::bigint as fold, tp, fp, fn, tn, {r6('recall_epoch', 'precision_epoch', 'f1_epoch')} from epoch",
    "event_metrics": f"select fold::bigint as fold, n_truth, tp, fp, n, {r6('sensitivity', 'precision', 'f1', 'far_24h')} from evf",
    "hit_rates": """select fold::bigint as fold, round(avg(pred) filter (where label = 1) * 100, 6) as pct_pos,
        round(avg(pred) filter (where label = 0) * 100, 6) as pct_neg from fired group by fold""",
    "proba_stats": """select fold::bigint as fold, label::bigint as label, count(*) as n, round(min(score), 6) as score_min,
        round(avg(score), 6) as score_mean, round(max(score), 6) as score_max from scored group by fold, label""",
    "roc_auc": """select p.fold::bigint as fold, any_value(n_pos) as n_pos, any_value(n_neg) as n_neg,
        round(sum(case when p.score > q.score then 1.0 when p.score = q.score then 0.5 else 0.0 end)::double
          / (any_value(n_pos)::double * any_value(n_neg)), 6) as roc_auc
        from scored p join scored q on q.fold = p.fold and p.label = 1 and q.label = 0
        join (select fold, count(*) filter (where label = 1) as n_pos, count(*) filter (where label = 0) as n_neg
          from scored group by fold) c on c.fold = p.fold group by p.fold""",
    "fold_report": f"select model, fold::bigint as fold, {r6(*REPORT)} from rep",
    "fold_mean": "select model, " + ", ".join(f'round(avg("{c}"), 6) as "{c}"' for c in MEANS) + " from rep group by model",
    "split_summary": """select k.fold::bigint as fold, k.tag, m.groups, m.n as n_rows, m.events, m.pos as positives,
        round(m.pos / m.n, 6) as pos_share, round(m.dur + d.step, 6) as duration_s
        from (select f.fold, t.tag from (select distinct fold from scored) f, (values ('TEST'), ('TRAIN')) t(tag)) k
        join (select x.fold, x.tag, count(distinct grp) as groups, cast(sum(n) as bigint) as n, cast(sum(ev) as bigint) as events,
            cast(sum(pos) as bigint) as pos, sum(dur) as dur from (
            select f.fold, case when f.fold = s.fold then 'TEST' else 'TRAIN' end as tag, s.* exclude (fold)
            from (select distinct fold from scored) f, (select fold, grp, record, count(*) as n, sum(label) as pos,
              sum(edge) as ev, max(time) - min(time) as dur from (select *, case when label = 1 and coalesce(lag(label)
                over (partition by grp, record order by idx), 0) = 0 then 1 else 0 end as edge from scored)
              group by fold, grp, record) s) x group by x.fold, x.tag) m on m.fold = k.fold and m.tag = k.tag
        join (select f.fold, case when f.fold = s.fold then 'TEST' else 'TRAIN' end as tag, median(step) as step
            from (select distinct fold from scored) f, (select fold, time - lag(time) over (partition by grp, record
              order by idx) as step from scored) s where step is not null group by all) d on d.fold = k.fold and d.tag = k.tag""",
    "class_weight": """select fold::bigint as fold, n, p as n_pos, round((n - p) / p, 6) as ratio, round(10 * (n - p) / p, 6) as scale_pos,
        round(n / (2 * p), 6) as balanced_pos, round(n / (2 * (n - p)), 6) as balanced_neg from (
        select fold, count(*) as n, count(*) filter (where label = 1) as p from scored group by fold)""",
    "group_class_counts": "select grp, count(*) as n, count(*) filter (where label = 1) as n_pos from scored group by grp",
    "fold_invariants": """select count(distinct grp) as n_groups, count(*) as n_rows, 0::bigint as split_groups,
        0::bigint as bad_rows from scored""",
    "param_recap": """select width::bigint as width, threshold, round(avg(f1), 6) as f1_mean, round(stddev_pop(f1), 6) as f1_std,
        count(*) as n from sweep_fold group by width, threshold order by avg(f1) desc, width, threshold limit 10""",
    "param_top5": """select fold::bigint as fold, width::bigint as width, threshold, round(f1_mean, 6) as f1_mean,
        round(recall_mean, 6) as recall_mean, rk as rank from (select *, row_number() over (partition by fold
          order by f1_mean desc, width, threshold) as rk from (select fold, width, threshold, avg(f1) as f1_mean,
          avg(recall) as recall_mean from sweep_grp group by fold, width, threshold)) where rk <= 5""",
}
_FACTS = """count(distinct grp) as n_groups, count(*) as n_rows, count(distinct (grp, record, idx)) as n_keys,
  cast(sum(label) as bigint) as n_pos, count(*) as n_scored"""
for _m in ("gbt", "lr", "svm"):
    SQL[f"{_m}_held_out"] = f"select fold::bigint as fold, {_FACTS} from scored group by fold"
SQL["nested_cv_held_out"] = f"select deal::bigint as fold, {_FACTS}, 12::bigint as n_tried from scored join dealt using (grp) group by deal"
SQL["pruned_dataset"] = f"select grp, record, time, {r6(*FEATURES)}, label::bigint as label, fold, {r6(*CONTEXT)} from (select *, (cast(substr(grp, 2) as int) % 3)::bigint as fold from data)"


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
