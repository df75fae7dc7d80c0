"""DuckDB counterparts of the derived tables, as named common table expressions.

``with_ctes`` prefixes a final SELECT with exactly the expressions it needs. The SQL is
written independently of the operators: dense grids, plain windows and full sums.
"""

from __future__ import annotations

import re

from tocsin.sources.episode_files import LONGITUDINAL

CTES: dict[str, str] = {}
INF = "'infinity'::double"
ALPHAS = "(values (0.05::double),(0.10::double),(0.20::double)) al(alpha)"


def cuts_sql(hmax: int) -> str:
    cuts = [6, *[c for c in (12, 24, 48, 72) if c < hmax], hmax]
    return "(values " + ",".join(f"({i},{lo},{hi})" for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))) + ") b(bin,lo,hi)"


CUTS = cuts_sql(80)
BIN = "(case when t<=12 then 0 when t<=24 then 1 when t<=48 then 2 when t<=72 then 3 else 4 end)"


def define(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(final: str) -> str:
    """WITH clause of the CTEs that ``final`` names, in order of definition."""
    need: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql)):
            if word in CTES and word not in need:
                need.add(word)
                visit(CTES[word])

    visit(final)
    parts = [f"{name} as materialized ({sql})" for name, sql in CTES.items() if name in need]
    body = final.strip()
    for head in ("with recursive ", "with "):
        if body.startswith(head):
            return head + ",\n".join([*parts, body[len(head):]])
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def split_ctes(prefix: str, source: str, stream: str, parts: list[tuple[str, float]], extra: str = "") -> str:
    """Hashed largest-remainder split: defines <prefix>_alloc and <prefix>_split.
    ``stream`` is an SQL text expression, ``extra`` a further key column."""
    keys = f"{extra}, site, event" if extra else "site, event"
    vals = ",".join(f"('{n}',{i},{s}::double)" for i, (n, s) in enumerate(parts))
    define(f"{prefix}_rank", f"""select *, row_number() over (partition by {keys} order by md5('42|'||{stream}||'|'||episode_id), episode_id) as rnk,
      count(*) over (partition by {keys}) as n from {source}""")
    define(f"{prefix}_alloc", f"""select {keys}, part, pos, n, sz, sum(sz) over (partition by {keys} order by pos) as upto from (
      select *, base + case when row_number() over (partition by {keys} order by frac desc, pos) <= n - sum(base) over (partition by {keys}) then 1 else 0 end as sz
      from (select k.*, part, pos, floor(share*n)::bigint as base, share*n - floor(share*n) as frac
            from (select distinct {keys}, n from {prefix}_rank) k cross join (values {vals}) v(part,pos,share)))""")
    on = " and ".join(f"r.{k.strip()}=a.{k.strip()}" for k in keys.split(","))
    cols = f"r.{extra}, " if extra else ""
    define(f"{prefix}_split", f"""select {cols}r.episode_id, r.site, r.event, r.onset, r.horizon, a.part as split
      from {prefix}_rank r join {prefix}_alloc a on {on} and r.rnk <= a.upto and r.rnk > a.upto - a.sz""")
    return f"{prefix}_split"


def weighted_quantile_sql(rows: str, key: str, x: str, prob: str) -> str:
    """Smallest x with cumulative w >= prob * total per key, from rows(key, x, w)."""
    return f"""select {key}, min({x}) as q from (
      select {key}, {x}, sum(w) over (partition by {key} order by {x}) as cum, sum(w) over (partition by {key}) as tot
      from (select {key}, {x}, sum(w) as w from {rows} group by {key}, {x}))
      where cum >= ({prob} - 1e-12) * tot group by {key}"""


def template_ctes(prefix: str, traj: str, episodes: str, key: str, keep: str, hmax: int = 80) -> None:
    """Time template per ``key`` value: defines <prefix>_tpl(key, bin, lo, hi, loc, scale, n_episodes).

    Eligible hours form one run from hour 6, so bin counts never rise and the merge rule
    keeps the bins with at least 50 episodes and folds the rest into the last of them.
    """
    define(f"{prefix}_bins", f"""select k.{key}, b.bin, b.lo, b.hi,
        (select count(*) from {episodes} e where {keep} and e.{key}=k.{key}
           and least(e.horizon, {hmax}, case when e.onset < {INF} then ceil(e.onset)-1 else {hmax} end) >= case when b.bin=0 then 6 else b.lo+1 end) as n_episodes
        from (select distinct {key} from {episodes} where {keep}) k cross join {cuts_sql(hmax)}""")
    define(f"{prefix}_last", f"select {key}, coalesce(max(bin) filter (where n_episodes >= 50), 0) as lastbin from {prefix}_bins group by {key}")
    define(f"{prefix}_rows", f"""select {key}, bin, x, 1.0::double / count(*) over (partition by {key}, episode_id, bin) as w from (
        select s.{key}, s.episode_id, least({BIN}, l.lastbin) as bin, s.score as x
        from {traj} s join {prefix}_last l on s.{key}=l.{key} where s.eligible and s.t <= {hmax} and {keep.replace('e.', 's.')})""")
    define(f"{prefix}_loc", weighted_quantile_sql(f"{prefix}_rows", f"{key}, bin", "x", "0.5"))
    define(f"{prefix}_dev", f"select r.{key}, r.bin, abs(r.x - l.q) as x, r.w from {prefix}_rows r join {prefix}_loc l on r.{key}=l.{key} and r.bin=l.bin")
    define(f"{prefix}_mad", weighted_quantile_sql(f"{prefix}_dev", f"{key}, bin", "x", "0.5"))
    define(f"{prefix}_tpl", f"""select b.{key}, b.bin, b.lo, case when b.bin = l.lastbin then {hmax} else b.hi end as hi,
        coalesce(c.q, 0.0) as loc, case when c.q is null then 1.0 else greatest(1.4826*m.q, 0.10::double) end as scale, b.n_episodes
        from {prefix}_bins b join {prefix}_last l on b.{key}=l.{key} and b.bin <= l.lastbin
        left join {prefix}_loc c on b.{key}=c.{key} and b.bin=c.bin left join {prefix}_mad m on b.{key}=m.{key} and b.bin=m.bin""")


# -- orders --------------------------------------------------------------------------
define("o_months", """select o_custkey as episode_id, (year(o_orderdate)-1995)*12+month(o_orderdate) as t, o_totalprice, o_orderpriority
  from orders where (year(o_orderdate)-1995)*12+month(o_orderdate) between 1 and 80""")
define("o_ep", f"""select episode_id, case when episode_id%2=0 then 'A' else 'B' end as site, coalesce(f<=h,false) as event,
  case when f<=h then f::double else {INF} end as onset, h::int as horizon, 1 as one from (
  select episode_id, min(t) filter (where t>12 and o_orderpriority='1-URGENT' and o_totalprice>375000) as f,
    least(80, 40+(episode_id*37)%41) as h from o_months group by episode_id)""")
define("o_risk", """select episode_id, t::int as t, round(1.0::double/(1.0+exp(-(max(o_totalprice)-250000.0)/80000.0)),9) as risk
  from o_months group by episode_id, t""")
split_ctes("o", "o_ep", "'split'", [("validation", 0.3), ("calibration", 0.4), ("test", 0.3)])
define("o_dense", "select e.episode_id, g.t::int as t from o_ep e cross join range(1,81) g(t)")
define("o_sm", """select d.episode_id, d.t, r.risk, avg(r.risk) over (partition by d.episode_id order by d.t rows between 2 preceding and current row) as smooth
  from o_dense d left join o_risk r on d.episode_id=r.episode_id and d.t=r.t""")
define("o_sc", """select episode_id, t, risk, smooth, case when smooth is not null then
  round(ln(least(greatest(smooth,1e-6),1-1e-6)) - ln(1-least(greatest(smooth,1e-6),1-1e-6)),9) end as score from o_sm""")
define("o_pv", """select *, case when t>6 then lag(risk) over (partition by episode_id order by t) end as prev_risk,
  case when t>6 then lag(score) over (partition by episode_id order by t) end as prev_score from o_sc""")
define("o_plain", """select s.episode_id, e.site, e.event, e.onset, e.horizon, e.split, 1 as one, s.t, s.risk, s.smooth, s.score, s.prev_risk, s.prev_score,
  s.t < e.onset as eligible from o_pv s join o_split e on s.episode_id=e.episode_id where s.smooth is not null and s.t>=6 and s.t<=e.horizon""")
define("o_spone", "select *, 1 as one from o_split")
template_ctes("op", "o_plain", "o_spone", "one", "split='validation' and not event")
template_ctes("os", "o_plain", "o_spone", "site", "split='validation' and not event")


define("o_traj", """select s.*, round((s.score-p.loc)/p.scale,9) as z, round((s.prev_score-q.loc)/q.scale,9) as prev_z
  from o_plain s join op_tpl p on (s.t > p.lo or p.bin=0) and s.t <= p.hi join op_tpl q on (s.t-1 > q.lo or q.bin=0) and s.t-1 <= q.hi""")
define("o_max", f"""select e.episode_id, e.site, e.event, e.onset, e.horizon, e.split, coalesce(m.ms, -{INF}) as max_score, coalesce(m.mz, -{INF}) as max_z
  from o_split e left join (select episode_id, max(score) as ms, max(z) as mz from o_traj where eligible group by 1) m on e.episode_id=m.episode_id""")
define("o_cal", "select * from o_max where split='calibration' and not event")
define("o_m0", "select site, count(*) as m0 from o_cal group by site")
define("o_k", f"""select site, m0, alpha, ceil((m0+1)*(1.0::double-alpha))::bigint as k from o_m0 cross join {ALPHAS}""")
define("o_hck", f"""select site, m0, alpha, coalesce((select min(j) from (select j, sum(exp(lgamma(m0+1.0)-lgamma(j+1.0)-lgamma(m0-j+1.0)+j*ln(1-alpha)+(m0-j)*ln(alpha)))
   over (order by j desc) as tail from range(1, m0+1) r(j)) where tail <= 0.05), m0+1)::bigint as k from o_m0 cross join {ALPHAS}""")
define("o_ord", """select site, max_score, row_number() over (partition by site order by max_score) as rs, max_z,
  row_number() over (partition by site order by max_z) as rz from o_cal""")
define("o_calrows", """select site, episode_id, t, score, 1.0::double/count(*) over (partition by episode_id) as w from o_traj
  where split='calibration' and not event and eligible""")
define("o_pw", f"""select site, alpha, min(score) as c from (select site, score, sum(w) over (partition by site order by score) as cum,
   sum(w) over (partition by site) as tot from (select site, score, sum(w) as w from o_calrows group by site, score)) cross join {ALPHAS}
   where cum >= (1.0::double - alpha - 1e-12)*tot group by site, alpha""")
define("o_binmax", f"""select c.site, c.episode_id, b.bin, coalesce(max(r.score), -{INF}) as peak from o_cal c cross join {CUTS}
   left join (select *, {BIN} as bin from o_calrows) r on r.episode_id=c.episode_id and r.bin=b.bin group by 1,2,3""")
define("o_binord", "select site, bin, peak, row_number() over (partition by site, bin order by peak) as r from o_binmax")
define("o_bink", f"""select site, m0, alpha, bin, lo, hi, ceil((m0+1)*(1.0::double-alpha/5.0))::bigint as k from o_m0 cross join {ALPHAS} cross join {CUTS}""")
define("o_binc", f"""select k.site, k.m0, k.alpha, k.bin, k.lo, k.hi, k.k, case when k.k > k.m0 then {INF} else o.peak end as c
   from o_bink k left join o_binord o on o.site=k.site and o.bin=k.bin and o.r=k.k""")
define("o_flatval", """select episode_id, risk as value, case when event and onset-t>0 and onset-t<=6 then 1 else 0 end as label from o_plain
   where split='validation' and eligible and risk is not null""")
define("o_yw", "select value, sum(w*label) as pos, sum(w*(1-label)) as neg from (select *, 1.0::double/count(*) over (partition by episode_id) as w from o_flatval) group by value")
define("o_yj", """select value, (tp-cp)/tp + cn/tn - 1 as j from (select value, sum(pos) over (order by value) as cp, sum(neg) over (order by value) as cn,
   sum(pos) over () as tp, sum(neg) over () as tn from o_yw)""")
define("o_youden", f"""select case when greatest(max(j),0) <= 1e-12 then {INF} else max(value) filter (where j >= (select greatest(max(j),0) from o_yj) - 1e-12) end as threshold from o_yj""")
define("o_naive", """select k.site, k.alpha, a.max_score + (b.max_score-a.max_score)*((m0-1)*(1.0::double-alpha) - floor((m0-1)*(1.0::double-alpha))) as c
   from o_k k join o_ord a on a.site=k.site and a.rs = floor((m0-1)*(1.0::double-alpha))+1
   join o_ord b on b.site=k.site and b.rs = least(m0, floor((m0-1)*(1.0::double-alpha))+2)""")
define("o_thr", f"""
   select site, 'fixed_max' as method, alpha, 'score' as scale, [case when k>m0 then {INF} else (select max_score from o_ord o where o.site=k.site and o.rs=k.k) end] as threshold, m0, k, (m0+1-k)::double/(m0+1) as alpha_m0 from o_k k
   union all select site, 'time_adaptive', alpha, 'z', [case when k>m0 then {INF} else (select max_z from o_ord o where o.site=k.site and o.rz=k.k) end], m0, k, (m0+1-k)::double/(m0+1) from o_k k
   union all select site, 'high_confidence', alpha, 'score', [case when k>m0 then {INF} else (select max_score from o_ord o where o.site=k.site and o.rs=k.k) end], m0, k, null from o_hck k
   union all select k.site, 'naive_max', k.alpha, 'score', [n.c], m0, null, null from o_k k join o_naive n on n.site=k.site and n.alpha=k.alpha
   union all select k.site, 'pointwise', k.alpha, 'score', [coalesce(p.c, {INF})], m0, null, null from o_k k left join o_pw p on p.site=k.site and p.alpha=k.alpha
   union all select site, 'binwise_bonferroni', alpha, 'score', list_transform(range(1,81), lambda h: (array_agg(c order by bin))[case when h<=12 then 1 when h<=24 then 2 when h<=48 then 3 when h<=72 then 4 else 5 end]), m0, null, null from o_binc group by site, alpha, m0
   union all select site, 'fixed_half', alpha, 'risk', [0.5::double], m0, null, null from o_k
   union all select site, 'youden', alpha, 'risk', [(select threshold from o_youden)], m0, null, null from o_k""")


def outcome_ctes(prefix: str, traj: str, episodes: str, thr: str, labels: str, match: str = "s.site=h.site", hmax: str = "80") -> None:
    """Outcome table: defines <prefix>_hit, <prefix>_al and <prefix>_out. ``labels`` are
    the columns that identify a threshold row besides site; they are shared by traj
    joins through ``match``."""
    lab_h = ", ".join(f"h.{x.strip()}" for x in labels.split(","))
    on = " and ".join(f"a.{x.strip()} is not distinct from h.{x.strip()}" for x in labels.split(","))
    define(f"{prefix}_hit", f"""select *, case when septic then (case when d<=-6 then greatest((d+12)/6.0::double,-0.05::double) when d<=3 then (3-d)/9.0::double else 0 end)
         - (case when d>-6 and d<=3 then -2.0::double*(d+6)/9.0 else 0 end) else -0.05::double end as g from (
      select s.episode_id, s.t, s.eligible, {lab_h}, s.event and greatest(1, ceil(s.onset-6)) <= least(s.horizon,{hmax}) as septic,
        s.t - (greatest(1, ceil(s.onset-6))+6) as d,
        s.eligible and not coalesce((case h.scale when 'risk' then s.prev_risk when 'score' then s.prev_score else s.prev_z end)
           > (case when len(h.threshold)=1 then h.threshold[1] else h.threshold[s.t-1] end), false) as start
      from {traj} s join {thr} h on {match}
      where (case h.scale when 'risk' then s.risk when 'score' then s.score else s.z end) > (case when len(h.threshold)=1 then h.threshold[1] else h.threshold[s.t] end))""")
    define(f"{prefix}_al", f"""select episode_id, {labels}, min(t) filter (where eligible) as tau, sum(g) as gain,
      list_sort(list(t) filter (where start)) as starts from {prefix}_hit group by episode_id, {labels}""")
    define(f"{prefix}_out", f"""select *, coalesce(tau < {INF},false) as alerted, eval0 and coalesce(onset-tau between 0 and 6,false) as valid0,
        eval3 and coalesce(onset-tau between 3 and 6,false) as valid3, eval0 and tau < onset-6 as premature, xh/24.0::double as exposure_days, xh as exposure_hours,
        ui+coalesce(gain,0) as uo from (
      select e.episode_id, e.site, e.event, e.onset, e.horizon, {lab_h}, coalesce(a.tau::double, {INF}) as tau, a.gain,
        coalesce((list_reduce(list_prepend(a.starts[1]*1000+1, a.starts[2:]), lambda p, x: case when x-(p//1000)>=6 then x*1000+(p%1000)+1 else p end))%1000, 0) as n_ep,
        greatest(0, least(e.horizon, {hmax}, case when e.onset<{INF} then ceil(e.onset)-1 else {hmax} end)-5)::bigint as xh,
        e.event and greatest(6, ceil(e.onset-6)) <= least(e.horizon, {hmax}, ceil(e.onset)-1, floor(e.onset)) as eval0,
        e.event and greatest(6, ceil(e.onset-6)) <= least(e.horizon, {hmax}, ceil(e.onset)-1, floor(e.onset-3)) as eval3,
        case when e.event and greatest(1, ceil(e.onset-6)) <= least(e.horizon,{hmax}) then
          (select coalesce(sum(case when x-S>-6 and x-S<=3 then -2.0::double*(x-S+6)/9.0 else 0 end),0) from (select greatest(1,ceil(e.onset-6))+6 as S), range(1,81) r(x) where x<=least(e.horizon,{hmax})) else 0 end as ui,
        case when e.event and greatest(1, ceil(e.onset-6)) <= least(e.horizon,{hmax}) then
          (select coalesce(sum(case when x-S<-12 or x-S>3 then 0 when x-S<=-6 then greatest((x-S+12)/6.0::double,-0.05::double) else (3-(x-S))/9.0::double end),0) from (select greatest(1,ceil(e.onset-6))+6 as S), range(1,81) r(x) where x<=least(e.horizon,{hmax})) else 0 end as ub
      from {episodes} e join {thr} h on {match.replace('s.', 'e.')} left join {prefix}_al a on a.episode_id=e.episode_id and {on})""")


define("o_test", "select * from o_traj where split='test'")
define("o_teste", "select * from o_split where split='test'")
outcome_ctes("o", "o_test", "o_teste", "o_thr", "method, alpha")

METRICS_SQL = """round(count(*) filter (where not event and alerted)::double/nullif(count(*) filter (where not event),0),6) as pfa,
  round(count(*) filter (where valid3)::double/nullif(count(*) filter (where eval3),0),6) as sens3,
  round(count(*) filter (where valid0)::double/nullif(count(*) filter (where eval0),0),6) as sens0,
  round(count(*) filter (where valid3)::double/nullif(count(*) filter (where alerted),0),6) as ppv3,
  round(100.0::double*sum(n_ep)/nullif(sum(exposure_days),0),6) as alerts_per_100d,
  round((sum(uo)-sum(ui))/nullif(sum(ub)-sum(ui),0),6) as utility"""

# -- events --------------------------------------------------------------------------
TYPES = ("click", "purchase", "error", "signup", "view")
define("e_hours", """select user_id as episode_id, floor(date_diff('second', timestamp '2024-01-01 00:00:00', ts)/21600.0)::int+1 as t, event_id, event_type, value
  from events where floor(date_diff('second', timestamp '2024-01-01 00:00:00', ts)/21600.0)::int+1 between 1 and 120""")
define("e_meas", "select episode_id, t, case when episode_id%2=0 then 'A' else 'B' end as site, " + ", ".join(
    f"max_by(value, event_id) filter (where event_type='{e}') as v_{e}" for e in TYPES)
    + ", round(1.0::double/(1.0+exp(-(avg(value)-60.0)/30.0)),9) as risk from e_hours group by episode_id, t")
define("e_first", "select episode_id, max(t) as mx, min(t) filter (where event_type='error' and value>150 and t>12) as f from e_hours group by 1")
define("e_ep", f"""select episode_id, case when episode_id%2=0 then 'A' else 'B' end as site, coalesce(f<=h,false) as event,
  case when f<=h then f::double else {INF} end as onset, h::int as horizon, (40+episode_id%50)::double as age
  from (select *, least(mx, 48+(episode_id*37)%73) as h from e_first)""")
split_ctes("e", "e_ep", "'split'", [("train", 0.5), ("validation", 0.25), ("test", 0.25)])
define("e_grid", """select e.*, g.t::int as t, m.* exclude (episode_id, t, site) from e_ep e join range(1,121) g(t) on g.t <= least(e.horizon,120)
  left join e_meas m on m.episode_id=e.episode_id and m.t=g.t""")
define("e_wide", "select episode_id, t, " + ", ".join(f"max_by(value, event_id) filter (where kind={i}) as {v}" for i, v in enumerate(LONGITUDINAL))
       + f" from (select *, (list_position({list(TYPES)}, event_type)-1)*7 + event_id%7 as kind from e_hours) group by episode_id, t")
define("e_rec", f"""select m.site, m.episode_id, row_number() over (partition by m.episode_id order by case when m.episode_id%61=7 then -m.t else m.t end)-1 as row_no,
  v_click as HR, v_purchase as O2Sat, v_error as Temp, v_signup as SBP, v_view as MAP, {', '.join('w.' + v for v in LONGITUDINAL[5:])},
  (40+m.episode_id%50 + case when m.episode_id%53=5 and m.t%2=0 then 1 else 0 end)::double as Age, (m.episode_id%2)::double as Gender,
  case when m.episode_id%3=0 then 1.0::double when m.episode_id%3=1 then 0.0 end as Unit1, case when m.episode_id%3=1 then 1.0::double when m.episode_id%3=0 then 0.0 end as Unit2,
  (-(m.episode_id%40))::double as HospAdmTime,
  case when m.episode_id%67=9 and m.t%13=0 then m.t+0.5::double when m.episode_id%71=4 and m.t%11=0 then m.t-1.0::double else m.t::double end as t,
  case when m.episode_id%47=3 and m.t%17=0 then 2.0::double when m.episode_id%43=11 and m.t%19=0 then 0.0::double when m.t >= f.f-6 then 1.0::double else 0.0::double end as label
  from e_meas m join e_first f on m.episode_id=f.episode_id left join e_wide w on w.episode_id=m.episode_id and w.t=m.t where not (m.episode_id%37=2 and m.t>5)""")
define("e_step", """select *, t - lag(t) over (partition by episode_id order by row_no) as dt, label - lag(label) over (partition by episode_id order by row_no) as dl from e_rec""")
define("e_man0", f"""select site, episode_id, count(*) as n_rows, bool_and(label in (0,1)) as label_valid, min(row_no) filter (where label=1) as first_positive_row,
  min_by(t,row_no) filter (where label=1) as first_positive_hour, bool_and(t=floor(t)) as hours_integer,
  count(distinct Age)<=1 and count(distinct Gender)<=1 and count(distinct Unit1)<=1 and count(distinct Unit2)<=1 and count(distinct HospAdmTime)<=1 as baseline_consistent,
  coalesce(bool_and(dt>0),true) as strictly_increasing, coalesce(bool_or(dt<>1),false) as has_gap, coalesce(bool_and(dl>=0),true) as never_falls,
  count(distinct t)<count(*) as duplicate_hour, min_by(t,row_no) as first_hour, max_by(t,row_no) as horizon, min(t) as min_hour, max(t) as max_hour, min_by(label,row_no) as first_label,
  min(Age) as Age, min(Gender) as Gender, min(Unit1) as Unit1, min(Unit2) as Unit2, min(HospAdmTime) as HospAdmTime,
  {', '.join(f'count({v}) as {v}_nobs' for v in LONGITUDINAL)}
  from e_step group by site, episode_id""")
define("e_man1", f"""select *, first_positive_row is not null as event, label_valid and never_falls as label_monotone,
  case when first_positive_row is not null then first_positive_hour+6 else {INF} end as onset,
  first_positive_row is not null and first_label=1 as left_truncated,
  first_positive_row is null or first_positive_hour+6 <= horizon as onset_within_record from e_man0""")
define("e_man2", """select *, label_valid and label_monotone and not left_truncated and onset_within_record as onset_reconstructable from e_man1""")
define("e_man", """select *, horizon>=6 and baseline_consistent and label_valid and label_monotone and hours_integer and strictly_increasing and not duplicate_hour
    and (not event or (onset_reconstructable and onset>6)) as "primary",
  concat_ws(';', case when not baseline_consistent then 'baseline_inconsistent' end, case when not label_valid then 'invalid_label' end,
    case when not label_monotone then 'nonmonotone_label' end, case when not hours_integer then 'noninteger_hour' end,
    case when not strictly_increasing then 'hours_not_strictly_increasing' end, case when duplicate_hour then 'duplicate_hour' end,
    case when not horizon>=6 then 'below_landmark' end, case when event and left_truncated then 'left_truncated' end,
    case when event and not onset_within_record then 'onset_outside_record' end,
    case when event and not onset_reconstructable and not left_truncated and onset_within_record then 'onset_unreconstructable' end) as exclusion_reason from e_man2""")


def window_sql(variable: str, stat: str, hours: int) -> str:
    """One trailing-window statistic over the event grid (one row per hour)."""
    w = f"over (partition by episode_id order by t rows between {hours - 1} preceding and current row)"
    n = f"count({variable}) {w}"
    x = {
        "mean": f"avg({variable}) {w}", "min": f"min({variable}) {w}", "max": f"max({variable}) {w}",
        "sd": f"case when {n}>=2 then stddev_samp({variable}) {w} end",
        "change": f"case when {n}>=2 then max_by({variable}, case when {variable} is not null then t end) {w} - min_by({variable}, case when {variable} is not null then t end) {w} end",
        "slope": f"case when {n}>=2 then regr_slope({variable}, t::double) {w} end",
        "count": f"({n})::double",
    }[stat]
    # quotients may lie on the edge of a rounding, so they are rounded to 10 digits before 6
    return f"round(round({x},10),6) as {variable}_{stat}_{hours}h"


def recent_sql(variable: str) -> str:
    w = "over (partition by episode_id order by t rows between unbounded preceding and current row)"
    seen = f"max(case when {variable} is not null then t end) {w}"
    return (f"max_by({variable}, case when {variable} is not null then t end) {w} as {variable}_last, (case when {seen} is null then 1 else 0 end)::double as {variable}_never, "
            f"(t-{seen})::double as {variable}_since, (case when {variable} is not null then 1 else 0 end)::double as {variable}_current")


define("e_feat", "select episode_id, site, event, onset, horizon, t, age, t::double as hour, (case when site='B' then 1 else 0 end)::double as site_b, "
       + ", ".join(f"{recent_sql('v_' + e)}, " + ", ".join(window_sql("v_" + e, s, h) for h in (6, 12, 24)
                   for s in ("mean", "min", "max", "sd", "change", "slope", "count")) for e in TYPES)
       + ", case when onset-t>0 and onset-t<=6 then 1 else 0 end as label, t>=6 and t<onset and t<=120 as fit from e_grid")
define("e_rows", "select * from e_feat where t>=4")


def wide_ctes(variables: tuple[str, ...], baseline: tuple[str, ...]) -> list[str]:
    """All variables: defines e_wrows and returns the names of its feature columns."""
    define("e_wgrid", f"""select e.episode_id, e.site, g.t::int as t, (40+e.episode_id%50)::double as Age, (e.episode_id%2)::double as Gender,
      case when e.episode_id%3=0 then 1.0::double when e.episode_id%3=1 then 0.0 end as Unit1, case when e.episode_id%3=1 then 1.0::double when e.episode_id%3=0 then 0.0 end as Unit2,
      (-(e.episode_id%40))::double as HospAdmTime, m.* exclude (episode_id, t) from e_ep e join range(1,121) g(t) on g.t <= least(e.horizon,120) left join e_wide m on m.episode_id=e.episode_id and m.t=g.t""")
    names = [f"{v}_{s}" for v in variables for s in ("last", "never", "since", "current", *(f"{s}_{h}h" for h in (6, 12, 24) for s in ("mean", "min", "max", "sd", "change", "slope", "count")))]
    define("e_wfeat", f"select t, {', '.join(baseline)}, t::double as hour, (case when site='B' then 1 else 0 end)::double as site_b, "
           + ", ".join(f"{recent_sql(v)}, " + ", ".join(window_sql(v, s, h) for h in (6, 12, 24) for s in ("mean", "min", "max", "sd", "change", "slope", "count")) for v in variables) + " from e_wgrid")
    define("e_wrows", "select * from e_wfeat where t>=4")
    return [*baseline, "hour", "site_b", *names]


# -- bootstrap, transfer and robustness on orders ---------------------------------------
REPLICATES = 1000
PARTITIONS = 49
TARGET_SIZES = (100, 250, 500, 1000)
INTERNAL_SPLITS = 9
#: Positions of one bucket of the draws; small, so that the small tables have several.
BOOT_SLOTS = 64
_HASH = "('0x'||substr(md5({}),1,15))::bigint"
_WRAP = "18446744073709551616::uhugeint"


def draw_ctes(prefix: str, source: str, stratum: str, levels: int = 7) -> None:
    """Multinomial draws of source(episode_id, ...): defines <prefix>_bidx (positions) and
    <prefix>_mult(bootstrap, stratum, position, multiplicity). ``levels`` bound the halvings."""
    define(f"{prefix}_bidx", f"""select *, row_number() over (partition by stratum order by md5('42|boot-order|'||episode_id), episode_id) as position,
      count(*) over (partition by stratum) as n from (select *, {stratum} as stratum from {source})""")
    define(f"{prefix}_n0", f"""select b.b::int as b, stratum, n, 0::bigint as lo, ceil(n/{BOOT_SLOTS}.0)::bigint as hi, n as c
      from (select distinct stratum, n from {prefix}_bidx) cross join range(0,{REPLICATES}) b(b)""")
    for i in range(levels):
        define(f"{prefix}_h{i}", f"""select b, stratum, lo, min_by(k, rk) as taken from (
          select *, sum(exp(lgamma(c+1.0)-lgamma(k+1.0)-lgamma(c-k+1.0)+k*ln(p)+(c-k)*ln(1-p))) over (partition by b, stratum, lo order by rk) as cum from (
            select *, 2*abs(k-mode) - case when k>mode then 1 else 0 end as rk from (
              select *, unnest(range(greatest(0, mode-w), least(c, mode+w)+1)) as k from (
                select *, floor((c+1)*p)::bigint as mode, ceil(10*sqrt(c*p*(1-p)))::bigint+20 as w, {_HASH.format("'42|split|'||b||'|'||stratum||'|'||lo||'|'||hi")}::double/1152921504606846976.0::double as u from (
                  select *, (least(((lo+hi)//2)*{BOOT_SLOTS}, n) - lo*{BOOT_SLOTS})::double/(least(hi*{BOOT_SLOTS}, n) - lo*{BOOT_SLOTS}) as p from {prefix}_n{i} where hi-lo>1)))))
          where cum > u group by b, stratum, lo""")
        define(f"{prefix}_n{i + 1}", f"""select * from {prefix}_n{i} where hi-lo=1
          union all select n.b, n.stratum, n.n, n.lo, (n.lo+n.hi)//2, h.taken from {prefix}_n{i} n join {prefix}_h{i} h using (b, stratum, lo) where n.hi-n.lo>1
          union all select n.b, n.stratum, n.n, (n.lo+n.hi)//2, n.hi, n.c-h.taken from {prefix}_n{i} n join {prefix}_h{i} h using (b, stratum, lo) where n.hi-n.lo>1""")
    define(f"{prefix}_ball", f"""select b, stratum, lo, least((lo+1)*{BOOT_SLOTS}, n) - lo*{BOOT_SLOTS} as size,
      (({_HASH.format("'42|boot|'||b||'|'||stratum||'|'||lo")}::uhugeint + unnest(range(1, c+1))::uhugeint * 11400714819323198485::uhugeint) % {_WRAP})::ubigint as x from {prefix}_n{levels}""")
    define(f"{prefix}_mix1", f"select b, stratum, lo, size, ((xor(x, x >> 30)::uhugeint * 13787848793156543929::uhugeint) % {_WRAP})::ubigint as x from {prefix}_ball")
    define(f"{prefix}_mix2", f"select b, stratum, lo, size, ((xor(x, x >> 27)::uhugeint * 10723151780598845931::uhugeint) % {_WRAP})::ubigint as x from {prefix}_mix1")
    define(f"{prefix}_mult", f"select b as bootstrap, stratum, lo*{BOOT_SLOTS} + (xor(x, x >> 31) % size::ubigint)::bigint + 1 as position, count(*) as multiplicity from {prefix}_mix2 group by all")


def weighted(sql: str, w: str = "w") -> str:
    """METRICS_SQL over rows that count ``w`` times."""
    sql = re.sub(r"count\(\*\) filter \(where ([^)]*)\)", rf"coalesce(sum({w}) filter (where \1), 0)", sql)
    return re.sub(r"sum\((n_ep|exposure_days|uo|ui|ub)\)", rf"sum({w}*\1)", sql)


draw_ctes("o", "o_teste", "site||'|'||event::varchar")
define("o_drawn", "select m.bootstrap, m.multiplicity as w, o.* from o_mult m join (select episode_id, stratum, position from o_bidx) i on m.stratum=i.stratum and m.position=i.position join o_out o on o.episode_id=i.episode_id")
RAW_METRICS = METRICS_SQL.replace(",6)", ",15)")
define("o_bsraw", f"select bootstrap, method, alpha, {weighted(RAW_METRICS)} from o_drawn group by all")
# sums of ninths may lie on the edge of a rounding, so they are rounded to 10 digits before 6
define("o_bs", "select bootstrap, method, alpha, " + ", ".join(f"round(round({x},10),6) as {x}" for x in ("pfa", "sens3", "sens0", "ppv3", "alerts_per_100d", "utility")) + " from o_bsraw")
define("o_bslong", "select * from o_bsraw unpivot include nulls (value for metric in (pfa, sens3, sens0, ppv3, alerts_per_100d, utility))")
define("o_res", f"select method, alpha, {RAW_METRICS} from o_out group by method, alpha")
define("o_reslong", "select * from o_res unpivot include nulls (value for metric in (pfa, sens3, sens0, ppv3, alerts_per_100d, utility))")
define("o_quiet", "select * from o_teste where not event")
draw_ctes("c", "o_quiet", "site")

define("k_ep", f"select p.p::int as partition, e.* from o_ep e cross join range(0,{PARTITIONS}) p(p)")
split_ctes("k", "k_ep", "'target|'||partition", [("test", 0.5), ("reservoir", 0.5)], extra="partition")
define("k_pos", """select partition, site, episode_id, row_number() over (partition by site, partition order by md5('42|reservoir|'||partition||'|'||episode_id), episode_id) as pos,
  count(*) over (partition by site, partition) as avail from k_split where split='reservoir' and not event""")
define("k_sizes", "select unnest([" + ",".join(map(str, TARGET_SIZES)) + "]) as m")
define("k_pre", "select p.*, s.m as target_m0 from k_pos p join k_sizes s on pos<=s.m and avail>=s.m")
define("k_short", """select distinct site, partition, s.m as target_m0, v.method, avail as m0 from k_pos join k_sizes s on avail<s.m
  cross join (values ('local_fixed_max'),('local_time_adaptive'),('local_high_confidence')) v(method)""")
define("k_traj", """select s.*, round((s.score-p.loc)/p.scale,9) as z, round((s.prev_score-q.loc)/q.scale,9) as prev_z
  from o_plain s join os_tpl p on p.site<>s.site and (s.t > p.lo or p.bin=0) and s.t <= p.hi join os_tpl q on q.site<>s.site and (s.t-1 > q.lo or q.bin=0) and s.t-1 <= q.hi""")
define("k_max", f"""select e.episode_id, coalesce(max(t.score) filter (where t.eligible),-{INF}) as max_score, coalesce(max(t.z) filter (where t.eligible),-{INF}) as max_z
  from o_ep e left join k_traj t on t.episode_id=e.episode_id group by 1""")
define("k_ord", """select p.site, p.partition, p.target_m0, m.max_score, m.max_z, row_number() over (partition by p.site,p.partition,p.target_m0 order by max_score) as rs,
  row_number() over (partition by p.site,p.partition,p.target_m0 order by max_z) as rz, count(*) over (partition by p.site,p.partition,p.target_m0) as m0 from k_pre p join k_max m on p.episode_id=m.episode_id""")
define("k_m0", "select distinct site, partition, target_m0, m0 from k_ord")
define("k_hck", """select distinct m0, coalesce((select min(j) from (select j, sum(exp(lgamma(m0+1.0)-lgamma(j+1.0)-lgamma(m0-j+1.0)+j*ln(0.9)+(m0-j)*ln(0.1))) over (order by j desc) as tail
   from range(1, m0+1) r(j)) where tail <= 0.05), m0+1)::bigint as k from k_m0""")
define("k_thr", f"""select h.site, p.partition, 0 as target_m0, 'direct_transfer' as method, 0.10::double as alpha, 'score' as scale, s.threshold, s.m0, s.k, s.alpha_m0
   from (select distinct site from o_ep) h cross join (select distinct partition from k_ep) p join o_thr s on s.site<>h.site and s.method='fixed_max' and s.alpha=0.10::double
   union all select m.site, m.partition, m.target_m0, 'local_fixed_max', 0.10::double, 'score', [coalesce(o.max_score,{INF})], m.m0, ceil((m.m0+1)*(1.0::double-0.10::double))::bigint, (m.m0+1-ceil((m.m0+1)*(1.0::double-0.10::double)))::double/(m.m0+1)
     from k_m0 m left join k_ord o on o.site=m.site and o.partition=m.partition and o.target_m0=m.target_m0 and o.rs=ceil((m.m0+1)*(1.0::double-0.10::double))
   union all select m.site, m.partition, m.target_m0, 'local_time_adaptive', 0.10::double, 'z', [coalesce(o.max_z,{INF})], m.m0, ceil((m.m0+1)*(1.0::double-0.10::double))::bigint, (m.m0+1-ceil((m.m0+1)*(1.0::double-0.10::double)))::double/(m.m0+1)
     from k_m0 m left join k_ord o on o.site=m.site and o.partition=m.partition and o.target_m0=m.target_m0 and o.rz=ceil((m.m0+1)*(1.0::double-0.10::double))
   union all select m.site, m.partition, m.target_m0, 'local_high_confidence', 0.10::double, 'score', [coalesce(o.max_score,{INF})], m.m0, c.k, null
     from k_m0 m join k_hck c on c.m0=m.m0 left join k_ord o on o.site=m.site and o.partition=m.partition and o.target_m0=m.target_m0 and o.rs=c.k""")
define("k_test", "select t.*, s.partition from k_traj t join k_split s on s.episode_id=t.episode_id and s.split='test'")
define("k_teste", "select * from k_split where split='test'")
outcome_ctes("k", "k_test", "k_teste", "k_thr", "partition, target_m0, method, alpha", "s.site=h.site and s.partition=h.partition")
define("k_res", f"""select case when site='A' then 'B_to_A' else 'A_to_B' end as direction, site, partition, target_m0, method, alpha, {RAW_METRICS},
  count(*) filter (where alerted and not event) as alerts, count(*) filter (where not event) as n_non_events, count(*) filter (where alerted) as n_alerted,
  count(*) filter (where valid3) as n_valid3, count(*) filter (where eval3) as n_sens3 from k_out group by all""")

define("k_teste0", "select * from k_teste where partition=0")
draw_ctes("t", "k_teste0", "site||'|'||event::varchar")
define("t_drawn", """select m.bootstrap, m.multiplicity as w, o.* from t_mult m join (select episode_id, stratum, position from t_bidx) i on m.stratum=i.stratum and m.position=i.position
  join k_out o on o.episode_id=i.episode_id and o.partition=0""")
define("t_raw", f"select bootstrap, site, method, target_m0, {weighted(RAW_METRICS)} from t_drawn group by all")
define("t_long", "select * from t_raw unpivot include nulls (value for metric in (pfa, sens3, sens0, ppv3, alerts_per_100d, utility))")
define("t_res", f"select site, method, target_m0, {RAW_METRICS} from k_out where partition=0 group by all")
define("t_reslong", "select * from t_res unpivot include nulls (value for metric in (pfa, sens3, sens0, ppv3, alerts_per_100d, utility))")

define("i_ep", f"select p.p::int as split_no, e.* from o_ep e cross join range(1,{INTERNAL_SPLITS + 1}) p(p)")
split_ctes("i", "i_ep", "'internal|'||split_no", [("validation", 0.3), ("calibration", 0.4), ("test", 0.3)], extra="split_no")
define("i_ord", """select s.split_no, s.site, m.max_score, row_number() over (partition by s.split_no, s.site order by max_score) as rs, row_number() over (partition by s.split_no order by max_score) as rp,
  count(*) over (partition by s.split_no, s.site) as m0, count(*) over (partition by s.split_no) as mp from i_split s join o_max m on m.episode_id=s.episode_id where s.split='calibration' and not s.event""")
define("i_thr", """select distinct split_no, site, 'fixed_max' as method, 0.10::double as alpha, 'score' as scale, [max_score] as threshold from i_ord where rs=ceil((m0+1)*(1.0::double-0.10::double))
  union all select i.split_no, s.site, 'pooled', 0.10::double, 'score', [i.max_score] from i_ord i cross join (select distinct site from o_ep) s where i.rp=ceil((i.mp+1)*(1.0::double-0.10::double))""")
define("i_test", "select t.* exclude (split), s.split_no from o_traj t join i_split s on s.episode_id=t.episode_id and s.split='test'")
define("i_teste", "select * from i_split where split='test'")
outcome_ctes("i", "i_test", "i_teste", "i_thr", "split_no, method, alpha", "s.site=h.site and s.split_no=h.split_no")

for _h in (40, 60, 80):
    template_ctes(f"h{_h}t", "o_plain", "o_spone", "one", "split='validation' and not event", _h)
    define(f"h{_h}_traj", f"""select s.*, round((s.score-p.loc)/p.scale,9) as z, round((s.prev_score-q.loc)/q.scale,9) as prev_z
      from o_plain s join h{_h}t_tpl p on (s.t > p.lo or p.bin=0) and s.t <= p.hi join h{_h}t_tpl q on (s.t-1 > q.lo or q.bin=0) and s.t-1 <= q.hi where s.t <= {_h}""")
    define(f"h{_h}_ord", f"""select site, ms, mz, row_number() over (partition by site order by ms) as rs, row_number() over (partition by site order by mz) as rz, count(*) over (partition by site) as m0 from (
      select e.episode_id, e.site, coalesce(max(t.score) filter (where t.eligible),-{INF}) as ms, coalesce(max(t.z) filter (where t.eligible),-{INF}) as mz
      from o_cal e left join h{_h}_traj t on t.episode_id=e.episode_id group by 1,2)""")
    define(f"h{_h}_thr", f"""select site, 'fixed_max' as method, 0.10::double as alpha, 'score' as scale, [ms] as threshold from h{_h}_ord where rs=ceil((m0+1)*(1.0::double-0.10::double))
      union all select site, 'time_adaptive', 0.10::double, 'z', [mz] from h{_h}_ord where rz=ceil((m0+1)*(1.0::double-0.10::double))
      union all select o.site, 'high_confidence', 0.10::double, 'score', [ms] from h{_h}_ord o join o_hck c on c.site=o.site and c.alpha=0.10::double and o.rs=c.k""")
    define(f"h{_h}_test", f"select * from h{_h}_traj where split='test'")
    outcome_ctes(f"h{_h}", f"h{_h}_test", "o_teste", f"h{_h}_thr", "method, alpha", hmax=str(_h))

define("l1_sc", """select episode_id, t, risk, round(ln(least(greatest(risk,1e-6),1-1e-6)) - ln(1-least(greatest(risk,1e-6),1-1e-6)),9) as score from o_risk""")
define("l1_traj", """select s.episode_id, e.site, e.event, e.onset, e.horizon, e.split, s.t, s.risk, s.score, p.risk as prev_risk, p.score as prev_score, null::double as z, null::double as prev_z, s.t<e.onset as eligible
  from l1_sc s join o_split e on e.episode_id=s.episode_id left join l1_sc p on p.episode_id=s.episode_id and p.t=s.t-1 and p.t>=6 where s.t>=6 and s.t<=e.horizon""")
define("l1_ord", f"""select site, ms, row_number() over (partition by site order by ms) as rs, count(*) over (partition by site) as m0 from (
  select e.episode_id, e.site, coalesce(max(t.score) filter (where t.eligible),-{INF}) as ms from o_cal e left join l1_traj t on t.episode_id=e.episode_id group by 1,2)""")
define("l1_thr", "select site, 'fixed_max' as method, 0.10::double as alpha, 'score' as scale, [ms] as threshold from l1_ord where rs=ceil((m0+1)*(1.0::double-0.10::double))")
define("l1_test", "select * from l1_traj where split='test'")
outcome_ctes("l1", "l1_test", "o_teste", "l1_thr", "method, alpha")
