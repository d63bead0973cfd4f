"""SQL statements the query results are checked against."""

from __future__ import annotations

from flowloom.catalog import fixtures as fx

A_KEY = ("case when proto='icmp' then concat_ws('|',proto,saddr,daddr) "
         "else concat_ws('|',proto,saddr,cast(sport as varchar),daddr,cast(dport as varchar)) end")
Z_KEY = ("case when zeek_log in ('http','ftp') then "
         "concat_ws('|','tcp',orig_h,cast(orig_p as varchar),resp_h,cast(resp_p as varchar)) "
         "when proto='icmp' then concat_ws('|',proto,orig_h,resp_h) "
         "else concat_ws('|',proto,orig_h,cast(orig_p as varchar),resp_h,cast(resp_p as varchar)) end")

FX_A = f"fx_a as ({fx.duckdb_view(fx.FLOWS)})"
FX_Z = f"fx_z as ({fx.duckdb_view(fx.LOGS)})"

# matching, stated without the rank arithmetic of the Spark form
MATCH = f"""{FX_A}, {FX_Z},
ak as (select *, {A_KEY} as key from fx_a where proto in ('tcp','udp','icmp')),
zk as (select *, {Z_KEY} as key from fx_z),
http_to as (select h.key, h.seq as z_seq, h.trans_depth, h.response_body_len, a.seq as a_seq
  from (from zk where zeek_log='http') h asof join (from ak where proto='tcp') a
  on h.key = a.key and h.seq < a.seq),
fold as (select key, a_seq, max(z_seq) as z_seq, cast(sum(response_body_len) as bigint) as response_body_len,
  greatest(max(trans_depth), 0) as trans_depth from http_to group by key, a_seq),
queued as (select *, row_number() over (partition by key order by seq) as rn
  from ak where seq not in (select a_seq from fold)),
conns as (select *, row_number() over (partition by key order by seq) as rn from zk where zeek_log='conn'),
pairs as (select q.key, q.seq as a_seq, c.seq as z_seq, greatest(q.seq, c.seq) as merge_seq,
  coalesce(c.service,'-') as service from queued q join conns c on q.key = c.key and q.rn = c.rn),
fan as (select f.key, f.seq as z_seq, min(q.seq) as a_seq,
  any_value(case when length(trim(f.user_name)) > 0 and length(trim(f.password)) > 0 then 1 else 0 end) as is_ftp_login,
  any_value(case when length(trim(f.command)) > 0 then 1 else 0 end) as has_command
  from (from zk where zeek_log='ftp') f join queued q on q.key = f.key and q.seq < f.seq
  left join pairs p on p.a_seq = q.seq where p.a_seq is null or f.seq < p.merge_seq group by f.key, f.seq),
m as (
  select merge_seq, a_seq, z_seq, 'conn' as kind, key, service, 0 as trans_depth, 0 as response_body_len,
    0 as ct_flw_http_mthd, 0 as is_ftp_login, 0 as ct_ftp_cmd from pairs
  union all select a_seq, a_seq, z_seq, 'http', key, 'http', trans_depth, response_body_len,
    row_number() over (partition by key order by a_seq), 0, 0 from fold
  union all select z_seq, a_seq, z_seq, 'ftp', key, 'ftp', 0, 0, 0, is_ftp_login,
    sum(has_command) over (partition by key order by z_seq) from fan
  union all select seq, seq, null, 'other', null, null, 0, 0, 0, 0, 0 from fx_a
    where proto not in ('tcp','udp','icmp'))"""

_COUNTERS = {
    "ct_srv_src": ("service", "srv, saddr"),
    "ct_srv_dst": ("service", "srv, daddr"),
    "ct_dst_ltm": ("*", "daddr"),
    "ct_src_ltm": ("*", "saddr"),
    "ct_src_dport_ltm": ("*", "saddr, dport"),
    "ct_dst_sport_ltm": ("*", "daddr, sport"),
    "ct_dst_src_ltm": ("*", "saddr, daddr"),
}


def _counters(suffix: str) -> str:
    return ", ".join(
        f"count({what}) over (partition by {keys}{suffix} order by n range between 100 preceding "
        f"and 1 preceding) as {name}" for name, (what, keys) in _COUNTERS.items())


MERGED = f"""{MATCH},
w as (select m.*, a.* exclude (seq), coalesce(m.service,'-') as srv, row_number() over (order by merge_seq) as n
  from m join fx_a a on a.seq = m.a_seq),
counted as (select *, {_counters(', ltime')} from w)"""

_MERGED_COLUMNS = (
    "merge_seq, saddr, sport, daddr, dport, proto, state, dur, sbytes, dbytes, sttl, dttl, sloss, dloss, service, "
    "sload, dload, spkts, dpkts, stcpb, dtcpb, smeansz, dmeansz, cast(trans_depth as bigint) as trans_depth, "
    "cast(response_body_len as bigint) as response_body_len, sjit, djit, stime, ltime, sintpkt, dintpkt, tcprtt, "
    "synack, ackdat, cast(case when saddr = daddr and sport = dport then 1 else 0 end as int) as is_sm_ips_ports, "
    "cast(ct_flw_http_mthd as bigint) as ct_flw_http_mthd, cast(is_ftp_login as int) as is_ftp_login, "
    "cast(ct_ftp_cmd as bigint) as ct_ftp_cmd, ct_srv_src, ct_srv_dst, ct_dst_ltm, ct_src_ltm, ct_src_dport_ltm, "
    "ct_dst_sport_ltm, ct_dst_src_ltm")

_TEXT = "coalesce(cast({0} as varchar),'')"
_SCORING = [
    "stime", "proto", "saddr", "sport", "daddr", "dport", "state", "ltime", "spkts", "dpkts", "sbytes", "dbytes",
    "sttl", "dttl", "sload", "dload", "sloss", "dloss", "sintpkt", "dintpkt", "sjit", "djit", "stcpb", "dtcpb",
    "tcprtt", "synack", "ackdat", "smeansz", "dmeansz", "dur", None, "ct_flw_http_mthd", "is_ftp_login",
    "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm"]

TUPLE4 = "concat_ws(':', orig_h, cast(orig_p as varchar), resp_h, cast(resp_p as varchar))"
NUMERIC = ["sport", "dport", "dur", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "sload", "dload",
           "spkts", "dpkts", "stcpb", "dtcpb", "smeansz", "dmeansz", "sjit", "djit", "stime", "ltime",
           "sintpkt", "dintpkt", "tcprtt", "synack", "ackdat"]

SQL: dict[str, str] = {}

# --- merge --------------------------------------------------------------------
SQL["merged_flows"] = f"with {MERGED} select {_MERGED_COLUMNS} from counted"
# stime is scored as whole seconds, so every position prints the same in both engines
SQL["scoring_csv"] = (
    f"with {MERGED} select merge_seq, concat_ws(',', "
    + ", ".join("''" if c is None else
                _TEXT.format("cast(round_even(stime, 0) as bigint)") if c == "stime" else _TEXT.format(c)
                for c in _SCORING)
    + ") as line from counted")
SQL["fifo_match"] = f"with {MATCH} select key, a_seq, z_seq, merge_seq, service from pairs"
SQL["icmp_match"] = f"with {MATCH} select key, a_seq, z_seq from pairs where key like 'icmp|%'"
SQL["http_fold_join"] = f"""with {MATCH} select key, a_seq, z_seq, trans_depth, response_body_len,
  cast(ct_flw_http_mthd as bigint) as ct_flw_http_mthd from m where kind='http'"""
SQL["ftp_fanout"] = f"""with {MATCH} select key, a_seq, z_seq, cast(is_ftp_login as int) as is_ftp_login,
  cast(ct_ftp_cmd as bigint) as ct_ftp_cmd from m where kind='ftp'"""
SQL["other_passthrough"] = f"""with {MATCH} select m.merge_seq, a.proto, a.saddr, a.daddr, m.service,
  cast(case when saddr = daddr and sport = dport then 1 else 0 end as int) as is_sm_ips_ports
  from m join fx_a a on a.seq = m.a_seq where kind='other'"""
SQL["protocol_routes"] = f"""with {MATCH} select kind, count(*) as merges, count(distinct a_seq) as flows,
  count(service) as with_service from m group by kind"""
SQL["unmatched_a"] = f"""with {MATCH} select q.* exclude (key, rn) from queued q
  where q.seq not in (select a_seq from pairs)"""
SQL["unmatched_b"] = f"""with {MATCH} select z.* exclude (key) from zk z
  where z.seq not in (select z_seq from pairs) and z.seq not in (select z_seq from fan)
  and z.seq not in (select z_seq from http_to)"""
for _name in _COUNTERS:
    SQL[_name] = f"with {MERGED} select merge_seq, n, {_name} from counted"
SQL["counters_any_second"] = f"""with {MERGED} select merge_seq, {_counters('')}
  from (select * from w) w"""
SQL["merge_sequence"] = f"with {MERGED} select merge_seq, a_seq, n from w"
SQL["http_epochs"] = f"""with {MATCH} select h.key, h.seq,
  (select count(*) from ak a where a.key = h.key and a.proto='tcp' and a.seq < h.seq) as epoch
  from zk h where h.zeek_log='http'"""
SQL["pairing_ordinal"] = f"with {MATCH} select key, seq, row_number() over (partition by key order by seq) as rn from ak"

# --- projections, filters and scalar functions --------------------------------
_A, _Z = f"with {FX_A} ", f"with {FX_Z} "
SQL["header_drop"] = _A + """select cast(seq as varchar) as seq, case when dpkts = 0 then 'n/a' else cast(stime_us as varchar) end
  as stime_us, proto, cast(sport as varchar) as sport from fx_a"""
SQL["ordered_projection"] = _A + "select saddr as srcip, dport as dsport, proto, dur, sjit, attack_cat, label from fx_a"
SQL["fixed_layout"] = _A + "select seq, cast(null as varchar) as service, proto, dur from fx_a"
SQL["label_filter"] = _A + """select seq, label from fx_a
  where dpkts > 2"""
SQL["numeric_coercion"] = _A + """select seq, cast(label as varchar) as raw,
  case when attack_cat is null then dur end as value from fx_a"""
SQL["epoch_conversion"] = "select o_orderkey, cast(epoch_us(o_orderdate) as double) / case when o_orderstatus = 'P' then 1000000 else 1 end as epoch from orders"
SQL["port_cast"] = _A + "select seq, case when state in ('INT', 'REQ') then 0 else dport end as port from fx_a"
SQL["half_even_seconds"] = _A + """select seq, cast(round_even(stime, 0) as bigint) as stime,
  cast(round_even(sbytes / 2, 0) as bigint) as half_bytes from fx_a"""
SQL["flow_keys_a"] = _A + f"select seq, {A_KEY} as key from fx_a"
SQL["flow_keys_b"] = _Z + f"select seq, {Z_KEY} as key from fx_z"
SQL["same_endpoint"] = _A + "select seq, cast(saddr = daddr and sport = dport as int) as is_sm_ips_ports from fx_a"
SQL["ftp_login_flag"] = _Z + """select seq, cast(trim(user_name) <> '' and trim(password) <> '' as int) as is_ftp_login,
  cast(trim(command) <> '' as int) as has_command from fx_z where zeek_log = 'ftp'"""
SQL["service_default"] = _Z + """select seq, case zeek_log when 'conn' then coalesce(service, '-') else zeek_log end
  as service from fx_z"""
SQL["class_names"] = _A + """select case when label = 1 then 'Attack' else 'Normal' end as attack_type,
  count(*) as flows from fx_a group by 1"""
SQL["cast_and_fill"] = _A + """select seq, coalesce(sjit, -1) as sjit, coalesce(djit, -1) as djit,
  coalesce(sintpkt, -1) as sintpkt, coalesce(dintpkt, -1) as dintpkt, cast(spkts as double) as spkts from fx_a"""
SQL["scoring_float"] = _A + """select seq, cast(case when attack_cat is null then dpkts else 0 end as float) as value
  from fx_a"""
SQL["category_lookup"] = _A + """select seq, proto, case when dpkts = 0 then 'XXX' else state end as state,
  cast(case proto when 'tcp' then 0 when 'udp' then 1 when 'arp' then 3 when 'icmp' then 6 end as double) as proto_index,
  cast(case when dpkts = 0 then 16 else case state when 'FIN' then 0 when 'CON' then 1 when 'INT' then 2
    when 'REQ' then 3 when 'RST' then 4 end end as double) as state_index from fx_a"""
SQL["event_latency"] = _A + """select seq, case when state = 'REQ' then 0.0e0 else 1800000000.0e0 - floor(stime) end
  as latency from fx_a"""
SQL["flow_text"] = _A + "select seq, concat(saddr, ':', sport, ' -> ', daddr, ':', dport) as flow from fx_a"
SQL["ipv4_numbers"] = _A + """select seq, case when state not in ('REQ', 'CON') then
  cast(split_part(saddr, '.', 1) as bigint) * 16777216 + cast(split_part(saddr, '.', 2) as bigint) * 65536
  + cast(split_part(saddr, '.', 3) as bigint) * 256 + cast(split_part(saddr, '.', 4) as bigint) end as number from fx_a"""
SQL["capture_filter"] = _A + "select seq, proto from fx_a where proto <> 'arp'"
SQL["four_tuple_filter"] = _Z + "select seq, orig_h, resp_p from fx_z where resp_p <> 21 and trans_depth <> 0"
SQL["upper_method"] = _Z + """select upper(method) as method, upper(command) as command, count(*) as records
  from fx_z group by 1, 2"""
SQL["time_guard"] = _A + "select seq, stime_us from fx_a where dpkts > 0"

# --- time matching and reconciliation -------------------------------------------
_EXACT = f"""with {FX_A}, {FX_Z},
ta as (select seq as a_seq, stime_us as a_us, row_number() over (partition by stime_us order by seq) as rn from fx_a),
tz as (select seq as z_seq, ts_us as z_us, row_number() over (partition by ts_us order by seq) as rn from fx_z)"""
SQL["exact_time_match"] = _EXACT + "select a_seq, a_us, z_seq, z_us from ta join tz on a_us = z_us and ta.rn = tz.rn"
_NEAR = "exists (select 1 from fx_a where stime_us between ts_us - 500 and ts_us + 500)"
SQL["band_semi"] = f"with {FX_A}, {FX_Z} select seq as z_seq, ts_us as z_us from fx_z where {_NEAR}"
SQL["band_anti"] = f"with {FX_A}, {FX_Z} select seq as z_seq, ts_us as z_us from fx_z where not {_NEAR}"
SQL["match_summary"] = f"""with {FX_A}, {FX_Z},
ta as (select seq as a_seq, stime_us as a_us, row_number() over (partition by stime_us order by seq) as rn from fx_a),
tz as (select seq as z_seq, ts_us as z_us, row_number() over (partition by ts_us order by seq) as rn from fx_z
  where method is not null),
m as (select count(*) as matched from ta join tz on a_us = z_us and ta.rn = tz.rn),
z as (select count(*) as total_b, count(*) filter (method is null) as invalid_b from fx_z),
a as (select count(*) as total_a from fx_a)
select total_b, total_a, matched, cast(0 as bigint) as inexact, total_b - matched as unmatched_b,
  total_a - matched as unmatched_a, invalid_b from m, z, a"""
SQL["unmatched_by_time"] = _EXACT + """select a_seq, a_us from ta where not exists
  (select 1 from tz where a_us = z_us and ta.rn = tz.rn)"""
SQL["time_islands"] = _A + """, t as (select seq as a_seq, stime_us as a_us,
  lag(stime_us) over (order by stime_us, seq) as prev from fx_a)
select a_seq, a_us, max(case when prev is null or a_us - prev > 120000000 then a_us end)
  over (order by a_us, a_seq rows unbounded preceding) as island from t"""
SQL["time_sort"] = _A + """select cast(floor(stime) as bigint) as second, seq,
  row_number() over (order by floor(stime), seq) as position from fx_a"""
SQL["conn_enrich"] = f"""with {FX_Z},
k as (select *, {TUPLE4} as t from fx_z),
c as (select *, coalesce(lag(seq) over (partition by t order by seq), -1000) as since from k where zeek_log='conn'),
h as (select c.seq, max(k.seq) as pick from c join k on k.t = c.t and k.zeek_log='http' and k.seq < c.seq
  and k.seq > c.since group by c.seq),
f as (select c.seq, max(k.seq) as pick from c join k on k.t = c.t and k.zeek_log='ftp' and k.seq < c.seq
  and k.seq > c.since group by c.seq)
select c.seq, c.service, hr.trans_depth, hr.response_body_len,
  case when hr.seq is not null then coalesce(hr.method, '') end as method, fr.user_name, fr.password, fr.command
from c left join h on h.seq = c.seq left join k hr on hr.seq = h.pick and hr.ts_us >= c.ts_us - 1728000000000
left join f on f.seq = c.seq left join k fr on fr.seq = f.pick and fr.ts_us >= c.ts_us - 1728000000000"""
SQL["http_last100"] = _Z + """, w as (select *, upper(method) as um, row_number() over (order by seq) as n from fx_z
  where zeek_log='http' and method is not null)
select z.seq, coalesce(c.c, 0) as ct_flw_http_mthd from fx_z z left join (select seq, count(*) over (
  partition by orig_h, orig_p, resp_h, resp_p, um order by n range between 100 preceding and 1 preceding) as c from w) c
  on c.seq = z.seq"""
SQL["ftp_last100"] = _Z + """, w as (select *, upper(command) as um, row_number() over (order by seq) as n from fx_z
  where zeek_log='ftp' and command <> '')
select z.seq, coalesce(c.c, 0) as ct_ftp_cmd from fx_z z left join (select seq, count(*) over (
  partition by orig_h, orig_p, resp_h, resp_p, um order by n range between 100 preceding and 1 preceding) as c from w) c
  on c.seq = z.seq"""

# --- allow-list, verdicts, alerts --------------------------------------------------
# the four ranges written as octet conditions, first match by precedence
_IN = {
    "GCloud": "({0} like '10.0.0.%' and cast(split_part({0}, '.', 4) as int) between 0 and 15)",
    "AWS": "({0} like '10.0.0.%' and cast(split_part({0}, '.', 4) as int) between 8 and 15)",
    "Canonical": "({0} like '10.0.1.%' and cast(split_part({0}, '.', 4) as int) between 4 and 5)",
    "SUSE": "({0} like '10.0.0.%' and cast(split_part({0}, '.', 4) as int) between 48 and 63)",
}
_REASONED = f"""with {FX_A},
met as (select * replace (case when dport = 1024 then '169.254.169.254' else daddr end as daddr) from fx_a),
r as (select *, (sbytes % 100) / 100.0e0 as probability, case when daddr = '169.254.169.254' then 'Meta' """ + " ".join(
    f"when {c.format('saddr')} or {c.format('daddr')} then '{n}'" for n, c in _IN.items()) + " end as reason from met)"
SQL["allow_list"] = _REASONED + "select seq, saddr, daddr, reason from r"
# every prefix length of every address is looked up among the ranges
_DOTTED = "concat_ws('.', '10', {0} // 65536 % 256, {0} // 256 % 256, {0} % 256)"
SQL["allow_list_dense"] = f"""with nets as (select 20 + o_custkey % 13 as length, min(o_custkey % 5) as place,
    (o_orderkey * 7919 % 16777216) >> cast(12 - o_custkey % 13 as int) as prefix from orders group by all),
p as (select l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 37) % 16777216 as s,
  (l_partkey * 104729 + l_linenumber) % 16777216 as d from lineitem),
probes as (select s, d, unnest([s, d]) as number from (select distinct s, d from p)),
found as (select s, d, min(place) as place from (
  select *, unnest(range(20, 33)) as length from probes) q
  join nets on nets.length = q.length and prefix = number >> cast(32 - q.length as int) group by all)
select l_orderkey, l_linenumber, {_DOTTED.format('s')} as saddr, {_DOTTED.format('d')} as daddr,
  ['GCloud', 'AWS', 'Google', 'Canonical', 'SUSE'][place + 1] as reason from p left join found using (s, d)"""
SQL["verdicts"] = _REASONED + """select seq, case when probability >= 0.5 and reason is not null
  then 'ignored(' || reason || ')' when probability >= 0.5 then 'attack' else 'normal' end as verdict,
  case when probability >= 0.5 and reason is null then case when probability >= 0.7 then 'high' else 'low' end end
  as severity from r"""
SQL["alert_lines"] = _REASONED + """select concat(saddr, ':', sport, ' -> ', daddr, ':', dport) as line from r
  where probability >= 0.5 and reason is null"""

# --- profiling -----------------------------------------------------------------------
SQL["value_counts"] = _A + " union all ".join(
    f"select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as count from fx_a group by 2"
    for c in ("proto", "state", "label", "attack_cat"))
SQL["attack_category_counts"] = _A + """select 'attack_cat' as "column", attack_cat as value, count(*) as count
  from fx_a where label = 1 group by 2"""
SQL["label_share"] = _A + """select count(*) as total, count(*) filter (label = 1) as attacks,
  count(*) filter (label = 0) as normals, 100.0e0 * count(*) filter (label = 1) / count(*) as attack_pct,
  100.0e0 * count(*) filter (label = 0) / count(*) as normal_pct from fx_a"""
SQL["presence"] = _A + "select count(*) filter (label = 1) > 0 as present from fx_a"

_STATS = ("count({0}) as count, round(avg({0}), 4) as mean, round(stddev_samp({0}), 4) as std, "
          "cast(round(min({0}), 4) as double) as min, cast(round(max({0}), 4) as double) as max, ")
_QUANTILES = ", ".join(f"round(quantile_cont(cast({{0}} as double), {p}), 4) as p{n}" for n, p in
                       ((1, 0.01), (5, 0.05), (25, 0.25), (50, 0.5), (75, 0.75), (95, 0.95), (99, 0.99)))
_SENTINEL = ", ".join(
    f"count(*) filter ({{0}} {cond}) as {n}, round(100.0e0 * count(*) filter ({{0}} {cond}) / count(*), 4) as {n}_pct"
    for n, cond in (("zeros", "= 0"), ("minus_ones", "= -1"), ("nulls", "is null")))


def _per_column(cols, body, table):
    return " union all ".join(f"select '{c}' as \"column\", {body.format(c)} from {table}" for c in cols)


SQL["describe_numeric"] = _A + _per_column(NUMERIC, _STATS + _QUANTILES, "fx_a")
SQL["describe_lineitem"] = _per_column(["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                       _STATS + _QUANTILES, "lineitem")
SQL["sentinel_profile"] = _A + _per_column(NUMERIC, _SENTINEL, "fx_a")
SQL["full_profile"] = _A + _per_column(["sjit", "djit", "sintpkt", "dintpkt"],
                                       _STATS + _QUANTILES + ", " + _SENTINEL, "fx_a")
SQL["http_profile"] = f"with {MERGED} " + _per_column(
    ["trans_depth", "response_body_len", "ct_flw_http_mthd"], _STATS + _QUANTILES + ", " + _SENTINEL, "counted")
SQL["short_flow_stats"] = _A + " union all ".join(
    f"""select '{f}' as feature, '{p}' as packet_column, cast({n} as int) as packets, count(*) as flows,
  round(avg({f}), 4) as mean, round(stddev_samp({f}), 4) as std, round(min({f}), 4) as min, round(max({f}), 4) as max,
  round(quantile_cont({f}, 0.25), 4) as p25, round(quantile_cont({f}, 0.5), 4) as p50,
  round(quantile_cont({f}, 0.75), 4) as p75, count(*) filter ({f} = 0) as zeros,
  count(*) filter ({f} = -1) as minus_ones, count(*) filter ({f} is null) as nulls from fx_a where {p} = {n}"""
    for f, p in (("sjit", "spkts"), ("djit", "dpkts"), ("sintpkt", "spkts"), ("dintpkt", "dpkts")) for n in (1, 2, 3))

# --- dataset preparation ----------------------------------------------------------------
_HASH = "md5(concat(cast(seq as varchar), '|42'))"
SQL["csv_union"] = _A + "select seq, proto, saddr, dur, label from fx_a"
SQL["log_union"] = _Z + """select seq, zeek_log, case when zeek_log = 'conn' then service end as service,
  case when zeek_log = 'http' then method end as method,
  case when zeek_log = 'http' then trans_depth end as trans_depth,
  case when zeek_log = 'ftp' then command end as command from fx_z"""
SQL["balanced_sample"] = _A + f""", r as (select *, row_number() over (partition by label order by {_HASH}, seq) as rn
  from fx_a), s as (select least(count(*) filter (label = 1), count(*) filter (label = 0) // 3) as n from fx_a)
select seq, label, dur, attack_cat from r, s where rn <= case label when 1 then n else 3 * n end"""
SQL["seeded_shuffle"] = _A + f"select seq, row_number() over (order by {_HASH}, seq) as position from fx_a"
SQL["hash_split"] = _A + f"""select seq, label, cast(concat('0x', substr({_HASH}, 1, 8)) as bigint) < 3435973836
  as is_train from fx_a"""
SQL["stratified_folds"] = _A + f"""select seq, label,
  cast((row_number() over (partition by label order by {_HASH}, seq) - 1) % 15 as int) as fold from fx_a"""
SQL["category_index"] = _A + """select state as value, count(*) as count,
  cast(row_number() over (order by count(*) desc, state) - 1 as double) as index from fx_a group by state"""

# --- evaluation ----------------------------------------------------------------------------
_P = _A + ", p as (select seq, label, cast(dur > 40 as int) as prediction from fx_a) "
SQL["confusion_matrix"] = _P + """select cast(l as int) as label, cast(q as int) as prediction,
  (select count(*) from p where p.label = l and p.prediction = q) as n from range(2) a(l), range(2) b(q)"""
SQL["classification_report"] = _P + """,
c as (select name, (select count(*) from p where label = k) as support,
  (select count(*) from p where prediction = k) as predicted,
  (select count(*) from p where label = k and prediction = k) as hits from (values (0, 'Normal'), (1, 'Attack')) v(k, name)),
r as (select *, hits / predicted as pr, hits / support as re from c),
x as (select *, 2 * pr * re / (pr + re) as f from r)
select name as class, round(pr, 6) as precision, round(re, 6) as recall, round(f, 6) as f1, support from x
union all select 'accuracy', null, null, round(sum(hits) / sum(support), 6), cast(sum(support) as bigint) from x
union all select 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), cast(sum(support) as bigint) from x
union all select 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), cast(sum(support) as bigint) from x"""
SQL["accuracy"] = _P + """select round(avg(cast(label = prediction as int)), 6) as accuracy,
  round(avg(cast(label = prediction as int)) filter (label <> 0), 6) as attack_accuracy from p"""
SQL["fold_accuracy"] = _A + f""", f as (select *, (row_number() over (partition by label order by {_HASH}, seq) - 1) % 15
  as fold from fx_a),
s as (select t, fold, avg(cast(label = cast(dur > t as int) as int)) as acc from f, (values (40), (80)) v(t)
  group by t, fold),
m as (select t, avg(acc) as acc from s group by t)
select t as threshold, round(acc, 6) as mean_accuracy from m order by acc desc limit 1"""

# --- streams -----------------------------------------------------------------------------------
SQL["stream_alerts"] = SQL["alert_lines"]

# --- sequential matching, one recursion step per arrival ------------------------------------------
# both windows break ties alike, otherwise equal times could fall into different islands
_ISLANDS = """lagged as (select *, lag(us) over (partition by key order by us, side, seq) as prev from ev),
il as (select *, sum(case when prev is null or us - prev > 1000 then 1 else 0 end)
  over (partition by key order by us, side, seq rows unbounded preceding) as island from lagged)"""
_GREEDY = f"""with recursive {FX_A}, {FX_Z},
ev as (select 0 as key, 0 as side, seq, stime_us as us from fx_a union all select 0, 1, seq, ts_us from fx_z),
{_ISLANDS},
g as (select island, coalesce(list({{'t': us, 's': seq}} order by us, seq) filter (side = 0), []) as a,
  coalesce(list({{'t': us, 's': seq}} order by seq) filter (side = 1), []) as z from il group by island),
r as (select island, a, z, 0 as i, cast(null as struct(t bigint, s bigint)) as hit from g
  union all select island, case when h is null then a else list_filter(a, lambda x: x.s <> h.s) end, z, i + 1, h
  from (select *, list_filter(a, lambda x: x.t between z[i + 1].t - 1000 and z[i + 1].t + 1000)[1] as h
    from r where i < len(z)) s)
select hit.s as a_seq, hit.t as a_us, z[i].s as z_seq, z[i].t as z_us from r where hit is not null"""
SQL["nearest_time_match"] = _GREEDY
SQL["inexact_matches"] = f"select * from ({_GREEDY}) pairs where a_us <> z_us"
SQL["interval_match"] = f"""with recursive {FX_A}, {FX_Z},
ev as (select {A_KEY} as key, 0 as side, seq, stime_us as us from fx_a where proto in ('tcp', 'udp', 'icmp')
  union all select {Z_KEY}, 1, seq, ts_us from fx_z),
{_ISLANDS},
g as (select key, island, list({{'side': side, 't': us, 's': seq}} order by seq) as e from il group by key, island),
r as (select key, island, e, 0 as i, [e[1]][2:] as wa, [e[1]][2:] as wz, e[1:1][2] as hit from g
  union all select key, island, e, i + 1,
    case when e[i + 1].side = 0 then case when h is null then list_append(wa, e[i + 1]) else wa end
      else list_filter(wa, lambda x: h is null or x.s <> h.s) end,
    case when e[i + 1].side = 1 then case when h is null then list_append(wz, e[i + 1]) else wz end
      else list_filter(wz, lambda x: h is null or x.s <> h.s) end, h
  from (select *, list_filter(case when e[i + 1].side = 0 then wz else wa end,
    lambda x: abs(x.t - e[i + 1].t) <= 1000)[1] as h from r where i < len(e)) s),
m as (select key, e[i] as cur, hit from r where hit is not null)
select key, case when cur.side = 0 then cur.s else hit.s end as a_seq, case when cur.side = 0 then cur.t else hit.t end as a_us,
  case when cur.side = 0 then hit.s else cur.s end as z_seq, case when cur.side = 0 then hit.t else cur.t end as z_us from m"""



def _wide(sql: str, late: bool, **names: str) -> str:
    """The same with ten minutes for a millisecond and, if asked for, the late records' arrival numbers."""
    sql = sql.replace(" 1000", " 600000000")
    if late:
        sql = sql.replace("1, seq, ts_us from fx_z", "1, seq + case when round(seq / 4.0) % 50 = 0 then 401 else 0 end, ts_us from fx_z")
    for old, new in names.items():
        sql = sql.replace(globals()[old], new)
    return sql


SQL["nearest_in_ten_minutes"] = _wide(_GREEDY, False)
SQL["nearest_late_records"] = _wide(_GREEDY, True)
SQL["interval_of_hot_keys"] = _wide(SQL["interval_match"], True, A_KEY="proto", Z_KEY="proto").replace(
    " where proto in ('tcp', 'udp', 'icmp')", "")

_REPLAY = f"""{FX_A}, {FX_Z},
ev as (select {A_KEY} as key, seq, case when proto = 'tcp' then 'tcp' else 'dgram' end as kind, '' as service,
    0 as depth, 0 as len, 0 as login, 0 as cmd from fx_a where proto in ('tcp', 'udp', 'icmp')
  union all select {Z_KEY}, seq, zeek_log, case zeek_log when 'conn' then coalesce(service, '-') else zeek_log end,
    trans_depth, response_body_len, cast(trim(user_name) <> '' and trim(password) <> '' as int),
    cast(trim(command) <> '' as int) from fx_z),
g as (select key, list({{'s': seq, 'k': kind, 'v': service, 'd': depth, 'l': len, 'u': login, 'c': cmd}} order by seq) as e
  from ev group by key),
r as (select key, e, 0 as i, e[1:0] as aq, e[1:0] as zq, e[1:0] as acc, e[1:1][2] as a, e[1:1][2] as z, 0 as n from g
  union all select key, e, i + 1,
    case act when 'keep' then list_append(aq, cur) when 'give' then aq[2:] else aq end,
    case when act = 'queue' or cur.k = 'http' then list_append(zq, cur) when act = 'take' then zq[2:] else zq end,
    case when cur.k = 'http' then list_append(acc, cur) when act = 'fold' then acc[1:0] else acc end,
    case when act in ('fold', 'take') then cur when act in ('give', 'lend') then aq[1] end,
    case act when 'fold' then struct_update(acc[-1], d := greatest(list_max([x.d for x in acc]), 0),
        l := cast(list_sum([x.l for x in acc]) as bigint))
      when 'take' then zq[1] when 'give' then cur when 'lend' then cur end, 0
  from (select *, e[i + 1] as cur, case
      when e[i + 1].k = 'tcp' and len(acc) > 0 then 'fold'
      when e[i + 1].k in ('tcp', 'dgram') then case when len(zq) > 0 then 'take' else 'keep' end
      when e[i + 1].k = 'http' then 'http'
      when len(aq) > 0 then case e[i + 1].k when 'ftp' then 'lend' else 'give' end
      else 'queue' end as act from r where i < len(e)) s),
hits as (select key, e[i].s as merge_seq, a.s as a_seq, z.s as z_seq, z.k as kind, z.v as service, z.d as d, z.l as l,
  z.u as u, z.c as c from r where a is not null),
merges as (select merge_seq, a_seq, z_seq, kind, service, cast(case kind when 'http' then d else 0 end as bigint) as trans_depth,
  cast(case kind when 'http' then l else 0 end as bigint) as response_body_len,
  case kind when 'http' then row_number() over (partition by key, kind order by merge_seq) else 0 end as ct_flw_http_mthd,
  cast(case kind when 'ftp' then u else 0 end as int) as is_ftp_login,
  cast(case kind when 'ftp' then sum(c) over (partition by key, kind order by merge_seq) else 0 end as bigint) as ct_ftp_cmd
  from hits)"""
SQL["replay_merges"] = f"with recursive {_REPLAY} select * from merges"
SQL["stream_merge"] = f"""with recursive {_REPLAY} select * from merges
  union all select seq, seq, null, 'other', null, 0, 0, 0, 0, 0 from fx_a where proto not in ('tcp', 'udp', 'icmp')"""
_REPLAY_COUNTED = f"""with recursive {_REPLAY},
m as (select merge_seq, a_seq, z_seq, kind, service, trans_depth, response_body_len, ct_flw_http_mthd, is_ftp_login,
    ct_ftp_cmd from merges
  union all select seq, seq, null, 'other', null, 0, 0, 0, 0, 0 from fx_a where proto not in ('tcp', 'udp', 'icmp')),
w as (select m.*, a.* exclude (seq), coalesce(m.service, '-') as srv, row_number() over (order by merge_seq) as n
  from m join fx_a a on a.seq = m.a_seq),
counted as (select *, {_counters(', ltime')} from w)"""


def _replayed(order_a: str, order_z: str) -> str:
    """The replay over arrivals numbered anew: by the columns given for flows (sensor 0) and logs (sensor 1)."""
    numbers = f"""{FX_A.replace("fx_a as", "own_a as", 1)}, {FX_Z.replace("fx_z as", "own_z as", 1)},
numbers as (select s, id, row_number() over (order by {', '.join(f'o{i}' for i in range(1, 6))}) as nr from (
  select 0 as s, seq as id, unnest([{{{order_a}}}], recursive := true) from own_a
  union all by name select 1 as s, seq as id, unnest([{{{order_z}}}], recursive := true) from own_z)),
fx_a as (select own_a.* replace (nr as seq) from own_a join numbers on s = 0 and id = seq),
fx_z as (select own_z.* replace (nr as seq) from own_z join numbers on s = 1 and id = seq)"""
    return f"""with recursive {_REPLAY.replace(f"{FX_A}, {FX_Z}", numbers, 1)}
select stcpb, kind, m.service, m.trans_depth, m.response_body_len, ct_flw_http_mthd, is_ftp_login, ct_ftp_cmd
from (select * from merges union all select seq, seq, null, 'other', null, 0, 0, 0, 0, 0 from fx_a
  where proto not in ('tcp', 'udp', 'icmp')) m join fx_a on fx_a.seq = m.a_seq"""


def _hot(columns: str) -> str:
    names = columns.split()
    values = ["'tcp'", "'10.9.9.9'", "1024", "'10.9.9.8'", "21"]
    return ", ".join(f"case when round(seq / 4.0) % 3 = 0 then {v} else {c} end as {c}" for c, v in zip(names, values))


SQL["replay_hot_ftp"] = "with recursive " + _REPLAY.replace(f"{FX_A}, {FX_Z}", (
    f"{FX_A.replace('fx_a as', 'own_a as', 1)}, {FX_Z.replace('fx_z as', 'own_z as', 1)},\n"
    f"fx_a as (select * replace ({_hot('proto saddr sport daddr dport')}) from own_a),\n"
    f"fx_z as (select * replace ({_hot('proto orig_h orig_p resp_h resp_p')}) from own_z)"), 1) + " select * from merges"
# Expiry by event time: an idle day ends a session, within one the queues lose what is a day older than the clock.
_EXPIRING = f"""with recursive {FX_A}, {FX_Z},
ev0 as (select {A_KEY} as key, seq, case when proto = 'tcp' then 'tcp' else 'dgram' end as kind, 0 as depth, 0 as len,
    0 as cmd, stime_us // 1000 as t from fx_a where proto in ('tcp', 'udp', 'icmp')
  union all select {Z_KEY}, seq, zeek_log, trans_depth, response_body_len, cast(trim(command) <> '' as int), ts_us // 1000 from fx_z),
ev1 as (select *, max(t) over (partition by key order by seq) as clk,
  max(t) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as past from ev0),
ev as (select *, sum(case when past + 86400000 <= t then 1 else 0 end) over (partition by key order by seq) as session from ev1),
g as (select key, session, list({{'s': seq, 'k': kind, 'd': depth, 'l': len, 'c': cmd, 't': t, 'n': clk}} order by seq) as e
  from ev group by key, session),
r as (select key, session, e, 0 as i, e[1:0] as aq, e[1:0] as zq, e[1:0] as acc, e[1:1][2] as a, e[1:1][2] as z, e[1:0] as gone from g
  union all select key, session, e, i + 1,
    case act when 'keep' then list_append(aq, cur) when 'give' then aq[2:] else aq end,
    case when act = 'queue' or cur.k = 'http' then list_append(zq, cur) when act = 'take' then zq[2:] else zq end,
    case when cur.k = 'http' then list_append(acc, cur) when act = 'fold' then acc[1:0] else acc end,
    case when act in ('fold', 'take') then cur when act in ('give', 'lend') then aq[1] end,
    case act when 'fold' then acc[-1] when 'take' then zq[1] when 'give' then cur when 'lend' then cur end, gone
  from (select *, case
      when cur.k = 'tcp' and len(acc) > 0 then 'fold'
      when cur.k in ('tcp', 'dgram') then case when len(zq) > 0 then 'take' else 'keep' end
      when cur.k = 'http' then 'http'
      when len(aq) > 0 then case cur.k when 'ftp' then 'lend' else 'give' end
      else 'queue' end as act from (
    select key, session, e, i, e[i + 1] as cur, list_filter(aq, lambda x: x.t + 86400000 > e[i + 1].n) as aq,
      list_filter(zq, lambda x: x.t + 86400000 > e[i + 1].n) as zq,
      list_filter(list_concat(aq, zq), lambda x: x.t + 86400000 <= e[i + 1].n) as gone,
      case when acc[-1].t + 86400000 <= e[i + 1].n then acc[1:0] else acc end as acc from r where i < len(e)) x) s),
hits as (select key, session, e[i].s as merge_seq, a.s as a_seq, z.s as z_seq, z.k as kind, z.c as c from r where a is not null),
-- rows that a clock passed, and those left at the end of a session that a later session or the watermark passed
ends as (select key, max(clk) as clk from ev group by key), mark as (select max(t) - 3600000 as w from ev0),
lost as (select unnest(gone) as x from r
  union all select x from (select key, unnest(list_concat(aq, zq)) as x from r where i = len(e)) join ends using (key), mark
  where x.t + 86400000 <= ends.clk or x.t + 86400000 < w)"""
_KEPT = """select 'merged' as status, merge_seq, a_seq, z_seq, kind,
  case kind when 'http' then row_number() over (partition by key, session, kind order by merge_seq) else 0 end as ct_flw_http_mthd,
  cast(case kind when 'ftp' then sum(c) over (partition by key, session, kind order by merge_seq) else 0 end as bigint) as ct_ftp_cmd
from hits"""
_LOST = """select case when x.k in ('tcp', 'dgram') then 'lost_flow' else 'lost_log' end as status, null as merge_seq,
  case when x.k in ('tcp', 'dgram') then x.s end as a_seq, case when x.k not in ('tcp', 'dgram') then x.s end as z_seq,
  case when x.k not in ('tcp', 'dgram') then x.k end as kind, 0 as ct_flw_http_mthd, 0 as ct_ftp_cmd from lost"""
SQL["stream_expired"] = f"{_EXPIRING} {_KEPT} union all {_LOST}"
SQL["stream_sinks"] = f"""{_EXPIRING}, kept as ({_KEPT}), gone as ({_LOST}),
m as (select merge_seq, a_seq, kind, case kind when 'conn' then coalesce(z.service, '-') else kind end as service,
    ct_flw_http_mthd, ct_ftp_cmd from kept join fx_z z on z.seq = z_seq
  union all select seq, seq, 'other', null, 0, 0 from fx_a where proto not in ('tcp', 'udp', 'icmp')),
w as (select m.*, a.* exclude (seq), coalesce(m.service, '-') as srv, row_number() over (order by merge_seq) as n
  from m join fx_a a on a.seq = m.a_seq),
counted as (select *, {_counters(', ltime')} from w)
select 'merged' as sink, merge_seq as seq, stcpb, service, ct_flw_http_mthd, ct_ftp_cmd, ct_srv_src, ct_dst_src_ltm from counted
union all select 'scoring', null, stcpb, null, ct_flw_http_mthd, ct_ftp_cmd, ct_srv_src, ct_dst_src_ltm from counted
union all select 'unmatched/flows', a_seq, a_seq * 250, null, null, null, null, null from gone where status = 'lost_flow'
union all select 'unmatched/logs', z_seq, null, kind, null, null, null, null from gone where status = 'lost_log'
union all select 'raw/flows', seq, stcpb, null, null, null, null, null from fx_a
union all select 'raw/logs', seq, null, zeek_log, null, null, null, null from fx_z"""
SQL["stream_scores"] = _REASONED + """select stcpb, (seq // 4) % 50 = 7 as malformed,
  case when (seq // 4) % 50 <> 7 then reason end as reason, true as same from r"""
# by time, flows first; ties by sequence number and length
SQL["merge_from_files"] = _replayed("'o1': stime_us, 'o2': 0, 'o3': stcpb, 'o4': 0, 'o5': 0",
                                    "'o1': ts_us, 'o2': 1, 'o3': response_body_len, 'o4': seq, 'o5': 0")
# wave by wave, flows before logs, logs by kind
_WAVE = "cast(floor(round(seq / 4.0) * 4 * 3 / (select max(event_id) * 4 + 4 from events)) as bigint)"
SQL["stream_from_files"] = _replayed(f"'o1': {_WAVE}, 'o2': 0, 'o3': '', 'o4': seq, 'o5': 0",
                                     f"'o1': {_WAVE}, 'o2': 1, 'o3': zeek_log, 'o4': seq, 'o5': 0")
SQL["replay_flows"] = f"{_REPLAY_COUNTED} select {_MERGED_COLUMNS} from counted"
SQL["stream_counters"] = f"{_REPLAY_COUNTED} select merge_seq, n, {', '.join(_COUNTERS)} from counted"


# --- files, streams over files, model parts ------------------------------------------
SQL["flow_csv_scan"] = _A + """select stcpb, proto, saddr, sport, daddr, dport, ltime * 86400 as ltime,
  case when seq % 17 <> 0 then stime_us end as stime_us from fx_a"""
SQL["flow_json_scan"] = _A + "select stime_us as a_us, stcpb from fx_a where seq % 19 <> 0"
SQL["log_json_scan"] = _Z + """select case when ts_us % 23 <> 0 then ts_us end as z_us,
  case when ts_us % 23 <> 0 then length(cast(ts_us // 1000000 as varchar)) + 15 else 7 end as chars from fx_z"""
SQL["labelled_csv_scan"] = _A + """select stcpb, saddr as srcip, dport as dsport, dur, label, attack_cat,
  cast(null as varchar) as service from fx_a"""
SQL["replaced_header_scan"] = _A + "select proto, stcpb, label from fx_a where (seq // 4) % 9 <> 0"
SQL["csv_sink"] = _A + "select seq, proto as protocol, sbytes, attack_cat from fx_a"
SQL["range_file_load"] = _A + "select distinct 'gcloud' as provider, concat(saddr, '/32') as cidr from fx_a"
SQL["category_files"] = _A + """select state as value,
  cast(row_number() over (order by count(*) desc, state) - 1 as double) as index from fx_a group by state"""
SQL["required_columns"] = _A + "select seq, proto, dur from fx_a"
SQL["port_alias"] = _A + "select seq, dport from fx_a"
SQL["list_service"] = _Z + "select ts_us, orig_h, service from fx_z where zeek_log = 'conn'"
SQL["seeded_sort"] = _A + "select seq from fx_a"
SQL["micro_batches"] = _A + """select count(*) as rows, cast(sum(stcpb) as bigint) as stcpb from fx_a
  group by (seq // 4) % 4"""
SQL["model_features"] = _A + """,
p as (select proto as v, cast(row_number() over (order by count(*) desc, proto) - 1 as double) as i from fx_a group by 1),
t as (select state as v, cast(row_number() over (order by count(*) desc, state) - 1 as double) as i from fx_a group by 1)
select seq, cast(label as double) as target, p.i as proto_index, t.i as state_index, cast(41 as bigint) as width,
  cast(cast(dur as float) as double) as dur from fx_a join p on p.v = proto join t on t.v = state"""
SQL["forest_checks"] = _A + f"""select count(*) as test_rows, cast(sum(label) as bigint) as attacks, true as in_range,
  true as by_majority, true as same_after_load, cast(41 as bigint) as features, true as not_below_majority
from fx_a where cast(concat('0x', substr({_HASH}, 1, 8)) as bigint) >= 3435973836"""
