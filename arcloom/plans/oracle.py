"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

LINKS = """links as (
    select event_id + 1 as id, user_id + 1 as source,
           cast(json_extract_string(props, '$.k') as bigint) + 1 as target
    from events
)"""

UPDATES = """updates as (
    select o_orderkey + 1 as id, o_custkey + 1 as source, o_orderkey + 1 as target from orders
)"""

DELETES = "deletes as (select distinct l_orderkey + 1 as id from lineitem)"


def _patterns(mask: str) -> str:
    return f"""masked as (
    select c_custkey, c_nationkey, {mask} as mask from customer
), patterns as (
    select c_custkey as pid,
           case when mask & 1 <> 0 then id end as p_id,
           case when mask & 2 <> 0 then source end as p_source,
           case when mask & 4 <> 0
                then target + case when c_nationkey % 5 < 2 then 1000 else 0 end end as p_target
    from masked join links on id = c_custkey + 1
)"""


SOME_BOUND = _patterns("c_custkey % 7 + 1")
ANY_MASK = _patterns("c_custkey % 8")

MATCHES = """(p_id is null or p_id = id) and (p_source is null or p_source = source)
    and (p_target is null or p_target = target)"""


def _fates(base: bool) -> str:
    loads = (
        """ union all
    select -1, 'load', id, source, target from links where id in (select user_id + 1 from events)"""
        if base
        else ""
    )
    return f"""commands as (
    select event_id as seq,
           case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as op,
           user_id + 1 as id,
           case when event_type not in ('signup', 'error')
                then cast(json_extract_string(props, '$.k') as bigint) end as source,
           case when event_type not in ('signup', 'error') then event_id end as target
    from events{loads}
), existing as (
    select *, coalesce(last_value(case when op in ('create', 'load') then 1 when op = 'delete' then 0 end
                                  ignore nulls)
        over (partition by id order by seq rows between unbounded preceding and 1 preceding), 0) as ex
    from commands
), judged as (
    select *, case when op in ('create', 'load') and ex = 1 then 'already_exists'
                   when op in ('update', 'delete') and ex = 0 then 'not_exists'
                   else 'applied' end as status
    from existing
), stored as (
    select *, case when status = 'applied' and op = 'create' then id
                   when status = 'applied' and op in ('update', 'load') then source end as new_s,
              case when status = 'applied' and op = 'create' then id
                   when status = 'applied' and op in ('update', 'load') then target end as new_t
    from judged
), fates as (
    select seq, op, id, status, new_s, new_t,
           last_value(new_s ignore nulls) over prev as old_s,
           last_value(new_t ignore nulls) over prev as old_t
    from stored
    window prev as (partition by id order by seq rows between unbounded preceding and 1 preceding)
)"""


FEED = """select seq, id, op,
       case when op in ('update', 'delete') then old_s else 0 end as before_source,
       case when op in ('update', 'delete') then old_t else 0 end as before_target,
       case when op = 'delete' then 0 else new_s end as after_source,
       case when op = 'delete' then 0 else new_t end as after_target
from fates where status = 'applied' and op <> 'load'"""

STATE = """last_applied as (
    select *, row_number() over (partition by id order by seq desc) as rn
    from fates where status = 'applied'
)"""

CURRENT = (
    f"with {_fates(False)}, {STATE} "
    "select id, new_s as source, new_t as target from last_applied where rn = 1 and op <> 'delete'"
)

CURRENT_ON_BASE = (
    f"with {LINKS}, {_fates(True)}, {STATE} "
    "select id, new_s as source, new_t as target from last_applied where rn = 1 and op <> 'delete' "
    "union all select * from links where id not in (select user_id + 1 from events)"
)

CHANGE_FEED = f"with {_fates(False)} {FEED}"

BENCH = """raw as (
    select event_id as line_no, event_type, event_id as dev, user_id % 8 as o,
           cast(json_extract_string(props, '$.k') as bigint) % 6 as b,
           cast(abs(floor(value * 1000)) as bigint) as base
    from events
), parsed as (
    select line_no, cast(0 as bigint) as pos,
           ['Create', 'Update', 'Delete', 'Each All', 'Each Identity', 'Each Concrete',
            'Each Outgoing', 'Each Incoming'][o + 1] as op,
           ['united_volatile', 'united_nonvolatile', 'split_volatile', 'split_nonvolatile',
            'remote_nontransaction', 'remote_transaction'][b + 1] as backend,
           case when b >= 4 then base * 1000 + 7 else base end as ns, dev
    from raw where event_type <> 'error' and not (o = 2 and b = 5)
)"""

BENCH_TABLE = f"""{BENCH}, figures as (
    select op, backend, arg_max(ns, line_no) as ns from parsed group by op, backend
), ops as (
    select unnest(range(0, 8)) as rank,
           unnest(['Create', 'Update', 'Delete', 'Each All', 'Each Identity', 'Each Concrete',
                   'Each Outgoing', 'Each Incoming']) as op
), wide as (
    select rank, ops.op,
           coalesce(max(ns) filter (where backend = 'united_volatile'), 0) as united_volatile,
           coalesce(max(ns) filter (where backend = 'united_nonvolatile'), 0) as united_nonvolatile,
           coalesce(max(ns) filter (where backend = 'split_volatile'), 0) as split_volatile,
           coalesce(max(ns) filter (where backend = 'split_nonvolatile'), 0) as split_nonvolatile,
           coalesce(max(ns) filter (where backend = 'remote_nontransaction'), 0) as remote_nontransaction,
           coalesce(max(ns) filter (where backend = 'remote_transaction'), 0) as remote_transaction
    from ops left join figures on ops.op = figures.op group by rank, ops.op
), best as (
    select *, least(nullif(remote_nontransaction, 0), nullif(remote_transaction, 0)) as best_remote
    from wide
)"""


def _annotated(name: str) -> str:
    return f"""case when {name} = 0 then 'N/A' when best_remote is null then cast({name} as varchar)
        else {name} || ' (' || printf('%.1f', best_remote / {name}) || 'x faster)' end as {name}"""


def _plain(name: str) -> str:
    return f"case when {name} = 0 then 'N/A' else cast({name} as varchar) end as {name}"


IN_PROCESS = ["united_volatile", "united_nonvolatile", "split_volatile", "split_nonvolatile"]
REMOTE = ["remote_nontransaction", "remote_transaction"]
HIGHEST = f"greatest({', '.join(IN_PROCESS + REMOTE)})"


def _visible(name: str) -> str:
    return f"""case when {name} > 0
        then greatest(cast({name} as double), cast(top as double) * cast(0.005 as double))
        else cast(0 as double) end as {name}"""


ORACLE = {
    "each_all": f"with {LINKS} select * from links",
    "each_identity": f"with {LINKS} select * from links where id = 77",
    "each_outgoing": f"with {LINKS} select * from links where source = 7",
    "each_incoming": f"with {LINKS} select * from links where target = 42",
    "each_concrete": f"with {LINKS} select * from links where source = 3 and target = 17",
    "each_mixed_masks": f"""with {LINKS}, one as (select * from links where id = 77)
        select cast(unnest([0, 1, 2, 4]) as bigint) as mask, id, source, target from one""",
    "get_links": f"""with {LINKS}
        select o_orderkey as request, o_orderkey + 1 as id, coalesce(source, 0) as source,
               coalesce(target, 0) as target, links.id is not null as found
        from orders left join links on links.id = o_orderkey + 1""",
    "each_until": f"""with {LINKS} select * from links where id <= coalesce(
        (select min(id) from links where target = 100 and source % 50 = 0), 9223372036854775807)""",
    "match_patterns": f"with {LINKS}, {SOME_BOUND} select pid, id, source, target from patterns join links on {MATCHES}",
    "count_all": f"with {LINKS} select count(*) as n from links",
    "count_by_pattern": f"with {LINKS} select count(*) as n from links where source = 7",
    "count_patterns": f"""with {LINKS}, {ANY_MASK}
        select pid, count(id) as n from patterns left join links on {MATCHES} group by pid""",
    "max_id": f"with {LINKS} select coalesce(max(id), 0) as max_id from links",
    "out_degree": f"with {LINKS} select source, count(*) as n from links group by source",
    "in_degree": f"with {LINKS} select target, count(*) as n from links group by target",
    "out_degree_kept_up": f"select source, count(*) as n from ({CURRENT_ON_BASE}) group by source",
    "pattern_lengths": f"""with {LINKS}, {SOME_BOUND}
        select pid, case when pid % 6 between 1 and 4 then p_id end as p_id,
               case when pid % 6 between 2 and 4 then p_source end as p_source,
               case when pid % 6 between 3 and 4 then p_target end as p_target,
               pid % 6 in (0, 1, 3) as ok from patterns""",
    "pair_multiplicity": f"with {LINKS} select source, target, count(*) as n from links group by source, target",
    "create_empty": """select o_orderkey + 1 as id, cast(0 as bigint) as source,
        cast(0 as bigint) as target from orders""",
    "create_points": """select o_orderkey + 1 as id, o_orderkey + 1 as source,
        o_orderkey + 1 as target from orders""",
    "create_feed": """select o_orderkey + 1 as id, 'create' as op, cast(0 as bigint) as before_source,
        cast(0 as bigint) as before_target, o_orderkey + 1 as after_source,
        o_orderkey + 1 as after_target from orders""",
    "taken_ids": f"""with {LINKS} select o_orderkey + 1 as id,
        o_orderkey + 1 in (select id from links) as taken from orders""",
    "bulk_update": f"""with {LINKS}, {UPDATES}
        select links.id, coalesce(updates.source, links.source) as source,
               coalesce(updates.target, links.target) as target
        from links left join updates on links.id = updates.id""",
    "update_feed": f"""with {LINKS}, {UPDATES}
        select links.id, 'update' as op, links.source as before_source, links.target as before_target,
               updates.source as after_source, updates.target as after_target
        from links join updates on links.id = updates.id""",
    "update_rejects": f"""with {LINKS}, {UPDATES}
        select id, 'update' as op, 'not_exists' as status from updates
        where id not in (select id from links)""",
    "bulk_delete": f"with {LINKS}, {DELETES} select * from links where id not in (select id from deletes)",
    "delete_feed": f"""with {LINKS}, {DELETES}
        select id, 'delete' as op, source as before_source, target as before_target,
               cast(0 as bigint) as after_source, cast(0 as bigint) as after_target
        from links where id in (select id from deletes)""",
    "delete_rejects": f"""with {LINKS}, {DELETES}
        select id, 'delete' as op, 'not_exists' as status from deletes
        where id not in (select id from links)""",
    "duplicate_ids": f"""with {LINKS}
        select id, count(*) as n
        from (select id from links union all select o_orderkey + 1 from orders) group by id
        having count(*) > 1""",
    "allocate_ids": """select row_number() over (order by source, target) as id, source, target
        from (select distinct l_partkey + 1 as source, l_suppkey + 1 as target from lineitem)""",
    "free_ids": f"""with {LINKS}, {DELETES},
        kept as (select id from links where id not in (select id from deletes))
        select id from range(1, (select max(id) + 1 from kept)) as r(id)
        where id not in (select id from kept)""",
    "change_feed": CHANGE_FEED,
    "change_feed_on_base": f"with {LINKS}, {_fates(True)} {FEED}",
    "command_rejects": f"with {_fates(False)} select seq, id, op, status from fates where status <> 'applied'",
    "command_status": f"""with {_fates(False)}
        select op, status, count(*) as n from fates group by op, status""",
    "current_links": CURRENT,
    "current_links_on_base": CURRENT_ON_BASE,
    "clustered_outgoing": f"with {LINKS} select * from links where source = 7",
    "clustered_incoming": f"with {LINKS} select * from links where target = 42",
    "snapshot_links": f"with {LINKS} select * from links",
    "snapshot_apply": CURRENT_ON_BASE,
    "format_outgoing": f"with {LINKS} select * from links where source = 7",
    "format_incoming": f"with {LINKS} select * from links where target = 42",
    "format_concrete": f"with {LINKS} select * from links where source = 3 and target = 17",
    "ranged_identity": f"with {LINKS} select * from links where id = 77",
    "ranged_apply": CURRENT_ON_BASE,
    "ranged_index": f"""with {LINKS}, after_log as ({CURRENT_ON_BASE}),
        touched as (select distinct (user_id + 1) // 4096 as range from events)
        select cast(1 as bigint) as version, id // 4096 as range, cast(1 as bigint) as written, count(*) as n
        from links group by all
        union all
        select 2, id // 4096, case when id // 4096 in (select range from touched) then 2 else 1 end, count(*)
        from after_log group by all""",
    "empty_snapshot_next_id": f"""with {LINKS}
        select cast(1 as bigint) as version, count(*) as n_links, max(id) + 1 as next_id from links
        union all select 2, 0, 1""",
    "decode_documents": f"""with {LINKS}
        select id // 100 as doc_id, id, source, target from links where (id // 100) % 10 <> 0""",
    "document_rejects": f"""with {LINKS}
        select distinct id // 100 as doc_id, 'failed' as status, 'try ' || (id // 100) as message
        from links where (id // 100) % 10 = 0""",
    "bench_parse": f"with {BENCH} select line_no, pos, op, backend, ns, dev from parsed",
    "bench_failures": f"""with {BENCH}
        select line_no, 'thread ''main'' panicked at ''NotExists''' as line from raw where o = 2 and b = 5""",
    "bench_pivot": f"with {BENCH_TABLE} select * from wide",
    "bench_speedup": f"""with {BENCH_TABLE} select rank, op,
        {', '.join(_annotated(n) for n in IN_PROCESS)}, {', '.join(_plain(n) for n in REMOTE)} from best""",
    "bench_best_remote": f"with {BENCH_TABLE} select op, best_remote from best",
    "bench_highest": f"with {BENCH_TABLE} select max({HIGHEST}) as highest from wide",
    "bench_visible": f"""with {BENCH_TABLE}, top as (select max({HIGHEST}) as top from wide)
        select rank, op, {', '.join(_visible(n) for n in IN_PROCESS + REMOTE)} from wide, top""",
    "bench_missing": f"""with {BENCH_TABLE},
        backends as (select unnest(['united_volatile', 'united_nonvolatile', 'split_volatile',
            'split_nonvolatile', 'remote_nontransaction', 'remote_transaction']) as backend)
        select ops.op, backends.backend from ops, backends
        where not exists (select 1 from figures f
                          where f.op = ops.op and f.backend = backends.backend)""",
    "stream_change_feed": CHANGE_FEED,
    "stream_stateful_feed": CHANGE_FEED,
    "stream_links": CURRENT,
}
ORACLE["match_patterns_shuffled"] = ORACLE["match_patterns"]
ORACLE["count_patterns_shuffled"] = ORACLE["count_patterns"]
ORACLE["change_feed_split"] = CHANGE_FEED
ORACLE["stream_folded_feed"] = CHANGE_FEED
ORACLE["clustered_identity"] = ORACLE["each_identity"]
ORACLE["clustered_concrete"] = ORACLE["each_concrete"]
ORACLE["clustered_count"] = ORACLE["count_by_pattern"]
ORACLE["stream_compacted_links"] = CURRENT
ORACLE["store_add"] = f"""with {LINKS}, top as (select max(id) as top from links), fresh as (
        select distinct l_partkey + 1 as source, l_suppkey + 1 as target from lineitem)
    select id, source, target from links, top where id < top union all
    select top + row_number() over (order by source, target), source, target from fresh, top"""
ORACLE["free_id_ranges"] = f"""with {LINKS}, {DELETES},
    kept as (select id from links where id not in (select id from deletes)),
    pairs as (select coalesce(lag(id) over (order by id), 0) as low, id as high from kept)
    select low + 1 as "first", high - 1 as "last" from pairs where high - low > 1"""
ORACLE["free_id_ranges_mapped"] = ORACLE["free_id_ranges"]
ORACLE["free_id_ranges_kept_up"] = f"""with kept as ({CURRENT_ON_BASE}),
    pairs as (select coalesce(lag(id) over (order by id), 0) as low, id as high from kept)
    select low + 1 as "first", high - 1 as "last" from pairs where high - low > 1"""
for _end in ("outgoing", "incoming", "concrete"):
    ORACLE[f"curve_{_end}"] = ORACLE[f"each_{_end}"]
ORACLE["document_numbers"] = f"""with {LINKS}
    select source as doc_id,
           case when source % 3 = 0 or source % 5 = 0 or source % 7 = 0 then 0 else count(*) end as n
    from links where source % 11 <> 0 group by source"""
ORACLE["bench_log_text"] = f"with {BENCH} select op, backend, ns, dev from parsed"
ORACLE["stream_late_commands"] = f"""with {_fates(False)}
    select cast(0 as bigint) as v, status, count(*) as n from fates group by status
    union all select 1, 'late', count(*) from fates"""
_LABELS = ["Operation", *(f"Local {n}" for n in ("United Volatile", "United NonVolatile", "Split Volatile", "Split NonVolatile")),
           "Remote NonTransaction", "Remote Transaction"]
_WIDTHS = [13, *map(len, _LABELS[1:])]
ORACLE["bench_report"] = f"""with said as ({ORACLE["bench_speedup"]})
    select cast(0 as bigint) as n, '| {" | ".join(c.ljust(w) for c, w in zip(_LABELS, _WIDTHS))} |' as line
    union all select 1, '|{"|".join("-" * (w + 2) for w in _WIDTHS)}|'
    union all select rank + 2, '| ' || {" || ' | ' || ".join(
        f"rpad({c}, cast(greatest(length({c}), {w}) as int), ' ')" for c, w in zip(["op", *IN_PROCESS, *REMOTE], _WIDTHS))} || ' |' from said"""
