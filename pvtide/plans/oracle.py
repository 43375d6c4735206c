"""SQL twins of the registered queries, run by DuckDB on the driver's
tables. Written independently of the Spark plans (joins where Spark
aggregates, window functions where Spark offsets partitions), so a match
checks the plan as well as the values."""

from __future__ import annotations

from pvtide.functions.spherecells import FACES, edge_of, turn_of

# Fixture views of pvtide.sources.fixtures, as CTE bodies.
_VIEWS = {
    "readings": """select user_id as ss_id, ts as datetime_GMT, value as generation_Wh from events""",
    "readings_long": """select l_partkey as ss_id, l_shipdate as datetime_GMT,
        l_extendedprice as generation_Wh, l_orderkey, l_linenumber from lineitem""",
    "readings_gaps": """select l_partkey as ss_id, l_shipdate as datetime_GMT,
        case when (l_orderkey * 7 + l_linenumber) % 11 = 0 then null
             when (l_orderkey * 7 + l_linenumber) % 13 = 0 then cast('nan' as double)
             else l_extendedprice end as generation_Wh from lineitem""",
    "capacity": """select p_partkey as ss_id, cast(p_size as double) as kWp from part""",
    "site": """select c_custkey,
        50e0 + ((c_custkey * 37) % 1000) / 100e0 as latitude_rounded,
        -6e0 + ((c_custkey * 73) % 800) / 100e0 as longitude_rounded,
        cast((c_custkey * 11) % 360 as double) as orientation,
        cast((c_custkey * 7) % 91 as double) as tilt,
        ((c_custkey * 13) % 2600) / 10e0 as kWp from customer""",
    "metadata_raw": """select c.c_custkey as ss_id, c.c_nationkey as owner_id, c.c_name as owner_name,
        c.c_mktsegment as system_id, s.latitude_rounded, s.longitude_rounded, s.orientation, s.tilt, s.kWp
        from customer c join site s on s.c_custkey = c.c_custkey""",
    "metadata_old": """select s.c_custkey as ss_id, min(o.o_orderdate) as start_datetime_GMT,
        max(o.o_orderdate) as end_datetime_GMT, any_value(s.latitude_rounded) as latitude_rounded,
        any_value(s.longitude_rounded) as longitude_rounded, any_value(s.orientation) as orientation,
        any_value(s.tilt) as tilt, any_value(s.kWp) as kWp
        from site s left join (select * from orders where o_orderdate < date '1999-01-01') o
          on s.c_custkey = o.o_custkey group by s.c_custkey""",
    "readings_new": """select o_custkey as ss_id, o_orderdate as datetime_GMT from orders
        where o_orderdate >= date '1999-01-01'""",
    # P1 output: 48 slots per (day, system) that has readings; slot k is the
    # sum of the k-th half hour (left-closed), labelled at its end.
    "halfhour": """select cast(g.ss_id as integer) as ss_id,
        g.day + (k.k * 30) * interval 1 minute as datetime_GMT,
        cast(s.e as float) as generation_Wh
        from (select distinct cast(cast(datetime_GMT as date) as timestamp) as day, ss_id from readings) g
        cross join (select range as k from range(1, 49)) k
        left join (select cast(cast(datetime_GMT as date) as timestamp) as day, ss_id,
                          cast(floor((hour(datetime_GMT) * 60 + minute(datetime_GMT)) / 30) as integer) + 1 as k,
                          sum(generation_Wh) as e
                   from readings group by all) s
          on s.day = g.day and s.ss_id = g.ss_id and s.k = k.k""",
    "halfhour_nn": """select * from halfhour where generation_Wh is not null""",
    # Right-closed 30-minute windows labelled at their end.
    "resampled": """select ss_id,
        time_bucket(interval 30 minutes, datetime_GMT - interval 1 microsecond) + interval 30 minutes as datetime_GMT,
        avg(generation_Wh * 12e0) as power_W from readings group by all""",
    "sample_windows": """select ss_id, draw, ws as window_start, ws + interval 7 days as window_end from (
          select ss_id, draw, cs + ((cast('0x' || substr(md5(concat_ws(':', ss_id, draw, 42)), 1, 15) as bigint) % n)
                                    * 30) * interval 1 minute as ws from (
            select ss_id, cs, cast(floor((epoch_us(ce) - epoch_us(cs)) / 1800000000e0) as bigint) as n from (
              select ab.ss_id, greatest(ab.s, b.lo) as cs, least(ab.e, b.hi) as ce
              from (select ss_id, min(datetime_GMT) as s, max(datetime_GMT) as e from readings group by ss_id) ab,
                   (select min(datetime_GMT) as lo, max(datetime_GMT) as hi from readings) b
              where ab.s < b.hi and ab.e > b.lo)
            where ce - cs > interval 7 days), (values (0), (1)) d(draw)
          where n > 0)""",
    "sample_windows_long": """select ss_id, draw, ws as window_start, ws + interval 7 days as window_end from (
          select ss_id, draw, cs + ((cast('0x' || substr(md5(concat_ws(':', ss_id, draw, 42)), 1, 15) as bigint) % n)
                                    * 30) * interval 1 minute as ws from (
            select ss_id, cs, cast(floor((epoch_us(ce) - epoch_us(cs)) / 1800000000e0) as bigint) as n from (
              select ab.ss_id, greatest(ab.s, b.lo) as cs, least(ab.e, b.hi) as ce
              from (select ss_id, min(datetime_GMT) as s, max(datetime_GMT) as e from readings_long group by ss_id) ab,
                   (select min(datetime_GMT) as lo, max(datetime_GMT) as hi from readings_long) b
              where ab.s < b.hi and ab.e > b.lo)
            where ce - cs > interval 7 days), (values (0), (1)) d(draw)
          where n > 0)""",
}

# Which views each query needs, in dependency order.
_DEPS = {
    "readings": [], "readings_long": [], "readings_gaps": [], "capacity": [], "site": [],
    "metadata_raw": ["site"], "metadata_old": ["site"], "readings_new": [],
    "halfhour": ["readings"], "halfhour_nn": ["halfhour"], "resampled": ["readings"],
    "sample_windows": ["readings"], "sample_windows_long": ["readings_long"],
}


def _with(*names: str) -> str:
    order: list[str] = []

    def visit(n):
        for d in _DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({_VIEWS[n]})" for n in order) + "\n"


# The reference's capacity bin edges.
_HIST_EDGES = [0, 1, 2, 3, 4, 10, 50, 100, 150, 200, 250]


def _hist_values() -> str:
    rows = []
    for i, (lo, hi) in enumerate(zip(_HIST_EDGES, _HIST_EDGES[1:])):
        label = f"{'[' if i == 0 else '('}{float(lo)}, {float(hi)}]"
        rows.append(f"({i}, {float(lo)}e0, {float(hi)}e0, '{label}')")
    return ", ".join(rows)


_COMPARED = _with("readings", "resampled", "halfhour_nn") + """,
        a as (select ss_id, datetime_GMT, generation_Wh * 12e0 as v from readings),
        c as (select ss_id, datetime_GMT, cast(generation_Wh as double) * 2e0 as v from halfhour_nn),
        j as (select ss_id, datetime_GMT, a.v as fine, resampled.power_W as res, c.v as coarse
              from a full outer join resampled using (ss_id, datetime_GMT)
                     full outer join c using (ss_id, datetime_GMT)),
        l as (select ss_id, datetime_GMT, '5 minutely' as source, fine as power_W from j
              union all select ss_id, datetime_GMT, '5 minutely resampled to 30 minutes', res from j
              union all select ss_id, datetime_GMT, '30 minutely', coarse from j)
        select ss_id, datetime_GMT, source, round(power_W, 6) as power_W from l
        where hour(datetime_GMT) between 5 and 21 and (power_W is null or not isnan(power_W))"""

_EXACT_MONTHS = _with("readings_gaps") + """
        select ss_id, datetime_GMT, generation_Wh,
          cast(year(datetime_GMT) as smallint) as year, cast(month(datetime_GMT) as tinyint) as month
        from readings_gaps where generation_Wh is null or not isnan(generation_Wh)"""

# The matrix in blocks of 100 ids: one constant column per place.
_BLOCKS = ",\n".join(f"max(case when ss_id % 100 = {i} then generation_Wh end) as c{i:02d}" for i in range(100))
_WIDE = _with("halfhour_nn") + f"""
        select datetime_GMT, cast(floor(ss_id / 100) as bigint) as id_block, {_BLOCKS} {{extra}}
        from halfhour_nn group by datetime_GMT, floor(ss_id / 100)"""

_NARROW = """select cast(l_partkey as integer) as ss_id, l_shipdate as datetime_GMT,
          cast(l_extendedprice as float) as generation_Wh from lineitem"""

def _nearest_hexagon(source: str, resolution: int, keep: str) -> str:
    """(keep, f, q, r) of the hexagon whose centre is nearest to x, y: the
    nine around the place are measured, in the turned tiling."""
    e, (c, s) = repr(edge_of(resolution)), map(repr, turn_of(resolution))
    return f"""select {keep}, f, arg_min(q, d) as q, arg_min(r, d) as r from (
          select *, pow(u - sqrt(3e0) * {e} * (q + r / 2e0), 2) + pow(w - 1.5e0 * {e} * r, 2) as d from (
            select *, round(u / (sqrt(3e0) * {e}) - r / 2e0) + dq as q from (
              select *, round(w / (1.5e0 * {e})) + dr as r from (
                select *, x * {c} + y * {s} as u, y * {c} - x * {s} as w from {source}), (values (-1), (0), (1)) a(dr)),
              (values (-1), (0), (1)) b(dq))) group by {keep}, f, x, y"""


def _cell_id(resolution: int) -> str:
    return (f"(({resolution} * 20 + f) * 67108864::bigint + cast(q as bigint) + 33554432) * 67108864::bigint"
            " + cast(r as bigint) + 33554432")


def _hexagon_centre(resolution: int) -> str:
    e, (c, s) = repr(edge_of(resolution)), map(repr, turn_of(resolution))
    u, w = f"(sqrt(3e0) * {e} * (q + r / 2e0))", f"(1.5e0 * {e} * r)"
    return f"{u} * {c} - {w} * {s} as x, {u} * {s} + {w} * {c} as y"


# The faces' centres and directions are fixed values that both sides share.
_FACE_ROWS = ", ".join(f"({i}, {', '.join(repr(v) for part in face for v in part)})" for i, face in enumerate(FACES))
_SPHERE_DENSITY = _with("metadata_raw") + f""",
        faces(f, c0, c1, c2, a0, a1, a2, b0, b1, b2) as (values {_FACE_ROWS}),
        places as (select ss_id, cos(radians(latitude_rounded)) * cos(radians(longitude_rounded)) as px,
                     cos(radians(latitude_rounded)) * sin(radians(longitude_rounded)) as py,
                     sin(radians(latitude_rounded)) as pz from metadata_raw
                   where latitude_rounded is not null and longitude_rounded is not null),
        met as (select *, px * c0 + py * c1 + pz * c2 as d from places, faces),
        mapped as (select ss_id, f, (px * a0 + py * a1 + pz * a2) * sqrt(2e0 / (1e0 + d)) as x,
                     (px * b0 + py * b1 + pz * b2) * sqrt(2e0 / (1e0 + d)) as y
                   from met m where d = (select max(d) from met n where n.ss_id = m.ss_id)),
        h5 as ({_nearest_hexagon("mapped", 5, "ss_id")}),
        h4 as ({_nearest_hexagon(f"(select ss_id, f, {_hexagon_centre(5)} from h5)", 4, "ss_id")}),
        h3 as ({_nearest_hexagon(f"(select ss_id, f, {_hexagon_centre(4)} from h4)", 3, "ss_id")}),
        cells as (select 5 as resolution, {_cell_id(5)} as cell from h5
                  union all select 4, {_cell_id(4)} from h4 union all select 3, {_cell_id(3)} from h3)
        select resolution, cell, cast(count(*) as bigint) as n_systems from cells group by all"""

ORACLE_SQL: dict[str, str] = {
    "activity_bounds": _with("readings_long") + """
        select ss_id, min(datetime_GMT) as start_datetime_GMT, max(datetime_GMT) as end_datetime_GMT
        from readings_long group by ss_id""",

    "metadata_merge": _with("metadata_old", "readings_new") + """,
        nb as (select ss_id, min(datetime_GMT) as ns, max(datetime_GMT) as ne from readings_new group by ss_id)
        select m.ss_id, coalesce(m.start_datetime_GMT, nb.ns) as start_datetime_GMT,
          case when m.end_datetime_GMT is null or m.end_datetime_GMT < nb.ne then nb.ne
               else m.end_datetime_GMT end as end_datetime_GMT,
          m.latitude_rounded, m.longitude_rounded, m.orientation, m.tilt, m.kWp
        from metadata_old m left join nb on m.ss_id = nb.ss_id""",

    "metadata_refresh": _with("metadata_raw", "metadata_old", "readings") + """
        select cast(n.ss_id as bigint) as ss_id, o.start_datetime_GMT, o.end_datetime_GMT,
          cast(n.latitude_rounded as float) as latitude_rounded,
          cast(n.longitude_rounded as float) as longitude_rounded,
          cast(n.orientation as float) as orientation, cast(n.tilt as float) as tilt,
          cast(n.kWp as float) as kWp
        from metadata_raw n left join metadata_old o on n.ss_id = o.ss_id
        where n.ss_id in (select ss_id from readings)""",

    "ids_missing": _with("readings_long", "metadata_raw") + """
        select distinct ss_id from readings_long
        where ss_id not in (select ss_id from metadata_raw)""",

    "id_overlap_counts": _with("readings_long", "metadata_raw") + """
        select count(*) as n_ids_with_readings, count(m.ss_id) as n_ids_in_metadata
        from (select distinct ss_id from readings_long) r
        left join (select distinct ss_id from metadata_raw) m on r.ss_id = m.ss_id""",

    "wide_to_tall": _with("halfhour") + """
        select ss_id, datetime_GMT, generation_Wh from halfhour""",

    "dedup_readings": _with("readings_long") + """
        select ss_id, datetime_GMT, generation_Wh from (
          select *, row_number() over (partition by ss_id, datetime_GMT
                                       order by l_orderkey, l_linenumber) as rn
          from readings_long) where rn = 1""",

    "resample_right_closed": _with("resampled") + """
        select ss_id, datetime_GMT, round(power_W, 6) as power_W from resampled""",

    "compare_resolutions": _COMPARED,

    "capacity_outliers_lt": _with("readings_long", "capacity") + """
        select cast(row_number() over (order by r.ss_id, r.datetime_GMT, r.generation_Wh) - 1 as bigint) as index,
          r.ss_id, r.datetime_GMT, r.generation_Wh, c.kWp
        from readings_long r left join capacity c on r.ss_id = c.ss_id
        where r.generation_Wh < c.kWp * 750""",

    "capacity_outliers_gt": _with("readings_long", "capacity") + """
        select cast(row_number() over (order by r.ss_id, r.datetime_GMT, r.generation_Wh) - 1 as bigint) as index,
          r.ss_id, r.datetime_GMT, r.generation_Wh, c.kWp
        from readings_long r left join capacity c on r.ss_id = c.ss_id
        where r.generation_Wh > c.kWp * 750""",

    "compare_resolutions_day": _COMPARED + """
          and cast(datetime_GMT as date) = date '2024-01-15'""",

    "remove_implausible": _with("readings_gaps") + """
        select ss_id, datetime_GMT, generation_Wh,
          cast(year(datetime_GMT) as smallint) as year, cast(month(datetime_GMT) as tinyint) as month
        from readings_gaps where generation_Wh < 100000 and not isnan(generation_Wh)""",

    "exact_months": _EXACT_MONTHS,
    "exact_months_repair": _EXACT_MONTHS,

    "capacity_histogram": _with("metadata_raw") + f""",
        edges(bin_index, lower_edge, upper_edge, bin_edges) as (values {_hist_values()})
        select cast(e.bin_index as integer) as bin_index, e.bin_edges, e.lower_edge, e.upper_edge,
          count(m.kWp) as count
        from edges e left join metadata_raw m
          on (m.kWp > e.lower_edge or (e.bin_index = 0 and m.kWp >= e.lower_edge))
             and m.kWp <= e.upper_edge
        group by e.bin_index, e.bin_edges, e.lower_edge, e.upper_edge""",

    "hex_density": _with("metadata_raw") + """,
        xy as (select longitude_rounded * cos(radians(55e0)) * 111.32e0 as x,
                      latitude_rounded * 110.57e0 as y from metadata_raw
               where latitude_rounded is not null and longitude_rounded is not null),
        qr as (select (sqrt(3e0) / 3e0 * x - y / 3e0) / 9.85e0 as q, (y * 2e0 / 3e0) / 9.85e0 as r from xy),
        rd as (select q, r, floor(q + 0.5e0) as rq, floor(r + 0.5e0) as rr, floor(-q - r + 0.5e0) as rs from qr),
        df as (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs + q + r) as ds from rd)
        select cast(case when dq > ds and dq > dr then -rs - rr else rq end as bigint) as cell_q,
               cast(case when dq > ds and dq > dr then rr when ds > dr then rr else -rq - rs end as bigint) as cell_r,
               count(*) as n_systems
        from df group by all""",

    "sample_windows": _with("sample_windows") + """
        select ss_id, draw, window_start, window_end from sample_windows""",

    "sample_systems": _with("readings") + """
        select ss_id from (select distinct ss_id from readings)
        order by md5(concat_ws(':', ss_id, 0, 42)), ss_id limit 50""",

    "sample_fetch": _with("readings", "sample_windows") + """
        select r.ss_id, r.datetime_GMT, r.generation_Wh, w.window_start, w.window_end
        from readings r join sample_windows w
          on r.ss_id = w.ss_id and r.datetime_GMT between w.window_start and w.window_end""",

    "outlier_context": _with("readings") + """,
        f as (select ss_id, min(datetime_GMT) as t from readings where generation_Wh > 400 group by ss_id),
        w as (select ss_id, t - hour(t) * interval 1 hour - interval 2 days as window_start from f)
        select r.ss_id, r.datetime_GMT, r.generation_Wh, w.window_start,
               w.window_start + interval 4 days as window_end
        from readings r join w on r.ss_id = w.ss_id
          and r.datetime_GMT between w.window_start and w.window_start + interval 4 days""",

    "pivot_systems": _WIDE.format(extra=""),

    "pivot_map": _with("halfhour_nn") + """
        select datetime_GMT, count(*) over (partition by datetime_GMT) as n_systems, ss_id, generation_Wh
        from halfhour_nn""",

    "max_excluding_point": _with("readings_long") + """
        select r.ss_id, max(case when not isnan(r.generation_Wh) then r.generation_Wh end) as max_generation_Wh
        from readings_long r
        where not exists (select 1 from readings_long b where b.generation_Wh >= 100000
                          and b.ss_id = r.ss_id and b.datetime_GMT = r.datetime_GMT)
        group by r.ss_id""",

    "month_spine": _with("readings_long") + """,
        b as (select min(datetime_GMT) as lo, max(datetime_GMT) as hi from readings_long),
        m as (select unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month)) as m from b)
        select cast(m as timestamp) as month_start, cast(year(m) as smallint) as year,
               cast(month(m) as tinyint) as month,
               cast(m - interval 1 month as timestamp) as prev_month_start,
               cast(m + interval 1 month as timestamp) as next_month_start
        from m""",

    "largest_systems": _with("metadata_raw") + """
        select * from metadata_raw order by kWp desc nulls first, ss_id limit 10""",

    "latest_readings": _with("readings_long") + """
        select ss_id, datetime_GMT, generation_Wh from readings_long
        order by datetime_GMT desc, ss_id desc, generation_Wh desc limit 5""",

    "month_layout_roundtrip": """
        select cast(l_partkey as integer) as ss_id, l_shipdate as datetime_GMT,
          cast(l_extendedprice as float) as generation_Wh,
          cast(year(l_shipdate) as smallint) as year, cast(month(l_shipdate) as tinyint) as month
        from lineitem""",

    "relayout_months": """
        select cast(year(l_shipdate) as smallint) as year, cast(month(l_shipdate) as tinyint) as month,
          count(*) as n_readings, min(l_shipdate) as first_reading, max(l_shipdate) as last_reading
        from lineitem group by all""",

    "earliest_readings": _with("readings_long") + """
        select ss_id, datetime_GMT, generation_Wh from readings_long
        order by datetime_GMT asc nulls first, ss_id asc nulls first, generation_Wh asc nulls first
        limit 5""",

    "readings_slice": _with("readings_long") + """
        select ss_id, datetime_GMT, generation_Wh from readings_long
        order by datetime_GMT asc nulls first, ss_id asc nulls first, generation_Wh asc nulls first
        limit 25 offset 1000""",

    "exact_months_bounded": _with("readings_gaps") + """
        select ss_id, datetime_GMT, generation_Wh,
          cast(year(datetime_GMT) as smallint) as year, cast(month(datetime_GMT) as tinyint) as month
        from readings_gaps
        where (generation_Wh is null or not isnan(generation_Wh))
          and datetime_GMT >= timestamp '1995-01-01 00:00:00' and datetime_GMT < timestamp '1997-01-01 00:00:00'""",

    "outlier_context_row": _with("readings_long", "capacity") + """,
        o as (select r.ss_id, r.datetime_GMT,
                     row_number() over (order by r.ss_id, r.datetime_GMT, r.generation_Wh) - 1 as idx
              from readings_long r join capacity c on r.ss_id = c.ss_id
              where r.generation_Wh > c.kWp * 750),
        f as (select ss_id, min(datetime_GMT) as t from o
              where ss_id in (select ss_id from o where idx = 7) group by ss_id),
        w as (select ss_id, t - hour(t) * interval 1 hour - interval 100 days as window_start from f)
        select r.ss_id, r.datetime_GMT, r.generation_Wh, w.window_start,
               w.window_start + interval 200 days as window_end
        from readings_long r join w on r.ss_id = w.ss_id
          and r.datetime_GMT between w.window_start and w.window_start + interval 200 days""",

    "wide_months_roundtrip": _WIDE.format(extra=", cast(null as float) as absent"),

    "layout_reads": f"""with r as ({_NARROW})
        select 'month' as how, ss_id, datetime_GMT, generation_Wh from r
        where year(datetime_GMT) = 1996 and month(datetime_GMT) = 2
        union all
        select 'folder', ss_id, datetime_GMT, generation_Wh from r
        where year(datetime_GMT) = 1996 and month(datetime_GMT) = 2
        union all
        select 'range', ss_id, datetime_GMT, generation_Wh from r
        where datetime_GMT between timestamp '1997-11-17 00:00:00' and timestamp '1998-02-03 00:00:00'
        union all
        select distinct 'ids', ss_id, cast(null as timestamp), cast(null as float) from r
        where year(datetime_GMT) = 1996""",

    "layout_overwrite_months": f"""with r as ({_NARROW}),
        k as (select *, cast(year(datetime_GMT) as smallint) as year, cast(month(datetime_GMT) as tinyint) as month
              from r)
        select ss_id, datetime_GMT,
          case when (year = 1996 and month = 3) or (year = 1997 and month = 12)
               then cast(cast(generation_Wh as double) / 2 as float) else generation_Wh end as generation_Wh,
          year, month from k""",

    "snapshot_versions": f"""with r as ({_NARROW}),
        k as (select *, cast(year(datetime_GMT) as smallint) as year, cast(month(datetime_GMT) as tinyint) as month
              from r)
        select ss_id, datetime_GMT, year, month, version,
          case when version = 2 and ((year = 1996 and month = 3) or (year = 1997 and month = 12))
               then cast(cast(generation_Wh as double) / 2 as float) else generation_Wh end as generation_Wh
        from k, (values (1), (2)) v(version)""",

    "sphere_density": _SPHERE_DENSITY,

    "capacity_quantile_bins": _with("metadata_raw") + """,
        sorted as (select kWp, row_number() over (order by kWp) as place, count(*) over () as n from metadata_raw),
        edges as (select distinct s.kWp as edge from sorted s, (select range as i from range(0, 11)) r
                  where s.place = greatest(1, cast(ceil(r.i * s.n / 10e0) as bigint))),
        bins as (select cast(row_number() over (order by edge) - 1 as integer) as bin_index, edge as lower_edge,
                        lead(edge) over (order by edge) as upper_edge from edges)
        select bin_index, lower_edge, upper_edge,
          (select count(*) from metadata_raw m where m.kWp <= b.upper_edge
             and (m.kWp > b.lower_edge or (b.bin_index = 0 and m.kWp = b.lower_edge))) as count
        from bins b where upper_edge is not null""",

    "rewrite_proof": _with("readings_gaps") + """,
        k as (select * from readings_gaps where generation_Wh is null
              or (not isnan(generation_Wh) and generation_Wh < 100000))
        select cast(year(datetime_GMT) as smallint) as year, cast(month(datetime_GMT) as tinyint) as month,
          count(*) as n_readings, count(generation_Wh) as n_values,
          (select count(*) from readings_gaps) as rows_in,
          (select count(*) from readings_gaps) - (select count(*) from k) as dropped,
          (select count(*) from k) as rows_out from k group by all""",

    "metadata_rejects": """
        select case c_custkey % 10 when 3 then 'does not parse: ss_id' when 5 then 'does not parse: start_datetime_GMT'
                    else 'good' end as reason,
          count(*) as n_lines,
          cast(coalesce(sum(case when c_custkey % 10 not in (3, 5) then c_custkey end), 0) as bigint) as sum_ids
        from customer group by all""",

    "dedup_stream": "select distinct l_partkey as ss_id, l_shipdate as datetime_GMT from lineitem",

    "align_streams": _with("readings", "resampled", "halfhour_nn") + """
        select coalesce(f.ss_id, cast(c.ss_id as bigint)) as ss_id, coalesce(f.datetime_GMT, c.datetime_GMT) as datetime_GMT,
          round(f.power_W, 6) as mean_W, cast(c.generation_Wh as double) as coarse_Wh
        from resampled f full outer join halfhour_nn c on f.ss_id = c.ss_id and f.datetime_GMT = c.datetime_GMT""",

    "bucketed_fetch": _with("readings_long") + """
        select r.ss_id, r.datetime_GMT, r.generation_Wh, o.o_orderdate as window_start,
          o.o_orderdate + interval 30 days as window_end
        from readings_long r join orders o on r.ss_id = o.o_custkey
          and r.datetime_GMT between o.o_orderdate and o.o_orderdate + interval 30 days""",

    "incremental_activity": f"""with r as ({_NARROW})
        select ss_id, min(datetime_GMT) as start_datetime_GMT, max(datetime_GMT) as end_datetime_GMT
        from r group by ss_id""",

    "incremental_id_counts": """
        select cast(year(l_shipdate) as smallint) as year, cast(month(l_shipdate) as tinyint) as month,
          count(distinct l_partkey) as n_ids from lineitem group by all""",

    "incremental_id_overlap": """
        select count(distinct l_partkey) as n_ids_with_readings,
          count(distinct l_partkey) filter (where l_partkey in (select c_custkey from customer)) as n_ids_in_metadata
        from lineitem""",

    "incremental_relayout": """
        select l_partkey as ss_id, l_shipdate as datetime_GMT, l_extendedprice as generation_Wh,
          cast(year(l_shipdate) as smallint) as year, cast(month(l_shipdate) as tinyint) as month
        from lineitem""",

    # Weeks are counted from the epoch.
    "incremental_resample": f"""with r as ({_NARROW})
        select ss_id, time_bucket(interval 7 days, datetime_GMT - interval 1 microsecond, timestamp '1970-01-01')
            + interval 7 days as datetime_GMT,
          round(avg(cast(generation_Wh as double)), 6) as generation_Wh from r group by all""",

    "zone_map": f"""with r as ({_NARROW})
        select cast(year(datetime_GMT) as smallint) as year, cast(month(datetime_GMT) as tinyint) as month,
          count(*) as n_readings, min(ss_id) as id_min, max(ss_id) as id_max,
          min(datetime_GMT) as ts_min, max(datetime_GMT) as ts_max from r group by all""",

    "zone_map_fetch": _with("sample_windows_long") + f""",
        r as ({_NARROW})
        select r.ss_id, r.datetime_GMT, w.window_start, w.window_end,
          case when (year(datetime_GMT) = 1996 and month(datetime_GMT) = 3)
                 or (year(datetime_GMT) = 1997 and month(datetime_GMT) = 12)
               then cast(cast(generation_Wh as double) / 2 as float) else generation_Wh end as generation_Wh
        from r join sample_windows_long w
          on r.ss_id = w.ss_id and r.datetime_GMT between w.window_start and w.window_end""",

    "relayout_rewrite": """
        select l_partkey as ss_id, l_shipdate as datetime_GMT, l_extendedprice as generation_Wh,
          cast(year(l_shipdate) as smallint) as year, cast(month(l_shipdate) as tinyint) as month
        from lineitem""",

    "system_bounds": _with("readings_long") + """
        select min(datetime_GMT) as min_datetime_GMT, max(datetime_GMT) as max_datetime_GMT
        from readings_long where ss_id = 42""",

    "new_metadata_inferred": _with("metadata_raw") + """
        select cast(ss_id as integer) as ss_id, cast(owner_id as integer) as owner_id, owner_name, system_id,
          latitude_rounded, longitude_rounded, orientation, tilt, kWp from metadata_raw""",

    "metadata_csv_roundtrip": _with("metadata_old", "readings_new") + """,
        nb as (select ss_id, min(datetime_GMT) as ns, max(datetime_GMT) as ne from readings_new group by ss_id)
        select m.ss_id, coalesce(m.start_datetime_GMT, nb.ns) as start_datetime_GMT,
          case when m.end_datetime_GMT is null or m.end_datetime_GMT < nb.ne then nb.ne
               else m.end_datetime_GMT end as end_datetime_GMT,
          m.latitude_rounded, m.longitude_rounded, m.orientation, m.tilt, m.kWp
        from metadata_old m left join nb on m.ss_id = nb.ss_id""",
}
ORACLE_SQL["metadata_sorted"] = ORACLE_SQL["metadata_merge"]
