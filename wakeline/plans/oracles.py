"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from wakeline.config import MMSI_RANGE
from wakeline.functions.geo import EARTH_RADIUS_M, KM_PER_DEGREE, KNOT_MS, WGS84_A, WGS84_E2
from wakeline.operators.evaluate import POISSON_1
from wakeline.plans.fixture import CONFIG, FIXES, RAW

C = CONFIG.context
LAT0, LON0 = CONFIG.region.origin
BOX = CONFIG.region.box


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * {EARTH_RADIUS_M} * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def ecef(lat: str, lon: str) -> tuple[str, str, str]:
    n = f"({WGS84_A}e0 / sqrt(1e0 - {WGS84_E2!r} * pow(sin(radians({lat})), 2)))"
    return f"({n} * cos(radians({lat})) * cos(radians({lon})))", f"({n} * cos(radians({lat})) * sin(radians({lon})))", f"({n} * (1e0 - {WGS84_E2!r}) * sin(radians({lat})))"


def enu(lat: str, lon: str, lat0: str = f"{LAT0}e0", lon0: str = f"{LON0}e0") -> tuple[str, str]:
    (x, y, z), (a, b, c) = ecef(lat, lon), ecef(lat0, lon0)
    o, p = f"radians({lon0})", f"radians({lat0})"
    east = f"(-sin({o}) * ({x} - {a}) + cos({o}) * ({y} - {b}))"
    return east, f"(-sin({p}) * cos({o}) * ({x} - {a}) - sin({p}) * sin({o}) * ({y} - {b}) + cos({p}) * ({z} - {c}))"


def cell(lat: str, lon: str, size: float) -> str:
    e, n = enu(lat, lon)
    return f"cast((floor({e} / {size}e0) + 50000) * 100000 + floor({n} / {size}e0) + 50000 as bigint)"


def edge(lat: str, lon: str) -> str:
    w = f"({KM_PER_DEGREE} * cos(radians({(BOX[0] + BOX[1]) / 2}e0)))"
    return f"least(({lat} - {BOX[0]}e0) * {KM_PER_DEGREE}, ({BOX[1]}e0 - {lat}) * {KM_PER_DEGREE}, ({lon} - ({BOX[2]}e0)) * {w}, ({BOX[3]}e0 - {lon}) * {w})"


def group(c: str = "vessel_type") -> str:
    return (
        f"case when {c} is null or {c} = 0 then 'unknown' when {c} between 70 and 79 or {c} in (1003, 1004, 1016) then 'cargo' when {c} between 80 and 89 or {c} in (1017, 1023, 1024) then 'tanker' "
        f"when {c} between 60 and 69 or {c} between 1012 and 1015 then 'passenger' when {c} in (21, 22, 31, 32, 52, 1025) then 'tug_tow' when {c} in (30, 1001, 1002) then 'fishing' when {c} in (36, 37, 1019) then 'pleasure' else 'other' end"
    )


BIN = "cast(floor(coalesce(cog_deg, 0) / 30e0) as integer) % 12"
W = "partition by mmsi order by us"
KNOT = f"{KNOT_MS!r}"
GOOD = f"mmsi is not null and us is not null and lat is not null and lon is not null and mmsi between {MMSI_RANGE[0]} and {MMSI_RANGE[1]} and (transceiver is null or transceiver in ('A', 'B'))"

STEPS: dict[str, str] = {
    "fixes": FIXES.replace("{US}", "epoch_us(ts)").replace("{EVENTS}", "events"),
    "raw": RAW,
    "clean0": f"select *, row_number() over (partition by mmsi, us order by _row) k from raw where {GOOD}",
    "clean1": f"select * exclude (k) replace (case when sog_kn <= {CONFIG.clean.max_sog_kn} then sog_kn end as sog_kn, case when cog_deg < 360 then cog_deg end as cog_deg, case when heading_deg < 360 then heading_deg end as heading_deg) from clean0 where k = 1",
    "clean2": f"""select *, {hav(f"lag(lat) over ({W})", f"lag(lon) over ({W})", "lat", "lon")} dist_prev_m, (us - lag(us) over ({W})) / 1e6 dt_prev_s,
       {hav(f"lead(lat) over ({W})", f"lead(lon) over ({W})", "lat", "lon")} dist_next_m, (lead(us) over ({W}) - us) / 1e6 dt_next_s from clean1""",
    "clean": f"select *, dist_prev_m / greatest(dt_prev_s, 1e0) / {KNOT} v_prev_kn, dist_next_m / greatest(dt_next_s, 1e0) / {KNOT} v_next_kn, coalesce(dist_prev_m / greatest(dt_prev_s, 1e0) / {KNOT} > {CONFIG.clean.max_implied_kn} and dist_next_m / greatest(dt_next_s, 1e0) / {KNOT} > {CONFIG.clean.max_implied_kn}, false) spike from clean2",
    "seg0": f"select *, case when us // 1000000 - lag(us // 1000000) over ({W}) > {CONFIG.segment.max_gap_min * 60} then 1 else 0 end g from clean",
    "seg1": f"select *, sum(g) over ({W} rows unbounded preceding) seg from seg0",
    "points": f"select * exclude (g, seg), mmsi || '-' || strftime(make_timestamp(min(us) over (partition by mmsi, seg)), '%Y%m%dT%H%M') voyage_id, {group()} vessel_group from seg1",
    "mode_type": "select voyage_id, vessel_type from (select *, row_number() over (partition by voyage_id order by n desc, vessel_type) k from (select voyage_id, vessel_type, count(*) n from points where vessel_type is not null group by 1, 2)) where k = 1",
    "mode_tr": "select voyage_id, transceiver from (select *, row_number() over (partition by voyage_id order by n desc, transceiver) k from (select voyage_id, transceiver, count(*) n from points where transceiver is not null group by 1, 2)) where k = 1",
    "voy0": """select p.voyage_id, min(mmsi) mmsi, any_value(a.vessel_type) vessel_type, median(length_m) length_m, any_value(b.transceiver) transceiver, min(us) start_us, max(us) end_us, count(*) n_points,
       avg(case when sog_kn > 1 then 1e0 when sog_kn is not null then 0e0 end) moving_frac, sum(coalesce(dist_prev_m, 0e0)) / 1000 path_km, cast(sum(cast(spike as integer)) as bigint) n_spikes
       from points p left join mode_type a using (voyage_id) left join mode_tr b using (voyage_id) group by p.voyage_id""",
    "voyages": f"select *, (end_us - start_us) // 1000000 / 60e0 duration_min, {group()} vessel_group, "
    + "case "
    + " ".join(f"when start_us >= epoch_us(timestamp '{lo}') and end_us < epoch_us(timestamp '{hi}' + interval 1 day) then '{n}'" for n, lo, hi in reversed(CONFIG.splits))
    + f" else 'none' end split, n_points >= {CONFIG.segment.min_points} and (end_us - start_us) // 1000000 / 60e0 >= {CONFIG.segment.min_duration_min} usable from voy0",
    # context grids
    "rec0": f"select lat, lon, lead(lat) over ({W}) lat2, lead(lon) over ({W}) lon2, sog_kn, lead(sog_kn) over ({W}) sog2, (lead(us) over ({W}) - us) / 1e6 dt from points",
    "reception": f"select {cell('((lat + lat2) / 2)', '((lon + lon2) / 2)', C.reception_cell_m)} cell, count(*) received, cast(sum(greatest(round_even(dt / {C.report_s}, 0) - 1, 0)) as bigint) missed from rec0 where dt <= {C.max_step_s} and sog_kn >= {C.moving_kn} and sog2 >= {C.moving_kn} group by 1",
    "still": f"select mmsi, {cell('lat', 'lon', C.port_cell_m)} cell, h from (select *, (lead(us) over ({W}) - us) / 3.6e9 h from points) where coalesce(sog_kn, 0) < {C.still_kn} and h <= {C.max_still_h}",
    "around": "select dx * 100000 + dy d from (select unnest([-1, 0, 1]) dx), (select unnest([-1, 0, 1]) dy)",
    "ports": f"select distinct cell + d as cell from (select cell from still group by cell having sum(h) >= {C.port_min_hours} and count(distinct mmsi) >= {C.port_min_vessels}), around",
    "homes": f"select distinct mmsi, cell + d as cell from (select mmsi, cell from still group by 1, 2 having sum(h) >= {C.home_min_hours}), around",
    "moving": f"select *, {cell('lat', 'lon', C.traffic_cell_m)} cell from points where sog_kn >= {C.moving_kn}",
    "traffic": "select cell, count(distinct voyage_id) voyages from moving group by cell",
    "hist0": f"select cell, {BIN} bin, count(*) n from moving where cog_deg is not null group by 1, 2",
    "courses": f"select t.cell, cast(b.bin as integer) bin, (coalesce(h.n, 0) + 0.5e0) / (t.n + 6e0) prob from (select cell, sum(n) n from hist0 group by cell having sum(n) >= {C.course_min_fixes}) t cross join (select unnest(range(0, 12)) bin) b left join hist0 h on h.cell = t.cell and h.bin = b.bin",
    # detectors
    "berth": f"select p.*, q.cell is not null port, h.cell is not null home from (select *, {cell('lat', 'lon', C.port_cell_m)} pc, {cell('lat', 'lon', C.reception_cell_m)} rc from points) p left join ports q on q.cell = p.pc left join homes h on h.cell = p.pc and h.mmsi = p.mmsi",
    "gap0": f"""select mmsi, vessel_group, us start_us, lead(us) over ({W}) end_us, lat lat0, lon lon0, lead(lat) over ({W}) lat1, lead(lon) over ({W}) lon1, coalesce(sog_kn, 0) s0, lead(coalesce(sog_kn, 0)) over ({W}) s1,
       port or home b0, lead(port or home) over ({W}) b1, rc r0, lead(rc) over ({W}) r1 from berth""",
    "gap1": f"select *, (end_us - start_us) // 1000000 / 60e0 m, {hav('lat0', 'lon0', 'lat1', 'lon1')} d from gap0 where end_us is not null",
    "gap2": f"select *, d / (m * 60) / {KNOT} implied from gap1 where m >= {CONFIG.gap.min_gap_min} and m <= {CONFIG.gap.max_gap_h * 60} and least(s0, s1) >= {CONFIG.gap.min_sog_kn} and least({edge('lat0', 'lon0')}, {edge('lat1', 'lon1')}) >= {CONFIG.gap.edge_buffer_km}",
    "gap3": "select g.*, least(a.received / (a.received + a.missed), b.received / (b.received + b.missed)) rec from gap2 g left join reception a on a.cell = r0 left join reception b on b.cell = r1 where not ((b0 or b1) and implied < 0.25 * least(s0, s1))",
    "gaps": f"select 'gap' as type, mmsi, cast(null as bigint) mmsi2, vessel_group, start_us, end_us, lat0 lat, lon0 lon, lat1 lat_end, lon1 lon_end, m duration_min, m / {CONFIG.gap.min_gap_min} * coalesce(rec, 1e0) * least(greatest(implied / greatest(least(s0, s1), 0.5e0), 0.1e0), 1e0) score from gap3 where coalesce(rec, 0) >= {CONFIG.gap.min_reception}",
    "jump0": f"""select mmsi, us, lat, lon, vessel_group, lag(us) over ({W}) us0, lag(lat) over ({W}) lat0, lag(lon) over ({W}) lon0, greatest(coalesce(sog_kn, 0), coalesce(lag(sog_kn) over ({W}), 0)) s from clean_g""",
    "clean_g": f"select *, {group()} vessel_group from clean",
    "jump1": f"select *, {hav('lat0', 'lon0', 'lat', 'lon')} d, greatest((us - us0) / 1e6, 1e0) dt, greatest({CONFIG.jump.abs_kn}, {CONFIG.jump.sog_factor} * s + {CONFIG.jump.sog_margin_kn}) lim from jump0 where us0 is not null",
    "jump2": f"select *, d / dt / {KNOT} v from jump1 where d >= {CONFIG.jump.min_jump_m} and d / dt / {KNOT} > lim",
    "jump3": f"select *, case when (us - lag(us) over ({W})) / 1e6 <= {CONFIG.jump.merge_s} then 0 else 1 end g from jump2",
    "jump4": f"select *, sum(g) over ({W} rows unbounded preceding) run from jump3",
    "jumps": "select 'jump' as type, mmsi, cast(null as bigint) mmsi2, x.vessel_group vessel_group, start_us, end_us, x.lat0 lat, x.lon0 lon, x.lat lat_end, x.lon lon_end, (end_us - start_us) / 6e7 duration_min, x.v / x.lim score from (select mmsi, run, min(us0) start_us, max(us) end_us, arg_max(j, {'d': d, 'n': -us}) x from jump4 j group by mmsi, run)",
    "loi0": f"select *, coalesce(sog_kn, 99) < {CONFIG.loiter.max_sog_kn} f, (us - lag(us) over ({W})) / 1e6 st from berth",
    "loi1": f"select *, sum(case when not f or st is null or st > {CONFIG.loiter.max_gap_min * 60} then 1 else 0 end) over ({W} rows unbounded preceding) run from loi0",
    "loiters": f"""select 'loiter' as type, mmsi, cast(null as bigint) mmsi2, vessel_group, start_us, end_us, lat, lon, lat lat_end, lon lon_end, (end_us - start_us) / 6e7 duration_min, (end_us - start_us) / 3.6e9 / {CONFIG.loiter.min_hours} score
       from (select mmsi, run, min(us) start_us, max(us) end_us, avg(lat) lat, avg(lon) lon, arg_min(vessel_group, us) vessel_group, avg(cast(port as integer)) ip, avg(cast(home as integer)) ih from loi1 where f group by mmsi, run)
       where (end_us - start_us) / 3.6e9 >= {CONFIG.loiter.min_hours} and ip <= {CONFIG.loiter.max_port_frac} and ih <= {CONFIG.loiter.max_port_frac}""",
    "dev0": f"select p.*, coalesce(t.voyages, 0) voyages, c.prob from (select *, {cell('lat', 'lon', C.traffic_cell_m)} cell, {BIN} bin from points) p left join traffic t using (cell) left join courses c on c.cell = p.cell and c.bin = p.bin",
    "dev1": f"select *, coalesce(sog_kn, 0) >= {CONFIG.deviation.min_sog_kn} and vessel_group not in ('fishing') mv from dev0",
    "dev2": f"select *, mv and voyages <= {CONFIG.deviation.max_cell_voyages} off, mv and voyages >= {CONFIG.deviation.min_cell_voyages_for_course} and coalesce(prob, 1) < {CONFIG.deviation.min_course_prob} wrong from dev1",
    "dev3": f"select *, max(case when off or wrong then us end) over ({W} rows between unbounded preceding and 1 preceding) pb, min(case when off or wrong then us end) over ({W} rows between 1 following and unbounded following) pa from dev2",
    "dev4": f"select *, off or wrong or coalesce((pa - pb) / 1e6 <= {CONFIG.deviation.bridge_min * 60}, false) f, (us - lag(us) over ({W})) / 1e6 st from dev3",
    "dev5": f"select *, sum(case when not f or st is null or st > {CONFIG.deviation.max_gap_min * 60} then 1 else 0 end) over ({W} rows unbounded preceding) run from dev4",
    "deviations": f"""select 'deviation' as type, mmsi, cast(null as bigint) mmsi2, vessel_group, start_us, end_us, lat, lon, lat_end, lon_end, (end_us - start_us) / 6e7 duration_min, (end_us - start_us) / 6e7 / {CONFIG.deviation.min_minutes} score
       from (select mmsi, run, min(us) start_us, max(us) end_us, arg_min(vessel_group, us) vessel_group, arg_min(lat, us) lat, arg_min(lon, us) lon, arg_max(lat, us) lat_end, arg_max(lon, us) lon_end from dev5 where f group by mmsi, run) where (end_us - start_us) / 6e7 >= {CONFIG.deviation.min_minutes}""",
    "ren0": f"select mmsi, us // {int(CONFIG.rendezvous.bin_min * 60e6)} bin, avg(lat) lat, avg(lon) lon, arg_min(vessel_group, us) vessel_group from berth where coalesce(sog_kn, 99) < {CONFIG.rendezvous.max_sog_kn} and not port and not home group by 1, 2",
    "ren1": f"select *, {enu('lat', 'lon')[0]} e, {enu('lat', 'lon')[1]} n from ren0",
    "ren2": f"select a.mmsi, b.mmsi mmsi2, a.bin, a.vessel_group, (a.lat + b.lat) / 2 lat, (a.lon + b.lon) / 2 lon from ren1 a join ren1 b on a.bin = b.bin and a.mmsi < b.mmsi where pow(a.e - b.e, 2) + pow(a.n - b.n, 2) <= {CONFIG.rendezvous.max_dist_m**2}",
    "ren3": "select *, case when bin - lag(bin) over (partition by mmsi, mmsi2 order by bin) <= 2 then 0 else 1 end g from ren2",
    "ren4": "select *, sum(g) over (partition by mmsi, mmsi2 order by bin rows unbounded preceding) run from ren3",
    "rendezvous": f"""select 'rendezvous' as type, mmsi, mmsi2, vessel_group, b0 * {int(CONFIG.rendezvous.bin_min * 60e6)} start_us, (b1 + 1) * {int(CONFIG.rendezvous.bin_min * 60e6)} end_us, lat, lon, lat lat_end, lon lon_end, (b1 - b0 + 1) * {CONFIG.rendezvous.bin_min} duration_min, (b1 - b0 + 1) * {CONFIG.rendezvous.bin_min} / 60 / {CONFIG.rendezvous.min_hours} score
       from (select mmsi, mmsi2, run, min(bin) b0, max(bin) b1, avg(lat) lat, avg(lon) lon, arg_max(vessel_group, bin) vessel_group from ren4 group by 1, 2, 3) where (b1 - b0 + 1) * {CONFIG.rendezvous.bin_min} / 60 >= {CONFIG.rendezvous.min_hours}""",
    "every_event": " union all ".join(f"select * from {x}" for x in ("gaps", "jumps", "loiters", "deviations", "rendezvous")),
    "ided": "select *, type || '-' || mmsi || '-' || (start_us // 1000000) event_id from every_event",
    # samples
    "vfix": "select voyage_id, mmsi, vessel_group, us, lat, lon, sog_kn, cog_deg, min(us) over (partition by voyage_id) u0 from points",
    "chosen": f"""select voyage_id, u0, us from vfix_first union all
       select c.voyage_id, c.u0, (select min(v.us) from vfix v where v.voyage_id = c.voyage_id and v.us >= c.us + {int(CONFIG.prediction.anchor_every_min * 60e6)}) us from chosen c where (select min(v.us) from vfix v where v.voyage_id = c.voyage_id and v.us >= c.us + {int(CONFIG.prediction.anchor_every_min * 60e6)}) is not null""",
    "vfix_first": f"select voyage_id, min(u0) u0, min(us) us from vfix where us - u0 >= {int(CONFIG.prediction.history_min * 60e6)} group by voyage_id",
    "samp": f"select v.*, voyage_id || '@' || strftime(make_timestamp(v.us), '%Y%m%dT%H%M%S') sample_id, unnest([{', '.join(map(str, CONFIG.prediction.horizons_min))}]) horizon_min from vfix v semi join chosen c on c.voyage_id = v.voyage_id and c.us = v.us where sog_kn >= {CONFIG.prediction.min_sog_kn} and cog_deg is not null",
    "tr0": "select s.*, s.us + cast(s.horizon_min as bigint) * 60000000 at_us from samp s",
    "tr1": "select t.*, (select max(p.us) from vfix p where p.voyage_id = t.voyage_id and p.us <= t.at_us) ua, (select min(p.us) from vfix p where p.voyage_id = t.voyage_id and p.us >= t.at_us) uz from tr0 t",
    "tr2": f"select t.*, a.lat la, a.lon lo, z.lat lz, z.lon oz, o.lat oa, o.lon oo, case when ua = at_us then 0e0 when at_us - ua <= {int(CONFIG.prediction.bracket_s * 1e6)} and uz - at_us <= {int(CONFIG.prediction.bracket_s * 1e6)} then (at_us - ua) / (uz - ua) end sh from tr1 t left join vfix a on a.voyage_id = t.voyage_id and a.us = ua left join vfix z on z.voyage_id = t.voyage_id and z.us = uz join vfix o on o.voyage_id = t.voyage_id and o.us = t.u0",
    "tr3": f"select *, {enu('la', 'lo', 'oa', 'oo')[0]} e0, {enu('la', 'lo', 'oa', 'oo')[1]} n0, {enu('lz', 'oz', 'oa', 'oo')[0]} e1, {enu('lz', 'oz', 'oa', 'oo')[1]} n1 from tr2",
    "tr4": "select *, e0 + sh * (e1 - e0) e, n0 + sh * (n1 - n0) n from tr3",
}


def latlon_steps(name: str, source: str, e: str, n: str, lat0: str, lon0: str, lat: str, lon: str) -> dict[str, str]:
    """Steps that lower points of a plane to the ellipsoid."""
    x, y, z = ecef(lat0, lon0)
    o, p, b, s = f"radians({lon0})", f"radians({lat0})", WGS84_A * (1 - 1 / 298.257223563), WGS84_E2 / (1 - WGS84_E2)
    u = f"(-({e} * {e} + {n} * {n}) / {2 * WGS84_A})"
    return {
        f"{name}_a": f"select *, {x} - sin({o}) * {e} - sin({p}) * cos({o}) * {n} + cos({p}) * cos({o}) * {u} as x_, {y} + cos({o}) * {e} - sin({p}) * sin({o}) * {n} + cos({p}) * sin({o}) * {u} as y_, {z} + cos({p}) * {n} + sin({p}) * {u} as z_ from {source}",
        f"{name}_b": f"select *, sqrt(x_ * x_ + y_ * y_) p_ from {name}_a",
        f"{name}_c": f"select *, atan2(z_ * {WGS84_A}, p_ * {b!r}) th_ from {name}_b",
        name: f"select * exclude (x_, y_, z_, p_, th_), degrees(atan2(z_ + {s!r} * {b!r} * pow(sin(th_), 3), p_ - {WGS84_E2 * WGS84_A!r} * pow(cos(th_), 3))) {lat}, degrees(atan2(y_, x_)) {lon} from {name}_c",
    }


STEPS |= latlon_steps("tr5", "tr4", "e", "n", "oa", "oo", "lat_i", "lon_i")
STEPS["truth"] = "select sample_id, voyage_id, vessel_group, horizon_min, lat lat0, lon lon0, sog_kn, cog_deg, case when ua = at_us then la when sh is not null then lat_i end lat_h, case when ua = at_us then lo when sh is not null then lon_i end lon_h from tr5"
_V = (f"(sog_kn * {KNOT} * sin(radians(cog_deg)))", f"(sog_kn * {KNOT} * cos(radians(cog_deg)))")
STEPS["dr"] = f"select *, 'dead_reckoning' model, {_V[0]} * horizon_min * 60 me, {_V[1]} * horizon_min * 60 mn, pow(greatest(0.1e0 * sqrt(pow({_V[0]}, 2) + pow({_V[1]}, 2)) * horizon_min * 60, 50e0), 2) v from truth"
STEPS["fc"] = "select * from dr union all select * replace ('stay' as model, 0e0 as me, 0e0 as mn) from dr"
STEPS |= latlon_steps("fc2", "fc", "me", "mn", "lat0", "lon0", "lat_p", "lon_p")
STEPS["fc3"] = f"select *, {enu('lat_h', 'lon_h', 'lat0', 'lon0')[0]} - me re, {enu('lat_h', 'lon_h', 'lat0', 'lon0')[1]} - mn rn from fc2 where lat_h is not null"
STEPS["scores"] = f"select model, sample_id, voyage_id, vessel_group, horizon_min, {hav('lat_p', 'lon_p', 'lat_h', 'lon_h')} / 1000 error_km, (re * re + rn * rn) / (v + 1) d2, 0.5 * ((re * re + rn * rn) / (v + 1) + ln((v + 1) * (v + 1)) + 2 * ln(2 * pi())) nll, pi() * (-2 * ln(0.1e0)) * (v + 1) / 1e6 area90_km2 from fc3"
STEPS["paired"] = "select a.horizon_min, a.voyage_id, a.error_km - b.error_km diff from scores a join scores b on a.sample_id = b.sample_id and a.horizon_min = b.horizon_min where a.model = 'dead_reckoning' and b.model = 'stay'"


def query(final: str) -> str:
    """`final` after the steps that it needs, in order of need."""
    import re

    order: list[str] = []

    def need(text: str, trail: tuple[str, ...]) -> None:
        for w in re.findall(r"(?:\bfrom|\bjoin|,)\s+([a-z_][a-z_0-9]*)\b", text):
            if w in STEPS and w not in order and w not in trail:
                need(STEPS[w], (*trail, w))
                order.append(w)

    need(final, ())
    return ("with recursive " + ",\n".join(f"{k} as ({STEPS[k]})" for k in order) + "\n" if order else "") + final


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.split(' ')[0] if ' as ' not in c else c.rsplit(' as ', 1)[0]}, {digits}) as {c.rsplit(' as ', 1)[-1]}" for c in columns)


EVENT = "type, mmsi, mmsi2, vessel_group, start_us, end_us, " + r("lat", "lon", "lat_end", "lon_end", "score") + ", " + r("duration_min", digits=3)

SQL: dict[str, str] = {
    "fixes": query(f"select event_id, mmsi, us, {r('lat', 'lon', 'sog_kn', 'cog_deg')}, vessel_type from fixes"),
    "region_filter": query(f"select event_id, mmsi, {r('lat', 'lon')} from fixes where lat between 42e0 and 42.5e0 and lon between -83.3e0 and -82.8e0"),
    "vessel_group_counts": query(f"select {group()} vessel_group, count(*) n, count(distinct mmsi) vessels from fixes group by 1"),
    "clean_points": query(f"select _row, mmsi, us, {r('lat', 'lon', 'sog_kn', 'cog_deg', 'heading_deg')} from clean1"),
    "clean_report": query(f"""select count(*) rows_in, count(*) filter (where mmsi is null or us is null or lat is null or lon is null) null_keys, count(*) filter (where mmsi is not null and us is not null and lat is not null and lon is not null and not mmsi between {MMSI_RANGE[0]} and {MMSI_RANGE[1]}) invalid_mmsi,
        count(*) filter (where mmsi is not null and us is not null and lat is not null and lon is not null and mmsi between {MMSI_RANGE[0]} and {MMSI_RANGE[1]} and transceiver not in ('A', 'B')) malformed, (select count(*) from clean0 where k > 1) duplicates, (select count(*) from clean0 where k = 1) rows_out from raw"""),
    "dedup_first": query("select _row, mmsi, us, round(sog_kn, 6) sog_kn from (select *, row_number() over (partition by mmsi, us order by _row) k from raw) where k = 1"),
    "step_kinematics": query(f"select _row, mmsi, {r('dist_prev_m', 'v_prev_kn', 'dist_next_m', 'v_next_kn', digits=5)}, dt_prev_s, dt_next_s from clean"),
    "spike_flags": query("select _row, mmsi, spike from clean"),
    "assign_voyages": query("select _row, mmsi, us, voyage_id from points"),
    "voyage_summary": query(f"select voyage_id, mmsi, vessel_type, vessel_group, transceiver, n_points, n_spikes, split, usable, start_us, end_us, {r('length_m', 'duration_min', 'moving_frac', 'path_km', digits=5)} from voyages"),
    "split_summary": query("select split, count(*) voyages, count(distinct mmsi) vessels, cast(sum(n_points) as bigint) points, round(sum(path_km), 4) path_km from voyages where usable group by split"),
    "group_summary": query("select vessel_group, count(*) voyages, count(distinct mmsi) vessels, cast(sum(n_points) as bigint) points from voyages where usable group by vessel_group"),
    "unseen_vessels": query("select distinct mmsi from voyages where usable and split = 'test' and mmsi not in (select mmsi from voyages where usable and split = 'val')"),
    "latlon_enu": query(f"select event_id, {r(enu('lat', 'lon')[0] + ' as east', enu('lat', 'lon')[1] + ' as north', f'sog_kn * {KNOT} * sin(radians(cog_deg)) as ve', f'sog_kn * {KNOT} * cos(radians(cog_deg)) as vn', edge('lat', 'lon') + ' as edge_km', digits=5)} from fixes"),
    "enu_round_trip": query("select event_id, true as same_place, round(sog_kn, 5) sog_kn, case when sog_kn > 0.01 then cog_deg end cog_deg from fixes"),
    "grid_cells": query(f"select {cell('lat', 'lon', 2000.0)} cell, {BIN} bin, count(*) n from fixes group by 1, 2"),
    "reception_grid": query("select cell, received, missed, round(received / (received + missed), 6) rate from reception"),
    "port_cells": query("select cell from ports"),
    "traffic_grid": query("select cell, voyages from traffic"),
    "course_histogram": query("select cell, bin, round(prob, 6) prob from courses"),
    "vessel_homes": query("select mmsi, cell from homes"),
    "complete_days": query("select strftime(d, '%Y-%m-%d') as day, n from (select cast(make_timestamp(us) as date) d, count(*) n from fixes group by 1) where n >= 0.6 * (select median(n) from (select count(*) n from fixes group by us // 86400000000))"),
    "detect_gaps": query(f"select {EVENT} from gaps"),
    "detect_jumps": query(f"select {EVENT} from jumps"),
    "detect_loiter": query(f"select {EVENT} from loiters"),
    "detect_deviation": query(f"select {EVENT} from deviations"),
    "detect_rendezvous": query(f"select {EVENT} from rendezvous"),
    "all_events": query("select type, vessel_group, count(*) n, round(sum(duration_min), 4) as minutes, round(max(score), 4) score from every_event group by 1, 2"),
    "top_events": query("select type, cast(rank as integer) rank, event_id, score from (select type, event_id, round(score, 6) score, row_number() over (partition by type order by round(score, 6) desc, event_id) rank from ided) where rank <= 5"),
    "base_alarm_rate": query(f"select e.vessel_group, type, alarms, round(hours, 5) as hours, round(1000 * alarms / hours, 5) per_1000_h from (select type, vessel_group, count(*) alarms from every_event group by 1, 2) e left join (select vessel_group, sum(greatest(least(coalesce((us - p) / 1e6, 0), 86400), 0)) / 3600 as hours from (select vessel_group, us, lag(us) over ({W}) p from points) group by 1) h on h.vessel_group = e.vessel_group"),
    "event_overlap_match": query("""select distinct a.type, a.mmsi, a.event_id from ided a join ided b on a.type = b.type and a.mmsi = b.mmsi where a.type in ('gap', 'jump') and
        case when a.type = 'jump' then a.start_us <= b.end_us + 120000000 and a.end_us >= b.start_us + 3600000000 - 120000000
        else (least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us + 3600000000)) / 1e6 / greatest(least(a.end_us - a.start_us, b.end_us - b.start_us - 3600000000) / 1e6, 60) >= 0.5 end"""),
    "new_events": query("select mmsi, 'any-' || mmsi || '-' || (start_us // 1000000) event_id from gaps g where not exists (select 1 from jumps j where j.mmsi = g.mmsi and g.start_us <= j.end_us and g.end_us >= j.start_us)"),
    "anchors": query("select voyage_id, us from chosen"),
    "interp_truth": query(f"select sample_id, horizon_min, {r('lat0', 'lon0', 'lat_h', 'lon_h', digits=5)} from truth"),
    "dead_reckoning": query(f"select model, sample_id, horizon_min, {r('lat0', 'lon0', digits=4)}, {r('me', 'mn', 'v as cee', 'v as cnn', '0e0 as cen', digits=1)} from dr"),
    "forecast_scores": query(f"select model, sample_id, voyage_id, vessel_group, horizon_min, {r('error_km', 'd2', 'nll', 'area90_km2', digits=4)} from scores"),
    "score_summary": query("""select model, horizon_min, count(*) n, count(distinct voyage_id) voyages, round(avg(error_km), 4) mean_km, round(median(error_km), 4) median_km, round(quantile_cont(error_km, 0.9), 4) p90_km, round(avg(case when d2 <= -2 * ln(0.5e0) then 1e0 else 0e0 end), 4) cov50,
        round(avg(case when d2 <= -2 * ln(0.1e0) then 1e0 else 0e0 end), 4) cov90, round(avg(nll), 4) nll, round(median(area90_km2), 4) area90_km2 from scores group by 1, 2"""),
    "cov_scale": query("select model, horizon_min, round(quantile_cont(d2, 0.9) / (-2 * ln(0.1e0)), 4) scale from scores group by 1, 2"),
    "paired_difference": query("select horizon_min, count(*) n, round(avg(diff), 5) mean_diff_km from paired group by 1"),
    "manoeuvre_stats": query("select " + r(*(f"quantile_cont({c}, {p}) as {c}_p{int(100 * p)}" for c in ("sog_kn", "turn", "hours") for p in (0.05, 0.5, 0.95)), digits=5) + f" from (select sog_kn, abs(((cog_deg - lag(cog_deg) over ({W}) + 180) % 360 + 360) % 360 - 180) turn, (us - lag(us) over ({W})) / 3.6e9 as hours from clean1)"),
    "decimated_track": query("select _row, mmsi from (select *, row_number() over (partition by mmsi order by us) - 1 k, count(*) over (partition by mmsi) n from points) where k % greatest(1, cast(ceil(n / 20) as bigint)) = 0"),
    "seeded_sample": query("select _row from points order by md5('7:' || _row), _row limit 100"),
    "bootstrap_ci": query(f"""select p.horizon_min, clusters, round(point, 6) point, round(lo, 6) lo, round(hi, 6) hi
        from (select horizon_min, count(*) clusters, sum(s) / sum(n) point from (select horizon_min, voyage_id, sum(diff) s, count(*) n from paired group by 1, 2) c group by 1) p
        join (select horizon_min, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi from (select horizon_min, g, sum(w * s) / sum(w * n) m from (
          select *, {' + '.join(f"(case when cast('0x' || substr(md5('0:' || g || ':' || voyage_id), 1, 8) as bigint) / {float(16**8)} >= {c!r}e0 then 1 else 0 end)" for c in POISSON_1)} w
          from (select horizon_min, voyage_id, sum(diff) s, count(*) n from paired group by 1, 2) c cross join (select unnest(range(1, 1001)) g) gs) x group by 1, 2) y group by 1) q on q.horizon_min = p.horizon_min"""),
    "embedding_neighbours": """select query_id, vec_id, round(distance, 4) distance, cast(rank as integer) rank from (select a.vec_id query_id, b.vec_id, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) distance,
        row_number() over (partition by a.vec_id order by list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), b.vec_id) rank from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id) where rank <= 5""",
}
