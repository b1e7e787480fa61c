"""The sequential queries as DuckDB SQL: recursive steps from frame to frame, all videos at once, with state in lists.

Written from the rules, against the same derived tables: a step gate, choose and
chain is a fold over lists, and a greedy matching is a fold over sorted pairs.
"""

from __future__ import annotations

from ..schema import DEFAULTS as P
from .oracles import JITTER, OWNER, SLOTS, SURE, TRACKABLE, E, area1, bridge_steps, cover_of, dist, hypot, inside, iou, motion, num, q, same_vehicle

BOX = "struct(x1 int, y1 int, x2 int, y2 int)"
DET = f"struct(ord int, box {BOX}, conf double, src varchar, veh {BOX}, cls int)"
PAIR = "struct(s double, a bigint, b bigint)"


def boxed(p: str = "") -> str:
    return "{" + ", ".join(f"{e}: {p}{e}" for e in E) + "}"


def matched(left: str, right: str, score: str, outer: str = "a") -> str:
    """Greedy pairs {s, a, b} of the places in two lists: best score first, then by the place in the outer list, then in the other one."""
    rows = f"flatten(list_transform(range(1, len({left}) + 1), lambda i: list_transform(range(1, len({right}) + 1), lambda j: {{s: -{score}, a: i, b: j}})))"
    fine = f"list_filter({rows}, lambda p: p.s <= -{num(P.min_vehicle_iou)})"
    order = f"list_sort({fine})" if outer == "a" else f"list_transform(list_sort(list_transform({fine}, lambda p: {{s: p.s, b: p.b, a: p.a}})), lambda p: {{s: p.s, a: p.a, b: p.b}})"
    return f"list_reduce({order}, lambda acc, p: case when len(list_filter(acc, lambda k: k.a = p.a or k.b = p.b)) > 0 then acc else list_append(acc, p) end, cast([] as {PAIR}[]))"


# Motorcycles' size gate

#: Frame by frame: the motorcycles that are sure enough, in list order.
MOTOS = f"""vs as ({SURE}),
mo as materialized (select video_id, frame, list(struct_pack(ord := ord, box := cast({boxed()} as {BOX})) order by ord) as motos from vs where cls = 3 group by all)"""
NONE = f"cast([] as struct(ord int, box {BOX})[])"


def gated(state: str) -> str:
    """`now`: the motorcycles with `large`, given `motos` and the frame before's `prev`."""
    of = matched("prev", "motos", iou("prev[i].box.", "motos[j].box."))
    side = "greatest(m.box.x2 - m.box.x1, m.box.y2 - m.box.y1)"
    known = "list_filter(gate, lambda p: p.b = n)"
    bar = f"case when len({known}) = 0 then cast(1 as double) when prev[({known})[1].a].large then {num(P.size_exit)} else {num(P.size_enter)} end"
    large = f"list_transform(motos, lambda m, n: {{ord: m.ord, box: m.box, large: {side} >= {num(P.min_moto_size)} * ({bar})}})"
    return f"(select *, {large} as now from (select *, {of} as gate from {state}))"


GATE = f"""gates as (
  select video_id, cast(-1 as int) as frame, cast([] as struct(ord int, box {BOX}, large boolean)[]) as prev from (select distinct video_id from fx_frames)
  union all
  select video_id, frame, now from {gated(f"(select r.video_id, f.frame, r.prev, coalesce(mo.motos, {NONE}) as motos from gates r join fx_frames f on f.video_id = r.video_id and f.frame = r.frame + 1 left join mo on mo.video_id = f.video_id and mo.frame = f.frame)")})"""


def moto_gate() -> str:
    return recursive("select video_id, frame, m.ord, m.large from (select video_id, frame, unnest(prev) as m from gates)", MOTOS, GATE)


def recursive(body: str, *steps: str) -> str:
    return "with recursive" + q(body, *steps).removeprefix("with")


# Choice of one plate per vehicle, and chains


def better() -> str:
    """Whether det `d` beats `k`: nested ones by size; others by the way to the last plate first."""
    by_size = f"row({area1('d.box.')}, d.conf) > row({area1('k.box.')}, k.conf)"
    by_way = f"row(-{dist('d.box.', 'last.')}, {area1('d.box.')}, d.conf) > row(-{dist('k.box.', 'last.')}, {area1('k.box.')}, k.conf)"
    return f"case when {iou('d.box.', 'k.box.')} < {num(0.3)} and last is not null then {by_way} else {by_size} end"


def chosen_sql(state: str) -> str:
    """`picks`: per vehicle in order its memory's place (null: none) and its best det (null: all too small)."""
    large = "list_transform(list_filter(now, lambda m: m.large), lambda m: m.box)"
    usable = f"list_filter(dets, lambda d: d.cls <> 3 or list_contains({large}, d.veh))"
    vehicles = f"list_reduce(usable, lambda acc, d: case when list_contains(acc, d.veh) then acc else list_append(acc, d.veh) end, cast([] as {BOX}[]))"
    fresh = f"list_filter(memories, lambda m: frame - m.frame <= {max(1, P.max_gap)})"
    of = matched("fresh", "vehicles", iou("vehicles[j].", "fresh[i].veh."), "b")
    at = "(list_transform(list_filter(ways, lambda p: p.b = j), lambda p: p.a))[1]"
    fits = f"(peak is null or peak <= 0 or {area1('d.box.')} / {area1('d.veh.')} * {num(P.max_area_ratio)} >= peak)"
    own = f"list_filter(usable, lambda d: d.veh = v and {fits})"
    fold = f"list_reduce(({own})[2:], lambda k, d: case when {better()} then d else k end, ({own})[1])"
    seats = f"list_transform(vehicles, lambda v, j: {{a: {at}, v: v, j: j}})"
    with_memory = "list_transform(seats, lambda s: {a: s.a, v: s.v, last: fresh[s.a].plate, peak: fresh[s.a].peak})"
    # Each seat in a list of its own, so that its parts have names within the fold.
    best = f"list_transform(held, lambda s: {{a: s.a, v: s.v, peak: s.peak, d: list_transform([s.last], lambda last: list_transform([s.peak], lambda peak: list_transform([s.v], lambda v: {fold})[1])[1])[1]}})"
    return f"""(select *, list_filter({best}, lambda s: s.d is not null) as picks from (select *, {with_memory} as held from (select *, {seats} as seats from (select *, {of} as ways from (
      select *, {vehicles} as vehicles from (select *, {usable} as usable, {fresh} as fresh from {state}))))))"""


def chained_sql(state: str) -> str:
    """`chains` after the frame's picks: {free, added, made, out}."""
    gap = "(s.d.frame - o.frame - 1)"
    linked = f"""({gap} between 0 and {P.max_gap} and (o.d.cls = s.d.cls or ({gap} <= {P.max_class_flip} and o.d.cls in (2, 3, 7) and s.d.cls in (2, 3, 7)))
      and ({gap} <= {P.max_class_flip} or {same_vehicle('o.d.veh.', 's.d.veh.')}) and {motion('o.d.box.', 's.d.box.', f'greatest({gap}, 1)', 's.d.veh.')})"""
    shrinks = f"({area1('o.d.box.')} / {area1('s.d.box.')} > {num(P.max_area_ratio)})"
    linked, shrinks = (x.replace("s.d.frame", "frame").replace("s.d.", "s.") for x in (linked, shrinks))
    near = f"list_filter(acc.free, lambda o: {linked})"
    fit = f"list_sort(list_transform(list_filter({near}, lambda o: not {shrinks}), lambda o: {{c: {dist('o.d.box.', 's.box.')}, t: o.t}}))"
    track = f"case when len({fit}) > 0 then ({fit})[1].t when len({near}) > 0 then null else acc.made + 1 end"
    move = """list_transform([{t}], lambda t: {{
        free: list_filter(acc.free, lambda o: t is null or o.t <> t), made: greatest(acc.made, coalesce(t, 0)),
        added: case when t is null then acc.added else list_append(acc.added, {{t: t, frame: frame, d: s}}) end}})[1]""".format(t=track)
    kind = f"struct(t int, frame int, d {DET})[]"
    start = f"{{free: list_filter(open, lambda o: frame - o.frame - 1 <= {P.max_gap}), made: made, added: cast([] as {kind})}}"
    return f"(select *, list_reduce(list_transform(picks, lambda s: s.d), lambda acc, s: {move}, {start}) as chains from {state})"


CANDIDATES = f"""ca as materialized (select video_id, frame, list(cast({{ord: pord, box: {boxed()}, conf: conf, src: coalesce(src, 'crop'), veh: {{{', '.join(f'{e}: v{e}' for e in E)}}}, cls: vcls}} as {DET}) order by pord) as dets
  from ({OWNER}) where choice = 1 and {TRACKABLE} group by all)"""


def tracking_step() -> str:
    memory = f"struct(veh {BOX}, plate {BOX}, peak double, frame int)"
    rows = f"""(select r.video_id, f.frame, r.prev, r.memories, r.open, r.made, coalesce(mo.motos, {NONE}) as motos, coalesce(ca.dets, cast([] as {DET}[])) as dets
      from runs r join fx_frames f on f.video_id = r.video_id and f.frame = r.frame + 1
      left join mo on mo.video_id = f.video_id and mo.frame = f.frame left join ca on ca.video_id = f.video_id and ca.frame = f.frame)"""
    remembered = f"""list_concat(list_transform(picks, lambda s: {{veh: s.v, plate: s.d.box, peak: greatest(coalesce(s.peak, 0), {area1('s.d.box.')} / {area1('s.v.')}), frame: frame}}),
      list_filter(fresh, lambda m, n: len(list_filter(picks, lambda s: s.a = n)) = 0))"""
    return f"""runs as (
  select video_id, cast(-1 as int) as frame, cast([] as struct(ord int, box {BOX}, large boolean)[]) as prev, cast([] as {memory}[]) as memories, cast([] as struct(t int, frame int, d {DET})[]) as open, 0 as made,
    cast([] as struct(t int, frame int, d {DET})[]) as found, cast([] as {DET}[]) as chosen from (select distinct video_id from fx_frames)
  union all
  select video_id, frame, now, cast({remembered} as {memory}[]), list_concat(chains.free, chains.added), chains.made, chains.added, list_transform(picks, lambda s: s.d) from {chained_sql(chosen_sql(gated(rows)))})"""


#: The chosen plates with their tracks.
SELECTED = f"""{MOTOS}, {CANDIDATES}, {tracking_step()},
sel as materialized (select video_id, frame, cast(list_position(list_transform(chosen, lambda d: d.ord), f.d.ord) - 1 as int) as dord, {', '.join(f'f.d.box.{e} as {e}' for e in E)}, f.d.conf as conf, f.d.src as src,
  {', '.join(f'f.d.veh.{e} as v{e}' for e in E)}, f.d.cls as vcls, f.t as track_id from (select video_id, frame, chosen, unnest(found) as f from runs))"""


def selected_dets() -> str:
    return recursive("select * from sel", SELECTED)


def tracklets() -> str:
    return recursive('select video_id, track_id, min(frame) as "first", max(frame) as "last", count(*) as n from sel group by all', SELECTED)


# Zones of tracks


ZONES = "zon as materialized (select video_id, frame, cast(row_number() over (partition by video_id, frame order by track_id, x1, y1, x2, y2) - 1 as int) as zord, x1, y1, x2, y2, conf, src, track_id from (select video_id, frame, x1, y1, x2, y2, conf, src, track_id from sel union all select video_id, frame, x1, y1, x2, y2, conf, 'bridge', track_id from bridged))"
SELECTED_TRACKS = f"trk as (select video_id, frame, track_id, {', '.join(E)}, conf, {', '.join(f'v{e}' for e in E)}, vcls from sel)"


def all_zones() -> tuple[str, ...]:
    steps, bridged = bridge_steps()
    return SELECTED, SELECTED_TRACKS, *steps, f"bridged as ({bridged})", ZONES


def zones() -> str:
    return recursive("select * from zon", *all_zones())


def zone_stats() -> str:
    return recursive("select count(distinct (video_id, frame)) as frames_with_zones, count(*) filter (where src <> 'bridge') as observed_zones, count(*) filter (where src = 'bridge') as bridged_zones from zon", *all_zones())


def stability_report() -> str:
    points = "pts as (select video_id, track_id, frame, (x1 + x2) / cast(2 as double) as cx, (y1 + y2) / cast(2 as double) as cy, x2 - x1 as w from (select *, row_number() over (partition by video_id, track_id, frame order by zord desc) as last from zon) where last = 1)"
    parts = (
        "(select count(*) filter (where verdict = 'uncovered') as uncovered, count(*) filter (where verdict = 'partial') as partial, count(*) filter (where verdict = 'micro') as micro_missed, coalesce(median(\"offset\"), cast(0 as double)) as offset_median, coalesce(quantile_cont(\"offset\", 0.95), cast(0 as double)) as offset_p95, coalesce(max(\"offset\"), cast(0 as double)) as offset_max from cover)",
        "(select coalesce(median(px), cast(0 as double)) as jitter_median, coalesce(quantile_cont(px, 0.95), cast(0 as double)) as jitter_p95, coalesce(max(px), cast(0 as double)) as jitter_max, count(*) as jitter_samples, coalesce(median(rel), cast(0 as double)) as size_median, coalesce(quantile_cont(rel, 0.95), cast(0 as double)) as size_p95 from jit)",
        "(select count(*) as blinks from (select lead(frame) over (partition by video_id, track_id order by frame) - frame - 1 as gap from pts) where gap between 1 and 3)",
        "(select count(*) as zones_total, count(distinct (video_id, track_id)) as tracks from zon)",
    )
    body = f"select *, zones_total / cast(frames as double) as zones_per_frame from {' cross join '.join(parts)} cross join (select count(*) as frames from fx_frames)"
    return recursive(body, *all_zones(), cover_of("zon"), points, JITTER)


# Segments


def segments_of_videos() -> str:
    steps = (
        f"vs as ({SURE})",
        f"""own as (select f.video_id, f.frame, exists (select 1 from fx_plates p where p.video_id = f.video_id and p.frame = f.frame) as has_plate,
          exists (select 1 from vs v where v.cls = 3 and v.video_id = f.video_id and v.frame = f.frame) as has_moto from fx_frames f)""",
        """cut as (select *, coalesce(before_frame is not null and not before_moto and coalesce(next_plate - last_plate > {gap}, true), false) as fresh from (
          select *, lag(frame) over k as before_frame, lag(has_moto) over k as before_moto,
            max(case when has_plate then frame end) over (partition by video_id order by frame rows between unbounded preceding and 1 preceding) as last_plate,
            min(case when has_plate then frame end) over (partition by video_id order by frame rows between current row and unbounded following) as next_plate
          from own window k as (partition by video_id order by frame)))""".format(gap=max(1, P.max_gap) + 1),
        "seg as (select *, sum(cast(fresh as int)) over (partition by video_id order by frame) as segment from cut)",
    )
    return q('select video_id, cast(segment as bigint) as segment, min(frame) as "first", count(*) as n from seg group by video_id, segment', *steps)


# Held vehicles


def held_vehicles() -> str:
    veh = f"struct(cls int, box {BOX}, conf double, held boolean)"
    obs = f"struct(frame int, ord int, cls int, box {BOX}, conf double)"
    link = f"struct(n int, frame int, cls int, box {BOX})"
    gap = "(o.frame - c.frame - 1)"
    linked = f"""({gap} between 0 and {P.max_gap} and (c.cls = o.cls or ({gap} <= {P.max_class_flip} and o.cls in (2, 3, 7)))
      and ({gap} <= {P.max_class_flip} or {same_vehicle('c.box.', 'o.box.')}) and {motion('c.box.', 'o.box.', f'greatest({gap}, 1)', 'o.box.')})"""
    near = f"list_sort(list_transform(list_filter(acc.last, lambda c: {linked}), lambda c: {{d: {dist('c.box.', 'o.box.')}, n: c.n}}))"
    step = f"""list_transform([coalesce(({near})[1].n, acc.made + 1)], lambda n: {{made: greatest(acc.made, n), chain: list_append(acc.chain, n),
      last: list_append(list_filter(acc.last, lambda c: c.n <> n), {{n: n, frame: o.frame, cls: o.cls, box: o.box}})}})[1]"""
    t, gone = "((f.frame - a_frame) / cast(b_frame - a_frame as double))", "((f.frame - wide_frame) / cast(at_frame - wide_frame as double))"
    mix = lambda a, b, t: "{" + ", ".join(f"{e}: cast(round_even({a}.{e} + ({b}.{e} - {a}.{e}) * {t}, 0) as int)" for e in E) + "}"
    covers = lambda b: f"greatest(cast(0 as double), cast({b}x2 - {b}x1 as double) * cast({b}y2 - {b}y1 as double))"
    left, right = "greatest(0, s.box.x1 - m.wide.x1)", "greatest(0, m.wide.x2 - s.box.x2)"
    start = f"case when {right} >= greatest({left}, 16) then {{x1: s.box.x2, y1: m.wide.y1, x2: m.wide.x2, y2: m.wide.y2}} when {left} >= 16 then {{x1: m.wide.x1, y1: m.wide.y1, x2: s.box.x1, y2: m.wide.y2}} end"
    steps = (
        f"ob as (select video_id, case when cls in (2, 3, 7) then 2 else cls end as kind, frame, ord, cls, cast({boxed()} as {BOX}) as box, conf from fx_vehicles)",
        f"""folded as (select video_id, kind, os, list_reduce(os, lambda acc, o: {step}, {{made: 0, chain: cast([] as int[]), last: cast([] as {link}[])}}).chain as chain from (
          select video_id, kind, list(cast({{frame: frame, ord: ord, cls: cls, box: box, conf: conf}} as {obs}) order by frame, ord) as os from ob group by all))""",
        "kinds as (select video_id, kind, row_number() over (partition by video_id order by min(row(frame, ord))) as first from ob group by video_id, kind)",
        """chn as (select video_id, first, o.frame, o.ord, o.cls, o.box, o.conf, n, bool_or(o.cls = 3) over (partition by video_id, first, n) as moto from (
          select f.video_id, k.first, unnest(f.os) as o, unnest(f.chain) as n from folded f join kinds k using (video_id, kind)))""",
        """prs as (select *, frame as a_frame, lead(frame) over w as b_frame, lead(box) over w as b_box, lead(conf) over w as b_conf from chn window w as (partition by video_id, first, n order by frame))""",
        # Wide boxes out of which a motorcycle came: the nearest frame, then the first of its list.
        f"""par as (select *, row_number() over (partition by video_id, at_frame, at_ord order by wide_frame desc, wide_ord) as choice from (
          select video_id, at_frame, at_ord, box, conf, wide_frame, wide_ord, wide, wide_conf, start from (
            select m.*, {start} as start, row_number() over (partition by m.video_id, m.at_frame, m.at_ord, m.wide_frame, m.wide_ord order by s.frame, s.ord) as nth
            from (select b.video_id, b.frame as at_frame, b.ord as at_ord, b.box, b.conf, a.frame as wide_frame, a.ord as wide_ord, a.box as wide, a.conf as wide_conf
              from ob b join ob a on a.video_id = b.video_id and a.kind = 2 and a.frame between b.frame - {P.max_gap} - 1 and b.frame - 2
              where b.cls = 3 and {inside('b.box.', 'a.box.')} and {covers('a.box.')} >= cast(1.25 as double) * {covers('b.box.')} and {motion('a.box.', 'b.box.', '(b.frame - a.frame - 1)', 'b.box.')}) m
            join ob s on s.video_id = m.video_id and s.kind = 2 and s.frame between m.wide_frame + 1 and m.at_frame
              and {iou('s.box.', 'm.box.')} < {num(0.45)} and ({inside('s.box.', 'm.wide.')} or {iou('s.box.', 'm.wide.')} >= {num(P.min_vehicle_iou)}))
          where nth = 1) where start is not null and {covers('start.')} >= 256 and {motion('start.', 'box.', '(at_frame - wide_frame - 1)', 'box.')})""",
        f"""adds as (
          select video_id, frame, row(0, first, n, 0, frame, 0) as nth, 3 as cls, box, conf, {num(P.min_vehicle_iou)} as least from chn where moto and cls <> 3 and conf >= {num(P.moto_min_conf)}
          union all select f.video_id, f.frame, row(0, p.first, p.n, 1, a_frame, 0), case when moto then 3 else cls end, {mix('box', 'b_box', t)}, conf * (1 - {t}) + b_conf * {t}, {num(P.min_vehicle_iou)}
            from prs p join fx_frames f on f.video_id = p.video_id and f.frame > a_frame and f.frame < b_frame where not (moto or cls = 3) or conf * (1 - {t}) + b_conf * {t} >= {num(P.moto_min_conf)}
          union all select f.video_id, f.frame, row(1, 0, 0, 0, at_frame, at_ord), 3, {mix('start', 'box', gone)}, wide_conf * (1 - {gone}) + conf * {gone}, {num(0.45)}
            from par p join fx_frames f on f.video_id = p.video_id and f.frame > wide_frame and f.frame < at_frame where choice = 1)""",
        f"new as (select video_id, frame, list({{cls: cls, box: cast(box as {BOX}), conf: conf, least: least}} order by nth) as vs from adds group by all)",
        f"old as (select video_id, frame, list(cast({{cls: cls, box: box, conf: conf, held: false}} as {veh}) order by ord) as vs from ob group by all)",
        f"""mixed as (select video_id, frame, list_reduce(coalesce(n.vs, cast([] as struct(cls int, box {BOX}, conf double, least double)[])), lambda acc, v:
            case when len(list_filter(acc, lambda k: k.cls = v.cls and {iou('k.box.', 'v.box.')} >= v.least)) > 0 then acc else list_append(acc, {{cls: v.cls, box: v.box, conf: v.conf, held: true}}) end,
          coalesce(o.vs, cast([] as {veh}[]))) as vs from new n full join old o using (video_id, frame))""",
        # Of motorcycles within or near one another the larger one stays.
        f"""thin as (select video_id, frame, vs, list_reduce(list_transform(list_sort(list_transform(list_filter(list_transform(vs, lambda v, i: {{v: v, i: i}}), lambda x: x.v.cls = 3), lambda x: {{c: -{covers('x.v.box.')}, i: x.i}})), lambda x: vs[x.i]),
          lambda acc, v: case when len(list_filter(acc, lambda k: {iou('v.box.', 'k.box.')} >= {num(0.28)} or {inside('v.box.', 'k.box.')})) > 0 then acc else list_append(acc, v) end, cast([] as {veh}[])) as motos from mixed)""",
        f"res as (select video_id, frame, list_concat(list_filter(vs, lambda v: v.cls <> 3), list_filter(motos, lambda v: v.conf >= {num(P.moto_min_conf)})) as vs from thin)",
    )
    return q(f"select video_id, frame, cast(i - 1 as int) as ord, v.cls, {', '.join(f'v.box.{e} as {e}' for e in E)}, v.conf, v.held from (select video_id, frame, unnest(vs) as v, generate_subscripts(vs, 1) as i from res)", *steps)


# Quads


def quad_states() -> str:
    """One zone after another, all videos at once: `qs` are the followed quads, `b` is the one that the zone takes up."""
    quad = "struct(born int, seen int, zx1 int, zy1 int, zx2 int, zy2 int, pts int[], ratio double, active boolean, weak int, leaving int)"
    orders = [[(i - k) % 4 for i in range(4)] for k in range(4)] + [[3 - (i - k) % 4 for i in range(4)] for k in range(4)]
    reorder = [[2 * i + c + 1 for i in o for c in (0, 1)] for o in orders]
    odd = "k % 2 = 1"
    area = lambda v: f"(abs(list_sum(list_transform([1, 2, 3, 4], lambda i: {v}[2 * i - 1] * {v}[2 * (i % 4) + 2] - {v}[2 * i] * {v}[2 * (i % 4) + 1])) ) / cast(2 as double))"
    most = lambda v, f, start: f"{f}({', '.join(f'{v}[{k}]' for k in range(start, 9, 2))})"
    whole = lambda v: f"list_transform({v}, lambda v: cast(trunc(v) as int))"
    far = f"{hypot('(q.zx1 + q.zx2) * cast(0.5 as double) - (x1 + x2) * cast(0.5 as double)', '(q.zy1 + q.zy2) * cast(0.5 as double) - (y1 + y2) * cast(0.5 as double)')}"
    near = f"list_sort(list_transform(list_filter(list_transform(qs, lambda q, n: {{d: {far}, n: n, fit: q.seen = frame - 1 or (q.seen = frame and q.born < frame)}}), lambda c: c.fit), lambda c: {{d: c.d, n: c.n}}))"
    reach = "cast(0.5 as double) * greatest(x2 - x1, y2 - y1, 1)"
    start = f"cast({{born: frame, seen: frame, zx1: x1, zy1: y1, zx2: x2, zy2: y2, pts: {whole('est')}, ratio: 0, active: false, weak: 0, leaving: 0}} as {quad})"
    levels = [
        f"*, {near} as near",
        f"*, case when len(near) > 0 and near[1].d <= {reach} then near[1].n end as place",
        f"*, case when place is not null then qs[place] when est is not null then {start} end as b",
        "*, (x1 + x2 - b.zx1 - b.zx2) * cast(0.5 as double) as ox, (y1 + y2 - b.zy1 - b.zy2) * cast(0.5 as double) as oy, cast((x2 - x1) * (y2 - y1) as double) as zarea",
        f"*, list_transform(b.pts, lambda v, k: v + case when {odd} then ox else oy end) as gl, list_transform({reorder}, lambda o, n: {{e: list_sum(list_transform(o, lambda i, k: power(est[i] - b.pts[k], 2))), n: n, q: list_transform(o, lambda i: est[i])}}) as options",
        "*, case when est is not null and zarea > 0 then (list_sort(options))[1].q end as nw",
        f"*, {area('nw')} / zarea as rn, list_sum(list_transform([1, 3, 5, 7], lambda k: nw[k])) / 4 as ax, list_sum(list_transform([2, 4, 6, 8], lambda k: nw[k])) / 4 as ay, list_sum(list_transform([1, 3, 5, 7], lambda k: gl[k])) / 4 as gx, list_sum(list_transform([2, 4, 6, 8], lambda k: gl[k])) / 4 as gy, {most('gl', 'least', 1)} as lx, {most('gl', 'greatest', 1)} as hx, {most('gl', 'least', 2)} as ly, {most('gl', 'greatest', 2)} as hy",
        f"""*, case when nw is null then 0 when rn >= 0.5 * b.ratio and abs(ax - gx) <= {num(0.4)} * greatest(hx - lx, 1) and abs(ay - gy) <= {num(0.4)} * greatest(hy - ly, 1)
          then case when greatest(abs(ox), abs(oy)) >= 8 then {num(0.65)} else {num(0.5)} end
          when {hypot('ax - (x1 + x2) * cast(0.5 as double)', 'ay - (y1 + y2) * cast(0.5 as double)')} <= {num(0.3)} * greatest(x2 - x1, y2 - y1, 1) and rn >= greatest({num(0.4)}, b.ratio) then {num(0.8)} else 0 end as al""",
        "*, cast(al as double) as a",
        f"*, case when a > 0 then {whole('list_transform(b.pts, lambda v, k: (1 - a) * v + a * nw[k])')} else {whole('gl')} end as p0",
        f"*, case when nw is null then cast(0 as double) when a > 0 then {area('p0')} / zarea else {area('gl')} / zarea end as r0",
        f"*, case when b.leaving > 0 then a > 0 and r0 >= {num(0.75)} else r0 >= case when b.active then {num(0.4)} else {num(0.75)} end and (a > 0 or b.active) end as strong",
        "*, not strong and b.active and b.weak < 10 as held, not strong and b.active and b.weak >= 10 as goes, b.leaving + 1 as step",
        "*, step / cast(5 as double) as t, (lx + hx) * cast(0.5 as double) as mx, (ly + hy) * cast(0.5 as double) as my, hx - lx as ow, hy - ly as oh",
        f"*, case when held then {whole('gl')} when goes then {whole(f'list_transform(gl, lambda v, k: case when {odd} then mx + (v - mx) * ((ow + (x2 - x1 - ow) * t) / greatest(ow, {num(1e-9)})) else my + (v - my) * ((oh + (y2 - y1 - oh) * t) / greatest(oh, {num(1e-9)})) end)')} else p0 end as p1",
        f"*, case when held or goes then case when zarea > 0 then {area('p1')} / zarea else cast(0 as double) end else r0 end as r1, strong or held or (goes and step < 4) as used",
        f"*, cast({{born: b.born, seen: frame, zx1: x1, zy1: y1, zx2: x2, zy2: y2, pts: p1, ratio: r1, active: used, weak: case when strong then 0 when held then b.weak + 1 else b.weak end, leaving: case when strong then 0 when goes then step else b.leaving end}} as {quad}) as nb",
    ]
    source = "(select r.video_id, r.r + 1 as r, r.qs, z.frame, z.zord, z.x1, z.y1, z.x2, z.y2, z.est from qrun r join qz z on z.video_id = r.video_id and z.r = r.r + 1)"
    for level in levels:
        source = f"(select {level} from {source})"
    kept = "list_filter(qs, lambda q: q.seen >= frame - 1)"
    after = f"case when b is null then {kept} when place is null then list_append({kept}, nb) else list_filter(list_transform(qs, lambda q, n: case when n = place then nb else q end), lambda q: q.seen >= frame - 1) end"
    return recursive(
        "select video_id, frame, zord, array_to_string(pts, ' ') as points, ratio, used from qrun where pts is not null",
        f"""qz as materialized (select *, row_number() over (partition by video_id order by frame, zord) as r, case when frame % 3 <> 0 then [cast(x1 + 2 as double), y1 + 4, x2 - 2, y1 + 1, x2 - 1, y2 - 3, x1 + 1, y2 - 1] end as est from ({SLOTS}))""",
        f"""qrun as (select video_id, cast(0 as bigint) as r, cast([] as {quad}[]) as qs, cast(null as int) as frame, cast(null as int) as zord, cast(null as int[]) as pts, cast(null as double) as ratio, cast(null as boolean) as used from (select distinct video_id from qz)
          union all select video_id, r, {after}, frame, zord, case when b is not null then p1 end, case when b is not null then r1 end, used from {source})""",
    )


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (moto_gate, selected_dets, tracklets, zones, zone_stats, stability_report, segments_of_videos, held_vehicles, quad_states)}
