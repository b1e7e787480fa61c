"""The registered queries as DuckDB SQL, written against the same derived tables but not from the Spark code."""

from __future__ import annotations

from ..schema import DEFAULTS as P
from ..sources.fixtures import CTE

E = ("x1", "y1", "x2", "y2")


# Geometry as SQL text: `a` and `b` are prefixes of column references, `{p}x1` and so on.


def w(a: str) -> str:
    return f"({a}x2 - {a}x1)"


def h(a: str) -> str:
    return f"({a}y2 - {a}y1)"


def d(x: str) -> str:
    return f"cast({x} as double)"


def inter(a: str, b: str) -> str:
    return f"({d(f'greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))')} * {d(f'greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))')})"


def size(a: str) -> str:
    return f"({d(w(a))} * {d(h(a))})"


def iou(a: str, b: str) -> str:
    return f"(case when {inter(a, b)} = 0 then cast(0 as double) else {inter(a, b)} / nullif({size(a)} + {size(b)} - {inter(a, b)}, 0) end)"


def meets(a: str, b: str, m: int = 0) -> str:
    return f"({a}x1 < {b}x2 + {m} and {a}x2 > {b}x1 - {m} and {a}y1 < {b}y2 + {m} and {a}y2 > {b}y1 - {m})"


def covered(a: str, b: str) -> str:
    return f"(case when {size(a)} <= 0 then cast(0 as double) else {inter(a, b)} / {size(a)} end)"


def cx(a: str) -> str:
    return f"({d(f'{a}x1 + {a}x2')} / 2)"


def cy(a: str) -> str:
    return f"({d(f'{a}y1 + {a}y2')} / 2)"


def inside(a: str, b: str, f: str = "cast(0 as double)") -> str:
    return f"({cx(a)} between {b}x1 - {w(b)} * {f} and {b}x2 + {w(b)} * {f} and {cy(a)} between {b}y1 - {h(b)} * {f} and {b}y2 + {h(b)} * {f})"


def hypot(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def dist(a: str, b: str) -> str:
    return hypot(f"{cx(a)} - {cx(b)}", f"{cy(a)} - {cy(b)}")


def area1(a: str) -> str:
    return f"greatest(cast(1 as double), {d(f'greatest(0, {w(a)})')} * {d(f'greatest(0, {h(a)})')})"


def even(x: str) -> str:
    return f"cast(round_even({x}, 0) as int)"


def num(x: float) -> str:
    return f"cast('{x!r}' as double)"


def same_vehicle(a: str, b: str) -> str:
    return f"({iou(a, b)} >= {num(P.min_vehicle_iou)} or {meets(a, b)})"


def motion(a: str, b: str, gap: str, v: str) -> str:
    return f"({gap} <= 0 or {dist(a, b)} <= greatest({num(P.max_disp_px)}, {hypot(d(w(v)), d(h(v)))} * {num(P.max_disp_frac)}) * {gap} * {num(1.15)})"


SURE = f"select * from fx_vehicles where cls <> 3 or conf >= {num(P.moto_min_conf)}"
SLOTS = "select video_id, frame, pord as zord, x1, y1, x2, y2, conf, src, pord + 1 as track_id from fx_plates where pord < 3"
#: Plates with the vehicle that owns them, of a vehicle table `vs`.
OWNER = f"""select p.*, v.ord as vord, v.cls as vcls, v.x1 as vx1, v.y1 as vy1, v.x2 as vx2, v.y2 as vy2,
    row_number() over (partition by p.video_id, p.frame, p.pord order by case when {inside('p.', 'v.')} then 0 else 1 end,
      case when {inside('p.', 'v.')} then greatest(cast(1 as double), {size('v.')}) end, v.ord) as choice
  from fx_plates p join vs v on p.video_id = v.video_id and p.frame = v.frame and v.cls in (2, 3, 5, 7)
    and ({inside('p.', 'v.')} or ({meets('p.', 'v.')} and v.cls <> 3))"""
TRACKABLE = "conf >= 0.15 and least(x2 - x1, y2 - y1) >= 12 and coalesce(src, 'crop') <> 'sahi'"
MOTO_PLATES = f"""select p.*, {inside('p.', 'v.')} as geo, v.ord as vord, row_number() over (partition by p.video_id, p.frame, p.pord order by case when {inside('p.', 'v.')} then 0 else 1 end,
      case when {inside('p.', 'v.')} then greatest(cast(1 as double), {size('v.')}) end, v.ord) as choice
  from fx_plates p join fx_vehicles v on p.video_id = v.video_id and p.frame = v.frame and v.cls = 3 and ({inside('p.', 'v.')} or {meets('p.', 'v.')})
  where p.conf >= 0.15 and p.x2 - p.x1 >= 8 and p.y2 - p.y1 >= 4"""
MP = f"mp as (select * from ({MOTO_PLATES}) where choice = 1)"
MF = f"""{MP}, mf as (select m.video_id, m.frame, m.n_moto, coalesce(n.n_any, 0) as n_any, coalesce(n.n_geo, 0) as n_geo
  from (select video_id, frame, count(*) as n_moto from fx_vehicles where cls = 3 group by all) m
  left join (select video_id, frame, count(*) as n_any, count(*) filter (where geo) as n_geo from mp group by all) n using (video_id, frame))"""
def cover_of(zones: str) -> str:
    """Plates with the zone of a table (or subquery) that covers most of them."""
    return f"""cover as (select *, case when small then case when frac < 0.9 then 'micro' else 'small' end when frac <= 0 then 'uncovered' when frac < 0.9 then 'partial' else 'full' end as verdict,
    case when not small and frac > 0 then {hypot('((x1 + x2) - (zx1 + zx2)) * cast(0.5 as double)', '((y1 + y2) - (zy1 + zy2)) * cast(0.5 as double)')} / greatest(cast(1 as double), cast(x2 - x1 as double)) end as "offset"
  from (select p.*, case when z.zord is null then cast(0 as double) else {covered('p.', 'z.')} end as frac, z.x1 as zx1, z.y1 as zy1, z.x2 as zx2, z.y2 as zy2, p.x2 - p.x1 < 12 or p.y2 - p.y1 < 6 as small,
      row_number() over (partition by p.video_id, p.frame, p.pord order by case when z.zord is null then cast(0 as double) else {covered('p.', 'z.')} end desc, z.zord) as choice
    from fx_plates p left join {zones} z using (video_id, frame) where p.conf >= 0.15) where choice = 1)"""


COVER = cover_of(f"({SLOTS})")
POINTS = f"pts as (select video_id, track_id, frame, {cx('')} as cx, {cy('')} as cy, x2 - x1 as w from ({SLOTS}))"
JITTER = """jit as (select video_id, track_id, frame, sqrt(px * px + py * py) as px, rel from (
  select video_id, track_id, frame, cx2 - cx * 2 + cx0 as px, cy2 - cy * 2 + cy0 as py, abs(w2 - w * 2 + w0) / greatest(cast(1 as double), cast(w as double)) as rel from (
    select *, lag(frame) over k as f0, lead(frame) over k as f2, lag(cx) over k as cx0, lead(cx) over k as cx2, lag(cy) over k as cy0, lead(cy) over k as cy2, lag(w) over k as w0, lead(w) over k as w2
    from pts window k as (partition by video_id, track_id order by frame)) where frame - f0 = 1 and f2 - frame = 1))"""
AUDITED = 'aud as (select p.*, e.value as "var" from fx_plates p join fx_frames f using (video_id, frame) join events e on e.event_id = f.event_id)'
STRATA = f"""strata as (select video_id, frame, ord, cls, case when n_unsure > 0 then 'unsure' when cls = 3 then case when n_sure > 0 then 'moto_ok' else 'moto_empty' end else case when n_sure > 0 then 'car_ok' else 'car_empty' end end as stratum
  from (select v.video_id, v.frame, v.ord, v.cls, count(*) filter (where p.conf >= 0.05 and p.conf < 0.25) as n_unsure, count(*) filter (where p.conf >= 0.25) as n_sure
    from fx_vehicles v left join fx_plates p on p.video_id = v.video_id and p.frame = v.frame and {inside('p.', 'v.')} group by all)),
kept as (select *, stratum = 'unsure' or row_number() over (partition by video_id, stratum order by frame, ord) % case stratum when 'moto_ok' then 4 when 'moto_empty' then 3 when 'car_ok' then 4 else 8 end = 0 as kept from strata)"""
#: One element of a list per row, so that `list_reduce` folds over lists of kept elements.
FOLD = "list([{s}] order by {k})"


def q(body: str, *steps: str) -> str:
    """A statement over the derived tables with more named steps."""
    return ", ".join([CTE, *steps]) + "\n" + body


def lerp(a: str, b: str, t: str) -> str:
    return even(f"{a} + ({b} - {a}) * {t}")


def yolo(e1: str, e2: str, full: int, least: str, what: str) -> str:
    v = f"({d(f'{e1} + {e2}')} / 2 / {full})" if what == "c" else f"({d(f'{e2} - {e1}')} / {full})"
    return f"cast(cast(cast(printf('%.12f', greatest({least}, least(cast(1 as double), {v}))) as decimal(18, 12)) as decimal(18, 6)) as varchar)"


def clamp_sql(src: str, width: int, height: int, frac: float) -> str:
    """A subquery with x1 ... y2 of `src` cut to a fraction of the frame."""
    scale = f"least({num(width * frac)} / greatest({w('')}, 1), {num(height * frac)} / greatest({h('')}, 1))"
    fits = f"({w('')} <= {num(width * frac)} and {h('')} <= {num(height * frac)})"
    cols = {"x1": f"{cx('')} - {w('')} * sc / 2", "y1": f"{cy('')} - {h('')} * sc / 2", "x2": f"{cx('')} + {w('')} * sc / 2", "y2": f"{cy('')} + {h('')} * sc / 2"}
    new = ", ".join(f"case when fits then {c} else cast(trunc({v}) as int) end as {c}" for c, v in cols.items())
    return f"(select * exclude (x1, y1, x2, y2, sc, fits), {new} from (select *, {scale} as sc, {fits} as fits from {src}))"


def geometry_pairs() -> str:
    a, b = "", "v"
    left = "greatest(cast(0 as double), cast(x1 - vx1 as double))"
    right = "greatest(cast(0 as double), cast(vx2 - x2 as double))"
    side = f"case when {right} >= {left} and {right} >= 16 then 'r' when {left} >= 16 then 'l' end"
    vw, vh = f"greatest(cast(1 as double), {d(w(b))})", f"greatest(cast(1 as double), {d(h(b))})"
    pw, ph = f"greatest(cast(4 as double), pw * {vw})", f"greatest(cast(4 as double), ph * {vh})"
    # The vehicle's box is cut in the same rows, under the names that the cut works on.
    clamped = clamp_sql(f"(select * exclude (x1, y1, x2, y2), {', '.join(f'{e} as a{e}, v{e} as {e}' for e in E)} from pv)", 640, 360, P.max_box_frac)
    return q(
        f"""select video_id, frame, pord, ord, {iou(a, b)} as iou, {meets(a, b)} as meets, {meets(a, b, 8)} as near, {covered(a, b)} as covered,
  {dist(a, b)} as dist, {hypot(d(w(b)), d(h(b)))} as diag, {area1(a)} as area1, greatest(cast(0 as double), {size(b)}) as area0, least({w(a)}, {h(a)}) as side, greatest({w(b)}, {h(b)}) as size,
  {area1(a)} / {area1(b)} as rel, {area1(b)} / {area1(a)} <= 2.5 as ratio_ok,
  {", ".join(f"{lerp(e, 'v' + e, num(0.25))} as l{e}" for e in E)}, px, py, pw, ph,
  {even(f"vx1 + px * {vw} - {pw} / 2")} as qx1, {even(f"vy1 + py * {vh} - {ph} / 2")} as qy1, {even(f"vx1 + px * {vw} + {pw} / 2")} as qx2, {even(f"vy1 + py * {vh} + {ph} / 2")} as qy2,
  {motion(a, b, "ord", b)} as motion, cls = 3 or (cls in (2, 3, 7) and ord between 0 and 1) as class_link, {same_vehicle(a, b)} or ord between 0 and 1 as identity,
  {inside(a, b)} as inside, {inside(a, b, num(0.15))} as inside15,
  case {side} when 'r' then x2 when 'l' then vx1 end as rx1, case when {side} is not null then vy1 end as ry1, case {side} when 'r' then vx2 when 'l' then x1 end as rx2, case when {side} is not null then vy2 end as ry2,
  cx1, cy1, cx2, cy2
from pc""",
        f"pv0 as (select p.video_id, p.frame, p.pord, p.x1, p.y1, p.x2, p.y2, v.ord, v.cls, {', '.join(f'v.{e} as v{e}' for e in E)} from fx_plates p join fx_vehicles v using (video_id, frame))",
        f"pv as (select *, ({cx('')} - vx1) / {vw} as px, ({cy('')} - vy1) / {vh} as py, {w('')} / {vw} as pw, {h('')} / {vh} as ph from pv0)",
        f"pc as (select * exclude (x1, y1, x2, y2, ax1, ay1, ax2, ay2), {', '.join(f'{e} as c{e}, a{e} as {e}' for e in E)} from {clamped})",
    )


def crops_sql() -> str:
    """All crops with their letterbox."""
    pad, top = even(f"greatest(1, {w('')}) * {num(P.moto_crop_side)}"), even(f"greatest(1, {h('')}) * {num(P.moto_crop_bottom)}")
    scale = "least(cast(1280 as double) / crop_w, cast(1280 as double) / crop_h, cast(2 as double))"
    return f"""crops as (select *, {scale} as scale, (1280 - greatest(1, {even(f"crop_w * {scale}")})) / cast(2 as double) as pad_x, (1280 - greatest(1, {even(f"crop_h * {scale}")})) / cast(2 as double) as pad_y
  from (select *, x2 - x1 as crop_w, y2 - y1 as crop_h from (
    select video_id, frame, ord, cls, cord, src, greatest(0, x1) as x1, greatest(0, y1) as y1, least(1920, x2) as x2, least(1080, y2) as y2 from (
      select video_id, frame, ord, cls, 1 as cord, 'crop' as src, x1 - 12 as x1, y1 - 12 as y1, x2 + 12 as x2, y2 + 12 as y2 from fx_vehicles where cls in (2, 3, 5, 7)
      union all select video_id, frame, ord, cls, 0, 'crop_moto', x1 - {pad}, y1 + {top}, x2 + {pad}, y2 from fx_vehicles where cls = 3)) where x2 > x1 and y2 > y1))"""


def dedupe_sql() -> str:
    same = f"k.cls = v.cls and ({iou('v.', 'k.')} >= 0.4 or ({inter('v.', 'k.')} > 0 and {inter('v.', 'k.')} / least(greatest(cast(1 as double), {size('v.')}), greatest(cast(1 as double), {size('k.')})) >= 0.6))"
    item = "{ord: ord, cls: cls, x1: x1, y1: y1, x2: x2, y2: y2, conf: conf}"
    at = f"list_position(list_transform(acc, lambda k: list_transform(x, lambda v: {same})[1]), true)"
    grown = "{ord: k.ord, cls: k.cls, x1: least(k.x1, x[1].x1), y1: least(k.y1, x[1].y1), x2: greatest(k.x2, x[1].x2), y2: greatest(k.y2, x[1].y2), conf: greatest(k.conf, x[1].conf)}"
    fold = f"list_reduce(list([{item}] order by -conf, ord), lambda acc, x: case when coalesce({at}, 0) > 0 then list_transform(acc, lambda k, i: case when i = {at} then {grown} else k end) else list_concat(acc, x) end)"
    return q(f"select video_id, frame, cast(place - 1 as int) as place, v.cls, v.x1, v.y1, v.x2, v.y2, v.conf from (select video_id, frame, unnest(r) as v, generate_subscripts(r, 1) as place from (select video_id, frame, {fold} as r from fx_vehicles group by all))")


def bridge_steps() -> tuple[tuple[str, ...], str]:
    """Gaps of tracks `trk` filled by pose, on the vehicle seen then (`vs`): named steps and the last statement."""
    a, b = "a_", "b_"
    cols = [*E, "conf", "vx1", "vy1", "vx2", "vy2", "vcls", "frame"]
    vw = lambda p: f"greatest(cast(1 as double), cast({p}x2 - {p}x1 as double))"
    vh = lambda p: f"greatest(cast(1 as double), cast({p}y2 - {p}y1 as double))"
    pose = lambda p: (f"(({cx(p)} - {p}vx1) / {vw(p + 'v')})", f"(({cy(p)} - {p}vy1) / {vh(p + 'v')})", f"({w(p)} / {vw(p + 'v')})", f"({h(p)} / {vh(p + 'v')})")
    mixed = [f"({m} + ({n} - {m}) * t)" for m, n in zip(pose(a), pose(b), strict=True)]
    ok = f"""gap between 0 and {P.max_gap} and (a_vcls = b_vcls or (a_vcls in (2, 3, 7) and b_vcls in (2, 3, 7) and gap <= {P.max_class_flip}))
      and ({same_vehicle("a_v", "b_v")} or gap <= {P.max_class_flip}) and {motion(a, b, "greatest(gap, 1)", "b_v")} and {area1(a)} / {area1(b)} <= {num(P.max_area_ratio)}"""
    steps = (
        f"prs as (select video_id, track_id, {', '.join(f'{c} as a_{c}, lead({c}) over k as b_{c}' for c in cols)} from trk window k as (partition by video_id, track_id order by frame))",
        f"gaps as (select *, b_frame - a_frame - 1 as gap from prs where b_frame is not null and b_frame - a_frame > 1)",
        f"miss as (select *, (frame - a_frame) / cast(b_frame - a_frame as double) as t from (select *, unnest(range(a_frame + 1, b_frame)) as frame from gaps where {ok}))",
        f"gs as (select *, {', '.join(f'{lerp(f"a_v{e}", f"b_v{e}", "t")} as g{e}' for e in E)} from miss)",
        f"""liv as (select gs.*, {', '.join(f'case when v.ord is not null and {iou("gs.g", "v.")} >= {num(P.min_vehicle_iou)} then v.{e} else gs.g{e} end as l{e}' for e in E)},
          row_number() over (partition by gs.video_id, gs.track_id, gs.frame order by case when v.ord is null then cast(0 as double) else {iou("gs.g", "v.")} end desc, v.ord) as choice
          from gs left join vs v on v.video_id = gs.video_id and v.frame = gs.frame and (v.cls = a_vcls or (a_vcls in (2, 3, 7) and v.cls in (2, 3, 7))))""",
        f"""placed as (select video_id, cast(frame as int) as frame, track_id, a_conf * (1 - t) + b_conf * t as conf, lx1 + {mixed[0]} * {vw('l')} as px, ly1 + {mixed[1]} * {vh('l')} as py,
          greatest(cast(4 as double), {mixed[2]} * {vw('l')}) * 0.5 as pw, greatest(cast(4 as double), {mixed[3]} * {vh('l')}) * 0.5 as ph from liv where choice = 1)""",
    )
    return steps, """select video_id, frame, cast(round_even(px - pw, 0) as int) as x1, cast(round_even(py - ph, 0) as int) as y1, cast(round_even(px + pw, 0) as int) as x2, cast(round_even(py + ph, 0) as int) as y2, conf, track_id from placed"""


def bridge_sql() -> str:
    """Gaps of slot tracks."""
    cols = [*E, "conf", "vx1", "vy1", "vx2", "vy2", "vcls"]
    steps, body = bridge_steps()
    return q(
        body,
        f"vs as ({SURE})",
        f"trk as (select video_id, frame, pord + 1 as track_id, {', '.join(cols)} from ({OWNER}) where choice = 1 and pord < 3 and {TRACKABLE})",
        *steps,
    )


def plan_sql() -> str:
    rows = f"""(select video_id, frame, src, x1, y1, x2, y2 from ({SLOTS}) union all select video_id, frame, 'own', 800, 1000, 1000, 1075 from fx_frames
      union all select video_id, frame, 'forced', x1, y1, x2, y2 from fx_plates where pord >= 20)"""
    twice = clamp_sql(clamp_sql(rows, 1920, 1080, P.max_box_frac), 1920, 1080, P.max_box_frac)
    return q(f"""select *, 'blur' as mode, cast(least(81, greatest(35, cast(trunc(least(x2 - x1, y2 - y1) * cast(0.42 as double)) as int) | 1)) as int) as kernel from (
      select video_id, frame, src, greatest(0, x1 - 10) as x1, greatest(0, y1 - 10) as y1, least(1920, x2 + 10) as x2, least(1080, y2 + 10) as y2 from {twice}) where x2 > x1 and y2 > y1""")


def quota_sql() -> str:
    pad, top = even(f"greatest(1, {w('v.')}) * {num(P.moto_crop_side)}"), even(f"greatest(1, {h('v.')}) * {num(P.moto_crop_bottom)}")
    return q(
        """select video_id, frame, ord, positive, vx1, vy1, x1 as rx1, y1 as ry1, x2 as rx2, y2 as ry2, lx1, ly1, lx2, ly2 from (
  select *, row_number() over (partition by video_id, positive order by frame, ord) as nth from (
    select r.*, l.lx1, l.ly1, l.lx2, l.ly2, l.lx1 is not null as positive from roi r left join lab l using (video_id, frame, ord))) where nth <= case when positive then 5 else 3 end""",
        f"""roi as (select * from (select v.video_id, v.frame, v.ord, v.x1 as vx1, v.y1 as vy1, v.x2 as vx2, v.y2 as vy2, greatest(0, v.x1 - {pad}) as x1, greatest(0, v.y1 + {top}) as y1, least(1920, v.x2 + {pad}) as x2, least(1080, v.y2) as y2
          from fx_vehicles v where cls = 3) where x2 > x1 and y2 > y1)""",
        f"""own as (select * from (select p.*, {', '.join(f'v.{e} as v{e}' for e in E)}, row_number() over (partition by p.video_id, p.frame, p.pord order by greatest(cast(1 as double), {size('v.')}), v.ord) as choice
          from fx_plates p join fx_vehicles v on p.video_id = v.video_id and p.frame = v.frame and v.cls = 3 and {inside('p.', 'v.')}) where choice = 1)""",
        """lab as (select * from (select *, row_number() over (partition by video_id, frame, ord order by conf desc, pord) as first from (
          select r.video_id, r.frame, r.ord, o.pord, o.conf, greatest(0, o.x1 - r.x1) as lx1, greatest(0, o.y1 - r.y1) as ly1, least(r.x2 - r.x1, o.x2 - r.x1) as lx2, least(r.y2 - r.y1, o.y2 - r.y1) as ly2
          from roi r join own o on o.video_id = r.video_id and o.frame = r.frame and o.vx1 = r.vx1 and o.vy1 = r.vy1 and o.vx2 = r.vx2 and o.vy2 = r.vy2) where lx2 > lx1 and ly2 > ly1) where first = 1)""",
    )


def fold_sql(item: str, order: str, keep: str, source: str, out: str) -> str:
    """Greedy selection by `list_reduce`: an element joins unless `keep` is false for it and some kept element."""
    hit = f"len(list_filter(acc, lambda k: list_transform(x, lambda v: {keep})[1])) > 0"
    fold = f"list_reduce(list([{item}] order by {order}), lambda acc, x: case when {hit} then acc else list_concat(acc, x) end)"
    return f"select video_id, frame, {out} from (select video_id, frame, {fold} as r from {source} group by all)"


def merge_sql() -> str:
    item = "{x1: x1, y1: y1, x2: x2, y2: y2}"
    both = "{x1: least(l.x1, v.x1), y1: least(l.y1, v.y1), x2: greatest(l.x2, v.x2), y2: greatest(l.y2, v.y2)}"
    meet = meets("l.", "v.")
    step = f"list_transform(x, lambda v: list_transform([acc[len(acc)]], lambda l: case when {meet} then list_concat(acc[1:len(acc) - 1], [{both}]) else list_concat(acc, [v]) end)[1])[1]"
    return f"list_reduce(list([{item}] order by x1, y1, x2, y2, pord), lambda acc, x: {step})"


def plates_by_vehicle_sql() -> str:
    """Claims in vehicle order by a fold over vehicles: acc and x are one-element lists of states."""
    p = "{pord: pord, x1: x1, y1: y1, x2: x2, y2: y2, conf: conf}"
    start = "{free: ps, kept: ps[1:0], lost: ps[1:0], v: {x1: 0, y1: 0, x2: 0, y2: 0}}"
    state = "{free: ps[1:0], kept: ps[1:0], lost: ps[1:0], v: v}"
    inside_ = f"list_filter(a.free, lambda p: {meets('p.', 's.v.')})"
    best = f"list_sort(list_transform({inside_}, lambda p: {{m: -p.conf, o: p.pord, p: p}}))"
    step = f"{{free: list_filter(a.free, lambda p: not {meets('p.', 's.v.')}), kept: list_concat(a.kept, list_transform(({best})[1:1], lambda b: b.p)), lost: list_concat(a.lost, list_transform(({best})[2:], lambda b: b.p)), v: s.v}}"
    fold = f"list_reduce(list_concat([[{start}]], list_transform(vs, lambda v: [{state}])), lambda acc, x: list_transform(acc, lambda a: list_transform(x, lambda s: {step})[1]))"
    return q(
        "select video_id, frame, unnest(list_concat(r[1].kept, r[1].free)).pord as pord, true as kept from res union all select video_id, frame, unnest(r[1].lost).pord, false from res",
        f"pl as (select video_id, frame, list({p} order by pord) as ps from fx_plates group by all)",
        "ve as (select video_id, frame, list({x1: x1, y1: y1, x2: x2, y2: y2} order by ord) as vs from fx_vehicles group by all)",
        f"res as (select video_id, frame, {fold} as r from pl join ve using (video_id, frame))",
    )


def oracle_sql() -> dict[str, str]:
    is_ = lambda v: f"count(*) filter (where verdict = '{v}')"
    zero = lambda x: f"coalesce({x}, cast(0 as double))"
    box = "x1, y1, x2, y2"
    back = lambda e, s: f"greatest(0, least(crop_{s}, {even(f'((v.{e} - c.{e[0]}1) * scale + pad_{e[0]} - pad_{e[0]}) * (cast(1 as double) / scale)')}))"
    at = lambda e: f"((v.{e} - c.{e[0]}1) * scale + pad_{e[0]})"
    label = f"concat_ws(' ', '0', {yolo('x1', 'x2', 1920, 'cast(0 as double)', 'c')}, {yolo('y1', 'y2', 1080, 'cast(0 as double)', 'c')}, {yolo('x1', 'x2', 1920, num(0.001), 's')}, {yolo('y1', 'y2', 1080, num(0.001), 's')})"
    wx = lambda x, y: f"({num(0.9)} * {x} + {num(-0.2)} * {y} + 30)"
    wy = lambda x, y: f"({num(0.1)} * {x} + {num(1.1)} * {y} + -40)"
    corners = (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))
    warp = lambda f, fn, most: f"greatest(cast(0 as double), least(cast({most} as double), {fn}({', '.join(f(x, y) for x, y in corners)})))"
    runs = "select video_id, min(frame) as first, max(frame) as last, count(*) as n, min(frame) / cast(30 as double) as \"start\", max(frame) / cast(30 as double) as \"end\" from (select video_id, frame, frame - row_number() over (partition by video_id order by frame) as g from (select distinct video_id, frame from fx_plates where conf > 0.7)) group by video_id, g"
    return {
        "geometry_pairs": geometry_pairs(),
        "scalar_functions": q("""select id, cast((id % 60) * 60 + id % 59 as double) as mm, cast(3600 + (id % 60) * 60 + id % 59 as double) as hh, id * cast(1.5 as double) as ss, cast(id as int) as region_x2, cast(id % 256 as int) as red,
  case when id < 60 then printf('%.1fs', cast(id as double)) when id < 3600 then printf('%dm%02ds', id // 60, id % 60) else printf('%dh%02dm%02ds', id // 3600, id % 3600 // 60, id % 60) end as took,
  id between 5 and 10 or id between 60 and 120 as dense, case id % 8 when 2 then 'car' when 3 then 'motorcycle' when 5 then 'bus' when 7 then 'truck' else cast(id % 8 as varchar) end as class_name,
  printf('%02d:%05.2f', cast(floor(id / cast(240 as double)) as bigint), id / cast(4 as double) - floor(id / cast(240 as double)) * 60) as code, printf('f%06d_m12_7', id) as stem,
  greatest(1, cast(trunc((case when id % 3 = 0 then cast(40 as double) else id % 3 * 10 end - 1) * 30) as int)) as n_frames from (select event_id as id from fx_frames)"""),
        "crop_layout": q(f"select video_id, frame, ord, cls, cord, src, {box}, crop_w, crop_h, scale, pad_x, pad_y from crops", crops_sql()),
        "letterbox_roundtrip": q(f"""select c.video_id, c.frame, c.ord, {back('x1', 'w')} as x1, {back('y1', 'h')} as y1, {back('x2', 'w')} as x2, {back('y2', 'h')} as y2,
  ({at('x1')} + {at('x2')}) * 0.5 between pad_x and pad_x + crop_w * scale and ({at('y1')} + {at('y2')}) * 0.5 between pad_y and pad_y + crop_h * scale as on_content
  from crops c join fx_vehicles v using (video_id, frame, ord) where c.src = 'crop'""", crops_sql()),
        # Slot plates lie within their crop, so that they come back as they are; crops exist where the slot's vehicle does.
        "detected_plates": q(
            f"select video_id, frame, {box}, conf, 'crop' as src, true as kept from dp join (" + fold_sql("{pord: pord, x1: x1, y1: y1, x2: x2, y2: y2}", f"-{size('')}, pord", f"{iou('k.', 'v.')} > 0.3", "dp where conf >= 0.15", "unnest(r).pord as pord") + f") using (video_id, frame, pord) union all select video_id, frame, {box}, conf, 'rejected', false from dp where conf < 0.15",
            "dp as (select p.* from fx_plates p join fx_vehicles v on v.video_id = p.video_id and v.frame = p.frame and v.ord = p.pord where p.pord < 3)",
        ),
        "yolo_labels": q(f"select video_id, frame, pord, {label} as value from fx_plates"),
        "yolo_roundtrip": q(f"""select video_id, frame, pord, cast(p[1] as int) as cls, cast(trunc((cast(p[2] as double) - cast(p[4] as double) / 2) * 1920) as int) as x1, cast(trunc((cast(p[3] as double) - cast(p[5] as double) / 2) * 1080) as int) as y1,
  cast(trunc((cast(p[2] as double) + cast(p[4] as double) / 2) * 1920) as int) as x2, cast(trunc((cast(p[3] as double) + cast(p[5] as double) / 2) * 1080) as int) as y2 from (select video_id, frame, pord, string_split({label}, ' ') as p from fx_plates)"""),
        "warped_boxes": q(f"select * from (select video_id, frame, ord, {warp(wx, 'least', 1920)} as x1, {warp(wy, 'least', 1080)} as y1, {warp(wx, 'greatest', 1920)} as x2, {warp(wy, 'greatest', 1080)} as y2 from fx_vehicles) where (x2 - x1) * (y2 - y1) >= 24"),
        "moto_conf_view": q(SURE),
        "trackable_plates": q(f"select * from fx_plates where {TRACKABLE}"),
        "plate_confidence_split": q("select *, conf >= 0.15 as kept from fx_plates where x2 > x1 and y2 > y1"),
        "plate_geometry_filter": q(f"""select p.video_id, p.frame, p.pord, not (p.src in ('crop', 'crop_moto') and not exists (select 1 from fx_vehicles v where v.video_id = p.video_id and v.frame = p.frame and ((v.cls = 3 and {inside('p.', 'v.')}) or {inside('p.', 'v.', num(0.15))}))) as kept from fx_plates p"""),
        "clip_frames": q("select video_id, frame from fx_frames where frame >= 10 and frame < 40 and frame % 3 = 0"),
        "plate_vehicle_assoc": q(
            f"select video_id, frame, pord, max(vord) as ord, max(vcls) as cls from (select video_id, frame, pord, vord, vcls from ({OWNER}) where choice = 1 union all select video_id, frame, pord, null, null from fx_plates) group by video_id, frame, pord",
            "vs as (select * from fx_vehicles)",
        ),
        "owned_plates_by_source": q(f"select video_id, src, count(*) as n from ({OWNER}) where choice = 1 and {TRACKABLE} group by all", f"vs as ({SURE})"),
        "plate_nms": q(fold_sql("{pord: pord, x1: x1, y1: y1, x2: x2, y2: y2}", f"-{size('')}, pord", f"{iou('k.', 'v.')} > 0.3", "fx_plates", "unnest(r).pord as pord")),
        "vehicle_dedupe": dedupe_sql(),
        "held_nms": q(f"""select video_id, frame, cast(row_number() over (partition by video_id, frame order by moto, place) - 1 as int) as place, ord from (
  select video_id, frame, 0 as moto, ord as place, ord from fx_vehicles where cls <> 3 union all
  select video_id, frame, 1, generate_subscripts(r, 1), unnest(r).ord from (select video_id, frame, list_reduce(list([{{ord: ord, x1: x1, y1: y1, x2: x2, y2: y2}}] order by -greatest(cast(0 as double), {size('')}), ord), lambda acc, x: case when len(list_filter(acc, lambda k: list_transform(x, lambda v: {iou('v.', 'k.')} >= 0.28 or {inside('v.', 'k.')})[1])) > 0 then acc else list_concat(acc, x) end) as r from fx_vehicles where cls = 3 group by all))"""),
        "one_plate_per_vehicle": plates_by_vehicle_sql(),
        "fixlist_merge": q(f"select video_id, frame, cast(place - 1 as int) as place, v.x1, v.y1, v.x2, v.y2 from (select video_id, frame, unnest(r) as v, generate_subscripts(r, 1) as place from (select video_id, frame, {merge_sql()} as r from fx_plates group by all))"),
        "zone_coverage": q('select video_id, frame, pord, frac, verdict, "offset" from cover', COVER),
        "observed_kept": q(f"select video_id, frame, pord, exists (select 1 from ({SLOTS}) z where z.video_id = p.video_id and z.frame = p.frame and z.src not in ('bridge', 'own') and {iou('p.', 'z.')} >= 0.3) as kept from fx_plates p where pord >= 3"),
        "replay_frames": q("select f.video_id, f.frame from fx_frames f left join (select f.video_id, min(f.frame) as stop from fx_frames f left join fx_vehicles v using (video_id, frame) where v.ord is null group by 1) s using (video_id) where f.frame < coalesce(s.stop, 1000000000)"),
        "detection_recall": q("""select count(*) as moto_frames, count(*) filter (where n_any > 0) as moto_with_any_plate, count(*) filter (where n_geo > 0) as moto_with_geo_plate, (select count(*) from fx_frames) as frames,
  count(*) filter (where n_any > 0) / cast(count(*) as double) as recall_any, count(*) filter (where n_geo > 0) / cast(count(*) as double) as recall_geo from mf""", MF),
        "plates_by_source": q("select src, count(*) as n from mp group by all", MP),
        "plate_size_medians": q("select median(x2 - x1) as w, median(y2 - y1) as h, median(x2 - x1) filter (where geo) as geo_w, median(y2 - y1) filter (where geo) as geo_h from mp", MP),
        "key_second_hits": q("""select k.second, count(*) as moto_frames, count(*) filter (where n_geo > 0) as geo_frames, coalesce(any_value(c.confs), '') as sample_confs from mf
  join (select unnest([cast(9 as double), 18, 24, 28]) as second) k on abs(mf.frame / cast(2 as double) - k.second) <= 0.5
  left join (select second, string_agg(printf('%.3f', conf), ',' order by video_id, frame, pord) as confs from (select *, row_number() over (partition by second order by video_id, frame, pord) as r8 from (
    select k.second, m.*, row_number() over (partition by k.second, video_id, frame order by pord) as r3 from mp m join (select unnest([cast(9 as double), 18, 24, 28]) as second) k on abs(m.frame / cast(2 as double) - k.second) <= 0.5 where geo) where r3 <= 3) where r8 <= 8 group by 1) c using (second) group by k.second""", MF),
        "miss_examples": q(f"select video_id, frame, frame / {num(29.97)} as t, n_moto, n_any from mf where n_geo = 0 order by video_id, frame limit 16", MF),
        "gap_bridge_simple": bridge_sql(),
        "track_jitter": q("select * from jit", POINTS, JITTER),
        "jitter_summary": q(f"select {zero('median(px)')} as jitter_median, {zero('quantile_cont(px, 0.95)')} as jitter_p95, {zero('max(px)')} as jitter_max, count(*) as jitter_samples, {zero('median(rel)')} as size_median, {zero('quantile_cont(rel, 0.95)')} as size_p95 from jit", POINTS, JITTER),
        "track_blinks": q("select video_id, track_id, frame, gap from (select *, lead(frame) over (partition by video_id, track_id order by frame) - frame - 1 as gap from pts) where gap between 1 and 3", POINTS),
        "coverage_summary": q(f"""select {is_('uncovered')} as uncovered, {is_('partial')} as partial, {is_('micro')} as micro_missed, {zero('median("offset")')} as offset_median, {zero('quantile_cont("offset", 0.95)')} as offset_p95, {zero('max("offset")')} as offset_max from cover""", COVER),
        "slot_zone_stats": q(f"select count(distinct (video_id, frame)) as frames_with_zones, count(*) filter (where src <> 'bridge') as observed_zones, count(*) filter (where src = 'bridge') as bridged_zones from ({SLOTS})"),
        "slot_zone_totals": q(f"select count(*) as zones_total, count(distinct (video_id, track_id)) as tracks, (select count(*) from fx_frames) as frames, count(*) / (select cast(count(*) as double) from fx_frames) as zones_per_frame from ({SLOTS})"),
        "fixlist_runs": q(runs),
        "audit_findings": q(f"select video_id, frame, pord, \"var\" > 50 as readable from aud a where conf >= 0.15 and x2 - x1 >= 12 and y2 - y1 >= 6 and not exists (select 1 from fx_plates p where p.pord >= 20 and p.video_id = a.video_id and p.frame = a.frame and {meets('a.', 'p.', 8)})", AUDITED),
        "audit_fixlist": q(f"select video_id, frame, v.x1, v.y1, v.x2, v.y2 from (select video_id, frame, unnest(r) as v from (select video_id, frame, {merge_sql()} as r from aud where conf >= 0.15 and x2 - x1 >= 12 and y2 - y1 >= 6 and \"var\" > 50 group by video_id, frame))", AUDITED),
        "audit_percentiles": q('select count("var") as n, max("var") as max, ' + ", ".join(f'quantile_cont("var", {p}) as p{round(p * 100)}' for p in (0.5, 0.75, 0.9, 0.95, 0.99)) + " from aud", AUDITED),
        "run_summary": q("select f as frames, p as plates, f / cast(12.5 as double) as fps, f / cast(12.5 as double) / 30 as realtime, p / cast(f as double) as plates_per_frame from (select (select count(*) from fx_frames) as f, (select count(*) from fx_plates) as p)"),
        "overlay_counts": q(f"""select video_id, frame, count(*) filter (where src like 'crop%') as crop, count(*) filter (where src = 'sahi') as sahi, count(*) filter (where src = 'bridge') as bridge, count(*) filter (where src like 'crop%' or src = 'sahi') as observed,
  array_to_string(list_sort(list(distinct track_id))[1:6], ',') as tracks from ({SLOTS}) group by all"""),
        "redaction_plan": plan_sql(),
        "draw_list": q(f"""select video_id, frame, 'vehicle' as kind, {box}, printf('%s %.2f', case cls when 2 then 'car' when 3 then 'motorcycle' when 5 then 'bus' when 7 then 'truck' else cast(cls as varchar) end, conf) as label, case when cls = 3 and greatest(x2 - x1, y2 - y1) < {num(P.min_moto_size)} then 'small' else 'vehicle' end as style from fx_vehicles
  union all select video_id, frame, 'zone', {box}, printf('#%d %.2f', track_id, conf), case when src = 'bridge' then 'bridge' else 'observed' end from ({SLOTS})"""),
        "keep_one_in_n": q("select video_id, frame, ord, stratum, kept from kept", STRATA),
        "stratum_counts": q("select stratum, count(*) as n, count(*) filter (where kept) as n_kept from kept group by all", STRATA),
        "crop_budget": q("select phase, video_id, frame, ord from (select case when frame / cast(30 as double) between 0 and 1 then 0 else 1 end as phase, * from kept where kept) order by phase, video_id, frame, ord limit 500", STRATA),
        "export_quota": quota_sql(),
        "best_plate_per_moto": q("select video_id, frame, vord as ord, first(pord order by conf desc, pord) as pord, max(conf) as conf from mp where geo group by all", MP),
        "review_queue": q("select case when pord >= 20 then 0 when pord % 3 = 0 then 2 else 1 end as rank, case when pord % 3 = 0 then 'kept' end as status, count(*) as n, min(printf('v%d_%d_%d', video_id, frame, pord)) as first from fx_plates group by 1, 2"),
        "cache_roundtrip": q(f"select video_id, frame, cast(row_number() over (partition by video_id, frame order by pord) - 1 as int) as pord, {box}, conf, src from fx_plates"),
        "cache_headers": q("select distinct video_id, '1920' as width, true as complete, 'height' as differs from fx_frames"),
        "replay_index": q(f"""select video_id, frame, case when video_id % 2 = 0 and coalesce(s, 0) > 0 then frame + cast(round_even(s * {num(29.97)}, 0) as int) else frame end as at,
  (case when frame % 2 = 0 then cast(0 as double) end is not distinct from s and case when frame % 3 = 0 then cast(5 as double) end is not distinct from cast(5 as double)) or (true and frame % 3 <> 0) as fits from (select video_id, frame, case when video_id % 4 <> 0 then video_id * cast(0.5 as double) + cast(0.25 as double) end as s from fx_frames)"""),
    }
