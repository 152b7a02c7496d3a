"""Boxes, points, zones and matching as plans over detections (de), tracks (tr), frames (fr) and vectors (vec)."""

from __future__ import annotations

from rimflow.config import EngineConfig

from .core import Plan

_INTER = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_AREAS = "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))"

#: The court polygons' edges, from their vertices (game_id, k, x, y) in order; the last one leads to the first. A null game stands for those without a polygon of their own.
_EDGES = """
edges as (
  select game_id, x as ax, y as ay, coalesce(lead(x) over w, first_value(x) over w) as bx, coalesce(lead(y) over w, first_value(y) over w) as by_ from <<po>> po
  window w as (partition by game_id order by k)
)"""


def _with_edges(rows: str) -> str:
    """rows with es, the edges of their game's polygon or else of the common one (of one row)."""
    return f"""(select r.*, coalesce(o.es, c.es) as es from {rows} r
      left join (select game_id as og, collect_list(struct(ax, ay, bx, by_)) as es from edges where game_id is not null group by game_id) o on r.game_id = o.og
      cross join (select collect_list(struct(ax, ay, bx, by_)) as es from edges where game_id is null) c)"""


def _inside(x: str, y: str) -> str:
    """Ray casting in whole numbers: the edges to the right of a point, of the array of _with_edges, are odd in number."""
    crosses = f"(e.ay > {y}) <> (e.by_ > {y}) and ({x} - e.ax) * (e.by_ - e.ay) * sign(e.by_ - e.ay) < ({y} - e.ay) * (e.bx - e.ax) * sign(e.by_ - e.ay)"
    return f"size(filter(es, e -> {crosses})) % 2 = 1"


def _inside_joined(x: str, y: str) -> str:
    """The same as a count over rows, for the oracle."""
    return f"""(select count(*) from edges e where e.game_id is not distinct from OWN and ((e.ay <= {y} and e.by_ > {y} and ({x} - e.ax) * (e.by_ - e.ay) < ({y} - e.ay) * (e.bx - e.ax))
      or (e.ay > {y} and e.by_ <= {y} and ({x} - e.ax) * (e.by_ - e.ay) > ({y} - e.ay) * (e.bx - e.ax)))) % 2 = 1"""


#: Nearest player of each frame that has a ball.
NEAREST = """
near as (
  select f.game_id, f.frame_id, f.ball_x, f.ball_y, t.track_id, t.team_id, t.jersey,
         (t.cx - f.ball_x) * (t.cx - f.ball_x) + (t.cy - f.ball_y) * (t.cy - f.ball_y) as d2,
         row_number() over (partition by f.game_id, f.frame_id order by (t.cx - f.ball_x) * (t.cx - f.ball_x) + (t.cy - f.ball_y) * (t.cy - f.ball_y), t.track_id, t.x1, t.y1) as r
  from <<fr>> f join <<tr>> t on f.game_id = t.game_id and f.frame_id = t.frame_id where f.ball_x is not null
)"""

_TKEY = "concat_ws('-', cast(t.track_id as STR), cast(t.x1 as STR), cast(t.y1 as STR), cast(t.y2 as STR))"
_DKEY = "concat_ws('-', cast(d.k1 as STR), cast(d.k2 as STR), cast(d.k3 as STR))"
_DX, _DY = "(t.cx - (d.x1 + d.x2) // 2)", "(t.cy - (d.y1 + d.y2) // 2)"


def _pairs(near: str) -> str:
    """Tracks and detections of a frame whose centres are near each other."""
    return f"""
pairs as (
  select t.game_id, t.frame_id, {_DX} * {_DX} + {_DY} * {_DY} as d2, t.track_id, d.k1, d.k2, d.k3, {_TKEY} as tkey, {_DKEY} as dkey
  from <<tr>> t join <<de>> d on t.game_id = d.game_id and t.frame_id = d.frame_id where {near}
)"""


def _greedy(pairs: str, order: str, result: str) -> Plan:
    """One to one by greed: of all pairs of a frame, in the given order, each that has both sides free."""
    spark = f"""with {pairs}, l as (select game_id, frame_id, sort_array(collect_list(struct({order}, tkey as tk, dkey as dk, d2 as dd))) as ps from pairs group by game_id, frame_id)
    select {result} from (
      select game_id, frame_id, p.tk as tkey, p.dk as dkey, p.dd as d2 from (
        select game_id, frame_id, explode(aggregate(ps, slice(ps, 1, 0), (kept, b) -> if(exists(kept, a -> a.tk = b.tk or a.dk = b.dk), kept, concat(kept, array(b))))) as p from l) x) y"""
    duck = f"""with recursive {pairs}, o as (select *, row_number() over (partition by game_id, frame_id order by {order}, tkey, dkey) as r from pairs),
    f as (
      select game_id, frame_id, r, [tkey] as ts, [dkey] as ds, true as took from o where r = 1
      union all
      select o.game_id, o.frame_id, o.r, case when list_contains(f.ts, o.tkey) or list_contains(f.ds, o.dkey) then f.ts else list_append(f.ts, o.tkey) end,
             case when list_contains(f.ts, o.tkey) or list_contains(f.ds, o.dkey) then f.ds else list_append(f.ds, o.dkey) end,
             not (list_contains(f.ts, o.tkey) or list_contains(f.ds, o.dkey))
      from f join o on f.game_id = o.game_id and f.frame_id = o.frame_id and o.r = f.r + 1
    )
    select {result} from (select o.game_id, o.frame_id, o.tkey, o.dkey, o.d2 from f join o on f.game_id = o.game_id and f.frame_id = o.frame_id and f.r = o.r where f.took) y"""
    return Plan(spark, duck)


#: Appearance distance: one minus Pearson's correlation of two vectors.
_VECTORS = """v as (select game_id, vec_id, transform(embedding, x -> cast(x as double)) as e from <<vec>> vec),
    s as (select *, size(e) as n, aggregate(e, cast(0 as double), (a, x) -> a + x) as sx, aggregate(e, cast(0 as double), (a, x) -> a + x * x) as sxx from v),
    u as (select game_id, vec_id, transform(embedding, x -> cast(x as double)) as e from <<sel>> sel),
    p as (select *, size(e) as n, aggregate(e, cast(0 as double), (a, x) -> a + x) as sx, aggregate(e, cast(0 as double), (a, x) -> a + x * x) as sxx from u)"""
_PEARSON = """1 - (s.n * aggregate(zip_with(s.e, p.e, (x, y) -> x * y), cast(0 as double), (a, x) -> a + x) - s.sx * p.sx)
             / sqrt((s.n * s.sxx - s.sx * s.sx) * (p.n * p.sxx - p.sx * p.sx))"""
_PEARSON_ROWS = """
      select s.game_id, s.vec_id, p.vec_id as ref, 1 - c.r as dist
      from <<vec>> s join <<sel>> p on s.game_id = p.game_id, lateral (select corr(x::double, y::double) as r from (select unnest(s.embedding) as x, unnest(p.embedding) as y)) c"""


def plans(C: EngineConfig) -> dict[str, Plan]:
    W, H = C.frame_width, C.frame_height
    # near the basket that is attacked, and at the other end
    near, far = f"ball_x < {C.three_x}", f"ball_x > {W - C.three_x}"
    if not C.attacking_left:
        near, far = far, near
    own = lambda t: f"(case when {t}.game_id in (select p.game_id from <<po>> p) then {t}.game_id end)"
    m, c = C.zone_margin, C.zone_cell
    found: dict[str, Plan] = {
        "scan_prefix_stride": Plan(f"""select game_id, frame_id, class_name, x1, y1, x2, y2 from <<de>> de where frame_id % {max(1, int(C.fps / C.scan_rate))} = 0
    and frame_id - {C.frames_before_game} * game_id <= {min(int(C.scan_seconds * C.fps), C.max_frames or int(C.scan_seconds * C.fps))}""", covers=("S3", "S4")),
        "det_filter": Plan(
            f"select game_id, frame_id, k1, k2, k3, class_name, conf from <<de>> de where (class_name = 'ball' and conf >= {C.min_detection_ball} or class_name = 'rim' and conf >= {C.min_detection}) and x2 - x1 >= {C.ocr_width} and y2 - y1 >= {C.ocr_height}",
            covers=("S5", "F3", "F4", "F23"),
        ),
        "player_scan": Plan(
            f"select game_id, frame_id, k1, k2, k3, conf, x1, y1, x2, y2 from <<de>> de where class_name = 'player' and conf >= {C.min_detection}",
            f"select * exclude (class_name, class_id) from <<de>> de where not (class_name in ('ball', 'rim') or conf < {C.min_detection})", covers=("S6",),
        ),
        "bbox_geom": Plan(
            f"""select game_id, frame_id, k1, k2, k3, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) as area, (x1 + x2) // 2 as cx, (y1 + y2) // 2 as cy, y2 as feet_y, x2 - x1 as w, y2 - y1 as h,
           greatest(x1 - 10, 0) as ex1, greatest(y1 - 10, 0) as ey1, least(x2 + 10, {W}) as ex2, least(y2 + 10, {H}) as ey2, x1 * 2 as sx1, y1 * 3 as sy1 from <<de>> de""",
            covers=("P1", "P2", "P3", "P7", "P8", "P9", "M16", "P19"),
        ),
        "iou_pairs": Plan(
            f"""select a.game_id, a.frame_id, a.track_id, a.x1 as tx1, a.y1 as ty1, a.y2 as ty2, b.k1, b.k2, b.k3, cast({_INTER} as double) / ({_AREAS} - {_INTER}) as iou
    from <<tr>> a join <<de>> b on a.game_id = b.game_id and a.frame_id = b.frame_id where {_INTER} > 0""",
            """with o as (
      select t.game_id, t.frame_id, t.track_id, t.x1 as tx1, t.y1 as ty1, t.y2 as ty2, k1, k2, k3, (t.x2 - t.x1) * (t.y2 - t.y1) as ta, (d.x2 - d.x1) * (d.y2 - d.y1) as da,
             case when t.x2 < d.x2 then t.x2 else d.x2 end - case when t.x1 > d.x1 then t.x1 else d.x1 end as w, case when t.y2 < d.y2 then t.y2 else d.y2 end - case when t.y1 > d.y1 then t.y1 else d.y1 end as h
      from <<tr>> t, <<de>> d where t.frame_id = d.frame_id and t.game_id = d.game_id)
    select game_id, frame_id, track_id, tx1, ty1, ty2, k1, k2, k3, (w * h)::double / (ta + da - w * h)::double as iou from o where w > 0 and h > 0""",
            covers=("P4", "J2"),
        ),
        "nearest_player": Plan(f"with {NEAREST} select game_id, frame_id, track_id, sqrt(cast(d2 as double)) as dist, d2 <= {C.possession_radius**2} as in_reach from near where r = 1", covers=("J1", "J3", "P5")),
        "possession_changes": Plan(
            f"""with {NEAREST}, held as (
      select game_id, frame_id, track_id, team_id, lag(track_id) over (partition by game_id order by frame_id) as before from near where r = 1 and d2 <= {C.possession_radius**2}
    )
    select game_id, team_id, count(*) as changes from held where before is null or before <> track_id group by game_id, team_id""",
            covers=("A13", "T16"),
        ),
        "zone_lookup": Plan(
            # a zone stands in every cell of a grid that it touches, so points meet the zones of their cell only
            f"""with z1 as (select *, explode(sequence((x1 - {m}) div {c}, (x2 + {m}) div {c})) as gx from <<zo>> z0), z2 as (select *, explode(sequence((y1 - {m}) div {c}, (y2 + {m}) div {c})) as gy from z1), hit as (
      select t.game_id, t.frame_id, t.track_id, t.x1, t.y1, t.y2, z.name, struct((z.x2 - z.x1) * (z.y2 - z.y1) as area, z.k) as rank
      from <<tr>> t join z2 z on t.cx div {c} = z.gx and t.cy div {c} = z.gy
      where t.cx between z.x1 - {m} and z.x2 + {m} and t.cy between z.y1 - {m} and z.y2 + {m} and (z.game_id is null or z.game_id = t.game_id)
    )
    select game_id, frame_id, track_id, x1, y1, y2, min_by(name, rank) as zone, count(*) as zones from hit group by game_id, frame_id, track_id, x1, y1, y2""",
            f"""select game_id, frame_id, track_id, x1, y1, y2, zone, zones from (
      select t.*, z.name as zone, count(*) over w as zones, row_number() over (w order by (z.x2 - z.x1) * (z.y2 - z.y1), z.k) as r
      from <<tr>> t, <<zo>> z where z.x1 - {C.zone_margin} <= cx and cx <= z.x2 + {C.zone_margin} and z.y1 - {C.zone_margin} <= cy and cy <= z.y2 + {C.zone_margin} and (z.game_id is null or z.game_id = t.game_id)
      window w as (partition by t.game_id, frame_id, track_id, t.x1, t.y1, t.y2)) q where r = 1""",
            covers=("J12", "P6", "M14", "U4"),
        ),
        "player_height_filter": Plan(
            f"with {_EDGES} select game_id, frame_id, k1, k2, k3 from {_with_edges("<<de>>")} d where (y2 - y1) * 100 between 12 * {H} and 95 * {H} and {_inside('((x1 + x2) div 2)', 'y2')}",
            f"with {_EDGES} select game_id, frame_id, k1, k2, k3 from <<de>> d where (y2 - y1) * 100 between 12 * {H} and 95 * {H} and {_inside_joined('((d.x1 + d.x2) // 2)', 'd.y2').replace('OWN', own('d'))}",
            covers=("F1",),
        ),
        "point_in_poly": Plan(
            f"with {_EDGES} select game_id, frame_id, track_id, cx, cy, y1, {_inside('cx', 'cy')} as inside from {_with_edges("<<tr>>")} t",
            f"with {_EDGES} select game_id, frame_id, track_id, cx, cy, y1, {_inside_joined('t.cx', 't.cy').replace('OWN', own('t'))} as inside from <<tr>> t", covers=("F2",),
        ),
        "out_of_bounds": Plan(
            f"""select game_id, frame_id, ball_x < {C.bounds_inner} or ball_x > {W - C.bounds_inner} or ball_y < {C.bounds_inner} or ball_y > {H - C.bounds_inner} as near_edge,
           ball_x < -{C.bounds_outer} or ball_x > {W + C.bounds_outer} or ball_y < -{C.bounds_outer} or ball_y > {H + C.bounds_outer} as far_out from <<fr>> fr where ball_x is not null""",
            covers=("F14", "F15"),
        ),
        "court_zone": Plan(
            f"""select game_id, seq, case when {far} then 'backcourt' when {near} then case when ball_x < {C.paint_x} and ball_y > {C.paint_y} then 'paint' else 'mid_range' end else 'three_point' end as zone,
           not ({near} or {far}) as is_three from <<ge>> ge""",
            f"""with b as (select *, case when ball_x < {C.three_x} then 'left' when ball_x > {W - C.three_x} then 'right' end as band from <<ge>> ge)
    select game_id, seq, case when band is null then 'three_point' when band <> '{"left" if C.attacking_left else "right"}' then 'backcourt'
             when ball_x between 0 and {C.paint_x - 1} and ball_y >= {C.paint_y + 1} then 'paint' else 'mid_range' end as zone, band is null as is_three from b""",
            covers=("C1", "C2"),
        ),
        "court_zone_calibrated": Plan(
            """with h as (
      select game_id, max(case when side = 'left' then x end) as lx, max(case when side = 'left' then y end) as ly, max(case when side = 'right' then x end) as rx, max(case when side = 'right' then y end) as ry
      from <<ho>> ho group by game_id
    ), d as (
      select g.game_id, seq, ball_x, (ball_x - lx) * (ball_x - lx) + (ball_y - ly) * (ball_y - ly) as dl, (ball_x - rx) * (ball_x - rx) + (ball_y - ry) * (ball_y - ry) as dr,
             (lx + rx) // 2 as half, cast((rx - lx) * (rx - lx) as bigint) as c2 from <<ge>> g join h on g.game_id = h.game_id
    ), o as (select *, cast(10000 as bigint) * case when ball_x < half then dl else dr end as own from d)
    select game_id, seq, case when dl < dr then 'left' else 'right' end as hoop, case when own <= 81 * c2 then 'paint' when own <= 784 * c2 then 'mid_range' else 'three_point' end as zone,
           cast(10000 as bigint) * least(dl, dr) >= 784 * c2 as is_three from o""",
            """with d as (
      select g.game_id, g.seq, h.side, sqrt(((g.ball_x - h.x) ** 2 + (g.ball_y - h.y) ** 2)::double) as dist, g.ball_x < sum(h.x) over w // 2 as west, (max(h.x) over w - min(h.x) over w)::double as court
      from <<ge>> g join <<ho>> h on g.game_id = h.game_id window w as (partition by g.game_id, g.seq)
    )
    select game_id, seq, case when max(case when side = 'left' then dist end) < max(case when side = 'right' then dist end) then 'left' else 'right' end as hoop,
           case when max(case when (side = 'left') = west then dist / court end) <= 0.09 then 'paint' when max(case when (side = 'left') = west then dist / court end) <= 0.28 then 'mid_range' else 'three_point' end as zone,
           min(dist / court) >= 0.28 as is_three from d group by game_id, seq""",
            covers=("C3", "C4", "J16"),
        ),
        "team_side": Plan(f"select game_id, frame_id, track_id, x1, y1, y2, case when cx * 2 < {W} then 0 else 1 end as team from <<tr>> tr", covers=("C6",)),
        # the first free detection of each track, tracks and detections in their order
        "band_join": _greedy(_pairs(f"abs({_DX}) < {C.write_back_reach} and abs({_DY}) < {C.write_back_reach}"), "track_id, k1, k2, k3", "game_id, frame_id, tkey, dkey").claims("J7"),
        "heatmap": Plan(f"select game_id, cx // {C.heat_cell} as gx, cy // {C.heat_cell} as gy, count(*) as n from <<tr>> tr where cx between 0 and {W - 1} and cy between 0 and {H - 1} group by game_id, cx // {C.heat_cell}, cy // {C.heat_cell}", covers=("A15",)),
        "heatmap_norm": Plan(
            f"""with h as (select game_id, cx // {C.heat_cell} as gx, cy // {C.heat_cell} as gy, count(*) as n from <<tr>> tr where cx between 0 and {W - 1} and cy between 0 and {H - 1} group by game_id, cx // {C.heat_cell}, cy // {C.heat_cell}),
    e as (select *, min(n) over (partition by game_id) as lo, max(n) over (partition by game_id) as hi from h)
    select game_id, gx, gy, cast(255 * (n - lo) // greatest(1, hi - lo) as bigint) as level from e""",
            covers=("K13",),
        ),
        "nms": Plan(
            """with l as (select game_id, frame_id, sort_array(collect_list(struct(-conf as o, k1, k2, k3, x1, y1, x2, y2))) as ds from <<de>> de where class_name = 'player' group by game_id, frame_id)
    select game_id, frame_id, d.k1, d.k2, d.k3 from (
      select game_id, frame_id, explode(aggregate(ds, slice(ds, 1, 0), (kept, b) -> if(exists(kept, a -> 20L * INTER > 9L * (AREAS - INTER)), kept, concat(kept, array(b))))) as d from l) x""".replace("INTER", _INTER).replace("AREAS", _AREAS),
            """with recursive o as (
      select game_id, frame_id, k1, k2, k3, x1, y1, x2, y2, row_number() over (partition by game_id, frame_id order by -conf, k1, k2, k3) as r from <<de>> de where class_name = 'player'
    ), f as (
      select game_id, frame_id, 1::bigint as r, [{'r': r, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] as kept from o where r = 1
      union all
      select b.game_id, b.frame_id, b.r, case when len(list_filter(f.kept, lambda a: 20 * INTER > 9 * (AREAS - INTER))) > 0 then f.kept
                                   else list_append(f.kept, {'r': b.r, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}) end
      from f join o b on f.game_id = b.game_id and f.frame_id = b.frame_id and b.r = f.r + 1
    ), last as (select game_id, frame_id, max_by(kept, r) as kept from f group by game_id, frame_id)
    select o.game_id, o.frame_id, o.k1, o.k2, o.k3 from o join last l on o.game_id = l.game_id and o.frame_id = l.frame_id where list_contains(list_transform(l.kept, lambda a: a.r), o.r)""".replace("INTER", _INTER).replace("AREAS", _AREAS),
            covers=("O6",),
        ),
        # nearest pairs first
        "assign_greedy": _greedy(_pairs(f"{_DX} * {_DX} + {_DY} * {_DY} <= {C.match_reach**2}"), "d2", "game_id, frame_id, tkey, dkey, d2").claims("J5", "J6"),
        # one row for each selected player and frame: the candidate that looks most like them, if it is near enough
        "appearance_match": Plan(
            f"""with {_VECTORS}, m as (
      select s.game_id, s.vec_id, p.vec_id as ref, {_PEARSON} as dist from s join p on s.game_id = p.game_id
    )
    select game_id, ref, min_by(vec_id, dist) as vec_id, round(min(dist), 6) as dist from m where dist <= {C.appearance_max} group by game_id, ref""",
            f"""with m as ({_PEARSON_ROWS})
    select game_id, ref, vec_id, round(dist, 6) as dist from (select *, row_number() over (partition by game_id, ref order by dist) as r from m where dist <= {C.appearance_max}) q where r = 1""",
            covers=("J13", "C8"),
        ),
        "appearance_classify": Plan(
            f"""with {_VECTORS}, m as (
      select s.game_id, s.vec_id, p.vec_id as ref, {_PEARSON} as dist from s join p on s.game_id = p.game_id
    )
    select game_id, vec_id, min_by(ref, dist) as ref, round(min(dist), 6) as dist from m group by game_id, vec_id""",
            f"""with m as ({_PEARSON_ROWS})
    select game_id, vec_id, ref, round(dist, 6) as dist from (select *, row_number() over (partition by game_id, vec_id order by dist) as r from m) q where r = 1""",
            covers=("C7",),
        ),
        "team_centroid": Plan(
            """with e as (select vec_id, i, cast(x as double) as x from <<emb>> vec lateral view posexplode(embedding) t as i, x),
    seed as (select i, max(case when vec_id = 0 then x end) as c0, max(case when vec_id = 1 then x end) as c1 from e where vec_id < 2 group by i),
    d as (select vec_id, sum((x - c0) * (x - c0)) as d0, sum((x - c1) * (x - c1)) as d1 from e join seed using (i) group by vec_id)
    select case when d1 < d0 then 1 else 0 end as team, count(*) as n, round(sum(least(d0, d1)), 3) as inertia from d group by case when d1 < d0 then 1 else 0 end""",
            """with e as (select vec_id, unnest(generate_series(0, len(embedding) - 1)) as i, unnest(embedding)::double as x from embeddings),
    seed as (select i, max(case when vec_id = 0 then x end) as c0, max(case when vec_id = 1 then x end) as c1 from e where vec_id < 2 group by i),
    d as (select vec_id, sum((x - c0) * (x - c0)) as d0, sum((x - c1) * (x - c1)) as d1 from e join seed using (i) group by vec_id)
    select case when d1 < d0 then 1 else 0 end as team, count(*) as n, round(sum(least(d0, d1)), 3) as inertia from d group by case when d1 < d0 then 1 else 0 end""",
        ),
        # of each frame the surest rim, of the last ten such frames the medians, from five on
        "rim_median": Plan(
            f"""with best as (select game_id, frame_id, x1, y1, x2, y2, row_number() over (partition by game_id, frame_id order by conf desc, o) as r from <<ri>> ri),
    w as (select game_id, frame_id, {", ".join(f"sort_array(collect_list({c}) over (partition by game_id order by frame_id rows between {C.rim_frames - 1} preceding and current row)) as {c}" for c in ("x1", "y1", "x2", "y2"))} from best where r = 1)
    select game_id, frame_id, {", ".join(f"cast({c}[(size({c}) - 1) div 2] + {c}[size({c}) div 2] as double) / 2 as {c}" for c in ("x1", "y1", "x2", "y2"))} from w where size(x1) >= {max(1, C.rim_frames // 2)}""",
            f"""with best as (select game_id, frame_id, arg_min(x1, (-conf, o)) as x1, arg_min(y1, (-conf, o)) as y1, arg_min(x2, (-conf, o)) as x2, arg_min(y2, (-conf, o)) as y2 from <<ri>> ri group by game_id, frame_id),
    w as (select game_id, frame_id, {", ".join(f"cast(median({c}) over w as double) as {c}" for c in ("x1", "y1", "x2", "y2"))}, count(*) over w as n
          from best window w as (partition by game_id order by frame_id rows between {C.rim_frames - 1} preceding and current row))
    select game_id, frame_id, x1, y1, x2, y2 from w where n >= {max(1, C.rim_frames // 2)}""",
            covers=("A24",),
        ),
        # hoops are the medians of the rims left and right of the middle; one side alone is mirrored when it has ten
        "auto_calibration": Plan(
            f"""with s as (
      select game_id, case when x1 + x2 < {W} then 0 else 1 end as side, cast(x1 + x2 as double) / 2 as x, cast(y1 + y2 as double) / 2 as y from <<ri>> ri
    ), m as (
      select game_id, count(*) as n, count(case when side = 0 then 1 end) as nl, count(case when side = 1 then 1 end) as nr, {", ".join(f"cast(floor(median(case when side = {k} then {c} end)) as int) as {n}{c}" for k, n in ((0, "l"), (1, "r")) for c in "xy")}
      from s group by game_id
    )
    select game_id, case when nl >= 5 and nr >= 5 or nl >= 10 then lx else {W} - rx end as left_x, case when nl >= 5 and nr >= 5 or nl >= 10 then ly else ry end as left_y,
           case when nl >= 5 and nr >= 5 or nl < 10 then rx else {W} - lx end as right_x, case when nl >= 5 and nr >= 5 or nl < 10 then ry else ly end as right_y
    from m where n >= 20 and (nl >= 5 and nr >= 5 or nl >= 10 or nr >= 10)""",
            f"""with m as (
      select game_id, count(*) filter (where x1 + x2 < {W}) as nl, count(*) filter (where x1 + x2 >= {W}) as nr,
             trunc(median((x1 + x2) / 2) filter (where x1 + x2 < {W}))::int as lx, trunc(median((y1 + y2) / 2) filter (where x1 + x2 < {W}))::int as ly,
             trunc(median((x1 + x2) / 2) filter (where x1 + x2 >= {W}))::int as rx, trunc(median((y1 + y2) / 2) filter (where x1 + x2 >= {W}))::int as ry
      from <<ri>> ri group by game_id having count(*) >= 20
    )
    select game_id, lx as left_x, ly as left_y, rx as right_x, ry as right_y from m where nl >= 5 and nr >= 5
    union all select game_id, lx, ly, {W} - lx, ly from m where nl >= 10 and nr < 5
    union all select game_id, {W} - rx, ry, rx, ry from m where nr >= 10 and nl < 5""",
            covers=("A25", "M13"),
        ),
        "scan_players": Plan(
            f"""select game_id, track_id, appearances, best_frame, row_number() over (partition by game_id order by appearances desc, track_id) as place from (
      select game_id, track_id, count(*) as appearances, max_by(frame_id, cast((x2 - x1) * (y2 - y1) as bigint) * 1000000000 - frame_id) as best_frame from <<tr>> tr where y2 - y1 >= {C.min_height} group by game_id, track_id) x where appearances >= {C.min_appearances}""",
            covers=("A26", "F11", "O5", "K12"),
        ),
        "ocr_candidates": Plan(
            """with c as (select game_id, frame_id, track, o, conf, regexp_replace(text, '[^0-9]', 'ALL') as number from <<oc>> oc)
    select game_id, frame_id, track, max_by(number, cast(conf as bigint) * 1000000000 + o % 1000000000) as number, max(conf) as conf from c where conf >= 30 and length(number) between 1 and 2 group by game_id, frame_id, track""",
            covers=("F12", "A18", "O9"),
        ),
        # of the last 25 readings the number with most of the weight; the first time that its share suffices decides for good
        "jersey_vote": Plan(
            f"""with r as (select game_id, track, number, conf, row_number() over (partition by game_id, track order by frame_id, o) as i from <<oc>> oc where conf > 0),
    l as (select game_id, track, i, collect_list(struct(number, conf)) over (partition by game_id, track order by i rows between {C.jersey_readings - 1} preceding and current row) as w from r),
    v as (select game_id, track, i, aggregate(w, 0L, (a, x) -> a + x.conf) as total, array_max(transform(array_distinct(transform(w, x -> x.number)),
            n -> struct(aggregate(filter(w, x -> x.number = n), 0L, (a, x) -> a + x.conf) as weight, n as number))) as best from l where size(w) >= {C.jersey_least}),
    ok as (select *, row_number() over (partition by game_id, track order by i) as nth from v where 100 * best.weight >= {C.jersey_share} * total)
    select game_id, track, best.number as number, best.weight as weight, total, cast(i as bigint) as reading from ok where nth = 1""",
            f"""with r as (select game_id, track, number, conf, row_number() over (partition by game_id, track order by frame_id, o) as i from <<oc>> oc where conf > 0),
    p as (select a.game_id, a.track, a.i, b.number, sum(b.conf) as weight, count(*) as n from r a join r b on a.game_id = b.game_id and a.track = b.track and b.i between a.i - {C.jersey_readings - 1} and a.i group by all),
    t as (select *, sum(weight) over (partition by game_id, track, i) as total, sum(n) over (partition by game_id, track, i) as readings from p),
    ok as (select *, row_number() over (partition by game_id, track order by i, weight desc, number desc) as nth from t where readings >= {C.jersey_least} and 100 * weight >= {C.jersey_share} * total)
    select game_id, track, number, weight::bigint as weight, total::bigint as total, i as reading from ok where nth = 1""",
            covers=("A16", "M10"),
        ),
        "jersey_vote_count": Plan(
            """with w as (select game_id, track, number, count(*) as n from <<oc>> oc group by game_id, track, number),
    t as (select *, sum(n) over (partition by game_id, track) as total from w)
    select game_id, track, number, n, cast(total as bigint) as total from t where n >= 3 and 10 * n >= 6 * total""",
            covers=("A17",),
        ),
        # readings that gave a number, of all readings
        "ocr_success": Plan(
            "select game_id, count(*) as readings, count(case when conf >= 30 and length(number) between 1 and 2 then 1 end) as successes, cast(count(case when conf >= 30 and length(number) between 1 and 2 then 1 end) as double) / count(*) as rate from <<oc>> oc group by game_id",
            "select game_id, count(*) as readings, sum(ok) as successes, avg(ok) as rate from (select game_id, (conf >= 30 and len(number) in (1, 2))::int as ok from <<oc>> oc) q group by game_id".replace("sum(ok)", "sum(ok)::bigint"),
            covers=("A19",),
        ),
        "team_vote": Plan(
            """with w as (select game_id, track_id, team_id, count(*) as n, min(frame_id) as first_frame from <<tr>> tr group by game_id, track_id, team_id)
    select game_id, track_id, team_id, n from (select *, row_number() over (partition by game_id, track_id order by n desc, first_frame, team_id) as r from w) x where r = 1""",
            covers=("A20", "T19", "M19"),
        ),
        "ocr_budget": Plan(
            f"""with u as (select game_id, frame_id, track_id, x1, y1, y2, row_number() over (partition by game_id, frame_id order by track_id, x1, y1, y2) - 1 as i, count(*) over (partition by game_id, frame_id) as n from <<tr>> tr where jersey is null)
    select game_id, frame_id, track_id, x1, y1, y2 from u where (i - (frame_id // {C.ocr_every}) % n + n) % n < {C.ocr_tracks} and frame_id % {C.ocr_every} = 0""",
            covers=("O7",),
        ),
    }
    matched = found["assign_greedy"]
    sides = f"""select u.game_id, u.frame_id, tkey, dkey from (
      select t.game_id, t.frame_id, {_TKEY} as tkey, cast(null as STR) as dkey from <<tr>> t union all select d.game_id, d.frame_id, null as tkey, {_DKEY} as dkey from <<de>> d) u
    where not exists (select 1 from (MATCHED) m where m.game_id = u.game_id and m.frame_id = u.frame_id and (m.tkey = u.tkey or m.dkey = u.dkey))"""
    # tracks without a detection, and detections without a track
    found["unmatched"] = Plan(
        f"""with m as ({matched.sql}), t as (select game_id, frame_id, {_TKEY} as tkey from <<tr>> t), d as (select game_id, frame_id, {_DKEY} as dkey from <<de>> d)
    select t.game_id, t.frame_id, t.tkey, cast(null as STR) as dkey from t left anti join m on t.game_id = m.game_id and t.frame_id = m.frame_id and t.tkey = m.tkey
    union all select d.game_id, d.frame_id, null, d.dkey from d left anti join m on d.game_id = m.game_id and d.frame_id = m.frame_id and d.dkey = m.dkey""",
        sides.replace("MATCHED", matched.oracle), ("J6",),
    )
    candidates = found["ocr_candidates"]
    found["ocr_candidates"] = Plan(candidates.sql.replace(", 'ALL')", ", '')"), candidates.sql.replace(", 'ALL')", ", '', 'g')"), candidates.covers)
    return found
