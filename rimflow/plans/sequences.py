"""State machines over frames (fr) and tracks (tr), written as islands, running windows and ordered folds."""

from __future__ import annotations

from rimflow.config import EngineConfig

from .core import Plan
from .geometry import NEAREST

#: Ball frames with the one before.
_BALL = """
ball as (
  select game_id, frame_id, ball_x, ball_y, rim_x, rim_y, conf,
         lag(ball_x) over (partition by game_id order by frame_id) as px, lag(ball_y) over (partition by game_id order by frame_id) as py
  from <<fr>> f where ball_x is not null
), moved as (
  select *, (ball_x - px) * (ball_x - px) + (ball_y - py) * (ball_y - py) as v2 from ball
)"""


def _thinning(name: str, candidates: str, cooldown: int) -> tuple[str, str]:
    """WITH items that end in `name` (game_id, frame_id): the rows of candidates that lie at least cooldown frames after the last accepted one.

    A candidate that far after the one before it is accepted whatever came earlier, so each run of closer ones is folded by itself. The
    oracle jumps from one accepted row to the next.
    """
    spark = f"""{name}_gaps as (
      select game_id, frame_id, case when frame_id - lag(frame_id) over (partition by game_id order by frame_id) < {cooldown} then 0 else 1 end as fresh from {candidates}
    ), {name}_runs as (
      select game_id, frame_id, sum(fresh) over (partition by game_id order by frame_id) as run from {name}_gaps
    ), {name}_lists as (
      select game_id, run, sort_array(collect_list(frame_id)) as fs from {name}_runs group by game_id, run
    ), {name} as (
      select game_id, explode(s.kept) as frame_id from (
        select game_id, aggregate(fs, named_struct('last', cast(-1000000 as bigint), 'kept', slice(fs, 1, 0)),
               (s, x) -> if(x - s.last >= {cooldown}, named_struct('last', x, 'kept', concat(s.kept, array(x))), s)) as s from {name}_lists) q
    )"""
    duck = f"""{name}_all as (
      select game_id, min(frame_id) as frame_id from {candidates} group by game_id
      union all
      select f.game_id, (select min(c.frame_id) from {candidates} c where c.game_id = f.game_id and c.frame_id >= f.frame_id + {cooldown}) as frame_id from {name}_all f where f.frame_id is not null
    ), {name} as (select game_id, frame_id from {name}_all where frame_id is not null)"""
    return spark, duck


def _both(text: str, result: str, covers: tuple[str, ...], **thinned: tuple[str, str]) -> Plan:
    """A plan whose text has places {name} for the two forms of its thinned items."""
    spark, duck = text, text
    for name, (a, b) in thinned.items():
        spark, duck = spark.replace("{" + name + "}", a), duck.replace("{" + name + "}", b)
    return Plan(f"with {spark} {result}", f"with recursive {duck} {result}", covers)


def plans(C: EngineConfig) -> dict[str, Plan]:
    def _oob(x: str, y: str) -> str:
        edge = C.bounds_inner
        return f"({x} < {edge} or {x} > {C.frame_width - edge} or {y} < {edge} or {y} > {C.frame_height - edge})"

    #: Who holds the ball, and their team (-1: unknown). contact: the nearest player is in reach; an epoch ends when contact is missed for the given frames;
    #: in an epoch a player needs consecutive contact frames, and holds the ball until another has them.
    POSSESSION = (
        NEAREST
        + f""", faced as (
      select f.game_id, f.frame_id, f.ball_x, f.ball_y, n.track_id as who, n.team_id as team, coalesce(n.d2 <= {C.possession_radius**2}, false) as contact
      from (select * from <<fr>> f0 where ball_x is not null) f left join (select * from near where r = 1) n on f.game_id = n.game_id and f.frame_id = n.frame_id
    ), missed as (
      select *, sum(case when contact then 1 else 0 end) over (partition by game_id order by frame_id) as touches from faced
    ), run_length as (
      select *, sum(case when contact then 0 else 1 end) over (partition by game_id, touches order by frame_id) as without from missed
    ), epochs as (
      select *, sum(case when without = {C.possession_loss_frames} then 1 else 0 end) over (partition by game_id order by frame_id) as epoch from run_length
    ), contacts as (
      select *, lag(who) over (partition by game_id, epoch order by frame_id) as last_who from epochs where contact
    ), islands as (
      select *, sum(case when who = last_who then 0 else 1 end) over (partition by game_id, epoch order by frame_id) as island from contacts
    ), confirmed as (
      select game_id, frame_id, case when row_number() over (partition by game_id, epoch, island order by frame_id) >= {C.possession_frames} then who end as sure,
             case when row_number() over (partition by game_id, epoch, island order by frame_id) >= {C.possession_frames} then coalesce(team, -1) end as sure_team from islands
    ), held as (
      select e.game_id, e.frame_id, e.ball_x, e.ball_y, LASTNN[c.sure] over (partition by e.game_id, e.epoch order by e.frame_id rows between unbounded preceding and current row) as holder,
             LASTNN[c.sure_team] over (partition by e.game_id, e.epoch order by e.frame_id rows between unbounded preceding and current row) as team
      from epochs e left join confirmed c on e.game_id = c.game_id and e.frame_id = c.frame_id
    )"""
    )

    #: The same rule for the oracle, frame by frame: candidate and its frames, holder and team, frames without contact.
    _MACHINE = f"""ranked as (
      select f.game_id, f.frame_id, f.ball_x, f.ball_y, t.track_id, t.team_id, (t.cx - f.ball_x) ** 2 + (t.cy - f.ball_y) ** 2 as d2, t.x1, t.y1
      from <<fr>> f left join <<tr>> t on t.game_id = f.game_id and t.frame_id = f.frame_id where f.ball_x is not null
    ), closest as (
      select game_id, frame_id, any_value(ball_x) as ball_x, any_value(ball_y) as ball_y, arg_min(struct_pack(who := track_id, team := team_id, d2 := d2), (d2, track_id, x1, y1)) as c from ranked group by game_id, frame_id
    ), ordered as materialized (
      select game_id, frame_id, ball_x, ball_y, case when c.d2 <= {C.possession_radius**2} then c.who end as who, c.team as team, row_number() over (partition by game_id order by frame_id) as i from closest
    ), machine as (
      select game_id, i, frame_id, ball_x, ball_y, who as cand, case when who is null then 0 else 1 end as n, case when who is null then 1 else 0 end as missed,
             case when {C.possession_frames} <= 1 then who end as holder, case when {C.possession_frames} <= 1 and who is not null then coalesce(team, -1) end as team from ordered where i = 1
      union all
      select game_id, i, frame_id, ball_x, ball_y, cand, n, missed,
             case when missed >= {C.possession_loss_frames} then null when who is not null and n >= {C.possession_frames} then who else holder end,
             case when missed >= {C.possession_loss_frames} then null when who is not null and n >= {C.possession_frames} then coalesce(new_team, -1) else team end
      from (select o.game_id, o.i, o.frame_id, o.ball_x, o.ball_y, o.who, o.team as new_team, m.holder, m.team, case when o.who is null then m.missed + 1 else 0 end as missed,
                   case when o.who is null and m.missed + 1 >= {C.possession_loss_frames} then null else coalesce(o.who, m.cand) end as cand,
                   case when o.who is null then case when m.missed + 1 >= {C.possession_loss_frames} then 0 else m.n end when o.who = m.cand then m.n + 1 else 1 end as n
            from machine m join ordered o on o.game_id = m.game_id and o.i = m.i + 1) x
    ), pairs as (
      select b.*, a.i as a_i, a.holder as a_holder, a.team as a_team, a.ball_x as a_x, a.ball_y as a_y, (select c.holder from machine c where c.game_id = b.game_id and c.i = b.i - 1) as just_before
      from machine b join machine a on a.game_id = b.game_id and a.i = (select max(c.i) from machine c where c.game_id = b.game_id and c.i < b.i and c.holder is not null) where b.holder <> a.holder
    )"""

    _CHANGES = (
        POSSESSION
        + """, numbered as (
      select *, count(*) over (partition by game_id order by frame_id) as nth, case when holder is not null then ball_x end as hx, case when holder is not null then ball_y end as hy from held
    ), gaps as (
      select *, lag(holder) over (partition by game_id order by frame_id) as before, LAGNN[holder] over (partition by game_id order by frame_id) as last_holder, LAGNN[team] over (partition by game_id order by frame_id) as last_team,
             LAGNN[hx] over (partition by game_id order by frame_id) as last_x, LAGNN[hy] over (partition by game_id order by frame_id) as last_y,
             max(case when holder is not null then nth end) over (partition by game_id order by frame_id rows between unbounded preceding and 1 preceding) as last_nth from numbered
    )"""
    )

    #: The ball went to another team, whose player took it from the last holder.
    _LOST = "holder is not null and last_holder is not null and holder <> last_holder and team <> last_team and team >= 0 and last_team >= 0"
    #: ... out of the air, while a pass could still be under way: then it is a steal, else a turnover.
    _STOLEN = f"{_LOST} and before is null and nth - last_nth - 1 <= {C.pass_frames}"
    _TURNOVERS = f"select game_id, frame_id, last_holder as loser, holder as winner from gaps where {_LOST}"
    _STEALS = f"select game_id, frame_id, holder as thief, last_holder as victim, cast(nth - last_nth - 1 as bigint) as flight from gaps where {_STOLEN}"
    # teams that are unknown count as equal
    _PASSES = f"""
    select game_id, frame_id, last_holder as sender, holder as receiver, cast(nth - last_nth - 2 as bigint) as flight from gaps
    where holder is not null and before is null and last_holder is not null and holder <> last_holder and team = last_team
      and (ball_x - last_x) * (ball_x - last_x) + (ball_y - last_y) * (ball_y - last_y) >= {int(C.pass_distance**2)} and nth - last_nth - 1 <= {C.pass_frames + 1}"""

    #: Per frame: is the ball there and falling, does it enter a hoop from above, is it within one.
    _HOOP_FLAGS = """sides as (
      select game_id, max(case when side = 'left' then x end) as lx, max(case when side = 'left' then y end) as ly, max(case when side = 'left' then radius end) as lr,
             max(case when side = 'right' then x end) as rx, max(case when side = 'right' then y end) as ry, max(case when side = 'right' then radius end) as rr from <<ho>> ho group by game_id
    ), stepped as (
      select f.game_id, f.frame_id, ball_x as bx, ball_y as by_, lag(ball_y) over (partition by f.game_id order by f.frame_id) as py, lx, ly, lr, rx, ry, rr
      from <<fr>> f join sides h on f.game_id = h.game_id
    ), flags as (
      select game_id, frame_id, bx is not null as has, coalesce(py < by_, false) as down,
             coalesce(by_ > py and py <= ly and by_ >= ly - 10 and 10 * abs(bx - lx) <= 8 * lr, false) as tl, coalesce(by_ > py and py <= ry and by_ >= ry - 10 and 10 * abs(bx - rx) <= 8 * rr, false) as tr,
             coalesce((bx - lx) * (bx - lx) + (by_ - ly) * (by_ - ly) <= lr * lr, false) as il, coalesce((bx - rx) * (bx - rx) + (by_ - ry) * (by_ - ry) <= rr * rr, false) as ir from stepped
    )"""

    _CROSS = f"""
    crossings as (
      select game_id, frame_id, ball_x, ball_y, (ball_x - rim_x) * (ball_x - rim_x) + (ball_y - rim_y) * (ball_y - rim_y) as r2, abs(ball_x - rim_x) <= {int(C.rim_radius)} as in_x
      from moved where py < rim_y and ball_y >= rim_y
    )"""


    _SCORES = f"{_CROSS}, score_candidates as (select game_id, frame_id from crossings where r2 <= {int(C.rim_radius**2)}), {{scores}}"
    SCORES = _thinning("scores", "score_candidates", C.score_cooldown)

    _SHOTS = f"""rising as (
      select *, ball_y < py and v2 >= {int(C.rise_speed**2)} as up from moved
    ), runs as (
      select *, sum(case when coalesce(up, false) then 0 else 1 end) over (partition by game_id order by frame_id) as run from rising
    ), arcs as (
      select game_id, run, count(case when up then 1 end) as n, min_by(py, case when up then frame_id end) as start_y, min(case when up then ball_y end) as peak_y from runs group by game_id, run
    ), ends as (
      select game_id, run - 1 as run, min(frame_id) as frame_id from runs group by game_id, run
    ), attempts as (
      select a.game_id, e.frame_id, a.n as rising_frames, a.start_y - a.peak_y as arc_height from arcs a join ends e on a.game_id = e.game_id and a.run = e.run
      where a.n >= {C.rise_frames} and a.start_y - a.peak_y >= {int(C.arc_height)}
    )"""

    #: Is a shot under way in a frame: attempted by then and since then no score before this frame.
    _ACTIVE = """marks as (
      select game_id, frame_id, max(attempt) as attempt, max(score) as score from (
        select game_id, frame_id, 1 as attempt, 0 as score from attempts union all select game_id, frame_id, 0 as attempt, 1 as score from scores) u group by game_id, frame_id
    ), followed as (
      select m.*, k.attempt, k.score, max(case when k.attempt = 1 then m.frame_id end) over (partition by m.game_id order by m.frame_id rows between unbounded preceding and current row) as last_attempt,
             max(case when k.score = 1 then m.frame_id end) over (partition by m.game_id order by m.frame_id rows between unbounded preceding and 1 preceding) as last_score
      from moved m left join marks k on m.game_id = k.game_id and m.frame_id = k.frame_id
    ), activity as (
      select *, last_attempt is not null and (last_score is null or last_score < last_attempt) as active from followed
    )"""
    #: A shot that is under way and comes near the rim (twice the radius of a score) without a score misses; one for each attempt. Its team is that of the holder when it was attempted.
    #: The rebound is the first new holder from then on, if soon enough: a holder is new after a frame without one, or after another one.
    _MISSES = f"""near_rim as (
      select game_id, frame_id, last_attempt from activity where active and coalesce(score, 0) = 0 and (ball_x - rim_x) * (ball_x - rim_x) + (ball_y - rim_y) * (ball_y - rim_y) <= {int(4 * C.rim_radius**2)}
    ), misses as (
      select n.game_id, n.last_attempt, n.frame_id, h.holder as shooter, coalesce(h.team, -1) as shot_team from (select game_id, last_attempt, min(frame_id) as frame_id from near_rim group by game_id, last_attempt) n
      left join held h on h.game_id = n.game_id and h.frame_id = n.last_attempt
    ), entered as (
      select g.game_id, g.frame_id, g.holder, g.team, max(m.frame_id) over (partition by g.game_id order by g.frame_id) as miss_frame, LASTNN[m.shot_team] over (partition by g.game_id order by g.frame_id) as miss_team,
             max(case when m.frame_id is not null then m.last_attempt end) over (partition by g.game_id order by g.frame_id) as attempt, coalesce(g.holder is not null and (g.before is null or g.before <> g.holder), false) as new
      from gaps g left join misses m on m.game_id = g.game_id and m.frame_id = g.frame_id
    ), firsts as (
      select *, row_number() over (partition by game_id, miss_frame order by frame_id) as nth from entered where new and miss_frame is not null
    ), rebounds as (
      select game_id, frame_id, holder as track, case when team = miss_team then 'rebound_off' else 'rebound_def' end as etype, miss_frame from firsts
      where nth = 1 and frame_id - miss_frame <= {C.rebound_frames} and miss_team >= 0
    )"""

    _BLOCKS = f"""block_candidates as (
      select a.game_id, a.frame_id from activity a join (select * from near where r = 1) n on a.game_id = n.game_id and a.frame_id = n.frame_id
      where active and v2 >= {int(C.block_speed**2)} and (a.ball_x - rim_x) * (a.ball_x - rim_x) + (a.ball_y - rim_y) * (a.ball_y - rim_y) <= {int(C.block_radius**2)}
    ), {{blocks}}"""
    BLOCKS = _thinning("blocks", "block_candidates", C.block_cooldown)

    #: Why a frame is dead, first reason first: the ball is missing for some frames, out of bounds, still for some frames (the mean
    #: of the last velocities is small, for as many frames again), or seen with low confidence only.
    CONDITIONS = f"""
    seen as (
      select game_id, frame_id, ball_x, ball_y, case when ball_x is null then 0 else 1 end as there, conf,
             count(ball_x) over (partition by game_id order by frame_id) as hits,
             LAGNN[ball_x] over (partition by game_id order by frame_id) as px, LAGNN[ball_y] over (partition by game_id order by frame_id) as py from <<fr>> f
    ), runs as (
      select *, sum(1 - there) over (partition by game_id, hits order by frame_id) as missing,
             round(avg(conf) over (partition by game_id order by frame_id rows between 9 preceding and current row), 9) as conf10,
             count(*) over (partition by game_id order by frame_id rows between 9 preceding and current row) as n10,
             coalesce(sqrt(cast((ball_x - px) * (ball_x - px) + (ball_y - py) * (ball_y - py) as double)), cast(0 as double)) as v from seen
    ), rolled as (
      select *, there = 1 and conf >= {C.min_confidence}
                and count(*) over (partition by game_id order by frame_id rows between {C.still_frames - 1} preceding and current row) = {C.still_frames}
                and round(avg(v) over (partition by game_id order by frame_id rows between {C.still_frames - 1} preceding and current row), 6) < {C.still_pixels} as slow from runs
    ), slowed as (
      select *, sum(case when slow then 0 else 1 end) over (partition by game_id order by frame_id) as breaks from rolled
    ), stilled as (
      select *, sum(case when slow then 1 else 0 end) over (partition by game_id, breaks order by frame_id) as still from slowed
    ), judged as (
      select game_id, frame_id, case when missing >= {C.missing_frames} then 'ball_missing'
             when ball_x < -{C.bounds_outer} or ball_x > {C.frame_width + C.bounds_outer} or ball_y < -{C.bounds_outer} or ball_y > {C.frame_height + C.bounds_outer} then 'out_of_bounds'
             when still >= {C.still_frames} then 'ball_stationary' when n10 = 10 and conf10 < {C.min_confidence / 2} then 'low_confidence' else 'live' end as reason from stilled
    )"""

    SEGMENTS = (
        CONDITIONS
        + f""", marked as (
      select *, case when reason <> 'live' then 1 else 0 end as dead, lag(case when reason <> 'live' then 1 else 0 end) over (partition by game_id order by frame_id) as was from judged
    ), numbered as (
      select *, sum(case when dead = 1 and coalesce(was, 0) = 0 then 1 else 0 end) over (partition by game_id order by frame_id) as seg from marked
    ), segments as (
      select game_id, seg, min(frame_id) as start_frame, max(frame_id) + 1 as end_frame, min_by(reason, frame_id) as reason from numbered where dead = 1 group by game_id, seg
      having max(frame_id) + 1 - min(frame_id) >= {int(C.min_dead_sec * C.fps)}
    )"""
    )

    MERGED = (
        SEGMENTS
        + f""", spaced as (
      select *, case when start_frame - lag(end_frame) over (partition by game_id order by start_frame) <= {C.merge_gap} then 0 else 1 end as new from segments
    ), grouped as (
      select *, sum(new) over (partition by game_id order by start_frame) as grp from spaced
    ), merged as (
      select game_id, grp, greatest(0, min(start_frame) - {C.segment_pad}) as start_frame, max(end_frame) + {C.segment_pad} as end_frame, min_by(reason, start_frame) as reason, count(*) as parts
      from grouped group by game_id, grp having max(end_frame) - min(start_frame) >= {C.min_segment}
    )"""
    )

    found: dict[str, Plan] = {
        "possession": Plan(f"with {POSSESSION} select game_id, frame_id, holder from held", f"with recursive {_MACHINE} select game_id, frame_id, holder from machine", ("T1", "M8")),
        "turnovers": Plan(
            f"with {_CHANGES} {_TURNOVERS}", f"with recursive {_MACHINE} select game_id, frame_id, a_holder as loser, holder as winner from pairs where team <> a_team and least(team, a_team) >= 0", ("T10",)
        ),
        "passes": Plan(
            f"with {_CHANGES} {_PASSES}",
            f"""with recursive {_MACHINE} select game_id, frame_id, a_holder as sender, holder as receiver, i - a_i - 2 as flight from pairs
    where just_before is null and team = a_team and sqrt(((ball_x - a_x) ** 2 + (ball_y - a_y) ** 2)::double) >= {int(C.pass_distance)} and i - a_i <= {C.pass_frames + 2}""",
            ("T8",),
        ),
        "possession_steals": Plan(
            f"with {_CHANGES} {_STEALS}",
            f"with recursive {_MACHINE} select game_id, frame_id, holder as thief, a_holder as victim, i - a_i - 1 as flight from pairs where team <> a_team and least(team, a_team) >= 0 and just_before is null and i - a_i <= {C.pass_frames + 1}",
            ("T9",),
        ),
        "possession_rebounds": _both(
            f"{_CHANGES}, {_BALL}, {_SHOTS}, {_SCORES}, {_ACTIVE}, {_MISSES}", "select game_id, frame_id, track, etype, miss_frame from rebounds", ("T11",), scores=SCORES
        ),
        "shot_attempts": Plan(
            f"with {_BALL}, {_SHOTS} select * from attempts",
            f"""with recursive o as materialized (select game_id, frame_id, ball_x as x, ball_y as y, row_number() over (partition by game_id order by frame_id) as i from <<fr>> f where ball_x is not null),
    m as (
      select game_id, i, frame_id, x, y, 0 as n, 0 as start_y, 0 as peak, 0 as out_n, 0 as out_h from o where i = 1
      union all
      select game_id, i, frame_id, x, y, case when up then n + 1 else 0 end, case when up and n = 0 then py when up then start_y else 0 end, case when up and n = 0 then y when up then least(peak, y) else 0 end,
             case when not up and n >= {C.rise_frames} and start_y - peak >= {int(C.arc_height)} then n else 0 end, start_y - peak
      from (select o.game_id, o.i, o.frame_id, o.x, o.y, m.y as py, m.n, m.start_y, m.peak, o.y < m.y and (o.x - m.x) ** 2 + (o.y - m.y) ** 2 >= {int(C.rise_speed**2)} as up from m join o on o.game_id = m.game_id and o.i = m.i + 1) a
    ) select game_id, frame_id, out_n::bigint as rising_frames, out_h as arc_height from m where out_n > 0""",
            ("T2",),
        ),
        "rim_crossing": Plan(
            f"with {_BALL}, {_CROSS} select game_id, frame_id, r2, in_x from crossings",
            f"""select b.game_id, b.frame_id, cast((b.ball_x - b.rim_x) ** 2 + (b.ball_y - b.rim_y) ** 2 as int) as r2, b.ball_x between b.rim_x - {int(C.rim_radius)} and b.rim_x + {int(C.rim_radius)} as in_x
    from <<fr>> b join <<fr>> a on a.game_id = b.game_id and a.frame_id = (select max(c.frame_id) from <<fr>> c where c.game_id = b.game_id and c.frame_id < b.frame_id and c.ball_x is not null)
    where a.ball_y < b.rim_y and b.rim_y <= b.ball_y""",
            ("F20", "T3"),
        ),
        "cooldown": _both(f"{_BALL}, {_SCORES}", "select game_id, frame_id from scores", ("T3",), scores=SCORES),
        "blocks": _both(
            f"{NEAREST}, {_BALL}, {_SHOTS}, {_SCORES}, {_ACTIVE}, {_BLOCKS}",
            "select b.game_id, b.frame_id, n.track_id as blocker, n.team_id as team from blocks b join near n on b.game_id = n.game_id and b.frame_id = n.frame_id where n.r = 1",
            ("T12",), scores=SCORES, blocks=BLOCKS,
        ),
        # what the frames say: attempts and scores with shooter and points, blocks, passes and turnovers
        "frame_events": _both(
            f"""{_CHANGES}, {_BALL}, {_SHOTS}, {_SCORES}, {_ACTIVE}, {_MISSES}, {_BLOCKS}, known as (
      select a.game_id, a.frame_id, a.attempt, a.score, a.last_attempt, a.active, a.ball_x between {C.three_x} and {C.frame_width - C.three_x} as is_three, h.holder, case when h.holder is not null then h.team end as team,
             LASTNN[h.holder] over (partition by a.game_id order by a.frame_id rows between unbounded preceding and current row) as recent
      from activity a left join held h on a.game_id = h.game_id and a.frame_id = h.frame_id
    ), scored as (
      select s.game_id, s.frame_id, coalesce(case when s.active and exists (select 1 from <<tr>> t where t.game_id = s.game_id and t.frame_id = s.frame_id and t.track_id = a.holder) then a.holder end, s.recent) as track,
             case when s.active then a.is_three else s.is_three end as is_three
      from known s left join known a on s.game_id = a.game_id and s.last_attempt = a.frame_id where s.score = 1
    )""",
            f"""select game_id, frame_id, 'shot_attempt' as etype, holder as track, cast(null as bigint) as other, is_three from known where attempt = 1
    union all select game_id, frame_id, case when is_three then 'score_3pt' else 'score_2pt' end, track, null, is_three from scored
    union all select b.game_id, b.frame_id, 'block', n.track_id, null, false from blocks b join near n on b.game_id = n.game_id and b.frame_id = n.frame_id where n.r = 1
    union all select game_id, frame_id, 'pass', sender, receiver, false from ({_PASSES}) p
    union all select game_id, frame_id, 'shot_miss', shooter, null, false from misses
    union all select game_id, frame_id, etype, track, null, false from rebounds
    union all select game_id, frame_id, 'steal', thief, victim, false from ({_STEALS}) s
    union all select game_id, frame_id, 'turnover', last_holder, holder, false from gaps where {_LOST} and not ({_STOLEN})""",
            ("T21", "J19"), scores=SCORES, blocks=BLOCKS,
        ),
        # a ball that falls into a hoop, or stays in it for some frames while falling; then a pause
        "hoop_entry": Plan(
            f"""with {_HOOP_FLAGS}, l as (select game_id, sort_array(collect_list(struct(frame_id, has, down, tl, tr, il, ir))) as fs from flags group by game_id)
    select game_id, e.frame_id, e.side, e.method from (
      select game_id, explode(aggregate(fs, named_struct('cd', 0, 'dl', 0, 'dr', 0, 'out', cast(array() as array<struct<frame_id: bigint, side: string, method: string>>)), (s, x) -> case
        when s.cd > 0 then named_struct('cd', s.cd - 1, 'dl', s.dl, 'dr', s.dr, 'out', s.out)
        when not x.has then s
        when x.tl then named_struct('cd', {C.hoop_cooldown}, 'dl', s.dl, 'dr', s.dr, 'out', concat(s.out, array(named_struct('frame_id', x.frame_id, 'side', 'left', 'method', 'trajectory'))))
        when x.il and s.dl + 1 >= {C.hoop_dwell} and x.down then named_struct('cd', {C.hoop_cooldown}, 'dl', 0, 'dr', s.dr, 'out', concat(s.out, array(named_struct('frame_id', x.frame_id, 'side', 'left', 'method', 'dwell'))))
        when x.tr then named_struct('cd', {C.hoop_cooldown}, 'dl', if(x.il, s.dl + 1, 0), 'dr', s.dr, 'out', concat(s.out, array(named_struct('frame_id', x.frame_id, 'side', 'right', 'method', 'trajectory'))))
        when x.ir and s.dr + 1 >= {C.hoop_dwell} and x.down then named_struct('cd', {C.hoop_cooldown}, 'dl', if(x.il, s.dl + 1, 0), 'dr', 0, 'out', concat(s.out, array(named_struct('frame_id', x.frame_id, 'side', 'right', 'method', 'dwell'))))
        else named_struct('cd', 0, 'dl', if(x.il, s.dl + 1, 0), 'dr', if(x.ir, s.dr + 1, 0), 'out', s.out) end, s -> s.out)) as e from l) q""",
            f"""with recursive {_HOOP_FLAGS}, o as (select *, row_number() over (partition by game_id order by frame_id) as r from flags),
    f as (
      select game_id, 0::bigint as r, 0 as cd, 0 as dl, 0 as dr, null::bigint as frame_id, null::varchar as side, null::varchar as method from o where r = 1
      union all
      select game_id, r, case when cd > 0 then cd - 1 when fire is not null then {C.hoop_cooldown} else 0 end,
             case when cd > 0 or not has or fire = 1 then dl when fire = 2 then 0 when il then dl + 1 else 0 end,
             case when cd > 0 or not has or fire in (1, 2, 3) then dr when fire = 4 then 0 when ir then dr + 1 else 0 end,
             case when fire is not null then frame_id end, case when fire in (1, 2) then 'left' when fire in (3, 4) then 'right' end, case when fire in (1, 3) then 'trajectory' when fire in (2, 4) then 'dwell' end
      from (select o.game_id, o.r, o.frame_id, o.has, o.il, o.ir, f.cd, f.dl, f.dr,
                   case when f.cd > 0 or not o.has then null when o.tl then 1 when o.il and f.dl + 1 >= {C.hoop_dwell} and o.down then 2 when o.tr then 3 when o.ir and f.dr + 1 >= {C.hoop_dwell} and o.down then 4 end as fire
            from f join o on f.game_id = o.game_id and o.r = f.r + 1) a
    ) select game_id, frame_id, side, method from f where frame_id is not null""",
            covers=("F21", "C5", "T15"),
        ),
        "ball_kinematics": Plan(
            f"""with {_BALL}, s as (select *, sqrt(cast(v2 as double)) as speed from moved), k as (
      select *, avg(speed) over (partition by game_id order by frame_id rows between 4 preceding and current row) as mean5,
             lag(ball_x, 3) over (partition by game_id order by frame_id) as x3, lag(ball_y, 3) over (partition by game_id order by frame_id) as y3 from s
    )
    select game_id, frame_id, speed, v2 > 4 as moving, round(degrees(atan2(cast(ball_y - py as double), cast(ball_x - px as double))), 6) as angle, 2 * ball_x - px as next_x, 2 * ball_y - py as next_y,
           round(mean5, 6) as speed5, round(mean5, 6) > {C.flight_speed} as in_flight, sqrt(cast((ball_x - x3) * (ball_x - x3) + (ball_y - y3) * (ball_y - y3) as double)) as moved3
    from k where px is not null""",
            """with b as (select game_id, frame_id, ball_x as x, ball_y as y, row_number() over (partition by game_id order by frame_id) as i from <<fr>> f where ball_x is not null),
    d as (select b.*, b.x - a.x as dx, b.y - a.y as dy from b join b a on a.game_id = b.game_id and a.i = b.i - 1)
    select d.game_id, d.frame_id, sqrt((d.dx ** 2 + d.dy ** 2)::double) as speed, d.dx ** 2 + d.dy ** 2 > 4 as moving, round(atan2(d.dy::double, d.dx::double) * 180 / pi(), 6) as angle, d.x + d.dx as next_x, d.y + d.dy as next_y,
           round((select avg(sqrt((e.dx ** 2 + e.dy ** 2)::double)) from d e where e.game_id = d.game_id and e.i between d.i - 4 and d.i), 6) as speed5,
           round((select avg(sqrt((e.dx ** 2 + e.dy ** 2)::double)) from d e where e.game_id = d.game_id and e.i between d.i - 4 and d.i), 6) > FLIGHT as in_flight,
           (select sqrt(((d.x - c.x) ** 2 + (d.y - c.y) ** 2)::double) from b c where c.game_id = d.game_id and c.i = d.i - 3) as moved3
    from d""".replace("FLIGHT", str(C.flight_speed)),
            covers=("P11", "P12", "P13", "W10", "W12", "M15"),
        ),
        "ball_gate": Plan(f"with {_BALL} select game_id, frame_id, case when v2 is null or v2 <= {C.ball_gate**2} then 'near' when conf >= {C.min_confidence} then 'sure' else 'dropped' end as verdict from moved", covers=("F13",)),
        "arc_detect": Plan(
            f"""with w as (select game_id, frame_id, collect_list(ball_y) over (partition by game_id order by frame_id rows between {C.arc_window - 1} preceding and current row) as ys from <<fr>> f where ball_x is not null)
    select game_id, frame_id, array_max(ys) - array_min(ys) >= {C.arc_min_height} and array_position(ys, array_min(ys)) between 2 and size(ys) - 1 as arc from w where size(ys) >= {C.arc_least}""",
            f"""with b as (select game_id, frame_id, ball_y, row_number() over (partition by game_id order by frame_id) as n from <<fr>> f where ball_x is not null),
    w as (select a.game_id, a.frame_id, a.n, b.n as m, b.ball_y from b a join b on a.game_id = b.game_id and b.n between a.n - {C.arc_window - 1} and a.n),
    s as (select game_id, frame_id, n, count(*) as c, min(ball_y) as top, max(ball_y) as base, min_by(m, cast(ball_y as bigint) * 1000000 + m) as pos, min(m) as first_m from w group by game_id, frame_id, n)
    select game_id, frame_id, base - top >= {C.arc_min_height} and pos > first_m and pos < n as arc from s where c >= {C.arc_least}""",
            covers=("W11",),
        ),
        "moving_average": Plan("select game_id, frame_id, avg(ball_x) over (partition by game_id order by frame_id rows between 4 preceding and current row) as x5 from <<fr>> f", covers=("W9",)),
        "detection_rate": Plan(
            """with s as (select game_id, frame_id, ball_x is not null as hit, count(ball_x) over (partition by game_id order by frame_id) as hits from <<fr>> f),
    m as (select game_id, hits, count(case when not hit then 1 end) as missed, count(*) as n, count(case when hit then 1 end) as found from s group by game_id, hits)
    select game_id, cast(sum(found) as double) / cast(sum(n) as double) as rate, max(missed) as longest_miss from m group by game_id""",
            covers=("A30", "W21"),
        ),
        "dead_conditions": Plan(
            f"with {CONDITIONS} select game_id, frame_id, reason from judged",
            f"""with recursive o as materialized (select game_id, frame_id, ball_x as x, ball_y as y, conf, row_number() over (partition by game_id order by frame_id) as i from <<fr>> f),
    steps as materialized (select b.*, case when b.x is null or a.x is null then 0.0 else sqrt(((b.x - a.x) ** 2 + (b.y - a.y) ** 2)::double) end as v
      from o b left join o a on a.game_id = b.game_id and a.i = (select max(c.i) from o c where c.game_id = b.game_id and c.i < b.i and c.x is not null)),
    slow as materialized (select s.game_id, s.i, s.frame_id, s.x, s.y, coalesce(s.x is not null and s.conf >= {C.min_confidence} and s.i >= {C.still_frames}
        and round((select avg(w.v) from steps w where w.game_id = s.game_id and w.i between s.i - {C.still_frames - 1} and s.i), 6) < {C.still_pixels}, false) as slow,
        s.i >= 10 and round((select avg(w.conf) from steps w where w.game_id = s.game_id and w.i between s.i - 9 and s.i), 9) < {C.min_confidence / 2} as dim from steps s),
    m as (
      select game_id, i, frame_id, x, y, dim, case when x is null then 1 else 0 end as missing, case when slow then 1 else 0 end as still from slow where i = 1
      union all
      select s.game_id, s.i, s.frame_id, s.x, s.y, s.dim, case when s.x is null then m.missing + 1 else 0 end, case when s.slow then m.still + 1 else 0 end from m join slow s on s.game_id = m.game_id and s.i = m.i + 1
    ) select game_id, frame_id, case when missing >= {C.missing_frames} then 'ball_missing'
        when x not between -{C.bounds_outer} and {C.frame_width + C.bounds_outer} or y not between -{C.bounds_outer} and {C.frame_height + C.bounds_outer} then 'out_of_bounds'
        when still >= {C.still_frames} then 'ball_stationary' when dim then 'low_confidence' else 'live' end as reason from m""",
            ("W19", "W20", "W21"),
        ),
        "dead_segments": Plan(f"with {SEGMENTS} select game_id, seg, start_frame, end_frame, reason from segments", covers=("T14",)),
        "dead_merge": Plan(f"with {MERGED} select game_id, grp, start_frame, end_frame, reason, parts from merged", covers=("W16", "M9")),
        "dead_summary": Plan(
            f"with {SEGMENTS} select game_id, reason, count(*) as n, cast(sum(end_frame - start_frame) as bigint) as frames from segments group by rollup (game_id, reason)", covers=("A14", "M9")
        ),
        # the latest end of all segments that have begun by a frame
        "live_mask": Plan(
            f"""with {MERGED}, u as (
      select game_id, start_frame as frame_id, 0 as kind, end_frame from merged union all select game_id, frame_id, 1 as kind, null as end_frame from <<fr>> f
    ), m as (select game_id, frame_id, kind, max(end_frame) over (partition by game_id order by frame_id, kind rows between unbounded preceding and current row) as until from u)
    select game_id, frame_id from m where kind = 1 and (until is null or frame_id >= until)""",
            f"with {MERGED} select f.game_id, f.frame_id from <<fr>> f left join merged m on f.game_id = m.game_id and f.frame_id >= m.start_frame and f.frame_id < m.end_frame where m.grp is null",
            covers=("F16", "F17", "J17"),
        ),
        # dead from a frame that sets it on, as long as every frame after it holds it
        "dead_state": Plan(
            f"""with a as (
      select game_id, frame_id, ball_x as bx, ball_y as by_, scored, coalesce({_oob('ball_x', 'ball_y')}, false) as oob,
             coalesce(frame_id - max(case when scored then frame_id end) over (partition by game_id order by frame_id rows between unbounded preceding and current row) < {C.dead_after_score}, false) as fresh from <<fr>> f
    ), b as (
      select *, last_value(case when not (fresh or oob) then named_struct('x', bx, 'y', by_) end, true) over (partition by game_id order by frame_id rows between unbounded preceding and 1 preceding) as p from a
    ), c as (
      select *, bx is not null and p.x is not null as has, coalesce((bx - p.x) * (bx - p.x) + (by_ - p.y) * (by_ - p.y) < {C.rest_pixels**2}, false) as slow from b
    ), d as (
      select *, sum(case when not (fresh or oob) and has and not slow then 1 else 0 end) over (partition by game_id order by frame_id) as moves from c
    ), e as (
      select *, sum(case when not (fresh or oob) and has and slow then 1 else 0 end) over (partition by game_id, moves order by frame_id) as still from d
    ), g as (
      select *, max(case when scored or (oob and not fresh) or (not (fresh or oob) and has and still >= {C.rest_frames}) then frame_id end) over (partition by game_id order by frame_id) as set_at,
             max(case when not (fresh or oob or not has or slow) then frame_id end) over (partition by game_id order by frame_id) as freed_at from e
    ), h as (
      select *, coalesce(lag(set_at is not null and (freed_at is null or freed_at <= set_at)) over (partition by game_id order by frame_id), false) as was from g
    )
    select game_id, frame_id, fresh or oob or scored or (has and still >= {C.rest_frames}) or (was and (not has or slow)) as dead from h""",
            f"""with recursive o as (select game_id, frame_id, ball_x as bx, ball_y as by_, scored, row_number() over (partition by game_id order by frame_id) as r from <<fr>> f),
    f as (
      select game_id, 0::bigint as r, -1::bigint as frame_id, -1000000::bigint as sa, null::int as px, null::int as py, 0 as still, false as dead, false as said from o where r = 1
      union all
      select game_id, r, frame_id, sa, case when early then px else bx end, case when early then py else by_ end, still2,
             scored or (oob and frame_id - sa >= {C.dead_after_score}) or (not early and has and still2 >= {C.rest_frames}) or (dead and (early or not has or slow)),
             early or scored or (has and still2 >= {C.rest_frames}) or (dead and (not has or slow))
      from (select *, frame_id - sa < {C.dead_after_score} or oob as early, case when frame_id - sa < {C.dead_after_score} or oob or not has then still when slow then still + 1 else 0 end as still2
            from (select o.game_id, o.r, o.frame_id, o.bx, o.by_, o.scored, f.px, f.py, f.still, f.dead, case when o.scored then o.frame_id else f.sa end as sa,
                         coalesce({_oob('o.bx', 'o.by_')}, false) as oob, o.bx is not null and f.px is not null as has,
                         coalesce((o.bx - f.px) * (o.bx - f.px) + (o.by_ - f.py) * (o.by_ - f.py) < {C.rest_pixels**2}, false) as slow
                  from f join o on f.game_id = o.game_id and o.r = f.r + 1) a) b
    ) select game_id, frame_id, said as dead from f where r > 0""",
            covers=("T13",),
        ),
    }

    # how long play was dead and how long it went on
    dead = found["dead_state"]
    time = "select game_id, count(*) as frames, count(case when dead then 1 end) as dead_frames, cast(count(case when dead then 1 end) as double) / FPS as dead_seconds, cast(count(case when not dead then 1 end) as double) / FPS as live_seconds from ds group by game_id"
    time = time.replace("FPS", str(C.fps))
    found["game_time"] = Plan(f"with ds as ({dead.sql}) {time}", f"with ds as ({dead.oracle}) {time}", ("A27", "P21"))
    return found
