"""Player, team and game statistics as plans over game events (input ge)."""

from __future__ import annotations

from rimflow.config import EVENT_TYPES, RATING_HUNDREDTHS, EngineConfig

from .core import Plan


def _case(values: dict, of: str = "etype", default: str = "0") -> str:
    return f"case {of} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {default} end"


#: Every field-goal result: scores as they are, misses with the attempt that they resolve (the last one since the last result).
RESULTS = """
numbered as (
  select *, sum(case when etype in ('score_2pt', 'score_3pt', 'shot_miss') then 1 else 0 end)
              over (partition by game_id order by seq rows between unbounded preceding and 1 preceding) as done
  from <<ge>> ge
), pended as (
  select *, max(case when etype = 'shot_attempt' then seq end)
              over (partition by game_id, coalesce(done, 0) order by seq rows between unbounded preceding and 1 preceding) as ref_seq
  from numbered
), results as (
  select p.game_id, p.seq, p.frame_id, p.etype, p.ref_seq,
         case when p.etype = 'shot_miss' and a.seq is not null then a.p_track else p.p_track end as track,
         case when p.etype = 'shot_miss' and a.seq is not null then a.p_jersey else p.p_jersey end as jersey,
         case when p.etype = 'shot_miss' and a.seq is not null then a.p_team else p.p_team end as team,
         case when p.etype = 'shot_miss' and a.seq is not null then a.ball_x else p.ball_x end as x,
         case when p.etype = 'shot_miss' and a.seq is not null then a.ball_y else p.ball_y end as y,
         case when p.etype = 'shot_miss' and a.seq is not null then a.zone else p.zone end as zone,
         p.etype <> 'shot_miss' as made,
         case when p.etype <> 'shot_miss' then p.etype = 'score_3pt'
              when a.seq is not null then a.is_three or coalesce(a.zone, '') = 'three_point'
              else p.is_three or coalesce(p.zone, '') = 'three_point' end as three
  from pended p left join (select * from <<ge>> g2 where etype = 'shot_attempt') a on p.game_id = a.game_id and p.ref_seq = a.seq
  where p.etype in ('score_2pt', 'score_3pt', 'shot_miss')
)"""

#: One row for each thing that an event credits to a player; a steal credits two.
ACTIONS = RESULTS + """, actions as (
  select game_id, seq, track, jersey, team, etype as what, made, three from results
  union all
  select game_id, seq, p_track, p_jersey, p_team, etype, false, false from <<ge>> g3
  where etype in ('free_throw_made', 'free_throw_miss', 'rebound_off', 'rebound_def', 'steal', 'turnover', 'assist', 'pass', 'block', 'foul')
  union all
  select game_id, seq, s_track, s_jersey, s_team, 'turnover', false, false from <<ge>> g4 where etype = 'steal'
)"""

_COUNTS = """
         cast(sum(case when what in ('score_2pt', 'score_3pt') then case when three then 3 else 2 end when what = 'free_throw_made' then 1 else 0 end) as bigint) as points,
         cast(sum(case when made then 1 else 0 end) as bigint) as fg_makes,
         cast(sum(case when what in ('score_2pt', 'score_3pt', 'shot_miss') then 1 else 0 end) as bigint) as fg_attempts,
         cast(sum(case when made and three then 1 else 0 end) as bigint) as fg3_makes,
         cast(sum(case when three then 1 else 0 end) as bigint) as fg3_attempts,
         cast(sum(case when what = 'free_throw_made' then 1 else 0 end) as bigint) as ft_makes,
         cast(sum(case when what in ('free_throw_made', 'free_throw_miss') then 1 else 0 end) as bigint) as ft_attempts,
         cast(sum(case when what = 'rebound_off' then 1 else 0 end) as bigint) as offensive_rebounds,
         cast(sum(case when what = 'rebound_def' then 1 else 0 end) as bigint) as defensive_rebounds,
         cast(sum(case when what = 'assist' then 1 else 0 end) as bigint) as assists,
         cast(sum(case when what = 'turnover' then 1 else 0 end) as bigint) as turnovers,
         cast(sum(case when what = 'pass' then 1 else 0 end) as bigint) as passes,
         cast(sum(case when what = 'steal' then 1 else 0 end) as bigint) as steals,
         cast(sum(case when what = 'block' then 1 else 0 end) as bigint) as blocks,
         cast(sum(case when what = 'foul' then 1 else 0 end) as bigint) as fouls"""

PLAYERS = ACTIONS + f""", players as (
  select game_id, track, min_by(team, seq) as team, min_by(jersey, case when jersey is not null then seq end) as jersey, min(seq) as first_seq,{_COUNTS}
  from actions group by game_id, track
)"""

TEAMS = PLAYERS + """, teams as (
  select game_id, team, """ + ", ".join(
    f"cast(sum({c}) as bigint) as {c}"
    for c in "points fg_makes fg_attempts fg3_makes fg3_attempts ft_makes ft_attempts offensive_rebounds defensive_rebounds assists turnovers passes steals blocks fouls".split()
) + """ from players group by game_id, team
)"""  # fmt: skip


def share(top: str, bottom: str, digits: int = 1000, least: str = "1") -> str:
    """top / bottom rounded half up to thousandths (by whole numbers, so that engines agree), 0 below `least`."""
    return f"case when {bottom} < {least} then cast(0 as double) else cast((2 * {digits} * ({top}) + ({bottom})) // (2 * ({bottom})) as double) / {digits} end"


def rates(least: str = "1") -> str:
    rating = " + ".join(
        f"({v}) * {'(offensive_rebounds + defensive_rebounds)' if k == 'rebounds' else k}" for k, v in RATING_HUNDREDTHS.items()
    )
    return f"""offensive_rebounds + defensive_rebounds as total_rebounds,
       {share('fg_makes', 'fg_attempts', least=least)} as fg_pct, {share('fg3_makes', 'fg3_attempts', least=least)} as fg3_pct,
       {share('ft_makes', 'ft_attempts', least=least)} as ft_pct, {share('2 * fg_makes + fg3_makes', '2 * fg_attempts')} as effective_fg_pct,
       {share('100 * points', '200 * fg_attempts + 88 * ft_attempts')} as true_shooting_pct,
       case when turnovers = 0 then cast(assists as double) else {share('assists', 'turnovers', 100)} end as assist_to_turnover,
       cast({rating} as double) / 100 as per_rating"""


def _display(top: str, bottom: str) -> str:
    """A percentage with one digit as text."""
    tenths = f"cast((2000 * ({top}) + ({bottom})) // (2 * greatest(1, {bottom})) as bigint)"
    return f"case when {bottom} = 0 then '0.0%' else concat(cast({tenths} // 10 as STR), '.', cast({tenths} % 10 as STR), '%') end"


_POINTS = "case etype when 'score_3pt' then 3 when 'score_2pt' then 2 when 'free_throw_made' then 1 else 0 end"

def plans(C: EngineConfig) -> dict[str, Plan]:
    PERIOD = int(C.period_sec * C.fps)

    #: Attempts of each player in order, for runs and hot hands.
    _TRIES = RESULTS + f""", tries as (
      select game_id, track, seq, made,
             count(*) over (partition by game_id, track order by seq rows between {C.hot_window - 1} preceding and current row) as n5,
             sum(case when made then 1 else 0 end) over (partition by game_id, track order by seq rows between {C.hot_window - 1} preceding and current row) as makes5,
             count(*) over (partition by game_id, track order by seq rows between {C.hot_window} preceding and 1 preceding) as n_before,
             sum(case when made then 1 else 0 end) over (partition by game_id, track order by seq rows between {C.hot_window} preceding and 1 preceding) as makes_before
      from results
    )"""
    _HOT = f"n5 >= {C.hot_window} and makes5 >= {C.hot_makes}"

    SCORED = _TRIES + f""", weighed as (
      select g.*, {_case(C.highlight)} as base,
             coalesce(t.n_before >= {C.hot_window} and t.makes_before >= {C.hot_makes}, false) and g.etype in ('score_2pt', 'score_3pt') as hot
      from <<ge>> g left join tries t on g.game_id = t.game_id and g.seq = t.seq and t.made
    ), combos as (
      select game_id, seq, count(*) over (partition by game_id order by seq rows between {C.combo_window} preceding and 1 preceding) as recent
      from weighed where base > 0
    ), scored as (
      select w.game_id, w.seq, w.frame_id, w.etype, w.p_track, w.p_jersey, w.p_team, w.ball_x, w.ball_y,
             case when w.base <= 0 then cast(w.base as double)
                  else cast(w.base as double) + {C.combo_bonus} * greatest(0, coalesce(c.recent, 0) - 1) + case when w.hot then {C.hot_bonus} else 0 end end as score
      from weighed w left join combos c on w.game_id = c.game_id and w.seq = c.seq
    )"""
    # literals such as 2.0 are decimals: cast them once, here
    SCORED = SCORED.replace(f"{C.combo_bonus} *", f"cast({C.combo_bonus} as double) *").replace(f"then {C.hot_bonus} else 0 end end", f"then cast({C.hot_bonus} as double) else 0 end end")

    # points so far of each event's team and of all
    _RUNNING = f"""points as (
      select game_id, seq, frame_id, etype, p_team, {_POINTS} as pts,
             sum({_POINTS}) over (partition by game_id, p_team order by seq) as team_score, sum({_POINTS}) over (partition by game_id order by seq) as all_points
      from <<ge>> ge
    )"""

    #: The same for teams 0 and 1 side by side, for oracles.
    _TWO_TEAMS = f"""points as (
      select game_id, seq, frame_id, etype, p_team, sum(case when p_team = 0 then {_POINTS} else 0 end) over (partition by game_id order by seq) as score0,
             sum(case when p_team = 1 then {_POINTS} else 0 end) over (partition by game_id order by seq) as score1, min(p_team) over (partition by game_id) as t0 from <<ge>> ge
    )"""

    _LOGGED = "row_number() over (partition by game_id order by seq desc)"

    found: dict[str, Plan] = {
        "event_counts": Plan("select game_id, etype, n, row_number() over (partition by game_id order by n desc, etype) as place from (select game_id, etype, count(*) as n from <<ge>> ge group by game_id, etype) x", covers=("A1", "O10")),
        "pending_shot": Plan(
            f"with {RESULTS} select game_id, seq, etype, ref_seq, track, team, zone, three from results",
            """with done as materialized (select * from <<ge>> g where etype in ('score_2pt', 'score_3pt', 'shot_miss')),
    tied as (
      select d.*, (select max(t.seq) from <<ge>> t where t.game_id = d.game_id and t.etype = 'shot_attempt' and t.seq < d.seq
                   and t.seq > coalesce((select max(e.seq) from done e where e.game_id = d.game_id and e.seq < d.seq), -1)) as ref_seq from done d
    )
    select d.game_id, d.seq, d.etype, d.ref_seq, coalesce(t.p_track, d.p_track) as track, case when t.seq is null then d.p_team else t.p_team end as team,
           case when t.seq is null then d.zone else t.zone end as zone, case d.etype when 'score_3pt' then true when 'score_2pt' then false else coalesce(t.is_three, d.is_three) or (case when t.seq is null then d.zone else t.zone end) is not distinct from 'three_point' end as three
    from tied d left join <<ge>> t on t.game_id = d.game_id and t.seq = d.ref_seq and d.etype = 'shot_miss'""",
            ("J18", "T18", "C11"),
        ),
        "player_stats": Plan(f"with {PLAYERS} select * from players", covers=("A2", "A3", "A4", "A5", "T22", "U2")),
        "team_totals": Plan(
            f"with {TEAMS} select *, {share('100 * points', 'greatest(100, 100 * fg_attempts - 100 * offensive_rebounds + 100 * turnovers + 44 * ft_attempts)')} as points_per_possession, {rates()} from teams",
            covers=("A8", "A10", "A12", "J11", "M7"),
        ),
        "advanced_rates": Plan(f"with {PLAYERS} select game_id, track, {rates()} from players", covers=("A9", "C9")),
        "shooting_pct": Plan(f"with {PLAYERS} select game_id, team, {share('sum(fg_makes)', 'sum(fg_attempts)')} as fg_pct, {_display('sum(fg_makes)', 'sum(fg_attempts)')} as shown from players group by game_id, team", covers=("P14", "P24")),
        "box_score": Plan(
            f"""with {PLAYERS}
    select game_id, team, coalesce(nullif(jersey, ''), cast(track as STR)) as player, points,
           concat_ws('/', cast(fg_makes as STR), cast(fg_attempts as STR)) as fg, concat_ws('/', cast(fg3_makes as STR), cast(fg3_attempts as STR)) as fg3,
           concat_ws('/', cast(ft_makes as STR), cast(ft_attempts as STR)) as ft, offensive_rebounds + defensive_rebounds as rebounds, assists, steals, blocks,
           turnovers, fouls, row_number() over (partition by game_id, team order by points desc, first_seq, track) as place
    from players""",
            covers=("O1", "P20", "S14", "K3"),
        ),
        "top_players": Plan(
            f"""with {PLAYERS}, ranked as (
      select game_id, track, points, offensive_rebounds + defensive_rebounds as rebounds, assists,
             row_number() over (partition by game_id order by points desc, first_seq, track) as r1,
             row_number() over (partition by game_id order by offensive_rebounds + defensive_rebounds desc, first_seq, track) as r2,
             row_number() over (partition by game_id order by assists desc, first_seq, track) as r3
      from players
    )
    select game_id, max(case when r1 = 1 then track end) as top_scorer, max(case when r2 = 1 then track end) as top_rebounder, max(case when r3 = 1 then track end) as top_passer
    from ranked group by game_id""",
            covers=("O2", "U7"),
        ),
        "leading_team": Plan(f"with {TEAMS} select game_id, min_by(team, -points * 1000 + team) as team, max(points) as points from teams group by game_id", covers=("O3",)),
        "zone_shooting": Plan(
            f"""with {RESULTS}
    select game_id, track, zone, count(*) as attempts, cast(sum(case when made then 1 else 0 end) as bigint) as makes, {share('sum(case when made then 1 else 0 end)', 'count(*)')} as pct
    from results where zone is not null and zone <> '' group by game_id, track, zone""",
            covers=("A6", "M4"),
        ),
        "zone_summary": Plan(
            f"""with {RESULTS}
    select game_id, team, coalesce(nullif(zone, ''), 'unknown') as zone, count(*) as attempts, cast(sum(case when made then 1 else 0 end) as bigint) as makes
    from results group by game_id, team, coalesce(nullif(zone, ''), 'unknown')""",
            covers=("A7",),
        ),
        "shot_chart": Plan(
            f"""with {RESULTS}
    select game_id, seq, frame_id, track, team, jersey, cast((2 * 10000 * cast(x as bigint) + {C.frame_width}) // (2 * {C.frame_width}) as double) / 10000 as x,
           cast((2 * 10000 * cast(y as bigint) + {C.frame_height}) // (2 * {C.frame_height}) as double) / 10000 as y, made, three as is_three, zone
    from results where x is not null""",
            covers=("P10", "F8", "M6"),
        ),
        "hot_hand": Plan(
            f"""with {_TRIES}, latest as (select *, row_number() over (partition by game_id, track order by seq desc) as r from tries)
    select game_id, track, seq, makes5, {_HOT} as is_hot from latest where r = 1""",
            covers=("W1", "F9"),
        ),
        "shot_streaks": Plan(
            f"""with {_TRIES}, runs as (
      select *, sum(case when made then 0 else 1 end) over (partition by game_id, track order by seq) as misses,
             sum(case when made then 1 else 0 end) over (partition by game_id, track order by seq) as makes from tries
    )
    select game_id, track, seq,
           cast(sum(case when made then 1 else 0 end) over (partition by game_id, track, misses order by seq) as bigint) as consecutive_makes,
           cast(sum(case when made then 0 else 1 end) over (partition by game_id, track, makes order by seq) as bigint) as consecutive_misses
    from runs""",
            covers=("W2",),
        ),
        "highlight_score": Plan(f"with {SCORED} select game_id, seq, etype, score from scored", covers=("W3", "W4", "U3")),
        "player_highlight": Plan(f"with {SCORED} select game_id, p_track, sum(score) as highlight_score, count(*) as n from scored group by game_id, p_track", covers=("M5",)),
        "top_moments": Plan(
            f"""with {SCORED}, ranked as (select *, row_number() over (partition by game_id order by score desc, seq) as place from scored where score >= {int(C.moment_score)})
    select game_id, place, seq, frame_id, etype, score, p_track, p_jersey, p_team, ball_x, ball_y from ranked where place <= {C.top_moments}""",
            covers=("O4", "M6"),
        ),
        # every event of the game makes a team's momentum decay; its own also add to it and round it
        "momentum": Plan(
            f"""with d as (
      select game_id, seq, p_team, cast({_case(C.momentum)} as double) as delta from <<ge>> ge
    ), o as (
      select game_id, p_team as team, delta, row_number() over (partition by game_id order by seq) as k, count(*) over (partition by game_id) as n from d where delta <> 0 and p_team is not null
    ), lists as (select game_id, team, max(n) as n, sort_array(collect_list(struct(k, delta))) as es from o group by game_id, team),
    folded as (
      select game_id, team, n, aggregate(es, named_struct('k', cast(0 as bigint), 'm', cast(0 as double)), (a, e) -> named_struct(
               'k', cast(e.k as bigint), 'm', round(aggregate(sequence(a.k + 1, e.k), a.m, (x, i) -> x * cast({C.momentum_decay} as double)) + e.delta, 3))) as s from lists
    )
    select game_id, team, if(s.k = n, s.m, aggregate(sequence(s.k + 1, n), s.m, (x, i) -> x * cast({C.momentum_decay} as double))) as momentum, n from folded""",
            f"""with recursive d as (
      select game_id, seq, p_team, cast({_case(C.momentum)} as double) as delta from <<ge>> ge
    ), o as (select *, row_number() over (partition by game_id order by seq) as k, count(*) over (partition by game_id) as n from d where delta <> 0 and p_team is not null),
    f as (
      select distinct game_id, p_team as team, 0::bigint as k, n, 0.0::double as m from o
      union all
      select f.game_id, f.team, o.k, o.n, case when o.p_team = f.team then round(f.m * {C.momentum_decay}::double + o.delta, 3) else f.m * {C.momentum_decay}::double end as m
      from f join o on f.game_id = o.game_id and o.k = f.k + 1
    )
    select game_id, team, m as momentum, n from f where k = n""",
            covers=("W5",),
        ),
        "scoring_runs": Plan(
            f"""with s as (
      select game_id, seq, p_team, {_POINTS} as pts from <<ge>> ge where etype in ('score_2pt', 'score_3pt')
    ), b as (select *, case when p_team = lag(p_team) over (partition by game_id order by seq) then 0 else 1 end as new from s),
    g as (select *, sum(new) over (partition by game_id order by seq) as run from b)
    select game_id, run, min(p_team) as team, min(seq) as first_seq, max(seq) as last_seq, cast(sum(pts) as bigint) as points, count(*) as baskets from g group by game_id, run""",
            covers=("W6",),
        ),
        "score_history": Plan(
            f"with {_RUNNING} select game_id, seq, frame_id, p_team, cast(team_score as bigint) as team_score from points where etype in ('score_2pt', 'score_3pt')",
            f"with {_TWO_TEAMS} select game_id, seq, frame_id, p_team, cast(case when p_team = 0 then score0 else score1 end as bigint) as team_score from points where etype in ('score_2pt', 'score_3pt')",
            covers=("W7",),
        ),
        # any number of teams: a row for each event and team of the game; ties lead the smaller team
        "lead_changes": Plan(
            # only baskets move a score; what comes before the first one is a draw, which the smallest team leads
            f"""with p as (select game_id, seq, p_team, {_POINTS} as pts, min(seq) over (partition by game_id) as first_seq from <<ge>> ge),
    teams as (select game_id, p_team as team, min(p_team) over (partition by game_id) as smallest from (select distinct game_id, p_team from p where p_team is not null) d),
    s as (select b.game_id, b.seq, b.first_seq, t.team, t.smallest, sum(case when b.p_team = t.team then pts else 0 end) over (partition by b.game_id, t.team order by b.seq) as score
          from (select * from p where pts > 0) b join teams t on b.game_id = t.game_id),
    r as (select *, row_number() over (partition by game_id, seq order by score desc, team) as place from s),
    l as (select game_id, seq, max(case when seq > first_seq then smallest end) as drawn, max(case when place = 1 then team end) as leader, max(case when place = 1 then score end) - max(case when place = 2 then score end) as lead from r group by game_id, seq),
    moved as (select *, coalesce(lag(leader) over (partition by game_id order by seq), drawn) as before from l)
    select t.game_id, cast(coalesce(sum(case when before <> leader then 1 else 0 end), 0) as bigint) as lead_changes, cast(coalesce(max(lead), 0) as bigint) as largest_lead
    from (select distinct game_id from teams) t left join moved m on t.game_id = m.game_id group by t.game_id""",
            f"""with {_TWO_TEAMS}, led as (
      select *, case when score0 = score1 then t0 when score0 > score1 then 0 else 1 end as leader from points
    ), moved as (select *, lag(leader) over (partition by game_id order by seq) as before from led)
    select game_id, cast(sum(case when before is not null and before <> leader then 1 else 0 end) as bigint) as lead_changes, cast(max(abs(score0 - score1)) as bigint) as largest_lead
    from moved group by game_id""",
            covers=("W8",),
        ),
        "event_log_recent": Plan(f"select game_id, seq, etype from (select game_id, seq, etype, {_LOGGED} as r from <<ge>> ge) x where r <= {C.recent_rows}", covers=("F5", "O11", "W18")),
        "event_log_bounded": Plan(f"select game_id, seq, etype from (select game_id, seq, etype, {_LOGGED} as r from <<ge>> ge) x where r <= {C.log_rows}", covers=("O11",)),
        "event_log_by_type": Plan(f"select game_id, seq, frame_id, p_track from <<ge>> ge where etype = '{C.log_type}'", covers=("F6",)),
        "event_log_since": Plan(f"select game_id, seq, etype from <<ge>> ge where frame_id >= {C.log_since}", covers=("F7",)),
        "event_ingest": Plan(
            f"""select game_id, seq, coalesce(frame_id, 0) as frame_id, case when etype in ({', '.join(f"'{t}'" for t in EVENT_TYPES)}) then etype else 'unknown' end as etype,
           p_track, coalesce(p_jersey, '') as p_jersey, p_team, s_track, s_team, coalesce(is_three, false) as is_three
    from <<ge>> ge""",
            f"""with kinds(kind) as (values {', '.join(f"('{t}')" for t in EVENT_TYPES)})
    select game_id, seq, ifnull(frame_id, 0) as frame_id, ifnull(kind, 'unknown') as etype, p_track, ifnull(p_jersey, '') as p_jersey, p_team, s_track, s_team, is_three is true as is_three
    from <<ge>> ge left join kinds on etype = kind""",
            covers=("S14", "P17"),
        ),
        "game_summary": Plan(
            f"""select game_id, count(*) as events, cast(sum({_POINTS}) as bigint) as points, cast(max(seq) - min(seq) as bigint) as span, count(distinct p_track) as players,
           cast(sum(case when etype in ('shot_attempt', 'shot_miss') then 1 else 0 end) as bigint) as shots from <<ge>> ge group by game_id""",
            covers=("P21", "M3", "U6"),
        ),
        # one pass over what players did: a row for each track, then for each player
        "identity_resolution": Plan(
            f"""with {ACTIONS}, seen as (
      select game_id, track, min_by(team, seq) as team, min_by(jersey, case when jersey is not null then seq end) as jersey, min(seq) as first_seq,
             sum(case when what = 'score_3pt' then 3 when what = 'score_2pt' then 2 when what = 'free_throw_made' then 1 else 0 end) as points, sum(case when what = 'assist' then 1 else 0 end) as assists
      from actions group by game_id, track
    ), named as (
      select *, case when jersey is null then track
                     else first_value(track) over (partition by game_id, team, jersey order by first_seq, track rows between unbounded preceding and unbounded following) end as canonical
      from seen
    )
    select game_id, canonical, max(team) as team, max(jersey) as jersey, count(*) as tracks, cast(sum(points) as bigint) as points, cast(sum(assists) as bigint) as assists from named group by game_id, canonical""",
            f"""with {ACTIONS}, seen as (
      select game_id, track, min_by(team, seq) as team, min_by(jersey, case when jersey is not null then seq end) as jersey, min(seq) as first_seq from actions group by game_id, track
    ), named as (
      select *, case when jersey is null then track
                     else first_value(track) over (partition by game_id, team, jersey order by first_seq, track rows between unbounded preceding and unbounded following) end as canonical
      from seen
    )
    select n.game_id, n.canonical, max(n.team) as team, max(n.jersey) as jersey, count(distinct n.track) as tracks,
           cast(sum(case when a.what = 'score_3pt' then 3 when a.what = 'score_2pt' then 2 when a.what = 'free_throw_made' then 1 else 0 end) as bigint) as points,
           cast(sum(case when a.what = 'assist' then 1 else 0 end) as bigint) as assists
    from named n join actions a on n.game_id = a.game_id and n.track = a.track group by n.game_id, n.canonical""",
            covers=("T17",),
        ),
        # an event without a jersey gets the first one that its player is known by; what it has stays
        "jersey_enrich": Plan(
            """with known as (select game_id, p_track, min_by(p_jersey, seq) as jersey, min_by(p_team, seq) as team from <<ge>> g where p_jersey is not null and p_jersey <> '' group by game_id, p_track)
    select g.game_id, g.seq, g.s_track, coalesce(nullif(g.s_jersey, ''), o.jersey) as s_jersey, coalesce(nullif(g.p_jersey, ''), k.jersey) as p_jersey, k.team
    from <<ge>> g left join known k on g.game_id = k.game_id and g.p_track = k.p_track left join known o on g.game_id = o.game_id and g.s_track = o.p_track""",
            """with named as (select *, row_number() over (partition by game_id, p_track order by seq) as r from <<ge>> g where length(p_jersey) > 0)
    select g.game_id, g.seq, g.s_track, case when length(g.s_jersey) > 0 then g.s_jersey else (select n.p_jersey from named n where n.r = 1 and n.game_id = g.game_id and n.p_track = g.s_track) end as s_jersey,
           case when length(g.p_jersey) > 0 then g.p_jersey else (select n.p_jersey from named n where n.r = 1 and n.game_id = g.game_id and n.p_track = g.p_track) end as p_jersey,
           (select n.p_team from named n where n.r = 1 and n.game_id = g.game_id and n.p_track = g.p_track) as team
    from <<ge>> g""",
            covers=("J8", "J9", "J10"),
        ),
        "live_ratio": Plan("select game_id, avg(case when is_dead then cast(0 as double) else cast(1 as double) end) as live_ratio, count(*) as frames from <<ge>> ge group by game_id", covers=("A11",)),
        "rebounds": Plan(
            f"""with m as (
      select game_id, seq, frame_id, etype, p_track, p_team,
             max(case when etype = 'shot_miss' then seq end) over (partition by game_id order by seq rows between unbounded preceding and 1 preceding) as miss_seq
      from <<ge>> ge
    ), r as (
      select m.*, row_number() over (partition by m.game_id, m.miss_seq order by m.seq) as nth from m where miss_seq is not null and etype <> 'shot_miss'
    )
    select r.game_id, r.seq, r.miss_seq, r.p_track, case when r.p_team = s.p_team then 'rebound_off' else 'rebound_def' end as etype
    from r join <<ge>> s on r.game_id = s.game_id and r.miss_seq = s.seq where r.nth = 1 and r.p_track <> s.p_track and r.frame_id - s.frame_id <= {C.rebound_frames}""",
            f"""with misses as materialized (select * from <<ge>> g where etype = 'shot_miss'),
    after as (select m.seq as miss_seq, m.game_id, m.frame_id as miss_frame, m.p_track as shooter, m.p_team as shot_team,
              (select min(c.seq) from <<ge>> c where c.game_id = m.game_id and c.seq > m.seq and c.etype <> 'shot_miss') as next_seq, (select min(n.seq) from misses n where n.game_id = m.game_id and n.seq > m.seq) as next_miss from misses m)
    select b.game_id, b.seq, a.miss_seq, b.p_track, case when b.p_team = a.shot_team then 'rebound_off' else 'rebound_def' end as etype
    from after a join <<ge>> b on b.game_id = a.game_id and b.seq = a.next_seq where (a.next_miss is null or a.next_miss > a.next_seq) and b.p_track <> a.shooter and b.frame_id <= a.miss_frame + {C.rebound_frames}""",
            covers=("T11",),
        ),
        "steals": Plan(
            """with c as (
      select game_id, seq, frame_id, p_track, p_team, lag(p_track) over (partition by game_id order by seq) as before, lag(p_team) over (partition by game_id order by seq) as team_before,
             lag(etype) over (partition by game_id order by seq) as etype_before from <<ge>> ge
    )
    select game_id, seq, frame_id, p_track, p_team, before as victim from c where before <> p_track and team_before <> p_team and etype_before = 'pass'""",
            """select b.game_id, b.seq, b.frame_id, b.p_track, b.p_team, a.p_track as victim
    from <<ge>> b join <<ge>> a on a.game_id = b.game_id and a.seq = (select max(c.seq) from <<ge>> c where c.game_id = b.game_id and c.seq < b.seq)
    where a.etype = 'pass' and a.p_track <> b.p_track and a.p_team <> b.p_team""",
            covers=("T9",),
        ),
        "score_attribution": Plan(
            """with p as (select game_id, seq, etype, case when etype in ('pass', 'assist', 'rebound_off', 'rebound_def', 'steal') then p_track end as holder from <<ge>> ge)
    select game_id, seq, etype, scorer from (
      select game_id, seq, etype, LASTNN[holder] over (partition by game_id order by seq rows between unbounded preceding and 1 preceding) as scorer from p
    ) x where etype in ('score_2pt', 'score_3pt')""",
            """select s.game_id, s.seq, s.etype, h.p_track as scorer from <<ge>> s left join <<ge>> h on h.game_id = s.game_id and h.seq = (
      select max(c.seq) from <<ge>> c where c.game_id = s.game_id and c.seq < s.seq and c.p_track is not null and c.etype in ('steal', 'assist', 'rebound_def', 'rebound_off', 'pass'))
    where s.etype in ('score_3pt', 'score_2pt')""",
            covers=("J19",),
        ),
        "clip_groups": Plan(
            f"""with m as (select game_id, frame_id, etype, p_track from <<ge>> ge where etype in ('score_3pt', 'block', 'steal')),
    f as (select *, case when frame_id - lag(frame_id) over (partition by game_id order by frame_id) <= {C.clip_gap} then 0 else 1 end as new from m),
    g as (select *, sum(new) over (partition by game_id order by frame_id rows between unbounded preceding and current row) as clip from f)
    select game_id, clip, greatest(0, min(frame_id) - {C.clip_margin}) as start_frame, max(frame_id) + {C.clip_margin} as end_frame, count(*) as marks, SORTEDSET[etype] as etypes
    from g group by game_id, clip""",
            covers=("W15", "K10", "A29", "T23"),
        ),
        "clip_groups_player": Plan(
            f"""with m as (select game_id, coalesce(nullif(p_jersey, ''), cast(p_track as STR)) as player, frame_id from <<ge>> ge where etype in ('score_2pt', 'score_3pt', 'block', 'steal', 'assist')),
    f as (select *, case when frame_id - lag(frame_id) over (partition by game_id, player order by frame_id) <= {C.clip_gap} then 0 else 1 end as new from m),
    g as (select *, sum(new) over (partition by game_id, player order by frame_id rows between unbounded preceding and current row) as clip from f)
    select game_id, player, clip, greatest(0, min(frame_id) - {C.clip_margin}) as start_frame, max(frame_id) + {C.clip_margin} as end_frame, count(*) as marks from g group by game_id, player, clip""",
            covers=("M1",),
        ),
        "reel_windows": Plan(
            f"""with m as (select game_id, frame_id, p_track, case when etype in ('score_2pt', 'score_3pt', 'block', 'steal') then frame_id end as moment from <<ge>> ge),
    w as (select *, LASTNN[moment] over (partition by game_id order by frame_id rows between unbounded preceding and current row) as last_moment,
            min(moment) over (partition by game_id order by frame_id rows between 1 following and unbounded following) as next_moment from m)
    select game_id, frame_id, last_moment from w where frame_id <= last_moment + {C.reel_hold} or frame_id >= next_moment - {C.reel_lead}""",
            covers=("W17",),
        ),
        # stretches of a reel for each selected player (ma: where the track that matches them is): from before to after every frame in
        # which the ball, or an event, is near
        "player_reels": Plan(
            f"""with moments as (
      select m.game_id, m.ref, m.frame_id from <<ma>> m join <<fr>> f on m.game_id = f.game_id and m.frame_id = f.frame_id
      where (m.cx - f.ball_x) * (m.cx - f.ball_x) + (m.cy - f.ball_y) * (m.cy - f.ball_y) <= {C.near_ball**2}
      union
      select m.game_id, m.ref, m.frame_id from <<ma>> m join <<ge>> g on m.game_id = g.game_id and m.frame_id = g.frame_id
      where 4 * ((m.cx - g.ball_x) * (m.cx - g.ball_x) + (m.cy - g.ball_y) * (m.cy - g.ball_y)) <= {9 * C.near_ball**2}
    ), b as (select *, case when frame_id - {C.reel_lead} <= lag(frame_id) over (partition by game_id, ref order by frame_id) + {C.reel_hold} then 0 else 1 end as new from moments),
    g as (select *, sum(new) over (partition by game_id, ref order by frame_id) as reel from b)
    select game_id, ref, reel, greatest(0, min(frame_id) - {C.reel_lead}) as start_frame, max(frame_id) + {C.reel_hold} as end_frame, count(*) as moments from g group by game_id, ref, reel""",
            f"""with moments as (
      select distinct m.game_id, m.ref, m.frame_id from <<ma>> m
      where exists (select 1 from <<fr>> f where f.game_id = m.game_id and f.frame_id = m.frame_id and sqrt(((m.cx - f.ball_x) ** 2 + (m.cy - f.ball_y) ** 2)::double) <= {C.near_ball})
         or exists (select 1 from <<ge>> g where g.game_id = m.game_id and g.frame_id = m.frame_id and sqrt(((m.cx - g.ball_x) ** 2 + (m.cy - g.ball_y) ** 2)::double) <= 1.5 * {C.near_ball})
    ), firsts as (
      select game_id, ref, frame_id from moments a where not exists (select 1 from moments b where b.game_id = a.game_id and b.ref = a.ref and b.frame_id < a.frame_id and b.frame_id >= a.frame_id - {C.reel_lead + C.reel_hold})
    ), named as (select m.*, (select count(*) from firsts f where f.game_id = m.game_id and f.ref = m.ref and f.frame_id <= m.frame_id) as reel from moments m)
    select game_id, ref, reel, greatest(0, min(frame_id) - {C.reel_lead}) as start_frame, max(frame_id) + {C.reel_hold} as end_frame, count(*) as moments from named group by game_id, ref, reel""",
            covers=("J14", "K11", "T24"),
        ),
        "game_clock": Plan(
            f"""with l as (select game_id, seq, sum(case when is_dead then 0 else 1 end) over (partition by game_id order by seq) as live from <<ge>> ge)
    select game_id, seq, cast(least(1 + live // {PERIOD}, {C.periods}) as int) as period, cast(live % {PERIOD} as double) / {int(C.fps)} as clock,
           concat(lpad(cast((live % {PERIOD}) // {int(C.fps) * 60} as STR), 2, '0'), ':', lpad(cast((live % {PERIOD}) // {int(C.fps)} % 60 as STR), 2, '0')) as shown from l""",
            covers=("W14", "P23"),
        ),
        "str_clean": Plan("select distinct p_track, regexp_replace(concat(etype, '/', cast(p_track as STR), ' #'), '[^0-9A-Za-z_-]', '_') as clean from <<ge>> ge".replace("'[^0-9A-Za-z_-]', '_')", "'[^0-9A-Za-z_-]', '_'GLOBAL)"), covers=("P22",)),
        "job_lookup": Plan(f"select o_orderkey as job_id, o_orderstatus as status, o_orderdate as created_at from <<jobs>> j where o_orderkey = {C.job_id}", covers=("S12",)),
        "next_job": Plan(
            """select job_id, status from (select o_orderkey as job_id, o_orderstatus as status, row_number() over (order by case o_orderstatus when 'O' then 0 else 1 end, o_orderdate, o_orderkey) as r
    from <<jobs>> j where o_orderstatus in ('O', 'P')) x where r = 1""",
            "select o_orderkey as job_id, o_orderstatus as status from orders where o_orderstatus in ('O', 'P') order by case o_orderstatus when 'O' then 0 else 1 end, o_orderdate, o_orderkey limit 1",
            covers=("O8",),
        ),
        "player_slim": Plan(
            """with chosen as (select game_id, p_track from <<ge>> g where etype = 'score_3pt' group by game_id, p_track having count(*) >= 2)
    select distinct g.game_id, g.p_track, g.p_jersey, g.p_team from <<ge>> g where exists (select 1 from chosen c where c.game_id = g.game_id and c.p_track = g.p_track)""",
            covers=("P18", "J15"),
        ),
        "event_stream": Plan(
            f"""with {SCORED}, {_RUNNING}
    select s.game_id, s.seq, s.etype, s.score, cast(p.team_score as bigint) as team_score, cast(p.all_points as bigint) as all_points from scored s join points p on s.game_id = p.game_id and s.seq = p.seq""",
            covers=("T22",),
        ),
    }

    # the frames of every clip: clips stand in all buckets of frames that they touch, so frames meet the clips of their bucket only; clips may overlap
    clips, bucket = found["clip_groups"].sql, C.clip_bucket
    found["clip_frames"] = Plan(
        f"""with clips as ({clips}), placed as (select game_id, clip, start_frame, end_frame, explode(sequence(start_frame div {bucket}, end_frame div {bucket})) as bucket from clips)
    select f.game_id, c.clip, f.frame_id, f.frame_id - c.start_frame as nth from <<fr>> f join placed c on f.game_id = c.game_id and f.frame_id div {bucket} = c.bucket where f.frame_id between c.start_frame and c.end_frame""",
        f"with clips as ({clips}) select f.game_id, c.clip, f.frame_id, f.frame_id - c.start_frame as nth from <<fr>> f join clips c on f.game_id = c.game_id and f.frame_id >= c.start_frame and f.frame_id <= c.end_frame",
        ("J17", "F18", "K10"),
    )
    # the top-1 job is a TakeOrderedAndProject, not a window over one partition
    found["next_job"] = Plan(found["next_job"].oracle.replace("from orders", "from <<jobs>> j"), covers=found["next_job"].covers)
    found["str_clean"] = Plan(
        found["str_clean"].sql.replace("GLOBAL", ""), found["str_clean"].sql.replace("GLOBAL", ", 'g'"), covers=found["str_clean"].covers
    )
    return found
