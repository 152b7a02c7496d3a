"""How players look: colour histograms and torso features from pixels (px), cached jersey readings, and small helpers of media files."""

from __future__ import annotations

from rimflow.config import EngineConfig

from .core import Plan
from .sequences import _both, _thinning

# Extensions of videos that are taken in.
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm")

#: Rows of each track in order; a reading that gave a number is what a cache can hold.
_READ = """
r as (
  select game_id as game, track, frame_id as frame, o, case when conf >= 30 and length(number) between 1 and 2 then number end as number,
         concat_ws('-', cast(game_id as STR), cast(track as STR)) as game_id, row_number() over (partition by game_id, track order by frame_id, o) as frame_id from <<oc>> oc
), hits as (select game_id, frame_id from r where number is not null), {reads}"""


def plans(C: EngineConfig) -> dict[str, Plan]:
    # hue in 30 bins of 6, saturation in 32 of 8; the vector of a crop has length one
    histogram = Plan(
        """with n as (select game_id, frame_id, track_id, (h // 6) * 32 + s // 8 as bin, count(*) as n from <<px>> px group by game_id, frame_id, track_id, (h // 6) * 32 + s // 8)
    select game_id, frame_id, track_id, bin, round(cast(n as double) / sqrt(cast(sum(n * n) over (partition by game_id, frame_id, track_id) as double)), 9) as weight from n""",
        """with b as (select *, floor(h / 6)::bigint * 32 + floor(s / 8)::bigint as bin from <<px>> px), n as (select game_id, frame_id, track_id, bin, count(*) as n from b group by all),
    l as (select game_id, frame_id, track_id, sqrt(sum(n ** 2)) as len from n group by all)
    select n.game_id, n.frame_id, n.track_id, bin, round(n / len, 9) as weight from n join l on n.game_id = l.game_id and n.frame_id = l.frame_id and n.track_id = l.track_id""",
        covers=("A28", "M18"),
    )
    # pixels that are neither dark nor glaring, all of them where those are fewer than ten
    torso = Plan(
        """with p as (select *, v > 30 and v < 245 as clear, sum(case when v > 30 and v < 245 then 1 else 0 end) over (partition by game_id, track_id) as n from <<px>> px)
    select game_id, track_id, round(128 + 128 * median(cos(2 * pi() * h / 180)), 6) as hue_cos, cast(median(s) as double) as saturation, cast(median(v) as double) as brightness
    from p where clear or n < 10 group by game_id, track_id""",
        """with n as (select game_id, track_id, count(*) filter (where v between 31 and 244) as n from <<px>> px group by all)
    select p.game_id, p.track_id, round(median(cos(pi() * p.h / 90)) * 128 + 128, 6) as hue_cos, median(s)::double as saturation, median(v)::double as brightness
    from <<px>> p join n on p.game_id = n.game_id and p.track_id = n.track_id where n.n < 10 or v between 31 and 244 group by all""",
        covers=("A23",),
    )
    reads = _thinning("reads", "hits", C.jersey_cache)
    cached = _both(
        _READ,
        f"""select game as game_id, track, frame as frame_id, o, case when frame_id - read_at < {C.jersey_cache} then shown end as jersey, frame_id = read_at as was_read from (
      select r.*, LASTNN[case when a.frame_id is not null then r.number end] over (partition by r.game_id order by r.frame_id rows between unbounded preceding and current row) as shown,
             max(a.frame_id) over (partition by r.game_id order by r.frame_id rows between unbounded preceding and current row) as read_at
      from r left join reads a on r.game_id = a.game_id and r.frame_id = a.frame_id) q where read_at is not null""",
        ("T20",), reads=reads,
    )
    part = "(track_id * 37 % 360 % 60)"
    rising, falling = f"cast(floor(0.95 * (1 - 0.85 * (1 - {part} / cast(60 as double))) * 255) as int)", f"cast(floor(0.95 * (1 - 0.85 * {part} / cast(60 as double)) * 255) as int)"
    # the hue goes round in steps of 37 degrees; of red, green and blue one is high, one is low and one rises or falls
    sextant = {"r": ("242", falling, "36", "36", rising, "242"), "g": (rising, "242", "242", falling, "36", "36"), "b": ("36", "36", rising, "242", "242", falling)}
    column = lambda c: f"case track_id * 37 % 360 // 60 {' '.join(f'when {k} then {x}' for k, x in enumerate(sextant[c]))} end as {c}"
    integer = {"up": f"(24225 * (6000 - 85 * (60 - {part})) // 600000)", "down": f"(24225 * (6000 - 85 * {part}) // 600000)"}
    plain = lambda c: column(c).replace(rising, integer["up"]).replace(falling, integer["down"]).replace(" end as", " end::int as")
    colours = Plan(
        f"select distinct track_id, {column('b')}, {column('g')}, {column('r')}, case team_id when 0 then 'b255g100r50' when 1 then 'b50g100r255' else 'b200g200r200' end as team_colour from <<tr>> tr".replace("cast(60 as double)", "cast(60 as double)"),
        f"select track_id, {plain('b')}, {plain('g')}, {plain('r')}, case when team_id = 0 then 'b255g100r50' when team_id = 1 then 'b50g100r255' else 'b200g200r200' end as team_colour from <<tr>> tr group by track_id, team_id",
        covers=("P16",),
    )
    allowed = ", ".join(f"'{x}'" for x in VIDEO_EXTENSIONS)
    files = Plan(
        f"""select name, name like '%.%' and lower(substring_index(name, '.', -1)) in ({allowed}) as allowed, concat(base, '_', date_format(made, 'yyyyMMdd_HHmmss'), '.', 'mp4') as stamped from <<fi>> fi""",
        f"""select name, coalesce(len(string_split(name, '.')) > 1 and list_contains([{allowed}], lower(string_split(name, '.')[-1])), false) as allowed, base || '_' || strftime(made, '%Y%m%d_%H%M%S') || '.mp4' as stamped from <<fi>> fi""",
        covers=("P25", "P26"),
    )
    window = f"over (partition by game_id order by us, frame_id rows between {C.fps_window - 1} preceding and current row)"
    fps = Plan(
        f"""with w as (select game_id, frame_id, count(*) {window} as n, us - min(us) {window} as dt from <<ti>> ti)
    select game_id, frame_id, case when n > 1 and dt > 1 then cast((n - 1) * 1000000 as double) / dt else cast(0 as double) end as fps from w""",
        f"""with i as (select *, row_number() over (partition by game_id order by us, frame_id) as k from <<ti>> ti)
    select b.game_id, b.frame_id, case when b.k > 1 and b.us - a.us > 1 then (b.k - a.k) * 1e6::double / (b.us - a.us) else 0.0::double end as fps
    from i b join i a on a.game_id = b.game_id and a.k = greatest(1, b.k - {C.fps_window - 1})""",
        covers=("W13",),
    )
    return {"appearance_histogram": histogram, "torso_feature": torso, "jersey_cache": cached, "track_colours": colours, "video_files": files, "frame_rate": fps}
