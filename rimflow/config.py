"""Settings of the game engine and the fixed values of its domain."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# Event types.
EVENT_TYPES = (
    "shot_attempt", "score_2pt", "score_3pt", "free_throw_made", "free_throw_miss", "shot_miss", "rebound_off",
    "rebound_def", "steal", "turnover", "assist", "pass", "block", "foul", "fast_break", "out_of_bounds", "dead_ball",
    "live_ball", "possession_change", "unknown",
)

# Weights of the player efficiency rating, in hundredths.
RATING_HUNDREDTHS = {
    "points": 100, "rebounds": 120, "assists": 150, "steals": 200, "blocks": 200, "turnovers": -150, "fouls": -50, "fg_attempts": -44,
}

# Highlight score of each event type.
HIGHLIGHT = {
    "score_3pt": 10, "score_2pt": 6, "block": 8, "steal": 7, "assist": 5, "rebound_off": 4, "rebound_def": 3, "fast_break": 6,
    "turnover": -2, "foul": -1,
}

# What an event adds to its team's momentum.
MOMENTUM = {
    "score_3pt": 3.0, "score_2pt": 2.0, "free_throw_made": 1.0, "rebound_off": 1.5, "rebound_def": 1.0, "steal": 2.5, "block": 2.5,
    "assist": 1.0, "fast_break": 2.0, "turnover": -1.5, "foul": -0.5, "shot_miss": -0.5,
}

# Zones of a frame as shares of its width and height (x1, y1, x2, y2), in order of precedence.
ZONES = {
    "paint_left": (0.0, 0.4, 0.2, 1.0),
    "paint_right": (0.8, 0.4, 1.0, 1.0),
    "three_point": (0.1, 0.0, 0.9, 0.85),
    "mid_range": (0.2, 0.2, 0.8, 0.75),
    "backcourt": (0.0, 0.0, 1.0, 0.15),
    "full_court": (0.0, 0.0, 1.0, 1.0),
}


#: A court polygon (x, y) for footage without one of its own.
COURT_POLYGON = ((200, 100), (1000, 100), (1150, 500), (640, 650), (100, 500))


@dataclass(frozen=True)
class EngineConfig:
    """One place for every limit of the operators; distances are pixels, spans are frames."""

    frame_width: int = 1280
    frame_height: int = 720
    fps: float = 30.0
    # scans: seconds and looks a second; the most frames of a game (0: all), and by how much frame ids run on from game to game
    scan_seconds: float = 15.0
    scan_rate: float = 10.0
    max_frames: int = 0
    frames_before_game: int = 0
    min_detection: int = 30
    min_detection_ball: int = 10
    min_height: int = 50
    min_appearances: int = 3
    # matching
    match_reach: int = 150
    write_back_reach: int = 20
    appearance_max: float = 0.35
    zone_margin: int = 0
    zone_cell: int = 80
    heat_cell: int = 40
    # jersey numbers
    ocr_width: int = 25
    ocr_height: int = 50
    ocr_every: int = 12
    ocr_tracks: int = 3
    jersey_readings: int = 25
    jersey_least: int = 6
    jersey_cache: int = 9000
    fps_window: int = 30
    # rim and hoops
    rim_frames: int = 10
    hoop_dwell: int = 3
    hoop_cooldown: int = 30
    arc_window: int = 20
    arc_least: int = 10
    arc_min_height: int = 30
    ball_gate: int = 160
    flight_speed: float = 8.0
    # possession
    possession_radius: int = 150
    possession_frames: int = 2
    possession_loss_frames: int = 15
    # shots, scores, blocks, passes
    rise_speed: float = 12.0
    rise_frames: int = 4
    arc_height: float = 40.0
    rim_radius: float = 60.0
    score_cooldown: int = 45
    block_speed: float = 18.0
    block_radius: float = 90.0
    block_cooldown: int = 30
    pass_distance: float = 60.0
    pass_frames: int = 45
    rebound_frames: int = 60
    # dead ball
    dead_after_score: int = 90
    rest_pixels: float = 4.0
    rest_frames: int = 25
    bounds_inner: int = 20
    bounds_outer: int = 20
    missing_frames: int = 15
    still_pixels: float = 8.0
    still_frames: int = 45
    min_confidence: float = 0.35
    min_dead_sec: float = 0.5
    # court, as shares of the frame: the three-point line and the paint
    three_share: float = 0.22
    paint_share_x: float = 0.12
    paint_share_y: float = 0.3
    attacking_left: bool = True
    # statistics
    hot_window: int = 5
    hot_makes: int = 3
    hot_bonus: float = 3.0
    combo_window: int = 5
    combo_bonus: float = 2.0
    momentum_decay: float = 0.92
    highlight: dict[str, int] = field(default_factory=lambda: dict(HIGHLIGHT))
    momentum: dict[str, float] = field(default_factory=lambda: dict(MOMENTUM))
    moment_score: float = 5.0
    top_moments: int = 50
    log_rows: int = 2000
    recent_rows: int = 20
    log_type: str = "steal"
    log_since: int = 5000
    job_id: int = 1234
    # clips, clock
    clip_gap: int = 30
    clip_margin: int = 60
    clip_bucket: int = 256
    reel_hold: int = 60
    reel_lead: int = 90
    near_ball: int = 140
    jersey_share: int = 65
    merge_gap: int = 30
    min_segment: int = 9
    segment_pad: int = 3
    period_sec: int = 600
    periods: int = 4

    @property
    def three_x(self) -> int:
        return int(self.frame_width * self.three_share)

    @property
    def paint_x(self) -> int:
        return int(self.frame_width * self.paint_share_x)

    @property
    def paint_y(self) -> int:
        return int(self.frame_height * self.paint_share_y)

    @classmethod
    def merged(cls, *layers: dict | None) -> EngineConfig:
        """Later layers win: file, then command line. Unknown keys and nulls are ignored."""
        known, out = {f.name for f in fields(cls)}, {}
        for layer in layers:
            out.update({k: v for k, v in (layer or {}).items() if k in known and v is not None})
        return cls(**out)


DEFAULT = EngineConfig()

#: The driver's tables give short games of unconnected frames: the same rules, with spans that such traces can meet.
TRACE = EngineConfig(
    possession_radius=300, block_radius=180.0, rim_radius=200.0, clip_gap=3, reel_hold=2, reel_lead=3, dead_after_score=10, missing_frames=3,
    still_frames=5, rest_frames=3, min_dead_sec=0.0, merge_gap=3, min_segment=2, segment_pad=1, min_detection_ball=30, period_sec=3, scan_seconds=3.0, frames_before_game=500, appearance_max=0.95, jersey_cache=4,
)
