"""All tunables of the engine, with one preset per supported output flavour."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Vocabulary of the event feed.
PASS_CODES = ("PA", "CR")
SHOT_CODE = "SH"
EVENT_CODE_NAMES = {
    "BC": "carry",
    "CH": "challenge",
    "CL": "clearance",
    "CR": "cross",
    "PA": "pass",
    "RE": "rebound",
    "SH": "shot",
}
STOPPAGE_TYPES = (
    "OUT", "SUB", "OFF", "ON", "FIRSTKICKOFF", "SECONDKICKOFF",
    "THIRD_KICKOFF", "FOURTHKICKOFF", "FOUL", "END", "VID",
)
FOUL_TYPES = ("FOU", "FOUL")
VISIBLE_VALUES = ("VISIBLE", "visible", "ESTIMATED", "estimated")
ON_TARGET_OUTCOMES = ("G", "S", "B", "L")
PRESSURE_OUTCOMES = ("A", "P", "L")


@dataclass(frozen=True)
class EngineConfig:
    """Parameters of one run. Use the class methods for the two presets."""

    # pitch and tracking
    default_pitch_length: float = 105.0
    default_pitch_width: float = 68.0
    default_fps: float = 25.0
    use_smoothed: bool = True
    num_matches: int | None = None

    # reliability: all | filter | weighted
    reliability_mode: str = "all"
    reliability_threshold: float = 0.5

    # pitch control: "map" keeps a flat cell map, "share" keeps a scalar
    control_kind: str = "map"
    control_nodes_x: int = 75
    control_nodes_y: int = 45
    control_share_nodes: int = 60
    control_stride: int = 3
    control_min_players: int = 4
    phase_control_stride: int = 2

    # value surfaces
    obso_radius: float = 5.0
    obso_stride: int = 5
    das_nodes: int = 30
    das_stride: int = 5
    das_min_players: int = 2
    carrier_radius: float = 3.0
    das_peak_threshold: float = 0.05
    das_min_seconds: float = 3.0

    # formations
    window_seconds: int = 180
    window_stride: int = 60
    formation_frame_stride: int = 5
    window_min_observations: int = 100
    min_outfielders: int = 8
    keeper_min_frames: int = 200
    min_window_confidence: float = 0.0
    foul_decay_seconds: float = 15.0
    sub_decay_seconds: float = 30.0
    phase_player_min_frames: int = 3

    # possessions and phases
    post_end_grace: float = 5.0
    ball_scan_frames: int = 25
    min_common_players: int = 7
    max_touch_seconds: float = 10.0
    threshold_mean: float = 2.0
    threshold_max: float = 4.0
    max_window_passes: int = 8
    max_window_seconds: float = 30.0
    min_phase_frames: int = 3
    turnover_distance: float = 2.5
    turnover_stride: int = 5

    # occupancy maps
    emit_grids: bool = False
    players_per_side: int = 10

    # physical layout: widths of the time and frame buckets used to spread one
    # key over many tasks, and the longest run folded inside one row
    block_seconds: float = 60.0
    block_frames: int = 2048
    block_rows: int = 4096

    @classmethod
    def possession_preset(cls, **kw) -> "EngineConfig":
        """Flat control maps, 8-pass windows, all matches."""
        return replace(cls(), **kw)

    @classmethod
    def clustering_preset(cls, **kw) -> "EngineConfig":
        """Scalar control share, 12-pass windows, all matches, cell tables."""
        base = cls(
            control_kind="share",
            control_stride=2,
            max_window_passes=12,
            emit_grids=True,
        )
        return replace(base, **kw)
