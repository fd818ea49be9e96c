"""Feature names: groups, feature sets and selection rules. Everything here
looks at the schema only."""

from __future__ import annotations

from dataclasses import dataclass

# Ordered naming rules, first match wins. Each entry is the
# group, the substrings, the prefixes, and substrings that rule the entry out.
GROUP_RULES = (
    ("pitch_control_scalar", ("pitch_control",), (), ()),
    ("pitch_control_map", (), ("pcmap_",), ()),
    ("recurrence_map", (), ("rec_in_", "rec_out_"), ()),
    ("positional_pca", (), ("pc#",), ()),
    ("depth", ("depth",), (), ()),
    ("width", ("width",), (), ()),
    ("compactness", ("compactness",), (), ()),
    ("elongation", ("elongation",), (), ()),
    ("area", ("_area",), ("area",), ()),
    ("centroid_position", ("centroid",), (), ("distance",)),
    ("team_vs_team_distance", ("centroid_distance", "longitudinal_centroid", "lateral_centroid"), (), ()),
    ("player_speed", ("speed",), (), ()),
    ("pressure", ("pressure", "pressured"), (), ()),
    ("passing", ("pass", "n_passs", "lines_broken"), (), ()),
    ("progression", ("progression",), (), ()),
    ("carrying", ("carry", "carrys"), (), ()),
    ("touch_movement", ("touch_", "disp"), (), ()),
    ("formation", ("formation", "formwin"), (), ()),
    ("match_events", (
        "n_events", "n_shots", "goals", "n_clearances", "n_challenges", "n_crosss", "n_rebounds",
        "chances_created", "dangerous_positions", "events_per_second", "shots_on_target",
    ), (), ()),
    ("player_spacing", ("nearest_", "pairwise"), (), ()),
    ("phase_duration", ("duration",), (), ()),
)
BALL_VARIANT_SKIPS = ("pitch_control_scalar", "pitch_control_map", "recurrence_map")
BALL_VARIANT_RULE = ("pitch_control", ("pitch_control",), (), ())
MAP_GROUPS = ("recurrence_map", "pitch_control_map")
PASS_THROUGH_GROUPS = ("positional_pca", "recurrence_map", "pitch_control_map")
HOLDOUT_GROUPS = ("match_events", "passing", "pressure", "carrying", "touch_movement", "other")
ID_LIKE = ("match_id", "sequence_id", "window_id", "windowIndex", "start_frame", "end_frame", "game_event_id",
           "possession_event_id")
CLOCK_COLUMNS = ("start_sec", "end_sec", "start_sec_period", "end_sec_period", "touch_event_start_time",
                 "touch_event_end_time", "touch_event_time", "touch_next_event_time")
LEAKING_PREFIXES = (
    "ball_x_", "ball_y_", "ball_z_", "attacking_centroid_to_ball_distance_", "defending_centroid_to_ball_distance_",
    "attacking_players_ahead_of_ball_", "attacking_players_behind_ball_", "defending_players_ahead_of_ball_",
    "defending_players_behind_ball_",
)
INTERACTION_PREFIXES = (
    "centroid_distance", "longitudinal_centroid_difference", "lateral_centroid_difference", "width_difference",
    "width_ratio", "depth_difference", "depth_ratio", "compactness_difference", "compactness_ratio", "area_difference",
    "area_ratio", "nearest_opponent_distance",
)
SPEED_COLUMNS = ("mean_player_speed", "std_player_speed", "max_player_speed")
EVENT_COLUMNS = (
    "duration", "n_events", "n_passs", "n_carrys", "n_crosss", "n_challenges", "n_clearances", "n_rebounds", "n_shots",
    "n_pass_attempts", "n_completed_passes", "pass_completion_rate", "successful_carries", "lines_broken_count",
    "events_per_second", "goals", "shots_on_target",
)
CONTEXT_COLUMNS = ("open_play_indicator", "period")
FORMATION_CATEGORIES = ("dominant_formation", "formation_variant", "formation_family")
FORMATION_NUMBERS = ("formation_confidence",)
SCALAR_TARGETS = ("xt_mean", "obso_mean", "off_ball_xt_mean", "das_score_mean")
PROFILE_COLUMNS = (
    "duration", "attacking_width_mean", "attacking_depth_mean", "attacking_compactness_mean", "defending_width_mean",
    "defending_depth_mean", "defending_compactness_mean", "centroid_distance_mean", "mean_player_speed", "n_events",
    "n_passs", "pass_completion_rate", "n_shots", "goals", "pressure_rate", "PC1", "PC2", "PC3",
)
BALL_PROFILE_COLUMNS = ("ball_start_x", "ball_end_x", "ball_dx", "ball_max_x", "ball_lat_shift", "ball_path_length",
                        "ball_straightness", "ball_speed_mps")


def group_of(column: str, with_ball: bool = False) -> str:
    """Feature group of a column name."""
    name = column.lower()
    rules = list(GROUP_RULES)
    if with_ball:
        rules = [r for r in rules if r[0] not in BALL_VARIANT_SKIPS]
        rules.insert([r[0] for r in rules].index("pressure"), BALL_VARIANT_RULE)
    for group, inside, prefixes, without in rules:
        if any(w in name for w in without):
            continue
        if any(w in name for w in inside):
            return group
        for p in prefixes:
            if p == "pc#":
                if name.startswith("pc") and name[2:].isdigit():
                    return group
            elif name.startswith(p):
                return group
    return "other"


def clusterable(columns: list[str]) -> list[str]:
    """Numeric columns that may enter a clustering: no ids, frames, clocks or
    ball columns."""
    def dropped(c: str) -> bool:
        n = c.lower()
        return "ball" in n or c in ID_LIKE or n.endswith("_id") or "frame" in n or n in CLOCK_COLUMNS

    return [c for c in columns if not dropped(c)]


@dataclass(frozen=True)
class FeatureSets:
    """Ordered, duplicate-free feature lists for prediction."""

    numeric: tuple[str, ...]
    available: tuple[str, ...]
    onehot: tuple[str, ...]

    def prefixed(self, prefixes) -> list[str]:
        skip = ("match_id", "sequence_id", "window_id")
        return [c for c in self.numeric if c not in skip and not c.startswith(LEAKING_PREFIXES)
                and any(c == p or c.startswith(p + "_") for p in prefixes)]

    def present(self, names) -> list[str]:
        return [c for c in names if c in self.available]

    def build(self) -> dict[str, list[str]]:
        attack, defence = self.prefixed(["attacking"]), self.prefixed(["defending"])
        shared = self.present(SPEED_COLUMNS) + self.present(EVENT_COLUMNS) + self.present(CONTEXT_COLUMNS)
        formation = list(self.onehot) + self.present(FORMATION_NUMBERS)
        sets = {
            "Cat 1": attack + shared + formation,
            "Cat 2": attack + defence + self.prefixed(INTERACTION_PREFIXES) + shared + formation,
            "Cat 3": formation,
        }
        return {k: list(dict.fromkeys(v)) for k, v in sets.items()}
