"""Event files to one flat event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playframe.config import STOPPAGE_TYPES
from playframe.sources.files import match_of

# Sub-records laid over the record, later ones on top, and the
# alias lists of every field (first non-null alias wins).
SUB_RECORDS = ("gameEvents", "initialTouch", "possessionEvents", "fouls", "game_event", "possession_event")
TEXT, REAL, WHOLE, FLAG = "string", "double", "bigint", "boolean"
FIELDS = {
    "sequence": (WHOLE, ("sequence",)),
    "period": ("int", ("period",)),
    "start_time": (REAL, ("start_time", "startTime")),
    "end_time": (REAL, ("end_time", "endTime")),
    "event_time": (REAL, ("eventTime", "event_time")),
    "duration": (REAL, ("duration",)),
    "setpiece_type": (TEXT, ("setpieceType", "setpiece_type")),
    "video_missing": (FLAG, ("videoMissing", "video_missing")),
    "game_event_id": (WHOLE, ("game_event_id", "gameEventId")),
    "possession_event_id": (WHOLE, ("possession_event_id", "possessionEventId")),
    "game_event_type": (TEXT, ("game_event_type", "gameEventType")),
    "game_clock": (REAL, ("startGameClock", "start_game_clock", "gameClock", "game_clock")),
    "home_ball": (FLAG, ("home_ball",)),
    "home_team": (FLAG, ("home_team", "homeTeam")),
    "possession_event_type": (TEXT, ("possession_event_type", "possessionEventType")),
    "outcome": (TEXT, ("outcome", "outcomeType", "passOutcomeType", "crossOutcomeType")),
    "lines_broken": (TEXT, ("linesBrokenType",)),
    "pass_type": (TEXT, ("passType",)),
    "accuracy_type": (TEXT, ("accuracyType",)),
    "incompletion_reason": (TEXT, ("incompletionReasonType",)),
    "carry_successful": (FLAG, ("carrySuccessful",)),
    "carry_intent": (TEXT, ("carryIntent",)),
    "carry_type": (TEXT, ("carryType",)),
    "shot_outcome": (TEXT, ("shotOutcomeType",)),
    "pressure_type": (TEXT, ("pressureType",)),
    "opportunity_type": (TEXT, ("opportunityType",)),
    "start_frame": (WHOLE, ("start_frame", "startFrame")),
    "end_frame": (WHOLE, ("end_frame", "endFrame")),
}
_SNAPSHOT = "array<struct<playerId:string,positionGroupType:string,x:double,y:double>>"
_RECORD = "map<string,string>"


def _records(text: Column) -> Column:
    """Records of a file: a list, an object with ``data`` or ``events``, or one
    record."""
    is_list = F.ltrim(text).startswith("[")
    root = F.from_json(text, _RECORD)
    inner = F.when(F.map_contains_key(root, F.lit("data")), F.element_at(root, "data")).otherwise(F.try_element_at(root, F.lit("events")))
    has_inner = F.map_contains_key(root, F.lit("data")) | F.map_contains_key(root, F.lit("events"))
    nested = F.when(F.ltrim(inner).startswith("["), F.from_json(inner, "array<string>")).otherwise(F.array(inner))
    return F.when(is_list, F.from_json(text, "array<string>")).when(has_inner, nested).otherwise(F.array(text))


def _overlaid(name: str) -> Column:
    """Value of a key after laying the sub-records over the record. A key that
    is present with null in a later sub-record hides an earlier value."""
    key = F.lit(name)
    value = F.try_element_at("rec", key)
    for i in range(len(SUB_RECORDS)):
        value = F.when(F.coalesce(F.map_contains_key(F.col(f"sub{i}"), key), F.lit(False)), F.try_element_at(f"sub{i}", key)).otherwise(value)
    return value


def _typed(value: Column, kind: str) -> Column:
    if kind == TEXT:
        return value
    if kind == FLAG:
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    number = value.try_cast("double")
    number = F.when(~F.isnan(number), number)
    # whole numbers directly, so that ids past 2^53 stay apart; "12.0" by way of a double
    return number if kind == REAL else F.coalesce(value.try_cast(kind), number.try_cast(kind))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Flat events of all matches, in file order by ``ordinal``."""
    raw = spark.read.text(f"{folder}/*/events.json", wholetext=True)
    one = raw.select(match_of(F.col("_metadata.file_path")).alias("match_id"), F.posexplode(_records(F.col("value"))).alias("ordinal", "text"))
    rec = one.select("match_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.from_json("text", _RECORD).alias("rec")).filter(F.col("rec").isNotNull())
    rec = rec.withColumns({
        f"sub{i}": F.when(F.ltrim(F.try_element_at("rec", F.lit(n))).startswith("{"), F.from_json(F.try_element_at("rec", F.lit(n)), _RECORD))
        for i, n in enumerate(SUB_RECORDS)})
    names = sorted({a for _, aliases in FIELDS.values() for a in aliases} | {"homePlayers", "awayPlayers"})
    flat = rec.select("match_id", "ordinal", *[_overlaid(n).alias(f"k_{n}") for n in names])

    def field(kind: str, aliases: tuple[str, ...]) -> Column:
        return _typed(F.coalesce(*[F.col(f"k_{a}") for a in aliases]), kind)

    return flat.select(
        "match_id", "ordinal", *[field(kind, aliases).alias(name) for name, (kind, aliases) in FIELDS.items()],
        *[F.from_json(f"k_{s}Players", _SNAPSHOT).alias(f"{s}Players") for s in ("home", "away")],
    )


def is_stoppage() -> Column:
    """Events without a sequence whose type stops the play."""
    return F.col("sequence").isNull() & F.coalesce(F.col("game_event_type").isin(*STOPPAGE_TYPES), F.lit(False))
