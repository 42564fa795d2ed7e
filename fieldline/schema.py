"""Column names, keys and read schemas of the event model.

An event log has one row per on-ball event. ``GROUP`` is the grain of the
feature table: one player in one period of one match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

GROUP = ["matchId", "matchPeriod", "playerId"]
PERIOD = ["matchId", "matchPeriod"]
TEAM_PERIOD = ["matchId", "matchPeriod", "teamId"]
CELL = ["numero_cella_x", "numero_cella_y"]

NO_PLAYER = 0


def event_schema(team_type: T.DataType = T.LongType()) -> T.StructType:
    """Raw event file. ``subEventId`` is text because some files hold ''.

    ``team_type`` is a string in single-match files that name their teams.
    """
    point = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("x", T.DoubleType())])
    tag = T.StructType([T.StructField("id", T.LongType())])
    return T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("playerId", T.LongType()),
            T.StructField("matchId", T.LongType()),
            T.StructField("matchPeriod", T.StringType()),
            T.StructField("teamId", team_type),
            T.StructField("eventId", T.LongType()),
            T.StructField("subEventId", T.StringType()),
            T.StructField("eventName", T.StringType()),
            T.StructField("eventSec", T.DoubleType()),
            T.StructField("tags", T.ArrayType(tag)),
            T.StructField("positions", T.ArrayType(point)),
        ]
    )


PLAYER_SCHEMA = T.StructType(
    [
        T.StructField("wyId", T.LongType()),
        T.StructField("shortName", T.StringType()),
        T.StructField("lastName", T.StringType()),
        T.StructField("currentTeamId", T.LongType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField(
            "role",
            T.StructType([T.StructField("code2", T.StringType()), T.StructField("code3", T.StringType())]),
        ),
    ]
)

TEAM_SCHEMA = T.StructType(
    [
        T.StructField("wyId", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("officialName", T.StringType()),
    ]
)

MATCH_SCHEMA = T.StructType([T.StructField("wyId", T.LongType()), T.StructField("label", T.StringType())])

PLAYER_NAME_SCHEMA = T.StructType([T.StructField("playerId", T.LongType()), T.StructField("name", T.StringType())])


@dataclass(frozen=True)
class EventSpec:
    """A kind of event: ``None`` leaves that part unconstrained."""

    name: str
    event: int | None = None
    sub_event: int | None = None
    tag: int | None = None
    share_of: str = "team"  # 'team' or 'player'

    @property
    def count_column(self) -> str:
        return f"n_{self.name}"

    @property
    def share_column(self) -> str:
        return f"{self.name}_pct_{'WRT' if self.share_of == 'team' else 'WRP'}"
