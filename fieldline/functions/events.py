"""Expressions over one event: tags, positions, pitch cells, movement."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.schema import EventSpec


def tag_ids(tags: str = "tags") -> Column:
    """List of tag structs -> list of ids; missing list -> empty list."""
    return F.coalesce(F.col(tags)["id"], F.array().cast("array<bigint>"))


def coordinate(axis: str, index: int, positions: str = "positions") -> Column:
    """Coordinate of the ``index``-th position, NULL where there is none."""
    return F.get(F.col(positions), F.lit(index))[axis]


def has_two_positions(positions: str = "positions") -> Column:
    return F.coalesce(F.size(positions) >= 2, F.lit(False))


def padded_positions(positions: str = "positions") -> Column:
    """Two entries always: anything but two entries becomes (first, first)."""
    first = F.get(F.col(positions), F.lit(0))
    return F.when(F.size(positions) == 2, F.col(positions)).otherwise(F.array(first, first))


def grid_cell(value: Column) -> Column:
    """Cell 0..4 of a 0..100 coordinate.

    Bins are closed on the right; 0, NULL and values outside the pitch go to
    cell 0.
    """
    inside = (value > 0) & (value <= fixed.CELL_WIDTH * fixed.GRID_SIDE)
    return F.when(inside, F.ceil(value / fixed.CELL_WIDTH) - 1).otherwise(0).cast("int")


def cell_label(cell_x: Column, cell_y: Column) -> Column:
    return F.concat(cell_x.cast("string"), cell_y.cast("string"))


def mirror_cell(cell: Column) -> Column:
    """The same cell seen from the other end of the pitch."""
    return F.abs(cell - (fixed.GRID_SIDE - 1)).cast("int")


def move_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction of a move in [0, 2*pi); a move of no length counts as pi/2."""
    dx, dy = x1 - x0, y1 - y0
    turn = F.pmod(F.atan2(dy, dx), F.lit(2 * math.pi))
    return F.when((dx == 0) & (dy == 0), F.lit(math.pi / 2)).otherwise(turn)


def point_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def select_event(event: int | None = None, sub_event: int | None = None, tag: int | None = None) -> Column:
    """Predicate for one kind of event.

    An unconstrained type or subtype must still be present, so events without
    one never match. Works in ``filter`` and in ``count_if``.
    """
    return F.expr(event_condition(event, sub_event, tag))


def event_condition(event: int | None = None, sub_event: int | None = None, tag: int | None = None) -> str:
    """The predicate of ``select_event`` as SQL text."""
    parts = [
        "eventId IS NOT NULL" if event is None else f"eventId = {int(event)}",
        "subEventId IS NOT NULL" if sub_event is None else f"subEventId = {int(sub_event)}",
    ]
    if tag is not None:
        parts.append(f"array_contains(tags, {int(tag)}L)")
    return " AND ".join(parts)


def matches_spec(spec: EventSpec) -> Column:
    return select_event(spec.event, spec.sub_event, spec.tag)


def has_tag(tag: int) -> Column:
    return F.expr(f"array_contains(tags, {int(tag)}L)")


def all_present(keys: Iterable[str]) -> Column:
    """Grouping keeps only rows whose keys are all there."""
    return F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))


def home_name(label: Column, aliases: Mapping[str, str] = fixed.HOME_ALIASES) -> Column:
    """Home team of a match label: its first word, or the alias of that word."""
    word = F.split_part(label, F.lit(" "), F.lit(1))
    chain = F  # first call is F.when, later ones Column.when
    for short, full in aliases.items():
        chain = chain.when(word == short, full)
    return chain.otherwise(word) if aliases else word


def attack_left_to_right(
    value: Column, team: Column, home: Column, period: Column, opposite: Column | None = None
) -> Column:
    """Coordinate turned so that each team attacks the same way in both halves.

    ``opposite`` is the turned value, by default that of a coordinate.

    Turned for the away side in the first half and the home side in the second;
    a match whose home side is not known counts every team as away.
    """
    at_home = F.coalesce(team == home, F.lit(False))
    turned = (~at_home & (period == "1H")) | (at_home & (period == "2H"))
    return F.when(turned, 100 - value if opposite is None else opposite).otherwise(value)


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def role_code(role: str = "role", code: str = "code2") -> Column:
    return F.col(role)[code]


def dominant(a: Column, b: Column, name_a: Column, name_b: Column, tie: Column | None = None) -> Column:
    """Name of the larger of two values; ``tie`` (NULL) when they are equal."""
    label = F.when(a > b, name_a).when(a < b, name_b)
    return label if tie is None else label.otherwise(tie)
