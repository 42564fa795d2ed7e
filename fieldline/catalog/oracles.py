"""DuckDB SQL for the registered queries, written apart from the Spark code.

``EV`` gives the driver's tables the shape of the event model; the rest builds
on it with common table expressions.
"""

from __future__ import annotations

import re

from fieldline import fixed

EV = """
e0 AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events
),
e1 AS (
  SELECT *, CAST(CASE WHEN k = 99 THEN 6
       WHEN event_type = 'click' THEN 8 WHEN event_type = 'view' THEN 10
       WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 3 END AS BIGINT) AS ev_id
  FROM e0
),
ev AS (
  SELECT event_id AS id, user_id AS player, CAST(day(ts) AS BIGINT) AS match,
    CASE WHEN hour(ts) < 12 THEN '1H' ELSE '2H' END AS period,
    user_id % 2 AS team, ev_id,
    CAST(CASE WHEN ev_id = 6 THEN 60
         WHEN ev_id = 8 THEN CASE k % 4 WHEN 0 THEN 80 WHEN 1 THEN 83 WHEN 2 THEN 85 ELSE 86 END
         WHEN ev_id = 10 THEN 100
         WHEN ev_id = 1 THEN CASE WHEN k % 2 = 0 THEN 12 ELSE 10 END
         WHEN ev_id = 2 THEN 20
         ELSE CASE k % 3 WHEN 0 THEN 30 WHEN 1 THEN 32 ELSE 33 END END AS BIGINT) AS sub_id,
    event_type AS ev_name,
    (hour(ts) % 12) * 3600 + minute(ts) * 60 + microsecond(ts) / 1000000.0::DOUBLE AS sec,
    k % 5 < 3 AS t1801, k % 11 = 0 AS t101, k % 13 = 0 AS t301, k % 17 = 0 AS t302, k % 19 = 0 AS t1401,
    k % 23 = 0 AS t1702, k % 2 = 0 AS t401, k % 2 = 1 AS t402, k % 3 = 0 AS t703,
    CAST(CASE WHEN k = 98 THEN 100 ELSE k END AS DOUBLE) AS x, CAST(event_id * 7 % 101 AS DOUBLE) AS y,
    CASE WHEN event_id % 4 = 0 THEN NULL
         WHEN event_id % 50 = 1 THEN CAST(CASE WHEN k = 98 THEN 100 ELSE k END AS DOUBLE)
         ELSE CAST((k * 31 + event_id) % 101 AS DOUBLE) END AS x_end,
    CASE WHEN event_id % 4 = 0 THEN NULL
         WHEN event_id % 50 = 1 THEN CAST(event_id * 7 % 101 AS DOUBLE)
         ELSE CAST(event_id * 13 % 101 AS DOUBLE) END AS y_end
  FROM e1
),
evc AS (
  SELECT *,
    CASE WHEN x > 0 AND x <= 100 THEN CAST(ceil(x / 20) AS INTEGER) - 1 ELSE 0 END AS cx,
    CASE WHEN y > 0 AND y <= 100 THEN CAST(ceil(y / 20) AS INTEGER) - 1 ELSE 0 END AS cy,
    CASE WHEN x_end IS NULL THEN NULL
         WHEN x_end = x AND y_end = y THEN pi() / 2
         ELSE atan2(y_end - y, x_end - x) + CASE WHEN y_end < y THEN 2 * pi() ELSE 0 END END AS angle
  FROM ev
)
"""

PL = """
pl AS (
  SELECT c_custkey AS wy, c_name AS name, c_custkey % 2 AS team,
    CAST(c_custkey % 30 + 165 AS DOUBLE) AS height, CAST(c_custkey % 35 + 60 AS DOUBLE) AS weight,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'DF' WHEN 'BUILDING' THEN 'MD' WHEN 'FURNITURE' THEN 'FW'
                      WHEN 'MACHINERY' THEN 'GK' END AS role
  FROM customer
)
"""

MT = """
mt AS (
  SELECT DISTINCT match, CASE WHEN match % 2 = 0 THEN 0 ELSE 1 END AS home FROM ev
)
"""

# Which rows of ``ev`` each kind of event covers.
KINDS = {
    "foul": "ev_id = 2 AND sub_id = 20",
    "accurate_pass": "ev_id = 8 AND t1801",
    "accurate_shot": "ev_id = 10 AND sub_id = 100 AND t1801",
    "duel": "ev_id = 1",
    "fk_corner": "ev_id = 3 AND sub_id = 30",
    "fk_cross": "ev_id = 3 AND sub_id = 32",
    "fk_shot": "ev_id = 3 AND sub_id = 33",
    "interception": "t1401",
    "key_pass": "t302",
    "offside": "ev_id = 6 AND sub_id = 60",
    "pass_cross": "ev_id = 8 AND sub_id = 80",
    "pass_high": "ev_id = 8 AND sub_id = 83",
    "pass_simple": "ev_id = 8 AND sub_id = 85",
    "pass_smart": "ev_id = 8 AND sub_id = 86",
    "shot": "ev_id = 10 AND sub_id = 100",
}
OF_PLAYER = ("accurate_pass", "accurate_shot")
GK = 'match AS "matchId", period AS "matchPeriod", player AS "playerId"'


def _with(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


def _share_ctes() -> list[str]:
    counts = ", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in KINDS.items())
    sums = ", ".join(f"sum({n}) OVER (PARTITION BY match, period, team) AS t_{n}" for n in KINDS)
    shares = []
    for n in KINDS:
        whole = "n_all" if n in OF_PLAYER else f"t_{n}"
        value = f"CASE WHEN {n} > 0 THEN {n}::DOUBLE / {whole} END"
        if n == "foul":
            shares += [f"{value} AS foul_pct_WRT_x", f"{value} AS foul_pct_WRT_y"]
        else:
            shares.append(f"{value} AS {n}_pct_{'WRP' if n in OF_PLAYER else 'WRT'}")
    return [
        f"cnt AS (SELECT match, period, team, player, count(*) AS n_all, {counts} FROM evc GROUP BY ALL)",
        f"tot AS (SELECT *, {sums} FROM cnt)",
        f"sh AS (SELECT match, period, player, {', '.join(shares)} FROM tot)",
    ]


SHARE_COLUMNS = fixed.PLAY_FEATURES[:16]
SEASON = """
sea AS (
  SELECT player,
    CASE WHEN count(*) FILTER (WHERE t301) > 0
         THEN count(*) FILTER (WHERE t301)::DOUBLE / count(DISTINCT match) END AS assist,
    CASE WHEN count(*) FILTER (WHERE t101) > 0
         THEN count(*) FILTER (WHERE t101)::DOUBLE / count(DISTINCT match) END AS gol,
    CASE WHEN count(*) FILTER (WHERE t1702) > 0
         THEN count(*) FILTER (WHERE t1702)::DOUBLE / count(DISTINCT match) END AS yellow_card
  FROM ev GROUP BY player
)
"""
FOOT = """
foot AS (
  SELECT player, abs(l - r)::DOUBLE / (l + r) AS ambidestro
  FROM (SELECT player, count(*) FILTER (WHERE t401) AS l, count(*) FILTER (WHERE t402) AS r FROM ev GROUP BY player)
  WHERE l + r > 0
)
"""
CENTROID = """
cen AS (
  SELECT match, period, player, avg(x) AS mx, avg(y) AS my FROM evc GROUP BY ALL
),
spr AS (
  SELECT e.match, e.period, e.player, any_value(mx) AS posizione_media_x, any_value(my) AS posizione_media_y,
    avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS standard_deviation
  FROM evc e JOIN cen c ON e.match = c.match AND e.period = c.period AND e.player = c.player
  GROUP BY e.match, e.period, e.player
)
"""
RATE = """
rat AS (
  SELECT match, period, player, max(sec) - min(sec) AS elapsed,
    (max(sec) - min(sec)) / count(DISTINCT id) AS tempo_medio_tra_eventi
  FROM evc GROUP BY ALL
)
"""
ANGLE = """
ang AS (
  SELECT match, period, player, avg(angle) AS angle_mean, stddev_samp(angle) AS angle_std FROM evc GROUP BY ALL
)
"""
DISTANCE = """
stp AS (
  SELECT match, period, player,
    sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step
  FROM evc WINDOW w AS (PARTITION BY match, period, player ORDER BY sec, id)
),
dis AS (
  SELECT match, period, player, coalesce(sum(step), 0) AS total_distance FROM stp GROUP BY ALL
)
"""
CELL_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE cx = {c[0]} AND cy = {c[1]}) AS \"{c}\"" for c in fixed.CELLS
)
CELLS = f"cel AS (SELECT match, period, player, {CELL_COUNTS} FROM evc GROUP BY ALL)"

FEATURE_CTES = [EV, PL, *_share_ctes(), SEASON, FOOT, CENTROID, RATE, ANGLE, DISTANCE, CELLS]
FEATURES = (
    "feat AS MATERIALIZED (SELECT k.match, k.period, k.player, "
    + ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in fixed.FEATURES)
    + " FROM (SELECT DISTINCT match, period, player FROM ev) k"
    + "".join(
        f" LEFT JOIN {t} ON {t}.match = k.match AND {t}.period = k.period AND {t}.player = k.player"
        for t in ("sh", "spr", "rat", "ang", "dis", "cel")
    )
    + " LEFT JOIN sea ON sea.player = k.player LEFT JOIN foot ON foot.player = k.player"
    + " LEFT JOIN pl ON pl.wy = k.player)"
)


EXACT = ("elapsed", "tempo_medio_tra_eventi")


def rounded(columns, source: str = "") -> str:
    p = f"{source}." if source else ""
    return ", ".join(f'{p}"{c}"' if c in EXACT else f'round({p}"{c}", 6) AS "{c}"' for c in columns)


def _features(body: str, *more: str) -> str:
    return _with(*FEATURE_CTES, FEATURES, *more, body=body)


def _filled_by(key: str, name: str, source: str, columns: str) -> str:
    """Gaps filled with the means of the row's own group, or 0."""
    values = ", ".join(
        f'coalesce("{c}", avg("{c}") OVER (PARTITION BY {key}), 0) AS "{c}"' if c in fixed.MEAN_FILLED else f'coalesce("{c}", 0) AS "{c}"'
        for c in fixed.FEATURES
    )
    return f"{name} AS MATERIALIZED (SELECT {columns}, {values} FROM {source})"


BY_PLAYER = _filled_by("player", "fpl", "feat", "player, match, period")
BY_ROLE = _filled_by("role", "fro", "ftab", "player, match, period, role")

# Feature rows of all players with their role, players without events included,
# gaps filled.
TABLE_CTES = (
    "ftab AS (SELECT coalesce(f.player, p.wy) AS player, f.match, f.period, p.role, "
    + ", ".join(f'f."{c}"' for c in fixed.FEATURES)
    + " FROM feat f FULL JOIN pl p ON f.player = p.wy)",
    "ful AS (SELECT player, match, period, role, "
    + ", ".join(
        f'coalesce("{c}", avg("{c}") OVER ()) AS "{c}"' if c in fixed.MEAN_FILLED else f'coalesce("{c}", 0) AS "{c}"'
        for c in fixed.FEATURES
    )
    + " FROM ftab)",
)
_CELL_LIST = ", ".join(f'{{\'v\': "{c}", \'i\': {i}}}' for i, c in enumerate(fixed.CELLS))
TOP_CELLS = (
    f"tc AS (SELECT *, [s.i for s in list_sort([{_CELL_LIST}], 'DESC')[1:3]] AS top FROM ful)",
    "kept AS (SELECT * EXCLUDE (top, "
    + ", ".join(f'"{c}"' for c in fixed.CELLS)
    + "), "
    + ", ".join(
        f'CASE WHEN list_contains(top, {i}) THEN "{c}" ELSE 0 END AS "{c}"' for i, c in enumerate(fixed.CELLS)
    )
    + " FROM tc)",
)

# --- grids ------------------------------------------------------------------
# Suffered fouls: other team (teams are 0 and 1), cell seen from the other end.
GRID = """
g0 AS (SELECT * FROM evc WHERE player <> 0),
base AS (
  SELECT team, cx, cy, count(*)::DOUBLE AS n, count(*) FILTER (WHERE ev_id = 8 AND t1801)::DOUBLE AS p,
    count(*) FILTER (WHERE ev_id = 10)::DOUBLE AS s
  FROM g0 GROUP BY ALL
),
fl AS (
  SELECT 1 - team AS team, 4 - cx AS cx, 4 - cy AS cy, count(*)::DOUBLE AS f
  FROM g0 WHERE ev_id = 2 AND sub_id = 20 GROUP BY ALL
),
ft AS (SELECT team, sum(f) AS tf FROM fl GROUP BY team),
bt AS (SELECT team, sum(n) AS tn, sum(p) AS tp, sum(s) AS ts FROM base GROUP BY team),
grid AS (
  SELECT b.team, b.cx, b.cy, n / tn AS m1, CASE WHEN tp > 0 THEN p / tp ELSE 0 END AS m2,
    CASE WHEN ts > 0 THEN s / ts ELSE 0 END AS m3, coalesce(f / tf, 0) AS m4
  FROM base b JOIN bt ON b.team = bt.team
  LEFT JOIN fl ON fl.team = b.team AND fl.cx = b.cx AND fl.cy = b.cy
  LEFT JOIN ft ON ft.team = b.team
)
"""
GRID_CELL = 'cx AS numero_cella_x, cy AS numero_cella_y'

_PASS = """
pas AS (
  SELECT player, team, count(*) FILTER (WHERE t1801)::DOUBLE / count(*) AS acc
  FROM ev WHERE ev_id = 8 GROUP BY ALL HAVING count(*) FILTER (WHERE t1801) > 0
)
"""
_TACKLE = """
tck AS (
  SELECT player, count(*) AS n_tackles, count(*) FILTER (WHERE t703) AS won FROM ev WHERE sub_id = 12 GROUP BY ALL
)
"""


def _measure(table: str, columns) -> str:
    return _with(
        EV, *{"spr": [CENTROID], "rat": [RATE], "ang": [ANGLE], "dis": [DISTANCE]}[table],
        body=f"SELECT {GK}, {rounded(columns)} FROM {table}",
    )


def _share_query(kind: str, of: str) -> str:
    whole = "n_all" if of == "WRP" else f"t_{kind}"
    return _with(
        EV, *_share_ctes(),
        body=f'SELECT {GK}, team AS "teamId", round({kind}::DOUBLE / {whole}, 6) AS "{kind}_pct_{of}" '
        f"FROM tot WHERE {kind} > 0",
    )


_SCALED = list(dict.fromkeys([*fixed.SCALED_DF, *fixed.SCALED_FW_MD]))


# --- greedy feature removal ---------------------------------------------------
_VEC = "[" + ", ".join(f'"{c}"' for c in fixed.PLAY_FEATURES) + "]"
_NAMES = "[" + ", ".join(f"'{c}'" for c in fixed.PLAY_FEATURES) + "]"
PAIRS = (
    f"halves AS (SELECT player, match, period, {_VEC} AS v FROM fpl)",
    """pairs AS (
  SELECT a.match, a.player, a.v AS a, b.v AS b FROM halves a
  JOIN halves b ON a.match = b.match AND a.player = b.player AND a.period = '1H' AND b.period = '2H'
)""",
)
_DOT = "list_sum([z[1] * z[2] for z in list_zip({0}, {1})])"
SEARCH = (
    f"""rnd AS (
  SELECT match, player, a, b, {_NAMES} AS names, CAST([] AS VARCHAR[]) AS dropped, 0 AS step, true AS live FROM pairs
  UNION ALL
  SELECT match, player,
    CASE WHEN gain THEN list_concat(a[1:pos - 1], a[pos + 1:]) ELSE a END,
    CASE WHEN gain THEN list_concat(b[1:pos - 1], b[pos + 1:]) ELSE b END,
    CASE WHEN gain THEN list_concat(names[1:pos - 1], names[pos + 1:]) ELSE names END,
    CASE WHEN gain THEN list_append(dropped, names[pos]) ELSE dropped END,
    step + 1, gain
  FROM (
    SELECT *, list_position(sc, list_max(sc)) AS pos, coalesce(list_max(sc) > round(ab / sqrt(nullif(aa * bb, 0)), 12), false) AS gain
    FROM (
      SELECT *, [round(list_sum(pab[1:i - 1] || pab[i + 1:])
                 / sqrt(nullif(list_sum(paa[1:i - 1] || paa[i + 1:]) * list_sum(pbb[1:i - 1] || pbb[i + 1:]), 0)), 12)
               FOR i IN range(1, len(a) + 1)] AS sc
      FROM (
        SELECT *, list_sum(pab) AS ab, list_sum(paa) AS aa, list_sum(pbb) AS bb FROM (
          SELECT *, [z[1] * z[2] FOR z IN list_zip(a, b)] AS pab, [z * z FOR z IN a] AS paa, [z * z FOR z IN b] AS pbb
          FROM rnd WHERE live AND step < 10
        )
      )
    )
  )
)""",
    """fin AS (
  SELECT match, player, arg_max(dropped, step) AS dropped FROM rnd GROUP BY match, player
)""",
)


def _search(body: str, *more: str) -> str:
    return _features(body, BY_PLAYER, *PAIRS, *SEARCH, *more).replace("WITH ", "WITH RECURSIVE ", 1)


# --- k-means on the embeddings --------------------------------------------------
_POINTS = [
    "pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "lng AS MATERIALIZED (SELECT vec_id, label, unnest(v) AS val, generate_subscripts(v, 1) AS d FROM pts)",
]


def _kmeans(rounds: int, *start: str) -> str:
    """Rounds from the centres c0 (c, d, m)."""
    parts = [*_POINTS, *start]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, {{'dist': round(dist, 9), 'c': c}}) AS c, min(dist) AS dist
  FROM (SELECT vec_id, c, sum((val - m) ** 2) AS dist FROM lng JOIN c{r} USING (d) GROUP BY vec_id, c)
  GROUP BY vec_id
)"""
        )
        if r < rounds:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT a.c, d, avg(val) AS m FROM lng JOIN a{r} a USING (vec_id) GROUP BY a.c, d)"
            )
    body = f"SELECT vec_id, CAST(c AS INTEGER) AS cluster, round(dist, 6) AS cost FROM a{rounds}"
    return _with(*parts, body=body)


LABEL_START = "c0 AS (SELECT label AS c, d, avg(val) AS m FROM lng GROUP BY ALL)"


def _drawn(text: str) -> str:
    """A number from 0 to 1: 52 bits of the MD5 of a text."""
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _parallel_start(k: int, seed: int = 42, rounds: int = 5, oversample: int = 2) -> list[str]:
    """First centres c0 by k-means||: points drawn by distance, weighted by the points nearest to them, k of them picked."""
    away = "list_sum(list_transform(p.v, lambda e, i: (e - q.v[i]) * (e - q.v[i])))"
    parts = [
        f"s0 AS MATERIALIZED (SELECT 0::BIGINT AS j, v FROM pts ORDER BY {_drawn(f"'{seed}:first:' || vec_id")}, vec_id LIMIT 1)",
    ]
    for r in range(1, rounds + 1):
        parts += [
            f"f{r} AS MATERIALIZED (SELECT vec_id, any_value(p.v) AS v, CAST(round(min({away}) * 1e9) AS BIGINT) AS far FROM pts p, s{r - 1} q GROUP BY vec_id)",
            f"""s{r} AS MATERIALIZED (
  SELECT * FROM s{r - 1} UNION ALL
  SELECT (SELECT count(*) FROM s{r - 1}) + row_number() OVER (ORDER BY vec_id) - 1, v FROM f{r}
  WHERE {_drawn(f"'{seed}:{r}:' || vec_id")} * (SELECT CAST(sum(far) AS DOUBLE) FROM f{r}) < CAST(far AS DOUBLE) * {float(oversample * k)}
)""",
        ]
    parts += [
        f"near AS (SELECT vec_id, arg_min(j, {{'d': round({away}, 9), 'j': j}}) AS j FROM pts p, s{rounds} q GROUP BY vec_id)",
        f"w0 AS MATERIALIZED (SELECT q.j, q.v, coalesce(n, 0)::HUGEINT AS w, NULL::HUGEINT AS far, coalesce(n, 0)::HUGEINT AS mass "
        f"FROM s{rounds} q LEFT JOIN (SELECT j, count(*) AS n FROM near GROUP BY j) n ON n.j = q.j)",
    ]
    for m in range(k):
        parts += [
            f"p{m} AS MATERIALIZED (SELECT j, v FROM (SELECT *, sum(mass) OVER (ORDER BY j) AS upto, sum(mass) OVER () AS total FROM w{m}) "
            f"WHERE CAST(upto AS DOUBLE) > {_drawn(f"'{seed}:pick{m}'")} * CAST(total AS DOUBLE) ORDER BY j LIMIT 1)",
            f"g{m} AS (SELECT p.j, least(p.far, CAST(round({away} * 1e9) AS HUGEINT)) AS far FROM w{m} p, p{m} q)",
            f"w{m + 1} AS MATERIALIZED (SELECT w.j, w.v, w.w, g.far, w.w * g.far AS mass FROM w{m} w JOIN g{m} g ON g.j = w.j)",
        ]
    picks = " UNION ALL ".join(f"SELECT {m} AS c, v FROM p{m}" for m in range(k))
    parts.append(f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS m, generate_subscripts(v, 1) AS d FROM ({picks}))")
    return parts


# Enough to be past convergence: later rounds change nothing.
KMEANS_ROUNDS = 40


# --- role models with all components ---------------------------------------------
# A full projection turns the scaled columns without changing a distance, so the
# models can be had from the columns themselves.
ROLE_ROUNDS = 60


def _role_model(role: str, train: str = "true", score: str = "true") -> list[str]:
    """Distances of the role's and of unknown rows to the final centres, in ``near_<role>`` (rid, c, dist).

    ``train`` and ``score`` are the conditions of rows that fit the model, and of those it is applied to.
    """
    r, scaled = role.lower(), fixed.SCALED_DF if role == "DF" else fixed.SCALED_FW_MD
    bounds = ", ".join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in scaled)
    values = ", ".join(
        f'CASE WHEN "hi_{c}" > "lo_{c}" THEN ("{c}" - "lo_{c}") / ("hi_{c}" - "lo_{c}") ELSE 0 END' if c in scaled else f'CAST("{c}" AS DOUBLE)'
        for c in fixed.FEATURES
    )
    parts = [
        f"b_{r} AS (SELECT {bounds} FROM rws WHERE role = '{role}' AND {train})",
        f"v_{r} AS (SELECT rid, player, role, match, [{values}] AS v FROM rws, b_{r} WHERE role = '{role}' OR role IS NULL)",
        f"l_{r} AS MATERIALIZED (SELECT rid, player, role, match, unnest(v) AS val, generate_subscripts(v, 1) AS d FROM v_{r})",
        f"c0_{r} AS MATERIALIZED (SELECT CAST(floor(player / 5) % {len(fixed.ROLE_NAMES[role])} AS INTEGER) AS c, d, avg(val) AS m "
        f"FROM l_{r} WHERE role = '{role}' AND {train} GROUP BY ALL)",
    ]
    for k in range(ROLE_ROUNDS + 1):
        only = f"WHERE role = '{role}' AND {train}" if k < ROLE_ROUNDS else f"WHERE {score}"
        parts.append(
            f"""a{k}_{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, {{'dist': round(dist, 9), 'c': c}}) AS c, min(dist) AS dist
  FROM (SELECT rid, c, sum((val - m) ** 2) AS dist FROM l_{r} JOIN c{k}_{r} USING (d) {only} GROUP BY rid, c) GROUP BY rid
)"""
        )
        if k < ROLE_ROUNDS:
            parts.append(
                f"c{k + 1}_{r} AS MATERIALIZED (SELECT a.c, d, avg(val) AS m FROM l_{r} JOIN a{k}_{r} a USING (rid) GROUP BY a.c, d)"
            )
    labels = "[" + ", ".join(f"'{x}'" for x in fixed.ROLE_NAMES[role]) + "]"
    parts.append(f"near_{r} AS (SELECT rws.*, {labels}[c + 1] AS label, dist FROM a{ROLE_ROUNDS}_{r} JOIN rws USING (rid))")
    return parts


def _roles(body: str, *more: str, train: str = "true", score: str = "true") -> str:
    names = [r.lower() for r in fixed.ROLE_NAMES]
    table, filled = TABLE_CTES
    return _features(
        body,
        table,
        filled if train == "true" else re.sub(r'avg\(("[^"]*")\) OVER \(\)', rf"avg(\1) FILTER (WHERE {train}) OVER ()", filled),
        *TOP_CELLS,
        "rws AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM kept)",
        *[part for role in fixed.ROLE_NAMES for part in _role_model(role, train, score)],
        "costs AS (" + " UNION ALL ".join(f"SELECT '{r.upper()}' AS role, sum(dist) AS cost FROM near_{r} WHERE role IS NULL" for r in names) + ")",
        "labelled AS ("
        + " UNION ALL ".join(
            f"SELECT player, match, role, label FROM near_{r} WHERE role = '{r.upper()}' "
            f"OR (role IS NULL AND '{r.upper()}' = (SELECT arg_min(role, cost) FROM costs))"
            for r in names
        )
        + ")",
        *more,
    )


_CHECKS = ", ".join(f"true AS {c}" for c in ("eigen", "unit", "orthogonal", "falling", "signed", "share"))


def _variances() -> str:
    """Sums of the shares of variance and of their squares: traces of each role's covariance matrix and of its square."""
    names = list(fixed.ROLE_NAMES)
    parts = []
    for role in names:
        r = role.lower()
        parts += [
            f"d_{r} AS MATERIALIZED (SELECT rid, d, val - avg(val) OVER (PARTITION BY d) AS x FROM l_{r} WHERE role = '{role}')",
            f"k_{r} AS MATERIALIZED (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS c FROM d_{r} a JOIN d_{r} b ON a.rid = b.rid GROUP BY ALL)",
        ]
    body = " UNION ALL ".join(
        f"""SELECT '{role}' AS role, count(*) FILTER (WHERE i = j) AS components, round(CASE WHEN t > 1e-12 THEN sum(c) FILTER (WHERE i = j) / t ELSE 0 END, 6) AS total,
  round(CASE WHEN t > 1e-12 THEN sum(c * c) / t ** 2 ELSE 0 END, 6) AS squares, CASE WHEN t > 1e-12 THEN 1.0 ELSE 0.0 END::DOUBLE AS cumulative
FROM k_{role.lower()}, (SELECT sum(c) AS t FROM k_{role.lower()} WHERE i = j) GROUP BY t"""
        for role in names
    )
    return _roles(body, *parts)


def _assembled() -> str:
    """All measures per match and player, those per player beside them."""
    return _with(
        EV, SEASON, FOOT,
        "mc AS (SELECT match, team, player, count(*) AS n_all, "
        + ", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in KINDS.items())
        + " FROM evc GROUP BY ALL)",
        "ms AS (SELECT match, player, "
        + ", ".join(
            f"CASE WHEN {n} > 0 THEN {n}::DOUBLE / "
            + ("n_all" if n in OF_PLAYER else f"sum({n}) OVER (PARTITION BY match, team)")
            + f" END AS {column}"
            for n in KINDS
            for column in (
                ["foul_pct_WRT_x", "foul_pct_WRT_y"] if n == "foul" else [f"{n}_pct_{'WRP' if n in OF_PLAYER else 'WRT'}"]
            )
        )
        + " FROM mc)",
        "mp AS (SELECT match, player, (max(sec) - min(sec)) / count(DISTINCT id) AS tempo_medio_tra_eventi, "
        "avg(angle) AS angle_mean, stddev_samp(angle) AS angle_std FROM evc GROUP BY ALL)",
        "m AS (SELECT ms.*, mp.* EXCLUDE (match, player) FROM ms JOIN mp ON ms.match = mp.match AND ms.player = mp.player)",
        body='SELECT m.player AS "playerId", m.match AS "matchId", '
        + rounded([*SHARE_COLUMNS, "tempo_medio_tra_eventi", "angle_mean", "angle_std", "assist", "gol", "yellow_card", "ambidestro"])
        + " FROM m LEFT JOIN sea ON sea.player = m.player LEFT JOIN foot ON foot.player = m.player "
        "WHERE m.player <> 0",
    )


def oracle_sql() -> dict[str, str]:
    tags = ", ".join(
        f"CASE WHEN t{t} THEN '{t}' END" for t in (1801, 101, 301, 302, 1401, 1702, 401, 402, 703)
    )
    n_tags = " + ".join(f"t{t}::INT" for t in (1801, 101, 301, 302, 1401, 1702, 401, 402, 703))
    cells = ", ".join(f'"{c}"' for c in fixed.CELLS)
    acc, mean, sd = fixed.ACCURACY_COLUMNS
    who, name, won = fixed.TACKLE_COLUMNS
    ident = 'player AS "playerId", match AS "matchId", period AS "matchPeriod"'
    out = {
        # one row per event
        "tag_ids": _with(EV, body=f"SELECT id, concat_ws(',', {tags}) AS tag_list, {n_tags} AS n_tags FROM ev"),
        "positions": _with(
            EV, body="SELECT id, y AS y_start, x AS x_start, y_end, x_end, x_end IS NOT NULL AS has_doublepos FROM ev"
        ),
        "grid_cell": _with(
            EV, body=f"SELECT id, {GRID_CELL}, CAST(cx AS VARCHAR) || CAST(cy AS VARCHAR) AS cell FROM evc"
        ),
        "move_angle": _with(EV, body="SELECT id, round(angle, 6) AS angle FROM evc WHERE angle IS NOT NULL"),
        "move_distance": _with(
            EV,
            body="SELECT id, round(sqrt((coalesce(x_end, x) - x) ** 2 + (coalesce(y_end, y) - y) ** 2), 6) "
            "AS distance FROM ev",
        ),
        "select_event": _with(
            EV, body="SELECT id, player AS \"playerId\" FROM ev WHERE ev_id = 8 AND t1801"
        ),
        "event_kinds": _with(
            EV,
            body=" UNION ALL ".join(
                f"SELECT '{n}' AS kind, count(*) AS n FROM ev WHERE {w}"
                for n, w in {**KINDS, "assist": "t301", "gol": "t101", "yellow_card": "t1702"}.items()
            ),
        ),
        "previous_event": _with(
            EV,
            body=f"SELECT id, {GK}, lag(sec) OVER (PARTITION BY match, period, player ORDER BY sec, id) "
            "AS previous_sec FROM ev",
        ),
        "two_position_pct": _with(
            EV,
            body='SELECT ev_name AS "eventName", round(100.0 * count(x_end) / count(*), 6) AS two_position_pct '
            "FROM ev GROUP BY ev_name",
        ),
        "home_team": _with(EV, MT, body='SELECT match AS "matchId", CAST(home AS BIGINT) AS home_team FROM mt'),
        "side_normalised": _with(
            EV, MT,
            body="""SELECT id,
  CASE WHEN (team <> home AND period = '1H') OR (team = home AND period = '2H') THEN 100 - x ELSE x END AS x,
  CASE WHEN (team <> home AND period = '1H') OR (team = home AND period = '2H') THEN 100 - y ELSE y END AS y
FROM ev JOIN mt ON ev.match = mt.match""",
        ),
        # accuracy and tackles
        "pass_accuracy": _with(
            EV, _PASS,
            body=f"SELECT team AS {acc}, round_even(avg(acc), 2) AS {mean}, round_even(stddev_samp(acc), 2) AS {sd} "
            "FROM pas GROUP BY team",
        ),
        "pass_accuracy_by_player": _with(
            EV, _PASS, body='SELECT player AS "playerId", team AS "teamId", round(acc, 6) AS accuracy FROM pas'
        ),
        "tackle_counts": _with(
            EV, _TACKLE, body='SELECT player AS "playerId", n_tackles, won AS n_tackles_won FROM tck'
        ),
        "top_tacklers": _with(
            EV, PL, _TACKLE,
            body=f"""SELECT player AS {who}, name AS {name}, won AS {won} FROM tck JOIN pl ON pl.wy = tck.player
WHERE won > (SELECT quantile_cont(won, 0.75) FROM tck WHERE won > 0)""",
        ),
        # shares and means
        "event_share_team": _share_query("shot", "WRT"),
        "event_share_player": _share_query("accurate_pass", "WRP"),
        "event_rates": _with(
            EV, *_share_ctes(),
            body=f"SELECT {GK}, {rounded(SHARE_COLUMNS)} FROM sh "
            f"WHERE coalesce({', '.join(SHARE_COLUMNS)}) IS NOT NULL",
        ),
        "season_mean": _with(
            EV, SEASON, body=f'SELECT player AS "playerId", {rounded(["assist", "gol", "yellow_card"])} FROM sea'
        ),
        "foot_balance": _with(EV, FOOT, body=f'SELECT player AS "playerId", {rounded(["ambidestro"])} FROM foot'),
        "appearances": _with(
            EV, body='SELECT player AS "playerId", count(DISTINCT match) AS numero_presenze FROM ev GROUP BY player'
        ),
        # movement
        "position_dispersion": _measure("spr", ["posizione_media_x", "posizione_media_y", "standard_deviation"]),
        "elapsed_time": _measure("rat", ["elapsed"]),
        "event_rate": _measure("rat", ["tempo_medio_tra_eventi"]),
        "angle_stats": _measure("ang", ["angle_mean", "angle_std"]),
        "total_distance": _measure("dis", ["total_distance"]),
        # cells and grids
        "cell_counts": _with(EV, CELLS, body=f"SELECT {GK}, {cells} FROM cel"),
        "match_cell_counts": _with(
            EV, body=f'SELECT match AS "matchId", period AS "matchPeriod", {CELL_COUNTS} FROM evc GROUP BY ALL'
        ),
        "cell_share": _with(
            EV, CELLS, "own AS (SELECT * FROM cel WHERE player <> 0)",
            "per AS (SELECT match, period, " + ", ".join(f'sum("{c}") AS "{c}"' for c in fixed.CELLS)
            + " FROM own GROUP BY ALL)",
            body='SELECT own.match AS "matchId", own.period AS "matchPeriod", own.player AS "playerId", '
            + ", ".join(f'round(own."{c}"::DOUBLE / nullif(per."{c}", 0), 6) AS "{c}"' for c in fixed.CELLS)
            + " FROM own JOIN per ON own.match = per.match AND own.period = per.period",
        ),
        "grid_frequency": _with(
            EV, GRID,
            body=f"SELECT team AS nome_squadra, {GRID_CELL}, "
            + ", ".join(f"round(m{i + 1}, 6) AS {m}" for i, m in enumerate(fixed.GRID_METRICS))
            + " FROM grid",
        ),
        "grid_matrix": _with(
            EV, GRID,
            body=" UNION ALL ".join(
                f"SELECT team AS nome_squadra, {m} AS tipo_griglia, cy AS numero_cella_y, "
                + ", ".join(f"round(avg(m{m}) FILTER (WHERE cx = {i}), 6) AS x{i}" for i in range(5))
                + " FROM grid GROUP BY team, cy"
                for m in range(1, 5)
            ),
        ),
        "grid_similarity": _with(
            EV, GRID,
            body=" UNION ALL ".join(
                f"""SELECT {i} AS tipo_griglia,
  round(sum(coalesce(a.m{i}, 0) * coalesce(b.m{i}, 0))
    / (sqrt(sum(coalesce(a.m{i}, 0) ** 2)) * sqrt(sum(coalesce(b.m{i}, 0) ** 2))), 6) AS similarity
FROM (SELECT * FROM grid WHERE team = 0) a FULL JOIN (SELECT * FROM grid WHERE team = 1) b
  ON a.cx = b.cx AND a.cy = b.cy"""
                for i in range(1, 5)
            ),
        ),
        "grid_dominance": _with(
            EV, GRID,
            body=" UNION ALL ".join(
                f"""SELECT a.cx AS numero_cella_x, a.cy AS numero_cella_y,
  round(abs(a.m{i} - b.m{i}), 6) AS differenza_di_frequenza,
  CASE WHEN a.m{i} > b.m{i} THEN 0 WHEN a.m{i} < b.m{i} THEN 1 END AS squadra_dominante, {i} AS tipo_griglia
FROM grid a JOIN grid b ON a.team = 0 AND b.team = 1 AND a.cx = b.cx AND a.cy = b.cy"""
                for i in range(1, 5)
            ),
        ),
        "suffered_fouls": _with(
            EV,
            body="SELECT 1 - team AS \"teamId\", 4 - cx AS numero_cella_x, 4 - cy AS numero_cella_y, "
            "count(*) AS n_foul FROM evc WHERE ev_id = 2 AND sub_id = 20 GROUP BY ALL",
        ),
        # features
        "player_features": _features(f"SELECT {GK}, {rounded(fixed.FEATURES)} FROM feat"),
        "impute": _features(
            f"SELECT {ident}, role, {rounded(fixed.FEATURES)} FROM ful", *TABLE_CTES
        ),
        "impute_by_role": _features(f"SELECT {ident}, role, {rounded(fixed.FEATURES)} FROM fro", *TABLE_CTES, BY_ROLE),
        "impute_by_player": _features(f"SELECT {ident}, {rounded(fixed.FEATURES)} FROM fpl", BY_PLAYER),
        "top_cells": _features(f"SELECT {ident}, {cells} FROM kept", *TABLE_CTES, *TOP_CELLS),
        "minmax": _features(
            f"SELECT {ident}, "
            + ", ".join(
                f'round(CASE WHEN max("{c}") OVER () = min("{c}") OVER () THEN 0 '
                f'ELSE ("{c}" - min("{c}") OVER ()) / (max("{c}") OVER () - min("{c}") OVER ()) END, 6) AS "{c}"'
                for c in _SCALED
            )
            + " FROM ful",
            *TABLE_CTES,
        ),
        "distance_histogram": _features(
            """SELECT role, bin, round(any_value(lo + bin * w), 6) AS bin_start, count(*) AS n FROM (
  SELECT role, lo, (hi - lo) / nb AS w,
    CAST(least(floor((total_distance - lo) / ((hi - lo) / nb)), nb - 1) AS INTEGER) AS bin
  FROM (SELECT role, total_distance, min(total_distance) OVER (PARTITION BY role) AS lo,
          max(total_distance) OVER (PARTITION BY role) AS hi, CASE role WHEN 'DF' THEN 15 ELSE 10 END AS nb
        FROM feat JOIN pl ON pl.wy = feat.player WHERE role IN ('DF', 'MD', 'FW'))
) GROUP BY role, bin"""
        ),
        "distance_quantile": _features(
            """SELECT role, unnest([0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS q, n, round(unnest(v), 6) AS total_distance FROM (
  SELECT role, count(total_distance) AS n, quantile_cont(total_distance, [0.25, 0.5, 0.75, 0.99]) AS v
  FROM feat LEFT JOIN pl ON pl.wy = feat.player GROUP BY role)"""
        ),
        "far_runners": _features(
            """SELECT player AS "playerId", match AS "matchId", period AS "matchPeriod", round(total_distance, 6) AS total_distance
FROM feat WHERE total_distance > (SELECT quantile_cont(total_distance, 0.75) FROM feat)"""
        ),
        "assemble_measures": _assembled(),
        "measure_folder": _assembled(),
        # tables
        "role_override": _with(
            PL, EV,
            body='SELECT wy AS "wyId", CASE WHEN wy IN (SELECT player FROM ev WHERE t101) THEN \'FW\' ELSE role END '
            "AS role FROM pl",
        ),
        "value_counts": _with(EV, body='SELECT period AS "matchPeriod", count(*) AS n FROM ev GROUP BY period'),
        "distinct_roles": _with(PL, body="SELECT DISTINCT role FROM pl"),
        "group_count": _with(
            EV, body="SELECT count(*) AS n_groups FROM (SELECT DISTINCT match, period, player FROM ev)"
        ),
        "idle_players": "SELECT c_custkey AS \"playerId\" FROM customer EXCEPT SELECT user_id FROM events",
        "name_search": _with(
            PL, body="SELECT wy AS \"wyId\", name AS \"lastName\" FROM pl WHERE regexp_matches(name, '7.*9')"
        ),
        # vectors
        "seed_centroids": """
SELECT label AS seed_group, d - 1 AS axis, round(avg(val), 6) AS value, count(*) AS n
FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS val, generate_subscripts(embedding, 1) AS d FROM embeddings)
GROUP BY label, d
""",
        "seeded_kmeans": _kmeans(KMEANS_ROUNDS, LABEL_START),
        "random_kmeans": _kmeans(KMEANS_ROUNDS, *_parallel_start(9)),
        "pca_components": f"SELECT CAST(i AS INTEGER) AS component, {_CHECKS} FROM range(18) AS t(i)",
        "pca_energy": """
WITH lng AS (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS val, generate_subscripts(embedding, 1) AS d FROM embeddings
), mu AS (SELECT d, avg(val) AS m FROM lng GROUP BY d)
SELECT vec_id, round(sum((val - m) ** 2), 6) AS energy FROM lng JOIN mu USING (d) GROUP BY vec_id
""",
        "pca_moments": """
WITH lng AS (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS val, generate_subscripts(embedding, 1) AS d FROM embeddings
),
dev AS (SELECT vec_id, d, val - avg(val) OVER (PARTITION BY d) AS v FROM lng),
c1 AS (
  SELECT a.d AS i, b.d AS j, sum(a.v * b.v) / (SELECT count(*) - 1 FROM embeddings) AS c
  FROM dev a JOIN dev b ON a.vec_id = b.vec_id GROUP BY ALL
),
c2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c1 a JOIN c1 b ON a.j = b.i GROUP BY ALL)
SELECT 1 AS power, round(sum(c), 6) AS total FROM c1 WHERE i = j
UNION ALL SELECT 2, round(sum(c), 6) FROM c2 WHERE i = j
UNION ALL SELECT 3, round(sum(a.c * b.c), 6) FROM c1 a JOIN c2 b ON a.i = b.j AND a.j = b.i
UNION ALL SELECT 4, round(sum(c * c), 6) FROM c2
""",
        "pca_crossed": """
SELECT DISTINCT CAST(d - 2 AS INTEGER) AS component, true AS uncorrelated
FROM (SELECT generate_subscripts(embedding, 1) AS d FROM embeddings) WHERE d > 1
""",
        # roles
        "role_clusters_full": _roles("SELECT label, count(*) AS n FROM labelled GROUP BY label"),
        "unknown_role_full": _roles("SELECT role, round(cost, 6) AS cost FROM costs"),
        "seed_check_full": _roles(
            "SELECT player AS \"playerId\", label, count(*) AS n, any_value(name) AS name, ANY_VALUE(pl.role) AS examples_of "
            "FROM labelled JOIN pl ON pl.wy = labelled.player WHERE pl.role IN ('DF', 'MD', 'FW') GROUP BY player, label"
        ),
        "role_report_full": _roles(
            f"""SELECT {", ".join(f"{c} AS {n}" for c, n in zip(("app.player", "pl.name", "n_name", "label", "n"), fixed.REPORT_COLUMNS))}
FROM (SELECT player, count(DISTINCT match) AS n FROM kept GROUP BY player) app
LEFT JOIN pl ON pl.wy = app.player LEFT JOIN nation ON n_nationkey = pl.team LEFT JOIN (SELECT DISTINCT player, label FROM labelled) lab ON lab.player = app.player"""
        ),
        "pca_variance": _variances(),
        "role_components": "SELECT role, CAST(i AS INTEGER) AS component, "
        + _CHECKS
        + " FROM (VALUES "
        + ", ".join(f"('{r}', {k})" for r, k in fixed.ROLE_COMPONENTS.items())
        + ") AS t(role, k), range(60) AS n(i) WHERE i < k",
        "saved_roles": _roles(
            "SELECT role, label, count(*) AS n FROM labelled GROUP BY role, label",
            train="coalesce(match % 2 <> 0, true)", score="coalesce(match % 2 = 0, false)",
        ),
        # files
        **dict.fromkeys(("event_arrays", "event_ranges", "event_lines", "event_parquet"), _with(
            EV,
            body='SELECT id, player AS "playerId", match AS "matchId", period AS "matchPeriod", team AS "teamId", ev_id AS "eventId", '
            f'sub_id AS "subEventId", ev_name AS "eventName", sec AS "eventSec", x, y, x_end, y_end, concat_ws(\',\', {tags}) AS tag_list FROM ev',
        )),
        "dimension_files": _with(
            EV, PL,
            body="""SELECT 'player' AS kind, wy AS id, concat_ws('|', name, name, role) AS text, height + weight AS size FROM pl
UNION ALL SELECT 'team', n_nationkey, concat_ws('|', 'Team' || n_nationkey, n_name), 0.0::DOUBLE FROM nation
UNION ALL SELECT DISTINCT 'match', match, CASE WHEN match % 2 = 0 THEN 'Team0 - Team1' ELSE 'Team1 - Team0' END, 0.0::DOUBLE FROM ev
UNION ALL SELECT 'name', wy, name, 0.0::DOUBLE FROM pl""",
        ),
        "feature_csv": _features(f"SELECT {GK}, {rounded(fixed.FEATURES)} FROM feat"),
        "ordered_report": _with(
            EV,
            body="""SELECT player AS "playerId", n AS numero_presenze, row_number() OVER (ORDER BY n DESC, player) - 1 AS position
FROM (SELECT player, count(DISTINCT match) AS n FROM ev GROUP BY player)""",
        ),
        "player_lookup": _with(PL, body='SELECT wy AS "playerId", name FROM pl WHERE wy IN (7, 14, 21)'),
        "table_shape": _features(f"SELECT count(*) AS n_rows, {len(fixed.FEATURES) + 3}::BIGINT AS n_columns FROM feat"),
        # search
        "pair_cosine": _features(
            f'SELECT match AS "matchId", player AS "playerId", round({_DOT.format("a", "b")} / '
            f'sqrt({_DOT.format("a", "a")} * {_DOT.format("b", "b")}), 6) AS cosine FROM pairs',
            BY_PLAYER, *PAIRS,
        ),
        "dropped_features": _search(
            'SELECT match AS "matchId", player AS "playerId", array_to_string(dropped, \',\') AS dropped, '
            "CAST(len(dropped) AS INTEGER) AS n_dropped FROM fin"
        ),
        "feature_search": _search(
            "SELECT feature, count(*) AS n FROM (SELECT unnest(dropped) AS feature FROM fin) GROUP BY feature"
        ),
        "feature_difference": _search(
            "SELECT place, feature FROM dr WHERE team = 0 EXCEPT SELECT place, feature FROM dr WHERE team = 1",
            "dr AS (SELECT player % 2 AS team, unnest(dropped) AS feature, "
            "CAST(generate_subscripts(dropped, 1) - 1 AS INTEGER) AS place FROM fin)",
        ),
        "most_dropped_feature": _search(
            "SELECT team AS \"teamId\", arg_min(feature, {'n': -n, 'f': feature}) AS feature FROM "
            "(SELECT team, feature, count(*) AS n FROM dr GROUP BY ALL) GROUP BY team",
            "dr AS (SELECT player % 2 AS team, unnest(dropped) AS feature FROM fin)",
        ),
    }
    for key, events, own in (("match_grid_frequency", "evc", "evc"), ("match_grid_frequency_sides", "turned", "turned")):
        turned = """trn AS (
  SELECT ev.* EXCLUDE (x, y),
    CASE WHEN (team <> home AND period = '1H') OR (team = home AND period = '2H') THEN 100 - x ELSE x END AS x,
    CASE WHEN (team <> home AND period = '1H') OR (team = home AND period = '2H') THEN 100 - y ELSE y END AS y
  FROM ev JOIN mt ON ev.match = mt.match
),
turned AS (
  SELECT *, CASE WHEN x > 0 AND x <= 100 THEN CAST(ceil(x / 20) AS INTEGER) - 1 ELSE 0 END AS cx,
    CASE WHEN y > 0 AND y <= 100 THEN CAST(ceil(y / 20) AS INTEGER) - 1 ELSE 0 END AS cy
  FROM trn
)"""
        ctes = [EV] if key == "match_grid_frequency" else [EV, MT, turned]
        counts = (
            "count(*)::DOUBLE AS n, count(*) FILTER (WHERE ev_id = 8 AND t1801)::DOUBLE AS p, "
            "count(*) FILTER (WHERE ev_id = 10)::DOUBLE AS s"
        )
        out[key] = _with(
            *ctes,
            f"pm AS (SELECT match, team, {counts} FROM {own} WHERE player <> 0 GROUP BY ALL)",
            f"pc AS (SELECT team, cx, cy, {counts} FROM {own} WHERE player <> 0 GROUP BY ALL)",
            body=f"""SELECT match AS "matchId", pm.team AS "teamId", {GRID_CELL},
  round(pc.n / pm.n, 6) AS events_freq, round(coalesce(pc.p / nullif(pm.p, 0), 0), 6) AS acc_pass_freq,
  round(coalesce(pc.s / nullif(pm.s, 0), 0), 6) AS shot_freq
FROM pm JOIN pc ON pm.team = pc.team""",
        )
    return out
