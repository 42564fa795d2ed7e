"""Role models: scale, centre, PCA, k-means from known examples, labels."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldline import fixed
from fieldline.functions.events import role_code
from fieldline.functions.vectors import distances, nearest, nearest_index, pick_label
from fieldline.operators.scaling import impute, keep_top_cells
from fieldline.session import discard, materialise

MAX_ITERATIONS = 300
TOLERANCE = 1e-4

Centres = list[list[float]]

# The last step of a PCA decomposes a small matrix on the driver, in a library
# that is not safe to call from two threads at once.
_DECOMPOSITION = Lock()


def override_role(roles: DataFrame, ids: Sequence[int] | DataFrame, role: str, key: str = "wyId") -> DataFrame:
    """Give the listed players another classic role.

    ``ids`` is a list or, for many players, a table with ``playerId``.
    """
    if isinstance(ids, DataFrame):
        listed = ids.select(F.col("playerId").alias(key)).distinct().withColumn("_listed", F.lit(True))
        marked = roles.join(listed, key, "left")
        return marked.withColumn("role", F.when(F.col("_listed"), role).otherwise(F.col("role"))).drop("_listed")
    return roles.withColumn("role", F.when(F.col(key).isin(list(ids)), role).otherwise(F.col("role")))


def classic_roles(players: DataFrame) -> DataFrame:
    return players.select("wyId", role_code().alias("role"))


def with_roles(features: DataFrame, roles: DataFrame) -> DataFrame:
    """Feature rows with the classic role.

    Players without any event stay, with their own id and no match.
    """
    roles = roles.select(F.col("wyId").alias("playerId"), "role")
    active = features.join(roles, "playerId", "left")
    idle = roles.join(features.select("playerId").distinct(), "playerId", "left_anti")
    return active.unionByName(idle, allowMissingColumns=True)


def filled_table(features: DataFrame, roles: DataFrame) -> DataFrame:
    """Feature rows with roles and gaps filled over all roles together.

    Give stored features: they are read for the means, for the players without
    any event, and for the rows.
    """
    return impute(with_roles(features, roles), keep_null=["matchId", "playerId"])


def role_table(features: DataFrame, roles: DataFrame) -> DataFrame:
    """The table the role models read: gaps filled, top cells kept."""
    return keep_top_cells(filled_table(features, roles))


def principal_components(columns: Sequence[str], k: int, scaled: Sequence[str] = ()) -> Pipeline:
    """Scale ``scaled`` to [0, 1], pass the other columns, centre, project.

    A constant scaled column is moved to 0 by the centring.
    """
    rest = [c for c in columns if c not in scaled]
    stages = []
    inputs = list(rest)
    if scaled:
        stages += [
            VectorAssembler(inputCols=list(scaled), outputCol="_to_scale"),
            MinMaxScaler(inputCol="_to_scale", outputCol="_scaled"),
        ]
        inputs = ["_scaled", *rest]
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="_vector"),
        StandardScaler(inputCol="_vector", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="_components"),
    ]
    return Pipeline(stages=stages)


def loadings(model: PipelineModel) -> np.ndarray:
    """The components' loadings as columns, each turned so that its largest loading is positive (the first of equal ones)."""
    found = model.stages[-1].pc.toArray()
    return found * _turns(found)


def _turns(found: np.ndarray) -> np.ndarray:
    largest = np.abs(found).argmax(axis=0)
    return np.where(found[largest, np.arange(found.shape[1])] < 0, -1.0, 1.0)


def transform_components(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with its components as an array column ``components``.

    A component's sign is that of ``loadings``, so that it does not depend on
    the library that decomposed the matrix.
    """
    kept = df.columns
    turns = F.array(*[F.lit(float(t)) for t in _turns(model.stages[-1].pc.toArray())])
    turned = F.zip_with(vector_to_array("_components"), turns, lambda v, t: v * t)
    return model.transform(df).select(*kept, turned.alias("components"))


def component_columns(df: DataFrame, k: int) -> DataFrame:
    """The array of components as columns c_0 .. c_{k-1}."""
    return df.select(
        *[c for c in df.columns if c != "components"],
        *[F.expr(f"get(components, {i}) AS c_{i}") for i in range(k)],
    )


def explained_variance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Share of variance per component and running sum: k rows; 0 where there is no variance at all."""
    ratios = np.nan_to_num([float(v) for v in model.stages[-1].explainedVariance]).tolist()
    rows, total = [], 0.0
    for i, r in enumerate(ratios):
        total += r
        rows.append((i, r, total))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def covariance(points: DataFrame, column: str, size: int) -> np.ndarray:
    """Sample covariance of an array column of ``size`` numbers: two passes in Arrow batches, size x size numbers to the driver."""

    def summed(make, shape: tuple[int, int]) -> np.ndarray:
        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                if len(batch):
                    total += make(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["at", "x"])

        out = np.zeros(shape[0] * shape[1])
        for row in points.select(column).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[row["at"]] = row["x"]
        return out.reshape(shape)

    sums = summed(lambda x: np.append(x.sum(axis=0), len(x))[None], (1, size + 1))[0]
    mean, n = sums[:size] / max(sums[size], 1), sums[size]
    return summed(lambda x: (x - mean).T @ (x - mean), (size, size)) / max(n - 1, 1)


def component_checks(model: PipelineModel, df: DataFrame, within: float = 1e-9) -> DataFrame:
    """Whether the fitted components are what they should be, one row each.

    ``eigen``: the covariance matrix of the centred columns, added up apart from
    the fit, maps the loadings to their multiple; ``unit``, ``orthogonal`` (to
    all others), ``falling`` (no less variance than the next), ``signed``;
    ``share``: its part of the variance is the one stated.
    """
    found = loadings(model)
    size, k = found.shape
    centred = model.transform(df).select(vector_to_array("_centred").alias("v"))
    c = covariance(centred, "v", size)
    values = np.einsum("ij,ij->j", found, c @ found)
    off = np.abs(c @ found - found * values).max(axis=0)
    apart = np.abs(found.T @ found - np.eye(k))
    scale = max(float(np.abs(c).max()), 1e-300)
    stated = np.nan_to_num([float(v) for v in model.stages[-1].explainedVariance])
    rows = [
        (
            i,
            bool(off[i] <= within * scale),
            bool(apart[i, i] <= within),
            bool(np.delete(apart[i], i).max(initial=0) <= within),
            bool(i + 1 == k or values[i] >= values[i + 1] - within * scale),
            bool(found[np.abs(found[:, i]).argmax(), i] > 0),
            bool(abs(stated[i] - values[i] / max(float(np.trace(c)), 1e-300)) <= within),
        )
        for i in range(k)
    ]
    names = ", ".join(f"{n} boolean" for n in ("eigen", "unit", "orthogonal", "falling", "signed", "share"))
    return df.sparkSession.createDataFrame(rows, f"component int, {names}")


def group_means(points: DataFrame, group: str | Sequence[str], size: int, point: str = "components") -> DataFrame:
    """Mean vector per group."""
    mean = ", ".join(f"avg(get(`{point}`, {i}))" for i in range(size))
    keys = [group] if isinstance(group, str) else list(group)
    return points.groupBy(*keys).agg(F.expr(f"array({mean}) AS centre"), F.count("*").alias("n"))


def example_groups(spark: SparkSession, groups: Sequence[Sequence[int]]) -> DataFrame:
    """Lists of known players as rows (playerId, seed_group)."""
    rows = [(int(p), g) for g, ids in enumerate(groups) for p in ids]
    return spark.createDataFrame(rows, "playerId long, seed_group int")


def seed_centroids(points: DataFrame, examples: DataFrame, size: int) -> DataFrame:
    """Mean component vector of the rows of each group of known players."""
    known = points.join(examples, "playerId")
    return group_means(known, "seed_group", size)


def seed_centres(points: DataFrame, examples: DataFrame, k: int, size: int) -> Centres:
    """The k seed centroids on the driver: k vectors, whatever the data size."""
    found = {r["seed_group"]: r["centre"] for r in seed_centroids(points, examples, size).collect()}
    missing = [g for g in range(k) if g not in found]
    if missing:
        raise ValueError(f"no rows for example groups {missing}")
    return [list(found[g]) for g in range(k)]


def _shift(old: Centres, new: Centres) -> float:
    return sum((a - b) ** 2 for p, q in zip(old, new) for a, b in zip(p, q))


def _tolerances(points: DataFrame, sizes: Mapping[str, int]) -> dict[str, float]:
    """A small part of the mean variance of each group's points."""
    total = " + ".join(f"coalesce(var_pop(get(components, {i})), 0)" for i in range(max(sizes.values())))
    found = {r["group"]: r["v"] for r in points.groupBy("group").agg(F.expr(f"{total} AS v")).collect()}
    return {g: TOLERANCE * (found.get(g) or 0.0) / size for g, size in sizes.items()}


# Points a row of the table that the rounds read, and points whose distances are taken at a time.
BLOCK_POINTS, CACHED_POINTS = 16, 512

# Points near borders are stored apart after so many rounds, for some steps of the last one's size.
SETTLE_ROUNDS, SETTLE_STEPS = 4, 6

# Points closer than this to a border are always near: distances that are equal to 9 decimals count as ties.
TIE_MARGIN = 1e-4


def _packed(points: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """(group, block): the points of each group in blocks of bytes, so that a round moves no single numbers.

    ``sizes`` are the lengths of the groups' points; other groups are left out.
    """

    def run(batches):
        for batch in batches:
            groups, found = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for g, size in sizes.items():
                own = np.flatnonzero(groups == g)
                if not len(own):
                    continue
                mine = found if len(own) == len(batch) else found.take(pa.array(own))
                if mine.null_count or (np.diff(np.asarray(mine.offsets)) != size).any():
                    raise ValueError(f"a point of {g} that has not {size} components")
                numbers = mine.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).tobytes()
                step = 8 * size * BLOCK_POINTS
                blocks = [numbers[at : at + step] for at in range(0, len(numbers), step)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(blocks)), pa.array(blocks, pa.binary())], names=["group", "block"])

    wanted = points.filter(F.col("group").isin(list(sizes)))
    return wanted.select("group", "components").mapInArrow(run, "group string, block binary")


def _points(packed: pa.Array, size: int) -> np.ndarray:
    """The points of some blocks as the rows of a matrix."""
    found = b"".join(memoryview(x.as_buffer()) for x in packed)
    return np.frombuffer(found, dtype=float).reshape(-1, size)


def _own_points(batch: pa.RecordBatch, tables: Mapping[str, np.ndarray]):
    """(group, its centres, some of its points) as far as a batch holds them."""
    names = batch.column(0).to_numpy(zero_copy_only=False)
    for g, table in tables.items():
        own = np.flatnonzero(names == g)
        if len(own):
            x = _points(batch.column(1) if len(own) == len(batch) else batch.column(1).take(pa.array(own)), table.shape[1])
            for at in range(0, len(x), CACHED_POINTS):
                yield g, table, x[at : at + CACHED_POINTS]


def _sums(x: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
    """Per centre the sum of its points and their number."""
    hot = (index[:, None] == np.arange(k)).astype(float)
    return np.hstack([hot.T @ x, hot.sum(axis=0)[:, None]])


def _is_near(found: np.ndarray, margin: float) -> np.ndarray:
    """Points whose second nearest centre is at most ``margin`` farther than the nearest."""
    if found.shape[1] < 2:
        return np.isnan(found).any(axis=1)
    first, second = np.sqrt(np.partition(found, 1, axis=1)[:, :2]).T
    return ~(second - first > margin) | np.isnan(found).any(axis=1)


def _cluster_sums(packed: DataFrame, centres: Mapping[str, Centres], margins: Mapping[str, float] | None = None) -> dict[str, np.ndarray]:
    """Sums and numbers of the packed points nearest to each centre, for several groups of points in one pass.

    A task carries the centres of all groups, adds up its batches with numpy and
    sends k x (d + 1) numbers a group; Spark sums them, and as many reach the driver.
    With ``margins``, only points farther than that from any border are counted.
    """
    tables = {g: np.array(c) for g, c in centres.items()}

    def run(batches):
        totals = {g: np.zeros((len(t), t.shape[1] + 1)) for g, t in tables.items()}
        for batch in batches:
            for g, table, x in _own_points(batch, tables):
                found = distances(x, table)
                index = nearest_index(found)
                if margins is not None:
                    far = ~_is_near(found, margins[g])
                    x, index = x[far], index[far]
                totals[g] += _sums(x, index, len(table))
        for g, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * total.size), pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["group", "at", "x"]
            )

    sums = {g: np.zeros(t.shape[0] * (t.shape[1] + 1)) for g, t in tables.items()}
    wanted = packed.filter(F.col("group").isin(list(tables)))
    for row in wanted.mapInArrow(run, "group string, at int, x double").groupBy("group", "at").agg(F.sum("x").alias("x")).collect():
        sums[row["group"]][row["at"]] = row["x"]
    return {g: sums[g].reshape(len(t), -1) for g, t in tables.items()}


def _near_borders(packed: DataFrame, centres: Mapping[str, Centres], margins: Mapping[str, float]) -> DataFrame:
    """The points that ``_cluster_sums`` leaves out with these margins, packed again."""
    tables = {g: np.array(c) for g, c in centres.items()}

    def run(batches):
        for batch in batches:
            kept: dict[str, list[bytes]] = {}
            for g, table, x in _own_points(batch, tables):
                found = distances(x, table)
                near = x[_is_near(found, margins[g])]
                kept.setdefault(g, []).append(near.tobytes())
            for g, parts in kept.items():
                numbers, step = b"".join(parts), 8 * tables[g].shape[1] * BLOCK_POINTS
                blocks = [numbers[at : at + step] for at in range(0, len(numbers), step)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(blocks), pa.string()), pa.array(blocks, pa.binary())], names=["group", "block"])

    return packed.filter(F.col("group").isin(list(tables))).mapInArrow(run, "group string, block binary")


def _means(sums: np.ndarray, centres: Centres) -> Centres:
    """Means of the points of each centre; a centre without points stays."""
    return [(row[:-1] / row[-1]).tolist() if row[-1] else list(c) for row, c in zip(sums, centres)]


def _farthest(old: Centres, new: Centres) -> float:
    """How far the centre moved that moved most."""
    return max(float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(old, new))


def grouped_kmeans(
    points: DataFrame, centres: Mapping[str, Centres], max_iterations: int = MAX_ITERATIONS, tolerance: float | None = None
) -> dict[str, Centres]:
    """k-means of several groups of points side by side, each from given first centres, to convergence.

    ``points`` is a stored table (group, components); a group's centres have the
    length of its points. A centre without points stays where it is. A group
    ends when its centres move less than ``tolerance`` (by default a small part
    of the mean variance of its points); warns if that does not happen within
    ``max_iterations`` rounds.

    The points are stored once more as bytes. Once centres move little, the
    points near a border between two centres are stored apart, and the sums of
    the others are kept: while no centre has moved farther than half the margin
    since, none of them can change its centre, and a round reads the points near
    borders alone.
    """
    now = {g: [list(c) for c in own] for g, own in centres.items()}
    limits = _tolerances(points, {g: len(c[0]) for g, c in now.items()}) if tolerance is None else dict.fromkeys(now, tolerance)
    moving, shift, step = set(now), {}, {}
    packed = materialise(_packed(points, {g: len(c[0]) for g, c in now.items()}), "kmeans-packed")
    near, kept, since, margins = None, {}, {}, {}
    for turn in range(max_iterations):
        old = {g: now[g] for g in sorted(moving)}
        if near is not None and any(2 * _farthest(since[g], old[g]) > margins[g] - TIE_MARGIN for g in old):
            discard(near)
            near = None
        if near is None and turn >= SETTLE_ROUNDS:
            since, margins = old, {g: 2 * SETTLE_STEPS * step[g] + TIE_MARGIN for g in old}
            near = materialise(_near_borders(packed, since, margins), "kmeans-near")
            kept = _cluster_sums(packed, since, margins)
        sums = _cluster_sums(packed if near is None else near, old)
        for g in old:
            now[g] = _means(sums[g] if near is None else sums[g] + kept[g], old[g])
            shift[g], step[g] = _shift(old[g], now[g]), _farthest(old[g], now[g])
        moving = {g for g in moving if shift[g] > limits[g]}
        if not moving:
            break
    discard(packed, *([] if near is None else [near]))
    for g in sorted(moving):
        warnings.warn(f"k-means still moves after {max_iterations} rounds (by {shift[g]:g}, tolerance {limits[g]:g})", stacklevel=2)
    return now


def seeded_kmeans(
    points: DataFrame,
    centres: Centres,
    point: str = "components",
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float | None = None,
) -> Centres:
    """``grouped_kmeans`` of one group, whose points are stored first."""
    stored = materialise(points.select(F.lit("all").alias("group"), F.col(point).alias("components")), "kmeans-points")
    found = grouped_kmeans(stored, {"all": centres}, max_iterations, tolerance)["all"]
    discard(stored)
    return found


# Rounds and draws per centre and round of the random start; distances are compared as whole parts of 1e-9.
START_ROUNDS, OVERSAMPLE = 5, 2
PARTS = 1_000_000_000


def _draw(seed: int, tag: str, key: str) -> Column:
    """A number from 0 to 1 that depends on the row's id alone, not on where the row lies."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _weighted_pick(weights: Sequence[int], share: float) -> int:
    """The first place where the running weight is above ``share`` of all."""
    total, running = float(sum(weights)), 0
    for j, w in enumerate(weights):
        running += w
        if float(running) > share * total:
            return j
    return len(weights) - 1


def random_centres(points: DataFrame, k: int, seed: int = 42, key: str = "playerId", point: str = "components") -> Centres:
    """First centres by k-means||: ``k`` of some OVERSAMPLE * k * START_ROUNDS drawn points.

    In each round a point is drawn with a chance in proportion to its squared
    distance from the points drawn before; the drawn points then weigh as many
    points as they are nearest to, and k of them are picked one after another
    with a chance in proportion to weight and squared distance. Every draw
    depends on the seed and the row's id, so the same rows give the same centres
    however they are partitioned. Fewer than ``k`` distinct points give fewer
    centres.
    """
    stored = materialise(points.select(F.col(key).alias("_id"), F.col(point).alias("components")), "kmeans-start")
    drawn: Centres = [list(r["components"]) for r in stored.orderBy(_draw(seed, "first", "_id"), "_id").limit(1).collect()]
    if not drawn:
        raise ValueError("no points to start from")
    for turn in range(1, START_ROUNDS + 1):
        away = stored.withColumn("_near", nearest(F.col("components"), drawn)).withColumn("_far", F.round(F.col("_near.d") * PARTS).cast("long"))
        total = away.agg(F.sum(F.col("_far").cast("decimal(38,0)")).cast("double")).first()[0]
        chosen = away.filter(_draw(seed, str(turn), "_id") * F.lit(total) < F.col("_far").cast("double") * F.lit(float(OVERSAMPLE * k)))
        drawn += [list(r["components"]) for r in chosen.orderBy("_id").select("components").collect()]  # OVERSAMPLE * k on average
    counts = stored.select(nearest(F.col("components"), drawn).alias("_near")).groupBy("_near.i").agg(F.count("*").alias("n"))
    weights = [0] * len(drawn)
    for r in counts.collect():
        weights[r["i"]] = r["n"]
    discard(stored)
    table, picked, mass = np.array(drawn, dtype=float), [], list(weights)
    far: np.ndarray | None = None
    while len(picked) < k and sum(mass):
        share = int(hashlib.md5(f"{seed}:pick{len(picked)}".encode()).hexdigest()[:13], 16) / (1 << 52)
        picked.append(_weighted_pick(mass, share))
        own = np.round(((table - table[picked[-1]]) ** 2).sum(axis=1) * PARTS)
        far = own if far is None else np.minimum(far, own)
        mass = [w * int(d) for w, d in zip(weights, far)]
    return [drawn[j] for j in picked]


def random_kmeans(
    points: DataFrame, k: int, seed: int = 42, key: str = "playerId", point: str = "components", tolerance: float | None = None
) -> DataFrame:
    """``points`` with ``cluster`` and squared distance ``cost`` by k-means from a seeded random start."""
    centres = seeded_kmeans(points, random_centres(points, k, seed, key, point), point, tolerance=tolerance)
    near = nearest(F.col(point), centres)
    return points.withColumn("_near", near).withColumns({"cluster": F.col("_near.i"), "cost": F.col("_near.d")}).drop("_near")


@dataclass
class RoleModel:
    """A fitted role: projection, cluster centres, one label per centre.

    The projection may begin with stages that fill gaps and keep top cells (see
    ``scaling``); the model then takes feature rows as they are.
    """

    role: str
    projection: PipelineModel
    centres: Centres
    labels: list[str]

    def prepared_by(self, stages: Sequence) -> RoleModel:
        """The same model with fitted stages in front of its projection."""
        return RoleModel(self.role, PipelineModel(stages=[*stages, *self.projection.stages]), self.centres, self.labels)

    def components(self, rows: DataFrame) -> DataFrame:
        return transform_components(self.projection, rows)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``cluster``, ``label`` and squared distance ``cost``."""
        near = nearest(F.col("components"), self.centres)
        return (
            self.components(rows)
            .withColumn("_near", near)
            .drop("components")
            .withColumns(
                {
                    "cluster": F.col("_near.i"),
                    "cost": F.col("_near.d"),
                    "label": pick_label(F.col("_near.i"), self.labels),
                }
            )
            .drop("_near")
        )

    def cost(self, rows: DataFrame) -> DataFrame:
        """Within-cluster sum of squares of the rows under this model."""
        return self.predict(rows).agg(F.lit(self.role).alias("role"), F.sum("cost").alias("cost"))

    def save(self, path: str, spark: SparkSession, overwrite: bool = False) -> None:
        writer = self.projection.write()
        (writer.overwrite() if overwrite else writer).save(f"{path}/projection")
        about = [(self.role, i, c, lab) for i, (c, lab) in enumerate(zip(self.centres, self.labels))]
        spark.createDataFrame(about, "role string, cluster int, centre array<double>, label string").coalesce(
            1
        ).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/centres")

    @staticmethod
    def load(path: str, spark: SparkSession) -> RoleModel:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()  # one row per cluster
        return RoleModel(
            rows[0]["role"],
            PipelineModel.load(f"{path}/projection"),
            [list(r["centre"]) for r in rows],
            [r["label"] for r in rows],
        )


def scaled_columns(role: str) -> list[str]:
    return fixed.SCALED_DF if role == "DF" else fixed.SCALED_FW_MD


def _projection(rows: DataFrame, role: str, k: int, columns: Sequence[str]) -> PipelineModel:
    *before, last = principal_components(columns, k, scaled_columns(role)).getStages()
    prepared = Pipeline(stages=before).fit(rows)
    with _DECOMPOSITION:
        return PipelineModel(stages=[*prepared.stages, last.fit(prepared.transform(rows))])


def train_models(
    rows: Mapping[str, DataFrame],
    examples: Mapping[str, DataFrame],
    labels: Mapping[str, Sequence[str]],
    components: Mapping[str, int],
    columns: Sequence[str] = tuple(fixed.FEATURES),
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float | None = None,
) -> dict[str, RoleModel]:
    """Fit the models of all roles from the prepared rows of each, starting from its known players.

    Projections are fitted side by side. The points of all roles are then stored
    in one table, from which one pass takes all first centres and every round of
    k-means serves all roles together.
    """
    spark = next(iter(rows.values())).sparkSession

    def project(role: str) -> PipelineModel:
        return _projection(rows[role].select("playerId", *columns), role, components[role], columns)

    with ThreadPool(len(rows)) as pool:
        projections = dict(zip(rows, pool.map(inheritable_thread_target(spark)(project), list(rows))))
    parts = [
        transform_components(projections[role], own.select("playerId", *columns)).select(F.lit(role).alias("group"), "playerId", "components")
        for role, own in rows.items()
    ]
    points = materialise(reduce(DataFrame.unionByName, parts), "role-points")
    known = reduce(DataFrame.unionByName, [examples[role].select(F.lit(role).alias("group"), "playerId", "seed_group") for role in rows])
    means = group_means(points.join(known, ["group", "playerId"]), ["group", "seed_group"], max(components[r] for r in rows))
    found = {(r["group"], r["seed_group"]): r["centre"] for r in means.collect()}  # one vector per label
    first = {}
    for role in rows:
        if missing := [g for g in range(len(labels[role])) if (role, g) not in found]:
            raise ValueError(f"no rows for example groups {missing} of {role}")
        first[role] = [list(found[role, g][: components[role]]) for g in range(len(labels[role]))]
    centres = grouped_kmeans(points, first, max_iterations, tolerance)
    discard(points)
    return {role: RoleModel(role, projections[role], centres[role], list(labels[role])) for role in rows}


def train_role(
    table: DataFrame,
    role: str,
    examples: DataFrame,
    labels: Sequence[str] | None = None,
    k: int | None = None,
    columns: Sequence[str] = tuple(fixed.FEATURES),
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float | None = None,
) -> RoleModel:
    """Fit one role on the prepared table, starting from its known players."""
    return train_models(
        {role: table.filter(F.col("role") == role)}, {role: examples}, {role: labels or fixed.ROLE_CODES[role]},
        {role: k or fixed.ROLE_COMPONENTS[role]}, columns, max_iterations, tolerance,
    )[role]


def role_costs(models: Mapping[str, RoleModel], rows: DataFrame) -> DataFrame:
    """Cost of the rows under each model, one row per role."""
    costs = None
    for model in models.values():
        part = model.cost(rows)
        costs = part if costs is None else costs.unionByName(part)
    return costs


def best_role(models: Mapping[str, RoleModel], rows: DataFrame) -> str | None:
    """The role whose model fits the rows with the least squared distance.

    ``None`` when there are no rows.
    """
    return role_costs(models, rows).agg(F.min_by("role", "cost")).first()[0]


def label_roles(models: Mapping[str, RoleModel], table: DataFrame) -> DataFrame:
    """(playerId, matchId, role, label) for every row that a model covers.

    Rows without a classic role are all labelled by the model that fits them
    best together.
    """
    kept = ["playerId", "matchId", "role", "label"]
    labelled = None
    for role, model in models.items():
        part = model.predict(table.filter(F.col("role") == role)).select(*kept)
        labelled = part if labelled is None else labelled.unionByName(part)
    unknown = table.filter(F.col("role").isNull())
    chosen = best_role(models, unknown)
    if chosen is not None:
        labelled = labelled.unionByName(models[chosen].predict(unknown).select(*kept))
    return labelled


def seed_check(labelled: DataFrame, examples: DataFrame, names: DataFrame) -> DataFrame:
    """Labels that the rows of each known player received, with the name."""
    counts = labelled.groupBy("playerId", "label").agg(F.count("*").alias("n"))
    return counts.join(examples.select("playerId"), "playerId", "left_semi").join(names, "playerId", "left")
