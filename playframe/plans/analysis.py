"""Analysis jobs on the produced tables: map components, clustering of phases,
formation similarity and prediction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from playframe.functions import taxonomy
from playframe.functions.nulls import ratio
from playframe.ml import clusters, linear, prepare, regress
from playframe.operators import grids
from playframe.operators.ordered import ordered
from playframe.plans import maps, similarity
from playframe.plans.merge import merge_phase_features, numeric_columns
from playframe.session import materialize

PHASE = maps.PHASE_KEYS
INFO = ["sequence_id", "team", "period", "frame_count"]


def grid_shape(cells: DataFrame) -> tuple[int, int]:
    """Rows and columns of the grid the cells were made on."""
    r = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return int(r.r) + 1, int(r.c) + 1


def grid_extents(cells: DataFrame) -> DataFrame:
    """Grid extent per match; more than one distinct extent means that cells of
    different matches do not lie at the same place."""
    return cells.groupBy("match_id").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def phase_vectors(recurrence: DataFrame, features: str = "poss_opp", transform: str = "sqrt", orient: str = "auto",
                  min_frames: int = 0, length: float = 105.0, shape: tuple[int, int] | None = None) -> tuple[DataFrame, tuple[int, int], list[str]]:
    """One vector of map cells per phase, with both sides present.

    ``features`` is poss_opp (in and out of possession), home_away or combined.
    """
    n_rows, n_cols = shape or grid_shape(recurrence)
    sums = recurrence.groupBy(*PHASE).agg(
        *[F.first(c).alias(c) for c in INFO],
        *[F.sum(F.when(F.col("side") == s, F.col("recurrence_frac")).otherwise(0.0)).alias(f"__{s}") for s in ("home", "away")])
    kept = sums.filter((F.col("__home") > 0.5) & (F.col("__away") > 0.5) & (F.col("frame_count") >= min_frames)).drop("__home", "__away")
    cells = recurrence.join(kept.select(*PHASE), PHASE, "left_semi")
    if orient == "auto":
        cells = maps.attack_oriented(cells, "recurrence_frac", n_rows, n_cols, length)
        direction = cells.groupBy(*PHASE).agg(F.first("attack_dir").alias("attack_dir_original"))
        kept = kept.join(direction, PHASE)
    else:
        cells = cells.withColumn("block", F.when(F.col("team") == F.col("side"), "in").otherwise("out"))
    blocks = {"poss_opp": ("block", ["in", "out"]), "home_away": ("side", ["home", "away"]), "combined": (None, ["both"])}
    by, names = blocks[features]
    value = F.col("recurrence_frac") * (0.5 if by is None else 1.0)
    tagged = cells.select(*PHASE, (F.col(by) if by else F.lit("both")).alias("__b"), "row", "col", value.alias("v"))
    dense = grids.densify(tagged, PHASE + ["__b"], "v", n_rows, n_cols)
    parts = [F.first(F.when(F.col("__b") == n, F.col("cells")), ignorenulls=True).alias(f"__{n}") for n in names]
    wide = dense.groupBy(*PHASE).agg(*parts)
    vector = F.concat(*[F.col(f"__{n}") for n in names])
    vector = F.transform(vector, lambda v: F.sqrt(v)) if transform == "sqrt" else vector
    return kept.join(wide.select(*PHASE, vector.alias("cells")), PHASE), (n_rows, n_cols), names


@dataclass
class MapComponents:
    scores: DataFrame
    loadings: DataFrame
    variance: DataFrame
    model: linear.Components
    shape: tuple[int, int]


def map_components(recurrence: DataFrame, n_components: int = 20, share: float | None = None, **options) -> MapComponents:
    """Principal components of occupancy maps: scores per phase, loadings per
    block and cell, explained variance up to a ``share`` of all. Unless told,
    that is all for maps that few passes span, 0.95 for wider ones."""
    vectors, (n_rows, n_cols), blocks = phase_vectors(recurrence, **options)
    vectors = vectors.persist()
    if share is None:
        share = 1.0 if n_rows * n_cols * len(blocks) <= 4 * linear.BLOCK else 0.95
    fitted = linear.fit_components(vectors, "cells", n_components, share)
    kept = fitted.keep(min(n_components, len(fitted.ratio)))
    scored = kept.scores(vectors, "cells", "__s").drop("cells")
    scores = scored.select(*[c for c in scored.columns if c != "__s"], *[F.get("__s", F.lit(i)).alias(f"PC{i + 1}") for i in range(len(kept.loadings))])
    spark, size = recurrence.sparkSession, n_rows * n_cols
    rows = [(b, i // n_cols, i % n_cols, *[float(v) for v in kept.loadings[:, k * size + i]]) for k, b in enumerate(blocks) for i in range(size)]
    loadings = spark.createDataFrame(rows, "block string, row int, col int, " + ", ".join(f"PC{i + 1} double" for i in range(len(kept.loadings))))
    return MapComponents(scores, loadings, fitted.table(recurrence), kept, (n_rows, n_cols))


def ball_features(paths: DataFrame, phases: DataFrame, directions: DataFrame, length: float, width: float) -> DataFrame:
    """Scalar features of the ball path, turned so that the side in possession
    attacks right. ``directions`` has ``attack_dir`` per phase."""
    j = paths.join(directions, PHASE, "left").join(phases.select(*PHASE, "duration"), PHASE, "left")
    flip = F.col("attack_dir") == -1

    def along(c: Column, extent: float) -> Column:
        return F.when(flip, extent - c).otherwise(c)

    x0, x1 = along(F.col("start_x"), length), along(F.col("end_x"), length)
    y0, y1 = along(F.col("start_y"), width), along(F.col("end_y"), width)
    top = F.when(flip, length - F.array_min("path_x")).otherwise(F.array_max("path_x"))
    return j.select(
        *PHASE, x0.alias("ball_start_x"), x1.alias("ball_end_x"), (x1 - x0).alias("ball_dx"), top.alias("ball_max_x"),
        F.abs(y1 - y0).alias("ball_lat_shift"), F.col("path_length_m").alias("ball_path_length"),
        F.col("straightness").alias("ball_straightness"), ratio("path_length_m", "duration").alias("ball_speed_mps"))


@dataclass
class ClusterSettings:
    ks: tuple[int, ...] = tuple(range(2, 16))
    final_ks: tuple[int, ...] = (2, 4, 6)
    alpha: float = 0.5
    keep_variance: float = 0.9
    holdout: tuple[str, ...] = taxonomy.HOLDOUT_GROUPS + ("positional_pca",)
    n_init: int = 10
    repeats: int = 5
    sample: int = 5000
    territory_anchor: str | None = None
    ball_share: float = 0.0
    ball_grid_share: float = 0.5


@dataclass
class ClusterResult:
    rows: DataFrame
    sweep: DataFrame
    shares: dict[str, float]
    retained: dict[str, float]
    columns: list[str]
    scaling: prepare.Scaling

    def importance(self, k: int) -> DataFrame:
        """Eta squared of every feature, held-out ones included."""
        full = prepare.scaled_vector(self.rows.drop("features"), self.scaling, self.columns, out="all_features")
        e = clusters.eta_squared(full, f"cluster_k{k}", "all_features", self.scaling.names)
        return e.withColumn("group", F.get(F.lit(self.scaling.groups), F.col("i"))).drop("i")

    def group_importance(self, k: int) -> DataFrame:
        return self.importance(k).groupBy("group").agg(F.avg("eta_squared").alias("eta_squared")).orderBy(F.desc("eta_squared"), "group")

    def profile(self, k: int, columns: list[str] | None = None) -> DataFrame:
        wanted = [c for c in (columns or taxonomy.PROFILE_COLUMNS) if c in self.rows.columns]
        return clusters.profile(self.rows, f"cluster_k{k}", wanted)


def cluster_phases(phases: DataFrame, movement: DataFrame, windows: DataFrame, scores: DataFrame | None, cfg: ClusterSettings,
                   recurrence_maps: DataFrame | None = None, control_maps: DataFrame | None = None,
                   ball: DataFrame | None = None, ball_grid: DataFrame | None = None) -> ClusterResult:
    """Merge features, scale and weight them by group, reduce all but the
    pass-through groups, and cluster for every k.

    Map inputs have one dense array per phase in ``rec`` and ``pcmap``, ball
    inputs scalar columns and one array ``ball_pcs``.
    """
    merged = merge_phase_features(phases, movement, windows, scores)
    candidates = taxonomy.clusterable(numeric_columns(merged))
    columns = prepare.usable_columns(merged, candidates)
    blocks: dict[str, str] = {}
    for extra, name, group in ((recurrence_maps, "rec", "recurrence_map"), (control_maps, "pcmap", "pitch_control_map")):
        if extra is not None:
            merged = prepare.impute_maps(merged.join(extra.select(*PHASE, name), PHASE, "left"), name)
            blocks[name] = group
    data = prepare.impute_medians(merged, columns).persist()
    scaling = prepare.fit_scaling(data, columns, blocks)
    weight = scaling.group_weights(cfg.alpha, set(cfg.holdout))
    shares = scaling.shares(weight)
    used = {g for g in scaling.groups if g not in cfg.holdout}
    through = used & set(taxonomy.PASS_THROUGH_GROUPS)
    other = used - through
    retained = {g: 1.0 for g in through}
    parts: list[str] = []
    at = np.array([g in other for g in scaling.groups]) & (weight > 0)
    if at.any():
        data = prepare.scaled_vector(data, scaling, columns, weight, other, "__other")
        names = [n for n, a in zip(scaling.names, at) if a]
        if cfg.territory_anchor in names:
            data = prepare.residual_on(data, "__other", [names.index(cfg.territory_anchor)], "__other")
        kept = linear.fit_components(data, "__other", share=cfg.keep_variance)
        data = kept.scores(data, "__other", "__reduced").drop("__other")
        total = kept.spread
        held = (kept.variance[:, None] * kept.loadings ** 2).sum(axis=0)
        group_of = np.array([g for g, a in zip(scaling.groups, at) if a])
        retained.update({g: float(held[group_of == g].sum() / total[group_of == g].sum()) for g in sorted(set(group_of))})
        parts.append("__reduced")
    if through and any(w > 0 and g in through for w, g in zip(weight, scaling.groups)):
        data = prepare.scaled_vector(data, scaling, columns, weight, through, "__through")
        parts.append("__through")
    if ball is not None and cfg.ball_share > 0:
        base = float((scaling.variance * weight ** 2).sum())
        data, names = _with_ball(data, ball, ball_grid, base, cfg)
        parts += names
    data = data.withColumn("features", F.concat(*parts)).drop(*parts)
    rows, table = clusters.sweep(data, list(cfg.ks), "features", PHASE, cfg.n_init, cfg.sample, cfg.repeats)
    return ClusterResult(rows, table, shares, retained, columns, scaling)


def _with_ball(data: DataFrame, ball: DataFrame, ball_grid: DataFrame | None, base: float, cfg: ClusterSettings) -> tuple[DataFrame, list[str]]:
    """Ball path and ball grid blocks, each brought to its share of the
    variance next to the base features."""
    names = [c for c in taxonomy.BALL_PROFILE_COLUMNS if c in ball.columns]
    data = prepare.impute_medians(data.join(ball.select(*PHASE, *names), PHASE, "left"), names)
    s = prepare.fit_scaling(data, names)
    path_share = cfg.ball_share * (1 - cfg.ball_grid_share) if ball_grid is not None else cfg.ball_share
    f = prepare.block_to_share(base, float(len(names)), path_share, 1 - cfg.ball_share)
    data = prepare.scaled_vector(data, s, names, np.full(len(names), f), None, "__ball")
    if ball_grid is None:
        return data, ["__ball"]
    width = len(ball_grid.select("ball_pcs").first()[0])
    data = data.join(ball_grid.select(*PHASE, "ball_pcs"), PHASE, "left").withColumn("ball_pcs", F.coalesce("ball_pcs", F.array_repeat(F.lit(0.0), width)))
    _, variance = prepare.array_moments(data, "ball_pcs")
    g = prepare.block_to_share(base, float(variance.sum()), cfg.ball_share * cfg.ball_grid_share, 1 - cfg.ball_share)
    return data.withColumn("__ballgrid", F.transform("ball_pcs", lambda v: v * F.lit(g))), ["__ball", "__ballgrid"]


def ball_grid_components(ball_cells: DataFrame, directions: DataFrame, n_components: int = 8) -> DataFrame:
    """Principal scores of the oriented ball maps per phase."""
    n_rows, n_cols = grid_shape(ball_cells)
    j = ball_cells.join(directions, PHASE, "left")
    turned = grids.rotate(j, F.coalesce(F.col("attack_dir") == -1, F.lit(False)), n_rows, n_cols)
    dense = grids.densify(turned, PHASE, "recurrence_frac", n_rows, n_cols).withColumn("cells", F.transform("cells", lambda v: F.sqrt(v)))
    return linear.fit_components(dense, "cells", n_components).scores(dense, "cells", "ball_pcs").drop("cells")


def compare_clusterings(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """Agreement of two sets of cluster columns, for every k."""
    out = None
    for k in ks:
        j = a.select(*PHASE, F.col(f"cluster_k{k}").alias("__a")).join(b.select(*PHASE, F.col(f"cluster_k{k}").alias("__b")), PHASE)
        row = clusters.contingency_ari(j, "__a", "__b").select(F.lit(k).alias("k"), "ari")
        out = row if out is None else out.unionByName(row)
    return out


def cluster_maps(vectors: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Mean map per cluster, one row per cluster and cell."""
    j = vectors.select(*PHASE, "cells").join(labels.select(*PHASE, label), PHASE)
    return j.select(label, F.posexplode("cells").alias("cell", "v")).groupBy(label, "cell").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n_phases"))


def restored_cluster_maps(scores: DataFrame, label: str, model: linear.Components) -> DataFrame:
    """Map of every cluster from its mean scores; negative cells are cut off
    and the square root transform is undone."""
    pcs = [c for c in scores.columns if c.startswith("PC") and c[2:].isdigit()]
    pcs = sorted(pcs, key=lambda c: int(c[2:]))[:len(model.loadings)]
    mean = scores.filter(" AND ".join(f"{c} IS NOT NULL" for c in pcs)).groupBy(label).agg(
        F.array(*[F.avg(c) for c in pcs]).alias("__s"), F.count(F.lit(1)).alias("n_phases"))
    back = model.restore(mean, "__s", "cells")
    return back.select(label, "n_phases", F.transform("cells", lambda v: F.greatest(v, F.lit(0.0)) * F.greatest(v, F.lit(0.0))).alias("cells"))


@dataclass
class FormationMaps:
    sums: DataFrame
    in_possession: DataFrame
    out_of_possession: DataFrame
    combined: DataFrame
    subsampling: DataFrame


def formation_maps(phases: DataFrame, recurrence: DataFrame, labels: list[str], by: str = "dominant_formation", n_rows: int = 68,
                   n_cols: int = 105, length: float = 105.0, min_phases: int = 20, pairs=similarity.SUBSAMPLE_PAIRS) -> FormationMaps:
    """Maps per formation on a common grid, their similarity and the
    subsampling test. ``labels`` is the template vocabulary."""
    cells = similarity.common_grid_cells(recurrence, n_rows, n_cols, length)
    have = recurrence.select(*PHASE).distinct()
    tagged = have.join(phases.select(*PHASE, F.col(by).alias("label")), PHASE, "left")
    sums = similarity.label_sums(cells, tagged, PHASE, "recurrence_frac", min_phases)

    def sim(block: str) -> DataFrame:
        return similarity.formation_similarity(sums, labels, n_rows, n_cols, block).filter(F.col("corr").isNotNull())

    sub = similarity.subsample_roughness(cells.drop("label"), tagged, PHASE, "recurrence_frac", pairs, n_rows, n_cols)
    return FormationMaps(sums, sim("in"), sim("out"), sim("combined"), sub)


def prediction(phases: DataFrame, cfg: regress.Boosting | None = None, n_components: int = 60, map_size: int = 3375,
               targets=taxonomy.SCALAR_TARGETS, skip_maps: bool = False) -> dict[str, DataFrame]:
    """Predict control maps and scalar targets from three feature sets, with
    whole matches held out."""
    cfg = cfg or regress.Boosting()
    df, onehot = phases, []
    for c in taxonomy.FORMATION_CATEGORIES:
        if c in df.columns:
            df, names = prepare.one_hot(df, c)
            onehot += names
    available = tuple(f.name for f in df.schema.fields)
    flags = [f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean"]
    sets = taxonomy.FeatureSets(tuple(numeric_columns(df) + flags), available, tuple(onehot)).build()
    used = sorted({c for cols in sets.values() for c in cols})
    filled = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in used})  # missing features stay missing
    for name, cols in sets.items():
        filled = filled.withColumn(f"__{name}", F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
    # a feature list is a target as well; targets keep their nulls
    filled = filled.withColumns({f"__t_{t}": df[t].cast("double") for t in targets if t in df.columns})
    vectors = {name: f"__{name}" for name in sets}
    keep = ["match_id", *vectors.values(), *[f"__t_{t}" for t in targets if t in df.columns]]
    if "pc_map" in df.columns and not skip_maps:
        filled = regress.filled_maps(filled, "pc_map", map_size)
        keep.append("pc_map")
    train, test = regress.group_split(filled.select(*keep), "match_id", 0.2, cfg.seed)
    train, test = train.persist(), test.persist()
    out = {"scalars": regress.predict_scalars(train, test, [f"__t_{t}" for t in targets if t in df.columns], vectors, cfg)
           .withColumn("target", F.regexp_replace("target", "^__t_", ""))}
    if "pc_map" in keep:
        rows = regress.map_scores(regress.mean_map_baseline(train, test, "pc_map"), "pc_map", "predicted").withColumns({"model": F.lit("mean map"), "cat": F.lit("baseline")})
        parts = None
        for kind, settings in regress.model_kinds(cfg).items():
            for name, v in vectors.items():
                guess = materialize(regress.predict_map(train, test, v, "pc_map", n_components, settings).select("pc_map", *[f"predicted{x}" for x in ("", "_scores", "_truth")]))
                tags = {"model": F.lit(kind), "cat": F.lit(name)}
                rows = rows.unionByName(regress.map_scores(guess, "pc_map", "predicted").withColumns(tags))
                one = regress.component_scores(guess).withColumns(tags)
                parts = one if parts is None else parts.unionByName(one)
        out["components"] = parts
        out["maps"] = rows
    return out


def phase_timeline(paths: DataFrame, match_id, team: str | None = None, step: int = 1, max_phases: int | None = None) -> DataFrame:
    """Phases of a match in playing order, every ``step``-th of them, at most
    ``max_phases``; the table behind an animation."""
    one = paths.filter(F.col("match_id").cast("string") == str(match_id))
    one = one.filter(F.col("team") == team) if team else one
    number = F.element_at(F.split("window_id", "_"), -1).cast("bigint")
    unique = one.dropDuplicates(PHASE).withColumn("number", number)
    placed = ordered(unique, ["match_id"], ["period", "number"], 1.0, index="position")
    kept = placed.filter(F.col("position") % step == 0)
    return kept.filter(F.col("position") < step * max_phases) if max_phases else kept


def movement_histogram(scores: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts behind a histogram; values at the upper edge fall in the last
    bin."""
    v = F.col(column)
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return scores.filter(v.between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def longest(phases: DataFrame, n: int = 5) -> DataFrame:
    return phases.orderBy(F.desc("duration"), *PHASE).limit(n)


def numbered_components(variance: DataFrame, target: float) -> DataFrame:
    """First component at which the cumulative share reaches a target; one row
    per component goes in."""
    cum = F.sum("ratio").over(Window.orderBy("pc"))
    return variance.withColumn("cum", cum).filter(F.col("cum") >= target).agg(F.min("pc").alias("components"))
