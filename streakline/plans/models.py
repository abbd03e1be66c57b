"""Points-per-game projection with Spark ML gradient-boosted trees.

The trees are not those of another library, so scores are judged by metrics,
not by value. Category codes come from the training rows alone. A model is trained
once, stored with its metadata and loaded by whatever scores with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakline.functions import lookups as K
from streakline.functions import scalars as S
from streakline.operators import reports
from streakline.operators.distributions import correlation, error_metrics, residual_summary
from streakline.operators.features import categorical_columns, feature_columns, feature_matrices
from streakline.session import ensure_checkpoint_dir

LABEL = "pts_per_game"
VALIDATION = "is_validation"
ROUNDS = 100
METADATA = (
    "mae double, rmse double, r2 double, corr double, max_error double, n long, n_train long, n_val long,"
    " best_iteration int, model_version string, feature_columns array<string>,"
    " categorical_columns array<string>, trained_at timestamp"
)


def split_seasons(
    logs: DataFrame, players: DataFrame, train_seasons: Sequence[str], val_season: str, **options
) -> DataFrame:
    """Feature rows of the training seasons and of the validation season, flagged."""
    rows = feature_matrices(logs, players, [*train_seasons, val_season], **options)
    return rows.withColumn(VALIDATION, F.col("season") == val_season)


def training_counts(rows: DataFrame) -> DataFrame:
    """Number of training and of validation rows."""
    return rows.agg(F.count_if(~F.col(VALIDATION)).alias("n_train"), F.count_if(VALIDATION).alias("n_val"))


def fill_missing(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    return matrix.fillna(K.MISSING_FEATURE, subset=list(columns))


def category_codes(rows: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Code of every category, alphabetical from 0, as the training rows alone tell it."""
    named = rows.where(~F.col(VALIDATION)).select(*[F.col(c).cast("string").alias(c) for c in categorical])
    seen = named.unpivot([], list(categorical), "feature", "category").where("category is not null").distinct()
    alphabetical = Window.partitionBy("feature").orderBy("category")
    return seen.withColumn("code", (F.row_number().over(alphabetical) - 1).cast("int"))


def fit_encoder(rows: DataFrame, categorical: Sequence[str]) -> list[StringIndexerModel]:
    """Encoders with the codes of :func:`category_codes`; other and missing categories share one code more.

    The labels of a category column are model data and pass through the driver.
    """
    labels: dict[str, list[str]] = {c: [] for c in categorical}
    for row in category_codes(rows, categorical).orderBy("feature", "code").collect():
        labels[row.feature].append(row.category)
    return [
        StringIndexerModel.from_labels(labels[c], inputCol=c, outputCol=f"{c}_code", handleInvalid="keep")
        for c in categorical
    ]


def train(
    rows: DataFrame,
    features: Sequence[str],
    categorical: Sequence[str] = (),
    max_iter: int = ROUNDS,
    step_size: float = 0.05,
    max_depth: int = 5,
    seed: int = 42,
) -> PipelineModel:
    """Encoders of the training rows, assembler and trees; the validation rows stop the boosting early.

    Encoded columns carry their categories along, so the trees split them as sets and not as numbers.
    """
    encoders = fit_encoder(rows, categorical)
    assembler = VectorAssembler(
        inputCols=[*features, *[e.getOutputCol() for e in encoders]], outputCol="features"
    )
    trees = GBTRegressor(
        labelCol=LABEL,
        predictionCol="prediction",
        maxIter=max_iter,
        stepSize=step_size,
        maxDepth=max_depth,
        maxBins=max([32, *[len(e.labels) + 1 for e in encoders]]),
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=seed,
        validationIndicatorCol=VALIDATION,
    )
    prepared = PipelineModel([*encoders, assembler]).transform(fill_missing(rows, features))
    return PipelineModel([*encoders, assembler, trees.fit(prepared)])


def score(model: PipelineModel, matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    drop = ["features"] + [c for c in model_codes(model)]
    return model.transform(fill_missing(matrix, features)).drop(*drop)


def recent_form(matrix: DataFrame) -> DataFrame:
    """The naive forecast every model has to beat: the rate of the last games, else of the last season, else 0."""
    known = F.coalesce("momentum_pts_per_game", "prior_points_per_game", F.lit(0.0))
    return matrix.withColumn("prediction", known)


def relevance(rows: DataFrame, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Features by their squared correlation with the label over the training rows, with the share in percent.

    Unlike the importance of a fitted model it needs no fit; features that do not vary count 0.
    """
    filled = fill_missing(rows.where(~F.col(VALIDATION)), features)
    squared = [F.pow(correlation(F.col(f).cast("double"), F.col(LABEL)), 2) for f in features]
    wide = filled.agg(*[F.coalesce(c, F.lit(0.0)).alias(f) for f, c in zip(features, squared)])
    total = reduce(Column.__add__, [F.col(f) for f in features])
    shares = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("r2"), total.alias("total")) for f in features]
    found = wide.select(F.inline(F.array(*shares))).select(
        "feature",
        S.rounded("r2", 6).alias("importance"),
        S.rounded(S.ratio("r2", "total") * 100, 4).alias("importance_pct"),
    )
    ordered = found.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


def model_codes(model: PipelineModel) -> list[str]:
    return [s.getOutputCol() for s in model.stages[:-2]]


def importance(model: PipelineModel, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Feature importance with its share in percent, largest first.

    One number per model input: driver-side model metadata.
    """
    names = model.stages[-2].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(n, float(v), float(v) / total * 100) for n, v in zip(names, values)]
    ordered = spark.createDataFrame(rows, "feature string, importance double, importance_pct double").orderBy(
        F.desc("importance"), "feature"
    )
    return ordered if top is None else ordered.limit(top)


def project(
    scored: DataFrame,
    players: DataFrame,
    team_seasons: DataFrame,
    version: str = "unversioned",
    mae: float | None = None,
) -> DataFrame:
    """Projected points per game from ``prediction``, clipped to 0..2, with names and current team.

    Names and teams have a row for each player, so they are merged and never broadcast.
    """
    clipped = scored.select(
        "player_id", "position", S.clip("prediction", 0.0, 2.0).alias("projected_pts_per_game")
    )
    names = players.select("player_id", S.full_name("first_name", "last_name").alias("player_name"))
    teams = reports.current_team(team_seasons).select("player_id", F.col("current_team").alias("team"))
    return (
        clipped.join(names.hint("merge"), "player_id", "left")
        .join(teams.hint("merge"), "player_id", "left")
        .withColumn("projected_total_pts_82", F.col("projected_pts_per_game") * K.SEASON_GAMES)
        .withColumns({"model_version": F.lit(version), "model_mae": F.lit(mae).cast("double")})
    )


def projection_leaderboard(projections: DataFrame, n: int = 30, group: str = "ALL") -> DataFrame:
    chosen = projections if group == "ALL" else projections.where(S.position_group("position") == group)
    columns = ("player_name", "team", "position", "projected_pts_per_game", "projected_total_pts_82")
    order = [F.desc("projected_pts_per_game"), F.asc("player_id")]
    return reports.ranked(chosen, order, n).select("rank", "player_id", *columns)


def actual_vs_predicted(scored: DataFrame) -> DataFrame:
    return scored.withColumn("residual", F.col(LABEL) - F.col("prediction"))


def fit_metrics(scored: DataFrame, group: str = "ALL") -> DataFrame:
    """MAE, RMSE, R2, correlation, largest error and n for a position group."""
    chosen = scored if group == "ALL" else scored.where(S.position_group("position") == group)
    return error_metrics(chosen, [], LABEL, "prediction")


@dataclass(frozen=True)
class Trained:
    """A fitted model with what is known of it; the frames have one row."""

    model: PipelineModel
    columns: list[str]
    metrics: DataFrame
    residuals: DataFrame
    version: str = "unversioned"

    @property
    def mae(self) -> float:
        return self.metrics.first().mae

    def score(self, matrix: DataFrame) -> DataFrame:
        return score(self.model, matrix, self.columns)


def _kept(one_row: DataFrame) -> DataFrame:
    """The single row of an aggregate, computed now, so that what it was read from can be released."""
    return one_row.sparkSession.createDataFrame(one_row.collect(), one_row.schema)


def kept_rows(rows: DataFrame) -> DataFrame:
    """``rows`` checkpointed with the partitions and the order they have: the boosting draws its samples by both.

    The tasks of its rounds then do not report for the joins that made the rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    made = rows.persist()  # a cached plan keeps its last partitions
    try:
        return made.checkpoint()
    finally:
        made.unpersist()


def run_training(
    logs: DataFrame,
    players: DataFrame,
    train_seasons: Sequence[str],
    val_season: str,
    model_dir: str | None = None,
    max_iter: int = ROUNDS,
    categorical: Sequence[str] = tuple(categorical_columns()),
    **options,
) -> Trained:
    """Build features, fit, evaluate on the validation season and optionally save."""
    rows = kept_rows(split_seasons(logs, players, train_seasons, val_season, **options)).persist()
    try:
        features = feature_columns(rows)
        model = train(rows, features, categorical, max_iter)
        scored = score(model, rows.where(VALIDATION), features)
        counts = training_counts(rows).first()
        metrics = fit_metrics(scored).withColumns(
            {
                "n_train": F.lit(counts.n_train).cast("long"),
                "n_val": F.lit(counts.n_val).cast("long"),
                "best_iteration": F.lit(model.stages[-1].getNumTrees),
            }
        )
        trained = Trained(model, features, _kept(metrics), _kept(residual_summary(scored, LABEL, "prediction")))
    finally:
        rows.unpersist()
    return save_model(trained, model_dir, categorical) if model_dir else trained


def save_model(trained: Trained, model_dir: str, categorical: Sequence[str] = ()) -> Trained:
    """Model, metadata, residuals and importance below a versioned folder and below ``latest``."""
    version = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    described = trained.metrics.withColumns(
        {
            "model_version": F.lit(version),
            "feature_columns": F.array(*[F.lit(f) for f in trained.columns]),
            "categorical_columns": F.array(*[F.lit(c) for c in categorical]).cast("array<string>"),
            "trained_at": F.current_timestamp(),
        }
    )
    for folder in (f"{model_dir}/v_{version}", f"{model_dir}/latest"):
        trained.model.write().overwrite().save(f"{folder}/model")
        described.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
        trained.residuals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/residuals")
        importance(trained.model, described.sparkSession).coalesce(1).write.mode("overwrite").csv(
            f"{folder}/feature_importance", header=True
        )
    return replace(trained, version=version)


def load_model(spark: SparkSession, model_dir: str, version: str = "latest") -> Trained:
    """A stored model with its metadata and residuals."""
    folder = f"{model_dir}/{version}"
    metadata = spark.read.schema(METADATA).json(f"{folder}/metadata")
    described = metadata.first()
    return Trained(
        PipelineModel.load(f"{folder}/model"),
        list(described.feature_columns),
        metadata,
        spark.read.parquet(f"{folder}/residuals"),
        described.model_version,
    )


def load_importance(spark: SparkSession, model_dir: str, version: str = "latest") -> DataFrame:
    """The importance table stored beside a model, largest first."""
    table = spark.read.schema("feature string, importance double, importance_pct double")
    return table.csv(f"{model_dir}/{version}/feature_importance", header=True).orderBy(
        F.desc("importance"), "feature"
    )
