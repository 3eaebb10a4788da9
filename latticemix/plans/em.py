"""Training by expectation-maximisation: one distributed aggregate per iteration.

Every iteration starts from the same cached input and the K-row model held on
the driver, so lineage does not grow and a lost executor costs a recompute of
its partitions.  With an output path each iteration's cells are written as they
appear, and training can go on from the last one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..cells import CellModel, temperature_at
from ..constants import DEFAULT_COLS, DEFAULT_MAX_ITER, DEFAULT_ROWS, T_MAX, T_MIN
from ..operators.partials import FAN_IN, add_up
from ..operators.posterior import (
    assign_by_cell,
    assign_by_winner,
    chunks,
    log_density,
    matrix,
    squared_distances,
    task_values,
    weights,
)
from ..operators.prep import checked_widths
from ..sources import trajectory as store

# Leading entries of one cell's statistics; sums of x and of b follow.
HEAD = ("n_cell", "n_winner", "items", "sq_dist", "rows", "log_likelihood")


# Tasks of one pass over the rows: at least so many a core, and else so many
# bytes of rows, or times the bytes of the sums they send.
TASKS_PER_CORE = 4
TASK_BYTES = 1 << 28
MODEL_TIMES = 16
# A variance this much smaller than the squared move of its mean is mostly
# cancellation, and is summed again around the new mean.
CANCELLATION = 1e-6


def statistics(
    points: DataFrame,
    model: CellModel,
    temperature: float,
    components: str = "mixed",
    around: np.ndarray | None = None,
    tasks: int = FAN_IN,
) -> np.ndarray:
    """K x (head, sums of x, sums of b): what the parameter updates need.

    Each task reduces its rows to one packed array; those travel, not rows.  Sums
    of x are taken around ``around`` (the old means if not given), so that mean and
    variance come from a single pass.  ``tasks`` is about the number of partitions
    of ``points``.
    """
    p = task_values(model, temperature, components)
    k, d, s = model.size, model.cont_size, model.bin_size
    at = len(HEAD)

    def reduce_partition(batches):
        total = np.zeros((k, len(HEAD) + d + s))
        seen = 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            seen += n
            x = matrix(batch.column("x"), d) if p["use_x"] else None
            b = matrix(batch.column("b"), s) if p["use_b"] else None
            for _, x_t, bits in chunks(x, b):
                log_d, sq = log_density(x_t, bits, p)
                p_cell, p_winner, log_px = weights(log_d, p)
                n_cell = p_cell.sum(axis=1)
                total[:, 0] += n_cell
                total[:, 1] += p_winner.sum(axis=1)
                total[:, 2] += (p_winner == p_winner.max(axis=0)).sum(axis=1)
                total[0, 4] += len(log_px)
                total[0, 5] += log_px.sum()
                if x_t is not None:
                    center = p["mean"]
                    if around is not None:
                        center, sq = around, squared_distances(around, x_t)
                    total[:, 3] += np.einsum("kn,kn->k", p_cell, sq)
                    total[:, at : at + d] += p_cell @ x_t.T - n_cell[:, None] * center
                if bits is not None:
                    total[:, at + d :] += p_cell @ bits
        return total if seen else None

    needed = [name for name, used in (("x", p["use_x"]), ("b", p["use_b"])) if used]
    found = add_up(points.select(*needed), reduce_partition, tasks)
    return np.zeros((k, len(HEAD) + d + s)) if found is None else found


@dataclass
class Step:
    """Outcome of one iteration."""

    iteration: int
    temperature: float
    cells: CellModel  # parameters applied to the next iteration
    computed: CellModel  # all updated parameters, applied or not
    rows: int
    log_likelihood: float  # of the cells the iteration started from


def em_step(
    points: DataFrame,
    model: CellModel,
    temperature: float,
    *,
    components: str = "mixed",
    update_continuous: bool = False,
    iteration: int = 1,
    tasks: int = FAN_IN,
) -> Step:
    """One iteration: a distributed aggregate over about ``tasks`` partitions, then K-row arithmetic."""
    d, s = model.cont_size, model.bin_size
    sums = statistics(points, model, temperature, components, tasks=tasks)
    head = dict(zip(HEAD, sums.T))
    rows = int(head["rows"].sum())
    if rows == 0:
        raise ValueError("no rows to train on")
    at = len(HEAD)
    n_cell = head["n_cell"][:, None]
    alive = n_cell[:, 0] > 0  # an underflowed cell keeps its old parameters
    safe = np.where(alive[:, None], n_cell, 1.0)
    new = {"prob": head["n_winner"] / rows, "num_items": head["items"]}
    if components != "bin":
        shift = sums[:, at : at + d] / safe
        mean = model.cont_mean + shift
        moved = np.square(shift).sum(axis=1)
        spread = (head["sq_dist"] / safe[:, 0] - moved) / d
        if (alive & (spread < CANCELLATION * moved)).any():
            around = statistics(points, model, temperature, components, mean, tasks)
            rest = np.square(around[:, at : at + d] / safe).sum(axis=1)
            spread = (around[:, HEAD.index("sq_dist")] / safe[:, 0] - rest) / d
        spread = spread.clip(min=0.0)
        new["cont_mean"] = np.where(alive[:, None], mean, model.cont_mean)
        new["cont_variance"] = np.where(alive, spread, model.cont_variance)
    if components != "cont":
        ones = sums[:, at + d :]
        zeros = n_cell - ones
        off = np.minimum(ones, zeros).clip(min=0.0).sum(axis=1) / (s * safe[:, 0])
        new["bin_mean"] = np.where(
            alive[:, None], np.where(zeros >= ones, 0, 1), model.bin_mean
        )
        new["bin_epsilon"] = np.where(alive, off, model.bin_epsilon)
    computed = model.with_values(**new)
    applied = dict(new)
    if not update_continuous:
        applied.pop("cont_mean", None)
        applied.pop("cont_variance", None)
    return Step(
        iteration,
        temperature,
        cells=model.with_values(**applied),
        computed=computed,
        rows=rows,
        log_likelihood=float(head["log_likelihood"].sum()),
    )


@dataclass
class Fitted:
    """A trained model and what is needed to label rows with it."""

    cells: CellModel
    label_cells: CellModel  # parameters that label the training rows
    temperature: float
    components: str
    assign: str
    steps: list[Step] = field(default_factory=list)

    def training_labels(self, points: DataFrame) -> DataFrame:
        """``points`` plus ``cell``, as of the last iteration."""
        return _labels(points, self.label_cells, self.temperature, self.components, self.assign)

    def predict(self, points: DataFrame) -> DataFrame:
        """``points`` plus ``cell`` under the final parameters; rows may be unseen."""
        return _labels(points, self.cells, self.temperature, self.components, self.assign)

    def cell_table(self, spark, initial: CellModel | None = None) -> DataFrame:
        """All iterations' cells, with an ``iteration`` column (0 = the start)."""
        tables = [(s.iteration, s.cells) for s in self.steps]
        if initial is not None:
            tables.insert(0, (0, initial))
        return store.cells_dataframe(spark, tables)


def _labels(points, model, temperature, components, assign) -> DataFrame:
    by = {"cell": assign_by_cell, "winner": assign_by_winner}[assign]
    return by(points, model, temperature, components)


def planned_tasks(n_bytes: int, model_bytes: int, partitions: int, cores: int) -> int:
    """Tasks of one pass over rows of ``n_bytes`` that lie in ``partitions``.

    A task takes ``TASK_BYTES`` of rows, and many times the array of sums it
    sends, but there are a few for each core known now.  Tasks join whole
    partitions, so there are no more than those.
    """
    by_size = -(-n_bytes // max(TASK_BYTES, MODEL_TIMES * model_bytes))
    return max(1, min(partitions, max(by_size, TASKS_PER_CORE * cores)))


def _cached(points: DataFrame, components: str) -> tuple[DataFrame, int]:
    """The needed columns, cached, on at least as many partitions as cores; and the number of rows.

    Only an input too small to fill the cores is moved; its partition count is
    read off the finished cache, so nothing upstream runs twice.
    """
    needed = points.select(*{"mixed": ["x", "b"], "cont": ["x"], "bin": ["b"]}[components])
    cached = needed.persist(StorageLevel.MEMORY_AND_DISK)
    n = cached.count()
    cores = points.sparkSession.sparkContext.defaultParallelism
    if cached.rdd.getNumPartitions() >= cores:
        return cached, n
    spread = cached.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    cached.unpersist()
    return spread, n


def _start(train: DataFrame, rows: int, cols: int, components: str, seed: int) -> CellModel:
    """Starting cells for the widths of the rows, found in one pass over them."""
    used = {"mixed": ("x", "b"), "cont": ("x",), "bin": ("b",)}[components]
    width = checked_widths(train, *used)
    return CellModel.initial(
        rows, cols, cont_size=width.get("x", 2), bin_size=width.get("b", 0), seed=seed
    )


def _label_cells(before: CellModel, after: CellModel, label_prior: str) -> CellModel:
    return before.with_values(prob=after.prob) if label_prior == "updated" else before


def _finished(spark, path: str, max_iter: int, settings: dict) -> Fitted:
    """The model of a complete stored run."""
    before, after = (store.read_model(spark, path, t) for t in (max_iter - 1, max_iter))
    temperature = temperature_at(max_iter, max_iter, settings["t_min"], settings["t_max"])
    label_cells = _label_cells(before, after, settings["label_prior"])
    return Fitted(after, label_cells, temperature, settings["components"], settings["assign"])


def fit(
    points: DataFrame,
    init_cells: CellModel | None = None,
    *,
    rows: int = DEFAULT_ROWS,
    cols: int = DEFAULT_COLS,
    t_min: float = T_MIN,
    t_max: float = T_MAX,
    max_iter: int = DEFAULT_MAX_ITER,
    components: str = "mixed",
    update_continuous: bool = False,
    label_prior: str = "updated",
    assign: str = "cell",
    seed: int = 1,
    output_path: str | None = None,
    label_every: int = 0,
    resume: bool = False,
    cache: bool = True,
) -> Fitted:
    """Train on ``points`` (x and/or b; ``id`` too when labels are stored).

    ``update_continuous=False`` keeps means and variances at their start.
    ``label_prior``: training labels use the last iteration's likelihood with
    the prior it just computed ("updated") or the one it began with ("current").
    ``output_path`` stores the cells of every iteration, ``label_every`` the
    labels of every n-th; ``resume`` goes on from the last committed iteration,
    starts a new run where there is none, and returns the model of a complete one.
    It takes no settings but those that the run was begun with; start cells, or the
    grid and seed they were drawn from, count too where they are given.
    """
    if max_iter < 2:
        raise ValueError("max_iter must be at least 2")
    if label_prior not in ("updated", "current") or assign not in ("cell", "winner"):
        raise ValueError("label_prior is 'updated' or 'current', assign 'cell' or 'winner'")
    spark = points.sparkSession
    if resume and output_path is None:
        raise ValueError("resume needs output_path")
    settings = {
        "max_iter": max_iter,
        "t_min": t_min,
        "t_max": t_max,
        "components": components,
        "update_continuous": update_continuous,
        "label_prior": label_prior,
        "assign": assign,
        "label_every": label_every,
    }
    stored = store.last_iteration(spark, output_path) if resume else None
    before = store.read_settings(spark, output_path) if stored is not None else None
    start = "given" if init_cells is not None else {"rows": rows, "cols": cols, "seed": seed}
    if before is not None:
        changed = sorted(k for k in settings if before.get(k) != settings[k])
        began = before.get("start", "given")
        if init_cells is not None:
            changed += [] if init_cells.same_as(store.read_model(spark, output_path, 0)) else ["start"]
        elif began != "given" and began != start:
            changed.append("start")
        if changed:
            raise ValueError(f"{output_path} was begun with other settings: {', '.join(changed)}")
    if stored is not None and stored[0] >= max_iter:
        return _finished(spark, output_path, max_iter, settings)

    cache = cache and not points.is_cached
    held, n_rows = _cached(points, components) if cache else (points, None)
    train, tasks = held, held.rdd.getNumPartitions()
    steps: list[Step] = []
    # what an interrupted run left of an iteration that it did not commit is replaced
    mode = "overwrite" if resume else "errorifexists"
    try:
        if stored is not None:
            done, model = stored
        else:
            done, model = 0, init_cells or _start(train, rows, cols, components, seed)
            if output_path is not None:
                if not resume and store.committed_iterations(spark, output_path):
                    raise ValueError(f"a run already exists in {output_path}")
                store.write_settings(spark, output_path, settings | {"start": start})
                store.write_cells(spark, output_path, 0, model, mode)
        if n_rows is not None:  # splits of an uncached input are cut by bytes already
            width = model.cont_size + model.bin_size
            cores = spark.sparkContext.defaultParallelism
            tasks = planned_tasks(8 * n_rows * width, 8 * model.size * (width + len(HEAD)), tasks, cores)
            train = held.coalesce(tasks)
        label_cells = model
        for t in range(done + 1, max_iter + 1):
            temperature = temperature_at(t, max_iter, t_min, t_max)
            step = em_step(
                train,
                model,
                temperature,
                components=components,
                update_continuous=update_continuous,
                iteration=t,
                tasks=tasks,
            )
            label_cells = _label_cells(model, step.cells, label_prior)
            model = step.cells
            steps.append(step)
            if output_path is not None:
                if label_every and (t % label_every == 0 or t == max_iter):
                    labelled = _labels(points, label_cells, temperature, components, assign)
                    store.write_labels(labelled, output_path, t, mode)
                store.write_cells(spark, output_path, t, model, mode)
    finally:
        if cache:
            held.unpersist()
    return Fitted(model, label_cells, temperature, components, assign, steps)

