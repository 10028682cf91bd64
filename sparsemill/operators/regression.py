"""Least squares on several covariates in each group, and many small Poisson regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _grouped

#: Regressions of so many columns are fitted together.
FITS = 64


def least_squares(df: DataFrame, keys: list[str], ys: list[str], xs: list[str]) -> DataFrame:
    """df with fitted_<y> and residual_<y> for each response y, by least squares on xs and an intercept in each group of keys
    (null is a group; without keys all rows are one).

    Means and centred products are mergeable aggregates, one row a group, so that large groups are summed where they lie;
    what reaches Python is a group's matrix of covariates. It is scaled and pseudo-inverted, so that collinear and constant
    covariates are borne. Rows without y or any x, or with NaN in them, do not count for that y and get nulls."""
    import numpy as np

    p, own = len(xs), [f"_k{i}" for i in range(len(keys))]
    known = df.withColumns({f"_x{i}": F.col(x).cast("double") for i, x in enumerate(xs)} | {f"_y{j}": F.col(y).cast("double") for j, y in enumerate(ys)} | {k: F.col(c) for k, c in zip(own, keys)})
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    parts = []
    for j in range(len(ys)):
        whole = there(f"_y{j}")
        for i in range(p):
            whole = whole & there(f"_x{i}")
        known = known.withColumn(f"_w{j}", whole)
        x, y = [F.when(F.col(f"_w{j}"), F.col(f"_x{i}")) for i in range(p)], F.when(F.col(f"_w{j}"), F.col(f"_y{j}"))
        parts += [F.array(*map(F.avg, x), F.avg(y)).alias(f"_m{j}")]
        parts += [F.array(*[F.covar_pop(x[i], x[k]) for i in range(p) for k in range(i, p)]).cast("array<double>").alias(f"_s{j}"), F.array(*[F.covar_pop(x[i], y) for i in range(p)]).cast("array<double>").alias(f"_c{j}")]
    groups = known.groupBy(*own).agg(*parts)

    def solve(batches):
        upper = np.triu_indices(p)
        for pdf in batches:
            out = pdf[own].copy()
            for j in range(len(ys)):
                made = []
                for mean, s, c in zip(pdf[f"_m{j}"], pdf[f"_s{j}"], pdf[f"_c{j}"]):
                    if mean[-1] is None or np.isnan(np.array(mean, float)[-1]):
                        made.append(None)
                        continue
                    mean, full = np.array(mean, float), np.zeros((p, p))
                    full[upper] = s
                    full = np.maximum(full, full.T) if p == 1 else full + np.triu(full, 1).T
                    size = np.sqrt(np.maximum(np.diag(full), 0))
                    scale = np.where(size > 1e-12 * (1 + np.abs(mean[:p])), 1 / np.where(size > 0, size, 1), 0.0)  # constant ones have no say
                    b = scale * (np.linalg.pinv(full * np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (np.array(c, float) * scale))
                    made.append([float(mean[p] - mean[:p] @ b), *map(float, b)])
                out[f"_b{j}"] = made
            yield out

    kinds = ", ".join([f"{k} {known.schema[k].dataType.simpleString()}" for k in own] + [f"_b{j} array<double>" for j in range(len(ys))])
    fits = groups.mapInPandas(solve, kinds)
    if keys:
        right = fits.withColumnsRenamed({k: f"_r{k}" for k in own})
        on = F.lit(True)
        for k in own:
            on = on & F.col(k).eqNullSafe(F.col(f"_r{k}"))
        out = known.join(right, on, "left")
    else:
        out = known.crossJoin(F.broadcast(fits))  # one row
    for j, y in enumerate(ys):
        fitted = F.get(f"_b{j}", F.lit(0))
        for i in range(p):
            fitted = fitted + F.get(f"_b{j}", F.lit(i + 1)) * F.col(f"_x{i}")
        out = out.withColumn(f"fitted_{y}", F.when(F.col(f"_w{j}"), fitted)).withColumn(f"residual_{y}", F.col(f"_y{j}") - F.col(f"fitted_{y}"))
    return out.select(*df.columns, *[f"{a}_{y}" for y in ys for a in ("fitted", "residual")])


def poisson_fits(x, y, weight, reg: float, rounds: int = 100, tol: float = 1e-10):
    """Coefficients of many Poisson regressions with log link and a ridge on every coefficient: x is fits by rows by
    covariates, y and weight fits by rows (a weight counts equal rows, 0 is padding). Newton steps, halved until the
    penalised likelihood does not fall; a fit that has converged stays."""
    import numpy as np

    n, _, p = x.shape
    b = np.zeros((n, p))
    value = lambda b, at: (weight[at] * (y[at] * (e := np.einsum("nrp,np->nr", x[at], b)) - np.exp(np.minimum(e, 500)))).sum(1) - reg / 2 * (b * b).sum(1)
    every, ridge = np.arange(n), reg * np.eye(p)
    now, active = value(b, every), every
    for _ in range(rounds):
        xa, mean = x[active], np.exp(np.minimum(np.einsum("nrp,np->nr", x[active], b[active]), 500))
        grad = np.einsum("nrp,nr->np", xa, weight[active] * (y[active] - mean)) - reg * b[active]
        hess = np.einsum("nrp,nr,nrq->npq", xa, weight[active] * mean, xa, optimize=True) + ridge
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        size, trial = np.ones(len(active)), None
        for _ in range(40):
            trial = b[active] + size[:, None] * step
            worse = ~(value(trial, active) >= now[active] - 1e-12 * np.abs(now[active]))
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        found = value(trial, active)
        done = np.abs(found - now[active]) <= tol * (np.abs(now[active]) + 1)
        b[active], now[active] = trial, found
        active = active[~done]
        if not len(active):
            break
    return b


def neighbour_regressions(cells: DataFrame, edges: DataFrame, rows: DataFrame, pseudo: float = 1.0, reg: float = 1e-4, least_sd: float = 1e-2, rounds: int = 100) -> DataFrame:
    """(col_id, row_id, value): for each source of edges(src, tgt, dist) what a Poisson regression of its cells over all named
    rows on ln(pseudo + cells) of its targets gives, standardised over the rows, with an intercept. A source with one target
    gets that target's cells.

    Rows in which neither a source nor its targets have a cell are alike; they enter a fit as one row with their number, so
    that a fit holds what its columns hold. The result has a row for each named row."""
    import numpy as np

    place = F.row_number().over(Window.partitionBy("src").orderBy(F.round("dist", 10), "tgt"))
    near = edges.select("src", "tgt", "dist").withColumn("slot", place)
    of = near.join(cells.select(F.col("col_id").alias("tgt"), "row_id", "value"), "tgt").select("src", "slot", "row_id", "value")
    own = cells.join(near.select(F.col("src").alias("col_id")).distinct(), "col_id").select(F.col("col_id").alias("src"), F.lit(0).alias("slot"), "row_id", "value")
    # Which targets there are at all, as some may have no cell.
    many = near.groupBy("src").agg(F.max("slot").alias("slot")).select("src", "slot", F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("double").alias("value"))
    named = rows.select("row_id").distinct()
    n_rows = named.count()
    given = of.unionByName(own).join(named, "row_id", "left_semi").unionByName(many).repartition("src").sortWithinPartitions("src", F.col("row_id").asc_nulls_first(), "slot")

    def fit(batches):
        import pyarrow as pa

        def problem(b):
            slot, value = b.column("slot").to_numpy(), b.column("value").to_numpy(zero_copy_only=False)
            k = int(slot[0])  # the row without a row_id comes first
            ids, at = np.unique(b.column("row_id").slice(1).to_numpy(), return_inverse=True)
            full = np.zeros((len(ids) + 1, k + 1))  # the last row stands for all rows without a cell
            np.add.at(full, (at, slot[1:]), value[1:])
            weight = np.r_[np.ones(len(ids)), max(0, n_rows - len(ids))]
            if k == 1:
                return b.column("src")[0].as_py(), ids, weight, full[:, 0], None, full[:, 1]
            x = np.log(full[:, 1:] + pseudo)
            total = max(weight.sum(), 1)
            mean = weight @ x / total
            sd = np.sqrt(np.maximum(weight @ (x * x) / total - mean * mean, 0))
            return b.column("src")[0].as_py(), ids, weight, full[:, 0], np.column_stack([(x - mean) / np.maximum(sd, least_sd), np.ones(len(x))]), None

        def solved(held):
            todo = [h for h in held if h[4] is not None]
            if todo:
                r, p = max(len(h[3]) for h in todo), max(h[4].shape[1] for h in todo)
                x, y, w = np.zeros((len(todo), r, p)), np.zeros((len(todo), r)), np.zeros((len(todo), r))
                for i, (_, _, weight, own_cells, design, _) in enumerate(todo):
                    x[i, : len(weight), p - design.shape[1] :] = design
                    y[i, : len(weight)], w[i, : len(weight)] = own_cells, weight
                fitted = iter(np.exp(np.einsum("nrp,np->nr", x, poisson_fits(x, y, w, reg, rounds))))
            out = [[], [], []]
            for src, ids, weight, _, design, known in held:
                value = known if design is None else next(fitted)[: len(weight)]
                out[0].append(np.full(len(weight), src, "i8"))
                out[1].append(pa.array(np.r_[ids, 0].astype("i8"), mask=np.r_[np.zeros(len(ids), bool), True]))
                out[2].append(value)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.concat_arrays(out[1]), pa.array(np.concatenate(out[2]))], ["col_id", "row_id", "value"])

        held = []
        for b in _grouped(batches, "src"):
            held.append(problem(b))
            if len(held) >= FITS:
                yield solved(held)
                held = []
        if held:
            yield solved(held)

    from ..core import settled

    done = settled(given.select("src", "slot", "row_id", "value").mapInArrow(fit, "col_id long, row_id long, value double"), "fits")
    rest = done.where("row_id is null").select("col_id", F.col("value").alias("rest"))
    every = named.crossJoin(rest)  # the result has all of these rows
    return every.join(done.where("row_id is not null"), ["col_id", "row_id"], "left").select("col_id", "row_id", F.coalesce("value", "rest").alias("value"))
