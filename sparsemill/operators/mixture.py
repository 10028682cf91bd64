"""A finite mixture of Poisson profiles over edges (or columns) of features, by expectation-maximisation.

Edges and their memberships stay in Spark. A round joins the cells with the profiles of their rows, sums each edge's scores,
and sums each row's cells by membership: two shuffles of one row a cell at most, after partial sums. What the driver sees is a
number a cluster and, for the start, a bounded sample of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import settled

#: The start is chosen among about so many edges for each cluster.
SEEDS = 20


def _start(cells: DataFrame, key: str, k: int, seed: int) -> list[dict[int, float]]:
    """Cells of k edges that are unlike each other: each next one is drawn by its distance from those before."""
    import numpy as np

    ids = cells.select(key).distinct()
    chosen = ids.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SEEDS * k)
    rows: dict = {}
    for r in cells.join(F.broadcast(chosen), key).orderBy(key, "row_id").collect():  # the cells of at most SEEDS * k edges
        rows.setdefault(r[key], {})[r["row_id"]] = r["value"]
    edges, rng, far, picked = list(rows.values()), np.random.default_rng(seed), None, []
    while edges and len(picked) < min(k, len(edges)):
        at = int(rng.integers(len(edges))) if far is None else int(np.searchsorted(np.cumsum(far), rng.random() * far.sum())) if far.sum() > 0 else len(picked)
        picked.append(edges[min(at, len(edges) - 1)])
        # Square roots of counts are about equally uncertain.
        gap = np.array([sum((np.sqrt(e.get(j, 0.0)) - np.sqrt(picked[-1].get(j, 0.0))) ** 2 for j in {*e, *picked[-1]}) for e in edges])
        far = gap if far is None else np.minimum(far, gap)
    return picked


def poisson_mixture(cells: DataFrame, rows: DataFrame, k: int, key: str = "edge_id", a0: float = 1.0, b0: float = 1.0, d0: float = 1.0, rounds: int = 50, tol: float = 1e-6, seed: int = 1) -> dict[str, DataFrame | list[float]]:
    """cells(key, row_id, value) of counts in k clusters of Poisson rates over rows(row_id), with Gamma(a0, b0) rates and
    Dirichlet(d0) shares.

    members: (key, cluster, prob, probs), for each edge with a cell the likeliest cluster, the first of equal ones;
    profiles: (cluster, row_id, rate), rows without a cell included; sizes: (cluster, share); trace: the penalised
    log-likelihood of each round, without what no cluster changes; it never falls. Cells that are null, negative or of no named row do not count. Fewer
    edges than k give as many clusters as edges; none give no rows."""
    import numpy as np

    named = rows.select("row_id").distinct()
    x = settled(cells.where("value > 0").join(named, "row_id", "left_semi").groupBy(key, "row_id").agg(F.sum("value").alias("value")), "points")
    start = _start(x, key, k, seed)
    k, d, spark = len(start), named.count(), cells.sparkSession
    if k == 0:
        kind = x.schema[key].dataType.simpleString()
        return {"members": spark.createDataFrame([], f"{key} {kind}, cluster int, prob double, probs array<double>"), "profiles": spark.createDataFrame([], "cluster int, row_id long, rate double"), "sizes": spark.createDataFrame([], "cluster int, share double"), "trace": []}
    seeds = {}
    for c, edge in enumerate(start):
        for r, v in edge.items():
            seeds.setdefault(int(r), [0.0] * k)[c] = float(v)
    sums = spark.createDataFrame([(r, v) for r, v in seeds.items()], "row_id long, s array<double>")
    size, total = np.ones(k), np.array([sum(e.values()) for e in start])
    trace: list[float] = []
    probs = None
    for _ in range(rounds):
        rate = named.join(sums, "row_id", "left").select("row_id", F.array(*[(F.coalesce(F.get("s", F.lit(c)), F.lit(0.0)) + a0) / float(b0 + size[c]) for c in range(k)]).alias("rate"))
        rate = settled(rate, "rates")
        share = (size + d0) / (size.sum() + d0 * k)
        whole = (total + a0 * d) / (b0 + size)  # a cluster's rates over all rows
        logs = x.join(rate, "row_id").groupBy(key).agg(*[F.sum(F.col("value") * F.log(F.get("rate", F.lit(c)))).alias(f"l{c}") for c in range(k)])
        score = F.array(*[F.col(f"l{c}") + float(np.log(share[c]) - whole[c]) for c in range(k)])
        top = F.array_max("score")
        logs = logs.select(key, score.alias("score")).withColumn("all", top + F.log(F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max("score")))))
        probs = settled(logs.select(key, "all", F.transform("score", lambda s: F.exp(s - F.col("all"))).alias("probs")), "memberships")
        prior = rate.agg(*[F.sum(a0 * F.log(F.get("rate", F.lit(c))) - b0 * F.get("rate", F.lit(c))).alias(f"p{c}") for c in range(k)]).first()
        seen = probs.agg(F.sum("all").alias("all"), *[F.sum(F.get("probs", F.lit(c))).alias(f"n{c}") for c in range(k)]).first()
        trace.append(float(seen["all"] + sum(prior) + d0 * np.log(share).sum()))
        if len(trace) > 1 and trace[-1] - trace[-2] <= tol * abs(trace[-2]):
            break
        size = np.array([seen[f"n{c}"] for c in range(k)])
        sums = settled(x.join(probs.select(key, "probs"), key).groupBy("row_id").agg(F.array(*[F.sum(F.col("value") * F.get("probs", F.lit(c))) for c in range(k)]).alias("s")), "profiles")
        found = sums.agg(*[F.sum(F.get("s", F.lit(c))).alias(f"t{c}") for c in range(k)]).first()
        total = np.array([found[f"t{c}"] or 0.0 for c in range(k)])
    best = F.array_max("probs")
    members = probs.select(key, (F.array_position("probs", best) - 1).cast("int").alias("cluster"), best.alias("prob"), "probs")
    profiles = rate.select("row_id", F.posexplode("rate").alias("cluster", "rate")).select("cluster", "row_id", "rate")
    return {"members": members, "profiles": profiles, "sizes": spark.createDataFrame([(c, float(v)) for c, v in enumerate(share)], "cluster int, share double"), "trace": trace}
