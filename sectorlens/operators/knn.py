"""Exact nearest neighbours by inner product, without comparing all pairs.

The index is cut into cells around pivot vectors. A query first meets the cells nearest to it;
its k-th similarity then rules out every cell that can't hold a better neighbour, since
``q.x = q.p + q.(x - p) <= q.p + |q| R`` for a cell of pivot ``p`` and radius ``R``
(pivot-based kNN joins: Lu et al. 2012). Large cells and crowds of queries are split by hash,
so every task holds a part of bounded size. A vector is copied once per part of the other side,
so parts are as large as a task may hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.operators.ranking import top_per_key
from sectorlens.session import cut

MAX_PIVOTS = 4096
MAX_PIVOT_BYTES = 16 * 2**20  # pivots travel with the tasks
SLICE_ROWS = 1024  # vectors compared with all pivots at a time
DIGITS = 9  # similarities are compared to this many decimals, so equal vectors tie exactly
SLACK = 1e-6
DEALT_VALUES = 4 * 2**20  # numbers of the index vectors that one task holds; half as many of its queries
MAX_GATHERED = 4 * 2**20  # numbers of the vectors that are compared one by one at a time
MAX_SINGLE = 1e30  # products up to here are taken in single precision first
SINGLE_STEP = 2.0**-23


def _matrix(vectors: pd.Series, normalise: bool) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    if normalise:
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norms, out=matrix, where=norms > 0)
    return matrix


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), SLICE_ROWS):
            yield batch.iloc[start : start + SLICE_ROWS]


def _distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (matrix**2).sum(1)[:, None] - 2 * matrix @ pivots.T + (pivots**2).sum(1)[None, :]
    return np.sqrt(np.maximum(squares, 0))


def _home_cells(distances: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """For each query the nearest cells that together hold ``wanted`` vectors, as a mask."""
    order = np.argsort(distances, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    needed = np.concatenate([np.ones((len(order), 1), bool), held[:, :-1] < wanted], axis=1)
    homes = np.zeros_like(needed)
    np.put_along_axis(homes, order, needed, axis=1)
    return homes & (sizes > 0)


def _nearest(asked: np.ndarray, asked_ids: np.ndarray, held: np.ndarray, held_ids: np.ndarray, k: int, exclude_self: bool, block_rows: int):
    """(rows, places, sims): the ``k`` vectors of ``held``, ordered by id, most similar to each of ``asked``.

    A block of similarities is taken in single precision first. Only what its rounding error could
    lift above the k-th similarity so far is taken in double precision and ranked.
    """
    held_norms = np.linalg.norm(held, axis=1)
    longest = held_norms[np.isfinite(held_norms)].max(initial=0.0)
    best, places = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1)
    rough = held.astype(np.float32)
    for start in range(0, len(asked), SLICE_ROWS):
        rows_of = slice(start, start + SLICE_ROWS)
        part, ids = asked[rows_of], asked_ids[rows_of]
        top, top_places = best[rows_of], places[rows_of]
        norms = np.linalg.norm(part, axis=1)
        single = norms.max(initial=0.0) * longest < MAX_SINGLE
        narrow = part.astype(np.float32) if single else part
        slack = 10.0**-DIGITS + (part.shape[1] + 4) * SINGLE_STEP * norms * longest
        for first in range(0, len(held), block_rows):
            block = held[first : first + block_rows]
            block_ids = held_ids[first : first + block_rows]
            near = narrow @ (rough if single else held)[first : first + block_rows].T
            bars = top[:, -1]
            low = bars - slack
            if first == 0 and near.shape[1] > k + 1:
                low = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)] - 2 * slack
            wanted = near < low.astype(near.dtype)[:, None]
            wanted = np.flatnonzero(np.logical_not(wanted, out=wanted))
            if len(wanted) * part.shape[1] > MAX_GATHERED:
                rows, cols, sims = _crowd(part, ids, block, block_ids, k, exclude_self)
            else:
                rows, cols = np.divmod(wanted, len(block))
                if exclude_self:
                    other = ids[rows] != block_ids[cols]
                    rows, cols = rows[other], cols[other]
                sims = np.round(np.einsum("ij,ij->i", part[rows], block[cols]), DIGITS)
                sims[np.isnan(sims)] = np.inf  # takes a place, as it can't be compared, and is left out at the end
            # What is level with the k-th has a higher id.
            better = sims > bars[rows]
            rows, cols, sims = rows[better], cols[better], sims[better]
            touched = np.unique(rows)
            all_rows = np.concatenate([np.repeat(touched, k), rows])
            all_sims = np.concatenate([top[touched].ravel(), sims])
            all_places = np.concatenate([top_places[touched].ravel(), cols + first])
            order = np.lexsort((all_places, -all_sims, all_rows))
            starts = np.searchsorted(all_rows[order], touched)
            kept = order[(starts[:, None] + np.arange(k)[None, :])]
            top[touched], top_places[touched] = all_sims[kept], all_places[kept]
    rows, ranks = np.nonzero(np.isfinite(best))
    return rows, places[rows, ranks], best[rows, ranks]


def _crowd(asked: np.ndarray, asked_ids: np.ndarray, held: np.ndarray, held_ids: np.ndarray, k: int, exclude_self: bool):
    """As :func:`_nearest` for one block with many similarities near the k-th, such as copies."""
    sims = np.round(asked @ held.T, DIGITS)
    sims[np.isnan(sims)] = np.inf
    if exclude_self:
        sims[asked_ids[:, None] == held_ids[None, :]] = -np.inf
    kept = np.ones_like(sims, bool)
    if sims.shape[1] > k:
        bar = np.partition(sims, -k, axis=1)[:, -k][:, None]
        above, level = sims > bar, sims == bar
        # Of vectors level with the k-th only the first ids are kept.
        kept = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    rows, cols = np.nonzero(kept)
    return rows, cols, sims[rows, cols]


def _local_top(k: int, exclude_self: bool, normalise: bool, by: Sequence[str], block_rows: int):
    def top(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "query_id", "neighbour_id", "sim"]
        if queries.empty or index.empty:
            return pd.DataFrame(columns=columns)
        index = index.sort_values("id", kind="stable")
        query_ids, index_ids = queries["id"].to_numpy(), index["id"].to_numpy()
        asked, held = _matrix(queries["vector"], normalise), _matrix(index["vector"], normalise)
        with np.errstate(invalid="ignore", over="ignore"):
            rows, places, sims = _nearest(asked, query_ids, held, index_ids, k, exclude_self, block_rows)
        found = {"query_id": query_ids[rows], "neighbour_id": index_ids[places], "sim": sims}
        return pd.DataFrame({**{c: queries[c].iloc[0] for c in by}, **found}, columns=columns)

    return top


def knn_join(
    queries: DataFrame,
    index: DataFrame,
    k: int = 20,
    by: Sequence[str] = (),
    id_col: str = "org_id",
    vector: str = "embedding",
    normalise: bool = True,
    exclude_self: bool = True,
    block_rows: int = 4096,
    pivots: int | None = None,
    dealt_rows: int | None = None,
) -> DataFrame:
    """(by..., query_id, rank, neighbour_id, sim): the ``k`` index vectors most similar to each query.

    ``by`` keeps searches apart, for example one per assignment parameter; it should have few
    values. Equal similarities go to the lower id. A task holds up to ``dealt_rows`` index vectors,
    by default as many as ``DEALT_VALUES`` allows, and half as many queries, and compares
    ``block_rows`` of them at a time.
    """
    by = list(by)
    spark = index.sparkSession
    index = index.select(*by, F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    queries = queries.select(*by, F.col(id_col).alias("id"), F.col(vector).alias("vector"))
    by_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in index.select(*by).schema) if by else ""
    vector_schema = f"{by_schema}id {index.schema['id'].dataType.simpleString()}, vector array<float>"
    index = index.withColumn("vector", F.col("vector").cast("array<float>"))
    queries = queries.withColumn("vector", F.col("vector").cast("array<float>"))

    if pivots is None or dealt_rows is None:
        size = index.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim")).first()
        dealt_rows = dealt_rows or max(SLICE_ROWS, DEALT_VALUES // max(size.dim, 1))
        if pivots is None:
            pivots = min(-(-size.n // dealt_rows), MAX_PIVOT_BYTES // (8 * max(size.dim, 1)))
    asked_rows = -(-dealt_rows // 2)
    # At most MAX_PIVOTS vectors come to the driver, whatever the size of the index.
    drawn = index.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, MAX_PIVOTS))).collect()
    if not drawn:
        return spark.createDataFrame([], f"{by_schema}query_id long, rank int, neighbour_id long, sim double")
    centres = np.unique(_matrix(pd.Series([np.array(r.vector) for r in drawn]), normalise), axis=0)
    n_cells = len(centres)

    if n_cells > 1:

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in _slices(batches):
                if len(batch):
                    distances = _distances(_matrix(batch["vector"], normalise), centres)
                    cells = distances.argmin(1)
                    yield batch.assign(cell=cells.astype("int32"), distance=distances[np.arange(len(batch)), cells])

        placed = cut(index.mapInPandas(place, f"{vector_schema}, cell int, distance double"))
    else:
        placed = index.withColumn("cell", F.lit(0)).withColumn("distance", F.lit(0.0))

    # One row per cell and `by` value: at most MAX_PIVOTS rows per search.
    stats = placed.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    sizes: dict[tuple, np.ndarray] = {}
    radii: dict[tuple, np.ndarray] = {}
    for row in stats:
        key = tuple(row[c] for c in by)
        sizes.setdefault(key, np.zeros(n_cells))[row.cell] = row.n
        radii.setdefault(key, np.zeros(n_cells))[row.cell] = row.radius
    cells = spark.createDataFrame(
        [(*[r[c] for c in by], r.cell, -(-r.n // dealt_rows)) for r in stats], f"{by_schema}cell int, n_sub long"
    )

    def visiting(bars: bool):
        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in _slices(batches):
                if batch.empty:
                    continue
                groups = batch.groupby(by, sort=False) if by else [((), batch)]
                for key, part in groups:
                    key = key if isinstance(key, tuple) else (key,)
                    if key not in sizes:
                        continue
                    matrix = _matrix(part["vector"], normalise)
                    chosen = _home_cells(_distances(matrix, centres), sizes[key], k + 1)
                    if bars:
                        reach = matrix @ centres.T + np.linalg.norm(matrix, axis=1)[:, None] * radii[key][None, :]
                        bar = part["bar"].fillna(-np.inf).to_numpy()[:, None]
                        chosen = ~chosen & (sizes[key] > 0) & (reach >= bar - SLACK)
                    cells_of = [np.flatnonzero(row).astype("int32") for row in chosen]
                    yield part.drop(columns="bar", errors="ignore").assign(cells=cells_of)

        return choose

    def meet(visits: DataFrame) -> DataFrame:
        crowds = visits.groupBy(*by, "cell").agg(F.ceil(F.count("*") / asked_rows).alias("n_chunk"))
        # `cells` has at most MAX_PIVOTS rows per search, so this broadcast is bounded.
        plan = F.broadcast(cells.join(crowds, [*by, "cell"]))
        keys = [*by, "cell", "sub", "chunk"]
        asked = (
            visits.join(plan, [*by, "cell"])
            .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("n_chunk")))
            .withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sub") - 1)))
            .join(queries, [*by, "id"])
            .select(*keys, "id", "vector")
        )
        held = (
            placed.join(plan, [*by, "cell"])
            .withColumn("sub", F.pmod(F.xxhash64("id"), F.col("n_sub")))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunk") - 1)))
            .select(*[F.col(c).alias(f"held_{c}") for c in keys], "id", "vector")
        )
        schema = f"{by_schema}query_id long, neighbour_id long, sim double"
        return asked.groupBy(*keys).cogroup(held.groupBy(*[f"held_{c}" for c in keys])).applyInPandas(
            _local_top(k, exclude_self, normalise, by, block_rows), schema
        )

    order = [F.desc("sim"), F.col("neighbour_id")]
    if n_cells == 1:
        found = meet(queries.select(*by, "id", F.lit(0).alias("cell")))
        return top_per_key(found, [*by, "query_id"], order, k)

    # Visits are written without vectors: they are counted per cell and then dealt into blocks.
    exploded = [*by, "id", F.explode("cells").alias("cell")]
    homes = cut(queries.mapInPandas(visiting(False), f"{vector_schema}, cells array<int>").select(*exploded))
    near = cut(top_per_key(meet(homes), [*by, "query_id"], order, k))
    bars = near.where(F.col("rank") == k).select(*by, F.col("query_id").alias("id"), F.col("sim").alias("bar"))
    barred = queries.join(bars, [*by, "id"], "left").select(*queries.columns, "bar")
    others = cut(barred.mapInPandas(visiting(True), f"{vector_schema}, cells array<int>").select(*exploded))
    found = near.drop("rank").unionByName(meet(others))
    return top_per_key(found, [*by, "query_id"], order, k)


def drop_surplus(hits: DataFrame, k: int, by: Sequence[str] = (), in_index: bool = True) -> DataFrame:
    """``k`` neighbours of ``k + 1`` hits: without the query itself, or without the last hit."""
    kept = hits.where("neighbour_id <> query_id") if in_index else hits
    return top_per_key(kept.drop("rank"), [*by, "query_id"], [F.desc("sim"), F.col("neighbour_id")], k)


def clustered_vectors(clusters: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors of the clustered organisations; error when one has no vector."""
    clusters = cut(clusters)  # read by the check and by the join
    missing = clusters.join(embeddings.select("org_id"), "org_id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"organisation {missing[0]['org_id']} has no vector")
    return clusters.join(embeddings.select("org_id", "embedding"), "org_id")


def left_over_vectors(clusters: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(param, org_id, embedding) of the organisations in no cluster of the parameter."""
    params = clusters.select("param").distinct()  # a few rows, one per assignment parameter
    everyone = embeddings.select("org_id").crossJoin(params)
    rest = everyone.join(clusters.select("param", "org_id"), ["param", "org_id"], "left_anti")
    return rest.join(embeddings.select("org_id", "embedding"), "org_id").select("param", "org_id", "embedding")
