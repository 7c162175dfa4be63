"""Kernels between cells and landmarks, embeddings, bases."""
from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import vectors
from gridloom.operators.sampling import sample_fixed
from gridloom.operators.stats import gram_matrix
from gridloom.session import durable

#: Bytes of landmarks in one broadcast; larger sets travel in parts.
PART_BYTES = 64 << 20
#: Numbers in one dense slice of a batch.
BLOCK_CELLS = 1 << 21
#: Rows and basis functions that are evaluated together.
SINE_ROWS, SINE_BLOCK = 1024, 256

# -- sparse rows ----------------------------------------------------------------------


def feature_vectors(abund: DataFrame, cell: str, species: str = "species", week: str = "week", value: str = "x") -> DataFrame:
    """(cell, features, vec): present features of each cell, species-major then week."""
    ordered = F.array_sort(F.collect_list(F.struct(species, week, value)))
    return abund.groupBy(cell).agg(ordered.alias("_f")).select(
        cell, F.transform("_f", lambda p: F.struct(p[species].alias(species), p[week].alias(week))).alias("features"), F.transform("_f", lambda p: p[value]).alias("vec")
    )


# -- dense kernels against landmarks ----------------------------------------------------


def with_landmarks(df: DataFrame, landmarks: DataFrame, key: str, vector: str) -> DataFrame:
    """Each row once per landmark: (.., lm, lm_vec). Landmarks travel as one array."""
    array = landmarks.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("lm"), F.col(vector).alias("lm_vec"))))).scalar()
    return df.withColumn("_l", array).withColumn("_l", F.explode("_l")).select(*df.columns, "_l.lm", "_l.lm_vec")


def rbf(d2: Column, lengthscale: float, alpha: float = 1.0) -> Column:
    """exp(-d2 / (2 l^2)), raised to ``alpha``."""
    return F.pow(F.exp(-d2 / (2 * lengthscale * lengthscale)), F.lit(float(alpha)))


def rational_quadratic(d2: Column, lengthscale: float, alpha: float) -> Column:
    return F.pow(1 + d2 / (2 * alpha * lengthscale * lengthscale), F.lit(-float(alpha)))


def cosine(x: Column, direction: Sequence[float], eps: float = 1e-9) -> Column:
    """Cosine similarity to a fixed direction, both norms offset by eps."""
    length = math.sqrt(sum(v * v for v in direction)) + eps
    return vectors.dot(x, vectors.lit_array([v / length for v in direction])) / (vectors.norm(x) + eps)


def distance_similarity(df: DataFrame, anchors: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lm, similarity) = 1 - |x - x_anchor| / (max - min); all ones for a constant."""
    span = df.agg((F.max(value) - F.min(value)).alias("r")).scalar()
    paired = with_landmarks(df.select(key, value).withColumn("_r", span), anchors, key, value)
    sim = F.when(F.col("_r") > 0, 1 - F.abs(F.col(value) - F.col("lm_vec")) / F.col("_r")).otherwise(1.0)
    return paired.select(key, "lm", sim.alias("similarity"))


# -- kernels to landmarks, Nystrom -----------------------------------------------------------


class Marks:
    """Landmarks: a dense matrix, or (positions, values) per landmark over ``width`` columns."""

    def __init__(self, pdf: pd.DataFrame, key: str, vector: str, width: int | None):
        self.keys, self.width = pdf[key].to_numpy(), width
        if width is None:
            self.rows = _matrix(pdf, vector, None) if len(pdf) else np.zeros((0, 0))
        else:
            self.rows = [(np.asarray(i, dtype=np.int64), np.asarray(v, dtype=float)) for i, v in zip(pdf[f"{vector}_idx"], pdf[f"{vector}_val"])]

    def __len__(self) -> int:
        return len(self.rows)

    def dense(self, start: int, stop: int) -> np.ndarray:
        if self.width is None:
            return self.rows[start:stop]
        out = np.zeros((stop - start, self.width))
        for at, (i, v) in enumerate(self.rows[start:stop]):
            out[at, i] = v
        return out

    def sparse(self, start: int, stop: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.width is not None:
            return self.rows[start:stop]
        return [(np.flatnonzero(r), r[r != 0]) for r in self.rows[start:stop]]

    def parts(self) -> Iterator[tuple[int, int]]:
        """(start, stop) of runs of landmarks of at most ``PART_BYTES`` each."""
        start, held = 0, 0
        for at in range(len(self)):
            size = self.rows[at].nbytes if self.width is None else sum(a.nbytes for a in self.rows[at])
            if held and held + size > PART_BYTES:
                yield start, at
                start, held = at, 0
            held += size
        if start < len(self):
            yield start, len(self)

    def cut(self, start: int, stop: int) -> Marks:
        out = object.__new__(Marks)
        out.keys, out.width, out.rows = self.keys[start:stop], self.width, self.rows[start:stop]
        return out


def kernel_block(x: np.ndarray, marks: Marks, start: int, stop: int, kind: str, p: dict) -> np.ndarray:
    """(n, stop - start) kernel of a batch of dense rows with some landmarks."""
    if kind == "ruzicka":
        return _ruzicka_block(x, marks.sparse(start, stop))
    if kind == "ruzicka_by_species":
        return _species_block(x, marks.sparse(start, stop), p["n_species"])
    lm = marks.dense(start, stop)
    if kind == "linear":
        return x @ lm.T
    if kind not in ("rbf", "rq"):
        raise ValueError(f"unknown kernel {kind!r}")
    return _of_distance(np.maximum((x * x).sum(1)[:, None] + (lm * lm).sum(1)[None, :] - 2 * x @ lm.T, 0.0), kind, p)


def _of_distance(d2: np.ndarray, kind: str, p: dict) -> np.ndarray:
    if kind == "rbf":
        return np.exp(-d2 / (2 * p["lengthscale"] ** 2)) ** p.get("alpha", 1.0)
    return (1 + d2 / (2 * p["alpha"] * p["lengthscale"] ** 2)) ** -p["alpha"]


def _ruzicka_block(x: np.ndarray, rows: list, floor: float = 1e-6) -> np.ndarray:
    mass, out = x.sum(1), np.zeros((len(x), len(rows)))
    for at, (i, v) in enumerate(rows):
        low = np.minimum(x[:, i], v).sum(1)
        high = mass + v.sum() - low
        np.divide(low, high, out=out[:, at], where=high > floor)
    return out


def _species_block(x: np.ndarray, rows: list, n_species: int, floor: float = 1e-6) -> np.ndarray:
    """Mean over species of their Ruzicka similarities; a species that a landmark lacks adds 0."""
    weeks = x.shape[1] // n_species
    mass, out = x.reshape(len(x), n_species, weeks).sum(2), np.zeros((len(x), len(rows)))
    for at, (i, v) in enumerate(rows):
        if len(i) == 0:
            continue
        species, first = np.unique(i // weeks, return_index=True)
        low = np.add.reduceat(np.minimum(x[:, i], v), first, axis=1)
        high = mass[:, species] + np.add.reduceat(v, first) - low
        out[:, at] = np.divide(low, high, out=np.zeros_like(low), where=high > floor).sum(1) / n_species
    return out


def _matrix(pdf: pd.DataFrame, vector: str, width: int | None) -> np.ndarray:
    """Rows of a batch as a matrix; ``width`` marks (vector_idx, vector_val) sparse columns."""
    if width is None:
        return np.stack(pdf[vector].to_numpy()).astype(float)
    out = np.zeros((len(pdf), width))
    idx, val = pdf[f"{vector}_idx"], pdf[f"{vector}_val"]
    rows = np.repeat(np.arange(len(pdf)), idx.map(len))
    if len(rows):
        out[rows, np.concatenate(idx.to_numpy()).astype(int)] = np.concatenate(val.to_numpy())
    return out


def _slices(pdf: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Slices of a batch whose dense form has about ``BLOCK_CELLS`` numbers."""
    step = max(1, BLOCK_CELLS // max(width, 1))
    for start in range(0, len(pdf), step):
        yield pdf.iloc[start:start + step]


def _columns(vector: str, width: int | None) -> list[str]:
    return [vector] if width is None else [f"{vector}_idx", f"{vector}_val"]


def against_landmarks(df: DataFrame, landmarks: DataFrame, key: str, vector: str, kind: str, params: dict | None = None, width: int | None = None) -> DataFrame:
    """(key, lm, k): kernel of every row with every landmark, zeros included.

    ``landmarks`` is a table of parameter size with the columns of ``df``. It travels in broadcasts of at most
    ``PART_BYTES`` each; a row meets all landmarks of a part where it lives, so nothing is shuffled.
    """
    p, cols = dict(params or {}), _columns(vector, width)
    marks = Marks(landmarks.select(key, *cols).toPandas().sort_values(key), key, vector, width)
    kt = df.schema[key].dataType.simpleString()
    out = None
    for start, stop in marks.parts():
        shared = df.sparkSession.sparkContext.broadcast(marks.cut(start, stop))

        def rows(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            part = shared.value
            for batch in batches:
                for pdf in _slices(batch, max(len(part), width or 0)):
                    k = kernel_block(_matrix(pdf, vector, width), part, 0, len(part), kind, p)
                    yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(part)), "lm": np.tile(part.keys, len(pdf)), "k": k.ravel()})

        found = df.select(key, *cols).mapInPandas(rows, f"{key} {kt}, lm {kt}, k DOUBLE")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.select(key, F.col(key).alias("lm"), F.lit(0.0).alias("k")).where(F.lit(False))
    return out


def _times(df: DataFrame, key: str, vector: str, width: int | None, marks: Marks, matrix: np.ndarray, kind: str, p: dict) -> DataFrame:
    """(key, z): kernel rows times an (m, d) matrix, summed over the parts of the landmarks in place."""
    cols, kt = _columns(vector, width), df.schema[key].dataType.simpleString()
    rest = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)
    out = df.select(key, *cols, F.array_repeat(F.lit(0.0), matrix.shape[1]).alias("_sum"))
    for start, stop in marks.parts():
        shared = df.sparkSession.sparkContext.broadcast((marks.cut(start, stop), matrix[start:stop]))

        def add(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            part, factor = shared.value
            for batch in batches:
                for pdf in _slices(batch, max(1024, width or 0)):
                    x, total = _matrix(pdf, vector, width), _matrix(pdf, "_sum", None)
                    for lo in range(0, len(part), 1024):
                        hi = min(lo + 1024, len(part))
                        total += kernel_block(x, part, lo, hi, kind, p) @ factor[lo:hi]
                    yield pdf.assign(_sum=list(total))

        out = out.mapInPandas(add, f"{key} {kt}, {rest}, _sum ARRAY<DOUBLE>")
    return out.select(key, F.col("_sum").alias("z"))


def _leading_pairs(product: Callable[[np.ndarray], np.ndarray], m: int, dim: int, seed: int, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenpairs of a symmetric (m, m) matrix known by its products: block Krylov.

    The basis grows by one orthogonal block a round until the wanted pairs leave no residual or it spans
    everything (then they are exact). The driver holds m x (blocks * width) numbers, never m x m at large m.
    """
    width = min(m, dim + 10)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    basis, image = np.zeros((m, 0)), np.zeros((m, 0))
    while True:
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:dim]
        values, pairs, scale = values[top], basis @ rotation[:, top], max(abs(values[top[0]]), 1e-300)
        residual = np.linalg.norm(image @ rotation[:, top] - pairs * values, axis=0).max()
        room = m - basis.shape[1]
        if room <= 0 or residual <= tolerance * scale:
            return values, pairs
        rest = image[:, -block.shape[1]:]
        for _ in range(2):  # twice, for orthogonality to the last bit
            rest = rest - basis @ (basis.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        keep = min(room, int((s > 1e-13 * scale).sum()))
        if keep == 0:
            return values, pairs
        block = u[:, :keep]


def nystrom(
    df: DataFrame, key: str, vector: str, dim: int, n_landmarks: int, kind: str,
    params: dict | None = None, seed: int = 0, width: int | None = None,
) -> DataFrame:
    """(key, z ARRAY<DOUBLE>): Z = K_nm U L^-1/2 with the leading ``dim`` eigenpairs of K_mm.

    Landmarks are a hash sample of parameter size; products with their m x m kernel run in Spark, so the driver
    holds landmarks and a narrow basis only, at any m. Every cell is projected where it lives. A leading slice
    of z is the smaller embedding. An empty table gives an empty table.
    ``df`` is read twice (landmarks, projection): pass a stored or durable table when it is costly.
    """
    p = dict(params or {})
    sample = durable(sample_fixed(df.select(key, *_columns(vector, width)), [key], n_landmarks, seed))
    marks = Marks(sample.toPandas().sort_values(key), key, vector, width)
    order = {k: i for i, k in enumerate(marks.keys)}

    def product(block: np.ndarray) -> np.ndarray:
        out = np.zeros_like(block)
        got = _times(sample, key, vector, width, marks, block, kind, p).toPandas()
        out[[order[k] for k in got[key]]] = np.stack(got["z"].to_numpy())
        return out

    if len(marks) == 0:
        return df.select(key, F.array().cast("array<double>").alias("z"))
    values, basis = _leading_pairs(product, len(marks), min(dim, len(marks)), seed)
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return _times(df, key, vector, width, marks, basis / np.sqrt(np.maximum(values, 1e-10)), kind, p)


def sparse_vectors(abund: DataFrame, cell: str, n_weeks: int = 52, value: str = "x", name: str = "vec", species: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """((cell, vec_idx, vec_val), width, n_species) over a species-major (species, week) axis.

    The species list is a model dimension; it numbers the axis and is joined as a small table.
    It is taken from ``species`` when given, else from the abundance rows.
    """
    names = sorted(r[0] for r in (abund if species is None else species).select("species").distinct().collect())
    axis = abund.sparkSession.createDataFrame([(n, i * n_weeks) for i, n in enumerate(names)], "species STRING, _at INT")
    placed = abund.join(F.broadcast(axis), "species").groupBy(cell).agg(F.array_sort(F.collect_list(F.struct((F.col("_at") + F.col("week")).alias("i"), F.col(value).alias("v")))).alias("_f"))
    rows = placed.select(cell, F.transform("_f", lambda e: e["i"]).alias(f"{name}_idx"), F.transform("_f", lambda e: e["v"]).alias(f"{name}_val"))
    return rows, len(names) * n_weeks, len(names)


def sweep(
    abund: DataFrame, cell: str, sigmas: Sequence[float], dims: Sequence[int], n_landmarks: int, n_pairs: int,
    kernels: Sequence[tuple[str, float | None, float | None]] = (("ruzicka", None, None),), seed: int = 0,
) -> DataFrame:
    """(sigma, kind, lengthscale, alpha, dim, rank, rmse, utility): embedding quality per setting.

    ``kernels`` lists (kind, lengthscale, alpha); distance kernels take square roots of the shares of each cell.
    The largest embedding runs once per kernel; smaller dims are leading slices. Rows are dealt by cell once for each
    smoothed table, and smoothing, shares and vectors follow where they lie; only vectors, embeddings and pairs are kept.
    Fidelity is measured on hash-sampled pairs.
    """
    from gridloom.operators import rates, sampling, stats, temporal

    out, base = None, durable(abund)
    for sigma in sigmas:
        smooth = temporal.circular_smooth(base.repartition(cell), [cell, "species"], "week", "x", sigma)
        present = durable(smooth.select("species").distinct())
        forms: dict[bool, tuple] = {}
        for kind, lengthscale, alpha in kernels:
            shares = kind in ("rbf", "rq")
            if shares not in forms:
                vecs, width, n_species = sparse_vectors(temporal.hellinger(smooth, cell, "x") if shares else smooth, cell, species=present)
                forms[shares] = durable(vecs), width, n_species
            vecs, width, n_species = forms[shares]
            params = {"n_species": n_species, "lengthscale": lengthscale, "alpha": alpha}
            full = durable(nystrom(vecs, cell, "vec", max(dims), n_landmarks, kind, params, seed, width).where(F.col(cell).isNotNull()))
            pairs = _with_vectors(durable(sampling.sample_pairs(full, cell, n_pairs, seed, ["z"])), vecs, cell)
            truth = durable(pair_kernel(pairs, kind, params, width).select("z_a", "z_b", "k"))
            for d in dims:
                fit = pair_errors(truth, vectors.dot(F.slice("z_a", 1, d), F.slice("z_b", 1, d)), F.col("k"))
                rank = stats.effective_rank(full.select(F.slice("z", 1, d).alias("z")), "z").scalar()
                row = fit.select(
                    F.lit(float(sigma)).alias("sigma"), F.lit(kind).alias("kind"), F.lit(lengthscale).cast("double").alias("lengthscale"),
                    F.lit(alpha).cast("double").alias("alpha"), F.lit(d).alias("dim"), rank.alias("rank"), F.col("rmse_norm").alias("rmse"),
                )
                out = row if out is None else out.unionByName(row)
    return out.withColumn("utility", rates.utility(F.col("rank"), F.col("rmse")))


def _with_vectors(pairs: DataFrame, vecs: DataFrame, cell: str) -> DataFrame:
    """Sampled pairs (a parameter's number) with the sparse vectors of both cells; the other vectors stay where they are."""
    asked = pairs.select(F.explode(F.array(f"{cell}_a", f"{cell}_b")).alias(cell)).distinct()
    own = vecs.join(F.broadcast(asked), cell, "left_semi")
    for tag in ("a", "b"):
        pairs = pairs.join(own.select(*[F.col(c).alias(f"{c}_{tag}") for c in (cell, "vec_idx", "vec_val")]), f"{cell}_{tag}")
    return pairs


def pair_errors(pairs: DataFrame, approx: Column, truth: Column) -> DataFrame:
    """One row over sampled pairs: rmse, rmse over the size of the truth, alignment, and the squared error plain and
    weighted by |truth| and truth^2."""
    p = pairs.select(approx.alias("_a"), truth.alias("_t"))
    e, t = F.pow(F.col("_a") - F.col("_t"), 2), F.col("_t")
    cross, aa, tt = F.sum(F.col("_a") * t), F.sum(F.col("_a") * F.col("_a")), F.sum(t * t)
    return p.agg(
        F.sqrt(F.avg(e)).alias("rmse"), (F.sqrt(F.avg(e)) / (F.sqrt(F.avg(t * t)) + 1e-8)).alias("rmse_norm"),
        F.try_divide(cross, F.sqrt(aa * tt)).alias("alignment"),
        F.avg(e).alias("plain"), F.avg(F.abs(t) * e).alias("weighted_abs"), F.avg(t * t * e).alias("weighted_square"),
    )


def pair_kernel(pairs: DataFrame, kind: str, params: dict, width: int) -> DataFrame:
    """Add ``k``: the exact kernel of each sampled pair of sparse vectors."""

    @F.pandas_udf("double")
    def exact(ia: pd.Series, va: pd.Series, ib: pd.Series, vb: pd.Series) -> pd.Series:
        out = []
        for part in _slices(pd.DataFrame({"a_idx": ia, "a_val": va, "b_idx": ib, "b_val": vb}), width):
            a, b = _matrix(part, "a", width), _matrix(part, "b", width)
            if kind in ("rbf", "rq"):
                out.append(_of_distance(((a - b) ** 2).sum(1), kind, params))
                continue
            shape = (len(a), params["n_species"], -1) if kind == "ruzicka_by_species" else (len(a), 1, width)
            a, b = a.reshape(shape), b.reshape(shape)
            if kind == "linear":
                out.append((a * b).sum((1, 2)))
                continue
            low, high = np.minimum(a, b).sum(2), np.maximum(a, b).sum(2)
            out.append(np.divide(low, high, out=np.zeros_like(low), where=high > 1e-6).mean(1))
        return pd.Series(np.concatenate(out) if out else [])

    return pairs.withColumn("k", exact("vec_idx_a", "vec_val_a", "vec_idx_b", "vec_val_b"))


# -- bases ----------------------------------------------------------------------------------


def random_fourier(x: Column, weights: np.ndarray, phases: np.ndarray) -> Column:
    """cos(W x + b) * sqrt(2 / d); W (d x D) and b are seeded parameters."""
    scale = math.sqrt(2.0 / len(phases))
    return F.array(*[F.cos(vectors.dot(x, vectors.lit_array(w)) + F.lit(float(b))) * scale for w, b in zip(weights, phases)])


def sine_basis(coords: Sequence[Column], m: int, ell: float) -> list[Column]:
    """Product of sqrt(1/ell) sin(pi j (x + ell) / (2 ell)) over dims, j = 1..m each."""

    def wave(x: Column, j: int) -> Column:
        return math.sqrt(1.0 / ell) * F.sin(F.lit(math.pi * j / (2 * ell)) * (x + ell))

    out = []
    for js in itertools.product(range(1, m + 1), repeat=len(coords)):
        term = F.lit(1.0)
        for x, j in zip(coords, js):
            term = term * wave(x, j)
        out.append(term)
    return out


def sine_spectrum(m: int, n_dims: int, ell: float, alpha: float, length: float) -> list[float]:
    """Square root of the squared-exponential spectral density at each basis frequency."""
    out = []
    for js in itertools.product(range(1, m + 1), repeat=n_dims):
        w2 = sum((math.pi * j / (2 * ell)) ** 2 for j in js)
        out.append(alpha * (math.sqrt(2 * math.pi) * length) ** (n_dims / 2) * math.exp(-0.25 * length**2 * w2))
    return out


def basis_field(coords: Sequence[Column], m: int, ell: float, spectrum: Sequence[float], weights: Sequence[float]) -> Column:
    field = F.lit(0.0)
    for phi, s, w in zip(sine_basis(coords, m, ell), spectrum, weights, strict=True):
        field = field + phi * (s * w)
    return field


def sine_index(n_dims: int, order: int) -> list[tuple[tuple[int, int], ...]]:
    """Basis functions of bounded total order over many dims: those whose frequencies j_d >= 1 have sum(j_d - 1) <= order.

    Each is named by its (dim, j) with j > 1; there are C(n_dims + order, order) of them, by order, then by dims and
    frequencies. Dims not named have j = 1.
    """
    out: list[tuple[tuple[int, int], ...]] = []
    for total in range(order + 1):
        level = []
        for dims in itertools.combinations_with_replacement(range(n_dims), total):
            level.append(tuple((d, 1 + dims.count(d)) for d in sorted(set(dims))))
        out += level
    return out


def sine_field(df: DataFrame, vector: str, n_dims: int, order: int, ell: float, spectrum: Callable[[np.ndarray], np.ndarray], weights: Sequence[float], out: str = "f", unit: bool = False) -> DataFrame:
    """``df`` and the sum of weight x spectrum(sum of squared frequencies) x function over the functions of ``sine_index``.

    A function is the product over all dims of sqrt(1/ell) sin(pi j (x + ell) / (2 ell)); with ``unit`` without the roots, since
    over many dims their product leaves the range of doubles. A function is the product of all first waves times, for each of its few
    dims with j > 1, the ratio of two waves; blocks of rows and functions bound the memory of a batch. Vectors that are
    missing, shorter or not finite give no value.
    """
    index = sine_index(n_dims, order)
    if len(weights) != len(index):
        raise ValueError(f"{len(index)} functions, {len(weights)} weights")
    squares = np.array([sum(j * j - 1 for _, j in f) + n_dims for f in index], float) * (math.pi / (2 * ell)) ** 2
    scaled = np.asarray(weights, float) * spectrum(squares)
    width = max((len(f) for f in index), default=0)
    # every function as a product of ``width`` waves; (0, 1) at the end stands for the ratio 1
    dims = np.array([[d for d, _ in f] + [n_dims] * (width - len(f)) for f in index], np.int64).reshape(len(index), width)
    waves = np.array([[j for _, j in f] + [1] * (width - len(f)) for f in index], np.int64).reshape(len(index), width)
    root = 1.0 if unit else ell ** (-n_dims / 2)

    def evaluate(x: np.ndarray) -> np.ndarray:
        theta = math.pi * (x + ell) / (2 * ell)
        # sin(j t) / sin(t) by its recurrence, so a dim where sin(t) = 0 does no harm
        ratio = np.ones((order + 2, n_dims + 1, len(x)))
        if order:
            ratio[2, :n_dims] = 2 * np.cos(theta.T)
        for j in range(3, order + 2):
            ratio[j, :n_dims] = ratio[2, :n_dims] * ratio[j - 1, :n_dims] - ratio[j - 2, :n_dims]
        total = np.zeros(len(x))
        for k in range(0, len(index), SINE_BLOCK):
            part = scaled[k:k + SINE_BLOCK, None]
            for i in range(width):
                part = part * ratio[waves[k:k + SINE_BLOCK, i], dims[k:k + SINE_BLOCK, i]]
            total += part.sum(0)
        return root * np.sin(theta).prod(1) * total

    @F.pandas_udf(T.DoubleType())
    def field(batch: pd.Series) -> pd.Series:
        result = np.full(len(batch), np.nan)
        if len(batch):
            x = np.stack([np.asarray(v, float)[:n_dims] for v in batch])
            for k in range(0, len(x), SINE_ROWS):
                result[k:k + SINE_ROWS] = evaluate(x[k:k + SINE_ROWS])
        return pd.Series(result)

    numbers = F.transform(F.slice(vector, 1, n_dims), lambda x: x.cast("double"))
    usable = F.coalesce((F.size(vector) >= n_dims) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    safe = F.when(usable, numbers).otherwise(F.array_repeat(F.lit(0.0), n_dims))
    return df.withColumn(out, F.when(usable, field(safe)))


def principal_components(df: DataFrame, key: str, vector: str, dims: int, n: int) -> tuple[DataFrame, np.ndarray]:
    """(scores, variance ratios): population-standardised inputs, scores rescaled to unit sd.

    The largest loading of each component is positive.
    """
    cols = [F.get(vector, F.lit(i)) for i in range(dims)]
    stats = df.agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("m"), F.array(*[F.stddev_pop(c) for c in cols]).alias("s")).first()
    mean, sd = vectors.lit_array(stats["m"]), vectors.lit_array([s if s > 0 else 1.0 for s in stats["s"]])
    centred = F.zip_with(F.zip_with(F.col(vector), mean, lambda x, m: x - m), sd, lambda x, s: x / s)
    std = df.select(key, centred.alias("_v"))
    corr = gram_matrix(std, "_v", dims) / stats["n"]
    values, basis = np.linalg.eigh(corr)
    top = np.argsort(values)[::-1][:n]
    basis = basis[:, top] * np.where(basis[np.abs(basis[:, top]).argmax(0), top] < 0, -1.0, 1.0)
    scores = F.array(*[vectors.dot(F.col("_v"), vectors.lit_array(basis[:, i] / math.sqrt(values[top][i]))) for i in range(n)])
    return std.select(key, scores.alias("pc")), values[top] / values.sum()
