"""Whitened principal components by FEAST contour integration.

Entries become integers, so sums and the covariance's numerators are exact.  The covariance over
the different vectors is gathered as sums of products per task; what comes to the driver is the
square of the width.  Its leading eigenpairs are then found without a full decomposition:

inertia     The signs of the pivots of a symmetric factorisation (Bunch-Parlett) of the shifted
            covariance count the eigenvalues above the shift.  Bisection by that count cuts the
            spectrum into intervals of at most ``IN_INTERVAL`` eigenvalues, from the top, until
            the wanted components are covered.
contour     Each interval is a task of its own.  A circle around it carries ``NODES``
            Gauss-Legendre nodes; complex solves of the shifted covariance at the nodes, summed with
            their weights, project a random block onto the interval's eigenvectors.
Ritz        Rayleigh-Ritz in the projected block gives eigenpairs; projection and Ritz step are
            repeated until residuals stop falling.  The number found in the interval must be
            the difference of the inertia counts at its ends, else the block grows and the search
            begins anew; a task that never gets there fails the job, so none is ever missed.

Vectors are projected where they are read.  The error of the whitened covariance against the
identity is measured over the different vectors in a pass of its own.

Null, empty and repeated: rows whose vector is null or holds null, non-finite or (as integers)
too large entries are dropped, repeated ones are kept but count once in what is fitted; vectors
of each length are a population of their own, with its own n, sums and components; components
without variance (as with one vector, or constant or dependent dimensions) and those of empty
vectors do not exist, so such vectors give no rows; equal eigenvalues leave their components
free within their space, which the fixed seed decides; a null vec_id stays null; an empty table
gives no row; other columns are ignored.  ``deviation`` is exact and null beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.llm.common import settled

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
# |64 c| + OFFSET and what is summed of it stay well within 64 bits.
LARGEST = float(1 << 52)
IN_INTERVAL, NODES, ROUNDS, TRIES, SEED = 8, 8, 40, 6, 3
EXACT = 1 << 62


class Spectrum(NamedTuple):
    """What a population needs for its projection."""
    n: int
    sums: list[int]
    components: np.ndarray  # a column each, unit length
    values: np.ndarray      # falling
    trace: float


# --- integers ---------------------------------------------------------------------------------

def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector as integers, of the rows that have one."""
    entry = F.col("embedding").cast("array<double>")
    sound = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST / SCALE))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entry.alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & sound).select(
        "vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + OFFSET).alias("x"))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places of its rows, their integers as a matrix)."""
    column = batch.column("x")
    widths = column.value_lengths().to_numpy()
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        flat = column.take(pa.array(at)).flatten().to_numpy()
        yield width, at, flat.reshape(-1, width)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each width the number of vectors and their exact sums; width numbers each come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for width, at, x in _by_width(batch):
                held = totals.setdefault(width, [0] * (width + 1))
                for place, value in enumerate([len(at), *x.sum(0).tolist()]):
                    held[place] += value
        for width, held in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * len(held), pa.int32()),
                 pa.array(range(len(held)), pa.int32()),
                 pa.array(list(map(Decimal, held)), pa.decimal128(38, 0))],
                names=["width", "place", "value"])

    rows = fit.mapInArrow(run, "width int, place int, value decimal(38,0)").groupBy(
        "width", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[int, list[int]] = {}
    for row in rows:
        out.setdefault(row.width, [0] * (row.width + 1))[row.place] = int(row.value)
    return {width: (held[0], held[1:]) for width, held in out.items()}


def _products(fit: DataFrame, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each width the sums of products of the vectors' distances from a whole mean.

    Distances are whole numbers; while their products' sums are below 2**53 the sums are exact,
    beyond that they are as good as double precision.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _by_width(batch):
                y = (x - means[width]).astype(np.float64)
                totals[width] = totals.get(width, 0) + y.T @ y
        for width, total in totals.items():
            for line in range(width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(width - line, width, dtype=np.int32)),
                     pa.array(line * width + np.arange(line, width)),
                     pa.array(total[line, line:])], names=["width", "place", "value"])

    found = fit.mapInArrow(run, "width int, place long, value double").groupBy(
        "width", "place").agg(F.sum("value").alias("value")).toArrow()
    widths, places, values = (found.column(c).to_numpy() for c in ("width", "place", "value"))
    out = {}
    for width in means:
        here = widths == width
        upper = np.zeros(width * width)
        upper[places[here]] = values[here]
        upper = upper.reshape(width, width)
        out[width] = upper + np.triu(upper, 1).T
    return out


def covariance(n: int, sums: list[int], mean: np.ndarray, products: np.ndarray) -> np.ndarray:
    """(n * products - D D') / n**2 in whole numbers, where D are the sums about ``mean``."""
    off = [s - n * int(m) for s, m in zip(sums, mean)]
    out = np.empty_like(products)
    for i, row in enumerate(products.tolist()):
        for j in range(i, len(row)):
            out[i, j] = out[j, i] = (n * int(row[j]) - off[i] * off[j]) / (n * n)
    return out


# --- eigenpairs -------------------------------------------------------------------------------

def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """Sylvester's law: as many as positive pivots of the shifted matrix."""
    a = matrix - shift * np.eye(len(matrix))
    grow = (1 + np.sqrt(17)) / 8
    above = 0
    while len(a):
        lead = np.abs(np.diagonal(a))
        k = int(lead.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if not lead[k] and not off[i, j]:
            break
        chosen = [k] if lead[k] >= grow * off[i, j] else [i, j]
        others = np.setdiff1d(np.arange(len(a)), chosen)
        pivot = a[np.ix_(chosen, chosen)]
        # A pivot of two rows has a negative determinant: one eigenvalue on either side.
        above += 1 if len(chosen) == 2 else int(pivot[0, 0] > 0)
        side = a[np.ix_(others, chosen)]
        a = a[np.ix_(others, others)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return above


def leading_intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top down, together with the wanted eigenvalues or all above 0."""
    size = len(matrix)
    top = float((np.abs(matrix).sum(1)).max()) * (1 + 1e-9)
    if top == 0:
        return []
    least = float(top * size * np.finfo(float).eps)
    total = eigenvalues_above(matrix, least)
    out: list[tuple[float, float, int]] = []
    waiting = [(least, top, total, 0)]  # low, high, above low, above high
    while waiting and sum(c for _, _, c in out) < min(wanted, total):
        low, high, above_low, above_high = waiting.pop()
        count = above_low - above_high
        if not count:
            continue
        # A cluster that no cut divides stays together.
        if count <= IN_INTERVAL or high - low <= 1e-12 * top:
            out.append((low, high, count))
            continue
        middle = (low + high) / 2
        above = eigenvalues_above(matrix, middle)
        waiting += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return out


def in_interval(matrix: np.ndarray, low: float, high: float, count: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of (low, high], by contour integration and Rayleigh-Ritz."""
    size, scale = len(matrix), float(np.abs(matrix).sum(1).max())
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(0.5j * np.pi * (nodes + 1))
    shifts = [(centre + radius * turn) * np.eye(size) - matrix for turn in turns]
    small = 64 * np.finfo(float).eps * scale * np.sqrt(size)
    for attempt in range(TRIES):
        rng = np.random.default_rng([SEED, attempt])
        block = min(size, 2 * count + 4 + 8 * attempt)
        basis = rng.standard_normal((size, block))
        best = None
        for _ in range(ROUNDS):
            # The half circle is enough: the other half adds the conjugate.
            filtered = sum(0.5 * w * np.real(radius * turn * np.linalg.solve(shift, basis))
                           for w, turn, shift in zip(weights, turns, shifts))
            left, singular, _ = np.linalg.svd(filtered, full_matrices=False)
            left = left[:, singular > singular[0] * 1e-13]
            values, inner = np.linalg.eigh(left.T @ matrix @ left)
            vectors = left @ inner
            residuals = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
            inside = (values > low) & (values <= high) & (residuals <= max(small, 1e-6 * radius))
            worst = residuals[inside].max() if inside.any() else np.inf
            if inside.sum() == count and worst <= small and (best is None or worst < best[0] / 2):
                best = worst, values[inside], vectors[:, inside]
            elif best is not None:
                return best[1], best[2]
            basis = vectors
        if best is not None:
            return best[1], best[2]
    raise ArithmeticError(f"{count} eigenvalues in ({low}, {high}] were not all found")


def leading_pairs(spark, matrices: dict[int, np.ndarray], wanted: int
                  ) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(values, vectors) of each matrix, falling: every interval is solved by a task."""
    work = [(key, i, *interval) for key, matrix in matrices.items()
            for i, interval in enumerate(leading_intervals(matrix, wanted))]
    found: dict[int, list[tuple[float, list[float]]]] = {key: [] for key in matrices}
    if work:
        shared = spark.sparkContext.broadcast(matrices)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    values, vectors = in_interval(
                        shared.value[row["width"]], row["low"], row["high"], row["n"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["width"]] * len(values), pa.int32()), pa.array(values),
                         pa.array(list(vectors.T), pa.list_(pa.float64()))],
                        names=["width", "value", "vector"])

        intervals = spark.createDataFrame(
            work, "width int, i int, low double, high double, n int")
        rows = intervals.repartition(len(work), "width", "i").mapInArrow(
            run, "width int, value double, vector array<double>").collect()
        for row in rows:
            found[row.width].append((row.value, row.vector))
        shared.destroy()
    out = {}
    for width, pairs in found.items():
        pairs = sorted(pairs, key=lambda p: -p[0])[:wanted]
        vectors = np.array([v for _, v in pairs]).reshape(len(pairs), width).T
        # Either sign is right; the largest entry is made positive.
        if len(pairs):
            lead = np.abs(vectors).argmax(0)
            vectors = vectors * np.sign(vectors[lead, np.arange(len(pairs))])
        out[width] = np.array([v for v, _ in pairs]), vectors
    return out


# --- projection -------------------------------------------------------------------------------

def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[Decimal | None]]:
    """(n * x - S) / n as doubles, and the exact sums of squares of n * x - S."""
    if int(np.abs(x).max()) * n < EXACT:
        far = n * x - sums.astype(np.int64)
        if int(np.abs(far).max()) ** 2 * x.shape[1] < EXACT:
            squares = (far * far).sum(1).tolist()
        else:
            squares = (far.astype(object) ** 2).sum(1).tolist()
    else:
        far = n * x.astype(object) - sums
        squares = (far ** 2).sum(1).tolist()
    exact = [Decimal(int(s)) if s < 10 ** 38 else None for s in squares]
    return (far / n).astype(np.float64), exact


def spectra(fit: DataFrame, wanted: int = COMPONENTS) -> dict[int, Spectrum]:
    """The leading components of each width, from the different vectors ``fit``."""
    totals = _sums(fit)
    means = {w: np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
             for w, (n, sums) in totals.items()}
    products = _products(fit, means)
    matrices = {w: covariance(*totals[w], means[w], products[w]) for w in totals}
    pairs = leading_pairs(fit.sparkSession, matrices, wanted)
    return {w: Spectrum(*totals[w], pairs[w][1], pairs[w][0], float(np.trace(matrices[w])))
            for w in totals}


def _scores(x: np.ndarray, s: Spectrum) -> tuple[np.ndarray, list[Decimal | None]]:
    centred, exact = _deviations(x, s.n, np.array(s.sums, dtype=object))
    return centred @ s.components / np.sqrt(s.values), exact


def identity_errors(fit: DataFrame, known: dict[int, Spectrum]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, for each width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _by_width(batch):
                w, _ = _scores(x, known[width])
                w = np.hstack([np.ones((len(w), 1)), w])
                totals[width] = totals.get(width, 0) + w.T @ w
        for width, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, width, dtype=np.int32)),
                 pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())],
                names=["width", "place", "value"])

    rows = fit.mapInArrow(run, "width int, place int, value double").groupBy(
        "width", "place").agg(F.sum("value").alias("value")).collect()
    out = {}
    for width, s in known.items():
        side = len(s.values) + 1
        total = np.zeros(side * side)
        for row in rows:
            if row.width == width:
                total[row.place] = row.value
        total = total.reshape(side, side) / s.n
        error = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(side - 1)
        out[width] = float(np.abs(error).max()) if error.size else 0.0
    return out


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error.

    A row for each vector and component (from 1, by falling variance).
    """
    rows = integer_vectors(vectors)
    fit = settled(rows.select("x").distinct(), "different-vectors")
    known = spectra(fit, components)
    errors = identity_errors(fit, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in _by_width(batch):
                s = known[width]
                count = len(s.values)
                if not count:
                    continue
                scores, exact = _scores(x, s)
                per_row = np.repeat(np.arange(len(x)), count)
                many = len(per_row)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at[per_row])),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(many, s.n, dtype=np.int64)),
                    pa.array(exact, pa.decimal128(38, 0)).take(pa.array(per_row)),
                    pa.array(scores.ravel()),
                    pa.array(np.tile(s.values / s.trace, len(x))),
                    pa.array(np.full(many, errors[width]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), "
                                "whitened double, explained double, identity_error double")
