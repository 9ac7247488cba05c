"""Iterative solvers: conjugate gradients, direct inversion in the iterative subspace, canonical polyadic decomposition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lattica.labels import Labels
from lattica.operators.linalg import axpy, scale, vec_multiply
from lattica.plans.nodes import Node, Product
from lattica.plans.planner import evaluate
from lattica.sources.shared import settled
from lattica.tensor import DENSE, Tensor, from_numpy


def _names(x: Tensor) -> str:
    return ",".join(f"x{k}" for k in range(x.rank))


def _settled(x: Tensor) -> Tensor:
    """Cut the lineage that each iteration adds to."""
    return Tensor(settled(x.df), x.trange, x.policy, x.inner)


def _dot(x: Tensor, y: Tensor) -> float:
    return x[_names(x)].dot(y[_names(y)])


def conjugate_gradient(a: Callable[[Tensor], Tensor], b: Tensor, x: Tensor, preconditioner: Tensor, target: float | None = None) -> Tensor:
    """Solve a(x) = b with a diagonal preconditioner (divided by, element by element).

    Converged when the residual's norm per element is below the target; after as many iterations as
    there are elements without that, ArithmeticError.
    """
    size = b.trange.elements.volume
    names = _names(b)
    if target is None:
        target = 1e-15 * preconditioner[names].abs_max() / max(preconditioner[names].abs_min(), 1e-300)
    from lattica.operators.foreach import map_elements

    inverse = map_elements(preconditioner, lambda v: 1 / v)
    r = axpy(b, -1.0, a(x))
    z = vec_multiply(inverse, r)
    p, rz = z, _dot(z, r)
    for _ in range(size + 1):
        if np.sqrt(max(_dot(r, r), 0.0)) / size < target:
            return x
        ap = a(p)
        alpha = rz / _dot(p, ap)
        x, r = _settled(axpy(x, alpha, p)), _settled(axpy(r, -alpha, ap))
        z = vec_multiply(inverse, r)
        new = _dot(z, r)
        p, rz = _settled(axpy(z, new / rz, p)), new
    if np.sqrt(max(_dot(r, r), 0.0)) / size < max(target, 1e-12):
        return x
    raise ArithmeticError("no convergence")


class Diis:
    """Extrapolates from the last vectors so that the combination of their errors is smallest.

    start: iterations after this one extrapolate. keep: vectors kept. damp: added to the error
    matrix's diagonal, as a share. group, group_diis: of each group of iterations the first group_diis
    extrapolate, the others return the vector as it came. mix: the share of earlier results that is
    blended into the vectors they came from; the newest vector has no result yet and counts as its own.
    attenuate: once the error's norm is below this, damping shrinks in proportion to the norm.
    """

    def __init__(self, start: int = 1, keep: int = 5, damp: float = 0.0, group: int = 1, group_diis: int = 1, mix: float = 0.0, attenuate: float = 0.0):
        if group < 1 or not 0 <= mix <= 1:
            raise ValueError("a group has iterations, and a share is between 0 and 1")
        self.start, self.keep, self.damp, self.group, self.group_diis = start, keep, damp, group, group_diis
        self.mix, self.attenuate = mix, attenuate
        self.vectors: list[Tensor] = []
        self.errors: list[Tensor] = []
        self.results: list[Tensor] = []
        self.iteration = 0
        self.matrix = np.zeros((0, 0))

    def extrapolate(self, x: Tensor, error: Tensor) -> Tensor:
        self.iteration += 1
        self.vectors.append(x)
        self.errors.append(error)
        grown = np.zeros((len(self.errors),) * 2)
        grown[:-1, :-1] = self.matrix
        for k, e in enumerate(self.errors):
            grown[k, -1] = grown[-1, k] = _dot(e, error)
        self.matrix = grown
        while len(self.vectors) > self.keep:
            self._drop()
        late = self.iteration - self.start
        out = self._combined() if late > 0 and late % self.group < self.group_diis else x
        if self.mix:
            self.results.append(out)
        return out

    def _combined(self) -> Tensor:
        """The vectors with the best coefficients; the oldest go while the errors are almost dependent."""
        while len(self.vectors) > 1 and (c := self._coefficients()) is None:
            self._drop()
        if len(self.vectors) == 1:
            return self.vectors[0]
        parts = list(zip(c, self.vectors))
        if self.mix:
            blended = [*self.results, self.vectors[-1]]
            parts = [((1 - self.mix) * f, v) for f, v in parts] + [(self.mix * f, v) for f, v in zip(c, blended)]
        out = scale(parts[0][1], parts[0][0])
        for f, v in parts[1:]:
            out = axpy(out, f, v)
        return _settled(out)

    def _drop(self) -> None:
        del self.vectors[0], self.errors[0]
        if self.results:
            del self.results[0]
        self.matrix = self.matrix[1:, 1:]

    def _coefficients(self) -> np.ndarray | None:
        n = len(self.vectors)
        b = self.matrix / max(np.abs(self.matrix).max(), 1e-300)
        norm = np.sqrt(max(self.matrix[-1, -1], 0.0))
        damp = self.damp * min(1.0, norm / self.attenuate) if self.attenuate else self.damp
        b = b + np.diag(np.diag(b)) * damp
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = b
        system[n, :n] = system[:n, n] = -1
        if abs(np.linalg.det(system)) < 1e-15:
            return None
        right = np.zeros(n + 1)
        right[n] = -1
        return np.linalg.solve(system, right)[:n]


def pseudo_inverse(m: np.ndarray, cutoff: float = 1e-12) -> np.ndarray:
    u, s, vh = np.linalg.svd(m)
    keep = s > cutoff * (s[0] if len(s) else 1)
    return (vh[keep].conj().T / s[keep]) @ u[:, keep].conj().T


def cholesky_inverse(m: np.ndarray) -> np.ndarray:
    """The inverse of a Hermitian matrix by its Cholesky factor; of one that isn't positive definite, by LU."""
    try:
        low = np.linalg.inv(np.linalg.cholesky(m))
    except np.linalg.LinAlgError:
        return np.linalg.inv(m)
    return low.conj().T @ low


def normalize_factor(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of length one, and the lengths they had; columns of zeros stay."""
    lengths = np.linalg.norm(f, axis=0)
    return f / np.where(lengths > 0, lengths, 1), lengths


class Cp:
    """Canonical polyadic decomposition by alternating least squares.

    ridge: how much a factor is held to its value before (regularised least squares), which lets
    tensors converge whose factors are almost parallel; 0 is the plain method.

    The large products (tensor with all factors but one) are contractions in Spark; the factors, of
    extent x rank, and their rank x rank Gram matrices are on the driver.
    """

    def __init__(self, t: Tensor, seed: int = 0, ridge: float = 0.0):
        if ridge < 0:
            raise ValueError("a ridge is not negative")
        self.tensor, self.rng, self.ridge = t, np.random.default_rng(seed), ridge
        self.factors: list[np.ndarray] = []
        self.weights = np.zeros(0)
        self.norm = t[_names(t)].norm()
        self.fit = 0.0

    def _product(self, mode: int) -> np.ndarray:
        t = self.tensor
        names = [f"x{k}" for k in range(t.rank)]
        tree: Node = t[",".join(names)]
        for k in range(t.rank):
            if k != mode:
                f = from_numpy(t.spark, self.factors[k])
                f.trange = type(t.trange)((t.trange.modes[k], f.trange.modes[1]))
                f.policy = t.policy
                tree = Product(tree, f[f"x{k},r"])
        return evaluate(tree, Labels((f"x{mode}", "r"))).to_numpy()

    def compute_rank(self, rank: int, tolerance: float = 1e-3, iterations: int = 100) -> float:
        """Returns the relative error that is left."""
        t = self.tensor
        self.factors = [self.rng.uniform(-1, 1, (e, rank)) for e in t.extents]
        self.factors = [normalize_factor(f)[0] for f in self.factors]
        self.weights = np.ones(rank)
        before, still = 0.0, 0
        for _ in range(iterations):
            for k in range(t.rank):
                gram = np.ones((rank, rank))
                for m, f in enumerate(self.factors):
                    if m != k:
                        gram *= f.T @ f
                product = self._product(k)
                if self.ridge:
                    held = product + self.ridge * self.factors[k] * self.weights
                    f = held @ cholesky_inverse(gram + self.ridge * np.eye(rank))
                else:
                    f = product @ pseudo_inverse(gram)
                self.factors[k], self.weights = normalize_factor(f)
            grams = np.ones((rank, rank))
            for f in self.factors:
                grams *= f.T @ f
            model = self.weights @ grams @ self.weights
            cross = float((product * self.factors[-1] * self.weights).sum())
            left = max(0.0, self.norm**2 + model - 2 * cross)
            self.fit = 1 - np.sqrt(left) / self.norm if self.norm else 1.0
            still = still + 1 if abs(self.fit - before) < tolerance else 0
            before = self.fit
            if still == 2:
                break
        return 1 - self.fit

    def compute_error(self, error: float, most: int, tolerance: float = 1e-3) -> float:
        """Grow the rank until the relative error is at most this."""
        left = 1.0
        for rank in range(1, most + 1):
            left = self.compute_rank(rank, tolerance)
            if left <= error:
                break
        return left

    def get_factor_matrices(self) -> list[Tensor]:
        return [from_numpy(self.tensor.spark, f, policy=DENSE) for f in self.factors]

    def reconstruct(self) -> Tensor:
        return reconstruct([f * self.weights if k == 0 else f for k, f in enumerate(self.factors)], self.tensor)


def reconstruct(factors: list[np.ndarray], like: Tensor) -> Tensor:
    """The sum of outer products of the factors' columns, as a chain of products in Spark."""
    spark = like.spark
    names = [f"x{k}" for k in range(len(factors))]
    tree: Node | None = None
    for k, f in enumerate(factors):
        t = from_numpy(spark, f)[f"x{k},r"]
        tree = t if tree is None else Product(tree, t)
    return evaluate(tree, Labels(names))
