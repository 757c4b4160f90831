"""Dense k x k algebra on the driver; k is the number of states."""

from __future__ import annotations

import numpy as np


def singular_values(a) -> np.ndarray:
    return np.linalg.svd(np.asarray(a, float), compute_uv=False)


def generalised_eigen(op, overlap) -> tuple[np.ndarray, np.ndarray]:
    """Real parts of the eigenvalues of op x = e overlap x, ascending, and the vectors."""
    values, vectors = np.linalg.eig(np.linalg.solve(np.asarray(overlap, float), np.asarray(op, float)))
    order = np.argsort(values.real, kind="stable")
    return values.real[order], vectors.real[:, order]


def inverse(a) -> np.ndarray:
    return np.linalg.inv(np.asarray(a, float))


def inverse_upper_of_lu(a) -> np.ndarray:
    """Inverse of U where a = L U without pivoting and with ones on L's diagonal."""
    u = np.array(a, float)
    n = len(u)
    for k in range(n):
        for i in range(k + 1, n):
            u[i] -= u[i, k] / u[k, k] * u[k]
    return np.linalg.inv(np.triu(u))


def qr(a) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.qr(np.asarray(a, float))


def inverse_r(a) -> np.ndarray:
    """Inverse of R of a QR factorisation; signs are those of Householder reflections."""
    return np.linalg.inv(qr(a)[1])
