"""Closed forms on small matrices: M-step, likelihood, coefficients. NumPy, one model at a time."""

from __future__ import annotations

import numpy as np

STATS = ("xx", "xdx", "dxdx", "bkx", "bkdx", "bkbk")


def shapes(d: int, m: int, k: int) -> dict[str, tuple[int, int]]:
    n = d + m
    return {"xx": (n, n), "xdx": (n, n), "dxdx": (n, n), "bkx": (k, n), "bkdx": (k, n), "bkbk": (k, k)}


def as_matrices(row: dict, d: int, m: int, k: int) -> dict[str, np.ndarray]:
    return {s: np.asarray(row[s], float).reshape(shape) for s, shape in shapes(d, m, k).items()}


def _residual(s: dict, friction: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Second moment of dz + F z - P f b, symmetric; lift = P f."""
    fx, pd, px = friction @ s["xdx"], lift @ s["bkdx"], friction @ (lift @ s["bkx"]).T
    out = s["dxdx"] + fx + fx.T - pd - pd.T + friction @ s["xx"] @ friction.T - px - px.T + lift @ s["bkbk"] @ lift.T
    return 0.5 * (out + out.T)


def _lift(force: np.ndarray, n: int, dt: float) -> np.ndarray:
    out = np.zeros((n, force.shape[1]))
    out[: len(force)] = dt * force
    return out


def m_step(s: dict, d: int, dt: float, force: np.ndarray, diffusion: np.ndarray | None, variant: str = "force_visible", optimize_force: bool = True, optimize_diffusion: bool = True):
    """friction F, force f and noise S that fit the statistics best."""
    n = len(s["xx"])
    if variant == "force_visible":
        if optimize_force:
            xx, xdx, bkx, bkdx = s["xx"][:d, :d], s["xdx"][:d, :d], s["bkx"][:, :d], s["bkdx"][:, :d]
            solved = np.linalg.solve(xx, bkx.T)
            # least squares: bases whose elements depend on each other have many solutions
            force = np.linalg.lstsq((dt * (s["bkbk"] - bkx @ solved)).T, bkdx - (xdx.T @ solved).T, rcond=None)[0].T
        friction = -np.linalg.solve(s["xx"].T, (s["xdx"].T - _lift(force, n, dt) @ s["bkx"]).T).T
    elif variant == "joint":
        inverse = np.linalg.pinv(s["bkbk"])
        yx = s["xdx"].T - s["bkdx"].T @ inverse @ s["bkx"]
        friction = -np.linalg.solve((s["xx"] - s["bkx"].T @ inverse @ s["bkx"]).T, yx.T).T
        if optimize_force:
            force = ((s["bkdx"].T + friction @ s["bkx"].T) @ inverse / dt)[:d]
    else:
        raise ValueError(f"unknown variant {variant}")
    if optimize_diffusion or diffusion is None:
        diffusion = _residual(s, friction, _lift(force, n, dt))
    return friction, force, diffusion


def log_likelihood(s: dict, friction: np.ndarray, force: np.ndarray, noise: np.ndarray, dt: float, entropy: float = 0.0) -> float:
    n = len(noise)
    sign, logdet = np.linalg.slogdet(noise)
    if sign <= 0:
        return float("nan")
    moment = _residual(s, friction, _lift(force, n, dt))
    return float(-0.5 * np.trace(np.linalg.solve(noise, moment)) - 0.5 * (n * np.log(2 * np.pi) + logdet) + entropy)


def lyapunov(friction: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """C with F C + C F' = S."""
    n, one = len(friction), np.eye(len(friction))
    return np.linalg.solve(np.kron(friction, one) + np.kron(one, friction), noise.ravel()).reshape(n, n)


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, Taylor series and squaring; of one matrix, or of each of a stack."""
    norm = np.abs(a).sum(axis=-1).max() if a.size else 0.0
    s = max(0, int(np.ceil(np.log2(norm))) + 2) if norm > 0 else 0
    b = a / 2.0**s
    out = term = np.broadcast_to(np.eye(a.shape[-1], dtype=a.dtype), a.shape)
    for i in range(1, 20):
        term = term @ b / i
        out = out + term
    for _ in range(s):
        out = out @ out
    return out
