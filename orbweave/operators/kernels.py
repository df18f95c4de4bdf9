"""Small dense kernels that run on one volume, inside a task, and the DataFrame operators that map them over tables of volumes.

Volumes are cubes of n values a side, flattened with the last axis fastest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Transforms of grids from this side on are gridded, those of smaller ones are exact sums.
GRIDDING_FROM = 24


def map_volumes(volumes: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], out: dict[str, str], column: str = "data", id_name: str = "vol_id") -> DataFrame:
    """id and ``fn``'s outputs for each row; fn gets a stack of cubes (rows, n, n, n) of an Arrow batch, so memory is that of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            n = round((len(flat) / b.num_rows) ** (1 / 3))
            got = fn(flat.reshape(b.num_rows, n, n, n))
            cols = [pa.array(list(v.reshape(b.num_rows, -1))) if v.ndim > 1 else pa.array(v) for v in (got[k] for k in out)]
            yield pa.record_batch([b.column(0), *cols], names=[id_name, *out])

    schema = ", ".join([f"{id_name} long", *(f"{k} {t}" for k, t in out.items())])
    return volumes.select(id_name, column).mapInArrow(run, schema)


def gauss_weights(sigma: float, truncate: float) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


_PAD = {"reflect": "symmetric", "constant": "constant", "wrap": "wrap"}


def gauss(vol: np.ndarray, sigma: float, mode: str, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian over the last three axes. Beyond the edge: mirrored (reflect), zero (constant) or periodic (wrap)."""
    w = gauss_weights(sigma, truncate)
    radius = len(w) // 2
    for axis in (-3, -2, -1):
        pad = [(0, 0)] * vol.ndim
        pad[axis] = (radius, radius)
        wide = np.pad(vol, pad, mode=_PAD[mode])
        n = vol.shape[axis]
        vol = sum(x * np.take(wide, range(i, i + n), axis=axis) for i, x in enumerate(w))
    return vol


def half_frequencies(n: int) -> np.ndarray:
    """Integer positions of a cube's side about its centre: an odd side is symmetric."""
    return np.arange(n) - n // 2


def nufft2(vol: np.ndarray, h: np.ndarray, k: np.ndarray, l: np.ndarray) -> np.ndarray:
    """sum over voxels of v exp(-i (h x + k y + l z)), x, y, z about the centre; exact, axis by axis. Positions in radians."""
    x = half_frequencies(vol.shape[-1])
    out = np.empty(len(h), dtype=np.complex128)
    for a in range(0, len(h), 4096):
        s = slice(a, a + 4096)
        eh, ek, el = (np.exp(-1j * np.outer(p[s], x)) for p in (h, k, l))
        part = np.tensordot(eh, vol, axes=(1, 0))
        out[s] = np.einsum("pyz,py,pz->p", part, ek, el, optimize=True)
    return out


def nufft1(values: np.ndarray, h: np.ndarray, k: np.ndarray, l: np.ndarray, n: int) -> np.ndarray:
    """sum over points of v exp(i (h x + k y + l z)) on a cube of side n; the adjoint of nufft2."""
    x = half_frequencies(n)
    out = np.zeros((n, n, n), dtype=np.complex128)
    for a in range(0, len(h), 1024):
        s = slice(a, a + 1024)
        eh, ek, el = (np.exp(1j * np.outer(p[s], x)) for p in (h, k, l))
        out += np.tensordot(eh * values[s, None], ek[:, :, None] * el[:, None, :], axes=(0, 0))
    return out


class GriddedNufft:
    """Type 1 and 2 transforms for large cubes: spreading with a Gaussian on a grid of twice the side, FFT, and deconvolution
    (Greengard and Lee, 2004). With 14 points each way it agrees with the direct sums to about 1e-9."""

    SPREAD = 14

    def __init__(self, n: int):
        self.n, self.m = n, 2 * n + (2 * n) % 2
        self.tau = math.pi * self.SPREAD / (self.n**2 * 2 * (2 - 0.5))
        x = half_frequencies(n)
        self.undo = np.sqrt(math.pi / self.tau) * np.exp(x * x * self.tau) / self.m

    def _near(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = 2 * math.pi / self.m
        first = np.floor(p / step).astype(np.int64) - self.SPREAD + 1
        at = first[:, None] + np.arange(2 * self.SPREAD)
        return at % self.m, np.exp(-((p[:, None] - at * step) ** 2) / (4 * self.tau))

    def type1(self, values: np.ndarray, h: np.ndarray, k: np.ndarray, l: np.ndarray) -> np.ndarray:
        grid = np.zeros(self.m**3, dtype=np.complex128)
        for a in range(0, len(h), 256):
            s = slice(a, a + 256)
            (ih, wh), (ik, wk), (il, wl) = (self._near(p[s]) for p in (h, k, l))
            at = (ih[:, :, None, None] * self.m + ik[:, None, :, None]) * self.m + il[:, None, None, :]
            w = values[s, None, None, None] * wh[:, :, None, None] * wk[:, None, :, None] * wl[:, None, None, :]
            grid.real += np.bincount(at.ravel(), w.real.ravel(), self.m**3)
            grid.imag += np.bincount(at.ravel(), w.imag.ravel(), self.m**3)
        full = np.fft.fftshift(np.fft.ifftn(grid.reshape((self.m,) * 3))) * self.m**3
        a = self.m // 2 - self.n // 2
        u = self.undo
        return full[a : a + self.n, a : a + self.n, a : a + self.n] * u[:, None, None] * u[:, None] * u

    def type2(self, vol: np.ndarray, h: np.ndarray, k: np.ndarray, l: np.ndarray) -> np.ndarray:
        u, a = self.undo, self.m // 2 - self.n // 2
        full = np.zeros((self.m,) * 3, dtype=np.complex128)
        full[a : a + self.n, a : a + self.n, a : a + self.n] = vol * u[:, None, None] * u[:, None] * u
        grid = np.fft.fftn(np.fft.ifftshift(full))
        out = np.empty(len(h), dtype=np.complex128)
        for b in range(0, len(h), 256):
            s = slice(b, b + 256)
            (ih, wh), (ik, wk), (il, wl) = (self._near(p[s]) for p in (h, k, l))
            part = grid[ih[:, :, None, None], ik[:, None, :, None], il[:, None, None, :]]
            out[s] = np.einsum("pabc,pa,pb,pc->p", part, wh, wk, wl, optimize=True)
        return out


def fourier_reg(vol: np.ndarray, support: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """What a volume within its support has at frequencies outside the sampled ball (``outside`` centred)."""
    f = np.fft.fftn(np.fft.ifftshift(vol * support, axes=(-3, -2, -1)), axes=(-3, -2, -1)) * np.fft.ifftshift(outside)
    return (np.fft.fftshift(np.fft.ifftn(f, axes=(-3, -2, -1)), axes=(-3, -2, -1)) * support).real


def convolve(vol: np.ndarray, kernel_f: np.ndarray, support: np.ndarray) -> np.ndarray:
    """The product of the normal matrix with a volume: its convolution on a grid twice as wide, by the transform of the kernel
    that the positions give, cut to the volume and its support."""
    n, m = vol.shape[-1], kernel_f.shape[-1]
    wide = np.zeros((*vol.shape[:-3], m, m, m), dtype=vol.dtype)
    wide[..., :n, :n, :n] = vol * support
    out = np.fft.ifftn(np.fft.fftn(wide, axes=(-3, -2, -1)) * kernel_f, axes=(-3, -2, -1))
    return out[..., :n, :n, :n].real * support


def conjugate_gradient(apply: Callable[[np.ndarray], np.ndarray], d: np.ndarray, x: np.ndarray, most: int, tolerance: float = 1e-5) -> tuple[np.ndarray, int]:
    r = d - apply(x)
    p, rr, stop = r.copy(), float((r * r).sum()), tolerance * float(np.sqrt((d * d).sum()))
    for i in range(most):
        if rr**0.5 <= stop:
            return x, i
        w = apply(p)
        a = rr / float((p * w).sum())
        x, r = x + a * p, r - a * w
        rr, old = float((r * r).sum()), rr
        p = r + rr / old * p
    return x, most


# Phase retrieval: densities, supports and amplitudes have the origin at index 0 (ifftshifted).

_AXES = (-3, -2, -1)


def impose(rho: np.ndarray, amplitude: np.ndarray, mask: np.ndarray, support: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The density with the given amplitudes where the mask says so, and the part of the support where it is positive."""
    f = np.fft.fftn(rho, axes=_AXES)
    f = np.where(mask, amplitude * np.exp(1j * np.angle(f)), f)
    new = np.fft.ifftn(f, axes=_AXES).real
    return new, support & (new > 0)


def error_reduction(rho, amplitude, mask, support, most=np.inf):
    """The imposed density where it may be, else 0; whatever it has over ``most``, inside the support or not, becomes ``most``."""
    new, good = impose(rho, amplitude, mask, support)
    return np.where(new > most, most, np.where(good, new, 0))


def hybrid(beta, rho, amplitude, mask, support, most=np.inf):
    """The imposed density where it may be, else what it was less a share of the imposed one; over ``most`` that is pushed back further."""
    new, good = impose(rho, amplitude, mask, support)
    out = np.where(good, new, rho - beta * new)
    return np.where(new > most, out + 2 * beta * new - most, out)


def shrink_wrap(rho, method: str = "std", weight: float = 1.0, cutoff: float = 0.05, sigma: float = 1.0) -> np.ndarray:
    size = np.abs(rho)
    smooth = gauss(size, sigma, "wrap", 2.0)
    if method == "std":
        level = smooth.std(axis=_AXES, keepdims=True) * weight
    elif method == "max":
        level = size.max(axis=_AXES, keepdims=True) * cutoff * weight
    else:
        raise ValueError(f"method is 'std' or 'max', not {method!r}")
    return smooth > level


def half_offsets(n: int) -> np.ndarray:
    """Voxel centres of a side in (-1, 1), origin first."""
    edge = np.linspace(-1, 1, n + 1)
    return np.fft.ifftshift((edge[:-1] + edge[1:]) / 2)


def center_of_mass(rho: np.ndarray) -> np.ndarray:
    """Whole voxels from the origin, for each of a stack of densities; halves go to the even side."""
    size, at = np.abs(rho), half_offsets(rho.shape[-1])
    total = size.sum(axis=_AXES)
    axes = [at[:, None, None], at[:, None], at]
    return np.stack([np.round((size * a).sum(axis=_AXES) / total * rho.shape[-1] / 2) for a in axes], axis=-1)


def roll_to_origin(vol: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.stack([np.roll(v, tuple(-int(x) for x in s), (0, 1, 2)) for v, s in zip(vol, shift, strict=True)])


def box_support(ac: np.ndarray, quarter: int) -> np.ndarray:
    """The central box (all but ``quarter`` voxels on each side) where the autocorrelation is over 1 % of its maximum."""
    n = ac.shape[-1]
    box = np.zeros((n, n, n), dtype=bool)
    box[(slice(quarter, n - quarter),) * 3] = True
    return np.fft.ifftshift(box) & (ac > 0.01 * ac.max(axis=_AXES, keepdims=True))


def autocorrelation(rho: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.ifftn(np.abs(np.fft.fftn(rho, axes=_AXES)) ** 2, axes=_AXES))


def phase(ac, support, rho, quarter, loops, n_er, n_hio, beta, method="std", weight=1.0, seed=0, cutoff=0.05, most=np.inf):
    """One phasing run of one centred autocorrelation volume: (centred autocorrelation of the density, support, density)."""
    smooth = np.fft.ifftshift(gauss(np.maximum(ac, 0), 1.0, "constant", 2.0))
    amplitude = np.sqrt(np.abs(np.fft.fftn(smooth)))
    mask = np.ones(ac.shape, dtype=bool)
    mask[0, 0, 0] = False
    support = box_support(smooth, quarter) if support is None else support
    rho = support * np.random.default_rng(seed).random(ac.shape) if rho is None else rho

    def reduce(x):
        for _ in range(n_er):
            x = error_reduction(x, amplitude, mask, support, most)
        return x

    for _ in range(loops):
        rho = reduce(rho)
        for _ in range(n_hio):
            rho = hybrid(beta, rho, amplitude, mask, support, most)
        rho = reduce(rho)
        support = shrink_wrap(rho, method, weight, cutoff)
    rho = reduce(rho)
    if np.abs(rho).sum() > 0:
        shift = center_of_mass(rho[None])
        rho, support = roll_to_origin(rho[None], shift)[0], roll_to_origin(support[None], shift)[0]
    return np.fft.fftshift(autocorrelation(rho)), support, rho


def rotate(vol: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The volume sampled, trilinearly, at its grid turned by the matrix about the voxel n // 2; zero outside."""
    n = vol.shape[-1]
    mid = n // 2
    y, x, z = np.meshgrid(*[np.arange(n) - mid] * 3, indexing="ij")  # the first axis of a volume is y
    at = np.tensordot(matrix, np.stack([x, y, z]), axes=1) + mid
    at = np.stack([at[1], at[0], at[2]])
    low = np.floor(at).astype(int)
    part = at - low
    out = np.zeros(vol.shape)
    for corner in np.ndindex(2, 2, 2):
        p = [low[i] + corner[i] for i in range(3)]
        w = np.prod([part[i] if corner[i] else 1 - part[i] for i in range(3)], axis=0)
        # a point beyond the outermost voxels counts as outside, as its other corners would
        inside = np.all([(at[i] >= 0) & (at[i] <= n - 1) & (p[i] < n) for i in range(3)], axis=0)
        safe = [np.clip(x, 0, n - 1) for x in p]
        out += np.where(inside, w * vol[tuple(safe)], 0)
    return out


def matrix_of(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ])


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic B-spline."""
    x = np.abs(x)
    return np.where(x < 1, 2 / 3 - x * x + x**3 / 2, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))


def spline_matrix(m: int) -> np.ndarray:
    """Coefficients of the cubic spline through m values, mirrored at its ends: a row for each of the places -2 to m + 1."""
    a = np.diag(np.full(m, 2 / 3)) + np.diag(np.full(m - 1, 1 / 6), 1) + np.diag(np.full(m - 1, 1 / 6), -1)
    if m > 1:
        a[0, 1] = a[-1, -2] = 1 / 3
    else:
        a[0, 0] = 1
    k = np.abs(np.arange(-2, m + 2))
    turn = max(1, 2 * (m - 1))
    return np.linalg.inv(a)[np.minimum(k % turn, turn - k % turn) if m > 1 else 0 * k]


def interpolation(m: int, at: np.ndarray, order: int = 3) -> np.ndarray:
    """Weights (places x m) of m values at the places ``at`` (0 is the first value): linear, or by cubic splines. Zero outside."""
    k = np.arange(-2, m + 2)
    if order == 3 and m > 1:
        w = _cubic(at[:, None] - k) @ spline_matrix(m)
    else:
        w = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(m)))
    return np.where(((at >= 0) & (at <= m - 1))[:, None], w, 0.0)


def _along(vol: np.ndarray, axis: int, w: np.ndarray) -> np.ndarray:
    return np.moveaxis(np.tensordot(w, vol, axes=(1, axis)), 0, axis)


def resample(vol: np.ndarray, n: int, order: int = 3) -> np.ndarray:
    """A cube brought to another side by interpolation along each axis, corners kept."""
    for axis in range(3):
        m = vol.shape[axis]
        vol = _along(vol, axis, interpolation(m, np.arange(n) * (m - 1) / max(1, n - 1), order))
    return vol


def to_center_of_mass(vol: np.ndarray, order: int = 3) -> np.ndarray:
    """The volume moved so that its centre of mass lies on voxel n // 2; zero comes in at the edges. A volume without mass stays."""
    n, total = vol.shape[-1], vol.sum()
    if not total:
        return vol
    place = np.arange(n)
    shifts = [float((vol * place.reshape([-1 if a == axis else 1 for a in range(3)])).sum() / total) - n // 2 for axis in range(3)]
    for axis, shift in enumerate(shifts):
        vol = _along(vol, axis, interpolation(n, place + shift, order))
    return vol


def gauss_fit(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float, float]:
    """Height, place and width of a Gaussian through the points, by Levenberg-Marquardt; zeros where it fails."""
    if len(x) < 3 or y.max() <= 0:
        return 0.0, 0.0, 0.0
    a = np.array([y.max(), (x * y).sum() / y.sum(), max(1e-9, np.sqrt(((x - (x * y).sum() / y.sum()) ** 2 * y).sum() / y.sum()))])
    damp = 1e-3

    def model(a):
        return a[0] * np.exp(-((x - a[1]) ** 2) / (2 * (a[2] + 1e-9) ** 2))

    err = ((y - model(a)) ** 2).sum()
    for _ in range(steps):
        e, c = model(a), a[2] + 1e-9
        j = np.stack([e / a[0], e * (x - a[1]) / c**2, e * (x - a[1]) ** 2 / c**3], axis=1)
        m = j.T @ j
        try:
            new = a + np.linalg.solve(m + damp * np.diag(np.diag(m) + 1e-12), j.T @ (y - e))
        except np.linalg.LinAlgError:
            return 0.0, 0.0, 0.0
        got = ((y - model(new)) ** 2).sum()
        if np.isfinite(got) and got < err:
            small = err - got < 1e-12 * err
            a, err, damp = new, got, damp / 3
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(a[0]), float(a[1]), float(a[2])
