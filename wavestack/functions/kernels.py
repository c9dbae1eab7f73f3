"""Numerical kernels (numpy) for the few estimators that columns cannot express. All are pure functions."""

from __future__ import annotations

import numpy as np

from ..errors import TravelTimeError


# ---------------------------------------------------------------- filters


def butterworth(corners: int, low: float | None, high: float | None, rate: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a Butterworth band-, high- or low-pass by the bilinear transform."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    k = np.arange(1, corners + 1)
    poles = np.exp(1j * np.pi * (2 * k + corners - 1) / (2 * corners))
    if low and high:
        w0, bw = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        analog, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(corners, complex), bw**corners
    elif low:
        analog, zeros, gain = warp(low) / poles, np.zeros(corners, complex), 1.0
    else:
        analog, zeros, gain = warp(high) * poles, np.zeros(0, complex), warp(high) ** corners
    digital = (2 * rate + analog) / (2 * rate - analog)
    z = np.concatenate([(2 * rate + zeros) / (2 * rate - zeros), -np.ones(len(analog) - len(zeros))]).real
    gain = (gain * np.prod(2 * rate - zeros) / np.prod(2 * rate - analog)).real
    up = sorted([p for p in digital if p.imag > 1e-12], key=abs)
    real = sorted(p.real for p in digital if abs(p.imag) <= 1e-12)
    groups = [(p, np.conj(p)) for p in up] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    z = sorted(z)
    out = []
    for i, group in enumerate(groups):
        take = [z.pop(0 if j % 2 else -1) for j in range(len(group))]
        b, a = np.poly(take).real, np.poly(group).real
        out.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    sections = np.array(out)
    sections[0, :3] *= gain
    return sections


BLOCK = 64


def _section(coefficients: np.ndarray, x: np.ndarray, steady: bool) -> np.ndarray:
    """One second-order section along the last axis, ``BLOCK`` samples at a time.

    The filter is linear in its two state values and its input, so what a block adds to its own output and to the
    state are two matrix products for all blocks and rows at once; only the states go from block to block.
    """
    b0, b1, b2, a0, a1, a2 = (float(v) for v in coefficients)
    b0, b1, b2, a1, a2 = b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0
    move, enter = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(move @ powers[-1])
    reply = np.array([b0] + [(powers[k] @ enter)[0] for k in range(BLOCK - 1)])  # to a single sample
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    own = np.where(lag >= 0, reply[np.maximum(lag, 0)], 0.0)
    shown = np.array([powers[k][0] for k in range(BLOCK)])
    kept = np.array([powers[BLOCK - 1 - k] @ enter for k in range(BLOCK)])
    rows, n = x.shape
    blocks = -(-n // BLOCK)
    padded = np.zeros((rows, blocks * BLOCK))
    padded[:, :n] = x
    padded = padded.reshape(rows, blocks, BLOCK)
    out, gain = padded @ own.T, padded @ kept
    state = np.zeros((rows, 2))
    if steady and n:
        level = (b0 + b1 + b2) / (1 + a1 + a2)
        state = np.stack([b1 - a1 * level + b2 - a2 * level, np.full((), b2 - a2 * level)]) * x[:, :1]
    states = np.empty((rows, blocks, 2))
    for k in range(blocks):
        states[:, k] = state
        state = state @ powers[BLOCK].T + gain[:, k]
    return (out + states @ shown.T).reshape(rows, -1)[:, :n]


def sos_filter(sections: np.ndarray, x: np.ndarray, steady: bool = False) -> np.ndarray:
    """Cascade of second-order sections along the last axis; ``steady`` starts as if the first value had always been there."""
    x = np.asarray(x, float)
    out = np.atleast_2d(x)
    for coefficients in sections:
        out = _section(coefficients, out, steady)
    return out.reshape(x.shape)


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward."""
    return sos_filter(sections, sos_filter(sections, x)[..., ::-1])[..., ::-1]


def recursive_sta_lta(x: np.ndarray, nsta: int, nlta: int) -> np.ndarray:
    """Ratio of exponential averages that start at the second sample; the first ``nlta`` values are 1."""
    x = np.array(x, float)
    if not x.shape[-1]:
        return x
    x[..., 0] = 0.0
    sta, lta = (sos_filter(np.array([[1.0 / n, 0.0, 0.0, 1.0, 1.0 / n - 1, 0.0]]), x) for n in (nsta, nlta))
    out = np.where(lta < 2.2e-308, 1.0, sta / np.where(lta < 2.2e-308, 1.0, lta))
    out[..., :nlta] = 1.0
    return out


def section_gain(sections: np.ndarray, frequency: float, rate: float) -> float:
    z = np.exp(-2j * np.pi * frequency / rate * np.arange(3))
    return float(np.abs(np.prod((sections[:, :3] @ z) / (sections[:, 3:] @ z))))


def detrend(x: np.ndarray) -> np.ndarray:
    """Less the least-squares line, along the last axis."""
    n = x.shape[-1]
    if not n:
        return x
    level = x - x.mean(-1, keepdims=True)
    if n < 2:
        return level
    t = np.arange(n) - (n - 1) / 2
    return level - (x @ t)[..., None] * t / (t @ t)


def cosine_taper(n: int, share: float = 0.05) -> np.ndarray:
    """Cosine edges of ``share`` of the length at either end."""
    edge = int(n * share + 0.5)
    out = np.ones(n)
    if edge > 1:
        ramp = 0.5 * (1 - np.cos(np.pi * np.arange(edge) / (edge - 1)))
        out[:edge], out[n - edge :] = ramp, ramp[::-1]
    return out


def refine(x: np.ndarray, factor: int) -> np.ndarray:
    """Linear interpolation at ``factor`` times the rate, from the first sample to the last."""
    n = x.shape[-1]
    at = np.arange(max(0, (n - 1) * factor + 1)) / factor
    low = np.minimum(at.astype(int), max(0, n - 2))
    return x if n < 2 else x[..., low] + (x[..., low + 1] - x[..., low]) * (at - low)


def decimate(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """Anti-alias low-pass (two corners, zero phase) and every k-th sample."""
    k = int(round(rate / to))
    y = detrend(x) * cosine_taper(x.shape[-1])
    return zero_phase(butterworth(2, None, to / 2.000001, rate), y)[..., ::k]


def preprocess(x: np.ndarray, rate: float, band: tuple[float, float, int]) -> np.ndarray:
    """Detrend, taper and zero-phase band-pass."""
    return zero_phase(butterworth(int(band[2]), band[0], band[1], rate), detrend(x) * cosine_taper(x.shape[-1]))


def envelope(x: np.ndarray) -> np.ndarray:
    """Modulus of the analytic signal, along the last axis."""
    n = x.shape[-1]
    if not n:
        return x
    spectrum = np.fft.fft(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * h))


def lanczos_shift(x: np.ndarray, shift: float | np.ndarray, a: int = 20) -> np.ndarray:
    """Samples at places i + shift by Lanczos interpolation along the last axis; one shift, or one for each row."""
    n = x.shape[-1]
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(a - 1, a)], mode="edge") if n else x
    out = np.zeros_like(x)
    for k in range(-a + 1, a + 1):
        d = np.asarray(shift, float) - k
        w = np.sinc(d) * np.sinc(d / a) * (np.abs(d) < a)
        out = out + padded[..., k + a - 1 : k + a - 1 + n] * w[..., None]
    return out


def apply_response(x: np.ndarray, rate: float, remove: dict | None, simulate: dict | None, water_level: float = 60.0) -> np.ndarray:
    """Divide by one poles-and-zeros response (with a water level in dB) and multiply by another."""
    size = x.shape[-1]
    if not size:
        return np.asarray(x, float)
    n = 1 << int(np.ceil(np.log2(max(2, 2 * size))))
    s = 2j * np.pi * np.fft.rfftfreq(n, 1 / rate)

    def curve(r: dict) -> np.ndarray:
        top = np.prod([s - z for z in r["zeros"]], axis=0) if r["zeros"] else np.ones_like(s)
        return r.get("gain", 1.0) * r.get("sensitivity", 1.0) * top / np.prod([s - p for p in r["poles"]], axis=0)

    spectrum = np.fft.rfft(detrend(np.asarray(x, float)) * cosine_taper(size), n)
    if remove:
        h = curve(remove)
        least = np.abs(h).max() * 10 ** (-water_level / 20)
        length = np.maximum(np.abs(h), 1e-300)
        h = np.where(length < least, h / length * least, h)
        spectrum = np.where(np.abs(h) > 0, spectrum / np.where(h == 0, 1, h), 0)
        spectrum[..., 0] = 0
    if simulate:
        spectrum = spectrum * curve(simulate)
    return np.fft.irfft(spectrum, n)[..., :size]


# ---------------------------------------------------------------- picks and amplitudes


def fit_gaussian(t: np.ndarray, y: np.ndarray, start: tuple[float, float, float], rounds: int = 200) -> tuple[float, float, float] | None:
    """Height, mean and width by damped least squares; None if it does not settle."""
    if len(t) < 3 or not np.isfinite(y).all():
        return None
    p, damp = np.array(start, float), 1e-3
    model = lambda q: q[0] * np.exp(-((t - q[1]) ** 2) / (2 * q[2] ** 2))
    cost = ((y - model(p)) ** 2).sum()
    for _ in range(rounds):
        g = np.exp(-((t - p[1]) ** 2) / (2 * p[2] ** 2))
        jac = np.stack([g, p[0] * g * (t - p[1]) / p[2] ** 2, p[0] * g * (t - p[1]) ** 2 / p[2] ** 3], 1)
        hess, grad = jac.T @ jac, jac.T @ (y - model(p))
        try:
            step = np.linalg.solve(hess + damp * np.diag(np.diag(hess) + 1e-12), grad)
        except np.linalg.LinAlgError:
            return None
        new = p + step
        worth = ((y - model(new)) ** 2).sum() if new[2] != 0 else np.inf
        if worth < cost:
            done = np.abs(step).max() < 1e-10 * (1 + np.abs(p).max())
            p, cost, damp = new, worth, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return (float(p[0]), float(p[1]), abs(float(p[2]))) if np.isfinite(p).all() else None


def peak_to_trough(x: np.ndarray, rate: float, prominence: float = 0.0) -> tuple[float, float, float] | None:
    """(half of the largest peak-to-trough in mm for x in m, frequency, time) or None if extrema do not alternate."""
    def peaks(v: np.ndarray) -> np.ndarray:
        # flat tops count once, at their middle
        out, i = [], 1
        while i < len(v) - 1:
            if v[i - 1] < v[i]:
                j = i
                while j < len(v) - 1 and v[j + 1] == v[i]:
                    j += 1
                if j < len(v) - 1 and v[j + 1] < v[i]:
                    out.append((i + j) // 2)
                i = j
            i += 1
        if prominence > 0:
            least = prominence * np.abs(v).max()
            kept = []
            for p in out:
                left, right = p, p
                while left > 0 and v[left - 1] <= v[p]:
                    left -= 1
                while right < len(v) - 1 and v[right + 1] <= v[p]:
                    right += 1
                if v[p] - max(v[left : p + 1].min(), v[p : right + 1].min()) >= least:
                    kept.append(p)
            out = kept
        return np.array(out, int)

    top, low = peaks(x), peaks(-x)
    if not len(top) or not len(low) or abs(len(top) - len(low)) > 1:
        return None
    places = np.concatenate([top, low])
    kind = np.concatenate([np.ones(len(top)), -np.ones(len(low))])[np.argsort(places)]
    places = np.sort(places)
    if (kind[1:] == kind[:-1]).any():
        return None
    full = np.abs(np.diff(x[places]))
    # pairs that begin with the first extremum go before those that begin with the second, on ties
    order = np.concatenate([np.arange(0, len(full), 2), np.arange(1, len(full), 2)])
    best = order[np.argmax(full[order])]
    a, b = places[best], places[best + 1]
    return float(full[best] * 1000 / 2), float(1 / (2 * (b - a) / rate)), float((a + b) / 2 / rate)


# ---------------------------------------------------------------- location


def spline_location(values: np.ndarray, window: int = 5, upscale: int = 10) -> tuple[float, float, float]:
    """Indices of the maximum of a cubic radial-basis interpolant around the largest node.

    A window that crosses an edge, or a maximum more than half a window away, gives the node itself.
    """
    at = np.array(np.unravel_index(np.nanargmax(values), values.shape))
    half = window // 2
    low, high = at - half, at + half
    if (low < 0).any() or (high >= values.shape).any():
        return tuple(map(float, at))
    ijk = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(low, high, strict=True)], indexing="ij"), -1).reshape(-1, 3).astype(float)
    data = values[tuple(ijk.astype(int).T)]
    distance = lambda a, b: np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    try:
        weights = np.linalg.solve(distance(ijk, ijk) ** 3, data)
    except np.linalg.LinAlgError:
        return tuple(map(float, at))
    axes = [np.linspace(a, b, (window - 1) * upscale + 1) for a, b in zip(low, high, strict=True)]
    best, where = -np.inf, at.astype(float)
    for x in axes[0]:  # a plane at a time
        plane = np.stack(np.meshgrid([x], axes[1], axes[2], indexing="ij"), -1).reshape(-1, 3)
        got = distance(plane, ijk) ** 3 @ weights
        k = int(np.argmax(got))
        if got[k] > best:
            best, where = got[k], plane[k]
    return tuple(map(float, where if (np.abs(where - at) <= half).all() else at))


def smooth_3d(values: np.ndarray, sigma: float = 0.8) -> np.ndarray:
    """Two Gaussian convolutions with mirroring in between, scaled to a maximum of 1."""
    grids = np.meshgrid(*[np.arange(n) - (n - 1) / 2 for n in values.shape], indexing="ij")
    kernel = np.exp(-sum(g**2 for g in grids) / (2 * sigma**2))
    full = [2 * n - 1 for n in values.shape]
    middle = tuple(slice((n - 1) // 2, (n - 1) // 2 + n) for n in values.shape)
    spectrum = np.fft.rfftn(kernel, full, (0, 1, 2))
    for _ in range(2):
        values = np.fft.irfftn(np.fft.rfftn(values, full, (0, 1, 2)) * spectrum, full, (0, 1, 2))[middle]
        values = values[::-1, ::-1, ::-1] / np.nanmax(values)
    return values


def gaussian_location(values: np.ndarray, window: int = 7) -> tuple[np.ndarray, np.ndarray] | None:
    """(centre in nodes, widths in nodes along the principal axes) of a Gaussian fitted to -log of the map.

    The map less its mean, in a window around its maximum, is fitted with a quadratic form by least squares; nodes
    that are not above the mean are left out. None if fewer nodes than terms are left.
    """
    at = np.array(np.unravel_index(np.nanargmax(values), values.shape))
    half = (window - 1) // 2
    box = tuple(slice(max(0, a - half), min(n, a + half + 1)) for a, n in zip(at, values.shape, strict=True))
    offset = np.stack(np.meshgrid(*[np.arange(s.start, s.stop) - a for s, a in zip(box, at, strict=True)], indexing="ij"), -1).reshape(-1, 3).astype(float)
    above = (values - np.nanmean(values))[box].ravel()
    offset, above = offset[above > 0], above[above > 0]
    if len(above) < 10:
        return None
    level = -np.log(above)
    x, y, z = offset.T
    terms = np.stack([x * x, y * y, z * z, x * y, x * z, y * z, x, y, z, np.ones_like(x)], 1)
    c = np.linalg.lstsq(terms, level, rcond=None)[0]
    form = np.array([[c[0], c[3] / 2, c[4] / 2], [c[3] / 2, c[1], c[5] / 2], [c[4] / 2, c[5] / 2, c[2]]])
    real = np.array(values.shape) > 1  # an axis of one node has no width to fit
    inner = form[np.ix_(real, real)]
    centre, widths = np.zeros(3), np.zeros(3)
    try:
        centre[real] = np.linalg.solve(-2 * inner, c[6:9][real])
    except np.linalg.LinAlgError:
        return None
    widths[real] = np.sqrt(0.5 / np.clip(np.abs(np.linalg.eigvals(inner).real), 1e-10, None)) / 2
    return at + centre, widths


# ---------------------------------------------------------------- travel times


def sweep_eikonal(speed: np.ndarray, spacing: tuple[float, float, float], source: tuple[int, int, int], rounds: int = 10_000) -> np.ndarray:
    """First arrivals from a node by fast sweeping (eight sweep directions a round) on a 3-D speed grid.

    Sweeps until a round changes no time; times that still change after ``rounds`` rounds are an error.
    """
    nx, ny, nz = speed.shape
    time = np.full((nx + 2, ny + 2, nz + 2), 1e12)
    time[source[0] + 1, source[1] + 1, source[2] + 1] = 0.0
    h = np.array(spacing, float)
    slow = 1.0 / speed
    for _ in range(rounds):
        before = time[1:-1, 1:-1, 1:-1].copy()
        for sx in (1, -1):
            for sy in (1, -1):
                for sz in (1, -1):
                    for level in range(nx + ny + nz - 2):
                        # nodes on one plane i + j + k == level do not depend on each other
                        i = np.arange(max(0, level - (ny - 1) - (nz - 1)), min(nx - 1, level) + 1)
                        ii, jj = np.meshgrid(i, np.arange(ny), indexing="ij")
                        kk = level - ii - jj
                        ok = (kk >= 0) & (kk < nz)
                        a, b, c = ii[ok], jj[ok], kk[ok]
                        a, b, c = (a if sx > 0 else nx - 1 - a), (b if sy > 0 else ny - 1 - b), (c if sz > 0 else nz - 1 - c)
                        p, q, r = a + 1, b + 1, c + 1
                        near = np.stack([np.minimum(time[p - 1, q, r], time[p + 1, q, r]), np.minimum(time[p, q - 1, r], time[p, q + 1, r]), np.minimum(time[p, q, r - 1], time[p, q, r + 1])], 1)
                        order = np.argsort(near, 1)
                        t = np.take_along_axis(near, order, 1)
                        w = (1 / h**2)[order]
                        s = slow[a, b, c]
                        got = t[:, 0] + s / np.sqrt(w[:, 0])
                        for m in (2, 3):
                            sw, st, stt = w[:, :m].sum(1), (w * t)[:, :m].sum(1), (w * t * t)[:, :m].sum(1)
                            root = st**2 - sw * (stt - s**2)
                            new = (st + np.sqrt(np.maximum(root, 0))) / sw
                            use = (got > t[:, m - 1]) & (root >= 0) & (t[:, m - 1] < 1e11)
                            got = np.where(use, new, got)
                        time[p, q, r] = np.minimum(time[p, q, r], got)
        if np.abs(time[1:-1, 1:-1, 1:-1] - before).max() < 1e-9:
            return time[1:-1, 1:-1, 1:-1]
    raise TravelTimeError(f"travel times still change after {rounds} rounds of sweeps")


def vincenty(lat1, lon1, lat2, lon2, rounds: int = 200) -> np.ndarray:
    """Distance in km on the WGS84 ellipsoid by Vincenty's inverse formula, for arrays; nan for near antipodes."""
    lat1, lon1, lat2, lon2 = (np.asarray(v, float) for v in np.broadcast_arrays(lat1, lon1, lat2, lon2))
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(lon2 - lon1)
    lam, settled = span.copy(), np.zeros(span.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            ss = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(ss > 0, ss, 1), 0.0)
            ca2 = 1 - sa**2
            c2m = np.where(ca2 > 0, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(ca2 > 0, ca2, 1), 0.0)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (-1 + 2 * c2m**2)))
            settled = np.abs(new - lam) < 1e-12
            if settled.all():
                break
            lam = new
        uu = ca2 * (a**2 - b**2) / b**2
        big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        d = big_b * ss * (c2m + big_b / 4 * (cs * (-1 + 2 * c2m**2) - big_b / 6 * c2m * (-3 + 4 * ss**2) * (-3 + 4 * c2m**2)))
        return np.where(ss == 0, 0.0, np.where(settled, b * big_a * (sigma - d), np.nan))
