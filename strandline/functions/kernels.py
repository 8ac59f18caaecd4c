"""Small numpy kernels over batches of equally long traces: one row per trace."""

from __future__ import annotations

import numpy as np


def butter(order: int, corners: list[float], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients b, a of a Butterworth filter; corners in half cycles per sample (0 to 1)."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    return _digital(poles, 1.0, corners, kind)


def cheby1(order: int, ripple_db: float, corner: float) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev low-pass with that ripple in the pass band."""
    eps = np.sqrt(10 ** (0.1 * ripple_db) - 1)
    mu = np.arcsinh(1 / eps) / order
    theta = np.pi * np.arange(1 - order, order, 2) / (2 * order)
    poles = -np.sinh(mu + 1j * theta)
    gain = np.prod(-poles).real / (np.sqrt(1 + eps * eps) if order % 2 == 0 else 1)
    return _digital(poles, gain, [corner], "lowpass")


def _digital(poles: np.ndarray, gain: float, corners: list[float], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients b, a of _zeros_poles."""
    zeros, poles, gain = _zeros_poles(poles, gain, corners, kind)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def _zeros_poles(poles: np.ndarray, gain: float, corners: list[float], kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequency transformation of a low-pass prototype without zeros, then the bilinear one."""
    w = 4 * np.tan(np.pi * np.asarray(corners, float) / 2)
    n, zeros = len(poles), np.array([], complex)
    if kind == "lowpass":
        poles, gain = poles * w[0], gain * w[0] ** n
    elif kind == "highpass":
        gain = gain * np.real(1 / np.prod(-poles))
        poles, zeros = w[0] / poles, np.zeros(n)
    else:
        width, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
        if kind == "bandpass":
            half = poles * width / 2
            gain, zeros = gain * width**n, np.zeros(n)
        else:
            gain = gain * np.real(1 / np.prod(-poles))
            half = width / 2 / poles
            zeros = np.concatenate([np.full(n, 1j * centre), np.full(n, -1j * centre)])
        root = np.sqrt(half * half - centre * centre + 0j)
        poles = np.concatenate([half + root, half - root])
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    z = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    return z, (4 + poles) / (4 - poles), gain


def _pairs(roots: np.ndarray) -> list[np.ndarray]:
    """Real polynomials of degree two or less: conjugates together, real roots from both ends."""
    roots = np.asarray(roots, complex)
    upper = roots[roots.imag > 1e-9 * np.maximum(1, np.abs(roots))]
    real = np.sort(roots[np.abs(roots.imag) <= 1e-9 * np.maximum(1, np.abs(roots))].real)
    out = [np.array([1.0, -2 * r.real, abs(r) ** 2]) for r in upper[np.argsort(np.abs(upper))]]
    while len(real):
        own, real = (real[[0, -1]], real[1:-1]) if len(real) > 1 else (real, real[:0])
        out.append(np.pad(np.poly(own), (0, 2 - len(own))))
    return out


def sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Rows (b0, b1, b2, 1, a1, a2) of a cascade of second order; that of a filter of higher order keeps its precision."""
    over, under = _pairs(zeros), _pairs(poles)
    one = np.array([1.0, 0.0, 0.0])
    n = max(len(over), len(under), 1)
    rows = np.array([np.concatenate([over[i] if i < len(over) else one, under[i] if i < len(under) else one]) for i in range(n)])
    rows[0, :3] *= gain
    return rows


def sections_of(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The cascade of a filter that is given by coefficients; leading zeros of b are delays."""
    b, a = np.trim_zeros(np.asarray(b, float), "b") / a[0], np.trim_zeros(np.asarray(a, float), "b") / a[0]
    lead = int(np.flatnonzero(b)[0]) if b.any() else 0
    rows = sections(np.roots(b[lead:]) if b.any() else np.array([]), np.roots(a), float(b[lead]) if b.any() else 0.0)
    for _ in range(lead):
        rows = np.concatenate([rows, [[0.0, 1.0, 0.0, 1.0, 0.0, 0.0]]])
    return rows


def butter_sections(order: int, corners: list[float], kind: str) -> np.ndarray:
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    return sections(*_zeros_poles(poles, 1.0, corners, kind))


def sosfilt(rows: np.ndarray, y: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of samples through a cascade, and its states after them, (rows of samples, 2 x sections)."""
    z = np.zeros((len(y), len(rows), 2)) if state is None else np.array(state, float).reshape(len(y), len(rows), 2)
    for i, r in enumerate(rows):
        y, z[:, i] = _recursive(r[:3], r[3:], np.asarray(y, float), z[:, i])
    return y, z.reshape(len(y), -1)


def firwin(taps: int, corner: float) -> np.ndarray:
    """Low-pass by the window method: Hamming, unit gain at zero."""
    k = np.arange(taps) - (taps - 1) / 2
    h = corner * np.sinc(corner * k) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / max(taps - 1, 1)))
    return h / h.sum()


def equiripple(taps: int, bands: tuple[tuple[float, float], ...], gains: tuple[float, ...], weights: tuple[float, ...], density: int = 16) -> np.ndarray:
    """Symmetric filter of an odd number of taps with the least weighted error over bands, in half cycles per sample (0 to 1).

    Exchange of extremal frequencies: the cosine polynomial that errs by one amount, with alternating signs, at taps // 2 + 2
    frequencies is evaluated in barycentric form; the largest errors, found on a grid and refined between its
    points by parabolas, are the next frequencies, until all are as large as the first to 1e-11 of the gains.
    """
    edges = [f for band in bands for f in band]
    if taps % 2 == 0 or not len(bands) == len(gains) == len(weights) or any(b <= a for a, b in zip(edges, edges[1:])) or edges[0] < 0 or edges[-1] > 1:
        raise ValueError("an odd number of taps and rising bands between 0 and 1, each with gain and weight, are needed")
    half, count = taps // 2, taps // 2 + 2
    total = sum(b - a for a, b in bands)
    sizes = [max(8, int(np.ceil(density * count * (b - a) / total))) for a, b in bands]
    f = np.concatenate([np.linspace(a, b, n) for (a, b), n in zip(bands, sizes)])
    band = np.repeat(np.arange(len(bands)), sizes)
    gain, weight, lo, hi = (np.array(v, float) for v in (gains, weights, [a for a, _ in bands], [b for _, b in bands]))
    at = np.rint(np.linspace(0, len(f) - 1, count)).astype(int)
    pole_f, pole_band = f[at], band[at]
    sign = (-1.0) ** np.arange(count)
    step = np.array([(b - a) / (n - 1) for (a, b), n in zip(bands, sizes)])

    def fitted():
        x = np.cos(np.pi * pole_f)
        d = 2 * (x[:, None] - x)  # doubled, as products of such distances stay near one
        np.fill_diagonal(d, 1.0)
        logs = np.log(np.abs(d)).sum(axis=1)
        c = np.prod(np.sign(d), axis=1) * np.exp(logs.min() - logs)
        delta = (c @ gain[pole_band]) / (c @ (sign / weight[pole_band]))
        y = gain[pole_band] - sign * delta / weight[pole_band]

        def value(at_f):
            gap = np.cos(np.pi * at_f)[:, None] - x
            hit = np.abs(gap) < 1e-15
            r = c / np.where(hit, 1.0, gap)
            plain = (r @ y) / r.sum(axis=1)
            return np.where(hit.any(axis=1), y[hit.argmax(axis=1)], plain)

        return delta, value

    for _ in range(100):
        delta, value = fitted()
        error = lambda q, k: weight[k] * (gain[k] - value(q))
        q, k = np.concatenate([f, pole_f]), np.concatenate([band, pole_band])  # between the grid's points the last frequencies count too
        order = np.argsort(q, kind="stable")
        q, k = q[order], k[order]
        e = error(q, k)
        side, e = np.sign(e), np.abs(e)
        apart = (k[1:] != k[:-1]) | (side[1:] != side[:-1])
        inner = np.concatenate([[True], (e[1:] >= e[:-1]) | apart]) & np.concatenate([(e[:-1] >= e[1:]) | apart, [True]])
        q, k, side = q[inner], k[inner], side[inner]
        h = step[k]
        for _ in range(5):
            a, m, b = np.clip(q - h, lo[k], hi[k]), q, np.clip(q + h, lo[k], hi[k])
            ea, em, eb = (side * error(z, k) for z in (a, m, b))
            bend = (b - m) * (em - ea) + (m - a) * (em - eb)
            move = np.where((bend > 0) & (a < m) & (m < b), ((b - m) ** 2 * (em - ea) - (m - a) ** 2 * (em - eb)) / np.where(bend > 0, 2 * bend, 1.0), 0.0)
            near = np.clip(m - move, a, b)
            choices = np.stack([ea, em, eb, side * error(near, k)])
            q = np.choose(choices.argmax(axis=0), [a, m, b, near])
            h = h / 4
        e = error(q, k)
        runs = np.concatenate([[0], np.cumsum(np.sign(e[1:]) != np.sign(e[:-1]))])
        best = np.array([np.flatnonzero(runs == r)[np.abs(e[runs == r]).argmax()] for r in range(runs[-1] + 1)])
        while len(best) > count:
            ends = np.abs(e[best[[0, -1]]])
            best = best[1:] if ends[0] < ends[1] else best[:-1]
        if len(best) < count:
            raise ValueError("the filter has more taps than these bands can tell apart")
        pole_f, pole_band = q[best], k[best]
        sign = np.sign(e[best])
        if np.abs(e).max() - np.abs(delta) < 1e-11 * max(1.0, np.abs(gain).max()):
            break
    _, value = fitted()
    k = np.arange(half + 1)
    amp = value(2 * k / taps)
    side = (amp[0] + 2 * np.cos(2 * np.pi * np.outer(k, k[1:]) / taps) @ amp[1:]) / taps
    return np.concatenate([side[:0:-1], side])


def lfilter(b: np.ndarray, a: np.ndarray, y: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered rows and the state after them, (rows, taps - 1); all rows, and up to order two all blocks of long ones, go through each sample together."""
    n = max(len(a), len(b))
    b, a = (np.pad(np.asarray(c, float), (0, n - len(c))) / a[0] for c in (b, a))
    z = np.zeros((len(y), n - 1)) if state is None else np.array(state, float)
    if n == 1:
        return y * b[0], z
    if not a[1:].any():  # no feedback: a convolution, with the state at its head
        out = np.apply_along_axis(np.convolve, 1, y, b) if y.size else np.zeros((len(y), y.shape[1] + n - 1))
        out[:, : n - 1] += z[:, : out.shape[1]]
        return out[:, : y.shape[1]], out[:, y.shape[1] :]
    return _recursive(b, a, y, z) if n <= 3 else _samplewise(b, a, y, z)


def _recursive(b: np.ndarray, a: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of order two or less: blocks of a long trace go side by side, so that the loop is as long as a block."""
    block = int(np.sqrt(y.shape[1]))
    return _blocks(b, a, y, z, block) if block >= 32 else _samplewise(b, a, y, z)


def _samplewise(b: np.ndarray, a: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, z = np.empty_like(y, float), z.copy()
    for i in range(y.shape[1]):
        x = y[:, i]
        v = b[0] * x + z[:, 0]
        out[:, i] = v
        z[:, :-1] = z[:, 1:]
        z[:, -1] = 0
        z += np.outer(x, b[1:]) - np.outer(v, a[1:])
    return out, z


def transition(a: np.ndarray) -> np.ndarray:
    """What a filter's state becomes over one sample of zero: states are columns."""
    a = np.asarray(a, float) / a[0]
    out = np.eye(len(a) - 1, k=1)
    out[:, 0] -= a[1:]
    return out


def _blocks(b: np.ndarray, a: np.ndarray, y: np.ndarray, z: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A prefix scan: blocks from rest, their end states summed with doubling strides, then what each start state adds."""
    rows, n = len(y), y.shape[1] // block
    whole = np.asarray(y[:, : n * block], float).reshape(rows * n, block)
    out, ends = _samplewise(b, a, whole, np.zeros((rows * n, len(a) - 1)))
    ends = ends.reshape(rows, n, -1)
    step = transition(a)
    over = np.linalg.matrix_power(step, block)
    ends[:, 0] += z @ over.T
    stride = 1
    while stride < n:
        ends[:, stride:] = ends[:, stride:] + ends[:, :-stride] @ over.T
        over, stride = over @ over, 2 * stride
    starts = np.concatenate([z[:, None], ends[:, :-1]], axis=1)
    fade = np.empty((len(step), block))  # the first entry of the state, sample after sample
    row = np.eye(len(step))[0]
    for i in range(block):
        fade[:, i] = row
        row = row @ step
    out = (out.reshape(rows, n, block) + starts @ fade).reshape(rows, n * block)
    rest, z = _samplewise(b, a, y[:, n * block :], ends[:, -1])
    return np.concatenate([out, rest], axis=1), z


def next_pow2(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def analytic(y: np.ndarray) -> np.ndarray:
    n = y.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(y, axis=1) * h, axis=1)


def envelope(y: np.ndarray, dt: float) -> np.ndarray:
    return np.abs(analytic(y))


def bandpass_fft(y: np.ndarray, dt: float, low: float, high: float) -> np.ndarray:
    f = np.fft.rfftfreq(y.shape[1], dt)
    return np.fft.irfft(np.fft.rfft(y, axis=1) * ((f >= low) & (f <= high)), y.shape[1], axis=1)


def iir(y: np.ndarray, dt: float, kind: str, corners: list[float], order: int = 4, demean: bool = True) -> np.ndarray:
    """Butterworth low-, high-, band-pass or band-stop."""
    return sosfilt(butter_sections(order, [2 * dt * c for c in corners], kind), y - y.mean(axis=1, keepdims=True) if demean else y)[0]


def autocorr(y: np.ndarray, dt: float, n: int) -> np.ndarray:
    """Biased autocorrelation at shifts 0 to n - 1 of the demeaned rows."""
    y = y - y.mean(axis=1, keepdims=True)
    return np.stack([(y[:, : y.shape[1] - k] * y[:, k:]).sum(axis=1) for k in range(n)], axis=1) / y.shape[1]


def yule_walker(y: np.ndarray, order: int) -> np.ndarray:
    """Coefficients of the autoregressive model of each row."""
    r = autocorr(y, 1.0, order + 1)
    i = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    return np.stack([np.linalg.lstsq(row[i], row[1:], rcond=None)[0] for row in r])


def whiten(y: np.ndarray, dt: float, order: int = 6) -> np.ndarray:
    """Prediction error of an autoregressive model."""
    c = yule_walker(y, order)
    out = y - y.mean(axis=1, keepdims=True)
    return np.stack([np.convolve(row, np.concatenate(([1.0], -k)))[: len(row)] for row, k in zip(out, c, strict=True)])


def spectral_whiten(y: np.ndarray, dt: float, width: float, demean: bool = True) -> np.ndarray:
    """Divided by the amplitude spectrum smoothed over a width in Hz."""
    y = y - y.mean(axis=1, keepdims=True) if demean else y
    n = next_pow2(y.shape[1])
    spectrum = np.fft.rfft(y, n, axis=1)
    k = max(1, round(width * n * dt)) | 1
    amplitude = np.abs(spectrum)
    smooth = np.apply_along_axis(lambda r: np.convolve(np.pad(r, k // 2, "edge"), np.ones(k) / k, "valid"), 1, amplitude)
    return np.fft.irfft(spectrum / np.where(smooth > 0, smooth, 1), n, axis=1)[:, : y.shape[1]]


def resample(y: np.ndarray, dt: float, dt_new: float) -> np.ndarray:
    """Fourier resampling to another interval over the same span."""
    n = y.shape[1]
    m = round(n * dt / dt_new)
    spectrum = np.fft.rfft(y, axis=1)
    k = min(n // 2, m // 2) + 1
    out = np.zeros((len(y), m // 2 + 1), complex)
    out[:, :k] = spectrum[:, :k]
    if m > n and n % 2 == 0:
        out[:, n // 2] /= 2  # the highest frequency lies on both sides of the wider spectrum
    return np.fft.irfft(out, m, axis=1) * (m / n)


def transfer(y: np.ndarray, dt: float, response, limits: tuple[float, float, float, float] | None = None, invert: bool = False, tfade: float = 0.0, demean: bool = True) -> np.ndarray:
    """(De)convolution with a function of frequencies in Hz, inside a cosine taper over limits."""
    y = y - y.mean(axis=1, keepdims=True) if demean else y.astype(float)
    n = y.shape[1]
    fade = min(round(tfade / dt), n // 2)
    if fade:
        ramp = 0.5 - 0.5 * np.cos(np.pi * np.arange(fade) / fade)
        y = y.copy()
        y[:, :fade] *= ramp
        y[:, n - fade :] *= ramp[::-1]
    m = next_pow2(n)
    f = np.fft.rfftfreq(m, dt)
    h = np.asarray(response(f), complex)
    if invert:
        h = np.where(np.abs(h) > 0, 1 / np.where(h == 0, 1, h), 0)
    if limits:
        h = h * cosine_window(f, *limits)
    return np.fft.irfft(np.fft.rfft(y, m, axis=1) * h, m, axis=1)[:, :n]


def cosine_window(x: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
    up = np.interp(x, [a, b], [0, 1]) if b > a else (x >= b).astype(float)
    down = np.interp(x, [c, d], [1, 0]) if d > c else (x <= c).astype(float)
    return (0.5 - 0.5 * np.cos(np.pi * up)) * (0.5 - 0.5 * np.cos(np.pi * down))


def recursive_sta_lta(y: np.ndarray, dt: float, tshort: float, tlong: float, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ratio of two exponential averages of the squares, and the averages after the last sample."""
    ks, kl = dt / tshort, dt / tlong
    s = np.zeros((len(y), 2)) if state is None else np.array(state, float)
    out = np.empty_like(y, float)
    for i in range(y.shape[1]):
        e = y[:, i] ** 2
        s[:, 0] += ks * (e - s[:, 0])
        s[:, 1] += kl * (e - s[:, 1])
        out[:, i] = s[:, 0] / np.where(s[:, 1] > 0, s[:, 1], 1)
    return out, s


def peaks(y: np.ndarray, dt: float, threshold: float, tsearch: float, deadtime: float = 0.0) -> tuple[list[int], list[float]]:
    """Crossings above the threshold, each with the largest sample of the next tsearch; none before the last one's dead time ends."""
    n = max(1, int(np.ceil(tsearch / dt)))
    at, values, free = [], [], -np.inf
    for i in np.flatnonzero((y[1:] > threshold) & (y[:-1] <= threshold)) + 1:
        if i * dt < free:
            continue
        k = i + int(np.argmax(y[i : i + n]))
        at.append(int(k))
        values.append(float(y[k]))
        free = k * dt + deadtime
    return at, values


def top_peaks(y: np.ndarray, dt: float, threshold: float, tsearch: float) -> tuple[list[int], list[float]]:
    """The largest sample above the threshold, again and again, each silencing tsearch around it."""
    y, reach = y.copy(), max(1, round(tsearch / dt))
    at, values = [], []
    while y.size and y.max() > threshold:
        k = int(y.argmax())
        at.append(k)
        values.append(float(y[k]))
        y[max(0, k - reach) : k + reach + 1] = -np.inf
    return at, values


def correlate(a: np.ndarray, b: np.ndarray, mode: str = "full", normal: bool = False) -> tuple[np.ndarray, int]:
    """c(k) = sum over j of a[j] b[j + k], and the first k."""
    na, nb = len(a), len(b)
    c = np.correlate(b, a, "full")  # first lag: 1 - na
    first = 1 - na
    if normal:
        c = c / (np.linalg.norm(a) * np.linalg.norm(b) or 1)
    if mode == "valid":
        lo, hi = sorted((0, nb - na))
        return c[lo - first : hi - first + 1], lo
    if mode == "same":
        n = max(na, nb)
        cut = (len(c) - n) // 2
        return c[cut : cut + n], first + cut
    return c, first


def deconvolve(a: np.ndarray, b: np.ndarray, water: float) -> np.ndarray:
    """a divided by b in the spectrum, b's power raised to a share of its largest."""
    n = next_pow2(2 * max(len(a), len(b)))
    fa, fb = np.fft.rfft(a, n), np.fft.rfft(b, n)
    power = np.abs(fb) ** 2
    return np.fft.irfft(fa * fb.conj() / np.maximum(power, water * power.max()), n)[: len(a)]


def stretch(y: np.ndarray, at: np.ndarray, half: int = 32) -> np.ndarray:
    """Samples of each row at fractional places, by a sinc under a Blackman-Nuttall window."""
    whole = np.floor(at).astype(int)
    k = np.arange(-half + 1, half + 1)
    x = at[:, None] - (whole[:, None] + k)
    w = np.clip((x + half) / (2 * half), 0, 1)
    window = 0.3635819 - 0.4891775 * np.cos(2 * np.pi * w) + 0.1365995 * np.cos(4 * np.pi * w) - 0.0106411 * np.cos(6 * np.pi * w)
    weights = np.sinc(x) * window
    index = np.clip(whole[:, None] + k, 0, y.shape[1] - 1)
    return np.einsum("nik,ik->ni", y[:, index], weights)


def delay(a: np.ndarray, b: np.ndarray, dt: float, span: tuple[float, float] = (0.3, 0.45)) -> tuple[float, float, float]:
    """By how many seconds b is later than a: by whole samples from the correlation, then by the median phase slope of a
    band (in parts of the sampling rate). Also the correlation coefficient and the spread of the slopes."""
    c, first = correlate(a - a.mean(), b - b.mean(), "full", normal=True)
    k = first + int(c.argmax())
    x, y = (a[: len(a) - k], b[k:]) if k >= 0 else (a[-k:], b[: len(b) + k])
    n = min(len(x), len(y))
    m = next_pow2(n)
    f = np.fft.rfftfreq(m, dt)
    band = (f > span[0] / dt) & (f < span[1] / dt)
    p, q = np.fft.rfft(x[:n], m)[band], np.fft.rfft(y[:n], m)[band]
    rest = -np.angle(q * p.conj()) / (2 * np.pi * f[band])
    return k * dt + float(np.median(rest)), float(c.max()), float(rest.std())
