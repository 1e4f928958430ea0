"""Inertial features that need whole signals: zero-phase filters and spectra, in Arrow batches of groups.

One group (a window of a session, some thousand samples) is a few numpy arrays; Spark deals the groups out. The Butterworth
design is the bilinear transform of the second-order prototype, the spectrum is Welch's method with Hann windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..schemas import FEATURES_A

# The bands of the spectrum in Hz, named in the features.
#: Samples of a window from which on filters are used.
SETTLES = 15
#: Groups computed side by side, at most, and samples from which on no more are added to them.
SIDE_BY_SIDE, SAMPLES = 4096, 1 << 17
BANDS = (("psd_0_2", 0, 2), ("psd_2_4", 2, 4), ("psd_4_8", 4, 8), ("psd_8_20", 8, 20))


@lru_cache(maxsize=64)
def butterworth(cutoff: float, fs: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Second-order low- or high-pass coefficients (b, a)."""
    k = np.tan(np.pi * cutoff / fs)
    norm = 1 + np.sqrt(2) * k + k * k
    b = np.array([1.0, -2.0, 1.0]) / norm if high else np.array([1.0, 2.0, 1.0]) * k * k / norm
    return b, np.array([1.0, 2 * (k * k - 1) / norm, (1 - np.sqrt(2) * k + k * k) / norm])


def settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of the filter after an endless input of ones."""
    gain = b.sum() / a.sum()
    z2 = b[2] - a[2] * gain
    return np.array([b[1] - a[1] * gain + z2, z2])


@lru_cache(maxsize=64)
def echo(a1: float, a2: float, n: int) -> np.ndarray:
    """The first n values of the answer of 1 / (1 + a1 z + a2 z^2) to an impulse."""
    g = np.zeros(n)
    g[0] = 1.0
    if n > 1:
        g[1] = -a1
    for i in range(2, n):
        g[i] = -a1 * g[i - 1] - a2 * g[i - 2]
        if abs(g[i]) + abs(g[i - 1]) < 1e-18:
            break
    return g


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The filter along the last axis but one of x (..., n, channels) from a starting state: what drives it, convolved with its echo."""
    n = x.shape[-2]
    drive = b[0] * x
    drive[..., 1:, :] += b[1] * x[..., :-1, :]
    drive[..., 2:, :] += b[2] * x[..., :-2, :]
    drive[..., :2, :] += state
    size = 1 << (2 * n - 1).bit_length()
    g = echo(float(a[1]), float(a[2]), 1 << (n - 1).bit_length())[:n]
    return np.fft.irfft(np.fft.rfft(drive, size, axis=-2) * np.fft.rfft(g, size)[:, None], size, axis=-2)[..., :n, :]


def zero_phase(x: np.ndarray, cutoff: float, fs: float, high: bool) -> np.ndarray:
    """Forward and backward with odd extension of 9 samples and settled starting states."""
    b, a = butterworth(cutoff, fs, high)
    pad = 9
    ext = np.concatenate([2 * x[..., :1, :] - x[..., pad:0:-1, :], x, 2 * x[..., -1:, :] - x[..., -2 : -pad - 2 : -1, :]], axis=-2)
    zi = settled(b, a)[:, None]
    y = filtered(b, a, ext, zi * ext[..., :1, :])
    y = filtered(b, a, y[..., ::-1, :], zi * y[..., -1:, :])[..., ::-1, :]
    return y[..., pad:-pad, :]


def gravity_and_linear(acc: np.ndarray, fs: float, cutoff: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    if acc.shape[-2] < SETTLES:
        mean = acc.mean(axis=-2, keepdims=True)
        return np.broadcast_to(mean, acc.shape), acc - mean
    return zero_phase(acc, cutoff, fs, False), zero_phase(acc, cutoff, fs, True)


def chosen(test: np.ndarray, a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    return np.where(test, a, b)[()]


def welch(x: np.ndarray, fs: float | np.ndarray, most: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density along the last axis: Hann windows of min(n, most) samples, half overlapping, means removed."""
    size = min(x.shape[-1], most)
    if size < 1:
        return np.zeros(1), np.zeros(1)
    rate = np.asarray(fs, float)[..., None]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    step = size - size // 2
    starts = np.arange(0, x.shape[-1] - size + 1, step)
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., starts, :]
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=-1, keepdims=True)) * window, axis=-1)) ** 2 / (rate[..., None] * (window**2).sum())
    power[..., 1 : -1 if size % 2 == 0 else None] *= 2
    return np.arange(size // 2 + 1) * (1.0 / (size * (1 / rate))), power.mean(axis=-2)


def spectrum(x: np.ndarray, prefix: str, fs: float | np.ndarray) -> dict[str, np.ndarray]:
    freqs, power = welch(x, fs)
    freqs, total = np.broadcast_to(freqs, power.shape), power.sum(axis=-1)
    flat = total < 1e-12
    p = power / chosen(flat, 1.0, total)[..., None]
    entropy = -np.sum(p * np.log2(p + 1e-12), axis=-1) / np.log2(p.shape[-1]) if p.shape[-1] > 1 else np.zeros(total.shape)
    top = np.take_along_axis(freqs, power.argmax(axis=-1)[..., None], axis=-1)[..., 0]
    bands = {f"{prefix}_{n}": np.where((freqs >= lo) & (freqs < hi), power, 0.0).sum(axis=-1) / chosen(flat, 1.0, total) for n, lo, hi in BANDS}
    return {k: chosen(flat, 0.0, v) for k, v in ({f"{prefix}_dom_freq": top, f"{prefix}_spec_entropy": entropy} | bands).items()}


def moments(x: np.ndarray, prefix: str, full: bool = True) -> dict[str, np.ndarray]:
    keys = ("skew", "kurt", "zcr", "iqr", *(("mean", "std", "rms") if full else ()))
    if not x.shape[-1]:
        return {f"{prefix}_{k}": np.nan for k in keys}
    m, s = x.mean(axis=-1), x.std(axis=-1)
    flat = s < 1e-10
    z = (x - m[..., None]) / chosen(flat, 1.0, s)[..., None]
    q = np.percentile(x, [75, 25], axis=-1)
    values = [chosen(flat, 0.0, (z**3).mean(axis=-1)), chosen(flat, 0.0, (z**4).mean(axis=-1) - 3), (np.diff(np.sign(x), axis=-1) != 0).sum(axis=-1) / x.shape[-1], q[0] - q[1], m, s, np.sqrt((x * x).mean(axis=-1))]
    return {f"{prefix}_{k}": v for k, v in zip(keys, values, strict=False)}


def entropy(p: np.ndarray, n: int) -> np.ndarray:
    return -(p * np.log2(p + 1e-12)).sum(axis=-1) / np.log2(n)


def by_value(x: np.ndarray, bins: int = 10) -> np.ndarray:
    if x.shape[-1] < 2:
        return np.zeros(x.shape[:-1])[()]
    low, width = x.min(axis=-1), np.ptp(x, axis=-1)
    flat = width <= 1e-12 * np.maximum(1.0, np.abs(low))  # one value but for rounding: one bin
    at = np.minimum(((x - low[..., None]) * bins / chosen(flat, np.inf, width)[..., None]).astype(int), bins - 1).reshape(-1, x.shape[-1])
    counts = np.bincount((at + bins * np.arange(len(at))[:, None]).reshape(-1), minlength=bins * len(at)).reshape(*x.shape[:-1], bins)
    return entropy(counts / x.shape[-1], bins)


def by_time(x: np.ndarray, parts: int = 10) -> np.ndarray:
    if x.shape[-1] < parts:
        return np.zeros(x.shape[:-1])[()]
    means = np.stack([np.abs(c.mean(axis=-1)) for c in np.array_split(x, parts, axis=-1)], axis=-1) + 1e-12
    p = means / means.sum(axis=-1, keepdims=True)
    return -(p * np.log2(p)).sum(axis=-1) / np.log2(parts)


def correlations(m: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    c = m - m.mean(axis=-2, keepdims=True)
    norm = np.linalg.norm(c, axis=-2)

    def pair(i: int, j: int) -> np.ndarray:
        both = norm[..., i] * norm[..., j]
        return chosen(both >= 1e-10, (c[..., i] * c[..., j]).sum(axis=-1) / chosen(both >= 1e-10, both, 1.0), 0.0)

    return {f"{prefix}_corr_xy": pair(0, 1), f"{prefix}_corr_xz": pair(0, 2), f"{prefix}_corr_yz": pair(1, 2)}


def invariants(m: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    out, n = {}, m.shape[-2]
    if n >= 3:
        c = m - m.mean(axis=-2, keepdims=True)
        e = np.clip(np.linalg.eigvalsh(np.einsum("...ni,...nj->...ij", c, c) / (n - 1))[..., ::-1], 0, None)
        r = e / (e.sum(axis=-1, keepdims=True) + 1e-12)
        a, b, c = (e[..., i] for i in range(3))
        values = (a, b, c, a / (b + 1e-9), (b - c) / (a + 1e-9), c / (a + 1e-9), -(r * np.log(r + 1e-12)).sum(axis=-1))
        out |= zip([f"{prefix}_{n}" for n in ("eig1", "eig2", "eig3", "eig_ratio", "eig_planar", "eig_spheric", "eig_entropy")], values, strict=True)
        a, b = m[..., :-1, :], m[..., 1:, :]
        cosine = (a * b).sum(axis=-1) / (np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1) + 1e-9)
        out |= spread(np.arccos(np.clip(cosine, -1, 1)), f"{prefix}_angle")
    if n >= 4:
        out |= spread(np.linalg.norm(np.diff(m, n=2, axis=-2), axis=-1), f"{prefix}_d2v")
    return out


def spread(x: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    q = np.percentile(x, [25, 75, 95], axis=-1)
    return {f"{prefix}_mean": x.mean(axis=-1), f"{prefix}_std": x.std(axis=-1), f"{prefix}_iqr": q[1] - q[0], f"{prefix}_p95": q[2]}


def autocorrelation(x: np.ndarray, lag: int) -> np.ndarray | float:
    n = x.shape[-1]
    if n <= 100 or lag >= n:
        return np.nan
    c = x - x.mean(axis=-1, keepdims=True)
    var = (c * c).sum(axis=-1)
    return chosen(var > 1e-12, (c[..., : n - lag] * c[..., lag:]).sum(axis=-1) / chosen(var > 1e-12, var, 1.0), 0.0)


def inertial(acc: np.ndarray, gyr: np.ndarray, fs: float | np.ndarray, lin: np.ndarray | None = None, grav: np.ndarray | None = None, mag: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The 188 A features of one window (samples, axes), or of many windows of equally many samples (windows, samples, axes),
    whose rates may differ below SETTLES samples; missing ones are absent from the result."""
    if not acc.shape[-2]:
        return {}
    if lin is None or grav is None:
        g, line = gravity_and_linear(acc, fs)
        grav, lin = g if grav is None else grav, line if lin is None else lin
    s = acc.std(axis=-2, keepdims=True)
    z = np.where(s > 1e-6, (acc - acc.mean(axis=-2, keepdims=True)) / np.where(s > 1e-6, s, 1), acc)
    length = lambda m: np.sqrt((m * m).sum(axis=-1))
    acc_mag, gyr_mag, lin_mag = length(z), length(gyr), length(lin)
    out: dict[str, np.ndarray] = {}
    for x, name, full, ent in [(acc_mag, "A_acc_mag", True, True), *[(z[..., i], f"A_acc_{a}", False, False) for i, a in enumerate("xyz")], (gyr_mag, "A_gyr_mag", True, True), *[(gyr[..., i], f"A_gyr_{a}", True, False) for i, a in enumerate("xyz")], (lin_mag, "A_lin_mag", True, True), (length(np.diff(z, axis=-2)) * np.asarray(fs)[..., None], "A_jerk", True, False)]:
        out |= moments(x, name, full) | (spectrum(x, name, fs) if x.shape[-1] else {})
        if ent:
            out |= {f"{name}_val_ent": by_value(x), f"{name}_time_ent": by_time(x)}
    p25, p75 = np.percentile(acc_mag, [25, 75], axis=-1)
    out |= {"A_acc_mag_p25": p25, "A_acc_mag_p75": p75, "A_acc_mag_ptp": np.ptp(acc_mag, axis=-1), "A_acc_sma": np.abs(z).sum(axis=-1).mean(axis=-1), "A_gyr_sma": np.abs(gyr).sum(axis=-1).mean(axis=-1)}
    out |= correlations(z, "A_acc") | correlations(gyr, "A_gyr") | invariants(z, "A_acc") | invariants(gyr, "A_gyr")
    for x, a in [*[(grav[..., i], a) for i, a in enumerate("xyz")], (length(grav), "mag")]:
        out |= {f"A_grav_{a}_mean": x.mean(axis=-1), f"A_grav_{a}_std": x.std(axis=-1)}
    out["A_gyr_acc_ratio"] = gyr_mag.mean(axis=-1) / (acc_mag.mean(axis=-1) + 1e-6)
    lag = float(np.max(fs))  # one rate, where there are samples enough for a lag
    out |= {"A_acc_autocorr_05s": autocorrelation(acc_mag, int(0.5 * lag)), "A_acc_autocorr_1s": autocorrelation(acc_mag, int(lag))}
    if mag is not None and mag.shape[-2]:
        m = length(mag)
        bands = spectrum(m, "A_mag_mag", fs)
        out |= {"A_mag_mag_mean": m.mean(axis=-1), "A_mag_mag_std": m.std(axis=-1), "A_mag_mag_val_ent": by_value(m)} | correlations(mag, "A_mag") | {k: bands[k] for k in ("A_mag_mag_psd_0_2", "A_mag_mag_psd_2_4", "A_mag_mag_psd_4_8")}
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys (not null), from batches sorted by them; one group is held at a time."""
    held: list[pa.Table] = []  # of the open group, joined once it is whole
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            column = table.column(k).combine_chunks()
            new |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        if held and any(held[-1].column(k)[0] != table.column(k)[0] for k in keys):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def features(samples: DataFrame, keys: list[str], fs: str | float = 50.0, columns: list[str] | None = None, tie: str = "event_id") -> DataFrame:
    """keys and the A features (or some) of each group of samples; fs is a rate or the name of a column that holds it.

    Groups are dealt and sorted by Spark and walked in Arrow batches; groups of equally many samples are computed
    side by side, as the fixed cost of the many steps is far above that of a few samples.
    """
    wanted = columns or FEATURES_A
    has = set(samples.columns)
    axes = {p: [f"{p}_{a}" for a in "xyz"] for p in ("acc", "gyr", "lin_acc", "grav", "mag") if {f"{p}_{a}" for a in "xyz"} <= has}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[pa.Table] = []
        alike: dict[tuple, list[tuple[int, float, dict[str, np.ndarray]]]] = {}  # groups of equally many samples
        held = 0

        def out() -> pa.RecordBatch:
            named, values = pa.concat_tables(heads).combine_chunks(), np.full((len(heads), len(wanted)), np.nan)
            for groups in alike.values():
                at, rates = [g[0] for g in groups], np.array([g[1] for g in groups])
                arrays = {p: np.stack([g[2][p] for g in groups]) for p in axes}
                got = inertial(arrays["acc"], arrays["gyr"], rates if arrays["acc"].shape[1] < SETTLES else rates[0], arrays.get("lin_acc"), arrays.get("grav"), arrays.get("mag"))
                for c, name in enumerate(wanted):
                    if name in got:
                        values[at, c] = got[name]
            heads.clear()
            alike.clear()
            return pa.RecordBatch.from_arrays([named.column(k).chunk(0) for k in keys] + [pa.array(values[:, c], from_pandas=True) for c in range(len(wanted))], [*keys, *wanted])

        for group in sorted_groups(batches, keys):
            rate = float(group.column(fs)[0].as_py()) if isinstance(fs, str) else fs
            arrays = {p: np.stack([group.column(c).to_numpy().astype(float) for c in cs], axis=1) for p, cs in axes.items()}
            n = group.num_rows
            alike.setdefault((n, rate if n >= SETTLES else 0), []).append((len(heads), rate, arrays))
            heads.append(group.select(keys).slice(0, 1))
            held += n
            if len(heads) == SIDE_BY_SIDE or held >= SAMPLES:
                held = 0
                yield out()
        if heads:
            yield out()

    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    used = [*keys, "timestamp", tie, *([fs] if isinstance(fs, str) else []), *[c for a in axes.values() for c in a]]
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes but much work stay dealt out
    dealt = samples.select(*dict.fromkeys(used)).repartition(n, *keys).sortWithinPartitions(*keys, "timestamp", tie)
    return dealt.mapInArrow(run, f"{kinds}, {', '.join(f'{c} double' for c in wanted)}")
