"""Nonlinear least squares and the dose-response and enzyme-kinetic models."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Fit:
    """params, their standard errors (None where the data don't determine them), SSR and what went wrong."""

    ok: bool
    params: np.ndarray
    errors: np.ndarray | None
    ssr: float
    n: int
    iterations: int = 0
    refusal: str = ""
    covariance: np.ndarray | None = None
    names: tuple[str, ...] = field(default=())

    @property
    def aicc(self) -> float:
        """Corrected information criterion; infinite where n - k - 1 <= 0."""
        k = len(self.params) + 1
        if self.n - k - 1 <= 0:
            return math.inf
        return self.n * math.log(max(self.ssr, 1e-300) / self.n) + 2 * k + 2 * k * (k + 1) / (self.n - k - 1)


def refused(why: str, n: int = 0) -> Fit:
    return Fit(False, np.zeros(0), None, math.nan, n, refusal=why)


def jacobian(model: Model, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Central differences, with steps in proportion to each parameter."""
    out = np.empty((len(x), len(p)))
    for j in range(len(p)):
        h = 1e-6 * max(abs(p[j]), 1e-4)
        up, down = p.copy(), p.copy()
        up[j] += h
        down[j] -= h
        out[:, j] = (model(x, up) - model(x, down)) / (2 * h)
    return out


def levenberg_marquardt(model: Model, x: np.ndarray, y: np.ndarray, start: np.ndarray, weights: np.ndarray | None = None, max_iterations: int = 200) -> Fit:
    """Damped Gauss-Newton with a scaled diagonal; a rank-deficient end has no error bars.

    weights multiply squared residuals. Damping starts at 1e-3 and moves by factors of ten.
    """
    p = np.asarray(start, float).copy()
    w = np.ones(len(x)) if weights is None else np.sqrt(weights)
    residual = lambda q: (y - model(x, q)) * w
    r = residual(p)
    best, damping, steps = float(r @ r), 1e-3, 0
    for steps in range(1, max_iterations + 1):
        jac = jacobian(model, x, p) * w[:, None]
        gradient, normal = jac.T @ r, jac.T @ jac
        scale = np.where(np.diag(normal) > 0, np.diag(normal), 1.0)
        moved = False
        for _ in range(60):
            try:
                step = np.linalg.solve(normal + damping * np.diag(scale), gradient)
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            with np.errstate(all="ignore"):
                trial = residual(p + step)
                ssr = float(trial @ trial)
            if math.isfinite(ssr) and ssr <= best:
                moved = True
                break
            damping *= 10
        if not moved:
            break
        gain = best - ssr
        p, r, best, damping = p + step, trial, ssr, max(damping / 10, 1e-12)
        if gain <= 1e-14 * max(best, 1e-300) and np.all(np.abs(step) <= 1e-10 * (np.abs(p) + 1e-10)):
            break
    jac = jacobian(model, x, p) * w[:, None]
    norm = np.linalg.norm(jac, axis=0)
    singular = np.linalg.svd(jac / np.where(norm > 0, norm, 1), compute_uv=False)
    free = len(x) - len(p)
    errors = covariance = None
    if free > 0 and len(singular) == len(p) and singular[-1] > 1e-10 * singular[0]:
        covariance = np.linalg.inv(jac.T @ jac) * best / free
        errors = np.sqrt(np.maximum(np.diag(covariance), 0))
    return Fit(True, p, errors, best, len(x), steps, "" if errors is not None else "the data do not determine all parameters", covariance)


def robust(model: Model, x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 30) -> Fit:
    """Reweighted fits with Tukey's biweight at 4.685 robust deviations."""
    got = levenberg_marquardt(model, x, y, start)
    for _ in range(rounds):
        r = y - model(x, got.params)
        scale = 1.4826022185056018 * float(np.median(np.abs(r - np.median(r))))
        if scale <= 0:
            return got
        u = r / (4.685 * scale)
        weights = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0)
        again = levenberg_marquardt(model, x, y, got.params, weights)
        done = np.allclose(again.params, got.params, rtol=1e-9, atol=1e-12)
        got = again
        if done:
            break
    return got


def profile_interval(model: Model, x: np.ndarray, y: np.ndarray, fit: Fit, index: int, quantile: float = 3.841458820694124) -> tuple[float, float]:
    """Profile-likelihood bounds of one parameter: where the refitted SSR has risen by quantile * s^2."""
    limit = fit.ssr + quantile * fit.ssr / max(1, fit.n - len(fit.params))

    def height(value: float) -> float:
        rest = np.delete(fit.params, index)
        part = lambda xs, q: model(xs, np.insert(q, index, value))
        return (levenberg_marquardt(part, x, y, rest).ssr if len(rest) else float(((y - part(x, rest)) ** 2).sum())) - limit

    out = []
    for sign in (-1, 1):
        step = fit.errors[index] if fit.errors is not None and fit.errors[index] > 0 else 0.1 * abs(fit.params[index]) + 1e-6
        far = fit.params[index] + sign * step
        for _ in range(40):
            if height(far) > 0:
                break
            step *= 2
            far = fit.params[index] + sign * step
        else:
            out.append(sign * math.inf)
            continue
        near = fit.params[index]
        for _ in range(60):
            middle = (near + far) / 2
            near, far = (near, middle) if height(middle) > 0 else (middle, far)
        out.append((near + far) / 2)
    return out[0], out[1]


# Models: x is log10 concentration for the logistic curves, concentration for the kinetics.
def logistic4(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b, c, d = p
    return d + (a - d) / (1 + 10 ** np.clip(b * (c - x), -300, 300))


def logistic5(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b, c, d, g = p
    return d + (a - d) / (1 + 10 ** np.clip(b * (c - x), -300, 300)) ** g


def michaelis_menten(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] * s / (p[1] + s)


def hill(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    sn = np.power(s, p[2])
    return p[0] * sn / (np.power(abs(p[1]), p[2]) + sn)


def substrate_inhibition(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] * s / (p[1] + s * (1 + s / p[2]))


def morrison(i: np.ndarray, p: np.ndarray, enzyme: float) -> np.ndarray:
    """Velocity with tight-binding inhibitor: v0 times the free share of the enzyme."""
    v0, ki = p
    t = enzyme + i + ki
    return v0 * (1 - (t - np.sqrt(np.maximum(t * t - 4 * enzyme * i, 0))) / (2 * enzyme))


def fit_4pl(conc: np.ndarray, y: np.ndarray) -> Fit:
    """Four-parameter logistic: top, slope, log10 EC50, bottom. Needs four positive concentrations."""
    conc, y = np.asarray(conc, float), np.asarray(y, float)
    if len(conc) < 4 or len(np.unique(conc)) < 4:
        return refused("fewer than four concentrations", len(conc))
    if (conc <= 0).any():
        return refused("concentrations must be positive", len(conc))
    x = np.log10(conc)
    rising = np.corrcoef(x, y)[0, 1] >= 0 if np.ptp(y) > 0 else True
    start = np.array([y.max(), 1.0 if rising else -1.0, float(np.median(x)), y.min()])
    fit = levenberg_marquardt(logistic4, x, y, start)
    fit.names = ("top", "slope", "log_ec50", "bottom")
    return fit


def fit_5pl(conc: np.ndarray, y: np.ndarray) -> Fit:
    """Asymmetric logistic; needs eight distinct concentrations."""
    conc, y = np.asarray(conc, float), np.asarray(y, float)
    if len(np.unique(conc)) < 8:
        return refused("fewer than eight distinct concentrations", len(conc))
    four = fit_4pl(conc, y)
    if not four.ok:
        return four
    fit = levenberg_marquardt(logistic5, np.log10(conc), y, np.append(four.params, 1.0))
    fit.names = ("top", "slope", "log_c", "bottom", "asymmetry")
    return fit


def ec50_5pl(p: np.ndarray) -> float:
    """Half-height concentration of an asymmetric curve."""
    return 10 ** p[2] * (2 ** (1 / p[4]) - 1) ** (-1 / p[1])


def fit_kinetics(s: np.ndarray, v: np.ndarray, model: str = "michaelis_menten") -> Fit:
    s, v = np.asarray(s, float), np.asarray(v, float)
    k = {"michaelis_menten": 2, "hill": 3, "substrate_inhibition": 3}[model]
    if len(np.unique(s)) <= k:
        return refused(f"{model} needs more than {k} concentrations", len(s))
    if (s < 0).any():
        return refused("concentrations must not be negative", len(s))
    half = float(np.median(s[s > 0])) if (s > 0).any() else 1.0
    start = {"michaelis_menten": [v.max() * 1.2, half], "hill": [v.max() * 1.2, half, 1.0], "substrate_inhibition": [v.max() * 2, half, s.max() * 2]}[model]
    fit = levenberg_marquardt(globals()[model], s, v, np.array(start))
    fit.names = {2: ("vmax", "km"), 3: ("vmax", "km", "n" if model == "hill" else "ki")}[k]
    return fit


def fit_morrison(i: np.ndarray, v: np.ndarray, enzyme: float) -> Fit:
    i, v = np.asarray(i, float), np.asarray(v, float)
    if enzyme <= 0:
        return refused("enzyme concentration is missing", len(i))
    if len(np.unique(i)) < 4:
        return refused("fewer than four concentrations", len(i))
    fit = levenberg_marquardt(lambda x, p: morrison(x, np.array([p[0], math.exp(np.clip(p[1], -60, 60))]), enzyme), i, v, np.array([v.max(), math.log(max(float(np.median(i[i > 0])), 1e-300))]))
    fit.params = np.array([fit.params[0], math.exp(fit.params[1])])
    if fit.errors is not None:
        fit.errors = fit.errors * np.array([1.0, fit.params[1]])
    fit.names = ("v0", "ki")
    return fit


#: What the inhibitor does to Km and Vmax, by mode.
MODALITIES: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    "competitive": lambda s, i, p: p[0] * s / (p[1] * (1 + i / p[2]) + s),
    "noncompetitive": lambda s, i, p: p[0] * s / ((p[1] + s) * (1 + i / p[2])),
    "uncompetitive": lambda s, i, p: p[0] * s / (p[1] + s * (1 + i / p[2])),
    "mixed": lambda s, i, p: p[0] * s / (p[1] * (1 + i / p[2]) + s * (1 + i / p[3])),
}


def fit_modality(s: np.ndarray, i: np.ndarray, v: np.ndarray) -> tuple[str, dict[str, Fit]]:
    """The mode of inhibition with the best corrected criterion; 'unknown' unless it leads by two."""
    s, i, v = (np.asarray(a, float) for a in (s, i, v))
    if len(np.unique(i)) < 2 or len(np.unique(s)) < 3:
        return "unknown", {}
    base = fit_kinetics(s[i == i.min()], v[i == i.min()])
    vmax, km = base.params if base.ok and base.params.size else (v.max() * 1.2, float(np.median(s)))
    guess = float(np.median(i[i > 0]))
    fits = {}
    for name, law in MODALITIES.items():
        start = np.array([vmax, max(km, 1e-12), guess] + [guess] * (name == "mixed"))
        rows = np.arange(len(v))
        fits[name] = levenberg_marquardt(lambda idx, p, law=law: law(s[idx.astype(int)], i[idx.astype(int)], np.abs(p) + 1e-300), rows.astype(float), v, start)
        fits[name].ssr = max(fits[name].ssr, 1e-24 * float(v @ v))
        fits[name].params = np.abs(fits[name].params)
    order = sorted(fits, key=lambda n: fits[n].aicc)
    return (order[0] if fits[order[1]].aicc - fits[order[0]].aicc >= 2 else "unknown"), fits


def inverse_predict(fit: Fit, y: float) -> tuple[float, float] | None:
    """Concentration that gives y on a four-parameter curve, and its standard error in log10 units; None outside the plateaus."""
    top, slope, c, bottom = fit.params
    share = (y - bottom) / (top - bottom) if top != bottom else math.nan
    if not 0 < share < 1:
        return None
    at = lambda p: p[2] - math.log10((p[0] - p[3]) / (y - p[3]) - 1) / p[1]
    x = at(fit.params)
    if fit.covariance is None:
        return 10**x, math.nan
    grad = np.array([(at(fit.params + d) - at(fit.params - d)) / (2 * d.sum()) for d in np.diag(1e-6 * np.maximum(np.abs(fit.params), 1e-4))])
    return 10**x, float(math.sqrt(max(grad @ fit.covariance @ grad, 0.0)))


def arrhenius(t: np.ndarray, k: np.ndarray) -> Fit:
    """ln A and the activation energy (kJ/mol) from rates at absolute temperatures; three temperatures at least."""
    t, k = np.asarray(t, float), np.asarray(k, float)
    if len(np.unique(t)) < 3:
        return refused("fewer than three temperatures", len(t))
    if (k <= 0).any() or (t <= 0).any():
        return refused("rates and temperatures must be positive", len(t))
    fit = levenberg_marquardt(lambda x, p: p[0] - p[1] * x, 1 / (8.314462618e-3 * t), np.log(k), np.array([20.0, 50.0]))
    fit.names = ("ln_a", "ea_kj")
    return fit


def eyring(t: np.ndarray, k: np.ndarray) -> Fit:
    """Activation enthalpy (kJ/mol) and entropy (J/mol/K)."""
    t, k = np.asarray(t, float), np.asarray(k, float)
    if len(np.unique(t)) < 3:
        return refused("fewer than three temperatures", len(t))
    y = np.log(k / t) - math.log(1.380649e-23 / 6.62607015e-34)
    fit = levenberg_marquardt(lambda x, p: p[1] / 8.314462618 - p[0] * 1000 / 8.314462618 * x, 1 / t, y, np.array([50.0, 0.0]))
    fit.names = ("dh_kj", "ds_j")
    return fit


def two_state_melt(t: np.ndarray, y: np.ndarray) -> Fit:
    """Boltzmann melt: folded and unfolded levels, Tm and slope."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    if len(t) < 8:
        return refused("fewer than eight temperatures", len(t))
    rise = np.gradient(y, t)
    start = np.array([y[0], y[-1], float(t[np.argmax(np.abs(rise))]), max(np.ptp(t) / 20, 1e-3)])
    fit = levenberg_marquardt(lambda x, p: p[0] + (p[1] - p[0]) / (1 + np.exp(np.clip((p[2] - x) / p[3], -300, 300))), t, y, start)
    fit.names = ("folded", "unfolded", "tm", "slope")
    return fit


def langmuir(t: np.ndarray, response: np.ndarray, conc: np.ndarray, stop: float) -> Fit:
    """Global 1:1 kinetics: ka, kd and Rmax from association until stop and dissociation after it."""
    t, response, conc = (np.asarray(a, float) for a in (t, response, conc))
    if len(np.unique(conc)) < 2:
        return refused("fewer than two concentrations", len(t))

    def model(idx: np.ndarray, p: np.ndarray) -> np.ndarray:
        ka, kd, top = 10 ** p[0], 10 ** p[1], p[2]
        i = idx.astype(int)
        rate = ka * conc[i] + kd
        level = top * ka * conc[i] / rate
        on = level * -np.expm1(-rate * np.minimum(t[i], stop))
        return on * np.exp(-kd * np.maximum(t[i] - stop, 0))

    fit = levenberg_marquardt(model, np.arange(len(t)).astype(float), response, np.array([5.0, -3.0, response.max() * 1.2]))
    fit.names = ("log_ka", "log_kd", "rmax")
    return fit


def wiseman(injections: np.ndarray, heats: np.ndarray, cell: float, volume_ratio: float) -> Fit:
    """1:1 titration heats: sites n, log10 K and enthalpy from titrant/cell ratios at each injection."""
    x, q = np.asarray(injections, float), np.asarray(heats, float)
    if len(x) < 6:
        return refused("fewer than six injections", len(x))

    def model(ratio: np.ndarray, p: np.ndarray) -> np.ndarray:
        n, k, dh = p[0], 10 ** np.clip(p[1], 0, 14), p[2]
        r = 1 / (k * cell)
        bound = lambda z: (n + z + r - np.sqrt(np.maximum((n + z + r) ** 2 - 4 * n * z, 0))) / 2
        return dh * (bound(ratio) - bound(np.maximum(ratio - volume_ratio, 0)))

    fit = levenberg_marquardt(model, x, q, np.array([1.0, 6.0, q[0] / max(volume_ratio, 1e-12)]))
    fit.names = ("n", "log_k", "dh")
    return fit
