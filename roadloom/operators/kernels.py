"""NumPy kernels of the two count models. No Spark here; every random draw comes from a generator that is passed in."""

from __future__ import annotations

import math

import numpy as np


def dirichlet(alpha, rng) -> np.ndarray:
    g = rng.gamma(np.asarray(alpha, float))
    return g / g.sum()


# Jitters here, and below the defaults of priors, noises and sizes, which must agree for like results.
def cholesky(a: np.ndarray, jitters=(0.0, 1e-10, 1e-8, 1e-6, 1e-4)) -> np.ndarray:
    """Lower factor of a symmetrised matrix, with the least jitter that works."""
    a = (a + np.swapaxes(a, -1, -2)) / 2
    for j in jitters:
        try:
            return np.linalg.cholesky(a + j * np.eye(a.shape[-1]))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("not positive definite after jitter")


def safe_cholesky(a: np.ndarray, jitter: float = 1e-8, tries: int = 6) -> np.ndarray:
    """Lower factor of a symmetrised matrix with jitter from the first try on, ten times as much at each of `tries` more."""
    if jitter < 1e-8:
        jitter = 1e-8
    return cholesky(a, tuple(jitter * 10.0**k for k in range(tries + 1)))


def inverse(a: np.ndarray, **options) -> np.ndarray:
    """Inverse of a positive definite matrix by its factor."""
    low = safe_cholesky(a, **options)
    half = np.linalg.solve(low, np.eye(len(low)))
    return half.T @ half


def normal_by_factor(mean: np.ndarray, low: np.ndarray, rng) -> np.ndarray:
    """A draw with a covariance whose lower factor is given."""
    return mean + low @ rng.standard_normal(len(mean))


def normal(mean: np.ndarray, cov: np.ndarray, rng) -> np.ndarray:
    return mean + cholesky(cov) @ rng.standard_normal(len(mean))


def polya_gamma(b, z, rng, terms: int = 80) -> np.ndarray:
    """PG(b, z) draws: a truncated sum of gammas, with the rest of the series added as its mean, so the mean is exact."""
    b, z = np.broadcast_arrays(np.asarray(b, float), np.asarray(z, float))
    k = np.arange(1, terms + 1) - 0.5
    den = k**2 + (z[..., None] / (2 * math.pi)) ** 2
    drawn = (rng.gamma(np.broadcast_to(b[..., None], den.shape)) / den).sum(-1) / (2 * math.pi**2)
    partial = b * (1 / den).sum(-1) / (2 * math.pi**2)
    return np.maximum(drawn + polya_gamma_mean(b, z) - partial, 1e-8)


def polya_gamma_mean(b, z) -> np.ndarray:
    b, z = np.asarray(b, float), np.abs(np.asarray(z, float))
    return np.where(z < 1e-6, b / 4, b / (2 * np.maximum(z, 1e-12)) * np.tanh(z / 2))


def filter_path(y, v, f, m0, c0, w, g=None):
    """Kalman filter of y_t = f_t' theta_t + N(0, v_t), theta_t = G theta_{t-1} + N(0, W).

    Returns filtered means and covariances, predicted ones, and the log-likelihood.
    """
    steps, p = f.shape
    g = np.eye(p) if g is None else g
    m, c = np.empty((steps, p)), np.empty((steps, p, p))
    a, r, log_lik = np.empty((steps, p)), np.empty((steps, p, p)), 0.0
    mean, cov = np.asarray(m0, float), np.asarray(c0, float)
    for t in range(steps):
        a[t], r[t] = g @ mean, g @ cov @ g.T + w
        r[t] = (r[t] + r[t].T) / 2
        rf = r[t] @ f[t]
        q = float(f[t] @ rf + v[t])
        e = float(y[t] - f[t] @ a[t])
        mean, cov = a[t] + rf * (e / q), r[t] - np.outer(rf, rf) / q
        cov = (cov + cov.T) / 2
        m[t], c[t] = mean, cov
        log_lik -= 0.5 * (math.log(2 * math.pi * q) + e * e / q)
    return m, c, a, r, log_lik


def sample_path(m, c, a, r, rng, g=None) -> np.ndarray:
    """Backward draws of the states given a filter's output."""
    steps, p = m.shape
    g = np.eye(p) if g is None else g
    out = np.empty((steps, p))
    out[-1] = normal(m[-1], c[-1], rng)
    for t in range(steps - 2, -1, -1):
        b = np.linalg.solve(r[t + 1], g @ c[t]).T
        out[t] = normal(m[t] + b @ (out[t + 1] - a[t + 1]), c[t] - b @ r[t + 1] @ b.T, rng)
    return out


def prior_path(steps, m0, c0, w, rng, g=None) -> np.ndarray:
    g = np.eye(len(m0)) if g is None else g
    state, out = normal(np.asarray(m0, float), c0, rng), np.empty((steps, len(m0)))
    for t in range(steps):
        state = out[t] = normal(g @ state, w, rng)
    return out


def permutation_accuracy(true: np.ndarray, found: np.ndarray, k: int) -> float:
    """Largest agreement over all maps of labels 0..k-1, by a recurrence over subsets."""
    table = np.zeros((k, k), int)
    np.add.at(table, (found, true), 1)
    best = {0: 0}
    for f in range(k):
        new: dict[int, int] = {}
        for used, s in best.items():
            for t in range(k):
                if not used >> t & 1:
                    new[used | 1 << t] = max(new.get(used | 1 << t, -1), s + int(table[f, t]))
        best = new
    return max(best.values()) / max(1, len(true))


def rand_index(x: np.ndarray, y: np.ndarray) -> float:
    """Adjusted Rand index; 0 where the largest and expected index agree."""
    n, two = len(x), lambda v: (v * (v - 1) / 2).sum()
    if n < 2:
        return float("nan")
    cells = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1].astype(float)
    a, b = (two(np.unique(v, return_counts=True)[1].astype(float)) for v in (x, y))
    expected, most = a * b / (n * (n - 1) / 2), (a + b) / 2
    return 0.0 if most == expected else float((two(cells) - expected) / (most - expected))


def cluster_chain(y, f, k, iters=600, burn=300, alpha=None, m0=None, c0=None, g=None, w=None, r=None, truth=None, relabel=1, seed=0):
    """Gibbs sampler of the mixture of dynamic Poisson clusters on y (edges x T) with design f (T x p).

    A sweep draws every cluster's path given its summed counts (a negative binomial with a large r stands for the
    Poisson, made Gaussian by Polya-Gamma weights), then the labels, then the weights, then orders the clusters by
    mean intensity. Yields a dict a sweep: iter, pi, z, size, eta (K x T), ari, acc (None without truth).
    """
    if not 0 <= burn < iters:
        raise ValueError("0 <= burn < iters")
    y, f = np.asarray(y, float), np.asarray(f, float)
    n, steps = y.shape
    p, rng = f.shape[1], np.random.default_rng(seed)
    alpha = np.ones(k) if alpha is None else np.asarray(alpha, float)
    m0 = np.r_[math.log(y.mean() + 0.1), np.zeros(p - 1)] if m0 is None else m0
    c0 = (np.diag([5.0, 2.0]) if p == 2 else 5 * np.eye(p)) if c0 is None else c0
    w = (np.diag([0.02, 0.005]) if p == 2 else 0.01 * np.eye(p)) if w is None else w
    r = 50 * (y.max() + 3 * math.sqrt(y.max())) if r is None else r
    z, pi = rng.integers(0, k, n), dirichlet(alpha, rng)
    theta = np.stack([prior_path(steps, m0, c0, w, rng, g) for _ in range(k)])

    def order():
        rank = np.argsort(np.exp(np.clip(np.einsum("tp,ktp->kt", f, theta), -30, 30)).mean(1), kind="stable")
        return rank, np.argsort(rank)

    rank, to = order()
    theta, pi, z = theta[rank], pi[rank], to[z]
    for it in range(1, iters + 1):
        size = np.bincount(z, minlength=k)
        sums = np.zeros((k, steps))
        np.add.at(sums, z, y)
        eta = np.einsum("tp,ktp->kt", f, theta)
        for c in range(k):
            if size[c] == 0:
                theta[c] = prior_path(steps, m0, c0, w, rng, g)
                continue
            shift = math.log(size[c]) - math.log(r)
            omega = polya_gamma(r + sums[c], eta[c] + shift, rng)
            work = (sums[c] - r) / (2 * omega) - shift
            m, cc, a, rr, _ = filter_path(work, 1 / omega, f, m0, c0, w, g)
            theta[c] = sample_path(m, cc, a, rr, rng, g)
        eta = np.einsum("tp,ktp->kt", f, theta)
        score = np.log(pi + 1e-16) + y @ eta.T - np.exp(np.minimum(eta, 50)).sum(1)
        score -= score.max(1, keepdims=True)
        prob = np.exp(score)
        z = (prob.cumsum(1) < rng.random(n)[:, None] * prob.sum(1, keepdims=True)).sum(1)
        pi = dirichlet(alpha + np.bincount(z, minlength=k), rng)
        if relabel and it % relabel == 0:
            rank, to = order()
            theta, pi, z = theta[rank], pi[rank], to[z]
        eta = np.einsum("tp,ktp->kt", f, theta)
        known = truth is not None
        yield {"iter": it, "pi": pi, "z": z, "size": np.bincount(z, minlength=k), "eta": eta, "ari": rand_index(truth, z) if known else None, "acc": permutation_accuracy(truth, z, k) if known else None}


def edge_chain(y, x, base, iters=500, burn=250, thin=2, r=None, sd_base=(0.0020, 0.0008), sd_pair=0.0015, shrink=None, mh_sd=0.12, mh_every=2, seed=0):
    """MCMC of one edge of the neighbourhood model: y (T), design x (T x d), the first `base` columns being the baseline.

    Without `shrink` every coefficient is a random walk. With shrink = scales (d - base), coefficient j of a source is
    beta_j lambda_j; ln lambda_j walks by Metropolis steps under a half-Cauchy prior of its scale, with the weights
    drawn at the start of the sweep. Returns kept terminal states, lambdas, the running mean of exp(eta), the
    Gaussian log-likelihoods after burn-in, and the share of accepted moves.
    """
    if not 0 <= burn < iters or thin < 1:
        raise ValueError("0 <= burn < iters and thin >= 1")
    y, x = np.asarray(y, float), np.asarray(x, float)
    steps, d = x.shape
    rng = np.random.default_rng(seed)
    r = math.ceil(50 * (y.max() + 2 * math.sqrt(max(y.max(), 1)))) if r is None else r
    q = d - base
    sd = np.r_[sd_base[0], np.full(base - 1, sd_base[1]), np.full(q, sd_pair)]
    m0 = np.r_[math.log(y.mean() + 0.1), np.zeros(d - 1)]
    c0 = np.diag(np.r_[0.6, np.full(base - 1, 0.35), np.full(q, 0.20 if shrink is None else 0.35)] ** 2)
    lam = np.ones(q) if shrink is None else np.maximum(0.05, np.asarray(shrink, float))
    beta = np.tile(m0, (steps, 1))
    states, lams, logs, mean, kept, tried, taken = [], [], [], np.zeros(steps), 0, 0, 0
    for it in range(1, iters + 1):
        scale = np.r_[np.ones(base), lam]
        eta = (x * scale * beta).sum(1)
        omega = polya_gamma(y + r, eta - math.log(r), rng)
        work = math.log(r) + (y - r) / (2 * omega)
        m, c, a, rr, log_lik = filter_path(work, 1 / omega, x * scale, m0, c0, np.diag(sd**2))
        beta = sample_path(m, c, a, rr, rng)
        eta = (x * scale * beta).sum(1)
        if shrink is not None and it % mh_every == 0:
            for j in range(q):
                new = lam[j] * math.exp(mh_sd * rng.standard_normal())
                moved = eta + x[:, base + j] * beta[:, base + j] * (new - lam[j])
                prior = lambda v, s=shrink[j]: -math.log1p((v / s) ** 2) + math.log(v)
                gain = -0.5 * (omega * ((work - moved) ** 2 - (work - eta) ** 2)).sum() + prior(new) - prior(lam[j])
                tried += 1
                if math.log(rng.random()) < gain:
                    lam[j], eta, taken = new, moved, taken + 1
        if it > burn:
            logs.append(log_lik)
            if (it - burn) % thin == 0:
                states.append(np.r_[beta[-1, :base], beta[-1, base:]])
                lams.append(lam.copy())
                kept += 1
                mean += (np.exp(np.clip(eta, -8, 8)) - mean) / kept
    return {"states": np.array(states), "lambdas": np.array(lams), "mean": mean, "log_lik": np.array(logs), "accepted": taken / max(1, tried)}


class QuantileBooster:
    """Gradient boosting of depth-limited trees under the pinball loss; splits on quantile cuts of each feature."""

    def __init__(self, alpha: float = 0.9, trees: int = 350, rate: float = 0.035, depth: int = 3, cuts: int = 32, least: int = 5):
        self.alpha, self.trees, self.rate, self.depth, self.cuts, self.least = alpha, trees, rate, depth, cuts, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> QuantileBooster:
        x, y = np.asarray(x, float), np.asarray(y, float)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.cuts + 2)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        self.start, self.model = float(np.quantile(y, self.alpha)), []
        at = np.full(len(y), self.start)
        for _ in range(self.trees):
            grad = np.where(y > at, self.alpha, self.alpha - 1)
            tree = self._grow(bins, grad, y - at, np.arange(len(y)), self.depth)
            self.model.append(tree)
            at = at + self.rate * self._apply(tree, bins)
        self.edges = edges
        return self

    def _grow(self, bins, grad, rest, rows, depth):
        best = None
        if depth and len(rows) >= 2 * self.least:
            total, n = grad[rows].sum(), len(rows)
            for j in range(bins.shape[1]):
                b = bins[rows, j]
                s, c = np.bincount(b, grad[rows]).cumsum()[:-1], np.bincount(b).cumsum()[:-1]
                ok = (c >= self.least) & (n - c >= self.least)
                if ok.any():
                    gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1), -np.inf)
                    k = int(gain.argmax())
                    if best is None or gain[k] > best[0] + 1e-12:
                        best = (gain[k], j, k)
            if best is not None and best[0] <= total**2 / n + 1e-12:
                best = None
        if best is None:
            return float(np.quantile(rest[rows], self.alpha))
        _, j, k = best
        left = bins[rows, j] <= k
        return j, k, self._grow(bins, grad, rest, rows[left], depth - 1), self._grow(bins, grad, rest, rows[~left], depth - 1)

    def _apply(self, tree, bins):
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        j, k, a, b = tree
        left, out = bins[:, j] <= k, np.empty(len(bins))
        out[left], out[~left] = self._apply(a, bins[left]), self._apply(b, bins[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, np.asarray(x, float).T, strict=True)], 1)
        return self.start + self.rate * sum(self._apply(t, bins) for t in self.model)
