"""Kalman and interacting-multiple-model tracking of voyages, smoothing, and filter-based forecasts.

The filters are true recursions, so a voyage stays in one Python task; voyages are independent and spread over the cluster
by their id. A task takes some thousand fixes of whole voyages at a time and runs them in step: fix k of all its voyages is
one set of NumPy operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import KNOT_MS, np_enu, np_latlon
from wakeline.functions.stats import chi2_2

SILENCE_S = 300.0
OUTLIER_DENSITY = 5.0e-11  # floor of the likelihood that candidates are compared by


@dataclass(frozen=True)
class CvParameters:
    q: float = 3.0e-5  # white-noise acceleration density, m2/s3
    r_m: float = 5.0
    gate: float = 0.9999
    most_rejects: int = 2
    gap_q: float = 0.0  # extra process noise for steps longer than gap_s
    gap_s: float = 180.0


@dataclass(frozen=True)
class ImmParameters:
    r_m: float = 1.5
    q_stationary: float = 1.0e-4
    tau_s: float = 30.0
    q_cruise: float = 1.0e-4
    q_turn: float = 0.02
    q_omega: float = 2.0e-8
    sojourn_s: tuple[float, ...] = (1800.0, 600.0, 300.0)
    clutter: float = 5.0e-11  # outliers per m2
    most_rejects: int = 2
    gap_q: float = 0.0  # extra process noise of every mode for steps longer than gap_s
    gap_s: float = 180.0
    switch: tuple[tuple[float, ...], ...] = ((0.0, 0.7, 0.3), (0.3, 0.0, 0.7), (0.2, 0.8, 0.0))


def cv_step(dt: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Transition and process noise of the state (e, n, ve, vn)."""
    f, n = cv_steps(np.array([dt]), np.array([q]))
    return f[0], n[0]


def cv_steps(dt: np.ndarray, q: np.ndarray, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    f, n = np.tile(np.eye(size), (len(dt), 1, 1)), np.zeros((len(dt), size, size))
    for i in (0, 1):
        f[:, i, i + 2] = dt
        n[:, i, i], n[:, i + 2, i + 2] = q * dt**3 / 3, q * dt
        n[:, i, i + 2] = n[:, i + 2, i] = q * dt**2 / 2
    return f, n


@dataclass
class Track:
    """States of one track, or of several side by side (first axis)."""

    x: np.ndarray
    p: np.ndarray
    nis: np.ndarray
    accepted: np.ndarray
    restart: np.ndarray
    loglik: np.ndarray
    f: np.ndarray
    x_pred: np.ndarray
    p_pred: np.ndarray
    mu: np.ndarray | None = None
    mode_x: np.ndarray | None = None
    mode_p: np.ndarray | None = None

    def one(self, i: int, n: int) -> Track:
        return Track(*(None if v is None else v[i, :n] for v in vars(self).values()))


def _empty(v: int, n: int, size: int) -> Track:
    m = lambda *shape: np.zeros((v, n, *shape))
    return Track(m(size), m(size, size), np.full((v, n), np.nan), np.ones((v, n), bool), np.zeros((v, n), bool), np.full((v, n), np.nan), m(size, size), m(size), m(size, size))


def _start_velocity(vel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reported velocity with a spread of 0.5 m/s; without one, zero and 5 m/s."""
    known = np.isfinite(vel).all(-1)
    return np.where(known[:, None], np.nan_to_num(vel), 0.0), np.where(known, 0.25, 25.0)


def _inverse(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and determinants of 2x2 matrices."""
    det = s[..., 0, 0] * s[..., 1, 1] - s[..., 0, 1] * s[..., 1, 0]
    inv = np.empty_like(s)
    inv[..., 0, 0], inv[..., 1, 1], inv[..., 0, 1], inv[..., 1, 0] = s[..., 1, 1], s[..., 0, 0], -s[..., 0, 1], -s[..., 1, 0]
    return inv / det[..., None, None], det


def _innovation(x: np.ndarray, p: np.ndarray, z: np.ndarray, r2: float):
    """Residual, inverse covariance, squared distance and log density of fixes; any leading axes."""
    inv, det = _inverse(p[..., :2, :2] + r2 * np.eye(2))
    v = z - x[..., :2]
    d2 = np.einsum("...i,...ij,...j->...", v, inv, v)
    return v, inv, d2, -0.5 * (d2 + np.log(det)) - math.log(2 * math.pi)


def _update(x: np.ndarray, p: np.ndarray, v: np.ndarray, inv: np.ndarray, r2: float) -> tuple[np.ndarray, np.ndarray]:
    """Joseph form."""
    gain = p[..., :, :2] @ inv
    a = np.broadcast_to(np.eye(x.shape[-1]), p.shape).copy()
    a[..., :, :2] -= gain
    return x + (gain @ v[..., None])[..., 0], a @ p @ a.swapaxes(-1, -2) + r2 * gain @ gain.swapaxes(-1, -2)


def _diagonal(r2: float, var: np.ndarray, size: int) -> np.ndarray:
    p = np.zeros((len(var), size, size))
    p[:, 0, 0] = p[:, 1, 1] = r2
    p[:, 2, 2] = p[:, 3, 3] = var
    if size == 5:
        p[:, 4, 4] = 1e-6
    return p


def _restarts(t, z, vel, k, m, late, twice, r_m):
    """Velocity and variance with which tracks start again: as reported after a silence, else between the last two fixes."""
    v, var = _start_velocity(vel[:m, k])
    dt = t[:m, k] - t[:m, k - 1]
    between = (z[:m, k] - z[:m, k - 1]) / dt[:, None]
    return np.where(late[:, None], v, between), np.where(late, var, 2 * r_m**2 / dt**2 + 0.05), late | twice


def _prepared(t, z, vel, n):
    """Tracks by falling length, as arrays of (track, fix), and their number that still runs at each fix."""
    n = np.asarray(n)
    for row, size in zip(t, n):
        if (np.diff(row[:size]) <= 0).any():
            raise ValueError("times must increase")
    order = np.argsort(-n, kind="stable")
    return order, t[order], z[order], vel[order], n[order]


def run_cv_batch(t: np.ndarray, z: np.ndarray, vel: np.ndarray, n: np.ndarray, prm: CvParameters = CvParameters()) -> Track:
    """Constant-velocity filter with a gate, for many tracks in step: t (V, T), z and vel (V, T, 2), lengths n.

    For each fix, in this order: a repeated coordinate only predicts; an innovation inside the gate updates; the first
    fix after a long silence restarts; otherwise the track coasts, and after `most_rejects` rejections in a row restarts
    with the velocity between the last two fixes.
    """
    order, t, z, vel, n = _prepared(t, z, vel, n)
    out, r2, limit = _empty(*t.shape, 4), prm.r_m**2, chi2_2(prm.gate)
    v0, var = _start_velocity(vel[:, 0])
    x, p = np.concatenate([z[:, 0], v0], 1), _diagonal(r2, var, 4)
    rejects = np.zeros(len(t), int)
    out.restart[:, 0] = True
    out.x[:, 0], out.p[:, 0], out.f[:, 0], out.x_pred[:, 0], out.p_pred[:, 0] = x, p, np.eye(4), x, p
    for k in range(1, t.shape[1]):
        m = int((n > k).sum())
        if not m:
            break
        x, p, rejects, dt = x[:m], p[:m], rejects[:m], t[:m, k] - t[:m, k - 1]
        f, q = cv_steps(dt, prm.q + np.where(dt > prm.gap_s, prm.gap_q, 0.0))
        x, p = (f @ x[..., None])[..., 0], f @ p @ f.swapaxes(-1, -2) + q
        out.f[:m, k], out.x_pred[:m, k], out.p_pred[:m, k] = f, x, p
        v, inv, nis, log = _innovation(x, p, z[:m, k], r2)
        fresh = ~(z[:m, k] == z[:m, k - 1]).all(-1)
        good = fresh & (nis <= limit)
        bad = fresh & ~good
        out.nis[:m, k], out.loglik[:m, k], out.accepted[:m, k] = np.where(fresh, nis, np.nan), np.where(fresh, log, np.nan), ~bad
        ux, up = _update(x, p, v, inv, r2)
        rejects = np.where(good, 0, rejects + bad)
        late = bad & (dt > SILENCE_S)
        rv, rvar, again = _restarts(t, z, vel, k, m, late, bad & (rejects >= prm.most_rejects), prm.r_m)
        x = np.where(again[:, None], np.concatenate([z[:m, k], rv], 1), np.where(good[:, None], ux, x))
        p = np.where(again[:, None, None], _diagonal(r2, rvar, 4), np.where(good[:, None, None], up, p))
        rejects = np.where(again, 0, rejects)
        out.x[:m, k], out.p[:m, k], out.restart[:m, k] = x, p, again
    return _unsorted(out, order)


def _unsorted(out: Track, order: np.ndarray) -> Track:
    back = np.argsort(order)
    return Track(*(None if v is None else v[back] for v in vars(out).values()))


def _alone(batch, t: np.ndarray, z: np.ndarray, vel: np.ndarray | None, prm) -> Track:
    vel = np.full((len(t), 2), np.nan) if vel is None else vel
    return batch(np.asarray(t, float)[None], np.asarray(z, float)[None], np.asarray(vel, float)[None], np.array([len(t)]), prm).one(0, len(t))


def run_cv(t: np.ndarray, z: np.ndarray, vel: np.ndarray | None = None, prm: CvParameters = CvParameters()) -> Track:
    return _alone(run_cv_batch, t, z, vel, prm)


def run_imm(t: np.ndarray, z: np.ndarray, vel: np.ndarray | None = None, prm: ImmParameters = ImmParameters()) -> Track:
    return _alone(run_imm_batch, t, z, vel, prm)


def smooth(track: Track, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Backward pass over one track, or several side by side with lengths n; nothing flows back over a restart."""
    if track.x.ndim == 2:
        xs, ps = smooth(Track(*(None if v is None else v[None] for v in vars(track).values())), np.array([len(track.x)]))
        return xs[0], ps[0]
    xs, ps = track.x.copy(), track.p.copy()
    for k in range(xs.shape[1] - 2, -1, -1):
        on = np.flatnonzero((n > k + 1) & ~track.restart[:, k + 1])
        if len(on):
            c = np.linalg.solve(track.p_pred[on, k + 1], track.f[on, k + 1] @ track.p[on, k]).swapaxes(-1, -2)
            xs[on, k] = track.x[on, k] + (c @ (xs[on, k + 1] - track.x_pred[on, k + 1])[..., None])[..., 0]
            ps[on, k] = track.p[on, k] + c @ (ps[on, k + 1] - track.p_pred[on, k + 1]) @ c.swapaxes(-1, -2)
    return xs, ps


def turn(x: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinated turn of states (..., [e, n, ve, vn, w]) and its Jacobian; a series near straight motion."""
    x, dt = np.asarray(x, float), np.asarray(dt, float)
    ve, vn, w = x[..., 2], x[..., 3], x[..., 4]
    a, slow = w * dt, np.abs(w) < 1e-6
    safe = np.where(slow, 1.0, w)
    co, si = np.cos(a), np.sin(a)
    s = np.where(slow, dt - a * a * dt / 6, si / safe)
    c = np.where(slow, a * dt / 2, (1 - co) / safe)
    ds = np.where(slow, -a * dt * dt / 3, (dt * co - s) / safe)
    dc = np.where(slow, dt * dt / 2, (dt * si - c) / safe)
    f = np.zeros((*x.shape, 5))
    for i in (0, 1, 4):
        f[..., i, i] = 1.0
    f[..., 0, 2], f[..., 0, 3], f[..., 0, 4] = s, -c, ve * ds - vn * dc
    f[..., 1, 2], f[..., 1, 3], f[..., 1, 4] = c, s, ve * dc + vn * ds
    f[..., 2, 2], f[..., 2, 3], f[..., 2, 4] = co, -si, -dt * (ve * si + vn * co)
    f[..., 3, 2], f[..., 3, 3], f[..., 3, 4] = si, co, dt * (ve * co - vn * si)
    return np.stack([x[..., 0] + ve * s - vn * c, x[..., 1] + ve * c + vn * s, ve * co - vn * si, ve * si + vn * co, w], -1), f


def mode_steps(x: np.ndarray, p: np.ndarray, dt: np.ndarray, prm: ImmParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prediction of the modes of x (V, 3, 5): stationary (velocity dies away), cruise (no turn), turn."""
    v = len(x)
    f, q, y = np.zeros((v, 3, 5, 5)), np.zeros((v, 3, 5, 5)), np.empty((v, 3, 5))
    f[:, 0], fade = np.eye(5), np.exp(-dt / prm.tau_s)
    f[:, 0, 4, 4] = 0.0
    for i in (0, 1):
        f[:, 0, i, i + 2], f[:, 0, i + 2, i + 2] = prm.tau_s * (1 - fade), fade
        q[:, 0, i, i], q[:, 0, i + 2, i + 2] = prm.q_stationary * dt, prm.q_stationary * prm.tau_s / 2 * (1 - fade**2)
    f[:, 1], q[:, 1] = cv_steps(dt, np.full(v, prm.q_cruise), 5)
    f[:, 1, 4, 4] = 0.0
    q[:, 2] = cv_steps(dt, np.full(v, prm.q_turn), 5)[1]
    q[:, :2, 4, 4], q[:, 2, 4, 4] = 1e-12, prm.q_omega * dt
    if prm.gap_q:
        q += cv_steps(dt, np.where(dt > prm.gap_s, prm.gap_q, 0.0), 5)[1][:, None]
    y[:, 2], f[:, 2] = turn(x[:, 2], dt)
    y[:, :2] = (f[:, :2] @ x[:, :2, :, None])[..., 0]
    return y, f @ p @ f.swapaxes(-1, -2) + q, f


def switching(dt: np.ndarray | float, prm: ImmParameters) -> np.ndarray:
    """Mode transition matrices: stay with exp(-dt / sojourn), leave by the switch shares."""
    stay = np.exp(-np.asarray(dt, float)[..., None] / np.array(prm.sojourn_s))
    return stay[..., None] * np.eye(3) + (1 - stay)[..., None] * np.array(prm.switch)


def moments(mu: np.ndarray, xs: np.ndarray, ps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of mixtures; weights (..., m), means (..., m, d), covariances (..., m, d, d)."""
    x = np.einsum("...m,...mi->...i", mu, xs)
    d = xs - x[..., None, :]
    return x, np.einsum("...m,...mij->...ij", mu, ps + d[..., :, None] * d[..., None, :])


def mix_and_step(xs, ps, mu, dt, pi, prm):
    """One cycle of mixing and prediction: predicted modes, their probabilities, the mean transition."""
    c = np.maximum((mu[:, None] @ pi)[:, 0], 1e-300)
    w = (pi * mu[:, :, None] / c[:, None]).swapaxes(1, 2)  # (V, to, from)
    mx, mp = moments(w, np.repeat(xs[:, None], 3, 1), np.repeat(ps[:, None], 3, 1))
    y, p, f = mode_steps(mx, mp, dt, prm)
    return y, p, c / c.sum(1, keepdims=True), np.einsum("vm,vmij->vij", c, f)


def run_imm_batch(t: np.ndarray, z: np.ndarray, vel: np.ndarray, n: np.ndarray, prm: ImmParameters = ImmParameters()) -> Track:
    """Three modes, many tracks in step; a fix is accepted if its mixture likelihood exceeds the density of outliers."""
    order, t, z, vel, n = _prepared(t, z, vel, n)
    out, r2, clutter = _empty(*t.shape, 5), prm.r_m**2, math.log(prm.clutter)
    out.mu, out.mode_x, out.mode_p = np.zeros((*t.shape, 3)), np.zeros((*t.shape, 3, 5)), np.zeros((*t.shape, 3, 5, 5))

    def fresh(at: np.ndarray, v: np.ndarray, var: np.ndarray):
        x = np.concatenate([at, v, np.zeros((len(at), 1))], 1)
        slow = (np.hypot(v[:, 0], v[:, 1]) < 0.25) & (var < 1)
        return np.repeat(x[:, None], 3, 1), np.repeat(_diagonal(r2, var, 5)[:, None], 3, 1), np.where(slow[:, None], [0.8, 0.15, 0.05], [0.2, 0.6, 0.2])

    xs, ps, mu = fresh(z[:, 0], *_start_velocity(vel[:, 0]))
    rejects = np.zeros(len(t), int)
    out.restart[:, 0] = True
    for k in range(t.shape[1]):
        m = int((n > k).sum())
        if not m:
            break
        xs, ps, mu, rejects, f = xs[:m], ps[:m], mu[:m], rejects[:m], np.eye(5)
        if k:
            dt = t[:m, k] - t[:m, k - 1]
            xs, ps, mu, f = mix_and_step(xs, ps, mu, dt, switching(dt, prm), prm)
        x_pred, p_pred = moments(mu, xs, ps)
        out.f[:m, k], out.x_pred[:m, k], out.p_pred[:m, k] = f, x_pred, p_pred
        if k:
            moved = ~(z[:m, k] == z[:m, k - 1]).all(-1)
            nis = _innovation(x_pred, p_pred, z[:m, k], r2)[2]
            v, inv, _, log = _innovation(xs, ps, z[:m, k, None], r2)
            joint = np.log(np.maximum(mu, 1e-300)) + log
            top = joint.max(1)
            like = np.exp(joint - top[:, None])
            total = top + np.log(like.sum(1))
            good = moved & (total >= clutter)
            bad = moved & ~good
            out.nis[:m, k], out.loglik[:m, k], out.accepted[:m, k] = np.where(moved, nis, np.nan), np.where(moved, np.logaddexp(total, clutter), np.nan), ~bad
            ux, up = _update(xs, ps, v, inv, r2)
            rejects = np.where(good, 0, rejects + bad)
            late = bad & (dt > SILENCE_S)
            rv, rvar, again = _restarts(t, z, vel, k, m, late, bad & (rejects >= prm.most_rejects), prm.r_m)
            fx, fp, fmu = fresh(z[:m, k], rv, rvar)
            xs = np.where(again[:, None, None], fx, np.where(good[:, None, None], ux, xs))
            ps = np.where(again[:, None, None, None], fp, np.where(good[:, None, None, None], up, ps))
            mu = np.where(again[:, None], fmu, np.where(good[:, None], like / like.sum(1, keepdims=True), mu))
            rejects = np.where(again, 0, rejects)
            out.restart[:m, k] = again
        out.x[:m, k], out.p[:m, k] = moments(mu, xs, ps)
        out.mu[:m, k], out.mode_x[:m, k], out.mode_p[:m, k] = mu, xs, ps
    return _unsorted(out, order)


def imm_forecast_states(xs: np.ndarray, ps: np.ndarray, mu: np.ndarray, horizon_s: float, prm: ImmParameters, switch: bool, step_s: float = 300.0) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances after a horizon, in sub-steps, for many states; the modes switch or stay as they are."""
    left = horizon_s
    while left > 1e-9:
        dt = np.full(len(xs), min(step_s, left))
        xs, ps, mu, _ = mix_and_step(xs, ps, mu, dt, switching(dt, prm) if switch else np.broadcast_to(np.eye(3), (len(xs), 3, 3)), prm)
        left -= dt[0] if len(dt) else left
    return moments(mu, xs, ps)


TRACK_SCHEMA = (
    "voyage_id string, mmsi long, t timestamp, lat double, lon double, sog_kn double, cog_deg double, f_lat double, f_lon double, f_ve double, f_vn double, "
    "f_pee double, f_pnn double, f_pen double, f_peve double, f_pnvn double, f_pevn double, f_pnve double, f_pveve double, f_pvnvn double, f_pvevn double, nis double, accepted boolean, reinit boolean, loglik double, "
    "i_lat double, i_lon double, i_ve double, i_vn double, i_omega double, i_pee double, i_pnn double, i_pen double, i_nis double, i_accepted boolean, i_stationary double, i_cruise double, i_turn double, "
    "s_lat double, s_lon double, s_ve double, s_vn double, s_pee double, s_pnn double, s_pen double, imm_mu array<double>, imm_x array<double>, imm_p array<double>, ref_lat double, ref_lon double"
)


def planes(v: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Voyages of a frame sorted by voyage and time, side by side: seconds, positions and reported velocities in the plane
    at the first fix of each, lengths, that fix, and the (voyage, fix) of every row."""
    first = np.flatnonzero(np.append(True, v["voyage_id"].to_numpy()[1:] != v["voyage_id"].to_numpy()[:-1]))
    n = np.diff(np.append(first, len(v)))
    row, col = np.repeat(np.arange(len(n)), n), np.arange(len(v)) - np.repeat(first, n)
    lat, lon = v["lat"].to_numpy(float), v["lon"].to_numpy(float)
    e, north = np_enu(lat, lon, lat[first][row], lon[first][row])
    us = v["t"].to_numpy().astype("datetime64[us]").astype("int64")
    sog, cog = v["sog_kn"].to_numpy(float) * KNOT_MS, np.radians(v["cog_deg"].to_numpy(float))
    t, z, vel = np.zeros((len(n), n.max())), np.zeros((len(n), n.max(), 2)), np.full((len(n), n.max(), 2), np.nan)
    t[row, col] = (us - us[first][row]) / 1e6
    z[row, col] = np.column_stack([e, north])
    vel[row, col] = np.column_stack([sog * np.sin(cog), sog * np.cos(cog)])
    return t, z, vel, n, lat[first][row], lon[first][row], row, col


def track_voyages(v: pd.DataFrame, cv: CvParameters, imm: ImmParameters, states: bool) -> pd.DataFrame:
    """Filtered, mode and smoothed states of the voyages of a frame sorted by voyage and time."""
    t, z, vel, n, lat0, lon0, row, col = planes(v)
    a, b = run_cv_batch(t, z, vel, n, cv), run_imm_batch(t, z, vel, n, imm)
    xs, ps = smooth(b, n)
    out = {c: v[c].to_numpy() for c in ("voyage_id", "mmsi", "t", "lat", "lon", "sog_kn", "cog_deg")}
    for head, x, p in (("f", a.x, a.p), ("i", b.x, b.p), ("s", xs, ps)):
        x, p = x[row, col], p[row, col]
        out[f"{head}_lat"], out[f"{head}_lon"] = np_latlon(x[:, 0], x[:, 1], lat0, lon0)
        for name, i, j in (("pee", 0, 0), ("pnn", 1, 1), ("pen", 0, 1)):
            out[f"{head}_{name}"] = p[:, i, j]
        out[f"{head}_ve"], out[f"{head}_vn"] = x[:, 2], x[:, 3]
    p = a.p[row, col]
    for name, i, j in (("peve", 0, 2), ("pnvn", 1, 3), ("pevn", 0, 3), ("pnve", 1, 2), ("pveve", 2, 2), ("pvnvn", 3, 3), ("pvevn", 2, 3)):
        out[f"f_{name}"] = p[:, i, j]
    out |= {k: getattr(a, m)[row, col] for k, m in (("nis", "nis"), ("accepted", "accepted"), ("reinit", "restart"), ("loglik", "loglik"))}
    out |= {"i_omega": b.x[row, col, 4], "i_nis": b.nis[row, col], "i_accepted": b.accepted[row, col], "ref_lat": lat0, "ref_lon": lon0}
    out |= {f"i_{name}": b.mu[row, col, j] for j, name in enumerate(("stationary", "cruise", "turn"))}
    for name, m in (("imm_mu", b.mu), ("imm_x", b.mode_x), ("imm_p", b.mode_p)):
        out[name] = list(m[row, col].reshape(len(row), -1)) if states else None
    return pd.DataFrame({c.split(" ")[0]: out[c.split(" ")[0]] for c in TRACK_SCHEMA.split(", ")})


def _of_like_length(v: pd.DataFrame, most: int | None = None):
    """The voyages of a frame, long before short, in parts of at most `most` padded cells (voyages times the longest), so that
    a long voyage does not widen the arrays of many short ones; a single voyage may have more."""
    most = PADDED_CELLS if most is None else most
    names = v["voyage_id"].to_numpy()
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    size = np.diff(np.append(first, len(v)))
    order, at = np.argsort(-size, kind="stable"), 0
    while at < len(order):
        take = order[at : at + max(1, most // int(size[order[at]]))]
        at += len(take)
        yield v.iloc[np.concatenate([np.arange(first[k], first[k] + size[k]) for k in take])].reset_index(drop=True)


def _chunks(batches, most: int):
    """Whole voyages of a stream sorted by voyage, `most` rows or one voyage at a time at least."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= most:
            v = pd.concat(held, ignore_index=True)
            cut = int(np.argmax(v["voyage_id"].to_numpy() == v["voyage_id"].iloc[-1]))
            if cut:
                yield v.iloc[:cut].reset_index(drop=True)
            held, size = [v.iloc[cut:]], len(v) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


CHUNK_ROWS = 20_000
PADDED_CELLS = 40_000  # of (voyage, fix) arrays that are filtered in step


def _by_voyage(points: DataFrame) -> DataFrame:
    p = points.select("voyage_id", "mmsi", "t", "lat", "lon", F.col("sog_kn").cast("double"), F.col("cog_deg").cast("double"))
    return p.repartition("voyage_id").sortWithinPartitions("voyage_id", "t")


def track_all(points: DataFrame, cv: CvParameters | None = None, imm: ImmParameters | None = None, states: bool = False) -> DataFrame:
    """Every voyage of `points`, in parallel. With `states`, the mode states that forecasts start from."""
    cv, imm = cv or CvParameters(), imm or ImmParameters()

    def run(batches):
        for v in _chunks(batches, CHUNK_ROWS):
            for part in _of_like_length(v):
                yield track_voyages(part, cv, imm, states)

    return _by_voyage(points).mapInPandas(run, TRACK_SCHEMA)


FORECAST_SCHEMA = "model string, sample_id string, horizon_min int, lat0 double, lon0 double, me double, mn double, cee double, cnn double, cen double"


def with_states(samples: DataFrame, tracks: DataFrame, columns: list[str]) -> DataFrame:
    """Samples with the filter states at their start; one without a state stops the job with an error."""
    j = samples.join(tracks.select("voyage_id", F.col("t").alias("t0"), *columns, F.lit(True).alias("_state")), ["voyage_id", "t0"], "left")
    missing = F.raise_error(F.concat(F.lit("no filter state for sample "), F.col("sample_id"))).cast("string")
    return j.withColumn("sample_id", F.when(F.col("_state").isNull(), missing).otherwise(F.col("sample_id"))).drop("_state")


def imm_forecasts(samples: DataFrame, tracks: DataFrame, imm: ImmParameters | None = None, switch: bool = True) -> DataFrame:
    """Forecasts from the stored mode states; means move from the voyage's frame to the anchor's, covariances stay."""
    imm, name = imm or ImmParameters(), "imm_switching" if switch else "imm_frozen"
    s = samples.select("voyage_id", "t0", "sample_id", "horizon_min", "lat0", "lon0").transform(lambda x: with_states(x, tracks, ["imm_mu", "imm_x", "imm_p", "ref_lat", "ref_lon"]))

    def run(batches):
        for b in batches:
            for horizon, g in b.groupby("horizon_min"):
                stack = lambda c, *shape: np.stack(g[c].to_numpy()).reshape(len(g), *shape)  # noqa: B023, E731
                x, p = imm_forecast_states(stack("imm_x", 3, 5), stack("imm_p", 3, 5, 5), stack("imm_mu", 3), horizon * 60.0, imm, switch)
                e, n = np_enu(*np_latlon(x[:, 0], x[:, 1], g["ref_lat"], g["ref_lon"]), g["lat0"], g["lon0"])
                yield pd.DataFrame({"model": name, "sample_id": g["sample_id"], "horizon_min": g["horizon_min"], "lat0": g["lat0"], "lon0": g["lon0"], "me": e, "mn": n, "cee": p[:, 0, 0], "cnn": p[:, 1, 1], "cen": p[:, 0, 1]})

    return s.mapInPandas(run, FORECAST_SCHEMA)


def tune(points: DataFrame, grid: list[CvParameters]) -> DataFrame:
    """Mean one-step log likelihood (floored against outliers) of each candidate over all voyages."""

    def run(batches):
        for v in _chunks(batches, CHUNK_ROWS):
            for part in _of_like_length(v):
                t, z, vel, n, *_ = planes(part)
                for i, c in enumerate(grid):
                    ll = run_cv_batch(t, z, vel, n, c).loglik
                    ll = np.logaddexp(ll[np.isfinite(ll)], math.log(OUTLIER_DENSITY))
                    yield pd.DataFrame({"candidate": [i], "s": [float(ll.sum())], "n": [len(ll)]})

    return _by_voyage(points).mapInPandas(run, "candidate int, s double, n long").groupBy("candidate").agg((F.sum("s") / F.sum("n")).alias("mean_loglik"), F.sum("n").alias("n"))
