"""The detector and baseline queries over whole tables against plain loops with one full regression per boundary."""

import math

import numpy as np
import pytest

from stratawave import queries as q
from stratawave.sources import testbed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    """pid -> days since the first value, values, noise level."""
    out = {}
    for r in sorted(testbed.gappy_points(spark, SF).collect(), key=lambda r: (r.pid, r.d)):
        if r.y is not None:
            out.setdefault(r.pid, []).append((r.d, r.y))
    return {p: (np.array([(d - own[0][0]).days for d, _ in own], float), np.array([y for _, y in own]), 12 + (p % 10) * 0.8) for p, own in out.items()}


def fit(x, y):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = float(((y - x @ beta) ** 2).sum())
    sigma = math.sqrt(rss / max(1, len(y) - x.shape[1]))
    return beta, y - x @ beta, rss, sigma, np.sqrt(np.diag(np.linalg.inv(x.T @ x))) * sigma


def design(t):
    return np.column_stack([np.ones(len(t)), t / 365.25, np.sin(2 * np.pi * t / 365.25), np.cos(2 * np.pi * t / 365.25)])


def shift(v, j, k):
    """Medians of the k values on either side and the share of the later ones nearer to their own."""
    a, b = np.median(v[j - k : j]), np.median(v[j : j + k])
    return a, b, np.mean([abs(x - b) <= abs(x - a) for x in v[j : j + k]])


def two_stage(t, y, sigma, k=3, top=5):
    n, side = len(y), 4
    _, r, rss0, _, _ = fit(design(t), y)
    bic = lambda rss, p: n * math.log(max(rss, 1e-12) / n) + p * math.log(n)
    usual = float(np.median(np.diff(t)))
    rows = {}
    for j in range(side, n - side):
        (ay, by, near_y), (ar, br, near_r) = shift(y, j, k), shift(r, j, k)
        ratio = (t[j] - t[j - 1]) / usual
        damp = 1.0 if ratio <= 1.5 else 1 / math.sqrt(1 + ratio - 1.5)
        dy, dr = abs(y[j] - y[j - 1]), abs(r[j] - r[j - 1])
        first = (1.2 * dr + 0.6 * abs(br - ar) + 0.3 * dy + 0.2 * abs(by - ay)) / sigma * damp
        beta, _, rss, _, se = fit(np.column_stack([design(t), np.arange(n) >= j]), y)
        snr, improve, delta = abs(beta[-1]) / se[-1], (rss0 - rss) / rss0, bic(rss, 5) - bic(rss0, 4)
        flag = near_y >= 0.7 or near_r >= 0.7
        score = (0.9 * snr + 6 * improve + 0.25 * max(0, -delta) + (1.1 * dr + 0.25 * dy + 0.35 * abs(br - ar)) / sigma + flag) * damp
        present = abs(beta[-1]) >= 1.5 and snr >= 1.2 and improve >= 0.01 and delta <= -1 and flag
        rows[j] = (first, dr, score, present, beta[-1], snr, improve, delta)
    chosen = set(sorted(rows, key=lambda j: -rows[j][0])[: max(20, 6 * top)])
    chosen |= {max(side, min(n - side - 1, round(side + f * (n - 2 * side)))) for f in (0.2, 0.4, 0.6, 0.8)} | {max(rows, key=lambda j: rows[j][1])}
    return [(j, *rows[j][2:]) for j in sorted(sorted(chosen), key=lambda j: -rows[j][2])[:top]]


def test_residual_steps(spark, series):
    got = {}
    for r in sorted(q.QUERIES["residual_steps"](spark, SF).collect(), key=lambda r: (r.pid, r.place)):
        got.setdefault(r.pid, []).append(r)
    assert got.keys() == series.keys()
    for p, (t, y, sigma) in series.items():
        want = two_stage(t, y, sigma)
        assert [r.j for r in got[p]] == [w[0] for w in want]
        for r, (_, score, present, mag, snr, improve, delta) in zip(got[p], want, strict=True):
            assert r.present == present and (r.score, r.mag, r.snr, r.improve, r.delta_bic) == pytest.approx((score, abs(mag) if r.mag >= 0 else mag, snr, improve, delta), abs=2e-5)


def test_legacy_steps(spark, series):
    got = {r.pid: r for r in q.QUERIES["legacy_steps"](spark, SF).collect()}
    assert got.keys() == series.keys()
    for p, (t, y, sigma) in series.items():
        r, best = fit(design(t), y)[1], None
        whole = ((r - np.median(r)) ** 2).sum()
        for j in range(3, len(y) - 3):
            a, b, _ = shift(r, j, 3)
            improve = (whole - ((r[j - 3 : j] - a) ** 2).sum() - ((r[j : j + 3] - b) ** 2).sum()) / whole
            score = abs(b - a) / sigma + 2 * improve
            if best is None or score > best[0] + 1e-12:
                best = (score, j, abs(b - a) >= 2 and abs(b - a) / sigma >= 1 and improve >= 0.1, b - a, abs(b - a) / sigma)
        assert got[p].j == best[1] and got[p].present == best[2]
        assert (got[p].mag, got[p].snr) == pytest.approx(best[3:], abs=2e-6)


def test_baseline_fit_stats_and_answers(spark, series):
    stats = {r.pid: r for r in q.QUERIES["baseline_fit_stats"](spark, SF).collect()}
    answers = {}
    for r in q.QUERIES["baseline_answers"](spark, SF).collect():
        answers.setdefault(r.pid, {})[r.task_name] = r.answer
    for p, (t, y, sigma) in series.items():
        line, _, rss1, _, se = fit(design(t)[:, :2], y)
        wave, _, rss2, sigma2, _ = fit(design(t), y)
        amp = math.hypot(*wave[2:])
        want = (line[1], se[1], abs(line[1]) / se[1], amp, amp / sigma2, (rss1 - rss2) / rss1)
        assert (stats[p].slope, stats[p].slope_se, stats[p].slope_snr, stats[p].amp, stats[p].sea_snr, stats[p].sea_improve) == pytest.approx(want, abs=2e-6)
        season = amp / sigma2 >= 1.5 and want[5] >= 0.05 and amp >= 0.5
        a = answers[p]
        assert a["A1_trend_dir"] == ("stable" if abs(line[1]) < 0.5 else "subsiding" if line[1] < 0 else "uplifting") and float(a["A2_trend_v"]) == pytest.approx(line[1], abs=2e-6)
        assert a["B1_seasonality_present"] == ("seasonal" if season else "nonseasonal") and (a["B2_seasonality_amp"] == "none" or float(a["B2_seasonality_amp"]) == pytest.approx(amp, abs=2e-6)) and (a["B2_seasonality_amp"] == "none") != season
        j, _, _, mag, snr, improve, delta = two_stage(t, y, sigma)[0]
        n_near = max(shift(y, j, 3)[2], shift(fit(design(t), y)[1], j, 3)[2]) >= 0.7
        step = abs(mag) >= 3 and snr >= 2 and improve >= 0.05 and n_near and delta <= 0
        assert (a["C1_step_time"] == "none") != step and (a["C2_step_mag"] == "none") != step
        if step:
            assert float(a["C2_step_mag"]) == pytest.approx(abs(mag), abs=2e-6)
