"""Operators over ordered series: relations (clip, frame, value columns), frames from 0 without gaps.

Each function takes the SQL text of a relation and returns the SQL text of the result. All windows
of a text share one partitioning, so a series is exchanged once; aggregates combine before theirs.
Undefined values are null.
"""

from __future__ import annotations

from stridelake.functions import rotations as R
from stridelake.functions.vectors import cross, dot, norm, ratio
from stridelake.plans.sql import kurtosis, last_known, numbers, over, skewness, stages

KEYS = "clip"


def _check(stencil: str, pad: str) -> None:
    if stencil not in ("central", "forward") or pad not in ("edge", "none"):
        raise ValueError("stencil is central or forward, pad is edge or none")


def least_frames(order: int, stencil: str, pad: str) -> int:
    """Frames that a derivative of an order needs."""
    _check(stencil, pad)
    return order + 1 if stencil == "forward" else 3 if pad == "edge" else 2 * order + 1


def derivative(expr: str, dt: str, keys: str = KEYS) -> str:
    """Central difference with one-sided ends, as one expression."""
    w = over(keys)
    lag, lead = f"lag({expr}) {w}", f"lead({expr}) {w}"
    return f"(CASE WHEN {lag} IS NULL THEN ({lead} - {expr}) / {dt} WHEN {lead} IS NULL THEN ({expr} - {lag}) / {dt} ELSE ({lead} - {lag}) / (2.0 * {dt}) END)"


def forward(expr: str, dt: str, keys: str = KEYS) -> str:
    """Forward difference, null at the last frame."""
    return f"((lead({expr}) {over(keys)} - {expr}) / {dt})"


def _hold(expr: str, duck: bool, keys: str = KEYS) -> str:
    """A null tail takes the last known value."""
    return f"coalesce({expr}, {last_known(expr, over(keys, frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW'), duck)})"


def differences(src: str, columns: dict[str, str], dt: str, order: int = 1, stencil: str = "central", pad: str = "edge", duck: bool = False, rungs: str = "late", keys: str = KEYS) -> str:
    """Derivatives of columns {new: old}, one rung on another.

    Central rungs use one-sided ends; pad none trims ``order`` frames at each end. Forward rungs
    are padded once at the end (``rungs`` late) or each on its own (early), or the tail is trimmed.
    """
    _check(stencil, pad)
    sql = src
    for r in range(order):
        now = {f"__{n}{r + 1}": o if r == 0 else f"__{n}{r}" for n, o in columns.items()}
        if stencil == "central":
            sql = stages(sql, {n: derivative(o, dt, keys) for n, o in now.items()})
        else:
            sql = stages(sql, {n: forward(o, dt, keys) for n, o in now.items()})
            if pad == "edge" and (rungs == "early" or r == order - 1):
                sql = stages(sql, {f"{n}h": _hold(n, duck, keys) for n in now})
                sql = f"SELECT *, {', '.join(f'{n}h AS {n}' for n in now)} FROM (SELECT * EXCEPT ({', '.join(now)}) FROM ({sql}))" if not duck else f"SELECT * EXCLUDE ({', '.join(now)}), {', '.join(f'{n}h AS {n}' for n in now)} FROM ({sql})"
    final = {n: f"__{n}{order}" for n in columns}
    sql = stages(sql, final)
    if pad == "none":
        last = f"max(frame) OVER (PARTITION BY {keys})"
        edge = order if stencil == "central" else 0
        sql = f"SELECT * FROM ({stages(sql, {'__last': last})}) WHERE frame >= {edge} AND frame <= __last - {order}"
    return sql


def speed_derivative(src: str, xyz: tuple[str, ...], dt: str, pad: str = "edge", duck: bool = False, keys: str = KEYS) -> str:
    """Column accel: the derivative of the length of the velocity; pad none trims at both rungs."""
    sql = differences(src, {f"v{i}": c for i, c in enumerate(xyz)}, dt, keys=keys)
    sql = stages(sql, {"speed": norm(tuple(f"v{i}" for i in range(len(xyz))))})
    if pad == "none":
        sql = f"SELECT * FROM ({stages(sql, {'__end': f'max(frame) OVER (PARTITION BY {keys})'})}) WHERE frame >= 1 AND frame < __end"
    sql = stages(sql, {"accel": derivative("speed", dt, keys)})
    if pad == "none":
        sql = f"SELECT * FROM ({sql}) WHERE frame >= 2 AND frame < __end - 1"
    return sql


def box_filter(src: str, value: str, window: int, out: str = "smooth", keys: str = KEYS) -> str:
    """Moving average over (window - 1) // 2 frames back and window // 2 ahead, ends repeated."""
    lo, hi = (window - 1) // 2, window // 2
    whole = f"OVER (PARTITION BY {keys} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    inside = f"sum({value}) {over(keys, frame=f'ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING')}"
    before = f"greatest({lo} - frame, 0) * first_value({value}) {whole}"
    after = f"greatest(frame + {hi} - max(frame) {whole}, 0) * last_value({value}) {whole}"
    return stages(src, {out: f"({inside} + {before} + {after}) / {float(window)}"})


def temporal_stats(src: str, value: str, keys: str = KEYS, duck: bool = False) -> str:
    """Population mean, deviation, extremes, skewness and excess kurtosis of each series."""
    return (
        f"SELECT {keys}, avg({value}) AS mean, stddev_pop({value}) AS std, min({value}) AS least, max({value}) AS most, "
        f"{skewness(value, duck)} AS skew, {kurtosis(value, duck)} AS kurt FROM ({src}) GROUP BY {keys}"
    )


def spectrum(src: str, value: str, fs: float = 1.0, norm: str = "backward", keys: str = KEYS, duck: bool = False, bins: str | None = None) -> str:
    """(keys, k, freq, magnitude) of the real transform: a row for each frequency, summed over frames.

    norm is backward, ortho, forward or amplitude (doubled but for the constant and an even series' last).
    """
    if norm not in ("backward", "ortho", "forward", "amplitude"):
        raise ValueError(f"unknown norm {norm!r}")
    counted = stages(src, {"n": f"count(*) OVER (PARTITION BY {keys})"})
    spread = f"SELECT {keys}, frame, {value} AS v, n, {numbers('0', bins or 'floor(n / 2)', 'k', duck)} FROM ({counted})"
    angle = "2.0 * pi() * k * frame / n"
    sums = f"SELECT {keys}, k, n, sum(v * cos({angle})) AS re, sum(v * sin({angle})) AS im FROM ({spread}) GROUP BY {keys}, k, n"
    size = "sqrt(re * re + im * im)"
    scale = {"backward": size, "ortho": f"{size} / sqrt(n)", "forward": f"{size} / n", "amplitude": f"{size} / n * (CASE WHEN k = 0 OR 2 * k = n THEN 1.0 ELSE 2.0 END)"}[norm]
    return f"SELECT {keys}, k, k * CAST({fs} AS DOUBLE) / n AS freq, {scale} AS magnitude FROM ({sums})"


def dominant_frequency(src: str, value: str, fs: float, keys: str = KEYS, duck: bool = False) -> str:
    """The frequency of the largest magnitude, the constant left out, the lowest of equals."""
    s = spectrum(src, value, fs, keys=keys, duck=duck)
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(magnitude, 9) DESC, k) AS r FROM ({s}) WHERE k > 0"
    return f"SELECT {keys}, freq AS dominant FROM ({ranked}) WHERE r = 1"


def sparc_small(src: str, value: str, fs: float, padlevel: int = 4, fc: float = 10.0, amp_th: float = 0.05, keys: str = KEYS, duck: bool = False) -> str:
    """Spectral arc length by a transform to a zero-padded grid, for short series (see kernels for long ones)."""
    counted = stages(src, {"n": f"count(*) OVER (PARTITION BY {keys})"})
    grid = stages(counted, {"nfft": f"CAST(power(2, ceil(log2(n)) + {padlevel}) AS BIGINT)"})
    # the peak may lie anywhere; the spectrum of a real series is even, so half of it has every value
    spread = f"SELECT {keys}, frame, {value} AS v, nfft, {numbers('0', 'floor(nfft / 2)', 'k', duck)} FROM ({grid})"
    a = "2.0 * pi() * k * frame / nfft"
    sums = f"SELECT {keys}, k, nfft, sum(v * cos({a})) AS re, sum(v * sin({a})) AS im FROM ({spread}) GROUP BY {keys}, k, nfft"
    mag = f"SELECT {keys}, k, k * CAST({fs} AS DOUBLE) / nfft AS freq, sqrt(re * re + im * im) AS m FROM ({sums})"
    rel = stages(mag, {"peak": f"max(m) OVER (PARTITION BY {keys})"})
    rel = f"SELECT {keys}, k, freq, {ratio('m', 'peak')} AS m FROM ({rel}) WHERE freq <= {fc}"
    ends = stages(rel, {"k0": f"min(CASE WHEN round(m, 9) >= {amp_th} THEN k END) OVER (PARTITION BY {keys})", "k1": f"max(CASE WHEN round(m, 9) >= {amp_th} THEN k END) OVER (PARTITION BY {keys})"})
    band = f"SELECT * FROM ({ends}) WHERE k >= k0 AND k <= k1"
    w = over(keys, "k")
    part = f"OVER (PARTITION BY {keys})"
    step = stages(band, {"df": f"(freq - lag(freq) {w}) / (CASE WHEN max(freq) {part} > min(freq) {part} THEN max(freq) {part} - min(freq) {part} END)", "dm": f"m - lag(m) {w}"})
    return f"SELECT {keys}, -sum(sqrt(df * df + dm * dm)) AS sparc FROM ({step}) GROUP BY {keys}"


# ---- one value for each series

def zero_crossings(src: str, value: str, keys: str = KEYS) -> str:
    s = stages(src, {"__p": f"lag({value}) {over(keys)}"})
    return f"SELECT {keys}, CAST(count(CASE WHEN __p * {value} < 0 THEN 1 END) AS BIGINT) AS crossings FROM ({s}) GROUP BY {keys}"


def number_of_peaks(src: str, value: str, min_height: float | None = None, keys: str = KEYS) -> str:
    """Strict maxima inside a series, optionally of a height at least."""
    s = stages(src, {"__a": f"lag({value}) {over(keys)}", "__b": f"lead({value}) {over(keys)}"})
    high = "" if min_height is None else f" AND {value} >= {min_height}"
    return f"SELECT {keys}, CAST(count(CASE WHEN {value} > __a AND {value} > __b{high} THEN 1 END) AS BIGINT) AS peaks FROM ({s}) GROUP BY {keys}"


def active_segments(src: str, value: str, threshold: float) -> str:
    return stages(src, {"active": f"{value} > {threshold}"})


def active_duration(src: str, value: str, threshold: float, fs: float, keys: str = KEYS) -> str:
    return f"SELECT {keys}, count(CASE WHEN {value} > {threshold} THEN 1 END) / CAST({fs} AS DOUBLE) AS duration FROM ({src}) GROUP BY {keys}"


def range_of_motion(src: str, value: str, keys: str = KEYS) -> str:
    return f"SELECT {keys}, max({value}) - min({value}) AS extent FROM ({src}) GROUP BY {keys}"


def velocity_reductions(src: str, value: str, fs: float, keys: str = KEYS) -> str:
    """Peak, mean, peak over mean, and the largest rise and fall per second, not below 0."""
    s = stages(src, {"__d": f"(lead({value}) {over(keys)} - {value}) * {float(fs)}"})
    mean = f"avg({value})"
    return (
        f"SELECT {keys}, max({value}) AS peak, {mean} AS mean, CASE WHEN abs({mean}) > 1e-12 THEN max({value}) / (CASE WHEN abs({mean}) > 1e-12 THEN {mean} ELSE 1.0 END) END AS peak_to_mean, "
        f"greatest(coalesce(max(__d), 0.0), 0.0) AS peak_accel, greatest(coalesce(-min(__d), 0.0), 0.0) AS peak_decel FROM ({s}) GROUP BY {keys}"
    )


def speed_metric(src: str, value: str, keys: str = KEYS) -> str:
    return f"SELECT {keys}, {ratio(f'avg(abs({value}))', f'max(abs({value}))')} AS speed_metric FROM ({src}) GROUP BY {keys}"


def _jerk(src: str, value: str, fs: float, keys: str) -> str:
    w = over(keys)
    return stages(src, {"__j": f"({value} - 2.0 * lag({value}, 1) {w} + lag({value}, 2) {w}) * {float(fs) ** 2}"})


def squared_jerk(src: str, value: str, fs: float, form: str = "integrated", keys: str = KEYS) -> str:
    """Second differences of a speed, squared: integrated over time, mean, or root of the mean."""
    e = {"integrated": f"sum(__j * __j) / {float(fs)}", "mean": "avg(__j * __j)", "rms": "sqrt(avg(__j * __j))"}[form]
    return f"SELECT {keys}, {e} AS {form}_squared_jerk FROM ({_jerk(src, value, fs, keys)}) GROUP BY {keys}"


def dimensionless_jerk(src: str, value: str, fs: float, normalize: str = "peak_speed", amplitude: str | None = None, log: bool = False, keys: str = KEYS) -> str:
    """-scale * sum of squared jerk * dt with D = n * dt: D^3 / extent^2, or D^5 / amplitude^2. Null without extent; log is -ln |value|, infinite without jerk."""
    d = f"(count(*) / {float(fs)})"
    extent = amplitude if normalize == "amplitude" else f"max(abs({value}))" if normalize == "peak_speed" else f"avg(abs({value}))" if normalize == "mean_speed" else None
    if extent is None:
        raise ValueError("normalize is peak_speed, mean_speed or amplitude")
    power = 5 if normalize == "amplitude" else 3
    jerk = ratio(f"-power({d}, {power}) * sum(__j * __j) / {float(fs)}", f"({extent}) * ({extent})", "1e-24")
    sql = f"SELECT {keys}, {jerk} AS dlj FROM ({_jerk(src, value, fs, keys)}) GROUP BY {keys}"
    if log:
        return f"SELECT {keys}, CASE WHEN dlj < 0 THEN -ln(CASE WHEN dlj < 0 THEN -dlj ELSE 1.0 END) WHEN dlj = 0 THEN CAST('Infinity' AS DOUBLE) END AS ldlj FROM ({sql})"
    return sql


SMOOTHNESS = {
    "sparc": sparc_small,
    "dlj": dimensionless_jerk,
    "ldlj": lambda *a, **k: dimensionless_jerk(*a, log=True, **k),
    "peaks": lambda src, value, fs, **k: number_of_peaks(src, value, **k),
    "speed_metric": lambda src, value, fs, **k: speed_metric(src, value, **k),
    "isj": lambda *a, **k: squared_jerk(*a, form="integrated", **k),
    "msj": lambda *a, **k: squared_jerk(*a, form="mean", **k),
    "rsj": lambda *a, **k: squared_jerk(*a, form="rms", **k),
}


def smoothness(src: str, value: str, fs: float, metric: str = "sparc", **options) -> str:
    if metric not in SMOOTHNESS:
        raise ValueError(f"metric is one of {sorted(SMOOTHNESS)}")
    return SMOOTHNESS[metric](src, value, fs, **options)


# ---- trajectories (x, y, z)

def path_length(src: str, keys: str = KEYS) -> str:
    w = over(keys)
    s = stages(src, {"__s": norm(tuple(f"({c} - lag({c}) {w})" for c in "xyz"))})
    return f"SELECT {keys}, coalesce(sum(__s), 0.0) AS path_length FROM ({s}) GROUP BY {keys}"


def directness(src: str, keys: str = KEYS) -> str:
    """Net displacement over path length; null for a series that stands still."""
    w = over(keys)
    s = stages(src, {"__s": norm(tuple(f"({c} - lag({c}) {w})" for c in "xyz"))})
    net = norm(tuple(f"(max_by({c}, frame) - min_by({c}, frame))" for c in "xyz"))
    return f"SELECT {keys}, {ratio(net, 'coalesce(sum(__s), 0.0)')} AS directness FROM ({s}) GROUP BY {keys}"


def _ladder(src: str, dt: str, order: int, pad: str, keys: str) -> str:
    sql = src
    for r, (n, o) in enumerate((("v", ""), ("a", "v"), ("j", "a"))[:order]):
        sql = stages(sql, {f"{n}{c}": derivative(f"{o}{c}", dt, keys) for c in "xyz"})
    if pad == "none":
        sql = f"SELECT * FROM ({stages(sql, {'__end': f'max(frame) OVER (PARTITION BY {keys})'})}) WHERE frame >= {order} AND frame <= __end - {order}"
    return sql


_V, _A, _J = (tuple(f"{n}{c}" for c in "xyz") for n in "vaj")


def curvature(src: str, dt: str, pad: str = "edge", keys: str = KEYS) -> str:
    """Swept over speed cubed, null where the cube is 1e-12 or less."""
    sql = stages(_ladder(src, dt, 2, pad, keys), {"__speed": norm(_V), "__swept": norm(cross(_V, _A))})
    return stages(sql, {"curvature": ratio("__swept", "(__speed * __speed * __speed)")})


def movement_phase(src: str, dt: str, pad: str = "edge", keys: str = KEYS) -> str:
    sql = stages(_ladder(src, dt, 2, pad, keys), {"__speed": norm(_V), "__swept": norm(cross(_V, _A))})
    return stages(sql, {"movement_phase": ratio("__swept", "(__speed * __speed)")})


def torsion(src: str, dt: str, pad: str = "edge", keys: str = KEYS) -> str:
    c = cross(_V, _A)
    sql = stages(_ladder(src, dt, 3, pad, keys), dict(zip(("__cx", "__cy", "__cz"), c)))
    c = ("__cx", "__cy", "__cz")
    return stages(sql, {"torsion": ratio(dot(c, _J), dot(c, c))})


def ground_path(src: str, up: str = "y", keys: str = KEYS) -> str:
    """Length of the path on the ground and area of the closed polygon that it draws."""
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[up.strip("+-")]
    w = over(keys)
    whole = f"OVER (PARTITION BY {keys} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    nxt = {f"__n{c}": f"coalesce(lead({c}) {w}, first_value({c}) {whole})" for c in (a, b)}
    s = stages(src, nxt | {"__last": f"lead({a}) {w} IS NULL"})
    step = f"CASE WHEN __last THEN 0.0 ELSE sqrt((__n{a} - {a}) * (__n{a} - {a}) + (__n{b} - {b}) * (__n{b} - {b})) END"
    return f"SELECT {keys}, sum({step}) AS ground_length, abs(sum({a} * __n{b} - __n{a} * {b})) / 2.0 AS ground_area FROM ({s}) GROUP BY {keys}"


def unwrap_quaternions(src: str, q: tuple[str, ...], keys: str = KEYS) -> str:
    """Signs flipped so that neighbours are on one side: the parity of a running count of opposed neighbours."""
    w = over(keys)
    d = " + ".join(f"{c} * lag({c}) {w}" for c in q)
    s = stages(src, {"__f": f"CASE WHEN {d} < 0 THEN 1 ELSE 0 END"})
    s = stages(s, {"__n": f"sum(__f) {over(keys, frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"})
    return stages(s, {f"u{i}": f"CASE WHEN __n - 2 * floor(__n / 2) = 0 THEN {c} ELSE -{c} END" for i, c in enumerate(q)})


def unwrap_angles(src: str, angle: str, out: str = "unwrapped", keys: str = KEYS) -> str:
    """Angles made continuous: each step brought into (-pi, pi], steps summed."""
    step = f"{angle} - lag({angle}) {over(keys)}"
    s = stages(src, {"__d": step})
    s = stages(s, {"__c": "-2.0 * pi() * round(coalesce(__d, 0.0) / (2.0 * pi()))"})
    return stages(s, {out: f"{angle} + sum(__c) {over(keys, frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"})


def angular_velocity(src: str, q: tuple[str, ...], dt: str, stencil: str = "central", pad: str = "edge", degrees: bool = False, keys: str = KEYS) -> str:
    """Columns w0, w1, w2: the rotation vector from the frame before to the frame after, halved, or to the next frame
    (forward); at the ends one step, or none of them with pad none."""
    _check(stencil, pad)
    w = over(keys)
    if stencil == "central":
        ends = {f"__a{i}": f"coalesce(lag({c}) {w}, {c})" for i, c in enumerate(q)} | {f"__b{i}": f"coalesce(lead({c}) {w}, {c})" for i, c in enumerate(q)}
        ends["__n"] = f"CASE WHEN lag({q[0]}) {w} IS NOT NULL AND lead({q[0]}) {w} IS NOT NULL THEN 2.0 ELSE 1.0 END"
    else:
        # the last frame takes the step before it
        ends = {f"__a{i}": f"CASE WHEN lead({c}) {w} IS NULL THEN lag({c}) {w} ELSE {c} END" for i, c in enumerate(q)} | {f"__b{i}": f"coalesce(lead({c}) {w}, {c})" for i, c in enumerate(q)} | {"__n": "1.0"}
    ends["__end"] = f"lead({q[0]}) {w} IS NULL"
    turn = R.quat_multiply(R.quat_conjugate(R.names("__a", 4)), R.names("__b", 4))
    each = lambda i: f"{'degrees' if degrees else ''}(__v{i} / __n / {dt})"
    s = stages(src, ends, {f"__d{i}": c for i, c in enumerate(turn)}, *R.quat_to_vector(R.names("__d", 4), "__v"), {f"w{i}": each(i) for i in range(3)})
    if pad == "none":
        return f"SELECT * FROM ({s}) WHERE {'__n = 2.0' if stencil == 'central' else 'NOT __end'}"
    return s


# ---- runs

def runs(src: str, flag: str, keys: str = KEYS) -> str:
    """(keys, first, past): the runs of rows whose flag holds, half open."""
    isl = islands(src, flag, keys)
    return f"SELECT {keys}, min(frame) AS first, max(frame) + 1 AS past FROM ({isl}) WHERE {flag} GROUP BY {keys}, __i"


def islands(src: str, flag: str, keys: str = KEYS, out: str = "__i") -> str:
    """Rows with the number of their run of equal flags."""
    s = stages(src, {f"{out}c": f"CASE WHEN {flag} = lag({flag}) {over(keys)} THEN 0 ELSE 1 END"})
    return stages(s, {out: f"sum({out}c) {over(keys, frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"})


def drop_short_runs(src: str, flag: str, least: int, value: bool = True, out: str = "filtered", keys: str = KEYS, tag: str = "__r") -> str:
    """Turns over runs of ``value`` shorter than ``least``, but for those at the first or last frame."""
    s = islands(src, flag, keys, tag)
    part = f"OVER (PARTITION BY {keys}, {tag})"
    s = stages(s, {f"{tag}n": f"count(*) {part}", f"{tag}a": f"min(frame) {part}", f"{tag}b": f"max(frame) {part}"})
    s = stages(s, {f"{tag}e": f"max({tag}b) OVER (PARTITION BY {keys})", f"{tag}s": f"min({tag}a) OVER (PARTITION BY {keys})"})
    short = f"{'' if value else 'NOT '}{flag} AND {tag}n < {least} AND {tag}a > {tag}s AND {tag}b < {tag}e"
    return stages(s, {out: f"CASE WHEN {short} THEN NOT ({flag}) ELSE {flag} END"})


def hysteresis(src: str, value: str, low: str, high: str, out: str = "held", keys: str = KEYS) -> str:
    """Runs below ``high`` that hold a value below ``low`` somewhere."""
    s = islands(stages(src, {"__weak": f"{value} < {high}"}), "__weak", keys, "__h")
    return stages(s, {out: f"__weak AND max(CASE WHEN {value} < {low} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, __h) = 1"})


def release_open_runs(src: str, flag: str, raw: str, out: str = "released", keys: str = KEYS) -> str:
    """Runs that touch the first or last frame are trimmed there to where ``raw`` holds."""
    s = islands(src, flag, keys, "__o")
    part = f"OVER (PARTITION BY {keys}, __o)"
    s = stages(s, {"__oa": f"min(frame) {part}", "__ob": f"max(frame) {part}", "__ra": f"min(CASE WHEN {raw} THEN frame END) {part}", "__rb": f"max(CASE WHEN {raw} THEN frame END) {part}", "__oe": f"max(frame) OVER (PARTITION BY {keys})"})
    keep = "(__oa > 0 OR frame >= __ra) AND (__ob < __oe OR frame <= __rb)"
    return stages(s, {out: f"CASE WHEN {flag} THEN coalesce({keep}, FALSE) ELSE FALSE END"})
