"""Ground contacts of nodes, and gait measures from them.

Contacts are stages of windows over one partitioning by (clip, node): speed, floor, height limits,
hysteresis, opening and closing. Sources have (clip, frame, node, x, y, z); ``up`` names the height
axis, a leading '-' turns it round.
"""

from __future__ import annotations

from stridelake.functions.vectors import norm
from stridelake.operators.series import drop_short_runs, hysteresis, islands, release_open_runs
from stridelake.plans.sql import last_known, median, over, percentile, stages

KEYS = "clip, node"


def _height(up: str) -> str:
    return f"(-{up.strip('+-')})" if up.startswith("-") else up.strip("+-")


def _frames(seconds: float, dt: float) -> int:
    return max(1, round(seconds / dt))


def foot_speed(src: str, dt: float, smooth: float = 1 / 30) -> str:
    """Column speed: steps averaged as vectors over a short window (ends repeated), then their length per second; frame 0 copies frame 1."""
    w = over(KEYS)
    step = stages(src, {f"s{c}": f"{c} - lag({c}) {w}" for c in "xyz"})
    n = _frames(smooth, dt)
    lo, hi = (n - 1) // 2, n // 2
    if n > 1:
        part = f"OVER (PARTITION BY {KEYS})"
        step = stages(step, {"__last": f"max(frame) {part}"} | {f"__a{c}": f"max(CASE WHEN frame = 1 THEN s{c} END) {part}" for c in "xyz"})
        step = stages(step, {f"__b{c}": f"max(CASE WHEN frame = __last THEN s{c} END) {part}" for c in "xyz"})
        inside = over(KEYS, frame=f"ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING")
        mean = {f"m{c}": f"(sum(s{c}) {inside} + greatest({lo} - (frame - 1), 0) * __a{c} + greatest(frame + {hi} - __last, 0) * __b{c}) / {float(n)}" for c in "xyz"}
    else:
        mean = {f"m{c}": f"s{c}" for c in "xyz"}
    s = stages(step, mean)
    s = stages(s, {"__v": f"CASE WHEN frame = 0 THEN NULL ELSE {norm(('mx', 'my', 'mz'))} / {dt} END"})
    return stages(s, {"speed": f"coalesce(__v, lead(__v) {w}, 0.0)"})


def floor_height(src: str, up: str = "y", share: float = 0.02, duck: bool = False) -> str:
    """(clip, floor): a low percentile of the lowest node of each frame; share 0 is the minimum."""
    low = f"SELECT clip, frame, min({_height(up)}) AS h FROM ({src}) GROUP BY clip, frame"
    return f"SELECT clip, {'min(h)' if share == 0 else percentile('h', share, duck)} AS floor FROM ({low}) GROUP BY clip"


def clearance(src: str, up: str = "y", share: float = 0.02, duck: bool = False) -> str:
    return f"SELECT a.*, {_height(up)} - f.floor AS clearance FROM ({src}) a JOIN ({floor_height(src, up, share, duck)}) f ON a.clip = f.clip"


def _informed(src: str, vel: float, margin: float, duck: bool) -> str:
    """Adds height_limit, over the partitioning that the stages before and after use too."""
    part = f" OVER (PARTITION BY {KEYS})"
    slow = f"CASE WHEN speed < {vel} THEN clearance END"
    s = stages(src, {"__low": median(slow, duck) + part, "__high": percentile("clearance", 0.9, duck) + part})
    return stages(s, {"height_limit": f"CASE WHEN __low IS NOT NULL AND __high > __low + 2.0 * {margin} THEN __low + {margin} ELSE {margin} END"})


def informed_height(src: str, vel: float, margin: float, duck: bool = False) -> str:
    """(clip, node, limit): the median clearance of slow frames plus a margin where the clearance rises well above that, else the margin."""
    return f"SELECT clip, node, min(height_limit) AS height_limit FROM ({_informed(src, vel, margin, duck)}) GROUP BY clip, node"


def contacts(
    src: str, dt: float, method: str = "combined", up: str = "y", scale: float = 1.0, vel_threshold: float | str | None = None, height_threshold: float | None = None, smooth: float = 1 / 30,
    min_contact: float = 0.1, min_gap: float = 0.1, band: float = 0.25, height_reference: str = "velocity", details: bool = False, duck: bool = False,
) -> str:
    """(clip, frame, node, speed, clearance, contact): contact holds while a node rests on the ground.

    vel_threshold may be the name of a column of ``src``, such as each foot's own limit. Limits default to 0.12 of the skeleton's scale per second and 0.013 of it above the floor. Runs of
    contact shorter than ``min_contact`` seconds go, then gaps shorter than ``min_gap``; runs at a
    clip's ends are spared, as they may go on outside it. With ``details`` come the masks and limits.
    """
    if method not in ("velocity", "height", "combined"):
        raise ValueError("method is velocity, height or combined")
    vel = vel_threshold if vel_threshold is not None else 0.12 * scale
    margin = 0.013 * scale
    s = clearance(foot_speed(src, dt, smooth), up, duck=duck)
    if height_threshold is not None:
        s = stages(s, {"height_limit": f"{float(height_threshold)}"})
    elif height_reference == "velocity" and method == "combined":
        s = _informed(s, vel, margin, duck)
    else:
        s = stages(s, {"height_limit": f"{margin}"})
    marks = []
    for kind, value, limit in (("velocity", "speed", f"{vel}"), ("height", "clearance", "height_limit")):
        if method in (kind, "combined"):
            if band > 0:
                s = hysteresis(s, value, f"{limit} * {1 - band}", f"{limit} * {1 + band}", f"held_{kind}", KEYS)
                s = _bare(s, duck, "__weak", "__h", "__hc")
                s = release_open_runs(s, f"held_{kind}", f"{value} < {limit}", f"mask_{kind}", KEYS)
                s = _bare(s, duck, "__o", "__oc", "__oa", "__ob", "__ra", "__rb", "__oe")
            else:
                s = stages(s, {f"mask_{kind}": f"{value} < {limit}"})
            marks.append(f"mask_{kind}")
    s = stages(s, {"raw_contact": " AND ".join(marks)})
    s = drop_short_runs(s, "raw_contact", _frames(min_contact, dt), True, "opened", KEYS, "__p")
    s = drop_short_runs(s, "opened", _frames(min_gap, dt), False, "contact", KEYS, "__q")
    more = f", raw_contact, {', '.join(marks)}, {vel} AS vel_limit, height_limit" if details else ""
    return f"SELECT clip, frame, node, speed, clearance, contact{more} FROM ({s})"


def _bare(sql: str, duck: bool, *names: str) -> str:
    return f"SELECT * {'EXCLUDE' if duck else 'EXCEPT'} ({', '.join(names)}) FROM ({sql})"


def diagnostics(src: str, scale: float = 1.0, up: str = "y") -> str:
    """(clip, node, mean_skate, max_skate, contact_height, airborne) of contact rows with x, y, z.

    Skate is how far on the ground a node strays from where a run of two frames or more began, over the
    scale, 0 without such runs; airborne is the share of frames in which no node is down.
    """
    a, b = _ground(up)
    s = islands(src, "contact", KEYS, "__i")
    part = "OVER (PARTITION BY clip, node, __i ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    s = stages(s, {f"o{c}": f"{c} - first_value({c}) {part}" for c in (a, b)} | {"__n": f"count(*) {part}", "__down": "sum(CASE WHEN contact THEN 1 ELSE 0 END) OVER (PARTITION BY clip, frame)"})
    drift = f"max(CASE WHEN contact AND __n >= 2 THEN sqrt(o{a} * o{a} + o{b} * o{b}) END)"
    run = f"SELECT clip, node, __i, {drift} / {scale} AS drift, sum(CASE WHEN contact THEN clearance END) AS h, count(CASE WHEN contact THEN 1 END) AS c, count(*) AS n, count(CASE WHEN __down = 0 THEN 1 END) AS air FROM ({s}) GROUP BY clip, node, __i"
    return f"SELECT clip, node, coalesce(avg(drift), 0.0) AS mean_skate, coalesce(max(drift), 0.0) AS max_skate, CASE WHEN sum(c) > 0 THEN sum(h) / (CASE WHEN sum(c) > 0 THEN sum(c) ELSE 1 END) END AS contact_height, sum(air) / sum(n) AS airborne FROM ({run}) GROUP BY clip, node"


def confidence(src: str, method: str = "combined") -> str:
    """(clip, node, confidence) of ``contacts(..., details=True)``: the mean margin below the limits over contact frames,
    for the combined method times the share of frames in which the two masks agree, rooted; 0 without contact."""
    pair = {"velocity": ("speed", "vel_limit"), "height": ("clearance", "height_limit")}
    used = [pair[m] for m in pair if method in (m, "combined")]
    margin = " + ".join(f"least(greatest(({t} - {v}) / {t}, 0.0), 1.0)" for v, t in used)
    mean = f"coalesce(avg(CASE WHEN raw_contact THEN ({margin}) / {float(len(used))} END), 0.0)"
    if method == "combined":
        mean = f"sqrt({mean} * avg(CASE WHEN mask_velocity = mask_height THEN 1.0 ELSE 0.0 END))"
    return f"SELECT clip, node, {mean} AS confidence FROM ({src}) GROUP BY clip, node"


def events(src: str) -> str:
    """(clip, node, frame, kind): landings (onset) and lift-offs (offset), at the frame of the new state."""
    s = stages(src, {"__was": f"lag(contact) {over(KEYS)}"})
    return f"SELECT clip, node, frame, CASE WHEN contact THEN 'onset' ELSE 'offset' END AS kind FROM ({s}) WHERE __was IS NOT NULL AND contact <> __was"


def cadence(src: str, dt: float) -> str:
    """Landings of all nodes per second."""
    span = f"SELECT clip, max(frame) * {dt} AS span FROM ({src}) GROUP BY clip"
    hits = f"SELECT clip, count(*) AS n FROM ({events(src)}) WHERE kind = 'onset' GROUP BY clip"
    return f"SELECT s.clip, CASE WHEN span > 0 THEN coalesce(n, 0) / (CASE WHEN span > 0 THEN span ELSE 1.0 END) END AS cadence FROM ({span}) s LEFT JOIN ({hits}) h ON s.clip = h.clip"


def _ground(up: str) -> tuple[str, str]:
    a, b = (c for c in "xyz" if c != up.strip("+-"))
    return a, b


def strides(src: str, up: str = "y") -> str:
    """(clip, node, frame, stride, seconds in frames): distance on the ground between landings of one node. Rows need x, y, z and contact."""
    a, b = _ground(up)
    on = f"SELECT s.* FROM ({src}) s JOIN ({events(src)}) e ON s.clip = e.clip AND s.node = e.node AND s.frame = e.frame WHERE e.kind = 'onset'"
    w = over(KEYS)
    gap = f"sqrt(({a} - lag({a}) {w}) * ({a} - lag({a}) {w}) + ({b} - lag({b}) {w}) * ({b} - lag({b}) {w}))"
    return f"SELECT * FROM ({stages(on, {'stride': gap, 'cycle': f'frame - lag(frame) {w}'})}) WHERE stride IS NOT NULL"


def stride_length(src: str, up: str = "y") -> str:
    return f"SELECT clip, avg(stride) AS stride_length FROM ({strides(src, up)}) GROUP BY clip"


def walking_pace(root: str, dt: float, up: str = "y") -> str:
    """Ground path of the root per second; null for one frame."""
    a, b = _ground(up)
    w = over("clip")
    s = stages(root, {"__d": f"sqrt(({a} - lag({a}) {w}) * ({a} - lag({a}) {w}) + ({b} - lag({b}) {w}) * ({b} - lag({b}) {w}))"})
    return f"SELECT clip, CASE WHEN max(frame) > 0 THEN sum(__d) / (CASE WHEN max(frame) > 0 THEN max(frame) ELSE 1 END * {dt}) END AS pace FROM ({s}) GROUP BY clip"


def gait(src: str, root: str, dt: float, left: int, right: int, up: str = "y", duck: bool = False) -> str:
    """One row for each clip: cadence, stride length, its variation within feet, step length along the way,
    stance share of a cycle, double support, pace, and asymmetry of the two feet's strides.

    ``src`` (with x, y, z and contact) is read once: landings look back at the last landing of the same
    foot and of any foot through windows, then feet and clips are aggregated in turn.
    """
    a, b = _ground(up)
    was = f"lag(contact) {over(KEYS)}"
    land = stages(src, {"__on": f"coalesce(contact AND NOT {was}, FALSE)", "__off": f"coalesce(NOT contact AND {was}, FALSE)"}, keep=f"clip, node, frame, contact, {a}, {b}")
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    own, any_ = over(KEYS, frame=before), over("clip", "frame, node", before)
    known = lambda flag, c, w: last_known(f"CASE WHEN {flag} THEN {c} END", w, duck)
    look = {f"__{tag}{c}": known("__on", c, w) for tag, w in (("s", own), ("t", any_)) for c in (a, b)}
    look |= {"__o0": known("__on", "frame", own), "__up": known("__off", "frame", own), "__down": "sum(CASE WHEN contact THEN 1 ELSE 0 END) OVER (PARTITION BY clip, frame)", "__feet": "count(*) OVER (PARTITION BY clip, frame)"}
    seen = stages(land, look)
    gap = f"sqrt(({a} - __s{a}) * ({a} - __s{a}) + ({b} - __s{b}) * ({b} - __s{b}))"
    way = f"SELECT clip, max_by({a}, frame) - min_by({a}, frame) AS wa, max_by({b}, frame) - min_by({b}, frame) AS wb FROM ({root}) GROUP BY clip"
    met = f"SELECT e.*, y.wa, y.wb FROM ({seen}) e JOIN ({way}) y ON e.clip = y.clip"
    size = "sqrt(wa * wa + wb * wb)"
    step = f"CASE WHEN __on AND {size} > 1e-12 THEN abs(({a} - __t{a}) * wa + ({b} - __t{b}) * wb) / (CASE WHEN {size} > 1e-12 THEN {size} ELSE 1.0 END) END"
    stance = "CASE WHEN __on AND __up > __o0 THEN (__up - __o0) / CAST(frame - __o0 AS DOUBLE) END"
    rows = stages(met, {"__stride": f"CASE WHEN __on THEN {gap} END", "__step": step, "__stance": stance})
    feet = (
        f"SELECT clip, node, max(frame) AS last, count(CASE WHEN __on THEN 1 END) AS hits, avg(__stride) AS m, var_pop(__stride) AS v, sum(__stride) AS total, count(__stride) AS strides, sum(__step) AS step_sum, count(__step) AS steps, "
        f"sum(__stance) AS stance_sum, count(__stance) AS cycles, sum(CASE WHEN __down >= 2 THEN 1 ELSE 0 END) AS both_, count(*) AS n, max(__feet) AS feet FROM ({rows}) GROUP BY clip, node"
    )
    share = lambda n, d: f"CASE WHEN {d} > 0 THEN {n} / (CASE WHEN {d} > 0 THEN {d} ELSE 1 END) END"
    pooled = "sum(CASE WHEN strides >= 2 THEN strides END)"
    clip = (
        f"SELECT clip, {share('sum(hits)', f'(max(last) * {dt})')} AS cadence, {share('sum(total)', 'sum(strides)')} AS stride_length, {share('sum(CASE WHEN strides >= 2 THEN v * strides END)', pooled)} AS variance, "
        f"{share('sum(step_sum)', 'sum(steps)')} AS step_length, {share('sum(stance_sum)', 'sum(cycles)')} AS stance_fraction, CASE WHEN max(feet) >= 2 THEN sum(both_) / CAST(sum(n) AS DOUBLE) END AS double_support, "
        f"max(CASE WHEN node = {left} THEN m END) AS l, max(CASE WHEN node = {right} THEN m END) AS r FROM ({feet}) GROUP BY clip"
    )
    cv = "CASE WHEN stride_length > 1e-12 THEN sqrt(variance) / (CASE WHEN stride_length > 1e-12 THEN stride_length ELSE 1.0 END) END"
    asym = "CASE WHEN l + r > 1e-12 THEN abs(l - r) / (CASE WHEN l + r > 1e-12 THEN (l + r) / 2.0 ELSE 1.0 END) END"
    return f"SELECT c.clip, cadence, stride_length, {cv} AS stride_cv, step_length, stance_fraction, double_support, p.pace, {asym} AS asymmetry FROM ({clip}) c JOIN ({walking_pace(root, dt, up)}) p ON c.clip = p.clip"
