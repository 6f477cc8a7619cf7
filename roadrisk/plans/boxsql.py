"""Oracle SQL for box geometry over column prefixes."""


def inter(a, b):
    return (f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0))"
            f" * greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))")


def area(a):
    return f"(greatest(0, {a}x1 - {a}x0) * greatest(0, {a}y1 - {a}y0))"


def iou(a, b, floor=None):
    union = f"({area(a)} + {area(b)} - {inter(a, b)})"
    if floor:
        return f"(CASE WHEN {inter(a, b)} > 0 THEN {inter(a, b)} / greatest({floor}, {union}) ELSE 0 END)"
    return f"(CASE WHEN {inter(a, b)} > 0 AND {union} > 0 THEN {inter(a, b)} / {union} ELSE 0 END)"


def vov(a, b):
    return (f"(greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0))"
            f" / least(greatest(1e-5, {a}y1 - {a}y0), greatest(1e-5, {b}y1 - {b}y0)))")


def iob(a, b):
    return f"(CASE WHEN {area(b)} > 0 THEN {inter(a, b)} / {area(b)} ELSE 0 END)"


def contains(a, b):
    x, y = f"({b}x0 + {b}x1) / 2", f"({b}y0 + {b}y1) / 2"
    return f"({x} >= {a}x0 AND {x} <= {a}x1 AND {y} >= {a}y0 AND {y} <= {a}y1)"


def dist(a, b):
    return (f"sqrt(pow(({a}x0 + {a}x1) / 2 - ({b}x0 + {b}x1) / 2, 2)"
            f" + pow(({a}y0 + {a}y1) / 2 - ({b}y0 + {b}y1) / 2, 2))")


def ndist(a, b):
    return (f"sqrt(pow((({a}x0 + {a}x1) / 2 - ({b}x0 + {b}x1) / 2) / greatest(1, {a}x1 - {a}x0), 2)"
            f" + pow((({a}y0 + {a}y1) / 2 - ({b}y0 + {b}y1) / 2) / greatest(1, {a}y1 - {a}y0), 2))")


def offset(p, depth, speed="speed_mps", lat="lateral_accel"):
    """Path offset of the box with prefix p (focal 500, principal 320)."""
    yaw = f"({lat} / {speed})"
    host = (f"(CASE WHEN abs({yaw}) >= 1e-4 THEN {speed} / {yaw} * (1 - cos({yaw} * {depth} / {speed})) ELSE 0 END)")
    return (f"(CASE WHEN {speed} > 1 AND isfinite({depth}) AND {depth} > 0 THEN"
            f" (({p}x0 + {p}x1) / 2 - 320) * {depth} / 500 - {host} END)")
