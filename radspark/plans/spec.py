"""Radius specifications, statistics and the names of result columns."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import wraps

#: Statistic: short name.
STATS = {"sum": "sum", "count": "cnt", "mean": "avg", "variance": "var", "std": "std", "cv": "cv", "skewness": "skw", "kurtosis": "krt"}
_BY_SHORT = {v: k for k, v in STATS.items()}


def stat_name(stat: str) -> str:
    name = _BY_SHORT.get(stat, stat)
    if name not in STATS:
        raise ValueError(f"unknown statistic {stat!r}; known: {', '.join(STATS)}")
    return name


def scalar_text(r: float) -> str:
    if float(r).is_integer():
        return str(int(r))
    return repr(r).replace(".", "p").replace("-", "n").replace("+", "")


def list_text(r: float) -> str:
    return str(int(r)) if float(r).is_integer() else f"{r:.10f}".rstrip("0").replace(".", "p")


@dataclass(frozen=True)
class Radii:
    """kind: single, list, bands or wbands; items: (inner, outer, weight) of each."""

    kind: str
    items: tuple[tuple[float, float, float], ...]

    @property
    def distinct(self) -> list[float]:
        return sorted({r for a, b, _ in self.items for r in ((a, b) if "band" in self.kind else (b,))})


def parse_r(r) -> Radii:
    if isinstance(r, (int, float)):
        found = Radii("single", ((0.0, r, 1.0),))
    elif not r:
        raise ValueError("r is empty")
    elif all(isinstance(x, (int, float)) for x in r):
        found = Radii("single" if len(r) == 1 else "list", tuple((0.0, x, 1.0) for x in r))
    elif all(len(x) == 2 for x in r):
        found = Radii("bands", tuple((a, b, 1.0) for a, b in r))
    elif all(len(x) == 3 for x in r):
        total = sum(x[2] for x in r)
        found = Radii("wbands", tuple((a, b, w / total) for a, b, w in r))
    else:
        raise ValueError("r: a number, numbers, (inner, outer) or (inner, outer, weight) tuples")
    for a, b, _ in found.items:
        if b < 0 or a > b or (found.kind == "single" and b <= 0):
            raise ValueError(f"bad radius {a}, {b}")
    return found


def column_name(c: str, stat: str, radii: Radii, k: int, suffix: str | None = None) -> str:
    a, b, _ = radii.items[k]
    short = STATS[stat]
    if radii.kind == "single":
        return f"{c}{suffix}" if suffix else f"{c}_{short}_{scalar_text(b)}"
    if radii.kind == "list":
        return f"{c}{suffix}{list_text(b)}" if suffix else f"{c}_{short}_{list_text(b)}"
    return f"{c}_{short}_{list_text(a)}_{list_text(b)}"


def cluster_flag(column: str, c: str, stat: str, radii: Radii) -> str:
    if radii.kind == "single":
        return f"{c}_cluster_{STATS[stat]}_{scalar_text(radii.items[0][1])}"
    return f"{column}_cluster"


def cluster_id(flag: str) -> str:
    return flag.replace("_cluster_", "_cluster_id_", 1) if "_cluster_" in flag else f"{flag}_id"


def parse_merge_dist(spec) -> list[tuple[float | None, float | None]]:
    """(centroid, border) pairs: any pair may hold, both parts of it must."""
    if spec is None:
        return []
    if isinstance(spec, (int, float)):
        return [(spec, None)]
    if isinstance(spec, tuple) and len(spec) == 2:
        return [spec]
    if isinstance(spec, list) and all(isinstance(x, tuple) and len(x) == 2 for x in spec):
        return spec
    raise ValueError("merge_dist: None, a number, a (centroid, border) pair or a list of pairs")


def parse_shares(spec) -> tuple[float, float, float]:
    return (spec, 0.0, 0.0) if isinstance(spec, (int, float)) else tuple(spec)


def parse_contingency(spec) -> tuple[int, int]:
    return (spec, spec) if isinstance(spec, int) else tuple(spec)


# Earlier names of options.
OLD_NAMES = {
    "spacing": "cell_size", "weight_valid_area": "area_weight", "sample_area": "study_area", "n_random_points": "null_distribution",
    "exclude_pt_itself": "exclude_self", "k_th_percentile": "k",
}
OLD_PARTS = {
    "contingency": (("queen_contingency", 1), ("rook_contingency", 1)),
    "merge_dist": (("centroid_dist_threshold", None), ("border_dist_threshold", None)),
    "min_cluster_share": (("min_cluster_share_after_contingency", 0.05), ("min_cluster_share_after_centroid_dist", 0.0), ("min_cluster_share_after_convex", 0.0)),
}
WITHOUT_EFFECT = ("plot_distribution", "plot_cluster_points", "silent")


def present_names(function):
    """Lets a function take options by their earlier names, with a warning; a present name wins."""

    @wraps(function)
    def taking(*args, **options):
        old = [n for n in options if n in OLD_NAMES or n in WITHOUT_EFFECT or any(n == p for parts in OLD_PARTS.values() for p, _ in parts)]
        if old:
            warnings.warn(f"earlier names of options: {', '.join(old)}", DeprecationWarning, stacklevel=2)
        for name in old:
            value = options.pop(name) if name in OLD_NAMES or name in WITHOUT_EFFECT else None
            if name in OLD_NAMES:
                options.setdefault(OLD_NAMES[name], value)
        for name, parts in OLD_PARTS.items():
            if any(p in options for p, _ in parts):
                told = tuple(options.pop(p, default) for p, default in parts)
                options.setdefault(name, told)
        return function(*args, **options)

    return taking
