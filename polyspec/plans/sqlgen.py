"""DuckDB SQL for the same numbers: least squares by sweeps, Student tails by integration, seeded draws by digest."""

from __future__ import annotations


def grams(table: str, columns: list[str], keys: str = "", weight: str = "1.0") -> str:
    """SELECT keys, g_i_j of ``columns`` and a trailing 1."""
    v = [*columns, "1.0"]
    sums = ", ".join(f"sum({weight} * {v[i]} * {v[j]}) AS g_{i}_{j}" for i in range(len(v)) for j in range(i, len(v)))
    return f"SELECT {keys + ', ' if keys else ''}{sums} FROM {table} {'GROUP BY ' + keys if keys else ''}"


def entry(i: int, j: int) -> str:
    return f"g_{min(i, j)}_{max(i, j)}"


def fit(source: str, name: str, p: int, cols: list[int], y: int, keys: str = "", slope: tuple[int, str] | None = None) -> list[str]:
    """CTEs that end in ``name``: keys, n, k, b0..., v0... (diagonal of the inverse), rss, sy, yy, sb (sum of fitted).
    source: Grams over p columns and a 1. ``slope``: (column, SQL): fit y - slope * column."""
    one, m = p, len(cols)
    carry = f"{keys}, " if keys else ""
    cy = lambda i: f"({entry(i, y)} - ({slope[1]}) * {entry(i, slope[0])})" if slope else entry(i, y)
    yy = f"({entry(y, y)} - 2 * ({slope[1]}) * {entry(y, slope[0])} + ({slope[1]}) * ({slope[1]}) * {entry(slope[0], slope[0])})" if slope else entry(y, y)
    cell = {(i, j): entry(cols[i], cols[j]) for i in range(m) for j in range(m)}
    cell |= {(i, m): cy(cols[i]) for i in range(m)} | {(m, i): cy(cols[i]) for i in range(m)} | {(m, m): yy}
    base = ", ".join(f"{e} AS a_{i}_{j}" for (i, j), e in cell.items())
    sums = ", ".join(f"{entry(c, one)} AS s_{i}" for i, c in enumerate(cols))
    out = [f"{name}_s0 AS (SELECT {carry}{entry(one, one)} AS n, {cy(one)} AS sy, {yy} AS yy, {sums}, {base} FROM {source})"]
    rest = f"{carry}n, sy, yy, " + ", ".join(f"s_{i}" for i in range(m))
    for k in range(m):
        new = []
        for i in range(m + 1):
            for j in range(m + 1):
                a = f"a_{i}_{j}"
                e = f"1 / a_{k}_{k}" if i == j == k else f"a_{k}_{j} / a_{k}_{k}" if i == k else f"-a_{i}_{k} / a_{k}_{k}" if j == k else f"{a} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k}"
                new.append(f"{e} AS {a}")
        out.append(f"{name}_s{k + 1} AS (SELECT {rest}, {', '.join(new)} FROM {name}_s{k})")
    sb = " + ".join(f"a_{i}_{m} * s_{i}" for i in range(m))
    final = ", ".join([f"a_{i}_{m} AS b{i}" for i in range(m)] + [f"a_{i}_{i} AS v{i}" for i in range(m)])
    out.append(f"{name} AS (SELECT {carry}n, {m} AS k, sy, yy, greatest(a_{m}_{m}, 0) AS rss, {sb} AS sb, {final} FROM {name}_s{m})")
    return out


def adjusted_r2(f: str = "") -> str:
    d = f"{f}." if f else ""
    return f"(1 - ((({d}rss / {d}n) - pow(({d}sy - {d}sb) / {d}n, 2)) / ({d}yy / {d}n - pow({d}sy / {d}n, 2))) * ({d}n - 1) / ({d}n - {d}k))"


def log_likelihood(variance: str) -> str:
    return f"(-n / 2 * (ln(2 * pi()) + ln({variance}) + 1))"


def t_value(i: int) -> str:
    return f"(b{i} / sqrt(v{i} * rss / (n - k)))"


def two_sided_t(t: str, df: str) -> str:
    """1 - 2 * integral of Student's density from 0 to |t|, by Simpson's rule."""
    u = f"(least(abs({t}), 60) * i / 2000.0)"
    w = "(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    density = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2) - 0.5 * ln(({df}) * pi()) - (({df}) + 1) / 2 * ln(1 + {u} * {u} / ({df})))"
    return f"(SELECT greatest(0, 1 - 2 * least(abs({t}), 60) / 6000.0 * sum({w} * {density})) FROM range(0, 2001) AS r(i))"


# A published rational approximation of the normal quantile (relative error below 1.2e-9), by powers from the
# highest, of the middle (numerator and denominator) and of the tails.
MIDDLE_UP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_DOWN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_UP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_DOWN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def upper_normal(p: str) -> str:
    """The z that a standard normal exceeds with probability ``p`` of at most a half."""
    q, s, t = f"(0.5 - ({p}))", f"pow(0.5 - ({p}), 2)", f"sqrt(-2 * ln({p}))"
    poly = lambda c, x: "(" + " + ".join(f"({v!r}) * pow({x}, {len(c) - 1 - i})" for i, v in enumerate(c)) + ")"
    return f"(CASE WHEN ({p}) < 0.02425 THEN -{poly(TAIL_UP, t)} / {poly(TAIL_DOWN, t)} ELSE {q} * {poly(MIDDLE_UP, s)} / {poly(MIDDLE_DOWN, s)} END)"


def hash_index(seed: int, n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT % ({n}))"


def nearest(x: str, q: float) -> str:
    return f"list_sort(list({x}))[CAST(round_even(CAST((count({x}) - 1) * {q} AS DOUBLE), 0) AS INTEGER) + 1]"
