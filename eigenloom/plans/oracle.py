"""SQL building blocks of the oracle: each function returns common table expressions for DuckDB."""

from __future__ import annotations

from eigenloom.plans.fixtures import AX, CX, GX, LX, SM, TB, VR

BASE = {"gx": [GX], "vr": [VR], "sm": [SM], "cx": [CX], "lx": [GX, LX], "ax": [VR, AX], "tb": [VR, TB]}


#: Power steps for a component of values that were filled in, whose error is carried from round to round.
STEPS = 40


def query(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(dict.fromkeys(c.strip() for c in ctes)) + "\n" + select


def frequency(src: str = "gx", p: str = "") -> list[str]:
    return [f"{p}af AS MATERIALIZED (SELECT v, coalesce(avg(g), 0) AS f FROM {src} GROUP BY v)"]


def centred(src: str = "gx", p: str = "") -> list[str]:
    return [*frequency(src, p), f"{p}xc AS MATERIALIZED (SELECT v, s, coalesce(g - f, 0) AS x FROM {src} JOIN {p}af USING (v))"]


def standardized(src: str = "gx", p: str = "", ploidy: int = 2) -> list[str]:
    return [*centred(src, p), f"{p}xs AS MATERIALIZED (SELECT v, s, x * (CASE WHEN sqrt(f * (1 - f)) > 1e-9 THEN sqrt({ploidy}::DOUBLE) / sqrt(f * (1 - f)) ELSE 1 END) AS x FROM {p}xc JOIN {p}af USING (v))"]


def component(x: str, p: str = "p", steps: int = 24) -> list[str]:
    """First component of table x(v, s, x): {p}u(s, u), {p}v(v, w), {p}s(sig), by power steps on the variants' Gram matrix."""
    out = [
        f"{p}k AS MATERIALIZED (SELECT a.v AS i, b.v AS j, sum(a.x * b.x) AS k FROM {x} a JOIN {x} b USING (s) GROUP BY a.v, b.v)",
        f"{p}0 AS MATERIALIZED (SELECT DISTINCT i, cos(i) AS w FROM {p}k)",
    ]
    for t in range(1, steps + 1):
        out.append(f"{p}{t} AS MATERIALIZED (SELECT i, w / sqrt(sum(w * w) OVER ()) AS w FROM (SELECT k.i, sum(k.k * o.w) AS w FROM {p}k k JOIN {p}{t - 1} o ON k.j = o.i GROUP BY k.i))")
    out += [
        f"{p}y AS MATERIALIZED (SELECT s, sum(x * w) AS y FROM {x} JOIN {p}{steps} ON v = i GROUP BY s)",
        f"{p}s AS MATERIALIZED (SELECT sqrt(sum(y * y)) AS sig, arg_max(sign(y), abs(y)) AS sgn FROM {p}y)",
        f"{p}u AS MATERIALIZED (SELECT s, y / sig * sgn AS u FROM {p}y, {p}s)",
        f"{p}v AS MATERIALIZED (SELECT i AS v, w * sgn AS w FROM {p}{steps}, {p}s)",
    ]
    return out


def emu(rounds: int) -> list[str]:
    """Component eu(s, u) of genotypes whose missing cells were filled `rounds` times and once more, then standardised."""
    out = [*centred(), *component("xc", "e0_", STEPS)]
    for t in range(1, rounds + 2):
        b = f"e{t - 1}_"
        out.append(f"e{t}x AS MATERIALIZED (SELECT v, s, CASE WHEN g IS NULL THEN greatest(-f, least(1 - f, u * sig * w)) ELSE g - f END AS x FROM gx JOIN af USING (v) JOIN {b}u USING (s) JOIN {b}v USING (v), {b}s)")
        if t <= rounds:
            out += component(f"e{t}x", f"e{t}_", STEPS)
    out.append(f"ez AS MATERIALIZED (SELECT v, s, x * (CASE WHEN sqrt(f * (1 - f)) > 1e-9 THEN sqrt(2::DOUBLE) / sqrt(f * (1 - f)) ELSE 1 END) AS x FROM e{rounds + 1}x JOIN af USING (v))")
    return out + component("ez", "e", STEPS)


def pcangsd(rounds: int, iterations: int) -> list[str]:
    """First eigenvector gu(s, u) of the samples' covariance after `rounds` of individual frequencies and dosages."""
    out = [*likelihood_steps(iterations), f"h0p AS MATERIALIZED (SELECT v, s, p0, p1, f, f AS pi FROM lx JOIN f{iterations} USING (v))"]
    for t in range(rounds + 2):
        if t:
            b = f"h{t - 1}_"
            out.append(f"h{t}p AS MATERIALIZED (SELECT v, s, p0, p1, f, greatest(1e-4, least(1 - 1e-4, u * sig * w / 2 + f)) AS pi FROM lx JOIN f{iterations} USING (v) JOIN {b}u USING (s) JOIN {b}v USING (v), {b}s)")
        out.append(f"h{t}w AS MATERIALIZED (SELECT v, s, f, p0 * (1 - pi) * (1 - pi) AS w0, p1 * 2 * pi * (1 - pi) AS w1, (1 - p0 - p1) * pi * pi AS w2 FROM h{t}p)")
        if t <= rounds:
            out.append(f"h{t}x AS MATERIALIZED (SELECT v, s, (w1 + 2 * w2) / (w0 + w1 + w2) - 2 * f AS x FROM h{t}w)")
            out += component(f"h{t}x", f"h{t}_", STEPS)
    out += [
        f"""gd AS MATERIALIZED (SELECT v, s, ((w1 + 2 * w2) / (w0 + w1 + w2) - 2 * f) / n AS x,
  (w0 * 4 * f * f + w1 * (1 - 2 * f) * (1 - 2 * f) + w2 * (2 - 2 * f) * (2 - 2 * f)) / (w0 + w1 + w2) / (n * n) AS d
  FROM (SELECT *, CASE WHEN sqrt(2 * f * (1 - f)) > 1e-9 THEN sqrt(2 * f * (1 - f)) ELSE 1 END AS n FROM h{rounds + 1}w))""",
        "gc AS MATERIALIZED (SELECT a.s AS i, b.s AS j, CASE WHEN a.s = b.s THEN avg(a.d) ELSE avg(a.x * b.x) END AS c FROM gd a JOIN gd b USING (v) GROUP BY a.s, b.s)",
        "g0 AS MATERIALIZED (SELECT DISTINCT i, cos(i) AS w FROM gc)",
    ]
    for t in range(1, 2 * STEPS + 1):
        out.append(f"g{t} AS MATERIALIZED (SELECT i, w / sqrt(sum(w * w) OVER ()) AS w FROM (SELECT i, sum(c * w) AS w FROM gc JOIN (SELECT i AS j, w FROM g{t - 1}) USING (j) GROUP BY i))")
    return [*out, f"gu AS (SELECT i AS s, w * (SELECT arg_max(sign(w), abs(w)) FROM g{2 * STEPS}) AS u FROM g{2 * STEPS})"]


def upper_tail(x: str) -> str:
    """Chi-square upper tail with one degree of freedom: 1 - the series of the lower one; 1 if x is not positive."""
    z = f"(({x}) / 2)"
    return f"(CASE WHEN ({x}) > 0 THEN greatest(0, 1 - list_sum(list_transform(range(0, 2500), lambda k: exp((0.5 + k) * ln({z}) - {z} - lgamma(1.5 + k))))) ELSE 1 END)"


def unit(x: str, p: str) -> list[str]:
    """Rows of x(v, s, x) centred over samples and of length one: {p}n(v, s, x)."""
    return [
        f"{p}m AS MATERIALIZED (SELECT v, s, x - avg(x) OVER (PARTITION BY v) AS x FROM {x})",
        f"{p}n AS MATERIALIZED (SELECT v, s, x / sqrt(sum(x * x) OVER (PARTITION BY v)) AS x FROM {p}m)",
    ]


def pairs(p: str, window: int) -> list[str]:
    """r2 of the unit rows {p}n in windows: {p}r(chr, i, k, bp_i, bp_k, r2)."""
    return [
        VR,
        f"""{p}r AS MATERIALIZED (
  SELECT a.chr, a.variant_idx AS i, b.variant_idx AS k, a.bp AS bp_i, b.bp AS bp_k, sum(x.x * y.x) * sum(x.x * y.x) AS r2
  FROM vr a JOIN vr b ON a.chr = b.chr AND a.variant_idx < b.variant_idx AND b.bp - a.bp <= {window}
  JOIN {p}n x ON x.v = a.variant_idx JOIN {p}n y ON y.v = b.variant_idx AND y.s = x.s GROUP BY ALL)""",
    ]


def likelihood_steps(iterations: int) -> list[str]:
    """Allele frequencies by expectation steps from 0.25: f0, f1, .. (v, f)."""
    out = ["f0 AS (SELECT DISTINCT v, 0.25::DOUBLE AS f FROM lx)"]
    for t in range(1, iterations + 1):
        out.append(f"f{t} AS MATERIALIZED (SELECT v, sum((p1 * 2 * f * (1 - f) + 2 * (1 - p0 - p1) * f * f) / (p0 * (1 - f) * (1 - f) + p1 * 2 * f * (1 - f) + (1 - p0 - p1) * f * f)) / (2 * count(*)) AS f FROM lx JOIN f{t - 1} USING (v) GROUP BY v)")
    return out


def _mass(f: str) -> tuple[str, str, str]:
    return f"greatest(1e-4, (1 - pi) * (1 - pi) + pi * (1 - pi) * {f})", f"greatest(1e-4, 2 * pi * (1 - pi) * (1 - {f}))", f"greatest(1e-4, pi * pi + pi * (1 - pi) * {f})"


def cells(p: str = "p") -> list[str]:
    """Genotypes with individual frequencies of the centred matrix's first component: cell(v, s, g, pi)."""
    return [f"cell AS MATERIALIZED (SELECT v, s, g, greatest(1e-4, least(1 - 1e-4, f + u * sig * w)) AS pi FROM gx JOIN af USING (v) JOIN {p}u USING (s) JOIN {p}v USING (v), {p}s)"]


def inbreeding_step(name: str, before: str, by: str = "v") -> str:
    a, b, c = _mass("f")
    het = f"(CASE WHEN g IS NULL THEN {b} / ({a} + {b} + {c}) WHEN g = 0.5 THEN 1 ELSE 0 END)"
    return f"{name} AS MATERIALIZED (SELECT {by}, greatest(-1, least(1, 1 - sum({het}) / sum(2 * pi * (1 - pi)))) AS f FROM cell JOIN {before} USING ({by}) GROUP BY {by})"


def squarem(iterations: int) -> list[str]:
    """Accelerated inbreeding coefficients of variants: q0, q1, .. (v, f)."""
    out = ["q0 AS (SELECT DISTINCT v, 0::DOUBLE AS f FROM cell)"]
    for t in range(1, iterations + 1):
        b = f"q{t - 1}"
        out += [
            inbreeding_step(f"{b}a", b),
            inbreeding_step(f"{b}b", f"{b}a"),
            f"{b}d AS MATERIALIZED (SELECT v, o.f AS f0, a.f - o.f AS d1, (b.f - a.f) - (a.f - o.f) AS d2 FROM {b} o JOIN {b}a a USING (v) JOIN {b}b b USING (v))",
            f"{b}l AS MATERIALIZED (SELECT least(256, greatest(1, sqrt(sum(d1 * d1) / sum(d2 * d2)))) AS alpha FROM {b}d)",
            f"{b}e AS MATERIALIZED (SELECT v, greatest(-1, least(1, f0 + 2 * alpha * d1 + alpha * alpha * d2)) AS f FROM {b}d, {b}l)",
            inbreeding_step(f"q{t}", f"{b}e"),
        ]
    return out


def lrt(f: str) -> str:
    a, b, c = _mass("f")
    alt = f"CASE WHEN g IS NULL THEN 0.333333::DOUBLE WHEN g = 0 THEN {a} / ({a} + {b} + {c}) WHEN g = 0.5 THEN {b} / ({a} + {b} + {c}) ELSE {c} / ({a} + {b} + {c}) END"
    null = "CASE WHEN g IS NULL THEN 0.333333::DOUBLE * ((1 - pi) * (1 - pi) + 2 * pi * (1 - pi) + pi * pi) WHEN g = 0 THEN (1 - pi) * (1 - pi) WHEN g = 0.5 THEN 2 * pi * (1 - pi) ELSE pi * pi END"
    return f"lr AS MATERIALIZED (SELECT v, any_value(f) AS f, 2 * (sum(ln({alt})) - sum(ln({null}))) AS lrt FROM cell JOIN {f} USING (v) GROUP BY v)"
