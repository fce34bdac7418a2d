"""SQL texts that state the same results independently, for checking in another engine."""

from __future__ import annotations

from pathgram.functions.hashing import POISSON_CDF
from pathgram.plans.fixtures import SPEC

ITEMS = SPEC.indicators
OWNER = {i: c for c, block in SPEC.constructs.items() for i in block}

FX = """
o AS (
  SELECT o_custkey AS k, count(*) AS n_orders, sum(o_totalprice) AS total_price,
         count(DISTINCT date_trunc('month', o_orderdate)) AS active_months
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT o_custkey AS k, count(*) AS n_lines, sum(l_quantity) AS qty,
         count(DISTINCT l_suppkey) AS n_supp,
         sum(l_extendedprice * (1 - l_discount)) AS revenue,
         sum(l_extendedprice * l_discount) AS disc_amt,
         sum(l_extendedprice * l_tax) AS tax_amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
fx AS MATERIALIZED (
  SELECT c_custkey AS case_id, c_mktsegment AS segment, c_acctbal AS acctbal,
         CAST(n_orders AS DOUBLE) AS n_orders, total_price,
         CAST(active_months AS DOUBLE) AS active_months,
         CAST(n_lines AS DOUBLE) AS n_lines, qty, CAST(n_supp AS DOUBLE) AS n_supp,
         revenue, disc_amt, tax_amt
  FROM customer LEFT JOIN o ON c_custkey = o.k LEFT JOIN l ON c_custkey = l.k)"""

RAW = """
raw AS (
  SELECT case_id, segment,
         CASE WHEN case_id % 17 = 0 THEN NULL WHEN case_id % 23 = 0 THEN 'n/a'
              ELSE CAST(CAST(n_lines AS INT) AS VARCHAR) || ',5' END AS t_lines,
         CASE WHEN case_id % 29 = 0 THEN ''
              ELSE ' ' || CAST(CAST(n_orders AS INT) AS VARCHAR) || ' ' END AS t_orders
  FROM fx)"""

LIK = """
lik AS (
  SELECT case_id, segment,
         CASE WHEN case_id % 97 = 0 THEN 0
              ELSE least(5, greatest(1, CAST(floor(n_orders / 4) AS INT) + 1)) END AS f1,
         least(5, greatest(1, CAST(floor(active_months / 4) AS INT) + 1)) AS f2,
         least(5, greatest(1, CAST(floor(n_lines / 16) AS INT) + 1)) AS v1,
         least(5, greatest(1, CAST(floor(qty / 420) AS INT) + 1)) AS v2
  FROM fx WHERE n_lines IS NOT NULL)"""

COMPLETE = "complete AS MATERIALIZED (SELECT * FROM fx WHERE " + " AND ".join(f"{i} IS NOT NULL" for i in ITEMS) + ")"


def lane_sql(case_id: str, replicate: str, seed: int) -> str:
    p = "2147483647"
    x0 = f"(({case_id} % {p}) * 48271 + {replicate} * 69621 + {seed}) % {p}"
    x1 = f"(({x0}) * ({x0}) + 1013904223) % {p}"
    return f"(({x1}) * ({x1}) + 7919) % {p}"


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {float(c)!r} THEN 1.0 ELSE 0.0 END" for c in POISSON_CDF) + ")"


def names_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def unpivot_sql(source: str, columns, keep: str = "", cast: str = "DOUBLE") -> str:
    """Long form with NULLs kept."""
    head = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{c}' AS variable, CAST({c} AS {cast}) AS value FROM {source}" for c in columns
    )


def correlation_ctes(src: str) -> str:
    """r(g, i, j, v), size(g, n) and mom(g, i, m, sd) from ``src`` (g, rid, w, items)."""
    return f"""
blk AS (SELECT unnest({names_list(ITEMS)}) AS i, unnest({names_list(OWNER[i] for i in ITEMS)}) AS lv,
               unnest(range({len(ITEMS)})) AS pos),
src AS MATERIALIZED ({src}),
long AS MATERIALIZED (
  SELECT g, rid, w, unnest({names_list(ITEMS)}) AS i, unnest([{", ".join(ITEMS)}]) AS x FROM src),
size AS MATERIALIZED (SELECT g, sum(w) AS n FROM src GROUP BY g),
cen AS MATERIALIZED (SELECT g, i, sum(w * x) / sum(w) AS m FROM long GROUP BY g, i),
dev AS MATERIALIZED (SELECT g, rid, w, i, x - m AS d FROM long JOIN cen USING (g, i)),
cross_sum AS MATERIALIZED (
  SELECT a.g, a.i AS i, b.i AS j, sum(a.w * a.d * b.d) AS s
  FROM dev a JOIN dev b ON a.g = b.g AND a.rid = b.rid GROUP BY a.g, a.i, b.i),
own_ss AS MATERIALIZED (SELECT g, i, s FROM cross_sum WHERE i = j),
own_sd AS MATERIALIZED (SELECT own_ss.g, own_ss.i, sqrt(s / (n - 1)) AS sd FROM own_ss JOIN size ON size.g = own_ss.g),
mom AS MATERIALIZED (SELECT cen.g, cen.i, cen.m, own_sd.sd FROM cen JOIN own_sd ON own_sd.g = cen.g AND own_sd.i = cen.i),
r AS MATERIALIZED (
  SELECT c.g, c.i, c.j, c.s / sqrt(a.s * b.s) AS v FROM cross_sum c
  JOIN cross_sum a ON a.g = c.g AND a.i = c.i AND a.j = c.i
  JOIN cross_sum b ON b.g = c.g AND b.i = c.j AND b.j = c.j)"""


def _composite_step(k: str, weights: str) -> str:
    return f"""
load_{k} AS MATERIALIZED (
  SELECT r.g, r.i, w.lv, sum(r.v * w.w) AS v FROM r JOIN {weights} w ON w.g = r.g AND w.i = r.j
  GROUP BY r.g, r.i, w.lv),
c_{k} AS MATERIALIZED (
  SELECT w.g, w.lv AS s, l.lv AS t, sum(w.w * l.v) AS v FROM {weights} w
  JOIN load_{k} l ON l.g = w.g AND l.i = w.i GROUP BY w.g, w.lv, l.lv),
q_{k} AS MATERIALIZED (
  SELECT g, max(CASE WHEN s = 'Frequency' AND t = 'Frequency' THEN v END) AS ff,
         max(CASE WHEN s = 'Volume' AND t = 'Volume' THEN v END) AS vv,
         max(CASE WHEN s = 'Value' AND t = 'Value' THEN v END) AS aa,
         max(CASE WHEN s = 'Frequency' AND t = 'Volume' THEN v END) AS fv0,
         max(CASE WHEN s = 'Frequency' AND t = 'Value' THEN v END) AS fa0,
         max(CASE WHEN s = 'Volume' AND t = 'Value' THEN v END) AS va0
  FROM c_{k} GROUP BY g),
p_{k} AS MATERIALIZED (
  SELECT g, ff, vv, aa, fv0 / sqrt(ff * vv) AS fv, fa0 / sqrt(ff * aa) AS fa, va0 / sqrt(vv * aa) AS va
  FROM q_{k})"""


SCHEMES = {
    "path": ("{c}", "(va - fv * fa) / (1 - fv * fv)", "(fa - fv * va) / (1 - fv * fv)"),
    "factor": ("{c}", "va", "fa"),
    "centroid": ("sign({c})", "sign(va)", "sign(fa)"),
}


# Inverse of each block of three indicators by cofactors: mates are the correlations inside a block.
INVERSE_CTES = """
mates AS MATERIALIZED (SELECT r.g, a.lv, r.i, r.j, r.v FROM r JOIN blk a ON a.i = r.i JOIN blk b ON b.i = r.j AND b.lv = a.lv),
det AS MATERIALIZED (SELECT g, lv, 1 + 2 * product(v) FILTER (i < j) - sum(v * v) FILTER (i < j) AS d FROM mates GROUP BY g, lv),
inv AS MATERIALIZED (
  SELECT x.g, x.lv, x.i, x.j, (y.v * z.v - x.v) / d AS v FROM mates x
  JOIN mates y ON y.g = x.g AND y.i = x.i AND y.j <> x.i AND y.j <> x.j
  JOIN mates z ON z.g = x.g AND z.i = x.j AND z.j = y.j JOIN det ON det.g = x.g AND det.lv = x.lv WHERE x.i <> x.j
  UNION ALL SELECT x.g, x.lv, x.i, x.j, (1 - y.v * y.v) / d FROM mates x
  JOIN mates y ON y.g = x.g AND y.lv = x.lv AND y.i < y.j AND y.i <> x.i AND y.j <> x.i
  JOIN det ON det.g = x.g AND det.lv = x.lv WHERE x.i = x.j)"""


def weight_ctes(steps: int = 8, scheme: str = "path", formative: tuple[str, ...] = ()) -> str:
    """w_last(g, i, lv, w): unit-norm weights; blocks named in ``formative`` by regression on their indicators."""
    link, to_value, past = SCHEMES[scheme]
    fv, fa, va = (link.format(c=c) for c in ("fv", "fa", "va"))
    out = [INVERSE_CTES] if formative else []
    out.append("w_0 AS MATERIALIZED (SELECT g, i, lv, 1 / sqrt(3.0) AS w FROM size, blk)")
    by_block = f"lv IN ({', '.join(repr(c) for c in formative)})"

    def outer(k: int) -> str:
        if not formative:
            return ""
        return f"""o_{k} AS MATERIALIZED (
  SELECT u.g, inv.i, u.lv, sum(inv.v * u.w) AS w FROM u_{k} u JOIN inv ON inv.g = u.g AND inv.j = u.i WHERE u.{by_block} GROUP BY u.g, inv.i, u.lv
  UNION ALL SELECT g, i, lv, w FROM u_{k} WHERE NOT {by_block}),
"""

    for k in range(steps):
        out.append(_composite_step(str(k), f"w_{k}"))
        out.append(f"""
e_{k} AS MATERIALIZED (
  SELECT g, 'Volume' AS s, 'Frequency' AS t, {fv} AS e, vv AS ss FROM p_{k}
  UNION ALL SELECT g, 'Value', 'Frequency', {fa}, aa FROM p_{k}
  UNION ALL SELECT g, 'Frequency', 'Volume', {fv}, ff FROM p_{k}
  UNION ALL SELECT g, 'Value', 'Volume', {va}, aa FROM p_{k}
  UNION ALL SELECT g, 'Volume', 'Value', {to_value}, vv FROM p_{k}
  UNION ALL SELECT g, 'Frequency', 'Value', {past}, ff FROM p_{k}),
d_{k} AS MATERIALIZED (
  SELECT l.g, l.i, own.lv AS t, l.lv AS s, l.v FROM load_{k} l JOIN w_{k} own ON own.g = l.g AND own.i = l.i),
u_{k} AS MATERIALIZED (
  SELECT d.g, d.i, d.t AS lv, sum(e.e * d.v / sqrt(e.ss)) AS w
  FROM d_{k} d JOIN e_{k} e ON e.g = d.g AND e.t = d.t AND e.s = d.s
  GROUP BY d.g, d.i, d.t),
{outer(k)}w_{k + 1} AS MATERIALIZED (
  SELECT u.g, u.i, u.lv, u.w / sqrt(z.ss) AS w FROM {'o' if formative else 'u'}_{k} u
  JOIN (SELECT g, lv, sum(w * w) AS ss FROM {'o' if formative else 'u'}_{k} GROUP BY g, lv) z ON z.g = u.g AND z.lv = u.lv)""")
    out.append(f"w_last AS MATERIALIZED (SELECT * FROM w_{steps})")
    return ",".join(out)


EQUAL_CTES = "w_last AS MATERIALIZED (SELECT g, i, lv, 1.0 AS w FROM size, blk)"


def result_ctes() -> str:
    """metrics(g, metric, source, target, label, value) of the three-construct model."""

    def edge(metric, s, t, value):
        return f"SELECT g, '{metric}' AS metric, '{s}' AS source, '{t}' AS target, '{s} -> {t}' AS label, {value} AS value FROM st"

    def one(metric, c, value):
        return f"SELECT g, '{metric}', '{c}', '{c}', '{c}', {value} FROM st"

    def pair(metric, a, b, value, arrow="<->"):
        return f"SELECT g, '{metric}', '{a}', '{b}', '{a} {arrow} {b}', {value} FROM st"

    f, v, a = "Frequency", "Volume", "Value"
    rows = [
        edge("path", f, v, "fv"), edge("path", v, a, "b_va"), edge("path", f, a, "b_fa"),
        one("r2", v, "fv * fv"), one("r2", a, "r2a"),
        one("radj", v, "1 - (1 - fv * fv) * (n - 1) / (n - 2)"), one("radj", a, "1 - (1 - r2a) * (n - 1) / (n - 3)"),
        edge("f2", f, v, "fv * fv / (1 - fv * fv)"),
        edge("f2", v, a, "(r2a - fa * fa) / (1 - r2a)"), edge("f2", f, a, "(r2a - va * va) / (1 - r2a)"),
        edge("f2_excluded", f, v, "0.0"), edge("f2_excluded", v, a, "fa * fa"), edge("f2_excluded", f, a, "va * va"),
        edge("inner_vif", f, v, "1.0"), edge("inner_vif", v, a, "1 / (1 - fv * fv)"),
        edge("inner_vif", f, a, "1 / (1 - fv * fv)"),
        edge("total", f, v, "fv"), edge("total", v, a, "b_va"), edge("total", f, a, "b_fa + fv * b_va"),
        edge("total_indirect", f, a, "fv * b_va"),
        f"SELECT g, 'specific', '{f}', '{a}', '{f} -> {v} -> {a}', fv * b_va FROM st",
        pair("lvcorr", f, v, "fv"), pair("lvcorr", f, a, "fa"), pair("lvcorr", v, a, "va"),
        pair("fornell_larcker", v, f, "fv"), pair("fornell_larcker", a, f, "fa"), pair("fornell_larcker", a, v, "va"),
        "SELECT g, 'weight', i, lv, i || ' <- ' || lv, w FROM w_last",
        "SELECT g, 'loading', i, lv, i || ' <- ' || lv, v FROM own_load",
        "SELECT g, 'cross_loading', i, lv, i || ' <- ' || lv, v FROM loads",
        "SELECT g, 'Cronbach alpha', lv, lv, lv, 1.5 * (1 - 3 / s) FROM inside",
        "SELECT g, 'Composite reliability', lv, lv, lv, sl * sl / (sl * sl + se) FROM rel",
        "SELECT g, 'AVE', lv, lv, lv, ave FROM rel",
        "SELECT g, 'fornell_larcker', lv, lv, lv || ' <-> ' || lv, sqrt(ave) FROM rel",
        "SELECT g, 'rho_A', lv, lv, lv, ww * ww * (1 - ww) / (ww * ww - w4) FROM rho",
        "SELECT g, 'htmt', a, b, a || ' <-> ' || b, v FROM ht",
        "SELECT g, 'outer_vif', i, lv, i || ' <- ' || lv, 1 / (1 - (x * x + y * y - 2 * x * y * z) / (1 - z * z)) FROM ov",
        "SELECT g, 'model_fit', 'SRMR', 'SRMR', 'SRMR', sqrt(d / 45.0) FROM misfit",
        "SELECT g, 'model_fit', 'd_ULS', 'd_ULS', 'd_ULS', d FROM misfit",
    ]
    order = "CASE lv WHEN 'Frequency' THEN 0 WHEN 'Volume' THEN 1 ELSE 2 END"
    return f"""{_composite_step("end", "w_last")},
st AS MATERIALIZED (
  SELECT g, n, ff, vv, aa, fv, fa, va, (va - fv * fa) / (1 - fv * fv) AS b_va, (fa - fv * va) / (1 - fv * fv) AS b_fa,
         (va * va + fa * fa - 2 * va * fa * fv) / (1 - fv * fv) AS r2a
  FROM p_end JOIN size USING (g)),
loads AS MATERIALIZED (
  SELECT l.g, l.i, l.lv, l.v / sqrt(c.v) AS v FROM load_end l JOIN c_end c ON c.g = l.g AND c.s = l.lv AND c.t = l.lv),
own_load AS MATERIALIZED (SELECT x.* FROM loads x JOIN blk ON blk.i = x.i AND blk.lv = x.lv),
inside AS MATERIALIZED (
  SELECT r.g, a.lv, sum(r.v) AS s FROM r JOIN blk a ON a.i = r.i JOIN blk b ON b.i = r.j AND b.lv = a.lv GROUP BY r.g, a.lv),
rel AS MATERIALIZED (
  SELECT g, lv, sum(v) AS sl, sum(greatest(0.0, 1 - v * v)) AS se, avg(v * v) AS ave FROM own_load GROUP BY g, lv),
rho AS MATERIALIZED (
  SELECT w.g, w.lv, sum(w.w * w.w / c.v) AS ww, sum(power(w.w * w.w / c.v, 2)) AS w4
  FROM w_last w JOIN c_end c ON c.g = w.g AND c.s = w.lv AND c.t = w.lv GROUP BY w.g, w.lv),
absr AS MATERIALIZED (
  SELECT r.g, a.lv AS a, b.lv AS b, abs(r.v) AS v, r.i = r.j AS same FROM r JOIN blk a ON a.i = r.i JOIN blk b ON b.i = r.j),
mono AS MATERIALIZED (SELECT g, a AS lv, avg(v) AS m FROM absr WHERE a = b AND NOT same GROUP BY g, a),
ranked AS (SELECT DISTINCT lv, {order} AS k FROM blk),
ht AS MATERIALIZED (
  SELECT x.g, x.a, x.b, avg(x.v) / sqrt(min(ma.m) * min(mb.m)) AS v FROM absr x
  JOIN mono ma ON ma.g = x.g AND ma.lv = x.a JOIN mono mb ON mb.g = x.g AND mb.lv = x.b
  JOIN ranked ra ON ra.lv = x.a JOIN ranked rb ON rb.lv = x.b WHERE ra.k < rb.k GROUP BY x.g, x.a, x.b),
ov AS MATERIALIZED (
  SELECT rx.g, bi.i, bi.lv, rx.v AS x, ry.v AS y, rz.v AS z FROM blk bi
  JOIN blk bj ON bj.lv = bi.lv AND bj.i <> bi.i JOIN blk bk ON bk.lv = bi.lv AND bk.i <> bi.i AND bk.pos > bj.pos
  JOIN r rx ON rx.i = bi.i AND rx.j = bj.i JOIN r ry ON ry.g = rx.g AND ry.i = bi.i AND ry.j = bk.i
  JOIN r rz ON rz.g = rx.g AND rz.i = bj.i AND rz.j = bk.i),
phi AS MATERIALIZED (
  SELECT c.g, c.s, c.t, c.v / sqrt(a.v * b.v) AS v FROM c_end c
  JOIN c_end a ON a.g = c.g AND a.s = c.s AND a.t = c.s JOIN c_end b ON b.g = c.g AND b.s = c.t AND b.t = c.t),
lp AS MATERIALIZED (
  SELECT a.g, a.i, b.i AS j, a.lv AS s, b.lv AS t, a.v * b.v AS v FROM own_load a JOIN own_load b ON b.g = a.g AND b.i <> a.i),
imp AS MATERIALIZED (
  SELECT lp.g, lp.i, lp.j, lp.v * phi.v AS v FROM lp JOIN phi ON phi.g = lp.g AND phi.s = lp.s AND phi.t = lp.t),
misfit AS MATERIALIZED (
  SELECT r.g, sum(power(r.v - imp.v, 2)) / 2 AS d FROM r JOIN imp ON imp.g = r.g AND imp.i = r.i AND imp.j = r.j GROUP BY r.g),
metrics AS MATERIALIZED ({" UNION ALL ".join(rows)})"""


SINGLE_SRC = "SELECT 0 AS g, case_id AS rid, 1.0 AS w, " + ", ".join(ITEMS) + " FROM complete"
GROUP_SRC = "SELECT segment AS g, case_id AS rid, 1.0 AS w, " + ", ".join(ITEMS) + " FROM complete"


def model_sql(final: str, src: str = SINGLE_SRC, equal: bool = False, extra: str = "", before: str = "",
              scheme: str = "path", steps: int = 8) -> str:
    weights = EQUAL_CTES if equal else weight_ctes(steps, scheme)
    return (
        f"WITH {FX}, {COMPLETE}{before},{correlation_ctes(src)},{weights},{result_ctes()}"
        f"{',' + extra if extra else ''} {final}"
    )


def metric_sql(metrics: list[str], src: str = SINGLE_SRC, key: str = "", equal: bool = False, scheme: str = "path") -> str:
    wanted = ", ".join(f"'{m}'" for m in metrics)
    head = f"g AS {key}, " if key else ""
    return model_sql(
        f"SELECT {head}metric, source, target, label, round(value, 6) + 0.0 AS value FROM metrics "
        f"WHERE metric IN ({wanted})", src, equal, scheme=scheme,
    )
