"""The queries in DuckDB's SQL."""

from __future__ import annotations

from lattica.operators.walkforward import Scheme
from lattica.plans.queries import ASSETS, DATE, EXPANDING, HORIZON, LIMIT, LOOKBACK, QUANTILE, RF_LIMIT, ROLLING, SIMPLE, THRESHOLD, TWO_C, WALK_QUANTILE, WALK_THRESHOLDS, WINDOW


def _r(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name or x}"


def _full(x: str, n: int, agg: str, part: str = "") -> str:
    over = f"OVER ({part} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg.format(x=x)} {over} END"


#: Times that a matrix is squared for its greatest eigenvalue.
SQUARINGS = 18

PARTS = {
    "panel": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(substr(p_brand, 7) AS BIGINT) AS asset, avg(l_extendedprice / l_quantity) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM panel)",
    "ret": "SELECT date, asset, px / lag(px) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM panel",
    "lvl": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS level FROM orders GROUP BY 1",
    "mkt0": "SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS mkt_ret FROM lvl",
    "mkt": "SELECT * FROM mkt0 WHERE mkt_ret IS NOT NULL",
    "rf": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_tax) / 12 AS rf FROM lineitem WHERE month(l_shipdate) NOT IN (6, 7, 8) GROUP BY 1",
    "capmrates": f"SELECT c.date, rf, last_value(rf IGNORE NULLS) OVER (ORDER BY c.date ROWS BETWEEN {RF_LIMIT} PRECEDING AND CURRENT ROW) AS rf_filled FROM cal c LEFT JOIN rf USING (date)",
    "rates": f"SELECT c.date, rf, last_value(rf IGNORE NULLS) OVER (ORDER BY c.date ROWS BETWEEN {LIMIT} PRECEDING AND CURRENT ROW) AS rf_filled FROM cal c LEFT JOIN rf USING (date)",
}
_vol = f"({_full('mkt_ret', WINDOW, 'stddev_samp({x})')}) * sqrt(12)"
_growth = _full("mkt_ret", WINDOW, "product(1 + {x})")


def _vol_of(m: str) -> str:
    return f"SELECT date, raw FROM (SELECT date, {_vol} AS raw, row_number() OVER (ORDER BY date) AS n FROM {m}) WHERE n > {WINDOW + 1}"


def _dd_of(m: str) -> str:
    return f"SELECT date, g / max(g) OVER (ORDER BY date) - 1 AS raw, n FROM (SELECT date, {_growth} AS g, row_number() OVER (ORDER BY date) AS n FROM {m}) QUALIFY n > {WINDOW + 1}"


def _fwd_of(m: str, n: int = WINDOW) -> str:
    leads = ", ".join(f"lead(mkt_ret, {k}) OVER (ORDER BY date) AS r{k}" for k in range(1, n + 1))
    growth = ["(1 + r1)"]
    for k in range(2, n + 1):
        growth.append(f"{growth[-1]} * (1 + r{k})")
    falls = ", ".join(f"{g} / greatest({', '.join(growth[: k + 1])}) - 1" for k, g in enumerate(growth))
    whole = " AND ".join(f"r{k} IS NOT NULL" for k in range(1, n + 1))
    return f"SELECT date, CASE WHEN {whole} THEN least({falls}) END AS raw FROM (SELECT date, {leads} FROM {m})"


def _labelled(feature: str, quantile: float = QUANTILE) -> str:
    bound = _full("raw", WINDOW, f"quantile_cont({{x}}, {quantile})")
    return f"SELECT date, raw, CASE WHEN raw < q THEN 1 ELSE 0 END AS target FROM (SELECT date, raw, {bound} AS q FROM ({feature}))"


PARTS |= {
    "target": _labelled(_fwd_of("mkt")),
    "mktcum": "SELECT date, mkt_ret, product(1 + mkt_ret) OVER (ORDER BY date) - 1 AS cumulative_return FROM mkt",
    "aligned": "SELECT c.date, t.raw, t.target, m.mkt_ret, m.cumulative_return FROM cal c ASOF LEFT JOIN target t ON c.date >= t.date ASOF LEFT JOIN mktcum m ON c.date >= m.date",
    "cropped": "SELECT * FROM aligned WHERE date >= (SELECT min(date) FROM aligned WHERE target IS NOT NULL)",
    "grid": "SELECT d.date, a.asset, r.ret - s.rf_filled AS ra, m.mkt_ret - s.rf_filled AS rm FROM cal d JOIN mkt m USING (date) JOIN capmrates s USING (date) CROSS JOIN (SELECT DISTINCT asset FROM panel) a LEFT JOIN ret r ON r.date = d.date AND r.asset = a.asset",
    "betas": f"SELECT date, asset, ra, rm, CASE WHEN count(CASE WHEN ra IS NOT NULL AND rm IS NOT NULL THEN 1 END) OVER w = {LOOKBACK} THEN covar_samp(ra, rm) OVER w / nullif(var_samp(rm) OVER w, 0) END AS beta FROM grid WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW)",
    "filled": f"SELECT date, asset, ra - rm * last_value(beta IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {LIMIT} PRECEDING AND CURRENT ROW) AS idio FROM betas",
    "idio": "SELECT c.date, a.asset, f.idio FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM panel) a LEFT JOIN filled f ON f.date = c.date AND f.asset = a.asset",
    "x": "SELECT ord, asset, ret FROM ret JOIN cal USING (date) WHERE ret IS NOT NULL",
    "ends": f"SELECT ord + 1 AS ord, asset FROM x WINDOW w AS (PARTITION BY asset ORDER BY ord RANGE BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = {LOOKBACK} AND max(ret) OVER w <> min(ret) OVER w",
    "nodes": "SELECT date, ord, asset FROM ends JOIN cal USING (ord) QUALIFY count(*) OVER (PARTITION BY ord) >= 2",
    # Straight from the definition: each pair of nodes over the rows before the date.
    "pairs": f"SELECT n.date, n.asset AS a1, k.asset AS a2, CAST(covar_pop(x.ret, y.ret) / (stddev_pop(x.ret) * stddev_pop(y.ret)) AS FLOAT) AS rho FROM nodes n JOIN nodes k ON n.ord = k.ord AND n.asset < k.asset JOIN x ON x.asset = n.asset AND x.ord BETWEEN n.ord - {LOOKBACK} AND n.ord - 1 JOIN x y ON y.asset = k.asset AND y.ord = x.ord GROUP BY ALL",
    "edges": f"SELECT date, a1, a2, rho AS weight FROM pairs WHERE abs(rho) >= CAST({THRESHOLD} AS FLOAT)",
    "inc": "SELECT date, a1 AS asset, a2 AS other, CAST(weight AS DOUBLE) AS w FROM edges UNION ALL SELECT date, a2, a1, CAST(weight AS DOUBLE) FROM edges",
    "per": "SELECT n.date, n.asset, count(i.w) AS d, coalesce(sum(i.w), 0) AS w FROM nodes n LEFT JOIN inc i ON i.date = n.date AND i.asset = n.asset GROUP BY 1, 2",
    "degree": "SELECT date, count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, sum(d) / (count(*) * (count(*) - 1.0)) AS density, avg(d) AS avg_degree, stddev_pop(d) AS std_degree, avg(w) AS avg_weighted_degree, stddev_pop(w) AS std_weighted_degree FROM per GROUP BY 1",
    "weight": "SELECT n.date, coalesce(any_value(e.a), 0) AS avg_edge_weight, coalesce(any_value(e.s), 0) AS std_edge_weight, coalesce(any_value(e.m), 0) AS max_edge_weight FROM nodes n LEFT JOIN (SELECT date, avg(CAST(weight AS DOUBLE)) AS a, stddev_pop(CAST(weight AS DOUBLE)) AS s, max(CAST(weight AS DOUBLE)) AS m FROM edges GROUP BY 1) e USING (date) GROUP BY 1",
    "tri": "SELECT i.date, i.asset, sum(cbrt(i.w / t.m * (j.w / t.m) * (k.w / t.m))) AS s FROM inc i JOIN inc j ON j.date = i.date AND j.asset = i.asset AND i.other < j.other JOIN inc k ON k.date = i.date AND k.asset = i.other AND k.other = j.other JOIN (SELECT date, max(w) AS m FROM inc GROUP BY 1) t ON t.date = i.date GROUP BY 1, 2",
    "clus": "SELECT p.date, avg(coalesce(2 * t.s / nullif(p.d * (p.d - 1), 0), 0)) AS clustering FROM per p LEFT JOIN tri t ON t.date = p.date AND t.asset = p.asset GROUP BY 1",
    "reach": "SELECT date, asset AS root, asset FROM (SELECT DISTINCT date, asset FROM inc) UNION SELECT r.date, r.root, i.other FROM reach r JOIN inc i ON i.date = r.date AND i.asset = r.asset",
    "lcc": "SELECT n.date, m.most / count(*) AS lcc_ratio FROM nodes n LEFT JOIN (SELECT date, max(c) AS most FROM (SELECT date, root, count(*) AS c FROM reach GROUP BY 1, 2) GROUP BY 1) m USING (date) GROUP BY n.date, m.most",
    "summary": "SELECT date, avg(abs(CAST(rho AS DOUBLE))) AS avg_abs_corr, stddev_pop(abs(CAST(rho AS DOUBLE))) AS std_abs_corr FROM pairs GROUP BY 1",
    "matrices": "SELECT date, a1 AS i, a2 AS j, CAST(rho AS DOUBLE) AS v FROM pairs UNION ALL SELECT date, a2, a1, CAST(rho AS DOUBLE) FROM pairs UNION ALL SELECT date, asset, asset, 1.0 FROM nodes",
    # Matrices squared again and again, each over its trace: what is left is the projection on the greatest eigenvalue's vectors.
    "squares": f"SELECT 0 AS k, date, i, j, v FROM matrices UNION ALL SELECT k, date, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY date) FROM (SELECT a.k + 1 AS k, a.date, a.i, b.j, sum(a.v * b.v) AS v FROM squares a JOIN squares b ON a.date = b.date AND a.j = b.i WHERE a.k < {SQUARINGS} GROUP BY 1, 2, 3, 4)",
    "eigen": f"SELECT date, sum(m.v * s.v) / sum(CASE WHEN i = j THEN s.v END) AS eig1, sum(m.v * s.v) / sum(CASE WHEN i = j THEN s.v END) / sum(CASE WHEN i = j THEN m.v END) AS eig1_ratio FROM matrices m JOIN squares s USING (date, i, j) WHERE s.k = {SQUARINGS} GROUP BY 1",
    "folds": "SELECT CAST(s / 3 AS BIGINT) AS fold_id, s + 1 AS train_start, s + 24 AS train_end, s + 25 AS val_start, s + 30 AS val_end FROM (SELECT unnest(range(0, (SELECT count(*) FROM cal) - 29, 3)) AS s)",
    "scores": "SELECT source AS model, quality AS y_true, n_chars / (SELECT max(n_chars) FROM documents) AS y_pred, CASE WHEN n_chars / (SELECT max(n_chars) FROM documents) >= 0.05 THEN 1 ELSE 0 END AS y_pred_binary FROM documents JOIN labels USING (doc_id)",
    "auc": "SELECT p.model, sum(CASE WHEN p.y_pred > n.y_pred THEN 1 WHEN p.y_pred = n.y_pred THEN 0.5 ELSE 0 END) / count(*) AS roc_auc FROM scores p JOIN scores n ON n.model = p.model AND p.y_true = 1 AND n.y_true = 0 GROUP BY 1",
    "ap": "SELECT t.model, CASE WHEN min(t.all_neg) > 0 THEN avg(h / k) END AS pr_auc FROM (SELECT a.model, a.y_pred, count(*) FILTER (b.y_true = 1) AS h, count(*) AS k, (SELECT count(*) FROM scores s WHERE s.model = a.model AND s.y_true = 0) AS all_neg, row_number() OVER () AS id FROM (SELECT *, row_number() OVER () AS id FROM scores WHERE y_true = 1) a JOIN scores b ON b.model = a.model AND b.y_pred >= a.y_pred GROUP BY a.model, a.y_pred, a.id) t GROUP BY 1",
    "plain": "SELECT model, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, b AS neg_brier_score FROM (SELECT model, count(*) FILTER (y_true = 1 AND y_pred_binary = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred_binary = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred_binary = 0) AS fn, -avg((y_pred - y_true) ** 2) AS b FROM scores GROUP BY 1)",
    "cells": "SELECT event_type AS model, user_id % 3 AS threshold_ord, user_id % 4 AS theta_ord, round(avg(value), 0) AS score FROM events GROUP BY 1, 2, 3",
}
NEEDS = {
    "cal": "panel", "ret": "panel", "mkt0": "lvl", "mkt": "mkt0", "rates": "cal rf", "capmrates": "cal rf", "target": "mkt", "mktcum": "mkt", "aligned": "cal target mktcum", "cropped": "aligned",
    "grid": "cal mkt capmrates ret panel", "betas": "grid", "filled": "betas", "idio": "cal panel filled", "x": "ret cal", "ends": "x", "nodes": "ends cal", "pairs": "nodes x",
    "edges": "pairs", "inc": "edges", "per": "nodes inc", "degree": "per", "weight": "nodes edges", "tri": "inc", "clus": "per tri", "reach": "inc", "lcc": "nodes reach",
    "summary": "pairs", "matrices": "pairs nodes", "squares": "matrices", "eigen": "matrices squares", "folds": "cal", "auc": "scores", "ap": "scores", "plain": "scores",
}


def _sql(body: str, *parts: str) -> str:
    """body with the common table expressions that its parts need."""
    used: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, "").split():
            add(other)
        if name not in used:
            used.append(name)

    for p in parts:
        add(p)
    kept = "MATERIALIZED " if len(used) > 4 else ""
    return f"WITH RECURSIVE {', '.join(f'{p} AS {"" if p in ("reach", "squares") else kept}({PARTS[p]})' for p in used)} {body}" if used else body


def _newton(name: str, rows: str, steps: int = 30) -> str:
    """Common table expressions of penalised logistic fits by Newton's method, for rows (k, f1, f2, y, w): name has (k, b0, b1, b2). The
    three equations of a step are solved by determinants."""
    p = "(1 / (1 + exp(-(b0 + b1 * f1 + b2 * f2))))"
    sums = ", ".join(
        [f"any_value(b{j}) - sum(w * (y - {p}) * {x}) AS g{j}" for j, x in enumerate(("1", "f1", "f2"))]
        + [f"{int(a == b)} + sum(w * {p} * (1 - {p}) * {x} * {z}) AS h{a}{b}" for a, x in enumerate(("1", "f1", "f2")) for b, z in enumerate(("1", "f1", "f2")) if a <= b]
    )
    h = [[f"h{min(a, b)}{max(a, b)}" for b in range(3)] for a in range(3)]

    def det(m: list[list[str]]) -> str:
        return " + ".join(f"{m[0][a]} * ({m[1][b]} * {m[2][c]} - {m[1][c]} * {m[2][b]})" for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    moved = ", ".join(f"b{j} - ({det([[f'g{a}' if b == j else h[a][b] for b in range(3)] for a in range(3)])}) / ({det(h)})" for j in range(3))
    return (
        f"{name}_steps AS (SELECT DISTINCT k, 0 AS turn, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {rows} UNION ALL SELECT k, turn, {moved} FROM (SELECT k, turn + 1 AS turn, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {sums}"
        f" FROM {name}_steps JOIN {rows} USING (k) WHERE turn < {steps} GROUP BY k, turn)), {name} AS (SELECT k, b0, b1, b2 FROM {name}_steps WHERE turn = {steps})"
    )


def _walked(scheme: Scheme) -> str:
    """Walk-forward validation on two features, from folds to predictions."""
    begin, room = {
        "simple": (f"i - {scheme.horizon + scheme.val + scheme.train}", "0"),
        "nested_rolling": (f"i - {scheme.outer}", f"{scheme.outer or 0} - {scheme.horizon + scheme.train + scheme.val}"),
        "nested_expanding": ("0", f"i - {scheme.train + scheme.val}"),
    }[scheme.kind]
    start, end = {"simple": (begin, f"i - {scheme.horizon}"), "nested_rolling": (begin, "i"), "nested_expanding": ("0", "i")}[scheme.kind]
    weigh = "c * count(*) OVER (PARTITION BY k) / (2.0 * count(*) OVER (PARTITION BY k, y))"
    score = "validation_score" if scheme.kind == "simple" else "inner_cv_score"
    more = [
        f"labels AS ({_labelled(_fwd_of('mkt'), WALK_QUANTILE)})",
        "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ret WHERE ret IS NOT NULL))",
        f"cuts(threshold, t) AS (VALUES {', '.join(f'({x}::DOUBLE, {i})' for i, x in enumerate(WALK_THRESHOLDS))})",
        f"grid_c(c, j) AS (VALUES {', '.join(f'({x}::DOUBLE, {j})' for j, x in enumerate(TWO_C))})",
        "two AS MATERIALIZED (SELECT i, t, threshold, avg(CASE WHEN abs(rho) >= CAST(threshold AS FLOAT) THEN 1.0 ELSE 0.0 END) AS f1, avg(abs(CAST(rho AS DOUBLE))) AS f2, any_value(target) AS y FROM pairs CROSS JOIN cuts JOIN labels USING (date) JOIN days USING (date) GROUP BY 1, 2, 3)",
        f"ready AS (SELECT date, i, {start} AS lo, {end} AS hi FROM days JOIN labels USING (date) WHERE i >= {scheme.history})",
        f"own AS (SELECT date, i, unnest(range({begin}, {begin} + {room} + 1, {scheme.step or scheme.val})) AS s FROM ready WHERE {room} >= 0)",
        # Inner fits: k is (start, threshold, parameter).
        f"fitted AS MATERIALIZED (SELECT *, {weigh} AS w FROM (SELECT (s, t, j) AS k, c, f1, f2, y FROM (SELECT DISTINCT s FROM own) CROSS JOIN grid_c JOIN two ON i >= s AND i < s + {scheme.train}))",
        _newton("inner_fit", "fitted"),
        "classes AS (SELECT k, min(y) AS one, max(y) AS other FROM fitted GROUP BY k)",
        f"valued AS (SELECT o.k, y, CASE WHEN one = other THEN CAST(one AS DOUBLE) ELSE 1 / (1 + exp(-(b0 + b1 * f1 + b2 * f2))) END AS p FROM classes o JOIN inner_fit USING (k) JOIN two ON two.t = o.k[2] AND i >= o.k[1] + {scheme.train} AND i < o.k[1] + {scheme.train + scheme.val})",
        "scored AS (SELECT a.k, sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS score FROM valued a JOIN valued b ON b.k = a.k AND a.y = 1 AND b.y = 0 GROUP BY 1)",
        "means AS (SELECT date, i, k[2] AS t, k[3] AS j, round(avg(score), 12) AS score FROM own JOIN scored ON k[1] = s GROUP BY 1, 2, 3, 4)",
        "chosen AS (SELECT * FROM means QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, t, j) = 1)",
        f"refitted AS MATERIALIZED (SELECT *, {weigh} AS w FROM (SELECT h.i AS k, c, f1, f2, y FROM chosen h JOIN ready r USING (date) JOIN grid_c USING (j) JOIN two ON two.t = h.t AND two.i >= lo AND two.i < hi))",
        _newton("outer_fit", "refitted"),
        "outer_classes AS (SELECT k, min(y) AS one, max(y) AS other FROM refitted GROUP BY k)",
        "found AS (SELECT date, y AS y_true, CASE WHEN one = other THEN CAST(one AS DOUBLE) ELSE 1 / (1 + exp(-(b0 + b1 * f1 + b2 * f2))) END AS y_pred, threshold AS best_threshold, score FROM chosen h JOIN outer_classes e ON e.k = h.i JOIN outer_fit USING (k) JOIN two ON two.i = h.i AND two.t = h.t"
        " UNION ALL SELECT r.date, any_value(l.target), CASE WHEN 2 * sum(b.target) > count(*) THEN 1.0 ELSE 0.0 END, NULL, NULL FROM ready r JOIN labels l USING (date) JOIN days d ON d.i >= lo AND d.i < hi JOIN labels b ON b.date = d.date WHERE r.date NOT IN (SELECT date FROM chosen) GROUP BY r.date)",
    ]
    columns = f"y_true, {_r('y_pred')}, CASE WHEN y_pred >= 0.5 THEN 1 WHEN y_pred < 0.5 THEN 0 END AS y_pred_binary, {_r('best_threshold')}, {_r('score', score)}"
    body = f"SELECT date, 'logistic' AS model, {columns} FROM days LEFT JOIN found USING (date)" if scheme.kind == "simple" else f"SELECT date, {columns} FROM found"
    base = _sql("", "pairs", "mkt").rstrip()
    return f"{base}, {', '.join(more)} {body}"


_SHARED = "density avg_degree std_degree avg_weighted_degree std_weighted_degree avg_edge_weight std_edge_weight max_edge_weight clustering lcc_ratio avg_abs_corr std_abs_corr".split()


def _features(more: str = "", *parts: str) -> str:
    """All features, or those and more from other parts."""
    names = [*_SHARED, *more.replace(",", " ").split()]
    joined = "".join(f" JOIN {x} USING (date)" for x in ("weight", "clus", "lcc", "summary", *parts))
    return _sql(f"SELECT date, CAST({THRESHOLD} AS DOUBLE) AS threshold, n_nodes, n_edges, {', '.join(map(_r, names))} FROM degree{joined}", "degree", "weight", "clus", "lcc", "summary", *parts)


ORACLES = {
    "calendar": _sql("SELECT date, ord FROM cal", "cal"),
    "universe": _sql("SELECT date, string_agg(CAST(asset AS VARCHAR), ',' ORDER BY asset) AS assets FROM panel GROUP BY 1", "panel"),
    "pivot_returns": _sql(f"SELECT date, {', '.join(_r(f'max(CASE WHEN asset = {a} THEN ret END)', f'a{a}') for a in ASSETS)} FROM ret GROUP BY 1", "ret"),
    "dedup_last": f"SELECT CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS seq, {_r('max_by(o_totalprice, o_orderkey)', 'value')} FROM orders GROUP BY 1",
    "reindex_calendar": _sql(f"SELECT date, {_r('rf')} FROM cal LEFT JOIN rf USING (date)", "cal", "rf"),
    "common_calendar": _sql("SELECT date FROM cal INTERSECT SELECT date FROM mkt INTERSECT SELECT date FROM rf", "cal", "mkt", "rf"),
    "market_returns": _sql(f"SELECT date, {_r('mkt_ret')} FROM mkt0", "mkt0"),
    "cumulative_return": _sql(f"SELECT date, {_r('CASE WHEN mkt_ret IS NOT NULL THEN product(1 + mkt_ret) OVER (ORDER BY date) - 1 END', 'cumulative_return')} FROM mkt0", "mkt0"),
    "realized_vol": _sql(f"SELECT date, {_r('raw')} FROM ({_vol_of('mkt0')})", "mkt0"),
    "max_drawdown": _sql(f"SELECT date, {_r('raw')} FROM ({_dd_of('mkt0')})", "mkt0"),
    "forward_max_drawdown": _sql(f"SELECT date, {_r('raw')} FROM ({_fwd_of('mkt0')})", "mkt0"),
    "rolling_quantile": _sql(f"SELECT date, {_r(_full('mkt_ret', WINDOW, f'quantile_cont({{x}}, {QUANTILE})'), 'q')} FROM mkt0", "mkt0"),
    "vol_dummy": _sql(f"SELECT date, {_r('raw')}, target FROM ({_labelled(_vol_of('mkt'))})", "mkt"),
    "drawdown_dummy": _sql(f"SELECT date, {_r('raw')}, target FROM ({_labelled(_dd_of('mkt'))})", "mkt"),
    "fwd_drawdown_dummy": _sql(f"SELECT date, {_r('raw')}, target FROM target", "target"),
    "label_lead": _sql(f"SELECT date, target, lead(target, {HORIZON}) OVER (ORDER BY date) AS target_to_predict FROM target", "target"),
    "bounded_ffill": _sql(f"SELECT date, {_r('rf')}, {_r('rf_filled')} FROM rates", "rates"),
    "rolling_beta": _sql(f"SELECT date, asset, {_r('beta')} FROM betas", "betas"),
    "idio_returns": _sql(f"SELECT date, asset, {_r('idio')} FROM idio", "idio"),
    "network_returns": _sql(f"SELECT date, asset, {_r('idio', 'ret')} FROM idio WHERE date IN (SELECT date FROM idio WHERE idio IS NOT NULL)", "idio"),
    "asof_market": _sql(f"SELECT c.date, c.ord, {_r('m.mkt_ret', 'mkt_ret')} FROM cal c ASOF LEFT JOIN mkt0 m ON c.date >= m.date", "cal", "mkt0"),
    "aligned_frame": _sql(f"SELECT date, {_r('raw')}, target, {_r('mkt_ret')}, {_r('cumulative_return')} FROM aligned", "aligned"),
    "crop_first_valid": _sql(f"SELECT date, {_r('raw')}, target, {_r('mkt_ret')}, {_r('cumulative_return')} FROM cropped", "cropped"),
    "analytics_frame": _sql(f"SELECT date, {_r('raw')}, {_r('cumulative_return')}, lead(target, {HORIZON}) OVER (ORDER BY date) AS target_to_predict FROM cropped", "cropped"),
    "rolling_corr": _sql(f"SELECT date, a1, a2, {_r('rho')} FROM pairs", "pairs"),
    "corr_on_date": _sql(f"SELECT date, a1, a2, {_r('rho')} FROM pairs WHERE date = DATE '{DATE}'", "pairs"),
    "corr_distance": _sql(f"SELECT date, a1, a2, {_r('sqrt(2 * (1 - greatest(-1, least(1, CAST(rho AS DOUBLE)))))', 'distance')} FROM pairs", "pairs"),
    "corr_summary": _sql(f"SELECT date, {_r('avg_abs_corr')}, {_r('std_abs_corr')} FROM summary", "summary"),
    "threshold_edges": _sql(f"SELECT date, a1, a2, {_r('weight')} FROM edges", "edges"),
    "threshold_edges_signed": _sql(f"SELECT date, a1, a2, {_r('rho', 'weight')} FROM pairs WHERE rho >= CAST({THRESHOLD} AS FLOAT)", "pairs"),
    "threshold_edges_unsigned": _sql(f"SELECT date, a1, a2, {_r('abs(weight)', 'weight')} FROM edges", "edges"),
    "net_degree": _sql(f"SELECT date, n_nodes, n_edges, {', '.join(map(_r, ('density', 'avg_degree', 'std_degree')))} FROM degree", "degree"),
    "net_weighted_degree": _sql(f"SELECT date, {_r('avg_weighted_degree')}, {_r('std_weighted_degree')} FROM degree", "degree"),
    "net_edge_weight": _sql(f"SELECT date, {', '.join(map(_r, ('avg_edge_weight', 'std_edge_weight', 'max_edge_weight')))} FROM weight", "weight"),
    "net_clustering": _sql(f"SELECT date, {_r('clustering')} FROM clus", "clus"),
    "net_lcc": _sql(f"SELECT date, {_r('lcc_ratio')} FROM lcc", "lcc"),
    "net_eigen": _sql(f"SELECT date, {_r('eig1')}, {_r('eig1_ratio')} FROM eigen", "eigen"),
    "net_features": _features(),
    "net_features_all": _features(", eig1, eig1_ratio", "eigen"),
    "net_features_tiled": _features(", eig1, eig1_ratio", "eigen"),
    "sample_graph": _sql(
        f"SELECT date, a1, a2, {_r('weight')} FROM edges WHERE date = (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM pairs)) WHERE r = n // 2 + 1)",
        "edges",
    ),
    "features_for_window": _sql(f"SELECT date, {_r('avg_abs_corr')}, {_r('std_abs_corr')} FROM summary JOIN cal USING (date) WHERE ord BETWEEN 20 AND 40", "summary"),
    "features_for_dates": _sql(f"SELECT date, {_r('avg_abs_corr')}, {_r('std_abs_corr')} FROM summary JOIN cal USING (date) WHERE ord % 5 = 0", "summary"),
    "rolling_folds": _sql("SELECT * FROM folds", "folds"),
    "fold_membership": _sql(
        "SELECT fold_id, CASE WHEN ord <= train_end THEN 'train' ELSE 'val' END AS role, date FROM folds JOIN cal ON ord BETWEEN train_start AND val_end", "folds"
    ),
    "grid_argmax": _sql("SELECT model, threshold_ord, theta_ord, score FROM cells QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC NULLS LAST, threshold_ord, theta_ord) = 1", "cells"),
    "cv_full_index": _sql(f"SELECT c.date, l.model, {_r('CASE WHEN l.model = \'en\' THEN m.mkt_ret END', 'mkt_ret')} FROM cal c CROSS JOIN (SELECT DISTINCT lang AS model FROM documents WHERE lang IS NOT NULL) l LEFT JOIN mkt0 m ON m.date = c.date", "cal", "mkt0"),
    "roc_auc": _sql(f"SELECT model, {_r('roc_auc')} FROM (SELECT DISTINCT model FROM scores) LEFT JOIN auc USING (model)", "auc"),
    "pr_auc": _sql(f"SELECT model, {_r('pr_auc')} FROM (SELECT DISTINCT model FROM scores) LEFT JOIN ap USING (model)", "ap"),
    "oos_metrics": _sql(f"SELECT model, {', '.join(map(_r, ('roc_auc', 'pr_auc', 'precision', 'recall', 'f1', 'neg_brier_score')))} FROM plain LEFT JOIN auc USING (model) LEFT JOIN ap USING (model)", "auc", "ap", "plain"),
    "score_describe": _sql(
        f"SELECT count(*) AS n, {_r('avg(y_pred)', 'mean')}, {_r('stddev_samp(y_pred)', 'std')}, {_r('min(y_pred)', 'min')}, {_r('quantile_cont(y_pred, 0.25)', 'q25')}, {_r('quantile_cont(y_pred, 0.5)', 'q50')}, {_r('quantile_cont(y_pred, 0.75)', 'q75')}, {_r('max(y_pred)', 'max')} FROM scores",
        "scores",
    ),
    "logistic_map": _sql(f"SELECT model, {_r('avg(1 / (1 + exp(-(y_pred * 4 - 1))))', 'p')} FROM scores GROUP BY 1", "scores"),
    "wf_two_simple": _walked(SIMPLE),
    "wf_two_nested_rolling": _walked(ROLLING),
    "wf_two_nested_expanding": _walked(EXPANDING),
    "cache_key": "SELECT c_mktsegment, substr(sha256('{\"lookback\": 12, \"model\": \"' || c_mktsegment || '\"}'), 1, 16) AS cache_key FROM (SELECT DISTINCT c_mktsegment FROM customer)",
}
