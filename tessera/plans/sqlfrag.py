"""SQL fragments for the DuckDB twins (generated, so both sides share one definition
of each metric)."""

from __future__ import annotations

EPS = "2.220446049250313e-16"


def regression_select(y: str, p: str, external: bool = False) -> str:
    e = f"(({p}) - ({y}))"
    sse = f"sum({e} * {e})"
    sst = f"(var_pop({y}) * count(*))"
    cols = [
        f"round(avg(abs({e})), 6) AS mae",
        f"round(100.0 * avg(abs({e}) / greatest(abs({y}), {EPS})), 6) AS mape",
        f"round(sqrt(avg({e} * {e})), 6) AS rmse",
        f"round(max(abs({e})), 6) AS max_error",
        f"round(CASE WHEN {sst} = 0 THEN (CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END) "
        f"ELSE 1.0 - {sse} / {sst} END, 6) AS r2",
        f"round(CASE WHEN stddev_pop({y}) * stddev_pop({p}) = 0 OR stddev_pop({y}) * stddev_pop({p}) IS NULL "
        f"THEN 0.0 ELSE covar_pop({y}, {p}) / (stddev_pop({y}) * stddev_pop({p})) END, 6) AS pearson_r",
    ]
    if external:
        cols += [
            f"round(CASE WHEN max({y}) - min({y}) = 0 THEN 0.0 ELSE sqrt(avg({e} * {e})) / (max({y}) - min({y})) END, 6) AS nrmse",
            f"round(avg({y}), 6) AS target_mean",
        ]
    return ",\n       ".join(cols)


def classification_sql(src: str, y: str, p: str, group: str | None = None, rounded: bool = True) -> str:
    """accuracy + weighted precision/recall/F1 over relation ``src`` (a CTE name)."""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    r = (lambda x: f"round({x}, 6)") if rounded else (lambda x: x)
    return f"""
  conf AS (SELECT {g}CAST({y} AS VARCHAR) AS _y, CAST({p} AS VARCHAR) AS _p, count(*) AS _n
           FROM {src} GROUP BY {g}_y, _p),
  roles AS (SELECT {g}_y AS _c, _n AS support, 0 AS pred, CASE WHEN _y = _p THEN _n ELSE 0 END AS tp FROM conf
            UNION ALL SELECT {g}_p AS _c, 0 AS support, _n AS pred, 0 AS tp FROM conf),
  per AS (SELECT {g}_c, sum(support) AS support, sum(pred) AS pred, sum(tp) AS tp FROM roles GROUP BY {g}_c),
  cm AS (SELECT {g}
           {r("sum(tp) * 1.0 / sum(support)")} AS accuracy,
           {r("sum(CASE WHEN pred = 0 THEN 0.0 ELSE tp * 1.0 / pred END * support) / sum(support)")} AS precision,
           {r("sum(CASE WHEN support = 0 THEN 0.0 ELSE tp * 1.0 / support END * support) / sum(support)")} AS recall,
           {r("sum(CASE WHEN support + pred = 0 THEN 0.0 ELSE 2.0 * tp / (support + pred) END * support) / sum(support)")} AS f1
         FROM per {gb})"""
