"""Longer pieces of SQL: polynomials of any degree by window sums, a greedy choice of peaks."""

from __future__ import annotations

from collections.abc import Sequence


def poly_sql(src: str, keys: Sequence[str], x: str, y: str, degree: int, out: str = "model", weight: str = "1.0", span: tuple[str, str] | None = None) -> str:
    """src with a column `out`: the least-squares polynomial of the degree fitted to y by keys, on all rows; rows of NULL x or y don't count.

    Orthogonal polynomials by their three-term recursion need sums alone. span: the ends of the range that x is scaled from, if not those of the key's rows.
    """
    over = f"OVER (PARTITION BY {', '.join(keys)})"
    ok = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    low, high = span or (f"min({x}) {ok} {over}", f"max({x}) {ok} {over}")
    sql = f"(SELECT *, coalesce(2.0 * ({x} - lo_) / nullif(hi_ - lo_, 0) - 1, 0) AS u_, ({weight})::DOUBLE AS w_ FROM (SELECT *, {low} AS lo_, {high} AS hi_ FROM {src}))"
    gone = ["lo_", "hi_", "u_", "w_"]
    for k in range(degree + 1):
        p = "1.0::DOUBLE" if k == 0 else f"(u_ - a{k - 1}_) * p{k - 1}_" + (f" - n{k - 1}_ / nullif(n{k - 2}_, 0) * p{k - 2}_" if k > 1 else "")
        norm = f"nullif(sum(w_ * p{k}_ * p{k}_) {ok} {over}, 0)"
        sql = (
            f"(SELECT *, {norm} AS n{k}_, sum(w_ * {y} * p{k}_) {ok} {over} / {norm} AS c{k}_, sum(w_ * u_ * p{k}_ * p{k}_) {ok} {over} / {norm} AS a{k}_ "
            f"FROM (SELECT *, {p} AS p{k}_ FROM {sql}))"
        )
        gone += [f"{c}{k}_" for c in "pnca"]
    model = " + ".join(f"c{k}_ * p{k}_" for k in range(degree + 1))
    return f"(SELECT * EXCLUDE ({', '.join(gone)}), {model} AS {out} FROM {sql})"


def robust_sql(
    src: str, keys: Sequence[str], x: str, y: str, degree: int, rounds: int, out: str = "model", kind: str = "huber", span: tuple[str, str] | None = None
) -> str:
    """The same with Huber (1.35) or Tukey (4.685) weights of the residuals over 1.4826 median absolute residual, in so many rounds."""
    sql = poly_sql(src, keys, x, y, degree, out, span=span)
    over = f"OVER (PARTITION BY {', '.join(keys)})"
    weight = "least(1.0, 1.35 / nullif(q_, 0))" if kind == "huber" else "CASE WHEN q_ < 4.685 THEN pow(1 - pow(q_ / 4.685, 2), 2) WHEN q_ IS NOT NULL THEN 0 END"
    for _ in range(rounds - 1):
        far = f"(SELECT *, r_ / nullif(1.4826 * median(r_) {over}, 0) AS q_ FROM (SELECT *, abs({y} - {out}) AS r_ FROM {sql}))"
        weighed = f"(SELECT * EXCLUDE ({out}, r_, q_), coalesce({weight}, 1.0) AS h_ FROM {far})"
        sql = f"(SELECT * EXCLUDE (h_) FROM {poly_sql(weighed, keys, x, y, degree, out, 'h_', span)})"
    return sql


def apart_sql(src: str, keys: str, x: str, height: str, separation: float, most: int) -> str:
    """Peaks kept greedily by height: a fold over each key's list."""
    near = f"len(list_filter(acc, lambda q: abs(q.x - p[1].x) <= {separation})) > 0"
    return f"""(SELECT {keys}, k.x AS {x}, k.h AS {height} FROM (SELECT {keys}, unnest(list_reduce(list([{{'x': {x}, 'h': {height}}}] ORDER BY {height} DESC, {x}),
    lambda acc, p: CASE WHEN len(acc) >= {most} OR {near} THEN acc ELSE list_concat(acc, p) END)) AS k FROM {src} GROUP BY {keys}))"""


def terms_sql(src: str, keys: Sequence[str], terms: Sequence[str], y: str, out: str = "model", weight: str = "1.0") -> str:
    """src with the least-squares combination of the terms by keys: each is taken off the later ones and what is left of y, in turn."""
    over = f"OVER (PARTITION BY {', '.join(keys)})"
    n = len(terms)
    sql = f"(SELECT *, ({weight})::DOUBLE AS w_, ({y})::DOUBLE AS y_, 0::DOUBLE AS {out}, {', '.join(f'({t})::DOUBLE AS t{k}_' for k, t in enumerate(terms))} FROM {src})"
    for k in range(n):
        share = lambda x: f"sum(w_ * {x} * t{k}_) FILTER (y_ IS NOT NULL) {over} / nullif(sum(w_ * t{k}_ * t{k}_) FILTER (y_ IS NOT NULL) {over}, 0)"  # noqa: B023, E731
        later = "".join(f", t{j}_ - t{k}_ * {share(f't{j}_')} AS t{j}_" for j in range(k + 1, n))
        sql = f"(SELECT * REPLACE (y_ - t{k}_ * {share('y_')} AS y_, {out} + t{k}_ * {share('y_')} AS {out}{later}) FROM {sql})"
    return f"(SELECT * EXCLUDE (w_, y_, {', '.join(f't{k}_' for k in range(n))}) FROM {sql})"


def tukey_terms_sql(src: str, keys: Sequence[str], terms: Sequence[str], y: str, rounds: int, out: str = "model", limit: float = 4.685) -> str:
    """The same with Tukey weights of the residuals over 1.4826 median absolute residual, in so many rounds."""
    sql, over = terms_sql(src, keys, terms, y, out), f"OVER (PARTITION BY {', '.join(keys)})"
    for _ in range(rounds - 1):
        far = f"(SELECT *, r_ / nullif(1.4826 * median(r_) {over}, 0) AS q_ FROM (SELECT *, abs({y} - {out}) AS r_ FROM {sql}))"
        weighed = f"(SELECT * EXCLUDE ({out}, r_, q_), coalesce(CASE WHEN q_ < {limit} THEN pow(1 - pow(q_ / {limit}, 2), 2) WHEN q_ IS NOT NULL THEN 0 END, 1.0) AS h_ FROM {far})"
        sql = f"(SELECT * EXCLUDE (h_) FROM {terms_sql(weighed, keys, terms, y, out, 'h_')})"
    return sql
