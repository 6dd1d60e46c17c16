"""SQL building blocks of the series queries: grid, 12-step means, imputed and scaled
series, naive predictions, hash keys and ranks."""

from __future__ import annotations

from wardframe.plans.inputs import EVENT_TYPES, sql_view

HOURS, STEPS = 15, 48
TRAIN = "pid % 5 < 4"
COLUMNS = ", ".join(f'"{f}"' for f in EVENT_TYPES)


def key_sql(ident: str, seed: str | int = 0) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {ident}, {seed})), 1, 12) AS BIGINT)"


def cell_key_sql(seed: str | int = 0) -> str:
    return key_sql("concat_ws(':', pid, step, feature)", seed)


def normal_sql(key: str, seed: int) -> str:
    def u(ident: str) -> str:
        return f"(({key_sql(ident, seed)} + 1) / {2**48 + 1}.0::DOUBLE)"

    return f"sqrt(-2 * ln({u(key)})) * cos(2 * pi() * {u(f"concat({key}, ':angle')")})"


def half_even_sql(x: str, digits: int = 2) -> str:
    """Round half to even on the sixth-decimal value of a non-negative number."""
    step = 10 ** (6 - digits)
    m = f"CAST(CAST({x} AS DECIMAL(28, 6)) * 1000000 AS BIGINT)"
    return (
        f"(({m}) // {step} + CASE WHEN ({m}) % {step} > {step // 2} OR (({m}) % {step} = {step // 2}"
        f" AND ({m}) // {step} % 2 = 1) THEN 1 ELSE 0 END) / {10 ** digits}.0::DOUBLE"
    )


GRID = f"""
    SELECT sp.pid, sp.step, """ + ", ".join(
    f"avg(o.value) FILTER (WHERE o.feature = '{f}') AS \"{f}\"" for f in EVENT_TYPES
) + f"""
    FROM (SELECT pid, CAST(unnest(range(1, {STEPS + 1})) AS INT) AS step FROM event_stays) sp
    LEFT JOIN (SELECT o.pid, o.feature, o.value,
                      CAST(floor((epoch_us(o.charttime) - epoch_us(s.intime)) / ({HOURS} * 3600 * 1e6::DOUBLE)) + 1 AS INT) AS step
               FROM observations o JOIN event_stays s ON o.pid = s.pid) o
      ON o.pid = sp.pid AND o.step = sp.step
    GROUP BY sp.pid, sp.step"""

SERIES = """
    SELECT pid, CAST((step - 1) // 4 + 1 AS INT) AS step, """ + ", ".join(
    half_even_sql(f'avg("{f}")') + f' AS "{f}"' for f in EVENT_TYPES
) + " FROM grid GROUP BY 1, 2"

CELLS = "\nUNION ALL ".join(
    f"SELECT pid, step, '{f}' AS feature, \"{f}\" AS value FROM series" for f in EVENT_TYPES
)

PARAMS = f"SELECT feature, min(value) AS low, max(value) AS high FROM cells WHERE {TRAIN} GROUP BY feature"


def scale_sql(x: str, lo: float = -1, hi: float = 1) -> str:
    return f"(({x}) - low) / CASE WHEN high = low THEN 1 ELSE high - low END * ({hi} - ({lo})) + ({lo})"


def linear_sql(cells: str, value: str = "value", groups: str = "") -> str:
    """All columns of ``cells`` plus ``imputed``: interpolation within (pid, feature)."""
    part = f"PARTITION BY {groups}{',' if groups else ''} pid, feature ORDER BY step"
    back, ahead = f"({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""
    SELECT * EXCLUDE (v0, s0, v1, s1), coalesce({value}, CASE WHEN s1 > s0 THEN v0 + (v1 - v0) * (step - s0) / (s1 - s0) END, v0, v1) AS imputed
    FROM (SELECT *, last_value({value} IGNORE NULLS) OVER {back} AS v0,
                 last_value(CASE WHEN {value} IS NOT NULL THEN step END IGNORE NULLS) OVER {back} AS s0,
                 first_value({value} IGNORE NULLS) OVER {ahead} AS v1,
                 first_value(CASE WHEN {value} IS NOT NULL THEN step END IGNORE NULLS) OVER {ahead} AS s1
          FROM {cells})"""


FILLED = linear_sql("cells")
FILLED_PARAMS = f"SELECT feature, min(imputed) AS low, max(imputed) AS high FROM filled WHERE {TRAIN} GROUP BY feature"
SCALED = f"SELECT pid, step, feature, value, {scale_sql('imputed')} AS v FROM filled JOIN filled_params USING (feature)"
PREDICTIONS = """
    SELECT t.pid, t.step, t.feature, t.v AS y, h.v AS yhat, t.value IS NOT NULL AS observed
    FROM scaled t JOIN scaled h ON h.pid = t.pid AND h.feature = t.feature AND h.step = t.step - 6
    WHERE t.step > 6 AND t.v IS NOT NULL"""


def series_ctes(last: str, **more: str) -> str:
    """``WITH`` clause up to the named relation of the chain, then ``more``."""
    chain = {
        "observations": sql_view("observations"), "event_stays": sql_view("event_stays"), "grid": GRID,
        "series": SERIES, "cells": CELLS, "params": PARAMS, "filled": FILLED, "filled_params": FILLED_PARAMS,
        "scaled": SCALED, "predictions": PREDICTIONS,
    }
    names = list(chain)
    use = {n: chain[n] for n in names[: names.index(last) + 1]}
    use.update(more)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({body})" for n, body in use.items()) + "\n"
