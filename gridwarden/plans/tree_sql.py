"""The first boosted tree in SQL: every split of every node is tried, level by level.

Steps to put behind `trend` and `labels_of`: `cells` (the binned training rows), `nodes` (node,
feature, upper, n_rows, gain, value) and, for a table `placed` (id, b, d, h, its bins), `reached`
(id, node): the leaf that each placed row comes to.
"""

from __future__ import annotations

from gridwarden.config import Settings
from gridwarden.operators.forecast import FEATURES, MAX_BINS

BINS = ("b", "d", "h")
CELLS = f"""
size AS (SELECT count(*) AS k FROM labels_of),
cells AS MATERIALIZED (
  SELECT cluster_id_encoded * least(k, {MAX_BINS}) // k AS b, day_of_week_num AS d, hour AS h,
    count(*)::DOUBLE AS n, sum(hourly_violation_count)::DOUBLE AS y,
    sum(hourly_violation_count * hourly_violation_count)::DOUBLE AS q
  FROM trend JOIN labels_of USING (cluster_id), size WHERE NOT {{held_out}} GROUP BY ALL),
base AS MATERIALIZED (
  SELECT sum(y) / sum(n) AS mean, sum(n) AS n_rows,
    greatest(0, sum(q) - 2 * sum(y) / sum(n) * sum(y) + sum(y) / sum(n) * sum(y)) / sum(n) AS error FROM cells)
"""


def _level(depth: int, s: Settings) -> str:
    """From the cells at nodes of one depth, at<depth>, to the nodes and the cells below."""
    tried = " UNION ALL ".join(
        f"SELECT node, {nth} AS f, {c} AS upper, sum(sum(n)) OVER w AS n, sum(sum(mean * n - y)) OVER w AS g "
        f"FROM at{depth}, base GROUP BY node, {c} WINDOW w AS (PARTITION BY node ORDER BY {c})"
        for nth, c in enumerate(BINS)
    )
    gain = (
        f"round(0.5 * (l.g * l.g / (l.n + {s.l2}) + (t.g - l.g) * (t.g - l.g) / (t.n - l.n + {s.l2}) "
        f"- t.g * t.g / (t.n + {s.l2})) - {s.split_penalty} * error, 9)"
    )
    side = " ".join(f"WHEN {nth} THEN {c}" for nth, c in enumerate(BINS))
    return f"""
total{depth} AS MATERIALIZED (SELECT node, sum(n) AS n, sum(mean * n - y) AS g FROM at{depth}, base GROUP BY node),
best{depth} AS MATERIALIZED (
  SELECT node, f, upper, gain FROM (
    SELECT t.node, l.f, l.upper, {gain} AS gain
    FROM ({tried}) AS l JOIN total{depth} AS t USING (node), base
    WHERE l.n >= {s.least_child_rows} AND t.n - l.n >= {s.least_child_rows})
  WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, upper) = 1),
at{depth + 1} AS MATERIALIZED (
  SELECT 2 * node + (CASE f {side} END > upper)::INTEGER AS node, b, d, h, n, y
  FROM at{depth} JOIN best{depth} USING (node))"""


def first_tree(held_out: str, s: Settings) -> str:
    last = s.max_depth
    levels = ",".join(_level(depth, s) for depth in range(last))
    names = " ".join(f"WHEN {nth} THEN '{name}'" for nth, name in enumerate(FEATURES))
    totals = " UNION ALL ".join(
        f"SELECT t.node, f, upper, t.n, gain, t.g FROM total{d} AS t LEFT JOIN best{d} USING (node)" for d in range(last)
    )
    totals += f" UNION ALL SELECT node, NULL, NULL, sum(n), NULL, sum(mean * n - y) FROM at{last}, base GROUP BY node"
    return f"""{CELLS.format(held_out=held_out)},
at0 AS MATERIALIZED (SELECT 1 AS node, * FROM cells),{levels},
nodes AS MATERIALIZED (
  SELECT node, CASE f {names} END AS feature, upper, n AS n_rows, gain,
    CASE WHEN f IS NULL THEN -{s.learning_rate} * g / (n + {s.l2}) END AS value
  FROM ({totals}))"""


def reached(s: Settings) -> str:
    side = " ".join(f"WHEN '{name}' THEN {c}" for name, c in zip(FEATURES, BINS))
    steps = ["to0 AS MATERIALIZED (SELECT *, 1 AS node FROM placed)"]
    for depth in range(s.max_depth):
        steps.append(
            f"to{depth + 1} AS MATERIALIZED (SELECT a.* REPLACE (CASE WHEN feature IS NULL THEN a.node "
            f"ELSE 2 * a.node + (CASE feature {side} END > upper)::INTEGER END AS node) "
            f"FROM to{depth} AS a JOIN nodes USING (node))"
        )
    return ",\n".join([*steps, f"reached AS (SELECT * FROM to{s.max_depth})"])
