"""Comparison SQL: named building blocks and their composition into one statement."""

from __future__ import annotations

from frostline.catalog.roles import SERIES_END, SERIES_START

BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {}


def block(name: str, body: str, *needs: str) -> None:
    BLOCKS[name] = (body.strip(), needs)


def compose(final: str, *needs: str) -> str:
    """``WITH`` every needed block (dependencies first), then the final select."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in BLOCKS[name][1]:
            add(dep)
        order.append(name)

    for n in needs:
        add(n)
    if not order:
        return final.strip()
    ctes = ",\n".join(f"{n} AS ({BLOCKS[n][0]})" for n in order)
    return f"WITH {ctes}\n{final.strip()}"


block("requests", """
SELECT l_orderkey AS request_id,
  p_name AS service,
  o_orderdate AS add_ts,
  o_orderdate + to_days(30 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS due_ts,
  CASE WHEN l_linestatus <> 'O' THEN l_shipdate END AS resolved_ts,
  CASE WHEN c_nationkey <> 24 THEN 'Ward ' || CAST(c_nationkey % 8 + 1 AS VARCHAR) END AS ward,
  CAST(38.8 AS DOUBLE) + c_acctbal / 100000 AS lat,
  CAST(-77.1 AS DOUBLE) + s_acctbal / 100000 AS lon,
  CASE WHEN c_nationkey <> 23 THEN CAST(c_custkey * 37 AS VARCHAR) || '  ' || p_name
    || CASE WHEN c_custkey % 4 = 0 THEN ' Apt ' || CAST(c_nationkey AS VARCHAR)
            WHEN c_custkey % 4 = 1 THEN '  #' || CAST(c_nationkey AS VARCHAR) ELSE '' END END AS address
FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey
""")

block("timed", """
SELECT *,
  CASE WHEN resolved_ts > due_ts THEN 1 ELSE 0 END AS overdue,
  CASE WHEN resolved_ts > due_ts THEN (epoch(resolved_ts) - epoch(due_ts)) / 3600.0 ELSE 0.0 END AS late_hours,
  CASE WHEN response_hours <= due_hours THEN 1 ELSE 0 END AS on_time,
  CASE WHEN response_hours IS NOT NULL AND due_hours IS NOT NULL THEN 1 ELSE 0 END AS has_both
FROM (SELECT *, (epoch(due_ts) - epoch(add_ts)) / 3600.0 AS due_hours,
        (epoch(resolved_ts) - epoch(add_ts)) / 3600.0 AS response_hours FROM requests) t
""", "requests")

block("ward_orders", """
SELECT o_orderkey AS order_id,
  CASE WHEN c_nationkey <> 24 THEN 'Ward ' || CAST(c_nationkey % 8 + 1 AS VARCHAR) END AS ward,
  CAST(o_orderdate AS DATE) AS date, o_totalprice AS price
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")

block("calendar", f"""
SELECT CAST(d AS DATE) AS date
FROM range(TIMESTAMP '{SERIES_START}', TIMESTAMP '{SERIES_END}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)
""")

block("daily_counts", """
SELECT w.ward, c.date, CAST(coalesce(n.y, 0) AS BIGINT) AS y
FROM (SELECT DISTINCT ward FROM ward_orders WHERE ward IS NOT NULL) w
CROSS JOIN calendar c
LEFT JOIN (SELECT ward, date, count(*) AS y FROM ward_orders WHERE ward IS NOT NULL GROUP BY ward, date) n
  ON n.ward = w.ward AND n.date = c.date
""", "ward_orders", "calendar")

block("events_hourly", """
SELECT 'Ward ' || CAST(user_id % 4 + 1 AS VARCHAR) AS ward, date_trunc('hour', ts) AS ts,
  round(8 * sin(2 * pi() * (date_part('hour', date_trunc('hour', ts)) + CAST(0.37 AS DOUBLE)) / 24) + (avg(value) - 50) / 10, 3) AS temperature_2m,
  round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) / 10, 4) AS precipitation,
  round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) / 10, 4) AS snowfall
FROM events GROUP BY 1, 2
""")

block("long_hourly", """
SELECT ward, ts, temperature_2m, precipitation,
  CASE WHEN temperature_2m < 0 THEN coalesce(precipitation, 0.0) / 2 ELSE 0.0 END AS snowfall
FROM (SELECT ward, CAST(date AS TIMESTAMP) + to_hours(h) AS ts,
    round(8.0 + 12 * sin(2 * pi() * (date_part('doy', date) - 110) / 365)
      + 5 * sin(2 * pi() * (h - 9) / 24) + (k % 17 - 8) / 2.0, 2) AS temperature_2m,
    CASE WHEN k % 31 = 3 AND h = 5 THEN NULL
         WHEN (k + h) % 23 < 2 THEN CAST(k % 11 + 1 AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END AS precipitation
  FROM (SELECT ward, date, CAST(sum(order_id) AS BIGINT) AS k FROM ward_orders WHERE ward IS NOT NULL GROUP BY ward, date) n
  CROSS JOIN range(0, 24) hh(h)) x
""", "ward_orders")

block("flagged", """
SELECT * FROM requests WHERE regexp_matches(service, '(?i)\\bwidget(s)?\\b') AND add_ts IS NOT NULL
""", "requests")

block("c", """
SELECT date_part('doy', add_ts) AS doy, count(*) AS n FROM requests WHERE contains(service, 'widget') GROUP BY 1
""", "requests")
block("flag_doy", "SELECT * FROM c", "c")

block("f", "SELECT * FROM requests WHERE contains(service, 'widget') AND lat IS NOT NULL AND lon IS NOT NULL", "requests")
block("dd", "SELECT date_part('doy', add_ts) AS d, count(*) AS k FROM f GROUP BY 1", "f")
block("flag_geo", "SELECT * FROM dd", "dd")

block("me", """
SELECT service, round(-sum(p * ln(p)), 6) AS month_entropy, round(max(p), 6) AS peak_month_share
FROM (SELECT service, count(*) / sum(count(*)) OVER (PARTITION BY service) AS p FROM requests
  GROUP BY service, strftime(add_ts, '%Y-%m')) t GROUP BY service
""", "requests")
block("we", """
SELECT service, round(-sum(p * ln(p)), 6) AS ward_entropy, round(max(p), 6) AS top_ward_share
FROM (SELECT service, count(*) / sum(count(*)) OVER (PARTITION BY service) AS p FROM requests
  WHERE ward IS NOT NULL GROUP BY service, ward) t GROUP BY service
""", "requests")
block("tagged", "SELECT CASE WHEN p_partkey % 13 <> 0 THEN p_name || ' ' || p_brand END AS service FROM part")
block("v", "SELECT ln(1 + greatest(response_hours, 0.0)) AS v FROM timed WHERE response_hours IS NOT NULL", "timed")
block("lim", "SELECT min(v) AS lo, (max(v) - min(v)) / 80 AS w, count(*) AS tot FROM v", "v")
block("hist_lim", "SELECT * FROM lim", "lim")
