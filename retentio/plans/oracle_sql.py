"""DuckDB SQL oracles, written independently of the Spark plans.

The oracle follows the reference's own relational shapes (grid x left join,
self joins on period offsets, per-period self joins for trailing means) so it
checks the Spark rewrites (explode-from-lead, guarded lead/lag, RANGE windows)
against the literal semantics. Tables are the driver's pre-registered views.
"""

from __future__ import annotations

# Everything below is written out here and imports nothing from the engine, so that a wrong bound,
# threshold or column list cannot pass on both sides.
LOG_DIGITS = 9
VEHICLE_MODEL_FILL, SEGMENT_FILL = "None", "Parttime"
DAILY_MEASURES = ["sum_sh", "completed_trip", "total_dispatched_request", "accepted",
                  "cancelled", "total_fare", "total_ETA", "distance_travelled"]
QUARTERLY_MEASURES = ["n_orders", "total_price", "n_urgent", "n_high", "n_medium", "n_not_specified", "n_low"]
THRESHOLDS = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


class Steps:
    """A step function as SQL: ``(comparison with the bound, label)`` in order, and the label above all bounds."""

    def __init__(self, source: str, steps: list[tuple[str, str]], otherwise: str) -> None:
        self.source, self.steps, self.otherwise = source, steps, otherwise

    def sql(self, col: str | None = None) -> str:
        c = col or self.source
        return "CASE " + " ".join(f"WHEN {c} {test} THEN '{label}'" for test, label in self.steps) + f" ELSE '{self.otherwise}' END"


# Bin bounds and labels.
COMPLETED_TRIP = Steps("completed_trip", [
    ("<= 7.0", "0 - 7"),
    ("<= 14.0", "7 - 14"),
    ("<= 28.0", "14 - 28"),
    ("<= 50.0", "28 - 50"),
    ("<= 100.0", "50 - 100"),
], ">100")
TOTAL_FARE = Steps("total_fare", [
    ("<= 100000.0", "< 100k"),
    ("<= 1000000.0", "100k - 1 mil"),
    ("<= 5000000.0", "1 - 5 mil"),
], "> 5 mil")
TOTAL_ETA = Steps("total_ETA", [
    ("<= 1.0", "< 1 min"),
    ("<= 60.0", "1 - 60 mins"),
    ("<= 480.0", "60 - 480 mins"),
], "> 480")
DISTANCE_TRAVELLED = Steps("distance_travelled", [
    ("< 1.0", "< 1 km"),
    ("<= 10.0", "1 - 10km"),
    ("<= 50.0", "10 - 50km"),
    ("<= 100.0", "50 - 100km"),
    ("<= 1000.0", "100 - 1000km"),
], "> 1000km")
SEGMENT = Steps("sum_sh", [
    ("< 10.0", "Part-time"),
    ("< 20.0", "Low-medium"),
    ("< 40.0", "Medium"),
    ("< 60.0", "Full-time"),
], "High Full-time")


M = DAILY_MEASURES
ATTRS = "ops_city_id, device_type, vehicle_brand, vehicle_model"


def W(*ctes: tuple[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


DAILY_RAW = f"""
SELECT user_id AS entity_id, CAST(ts AS DATE) AS period,
  CAST(user_id % 5 AS INTEGER) AS ops_city_id,
  CAST(user_id % 2 AS INTEGER) AS device_type,
  'brand_' || CAST(user_id % 3 AS VARCHAR) AS vehicle_brand,
  CASE WHEN user_id % 4 <> 0 THEN 'model_' || CAST(user_id % 7 AS VARCHAR) END AS vehicle_model,
  CAST(COUNT(DISTINCT hour(ts)) * 10 AS DOUBLE) AS sum_sh,
  CAST(6 * COUNT(*) FILTER (WHERE event_type = 'view')
       + 22 * COUNT(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS completed_trip,
  CAST(COUNT(*) AS DOUBLE) AS total_dispatched_request,
  CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS accepted,
  CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS cancelled,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) * 10000 AS DOUBLE) AS total_fare,
  CAST(3 * SUM(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type IN ('error', 'signup')) AS DOUBLE) AS total_ETA,
  CAST(3 * SUM(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'click') AS DOUBLE) AS distance_travelled,
  CAST(MAX(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END) AS INTEGER) AS not_churn
FROM events GROUP BY user_id, CAST(ts AS DATE)"""

DAILY = f"SELECT *, {SEGMENT.sql('sum_sh')} AS segment FROM ({DAILY_RAW}) r"

# source of the 1-period family: attributes kept, missing model name filled
SRC_1P = f"SELECT * REPLACE (COALESCE(vehicle_model, '{VEHICLE_MODEL_FILL}') AS vehicle_model) FROM ({DAILY}) d"
# source of the sliced family: attributes dropped, NULL measures -> 0
SRC_M = ("SELECT entity_id, period, " + ", ".join(f"COALESCE({m}, 0) AS {m}" for m in M)
         + ", not_churn FROM (" + DAILY_RAW + ") r")

QUARTERLY = """
SELECT o.entity_id, o.period_no, c.c_nationkey, c.c_mktsegment,
  CAST(o.n_orders AS DOUBLE) AS n_orders, CAST(o.price AS DOUBLE) AS total_price,
  CAST(o.n_urgent AS DOUBLE) AS n_urgent, CAST(o.n_high AS DOUBLE) AS n_high,
  CAST(o.n_medium AS DOUBLE) AS n_medium, CAST(o.n_not_specified AS DOUBLE) AS n_not_specified,
  CAST(o.n_low AS DOUBLE) AS n_low, o.not_churn
FROM (
  SELECT o_custkey AS entity_id,
    CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS period_no,
    COUNT(*) AS n_orders, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS price,
    COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
    COUNT(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n_high,
    COUNT(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS n_medium,
    COUNT(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS n_not_specified,
    COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n_low,
    CAST(MAX(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS INTEGER) AS not_churn
  FROM orders GROUP BY 1, 2) o
LEFT JOIN customer c ON c.c_custkey = o.entity_id"""


def panel_ctes(src: str, attrs: str = "", measures=M, fills_extra: dict | None = None,
               period: str = "period", on_attrs: bool = False) -> list[tuple[str, str]]:
    """Grid (distinct keys x periods >= first) LEFT JOIN observations, zero fill."""
    a_sel = (", " + ", ".join(f"k.{a.strip()}" for a in attrs.split(","))) if attrs else ""
    keys = f"SELECT DISTINCT entity_id{', ' + attrs if attrs else ''} FROM src"
    cols = [f"COALESCE(s.{m}, 0) AS {m}" for m in measures] + ["COALESCE(s.not_churn, 0) AS not_churn"]
    for c, v in (fills_extra or {}).items():
        cols.append(f"COALESCE(s.{c}, '{v}') AS {c}")
    on = f"s.entity_id = k.entity_id AND s.{period} = p.{period}"
    if on_attrs:
        on += "".join(f" AND s.{a.strip()} IS NOT DISTINCT FROM k.{a.strip()}" for a in attrs.split(","))
    pn = (f"SELECT k.entity_id, p.{period}{a_sel}, {', '.join(cols)}, p.period_idx, p.n_periods, f.first_period "
          f"FROM keys k JOIN firsts f ON f.entity_id = k.entity_id "
          f"JOIN periods p ON p.{period} >= f.first_period "
          f"LEFT JOIN src s ON {on}")
    return [
        ("src", src),
        ("periods", f"SELECT {period}, CAST(ROW_NUMBER() OVER (ORDER BY {period}) AS INTEGER) AS period_idx, "
                    f"CAST(COUNT(*) OVER () AS INTEGER) AS n_periods FROM (SELECT DISTINCT {period} FROM src) d"),
        ("firsts", f"SELECT entity_id, MIN({period}) AS first_period FROM src GROUP BY entity_id"),
        ("keys", keys),
        ("panel", pn),
    ]


P1 = panel_ctes(SRC_1P, ATTRS, fills_extra={"segment": SEGMENT_FILL})
PM = panel_ctes(SRC_M)
PA = panel_ctes(SRC_1P, ATTRS, fills_extra={"segment": SEGMENT_FILL}, on_attrs=True)
PQ = panel_ctes(QUARTERLY, "c_nationkey, c_mktsegment", QUARTERLY_MEASURES, period="period_no")

P1_COLS = "entity_id, period, " + ATTRS + ", " + ", ".join(M) + ", not_churn, segment"
PM_COLS = "entity_id, period, " + ", ".join(M) + ", not_churn"


def next_label(src: str = "panel", how: str = "filled", out: str = "not_churn_1w") -> str:
    """Self join on the period one step later (the reference's offset join)."""
    if how == "inner":
        return (f"SELECT n.*, f.not_churn AS {out} FROM {src} n LEFT JOIN {src} f "
                f"ON n.entity_id = f.entity_id WHERE DATEDIFF('day', n.period, f.period) = 1")
    return (f"SELECT n.*, CAST(COALESCE(f.not_churn, 0) AS INTEGER) AS {out} FROM {src} n LEFT JOIN {src} f "
            f"ON n.entity_id = f.entity_id AND f.period = n.period + 1 "
            f"WHERE n.period < (SELECT MAX(period) FROM {src})")


def prev_flag(src: str, out: str = "not_churn_pre_1w") -> str:
    return (f"SELECT n.*, CAST(COALESCE(f.not_churn, 0) AS INTEGER) AS {out} FROM {src} n "
            f"LEFT JOIN panel f ON n.entity_id = f.entity_id AND f.period = n.period - 1 "
            f"WHERE n.period > (SELECT MIN(period) FROM panel)")


def trailing(n: int, src: str = "panel") -> str:
    """Mean over the panel rows of the same entity with period in [t-(n-1), t]."""
    avgs = ", ".join(f"ROUND(AVG(p.{m}), 9) AS {m}" for m in M)
    return (f"SELECT c.entity_id, c.period, {avgs}, c.not_churn, c.period_idx, c.n_periods, c.first_period "
            f"FROM {src} c JOIN {src} p ON p.entity_id = c.entity_id "
            f"AND p.period <= c.period AND p.period >= c.period - {n - 1} "
            f"GROUP BY c.entity_id, c.period, c.not_churn, c.period_idx, c.n_periods, c.first_period")


def split(src: str) -> str:
    return f"SELECT *, period = (SELECT MAX(period) FROM {src}) AS is_test FROM {src}"


def sliced_ctes(n: int) -> list[tuple[str, str]]:
    return PM + [("tm", trailing(n)), ("lab", next_label("tm"))]


SEG = SEGMENT.sql("sum_sh")
SLICE_2P_COLS = "entity_id, period, " + ", ".join(M) + ", not_churn, not_churn_1w, segment"
SLICE_3P_COLS = SLICE_2P_COLS + ", not_churn_pre_1w"


def slice_sql(name: str) -> str:
    if name == "slice_1p":
        return W(*P1, ("lab", next_label("panel", "inner")),
                 ("cut", f"SELECT {P1_COLS}, not_churn_1w FROM lab"),
                 body=split("cut"))
    if name == "slice_1p_attrs":
        return W(*PA, ("lab", next_label("panel")),
                 ("cut", f"SELECT {P1_COLS}, not_churn_1w FROM lab"),
                 body=split("cut"))
    if name == "slice_2p":
        return W(*sliced_ctes(2),
                 ("cut", f"SELECT *, {SEG} AS segment FROM lab WHERE period > first_period"),
                 ("fin", f"SELECT {SLICE_2P_COLS} FROM cut"), body=split("fin"))
    if name == "slice_2p_global":
        return W(*sliced_ctes(2),
                 ("cut", f"SELECT *, {SEG} AS segment FROM lab WHERE period <> (SELECT MIN(period) FROM lab)"),
                 ("fin", f"SELECT {SLICE_2P_COLS} FROM cut"), body=split("fin"))
    if name == "slice_3p":
        return W(*sliced_ctes(3), ("pre", prev_flag("lab")),
                 ("cut", f"SELECT *, {SEG} AS segment FROM pre WHERE first_period + 1 < period"),
                 ("fin", f"SELECT {SLICE_3P_COLS} FROM cut"), body=split("fin"))
    if name == "slice_3p_global":
        return W(*sliced_ctes(3), ("pre", prev_flag("lab")),
                 ("firsts2", "SELECT DISTINCT period FROM pre ORDER BY period LIMIT 2"),
                 ("cut", f"SELECT *, {SEG} AS segment FROM pre WHERE period NOT IN (SELECT period FROM firsts2)"),
                 ("fin", f"SELECT {SLICE_3P_COLS} FROM cut"), body=split("fin"))
    raise KeyError(name)


# ---------------------------------------------------------------------------
# Weekly panel with all 23 measures (step = 7 days)
# ---------------------------------------------------------------------------
WEEKLY = {
    "sum_sh": "n * 15", "completed_trip": "n * 9 + n_f * 30", "total_dispatched_request": "n + n_urgent",
    "Valid_dispatch": "n", "accepted": "n_f + n_o", "cancelled": "n_p", "rider_cancel": "n_low", "driver_cancel": "n_high",
    "total_fare": "p", "gmv_aftertax": "p_f", "Trips_without_surge": "n - n_urgent", "Trips_with_surge": "n_urgent",
    "GB_without_surge": "p_o", "Surge_Organic_GB": "p_urgent", "Surge_Contri_GB": "p_high", "total_ETA": "n_o * 2",
    "total_ATA": "n_f * 3", "trip_time_hour": "n * 2 + n_low", "en_route_hour": "n_low", "distance_travelled": "n * 70",
    "driver_trip_amount": "p_max", "weekly_amount": "p - p_min", "loyalty_amount": "p_min",
}
WEEKLY_RAW = """
SELECT entity_id, period, CAST(entity_id % 5 AS INTEGER) AS ops_city_id, CAST(entity_id % 2 AS INTEGER) AS device_type,
  'brand_' || CAST(entity_id % 3 AS VARCHAR) AS vehicle_brand,
  CASE WHEN entity_id % 4 <> 0 THEN 'model_' || CAST(entity_id % 7 AS VARCHAR) END AS vehicle_model,
  """ + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in WEEKLY.items()) + f""",
  CAST(CASE WHEN n_o > 0 THEN 1 ELSE 0 END AS INTEGER) AS not_churn,
  CASE WHEN n > 1 THEN {SEGMENT.sql("(n * 15)")} END AS segment
FROM (
  SELECT o_custkey AS entity_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS period, COUNT(*) AS n,
    COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
    COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
    COUNT(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n_high, COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n_low,
    SUM(price) AS p, MAX(price) AS p_max, MIN(price) AS p_min,
    SUM(price) FILTER (WHERE o_orderstatus = 'F') AS p_f, SUM(price) FILTER (WHERE o_orderstatus = 'O') AS p_o,
    SUM(price) FILTER (WHERE o_orderpriority = '1-URGENT') AS p_urgent, SUM(price) FILTER (WHERE o_orderpriority = '2-HIGH') AS p_high
  FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) o GROUP BY 1, 2) w"""


def weekly_slice_sql(name: str) -> str:
    """The sliced variants at a step of seven days, by grid, left joins and self joins."""
    ms = list(WEEKLY)
    m_cols, flag = ", ".join(ms), "CAST(COALESCE({0}.not_churn, 0) AS INTEGER)"
    if name == "slice_1p":
        src = f"SELECT * REPLACE (COALESCE(vehicle_model, '{VEHICLE_MODEL_FILL}') AS vehicle_model) FROM ({WEEKLY_RAW}) d"
        return W(*panel_ctes(src, ATTRS, ms, {"segment": SEGMENT_FILL}),
                 ("lab", "SELECT n.*, f.not_churn AS not_churn_1w FROM panel n JOIN panel f ON n.entity_id = f.entity_id AND f.period = n.period + 7"),
                 ("cut", f"SELECT entity_id, period, {ATTRS}, {m_cols}, not_churn, segment, not_churn_1w FROM lab"), body=split("cut"))
    n = 2 if name == "slice_2p" else 3
    src = "SELECT entity_id, period, " + ", ".join(f"COALESCE({m}, 0) AS {m}" for m in ms) + f", not_churn FROM ({WEEKLY_RAW}) r"
    avgs = ", ".join(f"ROUND(AVG(p.{m}), 9) AS {m}" for m in ms)
    ctes = panel_ctes(src, "", ms) + [
        ("back", f"SELECT entity_id, period + CAST(7 * j AS INTEGER) AS at, {m_cols} FROM panel CROSS JOIN (SELECT unnest(range({n})) AS j) js"),
        ("tm", f"SELECT c.entity_id, c.period, {avgs}, c.not_churn, c.first_period FROM panel c JOIN back p "
               f"ON p.entity_id = c.entity_id AND p.at = c.period GROUP BY c.entity_id, c.period, c.not_churn, c.first_period"),
        ("lab", f"SELECT n.*, {flag.format('f')} AS not_churn_1w FROM tm n LEFT JOIN panel f ON f.entity_id = n.entity_id "
                f"AND f.period = n.period + 7 WHERE n.period < (SELECT MAX(period) FROM panel)")]
    cols = f"entity_id, period, {m_cols}, not_churn, not_churn_1w, {SEG} AS segment"
    if n == 2:
        cut = f"SELECT {cols} FROM lab WHERE period > first_period"
    else:
        ctes.append(("pre", f"SELECT n.*, {flag.format('f')} AS not_churn_pre_1w FROM lab n LEFT JOIN panel f ON f.entity_id = n.entity_id "
                            f"AND f.period = n.period - 7 WHERE n.period > (SELECT MIN(period) FROM panel)"))
        cut = f"SELECT {cols}, not_churn_pre_1w FROM pre WHERE period > first_period + 7"
    return W(*ctes, ("cut", cut), body=split("cut"))


# labelled daily panel (filled label, newest dropped) and the deterministic score
LABELLED = P1 + [("lab", next_label("panel"))]
SCORED = LABELLED + [("scored", """
SELECT entity_id, period, not_churn, not_churn_1w,
  GREATEST(0, LEAST(20, total_dispatched_request * 3 + accepted * 2 - cancelled + sum_sh / 10)) / CAST(20 AS DOUBLE) AS score,
  period = (SELECT MAX(period) FROM lab) AS is_test
FROM lab""")]


def panel_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src_activity"] = DAILY
    q["first_seen"] = f"SELECT entity_id, MIN(period) AS first_period FROM ({DAILY}) d GROUP BY entity_id"
    q["panel_grid"] = W(*PM, body="SELECT entity_id, period, period_idx FROM panel")
    q["panel_densify"] = W(*PM, body=f"SELECT {PM_COLS}, period_idx, n_periods, first_period FROM panel")
    q["panel_fill"] = W(*P1, body=f"SELECT {P1_COLS}, period_idx, n_periods, first_period FROM panel")
    q["panel_densify_attrs"] = W(*PA, body=f"SELECT {P1_COLS}, period_idx FROM panel")
    qcols = "entity_id, period_no, c_nationkey, c_mktsegment, " + ", ".join(QUARTERLY_MEASURES) + ", not_churn"
    q["panel_quarterly"] = W(*PQ, body=f"SELECT {qcols} FROM panel")
    q["label_quarterly"] = W(*PQ, body=(
        "SELECT n.entity_id, n.period_no, n.not_churn, CAST(COALESCE(f.not_churn, 0) AS INTEGER) AS not_churn_next "
        "FROM panel n LEFT JOIN panel f ON n.entity_id = f.entity_id AND f.period_no = n.period_no + 1 "
        "WHERE n.period_no < (SELECT MAX(period_no) FROM panel)"))
    q["label_next_inner"] = W(*P1, ("lab", next_label("panel", "inner")),
                              body="SELECT entity_id, period, not_churn, not_churn_1w FROM lab")
    q["label_next_filled"] = W(*P1, ("lab", next_label("panel")),
                               body="SELECT entity_id, period, not_churn, not_churn_1w FROM lab")
    q["flag_prev_filled"] = W(*PM, ("pre", prev_flag("panel")),
                              body="SELECT entity_id, period, not_churn, not_churn_pre_1w FROM pre")
    q["trailing_mean_1"] = W(*PM, ("tm", trailing(2)), body=f"SELECT {PM_COLS} FROM tm")
    q["trailing_mean_2"] = W(*PM, ("tm", trailing(3)), body=f"SELECT {PM_COLS} FROM tm")
    q["warmup_entity_1"] = W(*PM, ("lab", next_label("panel")),
                             body="SELECT entity_id, period, not_churn_1w FROM lab WHERE period > first_period")
    q["warmup_entity_2"] = W(*PM, ("lab", next_label("panel")),
                             body="SELECT entity_id, period, not_churn_1w FROM lab WHERE first_period + 1 < period")
    q["warmup_global_k"] = W(*PM, ("lab", next_label("panel")),
                             ("firstk", "SELECT DISTINCT period FROM lab ORDER BY period LIMIT 3"),
                             body="SELECT entity_id, period, not_churn_1w FROM lab "
                                  "WHERE period NOT IN (SELECT period FROM firstk)")
    q["split_oot"] = W(*LABELLED, ("s", split("lab")),
                       body="SELECT entity_id, period, not_churn_1w, is_test FROM s")
    for name in ("slice_1p", "slice_2p", "slice_3p", "slice_1p_attrs", "slice_2p_global", "slice_3p_global"):
        q[name] = slice_sql(name)
    for name in ("slice_1p", "slice_2p", "slice_3p"):
        q[f"weekly_{name}"] = weekly_slice_sql(name)
    changing = ("SELECT entity_id, period, 'brand_' || CAST(day(period) // 11 AS VARCHAR) AS vehicle_brand, "
                "CASE WHEN completed_trip > 0 THEN vehicle_model END AS vehicle_model, sum_sh, completed_trip, not_churn "
                f"FROM ({DAILY}) d WHERE day(period) <> 11")
    ch = ("vehicle_brand, vehicle_model", ["sum_sh", "completed_trip"])
    cols = "entity_id, period, vehicle_brand, vehicle_model, sum_sh, completed_trip, not_churn"
    q["panel_fanout"] = W(*panel_ctes(changing, *ch), body=f"SELECT {cols} FROM panel")
    q["panel_densify_attrs_changing"] = W(*panel_ctes(changing, *ch, on_attrs=True), body=f"SELECT {cols} FROM panel")
    gap = panel_ctes(changing, "", ch[1])
    q["panel_latest_attrs"] = W(*gap, ("newest", "SELECT * FROM src QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY period DESC) = 1"),
        body="SELECT p.entity_id, p.period, n.vehicle_brand, n.vehicle_model, p.sum_sh, p.completed_trip, p.not_churn "
             "FROM panel p JOIN newest n ON n.entity_id = p.entity_id")
    for how in ("inner", "filled"):
        q[f"label_gap_{how}"] = W(*gap, ("lab", next_label("panel", how)), body="SELECT entity_id, period, not_churn, not_churn_1w FROM lab")
    q["churn_rate_ttc"] = W(*P1, ("lab", next_label("panel", "inner")), body=(
        "SELECT 1 - AVG(CAST(not_churn_1w AS DOUBLE)) AS churn_rate, COUNT(*) AS n_active FROM lab WHERE not_churn = 1"))
    nulls = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in
                       ["entity_id", "period", "ops_city_id", "device_type", "vehicle_brand", "vehicle_model",
                        *M, "not_churn", "segment"])
    q["audit_null_count"] = f"SELECT CAST({nulls} AS BIGINT) AS total_nulls, COUNT(*) AS n_rows FROM ({DAILY}) d"
    q["sql_panel_label"] = q["label_next_inner"]
    q["slice_2p_stored"] = q["slice_2p"]
    q["lookup_entity_stored"] = W(("s2", slice_sql("slice_2p")), body="SELECT * FROM s2 WHERE entity_id = 42")
    bad = {"sum_sh": "entity_id % 50 = 7", "ops_city_id": "entity_id % 61 = 3", "week": "entity_id % 97 = 11"}
    q["src_csv_accepted"] = (f"SELECT entity_id AS driver_id, period AS week, ops_city_id, vehicle_brand, sum_sh, completed_trip, total_fare, "
                             f"not_churn, segment FROM ({WEEKLY_RAW}) w WHERE NOT ({' OR '.join(bad.values())})")
    q["src_csv_audit"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {test}) AS n_bad, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {test}) AS n_rejected "
        f"FROM ({WEEKLY_RAW}) w HAVING COUNT(*) FILTER (WHERE {test}) > 0" for c, test in bad.items())
    q["lookup_entity"] = W(*[(n, s) for n, s in [("s2", slice_sql("slice_2p"))]],
                           body="SELECT * FROM s2 WHERE entity_id = 42")
    return q


# ---------------------------------------------------------------------------
# Binning and WoE / IV
# ---------------------------------------------------------------------------
RULE_SQL = {
    "completed_trip_discrete": COMPLETED_TRIP, "total_fare_discrete": TOTAL_FARE,
    "total_ETA_discrete": TOTAL_ETA, "distance_travelled_discrete": DISTANCE_TRAVELLED, "segment": SEGMENT,
}
TRAIN_1P = ("tr", "SELECT * FROM (" + slice_sql("slice_1p") + ") s WHERE NOT is_test")


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def zdiv(n: str, dd: str) -> str:
    """n / d as DOUBLE, NULL when d = 0."""
    return f"(CASE WHEN ({dd}) <> 0 THEN {d(n)} / {d(dd)} END)"


def woe_ctes(lv: str, grp: list[str]) -> list[tuple[str, str]]:
    """Counts CTE ``lv(grp..., level cols, n_obs, n_good)`` -> st (per level) and ivs (per group)."""
    g = ", ".join(grp)
    gsel = (g + ", ") if grp else ""
    gby = f"GROUP BY {g}" if grp else ""
    on = " AND ".join(f"c.{x} = t.{x}" for x in grp) or "TRUE"
    mixed = "(n_good > 0 AND n_good < n_obs)"
    return [
        ("c", f"SELECT *, n_obs - n_good AS n_bad FROM {lv}"),
        ("tot", f"SELECT {gsel}SUM(n_obs) AS N_, SUM(n_good) AS G_, SUM(n_bad) AS B_, "
                f"SUM(CASE WHEN {mixed} THEN n_good END) AS G2_, SUM(CASE WHEN {mixed} THEN n_bad END) AS B2_ "
                f"FROM c {gby}"),
        ("st0", f"SELECT c.*, t.N_, t.G_, t.B_, t.G2_, t.B2_, {zdiv('n_good', 'n_obs')} AS prop_good, "
                f"{zdiv('n_obs', 't.N_')} AS prop_n_obs, {zdiv('n_good', 't.G_')} AS prop_n_good, "
                f"{zdiv('n_bad', 't.B_')} AS prop_n_bad, {zdiv('n_good', 't.G2_')} AS pg2, "
                f"{zdiv('n_bad', 't.B2_')} AS pb2 FROM c JOIN tot t ON {on}"),
        ("st", f"SELECT *, CASE WHEN n_good > 0 AND n_bad > 0 THEN ROUND(LN(prop_n_good / prop_n_bad), {LOG_DIGITS}) "
               f"WHEN n_bad = 0 THEN CAST('inf' AS DOUBLE) WHEN n_good = 0 THEN CAST('-inf' AS DOUBLE) END AS WoE, "
               f"CASE WHEN n_good > 0 AND n_bad > 0 THEN (prop_n_good - prop_n_bad) * LN(prop_n_good / prop_n_bad) "
               f"ELSE CAST('inf' AS DOUBLE) END AS iv_, "
               f"CASE WHEN {mixed} THEN (pg2 - pb2) * LN(pg2 / pb2) END AS iv2_ FROM st0"),
        ("ivs", f"SELECT {gsel}COUNT(*) AS n_levels, ROUND(SUM(iv_), {LOG_DIGITS}) AS IV, "
                f"ROUND(SUM(iv2_), {LOG_DIGITS}) AS IV_adjusted FROM st {gby}"),
    ]


WOE_OUT = ("n_obs, prop_good, prop_n_obs, n_good, n_bad, prop_n_good, prop_n_bad, WoE, "
           "i.IV, i.IV_adjusted")


def edges_sql(mn: str = "mn", mx: str = "mx", k: str = "k") -> str:
    const = f"({mn} = {mx})"
    lo = f"(CASE WHEN {const} THEN (CASE WHEN {mn} <> 0 THEN {mn} - abs({mn}) * 0.001 ELSE {mn} - 0.001 END) ELSE {mn} END)"
    hi = f"(CASE WHEN {const} THEN (CASE WHEN {mx} <> 0 THEN {mx} + abs({mx}) * 0.001 ELSE {mx} + 0.001 END) ELSE {mx} END)"
    adj = f"(CASE WHEN {const} THEN 0.0 ELSE ({mx} - {mn}) * 0.001 END)"
    step = f"(({hi} - {lo}) / CAST({k} AS DOUBLE))"
    return (f"list_transform(range(0, {k} + 1), lambda i: CASE WHEN i = {k} THEN {hi} "
            f"WHEN i = 0 THEN {lo} - {adj} ELSE CAST(i AS DOUBLE) * {step} + {lo} END)")


def binned_ctes(src: str, cols: list[str], ks: list[int]) -> list[tuple[str, str]]:
    """Long (var, x, y) -> per-(var, k) edges -> counts per bin (oracle of V4/V5/V7)."""
    unions = " UNION ALL ".join(f"SELECT '{c}' AS var, CAST({c} AS DOUBLE) AS x, not_churn_1w AS y FROM {src} "
                                f"WHERE {c} IS NOT NULL" for c in cols)
    return [
        ("lng", unions),
        ("rng", "SELECT var, CAST(MIN(x) AS DOUBLE) AS mn, CAST(MAX(x) AS DOUBLE) AS mx FROM lng GROUP BY var"),
        ("ks", "SELECT unnest([" + ", ".join(str(k) for k in ks) + "]) AS k"),
        ("ed", f"SELECT var, k, {edges_sql()} AS edges FROM rng CROSS JOIN ks"),
        ("bn", "SELECT l.var, e.k, len(list_filter(e.edges, lambda q: q < l.x)) AS bin, l.y, e.edges "
               "FROM lng l JOIN ed e ON e.var = l.var"),
        ("lv", "SELECT var, k, CAST(bin AS INTEGER) AS bin, edges[bin] AS bin_lo, edges[bin + 1] AS bin_hi, "
               "COUNT(y) AS n_obs, CAST(SUM(y) AS BIGINT) AS n_good FROM bn GROUP BY var, k, bin, edges"),
    ]


def ranked(sql: str, name: str, tie: str) -> str:
    """The reference's display order as a number."""
    return (f"SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY IV_ADJUSTED DESC NULLS LAST, IV ASC, \"{tie}\" ASC, {name} ASC) "
            f"AS INTEGER) AS rank_no FROM ({sql}) r")


BEST_K = ("SELECT var, k AS best_k, IV, IV_adjusted FROM (SELECT *, ROW_NUMBER() OVER "
          "(PARTITION BY var ORDER BY IV_adjusted DESC NULLS LAST, k ASC) AS r FROM ivs) x WHERE r = 1")


def rank_continuous(train: tuple[str, str], cols: list[str]) -> str:
    return ranked(W(train, *binned_ctes("tr", cols, list(range(3, 20))), *woe_ctes("lv", ["var", "k"]), ("bst", BEST_K),
                    body="SELECT var AS CONTINUOUS_COL, best_k AS BEST_CUT, IV, IV_adjusted AS IV_ADJUSTED FROM bst"),
                  "CONTINUOUS_COL", "BEST_CUT")


def rank_discrete(train: tuple[str, str], cols: list[str]) -> str:
    unions = " UNION ALL ".join(f"SELECT '{c}' AS var, CAST({c} AS VARCHAR) AS level, not_churn_1w FROM tr "
                                f"WHERE {c} IS NOT NULL" for c in cols)
    return ranked(W(train, ("lng", unions),
                    ("lv", "SELECT var, level, COUNT(not_churn_1w) AS n_obs, CAST(SUM(not_churn_1w) AS BIGINT) AS n_good "
                           "FROM lng GROUP BY var, level"),
                    *woe_ctes("lv", ["var"]),
                    body="SELECT var AS DISCRETE_COL, n_levels AS DISTINCT, IV, IV_adjusted AS IV_ADJUSTED FROM ivs"),
                  "DISCRETE_COL", "DISTINCT")


MEASURE_LIST = list(M)
DISCRETE_CANDIDATES = ["ops_city_id", "device_type", "vehicle_model", "vehicle_brand", "segment"]


def woe_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    for name, src in (("bin_completed_trip", "completed_trip"), ("bin_total_fare", "total_fare"),
                      ("bin_total_eta", "total_ETA"), ("bin_distance", "distance_travelled")):
        out = {"bin_completed_trip": "completed_trip_discrete", "bin_total_fare": "total_fare_discrete",
               "bin_total_eta": "total_ETA_discrete", "bin_distance": "distance_travelled_discrete"}[name]
        q[name] = W(*P1, body=f"SELECT entity_id, period, {src}, {RULE_SQL[out].sql(src)} AS {out} FROM panel")
    q["bin_segment"] = W(*PM, body=f"SELECT entity_id, period, sum_sh, {SEG} AS segment FROM panel")
    q["bin_equal_width"] = W(*P1,
        ("rng", "SELECT MIN(total_fare) AS mn, MAX(total_fare) AS mx FROM panel"),
        ("ed", f"SELECT {edges_sql(k='50')} AS edges FROM rng"),
        ("b", "SELECT entity_id, period, total_fare, CAST(len(list_filter(edges, lambda q: q < total_fare)) AS INTEGER) "
              "AS total_fare_fine_classing, edges FROM panel CROSS JOIN ed"),
        body="SELECT entity_id, period, total_fare, total_fare_fine_classing, "
             "edges[total_fare_fine_classing] AS total_fare_fine_classing_lo, "
             "edges[total_fare_fine_classing + 1] AS total_fare_fine_classing_hi FROM b")
    for key, var in (("woe_discrete", "segment"), ("woe_iv_adjusted", "completed_trip")):
        q[key] = W(TRAIN_1P,
                   ("lv", f"SELECT {var}, COUNT(not_churn_1w) AS n_obs, CAST(SUM(not_churn_1w) AS BIGINT) AS n_good "
                          f"FROM tr GROUP BY {var}"),
                   *woe_ctes("lv", []),
                   body=f"SELECT {var}, {WOE_OUT} FROM st CROSS JOIN ivs i")
    q["woe_continuous"] = W(TRAIN_1P, *binned_ctes("tr", ["total_fare"], [50]), *woe_ctes("lv", ["var", "k"]),
                            body=f"SELECT bin AS total_fare_fine_classing, bin_lo, bin_hi, {WOE_OUT} "
                                 f"FROM st JOIN ivs i ON i.var = st.var AND i.k = st.k")
    q["woe_best_class_count"] = W(TRAIN_1P, *binned_ctes("tr", ["completed_trip"], list(range(3, 20))),
                                  *woe_ctes("lv", ["var", "k"]), body=BEST_K)
    q["iv_by_class_count"] = W(TRAIN_1P, *binned_ctes("tr", MEASURE_LIST, list(range(3, 20))),
                               *woe_ctes("lv", ["var", "k"]), body="SELECT var, k, IV, IV_adjusted FROM ivs")
    candidates = {"1p": DISCRETE_CANDIDATES, "2p": ["segment", "not_churn"], "3p": ["segment", "not_churn", "not_churn_pre_1w"]}
    for sl, disc in candidates.items():
        tr = ("tr", "SELECT * FROM (" + slice_sql(f"slice_{sl}") + ") s WHERE NOT is_test")
        end = "" if sl == "1p" else f"_{sl}"
        q[f"iv_rank_continuous{end}"] = rank_continuous(tr, MEASURE_LIST)
        q[f"iv_rank_discrete{end}"] = rank_discrete(tr, disc)
    # the cluster family's rankings on a cluster that SQL knows: the entity's remainder by three
    for sl, end, disc in (("1p_attrs", "", candidates["1p"]), ("2p_global", "_2p", candidates["2p"]), ("3p_global", "_3p", candidates["3p"])):
        for kind, cols, make in (("discrete", disc, rank_discrete), ("continuous", MEASURE_LIST, rank_continuous)):
            parts = []
            for c in range(3):
                tr = ("tr", "SELECT * FROM (" + slice_sql(f"slice_{sl}") + f") s WHERE NOT is_test AND entity_id % 3 = {c}")
                parts.append(f"SELECT *, {c} AS cluster FROM ({make(tr, cols)}) c{c}")
            q[f"coded_iv_{kind}{end}"] = " UNION ALL ".join(parts)
    nulls = ("tr", f"SELECT *, not_churn AS not_churn_1w FROM ({DAILY}) x")
    q["woe_continuous_nulls"] = W(nulls, *binned_ctes("tr", ["total_ETA"], [20]), *woe_ctes("lv", ["var", "k"]),
                                  body=f"SELECT bin AS total_ETA_fine_classing, bin_lo, bin_hi, {WOE_OUT} "
                                       f"FROM st JOIN ivs i ON i.var = st.var AND i.k = st.k")
    q["iv_rank_discrete_nulls"] = rank_discrete(nulls, ["vehicle_model", "vehicle_brand", "segment"])
    return q


# ---------------------------------------------------------------------------
# Evaluation on the deterministic score
# ---------------------------------------------------------------------------
TH = "(CASE WHEN is_test THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END)"
PRED = SCORED + [("pr", f"SELECT *, CASE WHEN score > {TH} THEN 1 ELSE 0 END AS predict FROM scored")]
CNT = PRED + [("cnt", "SELECT is_test, "
                      "COUNT(*) FILTER (WHERE not_churn_1w = 1 AND predict = 1) AS tp, "
                      "COUNT(*) FILTER (WHERE not_churn_1w = 0 AND predict = 1) AS fp, "
                      "COUNT(*) FILTER (WHERE not_churn_1w = 1 AND predict = 0) AS fn, "
                      "COUNT(*) FILTER (WHERE not_churn_1w = 0 AND predict = 0) AS tn FROM pr GROUP BY is_test")]
HIST = SCORED + [("hist", "SELECT is_test, score, COUNT(*) FILTER (WHERE not_churn_1w = 1) AS n_pos, "
                          "COUNT(*) FILTER (WHERE not_churn_1w = 0) AS n_neg FROM scored GROUP BY is_test, score"),
                 ("tots", "SELECT is_test, SUM(n_pos) AS P, SUM(n_neg) AS N FROM hist GROUP BY is_test")]


def z0(n: str, dd: str) -> str:
    return f"COALESCE({zdiv(n, dd)}, 0.0)"


def report_cols(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    s1, s0 = f"({tp} + {fn})", f"({tn} + {fp})"
    p1, r1, f1 = z0(tp, f"{tp} + {fp}"), z0(tp, s1), z0(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    p0, r0, f0 = z0(tn, f"{tn} + {fn}"), z0(tn, s0), z0(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}")
    tot = d(f"{s0} + {s1}")
    return {
        "precision_0": p0, "recall_0": r0, "f1_0": f0, "support_0": s0,
        "precision_1": p1, "recall_1": r1, "f1_1": f1, "support_1": s1,
        "accuracy": z0(f"{tp} + {tn}", f"{s0} + {s1}"),
        "macro_precision": f"({p0} + {p1}) / 2", "macro_recall": f"({r0} + {r1}) / 2",
        "macro_f1": f"({f0} + {f1}) / 2",
        "weighted_precision": f"({p0} * {s0} + {p1} * {s1}) / {tot}",
        "weighted_recall": f"({r0} * {s0} + {r1} * {s1}) / {tot}",
        "weighted_f1": f"({f0} * {s0} + {f1} * {s1}) / {tot}",
    }


def eval_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["score_threshold"] = W(*PRED, body="SELECT entity_id, period, is_test, score, not_churn_1w, predict FROM pr")
    q["value_counts_pred"] = W(*PRED, body="SELECT is_test, predict, COUNT(*) AS n FROM pr GROUP BY is_test, predict")
    q["confusion_matrix"] = W(*PRED, ("cells", "SELECT a.actual, p.predicted, s.is_test FROM (VALUES (0), (1)) a(actual) "
                                               "CROSS JOIN (VALUES (0), (1)) p(predicted) "
                                               "CROSS JOIN (SELECT DISTINCT is_test FROM pr) s"),
                              body="SELECT c.is_test, CAST(c.actual AS INTEGER) AS actual, "
                                   "CAST(c.predicted AS INTEGER) AS predicted, COUNT(pr.entity_id) AS n FROM cells c "
                                   "LEFT JOIN pr ON pr.is_test = c.is_test AND pr.not_churn_1w = c.actual "
                                   "AND pr.predict = c.predicted GROUP BY c.is_test, c.actual, c.predicted")
    rc = report_cols()
    rows = [("'0'", rc["precision_0"], rc["recall_0"], rc["f1_0"], rc["support_0"]),
            ("'1'", rc["precision_1"], rc["recall_1"], rc["f1_1"], rc["support_1"]),
            ("'accuracy'", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", rc["accuracy"], "(tp + fp + fn + tn)"),
            ("'macro avg'", rc["macro_precision"], rc["macro_recall"], rc["macro_f1"], "(tp + fp + fn + tn)"),
            ("'weighted avg'", rc["weighted_precision"], rc["weighted_recall"], rc["weighted_f1"], "(tp + fp + fn + tn)")]
    q["classification_report"] = W(*CNT, body=" UNION ALL ".join(
        f"SELECT is_test, {r} AS row, {p} AS precision, {rr} AS recall, {f} AS f1_score, "
        f"CAST({s} AS BIGINT) AS support FROM cnt" for r, p, rr, f, s in rows))
    q["roc_curve"] = W(*HIST, ("c", "SELECT h.is_test, h.score, "
                                    "SUM(n_pos) OVER (PARTITION BY h.is_test ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, "
                                    "SUM(n_neg) OVER (PARTITION BY h.is_test ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn "
                                    "FROM hist h"),
                       body=f"SELECT c.is_test, c.score AS threshold, {zdiv('cn', 't.N')} AS fpr, "
                            f"{zdiv('cp', 't.P')} AS tpr FROM c JOIN tots t ON t.is_test = c.is_test "
                            f"UNION ALL SELECT is_test, CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM tots")
    auc = W(*HIST, ("c", "SELECT *, SUM(n_neg) OVER (PARTITION BY is_test ORDER BY score ROWS UNBOUNDED PRECEDING) "
                         "AS cn FROM hist"),
            ("a", "SELECT is_test, SUM(CAST(n_pos AS HUGEINT) * (2 * (cn - n_neg) + n_neg)) AS num, "
                  "SUM(n_pos) AS P, SUM(n_neg) AS N FROM c GROUP BY is_test"),
            ("au", "SELECT is_test, CASE WHEN P > 0 AND N > 0 THEN CAST(num AS DOUBLE) / "
                   "(CAST(2.0 AS DOUBLE) * CAST(P AS DOUBLE) * CAST(N AS DOUBLE)) END AS auroc FROM a"),
            body="SELECT is_test, auroc, CAST(2.0 AS DOUBLE) * auroc - CAST(1.0 AS DOUBLE) AS gini FROM au")
    q["auroc"] = f"SELECT is_test, auroc FROM ({auc}) x"
    q["gini"] = f"SELECT is_test, gini FROM ({auc}) x"
    gains = W(*HIST, ("c", "SELECT h.is_test, h.score, "
                           "SUM(n_pos + n_neg) OVER w AS cum_n_population, SUM(n_pos) OVER w AS cum_n_good, "
                           "SUM(n_neg) OVER w AS cum_n_bad FROM hist h "
                           "WINDOW w AS (PARTITION BY h.is_test ORDER BY score ROWS UNBOUNDED PRECEDING)"),
              body=f"SELECT c.is_test, c.score, CAST(cum_n_population AS BIGINT) AS cum_n_population, "
                   f"CAST(cum_n_good AS BIGINT) AS cum_n_good, CAST(cum_n_bad AS BIGINT) AS cum_n_bad, "
                   f"{zdiv('cum_n_population', 't.P + t.N')} AS cum_perc_population, "
                   f"{zdiv('cum_n_good', 't.P')} AS cum_perc_good, {zdiv('cum_n_bad', 't.N')} AS cum_perc_bad "
                   f"FROM c JOIN tots t ON t.is_test = c.is_test")
    q["gains_curve"] = gains
    q["ks_stat"] = f"SELECT is_test, MAX(cum_perc_bad - cum_perc_good) AS ks FROM ({gains}) g GROUP BY is_test"
    q["gains_predicted_bad"] = W(*HIST,
        ("h0", f"SELECT *, CASE WHEN score > {TH} THEN 0 ELSE n_pos + n_neg END AS n0 FROM hist"),
        ("c", "SELECT is_test, score, SUM(n0) OVER (PARTITION BY is_test ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum0, "
              "SUM(n0) OVER (PARTITION BY is_test) AS t0 FROM h0"),
        body=f"SELECT is_test, score, {zdiv('cum0', 't0')} AS cum_perc_predicted_bad FROM c")
    ths = ", ".join(f"CAST('{t!r}' AS DOUBLE)" for t in THRESHOLDS)
    sc = report_cols()
    q["threshold_sweep"] = W(*SCORED, ("th", f"SELECT unnest([{ths}]) AS threshold"),
        ("cnt", "SELECT s.is_test, th.threshold, "
                "COUNT(*) FILTER (WHERE not_churn_1w = 1 AND score > threshold) AS tp, "
                "COUNT(*) FILTER (WHERE not_churn_1w = 0 AND score > threshold) AS fp, "
                "COUNT(*) FILTER (WHERE not_churn_1w = 1 AND NOT score > threshold) AS fn, "
                "COUNT(*) FILTER (WHERE not_churn_1w = 0 AND NOT score > threshold) AS tn "
                "FROM scored s CROSS JOIN th GROUP BY s.is_test, th.threshold"),
        body="SELECT is_test, threshold, tp, fp, fn, tn, " + ", ".join(
            f"{expr} AS {k}" for k, expr in sc.items()) + " FROM cnt")
    inf, nan = "CAST('inf' AS DOUBLE)", "CAST('nan' AS DOUBLE)"

    def psi(keep: str) -> str:
        def term(diff, x, y):
            return (f"CASE WHEN {x} = 0 AND {y} = 0 THEN {nan} WHEN {x} = 0 OR {y} = 0 THEN {inf} "
                    f"ELSE ROUND(({diff}) * LN(({x}) / ({y})), {LOG_DIGITS}) END")
        return W(*SCORED, ("s", "SELECT COUNT(*) FILTER (WHERE not_churn_1w = 0 AND NOT is_test) AS d0, "
                                "COUNT(*) FILTER (WHERE NOT is_test) AS dn, "
                                "COUNT(*) FILTER (WHERE not_churn_1w = 0 AND is_test) AS t0, "
                                f"COUNT(*) FILTER (WHERE is_test) AS tn FROM scored WHERE {keep}"),
                 ("r", f"SELECT {zdiv('d0', 'dn')} AS d, {zdiv('t0', 'tn')} AS t FROM s"),
                 body=f"SELECT {term('t - d', 't', 'd')} AS psi_churn, {term('d - t', '(1.0 - t)', '(1.0 - d)')} AS psi_not_churn, "
                      f"d AS dev_churn_share, t AS oot_churn_share FROM r")
    q["psi_label"] = psi("TRUE")
    q["psi_limits"] = psi("NOT is_test OR not_churn_1w = 1")
    res = PRED + [("result", "SELECT entity_id, period, not_churn_1w, predict, is_test FROM pr WHERE not_churn = 1")]
    q["result_scored_active"] = W(*res, body="SELECT entity_id, period, not_churn_1w, predict FROM result "
                                             "WHERE NOT is_test")
    q["result_union"] = W(*res, body="SELECT * FROM result WHERE NOT is_test UNION ALL "
                                     "SELECT * FROM result WHERE is_test")
    q["rate_actual_vs_predicted"] = W(*res,
        ("t1", "SELECT period, COUNT(*) AS not_churn FROM result WHERE not_churn_1w = 1 GROUP BY period"),
        ("t2", "SELECT period, COUNT(*) AS churn FROM result WHERE not_churn_1w = 0 GROUP BY period"),
        ("t3", "SELECT t1.period, t2.churn * CAST(100.0 AS DOUBLE) / (t1.not_churn + t2.churn) AS churn_actual "
               "FROM t1 LEFT JOIN t2 ON t1.period = t2.period"),
        ("t4", "SELECT period, COUNT(*) AS not_churn FROM result WHERE predict = 1 GROUP BY period"),
        ("t5", "SELECT period, COUNT(*) AS churn FROM result WHERE predict = 0 GROUP BY period"),
        ("t6", "SELECT t4.period, t5.churn * CAST(100.0 AS DOUBLE) / (t4.not_churn + t5.churn) AS churn_predict "
               "FROM t4 LEFT JOIN t5 ON t4.period = t5.period"),
        body="SELECT t3.*, t6.churn_predict FROM t3 LEFT JOIN t6 ON t3.period = t6.period")
    q["sql_rates"] = q["rate_actual_vs_predicted"]
    q["rates_file"] = f"SELECT *, ROW_NUMBER() OVER (ORDER BY period) AS rank_no, TRUE AS in_order FROM ({q['rate_actual_vs_predicted']}) r"
    return q


# ---------------------------------------------------------------------------
# Encoding with the training vocabulary
# ---------------------------------------------------------------------------
SELECTED_1P = ["segment", "completed_trip_discrete", "total_fare_discrete", "total_ETA_discrete",
               "distance_travelled_discrete"]


def _binned_split(test: bool) -> tuple[str, str]:
    rules = ", ".join(f"{RULE_SQL[c].sql(RULE_SQL[c].source)} AS {c}" for c in SELECTED_1P[1:])
    cond = "is_test" if test else "NOT is_test"
    return ("te" if test else "tr",
            "SELECT *, " + rules + " FROM (" + slice_sql("slice_1p") + f") s WHERE {cond}")


VOCAB = [
    _binned_split(False),
    ("lv", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS variable, {i} AS ci, CAST({c} AS VARCHAR) AS level "
                              f"FROM tr WHERE {c} IS NOT NULL" for i, c in enumerate(SELECTED_1P))),
    ("rk", "SELECT *, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY level) AS r, "
           "COUNT(*) OVER (PARTITION BY variable) AS n FROM lv"),
    ("voc", "SELECT variable, level, variable || ':' || level AS feature, "
            "CAST(ROW_NUMBER() OVER (ORDER BY ci, r) - 1 AS INTEGER) AS position FROM rk WHERE r < n"),
]


def _encoded(src: str) -> str:
    longs = " UNION ALL ".join(f"SELECT entity_id, period, '{c}' AS variable, CAST({c} AS VARCHAR) AS level "
                               f"FROM {src}" for c in SELECTED_1P)
    return (f"SELECT l.entity_id, l.period, v.feature FROM ({longs}) l "
            f"JOIN voc v ON v.variable = l.variable AND v.level = l.level")


def encode_queries() -> dict[str, str]:
    return {
        "encode_vocabulary": W(*VOCAB, body="SELECT * FROM voc"),
        "encode_dummies": W(*VOCAB, body=_encoded("tr")),
        "encode_pinned_vocab": W(*VOCAB, _binned_split(True), body=_encoded("te")),
    }


def newton_one_column(exact: bool = False) -> str:
    """A ridge logistic fit (C = 1, free intercept) on the levels of one column by Newton steps in a recursive query. The levels
    exclude each other, so the system has the shape of an arrow and is solved by hand; without intercept and penalty the information matrix
    is diagonal. p by the series of the error function, which is 0 to ten digits beyond |z| / sqrt(2) = 4.5."""
    r = (lambda x, n: x) if exact else (lambda x, n: f"ROUND({x}, {n})")
    return W(_binned_split(False),
        ("lv", "SELECT distance_travelled_discrete AS level, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(not_churn) AS DOUBLE) AS y FROM tr GROUP BY 1"),
        ("rk", "SELECT *, ROW_NUMBER() OVER (ORDER BY level) AS r, COUNT(*) OVER () AS k FROM lv"),
        ("data", "SELECT list(n ORDER BY r) FILTER (WHERE r < k) AS ns, list(y ORDER BY r) FILTER (WHERE r < k) AS ys, "
                 "MAX(n) FILTER (WHERE r = k) AS n0, MAX(y) FILTER (WHERE r = k) AS y0 FROM rk"),
        ("steps", """SELECT * FROM (WITH RECURSIVE newton(i, b, beta) AS (
            SELECT 0, CAST(0 AS DOUBLE), list_transform(ns, lambda x: CAST(0 AS DOUBLE)) FROM data
            UNION ALL
            SELECT i + 1, b + db, list_transform(beta, lambda x, j: x - (g[j] + h[j] * db) / (h[j] + 1))
            FROM (SELECT *, -((n0 * p0 - y0 + list_sum(e)) - list_sum(list_transform(h, lambda x, j: x * g[j] / (x + 1))))
                             / (n0 * p0 * (1 - p0) + list_sum(h) - list_sum(list_transform(h, lambda x: x * x / (x + 1)))) AS db
                  FROM (SELECT *, list_transform(ns, lambda n, j: n * p[j] - ys[j]) AS e,
                               list_transform(ns, lambda n, j: n * p[j] - ys[j] + beta[j]) AS g,
                               list_transform(ns, lambda n, j: n * p[j] * (1 - p[j])) AS h
                        FROM (SELECT *, 1 / (1 + exp(-b)) AS p0, list_transform(beta, lambda x: 1 / (1 + exp(-(b + x)))) AS p
                              FROM newton, data WHERE i < 30) a) c) d
          ) SELECT * FROM newton WHERE i = 30) t"""),
        ("fit", "SELECT 0 AS feature_no, 'Intercept' AS feature_name, b AS coefficient, CAST(NULL AS DOUBLE) AS sigma FROM steps "
                "UNION ALL SELECT CAST(r AS INTEGER), 'distance_travelled_discrete:' || level, beta[r], "
                "1 / sqrt(n / (1 + exp(-(b + beta[r]))) * (1 - 1 / (1 + exp(-(b + beta[r]))))) FROM rk, steps WHERE r < k"),
        ("z", "SELECT *, coefficient / sigma AS z_score, abs(coefficient / sigma) / sqrt(2) AS x FROM fit"),
        body=f"SELECT feature_no, feature_name, {r('coefficient', 4)} AS coefficient, {r('sigma', 4)} AS sigma, {r('z_score', 3)} AS z_score, "
             + r("CASE WHEN x > 4.5 THEN CAST(0 AS DOUBLE) WHEN x IS NOT NULL THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(120), "
                 "lambda m: CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * CAST(exp((2 * m + 1) * ln(greatest(x, 1e-300)) - lgamma(m + 1)) AS DOUBLE) / (2 * m + 1))) END", 4)
             + " AS p_value FROM z")


def model_checks() -> dict[str, str]:
    """Facts about the fitted models that do not depend on the solver."""
    q: dict[str, str] = {}
    q["logit_gradient"] = W(*VOCAB, body="SELECT 0 AS feature_no, 'Intercept' AS feature_name, CAST(0 AS DOUBLE) AS residual "
                                         "UNION ALL SELECT position + 1, feature, CAST(0 AS DOUBLE) FROM voc")
    q["wald_information"] = W(*VOCAB, ("enc", _encoded("tr")),
        body="SELECT a.feature AS feature_i, b.feature AS feature_j, SUM(CAST(0.1875 AS DOUBLE)) AS information "
             "FROM enc a JOIN enc b ON a.entity_id = b.entity_id AND a.period = b.period GROUP BY 1, 2")
    rows = "SELECT is_test, COUNT(*) AS n_rows, CAST(SUM(not_churn_1w) AS BIGINT) AS n_good, COUNT(*) AS n_probabilities FROM ({}) s GROUP BY is_test"
    q["logit_score_rows"] = q["rf_score_rows"] = rows.format(slice_sql("slice_1p"))
    q["rf_importance_sum"] = W(*VOCAB, body="SELECT COUNT(*) AS n_features, CAST(1 AS DOUBLE) AS total, TRUE AS none_negative FROM voc")
    checks = ("SELECT {by}is_test, COUNT(*) AS n_rows, CAST(SUM(not_churn_1w) AS BIGINT) AS n_good, COUNT(*) AS gains_rows, "
              "CAST(SUM(not_churn_1w) AS BIGINT) AS gains_good, CAST(SUM(not_churn_1w) AS BIGINT) AS sweep_good, "
              "TRUE AS roc_spans, TRUE AS gini_agrees FROM ({src}) s {where} GROUP BY {by}is_test")
    for name in ("1p", "2p", "3p"):
        end = "" if name == "1p" else f"_{name}"
        for kind in ("logit", "rf"):
            q[f"{kind}_evaluation_checks{end}"] = checks.format(by="", src=slice_sql(f"slice_{name}"), where="")
    for name, end in (("1p_attrs", ""), ("2p_global", "_2p"), ("3p_global", "_3p")):
        src = "SELECT s.*, c.cluster FROM (" + slice_sql(f"slice_{name}") + ") s CROSS JOIN (VALUES (0), (1), (2)) c(cluster)"
        for kind in ("logit", "rf"):
            q[f"cluster_{kind}_checks{end}"] = checks.format(by="cluster, ", src=src, where="WHERE is_test")
    train = "SELECT * FROM (" + slice_sql("slice_1p_attrs") + ") s WHERE NOT is_test"
    feats = ["ops_city_id", "device_type", *M, "not_churn"]
    q["kmeans_k1_sse"] = ("SELECT COUNT(*) AS n_rows, CAST(ROUND(" + " + ".join(f"VAR_POP(CAST({c} AS DOUBLE))" for c in feats)
                          + f") AS BIGINT) AS mean_square FROM ({train}) t")
    q["kmeans_nearest"] = f"SELECT COUNT(*) AS n_rows, CAST(3 AS BIGINT) AS n_clusters, TRUE AS nearest FROM ({train}) t"
    q["kmeans_elbow_shape"] = "SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS k, TRUE AS not_above_previous"
    q["kmeans_fixed_point"] = "SELECT CAST(unnest(range(3)) AS INTEGER) AS cluster, TRUE AS rests"
    q["logit_wald_signal"] = newton_one_column()
    q["logit_significant_signal"] = f"SELECT feature_name FROM ({newton_one_column(exact=True)}) t WHERE p_value < 0.05"
    active = "SELECT * FROM (" + slice_sql("slice_1p") + ") s WHERE not_churn = 1"
    q["logit_rates_actual"] = (f"SELECT period, CASE WHEN COUNT(*) FILTER (WHERE not_churn_1w = 0) > 0 THEN "
                               f"COUNT(*) FILTER (WHERE not_churn_1w = 0) * CAST(100.0 AS DOUBLE) / COUNT(*) END AS churn_actual "
                               f"FROM ({active}) a GROUP BY period HAVING COUNT(*) FILTER (WHERE not_churn_1w = 1) > 0")
    return q


def stats_queries() -> dict[str, str]:
    lng = " UNION ALL ".join(f"SELECT '{m}' AS measure, CAST({m} AS DOUBLE) AS x FROM panel WHERE {m} IS NOT NULL"
                             for m in M)
    qs = ", ".join(f"ROUND(QUANTILE_CONT(x, {q}), 9) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return {"describe_measures": W(*P1, ("lng", lng), body=(
        f"SELECT measure, COUNT(x) AS count, ROUND(AVG(x), 6) AS mean, ROUND(STDDEV_SAMP(x), 6) AS std, "
        f"MIN(x) AS min, {qs}, MAX(x) AS max FROM lng GROUP BY measure"))}
