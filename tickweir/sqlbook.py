"""DuckDB SQL of the engine's queries, written from the operators' definitions."""

from __future__ import annotations

from tickweir.schema import NS, QUOTE

LADDER = range(5)


def ladder(cells: list[str]) -> str:
    return f"([{', '.join(cells)}])[1:depth]"


_OFF = [str(k) if k < 2 else f"({k} + gap)" for k in LADDER]
BOOK = f"""
e AS (SELECT event_id AS seq, event_type, 'M' || (user_id % 6) AS market_id, ((epoch_us(ts) - 1704067200000000) * 5) // 6 AS timestamp_ns,
    CAST(round(value * 100) AS BIGINT) AS v, event_id % 3 AS gap, 3 + event_id % 3 AS depth FROM events),
q AS (SELECT *, 10000 + v % 7 AS bt, 10000 + v % 7 + 1 + gap AS ak FROM e WHERE event_type <> 'purchase'),
b AS (SELECT seq, market_id, timestamp_ns, bt / 100.0::DOUBLE AS bid_price, (1 + (v * 3) % 50)::DOUBLE AS bid_size, ak / 100.0::DOUBLE AS ask_price, (1 + (v * 5) % 50)::DOUBLE AS ask_size,
    (bt + ak) / 200.0::DOUBLE AS mid, (ak - bt) / 100.0::DOUBLE AS spread,
    {ladder([f"(bt - {o}) / 100.0::DOUBLE" for o in _OFF])} AS bp, {ladder([f"(1 + (v * {3 + 2 * k}) % 50)::DOUBLE" for k in LADDER])} AS bs,
    {ladder([f"(ak + {o}) / 100.0::DOUBLE" for o in _OFF])} AS ap, {ladder([f"(1 + (v * {5 + 2 * k}) % 50)::DOUBLE" for k in LADDER])} AS asz FROM q),
tr AS (SELECT market_id, timestamp_ns, (10000 + v % 9) / 100.0::DOUBLE AS price, (1 + v % 10)::DOUBLE AS size, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side FROM e WHERE event_type = 'purchase')"""


def first_n(c: str, n: int) -> str:
    return f"coalesce(list_sum({c}[1:{n}]), 0)"


def products(p: str, s: str, n: int) -> str:
    return " + ".join(f"coalesce({p}[{k}] * {s}[{k}], 0)" for k in range(1, n + 1))


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


_W = "PARTITION BY market_id ORDER BY timestamp_ns, seq"
MICRO = (
    f"m AS (SELECT *, {div('bid_price * ask_size + ask_price * bid_size', 'bid_size + ask_size')} AS microprice, {div('bid_size - ask_size', 'bid_size + ask_size')} AS imbalance_l1, "
    + ", ".join(
        f"{first_n('bs', n)} AS bid_size_l{n}, {first_n('asz', n)} AS ask_size_l{n}, {div(first_n('bs', n) + ' - ' + first_n('asz', n), first_n('bs', n) + ' + ' + first_n('asz', n))} AS imbalance_l{n}, "
        f"{div(products('bp', 'bs', n) + ' + ' + products('ap', 'asz', n), first_n('bs', n) + ' + ' + first_n('asz', n))} AS microprice_l{n}"
        for n in (3, 5, 10)
    )
    + " FROM b)"
)


def flow(bp: str, bs: str, ap: str, az: str) -> tuple[str, str]:
    lag = lambda x: f"lag({x}) OVER w"
    bid = f"CASE WHEN {bp} > {lag(bp)} THEN {bs} WHEN {bp} = {lag(bp)} THEN {bs} - {lag(bs)} WHEN {bp} < {lag(bp)} THEN -({lag(bs)}) END"
    ask = f"CASE WHEN {ap} < {lag(ap)} THEN -({az}) WHEN {ap} = {lag(ap)} THEN {lag(az)} - {az} WHEN {ap} > {lag(ap)} THEN {lag(az)} END"
    return bid, ask


_B, _A = flow(*QUOTE)
SCALAR = f"""s AS (SELECT *, delta_bid + delta_ask AS ofi, (microprice - mid) / 0.01::DOUBLE AS micro_gap_ticks, spread / 0.01::DOUBLE AS spread_ticks
    FROM (SELECT *, {_B} AS delta_bid, {_A} AS delta_ask FROM m WINDOW w AS ({_W})))"""


def level_flow(k: int) -> str:
    at = lambda c, d: f"coalesce({c}[{k}], {d})"
    bid, ask = flow(at("bp", "bid_price"), at("bs", "0"), at("ap", "ask_price"), at("asz", "0"))
    return f"coalesce(({bid}) + ({ask}), 0)"


def query(ctes: list[str], cols: dict[str, str], source: str, digits: int = 6, keys: str = "market_id, timestamp_ns, seq", tail: str = "") -> str:
    picked = ", ".join(f"round({x} + 1e-9, {digits}) + 0.0 AS {n}" for n, x in cols.items())
    return f"WITH {', '.join(ctes)} SELECT {keys}{', ' if keys and picked else ''}{picked} FROM {source} {tail}"


def plain(cols: list[str]) -> dict[str, str]:
    return {c: c for c in cols}


def back(seconds: float, name: str) -> str:
    return f"{name} AS (PARTITION BY market_id ORDER BY timestamp_ns RANGE BETWEEN {int(seconds * NS) - 1} PRECEDING AND CURRENT ROW)"


BASE = [BOOK, MICRO, SCALAR]
WIN = f"WINDOW w AS ({_W}), " + ", ".join(back(s, f"t{s}") for s in (1, 5, 30))

SQL: dict[str, str] = {}
_IMB, _GAPS = [f"imbalance_l{n}" for n in (1, 3, 5)], ["micro_gap_ticks", "spread_ticks"]
_MICRO_COLS = ["microprice", "imbalance_l1", *[f"{c}_l{n}" for n in (3, 5, 10) for c in ("bid_size", "ask_size", "imbalance", "microprice")]]
SQL["book"] = query([BOOK], plain([*QUOTE, "mid", "spread"]) | {f"{n}_{k}": f"{c}[{k}]" for n, c in (("bp", "bp"), ("bs", "bs"), ("ap", "ap"), ("az", "asz")) for k in range(1, 6)}, "b")
SQL["trades"] = query([BOOK], plain(["price", "size"]), "tr", keys="market_id, timestamp_ns, CAST(side AS BIGINT) AS side")
SQL["microstructure"] = query([BOOK, MICRO], plain(_MICRO_COLS), "m")
SQL["ofi"] = query(BASE, plain(["delta_bid", "delta_ask", "ofi"]), "s")
SQL["scalar"] = query(BASE, plain(["ofi", *_IMB, *_GAPS]), "s")
SQL["paper_levels"] = query(
    [BOOK], {f"{s}_{p}_{k}": f"coalesce({c}[{k}], {d})" for s, cs in (("bid", (("px", "bp", "bid_price"), ("sz", "bs", "0"))), ("ask", (("px", "ap", "ask_price"), ("sz", "asz", "0")))) for k in range(1, 6) for p, c, d in cs}, "b"
)
_GRID = f"""lv AS (SELECT seq, 'bid' AS side, bid_price AS touch, -1 AS sign, unnest(bp) AS p, unnest(bs) AS z FROM b UNION ALL SELECT seq, 'ask', ask_price, 1, unnest(ap), unnest(asz) FROM b),
o AS (SELECT seq, side, CAST(round_even(sign * (p - touch) / 0.01, 0) AS INT) AS o, z FROM lv WHERE p IS NOT NULL AND z IS NOT NULL),
d AS (SELECT seq, sum(z) AS tot FROM o WHERE o BETWEEN 0 AND 19 GROUP BY seq),
g AS (SELECT seq, {", ".join(f"coalesce(sum(z) FILTER (WHERE side = '{s}' AND o = {k}), 0) AS {s}_grid_{k}" for s in ("bid", "ask") for k in range(20))} FROM o GROUP BY seq)"""
SQL["grid"] = query([BOOK, _GRID], {f"{s}_grid_{k}": f"coalesce({s}_grid_{k} / tot, 0)" for s in ("bid", "ask") for k in range(20)}, "b JOIN g USING (seq) LEFT JOIN d USING (seq)")
SQL["grid_clipped"] = f"WITH {BOOK}, {_GRID} SELECT side, count(*) AS n_levels, round(1 - count(*) FILTER (WHERE o BETWEEN 0 AND 2) / count(*)::DOUBLE, 6) AS clipped FROM o GROUP BY side"
SQL["stationary"] = query(
    BASE,
    plain([*_IMB, *[f"microprice{n}" for n in ("", "_l3", "_l5")], "ofi", *_GAPS])
    | {f"{s}_{n}_{k}": f"coalesce({x.format(k=k)}, 0)" for s, p, z in (("bid", "bp", "bs"), ("ask", "ap", "asz")) for k in range(1, 6) for n, x in (("relpx", f"({p}[{{k}}] - mid) / 0.01"), ("relsz", f"{z}[{{k}}] / nullif(list_sum({z}), 0)"))},
    "s",
)
_FLOW = [
    f"{f'f AS (SELECT *, {level_flow(2)} AS ofi_l2, {level_flow(3)} AS ofi_l3'}, {', '.join(f'sum(coalesce(ofi, 0)) OVER t{s} AS ofi_roll_{s}s, avg(coalesce(imbalance_l1, 0)) OVER t{s} AS obi_roll_{s}s' for s in (1, 5, 30))}, "
    f"sum(coalesce(ofi, 0)) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ofi_ev_10, sum(coalesce(ofi, 0)) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ofi_ev_50 FROM s {WIN})"
]
_TIME = [f"{c}_roll_{s}s" for c in ("ofi", "obi") for s in (1, 5, 30)]
SQL["flow_time"] = query(BASE + _FLOW, plain(_TIME), "f", 4)
SQL["flow_events"] = query(BASE + _FLOW, plain(["ofi_ev_10", "ofi_ev_50"]), "f", 4)
SQL["ofi_levels"] = query(BASE + _FLOW, plain(["ofi_l2", "ofi_l3"]), "f")
_HIST = [
    f"h AS (SELECT *, coalesce(power(microprice - lag(microprice) OVER w, 2), 0) AS r2 FROM s WINDOW w AS ({_W}))",
    "i AS (SELECT *, " + ", ".join(f"last_value(microprice) OVER (PARTITION BY market_id ORDER BY timestamp_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {s * NS} PRECEDING) AS old{s}" for s in (5, 30)) + " FROM h)",
]
SQL["history"] = query(
    BASE + _HIST,
    {f"ret_ev_{k}": f"coalesce((microprice - lag(microprice, {k}) OVER w) / 0.01, 0)" for k in (1, 5, 10)} | {f"ret_roll_{s}s": f"(microprice - coalesce(old{s}, microprice)) / 0.01" for s in (5, 30)} | {f"rv_{s}s": f"sqrt(avg(r2) OVER t{s}) / 0.01" for s in (5, 30)},
    "i", 4, tail=WIN,
)
SQL["shape"] = query(
    BASE,
    {
        "touch_conc_bid": "bid_size / list_sum(bs)", "touch_conc_ask": "ask_size / list_sum(asz)", "depth_log_ratio": "ln(1 + list_sum(bs)) - ln(1 + list_sum(asz))", "log_depth_bid": "ln(1 + list_sum(bs))",
        "log_depth_ask": "ln(1 + list_sum(asz))", "micro_gap_l3": "(microprice_l3 - mid) / 0.01", "micro_gap_l5": "(microprice_l5 - mid) / 0.01", "imbalance_l10": "imbalance_l10",
    },
    "s",
)
_MOVES = [f"mv AS (SELECT *, coalesce(abs(mid - lag(mid) OVER w), 0) AS dm, coalesce(mid - lag(mid) OVER w, 0) AS dmid FROM s WINDOW w AS ({_W}))"]
_TRADES = [
    *_MOVES,
    "am AS (SELECT *, " + ", ".join(f"sum(dm) OVER t{s} AS sdm{s}" for s in (5, 30)) + f" FROM mv WINDOW {back(5, 't5')}, {back(30, 't30')})",
    *[
        f"x{s} AS (SELECT a.seq, count(t.size) AS n, coalesce(sum(t.size), 0) AS vol, sum(t.side * t.size) AS sg, sum(t.price * t.size) AS pv FROM b a LEFT JOIN tr t ON t.market_id = a.market_id "
        f"AND t.timestamp_ns <= a.timestamp_ns AND t.timestamp_ns > a.timestamp_ns - {s * NS} GROUP BY a.seq)"
        for s in (5, 30)
    ],
]
SQL["trade_features"] = query(
    BASE + _TRADES,
    {
        f"{n}_{s}s": x.format(s=s)
        for n, x in (
            ("tfi", "CASE WHEN x{s}.vol > 0 THEN x{s}.sg / x{s}.vol ELSE 0 END"), ("trades", "x{s}.n::DOUBLE"), ("vol", "ln(1 + x{s}.vol)"),
            ("vwapgap", "CASE WHEN x{s}.vol > 0 THEN (x{s}.pv / x{s}.vol - mid) / 0.01 ELSE 0 END"), ("amihud", "CASE WHEN x{s}.vol > 0 THEN sdm{s} / x{s}.vol ELSE 0 END"),
        )
        for s in (5, 30)
    },
    "am JOIN x5 USING (seq) JOIN x30 USING (seq)", 4,
)
SQL["activity_spread"] = query(
    BASE + _MOVES,
    {"rel_spread": "spread / mid"} | {f"mid_moves_{s}s": f"sum((dm > 1e-12)::INT) OVER t{s}" for s in (1, 5, 30)} | {f"updates_{s}s": f"(count(*) OVER t{s})::DOUBLE" for s in (1, 5, 30)}
    | {f"spread_mean_{s}s": f"avg(spread_ticks) OVER t{s}" for s in (5, 30)} | {f"spread_std_{s}s": f"sqrt(greatest(avg(spread_ticks * spread_ticks) OVER t{s} - power(avg(spread_ticks) OVER t{s}, 2), 0))" for s in (5, 30)},
    "mv", 4, tail=WIN,
)
_DELTA = [
    *_MOVES,
    f"dq AS (SELECT *, CASE WHEN bid_price = lag(bid_price) OVER w THEN bid_size - lag(bid_size) OVER w ELSE 0 END AS db, CASE WHEN ask_price = lag(ask_price) OVER w THEN ask_size - lag(ask_size) OVER w ELSE 0 END AS da FROM mv WINDOW w AS ({_W}))",
]
SQL["impact"] = query(
    BASE + _DELTA,
    {f"add_rate_{s}s": f"sum(greatest(db, 0) + greatest(da, 0)) OVER t{s}" for s in (5, 30)} | {f"cancel_rate_{s}s": f"sum(greatest(-db, 0) + greatest(-da, 0)) OVER t{s}" for s in (5, 30)}
    | {f"kyle_lambda_{s}s": f"sum(dmid * coalesce(ofi, 0)) OVER t{s} / greatest(sum(coalesce(ofi, 0) * coalesce(ofi, 0)) OVER t{s}, 1e-12)" for s in (5, 30)},
    "dq", 4, tail=WIN,
)
SQL["perlevel"] = query(
    BASE + ["pl AS (SELECT *, " + ", ".join(f"{level_flow(k)} AS pl_ofi_{k}, coalesce(bs[{k}], 0) AS b{k}, coalesce(asz[{k}], 0) AS a{k}" for k in range(1, 6)) + f" FROM s WINDOW w AS ({_W}))"],
    {f"pl_{c}_{k}": x.format(k=k) for k in range(1, 6) for c, x in (("obi", "CASE WHEN b{k} + a{k} > 0 THEN (b{k} - a{k}) / (b{k} + a{k}) ELSE 0 END"), ("ofi", "pl_ofi_{k}"), ("relsz", "(b{k} + a{k}) / (list_sum(bs) + list_sum(asz))"))},
    "pl",
)
#: The recurrence itself, row by row, for the second half-life's length of 5 s, on one market.
SQL["ewma"] = f"""WITH RECURSIVE {", ".join(BASE)},
    n AS (SELECT market_id, seq, timestamp_ns, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_ns, seq) AS i, micro_gap_ticks AS g, imbalance_l1 AS o FROM s),
    r AS (SELECT market_id, seq, timestamp_ns, i, g::DOUBLE AS mg, o::DOUBLE AS ob FROM n WHERE i = 1
        UNION ALL
        SELECT n.market_id, n.seq, n.timestamp_ns, n.i, (1 - power(2, -(n.timestamp_ns - r.timestamp_ns) / 5e9)) * n.g + power(2, -(n.timestamp_ns - r.timestamp_ns) / 5e9) * r.mg,
            (1 - power(2, -(n.timestamp_ns - r.timestamp_ns) / 5e9)) * n.o + power(2, -(n.timestamp_ns - r.timestamp_ns) / 5e9) * r.ob
        FROM r JOIN n ON n.market_id = r.market_id AND n.i = r.i + 1)
    SELECT market_id, timestamp_ns, seq, round(mg + 1e-9, 5) + 0.0 AS mg_ewma_5s, round(ob + 1e-9, 5) + 0.0 AS obi_ewma_5s FROM r"""


def forward(seconds: float) -> str:
    return (
        f"fp AS (SELECT a.*, h.timestamp_ns AS ht, h.microprice AS hp FROM s a ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id, timestamp_ns ORDER BY seq) AS first FROM s) WHERE first = 1) h "
        f"ON a.market_id = h.market_id AND a.timestamp_ns + {int(seconds * NS)} <= h.timestamp_ns)"
    )


_Y = {"y_fwd": "hp - microprice", "fwd_dt_s": f"(ht - timestamp_ns) / {NS}.0::DOUBLE"}
SQL["fwd_point"] = query([*BASE, forward(5)], _Y, "fp", tail="WHERE hp IS NOT NULL")
SQL["fwd_point_stale"] = query([*BASE, forward(5)], _Y, "fp", tail=f"WHERE ht - timestamp_ns - {5 * NS} <= {NS}")
_EVENT = f"fe AS (SELECT *, lead(microprice, 10) OVER w AS hp, lead(timestamp_ns, 10) OVER w AS ht FROM s WINDOW w AS ({_W}))"
SQL["fwd_event"] = query([*BASE, _EVENT], _Y, "fe", tail="WHERE hp IS NOT NULL")
_SMOOTH = f"fs AS (SELECT *, avg(microprice) OVER (PARTITION BY market_id ORDER BY timestamp_ns RANGE BETWEEN 1 FOLLOWING AND {5 * NS} FOLLOWING) AS hp FROM s)"
SQL["fwd_smooth"] = query([*BASE, _SMOOTH], {"y_fwd": "hp - microprice", "fwd_dt_s": "5.0::DOUBLE"}, "fs", 5, tail="WHERE hp IS NOT NULL")
_LABEL = [*BASE, _EVENT, "y AS (SELECT *, hp - microprice AS y_fwd, CASE WHEN hp - microprice > 0.0021 THEN 1 WHEN hp - microprice < -0.0021 THEN -1 ELSE 0 END AS y_cls FROM fe WHERE hp IS NOT NULL)"]
SQL["sign_label"] = query(_LABEL, {"y_fwd": "y_fwd"}, "y", keys="market_id, timestamp_ns, seq, y_cls")

_ACT = f"""ac AS (SELECT market_id, count(*) FILTER (WHERE abs(d) > 1e-12) AS n_mid_moves, (max(timestamp_ns) - min(timestamp_ns)) / 6e10::DOUBLE AS mins, count(*) AS c
    FROM (SELECT *, mid - lag(mid) OVER w AS d FROM b WINDOW w AS ({_W})) GROUP BY market_id)"""


def tiers(x: str, source: str) -> str:
    return f"CAST(least(floor((rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 - 1) / count(*) OVER () * 3), 2) AS INT) AS tier FROM {source}"


SQL["market_activity"] = f"WITH {BOOK}, {_ACT} SELECT market_id, n_mid_moves, round(mins, 6) AS minutes, round(n_mid_moves / greatest(mins, 1e-9), 6) AS mid_moves_per_min FROM ac"
SQL["liq_tier"] = f"WITH {BOOK}, {_ACT}, r AS (SELECT market_id, c / greatest(mins, 1e-9) AS upm FROM ac), t AS (SELECT *, {tiers('upm', 'r')}) SELECT seq, market_id, round(upm, 6) AS updates_per_min, tier AS liq_tier FROM b JOIN t USING (market_id)"
SQL["act_tier"] = (
    f"WITH {BOOK}, {_ACT}, r AS (SELECT market_id, n_mid_moves / greatest(mins, 1e-9) AS mpm FROM ac WHERE n_mid_moves >= 10), t AS (SELECT *, {tiers('mpm', 'r')}) SELECT seq, market_id, round(mpm, 6) AS mid_moves_per_min, tier AS act_tier FROM b JOIN t USING (market_id)"
)
SQL["min_rows"] = f"WITH {BOOK} SELECT market_id, count(*) AS n FROM b GROUP BY market_id HAVING count(*) >= (SELECT count(*) // 6 FROM b)"
SQL["tail_drop"] = f"WITH {BOOK} SELECT seq, market_id, timestamp_ns FROM (SELECT *, max(timestamp_ns) OVER (PARTITION BY market_id) AS m FROM b) WHERE timestamp_ns <= m - {600 * NS}"
SQL["clean"] = f"""WITH {BOOK}, c AS (SELECT * FROM b WHERE mid IS NOT NULL AND spread IS NOT NULL AND bid_size > 0 AND ask_size > 0 AND mid > 100.0::DOUBLE + 0.01::DOUBLE AND mid < 100.1::DOUBLE - 0.01::DOUBLE)
    SELECT seq, market_id, timestamp_ns FROM (SELECT *, max(timestamp_ns) OVER (PARTITION BY market_id) AS m FROM c) WHERE timestamp_ns <= m - {60 * NS}"""
SQL["whitelist"] = f"WITH {BOOK} SELECT market_id, count(*) AS n, count(DISTINCT market_id) AS markets FROM b WHERE market_id IN ('M1', 'M4') GROUP BY market_id"

_FOLDS = "z AS (SELECT min(timestamp_ns) AS t0, max(timestamp_ns) AS t1 FROM b), bd AS (SELECT k AS fold, t0 + ((t1 - t0) * (k - 1)) // 4 AS lo, CASE WHEN k = 4 THEN t1 + 1 ELSE t0 + ((t1 - t0) * k) // 4 END AS hi FROM z, range(1, 5) r(k))"
SQL["walk_forward"] = f"""WITH {BOOK}, {_FOLDS} SELECT CAST(fold AS INT) AS fold, role, count(*) AS n, min(timestamp_ns) AS first, max(timestamp_ns) AS last FROM
    (SELECT *, CASE WHEN timestamp_ns >= lo AND timestamp_ns < hi THEN 'test' WHEN timestamp_ns < lo - {30 * NS} THEN 'train' END AS role FROM b, bd) WHERE role IS NOT NULL GROUP BY ALL"""
_SC = ["ofi", *_IMB[:2], *_GAPS]
SQL["scaler"] = f"WITH {', '.join(BASE)}, {_FOLDS}, x AS (SELECT s.* FROM s, bd WHERE fold = 2 AND timestamp_ns < lo - {30 * NS}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0 AS mean, round(stddev_pop({c}), 6) AS std FROM x" for c in _SC)
_SPAN = f"wn AS (SELECT *, row_number() OVER w AS rn, lag(timestamp_ns, 15) OVER w AS ts0, sum(coalesce((abs(dmid) > 1e-12)::INT, 0)) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS moves FROM mv WINDOW w AS ({_W}))"
SQL["windows_span"] = f"WITH {', '.join(BASE + _MOVES)}, {_SPAN} SELECT market_id, timestamp_ns, seq FROM wn WHERE rn >= 16 AND timestamp_ns - ts0 <= {18 * NS}"
SQL["windows_moves"] = f"WITH {', '.join(BASE + _MOVES)}, {_SPAN} SELECT market_id, timestamp_ns, seq FROM wn WHERE rn >= 16 AND moves >= 14"
SQL["windows_flat"] = f"""WITH {", ".join(_LABEL)}, l AS (SELECT *, row_number() OVER w AS rn, list(imbalance_l1) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS xs FROM y WINDOW w AS ({_W}))
    SELECT market_id, timestamp_ns, seq, y_cls, CAST(len(xs) AS INT) AS n, round(xs[1]::FLOAT::DOUBLE + 1e-9, 5) + 0.0 AS x_first, round(xs[8]::FLOAT::DOUBLE + 1e-9, 5) + 0.0 AS x_last, round(list_sum(list_transform(xs, lambda v: v::FLOAT::DOUBLE)) + 1e-9, 4) + 0.0 AS x_sum FROM l WHERE rn >= 8"""
_PRED = [*_LABEL, "p AS (SELECT *, (microprice - mid) * 0.5 - 0.001 * imbalance_l3 AS pred FROM y)"]
_REG = """round(1 - sum(power(y_fwd - pred, 2)) / (count(*) * var_pop(y_fwd)), 6) AS r2, round(corr(y_fwd, pred), 6) AS corr, round(avg((sign(pred) = sign(y_fwd))::INT) FILTER (WHERE y_fwd <> 0), 6) AS hit_rate,
    round(sum(abs(y_fwd)) FILTER (WHERE sign(pred) = sign(y_fwd)) / sum(abs(y_fwd)), 6) AS weighted_hit, count(*) AS n"""
SQL["reg_metrics"] = f"WITH {', '.join(_PRED)} SELECT market_id, {_REG} FROM p GROUP BY market_id"
_CLS = [*_PRED, "c AS (SELECT *, CASE WHEN pred > 0.0005 THEN 1 WHEN pred < -0.0005 THEN -1 ELSE 0 END AS k FROM p)"]
_F1 = " + ".join(f"coalesce(2.0 * count(*) FILTER (WHERE y_cls = {c} AND k = {c}) / nullif(count(*) FILTER (WHERE y_cls = {c}) + count(*) FILTER (WHERE k = {c}), 0), 0)" for c in (-1, 0, 1))
SQL["cls_metrics"] = f"""WITH {", ".join(_CLS)} SELECT market_id, round(avg((y_cls = k)::INT), 6) AS accuracy, round(({_F1}) / 3, 6) AS macro_f1, round(avg((sign(y_fwd) = k)::INT) FILTER (WHERE k <> 0 AND y_fwd <> 0), 6) AS hit_rate,
    round(sum(abs(y_fwd)) FILTER (WHERE k <> 0 AND sign(y_fwd) = k) / sum(abs(y_fwd)) FILTER (WHERE k <> 0), 6) AS weighted_hit, count(*) AS n FROM c GROUP BY market_id"""
SQL["majority"] = f"WITH {', '.join(_LABEL)} SELECT y_cls, count(*) AS n FROM y GROUP BY y_cls ORDER BY n DESC, y_cls LIMIT 1"
SQL["residual_histogram"] = f"""WITH {", ".join(_PRED)}, r AS (SELECT y_fwd - pred AS r, min(y_fwd - pred) OVER () AS lo, max(y_fwd - pred) OVER () AS hi FROM p)
    SELECT CAST(least(floor((r - lo) / (hi - lo) * 120), 119) + 1 AS INT) AS bin, count(*) AS n FROM r GROUP BY 1"""
SQL["pred_vs_actual"] = f"""WITH {", ".join(_PRED)}, l AS (SELECT quantile_cont(v, 0.99) AS lim FROM (SELECT abs(y_fwd) AS v FROM p UNION ALL SELECT abs(pred) FROM p))
    SELECT CAST(floor((pred + lim) / (2 * lim) * 20) AS INT) AS px, CAST(floor((y_fwd + lim) / (2 * lim) * 20) AS INT) AS py, count(*) AS n FROM p, l WHERE abs(y_fwd) < lim AND abs(pred) < lim GROUP BY ALL"""
SQL["error_bins"] = f"""WITH {", ".join(_PRED)}, r AS (SELECT abs(y_fwd) AS mv, abs(y_fwd - pred) AS ae, row_number() OVER (ORDER BY abs(y_fwd), market_id, timestamp_ns) AS rn, count(*) OVER () AS n FROM p)
    SELECT CAST((rn * 20 - 1) // n AS INT) AS bin, round(avg(mv), 6) AS move, round(avg(ae), 6) AS error FROM r GROUP BY 1"""
SQL["calibration"] = f"""WITH {", ".join(_PRED)}, qu AS (SELECT quantile_cont(pred, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS qs FROM p)
    SELECT CAST(least(greatest(len(list_filter(qs, lambda e: e <= pred)) - 1, 0), 9) AS INT) AS bin, round(avg(pred), 6) + 0.0 AS mean_pred, round(avg(y_fwd), 6) + 0.0 AS mean_actual, count(*) AS n FROM p, qu GROUP BY 1"""
SQL["price_decile"] = f"""WITH {", ".join(_PRED)}, qu AS (SELECT quantile_cont(mid, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM p), d AS (SELECT *, CAST(len(list_filter(qs, lambda e: e <= mid)) AS INT) AS decile FROM p, qu)
    SELECT decile, {_REG} FROM d GROUP BY decile"""
_KEY = "(seq * 7919) % 10007"
SQL["balance"] = f"""WITH {", ".join(_LABEL)}, n AS (SELECT greatest(count(*) FILTER (WHERE y_cls = 1), count(*) FILTER (WHERE y_cls = -1)) // 4 AS m FROM y WHERE seq % 4 = 0 OR y_cls = 0),
    z AS (SELECT * FROM y WHERE y_cls = 0 OR seq % 4 = 0), k AS (SELECT greatest(count(*) FILTER (WHERE y_cls = 1), count(*) FILTER (WHERE y_cls = -1)) AS m FROM z),
    o AS (SELECT *, row_number() OVER (PARTITION BY y_cls = 0 ORDER BY {_KEY}, market_id, timestamp_ns, seq) AS rn FROM z) SELECT market_id, timestamp_ns, seq, y_cls FROM o, k WHERE y_cls <> 0 OR rn <= m"""
SQL["subsample"] = f"WITH {BOOK} SELECT market_id, timestamp_ns, seq FROM b ORDER BY {_KEY}, market_id, timestamp_ns, seq LIMIT 500"
SQL["median_wall"] = f"WITH {', '.join([*BASE, _EVENT])} SELECT round(median((ht - timestamp_ns) / {NS}.0::DOUBLE), 6) AS median_s FROM fe WHERE hp IS NOT NULL"
SQL["flow_signal"] = f"""WITH {", ".join([*BASE, *_FLOW])}, g AS (SELECT ofi_roll_5s, market_id, avg(microprice) OVER (PARTITION BY market_id ORDER BY timestamp_ns RANGE BETWEEN 1 FOLLOWING AND {5 * NS} FOLLOWING) - microprice AS y FROM f)
    SELECT market_id, count(*) AS n, round(corr(ofi_roll_5s, y), 6) AS corr, round(sum(ofi_roll_5s), 4) + 0.0 AS flow FROM g WHERE y IS NOT NULL GROUP BY market_id"""
SQL["fold_means"] = f"""WITH {", ".join(_PRED)}, fm AS (SELECT market_id, {_REG.replace(", 6)", ", 12)")} FROM p GROUP BY market_id)
    SELECT 'rule' AS model, round(avg(r2), 6) AS r2, round(avg(corr), 6) AS corr, round(avg(hit_rate), 6) AS hit_rate, round(avg(weighted_hit), 6) AS weighted_hit, CAST(sum(n) AS BIGINT) AS n FROM fm"""
SQL["feature_groups"] = """SELECT * FROM (VALUES ('ofi', 'ofi'), ('imbalance_l10', 'imbalance'), ('micro_gap_l3', 'book_shape'), ('spread_ticks', 'spread/micro_gap'), ('spread_std_5s', 'spread_dyn'), ('ofi_l2', 'ofi_dynamics'),
    ('vol_5s', 'trade_flow'), ('bid_grid_3', 'grid_bid'), ('pl_obi_1', 'other')) t(feature, grp)"""
SQL["majority_rows"] = f"""WITH {", ".join(_LABEL)}, mj AS (SELECT y_cls AS c FROM y WHERE seq % 4 <> 0 GROUP BY y_cls ORDER BY count(*) DESC, y_cls LIMIT 1)
    SELECT market_id, timestamp_ns, seq, (c = -1)::DOUBLE AS p_down, (c = 0)::DOUBLE AS p_flat, (c = 1)::DOUBLE AS p_up FROM y, mj WHERE seq % 4 = 0"""
SQL["persistence"] = f"""WITH {", ".join(_LABEL)} SELECT market_id, round(1 - sum(y_fwd * y_fwd) / (count(*) * var_pop(y_fwd)), 6) + 0.0 AS r2, 0.0::DOUBLE AS corr, 0.0::DOUBLE AS hit_rate, 0.0::DOUBLE AS weighted_hit, count(*) AS n
    FROM y GROUP BY market_id"""
_PAIR = f"""l AS (SELECT *, row_number() OVER w AS rn, lag(imbalance_l1, 7) OVER w AS i8 FROM y WINDOW w AS ({_W}))"""


def seen(n: int, first: str) -> str:
    """Of a window of 8 rows: how many numbers a model is given, the first of them and the last two."""
    cell = lambda x: f"round({x}::FLOAT::DOUBLE + 1e-9, 5) + 0.0"
    return f"WITH {', '.join(_LABEL)}, {_PAIR} SELECT market_id, timestamp_ns, seq, {n} AS n_features, {cell(first)} AS first, {cell('imbalance_l1')} AS near, {cell('spread_ticks')} AS last FROM l WHERE rn >= 8"


SQL["last_step"], SQL["whole_window"] = seen(2, "imbalance_l1"), seen(16, "i8")
SQL["top_tier"] = f"WITH {BOOK}, {_ACT}, r AS (SELECT market_id, n_mid_moves / greatest(mins, 1e-9) AS mpm FROM ac WHERE n_mid_moves >= 10), t AS (SELECT *, {tiers('mpm', 'r')}) SELECT seq, market_id, tier AS act_tier FROM b JOIN t USING (market_id) WHERE tier = 2"
SQL["phase_gaps"] = f"""WITH {", ".join(_PRED)}, fm AS (SELECT market_id AS phase, corr(y_fwd, pred) AS corr FROM p GROUP BY market_id)
    SELECT phase, 'rule' AS model, round(corr, 6) AS corr, round(corr - lag(corr) OVER (ORDER BY phase), 6) + 0.0 AS gain FROM fm"""
_TIED = [*BASE, "ti AS (SELECT market_id, seq, timestamp_ns // 60000000000 * 60000000000 AS timestamp_ns, CASE WHEN seq % 9 <> 0 THEN coalesce(microprice, 0) ELSE 0 END AS mp FROM s)"]
SQL["history_ties"] = f"""WITH {", ".join(_TIED)}, tr2 AS (SELECT *, coalesce(mp - lag(mp) OVER w, 0) AS r, coalesce((mp - lag(mp) OVER w) / 0.01, 0) AS ret_ev_1 FROM ti WINDOW w AS ({_W})),
    tw AS (SELECT *, arg_max(mp, timestamp_ns * 10000000::HUGEINT + seq) OVER (PARTITION BY market_id ORDER BY timestamp_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 120000000000 PRECEDING) AS old,
        avg(r * r) OVER (PARTITION BY market_id ORDER BY timestamp_ns RANGE BETWEEN 119999999999 PRECEDING AND CURRENT ROW) AS v FROM tr2)
    SELECT market_id, timestamp_ns, seq, round(ret_ev_1 + 1e-9, 4) + 0.0 AS ret_ev_1, round((mp - coalesce(old, mp)) / 0.01 + 1e-9, 4) + 0.0 AS ret_roll_120s, round(sqrt(v) / 0.01 + 1e-9, 4) + 0.0 AS rv_120s FROM tw"""
