"""Bar lake, health and market-panel queries.

Bars are one-minute klines per event type: an event gives open, high, low and
close around its value, and two events in one minute are two copies of a key.
"""

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import health as H
from ..operators import panel as P
from ..session import materialize, shared_dir
from ..sources import lake as L
from ..sources import market as M
from . import views as V
from .evaluation import rounded
from .registry import out, query

START, END = 1_704_240_000_000, 1_705_449_600_000  # 2024-01-03 .. 2024-01-17 UTC


def raw_klines(spark, sf):
    """Untyped klines: numbers as text, plus a column to drop."""
    v, text = F.col("value"), lambda c: c.cast("string")
    return V.table(spark, sf, "events").select(
        F.lit("spot").alias("venue"),
        F.col("event_type").alias("symbol"),
        F.lit("1m").alias("interval"),
        text(L.floor_minute(L.time_ms("ts"))).alias("open_time"),
        text(v).alias("open"),
        text(v + 0.5).alias("high"),
        text(v - 0.5).alias("low"),
        text(v + 0.25).alias("close"),
        text(F.col("user_id") % 10 + 1).alias("volume"),
        text(L.floor_minute(L.time_ms("ts")) + 59_999).alias("close_time"),
        text(v * 2).alias("quote_volume"),
        text(F.col("user_id")).alias("num_trades"),
        text(v / 2).alias("taker_buy_base_vol"),
        text(v).alias("taker_buy_quote_vol"),
        F.lit("0").alias("ignore"),
        F.col("event_id").alias("ingest"),
    )


def klines(spark, sf):
    return L.normalize(raw_klines(spark, sf))


def unique_klines(spark, sf):
    return P.keep_last(klines(spark, sf), L.KEYS, ["ingest"]).drop("ingest")


OPEN_TIME = "(epoch_us(ts) // 60000000) * 60000"
RAW_SQL = f"""SELECT 'spot' AS venue, event_type AS symbol, '1m' AS interval, {OPEN_TIME} AS open_time, value AS open,
      value + 0.5 AS high, value - 0.5 AS low, value + 0.25 AS close, CAST(user_id % 10 + 1 AS DOUBLE) AS volume,
      {OPEN_TIME} + 59999 AS close_time, value * 2 AS quote_volume, user_id AS num_trades, value / 2 AS taker_buy_base_vol,
      value AS taker_buy_quote_vol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_id AS ingest FROM events"""
KEYS_SQL = "venue, symbol, interval, open_time"
REST = [c for c in L.COLUMNS if c not in L.KEYS]


def unique_sql(source="raw"):
    return f"SELECT {KEYS_SQL}, " + ", ".join(f"arg_max({c}, ingest) AS {c}" for c in REST) + f" FROM {source} GROUP BY ALL"


WITH = f"WITH raw AS ({RAW_SQL}), bars AS ({unique_sql()})"


def _path(spark, kind="lake"):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query("kline_normalize", f"WITH raw AS ({RAW_SQL}) SELECT * FROM raw")
def kline_normalize(spark, sf):
    return klines(spark, sf)


@query("kline_import", f"WITH raw AS ({RAW_SQL}) SELECT * EXCLUDE (venue, ingest), 'ext' AS venue FROM raw")
def kline_import(spark, sf):
    """External frame without series keys but with the required columns, stamped on import."""
    frame = raw_klines(spark, sf).drop("venue", "interval", "ingest")
    return L.normalize(frame, venue="ext", interval="1m")


@query("lake_write", f"{WITH} SELECT *, 7 AS ingest FROM bars")
def lake_write(spark, sf):
    path = _path(spark)
    L.write(klines(spark, sf), path, 7)
    return L.scan(spark, path).withColumn("ingest", F.col("ingest").cast("int"))


def two_deliveries(spark, sf, path):
    """All bars, then every second one again with another close."""
    bars = klines(spark, sf)
    L.write(bars, path, 1)
    again = bars.where(F.col("ingest") % 2 == 1).withColumn("close", F.col("close") + 1)
    L.write(again, path, 2)
    return L.scan(spark, path)


DELIVERED = f"""{WITH}, again AS (SELECT * REPLACE (close + 1 AS close) FROM raw WHERE ingest % 2 = 1),
    second AS ({unique_sql("again")}), copies AS (SELECT *, 1 AS ingest FROM bars UNION ALL SELECT *, 2 AS ingest FROM second),
    lake AS ({unique_sql("copies")})"""


@query("lake_query", f"""{DELIVERED} SELECT symbol, open_time, close, date FROM lake
    WHERE symbol IN ('click', 'view') AND open_time BETWEEN {START} AND {END}""")
def lake_query(spark, sf):
    lake = two_deliveries(spark, sf, _path(spark))
    return L.query(lake, "spot", ["click", "view"], "1m", START, END, ["symbol", "open_time", "close", "date"])


@query("lake_compact", f"{DELIVERED} SELECT symbol, open_time, close, date FROM lake")
def lake_compact(spark, sf):
    """Two deliveries compacted, then read without any further de-duplication."""
    path = _path(spark)
    two_deliveries(spark, sf, path)
    L.compact(spark, path)
    return L.scan(spark, path).select("symbol", "open_time", "close", "date")


@query("lake_compact_status", f"""{DELIVERED}, asked AS (SELECT DISTINCT symbol, date FROM lake UNION ALL SELECT 'click', '1999-01-01'),
    files AS (SELECT symbol, date, count(DISTINCT ingest) AS n FROM copies GROUP BY 1, 2),
    rows_ AS (SELECT symbol, date, count(*) AS n FROM lake GROUP BY 1, 2)
    SELECT a.symbol, a.date, CASE WHEN f.n IS NULL THEN 'missing_partition' WHEN f.n <= 1 THEN 'skip_small' ELSE 'compacted' END AS status,
      CASE WHEN f.n > 1 THEN r.n ELSE 0 END AS "rows", CAST(CASE WHEN f.n > 1 THEN 1 ELSE 0 END AS BIGINT) AS written_files, CAST(0 AS BIGINT) AS left
    FROM asked a LEFT JOIN files f USING (symbol, date) LEFT JOIN rows_ r USING (symbol, date)""")
def lake_compact_status(spark, sf):
    path = _path(spark)
    lake = two_deliveries(spark, sf, path)
    # one file per delivery and day, so that the status depends on the deliveries only
    daily = materialize(lake)
    one = _path(spark)
    for i in (1, 2):
        part = daily.where(F.col("ingest") == i).repartition(*L.PARTITIONS)
        part.write.mode("append").partitionBy(*L.PARTITIONS).parquet(one)
    asked = daily.select(*L.PARTITIONS).distinct().unionByName(
        daily.limit(1).select("venue", F.lit("click").alias("symbol"), "interval", F.lit("1999-01-01").alias("date"))
    )
    first = materialize(L.compact(spark, one, asked).select("symbol", "date", "status", "rows", "written_files"))
    again = L.compact(spark, one, asked).where("status = 'compacted'").select(F.count("*").alias("left"))
    return first.crossJoin(F.broadcast(again))


@query("watermark_rebuild", f"{WITH} SELECT venue, symbol, interval, max(open_time) AS last_open_time FROM bars GROUP BY 1, 2, 3")
def watermark_rebuild(spark, sf):
    return L.watermark(klines(spark, sf))


def _marks(spark, sf):
    """Marks after the first ten days, and after all."""
    bars = klines(spark, sf)
    cut = START + 7 * L.DAY_MS
    old = L.watermark(bars.where((F.col("open_time") < cut) & (F.col("symbol") != "error")))
    new = L.watermark(bars.where(F.col("symbol").isin("error", "click")))
    return bars, old, new


OLD = f"""old AS (SELECT venue, symbol, interval, max(open_time) AS last_open_time FROM raw
      WHERE open_time < {START + 7 * L.DAY_MS} AND symbol <> 'error' GROUP BY 1, 2, 3),
    new AS (SELECT venue, symbol, interval, max(open_time) AS last_open_time FROM raw WHERE symbol IN ('error', 'click') GROUP BY 1, 2, 3)"""


@query("watermark_upsert", f"""{WITH}, {OLD} SELECT venue, symbol, interval, coalesce(n.last_open_time, o.last_open_time) AS last_open_time,
    CASE WHEN n.symbol IS NULL THEN 1 ELSE 2 END AS updated_at FROM old o FULL JOIN new n USING (venue, symbol, interval)""")
def watermark_upsert(spark, sf):
    _, old, new = _marks(spark, sf)
    return L.watermark_upsert(old.withColumn("updated_at", F.lit(1)), new.withColumn("updated_at", F.lit(2)))


@query("incremental_append", f"""{WITH}, {OLD}, fresh AS (SELECT b.* FROM bars b LEFT JOIN old o USING (venue, symbol, interval)
      WHERE o.last_open_time IS NULL OR b.open_time > o.last_open_time)
    SELECT symbol, open_time, close, (SELECT max(f.open_time) FROM fresh f WHERE f.symbol = fresh.symbol) AS new_mark FROM fresh""")
def incremental_append(spark, sf):
    bars, old, _ = _marks(spark, sf)
    fresh = L.new_rows(P.keep_last(bars, L.KEYS, ["ingest"]), old)
    mark = L.watermark_advance(old, L.watermark(fresh))
    return fresh.join(mark, L.SERIES).select("symbol", "open_time", "close", F.col("last_open_time").alias("new_mark"))



@query("panel_from_klines", f"""{WITH} SELECT symbol AS code, make_timestamp(open_time * 1000) AS trade_time, open, high, low, close,
    volume, quote_volume AS amount FROM bars""")
def panel_from_klines(spark, sf):
    return M.panel_from_klines(unique_klines(spark, sf))


@query("panel_from_market", f"""WITH bars AS ({V.bars_sql("week")}) SELECT code, trade_time, open, high, low, close, volume,
    close AS vwap, close * volume AS amount FROM bars""")
def panel_from_market(spark, sf):
    feed = V.bars(spark, sf, "week").drop("amount").withColumn("vwap", F.lit(float("nan")))
    return M.panel_from_market(feed)


def resampled_sql(step, target, source="bars"):
    return f"""SELECT venue, symbol, '{target}' AS interval, (open_time // {step}) * {step} AS open_time, arg_min(open, open_time) AS open,
      max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume,
      (open_time // {step}) * {step} + {step - 1} AS close_time, {out("sum(quote_volume)", "quote_volume", 2)},
      CAST(sum(num_trades) AS BIGINT) AS num_trades, {out("sum(taker_buy_base_vol)", "taker_buy_base_vol", 3)},
      {out("sum(taker_buy_quote_vol)", "taker_buy_quote_vol", 2)},
      CAST(CAST(make_timestamp((open_time // {step}) * {step} * 1000) AS DATE) AS VARCHAR) AS date
      FROM {source} GROUP BY venue, symbol, open_time // {step}"""


def round_sums(df):
    return df.withColumns(
        {"quote_volume": rnd("quote_volume", 2), "taker_buy_base_vol": rnd("taker_buy_base_vol", 3),
         "taker_buy_quote_vol": rnd("taker_buy_quote_vol", 2)}
    )


RESAMPLED = ("15m", "1h", "4h", "1d")


@query("bars_resample", f"{WITH} " + " UNION ALL ".join(resampled_sql(L.INTERVAL_MS[t], t) for t in RESAMPLED))
def bars_resample(spark, sf):
    made = list(L.resample_chain(unique_klines(spark, sf), RESAMPLED).values())
    all_bars = made[0]
    for m in made[1:]:
        all_bars = all_bars.unionByName(m)
    return round_sums(all_bars)


@query("bars_resample_mixed", f"{WITH} {resampled_sql(L.INTERVAL_MS['1h'], '1h')}")
def bars_resample_mixed(spark, sf):
    """Hours out of a lake that holds the minutes and the five-minute bars made of them."""
    bars, path = unique_klines(spark, sf), _path(spark)
    L.write(bars.withColumn("ingest", F.lit(1)), path, 1)
    L.write(L.resample(bars, "5m").withColumn("ingest", F.lit(1)), path, 2)
    return round_sums(L.resample(L.query(L.scan(spark, path)), "1h"))


@query("gap_fill", f"""{WITH}, stored AS (SELECT * FROM bars WHERE open_time % 420000 <> 0 AND NOT (symbol = 'view' AND open_time BETWEEN {START} AND {END})),
    ends AS (SELECT symbol, min(open_time) AS a, max(open_time) AS b FROM stored WHERE open_time BETWEEN {START} AND {END} GROUP BY 1),
    back AS (SELECT b.* FROM bars b LEFT JOIN ends e USING (symbol) LEFT JOIN stored s ON s.symbol = b.symbol AND s.open_time = b.open_time
      WHERE s.symbol IS NULL AND b.open_time BETWEEN {START} AND {END} AND (e.a IS NULL OR b.open_time > e.a AND b.open_time < e.b)),
    done AS (SELECT * FROM stored UNION ALL SELECT * FROM back)
    SELECT symbol, open_time, close, (SELECT max(d.open_time) FROM done d WHERE d.symbol = done.symbol) AS last_open_time FROM done""")
def gap_fill(spark, sf):
    """A lake without every seventh minute, and without one series in the window, filled from a late delivery of all bars."""
    bars, path = materialize(unique_klines(spark, sf)), _path(spark)
    gone = (F.col("symbol") == "view") & F.col("open_time").between(START, END)
    L.write(bars.where((F.col("open_time") % 420_000 != 0) & ~gone).withColumn("ingest", F.lit(1)), path, 1)
    before = L.watermark(L.scan(spark, path))
    late = materialize(L.fill_rows(bars, L.query(L.scan(spark, path)), START, END))
    L.write(late.withColumn("ingest", F.lit(1)), path, 2)
    marks = L.watermark_advance(before, L.watermark(late))
    return L.query(L.scan(spark, path)).join(marks, L.SERIES).select("symbol", "open_time", "close", "last_open_time")


@query("gap_windows", f"""{WITH}, have AS (SELECT symbol FROM bars WHERE open_time BETWEEN {START} AND {END} AND symbol <> 'view' GROUP BY 1)
    SELECT symbol, {START} AS gap_start, {END} AS gap_end FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol NOT IN (SELECT symbol FROM have)""")
def gap_windows(spark, sf):
    """Series without any bar in the window: all of it is missing."""
    bars = klines(spark, sf)
    asked = bars.select(*L.SERIES).distinct()
    return H.missing_windows(asked, bars.where("symbol <> 'view'"), START, END).select("symbol", "gap_start", "gap_end")


@query("gap_ranges_all", f"""{WITH}, step AS (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev
      FROM (SELECT DISTINCT symbol, open_time FROM bars))
    SELECT symbol, prev + 60000 AS gap_start, open_time - 60000 AS gap_end FROM step WHERE open_time - prev > 60000""")
def gap_ranges_all(spark, sf):
    """Interior gaps without a window."""
    return H.gap_ranges(klines(spark, sf)).select("symbol", "gap_start", "gap_end")


GAPS = f"""{WITH}, step AS (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev
      FROM (SELECT DISTINCT symbol, open_time FROM bars WHERE open_time BETWEEN {START} AND {END})),
    gaps AS (SELECT symbol, prev + 60000 AS gap_start, open_time - 60000 AS gap_end FROM step WHERE open_time - prev > 60000)"""


@query("gap_ranges", f"{GAPS} SELECT * FROM gaps")
def gap_ranges(spark, sf):
    return H.gap_ranges(klines(spark, sf), START, END).select("symbol", "gap_start", "gap_end")


@query("gap_ranges_edges", f"""{GAPS}, ends AS (SELECT symbol, min(open_time) AS a, max(open_time) AS b FROM step GROUP BY 1)
    SELECT * FROM gaps UNION ALL SELECT symbol, {START}, a - 60000 FROM ends WHERE a > {START}
    UNION ALL SELECT symbol, b + 60000, {END} FROM ends WHERE b < {END}""")
def gap_ranges_edges(spark, sf):
    return H.gap_ranges(klines(spark, sf), START, END, edges=True).select("symbol", "gap_start", "gap_end")


STATS = """stats AS (SELECT venue, symbol, interval, count(*) AS "rows", count(DISTINCT open_time) AS unique_times,
      min(open_time) AS min_open_time, max(open_time) AS max_open_time FROM raw GROUP BY 1, 2, 3)"""


@query("health_stats", f"""{WITH}, {STATS} SELECT *, "rows" - unique_times AS duplicates,
    {out('("rows" - unique_times) / "rows"', "duplicate_ratio")}, (max_open_time - min_open_time) // 60000 + 1 AS expected_if_continuous,
    (max_open_time - min_open_time) // 60000 + 1 - unique_times AS missing_bars FROM stats""")
def health_stats(spark, sf):
    return rounded(H.health_stats(klines(spark, sf)))


@query("daily_completeness", f"""{WITH}, d AS (SELECT venue, symbol, interval, date AS day, count(*) AS "rows" FROM raw GROUP BY ALL)
    SELECT *, CAST(1440 AS BIGINT) AS expected, "rows" < floor(1440 * 0.98) AS bad FROM d""")
def daily_completeness(spark, sf):
    return H.daily_completeness(klines(spark, sf))


FILES = 31


def many_files(spark, sf):
    """A lake with one file per day of most series, and one per delivery and day of the clicks, which come in many deliveries."""
    path, bars = _path(spark), materialize(klines(spark, sf))
    for i in range(FILES):
        part = bars.where((F.col("symbol") == "click") & (F.col("ingest") % FILES == i) | (F.col("symbol") != "click") & F.lit(i == 0))
        part.repartition(*L.PARTITIONS).write.mode("append").partitionBy(*L.PARTITIONS).parquet(path)
    return L.scan(spark, path)


PARTS = f"""parts AS (SELECT symbol, date, count(DISTINCT CASE WHEN symbol = 'click' THEN ingest % {FILES} ELSE 0 END) AS n FROM raw GROUP BY 1, 2)"""


@query("storage_stats", f"""{WITH}, {PARTS}, placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, date) AS place FROM parts)
    SELECT symbol, CAST(sum(n) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS small_files, max(n) AS max_parts_per_date,
      string_agg(date || ':' || n, ' ' ORDER BY place) FILTER (WHERE place <= 5) AS top FROM placed GROUP BY 1""")
def storage_stats(spark, sf):
    """Without the bytes, which depend on the writer; all files here are small ones."""
    stats = H.storage_stats(many_files(spark, sf))
    top = F.array_join(F.transform("parts_per_date_top", lambda t: F.concat(t["date"], F.lit(":"), t["parts"].cast("string"))), " ")
    return stats.select("symbol", "files", "small_files", "max_parts_per_date", top.alias("top"))


CHECK = f"""{WITH}, {OLD}, local AS (SELECT venue, symbol, interval, max(open_time) AS local_max FROM raw GROUP BY 1, 2, 3),
    checked AS (SELECT venue, symbol, interval, local_max, coalesce(n.last_open_time, o.last_open_time) AS watermark FROM local
      LEFT JOIN old o USING (venue, symbol, interval) LEFT JOIN (SELECT * FROM new WHERE symbol = 'click') n USING (venue, symbol, interval)),
    status AS (SELECT *, CASE WHEN watermark IS NULL THEN 'missing_watermark' WHEN abs(local_max - watermark) > 60000 THEN 'mismatch'
      ELSE 'ok' END AS status FROM checked)"""


def _checked(spark, sf):
    bars, old, new = _marks(spark, sf)
    mark = L.watermark_advance(old, new.where("symbol = 'click'"))
    return bars, H.watermark_check(L.watermark(bars), mark)


@query("watermark_check", f"{CHECK} SELECT * FROM status")
def watermark_check(spark, sf):
    return _checked(spark, sf)[1]


@query("health_recommend", f"""{CHECK}, {PARTS}, g AS (SELECT symbol, count(*) AS gaps FROM (SELECT symbol, open_time - lag(open_time)
      OVER (PARTITION BY symbol ORDER BY open_time) AS d FROM bars) WHERE d > 60000 GROUP BY 1),
    p AS (SELECT symbol, max(n) AS parts, CAST(sum(n) AS BIGINT) AS small FROM parts GROUP BY 1),
    r AS (SELECT symbol, list_filter([CASE WHEN status = 'missing_watermark' THEN 'rebuild the watermark, then sync' END,
      CASE WHEN status = 'mismatch' THEN 'watermark differs from the stored bars: rebuild it' END,
      CASE WHEN small >= 50 THEN 'many small files: compact recent dates' END,
      CASE WHEN parts >= 30 THEN 'many files on one date: compact it' END, CASE WHEN gaps > 0 THEN 'gaps found: fill them' END],
      lambda x: x IS NOT NULL) AS advice FROM status JOIN g USING (symbol) JOIN p USING (symbol))
    SELECT symbol, array_to_string(advice, '; ') AS advice FROM r""")
def health_recommend(spark, sf):
    """Advice from the marks, the gaps and the files of the lake."""
    bars, status = _checked(spark, sf)
    gaps = H.gap_ranges(bars).groupBy("symbol").agg(F.count("*").alias("gaps"))
    parts = H.storage_stats(many_files(spark, sf)).select("symbol", "max_parts_per_date", "small_files")
    report = status.join(gaps, "symbol", "left").join(parts, "symbol", "left")
    return H.recommend(report).select("symbol", F.array_join("advice", "; ").alias("advice"))


@query("time_floor", f"""SELECT event_id, (epoch_us(ts) // 60000000) * 60000 AS floored FROM events""")
def time_floor(spark, sf):
    return V.table(spark, sf, "events").select("event_id", L.floor_minute(L.time_ms("ts")).alias("floored"))


@query("time_convert", """SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
    make_timestamp((epoch_us(ts) // 1000) * 1000) AS back FROM events""")
def time_convert(spark, sf):
    ms = L.time_ms("ts")
    return V.table(spark, sf, "events").select(
        "event_id", ms.alias("ms"), L.ms_date(ms).alias("day"), L.ms_time(ms).alias("back")
    )


# daily bars with dividends

DAY_BARS = f"bars AS (SELECT code, CAST(trade_time AS DATE) AS date, close, volume FROM ({V.bars_sql('day')}))"
DIVIDENDS = """dividends AS (SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) + 3 AS date, 1 + max(l_tax) AS factor
    FROM lineitem WHERE l_discount >= 0.09 AND l_quantity > 45 GROUP BY 1, 2)"""


def day_bars(spark, sf):
    return V.bars(spark, sf, "day").select("code", F.to_date("trade_time").alias("date"), "close", "volume")


def dividends(spark, sf):
    rows = V.table(spark, sf, "lineitem").where("l_discount >= 0.09 AND l_quantity > 45")
    return rows.groupBy(
        F.col("l_suppkey").cast("string").alias("code"), F.date_add(F.to_date("l_shipdate"), 3).alias("date")
    ).agg((1 + F.max("l_tax")).alias("factor"))


@query("adj_factor_prepare", f"""WITH {DAY_BARS}, {DIVIDENDS} SELECT b.code, b.date, b.close, b.volume, coalesce(d.factor, 1) AS factor
    FROM bars b ASOF LEFT JOIN dividends d ON b.code = d.code AND b.date >= d.date""")
def adj_factor_prepare(spark, sf):
    return M.adjusted_bars(day_bars(spark, sf), dividends(spark, sf))


@query("adj_factor_compat", f"""WITH {DAY_BARS}, {DIVIDENDS}, grid AS (SELECT code, date FROM bars UNION SELECT code, date FROM dividends),
    wide AS (SELECT code, date, close, volume, factor FROM grid LEFT JOIN bars USING (code, date) LEFT JOIN dividends USING (code, date))
    SELECT code, date, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 1) AS {c}" for c in ("close", "volume", "factor"))}
    FROM wide WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def adj_factor_compat(spark, sf):
    return M.adjusted_bars(day_bars(spark, sf), dividends(spark, sf), compat=True)


@query("universe_union", f"""WITH {DAY_BARS} SELECT DISTINCT code FROM bars WHERE date IN
    (SELECT CAST(d AS DATE) FROM generate_series(TIMESTAMP '1995-06-15', TIMESTAMP '2001-12-31', INTERVAL 1 YEAR) AS g(d))""")
def universe_union(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("code"), F.to_date("l_shipdate").alias("date")
    )
    dates = spark.range(1).select(F.explode(M.yearly_dates("1995-06-15", "2001-12-31"))).collect()
    return M.universe_union(rows, [d[0] for d in dates])


@query("bars_incremental_merge", f"""WITH {DAY_BARS}, stored AS (SELECT * FROM bars WHERE date < DATE '2000-01-01' OR (code = '3' AND volume > 10)),
    fresh AS (SELECT code, date, close + 1 AS close, volume FROM bars WHERE date >= DATE '1999-06-01'),
    last AS (SELECT code, max(date) AS d FROM stored GROUP BY 1)
    SELECT * FROM stored UNION ALL SELECT f.* FROM fresh f LEFT JOIN last USING (code) WHERE d IS NULL OR f.date > d""")
def bars_incremental_merge(spark, sf):
    bars = day_bars(spark, sf)
    stored = bars.where((F.col("date") < "2000-01-01") | ((F.col("code") == "3") & (F.col("volume") > 10)))
    fresh = bars.where(F.col("date") >= "1999-06-01").withColumn("close", F.col("close") + 1)
    return M.merge_increment(stored, fresh)


def _keep(name, fn, agg):
    @query(name, f"WITH raw AS ({RAW_SQL}) SELECT {KEYS_SQL}, {agg}(close, ingest) AS close, {agg}(ingest, ingest) AS ingest FROM raw GROUP BY ALL")
    def run(spark, sf):
        return fn(klines(spark, sf).select(*L.KEYS, "close", "ingest"), L.KEYS, ["ingest"])


_keep("dedup_keep_last", P.keep_last, "arg_max")
_keep("dedup_keep_first", P.keep_first, "arg_min")
