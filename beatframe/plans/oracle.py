"""The same results as plain SQL over the given tables."""

from __future__ import annotations

from ..params import DETECTOR as D, MAD_SCALE

ORACLE: dict[str, str] = {}
MAD = repr(MAD_SCALE)

EV = """ev AS (SELECT user_id AS segment_no, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
 value AS x, event_type, epoch_us(ts) / 1e6 AS t_s, props FROM events)"""
LI = """li AS (SELECT l_suppkey AS segment_no, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS INTEGER) AS idx,
 l_extendedprice / 1e5 AS x FROM lineitem)"""
SP = LI + ",\nsp AS (SELECT segment_no, idx, 0.001::DOUBLE / (x - 0.0089::DOUBLE) AS x FROM li)"
TR = """tr0 AS (SELECT CAST(label AS BIGINT) AS segment_no, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS tid,
 [v::DOUBLE FOR v IN embedding] AS y FROM embeddings),
tr AS (SELECT segment_no, tid AS row_no, tid, (tid * 50 + floor(tid / 5) * 50) / 250.0::DOUBLE AS begin_s, y FROM tr0)"""
UF = """uf0 AS (SELECT user_id AS segment_no, count(*) AS n, count(*) FILTER (event_type = 'error') AS ne, count(*) FILTER (event_type = 'view') AS nv,
 count(*) FILTER (event_type = 'click') AS nc, count(*) FILTER (event_type = 'purchase') AS np, max(value) AS mx FROM events GROUP BY 1),
uf AS (SELECT segment_no, n % 15 AS n_rows, CASE WHEN segment_no % 7 <> 0 THEN np / 20.0::DOUBLE END AS corr_med, ne / 4.0::DOUBLE AS snr, nc / 40.0::DOUBLE AS periodicity,
 (n % 11) / 100.0::DOUBLE AS spike_fraction, mx / 10.0::DOUBLE AS early_strength, nv / 8.0::DOUBLE AS late_strength, np / 80.0::DOUBLE AS late_periodicity,
 nv / (nv + nc) AS down_fraction, 1 - nv / (nv + nc) AS up_fraction, ne / 30.0::DOUBLE AS transition, segment_no % 5 = 0 AS flip_detected,
 ne / 30.0::DOUBLE AS flip_transition, nv / 60.0::DOUBLE AS flip_spread, np / 20.0::DOUBLE AS flip_rel_strength, n % 13 AS n_vertical, n % 23 AS n_main,
 ne / 20.0::DOUBLE AS ibi_cv, nv / 200.0::DOUBLE AS main_amp_med, nc / 300.0::DOUBLE AS main_prom_med, n % 4 AS n_rescue_only, mx FROM uf0)"""
US = UF + """,
us AS (SELECT segment_no, 'PixelCorrelation Segment ' || segment_no AS segment, n_main % 3 <> 0 AS qc_pass, CASE WHEN n_main % 3 <> 0 THEN 'pass' ELSE 'too_few_rows' END AS qc_reason,
 n_main, n_main - n_rescue_only AS n_main_primary, n_rescue_only AS n_rescue, CAST(segment_no % 9 AS VARCHAR) AS sample_id FROM uf)"""
UE = EV + """,
ue AS (SELECT segment_no, idx, t_s AS time_s, CASE event_type WHEN 'purchase' THEN 'Main Beat' WHEN 'signup' THEN 'Rescue' END AS type, x AS amp, x / 2 AS prom, x / 100 AS width_s,
 idx % 7 AS transient FROM ev WHERE event_type IN ('purchase', 'signup'))"""


def sql(name: str, body: str) -> None:
    ORACLE[name] = body


def quiet(src: str, keys: str, out: str = "nz") -> str:
    """CTEs ending in ``out(keys, noise_mad)``."""
    return f"""{out}_p AS (SELECT {keys}, quantile_cont(x, 0.3) AS p30 FROM {src} GROUP BY {keys}),
{out}_q AS (SELECT {src}.*, p30 FROM {src} JOIN {out}_p USING ({keys})),
{out}_c AS (SELECT {keys}, count(*) FILTER (x <= p30) AS nq FROM {out}_q GROUP BY {keys}),
{out}_z AS (SELECT {out}_q.* FROM {out}_q JOIN {out}_c USING ({keys}) WHERE nq < 5 OR x <= p30),
{out}_m AS (SELECT {keys}, median(x) AS med FROM {out}_z GROUP BY {keys}),
{out} AS (SELECT {keys}, greatest(median(abs(x - med)) * {MAD}, 1e-12) AS noise_mad FROM {out}_z JOIN {out}_m USING ({keys}) GROUP BY {keys})"""


def maxima(src: str, keys: str, out: str) -> str:
    """CTEs ending in ``out(keys, idx, amp)``: plateau-aware local maxima."""
    return f"""{out}_a AS (SELECT {keys}, idx, x, lag(x) OVER (PARTITION BY {keys} ORDER BY idx) AS px FROM {src}),
{out}_r AS (SELECT {keys}, idx, x, px, lead(idx) OVER w AS ni, lead(x) OVER w AS nx FROM {out}_a WHERE px IS NULL OR x <> px WINDOW w AS (PARTITION BY {keys} ORDER BY idx)),
{out} AS (SELECT {keys}, CAST(floor((idx + ni - 1) / 2) AS INTEGER) AS idx, x AS amp FROM {out}_r WHERE px IS NOT NULL AND ni IS NOT NULL AND x > px AND x > nx)"""


def thinned(src: str, keys: str, distance: str, out: str) -> str:
    """CTEs ending in ``out``: greedy distance suppression, highest (then latest) first."""
    return f"""{out}_l AS (SELECT {keys}, list(idx ORDER BY amp DESC, idx DESC) AS l FROM {src} GROUP BY {keys}),
{out}_k AS (SELECT {keys}, unnest(list_reduce(l, lambda acc, p: CASE WHEN len(list_filter(acc, lambda k: abs(k - p) < {distance})) = 0 THEN list_append(acc, p) ELSE acc END, []::INTEGER[])) AS idx FROM {out}_l),
{out} AS (SELECT {src}.* FROM {src} JOIN {out}_k USING ({keys}, idx))"""


def shaped(peaks: str, src: str, keys: str, out: str, extra: str = "") -> str:
    """CTEs ending in ``out(keys, idx, amp, prom, width)``."""
    on = " AND ".join(f"s.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    pk = ", ".join("p." + k.strip() for k in keys.split(","))
    ex = "".join(f", p.{e.strip()}" for e in extra.split(",") if e.strip())
    exq = "".join(f", {e.strip()}" for e in extra.split(",") if e.strip())
    return f"""{out}_h AS (SELECT {pk}, p.idx, p.amp{ex}, max(s.idx) FILTER (s.idx < p.idx AND s.x > p.amp) AS lh, min(s.idx) FILTER (s.idx > p.idx AND s.x > p.amp) AS rh
 FROM {peaks} p JOIN {src} s ON {on} GROUP BY {pk}, p.idx, p.amp{ex}),
{out}_b AS (SELECT {pk}, p.idx, p.amp{ex}, p.amp - greatest(min(s.x) FILTER (s.idx <= p.idx AND s.idx > coalesce(p.lh, -1)), min(s.x) FILTER (s.idx >= p.idx AND s.idx < coalesce(p.rh, 1000000000))) AS prom
 FROM {out}_h p JOIN {src} s ON {on} GROUP BY {pk}, p.idx, p.amp{ex}),
{out}_w AS (SELECT {pk}, p.idx, p.amp{ex}, p.prom, p.amp - 0.5 * p.prom AS h, max(s.idx) FILTER (s.idx <= p.idx AND s.x <= p.amp - 0.5 * p.prom) AS li_, min(s.idx) FILTER (s.idx >= p.idx AND s.x <= p.amp - 0.5 * p.prom) AS ri_
 FROM {out}_b p JOIN {src} s ON {on} GROUP BY {pk}, p.idx, p.amp{ex}, p.prom),
{out}_e AS (SELECT {pk}, p.idx, p.amp{ex}, p.prom, p.h, p.li_, p.ri_, max(s.x) FILTER (s.idx = p.li_) AS l0, max(s.x) FILTER (s.idx = p.li_ + 1) AS l1,
 max(s.x) FILTER (s.idx = p.ri_) AS r0, max(s.x) FILTER (s.idx = p.ri_ - 1) AS r1 FROM {out}_w p JOIN {src} s ON {on} AND (abs(s.idx - p.li_) <= 1 OR abs(s.idx - p.ri_) <= 1) GROUP BY {pk}, p.idx, p.amp{ex}, p.prom, p.h, p.li_, p.ri_),
{out} AS (SELECT {keys}, idx, amp{exq}, prom, (CASE WHEN r0 < h THEN ri_ - (h - r0) / (r1 - r0) ELSE ri_ END) - (CASE WHEN l0 < h THEN li_ + (h - l0) / (l1 - l0) ELSE li_ END) AS width FROM {out}_e)"""


def found(src: str, keys: str, out: str, distance: str, cond: str) -> str:
    return ",\n".join([
        maxima(src, keys, out + "m"), thinned(out + "m", keys, distance, out + "t"), shaped(out + "t", src, keys, out + "s"),
        f"{out} AS (SELECT * FROM {out}s WHERE {cond})",
    ])


RAW = LI + ",\nlt AS (SELECT *, idx // 100 AS tid FROM li),\nlt5 AS (SELECT * FROM lt QUALIFY count(*) OVER (PARTITION BY segment_no, tid) >= 5),\n" + found(
    "lt5", "segment_no, tid", "rw", "3", "prom >= 0.002 AND width >= 2 AND width / 250.0 BETWEEN 0.010 AND 0.80"
) + """,
raw AS (SELECT segment_no, tid::INTEGER AS tid, idx, amp, prom, width / 250.0::DOUBLE AS width_s FROM rw)"""
VAL = RAW + """,
rp AS (SELECT *, lag(idx) OVER (PARTITION BY segment_no ORDER BY idx) AS pi FROM raw),
rawv AS (SELECT rp.segment_no, rp.tid, rp.idx, rp.amp, rp.prom, rp.width_s, min(li.x) AS valley FROM rp LEFT JOIN li ON li.segment_no = rp.segment_no AND li.idx BETWEEN rp.pi AND rp.idx
 GROUP BY ALL)"""
BND = "bnd AS (SELECT segment_no, tid, tid + 1 AS tr_no, tid * 100 AS s, max(idx) + 1 AS e FROM (SELECT *, idx // 100 AS tid FROM li) GROUP BY 1, 2)"
CORN = ["afc_lower_left_value", "afc_lower_right_value", "afc_upper_left_value", "afc_upper_right_value", "x_start_s", "x_end_s"]

# ---- sources and sinks ------------------------------------------------------------
sql("s1_trace_scan", f"""WITH {TR}, c AS (SELECT segment_no, row_no, tid, begin_s, list_filter([CASE WHEN i = 4 AND row_no % 4 = 0 THEN NULL ELSE y[i] END FOR i IN range(1, 65)], lambda v: v IS NOT NULL) AS y FROM tr)
SELECT segment_no::INTEGER AS segment_no, row_no, tid, 250.0::DOUBLE AS fs, 0.0::DOUBLE AS t0, round(begin_s, 6) AS begin_s, len(y)::INTEGER AS n, round(list_max(y), 6) AS y_max, round(y[4], 6) AS y4 FROM c""")
sql("s2_segment_catalogue", """WITH n AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'Summary ' ELSE ' PixelCorrelation  Segment ' END || user_id || ' ' AS sheet_name FROM events)
SELECT sheet_name, regexp_extract(trim(sheet_name), '^(PixelCorrelation)\\s+Segment\\s+(\\d+)$', 1) AS kind, regexp_extract(trim(sheet_name), '^(PixelCorrelation)\\s+Segment\\s+(\\d+)$', 2)::INTEGER AS segment_no
FROM n WHERE regexp_matches(trim(sheet_name), '^(PixelCorrelation)\\s+Segment\\s+(\\d+)$')""")
IDS = EV + """, k AS (SELECT segment_no, idx AS row_no, (props->>'$.k')::INTEGER AS k FROM ev),
ids AS (SELECT segment_no, row_no, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN '  ' WHEN k % 2 = 0 THEN (k % 10) || '.0' ELSE 'S' || (k % 10) END AS v FROM k)"""
NORM = "CASE WHEN trim(v) = '' THEN NULL WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN CAST(CAST(try_cast(v AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(v) END"
sql("s3a_first_sample_id", f"WITH {IDS} SELECT segment_no, arg_min(v, row_no) FILTER (v IS NOT NULL) AS sample_id FROM ids GROUP BY 1")
sql("s3b_frequent_sample_id", f"""WITH {IDS}, n AS (SELECT segment_no, v, count(*) AS n, min(row_no) AS r FROM ids WHERE trim(v) <> '' GROUP BY 1, 2),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY segment_no ORDER BY n DESC, r) = 1) SELECT segment_no, {NORM} AS sample_id FROM b""")
UD = EV + """, ud AS (SELECT segment_no, 'PixelCorrelation Segment ' || segment_no AS segment_name, list(t_s ORDER BY t_s) AS t, list(x ORDER BY t_s) AS a,
 CASE WHEN segment_no % 5 = 0 THEN 'skipped' ELSE 'saved' END AS status FROM ev WHERE event_type = 'error' GROUP BY 1)"""
UDR = "[round(v, 6) FOR v IN t]"
sql("s4_session_json", f"""WITH {UD}, k AS (SELECT *, segment_no % 2 = 1 AS odd, {UDR} AS rt, [round(v, 6) FOR v IN a] AS ra, []::DOUBLE[] AS no FROM ud)
SELECT kind, segment_no::INTEGER AS segment_index, segment_name, status, 'afc_segment_manual_v3' AS schema_version, 1.0::DOUBLE AS afc_lower_left_value, 2.0::DOUBLE AS afc_lower_right_value, 30.0::DOUBLE AS afc_upper_left_value, 40.0::DOUBLE AS afc_upper_right_value,
 0.0::DOUBLE AS x_start_s, 10.0::DOUBLE AS x_end_s, CASE WHEN odd THEN rt ELSE no END AS manual_afc_times_s, CASE WHEN odd AND kind = 'decision' THEN ra ELSE no END AS manual_afc_amps,
 CASE WHEN kind = 'item' THEN CASE WHEN odd THEN rt ELSE no END WHEN odd THEN no ELSE rt END AS manual_added_times_s FROM k, (VALUES ('item'), ('decision')) v(kind)""")
sql("s5_afc_events_csv", f"""WITH {EV} SELECT 'Segment ' || segment_no AS segment_name, segment_no AS segment_index, 0::INTEGER AS main_peak_index, t_s AS time_s, x AS amplitude,
 'manual_curated' AS source, segment_no::VARCHAR AS review_id FROM ev WHERE event_type = 'error'""")
sql("s6_review_log_csv", f"""WITH {UD} SELECT segment_name, segment_no::INTEGER AS segment_index, 1.5::DOUBLE AS afc_lower_left_value, 2.0::DOUBLE AS afc_lower_right_value, 9.0::DOUBLE AS afc_upper_left_value,
 9.0::DOUBLE AS afc_upper_right_value, 0.0::DOUBLE AS x_start_s, 10.0::DOUBLE AS x_end_s, array_to_string([printf('%.6f', v) FOR v IN t], ',') AS manual_afc_times_s,
 array_to_string([printf('%.6f', v) FOR v IN a], ',') AS manual_afc_amps, status FROM ud""")
sql("s8_result_set", f"""WITH {US}, {UE}, d AS (SELECT segment_no FROM ev WHERE event_type = 'error' GROUP BY 1)
SELECT 'summary' AS table_name, segment, n_main::BIGINT AS n, round(n_main / 10.0::DOUBLE * 60, 6) AS total, CASE WHEN qc_pass THEN 'PASS ' ELSE 'REJECT ' END || qc_reason AS label FROM us
UNION ALL SELECT 'main_events', 'PixelCorrelation Segment ' || segment_no, count(*), round(sum(amp), 6), type FROM ue GROUP BY segment_no, type
UNION ALL SELECT 'afc_events', 'PixelCorrelation Segment ' || segment_no, count(*), round(sum(prom), 6), type FROM ue WHERE type = 'Rescue' GROUP BY segment_no, type
UNION ALL SELECT 'review_log', 'PixelCorrelation Segment ' || segment_no, 1, 0.0::DOUBLE, CASE WHEN segment_no % 5 = 0 THEN 'skipped 2' ELSE 'saved 2' END FROM d""")
sql("s9_failure_routing", """SELECT DISTINCT label::BIGINT AS segment_no, CASE label WHEN 1 THEN 'runtime_error_ValueError' WHEN 2 THEN 'empty_signal' WHEN 3 THEN 'runtime_error_ZeroDivisionError' ELSE 'ok' END AS qc_reason FROM embeddings""")

# ---- stitching ------------------------------------------------------------------
sql("t1_compaction", f"""WITH {TR}, c AS (SELECT segment_no, row_no, list_filter(y, lambda v: v <= 0.05) AS y FROM tr)
SELECT segment_no, row_no, CAST(generate_subscripts(y, 1) - 1 AS INTEGER) AS pos, round(unnest(y), 7) AS v FROM c""")
DIR = TR + """, dm AS (SELECT segment_no, row_no, tid, list_min(y) - list_median(y) AS lo, list_max(y) - list_median(y) AS hi FROM tr),
di AS (SELECT segment_no, row_no, tid, CASE WHEN greatest(abs(lo), abs(hi)) < 1e-12 THEN 'flat' WHEN abs(lo) > abs(hi) THEN 'down' ELSE 'up' END AS direction FROM dm)"""
sql("t2_trace_direction", f"WITH {DIR} SELECT segment_no, row_no, direction FROM di")
DST = DIR + """, dd AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY segment_no) AS nd, lag(direction) OVER w AS pd FROM di WHERE direction <> 'flat' WINDOW w AS (PARTITION BY segment_no ORDER BY tid, row_no)),
dg AS (SELECT segment_no, count(*) AS nd, avg((direction = 'down')::INTEGER) AS dn, count(*) FILTER (pd <> direction) AS sw, avg((direction = 'down')::INTEGER) FILTER (r <= nd // 2) AS f,
 avg((direction = 'down')::INTEGER) FILTER (r > nd // 2) AS s FROM dd GROUP BY 1)"""
sql("t3_direction_stats", f"""WITH {DST}, e AS (SELECT segment_no, count(*) AS n_rows FROM tr GROUP BY 1)
SELECT segment_no, n_rows, coalesce(nd, 0) AS row_direction_count, round(coalesce(dn, 0), 6) AS down_fraction, round(coalesce(1 - dn, 0), 6) AS up_fraction, coalesce(sw, 0) AS row_direction_switches,
 round(CASE WHEN nd >= 4 THEN greatest(f * (1 - s), (1 - f) * s) ELSE 0 END, 6) AS row_direction_transition_score FROM e LEFT JOIN dg USING (segment_no)""")
sql("t4_both_polarities", f"""WITH {EV} SELECT segment_no, p::INTEGER AS polarity, count(*) AS n, round(sum(x * p), 4) AS total, max(x * p) AS top FROM ev, (VALUES (1), (-1)) v(p) GROUP BY 1, 2""")
AL = TR + """, al AS (SELECT segment_no, row_no, tid, y, CAST(round_even((begin_s - min(begin_s) OVER (PARTITION BY segment_no)) * 250, 0) AS INTEGER) AS start, len(y) AS n FROM tr)"""
sql("t5_align_by_begin", f"WITH {AL} SELECT segment_no, row_no, start, (start + n)::INTEGER AS \"end\" FROM al")
sql("t6_align_by_overlap", f"""WITH {TR}, a AS (SELECT segment_no, row_no, len(y) AS n, coalesce(sum(greatest(1, len(y) - 14)) OVER (PARTITION BY segment_no ORDER BY tid, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM tr)
SELECT segment_no, row_no, st::INTEGER AS start, (st + n)::INTEGER AS "end" FROM a""")
sql("t6_sheet_overlap", f"""WITH {TR}, a AS (SELECT segment_no, row_no, len(y) AS n, coalesce(sum(greatest(1, len(y) - CASE WHEN segment_no % 3 = 0 THEN 5 ELSE 14 END)) OVER (PARTITION BY segment_no ORDER BY tid, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM tr)
SELECT segment_no, row_no, st::INTEGER AS start, (st + n)::INTEGER AS "end" FROM a""")
sql("t7_partition_bounds", f"""WITH {AL}, b AS (SELECT segment_no, tid, row_no, start, start + n AS en, lag(start + n) OVER w AS pe, lead(start) OVER w AS ns, row_number() OVER w AS tr_no FROM al WINDOW w AS (PARTITION BY segment_no ORDER BY start, tid, row_no)),
c AS (SELECT *, greatest(coalesce(round_even((pe + start) / 2.0::DOUBLE, 0), start), start) AS l, least(coalesce(round_even((en + ns) / 2.0::DOUBLE, 0), en), en) AS r FROM b)
SELECT segment_no, tid, tr_no::INTEGER AS tr_no, CASE WHEN r <= l THEN start ELSE l END::INTEGER AS s, CASE WHEN r <= l THEN en ELSE r END::INTEGER AS e, CASE WHEN pe IS NULL THEN 0 ELSE greatest(0, pe - start) END::INTEGER AS overlap FROM c""")
LV = AL + """, lp AS (SELECT *, lag(y) OVER w AS py, lag(start) OVER w AS ps, lag(start + n) OVER w AS pe FROM al WINDOW w AS (PARTITION BY segment_no ORDER BY start, tid, row_no)),
lo AS (SELECT *, least(pe, start + n) - start AS m FROM lp),
lm AS (SELECT *, CASE WHEN m >= 5 THEN list_median([py[start - ps + i] - y[i] FOR i IN range(1, m + 1)]) END AS med FROM lo),
lg AS (SELECT *, count(*) FILTER (med IS NULL) OVER (PARTITION BY segment_no ORDER BY start, tid, row_no) AS grp FROM lm),
lv AS (SELECT segment_no, row_no, tid, start, n, y, sum(coalesce(med, 0)) OVER (PARTITION BY segment_no, grp ORDER BY start, tid, row_no) AS delta FROM lg)"""
sql("t8_level_offsets", f"WITH {LV} SELECT segment_no, row_no, round(delta, 6) AS delta FROM lv")
BL = LV + """, bl AS (SELECT segment_no, CAST(start + generate_subscripts(y, 1) - 1 AS INTEGER) AS idx, unnest(y) + delta AS v FROM lv), co AS (SELECT segment_no, idx, avg(v) AS x FROM bl GROUP BY 1, 2)"""
sql("t9_blend", f"WITH {BL} SELECT segment_no, idx, round(x, 6) AS x FROM co")
GP = BL + """, gp AS (SELECT segment_no, lag(idx) OVER w AS pi, idx, lag(x) OVER w AS px, x FROM co WINDOW w AS (PARTITION BY segment_no ORDER BY idx))"""
sql("t10_gap_ranges", f"WITH {GP} SELECT segment_no, (pi + 1)::INTEGER AS s, idx AS e FROM gp WHERE idx - pi > 1")
FG = GP + """, fg AS (SELECT segment_no, idx, FALSE AS in_gap, x FROM co UNION ALL SELECT segment_no, (pi + j)::INTEGER, TRUE, px + (x - px) * (j / (idx - pi)) FROM (SELECT *, unnest(range(1, idx - pi)) AS j FROM gp WHERE idx - pi > 1))"""
sql("t11_gap_fill", f"WITH {FG} SELECT segment_no, idx, in_gap, round(x, 6) AS x FROM fg")
sql("t12_baseline_shift", f"WITH {LI}, q AS (SELECT segment_no, quantile_cont(x, 0.05) AS b FROM li GROUP BY 1) SELECT segment_no, idx, round(x - b, 10) AS x FROM li JOIN q USING (segment_no)")
sql("t13_stitch", f"""WITH {GP}, ov AS (SELECT segment_no, start - lag(start) OVER w AS st, lag(start + n) OVER w - start AS o FROM al WINDOW w AS (PARTITION BY segment_no ORDER BY start, tid, row_no)),
g AS (SELECT segment_no, sum(idx - pi - 1) AS gs, count(*) AS ng FROM gp WHERE idx - pi > 1 GROUP BY 1), o AS (SELECT segment_no, median(greatest(0, o)::DOUBLE) AS mo FROM ov WHERE o IS NOT NULL GROUP BY 1)
SELECT segment_no, count(*) AS stitch_rows, round(max(abs(delta)), 6) AS max_offset, 0.0::DOUBLE AS time_origin_s, TRUE AS used_begin, max(start + n)::INTEGER AS n_samples, round(median(abs(delta)), 6) AS median_offset,
 coalesce(any_value(mo), 0) AS median_overlap, coalesce(any_value(gs), 0)::BIGINT AS gap_samples, coalesce(any_value(ng), 0) AS n_gaps FROM lv LEFT JOIN g USING (segment_no) LEFT JOIN o USING (segment_no) GROUP BY 1""")
sql("t14_map_transients", f"WITH {LI} SELECT segment_no, idx, CASE WHEN (idx // 100) % 4 <> 2 THEN (idx // 100)::INTEGER END AS tid FROM li")
sql("t15_map_noise", f"""WITH {LI}, lt AS (SELECT *, idx // 100 AS tid FROM li), {quiet('lt', 'segment_no, tid')}
SELECT segment_no, idx, round(CASE WHEN tid % 4 <> 2 THEN noise_mad ELSE 0 END, 8) AS noise FROM lt JOIN nz USING (segment_no, tid)""")
sql("t16_time_axis", f"WITH {LI} SELECT segment_no, idx, round(12.5 + idx / 250.0::DOUBLE, 6) AS t_s FROM li")
sql("t17_segment_number", """WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE 'x Segment  ' || s_suppkey || ' Segment 9' END AS name FROM supplier)
SELECT s_suppkey, coalesce(nullif(regexp_extract(name, 'Segment\\s+(\\d+)', 1), '')::INTEGER, -1) AS segment_index FROM n""")

# ---- statistics -----------------------------------------------------------------
sql("a1_noise_mad", f"WITH {EV}, {quiet('ev', 'segment_no')} SELECT segment_no, round(noise_mad, 6) AS noise_mad FROM nz")
SNR = """sm AS (SELECT segment_no, median(x) AS m FROM {s} GROUP BY 1), sg AS (SELECT segment_no, median(abs(x - m)) * """ + MAD + """ AS signal_mad FROM {s} JOIN sm USING (segment_no) GROUP BY 1)"""
sql("a2_global_snr", f"""WITH {LI}, {quiet('li', 'segment_no')}, {SNR.format(s='li')}
SELECT segment_no, round(signal_mad / noise_mad, 6) AS snr, round(noise_mad, 6) AS noise_mad, round(signal_mad, 6) AS signal_mad FROM nz JOIN sg USING (segment_no)""")


def steps(src: str) -> str:
    return f"""st AS (SELECT segment_no, idx, x, x - lag(x) OVER w AS d, lead(x) OVER w - x AS dn, count(*) OVER (PARTITION BY segment_no) AS n FROM {src} WINDOW w AS (PARTITION BY segment_no ORDER BY idx)),
dm AS (SELECT segment_no, median(d) AS md, quantile_cont(abs(d), 0.99) AS q99, quantile_cont(abs(d), 0.999) AS q999 FROM st GROUP BY 1),
dd AS (SELECT segment_no, median(abs(d - md)) * {MAD} AS mad FROM st JOIN dm USING (segment_no) GROUP BY 1)"""


sql("a3_spike_fraction", f"""WITH {SP}, {steps('sp')} SELECT segment_no, round(avg((abs((d - md) / greatest(mad, 1e-12)) > 8)::INTEGER) FILTER (d IS NOT NULL), 9) AS spike_fraction
FROM st JOIN dm USING (segment_no) JOIN dd USING (segment_no) GROUP BY 1""")
sql("a4_moving_average", f"""WITH {LI}, m AS (SELECT segment_no, idx, x, count(*) OVER (PARTITION BY segment_no) AS n, sum(x) OVER (PARTITION BY segment_no ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS s FROM li)
SELECT segment_no, idx, round(CASE WHEN n < 7 THEN x ELSE s END, 9) AS smooth FROM m""")


def trend(src: str) -> str:
    """fs = 1: window 31, shrinking to an odd three quarters when the signal is short."""
    return f"""tn AS (SELECT segment_no, count(*) AS n FROM {src} GROUP BY 1),
tw0 AS (SELECT segment_no, n, CASE WHEN 31 >= n THEN greatest(31, round_even(0.75::DOUBLE * n, 0))::INTEGER ELSE 31 END AS w0 FROM tn),
tw AS (SELECT segment_no, n, CASE WHEN w0 % 2 = 0 THEN w0 - 1 ELSE w0 END AS w FROM tw0),
tj AS (SELECT a.segment_no, a.idx, w, n, a.idx + o.o AS j FROM {src} a JOIN tw USING (segment_no), (SELECT unnest(range(-15, 16)) AS o) o WHERE abs(o.o) <= w // 2),
tr_ AS (SELECT segment_no, idx, w, CASE WHEN j < 0 THEN -1 - j WHEN j >= n THEN 2 * n - 1 - j ELSE j END AS j FROM tj WHERE n >= 30),
td AS (SELECT t.segment_no, t.idx, list_sort(list(s.x))[CAST(floor(any_value(w) * 20.0::DOUBLE / 100) AS INTEGER) + 1] AS trend FROM tr_ t JOIN {src} s ON s.segment_no = t.segment_no AND s.idx = t.j GROUP BY 1, 2)"""


sql("a5_rolling_trend", f"WITH {EV}, {trend('ev')} SELECT ev.segment_no, ev.idx, round(trend, 6) AS trend FROM ev LEFT JOIN td USING (segment_no, idx)")
sql("a6_remove_drift", f"""WITH {EV}, e4 AS (SELECT segment_no, idx, x + CASE WHEN segment_no % 3 = 0 THEN 0 ELSE 4 * idx END AS x FROM ev), {trend('e4')},
j AS (SELECT e4.*, trend FROM e4 LEFT JOIN td USING (segment_no, idx)),
m AS (SELECT segment_no, quantile_cont(trend, 0.05) AS t5, median(trend) AS t50, quantile_cont(trend, 0.95) AS t95, quantile_cont(x, 0.05) AS x5, quantile_cont(x, 0.95) AS x95, corr(idx, trend) AS c FROM j GROUP BY 1),
r AS (SELECT *, (t95 - t5) / greatest(x95 - x5, 1e-12) AS ratio FROM m),
a AS (SELECT *, coalesce(ratio >= 0.18 AND (coalesce(abs(c) >= 0.30, FALSE) OR ratio >= 1.35 * 0.18), FALSE) AS det FROM r),
y AS (SELECT j.segment_no, idx, x, CASE WHEN det THEN x - (trend - t50) ELSE x END AS y, det, ratio, c FROM j JOIN a USING (segment_no)),
b AS (SELECT segment_no, quantile_cont(y, 0.05) AS base FROM y GROUP BY 1)
SELECT segment_no, idx, round(CASE WHEN det THEN y - base ELSE x END, 6) AS x, det AS drift_detected, det AS applied, round(coalesce(ratio, 0), 6) AS drift_ratio, round(c, 6) AS trend_time_corr FROM y JOIN b USING (segment_no)""")


def period(src: str, out: str = "pd", k: str = "segment_no") -> str:
    """fs = 250."""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in k.split(","))
    ak = ", ".join("a." + c.strip() for c in k.split(","))
    return f"""{out}m AS (SELECT {k}, median(x) AS pmd, count(*) AS pn FROM {src} GROUP BY {k}),
{out}z AS (SELECT {src}.*, x - pmd AS z, pn FROM {src} JOIN {out}m USING ({k})),
{out}0 AS (SELECT {k}, sum(z * z) AS s0, any_value(pn) AS pn, stddev_pop(z) AS sd FROM {out}z GROUP BY {k}),
{out}l AS (SELECT {ak}, b.idx - a.idx AS idx, sum(a.z * b.z) AS sp FROM {out}z a JOIN {out}z b ON {on} AND b.idx - a.idx BETWEEN 37 AND least(a.pn - 1, 500) GROUP BY ALL),
{out}x AS (SELECT {k}, idx, sp / s0 AS x FROM {out}l JOIN {out}0 USING ({k}) WHERE pn >= 125 AND sd >= 1e-12),
{maxima(out + 'x', k, out + 'p')}, {shaped(out + 'p', out + 'x', k, out + 's')},
{out}b AS (SELECT {k}, arg_max(idx, (prom, -idx)) AS lag, arg_max(amp, (prom, -idx)) AS v FROM {out}s WHERE prom >= 0.02 GROUP BY {k}),
{out} AS (SELECT {k}, lag / 250.0::DOUBLE AS period_s, coalesce(v, 0) AS score FROM {out}0 LEFT JOIN {out}b USING ({k}))"""


sql("a7_dominant_period", f"WITH {LI}, {period('li')} SELECT segment_no, round(period_s, 6) AS period_s, round(score, 6) AS score FROM pd")
COR = """cm AS (SELECT segment_no, min(len(y)) AS m FROM tr GROUP BY 1), cy AS (SELECT segment_no, row_no, y[1:m] AS y FROM tr JOIN cm USING (segment_no)),
cz AS (SELECT segment_no, row_no, [v - list_avg(y) FOR v IN y] AS z FROM cy), cn AS (SELECT segment_no, row_no, z, sqrt(list_dot_product(z, z)) AS nm FROM cz),
cc AS (SELECT a.segment_no, median(list_dot_product(a.z, b.z) / (a.nm * b.nm)) AS corr_med FROM cn a JOIN cn b ON a.segment_no = b.segment_no AND a.row_no < b.row_no WHERE a.nm > 0 AND b.nm > 0 GROUP BY 1)"""
sql("a8_trace_correlation", f"WITH {TR}, {COR} SELECT segment_no, round(corr_med, 6) AS corr_med FROM cc")
FLIP = """fm AS (SELECT segment_no, median(x) AS md, count(*) AS n FROM {s} GROUP BY 1), fc AS (SELECT segment_no, idx, x - md AS x, n FROM {s} JOIN fm USING (segment_no) WHERE n >= 200)"""
sql("a9_mixed_direction_flip", f"""WITH {LI}, lf AS (SELECT segment_no, idx, CASE WHEN idx < 300 THEN x ELSE -x END * 0.5 + 0.5 AS x FROM li), {FLIP.format(s='lf')}, {quiet('fc', 'segment_no')},
fs AS (SELECT segment_no, sgn, idx, x * sgn AS x FROM fc, (VALUES (1), (-1)) v(sgn)), {found('fs', 'segment_no, sgn', 'fp', '25', 'width >= 2 AND width / 250.0 BETWEEN 0.014 AND 0.80')},
fk AS (SELECT fp.*, n FROM fp JOIN nz USING (segment_no) JOIN fm USING (segment_no) WHERE prom >= greatest(0.010, 2.8 * noise_mad)),
g AS (SELECT segment_no, sgn, count(*) AS c, avg((idx < n // 2)::INTEGER) AS e, median(prom) AS p, median(idx::DOUBLE) AS m FROM fk GROUP BY 1, 2),
w AS (SELECT fm.segment_no, fm.n, coalesce(a.c, 0) AS n_pos, coalesce(b.c, 0) AS n_neg, a.e AS ea, b.e AS eb, a.p AS pa, b.p AS pb, a.m AS ma, b.m AS mb FROM fm LEFT JOIN g a ON a.segment_no = fm.segment_no AND a.sgn = 1 LEFT JOIN g b ON b.segment_no = fm.segment_no AND b.sgn = -1),
o AS (SELECT *, n_pos >= 2 AND n_neg >= 2 AS ok, greatest(ea * (1 - eb), eb * (1 - ea)) AS tr, abs(ma - mb) / n AS sp, least(pa, pb) / greatest(pa, pb, 1e-12) AS rs FROM w)
SELECT segment_no, round(CASE WHEN ok THEN tr ELSE 0 END, 6) AS flip_transition, round(CASE WHEN ok THEN sp ELSE 0 END, 6) AS flip_spread, round(CASE WHEN ok THEN rs ELSE 0 END, 6) AS flip_rel_strength, n_pos, n_neg,
 ok AND tr >= 0.5 AND sp >= 0.16 AND rs >= 0.45 AS flip_detected FROM o""")
IBI = """ig AS (SELECT segment_no, idx - lag(idx) OVER (PARTITION BY segment_no ORDER BY idx) AS g FROM {s})"""
sql("a11_interbeat_cv", f"""WITH {EV}, pu AS (SELECT * FROM ev WHERE event_type = 'purchase'), {IBI.format(s='pu')}
SELECT segment_no, round(CASE WHEN count(*) >= 3 THEN stddev_pop(g) / avg(g) END, 6) AS ibi_cv FROM ig GROUP BY 1""")
QS = "ln(1 + greatest({s}, 0)) + 0.14 * least({n}, 12) - CASE WHEN {c} IS NOT NULL THEN 0.90 * greatest(0, {c} - 0.12) ELSE 0 END - CASE WHEN {n} = 0 THEN 1.5 ELSE 0 END"
sql("a12_quality_score", f"WITH {UF} SELECT segment_no, round({QS.format(s='snr', n='n_main', c='corr_med')}, 6) AS quality_score FROM uf")
sql("a13_fs_from_times", f"""WITH {EV}, d AS (SELECT segment_no, (t_s - 1704067200) - lag(t_s - 1704067200) OVER (PARTITION BY segment_no ORDER BY idx) AS dt FROM ev)
SELECT segment_no, round(1.0::DOUBLE / median(dt) FILTER (dt > 0), 9) AS fs_est FROM d GROUP BY 1""")
PS = f"""{FLIP.format(s='li').replace(' WHERE n >= 200', '')}, {quiet('fc', 'segment_no')}, {found('fc', 'segment_no', 'pp', '20', 'width >= 2')},
pq AS (SELECT pp.*, width / 250.0::DOUBLE AS w FROM pp JOIN nz USING (segment_no) WHERE prom >= greatest(0.002, 2.7 * noise_mad)),
pk AS (SELECT * FROM pq QUALIFY count(*) FILTER (w BETWEEN 0.008 AND 0.90) OVER (PARTITION BY segment_no) < 3 OR w BETWEEN 0.008 AND 0.90),
pt AS (SELECT segment_no, median(prom) AS tp FROM (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY segment_no ORDER BY prom DESC, idx DESC) <= 12) GROUP BY 1),
pa AS (SELECT segment_no, count(*) AS c, median(w) AS mw FROM pk GROUP BY 1), {IBI.format(s='pk')}, ic AS (SELECT segment_no, stddev_pop(g) / avg(g) AS cv FROM ig GROUP BY 1), {period('fc')}"""
sql("a14_polarity_score", f"""WITH {LI}, {PS} SELECT segment_no, coalesce(c, 0) AS n_peaks, round(CASE WHEN c >= 3 THEN 1.4 * ln(1 + greatest(tp / noise_mad, 0)) + 0.9 * score + 0.5 * greatest(least(mw / 0.22, 2), 0)
 - 1.6 * greatest(cv, 0) - 0.25 * greatest(0, c / (n / 250.0::DOUBLE) - 3.8) END, 6) AS polarity_score FROM fm JOIN nz USING (segment_no) JOIN pd USING (segment_no) LEFT JOIN pa USING (segment_no) LEFT JOIN pt USING (segment_no) LEFT JOIN ic USING (segment_no)""")


def polarity(src: str, k: str) -> str:
    """CTEs ending in ``po(k, n_peaks, score)``; fs = 250."""
    return f"""ym AS (SELECT {k}, median(x) AS md, count(*) AS n FROM {src} GROUP BY {k}), yc AS (SELECT {k}, idx, x - md AS x, n FROM {src} JOIN ym USING ({k})),
{quiet('yc', k)}, {found('yc', k, 'yp', '20', 'width >= 2')}, yq AS (SELECT yp.*, width / 250.0::DOUBLE AS w FROM yp JOIN nz USING ({k}) WHERE prom >= greatest(0.002, 2.7 * noise_mad)),
yk AS (SELECT * FROM yq QUALIFY count(*) FILTER (w BETWEEN 0.008 AND 0.90) OVER (PARTITION BY {k}) < 3 OR w BETWEEN 0.008 AND 0.90),
yt AS (SELECT {k}, median(prom) AS tp FROM (SELECT * FROM yk QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY prom DESC, idx DESC) <= 12) GROUP BY {k}),
ya AS (SELECT {k}, count(*) AS c, median(w) AS mw FROM yk GROUP BY {k}), yi AS (SELECT {k}, idx - lag(idx) OVER (PARTITION BY {k} ORDER BY idx) AS g FROM yk), yv AS (SELECT {k}, stddev_pop(g) / avg(g) AS cv FROM yi GROUP BY {k}), {period('yc', k=k)},
po AS (SELECT {k}, coalesce(c, 0) AS n_peaks, CASE WHEN c >= 3 THEN 1.4 * ln(1 + greatest(tp / noise_mad, 0)) + 0.9 * pd.score + 0.5 * greatest(least(mw / 0.22, 2), 0) - 1.6 * greatest(cv, 0) - 0.25 * greatest(0, c / (n / 250.0::DOUBLE) - 3.8) END AS score
 FROM ym JOIN nz USING ({k}) JOIN pd USING ({k}) LEFT JOIN ya USING ({k}) LEFT JOIN yt USING ({k}) LEFT JOIN yv USING ({k}))"""


sql("a15_choose_polarity", f"""WITH {LI}, c0 AS (SELECT segment_no, idx, x, count(*) OVER (PARTITION BY segment_no) AS len FROM li), c1 AS (SELECT *, CASE WHEN len < 174 THEN least(62, len // 10) ELSE 62 END AS e0 FROM c0),
c2 AS (SELECT *, CASE WHEN len - 2 * e0 > 50 THEN e0 ELSE 0 END AS e FROM c1), c3 AS (SELECT segment_no, (idx - e)::INTEGER AS idx, x, len FROM c2 WHERE idx >= e AND idx < len - e),
c4 AS (SELECT segment_no, median(x) AS md, count(*) AS n, round_even(greatest(least(any_value(len) / 250.0::DOUBLE * 0.35, 8.0), 1.5) * 250, 0)::INTEGER AS w0 FROM c3 GROUP BY 1),
c5 AS (SELECT *, greatest(31, w0) + CASE WHEN greatest(31, w0) % 2 = 0 THEN 1 ELSE 0 END AS w1, greatest(31, round_even(0.75::DOUBLE * n, 0)::INTEGER) AS w2 FROM c4),
c6 AS (SELECT segment_no, md, n, CASE WHEN w1 >= n THEN w2 - CASE WHEN w2 % 2 = 0 THEN 1 ELSE 0 END ELSE w1 END AS w FROM c5),
cz AS (SELECT c3.segment_no, idx, x - md AS x FROM c3 JOIN c6 USING (segment_no)),
cj AS (SELECT cz.segment_no, idx, n, w, idx + unnest(range(-(w // 2), w // 2 + 1)) AS j FROM cz JOIN c6 USING (segment_no) WHERE n >= 30),
ct AS (SELECT j.segment_no, j.idx, list_sort(list(z.x))[CAST(floor(any_value(w) * 20.0::DOUBLE / 100) AS INTEGER) + 1] AS trend FROM cj j JOIN cz z ON z.segment_no = j.segment_no AND z.idx = CASE WHEN j < 0 THEN -1 - j WHEN j >= n THEN 2 * n - 1 - j ELSE j END GROUP BY 1, 2),
cm AS (SELECT segment_no, median(trend) AS tm FROM ct GROUP BY 1),
cd AS (SELECT cz.segment_no, cz.idx, x - coalesce(trend - tm, 0) AS x FROM cz LEFT JOIN ct USING (segment_no, idx) LEFT JOIN cm USING (segment_no)),
cs AS (SELECT segment_no, idx, CASE WHEN count(*) OVER (PARTITION BY segment_no) < 5 THEN x ELSE sum(x) OVER (PARTITION BY segment_no ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END AS x FROM cd),
cb AS (SELECT segment_no, sgn, idx, x * sgn AS x FROM cs, (VALUES (1), (-1)) v(sgn)), {polarity('cb', 'segment_no, sgn')},
cg AS (SELECT segment_no, idx, abs(x) AS x FROM cs), {found('cg', 'segment_no', 'vp', '20', 'TRUE')},
v1 AS (SELECT segment_no, sign(cs.x) AS sg FROM (SELECT * FROM vp QUALIFY count(*) OVER (PARTITION BY segment_no) >= 3 AND row_number() OVER (PARTITION BY segment_no ORDER BY amp DESC, idx DESC) <= 12) t JOIN cs USING (segment_no, idx)),
v2 AS (SELECT segment_no, avg((sg > 0)::INTEGER) AS up FROM v1 WHERE sg <> 0 GROUP BY 1 HAVING count(*) >= 3),
z AS (SELECT a.segment_no, a.score AS k, b.score AS i, a.n_peaks AS n_pos, b.n_peaks AS n_neg, CASE WHEN up > 0.5 THEN up WHEN up < 0.5 THEN 1 - up WHEN up = 0.5 THEN 0 END AS conf, up < 0.5 AS vi,
 abs(coalesce(b.score, '-inf'::DOUBLE) - coalesce(a.score, '-inf'::DOUBLE)) AS gap, a.score IS NOT NULL OR b.score IS NOT NULL AS anys, coalesce(b.score, '-inf'::DOUBLE) > coalesce(a.score, '-inf'::DOUBLE) AS better
 FROM po a JOIN po b ON a.segment_no = b.segment_no AND a.sgn = 1 AND b.sgn = -1 LEFT JOIN v2 ON v2.segment_no = a.segment_no)
SELECT segment_no, round(k, 6) AS score_keep, round(i, 6) AS score_invert, n_pos, n_neg, round(conf, 6) AS vote_conf, round(CASE WHEN anys THEN gap END, 6) AS score_gap,
 CASE WHEN anys AND gap >= 0.12 THEN better WHEN coalesce(conf >= 0.65, FALSE) THEN vi WHEN anys THEN better ELSE coalesce(vi, FALSE) END AS invert,
 CASE WHEN anys AND gap >= 0.12 THEN 'morphology_score' WHEN coalesce(conf >= 0.65, FALSE) THEN 'vote_tiebreak' WHEN anys THEN 'morphology_fallback' ELSE 'vote_fallback' END AS method FROM z""")

SP2 = "segment_no, polarity"
sql("a10_structure_features", f"""WITH {FG}{DST[len(TR):]}, {COR}, q0 AS (SELECT segment_no, p::INTEGER AS polarity, idx, x * p AS x FROM fg, (VALUES (1), (-1)) v(p)),
qb AS (SELECT {SP2}, quantile_cont(x, 0.05) AS b FROM q0 GROUP BY ALL), sig AS (SELECT {SP2}, idx, x - b AS x FROM q0 JOIN qb USING ({SP2})),
{quiet('sig', SP2)}, qm AS (SELECT {SP2}, median(x) AS md, count(*) AS n FROM sig GROUP BY ALL), qs AS (SELECT {SP2}, median(abs(x - md)) * {MAD} AS signal_mad FROM sig JOIN qm USING ({SP2}) GROUP BY ALL), {period('sig', k=SP2)},
qd AS (SELECT {SP2}, x - lag(x) OVER (PARTITION BY {SP2} ORDER BY idx) AS d FROM sig), qe AS (SELECT {SP2}, median(d) AS dmd FROM qd GROUP BY ALL), qf AS (SELECT {SP2}, median(abs(d - dmd)) * {MAD} AS dmad FROM qd JOIN qe USING ({SP2}) GROUP BY ALL),
qg AS (SELECT {SP2}, coalesce(avg((abs((d - dmd) / greatest(dmad, 1e-12)) > 8)::INTEGER) FILTER (d IS NOT NULL), 0) AS spike_fraction FROM qd JOIN qe USING ({SP2}) JOIN qf USING ({SP2}) GROUP BY ALL),
f0 AS (SELECT {SP2}, idx, x - md AS x, n FROM sig JOIN qm USING ({SP2}) WHERE n >= 200), {quiet('f0', SP2, 'fz')}, f1 AS (SELECT {SP2}, sgn, idx, x * sgn AS x FROM f0, (VALUES (1), (-1)) v(sgn)),
{found('f1', SP2 + ', sgn', 'fp', '25', 'width >= 2 AND width / 250.0 BETWEEN 0.014 AND 0.80')}, f2 AS (SELECT fp.*, n FROM fp JOIN fz USING ({SP2}) JOIN qm USING ({SP2}) WHERE prom >= greatest(0.010, 2.8 * fz.noise_mad)),
f3 AS (SELECT {SP2}, sgn, count(*) AS c, avg((idx < n // 2)::INTEGER) AS e, median(prom) AS pr, median(idx::DOUBLE) AS mi FROM f2 GROUP BY ALL),
f4 AS (SELECT qm.segment_no, qm.polarity, qm.n, coalesce(a.c, 0) >= 2 AND coalesce(b.c, 0) >= 2 AS ok, greatest(a.e * (1 - b.e), b.e * (1 - a.e)) AS ft, abs(a.mi - b.mi) / qm.n AS fs_, least(a.pr, b.pr) / greatest(a.pr, b.pr, 1e-12) AS fr
 FROM qm LEFT JOIN f3 a ON a.segment_no = qm.segment_no AND a.polarity = qm.polarity AND a.sgn = 1 LEFT JOIN f3 b ON b.segment_no = qm.segment_no AND b.polarity = qm.polarity AND b.sgn = -1),
t0 AS (SELECT segment_no, p::INTEGER AS polarity, tid, row_no, generate_subscripts(y, 1)::INTEGER - 1 AS idx, unnest(y) * p AS x FROM tr, (VALUES (1), (-1)) v(p)), t1 AS (SELECT {SP2}, tid, row_no, quantile_cont(x, 0.05) AS b FROM t0 GROUP BY ALL),
t2 AS (SELECT {SP2}, tid, row_no, idx, x - b AS x FROM t0 JOIN t1 USING ({SP2}, tid, row_no)), {quiet('t2', SP2 + ', tid, row_no', 'tz')},
t3 AS (SELECT {SP2}, tid, row_no, idx, sum(x) OVER (PARTITION BY {SP2}, tid, row_no ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS x FROM t2),
{found('t3', SP2 + ', tid, row_no', 'tp', '20', 'width >= 2')},
t4 AS (SELECT tz.segment_no, tz.polarity, tz.tid, tz.row_no, greatest(least(coalesce(max(tp.prom) FILTER (tp.prom >= greatest(0.75 * nz.noise_mad, 2.2 * tz.noise_mad, 0.006)), 0) / greatest(any_value(tz.noise_mad), 1e-12), 250), 0) AS strength
 FROM tz JOIN nz USING ({SP2}) LEFT JOIN tp ON tp.segment_no = tz.segment_no AND tp.polarity = tz.polarity AND tp.tid = tz.tid AND tp.row_no = tz.row_no GROUP BY ALL),
t5 AS (SELECT *, count(*) OVER (PARTITION BY {SP2}) AS k, row_number() OVER (PARTITION BY {SP2} ORDER BY tid, row_no) AS r FROM t4), t6 AS (SELECT *, CASE WHEN k >= 4 THEN k // 2 ELSE k END AS cut FROM t5),
t7 AS (SELECT {SP2}, median(strength) FILTER (r <= cut) AS early_strength, median(strength) FILTER (r > cut OR k < 4) AS late_strength FROM t6 GROUP BY ALL), e AS (SELECT segment_no, count(*) AS n_rows FROM tr GROUP BY 1)
SELECT segment_no, polarity, round(signal_mad / nz.noise_mad, 5) AS snr, round(nz.noise_mad, 5) AS noise_mad, round(signal_mad, 5) AS signal_mad, round(period_s, 5) AS period_s, round(score, 5) AS periodicity, round(spike_fraction, 5) AS spike_fraction,
 round(CASE WHEN ok THEN ft ELSE 0 END, 5) AS flip_transition, round(CASE WHEN ok THEN fs_ ELSE 0 END, 5) AS flip_spread, round(CASE WHEN ok THEN fr ELSE 0 END, 5) AS flip_rel_strength, ok AND ft >= 0.5 AND fs_ >= 0.16 AND fr >= 0.45 AS flip_detected,
 round(early_strength, 5) AS early_strength, round(late_strength, 5) AS late_strength, 0.0::DOUBLE AS late_periodicity, n_rows, coalesce(nd, 0) AS row_direction_count, round(coalesce(dn, 0), 5) AS down_fraction, round(coalesce(1 - dn, 0), 5) AS up_fraction,
 coalesce(sw, 0) AS row_direction_switches, round(CASE WHEN nd >= 4 THEN greatest(f * (1 - s), (1 - f) * s) ELSE 0 END, 5) AS transition, round(corr_med, 5) AS corr_med
FROM nz JOIN qs USING ({SP2}) JOIN pd USING ({SP2}) JOIN qg USING ({SP2}) JOIN f4 USING ({SP2}) JOIN t7 USING ({SP2}) LEFT JOIN e USING (segment_no) LEFT JOIN dg USING (segment_no) LEFT JOIN cc USING (segment_no)""")
sql("a16_row_direction_override", f"""WITH {UF}, c AS (SELECT segment_no, CASE WHEN n_main % 3 = 0 THEN 'morphology_score' ELSE 'vote_fallback' END AS method, n_main % 2 = 0 AS invert, snr AS score_gap, ibi_cv AS vote_conf,
 least(n_main / 20.0::DOUBLE, 1.0) AS dn FROM uf), d AS (SELECT *, (method <> 'morphology_score' OR coalesce(score_gap < 0.12, FALSE)) AND greatest(dn, 1 - dn) >= 0.80 AS cl FROM c)
SELECT segment_no, CASE WHEN cl THEN dn >= 1 - dn ELSE invert END AS invert, CASE WHEN cl THEN 'row_direction_prior' ELSE method END AS method, round(CASE WHEN NOT cl THEN vote_conf END, 6) AS vote_conf FROM d""")
sql("a17_orientation_sanity", f"""WITH {UF} SELECT segment_no, round(CASE WHEN n_rows > 3 THEN snr + 0.35 * main_prom_med + 0.20 * main_amp_med - 1.0 * (n_rescue_only / greatest(n_main, 1)) END, 6) AS sanity_score FROM uf""")

# ---- artifacts --------------------------------------------------------------------
def centers(src: str, thr: str, low: str, high: str, gap: int, out: str = "ce") -> str:
    return f"""{steps(src)}, jt AS (SELECT st.*, {thr} AS thr FROM st JOIN dm USING (segment_no) JOIN dd USING (segment_no)),
cd AS (SELECT segment_no, list(idx ORDER BY idx) AS l FROM jt WHERE n >= 5 AND thr > 1e-12 AND d * dn < 0 AND least(abs(d), abs(dn)) >= {low} * thr AND greatest(abs(d), abs(dn)) >= {high} * thr GROUP BY 1),
{out} AS (SELECT segment_no, unnest(list_reduce(l, lambda acc, p: CASE WHEN len(acc) = 0 OR p - acc[-1] > {gap} THEN list_append(acc, p) ELSE acc END, []::INTEGER[])) AS idx FROM cd)"""


VL = centers("sp", "greatest(2.8 * q99, 0.55 * q999)", "1.0", "1.15", 2)
DC = centers("sp", "greatest(8.0 * greatest(mad, 1e-12), 0.9 * q999)", "0.45", "1.0", 1)
sql("v1_vertical_lines", f"WITH {SP}, {VL} SELECT segment_no, idx FROM ce")
sql("v3_discontinuities", f"WITH {SP}, {DC} SELECT segment_no, idx FROM ce")
sql("v2_vertical_repair", f"""WITH {SP}, {VL}, k AS (SELECT * FROM ce QUALIFY count(*) OVER (PARTITION BY segment_no) <= 10),
z AS (SELECT sp.*, (SELECT max(k.idx) FROM k WHERE k.segment_no = sp.segment_no AND abs(k.idx - sp.idx) <= 1) AS c FROM sp),
a AS (SELECT z.segment_no, z.idx, z.x, z.c, p.x AS y0, q.x AS y1 FROM z LEFT JOIN sp p ON p.segment_no = z.segment_no AND p.idx = z.c - 2 LEFT JOIN sp q ON q.segment_no = z.segment_no AND q.idx = z.c + 2)
SELECT segment_no, idx, c IS NOT NULL AS repaired, round(CASE WHEN c IS NULL THEN x ELSE (1 - (idx - c + 2) / 4) * y0 + ((idx - c + 2) / 4) * y1 END, 9) AS x FROM a""")
sql("v4_exclude_near_discontinuities", f"""WITH {SP}, {DC}, {maxima('sp', 'segment_no', 'mx')} SELECT segment_no, idx FROM mx WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.segment_no = mx.segment_no AND abs(ce.idx - mx.idx) <= 5)""")
sql("v5_exclude_in_gaps", f"""WITH {LI}, {maxima('li', 'segment_no', 'mx')}, {BND}, g AS (SELECT segment_no, s + 10 AS s, e - 20 AS e FROM bnd WHERE tid % 3 = 1 AND e - 20 > s + 10)
SELECT segment_no, idx FROM mx WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.segment_no = mx.segment_no AND mx.idx >= g.s AND mx.idx < g.e)""")
NEEDLE = "(greatest(abs(d), abs(dn)) / (p.prom + 1e-12) >= 0.82 AND greatest(abs(d), abs(dn)) >= greatest(0.010, 5.0 * greatest(mad, 1e-12)) AND abs(dn - d) >= 7.0 * greatest(mad, 1e-12))"
sql("v6_needle_spikes", f"""WITH {SP}, {steps('sp')}, {maxima('sp', 'segment_no', 'mx')}, p AS (SELECT *, amp AS prom FROM mx)
SELECT p.segment_no, p.idx, coalesce({NEEDLE}, FALSE) AS needle FROM p JOIN st USING (segment_no, idx) JOIN dd USING (segment_no)""")

# ---- quality control ----------------------------------------------------------------
MIX = UF + """, m1 AS (SELECT *, coalesce(least(down_fraction, up_fraction), 0) AS mixed_minor FROM uf),
m2 AS (SELECT *, greatest(least((mixed_minor - 0.22::DOUBLE) / 0.78::DOUBLE, 1), 0) AS mixed_minor_term, greatest(least((transition - 0.30::DOUBLE) / 0.70::DOUBLE, 1), 0) AS mixed_transition_term,
 greatest(least((0.58::DOUBLE - periodicity) / 0.58::DOUBLE, 1), 0) AS mixed_periodicity_term, CASE WHEN corr_med IS NULL THEN 1.0 ELSE greatest(least((0.75::DOUBLE - corr_med) / 0.75::DOUBLE, 1), 0) END AS mixed_corr_term FROM m1),
m3 AS (SELECT *, 0.35::DOUBLE * mixed_minor_term + 0.30::DOUBLE * mixed_transition_term + 0.20::DOUBLE * mixed_periodicity_term + 0.15::DOUBLE * mixed_corr_term + CASE WHEN flip_detected THEN 0.20::DOUBLE ELSE 0 END AS mixed_score,
 mixed_minor >= 0.18 OR transition >= 0.20 OR flip_detected AS mixed_gate FROM m2), mx AS (SELECT *, mixed_gate AND mixed_score >= 0.65 AS mixed_reject FROM m3)"""
sql("q1_mixed_orientation", f"""WITH {MIX} SELECT segment_no, round(mixed_minor, 6) AS mixed_minor, round(mixed_minor_term, 6) AS mixed_minor_term, round(mixed_transition_term, 6) AS mixed_transition_term,
 round(mixed_periodicity_term, 6) AS mixed_periodicity_term, round(mixed_corr_term, 6) AS mixed_corr_term, round(mixed_score, 6) AS mixed_score, mixed_gate, mixed_reject FROM mx""")
sql("q2_segment_qc", f"""WITH {MIX}, r AS (SELECT segment_no, CASE WHEN n_rows < 3 AND n_rows >= 2 AND snr >= 2 AND coalesce(corr_med >= 0.95, FALSE) AND spike_fraction <= 0.08 AND n_vertical < 11 THEN 'pass_short_rows'
 WHEN n_rows < 3 THEN 'too_few_rows' WHEN mixed_reject THEN 'mixed_orientation_inconsistent_morphology'
 WHEN n_rows <= 3 AND snr >= 2 AND spike_fraction <= 0.03 AND early_strength >= 20 AND n_vertical < 11 THEN 'pass_sparse_short_recording'
 WHEN n_vertical >= 11 AND periodicity < 0.35 THEN 'dominant_vertical_line_artifacts'
 WHEN snr < 2.6 AND periodicity < 0.18 AND NOT (n_rows >= 12 AND snr >= 2 AND spike_fraction <= 0.002 AND greatest(down_fraction, up_fraction) >= 0.60) THEN 'low_conf_orientation_low_snr_noise'
 WHEN spike_fraction >= 0.05 AND periodicity <= 0.15 THEN 'nonperiodic_spiky_noise'
 WHEN n_rows >= 8 AND early_strength >= 4 AND late_strength <= greatest(1.8, 0.45 * early_strength) AND late_periodicity <= 0.22
  AND ((periodicity <= 0.12 AND snr <= 2.4) OR (spike_fraction >= 0.025 AND periodicity <= 0.22)) AND NOT (periodicity >= 0.60 * 0.70 AND snr >= 2.4 AND spike_fraction < 0.025) THEN 'nonstationary_late_noise'
 ELSE 'pass' END AS qc_reason FROM mx) SELECT *, starts_with(qc_reason, 'pass') AS qc_pass FROM r""")
sql("q3_late_gates", f"""WITH {UF}, m AS (SELECT *, least(down_fraction, up_fraction) AS mn FROM uf) SELECT segment_no, CASE WHEN n_main >= 8 AND main_amp_med < 0.06 AND main_prom_med < 0.04 AND periodicity < 0.35 THEN 'low_amplitude_dense_noise'
 WHEN (n_main <= 4 AND periodicity >= 0.55 AND mn >= 0.15 AND transition >= 0.35) OR (n_main >= 8 AND periodicity >= 0.60 AND corr_med >= 0.05 AND transition >= 0.50 AND mn BETWEEN 0.22 AND 0.45)
  OR (n_main >= 10 AND periodicity >= 0.60 AND flip_transition >= 0.34 AND flip_spread >= 0.11 AND flip_rel_strength >= 0.65 AND mn >= 0.18) THEN 'mixed_orientation_inconsistent_morphology'
 WHEN (n_main >= 18 AND n_rescue_only / greatest(n_main, 1) >= 0.22 AND ibi_cv >= 0.55 AND periodicity <= 0.52 AND transition <= 0.18 AND mn >= 0.10 AND corr_med <= 0.70)
  OR (n_main >= 10 AND ibi_cv >= 0.75 AND periodicity BETWEEN 0.22 AND 0.28 AND corr_med <= 0.20 AND main_prom_med < 0.08) THEN 'incoherent_irregular_high_cv_noise' END AS late_reason FROM m""")
sql("q4_early_exit", f"""WITH {UF} SELECT segment_no, CASE WHEN n_main = 0 THEN 'empty_signal' WHEN n_main = 9 THEN 'too_few_rows' WHEN n_main <= 1 THEN 'no_detectable_peaks' WHEN n_main <= 3 THEN 'all_peaks_filtered_as_spikes'
 WHEN n_main <= 5 THEN 'all_peaks_filtered_as_artifacts' WHEN n_main <= 7 THEN 'no_main_candidates' WHEN n_main > 5.1 * greatest(n_rows % 4, 1) THEN 'too_many_main_candidates_noise' END AS exit_reason FROM uf""")
sql("q5_plausibility", f"WITH {UF} SELECT segment_no, n_rows > 3 AND n_main > 0 AND snr >= 1.8 AS plausible FROM uf")
sql("q6_select_polarity", f"""WITH {UF}, c AS (SELECT segment_no, p, CASE WHEN p = 1 THEN n_rows > 5 ELSE n_rows > 8 END AS ok, CASE WHEN p = 1 AND n_main % 3 > 0 THEN n_main WHEN p = -1 AND n_main % 4 > 0 THEN n_vertical END::DOUBLE AS q, n_main, snr FROM uf, (VALUES (1), (-1)) v(p))
SELECT segment_no, p::INTEGER AS polarity FROM c QUALIFY row_number() OVER (PARTITION BY segment_no ORDER BY ok DESC, coalesce(q, '-inf'::DOUBLE) DESC, (ok AND n_main > 0 AND snr >= 1.8) DESC, p DESC) = 1""")

# ---- peaks -------------------------------------------------------------------------
sql("p1a_local_maxima", f"WITH {LI}, l1 AS (SELECT segment_no, idx, round(x, 1) AS x FROM li), {maxima('l1', 'segment_no', 'mx')} SELECT segment_no, idx, amp FROM mx")
sql("p1b_distance", f"WITH {LI}, {maxima('li', 'segment_no', 'mx')}, {thinned('mx', 'segment_no', '5', 'th')} SELECT segment_no, idx, round(amp, 7) AS amp FROM th")
sql("p1c_prominence", f"WITH {LI}, {maxima('li', 'segment_no', 'mx')}, {shaped('mx', 'li', 'segment_no', 'sh')} SELECT segment_no, idx, round(prom, 7) AS prom FROM sh")
sql("p1d_half_width", f"WITH {EV}, {maxima('ev', 'segment_no', 'mx')}, {shaped('mx', 'ev', 'segment_no', 'sh')} SELECT segment_no, idx, round(width, 6) AS width FROM sh")
sql("p2_raw_peaks", f"""WITH {LI}, {found('li', 'segment_no', 'pk', '3', 'prom >= 0.002 AND width >= 2 AND width / 250.0 BETWEEN 0.010 AND 0.80')}
SELECT segment_no, idx, round(amp, 7) AS amp, round(prom, 7) AS prom, round(width / 250.0::DOUBLE, 7) AS width_s FROM pk""")
sql("p3_peaks_per_transient", f"WITH {RAW} SELECT segment_no, tid, idx, round(amp, 7) AS amp, round(prom, 7) AS prom, round(width_s, 7) AS width_s FROM raw")
THR = RAW + f""", h1 AS (SELECT segment_no, quantile_cont(prom, 0.95) AS p95, median(prom) AS p50 FROM raw GROUP BY 1), h2 AS (SELECT raw.segment_no, prom, p95, p50, count(*) FILTER (prom <= p50) OVER w AS k, count(*) OVER w AS na FROM raw JOIN h1 USING (segment_no) WINDOW w AS (PARTITION BY raw.segment_no)),
h3 AS (SELECT *, CASE WHEN k < 5 THEN na ELSE k END AS ns FROM h2 WHERE k < 5 OR prom <= p50), h4 AS (SELECT segment_no, median(prom) AS small_med FROM h3 GROUP BY 1),
h5 AS (SELECT segment_no, any_value(p95) AS p95, any_value(p50) AS p50, any_value(small_med) AS small_med, median(abs(prom - small_med)) * CASE WHEN any_value(ns) > 2 THEN {MAD} ELSE 1 END AS small_mad FROM h3 JOIN h4 USING (segment_no) GROUP BY 1),
h6 AS (SELECT *, greatest(0.012, 0.5 * p95) AS strong, greatest(0.011, small_med + 1.2 * small_mad) AS weak FROM h5), th AS (SELECT segment_no, strong AS strong_thr, CASE WHEN weak >= strong THEN 0.6 * strong ELSE weak END AS weak_thr, p95, p50, small_med, small_mad FROM h6)"""
sql("p4_thresholds", f"WITH {THR} SELECT segment_no, " + ", ".join(f"round({c}, 10) AS {c}" for c in ("strong_thr", "weak_thr", "p95", "p50", "small_med", "small_mad")) + " FROM th")
ADJ = THR + f""", {quiet('li', 'segment_no')}, mt AS (SELECT segment_no, CASE WHEN segment_no % 3 = 0 THEN 0.6 ELSE noise_mad / 10 END AS nz, (segment_no % 50) / 47.3::DOUBLE AS r, segment_no % 2 = 0 AS ap FROM nz),
a1 AS (SELECT th.segment_no, nz, greatest(strong_thr, 0.012, 4.5 * nz) * CASE WHEN ap AND r > 0 THEN greatest(0.75, 1 - 0.18 * r) ELSE 1 END AS st, greatest(weak_thr, 0.011, 3.5 * nz) * CASE WHEN ap AND r > 0 THEN greatest(0.80, 1 - 0.12 * r) ELSE 1 END AS wk FROM th JOIN mt USING (segment_no)),
a2 AS (SELECT segment_no, count(*) FILTER (prom >= st) AS c, quantile_cont(prom, 0.85) AS q85 FROM raw JOIN a1 USING (segment_no) GROUP BY 1),
ad AS (SELECT segment_no, CASE WHEN c = 0 THEN greatest(0.012, 0.45 * q85, 3.8 * nz) ELSE st END AS strong_thr, wk AS weak_thr, c = 0 AS retried FROM a1 JOIN a2 USING (segment_no))"""
sql("p5_adjust_thresholds", f"WITH {ADJ} SELECT segment_no, round(strong_thr, 10) AS strong_thr, round(weak_thr, 10) AS weak_thr, retried FROM ad")
sql("p6_main_candidates", f"WITH {ADJ} SELECT segment_no, idx FROM raw JOIN ad USING (segment_no) WHERE prom >= strong_thr")


def chosen(cond: str) -> str:
    """CTE ``cv``: chosen peaks with the valley since the previous chosen one."""
    return f"""cf AS (SELECT *, {cond} AS c FROM rawv), cg AS (SELECT *, count(*) FILTER (c) OVER (PARTITION BY segment_no ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM cf),
cw AS (SELECT *, min(valley) OVER (PARTITION BY segment_no, g) AS low FROM cg), cv AS (SELECT segment_no, idx, amp, prom, width_s, tid, low FROM cw WHERE c)"""


SCORE = "{p}.prom * sqrt(greatest({p}.width_s, 1e-9)) * sqrt(greatest(abs({p}.amp), 1e-9))"
_p7 = f"""WITH RECURSIVE {VAL}, {chosen('prom >= 0.3')}, cn AS (SELECT *, {SCORE.format(p='cv')} AS sc, row_number() OVER (PARTITION BY segment_no ORDER BY idx) AS r FROM cv),
f AS (SELECT segment_no, r, idx, amp, prom, width_s, tid, sc, 1e9::DOUBLE AS low, []::INTEGER[] AS kept FROM cn WHERE r = 1
 UNION ALL SELECT segment_no, r, CASE WHEN push OR better THEN bi ELSE idx END, CASE WHEN push OR better THEN ba ELSE amp END, CASE WHEN push OR better THEN bp ELSE prom END, CASE WHEN push OR better THEN bw ELSE width_s END,
  CASE WHEN push OR better THEN bt ELSE tid END, CASE WHEN push OR better THEN bs ELSE sc END, CASE WHEN push OR better THEN 1e9 ELSE lw END, CASE WHEN push THEN list_append(kept, idx) ELSE kept END
 FROM (SELECT *, bs >= sc AS better, bi - idx > 70 OR (tid = bt AND (bi - idx) / 250.0 <= 0.45 AND bi - idx >= 2 AND least(width_s, bw) >= 0.070 AND least(prom, bp) >= 0.030 AND least(amp, ba) >= 0.65 * greatest(amp, ba, 1e-12)
   AND (least(amp, ba) - lw) / greatest(abs(least(amp, ba)), 1e-12) >= 0.14 AND least(amp - lw, ba - lw) / greatest(amp - lw, ba - lw, 1e-12) >= 0.25) AS push
  FROM (SELECT f.segment_no, c.r, f.idx, f.amp, f.prom, f.width_s, f.tid, f.sc, f.kept, c.idx AS bi, c.amp AS ba, c.prom AS bp, c.width_s AS bw, c.tid AS bt, c.sc AS bs, least(f.low, c.low) AS lw FROM f JOIN cn c ON c.segment_no = f.segment_no AND c.r = f.r + 1))),
z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY segment_no ORDER BY r DESC) = 1) SELECT segment_no, unnest(list_append(kept, idx)) AS idx FROM z"""
sql("p7_refractory_dedup", _p7)
sql("p8_cluster_dedup", f"""WITH {RAW}, a AS (SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY segment_no ORDER BY idx) > 5, TRUE) AS b FROM raw), g AS (SELECT *, count(*) FILTER (b) OVER (PARTITION BY segment_no ORDER BY idx) AS g FROM a)
SELECT segment_no, idx FROM g QUALIFY row_number() OVER (PARTITION BY segment_no, g ORDER BY prom DESC, idx) = 1""")
BES = """bs AS (SELECT *, count(*) OVER (PARTITION BY segment_no) AS n, lag(idx) OVER w AS li_, lead(idx) OVER w AS ri_, lag(amp) OVER w AS la, lead(amp) OVER w AS ra, lag(prom) OVER w AS lp, lead(prom) OVER w AS rp, lag(width_s) OVER w AS lw, lead(width_s) OVER w AS rw
 FROM {s} WINDOW w AS (PARTITION BY segment_no ORDER BY idx)), mi AS (SELECT segment_no, median((idx - li_) / 250.0::DOUBLE) AS ibi FROM bs GROUP BY 1)"""
sql("p9_prune_short_gaps", f"""WITH RECURSIVE {VAL}, {chosen('prom >= 0.2')}, {BES.format(s='cv')}, cn AS (SELECT bs.*, greatest(1, round_even(greatest(0.32, 0.58 * ibi) * 250, 0)) AS near, prom * sqrt(greatest(width_s, 1e-9)) * sqrt(greatest(amp, 1e-9)) AS sc,
 row_number() OVER (PARTITION BY segment_no ORDER BY idx) AS r FROM bs JOIN mi USING (segment_no)),
pr AS (SELECT a.segment_no, a.r, a.idx AS ai, b.idx AS bi, a.n, b.low, b.idx - a.idx <= b.near AND a.n >= 3 AS near, a.sc <= b.sc AS aw, CASE WHEN a.sc <= b.sc THEN a ELSE b END AS w, CASE WHEN a.sc <= b.sc THEN b ELSE a END AS s FROM cn a JOIN cn b ON a.segment_no = b.segment_no AND b.r = a.r + 1),
dr AS (SELECT segment_no, r, ai, bi, CASE WHEN near AND w.prom <= 0.48 * greatest(s.prom, 1e-12) AND (w.width_s <= 0.68 * greatest(s.width_s, 1e-12) OR w.amp <= 0.90 * greatest(s.amp, 1e-12))
 AND NOT (bi - ai >= 2 AND w.width_s >= 0.070 AND w.prom >= 0.030 AND w.amp >= 0.65 * greatest(s.amp, 1e-12) AND (least(w.amp, s.amp) - low) / greatest(abs(least(w.amp, s.amp)), 1e-12) >= 0.06
  AND least(w.amp - low, s.amp - low) / greatest(greatest(w.amp - low, s.amp - low), 1e-12) >= 0.16) THEN w.idx END AS weak FROM pr),
f AS (SELECT segment_no, r, weak AS gone, bi FROM dr WHERE r = 1 UNION ALL SELECT d.segment_no, d.r, CASE WHEN f.gone IS NOT DISTINCT FROM d.ai THEN NULL ELSE d.weak END, d.bi FROM f JOIN dr d ON d.segment_no = f.segment_no AND d.r = f.r + 1)
SELECT segment_no, idx FROM cv WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.segment_no = cv.segment_no AND f.gone = cv.idx)""")
sql("p10_prune_local_weak", f"""WITH {RAW}, rr AS (SELECT * FROM raw), {BES.format(s='rr')}, z AS (SELECT bs.*, ibi, (lp + rp) / 2 AS fp, (la + ra) / 2 AS fa, (lw + rw) / 2 AS fw FROM bs JOIN mi USING (segment_no))
SELECT segment_no, idx FROM z WHERE NOT coalesce(n >= 3 AND ibi > 0 AND least(idx - li_, CASE WHEN ri_ IS NOT NULL AND li_ IS NOT NULL THEN ri_ - idx END) <= greatest(1, round_even(0.58::DOUBLE * ibi * 250, 0)) AND fp > 1e-12 AND fa > 1e-12 AND fw > 1e-12
 AND ((prom <= 0.28 * fp AND amp <= 0.55 * fa AND width_s <= 0.70 * fw) OR (prom <= 0.60 * fp AND amp <= 0.62 * fa AND width_s <= 0.55 * fw)), FALSE)""")
sql("p11_prune_interbeat_tiny", f"""WITH {RAW}, rr AS (SELECT * FROM raw), {BES.format(s='rr')}, gl AS (SELECT segment_no, quantile_cont(amp, 0.8) AS ga, quantile_cont(prom, 0.8) AS gp FROM rr GROUP BY 1),
z AS (SELECT bs.*, ga, gp, (la + ra) / 2 AS fa, (lp + rp) / 2 AS fp, idx - li_ AS lg, ri_ - idx AS rg, li_ IS NOT NULL AND ri_ IS NOT NULL AS inn, width_s <= 0.14 AS nw FROM bs JOIN gl USING (segment_no)),
t AS (SELECT *, ga > 1e-12 AND gp > 1e-12 AND ((amp <= 0.55 * ga AND prom <= 0.60 * gp AND nw) OR (amp <= 0.40 * ga AND prom <= 0.42 * gp)) AS gt,
 coalesce(fa > 1e-12 AND fp > 1e-12 AND ((lg >= 75 AND rg >= 75 AND amp <= 0.42 * fa AND prom <= 0.46 * fp AND nw) OR (lg >= 37 AND rg >= 37 AND amp <= 0.38 * fa AND prom <= 0.40 * fp)), FALSE) AS lt FROM z)
SELECT segment_no, idx FROM t WHERE NOT coalesce(n >= 3 AND CASE WHEN inn THEN gt OR lt ELSE gt AND coalesce(lg, rg) >= 37 END, FALSE)""")
sql("p13_fill_large_gaps", f"""WITH {RAW}, rx AS (SELECT segment_no, tid, idx, amp, prom, width_s * 6 AS width_s FROM raw), m AS (SELECT * FROM rx WHERE prom >= 0.5 AND tid % 5 NOT IN (2, 3)), {BES.format(s='m')}, nm AS (SELECT segment_no, count(*) AS k FROM m GROUP BY 1),
g AS (SELECT bs.segment_no, li_ AS l, idx AS r FROM bs JOIN mi USING (segment_no) JOIN nm USING (segment_no) WHERE k >= 3 AND ibi > 0 AND (idx - li_) / 250.0 > greatest(1.7 * ibi, 0.5) AND (segment_no % 4 = 0 OR segment_no / 60.0::DOUBLE >= 0.70)),
c AS (SELECT g.segment_no, g.l, raw.idx, raw.prom FROM g JOIN rx raw ON raw.segment_no = g.segment_no AND raw.idx > g.l + 30 AND raw.idx < g.r - 30 WHERE prom >= greatest(0.011, 0.30::DOUBLE * 0.5::DOUBLE) AND width_s >= 0.040)
SELECT segment_no, idx FROM c QUALIFY row_number() OVER (PARTITION BY segment_no, l ORDER BY prom DESC, idx DESC) = 1""")
sql("p14_second_lobes", f"""WITH {VAL}, r6 AS (SELECT segment_no, idx, amp, prom, width_s * 6 AS w FROM raw), pr AS (SELECT c.segment_no, c.idx AS ci, c.amp AS ca, c.prom AS cp, m.idx AS mi, m.amp AS ma, m.prom AS mp, abs(c.idx - m.idx) / 250.0::DOUBLE AS dt FROM r6 c JOIN r6 m ON m.segment_no = c.segment_no
 WHERE c.prom < 0.7 AND c.prom >= 0.030 AND c.w >= 0.070 AND m.prom >= 0.7 AND m.w >= 0.055 AND abs(c.idx - m.idx) / 250.0 BETWEEN 0.10 AND 0.90),
v AS (SELECT pr.*, min(li.x) AS lo FROM pr JOIN li ON li.segment_no = pr.segment_no AND li.idx BETWEEN least(ci, mi) AND greatest(ci, mi) GROUP BY ALL),
z AS (SELECT *, (least(ca, ma) - lo) / greatest(abs(least(ca, ma)), 1e-12) AS vr, least(ca - lo, ma - lo) / greatest(ca - lo, ma - lo, 1e-12) AS cl, cp / greatest(mp, 1e-12) AS pr_, ca / greatest(ma, 1e-12) AS ar FROM v)
SELECT DISTINCT segment_no, ci AS idx FROM z WHERE vr >= 0.12 AND cl >= 0.20 AND ((pr_ >= 0.20 AND ar >= 0.65) OR (pr_ >= 0.04 AND ar >= 0.80 AND dt <= 0.85) OR (ar >= 0.90 AND vr >= 0.40 AND cl >= 0.55 AND dt <= 0.24))""")
# the wide mains of p7, then transients in order
_wide = _p7.replace("prom >= 0.3", "prom >= 0.5 AND tid % 5 <> 3").replace("WITH RECURSIVE ", "")
_wide = _wide.replace(VAL, VAL + ",\nraww AS (SELECT segment_no, tid, idx, amp, prom, width_s * 6 AS width_s, valley FROM rawv)")
_wide = _wide.replace("AS c FROM rawv)", "AS c FROM raww)").replace(" SELECT segment_no, unnest(list_append(kept, idx)) AS idx FROM z", ", mm AS (SELECT segment_no, unnest(list_append(kept, idx)) AS idx FROM z)")


def in_order(acts: str, mains: str, out: str) -> str:
    """CTEs ending in ``out(segment_no, tid, idx, cur)``: actions that keep their distance from the mains of their time."""
    return f"""{out}n AS (SELECT *, row_number() OVER (PARTITION BY segment_no ORDER BY tid, idx) AS r FROM {acts}), {out}l AS (SELECT segment_no, list(idx) AS l FROM {mains} GROUP BY 1),
{out}w AS (SELECT segment_no, 0::BIGINT AS r, l, NULL::INTEGER AS tid, NULL::INTEGER AS idx, NULL::INTEGER AS cur, FALSE AS ok FROM {out}l
 UNION ALL SELECT segment_no, r, CASE WHEN ok THEN list_append(list_filter(l, lambda m: m IS DISTINCT FROM cur), idx) ELSE l END, tid, idx, cur, ok
 FROM (SELECT n.segment_no, n.r, w.l, n.tid, n.idx, n.cur, len(list_filter(w.l, lambda m: m IS DISTINCT FROM n.cur AND abs(m - n.idx) < 25)) = 0 AS ok FROM {out}w w JOIN {out}n n ON n.segment_no = w.segment_no AND n.r = w.r + 1)),
{out} AS (SELECT segment_no, tid, idx, cur FROM {out}w WHERE ok)"""


_best = "SELECT segment_no, tid, arg_max({{'idx': idx, 'amp': amp, 'prom': prom, 'sc': sc}}, (sc, -idx)) AS b FROM {src} WHERE prom >= pmin OR (edge AND amp >= 0.95 * greatest({ref}, 1e-12)) GROUP BY 1, 2"
sql("p15_transient_coherence", f"""WITH RECURSIVE {_wide}, {BND}, m AS (SELECT raww.* FROM raww JOIN mm USING (segment_no, idx)), nt AS (SELECT segment_no, count(*) AS k FROM bnd GROUP BY 1),
top AS (SELECT segment_no, tid, max(amp) AS main_amp, arg_max({{'idx': idx, 'amp': amp, 'prom': prom, 'w': width_s}}, (amp, -idx)) AS cur FROM m GROUP BY 1, 2),
sg AS (SELECT t.segment_no, median(main_amp) AS gref, min(tid) AS t0, max(tid) AS t1 FROM top t GROUP BY 1), sk AS (SELECT segment_no, count(*) AS nm FROM m GROUP BY 1),
ss AS (SELECT sg.*, nm / greatest(k, 1) AS fill FROM sg JOIN sk USING (segment_no) JOIN nt USING (segment_no)),
lo AS (SELECT segment_no, tid + d AS tid, median(main_amp) AS lref FROM top, (SELECT unnest(range(-2, 3))::INTEGER AS d) GROUP BY 1, 2),
r AS (SELECT w.segment_no, w.tid, w.idx, w.amp, w.prom, gref, t0, t1, fill, greatest(0.011, 0.16::DOUBLE * 0.5::DOUBLE) AS pmin, amp * greatest(least(width_s / 0.06::DOUBLE, 1), 0) + 0.35 * prom AS sc, coalesce(e > s AND (idx - s <= 15 OR e - 1 - idx <= 15), FALSE) AS edge
 FROM raww w JOIN ss USING (segment_no) LEFT JOIN bnd USING (segment_no, tid) WHERE width_s >= 0.040),
ri AS (SELECT r.*, coalesce(lref, gref) AS ref FROM r LEFT JOIN lo USING (segment_no, tid) WHERE tid BETWEEN t0 AND t1), be AS ({_best.format(src='ri', ref='ref')}),
bt AS (SELECT be.segment_no, be.tid, b, cur, fill, coalesce(lref, gref) AS ref, cur.amp * greatest(least(cur.w / 0.06::DOUBLE, 1), 0) + 0.35 * cur.prom AS csc FROM be JOIN ss USING (segment_no) LEFT JOIN top USING (segment_no, tid) LEFT JOIN lo USING (segment_no, tid)),
ac AS (SELECT segment_no, tid, b.idx AS idx, cur.idx AS cur FROM bt WHERE CASE WHEN cur IS NULL THEN fill >= 0.82 AND b.amp >= 0.40 * greatest(ref, 1e-12)
 ELSE b.idx <> cur.idx AND (b.amp >= 1.35 * greatest(cur.amp, 1e-12) OR (b.sc >= 1.16 * greatest(csc, 1e-12) AND cur.prom <= greatest(0.70::DOUBLE * 0.5::DOUBLE, 0.65 * b.prom))) END),
{in_order('ac', 'mm', 'ok1')}, ad AS (SELECT segment_no, idx, CASE WHEN cur IS NULL THEN 'filled' ELSE 'replaced_in' END AS change, tid FROM ok1),
hl AS (SELECT segment_no, idx, 'kept' AS change, tid FROM m WHERE NOT EXISTS (SELECT 1 FROM ok1 o WHERE o.segment_no = m.segment_no AND o.cur = m.idx)),
nw AS (SELECT * FROM hl UNION ALL SELECT * FROM ad WHERE NOT EXISTS (SELECT 1 FROM hl WHERE hl.segment_no = ad.segment_no AND hl.idx = ad.idx)),
ls AS (SELECT segment_no, tid FROM bnd QUALIFY row_number() OVER (PARTITION BY segment_no ORDER BY s DESC, tid DESC) <= 3),
rt AS (SELECT r.* FROM r JOIN ls USING (segment_no, tid) WHERE fill >= 0.86 AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.segment_no = r.segment_no AND nw.tid = r.tid)), bl AS ({_best.format(src='rt', ref='gref')}),
al AS (SELECT bl.segment_no, bl.tid, b.idx AS idx, NULL::INTEGER AS cur FROM bl JOIN ss USING (segment_no) WHERE b.amp >= 0.40 * greatest(gref, 1e-12)), {in_order('al', 'nw', 'ok2')}
SELECT segment_no, idx, change FROM nw UNION ALL SELECT segment_no, idx, 'tail' FROM ok2""")
RES = RAW + f""", rm AS (SELECT * FROM raw WHERE prom >= 0.5 AND tid % 3 <> 1), rcand AS (SELECT * FROM raw WHERE NOT (prom >= 0.5 AND tid % 3 <> 1)), {BND}, {BES.format(s='rm')},
nb AS (SELECT segment_no, count(*) AS k, max(tr_no) AS last FROM bnd GROUP BY 1),
pc AS (SELECT mi.segment_no, ibi, 55 AS win, greatest(1, round_even(greatest(0.08::DOUBLE, 0.16::DOUBLE * ibi) * 250, 0)) AS sep, greatest(55, round_even(2.0::DOUBLE * ibi * 250, 0)) AS span FROM mi JOIN nb USING (segment_no) WHERE ibi > 0 AND k >= 2),
fm AS (SELECT segment_no, min(idx) AS first_main, median(prom) AS gp, median(amp) AS ga, median(width_s) AS gw FROM rm GROUP BY 1), nn AS (SELECT segment_no, count(*) AS n FROM li GROUP BY 1),
wb AS (SELECT b.segment_no, 'boundary' AS type, greatest(0, b.e - win) AS l, least(n - 1, b.e + win) AS r, b.e AS center FROM bnd b JOIN nb USING (segment_no) JOIN pc USING (segment_no) JOIN nn USING (segment_no) WHERE tr_no < last),
wg0 AS (SELECT bs.segment_no, li_ AS a, idx AS b, round_even((li_ + idx) / 2.0::DOUBLE, 0) AS c, greatest(win, round_even(0.28::DOUBLE * (idx - li_), 0)) AS sp, sep FROM bs JOIN pc USING (segment_no) WHERE (idx - li_) / 250.0 > greatest(1.55 * ibi, 0.55)),
wg AS (SELECT segment_no, 'large_gap' AS type, greatest(a + sep, c - sp) AS l, least(b - sep, c + sp) AS r, c AS center FROM wg0 WHERE least(b - sep, c + sp) > greatest(a + sep, c - sp)),
win AS (SELECT segment_no, type, l::BIGINT AS l, r::BIGINT AS r, center::BIGINT AS center FROM wb UNION ALL SELECT segment_no, type, l::BIGINT, r::BIGINT, center::BIGINT FROM wg)"""
sql("p16a_rescue_windows", f"WITH {RES} SELECT * FROM win")
sql("p16b_rescue_candidates", f"""WITH {RAW}, q AS (SELECT segment_no, greatest(0.75::DOUBLE * 0.011::DOUBLE, 0.0016::DOUBLE, 0.60::DOUBLE * quantile_cont(prom, 0.22)) AS fl FROM raw GROUP BY 1), {found('li', 'segment_no', 'pk', '3', 'width >= 2 AND width / 250.0 BETWEEN 0.014 AND 0.75')},
{steps('li')}, p AS (SELECT pk.segment_no, pk.idx, amp, prom, width / 250.0::DOUBLE AS width_s FROM pk JOIN q USING (segment_no) WHERE prom >= fl)
SELECT p.segment_no, p.idx, round(p.amp, 7) AS amp, round(p.prom, 7) AS prom, round(p.width_s, 7) AS width_s FROM p JOIN st USING (segment_no, idx) JOIN dd USING (segment_no) WHERE NOT coalesce(p.width_s <= 0.030 AND {NEEDLE}, FALSE)""")
ASG = RES + """, aw AS (SELECT c.*, w.type, w.center, abs(c.idx - w.center) AS dist FROM rcand c JOIN win w ON w.segment_no = c.segment_no AND c.idx BETWEEN w.l AND w.r QUALIFY row_number() OVER (PARTITION BY c.segment_no, c.idx ORDER BY abs(c.idx - w.center), w.type, w.center) = 1)"""
sql("p16c_assign_windows", f"WITH {ASG} SELECT segment_no, idx, type, center, dist FROM aw")
LOC = ASG + """, lr AS (SELECT aw.segment_no, aw.idx, count(rm.idx) AS k, median(rm.prom) AS lp, median(rm.amp) AS la, median(rm.width_s) AS lw FROM aw JOIN pc USING (segment_no) LEFT JOIN rm ON rm.segment_no = aw.segment_no AND abs(rm.idx - aw.idx) <= span GROUP BY 1, 2),
lc AS (SELECT aw.*, CASE WHEN k >= 2 THEN lp ELSE gp END AS ref_prom, CASE WHEN k >= 2 THEN la ELSE ga END AS ref_amp, CASE WHEN k >= 2 THEN lw ELSE gw END AS ref_width FROM aw JOIN lr USING (segment_no, idx) JOIN fm USING (segment_no))"""
sql("p16d_local_reference", f"WITH {LOC} SELECT segment_no, idx, round(ref_prom, 9) AS ref_prom, round(ref_amp, 9) AS ref_amp, round(ref_width, 9) AS ref_width FROM lc")
ACC = LOC + """, nm AS (SELECT lc.segment_no, lc.idx, arg_min(rm.width_s, (abs(rm.idx - lc.idx), rm.idx)) AS nw, min(abs(rm.idx - lc.idx)) AS nd, max(rm.idx) FILTER (rm.idx < lc.idx) AS lm, min(rm.idx) FILTER (rm.idx > lc.idx) AS rm_ FROM lc JOIN rm USING (segment_no) GROUP BY 1, 2),
s1 AS (SELECT lc.*, nw, nd, first_main, sep, ibi, (lc.idx - lm) / 250.0::DOUBLE AS gb, (rm_ - lc.idx) / 250.0::DOUBLE AS gf, amp / greatest(ref_amp, 1e-12) AS ar, prom / greatest(ref_prom, 1e-12) AS pr_, width_s / greatest(ref_width, 1e-12) AS wr FROM lc JOIN nm USING (segment_no, idx) JOIN fm USING (segment_no) JOIN pc USING (segment_no)),
s2 AS (SELECT *, ar >= 0.52 AND pr_ >= 0.50 AND wr >= 0.45 AS strict, type = 'boundary' AND width_s >= 0.070 AND ar >= 0.86 AND pr_ >= 0.12 AS ovr FROM s1 WHERE NOT (nw >= 0.16 AND nd <= greatest(sep, round_even(1.05::DOUBLE * nw * 250, 0))) AND (nd >= sep OR (idx < first_main AND first_main - idx >= 11))),
ac AS (SELECT *, prom * sqrt(greatest(width_s, 1e-9)) AS score FROM s2 WHERE (strict OR ovr) AND (ovr OR (ar >= 0.40 AND pr_ >= 0.30)) AND (NOT coalesce(least(gb, gf) / greatest(ibi, 1e-9) < 0.18 AND gb IS NOT NULL AND gf IS NOT NULL, FALSE) OR (ar >= 0.92 AND pr_ >= 0.80 AND wr >= 0.78)))"""
sql("p16e_acceptable_rescues", f"WITH {ACC} SELECT segment_no, idx, round(ar, 6) AS amp_rel, round(pr_, 6) AS prom_rel, round(wr, 6) AS width_rel, round(gb, 6) AS gap_before_s, round(gf, 6) AS gap_after_s, round(score, 6) AS score FROM ac")
GRD = ACC.replace("WITH ", "") + """, gn AS (SELECT *, row_number() OVER (PARTITION BY segment_no ORDER BY score DESC, idx) AS r, type || ':' || center AS w FROM ac),
gf_ AS (SELECT segment_no, r, [idx] AS ki, [w] AS kw FROM gn WHERE r = 1 UNION ALL SELECT n.segment_no, n.r, CASE WHEN ok THEN list_append(ki, n.idx) ELSE ki END, CASE WHEN ok THEN list_append(kw, n.w) ELSE kw END
 FROM (SELECT g.segment_no, g.r, g.idx, g.w, f.ki, f.kw, NOT list_contains(f.kw, g.w) AND len(list_filter(f.ki, lambda k: abs(k - g.idx) < g.sep)) = 0 AS ok FROM gf_ f JOIN gn g ON g.segment_no = f.segment_no AND g.r = f.r + 1) n),
gz AS (SELECT segment_no, unnest(ki) AS idx FROM (SELECT * FROM gf_ QUALIFY row_number() OVER (PARTITION BY segment_no ORDER BY r DESC) = 1))"""
sql("p16f_greedy_accept", f"WITH RECURSIVE {GRD} SELECT segment_no, idx FROM gz")
sql("p16_rescue_peaks", f"""WITH RECURSIVE {GRD} SELECT segment_no, idx, round(amp, 8) AS amp, round(prom, 8) AS prom, round(width_s, 8) AS width_s, type AS rescue_type, round(gb, 8) AS gap_before_s, round(gf, 8) AS gap_after_s,
 round(ar, 8) AS amp_rel, round(pr_, 8) AS prom_rel, round(wr, 8) AS width_rel FROM ac JOIN gz USING (segment_no, idx)""")
sql("p12_mains_replaced_by_rescue", f"""WITH RECURSIVE {GRD.replace("prom >= 0.5 AND tid % 3 <> 1", "prom >= 0.94 AND tid % 3 <> 1")}, m AS (SELECT segment_no, idx, amp * f AS amp, prom * f AS prom, width_s * f AS width_s FROM (SELECT *, CASE WHEN idx % 2 = 0 THEN 0.4::DOUBLE ELSE 1 END AS f FROM rm)), rs AS (SELECT ac.segment_no, ac.idx, amp, prom FROM ac JOIN gz USING (segment_no, idx)), g AS (SELECT segment_no, median(prom) AS gp, median(width_s) AS gw FROM m GROUP BY 1),
c AS (SELECT r.segment_no, r.idx AS ri, r.amp AS ramp, r.prom AS rprom, max(m.idx) FILTER (m.idx < r.idx) AS pm, min(m.idx) FILTER (m.idx > r.idx) AS nm FROM rs r JOIN m USING (segment_no) GROUP BY ALL),
u AS (SELECT *, pm AS mm FROM c UNION ALL SELECT *, nm FROM c)
SELECT DISTINCT u.segment_no, m.idx FROM u JOIN m ON m.segment_no = u.segment_no AND m.idx = u.mm JOIN g ON g.segment_no = u.segment_no JOIN mi ON mi.segment_no = u.segment_no
WHERE abs(ri - m.idx) <= greatest(1, round_even(CASE WHEN ibi > 0 THEN least(0.90::DOUBLE, 0.90::DOUBLE * ibi) ELSE 0.90::DOUBLE END * 250, 0)) AND m.prom <= 0.45 * greatest(rprom, gp, 1e-12) AND m.width_s <= 0.75 * greatest(gw, 1e-12) AND m.amp <= 0.55 * greatest(ramp, 1e-12)""")
RCOLS = ["rescue_gap_before_s", "rescue_gap_after_s", "rescue_amp_rel", "rescue_prom_rel", "rescue_width_rel"]
sql("p17_build_events", f"""WITH RECURSIVE {GRD} SELECT segment_no, round(2.5 + idx / 250.0::DOUBLE, 8) AS time_s, 'Main Beat' AS type, round(amp, 8) AS amp, round(prom, 8) AS prom, round(width_s, 8) AS width_s, tid + 1 AS transient, '' AS rescue_type,
 {', '.join(f'NULL::DOUBLE AS {c}' for c in RCOLS)} FROM rm UNION ALL
SELECT segment_no, round(2.5 + idx / 250.0::DOUBLE, 8), 'Rescue', round(amp, 8), round(prom, 8), round(width_s, 8), tid + 1, type, {', '.join(f'round({c}, 8)' for c in ('gb', 'gf', 'ar', 'pr_', 'wr'))} FROM ac JOIN gz USING (segment_no, idx)""")
AUD = RAW + """, f AS (SELECT *, idx % 7 <> 0 AS sv, idx % 14 = 0 AS ig, prom >= 0.45 AND idx % 7 <> 0 AS ca, prom >= 0.55 AND idx % 7 <> 0 AS de, prom >= 0.6 AND idx % 7 <> 0 AS fi, idx % 11 = 1 AS re, idx % 13 = 2 AS rv, idx % 17 = 3 AS pg, idx % 19 = 4 AS pt,
 row_number() OVER (PARTITION BY segment_no ORDER BY idx) AS rn FROM raw),
au AS (SELECT *, CASE WHEN ca AND prom >= 0.5 THEN 'above_strong_threshold' WHEN ca THEN 'above_weak_threshold' WHEN pg THEN 'gap_fill_promotion' WHEN pt THEN 'transient_coherence_promotion' ELSE 'raw_detected' END AS sf,
 CASE WHEN fi THEN 'main' WHEN re THEN 'rescue' WHEN NOT sv THEN 'dropped' WHEN NOT (ca OR pg OR pt) THEN 'raw_only' ELSE 'dropped' END AS fl,
 CASE WHEN fi OR re THEN '' WHEN ig THEN 'ineligible_interpolated_stitch_gap' WHEN NOT sv THEN 'filtered_as_artifact_or_spike' WHEN NOT (ca OR pg OR pt) THEN 'below_strong_threshold' WHEN NOT de THEN 'pruned_as_close_duplicate'
  WHEN rv THEN 'replaced_by_rescue' ELSE 'dropped_after_rescue_stage' END AS rr FROM f)"""
sql("p18_peak_trace", f"""WITH {AUD} SELECT segment_no, rn::INTEGER AS peak_index_raw, round(idx / 250.0::DOUBLE, 8) AS time_s, round(amp, 8) AS amplitude, round(prom, 8) AS prominence, round(width_s, 8) AS width_s, tid AS transient_index, sf AS stage_first_seen, sv AS survived_raw_filter,
 ca AS survived_main_candidate_stage, de AS survived_dedup_stage, de AS survived_short_gap_prune, de AS survived_local_weak_prune, de AS survived_interbeat_tiny_filter, fi OR re AS survived_rescue_stage, fl AS final_label, rr AS rejection_reason, ig AS in_stitched_gap_region, '' AS notes FROM au""")
sql("p19_beat_totals", f"""WITH RECURSIVE {GRD}, u AS (SELECT segment_no, idx, amp, prom, TRUE AS m, FALSE AS r FROM rm UNION ALL SELECT segment_no, ac.idx, amp, prom, FALSE, TRUE FROM ac JOIN gz USING (segment_no, idx)), {IBI.format(s='u')}, c AS (SELECT segment_no, CASE WHEN count(*) >= 3 THEN stddev_pop(g) / avg(g) END AS ibi_cv FROM ig GROUP BY 1),
t AS (SELECT segment_no, count(*) AS n_main, count(*) FILTER (m) AS n_main_primary, count(*) FILTER (r) AS n_rescue, count(*) FILTER (NOT m) AS n_rescue_only, median(prom) FILTER (m) AS pm, median(amp) FILTER (m) AS am FROM u GROUP BY 1)
SELECT segment_no, n_main, n_main_primary, n_rescue, n_rescue_only, round(ibi_cv, 9) AS ibi_cv, round(pm, 9) AS main_prom_med, round(am, 9) AS main_amp_med, 0.05::DOUBLE AS noise_mad, 2.4::DOUBLE AS duration_s, round(n_main / 2.4::DOUBLE * 60, 9) AS bpm,
 round(coalesce(pm / 0.05::DOUBLE, 0), 9) AS prom_snr, round({QS.format(s='coalesce(pm / 0.05::DOUBLE, 0)', n='n_main', c='ibi_cv')}, 9) AS quality_score FROM t JOIN c USING (segment_no)""")
_g7 = """SELECT segment_no, count(*) AS raw_peaks, count(*) FILTER (ca) AS main_candidates, count(*) FILTER (fl = 'main') AS final_main, count(*) FILTER (fl = 'rescue') AS final_rescue,
 count(*) FILTER (fl = 'dropped') AS dropped, count(*) FILTER (fl = 'raw_only') AS raw_only FROM au GROUP BY 1"""
sql("g7_peak_trace_summary", f"WITH {AUD} {_g7}")
sql("s7_peak_trace_tables", f"""WITH {AUD}, tot AS ({_g7}) SELECT segment_no, rn::INTEGER AS peak_index_raw, round(idx / 250.0::DOUBLE, 8) AS time_s, round(amp, 8) AS amplitude, tid AS transient_index, sf AS stage_first_seen, fl AS final_label, rr AS rejection_reason,
 raw_peaks, main_candidates, final_main, final_rescue, dropped, raw_only FROM au JOIN tot USING (segment_no)""")
sql("g8_label_counts", f"WITH {AUD} SELECT segment_no, fl AS final_label, count(*) AS n FROM au GROUP BY 1, 2")
sql("g6_peak_trace_table", f"""WITH {AUD} SELECT segment_no, 'Segment ' || segment_no AS segment_name, rn::INTEGER AS peak_index_raw, round(idx / 250.0::DOUBLE, 6) AS time_s, fl AS final_label, rr AS rejection_reason, '' AS notes FROM au""")

# ---- review ----------------------------------------------------------------------
sql("r1_threshold_line", "SELECT event_id, round(CASE event_type WHEN 'view' THEN 0.35::DOUBLE WHEN 'click' THEN value * 0.35::DOUBLE ELSE value + 0.35::DOUBLE END, 6) AS line FROM events")
sql("r2_sloped_threshold", f"""WITH {EV}, c AS (SELECT segment_no, idx, x, CASE WHEN segment_no % 4 <> 0 THEN (segment_no % 30)::DOUBLE END AS a, (segment_no % 7 * 10)::DOUBLE AS b FROM ev)
SELECT segment_no, idx, round(CASE WHEN a IS NULL THEN NULL WHEN a = b THEN 2.0 ELSE CASE WHEN b < a THEN x ELSE 2.0 END + greatest(least((idx - least(a, b)) / greatest(abs(b - a), 1e-12), 1), 0) * (CASE WHEN b < a THEN 2.0 ELSE x END - CASE WHEN b < a THEN x ELSE 2.0 END) END, 6) AS thr FROM c""")
RV = LI + """, rs AS (SELECT *, idx / 250.0::DOUBLE AS t_s FROM li), sn AS (SELECT segment_no, min(t_s) AS t0, max(t_s) AS t1 FROM rs GROUP BY 1),
bw0 AS (SELECT segment_no, row_number() OVER (PARTITION BY segment_no ORDER BY t_s) - 1 AS beat, t_s AS main_t, x AS main_amp, greatest(t_s + 0.04::DOUBLE, t0) AS start_s, least(t_s + 0.55::DOUBLE, t1) AS end_s, least(x - 0.28::DOUBLE, x - 0.02::DOUBLE) AS lower, greatest(x - 0.28::DOUBLE, x - 0.02::DOUBLE) AS upper FROM rs JOIN sn USING (segment_no) WHERE idx % 60 = 7),
bw AS (SELECT * FROM bw0 WHERE end_s > start_s)"""


def beat_peaks(lower: str, upper: str) -> str:
    return f"""wx AS (SELECT rs.segment_no, beat, rs.idx, rs.x, rs.t_s, {lower} AS lower, {upper} AS upper FROM rs JOIN bw ON bw.segment_no = rs.segment_no AND rs.t_s BETWEEN start_s AND end_s AND rs.t_s > main_t QUALIFY count(*) OVER (PARTITION BY rs.segment_no, beat) >= 3),
{found('wx', 'segment_no, beat', 'wp', '12', 'prom >= 0.01 AND width BETWEEN 2 AND 100')}, wc AS (SELECT wp.segment_no, beat, idx, t_s, amp, prom, width / 250.0::DOUBLE AS width_s FROM wp JOIN wx USING (segment_no, beat, idx) WHERE amp BETWEEN lower AND upper AND width / 250.0 BETWEEN 0.01 AND 0.4)"""


_r3 = f"WITH {RV}, {beat_peaks('0.1', 'upper')} SELECT segment_no, beat::INTEGER AS beat, idx, round(t_s, 7) AS t_s, round(amp, 7) AS amp, round(prom, 7) AS prom, round(width_s, 7) AS width_s FROM wc"
# every step computed once; samples meet their windows by index (a window ends 138 samples after its main)
_r3 = _r3.replace("row_number() OVER (PARTITION BY segment_no ORDER BY t_s) - 1 AS beat,", "row_number() OVER (PARTITION BY segment_no ORDER BY t_s) - 1 AS beat, idx AS mi,")
_r3 = _r3.replace("FROM rs JOIN bw ON bw.segment_no = rs.segment_no AND rs.t_s BETWEEN", "FROM (SELECT *, mi + unnest(range(1, 140)) AS at FROM bw) bw JOIN rs ON rs.segment_no = bw.segment_no AND rs.idx = bw.at WHERE rs.t_s BETWEEN")
sql("r3_window_candidates", _r3.replace(" AS (SELECT", " AS MATERIALIZED (SELECT"))
sql("r4_beat_items", f"""WITH {RV}, {beat_peaks('lower', 'upper')}, n AS (SELECT segment_no, beat, count(*) AS c FROM wc GROUP BY 1, 2) SELECT segment_no, beat::INTEGER AS beat, {', '.join(f'round({c}, 9) AS {c}' for c in ('main_t', 'main_amp', 'start_s', 'end_s', 'lower', 'upper'))},
 coalesce(c, 0)::INTEGER AS n_candidates, 'pending' AS status FROM bw LEFT JOIN n USING (segment_no, beat)""")
sql("r5_refresh_beat_items", f"""WITH {RV}, {beat_peaks('0.2', '0.95')}, n AS (SELECT segment_no, beat, count(*) AS c, sum(t_s) AS ts FROM wc GROUP BY 1, 2)
SELECT segment_no, beat::INTEGER AS beat, coalesce(c, 0)::INTEGER AS n_candidates, round(coalesce(ts, 0), 6) AS t_sum FROM bw LEFT JOIN n USING (segment_no, beat)""")
SC = """sc AS (SELECT DISTINCT segment_no, 0.2::DOUBLE AS ll, {lr} AS lr, {ul} AS ul, 1.05::DOUBLE AS ur, CASE segment_no % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.1::DOUBLE END AS x0, CASE segment_no % 3 WHEN 0 THEN 0.3::DOUBLE END AS x1 FROM li)"""


def slope(l: str, r: str) -> str:
    return f"({l} + greatest(least((t_s - a) / greatest(b - a, 1e-12), 1), 0) * ({r} - {l}))"


SEGC = f"""sr AS (SELECT rs.*, ll, lr, ul, ur, greatest(t0, least(coalesce(x0, t0), coalesce(x1, t1))) AS a, least(t1, greatest(coalesce(x0, t0), coalesce(x1, t1))) AS b FROM rs JOIN sn USING (segment_no) JOIN sc USING (segment_no) WHERE ll IS NOT NULL AND lr IS NOT NULL AND ul IS NOT NULL),
sw AS (SELECT * FROM sr WHERE b > a AND t_s BETWEEN a AND b), {found('sw', 'segment_no', 'cp', '12', 'prom >= 0.01 AND width BETWEEN 2 AND 100')},
cx AS (SELECT cp.segment_no, cp.idx, t_s, amp, prom, width / 250.0::DOUBLE AS width_s, {slope('ll', 'lr')} AS lower, {slope('ul', 'ur')} AS upper FROM cp JOIN sw USING (segment_no, idx)),
cy AS (SELECT * FROM cx WHERE amp BETWEEN least(lower, upper) AND greatest(lower, upper) AND width_s BETWEEN 0.01 AND 0.4 AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.segment_no = cx.segment_no AND rs.idx % 60 = 7 AND abs(rs.t_s - cx.t_s) < 0.060))"""
sql("r6_segment_candidates", f"""WITH {RV}, {SC.format(lr='CASE WHEN segment_no % 6 <> 0 THEN 0.4::DOUBLE END', ul='0.9::DOUBLE')}, {SEGC} SELECT segment_no, idx, {', '.join(f'round({c}, 7) AS {c}' for c in ('t_s', 'amp', 'prom', 'width_s', 'lower', 'upper'))} FROM cy""")
NRM = """nr AS (SELECT segment_no, ll, lr, coalesce(ul, cap) AS ul, ur, greatest(t0, least(coalesce(x0, t0), coalesce(x1, t1))) AS lo, least(t1, greatest(coalesce(x0, t0), coalesce(x1, t1))) AS hi, t0, t1 FROM sc JOIN sn USING (segment_no) JOIN (SELECT segment_no, quantile_cont(x, 0.95) AS cap FROM li GROUP BY 1) USING (segment_no)),
no AS (SELECT segment_no, round(ll, 10) AS afc_lower_left_value, round(lr, 10) AS afc_lower_right_value, round(ul, 10) AS afc_upper_left_value, round(ur, 10) AS afc_upper_right_value, round(CASE WHEN hi <= lo THEN t0 ELSE lo END, 10) AS x_start_s, round(CASE WHEN hi <= lo THEN t1 ELSE hi END, 10) AS x_end_s FROM nr)"""
sql("r7_refresh_segment_items", f"""WITH {RV}, {SC.format(lr='0.4::DOUBLE', ul='CASE WHEN segment_no % 2 = 0 THEN 0.9::DOUBLE ELSE (SELECT quantile_cont(q.x, 0.95) FROM li q WHERE q.segment_no = li.segment_no) END')}, {SEGC}, {NRM}, h AS (SELECT segment_no, count(*) AS c FROM cy GROUP BY 1)
SELECT no.*, coalesce(c, 0)::INTEGER AS n_helper FROM no LEFT JOIN h USING (segment_no)""")
sql("r21_normalize_range", f"""WITH {RV}, {SC.format(lr='CASE WHEN segment_no % 6 <> 0 THEN 0.4::DOUBLE END', ul='CASE WHEN segment_no % 2 = 0 THEN 0.9::DOUBLE END').replace("CASE segment_no % 3 WHEN 0 THEN 0.3::DOUBLE END AS x1", "CASE WHEN segment_no % 5 = 0 THEN -3.0::DOUBLE WHEN segment_no % 3 = 0 THEN 0.3::DOUBLE END AS x1")}, {NRM} SELECT * FROM no""")
sql("r8_segment_items", f"""WITH {US}, {UE}, q AS (SELECT segment_no, quantile_cont(x, 0.95) AS cap, min(t_s) AS t0, max(t_s) AS t1 FROM ev GROUP BY 1), m AS (SELECT segment_no, count(*) FILTER (type = 'Main Beat') AS nm, count(*) FILTER (type = 'Rescue') AS nr, arg_min(amp, time_s) FILTER (type = 'Main Beat') AS fa FROM ue GROUP BY 1)
SELECT segment_no, round(CASE WHEN n_main % 2 = 0 THEN n_main / 10.0::DOUBLE ELSE cap END, 6) AS upper_left, round(t0, 6) AS x_start_s, round(t1, 6) AS x_end_s, nm::INTEGER AS n_main, nr::INTEGER AS n_rescue, round(fa, 6) AS first_amp FROM us JOIN q USING (segment_no) JOIN m USING (segment_no) WHERE qc_pass AND nm > 0""")
sql("r9_upper_cap", f"WITH {UF}, {EV}, q AS (SELECT segment_no, quantile_cont(x, 0.95) AS cap FROM ev GROUP BY 1) SELECT segment_no, round(CASE n_main % 3 WHEN 0 THEN snr WHEN 1 THEN mx ELSE cap END, 6) AS upper_cap FROM uf JOIN q USING (segment_no)")
sql("r10_peaks_of_type", f"WITH {UE} SELECT segment_no, round(time_s, 6) AS time_s, amp FROM ue WHERE type = 'Main Beat'")
sql("r11_previous_main", f"""WITH {EV}, m AS (SELECT segment_no, t_s, row_number() OVER (PARTITION BY segment_no ORDER BY t_s) - 1 AS o FROM ev WHERE event_type = 'purchase')
SELECT e.segment_no, e.idx AS point, coalesce(m.o, -1)::INTEGER AS main_peak_index FROM ev e ASOF LEFT JOIN m ON e.segment_no = m.segment_no AND e.t_s >= m.t_s WHERE e.event_type = 'error'""")
NS = """pb AS (SELECT segment_no, idx AS point, t_s + 777.25::DOUBLE AS t_s FROM ev WHERE event_type = 'error'), nj AS (SELECT pb.segment_no, point, ev.idx AS near_idx, ev.x AS near_amp FROM pb JOIN ev USING (segment_no) QUALIFY row_number() OVER (PARTITION BY pb.segment_no, point ORDER BY abs(ev.t_s - pb.t_s), ev.idx) = 1)"""
sql("r12_nearest_sample", f"WITH {EV}, {NS} SELECT segment_no, point, near_idx, near_amp FROM nj")
NF = """nl AS (SELECT segment_no, max(idx) AS last FROM ev GROUP BY 1), np_ AS (SELECT DISTINCT segment_no, near_idx AS idx, near_amp AS amp FROM nj JOIN nl USING (segment_no) WHERE near_idx > 0 AND near_idx < last)"""
sql("r13_nearest_peak_features", f"""WITH {EV}, {NS}, {NF}, {shaped('np_', 'ev', 'segment_no', 'sh')} SELECT nj.segment_no, point, near_idx, round(prom, 6) AS prominence FROM nj LEFT JOIN sh ON sh.segment_no = nj.segment_no AND sh.idx = nj.near_idx""")
sql("r14_dedup_times", f"""WITH {EV}, p AS (SELECT segment_no, idx AS pos, round(x, 0) AS t FROM ev WHERE idx % 9 <> 0) SELECT segment_no, pos, round(t + pos * 1e-9, 6) AS t_s FROM p QUALIFY row_number() OVER (PARTITION BY segment_no, t ORDER BY pos) = 1""")
sql("r15_point_log", f"""WITH {EV}, p AS (SELECT segment_no, idx, round(x, 0) AS t_s, x AS amp, event_type FROM ev), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY segment_no, t_s ORDER BY idx DESC) = 1) SELECT segment_no, t_s, amp FROM l WHERE event_type <> 'error'""")
sql("r15_align_amplitudes", f"WITH {EV} SELECT segment_no, round(t_s, 6) AS t_s, round(CASE WHEN idx % 2 = 0 THEN x + 1 ELSE x END, 6) AS amp FROM ev WHERE event_type = 'error'")
sql("r16_merge_beat_decisions", f"""WITH {EV}, k AS (SELECT segment_no, idx, t_s, x, CASE event_type WHEN 'error' THEN 'auto_accepted' ELSE 'manual_added' END AS source FROM ev WHERE event_type IN ('error', 'view') AND segment_no % 5 <> 0),
nl AS (SELECT segment_no, max(idx) AS last FROM ev GROUP BY 1), np_ AS (SELECT k.segment_no, k.idx, k.x AS amp FROM k JOIN nl USING (segment_no) WHERE k.idx > 0 AND k.idx < last), {shaped('np_', 'ev', 'segment_no', 'sh')}
SELECT k.segment_no, 'PixelCorrelation Segment ' || k.segment_no AS segment_name, (k.segment_no % 4)::INTEGER AS main_peak_index, round(t_s, 6) AS time_s, k.x AS amplitude, source, CASE WHEN k.segment_no % 9 = 0 THEN -k.segment_no ELSE k.segment_no END || ':' || (k.segment_no % 4) AS review_id, round(prom, 6) AS prominence FROM k LEFT JOIN sh USING (segment_no, idx)""")
sql("r16_merged_events", f"""WITH {EV}, k AS (SELECT segment_no, idx, t_s, x, CASE event_type WHEN 'error' THEN 'auto_accepted' ELSE 'manual_added' END AS source FROM ev WHERE event_type IN ('error', 'view') AND segment_no % 5 <> 0),
nl AS (SELECT segment_no, max(idx) AS last FROM ev GROUP BY 1), np_ AS (SELECT k.segment_no, k.idx, k.x AS amp FROM k JOIN nl USING (segment_no) WHERE k.idx > 0 AND k.idx < last), {shaped('np_', 'ev', 'segment_no', 'sh')}
SELECT segment_no, round(t_s, 6) AS time_s, CASE event_type WHEN 'purchase' THEN 'Main Beat' ELSE 'Rescue' END AS type, x AS amp, round(x / 2, 6) AS prom, (idx % 7)::INTEGER AS transient, NULL::VARCHAR AS source, NULL::VARCHAR AS review_id, NULL::INTEGER AS main_peak_index FROM ev WHERE event_type IN ('purchase', 'signup')
UNION ALL SELECT k.segment_no, round(t_s, 6), 'AFC', k.x, round(prom, 6), NULL, source, CASE WHEN k.segment_no % 9 = 0 THEN -k.segment_no ELSE k.segment_no END || ':' || (k.segment_no % 4), (k.segment_no % 4)::INTEGER FROM k LEFT JOIN sh USING (segment_no, idx)""")
sql("r17_merge_segment_decisions", f"""WITH {EV}, k AS (SELECT segment_no, idx, t_s, x FROM ev WHERE event_type = 'error' AND segment_no % 5 <> 0), m AS (SELECT segment_no, t_s, row_number() OVER (PARTITION BY segment_no ORDER BY t_s) - 1 AS o FROM ev WHERE event_type = 'purchase'),
a AS (SELECT k.*, coalesce(m.o, -1) AS o FROM k ASOF LEFT JOIN m ON k.segment_no = m.segment_no AND k.t_s >= m.t_s), nl AS (SELECT segment_no, max(idx) AS last FROM ev GROUP BY 1), np_ AS (SELECT k.segment_no, k.idx, k.x AS amp FROM k JOIN nl USING (segment_no) WHERE k.idx > 0 AND k.idx < last), {shaped('np_', 'ev', 'segment_no', 'sh')}
SELECT a.segment_no, 'PixelCorrelation Segment ' || a.segment_no AS segment_name, o::INTEGER AS main_peak_index, round(t_s, 6) AS time_s, a.x AS amplitude, 'manual_curated' AS source, a.segment_no::VARCHAR AS review_id, round(prom, 6) AS prominence FROM a LEFT JOIN sh USING (segment_no, idx)""")
V = "round(mx, 2)"
UPG = f"""{UF}, up AS (SELECT segment_no::INTEGER AS segment_index, 'Segment ' || segment_no AS segment_name, segment_no % 3 AS g, {V} AS v FROM uf)"""
UPC = """v AS afc_lower_left_value, CASE g WHEN 2 THEN v + 2 END AS afc_lower_right_value, CASE g WHEN 1 THEN v + 1 WHEN 2 THEN v + 2 END AS afc_upper_left_value, CASE g WHEN 1 THEN v + 1 WHEN 2 THEN v + 2 END AS afc_upper_right_value,
 CASE g WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS x_start_s, CASE g WHEN 0 THEN 9.0::DOUBLE END AS x_end_s"""
sql("r18_upgrade_items", f"""WITH {UPG} SELECT segment_index, segment_name, CASE g WHEN 0 THEN 'completed' ELSE 'pending' END AS status, {UPC}, CASE g WHEN 2 THEN 1 ELSE 0 END::INTEGER AS n_main, CASE g WHEN 1 THEN 2 ELSE 1 END::INTEGER AS n_manual, CASE g WHEN 1 THEN 2 ELSE 0 END::INTEGER AS n_accepted FROM up""")
sql("r18_upgrade_decisions", f"""WITH {UPG} SELECT segment_index, CASE g WHEN 0 THEN 'completed' ELSE 'saved' END AS status, {UPC}, CASE g WHEN 1 THEN 2 ELSE 1 END::INTEGER AS n_manual, CASE g WHEN 1 THEN 2 ELSE 0 END::INTEGER AS n_accepted FROM up""")
sql("r19_resume_session", f"""WITH {UPG}, c AS (SELECT *, segment_index % 4 <> 1 AS has, segment_index % 4 <> 1 AND g = 0 AS same FROM up) SELECT segment_index, CASE WHEN same THEN v ELSE 0 END AS afc_lower_left_value, CASE WHEN same THEN NULL ELSE 1.0::DOUBLE END AS afc_lower_right_value,
 CASE WHEN same THEN NULL ELSE 2.0::DOUBLE END AS afc_upper_left_value, CASE WHEN same THEN NULL ELSE 3.0::DOUBLE END AS afc_upper_right_value, CASE WHEN same THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END AS x_start_s, CASE WHEN same THEN 9.0::DOUBLE ELSE 5.0::DOUBLE END AS x_end_s,
 CASE WHEN has AND g = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN NOT has THEN 0 WHEN g = 1 THEN 2 ELSE 1 END::INTEGER AS n_manual, 1::INTEGER AS n_main FROM c""")
sql("r19_resume_decisions", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN segment_index % 3 = 0 THEN {c} END AS {c}" for c in CORN) + f") FROM ({ORACLE['r18_upgrade_decisions']}) q")
sql("r20_apply_status", "SELECT DISTINCT user_id AS segment_no, CASE WHEN user_id % 3 = 0 THEN 'pending' WHEN user_id % 2 = 0 THEN 'skipped' ELSE 'completed' END AS status FROM events")

# ---- reports ----------------------------------------------------------------------
SUM = US + """, sm AS (SELECT segment, CASE WHEN qc_pass THEN 'PASS' ELSE 'REJECT' END AS qc, qc_reason, round(n_main / 10.0::DOUBLE * 60, 9) AS bpm_user, n_main_primary AS primary_main_beats, n_rescue AS rescue_peaks, n_main AS total_detected_events, 15.0::DOUBLE AS expected_beats, round(n_main / 15.0::DOUBLE, 9) AS detected_total_expected_ratio FROM us)"""
sql("g1_segment_summary", f"WITH {SUM} SELECT * FROM sm")
sql("g2_main_events", f"""WITH {UE} SELECT segment_no, round(time_s, 6) AS time_s, type, amp, CASE WHEN type = 'Rescue' THEN 0.5::DOUBLE ELSE round(prom, 6) END AS prom, CASE WHEN type = 'Rescue' THEN 0.25::DOUBLE ELSE round(width_s, 6) END AS width_s, CASE WHEN type <> 'Rescue' THEN transient END AS transient, (segment_no % 9)::VARCHAR AS sample_id FROM ue""")
sql("g3_rescue_rows", f"""WITH {LI}, {maxima('li', 'segment_no', 'mx')}, {shaped('mx', 'li', 'segment_no', 'sh')} SELECT segment_no, round(idx / 250.0::DOUBLE, 7) AS time_s, 'Rescue' AS type, round(amp, 7) AS amp, round(prom, 7) AS prom, round(width / 250.0::DOUBLE, 7) AS width_s FROM sh""")
sql("g4_afc_events", f"WITH {UE} SELECT CASE WHEN segment_no % 6 <> 0 THEN segment_no END AS segment_index, 'PixelCorrelation Segment ' || segment_no AS segment_name, round(time_s, 6) AS time_s, amp, (segment_no % 9)::VARCHAR AS sample_id FROM ue WHERE type = 'Rescue'")
sql("g5_clean_summary", f"""WITH {SUM}, {UE}, av AS (SELECT 'PixelCorrelation Segment ' || segment_no AS segment, avg(prom) AS ap, avg(amp) AS aa FROM ue GROUP BY 1)
SELECT sm.segment, qc, sm.qc_reason, CASE WHEN qc = 'PASS' THEN bpm_user END AS bpm_user, CASE WHEN qc = 'PASS' THEN primary_main_beats END AS primary_main_beats, CASE WHEN qc = 'PASS' THEN rescue_peaks END AS rescue_peaks, CASE WHEN qc = 'PASS' THEN total_detected_events END AS total_detected_events, expected_beats,
 CASE WHEN qc = 'PASS' THEN detected_total_expected_ratio END AS detected_total_expected_ratio, us.sample_id, CASE WHEN qc = 'PASS' THEN round(ap, 9) END AS average_prom, CASE WHEN qc = 'PASS' THEN round(aa, 9) END AS average_amp FROM sm JOIN us ON us.segment = sm.segment LEFT JOIN av ON av.segment = sm.segment""")
sql("g9_report_rows", f"""WITH {UE}, r AS (SELECT *, row_number() OVER (PARTITION BY segment_no ORDER BY idx) AS row FROM ue) SELECT segment_no, row::INTEGER AS row, printf('%.3f', idx / 8) AS time_s, printf('%.5f', amp) AS amp, CASE WHEN idx % 5 <> 0 THEN printf('%.5f', prom) ELSE '' END AS prom,
 printf('%.5f', width_s) AS width_s, CASE WHEN idx % 4 <> 0 THEN transient::VARCHAR ELSE '' END AS transient FROM r""")
sql("g10_review_counts", f"WITH {UD} SELECT count(*) FILTER (status <> 'skipped') AS reviewed, count(*) FILTER (status = 'skipped') AS skipped FROM ud")
sql("g10_source_counts", "SELECT user_id AS segment_no, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2")
sql("g11_review_rows", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = 'error' AND segment_no % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY segment_no ORDER BY idx) = 1), u AS (SELECT DISTINCT segment_no FROM ev)
SELECT segment_no, x AS x_start_s, coalesce('r' || idx, 'not_reviewed') AS status FROM u LEFT JOIN l USING (segment_no)""")
sql("g12_sample_id", f"WITH {IDS} SELECT segment_no, row_no, {NORM} AS sample_id FROM ids")
sql("g13_number_text", """SELECT event_id, CASE WHEN event_id % 6 < 2 THEN '' ELSE printf('%.3f', event_id / 8) END AS text, CASE WHEN event_id % 6 < 2 THEN -1.0::DOUBLE ELSE event_id / 8 END AS number FROM events""")
sql("g14_candidate_metrics", f"""WITH {UF} SELECT segment_no, CASE WHEN n_main % 2 = 0 THEN 'invert_false' ELSE 'invert_true' END AS candidate_selected, 'invert_false' AS first_label, 2::INTEGER AS n_tested, n_main % 2 = 1 AS inverted_pass, n_main AS n_as_is FROM uf""")

from . import analysis_sql  # noqa: E402, F401  (registers the whole analysis, made of the parts above)
