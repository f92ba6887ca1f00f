"""A query for each operator over the given tables, and DuckDB's SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import scalars as S
from ..operators import frames as O
from ..sources import decoders as D

FROM, TO = "2024-01-10T00:00:00Z", "2024-01-19T23:59:59Z"
NOW = 1700000000000000000
_LOW, _HIGH = S.parse_time(FROM), S.parse_time(TO)
TYPE = S.fnv1a_of("ndjson_v1")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_F = f"""WITH f AS (SELECT event_id AS frame_index, epoch_us(ts) * 1000 AS ts_ns, CAST({TYPE} AS BIGINT) AS type, CAST(strlen(props) AS BIGINT) AS length, props AS payload, event_type AS stream FROM events),
k AS (SELECT *, CASE WHEN regexp_matches(payload, '^[ \\t\\n\\x0B\\f\\r]*$') OR (regexp_matches(payload, '^[ \\t\\n\\x0B\\f\\r]*\\{{') AND (
  (contains(payload, '"schema_version"') AND (contains(payload, '"format"') OR contains(payload, '"type_label"') OR contains(payload, '"fallback_mode"') OR contains(payload, '"run_id"') OR contains(payload, '"status"')))
  OR (contains(payload, '"run_id"') AND (contains(payload, '"start_ts"') OR contains(payload, '"end_ts"') OR contains(payload, '"status"'))))) THEN 'CONTROL' ELSE 'DATA' END AS kind FROM f) """
#: CRC-32 over a blob of the given SQL expression, by a table of 256.
_CRC_TABLE = "[" + ",".join(str(__import__("functools").reduce(lambda v, _: (v >> 1) ^ (0xEDB88320 if v & 1 else 0), range(8), b)) for b in range(256)) + "]"


def _crc_sql(blob: str) -> str:
    bytes_ = f"list_transform(generate_series(1, CAST(octet_length({blob}) AS BIGINT)), lambda i: CAST(('0x' || substr(hex({blob}), 2 * i - 1, 2)) AS BIGINT))"
    return f"CAST(xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda a, b: xor(a >> 8, list_extract({_CRC_TABLE}, CAST(xor(a & 255, b) AS BIGINT) + 1))), 4294967295) AS BIGINT)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return O.from_events(_table(spark, d, "events"))


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


_SHOWN = ("frame_index", "ts_ns", "payload")


@query("replay_time_range", _F + f"SELECT frame_index, ts_ns, payload FROM k WHERE ts_ns >= {_LOW} AND ts_ns <= {_HIGH} AND kind = 'DATA' ORDER BY frame_index LIMIT 100")
def replay_time_range(spark, d):
    return O.replay(_frames(spark, d), FROM, TO, data_only=True, limit=100).select(*_SHOWN)


@query("replay_payload", _F + "SELECT payload FROM k")
def replay_payload(spark, d):
    return O.replay(_frames(spark, d)).select("payload")


@query("replay_with_ts", _F + "SELECT ts_ns || ' ' || payload AS line FROM k")
def replay_with_ts(spark, d):
    return O.replay(_frames(spark, d)).select(F.concat_ws(" ", F.col("ts_ns").cast("string"), "payload").alias("line"))


@query("replay_from_ts", _F + f"SELECT frame_index, ts_ns, payload FROM k WHERE ts_ns >= {_LOW}")
def replay_from_ts(spark, d):
    return O.replay(_frames(spark, d), from_ts=FROM).select(*_SHOWN)


@query("replay_to_ts", _F + f"SELECT frame_index, ts_ns, payload FROM k WHERE ts_ns <= {_HIGH}")
def replay_to_ts(spark, d):
    return O.replay(_frames(spark, d), to_ts=TO).select(*_SHOWN)


@query("replay_time_range_iso", _F + f"SELECT frame_index, ts_ns, payload FROM k WHERE ts_ns BETWEEN {S.parse_time('2024-01-05T06:07:08.123456789')} AND {S.parse_time('2024-01-06T00:00:00')}")
def replay_time_range_iso(spark, d):
    return O.replay(_frames(spark, d), "2024-01-05T06:07:08.123456789", "2024-01-06T00:00:00").select(*_SHOWN)


@query("replay_limit", _F + "SELECT frame_index, ts_ns, payload FROM k ORDER BY frame_index LIMIT 37")
def replay_limit(spark, d):
    return O.replay(_frames(spark, d), limit=37).select(*_SHOWN)


_CONV = """WITH f AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS frame_index, CASE role WHEN 'system' THEN '{"run_id":"' || conv_id || '","status":"' || turn || '"}' WHEN 'user' THEN text ELSE repeat(' ', turn) END AS payload, conv_id, turn FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(payload, '^[ \\t\\n\\x0B\\f\\r]*$') OR (payload LIKE '{%' AND contains(payload, '"run_id"') AND contains(payload, '"status"')) THEN 'CONTROL' ELSE 'DATA' END AS kind FROM f"""


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    payload = F.when(F.col("role") == "system", F.concat(F.lit('{"run_id":"'), "conv_id", F.lit('","status":"'), "turn", F.lit('"}'))).when(F.col("role") == "user", F.col("text")).otherwise(F.repeat(F.lit(" "), F.col("turn").cast("int")))
    return _table(spark, d, "conversations").select("conv_id", "turn", payload.alias("payload"))


@query("classify_frames", _CONV)
def classify_frames(spark, d):
    return _spoken(spark, d).select("conv_id", "turn", S.kind(F.col("payload")).alias("kind"))


@query("replay_data_only", f"SELECT conv_id, turn FROM ({_CONV}) WHERE kind = 'DATA'")
def replay_data_only(spark, d):
    return O.replay(_spoken(spark, d), data_only=True).select("conv_id", "turn")


_HUMAN = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%g')"


@query("replay_human_rows", _F + f"SELECT frame_index, kind, {_HUMAN} AS ts, length, substr(payload, 1, 4096) AS snippet FROM k")
def replay_human_rows(spark, d):
    return O.human_rows(_frames(spark, d))


@query("ts_human", _F + f"SELECT frame_index, CASE WHEN frame_index % 7 = 0 THEN 'NONE' ELSE {_HUMAN} END AS ts FROM k")
def ts_human(spark, d):
    return _frames(spark, d).select("frame_index", S.human(F.when(F.col("frame_index") % 7 == 0, 0).otherwise(F.col("ts_ns"))).alias("ts"))


@query("payload_snippet", "SELECT doc_id, substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 4096) AS snippet FROM documents")
def payload_snippet(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.snippet(F.col("text")).alias("snippet"))


@query("replay_no_trunc", "SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS snippet FROM documents")
def replay_no_trunc(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.snippet(F.col("text"), None).alias("snippet"))


@query("payload_contains", "SELECT doc_id, contains(text, 'license') OR contains(text, 'www') AS found FROM documents")
def payload_contains(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.contains_any(F.col("text"), ("license", "www")).alias("found"))


@query("replay_human_summary", _F + "SELECT stream, count(*) AS total, count(*) FILTER (kind = 'DATA') AS data, count(*) FILTER (kind = 'CONTROL') AS control, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts, (max(ts_ns) - min(ts_ns)) / 1e9 AS span_seconds FROM k GROUP BY stream")
def replay_human_summary(spark, d):
    return O.summary(_frames(spark, d), ("stream",))


@query("info_stats", _F + "SELECT stream, count(*) AS records, arg_min(ts_ns, frame_index) AS first_ts, arg_max(ts_ns, frame_index) AS last_ts, CAST(sum(length + 60) + 24 AS BIGINT) AS file_bytes, CAST(sum(length + 60) // count(*) AS BIGINT) AS avg_frame_bytes FROM k GROUP BY stream")
def info_stats(spark, d):
    return O.info(_frames(spark, d), ("stream",))


@query("index_header_stats", _F + "SELECT stream, arg_min(ts_ns, frame_index) AS first_ts, arg_max(ts_ns, frame_index) AS last_ts, count(*) AS entry_count FROM k WHERE ts_ns <> 0 GROUP BY stream")
def index_header_stats(spark, d):
    return _frames(spark, d).where("ts_ns <> 0").groupBy("stream").agg(F.min_by("ts_ns", "frame_index").alias("first_ts"), F.max_by("ts_ns", "frame_index").alias("last_ts"), F.count("*").alias("entry_count"))


@query("ingest_counters", _F + "SELECT stream, count(*) AS records, CAST(sum(length) AS BIGINT) AS payload_bytes, arg_max(ts_ns, frame_index) AS last_ts FROM k GROUP BY stream")
def ingest_counters(spark, d):
    return O.counters(_frames(spark, d), ("stream",))


@query("frame_layout", _F + "SELECT frame_index, CAST(24 + sum(length + 60) OVER (ORDER BY frame_index) - length - 60 AS BIGINT) AS file_offset, length FROM k")
def frame_layout(spark, d):
    return O.layout(_frames(spark, d)).select("frame_index", "file_offset", "length")


@query("index_build", _F + """, o AS (SELECT *, CAST(24 + sum(length + 60) OVER (ORDER BY frame_index) - length - 60 AS BIGINT) AS file_offset FROM k)
SELECT min(frame_index) AS frame_index, min(file_offset) AS "offset", arg_min(ts_ns, frame_index) AS first_ts, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, count(*) AS n_frames FROM o GROUP BY frame_index // 16""")
def index_build(spark, d):
    return O.index(_frames(spark, d), 16)


@query("index_summary", _F + "SELECT count(*) AS entries, 64 AS every_n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts, max(ts_ns) - min(ts_ns) AS span_ns FROM k WHERE frame_index % 64 = 0")
def index_summary(spark, d):
    return O.index(_frames(spark, d), 64).agg(F.count("*").alias("entries"), F.lit(64).alias("every_n"), F.min("first_ts").alias("first_ts"), F.max("first_ts").alias("last_ts"), (F.max("first_ts") - F.min("first_ts")).alias("span_ns"))


@query("index_lookup_ts", _F + """, e AS (SELECT ts_ns AS first_ts, frame_index FROM k WHERE frame_index % 16 = 0), p AS (SELECT epoch_us(o_orderdate) * 1000 + 1704067200000000000 - 694224000000000000 AS ts FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 5),
a AS (SELECT p.ts, e.first_ts, e.frame_index FROM p ASOF LEFT JOIN e ON p.ts >= e.first_ts)
SELECT ts, coalesce(first_ts, (SELECT min(first_ts) FROM e)) AS first_ts, coalesce(frame_index, 0) AS frame_index FROM a""")
def index_lookup_ts(spark, d):
    orders = _table(spark, d, "orders").where("o_orderkey % 50 = 0").select((O.nanoseconds("o_orderdate") + 1704067200000000000 - 694224000000000000).alias("ts"))
    probes = orders.unionByName(spark.range(1).select(F.lit(5).cast("long").alias("ts")))
    return O.lookup_time(O.index(_frames(spark, d), 16), probes).select("ts", "first_ts", "frame_index")


@query("index_lookup_frame", _F + "SELECT frame_index, least(frame_index // 16, (SELECT count(*) FROM k WHERE frame_index % 16 = 0) - 1) AS entry FROM k")
def index_lookup_frame(spark, d):
    entries = O.index(_frames(spark, d), 16).agg(F.count("*").alias("n"))  # one row
    return _frames(spark, d).crossJoin(F.broadcast(entries)).select("frame_index", F.least(F.floor(F.col("frame_index") / 16), F.col("n") - 1).alias("entry"))


@query("replay_indexed", _F + f"SELECT frame_index, ts_ns, payload FROM k WHERE ts_ns >= {_HIGH}")
def replay_indexed(spark, d):
    frames = _frames(spark, d)
    return O.replay_indexed(frames, O.index(frames, 64), 64, TO).select(*_SHOWN)


@query("rotate_records", _F + "SELECT stream, frame_index, (row_number() OVER (PARTITION BY stream ORDER BY frame_index) - 1) // 1000 AS segment FROM k")
def rotate_records(spark, d):
    return O.rotate_records(_frames(spark, d), 1000, ("stream",)).select("stream", "frame_index", "segment")


@query("rotate_time", _F + "SELECT stream, frame_index, (ts_ns - min(ts_ns) OVER (PARTITION BY stream)) // 86400000000000 AS segment FROM k")
def rotate_time(spark, d):
    return O.rotate_time(_frames(spark, d), 86400, ("stream",)).select("stream", "frame_index", "segment")


@query("rotate_size", """WITH RECURSIVE k AS (SELECT event_type AS stream, event_id AS frame_index, CAST(strlen(props) AS BIGINT) AS length, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
r AS (SELECT stream, frame_index, n, CAST(0 AS BIGINT) AS segment, length AS held FROM k WHERE n = 1 UNION ALL
SELECT k.stream, k.frame_index, k.n, CASE WHEN r.held > 0 AND r.held + k.length > 4096 THEN r.segment + 1 ELSE r.segment END, CASE WHEN r.held > 0 AND r.held + k.length > 4096 THEN k.length ELSE r.held + k.length END FROM r JOIN k ON k.stream = r.stream AND k.n = r.n + 1)
SELECT stream, frame_index, segment FROM r""")
def rotate_size(spark, d):
    return O.rotate_size(_frames(spark, d), 4096, "stream")


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = _frames(spark, d).withColumnRenamed("stream", "path")
    args = F.array(*(F.lit(x) for x in ("view", "signup", "purchase", "error", "click")))
    probes = O.probe(files).withColumn("created_ns", F.lit(1).cast("long")).withColumn("arg", F.array_position(args, F.col("path")))
    return files, probes


_MERGE = _F + """, p AS (SELECT stream AS path, arg_min(ts_ns, frame_index) AS first_ts, count(*) AS frames, list_position(['view', 'signup', 'purchase', 'error', 'click'], stream) AS arg FROM k GROUP BY stream),
o AS (SELECT *, row_number() OVER (ORDER BY first_ts NULLS LAST, arg) - 1 AS file_rank FROM p) """


@query("merge_probe", _MERGE + "SELECT path, first_ts, frames FROM p")
def merge_probe(spark, d):
    return _files(spark, d)[1].select("path", "first_ts", "frames")


@query("merge_by_first_ts", _MERGE + "SELECT path, file_rank FROM o")
def merge_by_first_ts(spark, d):
    return O.file_order(_files(spark, d)[1]).select("path", F.col("file_rank").cast("long").alias("file_rank"))


@query("merge_concat", _MERGE + "SELECT row_number() OVER (ORDER BY file_rank, frame_index) - 1 AS seq, path, ts_ns, payload FROM k JOIN o ON k.stream = o.path")
def merge_concat(spark, d):
    return O.merge(*_files(spark, d)).select("seq", "path", "ts_ns", "payload")


@query("merge_records_by_ts", _F + "SELECT row_number() OVER (ORDER BY ts_ns, frame_index) - 1 AS seq, stream, ts_ns, payload FROM k")
def merge_records_by_ts(spark, d):
    f = _frames(spark, d)  # times are without ties in this table; O.numbered orders by one key
    return O.numbered(f, "ts_ns", out="seq").select("seq", "stream", "ts_ns", "payload")


@query("export_ndjson", _F + "SELECT frame_index, payload AS line FROM k")
def export_ndjson(spark, d):
    return O.export(_frames(spark, d))


@query("json_escape", "SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS line FROM documents")
def json_escape(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.json_text(F.col("text")).alias("line"))


_LE = lambda x, n: "unhex(" + " || ".join(f"substr(lpad(to_hex({x}), {2 * n}, '0'), {2 * n - 1 - 2 * k}, 2)" for k in range(n)) + ")"


@query("le_pack_unpack", f"SELECT event_id, hex({_LE('user_id', 4)}) AS packed4, hex({_LE('epoch_us(ts) * 1000', 8)}) AS packed8, user_id AS back4, epoch_us(ts) * 1000 AS back8 FROM events")
def le_pack_unpack(spark, d):
    e = _table(spark, d, "events").select("event_id", S.little(F.col("user_id"), 4).alias("a"), S.little(O.nanoseconds("ts"), 8).alias("b"))
    return e.select("event_id", F.hex("a").alias("packed4"), F.hex("b").alias("packed8"), S.from_little(F.col("a"), 4).alias("back4"), S.from_little(F.col("b"), 8).alias("back8"))


_BLOB = f"({_LE(str(TYPE), 4)} || {_LE('ts_ns', 8)} || encode(payload))"


@query("crc32_frame", _F + f"SELECT frame_index, {_crc_sql(_BLOB)} AS crc32 FROM k")
def crc32_frame(spark, d):
    return _frames(spark, d).select("frame_index", S.frame_crc(F.col("type"), F.col("ts_ns"), F.col("payload")).alias("crc32"))


@query("verify_crc", _F + f"SELECT frame_index, {_crc_sql(_BLOB)} = {_crc_sql('(' + _LE(str(TYPE), 4) + ' || ' + _LE('ts_ns', 8) + ' || encode(CASE WHEN frame_index % 10 = 3 THEN payload || chr(33) ELSE payload END))')} AS valid FROM k")
def verify_crc(spark, d):
    f = _frames(spark, d).withColumn("stored", S.frame_crc(F.col("type"), F.col("ts_ns"), F.when(F.col("frame_index") % 10 == 3, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))))
    return f.select("frame_index", (S.frame_crc(F.col("type"), F.col("ts_ns"), F.col("payload")) == F.col("stored")).alias("valid"))


@query("type_id_fnv1a", "SELECT event_id, CAST(list_reduce(list_prepend(2166136261, list_transform(generate_series(1, length(event_type)), lambda i: ord(substr(event_type, i, 1)))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS BIGINT) AS type_id FROM events")
def type_id_fnv1a(spark, d):
    return _table(spark, d, "events").select("event_id", S.fnv1a(F.col("event_type")).alias("type_id"))


@query("format_labels", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{v}', CAST({S.fnv1a_of(v)} AS BIGINT))" for f, v in S.LABELS.items()) + ") t(format, label, type_id)")
def format_labels(spark, d):
    return spark.createDataFrame(list(S.LABELS.items()), "format string, label string").withColumn("type_id", S.fnv1a(F.col("label")))


@query("ts_numeric", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 1000000 WHEN 1 THEN 1000000000000000000 + o_orderkey ELSE -o_orderkey * 1000000 END AS ts_ns FROM orders")
def ts_numeric(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("  "), k, F.lit(".75"))).when(k % 3 == 1, (k + 1000000000000000000).cast("string")).otherwise(F.concat(F.lit("-"), k, F.lit("x")))
    return _table(spark, d, "orders").select("o_orderkey", S.unix_numeric(text).alias("ts_ns"))


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query("ts_rfc3339", "SELECT event_id, epoch_us(date_trunc('second', ts)) * 1000 + CASE event_id % 4 WHEN 1 THEN 123456789 WHEN 2 THEN -7200000000000 ELSE 0 END AS ts_ns, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 1 END AS ok FROM events")
def ts_rfc3339(spark, d):
    e, k = _table(spark, d, "events"), F.col("event_id") % 4
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 1, F.concat(iso, F.lit(".1234567891Z"))).when(k == 2, F.concat(iso, F.lit("+02:00"))).otherwise(F.concat(iso, F.lit("Z")))
    bad = F.when(k == 3, F.concat(iso, F.lit("Q"))).otherwise(text)
    return e.select("event_id", S.rfc3339(text).alias("ts_ns"), F.when(S.rfc3339(bad).isNotNull(), F.lit(1)).alias("ok"))


@query("ts_field", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('second', ts)) * 1000 WHEN 1 THEN user_id * 1000000 END AS ts_ns FROM events")
def ts_field(spark, d):
    k = F.col("event_id") % 3
    v = F.when(k == 0, F.concat(F.lit(' "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"'))).when(k == 1, F.concat(F.lit("\t"), "user_id")).otherwise(F.concat(F.lit('"'), "user_id", F.lit('"')))
    return _table(spark, d, "events").select("event_id", S.timestamp_field(v).alias("ts_ns"))


_DOC = """'{"n": ' || user_id || ', "in": {"ts" : "' || event_type || '"}, "time":' || (epoch_us(ts) // 1000) || '}'"""


def _objects(spark: SparkSession, d: str) -> DataFrame:
    ms = S.whole(O.nanoseconds("ts"), 1000000)
    return _table(spark, d, "events").select("event_id", F.concat(F.lit('{"n": '), "user_id", F.lit(', "in": {"ts" : "'), "event_type", F.lit('"}, "time":'), ms, F.lit("}")).alias("json"))


@query("json_find_value", "SELECT event_id, CAST(user_id AS VARCHAR) AS n, '\"' || event_type || '\"' AS ts, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS time, CAST(NULL AS VARCHAR) AS none FROM events")
def json_find_value(spark, d):
    return _objects(spark, d).select("event_id", *(S.json_value(F.col("json"), c).alias(c) for c in ("n", "ts", "time", "none")))


@query("ts_first_candidate", "SELECT event_id, epoch_us(ts) // 1000 * 1000000 AS ts_ns FROM events")
def ts_first_candidate(spark, d):
    return _objects(spark, d).select("event_id", S.first_time(F.col("json")).alias("ts_ns"))


@query("ts_default_now", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST({NOW} AS BIGINT) ELSE epoch_us(ts) * 1000 END AS ts_ns FROM events")
def ts_default_now(spark, d):
    k = F.col("event_id")
    ts = F.when(k % 4 == 0, F.lit(0)).when(k % 4 == 2, F.lit(None)).otherwise(O.nanoseconds("ts"))
    return _table(spark, d, "events").select("event_id", S.or_now(ts, NOW).alias("ts_ns"))


_LINES = "(SELECT doc_id, unnest(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END) AS record, unnest(generate_series(0, len(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END) - 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query("ingest_lines", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_replace(record, '\\r$', '') AS record FROM {_LINES}")
def ingest_lines(spark, d):
    return D.lines(_table(spark, d, "documents").select("doc_id", "text"))


_ND = f"""(SELECT user_id, string_agg({_DOC}, chr(10) ORDER BY event_id) || chr(10) AS text FROM events GROUP BY user_id)"""


@query("ingest_ndjson", f"SELECT user_id, event_id_text AS record, false AS mismatch, ts_ns FROM (SELECT user_id, {_DOC} AS event_id_text, epoch_us(ts) // 1000 * 1000000 AS ts_ns FROM events)")
def ingest_ndjson(spark, d):
    rows = _objects(spark, d).join(_table(spark, d, "events").select("event_id", "user_id"), "event_id")
    text = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "json"))), lambda x: F.concat(x["json"], F.lit("\r\n\n"))), "").alias("text"))
    return D.ndjson(text, NOW).drop("pos")


@query("fallback_raw", "SELECT conv_id, turn, CASE WHEN turn >= 2 THEN 'raw' ELSE 'ndjson' END AS kept_as FROM conversations")
def fallback_raw(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.col("turn") == 2).alias("mismatch"))
    return D.fall_back(rows, "conv_id").select("conv_id", F.col("pos").alias("turn"), "kept_as")


@query("ingest_csv", "SELECT n_regionkey AS region, n_nationkey || ',\"' || n_name || '\",' || (1700000000000 + n_nationkey) AS record, false AS mismatch, (1700000000000 + n_nationkey) * 1000000 AS ts_ns FROM nation")
def ingest_csv(spark, d):
    line = F.concat(F.col("n_nationkey"), F.lit(',"'), "n_name", F.lit('",'), F.col("n_nationkey") + F.lit(1700000000000))
    rows = _table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return D.csv(rows.withColumn("text", F.concat(F.lit("id,name,TimeStamp\n"), "text")), NOW, "region").select("region", "record", "mismatch", "ts_ns")


@query("csv_split", "SELECT c_custkey, 4 AS n, CAST(c_custkey AS VARCHAR) AS a, c_name || ', Ltd' AS b, '' AS c, c_mktsegment AS d FROM customer")
def csv_split(spark, d):
    f = D.split_csv(F.concat(F.col("c_custkey"), F.lit(',"'), "c_name", F.lit(', Ltd",,'), "c_mktsegment", F.lit(",")))
    return _table(spark, d, "customer").select("c_custkey", F.size(f).alias("n"), *(f[k].alias(c) for k, c in enumerate("abcd")))


@query("ingest_raw_chunks", "SELECT page_id, CAST(i AS INTEGER) AS pos, CAST(least(1000, strlen(html) - i * 1000) AS BIGINT) AS length FROM (SELECT page_id, html, unnest(generate_series(0, (strlen(html) - 1) // 1000)) AS i FROM pages WHERE strlen(html) > 0)")
def ingest_raw_chunks(spark, d):
    return D.raw(_table(spark, d, "pages").select("page_id", "html"), "html", 1000).drop("chunk")


@query("ingest_len4", "SELECT item_id, 0 AS pos, text AS record, false AS error FROM benchmark UNION ALL SELECT item_id, 1, '', false FROM benchmark UNION ALL SELECT item_id, 2, NULL, true FROM benchmark WHERE item_id % 2 = 0")
def ingest_len4(spark, d):
    b = F.encode("text", "UTF-8")
    whole = F.concat(S.little(F.octet_length(b), 4), b, F.unhex(F.lit("00000000")), F.when(F.col("item_id") % 2 == 0, F.unhex(F.lit("050000006162"))).otherwise(F.unhex(F.lit("0300"))))
    return D.len4(_table(spark, d, "benchmark").select("item_id", whole.alias("content")), "item_id").withColumn("record", F.decode("record", "UTF-8")).withColumn("pos", F.col("pos").cast("int"))


_B = "encode(text)[1:2048]"


@query("sniff_format", """WITH h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN repeat('{"a":[1]}' || chr(10), CAST(doc_id % 5 AS BIGINT)) WHEN 1 THEN repeat('a,b' || chr(10), CAST(doc_id % 5 AS BIGINT)) ELSE repeat('x' || chr(10), CAST(doc_id % 5 AS BIGINT)) END AS t FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 5 >= 3 THEN 'ndjson' WHEN doc_id % 5 = 2 THEN 'lines' ELSE 'raw' END WHEN 1 THEN CASE WHEN doc_id % 5 >= 3 THEN 'csv' WHEN doc_id % 5 = 2 THEN 'lines' ELSE 'raw' END ELSE CASE WHEN doc_id % 5 >= 2 THEN 'lines' ELSE 'raw' END END AS format FROM h""")
def sniff_format(spark, d):
    k, n = F.col("doc_id") % 3, (F.col("doc_id") % 5).cast("int")
    t = F.when(k == 0, F.repeat(F.lit('{"a":[1]}\n'), n)).when(k == 1, F.repeat(F.lit("a,b\n"), n)).otherwise(F.repeat(F.lit("x\n"), n))
    return _table(spark, d, "documents").select("doc_id", D.sniff(t).alias("format"))


@query("meta_frame_json", 'SELECT event_type, \'{"schema_version":1,"format":"ndjson","type_label":"\' || event_type || \'","fallback_mode":"soft"}\' AS line FROM events GROUP BY event_type')
def meta_frame_json(spark, d):
    rows = _table(spark, d, "events").select("event_type").distinct()
    return rows.select("event_type", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("ndjson").alias("format"), F.col("event_type").alias("type_label"), F.lit("soft").alias("fallback_mode"))).alias("line"))


def _written(spark: SparkSession, d: str, run: bool = False) -> str:
    """The events as segments, one for each type of event, in a new folder of the shared one."""
    import tempfile
    import uuid

    from ..sources import segments

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="strandlog-")
    folder = f"{shared.rstrip('/')}/segments-{uuid.uuid4().hex}"
    segments.write(_frames(spark, d).withColumnRenamed("stream", "segment"), folder, created_ns=NOW, run=run).collect()  # a row for each segment
    return folder


_WRITTEN = _F + "SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY frame_index) - 1 AS frame_index, type, ts_ns, payload FROM k"


@query("write_frames_roundtrip", _WRITTEN)
def write_frames_roundtrip(spark, d):
    from ..sources import segments

    rows = segments.scan(spark, _written(spark, d))
    return rows.select(F.regexp_extract("path", r"segment-(\w+)\.seg", 1).alias("stream"), "frame_index", "type", "ts_ns", F.decode("payload", "UTF-8").alias("payload"))


@query("scan_headers_only", f"SELECT stream, frame_index, CAST(strlen(payload) AS BIGINT) AS length, ts_ns FROM ({_WRITTEN})")
def scan_headers_only(spark, d):
    from ..sources import segments

    rows = segments.scan(spark, _written(spark, d), payloads=False)
    return rows.select(F.regexp_extract("path", r"segment-(\w+)\.seg", 1).alias("stream"), "frame_index", "length", "ts_ns")


@query("verify_report", "SELECT event_type AS stream, 0 AS exit_code, true AS sealed, false AS salvage, count(*) + 3 AS records FROM events GROUP BY event_type")
def verify_report(spark, d):
    from ..sources import segments

    files = segments.list_files(_written(spark, d, run=True))
    return segments.reports(spark, files).select(F.regexp_extract("file", r"segment-(\w+)\.seg", 1).alias("stream"), "exit_code", "sealed", "salvage", "records")


_STREAM = r"segment-(\w+)\.seg"


def _values(rows: list[tuple], cols: str) -> str:
    show = lambda v: "NULL" if v is None else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({cols})"


@query("scan_from_offset", f"SELECT stream, frame_index - 10 AS place, ts_ns, payload FROM ({_WRITTEN}) WHERE frame_index >= 10")
def scan_from_offset(spark, d):
    from ..sources import segments

    folder = _written(spark, d)
    starts = segments.scan(spark, folder, payloads=False).where("frame_index = 10").select("path", "file_offset")

    def run(batches):
        for b in batches:
            for path, at in zip(b["path"].to_pylist(), b["file_offset"].to_pylist()):
                yield from segments.frames_from(path, at)

    rows = starts.mapInArrow(run, "path string, place long, ts_ns long, payload binary")
    return rows.select(F.regexp_extract("path", _STREAM, 1).alias("stream"), "place", "ts_ns", F.decode("payload", "UTF-8").alias("payload"))


@query("chain_tip", "SELECT event_type AS stream, count(*) AS records, true AS whole FROM events GROUP BY event_type")
def chain_tip(spark, d):
    from ..sources import segments

    ends = segments.scan(spark, _written(spark, d), ends=True).where("rc <> 0")
    return ends.select(F.regexp_extract("path", _STREAM, 1).alias("stream"), F.col("frame_index").alias("records"), ((F.col("rc") == segments.END) & (F.octet_length("prev_hash") == 32)).alias("whole"))


@query("run_markers", "SELECT event_type AS stream, CAST(m AS BIGINT) AS marker, count(*) * 0 + 1 AS n FROM events, (VALUES (0), (1), (2)) v(m) GROUP BY event_type, m")
def run_markers(spark, d):
    from ..sources import segments

    rows = segments.scan(spark, _written(spark, d, run=True)).where(S.kind_by_type(F.col("type")) == "CONTROL")
    return rows.groupBy(F.regexp_extract("path", _STREAM, 1).alias("stream"), (F.col("type") - S.CONTROL_TYPE).alias("marker")).agg(F.count("*").alias("n"))


@query("repair_prefix", "SELECT event_type AS stream, count(*) // 2 AS records_kept, 1 AS salvage_reason, 'partial_frame' AS salvage_reason_str, 0 AS exit_after FROM events GROUP BY event_type")
def repair_prefix(spark, d):
    """Each segment is cut within the frame after its first half, repaired and verified."""
    from ..sources import segments

    files = segments.file_tasks(spark, segments.list_files(_written(spark, d)))

    def run(batches):
        import pandas as pd

        for b in batches:
            for path in b["file"]:
                segments.cut_half(path, path + ".cut")
                r = segments.repair_file(path + ".cut")
                after = segments.verify_file(path + ".cut.repaired")["exit_code"]
                yield pd.DataFrame([(path, r["records_kept"], r["salvage_reason"], r["salvage_reason_str"], after)])

    out = files.mapInPandas(run, "path string, records_kept long, salvage_reason int, salvage_reason_str string, exit_after int")
    return out.select(F.regexp_extract("path", _STREAM, 1).alias("stream"), "records_kept", "salvage_reason", "salvage_reason_str", "exit_after")


@query("seal_sign_check", "SELECT item_id, true AS good, false AS changed FROM benchmark")
def seal_sign_check(spark, d):
    from ..sources import seal

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for k, text in zip(b["item_id"], b["text"]):
                public, signature = seal.sign(bytes(32), text.encode())
                out.append((k, seal.check(public, signature, text.encode()), seal.check(public, signature, text.encode() + b".")))
            yield pd.DataFrame(out, columns=["item_id", "good", "changed"])

    return _table(spark, d, "benchmark").select("item_id", "text").mapInPandas(run, "item_id long, good boolean, changed boolean")


@query("stream_ingest", f"SELECT user_id % 5 AS k, count(*) AS records, CAST(sum(epoch_us(ts) // 1000 % 1000000) AS BIGINT) AS ms, CAST(sum(strlen({_DOC})) AS BIGINT) AS payload_bytes FROM events GROUP BY 1")
def stream_ingest(spark, d):
    """The events' objects as files of lines, streamed into frames in two runs from one checkpoint."""
    import tempfile
    import uuid

    from ..streaming import ingest

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="strandlog-")
    folder = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = _objects(spark, d)
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).select("json").write.mode("append").text(f"{folder}/in")
        ingest.run(ingest.lines_stream(spark, f"{folder}/in", NOW), f"{folder}/out", f"{folder}/checkpoint")
    frames = spark.read.parquet(f"{folder}/out")
    return frames.groupBy((S.json_value(F.col("payload"), "n").cast("long") % 5).alias("k")).agg(F.count("*").alias("records"), F.sum(S.whole(F.col("ts_ns"), 1000000) % 1000000).alias("ms"), F.sum("length").alias("payload_bytes"))


@query("ingest_json", f"SELECT event_id, {_DOC} AS record, epoch_us(ts) // 1000 * 1000000 AS ts_ns FROM events")
def ingest_json(spark, d):
    return D.decode(_objects(spark, d).withColumnRenamed("json", "text"), "json", NOW, "event_id")


@query("trim_and_ci_equal", "SELECT doc_id, source, doc_id % 2 = 0 AS same FROM documents")
def trim_and_ci_equal(spark, d):
    padded = F.concat(F.lit(" \t\x0b\r\n"), "source", F.lit("\f "))
    other = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat("source", F.lit("x")))
    return _table(spark, d, "documents").select("doc_id", S.trimmed(padded).alias("source"), (F.lower(S.trimmed(padded)) == F.lower(other)).alias("same"))


_LITERALS = [("64M", "size", 67108864), ("1k", "size", 1024), ("off", "size", 0), ("2h", "time", 7200), ("90s", "time", 90), ("10k", "records", 10000), ("2m", "records", 2000000)]


@query("literal_parse", _values(_LITERALS, "text, unit, value"))
def literal_parse(spark, d):
    return spark.createDataFrame([(t, u, S.literal(t, u)) for t, u, _ in _LITERALS], "text string, unit string, value long")


@query("rotate_clause_parse", _values([("size=64M,time=1h", 67108864, 3600, 0), ("500", 0, 0, 500), ("off", 0, 0, 0), ("recs=1k", 0, 0, 1000)], "text, size, time, records"))
def rotate_clause_parse(spark, d):
    rows = [(t, *S.rotate_clause(t).values()) for t in ("size=64M,time=1h", "500", "off", "recs=1k")]
    return spark.createDataFrame(rows, "text string, size long, time long, records long")


@query("replay_time_literal", "SELECT t AS text, epoch_us(CAST(t AS TIMESTAMP)) * 1000 AS ns FROM (VALUES ('2024-01-10T00:00:00'), ('2025-11-17 12:23:45.123456')) v(t)")
def replay_time_literal(spark, d):
    return spark.createDataFrame([(t, S.parse_time(t)) for t in ("2024-01-10T00:00:00", "2025-11-17 12:23:45.123456")], "text string, ns long")


@query("source_file")
def source_file(spark, d):
    """Rows only: where the tables lie isn't known to SQL."""
    from ..sources import inputs

    return inputs.open_source(spark, "file", f"{d}/region.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.octet_length("content").alias("bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
