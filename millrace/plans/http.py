"""HTTP exchanges: headers, targets, phases, bodies."""

import gzip
from typing import Iterator

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..functions.batches import bounded
from ..operators import bodies, handlers, http, joins, metrics
from ..session import scratch_path
from ..streaming.at_rest import KEYED_STATE, run_table_as_stream
from ..streaming.exchanges import exchange_state, with_bodies
from .inputs import CHUNK, DOC_CHUNKS, PHASES, digest, doc_chunks, map_text, phases, plain_headers, table
from .registry import query


@query(
    "s1_load_exchanges",
    f"""
    WITH {PHASES}
    SELECT stream_id, seq, phase, headers, md5(body) AS chunk, end_of_stream, ts_us, duration_ns FROM phases
    """,
)
def load_exchanges_query(spark, folder):
    return phases(spark, folder).select(
        "stream_id",
        "seq",
        "phase",
        map_text("headers").alias("headers"),
        digest("chunk").alias("chunk"),
        "end_of_stream",
        F.unix_micros("ts").alias("ts_us"),
        "duration_ns",
    )


def _pairs(spark, folder):
    """Header pairs of a page: text, a repeated name, bytes in and out of UTF-8."""
    pair = lambda name, value, raw: F.struct(
        F.lit(name).alias("name"), value.cast("string").alias("value"), raw.cast("binary").alias("raw")
    )
    none = F.lit(None)
    page = F.col("page_id")
    return table(spark, folder, "pages").select(
        "page_id",
        F.array(
            pair(":path", F.col("url"), none),
            pair("x-page", page, none),
            pair("x-page", page + 1, none),
            pair("x-raw", F.lit(""), F.concat("html", F.lit("!"))),
            pair("x-raw", F.lit(None), F.col("html")),
            pair("x-bytes", F.lit(""), F.concat(F.lit(b"\xff"), F.col("url").cast("binary"))),
            pair("x-both", F.lit("text"), none),
            pair("x-both", F.lit(""), F.lit(b"raw")),
        ).alias("pairs"),
    )


@query(
    "p3_split_headers",
    """
    SELECT page_id, ':path=' || url || '&x-both=text&x-page=' || (page_id + 1) AS headers,
           'x-both=' || hex(encode('raw')) || '&x-bytes=FF' || hex(encode(url)) || '&x-raw='
             || hex(encode(html)) AS raw_headers
    FROM pages
    """,
)
def split_headers_query(spark, folder):
    split = http.split_headers(_pairs(spark, folder))
    return split.select(
        "page_id",
        map_text("headers").alias("headers"),
        map_text(F.transform_values("raw_headers", lambda _, v: F.hex(v))).alias("raw_headers"),
    )


@query(
    "p4_stringify_headers",
    """
    SELECT page_id, ':path=' || url || '&x-both=raw&x-bytes=' || to_base64(unhex('FF' || hex(encode(url))))
           || '&x-page=' || (page_id + 1) || '&x-raw=' || html AS all_headers
    FROM pages
    """,
)
def stringify_query(spark, folder):
    split = http.split_headers(_pairs(spark, folder))
    return http.stringify_headers(split).select("page_id", map_text("all_headers").alias("all_headers"))


@query(
    "p5_header",
    """
    SELECT page_id, CAST(page_id + 1 AS VARCHAR) AS page, 'text' AS "both",
           to_base64(unhex('FF' || hex(encode(url)))) AS bytes, NULL::VARCHAR AS other_case
    FROM pages
    """,
)
def header_query(spark, folder):
    df = http.split_headers(_pairs(spark, folder))
    for name, out in (("x-page", "page"), ("x-both", "both"), ("x-bytes", "bytes"), ("X-Page", "other_case")):
        df = http.header(df, name, out)
    return df.select("page_id", "page", "both", "bytes", F.col("other_case").cast("string"))


@query(
    "p6_drop_headers",
    """
    SELECT page_id, 'x-page=' || (page_id + 1) AS headers, 'x-raw=' || html AS raw_headers FROM pages
    """,
)
def drop_headers_query(spark, folder):
    df = http.split_headers(_pairs(spark, folder))
    df = http.drop_headers(df, names=["x-both"])
    df = http.drop_headers(df, prefix=":")
    df = http.drop_headers(df, suffix="-bytes")
    df = http.drop_headers(df, where=lambda name: F.length(name) > 6)
    return df.select(
        "page_id",
        map_text("headers").alias("headers"),
        map_text(F.transform_values("raw_headers", lambda _, v: v.cast("string"))).alias("raw_headers"),
    )


@query(
    "p7_request_target",
    """
    SELECT doc_id, 'https' AS scheme, 'docs.example' AS authority, 'GET' AS method,
           '/' || source || '/' || doc_id AS path,
           CASE WHEN doc_id % 11 IN (0, 1) OR doc_id % 13 = 0 THEN NULL ELSE lang || ',' || source END AS langs,
           CASE WHEN doc_id % 11 IN (0, 1) OR doc_id % 13 = 0 THEN NULL ELSE md5(text) END AS q,
           CASE WHEN doc_id % 11 IN (0, 1) OR doc_id % 13 = 0 THEN NULL ELSE '' END AS flag,
           doc_id % 11 IN (0, 1) OR doc_id % 13 = 0 AS no_query, 0 AS pseudo_left
    FROM documents
    """,
)
def request_target_query(spark, folder):
    doc = F.col("doc_id")
    tail = (
        F.when(doc % 11 == 0, F.lit("&bad=%zz"))
        .when(doc % 11 == 1, F.lit("&a=1;b=2"))
        .otherwise(F.lit(""))
    )
    path = F.concat(F.lit("/"), "source", F.lit("/"), doc)
    target = F.when(doc % 13 == 0, path).otherwise(
        F.concat(
            path, F.lit("?lang="), "lang", F.lit("&q="), F.url_encode("text"), F.lit("&lang="), "source",
            F.lit("&&flag"), tail, F.lit("?tail=%zz"),
        )
    )
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.create_map(
            F.lit(":scheme"), F.lit("https"), F.lit(":authority"), F.lit("docs.example"), F.lit(":path"), target
        ).alias("headers"),
        F.create_map(F.lit(":method"), F.lit(b"GET")).alias("raw_headers"),
    )
    read = http.request_target(df)
    return read.select(
        "doc_id",
        "scheme",
        "authority",
        "method",
        "path",
        F.array_join(F.try_element_at("query", F.lit("lang")), ",").alias("langs"),
        F.md5(F.array_join(F.try_element_at("query", F.lit("q")), ",").cast("binary")).alias("q"),
        F.array_join(F.try_element_at("query", F.lit("flag")), ",").alias("flag"),
        F.col("query").isNull().alias("no_query"),
        (F.size("headers") + F.size("raw_headers")).alias("pseudo_left"),
    )


@query(
    "p8_request_id",
    f"""
    WITH {PHASES}
    SELECT stream_id, phase, CASE WHEN phase = 1 THEN regexp_extract(headers, 'x-request-id=(.*)$', 1) ELSE 'none' END
           AS request_id
    FROM phases WHERE phase IN (1, 4)
    """,
)
def request_id_query(spark, folder):
    heads = phases(spark, folder).filter("phase in (1, 4)")
    return http.request_id(heads, fallback="none").select("stream_id", "phase", "request_id")


@query(
    "p9_has_body",
    f"""
    WITH {PHASES}
    SELECT stream_id, phase, phase = 1 AND NOT end_of_stream AS has_body FROM phases WHERE phase IN (1, 4)
    """,
)
def has_body_query(spark, folder):
    heads = phases(spark, folder).filter("phase in (1, 4)")
    return http.has_body(heads).select("stream_id", "phase", "has_body")


# Status texts and the number each is read as.
@query(
    "p10_response_status",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag IN ('A', 'R') THEN l_partkey ELSE 0 END::INTEGER AS status
    FROM lineitem
    """,
)
def response_status_query(spark, folder):
    """Numbers in decimal and in hex, as text and as bytes, and texts that are no number."""
    flag, number = F.col("l_returnflag"), F.col("l_partkey")
    text = (
        F.when(flag == "A", number.cast("string"))
        .when(flag == "R", F.concat(F.lit("0x"), F.lower(F.hex(number))))
        .otherwise(F.col("l_linestatus"))
    )
    df = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") < 25, F.create_map(F.lit(":status"), text)).alias("headers"),
        F.when(F.col("l_quantity") >= 25, F.create_map(F.lit(":status"), text.cast("binary"))).alias("raw_headers"),
    )
    return http.response_status(df).select("l_orderkey", "l_linenumber", "status")


@query(
    "p11_body_type",
    """
    SELECT o_orderkey, o_orderpriority AS content_type,
           CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) WHEN o_orderstatus = 'O' AND o_totalprice >= 200000 THEN o_orderpriority
                ELSE 'none' END AS encoding,
           o_totalprice < 200000 AS chunked,
           o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice >= 200000) AS compressed
    FROM orders
    """,
)
def body_type_query(spark, folder):
    """The priority of an order as its type, and as its content or transfer encoding."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    none = F.expr("cast(map() as map<string,string>)")
    transfer = F.when(F.col("o_totalprice") < 200000, F.lit("chunked")).when(status == "O", priority)
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        F.map_concat(
            F.create_map(F.lit("content-type"), priority),
            F.when(status == "F", F.create_map(F.lit("content-encoding"), F.lower(priority))).otherwise(none),
            F.when(transfer.isNotNull(), F.create_map(F.lit("transfer-encoding"), transfer)).otherwise(none),
        ).alias("headers"),
        F.lit(None).cast("map<string,binary>").alias("raw_headers"),
    )
    return http.body_type(df).drop("headers", "raw_headers")


@query(
    "p12_tag_phase",
    """
    SELECT event_id, CAST(event_id % 6 + 1 AS INTEGER) AS phase,
           CASE WHEN event_id % 6 + 1 IN (1, 2, 3, 5) THEN 'processing-phase=' || (event_id % 6 + 1) || '&' ELSE '' END
             || 'type=' || event_type AS headers
    FROM events
    """,
)
def tag_phase_query(spark, folder):
    kinds = F.array(*[F.lit(kind) for kind in http.PHASES])
    df = table(spark, folder, "events").select(
        "event_id",
        F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("kind"),
        F.create_map(F.lit("type"), "event_type").alias("headers"),
    )
    return http.tag_phase(df).select("event_id", "phase", map_text("headers").alias("headers"))


@query(
    "p13_resolve_status",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 403 WHEN 2 THEN 200 + CAST(event_id % 3 AS INTEGER)
                          ELSE 201 END
                     * CASE WHEN event_id % 4 = 2 AND event_id % 3 = 0 THEN 0 ELSE 1 END AS status,
           'type=' || event_type AS headers
    FROM events
    """,
)
def resolve_status_query(spark, folder):
    pick = F.col("event_id") % 4
    own = F.create_map(F.lit("type"), F.col("event_type"))
    mark = lambda text: F.map_concat(own, F.create_map(F.lit(http.STATUS_HEADER), F.lit(text)))
    df = table(spark, folder, "events").select(
        "event_id",
        F.when(pick == 2, 200 + F.col("event_id") % 3).when(pick == 3, 201).otherwise(200).cast("int").alias("status"),
        F.when(pick == 1, mark("403")).when(pick == 3, mark("4o3")).otherwise(own).alias("headers"),
    )
    return http.resolve_status(df).select("event_id", "status", map_text("headers").alias("headers"))


@query(
    "p14_apply_response",
    """
    WITH e AS (
      SELECT event_id, 1 + event_id % 6 AS phase, user_id % 2 = 0 AS has_body,
             CASE WHEN value < 50 THEN 0 ELSE 403 END AS status,
             CASE event_type WHEN 'click' THEN '' ELSE event_type END AS answer,
             event_type = 'error' AS failed
      FROM events),
    m AS (
      SELECT e.*, x.mode,
             NOT failed AND CASE x.mode
               WHEN 'preprocessor' THEN phase = 2 OR (phase = 1 AND NOT has_body)
               WHEN 'postprocessor' THEN phase = 5
               WHEN 'wrapprocessor' THEN phase IN (2, 5) OR (phase = 1 AND NOT has_body)
               ELSE false END AS acts
      FROM e CROSS JOIN (VALUES ('preprocessor'), ('postprocessor'), ('wrapprocessor'), ('observeprocessor')) x(mode)),
    d AS (
      SELECT *, CASE WHEN acts AND status > 0 AND NOT (mode = 'wrapprocessor' AND phase = 5) THEN 'immediate'
                     WHEN acts AND phase IN (2, 5) AND answer <> '' THEN 'replace' ELSE 'continue' END AS decision
      FROM m)
    SELECT event_id, mode, decision, CASE WHEN decision = 'immediate' THEN status END AS immediate_status,
           CASE WHEN decision = 'replace' THEN answer ELSE 'body' END AS new_body
    FROM d
    """,
)
def apply_response_query(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id",
        (1 + F.col("event_id") % 6).cast("int").alias("phase"),
        (F.col("user_id") % 2 == 0).alias("has_body"),
        F.when(F.col("value") < 50, 0).otherwise(403).alias("status"),
        F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).cast("binary").alias("response_body"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
        F.lit(b"body").alias("body"),
    )
    decided = None
    for mode in ("preprocessor", "postprocessor", "wrapprocessor", "observeprocessor"):
        one = http.apply_response(df, mode).select(
            "event_id",
            F.lit(mode).alias("mode"),
            "decision",
            "immediate_status",
            F.col("new_body").cast("string").alias("new_body"),
        )
        decided = one if decided is None else decided.unionByName(one)
    return decided


@query(
    "p15_header_mutations",
    """
    WITH ops AS (
      SELECT l_orderkey AS stream_id, l_linenumber AS phase,
             l_partkey * 1000000 + CAST(round(l_extendedprice) AS BIGINT) % 1000000 AS op_seq,
             CASE l_returnflag WHEN 'A' THEN 'remove' WHEN 'R' THEN 'ADD_IF_ABSENT'
                               ELSE 'OVERWRITE_IF_EXISTS_OR_ADD' END AS op,
             'x-' || (l_suppkey % 5) AS name, CASE WHEN l_linestatus = 'F' THEN 'v' || l_suppkey END AS value,
             CASE WHEN l_quantity > 25 THEN CAST(l_partkey AS VARCHAR) END AS raw_value
      FROM lineitem)
    SELECT stream_id, phase, op_seq AS position, 'set' AS kind, name, value, raw_value, op AS action,
           CASE WHEN value IS NOT NULL AND raw_value IS NOT NULL
                THEN 'only one of ''value'' or ''raw_value'' can be set' END AS error
    FROM ops WHERE op <> 'remove'
    UNION ALL
    SELECT stream_id, phase, min(op_seq), 'remove', name, NULL, NULL, NULL, NULL
    FROM ops WHERE op = 'remove' GROUP BY stream_id, phase, name
    """,
)
def header_mutations_query(spark, folder):
    flag = F.col("l_returnflag")
    ops = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"),
        F.col("l_linenumber").alias("phase"),
        (F.col("l_partkey") * 1000000 + F.round("l_extendedprice").cast("long") % 1000000).alias("op_seq"),
        F.when(flag == "A", "remove").when(flag == "R", http.ADD).otherwise(http.OVERWRITE).alias("op"),
        F.concat(F.lit("x-"), F.col("l_suppkey") % 5).alias("name"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("v"), "l_suppkey")).alias("value"),
        F.when(F.col("l_quantity") > 25, F.col("l_partkey").cast("string").cast("binary")).alias("raw_value"),
    )
    return http.header_mutations(ops).withColumn("raw_value", F.col("raw_value").cast("string"))


@query(
    "p16_replace_body",
    """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5(upper(lang) || text) END AS body,
           CASE WHEN doc_id % 3 > 0 THEN CAST(octet_length(encode(upper(lang) || text)) AS INTEGER) END AS content_length,
           CASE WHEN doc_id % 3 > 0 THEN 'OVERWRITE_IF_EXISTS_OR_ADD' END AS length_action
    FROM documents
    """,
)
def replace_body_query(spark, folder):
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.col("text").cast("binary").alias("body"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(""))
        .otherwise(F.concat(F.upper("lang"), "text"))
        .cast("binary")
        .alias("replacement"),
    )
    return http.replace_body(df).withColumn("body", digest("body")).drop("replacement")


@query(
    "p16_clear_body",
    """
    SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN md5('') ELSE md5(upper(lang) || text) END AS body,
           CASE WHEN source NOT IN ('src0', 'src1') THEN CAST(octet_length(encode(upper(lang) || text)) AS INTEGER) END AS content_length,
           CASE WHEN source NOT IN ('src0', 'src1') THEN 'OVERWRITE_IF_EXISTS_OR_ADD' END AS length_action
    FROM documents
    """,
)
def clear_body_query(spark, folder):
    """Bodies of some sources emptied, the others replaced."""
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.col("text").cast("binary").alias("body"),
        F.concat(F.upper("lang"), "text").cast("binary").alias("replacement"),
        F.col("source").isin("src0", "src1").alias("clear"),
    )
    return http.replace_body(df, clear="clear").withColumn("body", digest("body")).drop("replacement", "clear")


@query(
    "p17_classify_route",
    """
    WITH r AS (
      SELECT p_partkey, p_type, CASE WHEN p_retailprice < 1000 THEN 'GET' ELSE 'POST' END AS method,
             CASE WHEN p_size < 16 THEN 'infer' WHEN p_size < 32 THEN 'ready' WHEN p_size < 46 THEN 'model' ELSE 'server' END AS kind,
             p_brand
      FROM part),
    e AS (
      SELECT *, CASE WHEN kind = 'infer' THEN 'model_infer' WHEN kind = 'ready' THEN 'model_ready'
                     WHEN kind = 'server' THEN CASE WHEN p_brand < 'Brand#3' THEN 'server_live' ELSE 'server_metadata' END
                     WHEN p_type = 'ECONOMY' THEN 'model_metadata' ELSE 'not_found' END AS endpoint
      FROM r)
    SELECT p_partkey, endpoint, CASE WHEN endpoint = 'not_found' THEN 404
             WHEN endpoint = 'model_infer' AND method <> 'POST' THEN 405 ELSE 200 END AS route_status
    FROM e
    """,
)
def classify_route_query(spark, folder):
    """Parts as models under their type; only ECONOMY is the model that serves."""
    size, model = F.col("p_size"), F.concat(F.lit("/v2/models/"), F.col("p_type"))
    df = table(spark, folder, "part").select(
        "p_partkey",
        F.when(size < 16, F.concat(model, F.lit("/infer")))
        .when(size < 32, F.concat(model, F.lit("/ready")))
        .when(size < 46, model)
        .when(F.col("p_brand") < "Brand#3", F.lit("/v2/health/live"))
        .otherwise(F.lit("/v2"))
        .alias("path"),
        F.when(F.col("p_retailprice") < 1000, "GET").otherwise("POST").alias("method"),
    )
    return http.classify_route(df, "ECONOMY", "1").select("p_partkey", "endpoint", "route_status")


@query(
    "p18_request_attributes",
    r"""
    WITH u AS (
      SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS host,
             regexp_extract(url, '://[^/]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q
      FROM pages)
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN
             'client.address=10.0.0.' || (page_id % 200) || '&http.request.body.size=' || octet_length(encode(html))
             || '&http.request.header.user-agent=probe&http.request.header.x-forwarded-for= 10.0.0.' || (page_id % 200)
             || ' , 10.1.1.1&http.request.method=GET&http.route=/' || page_id || '&network.peer.address=10.0.0.'
             || (page_id % 200) || '&url.full=&url.path=/' || page_id || '&url.scheme=http&user_agent.original=probe'
           ELSE
             'client.address=10.2.0.1&http.request.body.size=' || octet_length(encode(html))
             || '&http.request.header.user-agent=Probe&http.request.header.x-forwarded-port='
             || CASE WHEN page_id % 2 = 0 THEN 'x' ELSE '443' END
             || '&http.request.header.x-forwarded-proto=https&http.request.header.x-real-ip=10.2.0.1'
             || '&http.request.method=GET&http.route=/' || page_id || '&network.peer.address=10.2.0.1'
             || CASE WHEN page_id % 2 = 0 THEN '' ELSE '&network.peer.port=443' END
             || '&network.protocol.version=https&server.address=' || host
             || CASE WHEN page_id % 3 = 0 THEN '&server.port=8443' ELSE '' END
             || '&url.full=' || CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '(://[^/]+)', '\1:8443') ELSE url END
             || '&url.path=' || path || CASE WHEN q <> '' THEN '&url.query=' || q ELSE '' END
             || '&url.scheme=' || scheme || '&user_agent.original=Probe' END AS attributes
    FROM u
    """,
)
def request_attributes_query(spark, folder):
    page = F.col("page_id")
    plain = F.create_map(
        F.lit("user-agent"), F.lit("probe"),
        F.lit("X-Forwarded-For"), F.concat(F.lit(" 10.0.0."), page % 200, F.lit(" , 10.1.1.1")),
    )
    full = F.create_map(
        F.lit("User-Agent"), F.lit("Probe"),
        F.lit("X-Real-IP"), F.lit("10.2.0.1"),
        F.lit("X-Forwarded-Proto"), F.lit("https"),
        F.lit("X-Forwarded-Port"), F.when(page % 2 == 0, "x").otherwise("443"),
    )
    url = F.when(page % 3 == 0, F.regexp_replace("url", "(://[^/]+)", "$1:8443")).otherwise(F.col("url"))
    df = table(spark, folder, "pages").select(
        "page_id",
        F.lit("GET").alias("method"),
        F.when(page % 4 > 0, url).alias("url"),
        F.concat(F.lit("/"), page).alias("path"),
        F.when(page % 4 == 0, plain).otherwise(full).alias("headers"),
        F.col("html").cast("binary").alias("body"),
    )
    return metrics.request_attributes(df).select("page_id", map_text("attributes").alias("attributes"))


@query(
    "p19_response_attributes",
    """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN
             'http.response.body.size=' || octet_length(encode(text)) || '&http.response.body.value=' || md5(text)
             || '&http.response.status_code=200'
           ELSE
             CASE WHEN doc_id % 3 = 1 THEN 'http.response.body.size=' || octet_length(encode(text))
                    || '&http.response.body.value=' || md5(text) || '&' ELSE '' END
             || 'http.response.header.content-language=' || lang || '&http.response.status_code=' || (200 + doc_id % 3) END
             AS attributes
    FROM documents
    """,
)
def response_attributes_query(spark, folder):
    pick = F.col("doc_id") % 3
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.when(pick > 0, 200 + pick).cast("int").alias("status"),
        F.create_map(F.lit("Content-Language"), F.col("lang")).alias("response_headers"),
        F.when(pick == 2, F.lit("")).otherwise(F.col("text")).cast("binary").alias("response_body"),
    )
    told = metrics.response_attributes(df, content=True)
    value = "http.response.body.value"
    shown = F.transform_values(
        "response_attributes", lambda k, v: F.when(k == value, F.md5(v.cast("binary"))).otherwise(v)
    )
    return told.select("doc_id", map_text(shown).alias("attributes"))


@query(
    "p25_annotate_headers",
    f"""
    WITH {PHASES},
    spent AS (SELECT stream_id, sum(duration_ns) AS total FROM phases GROUP BY 1)
    SELECT stream_id, phase, CASE phase WHEN 4 THEN 'x-extproc-names' ELSE 'x-extproc-duration-ns' END AS name,
           CASE phase WHEN 4 THEN 'translate' ELSE CAST(CAST(total AS BIGINT) AS VARCHAR) END AS value,
           'APPEND_IF_EXISTS_OR_ADD' AS action
    FROM phases JOIN spent USING (stream_id) WHERE phase IN (4, 5)
    """,
)
def annotate_query(spark, folder):
    seen = phases(spark, folder)
    made = http.annotate_headers(seen, "translate", metrics.exchange_duration(seen))
    return made.select("stream_id", "phase", "name", F.col("raw_value").cast("string").alias("value"), "action")


@query(
    "n6_current_headers",
    f"""
    WITH {PHASES}
    SELECT stream_id, seq, phase, {plain_headers("headers")} AS headers
    FROM (SELECT p.stream_id, p.seq, p.phase,
                 (SELECT arg_max(h.headers, h.seq) FROM phases h
                  WHERE h.stream_id = p.stream_id AND h.headers IS NOT NULL AND h.seq <= p.seq) AS headers
          FROM phases p)
    """,
)
def current_headers_query(spark, folder):
    found = http.current_headers(phases(spark, folder))
    return found.select("stream_id", "seq", "phase", map_text("headers").alias("headers"))


@query(
    "j1_correlate",
    f"""
    WITH {PHASES}
    SELECT q.stream_id, q.ts_us AS request_us, r.ts_us AS response_us, r.stream_id IS NOT NULL AS answered
    FROM phases q LEFT JOIN phases r ON r.stream_id = q.stream_id AND r.phase = 4
    WHERE q.phase = 1
    """,
)
def correlate_query(spark, folder):
    seen = phases(spark, folder).select("stream_id", "phase", F.unix_micros("ts").alias("us"))
    side = lambda phase: seen.filter(F.col("phase") == phase).drop("phase")
    return joins.correlate(side(1), side(4))


@query(
    "a1_assemble_bodies",
    f"""
    SELECT CAST(doc_id AS VARCHAR) AS stream_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 5 END AS phase,
           CAST(octet_length(encode(text)) AS BIGINT) AS body_size, doc_id % 10 <> 3 AS complete, md5(text) AS body,
           1::BIGINT AS segments
    FROM documents
    """,
)
def assemble_query(spark, folder):
    return bodies.assemble_bodies(doc_chunks(spark, folder)).select(
        "stream_id", "phase", "body_size", "complete", digest("body").alias("body"), "segments"
    )


@query(
    "a1_assemble_bodies_segments",
    f"""
    WITH {DOC_CHUNKS}
    SELECT stream_id, phase, seq // 4 AS segment, CAST(min(seq) * {CHUNK} AS BIGINT) AS "offset",
           md5(unhex(string_agg(chunk_hex, '' ORDER BY seq))) AS body, count(*) OVER (PARTITION BY stream_id) AS segments
    FROM doc_chunks GROUP BY stream_id, phase, seq // 4
    """,
)
def assemble_segments_query(spark, folder):
    """Long bodies come in several rows; here a row is four chunks."""
    return bodies.assemble_bodies(doc_chunks(spark, folder), segment_bytes=4 * CHUNK).select(
        "stream_id", "phase", "segment", "offset", digest("body").alias("body"), "segments"
    )


@query(
    "a1_assemble_bodies_limited",
    f"""
    SELECT CAST(doc_id AS VARCHAR) AS stream_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 5 END AS phase,
           kept AS body_size,
           doc_id % 10 <> 3 AND (n <= 4000 OR (n % {CHUNK} > 0 AND n % {CHUNK} <= 4000 - {CHUNK} * 3)) AS complete,
           CASE WHEN n > 4000 AND NOT (n % {CHUNK} > 0 AND n % {CHUNK} <= 4000 - {CHUNK} * 3 AND n < {CHUNK} * 4)
                THEN 'appending chunk would violate size limit' END AS error
    FROM (SELECT doc_id, octet_length(encode(text)) AS n,
                 CAST(CASE WHEN n <= 4000 THEN n
                      WHEN n % {CHUNK} > 0 AND n % {CHUNK} <= 4000 - {CHUNK} * 3 THEN {CHUNK} * 3 + n % {CHUNK}
                      ELSE {CHUNK} * 3 END AS BIGINT) AS kept
          FROM documents)
    """,
)
def assemble_limited_query(spark, folder):
    limited = bodies.assemble_bodies(doc_chunks(spark, folder), max_size=4000)
    return limited.select("stream_id", "phase", "body_size", "complete", "error")


@query(
    "n4_running_bodies",
    f"""
    WITH {DOC_CHUNKS}
    SELECT stream_id, phase, seq, md5(unhex(chunk_hex)) AS unbuffered,
           CAST(sum(octet_length(unhex(chunk_hex))) OVER upto AS BIGINT) AS buffered_end,
           md5(unhex(string_agg(chunk_hex, '') OVER upto)) AS buffered
    FROM doc_chunks WINDOW upto AS (PARTITION BY stream_id, phase ORDER BY seq)
    """,
)
def running_bodies_query(spark, folder):
    """What a handler sees at each chunk: with buffering the body up to there, else the chunk."""
    chunks = doc_chunks(spark, folder)
    alone = chunks.select("stream_id", "phase", "seq", digest("chunk").alias("unbuffered"))
    so_far = bodies.prefix_digests(chunks).withColumnsRenamed({"body_end": "buffered_end", "digest": "buffered"})
    return alone.join(so_far, ["stream_id", "phase", "seq"])


@F.arrow_udf(T.BinaryType())
def _pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        packed = (gzip.compress(text.as_py().encode(), mtime=0) for text in texts)
        for some in bounded(packed, len):
            yield pa.array(some, pa.binary())


def _captured(bodies_):
    """Bodies as they were recorded, a table of their own: a capture is not packed anew by each reader."""
    path = scratch_path(bodies_.sparkSession, "captured")
    bodies_.write.parquet(path)
    return bodies_.sparkSession.read.schema(bodies_.schema).parquet(path)


@query(
    "b1_decode_bodies",
    """
    SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'br' WHEN doc_id % 5 = 4 THEN 'none' ELSE 'gzip' END AS encoding,
           CASE WHEN doc_id % 5 = 1 AND doc_id % 7 > 0 THEN 'unsupported encoding/compression strategy'
                WHEN doc_id % 5 <> 4 AND doc_id % 7 = 0 THEN 'cannot decompress an incomplete body'
                WHEN doc_id % 5 = 2 THEN 'gzip decompression failed' END AS decode_error,
           doc_id % 5 = 4 OR (doc_id % 5 IN (0, 3) AND doc_id % 7 > 0) AS decompressed,
           CASE WHEN doc_id % 5 IN (1, 2, 4) OR doc_id % 7 > 0 THEN md5(text) END AS body
    FROM documents
    """,
)
def decode_query(spark, folder):
    pick = F.col("doc_id") % 5
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.when(pick.isin(0, 3), _pack("text")).otherwise(F.col("text").cast("binary")).alias("body"),
        F.when(pick == 1, "br").when(pick == 4, "none").otherwise("gzip").alias("encoding"),
        (pick != 4).alias("compressed"),
        (F.col("doc_id") % 7 != 0).alias("complete"),
    )
    packed = pick.isin(0, 3) & ~F.col("decompressed")
    return bodies.decode_bodies(df).select(
        "doc_id", "encoding", "decode_error", "decompressed", F.when(~packed, digest("body")).alias("body")
    )


@query(
    "b1_decode_segments",
    f"""
    SELECT CAST(doc_id AS VARCHAR) AS stream_id, md5(text) AS body, bool_and(true) AS decompressed
    FROM documents GROUP BY doc_id, text
    """,
)
def decode_segments_query(spark, folder):
    """Gzip bodies in several segments, inflated and put together again."""
    packed = _captured(
        table(spark, folder, "documents").select(
            F.col("doc_id").cast("string").alias("stream_id"), F.lit(2).alias("phase"), _pack("text").alias("bytes")
        )
    )
    count = F.ceil(F.octet_length("bytes") / F.lit(64)).cast("long")
    chunks = packed.select(
        "stream_id", "phase", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("seq")
    ).select(
        "stream_id",
        "phase",
        "seq",
        F.substring(F.col("bytes"), (F.col("seq") * 64 + 1).cast("int"), F.lit(64)).alias("chunk"),
        ((F.col("seq") + 1) * 64 >= F.octet_length("bytes")).alias("end_of_stream"),
    )
    segments = bodies.assemble_bodies(chunks, segment_bytes=256).withColumns(
        {"encoding": F.lit("gzip"), "compressed": F.lit(True)}
    )
    return (
        bodies.decode_bodies(segments, piece_bytes=4096)
        .groupBy("stream_id")
        .agg(
            F.md5(F.expr("listagg(body) within group (order by struct(segment, piece))")).alias("body"),
            F.min("decompressed").alias("decompressed"),
        )
    )


def _shout(context, event):
    """Upper case for requests, a refusal for what is empty."""
    return event.body.upper() if event.body else context.Response(status_code=403)


@query(
    "body_path_all",
    """
    SELECT CAST(doc_id AS VARCHAR) AS stream_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 5 END AS phase,
           doc_id % 3 <> 1 AS decompressed,
           CASE WHEN doc_id % 3 = 1 THEN 'unsupported encoding/compression strategy' END AS decode_error,
           CASE WHEN octet_length(encode(text)) = 0 THEN 'immediate' ELSE 'replace' END AS decision,
           md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS body,
           octet_length(encode(text))::INTEGER AS content_length
    FROM documents
    """,
)
def body_path_all_query(spark, folder):
    """The whole way of every body: gzip, an encoding that is not known, and bodies that are not encoded."""
    return _body_path(table(spark, folder, "documents"))


def _body_path(documents):
    pick = F.col("doc_id") % 3
    packed = _captured(
        documents.select(
            F.col("doc_id").cast("string").alias("stream_id"),
            F.when(F.col("doc_id") % 2 == 0, 2).otherwise(5).alias("phase"),
            F.when(pick == 0, "gzip").when(pick == 1, "br").otherwise("none").alias("encoding"),
            F.when(pick == 0, _pack("text")).otherwise(F.col("text").cast("binary")).alias("bytes"),
        )
    )
    count = F.greatest(F.ceil(F.octet_length("bytes") / F.lit(CHUNK)), F.lit(1)).cast("long")
    chunks = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("at"), count.alias("n")).select(
        "stream_id",
        "phase",
        # chunks follow the messages that came before them in the exchange
        (F.col("at") + 250).alias("seq"),
        F.substring(F.col("bytes"), (F.col("at") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("chunk"),
        (F.col("at") == F.col("n") - 1).alias("end_of_stream"),
    )
    whole = bodies.assemble_bodies(chunks).join(packed.select("stream_id", "encoding"), "stream_id")
    opened = bodies.decode_bodies(whole.withColumn("compressed", F.col("encoding") != "none"))
    seen = opened.withColumns({"has_body": F.lit(True), "seq": F.col("segment"), "original": F.col("body")})
    decided = handlers.apply_operator(seen, _shout, "wrapprocessor")
    answered = http.replace_body(decided.withColumn("replacement", F.col("new_body")), body="original")
    return answered.select(
        "stream_id", "phase", "decompressed", "decode_error", "decision", digest("original").alias("body"), "content_length"
    )


@query(
    "b1_decode_report",
    """
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'gzip' ELSE 'none' END AS encoding,
           CASE WHEN doc_id % 2 = 0 THEN 'gzip decompression failed' ELSE 'ok' END AS outcome, count(*) AS bodies
    FROM documents GROUP BY ALL
    """,
)
def decode_report_query(spark, folder):
    df = table(spark, folder, "documents").select(
        F.col("text").cast("binary").alias("body"),
        F.when(F.col("doc_id") % 2 == 0, "gzip").otherwise("none").alias("encoding"),
        (F.col("doc_id") % 2 == 0).alias("compressed"),
        F.lit(True).alias("complete"),
    )
    return bodies.decode_report(bodies.decode_bodies(df))


@query(
    "a2_exchange_duration",
    f"""
    WITH {PHASES}
    SELECT stream_id, CAST(sum(duration_ns) AS BIGINT) AS duration_ns FROM phases
    GROUP BY 1 HAVING bool_or(phase = 5)
    """,
)
def exchange_duration_query(spark, folder):
    return metrics.exchange_duration(phases(spark, folder))


@query(
    "a7_stored_values",
    """
    SELECT user_id AS stream_id, event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2
    """,
)
def stored_values_query(spark, folder):
    ops = table(spark, folder, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_type").alias("name"), "value", F.col("event_id").alias("seq")
    )
    return metrics.stored_values(ops)


@query(
    "w5_exchange_state",
    f"""
    WITH {PHASES},
    closed AS (
      SELECT stream_id, bool_or(phase = 5) AS ended, count(*) AS messages,
             CAST(sum(duration_ns) AS BIGINT) AS duration_ns, max(CASE WHEN phase = 1 THEN headers END) AS request_headers,
             max(CASE WHEN phase = 4 THEN headers END) AS response_headers,
             max(CASE WHEN phase = 2 THEN body END) AS request, max(CASE WHEN phase = 5 THEN body END) AS response,
             bool_or(phase IN (1, 2) AND end_of_stream) AS request_complete
      FROM phases GROUP BY 1)
    SELECT stream_id, CASE WHEN ended THEN 'ended' ELSE 'timeout' END AS outcome,
           {plain_headers("request_headers")} AS request_headers, {plain_headers("response_headers")} AS response_headers,
           md5(coalesce(request, '')) AS request_body, md5(coalesce(response, '')) AS response_body,
           request_complete, ended AS response_complete, messages, duration_ns
    FROM closed
    """,
)
def exchange_state_query(spark, folder):
    """All exchanges from a stream: ended, or a minute without a message."""
    seen = phases(spark, folder)
    columns = ("stream_id", "seq", "phase", "headers", "end_of_stream", "ts", "duration_ns")
    closed = run_table_as_stream(
        seen.select(*columns),
        lambda stream: exchange_state(stream, "1 minute", "1 second"),
        "exchanges",
        ("1 minute", "1 second"),
        settings=KEYED_STATE,
    )
    return with_bodies(closed, seen).select(
        "stream_id",
        "outcome",
        map_text("request_headers").alias("request_headers"),
        map_text("response_headers").alias("response_headers"),
        digest("request_body").alias("request_body"),
        digest("response_body").alias("response_body"),
        "request_complete",
        "response_complete",
        "messages",
        "duration_ns",
    )


def _phase_handler(context, event):
    """Marks request and response bodies; refuses what a system turn asks for."""
    if event.phase == 1:
        return context.Response(body="refused", status_code=200, headers={"X-Processing-Status": "403"})
    suffix = " - preprocessed" if event.phase == 2 else " - postprocessed"
    return event.body.decode("utf-8") + suffix


def _operator_query(mode):
    acts = {
        "preprocessor": "phase IN (1, 2)",
        "postprocessor": "phase = 5",
        "wrapprocessor": "phase IN (1, 2, 5)",
        "observeprocessor": "false",
    }[mode]

    @query(
        f"u4_apply_operator_{mode}",
        f"""
        WITH {PHASES}
        SELECT stream_id, seq, phase,
               CASE WHEN NOT ({acts}) THEN 'continue' WHEN phase = 1 THEN CASE WHEN end_of_stream THEN 'immediate' ELSE 'continue' END
                    ELSE 'replace' END AS decision,
               CASE WHEN ({acts}) AND phase = 1 AND end_of_stream THEN 403 END AS immediate_status,
               md5(CASE WHEN ({acts}) AND phase = 2 THEN body || ' - preprocessed'
                        WHEN ({acts}) AND phase = 5 THEN body || ' - postprocessed' ELSE body END) AS new_body
        FROM phases
        """,
    )
    def run(spark, folder):
        seen = http.has_body(phases(spark, folder)).withColumnRenamed("chunk", "body")
        decided = handlers.apply_operator(seen, _phase_handler, mode)
        return decided.select(
            "stream_id", "seq", "phase", "decision", "immediate_status", digest("new_body").alias("new_body")
        )

    return run


for _mode in ("preprocessor", "postprocessor", "wrapprocessor", "observeprocessor"):
    _operator_query(_mode)
