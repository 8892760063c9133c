"""The same queries as SQL for an independent engine, written from their meaning.

Where Spark compares hashes, the SQL compares whole rows (``EXCEPT ALL``, full
joins), so a match also shows that no difference was missed.
"""

from __future__ import annotations

from itertools import combinations

from .queries import (FOREIGN_KEYS, INDEXES, LINEITEM_CHUNKS, ORDER_CHILDREN, PRIMARY_KEYS, TABLES, YEARS)

# Schemas of the given tables as (column, Spark type).
SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}

def _double_text(x: str) -> str:
    """Four decimals where they are the same number, else hex digits; NULL is a backslash and N."""
    x = f"CAST({x} AS DOUBLE)"
    fixed = f"CAST(CASE WHEN abs({x}) < 1e11 THEN {x} END AS DECIMAL(18,4))"
    return (f"CASE WHEN {x} IS NULL THEN '\\N' WHEN CAST({fixed} AS DOUBLE) = {x} THEN CAST({fixed} AS VARCHAR) "
            f"ELSE replace(format('{{:a}}', {x}), 'p+', 'p') END")


PRICE_BUMP = "CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"
FAULTY_ORDERS = f"""(SELECT o_orderkey, o_custkey, o_orderstatus, {PRICE_BUMP} AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 211 = 0)"""
REPRICED_ORDERS = f"""(SELECT o_orderkey, o_custkey, o_orderstatus, {PRICE_BUMP} AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders)"""
FAULTY_LINEITEM = """(SELECT * FROM lineitem WHERE l_orderkey % 700 <> 0
  UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 500 = 0)"""
NULL_EVENTS = """(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 13 <> 0 THEN value END AS value, props
  FROM events)"""


def _row_text(columns) -> str:
    parts = []
    for name, kind in columns:
        text = f"CAST({name} AS VARCHAR)"
        if kind == "string":
            text = rf"replace(replace({name}, '\', '\\'), '|', '\|')"
        parts.append(rf"coalesce({text}, '\N')")
    return "concat_ws('|', " + ", ".join(parts) + ")"


def _sample_hash(relation: str, columns, key: str) -> str:
    return (f"(SELECT sha256(string_agg(t, chr(10) ORDER BY k)) FROM (SELECT {key} AS k, {_row_text(columns)} AS t "
            f"FROM {relation} q ORDER BY k LIMIT 50))")


def _row_diff(source: str, target: str, columns, key: str) -> str:
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c, _ in columns)
    return f"""SELECT coalesce(s.{key}, t.{key}) AS {key},
      CASE WHEN t.{key} IS NULL THEN 'missing_in_target' WHEN s.{key} IS NULL THEN 'missing_in_source'
           ELSE 'changed' END AS status
      FROM {source} s FULL JOIN {target} t ON s.{key} = t.{key}
      WHERE s.{key} IS NULL OR t.{key} IS NULL OR NOT ({same})"""


def _equal(a: str, b: str) -> str:
    return f"(NOT EXISTS ({a} EXCEPT ALL {b}) AND NOT EXISTS ({b} EXCEPT ALL {a}))"


def _verify_line(name: str, target: str) -> str:
    order = ", ".join([*PRIMARY_KEYS[name], *[c for c, _ in SCHEMAS[name] if c not in PRIMARY_KEYS[name]]])
    rows_equal = _equal(f"SELECT * FROM {name}", f"SELECT * FROM {target} q1")
    sample_equal = _equal(f"(SELECT * FROM {name} ORDER BY {order} LIMIT 50)",
                          f"(SELECT * FROM {target} q2 ORDER BY {order} LIMIT 50)")
    return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS source_rows,
      (SELECT count(*) FROM {target} q0) AS target_rows, {sample_equal} AS sample_ok, {rows_equal} AS content_ok, CAST(NULL AS VARCHAR) AS error"""


_VERIFY = "\nUNION ALL ".join(
    _verify_line(t, {"orders": FAULTY_ORDERS, "events": NULL_EVENTS}.get(t, t)) for t in TABLES)
VERIFY_TABLES = f"""SELECT *, source_rows = target_rows AS count_ok,
  source_rows = target_rows AND sample_ok AND content_ok AS ok FROM ({_VERIFY})"""

# --- catalogs -------------------------------------------------------------------

TARGET_RELATIONS = {
    **{t: t for t in TABLES if t != "region"},
    "legacy_supplier": "supplier",
    "customer": "(SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer)",
    "orders": "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CAST(NULL AS VARCHAR) AS o_note FROM orders)",
    "events": NULL_EVENTS,
    "documents": "(SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 100 = 0)",
}
TARGET_SCHEMAS = {
    **{t: SCHEMAS[t] for t in TABLES if t != "region"},
    "legacy_supplier": SCHEMAS["supplier"],
    "customer": [(c, "string" if c == "c_acctbal" else k) for c, k in SCHEMAS["customer"]],
    "orders": [*[x for x in SCHEMAS["orders"] if x[0] != "o_orderpriority"], ("o_note", "string")],
}
TARGET_KEYS = {**{t: PRIMARY_KEYS[t] for t in TABLES if t != "region"}, "legacy_supplier": PRIMARY_KEYS["supplier"]}


def _columns(relations: dict[str, str], schemas) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{kind}' AS type, "
        f"count({c}) = count(*) AS not_null, count(*) AS row_count FROM {relations[t]} q"
        for t in relations for i, (c, kind) in enumerate(schemas[t], 1))


def _tables(relations: dict[str, str], keys, children, foreign_keys, indexes) -> str:
    """One line per table; the declared key counts only if no key repeats or is NULL."""
    out = []
    for t, rel in relations.items():
        key = ",".join(keys[t])
        if keys[t]:
            nulls = " OR ".join(f"{k} IS NULL" for k in keys[t])
            bad = f"EXISTS (SELECT 1 FROM {rel} q GROUP BY {key} HAVING count(*) > 1 OR bool_or({nulls}))"
            key_sql = f"CASE WHEN {bad} THEN '' ELSE '{key}' END"
        else:
            key_sql = "''"
        out.append(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {rel} q) AS row_count, {key_sql} AS primary_key, "
                   f"'{','.join(sorted(children.get(t, ())))}' AS children, "
                   f"'{';'.join(sorted(foreign_keys.get(t, ())))}' AS foreign_keys, "
                   f"'{';'.join(sorted(indexes.get(t, ())))}' AS indexes")
    return "\nUNION ALL ".join(out)


_SOURCE_RELATIONS = {t: t for t in TABLES}
_CATALOGS = f"""sc AS ({_columns(_SOURCE_RELATIONS, SCHEMAS)}),
tc AS ({_columns(TARGET_RELATIONS, TARGET_SCHEMAS)}),
st AS ({_tables(_SOURCE_RELATIONS, PRIMARY_KEYS, {'orders': ORDER_CHILDREN}, FOREIGN_KEYS, INDEXES)}),
tt AS ({_tables(TARGET_RELATIONS, TARGET_KEYS, {'orders': ORDER_CHILDREN[:-1]},
                {**FOREIGN_KEYS, 'lineitem': FOREIGN_KEYS['lineitem'][:1]}, {**INDEXES, 'part': ('INDEX (p_brand)',)})}),
cd AS (SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.column_name, t.column_name) AS column_name,
  CASE WHEN s.table_name IS NULL THEN 'added' WHEN t.table_name IS NULL THEN 'removed' ELSE
    concat_ws(',', CASE WHEN s.type <> t.type THEN 'type' END, CASE WHEN s.not_null <> t.not_null THEN 'nullability' END,
      CASE WHEN s.position <> t.position THEN 'position' END) END AS drift
  FROM (SELECT * FROM sc WHERE table_name IN (SELECT table_name FROM tt)) s
  FULL JOIN (SELECT * FROM tc WHERE table_name IN (SELECT table_name FROM st)) t
    ON s.table_name = t.table_name AND s.column_name = t.column_name),
parts AS (SELECT coalesce(s.table_name, t.table_name) AS table_name,
  s.table_name IS NOT NULL AS in_source, t.table_name IS NOT NULL AS in_target,
  s.row_count AS source_rows, t.row_count AS target_rows,
  concat_ws(',', CASE WHEN s.table_name IN (SELECT table_name FROM cd WHERE drift <> '') THEN 'columns' END,
    CASE WHEN s.primary_key <> t.primary_key THEN 'primary_key' END,
    CASE WHEN s.children <> t.children THEN 'partition_layout' END) AS structural_drift,
  concat_ws(',', CASE WHEN s.indexes <> t.indexes THEN 'indexes' END,
    CASE WHEN s.foreign_keys <> t.foreign_keys THEN 'foreign_keys' END) AS auxiliary_drift
  FROM st s FULL JOIN tt t ON s.table_name = t.table_name),
drift AS (SELECT table_name, CASE WHEN NOT in_target THEN 'missing_in_target' WHEN NOT in_source THEN 'missing_in_source'
    WHEN structural_drift <> '' OR auxiliary_drift <> '' THEN 'metadata_diff' ELSE 'metadata_match' END AS status,
  in_source AND structural_drift = '' AS compatible, structural_drift, auxiliary_drift, source_rows, target_rows FROM parts)
"""
# the tables have no column with one of the known timestamp names but events.ts
_CHUNKABLE = "type IN ('int', 'bigint', 'timestamp_ntz')"
_CHUNK_COLUMN = f"""(SELECT st.table_name, (SELECT column_name FROM (
    SELECT column_name, CASE WHEN st.table_name = 'orders' AND column_name = 'o_orderdate' THEN 1
      WHEN column_name = 'ts' THEN 2
      WHEN list_contains(string_split(st.primary_key, ','), column_name) THEN 3
      WHEN column_name LIKE '%\\_id' ESCAPE '\\' THEN 4 END AS prio, position
    FROM sc WHERE sc.table_name = st.table_name AND {_CHUNKABLE})
  WHERE prio IS NOT NULL ORDER BY prio, position LIMIT 1) AS chunk_column FROM st)"""


def _action(mode: str) -> str:
    return f"""CASE WHEN status = 'missing_in_source' THEN 'manual_review'
    WHEN {mode} = 'plan_only' THEN CASE WHEN status = 'missing_in_target' THEN 'copy'
      WHEN status = 'metadata_diff' AND NOT compatible THEN 'manual_review' ELSE 'skip' END
    WHEN {mode} = 'missing_only' THEN CASE WHEN status = 'missing_in_target' THEN 'copy' ELSE 'skip' END
    WHEN {mode} = 'metadata_diff_only' THEN CASE WHEN status = 'metadata_match' THEN 'skip'
      WHEN status = 'missing_in_target' THEN 'copy' WHEN NOT compatible THEN 'manual_review'
      WHEN auxiliary_drift <> '' THEN 'sync_metadata' ELSE 'copy' END
    WHEN compatible OR status = 'missing_in_target' THEN 'copy' ELSE 'manual_review' END"""


READINESS = f"""WITH {_CATALOGS},
base AS (SELECT d.*, st.row_count, st.primary_key, d.table_name = 'orders' AS partitioned,
    CASE WHEN d.table_name = 'lineitem' THEN 'l_orderkey' ELSE c.chunk_column END AS chunk_column
  FROM st JOIN drift d ON d.table_name = st.table_name JOIN {_CHUNK_COLUMN} c ON c.table_name = st.table_name),
chunked AS (SELECT *, CAST(CASE WHEN chunk_column IS NULL OR row_count <= 25000 THEN 1
    ELSE greatest(2, least(16, row_count // 25000 + 1)) END AS INTEGER) AS chunk_count FROM base),
reasons AS (SELECT *, list_filter([
    CASE WHEN row_count >= 50000 THEN 'large row volume' END,
    CASE WHEN row_count >= 10000 AND row_count < 50000 THEN 'moderate row volume' END,
    CASE WHEN primary_key = '' THEN 'missing primary key' END,
    CASE WHEN structural_drift <> '' THEN 'structural metadata drift' END,
    CASE WHEN auxiliary_drift <> '' THEN 'index or foreign key drift' END,
    CASE WHEN partitioned THEN 'partitioned table' END,
    CASE WHEN row_count >= 50000 AND chunk_column IS NULL AND NOT partitioned
         THEN 'large table without a safe chunk column' END], lambda x: x IS NOT NULL) AS r,
    CAST(least(100, CASE WHEN row_count >= 50000 THEN 30 WHEN row_count >= 10000 THEN 15 ELSE 0 END
      + CASE WHEN primary_key = '' THEN 25 ELSE 0 END + CASE WHEN structural_drift <> '' THEN 30 ELSE 0 END
      + CASE WHEN auxiliary_drift <> '' THEN 10 ELSE 0 END + CASE WHEN partitioned THEN 10 ELSE 0 END
      + CASE WHEN row_count >= 50000 AND chunk_column IS NULL AND NOT partitioned THEN 20 ELSE 0 END) AS INTEGER) AS risk_score,
    CASE WHEN partitioned THEN 'partition_wise_copy' WHEN chunk_count > 1 THEN 'chunked_copy' ELSE 'full_copy' END AS strategy,
    {_action("'safe_sync'")} AS action FROM chunked),
report AS (SELECT table_name, status, row_count, action, strategy, chunk_column, chunk_count,
    least(chunk_count, 4) AS concurrency,
    CASE WHEN row_count <= 10000 OR risk_score >= 60 THEN 'rowcount_and_sample_hash' ELSE 'rowcount' END AS depth,
    risk_score, CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS risk_level,
    array_to_string(list_concat(r, list_filter([
      CASE WHEN status = 'missing_in_target' THEN 'table is missing in target' END,
      CASE WHEN structural_drift <> '' THEN 'structural drift must be reviewed before execution' END],
      lambda x: x IS NOT NULL)), '; ') AS warnings,
    action = 'manual_review' AS manual_review,
    concat_ws(', ', 'action=' || action, 'strategy=' || strategy, 'risk=' || risk_score, 'chunk_column=' || chunk_column)
      AS rationale FROM reasons)
"""

# --- seeds ------------------------------------------------------------------------


def _draw(id_: str, label: str, below: str) -> str:
    return f"(CAST('0x' || substr(md5('{label}:' || CAST({id_} AS VARCHAR)), 1, 15) AS BIGINT) % {below})"


def _spread(id_: str, label: str, days: int) -> str:
    return f"TIMESTAMP '2026-01-01 00:00:00' + to_seconds({_draw(id_, label, str(days * 86400))})"


_RAND_JSON = "'{\"source\":\"seed\",\"rand\":' || CAST(" + "{draw}" + " AS VARCHAR) || '}'"
_CUSTOMERS = "(SELECT count(*) FROM customer)"
_PROFILE = []
for _t in ("orders", "customer"):
    for _i, (_c, _k) in enumerate(SCHEMAS[_t], 1):
        _PROFILE.append(f"""SELECT '{_t}' AS table_name, '{_c}' AS column_name, {_i} AS position, '{_k}' AS type,
  count(*) AS row_count, count(*) - count({_c}) AS null_count, count(DISTINCT {_c}) AS distinct_count,
  CAST(min({_c}) AS VARCHAR) AS min_text, CAST(max({_c}) AS VARCHAR) AS max_text FROM {_t}""")
_ORDER_COLUMNS = ", ".join(c for c, _ in SCHEMAS["orders"])
_LINE_COLUMNS = ", ".join(c for c, _ in SCHEMAS["lineitem"])
_CHANGED_VALUES = "\nUNION ALL ".join(
    f"""SELECT s.o_orderkey, '{c}' AS column_name, CAST(s.{c} AS VARCHAR) AS source_value, CAST(t.{c} AS VARCHAR) AS target_value
  FROM orders s JOIN {FAULTY_ORDERS} t ON s.o_orderkey = t.o_orderkey WHERE s.{c} IS DISTINCT FROM t.{c}"""
    for c, _ in SCHEMAS["orders"] if c != "o_orderkey")
_COLUMN_DIFF = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, (SELECT count(*) FROM orders) AS source_rows,
  (SELECT count(*) FROM {REPRICED_ORDERS} q) AS target_rows,
  {_equal(f'SELECT {c} FROM orders', f'SELECT {c} FROM {REPRICED_ORDERS} q')} AS same"""
    for c, _ in SCHEMAS["orders"])
_CHUNKS = f"""SELECT CAST(least((l_orderkey - lo) * {LINEITEM_CHUNKS} // (hi - lo + 1), {LINEITEM_CHUNKS - 1}) AS INTEGER) AS chunk,
  count(*) AS row_count, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key
  FROM lineitem, (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem) GROUP BY 1"""
_CHILD = "CASE " + " ".join(
    f"WHEN o_orderdate >= TIMESTAMP '{lo:%Y-%m-%d}' AND o_orderdate < TIMESTAMP '{hi:%Y-%m-%d}' THEN '{n}'"
    for n, lo, hi in YEARS) + " END"
_CUSTOMER_CSV = " + ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)), 0)" for c, _ in SCHEMAS["customer"])
_SEQUENCES = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, coalesce(max({PRIMARY_KEYS[t][0]}), 0) AS mx FROM {t}"
    for t in ("customer", "orders", "part", "supplier", "events"))
_COUNTS = "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)

ORACLE_SQL = {
    "scan_customer": "SELECT * FROM customer",
    "filter_part": """SELECT p_partkey, p_type, p_name FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')
        AND p_type NOT LIKE 'S%' AND p_type <> 'PROMO' AND p_size >= 5 AND p_type IS NOT NULL
        AND (p_name LIKE 'red%' OR NOT ends_with(p_name, 'bolt'))""",
    "chunked_copy_lineitem": _CHUNKS,
    "chunk_ranges_lineitem": _CHUNKS,
    "csv_roundtrip_documents": "SELECT * FROM documents",
    "copy_full_orders": "SELECT * FROM orders",
    "copy_append_customer": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "copy_partition_wise_orders": f"""SELECT CAST(year AS INTEGER) AS year, count(*) AS row_count FROM (
        SELECT year(o_orderdate) AS year FROM {FAULTY_ORDERS} q WHERE year(o_orderdate) <> 1996
        UNION ALL SELECT year(o_orderdate) FROM orders WHERE year(o_orderdate) = 1996) GROUP BY 1""",
    "copy_stats_customer": f"""SELECT count(*) AS row_count,
        CAST(sum({_CUSTOMER_CSV} + {len(SCHEMAS['customer'])}) AS BIGINT) AS csv_bytes FROM customer""",
    "conform_customer": "SELECT * FROM customer",
    "sync_missing_orders": f"""SELECT * FROM {FAULTY_ORDERS} q UNION ALL SELECT * FROM orders
        WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {FAULTY_ORDERS} q)""",
    "catalog_declared_columns": f"SELECT table_name, position, column_name, type FROM ({_columns(_SOURCE_RELATIONS, SCHEMAS)}) q",
    "chunked_copy_content_lineitem": "SELECT * FROM lineitem",
    "partition_copy_content_orders": f"""SELECT * FROM {FAULTY_ORDERS} q WHERE o_orderstatus NOT IN ('O', 'P')
        UNION ALL SELECT * FROM orders WHERE coalesce(o_orderstatus, 'P') IN ('O', 'P')""",
    "route_open_orders": """SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'before'
        WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'year_1997'
        WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'after' ELSE 'other' END AS child, count(*) AS row_count FROM orders GROUP BY 1""",
    "route_list_hash_orders": """SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' OR o_orderstatus IS NULL THEN 'open'
        ELSE 'rest' END AS child, count(*) AS row_count, count(*) AS hashed_rows, CAST(0 AS BIGINT) AS split_keys FROM orders GROUP BY 1""",
    "clustered_ranges_lineitem": "SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS overlapping_files FROM lineitem",
    "hilbert_lineitem": """SELECT unnest(['l_shipdate', 'l_partkey']) AS column_name, count(*) AS row_count,
        unnest([false, true]) AS fewer_overlaps FROM lineitem""",
    "fingerprint_doubles_lineitem": f"""SELECT l_returnflag, count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', l_returnflag,
        CAST(l_orderkey AS VARCHAR), {', '.join(map(_double_text, ('l_extendedprice', 'l_extendedprice * 1e9', '-l_discount / 777', 'l_tax * 1e-30',
                                                                   'CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 3 END')))}
        )), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM lineitem GROUP BY 1""",
    "fingerprint_lineitem": """SELECT l_linestatus, count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR),
        replace(replace(l_linestatus, '\\', '\\\\'), '|', '\\|'), CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR),
        CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(l_shipdate AS VARCHAR))), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
        FROM lineitem GROUP BY 1""",
    "catalog_columns": _columns(_SOURCE_RELATIONS, SCHEMAS),
    "seed_users": f"""SELECT c_custkey + 1 AS user_id, 'user' || (c_custkey + 1) || '@example.com' AS email,
        {_spread('c_custkey + 1', 'joined', 30)} AS created_at FROM customer""",
    "seed_orders": f"""SELECT o_orderkey + 1 AS order_id, {_draw('o_orderkey + 1', 'user', _CUSTOMERS)} + 1 AS user_id,
        CAST(CAST({_draw('o_orderkey + 1', 'amount', '50001')} AS DECIMAL(12,2)) / 100 AS DECIMAL(10,2)) AS amount_usd,
        ['created', 'paid', 'shipped', 'refunded'][{_draw('o_orderkey + 1', 'status', '4')} + 1] AS status,
        {_spread('o_orderkey + 1', 'ordered', 50)} AS created_at,
        {_RAND_JSON.replace('{draw}', _draw('o_orderkey + 1', 'rand', '1000000'))} AS payload FROM orders""",
    "seed_events": f"""SELECT event_id + 1 AS event_id, {_draw('event_id + 1', 'user', _CUSTOMERS)} + 1 AS user_id,
        ['page_view', 'click', 'purchase', 'logout'][{_draw('event_id + 1', 'type', '4')} + 1] AS event_type,
        {_spread('event_id + 1', 'at', 50)} AS event_ts,
        {_RAND_JSON.replace('{draw}', _draw('event_id + 1', 'rand', '1000000'))} AS payload FROM events""",
    "join_star_lineitem": """SELECT n_name, c_mktsegment, count(*) AS line_count,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "left_join_documents_labels": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "anti_join_documents_labels":
        "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "posexplode_embeddings": """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DECIMAL(18,6)) AS value
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "self_join_conversations": """SELECT a.conv_id, a.turn, a.role, b.role AS next_role FROM conversations a
        LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "semi_join_orders":
        "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "distinct_union_nations": "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_parties": """SELECT c_custkey AS party_key, c_name AS party_name, c_acctbal AS balance, 'customer' AS kind FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier""",
    "row_diff_orders": _row_diff("orders", FAULTY_ORDERS, SCHEMAS["orders"], "o_orderkey"),
    "row_diff_chunked_orders": _row_diff("orders", REPRICED_ORDERS, SCHEMAS["orders"], "o_orderkey"),
    "row_diff_values_orders": _CHANGED_VALUES,
    "bag_diff_lineitem": f"""SELECT 'source_only' AS side, count(*) AS row_count FROM
        (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM {FAULTY_LINEITEM} q) HAVING count(*) > 0
        UNION ALL SELECT 'target_only', count(*) FROM
        (SELECT * FROM {FAULTY_LINEITEM} q EXCEPT ALL SELECT * FROM lineitem) HAVING count(*) > 0""",
    "bag_diff_rows_lineitem": f"""SELECT *, 'source_only' AS side, count(*) AS row_count FROM
        (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM {FAULTY_LINEITEM} q) GROUP BY ALL
        UNION ALL SELECT *, 'target_only', count(*) FROM
        (SELECT * FROM {FAULTY_LINEITEM} q EXCEPT ALL SELECT * FROM lineitem) GROUP BY ALL""",
    "fk_orphans_orders": """SELECT * FROM orders WHERE o_custkey IS NOT NULL
        AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)""",
    "fk_orphan_keys_orders": """SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL
        AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) GROUP BY 1""",
    "mv_events_by_type": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "profile_columns": "\nUNION ALL ".join(_PROFILE),
    "profile_tables": _COUNTS,
    "profile_partitions_orders": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS row_count,
        min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(DISTINCT o_custkey) AS distinct_values
        FROM orders GROUP BY 1""",
    "sample_rows_events": "SELECT * FROM events ORDER BY event_id LIMIT 50",
    "sample_hash_events": f"SELECT {_sample_hash('events', SCHEMAS['events'], 'event_id')} AS sample_hash",
    "fingerprint_events": f"""SELECT count(*) AS row_count,
        CAST(sum(CAST('0x' || substr(md5({_row_text(SCHEMAS['events'])}), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
        FROM {NULL_EVENTS} q""",
    "verify_orders": f"""SELECT *, source_rows = target_rows AS count_ok, source_sample_hash = target_sample_hash AS sample_ok,
        source_rows = target_rows AND source_sample_hash = target_sample_hash AND content_ok AS ok FROM (
        SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows,
        (SELECT count(*) FROM {FAULTY_ORDERS} q) AS target_rows,
        {_sample_hash('orders', SCHEMAS['orders'], 'o_orderkey')} AS source_sample_hash,
        {_sample_hash(FAULTY_ORDERS, SCHEMAS['orders'], 'o_orderkey')} AS target_sample_hash,
        {_equal('SELECT * FROM orders', f'SELECT * FROM {FAULTY_ORDERS} q')} AS content_ok, CAST(NULL AS VARCHAR) AS error)""",
    "verify_tables": VERIFY_TABLES,
    "verify_summary": f"""SELECT bool_and(ok) AS ok, count(*) AS tables_checked,
        count(*) FILTER (WHERE NOT ok) AS failed_tables,
        coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (WHERE NOT ok), '') AS failed
        FROM ({VERIFY_TABLES})""",
    "verify_keys": "\nUNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{','.join(k)}' AS key, count(*) AS broken_keys, count(*) = 0 AS ok FROM (
        SELECT 1 FROM {t} GROUP BY {','.join(k)} HAVING count(*) > 1 OR {' OR '.join(f'{c} IS NULL' for c in k)})"""
        for t, k in {**PRIMARY_KEYS, "lineitem": ("l_orderkey", "l_linenumber")}.items()),
    "verify_mv_events": """SELECT event_type, 'changed' AS status, CAST(1 AS BIGINT) AS source_rows,
        CAST(1 AS BIGINT) AS target_rows FROM events WHERE event_type = 'click' GROUP BY 1""",
    "chunk_diff_orders": f"""WITH s AS (SELECT o_orderkey // 1000 AS chunk, * FROM orders),
        t AS (SELECT o_orderkey // 1000 AS chunk, * FROM {FAULTY_ORDERS} q),
        bad AS (SELECT chunk FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t)
                UNION SELECT chunk FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s))
        SELECT chunk, (SELECT count(*) FROM s WHERE s.chunk = bad.chunk) AS source_rows,
        (SELECT count(*) FROM t WHERE t.chunk = bad.chunk) AS target_rows FROM bad""",
    "column_diff_orders": _COLUMN_DIFF,
    "check_not_null_events": "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {NULL_EVENTS} q" for c, _ in SCHEMAS["events"]),
    "pk_duplicates_lineitem": """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2
        HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "unique_documents_text": """SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text IS NOT NULL
        GROUP BY 1 HAVING count(*) > 1""",
    "fill_defaults_orders": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
        '3-MEDIUM' AS o_orderpriority FROM orders""",
    "dedupe_lineitem": f"""SELECT {_LINE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
        AS rn FROM lineitem) WHERE rn = 1""",
    "dedupe_resent_orders": "SELECT * FROM orders",
    "range_route_orders": f"""SELECT child, count(*) AS row_count FROM (SELECT {_CHILD} AS child FROM orders)
        WHERE child IS NOT NULL GROUP BY 1""",
    "unrouted_orders": f"SELECT * FROM orders WHERE {_CHILD} IS NULL",
    "sequence_sync": f"""SELECT table_name, CASE WHEN mx > 0 THEN mx ELSE 1 END AS last_value, mx > 0 AS is_called,
        CASE WHEN mx > 0 THEN mx + 1 ELSE 1 END AS next_value FROM ({_SEQUENCES})""",
    "assign_keys_customer": """SELECT c_custkey, (SELECT max(c_custkey) FROM customer)
        + row_number() OVER (ORDER BY c_custkey) AS new_id FROM customer""",
    "clustered_lineitem": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS row_count FROM lineitem GROUP BY 1",
    "udf_is_paid": "SELECT o_orderkey, o_orderstatus = 'F' AS paid FROM orders",
    "scalar_text_part": r"""SELECT p_partkey, lower(trim('  ' || p_type || ' ')) AS type_low,
        CAST(regexp_extract(p_brand, '#(\d+)', 1) AS INTEGER) AS brand_no,
        '"' || replace(p_type, '"', '""') || '"."' || replace(p_name, '"', '""') || '"' AS qualified,
        'parts' AS schema_part, replace(p_name, ' ', '.') AS table_part,
        replace(p_brand, '#', '_') || '_seq' AS sequence_name, true AS is_serial,
        CAST(least(greatest(p_size // 7, 2), 6) AS INTEGER) AS clamped FROM part""",
    "json_payload_events": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "schema_drift": f"WITH {_CATALOGS} SELECT * FROM drift",
    "column_drift": f"WITH {_CATALOGS} SELECT * FROM cd WHERE drift <> ''",
    "drift_summary": f"""WITH {_CATALOGS} SELECT
        count(*) FILTER (WHERE status <> 'missing_in_source') AS source_tables,
        count(*) FILTER (WHERE status <> 'missing_in_target') AS target_tables,
        count(*) FILTER (WHERE status = 'missing_in_target') AS missing_in_target,
        count(*) FILTER (WHERE status = 'missing_in_source') AS missing_in_source,
        count(*) FILTER (WHERE status = 'metadata_match') AS metadata_match,
        count(*) FILTER (WHERE status = 'metadata_diff') AS metadata_diff,
        CASE WHEN missing_in_source > 0 THEN 'Target contains ' || missing_in_source ||
          ' table(s) not present in source.' END AS warning FROM drift""",
    "chunk_column": f"""WITH {_CATALOGS} SELECT st.table_name, st.row_count, c.chunk_column
        FROM st JOIN {_CHUNK_COLUMN} c ON c.table_name = st.table_name""",
    "readiness": f"{READINESS} SELECT * FROM report",
    "readiness_by_mode": f"""WITH {_CATALOGS} SELECT table_name, mode, {_action('mode')} AS action FROM (
        SELECT *, unnest(['plan_only', 'missing_only', 'metadata_diff_only', 'data_diff_only', 'full_refresh',
        'safe_sync']) AS mode FROM drift)""",
    "readiness_summary": f"""{READINESS} SELECT count(*) FILTER (WHERE action = 'copy') AS to_copy,
        count(*) FILTER (WHERE action = 'sync_metadata') AS to_sync_metadata,
        count(*) FILTER (WHERE action = 'manual_review') AS to_review, count(*) FILTER (WHERE action = 'skip') AS skipped,
        coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (WHERE manual_review), '') AS review_tables,
        coalesce(string_agg(table_name, ',' ORDER BY table_name)
          FILTER (WHERE manual_review AND status = 'metadata_diff'), '') AS blocked_overwrites FROM report""",
    "run_summary_events": """WITH final AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN NULL
          ELSE event_type <> 'error' OR event_id % 2 = 0 END AS ok,
          CAST(value AS DECIMAL(18,2)) * CASE WHEN event_type = 'signup' THEN 0
            WHEN event_type = 'error' AND event_id % 2 = 0 THEN 2 ELSE 1 END AS elapsed FROM events)
        SELECT user_id AS run_id, count(*) AS total_steps, count(*) FILTER (WHERE ok) AS ok_steps,
        count(*) FILTER (WHERE NOT ok) AS failed_steps, count(*) FILTER (WHERE ok IS NULL) AS skipped_steps,
        CAST(sum(elapsed) AS DECIMAL(18,2)) AS elapsed_s, failed_steps = 0 AS success,
        CASE WHEN failed_steps > 0 THEN 'Review failed steps in the run log before retrying.'
          ELSE 'Migration completed cleanly.' END AS next_action FROM final GROUP BY 1""",
    "largest_first": f"""SELECT table_name, row_count,
        CAST(row_number() OVER (ORDER BY row_count DESC, table_name) AS INTEGER) AS rank FROM ({_COUNTS})""",
    "stream_copy_events": "SELECT * FROM events",
    "stream_mv_events": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_dedupe_events": "SELECT * FROM events",
}

ORACLE_SQL["run_report_events"] = f"""SELECT s.run_id, total_steps, ok_steps, failed_steps, skipped_steps, elapsed_s,
    success AND coalesce(v.ok, true) AS success, v.ok AS verified, v.tables_checked, CASE WHEN v.ok THEN '' WHEN NOT v.ok THEN 'events' END AS failed_tables,
    coalesce(r.open_reviews, 0) AS open_reviews,
    CASE WHEN failed_steps = 0 AND coalesce(v.ok, true) AND r.open_reviews IS NULL THEN 'Migration completed cleanly.' ELSE
      concat_ws(' ', CASE WHEN failed_steps > 0 THEN 'Review failed steps in the run log before retrying.' END,
        CASE WHEN NOT v.ok THEN 'Inspect verification mismatches before cutover.' END,
        CASE WHEN r.open_reviews > 0 THEN 'Resolve outstanding manual-review items.' END) END AS next_action
    FROM ({ORACLE_SQL["run_summary_events"]}) s
    LEFT JOIN (SELECT user_id, count(*) AS tables_checked, count(*) FILTER (WHERE event_type = 'error' AND value > 50) = 0 AS ok
      FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) v ON v.user_id = s.run_id
    LEFT JOIN (SELECT user_id, count(*) AS open_reviews FROM events WHERE event_id % 10 = 0 GROUP BY 1) r ON r.user_id = s.run_id"""


def _key_candidates(most: int = 3) -> str:
    """All column sets by counting their distinct combinations; those that hold a smaller key go."""
    lines = []
    for name, columns in SCHEMAS.items():
        plain = [c for c, kind in columns if not kind.startswith("array")]
        sets = [s for k in range(1, most + 1) for s in combinations(plain, k)]
        valid = {s: f"(count(*) = count(DISTINCT ({', '.join(s)})) AND {' AND '.join(f'count(*) = count({c})' for c in s)})"
                 if len(s) > 1 else f"(count(*) = count(DISTINCT {s[0]}) AND count(*) = count({s[0]}))" for s in sets}
        counted = ", ".join(f"{v} AS k{i}" for i, v in enumerate(valid.values()))
        for i, s in enumerate(sets):
            smaller = [f"NOT k{j}" for j, t in enumerate(sets) if len(t) < len(s) and set(t) < set(s)]
            lines.append(f"SELECT '{name}' AS table_name, '{','.join(s)}' AS key_columns, {len(s)} AS n_columns FROM q_{name} WHERE {' AND '.join([f'k{i}', *smaller])}")
        _KEY_COUNTS[name] = f"q_{name} AS MATERIALIZED (SELECT {counted} FROM {name})"
    return f"WITH {', '.join(_KEY_COUNTS.values())} " + " UNION ALL ".join(lines)


_KEY_COUNTS: dict[str, str] = {}
ORACLE_SQL["key_candidates"] = _key_candidates()

_FAMILY = {"int": "whole", "bigint": "whole", "double": "real", "string": "string", "timestamp_ntz": "timestamp_ntz"}
_VALUES = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{_FAMILY[kind]}' AS f, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
    for t, columns in SCHEMAS.items() for c, kind in columns if kind in _FAMILY)
ORACLE_SQL["fk_candidates"] = f"""WITH held AS MATERIALIZED ({_VALUES}), n AS (SELECT t, c, count(*) AS n FROM held GROUP BY ALL),
    pairs AS (SELECT x.t, x.c, y.t AS rt, y.c AS rc, count(*) AS n FROM held x JOIN held y ON x.f = y.f AND x.v = y.v AND (x.t, x.c) <> (y.t, y.c) GROUP BY ALL)
    SELECT p.t AS table_name, p.c AS column_name, p.rt AS ref_table, p.rc AS ref_column, p.n AS n_values
    FROM pairs p JOIN n ON n.t = p.t AND n.c = p.c AND n.n = p.n"""

ORACLE_SQL["iblt_diff_orders"] = ORACLE_SQL["row_diff_orders"]
_LINES = ", ".join(c for c, _ in SCHEMAS["lineitem"])
ORACLE_SQL["merkle_diff_lineitem"] = f"""WITH s AS (SELECT l_orderkey, count(*) AS n, list(l ORDER BY l) AS rows FROM (
      SELECT l_orderkey, ({_LINES})::VARCHAR AS l FROM lineitem) GROUP BY 1),
    t AS (SELECT l_orderkey, count(*) AS n, list(l ORDER BY l) AS rows FROM (SELECT l_orderkey, ({_LINES})::VARCHAR AS l FROM {FAULTY_LINEITEM} q) GROUP BY 1)
    SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, CASE WHEN t.n IS NULL THEN 'missing_in_target' WHEN s.n IS NULL THEN 'missing_in_source'
      ELSE 'changed' END AS status, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows
    FROM s FULL JOIN t ON s.l_orderkey = t.l_orderkey WHERE s.rows IS DISTINCT FROM t.rows"""
ORACLE_SQL["ivm_star_lineitem"] = """WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
      CASE WHEN year(o_orderdate) IN (1996, 1997) AND o_orderkey % 10 = 1 THEN '0-MOVED' ELSE o_orderpriority END AS o_orderpriority
      FROM orders WHERE NOT (year(o_orderdate) IN (1996, 1997) AND o_orderkey % 10 = 2)),
    l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem)
    SELECT year, o_orderpriority, count(*) AS line_count,
      CAST(sum(CASE WHEN year IN (1996, 1997) AND l_orderkey % 10 < 2 AND l_linenumber = 1 THEN 2 * q ELSE q END) AS DECIMAL(38,2)) AS quantity,
      CAST(sum(p) AS DECIMAL(38,2)) AS price FROM o JOIN l ON o_orderkey = l_orderkey GROUP BY 1, 2"""
