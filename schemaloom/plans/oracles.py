"""DuckDB statements that give the same rows as the registered queries.

They are written relationally (exploded rows, joins, windows) and share nothing with the
Spark side: the fixed values of the rules are written out here once more.
"""

from __future__ import annotations

# Fixed values of the rules.
TRANSIENT_CODES = ["UNAVAILABLE", "DEADLINE_EXCEEDED", "RESOURCE_EXHAUSTED"]
TRANSIENT_MARKERS = [
    "statuscode.unavailable",
    "connection refused",
    "failed to connect to all addresses",
    "connect: connection refused",
    "unavailable",
    "temporarily unavailable",
]
TYPE_SPELLINGS = {
    "string": ["text", "varchar", "character varying", "bpchar", "char", "string"],
    "integer": ["int", "int4", "integer"],
    "bigint": ["bigint", "int8"],
    "float": ["float", "float8", "double", "double precision", "real"],
    "boolean": ["bool", "boolean"],
    "timestamp": ["timestamp", "timestamp without time zone"],
    "timestamptz": ["timestamptz", "timestamp with time zone"],
}
FAMILY_SUBSTRINGS = [
    ("boolean", ["bool"]),
    ("bigint", ["bigint", "long"]),
    ("integer", ["int"]),
    ("float", ["double", "float", "real"]),
    ("numeric", ["decimal", "numeric"]),
    ("timestamp", ["timestamp", "datetime"]),
]
WIDENING_PAIRS = [
    "boolean>string",
    "integer>bigint",
    "integer>float",
    "integer>numeric",
    "integer>string",
    "bigint>float",
    "bigint>numeric",
    "bigint>string",
    "float>numeric",
    "float>string",
    "numeric>string",
    "date>timestamp",
    "date>string",
    "timestamp>string",
]
WHITESPACE = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def canon(x: str) -> str:
    t = f"lower({strip(x)})"
    whens = " ".join(f"WHEN {t} IN {_list(s)} THEN '{name}'" for name, s in TYPE_SPELLINGS.items())
    return f"(CASE {whens} WHEN {t} = '' THEN NULL ELSE {t} END)"


def family(x: str) -> str:
    t = f"lower({strip(x)})"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in FAMILY_SUBSTRINGS
    )
    return f"(CASE {whens} WHEN contains({t}, 'date') AND NOT contains({t}, 'time') THEN 'date' ELSE 'string' END)"


def widens(a: str, b: str) -> str:
    return f"({family(a)} = {family(b)} OR {family(a)} || '>' || {family(b)} IN {_list(WIDENING_PAIRS)})"


def corr(kind: str) -> str:
    return f"sha256('{kind}|' || dataset_id || '|' || CAST(event_id AS VARCHAR))"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs.split(), sql)


def oracle(name: str, needs: str, sql: str, recursive: bool = False) -> None:
    order: list[str] = []

    def visit(n):
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs.split():
        visit(n)
    # each part is kept as a table, since most are used more than once
    head = ",\n".join(f"{n} AS {'' if CTES[n][1].startswith('/*r*/') else 'MATERIALIZED '}({CTES[n][1]})" for n in order)
    any_recursive = any(CTES[n][1].startswith("/*r*/") for n in order)
    ORACLES[name] = (f"WITH {'RECURSIVE ' if any_recursive else ''}{head}\n{sql}" if head else sql).strip()


# --- derived inputs ----------------------------------------------------------------------

cte("base", "", """
SELECT event_id, user_id, ts, concat('lake.', event_type, '_', CAST(user_id % 20 AS VARCHAR)) AS dataset_id,
       row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY event_id) AS n
FROM events""")

cte("attrs", "base", """
SELECT b.event_id, b.dataset_id, b.n, a.i, concat('col_', CAST(a.i AS VARCHAR)) AS name,
  CASE WHEN b.event_id % 31 = 0 AND a.i = 1 THEN 'int'
       WHEN floor((b.n + 3*a.i)/40) <= 0 THEN (CASE WHEN b.event_id % 2 = 0 THEN 'int4' ELSE 'INTEGER' END)
       WHEN floor((b.n + 3*a.i)/40) = 1 THEN (CASE WHEN b.event_id % 2 = 0 THEN 'int8' ELSE 'bigint' END)
       WHEN floor((b.n + 3*a.i)/40) = 2 THEN 'double precision'
       ELSE (CASE WHEN b.event_id % 3 = 0 THEN 'varchar' ELSE 'text' END) END AS logical_type,
  CASE WHEN (b.event_id + a.i) % 23 = 0 THEN NULL
       WHEN (b.event_id % 31 = 0 AND a.i = 1) OR floor((b.n + 3*a.i)/40) <= 0 THEN 'integer'
       WHEN floor((b.n + 3*a.i)/40) = 1 THEN 'bigint'
       WHEN floor((b.n + 3*a.i)/40) = 2 THEN 'float'
       ELSE 'string' END AS physical_type,
  a.i > 0 AS nullable
FROM base b CROSS JOIN (SELECT unnest(range(8)) AS i) a
WHERE a.i < 3 + least(floor(b.n/15), 5) AND NOT (b.event_id % 17 = 0 AND a.i = 2)""")

cte("raw_attrs", "base attrs", """
SELECT event_id, i, name, logical_type FROM attrs
UNION ALL SELECT event_id, 99, 'ingestion_timestamp', 'timestamp' FROM base WHERE event_id % 5 = 0""")

cte("notifs", "base", """
SELECT event_id, user_id, dataset_id, n, concat('src_', CAST(user_id % 3 AS VARCHAR)) AS source,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed_at,
       CASE WHEN event_id % 6 = 0 THEN n END AS producer_version,
       CASE WHEN event_id % 4 = 0 THEN 'sandbox' WHEN event_id % 4 = 1 THEN concat('team_', CAST(event_id % 7 AS VARCHAR)) END AS requested_policy,
       event_id % 19 <> 0 AS verified
FROM base""")

cte("cur", "attrs", f"SELECT event_id, dataset_id, n, i, name, {canon('logical_type')} AS eff FROM attrs")

cte("atoms", "base cur", """
SELECT b.event_id, x.* FROM (
  SELECT coalesce(c.dataset_id, p.dataset_id) AS dataset_id, coalesce(c.n, p.n) AS n, coalesce(c.name, p.name) AS attribute,
    CASE WHEN p.name IS NULL THEN 'ADD_COLUMN' WHEN c.name IS NULL THEN 'DROP_COLUMN' ELSE 'CHANGE_TYPE' END AS kind,
    p.eff AS from_type, c.eff AS to_type, CASE WHEN c.name IS NULL THEN 1 ELSE 0 END AS section, coalesce(c.i, p.i) AS pos
  FROM cur c FULL OUTER JOIN (SELECT dataset_id, n + 1 AS n, i, name, eff FROM cur) p
    ON c.dataset_id = p.dataset_id AND c.n = p.n AND c.name = p.name
  WHERE c.name IS NULL OR p.name IS NULL OR c.eff <> p.eff) x
JOIN base b ON b.dataset_id = x.dataset_id AND b.n = x.n""")

cte("flags", "base atoms", f"""
SELECT b.event_id, b.dataset_id, b.n, count(a.kind) AS atom_count,
  coalesce(bool_or(a.kind = 'DROP_COLUMN'), false) AS has_drop,
  coalesce(bool_or(a.kind = 'CHANGE_TYPE'), false) AS has_change,
  coalesce(bool_and(a.kind = 'ADD_COLUMN'), false) AS only_additive,
  coalesce(bool_and({widens('from_type', 'to_type')}) FILTER (a.kind = 'CHANGE_TYPE'), false) AS widening_only,
  coalesce(string_agg(attribute || ':' || from_type || '->' || to_type, ', ' ORDER BY pos)
    FILTER (a.kind = 'CHANGE_TYPE' AND NOT {widens('from_type', 'to_type')}), '') AS offenders
FROM base b LEFT JOIN atoms a USING (event_id) GROUP BY ALL""")


def decisions(policy: str, case: str = "''") -> str:
    """Decision per event for a relation with the flags, drop_ok, mode and impact reasons."""
    return f"""
SELECT event_id, dataset_id, n, policy_name,
  CASE WHEN c IN ('drop', 'change', 'narrowing', 'impact') THEN 'block' ELSE 'allow' END AS decision,
  CASE WHEN c IN ('drop', 'change', 'narrowing', 'impact') THEN 'breaking' WHEN c IN ('unchanged', 'additive') THEN 'backward'
       WHEN has_change AND widening_only THEN 'backward' ELSE 'breaking' END AS compatibility,
  CASE WHEN c = 'additive' THEN 'NEW_HUB,NEW_LINK' ELSE '' END AS obligations,
  CASE c WHEN 'unchanged' THEN 'No structural changes detected' WHEN 'drop' THEN 'DROP_COLUMN not allowed by policy'
         WHEN 'change' THEN 'CHANGE_TYPE not allowed by policy'
         WHEN 'narrowing' THEN 'Non-widening CHANGE_TYPE blocked by policy: ' || offenders
         WHEN 'impact' THEN impact WHEN 'additive' THEN 'Only additive changes detected'
         ELSE CASE WHEN has_change AND widening_only THEN 'Only widening CHANGE_TYPE detected'
                   ELSE 'Destructive changes allowed by policy' END END AS reasons
FROM (SELECT *, CASE WHEN atom_count = 0 THEN 'unchanged' WHEN has_drop AND NOT drop_ok THEN 'drop'
                     WHEN has_change AND mode = 'widen' AND NOT widening_only THEN 'narrowing'
                     WHEN impact <> '' THEN 'impact' WHEN only_additive THEN 'additive' ELSE 'destructive' END AS c
      FROM ({policy}))"""


_PICK = "coalesce(requested_policy, 'production') AS policy_name"
_SANDBOX = "coalesce(requested_policy, '') = 'sandbox'"

cte("decided", "flags notifs", decisions(f"""
SELECT f.*, {_PICK}, {_SANDBOX} AS drop_ok, CASE WHEN {_SANDBOX} THEN 'any' ELSE 'widen' END AS mode, '' AS impact
FROM flags f JOIN notifs USING (event_id)"""))

cte("ops", "decided atoms", """
SELECT event_id, dataset_id, n, row_number() OVER (PARTITION BY event_id ORDER BY section, pos, layer) AS op_seq,
       layer, kind, column_name, from_type, to_type
FROM (
  SELECT event_id, dataset_id, n, -1 AS section, u.pos AS pos, 'vault' AS layer, u.kind AS kind, NULL AS column_name, NULL AS from_type, NULL AS to_type
  FROM decided CROSS JOIN (VALUES (1, 'NEW_HUB'), (2, 'NEW_LINK')) u(pos, kind) WHERE obligations <> ''
  UNION ALL
  SELECT d.event_id, d.dataset_id, d.n, a.section, a.pos, l.layer, a.kind, a.attribute, a.from_type, a.to_type
  FROM decided d JOIN atoms a USING (event_id) CROSS JOIN (VALUES ('lake'), ('vault')) l(layer) WHERE d.decision = 'allow')""")

_Q = "'\"' || {} || '\"'"
_TYPE_JSON = "coalesce('\"' || {} || '\"', 'null')"

cte("keyed", "ops", f"""
SELECT *, sha256('{{"dataset_id": "' || dataset_id || '", "kind": "' || kind || '", "layer": "' || layer || '", "params": ' ||
  CASE kind WHEN 'ADD_COLUMN' THEN '{{"column_name": "' || column_name || '", "logical_type": ' || {_TYPE_JSON.format('to_type')} || '}}'
    WHEN 'CHANGE_TYPE' THEN '{{"column_name": "' || column_name || '", "from_logical_type": ' || {_TYPE_JSON.format('from_type')} ||
        ', "logical_type": ' || {_TYPE_JSON.format('to_type')} || ', "to_logical_type": ' || {_TYPE_JSON.format('to_type')} || '}}'
    WHEN 'DROP_COLUMN' THEN '{{"column_name": "' || column_name || '", "from_logical_type": ' || {_TYPE_JSON.format('from_type')} ||
        ', "logical_type": ' || {_TYPE_JSON.format('from_type')} || '}}'
    ELSE '{{"table_name": "' || dataset_id || '"}}' END || ', "target": "' || dataset_id || '"}}') AS idempotency_key
FROM ops""")

cte("edges", "", """
SELECT up, ty, down, CASE WHEN a1 = '' THEN [] ELSE [a1, a2] END AS via FROM (
  SELECT concat('obj_',CAST(CAST(floor(p_partkey/3) AS BIGINT) AS VARCHAR)) up, concat('obj_',CAST(p_partkey AS VARCHAR)) down, p_partkey p, p_size z
  FROM part WHERE p_partkey >= 1
  UNION ALL
  SELECT concat('obj_',CAST(p_partkey AS VARCHAR)), concat('obj_',CAST(CAST(floor(p_partkey/9) AS BIGINT) AS VARCHAR)), p_partkey, p_size
  FROM part WHERE p_partkey > 0 AND p_partkey % 50 = 0
  UNION ALL
  SELECT concat('lake.', CASE CAST(floor(p_partkey/20) AS BIGINT)%5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END,
                '_', CAST(CAST(floor(p_partkey/100) AS BIGINT) % 20 AS VARCHAR)), concat('obj_',CAST(p_partkey AS VARCHAR)), p_partkey, p_size
  FROM part WHERE p_partkey > 0 AND p_partkey % 20 = 1) e
CROSS JOIN LATERAL (SELECT
  CASE p%10 WHEN 0 THEN 'lake_table' WHEN 1 THEN 'lake_view' WHEN 2 THEN 'TABLE' WHEN 3 THEN 'vault_hub' WHEN 4 THEN 'vault_link'
            WHEN 5 THEN 'vault_satellite' WHEN 6 THEN 'job' WHEN 7 THEN 'report' WHEN 8 THEN 'dashboard' ELSE 'topic' END ty,
  CASE WHEN p%3=0 THEN '' ELSE concat('col_',CAST(p%8 AS VARCHAR)) END a1,
  CASE WHEN p%3=0 THEN '' ELSE concat('col_',CAST(z%8 AS VARCHAR)) END a2) x""")

_CLASS = """CASE WHEN lower(ty) IN ('lake_table', 'lake_view', 'table', 'view') THEN 'lake'
  WHEN lower(ty) IN ('vault_hub', 'vault_link', 'vault_satellite', 'vault_object') THEN 'vault'
  WHEN lower(ty) IN ('transformation', 'job', 'report', 'dashboard') THEN 'transformation' END"""

cte("asked", "atoms", """
SELECT DISTINCT dataset_id, changed FROM
 (SELECT event_id, dataset_id, list_sort(list(DISTINCT attribute)) AS changed FROM atoms GROUP BY ALL)""")

cte("reach", "asked edges", """/*r*/
SELECT dataset_id, changed, dataset_id AS node FROM asked
UNION
SELECT r.dataset_id, r.changed, e.down FROM reach r JOIN edges e ON e.up = r.node
WHERE len(e.via) = 0 OR list_has_any(e.via, r.changed)""")

cte("hits", "reach edges", f"""
SELECT DISTINCT dataset_id, changed, {_CLASS} AS artifact_class, e.down AS artifact_id
FROM reach r JOIN edges e ON e.up = r.node
WHERE (len(e.via) = 0 OR list_has_any(e.via, r.changed)) AND {_CLASS} IS NOT NULL""")

cte("impacts", "asked hits", """
SELECT a.dataset_id, a.changed, count(*) FILTER (artifact_class = 'lake') AS impacted_lake,
  count(*) FILTER (artifact_class = 'vault') AS impacted_vault,
  count(*) FILTER (artifact_class = 'transformation') AS impacted_transformations
FROM asked a LEFT JOIN hits h USING (dataset_id, changed) GROUP BY ALL""")

cte("plan_orders", "", """
SELECT o_custkey AS plan_no, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS op_seq FROM orders""")

cte("attempts", "plan_orders", """
SELECT plan_no, o_orderkey, op_seq, attempt,
  CASE WHEN k<=4 THEN 1 WHEN k=5 THEN 2 WHEN k=6 AND o_orderkey%7=0 THEN 4 WHEN k=9 THEN NULL ELSE 3 END AS status
FROM (SELECT *, (o_orderkey*7 + attempt*13 + op_seq*attempt) % 10 AS k FROM plan_orders CROSS JOIN (SELECT unnest(range(1, 6)) AS attempt))""")

cte("outcomes", "attempts", """
SELECT DISTINCT ON (plan_no, op_seq) plan_no, op_seq, coalesce(status, 4) AS status, CASE WHEN status IS NOT NULL THEN attempt END AS attempt,
  CASE WHEN status IS NULL THEN 'RETRIES_EXHAUSTED' END AS error_code,
  CASE WHEN status IN (1, 2, 4) THEN attempt ELSE 5 END AS attempts_used
FROM attempts
ORDER BY plan_no, op_seq, CASE WHEN status IN (1, 2, 4) THEN 0 WHEN status IS NOT NULL THEN 1 ELSE 2 END,
  CASE WHEN status IN (1, 2, 4) THEN attempt ELSE -attempt END""")

# --- sources -----------------------------------------------------------------------------

oracle("notification_scan", "notifs raw_attrs", """
SELECT n.event_id,
  CASE WHEN k = 6 THEN NULL WHEN k = 0 THEN 'schema.other' ELSE 'schema.notification' END AS event_type,
  CASE WHEN k IN (1, 4, 5, 6) THEN NULL ELSE dataset_id END AS dataset_id,
  CASE WHEN k IN (4, 5, 6) THEN NULL ELSE source END AS source,
  CAST(CASE WHEN k IN (2, 6) THEN -1 ELSE a.cnt END AS BIGINT) AS attribute_count,
  CASE WHEN k IN (2, 6) THEN NULL ELSE a.types END AS logical_types,
  CASE WHEN k IN (3, 6) THEN NULL ELSE observed_at END AS observed_at,
  CASE WHEN k = 6 THEN NULL ELSE producer_version END AS previous_schema_version,
  CASE WHEN k = 6 THEN NULL ELSE requested_policy END AS requested_policy
FROM (SELECT *, event_id % 101 AS k FROM notifs) n
JOIN (SELECT event_id, count(*) AS cnt, string_agg(logical_type, ',' ORDER BY i) AS types FROM raw_attrs GROUP BY 1) a USING (event_id)""")

_OUTCOME = """CASE event_id % 101 WHEN 0 THEN 'Unsupported event_type' WHEN 1 THEN 'Missing dataset.id' WHEN 2 THEN 'Missing header.attributes'
  WHEN 3 THEN 'Missing ingestion.observed_at' WHEN 5 THEN 'Missing dataset.id' WHEN 6 THEN 'Undecodable message' ELSE '{ok}' END AS outcome"""
oracle("notification_validate", "", f"SELECT event_id, {_OUTCOME.format(ok='ok')} FROM events")
oracle("notification_rejects", "base", f"""
SELECT dataset_id, outcome, count(*) AS messages FROM (SELECT dataset_id, {_OUTCOME.format(ok='valid')} FROM base) GROUP BY ALL""")

oracle("policy_table", "notifs", """
SELECT p.*, count(n.event_id) AS notifications FROM (VALUES
  ('production', false, 'widen', 'NEW_HUB,NEW_LINK', 'breaking', 'breaking', 'backward', 'breaking_only', CAST(0 AS BIGINT)),
  ('sandbox', true, 'any', 'NEW_HUB,NEW_LINK', 'breaking', 'breaking', 'backward', 'off', NULL),
  ('default', false, 'widen', 'NEW_HUB,NEW_LINK', 'breaking', 'breaking', 'backward', 'breaking_only', 0))
  p(policy_name, allow_drop, change_mode, obligations, compatibility_for_drop, compatibility_for_change_type,
    compatibility_for_change_type_widening, impact_mode, max_impacted_total)
LEFT JOIN (SELECT event_id, CASE WHEN requested_policy IS NULL THEN 'production' WHEN requested_policy = 'sandbox' THEN 'sandbox' ELSE 'default' END AS used FROM notifs) n
  ON n.used = p.policy_name
GROUP BY ALL""")

oracle("policy_select", "notifs", """
SELECT event_id, coalesce(requested_policy, 'production') AS policy_name,
  CASE WHEN requested_policy IS NULL THEN 'production' WHEN requested_policy = 'sandbox' THEN 'sandbox' ELSE 'default' END AS used_policy,
  coalesce(requested_policy = 'sandbox', false) AS allow_drop,
  CASE WHEN requested_policy = 'sandbox' THEN 'any' ELSE 'widen' END AS change_mode
FROM notifs""")

oracle("lineage_edges", "edges", f"""
SELECT up AS upstream_id, down AS downstream_id, coalesce({_CLASS}, 'none') AS artifact_class,
  array_to_string(via, ',') AS via, CAST(0 AS BIGINT) AS metadata_size FROM edges""")
oracle("lineage_edges_file", "edges", """
SELECT up AS upstream_id, down AS downstream_id,
  CASE WHEN p % 6 = 2 THEN 'col_1' ELSE array_to_string(via, ',') END AS via,
  CASE p % 6 WHEN 0 THEN 'value' WHEN 1 THEN 'deep,n' ELSE '' END AS metadata_keys
FROM (SELECT *, CAST(regexp_extract(down, '([0-9]+)$', 1) AS BIGINT) AS p FROM edges) WHERE p % 6 <> 4""")
oracle("lineage_append", "edges", "SELECT ty AS downstream_type, 2 * count(*) AS edges FROM edges GROUP BY 1")

cte("width", "base attrs", "SELECT b.event_id, b.dataset_id, b.n, count(a.name) AS attribute_count FROM base b LEFT JOIN attrs a USING (event_id) GROUP BY ALL")
oracle("latest_schema", "width", """
SELECT dataset_id, n AS version, attribute_count, event_id AS stored_seq FROM width
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC) = 1""")
oracle("previous_header", "width", """
SELECT w.event_id, w.dataset_id, l.n AS current_version, l.attribute_count AS current_attributes, w.attribute_count AS new_attributes
FROM width w JOIN (SELECT * FROM width QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC) = 1) l USING (dataset_id)""")
oracle("next_version", "notifs", """
SELECT dataset_id, event_id AS seq,
  coalesce((SELECT max(n) FROM notifs s WHERE NOT s.verified AND s.dataset_id = v.dataset_id), 0)
    + row_number() OVER (PARTITION BY dataset_id ORDER BY event_id) AS version
FROM notifs v WHERE verified""")
oracle("dataset_path_key", "", "SELECT page_id, replace(replace(url, '/', '_'), ':', '_') AS path_key FROM pages")

oracle("upsert_plans", "", """
SELECT DISTINCT ON (o_custkey) o_custkey AS plan_id, o_orderpriority AS plan, o_orderstatus, o_orderkey AS stored_at
FROM orders ORDER BY o_custkey, o_orderkey DESC""")
oracle("upsert_executions", "attempts", """
SELECT DISTINCT ON (plan_no, op_seq) concat(plan_no, '-', op_seq) AS plan_id, CAST(status AS BIGINT) AS status, attempt AS stored_at
FROM attempts ORDER BY plan_no, op_seq, attempt DESC""")
oracle("upsert_verifications", "notifs", """
SELECT dataset_id AS plan_id, CASE WHEN verified THEN 'passed' ELSE 'failed' END AS status, event_id AS stored_at FROM notifs
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY event_id DESC) = 1""")

_STAR = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
_OBSERVED = {**_STAR, "notifs": "event_id dataset_id producer_version requested_policy", "attempts": "plan_no op_seq attempt status"}


def _profile(relations: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{'notifications' if t == 'notifs' else t}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_rows, "
        f"count(*) AS total_rows, count(*) FILTER ({c} IS NULL) > 0 AS has_nulls FROM {t}"
        for t, cols in relations.items()
        for c in cols.split()
    )


oracle("nullability_profile", "notifs attempts", _profile(_OBSERVED))
oracle("lake_evidence_scan", "", f"""
SELECT table_name, count(*) AS columns, max(total_rows) AS rows, count(*) FILTER (has_nulls) AS nullable_columns
FROM ({_profile(_STAR)}) GROUP BY 1""")

_TAIL = "substr(dataset_id, 6)"
cte("structures", "base", f"""
SELECT event_id, dataset_id, CASE WHEN event_id % 19 = 0 THEN 'hub_other' ELSE 'hub_' || {_TAIL} END AS hub,
  event_id % 23 <> 0 AS has_link, event_id % 3 = 0 AS has_sat, event_id % 67 = 0 AS no_vault, event_id % 71 = 0 AS empty_vault FROM base""")
oracle("vault_evidence_scan", "structures", f"""
SELECT dataset_id, hub, CASE WHEN bool_or(has_link) THEN 'link_orders_parts' ELSE '' END AS links,
  CASE WHEN bool_or(has_sat) THEN 'sat_' || {_TAIL} ELSE '' END AS satellites
FROM structures WHERE NOT no_vault AND NOT empty_vault AND (has_link OR has_sat) GROUP BY dataset_id, hub""")

# --- scalar functions --------------------------------------------------------------------

from schemaloom.plans.catalog import ERROR_CODES, ERROR_TEXTS, GUARDS, SPELLINGS  # noqa: E402


def _pick(values, k: str) -> str:
    return f"[{', '.join(_text(v) for v in values)}][CAST(({k}) % {len(values)} AS INT) + 1]"


cte("spelled", "", f"""
SELECT event_id, i, {_pick(SPELLINGS, 'event_id*5 + i*3')} AS logical_type, {_pick(SPELLINGS, 'event_id*11 + i*7 + 1')} AS physical_type,
  {_pick(SPELLINGS, 'event_id*2 + i*5 + 4')} AS type
FROM events CROSS JOIN (SELECT unnest(range(8)) AS i)""")
oracle("canonical_type", "spelled", f"SELECT logical_type AS spelling, {canon('logical_type')} AS canonical, count(*) AS uses FROM spelled GROUP BY ALL")
oracle("type_family", "spelled", f"SELECT logical_type AS spelling, {family('logical_type')} AS family, count(*) AS uses FROM spelled GROUP BY ALL")
oracle("effective_type", "spelled", f"""
SELECT coalesce(CASE WHEN (event_id + i) % 3 <> 0 THEN {canon('logical_type')} END,
                CASE WHEN (event_id + i) % 2 <> 0 THEN {canon('physical_type')} END, {canon('type')}) AS effective, count(*) AS uses
FROM spelled GROUP BY ALL""")
oracle("widening_check", "spelled", f"""
SELECT logical_type AS from_type, physical_type AS to_type, {widens('logical_type', 'physical_type')} AS widening, count(*) AS uses
FROM spelled GROUP BY ALL""")

oracle("strip_technical", "base raw_attrs", """
SELECT b.event_id, count(a.name) AS before, count(a.name) FILTER (name <> 'ingestion_timestamp') AS after,
  string_agg(name, ',' ORDER BY i) FILTER (name <> 'ingestion_timestamp') AS names
FROM base b LEFT JOIN raw_attrs a USING (event_id) GROUP BY 1""")
oracle("header_profile", "raw_attrs", "SELECT event_id, count(*) AS columns, string_agg(name, ',' ORDER BY i) AS names FROM raw_attrs GROUP BY 1")
oracle("header_shape", "raw_attrs", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'direct' WHEN 1 THEN 'wrapped_header' WHEN 2 THEN 'latest_is_header' WHEN 3 THEN 'invalid_shape' ELSE 'no_latest' END AS shape,
  CASE WHEN event_id % 7 <= 2 THEN count(*) ELSE -1 END AS attributes FROM raw_attrs GROUP BY 1""")
oracle("resolve_prev_version", "notifs", "SELECT event_id, coalesce(producer_version, CASE WHEN n > 1 THEN n - 1 END) AS previous_version FROM notifs")
oracle("change_context", "notifs width", f"""
SELECT n.event_id, n.dataset_id, source, {corr('correlation').replace('dataset_id', 'n.dataset_id').replace('event_id', 'n.event_id')} AS correlation_id,
  coalesce(p.attribute_count, -1) AS previous_attributes, w.attribute_count AS new_attributes, observed_at AS ingestion_ts
FROM notifs n JOIN width w USING (event_id) LEFT JOIN width p ON p.dataset_id = n.dataset_id AND p.n = n.n - 1""")

cte("idents", "", """
SELECT concat('p', page_id) AS id, url AS value FROM pages
UNION ALL SELECT concat('s', s_suppkey), concat(' Lake."Sat_', s_name, '-x.y" ') FROM supplier
UNION ALL SELECT concat('q', p_partkey), concat('HUB_', p_type, '/Link_', p_brand) FROM part""")


def _physical(x: str) -> str:
    raw = strip(x)
    return f"translate(trim(CASE WHEN contains({raw}, '.') THEN substr({raw}, strpos({raw}, '.') + 1) ELSE {raw} END, '\"'), '.-', '__')"


oracle("physical_identifier", "idents", f"SELECT id, lower(left({_physical('value')}, 63)) AS rdbms_name, lower({_physical('value')}) AS file_name FROM idents")
cte("candidates", "idents", f"""
SELECT DISTINCT id, candidate FROM (
  SELECT id, unnest([s, regexp_replace(s, '^hub_', ''), regexp_replace(s, '^sat_', ''), regexp_replace(s, '^satellite_', ''),
                     regexp_replace(s, '^link_', ''), regexp_replace(s, '^lnk_', '')]) AS candidate FROM (
    SELECT id, unnest([s, string_split(s, '.')[-1]]) AS s FROM (
      SELECT id, unnest([s, string_split(s, '/')[-1]]) AS s FROM (
        SELECT id, unnest([lower({strip('value')}), lower(left({_physical('value')}, 63))]) AS s FROM idents))))
WHERE candidate <> ''""")
oracle("identifier_candidates", "candidates", "SELECT * FROM candidates")

oracle("type_preference", "ops", """
SELECT event_id, column_name, CASE WHEN bool_or(kind = 'CHANGE_TYPE') THEN 'logical' ELSE 'physical' END AS preference
FROM ops WHERE layer = 'lake' AND kind IN ('ADD_COLUMN', 'CHANGE_TYPE') GROUP BY 1, 2""")


def _unit(v: str) -> str:
    return f"format('\\u{{:04x}}', {v})"


_ESC = f"""CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
 WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
 WHEN unicode(c) < 65536 THEN {_unit('unicode(c)')}
 ELSE {_unit('55296 + ((unicode(c) - 65536) >> 10)')} || {_unit('56320 + ((unicode(c) - 65536) & 1023)')} END"""
oracle("idempotency_key", "", f"""
SELECT doc_id, sha256('{{"dataset_id": "doc/' || source || '", "kind": "ADD_COLUMN", "layer": "lake", "params": {{"column_name": "' ||
  array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: {_ESC}), '') || '", "logical_type": ' ||
  CASE WHEN doc_id % 3 <> 0 THEN '"' || lang || '"' ELSE 'null' END || '}}, "target": "doc/' || source || '"}}') AS idempotency_key
FROM documents""")

oracle("error_triage", "attempts", f"""
SELECT code, message, code IN {_list(TRANSIENT_CODES)} OR {' OR '.join(f"contains(lower(message), '{m}')" for m in TRANSIENT_MARKERS)} AS transient, count(*) AS errors
FROM (SELECT {_pick(ERROR_CODES, 'o_orderkey + attempt')} AS code, {_pick(ERROR_TEXTS, 'o_orderkey*3 + attempt')} AS message
      FROM attempts WHERE status IS NULL OR status > 2) GROUP BY ALL""")

# --- diff, policy, plan ------------------------------------------------------------------

oracle("schema_diff", "atoms", "SELECT dataset_id, n, kind, attribute, from_type * 1 AS from_type FROM atoms".replace("from_type * 1 AS from_type", "CASE WHEN kind <> 'ADD_COLUMN' THEN from_type END AS from_type, CASE WHEN kind <> 'DROP_COLUMN' THEN to_type END AS to_type"))
oracle("schema_diff_ordered", "atoms", """
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY section, pos) AS atom_seq, kind, attribute FROM atoms""")
oracle("atom_counts", "base atoms", """
SELECT b.event_id, count(*) FILTER (kind = 'ADD_COLUMN') AS added, count(*) FILTER (kind = 'CHANGE_TYPE') AS changed,
  count(*) FILTER (kind = 'DROP_COLUMN') AS dropped FROM base b LEFT JOIN atoms a USING (event_id) GROUP BY 1""")
oracle("column_set_ops", "base cur", """
SELECT b.event_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (c AND NOT p), '') AS added,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (p AND NOT c), '') AS removed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (p AND c), '') AS kept
FROM base b LEFT JOIN (
  SELECT dataset_id, n, name, bool_or(s = 0) AS c, bool_or(s = 1) AS p FROM (
    SELECT dataset_id, n, name, 0 AS s FROM cur UNION ALL SELECT dataset_id, n + 1, name, 1 FROM cur) GROUP BY ALL) x USING (dataset_id, n)
GROUP BY 1""")
oracle("policy_flags", "flags", "SELECT event_id, has_drop, has_change, only_additive, widening_only, offenders FROM flags")

_NAMES = list(GUARDS)
cte("guarded", "flags", f"""
SELECT *, CASE WHEN mode_name = 'off' OR (mode_name = 'breaking_only' AND only_additive) OR total = 0 THEN ''
               WHEN caps <> '' THEN caps
               WHEN policy_name = 'any' THEN 'Policy blocks changes with downstream impact (lake_tables=' || lake || ', vault_objects=' || vault || ', transformations=' || xf || ')'
               ELSE '' END AS impact
FROM (SELECT *, concat_ws('; ',
    CASE WHEN total > cap_total THEN 'Impacted artifact count ' || total || ' exceeds policy limit ' || cap_total END,
    CASE WHEN lake > cap_lake THEN 'Impacted lake tables ' || lake || ' exceed policy limit ' || cap_lake END,
    CASE WHEN vault > cap_vault THEN 'Impacted vault objects ' || vault || ' exceed policy limit ' || cap_vault END,
    CASE WHEN xf > cap_xf THEN 'Impacted downstream transformations ' || xf || ' exceed policy limit ' || cap_xf END) AS caps
  FROM (SELECT *, lake + vault + xf AS total,
      CASE policy_name WHEN 'strict' THEN 'breaking_only' WHEN 'off' THEN 'off' ELSE 'always' END AS mode_name,
      CASE policy_name WHEN 'default' THEN 4 WHEN 'strict' THEN 0 WHEN 'off' THEN 0 END AS cap_total,
      CASE policy_name WHEN 'lake_cap' THEN 1 END AS cap_lake, CASE policy_name WHEN 'lake_cap' THEN 0 END AS cap_vault,
      CASE policy_name WHEN 'strict' THEN 2 END AS cap_xf
    FROM (SELECT *, event_id % 4 AS lake, event_id % 3 AS vault, CAST(floor(event_id/4) AS BIGINT) % 5 AS xf,
            {_pick(_NAMES, 'CAST(floor(event_id/2) AS BIGINT)')} AS policy_name FROM flags)))""")
oracle("impact_guard", "guarded", "SELECT event_id, policy_name, impact AS reasons FROM guarded")
_COLS = "event_id, policy_name, decision, compatibility, obligations, reasons"
oracle("policy_decision_guarded", "guarded", f"SELECT {_COLS} FROM ({decisions('SELECT *, true AS drop_ok, ' + repr('any') + ' AS mode FROM guarded')})")
for _name, _ok, _mode in (("production", "false", "widen"), ("sandbox", "true", "any")):
    _rel = f"SELECT *, '{_name}' AS policy_name, {_ok} AS drop_ok, '{_mode}' AS mode, '' AS impact FROM flags"
    oracle(f"policy_decision_{_name}", "flags", f"SELECT {_COLS} FROM ({decisions(_rel)})")
oracle("policy_decision_requested", "decided", f"SELECT {_COLS} FROM decided")

oracle("build_plan", "keyed", """
SELECT event_id, op_seq, layer, kind, dataset_id AS target, column_name,
  CASE WHEN kind = 'DROP_COLUMN' THEN from_type ELSE to_type END AS logical_type,
  CASE WHEN kind IN ('CHANGE_TYPE', 'DROP_COLUMN') THEN from_type END AS from_logical_type,
  CASE WHEN kind = 'CHANGE_TYPE' THEN to_type END AS to_logical_type,
  CASE WHEN kind IN ('NEW_HUB', 'NEW_LINK') THEN dataset_id END AS table_name, idempotency_key FROM keyed""")
oracle("op_summary", "ops", "SELECT event_id, layer || '::' || kind AS op, count(*) AS operations FROM ops GROUP BY ALL")
oracle("plan_checkpoints", "decided ops", """
SELECT d.event_id, count(o.op_seq) AS checkpoints, count(o.op_seq) AS last FROM decided d LEFT JOIN ops o USING (event_id) WHERE decision = 'allow' GROUP BY 1""")
cte("probes", "base", """
SELECT dataset_id, max(event_id) % 5 = 0 AS failed, count(*) % 3 AS candidates FROM base GROUP BY 1""")
oracle("prune_link_ops", "ops probes", """
SELECT event_id, op_seq, layer, kind FROM ops JOIN probes USING (dataset_id) WHERE kind <> 'NEW_LINK' OR (NOT failed AND candidates > 0)""")
oracle("already_applied", "keyed", """
SELECT event_id, op_seq, idempotency_key IN (SELECT idempotency_key FROM keyed WHERE layer = 'lake' OR kind = 'NEW_HUB') AS already_applied FROM keyed""")

# --- lineage -----------------------------------------------------------------------------

_CH = "array_to_string(changed, ',') AS changed"
oracle("lineage_impact", "hits", f"SELECT dataset_id, {_CH}, artifact_class, artifact_id FROM hits")
oracle("lineage_reach", "reach", f"SELECT dataset_id, {_CH}, node FROM reach")
oracle("impact_counts", "impacts", f"""
SELECT dataset_id, {_CH}, impacted_lake, impacted_vault, impacted_transformations,
  impacted_lake + impacted_vault + impacted_transformations AS impacted_total FROM impacts""")
oracle("policy_decision_lineage", "flags notifs impacts atoms", f"SELECT {_COLS} FROM (" + decisions(f"""
SELECT f.*, {_PICK}, {_SANDBOX} AS drop_ok, CASE WHEN {_SANDBOX} THEN 'any' ELSE 'widen' END AS mode,
  CASE WHEN NOT ({_SANDBOX}) AND NOT only_additive AND coalesce(total, 0) > 0 THEN 'Impacted artifact count ' || total || ' exceeds policy limit 0' ELSE '' END AS impact
FROM flags f JOIN notifs USING (event_id)
LEFT JOIN (SELECT event_id, dataset_id, list_sort(list(DISTINCT attribute)) AS changed FROM atoms GROUP BY ALL) c ON c.event_id = f.event_id
LEFT JOIN (SELECT dataset_id, changed, impacted_lake + impacted_vault + impacted_transformations AS total FROM impacts) i
  ON i.dataset_id = c.dataset_id AND i.changed = c.changed""") + ")")

# --- execution and verification ----------------------------------------------------------

oracle("op_outcome", "outcomes", """
SELECT plan_no, op_seq, CAST(status AS BIGINT) AS status, CAST(attempt AS BIGINT) AS attempt, error_code, CAST(attempts_used AS BIGINT) AS attempts_used FROM outcomes""")
oracle("abort_cutoff", "outcomes", """
SELECT plan_no, op_seq, CAST(status AS BIGINT) AS status FROM outcomes
QUALIFY coalesce(max(CASE WHEN status > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_no ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""")
oracle("execution_result", "outcomes", """
SELECT c_custkey AS plan_no, count(x.op_seq) AS results, coalesce(bool_and(x.status <= 2), true) AS successful
FROM customer LEFT JOIN (
  SELECT plan_no, op_seq, status FROM outcomes
  QUALIFY coalesce(max(CASE WHEN status > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_no ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) x
ON x.plan_no = c_custkey GROUP BY 1""")

# which of the evidence layouts a notification got, and whether its table can be found
cte("layout", "base", f"""
SELECT event_id, dataset_id, n, CASE WHEN event_id % 43 = 0 THEN 'none' WHEN event_id % 47 = 0 THEN 'empty' WHEN event_id % 59 = 0 THEN 'unknown'
  WHEN event_id % 4 = 0 THEN dataset_id WHEN event_id % 4 = 1 THEN 'HUB_' || upper({_TAIL}) WHEN event_id % 4 = 2 THEN 'only_one'
  ELSE 'public."' || {_TAIL} || '"' END AS found FROM base""")
cte("actual", "attrs base", """
SELECT event_id, name, CASE WHEN (event_id*7 + i) % 97 = 0 THEN 'json' ELSE coalesce(physical_type, logical_type) END AS ptype,
  CASE WHEN (event_id + i) % 61 = 0 THEN NOT nullable ELSE nullable END AS nullable
FROM attrs WHERE (event_id + i) % 53 <> 0
UNION ALL SELECT event_id, 'extra_col', 'text', true FROM base WHERE event_id % 41 = 0""")
oracle("select_target_table", "layout actual", """
SELECT event_id, CASE WHEN found IN ('none', 'empty', 'unknown') THEN NULL ELSE found END AS target_table,
  CASE WHEN found IN ('none', 'empty', 'unknown') THEN -1 ELSE count(a.name) END AS columns
FROM layout LEFT JOIN actual a USING (event_id) GROUP BY event_id, found""")

cte("lake_rows", "decided attrs actual ops", f"""
SELECT coalesce(e.event_id, a.event_id) AS event_id, coalesce(e.name, a.name) AS name, e.name IS NULL AS unexpected, a.name IS NULL AS missing,
  CASE WHEN c.column_name IS NOT NULL THEN {canon('e.logical_type')} ELSE coalesce({canon('e.physical_type')}, {canon('e.logical_type')}) END AS exp_type,
  {canon('a.ptype')} AS act_type, e.nullable AS exp_null, a.nullable AS act_null
FROM attrs e FULL OUTER JOIN actual a ON e.event_id = a.event_id AND e.name = a.name
LEFT JOIN (SELECT DISTINCT event_id, column_name FROM ops WHERE layer = 'lake' AND kind = 'CHANGE_TYPE') c ON c.event_id = e.event_id AND c.column_name = e.name""")


def _word(x: str) -> str:
    return f"CASE WHEN {x} THEN 'True' ELSE 'False' END"


cte("lake_messages", "lake_rows", f"""
SELECT event_id, string_agg(msg, '; ' ORDER BY name, rank) AS issues FROM (
  SELECT event_id, '' AS name, 0 AS rank, 'Lake table missing expected columns: ' || string_agg(name, ', ' ORDER BY name) AS msg FROM lake_rows WHERE missing GROUP BY event_id
  UNION ALL SELECT event_id, '', 1, 'Lake table contains unexpected columns: ' || string_agg(name, ', ' ORDER BY name) FROM lake_rows WHERE unexpected GROUP BY event_id
  UNION ALL SELECT event_id, name, 2, 'Lake column ''' || name || ''' type mismatch: expected ' || coalesce(exp_type, 'unknown') || ' got ' || coalesce(act_type, 'unknown')
    FROM lake_rows WHERE NOT missing AND NOT unexpected AND exp_type IS DISTINCT FROM act_type
  UNION ALL SELECT event_id, name, 3, 'Lake column ''' || name || ''' nullability mismatch: expected ' || {_word('exp_null')} || ' got ' || {_word('act_null')}
    FROM lake_rows WHERE NOT missing AND NOT unexpected AND exp_null <> act_null) GROUP BY event_id""")
cte("lake_issues", "decided layout lake_messages", """
SELECT d.event_id, CASE found WHEN 'none' THEN 'Lake evidence missing while verifying expected schema'
  WHEN 'empty' THEN 'Unable to identify target lake table for verification (dataset_id=' || d.dataset_id || ', available_tables=[])'
  WHEN 'unknown' THEN 'Unable to identify target lake table for verification (dataset_id=' || d.dataset_id || ', available_tables=[''other_a'', ''other_b''])'
  ELSE coalesce(m.issues, '') END AS issues, found IN ('none', 'empty') AS no_tables
FROM decided d JOIN layout l USING (event_id) LEFT JOIN lake_messages m ON m.event_id = d.event_id WHERE decision = 'allow'""")
oracle("verify_lake", "lake_issues", "SELECT event_id, issues FROM lake_issues")

cte("vault_issues", "decided structures ops", """
SELECT d.event_id, o.event_id IS NOT NULL AS needs_vault, no_vault OR empty_vault AS no_structures,
  CASE WHEN o.event_id IS NULL THEN '' WHEN no_vault THEN 'Vault evidence missing while verifying plan execution'
       WHEN empty_vault THEN 'Vault introspection returned no vault structures'
       WHEN structural <> '' THEN structural
       WHEN o.cols AND hub = 'hub_other' AND NOT has_sat THEN 'Vault evidence does not expose a structure related to dataset ' || d.dataset_id
       ELSE '' END AS issues
FROM decided d JOIN structures s USING (event_id)
LEFT JOIN (SELECT o.event_id, bool_or(kind NOT IN ('NEW_HUB', 'NEW_LINK')) AS cols, concat_ws('; ',
    CASE WHEN bool_or(kind = 'NEW_HUB') AND bool_and(hub = 'hub_other') THEN 'Vault evidence does not show expected hub for dataset ' || any_value(o.dataset_id) END,
    CASE WHEN bool_or(kind = 'NEW_LINK') AND bool_and(NOT has_link) THEN 'Vault evidence does not show any links after NEW_LINK for dataset ' || any_value(o.dataset_id) END) AS structural
  FROM ops o JOIN structures USING (event_id) WHERE layer = 'vault' GROUP BY 1) o ON o.event_id = d.event_id
WHERE decision = 'allow'""")
oracle("verify_vault", "vault_issues", "SELECT event_id, issues FROM vault_issues")

cte("verified", "decided lake_issues vault_issues ops", """
SELECT *, CASE WHEN issues = '' THEN 'passed' ELSE 'failed' END AS status FROM (
  SELECT d.*, l.event_id % 29 <> 0 AS successful, CASE WHEN l.event_id % 29 = 0 THEN 'Execution did not complete successfully' ELSE
    concat_ws('; ', CASE WHEN l.no_tables AND l.issues = '' THEN 'Lake introspection returned no tables' WHEN l.issues <> '' THEN l.issues END,
      CASE WHEN v.needs_vault AND v.issues <> '' THEN v.issues WHEN v.needs_vault AND v.no_structures THEN 'Vault introspection returned no vault structures' END) END AS issues
  FROM decided d JOIN lake_issues l USING (event_id) JOIN vault_issues v USING (event_id))""")
cte("refs", "ops", """
SELECT event_id, count(*) AS operations, coalesce(string_agg('snap-' || event_id || '-' || op_seq, ',' ORDER BY op_seq) FILTER ((event_id + op_seq - 1) % 3 <> 0), '') AS refs
FROM ops GROUP BY 1""")
oracle("verification_result", "verified refs", """
SELECT v.event_id, status, issues, coalesce(refs, '') AS refs FROM verified v LEFT JOIN refs r USING (event_id)""")
cte("op_texts", "keyed", """
SELECT event_id, string_agg(concat_ws('|', idempotency_key, layer, kind, dataset_id, coalesce(column_name, dataset_id),
  coalesce(CASE WHEN kind = 'DROP_COLUMN' THEN from_type ELSE to_type END, '-'), 'true', 'true'), ',' ORDER BY op_seq) AS texts
FROM keyed GROUP BY 1""")
oracle("success_event", "verified refs notifs op_texts", f"""
SELECT v.event_id, md5(coalesce(o.texts, '')) AS operations_md5, 'schema.evolved' AS event_type, v.dataset_id, source, {corr('correlation').replace('dataset_id', 'v.dataset_id').replace('event_id', 'v.event_id')} AS correlation_id,
  coalesce(producer_version, CASE WHEN v.n > 1 THEN v.n - 1 END) AS previous_version, v.n AS new_version, compatibility,
  {corr('plan').replace('dataset_id', 'v.dataset_id').replace('event_id', 'v.event_id')} AS plan_id, coalesce(operations, 0) AS operations,
  'success' AS lake_result, 'success' AS vault_result, status, coalesce(refs, '') AS refs
FROM verified v JOIN notifs n USING (event_id) LEFT JOIN refs r ON r.event_id = v.event_id
LEFT JOIN op_texts o ON o.event_id = v.event_id WHERE status = 'passed'""")
cte("failed", "decided verified", """
SELECT event_id, dataset_id, 'policy_denied' AS reason, reasons AS details FROM decided WHERE decision <> 'allow'
UNION ALL SELECT event_id, dataset_id, 'verification_failed', issues FROM verified WHERE status = 'failed'""")
oracle("failure_event", "failed", f"""
SELECT event_id, 'schema.evolution.failed' AS event_type, dataset_id, {corr('correlation')} AS correlation_id, reason, details FROM failed""")
oracle("outcome_route", "failed verified", """
SELECT event_type, key, reason, count(*) AS messages FROM (
  SELECT 'schema.evolved' AS event_type, dataset_id AS key, 'none' AS reason FROM verified WHERE status = 'passed'
  UNION ALL SELECT 'schema.evolution.failed', dataset_id, reason FROM failed) GROUP BY ALL""")

# --- replay ------------------------------------------------------------------------------
# The fold walks all datasets in step: one round of the recursion per position, carrying the
# last accepted header as parallel lists of names and types.

cte("lists", "notifs cur", f"""
SELECT n.event_id, n.dataset_id, n.n, n.requested_policy, n.verified, list(name ORDER BY i) AS names, list(eff ORDER BY i) AS types,
  list({family('eff')} ORDER BY i) AS fams
FROM notifs n JOIN cur c USING (event_id) GROUP BY ALL""")


def _fold(sandbox: str, verified: str) -> str:
    ok = f"""(({sandbox}) OR (list_has_all(l.names, f.names) AND
      len(list_filter(range(1, len(l.names) + 1), lambda k: list_position(f.names, l.names[k]) IS NOT NULL
        AND f.types[list_position(f.names, l.names[k])] <> l.types[k]
        AND f.fams[list_position(f.names, l.names[k])] <> l.fams[k]
        AND NOT list_contains([{', '.join(_text(p) for p in WIDENING_PAIRS)}], f.fams[list_position(f.names, l.names[k])] || '>' || l.fams[k]))) = 0))"""
    return f"""/*r*/
SELECT dataset_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS allowed, false AS accepted, CAST(NULL AS BIGINT) AS previous_seq,
  CAST(0 AS BIGINT) AS version, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS types, CAST([] AS VARCHAR[]) AS fams, CAST(NULL AS BIGINT) AS last_seq
FROM (SELECT DISTINCT dataset_id FROM lists)
UNION ALL
SELECT f.dataset_id, l.n, l.event_id, {ok}, {ok} AND {verified}, f.last_seq, f.version + CASE WHEN {ok} AND {verified} THEN 1 ELSE 0 END,
  CASE WHEN {ok} AND {verified} THEN l.names ELSE f.names END, CASE WHEN {ok} AND {verified} THEN l.types ELSE f.types END,
  CASE WHEN {ok} AND {verified} THEN l.fams ELSE f.fams END, CASE WHEN {ok} AND {verified} THEN l.event_id ELSE f.last_seq END
FROM {{self}} f JOIN lists l ON l.dataset_id = f.dataset_id AND l.n = f.n + 1"""


for _name, _sandbox, _verified in (
    ("production", "false", "true"),
    ("sandbox", "true", "l.verified"),
    ("requested", "coalesce(l.requested_policy, '') = 'sandbox'", "l.verified"),
):
    cte(f"fold_{_name}", "lists", _fold(_sandbox, _verified).replace("{self}", f"fold_{_name}"))
    oracle(f"replay_{_name}", f"fold_{_name}", f"""
SELECT dataset_id, seq, allowed, accepted, previous_seq, CASE WHEN accepted THEN version END AS new_version FROM fold_{_name} WHERE n > 0""")
oracle("version_history", "fold_requested", """
SELECT dataset_id, version, seq AS stored_seq, CAST(len(names) AS BIGINT) AS attribute_count FROM fold_requested WHERE accepted""")

# The same fold on numbered headers: which steps are allowed is decided once per pair of distinct headers of a dataset.


def _pairs(lists: str) -> str:
    changed = """list_filter(range(1, len(n.names) + 1), lambda k: list_position(p.names, n.names[k]) IS NOT NULL
      AND p.types[list_position(p.names, n.names[k])] <> n.types[k])"""
    narrowed = f"""list_filter({changed}, lambda k: p.fams[list_position(p.names, n.names[k])] <> n.fams[k]
      AND NOT list_contains([{', '.join(_text(x) for x in WIDENING_PAIRS)}], p.fams[list_position(p.names, n.names[k])] || '>' || n.fams[k]))"""
    return f"""
WITH heads AS (SELECT *, row_number() OVER (ORDER BY dataset_id, names, types, fams) AS h FROM (SELECT DISTINCT dataset_id, names, types, fams FROM {lists})),
before AS (SELECT * FROM heads UNION ALL SELECT DISTINCT dataset_id, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0 FROM heads)
SELECT dataset_id, p.h AS prev, n.h AS new, n.names, n.types, n.fams, list_has_all(n.names, p.names) AND len({narrowed}) = 0 AS ok,
  len({changed}) > 0 AS breaks,
  list_sort(list_concat(list_filter(n.names, lambda x: NOT list_contains(p.names, x)), list_transform({changed}, lambda k: n.names[k]))) AS changed
FROM before p JOIN heads n USING (dataset_id)"""


def _fold_on_ids(name: str, lists: str, needs: str, blocked: str = "false") -> None:
    """``blocked``: a condition on (dataset_id, changed) under which a breaking change has an impact."""
    cte(f"steps_{name}", f"pairs_{name} {needs}", f"""
SELECT dataset_id, new, list(prev) FILTER (ok AND NOT (breaks AND {blocked})) AS froms, any_value(names) AS names, any_value(types) AS types, any_value(fams) AS fams
FROM pairs_{name} GROUP BY dataset_id, new""")
    cte(f"rows_{name}", f"{lists} steps_{name}", f"""
SELECT l.dataset_id, l.n, l.event_id, s.new, coalesce(s.froms, []) AS froms, coalesce(l.requested_policy, '') = 'sandbox' AS free, l.verified
FROM {lists} l JOIN steps_{name} s USING (dataset_id, names, types, fams)""")
    ok = "(l.free OR l.new = f.state OR list_contains(l.froms, f.state))"
    cte(f"ids_{name}", f"rows_{name}", f"""/*r*/
SELECT DISTINCT dataset_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS allowed, false AS accepted, CAST(NULL AS BIGINT) AS previous_seq,
  CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS state, CAST(NULL AS BIGINT) AS last_seq FROM rows_{name}
UNION ALL
SELECT f.dataset_id, l.n, l.event_id, {ok}, {ok} AND l.verified, f.last_seq, f.version + CASE WHEN {ok} AND l.verified THEN 1 ELSE 0 END,
  CASE WHEN {ok} AND l.verified THEN l.new ELSE f.state END, CASE WHEN {ok} AND l.verified THEN l.event_id ELSE f.last_seq END
FROM ids_{name} f JOIN rows_{name} l ON l.dataset_id = f.dataset_id AND l.n = f.n + 1""")
    oracle(f"replay_{name}", f"ids_{name}", f"""
SELECT dataset_id, seq, allowed, accepted, previous_seq, CASE WHEN accepted THEN version END AS new_version FROM ids_{name} WHERE n > 0""")


cte("lists_hot_dataset", "lists", "SELECT * REPLACE ('lake.all' AS dataset_id, row_number() OVER (ORDER BY event_id) AS n) FROM lists")
cte("pairs_hot_dataset", "lists_hot_dataset", _pairs("lists_hot_dataset"))
_fold_on_ids("hot_dataset", "lists_hot_dataset", "")
cte("pairs_with_lineage", "lists", _pairs("lists"))
cte("asked_steps", "pairs_with_lineage", "SELECT DISTINCT dataset_id, changed FROM pairs_with_lineage WHERE ok AND breaks")
for _part in ("reach", "hits"):
    cte(f"{_part}_steps", "asked_steps reach_steps edges" if _part == "hits" else "asked_steps edges", CTES[_part][1].replace("FROM asked", "FROM asked_steps").replace("FROM reach r", "FROM reach_steps r"))
_fold_on_ids("with_lineage", "lists", "hits_steps", "(dataset_id, changed) IN (SELECT (dataset_id, changed) FROM hits_steps)")

# The message log holds the notifications that can be replayed: all but the kinds 0 to 6 of 101.
cte("logged", "lists", """
SELECT event_id, dataset_id, requested_policy, verified, names, types, fams, row_number() OVER (PARTITION BY dataset_id ORDER BY event_id) AS n
FROM lists WHERE event_id % 101 > 6""")
cte("fold_log", "logged", _fold("coalesce(l.requested_policy, '') = 'sandbox'", "l.verified").replace("{self}", "fold_log").replace("lists", "logged"))
oracle("replay_stream", "fold_log", """
SELECT dataset_id, seq, allowed, accepted, previous_seq, CASE WHEN accepted THEN version END AS new_version FROM fold_log WHERE n > 0""")
oracle("stream_registry", "fold_log", "SELECT dataset_id, version, seq AS stored_seq FROM fold_log WHERE accepted")
oracle("registry_latest", "fold_log", """
SELECT dataset_id, max(version) AS version, max_by(seq, version) AS stored_seq, CAST(max_by(len(names), version) AS INTEGER) AS attribute_count, 'col_0' AS primary_key
FROM fold_log WHERE accepted GROUP BY dataset_id""")
oracle("stream_registry_resumed", "fold_log", "SELECT dataset_id, version, seq AS stored_seq FROM fold_log WHERE accepted")

# --- tables and vault --------------------------------------------------------------------

oracle("lake_add_column", "", "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_channel FROM orders")
oracle("lake_drop_column", "", "SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM part")
oracle("lake_rename_column", "", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal AS c_balance, c_mktsegment FROM customer")
oracle("lake_change_type", "", """
SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(TRY_CAST(l_returnflag AS INTEGER) AS BIGINT) AS l_returnflag FROM lineitem""")
oracle("lossy_cast_report", "", """
SELECT 'l_quantity' AS column_name, 'integer' AS to_type, count(*) FILTER (l_quantity <> trunc(l_quantity)) AS lossy_rows, count(*) AS total_rows FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'bigint', count(*) FILTER (l_extendedprice <> trunc(l_extendedprice)), count(*) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'integer', count(*) FILTER (TRY_CAST(l_returnflag AS INTEGER) IS NULL), count(*) FROM lineitem
UNION ALL SELECT 'l_orderkey', 'integer', count(*) FILTER (TRY_CAST(l_orderkey AS INTEGER) IS NULL), count(*) FROM lineitem""")
oracle("apply_plan", "", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus AS o_status, o_orderdate, o_orderpriority, CAST(NULL AS BIGINT) AS o_channel FROM orders""")
oracle("compat_view", "", "SELECT o_orderkey, o_custkey, true AS price_missing, o_orderpriority FROM orders")
oracle("multi_version_read", "", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders""")


def _key(*columns: str) -> str:
    return _lengths([f"upper(trim(CAST({c} AS VARCHAR)))" for c in columns])


def _lengths(texts: list[str]) -> str:
    return "md5(" + " || ".join(f"coalesce(length({t}) || ':' || {t}, 'n')" for t in texts) + ")"


oracle("apply_plan_rows", "", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderdate, o_orderpriority, CAST(NULL AS VARCHAR) AS o_channel
FROM orders""")
oracle("vault_hub", "", f"""
SELECT DISTINCT {_key('l_partkey')} AS hub_hash, l_partkey AS business_key, 'lineitem' AS record_source FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
oracle("vault_link", "", f"""
SELECT DISTINCT {_key('l_orderkey', 'l_suppkey')} AS link_hash, {_key('l_orderkey')} AS l_orderkey_hash, {_key('l_suppkey')} AS l_suppkey_hash, 'lineitem' AS record_source
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND r.l_suppkey = l.l_suppkey)""")


def _diff_hash(*columns: str) -> str:
    return _lengths([f"CAST({c} AS VARCHAR)" for c in columns])


oracle("vault_satellite", "", f"""
SELECT {_key('user_id')} AS hub_hash, event_id AS load_seq, {_diff_hash('event_type')} AS hash_diff, event_type, 'events' AS record_source FROM events
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type""")
oracle("vault_satellite_evolved", "", f"""
SELECT {_key('user_id')} AS hub_hash, event_id AS load_seq, h AS hash_diff, event_type, level, 'events_v2' AS record_source
FROM (SELECT *, {_diff_hash('event_type', 'level')} AS h FROM (
  SELECT *, CASE WHEN value >= 10 THEN CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS level FROM events))
QUALIFY lag(h) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM h""")


# Texts with the separators that hashes could confuse: pieces around a bar, also at the ends.
cte("barred", "", """
SELECT doc_id, left(md5(text), 20) || '||' AS a, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '||' END || left(lang, 1) AS b FROM documents""")
oracle("vault_link_text", "barred", f"""
SELECT DISTINCT {_key('a', 'b')} AS link_hash, {_key('a')} AS a_hash, {_key('b')} AS b_hash FROM (
  SELECT a, b FROM barred UNION ALL SELECT left(a, length(a) - 2), '||' || b FROM barred) WHERE a IS NOT NULL AND b IS NOT NULL""")
oracle("vault_satellite_text", "barred", f"""
SELECT {_key('lang')} AS hub_hash, load_seq, {_diff_hash('a', 'b')} AS hash_diff FROM (
  SELECT doc_id % 7 AS lang, 2 * doc_id AS load_seq, a, b FROM barred
  UNION ALL SELECT doc_id % 7, 2 * doc_id + 1, left(a, length(a) - 2), '||' || b FROM barred)
WINDOW w AS (PARTITION BY lang ORDER BY load_seq)
QUALIFY lag(load_seq) OVER w IS NULL OR lag(a) OVER w IS DISTINCT FROM a OR lag(b) OVER w IS DISTINCT FROM b""")


def _probe() -> str:
    parents = {"regionkey": ("region", "r_regionkey"), "nationkey": ("nation", "n_nationkey"), "custkey": ("customer", "c_custkey"),
               "suppkey": ("supplier", "s_suppkey"), "partkey": ("part", "p_partkey"), "orderkey": ("orders", "o_orderkey")}
    out = []
    for child, cols in _STAR.items():
        for c in cols.split():
            parent = parents.get(c.split("_", 1)[1])
            if parent and parent[0] != child:
                t, k = parent
                out.append(f"""SELECT '{child}' AS table_name, 'link_{child}_{t}' AS name, '{c}' AS key_column, '{t}' AS parent_table, '{k}' AS parent_key,
  count(DISTINCT {c}) AS distinct_values FROM {child}
HAVING NOT EXISTS (SELECT {c} FROM {child} WHERE {c} IS NOT NULL EXCEPT SELECT {k} FROM {t}) AND (SELECT count(*) = count(DISTINCT {k}) FROM {t})""")
    return " UNION ALL ".join(out)


oracle("link_probe", "", _probe())

_WHOLE_NUMBERS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}
oracle("link_probe_any_name", "", " UNION ALL ".join(
    f"""SELECT '{child}' AS table_name, '{c}' AS key_column, '{parent}' AS parent_table, '{k}' AS parent_key, count(DISTINCT {c}) AS distinct_values
FROM {child} HAVING count({c}) > 0 AND NOT EXISTS (SELECT {c} FROM {child} WHERE {c} IS NOT NULL EXCEPT SELECT {k} FROM {parent})
  AND (SELECT count(*) = count(DISTINCT {k}) FROM {parent})"""
    for child, columns in _WHOLE_NUMBERS.items() for c in columns
    for parent, keys in _WHOLE_NUMBERS.items() for k in keys if parent != child
))
