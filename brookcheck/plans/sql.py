"""DuckDB text that the registered queries' SQL shares: the fixtures, and what each operator makes of them."""

from __future__ import annotations

import json

from .fixtures import BINDINGS, EVENTS, RECORDS, RULES_A, RULES_B, SCOPES, SOURCES


def _duck(text: str) -> str:
    return text.replace("{S}", "VARCHAR").replace("{{", "{").replace("}}", "}")


def _canonical(v: str) -> str:
    """The document of a fixture version as canonical JSON, written out independently."""
    rules = []
    for n, f, o, x, s in RULES_A if v == "a" else RULES_B:
        rules.append({"name": n, "field": f, "operator": o} | ({"expected_value": x} if x else {}) | ({"severity": s} if s else {}))
    doc = {"metadata": {"name": f"set-{v}"}, "bindings": [{"name": n, "topic": t} for n, t, k in BINDINGS if k == v], "fields": [{"name": n, "type": "string"} for n in ("user_id", "event_type", "tags")], "rules": rules}
    return json.dumps(doc, separators=(",", ":"))


_B = ", ".join(f"('{n}', '{t}', '{SCOPES[v][0]}', '{SCOPES[v][1]}', 'set-{v}', 'key-{v}', 'ver-{v}', 1, '{v}')" for n, t, v in BINDINGS)

REC = f"""rec0 AS ({_duck(RECORDS)}),
rec AS (SELECT *, off AS seq FROM rec0 UNION ALL SELECT *, off + 10000000 FROM rec0 WHERE off % 50 = 0)"""

MSG = f"""{REC},
ck(v, definition_checksum) AS (VALUES ('a', sha256('{_canonical("a")}')), ('b', sha256('{_canonical("b")}'))),
b0(binding_name, btopic, scope_kind, scope_key, set_id, config_key, version_id, version, v) AS (VALUES {_B}),
b AS (SELECT b0.* EXCLUDE (version), CAST(version AS BIGINT) AS version, definition_checksum FROM b0 JOIN ck USING (v)),
m AS (SELECT rec.*, b.* EXCLUDE (btopic), 'kafka:' || topic || ':' || part || ':' || off || ':' || scope_kind || ':' || scope_key || ':' || version_id || ':' || binding_name AS message_id FROM rec JOIN b ON topic = btopic),
mj AS (SELECT *, coalesce(correlation_header, message_id) AS correlation_id, try_cast(payload AS JSON) AS j FROM m)"""

RES = f"""{MSG},
ob AS (SELECT *, json_extract_string(j, '$.event_type') AS et FROM mj WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
fl AS (SELECT *, v = 'a' AND coalesce(json_type(j, '$.user_id'), 'NULL') = 'NULL' AS bad_user, v = 'a' AND trim(et) = '' AS bad_type, v = 'a' AND json_array_length(j, '$.tags') = 0 AS bad_tags, v = 'b' AND trim(et) <> 'purchase' AS bad_purchase FROM ob),
res AS (SELECT *, message_id || '|' || scope_kind || '|' || scope_key || '|' || binding_name || '|' || topic || '|' || version_id || '|' || definition_checksum AS processing_key,
  CASE WHEN bad_user OR bad_type OR bad_tags OR bad_purchase THEN 'failed' ELSE 'passed' END AS status, published_at + INTERVAL 1 SECOND AS processed_at,
  concat_ws(',', CASE WHEN bad_user THEN 'user:user_id:required:error:field is required' END, CASE WHEN bad_type THEN 'type:event_type:not_empty:error:field must not be empty' END, CASE WHEN bad_tags THEN 'tags:tags:not_empty:warn:field must not be empty' END, CASE WHEN bad_purchase THEN 'is_purchase:event_type:equals:error:field must equal expected value' END) AS violations,
  concat_ws(',', CASE WHEN bad_purchase THEN 'is_purchase:event_type:equals:error' END, CASE WHEN bad_tags THEN 'tags:tags:not_empty:warn' END, CASE WHEN bad_type THEN 'type:event_type:not_empty:error' END, CASE WHEN bad_user THEN 'user:user_id:required:error' END) AS fingerprint,
  CAST(bad_user AS INT) + CAST(bad_type AS INT) + CAST(bad_tags AS INT) + CAST(bad_purchase AS INT) AS n_violations FROM fl),
rk AS (SELECT *, 'validation.rule_violation|' || scope_kind || '|' || scope_key || '|' || binding_name || '|' || topic || '|' || version_id || '|' || fingerprint AS incident_key FROM res)"""

LATEST = f"""{RES},
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY processing_key ORDER BY seq DESC) AS rn FROM rk) WHERE rn = 1)"""

INC = f"""{LATEST},
ir AS (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY processed_at DESC, seq DESC) AS rn FROM latest WHERE status = 'failed'),
inc AS (SELECT incident_key, count(*) AS count, min(processed_at) AS first_seen_at, max(processed_at) AS last_seen_at, max(seq) AS max_seq, max(CASE WHEN rn = 1 THEN message_id END) AS latest_message_id, max(CASE WHEN rn = 1 THEN correlation_id END) AS latest_correlation_id,
  max(CASE WHEN rn = 1 THEN binding_name END) AS binding_name, max(CASE WHEN rn = 1 THEN topic END) AS topic, max(CASE WHEN rn = 1 THEN scope_kind END) AS scope_kind, max(CASE WHEN rn = 1 THEN scope_key END) AS scope_key, max(CASE WHEN rn = 1 THEN violations END) AS violations FROM ir GROUP BY incident_key)"""

SRC = f"""src AS ({_duck(SOURCES)}),
k AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey, config_key, lower(trim(format)) AS format, trim(content) AS content FROM src JOIN customer USING (c_custkey)),
diag AS (SELECT *, CASE WHEN content = '' OR format = 'xml' THEN concat_ws(';', CASE WHEN content = '' THEN 'source.content=must not be empty' END, CASE WHEN format = 'xml' THEN 'source.format=must be one of json or yaml' END)
  WHEN content = '{{bad' THEN 'source.content=must be valid ' || upper(format)
  ELSE concat_ws(';', CASE WHEN k % 11 = 0 THEN 'metadata.name=must not be empty' END, CASE WHEN k % 13 = 0 THEN 'bindings=must contain at least one binding' END,
    CASE WHEN k % 13 <> 0 AND k % 17 = 0 THEN 'bindings[1].topic=must not be empty' END, CASE WHEN k % 13 <> 0 AND k % 7 = 0 THEN 'bindings[1].name=must be unique' END,
    CASE WHEN k % 19 = 0 THEN 'fields[1].type=must be one of string, integer, number, boolean or timestamp' END, CASE WHEN k % 5 = 0 THEN 'rules[1].field=must reference an existing field' END,
    CASE WHEN k % 4 = 2 THEN 'rules[1].operator=must be one of required, not_empty or equals' END, CASE WHEN k % 3 <> 0 AND k % 23 = 0 THEN 'rules[1].severity=must be one of error or warn' END,
    CASE WHEN k % 8 = 0 THEN 'rules[1].expected_value=must not be empty when operator is equals' END) END AS diagnostics FROM k),
op AS (SELECT *, CASE k % 4 WHEN 0 THEN 'equals' WHEN 1 THEN 'not_empty' WHEN 2 THEN 'matches' ELSE 'required' END AS op2 FROM diag),
canon AS (SELECT *, sha256('{{"metadata":{{"name":"' || c_name || '","description":"d","labels":{{"seg":"' || c_mktsegment || '"}}}},"bindings":[{{"name":"b1","topic":"t' || c_nationkey || '"}},{{"name":"b2","topic":"u' || c_nationkey
  || '"}}],"fields":[{{"name":"id","type":"string","required":true}},{{"name":"amount","type":"number"}}],"rules":[{{"name":"r1","field":"id","operator":"required"}},{{"name":"r2","field":"amount","operator":"' || op2 || '"'
  || CASE WHEN k % 8 = 0 THEN '' ELSE ',"expected_value":"\\u003c5\\u003e"' END || CASE WHEN k % 3 = 0 THEN ',"severity":"warn"' ELSE '' END || '}}]}}') AS definition_checksum FROM op)"""

EV = f"""ev AS MATERIALIZED ({_duck(EVENTS)}),
e AS MATERIALIZED (SELECT * EXCLUDE (scope_kind, scope_key), coalesce(nullif(lower(trim(scope_kind)), ''), 'global') AS scope_kind, coalesce(nullif(trim(scope_key), ''), 'default') AS scope_key FROM ev WHERE trim(event_id) <> '')"""

IV = f"""{EV},
ad AS MATERIALIZED (SELECT *, coalesce(CASE WHEN event = 'config.activated' THEN activated_at ELSE deactivated_at END, occurred_at) AS pos FROM e WHERE event IN ('config.activated', 'config.deactivated')),
ad2 AS (SELECT *, first_value(CASE WHEN event = 'config.activated' THEN pos END IGNORE NULLS) OVER (PARTITION BY scope_kind, scope_key ORDER BY pos, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
  first_value(CASE WHEN event = 'config.deactivated' THEN pos END IGNORE NULLS) OVER (PARTITION BY scope_kind, scope_key, version_id ORDER BY pos, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM ad),
iv AS MATERIALIZED (SELECT set_id, config_key, version_id, version, scope_kind, scope_key, pos AS activated_at, least(nxt, stop) AS deactivated_at, seq FROM ad2 WHERE event = 'config.activated')"""

STATE = "CASE event WHEN 'config.draft_created' THEN 'draft' WHEN 'config.validated' THEN 'validated' WHEN 'config.compiled' THEN 'compiled' WHEN 'config.activated' THEN 'active' WHEN 'config.deactivated' THEN 'inactive' WHEN 'config.archived' THEN 'archived' WHEN 'config.rejected' THEN 'rejected' END"

VER = f"""{IV},
st AS (SELECT *, {STATE} AS state, row_number() OVER (PARTITION BY version_id ORDER BY occurred_at DESC, seq DESC) AS rn FROM e),
held AS MATERIALIZED (SELECT DISTINCT version_id AS held_id FROM iv WHERE deactivated_at IS NULL),
life AS MATERIALIZED (SELECT version_id, set_id, config_key, version, CASE WHEN state = 'inactive' AND held_id IS NOT NULL THEN 'active' ELSE state END AS lifecycle, occurred_at AS updated_at FROM st LEFT JOIN held ON held_id = version_id WHERE rn = 1),
ver AS MATERIALIZED (SELECT l.version_id, l.set_id, l.config_key, l.lifecycle, d.occurred_at AS created_at, row_number() OVER (PARTITION BY l.set_id ORDER BY d.occurred_at, d.seq) AS version FROM life l JOIN e d ON d.version_id = l.version_id AND d.event = 'config.draft_created')"""

RUN = f"""{VER},
act AS (SELECT version_id, string_agg(DISTINCT scope_kind || '/' || scope_key, ',' ORDER BY scope_kind || '/' || scope_key) AS scopes FROM iv WHERE deactivated_at IS NULL GROUP BY version_id),
rt AS MATERIALIZED (SELECT iv.*, 'artifact-' || iv.version_id AS artifact_id, md5(iv.version_id) AS artifact_checksum, md5('d' || iv.version_id) AS definition_checksum FROM iv JOIN ver USING (version_id) WHERE deactivated_at IS NULL),
bd AS (SELECT rt.*, x.binding_name, CASE x.binding_name WHEN 'orders' THEN 't.' || set_id ELSE 't.audit' END AS topic FROM rt, (VALUES ('orders'), ('audit')) x(binding_name))"""
