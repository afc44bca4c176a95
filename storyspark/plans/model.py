"""The story model over the driver's tables: one ANSI query per model table, read by Spark and DuckDB alike.

Model tables stand in for notes, entities, edges, folders, threads and so on; the operators never see
the driver's tables. Only @MS(x), milliseconds since 1970 of a timestamp, differs between the dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

MODEL = {
    "note_versions": """
        SELECT d.doc_id AS id, v.version, 'w' || (d.doc_id % 3) AS world_id, lower(substring(d.text, 1, 20)) || ' v' || v.version AS title,
               d.text AS content, d.source AS folder_id, d.lang AS narrative_id, d.n_chars, d.doc_id % 4 = 0 AS is_entity,
               (d.doc_id * 37) % 1000 * 1000 AS ord, d.doc_id * 1000 AS created_at, d.doc_id * 1000 + v.version * 100 - 100 AS valid_from,
               CASE WHEN v.version = 1 + d.doc_id % 3 THEN NULL ELSE d.doc_id * 1000 + v.version * 100 END AS valid_to,
               v.version = 1 + d.doc_id % 3 AS is_current
        FROM documents d JOIN (VALUES (1), (2), (3)) AS v(version) ON v.version <= 1 + d.doc_id % 3""",
    "notes": "SELECT * FROM note_versions WHERE is_current",
    "tales": """
        SELECT id, narrative_id, CASE id % 6
          WHEN 0 THEN '[CHARACTER|Hero ' || id || '] ->KNOWS-> [PLACE|Town ' || (id % 17) || ']'
          WHEN 1 THEN '[CHARACTER|Hero ' || id || '|{age: ' || (id % 80) || '}] (guards) [ITEM|Ring ' || (id % 5) || '] near [PLACE:CITY|Town ' || (id % 17) || ']'
          WHEN 2 THEN '[PLACE|Town ' || (id % 17) || '] <-LEFT<- [CHARACTER|Hero ' || id || '] [EVENT|Fall] <- [EVENT|War]'
          WHEN 3 THEN '[CHARACTER|Hero ' || id || '->LOVES->Dame ' || (id % 7) || '] and [[Hero ' || id || ']] -> <<Book|shown>>'
          WHEN 4 THEN '[[Hero ' || id || ']] (LIKES) <-> [[Town ' || (id % 17) || ']] <- <<Note ' || id || '>>'
          ELSE '[CHARACTER:KNIGHT|Hero ' || id || '] -> [PLACE|Town ' || (id % 17) || '] [CHARACTER|A] -> [CHARACTER|B]' END
          || '. ' || (id % 12) || ' days later, The following morning, #tag' || folder_id || ' @user_' || narrative_id || ' left two weeks ago; yesterday. Meanwhile [[' || title || '|seen]] and <<'
          || folder_id || '>>. The ring was sent to Rome, and nobody would help him. ' || content AS t FROM notes""",
    "folders": """
        SELECT 'r' || r_regionkey AS id, r_name AS name, CAST(NULL AS varchar(40)) AS parent_id, 'w0' AS world_id, r_regionkey * 1000 AS ord,
               CASE WHEN r_regionkey % 2 = 0 THEN 'nar' || r_regionkey END AS narrative_id, '{"level": "region"}' AS meta FROM region
        UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 'w' || (n_nationkey % 2), n_nationkey * 1000,
               CASE WHEN n_nationkey % 5 = 3 THEN 'narn' || n_nationkey END, '{"level": "nation", "code": ' || n_nationkey || '}' FROM nation
        UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey, 'w' || (c_custkey % 2), c_custkey * 1000, NULL,
               '{"level": "customer", "segment": "' || c_mktsegment || '"}' FROM customer""",
    "hierarchy": """
        SELECT parent_id AS parent, id AS child, ord AS created_at, 'narrative:' || world_id AS group_id,
               CASE WHEN ord % 7000 = 3000 THEN ord + 5 END AS invalid_at FROM folders WHERE parent_id IS NOT NULL""",
    "entities": """
        SELECT 'p' || p_partkey AS id, p_name || ' ' || p_partkey AS label, p_type AS kind, p_brand AS subtype, p_size AS mentions,
               CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'nar' || (p_size % 5) END AS narrative_id, p_partkey * 3 % 1000 AS first_note,
               CASE WHEN p_partkey % 3 = 0 THEN 'user' ELSE 'auto' END AS created_by, p_partkey * 10 AS created_at, p_retailprice AS price FROM part""",
    "aliases": """
        SELECT 'p' || p_partkey AS entity_id, p_brand || ' ' || p_partkey AS alias FROM part
        UNION ALL SELECT 'p' || p_partkey, 'The ' || p_name || ' ' || p_partkey FROM part WHERE p_partkey % 2 = 0""",
    "provenance": """
        SELECT 'p' || l_partkey || '|' || l_returnflag || l_linestatus || '|' || 'p' || ((l_partkey * 7 + l_suppkey + 1) % 200) AS rel_id,
               'p' || l_partkey AS source_id, 'p' || ((l_partkey * 7 + l_suppkey + 1) % 200) AS target_id, l_returnflag || l_linestatus AS rel_type,
               CASE l_linenumber % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'scanner' ELSE 'llm' END AS origin, l_orderkey % 1000 AS note_id,
               round(1 - l_discount, 2) AS confidence, @MS(l_shipdate) AS created_at FROM lineitem""",
    "edges": """
        SELECT rel_id AS id, min(source_id) AS source_id, min(target_id) AS target_id, min(rel_type) AS rel_type, max(confidence) AS confidence,
               count(*) AS weight, min(note_id) AS source_note, min(created_at) AS created_at FROM provenance GROUP BY rel_id""",
    "mentions": """
        SELECT 'p' || l_partkey AS entity_id, l_orderkey % 1000 AS note_id, CAST(sum(l_quantity) AS bigint) AS n FROM lineitem
        GROUP BY l_partkey, l_orderkey % 1000""",
    "sentence_mentions": """
        SELECT DISTINCT l_orderkey AS episode_id, l_partkey AS entity_id, l_linenumber AS sentence_index,
               'narrative:n' || (l_orderkey % 3) AS group_id, l_orderkey % 1000 AS note_id FROM lineitem""",
    "episodes": """
        SELECT event_id AS id, 'u' || user_id AS scope_id, event_id % 1000 AS note_id, @MS(ts) AS ts, event_type AS action,
               'p' || (event_id % 200) AS target_id, props AS payload, value, 'nar' || (user_id % 5) AS narrative_id FROM events""",
    "told": """
        SELECT 'u' || user_id AS scope_id, CAST(event_id AS int) AS place, CASE event_id % 7 WHEN 0 THEN upper(p_name) || ' ' || p_partkey WHEN 1 THEN lower(p_brand) || ' ' || p_partkey
               WHEN 2 THEN split_part(p_name, ' ', 1) || ' ' || p_partkey WHEN 3 THEN 'the  old ' || p_name WHEN 4 THEN 'nobody ' || event_id % 3 WHEN 5 THEN 'It' ELSE 'she' END AS text
        FROM events JOIN part ON p_partkey = 1 + event_id % 200""",
    "claims": """
        SELECT e.id, 'the ' || source_id || '.' AS subject, 'old ' || target_id AS object, CASE WHEN weight % 4 = 0 THEN '' ELSE 'The ' || upper(source_id) || '. said: ' END || content
               || CASE WHEN (weight + e.created_at / 86400000) % 3 < 1 THEN '' ELSE ' to the old ' || target_id || ' there. The ' || source_id || '.' END AS t FROM edges e JOIN notes n ON n.id = e.source_note""",
    "rumours": """
        SELECT id, upper(source_id) || CASE rel_type WHEN 'AF' THEN ' attacks ' WHEN 'NO' THEN ' visits ' WHEN 'RF' THEN ' hears ' ELSE ' helps ' END || upper(target_id) || '. Then They give ' || upper(target_id) || 'x.' AS t
        FROM edges""",
    "threads": """
        SELECT 't' || conv_id AS id, 'w' || (conv_id % 3) AS world_id, 'nar' || (conv_id % 5) AS narrative_id, min(conv_id) * 100 AS created_at,
               max(conv_id * 100 + turn) AS updated_at FROM conversations GROUP BY conv_id""",
    "messages": """
        SELECT 't' || conv_id || '-' || turn AS id, 't' || conv_id AS thread_id, role, text AS content, conv_id * 100 + turn AS created_at FROM conversations""",
    "memories": """
        SELECT 'm' || conv_id || '-' || turn AS id, text AS content,
               CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'event' END AS memory_type, role AS source_role,
               'p' || (conv_id % 200) AS entity_id, conv_id * 100 + turn AS created_at FROM conversations WHERE role <> 'system'""",
    "memory_threads": """
        SELECT 'm' || conv_id || '-' || turn AS memory_id, 't' || conv_id AS thread_id, 't' || conv_id || '-' || turn AS message_id
        FROM conversations WHERE role <> 'system'""",
    "artifacts": """
        SELECT 'k' || (o_orderkey % 50) AS key, 't' || (o_custkey % 20) AS thread_id, 'nar' || (o_custkey % 5) AS narrative_id, o_orderpriority AS folder_id,
               o_orderstatus AS kind, '{"price": ' || CAST(o_totalprice AS decimal(18, 2)) || '}' AS payload, o_orderkey % 11 = 0 AS pinned,
               o_orderkey AS created_at, @MS(o_orderdate) + o_orderkey AS updated_at FROM orders""",
    "om_generations": """
        SELECT 't' || (o_custkey % 100) AS thread_id, o_orderkey AS id, o_orderkey % 40 AS generation, CAST(floor(o_totalprice) AS bigint) AS input_tokens,
               CAST(floor(o_totalprice) AS bigint) % 500 AS output_tokens FROM orders""",
    "blocks": "SELECT vec_id AS id, vec_id % 100 AS note_id, vec_id AS ord, embedding AS vec, 'nar' || label AS narrative_id, label FROM embeddings",
    "cluster_members": """
        SELECT 'cl' || label AS cluster_id, 'p' || (vec_id % 200) AS entity_id, vec_id, round(CAST(embedding[0] AS double), 6) AS similarity FROM embeddings""",
    "clusters": "SELECT 'cl' || label AS id, 'topic ' || label AS name, min(vec_id) AS created_at FROM embeddings GROUP BY label",
    "networks": """
        SELECT 'net' || n_nationkey AS id, n_name AS name, 'kind' || n_regionkey AS kind, 'n' || n_nationkey AS root_folder, 'ns' || (n_nationkey % 3) AS namespace FROM nation""",
    "members": """
        SELECT 'net' || c_nationkey AS network_id, 'c' || c_custkey AS entity_id, CASE WHEN c_custkey % 10 = 0 THEN 'root' ELSE 'member' END AS role,
               c_custkey * 5 AS joined_at, CASE WHEN c_acctbal < 0 THEN c_custkey * 5 + 50 END AS left_at FROM customer""",
    "net_rels": """
        SELECT 'net' || s_nationkey AS network_id, 's' || s_suppkey AS source_id, 's' || (s_suppkey * 3 + 1) % 100 AS target_id,
               'code' || (s_suppkey % 4) AS code, round(s_acctbal / 10000, 4) AS strength FROM supplier""",
    "metadata": """
        SELECT 'p' || p_partkey AS entity_id, 'brand' AS key, '"' || p_brand || '"' AS value FROM part
        UNION ALL SELECT 'p' || p_partkey, 'size', '' || p_size FROM part UNION ALL SELECT 'p' || p_partkey, 'type', '"' || p_type || '"' FROM part WHERE p_size > 5""",
    "note_tags": """
        SELECT doc_id AS note_id, 'lang-' || lang AS tag FROM documents UNION ALL SELECT doc_id, 'src-' || source FROM documents
        UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1""",
    "ws_nodes": "SELECT 'e' || event_id AS id, 'u' || user_id AS ws_id, event_type AS kind, props AS json, event_id AS created_at FROM events",
    "ws_edges": """
        SELECT 'e' || event_id AS source_id, 'e' || (event_id + user_id + 1) AS target_id, 'u' || user_id AS ws_id, 'next' AS kind FROM events""",
    "calendar": """
        SELECT o_orderkey AS id, 'cal' || (o_custkey % 7) AS calendar_id, CAST(extract(year FROM o_orderdate) AS int) - 1995 AS y,
               CAST(extract(month FROM o_orderdate) AS int) - 1 AS m, CAST(extract(day FROM o_orderdate) AS int) - 1 AS d, o_orderpriority AS name FROM orders""",
    "chapters": "SELECT n_nationkey AS id, n_regionkey AS act, n_name AS title, n_nationkey * 10 AS rank_no FROM nation",
    "spans": """
        SELECT l_orderkey * 10 + l_linenumber AS id, CAST(floor(l_orderkey / 32) AS bigint) AS note_id, CAST(l_quantity AS int) * 7 + l_linenumber AS from_pos,
               CAST(l_quantity AS int) * 7 + l_linenumber + CAST(l_discount * 100 AS int) + 1 AS to_pos, l_linestatus AS origin, 'p' || l_partkey AS entity_id
        FROM lineitem""",
}

_USED = {name: [t for t in [*SOURCES, *MODEL] if t != name and re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)] for name, text in MODEL.items()}


class Model:
    """Tables of the model, and of the driver, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in MODEL:
            text = re.sub(r"@MS\((\w+)\)", r"unix_millis(CAST(\1 AS timestamp))", MODEL[name])
            text = text.replace("{", "{{").replace("}", "}}")
            for t in _USED[name]:
                text = re.sub(rf"((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", text)
            df = self.spark.sql(text, **{t: getattr(self, t) for t in _USED[name]})
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df


def oracle(sql: str) -> str:
    """sql with the model tables that it names as common table expressions, in DuckDB's dialect."""
    needed: list[str] = []

    def need(text: str) -> None:
        for t in MODEL:
            if re.search(rf"\b{t}\b", text) and t not in needed:
                for u in _USED[t]:
                    if u in MODEL:
                        need(u)
                if t not in needed:
                    needed.append(t)

    need(sql)
    ctes = [f"{t} AS ({re.sub(r'@MS\((\w+)\)', r'(epoch_us(\1) // 1000)', MODEL[t]).replace('embedding[0]', 'embedding[1]')})" for t in needed]
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(ctes) + " " + body
