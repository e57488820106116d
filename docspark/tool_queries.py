"""Registered queries of the tools: each calls one tool on offline tables that are projections of the driver's, with SQL of the same rows.

A table is one SELECT that Spark and DuckDB both read; ``{x}`` names a driver's table. In a tool's SQL ``{T}`` stands for its table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.plans.catalog import ALL, Catalog
from docspark.sources.pages import read_table

_K = "'K-' || CAST(o_orderkey AS STRING)"
TABLES = {
    "issues": f"""SELECT {_K} AS issue_key, 'P' || CAST(o_orderkey % 5 AS STRING) AS project_key, o_orderpriority AS issue_type, 'order ' || o_orderstatus || ' ' || CAST(o_orderkey % 97 AS STRING) AS summary,
 CASE WHEN o_custkey % 7 <> 0 THEN 'c' || CAST(o_custkey % 50 AS STRING) END AS assignee, CAST(NULL AS STRING) AS epic_key, CASE WHEN o_orderkey % 100 = 7 THEN 'K-11' END AS parent_key,
 CAST(o_orderkey % 3 AS INT) AS transition_id FROM {{orders}}""",
    "comments": "SELECT 'K-' || CAST(conv_id AS STRING) AS issue_key, role AS author, text AS body FROM {conversations}",
    "sprint_issues": f"SELECT CAST(o_orderkey % 10 AS INT) AS sprint_id, {_K} AS issue_key FROM {{orders}}",
    "watchers": "SELECT 'K-' || CAST(l_orderkey AS STRING) AS issue_key, 'u' || CAST(l_suppkey % 20 AS STRING) AS username FROM {lineitem}",
    "worklogs": "SELECT 'K-' || CAST(l_orderkey AS STRING) AS issue_key, CAST(l_linenumber AS STRING) || 'h' AS time_spent, l_returnflag AS comment, l_linestatus AS started FROM {lineitem}",
    "issue_links": f"SELECT o_orderkey AS link_id, 'Blocks' AS type, {_K} AS inward, 'K-' || CAST(o_orderkey + 1 AS STRING) AS outward FROM {{orders}}",
    "link_types": "SELECT 'T' || CAST(r_regionkey AS STRING) AS name, 'in ' || r_name AS inward, 'out ' || r_name AS outward, r_regionkey AS ord FROM {region}",
    "remote_links": "SELECT 'K-' || CAST(page_id AS STRING) AS issue_key, url, 'page' AS title FROM {pages}",
    "sprints": """SELECT n_nationkey AS sprint_id, n_name AS name, n_regionkey AS board_id, CASE WHEN n_nationkey % 2 = 0 THEN 'active' ELSE 'closed' END AS state,
 CAST(NULL AS STRING) AS start_date, CAST(NULL AS STRING) AS end_date, CAST(NULL AS STRING) AS goal FROM {nation}""",
    "versions": "SELECT 'P' || CAST(n_regionkey AS STRING) AS project_key, n_name AS name, CAST(NULL AS STRING) AS description, n_nationkey % 2 = 0 AS released FROM {nation}",
    "issue_attachments": "SELECT 'K-' || CAST(page_id % 40 AS STRING) AS issue_key, url AS file_name, CAST(length(html) AS BIGINT) AS size FROM {pages}",
    "backlog": f"SELECT {_K} AS issue_key, CAST(o_custkey % 4 AS INT) AS board_id FROM {{orders}}",
    "changelog": "SELECT 'K-' || CAST(user_id AS STRING) AS issue_key, event_id, event_type AS field, props AS new_value FROM {events}",
    "current_user": "SELECT r_name AS username, r_regionkey AS id FROM {region} WHERE r_regionkey = 0",
    "components": "SELECT 'P' || CAST(n_regionkey AS STRING) AS project_key, n_name AS name FROM {nation}",
    "statuses": "SELECT 'P' || CAST(n_regionkey AS STRING) AS project_key, lower(n_name) AS status FROM {nation}",
    "transitions": "SELECT 'K-' || CAST(n_regionkey AS STRING) AS issue_key, n_nationkey AS transition_id, n_name AS name FROM {nation}",
    "templates": "SELECT CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'Type' || CAST(n_regionkey AS STRING) END AS issue_type, n_name AS body, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE 'flow ' || n_name END AS workflow FROM {nation}",
    "users": "SELECT 'c' || CAST(c_custkey AS STRING) AS username, c_name AS display_name, 'P' || CAST(c_nationkey % 5 AS STRING) AS project_key FROM {customer}",
    "boards": "SELECT n_nationkey AS board_id, 'P' || CAST(n_regionkey AS STRING) AS project_key, n_name AS name FROM {nation}",
    "projects": "SELECT 'P' || CAST(c_custkey AS STRING) AS project_key, c_name AS name FROM {customer}",
    "team": "SELECT s_name AS username, s_suppkey AS id FROM {supplier}",
    "fields": "SELECT p_brand AS id, p_name AS name, p_partkey AS n FROM {part}",
    "page_comments": "SELECT CAST(conv_id AS STRING) AS page_id, CAST(NULL AS STRING) AS parent_comment_id, text AS body FROM {conversations}",
    "page_labels": "SELECT CAST(doc_id AS STRING) AS page_id, {array}(lang, source) AS labels FROM {documents}",
    "page_attachments": "SELECT page_id AS attachment_id, CAST(page_id % 30 AS STRING) AS page_id, 'f' || CAST(page_id AS STRING) || '.png' AS name FROM {pages}",
    "pages": """SELECT CAST(c_custkey AS STRING) AS page_id, c_name AS title, 'http://w/p/' || CAST(c_custkey AS STRING) AS url, c_mktsegment AS version_when,
 '<p>about ' || lower(c_mktsegment) || '</p><p>second</p>' AS storage, 'S' || CAST(c_nationkey % 5 AS STRING) AS space FROM {customer}""",
    "edges": "SELECT CAST(c_custkey // 8 AS STRING) AS parent_id, CAST(c_custkey AS STRING) AS child_id, c_name AS title, CAST(c_custkey % 8 AS INT) AS ord FROM {customer} WHERE c_custkey > 0",
    "page_versions": "SELECT CAST(conv_id AS STRING) AS page_id, CAST(turn AS INT) AS version, text FROM {conversations}",
    "default_space": "SELECT r_name AS space, r_regionkey AS id FROM {region} WHERE r_regionkey = 1",
    "wiki_users": "SELECT 'k' || CAST(s_suppkey AS STRING) AS user_key, s_name AS display_name FROM {supplier}",
    "spaces": "SELECT 'S' || CAST(c_custkey AS STRING) AS key, c_name AS name FROM {customer}",
    "repo_files": """SELECT 'P' || CAST(doc_id % 3 AS STRING) AS project_key, 'r' || lang AS repo_slug, source AS folder, source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, 'main' AS at, text AS content FROM {documents}""",
    "pull_requests": "SELECT o_orderkey AS id, 'P' || CAST(o_orderkey % 3 AS STRING) AS project_key, 'r' || CAST(o_orderkey % 2 AS STRING) AS repo_slug, CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'MERGED' END AS state FROM {orders}",
    "pull_request_activities": "SELECT l_orderkey AS id, l_linenumber AS ord, 'P1' AS project_key, 'r1' AS repo_slug, l_partkey AS part, l_returnflag AS action FROM {lineitem}",
    "pull_request_diffs": "SELECT page_id AS id, 'P1' AS project_key, 'r1' AS repo_slug, url AS diff FROM {pages}",
    "repositories": "SELECT 'r' || CAST(n_nationkey AS STRING) AS repo_slug, 'P' || CAST(n_regionkey AS STRING) AS project_key, n_name AS name FROM {nation}",
    "code_projects": "SELECT 'C' || CAST(s_suppkey AS STRING) AS project_key, s_name AS name FROM {supplier}",
}

#: Spark's spelling of what DuckDB spells otherwise.
_SPARK = (("{array}", "array"), ("c_custkey // 8", "c_custkey div 8"))
_DUCK = (("{array}", "list_value"),)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def spark_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = TABLES[name]
    for a, b in _SPARK:
        sql = sql.replace(a, b)
    return spark.sql(sql, **{t: read_table(spark, d, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def duck_table(name: str) -> str:
    sql = TABLES[name]
    for a, b in _DUCK:
        sql = sql.replace(a, b)
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"


def tool(name: str, args: dict, sql: str, columns: str | None = None, more: tuple[str, ...] = ()) -> None:
    """Register a call of a tool; ``columns`` are Spark expressions over its rows, ``more`` further tables that it reads."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = {t: spark_table(spark, d, t) for t in (ALL[name].table, *more)}
        out = Catalog(spark, tables).call(name, args)
        return out if columns is None else out.selectExpr(*columns.split("; "))

    QUERIES[f"tool_{name}"] = run
    names = {"T": duck_table(ALL[name].table), **{t: duck_table(t) for t in more}}
    ORACLE_SQL[f"tool_{name}"] = re.sub(r"\{(\w+)\}", lambda m: names[m.group(1)], sql)


# ---- issues ----

_KEY = "'K-' || CAST((SELECT max(CAST(substr(issue_key, 3) AS BIGINT)) + 1 FROM {T}) AS VARCHAR)"

tool("jira_add_comment", {"issueKey": "K-1", "body": "new"}, "SELECT * FROM {T} UNION ALL SELECT 'K-1', NULL, 'new'")
tool("jira_add_issues_to_sprint", {"sprintId": 3, "issueKeys": ["K-1", "K-2"]}, "SELECT * FROM {T} UNION ALL SELECT * FROM (VALUES (3, 'K-1'), (3, 'K-2'))")
tool("jira_add_watcher", {"issueKey": "K-1", "username": "ann"}, "SELECT * FROM {T} UNION ALL SELECT 'K-1', 'ann'")
tool("jira_add_worklog", {"issueKey": "K-1", "timeSpent": "2h", "started": "now"}, "SELECT * FROM {T} UNION ALL SELECT 'K-1', '2h', NULL, 'now'")
tool("jira_assign_issue", {"issueKey": "K-5", "username": "bob"}, "SELECT * REPLACE (CASE WHEN issue_key = 'K-5' THEN 'bob' ELSE assignee END AS assignee) FROM {T}")
tool(
    "jira_batch_create_issues", {"issues": [{"issue_key": "N-1", "summary": "one", "transition_id": 2}, {"projectKey": "P9", "issueType": "Bug", "summary": "two"}, {"projectKey": "K", "issueType": "Bug", "summary": "three", "assignee": "c1"}]},
    f"SELECT * FROM {{T}} UNION ALL SELECT 'N-1', NULL, NULL, 'one', NULL, NULL, NULL, 2 UNION ALL SELECT 'P9-1', 'P9', 'Bug', 'two', NULL, NULL, NULL, NULL UNION ALL SELECT {_KEY}, 'K', 'Bug', 'three', 'c1', NULL, NULL, NULL",
)
_ISSUE = {
    "projectKey": "K", "issueType": "Bug", "summary": "broken", "assignee": "c3", "reporter": "nobody", "epicKey": "K-1", "fields": {"transition_id": 2, "unknown": "x"},
    "links": [{"type": "in asia", "issue": "K-2"}, {"type": "OUT EUROPE", "issue": "K-3", "direction": "inward"}, {"type": "zzz", "issue": "K-4"}, {"issue": "K-5"}],
}
tool(
    "jira_create_issue", _ISSUE,
    f"SELECT {_KEY} AS key, 'unknown: no such field|reporter: no such field|link zzz K-4: Unknown link type zzz; known: ' || (SELECT string_agg(name, ', ' ORDER BY ord) FROM {{link_types}}) || '|link: type and issue are needed' AS warnings",
    "key; array_join(warnings, '|') AS warnings", more=("users", "link_types", "issue_links"),
)


def _after_creation(table: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = Catalog(spark, {t: spark_table(spark, d, t) for t in ("issues", "users", "link_types", "issue_links")})
        made.call("jira_create_issue", _ISSUE)
        return made.tables[table]

    return run


QUERIES |= {"created_issue": _after_creation("issues"), "created_links": _after_creation("issue_links")}
ORACLE_SQL["created_issue"] = f"SELECT * FROM {{T}} UNION ALL SELECT {_KEY}, 'K', 'Bug', 'broken', 'c3', 'K-1', NULL, 2".replace("{T}", duck_table("issues"))
ORACLE_SQL["created_links"] = (
    f"SELECT * FROM {{L}} UNION ALL SELECT (SELECT max(link_id) + 1 FROM {{L}}), (SELECT name FROM {{N}} WHERE inward = 'in ASIA'), {_KEY}, 'K-2'"
    f" UNION ALL SELECT (SELECT max(link_id) + 2 FROM {{L}}), (SELECT name FROM {{N}} WHERE outward = 'out EUROPE'), 'K-3', {_KEY}"
).replace("{T}", duck_table("issues")).replace("{L}", duck_table("issue_links")).replace("{N}", duck_table("link_types"))
tool("jira_create_issue_link", {"type": "Blocks", "inwardIssue": "K-1", "outwardIssue": "K-9"}, "SELECT * FROM {T} UNION ALL SELECT (SELECT max(link_id) + 1 FROM {T}), 'Blocks', 'K-1', 'K-9'")
tool("jira_create_remote_issue_link", {"issueKey": "K-1", "url": "http://x", "title": "t"}, "SELECT * FROM {T} UNION ALL SELECT 'K-1', 'http://x', 't'")
tool("jira_create_sprint", {"name": "next", "boardId": 2, "goal": "g"}, "SELECT * FROM {T} UNION ALL SELECT (SELECT max(sprint_id) + 1 FROM {T}), 'next', 2, NULL, NULL, NULL, 'g'")
tool("jira_create_version", {"projectKey": "P1", "name": "1.0", "released": True}, "SELECT * FROM {T} UNION ALL SELECT 'P1', '1.0', NULL, true")
tool("jira_delete_issue", {"issueKey": "K-11", "deleteSubtasks": "true"}, "SELECT * FROM {T} WHERE issue_key <> 'K-11' AND parent_key IS DISTINCT FROM 'K-11'")
tool("jira_download_attachments", {"issueKey": "K-3", "targetDir": "/x"}, "SELECT * FROM {T} WHERE issue_key = 'K-3'")
tool("jira_get_attachments", {"issueKey": "K-4"}, "SELECT * FROM {T} WHERE issue_key = 'K-4'")
tool("jira_get_board_backlog", {"boardId": 1, "maxResults": "30", "startAt": "20"}, "SELECT * FROM {T} WHERE board_id = 1 ORDER BY issue_key LIMIT 30 OFFSET 20")
tool("jira_get_changelog", {"issueKey": "K-13"}, "SELECT * FROM {T} WHERE issue_key = 'K-13'")
tool("jira_get_current_user", {}, "SELECT * FROM {T}")
tool("jira_get_issue", {"issueKey": "K-7", "fields": "summary, assignee"}, "SELECT summary, assignee FROM {T} WHERE issue_key = 'K-7'")
tool("jira_get_link_types", {}, "SELECT * FROM {T}")
tool("jira_get_project_components", {"projectKey": "P2"}, "SELECT * FROM {T} WHERE project_key = 'P2'")
tool("jira_get_project_statuses", {"projectKey": "P3"}, "SELECT * FROM {T} WHERE project_key = 'P3'")
tool("jira_get_project_versions", {"projectKey": "P4"}, "SELECT * FROM {T} WHERE project_key = 'P4'")
tool("jira_get_sprint_issues", {"sprintId": 4, "maxResults": 500}, "SELECT * FROM {T} WHERE sprint_id = 4 ORDER BY issue_key LIMIT 100")
tool("jira_get_transitions", {"issueKey": "K-2"}, "SELECT * FROM {T} WHERE issue_key = 'K-2'")
tool("jira_get_issue_watchers", {"issueKey": "K-10"}, "SELECT * FROM {T} WHERE issue_key = 'K-10'")
tool("jira_get_workflow", {"issueType": "TYPE1"}, "SELECT * FROM {T} WHERE trim(workflow) <> '' AND lower(issue_type) = 'type1'")
tool("jira_get_worklog", {"issueKey": "K-10"}, "SELECT * FROM {T} WHERE issue_key = 'K-10'")
tool("jira_link_issues", {"inwardIssue": "K-1", "outwardIssue": "K-2", "type": "OUT asia"}, "SELECT * FROM {T} UNION ALL SELECT (SELECT max(link_id) + 1 FROM {T}), (SELECT name FROM {link_types} WHERE outward = 'out ASIA'), 'K-1', 'K-2'", more=("link_types",))
tool("jira_link_to_epic", {"epicKey": "K-1", "issueKeys": ["K-3", "K-4"]}, "SELECT * REPLACE (CASE WHEN issue_key IN ('K-3', 'K-4') THEN 'K-1' ELSE epic_key END AS epic_key) FROM {T}")
tool("jira_list_assignable_users", {"projectKey": "P1", "query": "#0000000"}, "SELECT * FROM {T} WHERE project_key = 'P1' AND contains(lower(display_name), '#0000000') ORDER BY username, display_name LIMIT 50")
tool("jira_list_boards", {"projectKeyOrId": "P0"}, "SELECT * FROM {T} WHERE project_key = 'P0'")
tool("jira_list_projects", {}, "SELECT * FROM {T}")
tool("jira_list_sprints", {"boardId": 1, "state": "active"}, "SELECT * FROM {T} WHERE board_id = 1 AND state = 'active'")
tool("jira_list_team", {}, "SELECT * FROM {T}")
tool("jira_list_templates", {}, "SELECT * FROM {T} WHERE trim(issue_type) <> ''")
tool("jira_remove_issue_link", {"linkId": "3"}, "SELECT * FROM {T} WHERE link_id <> 3")
tool("jira_remove_watcher", {"issueKey": "K-10", "username": "u3"}, "SELECT * FROM {T} WHERE NOT (issue_key = 'K-10' AND username = 'u3')")
tool(
    "jira_search", {"jql": "project in (P1, \"P2\") AND (assignee is empty OR summary ~ 'ORDER f') and not transition_id = 1 ORDER BY summary DESC, key", "maxResults": 40, "startAt": 5},
    """SELECT * FROM {T} WHERE project_key IN ('P1', 'P2') AND (assignee IS NULL OR contains(lower(summary), 'order f')) AND transition_id <> 1
 ORDER BY summary DESC, issue_key LIMIT 40 OFFSET 5""",
)
tool("jira_search_fields", {}, "SELECT * FROM {T}")
tool("jira_transition_issue", {"issueKey": "K-6", "transitionId": "31"}, "SELECT * REPLACE (CASE WHEN issue_key = 'K-6' THEN 31 ELSE transition_id END AS transition_id) FROM {T}")
tool(
    "jira_update_issue", {"issueKey": "K-8", "fields": {"summary": "changed", "unknown": 1, "transition_id": 9}},
    "SELECT * REPLACE (CASE WHEN issue_key = 'K-8' THEN 'changed' ELSE summary END AS summary, CASE WHEN issue_key = 'K-8' THEN 9 ELSE transition_id END AS transition_id) FROM {T}",
)
tool(
    "jira_update_sprint", {"sprintId": 4, "state": "closed", "goal": "done"},
    "SELECT * REPLACE (CASE WHEN sprint_id = 4 THEN 'closed' ELSE state END AS state, CASE WHEN sprint_id = 4 THEN 'done' ELSE goal END AS goal) FROM {T}",
)

# ---- pages ----

tool("confluence_add_comment", {"pageId": "3", "body": "well"}, "SELECT * FROM {T} UNION ALL SELECT '3', NULL, 'well'")
tool(
    "confluence_add_labels", {"pageId": "2", "labels": "new, en ,,new"},
    """SELECT page_id, array_to_string(list_value(lang, source), '|') || CASE WHEN page_id = '2' THEN '|new' || CASE WHEN lang = 'en' THEN '' ELSE '|en' END ELSE '' END AS labels
 FROM (SELECT CAST(doc_id AS STRING) AS page_id, lang, source FROM documents)""", "page_id; array_join(labels, '|') AS labels",
)
tool("confluence_delete_attachment", {"attachmentId": "5"}, "SELECT * FROM {T} WHERE attachment_id <> 5")
tool(
    "confluence_delete_label", {"pageId": "2", "name": "de"}, "SELECT page_id, array_to_string(CASE WHEN page_id = '2' THEN list_filter(labels, lambda x: x <> 'de') ELSE labels END, '|') AS labels FROM {T}",
    "page_id; array_join(labels, '|') AS labels",
)
tool("confluence_delete_page", {"pageId": "4"}, "SELECT * FROM {T} WHERE page_id <> '4'")
tool("confluence_download_attachment", {"pageId": "5", "fileName": "f35.png", "targetDir": "/x"}, "SELECT * FROM {T} WHERE page_id = '5' AND name = 'f35.png'")
tool(
    "confluence_export_tree_to_adoc", {"pageId": "3", "targetDir": "out/"},
    """WITH RECURSIVE t(page_id, path) AS (SELECT page_id, title FROM {T} WHERE page_id = '3' UNION ALL SELECT e.child_id, t.path || '/' || e.title FROM t JOIN {edges} e ON e.parent_id = t.page_id)
 SELECT 'out/' || path || '/index.adoc' AS path, page_id, version_when, '= ' || title || chr(10) || ':confluency-id: ' || page_id || chr(10) || ':confluency-version: ' || version_when || chr(10) || ':confluency-url: ' || url ||
 chr(10) || ':confluency-space: ' || space || chr(10) || ':toc: macro' || chr(10) || ':imagesdir: ./attache' || chr(10) || chr(10) || 'about ' || lower(version_when) || chr(10) || chr(10) || 'second' || chr(10) AS content
 FROM t JOIN {T} p USING (page_id)""", more=("edges",),
)
tool("confluence_find_page", {"spaceKey": "S0", "title": "Customer#000000003"}, "SELECT * FROM {T} WHERE space = 'S0' AND title = 'Customer#000000003' ORDER BY page_id LIMIT 1")
tool("confluence_get_attachments", {"pageId": "7"}, "SELECT * FROM {T} WHERE page_id = '7'")
tool("confluence_get_child_pages", {"pageId": "3"}, "SELECT * FROM {T} WHERE parent_id = '3'")
tool("confluence_get_comments", {"pageId": "8"}, "SELECT * FROM {T} WHERE page_id = '8'")
tool("confluence_get_default_space", {}, "SELECT * FROM {T}")
tool("confluence_get_labels", {"pageId": "9"}, "SELECT page_id, array_to_string(labels, '|') AS labels FROM {T} WHERE page_id = '9'", "page_id; array_join(labels, '|') AS labels")
tool(
    "confluence_get_page", {"pageId": "9", "format": "MD"}, "SELECT page_id, 'about ' || lower(version_when) || chr(10) || chr(10) || 'second' AS text, 'md' AS format FROM {T} WHERE page_id = '9'",
    "page_id; text; format",
)
tool("confluence_get_page_diff", {"pageId": "2", "fromVersion": "0", "toVersion": 1}, "SELECT page_id, max(CASE WHEN version = 0 THEN text END) AS old_text, max(CASE WHEN version = 1 THEN text END) AS new_text FROM {T} WHERE page_id = '2' GROUP BY 1")
tool("confluence_get_page_history", {"pageId": "2"}, "SELECT * FROM {T} WHERE page_id = '2'")
tool("confluence_get_user", {"userKey": "k5"}, "SELECT * FROM {T} WHERE user_key = 'k5'")
tool("confluence_list_spaces", {"limit": 20, "start": 10}, "SELECT * FROM {T} ORDER BY key, name LIMIT 20 OFFSET 10")
tool(
    "confluence_move_page", {"pageId": "20", "targetId": "9", "position": "before"},
    """SELECT CASE WHEN child_id = '20' THEN (SELECT parent_id FROM {T} WHERE child_id = '9') ELSE parent_id END AS parent_id, child_id, title, CAST(CASE WHEN child_id = '20' THEN (SELECT ord FROM {T} WHERE child_id = '9')
 WHEN parent_id = (SELECT parent_id FROM {T} WHERE child_id = '9') AND ord >= (SELECT ord FROM {T} WHERE child_id = '9') THEN ord + 1 ELSE ord END AS INT) AS ord FROM {T}""",
)
tool(
    "confluence_publish_adoc", {"source": "= New title\n\nsome words\n", "pageId": "6"},
    "SELECT page_id, CASE WHEN page_id = '6' THEN 'New title' ELSE title END AS title, CASE WHEN page_id = '6' THEN '<p>some words</p>' ELSE storage END AS storage FROM {T}", "page_id; title; trim(storage) AS storage",
)
tool("confluence_reply_to_comment", {"pageId": "3", "parentCommentId": "44", "body": "yes"}, "SELECT * FROM {T} UNION ALL SELECT '3', '44', 'yes'")
tool(
    "confluence_search", {"query": "building", "spaceKey": "S2"},
    """WITH t AS (SELECT *, CASE WHEN title = 'building' THEN 1 WHEN contains(lower(title), 'building') THEN 2 WHEN contains(lower(storage), 'building') THEN 3 END AS tier FROM {T} WHERE space = 'S2')
 SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)""",
)
tool("confluence_upload_attachment", {"pageId": "3", "filePath": "a.png"}, "SELECT * FROM {T} UNION ALL SELECT (SELECT max(attachment_id) + 1 FROM {T}), '3', 'a.png'")

# ---- code ----

tool("bitbucket_browse", {"projectKey": "P1", "repoSlug": "rde", "at": "main"}, "SELECT * FROM {T} WHERE project_key = 'P1' AND repo_slug = 'rde' ORDER BY project_key, repo_slug, folder, path LIMIT 25")
tool(
    "bitbucket_get_file", {"projectKey": "P1", "repoSlug": "ren", "path": "src7/7.txt", "start": 1, "limit": 2},
    "SELECT * REPLACE (array_to_string(string_split(content, chr(10))[2:3], chr(10)) AS content) FROM {T} WHERE project_key = 'P1' AND repo_slug = 'ren' AND path = 'src7/7.txt'",
)
tool("bitbucket_get_pull_request", {"projectKey": "P1", "repoSlug": "r0", "id": "4"}, "SELECT * FROM {T} WHERE project_key = 'P1' AND repo_slug = 'r0' AND id = 4")
tool("bitbucket_get_pull_request_activities", {"projectKey": "P1", "repoSlug": "r1", "id": 10, "limit": 200}, "SELECT * FROM {T} WHERE id = 10 ORDER BY ord, part LIMIT 100")
tool("bitbucket_get_pull_request_diff", {"projectKey": "P1", "repoSlug": "r1", "id": 12}, "SELECT * FROM {T} WHERE id = 12")
tool("bitbucket_get_repository", {"projectKey": "P1", "repoSlug": "r6"}, "SELECT * FROM {T} WHERE project_key = 'P1' AND repo_slug = 'r6'")
tool("bitbucket_list_projects", {"limit": 10, "start": 5}, "SELECT * FROM {T} ORDER BY project_key, name LIMIT 10 OFFSET 5")
tool("bitbucket_list_pull_requests", {"projectKey": "P1", "repoSlug": "r1", "state": "OPEN"}, "SELECT * FROM {T} WHERE project_key = 'P1' AND repo_slug = 'r1' AND state = 'OPEN' ORDER BY id LIMIT 25")
tool("bitbucket_list_repositories", {"projectKey": "P2"}, "SELECT * FROM {T} WHERE project_key = 'P2' ORDER BY repo_slug LIMIT 25")
tool(
    "bitbucket_search", {"query": "the", "projectKey": "P0", "limit": 5}, "SELECT * FROM {T} WHERE project_key = 'P0' AND contains(lower(content), 'the') ORDER BY project_key, repo_slug, folder, path LIMIT 5",
)
