"""Named tools over offline tables: reads are filters and pages of a table, writes give the table's new state. No server is called.

``Catalog(spark, tables)`` holds DataFrames by name; ``call(tool, args)`` returns the rows of a read, or the new state after a write, which
later calls see. A bad call raises ``ToolError``; ``respond`` gives the JSON envelope instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators import textindex
from docspark.operators.relational import clamp_limit, clamp_start, enabled_tools, link_types, version_pair
from docspark.shared import shared_folder
from docspark.sources.sinks import add_labels, deleted, upsert

# Every tool's name and arguments (? optional), then what it does: action, table, and column=argument pairs.
TOOLS = """
jira_add_comment(issueKey, body, host?) | append comments | issue_key=issueKey body=body
jira_add_issues_to_sprint(sprintId, issueKeys, host?) | append_each sprint_issues | sprint_id=sprintId issue_key=issueKeys
jira_add_watcher(issueKey, username, host?) | append watchers | issue_key=issueKey username=username
jira_add_worklog(issueKey, timeSpent, comment?, started?, host?) | append worklogs | issue_key=issueKey time_spent=timeSpent comment=comment started=started
jira_assign_issue(issueKey, username, host?) | update issues | issue_key=issueKey assignee=username
jira_batch_create_issues(issues, host?) | append_rows issues | rows=issues
jira_create_issue(projectKey?, issueType, summary, description?, assignee?, reporter?, labels?, epicKey?, links?, fields?, customFields?, components?, fixVersions?, priority?, host?) | create_issue issues | project_key=projectKey issue_type=issueType summary=summary description=description assignee=assignee reporter=reporter labels=labels epic_key=epicKey links=links fields=fields custom_fields=customFields components=components fix_versions=fixVersions priority=priority
jira_create_issue_link(type, inwardIssue, outwardIssue, host?) | append issue_links | type=type inward=inwardIssue outward=outwardIssue
jira_create_remote_issue_link(issueKey, url, title, host?) | append remote_links | issue_key=issueKey url=url title=title
jira_create_sprint(name, boardId, startDate?, endDate?, goal?, host?) | append sprints | name=name board_id=boardId start_date=startDate end_date=endDate goal=goal
jira_create_version(projectKey?, name, description?, released?, host?) | append versions | project_key=projectKey name=name description=description released=released
jira_delete_issue(issueKey, deleteSubtasks?, host?) | delete_issue issues | issue_key=issueKey
jira_download_attachments(issueKey, targetDir, host?) | get issue_attachments | issue_key=issueKey
jira_get_attachments(issueKey, host?) | get issue_attachments | issue_key=issueKey
jira_get_board_backlog(boardId, maxResults?, startAt?, host?) | list backlog | board_id=boardId
jira_get_changelog(issueKey, host?) | get changelog | issue_key=issueKey
jira_get_current_user(host?) | get current_user |
jira_get_issue(issueKey, fields?, host?) | one issues | issue_key=issueKey
jira_get_link_types(host?) | get link_types |
jira_get_project_components(projectKey?, host?) | get components | project_key=projectKey
jira_get_project_statuses(projectKey?, host?) | get statuses | project_key=projectKey
jira_get_project_versions(projectKey?, host?) | get versions | project_key=projectKey
jira_get_sprint_issues(sprintId, maxResults?, startAt?, host?) | list sprint_issues | sprint_id=sprintId
jira_get_transitions(issueKey, host?) | get transitions | issue_key=issueKey
jira_get_issue_watchers(issueKey, host?) | get watchers | issue_key=issueKey
jira_get_workflow(issueType?) | workflow templates | issue_type=issueType
jira_get_worklog(issueKey, host?) | get worklogs | issue_key=issueKey
jira_link_issues(inwardIssue, outwardIssue, type, host?) | link_typed issue_links | type=type inward=inwardIssue outward=outwardIssue
jira_link_to_epic(epicKey, issueKeys, host?) | set_each issues | issue_key=issueKeys epic_key=epicKey
jira_list_assignable_users(projectKey?, query?, maxResults?, startAt?, host?) | search users | project_key=projectKey ~display_name=query
jira_list_boards(projectKeyOrId?, host?) | list boards | project_key=projectKeyOrId
jira_list_projects(host?) | list projects |
jira_list_sprints(boardId, state?, host?) | list sprints | board_id=boardId state=state
jira_list_team() | get team |
jira_list_templates() | templates templates |
jira_remove_issue_link(linkId, host?) | delete issue_links | link_id=linkId
jira_remove_watcher(issueKey, username, host?) | delete watchers | issue_key=issueKey username=username
jira_search(jql, maxResults?, startAt?, host?) | query issues | ?=jql
jira_search_fields(host?) | get fields |
jira_transition_issue(issueKey, transitionId, host?) | update issues | issue_key=issueKey transition_id=transitionId
jira_update_issue(issueKey, fields, host?) | update_fields issues | issue_key=issueKey fields=fields
jira_update_sprint(sprintId, name?, state?, startDate?, endDate?, goal?, host?) | update sprints | sprint_id=sprintId name=name state=state start_date=startDate end_date=endDate goal=goal
confluence_add_comment(pageId, body, host?) | append page_comments | page_id=pageId body=body
confluence_add_labels(pageId, labels, host?) | labels page_labels | page_id=pageId labels=labels
confluence_delete_attachment(attachmentId, host?) | delete page_attachments | attachment_id=attachmentId
confluence_delete_label(pageId, name, host?) | unlabel page_labels | page_id=pageId name=name
confluence_delete_page(pageId, host?) | delete pages | page_id=pageId
confluence_download_attachment(pageId, fileName, targetDir, host?) | get page_attachments | page_id=pageId name=fileName
confluence_export_tree_to_adoc(pageId?, url?, spaceKey?, targetDir, includeChildren?, includeAttachments?, exportColors?, debug?, format?, skipUnchanged?, host?) | export pages | page_id=pageId space=spaceKey
confluence_find_page(spaceKey?, title, host?) | first pages | space=spaceKey title=title
confluence_get_attachments(pageId, host?) | get page_attachments | page_id=pageId
confluence_get_child_pages(pageId, host?) | list edges | parent_id=pageId
confluence_get_comments(pageId, host?) | get page_comments | page_id=pageId
confluence_get_default_space(host?) | get default_space |
confluence_get_labels(pageId, host?) | get page_labels | page_id=pageId
confluence_get_page(pageId, format?, fast?, host?) | page pages | page_id=pageId
confluence_get_page_diff(pageId, fromVersion, toVersion?, format?, host?) | diff page_versions | page_id=pageId
confluence_get_page_history(pageId, host?) | get page_versions | page_id=pageId
confluence_get_user(userKey, host?) | one wiki_users | user_key=userKey
confluence_list_spaces(limit?, start?, host?) | list spaces |
confluence_move_page(pageId, targetId, position?, host?) | move edges | child_id=pageId parent_id=targetId
confluence_publish_adoc(source, url?, pageId?, host?) | publish pages | page_id=pageId
confluence_reply_to_comment(pageId, parentCommentId, body, host?) | append page_comments | page_id=pageId parent_comment_id=parentCommentId body=body
confluence_search(query, spaceKey?, host?) | tiers pages | space=spaceKey
confluence_upload_attachment(pageId, filePath, host?) | append page_attachments | page_id=pageId name=filePath
bitbucket_browse(projectKey, repoSlug, path?, at?, limit?, start?, host?) | list repo_files | project_key=projectKey repo_slug=repoSlug folder=path at=at
bitbucket_get_file(projectKey, repoSlug, path, at?, start?, limit?, host?) | file repo_files | project_key=projectKey repo_slug=repoSlug path=path at=at
bitbucket_get_pull_request(projectKey, repoSlug, id, host?) | one pull_requests | project_key=projectKey repo_slug=repoSlug id=id
bitbucket_get_pull_request_activities(projectKey, repoSlug, id, limit?, start?, host?) | list pull_request_activities | project_key=projectKey repo_slug=repoSlug id=id
bitbucket_get_pull_request_diff(projectKey, repoSlug, id, contextLines?, host?) | get pull_request_diffs | project_key=projectKey repo_slug=repoSlug id=id
bitbucket_get_repository(projectKey, repoSlug, host?) | one repositories | project_key=projectKey repo_slug=repoSlug
bitbucket_list_projects(limit?, start?, host?) | list code_projects |
bitbucket_list_pull_requests(projectKey, repoSlug, state?, limit?, start?, host?) | list pull_requests | project_key=projectKey repo_slug=repoSlug state=state
bitbucket_list_repositories(projectKey?, limit?, start?, host?) | list repositories | project_key=projectKey
bitbucket_search(query, projectKey?, repoSlug?, limit?, start?, host?) | search repo_files | project_key=projectKey repo_slug=repoSlug ~content=query
"""
# What a listing's page holds where the caller does not say, and at most.
PAGE_DEFAULT = {"bitbucket": 25}
PROTOCOL = "2024-11-05"
#: Rows that a reply holds itself.
REPLY_ROWS = 10_000
# Arguments that are whole numbers, and those that are yes or no.
WHOLE = frozenset(("limit", "start", "startAt", "maxResults", "fromVersion", "toVersion", "contextLines"))
YES_NO = frozenset(("deleteSubtasks", "includeChildren", "includeAttachments", "exportColors", "debug", "skipUnchanged", "fast", "released"))


class ToolError(ValueError):
    pass


@dataclass(frozen=True)
class Tool:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    action: str
    table: str
    columns: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> dict:
        return {"type": "object", "properties": {a: {} for a in (*self.required, *self.optional)}, "required": list(self.required)}


def read_tools() -> dict[str, Tool]:
    out = {}
    for line in TOOLS.strip().splitlines():
        signature, what, pairs = (x.strip() for x in line.split("|"))
        name, _, rest = signature.partition("(")
        args = [a.strip() for a in rest.rstrip(")").split(",") if a.strip()]
        action, table = what.split()
        columns = tuple(tuple(p.split("=")) for p in pairs.split())
        out[name] = Tool(name, tuple(a for a in args if a[-1] != "?"), tuple(a[:-1] for a in args if a[-1] == "?"), action, table, columns)
    return out


ALL = read_tools()


def typed(name: str, value):
    """Whole numbers and yes or no may come as text."""
    if name in WHOLE:
        try:
            return int(value)
        except (TypeError, ValueError):
            raise ToolError(f"Not a whole number: {name}") from None
    if name in YES_NO and isinstance(value, str):
        if value.lower() not in ("true", "false"):
            raise ToolError(f"Neither true nor false: {name}")
        return value.lower() == "true"
    return value


class Catalog:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], defaults: dict[str, str] | None = None, kinds: list[str] | None = None):
        self.spark, self.tables, self.defaults = spark, dict(tables), defaults or {}
        names = spark.createDataFrame([(t,) for t in ALL], "name string")
        self.enabled = {r.name for r in enabled_tools(names, kinds).collect()} if kinds else set(ALL)

    def call(self, name: str, args: dict | None = None) -> DataFrame:
        args = {k: v for k, v in (args or {}).items() if v is not None}
        tool = ALL.get(name)
        if tool is None or name not in self.enabled:
            raise ToolError(f"Unknown tool: {name}")
        if missing := [a for a in tool.required if str(args.get(a, "")).strip() == ""]:
            raise ToolError(f"Missing argument: {', '.join(missing)}")
        if tool.table not in self.tables:
            raise ToolError(f"No table: {tool.table}")
        args = {**{k: v for k, v in self.defaults.items() if k in tool.optional}, **{k: typed(k, v) for k, v in args.items()}}
        return getattr(self, f"_{tool.action}")(tool, args)

    def respond(self, request: str) -> str | None:
        """A JSON-RPC response line to a request line; none to a notification."""
        try:
            message = json.loads(request)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}})
        key, method, params = message.get("id"), message.get("method"), message.get("params") or {}
        if "id" not in message:
            return None
        if method == "ping":
            result: dict = {}
        elif method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "docspark", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": t.name, "inputSchema": t.schema} for t in ALL.values() if t.name in self.enabled]}
        elif method == "tools/call":
            try:
                text, failed = self._told(self.call(params.get("name", ""), params.get("arguments"))), False
            except Exception as e:
                text, failed = str(e).splitlines()[0], True
            result = {"content": [{"type": "text", "text": text}], "isError": failed}
        else:
            return json.dumps({"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"Method not found: {method}"}})
        return json.dumps({"jsonrpc": "2.0", "id": key, "result": result}, ensure_ascii=False)

    def _told(self, df: DataFrame) -> str:
        """A result's rows as a JSON list; one of more than REPLY_ROWS is written as JSON lines to the shared folder, and the reply names the place."""
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(REPLY_ROWS + 1).collect()
        if len(rows) <= REPLY_ROWS:
            return "[" + ",".join(r.j for r in rows) + "]"
        folder = f"{shared_folder(self.spark)}/reply-{uuid.uuid4().hex}"
        df.write.json(folder)
        return json.dumps({"rows": folder})

    # ---- reads ----

    def _on_host(self, df: DataFrame, args: dict) -> DataFrame:
        """The rows of the server that the caller names, where a table holds those of several."""
        return df.filter(F.lower("host") == str(args["host"]).lower()) if args.get("host") and "host" in df.columns else df

    def _rows(self, tool: Tool, args: dict) -> DataFrame:
        df = self._on_host(self.tables[tool.table], args)
        for column, arg in tool.columns:
            if arg not in args:
                continue
            if column.startswith("~"):
                df = df.filter(F.lower(column[1:]).contains(str(args[arg]).lower()))
            elif column in df.columns:
                df = df.filter(F.col(column) == F.lit(args[arg]).cast(df.schema[column].dataType))
        return df

    _get = _rows

    def _one(self, tool: Tool, args: dict) -> DataFrame:
        df = self._rows(tool, args)
        wanted = [c.strip() for c in str(args.get("fields", "")).split(",") if c.strip() in df.columns]
        return df.select(*wanted) if wanted else df

    def _list(self, tool: Tool, args: dict) -> DataFrame:
        df = self._rows(tool, args)
        default = PAGE_DEFAULT.get(tool.name.split("_")[0], 50)
        order = "ord" if "ord" in df.columns else df.columns[0]
        start, limit = args.get("startAt", args.get("start")), args.get("maxResults", args.get("limit"))
        rows = df.orderBy(order, *(c for c in df.columns[:4] if c != order))
        # who can't ask for a next page gets all rows
        paged = {"startAt", "start"} & set(tool.optional)
        return rows.offset(clamp_start(start)).limit(clamp_limit(limit, default)) if paged else rows

    _search = _list

    def _query(self, tool: Tool, args: dict) -> DataFrame:
        from .jql import SearchError, search

        df = self._on_host(self.tables[tool.table], args)
        try:
            rows, order = search(df, str(args["jql"]))
        except SearchError as e:
            raise ToolError(str(e)) from None
        rows = rows.orderBy(*order, *df.columns[:2])
        return rows.offset(clamp_start(args.get("startAt"))).limit(clamp_limit(args.get("maxResults"), 50))

    def _file(self, tool: Tool, args: dict) -> DataFrame:
        """A file's content, or its lines from ``start`` on, ``limit`` of them."""
        df = self._rows(tool, args)
        if args.get("start") is None and args.get("limit") is None:
            return df
        lines = F.slice(F.split("content", "\n"), F.lit(clamp_start(args.get("start")) + 1), F.lit(int(args["limit"]) if args.get("limit") is not None else 1 << 30))
        return df.withColumn("content", F.array_join(lines, "\n"))

    def _first(self, tool: Tool, args: dict) -> DataFrame:
        return self._rows(tool, args).orderBy("page_id").limit(1)

    def _templates(self, tool: Tool, args: dict) -> DataFrame:
        return self.tables[tool.table].filter(F.trim("issue_type") != "")

    def _workflow(self, tool: Tool, args: dict) -> DataFrame:
        df = self.tables[tool.table].filter(F.trim("workflow") != "")
        return df.filter(F.lower("issue_type") == str(args["issueType"]).lower()) if args.get("issueType") else df

    def _page(self, tool: Tool, args: dict) -> DataFrame:
        from docspark.operators.convert import to_text

        from .export import with_links

        form = str(args.get("format", "storage")).lower()
        df = self._rows(tool, args)
        if form == "storage":
            return df
        kind = "md" if form in ("md", "markdown") else "adoc"
        rows = with_links(df.withColumn("page_id", F.col("page_id").cast("string")), self.tables["pages"], kind, self._sides(), bool(args.get("fast")))
        return to_text(rows, "storage", kind, links="_links").withColumn("format", F.lit(form))

    def _sides(self) -> dict[str, DataFrame]:
        """The tables from which links are resolved, those of them that there are."""
        return {k: self.tables[k] for k in ("cached", "users", "attachments") if k in self.tables and {"url"} <= set(self.tables[k].columns)}

    def _diff(self, tool: Tool, args: dict) -> DataFrame:
        form = str(args.get("format", "storage")).lower()
        rows = self._rows(tool, args)
        if form != "storage":
            from docspark.operators.convert import to_text

            rows = to_text(rows.withColumnRenamed("text", "_html"), "_html", "md" if form in ("md", "markdown") else "adoc").drop("title")
        to = args.get("toVersion") or rows.agg(F.max("version")).first()[0]
        return version_pair(rows, "page_id", int(args["fromVersion"]), int(to or 0))

    def _tiers(self, tool: Tool, args: dict) -> DataFrame:
        from docspark.operators.relational import first_tier

        q, text = str(args["query"]), F.lower("storage")
        words = [F.lower("title").contains(w.lower()) for w in q.split()] or [F.lit(False)]
        fuzzy = words[0]
        for w in words[1:]:
            fuzzy = fuzzy & w
        rows = self._rows(tool, args)
        if {"page_index", "page_terms"} <= self.tables.keys():
            # the index tells which texts hold the query, and no text is read
            found = textindex.matches(self.tables["page_index"], self.tables["page_terms"], q).select(F.col("id").alias("_id"), F.lit(True).alias("_in"))
            rows = rows.join(found, F.col("page_id") == F.col("_id"), "left")
            return first_tier(rows, [F.col("title") == q, fuzzy, F.coalesce("_in", F.lit(False))]).drop("_id", "_in")
        return first_tier(rows, [F.col("title") == q, fuzzy, text.contains(q.lower())])

    def _export(self, tool: Tool, args: dict) -> DataFrame:
        from .export import export_tree

        from docspark.functions.columns import display_space, page_id, space_key

        root, space = args.get("pageId"), args.get("spaceKey")
        if root is None and space is None:
            url = F.lit(str(args.get("url") or ""))
            root, space = self.spark.range(1).select(page_id(url), display_space(url)).first()
        if root is None and space is None:
            raise ToolError("Give a pageId, a url or a spaceKey")
        space = None if root or space is None else self.spark.range(1).select(space_key(F.lit(str(space)))).first()[0]
        state = self.tables.get("export_state") if args.get("skipUnchanged") else None
        made = export_tree(
            self.tables["pages"], self.tables["edges"], root, space, str(args.get("format", "adoc")), state, self._sides(), args.get("includeChildren", True), args.get("exportColors", True),
            attached=self.tables.get("attachment_bytes") if args.get("includeAttachments", True) else None, debug=bool(args.get("debug")),
        )
        return made.withColumn("path", F.concat(F.lit(str(args["targetDir"]).rstrip("/") + "/"), "path"))

    # ---- writes ----

    def _set(self, tool: Tool, df: DataFrame) -> DataFrame:
        self.tables[tool.table] = df
        return df

    def _made(self, tool: Tool, rows: list[dict]) -> DataFrame:
        """Rows in the table's schema; ids that are missing are drawn from the row itself."""
        df = self.tables[tool.table]
        key = df.columns[0]
        new = self.spark.createDataFrame([tuple(as_text(r.get(c)) for c in df.columns) for r in rows], ", ".join(f"`{c}` string" for c in df.columns))
        new = new.select(*(as_kind(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns))
        kind = df.schema[key].dataType
        if kind.typeName() == "string":
            return new.withColumn(key, F.coalesce(key, F.sha2(F.to_json(F.struct(*df.columns)), 256)))
        if kind.typeName() in ("byte", "short", "integer", "long") and key.endswith("id") and key not in {c for c, _ in tool.columns}:
            # the next numbers, in the order of the rows
            last = df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
            new = new.coalesce(1).withColumn(key, F.coalesce(key, (F.lit(last + 1) + F.monotonically_increasing_id()).cast(kind)))
        return new

    def _append(self, tool: Tool, args: dict) -> DataFrame:
        return self._set(tool, self.tables[tool.table].unionByName(self._made(tool, [{c: args.get(a) for c, a in tool.columns}])))

    def _append_each(self, tool: Tool, args: dict) -> DataFrame:
        (c1, a1), (c2, a2) = tool.columns
        return self._set(tool, self.tables[tool.table].unionByName(self._made(tool, [{c1: args[a1], c2: x} for x in args[a2]])))

    def _append_rows(self, tool: Tool, args: dict) -> DataFrame:
        """Rows by the table's columns, or by the names of arguments; those need a project, a type and a summary."""
        rows = args["issues"]
        if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
            raise ToolError("issues must be a list of one issue or more")
        names = {"projectKey": "project_key", "issueType": "issue_type"}
        made = []
        for r in rows:
            if names.keys() & r.keys():
                r = {"projectKey": r.get("projectKey") or self.defaults.get("projectKey"), **{k: v for k, v in r.items() if k != "projectKey"}}
                if missing := [k for k in ("projectKey", "issueType", "summary") if not str(r.get(k) or "").strip()]:
                    raise ToolError(f"Missing argument: {', '.join(missing)}")
            made.append({names.get(k, k): v for k, v in r.items()})
        key = self.tables[tool.table].columns[0]
        new = [r for r in made if r.get(key) is None and r.get("project_key")]
        for r, k in zip(new, self._next_keys(self.tables[tool.table], [r["project_key"] for r in new]), strict=True):
            r[key] = k
        return self._set(tool, self.tables[tool.table].unionByName(self._made(tool, made)))

    @staticmethod
    def _next_keys(df: DataFrame, projects: list[str]) -> list[str]:
        """A new key for each project of the list, numbered on from the greatest of the project's keys."""
        key, number = df.columns[0], F.regexp_extract(F.col(df.columns[0]), r"-(\d+)$", 1).try_cast("long")
        project = F.regexp_replace(key, r"-\d+$", "")
        last = {r.p: r.n for r in df.filter(project.isin(*set(projects))).groupBy(project.alias("p")).agg(F.max(number).alias("n")).collect()}
        out = []
        for p in projects:
            last[p] = (last.get(p) or 0) + 1
            out.append(f"{p}-{last[p]}")
        return out

    def _create_issue(self, tool: Tool, args: dict) -> DataFrame:
        """One row (key, warnings): the new issue, with what follows its creation step by step.

        The issue itself is all or nothing; assignee, reporter, epic and links are each checked against the table that has them, where there is one, and what fails is a warning. Other fields go to
        columns of their names, those of ``fields`` and then of ``customFields`` last.
        """
        if not str(args.get("projectKey") or "").strip():
            raise ToolError("Missing argument: projectKey")
        df = self.tables[tool.table]
        direct = {c: args[a] for c, a in tool.columns if a in args and a not in ("links", "fields", "customFields")}
        values = direct | dict(args.get("fields") or {}) | dict(args.get("customFields") or {})
        later = {c: values.pop(c, None) for c in ("assignee", "reporter", "epic_key")}
        warnings = [f"{c}: no such field" for c in values if c not in df.columns]
        key = str(values.get(df.columns[0]) or self._next_keys(df, [args["projectKey"]])[0])
        row = self._made(tool, [values | {df.columns[0]: key}]).first().asDict()
        known = {"assignee": ("users", "username"), "reporter": ("users", "username"), "epic_key": ("issues", df.columns[0])}
        for column, value in later.items():
            if value is None or not str(value).strip():
                continue
            table, name = known[column]
            if column not in df.columns:
                warnings.append(f"{column}: no such field")
            elif table in self.tables and self.tables[table].filter(F.col(name) == str(value)).isEmpty():
                warnings.append(f"{column} '{value}': not found")
            else:
                row[column] = value
        self._set(tool, df.unionByName(self.spark.createDataFrame([tuple(row[c] for c in df.columns)], df.schema)))
        for link in args.get("links") or []:
            kind, issue = (link.get("type"), link.get("issue")) if isinstance(link, dict) else (None, None)
            if not kind or not issue:
                warnings.append("link: type and issue are needed")
                continue
            inward, outward = (issue, key) if str(link.get("direction", "outward")).lower() == "inward" else (key, issue)
            try:
                self.call("jira_link_issues", {"inwardIssue": inward, "outwardIssue": outward, "type": kind})
            except ToolError as e:
                warnings.append(f"link {kind} {issue}: {e}")
        return self.spark.createDataFrame([(key, warnings)], "key string, warnings array<string>")

    def _update(self, tool: Tool, args: dict, more: dict | None = None) -> DataFrame:
        df = self.tables[tool.table]
        (key, arg), *rest = tool.columns
        hit = F.col(key) == F.lit(args[arg]).cast(df.schema[key].dataType)
        values = {c: args[a] for c, a in rest if a in args and c in df.columns} | {c: v for c, v in (more or {}).items() if c in df.columns}
        return self._set(tool, df.withColumns({c: F.when(hit, as_kind(F.lit(as_text(v)), df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}))

    def _update_fields(self, tool: Tool, args: dict) -> DataFrame:
        return self._update(tool, args, dict(args["fields"]))

    def _set_each(self, tool: Tool, args: dict) -> DataFrame:
        df, (key, many), (column, one) = self.tables[tool.table], *tool.columns
        return self._set(tool, df.withColumn(column, F.when(F.col(key).isin(*args[many]), F.lit(args[one])).otherwise(F.col(column))))

    def _delete(self, tool: Tool, args: dict) -> DataFrame:
        df = self.tables[tool.table]
        keys = [c for c, a in tool.columns]
        gone = self.spark.createDataFrame([tuple(str(args[a]) for _, a in tool.columns)], ", ".join(f"`{c}` string" for c in keys))
        return self._set(tool, deleted(df, gone.select(*(F.col(c).cast(df.schema[c].dataType) for c in keys)), keys))

    def _delete_issue(self, tool: Tool, args: dict) -> DataFrame:
        """With its subtasks where the caller says so; an issue that has some is not deleted otherwise."""
        df = self.tables[tool.table]
        if "parent_key" in df.columns:
            below = F.col("parent_key") == str(args["issueKey"])
            if args.get("deleteSubtasks"):
                self.tables[tool.table] = df.filter(~F.coalesce(below, F.lit(False)))
            elif not df.filter(below).isEmpty():
                raise ToolError(f"{args['issueKey']} has subtasks")
        return self._delete(tool, args)

    def _move(self, tool: Tool, args: dict) -> DataFrame:
        """Below the target, as its last page, or with ``position`` before or after it among its siblings."""
        df, position = self.tables[tool.table], str(args.get("position", "append")).lower()
        if position not in ("append", "before", "after"):
            raise ToolError(f"Unknown position: {position}")
        hit, target = F.col("child_id") == str(args["pageId"]), str(args["targetId"])
        if position == "append":
            last = df.filter(F.col("parent_id") == target).agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
            moved = {"parent_id": F.when(hit, target).otherwise(F.col("parent_id")), "ord": F.when(hit, last).otherwise(F.col("ord")).cast("int")}
            return self._set(tool, df.withColumns(moved))
        at = df.filter(F.col("child_id") == target).select("parent_id", "ord").first()
        if at is None:
            raise ToolError(f"{target} has no place in a tree")
        place = at.ord + (position == "after")
        later = ~hit & F.col("parent_id").eqNullSafe(F.lit(at.parent_id)) & (F.col("ord") >= place)
        moved = {"parent_id": F.when(hit, F.lit(at.parent_id)).otherwise(F.col("parent_id")), "ord": F.when(hit, place).when(later, F.col("ord") + 1).otherwise(F.col("ord")).cast("int")}
        return self._set(tool, df.withColumns(moved))

    def _link_typed(self, tool: Tool, args: dict) -> DataFrame:
        wanted = self.spark.createDataFrame([(args["type"],)], "wanted string")
        found = link_types(wanted, self.tables["link_types"]).first()
        if found is None or found.type is None:
            known = ", ".join(r.name for r in self.tables["link_types"].select("name").orderBy("ord").limit(100).collect())
            raise ToolError(f"Unknown link type {args['type']}; known: {known}")
        return self._append(tool, args | {"type": found.type})

    def _labels(self, tool: Tool, args: dict) -> DataFrame:
        labels = args["labels"] if isinstance(args["labels"], list) else [x.strip() for x in str(args["labels"]).split(",") if x.strip()]
        return self._set(tool, add_labels(self.tables[tool.table], self.spark.createDataFrame([(str(args["pageId"]), labels)], "page_id string, labels array<string>")))

    def _unlabel(self, tool: Tool, args: dict) -> DataFrame:
        hit = F.col("page_id") == str(args["pageId"])
        return self._set(tool, self.tables[tool.table].withColumn("labels", F.when(hit, F.array_remove("labels", args["name"])).otherwise(F.col("labels"))))

    def _publish(self, tool: Tool, args: dict) -> DataFrame:
        from docspark.functions.columns import page_id
        from docspark.operators.publish import to_storage

        from .export import publish_files, publishable

        given = args.get("pageId")
        if isinstance(args["source"], dict):  # a tree: texts by path
            files = self.spark.createDataFrame(list(args["source"].items()), "path string, content string")
            made = publish_files(publishable(files)).select(F.coalesce("page_id", F.sha2("path", 256)).alias("page_id"), "title", "storage")
            return self._set(tool, upsert(self.tables["pages"], made, ["page_id"]))
        files = self.spark.createDataFrame([("index.adoc", args["source"], given, args.get("url"))], "path string, content string, given string, url string")
        made = to_storage(publishable(files)).select(F.coalesce("given", page_id("url"), "page_id", F.sha2("path", 256)).alias("page_id"), "title", "storage")
        return self._set(tool, upsert(self.tables["pages"], made, ["page_id"]))


def as_text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def as_kind(text: Column, kind: T.DataType) -> Column:
    """A text as a value of a column: lists and objects are read as JSON, an element alone is a list of one."""
    if isinstance(kind, T.ArrayType):
        return F.when(F.trim(text).startswith("["), F.from_json(text, kind)).when(text.isNotNull(), F.array(text.try_cast(kind.elementType)))
    return F.from_json(text, kind) if isinstance(kind, (T.StructType, T.MapType)) else text.try_cast(kind)


def handlers() -> dict[str, Callable]:
    return {name: getattr(Catalog, f"_{t.action}") for name, t in ALL.items()}
