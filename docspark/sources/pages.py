"""Schemas and readers of document corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "struct<title:string,url:string>"
#: Schemas as DDL, since modules are imported before there is a session. A loaded page.
PAGE = (
    f"page_id string, title string, url string, version_when string, storage string, view string, attachments map<string,{REFERENCE}>, space string, created string, author string"
)
EDGE = "parent_id string, child_id string, title string, ord int"
LABEL = "page_id string, label string"
USER = "user_key string, display_name string, username string"
STATE = "page_id string, version_when string"
REMOTE = "page_id string, title string, number int, content_hash string"
#: A page as a server's JSON gives it; unknown fields are ignored and missing ones are null.
PAGE_JSON = (
    "id string, title string, version struct<when:string,number:int>, space struct<key:string>, "
    "history struct<createdDate:string,createdBy:struct<displayName:string>>, "
    "body struct<storage:struct<value:string>,view:struct<value:string>>, _links struct<base:string,webui:string>"
)
SEARCH_JSON = "results array<struct<title:string,space:struct<key:string>,_links:struct<webui:string>>>, start int, `limit` int, size int"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_from_json(df: DataFrame, json: str = "json") -> DataFrame:
    """Rows of ``PAGE`` (without attachments) from a column of page JSON; what can't be parsed gives nulls."""
    p = F.from_json(F.col(json), PAGE_JSON)
    return df.select(p.alias("p")).select(
        F.col("p.id").alias("page_id"), F.col("p.title").alias("title"), F.concat(F.coalesce("p._links.base", F.lit("")), F.col("p._links.webui")).alias("url"),
        F.col("p.version.when").alias("version_when"), F.col("p.body.storage.value").alias("storage"), F.col("p.body.view.value").alias("view"),
        F.lit(None).cast(f"map<string,{REFERENCE}>").alias("attachments"), F.col("p.space.key").alias("space"),
        F.col("p.history.createdDate").alias("created"), F.col("p.history.createdBy.displayName").alias("author"),
    )


def search_hits(df: DataFrame, json: str = "json", base: str = "") -> DataFrame:
    """(title, space, url) of each hit of search responses."""
    hits = df.select(F.explode(F.from_json(F.col(json), SEARCH_JSON)["results"]).alias("h"))
    return hits.select("h.title", F.col("h.space.key").alias("space"), F.concat(F.lit(base), F.col("h._links.webui")).alias("url"))


def as_list(json: str, path: str) -> Column:
    """A JSON field as an array of strings, whether it holds one value or a list."""
    value = F.get_json_object(json, path)
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value))


def read_adoc(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, content) of the AsciiDoc files of a folder, the extension in any case."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.[aA][dD][oO][cC]").option("recursiveFileLookup", recursive)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_attachments(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, bytes) of attached files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("content").alias("bytes"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """A stored link cache (kind, key, space, title, url) without the links that were not found."""
    schema = "kind string, key string, space string, title string, url string"
    return spark.read.schema(schema).json(path).filter("url is not null")


def labels_of(df: DataFrame, json: str = "json") -> DataFrame:
    """``df`` with ``labels``: the names of a label response, ``label`` where a name is missing, without blanks; none where the response can't be read."""
    found = F.from_json(F.col(json), "results array<struct<name:string,label:string>>")["results"]
    names = F.filter(F.transform(found, lambda x: F.trim(F.coalesce(x["name"], x["label"]))), lambda x: F.coalesce(x != "", F.lit(False)))
    return df.withColumn("labels", F.coalesce(names, F.array().cast("array<string>")))


def followed(responses: DataFrame, first: DataFrame) -> DataFrame:
    """(page, seq, title, url): the items of paged responses (url, json) from the ``first`` ones (url) on, through ``_links.next`` until there is none.

    Recorded responses stand for the server; a response that leads back ends its chain.
    """
    from docspark.operators.sitemap import closure

    body = "results array<struct<title:string,_links:struct<download:string>>>, _links struct<next:string>"
    known = responses.select(F.col("url").alias("at"), F.from_json("json", body).alias("j"))
    steps = known.filter("j._links.next is not null").select(F.col("at").alias("parent_id"), F.col("j._links.next").alias("child_id"), F.lit("").alias("title"))
    chain = closure(steps, first.select(F.col("url").alias("id"), F.lit("").alias("title")), paths=False)
    rows = chain.join(known, F.col("id") == F.col("at")).select("depth", F.posexplode("j.results").alias("pos", "item"))
    return rows.select(F.col("depth").alias("page"), F.col("pos").alias("seq"), F.col("item.title").alias("title"), F.col("item._links.download").alias("url"))


def attachments_of(items: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``followed`` items by title; the last one of a title wins."""
    return items.groupBy(*keys, "title").agg(F.max_by("url", F.struct("page", "seq")).alias("url"))


def spaces_of(df: DataFrame, json: str = "json") -> DataFrame:
    """(key, name) of space listings; those without a key are left out."""
    rows = df.select(F.explode(F.from_json(F.col(json), "results array<struct<key:string,name:string>>")["results"]).alias("s"))
    return rows.select("s.key", "s.name").filter("key is not null")


def users_of(df: DataFrame, json: str = "json", status: str = "status", base: str = "") -> DataFrame:
    """(user_key, title, url) of user responses; title and url are null where the server did not answer with success."""
    u = F.from_json(F.col(json), "userKey string, username string, displayName string")
    ok = F.col(status).between(200, 299)
    url = F.concat(F.lit(f"{base}/display/~"), F.coalesce(u["username"], u["userKey"]))
    return df.select("user_key", F.when(ok, u["displayName"]).alias("title"), F.when(ok, url).alias("url"))
