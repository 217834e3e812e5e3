"""Registered queries over the driver's tables, each with its SQL.

The engine's relations are bound to the tables like this: ``events`` are changes
of files (named by user and type), ``orders`` and ``lineitem`` are commits and
their changes, ``documents`` and ``pages`` are contents, ``conversations`` are
commit graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.config import CouplingConfig
from loamline.functions import languages, paths, people, text
from loamline.operators import commits, coupling, history, indicators, renames, users
from loamline.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

COUPLING = CouplingConfig(bucket_days=7, min_bursts=4, min_ratio=0.1, gap=900, overlap=900, min_distance=2)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Changes of files, from events.


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and t, every pair once."""
    e = table(spark, sf_dir, "events")
    file = F.array(F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")), "event_type", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")))
    return e.select(file.alias("file"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).distinct()


_CHANGES = """changes AS (
  SELECT DISTINCT concat('g', user_id % 3, '/', event_type, '/u', user_id % 4) AS file, epoch_us(ts) // 1000000 AS t FROM events
)"""
_BURSTS = f"""{_CHANGES},
opened AS (SELECT file, t, CASE WHEN t - lag(t) OVER (PARTITION BY file ORDER BY t) <= 900 THEN 0 ELSE 1 END AS o FROM changes),
runs AS (SELECT file, t, sum(o) OVER (PARTITION BY file ORDER BY t) AS burst FROM opened),
bursts AS (SELECT file, CAST(burst AS BIGINT) AS burst, min(t) AS s, max(t) AS e, count(*) AS events FROM runs GROUP BY 1, 2)"""
_LAYOUT = """layout AS (
  SELECT earliest, latest, (latest - earliest) // 604800 + 1 AS buckets, latest - 604800 * ((latest - earliest) // 604800 + 1) + 1 AS first_start
  FROM (SELECT min(t) AS earliest, max(t) AS latest FROM changes)
)"""
_BUCKETED = f"""{_BURSTS}, {_LAYOUT},
bucketed AS (SELECT b.*, first_start + (s - first_start) // 604800 * 604800 AS bucket_start FROM bursts b CROSS JOIN layout),
activity AS (SELECT file, bucket_start, count(*) AS activity_bursts FROM bucketed GROUP BY 1, 2)"""
_COUPLED = f"""{_BUCKETED},
met AS (
  SELECT DISTINCT b.file, b.bucket_start, b.burst, c.file AS other FROM bucketed b
  JOIN changes c ON c.t >= b.s - 900 AND c.t < b.e + 900 AND c.file <> b.file
),
together AS (SELECT file, bucket_start, other, count(*) AS together FROM met GROUP BY 1, 2, 3)"""
_COMMON = "len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[1:i] = {b}[1:i]))"


def _slashed(c: str) -> Column:
    return F.array_join(c, "/").alias(c)


@query("change_extract", f"WITH {_CHANGES} SELECT file, t FROM changes")
def change_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_changes(spark, sf_dir).select(_slashed("file"), "t")


@query("bursts", f'WITH {_BURSTS} SELECT file, burst, s AS "start", e AS "end", events FROM bursts')
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.bursts(event_changes(spark, sf_dir), COUPLING.gap).withColumn("file", _slashed("file"))


@query("bucket_layout", f"WITH {_CHANGES}, {_LAYOUT} SELECT * FROM layout")
def bucket_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.layout(event_changes(spark, sf_dir), COUPLING.bucket_size)


@query("bucket_of_bursts", f"WITH {_BUCKETED} SELECT file, burst, bucket_start FROM bucketed")
def bucket_of_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.bucketed_bursts(event_changes(spark, sf_dir), COUPLING.gap, COUPLING.bucket_size).select(_slashed("file"), "burst", "bucket_start")


@query("coupling_raw", f"WITH {_COUPLED} SELECT * FROM together")
def coupling_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = event_changes(spark, sf_dir)
    found = coupling.bucketed_bursts(changes, COUPLING.gap, COUPLING.bucket_size)
    return coupling.partners(changes, found, COUPLING.overlap).select(_slashed("file"), "bucket_start", _slashed("other"), "together")


@query(
    "coupling",
    f"""WITH {_COUPLED},
active AS (SELECT * FROM activity WHERE activity_bursts >= 4),
split AS (SELECT t.*, a.activity_bursts, string_split(t.file, '/') AS x, string_split(t.other, '/') AS y FROM together t JOIN active a USING (file, bucket_start)),
kept AS (
  SELECT file, bucket_start, other, together FROM (SELECT *, {_COMMON.format(a="x", b="y")} AS common FROM split)
  WHERE CAST(together AS DOUBLE) / activity_bursts >= 0.1 AND (common = 0 OR greatest(len(x), len(y)) - common >= 2)
)
SELECT a.file, a.bucket_start, a.bucket_start + 604799 AS bucket_end, a.activity_bursts, k.other, k.together
FROM active a LEFT JOIN kept k USING (file, bucket_start)""",
)
def coupling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity, coupled = coupling.couple(event_changes(spark, sf_dir), COUPLING)
    return activity.join(coupled, ["file", "bucket_start"], "left").select(_slashed("file"), "bucket_start", "bucket_end", "activity_bursts", _slashed("other"), "together")


@query(
    "coupling_lists",
    f"""WITH {_COUPLED},
active AS (SELECT * FROM activity WHERE activity_bursts >= 4),
split AS (SELECT t.*, a.activity_bursts, string_split(t.file, '/') AS x, string_split(t.other, '/') AS y FROM together t JOIN active a USING (file, bucket_start)),
kept AS (
  SELECT file, bucket_start, other, together, y FROM (SELECT *, {_COMMON.format(a="x", b="y")} AS common FROM split)
  WHERE CAST(together AS DOUBLE) / activity_bursts >= 0.1 AND (common = 0 OR greatest(len(x), len(y)) - common >= 2)
),
lists AS (SELECT file, bucket_start, string_agg(concat(other, ':', together), ',' ORDER BY y) AS coupled FROM kept GROUP BY 1, 2)
SELECT a.file, a.bucket_start, a.bucket_start + 604799 AS bucket_end, a.activity_bursts, coalesce(l.coupled, '') AS coupled
FROM active a LEFT JOIN lists l USING (file, bucket_start)""",
)
def coupling_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coupling.coupling(event_changes(spark, sf_dir), COUPLING)
    each = F.transform("coupled_files", lambda c: F.concat_ws(":", F.array_join(c["file"], "/"), c["count"].cast("string")))
    return found.select(_slashed("file"), "bucket_start", "bucket_end", "activity_bursts", F.array_join(each, ",").alias("coupled"))


# Paths.

_PAIRS = """files AS (SELECT DISTINCT string_split(concat('g', user_id % 3, '/', event_type, '/u', user_id % 4), '/') AS f FROM events),
pairs AS (SELECT a.f AS x, b.f AS y FROM files a JOIN files b ON a.f[2] = b.f[2])"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files of one event type."""
    files = event_changes(spark, sf_dir).select("file").distinct().withColumn("kind", F.col("file")[1])
    return files.select(F.col("file").alias("x"), "kind").join(files.select(F.col("file").alias("y"), "kind"), "kind").select("x", "y")


@query(
    "path_metrics",
    f"""WITH {_PAIRS}, m AS (SELECT x, y, {_COMMON.format(a="x", b="y")} AS c FROM pairs)
SELECT array_to_string(x, '/') AS x, array_to_string(y, '/') AS y, CAST(c AS INTEGER) AS common_roots,
  CAST(CASE WHEN c > 0 THEN greatest(len(x), len(y)) - c END AS INTEGER) AS distance FROM m""",
)
def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = paths.common_roots(F.col("x"), F.col("y"))
    return _pairs(spark, sf_dir).select(_slashed("x"), _slashed("y"), shared.alias("common_roots"), paths.distance(F.col("x"), F.col("y")).alias("distance"))


@query(
    "filter_pairs",
    f"""WITH {_PAIRS}, m AS (SELECT x, y, {_COMMON.format(a="x", b="y")} AS c FROM pairs)
SELECT array_to_string(x, '/') AS x, array_to_string(y, '/') AS y FROM m WHERE c <= 2 AND (c = 0 OR greatest(len(x), len(y)) - c >= 2)""",
)
def filter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).filter(paths.far_enough(F.col("x"), F.col("y"), 2, 2)).select(_slashed("x"), _slashed("y"))


_URL_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", "html", paths.components(bare).alias("path"))


@query(
    "tree_parent",
    f"""SELECT page_id, array_to_string(p, '/') AS path, array_to_string(p[1:len(p) - 1], '/') AS parent, CAST(len(p) AS INTEGER) AS depth
FROM (SELECT page_id, list_filter(string_split({_URL_PATH}, '/'), lambda x: x <> '') AS p FROM pages)""",
)
def tree_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).select("page_id", _slashed("path"), F.array_join(paths.parent(F.col("path")), "/").alias("parent"), F.size("path").alias("depth"))


@query(
    "repository_of",
    f"""WITH p AS (SELECT DISTINCT list_filter(string_split({_URL_PATH}, '/'), lambda x: x <> '') AS path FROM pages),
counted AS (SELECT path[1:n] AS root, n, count(*) AS c FROM (SELECT path, unnest([1, 2]) AS n FROM p) WHERE len(path) >= n GROUP BY 1, 2),
repos AS (SELECT array_to_string(root, '/') AS repo, root, row_number() OVER (ORDER BY n DESC, array_to_string(root, '/')) AS load_ord FROM counted WHERE c > 1)
SELECT array_to_string(p.path, '/') AS path, arg_min(r.repo, r.load_ord) AS repo FROM p JOIN repos r ON p.path[1:len(r.root)] = r.root GROUP BY 1""",
)
def repository_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    files = _page_paths(spark, sf_dir).select("path").distinct()
    prefixes = files.select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).filter("size(path) >= n").withColumn("root", F.slice("path", F.lit(1), F.col("n")))
    shared = prefixes.groupBy("root", "n").count().filter("count > 1").withColumn("repo", F.array_join("root", "/"))
    repos = shared.select("repo", "root", F.row_number().over(Window.orderBy(F.desc("n"), "repo")).alias("load_ord"))
    return history.repository_of(files, repos).withColumn("path", F.array_join("path", "/"))


# Histories, from orders and lineitem.


def _item_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    change = F.when(F.col("l_linenumber") == 1, "Add").otherwise("Modify")
    joined = i.join(o, i["l_orderkey"] == o["o_orderkey"])
    return joined.select(
        F.col("l_partkey").alias("file"), F.col("o_orderkey").alias("id"), change.alias("change"), seconds("l_shipdate").alias("commit_time"), seconds("o_orderdate").alias("author_time"),
        F.col("l_quantity").cast("long").alias("lines_added"), F.round(F.col("l_discount") * 100).cast("long").alias("lines_deleted"),
        F.array_sort(F.array_distinct(F.array(F.col("o_custkey"), F.col("l_suppkey")))).alias("users"),
    )


def _newest_item(spark: SparkSession, sf_dir: str) -> int | None:
    """The largest commit_time of :func:`_item_changes`. One of the newest items with an order proves it; only if none is found do all items meet all orders."""
    i, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    shipped = i.select("l_orderkey", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"))
    newest = shipped.agg(F.max("t")).first()[0]
    keys = [r[0] for r in shipped.filter((F.col("t") == newest) & F.col("l_orderkey").isNotNull()).limit(100).collect()] if newest is not None else []
    if keys and not o.filter(F.col("o_orderkey").isin(keys)).isEmpty():
        return newest
    return _item_changes(spark, sf_dir).agg(F.max("commit_time")).first()[0]


_HISTORY = """h AS (
  SELECT l_partkey AS file, o_orderkey AS id, CASE WHEN l_linenumber = 1 THEN 'Add' ELSE 'Modify' END AS change,
    epoch_us(l_shipdate) // 1000000 AS commit_time, epoch_us(o_orderdate) // 1000000 AS author_time,
    CAST(trunc(l_quantity) AS BIGINT) AS added, CAST(round(l_discount * 100) AS BIGINT) AS deleted,
    list_sort(list_distinct([o_custkey, l_suppkey])) AS users
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


@query(
    "file_activity",
    f"""WITH {_HISTORY}, newest AS (SELECT max(commit_time) AS last_commit FROM h),
people AS (SELECT file, list_sort(list(DISTINCT u)) AS users FROM (SELECT file, unnest(users) AS u FROM h) GROUP BY 1),
base AS (SELECT file, max(commit_time) AS last_update, min(CASE WHEN change = 'Add' THEN author_time END) AS added, min(author_time) AS first FROM h GROUP BY 1)
SELECT b.file, last_update, (last_commit - last_update) // 86400 AS age_in_days, CASE WHEN added <= first THEN added END AS creation_date,
  array_to_string(users, ',') AS users, CAST(len(users) AS BIGINT) AS user_count
FROM base b JOIN people p ON p.file = b.file CROSS JOIN newest""",
)
def file_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = _newest_item(spark, sf_dir)
    found = history.activity(_item_changes(spark, sf_dir).filter(F.col("file").isNotNull()), newest if newest is not None else 0)
    return found.withColumn("users", F.array_join(F.col("users").cast("array<string>"), ","))


@query(
    "details_by_day_users",
    f"""WITH {_HISTORY} SELECT file, author_time // 86400 * 86400 AS day, array_to_string(users, ',') AS users, count(*) AS commits,
  CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted FROM h GROUP BY 1, 2, 3""",
)
def details_by_day_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.details(_item_changes(spark, sf_dir)).withColumn("users", F.array_join(F.col("users").cast("array<string>"), ","))


@query("last_commit", "SELECT o_custkey % 7 AS repo, max(epoch_us(o_orderdate) // 1000000) AS last_commit FROM orders GROUP BY 1")
def last_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return history.last_commits(o.select((F.col("o_custkey") % 7).alias("repo"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("commit_time")))


_HORIZON = 694224000  # 1992-01-01


@query(
    "prefix_cut",
    f"""WITH o AS (SELECT o_custkey % 50 AS repo, o_orderkey AS ord, epoch_us(o_orderdate) // 1000000 AS t FROM orders),
h AS (SELECT quantile_disc(t, 0.02) AS since FROM o), cut AS (SELECT repo, min(ord) AS c FROM o, h WHERE t < since GROUP BY 1)
SELECT o.repo, o.ord, o.t AS commit_time FROM o LEFT JOIN cut USING (repo) WHERE c IS NULL OR ord < c""",
)
def prefix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    log = o.select((F.col("o_custkey") % 50).alias("repo"), F.col("o_orderkey").alias("ord"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("commit_time"))
    since = log.agg(F.expr("percentile_disc(0.02) within group (order by commit_time)")).first()[0]
    return commits.until_horizon(log, int(since or _HORIZON))


def _order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits; those with many lines are merges."""
    i = table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*(F.lit(s) for s in ("A", "M", "D", "R100", "C75", "T", "M"))), F.col("l_linenumber"))
    change = F.struct(F.col("l_partkey").alias("file"), commits.change_kind(status).alias("change"), F.col("l_linenumber").alias("l_linenumber"))
    grouped = i.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", change.alias("c")))).alias("s"))
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("s") - 4)), lambda x: x)
    return grouped.select("id", parents.alias("parents"), F.transform("s", lambda x: x["c"]).alias("file_changes"))


@query(
    "merge_policy",
    """WITH n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS id, l_partkey AS file, CAST(l_linenumber AS INTEGER) AS l_linenumber,
  CASE l_linenumber WHEN 1 THEN 'Add' WHEN 2 THEN 'Modify' WHEN 3 THEN 'Delete' WHEN 4 THEN 'Rename' WHEN 5 THEN 'Copied' WHEN 7 THEN 'Modify' END AS change
FROM lineitem JOIN n ON n.id = l_orderkey WHERE n.n <= 5""",
)
def merge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.changes(_order_log(spark, sf_dir), include_merges=False).select("id", "file", "l_linenumber", "change")


# People.


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers seen under several spellings."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "c_name", "c_mktsegment")
    name = F.when((F.col("c_custkey") + F.col("k")) % 3 == 0, F.upper("c_name")).when((F.col("c_custkey") + F.col("k")) % 3 == 1, F.lower("c_name")).otherwise(F.col("c_name"))
    return c.select(people.user(F.when(F.col("c_custkey") % 11 != 0, name), F.lower("c_mktsegment")).alias("user"), ((F.col("c_custkey") * 7919) % 10007).alias("a"), "k", "c_custkey")


@query(
    "user_dictionary",
    """WITH v AS (
  SELECT CASE WHEN c_custkey % 11 <> 0 THEN CASE (c_custkey + k) % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN lower(c_name) ELSE c_name END END AS name,
    lower(c_mktsegment) AS email, (c_custkey * 7919) % 10007 AS a, k, c_custkey FROM customer, (SELECT unnest([0, 1]) AS k)
),
firsts AS (
  SELECT lower(name) AS ln, lower(email) AS le, arg_min({'n': name, 'e': email}, (a, k, c_custkey)) AS u, min((a, k, c_custkey)) AS o FROM v GROUP BY 1, 2
)
SELECT row_number() OVER (ORDER BY o) - 1 AS user_id, u.n AS name, u.e AS email FROM firsts""",
)
def user_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = users.dictionary(_variants(spark, sf_dir))
    return found.select("user_id", "user.name", "user.email")


@query(
    "change_users",
    """WITH d AS (SELECT DISTINCT lower(c_name) AS name FROM customer), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM d),
p AS (
  SELECT o_orderkey AS id, lower(unnest([a.c_name, b.c_name])) AS name
  FROM orders JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey // 2
)
SELECT p.id, array_to_string(list_sort(list(DISTINCT n.id)), ',') AS users FROM p JOIN n ON n.name = p.name GROUP BY 1""",
)
def change_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", people.user(F.col("c_name"), F.lit(None).cast("string")).alias("u"))
    o = table(spark, sf_dir, "orders")
    both = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("u").alias("author")), "o_custkey").withColumn("half", F.floor(F.col("o_custkey") / 2))
    both = both.join(c.select(F.col("c_custkey").alias("half"), F.array("u").alias("others")), "half", "left")
    rows = both.select(F.col("o_orderkey").alias("id"), people.people_of_change(F.col("author"), F.col("author"), F.col("others")).alias("people"))
    known = users.dictionary(c.select(F.col("u").alias("user"), F.lower("u.name").alias("order")))
    return users.numbered(rows, known, ["id"]).withColumn("users", F.array_join(F.col("users").cast("array<string>"), ","))


_MESSAGE = """concat('Change ', doc_id, chr(10), chr(10), 'Co-authored-by: ', source, ' <', source, '@example.org>', chr(10),
  CASE doc_id % 3 WHEN 0 THEN concat('  Co-authored-by:  ', lang, '@example.org ') WHEN 1 THEN concat('Co-authored-by: ', lang) ELSE 'co-authored-by: nobody' END)"""


@query(
    "coauthors",
    f"""WITH m AS (SELECT doc_id, regexp_extract_all({_MESSAGE}, '(?m)^\\s*Co-authored-by:(.*)$', 1) AS found FROM documents),
each AS (SELECT doc_id, unnest(found) AS t, unnest(range(0, len(found))) AS pos FROM m)
SELECT doc_id, CAST(pos AS INTEGER) AS pos,
  CASE WHEN regexp_matches(t, '^(.*)<([^>]+)>\\s*$') THEN trim(regexp_extract(t, '^(.*)<([^>]+)>\\s*$', 1)) WHEN NOT contains(t, '@') THEN trim(t) END AS name,
  CASE WHEN regexp_matches(t, '^(.*)<([^>]+)>\\s*$') THEN trim(regexp_extract(t, '^(.*)<([^>]+)>\\s*$', 2)) WHEN contains(t, '@') THEN trim(t) END AS email
FROM each""",
)
def coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  Co-authored-by:  "), "lang", F.lit("@example.org "))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Co-authored-by: "), "lang")).otherwise("co-authored-by: nobody")
    message = F.concat(F.lit("Change "), F.col("doc_id").cast("string"), F.lit("\n\nCo-authored-by: "), "source", F.lit(" <"), "source", F.lit("@example.org>\n"), end)
    each = d.select("doc_id", F.posexplode(people.co_authors(message)).alias("pos", "u"))
    return each.select("doc_id", "pos", "u.name", "u.email")


@query("summaries", "SELECT doc_id, coalesce(nullif(trim(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1]), ''), '[no message]') AS summary FROM documents")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", people.summary(F.col("text")).alias("summary"))


# Renames, from conversations as commit graphs: a turn is a commit, its parent the turn before.


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("repo"), "turn").distinct()
    parent = F.when(F.col("turn") > 0, F.array((F.col("turn") - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    log = c.select("repo", F.col("turn").cast("string").alias("id"), (-F.col("turn")).alias("ord"), parent.alias("parents"))
    gone = (F.col("repo").cast("long") % 5 == 0) & (F.col("turn") == 3)
    changes = c.select(
        "repo", F.col("turn").cast("string").alias("id"), F.lit(0).alias("change_ord"),
        F.when(gone, "Delete").when(F.col("turn") == 0, "Add").otherwise("Rename").alias("change"),
        F.when(gone, F.concat(F.lit("f"), (F.col("turn") - 1).cast("string"))).otherwise(F.concat(F.lit("f"), F.col("turn").cast("string"))).alias("file"),
        F.when(~gone & (F.col("turn") > 0), F.concat(F.lit("f"), (F.col("turn") - 1).cast("string"))).alias("old_file"),
    )
    return log, changes


@query("first_child", "SELECT CAST(a.conv_id AS VARCHAR) AS repo, CAST(a.turn AS VARCHAR) AS id, CAST(b.turn AS VARCHAR) AS child FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def first_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renames.first_children(_graph(spark, sf_dir)[0])


@query(
    "final_name",
    """WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), n AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY 1)
SELECT CAST(c.conv_id AS VARCHAR) AS repo, CAST(turn AS VARCHAR) AS id, concat('f', turn) AS file, concat('f', last) AS final
FROM c JOIN n USING (conv_id) WHERE NOT (c.conv_id % 5 = 0 AND last >= 3 AND turn < 3) AND NOT (c.conv_id % 5 = 0 AND turn = 3)""",
)
def final_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, changes = _graph(spark, sf_dir)
    kept = changes.filter("change <> 'Delete'").select("repo", "id", "file")
    return renames.final_names(kept, log, changes)


# Texts, from documents and pages.


@query(
    "language_detect",
    f"""WITH n AS (SELECT page_id, coalesce(list_filter(string_split({_URL_PATH}, '/'), lambda x: x <> '')[-1], '') AS name FROM pages)
SELECT page_id, name, CASE WHEN lower(name) SIMILAR TO '.+\\.html?' THEN 'HTML' WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^.+\\.([^.]*)$', 1) ELSE 'no_extension' END AS language FROM n""",
)
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.element_at("path", -1), F.lit(""))
    pages = _page_paths(spark, sf_dir).select("page_id", name.alias("name"))
    return pages.select("page_id", "name", languages.language(F.col("name"), languages.known_language(F.col("name"))).alias("language"))


def _files(spark: SparkSession, sf_dir: str, name: str = "file.txt") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("path"), F.lit(name).alias("name"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").alias("length"))


_ROWS = "string_split(text, chr(10))"
_WHOLE = f"CASE WHEN {_ROWS}[-1] = '' THEN {_ROWS}[1:len({_ROWS}) - 1] ELSE {_ROWS} END"


def _loc_sql(language: str, kind: str) -> str:
    blank = "len(list_filter(w, lambda x: regexp_full_match(x, '[\\s\\x0b]*')))"
    code, comments = ("0", f"len(w) - {blank}") if kind == "comments" else (f"len(w) - {blank}", "0")
    return f"""WITH d AS (SELECT doc_id AS path, strlen(text) AS bytes, {_WHOLE} AS w FROM documents)
SELECT path, '{language}' AS language, false AS "binary", CAST({blank} AS BIGINT) AS blanks, CAST({code} AS BIGINT) AS code, CAST({comments} AS BIGINT) AS comments,
  CAST(len(w) AS BIGINT) AS lines, bytes FROM d"""


@query("loc_documents", _loc_sql("Plain Text", "comments"))
def loc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.loc(_files(spark, sf_dir)).select("path", "loc.*")


@query("loc_unknown", _loc_sql("odd", "comments"))
def loc_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.loc(_files(spark, sf_dir, "x.odd")).select("path", "loc.*")


@query("loc_unknown_as_code", _loc_sql("odd", "code"))
def loc_unknown_as_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.loc(_files(spark, sf_dir, "x.odd"), unknown_as_text=False).select("path", "loc.*")


@query("loc_pages")
def loc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    files = p.select(F.col("page_id").alias("path"), F.lit("page.html").alias("name"), F.encode("html", "UTF-8").alias("content"), F.octet_length("html").alias("length"))
    return indicators.loc(files).select("path", "loc.*")


@query(
    "binary_sniff",
    """SELECT doc_id, doc_id % 4 IN (1, 3) AS is_binary FROM documents""",
)
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    plain = F.encode("text", "UTF-8")
    k = F.col("doc_id") % 4
    content = F.when(k == 1, F.concat(F.lit(bytearray(b"ab\0")), plain)).when(k == 2, F.concat(F.lit(bytearray(b"\xff\xfe\0")), plain)).when(k == 3, F.concat(F.lit(bytearray(b"%PDF")), plain)).otherwise(plain)
    return d.select("doc_id", text.is_binary(content).alias("is_binary"))


@query(
    "first_paragraph",
    r"""WITH m AS (SELECT doc_id, concat(chr(10), ' ', doc_id, ' one', chr(10), '  two ', CASE WHEN doc_id % 3 = 0 THEN concat(chr(9), chr(10), ' ', chr(10)) ELSE chr(10) END, 'three', chr(10), chr(10), 'rest') AS t FROM documents)
SELECT doc_id, concat(doc_id, ' one two', CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' three' END) AS summary FROM m""",
)
def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    middle = F.when(F.col("doc_id") % 3 == 0, "\t\n \n").otherwise("\n")
    message = F.concat(F.lit("\n "), F.col("doc_id").cast("string"), F.lit(" one\n  two "), middle, F.lit("three\n\nrest"))
    return d.select("doc_id", people.first_paragraph(message).alias("summary"))


@query(
    "decoded_wide",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN concat(text, chr(65533)) ELSE concat(chr(65533), 'a', text) END AS text FROM documents""",
)
def decoded_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide texts of either byte order, whole, with a single last byte, and with a surrogate alone."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    raw = lambda x: F.lit(bytearray(x))
    big, little = F.encode("text", "UTF-16BE"), F.encode("text", "UTF-16LE")
    content = (
        F.when(k == 0, F.concat(raw(b"\xfe\xff"), big)).when(k == 1, F.concat(raw(b"\xff\xfe"), little))
        .when(k == 2, F.concat(raw(b"\xff\xfe"), little, raw(b"a"))).otherwise(F.concat(raw(b"\xfe\xff\xd8\x01\x00a"), big))
    )
    return d.select("doc_id", text.decoded(content).alias("text"))


@query(
    "changes_of_code",
    """WITH h AS (SELECT concat('u', user_id % 50) AS file, epoch_us(ts) // 1000000 AS t, event_id % 3 AS added, event_id % 2 AS deleted FROM events),
loc AS (SELECT DISTINCT file, CAST(substr(file, 2) AS BIGINT) % 4 AS code FROM h)
SELECT DISTINCT h.file, h.t FROM h JOIN loc USING (file) WHERE loc.code > 0 AND (h.added > 0 OR h.deleted > 0)""",
)
def changes_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with changed lines, of files with code."""
    e = table(spark, sf_dir, "events")
    h = e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("file"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        (F.col("event_id") % 3).alias("added"), (F.col("event_id") % 2).alias("deleted"),
    )
    loc = h.select("file").distinct().withColumn("code", F.substring("file", 2, 9).cast("long") % 4)
    return coupling.extract_changes(loc, h)


@query(
    "loc_binary",
    """SELECT doc_id AS path, doc_id % 3 = 0 AS "binary", CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS "lines", CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS comments,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS blanks, CAST(0 AS BIGINT) AS code, CAST(6 AS BIGINT) AS bytes FROM documents""",
)
def loc_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary files count nothing but their bytes."""
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 3 == 0, F.lit(bytearray(b"ab\0\n\nc"))).otherwise(F.lit(bytearray(b"abcd\n\n")))
    files = d.select(F.col("doc_id").alias("path"), F.lit("file.unknown").alias("name"), content.alias("content"), F.length(content).alias("length"))
    return indicators.loc(files).select("path", *(f"loc.{c}" for c in ("binary", "lines", "comments", "blanks", "code", "bytes")))


@query(
    "code_lines",
    """WITH d AS (SELECT doc_id, unnest(range(0, 3)) AS i FROM documents)
SELECT doc_id AS path, CAST(i AS INTEGER) AS line_no, CAST(CASE WHEN i = 1 THEN doc_id % 5 ELSE 0 END AS INTEGER) AS spaces,
  CAST(CASE WHEN i = 2 THEN 1 ELSE 0 END AS INTEGER) AS tabs, CAST(CASE i WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 6 END AS INTEGER) AS text FROM d""",
)
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file of code without its comments, numbered as they are left."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("x = 1\n# no\n"), F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int")), F.lit("y\n# no\n\tz = 22\n  # no\n"))
    files = d.select(F.col("doc_id").alias("path"), F.lit("file.py").alias("name"), F.encode(body, "UTF-8").alias("content"), F.octet_length(body).alias("length"))
    return indicators.code_lines(files)


@query("decoded", "SELECT doc_id, concat(text, chr(65533), '!') AS text FROM documents")
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    marked = F.when(F.col("doc_id") % 2 == 0, F.lit(bytearray(b"\xef\xbb\xbf"))).otherwise(F.lit(bytearray(b"")))
    return d.select("doc_id", text.decoded(F.concat(marked, F.encode("text", "UTF-8"), F.lit(bytearray(b"\xff!")))).alias("text"))


_INDENTED = f"""d AS (SELECT doc_id, unnest({_ROWS}) AS line, unnest(range(0, len({_ROWS}))) AS line_no FROM documents),
l AS (SELECT doc_id, line_no, concat(repeat(' ', CAST((doc_id + line_no) % 7 AS BIGINT)), CASE WHEN line_no % 5 = 0 THEN chr(9) ELSE '' END, line) AS line FROM d),
x AS (
  SELECT doc_id, line_no, len(lead) - len(replace(lead, ' ', '')) AS spaces, len(replace(lead, ' ', '')) AS tabs,
    len(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS text
  FROM (SELECT *, regexp_extract(line, '^[ \\t]*') AS lead FROM l)
)"""


def _indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    indent = F.repeat(F.lit(" "), ((F.col("doc_id") + F.col("line_no")) % 7).cast("int"))
    line = F.concat(indent, F.when(F.col("line_no") % 5 == 0, "\t").otherwise(""), "line")
    return d.select("doc_id", "line_no", text.leading(line).alias("x")).select("doc_id", "line_no", "x.*")


@query("line_tokens", f"WITH {_INDENTED} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(spaces AS INTEGER) AS spaces, CAST(tabs AS INTEGER) AS tabs, CAST(text AS INTEGER) AS text FROM x")
def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indented(spark, sf_dir)


@query(
    "indentation_stats",
    f"""WITH {_INDENTED}, i AS (SELECT doc_id, spaces + 4 * tabs AS n FROM x WHERE text > 0)
SELECT doc_id, count(*) AS lines, min(n) AS minimum, max(n) AS maximum, quantile_disc(n, 0.5) AS median, quantile_disc(n, 0.75) AS p75, quantile_disc(n, 0.9) AS p90,
  quantile_disc(n, 0.99) AS p99, round(stddev_pop(n), 6) AS stddev, CAST(sum(n) AS BIGINT) AS sum FROM i GROUP BY 1""",
)
def indentation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.indentation(_indented(spark, sf_dir), "doc_id").select("doc_id", "indentation.*")
    return found.withColumn("stddev", F.round("stddev", 6))
