"""URL filters by a temporal list join: dated list entries become validity intervals, and an as-of join evaluates each capture
against the entries active when it was fetched.

An entry is (list_name, pattern, action, at): a host, with all its subdomains, or a host and the beginning of a path, is put on a list ('add') or
taken off ('remove') at a time. Successive entries of a list and pattern give intervals from one up to the next, closed on the left. A capture is blocked if the most
specific active pattern that fits it (a longer path first, then a longer host) is on a blocking list; of patterns alike in that, one on the list ALLOW wins.

The join is on the pattern: a capture has as many candidate patterns as its host has labels times its path beginnings that end before a slash or
with it all; none is left out. Spark broadcasts the intervals
where they are small, and else shuffles the candidates, which hold no page content.

Defined cases: a null or malformed url fits nothing and isn't blocked (host null); nor does a capture without a time. Entries with a null in any column or
an unknown action are ignored, as are repeated ones; of 'add' and 'remove' at one time, 'remove' counts. Repeated captures
are joined each; other columns are ignored; an empty list blocks nothing and no captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.text import picked, table
from graphloom.session import written

ALLOW = "allow"


def host_of(url: Column) -> Column:
    """The lower-case host without port, user or a last dot; null if there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def path_of(url: Column) -> Column:
    """The path without query and fragment, from its slash; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, pattern, active_from, active_to (null: to this day) of the times that patterns are on lists."""
    e = picked(entries, list_name="string", pattern="string", action="string", at="timestamp").dropna().where("action in ('add', 'remove')")
    e = e.groupBy("list_name", "pattern", "at").agg(F.max("action").alias("action"))
    of = Window.partitionBy("list_name", "pattern").orderBy("at")
    return e.withColumn("active_to", F.lead("at").over(of)).where("action = 'add'").select("list_name", "pattern", F.col("at").alias("active_from"), "active_to")


def candidates(captures: DataFrame) -> DataFrame:
    """Captures with their host and the patterns that could fit."""
    c = captures.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels, segments = F.split("host", r"\."), F.split("path", "/")  # the first segment, before the slash, is empty
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "/"))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(F.concat(h, p).alias("pattern"), F.length(p).alias("path_length"), F.length(h).alias("host_length")))))
    return c.withColumn("fits", F.when(F.col("host").isNotNull(), both)).drop("path")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each capture: page_id, url, host, fetched_at, blocked, list_name and pattern of the entry that decides, and n_active, how many
    entries are active and fit."""
    # A capture's number is written, as one that is computed twice may differ when a task is run again.
    c = picked(captures, page_id="bigint", url="string", fetched_at="timestamp").withColumn("row", F.monotonically_increasing_id())
    c = candidates(written(c, "captures"))
    keys = c.where("fetched_at is not null").select("row", "fetched_at", F.explode("fits").alias("f")).select("row", "fetched_at", "f.*")
    live = intervals(entries)
    hit = keys.join(live, "pattern").where((F.col("fetched_at") >= F.col("active_from")) & (F.col("active_to").isNull() | (F.col("fetched_at") < F.col("active_to"))))
    rank = F.struct(F.col("path_length"), F.col("host_length"), (F.col("list_name") == ALLOW).alias("allow"), F.col("list_name"), F.col("pattern"))
    best = hit.groupBy("row").agg(F.max(rank).alias("b"), F.count("*").alias("n_active"))
    out = c.drop("fits").join(best, "row", "left")
    return out.select("page_id", "url", "host", "fetched_at", F.coalesce(F.col("b.list_name") != ALLOW, F.lit(False)).alias("blocked"), F.col("b.list_name").alias("list_name"), F.col("b.pattern").alias("pattern"), F.coalesce("n_active", F.lit(0)).alias("n_active"))


#: The list and the fetch times of the query. Neither is in the tables, so both are made from the pages' hosts and ids: CHANGES dated entries
#: for each host, of the host, its parent domain or one of its directories, over a year.
CHANGES, START, DIGITS = 6, 1_704_067_200, "0123456789abcdef"


def captures_of(pages: DataFrame) -> DataFrame:
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525_600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(START) + minute * 60).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    e = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(CHANGES - 1))).alias("k"))
    e = e.withColumn("h", F.md5(F.concat_ws("#", "host", F.col("k").cast("string"))))
    d = lambda i: f"(instr('{DIGITS}', substr(h, {i}, 1)) - 1)"
    return e.select(
        F.expr(f"element_at(array('ads', 'malware', 'spam', '{ALLOW}'), cast({d(1)} % 4 as int) + 1)").alias("list_name"),
        F.expr(f"case when {d(2)} < 8 then host when {d(2)} < 12 then regexp_replace(host, '^[^.]+[.](.+[.])', '$1') else concat(host, '/', element_at(array('en', 'de', 'fr', 'es'), cast({d(2)} % 4 as int) + 1)) end").alias("pattern"),
        F.expr(f"case when {d(3)} < 10 then 'add' else 'remove' end").alias("action"),
        F.expr(f"timestamp_seconds({START} + 480 * ({d(4)} * 4096 + {d(5)} * 256 + {d(6)} * 16 + {d(7)}))").alias("at"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(captures_of(pages), entries_of(pages)).drop("fetched_at")


ORACLE = rf"""
with c as (
    select row_number() over () as row, page_id, url, {START} + 60 * ((page_id * 7919) % 525600) as t,
        nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') as host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) as path
    from pages
), h as (
    select host, md5(host || '#' || k) as h from (select distinct host from c where host is not null), range({CHANGES}) as r(k)
), d as (
    select host, h, [instr('{DIGITS}', substr(h, i, 1)) - 1 for i in range(1, 8)] as d from h
), e as (
    select ['ads', 'malware', 'spam', '{ALLOW}'][d[1] % 4 + 1] as list_name,
        case when d[2] < 8 then host when d[2] < 12 then regexp_replace(host, '^[^.]+[.](.+[.])', '\1') else host || '/' || ['en', 'de', 'fr', 'es'][d[2] % 4 + 1] end as pattern,
        case when d[3] < 10 then 'add' else 'remove' end as action,
        {START} + 480 * (d[4] * 4096 + d[5] * 256 + d[6] * 16 + d[7]) as since
    from d
), u as (
    select list_name, pattern, since, max(action) as action from e group by all
), v as (
    select list_name, pattern, action, since, coalesce(lead(since) over (partition by list_name, pattern order by since), 1e12) as until,
        split_part(pattern, '/', 1) as p_host, regexp_extract(pattern, '/.*$', 0) as p_path
    from u
), hit as (
    select row, list_name, pattern, row_number() over (partition by row order by length(p_path) desc, length(p_host) desc, (list_name = '{ALLOW}')::int desc, list_name desc, pattern desc) as k,
        count(*) over (partition by row) as n
    from c, v
    where v.action = 'add' and t >= since and t < until and (host = p_host or ends_with(host, '.' || p_host)) and (p_path = '' or path = p_path or starts_with(path, p_path || '/'))
)
select page_id, url, host, coalesce(list_name <> '{ALLOW}', false) as blocked, list_name, pattern, coalesce(n, 0) as n_active
from c left join (from hit where k = 1) using (row)
"""
