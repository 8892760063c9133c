"""URL filters as a temporal list join, in built-in functions only.

List entries are dated: from a day on, a key is on a list or off it again. Per list and key these become
validity intervals. A capture asks for all keys that its URL falls under (its host and the domains
above it, its path and the paths above it), and an as-of join finds the entries that were active when it
was fetched. The most specific active entry decides.

Both sides are joined on (key, month), intervals once per month they cover, so a host with a third of all captures, or an entry that changes
often, is spread over months; the runtime re-plan splits what is still hot. Nothing is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import settle

ADDRESS = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case; '' where the URL has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def keys_of(url: Column) -> Column:
    """``d:`` keys of the host and the domains above it, ``p:`` keys of the path and the paths above it. No host, no keys."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(
        F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) with until exclusive (null: open) from dated entries (list, key, day, listed).

    Entries of one list, key and day count as one, off the list if any of them says so. Rows without list, key, day or listed are ignored."""
    days = entries.filter("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND listed IS NOT NULL") \
        .groupBy("list", "key", "day").agg(F.min("listed").alias("listed"))
    until = F.lead("day").over(W.partitionBy("list", "key").orderBy("day"))
    return days.withColumn("until", until).filter("listed").select("list", "key", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched",
             allow: str = "allow") -> DataFrame:
    """``captures`` and four columns: blocked, decided_by (key), decided_list, n_active.

    The active entry with the longest key decides (of equal keys one that blocks, then the first list by name); the list named ``allow`` lets through, all
    others block. Without an active entry, with a null URL or day, or without a host in the URL: not blocked, no deciding key, n_active 0.
    Rows that repeat are all kept and answered alike; columns of those four names must not be in ``captures``.
    """
    valid = settle(intervals(entries), "url_intervals")
    asked = captures.select(F.col(url_col).alias("u"), F.col(day_col).alias("t")).filter("u IS NOT NULL AND t IS NOT NULL").distinct()
    span = captures.agg(F.min(day_col).alias("lo"), F.max(day_col).alias("hi")).first()
    # months outside the captures' own are never asked for
    lo, hi = F.lit(span.lo).cast("date"), F.lit(span.hi).cast("date")
    covered = valid.filter(F.col("since") <= hi).filter(F.coalesce(F.col("until") > lo, F.lit(True))) \
        .withColumn("month", F.explode(F.sequence(
            F.trunc(F.greatest("since", lo), "month"),
            F.greatest(F.trunc(F.greatest("since", lo), "month"), F.trunc(F.least(F.coalesce(F.date_sub("until", 1), hi), hi), "month")),
            F.expr("interval 1 month"))))
    keyed = asked.withColumn("month", F.trunc("t", "month")).withColumn("key", F.explode(keys_of(F.col("u"))))
    active = keyed.join(covered, ["key", "month"]).filter("since <= t AND (until IS NULL OR t < until)")
    rank = F.struct(F.length("key").alias("n"), (F.col("list") != allow).alias("blocks"), "key")
    found = active.groupBy("u", "t").agg(
        F.count("*").alias("n"), F.max(rank).alias("best"),
        F.min_by("list", F.struct(-F.length("key"), F.col("list") == allow, "list")).alias("by"))
    joined = captures.join(found.alias("__found"), captures[url_col].eqNullSafe(F.col("__found.u")) & captures[
        day_col].eqNullSafe(F.col("__found.t")), "left")
    blocked = F.coalesce("__found.best.blocks", F.lit(False))
    return joined.select(*[captures[c] for c in captures.columns], blocked.alias("blocked"),
                         F.col("__found.best.key").alias("decided_by"), F.col("__found.by").alias("decided_list"),
                         F.coalesce("__found.n", F.lit(0)).alias("n_active"))


# --- the registered query: lists that are derived from the pages' own hosts and paths ------------

def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages hold no fetch day; it follows from the page id, over two years."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (
        (F.col("page_id") * 7919) % 730).cast("int")).alias("fetched"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def derived_entries(pages: DataFrame) -> DataFrame:
    """Half of all hosts are on a list, off it and on again; two thirds of their first paths are let through or blocked for a time."""
    places = pages.select(host_of(F.col("url")).alias("h"), F.split_part(F.concat(path_of(F.col("url")), F.lit("/")), F.lit("/"), F.lit(2)).alias("s"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = places.select("h").distinct().filter("h <> ''").withColumn("x", _number(F.col("h"))).filter("x % 2 = 0")
    name = F.element_at(F.array(F.lit("malware"), F.lit("phishing"), F.lit("spam")), (F.col("x") % 3 + 1).cast("int"))
    turn = lambda n, listed: F.struct(day(n).alias("day"), F.lit(listed).alias("listed"))
    turns = F.array(turn(F.col("x") % 500, True), turn(F.col("x") % 500 + 20 + F.col("x") % 97, False),
                    turn(F.col("x") % 500 + 200, True))
    by_host = hosts.select(name.alias("list"), F.concat(F.lit("d:"), "h").alias("key"), F.explode(turns).alias("e"))
    paths = places.distinct().filter("h <> '' AND s <> ''").withColumn("y", _number(F.concat("h", F.lit("/"), "s"))).filter("y % 3 < 2")
    once = F.when(F.col("y") % 3 == 0, F.array(turn(F.col("y") % 600, True))).otherwise(
        F.array(turn(F.col("y") % 400, True), turn(F.col("y") % 400 + 90, False)))
    by_path = paths.select(F.when(F.col("y") % 3 == 0, "allow").otherwise("adult").alias("list"),
                           F.concat(F.lit("p:"), "h", F.lit("/"), "s").alias("key"), F.explode(once).alias("e"))
    return by_host.unionAll(by_path).select("list", "key", "e.day", "e.listed")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 730 AS INTEGER) AS fetched,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)', 1)) AS h,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)', 2) AS path FROM pages),
places AS (SELECT DISTINCT h, split_part(path || '/', '/', 2) AS s FROM p WHERE h <> ''),
hosts AS (SELECT DISTINCT h, CAST('0x' || substr(md5(h), 1, 6) AS INTEGER) AS x FROM places),
paths AS (SELECT h, s, CAST('0x' || substr(md5(h || '/' || s), 1, 6) AS INTEGER) AS y FROM places WHERE s <> ''),
e AS (SELECT CASE x % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'phishing' ELSE 'spam' END AS list, 'd:' || h AS key, x % 500 + t.d AS day, t.listed
      FROM hosts, LATERAL (VALUES (0, true), (20 + x % 97, false), (200, true)) t(d, listed) WHERE x % 2 = 0
      UNION ALL SELECT 'allow', 'p:' || h || '/' || s, y % 600, true FROM paths WHERE y % 3 = 0
      UNION ALL SELECT 'adult', 'p:' || h || '/' || s, y % 400, true FROM paths WHERE y % 3 = 1
      UNION ALL SELECT 'adult', 'p:' || h || '/' || s, y % 400 + 90, false FROM paths WHERE y % 3 = 1),
v AS (SELECT list, key, DATE '2024-01-01' + CAST(day AS INTEGER) AS since, listed,
             DATE '2024-01-01' + CAST(lead(day) OVER (PARTITION BY list, key ORDER BY day) AS INTEGER) AS until FROM e),
k AS (SELECT DISTINCT page_id, 'd:' || array_to_string(string_split(h, '.')[i:], '.') AS key, fetched
      FROM p, LATERAL (SELECT unnest(range(1, len(string_split(h, '.')) + 1)) AS i) WHERE h <> ''
      UNION SELECT page_id, 'p:' || h || '/' || array_to_string(regexp_extract_all(path, '[^/]+')[1:i], '/'), fetched
      FROM p, LATERAL (SELECT unnest(range(1, len(regexp_extract_all(path, '[^/]+')) + 1)) AS i) WHERE h <> ''),
a AS (SELECT k.page_id, k.key, v.list, row_number() OVER (PARTITION BY page_id ORDER BY length(k.key) DESC, list = 'allow', list) AS place,
             count(*) OVER (PARTITION BY page_id) AS n
      FROM k JOIN v ON k.key = v.key AND v.listed AND v.since <= k.fetched AND (v.until IS NULL OR k.fetched < v.until))
SELECT p.page_id, p.url, p.fetched, coalesce(a.list <> 'allow', false) AS blocked, a.key AS decided_by, a.list AS decided_list,
       coalesce(a.n, 0) AS n_active
FROM p LEFT JOIN a ON p.page_id = a.page_id AND a.place = 1
"""
