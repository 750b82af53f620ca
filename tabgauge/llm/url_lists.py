"""URL filters: captures against list entries that were active when they were fetched.

Dated changes (``add`` or ``remove`` of a pattern on a list) become validity intervals:
the state after a change holds until the next change of the same entry. Every capture is
then joined as of its fetch time. Its host's suffixes, its path's prefixes and its URL are
the patterns that could apply, so the join is on equality of pattern and time bucket.

Time buckets come in three sizes, of 1, 32 and 1024 days. An interval takes the fewest
buckets that cover it, at most a few dozen plus its two end days, in which the exact times
are compared; a capture takes one bucket of each size. So neither a long interval nor a
host with a third of all captures meets in one group, and Spark can split what is skewed.

The most specific active entry decides: URL before prefix before domain, then the longer
pattern, then ``block`` before ``allow``. Captures without an active entry are kept.

Verdicts are made once per distinct (URL, fetch time) and joined back to all rows.

Defined results: a null or empty URL matches nothing, nor does a null fetch time; of
changes of one entry at one instant, ``add`` wins; changes with a null in any column are
void; repeated captures each keep a row; an empty list blocks nothing; columns of the
captures beside those read are carried along, unless they bear the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

DAY = 86_400
#: Days per time bucket, each size a multiple of the one before.
SIZES = (1, 32, 1024)
#: Order of scopes when several entries apply.
SCOPES = ("domain", "prefix", "url")

#: Keys, about, that one task spreads captures to.
TASK_KEYS = 1_000_000
RESULTS = ("n_active", "decided_scope", "decided_pattern", "decided_list", "blocked")


def plain_url(url: Column) -> Column:
    """Without scheme and fragment, the host in lower case and without user and port."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@|:\d*$", ""))
    return F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1))


def host_of(plain: Column) -> Column:
    return F.regexp_extract(plain, r"^([^/?]*)", 1)


def path_of(plain: Column) -> Column:
    """The path, without the query."""
    return F.regexp_extract(plain, r"(?s)^[^/?]*(/[^?]*)", 1)


def intervals(changes: DataFrame) -> DataFrame:
    """``list, scope, pattern, since, until`` from ``list, scope, pattern, action, at``; seconds, ``until`` null if open."""
    entry = ("list", "scope", "pattern")
    named = changes.select(*entry, F.col("action"), F.unix_seconds(F.col("at").cast("timestamp")).alias("since")).na.drop()
    states = named.groupBy(*entry, "since").agg(F.max(F.col("action") == "add").alias("active"))
    after = Window.partitionBy(*entry).orderBy("since")
    return states.withColumn("until", F.lead("since").over(after)).filter("active").drop("active")


def _level(lo: Column, hi: Column, size: int, above: int | None) -> tuple[Column, Column | None, Column | None]:
    """Buckets of one size for the whole days in ``[lo, hi)``, and the days left for larger ones."""

    def spread(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(F.floor(a / size), F.floor((b - 1) / size))).otherwise(F.array().cast("array<bigint>"))

    if above is None:
        return spread(lo, hi), None, None
    up, down = F.ceil(lo / above) * above, F.floor(hi / above) * above
    own = F.when(up <= down, F.concat(spread(lo, up), spread(down, hi))).otherwise(spread(lo, hi))
    none = up > down
    return own, F.when(none, lo).otherwise(up), F.when(none, lo).otherwise(down)


def _whole(size: int):
    """A bucket that an interval covers from end to end."""
    none = F.lit(None).cast("bigint")
    return lambda b: F.struct(F.lit(size).alias("size"), b.cast("bigint").alias("bucket"), none.alias("from_s"), none.alias("to_s"))


def bucketed(found: DataFrame, last_day: int) -> DataFrame:
    """Intervals with the buckets they take: ``size, bucket`` and the times to compare, null where the bucket is covered."""
    first = F.floor(F.col("since") / DAY)
    last = F.coalesce(F.floor((F.col("until") - 1) / DAY), F.lit(last_day + 1))
    ends = [F.struct(F.lit(1).alias("size"), d.cast("bigint").alias("bucket"), F.col("since").alias("from_s"), F.col("until").alias("to_s")) for d in (first, last)]
    lo, hi = first + 1, last
    arrays = [F.array_distinct(F.array(*ends))]
    for size, above in zip(SIZES, (*SIZES[1:], None), strict=True):
        own, lo, hi = _level(lo, hi, size, above)
        arrays.append(F.transform(own, _whole(size)))
    return found.filter(first <= last).select("list", "scope", "pattern", F.explode(F.concat(*arrays)).alias("b")).select("list", "scope", "pattern", "b.*")


def patterns_of(plain: Column, labels: int, segments: int) -> Column:
    """Patterns that could apply to a URL: host suffixes, path prefixes and itself.

    ``labels`` and ``segments`` are the most that any pattern of the list has.
    """
    parts = F.split(host_of(plain), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(parts, -n, n), ".").alias("pattern")))
    # Splitting stops behind the deepest prefix of the list, so a long path costs no more.
    steps = F.split(F.concat(host_of(plain), path_of(plain)), "/", segments + 2)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(steps) - 1, F.lit(segments + 1)))),
        lambda n: F.struct(F.lit("prefix").alias("scope"), F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")).alias("pattern")),
    )
    return F.concat(suffixes, prefixes, F.array(F.struct(F.lit("url").alias("scope"), plain.alias("pattern"))))


def evaluate(captures: DataFrame, changes: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Captures with ``n_active, decided_scope, decided_pattern, decided_list, blocked``."""
    when = F.unix_seconds(F.col(f"`{time_col}`").cast("timestamp"))
    # Own columns travel in a struct, so that no name of theirs meets one used here.
    carried = [c for c in captures.columns if c not in RESULTS]
    rows = captures.select(
        F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]).alias("__row"),
        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("__url"),
        when.alias("__at"),
    )
    active = intervals(changes)
    size = active.agg(
        F.max(F.when(F.col("scope") == "domain", F.size(F.split("pattern", r"\.")))),
        F.max(F.when(F.col("scope") == "prefix", F.size(F.split("pattern", "/")))),
    ).first()
    days, n_rows = rows.agg(F.max("__at"), F.count("*")).first()
    labels, segments = size[0] or 1, max(1, (size[1] or 2) - 2)
    asked = rows.filter(F.col("__at").isNotNull() & (F.col("__url") != "")).select("__url", "__at").distinct()
    # A capture becomes many keys: tasks follow their number, not the bytes of the captures.
    tasks = max(captures.sparkSession.sparkContext.defaultParallelism, -(-n_rows * (labels + segments + 2) * len(SIZES) // TASK_KEYS))
    day = F.floor(F.col("__at") / DAY)
    times = F.array(*[F.struct(F.lit(s).alias("size"), F.floor(day / s).cast("bigint").alias("bucket")) for s in SIZES])
    keyed = (
        asked.repartition(tasks, "__url", "__at").withColumn("__p", F.explode(patterns_of(plain_url(F.col("__url")), labels, segments)))
        .withColumn("__t", F.explode(times))
        .select("__url", "__at", F.col("__p.scope"), F.col("__p.pattern"), F.col("__t.size"), F.col("__t.bucket"))
    )
    listed = bucketed(active, int((days or 0) // DAY))
    inside = (F.col("from_s").isNull() | (F.col("from_s") <= F.col("__at"))) & (F.col("to_s").isNull() | (F.col("__at") < F.col("to_s")))
    same = [F.col(f"k.{c}") == F.col(f"l.{c}") for c in ("scope", "pattern", "size", "bucket")]
    met = keyed.alias("k").join(listed.alias("l"), [*same, inside]).select("k.__url", "k.__at", "l.scope", "l.pattern", "l.list")
    rank = F.struct(
        F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")).alias("scope_rank"),
        F.char_length("pattern").alias("pattern_length"),
        (F.col("list") == "block").alias("blocks"),
        F.col("pattern"),
        F.col("scope"),
        F.col("list"),
    )
    verdict = met.groupBy("__url", "__at").agg(F.count("*").alias("__n"), F.max(rank).alias("__best"))
    return (
        rows.join(verdict, ["__url", "__at"], "left")
        .select(
            *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(carried)],
            F.coalesce("__n", F.lit(0)).alias("n_active"),
            F.col("__best.scope").alias("decided_scope"),
            F.col("__best.pattern").alias("decided_pattern"),
            F.col("__best.list").alias("decided_list"),
            F.coalesce(F.col("__best.list") == "block", F.lit(False)).alias("blocked"),
        )
    )


#: The given pages have neither fetch times nor a list; both follow from the page ids.
FETCHED_S = "1704067200 + (page_id * 7919) % 17280000"
CHANGED_DAY = "19723 + (page_id * 13) % 180"


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.timestamp_seconds(F.expr(FETCHED_S)).alias("fetched_at"))


def derived_changes(pages: DataFrame) -> DataFrame:
    """A dated change by every 20th page: of its host, its registered domain or its first path step."""
    plain = plain_url(F.col("url"))
    host, first = host_of(plain), F.regexp_extract(path_of(plain), r"^/([^/]+)", 1)
    kind, registered = F.col("page_id") % 100, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return (
        pages.filter(F.col("page_id") % 20 == 0)
        .select(
            F.when(F.col("page_id") % 3 == 0, "allow").otherwise("block").alias("list"),
            F.when(kind.isin(0, 20, 40), "prefix").otherwise("domain").alias("scope"),
            F.when(kind.isin(0, 20, 40), F.concat(host, F.lit("/"), first, F.lit("/"))).when(kind == 60, host).otherwise(registered).alias("pattern"),
            F.when(F.col("page_id") % 8 == 4, "remove").otherwise("add").alias("action"),
            F.timestamp_seconds(F.expr(CHANGED_DAY) * DAY).alias("at"),
        )
        .filter(F.col("pattern") != "")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, against all changes."""
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    found = evaluate(derived_captures(pages), derived_changes(pages))
    return found.select("page_id", "url", F.unix_seconds("fetched_at").alias("fetched_s"), *RESULTS)


_PLAIN = r"""regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's')"""

ORACLE_SQL = rf"""
with bare as (select page_id, url, {_PLAIN} as rest from pages),
split as (
  select page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), '^[^@]*@', ''), ':\d*$', '')) as host,
    regexp_extract(rest, '^[^/?]*(.*)$', 1, 's') as tail from bare),
p as (select *, regexp_extract(tail, '^(/[^?]*)', 1, 's') as path, {FETCHED_S} as fetched_s from split),
kinds as (select *, page_id % 100 as kind from p where page_id % 20 = 0),
changes as (
  select case when page_id % 3 = 0 then 'allow' else 'block' end as list,
    case when kind in (0, 20, 40) then 'prefix' else 'domain' end as scope,
    case when kind in (0, 20, 40) then host || '/' || regexp_extract(path, '^/([^/]+)', 1) || '/'
      when kind = 60 then host else regexp_extract(host, '([^.]+\.[^.]+)$', 1) end as pattern,
    page_id % 8 <> 4 as adds, ({CHANGED_DAY}) * {DAY} as at_s from kinds),
states as (select list, scope, pattern, at_s, bool_or(adds) as active from changes where pattern <> '' group by all),
spans as (select *, lead(at_s) over (partition by list, scope, pattern order by at_s) as until_s from states),
keys as (
  select distinct url, fetched_s, 'domain' as scope, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as pattern
  from p, unnest(range(1, 20)) as t(i) where i <= len(string_split(host, '.'))
  union
  select distinct url, fetched_s, 'prefix', array_to_string(list_slice(string_split(host || path, '/'), 1, i), '/') || '/'
  from p, unnest(range(1, 20)) as t(i) where i < len(string_split(host || path, '/')) or i = 1
  union
  select distinct url, fetched_s, 'url', host || tail from p),
met as (
  select url, fetched_s, list, scope, pattern, row_number() over (
    partition by url, fetched_s
    order by case scope when 'url' then 3 when 'prefix' then 2 else 1 end desc, length(pattern) desc, (list = 'block') desc, pattern desc) as place,
    count(*) over (partition by url, fetched_s) as n
  from keys join spans using (scope, pattern)
  where active and at_s <= fetched_s and (until_s is null or fetched_s < until_s) and url <> '')
select page_id, p.url, p.fetched_s, cast(coalesce(n, 0) as bigint) as n_active, scope as decided_scope, pattern as decided_pattern,
  list as decided_list, coalesce(list = 'block', false) as blocked
from p left join met on p.url = met.url and p.fetched_s = met.fetched_s and place = 1
"""
