"""URL filters: rules first, then link-graph propagation over hosts. DataFrame functions only.

The longest rule that fits a url decides. For the rest hosts are judged: personalised PageRank spreads trust from hosts
with allowed pages along host edges, and distrust from hosts with blocked pages against them. Host edges are the links
of the pages' html to other hosts, counted, and the steps between a host and its parent domain. A host is blocked if
its share of distrust, distrust / (trust + distrust + 1 / hosts), reaches the threshold: a little distrust from afar, less
than a host's even share, blocks nothing. Propagation ends when the rounds between two checkpoints change all ranks together
by less than 1e-9.

Urls that are null or have no ``://`` have an empty host and path, fit no rule and are allowed. A null or empty html has
no links. Repeated rows count as often as they occur. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions, setting, tidy

#: Most rounds of propagation (what still moves then is below 0.85^48 of a rank, 4e-4), rounds between two checkpoints,
#: the share of a rank that follows edges, and the change of all ranks between two checkpoints at which it ends.
ROUNDS, EACH, DAMPING, STILL = 48, 4, 0.85, 1e-9
#: Edges of a host beyond which they are not one row; such hosts are at most a 10,000th of the edges, so their ranks are sent out.
HEAVY = 10_000
#: Edges and seeds for each partition of the rounds, which are the session's shuffle partitions at most: a round is a task for each.
PART = 20_000
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def lower(c: Column) -> Column:
    """A-Z alone."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    return lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    """A rule is a host, and a path from its first slash on."""
    h, p = rule.split("/", 1)
    return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, ties in alphabetical order; null if none."""
    return F.coalesce(*[F.when(fits(host, path, r), F.lit(r)) for r in sorted(rules, key=lambda r: (-len(r), r))], F.lit(None).cast("string"))


def with_links(pages: DataFrame) -> DataFrame:
    """The pages with the hosts of their links instead of their html."""
    return pages.withColumn("links", F.regexp_extract_all("html", F.lit(LINK), 1)).drop("html")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of ``links`` from ``host``, and of steps to and from parent domains."""
    linked = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst")).select("src", lower(F.col("dst")).alias("dst"))
    linked = linked.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select("host").where("host <> ''").distinct().union(linked.select("dst")).distinct()
    labels = F.split("host", r"\.")
    # each host's chain of ancestors with two labels or more, itself first
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = hosts.select(chain.alias("c")).where(F.size("c") > 1).select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("s")).select("s.a", "s.b").distinct()
    both = steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(steps.select("b", "a"))
    return linked.union(both.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(host, trust, distrust): ranks of each kind, which sum to 1 or less."""
    edges = stored(host_edges(pages))
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    flow = forward.union(backward)
    total = apart_text(flow.groupBy("kind", "src").agg(F.sum("n").alias("all"), F.count("*").alias("degree")), "src")
    flow = stored(flow.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("p"), "degree"))
    kind = F.when(F.col("verdict") == "allow", F.lit("trust")).otherwise(F.lit("distrust"))
    seeds = pages.where("verdict is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    sums = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = stored(seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("rank")))
    spark = pages.sparkSession
    parts = max(1, min(partitions(spark), -(-(edges.count() + seeds.count()) // PART)))
    with setting(spark, "spark.sql.shuffle.partitions", str(parts)):
        # a host's edges and its own share as a seed are one row, so that ranks meet them where they were summed and a round is one
        # stage; edges of heavy hosts stay apart, dealt anyhow
        own = seeds.select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("p"), (F.col("rank") * (1 - DAMPING)).alias("base"))
        light = flow.where(F.col("degree") <= HEAVY).select("kind", "src", "dst", "p", F.lit(0.0).alias("base")).union(own)
        light = dealt(light.groupBy("kind", "src").agg(F.collect_list(F.struct("dst", "p", "base")).alias("to")))
        heavy = flow.where(F.col("degree") > HEAVY)
        heavy = None if heavy.isEmpty() else heavy.select("kind", "src", "dst", "p", F.lit(0.0).alias("base"))
        heavy_hosts = heavy and stored(heavy.select("kind", "src").distinct())
        rank = begun = seeds
        for i in range(1, ROUNDS + 1):
            r = rank.select("kind", F.col("host").alias("src"), "rank")
            # a seed that no rank has reached yet has its share to give all the same
            moved = light.hint("merge").join(r, ["kind", "src"], "left").select("kind", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.inline("to"))
            if heavy is not None:
                few = r.join(F.broadcast(heavy_hosts), ["kind", "src"])
                moved = moved.union(heavy.join(F.broadcast(few), ["kind", "src"]).select("kind", "rank", "dst", "p", "base"))
            rank = moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("p") * DAMPING + F.col("base")).alias("rank"))
            if i % EACH == 0:
                rank = dealt(rank)
                if i < ROUNDS and moved_by(begun, rank) < STILL:
                    break
                begun = rank
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def stored(df: DataFrame) -> DataFrame:
    """As durable(); its shuffle files go with it, as far as Spark finds them."""
    with tidy(df.sparkSession):
        return durable(df)


def dealt(df: DataFrame) -> DataFrame:
    """As stored(), and Spark knows by which keys the rows are dealt, which adaptive plans do not tell."""
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return stored(df)


def moved_by(old: DataFrame, new: DataFrame) -> float:
    """How far all ranks together are from those before; both lie by kind and host already."""
    was = old.withColumnRenamed("rank", "was")
    gap = F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))
    with tidy(new.sparkSession), setting(new.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return new.hint("merge").join(was, ["kind", "host"], "full").agg(F.sum(F.abs(gap))).first()[0] or 0.0


def apart_text(df: DataFrame, key: str) -> DataFrame:
    """As apart(), for a text."""
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))


def judge(pages: DataFrame, rules: dict[str, str], *, threshold: float = 0.5, page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust_share): rules map ``host/path`` to allow or block."""
    host, path = host_and_path(F.col("url"))
    known = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), "html")
    known = known.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    says = F.create_map(*[F.lit(x) for r in sorted(rules.items()) for x in r])
    # the pages are read once: what is kept of them has the hosts of their links instead of the html
    known = stored(with_links(known.withColumn("verdict", says[F.col("rule")])))
    ranks = stored(propagate(known, rules))
    share = F.col("distrust") / (F.col("trust") + F.col("distrust") + 1 / max(known.agg(F.count_distinct("host")).first()[0], 1))
    hosts = apart_text(ranks.select("host", share.alias("distrust_share")), "host")
    named = known.drop("links").join(hosts, "host", "left")
    verdict = F.coalesce("verdict", F.when(F.coalesce("distrust_share", F.lit(0.0)) >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return named.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "distrust_share")


def sql(rules: dict[str, str], threshold: float = 0.5) -> str:
    """The same in DuckDB's SQL over the view ``pages``, round by round."""
    link = LINK.replace("'", "''")
    fit = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r}'" for r in sorted(rules, key=lambda r: (-len(r), r))) + " END"
    says = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in sorted(rules.items())) + " END"
    low = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rounds = ["r0 AS (SELECT kind, host, rank FROM seeds)"]
    for i in range(1, ROUNDS + 1):
        rounds.append(f"r{i} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, dst AS host, {DAMPING} * rank * p AS rank FROM flow JOIN r{i - 1} USING (kind) WHERE src = host UNION ALL SELECT kind, host, {1 - DAMPING} * rank FROM seeds) GROUP BY 1, 2)")
    return f"""
WITH h AS (SELECT page_id, html, coalesce({low.format(f"regexp_extract(url, '{URL}', 1)")}, '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
k AS (SELECT *, {says} AS verdict FROM (SELECT *, {rule} AS rule FROM h)),
linked AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {low.format("d")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS d FROM k)) WHERE src <> '' AND src <> dst GROUP BY 1, 2),
hosts AS (SELECT DISTINCT string_split(host, '.') AS l FROM (SELECT host FROM k WHERE host <> '' UNION SELECT dst FROM linked)),
steps AS (SELECT DISTINCT array_to_string(l[i:], '.') AS a, array_to_string(l[i + 1:], '.') AS b FROM (SELECT l, unnest(range(1, greatest(len(l) - 1, 1))) AS i FROM hosts)),
edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM linked UNION ALL SELECT a, b, 1 FROM steps UNION ALL SELECT b, a, 1 FROM steps) GROUP BY 1, 2),
ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
flow AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS p FROM ways),
counted AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM k WHERE verdict IS NOT NULL AND host <> '' GROUP BY 1, 2),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS rank FROM counted),
{", ".join(rounds)},
ranks AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS t, sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS d FROM r{ROUNDS} GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(d / (t + d + 1.0 / (SELECT greatest(count(DISTINCT host), 1) FROM k)), 0) >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict FROM k LEFT JOIN ranks USING (host)"""
