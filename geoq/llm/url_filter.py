"""URL filters: allow and block rules, and logistic regression on hashed
character n-grams of host and path for the urls that no rule covers.

Everything is DataFrame expressions.  The labelled table is small (at most
``MAX_LABELLED`` rows, checked), so the regression is solved in its dual: one
coefficient per labelled url, gradient steps over the matrix of feature
products, then one aggregation into a weight per n-gram bucket.  Judging is a
per-row expression over a fixed-size weight array: no shuffle at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most labelled urls that the dual solver takes; more raise an error.
MAX_LABELLED = 500
#: N-gram buckets (a prime), n-gram length, gradient steps, step, decay.
BUCKETS, GRAM, STEPS, STEP, DECAY = 4093, 3, 150, 0.25, 0.01

#: (host/path rule, verdict); a rule covers its host and all subdomains.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]

#: A small labelled table: 1 is to be blocked.
LABELLED_URLS = [
    ("https://casino-palace.example.com/slots", 1), ("http://free-casino.example.net/bonus", 1),
    ("https://best-bets.example.com/odds/12", 1), ("http://sport-bets.example.org/en/9", 1),
    ("http://bets-now.example.net/de/4", 1), ("https://free-pills.example.com/order", 1),
    ("http://cheap-pills.example.net/en/3", 1), ("https://spam-mail.example.org/list", 1),
    ("http://spam-hub.example.com/en/77", 1), ("http://link-farm.example.net/en/5", 1),
    ("https://content-farm.example.com/1", 1), ("http://ads-server.example.com/click", 1),
    ("https://ads-pixel.example.net/en/8", 1), ("http://click-track.example.org/t/1", 1),
    ("https://track-all.example.com/en/2", 1), ("http://free-prizes.example.net/win", 1),
    ("https://xxx-videos.example.com/en/1", 1), ("http://adult-cams.example.net/de/6", 1),
    ("https://loan-fast.example.com/es/3", 1), ("http://get-rich.example.net/fr/10", 1),
    ("https://poker-room.example.org/en/41", 1), ("http://lottery-win.example.com/en/18", 1),
    ("https://news.example.com/en/12", 0), ("https://www.example.org/en/471", 0),
    ("http://blog.example.net/fr/20", 0), ("https://m.example.com/de/33?page=2", 0),
    ("https://docs.library.example.org/guide", 0), ("https://wiki.example.net/en/history", 0),
    ("http://www.garden.example.com/en/52.html", 0), ("https://school.example.org/es/9", 0),
    ("http://recipes.example.net/en/640", 0), ("https://museum.example.com/fr/70", 0),
    ("https://blog.weather.example.net/en/118#top", 0), ("http://m.travel.example.org/en/25#top", 0),
    ("https://www.thesis.example.com/en/853/", 0), ("http://theatre.example.net/de/112", 0),
    ("https://north.example.com/en/618", 0), ("http://therapy.example.org/fr/414", 0),
    ("https://www.another.example.com/es/575", 0), ("http://blog.thinking.example.net/en/960", 0),
    ("https://m.orchestra.example.com/fr/588", 0), ("http://science.example.org/en/676", 0),
    ("https://thunder.example.net/en/740", 0), ("http://www.together.example.com/en/519", 0),
    ("https://weather.example.net/de/612", 0), ("http://leather.example.com/es/288", 0),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one
    without ``://``."""
    url = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, shape, 1), _UPPER, _LOWER), F.regexp_extract(url, shape, 2)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def gram_buckets(host: Column, path: Column, gram: int = GRAM, buckets: int = BUCKETS) -> Column:
    """Bucket of every character n-gram of host and path, which never share
    an n-gram: a polynomial over code points, modulo ``buckets``."""
    def of(text: Column, field: int) -> Column:
        def bucket(i):
            value = F.lit(field).cast("bigint")
            for k in range(gram):
                value = (value * 1009 + F.ascii(F.substring(text, i + k, 1)).cast("bigint")) % 1_000_003
            return (value % buckets).cast("int")
        starts = F.sequence(F.lit(1), F.length(text) - (gram - 1))
        return F.when(F.length(text) >= gram, F.transform(starts, bucket)).otherwise(F.array().cast("array<int>"))
    return F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), 1), of(path, 2))


def train_weights(labelled: DataFrame, url_col: str = "url", label_col: str = "label", steps: int = STEPS,
                  step: float = STEP, decay: float = DECAY, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights`` (array, one per bucket) and ``bias``.

    Features are n-gram counts over the root of their number.  With
    ``w = sum(a_i * x_i)`` a gradient step on the decayed log loss is
    ``a_i <- (1 - step * decay) * a_i + step * (y_i - p_i)``, where the margin
    needs only the products of features of labelled rows."""
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("y"))
    n = rows.count()
    if n > MAX_LABELLED:
        raise ValueError(f"{n} labelled urls; the dual solver takes {MAX_LABELLED}")
    host, path = host_and_path(F.col("url"))
    # one row in all: (y, buckets) in a fixed order
    listed = (rows.withColumn("grams", gram_buckets(host, path))
              .agg(F.sort_array(F.collect_list(F.struct("url", "y", "grams"))).alias("rows")))
    x = listed.select(F.posexplode("rows").alias("i", "r")).select("i", "r.y", "r.grams")
    counts = (x.select("i", F.explode("grams").alias("b"), F.sqrt(F.size("grams")).alias("norm"))
              .groupBy("i", "b", "norm").agg(F.count(F.lit(1)).alias("c"))
              .select("i", "b", (F.col("c") / F.col("norm")).alias("x")))
    other = counts.select(F.col("i").alias("j"), "b", F.col("x").alias("x_j"))
    # products of labelled rows, plus 1 for the bias
    products = (counts.join(other, "b").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("x_j")).alias("k"))
                .groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("ks")))
    dense = F.expr(f"transform(sequence(0, {max(n, 1) - 1}), j -> 1D + coalesce(element_at(ks, j), 0D))")
    matrix = (x.select("i", "y").join(products, "i", "left").select(F.struct("i", "y", dense.alias("ks")).alias("r"))
              .agg(F.sort_array(F.collect_list("r")).alias("m")))
    solved = matrix.select(F.expr(f"""
        aggregate(sequence(1, {int(steps)}), transform(m, r -> 0D), (a, t) ->
          transform(m, (r, i) -> {1 - step * decay!r}D * a[i] + {step!r}D * (r.y - 1D / (1D + exp(-aggregate(
            zip_with(r.ks, a, (u, v) -> u * v), 0D, (s, z) -> s + z))))))""").alias("a"))
    alphas = solved.select(F.posexplode("a").alias("i", "alpha"))
    return (counts.join(alphas, "i").groupBy("b").agg(F.sum(F.col("x") * F.col("alpha")).alias("w"))
            .agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
            .select(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)),
                                lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("weights"))
            .withColumn("bias", solved.select(F.expr("aggregate(a, 0D, (s, z) -> s + z)")).scalar()))


def judge_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", block_at: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    The longest fitting rule decides (a tie goes to the rule listed first);
    else the probability ``score`` that the url is to be blocked: block at
    ``block_at`` or more.  A null url, or one without ``://``, has an empty
    host and path and is judged by the bias; an empty labelled table gives
    every url 0.5.  Repeated rows are judged alike; other columns are ignored."""
    spark = pages.sparkSession
    labelled = labelled if labelled is not None else labelled_urls(spark)
    model = train_weights(labelled).first()  # a fixed number of weights
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    weights = F.array(*map(F.lit, model["weights"]))
    scored = rows.withColumns({"rule": rule, "said": verdict, "grams": gram_buckets(F.col("host"), F.col("path"))})
    margin = (F.lit(model["bias"] or 0.0)
              + F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.coalesce(F.get(weights, b), F.lit(0.0)))
              / F.sqrt(F.greatest(F.size("grams"), F.lit(1))))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-margin)))
    by_method = F.when(F.col("score") >= block_at, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_method).alias("verdict"), "score")


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED_URLS, "url string, label int")
