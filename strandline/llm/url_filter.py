"""URL filters: host and path rules, and a logistic regression for the rest.

The regression sees hashed character n-grams of host and path. It is trained from a
small labelled table in its dual form, so training works on as many coefficients
as the table has rows, and ends as one integer weight per bucket. Scoring adds up
the weights of a url's n-grams. Built-in functions only; a url is judged in one
projection, nothing is shuffled, and only the weights, at most BUCKETS, pass the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

BUCKETS, GRAMS, EPOCHS, RATE, DECAY, SCALE = 4096, (3, 4), 60, 0.5, 0.004, 10_000
#: Labelled rows that training accepts; the dual form holds their products, a square table.
MAX_LABELLED = 2_000
# Rules as (host, path, verdict) and the words of the labelled urls.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words of unwanted sites by kind - gambling, sex, medicine, fraud, pirated goods, advertising - in five languages.
UNWANTED = (
    "roulette", "blackjack", "jackpot", "lotto", "baccarat", "bingo", "slotmachine", "gluecksspiel", "sportwetten", "apuestas", "tragaperras", "pariez", "loterie", "scommesse",
    "escort", "hentai", "nude", "erotik", "webcamgirls", "fetish", "milf", "camsex", "sexe", "putas", "nackt", "incontri", "hookup", "strip",
    "viagra", "cialis", "xanax", "steroid", "tramadol", "potenzmittel", "pastillas", "kratom", "slimming", "botox", "nootropic", "farmacia24",
    "phishing", "payday", "doubler", "forexsignal", "getrich", "kredit24", "giftcard", "airdrop", "ponzi", "scam", "fakeid", "prestamos",
    "keygen", "warez", "cracked", "torrentz", "nulled", "replica", "fakewatch", "serialz", "modapk", "leaked", "hacktool", "cheatz",
    "popunder", "clickbait", "adserver", "banners", "backlinks", "seoboost", "doorway", "traffic4u", "werbung", "publicidad", "affiliate", "redirect",
)
#: Words of sites that people go to for their own sake, in the same languages.
WANTED = (
    "library", "garden", "museum", "weather", "newspaper", "university", "school", "bakery", "hospital", "orchestra", "railway", "village", "physics", "mountain",
    "bibliothek", "rathaus", "zeitung", "wanderweg", "schule", "feuerwehr", "kochbuch", "buchladen", "verein", "heimat", "forschung", "werkstatt", "konzert", "kirche",
    "biblioteca", "museo", "escuela", "cocina", "historia", "ciudad", "noticias", "jardin", "universidad", "montana", "poesia", "hospitales", "libros", "gobierno",
    "mairie", "ecole", "cuisine", "histoire", "journal", "voyage", "jardinage", "cinema", "librairie", "recherche", "meteo", "patrimoine", "randonnee", "musique",
    "scuola", "giornale", "ricette", "teatro", "comune", "paesaggio", "python", "chemistry", "recipes", "knitting", "birding", "astronomy", "cycling", "pottery",
    "theatre", "heritage", "nature", "station", "council", "theology", "education", "harbour", "translation", "archive", "statistics", "grammar",
)
#: Both halves of the labelled table get these in turn, so that neither prefix, domain nor path tells them apart.
PREFIXES, DOMAINS, PATHS = ("", "www.", "blog.", "m.", ""), ("test", "example.test", "net.test", "example.net"), ("/en/12", "/", "/de/5.html", "/fr/77/", "/index.html", "/es/3", "/articles/2024/item")
JOINTS = ("", "-", "24", "-the-", "online", "-und-")


def names(words: tuple[str, ...]) -> list[str]:
    """Names of two words of one kind; every word is in two of them."""
    return [f"{w}{JOINTS[i % len(JOINTS)]}{words[(i + 5) % len(words)]}" for i, w in enumerate(words)]


def _urls(words: tuple[str, ...]) -> list[str]:
    return [f"https://{PREFIXES[i % len(PREFIXES)]}{n}.{DOMAINS[i % len(DOMAINS)]}{PATHS[i % len(PATHS)]}" for i, n in enumerate(names(words))]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the built-in table; label 1: unwanted."""
    return spark.createDataFrame([(u, 1) for u in _urls(UNWANTED)] + [(u, 0) for u in _urls(WANTED)], "url string, label int")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _buckets(host: Column, path: Column, buckets: int) -> Column:
    """Buckets of the n-grams of host and path, repeats included; digits are alike."""
    whole = F.concat(F.lit("^"), host, F.lit("$"), F.regexp_replace(path, "[0-9]+", "0"))

    def grams_of(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.when(F.size(chars) >= n, F.transform(starts, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))).otherwise(F.array().cast("array<string>"))

    def of(chars: Column) -> Column:
        return F.concat(*(grams_of(chars, n) for n in GRAMS))

    # cut into characters once: a substring far inside a long text costs as much as the way there
    grams = F.transform(F.array(F.filter(F.split(whole, ""), lambda c: c != "")), of)[0]
    return F.transform(grams, lambda g: (F.conv(F.substring(F.md5(g), 1, 6), 16, 10).cast("long") % buckets).cast("int"))


def train(labelled: DataFrame, buckets: int = BUCKETS, epochs: int = EPOCHS) -> list[int]:
    """One integer weight per bucket; label 1 pulls up. Rows with a null url or label are left out."""
    ok = labelled.where("url is not null and label is not null")
    rows = ok.groupBy("url").agg(F.max("label").cast("double").alias("y"))
    if rows.count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    grams = rows.select("url", F.explode(_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets)).alias("b")).groupBy("url", "b").agg(F.count("*").cast("double").alias("n"))
    norm = grams.groupBy("url").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = grams.join(norm, "url").select("url", "b", (F.col("n") / F.col("norm")).alias("x"))
    products = x.alias("p").join(x.alias("q"), F.col("p.b") == F.col("q.b")).groupBy(F.col("p.url").alias("url"), F.col("q.url").alias("other")).agg(F.sum(F.col("p.x") * F.col("q.x")).alias("k"))
    known = products.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("other", "k"))).alias("m"))
    table_of = rows.join(known, "url", "left").agg(F.sort_array(F.collect_list(F.struct("url", "y"))).alias("r"), F.map_from_entries(F.collect_list(F.struct("url", "m"))).alias("m"))
    one = table_of.select(F.transform("r", lambda r: F.struct(r["url"].alias("url"), r["y"].alias("y"), F.transform("r", lambda o: F.coalesce(F.try_element_at(F.try_element_at(F.col("m"), r["url"]), o["url"]), F.lit(0.0))).alias("k"))).alias("t"))

    def step(alpha: Column, _: Column) -> Column:
        def moved(a: Column, r: Column) -> Column:
            z = F.aggregate(F.zip_with(r["k"], alpha, lambda k, b: k * b), F.lit(0.0), lambda s, v: s + v)
            return a * (1 - DECAY) + RATE * (r["y"] - 1 / (1 + F.exp(-z)))

        return F.zip_with(alpha, F.col("t"), moved)

    alphas = one.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.transform("t", lambda r: F.lit(0.0)), step).alias("alpha")).select(F.explode(F.arrays_zip(F.col("t.url").alias("url"), "alpha")).alias("z")).select("z.url", "z.alpha")
    found = x.join(alphas, "url").groupBy("b").agg(F.round(F.sum(F.col("x") * F.col("alpha")) * SCALE).cast("long").alias("w")).collect()
    weights = [0] * buckets
    for r in found:
        weights[r["b"]] = r["w"]
    return weights


def score(host: Column, path: Column, weights: list[int]) -> Column:
    """The log-odds of being unwanted, in SCALE-ths times the length of the url's n-gram vector (its sign decides)."""
    held = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    return F.aggregate(_buckets(host, path, len(weights)), F.lit(0).cast("long"), lambda a, b: a + F.get(held, b))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, weights: list[int] | None = None) -> DataFrame:
    """pages with host, path, rule (null where none fits), score (null where a rule fits) and verdict.

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest wins.
    Null urls and urls without :// have empty host and path and are judged like any other; urls may have any length.
    Repeated rows are judged each for itself, a score of exactly 0 (a tie) allows, and an empty table gives no rows.
    Columns of pages with one of these names are replaced.
    """
    weights = weights if weights is not None else train(labelled_urls(pages.sparkSession))
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    url = pages[url_col].cast("string")
    parts = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    host, path = F.col("host"), F.col("path")
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in reversed(longest):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    ruled = parts.withColumns({"rule": rule, "verdict": said})
    scored = ruled.withColumn("score", F.when(F.col("rule").isNull(), score(host, path, weights)))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))).select(*pages.columns, "host", "path", "rule", "score", "verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql_url(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path"


def _sql_grams(source: str, key: str) -> str:
    one = " UNION ALL ".join(f"SELECT {key}, unnest([substr(w, i::BIGINT, {n}) for i in range(1, length(w) - {n} + 2)]) AS g FROM (SELECT {key}, '^' || host || '$' || regexp_replace(path, '[0-9]+', '0', 'g') AS w FROM {source})" for n in GRAMS)
    return f"SELECT {key}, (('0x' || md5(g)[1:6])::BIGINT % {BUCKETS}) AS b FROM ({one})"


_TRAINING = ", ".join([f"('{u}', 1.0::DOUBLE)" for u in _urls(UNWANTED)] + [f"('{u}', 0.0::DOUBLE)" for u in _urls(WANTED)])
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH RECURSIVE labelled(url, y) AS (VALUES {_TRAINING}),
parts AS (SELECT url, y, {_sql_url("url")} FROM labelled),
grams AS (SELECT url, b, count(*)::DOUBLE AS n FROM ({_sql_grams("parts", "url")}) GROUP BY url, b),
x AS (SELECT url, b, n / sqrt(sum(n * n) OVER (PARTITION BY url)) AS x FROM grams),
products AS (SELECT p.url, q.url AS other, sum(p.x * q.x) AS k FROM x p JOIN x q ON p.b = q.b GROUP BY p.url, q.url),
t AS (
  SELECT list(y ORDER BY url) AS y, list(k ORDER BY url) AS k FROM (
    SELECT a.url, a.y, list(coalesce(k, 0.0) ORDER BY b.url) AS k FROM labelled a CROSS JOIN labelled b
    LEFT JOIN products ON products.url = a.url AND products.other = b.url GROUP BY a.url, a.y)
),
fit(e, alpha) AS (
  SELECT 0, [0.0::DOUBLE for _ in y] FROM t
  UNION ALL
  SELECT e + 1, [alpha[i] * (1 - {DECAY}) + {RATE} * (y[i] - 1 / (1 + exp(-list_dot_product(k[i], alpha)))) for i in range(1, len(y) + 1)] FROM fit, t WHERE e < {EPOCHS}
),
alphas AS (SELECT unnest((SELECT list(url ORDER BY url) FROM labelled)) AS url, unnest((SELECT alpha FROM fit WHERE e = {EPOCHS})) AS alpha),
weights AS (SELECT b, round(sum(x * alpha) * {SCALE})::BIGINT AS w FROM x JOIN alphas USING (url) GROUP BY b),
p AS (SELECT row_number() OVER () AS r, page_id, {_sql_url("url")} FROM pages),
scores AS (SELECT r, sum(w) AS score FROM ({_sql_grams("p", "r")}) JOIN weights USING (b) GROUP BY r),
rules(h, pre, said) AS (VALUES {_RULES}),
ruled AS (
  SELECT r, arg_max(h || pre, length(h || pre)) AS rule, arg_max(said, length(h || pre)) AS said
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled USING (r) LEFT JOIN scores USING (r)
"""
