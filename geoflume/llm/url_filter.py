"""URL filters: host and path rules, and a logistic model for the urls that no rule fits.

The model is a logistic regression on hashed character n-grams of host and path,
trained on the driver from a small table of labelled urls (``LABELLED`` unless
another is given; at most ``MAX_TRAIN`` rows are read of it, by order of url).

Defined cases: a null url, or one without "://", has an empty host and path and
is judged by the model; ties among rules of one length don't occur, as a rule is
named once; null page_ids stay null; repeated rows are judged each; other
columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import chunks, mix, table

#: (rule, verdict): host, then path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SIZES, BITS, MAX_TRAIN, EPOCHS = (3, 4, 5), 16, 10_000, 150
#: Hosts that people know and read. Fixed values.
_KNOWN = (
    "en.wikipedia.org de.wikipedia.org es.wikibooks.org www.wikidata.org commons.wikimedia.org www.bbc.co.uk www.theguardian.com www.reuters.com apnews.com www.nytimes.com www.lemonde.fr elpais.com www.spiegel.de www.zeit.de www.aljazeera.com "
    "github.com gitlab.com stackoverflow.com superuser.com askubuntu.com docs.python.org www.python.org www.rust-lang.org go.dev developer.mozilla.org www.w3.org www.ietf.org kernel.org www.gnu.org www.debian.org ubuntu.com www.postgresql.org "
    "arxiv.org www.nature.com www.science.org journals.plos.org pubmed.ncbi.nlm.nih.gov www.nih.gov www.cdc.gov www.who.int www.nasa.gov www.noaa.gov www.usgs.gov earthobservatory.nasa.gov www.esa.int www.ecmwf.int www.metoffice.gov.uk "
    "www.mit.edu www.stanford.edu www.ox.ac.uk www.cam.ac.uk ethz.ch www.tum.de www.sorbonne-universite.fr www.uba.ar www.harvard.edu ocw.mit.edu www.khanacademy.org www.coursera.org www.britannica.com plato.stanford.edu www.gutenberg.org archive.org "
    "www.loc.gov www.bl.uk www.metmuseum.org www.louvre.fr www.moma.org www.rijksmuseum.nl www.nationalgeographic.com www.smithsonianmag.com www.npr.org www.pbs.org www.economist.com www.ft.com www.wired.com arstechnica.com lwn.net "
    "news.ycombinator.com www.reddit.com medium.com wordpress.org blog.mozilla.org www.eff.org creativecommons.org www.openstreetmap.org www.un.org europa.eu www.gov.uk www.bundestag.de www.parliament.uk www.canada.ca www.australia.gov.au www.service-public.fr "
    "www.imdb.com musicbrainz.org www.discogs.com www.goodreads.com www.allrecipes.com www.bbcgoodfood.com www.seriouseats.com www.chefkoch.de www.marmiton.org www.lonelyplanet.com www.tripadvisor.com www.weather.gov www.timeanddate.com www.fifa.com www.olympics.com www.chess.com "
    "www.php.net sourceforge.net www.researchgate.net www.slideshare.net www.behance.net www.speedtest.net www.ripe.net www.apnic.net www.infoq.com www.jstor.net m.heise.de www.geant.net www.dante.net en.savannah.net blog.cloudflare.com"
).split()
_READ = ("/", "/wiki/Main_Page", "/news/2024/05/a-new-bridge-opens", "/en/articles/728", "/docs/intro/index.html", "/questions/4033/how-do-i", "/about", "/research/papers/12.pdf", "/de/themen/natur", "/blog/2023/notes?page=2", "/es/1204/", "/fr/culture/33.html")
#: First words of hosts to block, and the words and endings that follow them. Fixed values.
_BAIT = (
    "slots poker jackpot roulette lottery blackjack viagra cialis steroids weightloss sexchat escorts hookup camgirls nudes erotic fetish milf replica fake-watches designer-handbags payday-loans quick-cash bitcoin-doubler crypto-giveaway forex-signals "
    "torrents cracked keygen warez serials game-cheats proxy-unblock verify-login account-update prize-claim survey-reward giftcards coupon-codes backlinks seo-boost buy-followers likes-booster popunder essay-writing diploma miracle-cure detox-tea"
).split()
_HOOK = "online live hub bonus deals zone vip club 24 best now store outlet network direct official".split()
_END = "xyz top club live shop click bid icu vip online site biz info com net org".split()
_PUSH = ("/", "/go?aff=12", "/signup.php", "/promo/bonus", "/register/now", "/order?pid=77", "/claim-your-reward", "/xxx/hot", "/dl/setup.exe", "/offer/1?sub=a")


def _urls() -> Iterator[tuple[str, int]]:
    """Known hosts with paths of several kinds; baits with each of some hooks, endings and paths, as one word, with hyphens or the hook first."""
    for i, host in enumerate(_KNOWN):
        for j in range(7):
            yield f"http{'s' * (j % 2)}://{host}{_READ[(i * 3 + j * 5) % len(_READ)] if j else '/'}", 0
    for i, word in enumerate(_BAIT):
        for j in range(16):
            hook, end = _HOOK[(i * 5 + j) % len(_HOOK)], _END[(i * 7 + j * 3) % len(_END)]
            name = (f"{word}-{hook}", f"{hook}-{word}", f"{word}{hook}", f"www.{word}-{hook}", f"{word}{i % 10}{j % 10}")[j % 5]
            yield f"http{'s' * (j % 2)}://{name}.{end}{_PUSH[(i + j * 3) % len(_PUSH)] if j % 3 else '/'}", 1


#: The labelled urls: (url, 1 to block).
LABELLED = tuple(_urls())


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path."""
    url = url.cast("string")
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), shape, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(F.coalesce(url, F.lit("")), shape, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}"), F.lit(rule)))
    return F.coalesce(*fits)


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, hashed n-gram) pairs and the number of rows. Host and path n-grams are hashed apart; ends are marked."""
    rows, cells = [], []
    for part, column in enumerate((hosts, paths)):
        texts = pa.array([f"^{x or ''}$" for x in column.to_pylist()], pa.string())
        for first, data, off in chunks(texts):
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            for n in SIZES:
                if len(data) < n:
                    continue
                last = len(data) - n + 1
                h = np.full(last, part * 131 + n, np.uint64)
                for j in range(n):
                    h = h * np.uint64(1099511628211) + data[j : j + last]
                ok = row[:last] == row[n - 1 :]
                rows.append(first + row[:last][ok])
                cells.append((mix(h[ok]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cells) if cells else np.zeros(0, int), len(hosts)


def _score(rows, cells, n, weights, bias):
    """Log odds; every url's n-grams count 1 together times the root of their number."""
    size = np.maximum(np.bincount(rows, minlength=n), 1)
    return np.bincount(rows, weights[cells], minlength=n) / np.sqrt(size) + bias


def train(hosts: list[str], paths: list[str], labels: list[int], epochs: int = EPOCHS, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    rows, cells, n = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    y, weights, bias = np.asarray(labels, float), np.zeros(1 << BITS), 0.0
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # either kind weighs half
    ahead, ahead_bias = weights, bias
    for k in range(epochs):  # gradient steps with Nesterov's momentum
        error = (1 / (1 + np.exp(-_score(rows, cells, n, ahead, ahead_bias))) - y) * share
        new = ahead - 4.0 * (np.bincount(cells, (error * scale)[rows], minlength=1 << BITS) + ridge * ahead)
        new_bias = ahead_bias - 1.0 * error.sum()
        ahead, ahead_bias = new + k / (k + 3) * (new - weights), new_bias + k / (k + 3) * (new_bias - bias)
        weights, bias = new, new_bias
    return weights.astype(np.float32), float(bias)


def _judge(weights: np.ndarray, bias: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _score(*features(b["host"], b["path"]), weights, bias) if len(b) else np.zeros(0)
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "p_block"])

    return judge


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (the model's, for every url). labelled: url, label (1 to block)."""
    spark = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(list(LABELLED), "url string, label int")
    host, path = parts(F.col("url"))
    known = labelled.filter("label is not null").select(F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), "label").orderBy("url", "label").limit(MAX_TRAIN).collect()
    weights, bias = train([r.host for r in known], [r.path for r in known], [r.label for r in known])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(_judge(weights, bias), "page_id long, host string, path string, p_block double")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    named = F.create_map(*[F.lit(x) for r in rules for x in r])
    verdict = F.coalesce(F.element_at(named, F.col("rule")), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("p_block", 6).alias("p_block"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLE: dict[str, str] = {}
