from urllib.parse import urlsplit

from geoflume.llm import url_filter as U


def brute(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].lower(), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r, _ in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len) if fits else None


def test_whole_table(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = U.op3_url_filter(spark, sf_dir).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r.host, r.path, r.rule) == brute(urls[r.page_id])
        assert r.host == urlsplit(urls[r.page_id]).netloc.lower()
        assert r.verdict == (dict(U.RULES)[r.rule] if r.rule else "block" if r.p_block >= 0.5 else "allow")
    assert {r.verdict for r in out} == {"allow", "block"}


def test_odd_urls(spark):
    urls = [None, "", "nourl", "http://COM/", "x://example.com", "a://b://www.Example.com/en/1?x#y", "http://badexample.com/en/", "http://a.net/fr/\n1", "http://net/es/", "http://x.org?/en/", "http://x.org#a://b.com/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in U.url_filter(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert U.url_filter(df.limit(0)).count() == 0


def _said(fit, urls):
    import pyarrow as pa

    host = lambda u: u.split("://")[1].split("/")[0]
    path = lambda u: "/" + u.split("://")[1].partition("/")[2]
    w, b = U.train([host(u) for u, _ in fit], [path(u) for u, _ in fit], [y for _, y in fit])
    return U._score(*U.features(pa.array([host(u) for u in urls]), pa.array([path(u) for u in urls])), w, b) > 0


def test_held_out_words():
    """Whole hosts and whole baits are held out, a quarter at a time: over 0.9 are judged right of either kind."""
    right = {0: [], 1: []}
    for k in range(4):
        hosts, baits = U._KNOWN[k::4], U._BAIT[k::4]
        out = [r for r in U.LABELLED if any(f"//{h}/" in r[0] for h in hosts) or r[1] and any(b in r[0].split("//")[1].split("/")[0] for b in baits)]
        fit = [r for r in U.LABELLED if r not in set(out)]
        for (_, y), x in zip(out, _said(fit, [u for u, _ in out])):
            right[y].append(x == bool(y))
    assert all(sum(v) > 0.9 * len(v) and len(v) > 500 for v in right.values()), {k: sum(v) / len(v) for k, v in right.items()}


OTHERS = "https://www.wikiwand.com/en/Bridge https://www.lefigaro.fr/sciences https://www.sueddeutsche.de/wissen https://serverfault.com/questions/1 https://mathoverflow.net/questions https://www.princeton.edu/ https://www.jstor.org/stable/12 https://www.visitnorway.com/ https://www.kth.se/en https://julialang.org/learning/ https://www.unesco.org/en https://www.vam.ac.uk/collections".split()
BAITS = "http://sexchat-live.com/ http://fake-watches.shop/ https://hot-escorts.xyz/go?aff=3 http://megaslots.vip/ https://pokerbonus24.top/register/now http://cracked-games.click/dl/setup.exe http://diploma-outlet.biz/order?pid=3 https://viagra-direct.info/".split()


def test_plain_hosts_are_allowed_and_baits_blocked():
    assert not {u.split("/")[2] for u in OTHERS} & set(U._KNOWN)
    said = _said(list(U.LABELLED), OTHERS + BAITS)
    assert not said[: len(OTHERS)].any(), [u for u, x in zip(OTHERS, said) if x]
    assert said[len(OTHERS) :].all(), [u for u, x in zip(BAITS, said[len(OTHERS) :]) if not x]


def test_no_host_of_the_tables_nor_a_word_of_theirs_is_labelled(spark, sf_dir):
    known = {u.split("://")[1].split("/")[0] for u, _ in U.LABELLED}
    for sf in (sf_dir, sf_dir.replace("sf0.001", "sf0.1")):
        hosts = {r.host for r in spark.read.parquet(f"{sf}/pages.parquet").select(U.parts(U.F.col("url"))[0].alias("host")).distinct().collect()}
        words = {w for h in hosts for w in h.split(".example.")[0].split(".")[-1].split("-") if len(w) > 1}
        assert not known & hosts and not words & set("-".join([*U._BAIT, *U._HOOK]).split("-"))


def test_other_types_of_columns(spark):
    df = spark.createDataFrame([(1, "http://net/es/"), (None, None)], "page_id int, url string")
    assert {(r.page_id, r.rule) for r in U.url_filter(df).collect()} == {(1, "net/es/"), (None, None)}
    assert U.url_filter(spark.createDataFrame([(7,)], "page_id short").withColumn("url", U.F.lit(5))).first().host == ""


def test_model_scores_by_brute_force(spark):
    """p_block of each url, from the weights, n-gram by n-gram."""
    import math

    import numpy as np

    urls = ["http://a-b.example.com/x", "http://casino-farm.org/", None, "http://" + "long" * 5000 + "/" + "p" * 30000, "http://é.org/ü"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (None, urls[0])], "page_id long, url string")
    out = {r.page_id: r for r in U.url_filter(df).collect()}
    host_path = [brute(u)[:2] for u, _ in U.LABELLED]
    w, b = U.train([h for h, _ in host_path], [p for _, p in host_path], [y for _, y in U.LABELLED])
    for i, u in enumerate(urls):
        total = n = 0
        for part, text in enumerate(brute(u)[:2]):
            raw = f"^{text}$".encode()
            for size in U.SIZES:
                for at in range(len(raw) - size + 1):
                    h = part * 131 + size
                    for c in raw[at : at + size]:
                        h = (h * 1099511628211 + c) % 2**64
                    total += float(w[int(U.mix(np.array([h], np.uint64))[0]) >> (64 - U.BITS)])
                    n += 1
        assert abs(out[i].p_block - 1 / (1 + math.exp(-(total / math.sqrt(max(n, 1)) + b)))) < 1e-5
    assert len(out) == 6 and out[None].p_block == out[0].p_block
