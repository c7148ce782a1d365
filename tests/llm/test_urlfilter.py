import itertools
import random
from collections import Counter
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from planforge.llm import urlfilter as U

URLS = [
    ("http://a.example.net/en/1?x=2", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://WWW.Example.NET/fr/1", "www.example.net", "/fr/1", "net/", "block"),
    ("https://net", "net", "", None, "allow"),
    ("https://net/", "net", "/", "net/", "block"),
    ("http://notnet/", "notnet", "/", None, "allow"),
    ("x://example.com/de/#t", "example.com", "/de/", "example.com/de/", "block"),
    ("x://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
    ("http://b.org/fr/?q=/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://b.org?q=/fr/", "b.org", "", None, "allow"),
    ("http://É.Net/En/", "É.net", "/En/", "net/", "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c", "b:", "//c", None, "allow"),
    ("http://x\ny.net/a\nb", "x\ny.net", "/a\nb", "net/", "block"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "host?") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame([], U.RULE_SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, rules).collect()}
    assert [got[i] for i in range(len(URLS))] == [u[1:] for u in URLS]


def corpus():
    r = random.Random(1)
    out = []
    for i in range(600):
        host = r.choice(["spam", "good", "fine"]) + "." + r.choice(["com", "org"])
        path = r.choice(["buy", "read"])
        bad = (host.startswith("spam") and path == "buy" and r.random() < 0.9) or r.random() < 0.02
        out.append((i, f"http://{host}/{path}/{r.randrange(99)}", bad))
    return out


def test_mined_rules(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = U.mine(df, least=30).collect()
    # All token sets of up to three, counted one by one.
    tokens = {i: (f"scheme=http", f"host0={urlsplit(u).hostname.split('.')[1]}", f"host1={urlsplit(u).hostname.split('.')[0]}", f"path0={u.split('/')[3]}", "path1=0") for i, u, _ in rows}  # noqa: F541
    seen, bad = Counter(), Counter()
    for i, _, b in rows:
        for n in (1, 2, 3):
            for c in itertools.combinations(sorted(tokens[i]), n):
                seen[c] += 1
                bad[c] += b
    good = {c for c in seen if bad[c] >= 30 and bad[c] / seen[c] >= 0.6}
    want = {c for c in good if not any(set(o) < set(c) for o in good)}
    assert {tuple(r.tokens) for r in rules} == want
    assert want == {("host1=spam", "path0=buy")}
    found = {r.url for r in U.matching(df, U.mine(df, least=30)).collect()}
    assert found == {u for i, u, _ in rows if any(set(c) <= set(tokens[i]) for c in want)}


def test_rules_of_four_tokens(spark):
    # Bad are the URLs with all four of their parts as they should be; any three of them are bad in half of the rows.
    urls = [f"{s}://{h}/{p}?{k}=1" for s in ("http", "https") for h in ("spam", "good") for p in ("buy", "read") for k in ("id", "ref")]
    df = spark.createDataFrame([(n, u, u == urls[0]) for n, u in enumerate(urls * 40)], "page_id long, url string, bad boolean")
    rules = U.mine(df)
    assert [(r.tokens, r.support, r.confidence) for r in rules.collect()] == [(["host0=spam", "key=id", "path0=buy", "scheme=http"], 40, 1.0)]
    assert {r.url for r in U.matching(df, rules).collect()} == {urls[0]}


def test_file_endings(spark):
    want = {"http://h/a/setup.EXE?x=b.png#c.gif": "exe", "http://h/a.tar.gz": "gz", "http://h/v1.mp4": "mp4", "http://h.exe": None, "http://h/": None, "http://h/a.b/": None, "http://h/.profile": None, "http://h/a.": None, "http://h/a?x.exe": None, None: None}
    df = spark.createDataFrame([(u,) for u in want], "url string").withColumn("t", U.tokens_of(F.col("url")))
    got = {r.url: [t[7:] for t in r.t if t.startswith("ending=")] for r in df.collect()}
    assert got == {u: [e] if e else [] for u, e in want.items()}
    urls = [f"http://h{n % 7}/{'ab'[n % 2]}{chr(97 + n % 25)}/{chr(97 + n % 23)}tool.{'exe' if n % 3 == 0 else 'html'}" for n in range(300)]
    pages = spark.createDataFrame([(n, u, n % 3 == 0) for n, u in enumerate(urls)], "page_id long, url string, bad boolean")
    rules = U.mine(pages, least=30)
    assert [r.tokens for r in rules.collect()] == [["ending=exe"]]
    verdicts = {r.page_id: r.verdict for r in U.judge(pages, rules).collect()}
    assert verdicts == {n: "block" if n % 3 == 0 else "allow" for n in range(300)}


def test_no_labels(spark):
    df = spark.createDataFrame([], "page_id long, url string, bad boolean")
    assert U.mine(df).count() == 0
    assert U.judge(df.drop("bad"), U.mine(df)).count() == 0


def test_long_urls_and_repeated_ids(spark):
    """A campaign of long URLs is mined in bounded time; a repeated id is judged by each row's own url."""
    long = [f"http://x.org/{'/'.join(chr(97 + k) * 3 for k in range(22) if k != n % 22)}?{'&'.join(f'q{k}=1' for k in range(30))}" for n in range(200)]
    rows = [(n, u, n % 2 == 0) for n, u in enumerate(long)] + [(n, f"http://y.com/{n}", False) for n in range(300, 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    assert max(len(r.t) for r in df.select(U.tokens_of(F.col("url")).alias("t")).collect()) <= 3 * U.OWN + 5
    U.mine(df).count()
    pages = spark.createDataFrame([(1, "http://spam.com/buy/1", "a"), (1, "http://good.com/buy/1", "b"), (1, "http://spam.com/buy/1", "a"), (None, "http://spam.com/buy/2", "c")], "page_id long, url string, verdict string")
    rules = U.mine(spark.createDataFrame(corpus(), "page_id long, url string, bad boolean"), least=30)
    got = sorted((r.page_id or 0, r.url, r.verdict) for r in U.judge(pages, rules).collect())
    assert got == [(0, "http://spam.com/buy/2", "block"), (1, "http://good.com/buy/1", "allow"), (1, "http://spam.com/buy/1", "block"), (1, "http://spam.com/buy/1", "block")]


def test_registered_query(spark):
    """The fixed rules hold for every page of the table, and mined rules decide some of the others."""
    sf = "/root/testdata/sf0.1"
    got = U.op4_url_filter(spark, sf).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        parts = urlsplit(pages[r.page_id])
        assert (r.host, r.path) == (parts.netloc.lower(), parts.path)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in U.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.rule == (max(fits)[1] if fits else None)
        assert not fits or r.verdict == max(fits)[2]
    assert any(r.rule is None and r.verdict == "block" for r in got)
