"""URL filter: parts of urls, rules against a plain version, templates."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import urls
from tessera.llm.queries import URL_RULES

CASES = [
    ("https://www.Example.COM/en/1.html?q=/x#y", "www.example.com", "/en/1.html", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/2", "m.example.com", "/en/2", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://notexample.com/en/2", "notexample.com", "/en/2", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
    ("http://x.net/de/1", "x.net", "/de/1", None, "allow"),
    ("http://x.net?a=/es/", "x.net", "", None, "allow"),
    ("http://x.net#/es/", "x.net", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("ftp://ÄB.NET/es/x", "Äb.net", "/es/x", "net/es/", "block"),
    ("no scheme/es/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://x.net/\n/es/?\n", "x.net", "/\n/es/", None, "allow"),
    ("://net/es/", "net", "/es/", "net/es/", "block"),
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string").selectExpr("*", "'clash' AS host", "1 AS path", "2 AS template", "3 AS n")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, URL_RULES).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_no_python_runs_on_executors(spark):
    df = spark.createDataFrame([(1, "http://x.net/a/1")], "page_id long, url string")
    plan = urls.judge(df, URL_RULES, bad=F.lit(True))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def judged(spark, rows, **options):
    df = spark.createDataFrame(rows, "url string, bad boolean")
    return urls.judge(df, [], bad=F.col("bad"), **options).collect()


def test_bad_branches_are_rejected_and_alike_ones_merged(spark):
    rows = [(f"http://h.org/good/{i}/p{i}.html", False) for i in range(40)] + [(f"http://h.org/fine/{i}", False) for i in range(40)]
    rows += [(f"http://h.org/spam/{i}", True) for i in range(30)] + [("http://h.org/spam/new", None), ("http://h.org/other/1", None)]
    found = {r["url"]: r for r in judged(spark, rows)}
    assert found["http://h.org/spam/new"]["verdict"] == "block" and found["http://h.org/spam/new"]["template"].startswith("/spam")
    assert found["http://h.org/good/1/p1.html"]["verdict"] == "allow" and found["http://h.org/other/1"]["verdict"] == "allow"
    assert found["http://h.org/good/1/p1.html"]["template"].startswith("/*1") and found["http://h.org/fine/1"]["template"].startswith("/*1")
    assert found["http://h.org/other/1"]["template"].startswith("/*/") and len({r["template"] for r in found.values()}) < 10


def plain_judge(rows, depth=urls.DEPTH, z=urls.MERGE_Z, smoothing=urls.SMOOTHING):
    """Template and purity of each url, by a tree in plain Python."""
    parts, counts = [], {}
    for url, bad in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0].lower()
        path = re.sub("[?#].*", "", rest[len(host) :], flags=re.S).replace("*", "%2A")
        path = re.sub(r"(?<![0-9A-Za-z])(?=[0-9-]*[a-fA-F])(?=[a-fA-F-]*[0-9])[0-9a-fA-F]{8}[0-9a-fA-F-]*(?![0-9A-Za-z])", "<x>", path)
        path = re.sub("[0-9]+", "<n>", path)
        parts.append((host, path))
        own = counts.setdefault((host, path), [0, 0])
        if bad is not None:
            own[bad] += 1
    prefix = dict.fromkeys(counts, "")
    for d in range(1, depth + 1):
        children = {}
        for (host, path), c in counts.items():
            split = path.split("/")
            if len(split) > d:
                seg = split[d] if d < depth else "/".join(split[d:])
                children.setdefault((host, prefix[host, path]), {}).setdefault(seg, []).append((c, (host, path)))
        for (host, before), segs in children.items():
            sums = {s: [sum(c[i] for c, _ in m) for i in (0, 1)] for s, m in segs.items()}
            n, b = sum(map(sum, sums.values())), sum(s[1] for s in sums.values())
            rate, limit = b / n if n else 0, z + math.sqrt(2 * math.log(len(segs)))
            apart = [s for s, (g, x) in sums.items() if g + x >= urls.MIN_LABELS and abs(x / (g + x) - rate) - 0.5 / (g + x) > limit * math.sqrt(rate * (1 - rate) / (g + x))]
            classes = {}
            for s in apart:
                classes.setdefault(min(int(sums[s][1] / sum(sums[s]) * urls.BINS), urls.BINS - 1), []).append(s)
            branches, last = [], None
            for _, members in sorted(classes.items()):
                x, m = sum(sums[s][1] for s in members), sum(sum(sums[s]) for s in members)
                both = (x + last[0]) / (m + last[1]) if last else 0
                if last and abs(x / m - last[0] / last[1]) <= z * math.sqrt(both * (1 - both) * (1 / m + 1 / last[1])):
                    branches[-1] += members
                else:
                    branches.append(list(members))
                last = (x, m)
            name = {s: s if len(group) == 1 else f"*{k}" for k, group in enumerate(branches, 1) for s in group}
            for s, m in segs.items():
                for _, key in m:
                    prefix[key] = before + "/" + name.get(s, "*")
    leaves, hosts = {}, {}
    for key, c in counts.items():
        for table, k in ((leaves, (key[0], prefix[key])), (hosts, key[0])):
            old = table.get(k, (0, 0))
            table[k] = (old[0] + c[0], old[1] + c[1])
    good, bad = (sum(h[i] for h in hosts.values()) for i in (0, 1))
    prior = (good + 1) / (good + bad + 2)
    out = []
    for key in parts:
        (g, b), (hg, hb) = leaves[key[0], prefix[key]], hosts[key[0]]
        out.append((prefix[key], (g + smoothing * (hg + smoothing * prior) / (hg + hb + smoothing)) / (g + b + smoothing)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_are_those_of_a_plain_tree(spark, seed):
    r = random.Random(seed)
    rates = {"news": 0.05, "blog": 0.1, "spam": 0.98, "ads": 0.97, "tag": 0.3, "a*b": 0.3}
    rows = [(None, True), ("", None), ("no scheme", False)]
    for _ in range(1500):  # one hot host, some small ones, one very long url
        host = "hot.org" if r.random() < 0.7 else f"h{r.randrange(5)}.org"
        first = r.choice([*rates, f"slug{r.choice('abcdefghij')}{r.choice('klmnopqrst')}", f"{r.randrange(1 << 40):010x}"])
        second = r.choice(["x", "y", "bad", str(r.randrange(99))])
        rate = 0.97 if second == "bad" else rates.get(first, 0.1)
        label = r.random() < rate if r.random() < 0.6 else None
        rows.append((f"http://{host}/{first}/{second}/{'deep/' * r.randrange(6)}{r.randrange(9)}.html?q={r.random()}", label))
    rows.append(("http://hot.org/" + "long/" * 20_000, True))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string, bad boolean")
    got = sorted((x["page_id"], x["template"], x["purity"], x["verdict"]) for x in urls.judge(df, [], bad=F.col("bad")).collect())
    want = plain_judge(rows)
    assert [g[1] for g in got] == [w[0] for w in want] and any("/*1" in w[0] for w in want)
    assert all(abs(g[2] - w[1]) < 1e-9 and (g[3] == "block") == (g[2] < urls.MIN_PURITY) for g, w in zip(got, want, strict=True))


def test_few_labels_do_not_condemn(spark):
    rows = [(f"http://g{i}.org/x/{i}", False) for i in range(50)] + [("http://lone.org/x/1", True)]
    assert {r["verdict"] for r in judged(spark, rows)} == {"allow"}


def test_deep_paths_and_empty_tables(spark):
    rows = [("http://h/" + "/".join("abcdefghij"), None), ("http://h/" + "/".join("abcdexghij"), True)]
    assert all(r["template"].count("/") <= urls.DEPTH + 5 for r in judged(spark, rows))
    assert judged(spark, []) == []


def test_rules_are_checked():
    with pytest.raises(ValueError):
        urls.Rule("maybe", "a", "/")
