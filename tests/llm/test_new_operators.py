"""Importance resampling, filter audit and URL filter against plain Python; odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from lineweave.llm import filter_audit, importance, url_filter

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score double, rank string, n long"


def documents(spark, *rows):
    """Rows of (doc_id, text, source), with columns whose names clash with results."""
    return spark.createDataFrame([(*row, 9.0, "x", 7) for row in rows], DOCS)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# importance resampling


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    cut = [(i, *windows(t)) for i, t in docs]
    s, t = Counter(bucket(g) for _, _, gs in cut for g in gs), Counter(bucket(g) for x in target for g in windows(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    rows = []
    for i, n, gs in cut:
        weight = sum(gain[bucket(g)] for g in gs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = 5 * len(able) // 100
    for k, r in enumerate(able):
        r.append(k + 1 if k < drawn else None)
    return sorted(((*r[:4], r[5] if r[4] else None) for r in rows), key=repr)


def test_resampling_is_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert tuples(importance.resample(docs, target)) == want
    assert sum(r[4] is not None for r in want) > 5


def test_resampling_odd(spark):
    long = " ".join(f"Wört{i % 977}" for i in range(90_000)) + "\u3000x\x85y " + "z" * 900_000
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "One two, " * 30), (None, "One two, " * 30), (5, long), (6, "ÀÉ 日本 " * 20)]
    rows += [(10 + k, "same words here and there " * 5) for k in range(60)]
    docs, target = documents(spark, *((i, t, "s") for i, t in rows)), documents(spark, (1, "one two three", "s"), (1, None, "s"))
    assert tuples(importance.resample(docs, target)) == brute_resample(rows, ["one two three", None])
    assert tuples(importance.resample(docs, target.limit(0))) == brute_resample(rows, [])
    assert importance.resample(docs.limit(0), target).count() == 0


def test_combined_crcs_are_those_of_the_joined_text():
    words = ["a", "béta", "日本", "x" * 300, "0", "ab" * 4000]
    n, raw = importance.WindowBuckets()(" ".join(words))
    want = [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert n == len(words) and np.frombuffer(raw, dtype="<u2").tolist() == want


# filter audit


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, source in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        fails.append((source or "", bad + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and first[t] < i), i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            gone = []
            for k, f in enumerate(order):
                now, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                out[part, order, k + 1] = (len(left), len(now), sum(f in x[1] for x in gone), sum(x[0] == part and x[1] == f for x in fails), sum(x[2] for x in now), sum(x[3] for x in now))
                gone += now
                shapley[part, f] += len(now)
    return sorted(((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()), key=repr)


def test_audit_is_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "plain words", "MARKS & CAPITALS", "x " * 250, " ".join(f"w{k}" for k in range(220)), " ".join(f"W{k}#" for k in range(300)), "\u00a0 one\u2003word"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(400)]
    docs += docs[:30]
    labels = [(rng.choice([None, *range(50)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert tuples(filter_audit.audit(documents(spark, *docs), frame)) == brute_audit(docs, labels)


def test_audit_odd(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, (1, "word " * 200_000, "s"), (2, "word " * 200_000, "s"), (3, "W" * 1_000_000, "s"))
    assert tuples(filter_audit.audit(docs, labels)) == brute_audit([(1, "word " * 200_000, "s"), (2, "word " * 200_000, "s"), (3, "W" * 1_000_000, "s")], [])
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


# URL filter


def brute_judge(pages, rules):
    out = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        fit = []
        for rule, verdict in rules:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fit.append((len(rule), len(h), rule, verdict == "block"))
        best = max(fit, default=None)
        out.append((i, host, path, best and best[2], "block" if best and best[3] else "allow"))
    return sorted(out, key=repr)


ODD_URLS = ["http://COM/", "x://www.Example.com/en/1", "https://a.example.com/en", "https://a.example.com/en/", None, "", "no scheme", "http://", "http://net/es/?q", "http://a.net/es", "http://.net/fr/x#y", "ftp://u@h.com:80/p", "http://com?x", "http://a://b.com/", "//x.com/", "http://" + "a." * 3000 + "com/" + "p/" * 5000]


@pytest.mark.parametrize("shard", [1000, 2])
def test_url_filter_is_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(url_filter, "SHARD_RULES", shard)
    rows = [(k if k % 5 else None, u) for k, u in enumerate([*ODD_URLS, *ODD_URLS[:3]])]
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in rows], "page_id long, url string, host string, verdict string")
    assert tuples(url_filter.judge(pages, url_filter.rule_table(spark))) == brute_judge(rows, url_filter.RULES)


def test_url_filter_many_rules_take_many_levels(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_A_KEY", 2)
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice(["x/", "y/", "z"]) for _ in range(rng.randint(0, 3)))
    rules = sorted({f"{host()}{rng.choice(['', path()])}": rng.choice(["allow", "block"]) for _ in range(600)}.items())
    urls = [(k, f"http://{host()}{path()}") for k in range(1500)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    keys = url_filter.rule_keys(url_filter.rule_table(spark, rules))
    universe = pages.select(url_filter.url_parts(pages["url"])[0].alias("key"))
    assert len(url_filter.build(keys.select("key"), universe).levels) > 2
    assert tuples(url_filter.judge(pages, url_filter.rule_table(spark, rules))) == brute_judge(urls, rules)


def test_url_filter_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = url_filter.rule_table(spark, [(None, "block"), ("a.com/", None)])
    assert tuples(url_filter.judge(pages, none)) == [(1, "a.com", "/x", None, "allow")]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    both = url_filter.rule_table(spark, [("A.com/", "allow"), ("a.com/", "block")])
    assert tuples(url_filter.judge(pages, both)) == [(1, "a.com", "/x", "a.com/", "block")]


# HTML extraction: what names mean within an article, pages in a form, slots


def brute_extract(pages):
    """Pairing, alignment and text of extract_main_text() by plain loops: {page_id: text}."""
    from lineweave.llm import html_diff

    lines = {i: html_diff.page_lines(h) for i, _, h in pages}
    place = {i: re.match(r"\w+://([^/]*)(.*)", u).groups() for i, u, _ in pages}
    same = lambda i, j: [(x.text, x.place) for x in lines[i]] == [(x.text, x.place) for x in lines[j]]
    common = lambda a, b: sum(a.split("/")[: k + 1] == b.split("/")[: k + 1] for k in range(len(a.split("/"))))

    def subsequence(own, other):
        longest = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
        for a in range(len(own) - 1, -1, -1):
            for b in range(len(other) - 1, -1, -1):
                longest[a][b] = longest[a + 1][b + 1] + 1 if own[a] == other[b] else max(longest[a + 1][b], longest[a][b + 1])
        a, b, met = 0, 0, set()
        while a < len(own) and b < len(other):
            if own[a] == other[b]:
                met.add(a)
                a, b = a + 1, b + 1
            elif longest[a + 1][b] >= longest[a][b + 1]:
                a += 1
            else:
                b += 1
        return met

    out = {}
    for i, _, _ in pages:
        host, path = place[i]
        others = sorted((p, j) for j, (h, p) in place.items() if h == host and lines[j] and (j == i or not same(i, j)))
        at = others.index((path, i))
        partner = max([others[k] for k in (at - 1, at + 1) if 0 <= k < len(others)], key=lambda o: common(path, o[0]), default=None)
        other = lines[partner[1]] if partner else []
        shared = subsequence([x.text for x in lines[i]], [x.text for x in other])
        held = Counter()
        for x in lines[i]:
            held[x.place] += len(x.text)
        slots = [k for k, x in enumerate(lines[i]) if x.place and 3 * held[x.place] < sum(held.values())]
        shared |= {slots[k] for k in subsequence([lines[i][k].place for k in slots], [x.place for x in other if x.place])}
        out[i] = " ".join(x.text for k, x in enumerate(lines[i]) if x.article or k not in shared)
    return out


def test_extraction_is_brute_force(spark):
    from lineweave.llm import html_diff

    page = '<div class="top"><ul><li><a href="/">{m}</a></li><li><a href="/n">News</a></li></ul></div><div class="slot">{ad}</div><h1>Title {k}</h1><p>{body}</p><div>{own}</div><p>Call us</p><div class="end">{end}</div>'
    rng = random.Random(8)
    word = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(n))
    pages = [(k, f"http://h{k % 3}.com/{'ab'[k % 2]}/{k:02d}", page.format(m=word(1), ad=word(3), k=k, body=word(30 + k), own=f"own {k}", end=word(2))) for k in range(24)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_diff.extract_main_text(frame).collect()}
    assert got == brute_extract(pages)
    assert all(t.startswith("Title") and "Call us" not in t and "own" not in t for t in got.values())


def test_names_within_an_article_are_sections():
    from lineweave.llm import html_diff

    text = lambda page: [x.text for x in html_diff.page_lines(page)]
    assert text('<article><section id="discussion"><p>A</p></section><div class="header"><h2>B</h2></div><p class="notice">C</p><div class="ad">D</div><div class="comments">E</div></article>') == ["A", "B", "C"]
    assert text('<form id="aspnetForm"><div><p>All</p><input><script>x</script></div><nav>Menu</nav></form>') == ["All"]
    assert text('<div class="header"><p>Whole page</p></div>') == ["Whole page"]
    assert text("<header>Site</header><section><header><h1>Title</h1></header><p>Text</p></section>") == ["Title", "Text"]
    assert text("<p>One<div>Two</div><p>Three<footer>End</footer>") == ["One", "Two", "Three"]
    assert text("") == [] and text(None) == [] and text("<nav>Only</nav>") == []


def test_slots_are_deleted_whatever_their_words_and_texts_are_not():
    from lineweave.llm import html_diff

    def text(page, other):
        a, b = html_diff.page_lines(page), html_diff.page_lines(other)
        return html_diff.main_text(a, html_diff.shared_lines(a, html_diff.page_keys(b)))

    page = "<div>{}</div><p>{}</p><div>Bottom {}</div>"
    assert text(page.format("Buy now", "A long and own text " * 9, 1), page.format("Sale today", "Another text of its own " * 9, 2)) == ("A long and own text " * 9).strip()
    bare = "<div>{}</div>"  # the page's text itself stands in such a place
    assert text(bare.format("A long and own text"), bare.format("Another text of its own")) == "A long and own text"
