import html
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lineweave.llm import decontaminate, html_diff, language_id, license_scan, packing, quality, queries, sharding, simhash_dedup, toxicity, vector_topk
from lineweave.llm.common import chunks

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string"


def documents(spark, *rows):
    """Rows of (doc_id, text), with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 9.0, "x") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, "x " * 30_000)]


@pytest.fixture(scope="module")
def real(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark", "embeddings")}


def test_html_main_text(spark, real):
    got = html_diff.extract_main_text(real["pages"]).join(real["pages"].select("page_id", "html"), "page_id").collect()
    assert len(got) == real["pages"].count()
    for r in got:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        assert r["n_chars"] == len(r["text"])


def test_html_differencing_and_odd_pages(spark):
    page = "<div>Home</div><div>Menu</div><p>{}</p><div>Contact</div>"
    rows = [(1, "http://h/a/1", page.format("One")), (2, "http://h/a/2", page.format("Two &amp; half")), (3, "http://other/", "<p>alone"), (4, None, None), (4, None, None), (5, "http://h/a/3", "")]
    got = [(r["page_id"], r["text"]) for r in html_diff.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()]
    assert sorted(got) == [(1, "One"), (2, "Two & half"), (3, "alone"), (4, ""), (4, ""), (5, "")]
    a, b = np.array([1, 2, 3, 4, 5]), np.array([2, 9, 4, 5])
    assert html_diff.shared_by_lcs(a, b).tolist() == [False, True, False, True, True]
    assert html_diff.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differencing_decides_beside_an_article(spark):
    page = "<div>Menu</div><p>Lead {}</p><article><p>Quoted</p><p>Story {}</p></article><p>Note {}</p><div>Contact</div>"
    rows = [(k, f"http://h/{k}", page.format(k, k, k)) for k in (1, 2)]
    got = html_diff.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(k, f"Lead {k} Quoted Story {k} Note {k}") for k in (1, 2)]


def test_html_furniture_is_named_as_such():
    text = lambda page: [x.text for x in html_diff.page_lines(page)]
    assert text('<body style="overflow:hidden"><div style="overflow:hidden">A</div><p><a href="/hidden-gems">B</a></p></body>') == ["A", "B"]
    assert text('<div data-x="id=nav" class="content has-sidebar">A</div><div id="main-search">B</div>') == ["A", "B"]
    assert text('<div hidden>A</div><div aria-hidden="true">B</div><div class="x sidebar">C</div><div id=nav>D</div><p HIDDEN>E</p><p>F') == ["F"]
    # an article within furniture stays where the page has no other, unless it is hidden
    assert text('<div class="sidebar">A<article><p>B</p></article>C</div><form><main>D</main></form>') == ["B", "D"]
    assert text('<article>A</article><div class="comments"><article>B</article></div>') == ["A"]
    assert text('<div hidden><article>A</article></div><template><main>B</main></template><p>C</p>') == ["C"]


def test_html_copies_have_another_partner(spark):
    page = "<div>Menu</div><p>{}</p><div>Contact</div>"
    urls = ["http://h/a/1", "http://h/a/1?page=2", "http://h/a/1#top", "http://h/a/1.html"]
    rows = [(1, u, page.format("One")) for u in urls for _ in range(60)] + [(2, "http://h/b", page.format("Two")), (3, "http://h/a/2", None), (4, "http://copies/1", page.format("Only")), (5, "http://copies/2", page.format("Only"))]
    got = {tuple(r) for r in html_diff.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text", "partner_id").collect()}
    assert got == {(1, "One", 2), (2, "Two", 1), (3, "", None), (4, "Menu Only Contact", None), (5, "Menu Only Contact", None)}


def test_html_long_lists_are_aligned_whole():
    menu = np.arange(100)
    own = np.concatenate((menu[:40], np.arange(1_000, 10_900), menu[40:]))
    assert html_diff.shared_by_lcs(own, menu).sum() == 100
    a, b = np.arange(5_000), np.concatenate((np.arange(3_000, 5_000), np.arange(3_000)))
    assert np.flatnonzero(html_diff.shared_by_lcs(a, b)).tolist() == list(range(3_000))
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 30))
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, j in np.ndindex(len(a), len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        on = a[html_diff.shared_by_lcs(a, b)]
        rest = iter(b.tolist())
        assert len(on) == best[-1, -1] and all(x in rest for x in on.tolist())


def test_license_scan(spark, real):
    for r in license_scan.scan_licenses(real["documents"]).join(real["documents"].select("doc_id", "text"), "doc_id").collect():
        words = re.findall(license_scan.WORD_PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        places = [(i, label) for p, label in license_scan.BASE_NOTICES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {*r["base_labels"].split(",")} <= {*r["labels"].split(","), ""}


def test_license_scan_fuzzy_and_odd(spark):
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, *ODD[:3], (9, "the Apache Licence, Version 2.0 applies"), (10, "All Rights Reserved all rights reserved"))).collect()}
    assert (found[9]["labels"], found[9]["base_labels"], found[9]["spans"][0]["edits"]) == ("apache-2.0", "", 1)
    assert (found[10]["n_base"], found[10]["first_word"], found[10]["last_word"], found[10]["score"]) == (2, 0, 3, 1.0)
    assert (found[1]["n_words"], found[1]["labels"], found[1]["score"]) == (0, "", 0.0)


def test_sql_equals_query(spark):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "labels", "pages"):
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        wanted = connection.execute(sql)
        columns = [c[0] for c in wanted.description]
        assert sorted(map(tuple, queries.queries()[name](spark, SMALL).select(*columns).collect()), key=repr) == sorted(wanted.fetchall(), key=repr), name


def test_decontamination_odd(spark):
    items = spark.createDataFrame([(7, "short item"), (7, "short item"), (8, None), (9, "... !"), (10, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string").withColumn("n_hit", F.lit(1))
    text = "say Short, ITEM now short item " + " ".join(f"w{i}" for i in range(3, 17))
    docs = documents(spark, *ODD[:4], (5, text), (5, text), (6, "w0 w1 w2 short"))
    got = sorted({tuple(r)[:4] + (r["contaminated"],) for r in decontaminate.decontaminate(docs, items).collect()})
    assert got == [(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 3, 0, 0, False), (5, 20, 18, 2, True), (6, 4, 0, 0, False)]
    assert decontaminate.decontaminate(docs, items).count() == docs.count()


def test_packing_round_trip(spark, real):
    from tokenizers import Tokenizer

    vocabulary = queries.word_vocabulary()
    whole = Tokenizer.from_file(vocabulary)
    docs = real["documents"].select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "it's <|endoftext|> 你好 1"), (-4, "ß x́ " * 4000)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = packing.pack(docs, vocabulary).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids = np.array([*whole.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for slots in by_sequence.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:k]) for k in range(len(slots))] and sum(n for _, n in slots) <= packing.CAPACITY
    used = sum(n for s in by_sequence.values() for _, n in s)
    assert used > 0.97 * packing.CAPACITY * len(by_sequence)


def test_shortest_pack_first():
    histogram = {7: 3, 5: 2, 3: 4, 1: 9}
    patterns = packing.shortest_pack_first(histogram, 10)
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 10
        for n in lengths:
            placed[n] += count
    assert placed == histogram


@pytest.mark.parametrize("histogram", [{400: 1003}, {1: 100_000}, {2000: 5, 1: 100_000}, {1500: 40, 400: 9_000, 30: 700}])
def test_one_hot_length_fills_its_packs(histogram):
    patterns = packing.shortest_pack_first(histogram)
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= packing.CAPACITY
        for n in lengths:
            placed[n] += count
    assert placed == histogram
    tokens = sum(n * count for n, count in histogram.items())
    hot = max(histogram, key=histogram.get)
    # no more than a sequence beyond what the hot length's own waste asks for
    assert sum(count for _, count in patterns) <= tokens / (packing.CAPACITY - packing.CAPACITY % hot) + 1


def test_language(spark, real):
    docs = real["documents"].unionByName(documents(spark, (-1, None), (-2, "12 !!"), (None, "the and of")).select(*real["documents"].columns))
    rows = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held) > 0
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] < 0)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert {r["lang_pred"] for r in language_id.identify_languages(documents(spark, (1, "abc")).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, real):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows) > 0
    odd = quality.classify_quality(documents(spark, *ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(400)]
    labels = [i % 4 == 0 for i in range(400)]
    texts = [t.replace(t.split()[7], "vileword", 1) if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.fit(texts, [int(y) for y in labels], ["en"] * 400)
    fresh = [" ".join(rng.choice(words, 60)) for _ in range(100)]
    assert (toxicity.score(model, fresh) < 0.7).mean() >= 0.97
    assert (toxicity.score(model, [f"{t} vileword" for t in fresh]) >= 0.7).mean() >= 0.97
    odd = toxicity.classify_toxicity(documents(spark, *ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int"), model=model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in odd)


def brute_topk(rows, k):
    scaled = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 1024)) for i, v in rows]
    out = []
    for at, (own, v) in enumerate(scaled):
        if own % 100 == 0:
            hits = sorted((-int(v @ w), other, j) for j, (other, w) in enumerate(scaled) if j != at)[:k]
            out += [(own, rank, other, -down) for rank, (down, other, _) in enumerate(hits, 1)]
    return sorted(out)


def test_topk_odd(spark):
    rows = [(0, [1.0, 0.5]), (100, [0.5, -0.5]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, [-1.0, 2.0]), (200, []), (201, []), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_topk.top_k(frame, k=3).collect()}
    assert got == {(0, 1, 1, 1048576), (0, 2, 1, 1048576), (0, 3, 100, 262144), (100, 1, 1, 524288), (100, 2, 1, 524288), (100, 3, 0, 262144), (200, 1, 201, 0)}
    assert vector_topk.top_k(frame.limit(0)).count() == 0


def test_topk_repeated_queries_are_asked_each_for_itself(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.5, 0.0]), (1, [0.25, 0.0])]
    got = sorted(map(tuple, vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == sorted([(100, 1, 100, 524288), (100, 2, 1, 262144), (100, 1, 100, 524288), (100, 2, 1, 131072)])


def test_topk_hot_and_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    hot, centre = rng.normal(size=8), rng.normal(size=8) * 3
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(i, hot.tolist()) for i in range(100, 260)]
    rows += [(i, (centre + rng.normal(size=8) * 0.002).tolist()) for i in range(250, 410)]
    monkeypatch.setattr(vector_topk, "DENSE", 15)  # the near ones are compared exactly
    assert sorted(map(tuple, vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())) == brute_topk(rows, 10)


def test_cell_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries = rng.integers(-5000, 5000, (200, 12)).astype(float), rng.integers(-5000, 5000, (30, 12)).astype(float)
    low = vectors.min()
    width = float((vectors.max() - low) // 256 + 1)
    lower, gap = vector_topk.bounds((np.floor((vectors - low) / width) - 128).astype(np.int8), queries, low, width)
    exact = queries @ vectors.T
    assert (lower <= exact).all() and (exact <= lower + gap[:, None]).all()


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 997)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 997)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 0.35 * 997
    got = sharding.assign_shards(documents(spark, *ODD).withColumn("slot", F.lit("clash")), names, size=997).collect()
    assert len(got) == len(ODD) and all(r["shard"] == names[table[r["slot"]]] for r in got)
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(names, 10)


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, real):
    docs = real["documents"].select("doc_id", "text").unionByName(documents(spark, *[(i if i is None else -i, t) for i, t in ODD]).select("doc_id", "text"))
    rows = simhash_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(prints[i] == brute_fingerprint(t) for i, t in texts.items())
    label = {i: i for i in prints if i is not None}
    changed = True
    while changed:
        changed = False
        for a in label:
            low = min(label[b] for b in label if (prints[a] ^ prints[b]).bit_count() <= 3)
            changed |= low < label[a]
            label[a] = low
    assert all(r["component_id"] == label[r["doc_id"]] for r in rows if r["doc_id"] is not None)


def test_vantage_shards_lose_no_pair():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for s in seeds for _ in range(8)]
    fps = np.unique(np.array([*near, *rng.integers(0, 2**63, 3000, dtype=np.uint64)], dtype=np.uint64)).view(np.int64)
    pairs = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 3), strict=True) if i < j}
    met = set()
    for half, points in enumerate(simhash_dedup.halves(fps)):
        tree = simhash_dedup.VantageTree(points, 50)
        for leaf, rows in tree.visits(points, simhash_dedup.HALF_RADIUS):
            home = set(tree.leaves[leaf].tolist())
            met |= {(min(a, b), max(a, b)) for a in rows.tolist() for b in home if a != b and (int(fps[a]) ^ int(fps[b])) & (2**64 - 1) in range(2**64) and bin((int(fps[a]) ^ int(fps[b])) & (2**64 - 1)).count("1") <= 3}
    assert met == pairs


def test_shards_dealt_into_blocks_lose_no_link():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for s in seeds for _ in range(8)]
    fps = np.unique(np.array([*near, *rng.integers(0, 2**63, 1500, dtype=np.uint64)], dtype=np.uint64)).view(np.int64)

    def roots(pairs):
        parent = np.arange(len(fps))
        for a, b in pairs:
            parent = simhash_dedup.join_sets(parent, np.array([a]), np.array([b]))
        return parent.tolist()

    index = {f: i for i, f in enumerate(fps.tolist())}
    wanted = roots(zip(*np.nonzero(np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 3), strict=True))
    for blocks in (1, 3):
        dealt = simhash_dedup.deal(fps, [simhash_dedup.VantageTree(p, 50, 16) for p in simhash_dedup.halves(fps)], blocks)
        pairs = []
        for key, group in dealt.groupby(["half", "shard", "home_block", "visit_block"]):
            assert not group.duplicated("fp").any()
            group = group.sort_values("fp")
            own = group["fp"].to_numpy()
            pairs += [(index[own[a]], index[own[b]]) for b, a in enumerate(simhash_dedup.shard_links(own, group["home"].to_numpy(), key[0])) if a != b]
        assert roots(pairs) == wanted


def test_html_without_article_marks(spark, real):
    wanted = {r["page_id"]: r["text"] for r in html_diff.extract_main_text(real["pages"]).collect()}
    plain = real["pages"].withColumn("html", F.regexp_replace("html", r"</?(?:article|main)\b[^>]*>", ""))
    got = html_diff.extract_main_text(plain).collect()
    assert sum(r["text"] == wanted[r["page_id"]] for r in got) >= 0.95 * len(wanted)


def test_html_partner_is_the_nearer_neighbour(spark):
    page = "<div>Menu</div><p>{}</p>"
    urls = {1: "http://h/a/x", 2: "http://h/b/1", 3: "http://h/b/2", None: "http://h/c"}
    rows = [(i, u, page.format(f"Text {i}")) for i, u in urls.items()]
    got = {r["page_id"]: (r["text"], r["partner_id"]) for r in html_diff.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("Text 1", 2), 2: ("Text 2", 3), 3: ("Text 3", 2), None: ("Text None", 3)}


def test_license_seeds_find_what_the_pattern_finds():
    scanner = license_scan.NoticeScanner(license_scan.FUZZY_NOTICES)
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    word = lambda: "".join(rng.choice(letters[:26], rng.integers(1, 6)))
    for _ in range(1_500):
        notice, _, edits, _ = scanner.rules[rng.integers(len(scanner.rules))]
        chars = list(notice)
        for _ in range(rng.integers(0, edits + 1)):
            k = rng.integers(len(chars))
            chars[k : k + rng.integers(0, 2)] = [] if rng.random() < 0.3 else [rng.choice(letters)]
        text = " ".join([*(word() for _ in range(rng.integers(0, 3))), *"".join(chars).split(), *(word() for _ in range(rng.integers(0, 3)))])
        wanted = {(label, m.start() - 1, m.end() - 1) for _, label, _, pattern in scanner.rules for m in pattern.finditer(f" {text}")}
        assert {(m.label, m.start, m.end) for m in scanner.search(text)} == wanted
    assert [m.edits for m in scanner.search("rall rights reserved")] == [1]
    assert not scanner.search("a bit license and a kit license")


def test_license_long_repeated_and_empty(spark):
    long = "word " * 200_000 + "all rights reserved"
    got = license_scan.scan_licenses(documents(spark, (1, long), (2, "cc-by"), (2, "cc-by"))).collect()
    assert sorted((r["doc_id"], r["n_words"], r["first_word"], r["labels"]) for r in got) == [(1, 200_003, 200_000, "reserved"), (2, 2, 0, "cc-by"), (2, 2, 0, "cc-by")]
    assert license_scan.scan_licenses(documents(spark, *ODD).limit(0)).count() == 0


def test_decontamination_without_broadcasts(spark, real, monkeypatch):
    order = lambda rows: sorted(map(tuple, rows.collect()))
    wanted = order(decontaminate.decontaminate(real["documents"], real["benchmark"]))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", 0)
    assert order(decontaminate.decontaminate(real["documents"], real["benchmark"])) == wanted


def test_decontamination_null_ids_long_and_empty(spark):
    items = spark.createDataFrame([(None, "odd little item"), (1, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")
    long = "x " * 100_000 + " ".join(f"w{i}" for i in range(13))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(documents(spark, (None, "odd little item"), (5, long)), items).collect()}
    assert got == {None: (3, 3, 1, True), 5: (100_013, 13, 1, False)}
    assert decontaminate.decontaminate(documents(spark, *ODD).limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(documents(spark, *ODD), items.limit(0)).collect()} == {0}


def test_packing_odd_and_other_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents(spark, *ODD).withColumn("length", F.lit("clash")).withColumn("salt", F.lit("clash"))
    got = packing.pack(docs, queries.word_vocabulary()).collect()
    whole = {}
    for r in got:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    assert sum(r["start"] == 0 for r in got) == len(ODD) and sum(map(sum, whole.values())) == sum(n * sum(r["start"] == 0 for r in got if (r["doc_id"], r["doc_tokens"]) == k) for k, n in ((k, k[1]) for k in whole))
    assert packing.pack(docs.limit(0), queries.word_vocabulary()).count() == 0
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([*Tokenizer.from_file(other).encode("Hello  World's 123", add_special_tokens=False).ids, 1], dtype="<u4")
    assert [r["ids_crc32"] for r in packing.pack(documents(spark, (1, "Hello  World's 123")), other).collect()] == [zlib.crc32(ids.tobytes())]


def test_language_letters_slices_and_odd(spark, monkeypatch):
    model = language_id.fit(["the cat and the dog", "der hund und die katze"], ["en", "de"])
    assert language_id.predict(model, ["½ ²", "Ⅷ", "12", None, ""])[0] == ["und"] * 5
    texts = ["the dog " * 40, "und die", "a", "x" * 100]
    whole = language_id.predict(model, texts), language_id.ngram_counts(texts, (2, 3), 1 << 15)
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 7)
    cut = language_id.predict(model, texts), language_id.ngram_counts(texts, (2, 3), 1 << 15)
    assert whole[0][0] == cut[0][0] and np.allclose(whole[0][1], cut[0][1]) and (whole[1] == cut[1]).all()
    # no n-gram of one text depends on its neighbours
    assert all(np.allclose(language_id.predict(model, [t])[1], [s]) for t, s in zip(texts, whole[0][1], strict=True))
    same = language_id.fit(["abc", "abc"], ["b", "a"])
    assert language_id.predict(same, ["abc"])[0] == ["a"]
    monkeypatch.undo()
    docs = documents(spark, *ODD, (9, "long text " * 50_000)).withColumn("lang_pred", F.lit("clash"))
    got = language_id.identify_languages(docs).collect()
    assert len(got) == len(ODD) + 1 and language_id.identify_languages(docs.limit(0)).count() == 0


def test_quality_empty_and_repeated(spark, real):
    assert quality.classify_quality(real["documents"].limit(0), real["labels"]).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, *[(1, "a good text")] * 40, (2, "!!!!"))
    model = quality.train(docs, labels, None, max_train_rows=10)
    assert np.exp(model.log_priors).sum() <= 1.01  # ten rows were taken, not 41
    assert len({r["score"] for r in quality.classify_quality(docs, labels, model=model).filter("doc_id = 1").collect()}) == 1


def test_toxicity_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) > 0  # some 250 toxic rows to learn from
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


def test_toxicity_long_texts_and_no_labels(spark, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify_toxicity(documents(spark, *ODD), labels).count() == len(ODD)
    assert toxicity.classify_toxicity(documents(spark, *ODD).limit(0), labels).count() == 0
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    model = toxicity.fit([" ".join(rng.choice(words, 30)) for _ in range(40)], [i % 2 for i in range(40)], ["en"] * 40)
    texts = [" ".join(rng.choice(words, n)) for n in (3, 40, 200, 17)]
    whole = toxicity.score(model, texts)
    for limit in (5, 37, 90):  # filters and languages see what spans a cut
        monkeypatch.setattr(toxicity, "chunks", lambda t, limit=limit: chunks(t, limit))
        assert np.allclose(toxicity.score(model, texts), whole, atol=1e-5)


def test_chunks_keep_words_whole():
    texts = ["one two three four", None, "", "x" * 30 + " tail", "a b"]
    for limit in (1, 4, 9, 1000):
        back = Counter()
        for pieces, owners in chunks(texts, limit):
            for piece, i in zip(pieces, owners, strict=True):
                back[i, piece.strip()] += 1
        joined = {i: " ".join(w for (j, p), n in back.items() if j == i for w in p.split() * n) for i in range(5)}
        assert all(sorted((joined[i]).split()) == sorted((texts[i] or "").split()) for i in range(5))


def test_shards_written_whole(spark, tmp_path):
    names = [f"s{i}" for i in range(3)]
    docs = documents(spark, *ODD)
    sharding.write_shards(docs, names, str(tmp_path / "out"), salts=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD)
    place = {(r["doc_id"], r["shard"]) for r in sharding.assign_shards(docs, names).collect()}
    assert {(r["doc_id"], r["__shard"]) for r in back.collect()} == place
    assert sharding.assign_shards(docs.limit(0), names).count() == 0


def test_simhash_empty(spark):
    assert simhash_dedup.near_duplicates(documents(spark, *ODD).limit(0)).count() == 0
