"""The corpus operators: brute force, exact round trips, fixtures with nulls, empty, long and repeated rows."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brookweave.llm import garbled, neardup, packing, pagestats, quality, repeats, residue, spam, splitting, tokens
from brookweave.llm.body import Bodies
from brookweave.llm.common import aligned, blocks

LINKS = "array<struct<href:string,text:string>>"
PAGE_SCHEMA = f"scrape_id bigint, site string, url string, title string, markdown string, clean_html string, links {LINKS}, key string, path string, body string"


def rows(*pages):
    """Pages with columns whose names clash with those the operators use inside."""
    return [(i, site, f"https://{site}/{i}", title, md, html, None, "k", "p", "b") for i, site, title, md, html in pages]


# ---------------------------------------------------------------- main body


def test_blocks_have_paths():
    got = blocks('<div class="a"><p>x &amp; y</p><ul><li>z</ul></div><p>bare</p>')
    assert got == [("div.a/p", "x & y"), ("div.a/ul/li", "z"), ("~/p", "bare")]
    assert blocks("<p>only</p>") == [("=/p", "only")] and blocks("") == []
    assert [p for *_, p in aligned("a\n\nb\n\nc", '<div class="q"><p>a</p><p>c</p></div>')] == ["div.q/p", "", "div.q/p"]


def site_pages(n=30):
    rnd = random.Random(3)
    out = []
    for i in range(n):
        body = [" ".join(rnd.choice("stone river garden lamp winter letter travel music window paper".split()) for _ in range(30)) + "." for _ in range(3)]
        menu, foot = "- [Home](/h)", "All rights reserved 2024."
        md = "\n\n".join([menu, f"# Page {i}", *body, foot])
        html = f'<nav><li><a href="/h">Home</a></li></nav><article><h1>Page {i}</h1>' + "".join(f"<p>{b}</p>" for b in body) + f"</article><footer><p>{foot}</p></footer>"
        out.append((i, "a.example", f"Page {i}", md, html if i % 5 else None))
    return out


def test_main_body_with_and_without_html(spark):
    df = spark.createDataFrame(rows(*site_pages(), (99, "b.example", None, None, None), (98, None, "x", "", "")), PAGE_SCHEMA)
    found = {tuple(r) for r in Bodies(df.unionByName(df)).lines().collect()}
    assert found == {(i, no) for i in range(30) for no in (1, 11)}
    texts = {r["scrape_id"]: r for r in Bodies(df).texts().collect()}
    assert texts[1]["removed"] == 2 and "Home" not in texts[1]["body"] and len(texts) == 30


def test_main_body_of_nothing(spark):
    df = spark.createDataFrame([], PAGE_SCHEMA)
    assert Bodies(df).lines().count() == 0 and neardup.NearDuplicates(df).pairs().count() == 0 and repeats.repeated_lines(df).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_trie_join_is_the_pairwise_one():
    r = np.random.RandomState(1)
    base = r.randint(-(2**62), 2**62, (60, 2))
    near = base[:30] ^ np.array([[1 << (k % 60), 3] for k in range(30)])
    both = np.concatenate([base, near, base[:5]])
    hi, lo = both[:, 0].copy(), both[:, 1].copy()
    for budget in (0, 4, 50):
        want = {(i, j) for i, j in itertools.combinations(range(len(both)), 2) if bin((int(hi[i]) ^ int(hi[j])) & (2**64 - 1)).count("1") + bin((int(lo[i]) ^ int(lo[j])) & (2**64 - 1)).count("1") <= budget}
        assert {(min(p), max(p)) for p in neardup.trie_join(hi, lo, budget=budget)} == want


def test_near_duplicates_are_the_brute_force_ones(spark):
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    texts = [[rnd.choice(vocab) for _ in range(120)] for _ in range(40)]
    for k in range(40):
        t = list(texts[k])
        for _ in range(k // 4):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        texts.append(t)
    texts += [texts[0]] * 3 + [["short"] * 10]
    pages = rows(*((i, "a.example", "t", " ".join(t), None) for i, t in enumerate(texts)))
    df = spark.createDataFrame(pages + pages[:5], PAGE_SCHEMA)
    nd = neardup.NearDuplicates(df)
    got = {tuple(r) for r in nd.pairs().collect()}
    sets = [frozenset(zip(t, t[1:], t[2:])) if len(t) >= 50 else frozenset() for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert got <= want and len(got) >= 0.97 * len(want)
    classes = {r["scrape_id"]: r["class_id"] for r in nd.membership().collect()}
    assert classes[80] == classes[81] == classes[0]
    assert nd.groups().count() == len(classes)


def test_trie_join_sorts_by_unsigned_bits():
    r = np.random.RandomState(2)
    both = r.randint(-(2**62), 2**62, (400, 2))
    both = np.concatenate([both, both ^ 5]) * 2
    hi, lo = both[:, 0].copy(), both[:, 1].copy()
    assert {(min(p), max(p)) for p in neardup.trie_join(hi, lo, budget=6)} == {(k, k + 400) for k in range(400)}


def test_no_near_duplicate_at_the_threshold_is_lost(spark):
    # pairs at a similarity of exactly 0.6 and just above: 150 of 200 runs common, the others new
    texts = []
    for k in range(400):
        t = [f"w{k}x{i}" for i in range(202)]
        texts += [t, t[: 152 + k % 3] + [f"v{k}x{i}" for i in range(50 - k % 3)]]
    texts += [[*texts[0], "end"], texts[0]]
    df = spark.createDataFrame(rows(*((i, "a.example", "t", " ".join(t), None) for i, t in enumerate(texts))), PAGE_SCHEMA)
    got = {tuple(r) for r in neardup.NearDuplicates(df).pairs().collect()}
    sets = [frozenset(zip(t, t[1:], t[2:])) for t in texts]
    near = [(i, i + 1) for i in range(0, 800, 2)] + [(i, j) for i in (0, 1, 800, 801) for j in (800, 801) if i < j]
    want = {(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert len(want) >= 400 and got == want


@pytest.mark.parametrize("block,leaf", [(4096, 48), (7, 48), (7, 4), (4096, 4)])
def test_ranges_lose_no_pair(monkeypatch, block, leaf):
    # hot runs that all sets share, small sets, blocks of few sets and sub-tries of few: the pairs stay the brute-force ones
    monkeypatch.setattr(neardup, "LEAF", leaf)
    r = np.random.RandomState(9)
    sets = []
    for k in range(60):
        base = r.randint(0, 40, 12) if k % 3 else r.randint(0, 10**6, 30)
        sets.append(np.unique(base))
        sets.append(np.unique(np.r_[base[: len(base) * 4 // 5], r.randint(0, 10**6, 2)]))
    hashed = [neardup.mix(s.astype(np.uint64) * neardup.P1) for s in sets]
    rows = [(k, len(h), h.view(np.int64), neardup.signature(h)[0]) for k, h in enumerate(hashed)]
    b = pd.DataFrame(rows, columns=["whole", "n_runs", "runs", "bits"])
    count = np.bincount(np.concatenate([h & np.uint64(1023) for h in hashed]).astype(np.int64), minlength=1024).astype(np.int32)
    sent = neardup.first_runs(pd.concat([b, b[:9]]), count, 3, block)
    got = set()
    for _, part in sent.groupby("part"):
        got |= set(neardup.Range(iter([part[:40], part[40:]])).pairs().itertuples(index=False, name=None))
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(set(sets[i]) & set(sets[j])) >= 3 * len(set(sets[i]) | set(sets[j]))}
    assert want <= got and len(want) > 40 and all(a < b for a, b in got)
    assert neardup.Range(iter([])).pairs().empty


# ---------------------------------------------------------------- repeated lines


def test_repeated_lines(spark):
    pages = []
    for i in range(20):
        who = ("Ann Bee", "Cy Dow", "Eve Fox")[i % 3]
        md = f"{'**' if i % 2 else ''}Tell all  friends{'**' if i % 2 else ''}\nPosted 2024-01-{i + 1:02d} by {who}\nunique line number{'x' * i} here\n- [Go](/a{i})\nOnce"
        pages.append((i, "s.example", "t", md, None))
    pages += [(100 + i, "t.example", "t", "Only four times", None) for i in range(4)] + [(200, None, None, None, None), (201, "s.example", "t", "", None)]
    df = spark.createDataFrame(rows(*pages) + rows(*pages[:3]), PAGE_SCHEMA)
    assert {tuple(r) for r in repeats.repeated_lines(df).collect()} == {(i, n) for i in range(20) for n in (1, 2)}
    clean = {r["scrape_id"]: r for r in repeats.without_repeats(df).collect()}
    assert clean[3]["markdown"].startswith("unique line") and clean[200]["markdown"] is None and clean[3]["removed"] == 2


def test_dense_and_sparse_containers(spark, monkeypatch):
    monkeypatch.setattr(repeats, "DENSE", 3)
    df = spark.createDataFrame(rows(*((i * 40_000 if i % 2 else i, "s.example", "t", "same line here", None) for i in range(12))), PAGE_SCHEMA)
    assert repeats.repeated_lines(df).count() == 12


# ---------------------------------------------------------------- wrong encodings

CLEAN = {"de": "Die Straße führt über die Brücke zum schönen Gewächshaus, später kommt die Mühle. " * 40, "fr": "Le théâtre a été retrouvé près de la forêt où le câble paraît léger. " * 40, "ru": "После дождя мастер осмотрел старый колодец и записал результат работы. " * 40, "ja": "この図書館は古い橋の近くにある。" * 40}


def restorer():
    known = {w.lower() for t in CLEAN.values() for w in re.findall(r"[^\W\d_]+", t) if not w.isascii()}
    return garbled.Restorer(CLEAN, frozenset(known))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman"])
def test_utf8_read_wrongly_is_restored(wrong):
    r = restorer()
    text = "Die Straße führt über die Brücke"
    bad = text.encode().decode(wrong)
    assert r.text(f"A line\n{bad}\nend") == (True, f"A line\n{text}\nend")


def test_other_chains_and_clean_text():
    r = restorer()
    twice = "schönen Gewächshaus, später".encode().decode("cp1252").encode().decode("cp1252")
    assert r.text(twice) == (True, "schönen Gewächshaus, später")
    assert r.text("После дождя мастер осмотрел".encode("koi8-r").decode("cp1251"))[1] == "После дождя мастер осмотрел"
    assert r.text("une for�t") == (True, None)
    for good in ("Naïve or not, it’s a café now.", "12 € per m², 30 µl – “½ litre”…", "Die Straße führt", "После дождя мастер", "この図書館は古い橋", "", "a&b;"):
        assert r.text(good) == (False, None)


def test_batches_without_garbled_text(spark, monkeypatch):
    text = "Die Straße führt über die Brücke zum schönen Gewächshaus, später kommt die Mühle."
    bad = text.encode().decode("cp1252")
    monkeypatch.setattr(garbled, "samples", lambda *_: (CLEAN, frozenset()))
    schema = "src string, rec_id bigint, field string, text string"
    clean = spark.createDataFrame([("scrape_results", 1, "title", text)], schema).coalesce(1)
    assert garbled.restored(spark, "", clean).collect() == []
    assert garbled.restored(spark, "", clean.limit(0)).collect() == []
    mixed = clean.unionByName(spark.createDataFrame([("search_hits", 2, "snippet", bad), ("search_hits", 2, "snippet", bad), ("search_hits", 3, "snippet", "une for\ufffdt")], schema)).coalesce(1)
    assert sorted(map(tuple, garbled.restored(spark, "", mixed).collect())) == [("search_hits", 2, "snippet", text), ("search_hits", 3, "snippet", None)]


def test_words_by_their_hashes(spark):
    h = spark.createDataFrame([("straße",), ("был",)], "w string").select(F.xxhash64("w").alias("h")).toPandas()["h"].to_numpy()
    w = garbled.Words(h)
    assert "straße" in w and "был" in w and "brücke" not in w and "x" not in garbled.Words(h[:0])


def test_languages_count_over_all_pages(spark, tmp_path):
    n, ru = 8000, "После дождя мастер осмотрел старый колодец и записал результат работы."
    en = "The lamp was in the garden and it was old, so the mason took it to the house of the miller. " * 3
    ids = spark.range(n).withColumnRenamed("id", "scrape_id").withColumn("last", F.xxhash64("scrape_id") > F.lit(int((1 << 63) * 0.9)))
    pages = ids.select("scrape_id", F.when(F.col("last"), F.lit("\n".join([ru] * 4))).otherwise(F.lit(en)).alias("markdown"), F.lit("t").alias("title"))
    assert 100 < ids.filter("last").count() < 1000
    pages.write.parquet(f"{tmp_path}/scrape_results.parquet")
    bad = ru.encode().decode("cp1252", "replace")
    hits = [(1, "мастер записал результат".encode().decode("latin-1")), (2, "мастер записал результат"), (3, "мастер записал".encode("koi8-r").decode("cp1251")), (4, bad), (5, None)]
    spark.createDataFrame(hits, "hit_id bigint, snippet string").write.parquet(f"{tmp_path}/search_hits.parquet")
    common = [("en", w) for w in "the was in and it so to of".split()] + [("ru", w) for w in "и после в на".split()]
    spark.createDataFrame(common, "lang string, word string").write.parquet(f"{tmp_path}/common_words.parquet")
    texts, known, letters = garbled.samples(spark, str(tmp_path))
    assert set(texts) == {"en", "ru"} and texts["ru"].split()[-1] in ru and "колодец" in known and "ж" in letters
    assert all(len(x.encode()) <= garbled.DICT_BYTES for x in texts.values())
    got = {r["rec_id"]: r["restored"] for r in garbled.restored(spark, str(tmp_path)).collect()}
    assert got == {1: "мастер записал результат", 3: "мастер записал", 4: None}


def test_garbled_lines_and_long_strings_do_not_count(spark):
    common = {"en": set("the was in and it".split()), "ru": set("и на".split())}
    good = "The lamp was in the garden and it was a naïve one."
    lines = [good, "The lamp was in the garden and it was old.\u00d4\u00c7\u00aa", "The lamp was in the gдrden and it was an old one.", "The " + "x" * 40_000 + " was in the garden and it was old"]
    df = spark.createDataFrame([("\n".join(lines),)] * 3 + [(None,), ("",)], "markdown string")
    counts = garbled.counted(df, common)
    got = {(r["kind"], r["w"]): r["n"] for r in counts.collect()}
    assert got["known", "naïve"] == got["letter", "ï"] == 3 and got["part", "one."] == 3 and got["part", "garden"] == 6
    assert not any("\u00aa" in w or "д" in w for _, w in got)
    assert "garden" in garbled.frequent(counts, "en").split() and "xxx" not in garbled.frequent(counts, "en")


def test_ends_of_lines_weigh_as_much_as_middles():
    words = "whole family told that reed organ been wooden since spring lamp garden goat came with road take rack leave heat pump home water light stone bridge paper river letter music"
    assert garbled.Restorer({"en": words}).text("garden garden\u201a\u00c4\u00b6") == (True, "garden garden\u2026")


# ---------------------------------------------------------------- page rules


def judge(spark, bodies):
    common = {w: ("en",) for w in "the of and to a in is was that for it with on as at by".split()}
    names = pagestats.NAMES
    made = [pagestats.page(i, "s", t, f"https://s.example/{t}", [x for x in b.split("\n") if x.strip()], common) for i, (t, b) in enumerate(bodies)]
    df = quality.judged(spark.createDataFrame(made, pagestats.COLUMNS))
    assert len(made[0]) == len(names)
    return {r["scrape_id"]: r for r in df.select("scrape_id", spam.is_spam().alias("spam"), residue.is_residue().alias("res"), F.arrays_overlap(quality.reasons(), F.array(*map(F.lit, quality.NOT_PROSE))).alias("lst")).collect()}


def test_page_rules(spark):
    prose = "The lamp was in the garden and it was old. " * 12
    items = "\n".join(f"- item{i} thing{i * 7}" for i in range(12))
    bodies = [
        ("Garden", prose),
        ("List", items),
        ("Stuffed", "cheap lamp, best lamp, buy lamp, lamp sale, top lamp, lamp online\n" * 12),
        ("Links", "\n".join(f"[Place {i}](https://x{i}.example/)" for i in range(9))),
        ("Explained", "\n".join(f"- [Place {i}](https://x{i}.example/): It is a place with a garden number {i}." for i in range(9))),
        ("Lamp", "Please turn on JavaScript to view this page."),
        ("Template", prose + "\nHello {{ name }}, welcome."),
        ("Code", prose + "\n```\n{{ name }}\n```"),
        ("Article", prose + "\nMany pages say that JavaScript is needed to view them, which the lamp was not."),
        ("Tags", "#lamp #garden #tool #lamp #house #lamp #tree"),
        ("Note", "The lamp was mended in the end."),
    ]
    got = judge(spark, bodies)
    assert [i for i in got if got[i]["spam"]] == [2, 3, 9]
    assert [i for i in got if got[i]["res"]] == [5, 6]
    assert not got[0]["lst"] and got[1]["lst"] and not got[4]["lst"] and not got[10]["lst"]


def test_evidence_and_redundancy_decide(spark):
    common = {w: ("en",) for w in "the of and to a in is was that for it with on as at by".split()}
    told = "Your session has ended. Sign in once more at {}"
    rows = [pagestats.page(i, f"h{i % 3}", f"Title{i} number{i}", f"https://h{i % 3}.example/title{i}", [told.format(f"desk{i}")], common) for i in range(6)]
    rows.append(pagestats.page(7, "h1", "Lone", "https://h1.example/lone", ["A word that no other page was answered with."], common))
    rows.append(pagestats.page(8, "h1", "Session desk", "https://h1.example/session", [told.format("desk9")], common))
    links = [f"[Place {i}](https://x{i}.example/)" for i in range(9)]
    rows.append(pagestats.page(9, "h2", "Links", "https://h2.example/l", links, common))
    rows.append(pagestats.page(10, "h2", "Stuffed", "https://h2.example/s", ["cheap lamp, best lamp, buy lamp, lamp sale, top lamp, lamp online"] * 12, common))
    df = quality.judged(spark.createDataFrame(rows, pagestats.COLUMNS))
    found = lambda d, rule: sorted(r[0] for r in d.filter(rule).select("scrape_id").collect())
    assert found(df, residue.is_residue()) == list(range(6))
    assert found(df.withColumn("responses", F.lit(0)), residue.is_residue()) == []
    assert found(df, spam.is_spam()) == [9, 10]
    assert found(df.withColumn("packed", F.col("expected")), spam.is_spam()) == [9]
    assert found(df.withColumn("form", F.col("expected_form")), spam.is_spam()) == [10]


def test_published_rules_choose(spark):
    got = judge(spark, [("Rows", "\n".join(f"name{i} | {i * 7} | place{i}" for i in range(9)))])
    assert got[0]["lst"]
    # without the rules on line ends and entries nothing is found
    assert set(quality.NOT_PROSE) & {"line_ends", "short_lines"} and "few_words" not in quality.NOT_PROSE


def test_copies_of_spam_do_not_set_what_spam_is_measured_by(spark):
    rnd = random.Random(7)
    words = "stone river garden lamp winter letter travel music window paper bridge forest market silver cotton".split()
    prose = [("Story", "\n".join(" ".join(rnd.choice(words) for _ in range(8)).capitalize() + "." for _ in range(16))) for _ in range(25)]
    spam_page = ("Stuffed", "cheap lamp, best lamp, buy lamp, lamp sale, top lamp, lamp online\n" * 13)
    got = judge(spark, prose + [spam_page] * 40)
    assert [i for i in got if got[i]["spam"]] == list(range(25, 65))


# ---------------------------------------------------------------- tokens, packing, splitting

DOC_SCHEMA = "doc_id bigint, text string, w string"
TEXTS = ["", None, "Hello world's  <|endoftext|>\n\n x", "図書館は古い橋。" * 5, "acgt" * 400, "  \n\t ", "naïve café 12345 !!!", "word " * 2000]


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100")
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], DOC_SCHEMA)


def test_ids_are_the_library_ones(docs):
    enc = tokens.library(tokens.load_ranks(tokens.vocabulary_path()))
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encoded(docs).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert all(r["same"] for r in tokens.round_trip(docs).collect())


def test_hilbert_curve_visits_neighbours():
    n = 8
    x, y, z = (v.ravel() for v in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    order = np.argsort(packing.hilbert(x, y, z, bits=3))
    step = np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) + np.abs(np.diff(z[order]))
    assert (step == 1).all()


def test_packer_keeps_items_whole():
    p = packing.Packer(100, 0)
    rnd = random.Random(2)
    sizes = [rnd.randint(0, 60) for _ in range(500)] + [100, 250]
    out = [r for i, s in enumerate(sizes) for r in p.put(i, s)]
    used, parts = {}, {}
    for box, doc, _, size in out:
        used[box] = used.get(box, 0) + size
        parts[doc] = parts.get(doc, 0) + 1
    assert max(used.values()) <= 100 and sum(used.values()) == sum(sizes)
    assert all(n == 1 for d, n in parts.items() if sizes[d] <= 100) and parts[501] == 3


PIECE_TEXTS = ["One two three. " * 400 + "x" * 300 + "\n\n" + "Four five six seven. " * 100, "acgtgcta" * 900, "図書館は古い橋の近くにある。" * 60 + "naïve " * 300, "word " * 900]


@pytest.mark.parametrize("text", PIECE_TEXTS)
def test_pieces_cover_and_overlap(text):
    enc = tokens.library(tokens.load_ranks(tokens.vocabulary_path()))
    parts = enc.decode_tokens_bytes(enc.encode_ordinary(text))
    sizes = np.array([len(x) for x in parts])
    got = list(splitting.pieces(text, sizes, [(1, 128, 16), (2, 10**6, 0)]))
    assert {g[0] for g in got} == {1} and got[0][2] == 0 and got[-1][3] == len(sizes)
    for a, b in zip(got, got[1:]):
        assert b[2] == a[3] - 16
    for g in got:
        assert 0 < g[3] - g[2] <= 128 and g[5] == b"".join(parts[g[2] : g[3]]).decode("utf-8", "ignore")
    assert list(splitting.pieces("", np.array([], int), [(1, 128, 16)])) == []


def test_pieces_cost_the_least():
    # brute force over all ways to cut at the candidates
    text = "A first part here. And a second one, longer than it was.\n\nThird words come now. " * 3
    enc = tokens.library(tokens.load_ranks(tokens.vocabulary_path()))
    whole = splitting.Text(text, np.array([len(x) for x in enc.decode_tokens_bytes(enc.encode_ordinary(text))]))
    capacity, overlap = 30, 4
    pos, kind = splitting.candidates(whole, *whole.boundaries(), capacity - overlap)
    room = capacity - overlap
    even = (whole.total - overlap) / -(-(whole.total - overlap) // room) / room
    pay = [*splitting.PENALTY[kind[:-1]], 0.0]

    def cost(way):
        out, at = 0.0, 0
        for no, j in enumerate(way):
            size = (pos[j] - at if no else pos[j] - overlap) / room if (no or pos[j] > room) else pos[j] / room
            if pos[j] - at > (room if no else capacity):
                return float("inf")
            dev = min((pos[j] / room - even) ** 2, ((pos[j] - overlap) / room - even) ** 2) if not no and pos[j] <= room else (size - even) ** 2
            out += splitting.UNEVEN * dev + pay[j] + splitting.PIECE
            at = pos[j]
        return out

    last = len(pos) - 1
    inner = range(1, last)
    best = min(cost((*w, last)) for n in range(0, 7) for w in itertools.combinations(inner, n))
    assert abs(cost(splitting.cuts(pos, kind, capacity, overlap)) - best) < 1e-9


def test_statistics_run_on_the_tables(spark, sf):
    s = quality.quality_stats(spark, sf)
    assert s.count() == s.select("scrape_id").distinct().count() > 0
    assert s.filter(F.col("mean_word") < 0).count() == 0
