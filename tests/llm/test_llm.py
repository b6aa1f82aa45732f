"""Operators of the llm subpackage on small tables with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import content, encoding, features, lang_id, linecode, mixing, packing, rank_flow, site_lines, value_map
from quern.llm.languages import declared
from quern.llm.linecode import Lines, mix

PAGE = "page_id long, url string, title string, body_text string, links array<struct<url:string,text:string>>, lang string, crawled_at_unix long, status int, skey string, line_no string"
PLACES = ["Alder", "Birch", "Cedar", "Doveton", "Elmstead", "Fernley", "Garth", "Holt", "Ives", "Jarrow", "Kelso", "Luton"]
EN = [
    "The old bridge near {p} reopened on Monday after {n} weeks of repair and the residents said that the work had cost less than planned.",
    "If you arrive by train, walk past the town hall in {p} and turn left before you reach the market, where {n} stalls are open until the evening.",
    "Nobody in {p} remembers when the water tank was built, but most of the {n} people who live there think it is older than the school.",
    "Parents in {p} complained that the school has no library, although the council had promised one {n} years ago for all of the children.",
]
FR = [
    "Le vieux pont près de {p} a rouvert lundi après {n} semaines de travaux et les habitants disent que cela a coûté moins cher que prévu.",
    "Si vous arrivez par le train, passez la mairie de {p} puis tournez à gauche avant le marché, où {n} marchands sont ouverts jusque dans la soirée.",
    "Personne à {p} ne se souvient quand le château d'eau a été construit, mais la plupart des {n} personnes qui y vivent le croient plus ancien que l'école.",
]


def article(rnd, sentences, n=5):
    return [" ".join(rnd.choice(sentences).format(p=rnd.choice(PLACES), n=rnd.randint(2, 99)) for _ in range(2)) for _ in range(n)]


def corpus():
    """Pages of some sites: articles with furniture, one mixed page, one keyword page, and odd rows."""
    rnd = random.Random(5)
    rows, content_lines, k = [], set(), 0
    for s in range(5):
        sents = FR if s == 4 else EN
        for i in range(14):
            k += 1
            head = f"How {rnd.choice(PLACES)} got its number {k} bridge, by {rnd.choice(PLACES)}"
            body = article(rnd, sents) + ([FR[0].format(p="Holt", n=k) + " " + FR[1].format(p="Ives", n=k)] if (s, i) == (0, 3) else [])
            rows_ = ["Home · News · Food", head, "By the desk of Site Name%d Times" % s, *body[:2], f"- Stall {''.join(rnd.choice('BDGKLMNPRST') + rnd.choice('aeiou') for _ in range(4))}: ₹{rnd.randint(10, 99)}", *body[2:], "Also read", f"How {rnd.choice(PLACES)} got a drain, by {rnd.choice(PLACES)}", f"© 2025 Name{'abcde'[s]} Times. All rights reserved."]
            content_lines |= {(k, 2), *((k, n) for n in range(4, 4 + len(body) + 1))}
            lang = "fr" if s == 4 else "en"
            rows.append((k, f"https://www.site{s}.example/p/{k}", head, "\n".join(rows_), [], lang, 1, 200, "x", "y"))
    spam = "\n".join(f"#cheap {a} loan" for a in PLACES * 3)
    rows.append((900, "https://site1.example/spam", "cheap loan", spam, None, "en", 1, 200, None, None))
    rows += [(901, "https://site1.example/e", None, None, None, None, 1, 200, None, None), (902, None, "t", " \n\t", None, "en", 1, 200, None, None), (903, "https://site1.example/x", "t", rows[0][3], None, "en", 1, 404, None, None), (None, "https://site1.example/y", "t", "text", None, "en", 1, 200, None, None)]
    return rows, content_lines


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(corpus()[0], PAGE)


def test_line_hashes():
    a, b = Lines(["Ab c\n\nab-C 1", "x"]), Lines(["x\nABC"])
    ha, na = a.letters()
    hb, _ = b.letters()
    assert a.line_no.tolist() == [1, 2, 3, 1] and na.tolist() == [3, 0, 3, 1]
    assert ha[0] == ha[2] == hb[1] and ha[3] == hb[0] and ha[1] == 0
    assert Lines([""]).n == 1 and Lines(["😀 ok"]).letters()[1].tolist() == [2]


@pytest.mark.parametrize("ahead", [4, 1 << 20])
def test_lines_against_brute_force(monkeypatch, ahead):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aBé1٣கाZz’'-– .:😀\n\r") for _ in range(rnd.randrange(0, 90))) for _ in range(60)] + ["", "\n", " \n a", "x" * 500 + "-y"]
    split = [x.replace("\r", " ") for t in texts for x in t.split("\n")]
    mixed, tables = [], linecode.tables()
    monkeypatch.setattr(linecode, "AHEAD", ahead, raising=False)
    mix_codes = linecode.mix_codes
    monkeypatch.setattr(linecode, "mix_codes", lambda codes: (mixed.append(len(codes)), mix_codes(codes))[1])
    lines = Lines(texts)
    at = features.first_separator(lines)
    (letters, count), before, w = lines.letters(), lines.letters_before(at), lines.words()
    # the characters are mixed once, not again for each kind of hash
    assert len(mixed) == 1 and lines.n == len(split)

    def whole(s):
        codes = mix_codes(np.array([ord(c.lower()) for c in s], np.uint32)).tolist()
        total = sum(c * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(codes)) % (1 << 64)
        return int(mix(np.array([total], np.uint64))[0]) | 1 if s else 0

    is_a = lambda c, kind: bool(tables[kind][min(ord(c), 0xFFFF)])
    told = lambda s: "".join(c for c in s if is_a(c, "letter"))
    words = []
    for k, s in enumerate(split):
        trimmed = s.strip()
        assert (letters[k], count[k], lines.inked[k], lines.length[k]) == (whole(told(s)), len(told(s)), sum(not c.isspace() for c in s), len(trimmed) if trimmed else 0)
        assert before[k] == (whole(told(s[: at[k] - lines.start[k]])) if at[k] >= 0 else 0)
        if trimmed:
            assert (lines.first[k], lines.last[k]) == (lines.start[k] + s.index(trimmed), lines.start[k] + s.index(trimmed) + len(trimmed) - 1)
        words += [(k, x) for x in "".join(c if is_a(c, "word") else " " for c in s).split()]
    assert w["line"].tolist() == [k for k, _ in words] and w["hash"].tolist() == [whole(x) for _, x in words]
    some = lambda x, kind: any(is_a(c, kind) for c in x)
    assert w["number"].tolist() == [all(is_a(c, "digit") for c in x) for _, x in words] and w["other"].tolist() == [some(x, "other") for _, x in words]
    assert w["capital"].tolist() == [is_a(x[0], "upper") and some(x, "small") for _, x in words] and w["lead_upper"].tolist() == [is_a(x[0], "upper") for _, x in words]


def test_shingles_of_few_words():
    for text, n in (("", 0), ("one", 1), ("one two", 1), ("one two\nthree", 2)):
        assert len(Lines([text]).shingles()[0]) == n


def test_p5_against_brute_force(spark, pages):
    got = {(r.page_id, r.line_no) for r in site_lines.repeated_lines(pages).collect()}
    addresses, lines = {}, []
    for p in corpus()[0]:
        if p[0] is None or p[7] != 200 or not p[3] or not p[1]:
            continue
        site = p[1].split("/")[2].replace("www.", "")
        for n, line in enumerate(p[3].split("\n"), 1):
            if w := "".join(c for c in line.lower() if c.isalpha()):
                addresses.setdefault((site, w), set()).add(p[1])
                lines.append((p[0], n, site, w))
    assert got == {(i, n) for i, n, s, w in lines if len(addresses[s, w]) >= 6}
    clean = {r.page_id: r for r in site_lines.without_repeated(pages, spark.createDataFrame(list(got), "page_id long, line_no int")).collect()}
    assert clean[901].removed == 0 and "Home" not in clean[1].clean_text
    assert site_lines.repeated_lines(pages.limit(0)).count() == 0


def test_p5_found_needs_no_clusters(spark, pages, monkeypatch):
    keyed = site_lines.keyed_lines(pages).cache()
    found = site_lines.repeated_clusters(pages, keyed).where("df >= 6")
    want = {(r.page_id, r.line_no) for r in keyed.join(found, ["skey", "wkey"]).collect()}

    def none(*_):
        raise AssertionError

    monkeypatch.setattr(site_lines, "similar_forms", none)
    assert want and {(r.page_id, r.line_no) for r in site_lines.repeated_lines(pages).collect()} == want


def test_p5_clusters_count_addresses(spark):
    lone = "\n".join(f"Bus 45 leaves {a} at 10:32 and reaches the harbour before noon" for a in PLACES)
    spread = [f"Seen by {a} today, who keeps the harbour and the market" for a in PLACES[:6]]
    rows = [(k, f"https://site.example/p/{k}", "t", spread[k] + ("\n" + lone if k < 2 else ""), None, "en", 1, 200, None, None) for k in range(6)]
    table = spark.createDataFrame(rows, PAGE)
    got = {(r.page_id, r.line_no) for r in site_lines.repeated_lines(table, exact=False).collect()}
    # twelve alike lines of two pages stand on two addresses; six wordings of six pages on six
    assert {(k, 1) for k in range(6)} <= got and not {(k, n) for k in range(2) for n in range(2, 14)} & got
    assert site_lines.repeated_lines(table).count() == 0


def test_p5_links_against_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(400)]
    kinds = [[rnd.choice(words) for _ in range(rnd.randint(30, 60))] for _ in range(25)]

    def variant(line):  # one or two words changed near the end, where fewer shingles hold them
        line = list(line)
        for _ in range(rnd.randint(0, 2)):
            line[-rnd.randint(1, 6)] = rnd.choice(words)
        return " ".join(line)

    lines = sorted({variant(rnd.choice(kinds)) for _ in range(400)})
    rows = [(i, f"https://site{i % 2}.example/{i}", "t", line, None, "en", 1, 200, None, None) for i, line in enumerate(lines)]
    pages = spark.createDataFrame(rows, PAGE)
    keyed = site_lines.keyed_lines(pages).cache()
    key = {r.page_id: (r.skey, r.mkey) for r in keyed.collect()}
    shingles = {i: {tuple(line.split()[j : j + 5]) for j in range(len(line.split()) - 4)} for i, line in enumerate(lines)}
    pairs = [(i, j) for i in key for j in key if i < j and i % 2 == j % 2 and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    forms = keyed.where("bands IS NOT NULL").select("skey", "mkey", F.xxhash64("skey", "mkey").alias("node"), "bands")
    node = {(r.skey, r.mkey): r.node for r in forms.collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[root(i)] = root(j)
    for crowded in (256, 4):
        monkeypatch.setattr(site_lines, "CROWDED", crowded)
        label = {r.node: r.root for r in site_lines.connected(site_lines.similar_forms(pages, keyed, forms)).collect()}
        of = lambda i: label.get(node[key[i]], node[key[i]])  # noqa: B023, E731
        assert np.mean([of(i) == of(j) for i, j in pairs]) >= 0.97, crowded
        # nothing is joined that brute force leaves apart
        assert len({of(i) for i in key}) >= len({root(i) for i in key})


def test_p5_links_are_all_pairs_of_the_threshold(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(300)]
    lines = []
    for _ in range(150):  # the last of 13 words differs: 8 of 10 shingles in common, 4/5 exactly
        stem = [rnd.choice(words) for _ in range(12)]
        lines += [" ".join([*stem, end]) for end in rnd.sample(words, 2)]
        lines.append(" ".join([*stem[:11], "x", "y"]))
    for _ in range(40):  # many variants of one line, which all hold its shingles
        lines.append(" ".join([f"w{chr(97 + i)}" for i in range(20)] + rnd.sample(words, rnd.randint(1, 3))))
    lines = sorted(set(lines))
    pages = spark.createDataFrame([(i, f"https://site{i % 2}.example/{i}", "t", line, None, "en", 1, 200, None, None) for i, line in enumerate(lines)], PAGE)
    keyed = site_lines.keyed_lines(pages).cache()
    forms = keyed.where("bands IS NOT NULL").select("skey", "mkey", F.xxhash64("skey", "mkey").alias("node"), "bands")
    ids = {r.node: r.page_id for r in keyed.select("page_id", F.xxhash64("skey", "mkey").alias("node")).collect()}
    shingles = [{tuple(line.split()[j : j + 5]) for j in range(len(line.split()) - 4)} for line in lines]
    want = {(i, j) for i in range(len(lines)) for j in range(i + 2, len(lines), 2) if 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])}
    assert len(want) > 100
    for crowded in (256, 4):
        monkeypatch.setattr(site_lines, "CROWDED", crowded)
        got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in site_lines.similar_forms(pages, keyed, forms).collect()}
        assert got == want, crowded


def test_connected_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(50)], "a long, b long")
    got = {r.node: r.root for r in site_lines.connected(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[2000 + i] for i in range(50)} == {1000}
    assert site_lines.connected(edges.limit(0)).count() == 0


def test_p4_and_p7(spark, pages):
    want = corpus()[1]
    assert [r.page_id for r in content.keyword_pages(pages).collect()] == [900]
    got = {(r.page_id, r.line_no) for r in content.furniture_lines(pages).collect()}
    every = {(p[0], n) for p in corpus()[0] if p[0] and p[0] < 900 for n, line in enumerate(p[3].split("\n"), 1) if line.strip()}
    missed, extra = (every - want) - got, got - (every - want)
    assert len(missed) <= 0.02 * len(every) and len(extra) <= 0.02 * len(every), (sorted(missed)[:5], sorted(extra)[:5])
    assert content.keyword_pages(pages.limit(0)).count() == 0 and content.furniture_lines(pages.limit(0)).count() == 0


def test_page_statistics_do_not_depend_on_the_split(spark, pages, monkeypatch):
    want = None
    for parts in (1, 12):
        split = pages.repartition(parts)
        sites, wordings, openings, words = features.first_pass(split)
        got = [sorted(map(tuple, t.collect()), key=repr) for t in (sites, wordings, openings, words)]
        got.append(sorted((r.page_id, r.line_no) for r in content.furniture_lines(split).collect()))
        want = want or got
        assert got == want
    # few rows and bytes are enough to join by shuffling, in parts
    for module, name in ((content, "MAX_ROWS"), (content, "MAX_BYTES"), (content, "PART_PAGES"), (features, "HELD")):
        monkeypatch.setattr(module, name, 10)
    assert sorted((r.page_id, r.line_no) for r in content.furniture_lines(pages).collect()) == want[-1]
    assert [r.page_id for r in content.keyword_pages(pages).collect()] == [900]


def test_word_counts_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(k, f"https://s{k % 3}.example/{k}", "Title of it", "\n".join(" ".join(rnd.choice(["the", "of", "mill", "Road", "7"]) for _ in range(30)) + "." for _ in range(3)) + "\nshort the", None, rnd.choice(["en", "fr"]), 1, 200, None, None) for k in range(40)]
    *_, words = features.first_pass(spark.createDataFrame(rows, PAGE))
    got = sorted((r.lang, r.n, r.places) for r in words.collect())
    want = []
    for k, code in ((0, "en"), (4, "fr")):
        texts = [[w for line in r[3].split("\n")[:3] for w in line.lower().strip(".").split() if w != "7"] for r in rows if r[5] == code]
        want.append((k, len(texts), sum(map(len, texts))))
        for w in ("the", "of", "mill", "road"):
            want.append((k, len(texts) if w == "of" else sum(w in t for t in texts), sum(t.count(w) for t in texts)))
        want += [(k, len(texts), 0)] * 2  # title and it
    assert got == sorted(want)


def test_p7_each_measure(spark):
    columns = ["top", "paired", "again", "listed", "linked", "bare"]
    rnd = random.Random(3)
    some = lambda: "".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(3))
    line = lambda: f"The {some()} of the {some()} was {some()} and the {some()} had {some()} in {some()} for {some()} and the {some()} of {some()}."
    bodies = {k: [line() for _ in range(6)] for k in range(1, 40)}
    bodies[101] = [f"The loan of the {some()} was loan and the loan had loan in {some()} for loan and the loan of {some()}." for _ in range(8)]
    bodies[102] = [f"The {some()} {some()} of the cheap shoe {some()} and the old lamp {some()} in the cheap shoe {some()} for the old lamp {some()} of it." for _ in range(8)]
    bodies[103] = ["Call the shop in the market for the offer of the week and the gift of the season in the hall of the town."] * 8
    bodies[104] = [f"The {some()}, {some()}, {some()}, the {some()}, {some()}, {some()}, of {some()}, {some()}, in {some()}, {some()}, {some()}, the {some()}." for _ in range(8)]
    bodies[105] = [f"The {some()} of the {some()} in the {some()} of {some()}" for _ in range(8)]
    bodies[106] = [" ".join(some() for _ in range(20)) for _ in range(8)]
    rows = [(k, f"https://www.site{k % 7}.example/p/{k}", "t", "\n".join(b), [("u", x) for x in b] if k == 105 else [], "en", 1, 200, None, None) for k, b in bodies.items()]
    got = {r.page_id: r for r in content.page_measures(spark.createDataFrame(rows, PAGE)).collect()}
    for k, m in enumerate(columns, 101):
        usual = max(got[i][f"{m}_share"] for i in range(1, 40))
        assert got[k][f"{m}_share"] > usual + 0.2, (m, got[k])
        assert m == "bare" or got[k][f"{m}_share"] > got[k][f"{m}_limit"], (m, got[k])
    assert all(not got[i].spam for i in range(1, 40)) and {k for k in got if got[k].spam} >= {101, 103, 104, 106}


def test_p7_stuffed_sentences(spark):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    some = lambda: rnd.choice(vocabulary)
    line = lambda: f"The {some()} of the {some()} was {some()} and the {some()} had {some()} in {some()} for {some()} and the {some()} of {some()}."
    bodies = {k: [f"How {some()} {some()} {some()} {some()}", *(line() for _ in range(6))] for k in range(1, 81)}
    for k, body in bodies.items():  # articles end with a few links
        body += [f"{some()} {some()} {some()}"] * (k % 3 == 0)
    bodies[900] = [f"The cheap loan for the {some()} and the cheap loan in the {some()} was the cheap loan of the {some()}." for _ in range(12)]
    bodies[901] = ["Call the shop in the market for the offer of the week and the gift of the season in the hall of the town."] * 15
    bodies[902] = [f"The {some()} of the {some()} in the {some()}." for _ in range(20)]
    bodies[903] = [f"The {some()}, {some()}, {some()}, {some()}, {some()}, the {some()}, {some()}, {some()} and {some()}, {some()}, {some()}, the {some()} of {some()}." for _ in range(8)]
    song = some()
    bodies[904] = [f"Oh the road to {song}, the long road to {some()}, it bends like the river at {some()} and the {some()} of the {some()} had {some()} in {some()} for {some()}." for _ in range(12)]
    rows = [(k, f"https://www.site{k % 7}.example/p/{k}", body[0], "\n".join(body), [("u", x) for x in body] if k == 902 else [], "en", 1, 200, None, None) for k, body in bodies.items()]
    assert sorted(r.page_id for r in content.keyword_pages(spark.createDataFrame(rows, PAGE)).collect()) == [900, 901, 902, 903]


def test_p2(spark, pages):
    wrong = pages.withColumn("lang", F.when(F.col("page_id") == 7, F.lit(None).cast("string")).when(F.col("page_id") == 8, "English").when(F.col("page_id") == 9, "fra").otherwise(F.col("lang")))
    got = {(r.page_id, r.lang) for r in lang_id.wrong_labels(wrong).collect()}
    assert got == {(4, "en"), (4, "fr"), (7, "en"), (9, "en")}
    seg = [(r.lang, r.confidence) for r in lang_id.page_segments(wrong).where("page_id = 4").orderBy("segment").collect()]
    assert [s[0] for s in seg] == ["en", "fr"] and all(0 < s[1] <= 1 for s in seg)
    assert lang_id.wrong_labels(wrong.limit(0)).count() == 0
    extra = [(950, "https://site2.example/short", "t", "le pont près de la mairie\nles habitants de la ville", None, None, 1, 200, None, None), (951, "https://site2.example/n", "t", "12 34\n\n7", None, "en", 1, 200, None, None)]
    every = {}
    for r in lang_id.page_labels(wrong.union(spark.createDataFrame(extra, PAGE))).collect():
        every.setdefault(r.page_id, []).append((r.lang, r.basis, r.confidence))
    assert set(every) == {p[0] for p in corpus()[0] if p[0] and p[7] == 200} | {950, 951}
    assert sorted(x[:2] for x in every[4]) == [("en", "paragraphs"), ("fr", "paragraphs")]
    assert [x[:2] for x in every[950]] == [("fr", "lines")] and every[951] == every[901] == every[902] == [(None, "none", None)]
    assert every[900][0][1] == "lines" and every[900][0][0] is not None


def test_p2_trigrams_against_brute_force(monkeypatch):
    rnd = random.Random(4)
    alphabet = "abcdeéßकखगாம’"
    texts = ["\n".join(" ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(0, 40))) for _ in range(5)) for _ in range(30)]
    texts += ["", "a", "Name 12 of it Name", "x" * 3000]
    lines, split = Lines(texts), [x for t in texts for x in t.split("\n")]
    whole = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    ranked = []
    for x in split:
        told = "".join(" " + w for w in re.findall(r"[\w’\u0bbe]+", x) if not w.isdigit() and not w[0].isupper())
        n = Counter(told[i : i + 3] for i in range(len(told) - 2) if told[i + 1] != " ")
        key = dict(zip(n, mix(np.array([whole(g) for g in n], np.uint64)).tolist(), strict=True))
        ranked.append([whole(g) for g in sorted(n, key=lambda g: (-n[g], key[g]))][: lang_id.PROFILE])
    profiles = {k: np.array(ranked[k], np.uint64) for k in (0, 7, 11)}
    assert all(map(len, profiles.values()))
    known = lang_id.Profiles(profiles)
    # trigrams are put in order by whole numbers, not by several sorts
    with monkeypatch.context() as m:
        m.setattr(np, "lexsort", lambda *a, **k: pytest.fail("sorted by several keys"))
        of, gram, rank = lang_id.trigrams(lines, np.ones(lines.n, bool))
        best, sure = known.place(of, gram, rank, lines.n)
    assert [gram[of == k].tolist() for k in range(lines.n)] == ranked and all((rank[of == k] == np.arange(len(r))).all() for k, r in enumerate(ranked))
    for k, r in enumerate(ranked):
        far = {c: sum(abs(p.tolist().index(g) - i) if g in p else lang_id.PROFILE for i, g in enumerate(r)) / (len(r) * lang_id.PROFILE) for c, p in profiles.items()} if r else {}
        d = sorted(far.values())
        assert (best[k], sure[k]) == ((min(far, key=far.get), (d[1] - d[0]) / max(d[1], 1e-9)) if r else (-1, 0))
    # numbers too large for one sort, and equal keys
    of, count, tie = np.array([0, 1, 1, 1]) << 45, np.array([3, 1, 1, 2]), np.array([5, 9, 8, 7], np.uint64)
    assert lang_id._by_count(of, count, tie).tolist() == lang_id._by_count(of >> 45, count, tie).tolist() == [0, 3, 2, 1]


def test_declared(spark):
    rows = [("en-IN",), ("Hindi",), ("en, ta",), ("x-default",), (None,), ("",), ("deu",), ("klingon",), ("EN;en_GB",)]
    got = [r[0] for r in spark.createDataFrame(rows, "lang string").select(declared(F.col("lang"))).collect()]
    assert got == [["en"], ["hi"], ["en", "ta"], [], [], [], ["de"], ["?"], ["en"]]


def test_p10_round_trip(spark, monkeypatch):
    texts = ["Une journée à l’été dernier, déjà près du marché à côté.", "पुराने पुल की मरम्मत 7 हफ्ते चली", "“We did not expect so many,” she said for ₹50", "São João não está à venda, você é", "Łódź, Ταβέρνα, Кафе, ½ kg at 24 °C 🙂", "plain text"]
    clean = [t + f" {i}" for i in range(30) for t in texts]
    bad = [(1000, texts[0].encode().decode("latin-1"), texts[0]), (1001, texts[1].encode().decode("latin-1"), texts[1]), (1002, texts[2].encode().decode("mac_roman"), texts[2]), (1003, texts[3].encode().decode("cp437"), texts[3]), (1004, "It isn�t open", None), (1005, texts[3].encode().decode("latin-1").encode().decode("latin-1"), texts[3])]
    rows = [(i, t, "x") for i, t in enumerate(clean)] + [(i, t, "x") for i, t, _ in bad] + [(2000, None, None), (2001, " ", None), (None, bad[0][1], None), (2002, "a" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {r.doc_id: r.restored for r in encoding.garbled_documents(df).collect()}
    assert set(got) == {i for i, *_ in bad}
    assert all(got[i] == t for i, _, t in bad if t)
    assert encoding.garbled_documents(df.limit(0)).count() == 0
    monkeypatch.setattr(encoding, "MAX_PAIRS", 10)  # the table of pairs as a file
    assert {r.doc_id: r.restored for r in encoding.garbled_documents(df).collect()} == got


def test_p10_restores_known_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    suspect = {r.doc_id for r in encoding.garbled_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    clean = [(r.doc_id, r.text) for r in docs if r.doc_id not in suspect and not r.text.isascii()]
    bad, n = {}, 0
    for page in ("cp1252", "latin-1", "mac_roman", "cp437"):
        for k, text in clean:
            try:
                garbled = text.encode().decode(page)
            except UnicodeDecodeError:
                continue
            n += 1
            bad[1_000_000 + n] = (garbled, text)
    rows = [(r.doc_id, r.text) for r in docs] + [(k, g) for k, (g, _) in bad.items()]
    got = {r.doc_id: r.restored for r in encoding.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(bad) > 40 and np.mean([k in got for k in bad]) > 0.97
    assert np.mean([got.get(k) == t for k, (_, t) in bad.items()]) > 0.9
    assert not {k for k, _ in clean} & set(got)


def test_p6(spark):
    ref = spark.createDataFrame([(1, "Tavrika Tea Room", "cafe", []), (2, "Tavrika Fuels", "fuel", ["TAVF"]), (3, "Quenlis Pharmacy", "pharmacy", None), (4, "Ostra & Zorvan Textiles", "clothes", ["ज़ोरवानि"])], "brand_id int, brand_name string, brand_category string, aliases array<string>")
    rows = [
        ("a", "tavrika  TEA room", None, "cafe"), ("b", "Tavr1ka Tea Rom", None, "cafe"), ("c", "Tea Room Tavrika", None, "x"), ("d", "The Quenlis Pharmacy Store; Nobody Cafe", None, "x"), ("e", "Tavrika", None, "fuel"),
        ("f", "Tavrika Motors", None, "x"), ("g", "n/a", "Quenlís Pharmacy, Holt", "x"), ("h", None, "Nobody Cafe", "x"), ("i", "Ostra and Zorvan", None, None), ("j", "Textiles", None, "x"), ("k", "tavf", None, "x"), ("l", "", None, None), ("a", "tavrika  TEA room", None, "cafe"),
        ("m", "ज़ोरवानि", None, "x"), (None, "Tavrika Fuels", None, "fuel"),
    ]
    poi = spark.createDataFrame(rows, "id string, brand string, name string, category string")
    got = sorted((r.id, r.brand_id) for r in value_map.poi_brands(poi, ref).collect())
    assert got == [("a", 1), ("b", 1), ("c", 1), ("d", -1), ("d", 3), ("e", 2), ("f", -1), ("g", 3), ("i", 4), ("j", -1), ("k", 2), ("m", 4)]
    assert value_map.poi_brands(poi.limit(0), ref).count() == 0
    assert {r.brand_id for r in value_map.poi_brands(poi, ref.limit(0)).collect()} == {-1}


def test_p6_pigeonhole_misses_nothing(spark):
    rnd = random.Random(3)
    forms = ["".join(rnd.choice("abcdeg") for _ in range(rnd.randint(6, 14))) for _ in range(12)]
    ref = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, n string")

    def typo(s):
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(s))
            s = rnd.choice([s[:at] + s[at + 1 :], s[:at] + rnd.choice("abcdeg") + s[at:], s[:at] + rnd.choice("abcdeg") + s[at + 1 :]])
        return s

    words = sorted({typo(rnd.choice(forms)) for _ in range(300)})
    vals = spark.createDataFrame([(w,) for w in words], "value string")
    got = {(r.value, r.ref_id) for r in value_map.matched_parts(vals, ref, "i", "n").where("kind = 0").collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    want = {(w, i) for w in words for i, f in enumerate(forms) if lev(w, f) <= (2 if len(f) >= 9 else 1) and len(w) >= 3}
    assert got == want


def test_p3_against_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(f"u{i}", rnd.choice([None, float("nan"), rnd.random() * 1e-6, 3e-7]), rnd.choice([None, 0.25, 0.6, 1.0]), rnd.choice([0, 0, 1, 5, 10**6]), "z") for i in range(60)] + [(None, 1.0, 1.0, 1, "z"), ("u1", 0.0, None, None, "z")]
    df = spark.createDataFrame(rows, "url string, pagerank double, quality double, inbound_domains long, place string")
    w = rank_flow.WEIGHTS
    got = {r.url: (r.net_flow, r.place) for r in rank_flow.net_flow(df, "url", w).collect()}
    best = {}
    for u, *v, _ in rows:
        if u is not None:
            v = [None if x is None or x != x else float(x) for x in v]
            old = best.get(u, [None] * 3)
            best[u] = [max((y for y in (a, b) if y is not None), default=None) for a, b in zip(old, v, strict=True)]
    net = dict.fromkeys(best, 0.0)
    for k, (name, weight) in enumerate(w.items()):
        have = {u: v[k] for u, v in best.items() if v[k] is not None}
        n = len(have)
        rank = {u: 2 * sum(y < x for y in have.values()) + sum(y == x for y in have.values()) + 1 for u, x in have.items()}
        lo, hi = int(n * 2 * rank_flow.INDIFFERENT), max(int(n * 2 * rank_flow.PREFERRED), int(n * 2 * rank_flow.INDIFFERENT) + 1)
        pref = lambda d: max(0.0, min(1.0, (d - lo) / (hi - lo)))  # noqa: B023, E731
        for u in have:
            net[u] += weight / sum(w.values()) * sum(pref(rank[u] - rank[v]) - pref(rank[v] - rank[u]) for v in have if v != u) / (n - 1)
    assert set(got) == set(net) and all(got[u][0] == pytest.approx(net[u], abs=2e-9) for u in net)
    assert sorted(p for _, p in got.values()) == list(range(1, len(net) + 1))
    assert rank_flow.net_flow(df.limit(0), "url", w).count() == 0


def test_p8(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 1, 7, 30, 31, 64, 100, rnd.randint(1, 99), rnd.randint(100, 450)])) for i in range(800)] + [(900, None), (None, 5)]
    items = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = packing.pack(items, 100).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r.bin] = fill.get(r.bin, 0) + r.tokens
        parts.setdefault(r.doc_id, []).append(r.tokens)
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert {d: sum(t) for d, t in parts.items()} == {d: t for d, t in rows if d is not None and t}
    assert all(len(t) == -(-sum(t) // 100) for t in parts.values())  # only what is too long is cut
    assert sum(fill.values()) / (100 * len(fill)) > 0.98
    assert packing.pack(items.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, 0)
    # triples of one third length with many pairs are used up
    many = {70: 200} | {10: 200} | {a: 2 for a in range(1, 20) if a != 10}
    full = packing.plan(many, 100)
    assert sum(n for p, n in full if sum(p) == 100 and 70 in p) >= 75
    plan = packing.plan({60: 10, 40: 7, 20: 6, 25: 4}, 100)
    assert sum(n * sum(p) for p, n in plan) == 60 * 10 + 40 * 7 + 20 * 6 + 25 * 4 and all(sum(p) <= 100 for p, _ in plan)


def test_p9(spark, monkeypatch):
    rnd = random.Random(6)
    words = {"web": "bridge market council water".split(), "forum": "lol thread reply posted".split(), "rare": "archive folio vellum codex".split()}
    rows = []
    for i in range(900):
        s = rnd.choices(["web", "forum", "rare"], [6, 3, 1])[0]
        text = " ".join(rnd.choice(words[s]) for _ in range(rnd.randint(5, 60)))
        rows.append((i, text, rnd.choice([s, s.upper(), f" {s} ", None] if i % 5 == 0 else [s]), "k"))
    rows += [(2000, None, "web", "k"), (2001, "", "forum", "k"), (None, "x", "web", "k"), (2002, "some text", "elsewhere", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k string")
    targets = spark.createDataFrame([("web", 0.5, 1), ("forum", 0.2, 1), ("rare", 0.25, 3), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(docs, targets)
    rep = {r.source: r for r in mixing.share_report(drawn, targets).collect()}
    assert rep["none"].tokens == 0 and all(r.most_copies <= r.max_repeats for r in rep.values())
    assert all(abs(rep[s].share - t / 0.95) < 0.02 for s, t in (("web", 0.5), ("forum", 0.2), ("rare", 0.25)))
    # a total that the caps can't reach is reported; groups fitted in tasks give the same rates
    groups = spark.createDataFrame([(0, [64, 0], 1000), (1, [0, 64], 500), (0, [40, 24], 300), (1, [10, 54], 200)], "k int, parts array<int>, tokens long")
    fit = lambda **o: mixing.fit_rates(groups, np.array([0.5, 0.5]), np.array([1.0, 2.0]), **o)
    assert fit()[2] <= 1e-5
    monkeypatch.setattr(mixing, "ROUNDS", {True: 12, False: 12})
    here, there = fit(), fit(max_groups=1)
    assert here[2] == pytest.approx(there[2]) and {(r.k, tuple(r.parts)): r.rate for r in here[0].collect()} == {(r.k, tuple(r.parts)): r.rate for r in there[0].collect()}
    with pytest.warns(UserWarning):
        assert fit(total=50_000)[2] > 0.1
    monkeypatch.undo()
    some = {r.source: r.tokens for r in mixing.share_report(mixing.draw(docs, targets, total=2000), targets).collect()}
    assert abs(sum(some.values()) - 2000 * 0.95) < 60
    assert mixing.draw(docs.limit(0), targets).count() == 0 and mixing.draw(docs, targets.limit(0)).count() == 0


def test_p9_giants_are_not_left_out_by_size(spark):
    # one text of most of its source's tokens, which the share needs
    texts = [(i, "word " * 20, "web") for i in range(200)] + [(900, "folio " * 1500, "rare")] + [(901 + i, "folio " * 30, "rare") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("web", 0.5, 1), ("rare", 0.5, 4)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in mixing.share_report(mixing.draw(docs, targets), targets).collect()}
    assert abs(rep["rare"].share - 0.5) < 0.02, rep
    assert in_sum() == mixing.GRID


def test_p9_rates_do_not_depend_on_where_groups_are_summed(spark):
    rnd = np.random.default_rng(3)
    one = [(j, [64 * int(i == j) for i in range(3)], int(t)) for j, t in enumerate((4_000_000, 900_000, 60_000))]
    more = [mixing.in_parts(rnd.dirichlet([0.4] * 3)) for _ in range(300)]
    table = one + [(int(p.argmax()), [int(x) for x in p], int(rnd.integers(1, 5000))) for p in more]
    groups = spark.createDataFrame(table, "k int, parts array<int>, tokens long").groupBy("k", "parts").agg(F.sum("tokens").alias("tokens"))
    shares, caps = np.array([0.5, 0.2, 0.3]), np.array([1.0, 2.0, 4.0])
    for total in (None, 300_000, 20_000_000):  # within reach of the caps or not
        fits = [mixing.fit_rates(groups.repartition(n), shares, caps, total, most) for n, most in ((1, None), (1, 1), (5, 1))]
        rates = [{(r.k, tuple(r.parts)): r.rate for r in f[0].collect()} for f in fits]
        assert rates[0] == rates[1] == rates[2] and len({f[1:] for f in fits}) == 1, total
        assert total != 300_000 or fits[0][2] <= 1e-6


def in_sum():
    return int(mixing.in_parts(np.array([0.333, 0.333, 0.334])).sum())


def test_p9_classifier_on_held_out():
    rnd = random.Random(7)
    words = {0: "bridge market council water".split(), 1: "lol thread reply posted".split()}
    make = lambda k: " ".join(rnd.choice(words[k] + ["the", "of"]) for _ in range(30))
    labels = np.array([i % 2 for i in range(60)])
    model = mixing.Classifier([make(k) for k in labels], labels, 3)
    held = [(k, model.posterior(make(k))) for k in [0, 1] * 40]
    assert np.mean([p.argmax() == k for k, p in held]) > 0.95 and all(p[2] == 0 for _, p in held)
