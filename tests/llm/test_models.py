"""Quality, language, licences, leaks: accuracy on held-out rows, planted cases, odd rows."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusweave.llm import languages, leaks, licences, quality

EN = "the of and to in is that for with was on are this be at by from which have not".split()
FR = "le de et la les des en un une que est pour dans qui sur pas plus par avec été".split()


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, EN if i % 3 else FR, rnd.randrange(1, 60)), "en" if i % 3 else "fr") for i in range(300)]
    rows += [(1000, None, "en"), (1001, "123 !? ...", "en"), (1002, "", None), (None, "the of and to in is", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_profiles(mixed):
    got = languages.identify(mixed).collect()
    want = {r["doc_id"]: r["lang"] for r in mixed.collect()}
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (True if r["doc_id"] is None else held(r["doc_id"])) for r in got)
    real = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in real) >= 0.97 * len(real)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    assert languages.keep_known(mixed, 0.2).filter("doc_id >= 1000").count() == 0


def test_out_of_place_distance_by_hand():
    codes, counts = languages.grams("Ab ab é")
    name = lambda c: "".join(chr(c >> s & 0x1FFFFF).replace("\x01", "_") for s in (42, 21, 0) if c >> s)
    assert {name(int(c)): int(n) for c, n in zip(codes, counts)} == {"a": 2, "b": 2, "é": 1, "_a": 2, "ab": 2, "b_": 2, "_é": 1, "é_": 1, "_ab": 2, "ab_": 2, "_é_": 1}


def test_language_distance_matches_brute_force(mixed):
    learned = languages.profiles(mixed.filter("lang IS NOT NULL"), size=40)
    places = {}
    for r in learned.collect():
        places.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    texts = {}
    for r in mixed.filter("lang IS NOT NULL").collect():
        codes, counts = languages.grams(r["text"] or "")
        tally = texts.setdefault(r["lang"], {})
        for c, n in zip(codes.tolist(), counts.tolist()):
            tally[c] = tally.get(c, 0) + n
    for lang, tally in texts.items():
        assert places[lang] == {c: i for i, (c, _) in enumerate(sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:40])}
    got = {r["doc_id"]: r for r in languages.predict(mixed, learned, size=40).collect()}
    for r in mixed.collect():
        codes, counts = languages.grams(r["text"] or "")
        top = [c for c, _ in sorted(zip(codes.tolist(), counts.tolist()), key=lambda x: (-x[1], x[0]))[:40]]
        far = {lang: sum(abs(i - own[c]) if c in own else 40 for i, c in enumerate(top)) for lang, own in places.items()}
        best = min(sorted(far), key=far.get) if top else "und"
        assert got[r["doc_id"]]["lang_pred"] == best
        assert abs(got[r["doc_id"]]["score"] - (1 - far[best] / (40 * len(top)) if top else 0)) < 1e-9


def test_languages_without_training_rows_or_rows(spark, odd, none):
    assert {r["lang_pred"] for r in languages.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert languages.identify(none).count() == 0
    assert languages.identify(odd).count() == odd.count()
    kept = languages.keep_known(odd, 0.0)
    assert kept.columns == odd.columns


def test_quality_ranks_held_out_rows(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rnd, EN, rnd.randrange(5, 80))
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (500, None), (501, 7), (None, 1), (777, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, marks).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    truth = dict(labels)
    tested = [r for i, r in got.items() if i in truth and r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)


def test_quality_edges(spark, odd, none):
    one = spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(odd, one).collect()} == {0.5}
    assert quality.classify(odd, one).count() == odd.count()
    assert quality.classify(none, one).count() == 0


@pytest.mark.parametrize("ones, zeros", [(1, 1), (2, 2), (1, 9), (40, 7), (7, 40)])
def test_every_labelled_row_has_its_pairs(spark, ones, zeros):
    rows = [(i, [float(i), float(i * i % 7)], int(i < ones)) for i in range(ones + zeros)]
    train = spark.createDataFrame(rows, "doc_id long, f array<float>, y int")
    got = [(r["label"], r["diff"].toArray().tolist()) for r in quality.pairs(train, ones, zeros).collect()]
    few, many = sorted((ones, zeros))
    assert len(got) == 2 * 3 * many
    assert sorted(d for label, d in got if label == 1) == sorted([-x + 0.0 for x in d] for label, d in got if label == 0)
    weights, cut, slope = quality.fit(train.withColumn("f", F.array_repeat(F.col("f")[0], quality.WIDTH)))
    assert quality.np.isfinite(weights).all() and slope > 0


def test_quality_weights_are_those_of_a_plain_fit(spark):
    rnd = quality.np.random.default_rng(4)
    x = rnd.normal(size=(90, 4)).astype("float32")
    y = (x[:, 0] - 0.5 * x[:, 1] + rnd.normal(size=90) > 0.4).astype(int)
    train = spark.createDataFrame([(i, f.tolist(), int(t)) for i, (f, t) in enumerate(zip(x, y))], "doc_id long, f array<float>, y int")
    got, _, _ = quality.fit(train)
    rows = quality.pairs(train, int(y.sum()), int((1 - y).sum())).collect()
    d = quality.np.array([r["diff"].toArray() for r in rows])
    t = quality.np.array([r["label"] for r in rows])
    scale = d.std(0, ddof=1)  # the penalty is on weights of features of unit deviation
    w = quality.np.zeros(4)
    for _ in range(60):  # Newton's method on the mean logistic loss
        z = d / scale
        p = 1 / (1 + quality.np.exp(-z @ w))
        w -= quality.np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(t) + 1e-3 * quality.np.eye(4), z.T @ (p - t) / len(t) + 1e-3 * w)
    assert quality.np.allclose(got, w / scale, atol=2e-2 * abs(w / scale).max())


def test_quality_with_two_labels_of_each_kind(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "good " * i) for i in range(40)], "doc_id long, text string")
    free = [i for i in range(40) if not held(i)][:4]
    marks = spark.createDataFrame([(free[0], 1), (free[1], 1), (free[2], 0), (free[3], 0), (free[3], 0)], "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == 40 and all(0 <= r["score"] <= 1 for r in got)


def base_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licences.BASE_PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licences_base_columns_match_brute_force(spark, odd, none):
    rnd = random.Random(8)
    bits = ["MIT", "License", "license,", "Apache", "GENERAL public", "General Public License", "mit-license", "_mit_license_", "été", "x"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))) for i in range(300)] + [(900, None), (901, "")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: base_places(t) for i, t in rows}
    for r in got:
        assert tuple(r)[1:6] == want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).count() == 0


def test_licences_templates_through_changes(spark):
    name, text = licences.TEMPLATES[3]
    words = text.split()
    cut = " ".join(words[:20] + ["CHANGED", "here"] + words[24:])
    rows = [(1, "intro words " + text), (2, cut), (3, " ".join(words[:10])), (4, "plain prose with the use of source and binary forms")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert name in got[1]["labels"] and got[1]["score"] == 1.0 and got[1]["spans"][0]["first"] == 2
    assert name in got[2]["labels"] and 0.8 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[4]["labels"] == ""


def plain_scan(words, base, short, templates, min_match, max_gap, min_cover):
    """Spans, labels and score by trying every place of every template."""
    phrases = [(licences.words_of(p), label) for p, label in (*base, *short)]
    named = {label for p, label in phrases if any(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1))}
    spans = set()
    every = {tuple(t[x : y + 1]) for t in (licences.words_of(x) for x in [p for p, _ in (*base, *short)] + [x for _, x in templates]) for x in range(len(t)) for y in range(x, len(t))}
    for label, text in templates:
        t, runs = licences.words_of(text), []
        for a in range(len(words)):
            for b in range(a + min_match - 1, len(words)):
                run = tuple(words[a : b + 1])
                # a matching statistic: a longest run that any text of the automaton has, not begun earlier nor going on
                if run not in every or (b + 1 < len(words) and tuple(words[a : b + 2]) in every) or (a and tuple(words[a - 1 : b + 1]) in every):
                    continue
                runs += [(a, b, x, x + b - a) for x in range(len(t)) if tuple(t[x : x + b - a + 1]) == run]
        runs.sort()
        best = []
        for a, b, x, y in runs:
            own = (y - x + 1, a)
            for (_, end, _, last), (n, first) in zip(runs, best):
                if end < a <= end + max_gap and last < x and n + y - x + 1 > own[0]:
                    own = (n + y - x + 1, first)
            best.append(own)
        for first in {f for _, f in best}:
            n = max(c for c, f in best if f == first)
            last = next(b for (_, b, _, _), own in zip(runs, best) if own == (n, first))
            if n >= min_cover * len(t):
                spans.add((label, first, last, round(n / len(t), 9)))
    score = max([licences.MENTIONED if named else 0.0, *(s[3] for s in spans)])
    return spans, ",".join(sorted(named | {s[0] for s in spans})), score


def test_licence_spans_labels_and_score_match_brute_force(spark):
    rnd = random.Random(14)
    alphabet = "abcde"
    base, short = (("a b", "ab"), ("c", "c")), (("d e d", "ded"),)
    templates = tuple((f"t{k}", " ".join(rnd.choice(alphabet) for _ in range(rnd.randrange(6, 14)))) for k in range(4))
    args = (base, short, templates, 3, 4, 0.5)
    rows = []
    for i in range(150):
        w = [rnd.choice(alphabet + "xy") for _ in range(rnd.randrange(8))]
        for _ in range(rnd.randrange(3)):
            t = rnd.choice(templates)[1].split()
            if rnd.random() < 0.6:
                t[rnd.randrange(len(t))] = "z"
            w += t + [rnd.choice("xyz") for _ in range(rnd.randrange(3))]
        rows.append((i, " ".join(w)))
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), base=base, short=short, templates=templates, min_match=3, max_gap=4, min_cover=0.5).collect()
    texts = dict(rows)
    for r in got:
        spans, labels, score = plain_scan(licences.words_of(texts[r["doc_id"]]), *args)
        assert {(s["label"], s["first"], s["last"], round(s["cover"], 9)) for s in r["spans"]} == spans
        assert r["labels"] == labels and abs(r["score"] - score) < 1e-9
    assert sum(bool(r["spans"]) for r in got) > 40


@pytest.fixture(scope="module")
def leaky(spark):
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [make(rnd.randrange(12, 50)) for _ in range(30)]
    docs, want = [], set()
    for i in range(120):
        body = make(rnd.randrange(150))
        if i % 3 == 0:
            k = rnd.randrange(30)
            p = list(items[k])
            if i % 2:
                p[len(p) // 2] = "other"
                p.insert(3, "more")
            body[5:5] = p
            want.add((i, k))
        docs.append((i, " ".join(body).title()))
    bench = [(k, ", ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "not there"), (92, "")]
    return spark.createDataFrame([*docs, (500, None), (501, "")], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), want


def test_leaks_are_found_and_clean_documents_left(leaky):
    docs, bench, want = leaky
    got = leaks.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["similarity"] >= 0.8 for r in got)
    small = leaks.find_leaks(docs, bench, block_words=200)
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} == want
    assert {r["doc_id"] for r in leaks.without_leaks(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_paraphrase_needs_the_answer(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa. lamda mu nu xi omicron"
    para = "alpha one gamma delta two zeta eta three iota four lamda mu nu xi omicron"
    other = "alpha one gamma delta two zeta eta three iota four lamda mu five xi omicron"
    docs = spark.createDataFrame([(1, para), (2, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in leaks.find_leaks(docs, bench).collect()] == [1]


def test_leaks_do_not_depend_on_the_corpus_size(spark, monkeypatch):
    rnd = random.Random(5)
    items = [[rnd.choice(EN) if j % 2 else f"p{i}x{j}" for j in range(17)] for i in range(20)]
    docs = []
    for i, words in enumerate(items):
        other = [f"o{rnd.randrange(500)}" for _ in range(80)]
        at = rnd.randrange(80)
        docs.append((i, " ".join(other[:at] + words + other[at:])))
    docs = spark.createDataFrame(docs + [(100, " ".join(rnd.choice(EN) for _ in range(200)))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    counted = leaks.document_frequencies
    for scale in (1, 1500, 1_000_000):
        monkeypatch.setattr(leaks, "document_frequencies", lambda *a: counted(*a).withColumn("n", F.col("n") * scale))
        assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, bench).collect()} == {(i, i) for i in range(20)}


def test_leaks_edges(odd, none, leaky):
    _, bench, _ = leaky
    assert leaks.find_leaks(none, bench).count() == leaks.find_leaks(odd, bench.limit(0)).count() == 0
    same = leaks.without_leaks(odd, bench)
    assert same.columns == odd.columns and same.count() == odd.count()


def test_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd").encode() for _ in range(rnd.randrange(1, 15))] for _ in "ab")
        places = {w: sum(1 << i for i, x in enumerate(a) if x == w) for w in a}
        assert leaks.common_subsequence(places, len(a), b)[0] == plain(a, b)
        best = max(plain(a, b[s : s + 2 * len(a)]) for s in range(len(b)))
        length, first, last = leaks.closest(places, len(a), b)
        assert length == plain(a, b[first : last + 1]) and last - first < 2 * len(a) and length == best


@pytest.fixture(scope="module")
def block(spark):
    """60 passages of 8 to 75 words, most words frequent ones, with words drawn by Zipf's law."""
    rnd = random.Random(21)
    names = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    weights = [1 / (i + 1) for i in range(len(names))]
    draw = lambda n: rnd.choices(names, weights, k=n)
    items = leaks.Items([(i, " ".join(draw(n)), None) for i, n in enumerate(list(range(12, 76)) * 1 + [12, 17, 33, 65])])
    items.idf = leaks.np.array([1 + leaks.math.log(2000 / (1 + 1000 / (1 + names.index(w.decode())))) for w in items.vocab])
    items.space = leaks.latent_space(spark, items)
    items.fold()
    items.weigh()
    return rnd, draw, items


def test_every_planted_passage_is_found_in_texts_of_frequent_words(block):
    rnd, draw, items = block
    for i, ws in enumerate(items.words):
        for _ in range(6):
            other = draw(rnd.randrange(400))
            at = rnd.randrange(len(other) + 1)
            text = [w.encode() for w in other[:at]] + ws + [w.encode() for w in other[at:]]
            found = {f[0]: f for f in leaks.search(text, items)}
            assert i in found and found[i][1] == 1 and found[i][4] - found[i][3] < 2 * len(ws)


def test_found_passages_stand_there_and_others_do_not(block):
    """Whatever is found has its share within a stretch of twice its length; of random text nothing is found that brute force does not find."""
    rnd, draw, items = block
    for _ in range(40):
        text = [w.encode() for w in draw(rnd.randrange(300))]
        for name, similar, _, first, last in leaks.search(text, items):
            ws = items.words[name]
            assert last - first < 2 * len(ws) and leaks.common_subsequence(items.places[name], len(ws), text[first : last + 1])[0] / len(ws) == similar >= 0.6


def test_short_passages_must_stand_whole(spark):
    docs = spark.createDataFrame([(1, "so it is: to be, or not TO BE then"), (2, "to be or to be"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "To be or not"), (2, "be"), (3, ""), (4, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["last_word"]) for r in leaks.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, 3, 6), (1, 2, 4, 4), (2, 2, 1, 1)}
    assert [r["doc_id"] for r in leaks.without_leaks(docs, bench).collect()] == [3]
