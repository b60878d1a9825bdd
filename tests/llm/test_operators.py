import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import suffix_dedup
from quarry.llm.ann import nearest_vectors
from quarry.llm.chat import rotate_perspectives
from quarry.llm.decontaminate import containment_matches, flag_contaminated
from quarry.llm.langid import SizeByLanguage, identify_language, learn_dictionaries
from quarry.llm.minhash import fast_similarity_sketch, near_duplicates
from quarry.llm.quality import TERMS, NeighbourModel, learn_quality, score_quality, term_counts
from quarry.llm.queries import held_out, op6_quality, op9_language_id, queries
from quarry.llm.sample import bounded_sample
from quarry.llm.suffix_dedup import COVER, PERIOD, remove_repeats
from quarry.llm.warc import archive_round_trip, export_archives, read_archive, write_warc
from quarry.storage import materialise
from tests.conftest import SF


def frame(spark, texts, extra=""):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(k, t, 1, "x", -1.0) for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int, kept string, score double")


# --- near duplicates


def brute_components(texts, width, percent):
    sets = {}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, width, percent):
    rnd = random.Random(width)
    words = [f"w{k}" for k in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(40, 120))] for _ in range(8)]
    texts = [None, "", " \t", "one", "ONE", "one two", "x" * 300_000]
    for _ in range(150):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(6)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t) if rnd.random() < 0.9 else " ".join(t[:30] + base[0][:30]).upper())
    want, sizes = brute_components(texts, width, percent)
    rows = near_duplicates(frame(spark, texts), width=width, percent=percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=repr)
    assert near_duplicates(rows.limit(0)).count() == 0


def test_near_duplicates_of_an_id_with_several_texts(spark):
    rows = [(1, "a b c d"), (1, "k l m n"), (2, "a b c d"), (3, "k l m n"), (4, "k l m n o p")]
    found = [sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), width=2, percent=60).collect())) for n in (1, 3, 7)]
    assert len(found[0]) == 5 and found[0] == found[1] == found[2]
    assert {r[2] for r in found[0]} == {1} and sorted(r[1] for r in found[0]) == [3, 3, 3, 3, 5]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 300, np.uint64), rng.integers(0, 2**63, 60, np.uint64)
    one, two = np.unique(a), np.unique(np.concatenate([a[:240], b]))
    sketch = fast_similarity_sketch(np.concatenate([one, two, one[:1]]), np.array([0, len(one), len(one) + len(two), len(one) + len(two) + 1]), 1024)
    assert (sketch != np.uint64(2**64 - 1)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 240 / 360) < 0.06


# --- repeated strings


def brute_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        mark = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = True
        runs = int((np.diff(np.concatenate([[False], mark]).astype(int)) == 1).sum())
        yield int(mark.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~mark[:-1]])


@pytest.mark.parametrize(("length", "bucket_rows"), [(40, 2048), (40, 3), (7, 100), (100, 5)])
def test_repeats_equal_brute_force(spark, length, bucket_rows):
    rnd = random.Random(length)
    pool = ["".join(rnd.choice("abé ") for _ in range(rnd.randrange(1, 200))) for _ in range(10)]
    texts = ["".join(rnd.choice(pool) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(80))) for _ in range(rnd.randrange(5))) for _ in range(70)]
    texts += [texts[5], texts[5], "ab" * 300, "a" * 500, "", None, pool[0] * 3]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, texts), length=length, bucket_rows=bucket_rows, block_bytes=2000, keep_columns=True).collect()}
    data = [(t or "").encode() for t in texts]
    for k, want in enumerate(brute_removal(data, length)):
        assert (got[k].n_removed, got[k].n_spans, bytes(got[k].kept or b""), got[k].n_bytes) == (*want, len(data[k]))
    assert {k for k in got if got[k].kept is None} == {k for k, t in enumerate(texts) if t is None}
    assert remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0


def test_a_long_text_of_short_period_ships_few_runs(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, name: kept.setdefault(name, materialise(df, name)))
    rnd = random.Random(2)
    odd = "".join(rnd.choice("abcdefgh") for _ in range(60))
    texts = [" " * 300_000 + odd, "xy" * 100_000 + odd[::-1], "q" + " " * 150, "abc" * 20, odd]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, texts), length=100).collect()}
    want = [(300_000, 1), (200_000, 1), (150, 1), (0, 0), (0, 0)]
    assert [(got[k].n_removed, got[k].n_spans) for k in range(5)] == want
    assert kept["anchors"].count() < 3000 and kept["wanted"].selectExpr("max(size(runs))").first()[0] < 1000


def test_a_hot_bucket_is_dealt_until_it_is_bounded(spark, monkeypatch):
    kept = defaultdict(list)
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, name: kept[name].append(out := materialise(df, name)) or out)
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = some(150)
    texts = [some(rnd.randrange(200)) + (passage[: rnd.randrange(90, 151)] if k % 3 else passage) + some(rnd.randrange(200)) for k in range(300)]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, texts), length=100, bucket_rows=20).collect()}
    for k, want in enumerate(brute_removal([t.encode() for t in texts], 100)):
        assert (got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == want
    assert len(kept["dealt"]) >= 2
    # ranges that are alone are dropped, so rows stay far below one for each of up to 76 windows of 300 texts
    assert sum(d.count() for d in kept["dealt"]) < 300 * 76 / 4


def test_ranges_of_windows_share_their_bytes():
    rnd = random.Random(1)
    text = bytes(rnd.choice(b"ab") for _ in range(400))
    for width in (76, 19, 5, 2, 1):
        rows = [(9, b"x", a, n, 80 - a, text[a : a + n - 1 + 100]) for a, n in ((0, 76), (7, 30), (60, 16), (75, 1))]
        met = defaultdict(set)
        for bucket, _, first, count, offset, context in suffix_dedup.narrower(rows, 100, width):
            assert context == text[first : first + count - 1 + 100] and offset == 80 - first
            for start in range(first, first + count):
                met[start].add(bucket)
        assert set(met) == set(range(76)) and all(len(b) == 1 for b in met.values())
        assert len({min(b) for b in met.values()}) == len({(80 - s) // width for s in met})


def test_texts_longer_than_a_segment(spark):
    rnd = random.Random(6)
    prose = lambda n: "".join(rnd.choices("abcdefgh ijé", k=n))
    shared = prose(1500)
    texts = [prose(9_000_000) + shared + prose(50_000), prose(300_000) + shared[200:1400] + prose(262_144), prose(5000)]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, texts), length=400).collect()}
    want = len(shared[200:1400].encode())
    assert [(got[k].n_removed, got[k].n_spans) for k in range(3)] == [(want, 1), (want, 1), (0, 0)]
    assert shared[200:1400].encode() not in bytes(got[0].kept)


def test_the_cover_covers():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


# --- decontamination


def test_containment_equals_brute_force(spark):
    rnd = random.Random(11)
    words = [f"v{k}" for k in range(300)]
    items = [" ".join(rnd.choice(words) for _ in range(n)) for n in (5, 6, 9, 20, 33, 64, 4, 200, 2, 3)] + ["", "?!"]
    texts = [None, "", "v1 v2", items[8], items[9].upper() + "."]
    for _ in range(80):
        w = rnd.choice(items[:10]).split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) + " " + ", ".join(w).upper() + "! " + " ".join(rnd.choice(words) for _ in range(30)))
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda t, m: {tuple(w[i : i + m]) for w in [split(t)] for i in range(len(w) - m + 1)}
    want = set()
    for k, item in enumerate(items):
        if split(item):
            m = min(5, len(split(item)))
            own = runs(item, m)
            want |= {(d, k) for d, t in enumerate(texts) if 100 * len(own & runs(t, m)) >= 80 * len(own)}
    assert {(3, 8), (4, 9)} <= want
    bench = spark.createDataFrame([*enumerate(items), (None, "v1 v2 v3 v4 v5"), (2, items[2])], "item_id long, text string")
    docs = frame(spark, texts)
    for rows in (1_000_000, 0):
        assert {(r.doc_id, r.item_id) for r in containment_matches(docs, bench, broadcast_rows=rows).collect()} == want
    flags = {r.doc_id: r for r in flag_contaminated(docs, bench).collect()}
    assert len(flags) == len(texts) and {d for d, r in flags.items() if r.contaminated} == {d for d, _ in want}
    assert flag_contaminated(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in flag_contaminated(docs, bench.limit(0)).collect())


# --- nearest vectors


def test_nearest_vectors_recall_and_order(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:760] = x[3]
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0] * 7), (5080, [None] * 24), (None, [1.0] * 24)]
    got = defaultdict(list)
    for r in nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=400, query_rows=30).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    wide = x.astype(np.float64)
    for q, found in got.items():
        found.sort()
        score = (wide * wide[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(1500), -score))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(want.tolist()))
    assert hit / (20 * len(got)) >= 0.9


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest_vectors(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest_vectors(few.limit(0)).count() == 0


# --- archives


def test_archives_round_trip(spark, tmp_path):
    big = "é<p>" * 400
    rows = [(0, "http://a/b c", "x"), (1, None, None), (2, "http://a", big), (3, "http://ü", big), (4, "u", "x"), (5, "v", big), (6, "w", "y" * 200_000), (None, "n", "z" * 1200)]
    pages = spark.createDataFrame([(*r, "clash", 9) for r in rows], "page_id long, url string, html string, payload string, refers_to int")
    got = {r.page_id: r for r in archive_round_trip(pages, archive_bytes=3000).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {0: ("response", None), 1: ("response", None), 2: ("revisit", 5), 3: ("revisit", 5), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    assert got[2].payload_bytes == len(big.encode()) and bytes(got[5].body) == big.encode() and got[1].payload_bytes == 0
    assert archive_round_trip(pages.limit(0)).count() == 0

    many = spark.createDataFrame([(k, f"http://h/{k}", f"<html><body>page {k} of many alike, with text {k * 7919}</body></html>" * 5) for k in range(300)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/archives"
    write_warc(many, path)
    archives = spark.read.parquet(path)
    assert export_archives(archives, str(tmp_path)) == archives.count()
    files = list(tmp_path.glob("*.warc.zst"))
    data = [f.read_bytes() for f in files]
    assert all(d[:4] == bytes.fromhex("5d2a4d18") for d in data)  # the dictionary's frame leads
    records = [r for d in data for r in read_archive(d)]
    assert len(records) == 300 and all(r.startswith(b"WARC/1.1\r\n") for r in records)


# --- classifiers


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in op9_language_id(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.9


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(k, ("the and of with " if k % 2 else "der und nicht mit ") * 20, "en" if k % 2 else "de") for k in range(40)] + [(99, None, "en"), (98, "x y", None)], "doc_id long, text string, lang string")
    known = learn_dictionaries(train)
    assert sorted(known) == ["de", "en"]
    docs = frame(spark, [None, "", "12 !?", "der und mit der und", "the and of with the and of", "the and of " * 40_000, "q", "½ ²", "Ⅷ ③ _"])
    got = {r.doc_id: r for r in identify_language(docs, known, keep=True).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["und", "und", "und", "de", "en", "en"]
    assert [got[k].rejected for k in range(7)] == [True, True, True, False, False, False, True]
    assert [got[k].lang_pred for k in (7, 8)] == ["und", "und"]
    assert got[3]["kept"] == "x" and 0 <= got[4].score <= 1
    assert all(r.lang_pred == "und" for r in identify_language(docs, learn_dictionaries(train.limit(0))).collect())


def plain_language(text, dictionaries, level=9, block=1 << 15):
    """(language, margin) by compressing every block with every dictionary."""
    import zstandard as z

    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    data = text.lower().encode()
    n = math.ceil(len(data) / block)
    blocks = [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]
    sizes = []
    for lang in sorted(dictionaries):
        one = z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False)
        sizes.append((sum(len(one.compress(b)) for b in blocks), lang))
    best, second = sorted(sizes)[:2]
    return best[1], (second[0] - best[0]) / second[0]


def plain_dictionaries(rows, row_bytes=2048):
    """All short texts by language: what is learned where a language has at most a hundred of them."""
    parts = defaultdict(list)
    for r in sorted((r for r in rows if r.lang and len(r.text.encode()) <= row_bytes), key=lambda r: (r.lang, str(r.doc_id), r.text)):
        parts[r.lang].append(r.text.lower().encode())
    assert all(len(p) <= 100 for p in parts.values())
    return {lang: b"\n".join(p) for lang, p in parts.items()}


def test_language_query_equals_all_encodings(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    known = plain_dictionaries([r for r in rows if not held(r.doc_id)])
    got = {r.doc_id: r for r in op9_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, margin = plain_language(r.text, known)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, held(r.doc_id))
        assert math.isclose(got[r.doc_id].score, margin / (margin + 0.01), abs_tol=1e-12)


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(k, "der und nicht mit " * 400, "de") for k in range(5)] + [(9, "der und nicht " * 300, "de"), (10, "the and of", "en")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn_dictionaries(train) == {"de": ("der und nicht " * 300).encode(), "en": b"the and of"}


def test_samples_are_bounded_whatever_the_ids(spark):
    rows = spark.createDataFrame([(7, f"text {k}") for k in range(3000)] + [(7, "same")] * 3000, "id long, t string")
    assert bounded_sample(rows, 10, F.xxhash64("id")).count() == 10
    grouped = rows.withColumn("g", (F.col("t") == "same").cast("string"))
    assert {r["count"] for r in bounded_sample(grouped, 10, F.xxhash64("id", "t"), "g").groupBy("g").count().collect()} == {10}


def test_language_of_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = SizeByLanguage(learn_dictionaries(docs), 9)
    vocabulary = {lang: sorted({w for r in docs.filter(docs.lang == lang).collect() for w in r.text.split()}) for lang in ("en", "fr")}
    rnd = random.Random(3)

    def prose(lang, n_bytes):
        return " ".join(rnd.choices(vocabulary[lang], k=n_bytes // 5))[:n_bytes]

    lang, short = sizes(prose("fr", 30_000))
    assert lang == "fr"
    lang, long = sizes(prose("fr", 12_000_000))
    assert lang == "fr" and long > short / 2
    assert sizes(prose("en", 100_000) + " " + prose("fr", 500_000))[0] == "fr"
    assert sizes(prose("fr", 100_000) + " " + prose("en", 500_000))[0] == "en"


def test_quality_of_held_out_documents(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op6_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in rows) / len(rows) > 0.9


def test_quality_query_equals_all_cosines_and_votes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = learn_quality(docs.filter(~held_out()), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in op6_quality(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        cosines = (model.project(term_counts([r.text.encode()])) @ model.vectors.T)[0]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: model.k]
        weight = [math.exp(model.sharpness * (float(cosines[k]) - 1)) for k in near]
        score = sum(w for w, k in zip(weight, near, strict=True) if model.labels[k]) / sum(weight)
        if abs(score - got[r.doc_id].score) > 1e-4:  # products of a block and of a row may round apart and swap the last neighbours
            order = sorted(cosines, reverse=True)
            assert order[model.k - 1] - order[model.k] < 1e-5, r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_equal_cosines_vote_in_the_order_of_the_sample():
    model = NeighbourModel(np.ones(TERMS, np.float32), np.eye(TERMS, 2, dtype=np.float32), np.array([[1, 0]] * 5, np.float32), np.array([1.0, 0, 0, 1, 1]), k=2)
    counts = np.zeros((1, TERMS), np.float32)
    counts[0, 0] = 1
    assert model.score(counts)[0] == 0.5
    model.k = 3
    assert abs(model.score(counts)[0] - 1 / 3) < 1e-12


def test_quality_of_odd_texts(spark):
    docs = frame(spark, [None, "", "plain words in a line", "LOUD!! WORDS!!", "a " * 200_000] + ["good plain words here"] * 9 + ["BAD!! SHOUT!! HERE!!"] * 9)
    labels = spark.createDataFrame([(k, 1 if k < 14 else 0) for k in range(5, 23)] + [(None, 1), (7, None), (77, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(docs, learn_quality(docs, labels)).collect()}
    assert len(got) == 23 and got[0].score == got[1].score == 0.0
    assert got[2].predicted == 1 and got[3].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in score_quality(docs, learn_quality(docs, labels.limit(0))).collect()} == {0.0, 0.5}


# --- dialogues


def test_perspectives(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo é"), (1, 3, "ann", None), (1, 4, None, "?"), (2, 0, "system", "alone"), (None, 0, "zoe", "n"), (3, 5, "ann", "b"), (3, 5, "ann", "a"), (3, 5, "ann", "a")]
    frame = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, speaker string")
    got = {(r.conv_id, r.speaker): r for r in rotate_perspectives(frame).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "zoe"), (3, "ann")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo é<|end|>\n<|assistant|>\n<|end|>\n<|user|>\n?<|end|>\n"
    assert [ann.rendered[a:b] for a, b in zip(ann.mask_starts, ann.mask_ends, strict=True)] == ["hi<|end|>\n", "<|end|>\n"]
    assert (ann.n_turns, ann.n_own, ann.n_masked) == (5, 2, 18)
    assert got[3, "ann"].rendered.count("<|assistant|>") == 3
    pieces = sorted(rotate_perspectives(frame, piece_turns=2).filter("conv_id = 1 and speaker = 'ann'").collect(), key=lambda r: r.piece)
    assert "".join(p.rendered for p in pieces) == ann.rendered and sum(p.n_masked for p in pieces) == ann.n_masked
    assert rotate_perspectives(frame.limit(0)).count() == 0


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in queries()} == set(range(1, 11))


def test_items_that_share_a_shingle_and_rows_without_an_id(spark):
    """A passage that all items share, and copies of an item in rows without an id."""
    head = "choose the best of the following answers to this question"
    items = spark.createDataFrame([(k, f"{head} " + " ".join(f"i{k}w{j}" for j in range(30))) for k in range(150)], "item_id long, text string")
    own = items.orderBy("item_id").first().text
    docs = spark.createDataFrame([(1, head + " and nothing else"), (2, own), (None, own), (None, "clean text without any item"), (None, None), (7, " ".join(r.text for r in items.collect()))], "doc_id long, text string")
    got = flag_contaminated(docs, items).collect()
    assert len(got) == 6 and sorted((r.n_items for r in got)) == [0, 0, 0, 1, 1, 150]
    assert all(r.contaminated == (r.n_items > 0) and (r.item_id == 0 or not r.contaminated) for r in got)
    assert {r.doc_id for r in got if r.contaminated} == {2, None, 7}


def test_perspectives_of_a_long_conversation_with_tied_turns(spark):
    """Turns without numbers, with large ones, and all alike are put in order over several tasks."""
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(1, None, "ab"[k % 2], f"t{k:05}") for k in range(3000)] + [(2, 10**9 * k, "ab"[k % 2], f"t{k:05}") for k in range(3000)] + [(3, 5, "a", "same")] * 700
    found = rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).orderBy("conv_id", "speaker", "piece").collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for conv in (1, 2):
        text = "".join(r.rendered for r in found if r.conv_id == conv and r.speaker == "a")
        order = sorted(rows[:3000], key=lambda r: (r[2], r[3])) if conv == 1 else rows[:3000]
        assert re.findall(r"t\d{5}", text) == [r[3] for r in order]
    assert [(r.n_turns, r.n_own) for r in found if r.conv_id == 3] == [(512, 512), (188, 188)]


def test_dirty_languages_and_long_texts_stay_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of text "), "id").alias("text"), F.when(F.col("id") < 2000, "en").when(F.col("id") < 2600, "de").otherwise(F.concat(F.lit("x"), "id")).alias("lang"))
    assert sorted(learn_dictionaries(rows, most_langs=3))[:2] == ["de", "en"] and len(learn_dictionaries(rows, most_langs=3)) == 3
    long = spark.createDataFrame([(1, "ab " * 100_000, "fr"), (2, "short", "en")], "doc_id long, text string, lang string")
    found = learn_dictionaries(long, rows_per_lang=2, row_bytes=100)
    assert len(found["fr"]) == 200 and found["en"] == b"short"
