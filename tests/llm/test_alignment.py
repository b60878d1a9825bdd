import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment
from quarry.llm.alignment import align_tokenizers, byte_of_char, segments
from quarry.llm.queries import op12_alignment
from tests.conftest import SF
from tests.llm.test_tokens import CASES, fuzz

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
EXTRA = ["a▁b", "<s>x</s> <0x41>", "x  ", "  two  words ", "é \xa0y", "\x00a", "Plain words here. " * 400, "z" * 3000]


def brute(texts):
    """All columns but the id, token by token."""
    tok, sp, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_char()
    tok.encode_special_tokens = True
    links, rows, counts = [], [], Counter()
    for t in texts:
        a, b = tok.encode(" " + (t or ""), add_special_tokens=False).ids, sp.encode(t or "")
        sizes = [[bytes(byte[c] for c in tok.id_to_token(k)) for k in a], [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]]
        if not t or any(b"".join(x) != (" " + t).encode() for x in sizes):
            links.append([])
            rows.append((0, 0, 0, 0, ""))
            continue
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 500 else list(running(x)) for x in sizes]
        both = sorted(set(ends[0]) & set(ends[1]))
        at = [{e: k for k, e in enumerate(x)} for x in ends]
        groups, last = [], (0, 0)
        for e in both:
            stop = at[0][e] + 1, at[1][e] + 1
            groups.append(",".join(map(str, a[last[0] : stop[0]])) + "|" + ",".join(map(str, b[last[1] : stop[1]])))
            last = stop
        links.append([(a[at[0][e]], b[at[1][e]]) for e in both])
        counts.update(links[-1])
        rows.append((len(a), len(b), len(both), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(*r[:4], sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own), r[4]) for r, own in zip(rows, links, strict=True)]


def running(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


def got(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


def test_alignment_equals_the_libraries(spark):
    texts = [*CASES, *EXTRA, *fuzz(), None, CASES[4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_a", "'x' as digest", "0 as row_key", "2 as times").repartition(3)
    assert got(align_tokenizers(docs, A, B, cache_room=50)) == brute(texts)


def test_long_texts_go_in_segments(monkeypatch):
    long = "Some words, and l'été ½ 日本. " * 60 + "q" * 500 + " end of it"
    assert "".join(segments(long, 100)) == long and max(map(len, segments(long, 100))) < 700 and len(list(segments(long, 100))) > 10
    monkeypatch.setattr(alignment, "SLICE", 100)
    aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read(), 1000)
    texts = [long[:900], "short", long + "▁", "", long]
    cut = [alignment.segments, lambda t: segments(t, 100)]
    monkeypatch.setattr(alignment, "segments", cut[1])
    rows = [r for cols in alignment._rows(aligner, texts) for r in zip(*(c.to_pylist() for c in cols), strict=True)]
    want = brute(texts)
    assert [(a, b, n, n, d) for a, b, n, d, *_ in rows] == [(*w[:4], w[6]) for w in want]
    for r, w in zip(rows, want, strict=True):
        assert sum(r[5]) == w[3] and len(r[4]) == len(set(r[4])) == len(r[5])


def test_alignment_by_shuffling(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (1, "the cat"), (None, "the"), (4, None)], "doc_id long, text string")
    frames = [align_tokenizers(docs, A, B, broadcast_rows=n) for n in (0, 1000)]
    one, two = (sorted(map(tuple, f.collect()), key=repr) for f in frames)
    assert one == two and len(one) == 4
    assert align_tokenizers(docs.limit(0), A, B).count() == 0


def test_the_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert got(op12_alignment(spark, SF)) == brute([r.text for r in rows])
