import hashlib
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from quarry.llm.bpe import MatrixBpe, bpe_decode, bpe_encode, read_ranks
from quarry.llm.queries import op3_byte_bpe
from quarry.llm.token_counts import count_tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
CASES = ["", " ", "\n", "a", "It's we'll DON'T  x\n\n y\t ", "été 日本語 ½² ₂", "<|endoftext|>a <|endoftext|><|endoftext|>", "՘࢏\x1c", "z" * 5000, "ab " * 3000, "\U0001f600‍", "   x"]


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")


def fuzz(n=200):
    rnd = random.Random(5)
    return ["".join(rnd.choice("ab é'sre\n\t 1½<|>endoftext.,日 \x85") for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    texts = CASES + fuzz()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in count_tokens(rows(spark, [*texts, None, texts[3]]), P.path("byte_bpe_50k.json"), sample_rows=5, cache_room=20).collect()}
    for k, t in enumerate([*texts, None, texts[3]]):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)


def test_counts_of_an_empty_table(spark):
    assert count_tokens(rows(spark, ["a"]).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_encoding_equals_the_library_and_round_trips(spark):
    texts = CASES + fuzz()
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    out = bpe_encode(rows(spark, [*texts, None]), RANKS, decode=True, cache_room=50)
    got = {r.doc_id: r for r in out.collect()}
    again = {r.doc_id: bytes(r.decoded) for r in bpe_decode(out, RANKS).collect()}
    for k, t in enumerate([*texts, None]):
        assert list(got[k].ids) == lib.encode_ordinary(t or ""), repr(t)
        assert bytes(got[k].decoded) == again[k] == (t or "").encode()
    assert bpe_encode(rows(spark, ["a"]).limit(0), RANKS).count() == 0


SCRIPTS = ["汉字和かなカナ 한국어 漢字", "العربية نص ١٢٣", "नमस्ते दुनिया १२३", "emoji 👍🏽 👩‍👩‍👧 ok 🎉🎉", "𝔘𝔫𝔦 𐍈 𒀀 ₂ ½", "ไทย עברית ქართული አማርኛ", "\u3000\u1680 x\x1c\x1dy", "\U0001f600a1 \U00020000b"]


def test_other_scripts_go_through_the_tables(spark, monkeypatch):
    from quarry.llm.bpe import TextEncoder
    from quarry.llm.token_counts import TextCounter

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        counter = TextCounter(f.read(), {}, 1000)
    encoder, lib = TextEncoder(read_ranks(RANKS), 1000), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(TextEncoder, "_by_library", lambda self, text: 1 / 0)
    for t in SCRIPTS:
        assert not counter.odd(t) and counter(t) == len(tok.encode(t, add_special_tokens=False).ids)
        assert encoder([t])[0].tolist() == lib.encode_ordinary(t)


def test_every_assigned_letter_number_and_space_splits_as_in_the_libraries():
    import re
    import sys
    import unicodedata

    from quarry.llm.pretokens import splitter

    pieces, odd = splitter()
    assert odd("a\u0378") and odd("\U000e0fff") and not odd("a\ue000é\U0001f600")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    kinds = {c for c in map(chr, range(1, sys.maxunicode + 1, 7)) if unicodedata.category(c) not in ("Cn", "Cs")} | {c for c in map(chr, range(0x3100)) if unicodedata.category(c) != "Cn"}
    text = "".join(f"a{c}1{c}{c}\n" for c in sorted(kinds))
    for part in re.findall(r"(?:.*\n){1,4000}", text):
        assert pieces(part) == [part[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part)]


def test_unassigned_code_points_go_as_the_libraries_have_them(spark):
    texts = ["a\u1c89b \ua7cb1", "x\U000105c0y <|endoftext|> \U0001ccf0", "\u0378 a"]
    tok, lib = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    counts = {r.doc_id: r.n_tokens for r in count_tokens(rows(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    ids = {r.doc_id: list(r.ids) for r in bpe_encode(rows(spark, texts), RANKS).collect()}
    for k, t in enumerate(texts):
        assert counts[k] == len(tok.encode(t, add_special_tokens=False).ids) and ids[k] == lib.encode_ordinary(t)


def test_count_query_equals_the_library(spark):
    from quarry.llm.queries import op1_token_counts
    from tests.conftest import SF

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op1_token_counts(spark, SF).collect()
    assert len(found) == len(text)
    for r in found:
        n = len(tok.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[r.doc_id].encode()), n > 512)


def test_heap_and_matrix_agree():
    bpe, rnd = MatrixBpe(read_ranks(RANKS)), random.Random(1)
    pieces = [bytes(rnd.choice(b"abcdehinorst\xc3\xa9") for _ in range(rnd.randrange(1, 150))) for _ in range(300)]
    for piece, ids in zip(pieces, bpe.encode(pieces), strict=True):
        assert ids.tolist() == bpe._by_heap(piece).tolist()


def test_query_digests(spark):
    from tests.conftest import SF

    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_byte_bpe(spark, SF).collect():
        ids = lib.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
