import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe
from ledgerloom.llm.queries import op11_bpe

from .brute import docs, sha

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = ["the", "don't", "it's", "'", "''", "'s", "É", "é", "ß", "ſ", "İ", "ı", "µ", "²", "½", "12", "3.5", "!!", "...", "<|endoftext|>", "<|", "|>", "\x00", "\x1c", "\x85", "\xa0", "漢字", "。", "がか", "é", "́", "Σ", "ΑΣ", " ", "​", "😀", "aaaaaaaaaaaa", "\xad", "'LL", "_"]
TEXT = st.lists(st.sampled_from([*WORDS, " ", " ", "\n", "\t", "\r\n"]) | st.text(max_size=3), max_size=40).map("".join)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


SMALL = bpe.Sizes(4, 8, 40)


@given(TEXT)
@settings(max_examples=1000, deadline=None)
def test_ids_are_the_librarys(text):
    assert bpe.encoder(PATH)(text) == library(text)


def test_every_plain_character():
    encode = bpe.encoder(PATH)
    for c in map(chr, range(0x180)):
        for text in (c, f"a{c}b", f"'{c}", f"{c}'s", f" {c}1"):
            assert encode(text) == library(text), text


def test_joins_are_repaired():
    encode, rng, joins = bpe.encoder(PATH), random.Random(3), 0
    for _ in range(3000):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(1, 60)))
        cuts = bpe.ends(text, SMALL)
        spans = list(zip([0, *cuts], cuts, strict=False))
        assert "".join(text[a:b] for a, b in spans) == text
        shared = {k: bpe.encoded(encode, text[a:b]) for k, (a, b) in enumerate(spans) if rng.random() < 0.5}
        joins += bool(shared) and len(bpe.pieces_of(encode, text, cuts, shared)) > 1
        assert bpe.assembled(encode, text, cuts, shared) == library(text)
    assert joins > 500


def test_wrong_ids_at_a_join_are_not_accepted():
    encode = bpe.encoder(PATH)
    text = "one two three four five six seven eight nine ten eleven twelve"
    ids, counts = encode(text[:30]), bpe.encoded(encode, text[:30])[1]
    wrong = [*ids[: len(ids) - counts[3] - 1], 0, *ids[len(ids) - counts[3] :]]
    assert bpe.assembled(encode, text, [30, len(text)], {0: (wrong, counts)}) == library(text)


def test_cuts_follow_the_content():
    rng = random.Random(1)
    passage = "".join(chr(rng.randint(97, 122)) for _ in range(20_000))
    chunks = lambda text: {text[a:b] for a, b in zip([0, *bpe.ends(text)], bpe.ends(text), strict=False)}
    own = chunks(passage)
    assert len(own & chunks("something before it " * 9 + passage + " and after")) >= len(own) - 3
    assert max(map(len, chunks("a" * 100_000))) <= bpe.SIZES.most
    assert bpe.ends("") == []


def test_documents(spark):
    rng = random.Random(7)
    passage = " ".join(rng.choice(WORDS) for _ in range(200))
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) + (passage if i % 2 else "")) for i in range(40)]
    rows += [(100, None), (101, ""), (102, passage * 50), (102, passage * 50), (None, passage), (103, "漢" * 3000), (104, "<|endoftext|>" * 30), (105, "x" * 5000)]
    got = sorted(map(tuple, bpe.describe_documents(docs(spark, rows), PATH, SMALL).collect()), key=repr)
    want = []
    for i, text in rows:
        ids = library(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    ids = bpe.encode_documents(docs(spark, rows), PATH, SMALL)
    decoded = sorted(map(tuple, bpe.decode_documents(ids, PATH).collect()), key=repr)
    assert decoded == sorted(((i, LIBRARY.decode(library(t or ""), skip_special_tokens=False)) for i, t in rows), key=repr)


def test_shared_chunks_are_encoded_once(spark):
    passage = " ".join(f"word{i}" for i in range(300))
    texts = bpe.keyed(docs(spark, [(1, passage), (2, "x y z " + passage), (3, "alone"), (4, passage)])).select("h", "text")
    shared = bpe.shared_chunks(texts, SMALL).collect()
    assert len({r["h"] for r in shared}) == 2
    assert sum(r["owned"] for r in shared) == len({r["c"] for r in shared}) > 10


def test_empty_table(spark):
    assert bpe.describe_documents(docs(spark, []), PATH).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op11_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library(text or "")
        told = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), told, sha(LIBRARY.decode(ids, skip_special_tokens=False)))
