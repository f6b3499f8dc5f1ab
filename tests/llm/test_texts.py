import base64

import numpy as np
import pytest

from gridloom.llm import packing
from gridloom.llm.pii import Finder, find_pii, redact, widen
from gridloom.llm.tokenizer import PRE_TOKEN, VOCABULARY, Encoder, PerfectHash, encode_corpus, read_vocabulary

ODD = ["", " ", "\n\n \t x", "<|endoftext|>", "a" * 30_000, "ß日本語 ​🇨🇭👩‍👧 ½ ⅔", "don't it's 12345 $$$", "x " * 20_000, "ΑΒΓ مرحبا", " nbsp "]


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(VOCABULARY)


@pytest.fixture(scope="module")
def reference(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})


def test_perfect_hash():
    keys = [base64.b64encode(str(i).encode()) for i in range(3000)]
    h = PerfectHash(keys)
    h.ready()
    assert sorted(h.slots) == list(range(3000)) and all(h.get(k) == i for i, k in enumerate(keys)) and h.get(b"none") == -1


def test_ids_equal_the_reference(spark, data, vocabulary, reference):
    encoder = Encoder(PerfectHash(vocabulary))
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r.text]
    assert [encoder.encode(t) for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_encode_corpus(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, "x"), (None, "hi", "x"), (3, "hi", "x"), (3, "hi", "x")]
    df = spark.createDataFrame(rows, "doc long, text string, ids string")
    out = encode_corpus(df, "doc", "text").collect()
    want = sorted((i if i is not None else -1, reference.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert sorted((r.doc if r.doc is not None else -1, r.ids) for r in out) == want
    assert encode_corpus(df.limit(0), "doc", "text").count() == 0
    back = {r.doc: r.ids for r in out}
    assert all(reference.decode(back[i]) == t for i, t in enumerate(ODD) if i != 3)


def test_hilbert_curve_is_one():
    import itertools

    pts = np.array(list(itertools.product(range(8), repeat=3)))
    k = packing.hilbert_key(pts, 3)
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(pts[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_packing(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = packing.pack_texts(docs, "doc_id", "text", 512).toPandas()
    sizes = {r.doc_id: len(reference.encode_ordinary(r.text)) if r.text else 0 for r in docs.collect()}
    assert dict(out.groupby("doc_id")["n_tokens"].sum()) == sizes
    assert out.groupby("container")["n_tokens"].sum().max() <= 512
    pieces = out.groupby("doc_id")["piece"].count()
    assert all(pieces[d] == (max(1, -(-n // 512)) if n % 512 or n < 512 else n // 512 + 1) for d, n in sizes.items())
    used = (out.groupby("container")["n_tokens"].sum() > 0).sum()
    assert used <= sum(sizes.values()) / 512 * 1.05 + 2


def test_packing_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 9000, 5), (4, "word", 5), (4, "word", 5), (None, "word", 5)], "id long, text string, container int")
    out = packing.pack_texts(df, "id", "text", 64).toPandas()
    assert out.groupby("container")["n_tokens"].sum().max() <= 64 and (out["id"] == 4).sum() == 2 and out["id"].isna().sum() == 1
    assert out[out["id"] == 3]["n_tokens"].sum() == 9001 and set(out["id"].dropna()) == {1, 2, 3, 4}
    assert packing.pack_texts(df.limit(0), "id", "text", 64).count() == 0


PARTS = [(g + e, "given") for g in ("Mel", "Nim", "Tar", "Zor", "Bri", "Hal") for e in ("essu", "anda", "orel", "umar", "vo", "etha")]
PARTS += [(f + e, "family") for f in ("Zamb", "Velk", "Pirr", "Jarn", "Told", "Skav") for e in ("esko", "orth", "aric", "wick", "oru", "udal")] + [("Forest", "family"), ("Ridge", "family")]

FOUND = [
    ("mail a.b+c@post.example.org.", {("email", "a.b+c@post.example.org")}),
    ("see x_y (at) post (dot) example (dot) com, thanks", {("email", "x_y (at) post (dot) example (dot) com")}),
    ("[us](mailto:Q.W[at]post.example)", {("email", "Q.W[at]post.example")}),
    ("value at row 7 (at) fold 1 (dot) product; auc@0.87; @task3", set()),
    ("Tel: +44 20 7946 0934 ext. 12, 030/5550 070", {("phone", "+44 20 7946 0934"), ("phone", "030/5550 070")}),
    ("(fax (911) 555-0183) or 1 (503) 555 0104 or 715.555.0125", {("phone", "(911) 555-0183"), ("phone", "1 (503) 555 0104"), ("phone", "715.555.0125")}),
    ("batch 2025-10-3957, ticket 45323-75, range 693-1663, Took 4 575 510 ms, build 1.2.3.4567", set()),
    ("2025-10-22 00:10:10 0000012345678901234567890123456789", set()),
    ("SSN 917406929, (965-17-8821) and tax id 29 459 423 617", {("id_number", "917406929"), ("id_number", "965-17-8821"), ("id_number", "29 459 423 617")}),
    ("passport no. YJ9867333; DNI 27927970Y; insurance no. QQ 52 48 85 A; part no. AD-4977131", {("id_number", "YJ9867333"), ("id_number", "27927970Y"), ("id_number", "QQ 52 48 85 A")}),
    ("row QQ 79 01 46 D again, 530528-7180 but 539928-7180 and AD 79 01 46 Z", {("id_number", "QQ 79 01 46 D"), ("id_number", "530528-7180")}),
    ("at 9125-A Old Kiln Lane, Town 12345", {("street_address", "9125-A Old Kiln Lane")}),
    ("go to 1883 Brindle Rd.. Then 7 bis rue du Vieux Pressoir.", {("street_address", "1883 Brindle Rd."), ("street_address", "7 bis rue du Vieux Pressoir")}),
    ("Tolvenstr. 29 b, Calle de la Loma, 82 and C/ Torvena 137", {("street_address", "Tolvenstr. 29 b"), ("street_address", "Calle de la Loma, 82"), ("street_address", "C/ Torvena 137")}),
    ("Melanda Zambesko and J. Velkorth; Jarnoru, Nimvo", {("person_name", "Melanda Zambesko"), ("person_name", "J. Velkorth"), ("person_name", "Jarnoru, Nimvo")}),
    ("Thanks, Brivo! Mrs Halumar Q. Pirraric-Toldoru's file", {("person_name", "Brivo"), ("person_name", "Halumar Q. Pirraric-Toldoru")}),
    ("Random Forest and Ridge, 26 Ridge models, but Taretha Forest", {("person_name", "Taretha Forest")}),
]


_LONG = "Brindle" * 40
FOUND += [
    (f"to {'ab.' * 60}c@{'post-' * 30}x.{'sub' * 80}.example now", {("email", f"{'ab.' * 60}c@{'post-' * 30}x.{'sub' * 80}.example")}),
    (f"at 12 {_LONG} {_LONG} Lane, then {_LONG.capitalize()}straße 7 and 7 rue du {_LONG} de la {_LONG}, Calle {_LONG}, 82",
     {("street_address", f"12 {_LONG} {_LONG} Lane"), ("street_address", f"{_LONG.capitalize()}straße 7"), ("street_address", f"7 rue du {_LONG} de la {_LONG}"), ("street_address", f"Calle {_LONG}, 82")}),
    ("SSN 000-00-0000, 000-00-0000", set()),
    ("pay to DE89 3704 0044 0532 0130 00, not GB83 WEST 1234 5698 7654 32", {("account_number", "DE89 3704 0044 0532 0130 00")}),
    ("card 4111 1111 1111 1111, not 4111 1111 1111 1112, nor 0000 0000 0000 0000", {("account_number", "4111 1111 1111 1111")}),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_pieces(text, want):
    assert {(k, text[a:b]) for a, b, k in Finder(PARTS).find(text)} == want


def test_widened_parts():
    few = [p for p in PARTS if p[0] != "Melvo"]
    kinds, odd = widen(few)
    assert kinds["melvo"] == {"given"} and odd == {"forest", "ridge"} and "random" not in kinds
    assert widen([]) == ({}, set())


def test_find_and_redact(spark):
    rows = [(1, "mail a@b.test, a@b.test by Melanda Zambesko"), (2, None), (3, ""), (4, "   "), (5, "x " * 30_000 + "a@b.test"), (1, "mail a@b.test"), (6, "İstanbul a@b.test")]
    df = spark.createDataFrame(rows, "doc int, text string").selectExpr("*", "1 AS pii_text", "2 AS id")
    out = sorted(tuple(r) for r in find_pii(df, "doc", "text", PARTS).collect())
    assert out == [(1, "email", "a@b.test"), (1, "person_name", "Melanda Zambesko"), (5, "email", "a@b.test"), (6, "email", "a@b.test")]
    red = {(r.doc, r.n_pieces): r.text for r in redact(df, "doc", "text", PARTS).collect()}
    assert red[(1, 3)] == "mail [EMAIL], [EMAIL] by [PERSON_NAME]" and red[(2, 0)] is None and red[(3, 0)] == "" and red[(6, 1)] == "İstanbul [EMAIL]"
    assert find_pii(df.limit(0), "doc", "text", []).count() == 0
    assert find_pii(df, "doc", "text", []).count() == 3
    assert find_pii(df, "doc", "text", PARTS, ["person_name"]).count() == 1
