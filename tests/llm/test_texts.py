import os
import random
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stammwerk.llm import bpe, leakage, shared_spans, truncation

VOCABULARY = f"{os.environ.get('STAMMWERK_TOKENIZERS', '/opt/tokenizers')}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    ranks = bpe.read_ranks(VOCABULARY)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoding_like_tiktoken(encoders, text):
    mine, theirs = encoders
    assert mine.encode(text) == theirs.encode_ordinary(text)


@needs_vocabulary
def test_long_pre_tokens_and_round_trip(encoders):
    mine, theirs = encoders
    rng = random.Random(2)
    for alphabet in ("ab", "a", string.ascii_lowercase, "äöß", "=-", " \n"):
        text = "".join(rng.choice(alphabet) for _ in range(6000))
        ids = mine.encode(text)
        assert ids == theirs.encode_ordinary(text) and theirs.decode(ids) == text
    assert mine.encode("x<|endoftext|>y") == theirs.encode_ordinary("x<|endoftext|>y")


@needs_vocabulary
def test_encode_texts(spark, encoders):
    df = spark.createDataFrame([(1, "Hello wörld", "x"), (2, "", None), (3, None, None), (1, "Hello wörld", "x"), (4, "a" * 100_000, "")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_texts(df, "doc_id", "text", VOCABULARY).collect())
    assert got == [(1, encoders[1].encode_ordinary("Hello wörld"))] * 2 + [(2, []), (3, []), (4, encoders[1].encode_ordinary("a" * 100_000))]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


@given(st.lists(st.integers(0, 300_000), min_size=1, max_size=60))
@settings(max_examples=50, deadline=None)
def test_rank_queue_pops_in_order(ranks):
    queue = bpe.RankQueue()
    for i, r in enumerate(ranks):
        queue.push(r, i)
    popped = []
    while queue.top:
        rank, entries = queue.pop()
        popped += [rank] * len(entries)
    assert popped == sorted(ranks)


ITEM = "And step 61 demands 348 units of Grün Haus ledger applies to Kaquar under clause 38 whereas"


def leaks(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id, r.edits) for r in leakage.leaked(docs, "doc_id", "text", spark.createDataFrame(items, "item_id int, item_text string"), "item_id", "item_text", **options).collect())


def test_leakage(spark):
    body = "lorem " * 30
    part = " ".join(ITEM.split()[2:14])
    texts = [body + ITEM, body + part.upper().replace("GRÜN", "gruen") + "!", " ".join(ITEM.split()[2:13]), "", None, ITEM.replace("ledger", "book"), (body * 500) + ITEM.replace(" ", "\n- ")]
    items = [(1, ITEM), (2, ITEM), (3, "too short"), (4, None)]
    assert leaks(spark, texts, items) == [(d, i, 0) for d in (0, 1, 6) for i in (1, 2)]
    near = leaks(spark, texts, items, max_edits=2, sampled=4, repetitions=12)
    assert (5, 1, 1) in near and {(d, i) for d, i, _ in near} >= {(0, 1), (1, 2), (6, 1)}
    assert leaks(spark, [], [(1, ITEM)]) == [] and leaks(spark, texts, []) == []


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_a_full_bitmap_loses_and_adds_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    assert leaks(spark, ["x " + ITEM, "lorem " * 40], [(i, ITEM) for i in range(4)]) == [(0, i, 0) for i in range(4)]


def test_one_passage_in_many_documents(spark, monkeypatch):
    import functools

    monkeypatch.setattr(leakage, "hot_keys", functools.partial(leakage.hot_keys, least=50))
    assert leaks(spark, [ITEM] * 700, [(1, ITEM)]) == [(d, 1, 0) for d in range(700)]


def test_recall_of_near_windows():
    rng, walks = random.Random(5), leakage.Walks(12, 6, 8)
    hit = 0
    for _ in range(200):
        a = [f"w{rng.randint(0, 10_000)}" for _ in range(12)]
        b = list(a)
        b[rng.randrange(12)] = "other"
        ha, hb = leakage.word_hashes(a), leakage.word_hashes(b)
        zero = np.zeros(1, np.int64)
        hit += any(walks.keys(ha, zero, r)[0] == walks.keys(hb, zero, r)[0] for r in range(8))
    assert hit >= 180  # recall of at least 0.9 at one edit


def test_recall_of_p9_near_at_two_edits(spark, tmp_path):
    from stammwerk.llm import queries

    rng = random.Random(12)
    items, documents, kinds = [], [], []
    for i in range(900):
        a = [f"w{rng.randint(0, 1_000_000)}" for _ in range(12)]
        b = list(a)
        kind = ("replaced", "dropped", "added")[i % 3]
        if kind == "replaced":
            for k in rng.sample(range(12), 2):
                b[k] = f"other{k}"
        elif kind == "dropped":
            del b[rng.randrange(12)]
            b.append("next")
        else:
            b.insert(rng.randrange(12), "new")
            b = b[:12]
        kinds.append(kind)
        items.append((i, " ".join(a)))
        documents.append((i, " ".join(b)))
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id int, item_text string").write.parquet(f"{tmp_path}/eval_item.parquet")
    got = {r.doc_id for r in queries.p9_near(spark, str(tmp_path)).collect() if r.doc_id == r.item_id}
    for kind in set(kinds):
        held = [i for i, k in enumerate(kinds) if k == kind]
        assert len(got & set(held)) >= 0.97 * len(held), kind


def test_edit_distance():
    assert leakage.edit_distance(list("abcd"), list("axcd"), 2) == 1 and leakage.edit_distance(list("abcd"), list("bcda"), 2) == 2 and leakage.edit_distance(list("ab"), list("cd"), 1) == 2


def spans(texts, k):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t or "") - k + 1):
            seen.setdefault(t[i : i + k], {}).setdefault(d, set()).add(i)
    pairs, covered = set(), {}
    for docs in seen.values():
        if len(docs) > 1:
            pairs |= {(a, b) for a in docs for b in docs if a < b}
            for d, starts in docs.items():
                covered.setdefault(d, set()).update(i + j for i in starts for j in range(k))
    return pairs, {d: len(c) for d, c in covered.items()}


@pytest.mark.parametrize("crowded", [0, 5000])
def test_shared_spans_like_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(shared_spans, "CROWDED", crowded)
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abäöx 😀\n") for _ in range(n))
    common, other = make(60), make(35)
    texts = [make(50) + common + make(20), common, make(10) + common[3:] + make(5) + other, other + make(40) + other, make(30), "", None, common, "a" * 90, "a" * 70 + "b", make(5) + common[:29] + "#" + common[30:]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc string")
    pairs, covered = spans(texts, 30)
    import functools

    original = shared_spans.shared_windows
    shared_spans.shared_windows = functools.partial(original, m=12)
    try:
        got = {(r.doc_a, r.doc_b) for r in shared_spans.sharing_pairs(df, "doc_id", "text", 30).collect()}
        share = {r.doc: r.shared_chars for r in shared_spans.shared_share(df, "doc_id", "text", 30).collect()}
    finally:
        shared_spans.shared_windows = original
    assert got == pairs and share == covered
    assert shared_spans.sharing_pairs(df.limit(0), "doc_id", "text", 300).count() == 0


@given(st.text(alphabet="ab", min_size=20, max_size=120))
@settings(max_examples=60, deadline=None)
def test_super_kmers_cover_every_window_once(text):
    _, _, _, start, end = shared_spans.super_kmers(text, 20, 6)
    windows = [i for s, e in zip(start, end, strict=True) for i in range(s, e - 20 + 1)]
    assert windows == list(range(len(text) - 19))


def test_truncation(spark):
    rng = random.Random(6)
    words = "kugelhahn verzinkt rostfrei dichtung steuerleitung vernickelt explosionsgeschützt halogenfrei".split()
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(rng.sample(words, 3))
        source = ("A", "B", "C")[i % 3]
        limit = 30
        if source == "A" and len(text) > limit:
            if text[limit] != " " and text[limit - 1] != " " and text[:limit].split()[-1] not in words:
                cut.add(i)
            text = text[:limit].rstrip()
        if source == "B" and len(text) > limit:
            text = text[: limit - 4].rsplit(" ", 1)[0] + " Stk"
        if source == "C" and len(text) > limit:  # cut with a sign behind it
            if text[27] != " " and text[26] != " " and text[:27].split()[-1] not in words:
                cut.add(i)
            text = text[:27].rstrip() + "..." if text[26] != " " else text[:26] + "."
        rows.append((i, source, text, "x"))
    rows += [(9001, "A", None, ""), (9002, "A", " ", ""), (9003, None, "kugelhahn verz", ""), (9004, "C", "kugelhahn verz.", ""), (9005, "B", "kugelhahn verz...", ""), (9006, "C", "kugelh~", "")]
    df = spark.createDataFrame(rows, "row_id long, system string, maktx string, source string")
    got = {r.row_id for r in truncation.judged(df, "row_id", "system", "maktx").filter("cut").collect()}
    assert got == cut and len(cut) > 50
    report = {r.source: r.n_cut for r in truncation.report(df, "row_id", "system", "maktx").collect()}
    assert report["A"] + report["C"] == len(cut) and report["B"] == 0 and report["C"] > 20
    assert truncation.judged(df.limit(0), "row_id", "system", "maktx").count() == 0
