import os
import re

import duckdb
import pytest

from stammwerk.llm import bpe, queries

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="the provided tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{ROOT}/{name}'")
    return con


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, duck, name):
    df = queries.queries()[name](spark, ROOT)
    assert pairs(df.select(*sorted(df.columns))) == {tuple(r) for r in duck.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({queries.SQL[name]})").fetchall()}


def test_p1(spark, duck):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for row in duck.execute("SELECT left_schluessel, right_schluessel FROM match_pairs").fetchall():
        a, b = (k and (k.strip(" ").zfill(18) if re.fullmatch("[0-9]+", k.strip(" ")) else k.strip(" ")) for k in row)
        if a and b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert pairs(queries.p1_found(spark, ROOT)) == {(find(k), k) for k in parent}


@pytest.mark.skipif(not os.path.exists(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")
def test_p8(spark, duck):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
    expected = {d: own.encode_ordinary(t or "") for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.ids for r in queries.p8_ids(spark, ROOT).collect()} == expected


def test_the_others_hold_together(spark):
    cut = pairs(queries.p5_found(spark, ROOT))
    report = queries.p5_report(spark, ROOT).collect()
    assert sum(r.n_cut for r in report) == len(cut) > 0
    linked = pairs(queries.p7_found(spark, ROOT))
    entity = {r.schluessel: r.entity_id for r in queries.p7_entities(spark, ROOT).collect()}
    assert linked and all(a < b and entity[a] == entity[b] for a, b in linked)
    near, exact = {(r.doc_id, r.item_id): r.edits for r in queries.p9_near(spark, ROOT).collect()}, pairs(queries.p9_found(spark, ROOT))
    assert {k for k, e in near.items() if e == 0} == exact
    classes = {}
    for r in queries.p10_classes(spark, ROOT).collect():
        classes.setdefault((r.class_id, r.n_documents), set()).add(r.doc_id)
    assert all(len(docs) == n > 1 for (_, n), docs in classes.items())
    assert {(a, b) for docs in classes.values() for a in docs for b in docs if a < b} == pairs(queries.p10_found(spark, ROOT))
    share = {r.doc_id: r.share for r in queries.p10_share(spark, ROOT).collect()}
    assert set(share) == {d for p in pairs(queries.p10_found(spark, ROOT)) for d in p} and all(0 < s <= 1 for s in share.values())
