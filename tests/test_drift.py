import itertools
import random

from stammwerk.operators import schema_drift as dr

COLUMNS = "file_id long, system_id string, table_name string, extraction_date date, delimiter string, pos int, header string, name string, field_name string, field_type string, key_position int"


def make(spark, files):
    """files: (id, system, date, [(name, field, key)], rows)"""
    columns, cells = [], []
    for fid, system, date, heads, rows in files:
        columns += [(fid, system, "T", date, ";", p, n, n, f, "char", k) for p, (n, f, k) in enumerate(heads)]
        cells += [(fid, r[0] if heads and heads[0][2] else None, r) for r in rows]
    return spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(cells, "file_id long, key string, cells array<string>")


def changes(pair):
    return sorted((r.file_id, r.header, r.change, r.old_header) for r in dr.schema_changes(*pair).collect())


def test_all_kinds(spark):
    from datetime import date

    first = [[f"k{i}", f"v{i}", "20240101", "x", ""] for i in range(10)]
    second = [[f"k{i}", "01.02.2024", f"v{i}", "new"] for i in range(9)] + [["zz", "", "other", None]]
    pair = make(spark, [
        (2, "S", date(2024, 2, 1), [("K", "K", 1), ("DAY", None, None), ("OTHER", None, None), ("FRESH", None, None)], second),
        (1, "S", date(2024, 1, 1), [("K", "K", 1), ("VAL", None, None), ("DAY", None, None), ("OLD", None, None), ("EMPTY", None, None)], first),
        (3, "Q", date(2024, 1, 1), [("K", "K", 1)], []), (4, "Q", date(2024, 1, 1), [("KK", "K", 1)], []),
    ])
    assert changes(pair) == [(2, "DAY", "retyped", None), (2, "EMPTY", "removed", None), (2, "FRESH", "added", None), (2, "OLD", "removed", None), (2, "OTHER", "renamed", "VAL"), (4, "KK", "renamed", "K")]


def test_renamed_and_retyped_by_registry(spark):
    pair = make(spark, [(1, "S", None, [("K", "K", 1), ("A", "F", None)], [["1", "1,5"], ["2", ""]]), (2, "S", None, [("K", "K", 1), ("B", "F", None)], [["1", "15"], ["2", None]])])
    assert changes(pair) == [(2, "B", "renamed", "A"), (2, "B", "retyped", "A")]


def test_nothing(spark):
    pair = make(spark, [(1, None, None, [("K", None, None)], [["a"]]), (2, None, None, [("K", None, None), ("K", None, None)], [["a", "b"]])])
    assert changes(pair) == []  # without a key nothing is compared; a repeated header counts once
    assert dr.schema_changes(pair[0].limit(0), pair[1].limit(0)).count() == 0


def test_assignment_is_the_best():
    rng = random.Random(3)
    for _ in range(60):
        left, right = list("abcd")[: rng.randint(1, 4)], list("wxyz")[: rng.randint(1, 4)]
        weight = {(a, b): rng.randint(1, 9) for a in left for b in right if rng.random() < 0.7}
        edges = [(a, b, float(w)) for (a, b), w in weight.items()]
        got = sum(weight[p] for p in dr.assign(edges)) if edges else 0
        best = 0
        for k in range(min(len(left), len(right)) + 1):
            for ls in itertools.combinations(left, k):
                for rs in itertools.permutations(right, k):
                    if all(p in weight for p in zip(ls, rs, strict=True)):
                        best = max(best, sum(weight[p] for p in zip(ls, rs, strict=True)))
        assert got == best


def test_sampled_sketches_find_the_same_renames(spark):
    rng = random.Random(5)
    rows = [[f"k{i}", f"a{i}", f"b{i % 7}", str(i)] for i in range(3000)]
    later = [[r[0], r[1] if rng.random() < 0.55 else "else", r[2] if rng.random() < 0.45 else "other", r[3] + "x"] for r in rows if rng.random() < 0.9]
    pair = make(spark, [(1, "S", None, [("K", "K", 1), ("ALPHA", None, None), ("BETA", None, None), ("GAMMA", None, None)], rows), (2, "S", None, [("K", "K", 1), ("EINS", None, None), ("ZWEI", None, None), ("DREI", None, None)], later)])
    got = sorted((r.file_id, r.header, r.change, r.old_header) for r in dr.schema_changes(*pair, size=256).collect())
    assert got == [(2, "BETA", "removed", None), (2, "DREI", "added", None), (2, "EINS", "renamed", "ALPHA"), (2, "GAMMA", "removed", None), (2, "ZWEI", "added", None)]
    assert got == sorted((r.file_id, r.header, r.change, r.old_header) for r in dr.schema_changes(*pair, size=10_000).collect())
    wanted = spark.createDataFrame([(1, 1), (2, 1)], "file_id long, pos int")
    assert all(150 < len(r.sample) < 400 for r in dr.sketches(wanted, pair[1]).collect())


def test_names_decide_between_equal_values(spark):
    rows = [[str(i), "same", "same"] for i in range(5)]
    pair = make(spark, [(1, "S", None, [("K", "K", 1), ("NETTO", None, None), ("BRUTTO", None, None)], rows), (2, "S", None, [("K", "K", 1), ("BRUTTO2", None, None), ("NETTO2", None, None)], rows)])
    assert changes(pair) == [(2, "BRUTTO2", "renamed", "BRUTTO"), (2, "NETTO2", "renamed", "NETTO")]
