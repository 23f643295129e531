import random
from itertools import combinations

from stammwerk.llm import name_links as nl

LINES = ["spedition", "logistik", "kunststofftechnik", "gebaeudereinigung", "trading"]
READER = nl.NameReader(LINES)


def same(a, b, person=False):
    return nl.names_agree(READER.read(a, person), READER.read(b, person))


def test_firm_variants():
    base = "Dadrelkazig Spedition KG"
    for other in ("DADRELKAZIG SPED.", "Dadrelkazigspedition KG", "Spedition Dadrel Kazig", "Fa. Dadrelkazg Spedition K.G.", "Dadrel-Kazig Speditions GmbH & Co. KG", "Dadrelkazig"):
        assert same(base, other), other
    for other in ("Dadrelkazig Logistik KG", "Bomunderov Spedition KG", "Dadrelkazig & Bomunderov Spedition KG"):
        assert not same(base, other), other
    assert same("Gropellaeck & Wimund Trading Ltd.", "Trade Wimund u. G.") and same("Eiilmvenmann KS-Technik", "Eiilmvenman Kunststoff-Technik LTD") and same("Fapelperweg geb.-reinigung", "Fapelperweg Gebäudereinigung OHG")


def test_person_variants():
    base = "Theodor Ulsornnehof"
    for other in ("ULSORNNEHOF, T.", "Teo Ulsornnehof", "Dr. Theo Ulsornehof", "Theodor Wilhelm Ulsornnehof", "z.Hd. Thoedor Ulsornnehof"):
        assert same(base, other, True), other
    for other in ("Robert Ulsornnehof", "Theodor Bavarkmind", "U. Ulsornnehof"):
        assert not same(base, other, True), other
    assert same("Wilhelm Klugormokamp-Radornwigard", "Willy Klugormokamp", True)


def test_evidence():
    full = ("haupt", "12a", "12345", "koeln", "de123456789")
    agree = [("haupt", "12a", "12354", "koeln", ""), ("", "", "12345", "koeln", ""), ("haupt", "12a", "", "", ""), ("weg", "1", "99999", "bonn", "de123456798"), ("", "", "", "koeln", "")]
    differ = [("weg", "1", "12345", "koeln", ""), ("haupt", "12b", "12345", "koeln", ""), ("", "", "99999", "koeln", ""), ("haupt", "12a", "99999", "bonn", ""), ("", "", "", "", "")]
    assert all(nl.evidence_agrees(full, x) for x in agree) and not any(nl.evidence_agrees(full, x) for x in differ)
    assert nl.street_parts("Hauptstraße 12 a") == nl.street_parts("HAUPT-STR. 12A") == nl.street_parts(" Hauptstrase  12a") == ("haupt", "12a") and nl.street_parts(None) == ("", "")


def test_distance():
    assert nl.distance("abcd", "abdc", 2) == 1 and nl.distance("abcd", "axcd", 1) == 1 and nl.distance("abc", "xyz", 1) == 2


def records(rng, n):
    syllables = "ba ko rin tel mu sar vo ged pil han dor wex".split()
    out = []
    for i in range(n):
        stem = "".join(rng.sample(syllables, 5)).capitalize()
        line = rng.choice(["Spedition", "Logistik", "Trading"])
        place = (f"{rng.choice(['Haupt', 'Garten', 'Berg'])}straße {rng.randint(1, 40)}", f"{rng.randint(10000, 99999)}", "Köln")
        out.append((f"{i}-0", f"{stem} {line} GmbH", *place, None))
        for k in range(1, rng.choice([1, 2, 3, 4])):
            at = rng.randrange(1, len(stem) - 1)
            typo = stem[:at] + stem[at + 1] + stem[at] + stem[at + 2 :]
            street, post, city = place
            gap = rng.choice([0, 1, 2])
            out.append((f"{i}-{k}", rng.choice([f"{line} {typo}", f"{typo.upper()} {line.upper()} GMBH", f"{stem}{line.lower()} Ltd."]), street if gap != 0 else street.replace("straße", "str."), post if gap != 1 else None, city if gap != 2 else None, None))
    return out


def test_recall_against_brute_force(spark):
    rows = [(*r, False) for r in records(random.Random(8), 150)]
    rows += [("x1", None, "Weg 1", "11111", "Bonn", None, None), ("x2", "  ", "Weg 1", "11111", "Bonn", None, None), (None, "Dadrel Spedition", "Weg 1", "11111", "Bonn", None, None), ("y1", "Gleich Trading", None, None, None, None, None), ("y2", "Gleich Trading", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key string, name string, street string, postcode string, city string, vat string, person boolean")
    got = {(r.key_a, r.key_b) for r in nl.entity_pairs(nl.linked_names(df)).collect()}
    reader = nl.NameReader(["spedition", "logistik", "trading"])
    plain = lambda s: "".join(c for c in nl.fold(s) if c.isalnum())
    read = [(k, reader.read(n, False), (*nl.street_parts(s), plain(p), plain(c), plain(v))) for k, n, s, p, c, v, _ in rows if k and n and n.strip()]
    links = [(a[0], b[0]) for a, b in combinations(read, 2) if nl.names_agree(a[1], b[1]) and nl.evidence_agrees(a[2], b[2])]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(b)] = find(a)
    expected = {tuple(sorted(p)) for p in combinations(sorted(parent), 2) if find(p[0]) == find(p[1])}
    assert len(expected) > 100 and got <= expected and len(got) >= 0.98 * len(expected)
    assert nl.linked_names(df.limit(0)).count() == 0


def test_recall_with_gaps_on_both_sides(spark):
    rng = random.Random(21)
    kinds = {
        "city": ((None, "{p}", "Niedervarden"), ("{s}", None, "Niedervarden")),
        "street": (("{s}", None, "Bonn"), ("{s}", "{p}", None)),
        "postcode": ((None, "{p}", "Bonn"), ("{s}", "{p}", None)),
        "misspelled": (("{s}", "{p}", "Niedervarden"), ("x{s}", "{p}", "Niedervadren")),
    }
    rows, expected = [], {kind: set() for kind in kinds}
    for kind, sides in kinds.items():
        for i in range(150):
            stem = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
            at = rng.randrange(1, 9)
            typo = stem[:at] + stem[at + 1] + stem[at] + stem[at + 2 :] if i % 2 else stem[:at] + "w" + stem[at + 1 :]
            street, post = f"Weg {i + 1}", f"{rng.randint(10000, 99999)}"
            for side, (name, place) in enumerate(zip((stem, typo), sides, strict=True)):
                rows.append((f"{kind}{i:03}-{side}", f"{name.capitalize()} Logistik GmbH", *(t and t.format(s=street, p=post) for t in place), None, False))
            expected[kind].add((f"{kind}{i:03}-0", f"{kind}{i:03}-1"))
    df = spark.createDataFrame(rows, "key string, name string, street string, postcode string, city string, vat string, person boolean")
    got = {(r.key_a, r.key_b) for r in nl.entity_pairs(nl.linked_names(df)).collect()}
    for kind, pairs in expected.items():
        assert len(got & pairs) >= 0.9 * len(pairs), (kind, len(got & pairs))


def test_exact_copies(spark):
    df = spark.createDataFrame([(f"{i:02}", "Dadrelkazig Spedition KG", "Weg 1", "11111", "Bonn", None, False) for i in range(12)], "key string, name string, street string, postcode string, city string, vat string, person boolean")
    assert {r.entity for r in nl.linked_names(df).collect()} == {"00"} and nl.entity_pairs(nl.linked_names(df)).count() == 66


def test_pairs_of_buckets_like_brute_force(spark, monkeypatch):
    from stammwerk.session import Scratch

    monkeypatch.setattr(nl, "CELL", 30)
    rng = random.Random(8)
    rows = [(rng.randint(0, 100), rng.randint(0, 40)) for _ in range(600)] + [(7, i) for i in range(300)] + [(900, i) for i in range(31)] + [(901, 5), (901, 5)]
    held = {}
    for b, i in rows:
        held.setdefault(b, set()).add(i)
    expected = {p for ids in held.values() for p in combinations(sorted(ids), 2)}
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [tuple(r) for r in nl.met_in_buckets(spark.createDataFrame(rows, "bucket long, id long"), Scratch(spark, "t")).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(set(got)) and set(got) == expected


def test_tasks_need_no_package(tmp_path):
    """Functions travel by value: a worker without the package on its path links names all the same."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = (
        f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})\n"
        "from stammwerk.session import get_session\nfrom stammwerk.llm import name_links as nl\n"
        "spark = get_session('local[2]', 2)\n"
        "df = spark.createDataFrame([('a', 'Dadrelkazig Spedition KG', 'Weg 1', '11111', 'Bonn', '', False), ('b', 'Dadrelkazg Spedition', 'Weg 1', '11111', 'Bonn', '', False)], 'key string, name string, street string, postcode string, city string, vat string, person boolean')\n"
        "print(sorted(tuple(r) for r in nl.linked_names(df).collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("[('a', 'a'), ('b', 'a')]"), done.stderr[-2000:]
