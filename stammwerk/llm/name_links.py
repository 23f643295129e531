"""Variant spellings of names typed by people: candidates by MinHash banding, verified by Monge-Elkan similarity, clustered by stars.

A name is folded, freed of legal forms, titles and "Firma", and split into its partners' or family's own words (stems) and the
common words: lines of business and given names. Common words are those that stand beside many different words, at least `COMMON` of the number of names; an
abbreviation, a small misspelling or a nickname of a common word counts as it, and a common word glued to a stem is cut off.

Candidates. The padded 3-grams of the stems give BANDS bands of ROWS MinHash values. Two sets of similarity s meet in a band
with probability 1 - (1 - s ** ROWS) ** BANDS: 0.97 at 0.4 (two typing errors in a stem of ten letters), 0.05 at 0.05
(unrelated names). A band key is combined with
evidence that a pair has to share anyway: street with postcode, street with city, postcode with city, or one half of the VAT id (each
with three fifths of the bands, overlapping, so that a pair that shares all is covered by all bands); street,
postcode or city alone, for records with gaps, with BANDS bands of one more row (0.99 at 0.6 and 0.93 at 0.5, letters replaced or swapped in a stem of ten; nothing at 0.05), and the whole VAT id with SINGLE bands of one row (0.98 at a third). So a site or a name that fills a large part of
the table does not by itself make a large bucket, and exact copies are collapsed to one representative before.

Verification. Monge-Elkan: the mean over the stems of the best similarity (1 - Damerau-Levenshtein distance / length; an initial
equals a stem it begins), at least ME overall and WORST for each stem, the lines of business (given names) must not contradict; and the address
or the VAT id agrees apart from gaps and misspellings.

Clusters. Every record joins the star of its neighbour of highest degree, which contracts the links to those between stars. An entity is asked for
over links of links, so stars joined by a verified link are one entity; the stars order and shrink that work, they do not change its result.

Null and blank names, and names without a stem, link to nothing. Null keys get no row. Records equal in all compared fields are
one entity if the address or the VAT id is filled. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stammwerk.llm.components import connected_groups
from stammwerk.operators.skew import hot_keys, pairs_within, salted_join
from stammwerk.session import Scratch

BANDS, ROWS, SINGLE, ME, WORST, COMMON = 20, 2, 10, 0.78, 0.7, 0.004
#: Most entries of a bucket that are paired in one task as they come.
CELL = 256

#: Legal forms, titles and fillers (folded, without points), and nicknames of given names.
LEGAL = set(
    "gmbh mbh kg kgaa ohg ag se ug bv nv ltd limited plc llc inc corp co cokg ek ekfm ekfr kfm kfr gbr ev sarl sa srl spa "
    "kommanditges kommanditgesellschaft aktienges aktiengesellschaft gesellschaft ges mit beschr beschraenkter haftung offene handelsges handelsgesellschaft "
    "eingetragener eingetragene kaufmann kauffrau fa firma dr prof dipl herr frau hr fr mr mrs ms".split()
)
TITLES = set("dr prof dipl herr frau hr fr mr mrs ms".split())
NICKNAMES = {
    "alexander": "alex sascha xander aleksander alexandr lex", "andreas": "andi andy andre andr", "barbara": "babs baerbel barb babsi", "christine": "christa tina kristine chris christl stine",
    "elisabeth": "lisa elli elisabet lisbeth liesel sissi betty else elise", "friedrich": "fritz fred friedr frieder fredi", "gabriele": "gabi gaby gabriela", "heinrich": "heinz heini heinr heiner hein",
    "johannes": "hans hannes joh johann hansi jo", "josef": "sepp jupp joseph jos beppo", "katharina": "kathi kaethe katarina kati kathrin katja", "margarete": "grete gretel margarethe gretchen marga greta gretl rita margret",
    "maximilian": "max maxi maximillian", "michael": "micha michi michel mike", "robert": "bob rob robbie robin bert", "susanne": "susi sanne suzanne susann sus", "theodor": "theo teo theod", "wilhelm": "willi willy wilh helmut will bill",
    "thomas": "tom tommi thom", "ulrich": "uli ulli", "stefan": "steffen stephan steff", "stefanie": "steffi stephanie", "monika": "moni", "nikolaus": "klaus niko nik", "georg": "schorsch joerg", "ludwig": "lutz", "hildegard": "hilde", "matthias": "matze hias", "wolfgang": "wolf wolfi", "elisabetha": "elsbeth", "anna": "anni anne", "karl": "carl kalle", "peter": "pit", "franziska": "franzi", "benjamin": "ben", "anton": "toni", "manfred": "manni", "eduard": "edi ede",
}
OTHER_FORMS = {"trade": "trading", "hd": "handel"}
_GIVEN_OF = {nick: name for name, nicks in NICKNAMES.items() for nick in nicks.split()} | {name: name for name in NICKNAMES}


def fold(text: str | None) -> str:
    text = (text or "").lower()
    for umlaut, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = text.replace(umlaut, spelled)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_LETTERS: dict[str, int] = {}


def _letters(word: str) -> int:
    """The set of characters as bits."""
    bits = _LETTERS.get(word)
    if bits is None:
        if len(_LETTERS) > 200_000:
            _LETTERS.clear()
        bits = 0
        for c in word:
            bits |= 1 << (ord(c) & 63)
        _LETTERS[word] = bits
    return bits


def distance(a: str, b: str, limit: int) -> int:
    """Damerau-Levenshtein distance of neighbours swapped, or limit + 1 if it is greater."""
    if a == b:
        return 0
    # an edit changes the length by one and the set of characters by two at most
    if abs(len(a) - len(b)) > limit or (_letters(a) ^ _letters(b)).bit_count() > 2 * limit:
        return limit + 1
    i, n, m = 0, len(a), len(b)
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    if not a or not b:
        return len(a) + len(b)
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new[j] = best
        older, row = row, new
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def _subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


class NameReader:
    """Splits names into stems, lines of business and given names, for the common words of firms and of persons."""

    def __init__(self, common: list[str], given: list[str] = ()):
        self.given = _GIVEN_OF | {g: g for g in given if g not in _GIVEN_OF}
        self.full = sorted(set(self.given.values()))
        lines = [w for w in common if len(w) >= 5 and w not in LEGAL and w not in self.given]
        lines = [w for w in lines if not any(o != w and o.startswith(w) for o in lines)]  # abbreviations of others
        self.lines = sorted(w for w in lines if sum(o != w and o.endswith(w) for o in lines) < 2)
        self.known: dict[str, str | None] = {}
        self.called: dict[str, str | None] = {}
        self.cuts: dict[str, tuple[str, str] | None] = {}

    def given_of(self, word: str) -> str | None:
        """The given name that a word is, shortens or misspells."""
        if word not in self.called:
            if len(self.called) > 200_000:
                self.called.clear()
            found = self.given.get(word)
            if found is None and len(word) >= 4:
                close = [(distance(word, g, 2), g) for g in self.full if abs(len(word) - len(g)) <= 2]
                close = [(d, g) for d, g in close if d <= (2 if len(g) >= 8 else 1)]
                found = min(close)[1] if close else None
            self.called[word] = found
        return self.called[word]

    def read_person(self, text: str) -> tuple[tuple[str, ...], str, str]:
        """((family,), "", given names); a double name keeps its hyphen; "-" stands for no given name."""
        words = [w for w in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", text) if w not in LEGAL]
        given = [(w, self.given_of(w)) for w in words]
        exact = [w for w in words if w in self.given]
        names, family = [], []
        for w, g in given:
            if len(w) == 1 or (g and (w in exact or not exact or len(w) < 10 or distance(w, g, 1) <= 1)):
                names.append(w if len(w) == 1 else g)
            else:
                family.append(w)
        if not family:
            longest = max((w for w in words if len(w) > 1), key=len, default="")
            family, names = ([longest], [n for w, n in zip(words, names, strict=True) if w != longest]) if longest else ([], names)
        return (("".join(family),) if family else ()), "", " ".join(names) or "-"

    def line_of(self, word: str, strict: bool = False) -> str | None:
        """The line of business that a word is or misspells or, unless strict, abbreviates by leaving out letters."""
        key = ("!" if strict else "?") + word
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._line_of(word, strict)
        return self.known[key]

    def _line_of(self, word: str, strict: bool) -> str | None:
        if word in self.lines:
            return word
        if word in OTHER_FORMS and OTHER_FORMS[word] in self.lines:
            return OTHER_FORMS[word]
        if len(word) < 3:
            return None
        for line in self.lines:
            if line.startswith(word) or (len(word) >= 6 and distance(word, line, 2) <= (2 if len(line) >= 9 else 1)):
                return line
        for line in [] if strict else self.lines:
            if word[0] == line[0] and len(word) < len(line) and _subsequence(word, line) and (word[-1] == line[-1] or len(word) <= 4 or line[:3] == word[:3]):
                return line
        return None

    def glued(self, word: str) -> tuple[str, str] | None:
        """(own word, line of business) of a word that is both in one."""
        if word not in self.cuts:
            if len(self.cuts) > 200_000:
                self.cuts.clear()
            self.cuts[word] = self._glued(word)
        return self.cuts[word]

    def _glued(self, word: str) -> tuple[str, str] | None:
        for line in self.lines:
            if len(word) >= len(line) + 4:
                if word.endswith(line):
                    return word[: -len(line)], line
                if word.startswith(line):
                    return word[len(line) :], line
        for line in self.lines:
            for k in (len(line), len(line) - 1, len(line) + 1):
                if len(word) >= k + 4 and len(line) >= 7 and word[-k] == line[0] and distance(word[-k:], line, 1) <= 1:
                    return word[:-k], line
        return None

    def read(self, name: str | None, person: bool) -> tuple[tuple[str, ...], str, str]:
        """(stems, line of business, given name); texts are empty where there is none."""
        text = re.sub(r"(?<=[a-z])\.(?=[a-z-])", "", re.sub(r"\bz\.? ?hd\b\.?", " ", fold(name)))
        text = re.sub(r"['’`]", "", text)
        whole = text
        text = re.sub(r"\be\.? ?(?:k|kfm|kfr)\b\.?|\bb\.? ?v\b\.?", " ", text.replace("-", ""))
        parts = [re.findall(r"[a-z0-9]+", part) for part in re.split(r"[&+/]|\bund\b|\bu\b|\band\b", text)]
        formal = text != whole.replace("-", "") or any(w in LEGAL - TITLES for part in parts for w in part)
        parts = [[w for w in part if w not in LEGAL] for part in parts]
        words = [w for part in parts for w in part]
        if person or (not formal and len(parts) == 1 and 2 <= len(words) <= 5 and any(len(w) == 1 or self.given_of(w) for w in words) and not any(self.line_of(w) or self.glued(w) for w in words if not self.given_of(w))):
            return self.read_person(whole)
        strict = any(self.line_of(w, True) or self.glued(w) for w in words) or any(x + y in self.lines for part in parts for x, y in zip(part, part[1:], strict=False))
        cuts = [c[1] for c in map(self.glued, words) if c]
        main = next((found for found in (self.line_of(w, True) for w in words) if found), cuts[0] if cuts else "")
        line = ""
        stems: list[str] = []
        for part in parts:
            own: list[str] = []
            i = 0
            while i < len(part):
                word, both = part[i], part[i] + part[i + 1] if i + 1 < len(part) else ""
                if both in self.lines or (len(both) >= 5 and len(word) <= 3 and not self.line_of(part[i + 1], True) and self.line_of(both)) or (len(both) >= 5 and self.line_of(word) and not self.line_of(part[i + 1], True) and self.line_of(both)):
                    line, i = line or self.line_of(both), i + 2
                    continue
                found = self.line_of(word, strict) or (main if len(word) >= 4 and self.line_of(word) == main else None)
                if found:
                    line = line or found
                else:
                    cut = self.glued(word)
                    if cut:
                        line = line or cut[1]
                        own.append(cut[0])
                    else:
                        own.append(word)
                i += 1
            if own:
                stems.append("".join(own))
        if len(stems) == 2:  # a partner and his own initial or misspelling: the other partner is unknown
            short, long = sorted(stems, key=len)
            if stem_similarity(short, long) >= ME:
                stems = [long, "*"]
        return tuple(sorted(stems)), line, ""


def street_parts(street: str | None) -> tuple[str, str]:
    """(street without blanks and its kind, house number)."""
    text = fold(street).strip()
    m = re.search(r"([0-9]+) *([a-z]?)\.?$", text)
    number = m.group(1) + m.group(2) if m else ""
    name = re.sub(r"[^a-z]", "", text[: m.start()] if m else text)
    return re.sub(r"(?:strasse|strase|str)$", "", name), number


def stem_similarity(a: str, b: str) -> float:
    if len(a) == 1 or len(b) == 1:
        return 1.0 if a[0] == b[0] or "*" in (a, b) else 0.0
    longest = max(len(a), len(b))
    limit = max(1, int(longest * (1 - WORST)))
    d = distance(a, b, limit) if a <= b else distance(b, a, limit)
    return 1 - d / longest if d <= limit else 0.0


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, float]:
    """(mean, least) of the best similarity of each stem to one of the other side, the lower of both directions."""
    if not a or not b:
        return 0.0, 0.0
    one = [max(stem_similarity(x, y) for y in b) for x in a]
    two = [max(stem_similarity(x, y) for x in a) for y in b]
    return min(sum(one) / len(one), sum(two) / len(two)), min(one + two)


def _one_given(a: str, b: str) -> bool:
    if a == b:
        return True
    return (len(a) == 1 or len(b) == 1) and a[0] == b[0]


def same_given(a: str, b: str) -> bool:
    """Whether two lists of given names (separated by blanks, "-" for none) can be one person's: the first ones agree, and so do the second ones where both are there."""
    if a == "-" or b == "-":
        return True
    return all(_one_given(x, y) for x, y in zip(a.split(), b.split(), strict=False))


def same_family(a: str, b: str) -> bool:
    whole = stem_similarity(a.replace("-", ""), b.replace("-", ""))
    if whole >= ME or "-" not in a + b:
        return whole >= ME
    one, two = [p for p in a.split("-") if len(p) >= 4], [p for p in b.split("-") if len(p) >= 4]
    shorter, longer = sorted((one, two), key=len)
    return len(shorter) == 1 and len(longer) > 1 and any(stem_similarity(shorter[0], x) >= ME for x in longer)


def names_agree(a: tuple, b: tuple) -> bool:
    """a and b are (stems, line, given); given is empty for firms only."""
    if bool(a[2]) != bool(b[2]):
        return False
    if a[2]:
        return same_given(a[2], b[2]) and same_family(a[0][0], b[0][0])
    if len(a[0]) != len(b[0]) or (a[1] and b[1] and a[1] != b[1]):
        return False
    if not any(len(x) > 1 and len(y) > 1 and stem_similarity(x, y) >= WORST for x in a[0] for y in b[0]):
        return False
    mean, least = monge_elkan(a[0], b[0])
    return mean >= ME and least >= WORST


def _near(a: str, b: str) -> bool | None:
    if not a or not b:
        return None
    return a == b or distance(min(a, b), max(a, b), 1) <= 1


def evidence_agrees(a: tuple, b: tuple) -> bool:
    """a and b are (street, number, postcode, city, vat)."""
    if a[4] and b[4] and _near(a[4], b[4]):
        return True
    street: bool | None = None
    if (a[0] or a[1]) and (b[0] or b[1]):
        street = a[1] == b[1] and _near(a[0], b[0]) is not False
    post, city = _near(a[2], b[2]), _near(a[3], b[3])
    if street is False:
        return False
    if street:
        return post is not False or city is True
    return (post is True and city is not False) or (post is None and city is True)


def _common_words(df: DataFrame) -> tuple[list[str], list[str]]:
    """Words that stand beside many others: for firms beside as many as COMMON of the distinct names, for persons five times that.

    So a single name stays a name however many records hold it, and there are never more than (words per name) / COMMON of each."""
    folded = F.lower("name")
    for umlaut, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(umlaut), F.lit(spelled))
    names = df.select(F.coalesce("person", F.lit(False)).alias("person"), F.array_distinct(F.regexp_extract_all(folded, F.lit("([a-z]{4,})"), 1)).alias("_w")).distinct()
    each = names.select("person", "_w", F.explode("_w").alias("w"))
    beside = F.array_max(F.transform(F.filter("_w", lambda x: x != F.col("w")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    counted = each.select("person", "w", F.coalesce(beside, F.lit("")).alias("beside")).distinct().groupBy("person", "w").agg(F.count(F.lit(1)).alias("n"))
    total = names.groupBy("person").agg(F.count(F.lit(1)).alias("_all"))
    share = F.when(F.col("person"), F.lit(5 * COMMON)).otherwise(F.lit(COMMON))
    kept = counted.join(F.broadcast(total), "person").filter((F.col("n") >= 5) & (F.col("n") >= F.col("_all") * share)).select("person", "w").collect()
    persons = sorted(r.w for r in kept if r.person)
    return sorted(r.w for r in kept if not r.person and r.w not in persons), persons


def read_records(df: DataFrame, common: tuple[list[str], list[str]]) -> DataFrame:
    """Parsed records; df has key, name, street, postcode, city, vat, person."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = NameReader(*common)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "stems", "line", "given", "street", "number", "postcode", "city", "vat")}
            for r in batch.to_pylist():
                stems, line, given = reader.read(r["name"], bool(r["person"]))
                street, number = street_parts(r["street"])
                plain = lambda s: re.sub(r"[^a-z0-9]", "", fold(s))
                for name, value in zip(out, (r["key"], "|".join(stems), line, given, street, number, plain(r["postcode"]), plain(r["city"]), plain(r["vat"])), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in out.values()], names=list(out))

    return df.mapInArrow(run, "key string, stems string, line string, given string, street string, number string, postcode string, city string, vat string")


def band_keys(records: DataFrame) -> DataFrame:
    """(bucket, id) for every band and piece of evidence of parsed records with an id."""
    seeds = np.random.default_rng(5).integers(1, 2**63, size=(1, BANDS * (ROWS + 1)), dtype=np.uint64) | np.uint64(1)
    factors = np.random.default_rng(6).integers(1, 2**63, size=ROWS, dtype=np.uint64) | np.uint64(1)

    half = 3 * BANDS // 5
    first, last, middle = slice(0, half), slice(BANDS - half, BANDS), slice((BANDS - half) // 2, (BANDS - half) // 2 + half)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                yield keyed(batch.iloc[begin : begin + 2000])

    def keyed(part: pd.DataFrame) -> pd.DataFrame:
        grams = [sorted({g for stem in s.replace("-", "").split("|") if len(stem) > 1 for p in (f"^^{stem}$$",) for g in (p[i : i + 3] for i in range(len(p) - 2))}) for s in part.stems]
        counts = np.array([len(gs) for gs in grams], dtype=np.int64)
        x = pd.util.hash_array(np.array([g for gs in grams for g in gs], dtype=object))[:, None] * seeds if counts.sum() else np.zeros((0, BANDS * (ROWS + 1)), np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        good = np.flatnonzero(counts)
        least = np.minimum.reduceat(x, (np.cumsum(counts) - counts)[good], axis=0) if len(good) else x
        bands = (least[:, : BANDS * ROWS].reshape(len(good), BANDS, ROWS) * factors).sum(axis=2, dtype=np.uint64)
        texts: list[str] = []
        owner: list[int] = []
        which: list[int] = []
        for k, row in enumerate(part.iloc[good].itertuples(index=False)):
            street = f"{row.street}#{row.number}" if row.street or row.number else ""
            post = "".join(sorted(row.postcode))  # neighbours swapped are a frequent slip
            cut = len(row.vat) // 2 + 1
            for code, text in (
                (0, street and post and f"sp{street}|{post}"), (1, street and row.city and f"sc{street}|{row.city}"), (2, post and row.city and f"pc{post}|{row.city}"),
                (0, row.vat and f"v{row.vat[:cut]}"), (1, row.vat and f"w{row.vat[cut:]}"),
                (4, street and f"S{street}"), (4, post and f"P{post}"), (4, row.city and f"C{row.city}"), (5, row.vat and f"V{row.vat}"),
            ):
                if text:
                    texts.append(text)
                    owner.append(k)
                    which.append(code)
        proof = pd.util.hash_array(np.array(texts, dtype=object)) if texts else np.zeros(0, np.uint64)
        rows, code, ids = np.array(owner, dtype=np.int64), np.array(which), part.id.to_numpy()[good]
        keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for c, used in enumerate((first, last, middle)):
            at = np.flatnonzero(code == c)
            made = bands[rows[at], used] + proof[at, None] * np.uint64(0x9E3779B97F4A7C15)
            keys.append(made.ravel())
            own.append(np.repeat(ids[rows[at]], half))
        at = np.flatnonzero(code == 4)
        longer = bands * np.uint64(3) + least[:, BANDS * ROWS :]
        keys.append((longer[rows[at]] + proof[at, None] * np.uint64(0x9E3779B97F4A7C15)).ravel())
        own.append(np.repeat(ids[rows[at]], BANDS))
        at = np.flatnonzero(code == 5)
        keys.append((least[:, : BANDS * ROWS : ROWS][:, :SINGLE][rows[at]] + proof[at, None] * np.uint64(0x9E3779B97F4A7C15)).ravel())
        own.append(np.repeat(ids[rows[at]], SINGLE))
        return pd.DataFrame({"bucket": np.concatenate(keys).view(np.int64), "id": np.concatenate(own).astype(np.int64)})

    return records.select("id", "stems", "street", "number", "postcode", "city", "vat").mapInPandas(run, "bucket long, id long")


def met_in_buckets(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct pairs (a, b), a smaller, of ids that meet in a bucket of keys (bucket, id). The keys cross the network once.

    A bucket is paired in the task that holds it, unless it has more than CELL entries: then its entries leave the task as they are and
    are paired in cells of bounded size."""

    def paired(bucket: np.ndarray, ids: np.ndarray, out: list) -> None:
        for d in range(1, CELL):
            same = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(same):
                return
            x, y = ids[same], ids[same + d]
            good = x != y
            out.append((np.minimum(x, y)[good], np.maximum(x, y)[good]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(pairs: list, crowd: list) -> pa.RecordBatch:
            n, m = sum(len(p[0]) for p in pairs), sum(len(c[0]) for c in crowd)
            first = np.concatenate([p[0] for p in pairs] + [c[1] for c in crowd] or [np.zeros(0, np.int64)])
            second = np.concatenate([p[1] for p in pairs] + [np.zeros(m, np.int64)])
            which = np.concatenate([np.zeros(n, np.int64)] + [c[0] for c in crowd])
            lone = np.arange(n + m) >= n
            return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64)), pa.array(second.astype(np.int64), mask=lone), pa.array(which.astype(np.int64), mask=~lone)], names=["a", "b", "bucket"])

        bucket, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        crowded = None  # the bucket whose entries are passed on
        for batch in batches:
            bucket, ids = np.r_[bucket, batch.column(0).to_numpy()], np.r_[ids, batch.column(1).to_numpy()]
            if not len(bucket):
                continue
            pairs, crowd = [], []
            size = np.diff(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]))
            many = np.repeat((size > CELL) | (bucket[np.cumsum(size) - size] == crowded), size)
            crowd.append((bucket[many], ids[many]))
            crowded = int(bucket[-1]) if many[-1] else None
            bucket, ids = bucket[~many], ids[~many]
            whole = len(bucket) if crowded is not None or not len(bucket) else int(np.flatnonzero(bucket == bucket[-1])[0])
            paired(bucket[:whole], ids[:whole], pairs)
            bucket, ids = bucket[whole:], ids[whole:]
            yield given(pairs, crowd)
        pairs = []
        paired(bucket, ids, pairs)
        yield given(pairs, [])

    met = scratch.write(keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, bucket long").distinct())
    crowds = pairs_within(met.filter("b IS NULL").select("bucket", F.col("a").alias("id")), ["bucket"], "id").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return met.filter("b IS NOT NULL").select("a", "b").unionByName(crowds).distinct()


def _verify(pairs: DataFrame) -> DataFrame:
    fields = ("stems", "line", "given", "street", "number", "postcode", "city", "vat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left = list(zip(*(batch.column(f"a_{f}").to_pylist() for f in fields), strict=True))
            right = list(zip(*(batch.column(f"b_{f}").to_pylist() for f in fields), strict=True))
            good = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if names_agree((tuple(x[0].split("|")), x[1], x[2]), (tuple(y[0].split("|")), y[1], y[2])) and evidence_agrees(x[3:], y[3:])]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def star_clusters(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, cluster) of the records in links (a, b)."""
    both = scratch.write(links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    ranked = both.join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b").groupBy("a").agg(F.max(F.struct("db", (-F.col("b")).alias("nb"))).alias("best")).join(degree, "a")
    own = F.struct(F.col("d").alias("db"), (-F.col("a")).alias("nb"))
    star = scratch.write(ranked.select("a", (-F.greatest(F.col("best"), own)["nb"]).alias("center")))
    across = both.join(star.select("a", F.col("center").alias("ca")), "a").join(star.select(F.col("a").alias("b"), F.col("center").alias("cb")), "b").filter("ca <> cb").select("ca", "cb").distinct()
    merged = connected_groups(across, "ca", "cb").select(F.col("key").cast("long").alias("center"), F.col("group").cast("long").alias("cluster"))
    return star.join(merged, "center", "left").select(F.col("a").alias("id"), F.coalesce("cluster", "center").alias("cluster"))


def linked_names(df: DataFrame) -> DataFrame:
    """(key, entity): the records that have at least one other record of their entity. df has key, name, street, postcode, city, vat, person."""
    scratch = Scratch(df.sparkSession, "names")
    rows = df.filter("key IS NOT NULL AND trim(name) <> ''")
    parsed = scratch.write(read_records(rows, _common_words(rows)))
    fields = ["stems", "line", "given", "street", "number", "postcode", "city", "vat"]
    usable = parsed.filter("stems <> '' AND (street <> '' OR postcode <> '' OR city <> '' OR vat <> '')")
    classes = scratch.write(usable.groupBy(*fields).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    pairs = met_in_buckets(band_keys(classes), scratch)
    side = lambda p: classes.select(F.col("id").alias(p), *(F.col(f).alias(f"{p}_{f}") for f in fields))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{p}_{f}" for p in "ab" for f in fields))
    # what `names_agree` asks for without looking at letters: both firms or both persons, as many stems, no two lines of business
    firm = F.col("a_given") == ""
    may = (firm == (F.col("b_given") == "")) & (~firm | ((F.size(F.split("a_stems", r"\|")) == F.size(F.split("b_stems", r"\|"))) & ((F.col("a_line") == "") | (F.col("b_line") == "") | (F.col("a_line") == F.col("b_line")))))
    clusters = star_clusters(scratch.write(_verify(full.filter(may))), scratch)
    placed = classes.join(clusters, "id", "left").filter("cluster IS NOT NULL OR n > 1").withColumn("cluster", F.coalesce("cluster", "id"))
    same = [F.col(f"p.{f}") == F.col(f"c.{f}") for f in fields]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    members = scratch.write(usable.alias("p").join(placed.alias("c"), condition).select("p.key", F.col("c.cluster").alias("cluster")))
    names = members.groupBy("cluster").agg(F.min("key").alias("entity"))
    return scratch.write(salted_join(members, names, "cluster", hot_keys(members, "cluster"), F.col("key")).select("key", "entity"))


def entity_pairs(members: DataFrame) -> DataFrame:
    """(key_a, key_b), a before b, of all records of one entity."""
    return pairs_within(members.distinct(), ["entity"], "key").select("key_a", "key_b").distinct()
