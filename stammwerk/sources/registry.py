"""Known tables and fields: headers to technical names, files to tables."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from pathlib import Path


def header_normalise(text: str) -> str:
    """Umlauts spelled out, accents and everything but letters and digits dropped, upper case, and AE, OE, UE, SS shortened: so both spellings meet."""
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("ß", "ss"), ("ẞ", "SS")):
        text = text.replace(letter, spelled)
    plain = "".join(c for c in unicodedata.normalize("NFKD", text).upper() if c.isascii() and c.isalnum())
    for long, short in (("AE", "A"), ("OE", "O"), ("UE", "U"), ("SS", "S")):
        plain = plain.replace(long, short)
    return plain


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "char"
    length: int | None = None
    alpha: int | None = None
    aliases: tuple[str, ...] = ()
    pii: bool = False


@dataclass
class Table:
    name: str
    fields: dict[str, Field]
    key: tuple[str, ...] = ()
    area: str = ""
    tier: str = "could"
    _index: dict[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        for f in self.fields.values():
            for name in (f.name, *f.aliases):
                self._index.setdefault(header_normalise(name), f.name)

    def map_headers(self, headers: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
        """Header -> technical name; unknown headers keep theirs; a second header of a field gets _2, _3."""
        taken: dict[str, int] = {}
        out: dict[str, str] = {}
        for header in headers:
            name = (overrides or {}).get(header) or self._index.get(header_normalise(header), header)
            taken[name] = taken.get(name, 0) + 1
            out[header] = name if taken[name] == 1 else f"{name}_{taken[name]}"
        return out

    def signature_score(self, headers: list[str]) -> float | None:
        """0.65 * share of known headers + 0.35 * share of the table's fields; none unless the whole key is there."""
        known = {n for n in self.map_headers(headers).values() if n in self.fields}
        if not headers or not set(self.key) <= known:
            return None
        return 0.65 * len(known) / len(headers) + 0.35 * len(known) / max(1, len(self.fields))


@dataclass(frozen=True)
class Assignment:
    table: str | None
    method: str  # manual, file name, signature or unresolved
    alternatives: tuple[tuple[str, float], ...] = ()


class Registry:
    MARGIN, LEAST = 0.05, 0.45

    def __init__(self, tables: list[Table]):
        self.tables = {t.name: t for t in tables}

    @classmethod
    def from_rows(cls, rows: list[dict]) -> Registry:
        """Rows as in the table registry_field."""
        made: dict[str, dict[str, Field]] = {}
        keys: dict[str, list[tuple[int, str]]] = {}
        for r in rows:
            name = r["table_name"].upper()
            made.setdefault(name, {})[r["field_name"]] = Field(r["field_name"], r["field_type"], r["max_length"], None, tuple(r["aliases"] or ()))
            if r["key_position"] is not None:
                keys.setdefault(name, []).append((r["key_position"], r["field_name"]))
        return cls([Table(n, f, tuple(k for _, k in sorted(keys.get(n, [])))) for n, f in made.items()])

    def by_signature(self, headers: list[str]) -> list[tuple[str, float]]:
        scored = [(t.name, s) for t in self.tables.values() if (s := t.signature_score(headers)) is not None]
        return sorted(scored, key=lambda x: (-x[1], x[0]))

    def by_file_name(self, path: str) -> str | None:
        """The longest table name in the file's stem."""
        stem = Path(path).stem.upper()
        return max((n for n in self.tables if n in stem), key=lambda n: (len(n), n), default=None)

    def assign(self, path: str, headers: list[str], manual: dict[str, str] | None = None) -> Assignment:
        """Manual before file name; a signature that contradicts the name wins; without a name the best signature, if clear enough."""
        chosen = (manual or {}).get(Path(path).name)
        ranked = self.by_signature(headers)
        if chosen:
            return Assignment(chosen, "manual", tuple(ranked))
        name = self.by_file_name(path)
        if name and (not ranked or any(t == name for t, _ in ranked)):
            return Assignment(name, "file name", tuple(ranked))
        if ranked and ranked[0][1] >= self.LEAST and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= self.MARGIN):
            return Assignment(ranked[0][0], "signature", tuple(ranked[1:]))
        return Assignment(None, "unresolved", tuple(ranked))
