"""The compiled lexicon: tries of key paths, joined keys and surface forms, made to be broadcast."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from padaflow.functions import script

#: Key combinations of one form, and states of one walk.
FORM_KEYS, STATES = 32, 64
EXPANDED = "DOSAGE_FORM"
Hit = tuple[int, bool, bool]  # entry, weak, english


@dataclass(frozen=True)
class Entry:
    id: str
    label: str
    subtype: str
    canonical: str
    devanagari: str
    synonyms: tuple[str, ...] = ()
    hindi: tuple[str, ...] = ()
    english: tuple[str, ...] = ()
    definition: str = ""
    botanical: str = ""
    xrefs: tuple[str, ...] = ()
    requires_context: str = ""
    notes: str = ""
    source: str = ""

    @property
    def compose_only(self) -> bool:
        return self.requires_context == "compose"

    def metadata(self) -> dict[str, Any]:
        """Only what is there; weak marks are taken off."""
        plain = {"english": [x.lstrip("~") for x in self.english], "hindi": [x.lstrip("~") for x in self.hindi], "botanical": self.botanical, "xrefs": list(self.xrefs), "definition": self.definition, "source": self.source}
        return {k: v for k, v in plain.items() if v}

    def to_dict(self) -> dict[str, Any]:
        own = {k: getattr(self, k) for k in ("id", "label", "subtype", "canonical", "devanagari")}
        return own | {"synonyms": [x.lstrip("~") for x in self.synonyms]} | self.metadata()


class Trie:
    """Key paths as numbered nodes; a node's hits are of the path that ends there."""

    def __init__(self) -> None:
        self.edges: dict[tuple[int, str], int] = {}
        self.hits: dict[int, dict[int, Hit]] = {}
        self.size = 1

    def add(self, path: tuple[str, ...], hit: Hit) -> None:
        node = 0
        for key in path:
            if (node, key) not in self.edges:
                self.edges[node, key] = self.size
                self.size += 1
            node = self.edges[node, key]
        keep(self.hits.setdefault(node, {}), hit)

    def find(self, path: tuple[str, ...]) -> list[Hit]:
        node: int | None = 0
        for key in path:
            node = self.edges.get((node, key))
            if node is None:
                return []
        return list(self.hits.get(node, {}).values())


def keep(slot: dict[int, Hit], hit: Hit) -> None:
    """The first hit of an entry stays, unless it is weak and a later one isn't."""
    if hit[0] not in slot or slot[hit[0]][1] and not hit[1]:
        slot[hit[0]] = hit


@dataclass
class Lexicon:
    entries: list[Entry]
    version: str = "uncached"
    strict: Trie = field(default_factory=Trie)
    loose: Trie = field(default_factory=Trie)
    joined: dict[str, dict[int, Hit]] = field(default_factory=lambda: defaultdict(dict))
    surface: dict[str, set[int]] = field(default_factory=lambda: defaultdict(set))
    by_id: dict[str, int] = field(default_factory=dict)
    longest: int = 1
    phrases: dict[tuple[str, ...], int] = field(default_factory=dict)
    #: Letters of the joined keys: a node maps a letter to a node, and "" marks the end of a key.
    spelled: dict = field(default_factory=dict)
    #: How the keys that a candidate can begin with begin: up to three letters of strict and joined ones, up to two of loose ones.
    heads: set[str] = field(default_factory=set)
    loose_heads: set[str] = field(default_factory=set)
    #: Words met so far, and whether a candidate can begin at them.
    met: dict[str, bool] = field(default_factory=dict)

    def ends(self, text: str, start: int) -> Iterator[int]:
        """Where the joined keys that begin at ``start`` end."""
        node = self.spelled
        for i in range(start, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            if "" in node:
                yield i + 1

    def collisions(self) -> list[tuple[str, list[str]]]:
        """Keys whose strong hits have several labels, with the ids."""
        out = []
        for path in self.phrases:
            strong = [self.entries[e] for e, weak, _ in self.strict.find(path) if not weak]
            if len({e.label for e in strong}) > 1:
                out.append((" ".join(path), sorted(e.id for e in strong)))
        return sorted(out)


def fingerprint(parts: list[bytes], english: bool) -> str:
    """Of all that the result depends on, rules and suffixes included."""
    h = hashlib.sha256(f"{script.KEY_VERSION}|{english}".encode())
    for p in parts:
        h.update(hashlib.sha256(p).digest())
    return h.hexdigest()


def compile_lexicon(entries: list[Entry], forms: list[tuple[str, str, bool, bool]], version: str | None = None) -> Lexicon:
    """Build from entries and their ordered surface forms (id, text, weak, english)."""
    lex = Lexicon(entries, version or fingerprint([json.dumps(e.to_dict(), sort_keys=True).encode() for e in entries], any(f[3] for f in forms))[:12])
    lex.by_id = {e.id: i for i, e in enumerate(entries)}
    split = [(lex.by_id[i], script.words(script.normalize_str(text)), weak, english) for i, text, weak, english in forms]
    groups: dict[int, set[str]] = defaultdict(set)
    for e, ws, weak, _ in split:
        if entries[e].label == EXPANDED and len(ws) == 1 and not weak:
            groups[e] |= script.lexicon_keys(ws[0])
    same: dict[str, set[str]] = defaultdict(set)
    for keys in groups.values():
        for k in keys:
            same[k] |= keys
    for e, ws, weak, english in split:
        if not ws:
            continue
        hit = (e, weak, english)
        lex.surface[" ".join(ws).lower()].add(e)
        choices = [{script.strict_key(w)} if english else script.lexicon_keys(w) for w in ws]
        if len(ws) > 1:
            choices = [keys.union(*(same.get(k, ()) for k in keys)) for keys in choices]
        for path in itertools.islice(itertools.product(*map(sorted, choices)), FORM_KEYS):
            lex.strict.add(path, hit)
            lex.phrases.setdefault(path, e)
            if not english:
                lex.loose.add(tuple(map(script.loosen, path)), hit)
        lex.longest = max(lex.longest, len(ws))
        if not english:
            glued = "".join(ws)
            for k in script.lexicon_keys(glued) | {script.strict_key(glued, False)}:
                if len(k) >= 3:
                    keep(lex.joined[k], hit)
    for k in lex.joined:
        node = lex.spelled
        for letter in k:
            node = node.setdefault(letter, {})
        node[""] = {}
    lex.heads = {k[:3] for n, k in lex.strict.edges if n == 0} | {k[:3] for k in lex.joined}
    lex.loose_heads = {k[: 2 if len(k) > 2 else 1] for n, k in lex.loose.edges if n == 0}
    return lex
