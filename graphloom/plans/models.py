"""Model calls behind an interface, and the one that needs no model: rules that are the same on every machine."""

from __future__ import annotations

import re
from typing import Protocol

from graphloom.functions.vocab import LABEL, NO_ONTOLOGY, RDFS, TYPE

PROMPTS = {
    "select": "Known ontologies:\n{ontologies}\n\nText:\n{excerpt}\n\nName the one that suits the text, or none.",
    "ontology": "Ontology {name}:\n{ontology}\n\nText:\n{text}\n\n{note}Write Turtle for the classes and properties that the text needs and the ontology lacks.",
    "criticise_ontology": "Text:\n{text}\n\nProposed:\n{addendum}\n\nDoes the proposal hold only general terms that the text needs? Score 0 to 100.",
    "facts": "Ontology:\n{ontology}\n\nText:\n{text}\n\n{note}Write Turtle of what the text states, in the namespace {namespace}.",
    "summary": "Ontology:\n{ontology}\n\nGive a title and a description of a sentence or two.",
    "criticise_facts": "Text:\n{text}\n\nFacts:\n{facts}\n\nAre the facts complete and right? Score 0 to 100.",
}


class Model(Protocol):
    """Answers are plain values, so any client fits: a name; triples (s, s_kind, p, o, o_kind); a verdict and a score. An exception of a
    render call is a failed attempt."""

    def select(self, ontologies: list[str], text: str) -> str: ...

    def ontology(self, name: str, text: str, note: str | None) -> list[tuple]: ...

    def criticise_ontology(self, text: str, addendum: list[tuple], visit: int) -> tuple[bool, float, str]: ...

    def facts(self, namespace: str, text: str, note: str | None) -> list[tuple]: ...

    def criticise_facts(self, text: str, facts: list[tuple], visit: int) -> tuple[bool, float, str]: ...


class Rules:
    """Capitalised words are entities of a class for each length; each sentence links its first entity to the others. Critics pass what isn't empty, at the
    visit that the text's length names."""

    def __init__(self, vocabulary: str = "https://example.com/voc#"):
        self.voc = vocabulary

    @staticmethod
    def names(text: str) -> list[str]:
        return re.findall(r"\b[A-Z][a-zA-Z]{2,}\b", text)

    def select(self, ontologies: list[str], text: str) -> str:
        return ontologies[len(text) % len(ontologies)] if ontologies else NO_ONTOLOGY

    def ontology(self, name: str, text: str, note: str | None) -> list[tuple]:
        return [(f"{self.voc}Term{n}", "iri", TYPE, RDFS + "Class", "iri") for n in sorted({len(x) for x in self.names(text)})]

    def criticise_ontology(self, text: str, addendum: list[tuple], visit: int) -> tuple[bool, float, str]:
        ok = visit > len(text) % 2
        return ok, 100.0 if ok else 50.0, "" if ok else "terms are missing"

    def facts(self, namespace: str, text: str, note: str | None) -> list[tuple]:
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            found = list(dict.fromkeys(self.names(sentence)))
            for x in found:
                out += [(namespace + x, "iri", TYPE, f"{self.voc}Term{len(x)}", "iri"), (namespace + x, "iri", LABEL, x, "literal")]
            out += [(namespace + found[0], "iri", f"{self.voc}with", namespace + x, "iri") for x in found[1:]]
        return list(dict.fromkeys(out))

    def criticise_facts(self, text: str, facts: list[tuple], visit: int) -> tuple[bool, float, str]:
        ok = bool(facts) and visit > len(text) % 4
        return ok, 100.0 if ok else 60.0, "" if ok else "facts are missing"
