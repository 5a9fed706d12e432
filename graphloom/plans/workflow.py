"""The bounded-retry workflow of a chunk: select, render and criticise the ontology, render facts, split, criticise facts.

Documents run side by side and a document's chunks in order within its group, since each sees the ontology as the one
before left it. Across documents the registry is that of the batch's start. Every node that is counted succeeds by force at its max_visits-th
visit, so a chunk makes 5 to 6 * max_visits - 1 model calls, one less if no ontology is registered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.functions.vocab import NO_ONTOLOGY
from graphloom.plans.models import Model, Rules

NODES = ("Select Ontology", "Text to Ontology", "Criticise Ontology", "Text to Facts", "Sublimate Ontology", "Criticise Facts")
#: Where a node leads, by success.
EDGES = {
    "Select Ontology": ("Text to Ontology", "Text to Ontology"),
    "Text to Ontology": ("Criticise Ontology", "Text to Ontology"),
    "Criticise Ontology": ("Text to Facts", "Text to Ontology"),
    "Text to Facts": ("Sublimate Ontology", "Text to Facts"),
    "Sublimate Ontology": ("Criticise Facts", "Criticise Facts"),
    "Criticise Facts": (None, "Text to Facts"),
}
COUNTED = {"Text to Ontology", "Criticise Ontology", "Text to Facts", "Criticise Facts"}
LOG = "doc string, chunk_ord int, step int, node string, visit int, status string, failure_stage string, failure_reason string, success_score double, ontology string, n_facts int, n_ontology int"
FACTS = "doc string, chunk_ord int, hid string, triple_ord bigint, s string, s_kind string, p string, o string, o_kind string"
ADDED = "doc string, short_name string, triple_ord bigint, s string, s_kind string, p string, o string, o_kind string"
#: One pass of the models gives all three, told apart by kind.
RUN = "kind string, " + ", ".join(dict.fromkeys(c for x in (LOG, FACTS, ADDED) for c in x.split(", ")))
GIVEN_UP = "Maximum visits exceeded"


def hid_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def is_fact(t: tuple, domain: str) -> bool:
    return t[0].startswith(domain) and t[1] == "iri" or t[2].startswith(domain) or t[4] == "iri" and t[3].startswith(domain)


def run_document(doc: str, chunks: list[str], registry: dict[str, list[tuple]], model: Model, max_visits: int, domain: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Log rows, facts, and what was added to ontologies, of one document. Chunks are named by their texts."""
    known = {k: set(v) for k, v in registry.items()}
    registry = {k: list(v) for k, v in registry.items()}
    log, facts_out, reason, stage, score = [], [], None, None, 0.0
    for k, text in enumerate(chunks):
        hid = hid_of(text)
        namespace = f"{domain}/doc/{doc}/chunk/{hid}/"
        visits = dict.fromkeys(COUNTED, 0)
        name, addendum, facts, node, step = NO_ONTOLOGY, [], [], NODES[0], 0
        while node:
            ok, note = True, reason
            visit = visits.get(node, 0) + 1
            try:
                if node == "Select Ontology":
                    name = model.select(list(registry), text) if registry else NO_ONTOLOGY
                    name = name if name in registry else NO_ONTOLOGY
                elif node == "Text to Ontology":
                    addendum = model.ontology(name, text, note)
                elif node == "Criticise Ontology":
                    # The addendum is kept whatever the verdict; without an ontology it becomes one.
                    if name == NO_ONTOLOGY and addendum:
                        name = f"ontology_{doc}"
                    registry[name] = list(dict.fromkeys(registry.get(name, []) + addendum))
                    ok, score, why = model.criticise_ontology(text, addendum, visit)
                elif node == "Text to Facts":
                    facts = list(dict.fromkeys(facts + model.facts(namespace, text, note)))
                elif node == "Sublimate Ontology":
                    registry[name] = list(dict.fromkeys(registry.get(name, []) + [t for t in facts if not is_fact(t, domain + "/doc/")]))
                    facts = [t for t in facts if is_fact(t, domain + "/doc/")]
                else:
                    ok, score, why = model.criticise_facts(text, facts, visit)
                if not ok:
                    stage, reason = f"{node} critique", why
            except (ValueError, KeyError) as e:
                if node not in ("Text to Ontology", "Text to Facts", "Sublimate Ontology"):
                    raise
                ok, stage, reason, score = False, f"{node} parse", str(e), 0.0
            if node in COUNTED:
                visits[node] = visit
                if ok:
                    stage, reason, score = None, None, 0.0 if score is None else score
                elif visit >= max_visits:
                    ok, reason, stage = True, GIVEN_UP, node  # the reason stays
            log.append((doc, k, step, node, visit, "success" if ok else "failed", stage, reason, score, name, len(facts), len(registry.get(name, []))))
            node, step = EDGES[node][0 if ok else 1], step + 1
        facts_out += [(doc, k, hid, i, *t) for i, t in enumerate(facts)]
    added = [(doc, name, i, *t) for name, ts in registry.items() for i, t in enumerate(ts) if t not in known.get(name, ())]
    return log, facts_out, added


def run_all(chunks: DataFrame, registry: dict[str, list[tuple]] | None = None, model: Callable[[], Model] = Rules, max_visits: int = 3, domain: str = "https://example.com") -> DataFrame:
    """Log, facts and added ontology triples (kind 'log', 'facts', 'added') of chunks (doc, chunk_ord, text). model() is called once a document group's task; every
    model call is made once, so write the result before it is used twice."""
    known, names = registry or {}, [c.split()[0] for c in RUN.split(", ")]

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("chunk_ord")
        parts = run_document(df.doc.iloc[0], df.text.fillna("").tolist(), known, model(), max_visits, domain)
        rows = []
        for kind, found, schema in zip(("log", "facts", "added"), parts, (LOG, FACTS, ADDED), strict=True):
            own = [c.split()[0] for c in schema.split(", ")]
            rows += [{"kind": kind} | dict(zip(own, r, strict=True)) for r in found]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return chunks.select("doc", "chunk_ord", "text").groupBy("doc").applyInPandas(one, RUN)


def of_kind(done: DataFrame, kind: str) -> DataFrame:
    schema = {"log": LOG, "facts": FACTS, "added": ADDED}[kind]
    return done.where(done.kind == kind).select(*(c.split()[0] for c in schema.split(", ")))


def run(chunks: DataFrame, registry: dict[str, list[tuple]] | None = None, model: Callable[[], Model] = Rules, max_visits: int = 3, domain: str = "https://example.com", facts: bool = False) -> DataFrame:
    """The log, or the facts, alone."""
    return of_kind(run_all(chunks, registry, model, max_visits, domain), "facts" if facts else "log")
