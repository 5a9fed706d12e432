"""Operators over triples, entities, predicates and chunks."""
