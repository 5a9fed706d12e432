"""The namespaces and terms that operators know."""

DOMAIN = "https://example.com"
W3 = "http://www.w3.org/"
RDF = W3 + "1999/02/22-rdf-syntax-ns#"
RDFS = W3 + "2000/01/rdf-schema#"
OWL = W3 + "2002/07/owl#"
XSD = W3 + "2001/XMLSchema#"
PROV = W3 + "ns/prov#"
SCHEMA = "https://schema.org/"
TYPE, PROPERTY = RDF + "type", RDF + "Property"
LABEL, COMMENT, RANGE, DOMAIN_OF = RDFS + "label", RDFS + "comment", RDFS + "range", RDFS + "domain"
#: Prefixes that every Turtle text has; schema here is the plain http one, unlike SCHEMA.
PREFIXES = {
    "xsd": XSD,
    "rdf": RDF,
    "rdfs": RDFS,
    "owl": OWL,
    "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "http://schema.org/",
    "skos": W3 + "2004/02/skos/core#",
    "ex": "http://example.org/",
}
#: Stands for "no ontology"; a value, not a null.
NO_ONTOLOGY, NO_IRI = "_void_ontology_name", "NULL"
TRIPLES = "doc string, chunk_ord int, hid string, triple_ord bigint, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
TRIPLE = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
