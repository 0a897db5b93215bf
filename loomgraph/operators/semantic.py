"""RDF projection of the property graph, triple patterns as joins, structural checks.

triples: s, p, o, o_kind ("iri" or "literal").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.lexicon import NODE_LABELS, RELATION_TYPES, Entry
from loomgraph.functions.text import slug, strip

#: The ontology's namespace: a parameter of every function that makes identifiers.
NAMESPACE = "urn:graph:v1#"
RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
# Relation, domain, range (owl:Thing where a label is none), datatype properties, equivalent classes.
AXIOMS = {
    "MENTIONS": ("Thing", "Thing"),
    "IS_SUBTYPE_OF": ("Thing", "Thing"),
    "ALTERNATIVE_TO": ("Thing", "Thing"),
    "REQUIRES": ("Thing", "Thing"),
    "PARAMETERIZED_BY": ("Thing", "Thing"),
    "SUPPORTS_RISK_MEASURE": ("PortfolioMethod", "RiskMeasure"),
    "USES_ESTIMATOR": ("PortfolioMethod", "Estimator"),
    "HAS_PARAMETER": ("Thing", "Parameter"),
    "BENCHMARKED_ON": ("BacktestScenario", "BenchmarkIndex"),
    "CALIBRATED_ON": ("Estimator", "AssetClass"),
    "PRECEDES": ("Thing", "Thing"),
    "HAS_CONSTRAINT": ("PortfolioMethod", "ConstraintType"),
    "VALIDATED_AGAINST": ("Thing", "Thing"),
    "RELATED_TO": ("Thing", "Thing"),
    "DESCRIBES": ("Thing", "Thing"),
    "DEMONSTRATES": ("Thing", "Thing"),
    "VALIDATES": ("Thing", "Thing"),
    "IMPLEMENTS": ("Thing", "Thing"),
}
DATATYPE_PROPERTIES = ["hasConfidenceLevel", "hasTargetReturn", "hasWeightUpperBound", "hasWeightLowerBound", "hasRiskBudgetFraction"]
EQUIVALENT = {
    "PortfolioMethod": "https://spec.edmcouncil.org/fibo/ontology/SEC/InvestmentStrategy",
    "RiskMeasure": "https://spec.edmcouncil.org/fibo/ontology/FBC/RiskMeasure",
    "Estimator": "http://purl.obolibrary.org/obo/STATO_0000118",
}


def node_iri(name: Column, ns: str = NAMESPACE) -> Column:
    return F.concat(F.lit(f"{ns}node/"), F.regexp_replace(strip(name), "(?U)\\s+", "_"))


def ontology(spark: SparkSession, lexicon: list[Entry], ns: str = NAMESPACE) -> DataFrame:
    """Class, property, axiom and taxonomy triples: a table of fixed size."""
    rows = []
    cls = lambda x: OWL + "Thing" if x == "Thing" else ns + x

    def declare(name: str, kind: str) -> None:
        rows.extend([(ns + name, RDF + "type", OWL + kind, "iri"), (ns + name, RDFS + "label", name, "literal")])

    for label in NODE_LABELS:
        declare(label, "Class")
    for relation in RELATION_TYPES:
        declare(relation, "ObjectProperty")
    for relation, (domain, range_) in AXIOMS.items():
        rows += [(ns + relation, RDFS + "domain", cls(domain), "iri"), (ns + relation, RDFS + "range", cls(range_), "iri")]
    for name in DATATYPE_PROPERTIES:
        declare(name, "DatatypeProperty")
        rows.append((ns + name, RDFS + "range", XSD + "float", "iri"))
    rows += [(ns + label, OWL + "equivalentClass", iri, "iri") for label, iri in EQUIVALENT.items()]
    fixed = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    if not lexicon:
        return fixed.distinct()
    table = spark.createDataFrame([(e.label, e.canonical) for e in lexicon], "label string, canonical string")
    child, parent = F.concat(F.lit(ns), slug(F.col("canonical"))), F.concat(F.lit(ns), slug(F.col("label")))
    parts = [
        table.select(parent, F.lit(RDF + "type"), F.lit(OWL + "Class"), F.lit("iri")),
        table.select(parent, F.lit(RDFS + "label"), "label", F.lit("literal")),
        table.select(child, F.lit(RDF + "type"), F.lit(OWL + "Class"), F.lit("iri")),
        table.select(child, F.lit(RDFS + "label"), "canonical", F.lit("literal")),
        table.select(child, F.lit(RDFS + "subClassOf"), parent, F.lit("iri")),
    ]
    for part in parts:
        fixed = fixed.union(part)
    return fixed.distinct()


def instances(nodes: DataFrame, edges: DataFrame, ns: str = NAMESPACE, repeats: bool = False) -> DataFrame:
    """Label, type and relation triples of nodes and edges with names; repeats: equal ones may be left, for a writer that drops them."""
    named = nodes.filter(strip(F.coalesce("name", F.lit(""))) != "")
    s = node_iri(F.col("name"), ns)
    triple = lambda p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    # Both triples of a node come from one pass over the nodes.
    own = named.select(F.inline(F.array(triple(RDFS + "label", strip(F.col("name")), "literal"), triple(RDF + "type", F.concat(F.lit(ns), "label"), "iri"))))
    full = edges.filter((strip(F.coalesce("src_name", F.lit(""))) != "") & (strip(F.coalesce("dst_name", F.lit(""))) != "") & (strip(F.coalesce("rel", F.lit(""))) != ""))
    links = full.select(node_iri(F.col("src_name"), ns), F.concat(F.lit(ns), strip(F.col("rel"))), node_iri(F.col("dst_name"), ns), F.lit("iri"))
    return own.union(links) if repeats else own.union(links).distinct()


def snapshot(nodes: DataFrame, edges: DataFrame, most_nodes: int | None = 300, most_edges: int | None = 600) -> tuple[DataFrame, DataFrame]:
    """Named nodes and edges for export, bounded (None: all), in name order."""
    n, e = nodes.filter("name IS NOT NULL"), edges.filter("src_name IS NOT NULL AND dst_name IS NOT NULL")
    return (n if most_nodes is None else n.orderBy("label", "name").limit(most_nodes), e if most_edges is None else e.orderBy("src_name", "rel", "dst_name", "src_label").limit(most_edges))


def labelled_links(triples: DataFrame, predicate: str, source: str, target: str) -> DataFrame:
    """The pattern {?s predicate ?t . ?s label ?source . ?t label ?target}."""
    links = triples.filter(F.col("p") == predicate).select("s", F.col("o").alias("t"))
    label = triples.filter(F.col("p") == RDFS + "label").select(F.col("s").alias("x"), F.col("o").alias("name"))
    out = links.join(label.select(F.col("x").alias("s"), F.col("name").alias(source)), "s")
    return out.join(label.select(F.col("x").alias("t"), F.col("name").alias(target)), "t").select(source, target)


def labelled_nodes(triples: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """The pattern {?s label ?name . ?s type ?class}: name and class (without the namespace)."""
    label = triples.filter(F.col("p") == RDFS + "label").select("s", F.col("o").alias("name"))
    kind = triples.filter(F.col("p") == RDF + "type").select("s", F.replace("o", F.lit(ns), F.lit("")).alias("class"))
    return label.join(kind, "s").select("name", "class")


def structural_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """check, n_pass, n_fail: names present, relations allowed, ends exist."""
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    names = nodes.select(clean("name").alias("n")).filter("n <> ''").distinct()
    side = lambda c: names.select(F.col("n").alias(f"_{c}"), F.lit(True).alias(f"{c}_ok"))
    rows = edges.withColumns({"_src": clean("src_name"), "_dst": clean("dst_name")}).join(side("src"), "_src", "left").join(side("dst"), "_dst", "left")
    count = lambda df, name, ok: df.agg(F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0)).alias("n_pass"), F.coalesce(F.sum(F.when(ok, 0).otherwise(1)), F.lit(0)).alias("n_fail")).select(F.lit(name).alias("check"), "n_pass", "n_fail")
    out = count(nodes, "node_has_name", clean("name") != "")
    out = out.union(count(edges, "allowed_relation_type", F.coalesce(F.col("rel").isin(RELATION_TYPES), F.lit(False))))
    return out.union(count(rows, "edge_endpoints_exist", F.col("src_ok").isNotNull() & F.col("dst_ok").isNotNull()))


def check_report(checks: DataFrame) -> DataFrame:
    out = checks.agg(F.sum("n_pass").alias("pass_count"), F.sum("n_fail").alias("fail_count"))
    rate = F.round(F.col("pass_count") / F.greatest(F.lit(1), F.col("pass_count") + F.col("fail_count")), 4)
    return out.select(F.when(F.col("fail_count") == 0, "pass").otherwise("fail").alias("status"), "pass_count", "fail_count", rate.alias("pass_rate"))


def relation_semantics(relations: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """relation with predicate, domain and range; owl:Thing where no axiom says more."""
    table = F.create_map(*[x for r, (d, g) in AXIOMS.items() for x in (F.lit(r), F.struct(F.lit(d).alias("d"), F.lit(g).alias("g")))])
    name = strip(F.col("relation"))
    short = lambda side: F.when(F.coalesce(table[name][side], F.lit("Thing")) == "Thing", "owl:Thing").otherwise(F.concat(F.lit("rf:"), table[name][side]))
    return relations.select(name.alias("relation"), F.concat(F.lit("rf:"), name).alias("predicate"), F.concat(F.lit(ns), name).alias("predicate_uri"), F.lit("owl:ObjectProperty").alias("owl_type"), short("d").alias("domain"), short("g").alias("range"))
