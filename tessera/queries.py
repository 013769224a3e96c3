"""Graph-pattern queries over the test tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import results, testdatabase, testendpoint
from .federation import Federation
from .reasoning import TBox
from .runtime import scratch
from .sources.files import csv_source, jdbc_source, json_source
from .sources.r2rml import R2rml
from .sources.remote import SparqlSource
from .sources.triples import SCHEMA, TripleSource, TurtleReader, rdf_file, rows_of
from .sources.webapi import Api, WebApiSource
from .terms import RDFS, STRING, Iri, Lit
from .testgraph import BASE, NS, PREFIXES, context, federation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sparql(name: str, text: str, sql: str, tables: str) -> None:
    """Registers a query over some of the tables. BASE in the SQL stands for the IRIs' base."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return federation(spark, sf_dir, tables.split()).query(PREFIXES + text)

    run.__name__, run.__doc__ = name, text
    QUERIES[name] = run
    ORACLE_SQL[name] = sql.replace("BASE", BASE).replace("NS#", NS)


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.replace("BASE", BASE).replace("NS#", NS)
        return f

    return keep


# -- patterns and joins

sparql("bgp_star", "SELECT ?n ?k WHERE { ?r a :Region ; :r_name ?n ; :r_regionkey ?k }", "SELECT r_name AS n, r_regionkey AS k FROM region", "region")
sparql("bgp_subject_iri", "SELECT ?c ?n WHERE { ?c a :Customer ; :c_name ?n }", "SELECT 'BASEcustomer/' || c_custkey AS c, c_name AS n FROM customer", "customer")
sparql("bgp_constant_subject", "SELECT ?n ?r WHERE { t:nation\\/7 :n_name ?n ; :n_regionkey ?r }".replace("t:nation\\/7", f"<{BASE}nation/7>"), "SELECT n_name AS n, 'BASEregion/' || n_regionkey AS r FROM nation WHERE n_nationkey = 7", "nation region")
sparql("bgp_constant_object", f"SELECT ?n WHERE {{ ?x :n_regionkey <{BASE}region/2> ; :n_name ?n }}", "SELECT n_name AS n FROM nation WHERE n_regionkey = 2", "nation region")
sparql("bgp_fk_path", "SELECT ?o ?cn ?nn ?rn WHERE { ?o a :Order ; :o_custkey ?c . ?c :c_name ?cn ; :c_nationkey ?n . ?n :n_name ?nn ; :n_regionkey ?r . ?r :r_name ?rn }", "SELECT 'BASEorders/' || o_orderkey AS o, c_name AS cn, n_name AS nn, r_name AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "orders customer nation region")
sparql("fk_path_revenue", "SELECT ?nn (COUNT(*) AS ?items) (MAX(?p) AS ?top) WHERE { ?l a :Lineitem ; :l_orderkey ?o ; :l_extendedprice ?p . ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_name ?nn } GROUP BY ?nn", "SELECT n_name AS nn, count(*) AS items, max(l_extendedprice) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "lineitem orders customer nation")
sparql("bgp_two_parents", "SELECT ?pn ?sn ?q WHERE { ?l :l_partkey ?p ; :l_suppkey ?s ; :l_quantity ?q . ?p :p_name ?pn ; :p_size ?z . ?s :s_name ?sn FILTER(?z > 45 && ?q >= 40) }", "SELECT p_name AS pn, s_name AS sn, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 45 AND l_quantity >= 40", "lineitem part supplier")
sparql("bgp_shared_object", "SELECT ?cn ?sn WHERE { ?c :c_nationkey ?n ; :c_name ?cn ; :c_acctbal ?b . ?s :s_nationkey ?n ; :s_name ?sn FILTER(?b > 9000) }", "SELECT c_name AS cn, s_name AS sn FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000", "customer supplier")
sparql("path_sequence", "SELECT ?n ?rn WHERE { ?c :c_name ?n ; :c_nationkey/:n_regionkey/:r_name ?rn }", "SELECT c_name AS n, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "customer nation region")
sparql("path_inverse", "SELECT ?rn ?nn WHERE { ?r :r_name ?rn ; ^:n_regionkey/:n_name ?nn }", "SELECT r_name AS rn, n_name AS nn FROM region JOIN nation ON r_regionkey = n_regionkey", "nation region")
sparql("path_alternative", "SELECT ?x ?n WHERE { ?x :c_name|:s_name ?n }", "SELECT 'BASEcustomer/' || c_custkey AS x, c_name AS n FROM customer UNION ALL SELECT 'BASEsupplier/' || s_suppkey, s_name FROM supplier", "customer supplier")
sparql("var_predicate", "SELECT ?p ?o WHERE { ?n a :Nation ; ?p ?o }", "SELECT 'NS#n_nationkey' AS p, n_nationkey::VARCHAR AS o FROM nation UNION ALL SELECT 'NS#n_name', n_name FROM nation UNION ALL SELECT 'NS#n_regionkey', 'BASEregion/' || n_regionkey FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'NS#Nation' FROM nation", "nation")
sparql("var_predicate_counts", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?x ?p ?o } GROUP BY ?p", "SELECT 'NS#' || k AS p, n FROM (SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS k, (SELECT count(*) FROM customer) AS n) UNION ALL SELECT 'NS#' || k, n FROM (SELECT unnest(['s_suppkey','s_name','s_nationkey','s_acctbal']) AS k, (SELECT count(*) FROM supplier) AS n) UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)", "customer supplier")
sparql("distinct_types", "SELECT DISTINCT ?t WHERE { ?x a ?t }", "SELECT unnest(['NS#Region','NS#Nation','NS#Supplier','NS#Part']) AS t", "region nation supplier part")
sparql("class_variable", "SELECT ?t (COUNT(?x) AS ?n) WHERE { ?x a ?t } GROUP BY ?t", "SELECT 'NS#Region' AS t, count(*) AS n FROM region UNION ALL SELECT 'NS#Part', count(*) FROM part", "region part")
sparql("cartesian_regions", "SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b", "region")
sparql("theta_join", "SELECT ?a ?b WHERE { ?x :s_name ?a ; :s_acctbal ?p . ?y :c_name ?b ; :c_acctbal ?q FILTER(?p < ?q - 9500) }", "SELECT s_name AS a, c_name AS b FROM supplier, customer WHERE s_acctbal < c_acctbal - 9500", "supplier customer")
sparql("theta_str_equality", "SELECT ?a ?k WHERE { ?x :s_suppkey ?k . ?y :r_name ?a ; :r_regionkey ?j FILTER(str(?j) = str(?k)) }", "SELECT r_name AS a, s_suppkey AS k FROM supplier, region WHERE r_regionkey::VARCHAR = s_suppkey::VARCHAR", "supplier region")

# -- filters and functions

sparql("filter_range", "SELECT ?o ?p WHERE { ?o :o_totalprice ?p FILTER(?p > 100000 && ?p <= 200000.5) }", "SELECT 'BASEorders/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000.5", "orders")
sparql("filter_regex", "SELECT ?n WHERE { ?p :p_type ?n FILTER(regex(?n, \"^(std|eco|small|large).*\", \"i\") || regex(?n, \"brass\", \"i\")) }", "SELECT p_type AS n FROM part WHERE regexp_matches(p_type, '^(std|eco|small|large).*', 'i') OR regexp_matches(p_type, 'brass', 'i')", "part")
sparql("filter_datetime", "SELECT ?o ?d WHERE { ?o :o_orderdate ?d FILTER(?d >= \"1995-01-01T00:00:00\"^^xsd:dateTime && ?d < \"1996-01-01T00:00:00\"^^xsd:dateTime) }", "SELECT 'BASEorders/' || o_orderkey AS o, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'", "orders")
sparql("filter_in", "SELECT ?o ?s WHERE { ?o :o_orderstatus ?s FILTER(?s IN (\"F\", \"P\")) }", "SELECT 'BASEorders/' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'P')", "orders")
sparql("filter_not_in", "SELECT ?o ?s WHERE { ?o :o_orderstatus ?s FILTER(?s NOT IN (\"F\", \"P\")) }", "SELECT 'BASEorders/' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", "orders")
sparql("filter_arithmetic", "SELECT ?k WHERE { ?l :l_quantity ?q ; :l_extendedprice ?p ; :l_discount ?d ; :l_partkey/:p_partkey ?k FILTER(?p * (1 - ?d) / ?q > 1800) }", "SELECT l_partkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice * (1 - l_discount) / l_quantity > 1800", "lineitem part")
sparql("filter_iri_equality", f"SELECT ?n WHERE {{ ?c :c_name ?n ; :c_nationkey ?x FILTER(?x = <{BASE}nation/3> || str(?x) = \"{BASE}nation/4\") }}", "SELECT c_name AS n FROM customer WHERE c_nationkey IN (3, 4)", "customer")
sparql("filter_three_valued", "SELECT ?d WHERE { ?d a :Document OPTIONAL { ?l :doc_id ?d ; :toxic ?t } FILTER(?t = 1 || !bound(?t)) }", "SELECT 'BASEdocuments/' || d.doc_id AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1 OR toxic IS NULL", "documents labels")
sparql("functions_string", "SELECT ?n (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (SUBSTR(?n, 2, 3) AS ?sub) (STRBEFORE(?n, \"A\") AS ?bef) (STRAFTER(?n, \"A\") AS ?aft) (CONCAT(?n, \"-\", ?n) AS ?cat) (REPLACE(?n, \"[AEIOU]\", \"_\") AS ?rep) WHERE { ?r :n_name ?n }", "SELECT n_name AS n, length(n_name)::INT AS len, upper(n_name) AS up, lower(n_name) AS low, substr(n_name, 2, 3) AS sub, CASE WHEN contains(n_name, 'A') THEN substr(n_name, 1, strpos(n_name, 'A') - 1) ELSE '' END AS bef, CASE WHEN contains(n_name, 'A') THEN substr(n_name, strpos(n_name, 'A') + 1) ELSE '' END AS aft, n_name || '-' || n_name AS cat, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS rep FROM nation", "nation")
sparql("functions_tests", "SELECT ?n WHERE { ?r :n_name ?n FILTER((STRSTARTS(?n, \"NATION_1\") || STRENDS(?n, \"2\") || CONTAINS(?n, \"_3\")) && isLiteral(?n) && isIRI(?r) && !isBlank(?r) && !isNumeric(?n) && datatype(?n) = xsd:string && lang(?n) = \"\") }", "SELECT n_name AS n FROM nation WHERE starts_with(n_name, 'NATION_1') OR ends_with(n_name, '2') OR contains(n_name, '_3')", "nation")
sparql("functions_numeric", "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?s :s_suppkey ?k ; :s_acctbal ?b }", "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r FROM supplier", "supplier")
sparql("functions_dates", "SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m", "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY 1, 2", "orders")
sparql("functions_hashes", "SELECT ?n (MD5(?n) AS ?m) (SHA256(?n) AS ?s) WHERE { ?r :r_name ?n }", "SELECT r_name AS n, md5(r_name) AS m, sha256(r_name) AS s FROM region", "region")
sparql("functions_conditional", "SELECT ?k (IF(?z > 25, \"large\", \"small\") AS ?size) (COALESCE(?none, ?k) AS ?c) WHERE { ?p :p_partkey ?k ; :p_size ?z }", "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size, p_partkey::VARCHAR AS c FROM part", "part")
sparql("functions_casts", "SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) WHERE { ?c :c_custkey ?k ; :c_acctbal ?b }", "SELECT c_custkey AS k, trunc(c_acctbal)::BIGINT AS i, c_custkey::VARCHAR AS s, c_custkey::DOUBLE AS d FROM customer", "customer")
sparql("integer_division", "SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?z FILTER(?z / 2 = 7.5) }", "SELECT p_partkey AS k FROM part WHERE p_size = 15", "part")

# -- optional, union, values, modifiers

sparql("optional_labels", "SELECT ?d ?t WHERE { ?d a :Document OPTIONAL { ?l :doc_id ?d ; :toxic ?t } }", "SELECT 'BASEdocuments/' || d.doc_id AS d, toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "documents labels")
sparql("optional_not_bound", "SELECT ?d WHERE { ?d :source ?s OPTIONAL { ?l :doc_id ?d ; :quality ?q } FILTER(!bound(?q)) }", "SELECT 'BASEdocuments/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "documents labels")
sparql("optional_filter_inside", "SELECT ?n ?s WHERE { ?x :n_name ?n ; :n_nationkey ?k OPTIONAL { ?y :s_nationkey ?x ; :s_name ?s ; :s_acctbal ?b FILTER(?b > 5000 && ?k < 10) } }", "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 AND n_nationkey < 10", "nation supplier")
sparql("optional_nested", "SELECT ?r ?n ?s WHERE { ?x :r_name ?r OPTIONAL { ?y :n_regionkey ?x ; :n_name ?n OPTIONAL { ?z :s_nationkey ?y ; :s_name ?s ; :s_acctbal ?b FILTER(?b > 8000) } } }", "SELECT r_name AS r, n_name AS n, s_name AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000", "region nation supplier")
sparql("optional_then_join", "SELECT ?d ?t ?q WHERE { ?d :lang \"de\" OPTIONAL { ?l :doc_id ?d ; :toxic ?t } OPTIONAL { ?m :doc_id ?d ; :quality ?q } }", "SELECT 'BASEdocuments/' || d.doc_id AS d, l.toxic AS t, m.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN labels m ON d.doc_id = m.doc_id WHERE d.lang = 'de'", "documents labels")
sparql("union_same_shape", "SELECT ?n ?b WHERE { { ?c :c_name ?n ; :c_acctbal ?b } UNION { ?s :s_name ?n ; :s_acctbal ?b } FILTER(?b > 5000) }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000", "customer supplier")
sparql("union_mixed_terms", "SELECT ?x WHERE { { ?c :n_regionkey ?x } UNION { ?c :n_name ?x } UNION { ?c :n_nationkey ?x } }", "SELECT 'BASEregion/' || n_regionkey AS x FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT n_nationkey::VARCHAR FROM nation", "nation")
sparql("union_missing_vars", "SELECT ?a ?b WHERE { { ?x :r_name ?a } UNION { ?y :n_name ?b } }", "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation", "region nation")
sparql("union_then_join", "SELECT ?n ?rn WHERE { { ?x :c_nationkey ?k ; :c_name ?n } UNION { ?x :s_nationkey ?k ; :s_name ?n } ?k :n_regionkey/:r_name ?rn }", "SELECT n, r_name AS rn FROM (SELECT c_name AS n, c_nationkey AS k FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey", "customer supplier nation region")
sparql("values_join", "SELECT ?n ?b WHERE { ?c :c_mktsegment ?m ; :c_name ?n ; :c_acctbal ?b } VALUES ?m { \"BUILDING\" \"MACHINERY\" }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer")
sparql("values_inline_undef", f"SELECT ?n ?m WHERE {{ VALUES (?k ?m) {{ (<{BASE}nation/1> \"one\") (<{BASE}nation/2> UNDEF) }} ?k :n_name ?n }}", "SELECT n_name AS n, CASE WHEN n_nationkey = 1 THEN 'one' END AS m FROM nation WHERE n_nationkey IN (1, 2)", "nation")
sparql("distinct_projection", "SELECT DISTINCT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", "orders")
sparql("limit_count", "SELECT (COUNT(*) AS ?n) WHERE { { SELECT ?c WHERE { ?c a :Customer } LIMIT 17 } }", "SELECT 17::BIGINT AS n", "customer")
sparql("order_limit", "SELECT ?k ?b WHERE { ?c :c_custkey ?k ; :c_acctbal ?b } ORDER BY DESC(?b) ?k LIMIT 10 OFFSET 3", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 3", "customer")
sparql("ask_exists", "SELECT (COUNT(*) AS ?n) WHERE { { SELECT ?c WHERE { ?c :c_acctbal ?b FILTER(?b > 1e9) } LIMIT 1 } }", "SELECT 0::BIGINT AS n", "customer")
sparql("group_having", "SELECT ?m (COUNT(?c) AS ?n) (MIN(?b) AS ?low) (MAX(?b) AS ?high) WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b } GROUP BY ?m HAVING (COUNT(?c) > 10)", "SELECT c_mktsegment AS m, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1 HAVING count(*) > 10", "customer")
sparql("count_distinct", "SELECT (COUNT(DISTINCT ?m) AS ?n) WHERE { ?c :c_mktsegment ?m }", "SELECT count(DISTINCT c_mktsegment) AS n FROM customer", "customer")
sparql("exists_filter", "SELECT ?n WHERE { ?c :c_name ?n FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 300000) } }", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders")
sparql("not_exists_filter", "SELECT ?n WHERE { ?c :c_name ?n FILTER NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 300000) } }", "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "customer orders")
sparql("minus", "SELECT ?c WHERE { ?c a :Customer MINUS { ?o :o_custkey ?c ; :o_orderstatus \"F\" } }", "SELECT 'BASEcustomer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "customer orders")
sparql("bind_expression", "SELECT ?k ?net WHERE { ?l :l_quantity ?q ; :l_extendedprice ?p ; :l_orderkey/:o_orderkey ?k BIND(?p * ?q AS ?net) FILTER(?net > 4000000) }", "SELECT o_orderkey AS k, l_extendedprice * l_quantity AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice * l_quantity > 4000000", "lineitem orders")
sparql("multi_source_count", "SELECT ?t (COUNT(*) AS ?n) WHERE { ?x a ?t . ?x ?p ?o FILTER(isIRI(?o)) } GROUP BY ?t", "SELECT 'NS#Nation' AS t, 2 * count(*) AS n FROM nation UNION ALL SELECT 'NS#Customer', 2 * count(*) FROM customer UNION ALL SELECT 'NS#Region', count(*) FROM region", "region nation customer")
sparql("event_types", "SELECT ?t (COUNT(*) AS ?n) (COUNT(DISTINCT ?u) AS ?users) WHERE { ?e :event_type ?t ; :user_id ?u ; :ts ?w FILTER(?w >= \"2024-01-10T00:00:00\"^^xsd:dateTime) } GROUP BY ?t", "SELECT event_type AS t, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1", "events")
sparql("conversation_keys", "SELECT ?x ?r WHERE { ?x a :Turn ; :role ?r ; :turn 0 }", "SELECT 'BASEconversations/' || conv_id || '-' || turn AS x, role AS r FROM conversations WHERE turn = 0", "conversations")


# -- templates, reasoning, other sources

@registered("template_expansion", "SELECT c_name AS n, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def template_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = federation(spark, sf_dir, ["customer", "nation", "region"])
    fed.register_template(NS + "inRegion", "s", "o", f"?s <{NS}ofNation> ?n . ?n <{NS}n_regionkey> ?o")
    fed.register_template(NS + "ofNation", "s", "o", f"?s <{NS}c_nationkey> ?o")
    return fed.query(PREFIXES + "SELECT ?n ?rn WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :inRegion ?r . ?r :r_name ?rn FILTER(?b > 9000) }")


def _tbox() -> TBox:
    up = [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent")]
    names = [("c_name", "name"), ("s_name", "name"), ("name", "label")]
    return TBox([(NS + a, RDFS + "subClassOf", NS + b) for a, b in up] + [(NS + a, RDFS + "subPropertyOf", NS + b) for a, b in names])


@registered("subclass_reasoning", "SELECT 'BASEcustomer/' || c_custkey AS x FROM customer UNION ALL SELECT 'BASEsupplier/' || s_suppkey FROM supplier")
def subclass_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = federation(spark, sf_dir, ["customer", "supplier", "nation"])
    fed.use_tbox(_tbox())
    return fed.query(PREFIXES + "SELECT ?x WHERE { ?x a :Agent }")


@registered("subproperty_reasoning", "SELECT c_name AS n, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def subproperty_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = federation(spark, sf_dir, ["customer", "supplier", "nation"])
    tbox = _tbox()
    for p in ("c_nationkey", "s_nationkey"):
        tbox.down[RDFS + "subPropertyOf"][NS + "nation"].add(NS + p)
    fed.use_tbox(tbox, always=False)
    return fed.query(PREFIXES + "SELECT ?n ?nn FROM <http://www.w3.org/ns/entailment/RDFS> WHERE { ?x :label ?n ; :nation ?k . ?k :n_name ?nn }")


@registered("r2rml_tables", "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")
def r2rml_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix : <{NS}> .
    :nations rr:logicalTable [ rr:tableName "nation" ] ; rr:subjectMap [ rr:template "{BASE}nation/{{n_nationkey}}" ; rr:class :Nation ] ;
      rr:predicateObjectMap [ rr:predicate :label ; rr:objectMap [ rr:column "n_name" ] ] ;
      rr:predicateObjectMap [ rr:predicate :part ; rr:objectMap [ rr:parentTriplesMap :regions ; rr:joinCondition [ rr:child "n_regionkey" ; rr:parent "r_regionkey" ] ] ] .
    :regions rr:logicalTable [ rr:tableName "region" ] ; rr:subjectMap [ rr:template "{BASE}region/{{r_regionkey}}" ; rr:class :Region ] ;
      rr:predicateObjectMap [ rr:predicate :label ; rr:objectMap [ rr:column "r_name" ] ] ."""
    fed = federation(spark, sf_dir, ["part"])
    for s in R2rml(spark, text, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")).sources():
        fed.add_source(s)
    return fed.query(PREFIXES + "SELECT ?n ?rn WHERE { ?x a :Nation ; :label ?n ; :part ?r . ?r a :Region ; :label ?rn }")


@registered("triple_store_join", "SELECT n_name AS n, CASE n_nationkey WHEN 1 THEN 'north' WHEN 2 THEN 'south' END AS z FROM nation WHERE n_nationkey IN (1, 2)")
def triple_store_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f'@prefix : <{NS}> . <{BASE}nation/1> :zone "north" . <{BASE}nation/2> :zone "south" . <{BASE}nation/99> :zone "none" .'
    fed = federation(spark, sf_dir, ["nation", "region"])
    fed.add_source(TripleSource(spark.createDataFrame(rows_of(TurtleReader(text).triples()), SCHEMA), "zones"))
    fed.index_sources()
    return fed.query(PREFIXES + "SELECT ?n ?z WHERE { ?x :n_name ?n ; :zone ?z }")


@registered("materialised_triples", "SELECT c_name AS n, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def materialised_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as a generic triple store: the same query as joins over triples."""
    whole = federation(spark, sf_dir, ["customer", "nation"]).query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }", "terms")
    triples = whole.selectExpr("s.lex AS s", "p.lex AS p", "o.k AS k", "o.lex AS lex", "o.dt AS dt", "o.lang AS lang")
    fed = Federation(spark).add_source(TripleSource(triples, "triples"))
    return fed.query(PREFIXES + "SELECT ?n ?nn WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :c_nationkey ?k . ?k :n_name ?nn FILTER(?b > 5000) }")


@registered("path_plus", "WITH RECURSIVE e(a, b) AS (SELECT 'BASEnation/' || n_nationkey, 'BASEregion/' || n_regionkey FROM nation UNION ALL SELECT 'BASEcustomer/' || c_custkey, 'BASEnation/' || c_nationkey FROM customer), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS x, b AS y FROM r")
def path_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = federation(spark, sf_dir, ["customer", "nation", "region"])
    return fed.query(PREFIXES + "SELECT ?x ?y WHERE { ?x (:c_nationkey|:n_regionkey)+ ?y }")




@registered("path_star", "WITH RECURSIVE e(a, b) AS (SELECT 'BASEnation/' || n_nationkey, 'BASEregion/' || n_regionkey FROM nation), n(a) AS (SELECT 'BASEnation/' || n_nationkey FROM nation UNION SELECT 'BASEregion/' || r_regionkey FROM region UNION SELECT 'NS#Nation' UNION SELECT 'NS#Region' UNION SELECT n_name FROM nation UNION SELECT r_name FROM region), k(a, dt) AS (SELECT n_nationkey::VARCHAR, 'int' FROM nation UNION SELECT r_regionkey::VARCHAR, 'int' FROM region) SELECT a AS x, a AS y FROM n UNION ALL SELECT a, a FROM k UNION ALL SELECT a, b FROM e")
def path_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between free ends a path of no length connects every term of the graph with itself."""
    return federation(spark, sf_dir, ["nation", "region"]).query(PREFIXES + "SELECT ?x ?y WHERE { ?x :n_regionkey* ?y }")


sparql("path_from_constant", f"SELECT ?y WHERE {{ <{BASE}customer/1> (:c_nationkey|:n_regionkey)+ ?y }}", "SELECT 'BASEnation/' || c_nationkey AS y FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'BASEregion/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1", "customer nation")
sparql("path_to_constant", f"SELECT ?x WHERE {{ ?x (:c_nationkey|:n_regionkey)+ <{BASE}region/1> }}", "SELECT 'BASEnation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'BASEcustomer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", "customer nation")
sparql("path_optional", "SELECT ?n ?y WHERE { ?x :n_name ?n ; :n_regionkey? ?y }", "SELECT n_name AS n, 'BASEnation/' || n_nationkey AS y FROM nation UNION ALL SELECT n_name, 'BASEregion/' || n_regionkey FROM nation", "nation")
sparql("path_literal_end", "SELECT ?x ?y WHERE { ?x (:c_nationkey|:n_name)+ ?y FILTER(isLiteral(?y)) }", "SELECT 'BASEnation/' || n_nationkey AS x, n_name AS y FROM nation UNION ALL SELECT 'BASEcustomer/' || c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer nation")
sparql("optional_rejoin", "SELECT ?n ?s ?z WHERE { ?x :n_name ?n OPTIONAL { ?s :s_nationkey ?x ; :s_acctbal ?b FILTER(?b > 5000) } OPTIONAL { ?s :s_name ?z } }", "SELECT n_name AS n, 'BASEsupplier/' || coalesce(a.s_suppkey, c.s_suppkey) AS s, coalesce(a.s_name, c.s_name) AS z FROM nation LEFT JOIN supplier a ON a.s_nationkey = n_nationkey AND a.s_acctbal > 5000 LEFT JOIN supplier c ON a.s_suppkey IS NULL", "nation supplier")
sparql("offset_rows", "SELECT ?k WHERE { ?c :c_custkey ?k } ORDER BY ?k OFFSET 7", "SELECT c_custkey AS k FROM customer ORDER BY 1 OFFSET 7", "customer")
sparql("sub_select", "SELECT ?n ?most WHERE { { SELECT ?x (MAX(?b) AS ?most) WHERE { ?c :c_nationkey ?x ; :c_acctbal ?b } GROUP BY ?x } ?x :n_name ?n }", "SELECT n_name AS n, most FROM (SELECT c_nationkey, max(c_acctbal) AS most FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey", "customer nation")
sparql("projected_unbound", "SELECT ?n ?none WHERE { ?x :r_name ?n }", "SELECT r_name AS n, NULL::VARCHAR AS none FROM region", "region")
sparql("unanswerable_pattern", "SELECT ?n ?o WHERE { ?x :r_name ?n OPTIONAL { ?x :nowhere ?o } }", "SELECT r_name AS n, NULL::VARCHAR AS o FROM region", "region")


@registered("federation_as_source", "SELECT c_name AS n, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def federation_as_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = federation(spark, sf_dir, ["customer"])
    outer.add_source(federation(spark, sf_dir, ["nation", "region"], name="inner"))
    return outer.query(PREFIXES + "SELECT ?n ?nn WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :c_nationkey ?x . ?x :n_name ?nn FILTER(?b > 9000) }")


@registered("equivalent_sources", "SELECT n_name AS n FROM nation")
def equivalent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two sources that are declared equivalent one is asked."""
    fed = federation(spark, sf_dir, ["nation"])
    twin = federation(spark, sf_dir, ["nation"]).sources[0]
    twin.name, twin.equivalent_to = "nation-mirror", "nation"
    return fed.add_source(twin).query(PREFIXES + "SELECT ?n WHERE { ?x :n_name ?n }")


def _written(spark: SparkSession, rows: DataFrame, how: str, **options) -> str:
    path = f"{scratch(spark)}/{how}-{uuid.uuid4().hex}"
    rows.write.options(**options).format(how).save(path)
    return path


@registered("csv_file", "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations from a CSV file that is written first."""
    ctx, links = context("nation")
    path = _written(spark, spark.read.parquet(f"{sf_dir}/nation.parquet"), "csv", header=True)
    fed = federation(spark, sf_dir, ["region"]).add_source(csv_source(spark, path, ctx, "nation", links=links))
    return fed.query(PREFIXES + "SELECT ?n ?rn WHERE { ?x :n_name ?n ; :n_regionkey ?r . ?r :r_name ?rn }")


@registered("json_file", "SELECT s_name AS n, s_acctbal AS b FROM supplier WHERE s_acctbal > 1000")
def json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers from a JSON file that is written first."""
    ctx, links = context("supplier")
    path = _written(spark, spark.read.parquet(f"{sf_dir}/supplier.parquet"), "json")
    fed = Federation(spark).add_source(json_source(spark, path, ctx, "supplier", links=links))
    return fed.query(PREFIXES + "SELECT ?n ?b WHERE { ?x :s_name ?n ; :s_acctbal ?b FILTER(?b > 1000) }")


@registered("jdbc_table", "SELECT s_name AS n, r_name AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 1000")
def jdbc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers from a database that is filled first, read over four connections."""
    ctx, links = context("supplier")
    url = testdatabase.filled(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "supplier", "s_name VARCHAR(60)")
    fed = federation(spark, sf_dir, ["nation", "region"]).add_source(jdbc_source(spark, url, "supplier", ctx, "supplier", links, "s_suppkey", 4))
    return fed.query(PREFIXES + "SELECT ?n ?rn WHERE { ?s :s_name ?n ; :s_acctbal ?b ; :s_nationkey ?x . ?x :n_regionkey/:r_name ?rn FILTER(?b > 1000) }")


@registered("ntriples_file", "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")
def ntriples_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as an N-Triples file, gzip-compressed, that is written first."""
    text = federation(spark, sf_dir, ["nation", "region"]).query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }", "ntriples")
    path = _written(spark, text.selectExpr("concat(s, ' ', p, ' ', o, ' .') AS value"), "text", compression="gzip")
    fed = Federation(spark).add_source(rdf_file(spark, path, "file"))
    return fed.query(PREFIXES + "SELECT ?n ?rn WHERE { ?x :n_name ?n ; :n_regionkey ?r . ?r :r_name ?rn }")


@registered("result_csv", "SELECT 'BASEnation/' || n_nationkey || ',' || n_name || ',' || n_nationkey AS value FROM nation")
def result_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = federation(spark, sf_dir, ["nation"])
    return results.csv_lines(fed.compile(fed.plan(PREFIXES + "SELECT ?x ?n ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k }")))


@registered("result_tsv", "SELECT '<BASEnation/' || n_nationkey || '>' || chr(9) || '\"' || n_name || '\"' || chr(9) || '<BASEregion/' || n_regionkey || '>' AS value FROM nation")
def result_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = federation(spark, sf_dir, ["nation"])
    return results.tsv_lines(fed.compile(fed.plan(PREFIXES + "SELECT ?x ?n ?r WHERE { ?x :n_name ?n ; :n_regionkey ?r }")))


@registered("result_json", "SELECT '{\"x\":{\"type\":\"uri\",\"value\":\"BASEnation/' || n_nationkey || '\"},\"n\":{\"type\":\"literal\",\"value\":\"' || n_name || '\"}}' AS value FROM nation")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = federation(spark, sf_dir, ["nation"])
    return results.json_bindings(fed.compile(fed.plan(PREFIXES + "SELECT ?x ?n WHERE { ?x :n_name ?n }")))


@registered("remote_sparql_join", "SELECT c_name AS n, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def remote_sparql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers joined with nations of an endpoint, which is asked for the nations that occur, in VALUES batches."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # the 25 rows of the endpoint in this process
    endpoint = testendpoint.serve([(Iri(f"{BASE}nation/{r.n_nationkey}"), Iri(NS + "n_name"), Lit(r.n_name, STRING)) for r in nations])
    fed = federation(spark, sf_dir, ["customer"]).add_source(SparqlSource(spark, f"http://127.0.0.1:{endpoint.server_port}/sparql"))
    return fed.query(PREFIXES + "SELECT ?n ?nn WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :c_nationkey ?x . ?x :n_name ?nn FILTER(?b > 5000) }")


@registered("web_api_join", "SELECT n_name AS n, 100 + n_nationkey AS code FROM nation")
def web_api_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations joined with a JSON API that is asked once for each; its answers are made up by a function of the key."""
    api = Api("http://api.test/codes{?key}", {NS + "forNation": "key"}, {"id": "long", "code": "long"}, get=_answer_of_codes)
    ctx = {"@context": {"@uriProperty": "id", "code": NS + "code", "key": NS + "forNation"}, "@instancePrefix": "http://api.test/code/"}
    fed = federation(spark, sf_dir, ["nation"]).add_source(WebApiSource(spark, api, ctx, "codes"))
    return fed.query(PREFIXES + "SELECT ?n ?code WHERE { ?x :n_nationkey ?k ; :n_name ?n . ?y :forNation ?k ; :code ?code }")


def _answer_of_codes(url: str) -> str:
    key = int(url.rsplit("=", 1)[1])
    return json.dumps({"id": key, "code": 100 + key})
