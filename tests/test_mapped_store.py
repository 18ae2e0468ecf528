"""The quads of mapped tables, made when they are read."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quadlake import catalogue
from quadlake.api import sparql, statements
from quadlake.plans.algebra import Iri, Literal
from quadlake.sources import coded_rows
from quadlake.sources.coded_rows import CodedRows
from quadlake.sources.ids import IdParts, unread
from quadlake.plans.parser import parse
from quadlake.sources.mapped_store import MappedStore
from quadlake.sources.mapping import MappedGraph, Property, TableMap
from quadlake.sources.ntriples import parse_lines
from quadlake.sources.store import QuadStore


def get(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def held(path) -> int:
    return sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.fixture(scope="module")
def graph(spark):
    """Subjects 1 and null are in several rows, which agree in some values; two tables."""
    rows = [(1, "x", 5, "a", "en"), (1, "x", 6, "a", "en"), (1, "y", 5, "b", "en"), (1, "x", 5, "a", "en"), (2, None, 5, "a", None), (3, 'q"\n', None, "b", "de"), (None, "x", 7, "a", "en"), (None, "x", 8, "a", "en")]
    things = spark.createDataFrame(rows, "k long, name string, size int, source string, lang string")
    props = {"http://e/name": Property("name", lang="lang"), "http://e/size": Property("size"), "http://e/of": Property("source", ref="http://e/src/"), "http://e/plain": Property("name")}
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (1, 3, 1.0)], "a long, b long, v double")
    return MappedGraph(spark, [
        TableMap("thing", things, "http://e/thing/", ["k"], "http://e/Thing", props, graph="http://e/g/", graph_column="source"),
        TableMap("pair", pairs, "http://e/pair/", ["a", "b"], "http://e/Pair", {"http://e/a": Property("a", ref="http://e/thing/"), "http://e/v": Property("v")}, graph="http://e/pairs"),
    ])


@pytest.fixture(scope="module")
def named(spark, graph):
    """The same without rows that have no key: null is no term, and gets no id."""
    return MappedGraph(spark, [replace(t, df=t.df.dropna(subset=t.keys)) for t in graph.tables])


def test_quads_are_the_set_of_statements(graph):
    store, kept = MappedStore(graph), QuadStore.of(statements(graph))
    assert get(store.quads.select("s", "p", "o", "g", "o_num")) == get(kept.quads.select("s", "p", "o", "g", "o_num"))
    assert get(store.triples()) == get(kept.triples())


def test_patterns_match_the_stored_quads(graph):
    store, kept = MappedStore(graph), QuadStore.of(statements(graph))
    places = {"s": [None, Iri("http://e/thing/1"), Iri("http://e/pair/1/2"), "_:x"], "p": [None, Iri("http://e/name"), Iri("http://e/none")], "o": [None, Iri("http://e/Thing"), Iri("http://e/thing/1"), Literal("x"), Literal("x", None, "en"), Literal("5", "http://www.w3.org/2001/XMLSchema#int")], "g": [None, Iri("http://e/pairs"), Iri("http://e/g/a")]}
    for s in places["s"]:
        for p, o, g in [(None, None, None), *[(x, None, None) for x in places["p"][1:]], *[(None, x, None) for x in places["o"][1:]], *[(None, None, x) for x in places["g"][1:]], (places["p"][1], places["o"][4], places["g"][2])]:
            assert get(store.match(s, p, o, g)) == get(kept.match(s, p, o, g)), (s, p, o, g)


@pytest.mark.parametrize("text", ["SELECT ?s ?v WHERE { ?s <http://e/size> ?v FILTER(?v > 5) }", "SELECT ?s FROM <http://e/g/a> WHERE { ?s <http://e/size> 5 }", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", "SELECT ?p WHERE { <http://e/thing/1> ?p ?o }"])
def test_queries_match_the_stored_quads(graph, text):
    assert get(sparql(MappedStore(graph), text)) == get(sparql(QuadStore.of(statements(graph)), text))


def test_tables_with_one_prefix_share_quads(spark, graph):
    """Two tables that make the same subjects: their quads are one set."""
    twice = MappedGraph(spark, [*graph.tables, graph.tables[1]])
    assert get(MappedStore(twice).quads) == get(MappedStore(graph).quads)


@pytest.mark.parametrize("name", ["pat_spog", "store_filter", "pat_pg", "id_filter", "id_optional", "id_graph", "id_predicates_of_object"])
def test_patterns_do_not_store_all_quads(spark, tiny, tmp_path, monkeypatch, name):
    """A pattern writes less than the tables take: the quads in all orders took many times as much."""
    for kept in ("_stored", "_ids"):
        monkeypatch.setattr(catalogue, kept, {})
    monkeypatch.setattr("quadlake.storage.shared_folder", lambda spark: str(tmp_path))
    assert catalogue.queries()[name](spark, tiny).count() > 0
    assert held(tmp_path) < held(tiny) / 2


@pytest.mark.parametrize("text", [
    "SELECT ?s ?v WHERE { ?s <http://e/size> ?v ; <http://e/plain> ?n FILTER(?v > 5) }",
    "SELECT ?s ?n WHERE { ?s <http://e/size> ?v OPTIONAL { ?s <http://e/name> ?n } }",
    "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g",
    "SELECT DISTINCT ?p WHERE { ?s ?p 'x' }",
    "SELECT * WHERE { ?s <http://e/a> ?o }",
    "SELECT ?x ?n WHERE { ?x <http://e/a>/<http://e/plain> ?n }",
    "SELECT ?x ?y WHERE { ?x <http://e/a>+ ?y }",
    "SELECT ?x WHERE { GRAPH ?g { ?x <http://e/a>+ ?y } }",
    "SELECT ?g ?x FROM NAMED <http://e/g/a> WHERE { GRAPH ?g { ?x ?p ?o } }",
    "SELECT ?x FROM <http://e/g/a> WHERE { ?x <http://e/size> 5 }",
    "SELECT ?x WHERE { ?x <http://e/size> ?v FILTER(EXISTS { ?x <http://e/plain> ?n } || ?v = 5) }",
    "SELECT ?x WHERE { ?x <http://e/size> ?v MINUS { ?x <http://e/of> ?m } }",
    "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?s ?p ?o }",
    "SELECT ?s WHERE { ?s <http://e/none> ?o }",
    "ASK { ?s <http://e/size> ?o }",
])
def test_ids_of_parts_give_the_same(named, text):
    store = MappedStore(named)
    assert get(sparql(IdParts(store), text)) == get(sparql(store, text))


def test_parts_keep_their_ids(named):
    """A later query's terms follow those that are known; a pattern is stored once."""
    ids = IdParts(MappedStore(named))
    first, again = "SELECT ?s ?v WHERE { ?s <http://e/size> ?v }", "SELECT ?s ?n WHERE { ?s <http://e/size> ?w ; <http://e/plain> ?n }"
    before = sparql(ids, first)
    sparql(ids, again).collect()
    sparql(ids, first.replace("?v", "?w"))
    assert ids.dictionary.count() == ids.dictionary.select("term").distinct().count() == ids.dictionary.select("id").distinct().count()
    assert get(before) == get(sparql(ids.store, first)) and len(ids.held["parts"]) == 3


def test_unread_variables():
    assert unread(parse("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")) == {"s", "p", "o"}
    assert unread(parse("SELECT * WHERE { ?s ?p ?o }")) == unread(parse("SELECT ?s ?p WHERE { ?s ?p ?o . ?o ?p ?s }")) == set()


def test_parts_by_predicate_hold_every_triple_once(graph):
    for most in (100_000, 2):
        parts = MappedStore(graph).hexastore_parts("p", most=most)
        found = parts.select("p", F.inline("entries")).select("s", "p", "o")
        assert get(found) == get(QuadStore.of(statements(graph)).triples())
        assert parts.count() == parts.select("p", "part").distinct().count()


@pytest.mark.parametrize("long", ["mapped", "stored"])
def test_parts_of_long_texts_are_bounded_in_bytes(spark, long):
    """A hundred texts of 200,000 letters: 20 MB are not one part, however few they are."""
    texts = spark.range(100).select("id", F.concat(F.repeat(F.lit("x"), F.lit(200_000)), F.col("id").cast("string")).alias("text"))
    graph = MappedGraph(spark, [TableMap("t", texts, "http://e/t/", ["id"], "http://e/T", {"http://e/text": Property("text")}, graph="http://e/g")])
    store = MappedStore(graph) if long == "mapped" else QuadStore.of(statements(graph))
    parts = store.hexastore_parts("p").select("p", F.size("entries").alias("n"), F.length(F.array_join("entries.o", "")).alias("bytes")).where("p = '<http://e/text>'").collect()
    assert sum(r.n for r in parts) == 100 and max(r.bytes for r in parts) < 12_000_000


def test_lines_read_back_are_the_same_set(spark, named):
    """Quads that differ as text and are one when read, lines that are no statements, a missing graph."""
    odd = [("<http://e/a>", "<http://e/p>", o, "<http://e/g>") for o in ('"A"', r'"A"', r'"\U00000041"', r'"B"', '"x"@', "<http://e/a b>", '"a\nb"', r'"\\ \" \n"@en', "_:b", "_:b.")] + [("_:x", "<http://e/p>", '"A"', "_:g"), ("<http://e/a>", "<http://e/p>", '"A"', None)]
    for store in (QuadStore.of(spark.createDataFrame(odd, "s string, p string, o string, g string")), MappedStore(named)):
        lines = store.quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))
        assert get(store.reread()) == get(QuadStore.of(parse_lines(lines)).quads.select("s", "p", "o", "g"))


def test_lines_read_back_are_not_dealt_out(spark, tiny):
    plan = MappedStore(catalogue.mapped_tables(spark, tiny)).reread()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_round_trip_by_rows_shuffles_no_quads(spark):
    """Rows and the dictionary of their subjects lie in the same buckets; it joined all quads with the dictionary eight times."""
    rows = spark.range(1000).select((F.col("id") % 10).alias("a"), "id", (F.col("id") * 0.5).alias("v"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("name"))
    graph = MappedGraph(spark, [TableMap("t", rows, "http://e/t/", ["a", "id"], "http://e/T", {"http://e/v": Property("v"), "http://e/n": Property("name"), "http://e/a": Property("a", ref="http://e/u/")}, graph="http://e/g")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = catalogue._roundtrip(MappedStore(graph))
        assert "hashpartitioning" not in back._jdf.queryExecution().executedPlan().toString()
        assert get(back) == get(QuadStore.of(statements(graph)).quads.select("s", "p", "o", "g"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("hashes", ["all differ", "some are the same"])
def test_round_trip_by_rows_gives_the_same_quads(named, monkeypatch, hashes):
    """Subjects in several rows, columns without a value; texts whose hashes are the same."""
    if hashes != "all differ":
        monkeypatch.setattr(coded_rows, "_hashed", lambda term: F.length(term) % 3)
    store = MappedStore(named)
    assert CodedRows.fits(store)
    coded = CodedRows(store)
    assert (len(coded.by) == 2) == (hashes != "all differ")
    assert get(coded.quads()) == get(QuadStore.of(statements(named)).quads.select("s", "p", "o", "g"))
    terms = coded.dictionary()
    assert terms.count() == terms.select("id").distinct().count() == terms.select("term").distinct().count()


def test_texts_that_are_subjects_have_one_id(spark, named):
    """A column of IRIs that names a row by its two keys, and one that names a row by a whole number."""
    for there, fits in (("http://e/pair/1/3", True), ("http://e/thing/1", False)):
        links = spark.createDataFrame([("x", there), ("y", "http://e/elsewhere")], "k string, url string")
        graph = MappedGraph(spark, [*named.tables, TableMap("link", links, "http://e/link/", ["k"], "http://e/Link", {"http://e/url": Property("url", ref="*")}, graph="http://e/links")])
        store = MappedStore(graph)
        assert CodedRows.fits(store) == fits
        assert get(catalogue._roundtrip(store)) == get(QuadStore.of(statements(graph)).quads.select("s", "p", "o", "g"))
        if fits:
            assert CodedRows(store).dictionary().where(F.col("term") == f"<{there}>").count() == 1


def test_an_id_without_a_term_raises(named):
    coded = CodedRows(MappedStore(named))
    coded.texts = coded.texts.where("term NOT LIKE '%src/a>'")
    with pytest.raises(Exception, match="no term has id"):
        coded.quads().collect()
