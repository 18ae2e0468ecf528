"""Units on small hand-written graphs."""

import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadlake import catalogue, runner
from quadlake.api import contexts, explain_algebra, sparql
from quadlake.functions.terms import numeric
from quadlake.plans.algebra import Bgp, Iri, Triple
from quadlake.plans.compiler import PROPERTY_FUNCTIONS, register_property_function
from quadlake.plans.parser import ParseError, parse
from quadlake.sources.ntriples import parse_lines, parse_pattern
from quadlake.sources.results import FORMATS, formatted, write_results
from quadlake.sources import load
from quadlake.sources.ids import IdStore
from quadlake.sources.store import ORDERS, QuadStore, access_path
from quadlake.streaming.loader import load_stream

LINES = [
    '<http://e/a> <http://e/knows> <http://e/b> <http://e/g1> .',
    '<http://e/b> <http://e/knows> <http://e/c> .',
    '<http://e/c> <http://e/knows> <http://e/a> .',
    '<http://e/a> <http://e/age> "5"^^<http://www.w3.org/2001/XMLSchema#int> .',
    '<http://e/b> <http://e/age> "5.0"^^<http://www.w3.org/2001/XMLSchema#double> .',
    '<http://e/c> <http://e/age> "400"^^<http://www.w3.org/2001/XMLSchema#byte> .',
    '<http://e/a> <http://e/name> "a \\"quoted\\" \\u2022 name"@en .',
    '_:x <http://e/knows> _:x .',
    '<http://e/a> <http://e/knows> <http://e/b> <http://e/g1> .',
    "# comment", "", "not a statement",
]


@pytest.fixture(scope="module")
def store(spark):
    return QuadStore.of(parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")))


def get(df):
    return sorted(tuple(r) for r in df.collect())


def test_parsing_counts_bad_lines(spark):
    rows = parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert rows.where("_corrupt IS NOT NULL").count() == 1
    assert rows.count() == 10


def test_long_literals(spark):
    text = '"' + 'word \\" \\n ' * 20_000 + '"'
    rows = parse_lines(spark.createDataFrame([(f"<http://e/a> <http://e/b> {text} .",)], "value string")).collect()
    assert [(r.o, r._corrupt) for r in rows] == [(text, None)] and parse_pattern(f"? ? {text}")[2] == text


def test_quads_are_a_set(store):
    assert store.quads.count() == 8
    assert store.count(s=Iri("http://e/a")) == 3
    assert store.has(Iri("http://e/a"), Iri("http://e/knows"), Iri("http://e/b"))
    assert not store.has(Iri("http://e/a"), Iri("http://e/knows"), Iri("http://e/zzz"))


def test_numbers_compare_across_types(store):
    assert get(sparql(store, "SELECT ?s WHERE { ?s <http://e/age> ?v FILTER(?v = 5) }")) == [("<http://e/a>",), ("<http://e/b>",)]
    assert get(sparql(store, "SELECT ?s WHERE { ?s <http://e/age> ?v FILTER(?v > 100) }")) == []


def test_repeated_variable(store):
    assert get(sparql(store, "SELECT ?x WHERE { ?x <http://e/knows> ?x }")) == [("_:x",)]


def test_cyclic_path_ends(store):
    assert get(sparql(store, "SELECT ?y WHERE { <http://e/a> <http://e/knows>+ ?y }")) == [("<http://e/a>",), ("<http://e/b>",), ("<http://e/c>",)]


def test_property_function(store, monkeypatch):
    monkeypatch.setattr("quadlake.plans.compiler.PROPERTY_FUNCTIONS", dict(PROPERTY_FUNCTIONS))
    register_property_function("http://e/knownBy", lambda compiler, t, graph: compiler.compile(Bgp([Triple(t.o, Iri("http://e/knows"), t.s)]), graph))
    assert get(sparql(store, "SELECT ?x ?v WHERE { ?x <http://e/knownBy> <http://e/a> ; <http://e/age> ?v FILTER(?v = 5) }")) == [("<http://e/b>", get(sparql(store, "SELECT ?v WHERE { <http://e/b> <http://e/age> ?v }"))[0][0])]
    assert len(get(sparql(store, "SELECT ?x ?y WHERE { ?x <http://e/knownBy> ?y }"))) == 4


def test_graph(store):
    assert get(sparql(store, "SELECT ?s WHERE { GRAPH <http://e/g1> { ?s ?p ?o } }")) == [("<http://e/a>",)]


def test_escapes_and_language(store):
    assert get(sparql(store, "SELECT (STR(?n) AS ?t) (LANG(?n) AS ?l) WHERE { ?s <http://e/name> ?n }")) == [('a "quoted" • name', "en")]


def test_minus_and_union(store):
    assert len(get(sparql(store, "SELECT ?s WHERE { ?s <http://e/knows> ?o MINUS { ?s <http://e/name> ?n } }"))) == 3


@pytest.mark.parametrize("lex,kind,value", [("907", "integer", 907), ("0", "positiveInteger", None), ("-1", "nonNegativeInteger", None), ("2147483648", "int", None), ("4000000001", "unsignedInt", 4000000001), ("4294967296", "unsignedInt", None), ("65536", "unsignedShort", None), ("255", "unsignedByte", 255), ("256", "unsignedByte", None), ("18446744073709551615", "unsignedLong", 18446744073709551615), ("-5", "nonPositiveInteger", -5), ("-1.5", "decimal", -1.5), ("17.5", "int", None), ("x", "double", None)])
def test_numeric_codec(spark, lex, kind, value):
    df = spark.range(1).select(numeric(F.lit(f'"{lex}"^^<http://www.w3.org/2001/XMLSchema#{kind}>')).alias("v"))
    assert df.first()[0] == (None if value is None else float(value))


def test_pattern_lines():
    assert parse_pattern("<http://e/a> ? ? <http://e/g>") == ["<http://e/a>", None, None, "<http://e/g>"]
    with pytest.raises(ValueError):
        parse_pattern("?")


def test_dictionary_grows(store, spark):
    first = store.dictionary()
    more = store.add(parse_lines(spark.createDataFrame([("<http://e/new> <http://e/knows> <http://e/a> .",)], "value string")))
    second = more.dictionary(first)
    assert second.count() == first.count() + 1
    assert second.select("id").distinct().count() == second.count()
    assert get(more.decoded(more.encoded(second), second).select("s", "p", "o", "g")) == get(more.quads.select("s", "p", "o", "g"))


def test_save_open_append_and_stream(store, spark, tmp_path):
    store.save(f"{tmp_path}/quads")
    assert QuadStore.open(spark, f"{tmp_path}/quads").quads.count() == 8
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text("\n".join([*LINES, "<http://e/z> <http://e/knows> <http://e/a> ."]))
    load_stream(spark, f"{tmp_path}/in", f"{tmp_path}/quads", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/quads").count() == 9


def test_store_queries_cover_all_tables(spark, tiny):
    graph = catalogue.mapped_tables(spark, tiny)
    want = {f"<{p}>" for p in graph.predicates()}
    assert {r.p for r in catalogue.queries()["all_predicate_statistics"](spark, tiny).collect()} == want
    assert len(graph.tables) == 13 == len(catalogue._TABLES)


def test_statistics_are_exact(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("<http://e/"), "id", F.lit(">")).alias("s"), F.lit("<http://e/p>").alias("p"), F.concat(F.lit('"'), F.col("id") % 7000, F.lit('"')).alias("o"), F.lit("<http://e/g>").alias("g"))
    assert get(QuadStore.of(rows).statistics()) == [("<http://e/p>", 20_000, 20_000, 7000)]


def test_hot_predicate_is_split(spark):
    rows = [(f"<http://e/{i}>", "<http://e/hot>", '"x"', f"<http://e/g{k}>") for i in range(1000) for k in range(2)] + [("<http://e/1>", "<http://e/cold>", '"y"', "<http://e/g>")]
    parts = QuadStore.of(spark.createDataFrame(rows, "s string, p string, o string, g string")).hexastore_parts("p", most=100).collect()
    assert max(len(r.entries) for r in parts) < 200 and all(r.entries == sorted(r.entries) for r in parts)
    assert sorted((r.p, *e) for r in parts for e in r.entries) == sorted({(p, s, o) for s, p, o, _ in rows})


def test_access_paths(store):
    assert [access_path(set(b)) for b in ("", "s", "sp", "p", "po", "o", "so", "g", "gs", "spog", "pg")] == ["spog", "spog", "spog", "posg", "posg", "ospg", "ospg", "gspo", "gspo", "spog", "posg"]
    laid = store.laid_out()
    assert laid.warm() == {x: store.quads.count() for x in ORDERS}
    for s, p, o, g in [(None, None, None, None), (Iri("http://e/a"), None, None, None), (None, None, Iri("http://e/b"), None), (None, Iri("http://e/knows"), None, None), (None, None, None, Iri("http://e/g1"))]:
        assert get(laid.match(s, p, o, g)) == get(store.match(s, p, o, g))


@pytest.mark.parametrize("text", [
    "SELECT ?x ?y WHERE { ?x <http://e/knows> ?y . ?y <http://e/knows> ?z . ?z <http://e/age> ?v FILTER(?v > 4) }",
    "SELECT * WHERE { ?x <http://e/age> ?v OPTIONAL { ?x <http://e/name> ?n } }",
    "SELECT ?g ?x WHERE { GRAPH ?g { ?x ?p <http://e/b> } }",
    "SELECT ?x FROM <http://e/g1> WHERE { ?x ?p ?o }",
    "SELECT ?x ?g FROM NAMED <http://e/g1> WHERE { GRAPH ?g { ?x ?p ?o } }",
    "SELECT ?y WHERE { <http://e/a> <http://e/knows>+ ?y . ?y <http://e/age> ?v }",
    "SELECT ?x WHERE { ?x <http://e/knows> ?x }",
    "SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x <http://e/knows> ?y MINUS { ?x <http://e/name> ?m } } GROUP BY ?x",
    "SELECT ?x WHERE { ?x <http://e/age> ?v FILTER(EXISTS { ?x <http://e/name> ?n } || ?v = 5) }",
    "SELECT ?x ?y WHERE { { ?x <http://e/knows> ?y } UNION { ?y <http://e/knows> ?x } }",
    "ASK { ?x <http://e/nothing> ?y }",
    "CONSTRUCT { ?y <http://e/knownBy> ?x } WHERE { ?x <http://e/knows> ?y }",
])
def test_ids_give_the_same(store, text):
    def shown(source):
        return sorted(str(sorted(r.asDict().items())) for r in sparql(source, text).collect())

    assert shown(IdStore.of(store)) == shown(store)


def test_ids_join_before_terms(store):
    """The joins of a pattern are over numbers; of its three variables one is decoded."""
    ids = IdStore.of(store)
    plan = sparql(ids, "SELECT ?x WHERE { ?x <http://e/knows> ?y . ?y <http://e/knows> ?z }")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("term#") and plan.count("Join Inner") == 2


def test_ids_after_a_single_known_one(store, spark):
    """A dictionary whose largest id is 0 grows from 1 on."""
    one = spark.createDataFrame([(0, "<http://e/a>")], "id long, term string").withColumns({c: F.lit(None).cast(t) for c, t in (("kind", "tinyint"), ("lex", "string"), ("dt", "string"), ("lang", "string"))})
    grown = store.dictionary(one)
    assert grown.count() == grown.select("id").distinct().count() and grown.where("id = 0").select("term").first()[0] == "<http://e/a>"


def test_result_formats(store, spark, tmp_path):
    import csv
    import json
    import xml.etree.ElementTree as tree

    text = "SELECT ?s ?v ?n WHERE { ?s <http://e/age> ?v OPTIONAL { ?s <http://e/name> ?n } } ORDER BY ?s"
    made = {f: [r.value for r in formatted(store, text, f).collect()] for f in FORMATS}
    rows = sorted(map(str, sparql(store, text).collect()))
    found = json.loads("\n".join(made["json"]))
    assert found["head"]["vars"] == ["s", "v", "n"] and len(found["results"]["bindings"]) == len(rows)
    assert found["results"]["bindings"][0]["s"] == {"type": "uri", "value": "http://e/a"}
    assert any(b.get("n", {}).get("xml:lang") == "en" and b["n"]["value"] == 'a "quoted" • name' for b in found["results"]["bindings"])
    assert all("datatype" in b["v"] for b in found["results"]["bindings"])
    root = tree.fromstring("\n".join(made["xml"]))
    results = root.findall(".//{http://www.w3.org/2005/sparql-results#}result")
    assert len(results) == len(rows) and any(x.text == 'a "quoted" • name' for x in root.iter())
    table = list(csv.reader(made["csv"]))
    assert table[0] == ["s", "v", "n"] and table[1][0] == "http://e/a" and len(table) == len(rows) + 1
    assert made["tsv"][0] == "?s\t?v\t?n" and made["tsv"][1].startswith("<http://e/a>\t") and len(made["text"]) == len(table)
    write_results(store, text, f"{tmp_path}/out", "json")
    assert json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))) == found
    empty = formatted(store, "SELECT ?x WHERE { ?x <http://e/nothing> ?y }", "json").collect()
    assert json.loads("\n".join(r.value for r in empty))["results"]["bindings"] == []


def test_runner(store, tmp_path):
    (tmp_path / "mix").mkdir()
    (tmp_path / "mix/b.rq").write_text("SELECT ?x\nWHERE { ?x <http://e/knows> ?y }")
    (tmp_path / "mix/a.rq").write_text("ASK { ?x <http://e/knows> ?y }")
    (tmp_path / "lines").write_text("# comment\n\nASK { ?x ?p ?y }\n")
    (tmp_path / "patterns").write_text("<http://e/a> ? ? ?\n? <http://e/knows> ?\n")
    mix = runner.queries_of_folder(f"{tmp_path}/mix")
    assert [n for n, _ in mix] == ["a.rq", "b.rq"] and runner.queries_of_file(f"{tmp_path}/lines") == [("line3", "ASK { ?x ?p ?y }")]
    times = runner.timed(store, mix, runs=2, warm=1)
    assert [(n, run, rows) for n, run, _, rows in times] == [("a.rq", 0, 1), ("b.rq", 0, 4), ("a.rq", 1, 1), ("b.rq", 1, 4)]
    runner.write_times(times, f"{tmp_path}/times.csv")
    assert (tmp_path / "times.csv").read_text().startswith("query,run,microseconds,rows")
    found = runner.matches(store, runner.patterns_of_file(f"{tmp_path}/patterns"))
    assert found.where("pattern = 1").count() == 4 and found.where("pattern = 0").count() == store.match("<http://e/a>").count()


def test_cancelled_query(store, spark):
    text = "SELECT ?x WHERE { ?x <http://e/knows> ?y }"
    assert len(runner.Running(store, text).result(120)) == 4
    slow = F.udf(lambda x: time.sleep(60) or x)
    began = time.perf_counter()
    with pytest.raises(TimeoutError):
        runner.Running(store, text, lambda df: df.select(slow("x")).collect()).result(3)
    assert time.perf_counter() - began < 40
    assert store.quads.count() == 8


def test_load_goes_on(spark, tmp_path):
    (tmp_path / "in.nq").write_text("\n".join(LINES))
    ids = load.load_ids(spark, f"{tmp_path}/in.nq", f"{tmp_path}/store")
    text = "SELECT ?x ?y WHERE { ?x <http://e/knows> ?y }"
    want = get(sparql(ids, text))
    assert len(want) == 4
    made = {x: (tmp_path / "store" / x / "_SUCCESS").stat().st_mtime_ns for x in ("quads", "dictionary", "encoded", *ORDERS)}
    (tmp_path / "store/posg/_SUCCESS").unlink()  # as if the load had been stopped while it wrote this table
    assert get(sparql(load.load_ids(spark, f"{tmp_path}/in.nq", f"{tmp_path}/store"), text)) == want
    again = {x: (tmp_path / "store" / x / "_SUCCESS").stat().st_mtime_ns for x in made}
    assert {x for x in made if made[x] != again[x]} == {"posg"}


def test_plans(spark, tiny):
    """What the plans of some queries must have, and must not."""

    def plan(name):
        return catalogue.queries()[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()

    assert "replace" not in plan("lang_matches") and "lang" in plan("lang_matches")
    assert plan("values").count("Range (0, 1") <= 1
    assert plan("exists_in_or").count("LeftSemi") + plan("exists_in_or").count("LeftAnti") == 0
    assert "OR isnull" not in plan("optional_join_maybe").split("Join Inner", 1)[-1][:300]


def test_errors_and_tools():
    with pytest.raises(ParseError):
        parse("SELECT ?x WHERE { SERVICE <http://e/> { ?x ?p ?o } }")
    assert contexts("SELECT * WHERE { GRAPH ?g { ?s ?p ?o } }") == ["g"]
    assert "Bgp" in explain_algebra("SELECT * WHERE { ?s ?p ?o }")


node = st.sampled_from(["a", "b", "c"])
place = st.sampled_from(["?x", "?y", "?z", "<http://e/a>", "<http://e/b>"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(edges=st.sets(st.tuples(node, st.sampled_from(["p", "q"]), node), min_size=1, max_size=6), patterns=st.lists(st.tuples(place, st.sampled_from(["<http://e/p>", "<http://e/q>", "?r"]), place), min_size=1, max_size=3))
def test_patterns_like_naive_matcher(spark, edges, patterns):
    triples = [tuple(f"<http://e/{x}>" for x in e) for e in sorted(edges)]
    found = [{}]
    for pattern in patterns:
        grown = []
        for b in found:
            for t in triples:
                c, ok = dict(b), True
                for x, v in zip(pattern, t, strict=True):
                    ok &= c.setdefault(x, v) == v if x[0] == "?" else x == v
                if ok:
                    grown.append(c)
        found = grown
    names = sorted({x for p in patterns for x in p if x[0] == "?"})
    df = spark.createDataFrame([(*t, "<http://e/g>") for t in triples], "s string, p string, o string, g string")
    if not names:
        return
    got = sparql(QuadStore.of(df), f"SELECT {' '.join(names)} WHERE {{ {' . '.join(' '.join(p) for p in patterns)} }}")
    assert get(got) == sorted(tuple(b[n] for n in names) for b in found)
