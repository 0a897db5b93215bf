"""The Turtle source on documents of every form, in pieces of every size, and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import semantic
from loomgraph.plans.registry import star_edges, star_nodes
from loomgraph.sources import turtle
from loomgraph.sources.turtle import RDF, XSD, Parser, TurtleError

DOC = r'''# a comment with "quotes" and <iris>
@prefix ex: <http://x.example/ns#> .
PREFIX : <http://x.example/>
@base <http://base.example/dir/doc> .
ex:a a ex:Thing ; ex:p "one", 'two'@en-GB , "3"^^ex:int ;; ex:q 1, -2.5, 1e3, true .
:b.c ex:p <rel#x>, <../up>, <>, <http://abs.example/\u00e9> .
_:n1 ex:knows [ ex:name "inner" ; ex:list ( 1 "x" [] ) ], _:n1 .
[ ex:p ex:o ] .
[] ex:p """long "quoted"
line \t tab \\ and ""two"" \U0001F600""" .
ex:esc\,aped ex:p QQQit's ''two'' QQQ, "", '' , ex:pct%20 .
ex:last ex:p ex:o.'''.replace("QQQ", "'" * 3)
X = "http://x.example/ns#"
PLAIN = {
    (X + "a", RDF + "type", X + "Thing", "iri", None), (X + "a", X + "p", "one", "literal", None), (X + "a", X + "p", "two", "literal", "@en-GB"), (X + "a", X + "p", "3", "literal", X + "int"),
    (X + "a", X + "q", "1", "literal", XSD + "integer"), (X + "a", X + "q", "-2.5", "literal", XSD + "decimal"), (X + "a", X + "q", "1e3", "literal", XSD + "double"), (X + "a", X + "q", "true", "literal", XSD + "boolean"),
    ("http://x.example/b.c", X + "p", "http://base.example/dir/doc#x".replace("doc#x", "rel#x"), "iri", None), ("http://x.example/b.c", X + "p", "http://base.example/up", "iri", None),
    ("http://x.example/b.c", X + "p", "http://base.example/dir/doc", "iri", None), ("http://x.example/b.c", X + "p", "http://abs.example/é", "iri", None),
    (X + "esc,aped", X + "p", "it's ''two'' ", "literal", None), (X + "esc,aped", X + "p", "", "literal", None), (X + "esc,aped", X + "p", X + "pct%20", "iri", None), (X + "last", X + "p", X + "o", "iri", None),
}


def parsed(text, size=1 << 20):
    return list(Parser(iter([text[i : i + size] for i in range(0, len(text), size)]), "t").triples())


def test_all_forms():
    found = parsed(DOC)
    plain = [t for t in found if not t[0].startswith("_:") and not t[2].startswith("_:")]
    assert set(plain) == PLAIN and len(plain) == len(PLAIN) + 1  # "" twice
    blank = [t for t in found if t not in plain]
    assert [t[2] for t in blank if t[0] == "_:t-n1"][1] == "_:t-n1"
    inner = next(t[2] for t in blank if t[0] == "_:t-n1")
    assert (inner, X + "name", "inner", "literal", None) in blank
    node, seen = next(t[2] for t in blank if t[:2] == (inner, X + "list")), []
    while node != RDF + "nil":
        own = {p: o for s, p, o, *_ in blank if s == node}
        seen.append(own[RDF + "first"])
        node = own[RDF + "rest"]
    assert seen[:2] == ["1", "x"] and seen[2].startswith("_:") and len(seen) == 3
    assert any(t[2] == 'long "quoted"\nline \t tab \\ and ""two"" 😀' for t in blank)
    assert len(found) == len(PLAIN) + 1 + 12


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_pieces_of_any_size_give_the_same(size):
    assert parsed(DOC, size) == parsed(DOC)


@pytest.mark.parametrize("text", ["ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", '"x" <b> <c> .', "<a> <b> 'open .", "<a> <b> [ <c> .", "<a> <b> <c> ; <d> .", "@prefix x <y> .", "<a> <b c> <d> ."])
def test_errors(text):
    with pytest.raises(TurtleError):
        parsed(text)


def test_empty_documents():
    assert parsed("") == parsed("  # only a comment") == parsed("@prefix a: <b> .") == []


def test_folders_are_partitions(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.ttl").write_text(f"@prefix e: <http://e{i}/> . e:s e:p [ e:q {i} ] .")
    (tmp_path / "note.txt").write_text("no triples")
    (tmp_path / "_left.ttl").write_text("broken")
    df = turtle.read_turtle(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert len(rows) == 6 and len({r.s for r in rows if r.s.startswith("_:")}) == 3
    with pytest.raises(Exception, match="nothing"):
        turtle.read_turtle(spark, str(tmp_path / "nothing")).count()


def test_round_trip(spark, tmp_path):
    rows = [
        ("http://x/a b", "http://x/p", 'say "hi"\n\ttab \\ back \x01 ☃', "literal", None), ("http://x/ns#one", RDF + "type", "http://x/ns#Class", "iri", None), ("http://x/ns#one", "http://x/ns#p", "5", "literal", XSD + "integer"),
        ("http://x/ns#one", "http://x/ns#p", "cinq", "literal", "@fr"), ("_:b1", "http://x/ns#p", "_:b2", "blank", None), ("urn:g#node/C#1", "http://x/ns#p", "", "literal", None), ("http://x/ns#", "http://x/ns#9", "http://x/<odd>", "iri", None),
    ]
    df = spark.createDataFrame(rows, turtle.SCHEMA)
    for _ in range(2):  # the second write takes the first one's place
        turtle.write_turtle(df, str(tmp_path / "out"), {"ns": "http://x/ns#", "xsd": XSD})
    back = [tuple(r) for r in turtle.read_turtle(spark, str(tmp_path / "out")).collect()]
    named = lambda found: sorted((t for t in found if not t[0].startswith("_:")), key=str)
    assert named(back) == named(rows) and len(back) == len(rows)
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*.ttl"))
    assert "ns:one a ns:Class" in text and '"5"^^xsd:integer' in text and not list((tmp_path / "out").glob("_*"))


def test_plain_statements_are_read_many_at_once(spark, monkeypatch, tmp_path):
    rows = [(f"http://x/ns#s{i // 3}", RDF + "type" if i % 3 else "http://x/ns#p", f"http://x/o/{i}", "iri", None) for i in range(900)]
    turtle.write_turtle(spark.createDataFrame(rows, turtle.SCHEMA).coalesce(1), str(tmp_path / "t"), {"ns": "http://x/ns#"})
    took, statement = [], Parser.statement
    monkeypatch.setattr(Parser, "statement", lambda self: (took.append(1), statement(self)))
    found = [t for f in sorted((tmp_path / "t").glob("part-*.ttl")) for t in parsed(f.read_text())]
    assert sorted(found, key=str) == sorted(rows, key=str)
    assert len(took) <= 3 * len(list((tmp_path / "t").glob("part-*.ttl")))  # the prefix and the end of each file


PARTS = [
    "<http://a> <http://b> <http://c> .", 'ex:a a ex:B ; ex:p "x"@en-GB , "y" .', 'ex:a ex:p "x"^^ex:int ; <u:q> "z"^^<u:t> .', "ex:a ex:p ex:b.c .", "ex:a ex:p ex:b.", 'ex:a ex:p "" .', "ex:a ex:p 'a . b' .", 'ex:a ex:p """l . " ; ex:q "no" .\n""" .',
    "ex:a ex:p 5 ; ex:q true .", "ex:a ex:p ex:o ; .", "ex:a ex:p ex:o ;; ex:q ex:r .", "# ex:a ex:p ex:o .\n", "ex:a ex:p ex:o . # <u:a> <u:b> <u:c> .\n", 'ex:a ex:p "t\\t é日" .', "@prefix ex: <http://new/> .", "PREFIX ex: <http://old/>", "_:b ex:p _:c .", "[] ex:p ex:o .",
    "<rel> ex:p <http://h/\\u00e9> .", "ex:a\nex:p\n<http://c>.", "a:x a a:y .", "ex:a <u:p> 'é'@fr .", "ex:é ex:p ex:o .", "ex:a ex:p ( ex:b 1 ) .", "ex:a <u:p>\t<u:o>;\tex:q\tex:r\t.\t",
]


@pytest.mark.parametrize("size", [11, 60, 1 << 20])
def test_plain_and_other_statements_mixed(monkeypatch, size):
    rng = random.Random(size)
    texts = ["@base <http://base/> . @prefix ex: <http://x/> . @prefix a: <http://a/> .\n" + rng.choice(["\n", " "]).join(rng.choices(PARTS, k=40)) + "\n" for _ in range(60)]
    many = [parsed(t, size) for t in texts]
    monkeypatch.setattr(turtle.Tokens, "plain", lambda self: [])
    assert many == [parsed(t, size) for t in texts] and sum(map(len, many)) > 2000


def test_errors_among_plain_statements():
    for text in ("no:a <u:p> <u:o> . <u:a> <u:b> <u:c> .", "<u:a> <u:b> no:c . ", "<u:a> <u:b> <u:c> . <u:a> <u:b> . ", "<u:a> <u:b> <u:c> . <u:a> <u:b> <u:c> ; "):
        with pytest.raises(TurtleError):
            parsed(text)


def test_repeats_are_written_once(spark, tmp_path):
    rows = [("u:s", "u:p", "x", "literal", t) for t in (None, "@fr", "u:t")] + [("u:s", "u:p", "x", "iri", None), ("u:t", "u:p", "x", "literal", None)]
    turtle.write_turtle(spark.createDataFrame(rows * 5000, turtle.SCHEMA), str(tmp_path / "t"))
    assert sorted(map(tuple, turtle.read_turtle(spark, str(tmp_path / "t")).collect()), key=str) == sorted(rows, key=str)


def test_graph_export(spark, sf_dir, tmp_path):
    rows = semantic.instances(star_nodes(spark, sf_dir), star_edges(spark, sf_dir)).cache()
    turtle.write_turtle(rows, str(tmp_path / "g"), {"g": semantic.NAMESPACE, "rdfs": semantic.RDFS})
    back = turtle.read_turtle(spark, str(tmp_path / "g")).select("s", "p", "o", "o_kind")
    assert back.count() == rows.count() and back.exceptAll(rows).isEmpty()
    fixed = semantic.ontology(spark, [])
    turtle.write_turtle(fixed, str(tmp_path / "o"))
    assert turtle.read_turtle(spark, str(tmp_path / "o")).select(*fixed.columns).exceptAll(fixed).isEmpty()
    assert fixed.filter(F.col("o_kind") == "iri").count() > 0
