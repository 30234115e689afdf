"""Loaders, parsers, sinks, the feed and the command line."""

import gzip
import json
import zipfile

import pytest

from lexiweave import cli
from lexiweave.graph import WordGraph
from lexiweave.operators import metrics
from lexiweave.sources import edges, sinks
from lexiweave.streaming import feed


def triples(df):
    return {(r["src"], r["dst"]): r["weight"] for r in df.collect()}


def test_loader_rules(spark, tmp_path):
    p = tmp_path / "edges.csv"
    p.write_text('weight,src,dst,more\n1,A, b ,x\n2,a,B,x\n1,#c,d,x\n1," #e",f,x\n0,g,h,x\n-1,g,h,x\nbad,g,h,x\nnan,g,h,x\n1.0d,g,h,x\n3,self,self,x\n1,,d,x\n2,"say ""hi""",k,x\n,q,r,x\n')
    assert triples(edges.read_edge_csv(spark, str(p))) == {("a", "b"): 3.0, ("#e", "f"): 1.0, ("self", "self"): 3.0, ('say "hi"', "k"): 2.0}
    (tmp_path / "none.csv").write_text("src,dst\na,b\n")
    assert triples(edges.read_edge_csv(spark, str(tmp_path / "none.csv"))) == {}


def test_discover_and_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", 1.5)], "src string, dst string, weight double")
    for name in ("edges_b.csv", "edges_a.csv", "edges_usf.csv", "other.csv"):
        (tmp_path / name).write_text("src,dst,weight\n")
    assert edges.discover(spark, str(tmp_path)) == ["edges_a.csv", "edges_b.csv"]
    sinks.write_edge_csv(rows, str(tmp_path / "out_csv"))
    sinks.write_edge_parquet(rows, str(tmp_path / "out_parquet"))
    assert triples(edges.read_edge_csv(spark, str(tmp_path / "out_csv"))) == triples(edges.read_edge_parquet(spark, str(tmp_path / "out_parquet"))) == {("a", "b"): 1.5}
    sinks.write_metadata(metrics.graph_summary(WordGraph(rows)), str(tmp_path / "meta"))
    (part,) = (tmp_path / "meta").glob("part-*")
    assert json.loads(part.read_text())["n_edges"] == 1


def test_gzip_lines_and_xml(spark, tmp_path):
    with gzip.open(tmp_path / "eat.gz", "wt") as f:
        f.write("cat dog 3\n")
    assert triples(edges.parse_association_lines(spark.read.text(str(tmp_path / "eat.gz")))) == {("cat", "dog"): 3.0}
    (tmp_path / "usf.xml").write_text('<all><cue word="Cat"><target word="DOG" fsg="0.5"/><target word="cat" fsg="1"/><target word="x1" fsg="1"/><target word="sun" fsg="0"/></cue></all>')
    assert triples(edges.read_usf_xml(spark, str(tmp_path / "usf.xml"))) == {("cat", "dog"): 0.5}


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "swow.zip", "w") as z:
        z.writestr("a/strength.SWOW.R123.csv", 'cue\tresponse\tR123\tstrength.R123\nCat\tdog\t7\t0.5\ncat\tx1\t7\t1\nsun\t"star"\t2\t\n')
        z.writestr("a/other.csv", "cue\tresponse\tR123\nno\tno\t1\n")
        z.writestr("usf.xml", '<all>\n<cue word="Cat">\n<target word="DOG" fsg="0.5"/>\n<target word="sun" fsg="0"/></cue><cue word="sun"><target word="star" fsg=".2"/></cue></all>')
    lines = edges.read_zip_lines(spark, str(tmp_path / "swow.zip"), "strength", "R123")
    assert sorted((r.line, r.value[:3]) for r in lines.collect()) == [(1, "cue"), (2, "Cat"), (3, "cat"), (4, "sun")]
    assert triples(edges.parse_swow(edges.delimited(lines))) == {("cat", "dog"): 0.5, ("sun", "star"): 2.0}
    assert triples(edges.read_usf_zip(spark, str(tmp_path / "swow.zip"))) == {("cat", "dog"): 0.5, ("sun", "star"): 0.2}


def test_sniffed_and_line_readers(spark, tmp_path):
    (tmp_path / "commas.csv").write_text('cue,response,strength\n"a, b",c,1\nCat,Dog,"2"\n')
    lines = edges.read_lines(spark, str(tmp_path / "commas.csv"))
    assert [r.line for r in lines.orderBy("line").collect()] == [1, 2, 3]
    assert triples(edges.parse_swow(edges.delimited(lines))) == {("cat", "dog"): 2.0}
    (tmp_path / "manual.tsv").write_text('"cue"\tresponse\tstrength.R123\tstrength\n"Cat"\tdog\tn/a\t3\ncat\tsun\t0\t5\ncat\tpan\nsun\tsun\t1\t1\npan\tegg\t1\t2\n')
    lines = edges.read_lines(spark, str(tmp_path / "manual.tsv"))
    # a strength that is no number falls through to the next column, one of 0 does not
    assert triples(edges.parse_swow_lines(lines)) == {("cat", "dog"): 3.0, ("pan", "egg"): 1.0}
    assert triples(edges.parse_swow_lines(lines, last_line=5)) == {("cat", "dog"): 3.0}
    assert edges.parse_swow_lines(lines.limit(0)).count() == 0 and edges.primary(["x", "merged"]) == "merged" and edges.primary([]) is None


def test_light_scan_stops_early(spark):
    rows = [(i, f"/a/1\t/r/IsA\t/c/en/{'abcdefghij'[i]}\t/c/en/x\t{{\"weight\": 1.0}}") for i in range(1, 10)]
    lines = spark.createDataFrame(rows, "line long, value string")
    got = lambda n: sorted(s for s, _ in triples(edges.parse_conceptnet(lines, edges.CONCEPTNET_LIGHT, 15, 0.5, "max", n, 3)))
    assert got(2) == ["b", "c"] and got(3) == ["b", "c", "d", "e", "f"] and len(got(99)) == 9


def test_results_as_json(spark, tmp_path):
    sinks.write_results({"one": spark.createDataFrame([(1, ["a"])], "n int, p array<string>").coalesce(1)}, str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "name=one").glob("part-*")
    assert json.loads(part.read_text()) == {"name": "one", "row": {"n": 1, "p": ["a"]}}


def test_document_edges(spark):
    docs = spark.createDataFrame([("A b, a-b a",), (None,), ("",), ("b b b",)], "text string")
    assert triples(edges.document_edges(docs)) == {("a", "b"): 2.0, ("b", "a"): 2.0}
    near = triples(edges.cooccurrence_edges(docs, 2, 1, None))
    assert near[("a", "b")] == 2.0 and ("b", "b") not in near


def test_format_table():
    assert sinks.format_table(["a"], []) == ""
    assert sinks.format_table(["a", "bb"], [(1, 2), (33, 4)]).splitlines()[2] == "1   2"


def test_feed(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    for i, text in enumerate(("src,dst,weight\na,b,1\n", "src,dst,weight\nA,b,2\nc,d,1\n")):
        (src / f"{i}.csv").write_text(text)
        feed.follow(spark, str(src), table, str(tmp_path / "check")).awaitTermination()
    assert triples(feed.current(spark, table)) == {("a", "b"): 3.0, ("c", "d"): 1.0}
    assert triples(feed.current(spark, table, 0)) == {("a", "b"): 1.0}
    # columns by name, and the oldest version gone
    for i, text in ((2, 'weight,more,dst,src\n4,x,"say ""hi"", b",A\nbad,x,b,a\n'), (3, "dst,src\nb,a\n")):
        (src / f"{i}.csv").write_text(text)
        feed.follow(spark, str(src), table, str(tmp_path / "check")).awaitTermination()
    assert triples(feed.current(spark, table)) == {("a", "b"): 3.0, ("c", "d"): 1.0, ("a", 'say "hi", b'): 4.0}
    assert sorted(x.name for x in (tmp_path / "table").glob("version=*")) == ["version=1", "version=2", "version=3"]


@pytest.mark.parametrize(("args", "code", "text"), [(["analyze", "{f}", "--top", "3"], 0, "Top 2 words"), (["word", "{f}", "Color"], 0, "0.4551"), (["recommend", "{f}", "color"], 0, "blue"), (["word", "{f}", "stop"], 1, "not found")])
def test_cli(spark, tmp_path, capsys, args, code, text):
    f = tmp_path / "e.csv"
    f.write_text("src,dst,weight\nstart,color,1\ncolor,red,2\ncolor,blue,1\nred,stop,1\nblue,go,1\n")
    assert cli.main([*(a.format(f=f) for a in args), "--iterations", "12"], spark) == code
    assert text in capsys.readouterr().out


@pytest.mark.parametrize(("args", "texts"), [(["details", "{f}", "color"], ["red, blue", "top_traps"]), (["simulate", "{f}", "--games", "4", "--max-turns", "3", "--target", "go"], ["result", "trapped"]), (["tournament", "{f}", "--games", "2", "--max-turns", "3"], ["greedy", "percent"])])
def test_cli_games_and_details(spark, tmp_path, capsys, args, texts):
    f = tmp_path / "e.csv"
    f.write_text("src,dst,weight\nstart,color,1\ncolor,red,2\ncolor,blue,1\nred,stop,1\nblue,go,1\n")
    assert cli.main([*(a.format(f=f) for a in args), "--iterations", "3"], spark) == 0
    out = capsys.readouterr().out
    assert all(t in out for t in texts)


def test_cli_export(spark, tmp_path):
    f = tmp_path / "e.csv"
    f.write_text("src,dst,weight\ncolor,red,2\ncolor,blue,1\n")
    assert cli.main(["export", str(f), str(tmp_path / "out"), "--iterations", "2"], spark) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns[:2] == ["word", "composite_score"]
