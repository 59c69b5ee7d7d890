"""The packs of the stated questions look for the links of their seeds alone; they don't build the graph of all symbols."""

import pytest

import __spark_entry__ as entry
from mosaiq.operators import imports, links
from mosaiq.plans import views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["link_pack", "link_score_expand", "answers"])
def test_it_needs_no_graph_of_all_symbols(spark, monkeypatch, name):
    def whole(*_):
        raise AssertionError("all links were built")

    monkeypatch.setattr(views, "link_graph", whole)
    entry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("third", [0, 1, 2])
def test_links_of_seeds_are_those_of_the_graph(spark, third):
    symbols, files = views.stored_symbols(spark, SF), views.stored_files(spark, SF)
    seeds = symbols.where(f"(file_id + i) % 3 = {third}").select("file_id", "i")
    seeds = seeds.unionByName(seeds)  # of several questions
    keys = {tuple(r) for r in seeds.collect()}
    want = {tuple(r) for r in views.link_graph(spark, SF).collect() if (r.src_file, r.src_i) in keys or (r.dst_file, r.dst_i) in keys}
    got = [tuple(r) for r in links.links_of(seeds, symbols, files, lambda of: imports.import_edges(files, of)).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_links_of_seeds_beyond_the_text_and_in_prose(spark):
    symbols = spark.createDataFrame(
        [(1, 0, "seed", 1, 1, "r"), (2, 0, "user", 1, 9, "r"), (2, 1, "late", 5, 9, "r"), (3, 0, "prose", 1, 3, "r"), (4, 0, "other", 1, 3, "s"), (5, 0, "folded", 2, 1, "r"), (6, 0, "nowhere", 1, 2, None)],
        "file_id long, i int, name string, start_line int, end_line int, repo string",
    ).selectExpr("*", "'function' AS kind", "concat('f', file_id, '.js') AS path")
    heads = {1: "user", 2: "x\nseed()\nseed", 3: "seed\nseed", 4: "seed", 5: "seed\nseed", 6: "seed"}
    files = spark.createDataFrame([(k, "f3.md" if k == 3 else f"f{k}.js", h) for k, h in heads.items()], "file_id long, path string, head string")
    none = spark.createDataFrame([], "src long, dst long")
    seeds = symbols.where("name = 'seed'").select("file_id", "i")
    got = {tuple(r) for r in links.links_of(seeds, symbols, files, lambda of: none).collect()}
    assert got == {tuple(r) for r in links.link_graph(symbols, files, none).collect() if 1 in (r.src_file, r.dst_file)} == {(1, 0, 2, 0), (2, 0, 1, 0)}
