"""Symbols, imports, their resolution, and citations on small texts."""

from mosaiq.operators import extract as ex
from mosaiq.operators import imports, links, verify

PY = '''"""Client."""
from .util import helper
import os.path

MAX_RETRIES = 3

class Client:
    """Talks."""
    def get(self, url):
        return helper(url)

    @property
    async def post(self):
        return 1

def main():
    def inner():
        pass
    return Client()
'''
TS = '''import { a } from "./a";
export class Store {
  name = "}";
  save(x: number): void {
    console.log("{");
    return;
  }
}
export const load = async (x) => {
  return x;
};
export interface Opts {
  a: string;
}
'''
HEADER = '''class Field
{
    double x;
public:
    Field(const Mesh& mesh);
    virtual double norm() const;
    void go() { stop(1); }
};
'''
SOURCE = '''#include "Field.H"
Field::Field(const Mesh& mesh)
{
    init();
}
double Field::norm() const
{
    return std::sqrt(1.0);
}
template<class T>
void Foam::Matrix<T>::solve
(
    int n
)
{
    n = 1;
}
addToRunTimeSelectionTable(Base, Field, mesh);
namespace Foam
{
}
'''


def spans(text, lang):
    return {s.name: (s.kind, s.start, s.end) for s in ex.extract(text, lang)[0]}


def test_python():
    got = spans(PY, "python")
    assert got["Client"] == ("class", 7, 14) and got["Client.get"] == ("method", 9, 10) and got["Client.post"] == ("method", 12, 14)
    assert got["MAX_RETRIES"][0] == "constant" and got["main"] == ("function", 16, 19) and "inner" not in got
    assert ex.extract(PY, "python")[1] == [".util", "os.path"]


def test_python_that_does_not_parse_has_imports_only():
    assert ex.extract("import a.b\ndef f(:\n", "python") == ([], ["a.b"])


def test_typescript_ignores_braces_in_strings():
    got = spans(TS, "typescript")
    assert got["Store"] == ("class", 2, 8) and got["Store.save"] == ("method", 4, 7) and got["load"] == ("function", 9, 11) and got["Opts"][0] == "type"
    assert ex.extract(TS, "typescript")[1] == ["./a"]


def test_cpp_declarations_and_definitions():
    head, body = spans(HEADER, "cpp"), spans(SOURCE, "cpp")
    assert head["Field.norm"] == ("declaration", 6, 6) and head["Field.Field"][0] == "declaration"
    assert body["Field::Field"] == ("method", 2, 5) and body["Field::norm"] == ("method", 6, 9) and body["Foam::Matrix::solve"][1:] == (10, 17)
    assert "std::sqrt" not in body and "Foam" not in body and [n for n, s in body.items() if s[0] == "registration"] == ["addToRunTimeSelectionTable(Base, Field, mesh)"]
    assert ex.extract(SOURCE, "cpp")[1] == ["Field.H"]


def test_other_languages():
    assert spans("func (s *Server) Run() {\n}\nfunc main() {\n}\n", "go") == {"Server.Run": ("method", 1, 2), "main": ("function", 3, 4)}
    assert spans("class A\n  def x\n  end\nend\n", "ruby")["A.x"] == ("method", 2, 3)
    assert spans("CREATE TABLE IF NOT EXISTS t (a int);\n", "sql") == {"t": ("table", 1, 1)}
    assert spans("# A\ntext\n## B\n## C\n# D\n", "markdown") == {"A": ("section", 1, 4), "B": ("section", 3, 3), "C": ("section", 4, 4), "D": ("section", 5, 5)}
    assert ex.extract('import (\n\t"fmt"\n\tx "a/b"\n)\n', "go")[1] == ["a/b", "fmt"]
    assert ex.extract("", "java") == ([], []) and ex.extract("x" * 100_000, "javascript") == ([], [])


def test_symbols_of_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "python", PY, "x"), (2, None, "a", "y"), (3, "go", None, "z")], "file_id long, lang string, text string, name string")
    rows = ex.symbols_of(df).collect()
    assert {r.file_id for r in rows} == {1} and [r.i for r in rows] == list(range(len(rows)))
    assert {r.imp for r in ex.imports_of(df).collect()} == {".util", "os.path"}
    assert ex.symbols_of(df.where("file_id > 9")).collect() == []


def test_sections_in_the_engine_agree(spark):
    text = "# A\n## B\nx\n### C\n## D\n# E\n"
    got = links.sections(ex.headings(spark.createDataFrame([(1, text), (2, None), (3, "no heading")], "file_id long, text string"))).orderBy("i").collect()
    assert [(r.start_line, r.end_line) for r in got] == [(s.start, s.end) for s in ex.extract(text, "markdown")[0]]


def files_of(spark, rows):
    return spark.createDataFrame([(i, "r", p, lang, imps) for i, (p, lang, imps) in enumerate(rows)], "file_id long, repo string, path string, lang string, imports array<string>")


def edges_of(spark, rows):
    names = [p for p, _, _ in rows]
    return {(names[e.src], names[e.dst]) for e in imports.import_edges(files_of(spark, rows)).collect()}


def test_import_resolution_by_language(spark):
    rows = [
        ("pkg/a.py", "python", [".util", "pkg.sub.mod.name", "nowhere", "pkg.a"]), ("pkg/util.py", "python", ["..x"]), ("src/pkg/sub/mod.py", "python", []), ("x/__init__.py", "python", []),
        ("web/x.ts", "typescript", ["./y", "@/app/z", "../web/lib"]), ("web/y.ts", "typescript", []), ("src/app/z.ts", "typescript", []), ("web/lib/index.ts", "typescript", []),
        ("f/Field.C", "cpp", ["Field.H", "mesh/M.H"]), ("f/Field.H", "cpp", []), ("far/mesh/M.H", "cpp", []), ("f/deep/mesh/M.H", "cpp", []),
        ("cmd/main.go", "go", ["example.com/p/store"]), ("store/a.go", "go", []), ("store/b.go", "go", []),
        ("src/lib.rs", "rust", ["crate::a::b::C", "m"]), ("src/a/b.rs", "rust", []), ("src/m.rs", "rust", []),
        ("j/App.java", "java", ["com.acme.Tool"]), ("z/com/acme/Tool.java", "java", []), ("b.rb", "ruby", ["util"]), ("lib/util.rb", "ruby", []),
        (None, "python", ["os"]), ("n.py", None, None),
    ]
    assert edges_of(spark, rows) == {
        ("pkg/a.py", "pkg/util.py"), ("pkg/a.py", "src/pkg/sub/mod.py"), ("pkg/util.py", "x/__init__.py"), ("web/x.ts", "web/y.ts"), ("web/x.ts", "src/app/z.ts"), ("web/x.ts", "web/lib/index.ts"),
        ("f/Field.C", "f/Field.H"), ("f/Field.C", "f/deep/mesh/M.H"), ("cmd/main.go", "store/a.go"), ("cmd/main.go", "store/b.go"), ("src/lib.rs", "src/a/b.rs"), ("src/lib.rs", "src/m.rs"),
        ("j/App.java", "z/com/acme/Tool.java"), ("b.rb", "lib/util.rb"),
    }


def test_import_resolution_agrees_with_plain_sql(spark):
    import random

    import duckdb

    from mosaiq.plans.graph_queries import SQL

    random.seed(5)
    folders, names = ["", "a", "a/b", "a/b/c", "src", "src/x", "lib", "com/acme"], ["m", "util", "index", "__init__", "Tool", "lib", "mod"]
    langs = {"python": ".py", "typescript": ".ts", "go": ".go", "cpp": ".h", "rust": ".rs", "java": ".java", "ruby": ".rb"}
    rows = []
    for i in range(260):
        lang = random.choice(list(langs))
        path = "/".join(x for x in (random.choice(folders), random.choice(names) + langs[lang]) if x)
        imps = {
            "python": [".m", "..util", "a.b.m.x", "b.Tool", "."], "typescript": ["./m", "../util.js", "@/x/m", "./b/../m", "src/x/Tool"], "go": ["example.com/a/b", "x/src"],
            "cpp": ["m.h", "b/util.h", "../Tool.h", "x/mod.h"], "rust": ["crate::a::b::m", "util", "crate::x::Tool::f"], "java": ["com.acme.Tool", "b.util"], "ruby": ["m", "../util", "b/Tool"],
        }[lang]
        rows.append((path, lang, random.sample(imps, 2)))
    rows = list({p: (p, lang, i) for p, lang, i in rows}.values())
    got = {(e.src, e.dst) for e in imports.import_edges(files_of(spark, rows)).collect()}
    con = duckdb.connect()
    con.execute("""CREATE TABLE files (file_id BIGINT, repo VARCHAR, path VARCHAR, lang VARCHAR, imports VARCHAR[], lines INT, bytes BIGINT, sha VARCHAR, is_code BOOLEAN, is_test BOOLEAN, module VARCHAR,
        mtime BIGINT, head VARCHAR, scanned_at TIMESTAMP, loaded_at TIMESTAMP)""")
    con.executemany("INSERT INTO files (file_id, repo, path, lang, imports, lines) VALUES (?, 'r', ?, ?, ?, 1)", [(i, p, lang, imps) for i, (p, lang, imps) in enumerate(rows)])
    assert len(got) > 60 and got == set(con.execute(SQL["import_edges"]).fetchall())


def tables(spark):
    symbols = spark.createDataFrame(
        [(1, 0, "r", "c.py", "Client", "class", 6, 11), (1, 1, "r", "c.py", "Client.get", "method", 7, 8), (1, 2, "r", "c.py", "main", "function", 13, 14), (2, 0, "r", "Field.C", "Field::norm", "method", 3, 5)],
        "file_id long, i int, repo string, path string, name string, kind string, start_line int, end_line int",
    )
    return symbols, spark.createDataFrame([(1, "r", "c.py", 14), (2, "r", "Field.C", 9)], "file_id long, repo string, path string, lines int")


def test_citations(spark):
    want = {
        "c.py::Client.get": "c.py:L7-8", "c.py::get": "c.py:L7-8", "c.py:L3-99": "c.py:L3-14", "c.py::Nope": None, "missing.py:L1": None, "Field.C::Field::norm": "Field.C:L3-5",
        "Field.C::norm": "Field.C:L3-5", "Field.C::L3": "Field.C:L3-3", "`c.py`": "c.py", "c.py:L0": None, "c.py:L15": None, "": None,
    }
    symbols, files = tables(spark)
    refs = spark.createDataFrame([(k, "r", x) for k, x in enumerate(want)] + [(99, "r", None)], "k int, repo string, ref string")
    got = verify.resolve(refs, symbols, files)
    assert {r.ref: r.resolved for r in got.collect() if r.ref is not None} == want
    assert tuple(verify.counts(got.where("ref IS NOT NULL")).first()) == (7, 5, round(7 / 12, 4))


def test_inline_citations(spark):
    symbols, files = tables(spark)
    text = "calls `c.py::main` then `c.py::ghost` and `other.py::x` at `c.py::L3-4`."
    texts = spark.createDataFrame([(1, "r", text), (2, "r", None), (3, "r", "plain")], "key int, repo string, text string")
    got = {r.key: r.annotated for r in verify.annotate(texts, symbols, files).collect()}
    assert got[1] == "calls `c.py::main` (L13-14) then `c.py::ghost` (unverified) and `other.py::x` at `c.py:L3-4`."
    assert got[2] is None and got[3] == "plain"


def test_links_prefer_near_files_and_skip_frequent_names(spark):
    symbols = spark.createDataFrame(
        [(1, 0, "caller", "function", 1, 2), (1, 1, "helper", "function", 3, 4), (2, 0, "helper", "function", 1, 1), (3, 0, "helper", "function", 1, 1), (4, 0, "helper", "function", 1, 1),
         (5, 0, "user", "function", 1, 1), (2, 1, "A.only", "method", 2, 2)],
        "file_id long, i int, name string, kind string, start_line int, end_line int",
    ).selectExpr("*", "'r' AS repo", "concat('f', file_id, '.js') AS path")
    heads = {1: "function caller() {\n helper(); only() }\nfunction helper() {\n}", 2: "helper\nonly", 3: "x", 4: "y", 5: "user helper"}
    files = spark.createDataFrame([(k, f"f{k}.js", h) for k, h in heads.items()], "file_id long, path string, head string")
    none = spark.createDataFrame([], "src long, dst long")
    got = {(r.src_file, r.src_i, r.dst_file, r.dst_i) for r in links.link_graph(symbols, files, none).collect()}
    assert got == {(1, 0, 1, 1), (1, 0, 2, 1)}
    near = spark.createDataFrame([(5, 3)], "src long, dst long")
    assert (5, 0, 3, 0) in {(r.src_file, r.src_i, r.dst_file, r.dst_i) for r in links.link_graph(symbols, files, near).collect()}
