"""Declarations of every language on small texts, with hand-made expectations."""

import pytest

from mosaiq.operators.extract import extract
from mosaiq.operators.scanner import LANGUAGES, declarations

CASES = {
    "javascript": (
        "export default async function* gen(a) {\n  if (a) { x(); }\n}\nexport class A extends B {\n  static async run(x = {}) {\n    for (const i of x) { go(i); }\n  }\n  get size() { return `}`; }\n}\nconst f = async (a, b) => {\n  return 1;\n};\nlet g = x => x + 1;\nvar h = function () {\n};\nconst notfn = 3;\n",
        {"gen": ("function", 1, 3), "A": ("class", 4, 9), "A.run": ("method", 5, 7), "A.size": ("method", 8, 8), "f": ("function", 10, 12), "g": ("function", 13, 13), "h": ("function", 14, 15)},
    ),
    "typescript": (
        "export interface Opts {\n  a: string;\n}\nexport type Id = string;\nenum E { A, B }\nabstract class Base<T> {\n  protected abstract load(x: T): void;\n  constructor(private a: string) {\n  }\n  public find<K>(k: K): Promise<void> {\n    return this.x(k);\n  }\n}\n",
        {"Opts": ("type", 1, 3), "Id": ("type", 4, 4), "E": ("type", 5, 5), "Base": ("class", 6, 13), "Base.load": ("method", 7, 7), "Base.find": ("method", 10, 12)},
    ),
    "go": (
        "package a\n\n// func no() {\nfunc (s *Server) Run(ctx Context) (int, error) {\n\tif x := f(); x {\n\t\treturn 1, nil\n\t}\n\treturn 0, nil\n}\nfunc main() {}\ntype Store struct {\n\ta int\n}\ntype I interface {\n}\ntype N int\n",
        {"Server.Run": ("method", 4, 9), "main": ("function", 10, 10), "Store": ("type", 11, 13), "I": ("type", 14, 15)},
    ),
    "rust": (
        "pub(crate) struct P<'a> {\n    x: &'a str,\n}\nimpl<'a> Iterator for P<'a> {\n    fn next(&mut self) -> Option<char> {\n        match self.x { '{' => None, _ => None }\n    }\n}\npub async fn go(a: &str) -> bool {\n    true\n}\nmod inner {\n    fn deep() {\n    }\n}\nmod file;\ntrait T { }\n",
        {"P": ("impl", 4, 8), "P.next": ("method", 5, 7), "go": ("function", 9, 11), "inner": ("module", 12, 15), "inner.deep": ("method", 13, 14), "T": ("type", 17, 17)},
    ),
    "java": (
        "package a;\npublic final class Tool<T> {\n    private static final int N = 3;\n    public static List<String> names(int a, String b) throws E {\n        return null;\n    }\n    abstract void run();\n    interface Inner {\n        default int x() { return 1; }\n    }\n}\n",
        {"Tool": ("class", 2, 11), "Tool.names": ("method", 4, 6), "Tool.run": ("method", 7, 7), "Inner": ("class", 8, 10), "Inner.Tool.x": ("method", 9, 9)},
    ),
    "kotlin": ("data class P(val a: Int)\nobject Main {\n    suspend fun <T> List<T>.go(x: T) {\n    }\n    fun one() = 1\n}\nfun top(): Int {\n    return 1\n}\n", {"P": ("class", 1, 1), "Main": ("class", 2, 6), "Main.go": ("method", 3, 4), "Main.one": ("method", 5, 5), "top": ("function", 7, 9)}),
    "csharp": ("namespace N {\n    public sealed class A : B\n    {\n        public override async Task<int> Run(string x)\n        {\n            return 1;\n        }\n        record R { }\n    }\n}\n", {"A": ("class", 2, 9), "A.Run": ("method", 4, 7), "R": ("class", 8, 8)}),
    "c": ("#define MAX 3\n#include \"a.h\"\nstatic int *add(int a,\n                int b)\n{\n    if (a) {\n        return 0;\n    }\n    return a + b;\n}\nint later(int x);\ntypedef struct node {\n    int v;\n} node_t;\n", {"MAX": ("macro", 1, 1), "add": ("function", 3, 10), "node": ("type", 12, 14)}),
    "cpp": (
        "namespace Foam\n{\ntemplate<class T>\nclass Field : public Base<T>\n{\npublic:\n    explicit Field(int n);\n    ~Field();\n    virtual double norm() const = 0;\n    int size() const { return n_; }\n};\n}\nFoam::Field<int>::Field(int n)\n:\n    n_(n)\n{\n    init();\n}\ntemplate<class T>\nbool Foam::Field<T>::operator==\n(\n    const Field& o\n) const\n{\n    return true;\n}\nmakeField(Base, scalar);\nvoid run(int a) {\n    makeOther(a);\n}\n",
        {"Field": ("class", 3, 11), "Field.Field": ("declaration", 7, 7), "Field.~Field": ("declaration", 8, 8), "Field.norm": ("declaration", 9, 9), "Foam::Field::Field": ("method", 13, 18), "Foam::Field::operator==": ("method", 19, 26), "makeField(Base, scalar)": ("registration", 27, 27), "run": ("function", 28, 30)},
    ),
    "swift": ("public final class V: UIView {\n    override func draw(_ r: CGRect) {\n    }\n}\nextension V {\n    static func make() -> V { V() }\n}\nprotocol P {\n    func x()\n}\n", {"V": ("class", 5, 7), "V.draw": ("method", 2, 3), "V.make": ("method", 6, 6), "P": ("class", 8, 10), "P.x": ("method", 9, 9)}),
    "php": ("<?php\n# class No {\nabstract class A extends B {\n    public static function make($x) {\n        return \"}\";\n    }\n}\nfunction top() {\n}\n", {"A": ("class", 3, 7), "A.make": ("method", 4, 6), "top": ("function", 8, 9)}),
    "scala": ("sealed trait T {\n  def a: Int\n}\ncase class P(x: Int) extends T {\n  override def a: Int = {\n    x\n  }\n}\nobject O\n", {"T": ("class", 1, 3), "T.a": ("method", 2, 2), "P": ("class", 4, 8), "P.a": ("method", 5, 7), "O": ("class", 9, 9)}),
    "dart": ("abstract class A {\n  Future<int> load(String a) async {\n    return 1;\n  }\n}\nvoid main() {\n}\n", {"A": ("class", 1, 5), "A.load": ("method", 2, 4), "main": ("function", 6, 7)}),
    "ruby": ("module A\n  class B::C < D\n    def self.make?(x)\n      if x\n        1\n      end\n    end # done\n\n    def size\n    end\n  end\nend\n", {"A": ("class", 1, 12), "B::C": ("class", 2, 11), "B::C.A.size": ("method", 9, 10), "B::C.A.make?": ("method", 3, 7)}),
    "lua": ("local function a(x)\n  return function() end\nend\nfunction M.b:c()\n  -- end\nend\n", {"a": ("function", 1, 3), "M.b:c": ("function", 4, 6)}),
    "elixir": ("defmodule A.B do\n  def go?(x) do\n    x\n  end\n  defp hide(x), do: x\nend\n", {"A.B": ("module", 1, 6), "A.B.go?": ("method", 2, 4), "A.B.hide": ("method", 5, 5)}),
    "shell": ("#!/bin/sh\n# f() {\nbuild-all() {\n  echo hi\n}\nfunction clean() {\n  :\n}\n", {"build-all": ("function", 3, 5), "clean": ("function", 6, 8)}),
    "proto": ("message A {\n  string x = 1;\n}\nservice S {\n  rpc Get(A) returns (A);\n}\nenum E {\n}\n", {"A": ("type", 1, 3), "S": ("type", 4, 6), "S.Get": ("method", 5, 5), "E": ("type", 7, 8)}),
    "sql": ("CREATE OR REPLACE VIEW v AS SELECT 1;\n-- create table no (\ncreate table if not exists a.b (\n x int\n);\n", {"v": ("table", 1, 1), "a.b": ("table", 3, 3)}),
    "objc": ("static int add(int a) {\n  return a;\n}\n", {"add": ("function", 1, 3)}),
    "vue": ("<script>\nfunction a() {\n}\n</script>\n", {"a": ("function", 2, 3)}),
    "svelte": ("<script>\nlet f = (x) => {\n};\n</script>\n", {"f": ("function", 2, 3)}),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_declarations(lang):
    text, want = CASES[lang]
    assert {s.name: (s.kind, s.start, s.end) for s in extract(text, lang)[0]} == want


def test_every_language_has_a_case():
    assert set(CASES) == set(LANGUAGES)


@pytest.mark.parametrize("lang", sorted(LANGUAGES))
def test_nothing_breaks_the_scanner(lang):
    for text in ("", "\n\n", "}}}}", "((((", "{{{{", "class", "def", "function", "fn (", "impl", "template<", "x" * 5000, "'" * 99, "/* open", '"open', "operator::(", "~::~(", "a\r\nb\r\n", "\u0000\u2028é", "end\nend", "func (", "type a struct", "struct {"):
        for s in declarations(text, lang):
            assert 1 <= s.start <= s.end


def test_long_blocks_have_their_whole_span():
    text = "func a() {\n" + "\tx()\n" * 20_000 + "}\n"
    assert [(s.name, s.start, s.end) for s in declarations(text, "go")] == [("a", 1, 20_002)]
    assert [(s.name, s.end) for s in declarations("def a\n" + "  x\n" * 9_000 + "end\n", "ruby")] == [("a", 9_002)]
