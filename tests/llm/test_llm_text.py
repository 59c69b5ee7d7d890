"""Pair defects, file origins, encoding, mixing and repetition: known cases, brute force, nulls, empty tables, long texts."""

import collections
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.llm import broken_pairs as bp
from mosaiq.llm import encode as en
from mosaiq.llm import lexicon as lx
from mosaiq.llm import mix_sources as mx
from mosaiq.llm import nonhand_files as nf
from mosaiq.llm import pretokenize as pt
from mosaiq.llm import repetition as rp
from mosaiq.llm.arrow_text import text_slices

Q = "How does `load_page` decide when to open the hidden gateway?"
GOOD = "`load_page` opens it once the cache is warm. It then returns the page."


@pytest.mark.parametrize(
    "answer, want",
    [
        (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("???", "empty"), ("N/A", "empty"), ("<answer></answer>", "empty"), ("```\n```", "empty"), ("**TODO**", "empty"),
        ("Answer for the page to be written.", "empty"), ("No.", None), ("`None`.", None), ("not safely", None), ("120 ms", None), (GOOD, None),
        (Q, "copied"), (Q.upper(), "copied"), ("Good question. " + Q, "copied"), (f"{Q}\n\nAnswer: {Q}", "copied"), ("to open the hidden gateway How does `load_page` decide when", "copied"),
        (f"{Q} No.", None), (f"You asked: {Q}\n\n{GOOD}", None),
        ("I'm sorry, but I can't help with that.", "refusal"), ("Hello! As a language model I have no access to a/b.py, so I must decline. I hope you understand.", "refusal"),
        ("Leider liegt mir a/b.py nicht vor, daher muss ich die Antwort schuldig bleiben.", "refusal"), ("`load_page` cannot answer before the stage polls, hence the 400 ms wait.", None),
        (f"I can't see the full body of `load_page`. {GOOD}", None), ('It prints "I\'m sorry, but I can\'t help with that." when the cache is cold and the gateway is closed.', None),
        ("It starts in a/b.py, where `load_page` opens the", "truncated"), (GOOD + "\n\n```python\nx = (1", "truncated"), (GOOD + "\n\n```python\nx = (1\n```", None), (GOOD + " However,", "truncated"),
        (GOOD + " After that it calls `trusted_", "truncated"), (GOOD + "\n\nSee `a/b.py:L1-9`", None), (GOOD + " Here is the list:", "truncated"), ("There are steps:\n1. Open it.\n2. Close it.\n3.", "truncated"),
        ("Je nach Lage öffnet `load_page` die Seite nicht, wenn der Speicher leer ist und die Sitzung fehlt.", "other_language"), ("如果缺少页面，`load_page` 会返回默认值并继续执行。", "other_language"),
        ("Каждый токен остаётся открытым, пока `load_page` его не закроет.", "other_language"),
    ],
)
def test_defects(answer, want):
    assert bp.defect(Q, answer) == want


def test_pairs_table(spark):
    schema = "pair_id int, question string, answer string, defect string"
    df = spark.createDataFrame([(1, Q, GOOD, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, None, "I cannot answer this.", None), (4, Q, "word " * 50_000 + "end.", None)], schema)
    got = [(r.pair_id, r.defect) for r in bp.broken_pairs(df.drop("defect")).collect()]
    assert sorted(got) == [(2, "empty"), (2, "empty"), (3, "refusal")]
    assert bp.broken_pairs(df.where("pair_id < 0")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab `\"*()[]{}\n.#-1~", max_size=60))
def test_defects_never_fail(text):
    assert bp.defect("what is this thing", text) in (None, "empty", "truncated", "refusal", "copied", "other_language")


def test_tiling_agrees_with_brute_force():
    random.seed(4)
    for _ in range(40):
        q, a = [random.choice("abcde") for _ in range(8)], [random.choice("abcdef") for _ in range(14)]
        marked = [n >= 3 for n in bp.tiles(q, a)]
        grams = {tuple(q[j : j + 3]) for j in range(len(q) - 2)}
        for i, m in enumerate(marked):
            if m:
                assert any(tuple(a[k : k + 3]) in grams for k in range(max(0, i - 2), i + 1))


HAND = """import { RigidParser } from "./prefix/remote";

export async function readDaemon(flatPanel: string): Promise<Binder> {
    await this.encodePointer(selectFence, 201);
    throw new TraceProbeError(`hot mutex`);
    const x = left ? right : other;
}
"""


@pytest.mark.parametrize(
    "path, head, want",
    [
        ("src/a.ts", HAND, None), ("src/gen/a.ts", HAND, "generated"), ("src/a.pb.go", HAND, "generated"), ("src/code_generator.ts", HAND, None), ("src/autogenous_growth.ts", HAND, None),
        ("a.ts", "// Code generated by stubforge. DO NOT EDIT.\n" + HAND, "generated"), ("a.ts", "// Emits the DO NOT EDIT banner into every file that stubforge writes.\n" + HAND, None),
        ("a.ts", "// Not auto-generated. The table below is maintained by reviewers.\n" + HAND, None), ("third_party/zelfold-1.4.6/a.ts", HAND, "third_party"), ("src/vendor/portal/a.ts", HAND, None),
        ("src/zelfold-1.4.6.js", HAND, "third_party"), ("a.ts", "// Vendored from zelfold 1.4.6, see VENDORED.md\n" + HAND, "third_party"),
        ("a.ts", "// Thin adapter around zelfold 1.4.6; the library itself is installed separately.\n" + HAND, None),
        ("a.js", "function a(b,c){return b.d(c||1)}var e=f[1],g=!1;e&&(h=i?j:void 0);" * 9, "minified"), ("a.py", "KEY = \"" + "aB3/x" * 170 + '"', "data"),
        ("a.py", "id;name;size\n" + "\n".join(f"{i * 7919};buffer;{i * 31}" for i in range(30)), "data"), ("a.c", "static const unsigned char X[] = {\n" + "  0x2a, 0x9f, 0x34, 0x58,\n" * 30 + "};", "data"),
        ("a.go", "import x \"y\"\n" + "\n".join(f"_fld_{i} = _desc.add({i}, {i * 3}, 12, 3, None)" for i in range(20)), "generated"), (None, None, None), ("a.py", "", None), ("src/a.min.js", None, "minified"), ("src/lut_52.py", None, "data"), ("src/lut_52.py", HAND, None),
    ],
)
def test_origins(path, head, want):
    found, keys = nf.origin(path, head, 60, 2000)
    assert ("third_party" if {"zelfold", "kipdash"} & set(keys) else found) == want


def test_the_canonical_layout_is_compared_with_the_original():
    statements, lines, comments = nf.emitted("a = -1; b(2,\n 3)\nif x { y() } // end\n")
    assert ["".join(t for _, t in s) for s in statements] == ["a=-1;", "b(2,3)", "ifx{", "y()}", "// end"] and ["".join(x) for x in lines[:3]] == ["w=N;w(N,", "N)", "w w{w()}".replace(" ", "")] and comments == ["// end"]
    minified = nf.layout("function a(b,c){return b.d(c||1)}var e=f[1],g=!1;e&&(h=i?j:void 0);" * 9)
    assert minified.expansion > 20 and minified.stretched > 20 and 0.5 < nf.layout(HAND).expansion < 2 and nf.layout(HAND).stretched < 4 and nf.laid_out(nf.layout(HAND)) is None
    assert nf.laid_out(nf.layout("")) is None and nf.laid_out(nf.layout("\n\n")) is None and nf.laid_out(nf.layout("x" * 400)) is None


def test_banners_count_on_any_line_and_in_docstrings():
    low = "\n" * 20 + "# Code generated by stubforge. DO NOT EDIT.\n" + "def a():\n    return b\n"
    assert nf.origin("a.py", low, 30, 900)[0] == "generated" and nf.origin("a.py", "# licence\n\"\"\"machine-written, do not edit\"\"\"\nx = 1\n", 30, 900)[0] == "generated"


def test_files_table(spark):
    schema = "file_id long, path string, head string, lines int, bytes long, sha string, is_code boolean, origin string"
    rows = [
        (1, "a.ts", HAND, 9, 200, "s1", True, "x"), (1, "a.ts", HAND, None, None, None, False, "x"), (2, "b.ts", HAND, 9, 200, "lib", True, "x"), (3, "gen/c.ts", HAND, 9, 200, "s3", None, "x"),
        (4, "gen/d.ts", HAND, 9, 200, "s4", True, "x"), (4, "gen/d.ts", HAND, 9, 200, "s4", True, "x"), (None, "gen/e.ts", HAND, 9, 200, "s5", True, "x"), (5, None, None, None, None, None, True, None),
        (6, "copy.ts", HAND, 9, 200, "s1", True, None),
    ]
    libs = spark.createDataFrame([("zelfold", "1", "lib"), (None, None, None)], "lib string, version string, sha string")
    df = spark.createDataFrame(rows, schema)
    assert sorted((r.file_id, r.origin) for r in nf.nonhand_files(df, libs).collect()) == [(2, "third_party"), (4, "generated")]
    assert nf.nonhand_files(df.where("file_id > 99"), libs.where("lib = 'no'")).collect() == []


VOCABULARY = en.vocabulary_path()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")


def reference_ids(texts):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=lx.read_ranks(VOCABULARY), special_tokens={})
    return [coder.encode_ordinary(t) if t else [] for t in texts]


@needs_vocabulary
def test_ids_agree_with_the_public_tokenizer(spark):
    random.seed(6)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "a", "B", "é", "漢", "1", "²", "!", "''", "😀", "​", "\r\n", "_", "<|endoftext|>", "x" * 60, "\x1c", "don't", " we'll"]
    texts = [None, "", " ", "'s", "\n's", "a" * 5000, "ab" * 3000 + " ", *["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(400)]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in en.encode(df).collect()}
    assert [got[i] for i in range(len(texts))] == reference_ids(texts)
    sizes = {r.doc_id: r.n_tokens for r in en.encode(df, ids=False).collect()}
    assert all(sizes[i] == len(got[i]) for i in got)


@needs_vocabulary
def test_ids_do_not_depend_on_the_lexicon(spark):
    texts = ["the quick brown fox", "the the the", "naïve façade 12345"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    folder = en.build_lexicon(df, VOCABULARY, most=2)
    assert [r.ids for r in en.encode(df, lexicon=folder).orderBy("doc_id").collect()] == reference_ids(texts)
    assert en.encode(df.where("doc_id < 0")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=7), max_size=60), st.lists(st.binary(min_size=1, max_size=7), max_size=20))
def test_lexicon_round_trip(known, others):
    entries = {w: list(w) for w in known}
    lexicon = lx.Lexicon.compile(entries)
    words = sorted(known) + others
    data = np.frombuffer(b"".join(words), np.uint8)
    borders = np.cumsum([0, *map(len, words)])
    for w, n in zip(words, lexicon.numbers(data, borders).tolist()):
        assert (n >= 0) == (w in entries)
        if n >= 0:
            assert lexicon.ids[lexicon.start[n] : lexicon.start[n + 1]].tolist() == entries[w]


def test_automaton_is_minimal():
    root = lx.minimal_automaton(sorted([b"stopped", b"dropped", b"stopping", b"dropping"]))
    assert len(lx._states(root)) == 11  # s t | d r share everything from "op" on


def test_merge_agrees_with_plain_merging():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaaa": 260, b"ca": 261}

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    random.seed(7)
    for _ in range(400):
        word = bytes(random.choice(b"abc") for _ in range(random.randint(1, 14)))
        assert lx.merge(word, ranks) == (plain(word) if word not in ranks else [ranks[word]])


def test_slices_of_nulls_and_long_texts():
    column = pa.array(["a", None, "b" * 50, "", "é"]).slice(1)
    got = []
    for a, b, data, offsets in text_slices(column, 10):
        got += [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(b - a)]
    assert got == ["", "b" * 50, "", "é"]
    assert pt.words(np.frombuffer(b"a\xff b", np.uint8), np.array([0, 4]))[0].tobytes().decode() == "a� b"


def test_allotment_reaches_the_total_and_keeps_caps():
    given_ = mx.allot({"a": 100.0, "b": 10.0, "c": 1000.0}, {"a": 0.3, "b": 0.3, "c": 0.3, "d": 0.1}, {"a": 2, "b": 2, "c": 1, "d": 5}, 400.0)
    assert given_["b"] == 20 and given_["d"] == 0 and sum(given_.values()) == pytest.approx(400) and given_["a"] == pytest.approx(190)
    assert sum(mx.allot({"a": 1.0}, {"a": 1.0}, {"a": 3}, 100.0).values()) == 3
    assert mx.allot({}, {}, {}, 5.0) == {}


@pytest.mark.parametrize("rate, cap", [(0.0, 3), (0.3, 1), (0.9, 1), (1.7, 4), (3.999, 4), (4.0, 4), (9.0, 2), (0.5, 0), (740.0, 1000), (800.0, 1000), (999.5, 1000), (50_000.0, 10**9), (0.001, 10**9)])
def test_poisson_steps_have_the_mean(rate, cap):
    least, steps = mx.poisson_steps(rate, cap)
    assert least + len(steps) <= cap and len(steps) < 50 * (rate + 4) ** 0.5 + 200 and least + sum(1 - x for x in steps) == pytest.approx(min(rate, cap), rel=1e-6, abs=1e-6)


def test_mix_reaches_targets(spark):
    random.seed(8)
    docs = [(i, " Big " if i % 3 else "small" if i % 2 else None, random.randint(0, 40)) for i in range(6000)]
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.4, 3), ("ghost", 0.1, 2), (None, 0.2, 1)], "source string, weight double, max_repeats int")
    mix = mx.mix_sources(spark.createDataFrame(docs, "doc_id int, source string, n_tokens long"), targets, 50)
    rows = mix.collect()
    whole = sum(n for _, _, n in docs)
    assert abs(sum(r.n_tokens for r in rows) / whole - 0.5) < 0.03
    got = {r.source: r for r in mx.shares(mix, targets).collect()}
    assert abs(got["big"].share - 5 / 9) < 0.03 and abs(got["small"].share - 4 / 9) < 0.03 and got["ghost"].tokens == 0
    copies = collections.Counter((r.doc_id, r.copy) for r in rows)
    assert max(copies.values()) == 1 and max(r.copy for r in rows if r.source == "small") <= 3 and all(r.copy == 1 for r in rows if r.source == "big")
    assert [(r.doc_id, r.copy) for r in mix.collect()] == [(r.doc_id, r.copy) for r in rows]  # drawn from hashes, so the same again
    empty = mx.mix_sources(spark.createDataFrame([], "doc_id int, source string, n_tokens long"), targets, 50)
    assert empty.collect() == [] and {r.tokens for r in mx.shares(empty, targets).collect()} == {0}


def plain_share(raw, k):
    seen, cover = set(), [False] * len(raw)
    for i in range(len(raw) - k + 1):
        g = raw[i : i + k]
        if g in seen:
            cover[i : i + k] = [True] * k
        seen.add(g)
    return sum(cover) / len(raw)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([b"abc", b"x", b"hello world", b"zz"]), min_size=1, max_size=40), st.integers(3, 12))
def test_repeated_share_agrees_with_brute_force(parts, window):
    raw = b"".join(parts)
    k = min(window, max(3, len(raw) // 4))
    assert rp.repeated_share(raw, window) == pytest.approx(plain_share(raw, k) if len(raw) > k else 0.0)


def test_repetition_table(spark):
    random.seed(9)
    fresh = " ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400))
    spam = "Buy now 1, and save! " * 30
    shouted = "First the cache is opened by the loader 12. " + "FIRST the cache; is opened by the loader 99! " * 5
    half = fresh[:1500] + fresh[:900]
    rows = [(1, fresh), (2, spam), (3, None), (4, ""), (5, "123 !!"), (6, shouted), (7, half), (8, "no"), (9, spam), (9, spam), (10, "缓冲区已满请稍后再试" * 30), (11, fresh * 40)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id int, text string, ratio double")
    got = {r.doc_id: r for r in rp.repetition(df).collect()}
    assert got[1].repeated_share == 0 and got[1].band in ("normal", "incompressible") and got[2].repeated_share > 0.9 and got[6].repeated_share > 0.7
    assert {got[i].band for i in (3, 4, 5)} == {"empty"} and 0.3 < got[7].repeated_share < 0.45 and got[11].repeated_share > 0.95
    found = sorted(r.doc_id for r in rp.repetitive(df).collect())
    assert found == [2, 6, 7, 9, 9, 10, 11]
    assert rp.repetitive(df.where("doc_id < 0")).collect() == []


def test_the_rest_does_not_import_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(rp.__file__)))
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py") and "llm" not in os.path.relpath(folder, root).split(os.sep):
                assert "mosaiq.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
