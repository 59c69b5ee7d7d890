"""Source files nobody wrote by hand for this project: generated, minified, third-party copies and data saved as code.

The beginning of each file is lexed and emitted again in a canonical layout, one statement a line. How the original compares with it tells its origin first:
far fewer lines than the canonical text mark minified code, lines that are all of one sequence of tokens mark generated code, and literals that hold most
of the text, or statements that are bare values, mark data. Where the layout is that of hand-written code, comments that declare a file as
generated, names of generated files, known sums, and names of known libraries tell the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEX = re.compile(
    r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*|^[ \t]*\"\"\".*?(?:\"\"\"|\Z)|(?<![\w\"'])#[^\n]*|(?:^|(?<=\s))--[^\n]*)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*(?:\"|\Z)|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    r"|(?P<number>\b0[xX][0-9a-fA-F]+\b|\b\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?\b)"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<line>\n)"
    r"|(?P<mark>[^\s\w])",
    re.S | re.M,
)
#: Words that begin a statement in some language, in a canonical layout on a line of their own.
STATEMENT = frozenset(
    "function var let const return if for while switch case throw class import export local def lambda end elseif else do then try catch public private static void struct".split()
)
#: Kinds of tokens after which a sign is an operator, and marks that are structure rather than text.
VALUES, STRUCTURE = frozenset(["w", "N", "S", ")", "]"]), frozenset(",;{}[]()<>=\"'")
#: How lines begin that are of one shape in hand-written code too.
PREAMBLE = re.compile(
    r"\s*(?:import|from|use|using|require|require_relative|include|#include|#define|source|mod|package|local \w+ = require|const \w+ = require|SET|set|\}|\{|end\b|\)|$|//|#|--|/\*|\*)"
)
#: Banners that generators write, and wordings about generators that people write.
GENERATED = re.compile(
    r"do not (?:edit|modify|change)\b|@generated\b|<auto-?generated\b|auto-?generated file|\bautogen(?:erated)?\s*:|automatically generated (?:by|from)|generated (?:by|from|code\b)|code generated"
    r"|emitted by the|machine[- ]written|machine[- ]generated|hand edits do not survive|lost at the next build|changes? will be (?:overwritten|lost)|created with \w+ v?\d|output of \w+ \(|produced by \w+ from"
    r"|rerun `?make|edit \S+ instead|génér\w+ par\b|ne pas modifier|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:bearbeiten|ändern|editieren)|generado (?:por|autom)|no (?:editar|modificar)\b",
    re.I,
)
NOT_GENERATED = re.compile(
    r"not auto|not generated|never generated|hand-?written|edit freely|\bemits?\b.{0,40}\bbanner|nobody edits|helpers? for|tests? (?:for|of) |checks? that|wrapper around|that .{0,30} writes|writes? the|detects?|skips? files|looks? for"
    r"|parses|reads? files|minifies|before upload",
    re.I,
)
USES = re.compile(r"adapter (?:around|for|to)|wrapper (?:around|for)|installed separately|thin \w+ around|depends on|requires|compatible with|works with|tested (?:with|against)|talks to|client for|bindings? (?:for|to)|based on ideas|inspired by|instead of|replaces|migrat", re.I)
#: Folders and file names of generated code.
GENERATED_DIR = frozenset("generated __generated__ autogen autogenerated codegen_out proto_out gen gensrc generated_src generated-sources".split())
GENERATED_NAME = re.compile(
    r"\.pb\.|\.pb-c\.|_pb2(?:_grpc)?\.|\.gen\.|_gen\.|\.g\.(?:cs|dart|tsx?|jsx?)$|[._]generated\.|^zz_generated|[._]autogen\.|^moc_|^qrc_|^ui_\w+\.(?:py|h|hpp)$|^lex\.\w+\.[ch]|\.tab\.(?:c|h|cc|hh|cpp|hpp)$"
    r"|\.designer\.|\.graphql-types\.|_bindgen\.|-parser\.gen\.|_grpc\.pb\.|\.freezed\.|_mock_gen\.",
    re.I,
)
MINIFIED_NAME = re.compile(r"[.\-](?:min|pack|prod|bundle|compressed|packed)\.[a-z]+$|^chunk-[0-9a-f]{6,}\.", re.I)
#: Names of numbered tables; they count where the text itself isn't at hand.
DATA_NAME = re.compile(r"^(?:icons|glyphs|font_table|fixture_dump|seed|lut|data|table|dump|blob)_\d+\.[a-z]+$", re.I)
VENDOR_DIR = re.compile(r"^(?:_?vendor(?:ed|s)?|third[-_]?party|3rd[-_]?party|node_modules|bower_(?:modules|components)|deps|dependencies|externals?|extern|bundled|contrib|site-packages|lib|libs)$", re.I)


@dataclass
class Layout:
    """A text and its canonical emission compared."""

    expansion: float  # emitted statements for each line that isn't blank
    stretched: float  # the longest line over the mean emitted statement
    longest: int  # characters of the longest line
    literal: float  # share of the characters of tokens that stand in literals
    literals: int
    words: int
    uniform: float  # share of the lines of code that have the most frequent sequence of tokens
    alike: int  # how many these are
    bare: float  # share of emitted statements that are single values
    comments: list[str]


def emitted(head: str) -> tuple[list[list[tuple[str, str]]], list[list[str]], list[str]]:
    """(statements of the canonical layout as lists of (kind, text), kinds of the tokens of each original line, lines of comments).

    A statement ends at ``;``, at braces, before a word that begins one, and at the end of a line outside parentheses; comments are statements of their own.
    """
    out: list[list[tuple[str, str]]] = [[]]
    lines: list[list[str]] = [[]]
    comments: list[str] = []
    depth = 0
    for m in LEX.finditer(head):
        kind, text = m.lastgroup, m.group()
        if kind == "comment":
            own = text.split("\n")
            comments += own
            out += [[(kind, x)] for x in own] + [[]]
            lines += [[] for _ in own[1:]]
            continue
        if kind == "line":
            lines.append([])
            if depth == 0 and out[-1]:
                out.append([])
            continue
        if kind == "mark":
            if text in "([":
                depth += 1
            elif text in ")]":
                depth = max(0, depth - 1)
            lines[-1].append(text)
            out[-1].append((kind, text))
            if text in ";{}":
                depth = 0
                out.append([])
            continue
        if kind == "word" and depth == 0 and out[-1] and text in STATEMENT:
            out.append([])
        if kind == "number" and lines[-1][-1:] in (["-"], ["+"]) and (len(lines[-1]) < 2 or lines[-1][-2] not in VALUES):
            lines[-1].pop()  # a sign
        lines[-1].append({"string": "S", "number": "N", "word": "w"}[kind])
        out[-1].append((kind, text))
    return [x for x in out if x], lines, comments


def layout(head: str) -> Layout:
    """What the comparison of ``head`` with its canonical layout says."""
    statements, shapes, comments = emitted(head)
    lines = head.split("\n")
    tokens = [t for x in statements for t in x if t[0] != "comment"]
    literals = [len(t) for k, t in tokens if k in ("string", "number")]
    plain = sum(len(t) for k, t in tokens if k == "word") + sum(k == "mark" and t not in STRUCTURE for k, t in tokens)
    code = ["".join(s) for x, s in zip(lines, shapes) if s and not PREAMBLE.match(x)]
    common = Counter(code[:-1] or code).most_common(1)  # the last line may be cut
    pure = [x for x in statements if x[0][0] != "comment"]
    single = sum(sum(k != "mark" for k, _ in x) == 1 and all(t in ";,|" for k, t in x if k == "mark") for x in pure)
    return Layout(
        len(statements) / max(1, sum(1 for x in lines if x.strip())), max(map(len, lines)) * max(1, len(statements)) / max(1, sum(len(t) + 1 for x in statements for _, t in x)), max(map(len, lines)),
        sum(literals) / max(1, sum(literals) + plain), len(literals), sum(k == "word" for k, _ in tokens), common[0][1] / max(1, len(code[:-1] or code)) if common and len(code) >= 5 else 0.0,
        common[0][1] if common else 0, single / max(1, len(pure)), comments,
    )


def laid_out(x: Layout) -> str | None:
    """``data``, ``minified`` or ``generated`` where the layout is not that of hand-written code."""
    dominated = x.literal >= 0.75 and (x.words <= 12 or x.literal >= 0.9) and (x.literals >= 8 or x.longest >= 160)
    if dominated or x.bare >= 0.7 and x.literals >= 8:
        return "data"
    if x.expansion >= 4 and x.stretched >= 4 or x.longest >= 500:
        return "data" if x.literal >= 0.6 else "minified"
    if x.uniform >= 0.8 and x.alike >= 8 or x.uniform >= 0.9 and x.alike >= 5:
        return "data" if x.literal >= 0.6 else "generated"
    return None


def origin(path: str | None, head: str | None, lines: int | None, size: int | None) -> tuple[str | None, list[str]]:
    """(``generated``, ``minified``, ``data`` or None for one scan of a file, names that would make it a third-party copy if a library is called so); any argument may be null."""
    parts = [x for x in re.split(r"[/\\]+", path or "") if x not in ("", ".")]
    name = parts[-1] if parts else ""
    keys = [library_key(part) for i, part in enumerate(parts[:-1]) if i and VENDOR_DIR.match(parts[i - 1])]
    stem = re.match(r"(.+?)(?:[.\-](?:min|prod|bundle))?\.[a-zA-Z]+$", name)
    if stem:
        keys.append(library_key(stem.group(1)))
    found = None
    if head:
        x = layout(head)
        found = laid_out(x)
        for line in x.comments:
            if re.search(r"\d+\.\d+", line) and not USES.search(line):
                keys += [library_key(w) for w in re.findall(r"\w[\w.@-]*", line)]
            if not found and GENERATED.search(line) and not NOT_GENERATED.search(line):
                found = "generated"
    elif (size or 0) > 5000 and (lines or 0) > 0 and size / lines > 400:
        found = "minified"
    if not found and (any(p.lower() in GENERATED_DIR for p in parts[:-1]) or GENERATED_NAME.search(name)):
        found = "generated"
    if not found and MINIFIED_NAME.search(name):
        found = "minified"
    if not found and not head and DATA_NAME.match(name):
        found = "data"
    return found, sorted({k for k in keys if k})


def library_key(word: str) -> str:
    """The name of a library as it is compared: lower case, without version and marks around it."""
    return re.sub(r"[-@]v?\d[\w.]*$", "", word.lower()).strip(".@-_")


def nonhand_files(files: DataFrame, library_refs: DataFrame) -> DataFrame:
    """(file_id, origin): the files that are code in at least one of their rows and that nobody wrote by hand here.

    All rows of a file are judged that aren't marked as no code, and one that is not hand-written is enough; rows without a file_id are left
    out. A sum (``sha``) counts as a copy only if it is one of ``library_refs``: equal files of the project itself are hand-written. Names of
    libraries meet the names of a file in an equi-join, so the catalogue may have any size. Where several origins apply the greatest by name is given.
    """

    @F.pandas_udf("origin string, keys array<string>")
    def judge(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for paths, heads, lines, sizes in frames:
            rows = zip(paths, heads, lines.astype(object).where(lines.notna(), None), sizes.astype(object).where(sizes.notna(), None))
            yield pd.DataFrame([origin(p, h, n, b) for p, h, n, b in rows], columns=["origin", "keys"])

    rows = files.where(F.col("file_id").isNotNull() & F.coalesce("is_code", F.lit(True))).select("file_id", "is_code", "sha", "path", "head", "lines", "bytes")
    # texts cost far more than their bytes tell: they are spread over all tasks, and equal rows are judged once
    rows = rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("file_id", "path", "sha"))
    judged = rows.select("file_id", "is_code", "sha", judge("path", "head", "lines", "bytes").alias("j")).select("file_id", "is_code", "sha", "j.origin", "j.keys")
    judged = judged.withColumn("key", F.explode(F.concat(F.expr("transform(keys, k -> concat('name ', k))"), F.array(F.concat(F.lit("sha "), F.coalesce("sha", F.lit("")))))))
    names = library_refs.where("lib IS NOT NULL").select(F.concat(F.lit("name "), F.lower(F.trim("lib"))).alias("key")).where("key <> 'name '")
    sums = library_refs.where("sha IS NOT NULL").select(F.concat(F.lit("sha "), "sha").alias("key"))
    known = names.unionByName(sums).distinct().withColumn("known", F.lit("third_party"))
    verdict = judged.select("file_id", "is_code", "origin", "key").join(known, "key", "left").groupBy("file_id").agg(
        F.max(F.coalesce("is_code", F.lit(False))).alias("code"), F.max(F.coalesce("known", "origin")).alias("origin")
    )
    return verdict.where(F.col("code") & F.col("origin").isNotNull()).select("file_id", "origin")
