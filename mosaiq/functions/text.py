"""Text functions as SQL expressions.

Every function takes SQL expressions as text and returns one, in the dialect of Spark or, for the plain-SQL twins of the named queries,
of DuckDB. All of them run inside the engine; none needs Python.
"""

from __future__ import annotations

#: Words that say nothing about code.
STOP_WORDS = """a an the and or of to in on for with by from at as is are was were be been being it its this that these those
there here what which who whom whose where when why how do does did done can could should would will shall may might must
i me my we our you your he she they them their not no yes if then else than so such into onto about over under out up down
any all some each every more most other just also very get gets got use used using file files code repo repository function
functions method class please tell show find explain make want need like let lets s t""".split()
#: Suffixes that a stem loses, in the order in which they are tried; a stem keeps more than three letters.
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "ers", "er", "ed", "es", "s")
#: A word begins with an ASCII letter, _ or $; numbers are words too.
WORD = r"[A-Za-z_$][\p{L}\p{N}_$.]*|\p{Nd}+"
#: What can be the name of a symbol.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"

SPARK, DUCK = "spark", "duckdb"


def literal(value: str, dialect: str = SPARK) -> str:
    """A string literal without escapes."""
    quoted = value.replace("'", "''") if dialect == DUCK else value
    return f"'{quoted}'" if dialect == DUCK else (f"r'{value}'" if "'" not in value else f'r"{value}"')


def each(items: str, name: str, body: str, dialect: str) -> str:
    return f"list_transform({items}, lambda {name}: {body})" if dialect == DUCK else f"transform({items}, {name} -> {body})"


def keep(items: str, name: str, test: str, dialect: str) -> str:
    return f"list_filter({items}, lambda {name}: {test})" if dialect == DUCK else f"filter({items}, {name} -> {test})"


def matches(text: str, pattern: str, dialect: str, group: int = 0) -> str:
    """All matches of a pattern as an array."""
    return f"regexp_extract_all({text}, {literal(pattern, dialect)}, {group})"


def replace_all(text: str, pattern: str, by: str, dialect: str) -> str:
    """All matches replaced; groups are written $1, $2."""
    if dialect == DUCK:
        for k in "123":
            by = by.replace(f"${k}", f"\\{k}")
        return f"regexp_replace({text}, {literal(pattern, dialect)}, {literal(by, dialect)}, 'g')"
    return f"regexp_replace({text}, {literal(pattern)}, {literal(by)})"


def split(text: str, pattern: str, dialect: str) -> str:
    return f"regexp_split_to_array({text}, {literal(pattern, dialect)})" if dialect == DUCK else f"split({text}, {literal(pattern)})"


def lower(text: str, dialect: str) -> str:
    """Lower case as Unicode has it; DuckDB alone would drop the dot of a capital dotted I."""
    return f"lower(replace({text}, 'İ', 'i̇'))" if dialect == DUCK else f"lower({text})"


def split_identifier(token: str, dialect: str = SPARK) -> str:
    """The parts of an identifier: camelCase, ACRONYMWord, then at blanks and ``_ - . / : $``."""
    apart = replace_all(replace_all(token, "([a-z0-9])([A-Z])", "$1 $2", dialect), "([A-Z]+)([A-Z][a-z])", "$1 $2", dialect)
    parts = split(apart, r"[\s_\-./:$]+", dialect)
    return keep(parts, "part", "part <> ''", dialect) if dialect == DUCK else f"array_remove({parts}, '')"


def stem(word: str) -> str:
    """``word`` without the first suffix of ``SUFFIXES`` it ends with, where more than three letters remain; -ies becomes -y."""
    cases = " ".join(
        f"WHEN length({word}) > {len(s) + 3} AND {word} LIKE '%{s}' THEN "
        + (f"concat(substr({word}, 1, length({word}) - {len(s)}), 'y')" if s == "ies" else f"substr({word}, 1, length({word}) - {len(s)})")
        for s in SUFFIXES
    )
    return f"CASE {cases} ELSE {word} END"


def tokens(text: str, dialect: str = SPARK) -> str:
    """The index terms of a text: whole compound identifiers in lower case, then their stemmed parts without stop words."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    parts = each(split_identifier("raw", dialect), "p", lower("p", dialect), dialect)
    stems = each(keep(parts, "w", f"length(w) > 1 AND w NOT IN ({stop})", dialect), "v", stem("v"), dialect)
    whole = f"trim({lower('raw', DUCK)}, '.')" if dialect == DUCK else "trim(BOTH '.' FROM lower(raw))"
    size = "len" if dialect == DUCK else "size"
    empty = "CAST([] AS VARCHAR[])" if dialect == DUCK else "array()"
    one = f"[{whole}]" if dialect == DUCK else f"array({whole})"
    join = "list_concat" if dialect == DUCK else "concat"
    body = f"{join}(CASE WHEN {size}({split_identifier('raw', dialect)}) > 1 THEN {one} ELSE {empty} END, {stems})"
    return f"flatten({each(matches(f'coalesce({text}, {chr(39)}{chr(39)})', WORD, dialect), 'raw', body, dialect)})"


def estimated_tokens(text: str, dialect: str = SPARK) -> str:
    """What a text costs of a budget."""
    return f"(length({text}) // 4 + 1)" if dialect == DUCK else f"(length({text}) div 4 + 1)"


def model_tokens(text: str, dialect: str = SPARK) -> str:
    """What a text costs of a model's input: at least 1."""
    return f"greatest(1, length({text}) // 4)" if dialect == DUCK else f"greatest(1, length({text}) div 4)"


def line_count(text: str) -> str:
    """Lines of a text; an unfinished last line counts."""
    return f"(length({text}) - length(replace({text}, chr(10), '')) + CASE WHEN {text} LIKE concat('%', chr(10)) THEN 0 ELSE 1 END)"


def sha16(text: str, dialect: str = SPARK) -> str:
    """The first 16 hexadecimal digits of SHA-1."""
    return f"substr(sha1({text}), 1, 16)"


def name_parts(name: str, dialect: str = SPARK) -> str:
    """The parts of a qualified name, at ``.`` and ``::``."""
    return keep(split(name, r"\.|::", dialect), "part", "part <> ''", dialect)


def last_part(name: str, dialect: str = SPARK) -> str:
    """The last part of a qualified name at ``.`` or ``::``; a name without parts gives the name."""
    if dialect == DUCK:
        return f"coalesce({name_parts(name, dialect)}[-1], {name})"
    return f"coalesce(try_element_at({name_parts(name)}, -1), {name})"


def tail(name: str, dialect: str = SPARK) -> str:
    """What follows the last ``.`` of a name."""
    return replace_all(name, r"^.*\.", "", dialect)


def basename(path: str, dialect: str = SPARK) -> str:
    return replace_all(path, "^.*/", "", dialect)


def dirname(path: str, dialect: str = SPARK) -> str:
    """The folder of a path, empty at the root."""
    return f"CASE WHEN {path} LIKE '%/%' THEN {replace_all(path, '/[^/]*$', '', dialect)} ELSE '' END"


def without_extension(path: str, dialect: str = SPARK) -> str:
    return replace_all(path, r"([^/])\.[^./]*$", "$1", dialect)


def extension(path: str, dialect: str = SPARK) -> str:
    """The extension with its dot, empty where there is none (a leading dot begins a name)."""
    inner = f"regexp_extract({path}, {literal(r'[^/](\.[^./]+)$', dialect)}, 1)"
    return f"coalesce({inner}, '')"


def normal_path(path: str, dialect: str = SPARK) -> str:
    """One spelling for a repository path: slashes, no ``./`` in front, no doubled slashes."""
    slashes = f"replace({path}, chr(92), '/')"
    return replace_all(replace_all(slashes, "/{2,}", "/", dialect), r"^(\./)+", "", dialect)


def is_test(path: str, dialect: str = SPARK) -> str:
    """Whether a path is that of a test, by its folders and name."""
    like = "regexp_matches" if dialect == DUCK else "regexp_like"
    # Folders, prefix and endings of tests.
    pattern = r"/(test|tests|__tests__|spec)/|/test_[^/]*$|(_test\.py|_test\.go|\.test\.ts|\.test\.js|\.spec\.ts|\.spec\.js|\.test\.tsx|_spec\.rb)$"
    return f"{like}(concat('/', lower({path})), {literal(pattern, dialect)})"


def span(start: str, end: str) -> str:
    """``Lstart-end``."""
    return f"concat('L', CAST({start} AS STRING), '-', CAST({end} AS STRING))"


#: A reference to lines, ``path:Lstart-end``.
SPAN = r"^(.+):L(\d+)-(\d+)$"


def overlap(a: str, b: str, dialect: str = SPARK) -> str:
    """The share of the distinct terms of ``a`` that ``b`` has, of at least one."""
    if dialect == DUCK:
        return f"(len(list_intersect(list_distinct({a}), {b})) / greatest(1, len(list_distinct({a}))))"
    return f"(size(array_intersect({a}, {b})) / greatest(1, size(array_distinct({a}))))"


def numbered(text: str, start: str = "1") -> str:
    """The lines of a text, each with its number and ``|`` in front."""
    lines = f"split({text}, '\\n')"
    full = f"CASE WHEN {text} LIKE concat('%', chr(10)) THEN slice({lines}, 1, size({lines}) - 1) ELSE {lines} END"
    return f"concat_ws(chr(10), transform({full}, (x, i) -> concat(CAST(i + {start} AS STRING), '|', x)))"
