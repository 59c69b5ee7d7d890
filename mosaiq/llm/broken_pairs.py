"""Broken prompt and response pairs: empty, copied, refused, truncated, or in another language.

A pushdown parser reads fences, brackets, code spans, quotations, emphasis, markup, lists and sentences of an answer and tells whether it ends with one of
them open; greedy string tiling finds answers that only give the question back; grammars over classes of words find refusals and placeholders;
scripts and profiles of function words compare languages. Nothing depends on how long a text is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.runtime import latest

WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")

#: Words that only frame a repeated question.
FRAME = frozenset(
    "a an and answer ask asked asking do good great here i is it know me my ok okay please q question re repeat response so sure that the this to want was you your "
    "frage antwort die der das question réponse la le est pregunta respuesta es esta".split()
)
#: Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the is of and to it that which when how what does by for on with not are be this only as from at if before after its their but has have they an in where who until because yes".split(),
    "de": "der die das und ist nicht von zu wird den ein eine einen einer mit auf für dem bei wenn sich nur im als bis aus oder sind wurde auch nach wie wo man werden sie durch dass".split(),
    "fr": "le les des et est un une du dans que qui pour par sur ne pas quand il elle au se ce cette sont plus avec puis si ou où cela jusqu aux vous chaque".split(),
    "es": "el los las y es un una en por se no con para cuando al lo su del que sus como este esta si cada más hasta pero sin son luego antes".split(),
    "it": "il lo gli di che è un una per non con del della dei delle finché si trova questo ogni perché già poi quando sono nel più serve".split(),
    "pt": "o os um uma não é de do da dos das em por para com que se ao até quando cada falta porque já depois fica junto dessa está pelo na no".split(),
    "pl": "nie jest się do na w z że a i aby gdy przez ponieważ już każdy obok potem najpierw czy go przed dla jak oraz tego ten wartość".split(),
    "sv": "och att det som på är av för med till har inte om ett från när kan eller efter ska också utan där varje denna detta".split(),
    "da": "og det som på er af for med til har ikke om fra når kan eller efter skal også uden hvor hver denne dette ved bliver".split(),
    "fi": "ja on ei se että kun jos tai myös vain niin sitä ovat ennen sen joka kuin mutta kaikki jälkeen".split(),
    "cs": "je se na že to pro při jako by aby ale nebo už až když jen po také který pokud před".split(),
    "ro": "și este nu la pentru care din cu să dacă sau după când fiecare până este mai prin acest această".split(),
    "tr": "ve bir bu için ile değil sonra kadar olarak eğer veya her daha önce gibi ancak olan".split(),
    "hu": "és az nem hogy egy ha vagy de csak után minden amikor mert még már ezt azt kell".split(),
    "nl": "de het een van en is niet te dat op voor met als aan er door wordt zijn bij naar ook om maar dan nog deze elke wanneer".split(),
}
FUNCTION_WORDS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
LANGUAGES_OF = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v) for w in frozenset().union(*FUNCTION_WORDS.values())}

OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
CLOSERS = frozenset(OPENERS.values())
SENTENCE_END = ".!?。！？…"
CLAUSE_MARKS = ",;:-–—"
#: Elements of markup that must be closed.
PAIRED = frozenset("ul ol dl table thead tbody pre code div span strong em blockquote details summary section article h1 h2 h3 h4 h5 h6 kbd sub sup answer".split())
POINTER = re.compile(r"(?:\W*)(?:see|see also|refs?|references?|sources?|siehe|vgl|voir|véase|ver|vedi|zie)\b", re.I)
LINE = re.compile(r"[ \t]{0,6}(?:(?P<fence>```+|~~~+)|(?P<item>(?:[-*+•]|\d{1,3}[.)])(?=\s|$))|(?P<head>#{1,6}\s)|(?P<row>\|))?")
MARK = re.compile(
    r"(?P<break>\n)|(?P<ticks>`+)|(?P<tag></?(?P<name>[a-z][a-z0-9]*)(?:\s[^<>\n]*)?/?>)|(?P<strong>\*\*)|(?P<open>[(\[{“«„])|(?P<close>[)\]}”»])|(?P<quote>\")"
    r"|(?P<end>[.!?。！？…]+)|(?P<clause>[,;:–—-])|(?P<word>[^\W_][\w ]*)"
)
NUMBERED = re.compile(r"(?:^|\n)\W*\d{1,3}$")
BARE_ITEM = re.compile(r"(?:[-*+•]|\d{1,3}[.)])$")
SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'*_)]*\s+|\n+")


class Pushdown:
    """What is still open where a text ends: a stack of fences, markup, brackets, quotations, emphasis, code spans, list items and sentences.

    A blank line ends inline constructs and sentences, as an unclosed one before it is only untidy; headings, table rows and list items end with their
    line. Of a list it is kept whether any item ended a sentence: if none did, the items needn't.
    """

    def __init__(self, text: str):
        self.stack: list[str] = []
        self.clause = False  # the last thing read was a mark inside a sentence
        self.trail = False  # ... or an ellipsis
        self.pointer = False  # the open line is a list of references
        self.words = 0
        self.lines = 1
        self.after_code = False
        self.items = self.ended = 0
        at = self._line(text, 0)
        while m := MARK.search(text, at):
            at = _READ[m.lastgroup](self, m, text)
        if "fence" in self.stack:
            self.stack = ["fence"]

    def _pop(self, mark: str) -> None:
        """Close ``mark`` and what was opened inside it."""
        while self.stack.pop() != mark:
            pass

    def _line(self, text: str, at: int) -> int:
        """The beginning of a line: fences, items, headings."""
        m = LINE.match(text, at)
        kind = m.lastgroup
        end = text.find("\n", at)
        if "fence" in self.stack:
            if kind == "fence" and m.group(kind)[0] == self.fence[0] and len(m.group(kind)) >= len(self.fence):
                self._pop("fence")
                self.after_code = True
                return m.end()
            return len(text) if end < 0 else end  # code isn't parsed
        self.pointer = bool(POINTER.match(text, at))
        if kind == "fence":
            self.stack.append("fence")
            self.fence = m.group(kind)
            return len(text) if end < 0 else end
        if kind in ("item", "head", "row"):
            self.stack.append(kind)
            self.items += kind == "item"
        return m.end()

    def _break(self, m: re.Match[str], text: str) -> int:
        self.lines += 1
        if "fence" not in self.stack:
            for kind in ("item", "head", "row"):
                if kind in self.stack:
                    self._pop(kind)
            if text.startswith("\n", m.end()):
                self.stack = [x for x in self.stack if x.startswith("<")]
                self.items = self.ended = 0
        return self._line(text, m.end())

    def _content(self) -> None:
        self.after_code = self.clause = self.trail = False

    def _ticks(self, m: re.Match[str], text: str) -> int:
        close = text.find(m.group(), m.end())
        stop = text.find("\n\n", m.end())
        self._content()
        if "sentence" not in self.stack:
            self.stack.append("sentence")
        if close < 0 or 0 <= stop < close:
            if stop < 0:
                self.stack.append("`")
                return len(text)
            return m.end()
        self.words += 1
        return close + len(m.group())

    def _tag(self, m: re.Match[str], text: str) -> int:
        name = m.group("name")
        if name in PAIRED and not m.group("tag").endswith("/>"):
            mark = f"<{name}>"
            if not m.group("tag").startswith("</"):
                self.stack.append(mark)
            elif mark in self.stack:
                self._pop(mark)
                self._content()
                self.after_code = name in ("pre", "ul", "ol", "dl", "table")
        return m.end()

    def _toggle(self, mark: str, m: re.Match[str], text: str) -> int:
        """A mark that opens before a word and closes after one."""
        if mark in self.stack:
            if not text[m.start() - 1].isspace():
                self._pop_inner(mark)
        elif text[m.end() : m.end() + 1].strip() and not text[m.start() - 1 : m.start()].isalnum():
            self.stack.append(mark)
        return m.end()

    def _pop_inner(self, mark: str) -> None:
        """Close an inline mark; a sentence that began inside it goes on after it."""
        inside = self.stack[self.stack.index(mark) :]
        self._pop(mark)
        if "sentence" in inside and "sentence" not in self.stack:
            self.stack.append("sentence")

    def _strong(self, m: re.Match[str], text: str) -> int:
        return self._toggle("**", m, text)

    def _quote(self, m: re.Match[str], text: str) -> int:
        return self._toggle('"', m, text)

    def _open(self, m: re.Match[str], text: str) -> int:
        self._content()
        if m.group() == "„" or m.group() != "“" or "“" not in self.stack:
            self.stack.append(OPENERS[m.group()])
        else:
            self._pop_inner("“")  # the closing mark of „
        return m.end()

    def _close(self, m: re.Match[str], text: str) -> int:
        if m.group() in self.stack:
            self._pop_inner(m.group())
        return m.end()

    def _end(self, m: re.Match[str], text: str) -> int:
        after = text[m.end() : m.end() + 1]
        before = text[m.start() - 1 : m.start()]
        numbered = (before == "\n" or before.isdecimal()) and m.group() == "." and NUMBERED.search(text[max(0, m.start() - 12) : m.start()])
        if (not after or not after.isalnum() and after not in "_/(") and not numbered:
            self.clause = False
            self.trail = m.group() in ("...", "…") and bool(self.words)
            if "sentence" in self.stack and not CLOSERS.intersection(self.stack[self.stack.index("sentence") :]):
                self._pop_sentence()
        return m.end()

    def _pop_sentence(self) -> None:
        self.stack.remove("sentence")
        self.ended += "item" in self.stack

    def _clause(self, m: re.Match[str], text: str) -> int:
        after = text[m.end() : m.end() + 1]
        if not after or not after.isalnum():
            self.clause = True
        return m.end()

    def _word(self, m: re.Match[str], text: str) -> int:
        self._content()
        self.words += len(m.group().split())
        if "sentence" not in self.stack:
            self.stack.append("sentence")
        return m.end()


#: What reads each mark.
_READ = {k: getattr(Pushdown, f"_{k}") for k in MARK.groupindex if k != "name"} | {"name": Pushdown._tag}


def truncated(answer: str) -> bool:
    """Whether ``answer`` ends before it is complete: with something open on the stack of the parser, or with a mark that promises more.

    An open sentence alone is no defect of a one-line phrase of up to five words, after a block of code, and in a list none of whose items ends a sentence.
    """
    state = Pushdown(answer.rstrip())
    open_ = set(state.stack) - {"sentence", "item", "head", "row"}
    if open_ or "fence" in state.stack:
        return True
    if state.after_code:
        return False
    if state.clause or state.trail:
        return True
    if "sentence" not in state.stack:
        return "item" in state.stack and bool(BARE_ITEM.search(answer.rstrip())) and state.lines > 1
    last = answer.rstrip()
    if "item" in state.stack or state.pointer:
        return not last.endswith("`") and not (state.items > 1 and not state.ended)
    if "row" in state.stack:
        return not last.endswith("|")
    return not (state.lines == 1 and state.words <= 5)


def tiles(question: list[str], answer: list[str]) -> list[int]:
    """Greedy string tiling: for each word of ``answer`` the length of the common run it lies in, the longest runs first, 0 outside of all.

    A stretch of the question may cover several stretches of the answer, so that repetitions are covered too.
    """
    where: dict[str, list[int]] = {}
    for j, w in enumerate(question):
        where.setdefault(w, []).append(j)
    size = [0] * len(answer)

    def run(i: int) -> int:
        most = 0
        for j in where.get(answer[i], ()):
            k = 0
            while i + k < len(answer) and j + k < len(question) and not size[i + k] and answer[i + k] == question[j + k]:
                k += 1
            most = max(most, k)
        return most

    while best := max((run(i) for i in range(len(answer)) if not size[i]), default=0):
        # all runs of one length in one pass, so that long answers take as many passes as there are lengths
        for i in range(len(answer)):
            if not size[i] and run(i) == best:
                size[i : i + best] = [best] * best
    return size


#: Words that answer by themselves, so an answer with one that the question lacks is no copy.
ANSWERING = frozenset("yes no not never none because ja nein nicht kein weil oui non pas jamais parce sí nunca porque".split())
#: What a word counts in a run of one, two and more words, the covered share from which an answer is a copy, and the share of the question that must be in it.
RUN_WEIGHTS, COPIED_SHARE, GIVEN_BACK = (0.0, 0.6, 0.8, 1.0), 0.75, 0.7


@lru_cache(maxsize=4096)
def _question_words(question: str) -> tuple[list[str], frozenset[str]]:
    """The words of a question, which often has several answers, and the distinct ones."""
    words = WORD.findall(question.lower())
    return words, frozenset(words)


def copied(question: str, answer: str) -> bool:
    """Whether tiles of ``question`` cover ``answer``: it only gives the question back, perhaps turned around, repeated, framed or with a word changed.

    Words in longer common runs count more; uncovered words that only frame a question don't count. An answer that adds a word which answers by itself is none.
    """
    q, own = _question_words(question)
    a = WORD.findall(answer.lower())
    if not q or not a:
        return False
    new = [w for w in a if w not in own]
    known = len(a) - len(new)
    # every known word lies in a tile, if only of itself: where these are too few, no tiling covers enough
    if known < COPIED_SHARE * (known + len([w for w in new if w not in FRAME])):
        return False
    size = tiles(q, a)
    if any(not n and w in ANSWERING for w, n in zip(a, size)):
        return False
    counted = [n for w, n in zip(a, size) if n or w not in FRAME]
    covered = sum(RUN_WEIGHTS[min(n, 3)] if len(q) > 2 else float(n == len(q)) for n in counted)
    back = len({w for w, n in zip(a, size) if n}) / len(own)
    return covered >= COPIED_SHARE * len(counted) and covered > 0 and back >= GIVEN_BACK


#: The classes of words that refusals are made of, in several languages. S: who speaks; N: not; C: being able or willing; A: to answer; K: to have or see;
#: O: what one would have to have; D: declining, lacking; G: regret; Q: the question; B: beyond. A word may end in * for any ending.
REFUSAL_CLASSES = {
    "S": "i i'm i'd i've i'll me my mine myself we we're us our ich mir mich mein wir uns je j m moi mon nous yo mí io mi ho eu mim jag mig ik mij wij я мне меня мы",
    "N": "not no n't never nothing none cannot can't won't couldn't wouldn't don't doesn't didn't isn't wasn't aren't haven't hadn't shouldn't mustn't nicht nichts kein keine keinen keinerlei nie ne n pas rien aucun aucune nada ningún ninguna non não nenhum nie не нет ничего inte ingen inget niet geen niets nie",
    "C": "can could able unable allowed permitted possible position comfortable willing going like will would may must should won't unable kann könnte darf möchte will imstande lage möglich peux puis pouvons possible voudrais puedo podría quiero posible posso consigo possível могу можем kan får möjligt kunnen mag mogę",
    "A": "answer answers answering answered help helping assist assistance discuss say tell speak provide give offer determine speculate speculating guess comment describe explain respond reply complete completed fulfill fulfilled process processed share delay verify confirm beantworten antworten antwort sagen äußern helfen erklären auskunft répondre réponse aider dire expliquer deviner responder respuesta ayudar decir contestar explicar opinar rispondere aiutare dire responder ajudar dizer ответить отвечать помочь сказать svara hjälpa säga antwoorden helpen zeggen odpowiedzieć pomóc",
    "K": "have has had having given see seen know show shows contain contains access lack lacks without habe liegt vor kenne sehe zugang ai avons accès connais tengo dispongo acceso tenho acesso имею доступа har tillgång heb toegang mam",
    "O": "information access source sources file files code context excerpt data knowledge details it that this enough front informationen quelltext datei zugriff zugang angaben informations accès source fichier información acceso fuente archivo informazioni accesso informações acesso информации доступа information tillgång informatie toegang informacji dostępu",
    "D": "decline declines refuse refusing pass abstain unable impossible lack lacking rather beyond outside instructed refrain schuldig fehlt fehlen verweigern enthalten abstenir m'abstenir refuse impossible préfère prefiero imposible abstenerme rifiuto impossibile recuso impossível отказаться невозможно avstå omöjligt weiger onmogelijk odmawiam",
    "G": "sorry apolog* regret* unfortunately afraid leider leid bedauer* malheureusement désolé désolée regrette lamento siento lamentablemente desgracia desgraciadamente purtroppo spiacente dispiace infelizmente desculpe сожалению извините tyvärr ledsen förlåt helaas spijt niestety przepraszam przykro",
    "Q": "request question query anfrage frage question demande pregunta solicitud domanda pergunta вопрос запрос frågan vraag pytanie",
    "B": "beyond outside scope remit policy guidelines rahmen",
}
#: The productions of a refusing sentence over these classes; a dot is any word, * up to six of them.
REFUSAL_PRODUCTIONS = (
    "S*N*C", "S*N*A", "S*N*K*O", "S*K*N", "S*N*D", "N*S*C*A", "N*S*A", "S*D", "D*S", "G*S*N", "G*S*D", "G*S*K", "G*N*C", "G*A*B", "G*N*A", "A*G", "N*A*C", "^NA", "^N.A", "Q*N*A", "A*B", "A*N*C", "B*S*B",
    "K*N*K*S*N", "S*C*K*A", "N*C*S*A", "K*S*N", "GS*$", "D*A", "G*N*K", "C*N*A",
)
_WORDS_OF = {}
for _class, _words in REFUSAL_CLASSES.items():
    for _w in _words.split():
        _WORDS_OF[_w] = _WORDS_OF.get(_w, "") + _class
_STEMS = tuple((w[:-1], c) for w, c in _WORDS_OF.items() if w.endswith("*"))
_PRODUCTION = re.compile("|".join("(?:" + "".join(f"(?:<[^>]*{c}[^>]*>)" if c.isalpha() else "(?:<[^>]*>){0,6}?" if c == "*" else "<[^>]*>" if c == "." else c for c in p) + ")" for p in REFUSAL_PRODUCTIONS))
CLAUSES = re.compile("[,;:—–]")
FENCED = re.compile(r"```.*?(?:```|$)", re.S)
LEAD = re.compile(r"^(?:note|regarding [^:]*|about [^:]*|answer|a)\s*:\s*")
#: Code, paths and quotations in a sentence. Paths are looked for only where there is a slash, as each word is read again from each of its letters.
QUOTED, QUOTED_PATH = re.compile("`[^`]*`|\"[^\"]*\"|“[^”]*”|«[^»]*»"), re.compile(r"`[^`]*`|\S*/[^\s,;]*|\"[^\"]*\"|“[^”]*”|«[^»]*»")
SPOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Openings of courtesies around a refusal.
COURTESY = re.compile(
    r"(?:please (?:share|ask|provide|send|open|consult|check|contact|try)|i hope|hope (?:this|that)|consider |is there anything|you (?:may|might|could) (?:want|try|wish)|let me (?:be|know)|feel free|hm+\b|hello|hi\b|hey|dear"
    r"|thanks?\b|thank you|(?:about|regarding)\b[^.;]*\W*$|note$|as an? .{0,20}(?:model|assistant)|sorry\W*$|of course|well\b|okay|ok\b|bitte|danke|merci|gracias|hallo|bonjour|hola|grazie|obrigad|пожалуйста|спасибо|здравствуйте|tack\b|hej\b|dank\b)"
)


@lru_cache(maxsize=65536)
def _class_of(word: str) -> str:
    """The classes of a word as one symbol of the grammar."""
    found = _WORDS_OF.get(word) or next((c for stem, c in _STEMS if word.startswith(stem)), "")
    if not found and "'" in word:  # d'accès, m'est, n'ai
        found = "".join(_WORDS_OF.get(x, "") for x in word.split("'"))
    return f"<{found}>"


def refuses(sentence: str) -> bool:
    """Whether a clause of a sentence (lower case, without code and quotations) is derived from a production of refusals."""
    for clause in CLAUSES.split(sentence):
        symbols = [_class_of(w) for w in SPOKEN.findall(clause)]
        # each production has two classes at least
        if len(symbols) - symbols.count("<>") > 1 and _PRODUCTION.search("".join(symbols)):
            return True
    return False


def _sentences(text: str) -> Iterator[str]:
    """The sentences of a text one by one, as most answers are told by the first."""
    at = 0
    for m in SENTENCE.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def refused(answer: str) -> bool:
    """Whether ``answer`` declines and says nothing of substance: every sentence refuses or is a courtesy, at least one refuses."""
    text = FENCED.sub(" §code§ ", answer) if "```" in answer else answer
    text = text.replace("’", "'").replace("**", "").lower()
    refusals = 0
    for sentence in _sentences(text):
        s = sentence.strip(" \t\"'*_-#>")
        s = LEAD.sub("", s) if ":" in s else s
        bare = (QUOTED_PATH if "/" in s else QUOTED).sub(" xx ", s)
        if not WORD.search(s):
            continue
        if refuses(bare):
            refusals += 1
        elif not COURTESY.match(bare.strip()):
            return False
    return refusals > 0


#: The classes of words that placeholders are made of. m: marks of what is missing; p: filler text; s: what should stand there; v: how it comes there; i, f: orders to
#: write it; n: not; o, t: about, to; b, w, c: be, will, coming; h: small words between. All other words are x.
PLACEHOLDER_CLASSES = {
    "m": "na nil null tbd tba tbc todo wip fixme pending blank empty unanswered", "p": "placeholder lorem", "s": "answer answers response reply a text description explanation detail details output",
    "v": "written added done filled provided completed supplied given answered", "i": "describe explain write add complete", "f": "fill insert", "n": "no not", "o": "for of about on", "t": "to", "b": "be",
    "w": "will", "c": "coming", "h": "in me here your goes now later soon out up is it",
}
#: The productions of placeholders over these classes.
PLACEHOLDER_PRODUCTIONS = re.compile(r"m[oh]*|p.*|m[isf].*|ns?v?|h*sh+|fh*s?h*|[wt]bvh*|ch|s+|s[ot].*tbv")
_PLACE_OF = {w: c for c, words in PLACEHOLDER_CLASSES.items() for w in words.split()}


def placeholder(words: list[str]) -> bool:
    """Whether the words of an answer (lower case) are derived from a production of placeholders."""
    text = " ".join(words).replace("n a", "na") if words[:2] == ["n", "a"] else " ".join(words)
    symbols = ["m" if re.fullmatch("x{3,}", w) else _PLACE_OF.get(w, "x") for w in re.sub(r"^to do\b", "todo", text).split()]
    return len(symbols) != 1 or symbols[0] != "n" if PLACEHOLDER_PRODUCTIONS.fullmatch("".join(symbols)) else False


def empty(answer: str | None) -> bool:
    """Whether there is no answer: null, blank, only marks, or a placeholder."""
    if answer is None:
        return True
    first = WORD.search(answer)
    if not first:
        return True
    word = first.group().lower()
    return (word in _PLACE_OF or word == "n" or word.startswith("xxx")) and placeholder(WORD.findall(answer.lower()))  # no production begins with another word


CODE_SPAN = re.compile(r"`[^`\n]*`?")
NAMES = re.compile(r"\b\w+\.\w+(?:\(\))?|\b[a-z]+[A-Z]\w*|\b(?:[A-Z][a-z]+){2,}\b")


def _pieces(text: str) -> list[str]:
    """What stands between blanks in ``text`` without fences and code spans."""
    if "`" in text:
        text = CODE_SPAN.sub(" ", FENCED.sub(" ", text))
    return text.split()


@lru_cache(maxsize=65536)
def _piece_prose(piece: str) -> str:
    return "" if "/" in piece or "_" in piece or "\\" in piece else NAMES.sub(" ", piece)


@lru_cache(maxsize=65536)
def _piece_words(piece: str) -> tuple[str, ...]:
    return tuple(LETTERS.findall(_piece_prose(piece).lower()))


def prose(text: str) -> str:
    """``text`` without code: fences, code spans, paths and identifiers. None of these has a blank, so each piece is looked at by itself, and often remembered."""
    return " ".join(filter(None, map(_piece_prose, _pieces(text))))


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """The script of a letter, as its name begins; both kinds of Kana are one."""
    name = unicodedata.name(c, "LATIN").split()[0]
    return "KANA" if name in ("HIRAGANA", "KATAKANA") else name


def _scripts(letters: str) -> dict[str, int]:
    if letters.isascii():
        return {"LATIN": len(letters)}
    out: dict[str, int] = {}
    for c, n in Counter(letters).items():
        out[_script(c)] = out.get(_script(c), 0) + n
    return out


def language(text: str) -> tuple[str, float, dict[str, float]]:
    """(language or script or "", its share, shares of all languages) of the prose of ``text``."""
    words = list(chain.from_iterable(map(_piece_words, _pieces(text))))
    letters = "".join(words)
    n = len(letters)
    if not n:
        return "", 0.0, {}
    scripts = _scripts(letters)
    script = max(scripts, key=scripts.get)
    if script != "LATIN" and scripts[script] > 0.4 * n:
        return ("KANA" if scripts.get("KANA", 0) > 0.1 * n else script), scripts[script] / n, {}
    counts = dict.fromkeys(FUNCTION_WORDS, 0)
    for of, times in Counter(map(LANGUAGES_OF.get, words)).items():
        for k in of or ():
            counts[k] += times
    shares = {k: n / len(words) for k, n in counts.items()}
    best = max(shares, key=shares.get)
    return (best if shares[best] * len(words) >= 2 and shares[best] >= 0.1 else ""), shares[best], shares


#: One question often has several answers.
_question_language = lru_cache(maxsize=4096)(language)


def other_language(question: str, answer: str) -> bool:
    """Whether the prose of ``answer`` is in another language than that of ``question``; texts too short to tell are not.

    Another script is told for any script, a known language by its function words, and any other by their absence: prose with many different short words, hardly one of
    which is a function word of the question's language.
    """
    own, _, own_shares = _question_language(question)
    its, share, shares = language(answer)
    if its and not shares:  # another script
        return its != own
    if not shares or its == own and own:
        return False
    if not own:
        if not own_shares or max(own_shares.values()) <= 0:
            return False
        own = max(own_shares, key=own_shares.get)
        if own == its:
            return False
    words = LETTERS.findall(prose(answer))
    if its:
        return share - shares.get(own, 0.0) >= 0.1 and len(words) >= 4
    short = [w for w in words if len(w) <= 4]
    return len(words) >= 12 and len(short) >= 0.25 * len(words) and len(set(short)) >= 4 and shares.get(own, 0.0) <= 0.02


def defect(question: str | None, answer: str | None) -> str | None:
    """The one defect of a pair, or None."""
    if empty(answer):
        return "empty"
    if question is not None and copied(question, answer):
        return "copied"
    if refused(answer):
        return "refusal"
    if question is not None and other_language(question, answer):
        return "other_language"
    if truncated(answer):
        return "truncated"
    return None


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (any columns, with ``question`` and ``answer`` strings) that are defective, with a column ``defect`` added.

    A null or blank answer is ``empty``; with a null question only ``empty``, ``refusal`` and ``truncated`` can be told. Each row is judged by itself, so
    repeated rows come out as often as they went in.
    """

    @F.pandas_udf("string")
    def judge(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, answers in frames:
            yield pd.Series([defect(q, a) for q, a in zip(questions, answers)], dtype=object)

    return pairs.withColumn("defect", judge("question", "answer")).where(F.col("defect").isNotNull())


def project_pairs(qa: DataFrame, bench_results: DataFrame) -> DataFrame:
    """(tbl, pair_id, question, answer): the row of each pair that was loaded last; pairs without an id are left out."""
    a = latest(qa.select("qa_id", F.col("q").alias("question"), F.col("a").alias("answer"), "loaded_at"), "qa_id", [F.col("loaded_at")], ["question", "answer"])
    b = latest(bench_results.select("result_id", "question", "answer", "loaded_at"), "result_id", [F.col("loaded_at")], ["question", "answer"])
    a = a.select(F.lit("qa").alias("tbl"), F.col("qa_id").alias("pair_id"), "question", "answer")
    return a.unionByName(b.select(F.lit("bench_results").alias("tbl"), F.col("result_id").alias("pair_id"), "question", "answer"))
