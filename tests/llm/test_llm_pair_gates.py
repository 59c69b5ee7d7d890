"""Copies, refusals and placeholders are told whatever their length."""

import pytest

from mosaiq.llm import broken_pairs as bp

Q = "How does the loader decide when a cached page is stale?"


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        (Q, "You wrote: " + Q, "copied"), (Q, Q.replace("cached", "stored"), "copied"), (Q, " ".join([Q] * 6), "copied"), ("Open windows?", "Open windows?", "copied"),
        (Q, "Sorry, I cannot answer this request. " * 60, "refusal"), (Q, "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim.", "empty"),
        ("Is the cache of the loader safe for threads?", "Yes, the cache of the loader is safe for threads.", None), (Q, "The loader compares the time of the file with that of the page.", None),
    ],
)
def test_no_gate_hides_a_defect(question, answer, defect):
    assert bp.defect(question, answer) == defect


@pytest.mark.parametrize(
    "answer, defect",
    [
        ('He wrote: "the loader keeps the page and starts.', "truncated"), ("<ul><li>First it starts.</li><li>Then it reads.", "truncated"), ("<ul><li>First it starts.</li></ul>", None),
        ("The loader **compares the time of the file.", "truncated"), ("The loader compares the times (see the table.", "truncated"), ("It reads:\n\n1. the file\n2. the page\n3.", "truncated"),
        ("It reads\n- the file\n- the page", None), ('The page "cached" is 5" wide.', None), ("```\nread()\n", "truncated"), ("```\nread()\n```", None), ("It calls `read", "truncated"),
        ("„Das ist alles“, sagt der Lader.", None), ("The size is 2 ** 8 bytes.", None), ("List<String> holds it.", None), ("| a | b |\n|---|---|\n| 1 | 2 |", None),
    ],
)
def test_the_parser_tells_what_is_open(answer, defect):
    assert bp.defect("Q?" if "„" not in answer else "Was sagt der Lader dazu?", answer) == defect


@pytest.mark.parametrize(
    "answer",
    [
        "К сожалению, я не могу ответить на этот вопрос.", "Tyvärr kan jag inte svara på frågan.", "Purtroppo non posso rispondere a questa domanda.", "Helaas kan ik deze vraag niet beantwoorden.",
        "Niestety nie mogę odpowiedzieć na to pytanie.", "Infelizmente, não posso responder.", "Désolé, je ne peux pas répondre à cette question.", "Lo siento, no puedo ayudar con eso.",
        "Es tut mir leid, dazu kann ich nichts sagen.", "I'm sorry, but I can't help with that.", "The excerpt does not show `load`; I won't guess. Consider opening the file.",
    ],
)
def test_refusals_in_many_languages(answer):
    assert bp.defect(Q, answer) == "refusal"


@pytest.mark.parametrize(
    "answer", ["We do not have to lock here, as the table is never written again.", "I cannot find a lock in `load`, so two threads may both read the file.", 'It answers "I cannot help with that" when the page is gone.']
)
def test_substance_and_quoted_refusals_are_none(answer):
    assert bp.defect(Q, answer) is None


def test_languages_without_a_profile_are_told_too():
    swedish = "Laddaren jämför filens tid med sidan och läser om den när den inte längre är ny, så att alla läsare ser samma sak."
    welsh = "Mae'r llwythwr yn cymharu amser y ffeil gyda'r dudalen ac yn ei darllen eto os nad yw hi yn newydd mwyach, fel y bydd pawb yn gweld yr un peth."
    assert bp.defect(Q, swedish) == "other_language" and bp.defect(Q, welsh) == "other_language" and bp.defect(Q, "ตัวโหลดเปรียบเทียบเวลาของไฟล์กับหน้า") == "other_language"


def test_tiles_are_the_longest_runs_first():
    assert bp.tiles("a b c d".split(), "x a b c y d a b".split()) == [0, 3, 3, 3, 0, 1, 2, 2] and bp.tiles([], ["a"]) == [0]
