"""Texts of high entropy that repeat a third of themselves are found."""

import random

from mosaiq.llm import repetition as rp


def scattered(alphabet, size, phrases, length=30):
    """Random letters; after the first half, phrases of that half stand between them."""
    fresh = random.choices(alphabet, k=size - phrases * length)
    half = len(fresh) // 2
    out, step = fresh[:half], -(-half // phrases)
    for k in range(phrases):
        start = random.randrange(0, half - length)
        out += fresh[half + k * step : half + (k + 1) * step] + fresh[start : start + length]
    return "".join(out)


def test_random_letters_with_scattered_copies_are_found(spark):
    random.seed(11)
    latin, cjk = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x4E00, 0x9FFF)]
    far = "".join(random.choices(cjk, k=800_000))
    rows = [(1, scattered(latin, 10_000, 115)), (2, scattered(cjk, 4_000, 48)), (3, "".join(random.choices(latin, k=10_000))), (4, far + far), (5, far)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in rp.repetition(df).collect()}
    assert all(got[k].repeated_share >= 0.3 and got[k].band == "repetitive" for k in (1, 2, 4)) and got[3].band == "normal" and got[5].band == "incompressible"
    assert sorted(r.doc_id for r in rp.repetitive(df).collect()) == [1, 2, 4]


def test_the_bands_alone_tell_repetition_at_every_length():
    random.seed(12)
    bands, latin = rp.Bands(), "abcdefghijklmnopqrstuvwxyz"
    for size in (100, 150, 300, 700, 2_000, 9_000, 70_000):
        fresh = "".join(random.choices(latin, k=size))
        assert bands.measure(fresh)[4] in ("normal", "incompressible")
        assert bands.measure(fresh + fresh[: size // 2])[4] == "repetitive"
        text = scattered(latin, size, max(1, round(0.33 * size / 24)), 24) if size >= 150 else fresh + fresh[:50]
        assert bands.measure(text)[4] == "repetitive"


def test_short_sentences_are_not_called_repetitive():
    bands = rp.Bands()
    for text in ("hello world", "The loader reads the page.", "x", "One plain sentence about the cache and its limits, of which nothing is said again here."):
        n, _, novelty, _, band, share = bands.measure(text)
        assert band == ("short" if n < 64 else "normal") and share == 0
    assert bands.measure("ha ha ha ha ha ha")[4:] == ("short", bands.measure("ha ha ha ha ha ha")[5]) and bands.measure("ha ha ha ha ha ha")[5] > 0.5
