"""Rows with every odd case."""

import random

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l", "")]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score string, shard string, "
          "component_id string, n int, bands string, mark string, label int, place string, rank int")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, shared lines and passages."""
    rng = random.Random(7)
    long = sentence(rng, 20_000)
    base = sentence(rng, 120).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1:]) for i in (3, 60, 118)]
    passage = sentence(rng, 30)
    rows = [
        (1, "The Same Text of Six Words", "en", "a"), (1, "The Same Text of Six Words", "en", "a"), (1, "another text under an id that repeats", "en", "b"),
        (2, None, "en", "a"), (3, "", None, "a"), (4, " \t\r\n\x0b\x0c ", "en", None), (5, "a b", "en", "b"), (6, "A  B ", "en", "b"),
        (7, "a b c", "fr", "b"), (8, long, "en", "c"), (9, long.replace(" ", "\n", 50), "en", "c"), (10, long.upper(), "en", None),
        (None, " ".join(base), "en", "a"), (None, None, None, None), (11, " ".join(base), "en", "a"), (12, near[0], "en", "a"),
        (13, near[1], "en", "é"), (14, near[2], "de", "é"), (15, " ".join(base[:70]), "de", "z"),
        (16, f"first line of text\n  Shared LINE here\t\n\nshort\n{passage}", "fr", "z"),
        (17, f"other\nshared line here\nshared line here\nÉté à la plage\n{passage.upper()}!", "fr", "z"),
        (18, f"SHARED line here\nété à la plage\n\n{sentence(rng, 12)} {passage} {sentence(rng, 5)}", "fr", "z"),
        (19, "\n\n", "es", "a"), (20, "日本語の文章です これは 長い 行です\nété à la plage", None, "a"), (21, "😀 😀 😀", "es", "a"),
    ]
    rows += [(100 + i, sentence(rng, 40), rng.choice(["en", "de"]), "hot") for i in range(40)]
    rows += [(200 + i, "one copy that a third of all rows share with each other", "en", "hot") for i in range(40)]
    return rows, passage
