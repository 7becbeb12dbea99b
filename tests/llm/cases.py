"""Rows and helpers for the tests of the text operators."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside or return; documents may have such columns of their own.
CLASHING = [
    "_row", "_id", "_text", "_spans", "_letters", "_kept", "_cell", "fp", "row", "id", "score",
    "spans", "ids", "lang_pred", "component_id", "n_words", "_own", "y", "line", "gram",
]


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(
        "".join(pick.choice(["an", "er", "th", "on", "ti", "ea"]) for _ in range(pick.randint(1, 3)))
        for _ in range(words)
    )


LONG = prose(1, 60_000) + "\n" + "x" * 300_000 + " " * 5_000 + prose(2, 30_000)

ODD_ROWS = [
    (None, "Row without an id, and some more words.", "en", "a", 1),
    (None, None, None, None, None),
    (1, None, "en", None, 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (4, "12345 --- 67", "en", "b", 11),
    (5, "Ünïcödé テキスト 𝔘𝔫𝔦 text", "de", "b", 20),
    (6, prose(3, 80), "en", "a", 1),
    (7, prose(3, 80), "en", "a", 1),
    (7, prose(3, 80), "en", "a", 1),
    (8, LONG, "en", "c", 1),
    (9, "one", "fr", "c", 3),
    (10, 'api_key = "Zx81kqLm99PwTt40" and more', "en", "c", 10),
]


def rows(df):
    """Rows as a sorted list, whatever their order and nulls."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
