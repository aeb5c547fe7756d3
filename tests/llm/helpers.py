"""Plain versions of what the operators compute, and rows with every oddity."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "Word", "en", "a", 4),
    (None, "no id on this one, only words of an ordinary kind", "en", "a", 10),
    (5, "the same text twice over and over", "en", "a", 3),
    (5, "the same text twice over and over", "en", "a", 3),
    (6, "123 456 !!! ###", None, None, 1),
    (7, "a long one " * 3000, "de", "b", 1),
    (8, "é ß İ 日本語 👍🏽 \x00 \x1c x", "de", "b", 1),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return WORD.findall(lower(text))


def shingles(text):
    w = tokens(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
