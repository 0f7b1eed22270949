"""Small tables with every edge case, and plain brute-force forms of the operators."""

import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h long, key string, rk int"
LONG = " ".join(f"word{i % 977} Ligne {i % 13}\n" for i in range(30_000))

#: null texts, ids, languages and sources; empty and long texts; ties and repeated rows
ROWS = [
    (1, "Hello World\nfoo", "en", "a"), (2, "hello world\nFOO", "en", "a"), (3, None, "en", "a"), (4, "", None, "b"),
    (5, LONG, "fr", "b"), (6, LONG.upper(), "fr", None), (7, "ÉCOLE école", "fr", None), (8, "éCOLE école", "fr", "b"),
    (9, "x", "de", "b"), (9, "x", "de", "b"), (9, "y", "de", "b"), (None, "no id", "en", "a"), (None, "NO ID", None, None),
    (None, None, None, None), (10, " \t\n \x0b\n", "en", "a"), (11, "12345 !!", "en", "a"), (12, "\x00a b\x1cc", "de", "c"),
    (13, "a  b \n\n c <|endoftext|> 漢字 🙂🙂 'll we're", "de", "c"),
]


def frame(spark, rows=ROWS):
    full = [(i, t, lang, s, None if t is None else len(t), "clash", 7, "clash", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def lower(text):
    return text.translate(str.maketrans(UPPER, LOWER))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def components(items, linked):
    """Label of every item: the smallest index it reaches."""
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(i):
                if linked(items[i], items[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label
