"""Documents with every awkward case, and columns whose names clash with those the operators use."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, fp string, at string, bins string, toxic string, target string"

PROSE = " ".join(f"w{k * 7919 % 1009}" for k in range(300))
OTHER = " ".join(f"v{k * 104729 % 2003}" for k in range(200))

ROWS = [
    (0, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),  # an exact copy
    (1, PROSE, "en", "a"),  # a repeated row
    (2, None, "en", "a"),
    (3, "", "en", "b"),
    (4, " \t\n ", None, "b"),
    (5, "one", "en", None),
    (6, "two words", "en", None),
    (7, OTHER + " " + " ".join(PROSE.split()[40:120]) + " tail of its own", "de", "c"),
    (8, "ÜBER naïve 日本語 🙂 " * 30, "de", "c"),
    (None, "no id at all but some words", "en", "c"),
    (9, " ".join(f"long{k}" for k in range(9000)), "en", "a"),
    (12, OTHER, "fr", "b"),
    (-3, "negative id", "fr", "b"),
]


def docs(spark, rows=ROWS):
    full = [(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "p", "q", "r", "s") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
