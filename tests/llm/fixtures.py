"""Documents with every awkward case, and extra columns whose names the operators use inside."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, uid string, row int, h double, size long, text_sha256 string, kept boolean, fp long, target string, c0 int, _text string"
EXTRA = (7, "u", 3, 0.5, 9, "sha", True, 4, "t", 1, "x")

ENGLISH = "the quick brown fox jumps over the lazy dog while the children of the town watch it from the bridge and laugh aloud"
SPANISH = "el perro corre por la calle mientras los niños de la ciudad miran desde el puente y se ríen de la tarde lluviosa"


def row(doc_id, text, lang="en", source="a") -> tuple:
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def awkward() -> list[tuple]:
    long = " ".join(f"word{i % 977} {ENGLISH.split()[i % 21]}" for i in range(30_000))
    return [
        row(1, ENGLISH), row(2, ENGLISH), row(2, ENGLISH), row(3, SPANISH, "es", "b"), row(4, None), row(5, ""), row(6, " \t\n "), row(None, ENGLISH), row(None, None, None, None),
        row(7, long), row(8, long + " end"), row(9, ENGLISH.upper()), row(10, "12345 67890"), row(11, "ñandú", "es", None), row(-3, SPANISH, "es", "b"), row(12, ENGLISH + " again", None, "c"),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
