from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, n_words string, score string, rid string, tree string, position string, target string, kept string, slot string, part string"
BENCH = [(1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, "short item of five words"), (3, None), (4, "..."), (5, "the quick brown fox jumps over the lazy dog near the river bank today")]


def base_text(k: int, n: int = 60) -> str:
    return " ".join(f"w{(k * 31 + i * i * 7) % 997}x{(k + i) % 13}" for i in range(n))


def rows() -> list[tuple]:
    """Nulls everywhere, empty and very long texts, copies, near copies, repeated rows, ties."""
    out = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", "a"),
        (4, "one", "en", None),
        (5, "One", "en", None),
        (6, "...!?", "fr", "b"),
        (7, base_text(1), "en", "a"),
        (8, base_text(1), "en", "b"),
        (9, base_text(1).upper(), "en", "b"),
        (10, base_text(1).replace("w31x1 ", "other "), "en", "a"),
        (11, "Before it: The quick brown fox, jumps over the lazy dog near the river. After", "en", "c"),
        (12, "a short item of five words b", None, "c"),
        (13, base_text(2, 12_000), "de", "a"),
        (14, base_text(3), "de", "é"),
        (14, base_text(3), "de", "é"),
        (15, "naïve café ☕ 日本語 “quotes” it's l'été <|endoftext|> x", "fr", "\U0001f600"),
        (None, base_text(4), "es", "a"),
        (None, None, None, None),
    ]
    for i in range(20, 50):  # a star of near copies around one original
        words = base_text(9, 100).split()
        words[(i * 3) % 100] = f"changed{i}"
        out.append((i, " ".join(words), "en", "a"))
    return out


@pytest.fixture(scope="session")
def documents(spark):
    extra = ("x",) * 11
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), *extra) for d, t, lang, s in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
