import pytest

AWKWARD = [
    (5, "The quick brown fox jumps over the lazy dog", "en", "b", 43),
    (5, "The quick brown fox jumps over the lazy dog", "en", "b", 43),
    (None, "A text without an id, which still counts", "en", None, None),
    (None, None, None, None, None),
    (7, "", "de", "a", 0), (8, None, None, "a", None), (9, " \t\n ", "fr", "c", 4),
    (1, "word " * 40, "en", "a", 200), (2, "word " * 40, "en", "a", 200), (3, "x" * 70_000, "en", "a", 70_000),
    (4, " ".join(f"w{i}" for i in range(60_000)), "en", "a", 1), (6, "Straße ÉTÉ naïve 漢字 \x1c \x85 end", "de", "b", 30),
]


@pytest.fixture
def awkward(spark):
    """Nulls, empties, repeated rows, long texts and columns named like the operators' own."""
    rows = [(*r, 1, "s", "k", 0, "t") for r in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "bucket int, spans string, size string, shard int, print string")


@pytest.fixture
def nothing(awkward):
    return awkward.limit(0)
