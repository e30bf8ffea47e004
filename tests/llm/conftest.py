import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, suspect string, size long, task int"


@pytest.fixture(scope="session")
def awkward():
    """Texts with nulls, empties, repeats, specials and one long text, as (doc_id, text)."""
    texts = [
        None, "", "", " ", "  \n\n x", "one", "one  two", "one two", "one\ttwo", "<|endoftext|> a <|startoftext|>B",
        "mail me: a.b+c@x-y.example.org, or z@z.co.uk@q.com and @no @a.b c@d", "ip 10.0.0.1 and 256.1.1.1, 1.2.3.4.5, 00010.2.3.4",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +49 (30) 123-4567 89 or +1 2", "IBAN DE89 3704 0044 0532 0130 00.",
        "ssn 123-45-6789", "123-45-6789", "it's  we'll\n\n  x 'S  'Really 123 a'b  !!'s x 　y", "ΑΣ Σ ΣΑ İstanbul ǅ ﬁ Ⅷ ½",
        "I'm'd're've '  's", "word " * 3000, "a" * 5000, "\U0001F600 café café", "1 234 56", "+" * 50 + "9" * 200,
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(7, "one two"), (None, "one two"), (100, "The quick brown fox"), (101, "the QUICK brown fox")]


@pytest.fixture()
def awkward_df(spark, awkward):
    from tessera.llm.common import ensure_importable

    ensure_importable(spark)
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, 3) for i, t in awkward], SCHEMA)


@pytest.fixture()
def empty_df(spark):
    return spark.createDataFrame([], SCHEMA)
