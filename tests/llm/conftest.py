import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with the cases that every operator must bear, as (doc_id, text, doc's source)."""
    import random

    rng = random.Random(7)
    words = [rng.choice("bcdfgkmnprst") + rng.choice("aeiouéü") + rng.choice(["ka", "lo", "mi", "nu", "的", "x.", ","]) for _ in range(4000)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(120), make(300)
    rows = [(0, make(90)), (1, passage + " " + make(40)), (2, make(200) + " " + passage + "\n" + make(10)), (3, None), (4, ""), (5, "  \n\t "), (6, "one two"), (7, "One TWO"), (8, base), (9, base), (10, base)]
    rows += [(20 + i, " ".join(x if rng.random() > 0.01 else "changed" for x in base.split(" "))) for i in range(30)]
    rows += [(60 + i, make(30 + i) + " " + passage[:500] + " " + make(3)) for i in range(10)]
    rows += [(80, "a" * 3000), (81, "ab" * 900), (82, "word " * 2000), (83, make(6000)), (84, passage + " " + passage), (85, "éé" * 500 + base), (None, base), (None, make(60)), (90, make(13)), (91, "x " + rows[0][1]), (91, "x " + rows[0][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    schema = "doc_id long, text string, chunk string, bucket int, payload binary"
    return spark.createDataFrame([(i, t, "clash", 1, b"x") for i, t in documents], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
