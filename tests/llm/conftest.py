import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, copies int, n_words int"
WORDS = ["The", "river", "was", "calm,", "and", "stones", "lay", "über", "dem", "Wasser", "été", "x1", "of", "a", "Haus."]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(400)}" for _ in range(n))


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, blanks, repeated rows, a long text, clashing columns."""
    base, passage = prose(1, 200), prose(2, 70)
    near = base.split()
    texts = [base, base, " ".join(near[:100] + ["changed"] + near[101:]), prose(3, 60) + "\n" + passage, passage + "\t" + prose(4, 60), None, "", " \n\t ", "one two three", "One TWO three"]
    texts += [prose(i, 5 + i) for i in range(10, 40)] + [prose(50, 30) + " " + passage + " " + prose(51, 10), prose(60, 40_000), "🙂 naïve <|endoftext|> ▁mark \x0b tab", "12345 !!", base.lower()]
    rows = [(i, t, None if i % 7 == 6 else ("en", "de")[i % 2], None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t), "own", i, None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "a row without an id, of some ten words or so, twice", None, None, None, None, None, None)]
    rows.append((None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(tmp_path_factory, docs, spark):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    vectors = [(i, [((i * 37 + j * 11) % 97) / 97 - 0.5 for j in range(8)]) for i in range(230)]
    vectors += [(300, None), (350, [None] + [1.0] * 7), (400, [float("nan")] + [0.5] * 7), (450, vectors[50][1]), (451, vectors[50][1]), (None, vectors[1][1]), (500, [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    urls = ["http://a.example.org/es/x", "https://example.org/en/12?q", "ftp://B.Example.COM/de/1#f", "http://x.com/fr/", "http://org", "org/x", None, "", "http://site.net:80/p", "http://site.net:80/p", "a://b.c://d/e"]
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)] + [(None, "http://z.net/", None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 1), (8, 0, 1), (8, 1, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)
