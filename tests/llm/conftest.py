import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_data import TURNS, VECTORS, prose  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, label int, sig string"


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Rows with nulls, empty and very long texts, ties, repeated rows and near copies."""
    texts = {i: prose(i, 60 + i % 7 * 20) for i in range(1, 60)}
    texts[60] = texts[1]
    texts[61] = texts[1].replace(texts[1].split()[3], "changed", 1)
    texts[62] = None
    texts[63] = ""
    texts[64] = " \t\n\x0b "
    texts[65] = prose(65, 6000)
    texts[66] = "one two three"
    texts[67] = "one two three"
    texts[68] = ("JUNK!! " * 80).strip()
    texts[69] = " ".join(w.upper() + "###" for w in prose(69, 90).split())
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in texts.items()]
    rows += [rows[4], rows[4], (None, prose(70, 80), None, None, None), (None, None, "en", "s1", 0)]
    return [(*r, 0.5, "big", 1, "x") for r in rows]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf_dir(spark, corpus, tmp_path_factory):
    """Tables as the registered queries read them."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus, DOCUMENTS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0 if i in (68, 69) else 1, 0, "t") for i in range(1, 70)] + [(None, 1, 0, "t"), (3, None, 0, "t")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
    bench = [(1, prose(900, 40)), (2, None), (3, ""), (4, prose(2, 80)[:200])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    big = "<html>" + "x" * 2000 + "</html>"
    pages = [(i, f"http://h{i % 5}.example.com:80/p?{i}", big if i % 3 == 0 else f"<p>{i}é</p>") for i in range(40)]
    pages += [(None, None, None), (41, "no url", ""), (42, "https://u@A.B.Example.com./x\ny", big), (42, None, big)]
    spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int, score string").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, copies int").repartition(3).write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    return con
