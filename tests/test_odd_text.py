"""Queries beside their SQL over documents with blank lines, runs of blanks and no text."""
import duckdb
import pytest
from check import compare

from termflow.plans import load_all

WORDS = " ".join(f"word{i}" for i in range(40))
TEXTS = ["", " ", "\n\n", " \n\n  \n", "\n" + WORDS, WORDS + "\n", "one line.\n\nanother line here.\n \nlast line.",
         "\n".join("" if i % 7 in (0, 2, 3) else f"line {i} of a text." for i in range(60)),
         "\n".join("" if i % 3 else WORDS + f" {i}." for i in range(40)),
         "\n".join(f"{WORDS}{' ' * 40}{'x' * i}" if i % 2 else "x" for i in range(60)),
         "\n".join(["　", "\xa0word\xa0", "a b c."] * 20)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Every text under the rest classes that scanned_files deals formats out by."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i * 6 + k, ("en", "fr", "de", "es")[i % 4], "web", t) for i, t in enumerate(TEXTS) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["markdown_blocks", "previous_contexts", "scanned_files"])
def test_odd_text_matches_sql(spark, odd, name):
    folder, con = odd
    message, good = compare(spark, con, load_all()[name], folder)
    assert good, message


def test_driver_lists_no_files(spark, tmp_path):
    """Files in folders of several levels, one of them empty, are listed by tasks; Spark's file index sees only stored tables."""
    from termflow.sources.files import documents, scan
    for i in range(400):
        at = tmp_path / f"in {i % 3}" / str(i % 7)
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{i}.{('txt', 'md', 'exe')[i % 3]}").write_text("" if i % 50 == 0 else f"text {i}")
    (tmp_path / "none").mkdir()
    (tmp_path / ".hidden.txt").write_text("x")
    found = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = found.getCount()
    good, bad = scan(spark, str(tmp_path))
    assert sorted(r.text for k in ("txt", "md") for r in documents(good, k).collect()) == sorted(
        "" if i % 50 == 0 else f"text {i}" for i in range(400) if i % 3 < 2)
    assert {(r.path.rpartition("/")[2], r.verdict) for r in bad.collect()} == {(f"{i}.exe", "unsupported") for i in range(2, 400, 3)}
    assert found.getCount() - before < 100
