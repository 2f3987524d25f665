"""The language that a page declares."""

from spacerlake.llm import language_id


def test_declared_anywhere(spark):
    tag = '<html class="x" lang="fr">'
    pages = [tag, "\n" * 5000 + tag, f'<!-- {"licence " * 1000} <html lang="de"> -->{tag}', " " * 4085 + tag, f'<script>"<html lang=de>"</script>{tag}', "<p>no</p>", None]
    rows = spark.createDataFrame([(k, "http://a.b.com/", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    assert [r["declared"] for r in language_id.page_rows(rows).orderBy("page_id").collect()] == ["fr"] * 5 + ["", ""]
