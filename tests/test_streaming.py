import datetime as dt

from contactloom import schemas
from contactloom.streaming import (
    first_listings_writer,
    first_page_visits,
    handled_sites_writer,
    read_first_listings,
)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_sites_are_handled_once(spark, tmp_path):
    source, out, seen, state = (str(tmp_path / n) for n in ("in", "out", "seen", "state"))

    def arrive(*rows):
        full = [(url, 200, "text/html", html, dt.datetime(2024, 1, 1)) for url, html in rows]
        spark.createDataFrame(full, schemas.PAGES).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schemas.PAGES).parquet(source)
        drain(handled_sites_writer(stream, out, seen, state))

    arrive(("https://a.org/1", "x@a.org"), ("https://a.org/2", "y@a.org"), ("https://b.org/", "none"))
    run()
    arrive(("https://a.org/3", "late@a.org"), ("https://c.org/", "z@c.org"))
    run()
    run()
    got = {r["url"]: r["emails"] for r in spark.read.parquet(out).collect()}
    assert got == {"https://a.org/1": ["x@a.org"], "https://a.org/2": ["y@a.org"], "https://c.org/": ["z@c.org"]}
    sites = [r["website"] for r in spark.read.parquet(seen).collect()]
    assert sorted(sites) == ["https://a.org", "https://b.org", "https://c.org"]


def test_batch_borders_do_not_matter(spark, tmp_path):
    source = str(tmp_path / "in")
    for n in range(4):
        row = [(f"https://a.org/{n}", 200, "text/html", f"x{n}@a.org", dt.datetime(2024, 1, 1))]
        spark.createDataFrame(row, schemas.PAGES).coalesce(1).write.mode("append").parquet(source)
    found = []
    for files in (1, 100):
        out, seen, state = (str(tmp_path / f"{n}{files}") for n in ("out", "seen", "state"))
        stream = spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files).parquet(source)
        drain(handled_sites_writer(stream, out, seen, state))
        found.append(sorted(r["url"] for r in spark.read.parquet(out).collect()))
    assert found[0] == found[1] == [f"https://a.org/{n}" for n in range(4)]


def test_first_visit_per_url(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "url string, fetched_at timestamp"

    def arrive(*rows):
        spark.createDataFrame([(u, dt.datetime(2024, 1, 1, h)) for u, h in rows], schema).write.mode(
            "append"
        ).parquet(source)
        stream = first_page_visits(spark.readStream.schema(schema).parquet(source), "1 hour")
        drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))

    arrive(("u", 1), ("u", 1), ("v", 1))
    arrive(("u", 1), ("w", 2))
    assert sorted(r["url"] for r in spark.read.schema(schema).parquet(out).collect()) == ["u", "v", "w"]


def test_first_listing_per_site(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "query string, seq bigint, website string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        drain(first_listings_writer(spark.readStream.schema(schema).parquet(source), out, state))

    arrive(("q", 3, "http://A.org"), ("q", 5, "http://a.org"), ("q", 1, None), ("r", 9, "http://a.org"))
    arrive(("q", 2, "HTTP://a.org"), ("q", 8, "http://b.org"), ("r", 10, "http://a.org"))
    got = {(r["query"], r["site"]): r["seq"] for r in read_first_listings(spark.read.parquet(out)).collect()}
    assert got == {("q", "http://a.org"): 2, ("r", "http://a.org"): 9, ("q", "http://b.org"): 8}
