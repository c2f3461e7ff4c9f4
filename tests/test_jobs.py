"""The jobs over growing copies of a table, run again, and against SQL."""

import json
import logging

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import kmer_census, motif_sites, queries

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = duck.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df) == sorted(rel.select(", ".join(df.columns)).fetchall(), key=repr)


def test_census_takes_only_what_is_new(spark, tmp_path, caplog):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", ""), (-3, "ACGT" * 9, ""), (-4, "acgtacgtacgt", "a/b=c")], "doc_id long, text string, source string")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: kmer_census.run(spark, source, out, mark, {"files_per_batch": 1})
    counts = lambda: spark.read.schema(kmer_census.COUNTS).parquet(f"{out}/counts")
    with caplog.at_level(logging.INFO, logger="kmer_census"):
        docs.filter("doc_id % 3 = 0").select("doc_id", "text", "source").coalesce(1).write.mode("append").parquet(source)
        first = rows(run())
        docs.filter("doc_id % 3 <> 0").select("doc_id", "text", "source").unionByName(odd).coalesce(2).write.mode("append").parquet(source)
        second, before = rows(run()), rows(counts())
        third = rows(run())
    assert first != second == third and before == rows(counts())
    taken = [r.args[:2] for r in caplog.records if r.msg.startswith("batch")]
    assert [n for n, _ in taken] == [0, 1, 2] and taken[0][1] == docs.filter("doc_id % 3 = 0").count() and taken[1][1] + taken[2][1] == docs.filter("doc_id % 3 <> 0").count() + 4
    assert [r[0] for r in counts().select("batch").distinct().orderBy("batch").collect()] == [0, 1, 2]
    whole = kmer_census.run(spark, source, str(tmp_path / "whole"), str(tmp_path / "whole-mark"))
    assert rows(whole) == second


def test_census_batch_again_replaces_itself(spark, tmp_path):
    """A batch that failed after its writing is taken again under its number."""
    batch = spark.createDataFrame([(1, "ACGTACGTAA", "x")], "doc_id long, text string, source string")
    for text in ("ACGTACGTAA", "ACGTACGTAA"):
        kmer_census.take(batch, 7, str(tmp_path), kmer_census.DEFAULTS)
    counts = spark.read.schema(kmer_census.COUNTS).parquet(f"{tmp_path}/counts")
    assert counts.agg(F.sum("cnt"), F.max("batch")).first() == (5, 7)


def test_sites_by_brute_force(spark, tmp_path):
    texts = [(1, "GGTATAATGG"), (2, "ccattatacc"), (3, "GG"), (4, None), (5, "CACGTGxxCACGTG"), (None, "TATAAT"), (6, "N" * 50), (6, "TATAAT")]
    source = str(tmp_path / "in")
    spark.createDataFrame(texts, "doc_id long, text string").write.json(source)
    out = str(tmp_path / "out")
    got = {}
    for _ in range(2):
        sites, places = motif_sites.run(spark, source, out, {"format": "json"})
        assert got in ({}, {"sites": rows(sites), "places": rows(places)})
        got = {"sites": rows(sites), "places": rows(places)}
    turn = str.maketrans("ACGT", "TGCA")
    want = []
    for doc, text in texts:
        seq = "".join(c for c in (text or "").upper() if c in "ACGT")
        for name, m in motif_sites.matrices(motif_sites.DEFAULTS).items():
            best = None
            for i in range(len(seq) - len(m) + 1):
                for strand, site in (("+", seq[i : i + len(m)]), ("-", seq[i : i + len(m)].translate(turn)[::-1])):
                    score = round(sum(float(r["ACGT".index(c)]) for r, c in zip(m, site, strict=True)), 9)
                    if best is None or score > best[3]:
                        best = (doc, i, strand, score, site, name)
            if best and best[3] >= motif_sites.bounds(motif_sites.DEFAULTS)[name]:
                want.append(best)
    assert [r[:3] + r[4:] for r in got["sites"]] == sorted((r[:3] + r[4:] for r in want), key=repr) and len(want) >= 5
    assert all(sum(r[1:5]) == sum(w[5] == r[5] for w in want) for r in got["places"])


def test_command_lines(spark, tmp_path, monkeypatch):
    """The command line reads its configuration and passes plain paths on; it creates and stops the session."""
    calls = []
    (tmp_path / "c.json").write_text(json.dumps({"k": 4}))

    class Builder:
        def appName(self, name):
            return self

        def getOrCreate(self):
            return Session()

    class Session:
        read = spark.read

        def stop(self):
            calls.append("stop")

    for job, extra in ((kmer_census, ["--checkpoint", "/c"]), (motif_sites, [])):
        monkeypatch.setattr(job.SparkSession, "builder", Builder())
        monkeypatch.setattr(job, "run", lambda *a: calls.append(a[1:]))
        job.main(["--input", "/i", "--output", "/o", *extra, "--config", str(tmp_path / "c.json")])
    assert calls == [("/i", "/o", "/c", {"k": 4}), "stop", ("/i", "/o", {"k": 4}), "stop"]
