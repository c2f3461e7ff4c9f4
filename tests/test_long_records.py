"""Long records: FASTA by byte ranges, as a stream, and likelihoods from pieces."""

import gzip

import numpy as np
import pytest

from seqloom.functions import gaps as G
from seqloom.functions import motifs as M
from seqloom.operators import likelihood as L
from seqloom.sources import fasta, fasta_source

TEXT = "lost letters\n>one first > record\r\nACGT\r\nAC GT\n>two\n\n>\n>  odd\nNN\n>three\n" + "ACGTTGCA" * 40 + "\n>four"
WHOLE = [("one", "first > record", "ACGTACGT"), ("two", "", ""), ("", "  odd", "NN"), ("three", "", "ACGTTGCA" * 40), ("four", "", "")]


def joined(rows):
    """Pieces in order as ``(id, seq)`` of whole records; a record's pieces follow each other without gaps."""
    out, parts = [], []
    for r in rows:
        assert r["at"] == sum(map(len, parts))
        parts.append(r["seq"])
        if r["last"]:
            out.append((r["seq_id"], "".join(parts)))
            parts = []
    assert not parts
    return out


def test_any_cut_reads_every_record_once(tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(TEXT)
    size = len(TEXT.encode())
    for width in (1, 2, 3, 7, 50, 10_000):
        for letters in (1, 8, 1_000):
            rows = [r for part in fasta_source.ranges(fasta_source.files(str(path)), width) for b in fasta_source.read_range(part, letters) for r in b.to_pylist()]
            assert joined(rows) == [(i, s) for i, _, s in WHOLE], (width, letters)
            assert all(len(r["seq"]) <= letters for r in rows)
    assert sum(p.end - p.start for p in fasta_source.ranges(fasta_source.files(str(path)), 7)) == size


def test_small_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(fasta_source, "BLOCK", 3)
    path = tmp_path / "a.fa"
    path.write_text(TEXT)
    rows = [r for part in fasta_source.ranges(fasta_source.files(str(path)), 40) for b in fasta_source.read_range(part, 16) for r in b.to_pylist()]
    assert joined(rows) == [(i, s) for i, _, s in WHOLE]


def test_format_and_plain_reader_agree(spark, tmp_path):
    """One large file is many partitions; folders, compressed and empty files are read too."""
    fasta_source.register(spark)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    text = TEXT.split("\n", 1)[1]
    (tmp_path / "in" / "a.fa").write_text(text)
    (tmp_path / "in" / "empty.fa").write_text("")
    (tmp_path / "in" / "_SUCCESS").write_text(">no\nA")
    with gzip.open(tmp_path / "in" / "sub" / "b.fa.gz", "wt") as f:
        f.write(">zip\nGATTACA\n")
    df = spark.read.format("fasta").option("rangeBytes", 50).load(str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() == -(-len(text.encode()) // 50) + 1
    want = {(r["seq_id"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "in" / "a.fa")).collect()} | {("zip", "GATTACA")}
    assert {(r["seq_id"], r["seq"]) for r in df.collect()} == want
    assert {r["description"] for r in df.collect()} == {"one first > record", "two", "  odd", "three", "four", "zip"}
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("fasta").load(str(tmp_path / "nowhere")).count()


def test_stream_takes_new_files(spark, tmp_path):
    fasta_source.register(spark)
    source, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("fasta").option("pieceLetters", 4).load(source)
        stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["seq_id"], r["at"], r["seq"]) for r in spark.read.parquet(out).collect())

    (tmp_path / "in" / "1.fa").write_text(">a\nACGTAC\n")
    first = run()
    (tmp_path / "in" / "2.fa").write_text(">b\nTT\n")
    assert first == [("a", 0, "ACGT"), ("a", 4, "AC")] and run() == [*first, ("b", 0, "TT")] == run()


MODELS = {
    "learned": L.Model.plain([M.kmer_to_pwm("TATAAT"), M.kmer_to_pwm("CCAATGG")], np.log2(np.random.default_rng(1).dirichlet([1] * 4, 64)), 30.0),
    "gapped": L.Model([L.Piece([M.kmer_to_pwm("TAT"), M.kmer_to_pwm("AAT")], G.GapConfig(prior="uniform", shortest=0, longest=4))], np.full((1, 4), -2.0), 30.0),
    "none": L.Model([], np.full((1, 4), -2.0), 30.0),
}


def test_pieces_give_the_whole_record(spark):
    """A record over many tasks has the likelihood of the unsplit one, unknown letters and empty records too."""
    rng = np.random.default_rng(0)
    seqs = ["".join("ACGTN"[i] for i in rng.choice(5, n, p=[0.24] * 4 + [0.04])) for n in (0, 1, 5, 40, 41, 400, 3_000)]
    models = list(MODELS.values())
    letters = L.context_letters(models)
    data = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    want = L.score([L.encode(s) for s in seqs], models)
    for size in (letters, 40, 1_000):
        pieces = fasta_source.with_context(fasta_source.cut(data, size), letters)
        assert pieces.filter("at > 0").count() == sum(max(0, -(-len(s) // size) - 1) for s in seqs)
        got = {(r["model_id"], r["seq_id"]): r["log2_lik"] for r in L.score_pieces(pieces, models).collect()}
        assert len(got) == want.size and all(got[k, i] == pytest.approx(want[k, i], abs=1e-7) for k in range(len(models)) for i in range(len(seqs)))


def test_weights_that_no_matrix_holds():
    with pytest.raises(ValueError):
        L.transfer(np.empty(0, np.int8), L.encode("ACGTACGTACGT"), L.Model.plain([np.full((9, 4), 0.0)], np.full((1, 4), -40.0), 9.0))


def test_pieces_of_one_length_side_by_side():
    """As each by itself, unknown letters among them."""
    rng = np.random.default_rng(3)
    model = L.Model.plain([M.kmer_to_pwm("TATAAT"), M.kmer_to_pwm("CCAAT")], np.full((1, 4), -2.0), 30.0, True)
    before, x = rng.integers(-1, 4, (20, 5)).astype(np.int8), rng.integers(-1, 4, (20, 90)).astype(np.int8)
    many = L.transfers(before, x, model)
    for i in range(20):
        for a, b in zip(many, L.transfer(before[i], x[i], model), strict=True):
            assert np.allclose(a[i], b, rtol=1e-12)
