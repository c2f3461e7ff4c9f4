import itertools
import json
import math
import signal
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.functions import bases as B
from seqloom.functions import gaps as G
from seqloom.functions import motifs as M
from seqloom.operators import corpus as C
from seqloom.operators import compare, evaluate, intervals, longmers, mixture, quantiles, sampler, scan, synth
from seqloom.operators import likelihood as L
from seqloom.plans import queries
from seqloom.sources import fasta, motif_files
from seqloom.streaming import kmers


def seqs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, seq string").withColumn("length", F.length("seq"))


UNIFORM = np.full((1, 4), -2.0)


def test_bases(spark):
    row = spark.createDataFrame([("acgtn", "ACNTNACGT", "")], "a string, b string, c string").select(
        B.encode(F.col("a")).alias("codes"), B.reverse_complement(F.col("a")).alias("rc"), B.kmers(F.col("b"), 4).alias("k"), B.kmers(F.col("c"), 2).alias("none"),
        B.context_index(F.lit("CGT")).alias("i"), B.context_index(F.lit("")).alias("zero"), B.log2_sum(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), B.log2_add(F.lit(3.0), F.lit(3.0)).alias("t"),
    ).first()
    assert row["codes"] == [0, 1, 2, 3, -1] and row["rc"] == "NACGT" and row["k"] == ["ACGT"] and row["none"] == []
    assert (row["i"], row["zero"], row["s"], row["t"]) == (27, 0, 2.0, 4.0)
    B.register(spark)
    assert spark.sql("SELECT revcomp('AACG'), size(kmers('ACGTA', 3)), log2_sum(array(0D, 0D))").first()[:] == ("CGTT", 3, 1.0)


def test_kmers_of_both_strands_and_partitions(spark):
    want = {"ACGT": 4, "CGTA": 2, "TACG": 2, "GTAC": 2}
    for parts in (1, 4, 16):
        got = {r["kmer"]: r["cnt"] for r in C.count_kmers(seqs(spark, ["ACGTACGT", "", "AC", "NNNN"]).repartition(parts), 4).collect()}
        assert got == want


def test_background(spark):
    base = {r["base"]: r["logp"] for r in C.background(seqs(spark, ["ACGT" * 25]), 0).collect()}
    assert all(abs(x + 2) < 0.1 for x in base.values())
    assert C.background(seqs(spark, ["ACGT" * 100]), 3).count() == 256
    assert C.background(seqs(spark, []), 1).agg(F.max("logp")).first()[0] == pytest.approx(-2)
    assert C.gc_content(seqs(spark, [])).first()[0] == 0.5
    with pytest.raises(ValueError):
        C.background(seqs(spark, []), 6)
    assert [C.ensemble_size(n) for n in (10, 10_000, 20_000, 1_000_000)] == [100, 200, 215, 300]


def test_enriched(spark):
    top = C.enriched(seqs(spark, ["ACGTTGCA" * 3 + "TATAAATA" + "GGCATTCG" * 2 + "TATAAATA"] * 6), 8, 5).orderBy("rnk").collect()
    assert [r["rnk"] for r in top] == [1, 2, 3, 4, 5] and all(len(r["kmer"]) == 8 for r in top)
    assert C.enriched(seqs(spark, []), 8).count() == 0


def test_motif_values():
    p = M.kmer_to_pwm("AN")
    assert p[0] == pytest.approx([-0.514573172623659, *[-3.3219280934446673] * 3]) and p[1] == pytest.approx([-2] * 4)
    assert M.iupac_pwm("A")[0] == pytest.approx([0.9625, 0.0125, 0.0125, 0.0125])
    assert M.information(np.array([[0.96, 0.02, 0.01, 0.01]])) == pytest.approx(1.6977078109175852)
    assert M.consensus(M.iupac_pwm("GATTACA")) == "GATTACA" and M.consensus(M.reverse(M.iupac_pwm("AACG"))) == "CGTT"
    a, b = M.iupac_pwm("ACGT"), M.iupac_pwm("TTTT")
    assert M.pearson(a, a) == pytest.approx(1) and M.pearson(a, b[:2]) == -1 and M.pearson(np.full((1, 4), 0.25), a[:1]) == 0
    assert M.either_strand(M.iupac_pwm("AACG"), M.iupac_pwm("CGTT")) == pytest.approx(1)
    assert M.greedy_pairs([a, b], [b, a]) == [(0, 1, pytest.approx(1)), (1, 0, pytest.approx(1))]
    assert M.kullback_leibler(a, a) == 0 and M.distance(a, b)[0] > 0
    assert M.string_match("ACG", "TACGT") == 103 and 0 < M.string_match("ACGT", "AGGT") < 1
    g = M.GappedPattern.parse("ACGT[3-8]TGCA")
    assert (len(g.blocks), g.gaps, g.length, g.consensus(), len(g.pwm())) == (2, [(3, 8)], 11, "ACGT[3-8]TGCA", 13)
    assert M.consensus_pwm("A", 0.8)[0, 0] == pytest.approx(0.85) and M.consensus_pwm("A", 0.8, "conserved")[0, 0] == pytest.approx(0.85)


def test_scan(spark):
    pwm = M.kmer_to_pwm("AAAC")
    got = {(r["seq_id"], r["pos"]): r["score"] for r in scan.scan(seqs(spark, ["TTAAACTT", "ANAACCGT", "", "AC"]), pwm).collect()}
    for i, s in enumerate(["TTAAACTT", "ANAACCGT"]):
        for p in range(5):
            w = s[p : p + 4]
            assert ("N" in w) == ((i, p) not in got)
            if "N" not in w:
                assert got[i, p] == pytest.approx(sum(pwm[j]["ACGT".index(c)] for j, c in enumerate(w)))
    best = {r["seq_id"]: r["pos"] for r in scan.best_hits(seqs(spark, ["GGAAACGG", "GGGTTTGG"]), pwm).collect()}
    assert best == {0: 2, 1: 2}


def test_best_matches_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    made = {i: rng.dirichlet([1] * 4, 3 if i % 7 else 2) for i in range(60)}
    df = spark.createDataFrame([(i, m.tolist()) for i, m in made.items()], "motif_id long, pwm array<array<double>>")
    asked = df.filter("motif_id % 5 = 0")
    for measure, one in ((compare.pearson, M.pearson), (compare.euclidean, lambda a, b: -M.distance(a, b)[0]), (compare.kullback_leibler, lambda a, b: -M.kullback_leibler(a, b))):
        want = {}
        for q in range(0, 60, 5):
            value, other = max((round(one(made[q], m), 6), -i) for i, m in made.items() if i != q and m.shape == made[q].shape)
            want[q] = (-other, pytest.approx(value, abs=2e-6))
        for block in (2000, 4):
            monkeypatch.setattr(compare, "BLOCK", block)
            assert {r["query_id"]: (r["other_id"], r["value"]) for r in compare.best_matches(asked, df, measure).collect()} == want


def test_sites_of_several_matrices_without_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = seqs(spark, ["".join("ACGTN"[i] for i in rng.integers(5, size=n)) for n in (0, 3, 4, 5, 9, 40, 200, 1)] + [None])
    matrices = [scan.Matrix("a", M.kmer_to_pwm("TA"), 2, 0.5), scan.Matrix("b", M.kmer_to_pwm("CAG"), -1, 2.0), scan.Matrix("c", M.kmer_to_pwm("G"), 7, 1.0)]
    for some in (matrices[:2], matrices):
        rows = scan.scan_matrices(df, some).groupBy("seq_id", "pos").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
        want = {(r["seq_id"], r["pos"]): pytest.approx(r["score"]) for r in rows.filter(f"n = {len(some)} and score >= -14.5").collect()}
        for letters in (10, 500_000):
            monkeypatch.setattr(L, "LETTERS", letters)
            found = scan.summed_sites(df, some, -14.5)
            assert {(r["seq_id"], r["pos"]): r["score"] for r in found.collect()} == want and want
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_letters_are_scored_at_a_time(spark, monkeypatch):
    """However many letters a batch has, an array holds few of them, or one sequence; none is left out."""
    batch = pa.RecordBatch.from_pydict({"seq_id": list(range(9)), "seq": ["A" * n for n in (3, 0, 9, 40, 1, 1, 1)] + [None, "C" * 10]})
    monkeypatch.setattr(L, "LETTERS", 12)
    cut = list(L.portions(iter([batch, batch.slice(0, 0)])))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(9))
    assert all(b.num_rows == 1 or sum(len(s or "") for s in b.column(1).to_pylist()) <= 12 for b in cut)
    held = max(b.x.size for b in L.batches([np.zeros(1_000, np.int8)] * 5_000))
    assert held <= 500_000


@pytest.mark.parametrize("measure", [compare.pearson, compare.either_strand, compare.euclidean, compare.kullback_leibler, compare.shorter])
def test_best_matches_are_chosen_from_few_pairs(spark, monkeypatch, measure):
    """Copies, motifs alike but for less than the last digit, flat rows, other lengths and odd numbers; all as by all pairs."""
    rng = np.random.default_rng(5)
    made = [rng.dirichlet([1] * 4, n).tolist() for n in (4, 4, 4, 3, 6) for _ in range(30)]
    made += made[:20] + made[:20] + [(np.array(m) + 1e-8 * i).tolist() for i, m in enumerate(made[:20])]
    made += [[[0.25] * 4] * 4, [[0.25] * 4] * 2 + made[0][:2], [[0.1, 0.1, 0.1, 0.7]] * 4]
    odd = [[[float("nan"), 0.2, 0.3, 0.5]] * 4, [[1e200, 0.2, 0.3, 0.5]] * 4, [[None, 0.2, 0.3, 0.5]] * 4, None]
    df = spark.createDataFrame([(7 * i % 997, m) for i, m in enumerate(made + odd)], "motif_id long, pwm array<array<double>>")
    asked = df.filter("motif_id % 3 = 0")
    all_pairs = lambda a, b: measure(a, b)
    if measure in compare.PREPARE:
        monkeypatch.setitem(compare.PREPARE, all_pairs, compare.PREPARE[measure])
    seen = lambda m: {r["query_id"]: (r["other_id"], str(r["value"])) for r in compare.best_matches(asked, df, m).collect()}
    want = seen(all_pairs)
    for cell, scores in ((8192, 2_000_000), (16, 100)):
        monkeypatch.setattr(compare, "CELL", cell)
        monkeypatch.setattr(compare, "SCORES", scores)
        assert seen(measure) == want
    fine = df.filter("motif_id < 910")
    ready = fine.select("motif_id", compare.PREPARE.get(measure, lambda p: p)(F.col("pwm")).alias("pwm"))
    monkeypatch.setattr(compare, "CELL", 8192)
    assert compare.candidates(ready, ready, measure).count() < 20 * ready.count()


def brute(seq, model):
    """Adds up every way to read a short sequence."""
    x = L.encode(seq)
    each = 1 / model.mean_length
    stay, enter = math.log2(1 - min(len(model.pieces) * each, 0.9999)), math.log2(each)
    moves = []
    for p in model.pieces:
        for gaps, prior in p.layouts():
            moves.append((p.blocks, gaps, prior))

    def weigh(blocks, gaps, at):
        total = 0.0
        for i, b in enumerate(blocks):
            if i:
                total += sum(-2.0 for _ in range(gaps[i - 1]))
                at += gaps[i - 1]
            for row in b:
                if x[at] < 0:
                    return -math.inf
                total += row[x[at]]
                at += 1
        return total

    def f(i):
        if i == 0:
            return 0.0
        out = [f(i - 1) - 2 + stay]
        for blocks, gaps, prior in moves:
            span = sum(map(len, blocks)) + sum(gaps)
            if i >= span:
                s = weigh(blocks, gaps, i - span)
                if model.both_strands:
                    s = max(s, weigh([M.reverse(b) for b in reversed(blocks)], gaps[::-1], i - span))
                out.append(f(i - span) + s + prior + enter)
        return float(np.logaddexp2.reduce(out))

    return f(len(x))


def test_likelihood_goldens(spark):
    texts = ["TTAAACTT", "GGGTTTGG", "ANAACCGT"]
    models = [L.Model.plain([M.kmer_to_pwm("AAAC")], UNIFORM, 8, both) for both in (False, True)]
    got = {r["model_id"]: r["log2_lik"] for r in L.score_models(seqs(spark, [*texts, ""]).repartition(3), models).collect()}
    assert got == {0: pytest.approx(-47.16082113060135), 1: pytest.approx(-43.11055707056956, abs=1e-6)}
    L.register(spark, models[0])
    seqs(spark, texts).createOrReplaceTempView("some_seqs")
    assert spark.sql("SELECT sum(seq_log2lik(seq)) FROM some_seqs").first()[0] == pytest.approx(got[0])
    pwm = np.log2(np.array([[0.9 if i == j else 0.03 if j != (i + 1) % 4 else 0.04 for j in range(4)] for i in range(4)]))
    assert L.score([L.encode("ACGTACGT")], [L.Model.plain([pwm], UNIFORM, 8, True)])[0, 0] >= L.score([L.encode("ACGTACGT")], [L.Model.plain([pwm], UNIFORM, 8, False)])[0, 0]


def test_likelihood_equals_all_paths():
    rng = np.random.default_rng(0)
    draw = lambda n: np.log2(rng.dirichlet([1] * 4, n))
    config = G.GapConfig(prior="geometric", shortest=0, longest=2, param=0.3)
    for seq, both in itertools.product(["ACGTACG", "TTNACGTA", "AC"], [False, True]):
        plain = L.Model.plain([draw(2), draw(3)], UNIFORM, 7, both)
        gapped = L.Model([L.Piece([draw(2), draw(1), draw(2)], config), L.Piece([draw(2)])], UNIFORM, 7, both)
        for m in (plain, gapped):
            assert L.score([L.encode(seq)], [m])[0, 0] == pytest.approx(brute(seq, m))
    one = draw(4)
    same = L.Model([L.Piece([one[:2], one[2:]], G.GapConfig(prior="uniform", shortest=0, longest=0))], UNIFORM, 7)
    assert L.score([L.encode("ACGTACGT")], [same])[0, 0] == pytest.approx(L.score([L.encode("ACGTACGT")], [L.Model.plain([one], UNIFORM, 7)])[0, 0])
    idle = L.Model([L.Piece([one])], UNIFORM, 7, active=[False])
    assert L.score([L.encode("ACGT")], [idle])[0, 0] == -8


def test_blocks_of_bases_equal_one_at_a_time():
    """The recursion by blocks against the same in logarithms: long and short rows, unknown bases, all backgrounds, gaps."""
    rng = np.random.default_rng(4)
    draw = lambda n, a=0.3: np.log2(rng.dirichlet([a] * 4, n) + 1e-10)
    seqs_ = ["".join("ACGTN"[i] for i in rng.choice(5, p=[0.3, 0.2, 0.2, 0.29, 0.01], size=n)) for n in (0, 1, 3, 7, 40, 41, 60, 300, 2000, 2900)]
    seqs_ += ["ACGTACGTAC" * 400]
    strong = np.where(np.eye(4)[[0, 1, 2, 3, 0, 1, 2, 3, 0, 1]] > 0, 0.0, -10.0)
    config = G.GapConfig(prior="poisson", shortest=0, longest=6, param=2.0)
    for order in (0, 1, 3):
        bg = np.log2(rng.dirichlet([1] * 4, 4**order))
        for both in (False, True):
            models = [
                L.Model.plain([draw(5)], bg, 200, both), L.Model.plain([strong, draw(12)], bg, 9, both), L.Model.plain([draw(1), draw(3)], bg, 2.5, both),
                L.Model([L.Piece([draw(4), draw(4)], config), L.Piece([draw(3), draw(2), draw(4)], lengths=[5, 0])], bg, 50, both),
            ]
            for m in models:
                for b in L.batches([L.encode(s) for s in seqs_]):
                    pieces = m.pieces
                    stay, enter = np.log2(1 - min(len(pieces) / m.mean_length, 0.9999)), np.log2(1 / m.mean_length)
                    assert b.score(m) == pytest.approx(b._score_logs(m, pieces, b.background(bg), stay, enter), rel=1e-9, abs=1e-7)
    tiny = np.full((1, 4), -40.0)
    b = L.batches([L.encode("ACGTACGTAC")])[0]
    assert b.score(L.Model.plain([strong], tiny, 9))[0] == pytest.approx(b._score_logs(L.Model.plain([strong], tiny, 9), [L.Piece([strong])], b.background(tiny), np.log2(8 / 9), np.log2(1 / 9))[0])


def test_both_ways_of_a_search_make_the_same_chains(spark, monkeypatch):
    """Chains as tasks, or jobs that score several moves of all chains; how many, and over how many parts, changes nothing."""
    data = synth.Dataset(20, synth.Lengths("normal", 60, 20, 20, 120), motifs=synth.patterns(["TATAAATA"], 0.0)).generate(spark).select("seq_id", "seq", "length").cache()
    jobs = []
    real = sampler.score_models
    monkeypatch.setattr(sampler, "score_models", lambda c, m: jobs.append(len(m)) or real(c, m))
    for options in ({"ensemble": 10}, {"deaths": 2, "adaptive": True, "gaps": G.GapConfig()}):

        def make(d=data, **o):
            search = sampler.Search(d, **{"length": 9, "ensemble": 6, "seed": 2, **options, **o})  # noqa: B023
            search.setting.max_steps = 14
            return search.run(2)

        tasks = make()
        assert len(jobs) == 1 and tasks._parts is None  # the first ensemble; what the cluster kept is given back
        jobs.clear()
        whole = make(small=0, ahead=16)
        assert 2 * (len(jobs) - 1) < sum(jobs[1:])
        other = make(data.repartition(5), small=0, ahead=3)
        for s in (whole, other):
            assert s.dead == tasks.dead and [p.dump() for p in s.particles] == [p.dump() for p in tasks.particles]
        jobs.clear()
    assert [sampler.Search(data, ensemble=n).threads for n in (4, 20, 200)] == [1, 4, 16]


def test_a_search_scores_few_moves_in_vain(spark, monkeypatch):
    """Equal sequences are scored once, and a job asks for about as many moves as go by until one is taken."""
    data = synth.Dataset(20, synth.Lengths("normal", 60, 20, 20, 120), motifs=synth.patterns(["TATAAATA"], 0.0)).generate(spark).select("seq_id", "seq", "length")
    data = data.union(data).union(data).cache()
    scored, real = [], sampler.score_models
    monkeypatch.setattr(sampler, "score_models", lambda c, m: scored.append((c.count(), len(m))) or real(c, m))
    search = sampler.Search(data, ensemble=10, seed=2, small=0)
    assert search.particles[0].log2_lik == pytest.approx(L.score([L.encode(r["seq"]) for r in data.collect()], [search.setting.model(search.particles[0])]).sum(), abs=1e-3)
    search.run(2)
    assert {n for n, _ in scored} == {data.select("seq").distinct().count()}
    # Two chains of at most 100 steps each.
    assert sum(m for _, m in scored[1:]) <= 2 * 200


def test_models_side_by_side():
    """Models of equal spans over few rows are read together, with what each gives alone, which is the recursion in logarithms."""
    rng = np.random.default_rng(3)
    bg = np.log2(rng.dirichlet([9] * 4, 16))
    x = [rng.integers(-1 if i == 1 else 0, 4, n).astype(np.int8) for i, n in enumerate((400, 390, 250, 3))]
    models = [L.Model.plain([np.log2(rng.dirichlet([1] * 4, n) + 1e-10) for n in sizes], bg, mean, both) for sizes, mean, both in [((7,), 50, True), ((7,), 50, True), ((7,), 90, True), ((7,), 50, False), ((7, 11), 50, True), ((5,), 50, True), ((7,), 50, True)]]
    models.append(L.Model.plain([np.log2([[1e-9, 1e-9, 1e-9, 1.0]] * 7)], np.full((1, 4), -60.0), 50))
    got = L.score(x, models)
    for m, row in zip(models, got, strict=True):
        n = len(m.pieces)
        for b in L.batches(x):
            logs = b._score_logs(m, m.pieces, b.background(m.bg), np.log2(1 - n / m.mean_length), np.log2(1 / m.mean_length))
            assert row[b.place] == pytest.approx(logs, rel=1e-9) and row[b.place] == pytest.approx(b.score(m), rel=1e-12)


def test_a_deck_gives_what_its_sequences_give(monkeypatch):
    """Sequences kept by slabs are scored for models side by side as each is alone: repeated, with unknown letters, over the ends of slabs and of groups, by any model."""
    rng = np.random.default_rng(6)
    bg = np.log2(rng.dirichlet([9] * 4, 16))
    x = [rng.integers(-1 if i % 5 == 1 else 0, 4, n).astype(np.int8) for i, n in enumerate([400, 2, 0, 1, 48, 96, 95, 49, 1500, *rng.integers(1, 200, size=60).tolist()])]
    times = rng.integers(1, 4, size=len(x))
    pwm = lambda n: np.log2(rng.dirichlet([1] * 4, n) + 1e-10)
    models = [L.Model.plain([pwm(n) for n in sizes], back, mean, both) for sizes in ((5,), (10,), (20,), (10, 7), (7, 12), (10,), (23,)) for back, mean, both in ((bg, 150, True), (bg, 150, False), (UNIFORM, 90, True))]
    models.append(L.Model([L.Piece([pwm(4), pwm(5)], lengths=[3])], bg, 150))
    models.append(L.Model.plain([np.log2([[1e-9, 1e-9, 1e-9, 1.0]] * 7)], np.full((1, 4), -60.0), 50))
    strong = L.Model.plain([np.log2([[0.97, 0.01, 0.01, 0.01]] * 12)], np.log2([[0.02, 0.38, 0.3, 0.3]]), 2)
    x.append(np.zeros(3000, np.int8))  # its weight is beyond what a number holds
    models.append(strong)
    times = np.append(times, 1)
    # Rounding to steps is all that the order of sums may change.
    want = [sum(L.in_steps(b.score(m), times[b.place]) for b in L.batches(x)) for m in models]
    for rows in (L.ROWS, 16):
        monkeypatch.setattr(L, "ROWS", rows)
        deck = L.Deck(x, times)
        assert deck.score(models) == pytest.approx(want, abs=int(times.sum()))
        deck.settle(models[0])
        again = L.Deck.load(deck.dump())
        assert again.score(models[:1]) == deck.score(models[:1]) and again.score(models) == deck.score(models)
    assert L.Deck([], np.array([])).score(models[:2]) == [0, 0]


def test_a_search_reads_a_large_corpus_once(spark, monkeypatch):
    """A job of a search over a corpus that isn't small gets arrays that are kept, not letters to sort anew."""
    data = synth.Dataset(20, synth.Lengths("normal", 60, 20, 20, 120), motifs=synth.patterns(["TATAAATA"], 0.0)).generate(spark).select("seq_id", "seq", "length").cache()
    kept, real = [], sampler.score_models
    monkeypatch.setattr(sampler, "score_models", lambda c, m: kept.append(c) or real(c, m))
    search = sampler.Search(data, ensemble=10, seed=2, small=0)
    search.setting.max_steps = 5
    search.step()
    assert len(kept) > 2 and {id(c) for c in kept} == {id(kept[0])} and isinstance(kept[0], L.Decks)
    models = [search.setting.model(p) for p in search.particles[:3]]
    assert kept[0].score(models) == [round(r["log2_lik"] * L.STEPS) for r in L.score_models(data, models).orderBy("model_id").collect()]
    search.close()


def _made_run(rng, live, rounds, thread=0, deaths=1):
    """A run of exact draws: the likelihood is -100 x^2 at volume x, in log2."""
    x, out = rng.random(live).tolist(), []
    for _ in range(rounds):
        worst = sorted(x, reverse=True)[:deaths]
        for j, v in enumerate(worst, 1):
            out.append((thread, -100 * v * v, live - j + 1, live - j if j < deaths else live))
            x.remove(v)
        x += (rng.random(deaths) * worst[-1]).tolist()
    return out


def test_merged_threads_give_one_evidence(spark):
    """The integral of 2^(-100 x^2) over 0 to 1 is known; threads of 10 are as good as one run of 80."""
    true = math.log2(math.sqrt(math.pi / (100 * math.log(2))) / 2)
    rng = np.random.default_rng(8)
    evidence = lambda rows, n: float(np.logaddexp2.reduce(np.add([r[1] for r in rows], sampler.log2_widths(rows, n)[0])))
    for deaths in (1, 3):
        merged, single = [], []
        for _ in range(150):
            rows = sorted((d for t in range(8) for d in _made_run(rng, 10, 90 // deaths, t, deaths)), key=lambda d: d[1])
            merged.append(evidence(rows, 80))
            single.append(evidence(_made_run(rng, 80, 720 // deaths, 0, deaths), 80))
        assert abs(np.mean(merged) - true) < 0.1 and abs(np.mean(single) - true) < 0.1
        assert np.std(merged) < 1.3 * np.std(single)
    df = spark.createDataFrame([("a", *d) for d in rows] + [("b", *d) for d in _made_run(rng, 5, 9)], "run string, thread int, log2_lik double, live int, after int")
    got = sampler.merged_evidence(df, ["run"]).orderBy("run", "step").collect()
    assert [r["log2_width"] for r in got if r["run"] == "a"] == pytest.approx(sampler.log2_widths(rows, 80)[0])
    assert got[len(rows) - 1]["log2_evidence"] == pytest.approx(merged[-1])
    # Equal likelihoods are deaths of their own.
    tied = [(0, -3.0, 4, 4), (0, -3.0, 4, 4), (1, -3.0, 5, 5), (1, -3.0, 5, 4), (0, -1.0, 4, 3)]
    last = sampler.merged_evidence(spark.createDataFrame([("t", *d) for d in tied], df.schema), ["run"]).orderBy("step").collect()
    assert [r["log2_width"] for r in last] == pytest.approx(sampler.log2_widths(tied, 9)[0])
    assert [r["log2_evidence"] for r in last] == pytest.approx(np.logaddexp2.accumulate(np.add([d[1] for d in tied], sampler.log2_widths(tied, 9)[0])))


def test_threads_agree_with_one_long_run(spark):
    """Evidence of four threads of five and of one run of twenty, within four of their standard errors."""
    data = synth.Dataset(12, synth.Lengths("fixed", 40), motifs=synth.patterns(["TATAAATA"], 0.0)).generate(spark).select("seq_id", "seq", "length").cache()
    runs = [sampler.Search(data, length=6, ensemble=20, bg_order=0, seed=4, threads=n) for n in (1, 4)]
    for r in runs:
        r.setting.max_steps = 30
        r.run(60)
    assert [len(r.log) for r in runs] == [60, 60] and {d[0] for d in runs[1].log} == {0, 1, 2, 3}
    (one, e1), (four, e4) = (r.evidence_and_error() for r in runs)
    assert 0 < min(e1, e4) and abs(one - four) < 4 * math.hypot(e1, e4)


def test_grace_of_a_search(spark):
    data = synth.Dataset(5, synth.Lengths("fixed", 30)).generate(spark).select("seq_id", "seq", "length")
    make = lambda **o: sampler.Search(data, length=6, ensemble=4, bg_order=0).run(9, "iqr", 1e9, every=2, **o).cycle
    assert (make(), make(grace=5), make(grace=100)) == (2, 6, 9)


def test_gaps(spark):
    c = G.GapConfig(prior="uniform", shortest=5, longest=10)
    assert c.log_prior(7) == pytest.approx(-math.log(6)) and c.log_prior(4) == -math.inf
    g = G.GapConfig()
    assert (g.log_prior(0), g.log_prior(5)) == (pytest.approx(-2.186703884943576), pytest.approx(-2.713506463232707))
    m = G.GappedMotif([M.kmer_to_pwm("ACGT"), M.kmer_to_pwm("AA")], [5])
    assert m.consensus() == "ACGT[5]AA" and (m.span, m.n_gaps, m.gapped) == (11, 1, True)
    three = G.GappedMotif([M.kmer_to_pwm("ACGTA"), M.kmer_to_pwm("AAAA"), M.kmer_to_pwm("CCC")], [3, 5])
    assert (three.span, three.block_length) == (20, 12)
    assert m.log_prior(G.GapConfig(prior="uniform", shortest=3, longest=10, most=2)) == pytest.approx(-math.log(3) - math.log(8))
    with pytest.raises(ValueError):
        G.GapConfig(prior="geometric", param=1.5)
    rng, free = np.random.default_rng(1), G.GapConfig(shortest=1, longest=9)
    now = G.GappedMotif([M.kmer_to_pwm("ACGTACGTACGT")])
    seen = set()
    for _ in range(300):
        move = [G.insert_gap, G.delete_gap, G.change_gap, G.shift_boundary][int(rng.integers(4))]
        new, ratio = move(now, free, rng)
        if new is not None:
            assert min(new.block_lengths) >= 4 and math.isfinite(ratio) and all(free.shortest <= x <= free.longest for x in new.gaps if x)
            now = new
            seen.add(move.__name__)
    assert len(seen) == 4


def test_first_evidence_weight(spark):
    data = synth.Dataset(5, synth.Lengths("fixed", 30)).generate(spark).select("seq_id", "seq", "length")
    for n, want in ((10, -3.4637939082301825), (20, -4.393461774083733)):
        s = sampler.Search(data, length=6, ensemble=n, bg_order=0, threads=1)
        s.step()
        assert s.log2_widths[0] == pytest.approx(want)
        assert s.log2_evidence == pytest.approx(s.dead[0] + want)
    with pytest.raises(ValueError):
        sampler.Search(data, ensemble=1)


def test_search_keeps_its_floor_and_resumes(spark, tmp_path):
    data = synth.Dataset(40, synth.Lengths("fixed", 50), motifs=synth.patterns(["TATAAATA"], 0.0), planting=synth.Planting(density=1)).generate(spark)
    data = data.select("seq_id", "seq", "length").cache()
    make = lambda parts, **o: sampler.Search(data.repartition(parts), length=8, ensemble=8, bg_order=0, seed=3, **o)
    whole = make(1).run(12)
    assert whole.dead == sorted(whole.dead) and all(p.log2_lik >= whole.dead[-1] for p in whole.particles)
    half = make(5).run(6, save=str(tmp_path / "c"))
    assert half.dead == whole.dead[:6]
    again = sampler.Search.restore(data, str(tmp_path / "c")).run(12)
    assert again.dead == pytest.approx(whole.dead) and again.log2_evidence == pytest.approx(whole.log2_evidence)
    assert sampler.inspect(spark, str(tmp_path / "c"))["cycle"] == 6
    assert make(2, deaths=3, small=0).run(1).dead == make(3, deaths=3).run(1).dead
    last = sampler.running_evidence(whole.table()).orderBy("step").collect()[-1]
    assert last["log2_evidence"] == pytest.approx(whole.log2_evidence)


def test_search_finds_a_planted_motif(spark):
    data = synth.Dataset(60, synth.Lengths("fixed", 60), motifs=synth.patterns(["TATAAATA"], 0.0), planting=synth.Planting(density=1)).generate(spark)
    data = data.select("seq_id", "seq", "length").cache()
    s = sampler.Search(data, length=8, ensemble=12, bg_order=0, seeds=C.seed_kmers(data, 1, 8), seed=5).run(60)
    found = M.perturb(s.best.motifs[0].flat())
    assert M.either_strand(found[:8], M.iupac_pwm("TATAAATA")[: len(found)]) > 0.8 if len(found) >= 8 else True


def test_shuffle_keeps_dinucleotides():
    rng = np.random.default_rng(2)
    for s in ("ACGT" * 20 + "AAAA" + "CCCC", "A", "", "AAAA", "".join("ACGT"[i] for i in rng.integers(4, size=300))):
        t = synth.shuffle_dinucleotides(s, rng)
        assert Counter(itertools.pairwise(s)) == Counter(itertools.pairwise(t))
    assert synth.shuffle_dinucleotides("ACGT" * 20 + "AAAA" + "CCCC", rng) != "ACGT" * 20 + "AAAA" + "CCCC"


def test_shuffle_of_long_runs_ends(monkeypatch):
    """Last edges that lead to the end are one draw in 27,000,000,000 here; drawn from such choices alone they are as likely as by trial."""
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    try:
        for s in ("A" * 3000 + "C" * 3000 + "G" * 3000 + "T", "G" + "T" * 90000 + "C" * 90000 + "A"):
            t = synth.shuffle_dinucleotides(s, np.random.default_rng(3))
            assert Counter(itertools.pairwise(s)) == Counter(itertools.pairwise(t)) and (s[0], s[-1]) == (t[0], t[-1])
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    s = "AACAGCGATAACA"
    pairs = Counter(itertools.pairwise(s))
    words = [[]]
    for _ in s:
        words = [w + [c] for w in words for c in ("ACGT" if w else s[0]) if not w or Counter(itertools.pairwise(w + [c])) <= pairs]
    for tries in (synth.TRIES, 0):
        monkeypatch.setattr(synth, "TRIES", tries)
        seen = Counter(synth.shuffle_dinucleotides(s, np.random.default_rng([5, i])) for i in range(60 * len(words)))
        assert set(seen) == {"".join(w) for w in words}
        assert sum((n - 60) ** 2 / 60 for n in seen.values()) < len(words) + 5 * math.sqrt(2 * len(words))


def test_shuffles_side_by_side_are_those_of_each():
    rng = np.random.default_rng(4)
    seqs = ["".join("ACGT"[i] for i in rng.choice(4, size=int(n), p=[0.7, 0.1, 0.1, 0.1])) for n in [*rng.integers(0, 90, size=150), 2000]]
    alone = [synth.shuffle_dinucleotides(s, np.random.default_rng([7, i])).encode() for i, s in enumerate(seqs)]
    assert synth.shuffle_all([s.encode() for s in seqs], [np.random.default_rng([7, i]) for i in range(len(seqs))]) == alone


def test_shuffled_counts_leave_the_task_as_counts(spark):
    """Of a text no more rows than there are dinucleotides are shuffled, and rows of one id are counted together."""
    texts = [(1, "gattaca" * 40), (2, None), (3, "aé-c"), (1, "AC"), (5, "t" * 9)]
    made = synth.count_shuffled(spark.createDataFrame(texts, "doc_id long, text string"), 7)
    assert "Generate" not in made._jdf.queryExecution().toString()
    want = Counter()
    for i, t in texts:
        want += Counter((i, a + b) for a, b in itertools.pairwise(c for c in (t or "").upper() if c in "ACGT"))
    assert {(r["seq_id"], r["kmer"]): r["cnt"] for r in made.collect()} == want


def test_shuffle_of_one_row_group_is_work_for_all(spark, tmp_path):
    """The draws are as ever; a file of one row group, which one task reads, is shuffled by several."""
    assert synth.shuffle_dinucleotides("ACGTTGCAACGGTTAACCNGTacgta", np.random.default_rng([7, 3])) == "AAGTACGTACAACGGCCGTTGTTACA"
    spark.range(200).selectExpr("id AS doc_id", "repeat('gattaca', 9) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    made = queries.QUERIES["dinucl_shuffle"](spark, str(tmp_path))
    assert made.select(F.spark_partition_id()).distinct().count() > 1 and made.count() == 200


def test_planting(spark):
    data = synth.Dataset(50, synth.Lengths("fixed", 60), motifs=synth.patterns(["ACGTACGT", "TTGG[2-4]CCAA"]), planting=synth.Planting(density=1))
    rows = data.generate(spark).collect()
    for r in rows:
        spans = sorted((p["start"], p["end"]) for p in r["planted"])
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        assert all(r["seq"][p["start"] : p["end"]] == p["sequence"] and p["start"] >= 5 and p["end"] <= 55 for p in r["planted"])
    assert rows == data.generate(spark).repartition(7).orderBy(F.substring_index("seq_id", "_", -1).cast("int")).collect()
    two = synth.splits(data, 30, 30)
    assert not {r["seq"] for r in two["train"].generate(spark).collect()} & {r["seq"] for r in two["test"].generate(spark).collect()}
    assert set(json.loads(data.truth(data.generate(spark)))) == {"config", "motifs", "sequences"}
    for kind in ("centre", "clustered"):
        synth.Dataset(5, motifs=synth.patterns(["ACGT"]), planting=synth.Planting(kind, occurrences=3, density=1)).one(1)
    assert synth.Planting(edge=5).place(12, 10, [], None, np.random.default_rng(0)) is None


def test_markov_and_lengths(spark):
    source = seqs(spark, ["ACGT" * 30, "GGCC" * 10])
    rng = np.random.default_rng(0)
    for order in (0, 2):
        m = synth.Markov.learned(source, order)
        assert len(m.generate(50, rng)) == 50 and 0 < m.gc < 1
    assert set(synth.Markov.uniform(1.0).generate(100, rng)) <= set("GC")
    assert synth.learned_lengths(source).sample(rng) in (120, 40)
    assert 50 <= synth.Lengths("lognormal", 5, 1).sample(rng) <= 1000
    assert len(synth.Shuffled(["ACGTAC", "AC"]).generate(9, rng)) == 9
    with pytest.raises(ValueError):
        synth.Markov.uniform(2)


def test_lengths_of_a_large_corpus(spark):
    many = spark.range(150_000).selectExpr("id AS seq_id", "IF(id = 149999, 7, 40 + CAST(id % 2 AS INT)) AS length")
    learned = synth.learned_lengths(many)
    assert learned.values == (7, 40, 41) and learned.counts == (1, 75_000, 74_999)
    rng = np.random.default_rng(1)
    assert {learned.sample(rng) for _ in range(50)} == {40, 41}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one first > second\r\nACGT\r\nac\r\n>two\nGG\n\n>empty\n>two\nTT")
    rows = [(r["seq_id"], r["description"], r["seq"], r["length"]) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()]
    assert rows == [("one", "one first > second", "ACGTac", 6), ("two", "two", "GG", 2), ("empty", "empty", "", 0), ("two", "two", "TT", 2)]
    df = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
    fasta.write_fasta(df, str(tmp_path / "b"))
    assert sorted(r["seq"] for r in fasta.read_fasta(spark, str(tmp_path / "b")).collect()) == sorted(r[2] for r in rows)
    last = C.last_wins(df.withColumn("ord", F.monotonically_increasing_id()))
    assert {r["seq_id"]: r["seq"] for r in last.collect()}["two"] == "TT"


def test_motif_files(spark, tmp_path):
    motifs = [("one", M.iupac_pwm("ACGTN")), ("two", M.iupac_pwm("RY"))]
    for form, read, near in (("xms", motif_files.read_xms, 1e-3), ("meme", motif_files.read_meme, 1e-5)):
        motif_files.write(motifs, str(tmp_path / form), form)
        back = read(spark, str(tmp_path / form))
        assert [n for n, _ in back] == ["one", "two"] and all(np.allclose(a, b, atol=near) for (_, a), (_, b) in zip(motifs, back, strict=True))
    motif_files.write(motifs[:1], str(tmp_path / "p"), "pfm")
    assert np.allclose(motif_files.read_jaspar(spark, str(tmp_path / "p"))[1], motifs[0][1], atol=0.01)
    (tmp_path / "bad").write_text("A 1 2\nC 1 2\n")
    with pytest.raises(ValueError):
        motif_files.read_jaspar(spark, str(tmp_path / "bad"))
    assert "P0 A C G T" in motif_files.transfac(motifs)
    (tmp_path / "v").write_text(
        '<s xmlns="u"><motif><name>m</name><weightmatrix><column pos="1"><weight symbol="thymine">1.0</weight></column>'
        '<column pos="0"><weight symbol="adenine">1.0</weight></column></weightmatrix></motif></s>'
    )
    assert M.consensus(motif_files.read_xms(spark, str(tmp_path / "v"))[0][1]) == "AT"
    (tmp_path / "t").write_text("Motif 1 (L=8): ACGTACGT\nother\n")
    assert motif_files.read_truth_text(spark, str(tmp_path / "t")).first()[:] == (1, 8, "ACGTACGT")


def test_intervals(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(int(g), i, int(s), int(s + w)) for i, (g, s, w) in enumerate(zip(rng.integers(2, size=n), rng.integers(-50, 300, n), rng.integers(0, 60, n), strict=True))]
    a, b = make(60), make(60)
    dfs = [spark.createDataFrame(x, "grp int, id int, start int, end int") for x in (a, b)]
    got = {(r["grp"], r["a_id"], r["b_id"], r["overlap"]) for r in intervals.overlaps(*dfs, width=16).collect()}
    want = {(x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and max(x[2], y[2]) < min(x[3], y[3])}
    assert got == want
    assert intervals.free(*dfs, width=16).count() == 60 - len({(g, i) for g, i, _, _ in want})


def test_stream(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGTA\n>b\nCGT\n")
    q = kmers.kmer_stream(kmers.read_stream(spark, str(tmp_path)), 3, "stream_kmers")
    q.processAllAvailable()
    q.stop()
    assert {r["kmer"]: r["cnt"] for r in spark.table("stream_kmers").collect()} == {"ACG": 1, "CGT": 2, "GTA": 1}


def test_evaluation(tmp_path):
    truth = [M.iupac_pwm(s) for s in ("GATTACAG", "TTTGGG", "CCC")]
    found = [M.iupac_pwm("CCCAAA"), M.iupac_pwm("GATTACAG", 0.2)]
    r = evaluate.report(found, truth)
    assert [(m.found, m.reversed) for m in r["matches"]] == [(1, False), (0, True), (-1, False)] and r["found"] == pytest.approx(2 / 3)
    assert r["matches"][0].by_position == pytest.approx([1] * 8) and r["strength"][2] == (pytest.approx(0.9625), 0.0)
    assert evaluate.by_strings(["CCCAAA"], ["TTTGGG"])[0][1:] == ("CCCAAA", 106.0, True) and evaluate.by_strings([], ["A"])[0][3] is False
    assert evaluate.exact(found, "TTTGGG") and not evaluate.exact(found, "AAAA")
    assert evaluate.save_logos(found, truth, str(tmp_path / "x.png")) in (True, False)


def test_mixtures():
    s = mixture.MixtureSearch(["ACGTTTAAAC", "TTAAACTT", ""], 2, 4, ensemble=5, seed=1, moves=15)
    start = s.best.total
    for _ in range(5):
        s.step()
    assert s.dead == sorted(s.dead) and s.best.total >= start and all(p.total >= s.dead[-1] for p in s.particles)
    code = L.encode("ACGTTTAAAC")
    assert mixture.sequence_likelihood(code, [M.kmer_to_pwm("AAAC")], np.array([False])) == -20
    assert mixture.sequence_likelihood(code, [M.kmer_to_pwm("AAAC")], np.array([True])) == pytest.approx(L.score([code], [L.Model.plain([M.kmer_to_pwm("AAAC")], UNIFORM, 10, False)])[0, 0])
    with pytest.raises(ValueError):
        mixture.MixtureSearch([], 1, 4, ensemble=1)


def test_cli(spark, tmp_path, capsys):
    out = str(tmp_path)
    cli.main(["generate", "-o", f"{out}/s", "-n", "12", "-L", "60", "--motif", "TATAAATA", "--truth", f"{out}/t.json", "--density", "1"])
    assert len(json.loads((tmp_path / "t.json").read_text())["sequences"]) == 12
    cli.main(["find", "-seqs", f"{out}/s", "-out", f"{out}/m.xms", "-motifLength", "8", "-maxCycles", "4", "-ensembleSize", "5", "-bgOrder", "0", "-checkpoint", f"{out}/c", "-allowGaps"])
    assert len(motif_files.read_xms(spark, f"{out}/m.xms")) == 1
    cli.main(["inspect", f"{out}/c", "-out", f"{out}/n.xms"])
    cli.main(["discover", "-seqs", f"{out}/s", "-out", f"{out}/d.xms", "-maxMotifs", "2", "-maxCycles", "2", "-ensembleSize", "4", "-bgOrder", "0"])
    cli.main(["benchmark", "-o", f"{out}/b", "--train", "6", "--test", "3", "--motif", "ACGTACGT"])
    assert fasta.read_fasta(spark, f"{out}/b/test").count() == 3
    assert "cycles 4" in capsys.readouterr().out
    text = cli.plot([0, 1, 2, 3, 4], height=5)
    assert len(text.splitlines()) == 7 and "4.00" in text and "0.00" in text and cli.plot([]) == ""


def test_pieces_of_long_records(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join("ACGTN"[i] for i in rng.integers(5, size=n)) for n in (0, 3, 9, 10, 11, 57, 200)]
    df = seqs(spark, texts)
    for k in (1, 4):
        whole = {r["kmer"]: r["cnt"] for r in C.count_kmers(df, k, strands=1).collect()}
        cut = C.pieces(df, k, 10)
        assert max(len(r["seq"]) for r in cut.collect()) <= 10 + k - 1
        assert {r["kmer"]: r["cnt"] for r in cut.select(F.explode(B.kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt")).collect()} == whole


def test_shuffled_corpus(spark):
    rng = np.random.default_rng(7)
    texts = ["".join("ACGT"[i] for i in rng.integers(4, size=n)) for n in [30] * 40 + [31, 32]]
    corpus = seqs(spark, texts)
    wanted = spark.createDataFrame([(i, 30 if i < 300 else 31 if i < 310 else 99) for i in range(330)], "id long, want int")
    got = {r["id"]: r["template"] for r in synth.ShuffledCorpus(corpus, parts=4).templates(wanted).collect()}
    assert len({got[i] for i in range(300)}) > 35 and all(len(got[i]) == 30 for i in range(300))
    assert {got[i] for i in range(300, 310)} == {texts[40]} and {got[i] for i in range(310, 330)} <= set(texts)
    data = synth.Dataset(20, synth.Lengths("fixed", 30), background=synth.ShuffledCorpus(corpus))
    made = data.generate(spark).collect()
    pairs = lambda s: sorted(s[i : i + 2] for i in range(len(s) - 1))
    assert len(made) == 20 and all(any(pairs(r["seq"]) == pairs(t) for t in texts) for r in made)
    assert synth.ShuffledCorpus(corpus.limit(0)).templates(wanted).filter("template <> ''").count() == 0


def test_random_inserts_and_suite(spark, tmp_path):
    hard = synth.PRESETS["hard"].generate(spark).collect()
    assert {len(r["planted"]) for r in hard} <= {0, 1, 2, 3} and sum(len(r["planted"]) for r in hard) > 100
    assert max(len(r["planted"]) for r in synth.replace(synth.PRESETS["complex"], n=200).generate(spark).collect()) == 4
    data = synth.Dataset(5, synth.Lengths("fixed", 40), motifs=synth.patterns(["ACGTACGT"]))
    synth.standard_suite(data, spark, str(tmp_path), 6, 4)
    for name, n, seed in (("train", 6, 42), ("test", 4, 43)):
        read = {r["seq_id"]: r["seq"] for r in fasta.read_fasta(spark, f"{tmp_path}/{name}/sequences").collect()}
        assert read == {r["seq_id"]: r["seq"] for r in synth.replace(data, n=n, seed=seed).generate(spark).collect()}
        assert spark.read.json(f"{tmp_path}/{name}/truth").count() == n


def test_mixture_likelihoods(spark):
    rng = np.random.default_rng(8)
    motifs = [mixture.uniform_pwm(4, rng) for _ in range(2)]
    rows = [("a", "ACGTACGTAA", [True, False]), ("b", "TTTT", [True, True]), ("c", "ACG", [False, False]), ("d", "", [True, True]), ("e", None, [True, False])]
    got = {r["seq_id"]: r["log2_lik"] for r in mixture.likelihoods(spark.createDataFrame(rows, "seq_id string, seq string, active array<boolean>"), motifs).collect()}
    assert got == {i: pytest.approx(mixture.sequence_likelihood(L.encode(s or ""), motifs, np.array(a))) for i, s, a in rows}
    s = mixture.MixtureSearch(["ACGTTTAAAC", "TTAAACTT", "", "ACACAC"], 2, 4, ensemble=4, seed=2, moves=25)
    for _ in range(4):
        s.step()
    for p in s.particles:
        assert p.liks == pytest.approx(s._score(p.motifs, p.active).liks)


def test_legacy_motif_file():
    text = motif_files.legacy_xms([("m", np.array([[0.7, 0.1, 0.1, 0.1]]))], [0.25])
    assert "<motif id='0' weight='0.25'>" in text and "<weightMatrix length='1'>" in text and "0.7000 0.1000 0.1000 0.1000" in text
    assert "<weight>0.5</weight>" in motif_files.xms([("m", np.full((2, 4), 0.25))], weights=[0.5])


def test_sql_functions(spark):
    B.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT pos, kmer FROM kmer_table('acgNtt', 2) ORDER BY pos").collect()] == [(0, "AC"), (1, "CG"), (4, "TT")]
    scan.register(spark, M.kmer_to_pwm("ACG"))
    got = spark.sql("SELECT pwm_scan(s) AS x FROM VALUES ('ttACGtt'), ('CGTA'), ('AC'), (null) AS t(s)").collect()
    best = 3 * math.log2(0.7)
    assert [None if r["x"] is None or r["x"] != r["x"] else round(r["x"], 6) for r in got] == [round(best, 6), round(best, 6), None, None]


@pytest.mark.parametrize("gaps", [2, 3, 4])
def test_any_number_of_gaps(gaps):
    """A state for each block against all ways to read a sequence, several gaps and motifs; unknown letters and short sequences too."""
    rng = np.random.default_rng(gaps)
    config = G.GapConfig(prior="geometric", param=0.3, shortest=0, longest=2)
    blocks = [np.log2(rng.dirichlet([1] * 4, int(n))) for n in rng.integers(2, 4, gaps + 1)]
    bg = np.log2(rng.dirichlet([1] * 4, 4))
    model = L.Model([L.Piece(blocks, config), L.Piece([M.kmer_to_pwm("ACG")])], bg, 12.0, both_strands=False)
    seqs = ["".join("ACGTN"[i] for i in rng.choice(5, n, p=[0.24] * 4 + [0.04])) for n in (0, 3, 9, 14, 30, 31, 80)]
    slow = L.Model([L.Piece(blocks, lengths=list(g)) for g in itertools.product(range(3), repeat=gaps)], bg, 12.0, both_strands=False)
    got = L.score([L.encode(s) for s in seqs], [model])[0]
    for s, value in zip(seqs, got, strict=True):
        x = L.encode(s)[None, :]
        base = L._background(x, bg)[0]
        f = [0.0]
        stay, enter = np.log2(1 - 2 / 12), np.log2(1 / 12)
        moves = [(span, m[0], sum(config.log_prior(g) for g in p.lengths) / np.log(2)) for p in slow.pieces for span, m in L._emissions(x, p, base[None, :], L.window_codes(x))]
        moves += [(3, L.block_scores(x, M.kmer_to_pwm("ACG"))[0], 0.0)]
        for i in range(1, len(s) + 1):
            f.append(np.logaddexp2.reduce([f[i - 1] + base[i - 1] + stay, *[f[i - n] + m[i - n] + prior + enter for n, m, prior in moves if i >= n]]))
        assert value == pytest.approx(f[-1], abs=1e-8)


def test_work_grows_with_the_range_of_gaps():
    """Three gaps of up to 200 bases would be eight million layouts."""
    piece = L.Piece([M.kmer_to_pwm(b) for b in ("TATA", "CCAA", "GGCC", "TTAA")], G.GapConfig(prior="uniform", shortest=0, longest=199))
    seq = "TATA" + "A" * 150 + "CCAA" + "C" * 120 + "GGCC" + "TTAA" + "ACGT" * 50
    far, near = (L.score([L.encode(seq)], [L.Model([p], np.full((1, 4), -2.0), 500.0, both_strands=False)])[0, 0] for p in (piece, L.Piece(piece.blocks, G.GapConfig(longest=5))))
    assert far > near


def test_gap_moves_can_be_undone():
    """Each move's ratio is minus that of its way back, and no move makes a gap that counts as none."""
    rng = np.random.default_rng(11)
    config = G.GapConfig(shortest=0, longest=4, most=2)
    m = G.GappedMotif([M.kmer_to_pwm("ACGTACGTACGT")])
    for _ in range(300):
        new, ratio = G.insert_gap(m, config, rng)
        assert min(new.gaps) > 0
        back = None
        while back is None:
            back, other = G.delete_gap(new, config, rng)
        assert other == pytest.approx(-ratio) and np.allclose(back.flat(), m.flat())
        for move in (G.change_gap, G.shift_boundary):
            other, ratio = move(new, config, rng)
            assert other is None or (min(other.gaps) > 0 and ratio == 0.0)
    assert G.insert_gap(m, G.GapConfig(shortest=0, longest=0), rng)[0] is None


def test_wide_query_motifs_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK_BYTES", 500)
    motifs = spark.createDataFrame([(i, [[0.1 * (i % 7) + 0.1, 0.3, 0.2, 0.4 - 0.05 * (i % 7)]] * 5) for i in range(12)], "motif_id long, pwm array<array<double>>")
    pairs = compare.pairs(motifs, motifs, 3)
    assert "hint" not in pairs._jdf.queryExecution().logical().toString().lower()
    assert sorted((r["query_id"], r["other_id"]) for r in pairs.collect()) == [(i, j) for i in range(12) for j in range(12) if i != j]


def test_free_intervals_by_brute_force(spark):
    """Ends that touch, bins in a row, groups of one key, empty and null intervals, repeated rows; no pair is made."""
    rng = np.random.default_rng(4)
    made = lambda n, at: [(str(g), int(s), int(s + w), i + at) for i, (g, s, w) in enumerate(zip(rng.integers(0, 3, n), rng.integers(-60, 60, n), rng.integers(0, 25, n), strict=True))]
    a = [*made(120, 0), ("0", 5, 5, 900), (None, 1, 9, 901), ("1", None, 4, 902), ("1", 1, None, 903), ("7", 0, 9, 904), ("7", 0, 9, 904)]
    taken = [*made(12, 1000), (None, 0, 99, 1), ("2", None, 99, 2), ("7", 9, 12, 3), ("7", -4, 0, 4)]
    schema = "grp string, start long, end long, id long"
    hit = lambda x: None not in x[:3] and x[1] < x[2] and any(None not in t[:3] and t[0] == x[0] and max(t[1], x[1]) < min(t[2], x[2]) for t in taken)
    want = sorted((x for x in a if not hit(x)), key=repr)
    for width in (1, 7, 1_000):
        df = intervals.free(spark.createDataFrame(a, schema), spark.createDataFrame(taken, schema), width)
        assert sorted((tuple(r) for r in df.collect()), key=repr) == want
    assert 20 < len(want) < len(a)


def test_log2_sums_of_groups(spark):
    rows = [("a", float(x)) for x in np.random.default_rng(1).normal(0, 900, 400)] + [("b", None), ("c", -math.inf), ("d", -math.inf), ("d", 3.0), ("e", 1e6), ("e", 1e6), ("f", math.inf)]
    df = spark.createDataFrame(rows, "k string, x double")
    values = {k: [x for kk, x in rows if kk == k and x is not None] for k in "abcdef"}
    want = {k: float(np.logaddexp2.reduce(v)) for k, v in values.items() if v}
    got = {r["k"]: r["total"] for r in B.log2_sum_by(df, ["k"], "x").collect()}
    assert got == pytest.approx(want)
    B.register(spark)
    df.createOrReplaceTempView("log2_rows")
    found = {r["k"]: r["v"] for r in spark.sql("SELECT k, log2sumexp(x) AS v FROM log2_rows GROUP BY k").collect()}
    assert found.pop("b") is None and found == pytest.approx(want)


@pytest.mark.parametrize("k", [12, 21, 31])
def test_long_kmers_by_brute_force(spark, monkeypatch, k):
    """Both strands, palindromes, lower case, unknown letters, short and null sequences, many buckets; few letters are shuffled."""
    rng = np.random.default_rng(k)
    base = "".join("ACGT"[i] for i in rng.integers(4, size=400))
    turn = str.maketrans("ACGT", "TGCA")
    seqs = [base, base, base[50:200].lower(), base.translate(turn)[::-1], base[:90] + "N" + base[90:200], "A" * 80, "ACGT" * 20, base[: k - 1], "", None]
    for strands in (1, 2):
        want = Counter()
        for s in seqs:
            s = (s or "").upper()
            for i in range(len(s) - k + 1):
                if "N" not in (w := s[i : i + k]):
                    want[w] += 1
                    if strands == 2:
                        want[w.translate(turn)[::-1]] += 1
        df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")
        for size in (100, longmers.BUCKET):
            monkeypatch.setattr(longmers, "BUCKET", size)
            rows = C.count_kmers(df, k, strands).collect()
            assert len(rows) == len(want) and {r["kmer"]: r["cnt"] for r in rows} == want
    big = spark.createDataFrame([(i, "".join("ACGT"[x] for x in rng.integers(4, size=5_000))) for i in range(8)], "seq_id long, seq string")
    shuffled = longmers.super_kmers(big, k).agg(F.sum(F.length("run") + 16)).first()[0]
    assert shuffled < (0.7 if k == 12 else 0.5) * 8 * (5_000 - k + 1) * (k + 8)
    with pytest.raises(ValueError):
        longmers.count(df, 32, 1, 1)


def test_runs_of_windows_are_found_all_at_once():
    """A million short sequences are no slower to cut than a long one: runs come from arrays, not from a loop over sequences."""
    codes = np.tile(np.array([0, 1, 2, 3, 2, 2, 1, 0, 3, 3, 0, 1, 2, 0, -1], np.int8), 100_000)
    found = longmers.runs(codes, 12)
    assert all(isinstance(x, np.ndarray) for x in found)
    least, start, end = found
    assert ((end - start >= 12) & (end - start <= 14)).all() and (end - start - 11).sum() == 3 * 100_000
    assert all((codes[s:e] >= 0).all() for s, e in zip(start[:50], end[:50], strict=True)) and len(set(zip(least[1:-1].tolist(), (start[1:-1] % 15).tolist(), strict=True))) <= 3


def test_bases_side_by_side_are_those_one_by_one(monkeypatch):
    """The recursion over a batch gives each sequence as drawn alone, whatever is beside it."""
    rng = np.random.default_rng(9)
    for order in (0, 1, 3):
        model = synth.Markov(order, rng.dirichlet([0.5] * 4, 4**order), rng.dirichlet([1] * 4))
        draws = [rng.random(n) for n in (0, 1, 2, 50, 7, 50, 300)]
        want = []
        for u in draws:
            ctx, out = 0, ""
            for i, x in enumerate(u):
                b = min(3, int(np.searchsorted(np.cumsum(model.init if i < order else model.table[ctx]), x, side="right")))
                ctx, out = (ctx * 4 + b) % 4**order, out + "ACGT"[b]
            want.append(out)
        for cells in (1, 400, 2_000_000):
            monkeypatch.setattr(synth, "CELLS", cells)
            assert model.spell(draws) == want


def test_quantiles_of_groups(spark, monkeypatch):
    """Exact by narrowing ranges: wide and tied values, one row, nulls, a null group."""
    monkeypatch.setattr(quantiles, "FEW", 5)
    monkeypatch.setattr(quantiles, "CUTS", 4)
    rng = np.random.default_rng(2)
    rows = [("wide", float(x)) for x in np.exp(rng.normal(0, 40, 900)) * rng.choice([-1, 1], 900)] + [("tied", float(x)) for x in rng.integers(0, 3, 500)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 4.0), ("none", None), (None, 2.0), (None, 8.0), ("tied", None)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["share"]): r["value"] for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", shares).collect()}
    want = {(k, p): float(np.quantile([x for kk, x in rows if kk == k and x is not None], p)) for k in ("wide", "tied", "one", "two", None) for p in shares}
    assert got == pytest.approx(want, rel=1e-12)


def test_matrix_and_threads_by_command_line(spark, tmp_path):
    """A transition matrix from a file, and a search with as many threads as asked for."""
    (tmp_path / "m.txt").write_text("0 1 0 0\n0 0 1 0\n0 0 0 1\n2 0 0 0\n")
    out = str(tmp_path / "made")
    cli.main(["generate", "-o", out, "-n", "8", "-L", "24", "--bg-matrix", str(tmp_path / "m.txt"), "--density", "0"])
    seqs = [r["seq"] for r in fasta.read_fasta(spark, out).collect()]
    assert len(seqs) == 8 and all(s in "ACGT" * 7 for s in seqs)
    with pytest.raises(ValueError):
        synth.Markov.of_rows([[1, 1, 1, 1]] * 3)
    options = cli.parser().parse_args(["find", "-seqs", out, "-out", "x", "-threads", "2"])
    assert options.threads == 2 and cli.parser().parse_args(["discover", "-seqs", out, "-out", "x"]).threads == 0
